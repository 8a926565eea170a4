"""Languages of transcripts and their segments by compression.

A text is compressed with the raw content of each language as a zstandard dictionary; the language whose
dictionary leaves the fewest bytes is taken, unless another leaves hardly more.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captide.llm.turns import BLOCK, Grammar, speech_of
from captide.sources.shared import settled

LANGUAGES = ("en", "ru", "uk", "de", "es", "fr")
CYRILLIC = frozenset(("ru", "uk"))
#: Labelled segments that the dictionaries are made from: about FIT_SEGMENTS in all, and of a rare language
#: FIT_LEAST if there are so many; none of more characters than FIT_CHARACTERS.
FIT_SEGMENTS, FIT_LEAST, FIT_CHARACTERS = 24_000, 1_000, 5_000
#: Bytes of a dictionary.
DICT_BYTES = 80_000
#: A segment is in another language than its video's if that saves at least so many bytes, and so much of the size.
MARGIN_BYTES, MARGIN_SHARE = 3, 0.15
#: The size where a language was not tried, and the code of a text whose language can't be told.
NEVER, UNKNOWN = 9999, "und"

# Codes of three letters.
THREE_LETTERS = {"eng": "en", "rus": "ru", "ukr": "uk", "deu": "de", "ger": "de", "spa": "es", "fra": "fr", "fre": "fr"}

_DIGITS = re.compile(r"\d+")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_LATIN = re.compile(r"[a-zß-ÿœ]", re.I)
_LETTER = re.compile(r"[^\W\d_]")


def language_code(label: Column) -> Column:
    """The two-letter code that a label stands for, in whatever spelling; null if it names none."""
    base = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "_", "-"), "^asr-?", "")
    base = F.split(base, "-")[0]
    known = F.create_map(*(F.lit(x) for kv in (THREE_LETTERS | {c: c for c in LANGUAGES}).items() for x in kv))
    return F.when(label.isNotNull(), F.try_element_at(known, base))


def plain(words: str) -> str:
    """What tells the language: lower case, without numbers and without names (capitals after the first word)."""
    w = words.split(" ")
    return " ".join([w[0].lower(), *(x for x in w[1:] if not x[:1].isupper() or x.isupper() and len(x) > 1)]).lower() if w[0] else ""


# one byte a letter in either script, so that matches are as long
_CP1251 = {ord(c): c.encode("cp1251")[0] for c in "абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ"}


def scripts(text: str) -> tuple[bool, bool]:
    """Whether Latin and Cyrillic letters may tell the text's language. A few look-alikes of the other
    script change nothing."""
    cyrillic, latin = not text.isascii() and bool(_CYRILLIC.search(text)), bool(_LATIN.search(text))
    if cyrillic and latin:
        c, n = len(_CYRILLIC.findall(text)), len(_LATIN.findall(text))
        return n * 4 > c, c * 4 > n
    return latin, cyrillic


def _bytes(text: str, latin: bool, cyrillic: bool) -> bytes:
    """The text in one byte a letter; letters of further scripts are a sign."""
    text = f" {_DIGITS.sub('', text)} "
    if cyrillic and latin:
        return text.translate(_CP1251).encode("latin-1", "replace")
    return text.encode("cp1251" if cyrillic else "latin-1", "replace")


class Sizes:
    """Compressed sizes of texts by language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.run = {}
        for lang, raw in dictionaries.items():
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=17, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.run[lang] = zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress
        self.cyrillic = [(i, self.run[x]) for i, x in enumerate(self.langs) if x in CYRILLIC]
        self.latin = [(i, self.run[x]) for i, x in enumerate(self.langs) if x not in CYRILLIC]

    def of(self, text: str) -> list[int]:
        """The size by each language of a script that the text has letters enough of; else NEVER."""
        out = [NEVER] * len(self.langs)
        latin, cyrillic = scripts(text)
        if latin or cyrillic:
            raw = _bytes(text, latin, cyrillic)
            for i, run in self.latin * latin + self.cyrillic * cyrillic:
                out[i] = len(run(raw))
        return out


#: Compression level; higher ones take longer and tell languages apart no better (measured).
LEVEL = 1


def fit(samples: list[tuple[str, str, str]], rounds: int = 3) -> dict[str, bytes]:
    """Dictionaries from (video, language, text). Labels may be wrong and videos mixed: each round gives a
    video to the language that its words were seen in most, and a text to that of its video unless its
    own words speak clearly for another."""
    texts = [(lang, video, text, text.split()) for video, lang, text in sorted({s for s in samples if None not in s}) if text and lang in LANGUAGES]
    for _ in range(rounds):
        counts, total = _counts(texts)
        scores = [[sum(math.log((counts[lang][w] + 0.1) / total[lang]) for w in words) for lang in LANGUAGES] for *_, words in texts]
        of_video: dict[str, list[float]] = {}
        for (_, video, *_), score in zip(texts, scores):
            of_video[video] = [x + y for x, y in zip(of_video.get(video, [0.0] * len(LANGUAGES)), score)]
        moved = []
        for (_, video, text, words), score in zip(texts, scores):
            whole = of_video[video]
            home = max(range(len(LANGUAGES)), key=whole.__getitem__)
            best = max(range(len(LANGUAGES)), key=lambda i: score[i] + (5.0 if i == home else 0.0))
            moved.append((LANGUAGES[best], video, text, words))
        texts = moved
    counts, total = _counts(texts)
    own = {lang: {w for w in c if c[w] > 1 and c[w] / total[lang] > 4 * max(counts[o][w] / total[o] for o in LANGUAGES if o != lang)} for lang, c in counts.items()}
    # a text all of whose words are rare is told by its letters
    letters = {lang: Counter() for lang in LANGUAGES}
    for lang, text in {(lang, text) for lang, _, text, _ in texts}:
        letters[lang].update(_trigrams(text))
    amount = {lang: sum(c.values()) + 1 for lang, c in letters.items()}

    def spelled(text: str, lang: str) -> bool:
        own_part = Counter(_trigrams(text))  # the text itself doesn't count
        score = {x: sum(n * math.log((max(0, letters[x][g] - n * (x == lang)) + 0.5) / amount[x]) for g, n in own_part.items()) for x in LANGUAGES}
        return score[lang] >= max(score.values())

    out = {}
    for lang in LANGUAGES:
        # texts with words of no other language; those that bring words not yet in the dictionary first
        rows = [(text, words) for x, _, text, words in texts if x == lang and sum(w in own[lang] for w in words) * 2 > len(words)]
        rows.sort(key=lambda r: xxhash.xxh64_intdigest(r[0]))
        have: set[str] = set()
        raw: list[bytes] = []
        size = 0
        for fresh in (True, False):
            for text, words in rows:
                new = own[lang].intersection(words) - have
                if fresh == bool(new) and size < DICT_BYTES and spelled(text, lang):
                    have |= new
                    raw.append(_bytes(text, *scripts(text)))
                    size += len(raw[-1])
        out[lang] = b"".join(reversed(raw)) or b" " * 16
    return out


def _trigrams(text: str) -> list[str]:
    t = f" {_DIGITS.sub('', text)} "
    return [t[i : i + 3] for i in range(len(t) - 2)]


def _counts(texts: list[tuple[str, str, str, list[str]]]) -> tuple[dict[str, Counter], dict[str, int]]:
    counts = {lang: Counter() for lang in LANGUAGES}
    for lang, *_, words in texts:
        counts[lang].update(set(words))
    return counts, {lang: sum(c.values()) + 1 for lang, c in counts.items()}


def segment_sizes(segments: DataFrame, videos: DataFrame, speakers: DataFrame) -> DataFrame:
    """(video_id, seg_idx, words, sizes): the number of telling words and the sizes by language of each
    segment that has any, repeated rows as they are."""
    own = segments.where("video_id IS NOT NULL AND seg_idx IS NOT NULL AND text IS NOT NULL").select("video_id", F.col("seg_idx").cast("bigint").alias("seg_idx"), "text")
    labels = videos.where("video_id IS NOT NULL").groupBy("video_id").agg(F.min(language_code(F.col("language"))).alias("lang"))
    # a row a video and a row a language: no text is shuffled to count them
    counts = {lang: n for lang, n in own.groupBy("video_id").count().join(labels.where("lang IS NOT NULL"), "video_id").groupBy("lang").agg(F.sum("count")).collect()}
    usual = max(1, sum(counts.values()) // FIT_SEGMENTS)
    share = {lang: max(1, min(usual, n // FIT_LEAST)) for lang, n in counts.items()}
    picked = lambda n: F.pmod(F.xxhash64("video_id", "seg_idx"), F.lit(n)) == 0
    short = own.where(F.length("text") <= FIT_CHARACTERS)
    sample = short.where(picked(usual)).join(labels.where("lang IS NOT NULL"), "video_id").select("video_id", "lang", "text")
    for lang in (x for x, n in share.items() if n < usual):  # of a rare language there are few videos
        sample = sample.where(F.col("lang") != lang).unionByName(short.where(picked(share[lang])).join(labels.where(F.col("lang") == lang), "video_id").select("video_id", "lang", "text"))
    grammar = Grammar()
    dictionaries = fit([(r[0], r[1], plain(speech_of(grammar, r[2]))) for r in sample.collect()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar, sizes = Grammar(), Sizes(dictionaries)
        for b in batches:
            keep, words, out = [], [], []
            for i, text in enumerate(b["text"].tolist()):
                p = plain(speech_of(grammar, text))
                if _LETTER.search(p):
                    keep.append(i)
                    words.append(p.count(" ") + 1)
                    out.append(sizes.of(p))
            yield pd.DataFrame({"video_id": b["video_id"].to_numpy()[keep], "seg_idx": b["seg_idx"].to_numpy()[keep], "words": words, "sizes": out})

    return own.mapInPandas(run, "video_id string, seg_idx bigint, words int, sizes array<smallint>")


def languages(segments: DataFrame, videos: DataFrame, speakers: DataFrame) -> DataFrame:
    """(video_id, seg_idx, lang, confidence, label): with seg_idx -1 the main language of each video that
    has segments with words and the code its own label names; with a seg_idx each segment that isn't in
    its video's. ``lang`` is ``und`` where the margin is too narrow to tell, or the script is of no known
    language.

    Null ids and texts, and segments without words, give nothing; repeated rows count once; a video
    without a row in ``videos`` has no label; the confidence of a video is the share of its words in the
    main language, that of a segment the share of bytes saved. Extra columns are ignored.
    """
    block = F.expr(f"CAST(FLOOR(seg_idx / {BLOCK}) AS INT)").alias("block")
    least = F.array_min("sizes")
    best = F.when(least < NEVER, F.array_position(F.col("sizes"), least.cast("smallint")).cast("int") - 1).otherwise(-1)
    runner_up = F.array_sort("sizes")[1] - least
    rows = segment_sizes(segments, videos, speakers).select("*", block)
    once = rows.groupBy("video_id", "block", "seg_idx").agg(F.first("words").alias("words"), F.first("sizes").alias("sizes")).withColumn("best", best)
    sure = F.when(runner_up >= 1, F.col("words"))
    by_block = once.groupBy("video_id", "block").agg(
        F.collect_list(F.struct("seg_idx", "sizes", "best")).alias("segs"), F.sum("words").alias("words"),
        *(F.coalesce(F.sum(F.when(F.col("best") == i, sure)), F.lit(0)).alias(f"n{i}") for i in range(len(LANGUAGES))),
    )
    by_block = settled(by_block)  # both the main language and the segments come from it
    n = [F.col(f"n{i}") for i in range(len(LANGUAGES))]
    codes = F.array(*(F.lit(x) for x in LANGUAGES))
    named = lambda i: F.coalesce(F.when(i >= 0, F.get(codes, i)), F.lit(UNKNOWN))
    total = sum(n[1:], n[0])
    most = F.greatest(*n)
    main = by_block.groupBy("video_id").agg(F.sum("words").alias("words"), *(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(LANGUAGES)))).select(
        "video_id", F.when(total > 0, (F.array_position(F.array(*n), most) - 1).cast("int")).otherwise(-1).alias("main"), F.round(F.when(total > 0, most / total).otherwise(0.0), 4).alias("confidence")
    )
    labels = videos.where("video_id IS NOT NULL").groupBy("video_id").agg(F.min(language_code(F.col("language"))).alias("label"))
    of_video = main.join(labels, "video_id", "left").select("video_id", F.lit(-1).cast("bigint").alias("seg_idx"), named(F.col("main")).alias("lang"), "confidence", "label")
    own_size = F.coalesce(F.when(F.col("main") >= 0, F.get(F.col("s.sizes"), F.col("main"))), F.lit(NEVER))
    saved = own_size - F.array_min("s.sizes")
    clear = saved >= F.greatest(F.lit(MARGIN_BYTES), F.ceil(own_size * MARGIN_SHARE))
    of_segment = (
        by_block.select("video_id", "segs").join(main.select("video_id", "main"), "video_id")
        .select("video_id", "main", F.explode("segs").alias("s"))
        .where((F.col("s.best") != F.col("main")) | (F.col("s.best") < 0))
        .select("video_id", "s.seg_idx", named(F.when(clear, F.col("s.best")).otherwise(-1)).alias("lang"), F.round(saved / own_size, 4).alias("confidence"), F.lit(None).cast("string").alias("label"))
    )
    return of_video.unionByName(of_segment)


def wrong_labels(found: DataFrame) -> DataFrame:
    """(video_id, seg_idx, lang) of the videos whose label names none or another language than the main
    one, and of the segments in another language than their video's, where the language is certain."""
    wrong = (F.col("seg_idx") >= 0) | F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return found.where(wrong & (F.col("lang") != UNKNOWN)).select("video_id", "seg_idx", "lang")

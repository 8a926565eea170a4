"""Speaker turns from raw captions.

A parsing-expression grammar (ordered choice, recursive nesting of annotations) splits the text of a
segment into labels, change marks, times, sounds and words. The grammar knows no names: what may be one
(before a colon, in brackets) is a candidate, which a join with the speakers of the channel settles, so
speakers of any number give the same turns. The parse tree becomes *parts*: stretches of a segment under
one label. Parts are put in order within blocks of ``BLOCK`` segments; only three rows per block travel on
to the step that joins the blocks of a video, so a video of any length never has to fit one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captide.sources.shared import settled

#: Segments of one video that one window sees.
BLOCK = 1024
FILLERS = frozenset(
    "э э-э ээ эм ну короче uh um uhm erm hm hum euh heu euuh äh ähm öh eh eeh em mmm е-е еее ем".split()
)

SPEAKER_WORDS = "speaker|спикер|спікер|locuteur|sprecher|hablante"


class Node(NamedTuple):
    """A node of the parse tree: what it is, the text it stands for, and what a ``maybe``, which is a label
    if it names somebody of the channel, says if it doesn't."""

    kind: str
    text: str
    said: str = ""


class Part(NamedTuple):
    """A stretch of a segment: its label if no candidate is a name (none: it goes on), the candidates of two
    words and one, the words it has then besides ``words``. A ``lead`` is the word before a candidate, which
    is part of the name if the candidate of two words is one, and else speech that goes on."""

    label: str | None
    two: str | None
    one: str | None
    lead: bool
    said: str
    words: str


# -- the grammar -------------------------------------------------------------------------------
# segment    <- item* EOF
# item       <- voice / tag / time / starred / music / mark / annotation / label / maybe / word / any
# voice      <- '<v' name '>'
# tag        <- '<' (!'>' .)* '>'            a time inside it makes it a time
# annotation <- open (annotation / !close .)* close      with open/close '[' ']' or '(' ')'
# label      <- numbered (':' / ' - ')
# maybe      <- (duty '(' name ')' / word word / word) ' '? ':'  /  an annotation of up to three words
#               a label if it is a name of the channel's speakers, else speech, or nothing if in brackets
# mark       <- '>>>' / '>>' / '»' / dash at the start of speech
# word       <- letters and digits with inner hyphens and apostrophes

_TIME = re.compile(r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?(?![\w:])")
_TAG = re.compile(r"<[^<>]*>")
_NUMBERED = re.compile(rf"(?:(?:{SPEAKER_WORDS})[ _]?(?:#|№)?0*(\d+)|[SСLH]0*(\d+))(?!\w)", re.I)
_NUMBERED_FIRST = frozenset("sSсСlLhH")  # the first letters of these
_COLON = re.compile(r"\s?:(?=\s|$)")
_DASHED = re.compile(r"\s+[-—–](?=\s|$)")
_MARK = re.compile(r"(?:>>>?|»)(?=\s|$|[\w<\[(])")
_DASH = re.compile(r"[-—–]+(?=\s)")
_STARRED = re.compile(r"\*[^*]*\*")
_MUSIC = re.compile(r"[♪♫#]+(?:\s*[♪♫]+)*")
_WORD = re.compile(r"[^\W_]+(?:[-'’ʼ_][^\W_]+)*")
_DUTY = re.compile(r"([^\W\d_]+(?:-[^\W\d_]+)?)\s*\(([^()]*)\)\s?:(?=\s|$)")
_ENTITY = re.compile(r"&nbsp;|&#160;", re.I)
_SPACE = re.compile(r"\s+")
_SPECIAL = re.compile(r"[:<>\[\]()*♪♫»&#@/—–_]|(?:^|\s)-+\s")
_CLOSE = {"[": "]", "(": ")"}


class Grammar:
    """Parses one segment."""

    def parse(self, text: str) -> list[Node]:
        text = _SPACE.sub(" ", _ENTITY.sub(" ", text)).strip()
        self.colon, self.bracket = ":" in text, "(" in text
        self.closes: dict[int, int] | None = None
        out: list[Node] = []
        at, end = 0, len(text)
        while at < end:
            at = self._item(text, at, out)
        return out

    def _item(self, text: str, at: int, out: list[Node]) -> int:
        c = text[at]
        if c == " ":
            return at + 1
        if c.isalnum():
            return self._speech(text, at, out)
        if c == "<" and (m := _TAG.match(text, at)):
            inner = m[0][1:-1]
            if inner[:2].lower() == "v " or inner[:2].lower() == "v.":
                out.append(Node("voice", self._form(inner[2:].split("@")[0])))
            elif _TIME.search(inner):
                out.append(Node("time", inner))
            return m.end()
        if c in _CLOSE:
            return self._annotation(text, at, out)
        if c == "*" and (m := _STARRED.match(text, at)):
            out.append(Node("sound", m[0]))
            return m.end()
        if m := _MARK.match(text, at):
            out.append(Node("mark", ""))
            return m.end()
        if m := _MUSIC.match(text, at):
            out.append(Node("sound", m[0]))
            return m.end()
        if c in "-—–" and (m := _DASH.match(text, at)):
            if not out or out[-1].kind in ("time", "sound"):
                out.append(Node("mark", ""))
            return m.end()
        return at + 1

    def _speech(self, text: str, at: int, out: list[Node]) -> int:
        """A time, a label or a word."""
        c = text[at]
        if c.isdigit() and (m := _TIME.match(text, at)):
            out.append(Node("time", m[0]))
            return m.end()
        if c in _NUMBERED_FIRST and (m := _NUMBERED.match(text, at)) and (n := _COLON.match(text, m.end()) or _DASHED.match(text, m.end())):
            out.append(Node("label", f"n:{int(m[1] or m[2])}"))
            return n.end()
        m = _WORD.match(text, at)
        stop = m.end()
        if self.colon:
            if self.bracket and (n := _DUTY.match(text, at)):
                out.append(Node("maybe", self._form(n[2]), n[1]))
                return n.end()
            dot = stop < len(text) and text[stop] == "." and stop - at == 1
            if n := _COLON.match(text, stop + dot):
                out.append(Node("named", text[at : stop + dot]))
                return n.end()
            if dot:
                out.append(Node("word", text[at : stop + 1]))
                return stop + 1
        out.append(Node("word", m[0]))
        return stop

    @staticmethod
    def _closes(text: str) -> dict[int, int]:
        """Where each bracket that is closed is closed, found in one pass."""
        out, open_ = {}, []
        for i, c in enumerate(text):
            if c in _CLOSE:
                open_.append(i)
            elif open_ and c == _CLOSE[text[open_[-1]]]:
                out[open_.pop()] = i
        return out

    def _annotation(self, text: str, at: int, out: list[Node]) -> int:
        """A bracketed annotation of any length; what nested annotations hold is left out of its body."""
        if self.closes is None:
            self.closes = self._closes(text)
        if (end := self.closes.get(at)) is None:
            return at + 1  # never closed: no annotation
        inner, i = [], at + 1
        while i < end:
            if (nested := self.closes.get(i)) is not None:
                i = nested
            else:
                inner.append(text[i])
            i += 1
        body, after = "".join(inner).strip(), end + 1
        if colon := _COLON.match(text, after):
            after = colon.end()
        if _TIME.fullmatch(body):
            out.append(Node("time", body))
        elif m := _NUMBERED.fullmatch(body):
            out.append(Node("label", f"n:{int(m[1] or m[2])}"))
        elif colon and body:
            out.append(Node("voice", self._form(body)))
        elif 1 <= len(names := body.split()) <= 3:
            out.append(Node("maybe", self._form(body if len(names) < 3 else f"{names[0]} {names[2]}")))
        else:
            out.append(Node("sound", body))
        return after

    @staticmethod
    def _form(name: str) -> str:
        return "f:" + " ".join(name.casefold().replace(".", " ").split())


def parts_of(grammar: Grammar, text: str | None) -> list[Part]:
    """Parts of one segment, with clean words joined by blanks. The first part has no label if the segment
    doesn't begin with one. ``m:`` is a change mark without a name. A capitalised word before a colon where
    the segment's speech begins is a label even if it names nobody known."""
    if not text or text.isspace():
        return []
    if not _SPECIAL.search(text):
        words = _plain_words(text)
        return [Part(None, None, None, False, "", words)] if words else []
    parts: list[tuple[Part, list[str]]] = [(Part(None, None, None, False, "", ""), [])]
    spoken = 0

    def begin(label: str | None, two: str | None = None, one: str | None = None, said: str = "") -> None:
        # a mark has this name, if it is one
        if parts[-1][0].label == "m:" and not parts[-1][1] and not parts[-1][0].said and label != "m:":
            parts.pop()
            label = label or "m:"
        parts.append((Part(label, two, one, False, said, ""), []))

    for node in grammar.parse(text):
        if node.kind == "word":
            if node.text.casefold() not in FILLERS:
                parts[-1][1].append(node.text)
                spoken += 1
        elif node.kind == "label":
            begin(node.text)
        elif node.kind == "voice":
            begin(node.text, None, node.text)
        elif node.kind == "maybe":
            begin(None, None, node.text, node.said)
            spoken += bool(node.said)
        elif node.kind == "named":
            one, two = grammar._form(node.text), None
            if parts[-1][1]:
                before = parts[-1][1].pop()
                two = grammar._form(f"{before} {node.text}")
                parts.append((Part(None, two, None, True, before, ""), []))
            unknown = not spoken and node.text[:1].isupper()
            said = "" if unknown or node.text.casefold() in FILLERS else node.text
            begin(one if unknown else None, two, one, said)
            spoken += 1
        elif node.kind == "mark":
            begin("m:")
    return [part._replace(words=" ".join(words)) for part, words in parts if part.label or part.two or part.one or part.said or words]


def _plain_words(text: str) -> str:
    return " ".join([w for w in _WORD.findall(text) if w.casefold() not in FILLERS])


def speech_of(grammar: Grammar, text: str | None) -> str:
    """The clean words of a segment apart from all that may be a name."""
    if text and not _SPECIAL.search(text):
        return _plain_words(text)
    return " ".join(p.words for p in parts_of(grammar, text) if p.words)


def _forms(name: str) -> Iterator[str]:
    """Every way a name may stand in a label, in the grammar's normal form."""
    words = (name or "").casefold().split()
    if not words:
        return
    first, last = words[0], words[-1]

    def slips(w: str) -> set[str]:
        return {w} | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}

    for f in slips(first):
        yield f
        yield f"{f} {last}"
    for x in slips(last):
        yield x
        yield f"{first} {x}"
    yield f"{first} {last[0]}"
    yield f"{first[0]} {last}"


def speaker_forms(speakers: DataFrame) -> DataFrame:
    """(channel_id, form, speaker): each label form that stands for exactly one person of the channel;
    a form shared by several persons goes to the one whose unaltered name or duty it is."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ch, sid, name, duty in b.itertuples(index=False):
                if ch is None or sid is None:
                    continue
                own = (name or "").casefold().split()
                plain = {" ".join(own), *own[:1], *own[-1:]}
                for form in set(_forms(name or "")) | ({duty.casefold()} if duty else set()):
                    rank = 0 if form in plain else 1 if duty and form == duty.casefold() else 2
                    rows.append((ch, "f:" + form, f"p:{sid}", rank))
            yield pd.DataFrame(rows, columns=["channel_id", "form", "speaker", "rank"])

    every = speakers.select("channel_id", "speaker_id", "display_name", "duty").mapInPandas(
        expand, "channel_id string, form string, speaker string, rank int"
    )
    return every.groupBy("channel_id", "form").agg(F.min_by("speaker", F.struct("rank", "speaker")).alias("speaker"))


def parsed(segments: DataFrame, videos: DataFrame, speakers: DataFrame, texts: bool = True) -> tuple[DataFrame, DataFrame]:
    """The parts (video_id, block, seg_idx, part, label, words, start_ms, end_ms), once each, and the blocks
    of each video. start_ms and end_ms are -1 where a segment's times are null or impossible. Without
    ``texts`` a sign stands for the words of a part, if it has any.

    Rows with a null video_id or seg_idx, and blank or null texts, give nothing; repeated rows count
    once. Extra columns of the inputs are ignored. Labels in segments with null or impossible times still
    hold for what follows.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar, plain = Grammar(), (None, None, None, False, "", "+")
        for b in batches:
            ids, seg, start, end = b["video_id"].to_numpy(), b["seg_idx"].to_numpy(), b["start_ms"].to_numpy(), b["end_ms"].to_numpy()
            pick, number, rows = [], [], []
            for i, text in enumerate(b["text"].tolist()):
                if not texts and not _SPECIAL.search(text):  # only whether it has a word
                    if any(m[0].casefold() not in FILLERS for m in _WORD.finditer(text)):
                        pick.append(i)
                        number.append(0)
                        rows.append(plain)
                    continue
                for k, (label, two, one, lead, said, words) in enumerate(parts_of(grammar, text)):
                    pick.append(i)
                    number.append(k)
                    label = f"m:{seg[i]}:{k}" if label == "m:" else label
                    rows.append((label, two, one, lead, said, words) if texts else (label, two, one, lead, said and "+", words and "+"))
            columns = dict(zip(Part._fields, zip(*rows))) if rows else {c: [] for c in Part._fields}
            yield pd.DataFrame({"video_id": ids[pick], "seg_idx": seg[pick], "part": number, **columns, "start_ms": start[pick], "end_ms": end[pick]})

    valid = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull() & (F.col("end_ms") >= F.col("start_ms"))
    own = segments.where("video_id IS NOT NULL AND seg_idx IS NOT NULL")
    block = F.expr(f"CAST(FLOOR(seg_idx / {BLOCK}) AS INT)").alias("block")
    parts = settled(  # the candidates and the parts come from it
        own.select("video_id", F.col("seg_idx").cast("int"), "text", F.when(valid, F.col("start_ms")).otherwise(-1).alias("start_ms"), F.when(valid, F.col("end_ms")).otherwise(-1).alias("end_ms"))
        .where("text IS NOT NULL")
        .mapInPandas(parse, "video_id string, seg_idx int, part int, label string, two string, one string, lead boolean, said string, words string, start_ms long, end_ms long")
        .select("*", block)
    )
    channel = videos.where("video_id IS NOT NULL").groupBy("video_id").agg(F.min("channel_id").alias("channel_id"))
    blocks = own.select("video_id", block).distinct()
    # what the candidates of a block of segments stand for in the video's channel
    maybe = parts.where("two IS NOT NULL OR one IS NOT NULL").select("video_id", "block", F.explode(F.array("two", "one")).alias("form")).where("form IS NOT NULL").distinct()
    named = maybe.join(channel, "video_id").join(speaker_forms(speakers), ["channel_id", "form"])
    names = named.groupBy("video_id", "block").agg(F.map_from_entries(F.collect_list(F.struct("form", "speaker"))).alias("names"))
    columns = [c for c in parts.columns if c not in ("video_id", "block", "seg_idx", "part")]
    once = parts.repartition("video_id", "block").groupBy("video_id", "block", "seg_idx", "part").agg(*(F.first(c).alias(c) for c in columns))
    two, one = (F.when(F.col(c).isNotNull(), F.try_element_at("names", F.col(c))) for c in ("two", "one"))
    hit = F.coalesce(two, one)
    rows = once.join(names, ["video_id", "block"], "left").select(
        "video_id", "block", "seg_idx", "part", F.when(~F.col("lead"), F.coalesce(hit, "label")).alias("label"),
        F.when(hit.isNull(), F.trim(F.concat_ws(" ", "said", "words"))).otherwise(F.col("words")).alias("words"), "start_ms", "end_ms",
    )
    return rows.where("label IS NOT NULL OR words != ''"), blocks


def utterances(segments: DataFrame, videos: DataFrame, speakers: DataFrame) -> DataFrame:
    """(video_id, seg_idx, part, speaker, words, start_ms, end_ms): the clean words of each part of a
    segment, without labels, times, sounds and filler, in order of seg_idx and part. A part whose
    speaker was named in an earlier segment has the label that held then. Times may be null."""
    rows, blocks = parsed(segments, videos, speakers)
    w = Window.partitionBy("video_id", "block").orderBy("seg_idx", "part")
    states = rows.where("label IS NOT NULL").groupBy("video_id", "block").agg(F.max_by("label", F.struct("seg_idx", "part")).alias("state"))
    by_block = Window.partitionBy("video_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select("video_id", "block").join(states, ["video_id", "block"], "left").select("video_id", "block", F.last("state", True).over(by_block).alias("carry"))
    time = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    return (
        rows.withColumn("who", F.last("label", True).over(w))
        .join(carry, ["video_id", "block"], "left")
        .where("words != ''")
        .select("video_id", "seg_idx", "part", F.coalesce("who", "carry", F.lit("")).alias("speaker"), "words", time("start_ms"), time("end_ms"))
    )


def speaker_turns(segments: DataFrame, videos: DataFrame, speakers: DataFrame) -> DataFrame:
    """(video_id, speaker, start_ms, end_ms): a row per longest run of one speaker in a video.

    ``speaker`` is ``p:`` and an id of ``speakers``, ``n:`` and a number, ``f:`` and an unknown name,
    ``m:`` for a mark of change without a name, or empty for speech before any label. Segments without
    a spoken word or with null or impossible times neither start, end nor belong to a turn; an empty
    table gives no row. See ``parsed`` for nulls and repeated rows.
    """
    rows, _ = parsed(segments, videos, speakers, texts=False)
    rows = rows.withColumn("spoken", (F.col("words") != "") & (F.col("start_ms") >= 0)).drop("words").where("spoken OR label IS NOT NULL")
    at = F.struct("seg_idx", "part")
    w = Window.partitionBy("video_id", "block").orderBy("seg_idx", "part")
    # runs inside a block; a null speaker is that of the blocks before; run 0 has labels without speech
    before = F.last(F.when(F.col("spoken"), F.struct("who")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        rows.withColumn("who", F.last("label", True).over(w))
        .withColumn("before", before)
        .withColumn("new", F.col("spoken") & (F.col("before").isNull() | ~F.col("before.who").eqNullSafe(F.col("who"))))
        .withColumn("run", F.sum(F.col("new").cast("int")).over(w))
        .groupBy("video_id", "block", "run")
        .agg(
            F.min_by("who", F.when(F.col("spoken"), at)).alias("who"),
            F.min_by("start_ms", F.when(F.col("spoken"), at)).alias("start_ms"),
            F.max(F.when(F.col("spoken"), F.col("end_ms"))).alias("end_ms"),
            F.max_by("label", F.when(F.col("label").isNotNull(), at)).alias("state"),
        )
    )
    runs = settled(runs.withColumn("n", F.max("run").over(Window.partitionBy("video_id", "block"))))
    inner = runs.where("run > 2 AND run < n").select("video_id", "who", "start_ms", "end_ms")
    # at most three runs per block, the first two and the last; and the label that holds at its end
    edge = F.when(F.expr("run > 0 AND (run <= 2 OR run = n)"), F.struct("run", "who", "start_ms", "end_ms"))
    edges = runs.groupBy("video_id", "block").agg(
        F.array_sort(F.collect_list(edge)).alias("runs"), F.max_by("state", F.when(F.col("state").isNotNull(), F.col("run"))).alias("state")
    )
    by_block = Window.partitionBy("video_id").orderBy("block")
    edges = (
        edges.withColumn("carry", F.last("state", True).over(by_block.rowsBetween(Window.unboundedPreceding, -1)))
        .select("video_id", "block", "carry", F.explode("runs").alias("r"))
        .select("video_id", "block", "r.run", F.coalesce("r.who", "carry", F.lit("")).alias("who"), "r.start_ms", "r.end_ms")
    )
    by_run = Window.partitionBy("video_id").orderBy("block", "run")
    before = F.lag(F.struct("who", "block", "run")).over(by_run)
    joined = (
        edges.withColumn("before", before)
        .withColumn("new", F.col("before").isNull() | (F.col("before.who") != F.col("who")) | ((F.col("before.block") == F.col("block")) & (F.col("run") > 2)))
        .withColumn("island", F.sum(F.col("new").cast("int")).over(by_run))
        .groupBy("video_id", "island")
        .agg(F.first("who").alias("who"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
        .drop("island")
    )
    return inner.unionByName(joined).withColumnRenamed("who", "speaker").select("video_id", "speaker", "start_ms", "end_ms")

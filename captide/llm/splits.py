"""Records of one split that stand, the same or nearly so, in another.

Two texts that at most EDITS word edits make equal share one of EDITS + 1 even parts of the first, moved by
as many words as the second is longer or shorter before it. So the parts are the bands here: a band's bucket
is made of minwise hashes of the part's shingles (pairs of neighbouring words). One side is put into the
buckets of its own parts, the other looks up each place where a part may stand in its texts. That finds every
pair, of texts of any length and whatever their words; with bands over the whole text, two altered words of
eleven leave a pair of texts hardly more alike than two texts of one template.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captide.llm.words import words
from captide.sources.shared import settled

#: Words altered, added or dropped (two neighbours exchanged are two words altered).
EDITS = 2
#: Minwise hashes that make up a band's bucket.
ROWS = 3
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _normal_form(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join(words(t)) or None)


def edits(a: list[str], b: list[str], most: int) -> int:
    """Words altered, added or dropped between a and b, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _verify(most: int):
    """The exact Jaccard similarity of the words of two texts, and their edits if it is high enough for
    ``most``: of the longer text at most so many words are not in the other."""

    def verify(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b):
            x, y = x.split(" "), y.split(" ")
            cx, cy = Counter(x), Counter(y)
            both = sum((cx & cy).values())
            jaccard = both / (len(x) + len(y) - both)
            long, short = max(len(x), len(y)), min(len(x), len(y))
            enough = jaccard >= (long - most) / (short + most) - 1e-9
            out.append((jaccard, edits(x, y, most) if enough else most + 1))
        return pd.DataFrame(out, columns=["jaccard", "edits"])

    return F.pandas_udf(verify, "struct<jaccard double, edits int>")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def places(n: int, m: int, most: int) -> range:
    """How far a part of a text of m words may have moved in one of n words: by the words added less those
    dropped before it, and at most ``most`` are added, dropped or altered."""
    d = n - m
    spare = (most - abs(d)) // 2  # pairs of one added and one dropped
    return range(min(0, d) - spare, max(0, d) + spare + 1)


def band_hashes(forms: list[str], most: int = EDITS) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Of each text its word signature, the buckets of its own parts, and those of every stretch that may be
    a part of a text at most ``most`` edits away. Of a signature an edit changes two bits at most."""
    known: dict[str, int] = {}

    def code(w: str) -> int:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
        return known[w]

    split = [f.split(" ") for f in forms]
    own: list = [None] * len(forms)
    probe: list = [None] * len(forms)
    sign = np.zeros(len(forms), np.uint64)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(split):
        by_length.setdefault(len(w), []).append(i)
    k = most + 1
    for n, rows in by_length.items():
        h = np.array([[code(w) for w in split[i]] for i in rows], np.uint64)
        sign[rows] = np.bitwise_or.reduce(np.uint64(1) << (h >> np.uint64(58)), axis=1)
        # a part of one word has that word for its only shingle
        pairs = _mixed(h[:, :-1] * _ODD[0] + h[:, 1:] * _ODD[1])
        hashes = {size: [_mixed(x * odd) for odd in _ODD[:ROWS]] for size, x in ((1, h), (2, pairs))}

        def bucket(m: int, part: int, begin: int, length: int, rows: int = len(rows), hashes: dict = hashes) -> np.ndarray:
            out = np.full(rows, m * 1009 + part, np.uint64)
            size = min(length, 2)
            for j in range(ROWS if length else 0):
                out = _mixed(out * _ODD[j] + hashes[size][j][:, begin : begin + length - size + 1].min(axis=1))
            return out.view(np.int64)

        def bounds(m: int, part: int) -> tuple[int, int]:
            return part * m // k, (part + 1) * m // k - part * m // k

        mine = np.stack([bucket(n, part, *bounds(n, part)) for part in range(k)], axis=1)
        looked = []
        for m in range(max(1, n - most), n + most + 1):
            for part in range(k):
                begin, length = bounds(m, part)
                looked += [bucket(m, part, begin + s, length) for s in places(n, m, most) if 0 <= begin + s and begin + s + length <= n]
        looked = np.stack(looked, axis=1)
        for i, a, b in zip(rows, mine, looked):
            own[i], probe[i] = a, np.unique(b)
    return sign.view(np.int64).tolist(), own, probe


def _bands(most: int):
    def run(forms: pd.Series) -> pd.DataFrame:
        sign, own, probe = band_hashes(forms.tolist(), most)
        return pd.DataFrame({"sign": sign, "own": own, "probe": probe})

    return F.pandas_udf(run, "struct<sign bigint, own array<bigint>, probe array<bigint>>")


def text_classes(records: DataFrame, id_col: str, split_col: str, text_col: str, train: str, evaluation: str) -> DataFrame:
    """(id, split, source columns..., key, form): the records of both splits that have words, once each;
    records with equal ``key`` have the same words in order. Split names are compared without case and
    outer blanks. It is settled, since classes and members come from it."""
    split = F.lower(F.regexp_replace(F.col(split_col), r"(?U)^\s+|\s+$", ""))
    return settled(
        records.select(F.col(id_col).alias("id"), split.alias("split"), F.col(text_col).alias("text"), *(["source"] if "source" in records.columns else []))
        .where(F.col("split").isin(train, evaluation) & F.col("text").isNotNull() & F.col("id").isNotNull())
        .withColumn("form", F.pandas_udf(_normal_form, "string")("text"))
        .where("form IS NOT NULL")
        .drop("text")
        .distinct()
        .withColumn("key", F.unhex(F.md5("form")))
    )


def class_pairs(classes: DataFrame, most: int = EDITS) -> DataFrame:
    """(key_t, key_e, jaccard, edits): different texts of the two sides with at most ``most`` word edits, all
    of them.

    ``classes`` has (key, form, in_train, in_eval). The training side lies in the buckets of its parts, the
    other looks up. A bucket that very many texts share emits no pair whose word signatures tell that they
    differ by more; its rows are spread by the skew handling of sort-merge joins. What is left is held to
    exact Jaccard similarity and then to the edits, on the whole texts.
    """
    banded = settled(classes.withColumn("b", _bands(most)("form")).select("key", "form", "in_train", "in_eval", "b.*"))
    t = banded.where("in_train").select(F.col("key").alias("key_t"), F.col("sign").alias("sign_t"), F.explode("own").alias("bucket"))
    e = banded.where("in_eval").select(F.col("key").alias("key_e"), F.col("sign").alias("sign_e"), F.explode("probe").alias("bucket"))
    near = (F.bit_count(F.col("sign_t").bitwiseXOR(F.col("sign_e"))) <= 2 * most) & (F.col("key_t") != F.col("key_e"))
    candidates = t.join(e, "bucket").where(near).select("key_t", "key_e").distinct()
    form = banded.select("key", "form")
    return (
        candidates.join(form.toDF("key_t", "form_t"), "key_t")
        .join(form.toDF("key_e", "form_e"), "key_e")
        .withColumn("v", _verify(most)("form_t", "form_e"))
        .where(F.col("v.edits") <= most)
        .select("key_t", "key_e", "v.jaccard", "v.edits")
    )


def _both(records: DataFrame, train: str, evaluation: str) -> tuple[DataFrame, DataFrame]:
    classes = records.groupBy("key").agg(F.first("form").alias("form"), F.max(F.col("split") == train).alias("in_train"), F.max(F.col("split") == evaluation).alias("in_eval"))
    pairs = class_pairs(classes).select("key_t", "key_e")
    same = classes.where("in_train AND in_eval").select(F.col("key").alias("key_t"), F.col("key").alias("key_e"))
    return classes, pairs.unionByName(same)


def cross_split_pairs(df: DataFrame, id_col: str = "id", split_col: str = "split", text_col: str = "anchor", train: str = "tuning", evaluation: str = "holdout") -> DataFrame:
    """(id_a, id_b), id_a < id_b: a record of each split whose texts have the same words in order apart
    from case, punctuation, spacing, encoding, look-alike letters and at most EDITS word edits.

    Null ids, texts and splits, other splits and texts without words make no pair; repeated rows count
    once; an empty table gives no rows; other columns are ignored. Texts of any length are compared whole.
    """
    records = text_classes(df, id_col, split_col, text_col, train, evaluation)
    _, pairs = _both(records, train, evaluation)
    t = records.where(F.col("split") == train).select(F.col("id").alias("t"), F.col("key").alias("key_t")).distinct()
    e = records.where(F.col("split") == evaluation).select(F.col("id").alias("e"), F.col("key").alias("key_e")).distinct()
    return (
        pairs.join(t, "key_t").join(e, "key_e").where("t != e")
        .select(F.least("t", "e").alias("id_a"), F.greatest("t", "e").alias("id_b"))
        .distinct()
    )


def overlap_report(df: DataFrame, source_col: str = "source_video", id_col: str = "id", split_col: str = "split", text_col: str = "anchor", train: str = "tuning", evaluation: str = "holdout") -> DataFrame:
    """(split, source, cases, overlapping): per split and source, how many records there are and how many
    have a partner in the other split. Partners are counted by class, never paired out."""
    kept = df.select(F.col(id_col).alias("id"), F.col(split_col).alias("split"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    records = text_classes(kept, "id", "split", "text", train, evaluation)
    _, pairs = _both(records, train, evaluation)
    hit = pairs.select(F.col("key_t").alias("key"), F.lit(train).alias("split")).unionByName(pairs.select(F.col("key_e").alias("key"), F.lit(evaluation).alias("split"))).distinct()
    return (
        records.join(hit.withColumn("hit", F.lit(1)), ["key", "split"], "left")
        .groupBy("split", "source", "id").agg(F.max("hit").alias("hit"))
        .groupBy("split", "source")
        .agg(F.count("*").alias("cases"), F.count("hit").alias("overlapping"))
    )

"""Which segments of its video hold an anchor's words.

A video's segments lie in blocks; each anchor visits the blocks of its video and leaves in each what may be
the best of all, so pairs of an anchor and a segment that share a word are never written out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from captide.functions import text
from captide.operators.blocks import block_of, with_margins

WIDTH = 65_536
REACH = 6
_OUT = 20_000


class _Block:
    """The segments of a block, and in which of them each word is."""

    def __init__(self) -> None:
        self.code: dict[str, int] = {}
        self.codes: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.rows: np.ndarray | None = None

    def coded(self, words: pa.Array) -> np.ndarray:
        d = words.dictionary_encode()
        known = np.array([self.code.setdefault(w, len(self.code)) for w in d.dictionary.to_pylist()], np.int64)
        return known[d.indices.to_numpy()] if len(known) else known

    def settle(self) -> None:
        codes, sizes = np.concatenate(self.codes), np.concatenate(self.sizes)
        self.seg_idx, self.codes, self.sizes, self.at = np.concatenate(self.at), [], [], []
        self.begin = np.append(0, np.cumsum(np.bincount(codes, minlength=len(self.code))))
        self.rows = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(codes, kind="stable")]

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments (from 0 on, ascending for each word) that hold the words, and which word it is."""
        which = np.flatnonzero(words < len(self.begin) - 1)
        lists = [self.rows[self.begin[w] : self.begin[w + 1]] for w in words[which]]
        return (np.concatenate(lists), np.repeat(which, [len(x) for x in lists])) if lists else (which, which)


def _visited(pairs: DataFrame, visit: Callable, schema: str) -> DataFrame:
    """What ``visit`` (block, row of the anchor, its words as places and strings) gives for each anchor and block.
    ``pairs``: rows by video and block, segments before anchors."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, out = None, _Block(), []
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            video, number, ids, seg_idx, words = (b.column(b.schema.get_field_index(c)) for c in ("video_id", "_b", "id", "seg_idx", "ws"))
            other = pc.or_(pc.not_equal(video.slice(1), video.slice(0, n - 1)), pc.not_equal(number.slice(1), number.slice(0, n - 1)))
            begins = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
            anchor = b.select(["id", "n", "several", "base", "more"])
            for lo, hi in zip(begins, begins[1:]):
                if (now := (video[lo].as_py(), number[lo].as_py())) != key:
                    key, block = now, _Block()
                own = ids.slice(lo, hi - lo).null_count  # segments, which have no id
                if own:
                    w = words.slice(lo, own)
                    block.codes.append(block.coded(w.flatten()))
                    block.sizes.append(pc.list_value_length(w).to_numpy())
                    block.at.append(seg_idx.slice(lo, own).to_numpy(zero_copy_only=False))
                if lo + own == hi:
                    continue
                if block.rows is None:
                    block.settle()
                w = words.slice(lo + own, hi - lo - own)
                codes = block.coded(w.flatten())
                ends = np.append(0, np.cumsum(pc.list_value_length(w).to_numpy()))
                for k, row in enumerate(anchor.slice(lo + own, hi - lo - own).to_pylist()):
                    rows, which = block.places(codes[ends[k] : ends[k + 1]])
                    if len(rows):
                        for x in visit(block, row, rows, which, w[k]):
                            out.append(x)
                            if len(out) == _OUT:
                                yield table(out)
                                out = []
        yield table(out)

    return pairs.mapInArrow(run, schema)


def _pairs(segments: DataFrame, anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Segments, once each, and behind them the anchors of their video, by block; texts travel once.

    ``segments``: rows as they stand in the table. ``blocks``: of each video, with ``base`` and ``more``."""
    w = anchors.select("id", "video_id", F.explode(F.array_distinct(text.words(F.col("anchor")))).alias("w"))
    own = w.groupBy("id", "video_id").agg(F.array_sort(F.collect_set("w")).alias("ws"))
    of = Window.partitionBy("id")
    own = own.select("id", "video_id", F.array_join("ws", " ").alias("text"), F.sum(F.size("ws")).over(of).alias("n"), (F.count("video_id").over(of) > 1).alias("several"))
    guests = own.join(blocks, "video_id").withColumn("seg_idx", F.lit(None).cast("int"))
    none = {"id": "string", "n": "bigint", "several": "boolean", "base": "bigint", "more": "boolean"}
    rows = segments.select("video_id", block_of("seg_idx", WIDTH).alias("_b"), "seg_idx", "text", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    keys = ["video_id", "_b", "id", "seg_idx"]
    once = rows.unionByName(guests).repartition("video_id", "_b").groupBy(*keys).agg(F.min("text").alias("text"), *(F.max(c).alias(c) for c in none if c != "id"))
    return once.sortWithinPartitions(*keys).withColumn("ws", F.array_distinct(text.words(F.col("text")))).drop("text")


def best_segment(segments: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, seg_idx, hits, n) of the segment of its video that holds most of an anchor's ``n`` words, the first of
    equal ones. Of an id with anchors in several videos, segments of one number count together."""

    def visit(block: _Block, anchor: dict, rows: np.ndarray, which: np.ndarray, words: pa.ListScalar) -> Iterator[tuple]:
        hits = np.bincount(rows)
        for r in np.flatnonzero(hits) if anchor["several"] else [hits.argmax()]:
            yield anchor["id"], int(block.seg_idx[r]), int(hits[r]), anchor["n"]

    blocks = segments.select("video_id", block_of("seg_idx", WIDTH).alias("_b")).distinct().withColumns({"base": F.lit(0).cast("bigint"), "more": F.lit(False)})
    found = _visited(_pairs(segments, anchors, blocks), visit, "id string, seg_idx int, hits long, n long")
    h = found.groupBy("id", "seg_idx").agg(F.sum("hits").alias("hits"), F.max("n").alias("n"))
    return h.groupBy("id").agg(F.max_by(F.struct("seg_idx", "hits", "n"), F.struct("hits", -F.col("seg_idx"))).alias("x")).select("id", "x.*")


def _stretch(rows: np.ndarray, which: np.ndarray, size: int, n: int, least: float) -> tuple[int, int] | None:
    """Of the stretches of one to REACH segments in a block that hold ``least`` of the ``n`` words the one with most,
    the shortest, then the first: where it begins and how long it is. ``rows`` as of ``_Block.places``."""
    count = np.bincount(rows, minlength=size + REACH)
    upto = np.append(0, np.cumsum(count))
    at_most = upto[REACH : REACH + size] - upto[:size]  # a word counts as often as it occurs
    p = np.flatnonzero((count[:size] > 0) & (at_most / n >= least))
    if not len(p):
        return None
    before = np.append(-REACH, rows[:-1])  # where the word was last
    before[1:][which[1:] != which[:-1]] = -REACH
    edge = np.zeros(size + REACH + 1, np.int64)
    edge[p] += 1
    edge[p + REACH] -= 1
    near = np.cumsum(edge)[rows] > 0
    r, before = rows[near], before[near]
    number = np.full(size, -1)
    number[p] = np.arange(len(p))
    hits = np.zeros((REACH, len(p)), np.int64)
    for d in range(REACH):  # words that come up for the first time d segments after the beginning
        begin = number[(r - d)[(r - d > before) & (r >= d)]]
        hits[d] = np.bincount(begin[begin >= 0], minlength=len(p))
    hits = np.cumsum(hits, axis=0)
    best = hits[-1].max()
    if best / n < least:
        return None
    k = int(np.argmax(hits.max(axis=1) == best))
    return int(p[np.argmax(hits[k] == best)]), k + 1


def best_stretch(segments: DataFrame, anchors: DataFrame, least: float) -> DataFrame:
    """(id, first, span, hits, n) of the stretch of one to REACH segments that holds most of an anchor's ``n`` words,
    the shortest, then the first one, if it holds ``least`` of them. ``first`` is a place among the segments of the
    video. Of an id with anchors in several videos, segments of one place count together."""

    def visit(block: _Block, anchor: dict, rows: np.ndarray, which: np.ndarray, words: pa.ListScalar) -> Iterator[tuple]:
        """The segments of the block's best stretch, and those that a stretch across the block's ends may hold."""
        size, keep = len(block.seg_idx), np.full(len(rows), anchor["several"])
        if not anchor["several"]:
            if found := _stretch(rows, which, size, anchor["n"], least):
                keep |= (rows >= found[0]) & (rows < sum(found))
            if anchor["base"]:
                keep |= rows < REACH - 1
            if anchor["more"]:
                keep |= rows > size - REACH
        if keep.any():
            said, held = words.as_py(), {}
            for r, w in zip(rows[keep].tolist(), which[keep].tolist()):
                held.setdefault(r, []).append(said[w])
            for r, ws in held.items():
                yield anchor["id"], anchor["base"] + r, ws, anchor["n"]

    order = Window.partitionBy("video_id").orderBy("_b")
    sizes = segments.select("video_id", block_of("seg_idx", WIDTH).alias("_b"), "seg_idx").distinct().groupBy("video_id", "_b").agg(F.count("*").alias("_n"))
    base = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.select("video_id", "_b", base.alias("base"), F.lead("_n").over(order).isNotNull().alias("more"))
    h = _visited(_pairs(segments, anchors, blocks), visit, "id string, pos long, ws array<string>, n long")
    near = Window.partitionBy("id", "_b").orderBy("pos").rangeBetween(0, REACH - 1)
    spans = with_margins(h, "pos", REACH).withColumn("l", F.collect_list(F.struct("pos", "ws")).over(near)).where("_own")
    hits = lambda k: F.size(F.array_distinct(F.flatten(F.transform(F.filter("l", lambda x: x["pos"] < F.col("pos") + k), lambda x: x["ws"]))))
    options = F.array(*(F.struct(hits(k).alias("hits"), F.lit(-k).alias("less"), (-F.col("pos")).alias("early")) for k in range(1, REACH + 1)))
    best = spans.groupBy("id").agg(F.max(F.array_max(options)).alias("x"), F.max("n").alias("n")).where(F.col("x.hits") / F.col("n") >= least)
    return best.select("id", (-F.col("x.early")).alias("first"), (-F.col("x.less")).alias("span"), "x.hits", "n")

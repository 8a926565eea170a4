"""Overlapping captions, chunks and batches: work that goes through the rows of a video in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from captide.operators.blocks import block_of


def edge_words(before: list[str], after: list[str]) -> int:
    """The most words that end ``before`` and begin ``after``, in one pass over both."""
    if not after:
        return 0
    border, k = [0] * len(after), 0  # of each beginning of ``after``, the longest other one that ends it
    for i in range(1, len(after)):
        while k and after[i] != after[k]:
            k = border[k - 1]
        k += after[i] == after[k]
        border[i] = k
    k = 0
    for w in before[-len(after) :]:
        while k and (k == len(after) or after[k] != w):
            k = border[k - 1]
        k += after[k] == w
    return k


def streamed(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str) -> DataFrame:
    """Rows of each group of ``keys`` in ``order`` through ``step``, a generator function of one group's rows
    (tuples of the columns): it yields output rows while the group goes by, so that no group has to fit in
    memory. Groups are spread by a shuffle on their keys and sorted where they arrive."""
    at = [df.columns.index(k) for k in keys]
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        for _, group in groupby(rows, lambda r: tuple(r[i] for i in at)):
            for x in step(group):
                out.append(x)
                if len(out) == 10_000:
                    yield table(out)
                    out = []
        yield table(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _strands(df: DataFrame, key: str, order: str, start: str, end: str, gap: int = 0) -> DataFrame:
    """Adds ``strand``: the start of the stretch of a key's rows that hang together, a row beginning a new
    one if it starts at or after every earlier end (plus ``gap``). Blocks of rows are tied by one row each."""
    b = df.withColumn("_b", block_of(start, 600_000))
    reach = b.groupBy(key, "_b").agg(F.max(end).alias("_m")).select(key, "_b", F.max("_m").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_r"))
    w = Window.partitionBy(key, "_b").orderBy(start, order)
    f = b.join(reach, [key, "_b"], "left").withColumn("_p", F.greatest("_r", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    f = f.withColumn("_s", F.max(F.when(F.col("_p").isNull() | (F.col(start) >= F.col("_p") + gap), F.col(start))).over(w))
    last = f.groupBy(key, "_b").agg(F.max("_s").alias("_h")).select(key, "_b", F.last("_h", True).over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_o"))
    return f.join(last, [key, "_b"], "left").withColumn("strand", F.coalesce("_s", "_o")).drop("_b", "_r", "_p", "_s", "_o")


def without_repeats(captions: DataFrame) -> DataFrame:
    """(video_id, seg_idx, text, start_ms, end_ms): captions in order of start, without the words that a
    caption says again because it overlaps the ones before, and without captions of which nothing is left.

    Captions that touch no earlier one make a new strand; strands are independent of each other, so
    a video is spread over tasks by its strands. Texts must be clean; input columns beside the five are
    dropped; an empty table gives no rows.
    """

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        recent: list[tuple[list[str], int]] = []  # kept captions that may still overlap
        reach = None  # where the one kept last ends
        for video, seg, text, start, end, _ in rows:
            words = text.split(" ")
            recent = [x for x in recent if x[1] > start]
            if reach is not None and start < reach:
                words = words[edge_words([w.lower() for t, _ in recent for w in t], [w.lower() for w in words]) :]
            if words:
                recent.append((words, end))
                reach = end
                yield video, seg, " ".join(words), start, end

    cols = captions.select("video_id", "seg_idx", "text", "start_ms", "end_ms")
    strands = _strands(cols, "video_id", "seg_idx", "start_ms", "end_ms").select(*cols.columns, "strand")
    return streamed(strands, ["video_id", "strand"], ["start_ms", "seg_idx"], step, "video_id string, seg_idx int, text string, start_ms bigint, end_ms bigint")


def chunks(captions: DataFrame, budget: int = 30_000, overlap_ms: int = 90_000) -> DataFrame:
    """(video_id, chunk, first, last, tokens): stretches of a video's captions of at most ``budget``
    estimated tokens (a line that alone exceeds it stands alone), each beginning with what ends within
    ``overlap_ms`` of the end of the one before. ``first`` and ``last`` are positions in the video.

    The captions stream by in order, only those of the open chunk are kept. Where a chunk ends depends
    on where it began, so one video is read by one task; its texts are not shuffled, only their sizes.
    """
    sizes = captions.select("video_id", "seg_idx", "end_ms", F.octet_length("text").alias("n"))
    ordered = sizes.repartition("video_id").sortWithinPartitions("video_id", "seg_idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, out, lines = None, [], []
        pos = chunk = used = 0

        def line(i: int, n: int) -> int:
            return max(1, -(-(n + len(str(i)) + 4) // 3))  # "[i] text" and a line break

        def close() -> None:
            size = sum(n + len(str(i)) + 4 for i, n, _ in lines) - 1
            out.append((video, chunk, lines[0][0], lines[-1][0], max(1, -(-size // 3))))

        def take(i: int, n: int, end: int) -> None:
            nonlocal lines, chunk, used
            while lines and (used >= budget or used + line(i, n) > budget):
                close()
                chunk += 1
                since = max(0, lines[-1][2] - overlap_ms)
                at = next((k for k in range(1, len(lines)) if lines[k][2] >= since), len(lines))
                lines = lines[at:]
                used = sum(line(x, y) for x, y, _ in lines)
            lines.append((i, n, end))
            used += line(i, n)

        for b in batches:
            for v, end, n in zip(b["video_id"], b["end_ms"], b["n"]):
                if v != video:
                    if lines:
                        close()
                    video, lines, pos, chunk, used = v, [], 0, 0, 0
                take(pos, int(n), int(end))
                pos += 1
            if out:
                yield pd.DataFrame(out, columns=["video_id", "chunk", "first", "last", "tokens"])
                out = []
        if lines:
            close()
        if out:
            yield pd.DataFrame(out, columns=["video_id", "chunk", "first", "last", "tokens"])

    return ordered.mapInPandas(run, "video_id string, chunk int, first int, last int, tokens bigint")


def batches(items: DataFrame, key: str, order: str, size: str, capacity: int, most: int) -> DataFrame:
    """(key, order, batch): next-fit packing inside each key, in order: a batch ends before the item that
    would exceed ``capacity`` or be item number ``most`` + 1. A key's items go by in constant memory; where
    a batch ends depends on where it began, so one key is read by one task."""

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        batch = used = n = 0
        for k, item, amount in rows:
            if n and (used + amount > capacity or n >= most):
                batch, used, n = batch + 1, 0, 0
            used, n = used + amount, n + 1
            yield k, item, batch

    kind = {c: items.schema[c].dataType.simpleString() for c in (key, order)}
    rows = items.select(key, order, F.col(size).cast("bigint").alias("_size"))
    return streamed(rows, [key], [order, "_size"], step, f"{key} {kind[key]}, {order} {kind[order]}, batch int")

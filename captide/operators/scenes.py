"""Greedy merging and choosing among overlapping scenes and events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captide.operators import rangejoin
from captide.operators.captions import _strands, streamed

#: Categories that count as one when scenes are compared.
COMPLEMENTARY = {"violence", "scary_and_disturbing"}


def _compatible(a: set, b: set) -> bool:
    return bool(a & b) or bool(a & COMPLEMENTARY and b & COMPLEMENTARY)


def merged_scenes(scenes: DataFrame, share: float = 0.4) -> DataFrame:
    """(scan_id, video_id, scene_id, start_ms, end_ms, scenes): scenes in order of start, each joined to
    the first earlier one that it overlaps by ``share`` of the shorter and shares a category with; the
    joined scene spans both and its id is theirs with a plus. Null or impossible bounds are left out,
    repeated rows count once.

    Scenes that overlap nothing earlier begin a new strand; a strand is merged by itself.
    """
    own = scenes.where("context_start_ms IS NOT NULL AND context_end_ms >= context_start_ms AND scan_id IS NOT NULL AND video_id IS NOT NULL AND scene_id IS NOT NULL")
    once = own.groupBy("scan_id", "video_id", "scene_id", "context_start_ms", "context_end_ms").agg(F.min("categories").alias("categories"))
    keyed = once.withColumn("k", F.struct("scan_id", "video_id"))
    strands = _strands(keyed, "k", "scene_id", "context_start_ms", "context_end_ms").select("scan_id", "video_id", "strand", "context_start_ms", "context_end_ms", "scene_id", "categories")

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        done: list[list] = []  # id, start, end, categories, number, of those that a later scene may still overlap
        for scan, video, _, s, e, sid, cats in rows:
            for m in done:
                if m[2] <= s:
                    yield scan, video, m[0], m[1], m[2], m[4]
            done = [m for m in done if m[2] > s]
            c = set(cats) if cats is not None else set()
            for m in done:
                both = max(0, min(m[2], e) - max(m[1], s))
                if _compatible(m[3], c) and both / min(max(1, m[2] - m[1]), max(1, e - s)) >= share:
                    m[0], m[1], m[2], m[4] = f"{m[0]}+{sid}", min(m[1], s), max(m[2], e), m[4] + 1
                    m[3] |= c
                    break
            else:
                done.append([sid, s, e, c, 1])
        for m in done:
            yield scan, video, m[0], m[1], m[2], m[4]

    return streamed(strands, ["scan_id", "video_id", "strand"], ["context_start_ms", "scene_id"], step, "scan_id string, video_id string, scene_id string, start_ms bigint, end_ms bigint, scenes int")


def greedy_unique(events: DataFrame, keys: list[str], id_col: str, pad: int = 2_000) -> DataFrame:
    """(*keys, id_col, start_ms, end_ms, confidence): events in order of start (then confidence, downwards),
    of which one that comes within ``pad`` of a kept one replaces it if its confidence is higher and
    else is dropped. Events farther from all earlier ones begin a new strand, which is done by itself and
    goes by in order: kept events that no later one can touch are given out."""
    keyed = events.select(*keys, id_col, "start_ms", "end_ms", "confidence").withColumn("_key", F.struct(*keys))
    strands = _strands(keyed, "_key", id_col, "start_ms", "end_ms", gap=pad + 1).drop("_key")
    rows = strands.select(*keys, "strand", "start_ms", (-F.col("confidence")).alias("_c"), id_col, "end_ms")
    k = len(keys)

    def step(group: Iterator[tuple]) -> Iterator[tuple]:
        kept: list[tuple] = []
        for x in group:
            start, end = x[k + 1], x[k + 4]
            yield from (out(y) for y in kept if y[k + 4] < start - pad)
            kept = [y for y in kept if y[k + 4] >= start - pad]
            hit = next((i for i, y in enumerate(kept) if y[k + 1] <= end + pad), None)
            if hit is None:
                kept.append(x)
            elif x[k + 2] < kept[hit][k + 2]:
                kept[hit] = x
        yield from map(out, kept)

    def out(y: tuple) -> tuple:
        return (*y[:k], y[k + 3], y[k + 1], y[k + 4], -y[k + 2])

    kind = {c: events.schema[c].dataType.simpleString() for c in (*keys, id_col)}
    schema = ", ".join(f"{c} {kind[c]}" for c in (*keys, id_col)) + ", start_ms bigint, end_ms bigint, confidence double"
    return streamed(rows, [*keys, "strand"], ["start_ms", "_c", id_col], step, schema)


def keep_first(rows: DataFrame, keys: list[str], id_col: str, pad: int = 2_000) -> DataFrame:
    """(*keys, id_col, start_ms, end_ms): rows in order of start (then id), without those that come within
    ``pad`` of one kept before under the same keys; nothing replaces a kept row. Rows with null or
    impossible times are left out. Null keys count as equal.

    Rows farther from all earlier ones begin a new strand; strands stream by in order, in constant memory:
    as starts only grow, the greatest end kept so far decides.
    """
    cols = [*keys, id_col, "start_ms", "end_ms"]
    keyed = rows.select(*cols).where("end_ms >= start_ms").withColumn("_key", F.to_json(F.struct(*keys)))
    strands = _strands(keyed, "_key", id_col, "start_ms", "end_ms", gap=pad + 1)
    ordered = strands.select(*cols, "_key", "strand").repartition("_key", "strand").sortWithinPartitions("_key", "strand", "start_ms", id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reach = None, 0
        for b in batches:
            keep = []
            for key, strand, start, end in zip(*(b.column(c).to_pylist() for c in ("_key", "strand", "start_ms", "end_ms"))):
                keep.append((key, strand) != last or start > reach + pad)
                if keep[-1]:
                    reach = end if (key, strand) != last else max(reach, end)
                    last = key, strand
            yield b.filter(pa.array(keep, pa.bool_())).select(cols)

    return ordered.mapInArrow(run, strands.select(*cols).schema)


def accepted(candidates: DataFrame, known: DataFrame, keys: list[str], id_col: str, pad: int = 2_000) -> DataFrame:
    """(*keys, id_col, start_ms, end_ms): the candidates, in order of start (then id), that come within
    ``pad`` of no row of ``known`` and of no candidate accepted before, under the same keys. ``keys``
    must not be null."""
    k = known.select(*keys, F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e")).distinct()
    c = candidates.select(*keys, id_col, "start_ms", "end_ms").distinct()
    hit = rangejoin.overlap_join(c, k, keys, "start_ms", "end_ms", "_s", "_e", pad=pad).select(*c.columns).distinct()
    return keep_first(c.join(hit, c.columns, "left_anti"), keys, id_col, pad)


def clusters(events: DataFrame, gap: int = 75_000) -> DataFrame:
    """(video_id, scene_id, start_ms, end_ms, events): a scene's events in order of start, a new cluster
    beginning where ``gap`` has passed or where the event's roles conflict with one of the cluster: both
    established, and actor and target reversed, or one actor once helpful and once hostile. Of several
    clusters each has its number after the scene's id. Repeated rows count as often as they come.

    Events farther than ``gap`` from all earlier ones begin a new strand, and strands go by in order; what
    is kept of a cluster are its roles, not its events.
    """
    keyed = events.withColumn("_key", F.struct("video_id", "scene_id"))
    strands = _strands(keyed, "_key", "event_id", "start_ms", "end_ms", gap=gap + 1).drop("_key")
    rows = strands.select("video_id", "scene_id", "strand", "start_ms", "end_ms", "event_id", "actor", "target", "intent", "established")

    def step(group: Iterator[tuple]) -> Iterator[tuple]:
        open_: list | None = None  # start, end, number
        pairs, intents = set(), set()
        for video, scene, strand, start, end, _, actor, target, intent, established in group:
            conflict = established and ((actor != target and (target, actor) in pairs) or (intent == "hostile" and (actor, "helpful") in intents) or (intent == "helpful" and (actor, "hostile") in intents))
            if open_ and start <= open_[1] + gap and not conflict:
                open_[1], open_[2] = max(open_[1], end), open_[2] + 1
            else:
                if open_:
                    yield video, scene, *open_, order
                    order += 1
                else:
                    order = 0
                open_, pairs, intents = [start, end, 1], set(), set()
            if established:
                pairs.add((actor, target))
                intents.add((actor, intent))
        if open_:
            yield video, scene, *open_, order

    kind = {c: events.schema[c].dataType.simpleString() for c in ("video_id", "scene_id")}
    schema = f"video_id {kind['video_id']}, scene_id {kind['scene_id']}, start_ms bigint, end_ms bigint, events int, place int"
    parts = streamed(rows, ["video_id", "scene_id", "strand"], ["start_ms", "end_ms", "event_id"], step, schema)
    scene = Window.partitionBy("video_id", "scene_id")
    number = F.row_number().over(scene.orderBy("start_ms", "place"))
    name = F.when(F.count("*").over(scene) == 1, F.col("scene_id")).otherwise(F.concat_ws(":", "scene_id", number))
    return parts.select("video_id", name.alias("scene_id"), "start_ms", "end_ms", "events")


def best_apart(rows: DataFrame, key: str, order: list[str], most: int, pad: int) -> DataFrame:
    """(rows' columns, place): of each key the greatest row by ``order``, then the greatest of those that lie
    farther than ``pad`` from all taken before, up to ``most``. A round is one aggregation and one join with
    a row a key."""
    left, out = rows, None
    for place in range(1, most + 1):
        top = left.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), F.struct(*order)).alias("x"))
        taken = top.select(key, "x.*", F.lit(place).alias("place")).select(*rows.columns, "place")
        out = taken if out is None else out.unionByName(taken)
        if place < most:
            near = top.select(key, (F.col("x.start_ms") - pad).alias("_s"), (F.col("x.end_ms") + pad).alias("_e"))
            left = left.join(near, key).where("start_ms > _e OR end_ms < _s").drop("_s", "_e")
    return out


def matching(pairs: DataFrame, group: list[str], left: str, right: str) -> DataFrame:
    """(*group, matched): the greatest number of pairs that use no left and no right twice, per group
    (augmenting paths). A group's eligible pairs must be a bounded set, such as those of one strand."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        edges: dict = {}
        for a, b in zip(g[left], g[right]):
            edges.setdefault(a, []).append(b)
        taken: dict = {}
        for a in sorted(edges):
            seen: set = set()
            path = [(a, iter(sorted(edges[a])))]
            trail: list = []
            while path:  # depth-first search for a free right end
                node, options = path[-1]
                for b in options:
                    if b in seen:
                        continue
                    seen.add(b)
                    trail = trail[: len(path) - 1] + [(node, b)]
                    if b not in taken:
                        for n, r in trail:
                            taken[r] = n
                        path = []
                    else:
                        path.append((taken[b], iter(sorted(edges[taken[b]]))))
                    break
                else:
                    path.pop()
        return pd.DataFrame([(*key, len(taken))], columns=[*group, "matched"])

    schema = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in group) + ", matched int"
    return pairs.select(*group, left, right).distinct().groupBy(*group).applyInPandas(run, schema)

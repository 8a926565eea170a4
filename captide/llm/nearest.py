"""Pairs of the nearest records in time of two tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE_MS = 5_000
#: Width of a time block; records of one entity in one block are compared in one place.
BLOCK_MS = 60_000
#: Rows of both tables that one group holds on average.
GROUP_ROWS = 20_000


def nearest_pairs(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, entity: str, left_time: str, right_time: str,
    tolerance: int = TOLERANCE_MS, block: int = BLOCK_MS,
) -> DataFrame:
    """(left_id, right_id): each left record with the right one of the same entity that is nearest in
    time, at most ``tolerance`` away; of two equally near the earlier, of two at one time the lesser id.

    Records with a null id, entity or time pair with nothing; repeated rows count once; a right record
    may serve several left ones; empty tables give no rows; other columns are ignored.

    Both sides are reduced to their distinct times per entity, so a group of one entity and one time
    block has at most block + 2 * tolerance times, however many records stand behind it. Right times go
    to every block that their tolerance touches. Groups of many such blocks are co-grouped, and one
    binary search over (entity and block, time) finds all neighbours of a group.
    """
    whole = max(block, 2 * tolerance)
    ok = lambda t: F.col(t).isNotNull()
    # a block number is a floor: DIV alone rounds towards zero; margins end where 64 bits do
    floor = lambda t: F.expr(f"({t}) DIV {whole} - CAST(({t}) < 0 AND pmod({t}, {whole}) != 0 AS INT)")
    first, last = -(1 << 63) + tolerance, (1 << 63) - 1 - tolerance
    reach = F.sequence(floor(f"greatest(t, {first}) - {tolerance}"), floor(f"least(t, {last}) + {tolerance}"))
    lefts = left.select(F.col(left_id).alias("l"), F.col(entity).alias("v"), F.col(left_time).cast("bigint").alias("t")).where(F.col("v").isNotNull() & ok("t") & F.col("l").isNotNull()).distinct()
    rights = (
        right.select(F.col(right_id).alias("r"), F.col(entity).alias("v"), F.col(right_time).cast("bigint").alias("t"))
        .where(F.col("v").isNotNull() & ok("t") & F.col("r").isNotNull())
        .groupBy("v", "t").agg(F.min("r").alias("r"))
    )
    groups = max(1, (left.count() + right.count()) // GROUP_ROWS)
    spread = F.expr(f"CAST(pmod(xxhash64(v, b), {groups}) AS INT)").alias("g")
    a = lefts.select("v", "t").distinct().withColumn("b", floor("t")).select("v", "t", "b", spread)
    b = rights.withColumn("b", F.explode(reach)).select("v", "t", "r", "b", spread)
    r_type = rights.schema["r"].dataType.simpleString()
    v_type = rights.schema["v"].dataType.simpleString()

    def match(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"v": x["v"], "t": x["t"], "r": pd.Series([None] * len(x), dtype=object)})
        if not len(x) or not len(y):
            return out.iloc[:0]
        place, _ = pd.factorize(pd.MultiIndex.from_frame(pd.concat([x[["v", "b"]], y[["v", "b"]]])))
        # one number for entity, block and time in the block
        width = whole + 2 * tolerance + 2
        at = lambda p, d: p * width + (d["t"].to_numpy() - d["b"].to_numpy() * whole + tolerance)
        px, py = place[: len(x)], place[len(x) :]
        kx, ky = at(px, x), at(py, y)
        order = np.argsort(ky, kind="stable")
        ky, py = ky[order], py[order]
        ids = y["r"].to_numpy()[order]
        after = np.searchsorted(ky, kx)
        before = np.maximum(after - 1, 0)
        after = np.minimum(after, len(ky) - 1)
        far = width + 1
        gap = lambda i: np.where(py[i] == px, np.abs(ky[i] - kx), far)
        best = np.where(gap(before) <= gap(after), before, after)
        hit = gap(best) <= tolerance
        out["r"] = ids[best]
        return out[hit]

    found = a.groupBy("g").cogroup(b.groupBy("g")).applyInPandas(match, f"v {v_type}, t bigint, r {r_type}")
    return lefts.join(found, ["v", "t"]).select(F.col("l").alias(left_id), F.col("r").alias(right_id))

"""Items into containers under several limits at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that are packed together, under one limit and under several (whose work grows with the square). A
#: shard leaves at most about one container badly filled.
SHARD_PIECES, SHARD_VECTORS = 20_000, 5_000


def fill(sizes: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The container of each item; sizes is (n, d), no item exceeds the capacity in any dimension.

    Dot-product heuristic: the open container takes, of the items that still fit, the one with the
    greatest product of its demand and the room left, each dimension weighted by how scarce it is over
    all items. Equal items are one kind with a count, so a round costs the number of kinds.
    """
    n, d = sizes.shape
    kinds, kind = np.unique(sizes, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    members = np.argsort(kind, kind="stable")
    count = np.bincount(kind, minlength=len(kinds))
    next_member = np.append(0, np.cumsum(count))[:-1].copy()
    share = kinds / capacity
    weight = sizes.sum(axis=0) / capacity
    weight = weight / weight.max() if weight.max() > 0 else np.ones(d)
    out = np.empty(n, np.int64)
    live = np.arange(len(kinds))
    live_share = share * weight
    plain = kinds
    left, container, room = n, -1, np.zeros(d)
    if d == 1:  # the greatest product is the largest item that fits: kinds are sorted, so search for it
        size, alive = kinds[:, 0], count.copy()
        below = np.arange(len(kinds))  # nearest kind at or below that still has items, with path halving

        def largest(i: int) -> int:
            while i >= 0 and alive[i] == 0:
                j = below[i] if below[i] != i else i - 1
                if j >= 0 and alive[j] == 0:
                    below[i] = below[j] if below[j] != j else j - 1
                i = j
            return i

        space = 0
        while left:
            i = largest(int(np.searchsorted(size, space, side="right")) - 1) if container >= 0 else -1
            if i < 0:
                container, space = container + 1, int(capacity[0])
                i = largest(int(np.searchsorted(size, space, side="right")) - 1)
            take = int(min(alive[i], space // size[i])) if size[i] > 0 else int(alive[i])
            out[members[next_member[i] : next_member[i] + take]] = container
            next_member[i] += take
            alive[i] -= take
            space -= take * int(size[i])
            left -= take
        return out
    while left:
        fits = (plain <= room).all(axis=1) if container >= 0 else np.zeros(len(live), bool)
        if not fits.any():
            container, room = container + 1, capacity.copy()
            fits = np.ones(len(live), bool)
        score = np.where(fits, live_share @ (room / capacity), -1.0)
        i = int(np.argmax(score))
        k = live[i]
        out[members[next_member[k]]] = container
        next_member[k] += 1
        count[k] -= 1
        room = room - plain[i]
        left -= 1
        if not count[k]:
            keep = np.arange(len(live)) != i
            live, live_share, plain = live[keep], live_share[keep], plain[keep]
    return out


def pack(df: DataFrame, id_col: str, size_cols: list[str], capacities: list[int], shard_pieces: int | None = None) -> DataFrame:
    """(id_col, piece, container, *size_cols): every item in one container, or, if it alone exceeds a
    capacity, in pieces that do not; the sizes are those of the piece.

    Limits hold at once in all dimensions (tokens, segments, loss-bearing tokens). An item that exceeds
    a capacity is cut evenly in all dimensions into as few pieces as fit. Null and negative sizes count
    as 0; rows repeated in all columns count once; of several rows with one id, and of null ids, each is
    an item, even of equal sizes; an empty table gives no rows; other columns are not in the result. ``container`` is ``shard-number``.
    """
    caps = np.array(capacities, np.int64)
    sizes = [F.greatest(F.coalesce(F.col(c).cast("bigint"), F.lit(0)), F.lit(0)).alias(f"s{i}") for i, c in enumerate(size_cols)]
    # the hash of a whole row spreads rows of one id, or of none, over the shards
    items = df.distinct().select(F.col(id_col).alias("id"), *sizes, F.xxhash64(*(F.col(c) for c in df.columns)).alias("row"))
    d = len(size_cols)
    pieces = F.greatest(*(F.ceil(F.col(f"s{i}") / F.lit(c)) for i, c in enumerate(capacities)), F.lit(1))
    if d == 1:  # full pieces and a rest
        c = capacities[0]
        size_of = [F.least(F.lit(c), F.col("s0") - F.col("piece") * c).alias("s0")]
    else:
        size_of = [(F.expr(f"(s{i} * (piece + 1)) DIV pieces - (s{i} * piece) DIV pieces")).alias(f"s{i}") for i in range(d)]
    cut = items.withColumn("pieces", pieces.cast("bigint")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece")).select("id", F.col("piece").cast("int").alias("piece"), "row", *size_of)
    shards = max(1, -(-(items.agg(F.sum(pieces)).first()[0] or 0) // (shard_pieces or (SHARD_PIECES if d == 1 else SHARD_VECTORS))))
    id_type = items.schema["id"].dataType.simpleString()
    names = [f"s{i}" for i in range(d)]

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["id", "piece", *names, "row"], kind="stable", ignore_index=True)
        at = fill(g[names].to_numpy(np.int64), caps)
        return pd.DataFrame({"id": g["id"], "piece": g["piece"], "container": [f"{key[0]}-{x}" for x in at], **{n: g[n] for n in names}})

    packed = (
        cut.withColumn("shard", F.expr(f"CAST(pmod(xxhash64(row, piece), {shards}) AS INT)"))
        .groupBy("shard")
        .applyInPandas(run, f"id {id_type}, piece int, container string, " + ", ".join(f"{n} bigint" for n in names))
    )
    return packed.select(F.col("id").alias(id_col), "piece", "container", *(F.col(n).alias(c) for n, c in zip(names, size_cols)))


def fill_report(packed: DataFrame, size_cols: list[str], capacities: list[int]) -> DataFrame:
    """(containers, items, and per dimension the sum and the share of the capacity used) in one row."""
    per = packed.groupBy("container").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in size_cols))
    return per.agg(
        F.count("*").alias("containers"), F.sum("n").alias("pieces"),
        *(F.sum(c).alias(c) for c in size_cols),
        *(F.round(F.sum(c) / (F.count("*") * cap), 6).alias(f"{c}_used") for c, cap in zip(size_cols, capacities)),
    )

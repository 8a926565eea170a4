"""Joins on overlapping intervals and near points, by keys and time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_MS = 60_000


def _bucket(ms: Column, width: int) -> Column:
    return F.floor(ms / F.lit(width)).cast("bigint")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], l_start: str, l_end: str, r_start: str, r_end: str, pad: int = 0, bucket: int = BUCKET_MS) -> DataFrame:
    """Pairs of equal keys with l_start <= r_end + pad and l_end >= r_start - pad (both ends count).

    Each interval stands in the buckets it touches, so the join is an equi-join on keys and bucket and
    one key's rows spread over many tasks; a pair is kept in the first bucket that both touch. The
    columns of both sides, apart from the keys, must differ in name. Null bounds pair with nothing.
    """
    spread = lambda s, e: F.explode(F.sequence(_bucket(s, bucket), _bucket(e, bucket)))
    ok = lambda s, e: F.col(s).isNotNull() & F.col(e).isNotNull() & (F.col(e) >= F.col(s))
    a = left.where(ok(l_start, l_end)).withColumn("_k", spread(F.col(l_start), F.col(l_end)))
    b = right.where(ok(r_start, r_end)).withColumn("_k", spread(F.col(r_start) - pad, F.col(r_end) + pad))
    first = F.greatest(_bucket(F.col(l_start), bucket), _bucket(F.col(r_start) - pad, bucket))
    return (
        a.join(b, [*keys, "_k"])
        .where((F.col(l_start) <= F.col(r_end) + pad) & (F.col(l_end) >= F.col(r_start) - pad) & (F.col("_k") == first))
        .drop("_k")
    )

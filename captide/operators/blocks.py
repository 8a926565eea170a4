"""Ordered work on entities of any size, in blocks of their order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def block_of(order: str, width: int = BLOCK) -> Column:
    return F.floor(F.col(order) / width).cast("bigint")


def previous(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = BLOCK) -> DataFrame:
    """Adds ``name``: the value of the row before, per keys and by ``order`` (unique per keys).

    Rows are ordered inside blocks of ``width``; across blocks only the last value of each travels."""
    b = df.withColumn("_b", block_of(order, width)).withColumn("_v", value)
    last = b.groupBy(*keys, "_b").agg(F.max_by(F.struct("_v"), order).alias("_l"))
    carry = last.select(*keys, "_b", F.lag("_l").over(Window.partitionBy(*keys).orderBy("_b")).alias("_c"))
    w = Window.partitionBy(*keys, "_b").orderBy(order)
    return (
        b.join(carry, [*keys, "_b"], "left")
        .withColumn(name, F.when(F.row_number().over(w) == 1, F.col("_c._v")).otherwise(F.lag("_v").over(w)))
        .drop("_b", "_v", "_c")
    )


def with_margins(df: DataFrame, order: str, margin: int, width: int = BLOCK) -> DataFrame:
    """Adds ``_b``, the block, and ``_own``: rows within ``margin`` of a block's border stand in the
    neighbour too, there as guests, so that frames of up to ``margin`` rows are whole in every block."""
    at = F.pmod(F.col(order), F.lit(width))
    b = block_of(order, width)
    near = F.array(b, F.when(at < margin, b - 1), F.when(at >= width - margin, b + 1))
    return df.withColumn("_home", b).withColumn("_b", F.explode(F.filter(near, lambda x: x.isNotNull()))).withColumn("_own", F.col("_b") == F.col("_home")).drop("_home")


def numbered(df: DataFrame, keys: list[str], block: Column, order: list, name: str = "pos") -> DataFrame:
    """Adds ``name``: the place of a row from 0 on among those of equal keys, by block and then by order.

    Rows are ordered inside their block; across blocks only counts travel."""
    b = df.withColumn("_b", block)
    n = b.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = n.select(*keys, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1
    return b.join(before, [*keys, "_b"]).withColumn(name, F.col("_o") + inside).drop("_b", "_o")

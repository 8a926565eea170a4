"""Continuous periods and gaps of intervals per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captide.sources.shared import settled

#: Width of the time blocks in which the intervals of one entity are merged apart from each other.
BLOCK_MS = 600_000


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, block_ms: int = BLOCK_MS) -> DataFrame:
    """(*keys, kind, start_ms, end_ms): ``period`` for each union of intervals that overlap or touch,
    ``gap`` for each stretch between one period and the next of the same keys.

    Rows with a null bound or an end not after the start are left out; repeated rows count once; null
    keys are an entity like any other; an empty table gives no rows; other columns are ignored.

    ``session_window`` with the row's own duration merges what overlaps inside a block of ``block_ms``
    of an entity. A window then joins periods that touch, and gaps come from ``lead``. The blocks of an
    entity are tied together by one row each, so no task holds an entity as a whole.
    """
    # a struct of the keys equals itself even where keys are null, so that plain joins keep one partitioning
    key = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys))) if keys else F.struct(F.lit(0).alias("k0"))
    rows = df.select(key.alias("k"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).where("s IS NOT NULL AND e > s")
    # a session needs no more than the time inside its block; the true end is kept beside it
    length = F.concat(F.least(F.expr("try_subtract(e, s)"), F.lit(block_ms + 1)).cast("string"), F.lit(" milliseconds"))
    offset = F.expr(f"pmod(s, {block_ms})")
    merged = settled(  # the table is read and merged once; what follows works on the sessions of blocks
        rows.withColumn("b", F.expr(f"s DIV {block_ms}") - F.when((F.col("s") < 0) & (offset != 0), 1).otherwise(0))
        .groupBy("k", "b", F.session_window(F.timestamp_millis(offset), F.coalesce(length, F.lit(f"{block_ms + 1} milliseconds"))).alias("w"))
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .drop("w")
    )
    in_block = Window.partitionBy("k", "b").orderBy("s", "e")
    by_block = Window.partitionBy("k").orderBy("b")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("k").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    reach = merged.groupBy("k", "b").agg(F.max("e").alias("most")).select("k", "b", F.max("most").over(earlier).alias("reach"))
    flagged = (
        merged.join(reach, ["k", "b"], "left")
        .withColumn("before", F.greatest("reach", F.max("e").over(in_block.rowsBetween(Window.unboundedPreceding, -1))))
        .withColumn("new", F.col("before").isNull() | (F.col("s") > F.col("before")))
        .withColumn("first", F.max(F.when(F.col("new"), F.col("s"))).over(in_block))
    )
    # of each block: where the period begins that runs into it, and where the next one after it begins
    heads = flagged.groupBy("k", "b").agg(F.max("first").alias("head"), F.min("first").alias("foot"))
    ties = heads.select("k", "b", F.last("head", True).over(earlier).alias("open"), F.last("foot", True).over(later).alias("next_foot"))
    tied = flagged.join(ties, ["k", "b"], "left").withColumn("p", F.coalesce("first", "open"))
    home = F.col("first").isNotNull()
    periods = tied.groupBy("k", "p").agg(
        F.max("e").alias("e"), F.min(F.when(home, F.col("b"))).alias("b"), F.min(F.when(home, F.col("next_foot"))).alias("next_foot")
    )
    nxt = F.coalesce(F.lead("p").over(Window.partitionBy("k", "b").orderBy("p")), F.col("next_foot"))
    period = F.struct(F.lit("period").alias("kind"), F.col("p").alias("s"), F.col("e").alias("e"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("e").alias("s"), F.col("n").alias("e"))
    both = periods.withColumn("n", nxt).select("k", F.explode(F.filter(F.array(period, gap), lambda x: x["e"].isNotNull())).alias("x"))
    return both.select(*(F.col(f"k.k{i}").alias(c) for i, c in enumerate(keys)), "x.kind", F.col("x.s").alias("start_ms"), F.col("x.e").alias("end_ms"))

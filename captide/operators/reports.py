"""Counts of content events per video, category and channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captide.functions.numbers import prevalence

def severity_rank(c: str = "severity") -> Column:
    return F.when(F.col(c) == "low", 1).when(F.col(c) == "medium", 2).when(F.col(c) == "high", 3)


def strongest(events: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """One event per key: that of the highest confidence, of equal ones the least id."""
    cols = [c for c in events.columns if c not in keys]
    best = F.min_by(F.struct(*cols), F.struct(-F.col("confidence"), F.col(id_col))).alias("x")
    return events.groupBy(*keys).agg(best).select(*keys, "x.*")


def video_categories(events: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """(video_id, category, events, shown, level, subtypes): a row for every video and category, also for
    those without events; ``shown`` are events of at least medium severity."""
    per = events.groupBy("video_id", "category").agg(
        F.count("*").alias("events"), F.count_if(severity_rank() >= 2).alias("shown"), F.max(severity_rank()).alias("level"),
        F.array_join(F.array_sort(F.collect_set("subtype")), ",").alias("subtypes"),
    )
    every = events.select("video_id").distinct().withColumn("category", F.explode(F.array(*map(F.lit, categories))))
    filled = every.join(per, ["video_id", "category"], "left")
    return filled.select("video_id", "category", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "shown", "level")), F.coalesce("subtypes", F.lit("")).alias("subtypes"))


def channel_categories(events: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """(category, raw_videos, videos, high_videos, events, peak, band): over all videos, per category, with
    zero rows; a video is affected by events of at least medium severity. Two levels of aggregation, so a
    video with very many events is one row before it meets the others."""
    per = events.groupBy("category", "video_id").agg(F.count("*").alias("n"), F.max(severity_rank()).alias("peak"))
    total = events.select("video_id").distinct().agg(F.count("*").alias("analyzed")).withColumn("category", F.explode(F.array(*map(F.lit, categories))))
    by = per.groupBy("category").agg(
        F.count("*").alias("raw_videos"), F.count_if(F.col("peak") >= 2).alias("videos"), F.count_if(F.col("peak") == 3).alias("high_videos"),
        F.sum("n").alias("events"), F.max("peak").alias("peak"),
    )
    filled = total.join(by, "category", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("raw_videos", "videos", "high_videos", "events", "peak")]
    return filled.select("category", *zero, prevalence(F.coalesce("videos", F.lit(0)), F.col("analyzed")).alias("band"))


def subtype_stats(events: DataFrame) -> DataFrame:
    """(category, subtype, events, videos, place) by events, then name."""
    per = events.groupBy("category", "subtype", "video_id").agg(F.count("*").alias("n"))
    by = per.groupBy("category", "subtype").agg(F.sum("n").alias("events"), F.count("*").alias("videos"))
    return by.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("events"), "subtype")))


def apportioned(df: DataFrame, group: str, order: str, total: str, weight: str, offset: bool = False) -> DataFrame:
    """(group, order, share): the whole number ``total`` of a group spread over its rows by weight (1 at
    least) without rest: the largest fractions get one more, from the largest on (of equal ones by order, then weight), or, with ``offset``,
    from the place that the sum of the whole parts points to."""
    w = F.greatest(F.lit(1).cast("bigint"), F.col(weight).cast("bigint"))
    g = Window.partitionBy(group)
    t = F.greatest(F.col(total).cast("bigint"), F.lit(0).cast("bigint"))
    d = df.withColumn("_w", w).withColumn("_s", F.sum("_w").over(g)).withColumn("_n", F.count("*").over(g))
    d = d.withColumn("_f", F.expr(f"(greatest(CAST({total} AS BIGINT), 0L) * _w) DIV _s")).withColumn("_m", F.pmod(t * F.col("_w"), F.col("_s")))
    d = d.withColumn("_rest", t - F.sum("_f").over(g)).withColumn("_p", F.row_number().over(g.orderBy(F.desc("_m"), order, "_w")) - 1)
    start = F.pmod(t - F.col("_rest"), F.col("_n")) if offset else F.lit(0)
    place = F.pmod(F.col("_p") - start, F.col("_n"))
    return d.select(group, order, (F.col("_f") + F.when(place < F.col("_rest"), 1).otherwise(0)).alias("share"))

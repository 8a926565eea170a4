"""The tables in the shape that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captide.functions.text import clean_caption, music_only
from captide.sources.tables import table

# Content categories in their order of rank.
CATEGORIES = (
    "profanity_and_rude_language", "insults", "toilet_humor", "violence", "scary_and_disturbing", "sexual_content", "gambling", "substances", "self_harm",
)


def segment_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the segments with a text and possible times, repeated ones too."""
    return table(spark, d, "transcript_segments").where("video_id IS NOT NULL AND seg_idx IS NOT NULL AND text IS NOT NULL AND start_ms >= 0 AND end_ms >= start_ms")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """(video_id, seg_idx, text, start_ms, end_ms) of the segments with a text and possible times, once each."""
    return segment_rows(spark, d).groupBy("video_id", "seg_idx").agg(F.min("text").alias("text"), F.min("start_ms").alias("start_ms"), F.min("end_ms").alias("end_ms"))


SEGMENTS_SQL = """seg AS (SELECT video_id, seg_idx, min(text) AS text, min(start_ms) AS start_ms, min(end_ms) AS end_ms FROM transcript_segments
  WHERE video_id IS NOT NULL AND seg_idx IS NOT NULL AND text IS NOT NULL AND start_ms >= 0 AND end_ms >= start_ms GROUP BY 1, 2)"""


def captions(spark: SparkSession, d: str) -> DataFrame:
    """Segments with clean text, without blank ones and music tags."""
    return segments(spark, d).withColumn("text", clean_caption(F.col("text"))).where((F.col("text") != "") & ~music_only(F.col("text")))


CAPTIONS_SQL = (
    SEGMENTS_SQL
    + r""", cap0 AS (SELECT video_id, seg_idx, start_ms, end_ms, trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g'), '[\s\x{00A0}\x{0085}\x0B\x{2028}\x{2029}\x{3000}]+', ' ', 'g')) AS text FROM seg),
cap AS (SELECT * FROM cap0 WHERE text <> '' AND NOT regexp_matches(lower(text), '^\s*(\[(музыка|music|instrumental)\]|\((музыка|music|instrumental)\))\s*[.!…-]*\s*$'))"""
)


def content_events(spark: SparkSession, d: str) -> DataFrame:
    """Content events made of the table ``events``: video, scene, category, subtype, severity, confidence
    and a time interval, the clock being pressed so that gaps lie around the usual limits."""
    e = table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("int")
    kind = {"view": "violence", "click": "insults", "purchase": "gambling", "signup": "substances", "error": "scary_and_disturbing"}
    category = F.coalesce(*(F.when(F.col("event_type") == t, c) for t, c in kind.items()))
    start = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 360000")
    day = F.floor(us / F.lit(86_400_000_000)).cast("bigint")
    return e.select(
        F.col("user_id").alias("video_id"), F.col("event_id"), category.alias("category"), F.concat(F.lit("s"), (k % 4).cast("string")).alias("subtype"),
        F.when(F.col("value") < 20, "low").when(F.col("value") < 80, "medium").otherwise("high").alias("severity"),
        F.round(F.least(F.col("value") / 100, F.lit(1.0)), 4).alias("confidence"), start.alias("start_ms"), (start + 2000).alias("end_ms"),
        F.concat_ws("_", F.col("user_id").cast("string"), day.cast("string")).alias("scene_id"),
    )


EVENTS_SQL = """ev AS (SELECT user_id AS video_id, event_id,
  CASE event_type WHEN 'view' THEN 'violence' WHEN 'click' THEN 'insults' WHEN 'purchase' THEN 'gambling' WHEN 'signup' THEN 'substances' WHEN 'error' THEN 'scary_and_disturbing' END AS category,
  's' || CAST(CAST(json_extract(props, '$.k') AS INT) % 4 AS VARCHAR) AS subtype,
  CASE WHEN value < 20 THEN 'low' WHEN value < 80 THEN 'medium' ELSE 'high' END AS severity,
  round(least(value / 100, 1.0), 4) AS confidence, epoch_us(ts) // 360000 AS start_ms, epoch_us(ts) // 360000 + 2000 AS end_ms,
  CAST(user_id AS VARCHAR) || '_' || CAST(epoch_us(ts) // 86400000000 AS VARCHAR) AS scene_id FROM events)"""

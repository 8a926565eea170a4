"""Words, fillers and repetitions of spoken text per video and channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captide.functions.numbers import frequency_band, per_thousand
from captide.functions.text import MARKERS, marker_counts, repeats, words
from captide.operators.blocks import previous


def speech_metrics(captions: DataFrame, language: DataFrame) -> DataFrame:
    """(video_id, total_words, fillers, repeated, markers array, method): counts over all captions of a
    video; a repetition may span two captions; fillers count in Russian videos only.

    ``language`` has (video_id, base). Captions are reduced to counts before they are shuffled by video.
    """
    t = captions.withColumn("w", words(F.col("text"))).where(F.size("w") > 0)
    ends = t.select("video_id", "seg_idx", F.size("w").alias("n"), repeats(F.col("w")).alias("r"), F.col("w")[0].alias("first"), F.element_at("w", -1).alias("last"), marker_counts(F.col("text"), F.col("w")).alias("m"))
    linked = previous(ends, ["video_id"], "seg_idx", F.col("last"), "before")
    per = linked.groupBy("video_id").agg(
        F.sum("n").alias("total_words"), F.sum(F.col("r") + F.coalesce((F.col("before") == F.col("first")).cast("int"), F.lit(0))).alias("repeated"),
        F.array(*(F.sum(F.col("m")[i]) for i in range(len(MARKERS)))).alias("m"),
    )
    russian = F.coalesce(F.col("base") == "ru", F.lit(False))
    zero = F.array(*(F.lit(0).cast("bigint") for _ in MARKERS))
    return (
        per.join(language, "video_id", "left")
        .withColumn("markers", F.when(russian, F.col("m")).otherwise(zero))
        .select("video_id", "total_words", F.aggregate("markers", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("fillers"), "repeated", "markers", F.when(russian, "heuristic_ru_v1").otherwise("repetition_only_v1").alias("method"))
    )


def with_rates(df: DataFrame) -> DataFrame:
    """Adds rates per 1000 words and the bands they fall in."""
    f, r = per_thousand(F.col("fillers"), F.col("total_words")), per_thousand(F.col("repeated"), F.col("total_words"))
    return df.withColumns({"fillers_per_1000": f, "repeated_per_1000": r, "filler_band": frequency_band(f), "repetition_band": frequency_band(r)})


def channel_speech(metrics: DataFrame, channel: DataFrame) -> DataFrame:
    """Per channel: sums over its videos and rates of the sums."""
    sums = metrics.join(channel, "video_id").groupBy("channel_id").agg(F.count("*").alias("videos"), *(F.sum(c).alias(c) for c in ("total_words", "fillers", "repeated")))
    return with_rates(sums)


def channel_markers(metrics: DataFrame, channel: DataFrame) -> DataFrame:
    """(channel_id, marker, n, place): fillers of each channel by how often they occur."""
    each = metrics.join(channel, "video_id").select("channel_id", F.posexplode("markers").alias("i", "n"))
    total = each.groupBy("channel_id", "i").agg(F.sum("n").alias("n")).where("n > 0")
    name: Column = F.element_at(F.array(*(F.lit(m) for m in MARKERS)), F.col("i") + 1)
    return total.select("channel_id", name.alias("marker"), "n", F.row_number().over(Window.partitionBy("channel_id").orderBy(F.desc("n"), "i")).alias("place"))


def marker_examples(captions: DataFrame, most: int = 8) -> DataFrame:
    """(video_id, seg_idx, marker, place): the first examples of fillers in a video, by caption and marker."""
    t = captions.withColumn("w", words(F.col("text"))).select("video_id", "seg_idx", F.posexplode(marker_counts(F.col("text"), F.col("w"))).alias("i", "n")).where("n > 0")
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("seg_idx", "i"))
    name = F.element_at(F.array(*(F.lit(m) for m in MARKERS)), F.col("i") + 1)
    return t.withColumn("place", place).where(F.col("place") <= most).select("video_id", "seg_idx", name.alias("marker"), "place")

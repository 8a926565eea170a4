"""The queries of the training-data problems, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captide.functions import text
from captide.llm import abuse, encode, langid, leaks, nearest, packing, reading, splits, turns
from captide.operators import captions
from captide.sources.shared import settled
from captide.sources.tables import table
from captide.sources.views import captions as clean_captions

Query = Callable[[SparkSession, str], DataFrame]
#: What a batch of examples holds at most.
LIMITS = {"tokens": 16_000, "segments": 640, "loss_tokens": 8_000}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return turns.speaker_turns(t("transcript_segments"), t("videos"), t("channel_speakers")).drop("speaker")


def p1_utterances(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return turns.utterances(t("transcript_segments"), t("videos"), t("channel_speakers"))


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return langid.languages(t("transcript_segments"), t("videos"), t("channel_speakers"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.wrong_labels(p2_languages(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.cross_split_pairs(table(spark, d, "parental_quality_manual"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.overlap_report(table(spark, d, "parental_quality_manual"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    controls, gold = table(spark, d, "compot_recall_controls"), table(spark, d, "compot_gold")
    return nearest.nearest_pairs(controls, gold, "control_id", "gold_id", "video_id", "at_ms", "start_ms")


def p6_batches(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk with its request batch of 70,000 tokens."""
    return packing.pack(table(spark, d, "transcript_chunks"), "item_id", ["estimated_tokens"], [70_000])


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_batches(spark, d), ["estimated_tokens"], [70_000])


def p6_limits(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of all transcripts in batches of 70,000 tokens and 3,000 segments, both at once."""
    c = captions.chunks(clean_captions(spark, d)).select(F.concat_ws(":", "video_id", "chunk").alias("chunk"), "tokens", (F.col("last") - F.col("first") + 1).alias("segments"))
    return packing.pack(c, "chunk", ["tokens", "segments"], [70_000, 3_000])


def _examples(spark: SparkSession, d: str) -> DataFrame:
    """Examples for instruction data: 64 segments of a video each. What persons known to the channel say
    bears loss, what others say is the prompt."""
    tokens = text.token_estimate(F.col("words"))
    u = p1_utterances(spark, d).groupBy("video_id", F.floor(F.col("seg_idx") / 64).alias("part"))
    u = u.agg(F.sum(tokens).alias("tokens"), F.count_distinct("seg_idx").alias("segments"), F.sum(F.when(F.col("speaker").startswith("p:"), tokens).otherwise(0)).alias("loss_tokens"))
    return u.select(F.concat_ws(":", "video_id", "part").alias("example"), *LIMITS)


def p6_instruction_batches(spark: SparkSession, d: str) -> DataFrame:
    """The examples in batches of 16,000 tokens, 640 segments and 8,000 loss-bearing tokens, all at once."""
    return packing.pack(settled(_examples(spark, d)), "example", list(LIMITS), list(LIMITS.values()))


def p6_instruction_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_instruction_batches(spark, d), list(LIMITS), list(LIMITS.values()))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.found_items(table(spark, d, "documents"), table(spark, d, "transcript_segments"), table(spark, d, "abuse_labels"))


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return abuse.rates(abuse.score_items(t("documents"), t("transcript_segments"), t("videos"), t("abuse_labels")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    documents, items = table(spark, d, "documents"), table(spark, d, "eval_passages")
    return leaks.leak_report(leaks.leaked_items(documents, items), documents, items)


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_grades"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.highest_grade(p10_levels(spark, d))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.level_profile(p10_levels(spark, d), table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1].isdigit()}


P5_SQL = """
WITH c AS (SELECT DISTINCT control_id, video_id, at_ms FROM compot_recall_controls WHERE control_id IS NOT NULL AND video_id IS NOT NULL AND at_ms IS NOT NULL),
g AS (SELECT video_id, start_ms, min(gold_id) AS gold_id FROM compot_gold WHERE gold_id IS NOT NULL AND video_id IS NOT NULL AND start_ms IS NOT NULL GROUP BY 1, 2),
r AS (SELECT c.control_id, g.gold_id, row_number() OVER (PARTITION BY c.control_id, c.video_id, c.at_ms ORDER BY abs(g.start_ms - c.at_ms), g.start_ms) AS k
  FROM c JOIN g ON g.video_id = c.video_id AND abs(g.start_ms - c.at_ms) <= 5000)
SELECT control_id, gold_id FROM r WHERE k = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_SQL}

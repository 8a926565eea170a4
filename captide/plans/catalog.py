"""The queries of the core library by name, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captide.functions import grounding, numbers, text
from captide.operators import anchors, blocks, captions, periods, rangejoin, reports, scenes, speech
from captide.sources import captionjson
from captide.sources.tables import table
from captide.sources.views import CAPTIONS_SQL, CATEGORIES, EVENTS_SQL, SEGMENTS_SQL, content_events, segment_rows, segments
from captide.sources.views import captions as clean_captions
from captide.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the same in SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CATEGORIES_SQL = "cats AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]) AS category)"


# -- periods and gaps --------------------------------------------------------------------------


@query("""
WITH i AS (
  SELECT 'scene' AS origin, scan_id, video_id AS entity, context_start_ms AS s, context_end_ms AS e FROM draft_scenes
  UNION ALL SELECT 'timing', scan_id, stage, start_ms, end_ms FROM timing_intervals),
o AS (SELECT DISTINCT * FROM i WHERE s IS NOT NULL AND e > s),
f AS (SELECT *, max(e) OVER (PARTITION BY origin, scan_id, entity ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM o),
n AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY origin, scan_id, entity ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS p FROM f),
m AS (SELECT origin, scan_id, entity, p, min(s) AS s, max(e) AS e FROM n GROUP BY ALL),
g AS (SELECT *, lead(s) OVER (PARTITION BY origin, scan_id, entity ORDER BY s) AS nxt FROM m)
SELECT origin, scan_id, entity, 'period' AS kind, s AS start_ms, e AS end_ms FROM g
UNION ALL SELECT origin, scan_id, entity, 'gap', e, nxt FROM g WHERE nxt IS NOT NULL
""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods and gaps of draft scenes per scan and video, and of timing intervals per scan and stage."""
    cols = ["origin", "scan_id", "entity"]
    drafts = table(spark, d, "draft_scenes").select(
        F.lit("scene").alias("origin"), "scan_id", F.col("video_id").alias("entity"), F.col("context_start_ms").alias("start_ms"), F.col("context_end_ms").alias("end_ms")
    )
    timings = table(spark, d, "timing_intervals").select(F.lit("timing").alias("origin"), "scan_id", F.col("stage").alias("entity"), "start_ms", "end_ms")
    return periods.periods_and_gaps(drafts.unionByName(timings), cols, "start_ms", "end_ms")


@query("WITH " + EVENTS_SQL + """,
f AS (SELECT *, max(end_ms) OVER (PARTITION BY video_id, category ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM ev),
n AS (SELECT *, sum(CASE WHEN r IS NULL OR start_ms > r + 75000 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, category ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS p FROM f)
SELECT video_id, category, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM n GROUP BY video_id, category, p
""")
def scene_islands_75s(spark: SparkSession, d: str) -> DataFrame:
    """Events of a video and category that lie at most 75 s apart make one scene."""
    e = content_events(spark, d).withColumn("reach", F.col("end_ms") + 75_000)
    p = periods.periods_and_gaps(e, ["video_id", "category"], "start_ms", "reach").where("kind = 'period'")
    return p.select("video_id", "category", "start_ms", (F.col("end_ms") - 75_000).alias("end_ms"))


@query("""
WITH o AS (SELECT DISTINCT scan_id, video_id, context_start_ms AS s, context_end_ms AS e FROM draft_scenes WHERE context_start_ms IS NOT NULL AND context_end_ms > context_start_ms),
f AS (SELECT *, max(e) OVER (PARTITION BY scan_id, video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM o),
n AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 5000 THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id, video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS p FROM f)
SELECT scan_id, video_id, min(s) AS start_ms, max(e) AS end_ms FROM n GROUP BY scan_id, video_id, p
""")
def evidence_merge_5s(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of evidence that lie at most 5 s apart are merged."""
    s = table(spark, d, "draft_scenes").where("context_end_ms > context_start_ms").withColumn("reach", F.col("context_end_ms") + 5_000)
    p = periods.periods_and_gaps(s, ["scan_id", "video_id"], "context_start_ms", "reach").where("kind = 'period'")
    return p.select("scan_id", "video_id", "start_ms", (F.col("end_ms") - 5_000).alias("end_ms"))


@query("""
WITH o AS (SELECT DISTINCT scan_id, stage, start_ms AS s, end_ms AS e FROM timing_intervals WHERE start_ms IS NOT NULL AND end_ms > start_ms),
f AS (SELECT *, max(e) OVER (PARTITION BY scan_id, stage ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM o)
SELECT scan_id, stage, CAST(sum(greatest(0, e - greatest(s, coalesce(r, s)))) AS BIGINT) AS wall_ms FROM f GROUP BY 1, 2
""")
def interval_union_length(spark: SparkSession, d: str) -> DataFrame:
    """Wall time of a stage, the length of the union of its intervals."""
    p = periods.periods_and_gaps(table(spark, d, "timing_intervals"), ["scan_id", "stage"], "start_ms", "end_ms").where("kind = 'period'")
    return p.groupBy("scan_id", "stage").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("wall_ms"))


# -- caption text ------------------------------------------------------------------------------


@query("WITH " + CAPTIONS_SQL + " SELECT video_id, seg_idx, text, CAST(greatest(1, ceil(strlen(text) / 3.0)) AS BIGINT) AS tokens FROM cap")
def clean_caption(spark: SparkSession, d: str) -> DataFrame:
    """P1, P2, H: clean captions without music tags, and their estimated tokens."""
    return clean_captions(spark, d).select("video_id", "seg_idx", "text", text.token_estimate(F.col("text")).alias("tokens"))


@query("WITH " + SEGMENTS_SQL + """ SELECT video_id, seg_idx, printf('%02d:%02d:%02d.%03d', start_ms // 3600000, (start_ms // 60000) % 60, (start_ms // 1000) % 60, start_ms % 1000) AS clock,
  printf('%d:%02d', start_ms // 60000, (start_ms // 1000) % 60) AS label FROM seg""")
def caption_clock(spark: SparkSession, d: str) -> DataFrame:
    """Times as text, in full and short."""
    ms = F.col("start_ms")
    short = F.format_string("%d:%02d", F.floor(ms / 60_000).cast("bigint"), (F.floor(ms / 1000) % 60).cast("bigint"))
    return segments(spark, d).select("video_id", "seg_idx", text.clock(ms).alias("clock"), short.alias("label"))


def _language(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos").where("video_id IS NOT NULL")
    return v.groupBy("video_id").agg(F.min(text.language_base(F.col("language"))).alias("base"))


def _channel(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "videos").where("video_id IS NOT NULL").groupBy("video_id").agg(F.min("channel_id").alias("channel_id"))


SPEECH_SQL = CAPTIONS_SQL + r""", wl AS (SELECT video_id, seg_idx, lower(text) AS t, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM cap),
tok AS (SELECT video_id, seg_idx, generate_subscripts(w, 1) AS k, unnest(w) AS w FROM wl WHERE len(w) > 0),
lagged AS (SELECT *, lag(w) OVER (PARTITION BY video_id ORDER BY seg_idx, k) AS p FROM tok),
base AS (SELECT video_id, min(regexp_split_to_array(regexp_replace(lower(language), '^asr-', ''), '[-_]')[1]) AS base FROM videos WHERE video_id IS NOT NULL GROUP BY 1),
cnt AS (SELECT video_id, count(*) AS total_words, sum(CASE WHEN w = p THEN 1 ELSE 0 END) AS repeated,
  sum((w = 'ну')::INT) AS m1, sum((w = 'короче')::INT) AS m2, sum((w = 'типа')::INT) AS m3, sum((w = 'значит')::INT) AS m5, sum(regexp_matches(w, '^э+$')::INT) AS m6, sum((w = 'эм')::INT) AS m7 FROM lagged GROUP BY 1),
two AS (SELECT video_id, sum(len(regexp_extract_all(t, '(^|[^\p{L}\p{N}])как\s+бы($|[^\p{L}\p{N}])'))) AS m4 FROM wl WHERE len(w) > 0 GROUP BY 1),
sm AS (SELECT c.video_id, CAST(total_words AS BIGINT) AS total_words, CAST(repeated AS BIGINT) AS repeated, coalesce(base = 'ru', false) AS ru, m1, m2, m3, m4, m5, m6, m7
  FROM cnt c JOIN two USING (video_id) LEFT JOIN base USING (video_id)),
speech AS (SELECT video_id, total_words, CAST(CASE WHEN ru THEN m1 + m2 + m3 + m4 + m5 + m6 + m7 ELSE 0 END AS BIGINT) AS fillers, repeated, CASE WHEN ru THEN 'heuristic_ru_v1' ELSE 'repetition_only_v1' END AS method, m1, m2, m3, m4, m5, m6, m7, ru FROM sm)"""
BAND_SQL = "CASE WHEN {0} <= 0 THEN 'none' WHEN {0} < 5 THEN 'occasional' WHEN {0} < 15 THEN 'noticeable' ELSE 'frequent' END"
RATE_SQL = "CASE WHEN total_words > 0 THEN floor({0} * 1000.0 / total_words * 10 + 0.5) / 10 ELSE 0.0 END"
RATES_SQL = ", ".join(f"{RATE_SQL.format(a)} AS {b}_per_1000, {BAND_SQL.format('(' + RATE_SQL.format(a) + ')')} AS {c}_band" for a, b, c in (("fillers", "fillers", "filler"), ("repeated", "repeated", "repetition")))


def _speech(spark: SparkSession, d: str) -> DataFrame:
    return speech.speech_metrics(clean_captions(spark, d), _language(spark, d))


@query("WITH " + SPEECH_SQL + " SELECT video_id, total_words, fillers, repeated, method, " + RATES_SQL + " FROM speech")
def speech_quality(spark: SparkSession, d: str) -> DataFrame:
    """Words, fillers and repetitions of each video, and their rates."""
    return speech.with_rates(_speech(spark, d)).drop("markers")


@query("WITH " + SPEECH_SQL + """, chan AS (SELECT video_id, min(channel_id) AS channel_id FROM videos WHERE video_id IS NOT NULL GROUP BY 1),
s AS (SELECT channel_id, count(*) AS videos, CAST(sum(total_words) AS BIGINT) AS total_words, CAST(sum(fillers) AS BIGINT) AS fillers, CAST(sum(repeated) AS BIGINT) AS repeated FROM speech JOIN chan USING (video_id) GROUP BY 1)
SELECT *, """ + RATES_SQL + " FROM s")
def speech_channel_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sums per channel, and rates of the sums."""
    return speech.channel_speech(_speech(spark, d), _channel(spark, d))


@query("WITH " + SPEECH_SQL + """, chan AS (SELECT video_id, min(channel_id) AS channel_id FROM videos WHERE video_id IS NOT NULL GROUP BY 1),
e AS (SELECT video_id, unnest(['ну', 'короче', 'типа', 'как бы', 'значит', 'э/ээ', 'эм']) AS marker, unnest([1, 2, 3, 4, 5, 6, 7]) AS i, unnest([m1, m2, m3, m4, m5, m6, m7]) AS n FROM speech WHERE ru),
t AS (SELECT channel_id, marker, i, CAST(sum(n) AS BIGINT) AS n FROM e JOIN chan USING (video_id) GROUP BY 1, 2, 3 HAVING sum(n) > 0)
SELECT channel_id, marker, n, CAST(row_number() OVER (PARTITION BY channel_id ORDER BY n DESC, i) AS INT) AS place FROM t""")
def filler_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Fillers of each channel by how often they occur."""
    return speech.channel_markers(_speech(spark, d), _channel(spark, d))


@query("WITH " + CAPTIONS_SQL + r""", wl AS (SELECT video_id, seg_idx, lower(text) AS t, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM cap),
e AS (SELECT video_id, seg_idx, unnest(['ну', 'короче', 'типа', 'как бы', 'значит', 'э/ээ', 'эм']) AS marker, unnest([1, 2, 3, 4, 5, 6, 7]) AS i,
  unnest([list_contains(w, 'ну'), list_contains(w, 'короче'), list_contains(w, 'типа'), regexp_matches(t, '(^|[^\p{L}\p{N}])как\s+бы($|[^\p{L}\p{N}])'), list_contains(w, 'значит'), len(list_filter(w, lambda x: regexp_matches(x, '^э+$'))) > 0, list_contains(w, 'эм')]) AS hit FROM wl),
r AS (SELECT video_id, seg_idx, marker, CAST(row_number() OVER (PARTITION BY video_id ORDER BY seg_idx, i) AS INT) AS place FROM e WHERE hit)
SELECT * FROM r WHERE place <= 8""")
def filler_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first eight examples of fillers in each video."""
    return speech.marker_examples(clean_captions(spark, d))


@query(r"""
WITH v AS (SELECT video_id, min(language) AS language, min(caption_source) AS caption_source FROM videos WHERE video_id IS NOT NULL GROUP BY 1),
p AS (SELECT *, CASE WHEN language IS NOT NULL AND language <> '' THEN replace(lower(language), '_', '-') END AS n FROM v),
q AS (SELECT *, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 'asr' OR starts_with(n, 'asr-') THEN 'asr' ELSE 'manual' END AS source,
  nullif(split_part(CASE WHEN n = 'asr' OR starts_with(n, 'asr-') THEN regexp_replace(n, '^asr-?', '') ELSE n END, '-', 1), '') AS base FROM p)
SELECT video_id, source, base, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 'ru' THEN 'exact' WHEN base IS DISTINCT FROM 'ru' THEN 'different_language' WHEN source = 'asr' THEN 'same_language_asr' ELSE 'same_language_variant' END AS resolution FROM q
""")
def caption_language(spark: SparkSession, d: str) -> DataFrame:
    """Source and base of each video's caption language, and how it answers a request for ``ru``."""
    v = table(spark, d, "videos").where("video_id IS NOT NULL").groupBy("video_id").agg(F.min("language").alias("language"))
    _, source, base = text.caption_parts(F.col("language"))
    return v.select("video_id", source.alias("source"), base.alias("base"), text.caption_resolution(F.lit("ru"), F.col("language")).alias("resolution"))


@query(r"""
WITH a AS (SELECT channel_id, list_sort(list(DISTINCT language)) AS l FROM videos WHERE channel_id IS NOT NULL AND language IS NOT NULL AND language <> '' GROUP BY 1),
n AS (SELECT channel_id, l, list_transform(l, lambda c: replace(lower(trim(c)), '_', '-')) AS m FROM a),
i AS (SELECT channel_id, l, list_filter(range(1, len(l) + 1), lambda k: NOT (m[k] = 'asr' OR starts_with(m[k], 'asr-')) AND split_part(m[k], '-', 1) = 'ru') AS r1,
  list_filter(range(1, len(l) + 1), lambda k: (m[k] = 'asr' OR starts_with(m[k], 'asr-')) AND split_part(regexp_replace(m[k], '^asr-', ''), '-', 1) = 'ru') AS r2,
  list_filter(range(1, len(l) + 1), lambda k: NOT (m[k] = 'asr' OR starts_with(m[k], 'asr-')) AND split_part(m[k], '-', 1) = 'en') AS e1,
  list_filter(range(1, len(l) + 1), lambda k: (m[k] = 'asr' OR starts_with(m[k], 'asr-')) AND split_part(regexp_replace(m[k], '^asr-', ''), '-', 1) = 'en') AS e2,
  list_filter(range(1, len(l) + 1), lambda k: m[k] = 'asr' OR starts_with(m[k], 'asr-')) AS x FROM n)
SELECT channel_id, l[coalesce(r1[1], r2[1], e1[1], e2[1], x[1])] AS code FROM i
""")
def language_choice(spark: SparkSession, d: str) -> DataFrame:
    """The caption language of each channel that answers the wishes ru, en, asr best."""
    v = table(spark, d, "videos").where("channel_id IS NOT NULL AND language IS NOT NULL AND language != ''")
    a = v.groupBy("channel_id").agg(F.array_sort(F.collect_set("language")).alias("l"))  # a channel has few codes
    return a.select("channel_id", captionjson.select_language(F.col("l"), ["ru", "en", "asr"]).alias("code"))


@query("WITH " + CAPTIONS_SQL + """, p AS (SELECT *, lag(lower(text)) OVER (PARTITION BY video_id ORDER BY seg_idx) AS b FROM cap),
q AS (SELECT video_id, seg_idx, string_split(b, ' ') AS x, string_split(lower(text), ' ') AS y FROM p WHERE b IS NOT NULL)
SELECT video_id, seg_idx, CAST(coalesce(list_max(list_filter(range(1, least(len(x), len(y)) + 1), lambda n: x[len(x) - n + 1:] = y[:n])), 0) AS INT) AS words FROM q""")
def caption_edges(spark: SparkSession, d: str) -> DataFrame:
    """H: how many words of a caption say the end of the caption before again."""
    p = blocks.previous(clean_captions(spark, d).select("video_id", "seg_idx", "text"), ["video_id"], "seg_idx", F.col("text"), "before")
    return p.where("before IS NOT NULL").select("video_id", "seg_idx", text.shared_edge(F.col("before"), F.col("text")).alias("words"))


@query("WITH RECURSIVE " + CAPTIONS_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, seg_idx) AS k FROM cap),
r AS (SELECT video_id, k, seg_idx, start_ms, end_ms, text AS said, [{'t': text, 'e': end_ms}] AS kept, end_ms AS reach FROM o WHERE k = 1
  UNION ALL SELECT video_id, k, seg_idx, start_ms, end_ms, said, CASE WHEN said = '' THEN kept ELSE list_append(kept, {'t': said, 'e': end_ms}) END, CASE WHEN said = '' THEN reach ELSE end_ms END
  FROM (SELECT *, array_to_string(w[n + 1:], ' ') AS said
    FROM (SELECT *, CASE WHEN start_ms < reach THEN coalesce(list_max(list_filter(range(1, least(len(x), len(w)) + 1), lambda j: lower(array_to_string(x[len(x) - j + 1:], ' ')) = lower(array_to_string(w[:j], ' ')))), 0) ELSE 0 END AS n
      FROM (SELECT o.video_id, o.k, o.seg_idx, o.start_ms, o.end_ms, r.reach, list_filter(r.kept, lambda y: y.e > o.start_ms) AS kept, string_split(o.text, ' ') AS w,
          string_split(array_to_string(list_transform(list_filter(r.kept, lambda y: y.e > o.start_ms), lambda y: y.t), ' '), ' ') AS x
        FROM r JOIN o ON o.video_id = r.video_id AND o.k = r.k + 1))))
SELECT video_id, seg_idx, said AS text, start_ms, end_ms FROM r WHERE said <> ''""")
def overlap_caption_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Captions without what they repeat of the captions they overlap."""
    return captions.without_repeats(clean_captions(spark, d))


@query("WITH " + SEGMENTS_SQL + " SELECT video_id, seg_idx, sha256(text) AS fingerprint FROM seg")
def caption_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """H: SHA-256 of each segment's text."""
    return segments(spark, d).select("video_id", "seg_idx", F.sha2("text", 256).alias("fingerprint"))


@query("WITH " + SEGMENTS_SQL + r" SELECT video_id, seg_idx, text, start_ms, end_ms FROM seg WHERE regexp_matches(text, '[^\s\x{00A0}]')")
def parse_captions(spark: SparkSession, d: str) -> DataFrame:
    """Segments written as payloads of one caption, of either layout by language, and parsed again."""
    s = segments(spark, d)
    plain = F.struct(F.array(F.struct("text", (F.col("start_ms") / 1000).alias("start"), ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("duration"))).alias("transcript"), F.concat_ws("\u0001", "video_id", "seg_idx").alias("video_id"))
    timed = F.struct(
        F.array(F.struct(F.col("start_ms").alias("tStartMs"), (F.col("end_ms") - F.col("start_ms")).alias("dDurationMs"), F.array(F.struct(F.col("text").alias("utf8"))).alias("segs"))).alias("events"),
        F.concat_ws("\u0001", "video_id", "seg_idx").alias("video_id"),
    )
    bodies = s.select(F.when(F.length("text") % 2 == 0, F.to_json(plain)).otherwise(F.to_json(timed)).alias("body"))
    key = F.split("video_id", "\u0001")
    return captionjson.parse_captions(bodies, "body").select(key[0].alias("video_id"), key[1].cast("int").alias("seg_idx"), "text", "start_ms", "end_ms")


# -- joins on time -----------------------------------------------------------------------------


@query("WITH " + EVENTS_SQL + """ SELECT a.event_id AS id_a, b.event_id AS id_b FROM ev a JOIN ev b ON a.video_id = b.video_id AND a.category = b.category AND a.subtype = b.subtype
  AND a.event_id < b.event_id AND a.start_ms <= b.end_ms + 2000 AND a.end_ms >= b.start_ms - 2000""")
def overlap_pairs_2s(spark: SparkSession, d: str) -> DataFrame:
    """Events of one video, category and subtype that overlap within 2 s."""
    e = content_events(spark, d).select("video_id", "category", "subtype", "event_id", "start_ms", "end_ms")
    b = e.toDF("video_id", "category", "subtype", "id_b", "b_start", "b_end")
    j = rangejoin.overlap_join(e.withColumnRenamed("event_id", "id_a"), b, ["video_id", "category", "subtype"], "start_ms", "end_ms", "b_start", "b_end", pad=2_000)
    return j.where("id_a < id_b").select("id_a", "id_b")


GOLD_SQL = "gold AS (SELECT DISTINCT gold_id, video_id, start_ms, attention FROM compot_gold WHERE gold_id IS NOT NULL AND video_id IS NOT NULL AND start_ms IS NOT NULL)"
CONTROLS_SQL = "ctl AS (SELECT DISTINCT control_id, video_id, at_ms, mode FROM compot_recall_controls WHERE control_id IS NOT NULL AND video_id IS NOT NULL AND at_ms IS NOT NULL)"
SCENES_SQL = "sc AS (SELECT DISTINCT scan_id, video_id, scene_id, context_start_ms AS s, context_end_ms AS e FROM draft_scenes WHERE context_start_ms IS NOT NULL AND context_end_ms > context_start_ms AND video_id IS NOT NULL)"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "compot_gold").select("gold_id", "video_id", "start_ms", "attention").where("gold_id IS NOT NULL AND video_id IS NOT NULL AND start_ms IS NOT NULL").distinct()


def _controls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "compot_recall_controls").select("control_id", "video_id", "at_ms", "mode").where("control_id IS NOT NULL AND video_id IS NOT NULL AND at_ms IS NOT NULL").distinct()


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "draft_scenes").where("context_start_ms IS NOT NULL AND context_end_ms > context_start_ms AND video_id IS NOT NULL")
    return s.select("scan_id", "video_id", "scene_id", F.col("context_start_ms").alias("s"), F.col("context_end_ms").alias("e")).distinct()


@query("WITH " + SEGMENTS_SQL + ", " + GOLD_SQL + """ SELECT g.gold_id, s.seg_idx FROM gold g JOIN seg s ON s.video_id = g.video_id AND s.start_ms <= g.start_ms + 5000 AND s.end_ms >= g.start_ms""")
def covered_segments(spark: SparkSession, d: str) -> DataFrame:
    """The segments that the five seconds from each gold label on overlap."""
    g = _gold(spark, d).select("gold_id", "video_id", F.col("start_ms").alias("g_start"), (F.col("start_ms") + 5_000).alias("g_end"))
    s = segments(spark, d).select("video_id", "seg_idx", "start_ms", "end_ms")
    return rangejoin.overlap_join(g, s, ["video_id"], "g_start", "g_end", "start_ms", "end_ms").select("gold_id", "seg_idx")


@query("WITH " + SEGMENTS_SQL + ", " + GOLD_SQL + """, w AS (SELECT DISTINCT video_id, greatest(0, start_ms - 120000) AS s, start_ms + 180000 AS e FROM gold),
f AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM w),
n AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS p FROM f),
m AS (SELECT video_id, min(s) AS window_start, max(e) AS window_end FROM n GROUP BY video_id, p)
SELECT m.video_id, window_start, window_end, count(*) AS segments, min(seg_idx) AS first_seg, max(seg_idx) AS last_seg FROM m JOIN seg s ON s.video_id = m.video_id AND s.start_ms <= window_end AND s.end_ms >= window_start GROUP BY 1, 2, 3""")
def review_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of -120 s to +180 s around labels, merged, and the segments in them."""
    g = _gold(spark, d).select("video_id", F.greatest(F.lit(0), F.col("start_ms") - 120_000).alias("s"), (F.col("start_ms") + 180_000).alias("e"))
    w = periods.periods_and_gaps(g, ["video_id"], "s", "e").where("kind = 'period'").select("video_id", F.col("start_ms").alias("window_start"), F.col("end_ms").alias("window_end"))
    j = rangejoin.overlap_join(w, segments(spark, d).select("video_id", "seg_idx", "start_ms", "end_ms"), ["video_id"], "window_start", "window_end", "start_ms", "end_ms", bucket=300_000)
    return j.groupBy("video_id", "window_start", "window_end").agg(F.count("*").alias("segments"), F.min("seg_idx").alias("first_seg"), F.max("seg_idx").alias("last_seg"))


@query("WITH " + CONTROLS_SQL + ", " + SCENES_SQL + """ SELECT control_id, EXISTS (SELECT 1 FROM sc WHERE sc.video_id = ctl.video_id AND sc.e - sc.s <= 150000 AND ctl.at_ms >= sc.s - 20000 AND ctl.at_ms <= sc.e + 20000) AS represented FROM ctl""")
def control_in_scene(spark: SparkSession, d: str) -> DataFrame:
    """Whether a control's time lies within 20 s of a scene of at most 150 s."""
    c = _controls(spark, d)
    s = _scenes(spark, d).where("e - s <= 150000").select("video_id", "s", "e").distinct()
    hit = rangejoin.overlap_join(c.withColumn("at_end", F.col("at_ms")), s, ["video_id"], "at_ms", "at_end", "s", "e", pad=20_000).select("control_id").distinct()
    return c.select("control_id").join(hit.withColumn("represented", F.lit(True)), "control_id", "left").na.fill(False, ["represented"])


@query("WITH " + CONTROLS_SQL + ", " + GOLD_SQL + """, h AS (SELECT control_id, mode, bool_or(g.gold_id IS NOT NULL) AS label, bool_or(coalesce(g.attention = 'main', false)) AS main
  FROM ctl LEFT JOIN gold g ON g.video_id = ctl.video_id AND abs(g.start_ms - ctl.at_ms) <= 5000 GROUP BY 1, 2),
o AS (SELECT mode, CASE WHEN mode = 'required_main' THEN CASE WHEN main THEN 'pass' ELSE 'miss' END WHEN mode = 'required_event' THEN CASE WHEN label THEN 'pass' ELSE 'miss' END ELSE CASE WHEN main THEN 'miss' ELSE 'pass' END END AS outcome FROM h)
SELECT mode, count(*) AS controls, CAST(count_if(outcome = 'pass') AS BIGINT) AS passed, CAST(count_if(outcome = 'miss') AS BIGINT) AS missed FROM o GROUP BY 1""")
def control_recall(spark: SparkSession, d: str) -> DataFrame:
    """Controls by mode that have a label, or a main one, within 5 s."""
    g = _gold(spark, d).select("video_id", F.col("start_ms").alias("g_start"), F.col("start_ms").alias("g_end"), "attention")
    c = _controls(spark, d)
    hit = rangejoin.overlap_join(c.withColumn("at_end", F.col("at_ms")), g, ["video_id"], "at_ms", "at_end", "g_start", "g_end", pad=5_000)
    hit = hit.groupBy("control_id").agg(F.lit(True).alias("label"), F.max(F.coalesce(F.col("attention") == "main", F.lit(False))).alias("main"))
    h = c.join(hit, "control_id", "left").na.fill(False, ["label", "main"])
    ok = F.when(F.col("mode") == "required_main", F.col("main")).when(F.col("mode") == "required_event", F.col("label")).otherwise(~F.col("main"))
    return h.groupBy("mode").agg(F.count("*").alias("controls"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("missed"))


@query("WITH " + SCENES_SQL + """, st AS (SELECT DISTINCT scan_id, video_id, scene_id, s, e FROM sc)
SELECT a.scan_id, a.video_id, a.scene_id, a.s AS start_ms FROM st a WHERE NOT EXISTS (SELECT 1 FROM st b WHERE b.video_id = a.video_id AND b.scan_id <> a.scan_id AND a.s <= b.e + 3000 AND a.e >= b.s - 3000)""")
def vanished_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes beside which no other scan of the same video has any scene within 3 s, of whatever category
    (a looser test than that of ``vanished_events``)."""
    a = _scenes(spark, d)
    b = a.select(F.col("scan_id").alias("other"), "video_id", F.col("s").alias("s2"), F.col("e").alias("e2"))
    hit = rangejoin.overlap_join(a, b, ["video_id"], "s", "e", "s2", "e2", pad=3_000).where("scan_id != other").select("scan_id", "video_id", "scene_id", "s").distinct()
    return a.join(hit, ["scan_id", "video_id", "scene_id", "s"], "left_anti").select("scan_id", "video_id", "scene_id", F.col("s").alias("start_ms")).distinct()


CATEGORY_SCENES_SQL = "ct AS (SELECT DISTINCT scan_id, video_id, scene_id, context_start_ms AS s, context_end_ms AS e, coalesce(unnest(CASE WHEN len(categories) > 0 THEN categories ELSE [NULL] END), '') AS category FROM draft_scenes WHERE context_start_ms IS NOT NULL AND context_end_ms > context_start_ms AND video_id IS NOT NULL)"


@query("WITH " + CATEGORY_SCENES_SQL + """
SELECT DISTINCT a.scan_id, a.video_id, a.scene_id, a.category, a.s AS start_ms, a.e AS end_ms FROM ct a
WHERE NOT EXISTS (SELECT 1 FROM ct b WHERE b.video_id = a.video_id AND b.category = a.category AND b.scan_id <> a.scan_id AND a.s <= b.e + 3000 AND a.e >= b.s - 3000)""")
def vanished_events(spark: SparkSession, d: str) -> DataFrame:
    """A row for each category of a scene that no other scan of the same video has within 3 s in
    the SAME category. Scenes without a category count as of the category ''."""
    s = table(spark, d, "draft_scenes").where("context_start_ms IS NOT NULL AND context_end_ms > context_start_ms AND video_id IS NOT NULL")
    a = s.select("scan_id", "video_id", "scene_id", F.col("context_start_ms").alias("s"), F.col("context_end_ms").alias("e"), F.explode_outer("categories").alias("category"))
    a = a.withColumn("category", F.coalesce("category", F.lit(""))).distinct()
    b = a.select(F.col("scan_id").alias("other"), "video_id", "category", F.col("s").alias("s2"), F.col("e").alias("e2")).distinct()
    cols = ["scan_id", "video_id", "scene_id", "category", "s", "e"]
    hit = rangejoin.overlap_join(a, b, ["video_id", "category"], "s", "e", "s2", "e2", pad=3_000).where("scan_id != other").select(*(F.col(c).alias(f"h_{c}") for c in cols)).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in cols]
    return a.join(hit, same, "left_anti").select("scan_id", "video_id", "scene_id", "category", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))


@query("WITH " + SEGMENTS_SQL + ", " + GOLD_SQL + """, c AS (SELECT DISTINCT g.gold_id, g.video_id, s.seg_idx, s.start_ms, s.end_ms, s.text FROM gold g JOIN seg s ON s.video_id = g.video_id AND s.start_ms <= g.start_ms + 5000 AND s.end_ms >= g.start_ms),
i AS (SELECT *, seg_idx - row_number() OVER (PARTITION BY gold_id, video_id ORDER BY seg_idx) AS island FROM c)
SELECT gold_id, video_id, min(seg_idx) AS first_seg, max(seg_idx) AS last_seg, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY seg_idx) AS text FROM i GROUP BY gold_id, video_id, island""")
def evidence_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of each label as ranges of consecutive segments, with times and text."""
    c = covered_segments(spark, d).join(_gold(spark, d).select("gold_id", "video_id"), "gold_id").join(segments(spark, d), ["video_id", "seg_idx"]).distinct()
    i = c.withColumn("island", F.col("seg_idx") - F.row_number().over(Window.partitionBy("gold_id", "video_id").orderBy("seg_idx")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"]), " ")  # five seconds of speech
    return i.groupBy("gold_id", "video_id", "island").agg(
        F.min("seg_idx").alias("first_seg"), F.max("seg_idx").alias("last_seg"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), joined.alias("text")
    ).drop("island")


@query("WITH " + SEGMENTS_SQL + r""", a AS (SELECT DISTINCT id, source_video AS video_id, unnest(list_distinct(regexp_extract_all(lower(anchor), '[\p{L}\p{N}]+'))) AS w FROM parental_quality_manual WHERE id IS NOT NULL AND anchor IS NOT NULL),
n AS (SELECT id, count(*) AS n FROM a GROUP BY 1),
s AS (SELECT video_id, seg_idx, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS w FROM seg),
h AS (SELECT a.id, s.seg_idx, count(*) AS hits FROM a JOIN s USING (video_id, w) GROUP BY 1, 2),
r AS (SELECT id, seg_idx, CAST(hits AS BIGINT) AS hits, n, row_number() OVER (PARTITION BY id ORDER BY hits DESC, seg_idx) AS k FROM h JOIN n USING (id))
SELECT id, seg_idx, floor(hits * 1.0 / n * 10000 + 0.5) / 10000 AS containment FROM r WHERE k = 1""")
def anchor_containment(spark: SparkSession, d: str) -> DataFrame:
    """The segment of its video that holds most of an anchor's words, and their share."""
    best = anchors.best_segment(segment_rows(spark, d), _anchors(spark, d))
    return best.select("id", "seg_idx", numbers.round_half_up(F.col("hits") / F.col("n"), 4).alias("containment"))


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parental_quality_manual").where("id IS NOT NULL AND anchor IS NOT NULL").select("id", F.col("source_video").alias("video_id"), "anchor")


# -- choosing, merging, packing ----------------------------------------------------------------


@query("WITH " + EVENTS_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, category, subtype ORDER BY confidence DESC, event_id) AS k FROM ev)
SELECT scene_id, category, subtype, event_id, confidence, start_ms, end_ms FROM r WHERE k = 1""")
def dedupe_argmax(spark: SparkSession, d: str) -> DataFrame:
    """Of the events of a scene, category and subtype the one of the highest confidence."""
    e = content_events(spark, d).select("scene_id", "category", "subtype", "event_id", "confidence", "start_ms", "end_ms")
    return reports.strongest(e, ["scene_id", "category", "subtype"], "event_id")


@query("WITH RECURSIVE " + EVENTS_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY video_id, category, subtype ORDER BY start_ms, confidence DESC, event_id) AS k FROM ev),
r AS (SELECT video_id, category, subtype, k, [{'i': event_id, 's': start_ms, 'e': end_ms, 'c': confidence}] AS kept FROM o WHERE k = 1
  UNION ALL SELECT video_id, category, subtype, k, CASE WHEN f IS NULL THEN list_append(kept, x) WHEN x.c > kept[f].c THEN list_concat(list_append(kept[:f - 1], x), kept[f + 1:]) ELSE kept END
  FROM (SELECT o.video_id, o.category, o.subtype, o.k, r.kept, {'i': o.event_id, 's': o.start_ms, 'e': o.end_ms, 'c': o.confidence} AS x,
    list_min(list_filter(range(1, len(r.kept) + 1), lambda j: r.kept[j].s <= o.end_ms + 2000 AND r.kept[j].e >= o.start_ms - 2000)) AS f
    FROM r JOIN o ON o.video_id = r.video_id AND o.category = r.category AND o.subtype = r.subtype AND o.k = r.k + 1)),
z AS (SELECT video_id, category, subtype, unnest(arg_max(kept, k)) AS x FROM r GROUP BY 1, 2, 3)
SELECT video_id, category, subtype, x.i AS event_id, x.s AS start_ms, x.e AS end_ms, x.c AS confidence FROM z""")
def greedy_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Events kept in order, a later one within 2 s replacing a kept one of lower confidence."""
    return scenes.greedy_unique(content_events(spark, d), ["video_id", "category", "subtype"], "event_id")


@query("WITH RECURSIVE " + EVENTS_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY video_id, category ORDER BY start_ms, event_id) AS k FROM ev),
r AS (SELECT video_id, category, k, [{'i': event_id, 's': start_ms, 'e': end_ms}] AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.video_id, o.category, o.k, CASE WHEN len(list_filter(r.kept, lambda y: y.s <= o.end_ms + 2000 AND y.e >= o.start_ms - 2000)) > 0 THEN r.kept ELSE list_append(r.kept, {'i': o.event_id, 's': o.start_ms, 'e': o.end_ms}) END
  FROM r JOIN o ON o.video_id = r.video_id AND o.category IS NOT DISTINCT FROM r.category AND o.k = r.k + 1),
z AS (SELECT video_id, category, unnest(arg_max(kept, k)) AS x FROM r GROUP BY 1, 2)
SELECT video_id, category, x.i AS event_id, x.s AS start_ms, x.e AS end_ms FROM z""")
def rejected_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Of events of one video and category, whatever their subtype and confidence, the first is kept
    and every later one within 2 s of a kept one is dropped."""
    return scenes.keep_first(content_events(spark, d), ["video_id", "category"], "event_id")


@query("""WITH RECURSIVE d AS (SELECT scan_id, video_id, scene_id, context_start_ms AS s, context_end_ms AS e, min(coalesce(categories, [])) AS c FROM draft_scenes
  WHERE context_start_ms IS NOT NULL AND context_end_ms >= context_start_ms AND scan_id IS NOT NULL AND video_id IS NOT NULL AND scene_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
o AS (SELECT *, row_number() OVER (PARTITION BY scan_id, video_id ORDER BY s, scene_id) AS k FROM d),
r AS (SELECT scan_id, video_id, k, [{'i': scene_id, 's': s, 'e': e, 'c': c, 'n': 1}] AS kept FROM o WHERE k = 1
  UNION ALL SELECT scan_id, video_id, k, CASE WHEN f IS NULL THEN list_append(kept, x) ELSE list_concat(list_append(kept[:f - 1], {'i': kept[f].i || '+' || x.i, 's': least(kept[f].s, x.s), 'e': greatest(kept[f].e, x.e), 'c': list_concat(kept[f].c, x.c), 'n': kept[f].n + 1}), kept[f + 1:]) END
  FROM (SELECT o.scan_id, o.video_id, o.k, r.kept, {'i': o.scene_id, 's': o.s, 'e': o.e, 'c': o.c, 'n': 1} AS x,
    list_min(list_filter(range(1, len(r.kept) + 1), lambda j: (list_has_any(r.kept[j].c, o.c) OR (list_has_any(r.kept[j].c, ['violence', 'scary_and_disturbing']) AND list_has_any(o.c, ['violence', 'scary_and_disturbing'])))
      AND greatest(0, least(r.kept[j].e, o.e) - greatest(r.kept[j].s, o.s)) * 1.0 / least(greatest(1, r.kept[j].e - r.kept[j].s), greatest(1, o.e - o.s)) >= 0.4)) AS f
    FROM r JOIN o ON o.scan_id = r.scan_id AND o.video_id = r.video_id AND o.k = r.k + 1)),
z AS (SELECT scan_id, video_id, unnest(arg_max(kept, k)) AS x FROM r GROUP BY 1, 2)
SELECT scan_id, video_id, x.i AS scene_id, x.s AS start_ms, x.e AS end_ms, x.n AS scenes FROM z""")
def merge_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes joined where they overlap by 0.4 and share a category."""
    return scenes.merged_scenes(table(spark, d, "draft_scenes"))


@query("WITH RECURSIVE " + GOLD_SQL + ", " + SCENES_SQL + """, w AS (SELECT scan_id, video_id, scene_id, s, s - 5000 AS lo, e AS hi FROM sc),
f AS (SELECT *, max(hi) OVER (PARTITION BY scan_id, video_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM w),
n AS (SELECT *, max(CASE WHEN r IS NULL OR lo > r THEN lo END) OVER (PARTITION BY scan_id, video_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS stretch FROM f),
p AS (SELECT n.scan_id, n.video_id, n.stretch, g.start_ms, g.gold_id, list({'hi': n.hi, 'id': n.scene_id} ORDER BY n.hi, n.scene_id) AS options FROM n JOIN gold g ON g.video_id = n.video_id AND g.start_ms BETWEEN n.lo AND n.hi GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY scan_id, video_id, stretch ORDER BY start_ms, gold_id) AS k FROM p),
r AS (SELECT scan_id, video_id, stretch, k, [options[1].id] AS used FROM o WHERE k = 1
  UNION ALL SELECT scan_id, video_id, stretch, k, CASE WHEN len(free) = 0 THEN used ELSE list_append(used, free[1].id) END
  FROM (SELECT o.scan_id, o.video_id, o.stretch, o.k, r.used, list_filter(o.options, lambda y: NOT list_contains(r.used, y.id)) AS free
    FROM r JOIN o ON o.scan_id IS NOT DISTINCT FROM r.scan_id AND o.video_id = r.video_id AND o.stretch = r.stretch AND o.k = r.k + 1))
SELECT scan_id, video_id, stretch, CAST(max(len(used)) AS INT) AS matched FROM r GROUP BY 1, 2, 3""")
def max_matching(spark: SparkSession, d: str) -> DataFrame:
    """The greatest number of pairs of scenes and labels that overlap, per scan and merged stretch. In
    SQL: labels are points and scenes intervals here, so giving each label, in order, the free scene that
    ends first is best; the operator needs no such order."""
    g = _gold(spark, d).select("video_id", "gold_id", F.col("start_ms").alias("g_start"), (F.col("start_ms") + 5_000).alias("g_end"))
    s = _scenes(spark, d)
    stretch = periods.periods_and_gaps(s.select("scan_id", "video_id", (F.col("s") - 5_000).alias("s"), "e"), ["scan_id", "video_id"], "s", "e").where("kind = 'period'")
    stretch = stretch.select("scan_id", "video_id", F.col("start_ms").alias("stretch"), F.col("end_ms").alias("stretch_end"))
    pairs = rangejoin.overlap_join(s, g, ["video_id"], "s", "e", "g_start", "g_end")
    inside = rangejoin.overlap_join(pairs.withColumn("at", F.col("s")), stretch, ["scan_id", "video_id"], "s", "at", "stretch", "stretch_end")
    return scenes.matching(inside, ["scan_id", "video_id", "stretch"], "scene_id", "gold_id")


ITEMS_SQL = "it AS (SELECT DISTINCT item_id, job_id, coalesce(estimated_tokens, 0) AS n FROM transcript_chunks WHERE item_id IS NOT NULL AND job_id IS NOT NULL)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transcript_chunks").where("item_id IS NOT NULL AND job_id IS NOT NULL")
    return t.select("item_id", "job_id", F.coalesce("estimated_tokens", F.lit(0)).alias("n")).distinct()


@query("WITH RECURSIVE " + ITEMS_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY item_id) AS k FROM it),
b AS (SELECT job_id, item_id, k, n AS s, 1 AS c, 0 AS batch FROM o WHERE k = 1
  UNION ALL SELECT o.job_id, o.item_id, o.k, CASE WHEN b.s + o.n > 70000 OR b.c >= 5 THEN o.n ELSE b.s + o.n END, CASE WHEN b.s + o.n > 70000 OR b.c >= 5 THEN 1 ELSE b.c + 1 END,
  CASE WHEN b.s + o.n > 70000 OR b.c >= 5 THEN b.batch + 1 ELSE b.batch END FROM b JOIN o ON o.job_id = b.job_id AND o.k = b.k + 1)
SELECT job_id, item_id, batch FROM b""")
def pack_batches(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each job in batches of at most 70,000 tokens and five items, in order."""
    return captions.batches(_items(spark, d), "job_id", "item_id", "n", 70_000, 5)


@query("WITH RECURSIVE " + CAPTIONS_SQL + """, num AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) - 1 AS pos FROM cap),
l AS (SELECT video_id, pos, end_ms, strlen(text) + strlen(CAST(pos AS VARCHAR)) + 4 AS size FROM num),
a AS (SELECT video_id, count(*) AS n, list(c ORDER BY pos) AS p, list(b ORDER BY pos) AS q, list(end_ms ORDER BY pos) AS e FROM
  (SELECT video_id, pos, end_ms, sum(greatest(1, ceil(size / 3.0))) OVER w AS c, sum(size) OVER w AS b FROM l WINDOW w AS (PARTITION BY video_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) GROUP BY 1),
r AS (SELECT video_id, 0 AS chunk, CAST(0 AS BIGINT) AS first, n, p, q, e, greatest(1, coalesce(list_max(list_filter(range(1, n + 1), lambda j: p[j] <= 30000)), 1)) AS till FROM a
  UNION ALL SELECT video_id, chunk, first, n, p, q, e, greatest(first + 1, coalesce(list_max(list_filter(range(first + 1, n + 1), lambda j: p[j] - CASE WHEN first > 0 THEN p[first] ELSE 0 END <= 30000)), first + 1)) AS till
  FROM (SELECT video_id, chunk + 1 AS chunk, n, p, q, e, coalesce(list_min(list_filter(range(first + 1, till), lambda j: e[j + 1] >= greatest(0, e[till] - 90000))), till) AS first FROM r WHERE till < n))
SELECT video_id, chunk, CAST(first AS INT) AS first, CAST(till - 1 AS INT) AS last, CAST(greatest(1, ceil((q[till] - CASE WHEN first > 0 THEN q[first] ELSE 0 END - 1) / 3.0)) AS BIGINT) AS tokens FROM r""")
def chunk_transcript(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts in chunks of at most 30,000 estimated tokens that overlap by 90 s."""
    return captions.chunks(clean_captions(spark, d))


APPORTION_SQL = """WITH o AS (SELECT l_orderkey, l_linenumber, greatest(1, CAST(l_quantity AS BIGINT)) AS w, greatest(0, CAST(floor(o_totalprice) AS BIGINT)) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT *, sum(w) OVER (PARTITION BY l_orderkey) AS s, count(*) OVER (PARTITION BY l_orderkey) AS n FROM o),
f AS (SELECT *, CAST((t * w) // s AS BIGINT) AS f, CAST((t * w) % s AS BIGINT) AS m FROM g),
p AS (SELECT *, t - sum(f) OVER (PARTITION BY l_orderkey) AS rest, row_number() OVER (PARTITION BY l_orderkey ORDER BY m DESC, l_linenumber, w) - 1 AS p FROM f)
SELECT l_orderkey, l_linenumber, CAST(f + CASE WHEN (p - {0} + n) % n < rest THEN 1 ELSE 0 END AS BIGINT) AS share FROM p"""


def _order_lines(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.floor("o_totalprice").cast("bigint").alias("total"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(o, "l_orderkey")


@query(APPORTION_SQL.format("0"))
def apportion_largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    """An order's whole total over its lines by quantity, without rest."""
    return reports.apportioned(_order_lines(spark, d), "l_orderkey", "l_linenumber", "total", "l_quantity")


@query(APPORTION_SQL.format("CAST((t - rest) % n AS BIGINT)"))
def apportion_offset(spark: SparkSession, d: str) -> DataFrame:
    """A14, the second variant: the rest is given out from an offset on."""
    return reports.apportioned(_order_lines(spark, d), "l_orderkey", "l_linenumber", "total", "l_quantity", offset=True)


# -- reports -----------------------------------------------------------------------------------


@query("WITH " + EVENTS_SQL + """, r AS (SELECT *, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS k FROM ev),
""" + CATEGORIES_SQL + """, v AS (SELECT DISTINCT video_id FROM ev),
a AS (SELECT video_id, category, count(*) AS events, CAST(count_if(k >= 2) AS BIGINT) AS shown, max(k) AS level, array_to_string(list_sort(list(DISTINCT subtype)), ',') AS subtypes FROM r GROUP BY 1, 2)
SELECT v.video_id, c.category, coalesce(events, 0) AS events, coalesce(shown, 0) AS shown, coalesce(level, 0) AS level, coalesce(subtypes, '') AS subtypes FROM v CROSS JOIN cats c LEFT JOIN a ON a.video_id = v.video_id AND a.category = c.category""")
def video_category_report(spark: SparkSession, d: str) -> DataFrame:
    """Events per video and category, with zero rows."""
    return reports.video_categories(content_events(spark, d), CATEGORIES)


@query("WITH " + EVENTS_SQL + """, """ + CATEGORIES_SQL + """, p AS (SELECT category, video_id, count(*) AS n, max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS k FROM ev GROUP BY 1, 2),
b AS (SELECT category, count(*) AS raw_videos, CAST(count_if(k >= 2) AS BIGINT) AS videos, CAST(count_if(k = 3) AS BIGINT) AS high_videos, CAST(sum(n) AS BIGINT) AS events, max(k) AS peak FROM p GROUP BY 1),
z AS (SELECT c.category, coalesce(raw_videos, 0) AS raw_videos, coalesce(videos, 0) AS videos, coalesce(high_videos, 0) AS high_videos, coalesce(events, 0) AS events, coalesce(peak, 0) AS peak, (SELECT count(DISTINCT video_id) FROM ev) AS t FROM cats c LEFT JOIN b USING (category))
SELECT category, raw_videos, videos, high_videos, events, peak, CASE WHEN videos = 0 OR t = 0 THEN 'none' WHEN videos * 1.0 / t <= 0.2 THEN 'rare' WHEN videos * 1.0 / t <= 0.5 THEN 'occasional' WHEN videos * 1.0 / t <= 0.8 THEN 'common' ELSE 'pervasive' END AS band FROM z""")
def channel_category_report(spark: SparkSession, d: str) -> DataFrame:
    """Videos and events per category over all videos, with zero rows, and how widespread it is."""
    return reports.channel_categories(content_events(spark, d), CATEGORIES)


@query("WITH " + EVENTS_SQL + """, b AS (SELECT category, subtype, count(*) AS events, count(DISTINCT video_id) AS videos FROM ev GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY events DESC, subtype) AS INT) AS place FROM b""")
def subtype_stats(spark: SparkSession, d: str) -> DataFrame:
    """Events and videos per subtype, in order."""
    return reports.subtype_stats(content_events(spark, d))


@query("""WITH t AS (SELECT DISTINCT scan_id, stage, start_ms, end_ms FROM timing_intervals WHERE end_ms >= start_ms)
SELECT stage, count(*) AS calls, CAST(sum(end_ms - start_ms) AS BIGINT) AS busy_ms, max(end_ms - start_ms) AS longest_ms, arg_max(scan_id, (end_ms - start_ms, scan_id)) AS slowest_scan FROM t GROUP BY 1""")
def stage_usage(spark: SparkSession, d: str) -> DataFrame:
    """Calls and time per stage, and the scan with the longest call."""
    t = table(spark, d, "timing_intervals").where("end_ms >= start_ms").select("scan_id", "stage", (F.col("end_ms") - F.col("start_ms")).alias("n"), "start_ms").distinct()
    return t.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("n").alias("busy_ms"), F.max("n").alias("longest_ms"), F.max_by("scan_id", F.struct("n", "scan_id")).alias("slowest_scan"))


@query("""WITH t AS (SELECT DISTINCT scan_id, stage, start_ms, end_ms FROM timing_intervals WHERE end_ms >= start_ms)
SELECT scan_id, stage, start_ms, end_ms, CAST(sum(end_ms - start_ms) OVER w AS BIGINT) AS busy_ms, count(*) OVER w AS calls FROM t WINDOW w AS (PARTITION BY scan_id, stage ORDER BY start_ms RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW)""")
def rolling_minute(spark: SparkSession, d: str) -> DataFrame:
    """Calls and their time in the minute before each call, per scan and stage."""
    t = table(spark, d, "timing_intervals").where("end_ms >= start_ms").select("scan_id", "stage", "start_ms", "end_ms").distinct()
    # a call also stands in the next minute's block, as a guest, so that no window crosses a block's border
    b = F.floor(F.col("start_ms") / 60_000)
    t = t.select("*", F.posexplode(F.array(b, b + 1)).alias("guest", "_b"))
    w = Window.partitionBy("scan_id", "stage", "_b").orderBy("start_ms").rangeBetween(-60_000, 0)
    t = t.select("*", F.sum(F.col("end_ms") - F.col("start_ms")).over(w).alias("busy_ms"), F.count("*").over(w).alias("calls"))
    return t.where("guest = 0").drop("guest", "_b")


@query("WITH " + CAPTIONS_SQL + r""", f AS (SELECT video_id, seg_idx, lower(string_agg(text, ' ') OVER (PARTITION BY video_id ORDER BY seg_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS t FROM cap),
c AS (SELECT video_id, seg_idx, regexp_matches(t, 'hammer|молот|hammer|marteau|martillo') AS tool, regexp_matches(t, 'drops|роняет|lässt|lâche|упускає|deja caer') AS act, regexp_matches(t, 'dragon|дракон|drachen|dragón') AS alarm FROM f)
SELECT video_id, seg_idx, CAST(2 + CASE WHEN alarm THEN 3 ELSE 0 END AS INT) AS score FROM c WHERE tool AND act""")
def cue_frames(spark: SparkSession, d: str) -> DataFrame:
    """Captions whose surroundings (two before, two after) name a tool and its fall, scored higher
    with an alarm."""
    return _cues(spark, d).select("video_id", "seg_idx", "score")


def _cues(spark: SparkSession, d: str) -> DataFrame:
    """(video_id, seg_idx, pos, at_ms, score, start_ms, end_ms): the captions with a cue, and the excerpt of
    nine captions before to thirteen after each. Words are looked for where the captions are read; what is
    shuffled are flags and times, in blocks of a video whose borders are shared."""
    c = clean_captions(spark, d)
    t = F.lower("text")
    has = {"tool": "hammer|молот|hammer|marteau|martillo", "act": "drops|роняет|lässt|lâche|упускає|deja caer", "alarm": "dragon|дракон|drachen|dragón", "opens": "^caer", "ends": "deja$"}
    flags = c.select("video_id", "seg_idx", "start_ms", "end_ms", *(t.rlike(p).alias(f) for f, p in has.items()))
    rows = blocks.with_margins(_numbered(flags), "pos", 13)
    w = Window.partitionBy("video_id", "_b").orderBy("pos")
    rows = rows.withColumn("pair", F.col("opens") & F.coalesce(F.lag("ends").over(w), F.lit(False)))  # the two words in two captions
    near = lambda f, lo=-2: F.max(f).over(w.rowsBetween(lo, 2))
    frame = w.rowsBetween(-9, 13)
    rows = rows.select(
        "video_id", "seg_idx", "pos", "_own", F.col("start_ms").alias("at_ms"), (near("tool") & (near("act") | near("pair", -1))).alias("cue"), (F.lit(2) + near("alarm").cast("int") * 3).alias("score"),
        F.first("start_ms").over(frame).alias("start_ms"), F.last("end_ms").over(frame).alias("end_ms"),
    )
    return rows.where("_own AND cue").drop("_own", "cue")


def _numbered(c: DataFrame) -> DataFrame:
    """Adds ``pos``, the place of a caption in its video."""
    return blocks.numbered(c, ["video_id"], blocks.block_of("seg_idx"), ["seg_idx"])


@query("WITH " + EVENTS_SQL + """, r AS (SELECT video_id, event_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, event_id DESC) AS INT) AS place FROM ev) SELECT * FROM r WHERE place <= 5""")
def top_events(spark: SparkSession, d: str) -> DataFrame:
    """The five events of the highest confidence in each video, later ones first among equals."""
    w = Window.partitionBy("video_id").orderBy(F.desc("confidence"), F.desc("event_id"))
    return content_events(spark, d).select("video_id", "event_id", F.row_number().over(w).alias("place")).where("place <= 5")


@query("""WITH r AS (SELECT video_id, scene_id, scan_id, row_number() OVER (PARTITION BY video_id, scene_id ORDER BY scan_id DESC) AS k FROM (SELECT DISTINCT video_id, scene_id, scan_id FROM draft_scenes WHERE video_id IS NOT NULL AND scene_id IS NOT NULL AND scan_id IS NOT NULL))
SELECT video_id, scene_id, scan_id FROM r WHERE k = 1""")
def newest_scan(spark: SparkSession, d: str) -> DataFrame:
    """Of each scene id the newest scan."""
    s = table(spark, d, "draft_scenes").where("video_id IS NOT NULL AND scene_id IS NOT NULL AND scan_id IS NOT NULL")
    return s.groupBy("video_id", "scene_id").agg(F.max("scan_id").alias("scan_id"))


@query("WITH " + GOLD_SQL + " SELECT video_id, CAST(count_if(attention = 'main') AS BIGINT) AS main, CAST(count_if(attention = 'details') AS BIGINT) AS details, CAST(count_if(attention = 'hidden') AS BIGINT) AS hidden FROM gold GROUP BY 1")
def attention_pivot(spark: SparkSession, d: str) -> DataFrame:
    """A26, and of A23 the counts alone: labels of each video by attention."""
    p = _gold(spark, d).groupBy("video_id").pivot("attention", ["main", "details", "hidden"]).agg(F.count(F.lit(1)))
    return p.na.fill(0)


@query("WITH " + GOLD_SQL + """, v AS (SELECT DISTINCT video_id FROM videos WHERE video_id IS NOT NULL), n AS (SELECT video_id, count(*) AS labels FROM gold GROUP BY 1)
SELECT coalesce(v.video_id, n.video_id) AS video_id, coalesce(labels, 0) AS labels, CASE WHEN v.video_id IS NULL THEN 'unknown' WHEN n.video_id IS NULL THEN 'missing' ELSE 'matched' END AS status FROM v FULL JOIN n ON v.video_id = n.video_id""")
def label_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Videos and labels that match, and those that lack the other."""
    v = table(spark, d, "videos").where("video_id IS NOT NULL").select("video_id").distinct().withColumn("v", F.lit(1))
    n = _gold(spark, d).groupBy("video_id").agg(F.count("*").alias("labels"))
    j = v.join(n, "video_id", "full")
    status = F.when(F.col("v").isNull(), "unknown").when(F.col("labels").isNull(), "missing").otherwise("matched")
    return j.select("video_id", F.coalesce("labels", F.lit(0)).alias("labels"), status.alias("status"))


@query("""WITH s AS (SELECT DISTINCT scan_id, video_id, unnest(categories) AS c FROM draft_scenes WHERE scan_id IS NOT NULL AND video_id IS NOT NULL),
f AS (SELECT video_id, min(scan_id) AS first FROM s GROUP BY 1),
n AS (SELECT video_id, scan_id, count(*) AS n FROM s GROUP BY 1, 2),
b AS (SELECT x.video_id, x.scan_id, count(*) AS shared FROM s x JOIN f USING (video_id) JOIN s y ON y.video_id = x.video_id AND y.scan_id = f.first AND y.c = x.c GROUP BY 1, 2)
SELECT n.video_id, n.scan_id, floor(coalesce(shared, 0) * 1.0 / (n.n + m.n - coalesce(shared, 0)) * 10000 + 0.5) / 10000 AS jaccard
FROM n JOIN f USING (video_id) JOIN n m ON m.video_id = n.video_id AND m.scan_id = f.first LEFT JOIN b ON b.video_id = n.video_id AND b.scan_id = n.scan_id WHERE n.scan_id <> f.first""")
def scan_stability(spark: SparkSession, d: str) -> DataFrame:
    """U6, U7, and of A20 the likeness alone: how alike the categories of a video are in a later scan and in its first."""
    s = table(spark, d, "draft_scenes").where("scan_id IS NOT NULL AND video_id IS NOT NULL")
    sets = s.select("video_id", "scan_id", F.explode("categories").alias("c")).groupBy("video_id", "scan_id").agg(F.collect_set("c").alias("c"))  # nine categories at most
    first = sets.groupBy("video_id").agg(F.min_by(F.struct(F.col("scan_id").alias("scan"), F.col("c").alias("c")), "scan_id").alias("f"))
    j = sets.join(first, "video_id").where("scan_id != f.scan")
    return j.select("video_id", "scan_id", numbers.round_half_up(F.size(F.array_intersect("c", "f.c")) / F.size(F.array_union("c", "f.c")), 4).alias("jaccard"))


@query("""WITH t AS (SELECT DISTINCT source_video AS v FROM parental_quality_manual WHERE lower(trim(split)) = 'tuning' AND source_video IS NOT NULL),
h AS (SELECT DISTINCT source_video AS v FROM parental_quality_manual WHERE lower(trim(split)) = 'holdout' AND source_video IS NOT NULL)
SELECT 'both' AS part, v AS video_id FROM (SELECT v FROM t INTERSECT SELECT v FROM h) UNION ALL SELECT 'holdout_only', v FROM (SELECT v FROM h EXCEPT SELECT v FROM t) UNION ALL SELECT 'tuning_only', v FROM (SELECT v FROM t EXCEPT SELECT v FROM h)""")
def split_sets(spark: SparkSession, d: str) -> DataFrame:
    """Videos of both splits, and of one alone."""
    p = table(spark, d, "parental_quality_manual").where("source_video IS NOT NULL")
    of = lambda name: p.where(F.lower(F.trim("split")) == name).select(F.col("source_video").alias("video_id"))
    t, h = of("tuning"), of("holdout")
    part = lambda df, name: df.select(F.lit(name).alias("part"), "video_id")
    return part(t.intersect(h), "both").unionByName(part(h.subtract(t), "holdout_only")).unionByName(part(t.subtract(h), "tuning_only"))


@query("WITH " + CONTROLS_SQL + ", " + GOLD_SQL + """, m AS (SELECT c.control_id, c.mode, count(g.gold_id) > 0 AS hit FROM ctl c LEFT JOIN gold g ON g.video_id = c.video_id AND abs(g.start_ms - c.at_ms) <= 5000 AND g.attention <> 'hidden' GROUP BY 1, 2),
q AS (SELECT CAST(count_if(hit AND mode <> 'no_main') AS BIGINT) AS tp, CAST(count_if(hit AND mode = 'no_main') AS BIGINT) AS fp, CAST(count_if(NOT hit AND mode <> 'no_main') AS BIGINT) AS fn, CAST(count_if(NOT hit AND mode = 'no_main') AS BIGINT) AS tn FROM m)
SELECT *, floor(CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) END * 10000 + 0.5) / 10000 AS precision, floor(CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) END * 10000 + 0.5) / 10000 AS recall FROM q""")
def control_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counts, precision and recall of visible labels against the controls."""
    g = _gold(spark, d).where("attention != 'hidden'").select("video_id", F.col("start_ms").alias("g_start"), F.col("start_ms").alias("g_end"))
    c = _controls(spark, d)
    hit = rangejoin.overlap_join(c.withColumn("at_end", F.col("at_ms")), g, ["video_id"], "at_ms", "at_end", "g_start", "g_end", pad=5_000).select("control_id").distinct()
    m = c.join(hit.withColumn("hit", F.lit(True)), "control_id", "left").na.fill(False, ["hit"])
    want, got = F.col("mode") != "no_main", F.col("hit")
    q = m.agg(F.count_if(got & want).alias("tp"), F.count_if(got & ~want).alias("fp"), F.count_if(~got & want).alias("fn"), F.count_if(~got & ~want).alias("tn"))
    ratio = lambda a, b: numbers.round_half_up(F.try_divide(a, a + b), 4)
    return q.withColumns({"precision": ratio(F.col("tp"), F.col("fp")), "recall": ratio(F.col("tp"), F.col("fn"))})


@query("""WITH o AS (SELECT id, list_distinct(list_transform(categories, lambda c: CASE WHEN c IN ('alcohol_and_drugs', 'tobacco_and_nicotine') THEN 'substances' ELSE c END)) AS c FROM (SELECT DISTINCT id, categories FROM parental_quality_manual WHERE id IS NOT NULL AND categories IS NOT NULL))
SELECT id, c AS category, CAST(pos AS INT) AS pos FROM (SELECT id, unnest(list_sort(c)) AS c, generate_subscripts(c, 1) AS pos FROM o)""")
def requested_categories(spark: SparkSession, d: str) -> DataFrame:
    """P5, U4: categories of each case, old names mapped, once each, in order of name."""
    p = table(spark, d, "parental_quality_manual").where("id IS NOT NULL AND categories IS NOT NULL").select("id", "categories").distinct()
    named = F.array_sort(F.array_distinct(F.transform("categories", lambda c: F.when(c.isin("alcohol_and_drugs", "tobacco_and_nicotine"), "substances").otherwise(c))))
    return p.select("id", F.posexplode(named).alias("p", "category")).select("id", "category", (F.col("p") + 1).alias("pos"))


@query("WITH " + GOLD_SQL + """, v AS (SELECT video_id, min(channel_id) AS channel_id FROM videos WHERE video_id IS NOT NULL GROUP BY 1)
SELECT channel_id, CAST(n AS BIGINT) AS n, CAST(n AS VARCHAR) || ' ' || CASE WHEN n % 100 BETWEEN 11 AND 14 THEN 'сцен' WHEN n % 10 = 1 THEN 'сцена' WHEN n % 10 BETWEEN 2 AND 4 THEN 'сцены' ELSE 'сцен' END AS summary FROM (SELECT channel_id, count_if(attention = 'main') AS n FROM gold JOIN v USING (video_id) GROUP BY 1)""")
def channel_summary_text(spark: SparkSession, d: str) -> DataFrame:
    """The number of main labels of each channel, as text with its plural form."""
    j = _gold(spark, d).join(_channel(spark, d), "video_id").groupBy("channel_id").agg(F.count_if(F.col("attention") == "main").alias("n"))
    return j.select("channel_id", "n", F.concat_ws(" ", F.col("n").cast("string"), numbers.count_form(F.col("n"), "сцена", "сцены", "сцен")).alias("summary"))


@query("WITH " + SEGMENTS_SQL + " SELECT video_id, seg_idx, start_ms, end_ms FROM seg")
def minimal_result_masked(spark: SparkSession, d: str) -> DataFrame:
    """Segments as structs, without the text that a minimal result must not hold."""
    s = segments(spark, d).select("video_id", "seg_idx", F.array(F.struct("text", "start_ms", "end_ms")).alias("evidence"))
    return captionjson.without(s, ("text",)).select("video_id", "seg_idx", F.col("evidence")[0]["start_ms"].alias("start_ms"), F.col("evidence")[0]["end_ms"].alias("end_ms"))


@query("""WITH m AS (SELECT item_id, min(job_id) AS job_id, min(created_at) AS made FROM transcript_chunks WHERE item_id IS NOT NULL GROUP BY 1),
v AS (SELECT job_id, min(made) AS first_at, count(*) AS items FROM m GROUP BY 1) SELECT job_id, items, epoch_us(first_at) AS first_us, CAST(rank() OVER (ORDER BY items DESC) AS INT) AS place FROM v QUALIFY place <= 20""")
def largest_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The twenty jobs with the most distinct items, and when they began."""
    m = table(spark, d, "transcript_chunks").where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("job_id").alias("job_id"), F.min("created_at").alias("made"))
    v = m.groupBy("job_id").agg(F.min("made").alias("first_at"), F.count("*").alias("items"))
    # jobs that share the twentieth count have its place too: the counts are few, their jobs are not ranked in one task
    sizes = v.groupBy("items").agg(F.count("*").alias("jobs")).orderBy(F.desc("items")).limit(20)
    before = F.coalesce(F.sum("jobs").over(Window.orderBy(F.desc("items")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sizes.withColumn("place", (before + 1).cast("int")).where("place <= 20").select("items", "place")
    return v.join(F.broadcast(places), "items").select("job_id", "items", F.unix_micros(F.col("first_at").cast("timestamp")).alias("first_us"), "place")


ANCHOR_SQL = SEGMENTS_SQL + r""", num AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) - 1 AS pos FROM seg),
a AS (SELECT DISTINCT id, source_video AS video_id, unnest(list_distinct(regexp_extract_all(lower(anchor), '[\p{L}\p{N}]+'))) AS w FROM parental_quality_manual WHERE id IS NOT NULL AND anchor IS NOT NULL),
n AS (SELECT id, count(*) AS n FROM a GROUP BY 1),
s AS (SELECT video_id, pos, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS w FROM num),
h AS (SELECT a.id, s.pos, a.w FROM a JOIN s USING (video_id, w))"""


@query("WITH " + ANCHOR_SQL + """, st AS (SELECT DISTINCT id, pos FROM h), k AS (SELECT unnest(range(1, 7)) AS span),
c AS (SELECT st.id, st.pos AS first, k.span, count(DISTINCT h.w) AS hits FROM st CROSS JOIN k JOIN h ON h.id = st.id AND h.pos BETWEEN st.pos AND st.pos + k.span - 1 GROUP BY 1, 2, 3),
r AS (SELECT c.*, n.n, row_number() OVER (PARTITION BY c.id ORDER BY hits DESC, span, first) AS place FROM c JOIN n USING (id))
SELECT id, CAST(first AS BIGINT) AS first, CAST(span AS INT) AS span, floor(hits * 1.0 / n * 10000 + 0.5) / 10000 AS score FROM r WHERE place = 1 AND hits * 1.0 / n >= 0.6""")
def anchor_spans(spark: SparkSession, d: str) -> DataFrame:
    """The stretch of one to six captions that holds most of an anchor's words, the shortest, then
    the first one, if it holds six tenths. Only captions that share a word are looked at."""
    best = anchors.best_stretch(segment_rows(spark, d), _anchors(spark, d), 0.6)
    return best.select("id", F.col("first").cast("bigint").alias("first"), "span", numbers.round_half_up(F.col("hits") / F.col("n"), 4).alias("score"))


@query("WITH " + SEGMENTS_SQL + ", " + GOLD_SQL + """, num AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) - 1 AS pos FROM seg),
k AS (SELECT DISTINCT s.video_id, s.pos FROM gold g JOIN num s ON s.video_id = g.video_id AND s.start_ms <= g.start_ms + 180000 AND s.end_ms >= greatest(0, g.start_ms - 120000)),
l AS (SELECT *, lag(pos) OVER (PARTITION BY video_id ORDER BY pos) AS p FROM k)
SELECT video_id, pos AS after_gap, pos - p - 1 AS missing FROM l WHERE pos > p + 1""")
def review_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Where captions are missing between the ones that review windows show, and how many."""
    g = _gold(spark, d).select("video_id", F.greatest(F.lit(0), F.col("start_ms") - 120_000).alias("w_start"), (F.col("start_ms") + 180_000).alias("w_end")).distinct()
    s = _numbered(segments(spark, d).drop("text")).select("video_id", F.col("pos").cast("bigint").alias("pos"), "start_ms", "end_ms")
    shown = rangejoin.overlap_join(g, s, ["video_id"], "w_start", "w_end", "start_ms", "end_ms", bucket=300_000).select("video_id", "pos").distinct()
    p = blocks.previous(shown, ["video_id"], "pos", F.col("pos"), "p")
    return p.where("pos > p + 1").select("video_id", F.col("pos").alias("after_gap"), (F.col("pos") - F.col("p") - 1).alias("missing"))


@query("WITH " + CAPTIONS_SQL + r""", num AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) - 1 AS pos, count(*) OVER (PARTITION BY video_id) AS n FROM cap),
f AS (SELECT video_id, pos, n, lower(string_agg(text, ' ') OVER (PARTITION BY video_id ORDER BY seg_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS t FROM num),
c AS (SELECT video_id, pos, n, 2 + CASE WHEN regexp_matches(t, 'dragon|дракон|drachen|dragón') THEN 3 ELSE 0 END AS score FROM f WHERE regexp_matches(t, 'hammer|молот|hammer|marteau|martillo') AND regexp_matches(t, 'drops|роняет|lässt|lâche|упускає|deja caer')),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, pos DESC) AS k FROM c)
SELECT b.video_id, CAST(b.score AS INT) AS score, x.start_ms, y.end_ms FROM b JOIN num x ON x.video_id = b.video_id AND x.pos = greatest(0, b.pos - 9) JOIN num y ON y.video_id = b.video_id AND y.pos = least(b.n - 1, b.pos + 13) WHERE k = 1""")
def risk_window(spark: SparkSession, d: str) -> DataFrame:
    """The excerpt of nine captions before to thirteen after the cue of the highest score of a
    video, the latest of equal ones."""
    top = _cues(spark, d).groupBy("video_id").agg(F.max_by(F.struct("score", "start_ms", "end_ms"), F.struct("score", "seg_idx")).alias("x"))
    return top.select("video_id", "x.*")


@query("""WITH v AS (SELECT video_id, min(channel_id) AS channel_id, min(title) AS title, min(published_at) AS published_at FROM videos WHERE video_id IS NOT NULL GROUP BY 1)
SELECT channel_id, video_id, coalesce(title, video_id) AS title FROM v WHERE channel_id IS NOT NULL""")
def channel_listing(spark: SparkSession, d: str) -> DataFrame:
    """Listings of a channel's videos as JSON, read again: rows without an id are dropped, a
    missing title is the id."""
    v = table(spark, d, "videos").where("channel_id IS NOT NULL").groupBy("video_id").agg(F.min("channel_id").alias("channel_id"), F.min("title").alias("title"))
    page = F.to_json(F.struct(F.struct(F.col("channel_id").alias("channelId")).alias("channel"), F.array(F.struct(F.col("video_id").alias("videoId"), "title")).alias("results")))
    body = F.from_json("body", "struct<channel:struct<channelId:string>,results:array<struct<videoId:string,title:string>>>")
    p = v.select(page.alias("body")).select(body.alias("p")).select("p.channel.channelId", F.explode("p.results").alias("r")).where("r.videoId IS NOT NULL")
    return p.select(F.col("channelId").alias("channel_id"), F.col("r.videoId").alias("video_id"), F.coalesce("r.title", "r.videoId").alias("title"))


@query()
def copy_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Explanations of cases that turn a negation of their anchor round become a quote of it."""
    p = table(spark, d, "parental_quality_manual").where("id IS NOT NULL").select("id", "anchor", "why").distinct()
    return p.select("id", grounding.ground_copy(F.col("anchor"), F.col("why")).alias("why"))


@query("WITH " + EVENTS_SQL + """ SELECT event_id, CAST(video_id AS VARCHAR) || ':' || scene_id || ':' || category || ':' || subtype AS id,
  CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, category, subtype, event_id) AS INT) AS place FROM ev""")
def event_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids made of video, scene, category and subtype, and the order of events in a video."""
    e = content_events(spark, d)
    n = blocks.numbered(e, ["video_id"], blocks.block_of("start_ms", 600_000), ["start_ms", "end_ms", "category", "subtype", "event_id"])
    return n.select("event_id", F.concat_ws(":", F.col("video_id").cast("string"), "scene_id", "category", "subtype").alias("id"), (F.col("pos") + 1).cast("int").alias("place"))


@query("WITH " + GOLD_SQL + """, v AS (SELECT DISTINCT video_id FROM videos WHERE video_id IS NOT NULL),
f AS (SELECT video_id, arg_min(gold_id, (start_ms, gold_id)) AS gold_id, arg_min(attention, (start_ms, gold_id)) AS attention FROM gold GROUP BY 1)
SELECT v.video_id, gold_id, coalesce(attention, 'none') AS attention FROM v LEFT JOIN f USING (video_id)""")
def first_label(spark: SparkSession, d: str) -> DataFrame:
    """Each video with its first label, or a default where there is none."""
    v = table(spark, d, "videos").where("video_id IS NOT NULL").select("video_id").distinct()
    f = _gold(spark, d).groupBy("video_id").agg(F.min_by(F.struct("gold_id", "attention"), F.struct("start_ms", "gold_id")).alias("x"))
    return v.join(f, "video_id", "left").select("video_id", "x.gold_id", F.coalesce("x.attention", F.lit("none")).alias("attention"))


@query("""WITH v AS (SELECT video_id, min(channel_id) AS channel_id, min(published_at) AS p FROM videos WHERE video_id IS NOT NULL GROUP BY 1), n AS (SELECT channel_id, count(*) AS n FROM v GROUP BY 1),
o AS (SELECT v.*, n.n, row_number() OVER (PARTITION BY channel_id ORDER BY p DESC NULLS LAST, video_id) - 1 AS pos FROM v JOIN n USING (channel_id))
SELECT channel_id, video_id, CAST(pos AS INT) AS place, CAST((pos - 1 + n) % n AS INT) AS rotated FROM o""")
def run_order(spark: SparkSession, d: str) -> DataFrame:
    """Videos of each channel from the newest on, and the same order rotated by one."""
    v = table(spark, d, "videos").where("video_id IS NOT NULL").groupBy("video_id").agg(F.min("channel_id").alias("channel_id"), F.min("published_at").alias("p")).where("channel_id IS NOT NULL")
    n = v.groupBy("channel_id").agg(F.count("*").alias("n"))
    day = F.coalesce(-F.floor(F.unix_micros(F.col("p").cast("timestamp")) / 86_400_000_000), F.lit(1 << 40)).cast("bigint")  # the newest day first, no day last
    o = blocks.numbered(v.join(n, "channel_id"), ["channel_id"], day, [F.desc_nulls_last("p"), "video_id"], "place").withColumn("place", F.col("place").cast("int"))
    return o.select("channel_id", "video_id", "place", F.pmod(F.col("place") - 1, F.col("n")).cast("int").alias("rotated"))


@query("WITH " + GOLD_SQL + ", " + SCENES_SQL + """, u AS (SELECT gold_id, video_id, start_ms FROM gold g WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.video_id = g.video_id AND g.start_ms >= sc.s - 5000 AND g.start_ms <= sc.e + 5000))
SELECT 'scene' AS part, video_id, scene_id AS id, s AS start_ms FROM (SELECT DISTINCT video_id, scene_id, s FROM sc) UNION ALL SELECT 'label', video_id, gold_id, start_ms FROM u""")
def known_and_rescued(spark: SparkSession, d: str) -> DataFrame:
    """All scenes, and beside them the labels that no scene covers within 5 s. The labels are
    not held against each other, which ``accepted_rescues`` does."""
    sc = _scenes(spark, d)
    g = _gold(spark, d).select("gold_id", "video_id", "start_ms").withColumn("till", F.col("start_ms"))
    hit = rangejoin.overlap_join(g, sc.select("video_id", "s", "e").distinct(), ["video_id"], "start_ms", "till", "s", "e", pad=5_000).select("gold_id", "video_id", "start_ms").distinct()
    rescued = g.drop("till").join(hit, ["gold_id", "video_id", "start_ms"], "left_anti").select(F.lit("label").alias("part"), "video_id", F.col("gold_id").alias("id"), "start_ms")
    return sc.select(F.lit("scene").alias("part"), "video_id", F.col("scene_id").alias("id"), F.col("s").alias("start_ms")).distinct().unionByName(rescued)


@query("WITH RECURSIVE " + GOLD_SQL + ", " + SCENES_SQL + """, u AS (SELECT DISTINCT gold_id, video_id, start_ms FROM gold g WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.video_id = g.video_id AND g.start_ms >= sc.s - 5000 AND g.start_ms <= sc.e + 5000)),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, gold_id) AS k FROM u),
r AS (SELECT video_id, k, [{'i': gold_id, 's': start_ms}] AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.video_id, o.k, CASE WHEN len(list_filter(r.kept, lambda y: abs(y.s - o.start_ms) <= 5000)) > 0 THEN r.kept ELSE list_append(r.kept, {'i': o.gold_id, 's': o.start_ms}) END
  FROM r JOIN o ON o.video_id = r.video_id AND o.k = r.k + 1),
z AS (SELECT video_id, unnest(arg_max(kept, k)) AS x FROM r GROUP BY 1)
SELECT video_id, x.i AS gold_id, x.s AS start_ms FROM z""")
def accepted_rescues(spark: SparkSession, d: str) -> DataFrame:
    """The labels, in order of time, that neither a scene nor a label accepted before covers
    within 5 s. Labels have no category here; with one it is a further key of ``scenes.accepted``."""
    g = _gold(spark, d).select("gold_id", "video_id", "start_ms", F.col("start_ms").alias("end_ms"))
    sc = _scenes(spark, d).select("video_id", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))
    return scenes.accepted(g, sc, ["video_id"], "gold_id", pad=5_000).drop("end_ms")


# Names of the categories.
LABELS = {
    "profanity_and_rude_language": "Мат и грубая лексика", "insults": "Оскорбления", "toilet_humor": "Туалетный юмор", "violence": "Насилие", "scary_and_disturbing": "Пугающие и тревожные темы",
    "sexual_content": "Сексуальные темы", "gambling": "Азартные игры и ставки", "substances": "Алкоголь, никотин и другие вещества", "self_harm": "Самоповреждение",
}
LABELS_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LABELS.items()) + "}"


@query("""WITH e AS (SELECT DISTINCT scan_id, video_id, scene_id, context_start_ms AS start_ms, unnest(categories) AS category FROM draft_scenes WHERE scan_id IS NOT NULL AND video_id IS NOT NULL AND scene_id IS NOT NULL AND context_start_ms IS NOT NULL)
SELECT *, coalesce(""" + LABELS_SQL + """[category], category) AS label FROM e""")
def scene_categories(spark: SparkSession, d: str) -> DataFrame:
    """A row for each category of a scene, with what the scene shares and the category's name."""
    e = table(spark, d, "draft_scenes").where("scan_id IS NOT NULL AND video_id IS NOT NULL AND scene_id IS NOT NULL AND context_start_ms IS NOT NULL")
    e = e.select("scan_id", "video_id", "scene_id", F.col("context_start_ms").alias("start_ms"), F.explode("categories").alias("category")).distinct()
    names = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return e.withColumn("label", F.coalesce(F.try_element_at(names, F.col("category")), F.col("category")))


@query("WITH " + CONTROLS_SQL + ", " + GOLD_SQL + """ SELECT control_id, coalesce(max(CASE attention WHEN 'main' THEN 2 WHEN 'details' THEN 1 WHEN 'hidden' THEN 0 END), -1) AS best, count(gold_id) AS labels
  FROM ctl LEFT JOIN gold g ON g.video_id = ctl.video_id AND abs(g.start_ms - ctl.at_ms) <= 5000 GROUP BY 1""")
def control_best(spark: SparkSession, d: str) -> DataFrame:
    """The greatest attention among the labels within 5 s of a control, -1 where there is none."""
    c = _controls(spark, d)
    g = _gold(spark, d).select("video_id", F.col("start_ms").alias("g_start"), F.col("start_ms").alias("g_end"), "attention")
    rank = F.when(F.col("attention") == "main", 2).when(F.col("attention") == "details", 1).when(F.col("attention") == "hidden", 0)
    hit = rangejoin.overlap_join(c.withColumn("at_end", F.col("at_ms")), g, ["video_id"], "at_ms", "at_end", "g_start", "g_end", pad=5_000)
    best = hit.groupBy("control_id").agg(F.max(rank).alias("best"), F.count("*").alias("labels"))
    ids = c.select("control_id").distinct()
    return ids.join(best, "control_id", "left").select("control_id", F.coalesce("best", F.lit(-1)).alias("best"), F.coalesce("labels", F.lit(0)).alias("labels"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CASE WHEN event_type = 'error' THEN 'provider_error' WHEN value < 1 THEN 'empty' ELSE 'ok' END AS status FROM events")
def event_props(spark: SparkSession, d: str) -> DataFrame:
    """The properties of events that may be logged, and the kind of outcome."""
    allowed = F.map_filter(F.from_json("props", "map<string,int>"), lambda k, _: k.isin("k"))
    status = F.when(F.col("event_type") == "error", "provider_error").when(F.col("value") < 1, "empty").otherwise("ok")
    return table(spark, d, "events").select("event_id", F.try_element_at(allowed, F.lit("k")).alias("k"), status.alias("status"))


# -- streams (an extension) --------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Counts per hour and type, by a stream over the events."""
    out = windows.run_to_table(windows.tumbling_counts(windows.read_events(spark, f"{d}/events.parquet")), spark, ["window_start", "event_type"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

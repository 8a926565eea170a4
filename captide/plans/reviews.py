"""Queries that hold scans, labels and controls against each other, by name, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captide.functions import numbers
from captide.operators import blocks, rangejoin, scenes
from captide.plans.catalog import CONTROLS_SQL, GOLD_SQL, SCENES_SQL, SQL, _controls, _cues, _gold, _scenes, max_matching, query
from captide.sources import captionjson
from captide.sources.tables import table
from captide.sources.views import CAPTIONS_SQL, EVENTS_SQL, SEGMENTS_SQL, content_events, segments
from captide.sources.views import captions as clean_captions

ROLES_SQL = """ro AS (SELECT ev.video_id, ev.scene_id, ev.event_id, ev.start_ms, ev.end_ms, k % 3 AS actor, (k // 3) % 3 AS target, CASE k % 5 WHEN 0 THEN 'hostile' WHEN 1 THEN 'helpful' ELSE '' END AS intent, k % 2 = 0 AS established
  FROM ev JOIN (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) USING (event_id))"""


@query("WITH RECURSIVE " + EVENTS_SQL + ", " + ROLES_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY video_id, scene_id ORDER BY start_ms, end_ms, event_id) AS k FROM ro),
r AS (SELECT video_id, scene_id, k, event_id, start_ms, end_ms AS reach, 1 AS c, [{'a': actor, 't': target, 'i': intent, 'e': established}] AS kept FROM o WHERE k = 1
  UNION ALL SELECT video_id, scene_id, k, event_id, start_ms, CASE WHEN same THEN greatest(reach, end_ms) ELSE end_ms END, CASE WHEN same THEN c ELSE c + 1 END, CASE WHEN same THEN list_append(kept, x) ELSE [x] END
  FROM (SELECT o.video_id, o.scene_id, o.k, o.event_id, o.start_ms, o.end_ms, r.reach, r.c, r.kept, {'a': o.actor, 't': o.target, 'i': o.intent, 'e': o.established} AS x,
    o.start_ms <= r.reach + 75000 AND len(list_filter(r.kept, lambda y: y.e AND o.established AND ((y.a <> y.t AND y.a = o.target AND y.t = o.actor)
      OR (y.a = o.actor AND ((y.i = 'helpful' AND o.intent = 'hostile') OR (y.i = 'hostile' AND o.intent = 'helpful')))))) = 0 AS same
    FROM r JOIN o ON o.video_id = r.video_id AND o.scene_id = r.scene_id AND o.k = r.k + 1)),
z AS (SELECT video_id, scene_id, c, min(start_ms) AS start_ms, max(reach) AS end_ms, count(*) AS events, max(c) OVER (PARTITION BY video_id, scene_id) AS n FROM r GROUP BY video_id, scene_id, c)
SELECT video_id, CASE WHEN n = 1 THEN scene_id ELSE scene_id || ':' || c END AS scene_id, start_ms, end_ms, CAST(events AS INT) AS events FROM z""")
def scene_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The events of a scene in order, cut where 75 s pass or where roles conflict; the parts are
    numbered if there are several. Roles are made of the events' properties."""
    e = content_events(spark, d).select("video_id", "scene_id", "event_id", "start_ms", "end_ms")
    k = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    intent = F.when(F.col("k") % 5 == 0, "hostile").when(F.col("k") % 5 == 1, "helpful").otherwise("")
    roles = e.join(k, "event_id").select(*e.columns, (F.col("k") % 3).alias("actor"), F.floor(F.col("k") / 3).cast("int") % 3, intent.alias("intent"), (F.col("k") % 2 == 0).alias("established"))
    return scenes.clusters(roles.toDF(*e.columns, "actor", "target", "intent", "established"))


@query("WITH RECURSIVE " + CAPTIONS_SQL + ", " + SCENES_SQL + r""", num AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) - 1 AS pos, count(*) OVER (PARTITION BY video_id) AS n FROM cap),
f AS (SELECT video_id, pos, n, start_ms, lower(string_agg(text, ' ') OVER (PARTITION BY video_id ORDER BY seg_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS t FROM num),
c AS (SELECT video_id, pos, n, 2 + CASE WHEN regexp_matches(t, 'dragon|дракон|drachen|dragón') THEN 3 ELSE 0 END AS score FROM f WHERE regexp_matches(t, 'hammer|молот|hammer|marteau|martillo') AND regexp_matches(t, 'drops|роняет|lässt|lâche|упускає|deja caer')
  AND NOT EXISTS (SELECT 1 FROM sc WHERE sc.video_id = f.video_id AND sc.e - sc.s <= 150000 AND f.start_ms >= sc.s - 20000 AND f.start_ms <= sc.e + 20000)),
w AS (SELECT c.video_id, c.score, c.pos, x.start_ms AS s, y.end_ms AS e FROM c JOIN num x ON x.video_id = c.video_id AND x.pos = greatest(0, c.pos - 9) JOIN num y ON y.video_id = c.video_id AND y.pos = least(c.n - 1, c.pos + 13)),
l AS (SELECT video_id, list({'score': score, 'pos': pos, 's': s, 'e': e} ORDER BY score DESC, pos DESC) AS left_over FROM w GROUP BY 1),
r AS (SELECT video_id, 1 AS place, left_over[1] AS x, list_filter(left_over, lambda y: NOT (y.s <= left_over[1].e + 20000 AND y.e >= left_over[1].s - 20000)) AS left_over FROM l
  UNION ALL SELECT video_id, place + 1, left_over[1], list_filter(left_over, lambda y: NOT (y.s <= left_over[1].e + 20000 AND y.e >= left_over[1].s - 20000)) FROM r WHERE place < 3 AND len(left_over) > 0)
SELECT video_id, CAST(place AS INT) AS place, CAST(x.score AS INT) AS score, x.s AS start_ms, x.e AS end_ms FROM r""")
def uncovered_windows(spark: SparkSession, d: str) -> DataFrame:
    """Of the excerpts around cues that no scene covers, the three of the highest score (the latest of
    equal ones) that lie more than 20 s apart from those taken before. Each round takes one of each video
    by an aggregation, so no video's cues meet in one task."""
    cues = _cues(spark, d).select("video_id", "pos", "score", F.col("at_ms"), "start_ms", "end_ms")
    short = _scenes(spark, d).where("e - s <= 150000").select("video_id", "s", "e").distinct()
    hit = rangejoin.overlap_join(cues.withColumn("at_end", F.col("at_ms")), short, ["video_id"], "at_ms", "at_end", "s", "e", pad=20_000).select("video_id", "pos").distinct()
    return scenes.best_apart(cues.join(hit, ["video_id", "pos"], "left_anti"), "video_id", ["score", "pos"], 3, 20_000).select("video_id", "place", "score", "start_ms", "end_ms")


@query("WITH " + SEGMENTS_SQL + """, h AS (SELECT video_id, seg_idx // 4096 AS b, seg_idx, sha256(text || '|' || start_ms || '|' || end_ms) AS h FROM seg),
p AS (SELECT video_id, b, sha256(string_agg(h, '' ORDER BY seg_idx)) AS h FROM h GROUP BY 1, 2),
t AS (SELECT video_id, sha256(string_agg(h, '' ORDER BY b)) AS h FROM p GROUP BY 1),
n AS (SELECT h, count(*) AS videos FROM t GROUP BY 1)
SELECT t.video_id, t.video_id || ':' || t.h AS transcript, n.videos AS videos FROM t JOIN n USING (h)""")
def transcript_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The key of each transcript, made of the video and a hash of its segments, and how many
    videos have the same one. Segments are hashed by blocks, and the blocks' hashes again."""
    one = F.sha2(F.concat_ws("|", "text", "start_ms", "end_ms"), 256)
    joined = lambda order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "h"))), lambda x: x["h"]), ""), 256).alias("h")
    by_block = segments(spark, d).select("video_id", "seg_idx", blocks.block_of("seg_idx").alias("b"), one.alias("h")).groupBy("video_id", "b").agg(joined("seg_idx"))
    t = by_block.groupBy("video_id").agg(joined("b"))
    return t.join(t.groupBy("h").agg(F.count("*").alias("videos")), "h").select("video_id", F.concat_ws(":", "video_id", "h").alias("transcript"), "videos")


@query("WITH " + CONTROLS_SQL + ", " + GOLD_SQL + """, m AS (SELECT control_id, c.video_id, CASE mode WHEN 'required_main' THEN 2 WHEN 'required_event' THEN 1 ELSE 0 END AS asked,
  max(CASE attention WHEN 'main' THEN 2 WHEN 'details' THEN 1 ELSE 0 END) AS got, count(g.gold_id) > 0 AS hit FROM ctl c LEFT JOIN gold g ON g.video_id = c.video_id AND abs(g.start_ms - c.at_ms) <= 5000 GROUP BY ALL)
SELECT video_id, count(*) AS controls, CAST(count_if(hit) AS BIGINT) AS detected, CAST(count_if(got = 2 AND hit) AS BIGINT) AS main, CAST(count_if(got = 1 AND hit) AS BIGINT) AS details, CAST(count_if(NOT hit OR got = 0) AS BIGINT) AS hidden,
  CAST(count_if(CASE WHEN hit THEN got ELSE 0 END < asked) AS BIGINT) AS downgrades, CAST(count_if(CASE WHEN hit THEN got ELSE 0 END > asked) AS BIGINT) AS upgrades FROM m GROUP BY 1""")
def attention_stability(spark: SparkSession, d: str) -> DataFrame:
    """Of each video's controls, how many have a label, its attention (hidden without one), and how
    often that is less or more than what the control asks for."""
    c = _controls(spark, d)
    g = _gold(spark, d).select("video_id", F.col("start_ms").alias("g_start"), F.col("start_ms").alias("g_end"), F.when(F.col("attention") == "main", 2).when(F.col("attention") == "details", 1).otherwise(0).alias("got"))
    j = rangejoin.overlap_join(c.withColumn("at_end", F.col("at_ms")), g, ["video_id"], "at_ms", "at_end", "g_start", "g_end", pad=5_000)
    keys = ["control_id", "video_id", "at_ms", "mode"]
    best = j.groupBy(*keys).agg(F.max("got").alias("got"))
    asked = F.when(F.col("mode") == "required_main", 2).when(F.col("mode") == "required_event", 1).otherwise(0)
    one = c.join(best, keys, "left").groupBy("control_id", "video_id", asked.alias("asked")).agg(F.max("got").alias("best")).withColumn("got", F.coalesce("best", F.lit(0)))
    n = lambda test, name: F.count_if(test).alias(name)
    got, want = F.col("got"), F.col("asked")
    return one.groupBy("video_id").agg(F.count("*").alias("controls"), n(F.col("best").isNotNull(), "detected"), n(got == 2, "main"), n(got == 1, "details"), n(got == 0, "hidden"), n(got < want, "downgrades"), n(got > want, "upgrades"))


#: Kinds of findings: a category and a subtype, or any of its subtypes.
PATTERNS = ("violence.*", "insults.s1", "gambling.s0", "gambling.s3", "substances.*")


@query("WITH " + EVENTS_SQL + ", p AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in PATTERNS) + """]) AS pattern)
SELECT p.pattern, ev.video_id, count(*) AS events, min(ev.start_ms) AS first_ms FROM ev JOIN p ON split_part(p.pattern, '.', 1) = ev.category AND split_part(p.pattern, '.', 2) IN ('*', ev.subtype) GROUP BY 1, 2""")
def pattern_matches(spark: SparkSession, d: str) -> DataFrame:
    """The events of each video that a pattern of a category and a subtype, or any subtype, stands for."""
    p = spark.createDataFrame([(x, *x.split(".")) for x in PATTERNS], "pattern string, category string, wanted string")  # as many rows as patterns
    j = content_events(spark, d).join(F.broadcast(p), "category").where("wanted = '*' OR wanted = subtype")
    return j.groupBy("pattern", "video_id").agg(F.count("*").alias("events"), F.min("start_ms").alias("first_ms"))


@query("WITH " + CAPTIONS_SQL + " SELECT video_id, seg_idx, start_ms, end_ms, text FROM cap")
def restored_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Captions written as numbered lines with a timeline beside them, 64 to a text, and read back."""
    part = F.floor(F.col("seg_idx") / 64).alias("part")
    rows = F.array_sort(F.collect_list(F.struct("seg_idx", "text", "start_ms", "end_ms")))
    saved = clean_captions(spark, d).groupBy("video_id", part).agg(rows.alias("r")).select(
        "video_id", F.array_join(F.transform("r", lambda x: F.concat(F.lit("["), x["seg_idx"].cast("string"), F.lit("] "), x["text"])), "\n").alias("lines"),
        F.transform("r", lambda x: F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"))).alias("timeline"),
    )
    return captionjson.restore_transcript(saved, "lines", "timeline")


@query("""WITH s AS (SELECT DISTINCT scan_id, video_id, scene_id FROM draft_scenes WHERE scan_id IS NOT NULL AND video_id IS NOT NULL AND scene_id IS NOT NULL),
f AS (SELECT video_id, max(scan_id) AS scan_id FROM s GROUP BY 1)
SELECT video_id, scan_id, count(*) AS scenes FROM s JOIN f USING (video_id, scan_id) GROUP BY 1, 2""")
def newest_scan_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Of each video the newest scan, which is the one seen first, and its number of scenes."""
    s = table(spark, d, "draft_scenes").where("scan_id IS NOT NULL AND video_id IS NOT NULL AND scene_id IS NOT NULL").select("scan_id", "video_id", "scene_id").distinct()
    per = s.groupBy("video_id", "scan_id").agg(F.count("*").alias("scenes"))
    return per.groupBy("video_id").agg(F.max(F.struct("scan_id", "scenes")).alias("x")).select("video_id", "x.*")


@query("""WITH s AS (SELECT DISTINCT scan_id, video_id, unnest(categories) AS c FROM draft_scenes WHERE scan_id IS NOT NULL AND video_id IS NOT NULL),
k AS (SELECT video_id, scan_id, list_sort(list(c)) AS c FROM s GROUP BY 1, 2),
f AS (SELECT video_id, arg_min(c, scan_id) AS first, min(scan_id) AS scan FROM k GROUP BY 1)
SELECT k.video_id, count(*) AS runs, floor(avg(CASE WHEN k.c = f.first THEN 1.0 ELSE 0.0 END) * 10000 + 0.5) / 10000 AS equal_share,
  floor(avg(len(list_intersect(k.c, f.first)) * 1.0 / len(list_distinct(list_concat(k.c, f.first)))) * 10000 + 0.5) / 10000 AS mean_jaccard FROM k JOIN f USING (video_id) WHERE k.scan_id <> f.scan GROUP BY 1""")
def run_stability(spark: SparkSession, d: str) -> DataFrame:
    """Of the later scans of a video, the share whose categories equal those of its first, and their
    mean Jaccard similarity."""
    s = table(spark, d, "draft_scenes").where("scan_id IS NOT NULL AND video_id IS NOT NULL")
    sets = s.select("video_id", "scan_id", F.explode("categories").alias("c")).groupBy("video_id", "scan_id").agg(F.array_sort(F.collect_set("c")).alias("c"))  # nine categories at most
    first = sets.groupBy("video_id").agg(F.min_by("c", "scan_id").alias("f"), F.min("scan_id").alias("scan"))
    likeness = F.size(F.array_intersect("c", "f")) / F.size(F.array_union("c", "f"))
    mean = lambda x, name: (F.floor(F.avg(x) * 10000 + 0.5) / 10000).alias(name)
    return sets.join(first, "video_id").where("scan_id != scan").groupBy("video_id").agg(F.count("*").alias("runs"), mean((F.col("c") == F.col("f")).cast("double"), "equal_share"), mean(likeness, "mean_jaccard"))


@query("WITH " + GOLD_SQL + ", " + SCENES_SQL + ", mm AS (" + SQL["max_matching"] + """),
v AS (SELECT DISTINCT scan_id, video_id FROM sc WHERE scan_id IS NOT NULL AND video_id IN (SELECT video_id FROM gold)),
p AS (SELECT scan_id, count(DISTINCT (video_id, scene_id)) AS scenes FROM sc JOIN v USING (scan_id, video_id) GROUP BY 1),
g AS (SELECT scan_id, count(DISTINCT (video_id, gold_id)) AS labels FROM gold JOIN v USING (video_id) GROUP BY 1),
m AS (SELECT scan_id, CAST(sum(matched) AS BIGINT) AS matched FROM mm GROUP BY 1)
SELECT scan_id, scenes, labels, coalesce(matched, 0) AS matched, floor(coalesce(matched, 0) * 1.0 / scenes * 10000 + 0.5) / 10000 AS precision, floor(coalesce(matched, 0) * 1.0 / labels * 10000 + 0.5) / 10000 AS recall
FROM p JOIN g USING (scan_id) LEFT JOIN m USING (scan_id)""")
def matched_quality(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of each scan's scenes against the labels, over the videos that have both, by
    the greatest matching of the two."""
    s = _scenes(spark, d).where("scan_id IS NOT NULL").select("scan_id", "video_id", "scene_id").distinct()
    g = _gold(spark, d).select("video_id", "gold_id").distinct()
    s = s.join(g.select("video_id").distinct(), "video_id", "left_semi")
    n = lambda df, name: df.groupBy("scan_id").agg(F.count("*").alias(name))
    matched = max_matching(spark, d).groupBy("scan_id").agg(F.sum("matched").alias("matched"))
    j = n(s, "scenes").join(n(s.select("scan_id", "video_id").distinct().join(g, "video_id"), "labels"), "scan_id").join(matched, "scan_id", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    share = lambda of: numbers.round_half_up(F.col("matched") / F.col(of), 4)
    return j.select("scan_id", "scenes", "labels", "matched", share("scenes").alias("precision"), share("labels").alias("recall"))

"""Anchors against the segments of their video."""

import random

import duckdb
import numpy as np
import pytest

from captide.operators import anchors
from captide.plans import catalog
from tests.test_catalog import canonical

SEGMENT = "video_id string, seg_idx int, text string, start_ms long, end_ms long"
ANCHOR = "id string, source_video string, anchor string"


def written(spark, path, segments, cases):
    for name, rows, schema in (("transcript_segments", segments, SEGMENT), ("parental_quality_manual", cases, ANCHOR)):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def by_sql(d, name):
    c = duckdb.connect()
    for t in ("transcript_segments", "parental_quality_manual"):
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    return canonical(c.sql(catalog.oracle_sql()[name]).df())


def odd(seed):
    """Repeated rows, gaps, empty texts, missing values, ids of two videos and of none."""
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(["Ab", "c1", "Ёж", "d-e", "f", "éÀ", "g_h", "..."] + list("jklmnopqrst")) for _ in range(r.randint(0, n)))
    segments = [(r.choice(["u", "v", "w", None]), r.choice([r.randint(0, 60), r.randint(0, 400), -3, None]), r.choice([say(4), say(9), None]), s := r.randint(-1, 50), s + r.randint(-1, 9)) for _ in range(500)]
    cases = [(r.choice([f"c{r.randint(0, 60)}", f"d{i}", None]), r.choice(["u", "v", "w", "x", None]), r.choice([say(3), say(9), say(9), None])) for i in range(120)]
    return segments + segments[:40], cases + cases[:9]


def shuffled(spark, df):
    """Rows that the stages of this query write for other stages."""
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    last = max((s.stageId() for s in map(stages().apply, range(stages().size()))), default=-1)
    df.collect()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    done = stages()
    return sum(s.shuffleWriteRecords() for s in map(done.apply, range(done.size())) if s.stageId() > last)


@pytest.fixture(scope="module")
def one_video(spark, tmp_path_factory):
    """1,500 segments of one video and 300 anchors: each segment shares a word with each anchor."""
    segments = [("v", i, f"the w{i} of x{i % 50}", i, i + 1) for i in range(1500)]
    cases = [(f"c{i}", "v", f"The w{i * 5}, of x{i * 5 % 50} the w{i * 5 + 1}") for i in range(300)]
    return written(spark, tmp_path_factory.mktemp("one"), segments, cases)


@pytest.mark.parametrize("width", [3, 40, anchors.WIDTH])
def test_anchor_containment_equals_sql_on_odd_rows(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(anchors, "WIDTH", width)
    d = written(spark, tmp_path, *odd(width))
    assert canonical(catalog.queries()["anchor_containment"](spark, d).toPandas()) == by_sql(d, "anchor_containment")


def test_anchor_containment_writes_no_pairs(spark, one_video):
    df = catalog.queries()["anchor_containment"](spark, one_video)
    assert shuffled(spark, df) < 15_000  # of 450,000 pairs
    assert canonical(df.toPandas()) == by_sql(one_video, "anchor_containment")


@pytest.mark.parametrize("width", [2, 3, 7, 40, anchors.WIDTH])
def test_anchor_spans_equals_sql_on_odd_rows(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(anchors, "WIDTH", width)
    d = written(spark, tmp_path, *odd(100 + width))
    assert canonical(catalog.queries()["anchor_spans"](spark, d).toPandas()) == by_sql(d, "anchor_spans")


def test_anchor_spans_writes_no_pairs(spark, one_video):
    df = catalog.queries()["anchor_spans"](spark, one_video)
    assert shuffled(spark, df) < 15_000  # of 450,000 pairs
    assert canonical(df.toPandas()) == by_sql(one_video, "anchor_spans")


def test_best_stretch_of_a_block_equals_brute_force():
    r = random.Random(5)
    for _ in range(2000):
        size, n = r.randint(1, 14), r.randint(1, 6)
        held = [sorted(r.sample(range(size), r.randint(1, size if r.random() < 0.2 else min(3, size)))) for _ in range(n)]
        rows, which = np.array([x for xs in held for x in xs]), np.array([w for w, xs in enumerate(held) for _ in xs])
        total = n + r.randint(0, 3)
        hits = lambda p, k: sum(any(p <= x < p + k for x in xs) for xs in held)
        most, less, early = max((hits(p, k), -k, -p) for p in set(rows.tolist()) for k in range(1, anchors.REACH + 1))
        assert anchors._stretch(rows, which, size, total, 0.6) == ((-early, -less) if most / total >= 0.6 else None)

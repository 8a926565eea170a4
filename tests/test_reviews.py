import random
from types import SimpleNamespace

import pytest

from captide.operators import captions, scenes
from captide.sources import captionjson
from captide.sources.shared import shared_folder

ROLES = "video_id int, scene_id string, event_id int, start_ms long, end_ms long, actor int, target int, intent string, established boolean"


def test_clusters_against_brute_force(spark):
    r = random.Random(6)
    data = [(1, "ab"[i % 2], i, s := r.randint(0, 60) * 10_000, s + r.choice([0, 2000, 150_000]), r.randint(0, 2), r.randint(0, 2), r.choice(["hostile", "helpful", ""]), r.random() < 0.6) for i in range(160)]
    want = []
    for scene in "ab":
        found: list[list] = []
        for x in sorted((x for x in data if x[1] == scene), key=lambda x: (x[3], x[4], x[2])):
            *_, actor, target, intent, sure = x
            now = found[-1] if found else []
            conflict = any(y[8] and sure and (actor != target and y[5:7] == (target, actor) or actor == y[5] and {intent, y[7]} == {"hostile", "helpful"}) for y in now)
            if now and x[3] <= max(y[4] for y in now) + 75_000 and not conflict:
                now.append(x)
            else:
                found.append([x])
        want += [(1, f"{scene}:{k + 1}" if len(found) > 1 else scene, c[0][3], max(y[4] for y in c), len(c)) for k, c in enumerate(found)]
    got = scenes.clusters(spark.createDataFrame(data, ROLES)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 6
    assert scenes.clusters(spark.createDataFrame([], ROLES)).count() == 0


def test_best_apart_against_brute_force(spark):
    r = random.Random(3)
    data = [(k, i, r.randint(0, 5), s := r.randint(0, 100) * 1000, s + r.randint(0, 30_000)) for k in ("a", None) for i in range(40)]
    got = scenes.best_apart(spark.createDataFrame(data, "k string, i int, score int, start_ms long, end_ms long").where("k IS NOT NULL"), "k", ["score", "i"], 3, 5_000).collect()
    kept: list[tuple] = []
    for x in sorted((x for x in data if x[0]), key=lambda x: (-x[2], -x[1])):
        if len(kept) < 3 and all(x[3] > y[4] + 5_000 or x[4] < y[3] - 5_000 for y in kept):
            kept.append(x)
    assert [tuple(x)[:5] for x in sorted(got, key=lambda x: x.place)] == kept


def test_one_group_of_half_the_rows_and_null_keys_stream_by(spark):
    data = [("hot", i) for i in range(3000)] + [(None, i) for i in range(50)] + [(str(i), 0) for i in range(3000)]

    def step(rows):
        key, n = None, 0
        for key, _ in rows:
            n += 1
        yield key, n

    got = {x.k: x.n for x in captions.streamed(spark.createDataFrame(data, "k string, i int"), ["k"], ["i"], step, "k string, n int").collect()}
    assert got["hot"] == 3000 and got[None] == 50 and len(got) == 3002


def test_transcripts_are_restored_or_refused(spark):
    make = lambda lines, times: spark.createDataFrame([("v", lines, times)], "video_id string, lines string, times array<struct<start_ms:long,end_ms:long>>")
    got = captionjson.restore_transcript(make("[3] a [1] b\n[4] ", [(1, 2), (3, 4)]), "lines", "times").collect()
    assert [tuple(x) for x in got] == [("v", 3, 1, 2, "a [1] b"), ("v", 4, 3, 4, "")]
    for lines, times in (("[3] a", [(1, 2), (3, 4)]), ("a", [(1, 2)])):
        with pytest.raises(Exception, match="number"):
            captionjson.restore_transcript(make(lines, times), "lines", "times").collect()


def test_no_local_folder_on_a_cluster():
    session = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {}))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(session(master))
    assert shared_folder(session("local[2]"))

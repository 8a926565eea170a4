import itertools
import random

from pyspark.sql import functions as F

from captide.operators import blocks, captions, rangejoin, reports, scenes

CAPTIONS = "video_id string, seg_idx int, text string, start_ms long, end_ms long"


def kept(spark, data):
    df = spark.createDataFrame(data, CAPTIONS)
    return [(r.seg_idx, r.text) for r in captions.without_repeats(df).orderBy("video_id", "start_ms", "seg_idx").collect()]


def test_repeats_without_overlap_stay(spark):
    assert kept(spark, [("v", 0, "Нет", 0, 1000), ("v", 1, "Нет", 1000, 2000), ("v", 2, "музыка", 3000, 4000)]) == [(0, "Нет"), (1, "Нет"), (2, "музыка")]


def test_part_of_a_word_is_no_overlap(spark):
    assert kept(spark, [("v", 0, "автомат", 0, 2000), ("v", 1, "мат", 1000, 3000)]) == [(0, "автомат"), (1, "мат")]


def test_overlap_of_words_goes(spark):
    data = [("v", 0, "one two three", 0, 3000), ("v", 1, "Two three four", 2000, 5000), ("v", 2, "four", 4000, 6000), ("v", 3, "three four five", 4500, 7000)]
    assert kept(spark, data) == [(0, "one two three"), (1, "four"), (3, "three four five")]
    assert kept(spark, []) == []


def chunks_brute(rows, budget, overlap):
    size = lambda t: max(1, -(-len(t.encode()) // 3))
    out, start, n = [], 0, 0
    while start < len(rows):
        end, used = start, 0
        while end < len(rows):
            cost = size(f"[{end}] {rows[end][0]}\n")
            if end > start and used + cost > budget:
                break
            used += cost
            end += 1
            if used >= budget:
                break
        out.append((n, start, end - 1, size("\n".join(f"[{i}] {rows[i][0]}" for i in range(start, end)))))
        n += 1
        if end >= len(rows):
            break
        since = max(0, rows[end - 1][1] - overlap)
        start = next((i for i in range(start + 1, end) if rows[i][1] >= since), end)
    return out


def test_chunks_against_brute_force(spark):
    r = random.Random(4)
    for budget, overlap in ((40, 500), (12, 0), (1, 100), (60, 5000)):
        rows = [("слово " * r.randint(1, 6), i * 300 + r.randint(0, 200)) for i in range(80)]
        df = spark.createDataFrame([("v", i, t, e - 50, e) for i, (t, e) in enumerate(rows)], CAPTIONS)
        got = [tuple(x)[1:] for x in captions.chunks(df, budget, overlap).orderBy("chunk").collect()]
        assert got == chunks_brute(rows, budget, overlap)
    assert captions.chunks(spark.createDataFrame([], CAPTIONS)).count() == 0


def test_batches_next_fit(spark):
    r = random.Random(2)
    data = [(k, f"{i:03}", r.choice([0, 10, 40, 70, 130])) for k in "ab" for i in range(50)]
    got = {(x.k, x.i): x.batch for x in captions.batches(spark.createDataFrame(data, "k string, i string, n long"), "k", "i", "n", 100, 3).collect()}
    for k in "ab":
        batch = total = count = 0
        for kk, i, n in data:
            if kk != k:
                continue
            if count and (total + n > 100 or count >= 3):
                batch, total, count = batch + 1, 0, 0
            total, count = total + n, count + 1
            assert got[k, i] == batch


def test_greedy_unique_against_brute_force(spark):
    r = random.Random(9)
    data = [(r.choice("ab"), i, s := r.randint(0, 300) * 100, s + 500, round(r.random(), 2)) for i in range(200)]
    want = []
    for k in "ab":
        done = []
        for x in sorted((x for x in data if x[0] == k), key=lambda x: (x[2], -x[4], x[1])):
            hit = next((j for j, y in enumerate(done) if y[2] <= x[3] + 2000 and y[3] >= x[2] - 2000), None)
            if hit is None:
                done.append(x)
            elif x[4] > done[hit][4]:
                done[hit] = x
        want += done
    df = spark.createDataFrame(data, "k string, i int, start_ms long, end_ms long, confidence double")
    got = scenes.greedy_unique(df, ["k"], "i").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_merged_scenes(spark):
    schema = "scan_id string, video_id string, scene_id string, categories array<string>, context_start_ms long, context_end_ms long"
    data = [
        ("s", "v", "a", ["violence"], 0, 100), ("s", "v", "b", ["scary_and_disturbing"], 40, 120), ("s", "v", "c", ["gambling"], 50, 110), ("s", "v", "d", ["violence"], 115, 300),
        ("s", "v", "e", None, 400, 500), ("s", "v", "f", ["x"], None, 5), ("s", "w", "a", ["violence"], 0, 100), ("s", "v", "a", ["violence"], 0, 100),
    ]
    got = sorted(map(tuple, scenes.merged_scenes(spark.createDataFrame(data, schema)).collect()))
    assert got == [("s", "v", "a+b", 0, 120, 2), ("s", "v", "c", 50, 110, 1), ("s", "v", "d", 115, 300, 1), ("s", "v", "e", 400, 500, 1), ("s", "w", "a", 0, 100, 1)]


def test_matching_is_greatest(spark):
    r = random.Random(1)
    data = [(g, a, b) for g in range(12) for a in "abcd" for b in range(4) if r.random() < 0.35]
    got = {x.g: x.matched for x in scenes.matching(spark.createDataFrame(data, "g int, a string, b int"), ["g"], "a", "b").collect()}
    for g in range(12):
        edges = {(a, b) for h, a, b in data if h == g}
        best = max(sum((a, b) in edges for a, b in zip("abcd", p)) for p in itertools.permutations(range(4)))
        assert got.get(g, 0) == best


def test_overlap_join_against_brute_force(spark):
    r = random.Random(5)
    a = [(r.choice("xy"), i, s := r.randint(0, 400), s + r.choice([0, 5, 80])) for i in range(60)]
    b = [(r.choice("xy"), i, s := r.randint(0, 400), s + r.choice([-1, 0, 30, 200])) for i in range(60)] + [("x", 99, None, 5)]
    x, y = spark.createDataFrame(a, "k string, i int, s long, e long"), spark.createDataFrame(b, "k string, j int, s2 long, e2 long")
    got = {(t.i, t.j) for t in rangejoin.overlap_join(x, y, ["k"], "s", "e", "s2", "e2", pad=7, bucket=50).collect()}
    assert got == {(i, j) for k, i, s, e in a for m, j, s2, e2 in b if k == m and s2 is not None and e2 >= s2 and s <= e2 + 7 and e >= s2 - 7}
    n = rangejoin.overlap_join(x, y, ["k"], "s", "e", "s2", "e2", pad=7, bucket=50).count()
    assert n == len(got)


def test_previous_and_margins_cross_blocks(spark):
    df = spark.createDataFrame([("v", i, i * 10) for i in (0, 3, 4, 9, 10, 11, 30)], "k string, i int, x int")
    got = blocks.previous(df, ["k"], "i", F.col("x"), "p", width=4).orderBy("i").collect()
    assert [r.p for r in got] == [None, 0, 30, 40, 90, 100, 110]
    m = blocks.with_margins(df, "i", 1, width=4)
    assert {(r.i, r._b, r._own) for r in m.collect()} >= {(3, 0, True), (3, 1, False), (4, 1, True), (4, 0, False), (11, 3, False)}


def test_apportionment_conserves_totals(spark):
    r = random.Random(3)
    data = [(g, i, t, r.randint(0, 9)) for g, t in enumerate((0, 1, 7, 100, 1001, -4)) for i in range(5)]
    for offset in (False, True):
        got = reports.apportioned(spark.createDataFrame(data, "g int, i int, t long, w long"), "g", "i", "t", "w", offset).groupBy("g").agg(F.sum("share").alias("s"), F.min("share").alias("m")).collect()
        assert {x.g: x.s for x in got} == {0: 0, 1: 1, 2: 7, 3: 100, 4: 1001, 5: 0}
        assert all(x.m >= 0 for x in got)


def test_reports_have_zero_rows(spark):
    e = spark.createDataFrame([(1, 5, "violence", "s0", "high", 0.5)], "video_id int, event_id int, category string, subtype string, severity string, confidence double")
    cats = ("violence", "gambling")
    assert sorted(map(tuple, reports.video_categories(e, cats).collect())) == [(1, "gambling", 0, 0, 0, ""), (1, "violence", 1, 1, 3, "s0")]
    assert sorted(map(tuple, reports.channel_categories(e, cats).collect())) == [("gambling", 0, 0, 0, 0, 0, "none"), ("violence", 1, 1, 1, 1, 3, "pervasive")]


def test_numbers_across_blocks(spark):
    df = spark.createDataFrame([("a", i) for i in (9, 0, 3, 4, 30, 10)] + [("b", 7)], "k string, i int")
    got = blocks.numbered(df, ["k"], blocks.block_of("i", 4), ["i"]).collect()
    assert {(r.k, r.i): r.pos for r in got} == {("a", 0): 0, ("a", 3): 1, ("a", 4): 2, ("a", 9): 3, ("a", 10): 4, ("a", 30): 5, ("b", 7): 0}

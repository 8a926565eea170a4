import random

import numpy as np

from captide.llm import reading

DOC, GRADE = "doc_id long, text string, source string, level int", "doc_id long, grade int"
EASY = ["the cats run", "we eat cake", "the dogs dig", "i see a fox"]
PLAIN = ["the captain hides the last lantern over the river", "the old wizard digs a tunnel next to the market", "that noisy neighbour paints the roof yellow"]
HARD = ["the phenomenological categorization of juridical intentionality presupposes terminological differentiation", "notwithstanding considerable divergence the methodological heterogeneity undermines comparability of aggregated indicators", "epistemological contingency necessitates systematic disaggregation of heterogeneous classifications"]


def name(r):
    return "".join(r.choice(["zim", "bra", "nep", "quen", "tor", "lu", "ven", "osk"]) for _ in range(4)).title()


def text(r, grade, punctuation=True):
    owes = f"{name(r)} owes {name(r)} exactly {r.randint(1, 900)} gold bars"
    if grade == 1:
        s = [r.choice(EASY) for _ in range(r.randint(5, 12))]
    elif grade == 2:
        s = [r.choice([*PLAIN, owes]) for _ in range(r.randint(4, 10))]
    elif grade == 3:
        s = [", and then ".join(r.choice(PLAIN) for _ in range(3)) for _ in range(r.randint(3, 6))]
    else:
        s = [r.choice(HARD) for _ in range(r.randint(4, 9))]
    return (". " if punctuation else " ").join(s)


def corpus(r, n):
    return [(i, text(r, i % 4 + 1, r.random() < 0.7), "s", 0) for i in range(n)], [(i, i % 4 + 1) for i in range(n)]


def test_held_out_grades():
    train, grades = corpus(random.Random(1), 160)
    model, ranker = reading.fit([d[1] for d in train], [g[1] for g in grades])
    test, want = corpus(random.Random(2), 120)
    level = ranker.level(ranker.score(reading.Measures(model).of([d[1] for d in test])))
    want = np.array([g[1] for g in want])
    assert ((level > reading.HIGHEST) == (want == 4)).mean() >= 0.98
    assert np.corrcoef(level, want)[0, 1] > 0.9


def test_one_learned_sentence_is_not_enough():
    train, grades = corpus(random.Random(3), 160)
    model, ranker = reading.fit([d[1] for d in train], [g[1] for g in grades])
    mixed = [text(random.Random(i), 2) + ". " + HARD[0] for i in range(20)]
    names = ["Zimbranepquen owes Torluvenosk exactly 40 gold bars. " * 6]
    assert (ranker.level(ranker.score(reading.Measures(model).of(mixed + names))) <= reading.HIGHEST).all()


def test_isotonic_is_the_best_increasing_fit():
    knots, levels = reading.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert np.interp([1, 2, 3, 4], knots, levels).tolist() == [1, 2.5, 2.5, 4]


def test_documents(spark):
    data, grades = corpus(random.Random(4), 120)
    docs = spark.createDataFrame(data + [(900, None, "s", 0), (901, " \n", "s", 0), (902, "12 ...", "s", 0), (903, HARD[0] * 2000, "s", 0), (None, HARD[0], "s", 0)], DOC)
    lab = spark.createDataFrame(grades + [(0, None), (None, 4), (5555, 4)], GRADE)
    levels = reading.reading_levels(docs, lab)
    got = {x.doc_id: x.level for x in levels.collect()}
    assert len(got) == 124 and got[900] is None and got[901] is None and got[902] is None
    found = {x.doc_id for x in reading.highest_grade(levels).collect()}
    assert {i for i, g in grades if g == 4} <= found | {903} and not {i for i, g in grades if g < 3} & found
    assert sum(x.documents for x in reading.level_profile(levels, docs).collect()) == 124


def test_without_grades_or_documents(spark):
    none = spark.createDataFrame([], DOC), spark.createDataFrame([], GRADE)
    assert reading.reading_levels(*none).count() == 0
    some = spark.createDataFrame([(1, "a b", "s", 0)], DOC)
    assert reading.reading_levels(some, none[1]).collect()[0].level == 2.0

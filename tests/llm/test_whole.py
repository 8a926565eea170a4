"""Inputs that the operators for training data did less than the whole job on."""

import random

from captide.llm import packing, splits, turns


def test_annotation_of_any_length_is_no_speech():
    words = lambda text: turns.speech_of(turns.Grammar(), text)
    assert words("one [" + "x " * 2000 + "(and more)] two") == "one two"
    assert words("one [two (three]") == "one two three"
    assert words("(" * 50_000 + " word") == "word"  # linear, or this never ends


def test_rows_of_null_or_equal_ids_are_items_each(spark):
    data = [(None, 5, "a"), (None, 5, "b"), ("x", 7, "a"), ("x", 7, "b"), ("x", 7, "b")]
    got = packing.pack(spark.createDataFrame(data, "id string, a long, video string"), "id", ["a"], [100]).collect()
    assert sorted((x.id or "", x.a) for x in got) == [("", 5), ("", 5), ("x", 7), ("x", 7)]


def test_pairs_of_short_texts_of_few_words_are_all_found(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(14)]
    texts = {" ".join(r.choice(vocabulary) for _ in range(r.randint(6, 20))) for _ in range(150)} | {"w1", "w1 w2", "w3 w4 w5", "w3", "w9 w8", "w7 w6 w1 w2"}
    for t in sorted(texts):
        w = t.split()
        for _ in range(2):  # two words altered well apart, or one dropped and one added
            v = list(w)
            v[len(v) // 4], v[3 * len(v) // 4] = r.choice(vocabulary), r.choice(vocabulary)
            if r.random() < 0.3:
                v = v[1:] + [r.choice(vocabulary)]
            texts.add(" ".join(v))
    rows = [(t, t, x := r.random() < 0.5, not x) for t in sorted(texts)]
    found = splits.class_pairs(spark.createDataFrame(rows, "key string, form string, in_train boolean, in_eval boolean"))
    got = {(x.key_t, x.key_e) for x in found.collect()}
    want = {(a, b) for a, _, x, _ in rows if x for b, _, _, y in rows if y and splits.edits(a.split(), b.split(), 2) <= 2}
    assert len(want) > 50 and got == want

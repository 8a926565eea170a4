import random

import pytest
from tokenizers import Tokenizer

from captide.llm import encode

PATH = f"{encode.TOKENIZERS}/{encode.VOCABULARY}"
PIECES = ["'s", "'ll", "'", "''", " ", "  ", "\n", "\n\n", "\t", "a", "aaaa", "don't", "é", "Ж", "12", "½", "²", "…", "!!", " ", "　", "\x1c", "\x85", "🙂", "中", "‑", "'re", "x'VE", "<|endoftext|>", "​", "́", "word", "The"]


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_equals_the_public_tokenizer(spark, public, monkeypatch):
    monkeypatch.setattr(encode, "CHUNK_BYTES", 500)
    r = random.Random(2)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(3000)] + ["aa " * 20_000, "б" * 3000]
    data = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(data + [(-1, None, "x"), (-2, "", "x"), (None, "a", "x"), (0, texts[0], "x")], "doc_id long, text string, ids string")
    got = encode.encode_texts(df).collect()
    assert len(got) == df.count()
    by = {x.doc_id: x.ids for x in got}
    assert [by[i] for i in range(len(texts))] == public(texts)
    assert by[-1] == [] and by[-2] == [] and by[None] == public(["a"])[0]


def test_empty_table_and_schema(spark):
    df = encode.encode_texts(spark.createDataFrame([], "doc_id long, text string"))
    assert df.schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>" and df.count() == 0


def test_words_beyond_the_kept_ones(public, monkeypatch):
    import numpy as np

    monkeypatch.setattr(encode, "KEPT_WORDS", 10)
    e = encode.Encoder(PATH)
    for text in ("one two three four five six seven eight nine ten eleven twelve", "one two", "three"):
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, n = e.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == public([text])[0] and n.tolist() == [len(ids)]

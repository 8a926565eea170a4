"""Reading level of documents, comparable across languages.

A linear ranker learns from pairs of graded documents which of two is harder, from features of their
vocabulary and sentences; an isotonic regression turns its scores into grades. Vocabulary is judged by
the letters inside the words, so that words no graded document has are still judged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captide.llm.encode import ragged
from captide.llm.words import cleaned

#: Bounds of the graded documents used for training: about so many, of so many characters together at
#: most, none longer than FIT_TEXT.
FIT_DOCUMENTS, FIT_CHARACTERS, FIT_TEXT = 6_000, 50_000_000, 1_000_000
#: Hashed letter groups of a word, and their length.
GROUPS, GROUP = 1 << 16, 4
#: Words that one stretch of a text has, of which the share of hard stretches is a feature.
STRETCH = 20
#: How much more a pair with a text of the highest grade counts.
TOP_PAIRS = 8.0
#: Features of a text.
MEASURES = 7
#: A document is of the highest grade if its level exceeds this.
HIGHEST = 3.5

_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_FEATURES = ("words", "letters", "long", "longest", "hard", "clause", "end", "number")


class WordModel:
    """How far a word's letter groups speak for texts of the highest grade (log odds)."""

    def __init__(self, bias: float, weight: np.ndarray):
        self.bias, self.weight = bias, weight

    @staticmethod
    def groups(word: str) -> list[int]:
        w = f"^{word}$"
        return [xxhash.xxh32_intdigest(w[i : i + GROUP]) % GROUPS for i in range(max(1, len(w) - GROUP + 1))]

    def score(self, word: str) -> float:
        g = self.groups(word)
        return float(self.bias + self.weight[g].mean() * 6)


def fit_words(words: list[list[str]], hard: np.ndarray, epochs: int = 12, seed: int = 3) -> WordModel:
    """Logistic model of single words: does a word stand in texts of the highest grade?"""
    in_hard: dict[str, int] = {}
    in_easy: dict[str, int] = {}
    for ws, h in zip(words, hard):
        side = in_hard if h else in_easy
        for w in set(ws):
            side[w] = side.get(w, 0) + 1
    vocabulary = sorted(in_hard.keys() | in_easy.keys())
    a = np.array([in_hard.get(w, 0) for w in vocabulary], float) / max(1, hard.sum())
    b = np.array([in_easy.get(w, 0) for w in vocabulary], float) / max(1, (~hard).sum())
    y = (a > 1.5 * b).astype(float)  # stands clearly more often in hard texts
    sizes = np.array([len(WordModel.groups(w)) for w in vocabulary])
    flat = np.array([g for w in vocabulary for g in WordModel.groups(w)])
    at = np.append(0, np.cumsum(sizes))
    weight, bias, grad2 = np.zeros(GROUPS), 0.0, np.full(GROUPS, 1e-6)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(vocabulary)), max(1, len(vocabulary) // 256)):
            s = sizes[part]
            g = flat[ragged(at[part], s)]
            row = np.repeat(np.arange(len(part)), s)
            z = bias + 6 * np.bincount(row, weights=weight[g], minlength=len(part)) / s
            e = balance[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part])
            d = np.bincount(g, weights=(6 * e / s)[row], minlength=GROUPS) / len(part) + 1e-5 * weight
            grad2 += d * d
            weight -= 0.3 * d / np.sqrt(grad2)
            bias -= 0.05 * e.mean()
    return WordModel(bias, weight)


class Measures(dict):
    """Features of blank-separated tokens, and sums of them over texts."""

    def __init__(self, model: WordModel):
        super().__init__()
        self.model = model
        self.rows: list[tuple] = []
        self.table = np.zeros((0, len(_FEATURES)))

    def __missing__(self, token: str) -> int:
        low = cleaned(token)
        ws = _WORD.findall(low)
        letters = [len(w) for w in ws]
        hard = sum(self.model.score(w) > 0 for w in ws)
        tail = token.rstrip("\"'»)”]")
        self.rows.append((
            len(ws), sum(letters), sum(n >= 10 for n in letters), max(letters, default=0) * bool(ws), hard,
            tail.endswith((",", ";", ":", "—")), tail.endswith((".", "!", "?", "…")) and bool(ws), not ws and any(c.isdigit() for c in token),
        ))
        n = self[token] = len(self.rows) - 1
        return n

    def of(self, texts: list[str]) -> np.ndarray:
        """Feature vectors of texts."""
        if len(self) > 1_000_000:
            self.clear()
            self.rows = []
            self.table = self.table[:0]
        tokens = [t.split() for t in texts]
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ids = np.fromiter((self[x] for t in tokens for x in t), np.int64, int(counts.sum()))
        if len(self.table) != len(self.rows):
            self.table = np.array(self.rows, float).reshape(-1, len(_FEATURES))
        per = self.table[ids]
        text = np.repeat(np.arange(len(texts)), counts)
        sums = np.stack([np.bincount(text, weights=per[:, k], minlength=len(texts)) for k in range(per.shape[1])], axis=1)
        n = np.maximum(sums[:, 0], 1)
        self.worded = sums[:, 0] > 0  # of the texts just measured, which have words
        share = sums / n[:, None]
        # share of stretches of the text most of whose words are hard
        begin = np.cumsum(counts) - counts
        stretch = (np.arange(len(ids)) - np.repeat(begin, counts)) // STRETCH
        most = np.append(0, np.cumsum(-(-counts // STRETCH)))
        where = np.repeat(most[:-1], counts) + stretch
        w = np.bincount(where, weights=per[:, 0], minlength=most[-1])
        h = np.bincount(where, weights=per[:, 4], minlength=most[-1])
        dense = h > 0.5 * np.maximum(w, 1)
        owner = np.repeat(np.arange(len(texts)), np.diff(most))
        hard_stretches = np.bincount(owner, weights=dense * w, minlength=len(texts)) / n
        sentence = np.where(sums[:, 6] > 0, n / np.maximum(sums[:, 6], 1), np.nan)
        # without punctuation nothing is known of sentences, which then count as usual ones (nan);
        # each measure counts within the range in which it tells levels apart: long names, commas or words of
        # one language alone don't make a text specialist, nor do a few learned sentences
        return np.stack([
            np.clip(share[:, 1], 3, 6.5), np.minimum(share[:, 2], 0.2), np.log1p(np.clip(sentence, 1, 20)),
            np.where(np.isnan(sentence), np.nan, np.minimum(share[:, 5], 0.06)), np.minimum(share[:, 7], 0.1),
            np.clip((share[:, 4] - 0.3) / 0.25, 0, 1), np.clip((hard_stretches - 0.35) / 0.3, 0, 1),
        ], axis=1)


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Measures by their spread; what isn't known is usual."""
    return np.nan_to_num((x - mean) / scale)


class Ranker:
    """Scores and grades from feature vectors."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, knots: np.ndarray, levels: np.ndarray):
        self.mean, self.scale, self.weight, self.knots, self.levels = mean, scale, weight, knots, levels

    def score(self, x: np.ndarray) -> np.ndarray:
        return standard(x, self.mean, self.scale) @ self.weight

    def level(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.knots, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the knots and levels of the best increasing fit of y to x."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for a, b in zip(x[order], y[order]):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, hi = blocks.pop()
            p = blocks[-1]
            blocks[-1] = [(p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, p[2], hi]
    knots, levels = [], []
    for m, _, lo, hi in blocks:
        knots += [lo] if lo == hi else [lo, hi]
        levels += [m] if lo == hi else [m, m]
    return np.array(knots), np.array(levels)


def fit(texts: list[str], grades: list[int], rounds: int = 8, seed: int = 5) -> tuple[WordModel, Ranker]:
    """Word model, ranker and calibration from graded texts."""
    y = np.array(grades, float)
    if not len(y):
        return WordModel(-1.0, np.zeros(GROUPS)), Ranker(np.zeros(MEASURES), np.ones(MEASURES), np.zeros(MEASURES), np.array([0.0]), np.array([2.0]))
    words = [_WORD.findall(cleaned(t)) for t in texts]
    top = y == max(4, y.max())
    # the word features of a text come from a model that hasn't seen the text
    fold = np.array([xxhash.xxh32_intdigest(t) % 3 for t in texts])
    x = np.zeros((len(texts), MEASURES))
    for f in range(3):
        out = np.flatnonzero(fold == f)
        model = fit_words([words[i] for i in np.flatnonzero(fold != f)], top[fold != f])
        if len(out):
            x[out] = Measures(model).of([texts[i] for i in out])
    model = fit_words(words, top)
    known = ~np.isnan(x)
    mean = np.where(known, x, 0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
    scale = np.sqrt(np.where(known, (x - mean) ** 2, 0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)) + 1e-6
    z = standard(x, mean, scale)
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(y), (2, 20_000))
    keep = y[a] > y[b]
    diff, gap = z[a[keep]] - z[b[keep]], (y[a] - y[b])[keep]
    weight = np.zeros(x.shape[1])
    # pairs with a text of the highest grade count most, since it is this line that matters
    times = np.where(y[a[keep]] == y.max(), TOP_PAIRS, 1.0)
    for _ in range(rounds):  # squared hinge by Newton steps: the harder text leads by the difference of the grades
        short = diff @ weight < gap if weight.any() else np.ones(len(gap), bool)
        d, g = diff[short] * times[short, None] ** 0.5, gap[short] * times[short] ** 0.5
        weight = np.linalg.solve(d.T @ d + 1e-3 * len(diff) * np.eye(x.shape[1]) + 1e-9 * np.eye(x.shape[1]), d.T @ g)
    score = z @ weight
    knots, levels = isotonic(score, y)
    return model, Ranker(mean, scale, weight, knots, levels)


def reading_levels(documents: DataFrame, grades: DataFrame) -> DataFrame:
    """(doc_id, score, level): the ranker's score and the calibrated reading level of each document's
    whole text, null for texts without words.

    Rows with a null id give nothing, every other row gives one; null grades and grades of no document
    are left out; without any graded document all levels are 2; other columns are ignored.
    """
    graded = grades.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    n = graded.count()
    graded = graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // FIT_DOCUMENTS)))) == 0)  # at most about FIT_DOCUMENTS ids
    known = documents.where("text IS NOT NULL").select("doc_id", F.col("text").alias("t")).where(F.length("t") <= FIT_TEXT).join(F.broadcast(graded), "doc_id")
    size = known.agg(F.sum(F.length("t"))).first()[0] or 0
    if size > FIT_CHARACTERS:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(-(-size // FIT_CHARACTERS))) == 0)
    rows = sorted({(r[0], r[1], r[2]) for r in known.select("doc_id", "t", "grade").collect()})
    model, ranker = fit([r[1] for r in rows], [r[2] for r in rows])
    d_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        measures = Measures(model)
        for b in batches:
            texts, ids = b["t"].tolist(), b["doc_id"].to_numpy()
            for lo in range(0, len(texts), 2000):
                part = texts[lo : lo + 2000]
                x = measures.of(part)
                score = np.where(measures.worded, ranker.score(x), np.nan)
                yield pd.DataFrame({"doc_id": ids[lo : lo + 2000], "score": score, "level": np.where(np.isnan(score), np.nan, ranker.level(score))})

    own = documents.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    out = own.mapInPandas(run, f"doc_id {d_type}, score double, level double")
    return out.select("doc_id", *(F.when(~F.isnan(c), F.round(c, 4)).alias(c) for c in ("score", "level")))


def highest_grade(levels: DataFrame) -> DataFrame:
    """(doc_id) of the documents of the highest grade."""
    return levels.where(F.col("level") > HIGHEST).select("doc_id").distinct()


def level_profile(levels: DataFrame, documents: DataFrame) -> DataFrame:
    """(source, grade, documents): how many documents of each source have each rounded level."""
    source = documents.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.first("source").alias("source"))
    return levels.join(source, "doc_id", "left").groupBy("source", F.floor(F.col("level") + 0.5).cast("int").alias("grade")).agg(F.count("*").alias("documents"))

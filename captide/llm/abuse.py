"""Abusive, hateful and sexual content by a factorization machine over hashed terms.

The words of a window of WINDOW words are hashed; the machine adds a weight for each and one for each
pair of them, so that an insult counts together with whom it is said to. It is trained on documents that
people judged as a whole: of a flagged document the window that looks worst stands for it, of the others
every window counts, and so from round to round. Which words tell comes from the judged documents and
from how many of all documents have them; no word is known beforehand. What is left are few telling
terms, so a text is scored from where these stand in it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captide.llm.flat import Tokens
from captide.llm.turns import BLOCK
from captide.llm.words import CLEAN

#: Words of a window, number of hashed terms, factors of a term.
WINDOW, TERMS, FACTORS = 12, 1 << 20, 6
#: Bounds of the judged documents used for training: about so many, of so many characters together at
#: most, none longer than FIT_TEXT.
FIT_DOCUMENTS, FIT_CHARACTERS, FIT_TEXT = 6_000, 50_000_000, 1_000_000
#: A term tells if so many flagged texts have it, and so many times more often than all documents.
TELLING_TEXTS, TELLING_RATIO = 2, 3.0
#: A text is reported if its worst window's score exceeds this share of the score of a window without
#: telling terms (which is negative; a probability of one half is 0).
THRESHOLD_SHARE = 0.6

# Signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "€": "e", "!": "i", "|": "i"}
# Cyrillic letters that look like Latin ones.
TWINS = {"а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "и": "i", "к": "k", "м": "m", "о": "o", "р": "p", "т": "t", "х": "x", "у": "y"}
_TO_LATIN, _TO_CYRILLIC = str.maketrans(TWINS), str.maketrans({v: k for k, v in TWINS.items()})
_PLAIN = CLEAN | {c: None for c in range(0x300, 0x370)} | {ord("і"): "и"}
_CYRILLIC, _LATIN = re.compile(r"[Ѐ-ӿ]"), re.compile(r"[a-z]")
_MARKUP = re.compile(r"<[^<>]*>|&nbsp;|&#160;", re.I)
_INSIDE = re.compile(r"(?<=[\w@$€])[.*_·•'’\-~]+(?=[\w@$€])")
_STARS = re.compile(r"\w\*+\w")
_MASK_DROP = re.compile(r"[^\w\x01]")
_DOUBLE = re.compile(r"(.)\1+")
_NUMBER = re.compile(r"[\d:.,]+")
_PART = re.compile(r"[\w@$€*]+(?:[.·•\-~_*!|'’]+[\w@$€]+)*")
_LEET = str.maketrans(LEET)


def _one_script(word: str) -> str:
    """Lower case without accents; letters of the script that has fewer become their twins of the other."""
    w = unicodedata.normalize("NFKD", word).casefold().translate(_PLAIN)
    cyrillic, latin = len(_CYRILLIC.findall(w)), len(_LATIN.findall(w))
    if cyrillic and latin:
        w = w.translate(_TO_CYRILLIC if cyrillic >= latin else _TO_LATIN)
    return w


def token_key(word: str) -> str:
    """A word's form without case, accents, look-alikes, signs for letters and repeated letters."""
    w = _INSIDE.sub("", word)
    if any(c in LEET for c in w) and any(c.isalpha() for c in w):
        w = w.translate(_LEET)
    return _DOUBLE.sub(r"\1", re.sub(r"[^\w]", "", _one_script(w)))


def _hash(term: str) -> int:
    return xxhash.xxh32_intdigest(term) % (TERMS - 2) + 2


def _parts(token: str) -> list[str]:
    """What of a blank-separated token may be a word: a part, without mark-up."""
    if "<" in token or "&" in token:
        token = _MARKUP.sub(" ", token)
    return [token] if token.isalpha() else _PART.findall(unicodedata.normalize("NFKC", token))


class Terms:
    """Turns texts into flat arrays of hashed terms, one a word. Letters that stand apart are joined.

    ``known`` are words (as keys) that a word with stars for letters may stand for, the longest first."""

    def __init__(self, known: list[str] | None = None) -> None:
        self.known = known or []
        self.own = frozenset(self.known)
        self.tokens = Tokens(self._codes)
        self.single: dict[int, int] = {}

    def key(self, part: str) -> str:
        if self.known and "*" in part.strip("*") and _STARS.search(part):
            for stars in (part, re.sub(r"\*+", "*", part)):  # a star for each letter, or stars for one
                pattern = _MASK_DROP.sub("", _one_script(stars.replace("*", "\x01")))
                for word in self.known:
                    if len(word) == len(pattern) and all(a in ("\x01", b) for a, b in zip(pattern, word)):
                        return word
        return token_key(part)

    def _codes(self, token: str) -> list[int]:
        """Per word its hashed term; a lone letter is minus its code point, to be joined with its
        neighbours; a number is none."""
        out = []
        for part in _parts(token):
            if len(part) == 1 and (part.isalpha() or part in "@$013457"):
                out.append(-ord(part.casefold()))
            elif not _NUMBER.fullmatch(part) and (key := self.key(part)):
                out.append(_hash(key))
        return out

    def flat(self, texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
        flat, at = self.tokens.flat(texts, pad)
        alone = np.flatnonzero(flat < 0)
        if len(alone):
            cut = np.flatnonzero((np.diff(alone) != 1) | (np.searchsorted(at, alone[1:], side="right") != np.searchsorted(at, alone[:-1], side="right"))) + 1
            for run in np.split(alone, cut):
                if len(run) >= 3:
                    key = self._joined("".join(chr(-c) for c in flat[run].tolist()))
                    flat[run] = 0
                    flat[run[0]] = _hash(key) if key else 0
            rest = np.flatnonzero(flat < 0)
            if len(rest):
                flat[rest] = [self._letter(c) for c in flat[rest].tolist()]
        return flat, at

    def _joined(self, text: str) -> str:
        """The word of letters that stood apart; a word of one letter may lie at either end."""
        forms = [token_key(x) for x in (text, text[1:], text[:-1], text[1:-1])]
        return next((f for f in forms if f in self.own), forms[0])

    def _letter(self, code: int) -> int:
        if code not in self.single:
            key = token_key(chr(-code))
            self.single[code] = _hash(key) if key else 0
        return self.single[code]


class Machine:
    """w0 + sum of w + sum over pairs of the products of factors, over the terms of a window."""

    def __init__(self, bias: float, terms: np.ndarray, linear: np.ndarray, factors: np.ndarray, known: list[str] | None = None):
        self.bias, self.known = bias, known or []
        order = np.argsort(terms)
        self.terms, self.linear, self.factors = terms[order], linear[order], factors[order]
        self.slot = np.zeros(TERMS, np.int32)
        self.slot[self.terms] = np.arange(1, len(terms) + 1)

    @property
    def limit(self) -> float:
        """What the score of a case exceeds; a text without telling terms never does."""
        return max(self.bias * THRESHOLD_SHARE, self.bias + 1e-9)

    def telling(self, flat: np.ndarray) -> np.ndarray:
        """Positions of terms that count."""
        return np.flatnonzero(self.slot[flat])

    def worst(self, pos: np.ndarray, code: np.ndarray) -> np.ndarray:
        """For each telling term, at increasing positions, the score of the window that begins at it."""
        if not len(pos):
            return np.zeros(0)
        k = self.slot[code] - 1
        # where the same term stood before, for a window counts a term once
        order = np.lexsort((pos, k))
        before = np.full(len(pos), -1)
        same = k[order[1:]] == k[order[:-1]]
        before[order[1:][same]] = pos[order[:-1][same]]
        linear, total, squares = np.zeros(len(pos)), np.zeros((len(pos), FACTORS)), np.zeros(len(pos))
        v2 = (self.factors * self.factors).sum(axis=1)
        for step in range(min(WINDOW, len(pos))):
            i = np.arange(len(pos) - step)
            j = i + step
            ok = (pos[j] < pos[i] + WINDOW) & (before[j] < pos[i])
            i, t = i[ok], k[j[ok]]
            linear[i] += self.linear[t]
            total[i] += self.factors[t]
            squares[i] += v2[t]
        return self.bias + linear + 0.5 * ((total * total).sum(axis=1) - squares)

    def scores(self, terms: Terms, texts: list[str]) -> np.ndarray:
        """The score of the worst window of each text."""
        flat, at = terms.flat(texts, WINDOW)
        pos = self.telling(flat)
        out = np.full(len(texts), self.bias)
        np.maximum.at(out, np.searchsorted(at, pos, side="right") - 1, self.worst(pos, flat[pos]))
        return out


NOTHING = Machine(-1.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))


def _distinct(windows: np.ndarray) -> np.ndarray:
    """Each window's terms once."""
    x = np.sort(windows, axis=1)
    x[:, 1:][x[:, 1:] == x[:, :-1]] = 0
    return x


def texts_with(flat: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, texts): how many of the texts have each term; ``chosen`` are the terms to look at."""
    pos = np.flatnonzero(chosen[flat])
    text = np.searchsorted(at, pos, side="right") - 1
    return np.unique(np.unique(text.astype(np.int64) * TERMS + flat[pos]) % TERMS, return_counts=True)


def candidates(texts: list[str], flagged: list[int]) -> np.ndarray:
    """Which terms stand in TELLING_TEXTS flagged texts or more."""
    flat, at = Terms().flat([t for t, f in zip(texts, flagged) if f == 1], WINDOW)
    every = np.ones(TERMS, bool)
    every[0] = False
    term, n = texts_with(flat, at, every)
    out = np.zeros(TERMS, bool)
    out[term[n >= TELLING_TEXTS]] = True
    return out


def fit(texts: list[str], flagged: list[int], frequency: np.ndarray, documents: int, rounds: int = 4, epochs: int = 25, seed: int = 7) -> Machine:
    """A machine from judged texts. ``frequency`` tells of each of ``candidates`` how many of all
    ``documents`` have it."""
    label = np.array([f == 1 for f in flagged], bool)
    if not label.any():
        return NOTHING
    chosen = candidates(texts, flagged)
    bad_texts = [t for t, f in zip(texts, label) if f]
    common = frequency / max(1, documents)

    def telling(terms: Terms) -> np.ndarray:
        flat, at = terms.flat(bad_texts, WINDOW)
        term, n = texts_with(flat, at, chosen)
        ratio = np.zeros(TERMS)
        ratio[term] = n / len(bad_texts) / np.maximum(common[term], 1e-9) * (n >= TELLING_TEXTS)
        return np.where(ratio > TELLING_RATIO, np.log(np.maximum(ratio, 1)), 0)

    odds = telling(Terms())
    # the words that masked ones may stand for
    keys = {token_key(p) for t in bad_texts for x in t.split() for p in _parts(x) if "*" not in p}
    known = sorted((k for k in keys if len(k) > 3 and odds[_hash(k)] > 0), key=lambda k: (-len(k), k))
    terms = Terms(known)
    odds = telling(terms)
    flat, at = terms.flat(texts, WINDOW)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    codes = np.where(odds[flat] > 0, flat, 0)
    c = np.append(0, np.cumsum(odds[codes]))
    sums = np.append(c, np.full(WINDOW, c[-1]))[WINDOW:][: len(flat)] - c[: len(flat)]
    rng = np.random.default_rng(seed)
    vocabulary, dense = np.unique(codes, return_inverse=True)
    dense = np.append(dense, np.zeros(WINDOW, dense.dtype))
    win = np.lib.stride_tricks.sliding_window_view(dense, WINDOW)
    starts = np.flatnonzero(codes > 0)  # a window begins with a term that tells
    bad, good = starts[label[doc[starts]]], starts[~label[doc[starts]]]
    if not len(bad):
        return NOTHING
    machine = None
    for _ in range(rounds):
        # of each flagged text the window that looks worst, and its neighbours, which hold the same words
        value = sums[bad] if machine is None else _dense_scores(machine, win[bad])
        order = np.lexsort((value, doc[bad]))
        worst = bad[order[np.append(doc[bad][order[1:]] != doc[bad][order[:-1]], True)]]
        around = np.unique(np.concatenate([worst, *(np.maximum(worst - s, 0) for s in (1, 2))]))
        around = np.repeat(around[label[doc[around]]], 3)
        hard = good[:0]
        if machine is not None and len(good):
            by_score = good[np.argsort(-_dense_scores(machine, win[good]), kind="stable")[:4000]]
            hard = np.concatenate([by_score, np.repeat(by_score[:300], 20)])
        empty = np.full(max(len(around), 100), len(flat))  # a window without telling terms is no case
        machine = _train(win, np.concatenate([around, good, hard, empty]), len(around), len(vocabulary), epochs, rng, machine)
    bias, w, v = machine
    strength = np.abs(w) + np.sqrt((v * v).sum(axis=1))
    keep = np.flatnonzero((strength > 0.15) & (vocabulary > 0))
    return Machine(float(bias), vocabulary[keep], w[keep], v[keep], known)


def _dense_scores(machine: tuple, win: np.ndarray) -> np.ndarray:
    bias, w, v = machine
    out = np.empty(len(win))
    for lo in range(0, len(win), 50_000):
        x = _distinct(win[lo : lo + 50_000])
        vs = v[x]
        s = vs.sum(axis=1)
        out[lo : lo + 50_000] = bias + w[x].sum(axis=1) + 0.5 * ((s * s).sum(axis=1) - (vs * vs).sum(axis=(1, 2)))
    return out


def _train(win: np.ndarray, rows: np.ndarray, positives: int, size: int, epochs: int, rng: np.random.Generator, start: tuple | None) -> tuple:
    """Logistic loss, AdaGrad, classes of equal weight; term 0 is the empty place and stays zero. Equal
    windows are one row that counts as many times."""
    if start is None:
        bias, w, v = -1.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS))
        v[0] = 0
    else:
        bias, w, v = start[0], start[1].copy(), start[2].copy()
    y_all = np.zeros((len(rows), 1), np.int64)
    y_all[:positives] = 1
    unique, times = np.unique(np.hstack([y_all, _distinct(win[rows])]), axis=0, return_counts=True)
    y, windows = unique[:, 0], unique[:, 1:]
    gb, gw, gv = 1e-8, np.full(size, 1e-8), np.full((size, FACTORS), 1e-8)
    weight = np.where(y == 1, 0.3 * len(rows) / max(1, positives), 1.0) * times * (len(y) / len(rows))
    rate, decay = 0.1, 2e-4
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 512):
            b = order[lo : lo + 512]
            x = windows[b]
            vs = v[x]
            s = vs.sum(axis=1)
            z = bias + w[x].sum(axis=1) + 0.5 * ((s * s).sum(axis=1) - (vs * vs).sum(axis=(1, 2)))
            g = weight[b] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) / len(b)
            dw = np.bincount(x.reshape(-1), weights=np.repeat(g, WINDOW), minlength=size) + decay * w / 30
            dv = np.zeros_like(v)
            contrib = g[:, None, None] * (s[:, None, :] - vs)
            flat = x.reshape(-1)
            for f in range(FACTORS):
                dv[:, f] = np.bincount(flat, weights=contrib[:, :, f].reshape(-1), minlength=size)
            dv += decay * v / 30
            dw[0] = 0
            dv[0] = 0
            db = g.sum()
            gb += db * db
            gw += dw * dw
            gv += dv * dv
            bias -= rate * db / math.sqrt(gb)
            w -= rate * dw / np.sqrt(gw)
            v -= 0.5 * rate * dv / np.sqrt(gv)
    return bias, w, v


def _frequency(texts: DataFrame, chosen: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of all texts have each chosen term, and how many texts there are. Counted where the texts
    are read; what is collected are at most TERMS numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, total, seen = Terms(), np.zeros(TERMS, np.int64), 0
        for b in batches:
            rows = b["t"].tolist()
            for lo in range(0, len(rows), 2000):
                flat, at = terms.flat(rows[lo : lo + 2000], WINDOW)
                term, n = texts_with(flat, at, chosen)
                total[term] += n
            seen += len(rows)
        term = np.flatnonzero(total)
        yield pd.DataFrame({"term": np.append(term, 0).astype(np.int32), "n": np.append(total[term], seen)})

    counts = texts.mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS, np.int64)
    for term, n in counts:
        out[term] = n
    documents, out[0] = int(out[0]), 0
    return out, documents


def _trained(documents: DataFrame, labels: DataFrame) -> Machine:
    """A machine from the judged documents, within the bounds above, and the words of all documents."""
    judged = labels.where("doc_id IS NOT NULL AND flagged IS NOT NULL").groupBy("doc_id").agg(F.max("flagged").alias("flagged"))
    n = judged.count()
    judged = judged.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // FIT_DOCUMENTS)))) == 0)  # at most about FIT_DOCUMENTS ids
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("text").alias("t"))
    known = texts.where(F.length("t") <= FIT_TEXT).join(F.broadcast(judged), "doc_id")
    size = known.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = -(-size // FIT_CHARACTERS)
    if parts > 1:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(parts)) == 0)
    rows = sorted({(r[0], r[1], r[2]) for r in known.select("doc_id", "t", "flagged").collect()})
    own, flagged = [r[1] for r in rows], [r[2] for r in rows]
    if 1 not in flagged:
        return NOTHING
    return fit(own, flagged, *_frequency(texts.select("t"), candidates(own, flagged)))


def score_documents(documents: DataFrame, labels: DataFrame, machine: Machine | None = None) -> DataFrame:
    """(doc_id, score, found): the score of the worst window of each document's whole text.

    Null and empty texts have the score of a text without telling terms; rows with a null id give
    nothing; every other row gives one row; other columns are ignored. Without flagged documents the
    machine finds nothing.
    """
    machine = machine or _trained(documents, labels)
    d_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms(machine.known)
        for b in batches:
            texts = b["t"].tolist()
            for lo in range(0, len(texts), 2000):
                out = machine.scores(terms, texts[lo : lo + 2000])
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[lo : lo + 2000], "score": out, "found": out > machine.limit})

    own = documents.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return own.mapInPandas(run, f"doc_id {d_type}, score double, found boolean")


_EDGE = "pos array<int>, code array<int>"


def _lists(per: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    at = pa.array(np.append(0, np.cumsum(per)).astype(np.int32))
    return [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in values]


def score_videos(segments: DataFrame, documents: DataFrame, labels: DataFrame, machine: Machine | None = None) -> DataFrame:
    """(video_id, score, found): the score of the worst window of each video's segments in order, across
    their borders.

    Null ids, null and wordless texts give nothing; repeated rows count once (of different texts under
    one seg_idx the one with the least terms, in their order); other columns are ignored.

    Only the telling terms of a segment and their places are shuffled, by blocks of segments of a video. A
    block scores the windows that begin before its last WINDOW - 1 words. Those that begin there are
    scored in a second step, to which each block sends its length and the terms of its first and last
    words; so every window is seen whole, however many wordless segments or repeated rows lie inside it.
    """
    machine = machine or _trained(documents, labels)
    edge = WINDOW - 1

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(machine.known)
        for b in batches:
            flat, at = terms.flat(b.column(2).to_pylist(), 0)
            pos = machine.telling(flat)
            seg = np.searchsorted(at, pos, side="right") - 1
            lists = _lists(np.bincount(seg, minlength=b.num_rows), pos - at[seg], flat[pos])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int32)), *lists], names=["video_id", "seg_idx", "n", "pos", "code"])

    def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
        """The rows as tables that hold groups of equal keys whole; rows come in order of the keys."""
        rest: list = []
        for b in batches:
            if not b.num_rows:
                continue
            same = [np.asarray(b.column(k).to_numpy(zero_copy_only=False)) for k in keys]
            new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in same])) + 1
            if rest and any(rest[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys):
                yield pa.Table.from_batches(rest).combine_chunks()
                rest = []
            if len(new):
                yield pa.Table.from_batches([*rest, b.slice(0, new[-1])]).combine_chunks()
                rest = [b.slice(new[-1])]
            else:
                rest.append(b)
        if rest:
            yield pa.Table.from_batches(rest).combine_chunks()

    def flat_terms(t: pa.Table, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and code of each term."""
        pos, code = (t.column(c).chunk(0) if t.column(c).num_chunks else pa.array([], pa.list_(pa.int32())) for c in ("pos", "code"))
        row = np.repeat(np.arange(t.num_rows), np.diff(pos.offsets.to_numpy()))
        return row, begin[row] + pos.flatten().to_numpy(), code.flatten().to_numpy()

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["video_id", "block"]):
            video = t.column("video_id").to_numpy(zero_copy_only=False)
            block, n = t.column("block").to_numpy(), t.column("n").to_numpy()
            fresh = np.append(True, (video[1:] != video[:-1]) | (block[1:] != block[:-1]))
            group = np.cumsum(fresh) - 1
            words = np.bincount(group, weights=n).astype(np.int64)
            first = np.append(0, np.cumsum(words + WINDOW))[:-1]  # groups lie apart
            begin = np.append(0, np.cumsum(n))[:-1] + group * WINDOW
            row, place, code = flat_terms(t, begin)
            of = group[row]
            local = place - first[of]
            score = np.where(local < words[of] - edge, machine.worst(place, code), -np.inf)
            most = np.full(len(words), machine.bias)
            np.maximum.at(most, of, score)
            keep = (local < edge) | (local >= words[of] - edge)
            lists = _lists(np.bincount(of[keep], minlength=len(words)), local[keep], code[keep])
            arrays = [pa.array(video[fresh], pa.string()), pa.array(block[fresh].astype(np.int32)), pa.array(words), pa.array(most), *lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["video_id", "block", "words", "most", "pos", "code"])

    def tied(t: pa.Table, end: bool) -> tuple[pa.RecordBatch, pa.Table]:
        """The scores of the rows whose last windows are whole, and the rows that wait for what follows."""
        video, words = t.column("video_id").to_numpy(zero_copy_only=False), t.column("words").to_numpy()
        group = np.cumsum(np.append(True, video[1:] != video[:-1])) - 1
        begin = np.append(0, np.cumsum(words))[:-1] + group * WINDOW  # videos lie apart
        row, place, code = flat_terms(t, begin)
        most = t.column("most").to_numpy().copy()
        np.maximum.at(most, row, np.where(place - begin[row] >= words[row] - edge, machine.worst(place, code), -np.inf))
        later = np.cumsum(words[::-1])[::-1] - words
        n = t.num_rows if end else int(np.argmax((group == group[-1]) & (later < edge)))
        return pa.RecordBatch.from_arrays([pa.array(video[:n], pa.string()), pa.array(most[:n])], names=["video_id", "score"]), t.slice(n)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                scored, wait = tied(pa.Table.from_batches([*rest, b]).combine_chunks(), False)
                rest = wait.to_batches()
                yield scored
        if rest:
            yield tied(pa.Table.from_batches(rest).combine_chunks(), True)[0]

    own = segments.where("video_id IS NOT NULL AND seg_idx IS NOT NULL AND text IS NOT NULL").select("video_id", F.col("seg_idx").cast("int").alias("seg_idx"), F.col("text").alias("t"))
    sparse = own.mapInArrow(terms_of, f"video_id string, seg_idx int, n int, {_EDGE}").where("n > 0")
    blocks = sparse.withColumn("block", F.floor(F.col("seg_idx") / BLOCK).cast("int")).repartition("video_id", "block")
    once = blocks.groupBy("video_id", "block", "seg_idx").agg(F.min(F.struct("n", "pos", "code")).alias("x")).select("video_id", "block", "seg_idx", "x.*")
    by_block = once.sortWithinPartitions("video_id", "block", "seg_idx").mapInArrow(inside, f"video_id string, block int, words long, most double, {_EDGE}")
    ordered = by_block.repartition("video_id").sortWithinPartitions("video_id", "block")
    scored = ordered.mapInArrow(across, "video_id string, score double")
    return scored.groupBy("video_id").agg(F.max("score").alias("score")).withColumn("found", F.col("score") > machine.limit)


def score_items(documents: DataFrame, segments: DataFrame, videos: DataFrame, labels: DataFrame) -> DataFrame:
    """(scope, item_key, source, score, found): every document with its source and every video that has
    segments with words with its channel."""
    machine = _trained(documents, labels)
    docs = documents.where("doc_id IS NOT NULL").select("doc_id", "source")
    of_docs = score_documents(documents, labels, machine).join(docs.groupBy("doc_id").agg(F.first("source").alias("source")), "doc_id", "left")
    channel = videos.where("video_id IS NOT NULL").groupBy("video_id").agg(F.min("channel_id").alias("source"))
    of_videos = score_videos(segments, documents, labels, machine).join(channel, "video_id", "left")
    return of_docs.select(F.lit("document").alias("scope"), F.col("doc_id").cast("string").alias("item_key"), "source", F.round("score", 4).alias("score"), "found").unionByName(
        of_videos.select(F.lit("video").alias("scope"), F.col("video_id").alias("item_key"), "source", F.round("score", 4).alias("score"), "found")
    )


def found_items(documents: DataFrame, segments: DataFrame, labels: DataFrame) -> DataFrame:
    """(scope, item_key) of the documents and videos that hold such content at least once."""
    machine = _trained(documents, labels)
    docs = score_documents(documents, labels, machine).where("found").select(F.lit("document").alias("scope"), F.col("doc_id").cast("string").alias("item_key"))
    return docs.distinct().unionByName(score_videos(segments, documents, labels, machine).where("found").select(F.lit("video").alias("scope"), F.col("video_id").alias("item_key")))


def rates(scored: DataFrame) -> DataFrame:
    """(scope, source, items, found, rate) per source of documents and channel of videos."""
    return scored.groupBy("scope", "source").agg(F.count("*").alias("items"), F.sum(F.col("found").cast("int")).alias("found")).withColumn("rate", F.round(F.col("found") / F.col("items"), 4))

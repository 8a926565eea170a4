"""Token ids of whole texts by a public byte-level BPE vocabulary.

Everything runs on flat arrays: a batch of texts is one array of bytes, its words are stretches of it,
and the merges are done in rounds for all words that a worker hasn't met yet at once.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files, unless the setting ``spark.captide.tokenizers`` or a parameter names another.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text taken on at once, and words kept with their ids, per worker. A longer text is still one piece.
CHUNK_BYTES = 4_000_000
KEPT_WORDS = 1_000_000

_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = range(4)


def _classes() -> np.ndarray:
    """The class of every code point."""
    initial = "".join(map(unicodedata.category, map(chr, range(sys.maxunicode + 1))))[::2]
    a = np.frombuffer(initial.encode("ascii"), np.uint8)
    out = np.where(a == ord("L"), LETTER, np.where(a == ord("N"), NUMBER, OTHER)).astype(np.uint8)
    out[_SPACES] = SPACE
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[at].astype(np.int32)
    pad = np.concatenate([data, np.zeros(3, np.uint8)])
    cp = b.copy()
    for least, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        k = np.flatnonzero(b >= least)
        v = b[k] & mask
        for j in range(1, more + 1):
            v = (v << 6) | (pad[at[k] + j] & 0x3F)
        cp[k] = v
    return cp, at


def word_starts(cp: np.ndarray, kind: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Marks the code points at which a word of the vocabulary's pattern begins; no word crosses the
    start of a text."""
    n = len(cp)
    start = text_start.copy()
    start[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    k = kind[runs]
    # white space before something: its last character stands alone or, if a blank, leads the next word
    last_of_text = np.append(text_start[runs[1:]], True) if len(runs) else np.zeros(0, bool)
    w = np.flatnonzero((k == SPACE) & ~last_of_text)
    start[ends[w] - 1] = True
    led = w[cp[ends[w] - 1] == 32] + 1
    start[runs[led]] = False
    # 's 't 're 've 'm 'll 'd
    size = ends - runs
    lone = (k == OTHER) & (size == 1) & (cp[runs] == 39) & ~last_of_text
    lone[led] = False
    q = np.flatnonzero(lone)
    q = q[k[q + 1] == LETTER]
    a = cp[runs[q + 1]]
    b = cp[np.minimum(runs[q + 1] + 1, n - 1)]
    two = (size[q + 1] > 1) & (((a == 108) & (b == 108)) | (((a == 118) | (a == 114)) & (b == 101)))
    one = np.isin(a, [115, 116, 109, 100])
    for hit, length in ((one, 1), (two & ~one, 2)):
        r = q[hit] + 1
        start[runs[r]] = False
        longer = size[r] > length
        start[runs[r[longer]] + length] = True
    return start


class Vocabulary:
    """Merges as sorted arrays of pair keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        # the printable stand-ins of the 256 bytes
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.of_byte = np.array([ids[chars[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([(ids[a] << 20) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key = np.append(key[order], np.int64(1) << 62)
        self.rank = np.append(order, len(order)).astype(np.int64)
        self.merged = np.append(np.array([ids[a + b] for a, b in pairs], np.int64)[order], 0)

    def encode(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[first:first+size], flat, and how many each word has."""
        word = np.repeat(np.arange(len(first)), size)
        sym = self.of_byte[data[ragged(first, size)]]
        done_word, done_sym = [], []
        none = len(self.rank) - 1
        while len(sym):
            inside = word[:-1] == word[1:]
            key = np.where(inside, (sym[:-1] << 20) | sym[1:], -1)
            at = np.searchsorted(self.key, key)
            rank = np.append(np.where(self.key[at] == key, self.rank[at], none), none)
            begins = np.flatnonzero(np.append(True, ~inside))
            lengths = np.diff(np.append(begins, len(sym)))
            lowest = np.repeat(np.minimum.reduceat(rank, begins), lengths)
            over = lowest == none
            if over.any():
                done_word.append(word[over])
                done_sym.append(sym[over])
            hit = (rank == lowest) & ~over
            # of overlapping hits (one pair of equal symbols in a row) every other one, from the left
            follows = hit & np.append(False, hit[:-1]) & np.append(False, inside)
            if follows.any():
                i = np.arange(len(hit))
                origin = np.maximum.accumulate(np.where(hit & ~follows, i, 0))
                hit &= (i - origin) % 2 == 0
            h = np.flatnonzero(hit)
            sym[h] = self.merged[at[h]]
            keep = ~over
            keep[h + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_word:
            return np.zeros(0, np.int32), np.zeros(len(first), np.int64)
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(first))


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ..., first[1], ...: the indexes of all stretches one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


class Encoder:
    """Ids of texts; keeps the ids of words met before."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.kind = _classes()
        self.power = np.ones(0, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes, sorted
        self.slot = np.zeros(0, np.int64)  # and their place below
        self.bytes, self.byte_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.id_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _hashes(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        if len(self.power) < len(data):
            powers = np.full((2, len(data)), base)
            powers[1] = inverse
            powers[:, 0] = 1
            self.power, self.back = np.multiply.accumulate(powers, axis=1)
        total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], dtype=np.uint64))
        return (total[first + size] - total[first]) * self.back[first] * np.uint64(0xD6E8FEB86659FD93) + size.astype(np.uint64)

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text; text i is data[ends[i]:ends[i+1]]."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(ends) - 1, np.int64)
        cp, at = code_points(data)
        text_start = np.zeros(len(data), bool)
        text_start[ends[:-1][np.diff(ends) > 0]] = True
        first = at[word_starts(cp, self.kind[cp], text_start[at])]
        size = np.diff(np.append(first, len(data)))
        h = self._hashes(data, first, size)
        if len(self.known) > KEPT_WORDS:
            self.clear()
        new, where = np.unique(h, return_index=True)
        fresh = ~np.isin(new, self.known, assume_unique=True)
        new, where = new[fresh], where[fresh]
        if len(new):
            f, s = first[where], size[where]
            ids, counts = self.vocabulary.encode(data, f, s)
            slots = np.arange(len(new)) + len(self.known)
            place = np.searchsorted(self.known, new)
            self.known, self.slot = np.insert(self.known, place, new), np.insert(self.slot, place, slots)
            self.bytes = np.concatenate([self.bytes, data[ragged(f, s)]])
            self.byte_at = np.concatenate([self.byte_at, self.byte_at[-1] + np.cumsum(s)])
            self.ids = np.concatenate([self.ids, ids])
            self.id_at = np.concatenate([self.id_at, self.id_at[-1] + np.cumsum(counts)])
        slot = self.slot[np.searchsorted(self.known, h)]
        # a hash stands for one word only: every word is held against the bytes kept for it
        same = np.array_equal(self.byte_at[slot + 1] - self.byte_at[slot], size) and np.array_equal(self.bytes[ragged(self.byte_at[slot], size)], data)
        if same:
            counts = self.id_at[slot + 1] - self.id_at[slot]
            flat = self.ids[ragged(self.id_at[slot], counts)]
        else:
            flat, counts = self.vocabulary.encode(data, first, size)
        text = np.searchsorted(ends, first, side="right") - 1
        return flat, np.bincount(text, weights=counts, minlength=len(ends) - 1).astype(np.int64)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids array<int>): the token ids of each row's whole text, without special tokens.

    Null and empty texts have an empty list; strings that look like special tokens are ordinary text;
    every row gives one row, repeated rows and null ids too; other columns are ignored. ``path`` is the
    vocabulary file, by default ``VOCABULARY`` in the folder that ``spark.captide.tokenizers`` names.
    """
    spark = df.sparkSession
    path = path or os.path.join(spark.conf.get("spark.captide.tokenizers", TOKENIZERS), VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            text = batch.column(1).fill_null("").cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            raw = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
            lo = 0
            while lo < len(text):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, side="right")) - 1)
                ends = offsets[lo : hi + 1]
                flat, counts = encoder.encode(raw[ends[0] : ends[-1]], ends - ends[0])
                at = np.append(0, np.cumsum(counts)).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], names=[id_col, "ids"])
                lo = hi

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>"
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)

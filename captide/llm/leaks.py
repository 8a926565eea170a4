"""Documents that hold passages of evaluation texts."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow.dataset as pads
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captide.llm.flat import Tokens
from captide.llm.words import words
from captide.sources.shared import settled, shared_folder

#: Words of a fingerprinted window, and the greatest number of bits that two fingerprints of one passage differ by.
WINDOW, RADIUS = 8, 7
#: A word's weight is its rarity among the items (0 in all of N, 1 in one, by logarithms). Words of this rarity,
#: or of this share of the rarity of the item's rarest ones, tell an item apart; a window without one is a
#: stock phrase.
TELLING, RAREST = 0.85, 0.9
#: Share of the item's words that the stretch must span, share of these that must stand in it, and the
#: least weighted similarity of the word pairs of both sides.
SPAN, MATCHED, SIMILAR = 0.4, 0.7, 0.5
#: Words that may be altered, dropped or added between two matching stretches of one passage.
GAP_ITEM, GAP_TEXT = 4, 8
#: Items, and characters of them, that a worker holds at once; more are taken in blocks.
BLOCK_ITEMS, BLOCK_CHARACTERS = 20_000, 40_000_000
#: Characters of documents that are held against one block after another, where there are several.
ROUND_CHARACTERS = 50_000_000
#: Bits of a block of a fingerprint. Of RADIUS = 7 altered bits at most one lies in some block of four.
BLOCK_BITS = 16

_MARKUP = re.compile(r"<[^<>]*>|&nbsp;|&#160;", re.I)
_TIME = re.compile(r"[\[(<]?\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?[\])>]?[,.;]?")


def token_words(token: str) -> list[str]:
    """Folded words of a blank-separated token; times and mark-up are none."""
    if "<" in token or "&" in token:
        token = _MARKUP.sub(" ", token)
    if ":" in token:
        token = _TIME.sub(" ", token)
    return words(token)


class Index:
    """Fingerprints of all windows of the items, by blocks of BLOCK_BITS."""

    def __init__(self, items: list[tuple[int, str]], spread: dict[str, int] | None = None, total: int | None = None):
        """``spread``: in how many different items each word is, and ``total`` how many there are, where the
        items are only a block of all. Items of the same words are one."""
        same: dict[tuple[str, ...], list[int]] = {}
        for i, text in items:
            same.setdefault(tuple(w for t in text.split() for w in token_words(t)), []).append(i)
        same.pop((), None)
        texts, self.ids = list(same), list(same.values())
        spread = spread or Counter(w for ws in texts for w in set(ws))
        full = math.log(max(2, total or len(texts)))
        rarity = {w: 0.0 if w.isdigit() else max(0.0, 1 - math.log(max(1, spread[w])) / full) for w in {w for ws in texts for w in ws}}
        self.code = {w: k + 1 for k, w in enumerate(sorted(rarity))}
        n = len(self.code) + 1
        self.weight = np.zeros(n)
        sign = np.zeros((n, 64), np.int16)
        for w, k in self.code.items():
            self.weight[k] = 1 + 3 * min(1.0, rarity[w] / TELLING) ** 8
            bits = np.unpackbits(np.frombuffer(xxhash.xxh64_digest(w.encode()), np.uint8)).astype(np.int16)
            sign[k] = (2 * bits - 1) * round(4 * self.weight[k])
        self.sign = sign
        self.items = [np.array([self.code[w] for w in ws], np.int32) for ws in texts]
        self.telling = np.zeros(n, bool)
        for ws in texts:
            least = min(TELLING, RAREST * max(rarity[w] for w in ws))
            self.telling[[self.code[w] for w in ws if rarity[w] >= least]] = True
        rows = []
        for k, codes in enumerate(self.items):
            padded = np.append(codes, np.zeros(max(0, WINDOW - len(codes)), np.int32))
            win = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
            keep = np.flatnonzero(self.telling[win].any(axis=1))
            rows.append((np.full(len(keep), k), win[keep], keep))
        self.owner = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
        self.spot = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.int64)
        self.prints = self.fingerprints(np.concatenate([r[1] for r in rows])) if rows else np.zeros(0, np.uint64)
        blocks = self.prints.view(np.uint16).reshape(-1, 64 // BLOCK_BITS)
        self.order = [np.argsort(blocks[:, b], kind="stable") for b in range(blocks.shape[1])]
        self.begin = [np.searchsorted(blocks[o, b], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32) for b, o in enumerate(self.order)]

    def fingerprints(self, windows: np.ndarray) -> np.ndarray:
        """SimHash of each window: the signs of the weighted sums of its words' bits."""
        out = np.zeros((len(windows), 64), np.int16)
        for j in range(windows.shape[1]):
            out += self.sign[windows[:, j]]
        return np.packbits(out > 0, axis=1).view(np.uint64).reshape(-1)

    def near(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window number, number of the item's window) of all pairs of fingerprints within RADIUS: in some block
        of bits they differ in one bit at most, so each block is looked up as it is and with each bit turned."""
        prints, which = np.unique(self.fingerprints(windows), return_inverse=True)
        order, first = np.argsort(which, kind="stable"), np.append(0, np.cumsum(np.bincount(which, minlength=len(prints))))
        blocks = prints.view(np.uint16).reshape(-1, 64 // BLOCK_BITS)
        turned = np.append(np.uint16(0), np.uint16(1) << np.arange(BLOCK_BITS, dtype=np.uint16))
        for part in np.array_split(np.arange(len(prints)), max(1, len(prints) // 20_000)):
            found = []
            for b in range(blocks.shape[1]):
                at = (blocks[part, b][:, None] ^ turned).astype(np.int64)
                lo, size = self.begin[b][at], self.begin[b][at + 1] - self.begin[b][at]
                who, size = np.repeat(part, size.sum(axis=1)), size.reshape(-1)
                ends = np.cumsum(size, dtype=np.int64)
                cand = self.order[b][np.arange(len(who)) + np.repeat(lo.reshape(-1) - (ends - size), size)]
                ok = np.bitwise_count(prints[who] ^ self.prints[cand]) <= RADIUS
                found.append(who[ok] * len(self.prints) + cand[ok])
            who, cand = np.divmod(np.unique(np.concatenate(found)), max(1, len(self.prints)))
            times = first[who + 1] - first[who]  # the windows of one fingerprint
            ends = np.cumsum(times)
            yield order[np.arange(times.sum()) + np.repeat(first[who] - (ends - times), times)], np.repeat(cand, times)

    def may_hold(self, flat: np.ndarray, begin: int, k: int) -> bool:
        """Whether enough of item k's words stand near where they would if it began at ``begin``."""
        item = self.items[k]
        lo, hi = begin - GAP_TEXT, begin + len(item) + GAP_TEXT
        region = flat[max(lo, 0) : hi]
        if len(region) < hi - lo:
            region = np.concatenate([np.zeros(max(0, -lo), np.int32), region, np.zeros(max(0, hi - len(flat)), np.int32)])
        near = np.lib.stride_tricks.sliding_window_view(region, 2 * GAP_TEXT + 1)[: len(item)]
        return (near == item[:, None]).any(axis=1).sum() >= SPAN * MATCHED * len(item)

    def holds(self, text: np.ndarray, k: int) -> bool:
        """Whether the codes hold a stretch of item k: in order, long and like enough."""
        item = self.items[k]
        a, b = item.tolist(), np.where(text > 0, text, -1 - np.arange(len(text))).tolist()
        blocks = [m for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
        i = 0
        while i < len(blocks):
            j = i
            while j + 1 < len(blocks) and blocks[j + 1].a - (blocks[j].a + blocks[j].size) <= GAP_ITEM and blocks[j + 1].b - (blocks[j].b + blocks[j].size) <= GAP_TEXT:
                j += 1
            chain = blocks[i : j + 1]
            i = j + 1
            lo, hi = chain[0].a, chain[-1].a + chain[-1].size
            if hi - lo < SPAN * len(a):
                continue
            # the part of the chain where most weight is matched: a stock phrase beside a quote isn't part of it
            place = np.full(hi - lo, -1)
            for m in chain:
                place[m.a - lo : m.a - lo + m.size] = np.arange(m.b, m.b + m.size)
            gain = np.where(place >= 0, 1, -1) * self.weight[item[lo:hi]]
            for m, n in zip(chain, chain[1:]):  # words that the text adds count against it too
                gain[n.a - lo] -= max(0, n.b - m.b - (n.a - m.a))
            total = np.append(0, np.cumsum(gain))
            least = np.minimum.accumulate(total[:-1])
            y = int(np.argmax(total[1:] - least)) + 1
            x = int(np.argmin(total[:y]))
            held = place[x:y][place[x:y] >= 0]
            if y - x >= SPAN * len(a) and len(held) >= MATCHED * (y - x) and self._similar(a[lo + x : lo + y], b[held[0] : held[-1] + 1]) >= SIMILAR:
                return True
        return False

    def _similar(self, a: list[int], b: list[int]) -> float:
        """Weighted Jaccard similarity of the word pairs."""
        w = self.weight

        def pairs(x: list[int]) -> Counter:
            out: Counter = Counter()
            for p, q in zip(x, x[1:]):
                out[p, q] += (w[p] if p > 0 else 1) + (w[q] if q > 0 else 1)
            return out

        x, y = pairs(a), pairs(b)
        both, any_ = sum((x & y).values()), sum((x | y).values())
        return both / any_ if any_ else float(a == b)

    def scan(self, tokens: Tokens, texts: list[str]) -> list[tuple[int, int]]:
        """(text number, item id) of all leaks in the texts."""
        flat, at = tokens.flat(texts, WINDOW)
        spots = np.flatnonzero(self.telling[flat])
        if not len(spots) or not len(self.prints):
            return []
        starts = np.unique((spots[:, None] - np.arange(WINDOW)).reshape(-1))
        starts = starts[starts >= 0]
        text = np.searchsorted(at, starts, side="right") - 1
        inside = starts < at[text + 1] - WINDOW
        starts, text = starts[inside], text[inside]
        padded = np.append(flat, np.zeros(WINDOW, np.int32))
        windows = padded[starts[:, None] + np.arange(WINDOW)]
        keys = []
        for who, cand in self.near(windows):
            begin = starts[who] - self.spot[cand]  # where the item would begin
            keys.append(np.unique((text[who] * len(self.items) + self.owner[cand]) << 32 | begin + len(flat)))
        out, last, done = [], (-1, -1, 0), set()
        for key in np.unique(np.concatenate(keys)).tolist():
            (t, k), begin = divmod(key >> 32, len(self.items)), (key & 0xFFFFFFFF) - len(flat)
            if (t, k) in done or (t, k) == last[:2] and begin - last[2] < GAP_TEXT // 2:
                continue
            last = (t, k, begin)
            if self.may_hold(flat, begin, k):
                lo, hi = max(at[t], begin - 3 * GAP_TEXT), min(at[t + 1] - WINDOW, begin + len(self.items[k]) + 3 * GAP_TEXT)
                if self.holds(flat[lo:hi], k):
                    done.add((t, k))
                    out += [(t, i) for i in self.ids[k]]
        return out


_HELD: dict[tuple, tuple] = {}


def _held(key: tuple, build: Callable[[], Index]) -> tuple[Index, Tokens]:
    """The index of this key, built once in a worker's life; one at a time is kept."""
    if key not in _HELD:
        _HELD.clear()
        index = build()
        _HELD[key] = index, Tokens(lambda t: [index.code.get(w, 0) for w in token_words(t)])
    return _HELD[key]


def _form(texts: pd.Series) -> pd.Series:
    """The folded words of each text."""
    return texts.map(lambda t: " ".join(w for x in t.split() for w in token_words(x)))


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id): each document that holds at least SPAN of an item's words in one stretch and in
    order, apart from case, punctuation, white space, mark-up, inserted times, encoding and a few words.

    Null ids and texts, and texts and items without words, give nothing; repeated rows count once; an
    empty table gives no rows; other columns are ignored. Texts are read whole. The documents are read
    in one pass without a shuffle. A worker holds a block of items at a time; if there are several, they lie
    in the shared folder, and each round of documents is held against one after the other.
    """
    own = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    n, characters = own.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-characters // BLOCK_CHARACTERS))
    docs = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d IS NOT NULL AND t IS NOT NULL")
    d_type, i_type = docs.schema["d"].dataType.simpleString(), own.schema["i"].dataType.simpleString()
    if blocks == 1:
        rows = sorted((r[0], r[1]) for r in own.collect())  # within the bounds above
        index_of = lambda _: Index(rows)
    else:
        # the blocks lie in the shared folder, each with how many items have its words
        at = f"{shared_folder(documents.sparkSession)}/items-{uuid.uuid4().hex}"
        formed = settled(own.withColumn("f", F.pandas_udf(_form, "string")("t")).withColumn("b", F.pmod(F.xxhash64("f"), F.lit(blocks)).cast("int")))
        words_of = lambda df, *c: df.select(*c, F.explode(F.array_distinct(F.split("f", " "))).alias("w"))
        spread = words_of(formed.select("f").distinct()).groupBy("w").agg(F.count("*").alias("n"))
        formed.select("b", "i", "t").repartition("b").write.partitionBy("b").parquet(f"{at}/items")
        words_of(formed, "b").distinct().join(spread, "w").repartition("b").write.partitionBy("b").parquet(f"{at}/spread")
        total = formed.where("f != ''").select("f").distinct().count()
        present = {r[0] for r in formed.select("b").distinct().collect()}  # at most as many as blocks

        def index_of(b: int) -> Index:
            part, n = (pads.dataset(f"{at.removeprefix('file://')}/{x}/b={b}").to_table().to_pydict() if b in present else {"i": [], "t": [], "w": [], "n": []} for x in ("items", "spread"))
            return Index(sorted(zip(part["i"], part["t"])), dict(zip(n["w"], n["n"])), total)

    call = uuid.uuid4().hex

    def rounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if blocks == 1:
            yield from batches
            return
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += int(batch["t"].str.len().sum())
            if size > ROUND_CHARACTERS:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rounds(batches):
            texts, ids = batch["t"].tolist(), batch["d"].to_numpy()
            for b in range(blocks):
                index, tokens = _held((call, b), lambda b=b: index_of(b))
                found = []
                for lo in range(0, len(texts), 2000):
                    found += [(ids[lo + t], i) for t, i in index.scan(tokens, texts[lo : lo + 2000])]
                yield pd.DataFrame(found, columns=["d", "i"])

    return docs.mapInPandas(run, f"d {d_type}, i {i_type}").distinct().select(F.col("d").alias(doc_id), F.col("i").alias(item_id))


def leak_report(leaks: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, documents): how many documents hold each item; items that leaked nowhere have 0."""
    n = leaks.groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id", "suite").distinct().join(n, "item_id", "left").na.fill(0, ["documents"])

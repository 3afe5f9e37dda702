"""Benchmark decontamination by the q-gram lemma and banded alignment.

An item of ``m`` characters that occurs in a document with at most ``e`` edits
shares at least ``m - q + 1 - q * e`` character q-grams with it, all of them on
diagonals (document position minus item position) within a range of ``e``.
Shared q-grams are counted in diagonal bands that overlap by the edit budget;
bands that reach the bound are regions to verify, and a banded alignment of the
whole item against the region decides.

Letters count in lower case and every white-space character as a blank. The
edit budget of an item is ``rate`` of its length, at most ``max_edits`` where
that is given, and no more than leaves one q-gram for the bound. Shared q-grams
are expanded a bounded number at a time, however often one repeats. The index of the items is broadcast
in blocks of bounded size, one pass over the documents for each block, so a
large benchmark needs no large broadcast. Documents are never shuffled.

Defined results: null or empty documents hold nothing; items that are null or
shorter than ``q`` characters are not searched; repeated items are reported
under each of their ids; repeated rows give repeated results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 8
RATE = 0.1
#: Characters of benchmark text in one broadcast index.
BLOCK_CHARS = 1_000_000
#: Characters searched at once; longer documents are cut into overlapping pieces.
PIECE_CHARS = 500_000
#: Pairs of equal q-grams expanded at once.
HITS_AT_ONCE = 2_000_000
_SLOT_BITS = 21
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_END = 0x110000
_folds: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Lower case of every code point below 0x1F000 that has one; blanks become 32."""
    if not _folds:
        fold = np.arange(0x110001, dtype=np.uint32)
        for cp in range(0x1F000):
            c = chr(cp)
            low = c.lower()
            if c.isspace():
                fold[cp] = 32
            elif low != c and len(low) == 1:
                fold[cp] = ord(low)
        _folds.append(fold)
    return _folds[0]


def _codes(text: str) -> np.ndarray:
    return _fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _grams(codes: np.ndarray) -> np.ndarray:
    """The 8 characters from each position on, one byte of each, as integers.

    Equal q-grams give equal integers; the alignment settles the rest.
    """
    low = np.zeros(len(codes) + Q, np.uint8)
    low[: len(codes)] = (codes ^ (codes >> np.uint32(8))) & np.uint32(0xFF)
    return np.ndarray((len(codes),), "<u8", low, 0, (1,))


def _slots(grams: np.ndarray) -> np.ndarray:
    return ((grams * _MULTIPLIER) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


class Index:
    """All q-grams of a block of items, with a table of slots to look up first."""

    def __init__(self, ids: list, texts: list[str], rate: float = RATE, max_edits: int | None = None):
        self.ids, self.items = [], []
        for key, text in zip(ids, texts, strict=True):
            if isinstance(text, str) and len(text) >= Q:
                self.ids.append(key)
                self.items.append(_codes(text))
        self.sizes = np.array([len(c) for c in self.items], np.int64)
        self.edits = np.minimum((self.sizes * rate).astype(np.int64), (self.sizes - Q) // Q)
        if max_edits is not None:
            self.edits = np.minimum(self.edits, max_edits)
        self.bound = self.sizes - Q + 1 - Q * self.edits
        self.band = np.array([1 << max(4, int(e).bit_length()) for e in self.edits], np.int64)
        self.width = self.band + self.edits
        grams = [_grams(c)[: len(c) - Q + 1].copy() for c in self.items]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.post_item, self.post_at = item[order].astype(np.int32), at[order].astype(np.int32)
        self.grams, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every)).astype(np.int64)
        self.slot = np.zeros(1 << _SLOT_BITS, bool)
        self.slot[_slots(self.grams)] = True

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of every occurrence, in code points."""
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        if not self.items:
            return []
        overlap = int((self.sizes + 2 * self.width).max())
        held, size = [], 0
        for row, text in enumerate(texts):
            if not isinstance(text, str):
                continue
            for start in range(0, max(1, len(text)), PIECE_CHARS):
                piece = text[start : start + PIECE_CHARS + overlap]
                held.append((row, start, piece))
                size += len(piece) + Q
                if size >= PIECE_CHARS:
                    self._search(held, found)
                    held, size = [], 0
        if held:
            self._search(held, found)
        out = []
        for (row, item), spans in found.items():
            spans.sort()
            best = [spans[0]]
            for s in spans[1:]:
                if s[0] < best[-1][1]:
                    best[-1] = min(best[-1], s, key=lambda x: (x[2], x[0]))
                else:
                    best.append(s)
            out += [(row, item, *s) for s in best]
        return out

    def _search(self, pieces: list, found: dict) -> None:
        raw = ("\0" * Q).join(p for _, _, p in pieces) + "\0" * Q
        codes = _codes(raw)
        lengths = np.array([len(p) for _, _, p in pieces], np.int64)
        begins = np.concatenate(([0], np.cumsum(lengths + Q)[:-1]))
        grams = _grams(codes)
        at = np.flatnonzero(self.slot[_slots(grams)])
        if not len(at):
            return
        value = grams[at]
        place = np.minimum(np.searchsorted(self.grams, value), len(self.grams) - 1)
        same = self.grams[place] == value
        at, place = at[same], place[same]
        count = self.first[place + 1] - self.first[place]
        if not len(at):
            return
        piece_of = np.searchsorted(begins, at, side="right") - 1
        base = -int(self.sizes.max()) // 16 - 2
        spread = int(lengths.max()) // 16 + 2 - base
        keys, hits, done = [], [], np.concatenate(([0], np.cumsum(count)))
        cut = np.unique(np.concatenate((np.searchsorted(done, np.arange(0, done[-1], HITS_AT_ONCE)), [len(at)])))
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            n = count[x:y]
            post = np.repeat(self.first[place[x:y]] - (done[x:y] - done[x]), n) + np.arange(done[y] - done[x])
            piece, item = np.repeat(piece_of[x:y], n), self.post_item[post].astype(np.int64)
            diagonal = np.repeat(at[x:y] - begins[piece_of[x:y]], n) - self.post_at[post]
            band = diagonal // self.band[item]
            again = diagonal - band * self.band[item] < self.edits[item]
            key = (piece * len(self.items) + item) * spread + (band - base)
            own, times = np.unique(np.concatenate((key, key[again] - 1)), return_counts=True)
            keys.append(own)
            hits.append(times)
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        hits = np.bincount(back, np.concatenate(hits)).astype(np.int64)
        own = key // spread
        enough = hits >= self.bound[own % len(self.items)]
        key, own = key[enough], own[enough]
        for k in np.unique(own % len(self.items)).tolist():
            mine = own % len(self.items) == k
            where = own[mine] // len(self.items)
            low = (key[mine] % spread + base) * self.band[k]
            self._verify(k, pieces, codes, begins, lengths, where, low, found)

    def _verify(self, k: int, pieces: list, codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray, where: np.ndarray, low: np.ndarray, found: dict) -> None:
        item = self.items[k]
        reach = len(item) + int(self.width[k]) - 1
        for a in range(0, len(where), 256):
            w, lo = where[a : a + 256], low[a : a + 256]
            column = lo[:, None] + np.arange(reach)
            inside = (column >= 0) & (column < lengths[w][:, None])
            region = np.where(inside, codes[np.clip(begins[w][:, None] + column, 0, len(codes) - 1)], _END)
            exact = np.array([_at(region[g], item) for g in range(len(w))], np.int64)
            for g in np.flatnonzero(exact >= 0).tolist():
                row, offset, _ = pieces[w[g]]
                start = offset + int(lo[g] + exact[g])
                found[(row, k)].append((start, start + len(item), 0))
            w, lo, region = w[exact < 0], lo[exact < 0], region[exact < 0]
            if not len(w):
                continue
            cost, end = _align(item, region)
            good = np.flatnonzero(cost <= self.edits[k])
            if len(good):
                _, back = _align(item[::-1], region[good][:, ::-1])
                for g, b in zip(good.tolist(), back.tolist(), strict=True):
                    row, offset, text = pieces[w[g]]
                    start = min(max(int(lo[g]) + reach - b, 0), len(text))
                    stop = min(max(int(lo[g]) + int(end[g]), start), len(text))
                    found[(row, k)].append((offset + start, offset + stop, int(cost[g])))


def _at(region: np.ndarray, item: np.ndarray) -> int:
    """Where the item stands unchanged (an alignment along one diagonal), or -1."""
    whole, part = region.astype("<u4").tobytes(), item.astype("<u4").tobytes()
    at = whole.find(part)
    while at % 4 and at >= 0:
        at = whole.find(part, at + 1)
    return at // 4 if at >= 0 else -1


def _align(item: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits of the whole item against part of each region, and where
    that part ends; the diagonals are those that the region leaves room for."""
    m, width = len(item), region.shape[1] - len(item) + 1
    kind = np.int16 if m < 15_000 else np.int32
    slide = np.arange(width, dtype=kind)
    d = np.zeros((len(region), width), kind)
    for i in range(m):
        nxt = d + (region[:, i : i + width] != item[i])
        np.minimum(nxt[:, :-1], d[:, 1:] + kind(1), out=nxt[:, :-1])
        d = np.minimum.accumulate(nxt - slide, axis=1) + slide
    best = d.argmin(1)
    return d[np.arange(len(d)), best], best + m


def _blocks(benchmark: DataFrame, item_id: str, text: str, rate: float, max_edits: int | None) -> Iterator[Index]:
    items = benchmark.select(F.col(item_id).alias("id"), F.col(text).cast("string").alias("text")).where(F.length("text") >= Q)
    chars = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect()
        yield Index([r["id"] for r in rows], [r["text"] for r in rows], rate, max_edits)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", *, rate: float = RATE, max_edits: int | None = None) -> DataFrame:
    """One row per benchmark item found in a document: ``doc_id``, ``item_id``,
    ``start``, ``end`` (code points) and ``edits``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("__doc"), F.col(text).cast("string").alias("__text"))
    kind = benchmark.schema[item_id].dataType.simpleString()
    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, `{item_id}` {kind}, start long, `end` long, edits int"

    def found_by(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                hits = shared.value.search(batch["__text"].tolist())
                if hits:
                    row, item, start, end, edits = (list(x) for x in zip(*hits, strict=True))
                    yield pd.DataFrame({doc_id: batch["__doc"].to_numpy()[row], item_id: [shared.value.ids[i] for i in item], "start": start, "end": end, "edits": np.array(edits, np.int32)})

        return rows.mapInPandas(search, schema)

    parts = [found_by(index) for index in _blocks(benchmark, item_id, item_text, rate, max_edits)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", *, rate: float = RATE, max_edits: int | None = None) -> Column:
    """A column with the number of benchmark passages in each text of ``docs``."""

    def counted(index: Index) -> Column:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @F.pandas_udf("long")
        def count(texts: pd.Series) -> pd.Series:
            out = np.zeros(len(texts), np.int64)
            for row, *_ in shared.value.search(texts.tolist()):
                out[row] += 1
            return pd.Series(out)

        return count(F.col(text).cast("string"))

    return reduce(lambda total, index: total + counted(index), _blocks(benchmark, item_id, item_text, rate, max_edits), F.lit(0))

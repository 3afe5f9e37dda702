"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams per language over every labelled row; each task
adds its counts before one small aggregation. The log-probability matrix has a
fixed size (languages x buckets) and is broadcast; batches are scored in numpy.

Defined results: text that is null or has no letter is ``und`` with score 0;
rows with a null label are not learned from; ties go to the label that sorts
first; without any labelled row every prediction is ``und``; repeated rows give
repeated results. Input columns other than those named are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (2, 3, 4)
BITS = 15
#: Characters scored at once within a batch.
BLOCK_CHARS = 400_000
#: From so many n-grams on, a text is scored from its counts rather than gram by gram.
DENSE = 4_000
#: More labels than this are refused: the matrix is broadcast.
MAX_LANGUAGES = 512
UNDETERMINED = "und"

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Lower-case code point of every letter; 32 for all else."""
    if not _letters:
        fold = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                fold[cp] = ord(c.lower()[0])
        _letters.append(fold)
    return _letters[0]


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded letters of all texts with single blanks between words.

    Returns codes, start and end of every text. Texts are set apart by four
    blanks, so that no n-gram sees two texts.
    """
    gap = "    "
    joined = gap.join(t if isinstance(t, str) else "" for t in texts) + gap
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) if isinstance(t, str) else 0 for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths + len(gap)) - len(gap)
    starts = ends - lengths
    codes = _letter_table()[np.minimum(raw, 0x10FFFF)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    place = np.concatenate(([0], np.cumsum(keep)))
    codes = np.concatenate((codes[keep], np.full(8, 32, np.uint32)))
    return codes, place[starts], place[ends]


def _buckets(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    n = len(codes) - 7
    h = np.full(n, order * 0x165667B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h = (h ^ codes[k : k + n]) * _MULTIPLIERS[k]
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if i > first and size + n > BLOCK_CHARS:
            yield first, i
            first, size = i, 0
        size += n + 4
    if first < len(texts):
        yield first, len(texts)


def _counts(texts: list[str | None], orders: tuple[int, ...], bits: int) -> np.ndarray:
    total = np.zeros(1 << bits, np.int64)
    for a, b in _runs(texts):
        codes, starts, ends = _codes(texts[a:b])
        for order in orders:
            last = ends - order + 1
            ok = last > starts
            step = np.zeros(len(codes) + 1, np.int32)
            np.add.at(step, starts[ok], 1)
            np.add.at(step, last[ok], -1)
            inside = np.cumsum(step)[: len(codes) - 7] > 0
            total += np.bincount(_buckets(codes, order, bits)[inside], minlength=1 << bits)
    return total


@dataclass(frozen=True)
class LanguageModel:
    """Sorted labels, log priors and a float32 matrix (buckets x labels)."""

    labels: tuple[str, ...]
    prior: np.ndarray
    log_prob: np.ndarray
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Labels and their posterior probability for whole texts."""
        labels, scores = [], np.zeros(len(texts))
        if not self.labels:
            return [UNDETERMINED] * len(texts), scores
        for a, b in _runs(texts):
            codes, starts, ends = _codes(texts[a:b])
            total = np.tile(self.prior, (b - a, 1)).astype(np.float64)
            found = [(_buckets(codes, order, self.bits), order) for order in self.orders]
            for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                own = np.concatenate([grams[s : max(s, e - order + 1)] for grams, order in found])
                if len(own) > DENSE:
                    total[i] += np.bincount(own, minlength=1 << self.bits).astype(np.float32) @ self.log_prob
                elif len(own):
                    total[i] += self.log_prob[own].sum(0)
            letter = np.add.reduceat(np.concatenate((codes != 32, [False])).astype(np.int64), np.stack((starts, np.maximum(ends, starts)), 1).ravel())[0::2]
            letter[ends <= starts] = 0
            best = total.argmax(1)
            odds = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            for i in range(b - a):
                if letter[i]:
                    labels.append(self.labels[best[i]])
                    scores[a + i] = odds[i]
                else:
                    labels.append(UNDETERMINED)
        return labels, scores


def fit(docs: DataFrame, text: str = "text", label: str = "lang", *, where: Column | None = None, orders: tuple[int, ...] = ORDERS, bits: int = BITS, alpha: float = 0.1) -> LanguageModel:
    """Learn from every row of ``docs`` with a label (and ``where``, if given)."""

    rows = docs if where is None else docs.where(where)
    rows = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for name, part in batch.groupby("label", sort=False)["text"]:
                if name not in held and len(held) >= MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} distinct labels")
                held[name] = held.get(name, 0) + _counts(part.tolist(), orders, bits)
                seen[name] = seen.get(name, 0) + len(part)
        for name, counts in held.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"label": name, "bucket": np.append(at, -1).astype(np.int32), "n": np.append(counts[at], seen[name])})

    counted = rows.mapInPandas(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    labels = tuple(sorted(counted["label"].unique()))
    if len(labels) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct labels")
    matrix, prior = np.zeros((1 << bits, len(labels))), np.zeros(len(labels))
    for j, name in enumerate(labels):
        own = counted[counted["label"] == name]
        grams = own[own["bucket"] >= 0]
        matrix[grams["bucket"].to_numpy(), j] = grams["n"].to_numpy()
        prior[j] = own.loc[own["bucket"] < 0, "n"].sum()
    matrix = np.log(matrix + alpha) - np.log(matrix.sum(0) + alpha * (1 << bits))
    prior = np.log(prior) - np.log(prior.sum()) if len(labels) else prior
    return LanguageModel(labels, prior, matrix.astype(np.float32), orders, bits)


def judged(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """Per row a struct (label, score) of its text; only the text reaches Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("label string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        labels, scores = shared.value.predict(texts.tolist())
        return pd.DataFrame({"label": pd.Series(labels, dtype=object), "score": scores})

    return judge(F.col(text).cast("string"))


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text", *, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Columns ``keep`` of every row, its predicted label and posterior (0 to 1).

    A kept column named like one of the results gives way to it.
    """
    kept = [F.col(c) for c in keep if c not in (pred, score)]
    out = docs.select(*kept, judged(docs, model, text).alias("__judged"))
    return out.select(*(c for c in keep if c not in (pred, score)), F.col("__judged.label").alias(pred), F.col("__judged.score").alias(score))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of documents that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))

"""Document scores by the masked pseudo-likelihood of a window network.

Each token is hidden and predicted from the two tokens on either side by a
small network (position-weighted embeddings, tanh, a softmax in three levels of
16 branches); the conditional log-probabilities of all tokens of a document add
up to its score.

Tokens are words, counted over all documents: the most frequent ``WORDS`` have
symbols of their own, all others share ``HASHED`` symbols by hash, so the
network has a fixed size and can be broadcast. The softmax is over all 4,096
symbols exactly, at the cost of 48 outputs a token.

Training is data-parallel in numpy. Documents are dealt by a hash of id and text to
``ROUNDS`` rounds and, within each, to as many shards as the number of tokens in the
corpus asks for (``SHARD_TOKENS`` each). All shards of a round start from the same
weights, learn from every position of their documents in the order of that
hash, and are averaged by the number of positions. So the network depends on the
rows and not on how they are stored or dealt to tasks. Only symbols, two bytes a
token, are shuffled. Weights are added up in parts that stream through tasks.

Defined results: null, empty or blank text has no token, sum 0 and a null mean;
a text of one word is predicted from padding; repeated rows give repeated
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellpath.llm._tables import materialise
from fellpath.llm._words import blocks, hash_words

#: Branches of a level, and levels; symbols are words of their own, then hashed ones; one more pads.
BRANCHES, LEVELS = 16, 3
SYMBOLS = BRANCHES**LEVELS
HASHED = 512
WORDS = SYMBOLS - HASHED
SIDE, WIDTH = 2, 16
ROUNDS, RATE, BATCH = 2, 0.1, 4096
SCORE_ROWS = 32_768
#: Weights that travel in one row.
PART = 8_192
#: Tokens of a shard, on average, and tokens learned from at once.
SHARD_TOKENS, BLOCK_TOKENS = 4_000_000, 200_000
SEED = 20231


@dataclass
class Network:
    """Sorted hashes of the words with symbols, their symbols, and weights.

    ``out[k]`` and ``bias[k]`` hold for each node of level k the weights of its
    branches; a symbol's digits to the base ``BRANCHES`` are its way down."""

    known: np.ndarray
    symbol: np.ndarray
    embed: np.ndarray
    place: np.ndarray
    out: list[np.ndarray]
    bias: list[np.ndarray]
    squares: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fresh(cls, known: np.ndarray, symbol: np.ndarray) -> Network:
        rng = np.random.RandomState(SEED)
        nodes = [BRANCHES**k for k in range(LEVELS)]
        embed = (rng.randn(SYMBOLS + 1, WIDTH) * 0.3).astype(np.float32)
        out = [(rng.randn(n, WIDTH, BRANCHES) * 0.1).astype(np.float32) for n in nodes]
        return cls(known, symbol, embed, np.ones((2 * SIDE, WIDTH), np.float32), out, [np.zeros((n, BRANCHES), np.float32) for n in nodes])

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.place, *self.out, *self.bias]

    def weights(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def with_weights(self, flat: np.ndarray) -> Network:
        parts, at = [], 0
        for like in self.arrays():
            parts.append(flat[at : at + like.size].astype(like.dtype).reshape(like.shape))
            at += like.size
        return Network(self.known, self.symbol, parts[0], parts[1], parts[2 : 2 + LEVELS], parts[2 + LEVELS :])

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = (WORDS + (hashes % np.uint64(HASHED)).astype(np.int64)).astype(np.int32)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            own = self.known[at] == hashes
            out[own] = self.symbol[at[own]]
        return out

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = np.zeros((len(around), WIDTH), self.embed.dtype)
        for k in range(2 * SIDE):
            total += (self.embed * self.place[k]).take(around[:, k], axis=0)
        return np.tanh(total, out=total)

    def _level(self, k: int, hid: np.ndarray, target: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
        """Of sorted targets: runs (node, start, end) of nodes of level ``k`` on the way to
        them, and for every branch of those nodes logits less their largest, and exponents."""
        node = target // BRANCHES ** (LEVELS - k)
        cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
        runs = [(int(node[i]), i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i]
        logits = np.empty((len(node), BRANCHES), hid.dtype)
        for n, i, j in runs:
            np.matmul(hid[i:j], self.out[k][n], out=logits[i:j])
            logits[i:j] += self.bias[k][n]
        logits -= _largest(logits)[:, None]
        return runs, logits, np.exp(logits)

    def log_prob(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        order = np.argsort(target.astype(np.uint16), kind="stable")
        target, rows, total = target[order], np.arange(len(order)), np.zeros(len(order))
        hid = self.hidden(around[order])
        for k in range(LEVELS):
            _, logits, powers = self._level(k, hid, target)
            total += logits[rows, target // BRANCHES ** (LEVELS - 1 - k) % BRANCHES] - np.log(_sums(powers))
        out = np.empty_like(total)
        out[order] = total
        return out

    def gradient(self, around: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log-probability, by array."""
        order = np.argsort(target.astype(np.uint16), kind="stable")
        around, target, n = around[order], target[order], len(order)
        rows, hid = np.arange(n), self.hidden(around)
        back, outs, biases = np.zeros_like(hid), [np.zeros_like(x) for x in self.out], [np.zeros_like(x) for x in self.bias]
        for k in range(LEVELS):
            runs, _, d = self._level(k, hid, target)
            d /= _sums(d)[:, None]
            d[rows, target // BRANCHES ** (LEVELS - 1 - k) % BRANCHES] -= 1
            d /= n
            biases[k][[r[0] for r in runs]] = np.add.reduceat(d, [r[1] for r in runs])
            for node, i, j in runs:
                part = d[i:j]
                outs[k][node] = hid[i:j].T @ part
                back[i:j] += part @ self.out[k][node].T
        back *= 1 - hid * hid
        embed, place = np.zeros_like(self.embed), np.zeros_like(self.place)
        # Of the steps that reach an embedding, those of one side at a time: one sum per side and symbol.
        by_width = np.ascontiguousarray(back.T, np.float64)
        for k in range(2 * SIDE):
            summed, seen = np.empty(self.embed.shape), around[:, k].astype(np.intp)
            for w in range(WIDTH):
                summed[:, w] = np.bincount(seen, by_width[w], SYMBOLS + 1)
            embed += summed * self.place[k]
            place[k] = (summed * self.embed).sum(0)
        return [embed, place, *outs, *biases]

    def learn(self, around: np.ndarray, target: np.ndarray) -> None:
        """One pass of minibatch gradient descent, each weight by the size of its past steps."""
        self.squares = self.squares or [np.full_like(x, 1e-10) for x in self.arrays()]
        for a in range(0, len(target), BATCH):
            for weight, square, step in zip(self.arrays(), self.squares, self.gradient(around[a : a + BATCH], target[a : a + BATCH]), strict=True):
                square += step * step
                weight -= RATE * step / np.sqrt(square)


def _largest(rows: np.ndarray) -> np.ndarray:
    """The largest of every row of ``BRANCHES`` numbers, all rows at once."""
    while rows.shape[1] > 1:
        half = rows.shape[1] // 2
        rows = np.maximum(rows[:, :half], rows[:, half:])
    return rows[:, 0]


def _sums(rows: np.ndarray) -> np.ndarray:
    """The sum of every row of ``BRANCHES`` numbers, all rows at once, in the order of ``sum``."""
    rows = rows[:, : BRANCHES // 2] + rows[:, BRANCHES // 2 :]
    while rows.shape[1] > 1:
        rows = rows[:, ::2] + rows[:, 1::2]
    return rows[:, 0]


def _contexts(raw: list[bytes], net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols around every token, the tokens, and offsets of the texts."""
    hashes, offsets = hash_words(raw)
    target = net.symbols(hashes)
    return _around(target, offsets), target, offsets


def _around(target: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The symbols on both sides of every token of texts that begin at ``offsets``."""
    texts = len(offsets) - 1
    padded = np.full(len(target) + SIDE * (texts + 1), SYMBOLS, np.int32)
    at = np.arange(len(target)) + SIDE * (np.repeat(np.arange(texts), np.diff(offsets)) + 1)
    padded[at] = target
    return np.stack([padded[at + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))], 1) if len(at) else np.zeros((0, 2 * SIDE), np.int32)


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (h, n): occurrences of every word, by hash, in all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [hash_words(raw)[0] for _, raw in blocks(batch["text"].tolist())]
            words, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            yield pd.DataFrame({"h": words.view(np.int64), "n": n.astype(np.int64)})

    return docs.select(F.col(text).cast("string").alias("text")).mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _mean(learned: DataFrame) -> np.ndarray | None:
    """Weights of all tasks, averaged by their positions; rows are (part, w, n)."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for batch in batches:
            for part, w, count in zip(batch["part"].tolist(), batch["w"].tolist(), batch["n"].tolist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(w, np.float32).astype(np.float64) * count
                n[part] = n.get(part, 0) + count
        for part, own in total.items():
            yield pd.DataFrame({"part": [part], "w": [np.round(own / n[part], 6).astype(np.float32).tobytes()]})

    rows = learned.repartition(F.col("part")).mapInPandas(add, "part int, w binary").collect()
    return np.concatenate([np.frombuffer(r["w"], np.float32) for r in sorted(rows, key=lambda r: r["part"])]) if rows else None


def _learned(own: Network, texts: list[bytes]) -> int:
    """Learn from texts of symbols in order; how many positions they have."""
    learned, first, size = 0, 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or size > BLOCK_TOKENS:
            part = texts[first:i]
            offsets = np.concatenate(([0], np.cumsum([len(t) // 2 for t in part], dtype=np.int64)))
            target = np.frombuffer(b"".join(part), np.uint16).astype(np.int32)
            if len(target):
                own.learn(_around(target, offsets), target)
            learned, first, size = learned + len(target), i, 0
        if i < len(texts):
            size += len(texts[i]) // 2
    return learned


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, rounds: int = ROUNDS, shard_tokens: int | None = None) -> Network:
    """Learn from every position of every document of ``docs``."""
    words = materialise(count_words(docs, text), "words")
    tokens = words.agg(F.sum("n")).first()[0] or 0
    common = words.orderBy(F.desc("n"), "h").limit(WORDS).collect()
    hashes = np.array([r["h"] for r in common], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    net = Network.fresh(hashes[order], order.astype(np.int32))
    shards = max(1, -(-tokens // (rounds * (shard_tokens or SHARD_TOKENS))))
    body = F.col(text).cast("string")
    key = F.xxhash64(F.col(doc_id), body) if doc_id in docs.columns else F.xxhash64(body)
    rows = docs.where(body.isNotNull()).select(key.alias("key"), body.alias("text"))
    for turn in range(rounds):
        start = docs.sparkSession.sparkContext.broadcast(net)

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                told: list[bytes] = []
                for _, raw in blocks(batch["text"].tolist()):
                    found, offsets = hash_words(raw)
                    symbols = start.value.symbols(found).astype(np.uint16)
                    told += [symbols[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pd.DataFrame({"key": batch["key"], "shard": batch["shard"], "s": told})

        def learn(part: pd.DataFrame) -> pd.DataFrame:
            own = start.value.with_weights(start.value.weights())
            learned = _learned(own, part.sort_values(["key", "s"])["s"].tolist())
            if not learned:
                return pd.DataFrame({"part": np.zeros(0, np.int32), "w": [], "n": np.zeros(0, np.int64)})
            flat = own.weights().astype(np.float32)
            parts = [flat[a : a + PART].tobytes() for a in range(0, len(flat), PART)]
            return pd.DataFrame({"part": np.arange(len(parts), dtype=np.int32), "w": parts, "n": np.int64(learned)})

        own = rows.where(F.pmod("key", F.lit(rounds)) == turn).withColumn("shard", F.pmod(F.shiftright("key", 8), F.lit(shards)))
        symbols = own.mapInPandas(encode, "key long, shard long, s binary")
        mean = _mean(symbols.groupBy("shard").applyInPandas(learn, "part int, w binary, n long"))
        if mean is not None:
            net = net.with_weights(mean)
    return net


def score(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, ``pll`` (sum of log-probabilities) and
    ``mean_pll`` (per token)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, total = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for first, raw in blocks(batch["__text"].tolist()):
                around, target, offsets = _contexts(raw, shared.value)
                found = [shared.value.log_prob(around[a : a + SCORE_ROWS], target[a : a + SCORE_ROWS]) for a in range(0, len(target), SCORE_ROWS)]
                running = np.concatenate((np.zeros(1), np.cumsum(np.concatenate(found), dtype=np.float64))) if found else np.zeros(1)
                n[first : first + len(raw)] = np.diff(offsets)
                total[first : first + len(raw)] = running[offsets[1:]] - running[offsets[:-1]]
            yield pd.DataFrame({doc_id: batch[doc_id], "n_tokens": n, "pll": total})

    rows = docs.select(F.col(doc_id), F.col(text).cast("string").alias("__text"))
    out = rows.mapInPandas(apply, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, pll double")
    return out.withColumn("mean_pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")))

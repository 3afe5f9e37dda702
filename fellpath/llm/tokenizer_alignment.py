"""Alignment of the tokens that two tokenizers make of the same document.

Both encode the whole text: A the text after a space, B the text, to which it
adds the space itself. Where a token of A and one of B end at the same byte the
document is cut; between two cuts lies a group. Shared ends in front of tokens
of both sides that begin with a space are the anchors: they split a document
into windows of token ids, mostly words, whose alignment is remembered by the
ids of both sides (packed, 4 bytes each), so that a word is walked token by token once a task.

A is run by the byte-pair encoder of ``tiktoken``, built from the vocabulary and
the pattern of A's own file: it gives the same ids in a third of the time.

Links are the pairs of tokens that end together. Their corpus-wide counts, by
pair of ids, are summed per task before the shuffle; up to ``BROADCAST_PAIRS``
pairs are sent to all tasks, more are joined by shuffle.

The tokenizers are read once by the driver and sent to the tasks as they are
(at most ``MODEL_BYTES`` each), so executors need no file of their own.

Defined results: texts that are null or empty, or whose tokens do not spell
``space + text`` exactly (text with U+2581, for instance), have no tokens, all
numbers are zero and the digest is ''. Repeated rows count and return once
each; a null id stays null; other columns are not touched; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellpath.llm._tables import materialise

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: A tokenizer's file may be as long as this.
MODEL_BYTES = 64_000_000
#: Pairs of ids (16 bytes each) that are broadcast at most.
BROADCAST_PAIRS = 4_000_000
#: Windows a task remembers; then it begins anew.
REMEMBERED = 500_000
#: Characters encoded at once.
BLOCK_CHARS = 500_000

#: Fixed value: how a byte-level vocabulary of this kind splits text before merging.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _letters_of_bytes() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 for itself, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


@dataclass
class Pair:
    """Both tokenizers, with the bytes of every id."""

    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]

    def __post_init__(self) -> None:
        self.a_len, self.b_len = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_space, self.b_space = (np.array([x.startswith(b" ") for x in side]) for side in (self.a_bytes, self.b_bytes))
        self.told = [str(i) for side in (self.a_bytes, self.b_bytes) for i in range(len(side))]
        self.size = [len(x) for side in (self.a_bytes, self.b_bytes) for x in side]
        self.memo: dict[bytes, str] = {}

    @classmethod
    def load(cls, byte_bpe: bytes, piece_bpe: bytes) -> Pair:
        import sentencepiece
        import tiktoken

        told = json.loads(byte_bpe)
        if told["model"]["type"] != "BPE" or told["pre_tokenizer"]["type"] != "ByteLevel" or told.get("normalizer"):
            raise ValueError("not a byte-level vocabulary")
        letters = _letters_of_bytes()
        spelled = {bytes(map(letters.__getitem__, t)): i for t, i in told["model"]["vocab"].items() if all(c in letters for c in t) and t not in {x["content"] for x in told["added_tokens"]}}
        a = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=spelled, special_tokens={})
        b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        pieces = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]
        of_id = {i: t for t, i in spelled.items()}
        return cls(a, b, [of_id.get(i, b"") for i in range(max(of_id, default=-1) + 1)], pieces)

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both sides for each text, encoded in blocks of bounded length."""
        first, size = 0, 0
        for i in range(len(texts) + 1):
            if i == len(texts) or (i > first and size + len(texts[i]) > BLOCK_CHARS):
                part = texts[first:i]
                if part:
                    yield from zip((self.a.encode_ordinary(" " + t) for t in part), self.b.encode(part, num_threads=1), strict=True)
                first, size = i, 0
            if i < len(texts):
                size += len(texts[i])

    def window(self, key: bytes) -> str:
        """The groups of one window as text; ``key`` holds its ids, those of B after those of A."""
        ids = array("i", key)
        n_a = sum(map(len(self.a_bytes).__gt__, ids))
        told, size = self.told, self.size
        groups, first_a, first_b, i, j = [], 0, n_a, 1, n_a + 1
        end_a, end_b = size[ids[0]], size[ids[n_a]]
        while True:
            if end_a < end_b:
                end_a += size[ids[i]]
                i += 1
            elif end_b < end_a:
                end_b += size[ids[j]]
                j += 1
            else:
                groups.append(",".join([told[x] for x in ids[first_a:i]]) + "|" + ",".join([told[x] for x in ids[first_b:j]]))
                if i == n_a:
                    break
                first_a, first_b = i, j
                end_a += size[ids[i]]
                end_b += size[ids[j]]
                i += 1
                j += 1
        if len(self.memo) >= REMEMBERED:
            self.memo.clear()
        known = self.memo[key] = ";".join(groups)
        return known

    def align(self, text: str, a: list[int], b: list[int]) -> tuple[int, int, np.ndarray, str]:
        """Numbers of tokens, keys of the links and groups as text of one document."""
        raw = b" " + text.encode("utf-8", "surrogatepass")
        none = 0, 0, np.zeros(0, np.int64), ""
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return none
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(self.a_len[ids_a]), np.cumsum(self.b_len[ids_b])
        # The encoder of A splits bytes and merges them, so that only their number can differ.
        if end_a[-1] != len(raw):
            return none
        held = np.zeros((2, len(raw) + 1), bool)
        held[0, end_a] = True
        held[1, end_b] = True
        last_a, last_b = np.flatnonzero(held[1, end_a]), np.flatnonzero(held[0, end_b])
        links = ids_a[last_a] * len(self.b_bytes) + ids_b[last_b]
        anchor = np.append(self.a_space[ids_a[last_a[:-1] + 1]] & self.b_space[ids_b[last_b[:-1] + 1]], True)
        to_a, to_b = last_a[anchor] + 1, last_b[anchor] + 1
        windows = np.empty(len(a) + len(b), np.int32)
        windows[np.arange(len(a)) + np.repeat(np.append(0, to_b[:-1]), np.diff(to_a, prepend=0))] = ids_a
        windows[np.arange(len(b)) + np.repeat(to_a, np.diff(to_b, prepend=0))] = ids_b + len(self.a_bytes)
        packed, ends = windows.tobytes(), (4 * (to_a + to_b)).tolist()
        known, walk = self.memo.get, self.window
        groups = [known(key := packed[first:end]) or walk(key) for first, end in zip([0, *ends], ends, strict=False)]
        return len(a), len(b), links, ";".join(groups)


_loaded: dict[tuple[str, str], Pair] = {}


def _read(spark: SparkSession, path: str) -> bytes:
    """A tokenizer's file, by Spark's reader, so that it may lie in any store."""
    found = spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("length", "content")
    if found.select("length").first()[0] > MODEL_BYTES:
        raise ValueError(f"{path} is longer than {MODEL_BYTES} bytes")
    return bytes(found.first().content)


def aligned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, keep_groups: bool = False) -> DataFrame:
    """Per row: ``doc_id``, n_a, n_b, n_groups, n_links, groups_sha256, its distinct
    links ``keys`` (id of A x ids of B + id of B) with their numbers ``times``, and
    ``b_ids``, how many ids B has; with ``keep_groups`` also ``groups`` as text."""
    spark = docs.sparkSession
    models = spark.sparkContext.broadcast((_read(spark, byte_bpe), _read(spark, piece_bpe)))
    name = (byte_bpe, piece_bpe)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _loaded:
            _loaded[name] = Pair.load(*models.value)
        pair = _loaded[name]
        for batch in batches:
            # Copies within a batch are aligned once.
            places: dict[str, int] = {}
            which = [places.setdefault(t if isinstance(t, str) else "", len(places)) for t in batch["__text"]]
            texts, done = list(places), []
            for body, (a, b) in zip(texts, pair.encode(texts), strict=True):
                n_a, n_b, links, spelled = pair.align(body, a, b) if body else (0, 0, np.zeros(0, np.int64), "")
                keys, times = np.unique(links, return_counts=True)
                done.append((n_a, n_b, len(links), hashlib.sha256(spelled.encode()).hexdigest() if spelled else "", keys, times.astype(np.int32), spelled if keep_groups else None))
            out = {name: [done[k][n] for k in which] for n, name in enumerate(("n_a", "n_b", "n_groups", "groups_sha256", "keys", "times", "groups"))}
            frame = pd.DataFrame(out, index=batch.index)
            frame.insert(0, "__id", batch["__id"])
            frame["n_links"], frame["b_ids"] = frame["n_groups"], len(pair.b_bytes)
            yield frame[["__id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times", "b_ids", "groups"]]

    kind = rows.schema["__id"].dataType.simpleString()
    found = rows.mapInPandas(scan, f"__id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<int>, b_ids long, groups string")
    return found.withColumnRenamed("__id", doc_id) if keep_groups else found.drop("groups").withColumnRenamed("__id", doc_id)


def link_counts(found: DataFrame) -> DataFrame:
    """Rows (key, count, best): how many links hold a pair of ids, and whether no
    pair with the same id of B is held by more."""
    one = found.select("b_ids", F.explode(F.arrays_zip("keys", "times")).alias("x"))
    counted = one.groupBy("b_ids", F.col("x.keys").alias("key")).agg(F.sum("x.times").alias("count"))
    counted = materialise(counted, "links")
    highest = counted.groupBy((F.col("key") % F.col("b_ids")).alias("b")).agg(F.max("count").alias("most"))
    return counted.join(highest, F.col("key") % F.col("b_ids") == F.col("b")).select("key", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: str) -> DataFrame:
    """Per row: ``doc_id``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    found = materialise(aligned(docs, doc_id, text, **options).withColumn("__row", F.monotonically_increasing_id()), "aligned")
    counts = materialise(link_counts(found), "link-counts")
    columns = [doc_id, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if counts.count() > BROADCAST_PAIRS:
        links = found.select("__row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("__row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
        sums = links.join(counts, "key").groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
        return found.join(sums, "__row", "left").fillna(0, ["n_best", "count_sum"]).select(*columns)
    table = counts.toPandas().sort_values("key")
    known = spark.sparkContext.broadcast(tuple(table[c].to_numpy(t) for c, t in (("key", np.int64), ("count", np.int64), ("best", np.int64))))

    @F.pandas_udf("n_best long, count_sum long")
    def summed(keys: pd.Series, times: pd.Series) -> pd.DataFrame:
        key, count, best = known.value
        lengths = np.fromiter((len(k) for k in keys), np.int64, len(keys))
        sums = np.zeros((2, len(keys)), np.int64)
        if lengths.sum():
            at = np.searchsorted(key, np.concatenate(keys.tolist()))
            n = np.concatenate(times.tolist()).astype(np.int64)
            for row, value in zip(sums, (best, count), strict=True):
                total = np.concatenate(([0], np.cumsum(value[at] * n)))
                ends = np.cumsum(lengths)
                row[:] = total[ends] - total[ends - lengths]
        return pd.DataFrame({"n_best": sums[0], "count_sum": sums[1]})

    return found.withColumn("__sums", summed("keys", "times")).select(*columns[:5], "__sums.n_best", "__sums.count_sum", "groups_sha256")

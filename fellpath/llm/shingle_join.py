"""N-gram Jaccard join: documents whose sets of word shingles are near equal.

Two documents link when ``den * |A & B| >= num * |A | B|`` over their distinct
five-word shingles. The result gives the connected classes of all links; no
link between different texts is lost, and copies are never expanded to pairs.

How a link is found:

1. Equal sets collapse to their smallest document by digest.
2. Prefix filter: with any fixed order of all shingles, two linked documents
   share a shingle among the first ``n - ceil(num/den * n) + 1`` of each. The
   order is by how many documents hold a shingle, rare first, then by hash.
   Counts come from one table of 2^23 hashed counters, summed over all
   documents; counters that several shingles share make the order less good,
   never the result less exact.
3. Prefix shingles with the same documents are one list; each distinct list is
   compared once. Lists are told apart by sums of hashes, never collected.
4. Stars: every document is compared with the smallest document of its lists;
   most groups of near copies become one class here, at a cost linear in size.
5. Tiles: in lists that still span several classes, documents outside the
   leading class meet each other and that class. Documents are put in bands of
   size (a factor ``den/num`` each; a pair is in the same or in neighbouring
   bands), large lists are cut into blocks, and hashed bitmap signatures, as
   wide as their sets ask for, are compared in bulk: differing bits bound the
   overlap from above.
6. Pairs that pass are decided by intersecting their sorted shingle arrays;
   only their texts are read and sent again.

Defined results: null, empty or blank text has no shingle and links with
nothing; rows with equal ids and several texts link as one node; a null id
links with nothing; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fellpath.llm._tables import materialise
from fellpath.llm._words import blocks, hash_words, mix64, shingles
from fellpath.operators.components import connected_components

WIDTH, NUM, DEN = 5, 80, 100
#: Counters of the table that orders shingles, and of one of its rows.
COUNTER_BITS, CHUNK_BITS = 23, 13
#: Least bits of a signature, rows of a tile's block.
SIGNATURE_BITS, BLOCK_ROWS = 1024, 512
#: Shingles of the texts that meet in one task on each side.
TILE_SHINGLES = 250_000
#: Ids up to this count are broadcast to select texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _sets(batch: pd.DataFrame, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, raw in blocks(batch["text"].tolist()):
        for i, own in enumerate(shingles(*hash_words(raw), width)):
            yield first + i, own


def _slots(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _signature(own: np.ndarray) -> bytes:
    """A bitmap with one hashed bit per shingle, of two to four bits for each."""
    width = max(SIGNATURE_BITS, 1 << max(2 * len(own) - 1, 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(own >> np.uint64(8)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _fold(sig: bytes, words: int) -> np.ndarray:
    """A bitmap as ``words`` 64-bit words; wider ones are folded onto themselves."""
    return np.bitwise_or.reduce(np.frombuffer(sig, np.uint64).reshape(-1, words))


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """A row (id, gone, tx, n, d1, d2, sig) per document, and rows (chunk, counts):
    each task's counters of how many of its documents hold a shingle."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << COUNTER_BITS, np.uint32)
        none = pd.array([None], "Int64")
        for batch in batches:
            for first, raw in blocks(batch["text"].tolist()):
                n, d1, d2, sig = [], [], [], []
                for own in shingles(*hash_words(raw), width):
                    n.append(len(own))
                    d1.append(own.sum(dtype=np.uint64))
                    d2.append(mix64(own).sum(dtype=np.uint64))
                    sig.append(_signature(own))
                    counts[_slots(own)] += np.uint32(1)
                part = batch.iloc[first : first + len(n)]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "gone": part["gone"].to_numpy(), "tx": pd.array(part["tx"], "Int64"), "n": pd.array(n, "Int32"), "d1": np.array(d1, np.uint64).view(np.int64), "d2": np.array(d2, np.uint64).view(np.int64), "sig": sig, "chunk": none.repeat(len(n)), "counts": None})
        parts = counts.reshape(-1, 1 << CHUNK_BITS)
        for first in range(0, len(parts), 128):
            held = [k for k in range(first, min(first + 128, len(parts))) if parts[k].any()]
            packed = [zlib.compress(parts[k].astype(np.min_scalar_type(int(parts[k].max()))).tobytes(), 1) for k in held]
            yield pd.DataFrame({"id": 0, "gone": True, "tx": none.repeat(len(held)), "n": pd.array([None] * len(held), "Int32"), "d1": 0, "d2": 0, "sig": None, "chunk": pd.array(held, "Int64"), "counts": packed})

    return docs.mapInPandas(scan, "id long, gone boolean, tx long, n int, d1 long, d2 long, sig binary, chunk long, counts binary")


def _order_table(counts: DataFrame) -> np.ndarray:
    """The order class of every counter in one byte: eight steps for each doubling.

    Tasks add up the rows of a chunk as they stream in, so what is held is at
    most one table whatever the number of rows; 2^23 bytes reach the driver.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        size = 1 << CHUNK_BITS
        for batch in batches:
            for chunk, packed in zip(batch["chunk"].tolist(), batch["counts"].tolist(), strict=True):
                raw = zlib.decompress(packed)
                own = np.frombuffer(raw, np.dtype(f"u{len(raw) // size}"))
                total[chunk] = total.get(chunk, 0) + own.astype(np.int64)
        for chunk, own in total.items():
            steps = np.minimum(np.log2(np.maximum(own, 1)) * 8, 255).astype(np.uint8)
            yield pd.DataFrame({"chunk": [chunk], "steps": [zlib.compress(steps.tobytes(), 1)]})

    table = np.zeros((1 << (COUNTER_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.uint8)
    summed = counts.select("chunk", "counts").repartition(F.col("chunk")).mapInPandas(add, "chunk long, steps binary")
    for row in summed.toLocalIterator():
        table[row["chunk"]] = np.frombuffer(zlib.decompress(row["steps"]), np.uint8)
    return table.ravel()


def _prefixes(docs: DataFrame, table: np.ndarray, width: int, num: int, den: int) -> DataFrame:
    """Rows (h, id, n): the prefix shingles of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def prefix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = shared.value
        for batch in batches:
            ids = batch["id"].to_numpy()
            for first, raw in blocks(batch["text"].tolist()):
                hs, ns, at = [], [], []
                for i, own in enumerate(shingles(*hash_words(raw), width)):
                    if len(own):
                        keep = len(own) - (num * len(own) + den - 1) // den + 1
                        hs.append(own[np.argsort(steps[_slots(own)], kind="stable")[:keep]])
                        ns.append(len(own))
                        at.append(first + i)
                if hs:
                    lengths = [len(x) for x in hs]
                    yield pd.DataFrame({"h": np.concatenate(hs).view(np.int64), "id": np.repeat(ids[at], lengths), "n": np.repeat(np.array(ns, np.int32), lengths)})

    return docs.mapInPandas(prefix, "h long, id long, n int")


def _may_link(na: np.ndarray, nb: np.ndarray, differing: np.ndarray, num: int, den: int) -> np.ndarray:
    """Each differing bit stands for at least one shingle of one side only, so
    2 * overlap <= na + nb - differing; a link needs (num + den) * overlap >=
    num * (na + nb)."""
    return (num + den) * (na + nb - differing) >= 2 * num * (na + nb)


def _bounded(pairs: DataFrame, held: DataFrame, num: int, den: int) -> DataFrame:
    """The ``pairs`` (a, b) whose signatures allow a link."""

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = np.zeros(len(batch), bool)
            for k, (na, x, nb, y) in enumerate(zip(batch["n_a"].tolist(), batch["sig_a"].tolist(), batch["n_b"].tolist(), batch["sig_b"].tolist(), strict=True)):
                words = min(len(x), len(y)) // 8
                near[k] = _may_link(na, nb, int(np.bitwise_count(_fold(x, words) ^ _fold(y, words)).sum(dtype=np.int64)), num, den)
            yield batch.loc[near, ["a", "b"]]

    for side in "ab":
        pairs = pairs.join(held.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}")), side)
    return pairs.select("n_a", "sig_a", "n_b", "sig_b", "a", "b").mapInPandas(bound, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Decide by the intersection of two sorted arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
    both = int((y[at] == x).sum()) if len(x) else 0
    return both > 0 and den * both >= num * (len(x) + len(y) - both)


def _decided(near: DataFrame, held: DataFrame, rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The links among candidate pairs (a, b), written.

    Ends are dealt to buckets by hash; a pair is decided where the bucket of
    one end meets that of the other, so a text travels once to each meeting it
    has a pair in, and each meeting holds about ``TILE_SHINGLES`` a side.
    """
    near = materialise(near.distinct(), "near-pairs")
    ends = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
    total = held.join(ends, "id", "left_semi").agg(F.sum("n")).first()[0] or 0
    spread = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(math.ceil(total / TILE_SHINGLES), math.isqrt(2 * spread) + 1)

    def bucket(end: str) -> Column:
        return F.pmod(F.xxhash64(end), F.lit(buckets)).cast("int")

    asked = near.select(bucket("a").alias("t0"), bucket("b").alias("t1"), "a", "b")
    need = materialise(asked.select("t0", "t1", F.col("a").alias("id")).union(asked.select("t0", "t1", "b")).distinct(), "near-needs")
    if need.count() <= BROADCAST_IDS:
        need = F.broadcast(need)
    texts = rows.join(need, "id").select("t0", "t1", "id", "text")

    def decide(texts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        sets: dict[int, list[np.ndarray]] = defaultdict(list)
        ids = texts["id"].tolist()
        for i, own in _sets(texts, width):
            sets[ids[i]].append(own)
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        linked = []
        for a, b in zip(asked["a"].tolist(), asked["b"].tolist(), strict=True):
            if top(a) != top(b) and any(_linked(x, y, num, den) for x in sets[a] for y in sets[b]):
                root[top(a)] = top(b)
                linked.append((a, b))
        return pd.DataFrame(linked, columns=["a", "b"], dtype=np.int64)

    return materialise(texts.groupBy("t0", "t1").cogroup(asked.groupBy("t0", "t1")).applyInPandas(decide, "a long, b long"), "links")


def _tiles(rows: DataFrame, held: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs (a, b) of different classes that share a list ``h``; ``rows``: h, id, n, root.

    In each list and band the class of the smallest root leads. The others meet
    in block pairs with each other and with the leading class, whose documents
    never meet among themselves.
    """
    step = float(np.log(den / num)) if den > num else 1.0
    band = F.floor(F.log(F.col("n")) / F.lit(step)).cast("int")
    rows = rows.withColumn("own", band).withColumn("band", F.explode(F.array(band, band + 1)))
    spans = rows.groupBy("h", "band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("rows")).where("r0 < r1")
    rows = rows.join(spans.select("h", "band", "r0"), ["h", "band"]).withColumn("leads", F.col("root") == F.col("r0"))
    sizes = rows.groupBy("h", "band").agg(*(F.greatest(F.ceil(F.count(F.when(c, 1)) / BLOCK_ROWS), F.lit(1)).cast("int").alias(x) for c, x in ((F.col("leads"), "n_lead"), (~F.col("leads"), "n_rest"))))
    rows = rows.join(sizes, ["h", "band"])
    block = F.pmod(F.xxhash64("id"), F.when(F.col("leads"), F.col("n_lead")).otherwise(F.col("n_rest"))).cast("int")
    rows = rows.withColumn("block", F.when(F.col("leads"), -1 - block).otherwise(block))
    # A leading block meets every other block; an other block meets all blocks.
    rows = rows.withColumn("other", F.explode(F.when(F.col("leads"), F.sequence(F.lit(0), F.col("n_rest") - 1)).otherwise(F.sequence(-F.col("n_lead"), F.col("n_rest") - 1))))
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    rows = rows.join(held.select("id", "sig"), "id")

    key = ["h", "band", "lo", "hi"]
    tiles = rows.select(*key, "id", "n", "root", (F.col("own") == F.col("band")).alias("own"), "block", "sig").repartition(*key).sortWithinPartitions(*key)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tile in _whole_tiles(batches, key):
            found = _compare(tile, num, den)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return tiles.mapInPandas(compare, "a long, b long").where("a <> b").distinct()


def _whole_tiles(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Tiles of several rows from sorted batches; a tile that goes on in the next batch waits for it."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if rest is None else pd.concat((rest, batch), ignore_index=True)
        values = rows[key].to_numpy()
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                yield rows.iloc[a:b]
        rest = rows.iloc[cuts[-1] :]
    if rest is not None and len(rest) > 1:
        yield rest


def _compare(tile: pd.DataFrame, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of one tile that may link; each pair is taken in one band and one block pair."""
    ids, n, root, block = (tile[c].to_numpy(np.int64) for c in ("id", "n", "root", "block"))
    own, within = tile["own"].to_numpy(bool), bool(tile["lo"].iloc[0] == tile["hi"].iloc[0])
    held = tile["sig"].tolist()
    words = min(map(len, held)) // 8
    sig = np.stack([_fold(s, words) for s in held])
    found = []
    for i in range(len(ids) - 1):
        js = np.arange(i + 1, len(ids))
        small, large = np.minimum(n[i], n[js]), np.maximum(n[i], n[js])
        js = js[(root[i] != root[js]) & (own[i] | own[js]) & (within | (block[i] != block[js])) & (den * small >= num * large)]
        if len(js):
            differing = np.bitwise_count(sig[i] ^ sig[js]).sum(1, dtype=np.int64)
            for j in js[_may_link(n[i], n[js], differing, num, den)].tolist():
                found.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
    return found


def _lists(posts: DataFrame) -> DataFrame:
    """Rows (h, id, n) of shingles that several documents share, one shingle for
    each distinct list of documents; written."""
    several = posts.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
    shared = materialise(posts.join(several, "h", "left_semi").distinct(), "shared-prefixes")
    marks = shared.groupBy("h").agg(F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(20,0)")).alias("s1"), F.sum(F.xxhash64("id", F.lit(2)).cast("decimal(20,0)")).alias("s2"), F.count("*").alias("rows"))
    kept = marks.groupBy("s1", "s2", "rows").agg(F.min("h").alias("h")).select("h")
    return materialise(shared.join(kept, "h", "left_semi"), "lists")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    key, body = F.col(doc_id).cast("long"), F.col(text).cast("string")
    rows = docs.select(F.coalesce(key, F.lit(0)).alias("id"), key.isNull().alias("gone"), body.alias("text"), F.xxhash64(body).alias("tx"))
    first = materialise(_scan(rows, width), "shingle-sizes")
    sized = first.where(F.col("n").isNotNull()).drop("chunk", "counts")
    table = _order_table(first.where(F.col("chunk").isNotNull()))

    nodes = sized.where("n > 0 and not gone")
    copies = nodes.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").select("d1", "d2", "n", "rep")
    equal = materialise(nodes.join(copies, ["d1", "d2", "n"]).where("id <> rep").select("id", "tx", "rep").distinct(), "equal-sets")
    few = F.broadcast(equal) if equal.count() <= BROADCAST_IDS else equal
    distinct = rows.where("not gone").join(few, ["id", "tx"], "left_anti").select("id", "text")

    posts = materialise(_prefixes(distinct, table, width, num, den), "prefixes")
    lists = _lists(posts)
    leaders = lists.groupBy("h").agg(F.min(F.struct("id", "n")).alias("lead"))
    pairs = lists.join(leaders, "h").where(F.col("id") != F.col("lead.id"))
    pairs = pairs.where(den * F.least("n", "lead.n") >= num * F.greatest("n", "lead.n"))
    pairs = materialise(pairs.select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct(), "star-pairs")

    held = nodes.join(few, ["id", "tx"], "left_anti").select("id", "n", "sig").distinct()
    links = _decided(_bounded(pairs, held, num, den), held, distinct, width, num, den)
    stars = links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))
    spread = lists.join(stars, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = spread.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("h")
    spread = materialise(spread.join(mixed, "h", "left_semi"), "mixed-lists")
    more = _decided(_tiles(spread, held, num, den).join(pairs, ["a", "b"], "left_anti"), held, distinct, width, num, den)

    several = nodes.groupBy("id").agg(F.min("d1").alias("x0"), F.max("d1").alias("x1"), F.min("d2").alias("y0"), F.max("d2").alias("y1")).where("x0 < x1 or y0 < y1").select("id")
    bridges = equal.join(several, "id", "left_semi").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    roots = connected_components(links.union(more).union(bridges), "a", "b")
    out = sized.select("id", "tx", "gone", "n").join(few, ["id", "tx"], "left").withColumn("node", F.coalesce("rep", "id"))
    out = out.join(roots, "node", "left")
    own = F.when(~F.col("gone"), F.col("id"))
    root = F.when(~F.col("gone"), F.coalesce("root", "node"))
    return out.select(own.alias(doc_id), F.col("n").cast("long").alias("n_shingles"), root.alias("component_id"))

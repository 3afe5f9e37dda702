"""How far the sources of each language differ in their words.

Terms are runs of ASCII letters and of bytes from 0x80 on, A-Z lower-cased. The
terms of a language that stand in at least ``MIN_DOCUMENTS`` of its documents are
its vocabulary. It is sorted, cut into shards of at most ``SHARD_TERMS`` terms,
and every shard becomes a minimal acyclic transducer in a task of its own, whose
outputs are the lexicographic ordinals of its terms. The texts are streamed
through the transducers, all terms of a block of text at a time; what they give
is counted by source and ordinal. Ties between terms go to the smaller ordinal.

With count>=0 occurrences of a term in a source (or in the whole language) and N
occurrences of all V kept terms there, p = 1 + floor(10^9 (count + 5) / (N + 5 V)),
in exact integers. Part ``pair`` sums abs(p - q) over the vocabulary for every two
sources of a language; part ``term`` lists the terms that a source has more of
than its language, by that difference.

Document counts and occurrences are added up per task before each shuffle.
Shards are broadcast in blocks of at most ``BLOCK_BYTES``, one pass over the texts
for each; most vocabularies are one block. Sums of pairs are taken over bounded
blocks of terms in many tasks and grow with the sources squared, as the result.

Defined results: null text, language or source read as ''; each row is a
document, repeated ones too; a source without terms is compared all the same; in
a language without a vocabulary all pairs have value 0; an empty table gives an
empty result; other columns are not touched.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellpath.llm._tables import materialise
from fellpath.llm.transducer import Transducer, build

MIN_DOCUMENTS, TOP_TERMS, SMOOTHING, SCALE = 30, 50, 5, 1_000_000_000
#: Terms of one transducer.
SHARD_TERMS = 20_000
#: Bytes of transducers that are broadcast at once.
BLOCK_BYTES = 128_000_000
#: Counters a task holds before it adds them up, and text bytes walked at once.
HELD, TEXT_BYTES = 1_000_000, 1_000_000
#: Sources whose pairs one row of sums is for, and cells of a block of terms.
SOURCE_BLOCK, CELLS = 256, 2_000_000

#: Letters as lower-case, bytes from 0x80 on as they are, all else a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _read(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))


def _folded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


def vocabulary(rows: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Rows (lang, term, place): kept terms; ``place`` ascends with lang and term."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter[bytes]] = {}
        for batch in batches:
            for name, body in zip(batch["lang"], batch["text"], strict=True):
                seen.setdefault(name, Counter()).update(set(_folded(body).split()))
                if sum(map(len, seen.values())) > HELD:
                    yield from rows_of(seen)
                    seen = {}
        yield from rows_of(seen)

    def rows_of(seen: dict[str, Counter[bytes]]) -> Iterator[pd.DataFrame]:
        for name, own in seen.items():
            if own:
                yield pd.DataFrame({"lang": name, "term": [t.decode("utf-8", "surrogatepass") for t in own], "n": np.fromiter(own.values(), np.int64, len(own))})

    counted = rows.select("lang", "text").mapInPandas(count, "lang string, term string, n long")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_documents).select("lang", "term")
    ordered = materialise(kept, "kept-terms").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return materialise(ordered.withColumn("place", F.monotonically_increasing_id()), "vocabulary")


def transducers(terms: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """One row per shard: lang, place of its first term, number of terms, transducer as bytes.

    A shard lies within one run of consecutive places, so ``place`` minus that of
    its first term is the ordinal within the shard.
    """

    def make(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        made = build([t.encode("utf-8", "surrogatepass") for t in part["term"]])
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "place": [part["place"].iloc[0]], "n_terms": [len(part)], "made": [made.to_bytes()]})

    run = F.shiftright("place", 33)
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    shards = terms.groupBy("lang", run.alias("run"), F.floor(within / shard_terms).alias("cut"))
    made = shards.applyInPandas(make, "lang string, place long, n_terms long, made binary")
    return materialise(made.withColumn("bytes", F.length("made").cast("long")), "transducers")


def _terms_at(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all folded texts, start and end of every term, and its text's place."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = data != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return data, starts, ends, np.searchsorted(np.cumsum(lengths), starts, "right")


def _walk(shards: list[tuple[int, Transducer]], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ordinal within the language of every term, -1 if it is not kept.

    Only shards whose range of terms, by their first eight bytes, may hold a term
    are walked for it; no term is in two shards.
    """
    if len(shards) == 1:
        base, only = shards[0]
        found = only.ordinals(data, starts, ends)
        return np.where(found < 0, -1, found + base)
    key = np.zeros(len(starts), np.uint64)
    for k in range(8):
        on = starts + k < ends
        key[on] |= data[starts[on] + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    order = np.argsort(key, kind="stable")
    key, found = key[order], np.full(len(starts), -1, np.int64)
    for base, shard in shards:
        low, high = (int.from_bytes(t[:8].ljust(8, b"\0"), "big") for t in (shard.first, shard.last))
        part = order[np.searchsorted(key, np.uint64(low)) : np.searchsorted(key, np.uint64(high), "right")]
        hit = shard.ordinals(data, starts[part], ends[part])
        found[part[hit >= 0]] = hit[hit >= 0] + base
    return found


def recount(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows (lang, source, ordinal, n): occurrences of kept terms, by streaming
    all texts through the transducers of their language."""
    spark = rows.sparkSession
    listed = shards.select("lang", "place", "n_terms", "bytes").orderBy("lang", "place").collect()
    base, blocks, size, before = [], [[]], 0, {}
    for shard in listed:
        if blocks[-1] and size + shard.bytes > BLOCK_BYTES:
            blocks.append([])
            size = 0
        base.append(before.get(shard.lang, 0))
        before[shard.lang] = base[-1] + shard.n_terms
        blocks[-1].append((shard.place, base[-1]))
        size += shard.bytes
    counted = None
    for block in blocks:
        bases = dict(block)
        low, high = (min(bases), max(bases)) if bases else (0, -1)
        made: dict[str, list[tuple[int, bytes]]] = {}
        for shard in shards.where(F.col("place").between(low, high)).orderBy("place").toLocalIterator():
            made.setdefault(shard.lang, []).append((bases[shard.place], bytes(shard.made)))
        part = _streamed(rows, spark.sparkContext.broadcast(made))
        counted = part if counted is None else counted.unionByName(part)
    return counted.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def _streamed(rows: DataFrame, shared) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {lang: [(base, pickle.loads(made)) for base, made in own] for lang, own in shared.value.items()}
        groups: dict[tuple[str, str], int] = {}
        names: list[tuple[str, str]] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            keys, which = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(which, np.concatenate([n for _, n in held])).astype(np.int64)

        def rows_of(keys: np.ndarray, n: np.ndarray) -> pd.DataFrame:
            group = keys >> 40
            return pd.DataFrame({"lang": [names[g][0] for g in group], "source": [names[g][1] for g in group], "ordinal": keys & ((1 << 40) - 1), "n": n})

        def walk(lang: str, texts: list[bytes], codes: list[int]) -> None:
            nonlocal n_held
            data, starts, ends, which = _terms_at(texts)
            found = _walk(known[lang], data, starts, ends)
            kept = found >= 0
            keys, n = np.unique((np.array(codes, np.int64)[which[kept]] << 40) | found[kept], return_counts=True)
            held.append((keys, n))
            n_held += len(keys)

        for batch in batches:
            by_lang: dict[str, list[tuple[str, str]]] = {}
            for lang, source, body in zip(batch["lang"], batch["source"], batch["text"], strict=True):
                if lang in known:
                    by_lang.setdefault(lang, []).append((source, body))
            for lang, part in by_lang.items():
                texts, codes, size = [], [], 0
                for source, body in part:
                    if (lang, source) not in groups:
                        groups[lang, source] = len(names)
                        names.append((lang, source))
                    texts.append(_folded(body))
                    codes.append(groups[lang, source])
                    size += len(texts[-1])
                    if size > TEXT_BYTES:
                        walk(lang, texts, codes)
                        texts, codes, size = [], [], 0
                if texts:
                    walk(lang, texts, codes)
                if n_held > HELD:
                    held[:] = [added()]
                    n_held = len(held[0][0])
                    if n_held > HELD // 2:
                        yield rows_of(*held.pop())
                        n_held = 0
        if held:
            keys, n = added()
            for k in range(0, len(keys), 200_000):
                yield rows_of(keys[k : k + 200_000], n[k : k + 200_000])

    return rows.mapInPandas(scan, "lang string, source string, ordinal long, n long")


def _scaled(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 size)) in decimals of 38 digits."""
    above = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + SMOOTHING * size).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def _pair_sums(vectors: DataFrame, groups: dict[str, tuple[list[str], np.ndarray]]) -> DataFrame:
    """Rows (lang, g, s, value): abs(p - q) summed over the terms of ``vectors``
    (lang, source block, array of (source, p)), for sources g of the block."""
    shared = vectors.sparkSession.sparkContext.broadcast({lang: ({s: k for k, s in enumerate(names)}, floor) for lang, (names, floor) in groups.items()})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            by_block: dict[tuple[str, int], list] = {}
            for lang, block, held in zip(batch["lang"], batch["block"].tolist(), batch["held"], strict=True):
                by_block.setdefault((lang, block), []).append(held)
            for (lang, block), part in by_block.items():
                place, floor = shared.value[lang]
                own = range(block * SOURCE_BLOCK, min(len(floor), (block + 1) * SOURCE_BLOCK))
                total = sums.setdefault((lang, block), np.zeros((len(own), len(floor)), np.int64))
                rows = max(1, CELLS // len(floor))
                for k in range(0, len(part), rows):
                    some = part[k : k + rows]
                    p = np.tile(floor, (len(some), 1))
                    for row, held in zip(p, some, strict=True):
                        for x in held:
                            row[place[x["source"]]] = x["p"]
                    for n, g in enumerate(own):
                        total[n] += np.abs(p - p[:, g : g + 1]).sum(0)
        for (lang, block), total in sums.items():
            names = list(shared.value[lang][0])
            for n, row in enumerate(total):
                yield pd.DataFrame({"lang": lang, "g": names[block * SOURCE_BLOCK + n], "s": names, "value": row})

    return vectors.mapInPandas(scan, "lang string, g string, s string, value long").groupBy("lang", "g", "s").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", *, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank)."""
    rows = _read(docs, text, lang, source)
    terms = vocabulary(rows, min_documents)
    shards = transducers(terms)
    counts = materialise(recount(rows, shards), "term-counts")

    sizes = shards.groupBy("lang").agg(F.sum("n_terms").alias("v"))
    groups = rows.select("lang", "source").distinct().join(sizes, "lang", "left").fillna(0, ["v"])
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = materialise(groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]), "groups")
    floors = groups.withColumn("floor", F.when(F.col("v") > 0, _scaled(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(0))
    listed: dict[str, tuple[list[str], list[int]]] = {}
    for row in floors.orderBy("lang", "source").toLocalIterator():
        names, floor = listed.setdefault(row.lang, ([], []))
        names.append(row.source)
        floor.append(row.floor)
    known = {name: (names, np.array(floor, np.int64)) for name, (names, floor) in listed.items()}

    each = counts.join(groups, ["lang", "source"]).select("lang", "source", "ordinal", "n", _scaled(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_sources") - 1) / SOURCE_BLOCK).cast("int")))
    width = groups.groupBy("lang").agg(F.count("*").alias("n_sources"))
    vectors = each.groupBy("lang", "ordinal").agg(F.collect_list(F.struct("source", "p")).alias("held")).join(width, "lang").select("lang", blocks.alias("block"), "held")
    sums = _pair_sums(vectors, known)
    others = groups.select("lang", F.col("source").alias("s"))
    pairs = groups.select("lang", F.col("source").alias("g")).join(others, "lang").where("g <> s").join(sums, ["lang", "g", "s"], "left").fillna(0, ["value"])
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pairs.select("lang", F.col("g").alias("source"), F.lit("pair").alias("part"), F.col("s").alias("item"), "value").withColumn("rank", F.row_number().over(by_value))

    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n"))
    all_n = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    q = whole.join(all_n, "lang").select("lang", "ordinal", _scaled(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    above = each.join(q, ["lang", "ordinal"]).where("p > q").select("lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value"))
    by_ordinal = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    top = above.withColumn("rank", F.row_number().over(by_ordinal)).where(F.col("rank") <= top_terms)
    starts = shards.select("lang", "place", "n_terms").withColumn("base", F.sum("n_terms").over(Window.partitionBy("lang").orderBy("place")) - F.col("n_terms"))
    placed = top.join(starts.withColumnRenamed("place", "first"), (top["lang"] == starts["lang"]) & (F.col("ordinal") >= F.col("base")) & (F.col("ordinal") < F.col("base") + F.col("n_terms"))).select(top["lang"].alias("lang"), "source", "value", "rank", (F.col("ordinal") - F.col("base") + F.col("first")).alias("place"))
    term = placed.join(terms, ["lang", "place"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pair.unionByName(term)

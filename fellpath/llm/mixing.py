"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words; each of its documents then expects
``target / source_size`` copies, at most ``max_repeat``. Documents stand in one
order (source, size, hash of the id, id); the expected copies are summed along
it, one random offset per source is added, and a document is emitted once for
every integer boundary that its stretch of the sum crosses. With documents in
order of size, neighbours stand in for each other and the words taken stay
close to the target.

A few documents may hold much of a source: those above ``LARGE`` of the target, of
which at most ``LARGE_DOCUMENTS`` a source, expect a whole number of copies, so
no offset moves them: from the largest on each takes the rate rounded up or
down, whichever keeps their words nearer to the rate. The other documents share
what is left of the target, so the words taken miss it by about one of them.

The order comes from a range shuffle, not from a window per source, so a source
that holds a third of all rows is dealt over many tasks. Ranks are local row
numbers plus the counts of earlier partitions. Offsets depend on the seed and
the source alone, and ranks on the rows alone, so reruns agree.

Defined results: a null source is a source of its own, last in order; null or
blank text has size 0 and takes 0 words; repeated rows take their own places;
an empty table gives an empty mix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellpath.llm._tables import materialise

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Totals of this many sources at most are taken to the driver.
MAX_SOURCES = 100_000
#: Share of its source's target above which a document expects a whole number of copies, and how many may.
LARGE, LARGE_DOCUMENTS = 0.002, 512


def words(text: str = "text") -> Column:
    """Number of runs of characters other than blank, tab, LF, VT, FF and CR."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> list[float]:
    """Targets of sources in order: shares of the sum of all sizes by weight
    (``weights`` repeat), none above ``max_repeat`` times its size, the excess
    shared again by weight until none is above."""
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out: list[float] = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weight[i] for i in open_)
        above = [i for i in open_ if left * weight[i] / total > max_repeat * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in above:
            out[i] = float(max_repeat * sizes[i])
            left -= out[i]
        gone = set(above)
        open_ = [i for i in open_ if i not in gone]
    return out


def _offset(source: str | None, seed: int) -> float:
    """Uniform in (0, 1), an odd multiple of 1/2048, so that sums stay exact."""
    name = f"{seed}:{'-' if source is None else '+' + source}".encode("utf-8", "surrogatepass")
    return (int.from_bytes(hashlib.sha256(name).digest()[:4], "big") % 1024 * 2 + 1) / 2048


def _crossed(offset: Column) -> Column:
    """Integer boundaries between the sums before and after a document."""
    return F.floor(F.col("rate") * (F.col("rank") + 1) + offset) - F.floor(F.col("rate") * F.col("rank") + offset)


def whole_copies(sizes: Sequence[int], rate: float, max_repeat: float = MAX_REPEAT) -> list[int]:
    """Copies of documents, largest first: ``rate`` rounded up or down, as keeps their
    words so far nearer to ``rate`` times their sizes."""
    out, missing = [], 0.0
    for size in sizes:
        missing += rate * size
        low = int(rate)
        high = min(low + 1, int(max_repeat))
        copies = high if abs(missing - high * size) < abs(missing - low * size) else low
        missing -= copies * size
        out.append(copies)
    return out


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", *, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT, seed: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """Per row: ``doc_id``, ``source``, ``size``, ``source_size``, ``target`` (of its source), ``copies``
    (times it is emitted), ``taken`` (its words in the mix), and the columns ``keep``."""
    spark = docs.sparkSession
    kept = [f"__keep{k}" for k in range(len(keep))]
    sized = docs.select(F.col(doc_id).alias("__id"), F.col(source).cast("string").alias("__source"), words(text).alias("size"), *(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)))
    sized = materialise(sized.withColumn("__row", F.monotonically_increasing_id()), "sizes")
    totals = sized.groupBy("__source").agg(F.sum("size").alias("source_size")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["__source"] is None, r["__source"] or ""))
    goals = targets([r["source_size"] for r in totals], weights, max_repeat)
    plan = [(k, r["__source"], r["source_size"], goal, min(goal / r["source_size"], float(max_repeat)) if r["source_size"] else 0.0, _offset(r["__source"], seed)) for k, (r, goal) in enumerate(zip(totals, goals, strict=True))]
    sources = spark.createDataFrame(plan, "k int, s string, source_size long, target double, rate double, offset double")

    # Ids and sizes only: what is kept besides joins again by row.
    known = sized.select("__row", "__id", "__source", "size").join(F.broadcast(sources), F.col("__source").eqNullSafe(F.col("s")))
    order = ["k", "size", "__hash", "__name"]
    known = known.withColumns({"__name": F.col("__id").cast("string"), "__hash": F.xxhash64(F.col("__id").cast("string"))})
    by_size = Window.partitionBy("k").orderBy(F.desc("size"), "__hash", "__name", "__row")
    large = known.where(F.col("size") > F.lit(LARGE) * F.col("target")).withColumn("n", F.row_number().over(by_size)).where(F.col("n") <= LARGE_DOCUMENTS).select("k", "n", "rate", "size", "__row")

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        return pd.DataFrame({"k": part["k"], "size": part["size"], "row": part["__row"], "whole": whole_copies(part["size"].tolist(), float(part["rate"].iloc[0]), max_repeat)})

    # At most LARGE_DOCUMENTS rows of a source.
    fixed = materialise(large.groupBy("k").applyInPandas(decide, "k int, size long, row long, whole long"), "large")
    given = {r["k"]: (r["own"], r["words"]) for r in fixed.groupBy("k").agg(F.sum("size").alias("own"), F.sum(F.col("size") * F.col("whole")).alias("words")).collect()}
    rest = [(k, min(max((goal - given.get(k, (0, 0))[1]) / (size - given.get(k, (0, 0))[0]), 0.0), float(max_repeat)) if size > given.get(k, (0, 0))[0] else 0.0) for k, _, size, goal, *_ in plan]
    rates = spark.createDataFrame(rest, "k int, rate double")

    placed = known.select("__row", "k", "size", "__hash", "__name").join(fixed.select(F.col("row").alias("__row")), "__row", "left_anti")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("__row", "k", F.spark_partition_id().alias("part"))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        for batch in batches:
            ks = batch["k"]
            batch["row"] = ks.groupby(ks).cumcount() + ks.map(lambda k: seen.get(k, 0))
            for k, c in ks.value_counts().items():
                seen[k] = seen.get(k, 0) + int(c)
            yield batch

    numbered = materialise(placed.mapInPandas(number, "__row long, k int, part int, row long"), "ranks")
    held = numbered.groupBy("k", "part").agg(F.count("*").alias("rows"))
    # A source spans neighbouring ranges, so this has at most partitions + sources rows.
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("k", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("earlier"))
    small = numbered.join(F.broadcast(before), ["k", "part"]).join(F.broadcast(rates), "k").join(F.broadcast(sources.select("k", "offset")), "k").withColumn("rank", F.col("row") + F.col("earlier"))
    copies = small.select("__row", F.least(_crossed(F.col("offset")), F.ceil("rate")).cast("long").alias("copies")).unionByName(fixed.select(F.col("row").alias("__row"), F.col("whole").alias("copies")))
    out = sized.join(copies, "__row").join(F.broadcast(sources), F.col("__source").eqNullSafe(F.col("s")))
    return out.select(F.col("__id").alias(doc_id), F.col("s").alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)))

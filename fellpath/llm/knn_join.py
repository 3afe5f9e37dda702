"""Exact top-k search by a Voronoi kNN join under the inner product.

Vectors are grouped by their nearest pivot. With ``r = |s - p|`` for a vector
``s`` of the cell of ``p``, every query ``q`` has

    q.p - |q| r  <=  q.s  <=  q.p + |q| r

so the smallest radii of each cell (a summary of fixed size) bound every
query's k-th best score from below, and a group of queries needs from a cell
only vectors whose upper bound reaches its lowest k-th best. Those vectors are
replicated to the group, in blocks, and each block is solved locally by one
matrix product; the best of all blocks are merged.

Equal vectors are one vector with its ``k + 1`` smallest ids, since ties go to
smaller ids and a query leaves out only itself; equal queries are one query.
So a vector that a third of all rows share costs as much as any other. Pivots
are the vectors with the smallest hashes, ``PIVOTS`` of them; they affect cost
only. All else covers every row.

Defined results: vectors that are null or hold null, NaN or infinite components
take no part; shorter vectors count as padded with zeros; an empty vector
scores 0; repeated rows of one id and vector count once; with fewer candidates
than ``k`` all are returned; columns other than id and vector are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellpath.llm._tables import materialise

PIVOTS = 16
#: Queries of one group and vectors of one block that a task takes together.
QUERY_ROWS, BLOCK_ROWS = 2048, 8192
#: Ways in which the rows of one vector are dealt out.
SALTS = 16
#: Rows of the table of bounds that are broadcast at most.
BROADCAST_ROWS = 100_000


def quantised(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component x, taken as double."""
    column = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _usable(column: Column) -> Column:
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return column.isNotNull() & ~F.coalesce(odd, F.lit(True))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.to_list(), np.int64).reshape(len(column), width)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in float64 while sums stay below 2^53."""
    if not len(a) or not len(b) or not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", *, scale: int = 256) -> DataFrame:
    """The ``k`` best rows of every query by inner product: ``query_id``,
    ``rank`` (from 1), ``vec_id`` and ``score``; ties to smaller ids."""
    valid = vectors.where(F.col(vec_id).isNotNull() & _usable(F.col(vector)))
    rows = valid.select(F.col(vec_id).cast("long").alias("id"), quantised(vector, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    width = int(rows.agg(F.max(F.size("v"))).first()[0] or 0)
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")})

    near = Window.partitionBy("h1", "h2", "salt").orderBy("id")
    few = rows.withColumn("salt", F.spark_partition_id() % SALTS).withColumn("place", F.dense_rank().over(near)).where(F.col("place") <= k + 1)
    few = few.withColumn("place", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("place") <= k + 1)
    data = few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_set("id")).alias("ids"))
    data = materialise(data, "vectors")
    n = data.count()
    pivots = _matrix(pd.Series([r["v"] for r in data.orderBy("h1", "h2").limit(PIVOTS).select("v").collect()]), width)
    asked = rows.where("asks").select("id", "h1", "h2").distinct()
    queries = rows.where("asks").groupBy("h1", "h2").agg(F.first("v").alias("v"))

    def cells(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            v = _matrix(batch["v"], width).astype(np.float64)
            far = np.sqrt(np.maximum(((v[:, None, :] - pivots[None]) ** 2).sum(2), 0)) if len(v) else np.zeros((0, len(pivots)))
            batch["cell"] = far.argmin(1).astype(np.int32) if len(v) else np.zeros(0, np.int32)
            batch["r"] = far.min(1) if len(v) else np.zeros(0)
            yield batch

    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long").withColumnRenamed("vec_id", vec_id)
    if not n:
        return empty
    placed = materialise(data.mapInPandas(cells, "h1 long, h2 long, v array<long>, ids array<long>, cell int, r double"), "cells")
    closest = Window.partitionBy("cell").orderBy("r", "h1", "h2")
    summary = placed.select("cell", "r", "h1", "h2").withColumn("place", F.row_number().over(closest)).where(F.col("place") <= k + 1).collect()
    sure_cell, sure_r = np.array([x["cell"] for x in summary]), np.array([x["r"] for x in summary])
    reach = {x["cell"]: x["r"] for x in placed.groupBy("cell").agg(F.max("r").alias("r")).collect()}

    n_queries = queries.count()
    coarse = max(1, min(len(pivots), n_queries // QUERY_ROWS))

    def bounds(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            v = _matrix(batch["v"], width).astype(np.float64)
            dots, norm = v @ pivots.T.astype(np.float64), np.sqrt((v**2).sum(1))
            low = dots[:, sure_cell] - norm[:, None] * sure_r
            kth = np.sort(low, 1)[:, -(k + 1)] if low.shape[1] > k else np.full(len(v), -np.inf)
            batch["cell"] = (dots[:, :coarse] - (pivots[:coarse].astype(np.float64) ** 2).sum(1) / 2).argmax(1).astype(np.int32)
            batch["norm"], batch["kth"], batch["dots"] = norm, kth, list(dots)
            yield batch

    grouped = queries.mapInPandas(bounds, "h1 long, h2 long, v array<long>, cell int, norm double, kth double, dots array<double>")
    blocks = max(1, -(-n_queries // (coarse * QUERY_ROWS)))
    grouped = materialise(grouped.withColumn("part", F.pmod(F.xxhash64("h2", "h1"), F.lit(blocks)).cast("int")), "queries")
    dots = grouped.select("cell", "part", F.posexplode("dots").alias("at", "dot")).groupBy("cell", "part", "at").agg(F.max("dot").alias("dot"))
    group = grouped.groupBy("cell", "part").agg(F.max("norm").alias("norm"), F.min("kth").alias("kth"))
    radius = F.create_map(*(F.lit(x) for pair in reach.items() for x in pair))
    needs = dots.join(group, ["cell", "part"]).withColumn("slack", F.lit(1e-6) * (1 + F.abs("dot") + F.abs("norm")))
    needs = needs.withColumn("least", F.when(F.col("norm") > 0, (F.col("kth") - F.col("dot") - F.col("slack")) / F.col("norm")).otherwise(float("-inf")))
    needs = needs.where(F.col("least") <= F.coalesce(radius[F.col("at")], F.lit(-1.0)))
    needs = materialise(needs.select(F.col("cell").alias("group"), "part", F.col("at").alias("cell"), "least"), "bounds")

    data_blocks = max(1, -(-n // BLOCK_ROWS))
    bound = F.broadcast(needs) if needs.count() <= BROADCAST_ROWS else needs
    sent = placed.join(bound, "cell").where(F.col("r") >= F.col("least"))
    sent = sent.select("group", "part", F.pmod("h1", F.lit(data_blocks)).cast("int").alias("block"), "v", "ids")
    asking = grouped.select(F.col("cell").alias("group"), "part", F.explode(F.sequence(F.lit(0), F.lit(data_blocks - 1))).alias("block"), "h1", "h2", "v")

    def solve(asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asks) and len(held):
            ids, sizes = np.concatenate(held["ids"].to_list()).astype(np.int64), held["ids"].map(len).to_numpy()
            owner = np.repeat(np.arange(len(held)), sizes)
            first = np.concatenate(([0], np.cumsum(sizes)))
            scores = _scores(_matrix(asks["v"], width), _matrix(held["v"], width))
            for h1, h2, own in zip(asks["h1"], asks["h2"], scores, strict=True):
                least = np.partition(own, -(k + 1))[-(k + 1)] if len(own) > k else own.min()
                at = np.flatnonzero(own >= least)
                rows_at = np.concatenate([np.arange(first[i], first[i + 1]) for i in at])
                order = np.lexsort((ids[rows_at], -own[owner[rows_at]]))[: k + 1]
                best = rows_at[order]
                out.append(pd.DataFrame({"h1": h1, "h2": h2, "id": ids[best], "score": own[owner[best]]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("h1", "h2", "id", "score")})

    keys = ["group", "part", "block"]
    found = asking.groupBy(keys).cogroup(sent.groupBy(keys)).applyInPandas(solve, "h1 long, h2 long, id long, score long")
    best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    found = materialise(found.select("h1", "h2", F.col("id").alias("other"), "score"), "neighbours")
    dealt = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = asked.withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int")).join(dealt, ["h1", "h2", "salt"]).where(F.col("id") != F.col("other"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", F.col("other").alias(vec_id), "score")

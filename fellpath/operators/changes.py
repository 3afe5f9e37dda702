"""Differences of snapshots, their identities, admission against manifests.

Joins are by key and keep both sides, so what is missing on either is a row
with a status. Null keys match nothing: such rows are told as they are on their
own side. Keys that repeat within a side are told as ``duplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellpath.functions import text


def record_digest(fields: dict[str, Column]) -> Column:
    """Identity of a record: SHA-256 of its canonical JSON."""
    return text.digest(text.canonical_json(fields))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed by ``value``; what is equal has no row."""
    old = before.select(key, F.col(value).alias("_old"), F.lit(True).alias("_b"))
    new = after.select(key, F.col(value).alias("_new"), F.lit(True).alias("_a"))
    both = old.join(new, key, "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def extract_comparison(before: DataFrame, after: DataFrame, key: str, geometry: list[str], attributes: list[str]) -> DataFrame:
    """(key, change): added, removed, geometry, attributes or both."""

    def side(rows: DataFrame, tag: str) -> DataFrame:
        return rows.select(key, F.struct(*geometry).alias(f"{tag}_g"), F.struct(*attributes).alias(f"{tag}_a"), F.lit(True).alias(f"{tag}_in"))

    both = side(before, "b").join(side(after, "a"), key, "full")
    shape, attrs = ~F.col("b_g").eqNullSafe(F.col("a_g")), ~F.col("b_a").eqNullSafe(F.col("a_a"))
    change = F.when(F.col("b_in").isNull(), "added").when(F.col("a_in").isNull(), "removed").when(shape & attrs, "both").when(shape, "geometry").when(attrs, "attributes")
    return both.select(key, change.alias("change")).where("change is not null")


def subset_violations(ids: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Keys of ``ids`` that ``allowed`` does not have; empty where it is a subset."""
    return ids.select(key).distinct().join(allowed.select(key).distinct(), key, "left_anti")


def admission(manifest: DataFrame, extract: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status) of every key of either side: admitted, changed, missing, unexpected or duplicate."""
    listed = manifest.groupBy(key).agg(F.count("*").alias("_m"), F.min(digest).alias("_want"))
    found = extract.groupBy(key).agg(F.count("*").alias("_x"), F.min(digest).alias("_have"))
    both = listed.join(found, key, "full")
    status = F.when((F.coalesce("_m", F.lit(0)) > 1) | (F.coalesce("_x", F.lit(0)) > 1), "duplicate").when(F.col("_x").isNull(), "missing").when(F.col("_m").isNull(), "unexpected").when(F.col("_want").eqNullSafe(F.col("_have")), "admitted").otherwise("changed")
    return both.select(key, status.alias("status"))


def coded(rows: DataFrame, code: str, domain: DataFrame, label: str = "label") -> DataFrame:
    """Rows with the label of their code and ``known``; ``domain`` has one row per code."""
    return rows.join(domain.select(F.col("code").alias("_code"), F.col("label").alias(label)), F.col(code) == F.col("_code"), "left").withColumn("known", F.col("_code").isNotNull()).drop("_code")


def revalidation(edges: DataFrame, features: DataFrame, route: str, feature: str) -> DataFrame:
    """(route, feature, issue): features of a route that are gone, no longer open or
    drawn otherwise (``status`` and ``shape`` on both sides)."""
    own = edges.select(route, feature, F.col("status").alias("_status"), F.col("shape").alias("_shape")).distinct()
    now = features.select(feature, "status", "shape", F.lit(True).alias("_there"))
    joined = own.join(now, feature, "left")
    issues = F.array_compact(F.array(F.when(F.col("_there").isNull(), "removed"), F.when(F.col("_there") & ~F.col("status").eqNullSafe(F.col("_status")), "status"), F.when(F.col("_there") & ~F.col("shape").eqNullSafe(F.col("_shape")), "geometry")))
    return joined.select(route, feature, F.explode(issues).alias("issue")).distinct()


def change_kind(candidate: str, parent: str, records_differ: Column, contract_differs: Column) -> Column:
    """initial, no-change, records, contract or provenance-only."""
    return F.when(F.col(parent).isNull(), "initial").when(F.col(candidate) == F.col(parent), "no-change").when(records_differ, "records").when(contract_differs, "contract").otherwise("provenance-only")


def journal(observations: DataFrame, source: str, order: str, identity: str) -> DataFrame:
    """Observations with their ``parent`` and ``link``, a digest over both."""
    w = Window.partitionBy(source).orderBy(order)
    out = observations.withColumn("parent", F.lag(identity).over(w))
    return out.withColumn("link", record_digest({"candidate": F.col(identity), "parent": F.col("parent"), "source": F.col(source).cast("string")}))


def broken_links(chain: DataFrame, source: str, order: str, identity: str) -> DataFrame:
    """Rows of a journal whose parent or link is not what the rows before tell."""
    again = journal(chain.drop("parent", "link"), source, order, identity).select(source, order, F.col("parent").alias("_p"), F.col("link").alias("_l"))
    return chain.join(again, [source, order]).where(~(F.col("parent").eqNullSafe(F.col("_p")) & F.col("link").eqNullSafe(F.col("_l")))).drop("_p", "_l")


def within_quota(rows: DataFrame, group: str, order: list[Column], size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """The newest rows of each group whose count and bytes, summed in order, stay within both limits."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.withColumns({"_n": F.count("*").over(w), "_b": F.sum(size).over(w)})
    return held.where((F.col("_n") <= most_rows) & (F.col("_b") <= most_bytes)).drop("_n", "_b")


def unsafe_closures(previous: DataFrame, following: DataFrame, reviews: DataFrame) -> DataFrame:
    """Closures (closure_id, sha, released_ms) that changed or went without a review
    (closure_id, from_sha, to_sha, reviewed_ms) between both releases."""
    next_ = following.select("closure_id", F.col("sha").alias("_next"), F.col("released_ms").alias("_until"))
    changed = previous.join(next_.select("closure_id", "_next"), "closure_id", "left").where(~F.col("sha").eqNullSafe(F.col("_next")))
    until = following.agg(F.max("released_ms").alias("_until"))
    seen = changed.alias("c").join(reviews.alias("r"), (F.col("c.closure_id") == F.col("r.closure_id")) & (F.col("c.sha") == F.col("r.from_sha")), "left")
    end = until.first()["_until"]
    good = F.col("r.to_sha").eqNullSafe(F.col("c._next")) & (F.col("r.reviewed_ms") >= F.col("c.released_ms")) & (F.col("r.reviewed_ms") <= F.lit(end))
    return seen.groupBy(F.col("c.closure_id").alias("closure_id")).agg(F.max(F.coalesce(good, F.lit(False))).alias("ok")).where("not ok").select("closure_id")


def add_or_conflict(held: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, outcome) of new rows: added, same or conflict; rows of one key must agree among themselves."""
    offered = new.groupBy(key).agg(F.min(digest).alias("_lo"), F.max(digest).alias("_hi"))
    joined = offered.join(held.select(key, F.col(digest).alias("_held"), F.lit(True).alias("_in")), key, "left")
    outcome = F.when(~F.col("_lo").eqNullSafe(F.col("_hi")), "conflict").when(F.col("_in").isNull(), "added").when(F.col("_held").eqNullSafe(F.col("_lo")), "same").otherwise("conflict")
    return joined.select(key, outcome.alias("outcome"))


def differing_fields(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) for every field in which rows of one key differ, or that one side lacks."""

    def long(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(f).cast("string") for f in fields)))).alias("field", name))

    both = long(left, "l").withColumn("_l", F.lit(True)).join(long(right, "r").withColumn("_r", F.lit(True)), [key, "field"], "full")
    return both.where(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("l").eqNullSafe(F.col("r"))).select(key, "field")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with ``side``; empty where both are equal."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def admitted_requests(requests: DataFrame, key: str, network: str, at_ms: str, per_hour: int = 5, per_day: int = 100) -> DataFrame:
    """The requests that a limit per network and hour and one per day let through, in
    order of time, then key; a repeated key is one request."""
    first = requests.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(at_ms))).where("_n = 1").drop("_n")
    hour, day = F.floor(F.col(at_ms) / 3_600_000), F.floor(F.col(at_ms) / 86_400_000)
    hourly = first.withColumns({"_hour": hour, "_day": day}).withColumn("_h", F.row_number().over(Window.partitionBy(network, "_hour").orderBy(at_ms, key))).where(F.col("_h") <= per_hour)
    return hourly.withColumn("_d", F.row_number().over(Window.partitionBy("_day").orderBy(at_ms, key))).where(F.col("_d") <= per_day).drop("_h", "_d", "_hour", "_day")


def upsert(held: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the latest by ``order``; of ties the new one."""
    both = held.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new")))).where("_n = 1").drop("_n", "_new")


def quarantine(rows: DataFrame, sound: Column, held: DataFrame, digest: Column) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and the others that ``held`` (digest) does not have yet, once each."""
    told = F.coalesce(sound, F.lit(False))
    bad = rows.where(~told).withColumn("digest", digest).dropDuplicates(["digest"]).join(held.select("digest"), "digest", "left_anti")
    return rows.where(told), bad

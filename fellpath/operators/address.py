"""Address index: building, street matching, search, nearest address.

All are joins and windows over plain tables; Parquet supplies the dictionary
and run encodings of a columnar index. Rows that cannot be indexed are counted
by reason, never dropped silently. Null texts have no tokens.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellpath.functions import geo, text
from fellpath.plans.staging import materialise

SCALE = 1_000_000
ORDER = ["street", "num", "suffix", "unit", "city", "oid"]


def entries(rows: DataFrame, county: Column | None = None) -> DataFrame:
    """Rows (oid, address, building, unit, city, zip, lat, lon) with ``skipped``
    (null where the row can be indexed) and the fields of an entry."""
    tokens = text.address_tokens("address")
    number = text.house_number(F.get(F.col("_t"), F.lit(0)))
    out = rows.withColumn("_t", tokens).withColumn("_n", number)
    outside = F.lit(False) if county is None else ~F.coalesce(county, F.lit(False))
    skipped = F.when(outside, "county").when(F.col("lat").isNull() | F.col("lon").isNull(), "point").when(F.col("_n").isNull() | (F.size("_t") < 2), "number")
    return out.select(
        "oid", skipped.alias("skipped"), F.array_join(F.slice("_t", 2, F.greatest(F.size("_t"), F.lit(1))), " ").alias("street"), F.col("_n.num").alias("num"), F.col("_n.suffix").alias("suffix"),
        text.unit_text("building", "unit").alias("unit"), F.upper(F.trim(F.coalesce("city", F.lit("")))).alias("city"), F.substring(F.trim(F.coalesce("zip", F.lit(""))), 1, 5).alias("zip"),
        text.half_up(F.col("lat") * SCALE).alias("lat"), text.half_up(F.col("lon") * SCALE).alias("lon"),
    )


def build_index(rows: DataFrame, county: Column | None = None) -> DataFrame:
    """The entries that can be indexed; of those alike in all but the id the first stays."""
    good = entries(rows, county).where("skipped is null").drop("skipped")
    same = Window.partitionBy("street", "num", "suffix", "unit", "city").orderBy("oid")
    repeat = (F.lag("lat").over(same) == F.col("lat")) & (F.lag("lon").over(same) == F.col("lon"))
    return good.withColumn("_repeat", F.coalesce(repeat, F.lit(False))).where("not _repeat").drop("_repeat")


def build_report(rows: DataFrame, county: Column | None = None) -> DataFrame:
    """One row of counts: rows, indexed, skipped by reason, duplicates, streets, cities, with_unit."""
    marked = entries(rows, county).groupBy().agg(F.count("*").alias("rows"), *(F.count_if(F.col("skipped") == r).alias(f"skipped_{r}") for r in ("county", "point", "number")), F.count_if(F.col("skipped").isNull()).alias("_good"))
    kept = build_index(rows, county).groupBy().agg(F.count("*").alias("indexed"), F.countDistinct("street").alias("streets"), F.countDistinct("city").alias("cities"), F.count_if(F.col("unit") != "").alias("with_unit"))
    joined = marked.join(F.broadcast(kept), F.lit(True))
    return joined.withColumn("duplicates", F.col("_good") - F.col("indexed")).drop("_good")


def match_streets(queries: DataFrame, streets: DataFrame) -> DataFrame:
    """(query, street, rank): streets that typed tokens fit; ``queries``: query, typed (array of tokens).

    All tokens but the last must be equal, the last may be a beginning or an
    alias; a leading direction of the street may be left out. Streets are
    looked up by their first relevant token or its beginnings, so the join is
    on equal values.
    """
    names = streets.select("street").distinct().withColumn("name", F.split("street", " "))
    skips = F.when((F.size("name") > 1) & F.col("name")[0].isin(*text.DIRECTIONALS), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    shifted = names.withColumn("offset", F.explode(skips)).withColumn("head", F.element_at("name", F.col("offset") + 1))
    whole = shifted.select("*", F.col("head").alias("key"), F.lit(True).alias("full"))
    begins = shifted.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.length("head")), lambda k: F.substring("head", F.lit(1), k))).alias("key"), F.lit(False).alias("full"))
    typed = queries.where(F.size("typed") > 0).withColumns({"n": F.size("typed"), "last": F.element_at("typed", -1)}).withColumn("alias", text.alias_completions("last"))
    many = typed.where("n > 1").withColumn("key", F.col("typed")[0]).join(whole, "key")
    one = typed.where("n = 1")
    single = one.withColumn("key", F.col("last")).join(begins, "key").unionByName(one.withColumn("key", F.explode("alias")).join(whole, "key"))
    found = many.unionByName(single).where((F.col("n") + F.col("offset") <= F.size("name")) & ((F.col("offset") == 0) | (F.col("typed")[0] != F.col("name")[0])))
    part = F.slice("name", F.col("offset") + 1, F.col("n"))
    end = F.element_at(part, -1)
    fits = (F.slice("typed", 1, F.col("n") - 1) == F.slice(part, 1, F.col("n") - 1)) & (end.startswith(F.col("last")) | F.array_contains("alias", end))
    exact = (F.col("n") + F.col("offset") == F.size("name")) & (end == F.col("last"))
    rank = F.when(exact, 0).otherwise(1000) + (F.size("name") - F.col("n") - F.col("offset")) * 10 + F.col("offset")
    return found.where(fits).groupBy("query", "street").agg(F.min_by(rank, "offset").alias("rank"))


def label(street: Column, num: Column, suffix: Column, city: Column) -> Column:
    number = F.concat(num.cast("string"), F.when(suffix == "1/2", " 1/2").otherwise(suffix))
    return F.concat(number, F.lit(" "), text.street_title(street), F.when(city != "", F.concat(F.lit(", "), text.city_title(city))).otherwise(""))


def search(queries: DataFrame, index: DataFrame, limit: int = 8) -> DataFrame:
    """What each typed text (query, text) finds: query, kind, ambiguous, found (array of labels).

    ``matches``: places with that number; ``streets``: streets to choose from;
    ``nearest-numbers``: the places before and after on the only street;
    ``none``. Places with one number, city and point are one, whatever their units.
    """
    parsed = queries.withColumn("_t", text.address_tokens("text")).withColumn("_n", text.house_number(F.get(F.col("_t"), F.lit(0))))
    typed = parsed.select("query", F.col("_n.num").alias("want"), F.col("_n.suffix").alias("want_suffix"), F.when(F.col("_n").isNull(), F.col("_t")).otherwise(F.slice("_t", 2, F.greatest(F.size("_t"), F.lit(1)))).alias("typed"))
    streets = match_streets(typed.select("query", "typed"), index)
    order = Window.partitionBy("query").orderBy("rank", "street")
    streets = streets.join(typed.select("query", "want", "want_suffix"), "query").withColumns({"place": F.row_number().over(order), "n_streets": F.count("*").over(Window.partitionBy("query"))})

    hits = streets.where("want is not null").join(index, "street").where((F.col("num") == F.col("want")) & (F.col("suffix") == F.col("want_suffix")))
    places = hits.groupBy("query", "place", "street", "num", "suffix", "city", "lat", "lon").agg(F.min(F.struct("unit", "oid")).alias("first"))
    first = Window.partitionBy("query").orderBy("place", "first.unit", "city", "first.oid")
    ranked = places.withColumns({"k": F.row_number().over(first), "n": F.count("*").over(Window.partitionBy("query"))}).where(F.col("k") <= limit)
    matches = ranked.groupBy("query").agg(F.max(F.col("n") > 1).alias("ambiguous"), F.transform(F.array_sort(F.collect_list(F.struct("k", label(F.col("street"), F.col("num"), F.col("suffix"), F.col("city")).alias("label")))), lambda x: x["label"]).alias("found")).withColumn("kind", F.lit("matches"))

    left = streets.join(matches.select("query"), "query", "left_anti")
    choose = left.where("want is null or n_streets > 1").where(F.col("place") <= limit)
    choices = choose.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "street"))), lambda x: text.street_title(x["street"])).alias("found")).withColumns({"kind": F.lit("streets"), "ambiguous": F.lit(None).cast("boolean")})

    alone = left.where("want is not null and n_streets = 1").join(index, "street")
    entry = F.struct(*ORDER)
    below = F.max(F.when(F.col("num") < F.col("want"), entry)).alias("lower")
    above = F.min(F.when(F.col("num") > F.col("want"), entry)).alias("higher")
    sides = alone.groupBy("query").agg(below, above)
    named = [label(F.col(f"{s}.street"), F.col(f"{s}.num"), F.col(f"{s}.suffix"), F.col(f"{s}.city")) for s in ("lower", "higher")]
    nearest = sides.select("query", F.array(*named).alias("found"), F.lit("nearest-numbers").alias("kind"), F.lit(None).cast("boolean").alias("ambiguous"))

    told = matches.unionByName(choices).unionByName(nearest)
    return queries.select("query").join(told, "query", "left").select("query", F.coalesce("kind", F.lit("none")).alias("kind"), "ambiguous", "found")


def nearest_address(points: DataFrame, index: DataFrame, meters: float = 75.0, cell: float = 0.002) -> DataFrame:
    """The nearest entry within ``meters`` (2000 at most) of each point (point_id, lat, lon):
    point_id, oid, distance; ties go to the entry that comes first in the index.

    Distinct places of points meet distinct places of entries, each with the entry that
    comes first there, so what lies at one place is never paired."""
    bound = min(max(meters, 0.0), 2000.0)
    k = F.lit(geo.FRAME_METERS_PER_DEGREE)
    asked = points.select(F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).where("p_lat is not null and p_lon is not null").distinct()
    rows_out = int(-(-bound // (cell * geo.FRAME_METERS_PER_DEGREE)))
    cols_out = F.ceil(F.lit(bound) / (k * cell * F.cos(F.radians("p_lat")))).cast("long")
    r, c = F.floor(F.col("p_lat") / cell), F.floor(F.col("p_lon") / cell)
    asked = asked.withColumn("r", F.explode(F.sequence(r - rows_out, r + rows_out))).withColumn("c", F.explode(F.sequence(c - cols_out, c + cols_out)))
    first = index.groupBy("lat", "lon").agg(F.min(F.struct(*ORDER)).alias("first"))
    placed = first.withColumns({"r": F.floor(F.col("lat") / (cell * SCALE)), "c": F.floor(F.col("lon") / (cell * SCALE))})
    dy = (F.col("lat") - text.half_up(F.col("p_lat") * SCALE)) / SCALE * k
    dx = (F.col("lon") - text.half_up(F.col("p_lon") * SCALE)) / SCALE * k * F.cos(F.radians("p_lat"))
    found = asked.join(placed, ["r", "c"]).withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= bound)
    best = found.groupBy("p_lat", "p_lon").agg(F.min(F.struct("d", "first")).alias("best"))
    told = points.select("point_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).join(best, ["p_lat", "p_lon"])
    return told.groupBy("point_id").agg(F.min("best").alias("best")).select("point_id", F.col("best.first.oid").alias("oid"), F.round("best.d", 1).alias("distance"))


def folded(value: Column | str) -> Column:
    """Lower case without apostrophes, letters and their marks apart; null as ''."""

    @F.pandas_udf("string")
    def apart(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFKD")

    plain = F.regexp_replace(F.lower(F.coalesce(value if isinstance(value, Column) else F.col(value), F.lit(""))), "['’]", "")
    return F.when(plain.rlike(r"^[\x00-\x7f]*$"), plain).otherwise(apart(plain))


#: Letters of a word by which a place is looked up; cells halve from the whole world (1024 degrees) this many times.
GRAM, LEVELS = 3, 24


def _cell(value: Column | str, level: Column) -> Column:
    return F.floor(((F.col(value) if isinstance(value, str) else value) + 512) / 1024 * F.pow(F.lit(2.0), level)).cast("long")


def nearest_places(queries: DataFrame, places: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` places nearest to a query's anchor among those that hold all its words,
    anywhere in label or address: query, rank, label. A search without words gives the
    first ``k`` places of the catalogue; places without a point come first, and an anchor
    without one is as far from all.

    ``queries`` (query, words, lat, lon); ``places`` (place_ord, label, lat, lon and, where it
    is known, address). Distinct sets of words meet places on the first letters, three
    at most, of their longest word, looked up among all runs of so many letters of a
    place; only runs that some set asks for are kept, and all words are checked after.

    Of the places of a set at one point only the first ``k`` by label can be found. An
    anchor's reach is told by the smallest cell around it that holds ``k`` of those: none of the
    ``k`` nearest lies beyond its farthest corner. Anchors then look only in the cells
    of that size in reach; those whose cells nowhere hold ``k``, or beyond 500 degrees, look at all points of the set.
    """
    address = F.col("address") if "address" in places.columns else F.lit(None).cast("string")
    held = places.where("label is not null").select("place_ord", "label", "lat", "lon", folded(F.concat_ws(" ", "label", address)).alias("body"))
    words = F.array_sort(F.array_distinct(F.filter(F.split(folded("words"), r"\s+"), lambda w: w != "")))
    asked = materialise(queries.select("query", words.alias("w"), F.col("lat").cast("double").alias("q_lat"), F.col("lon").cast("double").alias("q_lon")), "searches")
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    typed = materialise(asked.where(F.size("w") > 0).select("w").distinct().withColumns({"gram": F.substring(longest, 1, GRAM), "set": F.monotonically_increasing_id()}), "word-sets")
    # Places are few bytes and much work, so their number of tasks is told; a run counts where it occurs first.
    session = places.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    runs = held.where("body <> ''").repartition(tasks, "place_ord").withColumn("i", F.explode(F.sequence(F.lit(1), F.length("body")))).withColumn("size", F.explode(F.array(*(F.lit(n) for n in range(1, GRAM + 1)))))
    runs = runs.withColumn("gram", F.expr("substring(body, i, size)")).join(typed.select("gram").distinct(), "gram", "left_semi")
    grams = runs.where("length(gram) = size and instr(body, gram) = i").drop("i", "size")
    hit = grams.join(typed, "gram").where(F.forall("w", lambda x: F.contains(F.col("body"), x))).select("set", "place_ord", "label", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    here = Window.partitionBy("set", "lat", "lon").orderBy("label", "place_ord")
    entries = materialise(hit.withColumn("n", F.row_number().over(here)).where(F.col("n") <= k), "places-found")

    anchors = asked.join(typed.select("w", "set"), "w").select("set", "q_lat", "q_lon").distinct()
    dx = (F.col("lon") - F.col("q_lon")) * F.cos(F.radians("q_lat"))
    d2 = F.round((F.col("lat") - F.col("q_lat")) * (F.col("lat") - F.col("q_lat")) + dx * dx, 12)
    points = entries.groupBy("set", "lat", "lon").agg(F.count("*").alias("n"))
    seen = _in_reach(anchors, points, k).withColumn("d2", d2)
    bare_set = entries.withColumn("n", F.row_number().over(Window.partitionBy("set").orderBy("label", "place_ord"))).where(F.col("n") <= k)
    nowhere = anchors.where("q_lat is null or q_lon is null").join(bare_set.drop("n"), "set").withColumn("d2", F.lit(None).cast("double"))
    closer = seen.withColumn("r", F.rank().over(Window.partitionBy("set", "q_lat", "q_lon").orderBy("d2"))).where(F.col("r") <= k).drop("r")
    same = entries["set"].eqNullSafe(closer["set"]) & entries["lat"].eqNullSafe(closer["lat"]) & entries["lon"].eqNullSafe(closer["lon"])
    told = entries.join(closer, same).select(closer["set"], "q_lat", "q_lon", "d2", "label", "place_ord").unionByName(nowhere.select("set", "q_lat", "q_lon", "d2", "label", "place_ord"))
    near = Window.partitionBy("set", "q_lat", "q_lon").orderBy("d2", "label", "place_ord")
    best = told.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).join(typed.select("set", "w"), "set")
    best = best.select(F.col("w").alias("_w"), F.col("q_lat").alias("_lat"), F.col("q_lon").alias("_lon"), "d2", "label", "place_ord")
    found = asked.join(best, (F.col("w") == F.col("_w")) & F.col("q_lat").eqNullSafe(F.col("_lat")) & F.col("q_lon").eqNullSafe(F.col("_lon")))
    # A query that occurs twice is told the nearest of all its rows.
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d2", "label", "place_ord"))).where(F.col("rank") <= k).select("query", "rank", "label")
    first = held.orderBy("place_ord").limit(k).agg(F.array_sort(F.collect_list(F.struct("place_ord", "label"))).alias("first"))
    bare = asked.where(F.size("w") == 0).join(F.broadcast(first), F.lit(True)).select("query", F.posexplode("first").alias("rank", "x"))
    return found.unionByName(bare.select("query", (F.col("rank") + 1).alias("rank"), "x.label"))


def _in_reach(anchors: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(set, q_lat, q_lon, lat, lon): of each anchor with a place, points of its set among which the ``k`` nearest are.

    ``points`` (set, lat, lon, n) count the entries at each."""
    placed = anchors.where("q_lat is not null and q_lon is not null")
    sound = points.where("abs(lat) < 500 and abs(lon) < 500")
    levels = F.explode(F.sequence(F.lit(1), F.lit(LEVELS))).alias("level")
    cells = sound.select("*", levels).select("*", _cell("lat", F.col("level")).alias("r"), _cell("lon", F.col("level")).alias("c"))
    full = cells.groupBy("set", "level", "r", "c").agg(F.sum("n").alias("n")).where(F.col("n") >= k)
    own = placed.where("abs(q_lat) < 89 and abs(q_lon) < 500").select("*", levels).select("*", _cell("q_lat", F.col("level")).alias("r"), _cell("q_lon", F.col("level")).alias("c"))
    finest = own.join(full.drop("n"), ["set", "level", "r", "c"]).groupBy("set", "q_lat", "q_lon").agg(F.max("level").alias("level"))
    size = F.lit(1024.0) / F.pow(F.lit(2.0), F.col("level"))
    off = {c: F.greatest(F.col(q) - (_cell(q, F.col("level")) * size - 512), (_cell(q, F.col("level")) + 1) * size - 512 - F.col(q)) for c, q in (("lat", "q_lat"), ("lon", "q_lon"))}
    shrink = F.cos(F.radians("q_lat"))
    # Distances are compared to 12 digits, so the reach is a little more than the corner's.
    reach = F.sqrt(off["lat"] * off["lat"] + off["lon"] * shrink * off["lon"] * shrink + 1e-11)
    ranged = materialise(finest.withColumn("reach", reach), "reach")
    around = [F.sequence(_cell(F.col(q) - far, F.col("level")), _cell(F.col(q) + far, F.col("level"))) for q, far in (("q_lat", F.col("reach")), ("q_lon", F.col("reach") / shrink))]
    looks = ranged.withColumn("r", F.explode(around[0])).withColumn("c", F.explode(around[1]))
    used = ranged.select("level").distinct()
    near = looks.join(cells.join(F.broadcast(used), "level", "left_semi").drop("n"), ["set", "level", "r", "c"])
    rest = placed.join(ranged.select("set", "q_lat", "q_lon"), ["set", "q_lat", "q_lon"], "left_anti").join(points, "set")
    # Points that are not told come first.
    blank = placed.join(points.where("lat is null or lon is null"), "set").join(ranged.select("set", "q_lat", "q_lon"), ["set", "q_lat", "q_lon"], "left_semi")
    columns = ["set", "q_lat", "q_lon", "lat", "lon"]
    return near.select(*columns).unionByName(rest.select(*columns)).unionByName(blank.select(*columns))

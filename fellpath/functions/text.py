"""Texts, keys and formats of routes and addresses as column expressions.

Everything stays inside code generation but for the 64-bit route key. Null in,
null out, unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

METERS_PER_MILE = 1609.344
#: Canonical forms of address words.
CANONICAL = {
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW",
    "STREET": "ST", "STR": "ST", "AVENUE": "AVE", "AV": "AVE", "ROAD": "RD", "DRIVE": "DR", "LANE": "LN", "BOULEVARD": "BLVD", "BLV": "BLVD",
    "COURT": "CT", "PLACE": "PL", "CIRCLE": "CIR", "HIGHWAY": "HWY", "PARKWAY": "PKWY", "TERRACE": "TER", "TRAIL": "TRL", "SQUARE": "SQ",
    "ALLEY": "ALY", "EXPRESSWAY": "EXPY", "SAINT": "ST", "MOUNT": "MT", "FORT": "FT", "ROUTE": "RTE", "COUNTY": "CO",
}
DIRECTIONALS = ("N", "S", "E", "W", "NE", "NW", "SE", "SW")
#: Display style of a trail by its exact name.
STYLE_OF_NAME = {
    "Bloomer Line": "BloomerLine", "Collegiate": "Collegiate", "Illinois Central": "IllinoisCentral", "Interurban": "Interurban", "Northtown": "Northtown",
    "Route 66": "Route66", "Route 66 - Advanced": "Route66Advanced", "Route 66 - Alternate": "Route66Alternate",
    "Route 66 & Illinois Central": "Route66IllinoisCentral", "Route 66 & Southtown": "Route66Southtown", "Southtown": "Southtown",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x: Column | str) -> Column:
    """Nearest whole number, halves upwards, as BIGINT."""
    return F.floor(_c(x) + F.lit(0.5)).cast("long")


def name_key(name: Column | str) -> Column:
    """A trimmed name; blank names are null."""
    trimmed = F.regexp_replace(_c(name), r"^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def names_match(first: Column | str, second: Column | str) -> Column:
    """Equal but for case and outer blanks; no name matches no name. Never null."""
    return F.lower(name_key(first)).eqNullSafe(F.lower(name_key(second)))


def coordinate(lat: Column | str, lon: Column | str) -> Column:
    """A point in whole units of 1e-7 degrees, ``lat,lon``."""
    return F.concat(half_up(_c(lat) * 1e7).cast("string"), F.lit(","), half_up(_c(lon) * 1e7).cast("string"))


def traversal_key(source: Column | str, coordinates: Column | str) -> Column:
    """``source#geometry`` whatever the direction; ``coordinates`` is an ordered array of ``coordinate``."""
    points = _c(coordinates)
    both = F.least(F.array_join(points, ";"), F.array_join(F.reverse(points), ";"))
    geometry = F.when(F.size(points) > 0, both).otherwise("unknown")
    return F.concat(F.coalesce(name_key(source), F.lit("unattributed")), F.lit("#"), geometry)


def key_identity(key: Column | str) -> Column:
    """The geometry part of a key with its ``#``; the whole key where that is unknown."""
    key = _c(key)
    geometry = F.substring_index(key, "#", -1)
    return F.when((F.instr(key, "#") == 0) | geometry.isin("", "unknown"), key).otherwise(F.concat(F.lit("#"), geometry))


def key_points(key: Column | str) -> Column:
    """Points of a key as array<struct<lat,lon>>; null unless two or more well-formed points."""
    identity = key_identity(key)
    parts = F.split(F.substring(identity, 2, 1 << 30), ";")
    good = F.forall(parts, lambda p: p.rlike(r"^[+-]?\d{1,18},[+-]?\d{1,18}$"))
    points = F.transform(parts, lambda p: F.struct((F.split(p, ",")[0].try_cast("long") / 1e7).alias("lat"), (F.split(p, ",")[1].try_cast("long") / 1e7).alias("lon")))
    return F.when(identity.startswith("#") & good & (F.size(parts) >= 2), points)


def display_style(status: Column | str, roles: Column | str, name: Column | str) -> Column:
    """Style of a feature: proposed first, then its exact name, then its roles (array)."""
    roles, key = _c(roles), name_key(name)
    by_name = F.lit(None).cast("string")
    for label, style in STYLE_OF_NAME.items():
        by_name = F.when(key == label, style).otherwise(by_name)
    by_role = F.when(F.array_contains(roles, "ParkConnectors"), "ParkTrailConnectors").when(F.array_contains(roles, "SharedRoadways"), "SuggestedSharedRoadways").when(F.array_contains(roles, "TrailBranches"), "Route66").otherwise("Unknown")
    return F.when((_c(status) == "Proposed") | F.array_contains(roles, "ProposedTrails"), "Proposed").otherwise(F.coalesce(by_name, by_role))


def route_roles(layer: Column | str, facility: Column | str, system: Column | str, activity: Column | str) -> Column:
    """Roles of a feature by the coded values of its source layer (54 trails, 16 parks)."""
    layer, facility, system, activity = (_c(x) for x in (layer, facility, system, activity))
    trails = [F.lit("TrailBranches"), F.when(facility.isin("1", "4"), "SharedRoadways")]
    parks = [F.when(system.isin("3", "4") & (activity == "2"), "ParkConnectors"), F.when((system == "4") & (activity == "1"), "SharedRoadways")]
    return F.when(layer == 54, F.array_compact(F.array(*trails))).when(layer == 16, F.array_compact(F.array(*parks))).otherwise(F.array().cast("array<string>"))


def duration_text(meters: Column | str) -> Column:
    """Riding time at 8 miles an hour, one minute at least."""
    minutes = F.greatest(F.lit(1), half_up(_c(meters) / METERS_PER_MILE / 8.0 * 60))
    long = F.concat((F.floor(minutes / 60)).cast("string"), F.lit(" hr "), (minutes % 60).cast("string"), F.lit(" min"))
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(long)


def instruction_distance(meters: Column | str) -> Column:
    """``Now``, feet in steps of 25 below 500, else miles to a tenth."""
    meters = _c(meters)
    feet, tenths = meters * 3.28084, half_up(meters / METERS_PER_MILE * 10.0)
    miles = F.when(tenths % 10 == 0, F.floor(tenths / 10).cast("string")).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")))
    return F.when(meters < 1.0, "Now").when(feet < 500.0, F.concat((half_up(feet / 25.0) * 25).cast("string"), F.lit(" ft"))).otherwise(F.concat(miles, F.lit(" mi")))


def mileage(miles: Column | str) -> Column:
    """Miles with up to two decimals, one at least."""
    return (F.rint(_c(miles) * 100.0) / 100.0).cast("string")


def miles_text(meters: Column | str) -> Column:
    """Metres as miles to a tenth."""
    tenths = half_up(_c(meters) / METERS_PER_MILE * 10)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def route_summary(total: Column | str, access: Column | str, shared: Column | str) -> Column:
    """One line of a route's trail, shared-road, access and total miles."""
    total, access, shared = (_c(x) for x in (total, access, shared))

    def text(meters: Column) -> Column:
        miles = meters / METERS_PER_MILE
        return F.when(miles < 0.05, "0.00").otherwise(mileage(miles))

    trail = F.greatest(F.lit(0.0), total - access - shared)
    roads = F.when(shared > 0.01, F.concat(F.lit(", "), text(shared), F.lit(" shared-road miles"))).otherwise("")
    return F.concat(F.lit("Trail route found: "), text(trail), F.lit(" trail/connector miles"), roads, F.lit(", "), text(access), F.lit(" access miles, "), text(total), F.lit(" total miles."))


def loop_summary(total: Column | str, requested: Column | str, overlap: Column | str) -> Column:
    """One line of an exercise loop: whether it is near its target, length, time, metres ridden twice."""
    total, overlap = _c(total), _c(overlap)
    target = F.coalesce(_c(requested), total)
    exact = F.abs(total - target) <= F.greatest(F.lit(160.0), target * 0.1)
    again = F.when(overlap >= 50.0, F.concat(F.lit("; "), mileage(overlap / METERS_PER_MILE), F.lit(" mi retraced"))).otherwise("")
    return F.concat(F.when(exact, "Exercise loop found").otherwise("Closest exercise route found"), F.lit(": "), mileage(total / METERS_PER_MILE), F.lit(" mi, about "), duration_text(total), F.lit(" at 8 mph"), again, F.lit("."))


def elapsed_text(then_ms: Column | str, now_ms: Column | str) -> Column:
    """How long ago, in whole minutes, hours or days; the future is just now."""
    gone = F.greatest(F.lit(0), _c(now_ms) - _c(then_ms))

    def whole(unit: int) -> Column:
        return F.floor(gone / unit).cast("string")

    return F.when(gone < 60_000, "Just now").when(gone < 3_600_000, F.concat(whole(60_000), F.lit(" min ago"))).when(gone < 86_400_000, F.concat(whole(3_600_000), F.lit(" hr ago"))).when(gone < 172_800_000, "1 day ago").otherwise(F.concat(whole(86_400_000), F.lit(" days ago")))


def address_tokens(text: Column | str) -> Column:
    """Upper-case words of an address in canonical form; null gives none."""
    plain = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(_c(text), F.lit(""))), "[.,#]", " "), r"\s*&\s*", " AND ")
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    canonical = F.create_map(*(F.lit(x) for pair in CANONICAL.items() for x in pair))
    return F.transform(words, lambda w: F.coalesce(canonical[w], w))


def alias_completions(token: Column | str) -> Column:
    """Sorted canonical words of which an alias starts with ``token`` (two letters at least)."""
    token = _c(token)
    pairs = F.array(*(F.struct(F.lit(a).alias("alias"), F.lit(c).alias("word")) for a, c in CANONICAL.items()))
    found = F.transform(F.filter(pairs, lambda p: p["alias"].startswith(token)), lambda p: p["word"])
    return F.when(F.length(token) >= 2, F.array_sort(F.array_distinct(found))).otherwise(F.array().cast("array<string>"))


HOUSE_NUMBER = r"^(\d+)(?:-?([A-Z])|-(\d+)|(1/2))?$"


def house_number(token: Column | str) -> Column:
    """struct (num, suffix) of a house number such as 12, 12A, 12-3 or 121/2; null if it is none."""
    token = _c(token)
    letter, unit, half = (F.regexp_extract(token, HOUSE_NUMBER, k) for k in (2, 3, 4))
    suffix = F.when(letter != "", letter).when(unit != "", F.concat(F.lit("-"), unit)).otherwise(half)
    return F.when(token.rlike(HOUSE_NUMBER), F.struct(F.regexp_extract(token, HOUSE_NUMBER, 1).cast("long").alias("num"), suffix.alias("suffix")))


def unit_text(building: Column | str, unit: Column | str) -> Column:
    """``BLDG x`` and the unit, upper case; empty without either."""
    parts = [F.when(_c(building) != "", F.concat(F.lit("BLDG "), F.upper(name_key(building)))), F.upper(name_key(unit))]
    return F.array_join(F.array_compact(F.array(*parts)), " ")


def _titled(word: Column) -> Column:
    return F.concat(F.substring(word, 1, 1), F.lower(F.substring(word, 2, 1 << 30)))


def street_title(street: Column | str) -> Column:
    """A street with capital initials; directions and words with digits stay."""
    return F.array_join(F.transform(F.split(_c(street), " "), lambda w: F.when(w.isin(*DIRECTIONALS) | w.rlike(r"\d"), w).otherwise(_titled(w))), " ")


def city_title(city: Column | str) -> Column:
    return F.array_join(F.transform(F.split(_c(city), " "), _titled), " ")


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """Compact JSON of named values with sorted keys; nulls stay as ``null``."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenation."""
    return F.sha2(F.concat(*parts), 256)


def route_key(value: Column | str) -> Column:
    """``route-`` and the 64-bit FNV-1a hash of the UTF-8 bytes, 16 hex digits."""
    return F.pandas_udf(_route_keys, "string")(_c(value))


def _route_keys(value: pd.Series) -> pd.Series:
    raw = [None if v is None else v.encode() for v in value]
    size = max((len(r) for r in raw if r is not None), default=0)
    out, prime = np.full(len(raw), 0xCBF29CE484222325, np.uint64), np.uint64(0x100000001B3)
    # Byte k of all values at once; each value stops at its own length.
    order = sorted(range(len(raw)), key=lambda i: -len(raw[i] or b""))
    live = len(order)
    for k in range(size):
        while live and len(raw[order[live - 1]] or b"") <= k:
            live -= 1
        at = order[:live]
        out[at] = (out[at] ^ np.fromiter((raw[i][k] for i in at), np.uint64, live)) * prime
    return pd.Series([None if r is None else f"route-{int(h):016x}" for r, h in zip(raw, out, strict=True)], dtype=object)


def utc_millis(text: Column | str) -> Column:
    """Epoch milliseconds of an ISO time of zero offset; null for any other offset or text."""
    text = _c(text)
    zero = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]00:00)$")
    return F.when(zero, F.unix_millis(F.try_to_timestamp(F.regexp_replace(text, r"(Z|[+-]00:00)$", "+00:00"))))


def source_time(millis: Column | str) -> Column:
    """Epoch milliseconds as ISO text in UTC."""
    millis = _c(millis)
    whole = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.floor(millis / 1000)), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    rest = F.pmod(millis, F.lit(1000))
    return F.concat(whole, F.when(rest > 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 3, "0"), F.lit("000"))).otherwise(""), F.lit("Z"))


def network_prefix(ip: Column | str) -> Column:
    """A dotted IPv4 address in plain numbers, or the first 64 bits of an IPv6
    address; mapped IPv4 counts as IPv4; null if it is no address."""
    ip = _c(ip)
    four = F.split(ip, r"\.")
    is_four = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(four, lambda p: p.try_cast("int") <= 255)
    sides = F.split(F.lower(ip), "::")
    left = F.filter(F.split(sides[0], ":"), lambda p: p != "")
    right = F.when(F.size(sides) > 1, F.filter(F.split(F.get(sides, F.lit(1)), ":"), lambda p: p != "")).otherwise(F.array().cast("array<string>"))
    gap = F.lit(8) - F.size(left) - F.size(right)
    groups = F.concat(left, F.when(F.size(sides) > 1, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0)))).otherwise(F.array().cast("array<string>")), right)
    is_six = ip.rlike(r"^[0-9A-Fa-f:]+$") & F.contains(ip, F.lit(":")) & (F.size(sides) <= 2) & (F.size(groups) == 8) & F.forall(groups, lambda g: F.length(g) <= 4) & ((F.size(sides) == 1) | (gap > 0)) & ~ip.rlike(r":::|^:[^:]|[^:]:$")
    number = F.transform(groups, lambda g: F.conv(g, 16, 10).cast("int"))
    mapped = F.forall(F.slice(number, 1, 5), lambda n: n == 0) & (F.element_at(number, 6) == 0xFFFF)
    bytes_ = [F.floor(F.element_at(number, 7) / 256), F.element_at(number, 7) % 256, F.floor(F.element_at(number, 8) / 256), F.element_at(number, 8) % 256]
    first = F.concat(F.array_join(F.transform(F.slice(number, 1, 4), lambda n: F.lower(F.hex(n.cast("long")))), ":"), F.lit("::/64"))
    six = F.when(mapped, F.concat_ws(".", *(b.cast("string") for b in bytes_))).otherwise(first)
    return F.when(F.length(ip) > 64, None).when(is_four, F.array_join(F.transform(four, lambda p: p.try_cast("int").cast("string")), ".")).when(is_six, six)


def parsed_miles(text: Column | str) -> Column:
    """A finite number of miles from typed text, else null."""
    value = name_key(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def loop_target_valid(meters: Column | str) -> Column:
    """Half a mile to a hundred miles; never null."""
    meters = _c(meters)
    return F.coalesce(~F.isnan(meters) & meters.between(0.5 * METERS_PER_MILE, 100 * METERS_PER_MILE), F.lit(False))


def first_place(address: Column | str) -> Column:
    """What precedes the first comma, trimmed; null if that is empty."""
    return name_key(F.split_part(_c(address), F.lit(","), F.lit(1)))


def fixed(value: Column | str, places: int = 5) -> Column:
    """A number with a fixed count of decimals; a value that rounds to zero has no sign."""
    value, scale = _c(value), 10**places
    scaled = half_up(F.abs(value) * scale)
    text = F.concat(F.floor(scaled / scale).cast("string"), F.lit("."), F.lpad((scaled % scale).cast("string"), places, "0"))
    return F.when((value < 0) & (scaled != 0), F.concat(F.lit("-"), text)).otherwise(text)


def point_label(lat: Column | str, lon: Column | str) -> Column:
    return F.concat(F.lit("Map point "), fixed(lat), F.lit(", "), fixed(lon))


def share_text(title: Column | str, summary: Column | str, turnarounds: Column | str, footer: str) -> Column:
    """Lines of a shared route; ``turnarounds`` is the array of distances at which it turns back."""
    labels = F.transform(_c(turnarounds), instruction_distance)
    n = F.size(labels)
    places = F.when(n == 1, labels[0]).otherwise(F.concat(F.array_join(F.slice(labels, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(labels, -1)))
    count = F.when(n == 1, "1 turnaround").otherwise(F.concat(n.cast("string"), F.lit(" turnarounds")))
    line = F.when(n > 0, F.concat(count, F.lit(": turn back at "), places, F.lit(".\n"))).otherwise("")
    return F.concat(_c(title), F.lit("\n"), _c(summary), F.lit("\n"), line, F.lit(f"\n{footer}"))

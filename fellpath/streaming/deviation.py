"""States of a ride over its fixes: off-route, ridden distance, completion, reroutes.

Every fix is first classified by itself: ``bad`` (too coarse, or looked at too
late), ``on`` the route, clearly ``off`` it, or ``near`` its edge. All that
depends on the past is then read from runs of such classes:

- a stretch begins at each ``on`` and after each gap between good fixes; its
  ``off`` fixes are the evidence that the route was left, which is sure once
  there are enough of them, over long and far enough;
- a run of ``on`` fixes without anything between them shows a return;
- whichever of both came last decides whether the rider is off the route.

``statuses`` and ``completion`` are windows over a ride in the JVM. ``track`` is the
same rule on a stream, where a ride's state is a stretch begun, a run begun and
which event was last; it takes each batch as arrays. Ridden distance and reroutes
depend on their own last value; ``ridden`` and ``reroutes`` go from event to event
in numpy, and only over one ride at a time.

Defined results: fixes of a null rider are one ride; a null accuracy is never
credible; null distances are neither on nor off the route; a ride's ``seq`` should
be a key. In a stream fixes are taken in the order of ``fix_ms`` within a batch,
and one not newer than the last taken is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fellpath.functions import geo

#: Metres, milliseconds and counts of the rules.
OFF_ROUTE, ON_ROUTE = 50.0, 35.0
ACCURACY, FIX_AGE_MS, GAP_MS = 25.0, 10_000, 15_000
CONFIRM_FIXES, CONFIRM_MS, CONFIRM_METERS, RETURN_FIXES = 3, 15_000, 25.0, 2
STEP_METERS, JUMP_METERS = 300.0, 150.0
REROUTE_MS, REROUTE_METERS = 30_000, 100.0
LOST_MS = 10_000
FALLBACK_METERS, FALLBACK_MS = 45.0, 4_000
#: Fixes that are looked at together for the next event of a ride.
CHUNK = 512

BAD, ON, NEAR, OFF = "bad", "on", "near", "off"
STATUS = {"on": "OnRoute", "lost": "UncertainPosition", "maybe": "PossiblyOffRoute", "sure": "ConfirmedOffRoute"}


def fix_class() -> Column:
    """What a fix (accuracy_m, fix_ms, now_ms, off_m) tells by itself."""
    age = F.col("now_ms") - F.col("fix_ms")
    good = (F.col("accuracy_m") <= ACCURACY) & ~F.isnan("accuracy_m") & age.between(0, FIX_AGE_MS)
    return F.when(~F.coalesce(good, F.lit(False)), BAD).when(F.col("off_m") <= ON_ROUTE, ON).when(F.col("off_m") - F.col("accuracy_m") > OFF_ROUTE, OFF).otherwise(NEAR)


def statuses(fixes: DataFrame, ride: str = "rider", order: str = "seq") -> DataFrame:
    """``fixes`` with ``status``, ``streak_fixes`` (the evidence of a departure so far, null
    once it is sure) and ``return_fixes`` (fixes back on the route while it is sure)."""
    w = Window.partitionBy(ride).orderBy(order)
    until, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("_kind")
    rows = fixes.withColumn("_kind", fix_class())
    last = F.last(F.when(kind != BAD, F.col("fix_ms")), ignorenulls=True).over(before)
    rows = rows.withColumn("_gap", F.coalesce((kind != BAD) & (F.col("fix_ms") - last > GAP_MS), F.lit(False)))
    rows = rows.withColumns({
        "_stretch": F.sum(((kind == ON) | F.col("_gap")).cast("int")).over(until),
        "_run": F.sum(((kind != ON) | F.col("_gap")).cast("int")).over(until),
    })
    stretch = Window.partitionBy(ride, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = Window.partitionBy(ride, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    first = {c: F.first(F.when(kind == OFF, F.col(c)), ignorenulls=True).over(stretch) for c in ("fix_ms", "lat", "lon")}
    rows = rows.withColumns({"_n": F.sum((kind == OFF).cast("int")).over(stretch), "_back": F.sum((kind == ON).cast("int")).over(run)} | {f"_first_{c}": x for c, x in first.items()})
    sure = (kind == OFF) & (F.col("_n") >= CONFIRM_FIXES) & (F.col("fix_ms") - F.col("_first_fix_ms") >= CONFIRM_MS) & (geo.haversine("_first_lat", "_first_lon", "lat", "lon") >= CONFIRM_METERS)
    back = (kind == ON) & (F.col("_back") >= RETURN_FIXES)
    rows = rows.withColumn("_sure", F.coalesce(F.last(F.when(sure, True).when(back, False), ignorenulls=True).over(until), F.lit(False)))
    status = F.when(F.col("_sure"), STATUS["sure"]).when(kind == BAD, STATUS["lost"]).when((kind == ON) | (F.col("_n") == 0), STATUS["on"]).otherwise(STATUS["maybe"])
    counted = {"streak_fixes": F.when(~F.col("_sure"), F.col("_n")), "return_fixes": F.when(F.col("_sure") & (kind == ON), F.col("_back")).otherwise(0)}
    return rows.withColumns({"status": status} | counted).select(*(c for c in fixes.columns if c not in ("status", *counted)), "status", *counted)


def completion(rows: DataFrame, ride: str = "rider", order: str = "seq") -> DataFrame:
    """``rows`` (progress, whole, off_m) with ``departed``, ``verified`` metres and ``completed``.

    Verified are steps ahead of the furthest place so far, up to 300 m each. A ride is
    complete at three quarters verified, near the end and the route. Rows without
    progress, and where there is a column ``kind`` all but loops, change nothing.
    """
    w = Window.partitionBy(ride).orderBy(order)
    until, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    counts = F.col("progress").isNotNull() & (F.coalesce(F.col("kind") == "ExerciseLoop", F.lit(False)) if "kind" in rows.columns else F.lit(True))
    progress, whole = F.when(counts, F.col("progress")), F.col("whole")
    out = rows.withColumn("_step", progress - F.greatest(F.lit(0.0), F.coalesce(F.max(progress).over(before), F.lit(0.0))))
    step = F.when((F.col("_step") > 0) & (F.col("_step") <= STEP_METERS), F.col("_step")).otherwise(0.0)
    gone = F.coalesce(progress >= F.greatest(F.lit(100.0), whole * 0.05), F.lit(False))
    out = out.withColumns({"verified": F.sum(step).over(until), "departed": F.max(gone).over(until)})
    done = F.col("departed") & (F.col("verified") >= whole * 0.75) & (whole - progress <= F.greatest(F.lit(45.0), whole * 0.015)) & (F.col("off_m") <= 40.0)
    return out.withColumn("completed", F.max(F.coalesce(done, F.lit(False))).over(until)).drop("_step")


def credited(rows: DataFrame, ride: str = "rider", order: str = "seq") -> DataFrame:
    """``rows`` (fix_ms, off_m, accuracy_m, progress) with ``deviated``, ``off_route`` and ``credited`` metres so far.

    A fix deviates beyond 45 m and twice its accuracy; four seconds of that are off the
    route, unless a column ``off_route`` decides. Only progress between two fixes in a row
    that do not deviate is credited. Fixes without accuracy or progress are left out.
    """
    w = Window.partitionBy(ride).orderBy(order)
    until = w.rowsBetween(Window.unboundedPreceding, 0)
    told = F.col("off_route") if "off_route" in rows.columns else F.lit(None).cast("boolean")
    out = rows.where("accuracy_m is not null and progress is not null and off_m is not null")
    out = out.withColumn("deviated", F.col("off_m") > F.greatest(F.lit(FALLBACK_METERS), F.col("accuracy_m") * 2)).withColumn("_run", F.sum((~F.col("deviated")).cast("int")).over(until))
    since = F.min(F.when(F.col("deviated"), F.col("fix_ms"))).over(Window.partitionBy(ride, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    step = F.when(~F.col("deviated") & ~F.lag("deviated").over(w), F.greatest(F.lit(0.0), F.col("progress") - F.lag("progress").over(w))).otherwise(0.0)
    out = out.withColumns({"off_route": F.coalesce(told, F.col("deviated") & (F.col("fix_ms") - since >= FALLBACK_MS)), "_step": step})
    return out.withColumn("credited", F.sum("_step").over(until)).drop("_run", "_step")


def metres_ridden(progress: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Metres ridden for certain after each fix of one ride, and the place of a jump that waits (nan: none).

    While no fix lands more than a step ahead, what is ridden is the running maximum
    of fixes on the route. A fix beyond that is a jump: it waits while fixes stay on
    the route within a step ahead of where it landed, moves if they do not, and
    counts once they are far enough on; any fix off the route or back ends it.
    """
    n = len(progress)
    seen, on = ~np.isnan(progress), off <= OFF_ROUTE
    told, waits = np.zeros(n), np.full(n, np.nan)
    at, done, jump = 0, 0.0, np.nan
    while at < n:
        if np.isnan(jump):
            some = np.where(seen & on, progress, -np.inf)[at : at + CHUNK]
            top = np.maximum.accumulate(np.concatenate(([done], some)))
            beyond = np.flatnonzero(some > top[:-1] + STEP_METERS)
            calm = int(beyond[0]) if len(beyond) else len(some)
            told[at : at + calm], done, at = top[1 : calm + 1], float(top[calm]), at + calm
            if len(beyond):
                jump = some[calm]
                told[at], waits[at] = done, jump
                at += 1
            continue
        ahead = progress[at] - jump
        if not seen[at]:
            pass
        elif not on[at] or progress[at] <= done:
            jump = np.nan
        elif progress[at] <= done + STEP_METERS or JUMP_METERS <= ahead <= STEP_METERS:
            done, jump = float(progress[at]), np.nan
        elif not 0 <= ahead <= STEP_METERS:
            jump = progress[at]
        told[at], waits[at] = done, jump
        at += 1
    return told, waits


def _by_ride(rows: DataFrame, ride: str, order: str, columns: list[str], schema: str, of_ride) -> DataFrame:
    """``of_ride(sorted frame)`` for each ride; a task holds one ride at a time."""
    needed = rows.select(*dict.fromkeys([ride, order, *columns]))
    return needed.groupBy(ride).applyInPandas(lambda part: of_ride(part.sort_values(order, kind="stable")), schema)


def ridden(rows: DataFrame, ride: str = "rider", order: str = "seq") -> DataFrame:
    """(ride, order, ridden, pending) of every row (progress, off_m)."""

    def of_ride(part: pd.DataFrame) -> pd.DataFrame:
        told, waits = metres_ridden(part["progress"].to_numpy(np.float64, na_value=np.nan), part["off_m"].to_numpy(np.float64, na_value=np.inf))
        return part[[ride, order]].assign(ridden=told, pending=pd.Series(waits, part.index).astype(object).where(~np.isnan(waits), None))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return _by_ride(rows, ride, order, ["progress", "off_m"], f"{ride} {kinds[ride]}, {order} {kinds[order]}, ridden double, pending double", of_ride)


def _metres(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lats)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * geo.EARTH_RADIUS * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def reroutes(fixes: DataFrame, ride: str = "rider", order: str = "seq") -> DataFrame:
    """(ride, order) of the fixes at which a way back is searched for: good ones surely off
    the route, 30 s and 100 m after the last search. Only such fixes reach Python."""
    asking = statuses(fixes, ride, order).where((F.col("status") == STATUS["sure"]) & (fix_class() != BAD))

    def of_ride(part: pd.DataFrame) -> pd.DataFrame:
        ms, lat, lon = (part[c].to_numpy(np.float64) for c in ("fix_ms", "lat", "lon"))
        asked, at = [0], 1
        while at < len(ms):
            last = asked[-1]
            some = slice(at, at + CHUNK)
            due = np.flatnonzero((ms[some] - ms[last] >= REROUTE_MS) & (_metres(lat[last], lon[last], lat[some], lon[some]) >= REROUTE_METERS))
            if len(due):
                asked.append(at + int(due[0]))
            at = asked[-1] + 1 if len(due) else at + CHUNK
        return part[[ride, order]].iloc[asked]

    kinds = {f.name: f.dataType.simpleString() for f in fixes.schema}
    return _by_ride(asking, ride, order, ["fix_ms", "lat", "lon"], f"{ride} {kinds[ride]}, {order} {kinds[order]}", of_ride)


@dataclass
class Ride:
    """What the next batch needs of a ride's past."""

    good_ms: float = np.nan
    n_off: int = 0
    first_ms: float = np.nan
    first_lat: float = np.nan
    first_lon: float = np.nan
    n_on: int = 0
    sure: bool = False
    taken_ms: int = -1
    lost: bool = False


def _filled(at: np.ndarray) -> np.ndarray:
    """For each place the last place up to it that ``at`` marks, -1 before the first."""
    return np.maximum.accumulate(np.where(at, np.arange(len(at)), -1))


def advance(ride: Ride, kind: np.ndarray, ms: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[Ride, list[str]]:
    """The statuses of a batch of fixes in order, and the state after it."""
    n = len(kind)
    good, on, off = kind != BAD, kind == ON, kind == OFF
    before = np.concatenate(([-1], _filled(good)[:-1]))
    gap = good & (ms - np.where(before < 0, ride.good_ms, ms[before]) > GAP_MS)
    begins = _filled(on | gap)
    total = np.concatenate(([0], np.cumsum(off)))
    n_off = total[1:] - np.where(begins < 0, -ride.n_off, total[np.maximum(begins, 0)])
    places = np.append(np.flatnonzero(off), n)
    own = places[np.searchsorted(places, np.maximum(begins, 0))]
    held = (begins < 0) & (ride.n_off > 0)
    ms_, lat_, lon_ = (np.append(x, np.nan) for x in (ms.astype(np.float64), lat, lon))
    first = [np.where(held, past, x[own]) for past, x in ((ride.first_ms, ms_), (ride.first_lat, lat_), (ride.first_lon, lon_))]
    sure = off & (n_off >= CONFIRM_FIXES) & (ms - first[0] >= CONFIRM_MS)
    sure &= _metres(first[1], first[2], lat, lon) >= CONFIRM_METERS
    broken = _filled(~on)
    opened = _filled(~on | gap)
    n_on = np.where(on, np.arange(n) - opened + np.where(opened < 0, ride.n_on, opened > broken), 0)
    back = on & (n_on >= RETURN_FIXES)
    event = _filled(sure | back)
    is_sure = np.where(event < 0, ride.sure, sure[np.maximum(event, 0)])
    status = np.where(is_sure, STATUS["sure"], np.where(~good, STATUS["lost"], np.where(on | (n_off == 0), STATUS["on"], STATUS["maybe"])))
    last = _filled(good)[-1]
    end = Ride(float(ms[last]) if last >= 0 else ride.good_ms, int(n_off[-1]), *((float(x[-1]) if n_off[-1] else np.nan) for x in first), int(n_on[-1]), bool(is_sure[-1]), int(ms[-1]), False)
    return end, status.tolist()


_STATE = "good_ms double, n_off int, first_ms double, first_lat double, first_lon double, n_on int, sure boolean, taken_ms long, lost boolean"


class RideStates(StatefulProcessor):
    """Statuses of the fixes of a ride; with timers, also ``SignalLost`` when no fix comes for ten seconds."""

    def __init__(self, timers: bool) -> None:
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ride = handle.getValueState("ride", _STATE)

    def _held(self) -> Ride:
        held = self.ride.get()
        return Ride(*held) if held is not None else Ride()

    def _keep(self, ride: Ride) -> None:
        self.ride.update(tuple(kind(x) for kind, x in zip((float, int, float, float, float, int, bool, int, bool), astuple(ride), strict=True)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ride = self._held()
        batch = pd.concat(list(rows), ignore_index=True).sort_values("fix_ms", kind="stable")
        batch = batch[batch["fix_ms"] > ride.taken_ms].drop_duplicates("fix_ms")
        if len(batch):
            ride, told = advance(ride, batch["kind"].to_numpy(object), batch["fix_ms"].to_numpy(np.int64), batch["lat"].to_numpy(np.float64), batch["lon"].to_numpy(np.float64))
            self._keep(ride)
            if self.timers:
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + LOST_MS)
            yield pd.DataFrame({"rider": key[0], "fix_ms": batch["fix_ms"].to_numpy(np.int64), "status": told})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ride = self._held()
        if not ride.lost:
            ride.lost = True
            self._keep(ride)
            yield pd.DataFrame({"rider": [key[0]], "fix_ms": [ride.taken_ms], "status": ["SignalLost"]})

    def close(self) -> None:
        pass


OUTPUT = "rider long, fix_ms long, status string"


def track(fixes: DataFrame, *, timers: bool = False) -> DataFrame:
    """A stream of fixes (rider, fix_ms, now_ms, lat, lon, accuracy_m, off_m) as a stream of
    (rider, fix_ms, status). Needs the RocksDB state store."""
    rows = fixes.select("rider", "fix_ms", "lat", "lon", fix_class().alias("kind"))
    return rows.groupBy("rider").transformWithStateInPandas(RideStates(timers), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime" if timers else "None")


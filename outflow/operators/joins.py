"""Joins Spark has no single operator for: as-of, interval, spatial range, tolerance clusters.

All of them become equi-joins or windows on a key plus a slice of time, space or value, so a hot key is cut
into many small groups; duplicates are counted before anything is shuffled, and no step pairs up a whole group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outflow.functions import scalar as fx
from outflow.functions.ordering import nearest_value, running_totals
from outflow.operators.listing import at, named_accounts
from outflow.session import durable, shuffle_width


def dense_grid(keys: DataFrame, name: str, start: Column, end: Column, step: str | None = None) -> DataFrame:
    """Every key with every point of a calendar, made row by row from the keys (no cross join)."""
    points = F.sequence(start, end, F.expr(f"interval {step}")) if step else F.sequence(start, end)
    return keys.withColumn(name, F.explode(points))


def _slice_of(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds).cast("bigint")


def _asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, out: str, forward: bool, strict: bool) -> DataFrame:
    """Nearest right time per distinct (key, left time).

    Only the key and the time travel, and both sides are reduced to distinct times first. The rows are cut into range
    blocks of like size over (key, time), so that a hot key is many blocks; from block to block one row is carried.
    """
    want = left.select(*by, F.col(left_ts).alias("_t")).distinct()
    have = right.select(*by, F.col(right_ts).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    # On equal times, put the right row where the frame does (or, if strict, does not) reach it.
    right_side = 1 if forward != strict else 0
    both = have.select(*by, "_t", F.lit(right_side).alias("_side"), F.col("_t").alias("_r")).unionByName(
        want.select(*by, "_t", F.lit(1 - right_side).alias("_side"), F.lit(None).cast("timestamp_ntz").alias("_r"))
    )
    found = nearest_value(both, by, [F.col("_t"), F.col("_side")], "_r", out, forward)
    return found.where(F.col("_side") == 1 - right_side).select(*by, F.col("_t").alias(left_ts), out)


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, out: str = "matched_ts",
                  strict: bool = False) -> DataFrame:
    """Add the latest right time at or before each left time (before, if strict) of the same key."""
    matched = _asof(left, right, by, left_ts, right_ts, out, False, strict)
    return left.join(matched, [*by, left_ts], "left")


def asof_forward(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, out: str = "matched_ts",
                 strict: bool = False) -> DataFrame:
    """Add the earliest right time at or after each left time (after, if strict) of the same key."""
    matched = _asof(left, right, by, left_ts, right_ts, out, True, strict)
    return left.join(matched, [*by, left_ts], "left")


def flag_linked(withdrawals: DataFrame, complaints: DataFrame, name: str = "linked") -> DataFrame:
    """Mark withdrawals whose account any complaint names."""
    named = named_accounts(complaints).withColumn(name, F.lit(True))
    return withdrawals.join(named, "account_token", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def linked_only(withdrawals: DataFrame, complaints: DataFrame) -> DataFrame:
    return withdrawals.join(named_accounts(complaints), "account_token", "left_semi")


def pending_alerts(alerts: DataFrame, outcomes: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Alerts old enough to be judged that have no outcome yet."""
    old = alerts.where(F.col("created_at") <= at(as_of - timedelta(hours=hours)))
    return old.join(outcomes.select("alert_id"), "alert_id", "left_anti")


#: Rows of one side that meet in one group of a join.
GROUP_ROWS = 50_000
#: Hot groups of a join that are sent to every task; beyond, the planner joins them.
HOT_GROUPS = 100_000


def bounded_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bound: int = GROUP_ROWS) -> DataFrame:
    """An inner join on keys in which no group meets more than about ``bound`` rows of either side.

    A key with more is cut into chunks of both sides by hash; every chunk of one side is sent to all chunks of the other, so
    a hot key is a grid of groups. Keys below the bound are joined as they are.
    """
    n = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / bound).alias(name))
    hot = durable(n(left, "_rows").join(n(right, "_cols"), list(keys)).where("_rows > 1 OR _cols > 1"))
    groups = hot.count()
    if not groups:
        return left.join(right, list(keys))
    hot = F.broadcast(hot) if groups <= HOT_GROUPS else hot
    # The number of the row keeps equal rows apart.
    chunk = lambda df, of: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) + F.monotonically_increasing_id(), F.coalesce(F.col(of), F.lit(1)))
    all_of = lambda of: F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(of), F.lit(1)).cast("bigint") - 1))
    cut_left = left.join(hot, list(keys), "left").withColumn("_row", chunk(left, "_rows")).withColumn("_col", all_of("_cols"))
    cut_right = right.join(hot, list(keys), "left").withColumn("_col", chunk(right, "_cols")).withColumn("_row", all_of("_rows"))
    grid = [*keys, "_row", "_col"]
    return cut_left.drop("_rows", "_cols").join(cut_right.drop("_rows", "_cols"), grid).drop("_row", "_col")


def interval_join(left: DataFrame, events: DataFrame, key: str, left_ts: str, event_ts: str, lo_hours: float,
                  hi_hours: float, slice_hours: int = 24, bound: int = GROUP_ROWS) -> DataFrame:
    """Pairs with equal key and event time in [t + lo, t + hi].

    Each left row is copied to the few time slices its interval touches, which makes (key, slice) an equi-join. Events are counted
    per key and slice first; a slice with more than ``bound`` of them is halved until its parts would hold no more, down to a
    second. What even seconds leave together is cut into chunks.
    """
    span = lambda h: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(h * 3600)))
    seconds = slice_hours * 3600
    start, stop = F.col(left_ts) + span(lo_hours), F.col(left_ts) + span(hi_hours)
    wide = left.withColumn("_lo", start).withColumn("_hi", stop).withColumn(
        "_slice", F.explode(F.sequence(_slice_of(F.col("_lo"), seconds), _slice_of(F.col("_hi"), seconds)))
    )
    sliced = events.withColumn("_slice", _slice_of(F.col(event_ts), seconds))
    keys = [key, "_slice"]
    halvings = F.least(F.ceil(F.log2(F.col("_n") / bound)), F.lit(math.floor(math.log2(seconds)))).cast("int")
    dense = sliced.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > bound).select(*keys, halvings.alias("_deep"))
    dense = durable(dense)
    if not dense.isEmpty():
        parts = F.pow(F.lit(2.0), F.coalesce("_deep", F.lit(0)))
        # Seconds from the slice's start, held inside the slice.
        within = lambda ts: F.greatest(F.lit(0), F.least(F.lit(seconds - 1), F.unix_seconds(ts.cast("timestamp")) - F.col("_slice") * seconds))
        part = lambda ts: F.floor(within(ts) * parts / seconds).cast("bigint")
        wide = wide.join(dense, keys, "left").withColumn("_part", F.explode(F.sequence(part(F.col("_lo")), part(F.col("_hi"))))).drop("_deep")
        sliced = sliced.join(dense, keys, "left").withColumn("_part", part(F.col(event_ts))).drop("_deep")
        keys.append("_part")
    joined = bounded_join(wide, sliced, keys, bound)
    return joined.where((F.col(event_ts) >= F.col("_lo")) & (F.col(event_ts) <= F.col("_hi"))).drop(*keys[1:], "_lo", "_hi")


def exists_within(grid: DataFrame, events: DataFrame, key: str, grid_ts: str, event_ts: str,
                  horizons: Sequence[int]) -> DataFrame:
    """Add y_<h> = 1 if an event of the key lies strictly after t and before t + h hours.

    The next event settles every horizon at once, so nothing is copied per horizon.
    """
    nexted = asof_forward(grid, events, [key], grid_ts, event_ts, "_next", strict=True)
    gap = fx.hours_between(F.col(grid_ts), F.col("_next"))
    flags = [F.coalesce((gap < h).cast("int"), F.lit(0)).alias(f"y_{h}") for h in horizons]
    return nexted.select(*grid.columns, *flags)


def _lat_band(lat: Column, km: float) -> Column:
    height = math.degrees(km / fx.EARTH_RADIUS_KM)
    return F.floor(lat / height).cast("bigint")


def _lon_cells(band: Column, km: float) -> Column:
    """How many longitude cells a band has, so that a cell is never narrower than the radius.

    The width is taken at the edge furthest from the equator among the band and its neighbours.
    """
    height = math.degrees(km / fx.EARTH_RADIUS_KM)
    furthest = F.least((F.greatest(F.abs(band - 1), F.abs(band + 2))) * height, F.lit(90.0))
    reach = F.lit(math.sin(km / fx.EARTH_RADIUS_KM)) / F.greatest(F.cos(F.radians(furthest)), F.lit(1e-12))
    width = F.when(reach >= 1, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(reach, F.lit(1.0)))))
    return F.greatest(F.floor(360.0 / width), F.lit(1)).cast("bigint")


def _lon_cell(lon: Column, cells: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / 360.0 * cells).cast("bigint"), cells)


def _cells_around(points: DataFrame, km: float, lat: str, lon: str) -> DataFrame:
    """Every point with the up to nine cells that touch its own."""
    around = points.withColumn("_b", _lat_band(F.col(lat), km)).withColumn("_band", F.explode(F.sequence(F.col("_b") - 1, F.col("_b") + 1)))
    around = around.withColumn("_n", _lon_cells(F.col("_band"), km)).withColumn("_c", _lon_cell(F.col(lon), F.col("_n")))
    ring = F.array_distinct(
        F.array(F.pmod(F.col("_c") - 1, F.col("_n")), F.col("_c"), F.pmod(F.col("_c") + 1, F.col("_n")))
    )
    return around.withColumn("_cell", F.explode(ring)).drop("_b", "_n", "_c")


def _in_cells(points: DataFrame, km: float, lat: str, lon: str) -> DataFrame:
    """Every point with its own cell."""
    return points.withColumn("_band", _lat_band(F.col(lat), km)).withColumn("_cell", _lon_cell(F.col(lon), _lon_cells(F.col("_band"), km)))


def near(points: DataFrame, centres: DataFrame, km: float, point_lat: str, point_lon: str, centre_lat: str,
         centre_lon: str, distance: str = "distance_km", bound: int = GROUP_ROWS) -> DataFrame:
    """Pairs of points and centres at most ``km`` apart.

    The earth is cut into latitude bands and, per band, longitude cells at least ``km`` wide. A centre sits in one
    cell; a point is copied to the up to nine cells around it; the exact distance decides. Cells wrap at the date line. A dense cell
    is met in chunks of ``bound`` rows.
    """
    placed = _in_cells(centres, km, centre_lat, centre_lon)
    around = _cells_around(points, km, point_lat, point_lon)
    gap = fx.haversine_km(F.col(point_lat), F.col(point_lon), F.col(centre_lat), F.col(centre_lon))
    pairs = bounded_join(around, placed, ["_band", "_cell"], bound).withColumn(distance, gap)
    return pairs.where(F.col(distance) <= km).drop("_band", "_cell")


#: Points in and beside a cell that one row holds.
AROUND_ROWS = 200_000
#: Centres of a cell that share one such row.
SHARE_ROWS = 1_000
#: Rows that one task gathers into arrays, about: a task holds up to 128 arrays at once, however long.
GATHERED_ROWS = 250_000


def dealt(df: DataFrame, rows: int, keys: Sequence[str], gathered: int = GATHERED_ROWS) -> DataFrame:
    """The frame of so many rows moved by its keys to enough tasks that each gets about ``gathered`` rows."""
    return df.repartition(max(shuffle_width(df.sparkSession), math.ceil(rows / gathered)), *keys)


def crowded(centres: DataFrame, points: DataFrame, km: float, centre_lat: str, centre_lon: str, point_lat: str, point_lon: str,
            bound: int = AROUND_ROWS) -> DataFrame:
    """The centres with more than ``bound`` points in their cell and those around it."""
    cell = ["_band", "_cell"]
    full = _cells_around(points.select(point_lat, point_lon), km, point_lat, point_lon).groupBy(*cell).agg(F.count("*").alias("_n"))
    return _in_cells(centres, km, centre_lat, centre_lon).join(full.where(F.col("_n") > bound), cell, "left_semi").drop(*cell)


def lists_near(centres: DataFrame, points: DataFrame, km: float, centre_lat: str, centre_lon: str, point_lat: str, point_lon: str,
               entry: Column, out: str, share: int = SHARE_ROWS, gathered: int = GATHERED_ROWS) -> DataFrame:
    """Every centre with the sorted array of the entries of all points at most ``km`` away, null where no point is around.

    For centres that are not ``crowded``. The points travel once, in up to nine copies, and lie as one sorted array per cell; a cell with more than
    ``share`` centres has several. A centre picks its own from the array of its cell, so pairs are neither moved nor sorted. The copies are counted
    first and dealt to as many tasks as keep the arrays of one task small.
    """
    placed, cell = _in_cells(centres, km, centre_lat, centre_lon), ["_band", "_cell"]
    # At most one row for ``share`` centres.
    split = F.broadcast(durable(placed.groupBy(*cell).agg(F.ceil(F.count("*") / share).cast("bigint").alias("_shares")).where(F.col("_shares") > 1)))
    shares = F.coalesce("_shares", F.lit(1).cast("bigint"))
    placed = placed.join(split, cell, "left").withColumn("_share", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in centres.columns]), shares)).drop("_shares")
    point = F.struct(entry.alias("_entry"), F.col(point_lat).alias("_lat"), F.col(point_lon).alias("_lon"))
    copied = lambda df: _cells_around(df, km, point_lat, point_lon).join(split, cell, "left").select(
        *cell, F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1)).alias("_share"), "_point"
    )
    points = points.select(point.alias("_point"), point_lat, point_lon)
    copies = copied(points).count()
    # As read, the points lie in few tasks, and each would hold all its copies.
    copies_dealt = dealt(copied(dealt(points, copies, ["_point"], gathered)), copies, [*cell, "_share"], gathered)
    around = copies_dealt.groupBy(*cell, "_share").agg(F.sort_array(F.collect_list("_point")).alias("_points"))
    lat, lon, height = F.col(centre_lat), F.col(centre_lon), math.degrees(km / fx.EARTH_RADIUS_KM) * (1 + 1e-9)
    # The difference of the latitudes is the cheaper test and comes first.
    hit = lambda p: (F.abs(p["_lat"] - lat) <= height) & (fx.haversine_km(lat, lon, p["_lat"], p["_lon"]) <= km)
    found = F.transform(F.filter("_points", hit), lambda p: p["_entry"])
    return placed.join(around, [*cell, "_share"], "left").select(*centres.columns, found.alias(out))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Dimension lookup; keys without an entry get the mean of the table (0 if it is empty)."""
    fallback = F.coalesce(table.agg(F.avg(value)).scalar(), F.lit(0.0))
    entries = table.select(key, F.col(value).alias("_v"))
    return df.join(entries, key, "left").withColumn(out, F.coalesce("_v", fallback)).drop("_v")


def link_atm_accounts_complaints(withdrawals: DataFrame, complaints: DataFrame) -> DataFrame:
    """(machine, victim state, n): complaints naming an account that withdrew at the machine.

    Both sides are counted per account first: the join sees distinct (account, machine) and (account, state).
    """
    seen = withdrawals.select("account_token", "atm_id").distinct()
    named = complaints.where(F.col("linked_account_token").isNotNull()).groupBy(
        F.col("linked_account_token").alias("account_token"), "victim_state"
    ).agg(F.count("*").alias("n"))
    return seen.join(named, "account_token").groupBy("atm_id", "victim_state").agg(F.sum("n").alias("n"))


def amount_cluster(df: DataFrame, keys: Sequence[str], amount: str, tolerance: float = 0.10,
                   out: str = "amount_cluster") -> DataFrame:
    """Add how many rows of the group lie within a row's own tolerance of its amount (itself included).

    Counting by position instead of by pair: per distinct amount two probes are placed on the value axis, and
    the number of rows between them is the difference of two running counts.
    """
    cents = F.round(F.col(amount) * 100).cast("bigint")
    values = df.withColumn("_c", cents).groupBy(*keys, "_c").agg(F.count("*").alias("_n"))
    reach = F.floor(F.greatest(F.abs(F.col("_c")), F.lit(100)) * tolerance + 1e-9).cast("bigint")
    point = lambda value, kind, n: F.struct(
        value.alias("_v"), F.lit(kind).alias("_kind"), n.cast("bigint").alias("_w")
    )
    axis = values.select(
        *keys, "_c",
        F.inline(
            F.array(
                point(F.col("_c") - reach, 0, F.lit(0)), point(F.col("_c"), 1, F.col("_n")),
                point(F.col("_c") + reach, 2, F.lit(0)),
            )
        ),
    )
    counted = running_totals(axis, keys, [F.col("_v"), F.col("_kind"), F.col("_c")], {"_upto": "_w"})
    size = F.max(F.when(F.col("_kind") == 2, F.col("_upto"))) - F.max(F.when(F.col("_kind") == 0, F.col("_upto")))
    sizes = counted.groupBy(*keys, "_c").agg(size.alias(out))
    return df.withColumn("_c", cents).join(sizes, [*keys, "_c"]).drop("_c")


#: A cell with more places is split; the smallest cell is 2 ** -DEEPEST of the radius.
LEAF_PLACES, DEEPEST = 1024, 12


def _fine(level: int, lat: Column, lon: Column, km: float) -> tuple[Column, Column]:
    """Row and column of the quarter cells of a level; two to a row and column of the level above."""
    rows = F.floor(lat / (math.degrees(km / fx.EARTH_RADIUS_KM) / 2**level)).cast("bigint")
    cells = _lon_cells(_lat_band(lat, km), km) * 2**level
    return rows, _lon_cell(lon, cells)


def _reach(level: int, km: float, lat: Column, lon: Column) -> tuple[Column, Column]:
    """No more than the least and no less than the greatest distance from a point to the cell (_band, _y, _x) of a level."""
    height = math.degrees(km / fx.EARTH_RADIUS_KM) / 2**level
    width = 360.0 / (_lon_cells(F.col("_band"), km) * 2**level)
    south, west = F.col("_y") * height, F.col("_x") * width - 180.0
    north, east = south + height, west + width
    corners = [fx.haversine_km(lat, lon, y, x) for y in (south, north) for x in (west, east)]
    farthest = F.when(width < 90, F.greatest(*corners)).otherwise(F.lit(float("inf")))
    by_lat = F.radians(F.greatest(south - lat, lat - north, F.lit(0.0)))
    turn = lambda a, b: F.least(F.abs(a - b), 360.0 - F.abs(a - b))
    aside = F.when((lon >= west) & (lon <= east), 0.0).otherwise(F.least(turn(lon, west), turn(lon, east)))
    by_lon = F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(F.least(aside, F.lit(90.0)))))
    return fx.EARTH_RADIUS_KM * F.greatest(by_lat, by_lon), farthest


def proximity_counts(atms: DataFrame, complaints: DataFrame, km: float = 2.0, leaf: int = LEAF_PLACES) -> DataFrame:
    """(machine, day, n): complaints within ``km`` filed on the day or the day before; other days have no row.

    Complaints are counted per place and day first. Round by round, the cells around each machine are told apart: one that lies
    beyond the radius is left, one wholly inside it gives its totals, one with at most ``leaf`` places is measured place by place, and any other is
    split into four. So a dense cell is paired with a machine only along the edge of the circle.
    """
    places = complaints.where(F.col("victim_lat").isNotNull() & F.col("victim_lon").isNotNull()).groupBy(
        "victim_lat", "victim_lon", F.to_date("filing_timestamp").alias("filed")
    ).agg(F.count("*").alias("n"))
    lat, lon = F.col("victim_lat"), F.col("victim_lon")
    places = durable(places.withColumn("_band", _lat_band(lat, km)).withColumn("_cell", _lon_cell(lon, _lon_cells(F.col("_band"), km))))
    machines = atms.select("atm_id", "latitude", "longitude").where("latitude IS NOT NULL AND longitude IS NOT NULL")
    asked = _cells_around(machines, km, "latitude", "longitude").withColumnsRenamed({"_cell": "_x"}).withColumn("_y", F.col("_band"))
    cell, found = ["_band", "_y", "_x"], []
    for level in range(DEEPEST + 1):
        y, x = _fine(level, lat, lon, km)
        here = places.withColumn("_y", y).withColumn("_x", x)
        if level:
            # Only what lies in cells that are still asked for.
            here = here.join(asked.select(*cell).distinct(), cell, "left_semi")
        sizes = here.groupBy(*cell).agg(F.count("*").alias("_places"))
        least, most = _reach(level, km, F.col("latitude"), F.col("longitude"))
        judged = asked.join(sizes, cell).withColumn("_least", least).withColumn("_most", most).where(F.col("_least") <= km * (1 + 1e-9))
        inside = F.col("_most") <= km * (1 - 1e-9)
        small = (F.col("_places") <= leaf) | F.lit(level == DEEPEST)
        judged = durable(judged.withColumn("_do", F.when(inside, "whole").when(small, "each").otherwise("split")).select("atm_id", "latitude", "longitude", *cell, "_do"))
        totals = here.groupBy(*cell, "filed").agg(F.sum("n").alias("n"))
        found.append(judged.where("_do = 'whole'").join(totals, cell).select("atm_id", "filed", "n"))
        gap = fx.haversine_km(F.col("latitude"), F.col("longitude"), lat, lon)
        each = bounded_join(judged.where("_do = 'each'").drop("_do"), here.drop("_cell"), cell)
        found.append(each.where(gap <= km).select("atm_id", "filed", "n"))
        rest = judged.where("_do = 'split'")
        if rest.isEmpty():
            break
        quarters = F.array(*[F.struct((2 * F.col("_y") + i).alias("_y"), (2 * F.col("_x") + j).alias("_x")) for i in (0, 1) for j in (0, 1)])
        asked = rest.select("atm_id", "latitude", "longitude", "_band", F.inline(quarters))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.select("atm_id", "n", F.explode(F.sequence(F.col("filed"), F.date_add("filed", 1))).alias("day")).groupBy(
        "atm_id", "day"
    ).agg(F.sum("n").alias("complaints_nearby"))

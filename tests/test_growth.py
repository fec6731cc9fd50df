"""Steps whose work once grew with the square of the rows that share a time, a place or a key: their results, and that the plan holds no such step."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from shoalwater.functions import exprs
from shoalwater.operators import events, gates, reports, scan, spatial

HOUR = scan.HOUR_US
SLIDING = re.compile(r"RangeFrame, (?!unboundedpreceding)")


def plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def series(spark, seed, n=600):
    """Uneven samples of two stations with equal times, gaps and nulls."""
    rng = np.random.default_rng(seed)
    us = np.cumsum(rng.integers(0, 3, n)) * HOUR // 2 + np.cumsum(rng.random(n) < 0.02) * 50 * HOUR
    rows = [(i, "ab"[int(rng.integers(0, 2))], int(t), None if rng.random() < 0.2 else float(rng.integers(8, 20)), None if rng.random() < 0.1 else float(rng.integers(0, 360))) for i, t in enumerate(us)]
    return spark.createDataFrame(rows, "event_id long, station string, us long, temp_c double, dir_deg double").repartition(3).withColumn("speed_kn", F.col("temp_c"))


def by_id(df, columns):
    return sorted(df.select(*columns).collect(), key=lambda r: r["event_id"])


@pytest.mark.parametrize("dense", [False, True])
def test_nearest_in_time_meets_two_rows(spark, dense):
    tolerance = 500 * HOUR if dense else 2 * HOUR
    left, right = series(spark, 1, 150).select("event_id", "station", "us"), series(spark, 2, 250).select("station", "us", "temp_c", F.col("event_id").alias("rid"))
    got = events.nearest_in_time(left, right, ["station"], ["rid", "temp_c"], tolerance, "rid")
    assert "Join" not in plan(got)
    there, want = right.collect(), {}
    for r in left.collect():
        near = [(abs(r["us"] - o["us"]), o["us"], o["rid"], o["temp_c"]) for o in there if o["station"] == r["station"] and abs(r["us"] - o["us"]) <= tolerance]
        if near:
            gap, _, rid, temp = min(near, key=lambda x: x[:3])
            want[r["event_id"]] = (gap, rid, temp)
    assert {r["event_id"]: (r["gap_us"], r["rid"], r["temp_c"]) for r in got.collect()} == want and len(want) > 50


@pytest.mark.parametrize("back, ahead", [(24, 0), (0, 30), (6, 6), (3, 11)])
def test_framed_equals_whole_frames(spark, back, ahead):
    rows = series(spark, back)
    w = W.partitionBy("station").orderBy("us").rangeBetween(-back * HOUR, ahead * HOUR)
    v = F.col("temp_c")
    kinds = {"s": ("sum", v), "n": ("count", v), "lo": ("min", v), "hi": ("max", v)}
    got = scan.framed(rows, ["station"], {**kinds, "f": ("first", F.col("dir_deg"))}, back * HOUR, ahead * HOUR, tie=("event_id",))
    first = F.min_by(F.struct("dir_deg"), F.struct("us", "event_id")).over(w)["dir_deg"]
    want = rows.withColumns({**{n: getattr(F, k)(c).over(w) for n, (k, c) in kinds.items()}, "f": first})
    assert by_id(got, want.columns) == by_id(want, want.columns)
    assert not SLIDING.search(plan(got))


def test_wind_run_has_no_sliding_frame(spark):
    got = events.wind_run(series(spark, 5))
    assert not SLIDING.search(plan(got))
    assert got.count() > 400


def test_drops_have_no_sliding_frame(spark):
    rows = series(spark, 6)
    w = W.partitionBy("station").orderBy("us").rangeBetween(-scan.DAY_US, 0)
    want = rows.withColumn("drop_c", F.max("temp_c").over(w) - F.col("temp_c"))
    got = events.dropped(rows, scan.DAY_US)
    assert by_id(got, want.columns) == by_id(want, want.columns)
    for df in (got, events.onsets(rows, 4.0, 2.0), events.drop_events(rows)):
        assert not SLIDING.search(plan(df))


def test_smoothed_direction_has_no_sliding_frame(spark):
    rows = series(spark, 7)
    w, r = W.partitionBy("station").orderBy("us").rangeBetween(-6 * HOUR, 6 * HOUR), F.radians("dir_deg")
    want = {r["event_id"]: r["d"] for r in rows.withColumn("d", F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)).over(w), F.avg(F.cos(r)).over(w))), F.lit(360.0))).collect()}
    got = reports.smoothed_direction(rows)
    assert not SLIDING.search(plan(got))
    assert {r["event_id"]: r["dir"] for r in got.collect()} == pytest.approx(want)


def test_setup_response_has_no_sliding_frame(spark):
    got = events.setup_response(series(spark, 8), share=0.1)
    assert not SLIDING.search(plan(got))
    assert got.count() > 5


def test_nearest_point_compares_places_not_rows(spark):
    place = lambda name, m, extra: spark.range(400).select(F.col("id").alias(name), (F.lit(48.0) + F.col("id") % m / 50).alias("lat"), (F.lit(-90.0) + F.col("id") % (m + 1) / 40).alias("lon"), *extra)
    points, nodes = place("point", 7, []), place("node", 5, [(F.col("id") % 3).cast("double").alias("depth")])
    got = spatial.nearest_point(points, nodes, 3.0, least_depth=1.0)
    assert "Deduplicate [lat" in plan(got) and "Aggregate [lat" in plan(got)
    km = exprs.haversine_km("lat", "lon", "nlat", "nlon")
    pairs = points.crossJoin(nodes.where("depth >= 1").select("node", F.col("lat").alias("nlat"), F.col("lon").alias("nlon"))).withColumn("km", km).where("km <= 3")
    want = {r["point"]: tuple(r["m"]) for r in pairs.groupBy("point").agg(F.min(F.struct("km", "node")).alias("m")).collect()}
    assert {r["point"]: (r["km"], r["node"]) for r in got.collect()} == {p: want.get(p, (None, None)) for p in range(400)} and 0 < len(want) < 400


def test_bearing_sends_no_grid_to_the_driver(spark):
    pixels = spark.range(30 * 20).select(F.floor(F.col("id") / 20).alias("row"), (F.col("id") % 20).alias("col"), F.when(F.col("id") % 7 != 0, (F.col("id") * 37 % 101).cast("double")).alias("depth"))
    spots = spark.range(60).select(F.col("id").alias("spot"), (F.col("id") * 7 % 30).alias("row"), (F.col("id") * 3 % 20).alias("col"), F.lit(None).cast("long").alias("hint"))
    got = spatial.offshore_bearing(pixels, spots, 3)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    v = {(r["row"], r["col"]): r["depth"] for r in pixels.where("depth IS NOT NULL").collect()}
    for s in got.join(spots, "spot").collect():
        box = {k: x for k, x in v.items() if abs(k[0] - s["row"]) <= 3 and abs(k[1] - s["col"]) <= 3}
        east = sum(x - box[r, c - 1] for (r, c), x in box.items() if (r, c - 1) in box)
        north = -sum(x - box[r - 1, c] for (r, c), x in box.items() if (r - 1, c) in box)
        want = math.degrees(math.atan2(east, north)) % 360 if abs(east) > 1e-9 or abs(north) > 1e-9 else None
        assert s["bearing"] == (None if want is None else pytest.approx(want))


def test_gap_fill_runs_over_pieces(spark):
    rng = np.random.default_rng(3)
    rows = [("rs"[i % 2], i // 2, 99_000 + 20 * (i // 2), float(i % 11) if rng.random() < 0.4 else None) for i in range(400)]
    got = spatial.gap_fill(spark.createDataFrame(rows, "river string, idx int, dist_m int, v double").repartition(3), "v", 80)
    assert "unboundedfollowing" not in plan(got)
    want = {}
    for river in "rs":
        known = [(d, v) for r, _, d, v in rows if r == river and v is not None]
        for _, i, d, v in (r for r in rows if r[0] == river):
            a, z = max((k for k in known if k[0] <= d), default=None), min((k for k in known if k[0] >= d), default=None)
            want[river, i] = v if v is not None else a[1] + (d - a[0]) / (z[0] - a[0]) * (z[1] - a[1]) if a and z and z[0] - a[0] <= 80 else None
    assert {(r["river"], r["idx"]): r["filled"] for r in got.collect()} == pytest.approx(want)


def test_j05_model_takes_all_rows(spark):
    from shoalwater.plans import registry

    data = "/root/testdata/sf0.001"
    g = spark.read.parquet(f"{data}/lineitem.parquet").withColumn("f", F.col("l_quantity") + (F.col("l_discount") - 0.05) * 100)
    days = g.groupBy(F.col("l_suppkey").alias("site"), F.unix_date(F.col("l_shipdate").cast("date")).alias("day")).agg(F.avg("f").alias("m"), F.count_if(F.col("l_partkey") % 3 == 0).alias("t")).where("t > 0")
    want = {(r["site"], r["day"]): r["m"] for r in days.collect()}
    assert {(r["site"], r["day"]): r["model"] for r in registry.QUERIES["J-05"](spark, data).collect()} == pytest.approx(want, abs=1e-5)


def test_settings_share_one_search_for_runs(spark, monkeypatch):
    calls, found = [], events.onsets
    monkeypatch.setattr(events, "onsets", lambda *a, **k: calls.append(a) or found(*a, **k))
    rows = series(spark, 9)
    got = {(r["station"], r["persist_h"]): r["n"] for r in gates.episode_counts(rows, 4.0, [1.0, 4.0]).collect()}
    assert len(calls) == 1
    for h in (1.0, 4.0):
        want = {r["station"]: r["count"] for r in gates.onset_episodes(rows, 4.0, h).groupBy("station").count().collect()}
        assert {s: n for (s, p), n in got.items() if p == h} == {s: want.get(s, 0) for s in "ab"}


def test_lit_minutes_are_sought_once_a_place(spark):
    places = spark.range(300).select(F.col("id").alias("point"), (F.lit(48.0) + F.col("id") % 3).alias("lat"), F.lit(-89.0).alias("lon"), F.lit(172).alias("doy"))
    got = reports.light_windows(places)
    assert "Deduplicate [lat" in plan(got)
    assert got.count() == 300 and got.select("rise", "sets").distinct().count() <= 3


def test_every_minute_of_the_day_is_looked_at(spark):
    where = [(48.0, -89.0), (48.537, -89.421), (-33.3, 151.2), (0.0, 0.0), (80.0, 20.0)]  # the last has days without light and without dark
    places = spark.createDataFrame([(3 * i + k, *where[i], d) for i in range(len(where)) for k in range(3) for d in (15, 105, 172, 265, 355, 366)], "point long, lat double, lon double, doy int")
    want = {}
    for i, (lat, lon) in enumerate(where):
        for d in (15, 105, 172, 265, 355, 366):
            la, decl = math.radians(lat), math.radians(-23.44 * math.cos(2 * math.pi / 365 * (d + 10)))
            up = [m for m in range(1440) if math.degrees(math.asin(math.sin(la) * math.sin(decl) + math.cos(la) * math.cos(decl) * math.cos(math.radians((m - lon * 4) / 4 - 180 + lon)))) >= -0.833]
            want |= {(3 * i + k, d): (up[0], up[-1]) for k in range(3) if up}
    assert {(r["point"], r["doy"]): (r["rise"], r["sets"]) for r in reports.light_windows(places).collect()} == want
    assert (0, 1439) in want.values() and (12, 355) not in want
    assert {m % 5 for v in want.values() for m in v} == set(range(5))


def test_isotherms_meet_depths_not_pixels(spark):
    rng = np.random.default_rng(4)
    columns = spark.createDataFrame([(i % 2, i // 2, [1.0, 5.0, 10.0, 20.0], sorted((float(x) for x in rng.uniform(2, 18, 4)), reverse=True)) for i in range(60)], "spot long, lead long, depths array<double>, temps array<double>")
    pixels = [(int(rng.integers(0, 2)), float(rng.integers(1, 30)), float(rng.integers(0, 90))) for _ in range(300)]
    got = gates.trajectory(columns, spark.createDataFrame(pixels, "spot long, depth double, dist double"), 10.0, 1.5, (3.31, 1.51, 5.55), 60, 22, 10.0).collect()
    assert len(got) == 60 and 0 < sum(r["reach"] for r in got) < 60
    for r in got:
        near = [(d, m) for s, d, m in pixels if s == r["spot"] and m <= 60 and d <= 22]
        hit = [m for d, m in near if r["iso"] is not None and d >= r["iso"]]
        deep, shallow = (any(r[b] is not None and d >= r[b] for d, _ in near) for b in ("deep", "shallow"))
        assert (r["reach"], r["nearest"], r["area"], r["certain"], r["possible"]) == (bool(hit), min(hit, default=None), len(hit) * 100.0, deep, shallow)
    rows = spark.createDataFrame([(0, 1.0, 5.0)], "spot long, depth double, dist double")
    assert "count_if" not in plan(gates.trajectory(columns, rows, 10.0, 1.5, (3.31, 1.51, 5.55), 60, 22, 10.0))


def test_median_of_a_class_is_not_one_buffer(spark):
    from shoalwater.plans import registry

    assert "median(" not in plan(registry.QUERIES["AGG-22"](spark, "/root/testdata/sf0.001"))


def test_only_k_nodes_of_a_place_are_compared(spark):
    grid = spark.range(12).select(F.col("id").alias("row"), F.lit(0).alias("col"), F.lit(0).alias("x"), F.col("id").alias("y"))
    nodes = spark.range(300).select(F.col("id").alias("node"), (F.col("id") % 2).alias("x"), (F.col("id") % 3 * 2).alias("y"), F.when(F.col("id") % 5 != 0, F.col("id").cast("double")).alias("v"))
    got = spatial.scattered(grid, nodes, 3, 4)
    assert "windowspecdefinition(x#" in plan(got)
    known = [tuple(r) for r in nodes.collect()]
    for r in got.collect():
        near = sorted((x * x + (y - r["row"]) ** 2, n, v) for n, x, y, v in known if x * x + (y - r["row"]) ** 2 <= 9)[:4]
        some = [(1 / (d + 1e-6), v) for d, _, v in near if v is not None]
        want = None if not near else 999.0 if len(near) - len(some) > len(near) / 2 else sum(w * v for w, v in some) / sum(w for w, _ in some)
        assert r["v"] == (None if want is None else pytest.approx(want))


def test_bends_copy_a_station_to_few_cells(spark):
    import inspect

    assert inspect.signature(spatial.bend_radius).parameters["cell"].default >= 400
    s = spark.range(120).select(F.lit("r").alias("river"), F.col("id").alias("idx"), (F.col("id") * 10.0).alias("x"), (F.sin(F.col("id") / 9) * 60).alias("y"), F.lit(30.0).alias("width"))
    radius = lambda c: {r["idx"]: r["radius"] for r in spatial.bend_radius(s, "x", "y", cell=c).collect()}
    assert radius(400.0) == pytest.approx(radius(50.0)) and len(radius(400.0)) > 100


def test_river_is_numbered_in_pieces(spark):
    from shoalwater.plans import bindings

    assert "row_number" not in plan(bindings.river(spark, "/root/testdata/sf0.001"))

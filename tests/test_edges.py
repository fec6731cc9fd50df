"""Hand-made edge rows: boundaries, wraps, ties, nulls, gaps, empty input."""

import pytest
from pyspark.sql import functions as F

from shoalwater.functions import exprs
from shoalwater.operators import events, ledger, profiles, spatial, verify
from shoalwater.plans.bindings import HOUR_US
from shoalwater.sources import landed
from shoalwater.streaming import jobs


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("d,want", [(225.0, True), (315.0, True), (224.9, False), (585.0, True), (None, False)])
def test_sector(spark, d, want):
    assert one(spark, exprs.in_sector(F.lit(d).cast("double"))) is want


def test_sector_wraps(spark):
    assert one(spark, exprs.in_sector(F.lit(350.0), (340, 20))) and one(spark, exprs.in_sector(F.lit(20.0), (340, 20))) and not one(spark, exprs.in_sector(F.lit(21.0), (340, 20)))


def test_component_of_variable_wind(spark):
    null = F.lit(None).cast("double")
    assert one(spark, exprs.favourable_component(F.lit(0.0), null)) == 0.0
    assert one(spark, exprs.favourable_component(F.lit(5.0), null)) is None
    assert one(spark, exprs.favourable_component(F.lit(float("nan")), F.lit(270.0))) is None


def test_splits_must_not_overlap():
    with pytest.raises(ValueError):
        exprs.split_label("day", (1, 5), (5, 9))


def test_mixed_layer_must_be_positive(spark):
    with pytest.raises(Exception, match="positive"):
        one(spark, exprs.wedderburn(F.lit(3.0), F.lit(0.0)))


def wind(spark, rows):
    return spark.createDataFrame([(i, "s", int(h * HOUR_US), v, d) for i, (h, v, d) in enumerate(rows)], "event_id long, station string, us long, speed_kn double, dir_deg double")


def test_wind_run_counts_calm_and_skips_variable(spark):
    got = {r["event_id"]: r["drive"] for r in events.wind_run(wind(spark, [(0, 10.0, 270.0), (1, 0.0, None), (2, 30.0, None), (3, 10.0, 270.0), (30, 10.0, 270.0)])).collect()}
    assert got == {0: 0.0, 1: 5.0, 3: 15.0, 4: 0.0}
    assert events.wind_run(wind(spark, [(0, 10.0, 270.0)])).count() == 0


def test_wind_run_over_bucket_edges(spark):
    rows = [(h, 10.0, 270.0) for h in range(0, 24 * 20)]
    got = [r["drive"] for r in events.wind_run(wind(spark, rows)).orderBy("us").collect()]
    assert got[:25] == [10.0 * h for h in range(25)] and set(got[25:]) == {240.0}


def test_runs_keep_short_lulls_and_break_at_gaps(spark):
    blow = [(h, 15.0, 270.0) for h in range(8)]
    lull = blow + [(8, 2.0, 90.0), (9, 2.0, 90.0)] + [(h, 15.0, 270.0) for h in range(10, 13)]
    long_ = blow + [(8, 2.0, 90.0), (9, 2.0, 90.0), (10, 2.0, 90.0)] + [(h, 15.0, 270.0) for h in range(11, 19)]
    gap = blow + [(h, 15.0, 270.0) for h in range(9, 17)]  # a step of exactly twice the spacing stays
    wide = blow + [(h, 15.0, 270.0) for h in range(10, 18)]
    count = lambda rows: events.runs(wind(spark, rows), 13.0).count()
    assert [count(x) for x in (lull, long_, gap, wide)] == [1, 2, 1, 2]
    run = events.runs(wind(spark, lull), 13.0).first()
    assert run["duration_h"] == 12.0 and run["n"] == 11


def test_asof_is_inclusive_and_never_looks_ahead(spark):
    left = spark.createDataFrame([("s", 5), ("s", 10), ("s", 1)], "station string, us long")
    right = spark.createDataFrame([("s", 5, 1.0), ("s", 9, 2.0)], "station string, us long, v double")
    got = lambda r: sorted((x["us"], x["v"]) for x in events.asof_join(left, r, ["station"], ["v"]).collect())
    want = [(1, None), (5, 1.0), (10, 2.0)]
    assert sorted(got(right), key=str) == sorted(want, key=str)
    later = right.union(spark.createDataFrame([("s", 11, 3.0)], right.schema))
    assert sorted(got(later.repartition(5)), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("temps,status,depth", [([5.0, 4.0], "above_top", 1.0), ([15.0, 14.0], "below_bottom", None), ([12.0, 8.0], "crossing", 1.5), ([10.0, 8.0], "crossing", 1.0)])
def test_crossing_says_what_it_is(spark, temps, status, depth):
    row = one(spark, profiles.crossing(F.array(F.lit(1.0), F.lit(2.0)), F.array(*[F.lit(t) for t in temps]), 10.0))
    assert row["status"] == status and row["depth"] == depth


def test_interpolation_clamps_with_a_flag(spark):
    z, t = F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(10.0), F.lit(6.0))
    assert one(spark, profiles.at_depth(z, t, F.lit(2.0))).asDict() == {"temp": 8.0, "clamped": False}
    assert one(spark, profiles.at_depth(z, t, F.lit(100.0))).asDict() == {"temp": 6.0, "clamped": True}
    with pytest.raises(Exception, match="positive"):
        one(spark, profiles.layer_depths(F.array(F.lit(0.1)), F.lit(10.0), F.lit(0.0)))


def test_thin_evidence_gives_null(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0)], "k string, x double, y double")
    assert verify.spearman(rows, "k", "x", "y").first()["rho"] is None
    assert verify.pooled_bias(rows, "k", "x").first()["source"] == "prior"
    assert verify.logistic_fit(rows.withColumn("l", F.col("x") > 0), "x", "l") is None


def test_ranks_share_ties(spark):
    rows = spark.createDataFrame([("a", v) for v in (3.0, 1.0, 3.0, 2.0)], "k string, v double")
    assert sorted((r["v"], float(r["rank"])) for r in verify.average_rank(rows, "v", ["k"]).collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


def test_sign_test_is_exact(spark):
    rows = spark.createDataFrame([(d, 1.0, 2.0) for d in range(9)] + [(9, 2.0, 1.0)], "day int, f double, b double")
    got = verify.sign_test_days(rows.withColumn("k", F.lit(1)), ["k"]).first()
    assert got["wins"] == 9 and got["losses"] == 1 and abs(got["p"] - 22 / 1024) < 1e-9


def test_normal_tail(spark):
    df = spark.createDataFrame([(0.0,), (1.959964,), (None,)], "z double")
    got = [r["p"] for r in df.select(verify.normal_tail().alias("p")).collect()]
    assert got[0] == 1.0 and abs(got[1] - 0.05) < 1e-6


def test_violations_route_rows(spark):
    rows = spark.createDataFrame([("catch", "coho", "day", "http://x", 0.5, "q", None), ("x", "coho", "day", "ftp", 2.0, "", "nowhere")], "kind string, species string, precision string, source string, confidence double, quote string, place_id string")
    got = [r["v"] for r in rows.select(ledger.violations(["catch"], ["coho"], ["day"], ["kam"]).alias("v")).collect()]
    assert got[0] == [] and len(got[1]) == 5


def test_small_components_go(spark):
    pixels = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (5, 5), (2, 1), (2, 0)], "row long, col long")
    assert {(r["row"], r["n"]) for r in spatial.without_small(pixels, 2).collect()} == {(0, 5), (1, 5), (2, 5)}


def test_buoy_text_and_csv(spark, tmp_path):
    (tmp_path / "a.txt").write_text("#YY MM DD hh mm DEPTH OTMP\n#yr mo dy hr mn m degC\n\n2024 07 01 00 00 1.0 12.5\n2024 07 01 01 00 1.0 MM\n2024 07 01 02 00 1.0 99.0\n2024 07\n")
    assert [r["temp_c"] for r in landed.buoy_ocean(spark, str(tmp_path / "a.txt")).collect()] == [12.5]
    (tmp_path / "w.txt").write_text("#h\n2024 07 01 00 00 270 10.0 x\n2024 07 01 00 00 999 10.0 x\n")
    assert [(r["dir_deg"], r["speed_kn"]) for r in landed.buoy_wind(spark, str(tmp_path / "w.txt")).collect()] == [(270.0, 19.44)]
    (tmp_path / "c.csv").write_text("time,temperature,depth\nUTC,K,m\n2024-07-01T00:00:00Z,283.15,1.5\n")
    row = landed.csv_with_units(spark, str(tmp_path / "c.csv")).first()
    assert abs(row["temp_c"] - 10.0) < 1e-9 and row["depth_m"] == 1.5


def test_json_sources(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"table": {"rows": [["2024-07-01T00:00:00Z", "48.1", "-89.2", "11.5"], ["2024-07-02T00:00:00Z", "48.1", "-89.2", null]]}}')
    assert [r["sst"] for r in landed.grid_rows(spark, str(tmp_path / "g.json")).collect()] == [11.5]
    (tmp_path / "d.json").write_text('{"features": [{"properties": {"DATETIME": "2024-07-01T00:00:00Z", "DISCHARGE": 3.5}}, {"properties": {"DATETIME": "2024-07-02T00:00:00Z", "DISCHARGE": -1}}]}')
    assert [r["q"] for r in landed.discharge(spark, str(tmp_path / "d.json")).collect()] == [3.5]
    (tmp_path / "l.json").write_text('{"id": "a"}\n\n{bad\n{"id": "b"}\n')
    assert {r["id"] for r in landed.read_ledger(spark, str(tmp_path / "l.json"), "id string").collect()} == {"a", "b"}


def test_bronze_and_log_sinks(spark, tmp_path):
    rows = spark.sql("SELECT 's' AS station_id, n AS node, 6.0D AS depth_m, 10.0D + n AS temp_c, TIMESTAMP'2024-07-01 00:00:00' AS valid_time, 20.0D AS water_column_m, false AS clamped FROM VALUES (1), (2) t(n)")
    path = str(tmp_path / "bronze")
    landed.write_bronze(rows, path)
    landed.write_bronze(rows, path)
    assert [r["temp_c"] for r in landed.read_bronze(spark, path).collect()] == [12.0]
    log = str(tmp_path / "log")
    for _ in range(2):
        landed.append_new(spark.range(5).withColumnRenamed("id", "k"), log, ["k"])
    landed.append_new(spark.range(3, 8).withColumnRenamed("id", "k"), log, ["k"])
    assert sorted(r["k"] for r in spark.read.parquet(log).collect()) == list(range(8))
    assert len(landed.fingerprint(spark, log)) == 12


def test_report_has_a_row_for_every_key(spark, tmp_path):
    spine = spark.createDataFrame([("a",), ("b",)], "k string")
    landed.write_report(spine, spark.createDataFrame([("a", 1.0)], "k string, v double"), ["k"], str(tmp_path / "r"))
    assert {r["k"]: r["reason"] for r in spark.read.json(str(tmp_path / "r")).collect()} == {"a": None, "b": "no sample"}


def test_stream_tracker_agrees_with_batch(spark, tmp_path):
    rows = [(h, 15.0, 270.0) for h in range(8)] + [(8, 2.0, 90.0), (9, 2.0, 90.0), (10, 2.0, 90.0)] + [(h, 15.0, 270.0) for h in range(11, 19)] + [(h, 1.0, 90.0) for h in range(30, 40)]
    df = wind(spark, [(h + 24, v, d) for h, v, d in rows])
    for k, part in enumerate((df.where("us < 30 * 3600000000L"), df.where("us >= 30 * 3600000000L"))):
        part.withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}.parquet"))
    schema = spark.read.parquet(str(tmp_path / "in" / "0.parquet")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*.parquet"))
    got = sorted((r["start_us"], r["end_us"]) for r in jobs.run_to_table(jobs.run_tracker(stream, 13.0, 1.0), "tracker").collect())
    want = sorted((r["start_us"], r["end_us"]) for r in events.runs(df, 13.0).collect())
    assert got == want and len(want) == 2


def test_state_groups_hold_what_matters(spark, tmp_path):
    """Dense streams: few rows reach a state group, and the runs and alerts are those of all rows."""
    n, spacing = 6000, 0.01
    hours = [24 + i * spacing + (5.0 if i > 2500 else 0.0) + (0.6 if i > 4000 else 0.0) for i in range(n)]
    blows = [i % 2000 < 1300 or i % 7 == 0 and i % 2000 < 1500 for i in range(n)]
    rows = [(i, "a", int(h * 3_600_000_000), 14.0 + i % 5, 270.0 if b else (90.0 if i % 3 else None)) for i, (h, b) in enumerate(zip(hours, blows))]
    df = spark.createDataFrame(rows, "event_id long, station string, us long, speed_kn double, dir_deg double").withColumn("ts", F.timestamp_micros("us"))
    opened = df.withColumn("open", F.when(F.col("dir_deg").isNotNull(), F.col("dir_deg") == 270))
    opened.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(opened.schema).parquet(str(tmp_path / "in"))

    start, want, last = None, [], None
    for i, _, us, speed, direction in rows:
        fav = direction == 270
        if start is not None and ((not fav and us - end > 2 * 3.6e9) or us - last > 0.5 * 3.6e9):
            want.append((start, end, peak, count))
            start = None
        if fav:
            if start is None:
                start, peak, count = us, 0.0, 0
            end, peak, count = us, max(peak, speed), count + 1
        last = us
    got = sorted((r["start_us"], r["end_us"], r["peak_kn"], r["n"]) for r in jobs.run_to_table(jobs.run_tracker(stream, 13.0, 0.25), "dense").collect())
    assert got == [w for w in want if w[1] - w[0] >= 6 * 3.6e9] and len(got) > 1
    samples = df.select("event_id", "station", "ts", "us", "speed_kn", (F.col("dir_deg") == 270).alias("fav"))
    assert jobs.run_samples(samples, 0.5).count() <= 5 * len({us // 1_800_000_000 for _, _, us, _, _ in rows})

    state, changes = None, []
    for i, _, us, _, direction in rows:
        if direction is not None:
            if (direction == 270) != state and (state is not None or direction == 270):
                changes.append((i, us, direction == 270))
            state = direction == 270
    alerts = jobs.run_to_table(jobs.transitions(stream), "dense").select("event_id", F.unix_micros("ts").alias("us"), "state")
    assert sorted(map(tuple, alerts.collect())) == changes
    assert jobs.known_changes(opened).count() <= len(changes) + len({us // 3_600_000_000 for _, _, us, _, _ in rows})

"""Rules of composed statistics beside brute force: permuted spread, seasonal residual, logistic fit, in-situ events."""

import itertools
import math
import statistics

import numpy as np
import pandas as pd
import pytest

from shoalwater.operators import gates, reports, verify


def test_permuted_spread_over_usable_years(spark):
    """Six years, one with a gap before its onset and one whose mean is missing at one other onset day."""
    rng = np.random.default_rng(2)
    onset = {2010: 200, 2011: 205, 2012: 212, 2013: 199, 2014: 220, 2015: 208, 2016: 215}
    days = [(y, d, float(np.round(20 - 0.05 * (d - 190) + rng.normal(0, 1), 2))) for y in onset for d in range(180, 230) if not (y == 2012 and d == 210) and not (y == 2015 and d == 196)]
    value = {(y, d): v for y, d, v in days}

    def mean(y, d):
        w = [value.get((y, d - k)) for k in range(7)]
        return None if None in w else statistics.mean(w)

    usable = [y for y in onset if mean(y, onset[y]) is not None]
    assert len(usable) == 6
    sd = statistics.pstdev([mean(y, onset[y]) for y in usable])
    null = []
    for p in itertools.permutations([onset[y] for y in usable]):
        v = [mean(y, d) for y, d in zip(usable, p)]
        if None not in v:
            null.append(statistics.pstdev(v))
    want = sum(x <= sd + 1e-12 for x in null) / len(null)
    got = reports.permuted_spread(spark.createDataFrame(days, "year int, doy int, value double"), spark.createDataFrame(list(onset.items()), "year int, doy int"), 4000).collect()
    assert len(got) == 1 and got[0]["n"] == 6 and math.isclose(got[0]["sd"], sd, rel_tol=1e-9)
    assert abs(got[0]["p"] - want) < 0.03 and abs(got[0]["valid"] / 4000 - len(null) / 720) < 0.03
    few = spark.createDataFrame([(y, d) for y, d in list(onset.items())[:4]], "year int, doy int")
    assert reports.permuted_spread(spark.createDataFrame(days, "year int, doy int, value double"), few, 50).count() == 0


def brute_doy(frame, held):
    tr, te = frame[frame.group != held], frame[frame.group == held]
    a, b = np.polyfit(tr.x, tr.y, 1)
    s = (tr.y - a * tr.x - b).groupby(tr.doy).mean()
    season = s.reindex(range(int(tr.doy.min()), int(tr.doy.max()) + 1)).interpolate().rolling(15, min_periods=1, center=True).mean()
    return float(np.mean(np.abs(a * te.x + b + np.nan_to_num([season.get(int(d), 0.0) for d in te.doy]) - te.y)))


def test_seasonal_residual_is_filled_between_days(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(3):
        for d in sorted(rng.choice(np.r_[100:140, 175:230, 260:270], 45, replace=False).tolist()):
            x = float(rng.normal(10, 3))
            rows.append((g, x, 0.8 * x + 2 + 3 * math.sin(d / 20) + float(rng.normal(0, 0.2)), float(rng.normal()), int(d + 3 * g)))
    frame = pd.DataFrame(rows, columns=["group", "x", "y", "w", "doy"])
    got = {r["group"]: r["mae"] for r in verify.correction_families(spark.createDataFrame(rows, "group int, x double, y double, w double, doy int")).where("kind = 'linear_doy'").collect()}
    for g in range(3):
        assert math.isclose(got[g], brute_doy(frame, g), rel_tol=1e-9)


def test_in_situ_events(spark):
    """Two sustained drops of the measured series; the model has the first a day late, and one of its own."""
    slots = range(0, 400)
    drops = {"o": ((60, 72), (200, 214)), "m": ((64, 76), (300, 312))}
    series = {k: [(s, 12.0 - 6 * any(a <= s < z for a, z in d)) for s in slots] for k, d in drops.items()}
    frame = lambda k: spark.createDataFrame([("b", s, v) for s, v in series[k]], "station string, slot long, temp double")
    got = gates.in_situ_events(frame("m"), frame("o")).collect()
    assert [tuple(r) for r in got] == [("b", 1, 1, 1, 0.5, 0.5)]
    assert gates.in_situ_events(frame("m").limit(0), frame("o")).count() == 0


def test_wind_agreement(spark):
    hour = 3_600_000_000
    wind = [("s", i, i * hour, 20.0 if (i // 60) % 2 else 0.0, 270.0) for i in range(600)]
    temps = [("s", i * hour + 5, 15.0 - (4.0 if (i // 60) % 2 else 0.0)) for i in range(600)]
    w = spark.createDataFrame(wind, "station string, event_id long, us long, speed_kn double, dir_deg double")
    t = spark.createDataFrame(temps, "station string, us long, temp_c double")
    got = gates.wind_agreement(t, w).collect()
    assert len(got) == 1 and got[0]["n"] == 600 and got[0]["r"] < -0.3
    assert gates.wind_agreement(t.limit(2), w).first()["r"] is None


def newton(x, y, steps=50):
    """Logistic regression by Newton's method in numpy."""
    a = np.c_[np.ones(len(x)), x]
    b = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-a @ b))
        b += np.linalg.solve((a.T * (p * (1 - p))) @ a, a.T @ (y - p))
    return b


@pytest.mark.parametrize("seed", [1, 2])
def test_logistic_fit_equals_newton(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(3, 2, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.9 * x - 2)))).astype(int)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    got = verify.logistic_fit(rows, "x", "y")
    b0, b1 = newton(x, y)
    assert got["n"] == 400 and math.isclose(got["a"], b0, rel_tol=1e-6) and math.isclose(got["b"], b1, rel_tol=1e-6) and math.isclose(got["s50"], -b0 / b1, rel_tol=1e-6)


def test_trajectory_without_isotherm_or_pixels(spark):
    columns = spark.createDataFrame([(1, 0, [1.0, 5.0, 9.0], [20.0, 14.0, 4.0]), (1, 12, [1.0, 5.0, 9.0], [20.0, 19.0, 18.0]), (2, 0, [1.0, 5.0, 9.0], [20.0, 14.0, 4.0]), (1, 24, [1.0, 5.0, 9.0], [20.0, 14.0, 4.0])], "spot int, lead int, depths array<double>, temps array<double>")
    patches = spark.createDataFrame([(1, 6.0, 10.0), (1, 8.0, 30.0), (1, 40.0, 5.0), (1, None, 0.0), (1, 8.0, 99.0)], "spot int, depth double, dist double")
    got = {(r["spot"], r["lead"]): r for r in gates.trajectory(columns, patches, 10.0, 0.0, (0.0, -4.0, 2.0), 60, 22, 2.0).collect()}
    one = got[1, 0]
    assert math.isclose(one["iso"], 6.6) and one["reach"] and one["nearest"] == 30.0 and one["area"] == 4.0 and math.isclose(one["gradient"], 2.5) and one["possible"]
    assert got[1, 12]["iso"] is None and not got[1, 12]["reach"] and got[1, 12]["nearest"] is None and got[1, 12]["area"] == 0
    assert not got[2, 0]["reach"] and len(got) == 4
    windows = [tuple(r)[:4] for r in gates.reach_windows(gates.trajectory(columns, patches, 10.0, 0.0, (0.0, -4.0, 2.0), 60, 22, 2.0)).orderBy("first_lead").collect()]
    assert windows == [(1, 0, 0, 1), (1, 24, 24, 1)]


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(k, None if rng.random() < 0.1 else float(rng.integers(0, 50)) + float(rng.random() < 0.3) / 3) for k in ("a", "b", None) for _ in range(500)] + [("one", 4.5), ("none", None)]
    table = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r for r in verify.quantiles(table, "v", ["k"], {"p25": 0.25, "p50": 0.5, "p99": 0.99, "p0": 0.0, "p100": 1.0}).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for k, r in got.items():
        v = [x for y, x in rows if y == k and x is not None]
        for name in ("p0", "p25", "p50", "p99", "p100"):
            assert math.isclose(r[name], float(np.quantile(v, int(name[1:]) / 100)), rel_tol=1e-12, abs_tol=1e-12)
    whole = verify.quantiles(table, "v", [], {"p90": 0.9}).collect()
    assert len(whole) == 1 and math.isclose(whole[0]["p90"], float(np.quantile([x for _, x in rows if x is not None], 0.9)))
    assert verify.quantiles(table.limit(0), "v", ["k"], {"p90": 0.9}).count() == 0

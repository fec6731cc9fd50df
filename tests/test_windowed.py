"""Injected readers: windows, retries and coverage; sweeps that end between append and commit."""

from datetime import date, timedelta

import pytest

from shoalwater.session import new_path
from shoalwater.sources import windowed
from shoalwater.streaming import jobs

DAY = date(2024, 3, 1)


def test_clamp():
    assert windowed.clamp(DAY) == (DAY, None)
    assert windowed.clamp(DAY, coverage_end=date(2024, 2, 1)) == (date(2024, 2, 1), "source coverage ends 2024-02-01")
    assert windowed.clamp(DAY, today=date(2024, 2, 20)) == (date(2024, 2, 20), "requested end is in the future")
    end, why = windowed.clamp(DAY, date(2024, 2, 1), date(2024, 2, 20))
    assert end == date(2024, 2, 1) and "future" in why and "coverage" in why
    assert windowed.clamp(DAY, coverage_end=date(2025, 1, 1), today=date(2025, 1, 1)) == (DAY, None)


def test_windows_meet_without_overlap():
    got = [(w.lo, w.hi) for w in windowed.date_windows(DAY, DAY + timedelta(days=9), 4)]
    assert got == [(DAY, DAY + timedelta(days=3)), (DAY + timedelta(days=4), DAY + timedelta(days=7)), (DAY + timedelta(days=8), DAY + timedelta(days=9))]
    assert windowed.date_windows(DAY, DAY - timedelta(days=1), 4) == [] and len(windowed.date_windows(DAY, DAY, 4)) == 1


def test_rows_and_coverage(spark, tmp_path):
    """Two windows fail twice before they answer, one never answers, one is empty, one always raises."""
    log = str(tmp_path / "asked")

    def fetch(first, last):
        with open(log, "a") as f:
            f.write(f"{first}\n")
        n = (first - date(2024, 3, 1)).days // 2
        asked = open(log).read().count(str(first))
        if n == 4 or (n in (1, 2) and asked < 3):
            raise OSError("overloaded")
        return [] if n == 3 else None if n == 5 else [((first + timedelta(days=k)).isoformat(), n) for k in range((last - first).days + 1)]

    rows, coverage = windowed.read_windowed(spark, fetch, "day string, n int", DAY, DAY + timedelta(days=20), 2, coverage_end=DAY + timedelta(days=12), tries=3, backoff=0.0)
    got = {r["window_start"]: r for r in coverage.collect()}
    at = lambda n: got[DAY + timedelta(days=2 * n)]
    assert len(got) == 7 and [at(n)["missing"] for n in range(7)] == [False, False, False, True, True, True, False]
    assert [at(n)["attempts"] for n in range(7)] == [1, 3, 3, 3, 3, 3, 1] and at(6)["window_end"] == DAY + timedelta(days=12) and at(6)["records"] == 1
    assert {r["clamp_reason"] for r in got.values()} == {"source coverage ends 2024-03-13"}
    assert sorted((r["day"], r["n"]) for r in rows.collect()) == [((DAY + timedelta(days=2 * n + k)).isoformat(), n) for n in (0, 1, 2, 6) for k in range(1 if n == 6 else 2)]
    assert open(log).read().count("\n") == 2 + 3 * 5  # a window that fails is asked again alone


def test_range_past_coverage(spark):
    rows, coverage = windowed.read_windowed(spark, lambda a, z: [(1,)], "x int", DAY, DAY + timedelta(days=3), coverage_end=DAY - timedelta(days=1))
    assert rows.count() == 0 and coverage.count() == 0 and rows.columns == ["x"]


def source():
    """A fetch that tasks get by value."""

    def records(lo, hi):
        return [(t, f"r{t}") for t in range(lo, hi) if t % 3]

    return records


_records = source()


def _appended(spark, out):
    return sorted(r["t"] for r in spark.read.parquet(out).collect())


def test_sweep_resumes_and_reads_its_open_window_again(spark):
    out, state = new_path(spark, "swept"), new_path(spark, "state")
    run = lambda until: windowed.sweep(spark, _records, "t long, v string", 0, 10, until, lambda b: b.write.mode("append").parquet(out), state)
    run(25)
    assert _appended(spark, out) == [t for t, _ in _records(0, 25)]
    run(25)  # nothing new, nothing read
    assert len(_appended(spark, out)) == len(_records(0, 25))
    run(47)  # the window from 20 on was open
    assert _appended(spark, out) == sorted([t for t, _ in _records(0, 25)] + [t for t, _ in _records(20, 47)])


def test_sweep_that_ends_between_append_and_commit(spark):
    out, state = new_path(spark, "swept"), new_path(spark, "state")

    def sweep(until, killed):
        def accept(batch):
            batch.write.mode("append").parquet(out)
            if killed:
                raise RuntimeError("killed after the append")

        windowed.sweep(spark, _records, "t long, v string", 0, 10, until, accept, state)

    sweep(20, False)
    with pytest.raises(Exception, match="killed after the append"):
        sweep(30, True)
    sweep(30, False)
    assert _appended(spark, out) == sorted([t for t, _ in _records(0, 30)] + [t for t, _ in _records(20, 30)])  # one window twice
    again = spark.readStream.schema("t long, v string").parquet(out).selectExpr("t", "v", "timestamp_seconds(t) AS ts")
    once = jobs.run_to_table(jobs.keyed_append(again, ["t"], "100 days"), "once")
    assert sorted((r["t"], r["v"]) for r in once.collect()) == _records(0, 30)

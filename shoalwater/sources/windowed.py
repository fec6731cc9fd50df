"""Readers that a caller injects, one date or time window at a time, as Spark data sources.

``fetch`` is the caller's function. Every window is one input partition, so windows are read by as many
tasks as there are cores, and a task that fails or an executor that is lost repeats its own window alone.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..session import new_path, pin


class Window(InputPartition):
    """A window; its ends are days, both inside (batch), or instants, the last one outside (streams)."""

    def __init__(self, lo, hi):
        self.lo, self.hi = lo, hi


def clamp(end: date, coverage_end: date | None = None, today: date | None = None) -> tuple[date, str | None]:
    """The last day worth asking for, and why it is not ``end``: the future, or past the source's coverage."""
    reasons = []
    if today is not None and end > today:
        end = today
        reasons.append("requested end is in the future")
    if coverage_end is not None and end > coverage_end:
        end = coverage_end
        reasons.append(f"source coverage ends {coverage_end.isoformat()}")
    return end, "; ".join(reasons) or None


def date_windows(start: date, end: date, days: int) -> list[Window]:
    """``start`` to ``end``, both inside, in windows of so many days; none if the range is reversed."""
    n = max(0, -(-((end - start).days + 1) // days))
    return [Window(lo := start + timedelta(days=i * days), min(lo + timedelta(days=days - 1), end)) for i in range(n)]


class _Windows(DataSourceReader):
    def __init__(self, windows: list[Window], fetch, tries: int, backoff: float):
        self.windows, self.fetch, self.tries, self.backoff = windows, fetch, tries, backoff

    def partitions(self):
        return self.windows

    def read(self, partition):
        """The window's records, or one row without a record. Nothing and an error are both tried again."""
        got = None
        for attempt in range(1, max(1, self.tries) + 1):
            try:
                got = list(self.fetch(partition.lo, partition.hi) or ())
            except Exception:  # sources signal overload in any way
                got = None
            if got:
                break
            if attempt < self.tries:
                time.sleep(self.backoff * 2 ** (attempt - 1))
        for record in got or (None,):
            yield partition.lo, partition.hi, attempt, record if record is None else tuple(record)


def _registered(spark: SparkSession, schema: str, **readers: Callable) -> str:
    """Register a data source of one use with these reader methods; its name."""
    unique = f"windows_{uuid.uuid4().hex}"
    methods = {k: (lambda self, schema, make=make: make()) for k, make in readers.items()}
    spark.dataSource.register(type("WindowSource", (DataSource,), {"name": classmethod(lambda cls: unique), "schema": lambda self: schema, **methods}))
    return unique


def read_windowed(spark: SparkSession, fetch: Callable[[date, date], Iterable[tuple]], schema: str, start: date, end: date, days: int = 14, coverage_end: date | None = None, today: date | None = None, tries: int = 3, backoff: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Rows of ``schema`` for the days from ``start`` to ``end``, and the coverage table beside them.

    ``fetch(first, last)`` gives the records of a window, both days inside, as tuples. A window that gives
    nothing or raises is tried again alone, after ``backoff`` seconds that double; after ``tries`` times it is missing.
    Coverage has a row for each window, with data or without: window_start, window_end, attempts, records, missing, and
    clamp_reason (null unless the range was cut). Whether a missing window matters is the caller's decision. A range past
    the coverage has no windows. Both tables come from one reading, which is pinned.
    """
    last, reason = clamp(end, coverage_end, today)
    windows = date_windows(start, last, days)
    if windows:
        name = _registered(spark, f"lo date, hi date, attempts int, record struct<{_struct(schema)}>", reader=lambda: _Windows(windows, fetch, tries, backoff))
        raw = pin(spark.read.format(name).load(), "windows")
    else:
        raw = spark.createDataFrame([], f"lo date, hi date, attempts int, record struct<{_struct(schema)}>")
    coverage = raw.groupBy(F.col("lo").alias("window_start"), F.col("hi").alias("window_end")).agg(F.max("attempts").alias("attempts"), F.count("record").alias("records"))
    return raw.where("record IS NOT NULL").select("record.*"), coverage.withColumns({"missing": F.col("records") == 0, "clamp_reason": F.lit(reason).cast("string")})


def _struct(schema: str) -> str:
    """'a long, b string' as the fields of a struct type."""
    return ", ".join(": ".join(field.split(None, 1)) for field in schema.split(", "))


# ------------------------------------------------------------------ sweeps


class _Sweep(DataSourceStreamReader):
    """Time windows as offsets: ``done`` counts the closed windows, ``until`` is the instant read up to.

    The last window is closed only when it lies before ``until`` as a whole; until then every run reads it again
    from its start, because it was still filling.
    """

    def __init__(self, fetch, first: int, width: int, until: int):
        self.fetch, self.first, self.width, self.until = fetch, first, width, until

    def initialOffset(self):
        return {"done": 0, "until": self.first}

    def latestOffset(self):
        return {"done": max(0, self.until - self.first) // self.width, "until": max(self.first, self.until)}

    def partitions(self, start, end):
        if start == end:
            return []
        return [Window(lo, min(lo + self.width, end["until"])) for lo in range(self.first + start["done"] * self.width, end["until"], self.width)]

    def read(self, partition):
        for record in self.fetch(partition.lo, partition.hi):
            yield tuple(record)


def sweep(spark: SparkSession, fetch: Callable[[int, int], Iterable[tuple]], schema: str, first: int, width: int, until: int, accept: Callable[[DataFrame], None], state: str) -> None:
    """Read what lies before ``until`` and was not read before, window by window, and give it to ``accept``.

    ``fetch(lo, hi)`` gives the records of the instants from ``lo`` on and before ``hi``; windows are ``width`` long and
    start at ``first``. ``state`` is the folder of the offsets, which are committed after ``accept`` has returned: a run
    that ends in between gives the same windows to ``accept`` again, and so does the last, still open window of
    every run. What ``accept`` appends is therefore at least once, to be read by key (``streaming.jobs.keyed_append``).
    ``until`` never goes back between runs of one ``state``.
    """
    name = _registered(spark, schema, streamReader=lambda: _Sweep(fetch, first, width, until))
    query = spark.readStream.format(name).load().writeStream.foreachBatch(lambda batch, n: accept(batch)).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def land_by_day(rows: DataFrame, day: str) -> str:
    """Write ``rows`` to the shared folder, one folder a day; its path."""
    path = new_path(rows.sparkSession, "by-day")
    rows.repartition(day).write.partitionBy(day).parquet(path)
    return path


def landed_days(path: str, columns: list[str], day: str) -> Callable[[int, int], list[tuple]]:
    """A fetch over what ``land_by_day`` wrote: the rows of the days (numbers) from lo on and before hi."""

    def fetch(lo: int, hi: int) -> list[tuple]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        found = []
        for n in range(lo, hi):
            for f in store.get_file_info(fs.FileSelector(f"{root}/{day}={n}", allow_not_found=True)):
                if f.path.endswith(".parquet"):
                    found += zip(*(c.to_pylist() for c in pq.ParquetFile(store.open_input_file(f.path)).read(columns).columns), strict=True)
        return found

    return fetch

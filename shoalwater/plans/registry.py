"""All queries of the library with their DuckDB twins, keyed by operator id."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame under an operator id, with its DuckDB twin."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sustained runs of all events as one station, and the phase at the last reading."""
    from ..operators import events
    from .bindings import readings_hourly

    rows = readings_hourly(spark, sf_dir, one_station=True)
    return events.phase_at(events.runs(rows, threshold_kn=13.0), rows.groupBy("station").max("us").withColumnRenamed("max(us)", "us"))


for _module in ("queries_events", "queries_verify", "queries_profiles", "queries_spatial", "queries_ledger", "queries_stream", "queries_reports", "queries_sources", "queries_gates", "queries_windowed", "queries_tiles"):
    import_module(f"{__package__}.{_module}")

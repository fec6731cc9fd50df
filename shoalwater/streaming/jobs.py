"""Structured Streaming forms of the stateful operators; each has a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import exprs
from ..session import new_path


def events_stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """The event files under ``path`` as a stream with event time ``ts``.

    ``path`` is a folder of Parquet files or one such file; as a pattern, the source takes both.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that there is and return what it wrote, read from its table."""
    spark = stream.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")  # a batch that runs again replaces what it wrote

    write(spark.createDataFrame([], stream.schema), -1)  # a stream without rows has a table, too
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def keyed_append(stream: DataFrame, key: list[str], delay: str = "1 hour") -> DataFrame:
    """Rows whose natural key was not seen within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def daily_summary(stream: DataFrame, delay: str = "6 hours", least: int = 18) -> DataFrame:
    """Mean, max, min and count per station and day, emitted when the day is closed; thin days flagged."""
    day = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "station")
    out = day.agg(F.avg("temp_c").alias("mean_c"), F.max("temp_c").alias("max_c"), F.min("temp_c").alias("min_c"), F.count("*").alias("n"))
    return out.select("station", F.unix_date(F.to_date("window.start")).alias("day"), "mean_c", "max_c", "min_c", "n", (F.col("n") < least).alias("thin"))


def staleness(stream: DataFrame, at_us: int, most_h: float = 18.0) -> DataFrame:
    """Newest row of each source against an instant, and whether it is stale (update or complete mode)."""
    newest = stream.groupBy("station").agg(F.max("ts").alias("ts"))
    age = (F.lit(at_us) - F.unix_micros("ts")) / 3_600_000_000
    return newest.select("station", age.alias("age_h"), (age > most_h).alias("stale"))


def sliding_drive(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """In-sector mean speed over sliding windows of 24 hours, the coarse form of the trailing integral."""
    v = F.when(exprs.in_sector("dir_deg"), F.col("speed_kn")).otherwise(F.lit(0.0))
    w = stream.withColumn("v", v).withWatermark("ts", delay).groupBy("station", F.window("ts", "24 hours", "1 hour"))
    return w.agg(F.avg("v").alias("mean_v"), F.count("*").alias("n")).select("station", F.unix_micros("window.end").alias("end_us"), "mean_v", "n")


def sessions(stream: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Episodes of events at most a gap apart, emitted when they are closed."""
    s = stream.withWatermark("ts", delay).groupBy("station", F.session_window("ts", gap))
    return s.agg(F.min("ts").alias("a"), F.max("ts").alias("z"), F.count("*").alias("n")).select("station", F.unix_micros("a").alias("first_us"), F.unix_micros("z").alias("last_us"), "n")


def late_fill(stream: DataFrame, static: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with their third-party value from a static table, null where it is not there yet."""
    return stream.join(static.select(key, value), key, "left")


def known_changes(rows: DataFrame) -> DataFrame:
    """event_id, station, ts, open: of a batch, each station's and hour's first known state and its changes.

    Each hour is a task's group of its own, so that a station's state group holds what changed only.
    """

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["open"].notna()].sort_values(["ts", "event_id"])
        return pdf[(pdf["open"] != pdf["open"].shift())].drop(columns="hour")

    hour = rows.select("event_id", "station", "ts", "open", F.floor(F.unix_micros("ts") / 3_600_000_000).alias("hour"))
    return hour.groupBy("station", "hour").applyInPandas(reduce, "event_id long, station string, ts timestamp, open boolean")


def transitions(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A row for each change of a station's state; null keeps the last; a first state only if true.

    The last state of a station is kept; rows of a batch are taken in time order, hours first
    reduced to their changes.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for event_id, ts, open_ in zip(rows["event_id"], rows["ts"], rows["open"]):
            if pd.isna(open_):
                continue
            if bool(open_) != last and (last is not None or open_):
                out.append((int(event_id), key[0], ts, bool(open_)))
            last = bool(open_)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["event_id", "station", "ts", "state"])

    rows = known_changes(stream).withWatermark("ts", delay)
    return rows.groupBy("station").applyInPandasWithState(step, "event_id long, station string, ts timestamp, state boolean", "last boolean", "append", GroupStateTimeout.NoTimeout)


def run_samples(rows: DataFrame, width_h: float) -> DataFrame:
    """The samples of a batch that runs depend on: event_id, station, ts, us, fav, peak_kn, n.

    ``width_h``: at most the data gap and the grace, so that nothing can end a run between two samples of
    one bucket. Of a station's bucket stay the first and the last sample, the first favourable one, the
    last one before it and the last favourable one, which has the peak and the number of those left out.
    """
    width = max(1, int(width_h * 3_600_000_000))

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "event_id"], ignore_index=True)
        fav = pdf["fav"].fillna(False).to_numpy(dtype=bool)
        some = fav.nonzero()[0]
        n, peak = fav.astype(int), pdf["speed_kn"].where(fav, 0.0).to_numpy(dtype=float, copy=True)
        stay = {0, len(pdf) - 1}
        if len(some):
            first, last = int(some[0]), int(some[-1])
            stay |= {first, last, max(0, first - 1)}
            if first < last:
                n[last], peak[last] = len(some) - 1, peak[some].max()
        return pdf.assign(fav=fav, n=n, peak_kn=peak).loc[sorted(stay), ["event_id", "station", "ts", "us", "fav", "peak_kn", "n"]]

    bucket = rows.withColumn("bucket", F.floor(F.col("us") / width))
    return bucket.groupBy("station", "bucket").applyInPandas(reduce, "event_id long, station string, ts timestamp, us long, fav boolean, peak_kn double, n int")


def run_tracker(stream: DataFrame, threshold_kn: float, spacing_h: float, min_run_h: float = 6.0, grace_h: float = 2.0, delay: str = "1 hour") -> DataFrame:
    """Sustained runs per station as they end: by a lull beyond the grace or a data gap.

    The median spacing is not known ahead, so it is a parameter. An open run is closed by the
    event-time timer once the watermark is past its last sample, the gap and the grace. A state
    group holds the few samples of each short bucket of time that matter (``run_samples``).
    """
    gap = 2 * spacing_h
    schema = "station string, start_us long, end_us long, duration_h double, peak_kn double, n int"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end, last, peak, n = state.get if state.exists else (None, None, None, 0.0, 0)
        out = []

        def close() -> None:
            hours = (end - start) / 3.6e9 or spacing_h
            if hours >= min_run_h:
                out.append((key[0], start, end, hours, peak, n))

        if state.hasTimedOut:
            if start is not None:
                close()
            state.remove()
            yield pd.DataFrame(out, columns=["station", "start_us", "end_us", "duration_h", "peak_kn", "n"])
            return
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        for us, speed, fav, more in zip(rows["us"].tolist(), rows["peak_kn"].tolist(), rows["fav"].tolist(), rows["n"].tolist()):
            lull = not fav and start is not None and us - end > grace_h * 3.6e9
            if start is not None and (lull or us - last > gap * 3.6e9):
                close()
                start = None
            if fav:
                if start is None:
                    start, peak, n = us, 0.0, 0
                end, peak, n = us, max(peak, speed), n + more
            last = us
        state.update((start, end, last, peak, n))
        state.setTimeoutTimestamp(max(int(last / 1000 + (gap + grace_h) * 3.6e6) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["station", "start_us", "end_us", "duration_h", "peak_kn", "n"])

    fav = exprs.in_sector("dir_deg") & (F.col("speed_kn") >= threshold_kn)
    samples = stream.select("event_id", "station", "ts", F.unix_micros("ts").alias("us"), F.col("speed_kn").cast("double").alias("speed_kn"), fav.alias("fav"))
    rows = run_samples(samples, min(gap, grace_h)).withWatermark("ts", delay)
    return rows.groupBy("station").applyInPandasWithState(step, schema, "start_us long, end_us long, last_us long, peak_kn double, n int", "append", GroupStateTimeout.EventTimeTimeout)

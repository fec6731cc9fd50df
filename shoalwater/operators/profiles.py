"""Vertical profiles held as two parallel arrays, one row a profile, in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def layer_depths(siglay: Column, h: Column, zeta: Column) -> Column:
    """Depths of sigma layers; positive layers and a column that is not positive are errors."""
    column = h + zeta
    wrong = F.exists(siglay, lambda s: s > 0) | (column <= 0)
    return F.when(wrong, F.raise_error(F.lit("layers must not be positive, the column must be")).cast("array<double>")).otherwise(F.transform(siglay, lambda s: -s * column))


def _once(depths: Column, temps: Column, then) -> Column:
    """``then(depths, temps)`` with both arrays worked out once, not once for each element that a lambda looks at."""
    return F.get(F.transform(F.array(F.struct(depths.alias("z"), temps.alias("t"))), lambda b: then(b["z"], b["t"])), F.lit(0))


def _segments(depths: Column, temps: Column) -> Column:
    """Neighbouring levels as structs (z0, t0, z1, t1), shallow to deep."""
    n = F.size(depths)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.element_at(depths, i.cast("int")).alias("z0"), F.element_at(temps, i.cast("int")).alias("t0"), F.try_element_at(depths, (i + 1).cast("int")).alias("z1"), F.try_element_at(temps, (i + 1).cast("int")).alias("t1")))


def at_depth(depths: Column, temps: Column, z: Column, clamp: bool = True) -> Column:
    """(temp, clamped): linear between the bracketing levels; outside the span clamped or null."""
    hit = F.get(F.filter(_segments(depths, temps), lambda s: (s["z0"] <= z) & (z <= s["z1"])), F.lit(0))
    inside = hit["t0"] + (z - hit["z0"]) / (hit["z1"] - hit["z0"]) * (hit["t1"] - hit["t0"])
    top, bottom = F.element_at(depths, 1), F.element_at(depths, -1)
    outside = (z < top) | (z > bottom)
    edge = F.when(z < top, F.element_at(temps, 1)).otherwise(F.element_at(temps, -1)) if clamp else F.lit(None).cast("double")
    return F.struct(F.when(outside, edge).otherwise(inside).alias("temp"), (outside & F.lit(clamp)).alias("clamped"))


def crossing(depths: Column, temps: Column, target: Column | float, colder: bool = True) -> Column:
    """Shallowest crossing of a temperature: (depth, status).

    ``crossing`` is a measurement; ``above_top`` means the target lies at or above the first level, so the
    depth is only a bound; ``below_bottom`` has no depth. An exact hit counts.
    """
    t = target if isinstance(target, Column) else F.lit(float(target))
    return _once(depths, temps, lambda z, x: _crossing(z, x, t, colder))


def _crossing(depths: Column, temps: Column, t: Column, colder: bool) -> Column:
    beyond = (lambda x: x <= t) if colder else (lambda x: x >= t)
    hit = F.get(F.filter(_segments(depths, temps), lambda s: ~beyond(s["t0"]) & beyond(s["t1"])), F.lit(0))
    z = hit["z0"] + (t - hit["t0"]) / (hit["t1"] - hit["t0"]) * (hit["z1"] - hit["z0"])
    first = F.element_at(temps, 1)
    row = lambda depth, status: F.struct(depth.cast("double").alias("depth"), F.lit(status).alias("status"))
    return F.when(beyond(first) & (first != t), row(F.element_at(depths, 1), "above_top")).when(first == t, row(F.element_at(depths, 1), "crossing")).when(hit.isNotNull(), row(z, "crossing")).otherwise(row(F.lit(None), "below_bottom"))


def taper(z: Column, surface: float, deep: float, full_at: float = 6.0) -> Column:
    """Depth-tapered correction: -surface at the top, -deep from ``full_at`` down."""
    return F.lit(-surface) + F.lit(surface - deep) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), z / full_at))


def corrected(depths: Column, temps: Column, surface: float, deep: float) -> Column:
    return F.transform(temps, lambda t, i: t + taper(F.element_at(depths, (i + 1).cast("int")), surface, deep))


def isotherm_band(rows: DataFrame, target: float, surface: float, band: tuple[float, float, float]) -> DataFrame:
    """Isotherm depth of the corrected profile with its shallow and deep bound from the band's ends."""
    out = rows
    for name, deep in zip(("mid", "low", "high"), band):
        out = out.withColumn(name, crossing(F.col("depths"), corrected(F.col("depths"), F.col("temps"), surface, deep), target))
    return out.select("node", F.col("mid.depth").alias("depth"), F.col("mid.status").alias("status"), F.least("low.depth", "high.depth").alias("shallow"), F.greatest("low.depth", "high.depth").alias("deep"))


def local_gradient(depths: Column, temps: Column, z: Column) -> Column:
    """|dT/dz| of the levels that bracket z; null outside."""
    hit = F.get(F.filter(_segments(depths, temps), lambda s: (s["z0"] <= z) & (z <= s["z1"])), F.lit(0))
    return F.abs((hit["t1"] - hit["t0"]) / (hit["z1"] - hit["z0"]))


def depth_uncertainty(sigma: float, gradient: Column, least: float = 0.05, most_m: float = 15.0) -> Column:
    """(metres, reason): sigma over gradient; null where the water is mixed or the figure is useless."""
    m = F.lit(sigma) / gradient
    return F.when(gradient.isNull() | (gradient < least), F.struct(F.lit(None).cast("double").alias("metres"), F.lit("mixed").alias("reason"))).when(m > most_m, F.struct(F.lit(None).cast("double").alias("metres"), F.lit("over maximum").alias("reason"))).otherwise(F.struct(m.alias("metres"), F.lit(None).cast("string").alias("reason")))


def depth_to_distance(dist: Column, depth: Column, target: Column) -> Column:
    """Distance along a transect at which the bottom first reaches a depth; the first distance if it is already there."""
    hit = F.get(F.filter(_segments(dist, depth), lambda s: (s["t0"] != s["t1"]) & (F.least(s["t0"], s["t1"]) <= target) & (target <= F.greatest(s["t0"], s["t1"]))), F.lit(0))
    return F.when(target <= F.element_at(depth, 1), F.element_at(dist, 1)).otherwise(hit["z0"] + (target - hit["t0"]) / (hit["t1"] - hit["t0"]) * (hit["z1"] - hit["z0"]))


def mean_near(levels: DataFrame, at_us: int, tolerance_us: int) -> DataFrame:
    """Mean per depth of the samples within the tolerance of an instant: depth, temp, n."""
    return levels.where(F.abs(F.col("us") - at_us) <= tolerance_us).groupBy("depth").agg(F.avg("temp").alias("temp"), F.count("*").alias("n"))

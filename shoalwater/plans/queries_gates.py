"""Queries of forecast gates, in-situ reports, scorecards, bends, rays and scattered grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as ops, spatial
from ..session import new_path
from ..sources import landed
from .bindings import DAY_US, HOUR_US, NODES, PIXELS, PROFILES, READINGS, RIVER, TEMPS, load, nodes, pixels, profiles, readings, river, temps
from .queries_events import DRIVE
from .queries_profiles import _band_sql
from .queries_reports import _rounded
from .registry import query

#: The day that parts the tuning days from the held-out ones.
SPLIT_DAY = 19733


# ------------------------------------------------------------------------------- gate rows


def _crossed(name: str, src: str, target: float) -> str:
    """CTE ``name`` (k, depth, status) of the shallowest crossing in ``src`` (k, depth, t)."""
    return f"""{name}_s AS (SELECT k, depth AS z0, t AS t0, lead(depth) OVER w AS z1, lead(t) OVER w AS t1 FROM {src} WINDOW w AS (PARTITION BY k ORDER BY depth)), {name}_f AS (SELECT k, arg_min(t, depth) AS first, min(depth) AS top FROM {src} GROUP BY k),
{name}_h AS (SELECT k, min(z0 + ({target} - t0) / (t1 - t0) * (z1 - z0)) AS z FROM {name}_s WHERE NOT t0 <= {target} AND t1 <= {target} GROUP BY k),
{name} AS (SELECT f.k, CASE WHEN first <= {target} THEN top ELSE z END AS depth, CASE WHEN first < {target} THEN 'above_top' WHEN first = {target} OR z IS NOT NULL THEN 'crossing' ELSE 'below_bottom' END AS status FROM {name}_f f LEFT JOIN {name}_h USING (k))"""


_TAPER = "temp - (first - sst) + ((first - sst) - 3.31) * greatest(0, least(1, depth / 6.0::DOUBLE))"


@query("ARR-09", f"""WITH {PROFILES}, lv AS (SELECT node % 5 AS station, node // 5 AS day, node, depth, temp FROM levels), fs AS (SELECT station, day, arg_min(temp, depth) AS first FROM lv GROUP BY ALL),
known AS (SELECT station, issue, arg_max(sst, day) AS sst FROM (SELECT station, day, first + 0.7 AS sst, unnest([day, day + 1, day + 2]) AS issue FROM fs WHERE day % 7 NOT IN (1, 2, 3)) GROUP BY ALL),
ol AS (SELECT node AS k, depth, temp AS t, count(*) OVER (PARTITION BY node) AS n FROM lv WHERE (depth::BIGINT * 7 + node) % 9 >= node % 9), o_in AS (SELECT k, depth, t FROM ol WHERE n >= 5), {_crossed('o', 'o_in', 11.0)},
nl AS (SELECT lv.node AS k, depth, {_TAPER} AS t FROM lv JOIN fs USING (station, day) JOIN known ON known.station = lv.station AND known.issue = lv.day), {_crossed('held', 'nl', 11.0)},
fc AS (SELECT lv.station, lv.day, lead, lv.day - lead AS issue, lv.node * 10 + lead AS k, depth, temp + lead * 0.5 AS temp, first + lead * 0.5 AS first FROM lv JOIN fs USING (station, day), (SELECT unnest([1, 2, 3]) AS lead)),
r_in AS (SELECT k, depth, temp AS t FROM fc), {_crossed('r', 'r_in', 11.0)}, c_in AS (SELECT k, depth, {_TAPER} AS t FROM fc JOIN known USING (station, issue)), {_crossed('c', 'c_in', 11.0)}
SELECT fk.station, fk.day, lead * 24 AS lead_h, fk.issue, round(o.depth, 6) AS obs_iso, round(r.depth, 6) AS raw_iso, r.status AS fcst_status, round(c.depth, 6) AS corr_iso, round(abs(c.depth - o.depth), 6) AS abs_err, round(held.depth, 6) AS persist_iso, round(abs(held.depth - o.depth), 6) AS persist_abs_err, CASE WHEN sst IS NULL THEN 'absent' ELSE 'ok' END AS anchor
FROM (SELECT DISTINCT station, day, lead, issue, k FROM fc) fk JOIN o ON o.k = fk.k // 10 AND o.status = 'crossing' JOIN r ON r.k = fk.k LEFT JOIN c ON c.k = fk.k LEFT JOIN known ON known.station = fk.station AND known.issue = fk.issue LEFT JOIN held ON held.k = fk.issue * 5 + fk.station""")
def arr09(spark, d):
    p = profiles(spark, d).select((F.col("node") % 5).alias("station"), F.floor(F.col("node") / 5).alias("day"), "node", "depths", "temps")
    lead = p.withColumn("lead", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    forecasts = lead.select("station", "day", (F.col("lead") * 24).alias("lead_h"), "depths", F.transform("temps", lambda t: t + F.col("lead") * 0.5).alias("temps"))
    holes = F.transform("temps", lambda t, i: F.when(((i + 1) * 7 + F.col("node")) % 9 >= F.col("node") % 9, t))
    anchors = p.where("day % 7 NOT IN (1, 2, 3)").select("station", "day", (F.col("temps")[0] + 0.7).alias("sst"))
    out = ops.forecast_gate(forecasts, p.select("station", "day", "depths", "temps"), p.select("station", "day", "depths", holes.alias("temps")), anchors, 11.0, 3.31)
    return out.withColumns({c: F.round(c, 6) for c in ("obs_iso", "raw_iso", "corr_iso", "abs_err", "persist_iso", "persist_abs_err")})


# ------------------------------------------------------------------------------- trajectories

_TRAJECTORY = f"""{PIXELS}, px AS (SELECT row % 5 AS spot, depth, (row * 7 + col * 3) % 100 AS dist FROM pixels WHERE (row * 7 + col * 3) % 100 <= 60 AND depth <= 22), {PROFILES}, {_band_sql('mid', 3.31)}, {_band_sql('low', 1.51)}, {_band_sql('high', 5.55)},
i AS (SELECT mid.node, mid.node % 5 AS spot, mid.node // 5 AS lead, mid.depth AS iso, least(low.depth, high.depth) AS shallow, greatest(low.depth, high.depth) AS deep FROM mid JOIN low USING (node) JOIN high USING (node)),
gr AS (SELECT i.node, arg_min(abs((t1 - t0) / (z1 - z0)), z0) AS gradient FROM i JOIN s_mid s ON s.node = i.node AND iso BETWEEN z0 AND z1 GROUP BY i.node),
tj AS (SELECT i.spot, lead, iso, shallow, deep, gradient, count(*) FILTER (depth >= iso) > 0 AS reach, min(dist) FILTER (depth >= iso) AS nearest, count(*) FILTER (depth >= iso) * 100.0::DOUBLE AS area, count(*) FILTER (depth >= deep) > 0 AS certain, count(*) FILTER (depth >= shallow) > 0 AS possible FROM i LEFT JOIN gr USING (node) LEFT JOIN px ON px.spot = i.spot GROUP BY ALL)"""


def _trajectory(spark, d):
    """Leads of five spots: every profile is a spot's column at a lead; every pixel lies around a spot."""
    columns = profiles(spark, d).select((F.col("node") % 5).alias("spot"), F.floor(F.col("node") / 5).alias("lead"), "depths", "temps")
    patches = pixels(spark, d).select((F.col("row") % 5).alias("spot"), "depth", ((F.col("row") * 7 + F.col("col") * 3) % 100).alias("dist"))
    return ops.trajectory(columns, patches, 10.0, 1.5, (3.31, 1.51, 5.55), 60, 22, 10.0)


@query("ARR-08", f"WITH {_TRAJECTORY} SELECT spot, lead, round(iso, 6) AS iso, round(shallow, 6) AS shallow, round(deep, 6) AS deep, round(gradient, 6) AS gradient, reach, nearest, area, certain, possible FROM tj")
def arr08(spark, d):
    return _rounded(_trajectory(spark, d), "iso", "shallow", "deep", "gradient")


@query("ARR-08-windows", f"WITH {_TRAJECTORY}, z AS (SELECT *, lead - row_number() OVER (PARTITION BY spot ORDER BY lead) AS island FROM tj WHERE reach) SELECT spot, min(lead) AS first_lead, max(lead) AS last_lead, count(*) AS n, bool_and(certain) AS certain FROM z GROUP BY spot, island")
def arr08_windows(spark, d):
    return ops.reach_windows(_trajectory(spark, d))


# ------------------------------------------------------------------------------- in-situ report


@query("AGG-46", f"""WITH {TEMPS}, b AS (SELECT station, us, (event_id % 7 // 3)::DOUBLE AS depth, temp_c + event_id % 3 * 0.5::DOUBLE AS temp, temp_c FROM temps), nd AS (SELECT station, depth, count(*) AS n FROM b GROUP BY ALL), md AS (SELECT station, arg_min(depth, (-n, depth)) AS depth FROM nd GROUP BY station),
o AS (SELECT b.station, us // {6 * HOUR_US} AS slot, avg(temp) AS o FROM b JOIN md ON b.station = md.station AND b.depth = md.depth WHERE month(make_timestamp(us)) * 100 + day(make_timestamp(us)) BETWEEN 103 AND 128 GROUP BY ALL), m AS (SELECT station, us // {6 * HOUR_US} AS slot, avg(temp_c) AS m FROM b GROUP BY ALL),
p AS (SELECT station, slot, m, o, slot // 4 AS day, row_number() OVER w > floor(count(*) OVER (PARTITION BY station) * 0.6) AS late, count(*) OVER c >= 10 AS ok, avg(m) OVER c AS mc, avg(o) OVER c AS oc FROM m JOIN o USING (station, slot) WINDOW w AS (PARTITION BY station ORDER BY slot), c AS (PARTITION BY station ORDER BY slot ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)),
j AS (SELECT *, CASE WHEN ok THEN m - mc END AS ma, CASE WHEN ok THEN o - oc END AS oa, (day - min(day) OVER (PARTITION BY station)) // 30 AS month FROM p),
s AS (SELECT station, count(*) AS n, avg(abs(m - o)) AS mae, avg(m - o) AS bias, sqrt(avg((m - o) * (m - o))) AS rmse, corr(m, o) AS r, corr(ma, oa) AS anomaly_r, avg(abs(oa)) AS clim_mae, 1 - avg(abs(ma - oa)) / avg(abs(oa)) AS skill, avg(o - m) FILTER (NOT late) AS offset_c, avg(abs(m - o)) FILTER (late) AS late_mae FROM j GROUP BY station),
l AS (SELECT station, avg(abs(m - o + offset_c)) AS lc FROM j JOIN s USING (station) WHERE late GROUP BY station), dd AS (SELECT station, avg(abs(m - o)) AS daily_mae FROM (SELECT station, day, avg(m) AS m, avg(o) AS o FROM j GROUP BY ALL) GROUP BY station), mm AS (SELECT station, avg(abs(m - o)) AS monthly_mae FROM (SELECT station, month, avg(m) AS m, avg(o) AS o FROM j GROUP BY ALL) GROUP BY station)
SELECT station, n, round(mae, 6) AS mae, round(bias, 6) + 0.0 AS bias, round(rmse, 6) AS rmse, round(r, 6) AS r, round(anomaly_r, 6) AS anomaly_r, round(clim_mae, 6) AS clim_mae, round(skill, 6) + 0.0 AS skill, round(offset_c, 6) + 0.0 AS "offset", round(late_mae, 6) AS late_mae, round(lc, 6) AS late_corrected_mae, round(daily_mae, 6) AS daily_mae, round(monthly_mae, 6) AS monthly_mae FROM s LEFT JOIN l USING (station) JOIN dd USING (station) JOIN mm USING (station)""")
def agg46(spark, d):
    t = temps(spark, d)
    truth = ops.modal_six_hours(t.select("station", "us", F.floor(F.col("event_id") % 7 / 3).cast("double").alias("depth"), (F.col("temp_c") + F.col("event_id") % 3 * 0.5).alias("temp")), 103, 128)
    model = t.groupBy("station", F.floor(F.col("us") / (6 * HOUR_US)).alias("slot")).agg(F.avg("temp_c").alias("temp"))
    out = ops.in_situ(model, truth, window=20)
    return _rounded(out, *[c for c in out.columns if c not in ("station", "n")])


# ------------------------------------------------------------------------------- scorecard


def _episodes(name: str, drop: float, persist_h: float, where: str, src: str = "temps", window: int = DAY_US) -> str:
    """CTE ``name`` (station, day): first days of the episodes of sustained drops."""
    return f"""{name}_t AS (SELECT *, max(temp_c) OVER (PARTITION BY station ORDER BY us RANGE BETWEEN {window} PRECEDING AND CURRENT ROW) - temp_c >= {drop} AS active FROM {src} WHERE {where}), {name}_c AS (SELECT *, (active AND NOT coalesce(lag(active) OVER (PARTITION BY station ORDER BY us, event_id), FALSE))::INT AS c FROM {name}_t), {name}_i AS (SELECT *, sum(c) OVER (PARTITION BY station ORDER BY us, event_id) AS island FROM {name}_c),
{name}_o AS (SELECT DISTINCT station, us // {DAY_US} AS day FROM (SELECT station, min(us) AS us FROM {name}_i WHERE active GROUP BY station, island HAVING max(us) - min(us) >= {persist_h} * {HOUR_US})), {name}_n AS (SELECT *, coalesce((day - lag(day) OVER (PARTITION BY station ORDER BY day) > 1)::INT, 1) AS new FROM {name}_o), {name}_e AS (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY day) AS e FROM {name}_n), {name} AS (SELECT station, min(day) AS day FROM {name}_e GROUP BY station, e)"""


_TUNE, _HELD = f"us // {DAY_US} < {SPLIT_DAY}", f"us // {DAY_US} >= {SPLIT_DAY}"
_SETTINGS = (1.0, 2.0, 4.0)


@query("AGG-50-tune", f"WITH {TEMPS}, {', '.join(_episodes(f'e{i}', 4.0, h, _TUNE) for i, h in enumerate(_SETTINGS))}, a AS ({' UNION ALL '.join(f'SELECT {h}::DOUBLE AS persist_h, station FROM e{i}' for i, h in enumerate(_SETTINGS))}), s AS (SELECT DISTINCT station, unnest([1.0::DOUBLE, 2.0, 4.0]) AS persist_h FROM temps WHERE {_TUNE}) SELECT s.station, s.persist_h, count(a.station) AS n FROM s LEFT JOIN a USING (station, persist_h) GROUP BY ALL")
def agg50_tune(spark, d):
    return ops.episode_counts(temps(spark, d).where(F.floor(F.col("us") / DAY_US) < SPLIT_DAY), 4.0, list(_SETTINGS))


# episodes start at least two days apart, so with a tolerance of one day only the day before can be taken already
@query("AGG-50", f"""WITH RECURSIVE {TEMPS}, tt AS (SELECT event_id, station, us + length(station) * 9 * {HOUR_US} AS us, CASE WHEN us // {DAY_US} % 5 <> 0 THEN temp_c END AS temp_c FROM temps), {_episodes('tru', 3.0, 1.0, _HELD, 'tt')}, {_episodes('det', 4.0, 2.0, _HELD)},
q AS (SELECT t.station, t.day, row_number() OVER (PARTITION BY t.station ORDER BY t.day) AS k, e.day IS NOT NULL AS same, b.day IS NOT NULL AS before, a.day IS NOT NULL AS after FROM tru t LEFT JOIN det e ON e.station = t.station AND e.day = t.day LEFT JOIN det b ON b.station = t.station AND b.day = t.day - 1 LEFT JOIN det a ON a.station = t.station AND a.day = t.day + 1),
g(station, k, used, hit) AS (SELECT DISTINCT station, 0::BIGINT, -9::BIGINT, 0 FROM q UNION ALL SELECT q.station, q.k, CASE WHEN same THEN q.day WHEN before AND used <> q.day - 1 THEN q.day - 1 WHEN after THEN q.day + 1 ELSE used END, (same OR after OR (before AND used <> q.day - 1))::INT FROM g JOIN q ON q.station = g.station AND q.k = g.k + 1),
h AS (SELECT station, sum(hit) AS hits FROM g GROUP BY station), nt AS (SELECT station, count(*) AS nt FROM tru GROUP BY station), nd AS (SELECT station, count(*) AS nd FROM det GROUP BY station),
p AS (SELECT coalesce(nt, 0) AS nt, coalesce(nd, 0) AS nd, coalesce(hits, 0) AS hits FROM nt FULL JOIN nd USING (station) LEFT JOIN h USING (station)), s AS (SELECT coalesce(sum(hits), 0)::BIGINT AS hits, coalesce(sum(nt), 0)::BIGINT AS nt, coalesce(sum(nd), 0)::BIGINT AS nd, sum(nt * (1 - pow(1 - 3 / 107.0::DOUBLE, nd))) AS luck FROM p)
SELECT hits, nt - hits AS misses, nd - hits AS false_alarms, round(hits / nullif(nt, 0)::DOUBLE, 6) AS pod, round((nd - hits) / nullif(nd, 0)::DOUBLE, 6) AS far, round(luck / nullif(nt, 0), 6) AS chance_pod FROM s""")
def agg50(spark, d):
    held = F.floor(F.col("us") / DAY_US) >= SPLIT_DAY
    t = temps(spark, d)
    late = t.withColumn("temp_c", F.when(F.floor(F.col("us") / DAY_US) % 5 != 0, F.col("temp_c"))).withColumn("us", F.col("us") + F.length("station") * 9 * HOUR_US)  # a second witness, with gaps
    return _rounded(ops.scorecard(ops.onset_episodes(late.where(held), 3.0, 1.0), ops.onset_episodes(t.where(held), 4.0, 2.0), 107), "pod", "far", "chance_pod")


_MATCHED = """q AS (SELECT t.station, t.day, row_number() OVER (PARTITION BY t.station ORDER BY t.day) AS k, e.day IS NOT NULL AS same, b.day IS NOT NULL AS before, a.day IS NOT NULL AS after FROM tru t LEFT JOIN det e ON e.station = t.station AND e.day = t.day LEFT JOIN det b ON b.station = t.station AND b.day = t.day - 1 LEFT JOIN det a ON a.station = t.station AND a.day = t.day + 1),
g(station, k, used, hit) AS (SELECT DISTINCT station, 0::BIGINT, -9::BIGINT, 0 FROM q UNION ALL SELECT q.station, q.k, CASE WHEN same THEN q.day WHEN before AND used <> q.day - 1 THEN q.day - 1 WHEN after THEN q.day + 1 ELSE used END, (same OR after OR (before AND used <> q.day - 1))::INT FROM g JOIN q ON q.station = g.station AND q.k = g.k + 1),
h AS (SELECT station, sum(hit) AS hits FROM g GROUP BY station), nt AS (SELECT station, count(*) AS nt FROM tru GROUP BY station), nd AS (SELECT station, count(*) AS nd FROM det GROUP BY station),
p AS (SELECT station, coalesce(nt, 0) AS nt, coalesce(nd, 0) AS nd, coalesce(hits, 0)::BIGINT AS hits FROM nt FULL JOIN nd USING (station) LEFT JOIN h USING (station))"""


@query("AGG-46-events", f"""WITH RECURSIVE {TEMPS}, b AS (SELECT station, us, (event_id % 7 // 3)::DOUBLE AS depth, temp_c + event_id % 3 * 0.5::DOUBLE AS temp, temp_c FROM temps), nd0 AS (SELECT station, depth, count(*) AS n FROM b GROUP BY ALL), md AS (SELECT station, arg_min(depth, (-n, depth)) AS depth FROM nd0 GROUP BY station),
o AS (SELECT b.station, us // {6 * HOUR_US} AS slot, avg(temp) AS o FROM b JOIN md ON b.station = md.station AND b.depth = md.depth WHERE month(make_timestamp(us)) * 100 + day(make_timestamp(us)) BETWEEN 103 AND 128 GROUP BY ALL), m AS (SELECT station, us // {6 * HOUR_US} AS slot, avg(temp_c) AS m FROM b GROUP BY ALL),
jo AS (SELECT slot AS event_id, station, slot * {6 * HOUR_US} AS us, round(o, 9) AS temp_c FROM m JOIN o USING (station, slot)), jm AS (SELECT slot AS event_id, station, slot * {6 * HOUR_US} AS us, round(m, 9) AS temp_c FROM m JOIN o USING (station, slot)), {_episodes('tru', 3.0, 6.0, 'true', 'jo', 2 * DAY_US)}, {_episodes('det', 3.0, 6.0, 'true', 'jm', 2 * DAY_US)}, {_MATCHED}
SELECT station, hits, nt - hits AS misses, nd - hits AS false_alarms, round(hits / nullif(nt, 0)::DOUBLE, 6) AS pod, round((nd - hits) / nullif(nd, 0)::DOUBLE, 6) AS far FROM p""")
def agg46_events(spark, d):
    t = temps(spark, d)
    rounded = lambda df: df.withColumn("temp", F.round("temp", 9))  # noqa: E731  (means of both engines alike)
    truth = ops.modal_six_hours(t.select("station", "us", F.floor(F.col("event_id") % 7 / 3).cast("double").alias("depth"), (F.col("temp_c") + F.col("event_id") % 3 * 0.5).alias("temp")), 103, 128)
    model = t.groupBy("station", F.floor(F.col("us") / (6 * HOUR_US)).alias("slot")).agg(F.avg("temp_c").alias("temp"))
    return _rounded(ops.in_situ_events(rounded(model), rounded(truth), 3.0, 6.0), "pod", "far")


@query("AGG-50-wind", f"WITH {READINGS}, {TEMPS}, {DRIVE}, dr AS (SELECT station AS ds, us AS dus, drive FROM drive), t AS (SELECT t.station, temp_c, drive FROM temps t ASOF JOIN dr ON t.station = dr.ds AND t.us >= dr.dus) SELECT station, count(*) AS n, round(corr(drive, temp_c), 6) AS r FROM t GROUP BY station")
def agg50_wind(spark, d):
    return _rounded(ops.wind_agreement(temps(spark, d), readings(spark, d), DAY_US), "r")


# ------------------------------------------------------------------------------- bends, rays, grids

#: Arcs of alternating sides: 16 stations of 10 m along the chord, 64 m high.
_BENDY = "b AS (SELECT river, idx, dist_m, 20 + (width - 10) / 2 AS width, (idx * 10)::DOUBLE AS x, (idx % 16 * (16 - idx % 16) * CASE WHEN idx % 32 < 16 THEN 1 ELSE -1 END)::DOUBLE AS y FROM river)"


@query("W-20", f"""WITH {RIVER}, {_BENDY}, nb AS (SELECT b.river, b.idx, o.x - b.x AS u, o.y - b.y AS v, pow(o.x - b.x, 2) + pow(o.y - b.y, 2) AS q FROM b JOIN b o ON o.river = b.river AND o.idx BETWEEN b.idx - 8 AND b.idx + 8 WHERE pow(o.x - b.x, 2) + pow(o.y - b.y, 2) <= pow(2 * b.width, 2)),
m AS (SELECT river, idx, count(*) AS n, avg(u) AS u, avg(v) AS v, avg(q) AS q, var_pop(u) AS uu, var_pop(v) AS vv, covar_pop(u, v) AS uv, covar_pop(u, q) AS uq, covar_pop(v, q) AS vq FROM nb GROUP BY ALL), c AS (SELECT *, (uq * vv - vq * uv) / (2 * (uu * vv - uv * uv)) AS a, (vq * uu - uq * uv) / (2 * (uu * vv - uv * uv)) AS b FROM m WHERE n >= 4 AND 2 * n * n * (uu * vv - uv * uv) > 1e-9),
r AS (SELECT river, idx, sqrt(q - 2 * a * u - 2 * b * v + a * a + b * b) AS radius FROM c),
t AS (SELECT *, x - lag(x, 2) OVER w AS ax, y - lag(y, 2) OVER w AS ay, lead(x, 2) OVER w - x AS bx, lead(y, 2) OVER w - y AS by_ FROM b WINDOW w AS (PARTITION BY river ORDER BY idx)),
h AS (SELECT river, idx, dist_m, width, radius, radius / width AS rw, CASE WHEN ax * by_ - ay * bx > 0 THEN 'right' ELSE 'left' END AS side FROM t JOIN r USING (river, idx) WHERE radius / width <= 4 AND ax * ax + ay * ay > 1 AND bx * bx + by_ * by_ > 1),
n AS (SELECT *, coalesce((idx - lag(idx) OVER w > 2 OR side <> lag(side) OVER w)::INT, 1) AS new FROM h WINDOW w AS (PARTITION BY river ORDER BY idx)), g AS (SELECT *, sum(new) OVER (PARTITION BY river ORDER BY idx) AS g FROM n),
z AS (SELECT river, side, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx, max(dist_m) - min(dist_m) AS extent_m, arg_min(idx, (round(rw, 9), idx)) AS idx, arg_min(radius, (round(rw, 9), idx)) AS radius, arg_min(rw, (round(rw, 9), idx)) AS rw, arg_min(width, (round(rw, 9), idx)) AS width FROM g GROUP BY river, g, side)
SELECT river, side, n, first_idx, last_idx, extent_m, idx, round(radius, 4) AS radius, round(rw, 4) AS rw FROM z WHERE n >= 3 AND extent_m >= 0.5 * width""")
def w20(spark, d):
    i = F.col("idx") % 16
    b = river(spark, d).select("river", "idx", "dist_m", (F.lit(20) + (F.col("width") - 10) / 2).alias("width"), (F.col("idx") * 10).cast("double").alias("x"), (i * (16 - i) * F.when(F.col("idx") % 32 < 16, 1).otherwise(-1)).cast("double").alias("y"))
    return spatial.bends(b, "x", "y").withColumns({c: F.round(c, 4) for c in ("radius", "rw")})


_SPOTS = "spots AS (SELECT s_suppkey AS spot, s_suppkey * 7 % 40 AS row, s_suppkey * 13 % 50 AS col, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey * 37 % 360 END AS hint FROM supplier)"


def _spots(spark, d):
    k = F.col("s_suppkey")
    return load(spark, d, "supplier").select(k.alias("spot"), (k * 7 % 40).alias("row"), (k * 13 % 50).alias("col"), F.when(k % 3 != 0, k * 37 % 360).alias("hint"))


_BEARING = f"""{_SPOTS}, bx AS (SELECT spot, p.row, p.col, depth FROM spots s JOIN pixels p ON p.row BETWEEN s.row - 8 AND s.row + 8 AND p.col BETWEEN s.col - 8 AND s.col + 8 WHERE depth IS NOT NULL), e AS (SELECT a.spot, sum(b.depth - a.depth) AS east FROM bx a JOIN bx b ON a.spot = b.spot AND a.row = b.row AND b.col = a.col + 1 GROUP BY ALL), n AS (SELECT a.spot, -sum(b.depth - a.depth) AS north FROM bx a JOIN bx b ON a.spot = b.spot AND a.col = b.col AND b.row = a.row + 1 GROUP BY ALL),
f AS (SELECT s.*, CASE WHEN abs(coalesce(east, 0)) > 1e-9 OR abs(coalesce(north, 0)) > 1e-9 THEN (degrees(atan2(coalesce(east, 0), coalesce(north, 0))) + 360) % 360 END AS found FROM spots s LEFT JOIN e USING (spot) LEFT JOIN n USING (spot)),
br AS (SELECT *, CASE WHEN hint IS NULL OR abs((found - hint + 540) % 360 - 180) <= 60 THEN found ELSE hint::DOUBLE END AS bearing FROM f)"""


@query("RAS-12", f"WITH {PIXELS}, {_BEARING} SELECT spot, round(bearing, 6) AS bearing FROM br")
def ras12(spark, d):
    return spatial.offshore_bearing(pixels(spark, d), _spots(spark, d)).withColumn("bearing", F.round("bearing", 6))


@query("RAS-12-rays", f"WITH {PIXELS}, {_SPOTS}, k AS (SELECT spot, k, round_even(row - cos(radians(coalesce(hint, 45))) * k * 1.5, 0)::BIGINT AS row, round_even(col + sin(radians(coalesce(hint, 45))) * k * 1.5, 0)::BIGINT AS col FROM spots, (SELECT unnest(range(0, 13)) AS k)) SELECT spot, k, depth FROM k LEFT JOIN pixels USING (row, col)")
def ras12_rays(spark, d):
    spots = _spots(spark, d).withColumn("bearing", F.coalesce("hint", F.lit(45)).cast("double"))
    return spatial.rays(pixels(spark, d), spots, 12, 1.5)


_NODES_XY = "nd AS (SELECT s_suppkey AS node, s_suppkey * 37 % 50 AS x, s_suppkey * 11 % 40 AS y, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 30)::DOUBLE END AS v FROM supplier)"


@query("RAS-11", f"WITH {PIXELS}, {_NODES_XY}, nr AS (SELECT row, col, v, pow(x - col, 2) + pow(y - row, 2) AS d2, row_number() OVER (PARTITION BY row, col ORDER BY pow(x - col, 2) + pow(y - row, 2), node) AS k FROM pixels JOIN nd ON pow(x - col, 2) + pow(y - row, 2) <= 36), f AS (SELECT row, col, CASE WHEN avg((v IS NULL)::INT) > 0.5 THEN 999 ELSE sum(v / (d2 + 1e-6)) / (sum(1 / (d2 + 1e-6)) FILTER (v IS NOT NULL)) END AS v FROM nr WHERE k <= 4 GROUP BY ALL) SELECT row, col, round(v, 6) AS v FROM pixels LEFT JOIN f USING (row, col)")
def ras11(spark, d):
    k = F.col("s_suppkey")
    n = load(spark, d, "supplier").select(k.alias("node"), (k * 37 % 50).alias("x"), (k * 11 % 40).alias("y"), F.when(k % 3 != 0, (k % 30).cast("double")).alias("v"))
    grid = pixels(spark, d).select("row", "col", F.col("col").alias("x"), F.col("row").alias("y"))
    return spatial.scattered(grid, n, 6).withColumn("v", F.round("v", 6))


@query("SRC-17", f"WITH {NODES} SELECT 'n' || node AS id, round(lat, 6) AS lat, round(lon, 6) AS lon, 2::BIGINT AS n_depths, depth AS deepest, CASE WHEN node % 2 = 0 THEN 8.5::DOUBLE END AS trout_low, (19875 + node % 30)::BIGINT AS first_day FROM nodes WHERE node % 10 <> 0")
def src17(spark, d):
    path = new_path(spark, "stations")
    k = F.col("node")
    bands = F.when(k % 2 == 0, F.create_map(F.lit("trout"), F.struct(F.lit(8.5).alias("low"), F.lit(13.0).alias("high"))))
    split = F.struct(F.date_add(F.lit("2024-06-01").cast("date"), (k % 30).cast("int")).alias("first"))
    rows = nodes(spark, d).select(F.concat(F.lit("n"), k.cast("string")).alias("id"), F.when(k % 10 != 0, F.struct("lat", "lon")).alias("position"), F.array(F.lit(0.0), F.col("depth")).alias("depths_m"), bands.alias("bands"), split.alias("split"))
    rows.write.json(path)
    s = landed.stations(spark, path)
    return s.select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.size("depths_m").cast("long").alias("n_depths"), F.element_at("depths_m", -1).alias("deepest"), F.col("bands")["trout"]["low"].alias("trout_low"), F.unix_date("first").cast("long").alias("first_day"))

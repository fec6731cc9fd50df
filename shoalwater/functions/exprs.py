"""Column expressions: one definition per concept, used by products and by their gates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Sector and axis of favourable wind, event bar (kt h), plausible water, logistic.
SECTOR = (225.0, 315.0)
AXIS = 270.0
EVENT_DRIVE = 13 * 24.0
PLAUSIBLE = (-2.0, 30.0)
FAVOUR_S50, FAVOUR_WIDTH = 13.0, 3.0
EARTH_KM = 6371.0
# Densities, drag and gravity of the tilt number.
RHO_AIR, RHO_WATER, DRAG, G_PRIME, KN_TO_MS = 1.2, 1000.0, 1.3e-3, 0.0147, 0.514444


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """NaN as null, so that it poisons no maximum and no correlation."""
    return F.nanvl(_c(x), F.lit(None).cast("double"))


def in_sector(direction, sector=SECTOR) -> Column:
    """Direction within [lo, hi], wrapping where lo > hi; null is false."""
    lo, hi = (float(x) for x in sector)
    d = F.pmod(_c(direction), F.lit(360.0))
    inside = d.between(lo, hi) if lo <= hi else (d >= lo) | (d <= hi)
    return F.coalesce(inside, F.lit(False))


def favourable_component(speed, direction, axis: float = AXIS) -> Column:
    """Signed component along the axis; a null direction counts as 0 only when it is calm."""
    s, d = finite(speed), _c(direction)
    return F.when(s.isNull(), None).when(d.isNull(), F.when(s == 0, F.lit(0.0))).otherwise(s * F.cos(F.radians(d - axis)))


def is_event(drive, bar: float = EVENT_DRIVE) -> Column:
    return finite(drive) >= bar


def plausible(temp, low: float = PLAUSIBLE[0], high: float = PLAUSIBLE[1]) -> Column:
    return _c(temp).between(low, high)


def split_label(day, tune: tuple[int, int], validate: tuple[int, int]) -> Column:
    """'tune', 'validate' or null; both ranges inclusive, and they must not overlap."""
    if tune[0] <= validate[1] and validate[0] <= tune[1]:
        raise ValueError("tune and validate overlap")
    d = _c(day)
    return F.when(d.between(*tune), "tune").when(d.between(*validate), "validate")


def month_day(date) -> Column:
    return F.month(_c(date)) * 100 + F.dayofmonth(_c(date))


def in_annual_window(date, start, end) -> Column:
    """Month and day within [start, end] ('MM-DD' columns); wraps the year; freeze_up is 12-01."""
    number = lambda c: F.regexp_replace(F.when(c == "freeze_up", "12-01").otherwise(c), "-", "").cast("int")
    d, a, z = month_day(date), number(_c(start)), number(_c(end))
    return F.when(a <= z, d.between(a, z)).otherwise((d >= a) | (d <= z))


def season(date) -> Column:
    """(season, weight of the upwelling signal) by month."""
    m = F.month(_c(date))
    row = lambda s, u: F.struct(F.lit(s).alias("season"), F.lit(u).alias("upwelling"))
    return F.when(m.isin(5, 6), row("spring", "minimal")).when(m.isin(7, 8, 9), row("summer", "primary")).when(m.isin(10, 11), row("fall", "secondary")).otherwise(row("winter", "minimal"))


def exposure(x, offset: float, scale: float) -> Column:
    """Corrected wind, never below 0; null and NaN stay null."""
    v = finite(x)
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.lit(offset) + F.lit(scale) * v))


def within_tolerance(d_iso, d_ml, iso_m: float = 8.0, ml_c: float = 4.0) -> Column:
    return F.when((_c(d_iso).isNull() | (F.abs(_c(d_iso)) <= iso_m)) & (F.abs(_c(d_ml)) <= ml_c), "ok").otherwise("DIVERGENT")


def flow_regime(backwater, lo, mid, hi) -> Column:
    return F.when(_c(backwater), "backwater").when(_c(lo).isNull() | _c(mid).isNull() | _c(hi).isNull(), "unknown").when(_c(lo) > 1, "supercritical").when(_c(hi) < 1, "subcritical").otherwise("transitional")


def logistic(speed, s50: float = FAVOUR_S50, width: float = FAVOUR_WIDTH) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(_c(speed) - s50) / width))


def friction_velocity(speed_ms) -> Column:
    """Water-side friction velocity under a wind at 10 m."""
    return F.sqrt(F.lit(RHO_AIR * DRAG) * _c(speed_ms) * _c(speed_ms) / RHO_WATER)


def wedderburn(speed_ms, layer_m, fetch_m: float = 50_000.0, g_prime: float = G_PRIME) -> Column:
    """Tilt number; calm is +infinity; a layer that is not positive is an error."""
    u = friction_velocity(speed_ms)
    h = F.when(_c(layer_m) > 0, _c(layer_m)).otherwise(F.raise_error(F.lit("mixed layer must be positive")).cast("double"))
    return F.when(_c(speed_ms) <= 0, F.lit(float("inf"))).otherwise(F.lit(g_prime) * h * h / (u * u * F.lit(fetch_m)))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    s1, s2 = F.sin((c - a) / 2), F.sin((d - b) / 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(s1 * s1 + F.cos(a) * F.cos(c) * s2 * s2))


def mercator(lat, lon) -> tuple[Column, Column]:
    """EPSG:3857 metres (x, y)."""
    r = F.lit(6378137.0)
    return r * F.radians(_c(lon)), r * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(_c(lat)) / 2))


def from_mercator(x, y) -> tuple[Column, Column]:
    """(lat, lon) of EPSG:3857 metres."""
    r = F.lit(6378137.0)
    return F.degrees(F.lit(2.0) * F.atan(F.exp(_c(y) / r)) - F.lit(1.5707963267948966)), F.degrees(_c(x) / r)


def day_of_year(month, day) -> Column:
    """In the non-leap reference year 2001."""
    return F.dayofyear(F.make_date(F.lit(2001), _c(month), _c(day)))


def row_id(*fields, external=None) -> Column:
    """First 16 hex digits of the sha1 of the fields joined by '|', nulls as 'None'; an external id only if present."""
    text = F.concat_ws("|", *[F.coalesce(_c(f).cast("string"), F.lit("None")) for f in fields])
    if external is not None:
        text = F.concat(text, F.coalesce(F.concat(F.lit("|"), _c(external).cast("string")), F.lit("")))
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def domain(url) -> Column:
    """Host of a URL without scheme, path and a leading www."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(_c(url), "^https?://", ""), "/"), 1), r"^www\.", "")


def compass(direction) -> Column:
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.get(names, (F.floor((F.pmod(_c(direction), F.lit(360.0)) + 22.5) / 45) % 8).cast("int"))

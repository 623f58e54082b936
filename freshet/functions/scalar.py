"""Scalar functions as Column expressions: interpolation, normal quantile and integral, dates, coordinates, quantisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def interp(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear interpolation over ascending xs (arrays); values beyond the ends hold; of equal xs the last counts."""
    n = F.size(F.filter(xs, lambda v: v <= x))
    lo, hi = F.get(xs, n - 1), F.get(xs, n)
    a, b = F.get(ys, n - 1), F.get(ys, n)
    inside = a + (x - lo) / (hi - lo) * (b - a)
    return F.when(x.isNull() | (F.size(xs) == 0), F.lit(None).cast("double")).when(n == 0, F.get(ys, F.lit(0))).when(n == F.size(xs), a).otherwise(inside)


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


# Coefficients of the rational approximations of the normal quantile (Wichura's algorithm AS 241, PPND16).
_A = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3]
_B = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3]
_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
_D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
_E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]


def _poly(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[-1])
    for k in reversed(coefficients[:-1]):
        out = out * x + F.lit(k)
    return out


def _bound(x: Column, body) -> Column:
    """body(x) with x computed once, however often body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def norm_ppf(p: Column) -> Column:
    """Quantile of the standard normal distribution; null outside (0, 1)."""
    ratio = lambda x, top, bottom: _poly(x, top) / _poly(x, bottom)

    def body(v: Column) -> Column:
        q = v - 0.5
        tail = F.sqrt(-F.log(F.least(v, 1 - v)))
        outer = F.when(tail <= 5.0, _bound(tail - 1.6, lambda t: ratio(t, _C, _D))).otherwise(_bound(tail - 5.0, lambda t: ratio(t, _E, _F)))
        inner = q * _bound(F.lit(0.180625) - q * q, lambda t: ratio(t, _A, _B))
        return F.when((v > 0) & (v < 1), F.when(F.abs(q) <= 0.425, inner).otherwise(F.when(q < 0, -outer).otherwise(outer)))

    return _bound(p, body)


def norm_cdf(x: Column) -> Column:
    """Standard normal integral, by the series and the continued fraction of the error function; error under 1e-9."""

    def body(v: Column) -> Column:
        z = F.abs(v)
        square, series, fraction = z * z, F.lit(1.0), z
        for k in range(40, 0, -1):
            series = 1 + square / (2 * k + 1) * series
        for k in range(20, 0, -1):
            fraction = z + k / fraction
        density = F.exp(-square / 2) / math.sqrt(2 * math.pi)
        half = F.when(z < 3.5, 0.5 + density * z * series).otherwise(1 - density / fraction)
        return F.when(v < 0, 1 - half).otherwise(half)

    return _bound(x, body)


def water_year(day: Column) -> Column:
    """Year of a water year, which begins in October; 0 for what is no date."""
    d = F.try_to_date(day.cast("string"), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(day)
    return F.coalesce(F.year(d) + (F.month(d) >= 10).cast("int"), F.lit(0))


def utm_zone_srid(lon: Column, lat: Column) -> Column:
    """EPSG code of the northern NAD83 UTM zone of a place; null in the south."""
    zone = F.least(F.greatest(F.floor((lon + 180) / 6).cast("int") + 1, F.lit(1)), F.lit(60))
    return F.when(lat >= 0, 26900 + zone)


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north of a place in degrees."""
    radius = 6378137.0
    return F.radians(lon) * radius, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * radius


def generic_class(name: Column) -> Column:
    """Generic class of an occupancy code by its prefix; other names stay."""
    # Prefixes of occupancy codes and their classes.
    prefixes = {"RES": "residential", "COM": "commercial", "IND": "industrial", "AGR": "other", "GOV": "other", "EDU": "other", "REL": "other"}
    upper, out = F.upper(F.trim(name)), name
    for prefix, generic in prefixes.items():
        out = F.when(upper.startswith(prefix), F.lit(generic)).otherwise(out)
    return out


def hand_byte(hand: Column) -> Column:
    """Height in decimetres, 0 to 254 and truncated; 255 where there is none."""
    return F.coalesce(F.floor(clip(hand * 10, 0.0, 254.0)).cast("int"), F.lit(255))


def pack_u16(value: Column) -> tuple[Column, Column]:
    """High and low byte; what is missing or negative is 65535."""
    v = F.when(value >= 0, value).otherwise(65535).cast("int")
    v = F.coalesce(v, F.lit(65535))
    return F.shiftright(v, 8), v.bitwiseAND(F.lit(255))


def log_scale(damage: Column, floor: float = 1e3, ceiling: float = 1e8) -> Column:
    """1 to 255 on a logarithmic scale between floor and ceiling, 0 below floor; rounded half to even."""
    span = (F.log10(clip(damage, floor, ceiling)) - math.log10(floor)) / (math.log10(ceiling) - math.log10(floor))
    return F.when(damage >= floor, F.rint(1 + span * 254)).otherwise(0.0).cast("int")


def point_in_ring(x: Column, y: Column, ring: Column, boundary: bool = False) -> Column:
    """Whether a point lies in a ring (array of structs x, y); with boundary, points on an edge count as inside."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + 1) % n).alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    inside = F.aggregate(edges, F.lit(False), lambda s, e: s != F.coalesce(crosses(e), F.lit(False)))
    return inside | F.exists(edges, touches) if boundary else inside & ~F.exists(edges, touches)


def register(spark: SparkSession) -> None:
    """Make the functions of freshet.functions.sql usable from SQL texts."""
    from freshet.functions.sql import register as every

    every(spark)

"""Scalar functions whose meaning differs from the built-in of that name, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088  # fixed value: mean radius


def substring(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """Starts at 1 at least without taking from the length; a negative length is null."""
    start = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(1))
    if length is None:
        return F.substring(s, start, F.greatest(F.length(s), F.lit(0)))
    length = F.lit(length) if isinstance(length, int) else length
    return F.when(length >= 0, F.substring(s, start, F.greatest(length, F.lit(0))))


def substring_match(s: Column, pattern: str) -> Column:
    """The first group of the first match, or the whole match if there is no group; null without a match."""
    group = 1 if "(" in pattern.replace("(?", "").replace("\\(", "") else 0
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def left(s: Column, n: int) -> Column:
    """A negative n leaves out that many at the other end."""
    return F.substring(s, 1, n) if n >= 0 else F.substring(s, F.lit(1), F.greatest(F.length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    if n >= 0:
        return F.right(s, F.lit(n))
    return F.right(s, F.greatest(F.length(s) + n, F.lit(0)))


def quote_literal(s: Column) -> Column:
    body = F.replace(s, F.lit("'"), F.lit("''"))
    return F.when(F.instr(s, "\\") > 0, F.concat(F.lit("E'"), F.replace(body, F.lit("\\"), F.lit("\\\\")), F.lit("'"))).otherwise(F.concat(F.lit("'"), body, F.lit("'")))


def strict_ln(x: Column) -> Column:
    """An error outside the domain instead of null."""
    return F.when(x > 0, F.ln(x)).when(x.isNotNull(), F.raise_error(F.lit("LN of a number that is not positive")).cast("double"))


def strict_sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x)).when(x.isNotNull(), F.raise_error(F.lit("SQRT of a negative number")).cast("double"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees from north, 0 to 360."""
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    y = F.sin(d - b) * F.cos(c)
    x = F.cos(a) * F.sin(c) - F.sin(a) * F.cos(c) * F.cos(d - b)
    return (F.degrees(F.atan2(y, x)) + 360) % 360


def within_polygon(lat: Column, lon: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule over (lat, lon) corners."""
    inside = F.lit(0)
    for (y1, x1), (y2, x2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 != y2:
            crosses = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
            inside = inside + crosses.cast("int")
    return inside % 2 == 1


def money(text: Column) -> Column:
    """``'USD 12.34'``, ``'12.34 USD'`` or with thousands as in ``'1,234.50 USD'`` -> struct(asset, minor, scale); null for any other text."""
    number = r"(-?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?)"
    front, back = rf"^\s*([A-Z]{{3,10}})\s+{number}\s*$", rf"^\s*{number}\s+([A-Z]{{3,10}})\s*$"
    of = lambda a, b: F.when(text.rlike(front), F.regexp_extract(text, front, a)).when(text.rlike(back), F.regexp_extract(text, back, b))
    figure = F.replace(of(2, 1), F.lit(","), F.lit(""))
    scale = F.length(F.regexp_extract(figure, r"\.([0-9]+)", 1))
    whole = F.struct(of(1, 2).alias("asset"), F.replace(figure, F.lit("."), F.lit("")).cast("long").alias("minor"), scale.alias("scale"))
    return F.when(text.rlike(front) | text.rlike(back), whole)


def json_typeof(text: Column) -> Column:
    """object, array, string, number, boolean or null; SQL null for text that is no JSON."""
    first = F.substring(F.trim(text), 1, 1)
    kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")
    return F.when(F.try_parse_json(text).isNotNull(), kind)


def midpoint(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """struct(lat, lon) half way along the great circle."""
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    x, y = F.cos(c) * F.cos(d - b), F.cos(c) * F.sin(d - b)
    lat = F.atan2(F.sin(a) + F.sin(c), F.sqrt(F.pow(F.cos(a) + x, 2) + y * y))
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(b + F.atan2(y, F.cos(a) + x)).alias("lon"))


def destination(lat: Column, lon: Column, degrees: Column, km: Column) -> Column:
    """struct(lat, lon) after ``km`` in a direction."""
    a, b, t, d = F.radians(lat), F.radians(lon), F.radians(degrees), km / EARTH_KM
    to = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    east = F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to))
    return F.struct(F.degrees(to).alias("lat"), F.degrees(b + east).alias("lon"))


def vincenty_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the WGS-84 ellipsoid by Vincenty's inverse formula; spherical where it does not settle."""

    @F.pandas_udf("double")
    def km(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        major, flat = 6378.137, 1 / 298.257223563  # fixed values: WGS-84
        minor = major * (1 - flat)
        a, b, c, d = (np.radians(x.to_numpy(float)) for x in (a, b, c, d))
        u1, u2, far = np.arctan((1 - flat) * np.tan(a)), np.arctan((1 - flat) * np.tan(c)), d - b
        lam, settled = far.copy(), np.zeros(len(far), bool)
        with np.errstate(all="ignore"):
            for _ in range(60):
                sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
                cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
                sigma = np.arctan2(sin_s, cos_s)
                sin_a = np.where(sin_s == 0, 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(sin_s == 0, 1, sin_s))
                cos2_a = 1 - sin_a**2
                mid = np.where(cos2_a == 0, 0, cos_s - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2_a == 0, 1, cos2_a))
                k = flat / 16 * cos2_a * (4 + flat * (4 - 3 * cos2_a))
                new = far + (1 - k) * flat * sin_a * (sigma + k * sin_s * (mid + k * cos_s * (2 * mid**2 - 1)))
                settled = np.abs(new - lam) < 1e-12
                lam = new
                if settled.all():
                    break
            u = cos2_a * (major**2 - minor**2) / minor**2
            p = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            q = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            turn = q * sin_s * (mid + q / 4 * (cos_s * (2 * mid**2 - 1) - q / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
            h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin(far / 2) ** 2
            sphere = 2 * EARTH_KM * np.arcsin(np.minimum(np.sqrt(h), 1))
        return pd.Series(np.where(settled & np.isfinite(lam), minor * p * (sigma - turn), sphere))

    return km(lat1, lon1, lat2, lon2)

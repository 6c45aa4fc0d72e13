"""Lines and outlines as arrays of struct<lon, lat>, worked on with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertlake.functions.geo import KM_LAT, KM_LON, haversine_km
from alertlake.functions.text import bound

LINE = "array<struct<lon:double,lat:double>>"


def _km(a: Column, b: Column) -> Column:
    return haversine_km(a["lat"], a["lon"], b["lat"], b["lon"])


def _point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def spaced(line: Column, spacing_km: float) -> Column:
    """The first point, then each at least `spacing_km` from the last one taken, and the last point."""
    numbered = F.transform(line, lambda p, i: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), i.alias("i")))
    far = lambda acc, p: (F.size(acc) == 0) | (p["i"] == F.size(line) - 1) | (_km(F.element_at(acc, -1), p) >= spacing_km)
    take = lambda acc, p: F.when((F.size(acc) == 0), F.array(_point(p["lon"], p["lat"]))).when(far(acc, p), F.concat(acc, F.array(_point(p["lon"], p["lat"])))).otherwise(acc)
    return F.aggregate(numbered, F.array().cast(LINE), take)


def interior_point(polygon: Column, centre: Column, inside) -> Column:
    """`centre` if it lies in the polygon, else the nearest to it of a 5 x 5 grid over the bounds that does, else `centre`.

    inside: a function (polygon, lon, lat) -> boolean column.
    """
    lons, lats = F.transform(F.flatten(polygon), lambda p: p["lon"]), F.transform(F.flatten(polygon), lambda p: p["lat"])
    box = F.struct(F.array_min(lons).alias("w"), F.array_max(lons).alias("e"), F.array_min(lats).alias("s"), F.array_max(lats).alias("n"))
    steps = F.sequence(F.lit(1), F.lit(5))
    grid = lambda b: F.flatten(F.transform(steps, lambda y: F.transform(steps, lambda x: _point(b["w"] + (b["e"] - b["w"]) * x / 6, b["s"] + (b["n"] - b["s"]) * y / 6))))
    held = bound(box, lambda b: F.filter(grid(b), lambda p: inside(polygon, p["lon"], p["lat"])))
    nearest = F.get(F.array_sort(F.transform(held, lambda p: F.struct(_km(centre, p).alias("km"), p.alias("p")))), 0)["p"]
    own = _point(centre["lon"], centre["lat"])
    return F.when(inside(polygon, centre["lon"], centre["lat"]), own).otherwise(F.coalesce(nearest, own))


def smoothed(line: Column, samples: int = 7, most_handle_km: float = 75.0) -> Column:
    """A curve through all points: a cubic per leg, its handles along the neighbours' direction and no longer than the legs allow."""
    per_lon = KM_LON * F.cos(F.radians(F.aggregate(line, F.lit(0.0), lambda s, p: s + p["lat"]) / F.size(line)))
    last = F.size(line) - 1

    def curve(k: Column) -> Column:
        at = lambda i: F.get(line, F.greatest(F.lit(0), F.least(last, i)))

        def unit(i: Column) -> Column:
            x, y = (at(i + 1)["lon"] - at(i - 1)["lon"]) * k, (at(i + 1)["lat"] - at(i - 1)["lat"]) * KM_LAT
            size = F.sqrt(x * x + y * y)
            return bound(F.struct(x.alias("x"), y.alias("y"), F.when(size == 0, 1.0).otherwise(size).alias("n")), lambda v: F.struct((v["x"] / v["n"]).alias("x"), (v["y"] / v["n"]).alias("y")))

        def leg(i: Column) -> Column:
            a, b = at(i), at(i + 1)
            x, y = (b["lon"] - a["lon"]) * k, (b["lat"] - a["lat"]) * KM_LAT
            km = F.sqrt(x * x + y * y)
            handle = lambda other: F.least(km * 0.30, other * 0.34, F.lit(most_handle_km))
            before, after = F.when(i > 0, _km(at(i - 1), a)).otherwise(km), F.when(i + 1 < last, _km(b, at(i + 2))).otherwise(km)
            parts = F.struct(a.alias("a"), b.alias("b"), unit(i).alias("ta"), unit(i + 1).alias("tb"), handle(before).alias("ha"), handle(after).alias("hb"))

            def sampled(p: Column) -> Column:
                c1 = _point(p["a"]["lon"] + p["ta"]["x"] * p["ha"] / k, p["a"]["lat"] + p["ta"]["y"] * p["ha"] / KM_LAT)
                c2 = _point(p["b"]["lon"] - p["tb"]["x"] * p["hb"] / k, p["b"]["lat"] - p["tb"]["y"] * p["hb"] / KM_LAT)
                mix = lambda c, t: (1 - t) ** 3 * p["a"][c] + 3 * (1 - t) ** 2 * t * c1[c] + 3 * (1 - t) * t * t * c2[c] + t**3 * p["b"][c]
                return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda s: _point(mix("lon", s / samples), mix("lat", s / samples)))

            return bound(parts, sampled)

        return F.concat(F.flatten(F.transform(F.sequence(F.lit(0), last - 1), leg)), F.array(_point(at(last)["lon"], at(last)["lat"])))

    return F.when(F.size(line) < 2, line.cast(LINE)).otherwise(bound(per_lon, curve))

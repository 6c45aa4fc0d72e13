"""Joins and aggregates on shapes. A polygon is array<ring>, a ring array<struct<lon, lat>>, closed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake.functions.geo import KM_LAT, RADIUS_KM, haversine_km, km_per_lon
from alertlake.operators.stage import remove, staged

POLYGON = "array<array<struct<lon:double,lat:double>>>"


def bounds(polygon: Column) -> Column:
    """struct(west, south, east, north)."""
    points = F.flatten(polygon)
    side = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.struct(side(F.array_min, "lon").alias("west"), side(F.array_min, "lat").alias("south"), side(F.array_max, "lon").alias("east"), side(F.array_max, "lat").alias("north"))


def contains_point(polygon: Column, lon: Column, lat: Column) -> Column:
    """Whether a ray from the point crosses the rings an odd number of times; so holes are outside."""

    def crossings(ring: Column) -> Column:
        sides = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ring) - 1)), lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b")))
        a, b = (lambda s: s["a"]), (lambda s: s["b"])
        met = lambda s: ((a(s)["lat"] > lat) != (b(s)["lat"] > lat)) & (lon < (b(s)["lon"] - a(s)["lon"]) * (lat - a(s)["lat"]) / (b(s)["lat"] - a(s)["lat"]) + a(s)["lon"])
        return F.size(F.filter(sides, lambda s: F.coalesce(met(s), F.lit(False))))

    return F.aggregate(F.transform(polygon, crossings), F.lit(0), lambda n, c: n + c) % 2 == 1


FINEST_DEG, BAND_LEVELS = 1 / 1024, 19  # bands of latitude, from the finest by doubling to more than the globe


def _band(lat: Column, level: Column) -> Column:
    return F.floor(lat / (F.lit(FINEST_DEG) * F.pow(F.lit(2.0), level))).cast("long")


def _east(lon: Column, wraps: Column) -> Column:
    """Longitude for shapes across the date line: from 0 to 360."""
    return F.when(wraps & (lon < 0), lon + 360).otherwise(lon)


def edges_in_bands(shapes: DataFrame) -> DataFrame:
    """(shape, rank, region, polygon) -> an edge a row: shape, wraps, x1, y1, x2, y2, and the bands of latitude that it lies in.

    The level of its bands is the least with bands as high as the edge, so it lies in two at
    most. `wraps` tells shapes with an edge across the date line; their longitudes go on past 180.
    """
    point = lambda i: F.get("ring", F.col("i") + i)
    rings = shapes.select("shape", F.explode("polygon").alias("ring")).where(F.size("ring") > 1)
    edges = rings.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("ring") - 2))).select("shape", point(0)["lon"].alias("x1"), point(0)["lat"].alias("y1"), point(1)["lon"].alias("x2"), point(1)["lat"].alias("y2"))
    wraps = edges.groupBy("shape").agg(F.bool_or(F.abs(F.col("x1") - F.col("x2")) > 180).alias("wraps"))
    level = F.least(F.lit(BAND_LEVELS - 1), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(FINEST_DEG), F.abs(F.col("y1") - F.col("y2"))) / FINEST_DEG)))).cast("int")
    out = edges.join(wraps, "shape").withColumns({"x1": _east(F.col("x1"), F.col("wraps")), "x2": _east(F.col("x2"), F.col("wraps")), "level": level})
    return out.withColumn("band", F.explode(F.sequence(_band(F.least("y1", "y2"), F.col("level")), _band(F.greatest("y1", "y2"), F.col("level")))))


def holders(points: DataFrame, shapes: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """(lon, lat, shape, rank, region) for each different place of points (lon, lat, ...) and each shape (rank, region, polygon) that holds it.

    Points meet the bounds of shapes by an equi-join on grid cells, and a shape whose bounds
    hold a point meets it by those edges only that lie in the point's band of latitude: a ray
    east from it is inside where it crosses an odd number of them. An edge is kept once or
    twice, whatever the size of its shape; no shape is copied, and none is put together in a
    task. Shapes may have holes and may lie across the date line.
    """
    cell = lambda c: F.floor(c / cell_deg).cast("int")
    named = shapes.select("rank", "region", "polygon", F.xxhash64("rank", "region", "polygon").alias("shape"))
    own = named.groupBy("shape").agg(F.min("rank").alias("rank"), F.first("region").alias("region"), F.first("polygon").alias("polygon"))
    edges = staged(edges_in_bands(own), "edges-in-bands")
    boxes = edges.groupBy("shape").agg(F.first("wraps").alias("wraps"), F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"), F.min(F.least("y1", "y2")).alias("south"), F.max(F.greatest("y1", "y2")).alias("north"))
    boxes = boxes.join(own.select("shape", "rank", "region"), "shape")
    dealt = boxes.withColumn("cx", F.explode(F.sequence(cell(F.col("west")), cell(F.col("east"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("south")), cell(F.col("north")))))
    sites = points.select("lon", "lat").where("lon is not null and lat is not null").distinct()
    # A point is looked for at its longitude and, for shapes across the date line, past 180.
    sides = F.explode(F.array(F.struct(F.col("lon").alias("x"), F.lit(False).alias("wraps")), F.struct(_east(F.col("lon"), F.lit(True)).alias("x"), F.lit(True).alias("wraps"))))
    keyed = sites.withColumn("s", sides).select("lon", "lat", "s.*").withColumns({"cx": cell(F.col("x")), "cy": cell(F.col("lat"))})
    met = keyed.join(dealt, ["cx", "cy", "wraps"]).where(F.col("x").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north")))
    levels = F.array(*(F.lit(r[0]) for r in edges.select("level").distinct().collect())).cast("array<int>")  # BAND_LEVELS numbers at most
    asked = met.select("shape", "rank", "region", "lon", "lat", "x", F.explode(levels).alias("level")).withColumn("band", _band(F.col("lat"), F.col("level")))
    spans = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    right = F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    crossed = asked.join(edges.select("shape", "level", "band", "x1", "y1", "x2", "y2"), ["shape", "level", "band"]).where(spans & right)
    return crossed.groupBy("lon", "lat", "shape").agg(F.count("*").alias("n"), F.first("rank").alias("rank"), F.first("region").alias("region")).where("n % 2 = 1").drop("n")


def locate(points: DataFrame, shapes: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """points (lon, lat, ...) joined to the first shape (rank, region, polygon) that holds each; none: null region."""
    of = holders(points, shapes, cell_deg).groupBy("lon", "lat").agg(F.min_by("region", F.struct("rank", "shape")).alias("region"))
    return points.join(of, ["lon", "lat"], "left")


def _cells(rows: DataFrame, p: str, level: Column) -> DataFrame:
    """rows (<p>x1, <p>y1, <p>x2, <p>y2) in the cells of `level` that their bounds touch, and the first of these cells."""
    rows = rows.withColumn("level", level)
    ends = {f"{p}{side}{c}": _band(f(f"{p}{c}1", f"{p}{c}2"), F.col("level")) for c in "xy" for side, f in (("lo", F.least), ("hi", F.greatest))}
    rows = rows.withColumns(ends)
    for c in "xy":
        rows = rows.withColumn(f"c{c}", F.explode(F.sequence(f"{p}lo{c}", f"{p}hi{c}"))).drop(f"{p}hi{c}")
    return rows


def _level(p: str) -> Column:
    """The least level whose cells are as large as a segment, so it lies in four at most."""
    size = F.greatest(F.lit(FINEST_DEG), F.abs(F.col(f"{p}x1") - F.col(f"{p}x2")), F.abs(F.col(f"{p}y1") - F.col(f"{p}y2")))
    return F.least(F.lit(BAND_LEVELS - 1), F.ceil(F.log2(size / FINEST_DEG))).cast("int")


def cut_at_edges(lines: DataFrame, shapes: DataFrame) -> DataFrame:
    """The pieces of straight lines (line_id, lon1, lat1, lon2, lat2) inside and outside of each region (rank, region, polygon) that they meet.

    One row per piece: line_id, region, piece (from 1), since and until (shares of the line, the
    first from 0 and the last to 1) and inside. A line that no part of a region holds or
    crosses has no row for it; where an edge is only touched nothing is cut. Cuts within a
    billionth of the line are one. A line with a null is left out; line_id tells lines apart.
    Lines don't go across the date line.

    A line meets an edge in the cells of the larger one's size, at the first cell that they
    share. So long lines don't spread over small cells, nor long edges; nothing is compared
    with all. Which pieces are inside is asked of their middles.
    """
    ways = lines.select("line_id", *(F.col(a).cast("double").alias(b) for a, b in (("lon1", "l_x1"), ("lat1", "l_y1"), ("lon2", "l_x2"), ("lat2", "l_y2")))).dropna()
    ways = staged(ways.withColumn("l_level", _level("l_")), "ways")
    point = lambda i: F.get("ring", F.col("i") + i)
    rings = shapes.select("region", F.explode("polygon").alias("ring")).where(F.size("ring") > 1).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("ring") - 2)))
    edges = rings.select("region", *(point(i)[a].alias(f"e_{b}{i + 1}") for i in (0, 1) for a, b in (("lon", "x"), ("lat", "y"))))
    edges = staged(edges.withColumn("e_level", _level("e_")), "edges")
    levels = lambda df, c: F.array(*(F.lit(r[0]) for r in df.select(c).distinct().collect())).cast("array<int>")  # noqa: E731  # BAND_LEVELS numbers at most
    lifted_edges = edges.withColumn("at", F.explode(F.filter(levels(ways, "l_level"), lambda v: v >= F.col("e_level"))))
    lifted_ways = ways.withColumn("at", F.explode(F.filter(levels(edges, "e_level"), lambda v: v > F.col("l_level"))))
    on = ["level", "cx", "cy"]
    met = _cells(ways, "l_", F.col("l_level")).join(_cells(lifted_edges, "e_", F.col("at")).drop("at"), on)
    met = met.unionByName(_cells(lifted_ways, "l_", F.col("at")).drop("at").join(_cells(edges, "e_", F.col("e_level")), on))
    met = met.where((F.col("cx") == F.greatest("l_lox", "e_lox")) & (F.col("cy") == F.greatest("l_loy", "e_loy")))
    dx, dy, ex, ey = (F.col(f"{p}{c}2") - F.col(f"{p}{c}1") for p in ("l_", "e_") for c in "xy")
    side = lambda i: dx * (F.col(f"e_y{i}") - F.col("l_y1")) - dy * (F.col(f"e_x{i}") - F.col("l_x1"))
    share = F.try_divide((F.col("e_x1") - F.col("l_x1")) * ey - (F.col("e_y1") - F.col("l_y1")) * ex, dx * ey - dy * ex)
    cuts = met.where((side(1) > 0) != (side(2) > 0)).select("line_id", "region", F.round(share, 9).alias("until")).where("until > 0 and until < 1").distinct()
    cuts = staged(cuts, "cuts")
    pairs = cuts.select("line_id", "region").distinct()
    ends = cuts.unionByName(pairs.withColumn("until", F.lit(1.0)))
    pieces = ends.withColumn("since", F.coalesce(F.lag("until").over(Window.partitionBy("line_id", "region").orderBy("until")), F.lit(0.0)))
    middle = (F.col("since") + F.col("until")) / 2
    at = {"lon": F.col("l_x1") + dx * middle, "lat": F.col("l_y1") + dy * middle}
    pieces = staged(pieces.join(ways, "line_id").withColumns(at).select("line_id", "region", "since", "until", "lon", "lat"), "pieces")
    whole = staged(ways.withColumns({"since": F.lit(0.0), "until": F.lit(1.0)}).withColumns(at).select("line_id", "since", "until", "lon", "lat"), "whole-ways")
    held = staged(holders(pieces.select("lon", "lat").union(whole.select("lon", "lat")), shapes).select("lon", "lat", "region", F.lit(True).alias("inside")).distinct(), "held-middles")
    told = pieces.join(held, ["lon", "lat", "region"], "left").select("line_id", "region", "since", "until", F.coalesce("inside", F.lit(False)).alias("inside"))
    uncut = whole.join(held, ["lon", "lat"]).join(pairs, ["line_id", "region"], "left_anti").select("line_id", "region", "since", "until", "inside")
    # Neighbours on the same side are one piece: their edge was touched.
    within = Window.partitionBy("line_id", "region").orderBy("until")
    turned = told.withColumn("turn", (F.col("inside") != F.coalesce(F.lag("inside").over(within), ~F.col("inside"))).cast("int"))
    numbered = turned.withColumn("piece", F.sum("turn").over(within).cast("int"))
    merged = numbered.groupBy("line_id", "region", "piece").agg(F.min("since").alias("since"), F.max("until").alias("until"), F.first("inside").alias("inside"))
    return merged.where("inside or piece > 1 or until < 1").unionByName(uncut.withColumn("piece", F.lit(1)).select(*merged.columns))


def first_entries(lines: DataFrame, pieces: DataFrame) -> DataFrame:
    """(line_id, share, lon, lat): where each line first comes into the land that all regions of its pieces make, from outside of it.

    lines and pieces as for and from cut_at_edges(). A line that begins in the land and never
    comes back into it enters at its start; one that is never in it has no row.
    """
    within = Window.partitionBy("line_id").orderBy("since", "until")
    inside = pieces.where("inside").withColumn("reach", F.max("until").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    begins = inside.where("reach is null or since > reach").groupBy("line_id").agg(F.coalesce(F.min(F.when(F.col("since") > 0, F.col("since"))), F.lit(0.0)).alias("share"))
    at = lambda a, b: (F.col(a) + (F.col(b) - F.col(a)) * F.col("share"))
    return begins.join(lines, "line_id").select("line_id", "share", at("lon1", "lon2").alias("lon"), at("lat1", "lat2").alias("lat"))


def outer_edges(edges: DataFrame, by: list[str], digits: int = 5) -> DataFrame:
    """Edges (by..., lon1, lat1, lon2, lat2) that occur an odd number of times, whichever way round: the outer boundary.

    Edges across the date line and edges of no length are left out.
    """
    point = lambda i: F.struct(F.round(f"lon{i}", digits).alias("lon"), F.round(f"lat{i}", digits).alias("lat"))
    keyed = edges.where("abs(lon1 - lon2) <= 180").select(*by, F.least(point(1), point(2)).alias("a"), F.greatest(point(1), point(2)).alias("b")).where("a <> b")
    odd = keyed.groupBy(*by, "a", "b").agg(F.count("*").alias("n")).where("n % 2 = 1")
    return odd.select(*by, F.col("a.lon").alias("lon1"), F.col("a.lat").alias("lat1"), F.col("b.lon").alias("lon2"), F.col("b.lat").alias("lat2"))


def _run_to_end(going: DataFrame) -> DataFrame:
    """(h, to) -> (h, end, hops, least, ends): where the way from h ends, in how many hops, and the least h on it.

    By pointer doubling: in each round every pointer becomes as long as two, so the rounds are
    the logarithm of the longest way. A way that ends nowhere is a ring (`ends` is false);
    `least` is then that of the ring.
    """
    last = F.col("to").isNull()
    state = staged(going.select("h", F.coalesce("to", "h").alias("end"), F.when(last, 0).otherwise(1).cast("long").alias("hops"), F.col("h").alias("least"), last.alias("ends")), "pointers")
    while True:
        ahead = state.select(F.col("h").alias("end"), F.col("end").alias("on"), F.col("hops").alias("more"), F.col("least").alias("other"), F.col("ends").alias("over"))
        joined = state.join(ahead, "end")
        moved = (F.col("other") < F.col("least")) | (F.col("over") & ~F.col("ends"))
        after = staged(joined.select("h", F.col("on").alias("end"), (F.col("hops") + F.col("more")).alias("hops"), F.least("least", "other").alias("least"), (F.col("ends") | F.col("over")).alias("ends"), moved.alias("moved")), "pointers")
        remove(state)
        state = after.drop("moved")
        if after.where("moved").isEmpty():
            return state


def lines_of_edges(edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges (by..., lon1, lat1, lon2, lat2) put into lines: (by..., line, place, lon1, lat1, lon2, lat2), each edge once, in its line's direction.

    At every node the edges that meet there are paired in the order of their other ends; one
    is left over where their number is odd, and a line ends. So edges make up lines and rings
    in which each has a next one, and list ranking tells every edge its line and its place in
    it: no shape, and no line, passes through one task.
    """
    own = staged(edges.select(*by, "lon1", "lat1", "lon2", "lat2"), "edges").withColumn("e", F.monotonically_increasing_id())
    side = lambda i, j, way: F.struct((F.col("e") * 2 + way).alias("h"), *(F.col(f"{c}{k}").alias(f"{c}{n}") for n, k in ((1, i), (2, j)) for c in ("lon", "lat")))
    halves = staged(own.select(*by, F.explode(F.array(side(1, 2, 0), side(2, 1, 1))).alias("s")).select(*by, "s.*"), "half-edges")
    back = lambda h: h.bitwiseXOR(F.lit(1).cast("long"))
    at_node = Window.partitionBy(*by, "lon2", "lat2").orderBy("lon1", "lat1", "h")
    number = F.row_number().over(at_node)
    partner = F.when(number % 2 == 1, F.lead("h").over(at_node)).otherwise(F.lag("h").over(at_node))
    going = staged(halves.select("h", back(partner).alias("to")), "next-edges")
    first = _run_to_end(going)
    if not first.where(~F.col("ends")).isEmpty():  # rings are opened before their least edge
        ring = first.where(~F.col("ends")).select("h", "least")
        opened = going.join(ring, "h").select("h", F.when(F.col("to") != F.col("least"), F.col("to")).alias("to"))
        first = first.where("ends").unionByName(_run_to_end(opened))
    ranked = staged(halves.join(first.select("h", "end", "hops"), "h"), "ranked-edges")
    # Every line is found both ways; that with the least half-edge is kept.
    lines = ranked.groupBy("end").agg(F.max("hops").alias("longest"), F.min("h").alias("one"), F.min(back(F.col("h"))).alias("other")).where("one < other")
    return ranked.join(lines, "end").select(*by, F.shiftright("one", 1).alias("line"), (F.col("longest") - F.col("hops")).alias("place"), "lon1", "lat1", "lon2", "lat2")


def stitched(edges: DataFrame, by: str) -> DataFrame:
    """(by, line_no, points): the edges of each shape as lines, see lines_of_edges(); a line is a row."""
    point = lambda i: F.struct(F.col(f"lon{i}").alias("lon"), F.col(f"lat{i}").alias("lat"))
    rows = lines_of_edges(edges, [by]).groupBy(by, "line").agg(F.array_sort(F.collect_list(F.struct("place", point(1).alias("a"), point(2).alias("b")))).alias("own"))
    points = F.concat(F.array(F.get("own", 0)["a"]), F.transform("own", lambda s: s["b"]))
    return rows.select(by, (F.row_number().over(Window.partitionBy(by).orderBy("line")) - 1).alias("line_no"), points.alias("points"))


def weighted_centroid(points: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """(by..., lon, lat) averaged with weights; the plain average where all weights are 0."""
    w = F.coalesce(weight, F.lit(0.0))
    of = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * w), F.sum(w)), F.avg(c)).alias(c)
    return points.groupBy(*by).agg(of("lon"), of("lat"))


def seat(points: DataFrame, by: list[str], population: str) -> DataFrame:
    """The place of each group with the largest population; ties go to the least name."""
    best = points.groupBy(*by).agg(F.min_by(F.struct("name", "lon", "lat"), F.struct(-F.col(population), F.col("name"))).alias("s"))
    return best.select(*by, "s.name", "s.lon", "s.lat")


def on_sphere(lon: Column, lat: Column) -> list[Column]:
    """x, y, z of a point on the sphere of radius 1: no date line, and degrees of one size everywhere."""
    return [F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))]


def nearest(points: DataFrame, sites: DataFrame, k: int = 1) -> DataFrame:
    """The k nearest sites (site_id, lon, lat) to each point (point_id, lon, lat): (point_id, site_id, km, rank); ties go to the least site_id.

    Points and sites meet by an equi-join on cubes around the sphere, a point with the 27
    cubes about its own. What lies outside them is farther than a cube's side, so a point
    whose k-th site is nearer than that is done; the others go on with cubes four times as
    wide, until one holds the sphere. Cubes begin finer than sites lie on average, so places
    with many sites are settled while cubes there hold few. Points without coordinates have
    no row; point_id is taken to name one point.
    """
    cube = lambda side: [F.floor(F.col(f"__{c}") / side).cast("int").alias(f"__c{c}") for c in "xyz"]
    placed = lambda df, *cols: df.where("lon is not null and lat is not null").select(*cols, *(v.alias(f"__{c}") for c, v in zip("xyz", on_sphere(F.col("lon"), F.col("lat")), strict=True)))
    s = staged(placed(sites, "site_id", F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat")), "sites")
    side = math.sqrt(math.pi * k / max(1, s.count())) / 4
    left, done = placed(points, "point_id", "lon", "lat"), []
    around = F.expr("explode(flatten(transform(sequence(-1, 1), x -> flatten(transform(sequence(-1, 1), y -> transform(sequence(-1, 1), z -> struct(x, y, z)))))))")
    while True:
        spread = s.select("site_id", "s_lon", "s_lat", *cube(side)).withColumn("__d", around)
        spread = spread.select("site_id", "s_lon", "s_lat", *((F.col(f"__c{c}") + F.col(f"__d.{c}")).alias(f"__c{c}") for c in "xyz"))
        met = left.withColumns({f"__c{c}": v for c, v in zip("xyz", cube(side), strict=True)}).join(spread, [f"__c{c}" for c in "xyz"])
        km = met.select("point_id", "site_id", haversine_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")).alias("km"))
        best = F.struct("km", "site_id")
        if k == 1:
            found = km.groupBy("point_id").agg(F.array(F.min(best)).alias("best"))
        else:
            ranked = km.withColumn("rank", F.row_number().over(Window.partitionBy("point_id").orderBy("km", "site_id"))).where(F.col("rank") <= k)
            found = ranked.groupBy("point_id").agg(F.sort_array(F.collect_list(best)).alias("best"))
        whole = side >= 2  # 27 cubes hold the sphere
        sure = F.lit(whole) | ((F.size("best") == k) & (F.element_at("best", -1)["km"] < 2 * RADIUS_KM * math.asin(min(1.0, side / 2))))
        done.append(staged(found.where(sure), "nearest"))
        if whole:
            break
        left = staged(left.join(done[-1].select("point_id"), "point_id", "left_anti"), "points-left")
        if left.isEmpty():
            break
        side *= 4
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("point_id", F.posexplode("best").alias("at", "b")).select("point_id", "b.site_id", "b.km", (F.col("at") + 1).alias("rank"))


LOTS, FIRST_LOT = 4096, 100_000  # cells are dealt to so many lots; as many lots come first as hold about so many segments


def crossings(lines: DataFrame, most: int = 4) -> DataFrame:
    """(line_id, other_id, n): proper crossings of two lines' segments, counted up to `most`.

    lines: (line_id, seg_no, x1, y1, x2, y2), alike rows count once. Segments meet on the grid
    cells that they touch, and a pair is looked at in the least cell that both touch, so no pair
    is kept or sent anywhere to be told apart. Lots of cells are worked in turn, sixteen times
    as many each time, until all are done or no pair of lines is left that crosses less than
    `most` times: what is not worked then can't change a row. Shared ends are no crossing.
    """
    low = lambda a, b: F.floor(F.least(a, b)).cast("int")
    high = lambda a, b: F.floor(F.greatest(a, b)).cast("int")
    turn = lambda px, py, qx, qy, rx, ry: (F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px))
    apart = lambda u, v: (u > 1e-8) & (v < -1e-8) | (u < -1e-8) & (v > 1e-8)
    proper = apart(turn("a_x1", "a_y1", "a_x2", "a_y2", "b_x1", "b_y1"), turn("a_x1", "a_y1", "a_x2", "a_y2", "b_x2", "b_y2")) & apart(turn("b_x1", "b_y1", "b_x2", "b_y2", "a_x1", "a_y1"), turn("b_x1", "b_y1", "b_x2", "b_y2", "a_x2", "a_y2"))
    least = (F.col("cx") == F.greatest("a_lx", "b_lx")) & (F.col("cy") == F.greatest("a_ly", "b_ly"))
    lot = F.pmod(F.xxhash64("cx", "cy"), F.lit(LOTS))

    segments, named = lines.agg(F.count("*"), F.count_distinct("line_id")).first()
    since, until = 0, min(LOTS, math.ceil(LOTS * FIRST_LOT / max(1, segments)))
    left, found = lines.withColumns({"lx": low("x1", "x2"), "ly": low("y1", "y2")}), None
    while True:
        dealt = left.withColumn("cx", F.explode(F.sequence("lx", high("x1", "x2")))).withColumn("cy", F.explode(F.sequence("ly", high("y1", "y2"))))
        dealt = dealt.where((lot >= since) & (lot < until)).repartition("cx", "cy").distinct()
        side = lambda s, of=dealt: of.select("cx", "cy", *(F.col(c).alias(f"{s}_{c}") for c in left.columns))
        met = side("a").join(side("b").hint("merge"), ["cx", "cy"]).where(F.col("a_line_id") < F.col("b_line_id")).where(least & proper)
        now = met.groupBy(F.col("a_line_id").alias("line_id"), F.col("b_line_id").alias("other_id")).agg(F.count("*").alias("n"))
        before, found = found, staged(now if found is None else found.unionByName(now).groupBy("line_id", "other_id").agg(F.sum("n").alias("n")), "crossings")
        if before is not None:
            remove(before)
        if until == LOTS:
            break
        # A line is done once it crosses each other line that often.
        done = found.where(F.col("n") >= most).select(F.explode(F.array("line_id", "other_id")).alias("line_id")).groupBy("line_id").agg(F.count("*").alias("others")).where(F.col("others") == named - 1)
        settled = done.count()
        if settled == named:
            break
        if settled:
            left = left.join(staged(done.select("line_id"), "lines-done"), "line_id", "left_anti")
        since, until = until, min(LOTS, 16 * until)
    return found.select("line_id", "other_id", F.least(F.lit(most), "n").cast("int").alias("n"))


def length_km(points: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by..., km, points): the length and the number of points of each line in order."""
    within = Window.partitionBy(*by).orderBy(*order)
    step = haversine_km(F.lag("lat").over(within), F.lag("lon").over(within), F.col("lat"), F.col("lon"))
    return points.withColumn("__km", F.coalesce(step, F.lit(0.0))).groupBy(*by).agg(F.sum("__km").alias("km"), F.count("*").alias("points"))


def legs_of(points: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by..., leg, km, lon, lat): each leg between two points of a line, numbered from 1, at its middle."""
    within = Window.partitionBy(*by).orderBy(*order)
    before = lambda c: F.lag(c).over(within)
    legs = points.select(*by, (F.row_number().over(within) - 1).alias("leg"), haversine_km(before("lat"), before("lon"), F.col("lat"), F.col("lon")).alias("km"), ((before("lon") + F.col("lon")) / 2).alias("lon"), ((before("lat") + F.col("lat")) / 2).alias("lat"))
    return legs.where("leg > 0")


def route_regions(legs: DataFrame, by: list[str], lit: DataFrame) -> DataFrame:
    """One row per route: what its legs (by..., leg, km, region or null) pass through, given the regions that are lit.

    lit_km, unlit_km, outside_km, lit_regions, unlit_regions, and of the regions in the order
    passed, between the first and the last lit one: bridge_regions, the distinct unlit ones,
    and bridge_runs, how many times the way leaves the light.
    """
    told = legs.join(lit.select("region").distinct().withColumn("__lit", F.lit(True)), "region", "left")
    inside, is_lit = F.col("region").isNotNull(), F.coalesce(F.col("__lit"), F.lit(False))
    sums = told.groupBy(*by).agg(
        F.sum(F.when(inside & is_lit, F.col("km")).otherwise(0.0)).alias("lit_km"), F.sum(F.when(inside & ~is_lit, F.col("km")).otherwise(0.0)).alias("unlit_km"), F.sum(F.when(~inside, F.col("km")).otherwise(0.0)).alias("outside_km"),
        F.count_distinct(F.when(is_lit, F.col("region"))).alias("lit_regions"), F.count_distinct(F.when(inside & ~is_lit, F.col("region"))).alias("unlit_regions"),
    )
    # A route is one line; its legs are as many as its points.
    within = Window.partitionBy(*by).orderBy("leg")
    passed = told.where(inside).select(*by, "leg", "region", is_lit.alias("lit"))
    ends = passed.where("lit").groupBy(*by).agg(F.min("leg").alias("__first"), F.max("leg").alias("__last"))
    dark = passed.withColumn("__after", F.coalesce(F.lag("lit").over(within), F.lit(False))).join(ends, by).where("not lit and leg > __first and leg < __last")
    bridges = dark.groupBy(*by).agg(F.count_distinct("region").alias("bridge_regions"), F.count_if("__after").alias("bridge_runs"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return sums.join(bridges, by, "left").select(*by, "lit_km", "unlit_km", "outside_km", "lit_regions", "unlit_regions", zero("bridge_regions"), zero("bridge_runs"))


def nearest_progress(lines: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """points (by..., point_id, lon, lat) with `progress` from 0 to 1 along their line, lines being (by..., seq, lon, lat, km, progress).

    lines as progress_along() gives them. Distance is taken on the plane at the point; of
    places as near as each other, to a millimetre, the first counts.
    """
    within = Window.partitionBy(*by).orderBy("seq", "km", "progress")
    before = lambda c: F.lag(c).over(within)
    legs = lines.select(*by, F.col("seq").alias("__seq"), before("lon").alias("__lon0"), before("lat").alias("__lat0"), F.col("lon").alias("__lon1"), F.col("lat").alias("__lat1"), before("progress").alias("__p0"), F.col("progress").alias("__p1")).where("__lon0 is not null")
    met = points.join(legs, by)
    x = km_per_lon(F.col("lat"))
    vx, vy = (F.col("__lon1") - F.col("__lon0")) * x, (F.col("__lat1") - F.col("__lat0")) * KM_LAT
    ux, uy = (F.col("lon") - F.col("__lon0")) * x, (F.col("lat") - F.col("__lat0")) * KM_LAT
    met = met.withColumns({"__vx": vx, "__vy": vy, "__ux": ux, "__uy": uy})
    size = F.col("__vx") * F.col("__vx") + F.col("__vy") * F.col("__vy")
    share = F.coalesce(F.try_divide(F.col("__ux") * F.col("__vx") + F.col("__uy") * F.col("__vy"), size), F.lit(0.0))
    met = met.withColumn("__t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    off = F.pow(F.col("__ux") - F.col("__vx") * F.col("__t"), 2) + F.pow(F.col("__uy") - F.col("__vy") * F.col("__t"), 2)
    at = F.col("__p0") + (F.col("__p1") - F.col("__p0")) * F.col("__t")
    best = met.groupBy(*by, "point_id").agg(F.min(F.struct(F.round(F.sqrt(off), 6).alias("off"), "__seq", at.alias("progress"), "lon", "lat")).alias("b"))
    return best.select(*by, "point_id", "b.lon", "b.lat", "b.progress")

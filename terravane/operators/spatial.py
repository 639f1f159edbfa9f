"""Spatial joins as equi-joins on grid cells, and ordered joins of ways with nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo

#: Zones that cover more cells than this are compared by bounding box, in a table of their own.
CELLS_MAX, NEAREST, NEAR_M = 4096, 25, 1000.0


def boxes(zones: DataFrame) -> DataFrame:
    """zones with their bounding boxes."""
    points = F.flatten(F.flatten("polygons"))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return zones.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})


def _cell(c: Column, width: float) -> Column:
    return F.floor(c / width).cast("int")


def cells(zones: DataFrame, width: float) -> DataFrame:
    """One row for each grid cell that a zone's box touches; wide zones are left out (see wide_zones)."""
    span = (_cell(F.col("x1"), width) - _cell(F.col("x0"), width) + 1) * (_cell(F.col("y1"), width) - _cell(F.col("y0"), width) + 1)
    some = zones.where(span <= CELLS_MAX)
    across = some.withColumn("cell_x", F.explode(F.sequence(_cell(F.col("x0"), width), _cell(F.col("x1"), width))))
    return across.withColumn("cell_y", F.explode(F.sequence(_cell(F.col("y0"), width), _cell(F.col("y1"), width))))


def wide_zones(zones: DataFrame, width: float) -> DataFrame:
    span = (_cell(F.col("x1"), width) - _cell(F.col("x0"), width) + 1) * (_cell(F.col("y1"), width) - _cell(F.col("y0"), width) + 1)
    return zones.where(span > CELLS_MAX)


def _edge_table(zones: DataFrame) -> DataFrame:
    """(zone, polygon, x1, y1, x2, y2) for every edge of every ring."""
    polygons = zones.select(F.col("id").alias("zone"), F.posexplode("polygons").alias("polygon", "rings"))
    return polygons.select("zone", "polygon", F.explode(F.flatten(F.transform("rings", geo.edges))).alias("e")).select("zone", "polygon", "e.*")


def containing(points: DataFrame, zones: DataFrame, key: str, x: str, y: str, width: float = 1.0, country: tuple[str, str] | None = None) -> DataFrame:
    """(key, zone): every zone that contains a point. Boundaries are outside. zones: id, polygons, ...

    Points and boxes meet on grid cells (and country); candidates then meet the zones' edges, and a point is inside a polygon
    whose edges a ray from it crosses an odd number of times.
    """
    zone_country = country[1] if country else None
    z = boxes(zones.select("id", "polygons", *([zone_country] if country else [])))
    flat = z.drop("polygons")
    p = points.select(F.col(key).alias("_p"), F.col(x).alias("_x"), F.col(y).alias("_y"), *([F.lower(country[0]).alias("_c")] if country else []))
    p = p.withColumns({"_cx": _cell(F.col("_x"), width), "_cy": _cell(F.col("_y"), width)})
    box = F.col("_x").between(F.col("x0"), F.col("x1")) & F.col("_y").between(F.col("y0"), F.col("y1"))
    same = F.col("_c") == F.col(zone_country) if country else F.lit(True)
    near = p.join(cells(flat, width), (F.col("_cx") == F.col("cell_x")) & (F.col("_cy") == F.col("cell_y")) & same).where(box)
    wide = wide_zones(flat, width)
    far = p.join(wide, box & same)
    candidates = near.select("_p", "_x", "_y", "id").union(far.select("_p", "_x", "_y", "id")).distinct()
    hit = candidates.join(_edge_table(z), F.col("id") == F.col("zone"))
    e = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    counted = hit.groupBy("_p", "zone", "polygon").agg(F.count(F.when(geo.crosses(e, F.col("_x"), F.col("_y")), 1)).alias("n"), F.max(geo.on_edge(e, F.col("_x"), F.col("_y"))).alias("edge"))
    return counted.where((F.col("n") % 2 == 1) & ~F.col("edge")).select(F.col("_p").alias(key), "zone").distinct()


def zone_names(points: DataFrame, zones: DataFrame, key: str, x: str, y: str, width: float = 1.0, country: tuple[str, str] | None = None, metres=geo.haversine, out: str = "zone_name") -> DataFrame:
    """points with the name of the zone that contains them, or ''.

    Of several, the one whose centroid is nearest in whole metres, then the first in load order. zones: id, name, polygons,
    cx, cy, load_order (and a country). metres: a function of (lat, lon, lat, lon), such as geo.vincenty.
    """
    found = containing(points, zones, key, x, y, width, country)
    about = zones.select(F.col("id").alias("zone"), "name", "cx", "cy", "load_order")
    at = points.select(key, F.col(x).alias("_x"), F.col(y).alias("_y"))
    # Distances that do not converge come last.
    far = F.coalesce(F.floor(F.nanvl(metres(F.col("_y"), F.col("_x"), F.col("cy"), F.col("cx")), F.lit(4294967295.0))), F.lit(4294967295))
    best = found.join(about, "zone").join(at, key).groupBy(key).agg(F.min_by("name", F.struct(far, "load_order")).alias(out))
    return points.join(best, key, "left").withColumn(out, F.coalesce(out, F.lit("")))


def country_codes(points: DataFrame, zones: DataFrame, key: str, x: str, y: str, width: float = 5.0, remap: dict[str, str] | None = None, metres=geo.haversine, out: str = "country", near: float = NEAR_M) -> DataFrame:
    """points with the code of the country that contains them; near a coast, of one whose border is close.

    Only points that no country contains look at the 25 nearest centroids; the first of these, in that order, whose closest
    border point is under a kilometre away counts. zones: id, name, country_code, polygons, cx, cy, load_order.
    """
    codes = zones.withColumn("name", F.col("country_code"))
    inside = zone_names(points, codes, key, x, y, width, None, metres, out)
    lost = inside.where(F.col(out) == "").select(key, F.col(x).alias("_x"), F.col(y).alias("_y"))
    d = metres(F.col("_y"), F.col("_x"), F.col("cy"), F.col("cx"))
    # Countries are few, a fixed few hundred; their centroids are compared with the remainder only.
    centres = codes.select(F.col("id").alias("zone"), "country_code", "cx", "cy", "load_order")
    about = lost.crossJoin(F.broadcast(centres)).withColumn("far", F.floor(d))
    order = Window.partitionBy(key).orderBy("far", "load_order")
    about = about.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= NEAREST)
    parts = about.join(_edge_table(codes), "zone")
    e = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    close = parts.groupBy(key, "zone", "country_code", "nth", "_x", "_y").agg(F.min(geo.segment_distance(e, F.col("_x"), F.col("_y"))).alias("s"))
    metres_off = metres(F.col("_y"), F.col("_x"), F.col("s.y"), F.col("s.x"))
    close = close.where((F.col("s.d2") > 0) & (metres_off < near)).groupBy(key).agg(F.min_by("country_code", "nth").alias("_near"))
    code = F.coalesce(F.nullif(F.col(out), F.lit("")), F.col("_near"), F.lit(""))
    if remap:
        table = F.create_map(*(F.lit(v) for kv in remap.items() for v in kv))
        code = F.coalesce(F.try_element_at(table, code), code)
    return inside.join(close, key, "left").withColumn(out, code).drop("_near")


def all_zones(points: DataFrame, countries: DataFrame, regions: DataFrame, localities: DataFrame, key: str, x: str, y: str, **options) -> DataFrame:
    """points with country, region and locality; the latter two only where there is a country."""
    out = country_codes(points, countries, key, x, y, **options)
    for name, zones in (("region", regions), ("locality", localities)):
        named = zone_names(out, zones, key, x, y, country=("country", "country_code"), out=name)
        out = named.withColumn(name, F.when(F.col("country") != "", F.col(name)).otherwise(F.lit("")))
    return out


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, points): each way's nodes in order. A way with a node that is missing is an error in the data and keeps the rest."""
    each = ways.select("id", F.posexplode("nodes").alias("pos", "node"))
    met = each.join(nodes.select(F.col("id").alias("node"), "lat", "long"), "node")
    points = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "long"))).alias("p"))
    return points.select("id", F.transform("p", lambda p: F.struct(p["lat"].alias("lat"), p["long"].alias("long"))).alias("points"))


def multipoint_centroid(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    return rows.groupBy(by).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))

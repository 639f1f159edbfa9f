"""Geometry as column expressions over rings of (x, y) points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

EARTH_M = 6_371_008.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def vincenty_metres(lat1, lon1, lat2, lon2, tolerance: float = 1e-12, rounds: int = 100) -> np.ndarray:
    """Inverse problem on the WGS-84 ellipsoid for arrays; NaN where it does not converge."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(x, float)) for x in (lat1, lon1, lat2, lon2))
    u1, u2, length = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2)), lon2 - lon1
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, done = length.copy(), np.zeros(length.shape, bool)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, cu1 * cu2 * sl / ss)
            c2 = 1 - sa * sa
            cm = np.where(c2 == 0, 0.0, cs - 2 * su1 * su2 / c2)
            c = f / 16 * c2 * (4 + f * (4 - 3 * c2))
            new = length + (1 - c) * f * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
            done |= np.abs(new - lam) < tolerance
            lam = np.where(done & (np.abs(new - lam) >= tolerance), lam, new)
            if done.all():
                break
        u = c2 * (a * a - b * b) / (b * b)
        big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        d = big_b * ss * (cm + big_b / 4 * (cs * (2 * cm * cm - 1) - big_b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
    return np.where(done, b * big_a * (sigma - d), np.nan)


@F.pandas_udf(DoubleType())
def vincenty(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(vincenty_metres(lat1, lon1, lat2, lon2))


def edges(ring: Column) -> Column:
    """Consecutive points of a ring as (x1, y1, x2, y2), closed."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.lit(0), F.size(ring) - 1)), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def crosses(e, x: Column, y: Column) -> Column:
    """Whether a ray to the right of (x, y) crosses the edge."""
    return ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])


def on_edge(e, x: Column, y: Column) -> Column:
    cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return (cross == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))


def in_rings(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd over all rings of a polygon; points on the boundary are outside."""
    all_ = F.flatten(F.transform(rings, edges))
    return (F.size(F.filter(all_, lambda e: crosses(e, x, y))) % 2 == 1) & ~F.exists(all_, lambda e: on_edge(e, x, y))


def segment_distance(e, x: Column, y: Column) -> Column:
    """Planar distance from (x, y) to the edge, and the closest point, as a struct (d2, x, y)."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / n)))
    px, py = e["x1"] + t * dx, e["y1"] + t * dy
    return F.struct(((px - x) * (px - x) + (py - y) * (py - y)).alias("d2"), px.alias("x"), py.alias("y"))


def ring_sums(ring: Column) -> Column:
    """Twice the signed area and the centroid's moments (a2, mx, my)."""
    zero = F.struct(F.lit(0.0).alias("a2"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(s, e):
        c = e["x1"] * e["y2"] - e["x2"] * e["y1"]
        return F.struct((s["a2"] + c).alias("a2"), (s["mx"] + (e["x1"] + e["x2"]) * c).alias("mx"), (s["my"] + (e["y1"] + e["y2"]) * c).alias("my"))

    return F.aggregate(edges(ring), zero, add)


def centroid(polygons: Column) -> Column:
    """Centroid (x, y) of polygons, each an outer ring and holes. A null struct for no area."""
    zero = F.struct(F.lit(0.0).alias("a2"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def of_polygon(rings):
        sums = F.transform(rings, lambda r, i: F.struct((F.abs(ring_sums(r)["a2"]) * F.when(i == 0, 1.0).otherwise(-1.0)).alias("w"), ring_sums(r).alias("s")))
        return F.aggregate(sums, zero, lambda z, t: F.struct((z["a2"] + t["w"]).alias("a2"), (z["mx"] + t["s"]["mx"] / t["s"]["a2"] * t["w"]).alias("mx"), (z["my"] + t["s"]["my"] / t["s"]["a2"] * t["w"]).alias("my")))

    total = F.aggregate(F.transform(polygons, of_polygon), zero, lambda z, t: F.struct((z["a2"] + t["a2"]).alias("a2"), (z["mx"] + t["mx"]).alias("mx"), (z["my"] + t["my"]).alias("my")))
    return F.transform(F.array(total), lambda t: F.when(t["a2"] != 0, F.struct((t["mx"] / (3 * t["a2"])).alias("x"), (t["my"] / (3 * t["a2"])).alias("y"))))[0]

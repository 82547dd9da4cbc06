"""Points near points, and points inside regions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import radians

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.operators.skew import salted_join
from tidewave.storage import materialize

EARTH_KM = 6371.0088
# Side of a cell in widths of the search for neighbours: wider cells mean fewer copies of a slab and more points beside it.
CELL = 3
EDGE = "struct<x1:double,y1:double,x2:double,y2:double>"
SLAB = f"region_id bigint, owner bigint, x0 double, x1 double, ylow double, yhigh double, edges array<{EDGE}>, walls array<struct<low:double,high:double>>"


def clean_points(points: DataFrame) -> DataFrame:
    """Points (point_id, owner, lat, lon) that have a location, with longitudes from -180 to 180.

    No location: null, NaN, exactly 0,0, or outside the globe (latitude beyond 90, longitude beyond 360)."""
    lat, lon = F.col("lat"), F.col("lon")
    known = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & ~((lat == 0) & (lon == 0)) & lat.between(-90, 90) & lon.between(-360, 360)
    return points.where(known).withColumn("lon", F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def near_pairs(points: DataFrame, km: float, other_owner: bool = False, hot_rows: int = 20000) -> DataFrame:
    """Pairs of points at most `km` apart by great circle: point_id < other_id, km_apart; with `other_owner`, of differing owners.

    Each point's circle is decomposed like a region (see points_in_regions): its eastern half lies in one slab with two level edges, from the point's own longitude as far as
    the circle can reach, so every pair is met once, from its western point. Slabs are spread over the cells they touch (two or three), in rows of latitude CELL times as high as `km`, each cell at least CELL times
    as wide as the reach there, and points meet the slabs of the one cell they lie in; the edges, then the exact distance, decide. The work thus follows the
    number of neighbours. Cells wrap at the antimeridian and grow towards the poles. A cell with more than `hot_rows` points or slabs is
    cut into parts. Points: point_id (distinct), owner, lat, lon as from clean_points; nulls and empty tables give no pair."""
    high = float(np.degrees(km / EARTH_KM)) * 1.0000001
    row = lambda lat: F.floor(lat / (CELL * high))
    # The widest angle of longitude that km can span around the row's pole-ward edge.
    edge = lambda s: F.least(F.greatest(F.abs(s * CELL * high), F.abs((s + 1) * CELL * high)) + high, F.lit(90.0))
    reach = lambda s: F.when(edge(s) >= 89.5, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.sin(F.lit(radians(high))) / F.cos(F.radians(edge(s))), F.lit(1.0)))) * 1.000001)
    cells = lambda s: F.greatest(F.floor(360.0 / (CELL * reach(s))), F.lit(1)).cast("bigint")
    cell = lambda s, lon: F.floor((lon + 180.0) / (360.0 / cells(s)))
    at = points.select("point_id", "owner", "lat", "lon", row(F.col("lat")).alias("row"))
    at = at.withColumn("cell", F.pmod(cell(F.col("row"), F.col("lon")), cells(F.col("row"))))
    slabs = points.select(F.col("point_id").alias("west_id"), F.col("owner").alias("west_owner"), F.col("lat").alias("west_lat"), F.col("lon").alias("x0"))
    slabs = slabs.withColumn("row", F.explode(F.sequence(row(F.col("west_lat") - high), row(F.col("west_lat") + high))))
    spread = F.sequence(cell(F.col("row"), F.col("x0")), cell(F.col("row"), F.col("x0") + reach(F.col("row"))))
    slabs = slabs.withColumn("cell", F.explode(F.array_distinct(F.transform(spread, lambda c: F.pmod(c, cells(F.col("row")))))))
    # East of the slab's left side, the short way round; exactly opposite or equal longitudes are met from both sides and kept from the smaller id.
    away = F.col("lon") - F.col("x0")
    away = F.when(away > 180, away - 360).when(away < -180, away + 360).otherwise(away)
    found = ((away > 0) & (away < 180)) | (((away == 0) | (F.abs(away) == 180)) & (F.col("west_id") < F.col("point_id")))
    found &= F.col("lat").between(F.col("west_lat") - high, F.col("west_lat") + high)
    if other_owner:
        found &= F.col("owner") != F.col("west_owner")
    pairs = salted_join(at, slabs, ["row", "cell"], found, hot_rows)
    pairs = pairs.withColumn("km_apart", haversine_km(F.col("lat"), F.col("lon"), F.col("west_lat"), F.col("x0"))).where(F.col("km_apart") <= km)
    return pairs.select(F.least("west_id", "point_id").alias("point_id"), F.greatest("west_id", "point_id").alias("other_id"), "km_apart")


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def rings_of(wkt: str | None) -> list[list[tuple[float, float]]]:
    """The rings of a POLYGON or MULTIPOLYGON text in any spelling (case, blanks, SRID, Z and M values); [] for anything else.

    Rings of fewer than three different corners have no area and are left out; an unclosed ring is closed."""
    text = re.sub(r"^\s*SRID\s*=\s*\d+\s*;", "", wkt or "", flags=re.I).strip()
    if not re.match(r"(MULTI)?POLYGON\b", text, re.I):
        return []
    rings = []
    for body in re.findall(r"\(([^()]+)\)", text):
        corners = []
        for pair in body.split(","):
            xy = re.findall(_NUMBER, pair)
            if len(xy) < 2:
                return []
            corners.append((float(xy[0]), float(xy[1])))
        ring = [c for i, c in enumerate(corners) if not i or c != corners[i - 1]]
        if len(ring) > 1 and ring[0] == ring[-1]:
            ring.pop()
        if len(set(ring)) >= 3:
            rings.append(ring)
    return rings


def slabs_of(rings: list[list[tuple[float, float]]]) -> list[dict]:
    """The trapezoidal decomposition of a region: slabs between neighbouring corner longitudes, cut again where edges cross, each with the edges through it
    ordered from below, and the walls (corners and upright edges) at its left side."""
    edges = [(a, b) if a < b else (b, a) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])]
    xs = sorted({p[0] for ring in rings for p in ring})
    walls: dict[float, list[tuple[float, float]]] = {}
    for (x1, y1), (x2, y2) in edges:
        walls.setdefault(x1, []).append((y1, y1))
        walls.setdefault(x2, []).append((y2, y2))
        if x1 == x2:
            walls[x1].append((min(y1, y2), max(y1, y2)))
    starts: dict[float, list] = {}
    for e in edges:
        if e[0][0] < e[1][0]:
            starts.setdefault(e[0][0], []).append(e)
    height = lambda e, x: e[0][1] + (e[1][1] - e[0][1]) * (x - e[0][0]) / (e[1][0] - e[0][0])
    out, live = [], []
    for left, right in zip(xs, xs[1:]):
        live = [e for e in live if e[1][0] > left] + starts.get(left, [])
        cuts = [left, *crossings([(height(e, left), height(e, right)) for e in live], left, right), right]
        for a, b in zip(cuts, cuts[1:]) if live else ():
            ordered = sorted(live, key=lambda e: height(e, (a + b) / 2))  # noqa: B023
            ys = [height(e, x) for e in (ordered[0], ordered[-1]) for x in (a, b)]
            out.append({"x0": a, "x1": b, "ylow": min(ys) - 1e-9, "yhigh": max(ys) + 1e-9, "edges": [(*e[0], *e[1]) for e in ordered], "walls": sorted(walls.get(a, []))})
    return out


def crossings(ends: list[tuple[float, float]], left: float, right: float) -> list[float]:
    """Where edges cross between left and right, given their heights at both."""
    by_left = sorted(ends)
    if all(a[1] <= b[1] for a, b in zip(by_left, by_left[1:])):
        return []
    found = set()
    for i, (l1, r1) in enumerate(by_left):
        for l2, r2 in by_left[i + 1 :]:
            if l1 < l2 and r1 > r2:
                found.add(left + (right - left) * (l2 - l1) / ((l2 - l1) + (r1 - r2)))
    return sorted(x for x in found if left < x < right)


def _slabs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for region, owner, wkt in batch.itertuples(index=False):
            rings = rings_of(wkt)
            # An area written beyond 180 degrees is also looked for at the longitudes points are counted in.
            xs = [x for ring in rings for x, _ in ring]
            shifts = [0.0] + ([-360.0] if xs and max(xs) > 180 else []) + ([360.0] if xs and min(xs) < -180 else [])
            for shift in shifts:
                for s in slabs_of([[(x + shift, y) for x, y in ring] for ring in rings]):
                    rows.append((region, owner, s["x0"], s["x1"], s["ylow"], s["yhigh"], [dict(zip(("x1", "y1", "x2", "y2"), e)) for e in s["edges"]], [dict(zip(("low", "high"), w)) for w in s["walls"]]))
        yield pd.DataFrame(rows, columns=["region_id", "owner", "x0", "x1", "ylow", "yhigh", "edges", "walls"])


def region_slabs(regions: DataFrame) -> DataFrame:
    """The slabs of all regions (region_id, owner, wkt), one row each; texts that are no area give none."""
    return regions.select("region_id", "owner", "wkt").where(F.col("wkt").isNotNull()).mapInPandas(_slabs, SLAB)


def _inside(x: Column, y: Column) -> Column:
    """Whether a point of a slab (x0, edges, walls) is strictly inside: a binary search for the number of edges below it, odd inside by the even-odd rule. A point within rounding
    of an edge is on it, hence outside."""
    edges = F.col("edges")

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        e = F.get(edges, middle)
        a, b = (e["x2"] - e["x1"]) * (y - e["y1"]), (e["y2"] - e["y1"]) * (x - e["x1"])
        on = F.abs(a - b) <= F.lit(1e-14) * (F.abs(a) + F.abs(b))
        going = s["low"] < s["high"]
        return F.struct(
            F.when(going & (a > b), middle + 1).otherwise(s["low"]).alias("low"), F.when(going & (a <= b), middle).otherwise(s["high"]).alias("high"), (s["on"] | F.coalesce(going & on, F.lit(False))).alias("on")
        )

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(edges) + 1)).cast("int"))
    below = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(edges).alias("high"), F.lit(False).alias("on")), step, lambda s: ~s["on"] & (s["low"] % 2 == 1))
    return below & ~((x == F.col("x0")) & F.exists("walls", lambda w: (w["low"] <= y) & (y <= w["high"])))


def points_in_regions(points: DataFrame, regions: DataFrame, other_owner: bool = False, cell: float = 0.1, hot_rows: int = 20000) -> DataFrame:
    """Pairs (point_id, region_id) of points strictly inside a region, in plane geometry of degrees; with `other_owner`, of differing owners.

    Each region is decomposed into trapezoids: slabs between neighbouring corners and crossings of edges, their edges in order. Slabs are spread over
    square cells of `cell` degrees and meet the points of their cells in an equi-join that also tests the slab's bounds; a binary search over
    the slab's edges then decides. A point on a border, or at the last corner, is outside. Rings are read by the even-odd rule, which holds for self-crossing ones too,
    so holes and several parts need no case of their own. A cell with more than `hot_rows` points or slabs is cut into parts.
    Points as from clean_points, regions: region_id (distinct), owner, wkt; rows without area, nulls and empty tables give nothing."""
    box = lambda c: F.floor(c / cell).cast("bigint")
    slabs = materialize(region_slabs(regions).withColumnRenamed("owner", "region_owner"), "slabs")
    slabs = slabs.withColumn("cx", F.explode(F.sequence(box(F.col("x0")), box(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(box(F.col("ylow")), box(F.col("yhigh")))))
    at = points.select("point_id", "owner", "lat", "lon", box(F.col("lon")).alias("cx"), box(F.col("lat")).alias("cy"))
    bound = (F.col("lon") >= F.col("x0")) & (F.col("lon") < F.col("x1")) & (F.col("lat") >= F.col("ylow")) & (F.col("lat") <= F.col("yhigh"))
    if other_owner:
        bound &= F.col("owner") != F.col("region_owner")
    near = salted_join(at, slabs, ["cx", "cy"], bound, hot_rows)
    return near.where(_inside(F.col("lon"), F.col("lat"))).select("point_id", "region_id")

"""Plane geometry of regions: hulls, areas, overlaps, area-weighted crosswalks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.operators.places import crossings, rings_of
from tidewave.storage import materialize

Point = tuple[float, float]


def hull_of(points: list[Point]) -> list[Point]:
    """Corners of the convex hull, counter-clockwise from the least point; the points themselves if they span no area."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def chain(seq: list[Point]) -> list[Point]:
        out: list[Point] = []
        for p in seq:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(pts[::-1])


def wkt_of(hull: list[Point]) -> str | None:
    if not hull:
        return None
    text = lambda p: f"{p[0]:.9g} {p[1]:.9g}"
    if len(hull) == 1:
        return f"POINT({text(hull[0])})"
    if len(hull) == 2:
        return f"LINESTRING({', '.join(map(text, hull))})"
    return f"POLYGON(({', '.join(map(text, [*hull, hull[0]]))}))"


def areas_of(one: list[list[Point]], two: list[list[Point]]) -> tuple[float, float, float, bool]:
    """The areas of two regions and of their overlap by the even-odd rule, and whether no edges of `two` cross each other.

    The plane is cut into slabs at all corners and crossings of edges; between two neighbouring edges of a slab lies a trapezoid, inside a region if an odd number of its edges are below."""
    edges = []
    for which, rings in enumerate((one, two)):
        for ring in rings:
            for p, q in zip(ring, ring[1:] + ring[:1]):
                if p[0] != q[0]:
                    edges.append((*min(p, q), *max(p, q), which))
    edges.sort()
    xs = sorted({x for e in edges for x in (e[0], e[2])})
    height = lambda e, x: e[1] + (e[3] - e[1]) * (x - e[0]) / (e[2] - e[0])
    totals, simple = [0.0, 0.0, 0.0], True
    live, at, last_order = [], 0, []
    for left, right in zip(xs, xs[1:]):
        live = [e for e in live if e[2] > left]
        while at < len(edges) and edges[at][0] <= left:
            live.append(edges[at])
            at += 1
        ends = [(height(e, left), height(e, right)) for e in live]
        cuts = [left, *crossings(ends, left, right), right]
        # Edges of `two` cross inside the slab, or at its left side if those that go on change their order there.
        order = [e for _, e in sorted((height(e, (left + right) / 2), e) for e in live if e[4])]
        going, before = [e for e in order if e[0] < left], set(order)
        simple = simple and going == [e for e in last_order if e in before] and not (len(cuts) > 2 and crossings([h for h, e in zip(ends, live) if e[4]], left, right))
        last_order = order
        for x0, x1 in zip(cuts, cuts[1:]):
            middle = (x0 + x1) / 2
            inside, last = [False, False], 0.0
            for h, which in sorted((height(e, middle), e[4]) for e in live):
                piece = (h - last) * (x1 - x0)
                if inside[0]:
                    totals[0] += piece
                if inside[1]:
                    totals[1] += piece
                if inside[0] and inside[1]:
                    totals[2] += piece
                inside[which] = not inside[which]
                last = h
    return (*totals, simple)


def area_of(rings: list[list[Point]]) -> float:
    """The area of a region by the even-odd rule."""
    return areas_of(rings, [])[0]


@F.pandas_udf(T.StringType())
def hull_wkt(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """The hull of arrays of coordinates as text."""
    return pd.Series([None if x is None else wkt_of(hull_of(list(zip(x.tolist(), y.tolist())))) for x, y in zip(xs, ys)], dtype=object)


def hulls(points: DataFrame, by: list[str], x: str, y: str, precision: int = 20) -> DataFrame:
    """wkt of the convex hull of each group's points.

    A group is first reduced in parts: each part keeps the extreme points in many directions plus its own hull, so no task holds all the
    points of a large group; the hull of the parts' hulls is the group's."""
    rows = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.pmod(F.xxhash64(x, y), F.lit(precision)).alias("__p"))
    part = rows.groupBy(*by, "__p").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys")).withColumn("h", _hull_points("xs", "ys"))
    corners = part.select(*by, F.explode("h").alias("c")).select(*by, "c.x", "c.y")
    return corners.groupBy(*by).agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys")).select(*by, hull_wkt("xs", "ys").alias("wkt"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
def _hull_points(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series([[{"x": a, "y": b} for a, b in hull_of(list(zip(x.tolist(), y.tolist())))] for x, y in zip(xs, ys)], dtype=object)


@F.pandas_udf(T.DoubleType())
def area(wkt: pd.Series) -> pd.Series:
    """Plane area of a region's text; 0 for what is no area, null for null."""
    return pd.Series([None if w is None else area_of(rings_of(w)) for w in wkt], dtype=float)


BOX = T.StructType([*[T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")], T.StructField("upright", T.BooleanType())])


@F.pandas_udf(BOX)
def box(wkt: pd.Series) -> pd.DataFrame:
    """The bounds of a region's text, and whether it is one rectangle with upright sides, so that the bounds are the region."""
    rows = []
    for w in wkt:
        rings = rings_of(w)
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        if not xs:
            rows.append((None,) * 5)
            continue
        x0, y0, x1, y1 = min(xs), min(ys), max(xs), max(ys)
        turns = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        first = rings[0].index((x0, y0)) if (x0, y0) in rings[0] else 0
        turned = rings[0][first:] + rings[0][:first]
        rows.append((x0, y0, x1, y1, len(rings) == 1 and turned in (turns, turns[:1] + turns[:0:-1])))
    out = pd.DataFrame(rows, columns=["x0", "y0", "x1", "y1", "upright"])
    return out.astype({c: float for c in ("x0", "y0", "x1", "y1")}).assign(upright=out["upright"].astype(object))


AREAS = "contained boolean, map_area double, region_area double, overlap_area double, fraction double"


def _overlaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        maps: dict[str, list[list[Point]]] = {}
        regions: dict[str, list[list[Point]]] = {}
        out = []
        for m, r, mw, rw in b.itertuples(index=False):
            if rw not in regions:
                rings = rings_of(rw)
                regions[rw] = rings if areas_of([], rings)[3] else [hull_of([p for ring in rings for p in ring])]
            if mw not in maps:
                maps[mw] = rings_of(mw)
            map_area, whole, share, _ = areas_of(maps[mw], regions[rw])
            contained = whole > 0 and share >= whole * (1 - 1e-12)
            if share > whole * 1e-12:
                out.append((m, r, contained, map_area, whole, whole if contained else share, 1.0 if contained else share / whole))
        yield pd.DataFrame(out, columns=["map_shape", "region_shape", "contained", "map_area", "region_area", "overlap_area", "fraction"])


def shape() -> Column:
    """A key of the shape of a row: equal texts (wkt) have the same, null has none."""
    return F.sha2("wkt", 256)


def shape_crosswalk(maps: DataFrame, regions: DataFrame, cell: float = 0.5) -> DataFrame:
    """The crosswalk of shapes: map_shape, region_shape, contained, map_area, region_area, overlap_area, fraction, each pair of different texts once however many maps and regions share them.

    Shapes meet in grid cells of `cell` degrees by their bounds, each pair in the one cell of its overlap's lower corner. Two upright rectangles overlap by their bounds, compared as they are;
    other pairs are cut by one Python function, in which shares of less than 1e-12 of the region count as rounding."""
    def boxed(df: DataFrame, name: str) -> DataFrame:
        shapes = df.where("wkt is not null").select("wkt").distinct().select(shape().alias(name), F.col("wkt").alias(f"{name}_wkt"))
        # What has no bounds is left out only once all are written: the planner would move the condition, and with it the Python function, to the rows before distinct.
        return materialize(shapes.withColumn(f"{name}_box", box(f"{name}_wkt")), "shapes").where(f"{name}_box.x0 is not null")

    span = lambda b, a, z: F.sequence(F.floor(F.col(f"{b}.{a}") / cell), F.floor(F.col(f"{b}.{z}") / cell))
    m, r = boxed(maps, "map_shape"), boxed(regions, "region_shape")
    spread = lambda d, b: d.withColumn("cx", F.explode(span(b, "x0", "x1"))).withColumn("cy", F.explode(span(b, "y0", "y1")))
    a, b = F.col("map_shape_box"), F.col("region_shape_box")
    once = (F.col("cx") == F.floor(F.greatest(a.x0, b.x0) / cell)) & (F.col("cy") == F.floor(F.greatest(a.y0, b.y0) / cell))

    def pairs(m: DataFrame, r: DataFrame) -> DataFrame:
        met = spread(m, "map_shape_box").join(spread(r, "region_shape_box"), ["cx", "cy"])
        return met.where(once & (a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1))

    whole = lambda c: (c.x1 - c.x0) * (c.y1 - c.y0)
    share = (F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)) * (F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    contained = (b.x0 >= a.x0) & (b.x1 <= a.x1) & (b.y0 >= a.y0) & (b.y1 <= a.y1)
    level, others = F.col("map_shape_box.upright"), F.col("region_shape_box.upright")
    boxes = pairs(m.where(level).drop("map_shape_wkt"), r.where(others).drop("region_shape_wkt")).select(
        "map_shape", "region_shape", contained.alias("contained"), whole(a).alias("map_area"), whole(b).alias("region_area"), F.when(contained, whole(b)).otherwise(share).alias("overlap_area"), F.when(contained, 1.0).otherwise(share / whole(b)).alias("fraction")
    )
    rest = pairs(m.where(~level), r).unionByName(pairs(m.where(level), r.where(~others))).select("map_shape", "region_shape", "map_shape_wkt", "region_shape_wkt")
    return boxes.unionByName(rest.mapInPandas(_overlaps, f"map_shape string, region_shape string, {AREAS}"))


def of_rows(walk: DataFrame, maps: DataFrame, regions: DataFrame) -> DataFrame:
    """A crosswalk of shapes for each map (map_id, wkt) and region (region_id, wkt) of theirs: map_id, region_id and what else the walk has."""
    m, r = maps.select("map_id", shape().alias("map_shape")), regions.select("region_id", shape().alias("region_shape"))
    return walk.join(m, "map_shape").join(r, "region_shape").select("map_id", "region_id", *[c for c in walk.columns if c not in ("map_shape", "region_shape")])


def crosswalk(maps: DataFrame, regions: DataFrame, cell: float = 0.5) -> DataFrame:
    """Which part of each region (region_id, wkt) each map (map_id, wkt) covers: map_id, region_id, contained, map_area, region_area,
    overlap_area, fraction. Areas of any shape are cut as they are, with holes and parts; a region whose edges cross is taken as its convex hull. Each pair of shapes is cut once (see shape_crosswalk)."""
    return of_rows(shape_crosswalk(maps, regions, cell), maps, regions)


def weighted_by_overlap(maps: DataFrame, regions: DataFrame, values: list[str]) -> DataFrame:
    """Sums of region values by map, each weighted by the covered fraction: the maps' columns but wkt, n_regions and the values, for the maps that cover any region.

    maps: map_id, wkt and what else is to stay; regions: region_id (distinct), wkt and the values. Regions are read once: those of one shape are summed up before they meet the maps, and maps of one shape are worked out once."""
    totals = materialize(regions.where("wkt is not null").groupBy("wkt").agg(F.count("region_id").alias("n_regions"), *[F.sum(v).alias(v) for v in values]), "totals")
    by_shape = shape_crosswalk(maps, totals).join(totals.withColumn("region_shape", shape()).drop("wkt"), "region_shape").groupBy("map_shape").agg(F.sum("n_regions").alias("n_regions"), *[F.sum(F.col("fraction") * F.col(v)).alias(v) for v in values])
    return maps.withColumn("map_shape", shape()).drop("wkt").join(by_shape, "map_shape").drop("map_shape")


def maps_of(maps: DataFrame, strength: str = "moderate", times: tuple[str, ...] = ("A", "D", "N")) -> DataFrame:
    """The maps of one strength and the given times of day, those that count for their stations."""
    return maps.where((F.col("strength") == strength) & F.col("time_of_day").isin(*times))


def by_station(by_map: DataFrame, maps: DataFrame, values: list[str], strength: str = "moderate", times: tuple[str, ...] = ("A", "D", "N")) -> DataFrame:
    """Means of map values over a station's maps of one strength and the given times of day."""
    m = maps_of(maps, strength, times).select("map_id", "station_id")
    return by_map.join(m, "map_id").groupBy("station_id").agg(*[F.avg(v).alias(v) for v in values])


def by_show(station_values: DataFrame, fractions: DataFrame, values: list[str]) -> DataFrame:
    """Sums of station values by each station's share of the show."""
    return fractions.join(station_values, "station_id").groupBy("show_id").agg(*[F.sum(F.col("station_frac_of_show") * F.col(v)).alias(v) for v in values])


def census_wide(data: DataFrame, geographies: DataFrame, counts: dict[str, list[str]], medians: dict[str, str], population: str, of_tracts: tuple[str, ...] = ()) -> DataFrame:
    """Census variables side by side, in one pivoting aggregate: geography_id, is_group, population and a column for each of `counts` (the sum of several variables) and `medians`.

    data: geography_id, variable, value; geographies: geography_id, tract_code, block_group_code. Measures in `of_tracts` are those of tracts, all others those of block groups; a measure
    is 0 for geographies of the other kind and where it is missing. Geographies without data are left out."""
    value = lambda names: F.sum(F.when(F.col("variable").isin(names), F.col("value")).otherwise(0.0))
    wide = data.groupBy("geography_id").agg(value([population]).alias("population"), *[value(v).alias(k) for k, v in counts.items()], *[value([v]).alias(k) for k, v in medians.items()])
    kinds = geographies.where("tract_code is not null").select("geography_id", F.col("block_group_code").isNotNull().alias("is_group"))
    kept = lambda k: F.when(F.col("is_group") != F.lit(k in of_tracts), F.col(k)).otherwise(0.0).alias(k)
    return wide.join(kinds, "geography_id").select("geography_id", "is_group", "population", *[kept(k) for k in [*counts, *medians]])


def census_by_map(maps: DataFrame, geographies: DataFrame, wide: DataFrame, counts: list[str], medians: list[str]) -> DataFrame:
    """The census of each map (map_id, wkt): n_geos, population (of block groups), sums of counts by covered fraction and means of medians weighted by covered population.

    geographies: geography_id (distinct), wkt; wide as from census_wide. A geography without a measure weighs in its mean with 0, as in the source. Geographies of one shape are summed up
    before they meet the maps, maps of one shape are worked out once; shares of less than 1e-12 do not count."""
    of_group = F.when(F.col("is_group"), F.col("population")).otherwise(0.0)
    totals = geographies.select("geography_id", shape().alias("region_shape")).join(wide, "geography_id").groupBy("region_shape").agg(
        F.count("geography_id").alias("n_geos"), F.sum(of_group).alias("of_groups"), F.sum("population").alias("population"), *[F.sum(c).alias(c) for c in counts], *[F.sum(F.col("population") * F.col(m)).alias(m) for m in medians]
    )
    covered = lambda c: F.sum(F.col("fraction") * F.col(c))
    by_shape = shape_crosswalk(maps, geographies).where("fraction > 1e-12").join(totals, "region_shape").groupBy("map_shape").agg(
        F.sum("n_geos").alias("n_geos"), covered("of_groups").alias("population"), *[covered(c).alias(c) for c in counts], *[F.try_divide(covered(m), covered("population")).alias(m) for m in medians]
    )
    return maps.select("map_id", shape().alias("map_shape")).join(by_shape, "map_shape").drop("map_shape")


def census_by_show(station_values: DataFrame, fractions: DataFrame, counts: list[str], medians: list[str]) -> DataFrame:
    """The census of each show, as convex combinations of its stations' values: population, the share of each count in it (frac_...), and medians."""
    share = lambda c: F.sum(F.col("station_frac_of_show") * F.col(c))
    j = fractions.join(station_values, "station_id")
    return j.groupBy("show_id").agg(share("population").alias("population"), *[F.try_divide(share(c), share("population")).alias("frac_" + c.removeprefix("n_")) for c in counts], *[share(m).alias(m) for m in medians])


def preferred_maps(maps: DataFrame) -> DataFrame:
    """One map a station: the first time of day in alphabetical order, then the smallest id."""
    from tidewave.operators.windows import top_per_group

    return top_per_group(maps, ["station_id"], [F.col("time_of_day"), F.col("map_id")])

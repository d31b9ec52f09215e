"""Geospatial functions and joins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.io import written

KM = 6371.0088


def chord(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """The square of half the chord between two places on a sphere of radius 1; it grows with their distance."""
    p, q = F.radians(lat1), F.radians(lat2)
    return F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)


def arc(h: Column, radius: float = KM) -> Column:
    """Kilometers along the sphere for what chord() gives."""
    return 2 * radius * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = KM) -> Column:
    """Kilometers between two places, null where a coordinate is."""
    return arc(chord(lon1, lat1, lon2, lat2), radius)


def _band(km: float) -> float:
    """Degrees of latitude that km span, a little more."""
    return km / 111.0 + 1e-9


def _columns(y: Column, km: float) -> Column:
    """Cells around the globe in latitude band y, each at least as wide as km anywhere in the band; one where it touches a pole."""
    band, angle = _band(km), km / KM * 1.000001
    top = F.radians(F.least(F.lit(90.0), F.greatest(F.abs(y * band), F.abs((y + 1) * band))))
    width = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(angle)) / F.cos(top))))
    return F.when(top + angle < 1.5707, F.greatest(F.lit(1), F.floor(360 / width))).otherwise(F.lit(1))


def _column(lon: Column, n: Column) -> Column:
    return F.floor((lon + 180) / 360 * n)


def with_cell(df: DataFrame, km: float) -> DataFrame:
    """Adds the cell (_y, _x) of each row's lon and lat in a grid whose cells are at least km wide and high."""
    df = df.withColumn("_y", F.floor(F.col("lat") / _band(km)))
    n = _columns(F.col("_y"), km)
    return df.withColumn("_x", F.pmod(_column(F.col("lon"), n), n))


def with_cells_around(df: DataFrame, km: float) -> DataFrame:
    """The rows once for each cell of that grid in which something can be within km of them; the grid closes at 180 degrees."""
    df = df.withColumn("_y", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("lat") / _band(km)) + d)))
    n = _columns(F.col("_y"), km)
    beside = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(_column(F.col("lon"), n) + d, n))
    return df.withColumn("_x", F.explode(F.array_distinct(beside)))


def in_bbox(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """box is (west, east, south, north), edges included."""
    return lon.between(box[0], box[1]) & lat.between(box[2], box[3])


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed ring, as array of struct(x, y)."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0))


def in_rings(lon: Column, lat: Column, rings: Column) -> Column:
    """Even-odd rule over all edges of all rings, so holes and several parts need no special case. Low edges are inside."""

    def crossings(ring: Column) -> Column:
        edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))
        ax, ay, bx, by = (lambda e: e["a"]["x"]), (lambda e: e["a"]["y"]), (lambda e: e["b"]["x"]), (lambda e: e["b"]["y"])
        hit = lambda e: ((ay(e) > lat) != (by(e) > lat)) & (lon < (bx(e) - ax(e)) * (lat - ay(e)) / (by(e) - ay(e)) + ax(e))
        return F.size(F.filter(edges, hit))

    return F.aggregate(rings, F.lit(0), lambda s, r: s + crossings(r)) % 2 == 1


def bbox_of(rings: Column) -> Column:
    """struct(west, east, south, north) of all points of all rings."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_max(xs).alias("east"), F.array_min(ys).alias("south"), F.array_max(ys).alias("north"))


def _tiles(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


#: A tile of a polygon's cover is cut into so many by so many, so many times.
FANOUT, LEVELS = 8, 2


def _crossings(lon: Column, lat: Column, edges: Column) -> Column:
    """How many edges (ax, ay, bx, by) a ray from a point towards the east crosses. Low ends count."""
    hit = lambda e: ((e["ay"] > lat) != (e["by"] > lat)) & (lon < (e["bx"] - e["ax"]) * (lat - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])
    return F.size(F.filter(edges, hit))


def _once(values: Column) -> Column:
    """Those of the values that occur an odd number of times, in order. Pairs go within short pieces of the sorted values first, so the work stays near linear."""
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    step = lambda acc, v: F.when(last(acc) == v, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(v)))
    fold = lambda xs: F.aggregate(xs, F.array().cast("array<double>"), step)
    whole = F.array_sort(values)
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.size(whole) / 256).cast("int")), lambda k: fold(F.slice(whole, k * 256 + 1, F.lit(256))))
    return fold(F.flatten(pieces))


def _cut(tiles: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """The tiles (..., odd, edges, ends) for the points within x0 to x1, y0 to y1: edges that their rays may or may not cross, and ends of edges to the east.

    Edges that no such ray can cross go. Of edges that lie to the east only the heights of their ends matter: a ray crosses an
    odd number of them where an odd number of ends lie above it. Where two of them meet the ends cancel out, and what lies above the whole
    tile only changes whether it is odd.
    """
    low, high = lambda e: F.least(e["ay"], e["by"]), lambda e: F.greatest(e["ay"], e["by"])

    def reach(e: Column) -> tuple[Column, Column]:
        """The edge's least and largest x within the tile's height, a little more."""
        at = lambda y: (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]
        ends = at(F.greatest(low(e), y0)), at(F.least(high(e), y1))
        return F.least(*ends) - 1e-9, F.greatest(*ends) + 1e-9

    east = lambda e: reach(e)[0] > x1
    there = tiles.withColumn("edges", F.filter("edges", lambda e: (low(e) < y1) & (high(e) > y0) & (reach(e)[1] >= x0)))
    ends = F.flatten(F.transform(F.filter("edges", east), lambda e: F.array(e["ay"], e["by"])))
    cut = there.withColumn("ends", F.concat("ends", ends)).withColumn("edges", F.filter("edges", lambda e: ~east(e)))
    cut = cut.withColumn("odd", F.col("odd") != (F.size(F.filter("ends", lambda y: y >= y1)) % 2 == 1))
    within = F.filter("ends", lambda y: (y > y0) & (y < y1))
    return cut.withColumn("ends", _once(within))


def polygon_cover(polygons: DataFrame, key: str, size: float = 1.0, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(key, level, tx, ty, odd, edges, ends): a cover of each polygon by tiles of size * fanout ** level degrees.

    Tiles that lie inside are as large as the levels allow and hold no edges; those that lie outside are left out. Tiles of
    level 0 that an edge crosses hold the edges that cross them, and what edges to the east add: where their chains end, and whether
    a ray crosses an odd number of the others.
    """
    edge = lambda r: F.transform(F.arrays_zip(F.slice(r, 1, F.size(r) - 1).alias("a"), F.slice(r, 2, F.size(r) - 1).alias("b")), lambda e: F.struct(e["a"]["x"].alias("ax"), e["a"]["y"].alias("ay"), e["b"]["x"].alias("bx"), e["b"]["y"].alias("by")))
    edges = F.filter(F.flatten(F.transform("rings", lambda r: F.when(F.size(r) > 1, edge(r)).otherwise(F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>")))), lambda e: e["ay"] != e["by"])
    box, top = bbox_of(F.col("rings")), size * fanout**levels
    tiles = polygons.where(F.size(F.flatten("rings")) > 0).select(key, box.alias("_box"), F.lit(False).alias("odd"), edges.alias("edges"), F.array().cast("array<double>").alias("ends"))
    tiles = tiles.withColumn("tx", F.explode(_tiles(F.col("_box.west"), F.col("_box.east"), top))).withColumn("ty", F.explode(_tiles(F.col("_box.south"), F.col("_box.north"), top))).drop("_box")
    found = []
    for level in range(levels, -1, -1):
        wide = size * fanout**level
        cut = _cut(tiles, F.col("tx") * wide, F.col("ty") * wide, (F.col("tx") + 1) * wide, (F.col("ty") + 1) * wide)
        open_tile = (F.size("edges") > 0) | (F.size("ends") > 0)
        cut = written(cut.where(open_tile | F.col("odd")).select(key, F.lit(level).alias("level"), "tx", "ty", "odd", "edges", "ends"))
        if level == 0:
            found.append(cut)
            break
        found.append(cut.where(~open_tile))
        each = F.sequence(F.lit(0), F.lit(fanout - 1))
        tiles = cut.where(open_tile).withColumn("_i", F.explode(each)).withColumn("_j", F.explode(each))
        tiles = tiles.select(key, (F.col("tx") * fanout + F.col("_i")).alias("tx"), (F.col("ty") * fanout + F.col("_j")).alias("ty"), "odd", "edges", "ends")
    return reduce(DataFrame.unionByName, found)


def pip_join(points: DataFrame, polygons: DataFrame, size: float = 1.0, how: str = "inner", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Points (lon, lat) with the polygons (rings) that hold them: an equi-join on the tiles of their cover.

    A point looks in one tile of each level. In a tile that lies inside it is held without a test, in another one the tile's
    edges decide. Rings stay in one row a polygon. how is inner, left_semi or left_anti.
    """
    numbered = written(polygons.withColumn("_pid", F.monotonically_increasing_id()))
    cover = polygon_cover(numbered.select("_pid", "rings"), "_pid", size, fanout, levels).alias("q")
    places = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("lon") / (size * fanout**k)).alias("tx"), F.floor(F.col("lat") / (size * fanout**k)).alias("ty")) for k in range(levels + 1)])
    above = F.size(F.filter("q.ends", lambda y: y > F.col("p.lat")))
    inside = F.col("q.odd") != ((_crossings(F.col("p.lon"), F.col("p.lat"), F.col("q.edges")) + above) % 2 == 1)

    def met(looking: DataFrame) -> DataFrame:
        p = looking.withColumn("_t", F.explode(places)).alias("p")
        on = (F.col("p._t.level") == F.col("q.level")) & (F.col("p._t.tx") == F.col("q.tx")) & (F.col("p._t.ty") == F.col("q.ty")) & inside
        return p.join(cover, on)

    if how == "inner":
        return met(points).select(*[F.col(f"p.{c}") for c in points.columns], "q._pid").join(numbered, "_pid").drop("_pid")
    spots = points.select("lon", "lat").distinct()
    held = met(spots).select(F.col("p.lon").alias("_lon"), F.col("p.lat").alias("_lat")).distinct()
    return points.join(held, (F.col("lon") == F.col("_lon")) & (F.col("lat") == F.col("_lat")), how)


def reverse_geocode(points: DataFrame, cells: DataFrame, parents: DataFrame, decimals: int = 4) -> DataFrame:
    """Points with the cell (cell_id, code) and parent (prefix, parent) that hold them; one look-up per rounded place.

    Of several cells the smallest id wins; the parent follows from the code's first two digits.
    """
    spots = points.select(F.round("lon", decimals).alias("lon"), F.round("lat", decimals).alias("lat")).distinct()
    first = pip_join(spots, cells.select("cell_id", "code", "rings")).groupBy("lon", "lat").agg(F.min_by(F.struct("cell_id", "code"), "cell_id").alias("c"))
    named = first.select("lon", "lat", "c.*").withColumn("prefix", F.substring("code", 1, 2)).join(parents, "prefix", "left")
    named = named.select(F.col("lon").alias("_x"), F.col("lat").alias("_y"), "cell_id", "code", "parent")
    return points.join(named, (F.round("lon", decimals) == F.col("_x")) & (F.round("lat", decimals) == F.col("_y")), "left").drop("_x", "_y")


def features_near(features: DataFrame, points: DataFrame, home: tuple[float, float, float, float], pad: float = 3.0, most_rank: int = 6, size: float = 3.0) -> DataFrame:
    """Features (west, east, south, north, rank) that meet the home box, or come within pad degrees of a point outside it."""
    ranked = features.where(F.col("rank") <= most_rank)
    meets = (F.col("west") <= home[1]) & (F.col("east") >= home[0]) & (F.col("south") <= home[3]) & (F.col("north") >= home[2])
    away = points.where(~in_bbox(F.col("lon"), F.col("lat"), home)).select("lon", "lat").distinct()
    keyed = away.withColumn("_tx", F.floor(F.col("lon") / size)).withColumn("_ty", F.floor(F.col("lat") / size))
    rest = ranked.where(~meets)
    tiled = rest.withColumn("_tx", F.explode(_tiles(F.col("west") - pad, F.col("east") + pad, size))).withColumn("_ty", F.explode(_tiles(F.col("south") - pad, F.col("north") + pad, size)))
    close = F.col("lon").between(F.col("west") - pad, F.col("east") + pad) & F.col("lat").between(F.col("south") - pad, F.col("north") + pad)
    hit = tiled.join(keyed, ["_tx", "_ty"]).where(close).select(*features.columns).distinct()
    return ranked.where(meets).unionByName(hit)


def features_in_use(features: DataFrame, names: DataFrame) -> DataFrame:
    """Features whose (level, name) some row uses."""
    return features.join(names, ["level", "name"], "left_semi")


def polygons_hit(polygons: DataFrame, points: DataFrame, key: str, size: float = 1.0) -> DataFrame:
    """Polygons that hold at least one point."""
    return polygons.join(pip_join(points.select("lon", "lat").distinct(), polygons.select(key, "rings"), size).select(key).distinct(), key, "left_semi")


#: Cells of the tree are cut into so many by so many, so many times; cells with at most so many members are not cut.
CUT, DEEPEST, BOUND = 8, 7, 64


def _tree_cell() -> tuple[Column, Column]:
    """The smallest cell (tx, ty) of a row's lon and lat in the tree; 180 degrees east belongs to the easternmost one."""
    n = CUT**DEEPEST
    at = lambda v, low, size: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - low) / size * n))).cast("long")
    return at(F.col("lon"), -180, 360), at(F.col("lat"), -90, 180)


def _cell_bounds(lon: Column, lat: Column, n: Column, tx: Column, ty: Column) -> tuple[Column, Column]:
    """Kilometers that a place is from every point of a cell at least, and at most, with a little room for rounding."""
    west, east, south, north = tx * 360.0 / n - 180, (tx + 1) * 360.0 / n - 180, ty * 180.0 / n - 90, (ty + 1) * 180.0 / n - 90
    around = lambda d: F.least(F.pmod(d, F.lit(360.0)), 360 - F.pmod(d, F.lit(360.0)))
    beside = F.when(lon.between(west, east), 0.0).otherwise(F.least(around(lon - west), around(lon - east)))
    above = F.greatest(F.lit(0.0), south - lat, lat - north)
    # a meridian is reached on the great circle that meets it at a right angle, or at a pole
    to_meridian = F.when(beside < 90, F.degrees(F.asin(F.least(F.lit(1.0), F.cos(F.radians(lat)) * F.sin(F.radians(beside)))))).otherwise(90 - F.abs(lat))
    widest = F.when(F.pmod(lon + 180 - west, F.lit(360.0)) <= east - west, 180.0).otherwise(F.greatest(around(lon - west), around(lon - east)))
    # along the place's own parallel, then along the meridian
    farthest = widest * F.cos(F.radians(lat)) + F.greatest(F.abs(lat - south), F.abs(north - lat))
    to_km = KM * math.pi / 180
    return F.greatest(above, to_meridian) * to_km * 0.999999999 - 1e-6, farthest * to_km * 1.000000001 + 1e-6


def nearest(rows: DataFrame, members: DataFrame, on: list[str], key: str, member: str, k: int, penalty: Column | None = None, part: str | None = None, bound: int = BOUND, itself: bool = True) -> DataFrame:
    """(on, key, member, km, score): candidates that hold each row's k members of least score, km plus penalty, in its group; ties by member.

    penalty depends on the row's columns and the members' column part; with itself, a row is no member of its own. The members of a group and part stand in a tree of
    cells, each cut until it holds at most bound places or is as small as cells get (about 20 m). A row walks down the trees of its
    group, level by level: the cells that surely hold k members bound the score, cells that cannot reach it are dropped.
    At the end a row meets the members of a few cells with bound places each, however dense the members are around it. Of
    the members at one place only the first k + 1 count. Places without coordinates are left out.
    """
    tree = [*on, *([part] if part else [])]
    w = W.partitionBy(*tree, "lon", "lat").orderBy(member)
    spots = members.select(*tree, member, "lon", "lat").where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).withColumn("_i", F.row_number().over(w))
    spots = written(spots.where(F.col("_i") <= k + 1).drop("_i"))
    finest = spots.withColumns(dict(zip(("tx", "ty"), _tree_cell(), strict=True))).groupBy(*tree, "tx", "ty").agg(F.count("*").alias("n"))
    levels = {DEEPEST: written(finest)}
    for level in range(DEEPEST - 1, -1, -1):
        up = levels[level + 1].groupBy(*tree, F.floor(F.col("tx") / CUT).alias("tx"), F.floor(F.col("ty") / CUT).alias("ty"))
        levels[level] = written(up.agg(F.sum("n").alias("n")))
    seekers = rows.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    own = [c for c in seekers.columns if c not in ("tx", "ty", "n", "level")]
    cells = seekers.select(*own).join(levels[0], on).withColumn("level", F.lit(0)).withColumn("_more", penalty if penalty is not None else F.lit(0.0))
    for level in range(DEEPEST + 1):
        low, high = _cell_bounds(F.col("lon"), F.col("lat"), F.pow(F.lit(float(CUT)), F.col("level")), F.col("tx"), F.col("ty"))
        bounds = cells.withColumn("_low", low + F.col("_more")).withColumn("_high", high + F.col("_more"))
        by = W.partitionBy(*on, key)
        sure = F.sum("n").over(by.orderBy("_high").rangeBetween(W.unboundedPreceding, 0))
        # the row itself may be one of the members
        reach = bounds.withColumn("_sure", F.when(sure >= k + 1, F.col("_high"))).withColumn("_reach", F.min("_sure").over(by))
        kept = written(reach.where(F.col("_reach").isNull() | (F.col("_low") <= F.col("_reach"))).drop("_low", "_high", "_sure", "_reach"))
        whole = (F.col("n") > bound) & (F.col("level") == level)
        if level == DEEPEST or not kept.where(whole).limit(1).collect():
            break
        below = levels[level + 1].select(*tree, F.floor(F.col("tx") / CUT).alias("tx"), F.floor(F.col("ty") / CUT).alias("ty"), F.col("tx").alias("_tx"), F.col("ty").alias("_ty"), F.col("n").alias("_n"))
        finer = kept.where(whole).join(below, [*tree, "tx", "ty"]).drop("tx", "ty", "n", "level").withColumnsRenamed({"_tx": "tx", "_ty": "ty", "_n": "n"}).withColumn("level", F.lit(level + 1))
        cells = kept.where(~whole).unionByName(finer)
    x, y = _tree_cell()
    places = F.array(*[F.struct(F.lit(n).alias("level"), F.floor(x / CUT ** (DEEPEST - n)).alias("tx"), F.floor(y / CUT ** (DEEPEST - n)).alias("ty")) for n in range(DEEPEST + 1)])
    there = spots.select(*tree, member, F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.explode(places).alias("_c")).select(*tree, member, "_lon", "_lat", "_c.*")
    met = kept.drop("n").join(there, [*tree, "level", "tx", "ty"]).where(F.col(key) != F.col(member) if itself else F.lit(True))
    km = haversine(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))
    return met.select(*on, key, member, km.alias("km"), (km + F.col("_more")).alias("score"))


def min_distance(rows: DataFrame, anchors: DataFrame, on: list[str], key: str, bound: int = BOUND) -> DataFrame:
    """(on, key, km): each row's least distance to the anchors of its group; rows of groups without anchors are left out. Anchors at one place count once."""
    places = anchors.select(*on, "lon", "lat").distinct().withColumn("_place", F.monotonically_increasing_id())
    near = nearest(rows.select(*on, F.col(key).alias("_key"), "lon", "lat"), written(places), on, "_key", "_place", 1, bound=bound, itself=False)
    return near.groupBy(*on, F.col("_key").alias(key)).agg(F.min("km").alias("km"))


def distance_bands(candidates: DataFrame, key: str, similarity: float = 0.8) -> DataFrame:
    """(key, best_m, status) from candidates (has_source, name_similarity, distance_m): the best distance whose name is supported, if the source has a coordinate."""
    known, supported = F.bool_or("has_source"), F.when((F.col("name_similarity") >= similarity) & ~F.isnan("distance_m"), F.col("distance_m"))
    out = candidates.groupBy(key).agg(F.min(supported).alias("best_m"), F.coalesce(known, F.lit(False)).alias("_known"))
    # fixed values: names of the bands
    status = (
        F.when(~F.col("_known"), "unavailable")
        .when(F.col("best_m").isNull(), "no_name_supported_candidate")
        .when(F.col("best_m") < 500, "aligned_under_500m")
        .when(F.col("best_m") < 2000, "near_500m_to_2km")
        .otherwise("conflict_over_2km")
    )
    return out.select(key, F.when(F.col("_known"), F.col("best_m")).alias("best_m"), status.alias("status"))


def legs(route: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Route points with the distance km from the point before; null at the first."""
    w = W.partitionBy(group).orderBy(*order)
    return route.withColumn("km", haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")))


def route_length(route: DataFrame, group: str, order: list[str]) -> DataFrame:
    return legs(route, group, order).groupBy(group).agg(F.coalesce(F.sum("km"), F.lit(0.0)).alias("km"), F.count("*").alias("points"))


def long_legs(route: DataFrame, group: str, order: list[str], time: str, least: float = 500.0) -> DataFrame:
    """Legs longer than least km, with the hours since the point before (time in microseconds)."""
    w = W.partitionBy(group).orderBy(*order)
    hours = (F.col(time) - F.lag(time).over(w)) / 3.6e9
    return legs(route.withColumn("gap_hours", hours), group, order).where(F.col("km") > least)


def mercator(lon: Column, lat: Column) -> Column:
    """struct(x, y) in the unit square of the Web Mercator map."""
    y = (1 - F.ln(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / F.pi()) / 2
    return F.struct(((lon + 180) / 360).alias("x"), y.alias("y"))


def mercator_extent(points: DataFrame, group: str, least: float = 0.0005) -> DataFrame:
    """(group, x0, x1, y0, y1, span): each group's extent; span is the larger side, least at least."""
    m = points.withColumn("_m", mercator(F.col("lon"), F.col("lat")))
    box = m.groupBy(group).agg(F.min("_m.x").alias("x0"), F.max("_m.x").alias("x1"), F.min("_m.y").alias("y0"), F.max("_m.y").alias("y1"))
    return box.withColumn("span", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(least)))


def label_centroids(points: DataFrame, group: str, names: list[str], order: str, most: int = 8) -> DataFrame:
    """(group, name, lon, lat, n): mean position per finest name that is not empty, the first names by appearance."""
    name = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in names])
    out = points.withColumn("name", name).where(F.col("name").isNotNull()).groupBy(group, "name").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count("*").alias("n"), F.min(order).alias("_first"))
    return out.withColumn("_rank", F.row_number().over(W.partitionBy(group).orderBy("_first", "name"))).where(F.col("_rank") <= most).drop("_first", "_rank")

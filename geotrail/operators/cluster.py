"""Clustering in space and time. Intermediate tables are written to the shared folder, so lost executors cost no labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.geo import haversine, with_cell
from ..sources.io import written
from .joins import DAY, st_near, st_pair_totals, st_pairs


def neighbor_rule(visits: DataFrame, near: tuple[float, float] = (5, 100), travel: tuple[float, float] = (2, 2500), supported: str | None = None, digits: dict[str, int] | None = None) -> DataFrame:
    """(left, right, kind, gap_days, km): near within (days, km); travel_transition within other limits if both ends are supported. digits rounds gap_days and km."""
    pairs = st_pairs(visits, near[0], near[1], digits=digits).withColumn("kind", F.lit("near"))
    if supported is None:
        return pairs.select("left", "right", "kind", "gap_days", "km")
    far = st_pairs(visits.where(F.col(supported)), travel[0], travel[1], beyond=near, digits=digits).withColumn("kind", F.lit("travel_transition"))
    return pairs.unionByName(far).select("left", "right", "kind", "gap_days", "km")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds 0, 1, ... in order of a unique column: ranges of it are numbered on their own and put one after the other."""
    dealt = written(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row for each range
    inside = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    return dealt.withColumn("_i", inside).join(before, "_part").withColumn(name, F.col("_before") + F.col("_i")).drop("_part", "_i", "_before")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(v, label): for every node v the least node that links (a, b), given both ways, connect it with.

    Nodes pass on the least label and jump along labels until nothing changes; every round is a written table.
    """
    labels = nodes.select("v", F.col("v").alias("label"))
    while True:
        near = links.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        low = written(labels.join(near, "v", "left").select("v", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")))
        jump = low.select(F.col("v").alias("label"), F.col("label").alias("next"))
        done = written(low.join(jump, "label").select("v", "old", F.least("label", "next").alias("label")))
        labels = done.select("v", "label")
        if not done.where("old <> label").limit(1).collect():
            return labels


def _labelled(visits: DataFrame, cores: DataFrame, beside: DataFrame, key: str, time: str) -> DataFrame:
    """(key, cluster, role) from cores (id, t, label) and the neighbours beside (left, right) of all that are no cores."""
    first = cores.groupBy("label").agg(F.min(F.struct("t", "id")).alias("first"))
    core = written(cores.join(numbered(first, "first", "cluster").select("label", "cluster"), "label").select("id", "cluster"))
    border = beside.join(core.select(F.col("id").alias("right"), "cluster"), "right").join(core.select(F.col("id").alias("left")), "left", "left_anti")
    border = border.groupBy(F.col("left").alias("id")).agg(F.min("cluster").alias("cluster")).withColumn("role", F.lit("border"))
    out = core.withColumn("role", F.lit("core")).unionByName(border).withColumnRenamed("id", key)
    return visits.select(key).join(out, key, "left").withColumn("role", F.coalesce("role", F.lit("noise")))


def st_dbscan(visits: DataFrame, edges: DataFrame, min_samples: int = 2, key: str = "visit_id", time: str = "t") -> DataFrame:
    """(key, cluster, role) under any neighbour rule, given as edges (left, right).

    Cores have min_samples - 1 neighbours at least; cores that are neighbours share a cluster; clusters are numbered by their
    earliest core. A border visit goes to the lowest cluster beside it; the rest are noise with a null cluster.
    """
    all_visits = visits.select(F.col(key).alias("id"), F.col(time).alias("t"))
    both = written(edges.select("left", "right").unionByName(edges.select(F.col("right").alias("left"), F.col("left").alias("right"))).distinct())
    cores = written(both.groupBy(F.col("left").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= min_samples - 1).join(all_visits, "id").select("id", "t")) if min_samples > 1 else all_visits
    links = written(both.join(cores.select(F.col("id").alias("left")), "left").join(cores.select(F.col("id").alias("right")), "right").select(F.col("left").alias("a"), F.col("right").alias("b")))
    labels = components(cores.select(F.col("id").alias("v")), links)
    return _labelled(visits, cores.join(labels.withColumnRenamed("v", "id"), "id"), both, key, time)


def _apart(one: str, other: str) -> Column:
    """Kilometers between two points (t, lon, lat), or columns of that kind."""
    return haversine(F.col(f"{one}.lon"), F.col(f"{one}.lat"), F.col(f"{other}.lon"), F.col(f"{other}.lat"))


def st_dbscan_near(visits: DataFrame, days: float, km: float, min_samples: int = 2, key: str = "visit_id", time: str = "t") -> DataFrame:
    """What st_dbscan() gives for neighbours within days and km, without a list of all pairs.

    Cells in space and time are so small that all visits of one are neighbours. Where a cell has min_samples visits, all are
    cores and one unit; only the visits of other cells list their neighbours. Units are linked by their bounds, by their
    first and last visits, and, where that leaves them apart, visit by visit.
    """
    rows = visits.select(F.col(key).alias("id"), F.col(time).alias("t"), "lon", "lat")
    placed = with_cell(rows.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()), km * 0.6).withColumn("_b", F.floor(F.col("t") / int(days * DAY)))
    place, at = ["_b", "_y", "_x"], F.struct("t", "lon", "lat")
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    cells = placed.groupBy(*place).agg(F.min("id").alias("cell"), F.count("*").alias("n"), F.min_by(at, F.struct("t", "id")).alias("first"), F.max_by(at, F.struct("t", "id")).alias("last"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("lon", "lat") for f in (F.min, F.max)])
    cells = cells.withColumns({"sw": corner("min_lon", "min_lat"), "ne": corner("max_lon", "max_lat"), "nw": corner("min_lon", "max_lat"), "se": corner("max_lon", "min_lat")})
    cells = cells.withColumn("size", F.greatest(_apart("sw", "ne"), _apart("nw", "se"), _apart("sw", "se"), _apart("nw", "ne")))
    dense = (F.col("n") >= min_samples) & (F.col("size") <= 0.98 * km)
    cells = written(cells.withColumn("dense", dense))
    members = written(placed.join(cells.select(*place, "cell", "dense"), place).select("id", "t", "lon", "lat", "cell", "dense"))
    beside = written(st_near(members.where("not dense"), members, days, km))
    sparse = beside.groupBy(F.col("left").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= min_samples - 1).select("id")
    if min_samples <= 1:
        sparse = rows.select("id").join(members.where("dense"), "id", "left_anti")
    cores = written(members.where("dense").select("id", "t", F.col("cell").alias("unit")).unionByName(rows.join(sparse, "id").select("id", "t", F.col("id").alias("unit"))))

    unit = lambda side: cores.select(F.col("id").alias(side), F.col("unit").alias(f"u_{side}"))
    links = beside.join(unit("left"), "left").join(unit("right"), "right").select(F.col("u_left").alias("a"), F.col("u_right").alias("b"))
    known = cells.where("dense").select("cell", "first", "last", "size", F.struct(((F.col("min_lon") + F.col("max_lon")) / 2).alias("lon"), ((F.col("min_lat") + F.col("max_lat")) / 2).alias("lat")).alias("middle"))
    centers = known.select(F.col("cell").alias("id"), F.col("first.t").alias("t"), "middle.*")
    pairs = st_near(centers, centers, 2 * days, 2 * km).where("left < right")  # cells whose visits may be neighbours: each is shorter than days and smaller than km
    side = lambda n: known.select(F.col("cell").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in known.columns[1:]])
    pairs = pairs.join(side("left"), "left").join(side("right"), "right")
    whole = F.greatest("left_last.t", "right_last.t") - F.least("left_first.t", "right_first.t")
    sure = (whole / DAY <= days) & (_apart("left_middle", "right_middle") + F.col("left_size") + F.col("right_size") <= km)
    gap = F.greatest(F.lit(0), F.col("right_first.t") - F.col("left_last.t"), F.col("left_first.t") - F.col("right_last.t"))
    never = (gap / DAY > days) | (_apart("left_middle", "right_middle") - F.col("left_size") - F.col("right_size") > km)
    met = F.lit(False)
    for x in ("left_first", "left_last"):
        for y in ("right_first", "right_last"):
            met = met | ((F.abs(F.col(f"{x}.t") - F.col(f"{y}.t")) / DAY <= days) & (_apart(x, y) <= km))
    judged = written(pairs.where(~never).select("left", "right", (sure | met).alias("linked")))

    def joined(found: DataFrame) -> DataFrame:
        return written(found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())

    units = cores.select(F.col("unit").alias("v")).distinct()
    links = joined(links.unionByName(judged.where("linked").select(F.col("left").alias("a"), F.col("right").alias("b"))))
    labels = components(units, links)
    label = lambda n: labels.select(F.col("v").alias(n), F.col("label").alias(f"l_{n}"))
    rest = written(judged.where("not linked").join(label("left"), "left").join(label("right"), "right").where("l_left <> l_right").select("left", "right"))
    if rest.limit(1).collect():
        inside = lambda n: members.where("dense").select(F.col("cell").alias(n), F.struct("t", "lon", "lat").alias(f"{n}_x"))
        close = rest.join(inside("left"), "left").join(inside("right"), "right").where((F.abs(F.col("left_x.t") - F.col("right_x.t")) / DAY <= days) & (_apart("left_x", "right_x") <= km))
        more = joined(close.select(F.col("left").alias("a"), F.col("right").alias("b")).distinct())
        labels = components(units, links.unionByName(more))
    return _labelled(visits, cores.join(labels.withColumnRenamed("v", "unit"), "unit").select("id", "t", "label"), beside, key, time)


def _recorded(m: DataFrame, per: DataFrame, time: str) -> DataFrame:
    """The record of each cluster from its members and (cluster, edges, transitions, longest_km)."""
    record = m.groupBy("cluster").agg(
        F.count("*").alias("visits"), F.min(time).alias("start"), F.max(time).alias("end"), F.array_sort(F.collect_set("city")).alias("cities"), F.array_sort(F.collect_set("province")).alias("provinces")
    )
    out = record.join(per, "cluster", "left").fillna(0, ["edges", "transitions"])
    days = (F.col("end") - F.col("start")) / DAY
    flags = F.array_compact(F.array(F.when(days > 14, "long_span"), F.when(F.size("provinces") > 3, "many_provinces"), F.when(F.col("transitions") > 0, "has_transition")))
    return out.withColumn("days", days).withColumn("flags", flags)


def cluster_records(members: DataFrame, edges: DataFrame, key: str = "visit_id", time: str = "t") -> DataFrame:
    """Per cluster: span, days, distinct places in order, edges inside by kind, the longest, and flags."""
    m = members.where(F.col("cluster").isNotNull())
    side = lambda c: m.select(F.col(key).alias(c), F.col("cluster").alias(f"_{c}"))
    inside = edges.join(side("left"), "left").join(side("right"), "right").where(F.col("_left") == F.col("_right"))
    per = inside.groupBy(F.col("_left").alias("cluster")).agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == "travel_transition").alias("transitions"), F.max("km").alias("longest_km"))
    return _recorded(m, per, time)


def cluster_records_near(members: DataFrame, days: float, km: float, key: str = "visit_id", time: str = "t") -> DataFrame:
    """What cluster_records() gives for all neighbours within days and km, without a list of them: pairs inside a cluster are counted, most of them many at once."""
    m = members.where(F.col("cluster").isNotNull())
    per = st_pair_totals(m, days, km, "cluster", key, time).withColumn("transitions", F.lit(0).cast("long"))
    return _recorded(m, per, time)


def sweep(visits: DataFrame, configs: dict[str, dict], supported: Column | None = None) -> DataFrame:
    """One row per parameter set: clusters, members, noise, and quantiles of the cluster sizes."""
    rows = []
    for name, c in configs.items():
        labels = written(st_dbscan_near(visits, *c["near"], c["min_samples"]))
        sizes = labels.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("size"))
        totals = labels.agg(F.count("*").alias("visits"), F.count_if(F.col("cluster").isNotNull()).alias("members"), F.count_if(F.col("role") == "noise").alias("noise"))
        shape = sizes.agg(F.count("*").alias("clusters"), F.percentile("size", F.lit(0.5)).alias("median_size"), F.max("size").alias("largest"))
        rows.append(totals.withColumn("config", F.lit(name)).join(shape.withColumn("config", F.lit(name)), "config"))
    return reduce(DataFrame.unionByName, rows)


def noise(anchors: DataFrame, members: DataFrame, key: str = "visit_id") -> DataFrame:
    return anchors.join(members, key, "left_anti")

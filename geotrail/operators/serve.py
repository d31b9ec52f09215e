"""Serving queries over finished tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.geo import BOUND, haversine, nearest, with_cell, with_cells_around
from ..sources.io import written
from .rollups import paged_lists


def search_trips(trips: DataFrame, text: str | None = None, years: tuple[int, int] | None = None, province: str | None = None, city: str | None = None, kind: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """Trips (text, year, provinces, cities, kind, start) that meet all conditions given, by start and id.

    With an index() of the texts, a text of GRAM letters or more is looked up there, and only the trips found are read for it.
    """
    out = trips
    if text:
        found = indexed(index, text.lower()) if index is not None else None
        if found is not None:
            out = out.join(found, "trip_id", "left_semi")
        out = out.where(F.contains("text", F.lit(text.lower())))
    if years:
        out = out.where(F.col("year").between(*years))
    if province is not None:
        out = out.where(F.array_contains("provinces", province))
    if city is not None:
        out = out.where(F.array_contains("cities", city))
    if kind:
        out = out.where(F.col("kind") == kind)
    return out.orderBy("start", "trip_id")


#: Letters of an index entry; folders that the entries are dealt to; entries of a query that are looked up, the rarest.
GRAM, FOLDERS, LOOKED_UP = 3, 64, 4


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def index(documents: DataFrame) -> DataFrame:
    """(gram, trip_id, n, trips, folder): a written index of documents (trip_id, text): every sequence of GRAM letters with the trips that hold it, how often, and how many do.

    It is partitioned by folder, so that a look-up reads the folders of its sequences only.
    """
    places = F.when(F.length("text") >= GRAM, F.sequence(F.lit(1), F.length("text") - GRAM + 1))
    grams = documents.select("trip_id", F.explode(F.transform(places, lambda k: F.substring(F.col("text"), k, F.lit(GRAM)))).alias("gram"))
    postings = grams.groupBy("gram", "trip_id").agg(F.count("*").alias("n"))
    postings = written(postings)
    sized = postings.join(postings.groupBy("gram").agg(F.count("*").alias("trips")), "gram")
    return written(sized.withColumn("folder", _folder(F.col("gram"))).repartitionByRange("folder", "gram", "trip_id"), "folder")


def indexed(index: DataFrame, text: str) -> DataFrame | None:
    """(trip_id) of the trips that hold the rarest sequences of a text as often as it does, so of all that hold the text; None where it is too short."""
    wanted: dict[str, int] = {}
    for k in range(len(text) - GRAM + 1):
        wanted[text[k : k + GRAM]] = wanted.get(text[k : k + GRAM], 0) + 1
    if not wanted:
        return None
    spark = index.sparkSession
    grams = spark.createDataFrame(list(wanted.items()), "gram string, least long").withColumn("folder", _folder(F.col("gram")))
    folders = [r["folder"] for r in grams.select("folder").distinct().collect()]
    there = index.where(F.col("folder").isin(folders) & F.col("gram").isin(list(wanted)))
    counts = {r["gram"]: r["trips"] for r in there.groupBy("gram").agg(F.first("trips").alias("trips")).collect()}
    rarest = sorted(wanted, key=lambda g: (counts.get(g, 0), g))[:LOOKED_UP]
    held = there.where(F.col("gram").isin(rarest)).join(grams.select("gram", "least"), "gram").where(F.col("n") >= F.col("least"))
    return held.groupBy("trip_id").agg(F.count("*").alias("_n")).where(F.col("_n") == len(rarest)).select("trip_id")


def search_documents(trips: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """(trip_id, text): one lower-case text per trip from its title and ordered parts (trip_id, position, text), white space removed."""
    rows = trips.select("trip_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("position"), F.col("title").alias("text"))
    for k, p in enumerate(parts):
        rows = rows.unionByName(p.select("trip_id", F.lit(k).alias("part"), F.col("position").cast("long").alias("position"), "text"))
    lists = rows.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("part", "position", "text"))).alias("l"))
    return lists.select("trip_id", F.lower(F.regexp_replace(F.concat_ws("|", F.transform("l", lambda x: x["text"])), r"\s+", "")).alias("text"))


def region_option(visits: DataFrame, regions: DataFrame, places: DataFrame) -> DataFrame:
    """(visit_id, region_key): province/city of the region, else of the place, else a wide area."""
    out = visits.join(regions, "region_id", "left").join(places, "place_id", "left")
    key = lambda p, c: F.when(F.col(p).isNotNull(), F.concat_ws("/", p, c))
    wide = F.when(F.col("domestic"), "domestic").otherwise("overseas")
    return out.select("visit_id", F.coalesce(key("region_province", "region_city"), key("place_province", "place_city"), wide).alias("region_key"))


def place_pages(places: DataFrame, visits: DataFrame, members: DataFrame, size: int = 10_000) -> DataFrame:
    """(place_id, kind, page, ids): each place's distinct posts, and the trips that hold a visit there, in pages of at most size; a place without any has an empty page."""
    posts = visits.select("place_id", F.lit("post").alias("kind"), F.col("post_id").cast("string").alias("id"))
    trips = visits.join(members, "visit_id").select("place_id", F.lit("trip").alias("kind"), F.col("trip_id").cast("string").alias("id"))
    pages = paged_lists(posts.unionByName(trips), ["place_id", "kind"], "id", size, "ids")
    kinds = places.select("place_id", F.explode(F.array(F.lit("post"), F.lit("trip"))).alias("kind"))
    return kinds.join(pages, ["place_id", "kind"], "left").withColumns({"page": F.coalesce("page", F.lit(0)), "ids": F.coalesce("ids", F.array().cast("array<string>"))})


def region_pages(posts: DataFrame, region: str, order: list[Column], n: int = 6) -> DataFrame:
    """The first posts of each region."""
    return posts.withColumn("position", F.row_number().over(W.partitionBy(region).orderBy(*order))).where(F.col("position") <= n)


def trip_details(members: DataFrame, visit_posts: DataFrame) -> DataFrame:
    """(trip_id, visit_id, sequence, posts): each trip's nodes with their posts in order."""
    lists = visit_posts.groupBy("visit_id").agg(F.array_sort(F.collect_list("post_id")).alias("posts"))
    return members.join(lists, "visit_id", "left").withColumn("posts", F.coalesce("posts", F.array()))


def food_evidence(visits: DataFrame, own: Column, evidence: DataFrame, key: str) -> DataFrame:
    """Visits with has_food: own evidence, or any of their posts' (key); without it the role becomes context."""
    hits = evidence.select(key).distinct().withColumn("_e", F.lit(True))
    out = visits.join(hits, key, "left").withColumn("has_food", own | F.coalesce("_e", F.lit(False))).drop("_e")
    return out.withColumn("role", F.when(F.col("has_food"), F.col("role")).otherwise("context"))


def public_post(posts: DataFrame, whitelist: list[str], labels: str | None = None, most: int = 24) -> DataFrame:
    """The listed columns of a post, and the first labels without their confidence."""
    extra = [F.transform(F.slice(labels, 1, most), lambda x: x["name"]).alias(labels)] if labels else []
    return posts.select(*whitelist, *extra)


def neighborhoods(visits: DataFrame, km: float, need: int, group: str = "region_group") -> DataFrame:
    """(visit_id, neighbors, viable): other visits of the same group within km; viable with need - 1 at least.

    Visits of one place have the same neighbours, so places are compared, by grid cells, each with the number of its visits.
    """
    places = written(visits.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).groupBy(group, "lon", "lat").agg(F.count("*").alias("n")))
    a, b = with_cells_around(places, km), with_cell(places, km).select(group, "_y", "_x", "n", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    near = a.drop("n").join(b, [group, "_y", "_x"]).where(haversine(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")) <= km)
    counts = near.groupBy(group, "lon", "lat").agg((F.sum("n") - 1).alias("neighbors"))
    out = visits.select("visit_id", group, "lon", "lat").join(counts, [group, "lon", "lat"], "left").select("visit_id", F.coalesce("neighbors", F.lit(0)).alias("neighbors"))
    return out.withColumn("viable", F.col("neighbors") >= need - 1)


def nearest_k(anchors: DataFrame, members: DataFrame, group: str, k: int, year_weight: float = 60.0, seed: int | None = None, bound: int = BOUND) -> DataFrame:
    """(anchor_id, visit_id, score, rank): each anchor's first members by km and years apart, to a millimeter, ties by visit; a seed adds a fixed jitter below 1.

    An anchor walks down a tree of cells for each year of its group and meets the members of a few cells; see nearest(). With a seed
    every thousandth of the jitter has its own trees, as a member's jitter is part of its score. Visits without coordinates are left out.
    """
    jitter = F.pmod(F.xxhash64(F.lit(seed), "visit_id"), F.lit(1000)) / 1000 if seed is not None else F.lit(0.0)
    m = members.select(group, "visit_id", "lon", "lat", F.struct(F.col("year").alias("year"), jitter.alias("jitter")).alias("_part"))
    seekers = anchors.select(F.col("visit_id").alias("anchor_id"), group, "lon", "lat", "year")
    more = year_weight * F.abs(F.col("_part.year") - F.col("year")) + F.col("_part.jitter")
    near = nearest(seekers, m, [group], "anchor_id", "visit_id", k, more, "_part", bound).withColumn("score", F.round("score", 6))
    rank = F.row_number().over(W.partitionBy("anchor_id").orderBy("score", "visit_id"))
    return near.select("anchor_id", "visit_id", "score").withColumn("rank", rank).where(F.col("rank") <= k)


def _shortest(far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(km, order) of the best open path for each row of far (rows, n, n), the distances between n nodes; of equal paths that of the least order."""
    rows, n = far.shape[:2]
    km, order = np.full((2**n, n, rows), np.inf), np.zeros((2**n, n, rows), np.int64)  # by the nodes seen and the last of them; an order is its places as digits
    for last in range(n):
        km[1 << last, last], order[1 << last, last] = 0, last
    for seen in range(1, 2**n):
        for last in range(n):
            before = seen ^ (1 << last)
            if before > seen or not before:
                continue
            ends = [k for k in range(n) if before >> k & 1]
            longer = km[before, ends] + far[:, ends, last].T
            km[seen, last] = longer.min(axis=0)
            order[seen, last] = np.where(longer == km[seen, last], order[before, ends], n**n).min(axis=0) * n + last
    best = km[-1].min(axis=0)
    return best, np.where(km[-1] == best, order[-1], n**n).min(axis=0)[:, None] // n ** np.arange(n - 1, -1, -1) % n


def shortest_order(nodes: DataFrame, group: str, most: int = 7) -> DataFrame:
    """(group, path, km, status): the best open path through all nodes (node, lon, lat) of each group of at most most nodes.

    Larger groups have no path and the status too_many, the others solved; without a coordinate km is null, and so are both where nodes repeat or a node of several is null.
    A group that is solved is one row with the distances between its nodes; of the paths over the same nodes with the same last node only the best goes on.
    """

    @F.pandas_udf("km double, places array<int>")
    def best(far: pd.Series) -> pd.DataFrame:
        km, places = np.full(len(far), np.nan), np.full(len(far), None, object)
        sizes = far.map(len).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            n = round(size**0.5)
            some = np.stack([np.asarray(far.iat[k], float) for k in at]).reshape(-1, n, n)
            known = np.isfinite(some).all(axis=(1, 2))
            if n == 1:
                known[:], some = True, np.zeros_like(some)
            order = np.tile(np.arange(n), (len(at), 1))
            km[at[known]], order[known] = _shortest(some[known])
            places[at] = list(order)
        return pd.DataFrame({"km": km, "places": places})

    sizes = written(nodes.groupBy(group).agg(F.count("*").alias("_n")))
    sized = nodes.join(sizes.where(F.col("_n") <= most), group)
    lists = sized.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("node", "lon", "lat"))).alias("_at"))
    far = F.transform("_at", lambda a: F.transform("_at", lambda b: haversine(a["lon"], a["lat"], b["lon"], b["lat"])))
    lists = lists.select(group, "_at", F.flatten(far).alias("_far"), F.col("_at.node").alias("_nodes"))
    apart = (F.size("_nodes") == 1) | (F.size(F.array_distinct("_nodes")) == F.size("_nodes")) & ~F.exists("_nodes", lambda x: x.isNull())
    known = (F.size("_nodes") == 1) | ~F.exists("_far", lambda x: x.isNull())
    found = lists.where(apart).select(group, "_nodes", known.alias("_known"), best("_far").alias("_best"))
    path = F.transform("_best.places", lambda k: F.get("_nodes", k))
    solved = found.select(group, path.alias("path"), F.when(F.col("_known"), F.col("_best.km")).alias("km"))
    return sizes.select(group, F.when(F.col("_n") <= most, "solved").otherwise("too_many").alias("status")).join(solved, group, "left").select(group, "path", "km", "status")

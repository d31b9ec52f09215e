"""Aggregations into catalogs, counts and summaries."""

from __future__ import annotations

from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.io import written


def candidate_rollup(items: DataFrame, text: str = "content") -> DataFrame:
    """Per (post_id, name): sources, confidence range, media indexes, occurrences, whether the text holds it, and a stable index.

    items is (post_id, pic_index, pos, name, confidence, source, content).
    """
    out = items.groupBy("post_id", "name").agg(
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.array_sort(F.collect_set("pic_index")).alias("media_indexes"),
        F.count("*").alias("occurrences"),
        F.bool_or(F.contains(F.col(text), F.col("name"))).alias("in_text"),
        F.min(F.struct("pic_index", "pos")).alias("_first"),
    )
    return out.withColumn("candidate_index", F.row_number().over(W.partitionBy("post_id").orderBy("_first", "name")) - 1).drop("_first")


def entity_catalog(mentions: DataFrame) -> DataFrame:
    """Per entity: aliases, methods, occurrences, distinct posts, best confidence, linked places and match status."""
    out = mentions.groupBy("entity_id").agg(
        F.array_sort(F.collect_set("name")).alias("aliases"),
        F.array_sort(F.collect_set("method")).alias("methods"),
        F.count("*").alias("occurrences"),
        F.count_distinct("post_id").alias("posts"),
        F.max("confidence").alias("max_confidence"),
        F.array_sort(F.collect_set("place_id")).alias("place_ids"),
    )
    n = F.size("place_ids")
    return out.withColumn("match_status", F.when(n == 0, "unmatched").when(n == 1, "unique_high").otherwise("multiple"))


def paged_lists(rows: DataFrame, key: list[str], value: str, size: int = 10_000, name: str | None = None) -> DataFrame:
    """(key, page, values): the distinct non-null values of each key in order, in pages of at most size, numbered from 0.

    The distinct pairs are cut into ranges and counted by range and key; a pair's place follows from the pairs of its key in the
    ranges before and within its own. So no list and no task grows with what one key has.
    """
    pairs = rows.select(*key, value).where(F.col(value).isNotNull()).distinct()
    ranged = written(pairs.repartitionByRange(*key, value).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*key, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*key).orderBy("_range")) - F.col("_n")  # one row for each range that the key has
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("_range").alias("_r"), before.alias("_before"))
    same = reduce(lambda x, y: x & y, [ranged[c].eqNullSafe(starts[f"_{c}"]) for c in key], ranged["_range"] == starts["_r"])
    place = F.row_number().over(W.partitionBy("_range", *key).orderBy(value)) - 1
    placed = ranged.withColumn("_i", place).join(starts, same).withColumn("page", F.floor((F.col("_before") + F.col("_i")) / size))
    return placed.groupBy(*key, "page").agg(F.array_sort(F.collect_list(value)).alias(name or value))


def first_seen_catalog(rows: DataFrame, key: list[str], order: list[str], attributes: list[str], post: str = "post_id", size: int = 10_000) -> DataFrame:
    """(key, attributes, page, source_posts): per key the attributes of its first row, and its distinct posts in order, in pages of at most size; a key without a post has an empty page."""
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*attributes), F.struct(*order)).alias("_a")).select(*key, "_a.*")
    pages = paged_lists(rows, key, post, size, "source_posts").withColumnsRenamed({c: f"_{c}" for c in key})
    same = reduce(lambda x, y: x & y, [first[c].eqNullSafe(pages[f"_{c}"]) for c in key])
    out = first.join(pages, same, "left").withColumn("page", F.coalesce("page", F.lit(0)))
    return out.withColumn("source_posts", F.coalesce("source_posts", F.array())).drop(*[f"_{c}" for c in key])


def region_name(*names: str) -> Column:
    """The first name that is not empty."""
    return F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names])


def value_counts(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """(value, n) for every value of a fixed domain, zero where there is none."""
    values = df.sparkSession.createDataFrame([(v,) for v in domain], "value string")
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return values.join(counts, "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    return df.agg((F.approx_count_distinct(column) if approximate else F.count_distinct(column)).alias("n"))


def top_per_group(df: DataFrame, group: str, item: str, k: int = 8) -> DataFrame:
    """(group, item, n, rank): the most frequent items of each group, ties by item."""
    counts = df.groupBy(group, item).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), item))).where(F.col("rank") <= k)


def ordered_distinct(rows: DataFrame, group: str, order: list[str], values: str) -> DataFrame:
    """(group, values): the distinct elements of the group's arrays in order of appearance."""
    lists = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(values).alias("_v")))).alias("_l"))
    return lists.select(group, F.array_distinct(F.flatten(F.transform("_l", lambda x: x["_v"]))).alias(values))


def mean_confidence(members: DataFrame, group: str, column: str = "confidence") -> DataFrame:
    return members.groupBy(group).agg(F.round(F.avg(column), 4).alias("mean_confidence"))


def _at_ranks(counts: DataFrame, at: list[str], order: str, wanted: DataFrame) -> DataFrame:
    """counts (at, order, _n) joined with the wanted (at, _base, rank) that fall on them; _base rows come before, and becomes what comes before the hit."""
    w = W.partitionBy(*at).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    local = F.col("rank") - F.col("_base")
    met = before.join(wanted, at).where((local >= F.col("_before")) & (local < F.col("_before") + F.col("_n")))
    return met.withColumn("_base", F.col("_base") + F.col("_before")).drop("_before", "_n")


def ranked_values(rows: DataFrame, wanted: DataFrame, few: int = 100_000, ranges: int = 64) -> DataFrame:
    """(_g, rank, value): the values v of rows (_g, v) at the wanted (_g, rank), 0-based, in ascending order within each _g.

    The values of a group are cut into ranges at sketched quantiles and counted, and the ranges that hold a wanted rank are
    cut again, until a range has few rows or a single value; then its distinct values are counted. So no buffer grows with the
    values. Whatever the cuts, counts are exact.
    """
    at, done, start, step = ["_g", "_r"], [], F.lit(0).cast("long"), max(1, isqrt(ranges))
    rows, wanted = rows.select("_g", start.alias("_r"), "v"), written(wanted.select("_g", start.alias("_r"), start.alias("_base"), "rank"))
    while True:
        shares = F.array(*[F.lit((k + 1) / ranges) for k in range(ranges - 1)])
        sizes = written(rows.groupBy(*at).agg(F.count("*").alias("_n"), (F.min("v") < F.max("v")).alias("_many"), F.percentile_approx("v", shares, 100 * ranges).alias("_cuts")))
        large = (F.col("_n") > few) & F.col("_many")
        small = rows.join(sizes.where(~large).select(*at), at).groupBy(*at, "v").agg(F.count("*").alias("_n"))
        done.append(written(_at_ranks(small, at, "v", wanted).select("_g", "rank", F.col("v").alias("value"))))
        if not sizes.where(large).limit(1).collect():
            return reduce(DataFrame.unionByName, done)
        # a range lies between two cuts; the values that equal a cut are one of their own
        # and it is found among every few cuts first, then among the few behind
        cuts = sizes.where(large).select(*at, F.array_distinct("_cuts").alias("_cuts")).withColumn("_every", F.filter("_cuts", lambda _, i: i % step == step - 1))
        below = lambda xs: F.size(F.filter(xs, lambda c: c < F.col("v")))
        placed = rows.join(cuts, at).withColumn("_k", below("_every") * step)
        placed = placed.withColumn("_k", F.col("_k") + below(F.slice("_cuts", F.col("_k") + 1, F.lit(step))))
        place = F.col("_k") * 2 + F.coalesce(F.get("_cuts", "_k") == F.col("v"), F.lit(False)).cast("int")
        placed = placed.select(*at, place.alias("_k"), "v")
        counts = placed.groupBy(*at, "_k").agg(F.count("*").alias("_n"))  # at most 2 * ranges for a range
        hits = written(_at_ranks(counts, at, "_k", wanted))
        number = F.xxhash64("_r", "_k").alias("_r")
        rows = written(placed.join(hits.select(*at, "_k").distinct(), [*at, "_k"]).select("_g", number, "v"))
        wanted = written(hits.select("_g", number, "_base", "rank"))


def quantiles(df: DataFrame, column: str, by: list[str] | None = None, few: int = 100_000, ranges: int = 64) -> DataFrame:
    """Median and 90th percentile with linear interpolation, and the maximum; nulls don't count, a group of nulls has nulls.

    The values at the ranks come from ranked_values(), so memory is bounded by the number of ranges, not of values.
    """
    by = by or []
    group = F.to_json(F.struct(*by, F.lit(0).alias("_")))  # nulls of any column included
    base = written(df.select(*by, F.col(column).cast("double").alias("v")).withColumn("_g", group))
    totals = written(base.groupBy("_g", *by).agg(F.count("v").alias("_n"), F.max("v").alias("max")))
    place = lambda q: F.lit(q) * (F.col("_n") - 1)
    ranks = F.array(*[f(place(q)).cast("long") for q in (0.5, 0.9) for f in (F.floor, F.ceil)])
    wanted = totals.where("_n > 0").select("_g", F.explode(F.array_distinct(ranks)).alias("rank"))
    found = ranked_values(base.where(F.col("v").isNotNull()).select("_g", "v"), wanted, few, ranges)
    values = found.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_v"))
    out = totals.join(values, "_g", "left")

    def between(q: float) -> Column:
        low, high = (F.try_element_at(F.col("_v"), f(place(q)).cast("long")) for f in (F.floor, F.ceil))
        share = place(q) - F.floor(place(q))
        # as the weighted sum of both neighbours
        return F.when(F.col("_n") > 0, F.when(low == high, low).otherwise((1 - share) * low + share * high))

    return out.select(*by, between(0.5).alias("median"), between(0.9).alias("p90"), "max")


def summary(df: DataFrame, totals: dict[str, Column], conditions: dict[str, Column]) -> DataFrame:
    """One row: totals as given, and for each condition its count and rate."""
    counted = [c for n, p in conditions.items() for c in (F.count_if(p).alias(f"n_{n}"), F.round(F.avg(F.coalesce(p, F.lit(False)).cast("int")), 4).alias(f"rate_{n}"))]
    return df.agg(F.count("*").alias("total"), *[c.alias(n) for n, c in totals.items()], *counted)


def pivot_counts(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """One row per key, one count per value of a fixed list."""
    return df.groupBy(key).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def facets(labels: DataFrame, least: float = 0.75, most: int = 240) -> DataFrame:
    """(type, name, n): the most frequent trimmed names with enough confidence."""
    counts = labels.where(F.col("confidence") >= least).groupBy("type", F.trim("name").alias("name")).agg(F.count("*").alias("n"))
    return counts.where("name <> ''").orderBy(F.desc("n"), "type", "name").limit(most)


def manifest(rows: DataFrame, city: str, time: str) -> DataFrame:
    """One row: rows, distinct cities that are not empty, distinct years, first and last time (microseconds)."""
    at = F.timestamp_micros(time)
    return rows.agg(
        F.count("*").alias("total"), F.count_distinct(F.nullif(F.col(city).cast("string"), F.lit(""))).alias("cities"), F.array_sort(F.collect_set(F.year(at))).alias("years"), F.min(time).alias("first"), F.max(time).alias("last")
    )


def region_rollup(rows: DataFrame, province: str, city: str, trip: str, last: str | None = None) -> DataFrame:
    """(province, city, level, trips, sort_key): distinct trips by city and by province; the group last sorts last."""
    by = rows.groupingSets([[F.col(province), F.col(city)], [F.col(province)]], F.col(province), F.col(city))
    out = by.agg(F.count_distinct(trip).alias("trips"), F.grouping(city).alias("_g"))
    level = F.when(F.col("_g") == 1, "province").otherwise("city")
    return out.select(province, city, level.alias("level"), "trips", F.when(F.col(province).eqNullSafe(F.lit(last)), 1).otherwise(0).alias("sort_key"))


def usage_totals(rows: DataFrame, usage: str, fields: list[str]) -> DataFrame:
    """Sums of the counters of an optional struct; missing ones count as 0."""
    return rows.agg(*[F.sum(F.coalesce(F.col(f"{usage}.{f}"), F.lit(0))).alias(f) for f in fields])


def size_distribution(df: DataFrame, key: list[str]) -> DataFrame:
    """(size, groups): how many groups have so many rows."""
    return df.groupBy(*key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def distributions(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(distribution, value, n): value counts of several tables as one long table."""
    counted = [df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("distribution"), "value", "n") for name, (df, c) in parts.items()]
    return reduce(DataFrame.unionByName, counted)

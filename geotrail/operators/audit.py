"""Validation and audit. A check is one row (check_name, failures); it passes with none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.io import written


def check(name: str, failing: DataFrame) -> DataFrame:
    return failing.agg(F.lit(name).alias("check_name"), F.count("*").alias("failures"))


def not_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, n) of the keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str, is_array: bool = False) -> DataFrame:
    """Foreign ids of a scalar or array column that the parent lacks; nulls refer to nothing."""
    ids = child.select((F.explode(column) if is_array else F.col(column)).alias(key)).where(F.col(key).isNotNull())
    return ids.join(parent.select(key), key, "left_anti")


def out_of_range(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    ok = F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90) & ~F.isnan(lon) & ~F.isnan(lat)
    return df.where(~F.coalesce(ok, F.lit(False)))


def not_preserved(before: DataFrame, after: DataFrame, added: list[str]) -> DataFrame:
    """Rows in which the input and the enriched table without its added columns differ, either way."""
    core = after.drop(*added).select(*before.columns)
    return before.exceptAll(core).withColumn("side", F.lit("lost")).unionByName(core.exceptAll(before).withColumn("side", F.lit("new")))


def bad_slices(mentions: DataFrame, text: str = "content", mention: str = "term") -> DataFrame:
    """Mentions whose offsets are out of range or do not cut out their text."""
    piece = F.substring(F.col(text), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    ok = (F.col("start") >= 0) & (F.col("end") <= F.length(text)) & (piece == F.col(mention))
    return mentions.where(~F.coalesce(ok, F.lit(False)))


def bad_time_order(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    return df.where(F.col(start) > F.col(end))


def misaligned(trips: DataFrame, least: int = 2) -> DataFrame:
    """Trips whose route and members differ in length or at some position, or that are too short."""
    ids = F.transform("route", lambda r: r["visit_id"])
    return trips.where((F.size("route") < least) | ~ids.eqNullSafe(F.col("visit_ids")))


def shared_members(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """Visits in more than one trip, and candidates that are members too: (visit_id, problem)."""
    many = members.groupBy("visit_id").agg(F.count_distinct("trip_id").alias("n")).where("n > 1").select("visit_id", F.lit("in_two_trips").alias("problem"))
    both = candidates.select("visit_id").distinct().join(members, "visit_id", "left_semi").select("visit_id", F.lit("candidate_and_member").alias("problem"))
    return many.unionByName(both)


def forbidden(visits: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(visit_id, rule) of every rule that a visit breaks."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), name) for name, p in rules.items()]))
    return visits.select("visit_id", F.explode(broken).alias("rule"))


def uncovered(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one table that the other lacks."""
    left = a.select(key).distinct().join(b, key, "left_anti").withColumn("side", F.lit("left_only"))
    return left.unionByName(b.select(key).distinct().join(a, key, "left_anti").withColumn("side", F.lit("right_only")))


def row_parity(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n, equal): row counts, and whether each is the first table's."""
    counts = reduce(DataFrame.unionByName, [df.agg(F.lit(k).alias("position"), F.lit(n).alias("table_name"), F.count("*").alias("n")) for k, (n, df) in enumerate(tables.items())])
    return counts.withColumn("equal", F.col("n") == F.first("n").over(W.orderBy("position").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).drop("position")  # one row a table


def audit(checks: dict[str, DataFrame], warnings: dict[str, int] | None = None) -> DataFrame:
    """(check_name, failures, status): pass, warning up to a check's threshold, else fail; a last row overall."""
    warnings = warnings or {}
    rows = reduce(DataFrame.unionByName, [check(n, df).withColumn("_most", F.lit(warnings.get(n, 0))) for n, df in checks.items()])
    status = F.when(F.col("failures") == 0, "pass").when(F.col("failures") <= F.col("_most"), "warning").otherwise("fail")
    each = rows.select("check_name", "failures", status.alias("status"))
    overall = each.agg(F.lit("overall").alias("check_name"), F.sum("failures").alias("failures"), F.when(F.bool_and(F.col("status") != "fail"), "pass").otherwise("fail").alias("status"))
    return each.unionByName(overall)


#: The twenty checks of finished tables, and the table that each examines.
CHECKS = {
    "post_row_counts_equal": "posts",
    "source_values_preserved": "source",
    "located_values_preserved": "located",
    "unique_post_ids": "posts",
    "mention_slices_valid": "mentions",
    "mention_overlap_free": "mentions",
    "place_coordinates_valid": "places",
    "unique_visit_ids": "visits",
    "visit_references_valid": "visits",
    "visit_times_valid": "visits",
    "no_forbidden_fallback_route_anchors": "visits",
    "roles_cover_all_posts": "roles",
    "role_references_valid": "roles",
    "unique_trip_ids": "trips",
    "trip_references_valid": "trips",
    "trip_times_valid": "trips",
    "trip_routes_valid": "trips",
    "narrative_ids_valid": "narratives",
    "secondary_references_valid": "candidates",
    "narratives_cover_all_trips": "narratives",
}
#: What a row can say of a key: that it is one of the key's own rows, or who refers to it.
SAYS = ("own", "role", "anchor", "member", "narrative", "before", "after", "visit_ref", "role_ref", "trip_ref", "secondary_ref")


def _said(t: dict[str, DataFrame], blocked: list[str]) -> DataFrame:
    """(space, key, says) of all rows of the tables, each read once: keys and references by their space, failed row checks in the space check, rows in the space rows."""
    c = F.col
    event = lambda space, key, says: F.struct(F.lit(space).alias("space"), key.cast("string").alias("key"), F.lit(says).alias("says"))
    each = lambda space, column, says: F.coalesce(F.transform(column, lambda x: event(space, x, says)), F.array().cast("array<struct<space:string,key:string,says:string>>"))
    failed = lambda name, bad: event("check", F.when(F.coalesce(bad, F.lit(False)), F.lit(name)), "own")
    values = lambda names: F.md5(F.to_json(F.struct(*sorted(names))))
    found = lambda lon, lat: F.coalesce(c(lon).between(-180, 180) & c(lat).between(-90, 90) & ~F.isnan(lon) & ~F.isnan(lat), F.lit(False))
    source, located = t["source"].columns, t["located"].columns
    route = F.transform("route", lambda r: r["visit_id"])
    singles = {
        "source": [event("source_row", values(source), "before")],
        "located": [event("source_row", values(source), "after"), event("located_row", values(located), "before")],
        "posts": [event("located_row", values(located), "after"), event("post", c("post_id"), "own")],
        "places": [event("place", c("place_id"), "own"), failed("place_coordinates_valid", ~found("lon", "lat"))],
        "regions": [event("region", c("region_id"), "own")],
        "visits": [
            event("visit", c("visit_id"), "own"), event("visit", F.when(c("eligibility") == "anchor", c("visit_id")), "anchor"), event("place", c("place_id"), "visit_ref"), event("region", c("region_id"), "visit_ref"),
            failed("visit_references_valid", F.coalesce(F.size("post_ids"), F.lit(0)) <= 0), failed("visit_times_valid", c("start") > c("end")), failed("no_forbidden_fallback_route_anchors", (c("eligibility") == "anchor") & c("method").isin(blocked)),
        ],
        "roles": [event("post", c("post_id"), "role")],
        "trips": [event("trip", c("trip_id"), "own"), failed("trip_times_valid", c("start") > c("end")), failed("trip_routes_valid", (F.size("route") < 2) | ~route.eqNullSafe(c("visit_ids")))],
        "narratives": [event("trip", c("trip_id"), "narrative")],
        "candidates": [event("trip", c("trip_id"), "secondary_ref"), event("visit", c("visit_id"), "secondary_ref")],
        "contexts": [event("trip", c("trip_id"), "secondary_ref"), event("trip", c("other_trip_id"), "secondary_ref"), event("post", c("post_id"), "secondary_ref"), event("visit", c("visit_id"), "secondary_ref")],
    }
    lists = {
        "visits": [each("post", "post_ids", "visit_ref"), each("place", "candidate_ids", "visit_ref")], "roles": [each("visit", "visit_ids", "role_ref")],
        "trips": [each("post", "post_ids", "trip_ref"), each("visit", "visit_ids", "member")],
    }
    parts = []
    for name, events in singles.items():
        told = F.concat(F.array(event("rows", F.lit(name), "own"), *events), *lists.get(name, []))
        parts.append(t[name].select(F.explode(F.filter(told, lambda e: e["key"].isNotNull())).alias("e")).select("e.*"))
    return reduce(DataFrame.unionByName, parts)


def _judged(said: DataFrame) -> DataFrame:
    """(check_name, failures) from what is said of every key, and rows (check_name is the table's after a slash): one aggregation by key."""
    counts = said.groupBy("space", "key").agg(*[F.count_if(F.col("says") == x).alias(x) for x in SAYS])
    n = {x: F.col(x) for x in SAYS}
    missing, one = n["own"] == 0, lambda p: p.cast("long")
    rules = {
        "source_row": {"source_values_preserved": F.abs(n["before"] - n["after"])},
        "located_row": {"located_values_preserved": F.abs(n["before"] - n["after"])},
        "post": {
            "unique_post_ids": one(n["own"] > 1), "roles_cover_all_posts": one((n["own"] > 0) != (n["role"] > 0)) + one(n["role"] > 1), "role_references_valid": F.when(missing, n["role"]),
            "visit_references_valid": F.when(missing, n["visit_ref"]), "trip_references_valid": F.when(missing, n["trip_ref"]), "secondary_references_valid": F.when(missing, n["secondary_ref"]),
        },
        "visit": {
            "unique_visit_ids": one(n["own"] > 1), "role_references_valid": F.when(missing, n["role_ref"]), "trip_references_valid": F.when(n["anchor"] == 0, n["member"]).otherwise(0) + one(n["member"] > 1),
            "secondary_references_valid": F.when(missing, n["secondary_ref"]),
        },
        "trip": {"unique_trip_ids": one(n["own"] > 1), "narratives_cover_all_trips": one((n["own"] > 0) != (n["narrative"] > 0)), "secondary_references_valid": F.when(missing, n["secondary_ref"])},
        "place": {"visit_references_valid": F.when(missing, n["visit_ref"])},
        "region": {"visit_references_valid": F.when(missing, n["visit_ref"])},
    }
    item = lambda name, value: F.struct(name.alias("check_name"), F.coalesce(value, F.lit(0)).cast("long").alias("failures"))
    fails = F.when(F.col("space") == "check", F.array(item(F.col("key"), n["own"]))).when(F.col("space") == "rows", F.array(item(F.concat(F.lit("/"), "key"), n["own"])))
    for space, own in rules.items():
        fails = fails.when(F.col("space") == space, F.array(*[item(F.lit(name), value) for name, value in own.items()]))
    each = counts.select(F.explode(F.filter(fails, lambda x: x["failures"] > 0)).alias("x")).select("x.*")
    return each.groupBy("check_name").agg(F.sum("failures").alias("failures"))


def _mentions_judged(mentions: DataFrame, posts: DataFrame) -> DataFrame:
    """(check_name, failures) of mentions against the text of their post and against the mention before: one join, one pass."""
    content = posts.groupBy("post_id").agg(F.first("content").alias("content"))
    before = F.lag("end").over(W.partitionBy("post_id").orderBy("start", "end"))
    met = mentions.select("post_id", "start", "end", "text", before.alias("_before")).join(content, "post_id", "left")
    piece = F.substring(F.col("content"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    ok = (F.col("start") >= 0) & (F.col("end") <= F.length("content")) & (piece == F.col("text"))
    counts = met.agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("mention_slices_valid"), F.count_if(F.col("start") < F.col("_before")).alias("mention_overlap_free"), F.count("*").alias("/mentions"))
    return counts.unpivot([], list(counts.columns), "check_name", "failures")


def _narratives_judged(narratives: DataFrame, trips: DataFrame, entities: DataFrame) -> DataFrame:
    """(check_name, failures): narratives that name visits or themes that their trip lacks, or themes that are no entity."""
    told = narratives.select("trip_id", "highlight_ids", F.col("theme_ids").alias("told")).join(trips.select("trip_id", "visit_ids", "theme_ids"), "trip_id")
    strange = F.size(F.array_except("highlight_ids", "visit_ids")) + F.size(F.array_except("told", "theme_ids")) > 0
    named = told.select("trip_id", strange.alias("_strange"), F.explode_outer("told").alias("entity_id")).join(entities.select("entity_id", F.lit(True).alias("_known")), "entity_id", "left")
    bad = named.where(F.coalesce("_strange", F.lit(False)) | (F.col("entity_id").isNotNull() & F.col("_known").isNull()))
    return bad.agg(F.lit("narrative_ids_valid").alias("check_name"), F.count_distinct("trip_id").alias("failures"))


def final_audit(t: dict[str, DataFrame], blocked: list[str], warnings: dict[str, DataFrame] | None = None) -> DataFrame:
    """(check_name, failures, examined, status) of the twenty checks of finished tables, of the warnings, and overall.

    Tables: source, located, posts (post_id, ... each with more columns than the one before), mentions (post_id, mention_id, start, end,
    text, entity_id), entities (entity_id), places (place_id, lon, lat), regions (region_id), visits (visit_id, start, end, post_ids,
    place_id, candidate_ids, region_id, eligibility, method), roles (post_id, visit_ids), trips (trip_id, start, end, visit_ids, route, post_ids,
    theme_ids), narratives (trip_id, highlight_ids, theme_ids), candidates (trip_id, visit_id), contexts (trip_id, post_id, visit_id,
    other_trip_id). A check passes without failures; a warning never fails. Every row says once what it has to say of all keys
    it holds, and one aggregation by key judges them; mentions meet their texts and narratives their trips in a join each. So no table is
    read more than twice. A null key refers to nothing; values are compared as JSON.
    """
    c = F.col
    judged = [_judged(_said(t, blocked)), _mentions_judged(t["mentions"], t["posts"]), _narratives_judged(t["narratives"], t["trips"], t["entities"])]
    found = written(reduce(DataFrame.unionByName, judged))  # a row for each check that fails, and each table
    spark = found.sparkSession
    sizes = found.where("check_name LIKE '/%'").select(F.substring("check_name", 2, 100).alias("_at"), c("failures").alias("examined"))
    posts = sizes.where(c("_at").isin("source", "located", "posts")).agg(F.lit("post_row_counts_equal").alias("check_name"), (F.count_distinct("examined") + F.when(F.count("*") < 3, F.count("*")).otherwise(0) > 1).cast("long").alias("failures"))
    named = spark.createDataFrame(list(CHECKS.items()), "check_name string, _at string").withColumn("_warn", F.lit(False))
    failures = found.unionByName(posts)
    if warnings:
        failures = failures.unionByName(reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("check_name"), F.count("*").alias("failures")) for n, df in warnings.items()]))
        named = named.unionByName(spark.createDataFrame([(n, None, True) for n in warnings], named.schema))
    rows = named.join(failures, "check_name", "left").join(sizes, "_at", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    status = F.when(c("failures") == 0, "pass").when(c("_warn"), "warning").otherwise("fail")
    examined = F.when(~c("_warn"), F.coalesce("examined", F.lit(0)))
    each = written(rows.select("check_name", "failures", examined.alias("examined"), status.alias("status")))
    overall = each.agg(F.lit("overall").alias("check_name"), F.sum(F.when(c("status") == "fail", c("failures")).otherwise(0)).alias("failures"), F.lit(None).cast("long").alias("examined"), F.when(F.bool_and(c("status") != "fail"), "pass").otherwise("fail").alias("status"))
    return each.unionByName(overall)


def duplicate_titles(df: DataFrame, title: str) -> DataFrame:
    return df.groupBy(title).agg(F.count("*").alias("n")).where("n > 1")

"""Scoring of candidates and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Weights of the score's components, and what the source rank adds.
WEIGHTS = {"name": 60.0, "region": 12.0, "address": 15.0, "type": 8.0}
RANK_BONUS, RANK_STEP = 3.0, 0.15
#: Weights of the methods by which a visit's point was found, and those that give a precise place.
METHOD_WEIGHT = {
    "amap_deterministic": 0.96,
    "amap_with_llm_disambiguation": 0.92,
    "explicit_location_amap": 0.88,
    "amap_multiple_candidates": 0.68,
    "source_geo": 0.78,
    "explicit_region_geocode": 0.65,
}
PRECISE = ("amap_deterministic", "amap_with_llm_disambiguation", "amap_multiple_candidates", "explicit_location_amap", "source_geo")
REGION_METHOD, SOURCE_METHOD = "explicit_region_geocode", "source_geo"
#: Least scores of a second pass by kind and otherwise, prefixes of types that fit a kind, and the score that needs no fitting type.
THRESHOLDS, OTHERWISE = {"restaurant": 0.78, "market": 0.75, "attraction": 0.75, "building": 0.75, "other": 0.82}, 0.8
PREFIXES = {"restaurant": ("05", "08", "10"), "market": ("06", "12"), "attraction": ("08", "11", "14", "19"), "building": ("10", "12", "14", "15", "17", "19")}
CERTAIN, DROPPED, FAR_KM = 0.95, 0.65, 300.0
#: A text that names a region, and the methods whose context an address may contradict.
REGION_WORDS = "(省|市|自治区|特别行政区|区|县|旗|北京|上海|天津|重庆|香港|澳门|台湾)"
DEFAULT_CONTEXT, NEAR_CONTEXT = "global_default", ("temporal_neighbor", "ip_region_centroid")


def score_parts(similarity: Column, region: Column, address: Column, type_ok: Column, source_rank: Column) -> Column:
    """struct(name, region, address, type, rank): the components of a candidate's score; the first source rank, 1, has the whole bonus."""
    weight = lambda c, name: F.when(c, WEIGHTS[name]).otherwise(0.0)
    bonus = F.greatest(F.lit(0.0), RANK_BONUS - (source_rank - 1) * RANK_STEP)
    return F.struct(F.round(similarity * WEIGHTS["name"], 2).alias("name"), weight(region, "region").alias("region"), weight(address, "address").alias("address"), weight(type_ok, "type").alias("type"), bonus.alias("rank"))


def score(parts: Column) -> Column:
    """0 to 100: the sum of the components, two decimals."""
    total = parts["name"] + parts["region"] + parts["address"] + parts["type"] + parts["rank"]
    return F.round(F.least(F.lit(100.0), total), 2)


def rank(candidates: DataFrame, key: str) -> DataFrame:
    """Adds rank: by score descending, then source rank."""
    return candidates.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "source_rank")))


def decide(candidates: DataFrame, requests: DataFrame, key: str, margin: float = 8.0, credible: float = 0.75, near: float = 6.0, most: int = 5) -> DataFrame:
    """(key, status, selected_ids, top_score, margin, n_credible) of every request (key, generic, has_context).

    candidates are ranked (poi_id, score, name_similarity). A generic keyword is rejected; a request without candidates, or whose
    best is too unlike, has no match; several credible ones are kept where no context, or too small a margin, tells them
    apart; a clear best is accepted; the rest goes to review.
    """
    best = F.max("score").over(W.partitionBy(key))
    ok = (F.col("name_similarity") >= credible) & (F.col("score") >= best - F.lit(near))
    lists = candidates.withColumn("_ok", ok).groupBy(key).agg(
        F.max("score").alias("top_score"),
        F.max_by(F.struct("name_similarity", "poi_id"), -F.col("rank")).alias("_top"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_second"),
        F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct("rank", "poi_id")))).alias("_c"),
    )
    lists = requests.select(key, "generic", "has_context").join(lists, key, "left")
    lists = lists.withColumn("margin", F.col("top_score") - F.coalesce("_second", F.lit(0.0))).withColumn("n_credible", F.coalesce(F.size("_c"), F.lit(0)))
    similarity = F.col("_top.name_similarity")
    status = (
        F.when(F.col("generic"), "rejected")
        .when(F.col("top_score").isNull() | (similarity < 0.48) | (F.col("top_score") < 38), "no_match")
        .when((F.col("n_credible") > 1) & (~F.col("has_context") | (F.col("margin") < near)), "multiple")
        .when((similarity >= 0.9) & (F.col("top_score") >= 62) & (F.col("margin") >= margin), "auto_accept")
        .otherwise("needs_review")
    )
    lists = lists.withColumn("status", status)
    ids = F.slice(F.transform("_c", lambda c: c["poi_id"]), 1, most)
    chosen = F.when(F.col("status") == "auto_accept", F.array("_top.poi_id")).when(F.col("status").isin("multiple", "needs_review"), ids)
    return lists.select(key, "status", F.coalesce(chosen, F.array().cast(f"array<{dict(candidates.dtypes)['poi_id']}>")).alias("selected_ids"), "top_score", "margin", "n_credible")


def needs_review(decisions: DataFrame, conflict: Column | None = None) -> DataFrame:
    """Decisions to look at: those without a clear outcome that have candidates, and those that chose some although places conflict."""
    unclear = F.col("status").isin("needs_review", "no_match") & F.col("top_score").isNotNull()
    chose = F.col("status").isin("auto_accept", "multiple") & (conflict if conflict is not None else F.lit(False))
    return decisions.where(unclear | chose)


def review_input(candidates: DataFrame, context: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(key, input): JSON of the best candidates, the allowed ids and the record's context."""
    top = candidates.where(F.col("rank") <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "poi_id", "name", "score"))).alias("candidates"))
    rest = [c for c in context.columns if c != key]
    body = F.struct("candidates", F.transform("candidates", lambda c: c["poi_id"]).alias("allowed_ids"), F.struct(*rest).alias("context"))
    return top.join(context, key).select(key, F.to_json(body).alias("input"))


def overlay(decisions: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Decisions with a valid review (key, valid, review_status) in place of the rule's status; method says which it is."""
    valid = reviews.where("valid").select(key, "review_status")
    out = decisions.join(valid, key, "left")
    return out.withColumn("method", F.when(F.col("review_status").isNotNull(), "reviewed").otherwise("rule")).withColumn("status", F.coalesce("review_status", "status")).drop("review_status")


def context_conflict(kind: Column, text: Column, method: Column, distance_km: Column) -> Column:
    """Whether an address contradicts what was known of its record: a default place though the text names no region, or a place that is far from a near one."""
    named = F.coalesce(text.rlike(REGION_WORDS), F.lit(False))
    default = (method == DEFAULT_CONTEXT) & ~named
    far = method.isin(*NEAR_CONTEXT) & (distance_km > FAR_KM)
    return F.coalesce(kind == "address", F.lit(False)) & (F.coalesce(default, F.lit(False)) | F.coalesce(far, F.lit(False)))


def strict_filter(found: Column, conflict: Column, kind: Column, similarity: Column, query: Column, name: Column, typecode: Column) -> Column:
    """struct(accepted, reason) of a second pass: the first rule that speaks against a row is the reason.

    query and name are normalized. A name that the query holds must keep most of it; a type must fit the kind, unless the
    score is nearly certain; kinds without prefixes take any type.
    """
    need = F.lit(OTHERWISE)
    for k, v in THRESHOLDS.items():
        need = F.when(kind == k, v).otherwise(need)
    fits = F.lit(True)
    for k, prefixes in PREFIXES.items():
        fits = F.when(kind == k, F.substring(F.coalesce(typecode, F.lit("")), 1, 2).isin(*prefixes)).otherwise(fits)
    similarity, query, name = F.coalesce(similarity, F.lit(0.0)), F.coalesce(query, F.lit("")), F.coalesce(name, F.lit(""))
    dropped = F.contains(query, name) & (F.length(name) / F.greatest(F.length(query), F.lit(1)) < DROPPED)
    # fixed values: names of the reasons
    reason = (
        F.when(~found, "no_resolved_candidate")
        .when(conflict, "address_conflicts_with_existing_context")
        .when(similarity < need, "stricter_name_threshold")
        .when(dropped, "candidate_drops_distinctive_query_text")
        .when(~fits & (similarity < CERTAIN), "poi_type_incompatible")
        .otherwise("passed_strict_filter")
    )
    return F.struct((reason == "passed_strict_filter").alias("accepted"), reason.alias("reason"))


def best_match(candidates: DataFrame, key: str, least: float = 0.62) -> DataFrame:
    """The most similar candidate of each request, if it reaches the floor; the first source rank wins a tie."""
    rest = [c for c in candidates.columns if c != key]
    best = candidates.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("similarity", -F.col("source_rank"))).alias("b")).select(key, "b.*")
    return best.where(F.col("similarity") >= least)


def to_point(candidates: DataFrame, method: str, confidence: Column) -> DataFrame:
    """Candidates as output points."""
    return candidates.select(
        "request_id", "poi_id", "name", F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), F.format_string("%.6f,%.6f", F.col("lon").cast("double"), F.col("lat").cast("double")).alias("location"),
        F.lit(method).alias("selection_method"), confidence.alias("confidence"), F.lit(False).alias("is_fallback"),
    )


def dedupe_points(points: DataFrame, group: str, position: str) -> DataFrame:
    """The first point of each id; of each location and name where the id is null."""
    key = F.coalesce(F.col("poi_id").cast("string"), F.concat_ws("|", "location", "name"))
    return points.withColumn("_k", key).withColumn("_n", F.row_number().over(W.partitionBy(group, "_k").orderBy(position))).where("_n = 1").drop("_k", "_n")


def label_resolution(points: DataFrame, group: str) -> DataFrame:
    """(group, method, confidence, point_count) from all points of a record (method, confidence)."""
    out = points.groupBy(group).agg(F.count("*").alias("point_count"), F.bool_and(F.col("confidence") == "high").alias("_all"), F.bool_or(F.col("confidence") == "low").alias("_low"), F.min("method").alias("_m"), F.count_distinct("method").alias("_d"))
    confidence = F.when(F.col("_all"), "high").when(F.col("_low"), "low").otherwise("medium")
    return out.select(group, F.when(F.col("_d") > 1, "mixed").otherwise(F.col("_m")).alias("method"), confidence.alias("confidence"), "point_count")


def visit_confidence(assertion: Column, group: Column, method: Column, weights: dict[str, float] | None = None, unknown: float = 0.5) -> Column:
    """The least of the assertion's, the group's and the method's confidence, four decimals."""
    weights = weights or METHOD_WEIGHT
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.round(F.least(assertion, group, F.coalesce(F.element_at(table, method), F.lit(unknown))), 4)


def eligibility(method: Column, confidence: Column, n_points: Column, several: Column, time_relation: Column, poi_id: Column, kind: Column, coordinate_status: Column, least: float = 0.7) -> Column:
    """struct(eligibility, precision, flags) of a visit, from its method, its points and the first of them (poi_id, kind, coordinate_status).

    several tells that the decision was for a set of candidates; more than one point is a set as well.
    """
    true = lambda c: F.coalesce(c, F.lit(False))
    region, many = true(method == REGION_METHOD), true(several) | true(n_points > 1)
    anchor = ~many & true(method.isin(*PRECISE)) & true(confidence >= least)
    e = F.when(region, "region_only").when(anchor, "anchor").otherwise("candidate")
    address = true(kind.rlike("(?i)address")) | true(coordinate_status.rlike("(?i)address"))
    # fixed values: names of precisions and flags
    precision = (
        F.when(region, "region")
        .when(true(n_points > 1), "candidate_set")
        .when(true(method == SOURCE_METHOD), "source_coordinate")
        .when(true(poi_id != ""), "poi")
        .when(address, "address")
        .otherwise("point")
    )
    known_time = true(time_relation.isin("contemporaneous", "recent_relative"))
    flags = F.array_compact(F.array(F.when(many, "ambiguous_place_candidates"), F.when(region, "region_level_only"), F.when(~known_time, "visit_time_uses_post_timestamp")))
    return F.struct(e.alias("eligibility"), precision.alias("precision"), flags.alias("flags"))


def record_role(posts: DataFrame, visits: DataFrame, key: str, is_context: Column) -> DataFrame:
    """(key, role): anchor, region, context or search, the first that holds."""
    flags = visits.groupBy(key).agg(F.bool_or(F.col("eligibility") == "anchor").alias("_a"), F.bool_or(F.col("eligibility") == "region_only").alias("_r"))
    role = F.when(F.col("_a"), "anchor").when(F.col("_r"), "region").when(is_context, "context").otherwise("search")
    return posts.join(flags, key, "left").select(key, role.alias("role"))

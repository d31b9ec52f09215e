"""Requests to external services and validation of their answers, as tables on both sides."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors(rules: dict[str, Column]) -> Column:
    """array<string>: the names of the rules that are broken (their condition holds)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), name) for name, p in rules.items()]))


def build_input(posts: DataFrame, candidates: DataFrame, media: DataFrame, key: str = "post_id") -> DataFrame:
    """(key, input): one compact JSON document per post with its candidates and media in order; empty parts are left out."""
    c = candidates.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[x for x in candidates.columns if x != key]))).alias("candidates"))
    m = media.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[x for x in media.columns if x != key]))).alias("media"))
    rest = [x for x in posts.columns if x != key]
    return posts.join(c, key, "left").join(m, key, "left").select(key, F.to_json(F.struct(*rest, "candidates", "media")).alias("input"))


def create_requests(groups: DataFrame, endpoints: dict[str, str]) -> DataFrame:
    """One request per place group (post_id, group_index, place_kind, role, keyword, region, should_query): id, endpoint, parameters, blocked_reason."""
    table = F.create_map(*[F.lit(x) for kv in endpoints.items() for x in kv])
    raw = F.map_from_arrays(F.array(F.lit("keywords"), F.lit("region")), F.array(F.trim("keyword"), F.trim("region")))
    blocked = F.when(F.coalesce(F.trim("keyword"), F.lit("")) == "", "empty_keyword").when(F.length("keyword") > 80, "keyword_too_long").when(F.element_at(table, F.col("place_kind")).isNull(), "unknown_kind")
    rows = groups.where("should_query")
    return rows.select(
        F.concat_ws("__g", "post_id", "group_index").alias("request_id"), "post_id", "group_index", "place_kind", "role", F.element_at(table, F.col("place_kind")).alias("endpoint"),
        F.map_filter(raw, lambda k, v: v.isNotNull() & (v != "")).alias("parameters"), blocked.alias("blocked_reason"),
    )


def endpoint_fallback(requests: DataFrame, source: str, target: str, drop: list[str], reason: str, when: Column) -> DataFrame:
    """Requests with one endpoint replaced by another where a condition holds, without some parameters; keeps the original."""
    hit = (F.col("endpoint") == source) & when
    slim = F.map_filter("parameters", lambda k, v: ~k.isin(drop))
    return requests.withColumns(
        {"original_endpoint": F.when(hit, F.col("endpoint")), "fallback_reason": F.when(hit, F.lit(reason)), "parameters": F.when(hit, slim).otherwise(F.col("parameters")), "endpoint": F.when(hit, F.lit(target)).otherwise(F.col("endpoint"))}
    )


def exclusions(groups: DataFrame, known: DataFrame, kinds: list[str], key: str = "post_id") -> DataFrame:
    """Groups that make no request, with the first reason: invalid, source_missing, kind_excluded, blocked."""
    marked = groups.join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    reason = F.when(~F.col("valid"), "invalid").when(F.col("_known").isNull(), "source_missing").when(~F.col("place_kind").isin(kinds), "kind_excluded").when(F.coalesce(F.trim("keyword"), F.lit("")) == "", "blocked")
    return marked.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_known")


def location_requests(extractions: DataFrame, endpoints: dict[str, str], default: str, least: float = 0.75) -> DataFrame:
    """One request per place (text, kind, confidence) of valid extractions with enough confidence."""
    rows = extractions.where("valid").select("post_id", F.posexplode("places").alias("location_index", "p")).select("post_id", "location_index", "p.*").where(F.col("confidence") >= least)
    table = F.create_map(*[F.lit(x) for kv in endpoints.items() for x in kv])
    return rows.withColumn("endpoint", F.coalesce(F.element_at(table, F.col("kind")), F.lit(default))).withColumn("request_id", F.concat_ws("__l", "post_id", "location_index"))


def group_points(posts: DataFrame, points: str = "points") -> DataFrame:
    """(post_id, group_id, indexes): a post's points by source request; points without one are groups of their own."""
    rows = posts.select("post_id", F.posexplode(points).alias("i", "p"))
    group = F.coalesce(F.col("p.request_id").cast("string"), F.concat(F.lit("point:"), "i"))
    return rows.groupBy("post_id", group.alias("group_id")).agg(F.array_sort(F.collect_list("i")).alias("indexes"))


def trip_inputs(trips: DataFrame, visits: DataFrame, posts: DataFrame, most: int = 700) -> DataFrame:
    """(trip_id, visits): ordered visits of each trip with their post's text cut to most characters."""
    rows = trips.select("trip_id", F.posexplode("visit_ids").alias("sequence", "visit_id")).join(visits, "visit_id").join(posts.select("post_id", F.substring("content", 1, most).alias("text")), "post_id", "left")
    return rows.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "visit_id", "kind", "text"))).alias("visits"))


def corpus(post: Column, parts: list[Column]) -> Column:
    """All text that may justify an answer: the post's and every part's, an array each."""
    return F.concat_ws("\n", post, *[F.array_join(p, "\n") for p in parts])


# Answers are JSON texts, one a row. A rule that is broken gives an error by name, a fixed value; the errors of a row are
# distinct and sorted.


def _field(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _shape(v: Column) -> Column:
    """The type of a variant by its name; empty where the field is missing."""
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _is(v: Column, kind: str) -> Column:
    return F.startswith(_shape(v), F.lit(kind))


def _text(v: Column, name: str) -> Column:
    """A field that is text, else null."""
    return F.when(_is(_field(v, name), "STRING"), _field(v, name, "string"))


def _items(v: Column, name: str) -> Column:
    """A field that is a list, as an array; else an empty array."""
    return F.when(_is(_field(v, name), "ARRAY"), _field(v, name, "array<variant>")).otherwise(F.array().cast("array<variant>"))


def _whole(v: Column) -> Column:
    """The whole number that a variant is, else null."""
    number = F.when(_shape(v).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(v, "$", "double"))
    return F.when(number == F.floor(number), number.cast("long"))


def _confident(v: Column, name: str = "confidence") -> Column:
    """Whether a field is a number from 0 to 1; numbers may be written as text, null counts as 0."""
    return F.coalesce((_shape(_field(v, name)) == "VOID") | _field(v, name, "double").between(0, 1), F.lit(False))


def _one_of(v: Column, name: str, values: list[str]) -> Column:
    return F.coalesce(_text(v, name).isin(values), F.lit(False))


def _when(rules: dict[str, Column], prefix: Column | None = None) -> Column:
    """The names of the broken rules, with a prefix."""
    names = [(F.lit(n) if prefix is None else F.concat(prefix, F.lit(n)), p) for n, p in rules.items()]
    return F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), n) for n, p in names]))


def _each(items: Column, name: str, rules: Callable[[Column, Column], Column]) -> Column:
    """The errors of all items of a list, given each item and what its errors begin with: name_position_."""
    return F.flatten(F.transform(items, lambda x, i: rules(x, F.concat(F.lit(f"{name}_"), i.cast("string"), F.lit("_")))))


def _judged(answers: DataFrame, own: str, lists: list[str], rules: Callable[[Column], list[Column]]) -> DataFrame:
    """Adds errors to answers: those of rules, if the answer is an object and its lists are lists; own is an id that it must not carry."""
    v = F.col("_v")
    early = _when({f"unexpected_{own}": _field(v, own).isNotNull()} | {f"{name}_not_array": ~_is(_field(v, name), "ARRAY") for name in lists})
    lists_ok = F.lit(True)
    for name in lists:
        lists_ok = lists_ok & _is(_field(v, name), "ARRAY")
    found = F.when(~_is(v, "OBJECT"), F.array(F.lit("top_level_not_object"))).when(~lists_ok, early).otherwise(F.flatten(F.array(early, *rules(v))))
    return answers.withColumn("_v", F.try_parse_json("answer")).withColumn("errors", F.array_sort(F.array_distinct(found))).drop("_v")


def _repeated(ids: Column) -> Column:
    """The elements that occur earlier in the array too."""
    return F.filter(ids, lambda x, i: F.array_position(ids, x) <= i)


def validate_plan(
    answers: DataFrame, relationships: list[str], place_kinds: list[str], roles: list[str], keyword_kinds: list[str], endpoints: list[str], generic: str,
    alias: str = "same_place_alias", clue: str = "place_clue", weak: tuple[str, ...] = ("not_a_place", "insufficient_evidence"), named: str = "restaurant_name", around: str = "around", longest: int = 80, most: int = 5,
) -> DataFrame:
    """Adds errors to plans (answer, candidates array of (index, kinds), evidence array of texts, geo_usable).

    Every candidate must be used exactly once, in a group or among those not assigned; keywords must stand in the evidence.
    """
    known, evidence = F.transform("candidates", lambda c: c["index"]), F.col("evidence")

    def used(items: Column, get: Callable[[Column], Column]) -> Column:
        return F.filter(F.transform(items, get), lambda x: F.array_contains(known, x))

    def group(g: Column, prefix: Column) -> Column:
        indexes = F.transform(_items(g, "candidate_indexes"), _whole)
        is_alias = _text(g, "relationship") == alias
        clues = F.filter("candidates", lambda c: (c["kinds"] == F.array(F.lit(clue))) & F.array_contains(indexes, c["index"]))
        asked, q = ~F.coalesce(_is(_field(g, "should_query"), "BOOLEAN") & ~_field(g, "should_query", "boolean"), F.lit(False)), _field(g, "query")
        keyword = F.coalesce(F.trim(_text(q, "keyword")), F.lit(""))
        rules = _when(
            {
                "candidate_indexes_invalid": F.size(indexes) == 0, "unknown_candidate_index": F.exists(indexes, lambda x: F.coalesce(~F.array_contains(known, x), F.lit(True))),
                "invalid_relationship": ~_one_of(g, "relationship", relationships), "alias_group_has_fewer_than_two_candidates": is_alias & _is(_field(g, "candidate_indexes"), "ARRAY") & (F.size(indexes) < 2),
                "invalid_place_kind": ~_one_of(g, "place_kind", place_kinds), "invalid_role": ~_one_of(g, "role", roles), "should_query_not_boolean": ~_is(_field(g, "should_query"), "BOOLEAN"),
                "invalid_confidence": ~_confident(g), "missing_evidence": F.size(_items(g, "evidence")) == 0, "query_should_be_null": ~asked & (_shape(q) != "VOID"),
                "weak_relationship_must_not_query": asked & _one_of(g, "relationship", list(weak)), "query_not_object": asked & ~_is(q, "OBJECT"),
            }, prefix,
        )
        of_query = _when(
            {
                "empty_keyword": keyword == "", "keyword_too_long": F.length(keyword) > longest, "invalid_keyword_kind": ~_one_of(q, "keyword_kind", keyword_kinds),
                "invalid_endpoint_hint": ~_one_of(q, "endpoint_hint", [e for e in endpoints if e != "none"]), "keyword_not_in_evidence": (keyword != "") & ~F.exists(evidence, lambda t: F.contains(t, keyword)),
                "generic_restaurant_description_as_keyword": (_text(q, "keyword_kind") == named) & keyword.rlike(generic), "around_without_usable_geo": (_text(q, "endpoint_hint") == around) & ~F.col("geo_usable"),
            }, prefix,
        )
        clue_errors = F.when(is_alias, F.transform(clues, lambda c: F.concat(prefix, F.lit("alias_contains_place_clue_only_candidate_"), c["index"].cast("string")))).otherwise(F.array())
        return F.when(~_is(g, "OBJECT"), F.array(F.concat(prefix, F.lit("not_object")))).otherwise(F.concat(rules, clue_errors, F.when(asked & _is(q, "OBJECT"), of_query).otherwise(F.array())))

    def unassigned(x: Column, prefix: Column) -> Column:
        index = _whole(_field(x, "candidate_index"))
        return _when({"unknown_candidate_index": ~F.coalesce(F.array_contains(known, index), F.lit(False)), "missing_reason": F.coalesce(F.trim(_text(x, "reason")), F.lit("")) == ""}, prefix)

    def rules(v: Column) -> list[Column]:
        groups, rest = _items(v, "place_groups"), _items(v, "unassigned_candidates")
        in_groups = used(F.flatten(F.transform(groups, lambda g: _items(g, "candidate_indexes"))), _whole)
        ids = F.concat(in_groups, used(rest, lambda x: _whole(_field(x, "candidate_index"))))
        asks = F.filter(groups, lambda g: _is(g, "OBJECT") & ~F.coalesce(_is(_field(g, "should_query"), "BOOLEAN") & ~_field(g, "should_query", "boolean"), F.lit(False)))
        named_id = lambda end: lambda x: F.concat(F.lit("candidate_"), x.cast("string"), F.lit(end))
        return [
            _when({"unassigned_candidates_not_array": ~_is(_field(v, "unassigned_candidates"), "ARRAY"), "too_many_queries": F.size(asks) > most}), _each(groups, "group", group), _each(rest, "unassigned", unassigned),
            F.transform(_repeated(ids), named_id("_assigned_more_than_once")), F.transform(F.array_except(known, ids), named_id("_not_accounted_for")),
        ]

    return _judged(answers, "post_id", ["place_groups"], rules)


def validate_decision(answers: DataFrame, kinds: dict[str, tuple[int, int, str]], own: str = "request_id") -> DataFrame:
    """Adds errors to decisions (answer, allowed_ids array of texts); kinds gives each decision's least and most ids, and what is wrong with other numbers."""

    def rules(v: Column) -> list[Column]:
        ids, listed = F.transform(_items(v, "selected_poi_ids"), lambda x: F.try_variant_get(x, "$", "string")), _is(_field(v, "selected_poi_ids"), "ARRAY")
        counts = F.lit(None).cast("string")
        for kind, (low, high, name) in kinds.items():
            counts = F.when(listed & (_text(v, "decision") == kind) & ~F.size(ids).between(low, high), name).otherwise(counts)
        plain = {
            "unexpected_post_id": _field(v, "post_id").isNotNull(), "invalid_decision": ~_one_of(v, "decision", list(kinds)), "selected_poi_ids_not_array": ~listed,
            "duplicate_selected_poi_ids": F.size(ids) != F.size(F.array_distinct(ids)), "invalid_confidence": ~_confident(v), "missing_reason": F.coalesce(F.trim(_text(v, "reason")), F.lit("")) == "",
        }
        unknown = F.transform(F.filter(ids, lambda x: F.coalesce(~F.array_contains(F.col("allowed_ids"), x), F.lit(True))), lambda x: F.concat(F.lit("unknown_poi_id:"), F.coalesce(x, F.lit("null"))))
        return [_when(plain), F.array_compact(F.array(counts)), unknown]

    return _judged(answers, own, [], rules)


def validate_entities(answers: DataFrame, types: list[str], most: int = 30) -> DataFrame:
    """Adds errors to lists of entities (answer, content)."""

    def rules(v: Column) -> list[Column]:
        entities = _items(v, "entities")
        keys = F.transform(entities, lambda e: F.concat_ws("\0", F.coalesce(_field(e, "type", "string"), F.lit("\1")), F.coalesce(_field(e, "text", "string"), F.lit("\1"))))

        def one(e: Column, prefix: Column) -> Column:
            text = _text(e, "text")
            return _when({"invalid_text": F.coalesce(text, F.lit("")) == "", "not_exact_substring": (text != "") & ~F.contains("content", text), "invalid_type": ~_one_of(e, "type", types), "invalid_confidence": ~_confident(e)}, prefix)

        twice = F.transform(F.filter(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda x: F.array_position(keys, x["k"]) <= x["i"]), lambda x: F.concat(F.lit("entity_"), x["i"].cast("string"), F.lit("_duplicate")))
        return [_when({"too_many_entities": F.size(entities) > most}), _each(entities, "entity", one), twice]

    return _judged(answers, "post_id", ["entities"], rules)


def validate_locations(answers: DataFrame, kinds: list[str], most: int = 3) -> DataFrame:
    """Adds errors to lists of places (answer, content), content being all text that counts as evidence."""

    def one(x: Column, prefix: Column) -> Column:
        text = F.trim(F.coalesce(_text(x, "text"), F.lit("")))
        return _when({"empty_text": text == "", "not_in_evidence": (text != "") & ~F.contains("content", text), "invalid_kind": ~_one_of(x, "kind", kinds), "invalid_confidence": ~_confident(x), "missing_evidence": F.trim(F.coalesce(_text(x, "evidence"), F.lit(""))) == ""}, prefix)

    return _judged(answers, "post_id", ["locations"], lambda v: [_when({"too_many_locations": F.size(_items(v, "locations")) > most}), _each(_items(v, "locations"), "location", one)])


def validate_assertion(answers: DataFrame, assertions: list[str], times: list[str], roles: list[str], statuses: list[str], blocked: list[str], place: str = "visit_place", firm: tuple[str, ...] = ("confirmed", "candidate_set")) -> DataFrame:
    """Adds errors to assertions (answer, content, method, groups array of (group_id, indexes)); points of a blocked method are no place of a visit."""

    def rules(v: Column) -> list[Column]:
        given = _items(v, "point_groups")
        ids = F.transform(given, lambda g: F.coalesce(_field(g, "group_id", "string"), F.lit("\1")))

        def one(g: Column, prefix: Column) -> Column:
            name, evidence = _text(g, "group_id"), _text(g, "evidence")
            own = F.filter("groups", lambda x: x["group_id"] == name)
            allowed = F.coalesce(F.get(F.transform(own, lambda x: x["indexes"]), F.lit(0)), F.array().cast("array<long>"))
            indexes = F.transform(_items(g, "selected_point_indexes"), _whole)
            return _when(
                {
                    "unknown_group_id": F.size(own) == 0, "invalid_role": ~_one_of(g, "role", roles), "invalid_selection_status": ~_one_of(g, "selection_status", statuses),
                    "forbidden_fallback_visit_place": F.col("method").isin(blocked) & (_one_of(g, "role", [place]) | _one_of(g, "selection_status", list(firm))), "indexes_not_array": ~_is(_field(g, "selected_point_indexes"), "ARRAY"),
                    "invalid_point_index": F.exists(indexes, lambda x: F.coalesce(~F.array_contains(allowed, x), F.lit(True))), "invalid_confidence": ~_confident(g), "invalid_evidence": evidence.isNull(), "evidence_not_exact": (evidence != "") & ~F.contains("content", evidence),
                }, prefix,
            )

        plain = {"invalid_visit_assertion": ~_one_of(v, "visit_assertion", assertions), "invalid_time_relation": ~_one_of(v, "time_relation", times), "invalid_confidence": ~_confident(v)}
        twice = F.transform(F.filter(F.transform(ids, lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda x: F.array_position(ids, x["k"]) <= x["i"]), lambda x: F.concat(F.lit("group_"), x["i"].cast("string"), F.lit("_duplicate_group")))
        listed = _is(_field(v, "point_groups"), "ARRAY")
        last = _when({"point_groups_not_array": ~listed, "invalid_reason": listed & _text(v, "reason").isNull()})
        return [_when(plain), last, _each(given, "group", one), twice]

    return _judged(answers, "post_id", [], rules)


def validate_narrative(answers: DataFrame, shortest: int = 2, longest: int = 40, most: int = 4) -> DataFrame:
    """Adds errors to narratives (answer, visit_ids and theme_ids arrays of texts)."""

    def rules(v: Column) -> list[Column]:
        themes, highlights = F.transform(_items(v, "theme_entity_ids"), lambda x: F.try_variant_get(x, "$", "string")), _items(v, "highlights")

        def one(h: Column, prefix: Column) -> Column:
            return _when({"unknown_visit": ~F.coalesce(F.array_contains("visit_ids", _field(h, "visit_id", "string")), F.lit(False)), "invalid_text": F.coalesce(_text(h, "text"), F.lit("")) == ""}, prefix)

        plain = {f"invalid_{f}": _text(v, f).isNull() for f in ("title", "subtitle", "summary", "uncertainty_note")} | {
            "title_length": ~F.length(_text(v, "title")).between(shortest, longest), "themes_not_array": ~_is(_field(v, "theme_entity_ids"), "ARRAY"), "highlights_not_array": ~_is(_field(v, "highlights"), "ARRAY"),
            "unknown_theme_id": F.exists(themes, lambda x: F.coalesce(~F.array_contains("theme_ids", x), F.lit(True))), "too_many_highlights": F.size(highlights) > most,
        }
        return [_when(plain), _each(highlights, "highlight", one)]

    return _judged(answers, "trip_id", [], rules)


def validate_conditions(requests: DataFrame, regions: DataFrame, years: tuple[int, int], nodes: tuple[int, int]) -> DataFrame:
    """Adds status and problems to requests (request_id, region, year, node_count): only known options are accepted."""
    rows = requests.join(regions.select("region").distinct().withColumn("_r", F.lit(True)), "region", "left")
    rules = {"unknown_region": F.col("region").isNotNull() & F.col("_r").isNull(), "year_out_of_range": ~F.col("year").between(*years), "node_count_out_of_range": ~F.col("node_count").between(*nodes)}
    out = rows.withColumn("problems", errors(rules)).drop("_r")
    return out.withColumn("status", F.when(F.size("problems") == 0, "parsed").otherwise("needs_clarification"))


def merge_narratives(trips: DataFrame, narratives: DataFrame) -> DataFrame:
    """Frozen trips (trip_id, title, visit_ids, ...) with validated texts; highlights outside the trip are dropped and counted."""
    n = narratives.select("trip_id", F.col("title").alias("_title"), F.col("highlights").alias("_h"))
    out = trips.join(n, "trip_id").withColumn("highlights", F.array_intersect("_h", "visit_ids"))
    return out.withColumn("repaired", F.size("_h") - F.size("highlights")).withColumn("base_title", F.col("title")).withColumn("title", F.coalesce(F.nullif(F.trim("_title"), F.lit("")), "title")).drop("_title", "_h")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)

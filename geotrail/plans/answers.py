"""Answers of an external service, right and wrong ones, beside the errors that each must get: worked out by hand, rule by rule.

A query gives every row of a table one of the answers, by its key; QQA and QQB in an answer stand for texts of the row.
"""

from __future__ import annotations

import copy
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Cases = list[tuple[str, list[str]]]


def changed(base: dict, *path_and_value: Any) -> dict:
    """A copy of base with other values at the given paths, such as "a.0.b"; DROP takes a field away."""
    out = copy.deepcopy(base)
    for path, value in zip(path_and_value[::2], path_and_value[1::2], strict=True):
        *way, last = [int(p) if p.isdigit() else p for p in path.split(".")]
        at: Any = out
        for p in way:
            at = at[p]
        if value is DROP:
            del at[last]
        else:
            at[last] = value
    return out


DROP = object()


def cases(base: dict, changes: list[tuple[tuple, list[str]]], whole: Cases = ()) -> Cases:
    """The base without errors, its changed forms, and some answers as they are."""
    return [(json.dumps(base), []), *[(json.dumps(changed(base, *change)), errors) for change, errors in changes], *whole]


def answer(of: Cases, key: Column, a: Column, b: Column | None = None) -> Column:
    text = F.element_at(F.array(*[F.lit(x) for x, _ in of]), (F.pmod(key, F.lit(len(of))) + 1).cast("int"))
    text = F.replace(text, F.lit("QQA"), a)
    return text if b is None else F.replace(text, F.lit("QQB"), b)


def errors_sql(of: Cases, key: str) -> str:
    """SQL for the errors that the answers of answer() must get, sorted and comma-joined."""
    listed = ", ".join("'" + ",".join(sorted(set(errors))) + "'" for _, errors in of)
    return f"([{listed}])[CAST(({key}) % {len(of)} AS BIGINT) + 1]"


GROUP = {
    "candidate_indexes": [0], "relationship": "single_candidate", "place_kind": "restaurant", "role": "primary_visit", "should_query": True, "confidence": 0.8, "evidence": ["seen"],
    "query": {"keyword": " QQA ", "keyword_kind": "restaurant_name", "endpoint_hint": "text"},
}
REST = {"candidate_index": 1, "reason": "too vague"}
PLAN = {"place_groups": [GROUP], "unassigned_candidates": [REST, {"candidate_index": 2, "reason": "a clue"}]}
G = "place_groups.0."
#: Candidates 0 to 2; the last is nothing but a clue.
PLANS = cases(
    PLAN,
    [
        (("post_id", 5), ["unexpected_post_id"]),
        (("place_groups", {}), ["place_groups_not_array"]),
        (("place_groups", DROP, "post_id", "x"), ["place_groups_not_array", "unexpected_post_id"]),
        (("unassigned_candidates", DROP), ["unassigned_candidates_not_array", "candidate_1_not_accounted_for", "candidate_2_not_accounted_for"]),
        (("unassigned_candidates", []), ["candidate_1_not_accounted_for", "candidate_2_not_accounted_for"]),
        (("place_groups", []), ["candidate_0_not_accounted_for"]),
        (("place_groups", ["x", GROUP]), ["group_0_not_object"]),
        ((G + "candidate_indexes", []), ["group_0_candidate_indexes_invalid", "candidate_0_not_accounted_for"]),
        ((G + "candidate_indexes", "0"), ["group_0_candidate_indexes_invalid", "candidate_0_not_accounted_for"]),
        ((G + "candidate_indexes", [0, 9]), ["group_0_unknown_candidate_index"]),
        ((G + "candidate_indexes", [0, 0.5]), ["group_0_unknown_candidate_index"]),
        ((G + "candidate_indexes", [0, "1"]), ["group_0_unknown_candidate_index"]),
        ((G + "candidate_indexes", [0, 0]), ["candidate_0_assigned_more_than_once"]),
        ((G + "candidate_indexes", [0, 1]), ["candidate_1_assigned_more_than_once"]),
        ((G + "relationship", "odd"), ["group_0_invalid_relationship"]),
        ((G + "relationship", DROP), ["group_0_invalid_relationship"]),
        ((G + "relationship", "same_place_alias"), ["group_0_alias_group_has_fewer_than_two_candidates"]),
        ((G + "relationship", "same_place_alias", G + "candidate_indexes", [0, 1], "unassigned_candidates.0", {"candidate_index": 2, "reason": "r"}, "unassigned_candidates.1", DROP), []),
        ((G + "relationship", "same_place_alias", G + "candidate_indexes", [0, 2], "unassigned_candidates.1", DROP), ["group_0_alias_contains_place_clue_only_candidate_2"]),
        ((G + "place_kind", "palace"), ["group_0_invalid_place_kind"]),
        ((G + "role", 7), ["group_0_invalid_role"]),
        ((G + "should_query", "yes"), ["group_0_should_query_not_boolean"]),
        ((G + "should_query", DROP), ["group_0_should_query_not_boolean"]),
        ((G + "confidence", 1.5), ["group_0_invalid_confidence"]),
        ((G + "confidence", DROP), ["group_0_invalid_confidence"]),
        ((G + "confidence", "high"), ["group_0_invalid_confidence"]),
        ((G + "confidence", "0.5"), []),
        ((G + "confidence", None), []),
        ((G + "evidence", []), ["group_0_missing_evidence"]),
        ((G + "evidence", "seen"), ["group_0_missing_evidence"]),
        ((G + "should_query", False, G + "query", None), []),
        ((G + "should_query", False), ["group_0_query_should_be_null"]),
        ((G + "should_query", False, G + "query", DROP), ["group_0_query_should_be_null"]),
        ((G + "relationship", "not_a_place"), ["group_0_weak_relationship_must_not_query"]),
        ((G + "relationship", "not_a_place", G + "should_query", False, G + "query", None), []),
        ((G + "query", None), ["group_0_query_not_object"]),
        ((G + "query", [1]), ["group_0_query_not_object"]),
        ((G + "query.keyword", "  "), ["group_0_empty_keyword"]),
        ((G + "query.keyword", 5), ["group_0_empty_keyword"]),
        ((G + "query.keyword", "k" * 81), ["group_0_keyword_too_long", "group_0_keyword_not_in_evidence"]),
        ((G + "query.keyword", "k" * 80), ["group_0_keyword_not_in_evidence"]),
        ((G + "query.keyword_kind", "odd"), ["group_0_invalid_keyword_kind"]),
        ((G + "query.endpoint_hint", "none"), ["group_0_invalid_endpoint_hint"]),
        ((G + "query.endpoint_hint", "near"), ["group_0_invalid_endpoint_hint"]),
        ((G + "query.endpoint_hint", "around"), ["group_0_around_without_usable_geo"]),
        ((G + "query.keyword", "this shop"), ["group_0_generic_restaurant_description_as_keyword"]),
        ((G + "query.keyword", "this shop", G + "query.keyword_kind", "place_name"), []),
        (("unassigned_candidates.0.candidate_index", 9), ["unassigned_0_unknown_candidate_index", "candidate_1_not_accounted_for"]),
        (("unassigned_candidates.0.candidate_index", "1"), ["unassigned_0_unknown_candidate_index", "candidate_1_not_accounted_for"]),
        (("unassigned_candidates.0", 1), ["unassigned_0_unknown_candidate_index", "unassigned_0_missing_reason", "candidate_1_not_accounted_for"]),
        (("unassigned_candidates.0.candidate_index", 0), ["candidate_0_assigned_more_than_once", "candidate_1_not_accounted_for"]),
        (("unassigned_candidates.1.reason", " "), ["unassigned_1_missing_reason"]),
        (("unassigned_candidates.1.reason", DROP), ["unassigned_1_missing_reason"]),
        (("place_groups", [GROUP] * 6), ["too_many_queries", "candidate_0_assigned_more_than_once"]),
        (("place_groups", [GROUP] * 5), ["candidate_0_assigned_more_than_once"]),
        (("place_groups", [GROUP] * 5 + [GROUP | {"should_query": False, "query": None}]), ["candidate_0_assigned_more_than_once"]),
    ],
    [("[1]", ["top_level_not_object"]), ("not json", ["top_level_not_object"]), ("null", ["top_level_not_object"])],
)
#: What the answers may hold.
RELATIONSHIPS = ["single_candidate", "same_place_alias", "same_brand_branch_uncertain", "historical_or_renamed", "not_a_place", "insufficient_evidence"]
PLACE_KINDS = ["restaurant", "street_food", "market", "hotel_food", "attraction", "building", "region", "other", "unknown"]
PLAN_ROLES = ["primary_visit", "secondary_visit", "comparison_only", "mentioned_only", "delivery_only", "unknown"]
KEYWORD_KINDS = ["restaurant_name", "place_name", "address_fragment", "market_name", "building_name", "other"]
ENDPOINTS = ["around", "text", "none"]
DECISION_KINDS = {
    "select_one": (1, 1, "select_one_requires_one_id"), "keep_multiple": (2, 5, "keep_multiple_requires_2_to_5_ids"),
    "reject_all": (0, 0, "empty_decision_requires_no_ids"), "insufficient_evidence": (0, 0, "empty_decision_requires_no_ids"),
}

DECISION = {"decision": "select_one", "selected_poi_ids": ["QQA"], "confidence": 0.7, "reason": "the name fits"}
DECISIONS = cases(
    DECISION,
    [
        (("post_id", 1), ["unexpected_post_id"]),
        (("request_id", 1), ["unexpected_request_id"]),
        (("decision", "perhaps"), ["invalid_decision"]),
        (("decision", DROP), ["invalid_decision"]),
        (("selected_poi_ids", "QQA"), ["selected_poi_ids_not_array"]),
        (("selected_poi_ids", ["QQA", "QQA"]), ["duplicate_selected_poi_ids", "select_one_requires_one_id"]),
        (("selected_poi_ids", ["other"]), ["unknown_poi_id:other"]),
        (("selected_poi_ids", []), ["select_one_requires_one_id"]),
        (("selected_poi_ids", ["QQA", "QQB"]), ["select_one_requires_one_id"]),
        (("decision", "keep_multiple"), ["keep_multiple_requires_2_to_5_ids"]),
        (("decision", "keep_multiple", "selected_poi_ids", ["QQA", "QQB"]), []),
        (("decision", "keep_multiple", "selected_poi_ids", ["QQA", "QQB", "a", "b", "c", "d"]), ["keep_multiple_requires_2_to_5_ids", "unknown_poi_id:a", "unknown_poi_id:b", "unknown_poi_id:c", "unknown_poi_id:d"]),
        (("decision", "reject_all"), ["empty_decision_requires_no_ids"]),
        (("decision", "insufficient_evidence"), ["empty_decision_requires_no_ids"]),
        (("decision", "reject_all", "selected_poi_ids", []), []),
        (("confidence", -0.1), ["invalid_confidence"]),
        (("confidence", DROP), ["invalid_confidence"]),
        (("reason", "  "), ["missing_reason"]),
        (("reason", 5), ["missing_reason"]),
    ],
    [("5", ["top_level_not_object"]), ("{", ["top_level_not_object"])],
)

ENTITY = {"text": "QQA", "type": "dish", "confidence": 0.9}
ENTITIES = cases(
    {"entities": [ENTITY, {"text": "QQA", "type": "region", "confidence": 1}]},
    [
        (("post_id", 1), ["unexpected_post_id"]),
        (("entities", "QQA"), ["entities_not_array"]),
        (("entities", DROP, "post_id", 1), ["entities_not_array", "unexpected_post_id"]),
        (("entities", []), []),
        (("entities", [ENTITY | {"type": "dish"}] * 2), ["entity_1_duplicate"]),
        (("entities", [ENTITY] * 31), ["too_many_entities", *[f"entity_{k}_duplicate" for k in range(1, 31)]]),
        (("entities.0.text", ""), ["entity_0_invalid_text"]),
        (("entities.0.text", 5), ["entity_0_invalid_text"]),
        (("entities.0", "x"), ["entity_0_invalid_text", "entity_0_invalid_type", "entity_0_invalid_confidence"]),
        (("entities.0.text", "~QQA~"), ["entity_0_not_exact_substring"]),
        (("entities.1.type", "city"), ["entity_1_invalid_type"]),
        (("entities.1.type", DROP), ["entity_1_invalid_type"]),
        (("entities.1.confidence", 2), ["entity_1_invalid_confidence"]),
        (("entities.1.confidence", "x"), ["entity_1_invalid_confidence"]),
    ],
    [("[]", ["top_level_not_object"]), ("", ["top_level_not_object"])],
)

LOCATION = {"text": " QQA ", "kind": "city", "confidence": 0.4, "evidence": "in the text"}
LOCATIONS = cases(
    {"locations": [LOCATION]},
    [
        (("post_id", 1), ["unexpected_post_id"]),
        (("locations", {}), ["locations_not_array"]),
        (("locations", []), []),
        (("locations", [LOCATION] * 3), []),
        (("locations", [LOCATION] * 4), ["too_many_locations"]),
        (("locations.0.text", " "), ["location_0_empty_text"]),
        (("locations.0.text", DROP), ["location_0_empty_text"]),
        (("locations.0.text", "~QQA~"), ["location_0_not_in_evidence"]),
        (("locations.0.kind", "planet"), ["location_0_invalid_kind"]),
        (("locations.0.confidence", -1), ["location_0_invalid_confidence"]),
        (("locations.0.evidence", " "), ["location_0_missing_evidence"]),
        (("locations.0.evidence", 3), ["location_0_missing_evidence"]),
        (("locations.0", 3), ["location_0_empty_text", "location_0_invalid_kind", "location_0_invalid_confidence", "location_0_missing_evidence"]),
    ],
    [("true", ["top_level_not_object"])],
)

POINTS = {"group_id": "g1", "role": "visit_place", "selection_status": "confirmed", "selected_point_indexes": [0], "confidence": 0.6, "evidence": "QQA"}
ASSERTION = {"visit_assertion": "visited", "time_relation": "current", "confidence": 0.9, "point_groups": [POINTS], "reason": ""}
P = "point_groups.0."
#: Groups g1 with the points 0 and 1, and g2 with the point 2; the location is of a method that is not blocked.
ASSERTIONS = cases(
    ASSERTION,
    [
        (("post_id", 1), ["unexpected_post_id"]),
        (("visit_assertion", "maybe"), ["invalid_visit_assertion"]),
        (("time_relation", DROP), ["invalid_time_relation"]),
        (("confidence", 7), ["invalid_confidence"]),
        (("point_groups", DROP), ["point_groups_not_array"]),
        (("point_groups", 4, "confidence", 7, "reason", DROP), ["point_groups_not_array", "invalid_confidence"]),
        (("reason", DROP), ["invalid_reason"]),
        (("reason", None), ["invalid_reason"]),
        ((P + "group_id", "g9", P + "selected_point_indexes", []), ["group_0_unknown_group_id"]),
        ((P + "group_id", "g9"), ["group_0_unknown_group_id", "group_0_invalid_point_index"]),
        (("point_groups", [POINTS, POINTS]), ["group_1_duplicate_group"]),
        ((P + "role", "guest"), ["group_0_invalid_role"]),
        ((P + "selection_status", "sure"), ["group_0_invalid_selection_status"]),
        ((P + "selected_point_indexes", "0"), ["group_0_indexes_not_array"]),
        ((P + "selected_point_indexes", [0, 2]), ["group_0_invalid_point_index"]),
        ((P + "selected_point_indexes", [0.5]), ["group_0_invalid_point_index"]),
        (("point_groups", [POINTS, POINTS | {"group_id": "g2", "selected_point_indexes": [2]}]), []),
        ((P + "confidence", DROP), ["group_0_invalid_confidence"]),
        ((P + "evidence", DROP), ["group_0_invalid_evidence"]),
        ((P + "evidence", ""), []),
        ((P + "evidence", "~QQA~"), ["group_0_evidence_not_exact"]),
    ],
    [("{}", ["invalid_visit_assertion", "invalid_time_relation", "invalid_confidence", "point_groups_not_array"]), ("x", ["top_level_not_object"])],
)
#: The same for a location of a blocked method.
BLOCKED = cases(
    changed(ASSERTION, P + "role", "mentioned_only", P + "selection_status", "rejected"),
    [
        ((P + "role", "visit_place"), ["group_0_forbidden_fallback_visit_place"]),
        ((P + "selection_status", "confirmed"), ["group_0_forbidden_fallback_visit_place"]),
        ((P + "selection_status", "candidate_set"), ["group_0_forbidden_fallback_visit_place"]),
        (("point_groups", []), []),
    ],
)

HIGHLIGHT = {"visit_id": "QQA", "text": "a day out"}
NARRATIVE = {"title": "A trip", "subtitle": "", "summary": "s", "uncertainty_note": "", "theme_entity_ids": ["QQB"], "highlights": [HIGHLIGHT]}
NARRATIONS = cases(
    NARRATIVE,
    [
        (("trip_id", 1), ["unexpected_trip_id"]),
        (("title", DROP), ["invalid_title"]),
        (("title", 5), ["invalid_title"]),
        (("subtitle", None), ["invalid_subtitle"]),
        (("summary", DROP), ["invalid_summary"]),
        (("uncertainty_note", DROP), ["invalid_uncertainty_note"]),
        (("title", "A"), ["title_length"]),
        (("title", "A" * 41), ["title_length"]),
        (("title", "A" * 40), []),
        (("theme_entity_ids", DROP), ["themes_not_array"]),
        (("theme_entity_ids", ["QQB", "x"]), ["unknown_theme_id"]),
        (("theme_entity_ids", []), []),
        (("highlights", "x"), ["highlights_not_array"]),
        (("highlights", [HIGHLIGHT] * 4), []),
        (("highlights", [HIGHLIGHT] * 5), ["too_many_highlights"]),
        (("highlights.0.visit_id", "x"), ["highlight_0_unknown_visit"]),
        (("highlights.0.text", ""), ["highlight_0_invalid_text"]),
        (("highlights.0", 1), ["highlight_0_unknown_visit", "highlight_0_invalid_text"]),
    ],
    [("7", ["top_level_not_object"])],
)

"""Views over the driver tables that stand for the engine's own record types (see FIXTURES.md).

Each view is one SELECT that both engines run; the few functions whose names differ are written as $name(...).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Names of the functions that differ, per engine.
_SPARK = {"$us": "unix_micros(cast({} as timestamp))", "$int": "cast({} as bigint)", "$words": "split({}, ' ')"}
_DUCK = {"$us": "epoch_us({})", "$int": "cast({} as bigint)", "$words": "string_split({}, ' ')"}

VIEWS = {
    "fx_visits": """
        SELECT event_id AS visit_id, $us(ts) AS t, concat('loc_', user_id) AS location_key, user_id AS place_id,
               CASE event_type WHEN 'error' THEN 'region_only' WHEN 'signup' THEN 'candidate' ELSE 'anchor' END AS eligibility,
               (50 + event_id % 50) / 100 AS confidence,
               (10000 + (user_id % 20) * 150 + (event_id % 10) * 5) / 100 AS lon,
               (2000 + (user_id % 15) * 120 + (event_id % 7) * 5) / 100 AS lat,
               user_id % 25 AS province, user_id % 50 AS city, event_type AS kind
        FROM {events}""",
    "fx_posts": """
        SELECT doc_id AS post_id, doc_id * 25200000000 AS t, text AS content, source AS region_name, lang, n_chars
        FROM {documents}""",
    "fx_media": """
        SELECT conv_id AS post_id, turn AS pic_index, role AS image_type, text AS description
        FROM {conversations}""",
    "fx_raw": """
        SELECT event_id AS line_no,
               CASE WHEN event_id % 97 = 0 THEN concat('{"id":', event_id)
                    WHEN event_id % 89 = 0 THEN '[1,2]'
                    WHEN event_id % 83 = 0 THEN ''
                    ELSE concat('{"id":', event_id,
                         CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ',"type":null' WHEN 2 THEN ',"type":""' WHEN 3 THEN ',"type":5'
                              ELSE concat(',"type":"', event_type, '"') END,
                         ',"props":', props, '}') END AS line
        FROM {events}""",
    "fx_requests": """
        SELECT o_orderkey AS request_id, o_custkey AS post_id, o_totalprice AS price,
               CASE WHEN o_orderpriority LIKE '1%' THEN 'restaurant' WHEN o_orderpriority LIKE '2%' THEN 'region' ELSE 'place' END AS place_kind,
               o_orderstatus AS status
        FROM {orders}""",
    "fx_candidates": """
        SELECT l_orderkey AS request_id, l_partkey AS poi_id, p_name AS name, p_brand AS region, p_type AS type_text,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS source_rank,
               (10000 + (l_partkey % 200) * 5) / 100 AS lon, (2000 + (l_suppkey % 100) * 5) / 100 AS lat
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "fx_reviews": """
        SELECT doc_id AS post_id, quality = 1 AS valid, toxic = 1 AS rejected
        FROM {labels}""",
    "fx_plans": """
        SELECT l_orderkey AS plan_id, l_linenumber AS group_index,
               CASE WHEN l_orderkey % 11 = 0 AND l_linenumber = 2 THEN 1
                    WHEN l_orderkey % 13 = 0 AND l_linenumber = 1 THEN 99 ELSE l_linenumber END AS candidate_index,
               l_returnflag AS role, l_discount * 10 AS confidence, l_quantity AS quantity
        FROM {lineitem}""",
    "fx_cells": """
        SELECT n_nationkey AS cell_id, n_name AS name, (1000 + (n_nationkey % 5) * 60) / 10 AS x0, (1060 + (n_nationkey % 5) * 60) / 10 AS x1,
               (200 + floor(n_nationkey / 5) * 36) / 10 AS y0, (236 + floor(n_nationkey / 5) * 36) / 10 AS y1,
               concat(lpad(cast(n_regionkey AS string), 2, '0'), lpad(cast(n_nationkey AS string), 2, '0')) AS code
        FROM {nation}""",
}


def _translated(sql: str, names: dict[str, str]) -> str:
    for name, form in names.items():
        sql = re.sub(re.escape(name) + r"\(([^()]*)\)", lambda m, form=form: form.format(m[1]), sql)
    return sql


def _tables(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{([a-z]+)\}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name, or a driver table by its own name."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    sql = _translated(VIEWS[name], _SPARK)
    names = _tables(sql)
    sql = re.sub(r"\{(?![a-z]+\})", "{{", sql)
    sql = re.sub(r"(?<!\w)\}|\}(?=')", "}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in names})


def oracle(sql: str) -> str:
    """SQL for the other engine: the views that it names are put in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = ",\n".join(f"{v} AS ({re.sub(r'[{]([a-z]+)[}]', r'\1', _translated(VIEWS[v], _DUCK))})" for v in used)
    sql = sql.strip()
    if not used:
        return sql
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", sql):
        return f"WITH {m[1] or ''}{ctes},\n{sql[m.end():]}"
    return f"WITH {ctes}\n{sql}"

"""Queries of the families m (contracts), n (serving) and v (audit)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, contracts, serve
from ..sources.io import written as stored
from . import answers
from .columns import km
from .groups import BUILT, SEGMENTS, built
from .records import ITEMS, label_items
from .registry import Inputs, query
from .relations import MEMBERS, members

C = F.col


def joined(*parts: str) -> str:
    """SQL for the comma-joined names whose conditions hold; parts are name, condition, name, condition..."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {p} THEN '{n}' END" for n, p in zip(parts[::2], parts[1::2], strict=True)) + ")"


def written(df, column: str = "errors"):
    return df.withColumn(column, F.concat_ws(",", column))


@query("""
    SELECT doc_id AS post_id, concat('{"lang":"', lang, '"', CASE WHEN c IS NOT NULL THEN concat(',"candidates":[', c, ']') ELSE '' END, CASE WHEN m IS NOT NULL THEN concat(',"media":[', m, ']') ELSE '' END, '}') AS input FROM documents
    LEFT JOIN (SELECT o_custkey, string_agg(concat('{"o_orderkey":', o_orderkey, '}'), ',' ORDER BY o_orderkey) AS c FROM orders GROUP BY 1) ON o_custkey = doc_id
    LEFT JOIN (SELECT conv_id, string_agg(concat('{"turn":', turn, ',"role":"', role, '"}'), ',' ORDER BY turn) AS m FROM conversations GROUP BY 1) ON conv_id = doc_id""")
def m01_build_input(t: Inputs):
    docs = t.documents.select(C("doc_id").alias("post_id"), "lang")
    return contracts.build_input(docs, t.orders.select(C("o_custkey").alias("post_id"), "o_orderkey"), t.conversations.select(C("conv_id").alias("post_id"), "turn", "role"))


PLACE_GROUPS = "(SELECT request_id AS post_id, source_rank AS group_index, CASE poi_id % 4 WHEN 0 THEN 'restaurant' WHEN 1 THEN 'region' WHEN 2 THEN 'place' ELSE 'other' END AS place_kind, 'visit_place' AS role, CASE WHEN poi_id % 9 = 0 THEN ' ' ELSE name END AS keyword, CASE WHEN poi_id % 5 > 0 THEN region END AS region, poi_id % 6 > 0 AS should_query, poi_id % 11 > 0 AS valid FROM fx_candidates)"
ENDPOINTS = {"restaurant": "text", "region": "district", "place": "around"}


def place_groups(t: Inputs):
    return t.fx_candidates.selectExpr(
        "request_id AS post_id", "source_rank AS group_index", "CASE poi_id % 4 WHEN 0 THEN 'restaurant' WHEN 1 THEN 'region' WHEN 2 THEN 'place' ELSE 'other' END AS place_kind", "'visit_place' AS role",
        "CASE WHEN poi_id % 9 = 0 THEN ' ' ELSE name END AS keyword", "CASE WHEN poi_id % 5 > 0 THEN region END AS region", "poi_id % 6 > 0 AS should_query", "poi_id % 11 > 0 AS valid",
    )


@query(f"""
    SELECT concat(post_id, '__g', group_index) AS request_id, CASE place_kind WHEN 'restaurant' THEN 'text' WHEN 'region' THEN 'district' WHEN 'place' THEN 'around' END AS endpoint, nullif(trim(keyword), '') AS keywords, region,
           CASE WHEN trim(keyword) = '' THEN 'empty_keyword' WHEN place_kind = 'other' THEN 'unknown_kind' END AS blocked_reason FROM {PLACE_GROUPS} WHERE should_query""")
def m02_create_requests(t: Inputs):
    r = contracts.create_requests(place_groups(t), ENDPOINTS)
    return r.select("request_id", "endpoint", C("parameters")["keywords"].alias("keywords"), C("parameters")["region"].alias("region"), "blocked_reason")


@query(f"""
    SELECT concat(post_id, '__g', group_index) AS request_id, CASE WHEN place_kind = 'place' AND region IS NULL THEN 'text' ELSE CASE place_kind WHEN 'restaurant' THEN 'text' WHEN 'region' THEN 'district' WHEN 'place' THEN 'around' END END AS endpoint,
           CASE WHEN place_kind = 'place' AND region IS NULL THEN 'around' END AS original_endpoint, CASE WHEN place_kind = 'place' AND region IS NULL THEN 'no_region' END AS fallback_reason FROM {PLACE_GROUPS} WHERE should_query""")
def m03_endpoint_fallback(t: Inputs):
    r = contracts.create_requests(place_groups(t), ENDPOINTS)
    out = contracts.endpoint_fallback(r, "around", "text", ["region"], "no_region", ~F.map_contains_key("parameters", "region"))
    return out.select("request_id", "endpoint", "original_endpoint", "fallback_reason")


@query(f"""
    SELECT post_id, group_index, reason FROM (SELECT post_id, group_index, CASE WHEN NOT valid THEN 'invalid' WHEN post_id NOT IN (SELECT doc_id FROM documents) THEN 'source_missing' WHEN place_kind NOT IN ('restaurant', 'place') THEN 'kind_excluded' WHEN trim(keyword) = '' THEN 'blocked' END AS reason FROM {PLACE_GROUPS}) WHERE reason IS NOT NULL""")
def m04_exclusions(t: Inputs):
    known = t.documents.select(C("doc_id").alias("post_id"))
    return contracts.exclusions(place_groups(t), known, ["restaurant", "place"]).select("post_id", "group_index", "reason")


@query(f"""
    SELECT concat(post_id, '__l', location_index) AS request_id, name AS text, CASE coalesce(source, 'none') WHEN 'text' THEN 'around' ELSE 'text' END AS endpoint FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY pic_index, pos) - 1 AS location_index FROM {ITEMS}) WHERE post_id % 3 > 0 AND confidence >= 0.75""")
def m05_location_requests(t: Inputs):
    place = F.struct("pic_index", "pos", C("name").alias("text"), F.coalesce("source", F.lit("none")).alias("kind"), "confidence")
    lists = label_items(t).groupBy("post_id").agg(F.array_sort(F.collect_list(place)).alias("places")).withColumn("valid", C("post_id") % 3 > 0)
    return contracts.location_requests(lists, {"text": "around"}, "text").select("request_id", "text", "endpoint")


@query("""
    SELECT post_id, group_id, string_agg(CAST(i AS STRING), ',' ORDER BY i) AS indexes FROM (SELECT l_orderkey AS post_id, i, CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_linenumber % 2 AS STRING) ELSE concat('point:', i) END AS group_id FROM (
        SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))) GROUP BY 1, 2""")
def m06_group_points(t: Inputs):
    point = F.struct("l_linenumber", F.when(C("l_linenumber") % 3 > 0, C("l_linenumber") % 2).alias("request_id"))
    posts = t.lineitem.select(C("l_orderkey").alias("post_id"), "l_linenumber").distinct().groupBy("post_id").agg(F.array_sort(F.collect_list(point)).alias("points"))
    return contracts.group_points(posts).withColumn("indexes", F.concat_ws(",", C("indexes").cast("array<string>")))


@query(f"""SELECT trip_id, count(*) AS visits, string_agg(concat(visit_id, kind, coalesce(substr(text, 1, 50), '')), '|' ORDER BY t, visit_id) AS input FROM (SELECT m.trip_id, m.t, m.visit_id, kind, text FROM {MEMBERS} m JOIN fx_visits USING (visit_id) LEFT JOIN documents ON doc_id = visit_id) GROUP BY 1""")
def m07_trip_inputs(t: Inputs):
    lists = members(t).groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "visit_id"))), lambda x: x["visit_id"]).alias("visit_ids"))
    visits = t.fx_visits.select("visit_id", "kind", C("visit_id").alias("post_id"))
    out = contracts.trip_inputs(lists, visits, t.fx_posts, 50)
    piece = lambda x: F.concat(x["visit_id"].cast("string"), x["kind"], F.coalesce(x["text"], F.lit("")))
    return out.select("trip_id", F.size("visits").cast("long").alias("visits"), F.concat_ws("|", F.transform("visits", piece)).alias("input"))


@query("""SELECT c_custkey, concat_ws(chr(10), c_name, string_agg(o_orderpriority, chr(10) ORDER BY o_orderkey)) AS corpus FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def m08_evidence_corpus(t: Inputs):
    lists = t.orders.groupBy(C("o_custkey").alias("c_custkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("parts"))
    return t.customer.join(lists, "c_custkey").select("c_custkey", contracts.corpus(C("c_name"), [C("parts")]).alias("corpus"))


#: A word of each text, or a fixed one where it has none.
WORD = "coalesce(nullif(regexp_extract({}, '[A-Za-z]{{3,}}', 0), ''), 'fallback')"


def word(column: str):
    return F.expr(WORD.format(column))


@query(f"SELECT doc_id AS post_id, {answers.errors_sql(answers.PLANS, 'doc_id')} AS errors FROM documents")
def m09_validate_plan(t: Inputs):
    candidates = F.array(*[F.struct(F.lit(k).cast("long").alias("index"), F.array(*map(F.lit, kinds)).alias("kinds")) for k, kinds in enumerate((["name"], ["name", "place_clue"], ["place_clue"]))])
    rows = t.documents.select(
        C("doc_id").alias("post_id"), answers.answer(answers.PLANS, C("doc_id"), word("text")).alias("answer"), candidates.alias("candidates"),
        F.array("text", F.lit("fallback"), F.lit("from this shop")).alias("evidence"), F.lit(False).alias("geo_usable"),
    )
    lists = (answers.RELATIONSHIPS, answers.PLACE_KINDS, answers.PLAN_ROLES, answers.KEYWORD_KINDS, answers.ENDPOINTS)
    return written(contracts.validate_plan(rows, *lists, generic="(this|a) (shop|restaurant)")).select("post_id", "errors")


@query(f"SELECT request_id, {answers.errors_sql(answers.DECISIONS, 'request_id')} AS errors FROM (SELECT DISTINCT request_id FROM fx_candidates)")
def m10_validate_decision(t: Inputs):
    rows = t.fx_candidates.groupBy("request_id").agg(F.max("poi_id").cast("string").alias("x"))
    allowed = F.array("x", F.concat(F.lit("p"), "x"))
    rows = rows.select("request_id", allowed.alias("allowed_ids"), answers.answer(answers.DECISIONS, C("request_id"), C("x"), F.concat(F.lit("p"), "x")).alias("answer"))
    return written(contracts.validate_decision(rows, answers.DECISION_KINDS)).select("request_id", "errors")


@query(f"SELECT post_id, pic_index, {answers.errors_sql(answers.ENTITIES, 'post_id + pic_index')} AS errors FROM fx_media")
def m11_validate_entities(t: Inputs):
    rows = t.fx_media.select("post_id", "pic_index", F.concat("description", F.lit(" fallback")).alias("content"), answers.answer(answers.ENTITIES, C("post_id") + C("pic_index"), word("description")).alias("answer"))
    return written(contracts.validate_entities(rows, ["restaurant", "dish", "cuisine", "region"])).select("post_id", "pic_index", "errors")


@query(f"SELECT post_id, pic_index, {answers.errors_sql(answers.LOCATIONS, 'post_id + pic_index')} AS errors FROM fx_media")
def m12_validate_locations(t: Inputs):
    rows = t.fx_media.select("post_id", "pic_index", F.concat("description", F.lit(" fallback")).alias("content"), answers.answer(answers.LOCATIONS, C("post_id") + C("pic_index"), word("description")).alias("answer"))
    return written(contracts.validate_locations(rows, ["city", "region", "place"])).select("post_id", "pic_index", "errors")


@query(f"SELECT doc_id AS post_id, CASE WHEN lang = 'en' THEN {answers.errors_sql(answers.BLOCKED, 'doc_id')} ELSE {answers.errors_sql(answers.ASSERTIONS, 'doc_id')} END AS errors FROM documents")
def m13_validate_assertion(t: Inputs):
    group = lambda name, indexes: F.struct(F.lit(name).alias("group_id"), F.array(*[F.lit(k).cast("long") for k in indexes]).alias("indexes"))
    blocked = C("lang") == "en"
    given = F.when(blocked, answers.answer(answers.BLOCKED, C("doc_id"), word("text"))).otherwise(answers.answer(answers.ASSERTIONS, C("doc_id"), word("text")))
    rows = t.documents.select(
        C("doc_id").alias("post_id"), given.alias("answer"), F.concat("text", F.lit(" fallback")).alias("content"), F.when(blocked, "time_neighbor").otherwise("scored").alias("method"), F.array(group("g1", (0, 1)), group("g2", (2,))).alias("groups")
    )
    out = contracts.validate_assertion(rows, ["visited", "planned", "none"], ["current", "past"], ["visit_place", "mentioned_only"], ["confirmed", "candidate_set", "rejected"], ["time_neighbor", "region", "default"])
    return written(out).select("post_id", "errors")


NARRATIVES = f"(SELECT trip_id, CASE WHEN n % 5 = 0 THEN ' ' WHEN n % 7 = 0 THEN repeat('long ', 10) ELSE concat('trip of ', n) END AS title, n, first + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS pick, n > 9 AS much FROM (SELECT trip_id, count(*) AS n, min(visit_id) AS first FROM {MEMBERS} GROUP BY 1))"


def narrated(t: Inputs):
    m = members(t).groupBy("trip_id").agg(F.count("*").alias("n"), F.min("visit_id").alias("first"), F.array_sort(F.collect_list("visit_id")).alias("visit_ids"))
    title = F.when(C("n") % 5 == 0, " ").when(C("n") % 7 == 0, "long " * 10).otherwise(F.concat(F.lit("trip of "), "n"))
    pick = F.when(C("n") % 3 == 0, C("first") + 1).otherwise(C("first"))
    return m.select("trip_id", "n", "visit_ids", title.alias("title"), F.when(C("n") > 9, F.slice("visit_ids", 1, 5)).otherwise(F.array(pick)).alias("highlights"))


@query(f"SELECT trip_id, {answers.errors_sql(answers.NARRATIONS, 'first')} AS errors FROM (SELECT trip_id, min(visit_id) AS first FROM {MEMBERS} GROUP BY 1)")
def m14_validate_narrative(t: Inputs):
    m = members(t).groupBy("trip_id").agg(F.min("visit_id").alias("first"), F.array_sort(F.collect_list("visit_id")).cast("array<string>").alias("visit_ids"), F.array(F.min("place_id").cast("string")).alias("theme_ids"))
    rows = m.withColumn("answer", answers.answer(answers.NARRATIONS, C("first"), C("first").cast("string"), F.get("theme_ids", F.lit(0))))
    return written(contracts.validate_narrative(rows)).select("trip_id", "errors")


@query("""
    SELECT request_id, problems, CASE WHEN problems = '' THEN 'parsed' ELSE 'needs_clarification' END AS status FROM (SELECT o_orderkey AS request_id, """ + joined("unknown_region", "o_custkey % 40 >= 25", "year_out_of_range", "NOT year(o_orderdate) BETWEEN 1993 AND 1997", "node_count_out_of_range", "NOT o_orderkey % 10 BETWEEN 2 AND 7") + " AS problems FROM orders)")
def m15_validate_conditions(t: Inputs):
    requests = t.orders.select(C("o_orderkey").alias("request_id"), F.concat(F.lit("NATION_"), C("o_custkey") % 40).alias("region"), F.year("o_orderdate").alias("year"), (C("o_orderkey") % 10).alias("node_count"))
    out = contracts.validate_conditions(requests, t.nation.select(F.concat(F.lit("NATION_"), "n_nationkey").alias("region")), (1993, 1997), (2, 7))
    return written(out, "problems").select("request_id", "problems", "status")


@query(f"""SELECT r.trip_id, CASE WHEN trim(title) = '' THEN 'plain' ELSE trim(title) END AS title, 'plain' AS base_title, CASE WHEN NOT much AND pick NOT IN (SELECT visit_id FROM {MEMBERS} x WHERE x.trip_id = r.trip_id) THEN 1 ELSE 0 END AS repaired FROM {NARRATIVES} r""")
def m16_merge_narratives(t: Inputs):
    n = narrated(t)
    return contracts.merge_narratives(n.select("trip_id", "visit_ids", F.lit("plain").alias("title")), n).select("trip_id", "title", "base_title", C("repaired").cast("long"))


@query(f"""
    SELECT trip_id, start FROM (SELECT trip_id, min(t) AS start, any_value(place_id) % 25 AS province, string_agg(kind, ' ' ORDER BY t, visit_id) AS text FROM (SELECT m.*, kind FROM {MEMBERS} m JOIN fx_visits USING (visit_id)) GROUP BY 1)
    WHERE contains(text, 'click view') AND year(make_timestamp(start)) BETWEEN 2020 AND 2030 AND province = 3""")
def n01_trip_search(t: Inputs):
    m = members(t).join(t.fx_visits.select("visit_id", "kind", "province"), "visit_id")
    trips = m.groupBy("trip_id").agg(F.min("t").alias("start"), F.collect_set("province").alias("provinces"), F.array_sort(F.collect_list(F.struct("t", "visit_id", "kind"))).alias("l"))
    trips = trips.select("trip_id", "start", "provinces", F.concat_ws(" ", F.transform("l", lambda x: x["kind"])).alias("text"), F.year(F.timestamp_micros("start")).alias("year"))
    trips = stored(trips)
    return serve.search_trips(trips, text="click view", years=(2020, 2030), province=3, index=serve.index(trips)).select("trip_id", "start")


@query(f"""
    SELECT trip_id, lower(concat_ws('|', concat('Trip', trip_id), string_agg(kind, '|' ORDER BY t, visit_id), string_agg(location_key, '|' ORDER BY t, visit_id))) AS text FROM (SELECT m.*, kind, location_key FROM {MEMBERS} m JOIN fx_visits USING (visit_id)) GROUP BY 1""")
def n02_search_document(t: Inputs):
    m = members(t).join(t.fx_visits.select("visit_id", "kind", "location_key"), "visit_id")
    from pyspark.sql.window import Window as W

    m = m.withColumn("position", F.row_number().over(W.partitionBy("trip_id").orderBy("t", "visit_id")))
    trips = m.select("trip_id", F.concat(F.lit("Trip "), "trip_id").alias("title")).distinct()
    return serve.search_documents(trips, [m.select("trip_id", "position", C("kind").alias("text")), m.select("trip_id", "position", C("location_key").alias("text"))])


@query("""
    SELECT visit_id, coalesce(CASE WHEN r_name IS NOT NULL THEN concat_ws('/', r_name, CASE WHEN n_nationkey % 4 > 0 THEN n_name END) END, CASE WHEN c_mktsegment IS NOT NULL THEN concat_ws('/', c_mktsegment, c_name) END, CASE WHEN lon < 115 THEN 'domestic' ELSE 'overseas' END) AS region_key
    FROM fx_visits LEFT JOIN nation ON n_nationkey = province AND n_nationkey % 3 = 0 LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_custkey = place_id AND c_custkey % 2 = 0""")
def n03_region_option(t: Inputs):
    regions = t.nation.where("n_nationkey % 3 = 0").join(t.region, C("r_regionkey") == C("n_regionkey")).select(C("n_nationkey").cast("long").alias("region_id"), C("r_name").alias("region_province"), F.when(C("n_nationkey") % 4 > 0, C("n_name")).alias("region_city"))
    places = t.customer.where("c_custkey % 2 = 0").select(C("c_custkey").alias("place_id"), C("c_mktsegment").alias("place_province"), C("c_name").alias("place_city"))
    return serve.region_option(t.fx_visits.select("visit_id", C("province").alias("region_id"), "place_id", (C("lon") < 115).alias("domestic")), regions, places)


@query(f"""
    WITH d AS (SELECT DISTINCT place_id, 'post' AS kind, kind AS id FROM fx_visits UNION ALL SELECT DISTINCT v.place_id, 'trip', trip_id FROM fx_visits v JOIN {MEMBERS} m USING (visit_id)),
         p AS (SELECT *, (row_number() OVER (PARTITION BY place_id, kind ORDER BY id) - 1) // 3 AS page FROM d), k AS (SELECT c_custkey AS place_id, unnest(['post', 'trip']) AS kind FROM customer)
    SELECT place_id, kind, coalesce(page, 0) AS page, coalesce(string_agg(id, ',' ORDER BY id), '') AS ids FROM k LEFT JOIN p USING (place_id, kind) GROUP BY ALL""")
def n04_place_pages(t: Inputs):
    visits = t.fx_visits.select("visit_id", "place_id", C("kind").alias("post_id"))
    out = serve.place_pages(t.customer.select(C("c_custkey").alias("place_id")), visits, members(t).select("visit_id", "trip_id"), 3)
    return out.withColumn("ids", F.concat_ws(",", "ids"))


@query("SELECT doc_id, source, position FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS position FROM documents) WHERE position <= 6")
def n05_region_pages(t: Inputs):
    out = serve.region_pages(t.documents, "source", [C("n_chars").desc(), C("doc_id")])
    return out.select("doc_id", "source", C("position").cast("long"))


@query(f"SELECT trip_id, visit_id, sequence, coalesce(posts, '') AS posts FROM (SELECT trip_id, visit_id, row_number() OVER (PARTITION BY trip_id ORDER BY t, visit_id) - 1 AS sequence FROM {MEMBERS}) LEFT JOIN (SELECT conv_id, string_agg(CAST(turn AS STRING), ',' ORDER BY turn) AS posts FROM conversations GROUP BY 1) ON conv_id = visit_id")
def n06_trip_details(t: Inputs):
    from ..operators.sequences import route_sequence

    m = route_sequence(members(t), ["trip_id"]).select("trip_id", "visit_id", C("sequence").cast("long").alias("sequence"))
    out = serve.trip_details(m, t.conversations.select(C("conv_id").alias("visit_id"), C("turn").alias("post_id")))
    return out.withColumn("posts", F.concat_ws(",", C("posts").cast("array<string>")))


@query("SELECT visit_id, has_food, CASE WHEN has_food THEN eligibility ELSE 'context' END AS role FROM (SELECT *, kind = 'purchase' OR place_id IN (SELECT conv_id FROM conversations WHERE contains(text, 'the')) AS has_food FROM fx_visits)")
def n07_food_evidence(t: Inputs):
    evidence = t.conversations.where("contains(text, 'the')").select(C("conv_id").alias("place_id"))
    out = serve.food_evidence(t.fx_visits.withColumn("role", C("eligibility")), C("kind") == "purchase", evidence, "place_id")
    return out.select("visit_id", "has_food", "role")


@query(f"SELECT post_id, pic_index, string_agg(name, ',' ORDER BY pos) FILTER (n <= 3) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY post_id, pic_index ORDER BY pos) AS n FROM {ITEMS}) GROUP BY 1, 2")
def n08_public_post(t: Inputs):
    lists = label_items(t).groupBy("post_id", "pic_index").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "confidence"))).alias("labels"))
    return serve.public_post(lists, ["post_id", "pic_index"], "labels", 3).withColumn("labels", F.concat_ws(",", "labels"))


@query(f"""
    WITH v AS (SELECT * FROM fx_visits), c AS (SELECT a.visit_id, count(*) AS n FROM v a JOIN v b ON a.province = b.province AND a.visit_id <> b.visit_id AND {km('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 30 GROUP BY 1)
    SELECT visit_id, coalesce(n, 0) AS neighbors, coalesce(n, 0) >= 4 AS viable FROM v LEFT JOIN c USING (visit_id)""")
def n09_neighborhoods(t: Inputs):
    return serve.neighborhoods(t.fx_visits, 30, 5, "province")


@query(f"""
    WITH x AS (SELECT a.visit_id AS anchor_id, b.visit_id, round({km('a.lon', 'a.lat', 'b.lon', 'b.lat')} + 60.0 * abs(a.city - b.city), 6) AS score
               FROM fx_visits a JOIN fx_visits b ON a.province = b.province AND a.visit_id <> b.visit_id WHERE a.visit_id % 50 = 0)
    SELECT * FROM (SELECT anchor_id, visit_id, round(score, 3) AS score, row_number() OVER (PARTITION BY anchor_id ORDER BY score, visit_id) AS rank FROM x) WHERE rank <= 5""")
def n10_nearest_k(t: Inputs):
    v = t.fx_visits.select("visit_id", "province", "lon", "lat", C("city").alias("year"))
    out = serve.nearest_k(v.where("visit_id % 50 = 0"), v, "province", 5)
    return out.select("anchor_id", "visit_id", F.round("score", 3).alias("score"), C("rank").cast("long"))


@query(f"""
    WITH RECURSIVE n AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY span) AS n FROM (SELECT concat(place_id, '-', CAST(floor(t / 259200000000) AS BIGINT)) AS span, visit_id AS node, lon + visit_id % 97 / 1000 AS lon, lat + visit_id % 89 / 1000 AS lat FROM fx_visits WHERE eligibility = 'anchor')),
    p AS (SELECT span, n, [node] AS path, 0.0::DOUBLE AS km, lon, lat FROM n WHERE n <= 7 UNION ALL
          SELECT n.span, n.n, list_append(path, node), p.km + {km('p.lon', 'p.lat', 'n.lon', 'n.lat')}, n.lon, n.lat FROM p JOIN n ON n.span = p.span WHERE NOT list_contains(path, node))
    SELECT span, round(min(km), 3) AS km, 'solved' AS status FROM p WHERE len(path) = n GROUP BY 1 UNION ALL SELECT DISTINCT span, NULL, 'too_many' FROM n WHERE n > 7""")
def n11_shortest_order(t: Inputs):
    v = t.fx_visits.where("eligibility = 'anchor'").withColumn("span", F.concat("place_id", F.lit("-"), F.floor(C("t") / 259_200_000_000)))
    v = v.select("span", C("visit_id").alias("node"), (C("lon") + C("visit_id") % 97 / 1000).alias("lon"), (C("lat") + C("visit_id") % 89 / 1000).alias("lat"))
    return serve.shortest_order(v, "span").select("span", F.round("km", 3).alias("km"), "status")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def v01_unique_keys(t: Inputs):
    return audit.not_unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def v02_references(t: Inputs):
    return audit.dangling(t.lineitem, "l_orderkey", t.orders.where("o_orderstatus <> 'F'"), "o_orderkey")


@query("SELECT visit_id FROM fx_visits WHERE lon * 1.5 > 180")
def v03_ranges(t: Inputs):
    return audit.out_of_range(t.fx_visits.withColumn("lon", C("lon") * 1.5)).select("visit_id")


@query("SELECT c_custkey, c_name, 'lost' AS side FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, concat(c_name, '!'), 'new' FROM customer WHERE c_mktsegment = 'BUILDING'")
def v04_preserved(t: Inputs):
    before = t.customer.select("c_custkey", "c_name")
    name = F.when(C("c_mktsegment") == "BUILDING", F.concat("c_name", F.lit("!"))).otherwise(C("c_name"))
    after = t.customer.select("c_custkey", name.alias("c_name"), F.lit(1).alias("extra"))
    return audit.not_preserved(before, after, ["extra"])


@query("SELECT doc_id FROM documents WHERE doc_id % 6 = 0 OR n_chars < 8")
def v05_slices(t: Inputs):
    m = t.documents.select("doc_id", C("text").alias("content"), F.lit(3).alias("start"), F.lit(8).alias("end"), F.when(C("doc_id") % 6 == 0, F.lit("#####")).otherwise(F.substring("text", 4, 5)).alias("term"))
    return audit.bad_slices(m).select("doc_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate > l_shipdate")
def v06_time_order(t: Inputs):
    rows = t.lineitem.join(t.orders, C("o_orderkey") == C("l_orderkey"))
    return audit.bad_time_order(rows, "o_orderdate", "l_shipdate").select("l_orderkey", "l_linenumber")


@query(f"WITH RECURSIVE {SEGMENTS} SELECT trip_id FROM {BUILT} WHERE visits % 4 = 0")
def v07_route_alignment(t: Inputs):
    trips = built(t).withColumn("visit_ids", F.when(F.size("route") % 4 == 0, F.reverse("visit_ids")).otherwise(C("visit_ids")))
    return audit.misaligned(trips).select("trip_id")


@query(f"""SELECT visit_id, 'candidate_and_member' AS problem FROM {MEMBERS} WHERE visit_id % 9 = 0 UNION ALL SELECT visit_id, 'in_two_trips' FROM {MEMBERS} WHERE visit_id % 50 = 0""")
def v08_exclusive_membership(t: Inputs):
    m = members(t).select("trip_id", "visit_id")
    twice = m.where("visit_id % 50 = 0").withColumn("trip_id", F.concat("trip_id", F.lit("x")))
    return audit.shared_members(m.unionByName(twice), t.fx_visits.where("visit_id % 9 = 0"))


@query("SELECT visit_id, 'low_confidence_anchor' AS rule FROM fx_visits WHERE eligibility = 'anchor' AND confidence < 0.55 UNION ALL SELECT visit_id, 'region_without_region' FROM fx_visits WHERE eligibility = 'region_only' AND province = 0")
def v09_forbidden_method(t: Inputs):
    rules = {"low_confidence_anchor": (C("eligibility") == "anchor") & (C("confidence") < 0.55), "region_without_region": (C("eligibility") == "region_only") & (C("province") == 0)}
    return audit.forbidden(t.fx_visits, rules)


@query("SELECT doc_id, 'left_only' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right_only' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def v10_full_coverage(t: Inputs):
    return audit.uncovered(t.documents, t.labels, "doc_id")


@query("SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS n, true AS equal UNION ALL SELECT 'open', (SELECT count(*) FROM orders WHERE o_orderstatus = 'O'), (SELECT count(*) = count(*) FILTER (o_orderstatus = 'O') FROM orders)")
def v11_row_parity(t: Inputs):
    return audit.row_parity({"orders": t.orders, "open": t.orders.where("o_orderstatus = 'O'")})


#: What is wrong in the tables of v12, and how often: a count for each check, and the table that it examines. Some posts, visits and trips are there twice.
FIRST = "regexp_extract(text, '^[^ ]*', 0)"
TWICE = {"post": "doc_id % 97 = 0", "visit": "visit_id % 89 = 0", "trip": "start % 7 = 0"}
TRIP_SIZES = f"(SELECT trip_id, min(t) AS start, count(*) AS n FROM {MEMBERS} GROUP BY 1)"
VISIT_ROWS = f"(SELECT v.* FROM fx_visits v JOIN (SELECT unnest([1, 2]) AS copy) ON copy = 1 OR {TWICE['visit']})"
TRIP_ROWS = f"(SELECT s.* FROM {TRIP_SIZES} s JOIN (SELECT unnest([1, 2]) AS copy) ON copy = 1 OR {TWICE['trip']})"
WRONG = {
    "post_row_counts_equal": (f"(SELECT (count(*) FILTER ({TWICE['post']}) > 0)::INT FROM documents)", "POSTS"),
    "source_values_preserved": ("(SELECT 2 * count(*) FILTER (lang = 'fr') FROM documents)", "documents"),
    "located_values_preserved": (f"(SELECT count(*) FILTER ({TWICE['post']}) FROM documents)", "documents"),
    "unique_post_ids": (f"(SELECT count(*) FILTER ({TWICE['post']}) FROM documents)", "POSTS"),
    "mention_slices_valid": (f"(SELECT count(*) FILTER (lang = 'de') FROM documents WHERE {FIRST} <> '')", "MENTIONS"),
    "mention_overlap_free": (f"(SELECT count(*) FILTER (lang = 'es') FROM documents WHERE {FIRST} <> '')", "MENTIONS"),
    "place_coordinates_valid": ("(SELECT count(*) FILTER (c_mktsegment = 'BUILDING') FROM customer)", "customer"),
    "unique_visit_ids": (f"(SELECT count(*) FILTER ({TWICE['visit']}) FROM fx_visits)", "VISITS"),
    "visit_references_valid": (f"(SELECT count(*) FILTER (visit_id NOT IN (SELECT doc_id FROM documents)) + count(*) FILTER (place_id NOT IN (SELECT c_custkey FROM customer)) + count(*) FILTER (city NOT IN (SELECT n_nationkey FROM nation)) FROM {VISIT_ROWS})", "VISITS"),
    "visit_times_valid": (f"(SELECT count(*) FILTER (kind = 'error') FROM {VISIT_ROWS})", "VISITS"),
    "no_forbidden_fallback_route_anchors": (f"(SELECT count(*) FILTER (eligibility = 'anchor' AND kind = 'view') FROM {VISIT_ROWS})", "VISITS"),
    "roles_cover_all_posts": ("(SELECT count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) FROM documents)", "labels"),
    "role_references_valid": ("(SELECT count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents)) + count(*) FILTER (doc_id NOT IN (SELECT visit_id FROM fx_visits)) FROM labels)", "labels"),
    "unique_trip_ids": (f"(SELECT count(*) FILTER ({TWICE['trip']}) FROM {TRIP_SIZES})", "TRIPS"),
    "trip_references_valid": (f"(SELECT sum(CASE WHEN {TWICE['trip']} THEN 2 ELSE 1 END * (visit_id NOT IN (SELECT doc_id FROM documents))::INT + ({TWICE['trip']})::INT)::BIGINT FROM {MEMBERS} JOIN {TRIP_SIZES} USING (trip_id))", "TRIPS"),
    "trip_times_valid": (f"(SELECT count(*) FILTER (start % 5 = 0) FROM {TRIP_ROWS})", "TRIPS"),
    "trip_routes_valid": (f"(SELECT count(*) FILTER (n < 2) FROM {TRIP_ROWS})", "TRIPS"),
    "narrative_ids_valid": (f"(SELECT count(*) FILTER (n > 20 AND start % 11 > 0) FROM {TRIP_SIZES})", "NARRATIVES"),
    "secondary_references_valid": ("(SELECT count(*) FROM fx_visits WHERE eligibility = 'candidate')", "CANDIDATES"),
    "narratives_cover_all_trips": (f"(SELECT count(*) FILTER (start % 11 = 0) FROM {TRIP_SIZES})", "NARRATIVES"),
}
SIZES = {"MENTIONS": f"(SELECT count(*) + count(*) FILTER (lang = 'es') FROM documents WHERE {FIRST} <> '')", "TRIPS": f"(SELECT count(*) FROM {TRIP_ROWS})", "NARRATIVES": f"(SELECT count(*) FROM {TRIP_SIZES} WHERE start % 11 > 0)", "VISITS": f"(SELECT count(*) FROM {VISIT_ROWS})",
         "POSTS": f"(SELECT count(*) + count(*) FILTER ({TWICE['post']}) FROM documents)", "CANDIDATES": "(SELECT count(*) FROM fx_visits WHERE eligibility = 'candidate')"}
AUDITED = " UNION ALL ".join(
    f"SELECT '{name}' AS check_name, {wrong} AS failures, {SIZES.get(table, f'(SELECT count(*) FROM {table})')} AS examined, false AS warn" for name, (wrong, table) in WRONG.items()
)


@query(f"""
    WITH a AS ({AUDITED} UNION ALL SELECT 'low_confidence', (SELECT count(*) FROM fx_visits WHERE confidence < 0.52), NULL, true), s AS (SELECT *, CASE WHEN failures = 0 THEN 'pass' WHEN warn THEN 'warning' ELSE 'fail' END AS status FROM a)
    SELECT check_name, failures, examined, status FROM s UNION ALL SELECT 'overall', sum(failures) FILTER (status = 'fail'), NULL, CASE WHEN bool_and(status <> 'fail') THEN 'pass' ELSE 'fail' END FROM s""")
def v12_audit_report(t: Inputs):
    d = t.documents.select(C("doc_id").alias("post_id"), C("text").alias("content"), "lang")
    first = F.regexp_extract("content", "^[^ ]*", 0)
    m = d.withColumn("text", first).where("text <> ''").withColumn("end", F.length("text")).select("post_id", "lang", "end", F.when(C("lang") == "de", F.concat("text", F.lit("~"))).otherwise(C("text")).alias("text"))
    m = m.select("post_id", "text", "end", F.explode(F.when(C("lang") == "es", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("mention_id"))
    m = m.select("post_id", "text", F.lit(0).alias("start"), "end", F.concat_ws("-", "post_id", "mention_id").alias("mention_id"), F.lit("e").alias("entity_id"))
    ids = lambda c: F.array(C(c))
    visits = t.fx_visits.select(
        "visit_id", C("t").alias("start"), F.when(C("kind") == "error", C("t") - 1).otherwise(C("t")).alias("end"), ids("visit_id").alias("post_ids"), "place_id", F.array().cast("array<bigint>").alias("candidate_ids"),
        C("city").alias("region_id"), "eligibility", F.when(C("kind") == "view", "time_neighbor").otherwise("scored").alias("method"), "kind", "confidence",
    )
    copies = lambda df, twice: df.withColumn("_c", F.explode(F.when(F.expr(twice), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_c")
    visits = copies(visits, TWICE["visit"])
    step = F.struct("t", "visit_id")
    trips = members(t).groupBy("trip_id").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.array_sort(F.collect_list(step)).alias("route"))
    listed = F.transform("route", lambda r: r["visit_id"])
    trips = stored(trips.select("trip_id", "start", F.when(C("start") % 5 == 0, C("start") - 1).otherwise(C("end")).alias("end"), "route", listed.alias("visit_ids"), listed.alias("post_ids"), F.array(F.lit("e")).alias("theme_ids")))
    told = F.when(F.size("visit_ids") > 20, F.array(F.lit("e"), F.lit("f"))).otherwise(F.array(F.lit("e")))
    tables = {
        "source": d, "located": d.select("post_id", F.when(C("lang") == "fr", F.concat("content", F.lit("!"))).otherwise(C("content")).alias("content"), "lang", F.lit("r").alias("region")),
        "mentions": m, "entities": t.spark.createDataFrame([("e",)], "entity_id string"), "visits": visits, "trips": copies(trips, TWICE["trip"]), "narratives": trips.where("start % 11 > 0").select("trip_id", F.slice("visit_ids", 1, 2).alias("highlight_ids"), told.alias("theme_ids")),
        "places": t.customer.select(C("c_custkey").alias("place_id"), F.when(C("c_mktsegment") == "BUILDING", 200.0).otherwise(100.0).alias("lon"), F.lit(1.0).alias("lat")), "regions": t.nation.select(C("n_nationkey").alias("region_id")),
        "roles": t.labels.select(C("doc_id").alias("post_id"), ids("doc_id").alias("visit_ids")), "candidates": t.fx_visits.where("eligibility = 'candidate'").select(F.concat(F.lit("none-"), "place_id").alias("trip_id"), "visit_id"),
        "contexts": trips.select("trip_id", F.lit(None).cast("long").alias("post_id"), F.get("visit_ids", F.lit(0)).alias("visit_id"), C("trip_id").alias("other_trip_id")),
    }
    tables["posts"] = copies(tables["located"].withColumn("mentions", F.lit(1)), TWICE["post"].replace("doc_id", "post_id"))
    return audit.final_audit(tables, ["time_neighbor", "region", "default"], {"low_confidence": t.fx_visits.where("confidence < 0.52")})


@query("SELECT title, count(*) AS n FROM (SELECT concat(kind, ' ', place_id) AS title FROM fx_visits) GROUP BY 1 HAVING count(*) > 1")
def v13_duplicate_titles(t: Inputs):
    return audit.duplicate_titles(t.fx_visits.select(F.concat_ws(" ", "kind", "place_id").alias("title")), "title")

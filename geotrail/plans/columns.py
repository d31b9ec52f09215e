"""Queries of the families d (text) and e (geography)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import geo, text
from .registry import Inputs, query

C = F.col


#: These texts hold no compatibility characters, so the canonical forms that the other engine has are the same.
@query(r"SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]+', '', 'g') AS norm FROM documents")
def d01_norm_nfkd(t: Inputs):
    return t.documents.select("doc_id", text.norm_nfkd(C("text")).alias("norm"))


@query(r"SELECT doc_id, regexp_replace(lower(nfc_normalize(text)), '[\s\p{P}]+', '', 'g') AS norm FROM documents")
def d02_norm_nfkc(t: Inputs):
    return t.documents.select("doc_id", text.norm_nfkc(C("text"), punctuation=True).alias("norm"))


NAMED = """CASE p_partkey % 9 WHEN 0 THEN concat(p_name, '（', p_brand, '店）') WHEN 1 THEN concat(p_name, '总店') WHEN 2 THEN concat(p_name, ' (', p_brand, ')') WHEN 3 THEN concat(p_name, '第', p_size, '分店') WHEN 4 THEN concat(p_name, '直营店(中心) ')
    WHEN 5 THEN concat(p_name, '店') WHEN 6 THEN concat(p_name, '新店') WHEN 7 THEN concat(p_name, '饭店') ELSE concat('(广场)', p_name) END"""


@query(f"""
    WITH n AS (SELECT p_partkey, {NAMED} AS name FROM part)
    SELECT p_partkey, regexp_replace(regexp_replace(name, '[（(][^()（）]*(总店|分店|旗舰店|店|馆|商场|中心|广场)[^()（）]*[)）]\\s*$', ''), '(总店|旗舰店|直营店|第\\d+分店|分店)$', '') AS base,
           regexp_replace(regexp_replace(name, '(旗舰|总|分|新|老)?店$', ''), '(餐厅|饭店|酒家|酒楼|菜馆|食府|小馆|面馆|火锅|烧烤)$', '') AS plain FROM n""")
def d03_base_name(t: Inputs):
    named = t.part.select("p_partkey", F.expr(NAMED).alias("name"))
    return named.select("p_partkey", text.base_name(C("name")).alias("base"), text.base_of_normalized(C("name")).alias("plain"))


#: Pairs of names: each part beside the part 13 keys on, with texts that hold one another, branches, short ones and none.
PAIRS = "(SELECT a.p_partkey, a.p_name AS a, CASE WHEN a.p_partkey % 10 = 0 THEN concat(a.p_name, ' ', b.p_brand) WHEN a.p_partkey % 17 = 0 THEN '' WHEN a.p_partkey % 19 = 0 THEN substr(a.p_name, 1, 1 + a.p_partkey % 4) WHEN a.p_partkey % 23 = 0 THEN '#' WHEN a.p_partkey % 11 = 0 THEN concat(a.p_name, '总店') WHEN a.p_partkey % 7 = 0 THEN concat(b.p_name, ' (', a.p_partkey, '店)') ELSE b.p_name END AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 13)"
#: The other engine counts edits by bytes, so each letter beyond ASCII is written as one that no name has.
EDIT = "CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 WHEN a = b THEN 1.0 ELSE 1 - levenshtein(translate(a, '总店', '~^'), translate(b, '总店', '~^'))::DOUBLE / greatest(length(a), length(b)) END"
EITHER = "(length(a) > 0 AND length(b) > 0 AND (contains(a, b) OR contains(b, a)))"
RATIO = "least(length(a), length(b))::DOUBLE / greatest(length(a), length(b))"


def pairs(t: Inputs):
    a, b = t.part.alias("a"), t.part.alias("b")
    key, name = C("a.p_partkey"), C("a.p_name")
    second = F.when(key % 10 == 0, F.concat_ws(" ", name, "b.p_brand")).when(key % 17 == 0, "").when(key % 19 == 0, F.substring(name, F.lit(1), (1 + key % 4).cast("int"))).when(key % 23 == 0, "#")
    second = second.when(key % 11 == 0, F.concat(name, F.lit("总店"))).when(key % 7 == 0, F.concat("b.p_name", F.lit(" ("), key, F.lit("店)"))).otherwise(C("b.p_name"))
    return a.join(b, C("b.p_partkey") == key + 13).select("a.p_partkey", name.alias("a"), second.alias("b"))


@query(f"SELECT p_partkey, round({EDIT}, 6) AS similarity FROM {PAIRS}")
def d04_edit_similarity(t: Inputs):
    return pairs(t).select("p_partkey", F.round(text.edit_similarity(C("a"), C("b")), 6).alias("similarity"))


@query(f"SELECT p_partkey, round(CASE WHEN a = b AND length(a) > 0 THEN 1.0 WHEN {EITHER} THEN 0.75 + 0.2 * {RATIO} ELSE {EDIT} END, 6) AS similarity FROM {PAIRS}")
def d05_contain_similarity(t: Inputs):
    return pairs(t).select("p_partkey", F.round(text.contain_similarity(C("a"), C("b")), 6).alias("similarity"))


@query(f"""
    WITH p AS (SELECT * FROM {PAIRS}), g AS (
        SELECT p_partkey, 'a' AS side, unnest(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS g FROM p
        UNION ALL SELECT p_partkey, 'b', unnest(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) FROM p),
    n AS (SELECT p_partkey, g, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM g GROUP BY ALL),
    s AS (SELECT p_partkey, 2 * sum(least(na, nb))::DOUBLE / sum(na + nb) AS plain FROM n GROUP BY p_partkey)
    SELECT p_partkey, round(CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0 WHEN a = b THEN 1 WHEN {EITHER}
           THEN CASE WHEN least(length(a), length(b)) >= 3 THEN greatest(0.65, {RATIO}) WHEN least(length(a), length(b)) = 2 THEN greatest(0.5, {RATIO}) ELSE {RATIO} END
           WHEN least(length(a), length(b)) = 1 THEN 0 ELSE plain END, 6) AS dice
    FROM p LEFT JOIN s USING (p_partkey)""")
def d06_dice_bigrams(t: Inputs):
    return pairs(t).select("p_partkey", F.round(text.dice(C("a"), C("b")), 6).alias("dice"))


BASED = r"""(SELECT *, regexp_replace(regexp_replace(a, '[（(][^()（）]*(总店|分店|旗舰店|店|馆|商场|中心|广场)[^()（）]*[)）]\s*$', ''), '(总店|旗舰店|直营店|第\d+分店|分店)$', '') AS ba,
    regexp_replace(regexp_replace(b, '[（(][^()（）]*(总店|分店|旗舰店|店|馆|商场|中心|广场)[^()（）]*[)）]\s*$', ''), '(总店|旗舰店|直营店|第\d+分店|分店)$', '') AS bb FROM {})"""


def of(expr: str, a: str, b: str) -> str:
    """The expression over a and b for two other columns."""
    return re.sub(r"\b([ab])\b", lambda m: a if m[1] == "a" else b, expr)


@query(f"""SELECT p_partkey, CASE WHEN a = b THEN 'normalized_equal' WHEN lower(ba) = lower(bb) AND ba <> '' THEN 'base_equal' WHEN {EITHER} THEN 'contains' WHEN {EDIT} >= 0.7 THEN 'edit_similar' ELSE 'different' END AS relation, round({EDIT}, 6) AS score
    FROM {BASED.format(PAIRS)}""")
def d07_name_relation(t: Inputs):
    r = text.name_relation(C("a"), C("b"), C("a"), C("b"))
    return pairs(t).select("p_partkey", r.alias("r")).select("p_partkey", "r.relation", F.round("r.score", 6).alias("score"))


INSIDE = f"({of(EITHER, 'ba', 'bb')} AND least(length(ba), length(bb)) >= 2)"


@query(f"""
    WITH p AS (SELECT p_partkey, lower(trim(a)) AS a, lower(trim(b)) AS b, b AS name, lower(trim(ba)) AS ba, lower(trim(bb)) AS bb, f FROM (SELECT *, 1 AS f FROM {BASED.format(PAIRS)} UNION ALL SELECT *, 0 FROM {BASED.format(f"(SELECT p_partkey, a, 'plain part' AS b FROM {PAIRS})")})),
         e AS (SELECT *, {EDIT} AS edit, {of(EDIT, 'ba', 'bb')} AS base FROM p WHERE b <> ''),
         s AS (SELECT *, CASE WHEN a = b THEN 1.0 WHEN ba = bb AND ba <> '' THEN greatest(0.96, edit, base) WHEN {INSIDE} THEN greatest(edit, base, 0.72 + 0.18 * {of(RATIO, 'ba', 'bb')}) ELSE greatest(edit, base) END AS score,
                      CASE WHEN a = b THEN 'exact' WHEN ba = bb AND ba <> '' THEN 'same_base' WHEN {INSIDE} THEN 'contains' WHEN base > edit THEN 'base_edit' ELSE 'edit' END AS kind FROM e),
         r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, f DESC) AS n FROM s)
    SELECT p_partkey, round(score, 6) AS score, CASE WHEN score > 0 THEN kind ELSE 'none' END AS kind, CASE WHEN score > 0 THEN name ELSE '' END AS name FROM r WHERE n = 1""")
def d08_best_name_match(t: Inputs):
    best = text.best_name(C("a"), F.array("b", F.lit("plain part")))
    return pairs(t).select("p_partkey", best.alias("m")).select("p_partkey", F.round("m.score", 6).alias("score"), "m.kind", "m.name")


@query("SELECT s_suppkey, concat_ws(',', CASE WHEN contains(s_name, '1') THEN '1' END, CASE WHEN contains(s_name, '42') THEN '42' END, CASE WHEN contains(n_name, 'NATION_1') THEN 'NATION_1' END) AS clues FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def d09_clue_match(t: Inputs):
    rows = t.supplier.join(t.nation, C("s_nationkey") == C("n_nationkey"))
    hit = lambda words, field: text.clue_match(F.array(*map(F.lit, words)), F.array(field))
    return rows.select("s_suppkey", F.concat_ws(",", F.concat(hit(["1", "42"], "s_name"), hit(["NATION_1"], "n_name"))).alias("clues"))


@query("""SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN CAST(p_size AS STRING) LIKE '4%' OR p_type LIKE '%S%' WHEN p_brand LIKE '%2' THEN CAST(p_size AS STRING) LIKE '1%' OR regexp_matches(p_type, '^[A-M]') ELSE true END AS fits FROM part""")
def d10_type_compat(t: Inputs):
    kind = F.when(C("p_brand").endswith("1"), "place").when(C("p_brand").endswith("2"), "region").otherwise("other")
    return t.part.select("p_partkey", text.type_compat(kind, C("p_size").cast("string"), C("p_type"), {"place": ("4", "S"), "region": ("1", "^[A-M]")}).alias("fits"))


@query("SELECT p_partkey, lower(trim(p_type)) IN ('economy', 'small') OR regexp_matches(p_type, '(?i)^standard|ed$') AS generic FROM part")
def d11_generic_name(t: Inputs):
    return t.part.select("p_partkey", text.is_generic(C("p_type"), ["^standard", "ed$"], ["economy", "small"]).alias("generic"))


@query("SELECT c_custkey, concat('customer_', substr(sha256(concat(c_name, chr(0), CAST(c_nationkey AS STRING))), 1, 20)) AS id FROM customer")
def d12_stable_id(t: Inputs):
    return t.customer.select("c_custkey", text.stable_id("customer", C("c_name"), C("c_nationkey")).alias("id"))


@query("SELECT c_custkey, concat_ws(' ', c_mktsegment, c_name, c_mktsegment) AS flat FROM customer")
def d13_flatten_text(t: Inputs):
    nested = t.customer.select("c_custkey", "c_mktsegment", F.struct("c_name", "c_nationkey", F.array("c_mktsegment").alias("tags")).alias("inner"))
    return nested.select("c_custkey", text.flatten_text(nested).alias("flat"))


@query("SELECT visit_id, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.65 THEN 'medium' ELSE 'low' END AS bin FROM fx_visits")
def d14_confidence_bin(t: Inputs):
    return t.fx_visits.select("visit_id", text.confidence_bin(C("confidence")).alias("bin"))


@query("""SELECT visit_id, CASE WHEN visit_id % 7 > 1 THEN lon END AS lng, CASE WHEN visit_id % 7 > 1 THEN lat END AS lat, CASE WHEN visit_id % 7 > 1 THEN printf('%.6f,%.6f', lon, lat) END AS location FROM fx_visits""")
def d15_parse_lnglat(t: Inputs):
    raw = F.when(C("visit_id") % 7 == 0, "x,y").when(C("visit_id") % 7 == 1, F.concat(F.lit("999,"), "lat")).otherwise(F.concat_ws(",", C("lon").cast("string"), C("lat").cast("string")))
    return t.fx_visits.select("visit_id", text.parse_lnglat(raw).alias("p")).select("visit_id", "p.lng", "p.lat", "p.location")


@query("SELECT n_nationkey, n_nationkey % 3 = 0 AS region FROM nation")
def d16_region_like(t: Inputs):
    name = F.when(C("n_nationkey") % 3 == 0, F.concat("n_name", F.lit("市"))).when(C("n_nationkey") % 3 == 1, F.lit("市")).otherwise(C("n_name"))
    return t.nation.select("n_nationkey", text.looks_like_region(name).alias("region"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'somewhere' ELSE c_mktsegment END AS destination FROM customer")
def d17_title_destination(t: Inputs):
    title = F.when(C("c_custkey") % 4 == 0, "A Trip to ").otherwise(F.concat_ws(" ", F.lit("a trip to"), "c_mktsegment", F.lit("Journey")))
    return t.customer.select("c_custkey", text.destination(title, ["a trip to", "journey"], "somewhere").alias("destination"))


@query("SELECT doc_id, CASE WHEN contains(text, 'tion') THEN 'north' WHEN contains(text, 'eau') THEN 'west' WHEN contains(text, 'ung') THEN 'east' END AS area FROM documents")
def d18_text_admin(t: Inputs):
    return t.documents.select("doc_id", text.admin_from_text(C("text"), {"tion": "north", "eau": "west", "ung": "east"}).alias("area"))


@query("""
    WITH s AS (SELECT o_orderkey, o_orderdate AS a, max(l_shipdate) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT o_orderkey, year(a) AS year, strftime(a, '%Y-%m-%d') AS label, CASE WHEN strftime(a, '%Y-%m-%d') = strftime(b, '%Y-%m-%d') THEN strftime(a, '%Y-%m-%d') ELSE concat(strftime(a, '%Y-%m-%d'), ' - ', strftime(b, '%Y-%m-%d')) END AS range_label,
           round((epoch_us(b) - epoch_us(a)) / 3.6e9, 4) AS hours, round((epoch_us(b) - epoch_us(a)) / 8.64e10, 4) AS days FROM s""")
def d19_date_parts(t: Inputs):
    spans = t.orders.join(t.lineitem, C("l_orderkey") == C("o_orderkey")).groupBy("o_orderkey", C("o_orderdate").cast("timestamp").alias("a")).agg(F.max("l_shipdate").cast("timestamp").alias("b"))
    d = spans.select("o_orderkey", text.date_parts(C("a"), C("b")).alias("d")).select("o_orderkey", "d.*")
    return d.withColumns({"year": C("year").cast("long"), "hours": F.round("hours", 4), "days": F.round("days", 4)})


#: The sum of all four makes it null where one is, as the least of two values ignores a null.
HAV = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2)) + 0 * ({a} + {b} + {c} + {d})))"


def km(a: str, b: str, c: str, d: str) -> str:
    return HAV.format(a=a, b=b, c=c, d=d)


@query(f"SELECT visit_id, round({km('lon', 'lat', '116.4', '39.9')}, 3) AS km FROM fx_visits")
def e01_haversine(t: Inputs):
    return t.fx_visits.select("visit_id", F.round(geo.haversine(C("lon"), C("lat"), F.lit(116.4), F.lit(39.9)), 3).alias("km"))


@query("SELECT visit_id, lon BETWEEN 100 AND 115 AND lat BETWEEN 21 AND 30 AS inside FROM fx_visits")
def e02_bbox_predicate(t: Inputs):
    return t.fx_visits.select("visit_id", geo.in_bbox(C("lon"), C("lat"), (100, 115, 21, 30)).alias("inside"))


def cells(t: Inputs):
    """Cells as rings; cell 7 has a hole, cell 12 is two parts with a gap between."""
    x0, x1, y0, y1 = C("x0"), C("x1"), C("y0"), C("y1")
    whole, hole = geo.rectangle(x0, y0, x1, y1), geo.rectangle(x0 + 2, y0 + 1, x0 + 4, y0 + 2)
    rings = F.when(C("cell_id") == 7, F.array(whole, hole)).when(C("cell_id") == 12, F.array(geo.rectangle(x0, y0, x0 + 2, y1), geo.rectangle(x0 + 4, y0, x1, y1))).otherwise(F.array(whole))
    return t.fx_cells.select("cell_id", "name", "code", rings.alias("rings"))


IN_CELL = """(lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1 AND NOT (cell_id = 7 AND lon >= x0 + 2 AND lon < x0 + 4 AND lat >= y0 + 1 AND lat < y0 + 2) AND NOT (cell_id = 12 AND lon >= x0 + 2 AND lon < x0 + 4))"""


@query(f"SELECT visit_id, cell_id FROM fx_visits JOIN fx_cells ON {IN_CELL}")
def e03_point_in_polygon(t: Inputs):
    return geo.pip_join(t.fx_visits.select("visit_id", "lon", "lat"), cells(t)).select("visit_id", "cell_id")


@query(f"SELECT visit_id, cell_id, code, r_name AS parent FROM fx_visits LEFT JOIN fx_cells ON {IN_CELL} LEFT JOIN region ON lpad(CAST(r_regionkey AS STRING), 2, '0') = substr(code, 1, 2)")
def e04_reverse_geocode(t: Inputs):
    parents = t.region.select(F.lpad(C("r_regionkey").cast("string"), 2, "0").alias("prefix"), C("r_name").alias("parent"))
    return geo.reverse_geocode(t.fx_visits.select("visit_id", "lon", "lat"), cells(t), parents).select("visit_id", "cell_id", "code", "parent")


@query("SELECT cell_id, round(x0, 6) AS west, round(x1, 6) AS east, round(y0, 6) AS south, round(y1, 6) AS north FROM fx_cells")
def e05_bbox_of_geometry(t: Inputs):
    box = cells(t).select("cell_id", geo.bbox_of(C("rings")).alias("b")).select("cell_id", "b.*")
    return box.select("cell_id", *[F.round(c, 6).alias(c) for c in ("west", "east", "south", "north")])


@query("""
    SELECT cell_id FROM fx_cells WHERE cell_id % 8 <= 6 AND ((x0 <= 110 AND x1 >= 100 AND y0 <= 24 AND y1 >= 20)
        OR EXISTS (SELECT 1 FROM fx_visits WHERE NOT (lon BETWEEN 100 AND 110 AND lat BETWEEN 20 AND 24) AND lon BETWEEN x0 - 3 AND x1 + 3 AND lat BETWEEN y0 - 3 AND y1 + 3))""")
def e06_bbox_intersect(t: Inputs):
    f = t.fx_cells.select("cell_id", C("x0").alias("west"), C("x1").alias("east"), C("y0").alias("south"), C("y1").alias("north"), (C("cell_id") % 8).alias("rank"))
    return geo.features_near(f, t.fx_visits, (100, 110, 20, 24)).select("cell_id")


@query("SELECT cell_id FROM fx_cells WHERE name IN (SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 5000)")
def e07_feature_in_use(t: Inputs):
    names = t.supplier.where("s_acctbal > 5000").join(t.nation, C("s_nationkey") == C("n_nationkey")).select(F.lit("nation").alias("level"), C("n_name").alias("name"))
    return geo.features_in_use(cells(t).withColumn("level", F.lit("nation")), names).select("cell_id")


@query(f"SELECT cell_id FROM fx_cells WHERE EXISTS (SELECT 1 FROM fx_visits WHERE {IN_CELL} AND eligibility = 'candidate')")
def e08_contains_any(t: Inputs):
    return geo.polygons_hit(cells(t), t.fx_visits.where("eligibility = 'candidate'"), "cell_id").select("cell_id")


@query(f"""
    SELECT v.province, v.visit_id, round(min({km('v.lon', 'v.lat', 'a.lon', 'a.lat')}), 3) AS km
    FROM fx_visits v JOIN fx_visits a ON a.province = v.province AND a.eligibility = 'anchor' WHERE v.eligibility = 'candidate' GROUP BY 1, 2""")
def e09_min_distance(t: Inputs):
    out = geo.min_distance(t.fx_visits.where("eligibility = 'candidate'"), t.fx_visits.where("eligibility = 'anchor'"), ["province"], "visit_id")
    return out.withColumn("km", F.round("km", 3))


BANDS = "SELECT request_id, (poi_id % 100) / 100 AS name_similarity, request_id % 9 > 0 AS has_source, CASE WHEN poi_id % 5 > 0 THEN (poi_id % 37) * 100.0 END AS distance_m FROM fx_candidates"


@query(f"""
    SELECT request_id, CASE WHEN has_source THEN best_m END AS best_m, CASE WHEN NOT has_source THEN 'unavailable' WHEN best_m IS NULL THEN 'no_name_supported_candidate' WHEN best_m < 500 THEN 'aligned_under_500m' WHEN best_m < 2000 THEN 'near_500m_to_2km' ELSE 'conflict_over_2km' END AS status
    FROM (SELECT request_id, has_source, min(distance_m::DOUBLE) FILTER (name_similarity >= 0.8) AS best_m FROM ({BANDS}) GROUP BY 1, 2)""")
def e10_distance_bands(t: Inputs):
    rows = t.fx_candidates.select("request_id", ((C("poi_id") % 100) / 100).alias("name_similarity"), (C("request_id") % 9 > 0).alias("has_source"), F.when(C("poi_id") % 5 > 0, (C("poi_id") % 37) * F.lit(100.0)).alias("distance_m"))
    return geo.distance_bands(rows, "request_id")


LEGS = f"(SELECT *, {km('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} AS km, (t - lag(t) OVER w) / 3.6e9 AS gap_hours FROM fx_visits WINDOW w AS (PARTITION BY place_id ORDER BY t, visit_id))"


@query(f"SELECT place_id, round(coalesce(sum(km), 0), 3) AS km, count(*) AS points FROM {LEGS} GROUP BY 1")
def e11_route_length(t: Inputs):
    return geo.route_length(t.fx_visits, "place_id", ["t", "visit_id"]).withColumn("km", F.round("km", 3))


@query(f"SELECT visit_id, round(km, 3) AS km, round(gap_hours, 4) AS gap_hours FROM {LEGS.replace('place_id', 'province')} WHERE km > 500")
def e12_long_legs(t: Inputs):
    out = geo.long_legs(t.fx_visits, "province", ["t", "visit_id"], "t")
    return out.select("visit_id", F.round("km", 3).alias("km"), F.round("gap_hours", 4).alias("gap_hours"))


@query("""
    SELECT city, round(x0, 9) AS x0, round(x1, 9) AS x1, round(y0, 9) AS y0, round(y1, 9) AS y1, round(greatest(x1 - x0, y1 - y0, 0.0005), 9) AS span FROM (
        SELECT city, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM (
            SELECT city, (lon + 180) / 360 AS x, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 AS y FROM fx_visits) GROUP BY city)""")
def e13_mercator_extent(t: Inputs):
    out = geo.mercator_extent(t.fx_visits, "city")
    return out.select("city", *[F.round(c, 9).alias(c) for c in ("x0", "x1", "y0", "y1", "span")])


@query("""
    SELECT province, name, lon, lat, n FROM (
        SELECT province, name, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, count(*) AS n, row_number() OVER (PARTITION BY province ORDER BY min(visit_id), name) AS r
        FROM (SELECT *, CASE WHEN visit_id % 3 = 0 THEN CAST(city AS STRING) ELSE kind END AS name FROM fx_visits) GROUP BY 1, 2) WHERE r <= 8""")
def e14_label_centroid(t: Inputs):
    rows = t.fx_visits.withColumn("town", F.when(C("visit_id") % 3 == 0, C("city").cast("string")).otherwise(""))
    out = geo.label_centroids(rows, "province", ["town", "kind"], "visit_id")
    return out.select("province", "name", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "n")

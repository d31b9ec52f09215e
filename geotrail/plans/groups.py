"""Queries of the families h (aggregations) and i (sequences)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollups, sequences
from .columns import km
from .records import ITEMS, label_items
from .registry import Inputs, query

C = F.col


@query(f"""
    WITH c AS (SELECT post_id, name, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources, min(confidence) AS min_confidence, max(confidence) AS max_confidence,
                      string_agg(DISTINCT CAST(pic_index AS STRING), ',' ORDER BY CAST(pic_index AS STRING)) AS media, count(*) AS occurrences, bool_or(contains(content, name)) AS in_text, min(pic_index * 100000 + pos) AS first
               FROM {ITEMS} GROUP BY 1, 2)
    SELECT post_id, name, sources, min_confidence, max_confidence, media, occurrences, in_text, row_number() OVER (PARTITION BY post_id ORDER BY first, name) - 1 AS candidate_index FROM c""")
def h01_candidate_rollup(t: Inputs):
    out = rollups.candidate_rollup(label_items(t))
    return out.select("post_id", "name", F.concat_ws(",", "sources").alias("sources"), "min_confidence", "max_confidence", F.concat_ws(",", C("media_indexes").cast("array<string>")).alias("media"), "occurrences", "in_text", C("candidate_index").cast("long"))


MENTIONS = "(SELECT p_type AS entity_id, p_name AS name, CASE WHEN l_linenumber % 2 = 0 THEN 'label' ELSE 'review' END AS method, l_orderkey AS post_id, l_discount AS confidence, CASE WHEN p_size < 20 THEN p_size % 2 + length(p_type) END AS place_id FROM lineitem JOIN part ON p_partkey = l_partkey)"


@query(f"""
    SELECT entity_id, string_agg(DISTINCT name, '|' ORDER BY name) AS aliases, string_agg(DISTINCT method, '|' ORDER BY method) AS methods, count(*) AS occurrences, count(DISTINCT post_id) AS posts, max(confidence) AS max_confidence,
           CASE count(DISTINCT place_id) WHEN 0 THEN 'unmatched' WHEN 1 THEN 'unique_high' ELSE 'multiple' END AS match_status FROM {MENTIONS} GROUP BY 1""")
def h02_entity_catalog(t: Inputs):
    m = t.lineitem.join(t.part, C("p_partkey") == C("l_partkey")).select(
        C("p_type").alias("entity_id"), C("p_name").alias("name"), F.when(C("l_linenumber") % 2 == 0, "label").otherwise("review").alias("method"), C("l_orderkey").alias("post_id"), C("l_discount").alias("confidence"),
        F.when(C("p_size") < 20, C("p_size") % 2 + F.length("p_type")).alias("place_id"),
    )
    out = rollups.entity_catalog(m)
    return out.select("entity_id", F.concat_ws("|", "aliases").alias("aliases"), F.concat_ws("|", "methods").alias("methods"), "occurrences", "posts", "max_confidence", "match_status")


@query("""
    WITH f AS (SELECT place_id, arg_min(lon, visit_id) AS lon, arg_min(lat, visit_id) AS lat, arg_min(kind, visit_id) AS kind FROM fx_visits GROUP BY 1),
         p AS (SELECT place_id, visit_id, (row_number() OVER (PARTITION BY place_id ORDER BY visit_id) - 1) // 20 AS page FROM fx_visits)
    SELECT place_id, lon, lat, kind, page, string_agg(CAST(visit_id AS STRING), ',' ORDER BY visit_id) AS posts FROM f JOIN p USING (place_id) GROUP BY ALL""")
def h03_place_catalog(t: Inputs):
    out = rollups.first_seen_catalog(t.fx_visits, ["place_id"], ["visit_id"], ["lon", "lat", "kind"], "visit_id", 20)
    return out.select("place_id", "lon", "lat", "kind", "page", F.concat_ws(",", C("source_posts").cast("array<string>")).alias("posts"))


@query("""
    WITH f AS (SELECT province, arg_min(CASE WHEN city % 2 = 0 THEN CAST(city AS STRING) WHEN kind <> 'view' THEN kind ELSE location_key END, visit_id) AS name FROM fx_visits GROUP BY 1),
         d AS (SELECT DISTINCT province, CASE WHEN place_id % 3 > 0 THEN CAST(place_id AS STRING) END AS post FROM fx_visits), p AS (SELECT province, post, (row_number() OVER (PARTITION BY province ORDER BY post) - 1) // 7 AS page FROM d WHERE post IS NOT NULL)
    SELECT f.province, name, coalesce(page, 0) AS page, coalesce(string_agg(post, ',' ORDER BY post), '') AS posts FROM f LEFT JOIN p USING (province) GROUP BY ALL""")
def h04_region_catalog(t: Inputs):
    rows = t.fx_visits.withColumn("a", F.when(C("city") % 2 == 0, C("city").cast("string")).otherwise(" ")).withColumn("b", F.when(C("kind") != "view", C("kind")))
    rows = rows.withColumn("name", rollups.region_name("a", "b", "location_key")).withColumn("post_id", F.when(C("place_id") % 3 > 0, C("place_id").cast("string")))
    out = rollups.first_seen_catalog(rows, ["province"], ["visit_id"], ["name"], size=7)
    return out.select("province", "name", "page", F.concat_ws(",", "source_posts").alias("posts"))


@query("SELECT v AS value, (SELECT count(*) FROM orders WHERE o_orderstatus = v) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS v)")
def h05_value_counts(t: Inputs):
    return rollups.value_counts(t.orders, "o_orderstatus", ["F", "O", "P", "X"])


@query("SELECT count(DISTINCT request_id) AS n FROM fx_candidates")
def h06_distinct_count(t: Inputs):
    return rollups.distinct_count(t.fx_candidates, "request_id")


@query("""SELECT user_id, province, n, rank FROM (SELECT user_id, province, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, province) AS rank
    FROM (SELECT user_id, event_id % 23 AS province FROM events) GROUP BY 1, 2) WHERE rank <= 8""")
def h07_topk_per_group(t: Inputs):
    out = rollups.top_per_group(t.events.select("user_id", (C("event_id") % 23).alias("province")), "user_id", "province")
    return out.withColumn("rank", C("rank").cast("long"))


@query("""
    SELECT place_id, string_agg(v, ',' ORDER BY first) AS tags FROM (
        SELECT place_id, v, min(visit_id * 2 + k) AS first FROM (SELECT place_id, visit_id, 0 AS k, kind AS v FROM fx_visits UNION ALL SELECT place_id, visit_id, 1, CAST(city AS STRING) FROM fx_visits) GROUP BY 1, 2) GROUP BY 1""")
def h08_ordered_distinct(t: Inputs):
    rows = t.fx_visits.withColumn("tags", F.array("kind", C("city").cast("string")))
    return rollups.ordered_distinct(rows, "place_id", ["visit_id"], "tags").select("place_id", F.concat_ws(",", "tags").alias("tags"))


@query("SELECT place_id, round(avg(confidence + visit_id / 1e9), 4) AS mean_confidence FROM fx_visits GROUP BY 1")
def h09_mean_confidence(t: Inputs):
    # moved off ties of rounding, which the order of a sum would decide
    return rollups.mean_confidence(t.fx_visits.withColumn("confidence", C("confidence") + C("visit_id") / 1e9), "place_id")


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(max(l_extendedprice), 6) AS max FROM lineitem GROUP BY 1")
def h10_exact_quantile(t: Inputs):
    out = rollups.quantiles(t.lineitem, "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("median", "p90", "max")])


@query("""SELECT count(*) AS total, sum(user_id) AS users, max(event_id) AS last, count(*) FILTER (event_type = 'click') AS n_click, round(avg((event_type = 'click')::INT), 4) AS rate_click,
    count(*) FILTER (value > 50) AS n_large, round(avg(coalesce(value > 50, false)::INT), 4) AS rate_large FROM events""")
def h11_run_summary(t: Inputs):
    return rollups.summary(t.events, {"users": F.sum("user_id"), "last": F.max("event_id")}, {"click": C("event_type") == "click", "large": C("value") > 50})


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'none') AS n_none FROM events GROUP BY 1")
def h12_pivot_counts(t: Inputs):
    return rollups.pivot_counts(t.events, "user_id", "event_type", ["click", "view", "none"])


@query(f"SELECT type, name, count(*) AS n FROM (SELECT coalesce(source, 'none') AS type, trim(name) AS name FROM {ITEMS} WHERE confidence >= 0.75) WHERE name <> '' GROUP BY 1, 2 ORDER BY n DESC, type, name LIMIT 240")
def h13_facets(t: Inputs):
    return rollups.facets(label_items(t).withColumn("type", F.coalesce("source", F.lit("none"))))


@query("""SELECT count(*) AS total, count(DISTINCT CASE WHEN city > 0 THEN city END) AS cities, (SELECT string_agg(y, ',' ORDER BY y) FROM (SELECT DISTINCT CAST(year(make_timestamp(t)) AS STRING) AS y FROM fx_visits)) AS years, min(t) AS first, max(t) AS last FROM fx_visits""")
def h14_dataset_manifest(t: Inputs):
    rows = t.fx_visits.withColumn("town", F.when(C("city") > 0, C("city").cast("string")).otherwise(""))
    return rollups.manifest(rows, "town", "t").withColumn("years", F.concat_ws(",", C("years").cast("array<string>")))


@query("""SELECT province, city, CASE WHEN grouping(city) = 1 THEN 'province' ELSE 'city' END AS level, count(DISTINCT place_id) AS trips, CASE WHEN province = 24 THEN 1 ELSE 0 END AS sort_key
    FROM fx_visits GROUP BY GROUPING SETS ((province, city), (province))""")
def h15_region_rollup(t: Inputs):
    return rollups.region_rollup(t.fx_visits, "province", "city", "place_id", 24)


@query("SELECT sum(CASE WHEN l_linenumber % 3 > 0 THEN l_quantity ELSE 0 END) AS prompt, round(sum(CASE WHEN l_linenumber % 3 > 0 AND l_suppkey % 2 = 0 THEN l_tax ELSE 0 END), 6) AS completion FROM lineitem")
def h16_usage_totals(t: Inputs):
    usage = F.when(C("l_linenumber") % 3 > 0, F.struct(C("l_quantity").alias("prompt"), F.when(C("l_suppkey") % 2 == 0, C("l_tax")).alias("completion")))
    out = rollups.usage_totals(t.lineitem.select(usage.alias("usage")), "usage", ["prompt", "completion"])
    return out.select("prompt", F.round("completion", 6).alias("completion"))


@query("SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def h17_size_distribution(t: Inputs):
    return rollups.size_distribution(t.lineitem, ["l_orderkey"])


@query("""SELECT 'status' AS distribution, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'type', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2""")
def h18_distribution_audit(t: Inputs):
    return rollups.distributions({"status": (t.orders, "o_orderstatus"), "type": (t.events, "event_type"), "lang": (t.documents, "lang")})


SESSION = """(SELECT *, sum(new) OVER (PARTITION BY location_key ORDER BY t, visit_id ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, CASE WHEN lag(t) OVER w IS NULL OR lag(eligibility) OVER w <> eligibility OR t - lag(t) OVER w > 12 * 3600000000 THEN 1 ELSE 0 END AS new FROM fx_visits WINDOW w AS (PARTITION BY location_key ORDER BY t, visit_id)))"""


@query(f"""
    SELECT location_key, session, min(t) AS start, max(t) AS "end", string_agg(CAST(visit_id AS STRING), ',' ORDER BY visit_id) AS visit_ids, max(confidence) AS confidence, min(eligibility) AS eligibility, count(*) > 1 AS merged
    FROM {SESSION} GROUP BY 1, 2""")
def i01_gap_merge(t: Inputs):
    out = sequences.gap_merge(t.fx_visits)
    return out.withColumn("visit_ids", F.concat_ws(",", C("visit_ids").cast("array<string>")))


#: Anchors with the person whose trips they are (half of the places are a person of their own), and names of their regions, some empty.
PERSONS = """SELECT visit_id, t, lon, lat, confidence + visit_id / 1e9 AS confidence, kind, CASE WHEN place_id % 2 = 0 THEN place_id ELSE place_id % 41 END AS person,
    concat('province_', province % 4) AS province, CASE WHEN visit_id % 50 = 0 THEN '' ELSE concat('city_', city % 3) END AS city,
    CASE WHEN visit_id % 100 = 0 THEN NULL ELSE concat('district_', city % 2) END AS district
    FROM {fx_visits} WHERE eligibility = 'anchor'"""
HOME, CENTRE = "province_3", (106.0, 24.0)
#: The fold as a recursion over each person's anchors: the running segment and the time of its first visit.
LATE = f"((v.at_home <> r.at_home AND {km('r.lon', 'r.lat', 'v.lon', 'v.lat')} > 300) OR v.t - r.t > 5 * 86400000000 OR v.t - r.first > 14 * 86400000000)"
SEGMENTS = f"""
    v AS MATERIALIZED (SELECT *, province LIKE '%{HOME}%' OR city LIKE '%{HOME}%' OR {km('lon', 'lat', *map(str, CENTRE))} <= 120 AS at_home, row_number() OVER (PARTITION BY person ORDER BY t, visit_id) AS n FROM ({PERSONS.format(fx_visits='fx_visits')})),
    r AS (SELECT *, 0 AS segment, t AS first FROM v WHERE n = 1
          UNION ALL SELECT v.*, r.segment + CASE WHEN {LATE} THEN 1 ELSE 0 END, CASE WHEN {LATE} THEN v.t ELSE r.first END
          FROM r JOIN v ON v.person = r.person AND v.n = r.n + 1)"""


def persons(t: Inputs):
    return t.spark.sql(PERSONS, fx_visits=t.fx_visits)


def home():
    return sequences.at_home(C("lon"), C("lat"), [C("province"), C("city")], HOME, CENTRE)


def segmented(t: Inputs):
    return sequences.boundary_split(persons(t), "person", home())


@query(f"WITH RECURSIVE {SEGMENTS} SELECT person, visit_id, segment FROM r")
def i02_boundary_split(t: Inputs):
    return segmented(t).select("person", "visit_id", "segment")


SEG = ["person", "segment"]


@query(f"WITH RECURSIVE {SEGMENTS} SELECT person, visit_id, segment FROM (SELECT *, count(*) OVER (PARTITION BY person, segment) AS c FROM r) WHERE c < 2")
def i03_drop_singletons(t: Inputs):
    return sequences.drop_singletons(segmented(t), SEG)[1].select("person", "visit_id", "segment")


KIND = f"""(SELECT person, segment, CASE WHEN bool_or(km > 300) THEN 'travel_route' WHEN bool_and(at_home) THEN 'local_sequence' WHEN count(DISTINCT place) <= 1 AND count(DISTINCT province) <= 1 THEN 'destination_stay' ELSE 'travel_route' END AS kind
    FROM (SELECT *, coalesce(nullif(city, ''), nullif(district, ''), nullif(province, '')) AS place, coalesce({km('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')}, 0) AS km FROM r WINDOW w AS (PARTITION BY person, segment ORDER BY t, visit_id)) GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {SEGMENTS} SELECT person, segment, kind FROM {KIND}")
def i04_trip_kind(t: Inputs):
    return sequences.trip_kind(segmented(t), SEG, home())


@query(f"WITH RECURSIVE {SEGMENTS} SELECT person, segment, string_agg(concat(sequence, ':', visit_id), ',' ORDER BY sequence) AS route FROM (SELECT *, row_number() OVER (PARTITION BY person, segment ORDER BY t, visit_id) - 1 AS sequence FROM r) GROUP BY 1, 2")
def i05_route_sequence(t: Inputs):
    lists = sequences.route_sequence(segmented(t), SEG).groupBy(*SEG).agg(F.array_sort(F.collect_list(F.struct("sequence", "visit_id"))).alias("l"))
    return lists.select(*SEG, F.concat_ws(",", F.transform("l", lambda x: F.concat_ws(":", x["sequence"], x["visit_id"]))).alias("route"))


def built(t: Inputs):
    return sequences.build_trips(segmented(t), SEG, home(), "kind")


BUILT = """(SELECT person, segment, min(t) AS start, max(t) AS "end", concat('trip_', substr(sha256(string_agg(CAST(visit_id AS STRING), chr(0) ORDER BY t, visit_id)), 1, 20)) AS trip_id, count(*) AS visits,
            string_agg(CAST(visit_id AS STRING), ',' ORDER BY t, visit_id) AS visit_ids, round(avg(confidence), 4) AS mean_confidence
    FROM r GROUP BY 1, 2 HAVING count(*) > 1)"""


@query(f"WITH RECURSIVE {SEGMENTS} SELECT trip_id, start, \"end\", visit_ids, mean_confidence, kind FROM {BUILT} JOIN {KIND} USING (person, segment)")
def i06_build_trips(t: Inputs):
    return built(t).select("trip_id", "start", "end", F.concat_ws(",", C("visit_ids").cast("array<string>")).alias("visit_ids"), "mean_confidence", "kind")


@query("""
    SELECT place_id, min(d) AS first, max(d) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY place_id ORDER BY d) AS run FROM (
        SELECT place_id, d, CASE WHEN lag(d) OVER (PARTITION BY place_id ORDER BY d) >= d - 2 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT place_id, CAST(floor(t / 86400000000) AS BIGINT) AS d FROM fx_visits)))
    GROUP BY place_id, run""")
def i07_year_islands(t: Inputs):
    days = t.fx_visits.select("place_id", F.floor(C("t") / sequences.DAY).alias("d"))
    return sequences.islands(days, ["place_id"], "d")


@query("""
    WITH d AS (SELECT visit_id, t, CASE WHEN count(*) OVER (PARTITION BY title) > 1 THEN concat(title, ' (', strftime(make_timestamp(t), '%Y-%m'), ')') ELSE title END AS x FROM (SELECT visit_id, t, concat(kind, ' ', place_id) AS title FROM fx_visits))
    SELECT visit_id, CASE WHEN row_number() OVER (PARTITION BY x ORDER BY t, visit_id) > 1 THEN concat(x, ' #', visit_id) ELSE x END AS final_title FROM d""")
def i08_unique_titles(t: Inputs):
    rows = t.fx_visits.select("visit_id", "t", F.concat_ws(" ", "kind", "place_id").alias("title"))
    return sequences.unique_titles(rows, "title", "visit_id", "t").select("visit_id", "final_title")


#: Spans of each order, one or two of a line: where they start and how long they are. Some are equal but for source and confidence.
SPANS = """(SELECT l_orderkey AS post_id, l_partkey % 20 AS start, l_partkey % 20 + 3 + l_suppkey % 4 AS "end", CASE l_linenumber % 3 WHEN 0 THEN 'dish' WHEN 1 THEN 'region' ELSE 'cuisine' END AS type, concat('t', l_partkey % 2) AS term, l_linenumber % 3 AS priority, l_discount AS confidence, l_linestatus AS source FROM lineitem
    UNION ALL SELECT l_orderkey, l_partkey % 20, l_partkey % 20 + 3 + l_suppkey % 4, CASE l_linenumber % 3 WHEN 0 THEN 'dish' WHEN 1 THEN 'region' ELSE 'cuisine' END, concat('t', l_partkey % 2), l_linenumber % 3, l_tax, l_returnflag FROM lineitem WHERE l_quantity > 40)"""


def all_spans(t: Inputs):
    kind = "CASE l_linenumber % 3 WHEN 0 THEN 'dish' WHEN 1 THEN 'region' ELSE 'cuisine' END AS type"
    columns = ["l_orderkey AS post_id", "l_partkey % 20 AS start", "l_partkey % 20 + 3 + l_suppkey % 4 AS end", kind, "concat('t', l_partkey % 2) AS term", "l_linenumber % 3 AS priority"]
    return t.lineitem.selectExpr(*columns, "l_discount AS confidence", "array(l_linestatus) AS sources").unionByName(t.lineitem.where("l_quantity > 40").selectExpr(*columns, "l_tax AS confidence", "array(l_returnflag) AS sources"))


@query(f"""
    WITH RECURSIVE m AS (SELECT post_id, start, "end", type, term, min(priority) AS priority, max(confidence) AS confidence, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM {SPANS} GROUP BY ALL),
    s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY start - "end", priority, -confidence, start, "end", type, term) AS n FROM m),
    g AS (SELECT post_id, 0::BIGINT AS n, []::STRUCT(a BIGINT, b BIGINT, n BIGINT)[] AS kept FROM (SELECT DISTINCT post_id FROM s)
          UNION ALL SELECT g.post_id, s.n, CASE WHEN len(list_filter(g.kept, lambda k: s.start < k.b AND k.a < s."end")) > 0 THEN g.kept ELSE list_append(g.kept, {{'a': s.start, 'b': s."end", 'n': s.n}}) END
          FROM g JOIN s ON s.post_id = g.post_id AND s.n = g.n + 1)
    SELECT s.post_id, s.start, s."end", type, term, confidence, sources, list_contains(list_transform(f.kept, lambda k: k.n), s.n) AS kept FROM s JOIN (SELECT post_id, arg_max(kept, n) AS kept FROM g GROUP BY 1) f USING (post_id)""")
def i09_greedy_overlap(t: Inputs):
    return sequences.resolve_overlaps(all_spans(t)).withColumn("sources", F.concat_ws(",", "sources")).drop("priority")


@query("""
    WITH m AS (SELECT doc_id, p * 20 + doc_id % 7 AS a, p * 20 + doc_id % 7 + 5 AS b FROM documents, (SELECT unnest([0, 1, 3, 4, 8, 20, 100]) AS p) WHERE lang <> 'en' AND p * 20 + doc_id % 7 + 5 <= n_chars),
         e AS (SELECT doc_id, text, n_chars, unnest(list_sort(list_distinct(list_concat([0, n_chars], coalesce(marks, []))))) AS start FROM documents LEFT JOIN (SELECT doc_id, list_concat(list(a), list(b)) AS marks FROM m GROUP BY 1) USING (doc_id)),
         c AS (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS stop FROM e)
    SELECT c.doc_id AS post_id, c.start, m.a IS NOT NULL AS marked, substr(text, c.start + 1, stop - c.start) AS segment FROM c LEFT JOIN m ON m.doc_id = c.doc_id AND m.a = c.start WHERE stop > c.start""")
def i10_highlight_segments(t: Inputs):
    d = t.documents.select(C("doc_id").alias("post_id"), C("text").alias("content"), "n_chars", "lang")
    marks = d.where("lang <> 'en'").select("post_id", "n_chars", F.explode(F.array(*map(F.lit, (0, 1, 3, 4, 8, 20, 100)))).alias("p"))
    marks = marks.select("post_id", "n_chars", F.expr("p * 20 + post_id % 7").alias("start")).withColumn("end", C("start") + 5).where("end <= n_chars").drop("n_chars")
    return sequences.highlight_segments(d, marks)


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 4")
def i11_first_n(t: Inputs):
    return sequences.first_n(t.conversations, ["conv_id"], ["turn"], 4).select("conv_id", "turn")


@query(f"""
    SELECT post_id, type, name, confidence FROM (SELECT post_id, coalesce(source, 'none') AS type, name, max(confidence) AS confidence, row_number() OVER (PARTITION BY post_id, coalesce(source, 'none') ORDER BY max(confidence) DESC, name) AS n
    FROM {ITEMS} GROUP BY 1, 2, 3) WHERE n <= 10""")
def i12_best_per_label(t: Inputs):
    return sequences.best_labels(label_items(t).withColumn("type", F.coalesce("source", F.lit("none"))))


@query(f"SELECT post_id, start, \"end\", previous_end FROM (SELECT *, lag(\"end\") OVER (PARTITION BY post_id ORDER BY start, \"end\") AS previous_end FROM (SELECT DISTINCT post_id, start, \"end\" FROM {SPANS})) WHERE start < previous_end")
def i13_prev_end_check(t: Inputs):
    return sequences.overlaps(all_spans(t).select("post_id", "start", "end").distinct()).select("post_id", "start", "end", "previous_end")

"""Queries of the families j (mentions), k (clusters) and l (samples and sets)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, mentions, sampling
from ..sources.io import written
from .columns import km
from .registry import Inputs, query

C = F.col

#: Terms of each document: its words of 9 letters and more.
WORDS = """(SELECT doc_id AS post_id, CASE pos % 3 WHEN 0 THEN 'dish' WHEN 1 THEN 'region' ELSE 'restaurant' END AS type, word AS term, CASE WHEN pos % 3 = 0 THEN 'label' ELSE 'review' END AS source, (pos % 100) / 100 AS confidence
    FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)) WHERE regexp_full_match(word, '[A-Za-z]{9,}'))"""
#: Generic terms of restaurants and discarded terms, in their normalized form and as written.
GENERIC, DISCARDED = ["torewhouon", "ththshtion", "ofiningat", "thbletion"], ["Thheouble", "enlichkeit", "AIEA UMENT"]
TERMS = f"(SELECT post_id, type, term, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, max(confidence) AS confidence FROM {WORDS} WHERE type <> 'restaurant' OR lower(term) NOT IN ({', '.join(f"'{x}'" for x in GENERIC)}) GROUP BY 1, 2, 3)"
#: Starts by search from the end of the hit before, as a recursion.
HITS = f"""
    t AS MATERIALIZED (SELECT DISTINCT post_id, term, content FROM {TERMS} JOIN fx_posts USING (post_id)),
    h AS (SELECT post_id, term, content, instr(content, term) - 1 AS start FROM t WHERE instr(content, term) > 0
          UNION ALL SELECT post_id, term, content, start + length(term) + instr(substr(content, start + length(term) + 1), term) - 1 FROM h WHERE instr(substr(content, start + length(term) + 1), term) > 0)"""


def posts(t: Inputs):
    return t.fx_posts.select("post_id", "content")


def term_sources(t: Inputs):
    words = t.documents.select(C("doc_id").alias("post_id"), F.posexplode(F.split("text", " ")).alias("pos", "term")).where(C("term").rlike("^[A-Za-z]{9,}$"))
    return words.select("post_id", F.when(C("pos") % 3 == 0, "dish").when(C("pos") % 3 == 1, "region").otherwise("restaurant").alias("type"), "term", F.when(C("pos") % 3 == 0, "label").otherwise("review").alias("source"), ((C("pos") % 100) / 100).alias("confidence"))


def terms(t: Inputs):
    return mentions.collect_terms(posts(t), term_sources(t), GENERIC)


@query(f"SELECT * FROM {TERMS}")
def j01_collect_terms(t: Inputs):
    return terms(t).withColumn("sources", F.concat_ws(",", "sources"))


@query(f"""SELECT c.* FROM {TERMS} c LEFT JOIN labels l ON l.doc_id = post_id AND quality = 1 WHERE l.doc_id IS NULL OR (lower(term) NOT IN ('thheouble', 'enlichkeit', 'aieaument') AND contains(sources, 'review'))""")
def j02_authoritative_terms(t: Inputs):
    reviews = t.fx_reviews.withColumn("discarded", F.array(*map(F.lit, DISCARDED)))
    return mentions.authoritative_terms(terms(t), reviews, ("review",)).withColumn("sources", F.concat_ws(",", "sources"))


@query(f"WITH RECURSIVE {HITS} SELECT post_id, term, start, start + length(term) AS \"end\" FROM h")
def j03_locate_terms(t: Inputs):
    out = mentions.locate_terms(posts(t), terms(t).select("post_id", "term").distinct())
    return out.select("post_id", "term", C("start").cast("long").alias("start"), C("end").cast("long").alias("end"))


GRAMS = "list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))"
#: A name as it is compared.
ALIKE = r"regexp_replace(regexp_replace(lower(regexp_replace({0}, '\s+', '', 'g')), '[（(][^（）()]{{0,20}}(店|馆|分店)?[）)]$', ''), '[^\p{{L}}\p{{N}}]', '', 'g')"
IS_RESTAURANT = "(starts_with(coalesce(typecode, ''), '05') OR regexp_matches(coalesce(type, ''), '(?i)餐饮|餐厅|饭店|小吃|咖啡|酒吧|restaurant') OR coalesce(extraction_kind = 'restaurant', false))"


def dice_sql(pairs: str) -> str:
    """Tables up to dice (a, b, dice) of the pairs of names of a table x (a, b)."""
    return f"""g AS (SELECT DISTINCT a, b FROM {pairs}), n AS (SELECT a, b, 'a' AS side, unnest({GRAMS.format('a')}) AS g FROM g UNION ALL SELECT a, b, 'b', unnest({GRAMS.format('b')}) FROM g),
         c AS (SELECT a, b, g, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM n GROUP BY ALL), s AS (SELECT a, b, 2 * sum(least(na, nb)) / sum(na + nb) AS plain FROM c GROUP BY 1, 2),
         dice AS (SELECT g.a, g.b, CASE WHEN g.a = '' OR g.b = '' THEN 0 WHEN g.a = g.b THEN 1
                  WHEN contains(g.a, g.b) OR contains(g.b, g.a) THEN greatest(CASE WHEN least(length(g.a), length(g.b)) >= 3 THEN 0.65 WHEN least(length(g.a), length(g.b)) = 2 THEN 0.5 ELSE 0 END, least(length(g.a), length(g.b)) / greatest(length(g.a), length(g.b)))
                  WHEN least(length(g.a), length(g.b)) = 1 THEN 0 ELSE plain END AS dice FROM g LEFT JOIN s USING (a, b))"""


#: Points of requests: names with brackets of several sorts and other signs, kinds of all sorts.
PLACES = """SELECT request_id AS post_id, poi_id, CASE poi_id % 4 WHEN 0 THEN concat(type_text, '（', region, '店）') WHEN 1 THEN concat(' ', upper(name), ' (No. ', source_rank, ')') WHEN 2 THEN concat(type_text, '-', '(a bracket that is far too long to be one)') ELSE concat(name, '!') END AS name,
    CASE poi_id % 5 WHEN 0 THEN '050100' WHEN 1 THEN '110000' END AS typecode, CASE poi_id % 7 WHEN 0 THEN 'Fine Restaurant' WHEN 1 THEN '咖啡店' WHEN 2 THEN 'shop' END AS type, CASE poi_id % 11 WHEN 0 THEN 'restaurant' WHEN 1 THEN 'market' END AS extraction_kind
    FROM {fx_candidates}"""


@query(f"""
    WITH m AS (SELECT DISTINCT request_id AS post_id, name AS term FROM fx_candidates WHERE source_rank = 1), p AS (SELECT post_id, poi_id, {ALIKE.format('name')} AS b FROM ({PLACES.format(fx_candidates='fx_candidates')}) WHERE {IS_RESTAURANT}),
         x AS (SELECT m.post_id, poi_id, term, {ALIKE.format('term')} AS a, b FROM m JOIN p USING (post_id)), {dice_sql('x')},
         k AS (SELECT post_id, term, count(DISTINCT poi_id) AS n FROM x JOIN dice USING (a, b) WHERE dice >= 0.15 GROUP BY 1, 2)
    SELECT post_id, term, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN 'unique_high' WHEN n > 1 THEN 'multiple' ELSE 'unmatched' END AS status FROM m LEFT JOIN k USING (post_id, term)""")
def j04_link_places(t: Inputs):
    m = t.fx_candidates.where("source_rank = 1").select(C("request_id").alias("post_id"), C("name").alias("term"))
    p = t.spark.sql(PLACES, fx_candidates=t.fx_candidates)
    return mentions.link_places(m, p, 0.15).select("post_id", "term", F.size("matches").cast("long").alias("n"), "status")


#: Points of each document: the first of its words, some under a longer name, half of them restaurants.
POINTS = """SELECT doc_id AS post_id, doc_id * 10 + i AS poi_id, concat(word, CASE WHEN i % 3 = 0 THEN ' Bar' WHEN i % 3 = 1 THEN ' (x)' ELSE '' END) AS name, CASE WHEN i % 2 = 0 THEN '0501' ELSE '1101' END AS typecode, CASE WHEN i = 5 THEN 'restaurant' END AS type, NULL AS extraction_kind"""


def points(t: Inputs):
    words = t.documents.select("doc_id", F.posexplode(F.filter(F.split("text", " "), lambda x: x.rlike("^[A-Za-z]{9,}$"))).alias("i", "word")).where("i < 6")
    return t.spark.sql(f"{POINTS} FROM {{words}}", words=words).withColumn("extraction_kind", C("extraction_kind").cast("string"))


def built_mentions(t: Inputs):
    return mentions.build_mentions(posts(t), term_sources(t), points(t), GENERIC)


@query(f"""
    WITH RECURSIVE {HITS},
    w AS (SELECT h.post_id, h.start, h.start + length(h.term) AS "end", c.type, c.term, c.sources, c.confidence, CASE c.type WHEN 'restaurant' THEN 0 WHEN 'dish' THEN 1 ELSE 3 END AS priority FROM h JOIN {TERMS} c ON c.post_id = h.post_id AND c.term = h.term),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY post_id ORDER BY start, "end", type, term ROWS UNBOUNDED PRECEDING) AS island FROM (
          SELECT *, CASE WHEN start >= max("end") OVER (PARTITION BY post_id ORDER BY start, "end", type, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM w)),
    o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY post_id, island ORDER BY start - "end", priority, -confidence, start, "end", type, term) AS n FROM i),
    q AS (SELECT post_id, island, 0::BIGINT AS n, []::STRUCT(a BIGINT, b BIGINT, n BIGINT)[] AS kept FROM (SELECT DISTINCT post_id, island FROM o)
          UNION ALL SELECT q.post_id, q.island, o.n, CASE WHEN len(list_filter(q.kept, lambda k: o.start < k.b AND k.a < o."end")) > 0 THEN q.kept ELSE list_append(q.kept, {{'a': o.start, 'b': o."end", 'n': o.n}}) END
          FROM q JOIN o ON o.post_id = q.post_id AND o.island = q.island AND o.n = q.n + 1),
    kept AS (SELECT o.* FROM o JOIN (SELECT post_id, island, arg_max(kept, n) AS kept FROM q GROUP BY 1, 2) f USING (post_id, island) WHERE list_contains(list_transform(f.kept, lambda k: k.n), o.n)),
    named AS (SELECT doc_id, unnest(v) AS word, generate_subscripts(v, 1) - 1 AS i FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: regexp_full_match(x, '[A-Za-z]{{9,}}'))[1:6] AS v FROM documents)),
    p AS (SELECT post_id, poi_id, {ALIKE.format('name')} AS b FROM ({POINTS} FROM named) WHERE {IS_RESTAURANT}),
    x AS (SELECT DISTINCT post_id, term, poi_id, {ALIKE.format('term')} AS a, b FROM kept JOIN p USING (post_id) WHERE kept.type = 'restaurant'), {dice_sql('x')},
    l AS (SELECT post_id, term, string_agg(DISTINCT CAST(poi_id AS STRING), ',' ORDER BY CAST(poi_id AS STRING)) AS place_ids, count(DISTINCT poi_id) AS places FROM x JOIN dice USING (a, b) WHERE dice >= 0.45 GROUP BY 1, 2),
    e AS (SELECT kept.*, concat('ent_', type, '_', substr(sha256(concat(type, chr(0), lower(kept.term))), 1, 16)) AS entity_id, CASE WHEN type = 'restaurant' THEN coalesce(places, 0) END AS places, CASE WHEN type = 'restaurant' THEN coalesce(place_ids, '') ELSE '' END AS place_ids
          FROM kept LEFT JOIN l ON l.post_id = kept.post_id AND l.term = kept.term)
    SELECT post_id, start, "end", type, term, sources, confidence, entity_id, concat('mention_', substr(sha256(concat(post_id, chr(0), start, chr(0), "end", chr(0), entity_id)), 1, 16)) AS mention_id,
           CASE WHEN places IS NULL THEN 'entity' WHEN places = 0 THEN 'unmatched' WHEN places = 1 THEN 'unique_high' ELSE 'multiple' END AS status, place_ids FROM e""")
def j05_build_mentions(t: Inputs):
    out = built_mentions(t).withColumn("sources", F.concat_ws(",", "sources")).withColumns({c: C(c).cast("long") for c in ("start", "end")})
    return out.withColumn("place_ids", F.concat_ws(",", F.array_sort(C("place_ids").cast("array<string>"))))


@query(f"""SELECT post_id, count(*) AS mentions, string_agg(DISTINCT term, ',' ORDER BY term) AS terms, count(*) FILTER (type = 'dish') AS n_dish, count(*) FILTER (type = 'region') AS n_region FROM {TERMS} GROUP BY 1""")
def j06_mention_index(t: Inputs):
    return mentions.mention_index(terms(t), ["dish", "region"]).withColumn("terms", F.concat_ws(",", "terms"))


def near_sql(days: float, kilometers: float, p: str = "") -> str:
    """Tables n of the anchors and e of the pairs within days and kilometers, joined by day and tested exactly."""
    return f"""{p}n AS MATERIALIZED (SELECT *, CAST(floor(t / ({days} * 86400000000)) AS BIGINT) AS day FROM fx_visits WHERE eligibility = 'anchor'),
    {p}w AS MATERIALIZED (SELECT *, unnest([day, day + 1]) AS d FROM {p}n),
    {p}e AS MATERIALIZED (SELECT least(a.visit_id, b.visit_id) AS l, greatest(a.visit_id, b.visit_id) AS r, abs(a.t - b.t) / 8.64e10 AS gap_days, {km('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS km
          FROM {p}w a JOIN {p}n b ON a.d = b.day AND (a.t < b.t OR a.t = b.t AND a.visit_id < b.visit_id) AND b.t - a.t <= {days} * 86400000000 AND abs(a.lat - b.lat) <= {kilometers} / 111.0
          WHERE {km('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= {kilometers})"""


NEAR = near_sql(1.5, 60)


def anchors(t: Inputs):
    return t.fx_visits.where("eligibility = 'anchor'")


@query(f"""
    WITH {NEAR}, s AS (SELECT *, CAST(floor(t / 43200000000) AS BIGINT) AS half FROM n WHERE kind = 'purchase'),
         f AS (SELECT least(a.visit_id, b.visit_id) AS l, greatest(a.visit_id, b.visit_id) AS r, abs(a.t - b.t) / 8.64e10 AS gap_days, {km('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS km FROM (SELECT *, unnest([half, half + 1]) AS d FROM s) a JOIN s b ON a.d = b.half
         WHERE (a.t < b.t OR a.t = b.t AND a.visit_id < b.visit_id) AND b.t - a.t <= 0.5 * 86400000000 AND {km('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 400)
    SELECT l AS "left", r AS "right", 'near' AS kind, round(km, 3) AS km FROM e UNION ALL SELECT l, r, 'travel_transition', round(km, 3) FROM f WHERE NOT (gap_days <= 1.5 AND km <= 60)""")
def k01_neighbor_rule(t: Inputs):
    out = cluster.neighbor_rule(anchors(t).withColumn("ok", C("kind") == "purchase"), (1.5, 60), (0.5, 400), "ok", {"km": 3})
    return out.select("left", "right", "kind", "km")


def labels_sql(days: float, kilometers: float, least: int, p: str = "") -> str:
    """Table labels_ of the clusters: components of cores, found by following the links from every core."""
    return f"""{near_sql(days, kilometers, p)},
    {p}b AS MATERIALIZED (SELECT l AS a, r AS b FROM {p}e UNION ALL SELECT r, l FROM {p}e), {p}core AS MATERIALIZED (SELECT a AS v FROM {p}b GROUP BY 1 HAVING count(*) >= {least - 1}),
    {p}o AS MATERIALIZED (SELECT visit_id, row_number() OVER (ORDER BY t, visit_id) AS o FROM {p}n),
    {p}links AS MATERIALIZED (SELECT x.o AS a, y.o AS b FROM {p}b JOIN {p}o x ON x.visit_id = {p}b.a JOIN {p}o y ON y.visit_id = {p}b.b WHERE {p}b.a IN (SELECT v FROM {p}core) AND {p}b.b IN (SELECT v FROM {p}core)),
    {p}reach(v, w) USING KEY (v) AS (SELECT o, o FROM {p}o WHERE visit_id IN (SELECT v FROM {p}core)
        UNION SELECT l.a, min(r.w) FROM {p}reach r JOIN {p}links l ON l.b = r.v JOIN recurring.{p}reach c ON c.v = l.a WHERE r.w < c.w GROUP BY 1),
    {p}lab AS (SELECT visit_id AS v, w AS label FROM {p}reach JOIN {p}o ON {p}o.o = {p}reach.v),
    {p}num AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS cluster FROM (SELECT DISTINCT label FROM {p}lab)),
    {p}c AS (SELECT v AS visit_id, cluster, 'core' AS role FROM {p}lab JOIN {p}num USING (label)),
    {p}x AS (SELECT a AS visit_id, min(cluster) AS cluster, 'border' AS role FROM {p}b JOIN {p}c ON {p}c.visit_id = {p}b.b WHERE a NOT IN (SELECT v FROM {p}core) GROUP BY 1),
    {p}labels_ AS (SELECT {p}n.visit_id, u.cluster, coalesce(u.role, 'noise') AS role FROM {p}n LEFT JOIN (SELECT * FROM {p}c UNION ALL SELECT * FROM {p}x) u USING (visit_id))"""


LABELS = labels_sql(1.5, 60, 3)


@query(f"WITH RECURSIVE {LABELS} SELECT * FROM labels_")
def k02_st_dbscan(t: Inputs):
    return clustered(t).withColumn("cluster", C("cluster").cast("long"))


def clustered(t: Inputs):
    return cluster.st_dbscan_near(anchors(t), 1.5, 60, 3)


@query(f"""
    WITH RECURSIVE {LABELS}, m AS (SELECT * FROM labels_ JOIN n USING (visit_id) WHERE cluster IS NOT NULL)
    SELECT cluster, visits, start, "end", cities, edges, round(longest, 3) AS longest_km FROM (SELECT cluster, count(*) AS visits, min(t) AS start, max(t) AS "end", count(DISTINCT city) AS cities FROM m GROUP BY 1)
    JOIN (SELECT p.cluster, count(*) AS edges, max(e.km) AS longest FROM e JOIN m p ON p.visit_id = e.l JOIN m q ON q.visit_id = e.r AND p.cluster = q.cluster GROUP BY 1) USING (cluster)""")
def k03_cluster_record(t: Inputs):
    labels = written(clustered(t).select("visit_id", "cluster")).join(t.fx_visits, "visit_id")
    out = cluster.cluster_records_near(labels, 1.5, 60)
    return out.select(C("cluster").cast("long").alias("cluster"), "visits", "start", "end", F.size("cities").cast("long").alias("cities"), "edges", F.round("longest_km", 3).alias("longest_km"))


def swept(name: str, labels: str) -> str:
    s = f"(SELECT cluster, count(*) AS size FROM {labels} WHERE cluster IS NOT NULL GROUP BY 1)"
    return f"""SELECT '{name}' AS config, (SELECT count(*) FROM {labels}) AS visits, (SELECT count(cluster) FROM {labels}) AS members, (SELECT count(*) FROM {labels} WHERE role = 'noise') AS noise,
           count(*) AS clusters, quantile_cont(size::DOUBLE, 0.5) AS median_size, max(size) AS largest FROM {s}"""


@query(f"WITH RECURSIVE {labels_sql(1.5, 60, 3, 'narrow_')}, {labels_sql(1, 40, 2, 'pairs_')} {swept('narrow', 'narrow_labels_')} UNION ALL {swept('pairs', 'pairs_labels_')}")
def k04_parameter_sweep(t: Inputs):
    configs = {"narrow": {"near": (1.5, 60), "min_samples": 3}, "pairs": {"near": (1, 40), "min_samples": 2}}
    return cluster.sweep(anchors(t), configs)


@query("SELECT visit_id FROM fx_visits WHERE eligibility = 'anchor' AND place_id NOT IN (SELECT place_id FROM fx_visits WHERE eligibility = 'anchor' GROUP BY 1 HAVING count(*) > 60)")
def k05_noise(t: Inputs):
    full = anchors(t).groupBy("place_id").agg(F.count("*").alias("n")).where("n > 60")
    return cluster.noise(anchors(t), anchors(t).join(full, "place_id", "left_semi")).select("visit_id")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat('s1:', doc_id)), doc_id) AS n FROM documents) WHERE n <= 20")
def l01_stratified_hash_sample(t: Inputs):
    return sampling.stratified_sample(t.documents, ["lang"], 20, "s1", "doc_id").select("doc_id", "lang")


@query("""
    WITH r AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 END AS g, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat('s2:', doc_id)), doc_id) - 1 AS r FROM documents WHERE lang <> 'es')
    SELECT doc_id, lang, row_number() OVER (ORDER BY r, ((g - r) % 3 + 3) % 3) AS turn FROM r ORDER BY turn LIMIT 40""")
def l02_round_robin_sample(t: Inputs):
    out = sampling.round_robin(t.documents, "lang", ["en", "fr", "de"], 40, "s2", "doc_id", rotate=True)
    return out.select("doc_id", "lang", C("turn").cast("long"))


@query("SELECT o_orderkey, o_orderdate::DATE::STRING AS day FROM orders ORDER BY o_orderkey LIMIT 25")
def l03_limit(t: Inputs):
    return sampling.limit(t.orders.select("o_orderkey", C("o_orderdate").cast("date").cast("string").alias("day")), ["o_orderkey"], 25)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 4")
def l04_topk_global(t: Inputs):
    return sampling.top_k(t.events.groupBy("user_id").agg(F.count("*").alias("n")), C("n"), "user_id", 4)


@query("SELECT visit_id, t, confidence FROM fx_visits ORDER BY confidence DESC, t, visit_id")
def l05_multi_key_sort(t: Inputs):
    return sampling.multi_sort(t.fx_visits.select("visit_id", "t", "confidence"), C("confidence").desc(), "t", "visit_id")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def l06_first_distinct(t: Inputs):
    return sampling.first_distinct(t.events.select("user_id", "event_id"), ["user_id"], ["event_id"])


@query("SELECT o_orderkey AS src, o_custkey AS dst, o_totalprice AS weight, NULL::INTEGER AS line FROM orders UNION ALL SELECT l_orderkey, l_partkey, NULL, l_linenumber FROM lineitem")
def l07_union_edges(t: Inputs):
    a = t.orders.select(C("o_orderkey").alias("src"), C("o_custkey").alias("dst"), C("o_totalprice").alias("weight"))
    return sampling.union_edges(a, t.lineitem.select(C("l_orderkey").alias("src"), C("l_partkey").alias("dst"), C("l_linenumber").alias("line")))


@query("SELECT l_orderkey, coalesce(string_agg(DISTINCT CAST(l_linenumber AS STRING), ',' ORDER BY CAST(l_linenumber AS STRING)) FILTER (l_linenumber IN (1, 3, 5)), '') AS kept, coalesce(string_agg(DISTINCT CAST(l_linenumber AS STRING), ',' ORDER BY CAST(l_linenumber AS STRING)) FILTER (l_linenumber NOT IN (1, 3, 5)), '') AS dropped FROM lineitem GROUP BY 1")
def l08_intersect_except(t: Inputs):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("ids")).withColumn("allowed", F.array(F.lit(1), F.lit(3), F.lit(5)))
    out = sampling.partition_allowed(rows, "ids", "allowed")
    return out.select("l_orderkey", *[F.concat_ws(",", C(c).cast("array<string>")).alias(c) for c in ("kept", "dropped")])


@query("SELECT DISTINCT trim(p_type) AS value FROM part WHERE trim(p_type) <> '' AND p_size > 10")
def l09_distinct_keys(t: Inputs):
    return sampling.distinct_values(t.part.where("p_size > 10"), C("p_type"))


@query("SELECT doc_id, sha256(concat('s3:', doc_id)) AS draw FROM documents")
def l10_shuffle_seeded(t: Inputs):
    return sampling.shuffled(t.documents.select("doc_id"), "s3", "doc_id")

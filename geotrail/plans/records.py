"""Queries of the families a (sources and sinks), b (profiling) and c (repair)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile, repair
from ..sources import io
from .registry import Inputs, query


def scratch(t: Inputs) -> str:
    """A new path in the cluster's shared folder."""
    return io.shared_folder(t.spark)


BROKEN = "(line_no % 97 = 0 OR line_no % 89 = 0)"


@query("SELECT event_id AS id, event_type AS kind FROM events")
def a01_jsonl_scan(t: Inputs):
    path = scratch(t)
    t.events.select(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("value")).write.text(path)
    return io.read_jsonl(t.spark, path, "id bigint, kind string")


@query("""
    SELECT line_no, CASE WHEN line_no % 97 = 0 THEN 'malformed' ELSE 'not_object' END AS error, substr(line, 1, 240) AS raw_excerpt
    FROM fx_raw WHERE trim(line) <> '' AND (NOT json_valid(line) OR json_type(line) <> 'OBJECT')""")
def a02_scan_quarantine(t: Inputs):
    return io.scan_with_quarantine(t.fx_raw)[1]


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def a03_json_dir_scan(t: Inputs):
    path = scratch(t)
    lists = t.nation.groupBy((F.col("n_nationkey") % 4).alias("part")).agg(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("rows"))
    lists.select("part", F.to_json("rows").alias("value")).write.partitionBy("part").text(path)  # one document per file
    return io.read_json_dir(t.spark, path, "id bigint, name string").select("id", "name")


@query("SELECT o_orderkey AS request_id, CAST(NULL AS STRING) AS note FROM orders WHERE o_orderstatus = 'P'")
def a04_optional_source(t: Inputs):
    from pyspark.sql.types import StructType

    notes = io.read_optional(t.spark, scratch(t), StructType().add("request_id", "long").add("note", "string"))
    return t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("request_id")).join(notes, "request_id", "left")


@query("SELECT name, code, 'nation' AS level, 'Polygon' AS geometry_type FROM fx_cells")
def a05_geojson_scan(t: Inputs):
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    feature = F.struct(F.struct("name", "code").alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    paths = []
    for rest in (0, 1):  # two collections of cells, as files of their own
        paths.append(scratch(t))
        part = t.fx_cells.where(F.col("cell_id") % 2 == rest).agg(F.collect_list(feature).alias("features"))
        part.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).coalesce(1).write.text(paths[-1])
    return io.read_features(t.spark, paths, "nation").select("name", "code", "level", F.col("geometry.type").alias("geometry_type"))


@query("SELECT event_id, CASE WHEN event_id % 5 > 0 THEN CAST(event_id AS STRING) WHEN user_id % 2 = 0 THEN concat('m', user_id) ELSE concat('line:', event_id) END AS record_key FROM events")
def a06_record_key(t: Inputs):
    ids = t.events.withColumn("id", F.when(F.col("event_id") % 5 > 0, F.col("event_id"))).withColumn("mid", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("m"), "user_id")))
    return ids.select("event_id", io.record_key("id", "mid", number="event_id").alias("record_key"))


@query("SELECT s_suppkey, s_name FROM supplier")
def a07_write_once(t: Inputs):
    return io.write_once(t.supplier.select("s_suppkey", "s_name"), scratch(t))


@query("SELECT p_partkey, p_name, p_brand FROM part")
def a08_keyed_results(t: Inputs):
    return io.write_keyed(t.part.select("p_partkey", "p_name", "p_brand"), "p_partkey", scratch(t))


@query("""
    WITH r AS (SELECT sha256(concat_ws(chr(31), coalesce(p_brand, chr(0)), coalesce(p_name, chr(0)), coalesce(CAST(p_partkey AS STRING), chr(0)))) AS h FROM part)
    SELECT count(*) AS rows, concat_ws('-', CAST(sum(CAST(concat('0x', substr(h, 1, 8)) AS BIGINT)) AS STRING), CAST(sum(CAST(concat('0x', substr(h, 9, 8)) AS BIGINT)) AS STRING),
           CAST(sum(CAST(concat('0x', substr(h, 17, 8)) AS BIGINT)) AS STRING), CAST(sum(CAST(concat('0x', substr(h, 25, 8)) AS BIGINT)) AS STRING)) AS digest
    FROM r""")
def a09_table_fingerprint(t: Inputs):
    return io.fingerprint(t.part.select("p_partkey", "p_name", "p_brand"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def a10_pick_keys(t: Inputs):
    keys = t.lineitem.where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return io.pick_keys(t.orders, keys, "o_orderkey")[0].select("o_orderkey", "o_orderstatus")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a11_pending_rows(t: Inputs):
    return io.pending(t.documents, t.labels, "doc_id").select("doc_id")


@query("""
    SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'result'
                WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'error' ELSE 'pending' END AS outcome, count(*) AS n
    FROM documents GROUP BY 1""")
def a12_collect_outcomes(t: Inputs):
    out = io.collect_outcomes(t.documents.select("doc_id"), t.labels.where("quality = 1"), t.labels.where("toxic = 1"), "doc_id")
    return out.groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, concat('{"c_name":"', c_name, '","c_mktsegment":"', c_mktsegment, '"}') AS document FROM customer""")
def a13_public_json(t: Inputs):
    return io.publish(t.customer, "c_custkey", ["c_name", "c_mktsegment"])


@query(f"""
    WITH o AS (SELECT line_no, CASE WHEN json_valid(line) AND json_type(line) = 'OBJECT' THEN line END AS j FROM fx_raw WHERE NOT {BROKEN} AND line <> ''),
         s AS (SELECT 'type' AS field, CASE WHEN NOT json_exists(j, '$.type') THEN 'missing' WHEN json_type(j, '$.type') = 'NULL' THEN 'null'
                      WHEN json_type(j, '$.type') <> 'VARCHAR' THEN 'wrong_type' WHEN trim(json_extract_string(j, '$.type')) = '' THEN 'empty' ELSE 'nonempty' END AS state FROM o
               UNION ALL SELECT 'id', CASE WHEN json_exists(j, '$.id') THEN 'nonempty' ELSE 'missing' END FROM o
               UNION ALL SELECT 'props', CASE WHEN json_exists(j, '$.props') THEN 'nonempty' ELSE 'missing' END FROM o)
    SELECT field, count(*) AS total, count(*) FILTER (state <> 'missing') AS present, count(*) FILTER (state = 'missing') AS n_missing,
           count(*) FILTER (state = 'null') AS n_null, count(*) FILTER (state = 'empty') AS n_empty, count(*) FILTER (state = 'nonempty') AS n_nonempty,
           count(*) FILTER (state = 'wrong_type') AS n_wrong_type
    FROM s GROUP BY field""")
def b01_field_coverage(t: Inputs):
    good = io.scan_with_quarantine(t.fx_raw)[0]
    return profile.field_coverage(good, {"type": "STRING", "id": "NUMBER", "props": "OBJECT"})


@query("""
    SELECT l_orderkey, l_partkey, line, first_line FROM (
        SELECT l_orderkey, l_partkey, line, row_number() OVER w AS n, first(line) OVER w AS first_line
        FROM (SELECT l_orderkey, l_partkey, l_suppkey * 1000 + l_linenumber AS line FROM lineitem)
        WINDOW w AS (PARTITION BY l_orderkey, l_partkey ORDER BY line)) WHERE n > 1""")
def b02_duplicate_keys(t: Inputs):
    rows = t.lineitem.select("l_orderkey", "l_partkey", F.expr("l_suppkey * 1000 + l_linenumber").alias("line"))
    return profile.duplicates(rows, ["l_orderkey", "l_partkey"], "line")


@query("""
    SELECT 'lang' AS "column", coalesce(lang, '<missing>') AS value, count(*) AS n FROM documents GROUP BY ALL
    UNION ALL SELECT 'source', CASE WHEN doc_id % 10 > 0 THEN source ELSE '<missing>' END AS v, count(*) FROM documents GROUP BY v""")
def b03_value_histogram(t: Inputs):
    docs = t.documents.withColumn("source", F.when(F.col("doc_id") % 10 > 0, F.col("source")))
    return profile.histogram(docs, ["lang", "source"])


@query("""
    SELECT count(*) FILTER (value > 50) AS large, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (user_id % 2 = 0) AS even,
           count(*) FILTER (value IS NULL) AS no_value, count(*) FILTER (event_type IN ('click', 'view') AND value > 10) AS active
    FROM events""")
def b04_counter_suite(t: Inputs):
    c = F.col
    return profile.counters(t.events, {"large": c("value") > 50, "errors": c("event_type") == "error", "even": c("user_id") % 2 == 0, "no_value": c("value").isNull(), "active": c("event_type").isin("click", "view") & (c("value") > 10)})


@query("SELECT doc_id, len(string_split(text, ' ')) AS len_a, len(string_split(text, '.')) AS len_b FROM documents WHERE len(string_split(text, ' ')) <> len(string_split(text, '.'))")
def b05_array_len_mismatch(t: Inputs):
    rows = t.documents.select("doc_id", F.split("text", " ").alias("words"), F.split("text", "\\.").alias("sentences"))
    return profile.len_mismatch(rows, "words", "sentences").select("doc_id", F.col("len_a").cast("long"), F.col("len_b").cast("long"))


#: Labels of each medium: its words of five letters and more; some are not written as in the text.
ITEMS = """(SELECT post_id, pic_index, pos, CASE WHEN pos % 11 = 0 THEN concat(name, '~') ELSE name END AS name, ((pic_index * 13 + length(name)) % 120 - 5) / 100 AS confidence,
                  CASE pos % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'image' WHEN 2 THEN 'other' END AS source, content
           FROM (SELECT post_id, pic_index, unnest(w) AS name, generate_subscripts(w, 1) - 1 AS pos, description AS content
                 FROM (SELECT *, string_split(description, ' ') AS w FROM fx_media)) WHERE length(name) >= 5)"""


def label_items(t: Inputs):
    words = t.fx_media.select("post_id", "pic_index", F.col("description").alias("content"), F.posexplode(F.split("description", " ")).alias("pos", "name")).where("length(name) >= 5")
    source = F.when(F.expr("pos % 4 = 0"), "text").when(F.expr("pos % 4 = 1"), "image").when(F.expr("pos % 4 = 2"), "other")
    name = F.when(F.expr("pos % 11 = 0"), F.concat("name", F.lit("~"))).otherwise(F.col("name"))
    return words.select("post_id", "pic_index", "pos", name.alias("name"), F.expr("((pic_index * 13 + length(name)) % 120 - 5) / 100").alias("confidence"), source.alias("source"), "content")


@query(f"""
    SELECT issue, count(*) AS n FROM (
        SELECT unnest(list_filter([CASE WHEN trim(name) = '' THEN 'empty_name' END, CASE WHEN confidence < 0 OR confidence > 1 THEN 'invalid_confidence' END,
               CASE WHEN source IS NULL THEN 'missing_source' WHEN source NOT IN ('text', 'image') THEN 'invalid_source' END,
               CASE WHEN source = 'text' AND NOT contains(content, name) THEN 'not_in_text' END], lambda x: x IS NOT NULL)) AS issue FROM {ITEMS}) GROUP BY issue""")
def b06_candidate_quality(t: Inputs):
    found = profile.candidate_issues(label_items(t), ["text", "image"])
    return found.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def b07_enum_violations(t: Inputs):
    return profile.enum_violations(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("SELECT line_no, line FROM fx_raw WHERE line_no % 97 = 0 OR line_no % 89 = 0 ORDER BY line_no LIMIT 50")
def b08_bounded_sample(t: Inputs):
    return profile.issue_sample(t.fx_raw.where(BROKEN), ["line_no"], 50)


MEDIA_CLASS = """(SELECT post_id, bool_or(image_type = 'system') AS has_system, bool_or(length(description) > 400) AS has_long, bool_or(contains(description, 'the')) AS has_text FROM fx_media GROUP BY post_id)"""


@query(f"""
    SELECT post_id, CASE WHEN has_system AND has_long THEN 'A' WHEN has_long AND has_text THEN 'B' WHEN has_text THEN 'C' WHEN post_id % 3 = 0 THEN 'D' ELSE 'Q' END AS record_class
    FROM (SELECT doc_id AS post_id, coalesce(has_system, false) AS has_system, coalesce(has_long, false) AS has_long, coalesce(has_text, false) AS has_text
          FROM documents LEFT JOIN {MEDIA_CLASS} m ON m.post_id = doc_id)""")
def b09_record_class(t: Inputs):
    c = F.col
    evidence = {"has_system": c("image_type") == "system", "has_long": F.length("description") > 400, "has_text": F.contains(c("description"), F.lit("the"))}
    classes = {"A": c("has_system") & c("has_long"), "B": c("has_long") & c("has_text"), "C": c("has_text"), "D": c("post_id") % 3 == 0}
    posts = t.documents.select(c("doc_id").alias("post_id"))
    return profile.classify_posts(posts, t.fx_media, "post_id", evidence, classes).select("post_id", "record_class")


@query("SELECT p_brand, n_names, list_aggregate(names[1:20], 'string_agg', '|') AS names FROM (SELECT p_brand, count(DISTINCT p_name) AS n_names, list_sort(list(DISTINCT p_name)) AS names FROM part GROUP BY p_brand) WHERE n_names > 1")
def b10_multi_distinct(t: Inputs):
    return profile.multi_distinct(t.part, ["p_brand"], "p_name").select("p_brand", F.col("n_names").cast("long"), F.concat_ws("|", "names").alias("names"))


@query("""
    SELECT unnest(['parse_clean', 'no_duplicates', 'all_linked']) AS gate,
           unnest([(SELECT count(*) FROM fx_raw WHERE line_no % 97 = 0) = 0, (SELECT count(*) = count(DISTINCT line_no) FROM fx_raw), (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) = 0]) AS passed""")
def b11_quality_gates(t: Inputs):
    lines = t.fx_raw.agg(F.count_if(F.expr("line_no % 97 = 0")).alias("broken"), (F.count("*") - F.count_distinct("line_no")).alias("repeated"))
    loose = t.labels.join(t.documents, "doc_id", "left_anti").agg(F.count("*").alias("loose"))
    metrics = lines.withColumn("run", F.lit(1)).join(loose.withColumn("run", F.lit(1)), "run")  # one row each
    return profile.gates(metrics, {"parse_clean": F.col("broken") == 0, "no_duplicates": F.col("repeated") == 0, "all_linked": F.col("loose") == 0})


@query("""
    WITH m AS (SELECT post_id, image_type = 'user' AS from_user, length(description) > 200 AS long_text FROM fx_media),
         p AS (SELECT post_id, bool_or(from_user) AS from_user, bool_or(long_text) AS long_text FROM m GROUP BY post_id)
    SELECT 'media' AS grain, count(*) AS total, count(*) FILTER (from_user) AS from_user, count(*) FILTER (long_text) AS long_text FROM m
    UNION ALL SELECT 'post', count(*), count(*) FILTER (from_user), count(*) FILTER (long_text) FROM p""")
def b12_coverage_by_grain(t: Inputs):
    return profile.coverage_by_grain(t.fx_media, "post_id", {"from_user": F.col("image_type") == "user", "long_text": F.length("description") > 200})


GEO = "CASE visit_id % 6 WHEN 0 THEN lat WHEN 1 THEN lon WHEN 2 THEN 200.0 WHEN 3 THEN lon ELSE lon END"
GEO2 = "CASE visit_id % 6 WHEN 0 THEN lon WHEN 1 THEN lon WHEN 2 THEN 100.0 WHEN 3 THEN NULL WHEN 4 THEN lat - 40 ELSE lat END"


@query(f"""
    WITH g AS (SELECT visit_id, {GEO} AS a, {GEO2} AS b FROM fx_visits),
         o AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL OR a = b THEN NULL WHEN abs(a) <= 90 AND abs(b) <= 180 THEN 'lat_lng' WHEN abs(a) <= 180 AND abs(b) <= 90 THEN 'lng_lat' END AS source_order FROM g),
         x AS (SELECT *, CASE source_order WHEN 'lng_lat' THEN a WHEN 'lat_lng' THEN b END AS lng, CASE source_order WHEN 'lng_lat' THEN b WHEN 'lat_lng' THEN a END AS lat FROM o)
    SELECT visit_id, source_order IS NOT NULL AS usable, source_order, lng, lat, lng BETWEEN 73 AND 136 AND lat BETWEEN 3 AND 54 AS in_bounds,
           CASE WHEN a IS NULL OR b IS NULL THEN 'missing_or_unrecognized_geo' WHEN a = b THEN 'equal_coordinate_placeholder' WHEN source_order IS NULL THEN 'coordinate_out_of_global_range'
                WHEN source_order = 'lng_lat' THEN 'unexpected_source_coordinate_order' ELSE '' END AS flags
    FROM x""")
def c01_normalize_geo(t: Inputs):
    geo = t.fx_visits.select("visit_id", F.expr(GEO).cast("double").alias("a"), F.expr(GEO2).cast("double").alias("b"))
    out = geo.select("visit_id", repair.normalize_geo(F.col("a"), F.col("b")).alias("g")).select("visit_id", "g.*")
    return out.withColumn("flags", F.concat_ws(",", "flags"))


COORDS = """CASE visit_id % 5 WHEN 0 THEN concat(visit_id % 90, '.5,', visit_id % 45, '.25') WHEN 1 THEN concat('{{"location":"', visit_id % 90, '.5，', visit_id % 45, '.25"}}')
            WHEN 2 THEN concat('{{"coordinates":[', visit_id % 90, '.5,', visit_id % 45, '.25]}}') WHEN 3 THEN concat('{{"geo":{{"center":"', visit_id % 90, '.5,', visit_id % 45, '.25"}}}}') ELSE 'nowhere' END""".replace("{{", "{").replace("}}", "}")


@query("SELECT visit_id, CASE WHEN visit_id % 5 < 4 THEN visit_id % 90 + 0.5::DOUBLE END AS x, CASE WHEN visit_id % 5 < 4 THEN visit_id % 45 + 0.25::DOUBLE END AS y FROM fx_visits")
def c02_find_coordinates(t: Inputs):
    found = t.fx_visits.select("visit_id", repair.find_coordinates(F.expr(COORDS)).alias("c"))
    return found.select("visit_id", F.get("c", 0).alias("x"), F.get("c", 1).alias("y"))


def _answer(t: Inputs):
    """Answers as a model writes them: plain, fenced, with a trailing comma, or cut off."""
    body = F.concat(F.lit('{"id":'), "event_id", F.lit(',"kind":"'), "event_type", F.lit('"'))
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, F.concat(body, F.lit("}"))).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("}\n```"))).when(kind == 2, F.concat(body, F.lit(",}"))).when(kind == 3, body).otherwise(F.concat(F.lit('{"id":'), "event_id", F.lit("}")))
    return t.events.select("event_id", text.alias("answer"))


@query("""SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN concat('{"id":', event_id, ',"kind":"', event_type, '"}') END AS recovered FROM events""")
def c03_json_recover(t: Inputs):
    return repair.recover_objects(_answer(t), "answer", ["id", "kind"]).select("event_id", "recovered")


@query("SELECT line_no, line_no % 97 <> 0 AND line_no % 89 <> 0 AND line <> '' AND line_no % 7 <> 0 AS complete FROM fx_raw")
def c04_required_fields(t: Inputs):
    return t.fx_raw.select("line_no", repair.required_fields(F.col("line"), ["id", "type", "props"]).alias("complete"))


@query("SELECT event_type AS from_value, CASE event_type WHEN 'click' THEN 'view' WHEN 'error' THEN 'fault' END AS to_value, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY 1, 2")
def c05_enum_map(t: Inputs):
    return repair.map_enum(t.events, "event_type", {"click": "view", "error": "fault"})[1]


@query(f"SELECT post_id, pic_index, pos, CASE WHEN source IS NULL AND contains(content, name) THEN 'text' ELSE source END AS source FROM {ITEMS}")
def c06_infer_source(t: Inputs):
    lists = label_items(t).groupBy("post_id", "pic_index", "content").agg(F.collect_list(F.struct("name", "confidence", "source", "pos")).alias("items"))
    out = lists.select("post_id", "pic_index", F.explode(repair.infer_source(F.col("items"), F.col("content"))).alias("i"))
    return out.select("post_id", "pic_index", "i.pos", "i.source")


@query(f"""
    WITH c AS (SELECT post_id, pic_index, count(*) FILTER (source IS NULL) AS no_source, count(*) FILTER (confidence < 0 OR confidence > 1) AS bad_confidence FROM {ITEMS} GROUP BY 1, 2)
    SELECT post_id, pic_index, 'no_source' AS flag, no_source AS n FROM c WHERE no_source > 0 UNION ALL SELECT post_id, pic_index, 'bad_confidence', bad_confidence FROM c WHERE bad_confidence > 0""")
def c07_quality_flags(t: Inputs):
    counts = label_items(t).groupBy("post_id", "pic_index").agg(F.count_if(F.col("source").isNull()).alias("a"), F.count_if((F.col("confidence") < 0) | (F.col("confidence") > 1)).alias("b"))
    return counts.select("post_id", "pic_index", F.explode(repair.quality_flags({"no_source": F.col("a"), "bad_confidence": F.col("b")})).alias("f")).select("post_id", "pic_index", "f.*")


WRITTEN = "CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN ' NULL ' WHEN 2 THEN '(null)' WHEN 3 THEN concat('  ', p_name, ' ') ELSE p_name END"


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 >= 3 THEN p_name END AS name FROM part")
def c08_nullable_text(t: Inputs):
    return t.part.select("p_partkey", repair.nullable_text(F.expr(WRITTEN)).alias("name"))


@query("""
    SELECT conv_id, turn, len(list_filter(list_transform(string_split(text, ' '), lambda x: trim(x)), lambda x: length(x) >= 3 AND NOT regexp_matches(x, '(?i)^@|https?://|www\\.|the'))) AS n_useful
    FROM conversations""")
def c09_useful_text(t: Inputs):
    return t.conversations.select("conv_id", "turn", F.size(repair.useful_text(F.split("text", " "), ["the"])).cast("long").alias("n_useful"))


@query("""
    SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, d.lang) AS lang, CASE WHEN l.toxic = 1 THEN d.lang END AS old_lang, l.doc_id IS NOT NULL AS patched
    FROM documents d LEFT JOIN labels l USING (doc_id)""")
def c10_patch_merge(t: Inputs):
    patch = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("lang"))
    return repair.patch_merge(t.documents.select("doc_id", "lang"), patch, ["doc_id"], ["lang"])


@query("SELECT count(*) AS n_read, count(*) AS n_written, count(*) FILTER (event_type = 'click') AS n_changed, true AS reconciled FROM events")
def c11_repair_metrics(t: Inputs):
    before = t.events.select("event_id", "event_type")
    return repair.repair_metrics(before, repair.map_enum(before, "event_type", {"click": "view"})[0], "event_id", ["event_type"])


@query("SELECT s_suppkey, trim(regexp_replace(trim(s_name), '^Supplier', '')) AS region FROM supplier")
def c12_clean_prefix(t: Inputs):
    return t.supplier.select("s_suppkey", repair.clean_prefix(F.col("s_name"), "Supplier").alias("region"))


@query("""
    SELECT p_partkey, v.vocab_id, CASE WHEN v.vocab_id IS NULL THEN 'unmapped' ELSE 'exact_alias' END AS mapping_method, 'v1' AS vocab_version
    FROM part LEFT JOIN (SELECT lower(p_type) AS alias, min(p_size) AS vocab_id FROM part WHERE p_size <= 25 AND p_partkey % 3 = 0 GROUP BY 1) v ON v.alias = lower(trim(p_type))""")
def c13_controlled_vocab(t: Inputs):
    vocab = t.part.where("p_size <= 25 AND p_partkey % 3 = 0").groupBy(F.lower("p_type").alias("alias")).agg(F.min("p_size").alias("vocab_id"))
    return repair.map_vocab(t.part.select("p_partkey", "p_type"), vocab, "p_type", "v1").drop("p_type")

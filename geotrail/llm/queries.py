"""The operators applied to whole tables, one query each, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, bond, bpe, langid, metricjoin, mpeg, nearset, packing, recipes, repeats, secrets, shards, spelling
from .common import read_table


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    ids = bpe.encode(read_table(spark, sf_dir, "documents"), path)
    return ids.withColumn("d", bpe.digest(F.col("ids"), path)).select("doc_id", "n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mpeg.read_media(mpeg.store_texts(read_table(spark, sf_dir, "documents")), keep_payload=False)
    feature = F.concat_ws(";", F.concat_ws("/", "samples", "rate"), F.concat("table_frames", F.lit(":"), "table_bytes"), F.md5("toc"), "bad_frames", "skipped_bytes", F.md5(F.concat_ws(",", F.col("offsets").cast("array<string>"))))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op3_compacted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.compacted(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "arrival", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), keep_ids=False)


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents"), keep_text=False)


def op7_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bitpack.write_packed(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return bitpack.read_packed(spark.read.parquet(path), keep_ids=False)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearset.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != secrets.KINDS[3])

    def of_kind(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = secrets.scan_table(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", *map(of_kind, secrets.KINDS[:3]), F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(spans).alias("spans"))


def misspelt(name: str, run: str) -> str:
    """The run of document name, one in 31 without the code point that a checksum picks."""
    h = zlib.crc32(f"{name}:{run}".encode())
    return run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"), edit=misspelt)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metricjoin.similar_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe_tree, op2_mpeg_audio, op3_compacted_shards, op4_language_id, op5_pack_sequences, op6_repeated_substrings, op7_packed_ids, op8_exact_dedup, op9_near_dedup, op10_secret_scan, op11_spelling_variants, op12_hard_negatives, op13_jaccard_join)}

ORACLES: dict[str, str] = {
    "op3_compacted_shards": """
        SELECT doc_id, CAST(coalesce(((doc_id % 8) + 8) % 8, 0) AS INTEGER) AS arrival, lang, source, n_chars,
               strlen(text) AS n_bytes, sha256(text) AS text_sha256
        FROM documents""",
    "op8_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
        FROM t""",
    "op11_spelling_variants": r"""
        WITH RECURSIVE
        steps AS (
            SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
            FROM range(256) r(i)),
        runs AS (
            SELECT doc_id, run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]{7,}')) AS run FROM documents)
            GROUP BY ALL),
        hashed AS (
            SELECT run, n, xor(4294967295, list_reduce(
                       list_prepend(4294967295, list_transform(range(1, strlen(key) + 1), lambda k: CAST('0x' || substr(hex(encode(key)), 2 * k - 1, 2) AS BIGINT))),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
            FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key FROM runs), steps),
        words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n
            FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
            WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        skips AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
        pairs AS (
            SELECT a.word, b.word AS near FROM skips a JOIN skips b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, a.rest FROM skips a JOIN words b ON a.rest = b.word
            UNION SELECT a.rest, a.word FROM skips a JOIN words b ON a.rest = b.word),
        near AS (SELECT p.word, p.near, w.n FROM pairs p JOIN words w ON p.near = w.word),
        best AS (SELECT word, near AS form, n AS form_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, near) = 1),
        forms AS (
            SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 10 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n
            FROM words w LEFT JOIN best b USING (word)),
        walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON w.at = f.word WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
        FROM forms f JOIN walk w USING (word) JOIN forms e ON w.at = e.word WHERE e.form IS NULL""",
    "op12_hard_negatives": """
        WITH rows AS (
            SELECT vec_id, row_number() OVER () AS own, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
        scores AS (
            SELECT a.own, a.vec_id AS anchor_id, b.vec_id AS id, b.own AS other, a.label = b.label AS same,
                   CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM rows a JOIN rows b ON a.own <> b.own WHERE a.vec_id % 50 = 0),
        positives AS (
            SELECT own, anchor_id, id AS positive_id, other, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY own ORDER BY score DESC, id NULLS LAST, other) <= 5)
        SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.own, p.other ORDER BY n.score DESC, n.id NULLS LAST, n.other) AS INTEGER) AS rank,
               n.id AS negative_id, p.positive_score, n.score AS negative_score
        FROM positives p JOIN scores n ON p.own = n.own AND NOT n.same
             AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
        QUALIFY row_number() OVER (PARTITION BY p.own, p.other ORDER BY n.score DESC, n.id NULLS LAST, n.other) <= 3""",
    "op13_jaccard_join": r"""
        WITH RECURSIVE
        texts AS (
            SELECT doc_id, row_number() OVER () AS own,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT DISTINCT own, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS x
            FROM texts),
        sizes AS (SELECT own, count(*) AS n FROM sets GROUP BY own),
        common AS (SELECT a.own AS a, b.own AS b, count(*) AS n FROM sets a JOIN sets b ON a.x = b.x AND a.own <> b.own GROUP BY ALL),
        links AS (
            SELECT c.a, c.b FROM common c JOIN sizes x ON x.own = c.a JOIN sizes y ON y.own = c.b
            WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
        reach AS (SELECT own, own AS other FROM texts UNION SELECT r.own, l.b FROM reach r JOIN links l ON l.a = r.other)
        SELECT t.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(o.doc_id) AS component_id
        FROM reach r JOIN texts t ON t.own = r.own JOIN texts o ON o.own = r.other LEFT JOIN sizes s ON s.own = t.own
        GROUP BY t.own, t.doc_id""",
}

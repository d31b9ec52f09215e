import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from geotrail.llm.queries import ORACLES, QUERIES

from ..oracles import SF, assert_same
from .data import awkward, frame, prose
from .test_dedup import near_by_force
from .test_queries import crc, ids_of

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name])


def test_stages_against_brute_force(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    rng = random.Random(12)
    rows = awkward()
    for _ in range(10):
        words = prose(rng, 80).split()
        rows += [(5000 + len(rows), " ".join(words), "en", *[None] * 6), (5001 + len(rows), " ".join([*words, "tail"]), "en", *[None] * 6), (5002 + len(rows), " ".join(words), "en", *[None] * 6)]
    rows.append((9000, "the of an password=hunter22 the of an", "en", *[None] * 6))
    docs = frame(spark, rows).withColumn("n_chars", F.col("doc_id"))
    columns = docs.columns

    def step(name, df):
        path = f"{spark.conf.get('spark.checkpoint.dir')}/{name}-{rng.random()}"
        stages[name](spark, df, SF).write.parquet(path)
        return spark.read.parquet(path)

    one = step("language_id", docs)
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert one.columns == columns
    assert sorted(str(r.doc_id) for r in one.collect()) == sorted(str(r[0]) for r in rows if letters(r[1]))
    two = step("exact_dedup", one)
    keep = {}
    for r in rows:
        if letters(r[1]):
            best = keep.get(r[1], (None,))[0]
            keep[r[1]] = (r[0] if best is None else max(best, r[0] if r[0] is not None else best), r[1])
    assert two.columns == columns and sorted(map(str, ((r.doc_id, r.text) for r in two.collect()))) == sorted(map(str, keep.values()))
    three = step("near_dedup", two)
    assert three.columns == columns
    want = [i for i, _, c in near_by_force([(r.doc_id, r.text) for r in two.collect()]) if i == c]
    assert sorted(str(r.doc_id) for r in three.collect()) == sorted(want)
    four = step("secret_scan", three)
    texts = {r.doc_id: r.text for r in four.collect()}
    assert four.columns == columns and texts[9000] == "the of an [secret] the of an"
    assert texts[7] == "[secret]"  # 3000 hex digits
    assert all(texts[r.doc_id] == r.text for r in three.collect() if r.doc_id not in (7, 9000))
    five = step("pack", four).collect()
    pieces, bins = [], {}
    for r in four.collect():
        ids = [*ids_of("word_bpe_49k.json", r.text), 1]
        pieces += [(str(r.doc_id), n, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])) for n, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in five) == sorted(pieces)
    for r in five:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in map(sorted, bins.values()):
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 4096
    assert {r.doc_id for r in five} == set(texts)


def test_near_dedup_tells_repeated_ids_apart(spark):
    import corpus_pipeline

    rng = random.Random(13)
    words = prose(rng, 120)
    rows = [(3, words), (5, words + " tail"), (5, prose(rng, 90)), (None, words + " end"), (None, prose(rng, 70))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, (rows[0], rows[2], rows[4])))


def test_near_dedup_without_ids(spark):
    import corpus_pipeline

    rng = random.Random(17)
    words = prose(rng, 120)
    rows = [(None, words), (None, words + " tail"), (None, words), (None, prose(rng, 90)), (None, ""), (None, " "), (None, None)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF).collect()
    assert sum((r.text or "").startswith(words) for r in got) == 1 and len(got) == 5


def test_stages_leave_columns_of_any_name_alone(spark):
    import corpus_pipeline

    rows = [(k, f"the of an words that are here {k}", "en", "s", 9, "a", "b", "c", "d", "e", "f") for k in range(4)] + [(None, None, None, None, None, "a", "b", "c", "d", "e", "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _sha string, SHA string, _predicted string, Predicted string, _spans string, spans string")
    own = docs.columns[5:]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF).select(*own).distinct().collect()
        assert [tuple(r) for r in got] == [("a", "b", "c", "d", "e", "f")], name


def test_stages_on_an_empty_table(spark):
    import corpus_pipeline

    docs = frame(spark, []).withColumn("n_chars", F.col("doc_id"))
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, SF)
        assert out.count() == 0, name
        docs = out if name != "pack" else docs


def test_run_is_the_stages(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and hashlib and all(r.offset + r.length <= 4096 for r in rows)

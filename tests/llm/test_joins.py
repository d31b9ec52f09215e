"""Spelling variants, hard negatives and the Jaccard join against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotrail.llm import bond, metricjoin, spelling
from geotrail.llm.queries import ORACLES, QUERIES

from ..oracles import assert_same
from .data import awkward, documents, frame, prose
from .test_dedup import near_by_force


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_hard_negatives", "op13_jaccard_join"])
def test_oracles(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name])


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_by_force(counts):
    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v), default=None) for w, vs in near.items()}
    form = {w: b if b is not None and counts[b] >= 10 * counts[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, str(form[w]), root(w), counts[w], len(near[w]), str(counts.get(form[w]))) for w in counts)


def test_variants(spark):
    rng = random.Random(21)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))): rng.choice([1, 3, 10, 30, 100, 1000, 10**6]) for _ in range(300)}
    words |= {"a": 5, "aa": 7, "aaa": 70, "b" * 3000: 2, "b" * 2999 + "c": 40, "b" * 3001: 400, "😀aaaa": 3, "aaaa": 30, "": 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long").unionByName(spark.createDataFrame([(None, 5)], "word string, n long"))
    for parts in ("1", "7"):  # words in one range, and in several
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in spelling.variants(df).collect())
        assert got == variants_by_force(words)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spelling.variants(df.limit(0)).count() == 0


def test_tries_number_beginnings(spark):
    words = ["", "a", "ab", "abc", "abd", "b", "bc", "é", "éa", "zz"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for backwards in (False, True):
        nodes = {}
        for r in spelling.trie_paths(df, backwards).collect():
            key = r.word[::-1] if backwards else r.word
            for k, node in enumerate(r.path):
                assert nodes.setdefault(key[:k], node) == node
            assert len(r.path) == len(key) + 1
        assert len(set(nodes.values())) == len(nodes)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_words_of_texts(spark):
    texts = ["Straße straße STRASSE", "Ångström ångström ngström", None, "", "x" * 3000 + " " + "x" * 3000, "abcdefg,abcdefg;ABCDEFG abcdef", "naïveté-naïveté"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "abcdefg"), (5, texts[5])]

    def edit(name, run):
        h = zlib.crc32(f"{name}:{run}".encode())
        return run if h % 3 else run[: h % len(run)] + run[h % len(run) + 1 :]

    counts = Counter()
    for k, t in rows:
        for run in "".join(c if c in "abcdefghijklmnopqrstuvwxyz" or "À" <= c <= "ÿ" else " " for c in "".join(c.lower() if c < "\x80" else c for c in t or "")).split():
            word = edit("" if k is None else str(k), run)
            if len(word) >= 7:
                counts[word] += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.word: r.n for r in spelling.word_counts(df, "doc_id", "text", edit).collect()} == counts
    got = sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in spelling.spelling_variants(df, edit=edit).collect())
    assert got == variants_by_force({w: n for w, n in counts.items() if n >= 2})
    assert spelling.spelling_variants(frame(spark)).count() >= 0 and spelling.spelling_variants(frame(spark, [])).count() == 0


def negatives_by_force(rows):
    taking = [(k, i, y, [int(np.floor(256 * x)) for x in v]) for k, (i, y, v) in enumerate(rows) if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, i, y, v in taking:
        if i is None or i % 5:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, z) for n, j, z, w in taking if n != k and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for p, j, z in [s for s in scored if s[2] == y][:5]:
            found = [s for s in scored if s[2] != y and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(i, j, n + 1, m, p, q) for n, (q, m, _) in enumerate(found)]
    return sorted(map(str, out))


@pytest.mark.parametrize("group, section", [(2**19, 2**16), (200, 60)])
def test_negatives(spark, group, section, monkeypatch):
    monkeypatch.setattr(bond, "GROUP", group)
    monkeypatch.setattr(bond, "SECTION", section)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 0.3, (6, 20))
    rows = [(k, int(rng.integers(0, 4)), [float(x) for x in centres[k % 6] + rng.normal(0, 0.1, 20)]) for k in range(160)]
    rows += [(200 + k, k % 3, rows[0][2]) for k in range(30)]  # one vector very often
    rows += [rows[5], rows[5], (None, 1, rows[6][2]), (300, None, rows[6][2]), (305, 1, None), (310, 1, [None] * 20), (315, 1, [float("nan")] * 20), (320, 1, [float("inf")] + [0.0] * 19)]
    rows += [(325, 1, []), (330, 2, []), (-5, 1, [0.0] * 20), (335, 1, [1.0, 2.0]), (340, 1, [2.0, 2.0]), (341, 2, [1.0, 1.5]), (345, 1, [1e5] * 3), (346, 1, [1e5] * 3), (347, 2, [9e4] * 3)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumn("score", F.lit("x")).withColumn("GRP", F.lit(1)).repartition(3)
    got = sorted(str(tuple(r)) for r in bond.hard_negatives(df, F.col("vec_id") % 5 == 0).collect())
    assert got == negatives_by_force(rows) and len(got) > 100
    assert bond.hard_negatives(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert bond.hard_negatives(df, F.lit(False)).count() == 0


def edited(rng, words, share):
    return [w if rng.random() >= share else f"w{rng.randrange(10**6)}" for w in words]


@pytest.mark.parametrize("small, sample, block", [(24, 4096, 2**19), (2, 4096, 2**19), (2, 3, 600)])  # the last: hardly a pivot, tiny blocks
def test_jaccard_join(spark, small, sample, block, monkeypatch):
    monkeypatch.setattr(metricjoin, "SAMPLE", sample)
    monkeypatch.setattr(metricjoin, "LEAST", 1)
    rng = random.Random(23)
    rows = [r[:2] for r in awkward()]

    def add(words):
        rows.append((len(rows) + 1000, " ".join(words)))

    common = prose(rng, 60).split()
    for _ in range(12):  # groups of copies with an edit each, more alike and less, with a passage that all share
        base = prose(rng, rng.randrange(30, 200)).split() + common
        for _ in range(rng.choice([1, 2, 9])):
            add(edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.03])))
    chain = prose(rng, 150).split()
    for _ in range(25):  # each links with the next only
        add(chain)
        chain = chain[6:] + prose(rng, 6).split()
    template = prose(rng, 100).split()
    for _ in range(30):  # much alike, but no links; some pairs that are
        own = template + prose(rng, 40).split()
        add(own)
        if rng.random() < 0.3:
            add(edited(rng, own, 0.01))
    rows += [(None, rows[-1][1]), (None, rows[-1][1] + " tail"), rows[-2], (7, "a b c"), (8, "a b c"), (9, "A b C"), (10, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit(1)).withColumn("Key", F.lit("k")).repartition(5)
    got = metricjoin.similar_documents(df, small=small, block=block).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near_by_force(rows, 80)
    assert metricjoin.similar_documents(df.limit(0)).count() == 0


def test_pivots_measure_whole_sets():
    texts = ["a b c d e f g h", "a b c d e f g x", "p q r s t u v", "a b c d e f g h"]
    pivots = metricjoin.Pivots(texts, 80)
    sets = list(map(metricjoin.shingles, texts))
    kept = [sets[0], sets[1], sets[2]]  # the last one is the first
    for text in (*texts, "a b c d e", "z"):
        s = metricjoin.shingles(text)
        at = pivots.place(s)
        got = {p: (b, u) for p, b, u in zip(*(x.tolist() for x in pivots.similar(at, len(s))))}
        want = {k: (len(np.intersect1d(s, t)), len(np.union1d(s, t))) for k, t in enumerate(kept) if len(np.intersect1d(s, t))}
        assert got == want and sorted(pivots.ordered(s, at)) == s.tolist()
    assert metricjoin.prefixes(10, 80) == (3, 2)


def test_few_shingles_are_searched_in_the_sample(monkeypatch):
    rng = random.Random(24)
    texts = [prose(rng, 60) for _ in range(30)]
    pivots, looked_up, search = metricjoin.Pivots(texts, 80), [], np.searchsorted
    monkeypatch.setattr(metricjoin.np, "searchsorted", lambda a, v: looked_up.append(len(v)) or search(a, v))
    other = metricjoin.shingles(prose(rng, 5000))
    assert (pivots.place(other) == -1).all() and sum(looked_up) < 50
    assert (pivots.tokens[pivots.place(metricjoin.shingles(texts[3]))] == metricjoin.shingles(texts[3])).all()
    assert (metricjoin.Pivots([], 80).place(other) == -1).all()


def test_jaccard_join_leaves_no_shuffles_and_no_shingles_behind(spark):
    import time
    from pathlib import Path

    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(40)]
    texts = [base[k % 40] + (f" x{k} y{k}" if k % 3 else "") for k in range(160)]
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    local = [Path(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    shuffles = lambda: {f.name for d in local for f in d.rglob("shuffle_*.data")}
    folders, files, name = set(shared.iterdir()), shuffles(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name, None)
    out = metricjoin.similar_documents(documents(spark, texts))
    assert spark.conf.get(name, None) == setting
    until = time.time() + 20
    while (left := shuffles() - files) and time.time() < until:
        time.sleep(0.5)
    assert not left
    tables = [spark.read.parquet(f"file://{d}").columns for d in set(shared.iterdir()) - folders if any(d.rglob("*.parquet"))]
    assert tables and not [c for c in tables if "tokens" in c or "visits" in c]
    # the table that is returned can be read more than once
    assert out.count() == len(out.collect()) == len(out.collect()) == 160

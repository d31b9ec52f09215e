import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotrail.llm import common, graph, nearset, recipes, repeats
from geotrail.llm.graph import components

from .data import awkward, documents, frame, prose


def test_chunks_cover_the_text():
    rng = random.Random(4)
    texts = [b"", b"x", prose(rng, 9000).encode(), b"z" * 100_000, prose(rng, 60).encode()]
    for t, ends in zip(texts, recipes.chunk_ends(texts)):
        sizes = [b - a for a, b in zip([0, *ends], ends)]
        assert sum(sizes) == len(t) and max(sizes) <= recipes.LARGEST and ends == next(recipes.chunk_ends([t]))


def expected_duplicates(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(str(i), str(keep), len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out), len(groups)


@pytest.mark.parametrize("digest_bytes", [16, 1])  # one byte: most digests stand for several contents
def test_exact_duplicates(spark, digest_bytes):
    rng = random.Random(6)
    base = [prose(rng, rng.randrange(1, 900)) for _ in range(80)]
    rows = awkward() + [(100 + k, rng.choice(base), None, *[None] * 6) for k in range(200)]
    got = recipes.exact_duplicates(frame(spark, rows), digest_bytes=digest_bytes).collect()
    want, groups = expected_duplicates(rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == groups and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert recipes.exact_duplicates(frame(spark, [])).count() == 0


def test_duplicates_after_normalization(spark):
    got = recipes.exact_duplicates(documents(spark, ["A b", "a B", "c"]), normalize=F.lower).collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {(0, 1), (1, 1), (2, 2)}


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, 2), (7, 2), (9, 8)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 1: 1, 2: 1, 7: 1, 8: 8, 9: 8}


def test_components_drop_edges_that_are_settled(spark, monkeypatch):
    rng = random.Random(21)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1500)] + [(k, k) for k in (5, 6000)] + [(k + 1, k) for k in range(7000, 7100)]
    label = {}
    for a, b in sorted(map(sorted, edges)) * 99:
        label[a] = label[b] = min(label.get(a, a), label.get(b, b))
    assert all(label[a] == label[b] for a, b in edges)
    assert {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == label
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df: written.append((out := common.materialize(df)).count()) or out)
    star = [(0, k) for k in range(1, 2001)] + [(k, k + 1) for k in range(1, 2000, 2)]
    assert {r.label for r in components(spark.createDataFrame(star, "a bigint, b bigint")).collect()} == {0}
    assert sum(written) <= 3000 + 2 * 2001  # the edges once, each node twice, then nothing is left


def test_shingles_hash_words_together(monkeypatch):
    rng = random.Random(22)
    texts = [None, "", " ", "a", "A b\x0bC", "x y x y x y x y x y", "é É a b c d", *[prose(rng, n) for n in (4, 5, 6, 900)]]
    monkeypatch.delattr(nearset.hashlib, "blake2b")  # no call for each word
    for text in texts:
        s = nearset.shingles(text)
        assert len(s) == len(plain_shingles(text)) and (s[1:] > s[:-1]).all()
    assert (nearset.shingles("A b c d e f") == nearset.shingles("a  b c d e f")).all()
    assert not set(nearset.shingles("a b c d e")) & set(nearset.shingles("a b c d")) | set(nearset.shingles("b a c d e")) & set(nearset.shingles("a b c d e"))


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near_by_force(rows, percent=75):
    sets = [plain_shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    lowest = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            lowest[find(k)] = min(lowest.get(find(k), r[0]), r[0])
    return sorted((str(r[0]), len(sets[k]), str(lowest.get(find(k)))) for k, r in enumerate(rows))


@pytest.mark.parametrize("small", [24, 3])  # 3: most nodes branch again or meet their pivots
def test_near_duplicates(spark, small):
    rng = random.Random(8)
    rows = awkward()
    for g in range(12):
        words = prose(rng, rng.randrange(20, 300)).split()
        for _ in range(rng.randrange(1, 14)):
            copy = list(words)
            for _ in range(rng.randrange(0, max(1, len(words) // 50))):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((1000 + len(rows), " ".join(copy), None, *[None] * 6))
    got = nearset.near_duplicates(frame(spark, rows), small=small).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near_by_force(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert nearset.near_duplicates(frame(spark, [])).count() == 0


def star(rng, n, words=208):
    """An original and n copies, each at 0.82 or 0.78 to it and below 0.75 to one another."""
    base = prose(rng, words).split()
    out = [" ".join(base)]
    for k in range(n):
        copy = list(base)
        for at in rng.sample(range(1, words // 6), 4 + k % 2):
            copy[at * 6] = f"new{rng.random()}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("copies", "block"), [(100, nearset.BLOCK), (1000, nearset.BLOCK), (100, 2**12)])  # the last: many blocks a leaf
def test_near_duplicates_of_stars_and_templates(spark, copies, block):
    rng = random.Random(10)
    texts = star(rng, copies)
    template = prose(rng, 140)
    for k in range(80):
        own = prose(rng, 60)
        texts += [f"{template} {own}"] if k % 4 else [f"{template} {own}", f"{template} {own} tail"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = nearset.near_duplicates(documents(spark, []).union(spark.createDataFrame(rows, "doc_id bigint, text string")), block=block).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near_by_force(rows)


def test_near_duplicates_of_pairs_that_share_most_of_their_text(spark):
    rng = random.Random(15)
    template = prose(rng, 176).split()  # of every two pairs about 0.70 is the same
    rows = []
    for k in range(300):
        own = prose(rng, 37).split()
        rows += [(2 * k, " ".join(template + own)), (2 * k + 1, " ".join(template[:88] + [f"new{k}"] + template[89:] + own[:-6] + [f"end{k}"] * 6))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = near_by_force(rows)
    assert sum(i != c for i, _, c in want) == 300
    for block in (nearset.BLOCK, 2**14):
        got = nearset.near_duplicates(docs, block=block).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


def test_near_duplicates_without_ids(spark):
    rng = random.Random(16)
    texts = [prose(rng, 60) for _ in range(40)]
    rows = [(None, t) for t in texts] + [(None, f"{t} tail") for t in texts] + [(k, f"{t} end") for k, t in enumerate(texts[:9])]
    got = nearset.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near_by_force(rows)
    # of a component without a known id one row stays
    assert sum(r.kept for r in got) == 40 and all(r.kept == (r.doc_id == r.component_id) for r in got if r.component_id is not None)
    twins = [(None, texts[0]), (None, texts[0]), (None, texts[0] + " tail"), (None, ""), (None, None), (None, texts[1])]
    got = nearset.near_duplicates(spark.createDataFrame(twins, "doc_id bigint, text string")).collect()
    assert sorted((r.n_shingles > 0, r.kept) for r in got) == [(False, True), (False, True), (True, False), (True, False), (True, True), (True, True)]


def repeats_by_force(rows, window):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[k : k + window] for t in texts for k in range(len(t) - window + 1))
    out = []
    for r, t in zip(rows, texts):
        kept, n, runs = repeats.kept_bytes(t, [(k, k + window) for k in range(len(t) - window + 1) if seen[t[k : k + window]] > 1])
        out.append((str(r[0]), len(t), n, runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("window", "few", "segment"), [(144, 3, 100), (200, 200, 500_000)])  # 3: most slices are halved; 100: texts in segments
def test_repeats(spark, window, few, segment):
    rng = random.Random(9)
    rows = awkward()
    passages = [prose(rng, rng.randrange(15, 120)) for _ in range(6)]
    for k in range(60):
        parts = [prose(rng, rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 2)
            parts += [p[a : rng.randrange(a, len(p))], prose(rng, rng.randrange(0, 30))]
        rows.append((2000 + k, " ".join(parts), None, *[None] * 6))
    zeros = "\0" * 40
    rows += [(2900 + k, f"{prose(rng, k)}{zeros * (k % 4)}{passages[0]}{zeros[k:]}{passages[1]}", None, *[None] * 6) for k in range(12)]
    rows += [(3000, "xy" * 400, None, *[None] * 6), (3001, "é" * 150, None, *[None] * 6), (3002, "q" * (window - 1), None, *[None] * 6), (3003, "q" * window, None, *[None] * 6), (3004, "w" * (window + 1), None, *[None] * 6)]
    got = repeats.remove_repeats(frame(spark, rows), window, few=few, segment=segment).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == repeats_by_force(rows, window)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_windows_of_a_slice_against_brute_force():
    rng = random.Random(14)
    for _ in range(60):
        window, n = rng.randrange(6, 12), rng.randrange(1, 9)
        pieces = []
        for _ in range(n):
            lo = rng.randrange(0, 4)
            hi = lo + rng.randrange(0, 5)
            data = bytes(rng.choice(b"\0ab") for _ in range(hi - lo + window))
            pieces.append((rng.randrange(2), lo, hi, data))
        seen = Counter((s, d, x[hi - d : hi - d + window]) for s, lo, hi, x in pieces for d in range(lo, hi + 1))
        want = {(k, d) for k, (s, lo, hi, x) in enumerate(pieces) for d in range(lo, hi + 1) if seen[s, d, x[hi - d : hi - d + window]] > 1}
        s, lo, hi, data = zip(*pieces)
        piece, place = repeats.repeated_windows(*map(np.array, (s, lo, hi)), list(data), window)
        assert set(zip(piece.tolist(), place.tolist())) == want


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        repeats.Parse([b"x"], 100)


def test_once_gives_the_rows_of_plain_joins(spark):
    members = spark.createDataFrame([(n, i) for i in (1, 2, 3) for n in range(i * 10, i * 10 + 4)] + [(10, 1), (99, 9)], "node long, id long")
    sizes, labels = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "id long, n long"), spark.createDataFrame([(1, 1), (3, 1)], "id long, label long")
    got = nearset._once(members, sizes, labels)
    plain = members.join(sizes, "id").join(labels, "id", "left")
    assert sorted(got.select("node", "id", "n", "label").collect(), key=str) == sorted(plain.select("node", "id", "n", "label").collect(), key=str)
    assert got.count() == 13


def test_children_of_a_group_are_made_once(spark, monkeypatch):
    rng = random.Random(23)
    base = prose(rng, 300).split()
    texts = []
    for k in range(400):
        copy = list(base)
        copy[k % 300] = f"new{k}"
        texts.append(" ".join(copy))
    branch, made = nearset._branch, []

    def counted(*of):
        tally = spark.sparkContext.accumulator(0)

        def count(batches):
            for pdf in batches:
                tally.add(len(pdf))
                yield pdf

        out = branch(*of)
        made.append(tally)
        return out.mapInPandas(count, out.schema)

    monkeypatch.setattr(nearset, "_branch", counted)
    rows = []
    for n in (200, 400):
        made.clear()
        classes = spark.createDataFrame([(k, nearset.minwise(nearset.shingles(t)).tolist()) for k, t in enumerate(texts[:n])], "id long, tokens array<int>")
        found, leaves = nearset.candidates(classes)
        assert leaves.count() > 0 and len(made) == nearset.DEPTH
        assert max(tally.value for tally in made) <= n * nearset.TREES * nearset.FIRST  # linear in the group, each computed a single time
        rows.append(sum(tally.value for tally in made))
    assert rows[1] <= 2.5 * rows[0]

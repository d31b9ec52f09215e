"""Searches by grid cells against all pairs, with places near the poles and on both sides of 180 degrees."""

import random
from math import asin, cos, radians, sin, sqrt

import pytest

from geotrail.functions import geo
from geotrail.operators import cluster, joins, serve

DAY = 86_400_000_000


def km(a, b):
    p, q = radians(a[1]), radians(b[1])
    h = sin((q - p) / 2) ** 2 + cos(p) * cos(q) * sin(radians(b[0] - a[0]) / 2) ** 2
    return 2 * geo.KM * asin(sqrt(min(1.0, h)))


def places(rng, n):
    spots = [(179.9, 10.0), (-179.9, 10.0), (0.0, 89.7), (120.0, 89.8), (-60.0, -89.9), (100.0, 30.0), (100.5, 60.0), (-180.0, 0.0), (180.0, 0.1)]
    out = []
    for _ in range(n):
        x, y = rng.choice(spots) if rng.random() < 0.9 else (rng.uniform(-180, 180), rng.uniform(-90, 90))
        x, y = x + rng.uniform(-0.8, 0.8), max(-90.0, min(90.0, y + rng.uniform(-0.8, 0.8)))
        out.append(((x + 180) % 360 - 180, y))
    return out


def table(spark, rng, n):
    rows = [(k, rng.randrange(0, 20 * DAY), x, y, rng.randrange(2), rng.randrange(5)) for k, (x, y) in enumerate(places(rng, n))]
    return rows, spark.createDataFrame(rows, "visit_id bigint, t bigint, lon double, lat double, g int, year int")


def test_pairs_in_space_and_time(spark):
    rows, df = table(spark, random.Random(1), 300)
    for days, reach in ((1, 60), (3, 150)):
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and abs(a[1] - b[1]) <= days * DAY and km(a[2:4], b[2:4]) <= reach}
        got = [(r.left, r.right) for r in joins.st_pairs(df, days, reach).collect()]
        assert len(want) > 50 and sorted(got) == sorted(want)


def test_neighbors_and_least_distance(spark):
    rng = random.Random(2)
    rows, df = table(spark, rng, 250)
    got = {r.visit_id: (r.neighbors, r.viable) for r in serve.neighborhoods(df, 80, 5, "g").collect()}
    for a in rows:
        n = sum(a[0] != b[0] and a[4] == b[4] and km(a[2:4], b[2:4]) <= 80 for b in rows)
        assert got[a[0]] == (n, n >= 4)
    few = df.where("visit_id % 25 = 0")
    near = {r.visit_id: r.km for r in geo.min_distance(df, few, ["g"], "visit_id").collect()}
    for a in rows:
        want = min((km(a[2:4], b[2:4]) for b in rows if b[0] % 25 == 0 and a[4] == b[4]), default=None)
        assert (want is None and a[0] not in near) or abs(near[a[0]] - want) < 1e-6


def test_nearest_members(spark):
    rows, df = table(spark, random.Random(3), 200)
    got = {}
    for r in serve.nearest_k(df.where("visit_id % 10 = 0"), df, "g", 4).collect():
        got.setdefault(r.anchor_id, {})[r["rank"]] = r.visit_id
    for a in rows[::10]:
        ranked = sorted((round(km(a[2:4], b[2:4]) + 60 * abs(a[5] - b[5]), 6), b[0]) for b in rows if a[0] != b[0] and a[4] == b[4])[:4]
        assert got[a[0]] == {k + 1: b for k, (_, b) in enumerate(ranked)}


def test_nearest_in_a_crowd(spark):
    rng = random.Random(6)
    rows, _ = table(spark, rng, 40)
    rows += [(1000 + k, 0, 100.0 + rng.random() / 50, 30.0 + rng.random() / 50, 0, 2) for k in range(400)]  # a dense town
    rows += [(2000 + k, 0, 100.01, 30.01, 0, rng.randrange(2)) for k in range(60)]  # and one very busy place in it
    df = spark.createDataFrame(rows, "visit_id bigint, t bigint, lon double, lat double, g int, year int")
    anchors = [r for r in rows if r[0] % 40 == 0 or r[0] == 2001]
    some = df.where(df.visit_id.isin([r[0] for r in anchors]))
    got = {}
    for r in serve.nearest_k(some, df, "g", 3, bound=4).collect():
        got.setdefault(r.anchor_id, {})[r["rank"]] = r.visit_id
    for a in anchors:
        ranked = sorted((round(km(a[2:4], b[2:4]) + 60 * abs(a[5] - b[5]), 6), b[0]) for b in rows if a[0] != b[0] and a[4] == b[4])[:3]
        assert got.get(a[0], {}) == {k + 1: b for k, (_, b) in enumerate(ranked)}, a
    seeded = serve.nearest_k(some, df, "g", 3, seed=5, bound=4).collect()
    assert len(seeded) == sum(map(len, got.values())) and all(0 <= r.score for r in seeded)
    # however dense the town is, an anchor meets few members
    near = geo.nearest(some.select("g", "visit_id", "lon", "lat").withColumnRenamed("visit_id", "anchor_id"), df, ["g"], "anchor_id", "visit_id", 3, bound=4)
    assert max(r["count"] for r in near.groupBy("anchor_id").count().collect()) <= 80


def test_groups_that_are_too_large_keep_a_row(spark):
    nodes = spark.createDataFrame([(g, k, float(k), 0.0) for g, n in ((1, 3), (2, 9)) for k in range(n)], "g int, node bigint, lon double, lat double")
    got = {r.g: (r.status, r.path) for r in serve.shortest_order(nodes, "g").collect()}
    assert got == {1: ("solved", [0, 1, 2]), 2: ("too_many", None)}


def test_clusters_by_cells_equal_clusters_by_pairs(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(30):  # crowds of all sizes, some of which only just reach one another
        t, x, y = rng.randrange(0, 30 * DAY), rng.choice([100.0, 179.9, 60.0]) + rng.uniform(-0.5, 0.5), rng.choice([0.0, 60.0]) + rng.uniform(-0.5, 0.5)
        for _ in range(rng.choice([1, 2, 5, 40])):
            rows.append((len(rows), t + rng.randrange(-DAY, DAY), (x + rng.uniform(-0.3, 0.3) + 180) % 360 - 180, y + rng.uniform(-0.3, 0.3)))
    df = spark.createDataFrame([*rows, (9000, 5, None, 1.0)], "visit_id bigint, t bigint, lon double, lat double")
    for days, reach, least in ((1, 30, 3), (2, 12, 2), (0.3, 40, 4), (1, 30, 1)):
        want = {r.visit_id: (r.cluster, r.role) for r in cluster.st_dbscan(df, joins.st_pairs(df, days, reach), least).collect()}
        got = {r.visit_id: (r.cluster, r.role) for r in cluster.st_dbscan_near(df, days, reach, least).collect()}
        assert got == want and len({c for c, _ in want.values()}) > 3


def test_records_of_clusters_without_a_list_of_edges(spark):
    rng = random.Random(9)
    rows = [(k, rng.randrange(0, 6 * DAY), 100 + rng.choice([0, 0.5, 3]) + rng.uniform(0, 0.2), 30 + rng.uniform(0, 0.2), k % 3, k % 5, None if k % 10 == 0 else k % 2) for k in range(120)]
    df = spark.createDataFrame(rows, "visit_id bigint, t bigint, lon double, lat double, province int, city int, cluster int")
    df = df.unionByName(spark.createDataFrame([(500, 5, 10.0, 1.0, 1, 1, 7)], df.schema))  # a cluster without edges
    want = cluster.cluster_records(df, cluster.neighbor_rule(df, (1, 30)))
    got = cluster.cluster_records_near(df, 1, 30)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_shortest_order_writes_no_partial_paths(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(f"g{g}", f"n{k}", rng.uniform(100, 102), rng.uniform(30, 32)) for g in range(40) for k in range(1 + g % 8)]
    rows += [("alone", "a", None, 1.0), ("unknown", "b", None, 1.0), ("unknown", "a", 2.0, 1.0), ("twice", "a", 1.0, 1.0), ("twice", "a", 2.0, 1.0), ("nan", "b", float("nan"), 1.0), ("nan", "a", 1.0, 1.0)]
    rows += [("line", n, x, 0.0) for n, x in (("c", 1.0), ("a", 3.0), ("b", 2.0))] + [(None, "a", 1.0, 1.0)]
    written, write = [], serve.written
    monkeypatch.setattr(serve, "written", lambda df: written.append((out := write(df)).count()) or out)
    got = {r.g: (r.status, r.path, r.km) for r in serve.shortest_order(spark.createDataFrame(rows, "g string, node string, lon double, lat double"), "g").collect()}
    assert sum(written) == len(got) == 46  # a row for each group, none for a path on the way
    assert got["alone"] == ("solved", ["a"], 0.0) and got["unknown"] == ("solved", ["a", "b"], None) and got["twice"] == got[None] == ("solved", None, None)
    assert got["nan"][:2] == ("solved", ["a", "b"]) and got["g7"] == ("too_many", None, None)
    assert got["line"][1] == ["a", "b", "c"] and got["line"][2] == pytest.approx(222.39, abs=0.1)

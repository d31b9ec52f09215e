"""Operators that were built for scale, each against a plain computation on random or skewed tables."""

import bisect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotrail.functions import geo, text
from geotrail.operators import audit, joins, mentions, rollups, sequences, serve

C = F.col
H, D = 3_600_000_000, 86_400_000_000


def km(x, y, u, v):
    p, q = math.radians(y), math.radians(v)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(u - x) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


def test_along_a_route(spark):
    rng = random.Random(3)
    trips = [(k, rng.randrange(0, 20) * D + rng.choice([0, 5 * H]), 0) for k in range(12)]
    trips = [(k, s, s + rng.randrange(0, 6) * D) for k, s, _ in trips]
    route = [(k, (179.5 + rng.uniform(0, 1.5) + 180) % 360 - 180, rng.uniform(60, 62)) for k, _, _ in trips for _ in range(3)]
    events = [(k, rng.randrange(-2 * D, 28 * D), (178 + rng.uniform(0, 4) + 180) % 360 - 180, rng.uniform(59, 63)) for k in range(300)]
    for k, s, e in trips:  # at both ends of the window, and just beyond
        events += [(1000 + 10 * k + j, t, *next(p[1:] for p in route if p[0] == k)) for j, t in enumerate((s - D, s - D - 1, e + D, e + D + 1))]
    want = set()
    for k, s, e in trips:
        for v, t, x, y in events:
            if s - D <= t <= e + D:
                best = min(km(x, y, a, b) for n, a, b in route if n == k)
                if best <= 150:
                    want.add((k, v, round(best, 6)))
    t = spark.createDataFrame(trips, "trip_id int, start bigint, end bigint")
    r = spark.createDataFrame(route, "trip_id int, lon double, lat double")
    p = spark.createDataFrame(events, "post_id int, t bigint, lon double, lat double")
    got = {(x.trip_id, x.post_id, round(x.km, 6)) for x in joins.attach_context(t, r, p).collect()}
    assert got == want and {1000 + 10 * k + j for k, _, _ in trips for j in (0, 2)} <= {v for _, v, _ in got}
    marked = p.select(C("post_id").alias("visit_id"), "t", "lon", "lat", F.when(C("post_id") % 2 == 0, "candidate").otherwise("region_only").alias("eligibility"))
    both = {(x.trip_id, x.visit_id) for x in joins.attach_secondary(t, r, marked).collect()}
    assert both == {(k, v) for k, v, d in want if v % 2 or d <= 100}


def test_along_a_route_returned_pairs_are_joined_last(spark):
    t = spark.createDataFrame([(1, 0, D), (1, 20 * D, 21 * D), (1, 0, 2 * D), (2, 50 * D, 40 * D)], "trip_id int, start bigint, end bigint")
    r = spark.createDataFrame([(1, 100.0, 30.0), (2, 100.0, 30.0)], "trip_id int, lon double, lat double")
    p = spark.createDataFrame([(k, k * D, 100.0, 30.0) for k in range(60)] + [(60, D, None, 30.0), (61, None, 100.0, 30.0)], "post_id int, t bigint, lon double, lat double")
    out = joins.attach_context(t, r, p)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert sorted((x.trip_id, x.post_id) for x in out.collect()) == [(1, k) for k in (0, 1, 2, 3, 19, 20, 21, 22)]


@pytest.mark.parametrize("few, ranges", [(100_000, 64), (40, 8), (5, 4)])
def test_quantiles(spark, few, ranges):
    rng = np.random.default_rng(few)
    groups = {
        "spread": np.exp(rng.normal(0, 40, 3000)) * rng.choice([-1, 1], 3000), "ties": rng.integers(0, 4, 2000).astype(float), "one": np.full(500, 7.5), "mostly": np.concatenate([np.full(1800, 3.0), rng.random(200) * 6]),
        "two": np.array([1.0, 2.0]), None: np.array([5.0]),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("ties", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.median, r.p90, r["max"]) for r in rollups.quantiles(df, "x", ["g"], few, ranges).collect()}
    assert set(got) == {*groups, "nothing"} and got["nothing"] == (None, None, None)
    for g, xs in groups.items():
        assert np.allclose(got[g], (*np.quantile(xs, [0.5, 0.9]), xs.max()), rtol=1e-12, atol=0), g


def test_quantiles_of_a_whole_and_of_an_empty_table(spark):
    df = spark.createDataFrame([(float(k),) for k in range(11)], "x double")
    assert tuple(rollups.quantiles(df, "x").first()) == (5.0, 9.0, 10.0)
    assert rollups.quantiles(df.where("x < 0"), "x", ["x"]).count() == 0


def nearest(anchors, t, tolerance):
    times = sorted({a for _, a in anchors})
    least = {}
    for k, a in anchors:
        least[a] = min(k, least.get(a, k))
    k = bisect.bisect_left(times, t)
    best = min((x for x in times[max(0, k - 1) : k + 1]), key=lambda x: (abs(x - t), x), default=None)
    return least[best] if best is not None and abs(best - t) <= tolerance else None


def test_nearest_in_time_whatever_the_spread(spark):
    rng = random.Random(7)
    hot = 50 * D
    rows = [(k, rng.randrange(0, 100 * D)) for k in range(300)] + [(1000 + k, hot + rng.randrange(-3, 4)) for k in range(3000)] + [(9999, None)]
    anchors = [(k, rng.randrange(0, 100 * D)) for k in range(40)] + [(500 + k, hot + rng.choice([-2, 2, 2, 2])) for k in range(50)] + [(999, None)]
    a, b = spark.createDataFrame(rows, "k int, t bigint"), spark.createDataFrame(anchors, "a int, t bigint")
    got = {r.k: r.anchor_a for r in joins.nearest_asof(a, b, "t", 72 * H, ["a"]).collect()}
    known = [x for x in anchors if x[1] is not None]
    assert got == {k: None if t is None else nearest(known, t, 72 * H) for k, t in rows}
    assert {r.anchor_a for r in joins.nearest_asof(a, b.limit(0), "t", H, ["a"]).collect()} == {None}


def test_nearest_in_time_reads_no_frame_anew(spark):
    a, b = spark.createDataFrame([(1, 5), (2, None)], "k int, t bigint"), spark.createDataFrame([(7, 4), (8, 6)], "a int, t bigint")
    out = joins.nearest_asof(a, b, "t", H, ["a"])
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    assert {(r.k, r.anchor_a) for r in out.collect()} == {(1, 7), (2, None)}


@pytest.mark.parametrize("parts", [1, 4])
def test_totals_in_spans_without_their_pairs(spark, parts):
    rng = random.Random(parts)
    at = lambda: rng.choice([rng.randrange(0, 9 * D), 4 * D, 4 * D + 1])
    spans = [(f"s{k % 40}", start := at(), start + rng.choice([0, 0, D, 3 * D, -D, -3 * D])) for k in range(60)] + [("none", 90 * D, 91 * D), ("null", None, 3 * D), (None, 0, D)]
    spans += [("ends", 20 * D, 21 * D), ("unknown", 40 * D, 41 * D)]
    events = [(k - 50, at()) for k in range(300)] + [(1000, 19 * D), (2000, 19 * D - 1), (4000, 22 * D), (8000, 22 * D + 1), (None, 40 * D), (5, None), (2**62, 60 * D), (2**62, 60 * D), (2**62, 61 * D)]
    s, e = spark.createDataFrame(spans, "trip string, start bigint, end bigint"), spark.createDataFrame(events, "v bigint, t bigint").repartition(parts)
    got = {tuple(r) for r in joins.interval_totals(s, e, "trip", "t", "v").collect()}
    pairs = joins.interval_join(s, e, "t").groupBy("trip").agg(F.count("*"), F.sum("v"))
    assert got == {tuple(r) for r in pairs.collect()} and ("ends", 2, 5000) in got and ("unknown", 1, None) in got
    assert joins.interval_totals(s.limit(0), e, "trip", "t", "v").count() == joins.interval_totals(s, e.limit(0), "trip", "t", "v").count() == 0


def folded(visits, span=14 * D, gap=5 * D, far=300):
    """Segment of each visit by walking through its cluster."""
    out, last = {}, {}
    for v, c, t, x, y, home in sorted(visits, key=lambda v: (v[1], v[2], v[0])):
        if c not in last:
            last[c] = [0, t, t, x, y, home]
        segment, first, before, a, b, was = last[c]
        if (was != home and km(a, b, x, y) > far) or t - before > gap or t - first > span:
            segment, first = segment + 1, t
        last[c] = [segment, first, t, x, y, home]
        out[v] = segment
    return out


def test_segments_as_the_walk(spark):
    rng = random.Random(11)
    rows, v = [], 0
    for c in range(8):
        t = 0
        for _ in range(rng.choice([1, 3, 40, 120])):
            t += rng.choice([0, 0, H, D, 2 * D, 4 * D, 5 * D, 5 * D + 1])
            rows.append((v, c, t, 100.0 + rng.choice([0, 0, 4]), 30.0, rng.random() < 0.3))
            v += 1
    # steady steps of a day for years: many segments one after another, each of which decides the next
    rows += [(v + k, 99, k * D + rng.randrange(0, 3) * H, 100.0, 30.0, False) for k in range(1500)]
    df = spark.createDataFrame(rows, "visit_id bigint, c int, t bigint, lon double, lat double, home boolean")
    got = {r.visit_id: r.segment for r in sequences.boundary_split(df, "c", C("home")).collect()}
    assert got == folded(rows)


def test_home_and_cities(spark):
    rows = [("北京市", "", 0.0, 0.0), ("", "北京", 0.0, 0.0), (None, None, 116.4, 39.0), (None, None, 116.4, 38.5), ("河北", None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "province string, city string, lon double, lat double")
    # 0.9 degrees are 100 km, 1.4 are 156 km
    assert [r[0] for r in df.select(sequences.at_home(C("lon"), C("lat"), [C("province"), C("city")], "北京", (116.4, 39.9))).collect()] == [True, True, True, False, False]
    # the city falls back to the district, then to the province
    stays = [(1, 1, "p", "", "d"), (1, 2, "p", None, "d"), (2, 1, "p", "c", "d"), (2, 2, "p", "", "d"), (3, 1, "p", "", ""), (3, 2, "", "p", None), (4, 1, "", "", ""), (4, 2, None, None, None)]
    df = spark.createDataFrame([(s, n, n, 1.0, 1.0, p, c, d) for s, n, p, c, d in stays], "s int, visit_id int, t int, lon double, lat double, province string, city string, district string")
    got = {r.s: r.kind for r in sequences.trip_kind(df, ["s"], F.lit(False)).collect()}
    assert got == {1: "destination_stay", 2: "travel_route", 3: "destination_stay", 4: "destination_stay"}


def greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[4], -s[5], s[0], s[1], s[2], s[3])):
        if all(s[0] >= k[1] or k[0] >= s[1] for k in kept):
            kept.append(s)
    return kept


def test_overlaps_by_islands(spark):
    rng = random.Random(13)
    spans = {}
    for post in range(30):
        for _ in range(rng.choice([1, 5, 40])):
            a = rng.randrange(0, 60)
            s = (a, a + rng.randrange(0, 9), rng.choice("xy"), rng.choice("ab"))
            spans[post, s] = (rng.randrange(0, 3), rng.randrange(0, 5) / 4)
    rows = [(p, *s, *v, ["m"]) for (p, s), v in spans.items()]
    df = spark.createDataFrame(rows, "post_id int, start int, end int, type string, term string, priority int, confidence double, sources array<string>")
    got = sorted((r.post_id, r.start, r.end, r.type, r.term) for r in sequences.resolve_overlaps(df).where("kept").collect())
    want = sorted((p, *s[:4]) for p in range(30) for s in greedy([(*s, *v) for (q, s), v in spans.items() if q == p]))
    assert got == want
    # very many spans of one text, none of which meet: each is an island
    many = spark.range(100_000).selectExpr("1 AS post_id", "id * 3 AS start", "id * 3 + 3 AS end", "'x' AS type", "'a' AS term", "0 AS priority", "0.5D AS confidence", "array('m') AS sources")
    assert sequences.resolve_overlaps(many).where("kept").count() == 100_000


def test_crowded_cells_are_dealt_in_blocks(spark):
    rng = random.Random(19)
    rows = [(k, rng.randrange(0, 10 * D), rng.uniform(100, 102), rng.uniform(30, 31)) for k in range(80)]
    rows += [(1000 + k, 5 * D + rng.randrange(0, H), 101.0, 30.5 + rng.random() / 1000) for k in range(120)]  # most are in one cell and day
    df = spark.createDataFrame(rows, "visit_id bigint, t bigint, lon double, lat double")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and abs(a[1] - b[1]) <= D and km(*a[2:], *b[2:]) <= 50)
    for block in (10, 2000):
        assert sorted((r.left, r.right) for r in joins.st_pairs(df, 1, 50, block=block).collect()) == want
    named = df.withColumnRenamed("visit_id", "id")
    assert sorted((r.left, r.right) for r in joins.st_near(named, named, 1, 50, block=10).where("left < right").collect()) == want
    # no unit of work holds more than a few blocks of either side
    base = df.select(C("visit_id").alias("id"), F.lit(1).alias("c"))
    a, b, on = joins.dealt(base, base, ["c"], "id", 10)
    assert a.join(b, on).count() == 200 * 200
    sizes = [r["count"] for side in (a, b) for r in side.groupBy(*on).count().collect()]
    assert max(sizes) <= 25 and len(sizes) == 2 * 20 * 20


@pytest.mark.parametrize("size", [3, 10_000])
def test_pages(spark, size):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(0, 60)) for _ in range(400)] + [("c", None), ("d", 1)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(3)
    want = {}
    for k in {k for k, _ in rows}:
        values = sorted({v for x, v in rows if x == k and v is not None})
        want |= {(k, i // size): values[i : i + size] for i in range(0, len(values), size)}
    assert {(r.k, r.page): r.v for r in rollups.paged_lists(df, ["k"], "v", size).collect()} == want
    catalog = rollups.first_seen_catalog(df.withColumn("n", F.lit(1)), ["k"], ["v"], ["n"], "v", size).collect()
    assert {(r.k, r.page): r.source_posts for r in catalog} == want | {("c", 0): []}


def test_texts_by_index(spark):
    rng = random.Random(4)
    texts = [(k, "".join(rng.choice("abc é") for _ in range(rng.randrange(0, 40)))) for k in range(150)] + [(900, "aaaa"), (901, "aaa"), (902, None), (903, "ab"), (904, "😀😀😀x")]
    df = spark.createDataFrame(texts, "trip_id int, text string").withColumn("start", C("trip_id"))
    index = serve.index(df)
    for text in ("abc", "aaaa", "ab", "é a", "cabab", "AAA", "zzz", "😀😀😀", "", " "):
        want = sorted(k for k, x in texts if x is not None and text.lower() in x) if text else sorted(k for k, _ in texts)
        assert [r.trip_id for r in serve.search_trips(df, text=text, index=index).collect()] == want, text
    # the look-up reads the folders of its sequences only
    plan = serve.indexed(index, "abc")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan


def audited(spark, change=lambda name, rows: rows):
    schemas = {
        "source": "post_id int, content string", "located": "post_id int, content string, region string", "posts": "post_id int, content string, region string, n int", "mentions": "post_id int, mention_id string, start int, end int, text string, entity_id string",
        "entities": "entity_id string", "places": "place_id int, lon double, lat double", "regions": "region_id int", "visits": "visit_id int, start int, end int, post_ids array<int>, place_id int, candidate_ids array<int>, region_id int, eligibility string, method string",
        "roles": "post_id int, visit_ids array<int>", "trips": "trip_id int, start int, end int, visit_ids array<int>, route array<struct<visit_id:int>>, post_ids array<int>, theme_ids array<string>", "narratives": "trip_id int, highlight_ids array<int>, theme_ids array<string>",
        "candidates": "trip_id int, visit_id int", "contexts": "trip_id int, post_id int, visit_id int, other_trip_id int",
    }
    rows = {
        "source": [(1, "ab cd"), (2, "x"), (3, None)], "located": [(1, "ab cd", "r"), (2, "x", "r"), (3, None, None)], "posts": [(1, "ab cd", "r", 1), (2, "x", "r", 1), (3, None, None, 1)], "mentions": [(1, "m", 0, 2, "ab", "e"), (1, "n", 3, 5, "cd", "e")],
        "entities": [("e",)], "places": [(1, 100.0, 30.0), (2, -180.0, 90.0)], "regions": [(1,)], "visits": [(1, 0, 0, [1], 1, [], None, "anchor", "ok"), (2, 0, 1, [1, 2], None, [1, 2], None, "anchor", "ok"), (3, 5, 6, [3], None, None, 1, "candidate", "bad")],
        "roles": [(1, [1, 2]), (2, None), (3, [3])], "trips": [(1, 0, 5, [1, 2], [(1,), (2,)], [1, 2], ["e"])], "narratives": [(1, [2], ["e"])], "candidates": [(1, 3)], "contexts": [(1, 3, None, 1)],
    }
    tables = {n: spark.createDataFrame(change(n, list(rows[n])), s) for n, s in schemas.items()}
    return {r.check_name: (r.failures, r.examined, r.status) for r in audit.final_audit(tables, ["bad"], {"warned": tables["posts"].where("n > 5")}).collect()}


def test_audit_of_sound_tables(spark):
    got = audited(spark)
    assert set(got) == {*audit.CHECKS, "warned", "overall"} and {x[0] for x in got.values()} == {0} and {x[2] for x in got.values()} == {"pass"}
    assert (got["unique_post_ids"][1], got["mention_slices_valid"][1], got["trip_routes_valid"][1], got["warned"][1]) == (3, 2, 1, None)


def test_every_check_of_the_audit_fails(spark):
    more = {
        "source": [(9, "lost")], "located": [(3, "changed", None)], "posts": [(1, "ab cd", "r", 6), (2, "x", "r", 1)], "mentions": [(2, "o", 0, 1, "y", "e"), (2, "p", 0, 9, "x", "e"), (7, "q", 0, 1, "x", "e")],
        "places": [(3, 181.0, 0.0), (4, None, 0.0), (5, 0.0, float("nan"))],
        "visits": [(3, 9, 8, [1, 77], 66, [1, 67], 55, "anchor", "bad"), (4, 0, 0, [], None, None, None, "anchor", None), (5, 0, 0, None, None, None, None, None, None)],
        "roles": [(1, [1, 88]), (8, [89, 89])], "trips": [(1, 3, 2, [2, 3, 91], [(2,), (3,)], [1, 92], ["e", "f"]), (2, 0, 0, [4], [(4,)], None, None)],
        "narratives": [(2, [4, 1], ["g"]), (3, None, None), (1, [1], ["f"])], "candidates": [(44, 45), (None, None)], "contexts": [(46, 47, 48, 49)],
    }
    got = audited(spark, lambda name, rows: rows + more.get(name, []))
    want = {  # worked out by hand
        "post_row_counts_equal": 1, "source_values_preserved": 2, "located_values_preserved": 3, "unique_post_ids": 2, "mention_slices_valid": 3, "mention_overlap_free": 1, "place_coordinates_valid": 3, "unique_visit_ids": 1,
        "visit_references_valid": 6, "visit_times_valid": 1, "no_forbidden_fallback_route_anchors": 1, "roles_cover_all_posts": 2, "role_references_valid": 4, "unique_trip_ids": 1, "trip_references_valid": 3,
        "trip_times_valid": 1, "trip_routes_valid": 2, "narrative_ids_valid": 2, "secondary_references_valid": 6, "narratives_cover_all_trips": 1, "warned": 1,
    }
    assert {n: x[0] for n, x in got.items() if n != "overall"} == want
    assert got["warned"][2] == "warning" and got["overall"] == (sum(want.values()) - 1, None, "fail") and got["visit_times_valid"] == (1, 6, "fail")


def held(x, y, rings):
    """Even-odd rule by a ray to the east."""
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def test_cover_of_polygons(spark):
    rng = random.Random(29)

    def star(cx, cy, r, n):
        ring = [(cx + r * (0.4 + 0.6 * rng.random()) * math.cos(2 * math.pi * k / n), cy + r * (0.4 + 0.6 * rng.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]
        return [*ring, ring[0]]

    def box(x0, y0, x1, y1):
        return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]

    polygons = [(k, [star(rng.uniform(-5, 5), rng.uniform(-5, 5), rng.choice([0.3, 2, 6]), rng.choice([3, 7, 60]))]) for k in range(12)]
    polygons += [(20, [box(-8, -8, 8, 8), box(-2, -2, 2, 2), star(0, 0, 1, 9)]), (21, [box(-3, 1, 0, 2), box(4, 4, 5, 5)]), (22, [box(0, 0, 1, 1)]), (23, []), (24, [[(1.0, 1.0)]])]
    points = [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(1500)] + [(float(x), float(y)) for x in range(-9, 10) for y in range(-9, 10)] + [polygons[3][1][0][0]] * 2 + [(500.0, 0.0)]
    df = spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in polygons], "k int, rings array<array<struct<x:double,y:double>>>")
    pf = spark.createDataFrame([(n, *p) for n, p in enumerate(points)], "n int, lon double, lat double")
    want = sorted((n, k) for n, (x, y) in enumerate(points) for k, rings in polygons if held(x, y, rings))
    for size, fanout, levels in ((0.25, 4, 2), (1.0, 8, 2), (3.0, 2, 0)):
        assert sorted((r.n, r.k) for r in geo.pip_join(pf, df, size, fanout=fanout, levels=levels).collect()) == want
    assert {r.n for r in geo.pip_join(pf, df, how="left_semi").collect()} == {n for n, _ in want}
    assert {r.n for r in geo.pip_join(pf, df, how="left_anti").collect()} == {n for n in range(len(points))} - {n for n, _ in want}
    # a tile holds few of a long ring's edges, and the inside of a large polygon is made of large tiles
    ring = [(20 * math.cos(k / 500 * math.pi), 20 * math.sin(k / 500 * math.pi)) for k in range(1000)]
    one = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in [*ring, ring[0]]]])], df.schema)
    cover = geo.polygon_cover(one, "k", 0.5, 4, 2).collect()
    assert max(len(r.edges) for r in cover) <= 20 and max(len(r.ends) for r in cover) <= 4 and sum(r.level > 0 for r in cover) > 20 and len(cover) < 1500, (len(cover), sum(r.level > 0 for r in cover))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_are_normalized_and_compared_once(spark):
    df = spark.createDataFrame([("blue house", ["blue hous", "red"])], "k string, n array<string>")
    assert plan_of(df.select(text.best_name(C("k"), C("n")))).count("levenshtein(") <= 4  # its name shows them again


def test_bigrams_are_made_once_for_each_side(spark):
    df = spark.createDataFrame([("night", "nacht")], "a string, b string")
    assert plan_of(df.select(text.dice(C("a"), C("b")))).count("sequence(") <= 4


def test_python_gets_few_long_texts_at_once(spark):
    df = spark.createDataFrame([("Ａ b", ["b"])], "v string, w array<string>")
    for c in (mentions.occurrences(C("v"), C("w")), text.norm_nfkc(C("v"))):
        assert "BatchEvalPython" in plan_of(df.select(c)) and "ArrowEvalPython" not in plan_of(df.select(c))
    assert df.select(text.norm_nfkc(C("v")), text.norm_nfkd(F.lit(None).cast("string")), text.norm_nfkd(F.lit("é"))).first() == ("ab", None, "e")


def test_quantiles_with_ranges_of_odd_numbers(spark):
    values = [float(v % 13) for v in range(200)] + [1e300, -1e300, 0.5] * 9
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for ranges in (2, 3, 7, 10):
        got = rollups.quantiles(df, "x", few=2, ranges=ranges).first()
        assert (got.median, round(got.p90, 6), got["max"]) == (sorted(values)[113], round(float(np.quantile(values, 0.9)), 6), 1e300)


def test_no_side_of_pairs_passes_through_the_driver(spark):
    rows = spark.createDataFrame([(k, k * 1000, 10.0, 20.0) for k in range(9)], "visit_id long, t long, lon double, lat double")
    same = rows.withColumnRenamed("visit_id", "id")
    for df, n in ((joins.st_pairs(rows, 1, 100), 36), (joins.st_near(same, same, 1, 100), 72)):
        assert not [x for x in plan_of(df).splitlines() if "BroadcastHashJoin" in x and "Inner" in x] and df.count() == n


def test_pairs_and_their_totals_from_gathered_visits(spark, monkeypatch):
    rng = random.Random(11)
    spots = [(100.0, 30.0), (100.2, 30.1), (100.2, 30.9), (179.9, 0.0), (-179.9, 0.1)]
    times = [rng.randrange(0, 4 * D) for _ in range(30)]
    rows = [(k, rng.choice(times) if k % 3 else rng.randrange(0, 4 * D), *rng.choice(spots), k % 2) for k in range(400)]
    df = spark.createDataFrame([*rows, (900, 5, None, 30.0, 1), (901, None, 100.0, 30.0, 1)], "visit_id bigint, t bigint, lon double, lat double, g int")
    pairs = [(min(a, b)[0], max(a, b)[0], abs(a[1] - b[1]), km(*a[2:4], *b[2:4]), (a[4], b[4])) for i, a in enumerate(rows) for b in rows[:i]]
    within = {(p, q, round(gap / D, 4), round(d, 3)) for p, q, gap, d, _ in pairs if gap <= D and d <= 60}
    assert {tuple(r) for r in joins.st_pairs(df, 1, 60, digits={"gap_days": 4, "km": 3}).collect()} == within
    far = sorted((p, q) for p, q, gap, d, _ in pairs if gap <= 1.5 * D and d <= 120 and not (gap <= D and d <= 60))
    assert sorted((r.left, r.right) for r in joins.st_pairs(df, 1.5, 120, beyond=(1, 60)).collect()) == far and len(far) > 100
    for unit, block in ((1024, 2000), (7, 20)):  # all visits of a place and span in one row, and dealt over rows
        monkeypatch.setattr(joins.gathered, "__defaults__", (unit,))
        assert sorted((r.left, r.right) for r in joins.st_pairs(df, 1, 60, block=block).collect()) == sorted(x[:2] for x in within)
        got = {r.g: (r.edges, round(r.longest_km, 6)) for r in joins.st_pair_totals(df, 1, 60, "g", block=block).collect()}
        inside = {g: [d for *_, gap, d, ends in pairs if ends == (g, g) and gap <= D and d <= 60] for g in (0, 1)}
        assert got == {g: (len(ds), round(max(ds), 6)) for g, ds in inside.items()}


def test_pairs_are_made_from_a_row_for_each_place_and_span(spark):
    rows = spark.createDataFrame([(k, k * 1000, 10.0, 20.0) for k in range(60)], "visit_id long, t long, lon double, lat double")
    near = joins._units_near(joins.gathered(*joins._spans(rows, 1, "visit_id", "t", None)), 100, 2000, False)
    assert near.count() == 1 and joins.st_pairs(rows, 1, 100).count() == 60 * 59 // 2
    # what makes the pairs neither measures nor rounds, and calls no function for each
    plan = joins.st_pairs(rows, 1, 100, digits={"gap_days": 4, "km": 3})._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "ASIN" not in plan and "round" not in plan


def test_pairs_along_a_route_are_compared_by_time_only(spark):
    t = spark.createDataFrame([(1, 0, D), (1, D, 3 * D), (1, 9 * D, 9 * D)], "trip_id int, start bigint, end bigint")
    r = spark.createDataFrame([(1, 100.0, 30.0)], "trip_id int, lon double, lat double")
    p = spark.createDataFrame([(k, k * H, 100.5, 30.0) for k in range(400)], "post_id int, t bigint, lon double, lat double")
    out = joins.attach_context(t, r, p, digits=3)
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "exists" not in plan and "round" not in plan
    hours = [k for k in range(400) if k <= 96 or 192 <= k <= 240]
    assert sorted((x.trip_id, x.post_id, x.km) for x in out.collect()) == [(1, k, round(km(100.5, 30, 100, 30), 3)) for k in hours]

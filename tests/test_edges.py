"""Hand-written edge cases of FIXTURES.md section 3."""

import hashlib
import itertools
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from geotrail.functions import geo, text
from geotrail.operators import cluster, joins, mentions, profile, repair, sampling, scoring, sequences, serve
from geotrail.sources import io

C = F.col
H, D = 3_600_000_000, 86_400_000_000


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", f(C("v"))).collect())]


def test_geo_orders(spark):
    nan = float("nan")
    rows = [(116.4, 39.9), (39.9, 116.4), (80.0, 30.0), (50.0, 50.0), (200.0, 100.0), (None, 1.0), (-70.0, -120.0), (90.0, 180.0), (180.0, 90.0), (nan, nan)]
    df = spark.createDataFrame(rows, "a double, b double").select(repair.normalize_geo(C("a"), C("b")).alias("g")).select("g.*")
    got = [(r.usable, r.source_order, r.lng, r.lat, r.in_bounds, tuple(r.flags)) for r in df.collect()]
    # latitude first wherever that is possible; the other order only where it is the only one
    assert got == [
        (True, "lng_lat", 116.4, 39.9, True, ("unexpected_source_coordinate_order",)), (True, "lat_lng", 116.4, 39.9, True, ()), (True, "lat_lng", 30.0, 80.0, False, ()),
        (False, None, None, None, None, ("equal_coordinate_placeholder",)), (False, None, None, None, None, ("coordinate_out_of_global_range",)), (False, None, None, None, None, ("missing_or_unrecognized_geo",)),
        (True, "lat_lng", -120.0, -70.0, False, ()), (True, "lat_lng", 180.0, 90.0, False, ()), (True, "lng_lat", 180.0, 90.0, False, ("unexpected_source_coordinate_order",)), (False, None, None, None, None, ("coordinate_out_of_global_range",)),
    ]


def test_coordinates_in_text(spark):
    values = ["116.4，39.9", '[1.5, 2.5]', '{"geo":{"center":"3,4"}}', "x，y", None, "{}", "[5]"]
    assert column(spark, values, "string", repair.find_coordinates) == [[116.4, 39.9], [1.5, 2.5], [3.0, 4.0], None, None, None, None]


def test_json_recovery(spark):
    ok = '{"a":1,"b":"x"}'
    values = [ok, f"```json\n{ok}\n```", '{"a":1,"b":"x",}', '{"a":1,"b":"x, }"}', '{"a":1,"b":"x”}', ok + ok, "[1,2]", "", '{"a":1}', None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r.recovered for r in repair.recover_objects(df, "v", ["a", "b"]).orderBy("i").collect()]
    assert got == [ok, ok, ok, values[3], ok, None, None, None, None, None]


def states(spark, lines, kind):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    return [r.state for r in profile.field_states(df, {"x": kind}).orderBy("i").collect()]


def test_field_states(spark):
    lines = ['{"x":"a"}', "{}", '{"x":null}', '{"x":""}', '{"x":"  "}', '{"x":5}']
    assert states(spark, lines, "STRING") == ["nonempty", "missing", "null", "empty", "empty", "wrong_type"]
    assert states(spark, ['{"x":[]}', '{"x":[1]}', '{"x":{}}'], "ARRAY") == ["empty", "nonempty", "wrong_type"]


def test_classes_by_all_media_or_by_the_last(spark):
    media = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "y"), (2, 1, "x"), (3, 0, None)], "k int, i int, v string")
    posts = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "k int")
    rules = {"has_x": C("v") == "x"}, {"A": C("has_x")}
    assert {r.k: r.record_class for r in profile.classify_posts(posts, media, "k", *rules).collect()} == {1: "A", 2: "A", 3: "Q", 4: "Q"}
    assert {r.k: r.record_class for r in profile.classify_posts(posts, media, "k", *rules, last="i").collect()} == {1: "Q", 2: "A", 3: "Q", 4: "Q"}


def test_quarantine(spark):
    rows = [(1, '{"a":1}'), (2, "[1]"), (3, '{"a":'), (4, "  ")]
    good, bad = io.scan_with_quarantine(spark.createDataFrame(rows, "line_no int, line string"))
    assert [r.line_no for r in good.collect()] == [1]
    assert {(r.line_no, r.error) for r in bad.collect()} == {(2, "not_object"), (3, "malformed")}


def test_write_once_refuses(spark, tmp_path):
    df = spark.range(3)
    io.write_once(df, f"file://{tmp_path}/t")
    with pytest.raises(Exception, match="(?i)exist"):
        io.write_once(df, f"file://{tmp_path}/t")


def visits(spark, rows):
    return spark.createDataFrame(rows, "visit_id bigint, location_key string, t bigint, eligibility string, confidence double")


def test_sessions(spark):
    rows = [(1, "a", 0, "anchor", 0.5), (2, "a", 12 * H, "anchor", 0.9), (3, "a", 24 * H + 1, "anchor", 0.7), (4, "a", 25 * H, "candidate", 0.7), (5, "a", 26 * H, "anchor", 0.7), (6, "b", 5, "anchor", 0.1), (7, "b", 5, "anchor", 0.2)]
    got = {tuple(r.visit_ids) for r in sequences.gap_merge(visits(spark, rows)).collect()}
    assert got == {(1, 2), (3,), (4,), (5,), (6, 7)}


def test_segments(spark):
    stay = [(k, 1, k * 5 * D, 100.0, 30.0, 9) for k in range(4)]  # gaps of exactly 5 days; the fourth is 15 days after the first
    away = [(10, 2, 0, 100.0, 30.0, 1), (11, 2, D, 103.2, 30.0, 9), (12, 2, 2 * D, 103.3, 30.0, 9)]  # home to away over 300 km
    near = [(20, 3, 0, 100.0, 30.0, 1), (21, 3, D, 103.0, 30.0, 9)]  # less than 300 km
    df = spark.createDataFrame(stay + away + near, "visit_id bigint, place_id bigint, t bigint, lon double, lat double, province bigint")
    got = {r.visit_id: r.segment for r in sequences.boundary_split(df, "place_id", home=C("province") == 1).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 10: 0, 11: 1, 12: 1, 20: 0, 21: 0}


def test_nearest_in_time(spark):
    rows = spark.createDataFrame([(1, 100 * H), (2, 0), (3, 400 * H), (4, 172 * H + 1), (5, 172 * H)], "k int, t bigint")
    anchors = spark.createDataFrame([(90, 90 * H), (110, 110 * H), (100, 244 * H + 1)], "a int, t bigint")
    got = {r.k: (r.anchor_a, r.anchor_hours) for r in joins.nearest_asof(rows, anchors, "t", 72 * H, ["a"]).collect()}
    assert got == {1: (90, 10.0), 2: (None, None), 3: (None, None), 4: (110, 62.0), 5: (110, 62.0)}


def test_clusters_follow_the_definition(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(0, 40 * D), rng.uniform(100, 101), rng.uniform(30, 31)) for k in range(70)]
    df = spark.createDataFrame(rows, "visit_id bigint, t bigint, lon double, lat double")
    edges = cluster.neighbor_rule(df, (2, 40)).collect()
    beside = {k: set() for k, *_ in rows}
    for e in edges:
        beside[e.left].add(e.right)
        beside[e.right].add(e.left)
    order = [k for k, *_ in sorted(rows, key=lambda r: (r[1], r[0]))]
    for least in (2, 3, 4):
        label, n = {}, 0
        cores = {k for k in order if len(beside[k]) >= least - 1}
        for k in order:
            if k in cores and k not in label:
                todo = [k]
                while todo:
                    x = todo.pop()
                    if label.setdefault(x, n) == n:
                        todo += [y for y in beside[x] & cores if y not in label]
                n += 1
        for k in order:
            if k not in cores:
                label[k] = min((label[y] for y in beside[k] & cores), default=None)
        got = {r.visit_id: r.cluster for r in cluster.st_dbscan(df, cluster.neighbor_rule(df, (2, 40)), least).collect()}
        assert got == label


def test_overlapping_spans(spark):
    rows = [
        (1, 0, 5, "x", "a", 0, 0.5, ["m"]), (1, 1, 3, "x", "b", 0, 0.9, ["m"]), (1, 5, 8, "x", "c", 0, 0.5, ["m"]), (2, 0, 4, "y", "d", 1, 0.9, ["m"]), (2, 0, 4, "x", "e", 0, 0.1, ["m"]),
        (3, 0, 3, "x", "f", 0, 0.5, ["m"]), (3, 2, 6, "x", "g", 0, 0.5, ["m"]), (3, 5, 8, "x", "h", 0, 0.5, ["m"]), (4, 0, 2, "x", "i", 0, 0.2, ["n"]), (4, 0, 2, "x", "i", 0, 0.7, ["m", "n"]),
    ]
    df = spark.createDataFrame(rows, "post_id int, start int, end int, type string, term string, priority int, confidence double, sources array<string>")
    got = sequences.resolve_overlaps(df)
    assert {r.term for r in got.where("kept").collect()} == {"a", "c", "e", "g", "i"}
    assert [(r.confidence, r.sources) for r in got.where("post_id = 4").collect()] == [(0.7, ["m", "n"])]
    assert {r.post_id: (r.n_kept, r.n_rejected) for r in sequences.overlap_counts(got).collect()} == {1: (2, 1), 2: (1, 1), 3: (1, 2), 4: (1, 0)}


def bigram_score(a, b):
    a, b = a.lower(), b.lower()
    short, long = sorted((len(a), len(b)))
    if a in b or b in a:
        return 1 if a == b else max(short / long, 0.65 if short >= 3 else 0.5 if short == 2 else 0)
    x, y = (Counter(t[k : k + 2] for k in range(len(t) - 1)) for t in (a, b))
    return 2 * (x & y).total() / (x.total() + y.total()) if short > 1 else 0


def test_mentions_against_brute_force(spark):
    rng = random.Random(6)
    words = ["noodle", "noodle bar", "bar", "soup", "old town", "town", "noodle soup", "tea", "T ea", "ＴＥＡ", "x", "a\\Eb", "a.b", "(b)"]
    posts = [(k, " ".join(rng.choice([*words, "and", "the"]) for _ in range(rng.randrange(0, 30)))) for k in range(40)] + [(90, ""), (91, None)]
    sources = [(k, rng.choice(["restaurant", "dish", "region", "weather"]), rng.choice([*words, " soup "]), rng.choice(["label", "review"]), rng.randrange(100) / 100) for k, _ in posts for _ in range(8)]
    points = [(k, 10 * k + i, rng.choice(words).title() + rng.choice(["", "（东门店）", " (a bracket that is far too long)"]), rng.choice(["0501", "1101", None]), rng.choice(["咖啡店", "shop", None]), rng.choice(["restaurant", None])) for k in range(40) for i in range(4)]
    points += [(0, None, "noodle", "0501", None, None)]
    schema = ("post_id int, content string", "post_id int, type string, term string, source string, confidence double", "post_id int, poi_id int, name string, typecode string, type string, extraction_kind string")
    df = [spark.createDataFrame(r, s) for r, s in zip((posts, sources, points), schema)]

    def plain(name):
        return "".join(unicodedata.normalize("NFKC", name).lower().split())

    def alike(name):
        return "".join(c for c in re.sub(r"[（(][^（）()]{0,20}[）)]$", "", plain(name)) if c.isalnum())

    def restaurant(p):
        return p[1] is not None and ((p[3] or "").startswith("05") or "咖啡" in (p[4] or "") or p[5] == "restaurant")

    want, records = [], []
    for k, content in posts:
        content, terms = content or "", {}
        for p, kind, term, source, confidence in sources:
            term = term.strip()
            if p == k and kind in mentions.PRIORITY and len(term) >= 2 and term in content and not (kind == "restaurant" and plain(term) == "tea"):
                seen, best = terms.get((kind, term), (set(), 0))
                terms[kind, term] = (seen | {source}, max(best, confidence))
        spans = []
        for (kind, term), (seen, confidence) in terms.items():
            at = content.find(term)
            while at >= 0:
                spans.append((-len(term), mentions.PRIORITY[kind], -confidence, at, at + len(term), kind, term, sorted(seen)))
                at = content.find(term, at + len(term))
        kept = []
        for s in sorted(spans):
            if all(s[4] <= o[3] or o[4] <= s[3] for o in kept):
                kept.append(s)
        records.append((k, len(terms), len(kept), len(spans) - len(kept)))
        for _, _, c, start, end, kind, term, seen in kept:
            entity = f"ent_{kind}_" + hashlib.sha256(f"{kind}\0{plain(term)}".encode()).hexdigest()[:16]
            ids = sorted({q[1] for q in points if q[0] == k and restaurant(q) and alike(term) and alike(q[2]) and bigram_score(alike(term), alike(q[2])) >= 0.45}) if kind == "restaurant" else []
            status = ("unmatched", "unique_high", "multiple")[min(2, len(ids))] if kind == "restaurant" else "entity"
            mention = "mention_" + hashlib.sha256(f"{k}\0{start}\0{end}\0{entity}".encode()).hexdigest()[:16]
            want.append((k, start, end, kind, term, seen, -c, entity, mention, status, ids))
    got = mentions.build_mentions(*df, ["tea"]).collect()
    assert len(want) > 100 and {s[9] for s in want} == {"unmatched", "unique_high", "multiple", "entity"} and sorted(map(tuple, got)) == sorted(want)
    assert sorted(map(tuple, mentions.extraction_records(df[0], df[1], ["tea"]).collect())) == records


def test_reviewed_terms(spark):
    rows = [(1, "Ｔea House", ["review"]), (1, "soup", ["text_llm_exact_candidate", "review"]), (1, "bar", ["review"]), (2, "tea house", ["review"]), (3, "tea house", ["selected_amap_poi_name"])]
    terms = spark.createDataFrame(rows, "post_id int, term string, sources array<string>")
    reviews = spark.createDataFrame([(1, True, ["TEA HOUSE"]), (2, False, ["tea house"]), (3, True, [])], "post_id int, valid boolean, discarded array<string>")
    # post 1 has a valid review: the discarded term goes whatever its width and case, and so does what no trusted source names
    assert {(r.post_id, r.term) for r in mentions.authoritative_terms(terms, reviews).collect()} == {(1, "soup"), (2, "tea house"), (3, "tea house")}


def test_repeated_terms(spark):
    rows = [("aaaa", ["aa"]), ("a.b a+b", ["a.b"]), ("😀x😀x", ["x", "😀x", "x😀"]), ("abc", ["z", "", None]), (None, ["a"]), ("a", []), (r"a\Eb and a\Eb", [r"a\Eb", "\\", "[a-z]", "$", "a\\E"]), ("abcabc", ["abc", "bca", "c", "abcabc"])]
    df = spark.createDataFrame(rows, "v string, w array<string>")
    got = [r[0] for r in df.select(mentions.occurrences(C("v"), C("w"))).collect()]

    def find(text, term):
        out, at = [], text.find(term) if term else -1
        while at >= 0:
            out.append(at)
            at = text.find(term, at + len(term))
        return out

    assert got == [[find(v or "", t or "") for t in w] for v, w in rows] and got[6][0] == [0, 9]
    # every sign that means something in a pattern, as a term of a post
    signs = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
    posts = spark.createDataFrame([(1, "".join(f"{c}{c} " for c in signs))], "post_id int, content string")
    found = mentions.locate_terms(posts, spark.createDataFrame([(1, c * 2) for c in signs], "post_id int, term string")).collect()
    assert {r.term: (r.start, r.end) for r in found} == {c * 2: (3 * k, 3 * k + 2) for k, c in enumerate(signs)}


def test_names(spark):
    assert column(spark, ["Ｃafé É!", "ﬁ ①", None], "string", text.norm_nfkd) == ["cafee", "fi1", None]
    assert column(spark, ["Ａ b。C", "x\ty"], "string", lambda c: text.norm_nfkc(c, True)) == ["abc", "xy"]
    names = ["北京饭店", "面(东门店)", "面（王府井商场）", "面 (north)", "面总店", "面旗舰店", "面直营店", "面第12分店", "面分店", "面店", "(店)面", None]
    assert column(spark, names, "string", text.base_name) == ["北京饭店", "面", "面", "面 (north)", "面", "面", "面", "面", "面", "面店", "(店)面", None]
    plain = ["面旗舰店", "面总店", "面分店", "面新店", "面老店", "面店", "北京饭店", "面馆", "好火锅", "小馆店", "面直营店"]
    assert column(spark, plain, "string", text.base_of_normalized) == ["面", "面", "面", "面", "面", "面", "北京饭", "", "好", "", "面直营"]
    df = spark.createDataFrame([("", ""), ("ab", "ab"), ("ab", "abcd"), ("abcd", "abxd"), ("", "a")], "a string, b string")
    assert [r[0] for r in df.select(text.edit_similarity(C("a"), C("b"))).collect()] == [0.0, 1.0, 0.5, 0.75, 0.0]
    assert [round(r[0], 3) for r in df.select(text.contain_similarity(C("a"), C("b"))).collect()] == [0.0, 1.0, 0.85, 0.75, 0.0]


def test_titles(spark):
    may = 1_590_000_000_000_000
    rows = [(1, "x", may), (2, "x", may + 30 * D), (3, "y", may), (4, "z", may), (5, "z", may + D)]
    df = spark.createDataFrame(rows, "k int, title string, t bigint")
    got = {r.k: r.final_title for r in sequences.unique_titles(df, "title", "k", "t").collect()}
    assert got == {1: "x (2020-05)", 2: "x (2020-06)", 3: "y", 4: "z (2020-05)", 5: "z (2020-05) #5"}


def test_score_parts(spark):
    df = spark.createDataFrame([(0.98765, True, True, True, 1), (0.98765, False, True, False, 2), (0.5, False, False, False, 21), (1.0, True, True, True, 22)], "s double, r boolean, a boolean, t boolean, k int")
    parts = scoring.score_parts(C("s"), C("r"), C("a"), C("t"), C("k"))
    got = [(tuple(round(x, 6) for x in r[0]), r[1]) for r in df.select(parts, scoring.score(parts)).collect()]
    # the first of a source has all 3 points, the second 2.85, and the 21st none; 60 * 0.98765 = 59.259 is 59.26 on its own
    assert got == [((59.26, 12.0, 15.0, 8.0, 3.0), 97.26), ((59.26, 0.0, 15.0, 0.0, 2.85), 77.11), ((30.0, 0.0, 0.0, 0.0, 0.0), 30.0), ((60.0, 12.0, 15.0, 8.0, 0.0), 95.0)]


def test_second_pass(spark):
    near, default = "temporal_neighbor", "global_default"
    rows = [
        # found, kind, similarity, query, name, typecode, text, method, km, reason worked out by hand
        (False, "restaurant", 0.99, "a", "a", "0501", "a", None, None, "no_resolved_candidate"),
        (True, "address", 0.99, "a", "a", None, "some street", default, None, "address_conflicts_with_existing_context"),
        (True, "address", 0.99, "a", "a", None, "北京 street", default, None, "passed_strict_filter"),
        (True, "address", 0.1, "abcd", "a", None, "x", near, 300.1, "address_conflicts_with_existing_context"),
        (True, "address", 0.8, "a", "a", None, "x", near, 300.0, "passed_strict_filter"),
        (True, "address", 0.8, "a", "a", None, "x", "scored", 900.0, "passed_strict_filter"),
        (True, "restaurant", 0.78, "a", "a", "0501", "x", near, 900.0, "passed_strict_filter"),  # only addresses have a context
        (True, "restaurant", 0.77, "abcd", "a", "9901", "x", None, None, "stricter_name_threshold"),  # before dropped text and type
        (True, "market", 0.75, "a", "a", "1201", "x", None, None, "passed_strict_filter"),
        (True, "other", 0.81, "a", "a", None, "x", None, None, "stricter_name_threshold"),
        (True, "hotel", 0.79, "a", "a", None, "x", None, None, "stricter_name_threshold"),
        (True, "hotel", 0.8, "a", "a", None, "x", None, None, "passed_strict_filter"),  # a kind without prefixes takes any type
        (True, "restaurant", 0.96, "abcd", "ab", "0501", "x", None, None, "candidate_drops_distinctive_query_text"),
        (True, "restaurant", 0.96, "abc", "ab", "0501", "x", None, None, "passed_strict_filter"),  # two of three letters are kept
        (True, "restaurant", 0.96, "xy", "ab", "0501", "x", None, None, "passed_strict_filter"),  # the query doesn't hold the name
        (True, "restaurant", 0.96, "a", None, "0501", "x", None, None, "candidate_drops_distinctive_query_text"),
        (True, "restaurant", 0.94, "a", "a", "9901", "x", None, None, "poi_type_incompatible"),
        (True, "restaurant", 0.94, "a", "a", None, "x", None, None, "poi_type_incompatible"),
        (True, "restaurant", 0.95, "a", "a", "9901", "x", None, None, "passed_strict_filter"),
        (True, "attraction", None, "a", "a", "1401", "x", None, None, "stricter_name_threshold"),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, found boolean, kind string, s double, q string, n string, code string, text string, method string, km double, want string")
    r = scoring.strict_filter(C("found"), scoring.context_conflict(C("kind"), C("text"), C("method"), C("km")), C("kind"), C("s"), C("q"), C("n"), C("code"))
    got = df.select("k", r.alias("r")).orderBy("k").collect()
    assert [x.r.reason for x in got] == [x[-1] for x in rows] and all(x.r.accepted == (x.r.reason == "passed_strict_filter") for x in got)


def test_eligibility(spark):
    rows = [
        # method, confidence, points, set, time, id, kind, status; outcome worked out by hand
        ("explicit_region_geocode", 0.9, 1, False, "contemporaneous", "B1", None, None, "region_only", "region", ["region_level_only"]),
        ("source_geo", 0.7, 1, False, "contemporaneous", None, None, None, "anchor", "source_coordinate", []),
        ("source_geo", 0.69, 1, False, "past", None, None, None, "candidate", "source_coordinate", ["visit_time_uses_post_timestamp"]),
        ("amap_deterministic", 0.9, 2, False, "recent_relative", "B1", None, None, "candidate", "candidate_set", ["ambiguous_place_candidates"]),
        ("amap_deterministic", 0.9, 1, True, "recent_relative", "B1", None, None, "candidate", "poi", ["ambiguous_place_candidates"]),
        ("amap_multiple_candidates", 0.9, 1, None, "recent_relative", "", "Address", None, "anchor", "address", []),
        ("explicit_location_amap", 0.9, 1, False, None, None, None, "address_level", "anchor", "address", ["visit_time_uses_post_timestamp"]),
        ("ip_region_centroid", 0.99, 1, False, "contemporaneous", None, "x", "y", "candidate", "point", []),
        (None, None, 1, False, "contemporaneous", None, None, None, "candidate", "point", []),
        ("explicit_region_geocode", 0.9, 2, True, None, None, None, None, "region_only", "region", ["ambiguous_place_candidates", "region_level_only", "visit_time_uses_post_timestamp"]),
    ]
    df = spark.createDataFrame([(k, *r[:8]) for k, r in enumerate(rows)], "k int, m string, c double, n int, s boolean, t string, i string, y string, z string")
    got = df.select("k", scoring.eligibility(*(C(x) for x in "mcnstiyz")).alias("e")).orderBy("k").select("e.*").collect()
    assert [tuple(r) for r in got] == [r[8:] for r in rows]
    weights = spark.createDataFrame([("source_geo",), ("unheard_of",), (None,)], "m string").select(scoring.visit_confidence(F.lit(0.9), F.lit(0.80004), C("m")))
    assert [r[0] for r in weights.collect()] == [0.78, 0.5, 0.5]


def test_first_leg_has_no_length(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (2, 1, 50.0, 50.0)], "g int, t int, lon double, lat double")
    assert [r.km is None for r in geo.legs(df, "g", ["t"]).orderBy("g", "t").collect()] == [True, False, True]
    assert {r.g: (round(r.km, 1), r.points) for r in geo.route_length(df, "g", ["t"]).collect()} == {1: (111.2, 2), 2: (0.0, 1)}
    assert geo.long_legs(df, "g", ["t"], "t", 100.0).count() == 1


def test_distance_bands(spark):
    rows = [(1, True, 0.8, 499.0), (1, True, 0.79, 1.0), (2, True, 0.9, 500.0), (3, True, 0.9, 2000.0), (4, True, 0.9, None), (5, False, 0.9, 10.0), (6, True, 0.5, 10.0), (7, None, 0.9, 10.0)]
    df = spark.createDataFrame(rows, "k int, has_source boolean, name_similarity double, distance_m double")
    got = {r.k: (r.best_m, r.status) for r in geo.distance_bands(df, "k").collect()}
    none = (None, "no_name_supported_candidate")
    assert got == {1: (499.0, "aligned_under_500m"), 2: (500.0, "near_500m_to_2km"), 3: (2000.0, "conflict_over_2km"), 4: none, 5: (None, "unavailable"), 6: none, 7: (None, "unavailable")}


def test_decisions(spark):
    # request: (generic, context, [(score, similarity), ...]), with the outcome worked out by hand from the rules
    cases = {
        1: (False, True, [(95, 0.95), (86, 0.8)], "auto_accept", [0]),
        2: (False, True, [(95, 0.95), (88, 0.8)], "needs_review", [0]),  # margin below 8, and only one within 6 points
        3: (False, True, [(90, 0.8), (85, 0.76)], "multiple", [0, 1]),  # margin below 6
        4: (False, True, [(50, 0.47)], "no_match", []),
        5: (False, True, [(80, 0.75)], "needs_review", [0]),
        6: (True, True, [(95, 0.95)], "rejected", []),
        7: (False, True, [], "no_match", []),
        8: (False, False, [(90, 0.95), (84, 0.8)], "multiple", [0, 1]),  # no context, though the margin is 6
        9: (False, True, [(90, 0.95), (84, 0.8)], "needs_review", [0, 1]),  # context and a margin of 6, but not of 8
        10: (False, True, [(37.9, 0.99)], "no_match", []),  # score below 38
        11: (False, True, [(61, 0.95), (50, 0.9)], "needs_review", [0]),  # score below 62
        12: (False, False, [(62, 0.9), (54, 0.9)], "auto_accept", [0]),
        13: (False, True, [(60, 0.5)], "needs_review", []),  # not credible, yet not too unlike
        14: (False, False, [(80, 0.8)] * 7, "multiple", [0, 1, 2, 3, 4]),
    }
    rows = [(k, i, float(s), n, i + 1) for k, c in cases.items() for i, (s, n) in enumerate(c[2])]
    df = scoring.rank(spark.createDataFrame(rows, "request_id int, poi_id int, score double, name_similarity double, source_rank int"), "request_id")
    requests = spark.createDataFrame([(k, c[0], c[1]) for k, c in cases.items()], "request_id int, generic boolean, has_context boolean")
    decided = scoring.decide(df, requests, "request_id")
    assert {r.request_id: (r.status, r.selected_ids) for r in decided.collect()} == {k: (c[3], c[4]) for k, c in cases.items()}
    conflicts = C("request_id").isin(1, 3, 5)
    assert {r.request_id for r in scoring.needs_review(decided, conflicts).collect()} == {1, 2, 3, 4, 5, 9, 10, 11, 13}


def test_name_scores(spark):
    # worked out by hand: equal bases count 1 by their own edit similarity, one base in the other 0.72 + 0.18 x ratio, else the better edit similarity
    cases = [
        ("noodle bar", ["Noodle Bar"], 1.0, "exact"), ("noodle bar", ["Noodle Bar (North店)"], 1.0, "same_base"), ("noodle", ["noodle bars"], 0.72 + 0.18 * 6 / 11, "contains"),
        ("a", ["ab"], 0.5, "edit"), ("noodle总店", ["noodlx"], 5 / 6, "base_edit"), ("xy", ["ab"], 0.0, "none"), ("xy", [], 0.0, "none"), ("xy", [None, " ", "xz"], 0.5, "edit"),
    ]
    df = spark.createDataFrame([(i, k, n) for i, (k, n, *_) in enumerate(cases)], "i int, k string, n array<string>")
    got = [r.m for r in df.orderBy("i").select(text.best_name(C("k"), C("n")).alias("m")).collect()]
    assert [(round(m.score, 9), m.kind) for m in got] == [(round(s, 9), k) for *_, s, k in cases]
    pairs = [("abc", "abcdef", 0.65), ("abc", "abcd", 0.75), ("ab", "abcdef", 0.5), ("a", "abcd", 0.25), ("a", "b", 0.0), ("abcd", "abxd", 1 / 3), ("", "a", 0.0), ("aaaa", "aaab", 2 / 3)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string, w double").select(text.dice(C("a"), C("b"))).collect()]
    assert got == pytest.approx([w for *_, w in pairs])
    kinds = [("food", "050100", "x", True), ("food", "060100", "a food hall", True), ("food", "060100", "x", False), ("food", None, None, False), ("other", "1", "x", True)]
    df = spark.createDataFrame(kinds, "k string, c string, t string, w boolean")
    assert [r[0] for r in df.select(text.type_compat(C("k"), C("c"), C("t"), {"food": ("05", "food")})).collect()] == [w for *_, w in kinds]


def test_polygon_with_hole_and_parts(spark):
    rect = lambda *v: geo.rectangle(*map(F.lit, v))
    rings = F.array(rect(0, 0, 10, 10), rect(4, 4, 6, 6), rect(20, 0, 22, 2))
    points = [(1.0, 1.0), (5.0, 5.0), (21.0, 1.0), (15.0, 1.0), (0.0, 0.0), (10.0, 5.0)]
    df = spark.createDataFrame(points, "lon double, lat double").select(geo.in_rings(C("lon"), C("lat"), rings))
    assert [r[0] for r in df.collect()] == [True, False, True, False, True, False]


def test_shortest_order_against_all_permutations(spark):
    rng = random.Random(3)
    groups = {g: [(k, rng.uniform(100, 102), rng.uniform(30, 32)) for k in range(1 + g % 7)] for g in range(9)}
    df = spark.createDataFrame([(g, *n) for g, ns in groups.items() for n in ns], "g int, node bigint, lon double, lat double")
    km = {}
    pairs = [(g, a[0], b[0], a[1], a[2], b[1], b[2]) for g, ns in groups.items() for a in ns for b in ns]
    for r in spark.createDataFrame(pairs, "g int, a bigint, b bigint, p double, q double, r double, s double").withColumn("km", geo.haversine(C("p"), C("q"), C("r"), C("s"))).collect():
        km[r.g, r.a, r.b] = r.km
    got = {r.g: r.km for r in serve.shortest_order(df, "g").collect()}
    for g, ns in groups.items():
        best = min(sum(km[g, a, b] for a, b in zip(p, p[1:])) for p in itertools.permutations([n[0] for n in ns]))
        assert got[g] == pytest.approx(best)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "visit_id bigint, location_key string, t bigint, eligibility string, confidence double, lon double, lat double, province bigint")
    assert sequences.gap_merge(empty).count() == 0
    assert joins.st_pairs(empty, 1, 10).count() == 0
    assert cluster.st_dbscan(empty, joins.st_pairs(empty, 1, 10)).count() == 0
    assert joins.nearest_asof(empty, empty, "t", H, ["visit_id"]).count() == 0
    assert sampling.stratified_sample(empty, ["location_key"], 2, "s", "visit_id").count() == 0


def test_same_rows_whatever_the_partitions(spark):
    rng = random.Random(7)
    rows = [(k, f"p{rng.randrange(9)}", rng.randrange(0, 90 * D), rng.choice(["anchor", "candidate"]), 0.5) for k in range(400)]
    results = []
    for n in ("1", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(str, sequences.gap_merge(visits(spark, rows).repartition(int(n))).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]

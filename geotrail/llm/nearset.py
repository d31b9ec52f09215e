"""Near-duplicate documents by a chosen-path similarity join.

Documents of equal shingle sets are one class. A class stands for its minwise tokens, the least hash of its set under
each of WIDTH functions. A tree branches the classes by some of these tokens: those that agree in a token share a child
node. Nodes with few members are compared exhaustively; larger ones branch again, by tokens that depend on the path. A
node that stays large after DEPTH branchings is a leaf. Independent trees raise the recall: a pair of similarity 0.75 is
parted by one tree with probability 0.07 at the first branching, 0.19 by the second and 0.34 by the third, hence by all
eight with less than 1e-9, 2e-6 and 2e-4; more alike pairs far more rarely.

Candidates are confirmed on full sets, the most promising of each class first; candidates whose ends are already
connected need no confirmation, as only what is reachable counts. Members of a leaf first meet its pivot in this way,
which connects copies that are all alike. Leaves whose members are then not all connected are cut into blocks, and any two
of their blocks are compared on full sets, every member with every other, unless all members of both are connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64
from .graph import components, joined

#: Words of a shingle; minwise tokens of a class; trees; tokens of a tree at its first branching; branchings; small node.
WORDS, WIDTH, TREES, FIRST, DEPTH, SMALL = 5, 128, 8, 2, 3, 24
#: Links need 100 * intersection >= PERCENT * union. Estimates this far below are no candidates: over 6 deviations.
PERCENT, DOUBT = 75, 0.25
#: Shingles in a block of a leaf, and what a class counts for at least (so many classes in a block at most: the ratio).
BLOCK, LEAST = 2**19, 2**9

_RNG = np.random.default_rng(9)
_PLACES = _RNG.integers(0, 2**63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted fingerprints of the distinct shingles of a whole text. Only A-Z are lower-cased; words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = pd.util.hash_array(np.array(words, object), categorize=False)
    n = max(1, len(w) - WORDS + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(w))):
        total += w[k : k + n] * _PLACES[k]
    total = np.sort(mix64(total + _PLACES[WORDS : WORDS + 1] * np.uint64(min(WORDS, len(w)))))
    first = np.concatenate([[True], total[1:] != total[:-1]])
    return total if first.all() else total[first]


def minwise(s: np.ndarray) -> np.ndarray:
    """WIDTH tokens of a set that is not empty, as signed 32-bit integers."""
    low = np.full(WIDTH, 2**64 - 1, np.uint64)
    for k in range(0, len(s), 2048):
        np.minimum(low, (s[k : k + 2048, None] * _FACTORS).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def described(docs: DataFrame, id_col: str, text_col: str, with_sha: bool = False) -> DataFrame:
    """(id, text_hash, n_shingles, key, tokens): key identifies the set; it and the tokens are null where there is no word. With text_sha256 on demand."""
    kind = dict(docs.dtypes)[id_col]

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, text in zip(pdf["row"], pdf["text"], strict=True):
                s = shingles(text)
                out.append((name, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, minwise(s) if len(s) else None))
            described = pd.DataFrame(out, columns=["row", "n_shingles", "key", "tokens"])
            yield described.assign(**{c: pdf[c].to_numpy() for c in carried})

    rows = docs.select(F.col(id_col).cast("string").alias("row"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    if with_sha:
        rows = rows.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    carried = ["text_hash", *(["text_sha256"] if with_sha else [])]
    out = rows.mapInPandas(describe, "row string, n_shingles long, key binary, tokens array<int>, text_hash long" + ", text_sha256 string" * with_sha)
    return out.select(F.col("row").cast(kind).alias(id_col), "n_shingles", "key", "tokens", *carried)


def _branch(members: DataFrame, paths: Column, tokens: int) -> DataFrame:
    """(node, id): the children of each member (id, tokens) on all its paths, by minwise tokens whose places the path chooses. A child is one row, which leaves the tokens behind."""

    def child(path: Column, k: int) -> Column:
        place = (F.pmod(F.xxhash64(path, F.lit(k)), F.lit(WIDTH)) + 1).cast("int")
        return F.xxhash64(path, F.lit(k), F.element_at("tokens", place))

    children = F.flatten(F.transform(paths, lambda path: F.array(*[child(path, k) for k in range(tokens)])))
    return members.select(F.explode(children).alias("node"), "id")


def _gathered(members: DataFrame, *of: DataFrame) -> DataFrame:
    """(id, nodes) of members (node, id) with the columns that of have for the ids; what is not in the later ones has nulls."""
    known = members.groupBy("id").agg(F.collect_list("node").alias("nodes")).join(of[0], "id")
    for more in of[1:]:
        known = known.join(more, "id", "left")
    return known


def _once(members: DataFrame, *of: DataFrame) -> DataFrame:
    """members (node, id) with the columns that of have for their ids. An id meets them once, however many nodes it is in; what is not in the later ones has nulls."""
    return _gathered(members, *of).withColumn("node", F.explode("nodes")).drop("nodes")


def candidates(classes: DataFrame, trees: int = TREES, depth: int = DEPTH, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b), a < b: pairs of (id, tokens) that the trees bring together; (node, id): members of the leaves.

    Of the pairs within a leaf only those with its pivot are among the first.
    """
    roots = F.array(*[F.xxhash64(F.lit("tree"), F.lit(t)) for t in range(trees)])
    children, found = _branch(classes.select("id", "tokens"), roots, FIRST), []
    for step in range(depth):
        children = materialize(children)  # nodes and members are both made of them
        nodes = materialize(children.groupBy("node").agg(F.count("*").alias("size"), F.min_by("id", F.xxhash64("id", "node")).alias("pivot")).where("size > 1"))
        members = materialize(children.join(nodes, "node"))
        lists = members.where(F.col("size") <= small).groupBy("node").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        ids = lists.select("ids").distinct().select("ids", F.explode("ids").alias("a"))
        found.append(ids.select("a", F.explode(F.filter("ids", lambda x: x > F.col("a"))).alias("b")))
        large = members.where(F.col("size") > small)
        if step == depth - 1 or not nodes.where(F.col("size") > small).limit(1).collect():
            found.append(large.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")))
            leaves = large.select("node", "id")
            break
        paths = F.transform("nodes", lambda node: F.xxhash64(F.lit("path"), node))
        children = _branch(_gathered(large, classes.select("id", "tokens")), paths, 1)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return materialize(out.distinct()), leaves


def _promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, agree): the pairs whose sizes allow a link and whose tokens agree often enough, with how often they do."""
    of = classes.select("id", "tokens", "n")
    x = of.select(F.col("id").alias("a"), F.col("tokens").alias("ta"), F.col("n").alias("na"))
    y = of.select(F.col("id").alias("b"), F.col("tokens").alias("tb"), F.col("n").alias("nb"))
    both = pairs.join(x, "a").join(y, "b").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    agree = F.aggregate(F.zip_with("ta", "tb", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    return both.select("a", "b", agree.alias("agree")).where(F.col("agree") >= int(WIDTH * (PERCENT / 100 - DOUBT)))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for pdf in batches:
            keep = []
            for a, x, y in zip(pdf["a"], pdf["x"], pdf["y"], strict=True):
                if a != last:
                    last, held = a, shingles(x)
                keep.append(linked(held, shingles(y), percent))
            yield pdf.loc[keep, ["a", "b"]]

    x = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").mapInPandas(confirm, "a long, b long")


def _links(pairs: DataFrame, texts: DataFrame, rounds: int) -> DataFrame:
    """(node, label) of the classes that confirmed links connect. Every pair is confirmed, or its ends are connected without it.

    In each round every class has its most promising open pair confirmed; what is then still open between different
    components is confirmed at once.
    """
    labels, open_pairs = None, pairs
    for step in range(rounds + 1):
        chosen = open_pairs
        if step < rounds:
            ends = open_pairs.select(F.col("a").alias("end"), "a", "b", "agree").unionByName(open_pairs.select(F.col("b").alias("end"), "a", "b", "agree"))
            best = F.max(F.struct("agree", F.xxhash64("a", "b").alias("h"), "a", "b")).alias("best")
            chosen = ends.groupBy("end").agg(best).select("best.a", "best.b").distinct()
        new = materialize(confirmed(materialize(chosen.select("a", "b")), texts))
        labels = components(new if labels is None else joined(labels, new))
        if step == rounds:
            break
        rest = open_pairs.join(materialize(chosen.select("a", "b")), ["a", "b"], "left_anti")
        la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        rest = rest.join(la, "a", "left").join(lb, "b", "left").where("la is null or lb is null or la <> lb")
        open_pairs = materialize(rest.select("a", "b", "agree"))
        if not open_pairs.limit(1).collect():
            break
    return labels


def _connected(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """For every set of a and then of b a number that all have in common whom links between a and b connect."""
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    both = np.zeros((len(a), len(b)))

    def held_by(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(part)), np.float32)
        for row, s in zip(out, sets, strict=True):
            row[np.searchsorted(part, s[np.isin(s, part, assume_unique=True)])] = 1
        return out

    for k in range(0, len(shared), 4096):
        part = shared[k : k + 4096]
        both += held_by(a, part) @ held_by(b, part).T
    na, nb = (np.array([len(s) for s in x], np.float64) for x in (a, b))
    links = 100 * both >= percent * (na[:, None] + nb - both)
    of_a, of_b = np.arange(len(a)), np.arange(len(a), len(a) + len(b))
    far = len(a) + len(b)
    while True:
        new_b = np.minimum(of_b, np.where(links, of_a[:, None], far).min(axis=0))
        new_a = np.minimum(of_a, np.where(links, new_b, far).min(axis=1))
        if (new_a == of_a).all() and (new_b == of_b).all():
            return np.concatenate([of_a, of_b])
        of_a, of_b = new_a, new_b


def _blocked(members: DataFrame, texts: DataFrame, block: int, percent: int) -> DataFrame:
    """(a, b): links that connect whatever full sets connect within each node of members (node, id, n, label)."""
    weight, size = F.greatest("n", F.lit(max(1, block * LEAST // BLOCK))), F.floor(F.log2("n")).alias("size")
    weights = materialize(members.groupBy("node", "label", size).agg(F.sum(weight).alias("weight")))
    own = weights.groupBy("node", "label").agg(F.sum("weight").alias("own"))
    # what is connected and fills a block stays together, the rest of a node is dealt by size; no task sees a node whole
    weights = weights.join(own, ["node", "label"]).withColumn("part", F.when(F.col("own") < block, -1).otherwise(F.col("label")))
    parts = weights.groupBy("node", "part", "size").agg(F.ceil(F.sum("weight") / block).alias("parts"))
    placing = weights.join(parts, ["node", "part", "size"]).select("node", "label", "size", "part", "parts")
    rows = members.withColumn("size", size).join(placing, ["node", "label", "size"])
    rows = materialize(rows.select("node", "id", "n", F.col("part").alias("label"), F.xxhash64("part", "size", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")))
    blocks = rows.groupBy("node", "block").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("label", "n") for f in (F.min, F.max)])
    i, j = (blocks.select("node", *[F.col(c).alias(f"{side}_{c}") for c in blocks.columns[1:]]) for side in "ij")
    done = F.expr("i_min_label >= 0 and i_min_label = i_max_label and j_min_label = i_min_label and j_max_label = i_min_label")
    apart = (100 * F.col("i_max_n") < percent * F.col("j_min_n")) | (100 * F.col("j_max_n") < percent * F.col("i_min_n"))
    pairs = materialize(i.join(j, "node").where("i_block <= j_block").where(~done & ~apart).select("node", F.col("i_block").alias("i"), F.col("j_block").alias("j")))
    sides = pairs.select("node", "i", "j", F.col("i").alias("block")).unionByName(pairs.where("i < j").select("node", "i", "j", F.col("j").alias("block")))
    placed = materialize(sides.join(rows.select("node", "block", "id"), ["node", "block"]))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t) for t in pdf["text"]]
        first, ids = (pdf["block"] == pdf["i"]).to_numpy(), pdf["id"].to_numpy()
        one = np.flatnonzero(first)
        two = np.flatnonzero(~first) if pdf["i"].iloc[0] < pdf["j"].iloc[0] else one
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": []})
        order = ids[np.concatenate([one, two])]
        out = pd.DataFrame({"a": order[_connected([sets[k] for k in one], [sets[k] for k in two], percent)], "b": order})
        return out[out["a"] != out["b"]].drop_duplicates()

    # a text is met once by its id, then goes to the pairs of blocks that it is in
    of_text = placed.groupBy("id").agg(F.collect_list(F.struct("node", "i", "j", "block")).alias("at"))
    rows = of_text.join(texts.hint("merge"), "id").select("id", "text", F.explode("at").alias("at")).select("id", "text", "at.*")
    return rows.groupBy("node", "i", "j").applyInPandas(compare, "a long, b long")


def finish(leaves: DataFrame, labels: DataFrame, classes: DataFrame, fetch: Callable[[DataFrame], DataFrame], trees: int, block: int, percent: int = PERCENT) -> DataFrame:
    """The labels (node, label) once every two members of a leaf have been compared, or are connected.

    Leaves of different trees are much alike, so one of them in so many as there are trees is compared before the rest.
    """
    if not leaves.limit(1).collect():
        return labels
    sizes = classes.select("id", "n")
    for part in (F.pmod(F.xxhash64("node"), F.lit(trees)) == 0, F.pmod(F.xxhash64("node"), F.lit(trees)) != 0):
        here = materialize(_once(leaves.where(part), sizes, labels.withColumnRenamed("node", "id")).withColumn("label", F.coalesce("label", "id")))
        still = here.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("node")
        here = materialize(here.join(materialize(still), "node"))
        if here.limit(1).collect():
            new = materialize(_blocked(here, fetch(here.select("id").distinct()), block, percent))
            labels = components(joined(labels, new))
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, depth: int = DEPTH, small: int = SMALL, rounds: int = 1, block: int = BLOCK, with_sha: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: component_id is the smallest id reachable over links.

    Texts with fewer words than a shingle are one shingle; a null text or one without words is linked with nothing. Rows
    of equal sets are one class, however many; rows that repeat with the same id stay apart and share their component.
    A row with a null id has the smallest known id of its component, or null, and is not kept unless it stands alone; of a
    component without a known id one row is kept.
    Texts are compared whole, however long; one that is larger than a block is a block of its own.
    With with_sha each row also has its text_sha256, which tells rows apart that repeat an id.
    """
    rows = materialize(described(docs.select(id_col, text_col), id_col, text_col, with_sha).withColumn("row_number", F.monotonically_increasing_id()))
    named = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(id_col).alias("first_id"), F.min(F.struct(F.col(id_col).alias("id"), "text_hash")).alias("want"), F.min("row_number").alias("first_row"), F.first("tokens").alias("tokens"), F.max("n_shingles").alias("n"))
    classes = materialize(named.withColumn("id", F.monotonically_increasing_id()))
    found, leaves = candidates(classes, trees, depth, small)
    pairs = materialize(_promising(found, classes))

    def fetch(ids: DataFrame) -> DataFrame:
        return texts_of(docs, ids.join(classes.select("id", "key", "want"), "id"), id_col, text_col)

    labels = _links(pairs, fetch(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), rounds)
    labels = finish(leaves, labels, classes, fetch, trees, block)
    lowest = classes.select("id", "first_id", "first_row").join(labels.withColumnRenamed("node", "id"), "id")
    lowest = materialize(lowest.groupBy("label").agg(F.min("first_id").alias("component_id"), F.min("first_row").alias("least_row")))
    of_class = classes.select("id", "key", "first_id", "first_row").join(labels.withColumnRenamed("node", "id"), "id", "left").join(lowest, "label", "left")
    of_class = materialize(of_class.select("key", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("least_row", "first_row").alias("least_row")))
    empty = rows.where(F.col("key").isNull()).withColumns({"component_id": F.col(id_col), "least_row": F.col("row_number")})
    out = rows.where(F.col("key").isNotNull()).join(of_class, "key").unionByName(empty.select("key", *[c for c in rows.columns if c != "key"], "component_id", "least_row"))
    kept = F.when(F.col("component_id").isNull(), F.col("row_number") == F.col("least_row")).otherwise(F.col(id_col).eqNullSafe(F.col("component_id")))
    return out.select(id_col, "n_shingles", "component_id", kept.alias("kept"), *(["text_sha256"] if with_sha else []))


def texts_of(docs: DataFrame, involved: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): one text of each class among involved (id, key, want), fetched by the row id and the text's hash that it was found with."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [hashlib.blake2b(shingles(t).tobytes(), digest_size=16).digest() == k for t, k in zip(pdf["text"], pdf["key"], strict=True)]
            yield pdf.loc[keep, ["id", "text"]]

    source = docs.select(F.col(id_col).alias("want_id"), F.col(text_col).cast("string").alias("text")).withColumn("want_hash", F.xxhash64("text"))
    # the classes in question grow with the corpus, so this join is a sort-merge join at every size
    same = F.col("want_id").eqNullSafe(F.col("want.id")) & (F.col("want_hash") == F.col("want.text_hash"))
    met = source.join(materialize(involved).hint("merge"), same).select("id", "key", "text")
    return materialize(met.mapInPandas(check, "id long, text string").dropDuplicates(["id"]))

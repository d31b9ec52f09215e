"""Hard negatives by a vertical scan of vectors in descending order of an anchor's components.

Vectors lie as columns, one per dimension, in groups of rows. An anchor reads the columns in the order of its own
magnitudes, largest first, a few at a time. What the unread columns can add to a score at least and at most follows from
each column's least and largest value, so every row has bounds of its score; rows that cannot come among the wanted ones
leave the anchor's bitmap, until all columns are read and the scores of those left are exact. Components are scaled
integers, so scores are exact.

A section of anchors meets a group of rows in one task, both of bounded size, and every pair of a section and a group is a
row of work. A first scan finds each anchor's best rows of its own label, a second one the best rows of other labels
within the window that each of these sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import materialize

#: Components are multiplied by SCALE and rounded down. Positives of an anchor; negatives of a positive; the window of
#: a negative's score, in percent of the positive's.
SCALE, POSITIVES, NEGATIVES, FROM, TO = 256, 5, 3, 50, 95
#: Components in a group of rows and in a section of anchors; columns read at first and then at a time.
GROUP, SECTION, FIRST, STEP = 2**19, 2**16, 16, 8


def usable(vector: str, label: str) -> Column:
    """Whether a row takes part: it has a label, a vector, and no component that is null or not finite."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(label).isNotNull() & F.col(vector).isNotNull() & finite


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(np.abs(values).max(initial=0))
    return values.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64)


def _scaled(vectors: list) -> np.ndarray:
    values = np.floor(SCALE * np.array([np.asarray(v, np.float64) for v in vectors]))
    if np.abs(values).max(initial=0) >= 2**62:
        raise OverflowError("a scaled component does not fit a 64-bit integer")
    return values.astype(np.int64)


def packed(rows: DataFrame) -> DataFrame:
    """(block, dim, n, n_anchors, labels, ids, no_id, anchors, values): rows (id, label, vector, anchor) in blocks of one dimension, made task by task without a shuffle."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        made = 0

        def block(dim: int) -> pd.DataFrame:
            nonlocal made
            pdf = pd.concat(held.pop(dim))
            made += 1
            no_id = pdf["id"].isna().to_numpy()
            ids = np.array([0 if x else int(v) for x, v in zip(no_id, pdf["id"], strict=True)], np.int64)
            number = (TaskContext.get().partitionId() << 24) + made
            columns = (pdf["label"].to_numpy(np.int64), ids, no_id, pdf["anchor"].to_numpy(bool), _scaled(pdf["vector"].tolist()).reshape(len(pdf), dim))
            return pd.DataFrame([(number, dim, len(pdf), columns[3].sum(), *(c.tobytes() for c in columns))], columns=["block", "dim", "n", "n_anchors", "labels", "ids", "no_id", "anchors", "values"])

        for pdf in batches:
            pdf["id"] = pdf["id"].astype(object)
            for dim, part in pdf.groupby(pdf["vector"].map(len)):
                held.setdefault(dim, []).append(part)
                if sum(map(len, held[dim])) * max(dim, 1) >= GROUP // 2:
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    typed = rows.select(F.col("id").cast("string").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    return typed.mapInPandas(pack, "block long, dim int, n int, n_anchors int, labels binary, ids binary, no_id binary, anchors binary, values binary")


def _read(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """The rows of some blocks of one dimension, sorted by label; own numbers them through all blocks."""
    kinds = {"labels": np.int64, "ids": np.int64, "no_id": bool, "anchors": bool}
    out = {c: np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) for c, t in kinds.items()}
    dim = int(pdf["dim"].iloc[0])
    out["values"] = np.concatenate([np.frombuffer(x, np.int64).reshape(n, dim) for x, n in zip(pdf["values"], pdf["n"], strict=True)])
    out["own"] = np.concatenate([(b << 20) + np.arange(n) for b, n in zip(pdf["block"], pdf["n"], strict=True)])
    order = np.argsort(out["labels"], kind="stable")
    return {c: x[order] for c, x in out.items()}


def _columns(blocks: DataFrame, groups: int) -> DataFrame:
    """(grp, dim, n, labels, ids, no_id, own, values): all blocks as groups of rows by label, each dimension a column of values."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _read(pdf)
        values = _narrow(x["values"])
        parts = [x[c].tobytes() for c in ("labels", "ids", "no_id", "own")]
        return pd.DataFrame([(pdf["grp"].iloc[0], pdf["dim"].iloc[0], len(values), *parts, values.itemsize, np.ascontiguousarray(values.T).tobytes())], columns=["grp", "dim", "n", "labels", "ids", "no_id", "own", "width", "values"])

    placed = blocks.withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(groups)))
    return placed.groupBy("grp", "dim").applyInPandas(merge, "grp long, dim int, n int, labels binary, ids binary, no_id binary, own binary, width int, values binary")


def _anchors(blocks: DataFrame, sections: int) -> DataFrame:
    """(section, dim, own, anchor_id, label, vector): the anchors among the rows of blocks."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(len(pdf)):
                x = _read(pdf.iloc[k : k + 1])
                at = np.flatnonzero(x["anchors"])
                if len(at):
                    yield pd.DataFrame({"dim": pdf["dim"].iloc[k], "own": x["own"][at], "anchor_id": x["ids"][at], "label": x["labels"][at], "vector": [v.tobytes() for v in x["values"][at]]})

    rows = blocks.mapInPandas(pick, "dim int, own long, anchor_id long, label long, vector binary")
    return rows.withColumn("section", F.pmod(F.xxhash64("own"), F.lit(sections)))


class Slice:
    """Columns of some rows, with the least and largest value of each."""

    def __init__(self, columns: np.ndarray) -> None:
        self.columns, self.least, self.most = columns, columns.min(axis=1), columns.max(axis=1)

    def typed(self, top: int) -> None:
        """Use the cheapest numbers that hold all partial sums of scores with components up to top exactly."""
        bound = len(self.columns) * top * max(int(np.abs(x.astype(np.int64)).max(initial=0)) for x in (self.least, self.most))
        if bound >= 2**63:
            raise OverflowError("a score does not fit a 64-bit integer")
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
        self.columns, self.least, self.most = (x.astype(kind) for x in (self.columns, self.least, self.most))

    def scan(self, anchor: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of those that wanted(least, most) keeps; columns are read by the anchor's magnitudes."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor.astype(self.columns.dtype)[order]
        ends = np.sort(np.stack([a * self.least[order], a * self.most[order]]), axis=0)
        rest = np.zeros((2, len(a) + 1), self.columns.dtype)
        rest[:, :-1] = np.cumsum(ends[:, ::-1], axis=1)[:, ::-1]
        sums, alive, done = np.zeros(self.columns.shape[1], self.columns.dtype), None, 0
        while True:
            bitmap = wanted(sums + rest[0, done], sums + rest[1, done]) if done else np.ones(len(sums), bool)
            if done == len(a):
                bitmap = bitmap if done else wanted(sums, sums)
                kept = np.flatnonzero(bitmap)
                return kept if alive is None else alive[kept], sums[kept].astype(np.int64)
            if not bitmap.all():
                kept = np.flatnonzero(bitmap)
                alive, sums = kept if alive is None else alive[kept], sums[kept]
                if not len(kept):
                    return alive, sums.astype(np.int64)
            dims = order[done : done + (STEP if done else FIRST)]
            sums = sums + a[done : done + len(dims)] @ (self.columns[dims] if alive is None else self.columns[np.ix_(dims, alive)])
            done += len(dims)


def best(count: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Keeps rows that can be among the count of largest scores, with all ties."""

    def wanted(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        if len(least) <= count:
            return np.ones(len(least), bool)
        return most >= np.partition(least, -count)[-count]

    return wanted


def best_within(windows: list[tuple[int, int]], count: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Keeps rows that can be among the count of largest scores of some window, ends included, with all ties."""

    def wanted(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(least), bool)
        for low, high in windows:
            may = (most >= low) & (least <= high)
            sure = least[may & (least >= low) & (most <= high)]
            if len(sure) >= count:
                may &= most >= np.partition(sure, -count)[-count]
            keep |= may
        return keep

    return wanted


def window(score: int) -> tuple[int, int]:
    """Least and largest score of a negative, whose hundredfold lies from FROM to TO times the positive's; none where the positive's is negative."""
    return -(-FROM * score // 100), TO * score // 100


def _first(x: dict[str, np.ndarray], rows: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the first count rows: larger scores first, then smaller ids, unknown ids last."""
    return np.lexsort((x["own"][rows], x["ids"][rows], x["no_id"][rows], -scores))[:count]


def _scan(columns: DataFrame, anchors: DataFrame, groups: int, sections: int, same_label: bool) -> DataFrame:
    """(own, about, id, score): of each anchor the best rows of its label in every group (about null), or the best ones of other labels in the window of each of its scores (about)."""

    def meet(group: pd.DataFrame, section: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(group) and len(section):
            g = group.iloc[0]
            x = {c: np.frombuffer(g[c], t) for c, t in {"labels": np.int64, "ids": np.int64, "no_id": bool, "own": np.int64}.items()}
            values = np.frombuffer(g["values"], f"i{g['width']}").reshape(g["dim"], g["n"])
            vectors = {k: np.frombuffer(v, np.int64) for k, v in zip(section["own"], section["vector"], strict=True)}
            top = max(int(np.abs(v).max(initial=0)) for v in vectors.values())
            for label, of_label in section.groupby("label"):
                low, high = np.searchsorted(x["labels"], [label, label + 1])
                for part in [slice(low, high)] if same_label else [slice(0, low), slice(high, g["n"])]:
                    if part.start >= part.stop:
                        continue
                    there = Slice(values[:, part])
                    there.typed(top)
                    for row in of_label.itertuples():
                        if same_label:
                            rows, scores = there.scan(vectors[row.own], best(POSITIVES + 1))  # the anchor itself may be one
                            rows = rows + part.start
                            keep = x["own"][rows] != row.own
                            found = [(None, rows[keep], scores[keep], POSITIVES)]
                        else:
                            windows = {int(p): window(int(p)) for p in row.scores if p >= 0}
                            rows, scores = there.scan(vectors[row.own], best_within(list(windows.values()), NEGATIVES)) if windows else (np.zeros(0, int), np.zeros(0, int))
                            inside = {p: (scores >= a) & (scores <= b) for p, (a, b) in windows.items()}
                            found = [(p, rows[k] + part.start, scores[k], NEGATIVES) for p, k in inside.items()]
                        for about, at, got, count in found:
                            for k in _first(x, at, got, count):
                                out.append((row.own, about, None if x["no_id"][at[k]] else str(x["ids"][at[k]]), int(got[k])))
        return pd.DataFrame(out, columns=["own", "about", "id", "score"]).astype({"about": "Int64"})

    left = columns.withColumn("section", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sections - 1).cast("long")))).groupBy("grp", "dim", "section")
    right = anchors.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).groupBy("grp", "dim", "section")
    rows = left.cogroup(right).applyInPandas(meet, "own long, about long, id string, score long")
    return rows.select("own", "about", F.col("id").cast("long").alias("id"), "score")


def _ranked(rows: DataFrame, by: list[str], count: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= count)


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row that anchor holds of.

    An anchor's positives are the POSITIVES best other rows of its label, a positive's negatives the NEGATIVES best rows of
    other labels whose score lies from FROM to TO percent of the positive's. Larger scores come first, ties by smaller id;
    a row that repeats with its id is another row. Rows with a null label or vector, or a component that is null or not
    finite, take no part; a row with a null id does, but is no anchor, and comes after those that tie with it. Vectors
    are compared with those of the same length; an empty one scores 0. Scores that do not fit 64 bits are an error.
    An empty table gives no row; other columns are ignored.
    """
    chosen = rows.where(usable(vector_col, label_col))
    chosen = chosen.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"), (anchor & F.col(id_col).isNotNull()).alias("anchor"))
    blocks = materialize(packed(chosen))
    sizes = blocks.agg(F.sum(F.col("n") * F.greatest("dim", F.lit(1))).alias("n"), F.sum("n_anchors").alias("anchors"), F.max(F.greatest("dim", F.lit(1))).alias("dim")).first()
    groups, sections = (max(1, -(-(x or 0) // y)) for x, y in ((sizes["n"], GROUP), ((sizes["anchors"] or 0) * (sizes["dim"] or 0), SECTION)))
    columns, anchors = materialize(_columns(blocks, groups)), materialize(_anchors(blocks, sections))
    positives = _ranked(_scan(columns, anchors, groups, sections, True), ["own"], POSITIVES)
    positives = materialize(positives.select("own", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")))
    scores = positives.groupBy("own").agg(F.collect_set("positive_score").alias("scores"))
    negatives = _ranked(_scan(columns, anchors.join(scores, "own"), groups, sections, False), ["own", "about"], NEGATIVES)
    negatives = negatives.select("own", F.col("about").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = positives.join(negatives, ["own", "positive_score"]).join(anchors.select("own", "anchor_id"), "own")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

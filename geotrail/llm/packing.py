"""Best-fit packing of token sequences: minimum bin slack.

Only lengths matter to a plan, and there are at most capacity of them, so a plan is made over the histogram of lengths:
the longest length left opens a bin, a bitset subset-sum over the lengths left finds the fullest filling of the rest, and
that combination is taken as often as the counts allow. The plan's size is bounded by the capacity, not by the corpus.
Pieces then look up their place by their rank among the pieces of equal length: every task numbers its own pieces of each
length, and the counts of the tasks are put one after the other.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize
from .words import blocks, encoder

CAPACITY = 4096


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each at most counts[length] times, whose sum is the largest that is not over room."""
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length) if length <= room else 0
        take = 1
        while left:  # binary splitting of the multiplicity
            take = min(take, left)
            left -= take
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            take *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen += [length] * take
            at -= length * take
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Rows (length, first, per_bin, bins, bin, offset): the pieces of this length ranked from first on go, per_bin in each, to bins bins from bin on, from offset on."""
    left, used, rows, bins = {k: v for k, v in histogram.items() if v > 0}, dict.fromkeys(histogram, 0), [], 0
    while left:
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        chosen = [top, *fullest({k: v for k, v in rest.items() if v}, capacity - top)]
        uses = {x: chosen.count(x) for x in sorted(set(chosen), reverse=True)}
        times, offset = min(left[x] // n for x, n in uses.items()), 0
        for x, n in uses.items():
            rows.append((x, used[x], n, times, bins, offset))
            used[x] += n * times
            left[x] -= n * times
            offset += n * x
            if not left[x]:
                del left[x]
        bins += times
    return pd.DataFrame(rows, columns=["length", "first", "per_bin", "bins", "bin", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], part, rank): each document's ids and end_id, cut only where longer than capacity.

    rank counts the pieces of this length in the task part, from 0. A null text is end_id alone; texts of any length are
    encoded whole.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)[id_col]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        part, ranks = TaskContext.get().partitionId(), defaultdict(count)
        for pdf in batches:
            names = iter(pdf["row"].tolist())
            for block in blocks(pdf["text"].tolist()):
                out = []
                for ids in words.many(block):
                    name, ids = next(names), np.concatenate([ids, end])
                    for n, at in enumerate(range(0, len(ids), capacity)):
                        data = ids[at : at + capacity].tobytes()
                        out.append((name, n, at, len(data) // 4, zlib.crc32(data), *([data] if keep_ids else []), part, next(ranks[len(data)])))
                yield pd.DataFrame(out, columns=["row", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), "part", "rank"])

    schema = "row string, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", part int, rank long"
    out = rows.select(F.col(id_col).cast("string").alias("row"), "text").mapInPandas(cut, schema)
    return out.select(F.col("row").cast(kind).alias(id_col), *out.columns[1:])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds (sequence_id, offset) to the pieces of pieces(), a written table, as their part and rank must not change.

    The histogram of lengths, at most capacity rows, is all that reaches the driver. Repeated rows are pieces of their
    own; equal ones may swap places. A null id is an id like any other. An empty table gives an empty table.
    """
    counts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = {k: v for k, v in plan(histogram, capacity).groupby("length")}
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    firsts = materialize(counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("first")))
    shared = pieces.sparkSession.sparkContext.broadcast(steps)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        steps, rank = shared.value, rank.to_numpy()
        out = np.zeros((len(rank), 2), np.int64)
        for x, at in length.groupby(length.to_numpy()).indices.items():
            s = steps[x]
            k = np.searchsorted(s["first"].to_numpy(), rank[at], "right") - 1
            inside = rank[at] - s["first"].to_numpy()[k]
            per = s["per_bin"].to_numpy()[k]
            out[at, 0] = s["bin"].to_numpy()[k] + inside // per
            out[at, 1] = s["offset"].to_numpy()[k] + inside % per * x
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    placed = pieces.join(firsts, ["length", "part"]).withColumn("place", place(F.col("length"), F.col("first") + F.col("rank")))
    return placed.select(*[c for c in pieces.columns if c not in ("part", "rank")], "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """All documents as pieces of sequences of at most capacity ids; keep_ids keeps each piece's ids beside its place."""
    return pack(materialize(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, keep_ids)), capacity)

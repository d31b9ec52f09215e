"""Removal of repeated substrings by prefix-free parsing.

A rolling hash parses every text: the trigger of a window is its k-gram of least hash, so equal windows have equal
triggers wherever they stand. A phrase is what the windows of one trigger cover together; the part before the trigger
is its head, what follows, as far as a window reaches, its continuation. Equal phrases are one entry of the dictionary,
and all windows of an entry that occurs twice are repeated.

Different entries can share a window only if all that their windows hold in common, the bytes from the trigger on that
are the anchor, is equal. So the corpus order falls into independent slices, one for each anchor. In a slice the suffixes
of the heads are put in order, and so are the continuations, both with the lengths of common prefixes between
neighbours. A window is a suffix of a head and a continuation: two windows are equal where both are, as far as the
window reaches, hence where they lie in one run of either order between lengths that are too short. Slices with many
entries are cut by where the trigger stands in the window, halving until few entries or a single place are left, as
windows of a narrower range of places hold more bytes in common. Rolling hashes only bring together what may be equal;
what is removed has been compared by content, or by a 128-bit cryptographic digest of the content.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, materialize, shared_dir

#: Bytes of a k-gram, and k-grams among which the trigger of a window is chosen (a power of two).
GRAM, CHOICE = 16, 128
#: Entries that are compared in one place: at most about 330 bytes each. Slices with more are cut.
FEW = 500
#: Window starts of a long text that are parsed together.
SEGMENT = 500_000
_ROLLING = RollingHash(61)


class Parse:
    """The phrases of some texts. window must be at least GRAM + CHOICE."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        if window < GRAM + CHOICE:
            raise ValueError(f"windows need {GRAM + CHOICE} bytes at least")
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.starts = np.cumsum([0, *map(len, texts)])
        self.window = window
        self.prefix = _ROLLING.prefix(self.data)

    def triggers(self) -> np.ndarray:
        """For every position the trigger of the window that starts there."""
        h = _ROLLING.sliding(self.prefix, GRAM)
        low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= CHOICE:
            low = np.minimum(low[:-width], low[width:]) if len(low) > width else low[:0]
            width *= 2
        return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first window, last window, trigger), positions counted over all the texts."""
        t = self.triggers()
        lasts = self.starts[1:] - self.window  # of the windows of each text
        texts, first, last = [], [], []
        for k in np.flatnonzero(lasts >= self.starts[:-1]).tolist():
            a, b = int(self.starts[k]), int(lasts[k])
            cuts = np.flatnonzero(np.diff(t[a : b + 1])) + a + 1
            first.append(np.concatenate([[a], cuts]))
            last.append(np.concatenate([cuts - 1, [b]]))
            texts.append(np.full(len(cuts) + 1, k))
        if not texts:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        first = np.concatenate(first)
        return np.concatenate(texts), first, np.concatenate(last), t[first]

    def anchors(self, trigger: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from a trigger on that each of its windows holds."""
        return _ROLLING.of(self.prefix, trigger, trigger + self.window - CHOICE).view(np.int64)

    def digests(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Digests of the phrases."""
        data, blake = self.data.tobytes(), hashlib.blake2b
        return [blake(data[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (last + self.window).tolist(), strict=True)]


def _blocks(pdf: pd.DataFrame, window: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(row, offset, bytes): consecutive texts of about size bytes together. A longer text is cut so that each of its windows is in one part."""
    rows, offsets, held, n = [], [], [], 0
    for row, text in zip(pdf["row"], pdf["text"], strict=True):
        data = text.encode()
        for at in range(0, max(1, len(data) - window + 1), size):
            rows.append(row)
            offsets.append(at)
            held.append(data[at : at + size + window - 1])
            n += len(held[-1])
            if n >= size:
                yield np.array(rows), np.array(offsets), held
                rows, offsets, held, n = [], [], [], 0
    if held:
        yield np.array(rows), np.array(offsets), held


def _parsed(table: DataFrame, window: int, full: bool, segment: int) -> DataFrame:
    """(anchor) of every phrase, or with full (anchor, digest, row, first, last, trigger)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, offset, data in _blocks(pdf, window, segment):
                p = Parse(data, window)
                text, first, last, trigger = p.phrases()
                out = {"anchor": p.anchors(trigger)}
                if full:
                    shift = offset[text] - p.starts[text]
                    out |= {"digest": p.digests(first, last), "row": row[text], "first": first + shift, "last": last + shift, "trigger": trigger + shift}
                yield pd.DataFrame(out)

    schema = "anchor long, digest binary, row long, first int, last int, trigger int" if full else "anchor long"
    return table.select("row", "text").mapInPandas(parse, schema)


def _cut_out(marked: DataFrame, window: int) -> DataFrame:
    """(slice, row, first, lo, hi, data): the phrases in spans, an array of (anchor, first, last, trigger), as pieces.

    A piece stands for the windows whose trigger is lo to hi bytes behind their start; its data begin with the first.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, text, spans in zip(pdf["row"], pdf["text"], pdf["spans"], strict=True):
                data = text.encode()
                out += [(s["anchor"], row, s["first"], s["trigger"] - s["last"], s["trigger"] - s["first"], data[s["first"] : s["last"] + window]) for s in spans]
            yield pd.DataFrame(out, columns=["slice", "row", "first", "lo", "hi", "data"])

    return marked.select("row", "text", "spans").mapInPandas(cut, "slice long, row long, first int, lo int, hi int, data binary")


def _ordered(slices: np.ndarray, flat: np.ndarray, start: np.ndarray, length: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of strings that are read from start in direction step: their alphabetical order within each slice.

    common[k] is how long a prefix the strings at k - 1 and k of the order share; -1 where another slice begins.
    """
    width = int(length.max(initial=0))
    at = np.minimum(np.arange(width), np.maximum(length - 1, 0)[:, None]) * step + np.where(length > 0, start, 0)[:, None]
    letters = np.where(np.arange(width) < length[:, None], flat[at], 0).astype(np.uint8)
    keys = np.concatenate([slices.astype(">u4").view(np.uint8).reshape(-1, 4), letters], axis=1)
    order = np.argsort(length, kind="stable")  # a string comes behind its own prefixes, even if zero bytes follow
    order = order[np.argsort(np.ascontiguousarray(keys[order]).view(f"S{width + 4}").ravel(), kind="stable")]
    a, b = order[:-1], order[1:]
    differ = letters[a] != letters[b]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if width else np.zeros(len(a), np.int64)
    common = np.where(slices[a] == slices[b], np.minimum(common, np.minimum(length[a], length[b])), -1)
    return order, np.concatenate([[-1], common])


def repeated_windows(slices: np.ndarray, lo: np.ndarray, hi: np.ndarray, data: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, place of the trigger) of all windows that occur twice among the pieces of their slice."""
    flat = np.frombuffer(b"".join(data), np.uint8)
    start = np.cumsum([0, *map(len, data[:-1])])
    slices = np.unique(slices, return_inverse=True)[1].astype(np.uint32)
    trigger, n = start + hi, len(data)
    heads, head_common = _ordered(slices, flat, trigger - 1, hi, -1)
    tails, tail_common = _ordered(slices, flat, trigger, window - lo, 1)
    pieces, places = [], []
    for d in range(int(lo.min(initial=0)), int(hi.max(initial=-1)) + 1):
        runs = []
        for order, common, need in ((heads, head_common, d), (tails, tail_common, window - d)):
            run = np.empty(n, np.int64)
            run[order] = np.cumsum(common < need)
            runs.append(run)
        at = np.flatnonzero((lo <= d) & (d <= hi))
        both = runs[0][at] * (n + 1) + runs[1][at]
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(at) > 1 else order[:0]
        pieces.append(at[twice])
        places.append(np.full(len(twice), d))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(pieces or none), np.concatenate(places or none)


def _compared(pieces: DataFrame, window: int) -> DataFrame:
    """(row, first, last): runs of windows that occur twice within a slice; a slice must have few pieces."""

    def flag(pdf: pd.DataFrame) -> pd.DataFrame:
        piece, place = repeated_windows(*(pdf[c].to_numpy() for c in ("slice", "lo", "hi")), pdf["data"].tolist(), window)
        at = pdf["first"].to_numpy()[piece] + pdf["hi"].to_numpy()[piece] - place
        order = np.lexsort((at, piece))
        piece, at = piece[order], at[order]
        new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)])[: len(at)]
        end = np.concatenate([new[1:], [True]])[: len(at)]
        return pd.DataFrame({"row": pdf["row"].to_numpy()[piece[new]], "first": at[new], "last": at[end]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            rest = pdf["slice"] == pdf["slice"].iloc[-1]  # this slice may go on in the next batch
            held = pdf[rest]
            if not rest.all():
                yield flag(pdf[~rest])
        if held is not None:
            yield flag(held)

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parts, "slice").sortWithinPartitions("slice")
    return dealt.mapInPandas(compare, "row long, first int, last int")


def _halved(pieces: DataFrame, window: int, size: int) -> DataFrame:
    """The pieces cut by the place of the trigger into ranges of size places; a slice is a range and what its windows have in common."""
    parts = pieces.select("*", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))).alias("part"))
    parts = parts.withColumn("low", F.greatest("lo", F.col("part") * size).cast("int")).withColumn("high", F.least("hi", F.col("part") * size + size - 1).cast("int"))
    common = F.expr(f"substring(data, cast(hi - part * {size} + 1 as int), {window - size + 1})")
    own = F.expr(f"substring(data, hi - high + 1, high + {window} - low)")
    return parts.select(F.xxhash64(common, "part").alias("slice"), "row", (F.col("first") + F.col("hi") - F.col("high")).alias("first"), F.col("low").alias("lo"), F.col("high").alias("hi"), own.alias("data"))


def _shared(pieces: DataFrame, window: int, few: int) -> DataFrame:
    """(row, first, last): runs of windows that occur twice within the slices of pieces, whatever their size."""
    found, size = None, CHOICE
    while True:
        sizes = materialize(pieces.groupBy("slice").agg(F.count("*").alias("pieces")).where("pieces > 1"))
        sized = pieces.join(sizes, "slice")
        some = materialize(_compared(sized.where(F.col("pieces") <= few).drop("pieces"), window))
        found = some if found is None else found.unionByName(some)
        if size == 1 or not sizes.where(F.col("pieces") > few).limit(1).collect():
            return found
        size //= 2
        parts = materialize(_halved(sized.where(F.col("pieces") > few), window, size))
        same = parts.groupBy("slice", "lo", "hi", "data").agg(F.count("*").alias("n"), F.min(F.struct("row", "first")).alias("place"))
        same = materialize(same.select("slice", "place.row", "place.first", "lo", "hi", "data", "n"))
        again = parts.join(same.where("n > 1").select("slice", "lo", "hi", "data"), ["slice", "lo", "hi", "data"])
        found = found.unionByName(materialize(again.select("row", "first", (F.col("first") + F.col("hi") - F.col("lo")).alias("last"))))
        pieces = same.drop("n")


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of data without the spans (start, stop), the bytes removed and the maximal runs they form."""
    if not spans:
        return data, 0, 0
    steps = np.zeros(len(data) + 1, np.int32)
    for a, b in spans:
        steps[a] += 1
        steps[b] -= 1
    gone = np.cumsum(steps[:-1], dtype=np.int32) > 0
    runs = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def remove_repeats(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, few: int = FEW, segment: int = SEGMENT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): every byte of a window that starts twice anywhere is removed.

    A null text is empty; texts shorter than a window lose nothing; long texts are parsed segment by segment. Rows that
    repeat with the same id are documents of their own, so both lose everything that they share. Null ids are kept,
    other columns left out. The result is a written table.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("string").alias("name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    # bucketed by row, so that what is found about a row meets its text without moving any text again
    name = f"repeats_{uuid.uuid4().hex}"
    rows.repartition(parts, "row").write.bucketBy(parts, "row").option("compression", "zstd").option("path", shared_dir(spark)).saveAsTable(name)
    try:
        out = _without_repeats(spark.table(name), window, keep_text, few, segment)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out.select(F.col("name").cast(kind).alias(id_col), *out.columns[1:])


def _without_repeats(table: DataFrame, window: int, keep_text: bool, few: int, segment: int) -> DataFrame:
    """(name, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of the rows (name, text, row) of a bucketed table."""
    anchors = materialize(_parsed(table, window, False, segment).groupBy("anchor").count().where("count > 1").select("anchor"))
    phrases = materialize(_parsed(table, window, True, segment).join(anchors, "anchor"))
    place = F.min(F.struct("row", "first", "last", "trigger")).alias("place")
    entries = materialize(phrases.groupBy("anchor", "digest").agg(F.count("*").alias("n"), place))
    twice = phrases.join(materialize(entries.where("n > 1").select("anchor", "digest")), ["anchor", "digest"]).select("row", "first", "last")
    # entries that share an anchor with another entry may share windows with it: one phrase of each counts
    mixed = materialize(entries.groupBy("anchor").agg(F.count("*").alias("entries")).where("entries > 1"))
    unsure = entries.join(mixed, "anchor").select("anchor", "place.*")

    def meet(marks: DataFrame, how: str, *columns: str) -> DataFrame:
        marks = marks.groupBy("row").agg(F.collect_list(F.struct("first", "last", *columns)).alias("spans"))
        return table.join(marks.hint("merge"), "row", how)

    pieces = materialize(_cut_out(meet(unsure, "inner", "anchor", "trigger"), window))
    found = twice.unionByName(_shared(pieces, window, few))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, spans in zip(pdf["name"], pdf["text"], pdf["spans"], strict=True):
                data = text.encode()
                kept, n, runs = kept_bytes(data, [(s["first"], s["last"] + window) for s in (spans if spans is not None else [])])
                out.append((doc, len(data), n, runs, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
            yield pd.DataFrame(out, columns=["name", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])])

    schema = "name string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return materialize(meet(found, "left").select("name", "text", "spans").mapInPandas(remove, schema))

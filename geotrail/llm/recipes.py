"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes says so. Chunks of equal digest are held against each other by
content, so a digest that stands for one content identifies it; where contents share a digest they are told apart by
their rank. A document is its ordered list of chunk identifiers, and two documents are equal exactly if their lists are.
Contents move once, equal ones merged before they move; documents are grouped by their short lists alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, materialize
from .words import blocks

#: Bytes: of the rolling window, of the smallest and the largest chunk; one window in MEAN ends a chunk.
WINDOW, SMALLEST, LARGEST, MEAN = 32, 256, 16_384, 2048
_HASH = RollingHash(8)


def chunk_ends(texts: list[bytes]) -> Iterator[list[int]]:
    """Ends of the chunks of every text, a function of its bytes alone. An empty text is one empty chunk."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    hits = np.flatnonzero(_HASH.sliding(_HASH.prefix(data), WINDOW) % np.uint64(MEAN) == 0) + WINDOW
    at = 0
    for text in texts:
        stop, last, ends = at + len(text), at, []
        for end in [*hits[np.searchsorted(hits, at + WINDOW) : np.searchsorted(hits, stop)].tolist(), stop]:
            while end - last > LARGEST:
                last += LARGEST
                ends.append(last - at)
            if end == stop or end - last >= SMALLEST:
                ends.append(end - at)
                last = end
        yield ends
        at = stop


def _chunks(texts: list[bytes], digest_bytes: int) -> Iterator[list[tuple[bytes, bytes]]]:
    for text, ends in zip(texts, chunk_ends(texts), strict=True):
        parts = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        yield [(hashlib.blake2b(p, digest_size=digest_bytes).digest(), p) for p in parts]


def recipes(docs: DataFrame, id_col: str, text: Column, digest_bytes: int) -> DataFrame:
    """(id, text_sha256, n_bytes, recipe) of every row."""
    kind = dict(docs.dtypes)[id_col]

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = iter(pdf["row"].tolist())
            for block in blocks(pdf["text"].tolist(), 500_000):
                data = [x.encode() for x in block]
                out = [(next(names), hashlib.sha256(d).hexdigest(), len(d), b"".join(h for h, _ in c)) for d, c in zip(data, _chunks(data, digest_bytes), strict=True)]
                yield pd.DataFrame(out, columns=["row", "text_sha256", "n_bytes", "recipe"])

    rows = docs.select(F.col(id_col).cast("string").alias("row"), text.alias("text"))
    out = rows.mapInPandas(listed, "row string, text_sha256 string, n_bytes long, recipe binary")
    return out.select(F.col("row").cast(kind).alias(id_col), "text_sha256", "n_bytes", "recipe")


def clashes(docs: DataFrame, text: Column, digest_bytes: int) -> DataFrame:
    """(digest, content, rank) of the chunks whose digest stands for several contents."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block in blocks(pdf["text"].tolist(), 500_000):
                found = {x for c in _chunks([t.encode() for t in block], digest_bytes) for x in c}
                yield pd.DataFrame(sorted(found), columns=["digest", "content"])

    chunks = docs.select(text.alias("text")).mapInPandas(cut, "digest binary, content binary")
    variants = chunks.groupBy("digest").agg(F.collect_set("content").alias("contents")).where(F.size("contents") > 1)
    return variants.select("digest", F.posexplode(F.array_sort("contents")).alias("rank", "content"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalize=None, digest_bytes: int = 16) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256): the row of the largest id of each group of equal texts stays.

    normalize maps the text column to the text that is compared; null counts as empty. Rows that repeat with the same id
    and text are tied: exactly one of them is kept. A null id is smaller than any other. Other columns are left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalize(text) if normalize else text
    listed = recipes(docs, id_col, text, digest_bytes).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(listed)
    clash = materialize(clashes(docs, text, digest_bytes))
    key = ["recipe"]
    if clash.limit(1).collect():  # rank the contents that a digest confuses, in the texts that hold them
        rows = rows.join(_told_apart(docs, text, digest_bytes, clash), "text_sha256", "left").fillna("", ["ranks"])
        key = ["recipe", "ranks"]
    groups = rows.groupBy(*key).agg(F.max(F.struct(id_col, "row")).alias("keep"), F.count("*").alias("size")).where("size > 1")
    groups = materialize(groups)
    out = rows.join(groups, key, "left")
    single = F.col("size").isNull()
    return out.select(
        id_col,
        F.when(single, F.col(id_col)).otherwise(F.col(f"keep.{id_col}")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("keep.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def _told_apart(docs: DataFrame, text: Column, digest_bytes: int, clash: DataFrame) -> DataFrame:
    """(text_sha256, ranks): the ranks of the confused chunks of each text, in order."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block in blocks(pdf["text"].tolist(), 500_000):
                data = [t.encode() for t in block]
                out = [(hashlib.sha256(d).hexdigest(), n, h, p) for d, c in zip(data, _chunks(data, digest_bytes), strict=True) for n, (h, p) in enumerate(c)]
                yield pd.DataFrame(out, columns=["text_sha256", "pos", "digest", "content"])

    chunks = docs.select(text.alias("text")).mapInPandas(cut, "text_sha256 string, pos int, digest binary, content binary")
    ranked = chunks.join(clash, ["digest", "content"]).select("text_sha256", "pos", "rank").distinct()
    return ranked.groupBy("text_sha256").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("pos", "rank"))), lambda x: x["rank"].cast("string"))).alias("ranks"))

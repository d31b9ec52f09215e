"""Fixed-width bit-packed id files.

A file holds consecutive documents. Its ids are cut into blocks of BLOCK ids; each block is packed on its own with the
fewest bits that hold the largest id of the vocabulary, and starts at a byte that the header lists, so that a reader
unpacks any block with a few array operations. Layout, all little-endian:

    magic 4s, width u32, block u32, n_docs u64, n_ids u64
    doc_id i64 x n_docs, known u8 x n_docs (0: the id was null), ends u64 x n_docs (ids up to each document's end)
    block offsets u64 x (n_blocks + 1), from the start of the packed part
    packed part, 8 bytes of padding
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import shared_dir
from .words import blocks, encoder

MAGIC, HEAD, BLOCK = b"BPK1", "<4sIIQQ", 4096


def width_of(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Id k at bits [k*width, (k+1)*width), low bits first."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    """The first n ids; data must reach 8 bytes beyond them."""
    if width == 16:
        return data[: 2 * n].view("<u2").astype(np.uint32)
    at = np.arange(n, dtype=np.int64) * width
    byte, word = at >> 3, np.zeros(n, np.uint64)
    for k in range(5):
        word |= data[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def write_file(doc_ids: list[int | None], docs: list[np.ndarray], width: int, block: int = BLOCK) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    packed = [pack_bits(ids[k : k + block], width) for k in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, packed)]).astype("<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    ends = np.cumsum([len(d) for d in docs]).astype("<u8")
    head = struct.pack(HEAD, MAGIC, width, block, len(docs), len(ids))
    return b"".join([head, names.tobytes(), known.tobytes(), ends.tobytes(), offsets.tobytes(), *packed, bytes(8)])


class PackedFile:
    """Random access to the bytes of one file."""

    def __init__(self, data: bytes) -> None:
        magic, self.width, self.block, n, self.n_ids = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a packed id file")
        at = struct.calcsize(HEAD)
        self.names = np.frombuffer(data, "<i8", n, at)
        self.known = np.frombuffer(data, np.uint8, n, at + 8 * n).astype(bool)
        self.ends = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at + 17 * n).astype(np.int64)
        self.body = np.frombuffer(data, np.uint8, offset=at + 17 * n + 8 * (n_blocks + 1))

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the file; only the blocks that hold them are unpacked."""
        first, last = start // self.block, -(-stop // self.block)
        parts = [unpack_bits(self.body[self.offsets[k] :], min(self.block, self.n_ids - k * self.block), self.width) for k in range(first, last)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return ids[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_packed(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 4_000_000) -> str:
    """Write every document's ids and end_id to packed files in ascending id order; returns the folder.

    The folder holds a table (part, file, first_doc, n_docs, n_ids, content): one row is one file, part and file order
    them. The documents are dealt by ranges of the id, so each task writes consecutive files of about file_bytes. Null
    ids come first; a null text has only end_id; repeated rows are written each, next to one another. Rows of one id
    are told apart by how their texts begin and by where they were read, so an id that many rows share is not one task.
    """
    path = path or shared_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first(), F.col("place"))
    ordered = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("place")

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, part, n = encoder(tokenizer), TaskContext.get().partitionId(), 0
        width, end = width_of(max(words.vocab_size, end_id + 1)), np.array([end_id], np.uint32)
        names, held, size = [], [], 0

        def flush() -> pd.DataFrame:
            first = names[0]
            data = write_file(names, held, width)
            return pd.DataFrame({"part": [part], "file": [n], "first_doc": pd.array([first], "Int64"), "n_docs": [len(held)], "n_ids": [sum(map(len, held))], "content": [data]})

        for pdf in batches:
            ids = iter([None if pd.isna(x) else int(x) for x in pdf["doc_id"].astype("Int64")])
            for block in blocks(pdf["text"].tolist()):
                for got in words.many(block):
                    names.append(next(ids))
                    held.append(np.concatenate([got, end]))
                    size += len(held[-1]) * width // 8
                    if size >= file_bytes:
                        yield flush()
                        n += 1
                        names, held, size = [], [], 0
        if held:
            yield flush()

    out = ordered.mapInPandas(files, "part int, file int, first_doc long, n_docs long, n_ids long, content binary")
    out.write.options(compression="uncompressed").parquet(path)
    return path


def read_packed(df: DataFrame, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the rows that write_packed() wrote; start counts over all files."""
    totals = df.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each writing task
    before = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    inner = W.partitionBy("part").orderBy("file")
    starts = df.select("part", "file", "n_ids").join(F.broadcast(before), "part")
    starts = starts.select("part", "file", (F.col("part_start") + F.sum("n_ids").over(inner) - F.col("n_ids")).alias("file_start"))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                f = PackedFile(r.content)
                ids = f.read(0, f.n_ids)
                begins = np.concatenate([[0], f.ends[:-1]]) if len(f.ends) else f.ends
                docs = [ids[a:b].tobytes() for a, b in zip(begins, f.ends, strict=True)]
                out = {"part": r.part, "file": r.file, "doc_id": pd.array(np.where(f.known, f.names, 0), "Int64"), "inside": begins, "n_tokens": f.ends - begins, "ids_crc32": [zlib.crc32(x) for x in docs]}
                out = pd.DataFrame(out | ({"ids": docs} if keep_ids else {}))
                out.loc[~f.known, "doc_id"] = pd.NA
                yield out

    kept = ["ids"] if keep_ids else []
    got = df.select("part", "file", "content").mapInPandas(unpack, "part int, file int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)
    return got.join(starts, ["part", "file"]).select("doc_id", (F.col("file_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *kept)


__all__ = ["PackedFile", "pack_bits", "read_packed", "unpack_bits", "width_of", "write_file", "write_packed"]

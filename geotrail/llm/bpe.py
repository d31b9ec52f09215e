"""BPE encoding by tree concatenation, and decoding.

A long text is cut into leaves that are encoded on their own. Neighbours are joined pairwise, level by level: a window
around the join is encoded again and grows until it shares a token (same id, same bytes) with the left run and one with
the right run; the runs are spliced at those two tokens. A token sequence whose adjacent pairs are all as BPE leaves
them is the encoding of its text, so a splice at shared tokens is exact. Where no token is shared the window ends up as
the whole text of both runs, which is exact as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held
from .words import SPACE, WordEncoder, blocks, make_encoder, tokens_of

#: Bytes of a leaf, and characters from which a text is spread over tasks, as pieces of so many bytes.
LEAF_BYTES = 4096
SPREAD_CHARS = 32_768


class Run:
    """Ids of one stretch of a normalized text, with the byte after each."""

    def __init__(self, ids: np.ndarray, start: int, sizes: np.ndarray) -> None:
        self.ids, self.start = ids, start
        self.ends = start + np.cumsum(sizes)

    @classmethod
    def spliced(cls, start: int, *parts: tuple[np.ndarray, np.ndarray]) -> Run:
        run = cls.__new__(cls)
        run.start, run.ids, run.ends = start, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return run

    @property
    def stop(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else self.start

    def keys(self, a: int, b: int) -> set[tuple[int, int]]:
        return set(zip(self.ids[a:b].tolist(), self.ends[a:b].tolist(), strict=True))


class TreeEncoder:
    """Encodes normalized texts under a lower-case vocabulary whose words are split at white space."""

    def __init__(self, words: WordEncoder, leaf_bytes: int = LEAF_BYTES, window: int = 48) -> None:
        self.words, self.leaf, self.window = words, leaf_bytes, window
        sizes = [len(t.removesuffix(words.suffix)) for t in words.tokens]
        self.sizes = np.array([*sizes, 1], np.int64)

    def size_of(self, ids: np.ndarray) -> np.ndarray:
        return self.sizes[np.where(ids == SPACE, len(self.sizes) - 1, ids)]

    def cut(self, data: bytes, start: int = 0) -> list[tuple[int, bytes]]:
        """Halves of halves, down to leaves; only between characters."""
        if len(data) <= self.leaf:
            return [(start, data)]
        mid = len(data) // 2
        while mid and data[mid] & 0xC0 == 0x80:
            mid -= 1
        return self.cut(data[:mid], start) + self.cut(data[mid:], start + mid) if mid else [(start, data)]

    def run(self, ids: np.ndarray, start: int) -> Run:
        return Run(ids, start, self.size_of(ids))

    def join(self, data: bytes, left: Run, right: Run, origin: int = 0) -> Run:
        """The run of data[left.start:right.stop]; offsets count from origin."""
        cut, reach = left.stop, self.window
        while True:
            lo, hi = max(left.start, cut - reach), min(right.stop, cut + reach)
            while lo > left.start and data[lo - origin] & 0xC0 == 0x80:
                lo -= 1
            while hi < right.stop and data[hi - origin] & 0xC0 == 0x80:
                hi += 1
            mid = self.run(self.words.aligned(data[lo - origin : hi - origin].decode()), lo)
            # the first token of the window both sides of which are at stake is never taken: its start may differ
            i = int(np.searchsorted(left.ends, lo, "right"))
            j = int(np.searchsorted(right.ends, hi, "right"))
            a = b = None
            if lo > left.start:
                for k in range(len(mid.ids)):
                    if mid.ends[k] >= cut:
                        break
                    at = int(np.searchsorted(left.ends, mid.ends[k]))
                    if at > i and k and left.ends[at] == mid.ends[k] and left.ends[at - 1] == mid.ends[k - 1] and left.ids[at] == mid.ids[k]:
                        a = (at, k)
                        break
            else:
                a = (-1, -1)
            if hi < right.stop:
                for k in range(len(mid.ids) - 1, 0, -1):
                    if mid.ends[k - 1] < cut:
                        break
                    at = int(np.searchsorted(right.ends[:j], mid.ends[k]))
                    before = right.ends[at - 1] if at else right.start
                    if at < j and right.ends[at] == mid.ends[k] and before == mid.ends[k - 1] and right.ids[at] == mid.ids[k]:
                        b = (at, k)
                        break
            else:
                b = (len(right.ids), len(mid.ids))
            if a and b and a[1] < b[1]:
                return Run.spliced(
                    left.start,
                    (left.ids[: a[0] + 1], left.ends[: a[0] + 1]),
                    (mid.ids[a[1] + 1 : b[1]], mid.ends[a[1] + 1 : b[1]]),
                    (right.ids[b[0] :], right.ends[b[0] :]),
                )
            reach *= 4

    def grow(self, data: bytes, runs: list[Run], origin: int = 0) -> Run:
        while len(runs) > 1:
            pairs = [self.join(data, x, y, origin) for x, y in zip(runs[::2], runs[1::2], strict=False)]
            runs = pairs + runs[len(runs) - len(runs) % 2 :]
        return runs[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Aligned ids of normalized texts; the leaves of all of them are encoded together."""
        datas = [t.encode() for t in texts]
        cuts = [self.cut(d) for d in datas]
        leaves = iter(self.words.many_aligned([x.decode() for c in cuts for _, x in c]))
        return [self.grow(d, [self.run(next(leaves), at) for at, _ in c]).ids for d, c in zip(datas, cuts, strict=True)]

    def ids_of(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of raw texts as the library gives them."""
        for block in blocks(texts):
            parts = [self.words.split_special.split(x) if "<|" in x else [x] for x in block]
            got = iter(self.encode_all([self.words.normalize(p) for ps in parts for p in ps[::2]]))
            for ps in parts:
                ids = np.concatenate([np.frombuffer(self.words.special[p], np.uint32) if k % 2 else next(got) for k, p in enumerate(ps)])
                yield ids[ids != SPACE]


def tree(path: str, leaf_bytes: int) -> TreeEncoder:
    """The encoder of this Python worker."""
    return held(("tree", path, leaf_bytes), lambda: TreeEncoder(make_encoder(path, spaces=True), leaf_bytes))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf_bytes: int = LEAF_BYTES, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """(id, n_tokens, ids): the ids of every whole text under a lower-case word vocabulary, as little-endian bytes.

    Texts up to spread_chars are encoded where they are read. The pieces of longer ones are dealt over the tasks; equal
    long texts are encoded once. A null or empty text has no ids. Rows stay apart however often they repeat, a null id
    is kept, other columns are left out, an empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)[id_col]

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tree(tokenizer, leaf_bytes)
        for pdf in batches:
            ids = [x.tobytes() for x in t.ids_of(pdf["text"].tolist())]
            yield pd.DataFrame({"row": pdf["row"], "n_tokens": [len(x) // 4 for x in ids], "ids": ids})

    def carried(df: DataFrame) -> DataFrame:
        """The id rides along as text, so that nulls survive pandas."""
        return df.withColumn("row", F.col(id_col).cast("string"))

    def named(df: DataFrame) -> DataFrame:
        return df.select(F.col("row").cast(kind).alias(id_col), F.col("n_tokens").cast("long"), "ids")

    is_long = F.coalesce(F.length("text"), F.lit(0)) > spread_chars
    short = named(carried(rows.where(~is_long)).select("row", "text").mapInPandas(whole, "row string, n_tokens long, ids binary"))
    long = rows.where(is_long).withColumn("key", F.sha2("text", 256))
    done = _spread(long.select("key", "text").dropDuplicates(["key"]), tokenizer, leaf_bytes, spread_chars)
    return short.unionByName(long.select(id_col, "key").join(done, "key").select(id_col, "n_tokens", "ids"))


def _spread(texts: DataFrame, tokenizer: str, leaf_bytes: int, piece_bytes: int) -> DataFrame:
    """(key, n_tokens, ids) of few long texts: cut, encode the pieces on all tasks, then join the pieces of each text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = tree(tokenizer, leaf_bytes).words
        halve = TreeEncoder(words, piece_bytes).cut
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                found = []
                for n, part in enumerate(words.split_special.split(text)):
                    found += [(key, n, 0, part.encode())] if n % 2 else [(key, n, at, x) for at, x in halve(words.normalize(part).encode())]
                yield pd.DataFrame(found, columns=["key", "part", "start", "data"])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tree(tokenizer, leaf_bytes)
        for pdf in batches:
            plain = (pdf["part"] % 2 == 0).tolist()
            got = iter(t.encode_all([x.decode() for x, p in zip(pdf["data"], plain, strict=True) if p]))
            yield pdf.assign(ids=[next(got).tobytes() if p else t.words.special[x.decode()] for x, p in zip(pdf["data"], plain, strict=True)])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        t, out = tree(tokenizer, leaf_bytes), []
        for part, own in pdf.sort_values(["part", "start"]).groupby("part"):
            ids = [np.frombuffer(x, np.uint32) for x in own["ids"]]
            out.append(ids[0] if part % 2 else t.grow(b"".join(own["data"]), [t.run(x, at) for x, at in zip(ids, own["start"], strict=True)]).ids)
        ids = np.concatenate(out)
        ids = ids[ids != SPACE]
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "n_tokens": [len(ids)], "ids": [ids.tobytes()]})

    pieces = texts.mapInPandas(cut, "key string, part int, start long, data binary").repartition("key", "part", "start")
    pieces = pieces.mapInPandas(each, "key string, part int, start long, data binary, ids binary")
    return pieces.groupBy("key").applyInPandas(together, "key string, n_tokens long, ids binary")


def decoded(ids: Column, tokenizer: str) -> Column:
    """The text of ids, as the library decodes them under a vocabulary without a decoder: tokens joined by spaces."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        tokens = tokens_of(tokenizer)
        return ids.map(lambda x: b" ".join(tokens[np.frombuffer(x, np.uint32)]).decode())

    return decode(ids)


def digest(ids: Column, tokenizer: str) -> Column:
    """struct(ids_sha256, decoded_sha256) of the ids and of the text decoded from them; the text is not kept."""

    @F.pandas_udf("ids_sha256 string, decoded_sha256 string")
    def both(ids: pd.Series) -> pd.DataFrame:
        tokens = tokens_of(tokenizer)
        out = [(hashlib.sha256(x).hexdigest(), hashlib.sha256(b" ".join(tokens[np.frombuffer(x, np.uint32)])).hexdigest()) for x in ids]
        return pd.DataFrame(out, columns=["ids_sha256", "decoded_sha256"])

    return both(ids)

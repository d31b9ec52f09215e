"""Secret scans: patterns for known forms, and a token-efficiency test for strings that no language writes.

A vocabulary learned from text needs few tokens for words and many for random strings. A candidate run with few
characters a token is reported, unless it is a digest of a known length, a universally unique identifier, a number, or an
identifier whose letters are words, which take few tokens themselves.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held

#: The base kinds in order, their patterns and the least length of what must be long enough.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
_NAMES = ("passw", "secret", "token", "api")

#: A candidate has so many characters at least; below so many a token it is reported.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_-])")
CHARS_A_TOKEN = 2.1
#: Hex digits of common digests.
DIGESTS = frozenset((32, 40, 48, 56, 64, 96, 128))
_UUID = re.compile(r"[0-9a-fA-F]{8}(-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}")
_ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _vocabulary(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # candidates hold no white space, so letters, digits and other signs are all there is to tell apart
    return tiktoken.Encoding("ranks", pat_str=r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", mergeable_ranks=ranks, special_tokens={})


def vocabulary(path: str):
    """The vocabulary of this Python worker."""
    return held(("ranks", path), lambda: _vocabulary(path))


def looks_random(run: str, encoding, chars_a_token: float = CHARS_A_TOKEN) -> bool:
    if not re.search("[A-Za-z]", run) or len(run) >= chars_a_token * len(encoding.encode_ordinary(run)):
        return False
    if _UUID.fullmatch(run) or (_ALL_HEX.fullmatch(run) and len(run) in DIGESTS):
        return False
    words = _WORD.findall(run)
    return sum(map(len, words)) < chars_a_token * sum(len(encoding.encode_ordinary(w)) for w in words)


def find(text: str, encoding, chars_a_token: float = CHARS_A_TOKEN) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans of a whole text, in order; offsets are code points, ends exclusive."""
    spans = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        if not any(a < m.end() and m.start() < b for a, _, b in spans):
            if looks_random(m[0], encoding, chars_a_token):
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def secret_spans(text: Column, ranks_path: str, chars_a_token: float = CHARS_A_TOKEN) -> Column:
    """array<struct<kind, start, end>> of every whole text; null counts as empty and has no spans."""

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = vocabulary(ranks_path)
        for texts in batches:
            yield pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(x or "", encoding, chars_a_token)] for x in texts], dtype=object)

    return scan(text.cast("string"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def masked(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        ahead = s["start"] >= acc["at"]
        piece = F.when(ahead, F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], piece).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def scan_table(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", chars_a_token: float = CHARS_A_TOKEN) -> DataFrame:
    """(id, spans) of every row; repeated rows stay apart, a null id is kept, an empty table gives an empty table.

    Texts are scanned whole, however long; a null text has no spans. Spans of several kinds may overlap; a random one overlaps none.
    """
    return docs.select(F.col(id_col), secret_spans(F.col(text_col), ranks_path, chars_a_token).alias("spans"))

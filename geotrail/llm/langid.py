"""Language identification with hyperdimensional profiles.

Every letter has a random vector of -1 and 1 that depends on its code point alone. A three-letter sequence is the
product of its letters' vectors, each shifted by its place; a text is the sum over its sequences; a language is the sum
over its texts. A document gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held

DIM, ORDER = 512, 3
UNKNOWN = "und"
#: Sequences and letters that a task remembers the vectors of, and sequences it adds up at once.
MOST, MOST_LETTERS, STEP = 16_000, 32_768, 4096

_LETTERS: list[np.ndarray] = []


def letter_codes() -> np.ndarray:
    """For every code point its lower-case letter, 0 for what is no letter."""
    if not _LETTERS:
        table = np.zeros(sys.maxunicode + 1, np.int64)
        for c in range(sys.maxunicode + 1):
            x = chr(c)
            if unicodedata.category(x)[0] == "L":
                table[c] = ord(low) if len(low := x.lower()) == 1 else c
        _LETTERS.append(table)
    return _LETTERS[0]


class Profiles:
    """Sums of sequence vectors; the vectors are made when they are first met."""

    def __init__(self, dim: int = DIM) -> None:
        self.dim, self.letters, self.rows = dim, {}, {}
        self.vectors = np.zeros((1024, dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= MOST_LETTERS:
                self.letters.clear()
            self.letters[code] = np.random.default_rng([4, code]).integers(0, 2, self.dim).astype(np.int8) * 2 - 1
        return self.letters[code]

    def product(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of some sequences: their letters' vectors, shifted by place and multiplied."""
        out = np.ones((len(grams), self.dim), np.int8)
        for k in range(ORDER):
            codes, which = np.unique(grams >> 21 * (ORDER - 1 - k) & 0x1FFFFF, return_inverse=True)
            out *= np.roll(np.array([self.letter(c) for c in codes.tolist()]), ORDER - 1 - k, axis=1)[which]
        return out

    def of(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of at most STEP distinct sequences, remembered while they are few."""
        keys = grams.tolist()
        new = np.array([k for k, g in enumerate(keys) if g not in self.rows], np.int64)
        if len(self.rows) + len(new) > MOST:
            self.rows.clear()
            new = np.arange(len(keys))
        if len(new):
            n = len(self.rows)
            while n + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            self.vectors[n : n + len(new)] = self.product(grams[new])
            self.rows.update(zip(grams[new].tolist(), range(n, n + len(new)), strict=True))
        return self.vectors[[self.rows[g] for g in keys]]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct sequences of a text and their counts; words stand between single blanks. None if it has no letter."""
        codes = letter_codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes = np.concatenate([[0], codes, [0]])
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
        if len(codes) < ORDER:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
        return np.unique(grams, return_counts=True)

    def vector(self, text: str) -> np.ndarray | None:
        """The exact sum for a whole text, None where it has no letter."""
        grams, counts = self.grams(text)
        if not len(grams):
            return None
        total = np.zeros(self.dim, np.float64)
        for k in range(0, len(grams), STEP):
            # products of whole numbers, exact below 2**24 a step in float32
            kind = np.float32 if counts[k : k + STEP].sum() < 2**24 else np.float64
            total += counts[k : k + STEP].astype(kind) @ self.of(grams[k : k + STEP]).astype(kind)
        return total


def profiles(dim: int) -> Profiles:
    """The sums of this Python worker."""
    return held(("profiles", dim), lambda: Profiles(dim))


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dim: int = DIM) -> dict[str, np.ndarray]:
    """The prototype of each non-null language: the sum over all texts that have it. Texts without a letter add nothing.

    What reaches the driver is one number for each language and dimension.
    """

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, sums = profiles(dim), {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                if (v := p.vector(text or "")) is not None:
                    sums[lang] = sums.get(lang, 0) + np.rint(v).astype(np.int64)
        for lang, v in sums.items():
            yield pd.DataFrame({"lang": lang, "dim": np.arange(dim, dtype=np.int32), "value": v})

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sums = rows.mapInPandas(bundle, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    out: dict[str, np.ndarray] = {}
    for r in sums:
        out.setdefault(r["lang"], np.zeros(dim))[r["dim"]] = r["value"]
    return dict(sorted(out.items()))


def compare(vector: np.ndarray | None, names: list[str], prototypes: np.ndarray) -> tuple[str, float]:
    """The most similar of unit prototypes and its cosine as 0 to 1; ties go to the first name."""
    if vector is None or not names:
        return UNKNOWN, 0.0
    cosines = prototypes @ (vector / (np.linalg.norm(vector) or 1.0))
    k = int(np.argmax(cosines))
    return names[k], float(min(1.0, max(0.0, cosines[k])))


def predict(text: Column, prototypes: dict[str, np.ndarray], dim: int = DIM) -> Column:
    """struct(lang_pred, score) of every whole text; 'und' with 0 where it is null or has no letter, or nothing was learned."""
    names = list(prototypes)
    units = np.array([prototypes[n] / (np.linalg.norm(prototypes[n]) or 1.0) for n in names])

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        p = profiles(dim)
        return pd.DataFrame([compare(p.vector(x or ""), names, units) for x in texts], columns=["lang_pred", "score"])

    # not to be evaluated again for a filter on the prediction
    return of.asNondeterministic()(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the quarter that is not learned from; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, learned from the labelled rows that are not held out.

    Whole texts count, however long: a text's sequences are added up some thousands at a time. The label, the id and all other columns are no input of a prediction. Repeated rows stay apart; an empty table gives
    an empty table; without a labelled row every document is 'und'.
    """
    known = docs.where(~held_out(F.col(id_col)))
    prototypes = learn(known, lang_col, text_col, dim)
    out = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), predict(F.col(text_col), prototypes, dim).alias("p"))
    return out.select(id_col, "held_out", "p.lang_pred", "p.score")


__all__ = ["compare", "held_out", "identify", "learn", "letter_codes", "predict"]

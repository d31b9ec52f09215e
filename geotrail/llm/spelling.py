"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by a dictionary of trie-node pairs.

The words stand in a trie, and their reversals in another one; the nodes of both are numbered. A word cut at a place is
the pair of a prefix's node and a suffix's node, and so is a word with one place skipped. Two words that share a pair with a
skipped place on both sides differ by a replacement; a word whose cut is another word's skipped pair lacks one of its code
points. All pairs are integers, equal pairs mean equal strings, so a join gives the exact neighbours. A pair with a skipped
place leaves one code point open, so as many words share it at most as there are letters.

A trie is numbered along the sorted words: a word shares as many nodes with the word before it as they have code points in
common. Tasks number ranges of words; the few nodes that a range's first word shares with the range before take their
numbers from there. Paths grow with the length of words, not with its square.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import materialize

#: Least code points and occurrences of a word; a form occurs at least so many times as often.
LENGTH, OCCURRENCES, MORE = 7, 2, 10
#: Letters of words, A-Z being lower-cased before.
LETTERS = "a-zÀ-ÿ"
#: Code points that a task counts words of before it passes the counts on.
HELD = 2**22


def word_counts(docs: DataFrame, id_col: str, text_col: str, edit: Callable[[str, str], str] | None = None, length: int = LENGTH) -> DataFrame:
    """(word, n): how often each maximal run of letters with at least length code points occurs, after edit(id, run) of each; an id is '' where it is null.

    edit may shorten a run, which then counts if it still has length code points. Whole texts are read, however long.
    """
    run = re.compile(f"[{LETTERS}]{{{length},}}")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        size = 0

        def counted() -> pd.DataFrame:
            return pd.DataFrame({"word": list(counts), "n": list(counts.values())})

        for pdf in batches:
            for name, text in zip(pdf["name"], pdf["text"], strict=True):
                low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                for word, n in Counter(run.findall(low)).items():
                    word = edit(name, word) if edit else word
                    if len(word) >= length:
                        size += 0 if word in counts else len(word)
                        counts[word] += n
                if size > HELD:
                    yield counted()
                    counts.clear()
                    size = 0
        if counts:
            yield counted()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _common(a: str, b: str) -> int:
    """Code points that a and b begin with in common."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def trie_paths(words: DataFrame, backwards: bool = False) -> DataFrame:
    """(word, path): the nodes of the word's beginnings, or of its ends, from the empty one (0) to the whole word.

    words: distinct words in a column word, from a written table. Equal beginnings of whatever words have the same node.
    """

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, last, path = TaskContext.get().partitionId(), 0, "", [0]
        for pdf in batches:
            paths = []
            for key in pdf["key"]:
                same = _common(last, key)
                new = len(key) - same
                path = path[: same + 1] + [(part << 40) + made + k for k in range(1, new + 1)]
                made, last = made + new, key
                paths.append(path)
            yield pd.DataFrame({"word": pdf["word"], "part": part, "key": pdf["key"], "path": paths})

    key = F.reverse("word") if backwards else F.col("word")
    ordered = words.select("word", key.alias("key")).repartitionByRange("key").sortWithinPartitions("key")
    rows = materialize(ordered.mapInPandas(number, "word string, part long, key string, path array<long>"))
    ends = rows.groupBy("part").agg(*[f(F.struct("key", "path"), "key").alias(c) for f, c in ((F.min_by, "first"), (F.max_by, "last"))])
    joints, last, path = [(-1, [0], [0])], "", [0]  # one row a range, never more than there are tasks
    for r in ends.orderBy("part").collect():
        same = _common(last, r["first"]["key"])
        old, new = r["first"]["path"][: same + 1], path[: same + 1]
        joints.append((r["part"], old, new))
        last, own = r["last"]["key"], r["last"]["path"]
        path = [new[k] if k < len(old) and x == old[k] else x for k, x in enumerate(own)]
    joints = words.sparkSession.createDataFrame(joints, "part long, old array<long>, new array<long>")
    node = F.transform("path", lambda x, k: F.when((k < F.size("old")) & (F.get("old", k) == x), F.get("new", k)).otherwise(x))
    return rows.join(joints, "part").select("word", node.alias("path"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): both directions of every pair of words that differ by one inserted, deleted or replaced code point. words: distinct words in a column word, from a written table."""
    begins, ends = trie_paths(words).withColumnRenamed("path", "b"), trie_paths(words, backwards=True).withColumnRenamed("path", "e")
    size = F.size("b") - 1
    paths = materialize(begins.join(ends, "word").select("word", "b", "e", F.element_at("b", -1).alias("id")))

    def pairs(last: Column, skipped: int) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.get("b", k).alias("p"), F.get("e", size - k - skipped).alias("s"))))

    skips = paths.select("id", pairs(size - 1, 1).alias("x")).select("id", "x.*")
    cuts = paths.select("id", pairs(size, 0).alias("x")).select("id", "x.*")
    other = skips.select(F.col("id").alias("other"), "p", "s", F.lit(True).alias("skipped")).unionByName(cuts.select(F.col("id").alias("other"), "p", "s", F.lit(False).alias("skipped")))
    # either of equal code points in a row can be the one too many, so some pairs come more than once
    met = skips.join(other, ["p", "s"]).where(~F.col("skipped") | (F.col("id") < F.col("other"))).select("id", "other")
    met = materialize(met)
    both = met.unionByName(met.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    names = paths.select("id", "word")
    near = names.select(F.col("id").alias("other"), F.col("word").alias("near"))
    return both.join(near, "other").join(names, "id").select("word", "near")


def variants(counts: DataFrame, more: int = MORE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the distinct words of counts (word, n).

    n_near counts the words that differ by one inserted, deleted or replaced code point. form is the one of them with the
    largest n, ties by code points, if it occurs at least more times as often as the word; form_n is its n. root is reached
    from the word by following forms. A null word is left out; an empty table gives no row.
    """
    words = materialize(counts.select("word", "n").where(F.col("word").isNotNull()))
    near = materialize(neighbours(words)).join(words.withColumnRenamed("word", "near"), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    named = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= more * F.col("n"), F.col("best")).alias("best"))
    named = materialize(named.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    roots = materialize(named.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:  # a form is more times as frequent, so a few doublings reach every end
        step = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        step = materialize(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if not step.where("moved").limit(1).collect():
            break
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[str, str], str] | None = None) -> DataFrame:
    """variants() of the words of all texts: maximal runs of letters, A-Z lower-cased, after edit(id, run), with at least LENGTH code points and OCCURRENCES occurrences.

    A null text has no words, a null id is '' to edit; rows that repeat count as often as they are there; very long texts and
    words are whole; other columns are ignored.
    """
    return variants(word_counts(docs, id_col, text_col, edit).where(F.col("n") >= OCCURRENCES))

"""Awkward tables for every operator."""

import random

TOKENIZERS = {n: f"/opt/tokenizers/{n}" for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken")}
#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, row string, key string, n int, arrival int, spans string, length int"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "an"]) if rng.random() < 0.2 else "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def awkward():
    rng = random.Random(1)
    long = prose(rng, 4000)
    texts = [None, "", " \n", "One line, it's short.", "One line, it's short.", long, long + " end", "a" * 3000, "naïve Ωμέγα 三 😀 <|endoftext|> x", "!!'s ''re", prose(rng, 40)]
    rows = [(k, t, "en" if k % 2 else None, "r", "k", k, k, "s", 7) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "null id", "fr", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (-5, "negative", "de", "r", "k", 1, 1, "s", 1)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")

"""Texts beyond every block size, among short ones."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from geotrail.llm import bitpack, bpe, langid, mpeg, nearset, packing, recipes, repeats, secrets
from geotrail.llm.queries import vocabulary

from .data import TOKENIZERS, documents, prose
from .test_dedup import near_by_force

WORD, BYTE = TOKENIZERS["word_bpe_49k.json"], TOKENIZERS["byte_bpe_50k.json"]
SECRET = "password=hunter22"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(20)
    part = prose(rng, 45_000)  # about 240 kB
    long = " ".join([part, prose(rng, 300_000), SECRET, part])
    changed = long.split(" ")
    changed[1000:1200] = ["other"] * 200
    return [long, "short one", None, "x" * 700_000, " ".join(changed), "", part[:100_000]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return documents(spark, texts).repartition(3)


def library(path, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    return [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_tokens(docs, texts, spark):
    assert len(texts[0]) > 2_000_000
    want = library(WORD, texts)
    got = {r.doc_id: r.ids for r in bpe.encode(docs, WORD).collect()}
    assert all(np.array(ids, "<u4").tobytes() == got[k] for k, ids in enumerate(want))
    pieces = packing.pack_documents(docs, WORD).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces) == [(k, at, len(x[at : at + 4096]), crc(x[at : at + 4096])) for k, ids in enumerate(want) for x in [[*ids, 1]] for at in range(0, len(x), 4096)]
    rows = bitpack.read_packed(spark.read.parquet(bitpack.write_packed(docs, BYTE))).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == [(k, len(ids) + 1, crc([*ids, 0])) for k, ids in enumerate(library(BYTE, texts))]


def test_media_and_chunks(docs, texts):
    for r in mpeg.read_media(mpeg.store_texts(docs)).collect():
        data = (texts[r.doc_id] or "").encode()
        assert r.n_bytes == len(data) and r.payload == data + bytes(-len(data) % 64 if data else 64)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in recipes.exact_duplicates(docs).collect()} == {**{k: (k, 1) for k in (0, 1, 3, 4, 6)}, 2: (5, 2), 5: (5, 2)}


def test_repeats_in_long_texts(docs, texts):
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    alike = (got[0].n_removed, got[4].n_removed)
    # all of the first but the changed words and what stands within a window of them, and of the secret, which both hold
    assert alike[0] > 0.99 * got[0].n_bytes and got[4].n_bytes - alike[1] <= len("other ") * 200 + 2
    assert got[6].n_removed == got[6].n_bytes and got[3].n_removed == 700_000 and got[1].n_removed == 0
    assert got[3].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_languages_secrets_and_near_copies(docs, texts):
    rows = nearset.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == near_by_force(list(enumerate(texts)))
    assert {r.doc_id: r.component_id for r in rows}[4] == 0
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan_table(docs, vocabulary("byte_bpe_50k.tiktoken")).collect()}
    at = texts[0].index(SECRET)
    assert ("assign", at, at + len(SECRET)) in spans[0]
    labelled = docs.withColumn("lang", docs.text.substr(1, 1))
    assert {r.doc_id: r.lang_pred for r in langid.identify(labelled).collect()}[2] == "und"


def test_ties_of_languages_go_to_the_first_name():
    same = np.ones((2, 4)) / 2
    assert langid.compare(np.ones(4), ["a", "b"], same) == ("a", 1.0)
    assert langid.compare(None, ["a", "b"], same) == ("und", 0.0) and langid.compare(np.ones(4), [], same[:0]) == ("und", 0.0)

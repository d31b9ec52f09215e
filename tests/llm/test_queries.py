"""Every query on the small driver tables against an independent computation."""

import base64
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from geotrail.llm import langid
from geotrail.llm.queries import QUERIES

from ..oracles import SF
from .data import TOKENIZERS
from .test_dedup import near_by_force, repeats_by_force

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def documents():
    return duckdb.connect().execute(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def run(spark, name):
    return QUERIES[name](spark, SF).collect()


def ids_of(name, text):
    from tokenizers import Tokenizer

    if name not in LIBRARY:
        LIBRARY[name] = Tokenizer.from_file(TOKENIZERS[name])
        LIBRARY[name].no_truncation()
        LIBRARY[name].no_padding()
    return LIBRARY[name].encode(text or "", add_special_tokens=False).ids


LIBRARY: dict = {}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, documents):
    want = []
    for k, text, _ in documents:
        ids = ids_of("word_bpe_49k.json", text)
        decoded = LIBRARY["word_bpe_49k.json"].decode(ids, skip_special_tokens=False)
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, run(spark, "op1_bpe_tree"))) == want


def test_op2(spark, documents):
    for r, (k, text, _) in zip(sorted(run(spark, "op2_mpeg_audio")), documents, strict=True):
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (k, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        # frames of 320 kbit/s at 32 kHz hold 1440 bytes, of which 23 are header, checksum and side information
        frames = -(-len(payload) // 1417)
        duration, table, _, bad, skipped, _ = r.feature.split(";")
        assert (duration, table.split(":")[0], bad, skipped) == (f"{1152 * frames}/32000", str(frames), "0", "0")
        assert r.media_bytes - int(table.split(":")[1]) == 10 + 10 + len(b"\0payload\0%d" % len(payload))  # the tag in front


def test_op4(spark, documents):
    codes, letters = langid.letter_codes(), langid.Profiles()

    def grams(text):
        codes_of = [int(codes[ord(c)]) for c in text or ""]
        joined = re.sub("\0+", "\0", "".join(["\0", *map(chr, codes_of), "\0"]))
        return [joined[k : k + 3] for k in range(len(joined) - 2)] if joined != "\0" else []

    vectors = {}

    def vector(gram):
        if gram not in vectors:
            x, y, z = (letters.letter(ord(c)) for c in gram)
            vectors[gram] = np.roll(x, 2) * np.roll(y, 1) * z
        return vectors[gram]

    def bundle(text):
        return sum((vector(g).astype(float) for g in grams(text)), np.zeros(langid.DIM))

    held = {k: zlib.crc32(str(k).encode()) % 4 == 2 for k, *_ in documents}
    sums = {}
    for k, text, lang in documents:
        if lang is not None and not held[k] and grams(text):
            sums[lang] = sums.get(lang, 0) + bundle(text)
    got, right = {r.doc_id: r for r in run(spark, "op4_language_id")}, []
    for k, text, lang in documents:
        v = bundle(text)
        cosines = sorted(((v @ p / np.linalg.norm(v) / np.linalg.norm(p), n) for n, p in sums.items()), reverse=True) if grams(text) else []
        r = got[k]
        assert r.held_out == held[k] and r.lang_pred == (cosines[0][1] if cosines else "und")
        assert r.score == pytest.approx(max(0.0, cosines[0][0]) if cosines else 0.0, abs=1e-4)
        if held[k] and lang:
            right.append(r.lang_pred == lang)
    assert np.mean(right) >= 0.95


def test_op5(spark, documents):
    rows, want, bins = run(spark, "op5_pack_sequences"), [], {}
    for k, text, _ in documents:
        ids = ids_of("word_bpe_49k.json", text) + [1]
        want += [(k, n, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])) for n, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)])]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_op6(spark, documents):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op6_repeated_substrings"))
    assert got == repeats_by_force(documents, 200) and any(n for _, _, n, *_ in got)


def test_op7(spark, documents):
    at, want = 0, []
    for k, text, _ in documents:
        ids = ids_of("byte_bpe_50k.json", text) + [0]
        want.append((k, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, run(spark, "op7_packed_ids"))) == want


def test_op9(spark, documents):
    rows = run(spark, "op9_near_dedup")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == near_by_force(documents)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_op10(spark):
    folder = SF.replace("sf0.001", "sf0.01")  # the smallest tables hold no secret
    documents = duckdb.connect().execute(f"SELECT doc_id, text, lang FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got, found = {r.doc_id: r for r in QUERIES["op10_secret_scan"](spark, folder).collect()}, 0
    for k, text, _ in documents:
        kinds = (
            [m.span() for m in assign.finditer(text or "") if len(m[1]) >= 6],
            [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20],
            [m.span() for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24],
        )
        spans = sorted((a, n, b) for n, own in enumerate(kinds) for a, b in own)
        base = [f"{('assign', 'access', 'hex')[n]}:{a}:{b}" for a, n, b in spans]
        r = got[k]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(len, kinds)) and r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if not s.startswith("random:")] == base
        assert [int(s.split(":")[1]) for s in every] == sorted(int(s.split(":")[1]) for s in every)
        found += len(base)
        for a, b in ((int(x), int(y)) for s in every if s.startswith("random:") for x, y in [s.split(":")[1:]]):
            run = text[a:b]
            assert len(run) < 2.1 * tokens_by_merging(run) and not any(a < y and x < b for x, _, y in spans)
            assert not re.fullmatch("[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", run)
            random_ones.add(run)
    assert found
    assert tokens_by_merging("the") == 1 and tokens_by_merging("zq9Xk") >= 3


RANKS: dict = {}
random_ones: set = set()


def tokens_by_merging(run):
    """Tokens of a run without white space, by merging the pair of least rank again and again."""
    if not RANKS:
        with open(TOKENIZERS["byte_bpe_50k.tiktoken"], "rb") as f:
            RANKS.update((base64.b64decode(a), int(b)) for a, b in map(bytes.split, f))
    total = 0
    for piece in re.findall(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", run):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            rank, k = min((RANKS.get(parts[k] + parts[k + 1], 10**9), k) for k in range(len(parts) - 1))
            if rank == 10**9:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        total += len(parts)
    return total

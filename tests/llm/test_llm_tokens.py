"""Encoding, packing and the token store against the libraries themselves."""

import base64
import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import bpe, packing, pretokens, token_store, wordpieces

os.environ["TOKENIZERS_PARALLELISM"] = "false"
RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, ids string, n_tokens string"
TEXTS = ["", None, "it's we'll I'M  a\n\n b\t c ", "日本語 ½ ²³ Ⅳ 😀😀 é́ ﬁ ٣٤ ǅ　x", "<|endoftext|> \x1c\x85\xa0z", "ab" * 3000 + " " * 500, "word " * 5000, "Straße ñandú Œuvre’s"]


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}  # noqa: SIM115
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "x", "y") for i, t in enumerate(texts)], DOCS)


def test_pairs_of_splitters_agree():
    full = pretokens.Splitter(P.PATTERN)
    assert full.latin
    for cp in [*range(256)]:
        t = f"a{chr(cp)}b {chr(cp)}{chr(cp)} 1{chr(cp)} \n{chr(cp)}"
        assert full.latin(t) == full.full(t), cp
    assert pretokens.Splitter(r"\p{Lu}+").latin is None


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_codec_equals_the_library(tik, tok, text):
    own = bpe.codec(RANKS, P.PATTERN)
    ids = own.encode(text)
    assert ids == tik.encode_ordinary(text) and own.decode(ids) == text.encode()
    assert wordpieces.id_bytes(JSON, P.PATTERN).encode(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encode_and_decode_tables(spark, tik):
    df = docs(spark, TEXTS)
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(df, RANKS, P.PATTERN).collect()}
    assert ids == {i: tik.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    for r in bpe.digests(spark, df, RANKS, P.PATTERN).collect():
        want = tik.encode_ordinary(TEXTS[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.digests(spark, df.limit(0), RANKS, P.PATTERN).count() == 0


def test_cut():
    assert packing.cut(0, 8) == [] and packing.cut(8, 8) == [(0, 8)] and packing.cut(1, 8) == [(0, 1)]
    assert packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plans_hold_every_piece_once(histogram):
    used = packing.fractional(histogram, 40, rounds=60)
    plan = packing.rounded(histogram, used, 40)
    held = Counter()
    for config, times in plan:
        assert sum(k * m for k, m in config) <= 40
        for k, m in config:
            held[k] += m * times
    assert +held == +Counter(histogram)
    bound = -(-sum(k * n for k, n in histogram.items()) // 40)
    assert sum(t for _, t in plan) <= 1.8 * bound + 1


def test_plan_is_close_to_the_bound():
    r = np.random.default_rng(0)
    histogram = Counter(int(x) for x in np.clip(np.exp(r.normal(6.5, 1, 20_000)), 1, 2048))
    plan = packing.rounded(histogram, packing.fractional(histogram, 2048), 2048)
    assert sum(t for _, t in plan) <= 1.002 * sum(k * n for k, n in histogram.items()) / 2048 + 1


def test_packing(spark, tok):
    texts = [*TEXTS, *(" ".join(["tok"] * random.Random(i).randint(1, 300)) for i in range(60)), "x y z " * 900]
    got = packing.best_fit_packing(spark, docs(spark, texts), JSON, P.PATTERN, 256, 0).toPandas().sort_values(["doc_id", "piece"])
    for i, g in got.groupby("doc_id"):
        ids, at = np.array([*tok.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in g.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and (g.length.iloc[1:] == 256).all() and g.piece.tolist() == list(range(len(g)))
    assert got.doc_id.nunique() == len(texts)
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 256 + 1
    assert packing.best_fit_packing(spark, docs(spark, []), JSON, P.PATTERN, 256, 0).count() == 0


def test_token_store(spark, tok, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_CHARS", 9000)  # several shards
    df = docs(spark, TEXTS, 100).unionByName(docs(spark, ["again", "again"], 102)).unionByName(spark.createDataFrame([(None, "null id", "", "")], DOCS))
    got = sorted((tuple(r) for r in token_store.token_store(spark, df, JSON, P.PATTERN, 2, str(tmp_path / "s")).collect()), key=lambda r: r[1])
    assert len(list((tmp_path / "s").glob("*.bin"))) > 1
    assert [r[0] for r in got] == [None, *sorted([*range(100, 108), 102, 103])]
    at = 0
    want = {}
    for r in df.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(ids.tobytes())))
    for doc_id, start, n, crc in got:
        assert start == at and (n, crc) in want[doc_id]
        at += n
    reader = token_store.ShardReader(str(tmp_path / "s"), 0)
    assert list(reader.get(np.array([999_999, -5]))) == [[], []]
    reader.close()
    assert token_store.token_store(spark, df.limit(0), JSON, P.PATTERN).count() == 0


def test_one_far_doc_id_leaves_the_shards_even(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_CHARS", 5000)
    rows = [(i, "x" * (1000 if i < 50 else 99), "", "") for i in range(2000)]
    near, far = (token_store.shard_bounds(spark.createDataFrame(own, DOCS)) for own in (rows, [*rows, (2**62, "y", "", "")]))
    assert len(near) == 49 and abs(len(far) - len(near)) <= 1
    sizes = np.bincount(np.searchsorted(far, [r[0] for r in rows], side="left"), [len(r[1]) + 1 for r in rows])
    assert sizes.max() < 3 * sizes.mean()
    assert token_store.shard_bounds(spark.createDataFrame(rows[:3], DOCS)) == [] == token_store.shard_bounds(spark.createDataFrame([], DOCS))


def least_sequences(pieces, size):
    """The fewest bins, by trying every place for each piece, longest first."""
    best = len(pieces)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(pieces):
            best = len(bins)
            return
        for room in {b for b in bins if b >= pieces[k]}:
            left = list(bins)
            left[left.index(room)] -= pieces[k]
            put(k + 1, left)
        put(k + 1, [*bins, size - pieces[k]])

    put(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=9))
def test_plans_against_the_optimum(lengths):
    histogram = dict(Counter(lengths))
    plan = packing.rounded(histogram, packing.fractional(histogram, 16, rounds=60), 16)
    assert sum(t for _, t in plan) <= least_sequences(sorted(lengths, reverse=True), 16) + 1

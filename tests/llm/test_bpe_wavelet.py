import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxmill.llm import bpe, wavelet

PATH = public_tokenizers.path("byte_bpe_50k.json")
SOURCE = open(PATH, "rb").read()
LIBRARY = Tokenizer.from_file(PATH)
OWN, LOOKUP = bpe.Tokenizer(SOURCE), wavelet.LibraryEncoder(SOURCE)
HARD = ["", " ", "\n", "a\n", "\n\na", "a  b", "a \n b", "x<|endoftext|>y", "<|endoftext|>", " a", "a ", "\t a\tb", "it's  'll 　x", "\x1c a\x85b c", "ԯ՘ա", "日本語 123 ½", "é ​ ", "aaaa" * 500]


def ids(data, kind="<u4"):
    return np.frombuffer(data, kind).tolist()


def want(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", HARD)
def test_like_the_library(text):
    assert ids(OWN.encode(text)) == want(text)
    assert ids(LOOKUP.encode(text), LOOKUP.dtype) == want(text)
    assert OWN.decode(OWN.encode(text)) == LIBRARY.decode(want(text), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tab'.1é漢"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(text):
    assert ids(OWN.encode(text)) == want(text)
    assert ids(LOOKUP.encode(text), LOOKUP.dtype) == want(text)
    assert OWN.decode(OWN.encode(text)) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("  \nab'.1é漢"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=6))
def test_any_slice(texts):
    assert [ids(c, LOOKUP.dtype) for c in LOOKUP.encode_all(pa.array(texts, pa.string()))] == [want(t) for t in texts]


def test_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    monkeypatch.setattr(wavelet, "CACHED_PIECES", 3)
    a, b = bpe.Tokenizer(SOURCE), wavelet.LibraryEncoder(SOURCE)
    for t in ["one two three four five", "five four three", *HARD]:
        assert ids(a.encode(t)) == want(t) == ids(b.encode(t), b.dtype)


def test_operator(spark, make, small):
    df = make(small)
    out = bpe.encode_decode(df, PATH, slice_bytes=1000).collect()
    assert out[0].fingerprint == "x"
    assert sorted((r.doc_id, r.decoded) for r in out) == [(i, t or "") for i, t in enumerate(small)]
    assert all(ids(r.ids) == want(small[r.doc_id] or "") for r in out)
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0
    assert bpe.encode_decode(df, PATH, ids="n_chars", decoded=None).columns.count("n_chars") == 1


def check_matrix(wm, values, step):
    assert wm.access_many(np.arange(len(values))).tolist() == values == wm.every().tolist()
    for x in {*values[:3], 40, 37, -1, 64}:
        at = [i for i, v in enumerate(values) if v == x]
        assert wm.count(x) == len(at) and wm.select(x, len(at)) == -1 == wm.select(x, -1)
        assert wm.locate(x)[:: step] == at[:: step]
        for i in (0, len(values) // 2, len(values)):
            assert wm.rank(x, i) == values[:i].count(x)
        for k in range(0, len(at), step):
            assert wm.select(x, k) == at[k]
    for i in range(0, len(values), 97 * step):
        assert wm.access(i) == values[i]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 37), max_size=700))
def test_wavelet_matrix(values):
    wm, docs, counts = wavelet.unpack(wavelet.pack(np.array(values, np.uint16), [5], np.array([len(values)]), 6))
    assert docs == [5] and counts.tolist() == [len(values)]
    check_matrix(wm, values, 1)


def test_blocks_are_opened_singly(monkeypatch):
    r = np.random.default_rng(3)
    values = np.minimum(r.geometric(0.2, 30_000), 38) - 1
    monkeypatch.setattr(wavelet, "PLANE_WORDS", 64)
    monkeypatch.setattr(wavelet, "SAMPLE", 128)
    file = wavelet.pack(values.astype(np.uint16), [None, 1], np.array([10, 29_990]), 6)
    wm, docs, _ = wavelet.unpack(file)
    assert docs == [None, 1] and wm.access(12_345) == values[12_345]
    assert all(len(p.words.open) == 1 and len(p.words.blocks) == 8 for p in wm.planes)
    check_matrix(wm, values.tolist(), 53)
    assert wavelet.document_ids(file, 0).tolist() == values[:10].tolist() and wavelet.document_ids(file, 1).tolist() == values[10:].tolist()


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_shards(spark, make, small, size):
    rows = [(i * 3 % 10, t) for i, t in enumerate(small)] + [(None, "no id"), (3, "again"), (3, "again")]
    files = wavelet.write_shards(make(rows), PATH, shard_tokens=size)
    got = wavelet.read_shards(files).orderBy("start").collect()
    start = 0
    for r, (d, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        e = np.array([*want(t or ""), 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids, r.ids_crc32) == (d, start, len(e), e.tobytes(), zlib.crc32(e.tobytes()))
        start += len(e)
    assert wavelet.read_shards(wavelet.write_shards(make(rows).limit(0), PATH)).count() == 0


def test_digests_of_a_query(spark):
    from voxmill.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    start = 0
    for r in sorted(queries.op8_wavelet(spark, sf).collect(), key=lambda r: r.doc_id):
        a = np.array([*want(texts[r.doc_id]), 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(a), zlib.crc32(a.tobytes()))
        start += len(a)
    for r in queries.op9_bpe(spark, sf).collect():
        a = np.array(want(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(a), hashlib.sha256(a.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()

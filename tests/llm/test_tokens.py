"""Encoders against the tokenizers library; the codec, the string tables and the packing against it too."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tremor.llm import bpe, packing, sstable
from tremor.llm.tokens import encoder, vocabulary

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
ODD = [None, "", " ", "  \n\n x  y\t", "don't I'LL 12345 ½ ²", "日本語テキスト 123", "x　y", "ΑΣ ΟΔΟΣ İx ﬁ", "a<|endoftext|> b", "<|startoftext|> A", "a\x01b c\x01", "é" * 3000, "ab " * 5000, "é Å"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "null id"), (3, "another")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "block", "shard", "place", "hash")})


def library(path):
    t = Tokenizer.from_file(path)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_the_fast_engine_is_proven_equal(path):
    assert encoder(path).merger is not None
    ids = library(path)
    assert [x.tolist() for x in encoder(path).encode([t or "" for t in ODD])] == [ids(t) for t in ODD]


@settings(max_examples=600, deadline=None)
@given(st.text(max_size=60), st.sampled_from([BYTE, WORD]))
def test_any_text_has_the_librarys_ids(text, path):
    assert encoder(path).encode([text])[0].tolist() == library(path)(text)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_codec(spark, table, request):
    df, ids = request.getfixturevalue(table), library(BYTE)
    got = bpe.encode_documents(df, BYTE).collect()
    want = [(r.doc_id, ids(r.text), r.text or "") for r in df.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(((r.doc_id, r.tokens, r.text) for r in got), key=key) == sorted(want, key=key)


def test_codec_digests_and_empty_tables(spark, docs):
    spec = {"finish": bpe.digests, "result": "n_tokens long, ids_sha256 string, decoded_sha256 string"}
    ids = library(BYTE)
    for r in bpe.encode_documents(docs.limit(5), BYTE, **spec).join(docs, "doc_id").collect():
        own = ids(r.text)
        assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), BYTE, **spec).collect() == []


def test_shared_chunks_are_cut_alike():
    passage = np.random.default_rng(0).integers(97, 123, 6000).astype(np.uint8).tobytes()
    texts = [passage, b"other start " * 9 + passage]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    ends, rows = bpe.chunk_ends(raw, offsets)
    starts = np.append(0, ends[:-1])
    chunks = [{raw[a:b].tobytes() for a, b, r in zip(starts, ends, rows) if r == k} for k in (0, 1)]
    assert len(chunks[0] & chunks[1]) >= len(chunks[0]) - 1 > 2


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_string_tables(spark, table, request):
    df, ids = request.getfixturevalue(table), library(BYTE)
    manifest = sstable.write(df, BYTE)
    got = sstable.read(manifest, finish=sstable.checksums, result="n_tokens long, ids_crc32 long").orderBy("start").collect()
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
    at, want = 0, []
    for r in rows:
        own = [*ids(r.text), 0]
        want.append((r.doc_id, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    assert [tuple(r) for r in got] == want
    assert manifest.agg(F.sum("tokens")).first()[0] == at


def test_lookup_by_key(spark, docs):
    files = [sstable.Table(r.file) for r in sstable.write(docs, BYTE).collect()]
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = library(BYTE)
    for k in (0, 7, 150):
        found = [x.tolist() for t in files for x in t.get(sstable.key_of(k))]
        assert found == [[*ids(text[k]), 0]]
    assert not any(t.get(sstable.key_of(10**12)) for t in files)
    missed = sum(all(t.bloom[p >> 3] >> (p & 7) & 1 for p in sstable._probes(sstable.key_of(k), t.bits)) for t in files for k in range(10**6, 10**6 + 500))
    assert missed < 0.05 * 500 * len(files)
    for t in files:
        t.close()


def test_string_keys_and_empty_tables(spark, docs):
    named = docs.limit(20).select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    got = [r.doc_id for r in sstable.read(sstable.write(named, BYTE), id_type="string").orderBy("start").collect()]
    assert got == sorted(r.doc_id for r in named.collect())
    assert sstable.read(sstable.write(docs.limit(0), BYTE)).collect() == []


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_packing(spark, table, request):
    df, ids = request.getfixturevalue(table), library(WORD)
    pieces = packing.pack(df, WORD).toPandas()
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist()
        assert own.length.sum() in {2**k for k in range(12)}
    assert (pieces.length == pieces.tokens.map(len)).all()
    want = sorted(tuple([*ids(r.text), 1]) for r in df.collect())
    done, held = [], {}
    for r in pieces.sort_values(["sequence_id", "offset"]).itertuples():  # a document's pieces follow each other
        k = None if r.doc_id != r.doc_id else r.doc_id
        held.setdefault(k, []).extend(r.tokens)
        if r.start + r.length == r.doc_tokens:
            assert len(held[k]) == r.doc_tokens
            done.append(tuple(int(x) for x in held.pop(k)))
    assert sorted(done) == want and not held


def test_packing_of_nothing_and_of_copies(spark, docs):
    assert packing.pack(docs.limit(0), WORD).collect() == []
    copies = docs.limit(1).crossJoin(spark.range(200)).select(F.col("id").alias("doc_id"), "text")
    got = packing.pack(copies, WORD, digest=True)
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    assert got.select("doc_id").distinct().count() == 200
    with pytest.raises(ValueError):
        packing.pack(docs, WORD, length=1000)


def test_neighbours_on_the_curve_are_near():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(side, 3)
    assert sorted(key.tolist()) == list(range(512))
    walk = side[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()

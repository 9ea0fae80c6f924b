"""Packing along a space-filling curve.

A document's vector counts its hashed byte pairs; it is projected to three dimensions, and the place on a Hilbert curve
through those dimensions is the document's key.  Documents are dealt by ranges of the key and sorted by it; each range
packs its documents one after another into sequences, so neighbours in a sequence are neighbours on the curve.  What
is left over at a range's end is cut into sequences whose lengths are powers of two, so that nothing is padded.

Equal documents have equal keys; ties are dealt by a hash of id and text and then by the row's place in the input, so a
large group of copies is split over ranges; inside a range the order is total but for rows that are alike in both, so a
task that runs again cuts the same pieces.  Where ranges end follows Spark's sample, so the number of pieces may differ
from run to run; the ids and their documents don't.
A null text is empty and has only the end id; null or repeated ids are rows like any other; other columns are ignored;
an empty table gives no pieces.  A text longer than a sequence is cut; a task holds a batch of texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from . import blocks as B
from .bpe import _arrow
from .tokens import encoder

DIMS, BITS, BUCKETS = 3, 10, 512
SLICE = 1 << 20  # bytes of text that are encoded at once


def vectors(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit vectors of hashed byte-pair counts (square roots), a row for each text; zero for texts under two bytes."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    if len(raw) < 2:
        return np.zeros((n, BUCKETS))
    code = (raw[:-1].astype(np.int32) * 37 + raw[1:].astype(np.int32) * 101) % BUCKETS
    inside = row[1:] == row[:-1]
    v = np.sqrt(np.bincount((row[:-1] * np.int64(BUCKETS) + code)[inside], minlength=n * BUCKETS).reshape(n, BUCKETS))
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with coordinates in [0, 2**bits), by Gray-code transposition."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[:, i] & q) > 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(on, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[:, i] >> b) & 1
    return out


def keys(raw: np.ndarray, offsets: np.ndarray, spread: float = 4.0) -> np.ndarray:
    """Hilbert keys of texts: projections are squeezed into [0, 1) by a logistic curve."""
    way = np.random.default_rng(7).standard_normal((BUCKETS, DIMS))
    way -= way.mean(axis=0)
    p = 1 / (1 + np.exp(-spread * (vectors(raw, offsets) @ way)))
    return hilbert(np.minimum((p * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = B.flat(batch.column(1))
        parts = [keys(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in B.cuts(offs, SLICE)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))], ["id", "text", "place"])


def _packed(batches: Iterator[pa.RecordBatch], path: str, length: int, end: int, arrow: pa.Schema, digest: bool) -> Iterator[pa.RecordBatch]:
    enc, base = encoder(path), TaskContext.get().partitionId() << 32
    # The last sequence is not closed until the range ends: its pieces wait, and are cut into powers of two.
    wait: list[tuple] = []
    fill = sequence = 0

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, start, part, total, seq, off = zip(*rows, strict=True)
        out = [ids, start, [len(p) for p in part], [zlib.crc32(p.astype("<u4").tobytes()) for p in part] if digest else [p.astype(np.int32) for p in part], total, seq, off]
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

    for b in batches:
        _, offs = B.flat(b.column(1))
        for lo, hi in B.cuts(offs, SLICE):
            done: list[tuple] = []
            texts = [t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()]
            for i, t in zip(b.column(0).slice(lo, hi - lo).to_pylist(), enc.encode(texts), strict=True):
                t, at = np.append(t, enc.kind(end)), 0
                while at < len(t):
                    n = min(length - fill, len(t) - at)
                    wait.append((i, at, t[at : at + n], len(t), base + sequence, fill))
                    at, fill = at + n, fill + n
                    if fill == length:
                        done, wait, fill, sequence = done + wait, [], 0, sequence + 1
            if done:
                yield batch(done)
        B.trim()
    done, left = [], fill
    room = 1 << left.bit_length() - 1 if left else 0
    fill = 0
    for i, at, part, total, _, _ in wait:
        while len(part):
            n = min(room - fill, len(part))
            done.append((i, at, part[:n], total, base + sequence, fill))
            at, part, fill, left = at + n, part[n:], fill + n, left - n
            if fill == room:
                fill, sequence, room = 0, sequence + 1, 1 << left.bit_length() - 1 if left else 0
    if done:
        yield batch(done)


def pack(docs: DataFrame, path: str, length: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Pieces of all documents: id, start, length, tokens (digest: ids_crc32 instead), doc_tokens, sequence_id, offset.

    length: a power of two, the length of a full sequence.  end: id that closes a document.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    B.small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    own = T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("tokens", T.ArrayType(T.IntegerType()))
    longs = {n: T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")}
    schema = T.StructType([T.StructField(id_col, kind), longs["start"], longs["length"], own, longs["doc_tokens"], longs["sequence_id"], longs["offset"]])
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in schema])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = rows.mapInArrow(_keyed, T.StructType([T.StructField("id", kind), T.StructField("text", T.StringType()), T.StructField("place", T.LongType())]))
    keyed = keyed.withColumns({"tie": F.xxhash64("id", "text"), "salt": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(B.shards(docs.sparkSession, 1), "place", "tie", "salt").sortWithinPartitions("place", "tie", "id", "text").select("id", "text")
    return dealt.mapInArrow(lambda it: _packed(it, path, length, end, arrow, digest), schema)

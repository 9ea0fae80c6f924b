"""Token ids in sorted-string-table shards.

Documents are dealt by ranges of their id, encoded and written in ascending order, one file for each range:

    block*  : zstd of entries (varint shared, varint rest, varint size, rest of key, value), every 16th with its key
              in full, then the offsets of those entries and their number
    index   : last key, offset and size of each block
    filter  : Bloom filter of all keys, 10 bits a key
    footer  : places of index and filter, number of documents and ids, width of an id, magic

A key is b"\\0" for null, else b"\\1" and the id as 8 big-endian bytes (a string id: its UTF-8), so byte order is id
order, nulls first.  Values are the ids, little-endian.  A writer writes under a name of its own attempt and renames at
the end; a repeated attempt writes the same bytes.  What a task holds is a batch of texts, a block, and 16 bytes of each
key for the filter, never a shard's texts or ids.

A null text is empty, an empty text has only the end id; rows with equal ids are all kept, ordered by the first LEAD
characters of the text, then a hash of it, and go to several neighbouring shards if they are many; other columns are
ignored; an empty table gives no files and no rows.  A text of any length is one value; the task that writes or reads it
holds it whole.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import blocks as B
from .bpe import _arrow
from .tokens import encoder

BLOCK, RESTART, BITS, PROBES = 1 << 16, 16, 10, 7
SLICE, LEAD = 1 << 20, 32  # bytes of text that are encoded at once; characters of a text that order equal ids
FOOTER = struct.Struct("<QQQQQQI8s")
MAGIC = b"TRMRSST1"


def key_of(value: int | str | None) -> bytes:
    if value is None:
        return b"\0"
    return b"\1" + (value.encode() if isinstance(value, str) else struct.pack(">Q", value + (1 << 63)))


def value_of(key: bytes, text: bool) -> int | str | None:
    if key == b"\0":
        return None
    return key[1:].decode() if text else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _unvarint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith(("file:", "/")) else (fs.LocalFileSystem(), uri)


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    def __init__(self, out, width: int):
        self.out, self.width, self.pos = out, width, 0
        self.body, self.restarts, self.count, self.last = bytearray(), [], 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes = bytearray()
        self.docs = self.tokens = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART:
            top = min(len(key), len(self.last))
            while shared < top and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.body))
        self.body += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.count, self.last = self.count + 1, key
        self.hashes += xxhash.xxh3_128_digest(key)
        self.docs, self.tokens = self.docs + 1, self.tokens + len(value) // self.width
        if len(self.body) >= BLOCK:
            self.flush()

    def _put(self, raw: bytes) -> tuple[int, int]:
        at = self.pos
        self.out.write(raw)
        self.pos += len(raw)
        return at, len(raw)

    def flush(self) -> None:
        if self.count:
            raw = bytes(self.body) + np.array([*self.restarts, len(self.restarts)], "<u4").tobytes()
            self.index.append((self.last, *self._put(zstandard.ZstdCompressor(level=1).compress(raw))))
            self.body, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def finish(self) -> None:
        self.flush()
        index = self._put(b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) for k, a, n in self.index))
        bits = max(64, BITS * self.docs)
        raw = np.zeros((bits + 7) // 8, np.uint8)
        h = np.frombuffer(self.hashes, ">u8").reshape(-1, 2) if self.hashes else np.zeros((0, 2), ">u8")  # digests are big-endian: high, low
        for lo in range(0, len(h), 1 << 16):
            high, low = (h[lo : lo + (1 << 16), k].astype(np.uint64) for k in (0, 1))
            for i in range(PROBES):
                at = ((low % np.uint64(bits) + np.uint64(i) * ((high | np.uint64(1)) % np.uint64(bits))) % np.uint64(bits)).astype(np.int64)
                np.bitwise_or.at(raw, at >> 3, (1 << (at & 7)).astype(np.uint8))
        bloom = self._put(raw.tobytes())
        self._put(FOOTER.pack(*index, *bloom, self.docs, self.tokens, self.width, MAGIC))


class Table:
    """A shard opened for reading: whole, or by key."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        *at, self.docs, self.tokens, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no sorted string table")
        raw, p, self.index = self._read(*at[:2]), 0, []
        while p < len(raw):
            n, p = _unvarint(raw, p)
            key, p = raw[p : p + n], p + n
            start, p = _unvarint(raw, p)
            n, p = _unvarint(raw, p)
            self.index.append((key, start, n))
        self.keys, self.bloom, self.bits = [x[0] for x in self.index], self._read(*at[2:]), max(64, BITS * self.docs)

    def _read(self, at: int, n: int) -> bytes:
        return bytes(self.file.read_at(n, at))

    def _block(self, k: int) -> tuple[bytes, np.ndarray]:
        raw = zstandard.ZstdDecompressor().decompress(self._read(*self.index[k][1:]))
        n = int.from_bytes(raw[-4:], "little")
        return raw[: len(raw) - 4 * n - 4], np.frombuffer(raw, "<u4", n, len(raw) - 4 * n - 4)

    @staticmethod
    def _entries(body: bytes, at: int = 0, last: bytes = b"") -> Iterator[tuple[bytes, bytes]]:
        while at < len(body):
            shared, at = _unvarint(body, at)
            rest, at = _unvarint(body, at)
            size, at = _unvarint(body, at)
            last = last[:shared] + body[at : at + rest]
            at += rest
            yield last, body[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            for key, value in self._entries(self._block(k)[0]):
                yield key, np.frombuffer(value, f"<u{self.width}")

    def get(self, key: bytes) -> list[np.ndarray]:
        """Ids of all rows with the key: filter, then binary search over blocks and over a block's full keys."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        found, k = [], bisect.bisect_left(self.keys, key)
        while k < len(self.index):
            body, restarts = self._block(k)
            r = bisect.bisect_left(restarts, key, key=lambda at: next(self._entries(body, int(at)))[0])
            for own, value in self._entries(body, int(restarts[max(0, r - 1)])):
                if own > key:
                    return found
                if own == key:
                    found.append(np.frombuffer(value, f"<u{self.width}"))
            k += 1
        return found

    def close(self) -> None:
        self.file.close()


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end: int) -> Iterator[pa.RecordBatch]:
    enc, task = encoder(path), TaskContext.get()
    shard, writer = task.partitionId(), None
    fs, top = filesystem(folder)
    name, own = f"{top}/{shard:06d}.sst", f"{top}/.{shard:06d}-{task.taskAttemptId()}"
    for batch in batches:
        _, offs = B.flat(batch.column(1))
        for lo, hi in B.cuts(offs, SLICE):
            ids = batch.column(0).slice(lo, hi - lo).to_pylist()
            texts = batch.column(1).slice(lo, hi - lo).to_pylist()
            if writer is None:
                fs.create_dir(top, recursive=True)
                writer = Writer(fs.open_output_stream(own), np.dtype(enc.kind).itemsize)
            for i, t in zip(ids, enc.encode([t or "" for t in texts]), strict=True):
                writer.add(key_of(i), np.append(t, enc.kind(end)).tobytes())
        B.trim()
    if writer:
        writer.finish()
        writer.out.close()
        fs.move(own, name)
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([f"{folder}/{shard:06d}.sst"]), pa.array([writer.docs], pa.int64()), pa.array([writer.tokens], pa.int64()), pa.array([writer.pos], pa.int64())], ["shard", "file", "docs", "tokens", "bytes"])


def write(docs: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = 0) -> DataFrame:
    """Write the shards; returns their manifest (shard, file, docs, tokens, bytes), one row for each, kept as a table.

    folder: where the files go, a URI that all executors reach; by default a new folder under spark.checkpoint.dir, which
    goes when the application ends.
    """
    spark, given = docs.sparkSession, folder
    B.small_batches(spark)
    folder = folder or B.shared_folder(spark) + "-sst"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumns({"lead": F.substring("text", 1, LEAD), "tie": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(B.shards(spark, 1), "id", "lead", "tie", "salt").sortWithinPartitions("id", "lead", "tie", "text").select("id", "text")
    manifest = B.stored(dealt.mapInArrow(lambda it: _write(it, folder, path, end), "shard int, file string, docs long, tokens long, bytes long"))
    if not given:
        B.passing(spark, folder)
    return manifest


def listed(key: list, start: list[int], tokens: list[np.ndarray]) -> list[list]:
    return [[t.astype(np.int32) for t in tokens]]


def checksums(key: list, start: list[int], tokens: list[np.ndarray]) -> list[list]:
    return [[len(t) for t in tokens], [zlib.crc32(t.astype("<u4").tobytes()) for t in tokens]]


def read(manifest: DataFrame, id_type: str = "long", finish: Callable = listed, result: str = "tokens array<int>", id_col: str = "doc_id") -> DataFrame:
    """All documents of the shards: id, start (ids of all documents before it) and what finish makes of the ids."""
    schema = T.StructType.fromDDL(f"`{id_col}` {id_type}, start long, {result}")
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in schema])
    text = id_type == "string"
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    todo = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), "shard")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at in zip(batch["file"].to_pylist(), batch["base"].to_pylist(), strict=True):
                table, kept, held = Table(file), ([], [], []), 0
                for key, ids in table:
                    for x, v in zip(kept, (value_of(key, text), at, ids), strict=True):
                        x.append(v)
                    at, held = at + len(ids), held + len(ids)
                    if held > 1 << 20:
                        yield pack(kept)
                        kept, held = ([], [], []), 0
                if kept[0]:
                    yield pack(kept)
                table.close()

    def pack(kept: tuple[list, list, list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, f.type) for x, f in zip([kept[0], kept[1], *finish(*kept)], arrow, strict=True)], schema=arrow)

    return todo.repartition(B.shards(manifest.sparkSession, 1), "shard").mapInArrow(rows, schema)

"""Byte-pair encoding and decoding with content-defined chunk reuse.

1. Every text is cut where a rolling hash over the last bytes has its low bits at zero, so equal passages give equal
   chunks wherever they stand.  A block sends each of its distinct chunks once to the shard of the chunk's hash.
2. A shard encodes each distinct chunk once (equality is by bytes) and answers every block that asked.
3. A block joins the answers in order and repairs the joins: from the last cut-safe token before a join to the first
   after it, the text is encoded again, until both ends agree with what stands beside them.  A token is cut-safe if it
   begins with a space and the token before ends with a visible ASCII character: no pre-token reaches across that.

A chunk that is in a third of all documents is one entry in one shard, and one answer for each block that has it.

Inputs: a null text is empty and an empty text has no ids; ids may be null or repeated, a row of the result stands for
a row of the input; other columns are ignored; an empty table gives an empty result.  A text is held whole by the task
that has its block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from . import blocks as B, hashing as H
from .tokens import Encoder, encoder

WINDOW, MASK = 48, np.uint64(1023)
BLOCK, SLAB = 13 << 20, 1 << 20  # bytes of text in a block, and hashed at once
WIRE = "shard int, block long, meta binary, body binary"


def chunk_ends(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all texts, in order, and each chunk's row. Cuts lie between characters."""
    s = H.prefixes(raw)
    ends = np.flatnonzero((H.windows(s, WINDOW) & MASK) == 0) + WINDOW
    if len(ends):
        lead = np.append((raw & 0xC0) != 0x80, True)
        for _ in range(3):
            ends = ends + ~lead[ends]
        row = np.searchsorted(offsets, ends, side="left") - 1  # an end belongs to the text it closes
        ends = ends[ends - WINDOW >= offsets[row]]
    full = offsets[1:][offsets[1:] > offsets[:-1]]
    ends = np.unique(np.concatenate([ends, full]))
    return ends, np.searchsorted(offsets, ends, side="left") - 1


def cut(batches: Iterator[pa.RecordBatch], n_shards: int) -> Iterator[pa.RecordBatch]:
    number = B.numbered()
    for batch in batches:
        raw_all, offs_all = B.flat(batch.column(1))
        for lo, hi in B.cuts(offs_all, BLOCK):
            raw, offsets = raw_all[offs_all[lo] : offs_all[hi]], offs_all[lo : hi + 1] - offs_all[lo]
            block, ids = number(), batch.column(0).slice(lo, hi - lo)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, (one := pa.record_batch([ids], ["id"])).schema) as w:
                w.write_batch(one)
            out = [(int(block % n_shards), block, b"", B.press(sink.getvalue().to_pybytes()))]
            found = [(*chunk_ends(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), a) for a, b in B.cuts(offsets, SLAB)]
            ends = np.concatenate([e + offsets[a] for e, _, a in found])
            rows = np.concatenate([r + a for _, r, a in found])
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
            # a text starts where the one before ends, so the ends alone give the starts
            text, number_of = raw.tobytes(), {}
            which = np.zeros(len(ends), np.uint32)
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                which[i] = number_of.setdefault(text[a:b], len(number_of))
            chunks = list(number_of)
            to = np.array([xxhash.xxh3_64_intdigest(c) % n_shards for c in chunks], np.int64)
            used = to[which]
            for shard in np.unique(to).tolist():
                mine, refs = np.flatnonzero(to == shard), np.flatnonzero(used == shard)
                local = np.searchsorted(mine, which[refs])
                sizes = np.array([len(chunks[k]) for k in mine], np.uint32)
                meta = np.concatenate([[len(mine)], sizes, rows[refs], refs, local]).astype(np.uint32)
                out.append((shard, block, B.press(meta), B.press(b"".join([chunks[k] for k in mine]), 6)))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "block", "meta", "body"])
        B.trim()


def encode_shard(table: pa.Table, path: str) -> pa.Table:
    """Answers to all blocks that asked, block by block; held are the shard's distinct chunks and their ids."""
    enc, metas, bodies = encoder(path), [], []
    known: dict[bytes, bytes] = {}
    for meta, body in zip(table["meta"], table["body"], strict=True):
        meta, body = meta.as_py(), body.as_py()
        if not meta:
            metas.append(b"")
            bodies.append(body)
            continue
        m, text = B.unpress(meta, np.uint32), B.unpress(body)
        n = int(m[0])
        at = np.concatenate([[0], np.cumsum(m[1 : 1 + n], dtype=np.int64)]).tolist()
        chunks = [text[a:b] for a, b in zip(at, at[1:])]
        new = [c for c in chunks if c not in known]  # the chunks of a block are distinct
        known.update(zip(new, (x.tobytes() for x in enc.encode([c.decode() for c in new])), strict=True))
        mine = [known[c] for c in chunks]
        size = np.dtype(enc.kind).itemsize
        metas.append(B.press(np.concatenate([m[:1], np.array([len(v) // size for v in mine], np.uint32), m[1 + n :]])))
        bodies.append(B.press(b"".join(mine), 6))
    del known
    B.trim()
    return pa.table([table["shard"], table["block"], pa.array(metas, pa.binary()), pa.array(bodies, pa.binary())], ["shard", "block", "meta", "body"])


def _safe(enc: Encoder) -> tuple[np.ndarray, np.ndarray]:
    if not hasattr(enc, "safe"):
        enc.safe = (np.array([x[:1] == b" " for x in enc.spelled]), np.array([0x21 <= (x or b" ")[-1] < 0x7F for x in enc.spelled]))
    return enc.safe


def repaired(ids: np.ndarray, joins: np.ndarray, enc: Encoder) -> list:
    """Parts of a text's ids: arrays that stand, and windows (str) around joins to encode again."""
    opens, shuts = _safe(enc)
    safe = np.flatnonzero(opens[ids[1:]] & shuts[ids[:-1]]) + 1
    k = np.searchsorted(safe, joins, side="right") - 1
    left = np.where(k >= 0, safe[k] if len(safe) else 0, 0)
    k = np.searchsorted(safe, joins)
    right = np.where(k < len(safe), safe[np.minimum(k, len(safe) - 1)] if len(safe) else 0, len(ids))
    parts, at, spelled = [], 0, enc.spelled
    done: list[list[int]] = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        if a == b:
            continue
        if done and a < done[-1][1]:
            done[-1][1] = max(b, done[-1][1])
        else:
            done.append([a, b])
    for a, b in done:
        parts.append(ids[at:a])
        parts.append(b"".join(map(spelled.__getitem__, ids[a:b].tolist())).decode("utf-8", "replace"))
        at = b
    parts.append(ids[at:])
    return parts


def assemble(table: pa.Table, path: str, finish: Callable, schema: pa.Schema) -> pa.Table:
    enc, head, pieces = encoder(path), None, []
    for meta, body in zip(table["meta"].to_pylist(), table["body"].to_pylist(), strict=True):
        if not meta:
            head = pa.ipc.open_stream(B.unpress(body)).read_all().column(0)
            continue
        m, ids = B.unpress(meta, np.uint32), B.unpress(body, enc.kind)
        n = int(m[0])
        at = np.concatenate([[0], np.cumsum(m[1 : 1 + n], dtype=np.int64)])
        rows, pos, local = m[1 + n :].reshape(3, -1).astype(np.int64)
        pieces += [(r, p, ids[at[k] : at[k + 1]]) for r, p, k in zip(rows.tolist(), pos.tolist(), local.tolist(), strict=True)]
    pieces.sort(key=lambda x: x[:2])
    of: list[list[np.ndarray]] = [[] for _ in range(len(head))]
    for r, _, ids in pieces:
        of[r].append(ids)
    parts = []
    for own in of:
        if len(own) < 2:
            parts.append(own)
            continue
        joins = np.cumsum([len(x) for x in own[:-1]])
        parts.append(repaired(np.concatenate(own), joins, enc))
    again = iter(enc.encode([x for own in parts for x in own if isinstance(x, str)]))
    done = []
    for own in parts:
        own = [next(again) if isinstance(x, str) else x for x in own]
        done.append(np.concatenate(own) if own else np.zeros(0, enc.kind))
    del parts, pieces, of
    B.trim()
    return finish(head, done, enc).cast(schema)


def plain(ids: pa.Array, tokens: list[np.ndarray], enc: Encoder) -> pa.Table:
    """The default result: id, tokens (array of int), text (decoded from the ids)."""
    text = [b"".join(map(enc.spelled.__getitem__, t.tolist())).decode("utf-8", "replace") for t in tokens]
    return pa.table([ids, pa.array([t.astype(np.int32) for t in tokens], pa.list_(pa.int32())), pa.array(text, pa.string())], ["id", "tokens", "text"])


def digests(ids: pa.Array, tokens: list[np.ndarray], enc: Encoder) -> pa.Table:
    """id, n_tokens, and SHA-256 of the decimal ids joined by commas and of the decoded text."""
    if not hasattr(enc, "decimal"):
        enc.decimal = [str(i).encode() for i in range(len(enc.spelled))]
    listed, decoded = [], []
    for t in tokens:
        t = t.tolist()
        listed.append(hashlib.sha256(b",".join(map(enc.decimal.__getitem__, t))).hexdigest())
        raw = b"".join(map(enc.spelled.__getitem__, t))
        decoded.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
    return pa.table([ids, pa.array([len(t) for t in tokens], pa.int64()), pa.array(listed), pa.array(decoded)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", finish: Callable = plain, result: str = "tokens array<int>, text string") -> DataFrame:
    """Ids of every whole text and the text decoded from them, or what ``finish`` makes of both.

    path: vocabulary file of a byte-level tokenizer.  finish(ids, tokens, encoder) returns a table of the id column and
    the columns of ``result`` for the documents of a block.
    """
    B.small_batches(docs.sparkSession)
    n = B.shards(docs.sparkSession, 1)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *T.StructType.fromDDL(result)])
    arrow = pa.schema([pa.field(id_col, _arrow(kind)), *(pa.field(f.name, _arrow(f.dataType)) for f in schema[1:])])
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = narrow.mapInArrow(lambda it: cut(it, n), WIRE)
    back = sent.groupBy("shard").applyInArrow(lambda t: encode_shard(t, path), WIRE)
    return back.groupBy("block").applyInArrow(lambda t: assemble(t, path, lambda *a: finish(*a).rename_columns(arrow.names), arrow), schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)

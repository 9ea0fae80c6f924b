"""Language-model scores with an Elias-Fano bigram trie in shards.

The model is a bigram model with Dirichlet smoothing: P(w | c) = (n(c, w) + MU * p(w)) / (n(c) + MU), where p is the
additive unigram estimate (count + 0.1) / (N + 0.1 * (V + 1)), also the base score.  Each P(. | c) sums to one over the
V training tokens and one unknown token.  A text is read from a start mark to an end token.

Nothing of the model is ever in one place.  Blocks of documents keep their words as local numbers.  Each block sends its
vocabulary to word shards, which add up the training counts and answer with a global number and the count of each word.
Each block then sends its distinct word pairs, with training counts and the documents they stand in, to pair shards.  A
pair shard builds the trie of its pairs (log probabilities of 16 bits, levels memory-mapped from the task's own
temporary folder), looks up every pair, backs off for pairs that training has not seen, and answers with a sum for each
document.  A frequent word or pair is one row of a block, and pairs are dealt by both words, so a context that follows a
third of all tokens is spread over all shards.

Words are runs of bytes other than space and 0x09 to 0x0D with A-Z lower-cased; words and contexts are known by 64-bit
hashes.  A null text is empty and has only the end token; rows without id are learned from and scored; repeated rows
count as often as they stand; other columns are ignored; an empty table gives no rows.  A text of any length is read
whole by the task that has its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import blocks as B, hashing as H
from .bpe import _arrow
from .trie import Trie

MU = 500.0
BLOCK, SLAB = 13 << 20, 1 << 20
START, END, OWN = 0, 1, 2  # global numbers of the marks, and the first of a word
#: p(w) travels with a pair as log10 in steps of 1 / GRAIN.
GRAIN = 4096.0

COUNTED = "block long, head binary, size binary, body binary, words binary, seen binary, learned binary"
WIRE = "shard int, block long, body binary"
VOCAB = "shard int, block long, types long, tokens long, body binary"


def held_out(id_col: str = "doc_id", folds: int = 10, fold: int = 0) -> F.Column:
    """Whether crc32 of the id's decimal text falls in the fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return B.press(sink.getvalue().to_pybytes())


def _count(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Blocks: local numbers of all words (frequent words have small ones), and the vocabulary by (shard, hash)."""
    number = B.numbered()
    for batch in batches:
        raw_all, offs_all = B.flat(batch["text"])
        for lo, hi in B.cuts(offs_all, BLOCK):
            offsets = offs_all[lo : hi + 1]
            found = [H.words(raw_all[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in B.cuts(offsets - offsets[0], SLAB)]
            h = np.concatenate([x for x, _ in found])
            size = np.concatenate([np.diff(at) for _, at in found])
            held = batch["held"].slice(lo, hi - lo).to_numpy(zero_copy_only=False)
            words, local = np.unique(h, return_inverse=True)
            order = np.lexsort((words, words % np.uint64(shards)))
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            words, local = words[order], place[local]
            seen = np.bincount(local, minlength=len(words))
            learned = np.bincount(local, ~np.repeat(held, size), len(words)).astype(np.int64)
            rank = _rank(seen)
            yield pa.record_batch(
                [
                    pa.array([number()]), *(pa.array([x], pa.binary()) for x in (
                        _ipc(pa.record_batch([batch["id"].slice(lo, hi - lo), pa.array(held)], ["id", "held"])),
                        B.planes(size.astype(np.uint32)), B.planes(rank[local].astype(np.uint32)), words.tobytes(),
                        B.planes(seen.astype(np.uint32)), B.planes(learned.astype(np.uint32)),
                    )),
                ],
                ["block", "head", "size", "body", "words", "seen", "learned"],
            )
        B.trim()


def _rank(seen: np.ndarray) -> np.ndarray:
    rank = np.empty(len(seen), np.int64)
    rank[np.argsort(-seen, kind="stable")] = np.arange(len(seen))
    return rank


def _ask(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """A block's words and training counts, to each word shard."""
    for b in batches:
        for block, words, learned in zip(b["block"].to_pylist(), b["words"], b["learned"], strict=True):
            w, n = np.frombuffer(words.as_py(), np.uint64), B.unplanes(learned.as_py(), np.uint32)
            edge = np.searchsorted(w % np.uint64(shards), np.arange(shards + 1))
            rows = [(s, block, B.press(w[x:y]) + B.planes(n[x:y]), y - x) for s, (x, y) in enumerate(zip(edge.tolist(), edge[1:].tolist())) if x < y]
            if rows:
                out = [(s, block, np.uint32(y).tobytes() + p) for s, block, p, y in rows]
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["shard", "block", "body"])


def _asked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(body[:4], "little")
    import zstandard

    d = zstandard.ZstdDecompressor().decompressobj()
    w = np.frombuffer(d.decompress(body[4:]), np.uint64)
    assert len(w) == n
    return w, B.unplanes(d.unused_data, np.uint32)


def _number(table: pa.Table, shards: int) -> pa.Table:
    """Answers of a word shard: global number and training count of each word asked for; types and tokens of the shard."""
    shard = table["shard"][0].as_py()
    asked = [_asked(x) for x in table["body"].to_pylist()]
    words, back = np.unique(np.concatenate([w for w, _ in asked]), return_inverse=True)
    count = np.bincount(back, np.concatenate([n for _, n in asked]), len(words)).astype(np.int64)
    order = np.lexsort((words, -count))
    number = np.empty(len(words), np.int64)
    number[order] = OWN + np.arange(len(words)) * shards + shard
    out, at = [], 0
    for w, _ in asked:
        k = back[at : at + len(w)]
        at += len(w)
        ids, n = B.planes(number[k].astype(np.uint64)), B.planes(count[k].astype(np.uint64))
        out.append(np.uint32(len(ids)).tobytes() + ids + n)
    types, tokens = int((count > 0).sum()), int(count.sum())
    m = len(out)
    B.trim()
    return pa.table([table["shard"], table["block"], pa.array([types] * m, pa.int64()), pa.array([tokens] * m, pa.int64()), pa.array(out, pa.binary())], ["shard", "block", "types", "tokens", "body"])


def _pairs(shards: int, n: int, v: int, docs: int, mu: float):
    """cogroup: a block and the answers for its words; makes its documents' base sums and its pairs for each shard."""
    total = n + 0.1 * (v + 1)

    def make(key, left: pa.Table, right: pa.Table) -> pa.Table:
        block = left["block"][0].as_py()
        get = lambda c: left[c][0].as_py()
        size, seen = B.unplanes(get("size"), np.uint32).astype(np.int64), B.unplanes(get("seen"), np.uint32)
        head = pa.ipc.open_stream(B.unpress(get("head"))).read_all()
        held = head["held"].to_numpy()
        number, count = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
        at = 0
        for _, body in sorted(zip(right["shard"].to_pylist(), right["body"].to_pylist(), strict=True)):
            k = 4 + int.from_bytes(body[:4], "little")
            ids = B.unplanes(body[4:k], np.uint64)
            number[at : at + len(ids)], count[at : at + len(ids)] = ids, B.unplanes(body[k:], np.uint64)
            at += len(ids)
        assert at == len(seen)
        of_rank = np.argsort(-seen.astype(np.int64), kind="stable")
        local = of_rank[B.unplanes(get("body"), np.uint32)]
        # tokens with their ends: a start mark is only a context, an end only a word
        d = len(size)
        ends = np.cumsum(size + 1) - 1
        word, known = np.full(int((size + 1).sum()), END, np.int64), np.full(int((size + 1).sum()), docs, np.int64)
        body = np.ones(len(word), bool)
        body[ends] = False
        word[body], known[body] = number[local], count[local]
        doc = np.repeat(np.arange(d), size + 1)
        base = np.bincount(doc, np.log10((known + 0.1) / total), d)
        n_known = np.bincount(doc, known > 0, d).astype(np.int64)
        context, room = np.roll(word, 1), np.roll(known, 1)
        starts = ends - size
        context[starts], room[starts] = START, docs
        facts = np.stack([size + 1, n_known], 1).astype(np.int64).tobytes() + base.tobytes()
        rows = [(-1 - int(block % shards), block, np.uint32(d).tobytes() + B.press(facts) + get("head"))]
        shard = (H.mix(context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        train = ~held[doc]
        code = np.rint(-np.log10((known + 0.1) / total) * GRAIN).astype(np.uint32)
        room, doc = room.astype(np.uint64), doc.astype(np.uint32)
        del known, body, local
        order = np.lexsort((word, context, shard.astype(np.int32))).astype(np.int32)  # stable: documents stay in order
        edge = np.searchsorted(shard[order], np.arange(shards + 1))
        for s, (x, y) in enumerate(zip(edge.tolist(), edge[1:].tolist())):
            o = order[x:y]
            if not len(o):
                continue
            c, w = context[o], word[o]
            new = np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1]))
            first = np.flatnonzero(new)
            fresh = np.append(True, np.diff(c[first]) != 0)  # a context's first pair
            times = np.add.reduceat(train[o].astype(np.int64), first)
            parts = [
                np.diff(c[first][fresh], prepend=0).astype(np.uint64), room[o][first][fresh], np.diff(np.append(np.flatnonzero(fresh), len(first))).astype(np.uint32),
                w[first].astype(np.uint64), code[o][first], times.astype(np.uint32), np.diff(np.append(first, len(o))).astype(np.uint32), doc[o].astype(np.uint32),
            ]
            packed = [B.planes(p) for p in parts]
            rows.append((s, block, np.array([len(p) for p in packed], np.uint32).tobytes() + b"".join(packed)))
        B.trim()
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["shard", "block", "body"])

    return make


def _unpacked(body: bytes) -> list[np.ndarray]:
    sizes = np.frombuffer(body[:32], np.uint32)
    at = np.append(32, 32 + np.cumsum(sizes, dtype=np.int64)).tolist()
    kinds = (np.uint64, np.uint64, np.uint32, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32)
    delta, room, width, w, code, times, occurs, doc = (B.unplanes(body[a:b], k) for a, b, k in zip(at, at[1:], kinds, strict=False))
    c = np.repeat(np.cumsum(delta.astype(np.int64)), width)
    return [c, np.repeat(room, width).astype(np.float64), w.astype(np.int64), code / -GRAIN, times.astype(np.int64), occurs.astype(np.int64), doc]


def _score_shard(mu: float):
    def score(table: pa.Table) -> pa.Table:
        if table["shard"][0].as_py() < 0:
            return table
        got = [_unpacked(x) for x in table["body"].to_pylist()]
        c, room, w, p, times = (np.concatenate([g[k] for g in got]) for k in range(5))
        order = np.lexsort((w, c))
        c, room, w, p, times = (x[order] for x in (c, room, w, p, times))
        first = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])))
        n = np.add.reduceat(times, first)
        kept = n > 0
        f = first[kept]
        trie = Trie(c[f], w[f], np.log10((n[kept] + mu * 10 ** p[f]) / (room[f] + mu)))
        try:
            # distinct pairs once; each block's copies take the same answer
            hit, value = trie.find(c[first], w[first])
            answer = np.where(hit, value, np.log10(mu) + p[first] - np.log10(room[first] + mu))
        finally:
            trie.close()
        each = np.empty(len(c))
        each[order] = np.repeat(answer, np.diff(np.append(first, len(c))))
        out, at = [], 0
        for g in got:
            m = len(g[0])
            total = np.bincount(g[6], np.repeat(each[at : at + m], g[5]))
            at += m
            on = np.flatnonzero(np.bincount(g[6]))
            ids = B.planes(np.diff(on, prepend=0).astype(np.uint32))
            out.append(np.uint32(len(ids)).tobytes() + ids + total[on].tobytes())
        del got, c, room, w, p, times
        B.trim()
        return pa.table([table["shard"], table["block"], pa.array(out, pa.binary())], ["shard", "block", "body"])

    return score


def _joined(tokens: int, arrow: pa.Schema):
    def join(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["shard"].to_pylist(), table["body"].to_pylist(), strict=True))
        head = rows[0][1]
        d = int.from_bytes(head[:4], "little")
        import zstandard

        z = zstandard.ZstdDecompressor().decompressobj()
        facts = z.decompress(head[4:])
        ids = pa.ipc.open_stream(B.unpress(z.unused_data)).read_all()
        counts = np.frombuffer(facts, np.int64, 2 * d).reshape(d, 2)
        base, score = np.frombuffer(facts, np.float64, d, 16 * d), np.zeros(d)
        for _, body in rows[1:]:
            k = 4 + int.from_bytes(body[:4], "little")
            on = np.cumsum(B.unplanes(body[4:k], np.uint32).astype(np.int64))
            score[on] += np.frombuffer(body[k:], np.float64)
        return pa.table([ids["id"], ids["held"], pa.array(counts[:, 0].copy()), pa.array(counts[:, 1].copy()), pa.array(np.full(d, tokens)), pa.array(base.copy()), pa.array(score)], arrow.names).cast(arrow)

    return join


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu: float = MU) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; held-out ones aren't learned."""
    spark = docs.sparkSession
    B.small_batches(spark)
    shards, pair_shards = B.shards(spark, 1), B.shards(spark, 2)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held"), F.col(text_col).cast("string").alias("text"))
    blocks = B.stored(rows.mapInArrow(lambda it: _count(it, shards), COUNTED), "none")
    asked = blocks.select("block", "words", "learned").mapInArrow(lambda it: _ask(it, shards), WIRE)
    vocab = B.stored(asked.groupBy("shard").applyInArrow(lambda t: _number(t, shards), VOCAB), "none")
    sums = vocab.groupBy("shard").agg(F.first("types").alias("v"), F.first("tokens").alias("n")).agg(F.sum("v"), F.sum("n")).first()
    n_docs = rows.filter("not held").count()
    v, n = int(sums[0] or 0) + (n_docs > 0), int(sums[1] or 0) + n_docs
    pairs = blocks.select("block", "head", "size", "body", "seen").groupBy("block").cogroup(vocab.select("block", "shard", "body").groupBy("block")).applyInArrow(_pairs(pair_shards, n, v, n_docs, mu), WIRE)
    sums = pairs.groupBy("shard").applyInArrow(_score_shard(mu), WIRE)
    fields = [T.StructField(id_col, kind), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))]
    schema = T.StructType(fields)
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in schema])
    return sums.groupBy("block").applyInArrow(_joined(n, arrow), schema)

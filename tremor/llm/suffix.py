"""Removal of repeated passages with a sparse suffix array in range-partitioned buckets.

A byte goes if some string of length bytes (LENGTH, if nothing else is asked for) over it also starts anywhere else in the
corpus.  Sorting the suffix of every
byte is not needed: every string of length bytes (a window) names one place inside itself by its own bytes alone, the
leftmost smallest hash of GRAM bytes, so equal windows name the same place of equal text.  Neighbouring windows mostly
name the same place; a run of them is a *region*, about one for every 190 bytes at 400, and only suffixes that start at a
region's place are sorted.

1. Blocks list their regions.  For each distinct gram of a place a block sends one entry to the gram's shard; the shard
   answers whether the gram is alone, whether all its regions everywhere have the same bytes (then every window of them
   repeats and no suffix is needed), or whether they differ.
2. For grams whose regions differ, a block sends each distinct region: the suffix from its place on and the bytes before
   it.  Sampled splitters deal suffixes to ranges by their leading bytes (a salt splits runs of equal leading bytes).
3. A bucket sorts its suffixes by multikey quicksort with digits of eight bytes, which also gives the longest common
   prefixes; these bound which windows can repeat at all, and windows that can are compared.  A run of equal leading
   bytes that touches a bucket's end may go on in the next one: its windows that have not met an equal one, and one of
   each kind that have, are compared across all buckets by their hashes.
4. Blocks take the answers, mark the windows and cut the bytes.

Equality of grams' regions and of windows is by 64-bit hashes besides the 64-bit hash of the gram (128 bits together).
Matches never cross documents.  A null text is empty; texts under length bytes are never cut; a document that repeats
another one goes as a whole; null or repeated ids are rows like any other; an empty table gives no rows.  A task holds a
block (or one longer text) or a bucket.  A passage in any part of all documents is one entry of a block for each gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import blocks as B, hashing as H
from .bpe import _arrow

LENGTH, GRAM = 400, 32
#: A repeated passage of over so many words counts, however short they are.
WORDS = 50
BLOCK, SLAB = 1 << 20, 1 << 18
LEAD = 64
#: Of the compression of texts, which are stored once and dealt twice.
LEVEL = 6

TABLE = "block long, head binary, size binary, text binary, first array<binary>, last array<binary>, place array<binary>"
WIRE = "shard int, block long, body binary"
SUFFIX = "which int, block long, region int, twice boolean, before binary, lead binary, suffix binary, starts int, salt int"


def regions(raw: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...] = (LENGTH,)) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first and last window start and place of each region of all texts."""
    out: list[list[tuple]] = [[] for _ in lengths]
    for lo, hi in B.cuts(offsets, SLAB):
        at, o = int(offsets[lo]), offsets[lo : hi + 1] - offsets[lo]
        part = raw[at : offsets[hi]]
        n, have = len(part), 1
        if n < min(lengths):
            continue
        bits = np.uint64(max(20, int(n).bit_length()))
        low = H.windows(H.prefixes(part), GRAM)
        low = (low >> bits << bits) | np.arange(len(low), dtype=np.uint64)  # smallest hash, then leftmost
        for which in np.argsort(lengths, kind="stable").tolist():
            length = lengths[which]
            if n < length:
                break
            width = length - GRAM + 1
            while 2 * have <= width:  # the smallest of ``have`` neighbours, for ever more of them
                low = np.minimum(low[: len(low) - have], low[have:])
                have *= 2
            if have < width:
                low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
                have = width
            place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int32 if n < 1 << 31 else np.int64)
            valid = np.zeros(len(place) + 1, np.int32)  # windows inside one text
            full = np.flatnonzero(np.diff(o) >= length)
            np.add.at(valid, o[:-1][full], 1)
            np.add.at(valid, o[1:][full] - length + 1, -1)
            on = np.cumsum(valid[:-1], dtype=np.int32) > 0
            same = place[1:] == place[:-1]
            new = on.copy()
            new[1:] &= ~(on[:-1] & same)
            end = on.copy()
            end[:-1] &= ~(on[1:] & same)
            a, b = np.flatnonzero(new), np.flatnonzero(end)
            out[which].append((a + at, b + at, place[a].astype(np.int64) + at))
    return [tuple(np.concatenate(x) for x in zip(*own, strict=True)) if own else (np.zeros(0, np.int64),) * 3 for own in out]


def _kinds(raw: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Distinct regions: gram and bytes' hash of each (ascending by gram), one region of each, how many, and each region's kind."""
    gram, whole = np.empty(len(first), np.uint64), np.empty(len(first), np.uint64)
    step = max(1, SLAB // 128)
    for lo in range(0, len(first), step):  # prefix sums over a stretch of text at a time
        s = slice(lo, lo + step)
        a, b = int(first[s].min()), int(last[s].max()) + length
        p = H.prefixes(raw[a:b])
        gram[s] = H.spans(p, place[s] - a, place[s] - a + GRAM)
        whole[s] = H.mix(H.spans(p, first[s] - a, last[s] - a + length) ^ H.mix(((place[s] - first[s]) << 32 | (last[s] - first[s])).astype(np.uint64)))
    order = np.lexsort((whole, gram))
    g, w = gram[order], whole[order]
    new = np.append(True, (g[1:] != g[:-1]) | (w[1:] != w[:-1]))[: len(g)]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return g[at], w[at], order[at], np.diff(np.append(at, len(g))), kind


def _table(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    number = B.numbered()
    for batch in batches:
        raw_all, offs_all = B.flat(batch["text"])
        for lo, hi in B.cuts(offs_all, BLOCK):
            offsets = offs_all[lo : hi + 1] - offs_all[lo]
            raw = raw_all[offs_all[lo] : offs_all[hi]]
            spots = regions(raw, offsets, lengths)
            sink = pa.BufferOutputStream()
            head = batch.slice(lo, hi - lo).drop_columns(["text"])
            with pa.ipc.new_stream(sink, head.schema) as w:
                w.write_batch(head)
            put = [B.press(sink.getvalue().to_pybytes()), B.planes(np.diff(offsets).astype(np.uint64)), B.press(raw, LEVEL)]
            each = [[B.planes(np.diff(f, prepend=0)) for f, _, _ in spots], [B.planes(t - f) for f, t, _ in spots], [B.planes(p - f) for f, _, p in spots]]
            yield pa.record_batch([pa.array([number()]), *(pa.array([x], pa.binary()) for x in put), *(pa.array([x], pa.list_(pa.binary())) for x in each)], ["block", "head", "size", "text", "first", "last", "place"])
        B.trim()


def _opened(row: dict) -> Iterator[tuple[np.ndarray, ...]]:
    """For each length: the block's bytes, and first window, last window and place of its regions."""
    raw = B.unpress(row["text"], np.uint8)
    for first, last, place in zip(row["first"], row["last"], row["place"], strict=True):
        first = np.cumsum(B.unplanes(first, np.int64))
        yield raw, first, first + B.unplanes(last, np.int64), first + B.unplanes(place, np.int64)


def _by_gram(gram: np.ndarray) -> np.ndarray:
    """First kind of each distinct gram."""
    return np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])


def _grams(batches: Iterator[pa.RecordBatch], shards: int, lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """One entry for each distinct gram of a block: gram, hash of its regions (0: they differ), whether it is there twice.
    Each length has shards of its own."""
    for batch in batches:
        for row in batch.to_pylist():
            for which, (opened, length) in enumerate(zip(_opened(row), lengths, strict=True)):
                gram, whole, _, many, _ = _kinds(*opened, length)
                if not len(gram):
                    continue
                at = _by_gram(gram)
                kinds = np.diff(np.append(at, len(gram)))
                one = np.where(kinds == 1, whole[at] | np.uint64(1), np.uint64(0))
                twice = np.add.reduceat(many, at) > 1
                shard = (gram[at] % np.uint64(shards)).astype(np.int64)
                out = []
                for s in np.unique(shard).tolist():
                    o = np.flatnonzero(shard == s)
                    out.append((which * shards + s, row["block"], np.uint32(len(o)).tobytes() + gram[at][o].tobytes() + one[o].tobytes() + np.packbits(twice[o]).tobytes()))
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["shard", "block", "body"])
        B.trim()


def _judge(table: pa.Table) -> pa.Table:
    """A code for each entry of each block: 0 the gram is alone, 1 all its regions are equal, 2 they differ."""
    got = []
    for body in table["body"].to_pylist():
        n = int.from_bytes(body[:4], "little")
        got.append((np.frombuffer(body, np.uint64, n, 4), np.frombuffer(body, np.uint64, n, 4 + 8 * n), np.unpackbits(np.frombuffer(body, np.uint8, offset=4 + 16 * n))[:n]))
    gram, one, twice = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(gram, kind="stable")
    at = _by_gram(gram[order])
    least, most = np.minimum.reduceat(one[order], at), np.maximum.reduceat(one[order], at)
    count = np.add.reduceat(twice[order].astype(np.int64) + 1, at)
    code = np.where(count < 2, 0, np.where((least == most) & (least > 0), 1, 2)).astype(np.uint8)
    each = np.empty(len(gram), np.uint8)
    each[order] = np.repeat(code, np.diff(np.append(at, len(gram))))
    out, k = [], 0
    for g, _, _ in got:
        out.append(B.press(each[k : k + len(g)]))
        k += len(g)
    B.trim()
    return pa.table([table["shard"], table["block"], pa.array(out, pa.binary())], ["shard", "block", "body"])


def _codes(gram: np.ndarray, answers: pa.Table, shards: int, which: int) -> np.ndarray:
    """The answer for each kind of a block, from the shards of one length."""
    own = answers["shard"].to_numpy()
    answers = answers.filter(pa.array((own >= which * shards) & (own < (which + 1) * shards)))
    at = _by_gram(gram)
    shard = (gram[at] % np.uint64(shards)).astype(np.int64)
    code = np.zeros(len(at), np.uint8)
    for s, body in zip(answers["shard"].to_pylist(), answers["body"].to_pylist(), strict=True):
        code[np.flatnonzero(shard == s - which * shards)] = B.unpress(body, np.uint8)
    return np.repeat(code, np.diff(np.append(at, len(gram))))


def _suffixes(shards: int, lengths: tuple[int, ...]):
    """cogroup: a block and its answers; the distinct regions whose grams have differing regions."""

    def make(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row, out = left.to_pylist()[0], []
        text = B.unpress(row["text"])
        for which, ((raw, first, last, place), length) in enumerate(zip(_opened(row), lengths, strict=True)):
            gram, _, rep, many, _ = _kinds(raw, first, last, place, length)
            send = np.flatnonzero(_codes(gram, right, shards, which) == 2)
            a, b, p = (x[rep[send]].tolist() for x in (first, last, place))
            n = len(send)
            out.append(
                pa.table(
                    [
                        pa.array(np.full(n, which, np.int32)), pa.array(np.full(n, row["block"], np.int64)), pa.array(send.astype(np.int32)), pa.array(many[send] > 1), pa.array([text[i:k] for i, k in zip(a, p)], pa.binary()),
                        pa.array([text[k : min(k + LEAD, j + length)] for j, k in zip(b, p)], pa.binary()), pa.array([text[k : j + length] for j, k in zip(b, p)], pa.binary()),
                        pa.array([j - i + 1 for i, j in zip(a, b)], pa.int32()), pa.array((H.mix(send.astype(np.uint64) + np.uint64(row["block"] * 7919 % (1 << 62))) % np.uint64(1 << 30)).astype(np.int32)),
                    ],
                    ["which", "block", "region", "twice", "before", "lead", "suffix", "starts", "salt"],
                )
            )
        B.trim()
        return pa.concat_tables(out)

    return make


def multikey(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and each one's longest common prefix (in bytes) with a neighbour in that order.

    Multikey quicksort with digits of eight bytes: only runs that still are equal look at their next digit.  A string is
    taken as if zero bytes followed it; common prefixes do not count those.
    """
    n = len(strings)
    size = np.array([len(x) for x in strings], np.int64)
    digits = -(-int(size.max()) // 8) if n else 0
    padded = b"".join([x + bytes(8 * digits - len(x)) for x in strings])
    word = np.frombuffer(padded, ">u8").reshape(n, digits).astype(np.uint64) if digits else np.zeros((n, 0), np.uint64)
    order, run = np.arange(n), np.zeros(n, np.int64)  # run: number of each place's run, ascending
    todo = np.arange(n)  # places whose run has more than one string
    common = np.zeros(max(0, n - 1), np.int64)  # with the next place
    for d in range(digits):
        if not len(todo):
            break
        v = word[order[todo], d]
        o = np.lexsort((v, run[todo]))
        order[todo], v = order[todo][o], v[o]
        same = (run[todo][1:] == run[todo][:-1]) if len(todo) > 1 else np.zeros(0, bool)
        equal = same & (v[1:] == v[:-1])
        apart = np.flatnonzero(same & ~equal)
        x = v[apart] ^ v[apart + 1]
        common[todo[apart]] = 8 * d + (x.astype(">u8").view(np.uint8).reshape(-1, 8) > 0).argmax(axis=1)
        common[todo[np.flatnonzero(equal)]] = 8 * d + 8
        cut = np.append(True, ~equal)
        run[todo] = todo[np.flatnonzero(cut)][np.cumsum(cut) - 1]
        held = ~cut | np.append(equal, False)
        todo = todo[held]
    if n > 1:
        common = np.minimum(common, np.minimum(size[order[1:]], size[order[:-1]]))
    most = np.zeros(n, np.int64)
    most[:-1] = common
    most[1:] = np.maximum(most[1:], common)
    return order, most


def _buckets(batches: Iterator[pa.RecordBatch], shards: int, lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """A range's suffixes: those of each length are a bucket."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    del held
    which = table["which"].to_numpy()
    for k in np.unique(which).tolist():
        yield from _bucket(table.filter(pa.array(which == k)), k, shards, lengths[k])
    del table
    B.trim()


def _bucket(table: pa.Table, which: int, shards: int, length: int) -> Iterator[pa.RecordBatch]:
    """Sort suffixes and compare their windows. Out: answers to blocks (shard -1 - which), windows that others may have."""
    block, region, starts = (table[c].to_numpy() for c in ("block", "region", "starts"))
    twice = table["twice"].to_numpy()
    before, suffix = table["before"].to_pylist(), table["suffix"].to_pylist()
    del table
    order, common = multikey(suffix)
    gram = np.array([x[:GRAM] for x in suffix], f"S{GRAM}")[order]  # a trailing zero byte only joins runs
    raw_gram = [suffix[k][:GRAM] for k in order.tolist()]
    run_at = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    run = np.repeat(np.arange(len(run_at)), np.diff(np.append(run_at, len(gram))))
    # every region's windows, in sorted order: row, offset from the place, hash
    text = np.frombuffer(b"".join([before[k] + suffix[k] for k in order.tolist()]), np.uint8)
    left = np.array([len(before[k]) for k in order.tolist()], np.int64)
    size = left + np.array([len(suffix[k]) for k in order.tolist()], np.int64)
    n = starts[order].astype(np.int64)
    at = np.cumsum(size) - size
    out: list[tuple[int, int, bytes]] = []
    found_row, found_start = [], []
    for lo, hi in _stretches(run_at, n, len(order)):
        rows = np.arange(lo, hi)
        row = np.repeat(rows, n[rows])
        start = np.arange(len(row)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
        offset = left[row] - start  # bytes of the window before the place
        edge = (run[row] == 0) | (run[row] == run[-1])
        # a window reaches length - offset bytes into the suffix: no neighbour shares that much, no equal window
        may = edge | twice[order[row]] | (length - offset <= common[row])
        row, start, offset, edge = row[may], start[may], offset[may], edge[may]
        if not len(row):
            continue
        a = int(at[lo])
        s = H.prefixes(text[a : int(at[hi - 1] + size[hi - 1])])
        x = at[row] - a + start
        h = H.mix(H.spans(s, x, x + length) ^ H.mix((offset.astype(np.uint64) << np.uint64(32)) + np.uint64(5)))
        o = np.lexsort((h, run[row]))
        r, v = run[row][o], h[o]
        new = np.append(True, (r[1:] != r[:-1]) | (v[1:] != v[:-1]))
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(o)))
        again = np.add.reduceat(twice[order[row[o]]].astype(np.int64), first) + many > 1
        hit = np.empty(len(o), bool)
        hit[o] = np.repeat(again, many)
        found_row.append(row[hit])
        found_start.append(start[hit])
        # windows of runs that may go on elsewhere: one of each kind
        go = first[edge[o[first]]]
        pick = o[go]
        if len(pick):
            names = {}
            for k in np.unique(run[row[pick]]).tolist():
                names[k] = int.from_bytes(hashlib.blake2b(raw_gram[run_at[k]], digest_size=8).digest(), "little")
            key = H.mix(np.array([names[k] for k in run[row[pick]].tolist()], np.uint64) ^ h[pick])
            shard = (key % np.uint64(shards)).astype(np.int64)
            for q in np.unique(shard).tolist():
                w = np.flatnonzero(shard == q)
                k = order[row[pick[w]]]
                out.append((which * shards + q, 0, _wide(key[w], again[np.searchsorted(first, go[w])], block[k], region[k], start[pick[w]])))
    if found_row:
        row, start = np.concatenate(found_row), np.concatenate(found_start)
        out += _answers(which, block[order[row]], region[order[row]], start)
    for lo in range(0, len(out), 500):
        yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out[lo : lo + 500], strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["shard", "block", "body"])


def _stretches(run_at: np.ndarray, n: np.ndarray, total: int, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of whole runs with about ``most`` windows each."""
    ends = np.append(run_at[1:], total)
    upto = np.cumsum(n)
    lo = 0
    for e in ends.tolist():
        if upto[e - 1] - (upto[lo - 1] if lo else 0) >= most or e == total:
            yield lo, e
            lo = e


def _wide(key: np.ndarray, met: np.ndarray, block: np.ndarray, region: np.ndarray, start: np.ndarray) -> bytes:
    parts = [B.press(key), B.press(met.astype(np.uint8)), B.planes(block.astype(np.int64)), B.planes(region.astype(np.int32)), B.planes(start.astype(np.int32))]
    return np.array([len(p) for p in parts], np.uint32).tobytes() + b"".join(parts)


def _answers(which: int, block: np.ndarray, region: np.ndarray, start: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Repeated windows for each block: (kind of region, window) pairs."""
    if not len(block):
        return []
    o = np.lexsort((start, region, block))
    edge = np.flatnonzero(np.append(True, np.diff(block[o]) != 0))
    out = []
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(o)]):
        k = o[a:b]
        one, two = B.planes(region[k].astype(np.int32)), B.planes(start[k].astype(np.int32))
        out.append((-1 - which, int(block[k[0]]), np.uint32(len(one)).tobytes() + one + two))
    return out


def _across(table: pa.Table, shards: int) -> pa.Table:
    """Windows of different buckets with the same gram, offset and bytes; answers pass through."""
    own = table["shard"][0].as_py()
    if own < 0:
        return table
    got = []
    for body in table["body"].to_pylist():
        at = np.append(20, 20 + np.cumsum(np.frombuffer(body[:20], np.uint32), dtype=np.int64)).tolist()
        p = [body[a:b] for a, b in zip(at, at[1:])]
        got.append((B.unpress(p[0], np.uint64), B.unpress(p[1], np.uint8), B.unplanes(p[2], np.int64), B.unplanes(p[3], np.int32), B.unplanes(p[4], np.int32)))
    key, met, block, region, start = (np.concatenate(x) for x in zip(*got, strict=True))
    _, back, many = np.unique(key, return_inverse=True, return_counts=True)
    hit = (many[back] > 1) & (met == 0)
    out = _answers(own // shards, block[hit], region[hit], start[hit])
    return pa.table([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["shard", "block", "body"])


def _gone(row: dict, right: pa.Table, shards: int, which: int, opened: tuple, length: int) -> np.ndarray:
    """Which bytes of a block are in windows of the length that repeat."""
    raw, first, last, place = opened
    gram, _, _, many, kind = _kinds(raw, first, last, place, length)
    code = _codes(gram, right, shards, which)
    dup = np.zeros(len(raw) + 1, np.int32)  # counts of window starts that repeat, as differences
    whole = np.flatnonzero((code == 1)[kind] | (many > 1)[kind])
    np.add.at(dup, first[whole], 1)
    np.add.at(dup, last[whole] + 1, -1)
    on = np.cumsum(dup[:-1], dtype=np.int32) > 0
    del dup
    members = np.argsort(kind, kind="stable")
    at = np.searchsorted(kind[members], np.arange(len(gram) + 1))
    for body in right.filter(pa.array(right["shard"].to_numpy() == -1 - which))["body"].to_pylist():
        k = 4 + int.from_bytes(body[:4], "little")
        region, start = B.unplanes(body[4:k], np.int32).astype(np.int64), B.unplanes(body[k:], np.int32)
        count = at[region + 1] - at[region]
        each = np.repeat(at[region] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        on[first[members[each]] + np.repeat(start, count)] = True
    seen = np.cumsum(on, dtype=np.int32)  # a byte goes if a repeated window starts in the length places up to it
    gone = seen > 0
    gone[length:] = seen[length:] > seen[:-length]
    return gone


def _cut(shards: int, finish: Callable, arrow: pa.Schema, lengths: tuple[int, ...]):
    def cut(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        gone = [_gone(row, right, shards, k, opened, length) for k, (opened, length) in enumerate(zip(_opened(row), lengths, strict=True))]
        offsets = np.concatenate([[0], np.cumsum(B.unplanes(row["size"], np.uint64).astype(np.int64))])
        head = pa.ipc.open_stream(B.unpress(row["head"])).read_all()
        B.trim()
        return finish(head, B.unpress(row["text"], np.uint8), offsets, *gone).rename_columns(arrow.names).cast(arrow)

    return cut


def spans(gone: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal removed runs within texts: text, start and end (in the text)."""
    new = gone.copy()
    new[1:] &= ~gone[:-1]
    end = gone.copy()
    end[:-1] &= ~gone[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(gone))]
    new[edge] |= gone[edge]
    end[edge - 1] |= gone[edge - 1]
    a, b = np.flatnonzero(new), np.flatnonzero(end) + 1
    text = np.searchsorted(offsets, a, side="right") - 1
    return text, a - offsets[text], b - offsets[text]


def texts(head: pa.Table, raw: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
    """The columns of head, then text (what is left; bytes of cut characters go too) and spans (removed [start, end))."""
    own, a, b = spans(gone, offsets)
    cut = np.searchsorted(own, np.arange(len(offsets)))
    left = [raw[x:y][~gone[x:y]].tobytes().decode("utf-8", "ignore") for x, y in zip(offsets.tolist(), offsets[1:].tolist())]
    runs = [list(map(list, zip(a[i:j].tolist(), b[i:j].tolist()))) for i, j in zip(cut.tolist(), cut[1:].tolist())]
    return pa.table([*head.columns, pa.array(left, pa.string()), pa.array(runs, pa.list_(pa.list_(pa.int64())))], [*head.column_names, "text", "spans"])


def digests(head: pa.Table, raw: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
    """The columns of head, n_bytes, n_removed, n_spans and the SHA-256 of what is left."""
    own, _, _ = spans(gone, offsets)
    n = len(offsets) - 1
    total = np.concatenate([[0], np.cumsum(gone, dtype=np.int64)])
    kept = [hashlib.sha256(raw[x:y][~gone[x:y]].tobytes()).hexdigest() for x, y in zip(offsets.tolist(), offsets[1:].tolist())]
    return pa.table([*head.columns, pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), pa.array(np.bincount(own, minlength=n)), pa.array(kept, pa.string())], [*head.column_names, "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _long(raw: np.ndarray, offsets: np.ndarray, gone: np.ndarray, size: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end (among all bytes) of the runs in gone that have size bytes or more than so many words."""
    own, a, b = spans(gone, offsets)
    a, b = a + offsets[own], b + offsets[own]
    black = (raw != 32) & ((raw < 9) | (raw > 13))
    new = black & np.append(True, ~black[:-1])[: len(raw)]
    upto = np.append(np.int32(0), np.cumsum(new, dtype=np.int32))  # a block's words are few
    count = upto[b] - upto[a] + (black[a] & ~new[a])
    on = (b - a >= size) | (count > words)
    return own[on], a[on], b[on]


def least_bytes(words: int) -> int:
    """The length that finds all repeats of over so many words: those of one byte each, with a byte between them."""
    return 2 * words + 1


def long_runs(size: int, words: int, finish: Callable = texts) -> Callable:
    """finish over those removed runs that have size bytes or more than so many words; shorter ones stay."""

    def of(head: pa.Table, raw: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
        _, a, b = _long(raw, offsets, gone, size, words)
        step = np.zeros(len(raw) + 1, np.int32)
        np.add.at(step, a, 1)
        np.add.at(step, b, -1)
        return finish(head, raw, offsets, np.cumsum(step[:-1], dtype=np.int32) > 0)

    return of


def digests_and_passages(size: int, words: int) -> Callable:
    """For two lengths: digests of the first, and n_passages and passage_bytes, the number and bytes of the second's runs
    with size bytes or more than so many words."""

    def of(head: pa.Table, raw: np.ndarray, offsets: np.ndarray, gone: np.ndarray, short: np.ndarray) -> pa.Table:
        own, a, b = _long(raw, offsets, short, size, words)
        n = len(offsets) - 1
        out = digests(head, raw, offsets, gone)
        out = out.append_column("n_passages", pa.array(np.bincount(own, minlength=n)))
        return out.append_column("passage_bytes", pa.array(np.bincount(own, b - a, n).astype(np.int64)))

    return of


def remove_repeats(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", finish: Callable = texts, result: str = "text string, spans array<array<long>>", length: int | tuple[int, ...] = LENGTH
) -> DataFrame:
    """The columns of keep of every document and what finish makes of its text and of the bytes that go: those in strings of
    length bytes that repeat.  Several lengths share the blocks and their shuffles; finish then gets the bytes of each."""
    lengths = length if isinstance(length, tuple) else (length,)
    if min(lengths) <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    B.small_batches(docs.sparkSession)
    shards = B.shards(docs.sparkSession, 1)
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(text_col).cast("string").alias("text"), *kept)
    table = B.stored(rows.mapInArrow(lambda it: _table(it, lengths), TABLE), "none")
    own = ["block", "text", "first", "last", "place"]
    judged = B.stored(table.select(*own).mapInArrow(lambda it: _grams(it, shards, lengths), WIRE).groupBy("shard").applyInArrow(_judge, WIRE), "none")
    suffixes = table.select(*own).groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(_suffixes(shards, lengths), SUFFIX)
    # Kept as a table: dealing by ranges reads its rows twice, once for the sample of splitters.
    suffixes = B.stored(suffixes)
    dealt = suffixes.repartitionByRange(2 * shards * len(lengths), "which", "lead", "salt").drop("lead", "salt")
    found = dealt.mapInArrow(lambda it: _buckets(it, shards, lengths), WIRE).groupBy("shard", F.when(F.col("shard") < 0, F.col("block"))).applyInArrow(lambda t: _across(t.select(["shard", "block", "body"]), shards), WIRE)
    schema = T.StructType([*(docs.schema[c] for c in keep), *T.StructType.fromDDL(result)])
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in schema])
    return table.groupBy("block").cogroup(judged.unionByName(found).groupBy("block")).applyInArrow(_cut(shards, finish, arrow, lengths), schema)

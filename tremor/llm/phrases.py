"""Phrase collocation mining: n-gram counts by DuckDB in hash buckets, level by level, scored at their weakest cut.

Texts are cut into pieces, and identical pieces of a language become one piece with a multiplicity.  Blocks of pieces
keep their words as local numbers.  Level k works on phrases of k words that can still be frequent: a block sends each
distinct one, with its weight, to the bucket of its hash; a bucket adds weights up in DuckDB, out of core, and answers
with global numbers of the frequent ones.  A phrase of k + 1 words is the pair of its first and last k words, so it is
sent as a pair of numbers, and only if both are frequent: no phrase is more frequent than its parts, so none is lost,
and equality is exact at every level (words travel as text).

Counts of a phrase's parts come by shuffled lookups: each level asks the level below for its two halves of k - 1 words,
which hand on the counts of their own beginnings and ends.  The best of each language are ranked in two steps, first
within SALTS parts of a language.

A null language is ``und``; a null text has no pieces; repeated rows count as often as they stand; ids don't matter; a
piece of any length is read whole by the task that has it; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import contextlib
import shutil
import tempfile
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import blocks as B, hashing as H

BLOCK = 8 << 20
LONGEST, LEAST, BEST = 5, 100, 2000
SALTS = 32
#: What DuckDB holds before it spills to the task's own folder.
MEMORY = "192MB"

WIRE = "block long, shard int, body binary"
COUNTED = "block long, shard int, body binary, lang string, word string, l long, r long, num long, f long"
_NAMES = [x.split()[0] for x in COUNTED.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.string(), *[pa.int64()] * 4]
#: Rows of a chunk of DuckDB's results.
CHUNK = 1 << 17

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] += 32
_SHAPE[[*b".,;:!?", *range(0x0A, 0x0E)]] = 0x0A
_SHAPE[9] = 0x20


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, piece, n: a batch's distinct pieces, lower-cased, each with a line feed at its end."""
    for batch in batches:
        raw_all, offs_all = B.flat(batch["text"])
        for lo, hi in B.cuts(offs_all, BLOCK):
            raw, at = _SHAPE[raw_all[offs_all[lo] : offs_all[hi]]], offs_all[lo : hi + 1] - offs_all[lo]
            raw = np.insert(raw, at[1:], 0x0A)  # a text ends its last piece
            last = at[1:] + np.arange(1, hi - lo + 1)
            end = np.flatnonzero(raw == 0x0A) + 1
            start = np.append(0, end[:-1])
            solid = np.append(0, np.cumsum((raw != 0x0A) & (raw != 0x20)))
            on = solid[end] > solid[start]
            row = lo + np.searchsorted(last, end)
            offs = np.append(0, end).astype(np.int64)
            piece = pa.LargeStringArray.from_buffers(len(end), pa.py_buffer(offs), pa.py_buffer(raw)).filter(pa.array(on))
            table = pa.table([batch["lang"].take(pa.array(row[on])), piece], ["lang", "piece"])
            found = table.group_by(["lang", "piece"]).aggregate([([], "count_all")])
            for b in found.to_batches(1 << 16):
                yield pa.record_batch([b["lang"], b["piece"].cast(pa.string()), b["count_all"]], ["lang", "piece", "n"])
        B.trim()


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [B.planes(a) for a in arrays]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def _unpack(body: bytes, *kinds) -> list[np.ndarray]:
    at = 8 * len(kinds) + np.append(0, np.cumsum(np.frombuffer(body[: 8 * len(kinds)], np.int64)))
    return [B.unplanes(body[a:b], k) for a, b, k in zip(at.tolist(), at[1:].tolist(), kinds, strict=False)]


def _state(place: np.ndarray, own: np.ndarray, weight: np.ndarray) -> bytes:
    """Places (neighbours differ by one), local numbers and weights."""
    return _pack(np.diff(place, prepend=0).astype(np.uint32), own.astype(np.uint32), weight.astype(np.uint64))


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["block", "shard", "body"])


def _worded(block: int, table: pa.Table, shards: int) -> pa.RecordBatch:
    """State of a block of pieces, and its distinct words with weights for each shard; local numbers follow (shard, lang, word)."""
    raw, at = B.flat(table["piece"])
    solid = (raw != 0x0A) & (raw != 0x20)
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    start = np.flatnonzero(head)
    offs = np.append(0, np.cumsum(solid))[np.append(start, len(raw))].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offs), pa.py_buffer(raw[solid])).dictionary_encode()
    piece = np.searchsorted(at, start, side="right") - 1
    lang = table["lang"].combine_chunks().dictionary_encode()
    langs = [x.as_py() for x in lang.dictionary]
    v = len(words.dictionary)
    key, own = np.unique(lang.indices.to_numpy()[piece].astype(np.int64) * v + words.indices.to_numpy(), return_inverse=True)
    text, edge = B.flat(words.dictionary)
    s = H.prefixes(text)
    h = H.spans(s, edge[:-1], edge[1:])[key % v] ^ H.mix(np.array([zlib.crc32(x.encode()) for x in langs], np.uint64))[key // v]
    shard = (H.mix(h) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    local = np.empty(len(order), np.int64)
    local[order] = np.arange(len(order))
    own, key, shard = local[own], key[order], shard[order]
    weight = table["n"].to_numpy()[piece]
    total = np.zeros(len(key), np.int64)
    np.add.at(total, own, weight)
    rows = [(block, -1, _state(np.arange(len(start)) + piece, own, weight))]  # a new piece skips a place
    cut = np.searchsorted(shard, np.arange(shards + 1))
    for k, (x, y) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
        if x < y:
            part = pa.record_batch([lang.dictionary.take(pa.array(key[x:y] // v)).cast(pa.string()), words.dictionary.take(pa.array(key[x:y] % v)).cast(pa.string()), pa.array(total[x:y]), pa.array(np.arange(x, y))], ["lang", "word", "w", "pos"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_batch(part)
            rows.append((block, k, B.press(sink.getvalue().to_pybytes())))
    return _rows(rows)


def _blocks(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    number, held, size = B.numbered(), [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 1 << 14):
            b = batch.slice(lo, 1 << 14)
            held.append(b)
            size += b["piece"].get_total_buffer_size() * b.num_rows // max(1, batch.num_rows)
            if size >= BLOCK:
                yield _worded(number(), pa.Table.from_batches(held), shards)
                held, size = [], 0
                B.trim()
    if sum(b.num_rows for b in held):
        yield _worded(number(), pa.Table.from_batches(held), shards)


def _asked(body: bytes, level: int) -> pa.Table:
    """Columns of a bucket's request: what is asked for, weight, place in the block."""
    if level == 1:
        return pa.ipc.open_stream(B.unpress(body)).read_all()
    first, left, right, w = _unpack(body, np.uint64, np.int64, np.int64, np.uint64)
    pos = int(first[0]) + np.arange(len(w))
    return pa.table([np.cumsum(left), right, w.astype(np.int64), pos], ["l", "r", "w", "pos"])


@contextlib.contextmanager
def _database() -> Iterator[duckdb.DuckDBPyConnection]:
    folder = tempfile.mkdtemp(prefix="tremor-")
    con = duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": folder, "preserve_insertion_order": False})
    try:
        yield con
    finally:
        con.close()
        shutil.rmtree(folder, ignore_errors=True)


def _count(batches: Iterator[pa.RecordBatch], level: int, shards: int, least: int) -> Iterator[pa.RecordBatch]:
    """A partition's buckets: answers (block, shard, body: places and numbers of frequent ones), then the frequent ones
    with their counts; on level 1 also each language's number of words, as a row without number."""
    key = "lang, word" if level == 1 else "l, r"
    with _database() as con:
        con.execute(f"CREATE TABLE asked (shard INTEGER, block BIGINT, pos BIGINT, {'lang VARCHAR, word VARCHAR' if level == 1 else 'l BIGINT, r BIGINT'}, w BIGINT)")
        for batch in batches:
            for block, shard, body in zip(*(batch[c].to_pylist() for c in ("block", "shard", "body")), strict=True):
                con.register("part", _asked(body, level))
                con.execute(f"INSERT INTO asked SELECT {shard}, {block}, pos, {key}, w FROM part")
                con.unregister("part")
        con.execute(f"CREATE TABLE summed AS SELECT shard, {key}, CAST(sum(w) AS BIGINT) AS f FROM asked GROUP BY ALL")
        con.execute(f"CREATE TABLE known AS SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY {key}) - 1) * {shards} + shard AS num FROM summed WHERE f >= {least}")
        for rows in con.sql(f"SELECT block, shard, pos, num FROM asked JOIN known USING (shard, {key}) ORDER BY block, shard, pos").to_arrow_reader(CHUNK):
            yield from _answered(rows)
        nothing = "CAST(NULL AS BIGINT) AS block, CAST(NULL AS INTEGER) AS shard, CAST(NULL AS BLOB) AS body"
        own = "lang, word, CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS r" if level == 1 else "CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS VARCHAR) AS word, l, r"
        found = f"SELECT {nothing}, {own}, num, f FROM known"
        if level == 1:
            found += f" UNION ALL SELECT {nothing}, lang, NULL, NULL, NULL, NULL, CAST(sum(f) AS BIGINT) FROM summed GROUP BY lang"
        for rows in con.sql(found).to_arrow_reader(CHUNK):
            yield pa.RecordBatch.from_arrays([rows[n].cast(t) for n, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)
    B.trim()


def _answered(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of equal block and bucket as one row each; a run over a border of chunks is two rows."""
    block, shard, pos, num = (rows[c].to_numpy() for c in ("block", "shard", "pos", "num"))
    if not len(block):
        return
    edge = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (shard[1:] != shard[:-1])))
    body = [_pack(np.diff(pos[a:b], prepend=0).astype(np.uint64), num[a:b].astype(np.uint64)) for a, b in zip(edge.tolist(), np.append(edge[1:], len(block)).tolist())]
    n = len(edge)
    columns = [pa.array(block[edge]), pa.array(shard[edge]), pa.array(body, pa.binary())] + [pa.nulls(n, t) for t in _TYPES[3:]]
    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _longer(shards: int):
    """cogroup: a block's state and the answers for its phrases; its state of phrases one word longer, and what they ask."""

    def make(key, left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], t) for t in _TYPES[:3]], ["block", "shard", "body"])
        if not left.num_rows or not right.num_rows:
            return none
        block = left["block"][0].as_py()
        step, own, weight = _unpack(left["body"][0].as_py(), np.uint32, np.uint32, np.uint64)
        place = np.cumsum(step.astype(np.int64))
        number = np.full(int(own.max()) + 1, -1, np.int64)
        for body in right["body"].to_pylist():
            pos, num = _unpack(body, np.uint64, np.uint64)
            number[np.cumsum(pos.astype(np.int64))] = num.astype(np.int64)
        on = number[own] >= 0
        place, own, weight = place[on], own[on].astype(np.int64), weight[on].astype(np.int64)
        first = np.flatnonzero(place[1:] - place[:-1] == 1)
        if not len(first):
            return none
        place, weight = place[first], weight[first]
        pair, own = np.unique(own[first] * len(number) + own[first + 1], return_inverse=True)
        l, r = number[pair // len(number)], number[pair % len(number)]
        shard = (H.mix(l.astype(np.uint64) * np.uint64(H.STEP) + r.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((r, l, shard))
        local = np.empty(len(order), np.int64)
        local[order] = np.arange(len(order))
        own, l, r, shard = local[own], l[order], r[order], shard[order]
        total = np.zeros(len(order), np.int64)
        np.add.at(total, own, weight)
        rows = [(block, -1, _state(place, own, weight))]
        cut = np.searchsorted(shard, np.arange(shards + 1))
        for k, (x, y) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
            if x < y:
                rows.append((block, k, _pack(np.array([x], np.uint64), np.diff(l[x:y], prepend=0), r[x:y], total[x:y].astype(np.uint64))))
        B.trim()
        return pa.Table.from_batches([_rows(rows)])

    return make


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST) -> list[DataFrame]:
    """For each number of words, the phrases that occur ``least`` times: lang and word (one word) or l and r (longer ones:
    numbers of the first and the last words but one), num, f; rows without num: a language's number of words."""
    spark = docs.sparkSession
    B.small_batches(spark)
    shards = B.shards(spark, 1)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    pieces = rows.mapInArrow(_pieces, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    now = B.stored(pieces.mapInArrow(lambda it: _blocks(it, shards), WIRE), "none")
    out = []
    for level in range(1, longest + 1):
        asks = now.filter("shard >= 0").repartition(shards, "shard")
        found = B.stored(asks.mapInArrow(lambda it, level=level: _count(it, level, shards, least), COUNTED), "zstd")
        out.append(found.filter("block is null").select("lang", "word", "l", "r", "num", "f"))
        if level < longest:
            state = now.filter("shard = -1").groupBy("block")
            now = B.stored(state.cogroup(found.filter("block is not null").select("block", "shard", "body").groupBy("block")).applyInArrow(_longer(shards), WIRE), "none")
    return out


def _score(a: str, n: str, l: Column, r: Column) -> Column:
    """floor(1000 * a * n / (l * r)) in decimals of 38 digits: exact while 1000 * a * n has no more."""
    wide = lambda c: c.cast("decimal(19,0)")
    over = (F.col(a).cast("decimal(17,0)") * F.lit(1000).cast("decimal(4,0)") * F.col(n).cast("decimal(15,0)")).cast("decimal(38,0)")
    return F.call_function("div", over, (wide(l) * wide(r)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language that no longer one stands for.

    A phrase goes if it stands in a longer candidate that is as frequent; it is enough to look one word further, since
    what lies between them is as frequent too.
    """
    levels = counted(docs, text_col, lang_col, longest, least)
    words = levels[0].filter("num is not null")
    totals = levels[0].filter("num is null").groupBy("lang").agg(F.sum("f").alias("n"))
    # begins, ends: counts of the first and the last 1, 2, ... words
    parent = words.select("num", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("begins"), F.array("f").alias("ends"))
    found = None
    for k in range(2, longest + 1):
        own = levels[k - 1]
        left = parent.select(F.col("num").alias("l"), "lang", "phrase", "begins")
        right = parent.select(F.col("num").alias("r"), "last", "ends")
        joined = own.select("l", "r", "num", "f").join(left, "l").join(right, "r")
        parent = B.stored(joined.select("num", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.concat("begins", F.array("f")).alias("begins"), F.concat("ends", F.array("f")).alias("ends")))
        mine = parent
        if k < longest:
            above = levels[k].select(F.explode(F.array("l", "r")).alias("num"), F.col("f").alias("up")).groupBy("num").agg(F.max("up").alias("up"))
            mine = parent.join(above, "num", "left").filter(F.col("up").isNull() | (100 * F.col("up") < 100 * F.element_at("begins", -1))).drop("up")
        mine = mine.select("lang", "phrase", F.element_at("begins", -1).alias("a"), "begins", "ends", F.lit(k).alias("k"))
        found = mine if found is None else found.unionByName(mine)
    scored = found.join(totals, "lang")
    cuts = F.array_compact(F.array(*(F.when(F.col("k") > j, F.struct(_score("a", "n", F.get("begins", F.lit(j - 1)), F.get("ends", F.col("k") - j - 1)).alias("score"), F.lit(j).alias("at"), F.get("begins", F.lit(j - 1)).alias("l"), F.get("ends", F.col("k") - j - 1).alias("r"))) for j in range(1, longest))))
    scored = scored.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    few = scored.withColumn("part", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= best)
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    return top.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""N-gram Jaccard join by MinHash banding.

Shingles are runs of five words (white space cuts words, A-Z are lower-cased; a shorter text is one shingle).  A text has
bands * rows minima of its shingles' hashes; texts that agree in all rows of a band meet under the band's key and are
compared on their full shingle sets, with integers.  A pair at similarity s meets with probability
1 - (1 - s**rows)**bands; both follow from the threshold and the recall that is asked for there (16 bands of 4 rows at
0.8, which give 0.9998).  No link below the threshold is ever reported.

Texts with the same words are one class first.  A pair of classes is counted under the smallest key that both have and
nowhere else; a group of classes sends each member's number of links and a spanning forest, never its pairs.  A key with
the same members as a smaller one is left out, and a key with many shingles or members is dealt to several tasks by
pairs of member blocks.  So a group of copies, equal or near, may hold any part of all rows.

Texts that are null, empty or without words link with nothing and are kept.  Null ids are rows like any other (they come
last where the smallest id is asked for).  Rows that repeat id and text count as documents but only one is kept, unless
the text has no words.  A text of any length is compared whole, by the task that has its key.  Other columns are ignored
or, in ``deduplicate``, kept.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import blocks as B, hashing as H
from .caps import Runs, forest, kept_groups, meet
from .components import components

WORDS = 5
#: Minima of a text, if they do for the recall; the least share of pairs at the threshold that meet.
MINIMA, RECALL = 64, 0.9997
#: Shingles of a key's members, and members, that are compared in one task; more are cut into blocks of about this size.
LARGE, MEMBERS = 600_000, 1024


def banding(threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands for the recall at the threshold take MINIMA minima; one row, if none do."""
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError("threshold must be over 0 and at most 1, recall between 0 and 1")
    best = (1, 1)
    for rows in range(1, MINIMA + 1):
        hit = threshold**rows  # in one band
        bands = 1 if hit == 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if rows > 1 and bands * rows > MINIMA:
            break
        best = bands, rows
    return best


def _minima(s: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """(texts, n) minima; only for texts with shingles."""
    factor, term = H.seeds(n, 11) | H.U(1), H.seeds(n, 12)
    out = np.empty((len(at) - 1, n), np.uint32)
    for k in range(n):
        out[:, k] = np.minimum.reduceat((s * factor[k] + term[k]).view(np.uint32)[1::2], at[:-1])
    return out


def signed(raw: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: hash of its words in order, number of shingles (0: no words), and its band keys."""
    h, at = H.words(raw, offsets)
    s, so = H.shingles(h, at, WORDS)
    n = len(offsets) - 1
    node, keys, count = np.zeros(n, np.uint64), np.zeros((n, bands), np.uint64), np.diff(so)
    full = np.flatnonzero(count)
    if len(full):
        place = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))
        _, inverse = H._grown(int(place.max()) + 1)
        node[full] = H.mix(np.add.reduceat(h * inverse[place], at[:-1][full]) + np.diff(at)[full].astype(np.uint64))
        m = _minima(s, np.append(so[:-1][full], so[-1]), bands * rows).astype(np.uint64).reshape(len(full), bands, rows)
        key = np.broadcast_to(H.seeds(bands, 13), (len(full), bands))
        for r in range(rows):
            key = H.mix(key ^ m[:, :, r]) + H.U(r)
        keys[full] = key
    return node, count, keys


def _marked(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, offs = B.flat(b["text"])
        for lo, hi in B.cuts(offs, 2 << 20):
            node, count, keys = signed(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], bands, rows)
            none = count == 0
            held = pa.ListArray.from_arrays(np.arange(0, (hi - lo + 1) * bands, bands, dtype=np.int32), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.record_batch([b["id"].slice(lo, hi - lo), b["hash"].slice(lo, hi - lo), pa.array(node.view(np.int64), mask=none), pa.array(count), held], ["id", "hash", "node", "shingles", "bands"])


def linked(sets: list[np.ndarray], ratio: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) of sorted distinct hash sets with Jaccard similarity of at least ratio."""
    n, size = len(sets), np.array([len(x) for x in sets], np.int64)
    if n == 2:
        both = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
    else:
        _, which = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(n), size)
        seen = np.bincount(which)
        column = np.cumsum(seen > 1) - 1  # a shingle of one member is in no intersection
        on = seen[which] > 1
        both = meet(n, row[on], column[which[on]])
    found = []
    for lo in range(0, n, 256):
        inter = both[lo : lo + 256].astype(np.int64)
        near = inter * ratio.denominator >= (size[lo : lo + 256, None] + size - inter) * ratio.numerator
        i, j = np.nonzero(np.triu(near, lo + 1))
        found.append((i + lo, j))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _verified(batches: Iterator[pa.RecordBatch], ratio: Fraction, n_bands: int) -> Iterator[pa.RecordBatch]:
    for table, heads in Runs(batches, ["key", "i", "j"], 512):
        out: list[tuple[int, int | None, int]] = []
        raw, offs = B.flat(table["text"])
        sets: list[np.ndarray] = []
        for lo, hi in B.cuts(offs, 2 << 20):
            h, at = H.words(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            s, so = H.shingles(h, at, WORDS)
            sets += [np.unique(s[a:b]) for a, b in zip(so.tolist(), so[1:].tolist())]
        node, size, key, own, bi, bj = (table[c].to_numpy() for c in ("node", "size", "key", "own", "i", "j"))
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, n_bands)
        for lo, hi in zip(heads.tolist(), heads[1:].tolist()):
            if hi - lo < 2:
                continue
            a, b = linked(sets[lo:hi], ratio)
            if bi[lo] != bj[lo]:
                cross = own[lo + a] != own[lo + b]
                a, b = a[cross], b[cross]
            if not len(a):
                continue
            x, y = bands[lo + a], bands[lo + b]
            first = ~((x == y) & (x < key[lo])).any(axis=1)
            a, b, n = a[first], b[first], hi - lo
            w = np.bincount(a, size[lo:hi][b], n) + np.bincount(b, size[lo:hi][a], n)
            out += [(int(node[lo + k]), None, int(w[k])) for k in np.flatnonzero(w).tolist()]
            out += [(int(node[lo + k]), int(node[lo + r]), 0) for k, r in forest(n, a, b)]
        if out:
            yield pa.record_batch([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], ["a", "b", "links"])
        B.trim()


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.lit(29), text)


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = RECALL) -> DataFrame:
    """A row for each input row: id, hash (of the text), class_id (smallest id with the same words), n_links (documents
    at the threshold or above, itself left out), component_id (smallest id reachable by links), kept (it is the one)."""
    B.small_batches(docs.sparkSession)
    n_bands, n_rows = banding(threshold, recall)
    ratio = Fraction(threshold).limit_denominator(1000)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("hash", _text_hash(F.col("text")))
    marked = B.stored(rows.mapInArrow(lambda it: _marked(it, n_bands, n_rows), f"id {kind}, hash long, node long, shingles long, bands array<long>"))
    me = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    classes = B.stored(marked.filter("node is not null").groupBy("node").agg(F.min(me).alias("rep"), F.count("*").alias("size"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands")))
    light = classes.select(F.explode(F.array_distinct("bands")).alias("key"), "node", "shingles")
    groups = kept_groups(light, "key", "node", "shingles")
    members = B.stored(light.join(groups, "key").select("key", "node", "n", "total"))
    wanted = members.select("node").distinct().join(classes, "node").select("node", "rep.id", "rep.hash", "size", "bands")
    texts = rows.join(wanted, rows["id"].eqNullSafe(wanted["id"]) & (rows["hash"] == wanted["hash"])).select("node", "size", "bands", "text").dropDuplicates(["node"])
    blocks = F.greatest(F.ceil(F.col("total") / F.lit(LARGE)), F.ceil(F.col("n") / F.lit(MEMBERS))).cast("int")
    spread = members.withColumn("own", F.pmod(F.xxhash64(F.lit(17), "node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("key", "node", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = spread.join(texts, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = B.stored(dealt.mapInArrow(lambda it: _verified(it, ratio, n_bands), "a long, b long, links long"))
    each = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    parts = components(found.filter("b is not null").select("a", "b"))
    least = parts.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("least"))
    of = parts.join(least, "root").select("node", "least")
    facts = classes.select("node", "rep", "size").join(each, "node", "left").join(of, "node", "left")
    facts = facts.select("node", F.col("rep.id").alias("class_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("least", "rep").alias("least"))
    out = marked.select("id", "hash", "node").join(facts, "node", "left")
    lone = F.col("node").isNull()
    stays = lone | (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("hash") == F.col("least.hash")))
    return out.select(
        F.col("id").alias(id_col), "hash", F.when(lone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.when(lone, F.col("id")).otherwise(F.col("least.id")).alias("component_id"), stays.alias("kept"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = RECALL) -> DataFrame:
    """The rows of docs, all columns, without all but one document of each group; texts without words all stay."""
    words = F.coalesce(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    stay = links(docs, id_col, text_col, threshold, recall).filter("kept").select(F.col(id_col).alias("_id"), F.col("hash").alias("_hash")).distinct()
    own = docs.filter(words).withColumn("_own", _text_hash(F.col(text_col).cast("string")))
    kept = own.join(stay, own[id_col].eqNullSafe(stay["_id"]) & (own["_own"] == stay["_hash"])).drop("_id", "_hash")
    return kept.dropDuplicates([id_col, "_own"]).select(*docs.columns).unionByName(docs.filter(~words))

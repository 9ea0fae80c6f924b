"""Spelling variants: words one edit apart, found by bands of letter-parity masks, and the form that each is written for.

Words are the letter runs of all texts.  A word's mask has a bit for each class of letters (a to z have one each), set if
the word has an odd number of letters of the class.  One inserted, deleted or replaced letter flips two bits at most, so
of three bands of the mask one at least stays equal.  Words meet under an equal band, equal band number and the length
of the longer word, and, so that a band which many words share stays small, an equal *frame*: the letters before and
after a segment of the word.  The edit lies in one of a word's two halves, so two frames do for all.  A frame that many
words share is replaced by the two frames around the halves of its segment, again and again until its group is small or
the segment is one letter (then the group is no larger than the alphabet, for each of two lengths).  No pair is lost by
any of this, and a pair counts under one frame and one band only: the segment of the first letter that differs, and the
first equal band.  Frames are known by 64-bit hashes; what meets is verified by edit distance.  Groups send numbers of near words and their best one.

Forms lead to words at least ``ratio`` times as frequent, so chains are short; they are followed by pointer doubling.

A null text has no words; a null id is hashed as an empty one; repeated rows count as often as they stand; a text of any
length is read whole, in pieces cut between runs; ties of frequency go to the smaller word; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import blocks as B

#: Bytes of texts that are looked through at once.
SLAB = 1 << 20
#: Bits of the mask, bands, and bits of a band; letters from the most frequent one on.
BITS, BANDS = 60, 3
BAND = BITS // BANDS
COMMON = "etaoinshrdlcumwfgypbvkjxqz"
#: Words of a frame's group from which on it is cut; groups are measured on one word in SAMPLE.
LARGE, SAMPLE = 256, 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII = np.zeros(256, bool)
_ASCII[[*_UPPER.encode(), *_LOWER.encode(), 0xC3]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[[*_UPPER.encode()]] += 32


def _letters(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters: A to Z, a to z, and both bytes of U+00C0 to U+00FF, whose first one is 0xC3."""
    on = _ASCII[raw]
    on[1:] |= raw[:-1] == 0xC3
    return on


def _slabs(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes, offsets and first row of slabs of about SLAB bytes; a longer text is cut between its runs."""
    for lo, hi in B.cuts(offsets, SLAB):
        a, b = int(offsets[lo]), int(offsets[hi])
        while b - a > SLAB and hi == lo + 1:
            c, step = a + SLAB, 1 << 10
            while c < b:  # the next byte that ends a run
                gap = np.flatnonzero(~_letters(raw[c : c + step]))
                gap = gap[gap > 0]  # the first byte may be the second of a letter
                if len(gap):
                    c += int(gap[0])
                    break
                c, step = min(b, c + step - 1), 2 * step
            c = min(c, b)
            yield raw[a:c], np.array([0, c - a]), lo
            a = c
        yield raw[a:b], np.maximum(offsets[lo : hi + 1], a) - a, lo


def _found(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = B.flat(batch["text"])
        for part, at, row in _slabs(raw, offsets):
            on = _letters(part)
            edge = np.zeros(len(part) + 1, bool)
            edge[1:-1] = on[1:] != on[:-1]
            edge[at] = True
            cut = np.flatnonzero(edge)
            cut = cut[: np.searchsorted(cut, len(part), side="right")]
            start, end = cut[:-1], cut[1:]
            whole = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            keep = on[start] & (whole[end] - whole[start] >= least) if len(start) else np.zeros(0, bool)
            start, end = start[keep], end[keep]
            size = end - start
            inside = np.zeros(len(part) + 1, np.int8)
            inside[start] = 1
            inside[end] -= 1
            data = _LOW[part[np.cumsum(inside[:-1]).astype(bool)]]
            offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            run = pa.StringArray.from_buffers(len(size), pa.py_buffer(offs), pa.py_buffer(data))
            rows = pa.array(row + np.searchsorted(at, start, side="right") - 1)
            yield pa.record_batch([batch["id"].take(rows), run], ["id", "run"])
        B.trim()


def runs(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """id, run: all maximal letter runs of at least ``least`` letters, A-Z lower-cased."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    return rows.mapInArrow(lambda it: _found(it, least), "id string, run string")


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, often: int = 2, drop: int = 31) -> DataFrame:
    """word, n: words of at least ``least`` letters that occur ``often`` times or more.

    Where ``drop`` divides the crc32 h of ``<id>:<run>``, the run's letter at h % length is left out first.
    """
    each = runs(docs, id_col, text_col, least)
    h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    made = each.withColumn("h", h).select(F.when(F.col("h") % drop == 0, cut).otherwise(F.col("run")).alias("word"))
    return made.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def mask(word: Column) -> Column:
    """Parities of the word's letter classes; the classes are dealt to the bands in turn, frequent letters first."""

    def bit(c: Column) -> Column:
        code = F.ascii(c)
        place = F.when(code < 128, F.instr(F.lit(COMMON), c) - 1).otherwise(26 + (code - 192) % (BITS - 26))
        return (place % BANDS * BAND + F.floor(place / BANDS)).cast("int")

    one = F.lit(1).cast("long")
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", one, bit(c))))


def _segments(known: DataFrame) -> DataFrame:
    """Rows of both roles: a word of length L is a longer one for length L, a shorter one for L + 1; two halves each."""
    roles = F.explode(F.array(F.struct(F.lit(False).alias("short"), F.length("word").alias("len")), F.struct(F.lit(True).alias("short"), (F.length("word") + 1).alias("len"))))
    role = known.select("word", "n", "mask", roles.alias("r")).select("word", "n", "mask", "r.short", "r.len")
    half = F.floor(F.col("len") / 2).cast("int")
    return role.select("*", F.explode(F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("len").alias("hi")))).alias("s")).select("word", "n", "mask", "short", "len", "s.lo", "s.hi")


def _halves(rows: DataFrame) -> DataFrame:
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    two = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
    return rows.select("word", "n", "mask", "short", "len", F.explode(two).alias("s"), "band").select("word", "n", "mask", "short", "len", "s.lo", "s.hi", "band")


def _band(m: Column, band: Column) -> Column:
    return F.call_function("shiftright", m, (band * BAND).cast("int")).bitwiseAND(F.lit((1 << BAND) - 1))


def _keyed(rows: DataFrame) -> DataFrame:
    frame = (F.col("len"), F.col("lo"), F.col("hi"), F.substring("word", F.lit(1), F.col("lo")), F.expr("right(word, len - hi)"))
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    own = rows.withColumn("key", F.xxhash64("band", _band(F.col("mask"), F.col("band")), *frame))
    return own.withColumn("p", F.hash(F.substring("word", F.lit(1), mid))).withColumn("q", F.hash(F.right("word", F.col("len") - mid)))


def _crowded(rows: DataFrame, large: int, sample: int) -> DataFrame:
    """Keys with about ``large`` rows or more, by one word in ``sample``: what is missed costs time, no pairs."""
    few = rows.filter((F.col("hi") - F.col("lo") > 1) & (F.pmod(F.xxhash64(F.lit(7), "word"), F.lit(sample)) == 0))
    return few.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") >= max(2, large // sample)).select("key")


def met(known: DataFrame, large: int = LARGE, sample: int = SAMPLE) -> DataFrame:
    """Rows with keys under which they meet; known: word, n, mask."""
    rows = _keyed(_segments(known).withColumn("band", F.explode(F.array(*(F.lit(k) for k in range(BANDS))))))
    done, longest = None, known.agg(F.max(F.length("word"))).first()[0] or 1
    for _ in range(max(1, int(longest)).bit_length()):
        crowded = B.stored(_crowded(rows, large, sample))
        if crowded.isEmpty():
            break
        whole = rows.join(crowded, "key", "left_anti").select(*rows.columns)
        done = whole if done is None else done.unionByName(whole)
        rows = B.stored(_keyed(_halves(rows.join(crowded, "key", "left_semi"))))
    return rows if done is None else done.unionByName(rows)


def near(known: DataFrame, large: int = LARGE, sample: int = SAMPLE) -> DataFrame:
    """word, n, other, other_n: each word with each of its near words; a pair is found once and sent both ways."""
    rows = met(known, large, sample)
    a = rows.filter("not short").select("key", "lo", "hi", "band", F.col("word").alias("a"), F.col("n").alias("an"), F.col("mask").alias("am"), F.col("p").alias("ap"), F.col("q").alias("aq"))
    b = rows.select("key", "short", F.col("word").alias("b"), F.col("n").alias("bn"), F.col("mask").alias("bm"), F.col("p").alias("bp"), F.col("q").alias("bq"))
    flipped = F.col("am").bitwiseXOR(F.col("bm"))
    once = F.col("short") | (F.col("a") < F.col("b"))
    first_band = (F.col("band") == 0) | (_band(flipped, F.lit(0)) != 0) & ((F.col("band") == 1) | (_band(flipped, F.lit(1)) != 0))
    here = (F.substring("a", F.lit(1), F.col("lo")) == F.substring("b", F.lit(1), F.col("lo"))) & (F.substring("a", F.lit(1), F.col("hi")) != F.substring("b", F.lit(1), F.col("hi")))
    either = (F.col("ap") == F.col("bp")) | (F.col("aq") == F.col("bq"))  # true of all that are one edit apart, and no string is looked at
    # Sizes of exploded rows are guessed too small by the planner: no broadcast here.
    pairs = a.hint("merge").join(b, (a["key"] == b["key"]) & (F.bit_count(flipped) <= 2) & either & once & first_band & here & (F.levenshtein("a", "b", 1) == 1))
    both = F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("other"), F.col("bn").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("other"), F.col("an").alias("other_n"))))
    return pairs.select(both)


def roots(forms: DataFrame) -> DataFrame:
    """word, root of all words with a form (columns word and form); chains end, since frequencies grow along them."""
    ahead = B.stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = B.stored(ahead.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ahead = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return ahead


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 10, large: int = LARGE, sample: int = SAMPLE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    B.small_batches(docs.sparkSession)
    known = B.stored(words(docs, id_col, text_col).withColumn("mask", mask(F.col("word"))))
    best = near(known, large, sample).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best"))
    led = F.col("n_near").isNotNull() & (-F.col("best.m") >= ratio * F.col("n"))
    formed = B.stored(known.select("word", "n").join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("best.w")).alias("form"), F.when(led, -F.col("best.m")).alias("form_n")))
    root = roots(formed.filter("form is not null"))
    return formed.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_CRC_TABLE = "SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"
#: The same over the table ``documents`` in DuckDB; near words meet under what is left of them without one letter.
ORACLE = rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
hashed AS (SELECT run, {_CRC} AS h FROM (SELECT run, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x FROM runs WHERE length(run) >= 7), crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
known AS (SELECT word, count(*) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM known)),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b USING (cut, i) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, k.word, k.n FROM less a JOIN known k ON a.cut = k.word
  UNION SELECT k.word, k.n, a.word, a.n FROM less a JOIN known k ON a.cut = k.word
),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS w, max(other_n) AS m FROM pairs GROUP BY word),
formed AS (SELECT known.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN w END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM known LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, root FROM chain WHERE next IS NULL) c USING (word)
"""

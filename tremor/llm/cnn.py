"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes go through learned filters of a few bytes' width; each half-overlapping chunk of the text keeps the
largest answer of each filter; a small dense layer judges each chunk; the mean and the largest of the chunks' hidden
values are combined into one probability.  Chunks cover the whole text, however long; long texts go through in slabs.

The network is trained on the driver on a bounded sample (``SAMPLE`` labelled rows of each class, ``SAMPLE_CHARS``
characters of a longer text) with Adam from a fixed seed; its weights (under 1 MB) travel with the tasks.  Nothing but the bytes of
a text enters a score.

A null text is empty; an empty text is one chunk of no filter answers and gets the score of that; rows with null or
repeated ids are scored like any other; other columns are ignored; an empty table gives no rows.  Without a labelled
row of each class the network can't be trained: ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import blocks as B
from .bpe import _arrow

#: Labelled rows of each class that are learned from at most; characters of a text that are, and in how many pieces.
SAMPLE, SAMPLE_CHARS, PIECES = 1200, 16_384, 16
WIDTH, STEP, FILTERS, HIDDEN, HALF = 6, 2, 24, 16, 64


@dataclass
class Net:
    """taps: (WIDTH, 256, FILTERS), a value for each byte at each place; then dense layers."""

    taps: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def new(cls, seed: int = 0) -> Net:
        r = np.random.default_rng(seed)
        make = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        return cls(make(WIDTH, 256, FILTERS, scale=0.25), np.zeros(FILTERS, np.float32), make(FILTERS, HIDDEN, scale=0.3), np.zeros(HIDDEN, np.float32), make(2 * HIDDEN, scale=0.3), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.taps, self.bias, self.w1, self.b1, self.w2, self.b2]


def layout(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First filter places of half chunks, first half of each text, number of halves of each text.

    Places stand STEP bytes apart within a text; a half chunk has HALF bytes of them; a text has one half at least.
    """
    size = np.diff(offsets)
    halves = np.maximum(1, -(-size // HALF))
    return size, halves, np.concatenate([[0], np.cumsum(halves)])


def places(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte index of each filter place and the first place of each half; bytes are padded by zeros behind each text.

    Returns padded bytes, places and half starts (as positions among the places).
    """
    size, halves, first = layout(offsets)
    room = halves * HALF + WIDTH  # zeros fill the last half
    at = np.concatenate([[0], np.cumsum(room)])
    padded = np.zeros(int(at[-1]), np.uint8)
    padded[np.arange(len(raw)) + np.repeat(at[:-1] - offsets[:-1], size)] = raw
    n = HALF // STEP
    start = np.repeat(at[:-1] - first[:-1] * HALF, halves) + np.arange(int(first[-1])) * HALF
    where = (start[:, None] + np.arange(n) * STEP).ravel()
    return padded, where, first


def answers(net: Net, padded: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Filter answers at all places, (places, FILTERS)."""
    out = net.taps[0][padded[where]]
    for k in range(1, WIDTH):
        out += net.taps[k][padded[where + k]]
    return out


def halves_max(net: Net, raw: np.ndarray, offsets: np.ndarray, slab: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Largest answers of each half chunk, and the first half of each text."""
    padded, where, first = places(raw, offsets)
    n = HALF // STEP
    out = np.empty((int(first[-1]), FILTERS), np.float32)
    for lo in range(0, len(out), slab):
        hi = min(len(out), lo + slab)
        out[lo:hi] = answers(net, padded, where[lo * n : hi * n]).reshape(hi - lo, n, FILTERS).max(axis=1)
    return out, first


def pooled(net: Net, halves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A probability for each text from its half chunks' largest answers."""
    nxt = np.arange(1, len(halves) + 1)
    nxt[first[1:] - 1] -= 1  # the last half stands alone
    chunk = np.maximum(np.maximum(halves, halves[nxt]) + net.bias, 0)
    h = np.maximum(chunk @ net.w1 + net.b1, 0)
    mean = np.add.reduceat(h, first[:-1], axis=0) / np.diff(first)[:, None]
    most = np.maximum.reduceat(h, first[:-1], axis=0)
    z = np.concatenate([mean, most], axis=1) @ net.w2 + net.b2
    return 1 / (1 + np.exp(-z.astype(np.float64)))


def scores(net: Net, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if len(offsets) < 2:
        return np.zeros(0)
    return pooled(net, *halves_max(net, raw, offsets))


def gradients(net: Net, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted mean log loss and its gradient by each of net.parts(); the gradient of a maximum goes to its first place."""
    n = HALF // STEP
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    padded, where, first = places(np.frombuffer(b"".join(texts), np.uint8), offsets)
    a = answers(net, padded, where).reshape(-1, n, FILTERS)
    top = a.argmax(axis=1)
    half = np.take_along_axis(a, top[:, None], 1)[:, 0]
    nxt = np.arange(1, len(half) + 1)
    nxt[first[1:] - 1] -= 1
    left = half >= half[nxt]
    c = np.where(left, half, half[nxt]) + net.bias
    act = np.maximum(c, 0)
    pre = act @ net.w1 + net.b1
    h = np.maximum(pre, 0)
    count = np.diff(first)
    mean = np.add.reduceat(h, first[:-1], axis=0) / count[:, None]
    most = np.maximum.reduceat(h, first[:-1], axis=0)
    x = np.concatenate([mean, most], axis=1)
    z = x @ net.w2 + net.b2
    share_of = weights / weights.sum()
    loss = float((share_of * (np.logaddexp(0, z) - labels * z)).sum())
    dz = ((1 / (1 + np.exp(-z)) - labels) * share_of).astype(net.w2.dtype)
    dx = dz[:, None] * net.w2[None]
    rows = np.repeat(np.arange(len(texts)), count)
    hit = h == most[rows]
    share = hit / np.add.reduceat(hit, first[:-1], axis=0)[rows]
    dh = (dx[:, :HIDDEN] / count[:, None])[rows] + dx[:, HIDDEN:][rows] * share
    dpre = dh * (pre > 0)
    dc = (dpre @ net.w1.T) * (c > 0)
    dhalf = np.where(left, dc, 0)
    np.add.at(dhalf, nxt, np.where(left, 0, dc))
    src = where.reshape(-1, n)[np.arange(len(half))[:, None], top]  # byte where each filter's answer stood
    taps = np.zeros_like(net.taps)
    f = np.arange(FILTERS)
    for k in range(WIDTH):
        flat = (padded[src + k].astype(np.int64) * FILTERS + f).ravel()
        taps[k] = np.bincount(flat, dhalf.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return loss, [taps, dc.sum(0), act.T @ dpre, dpre.sum(0), x.T @ dz, np.array([dz.sum()])]


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 6, steps: int = 900, batch: int = 32, rate: float = 0.006, seed: int = 0) -> Net:
    """Adam on weighted log loss, at least so many epochs and steps."""
    r = np.random.default_rng(seed)
    net = Net.new(seed)
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    t = 0
    each = max(1, len(texts) // batch)
    epochs = max(epochs, -(-steps // each))
    rounds = epochs * each
    for _ in range(epochs):
        for own in np.array_split(r.permutation(len(texts)), each):
            _, grads = gradients(net, [texts[i] for i in own], labels[own], weights[own])
            t += 1
            step = rate * (1 - 0.9 * t / rounds) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for q, g, (m, v) in zip(net.parts(), grads, moment, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= (step * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def in_fold(id_col: str, keep: bool, folds: int = 4, fold: int = 2) -> F.Column:
    """Whether crc32 of the id's decimal text falls in the held-out fold (keep: in another one, as a null id does)."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
    return ~held if keep else held


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Net:
    """Fit on the labelled rows with the smallest id hashes of each class, held-out rows left aside.

    Classes weigh as the square roots of their numbers among all labelled rows.  Null and empty texts are not learned
    from; of a text over SAMPLE_CHARS characters PIECES pieces at even distances are, so many characters in all.
    """
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("label in (0, 1) and id is not null").filter(in_fold("id", True))
    total = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        raise ValueError("labelled rows of both classes are needed")
    text, size, piece = F.col("text"), F.length("text"), SAMPLE_CHARS // PIECES
    spread = F.concat(*(F.substring(text, F.floor((size - piece) * F.lit(k / (PIECES - 1))).cast("int") + 1, F.lit(piece)) for k in range(PIECES)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text <> ''")
    texts = texts.select("id", F.when(size > SAMPLE_CHARS, spread).otherwise(text).alias("text"))
    found = []
    for k in (0, 1):
        own, many = [], 2 * sample  # ids, of which few have no text; more are asked for until there are enough
        while True:
            chosen = named.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(many).dropDuplicates(["id"])
            chosen = F.broadcast(chosen) if many == 2 * sample else chosen
            own = texts.join(chosen, "id").orderBy(F.xxhash64("id"), "id", "text").limit(sample).collect()
            if len(own) == sample or many >= total[k]:
                break
            many *= 8
        found += own
    found.sort(key=lambda r: (r["id"], r["text"]))
    y = np.array([r["label"] for r in found], np.float32)
    if not 0 < y.sum() < len(y):
        raise ValueError("labelled rows of both classes are needed")
    share = {k: total[k] ** 0.5 / np.mean(y == k) for k in (0, 1)}
    return fit([r["text"].encode() for r in found], y, np.array([share[int(k)] for k in y], np.float32))


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), score_col: str = "score") -> DataFrame:
    """id, the columns of keep, and ``score_col`` (double): the probability that a text has label 1."""
    B.small_batches(docs.sparkSession)
    names = [id_col, *keep]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(score_col, T.DoubleType())])
    arrow = pa.schema([pa.field(f"c{i}", _arrow(f.dataType)) for i, f in enumerate(schema)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = B.flat(b.column(0))
            for lo, hi in B.cuts(offs, 1 << 20):
                s = scores(net, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                yield pa.record_batch([*(b.column(i + 1).slice(lo, hi - lo) for i in range(len(names))), pa.array(s)], schema=arrow)

    out = docs.select(F.col(text_col).cast("string").alias("t"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(names)))
    named = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    return out.mapInArrow(rows, named).toDF(*schema.names)

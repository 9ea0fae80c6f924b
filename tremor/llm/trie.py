"""A compact n-gram trie: Elias-Fano levels, quantised probabilities, memory-mapped.

Contexts and their pointers are monotone sequences; the successors of all contexts are made one monotone sequence by
adding to each successor the last value of the context before it.  A pair is found by successor search for its
context-relative value.  Values are decoded a stretch at a time, so a search for many sorted keys costs one pass.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

STRETCH = 1 << 16


class Store:
    """Arrays put one after another into a temporary file and read back through a memory map; closing removes it."""

    def __init__(self):
        fd, self.path = tempfile.mkstemp(suffix=".trie")
        self.file = os.fdopen(fd, "wb")
        self.parts: list[tuple[int, tuple[int, ...], np.dtype]] = []

    def put(self, a: np.ndarray) -> int:
        self.parts.append((self.file.tell(), a.shape, a.dtype))
        self.file.write(np.ascontiguousarray(a).tobytes())
        self.file.write(bytes(-self.file.tell() % 8))
        return len(self.parts) - 1

    def seal(self) -> None:
        self.file.close()
        self.map = np.memmap(self.path, np.uint8, "r") if os.path.getsize(self.path) else np.zeros(0, np.uint8)

    def get(self, k: int) -> np.ndarray:
        at, shape, kind = self.parts[k]
        return self.map[at : at + int(np.prod(shape)) * kind.itemsize].view(kind).reshape(shape)

    def close(self) -> None:
        del self.map
        os.unlink(self.path)


class EliasFano:
    """A non-decreasing sequence of unsigned integers: low bytes as they are, high parts as gaps in unary.

    The low part has whole bytes, as many as leave about one to a few hundred high values an element.
    """

    def __init__(self, values: np.ndarray, store: Store):
        values = values.astype(np.uint64)
        self.store, self.n = store, len(values)
        top = int(values[-1]) if self.n else 0
        self.low = 0
        while top >> 8 * self.low > 4 * self.n + 64:
            self.low += 1
        high = (values >> np.uint64(8 * self.low)).astype(np.int64)
        where = high + np.arange(self.n)
        bits = np.zeros(int(where[-1]) + 1 if self.n else 0, bool)
        bits[where] = True
        self.bits = store.put(np.packbits(bits))
        self.bytes = store.put(values.view(np.uint8).reshape(-1, 8)[:, : self.low])
        self.starts = where[::STRETCH]  # bit of the first element of each stretch
        self.first = values[::STRETCH]

    def stretch(self, k: int) -> np.ndarray:
        """Elements k * STRETCH and on."""
        lo, hi = k * STRETCH, min(self.n, (k + 1) * STRETCH)
        a = int(self.starts[k])
        b = int(self.starts[k + 1]) if k + 1 < len(self.starts) else None
        raw = np.unpackbits(self.store.get(self.bits)[a >> 3 : None if b is None else (b + 7) >> 3])
        ones = np.flatnonzero(raw[a & 7 :])[: hi - lo] + a
        out = (ones - np.arange(lo, hi)).astype(np.uint64) << np.uint64(8 * self.low)
        low = self.store.get(self.bytes)[lo:hi]
        for j in range(self.low):
            out |= low[:, j].astype(np.uint64) << np.uint64(8 * j)
        return out

    def at(self, places: np.ndarray) -> np.ndarray:
        """Elements at ascending places."""
        out = np.empty(len(places), np.uint64)
        edges = np.searchsorted(places, np.arange(0, self.n + STRETCH, STRETCH))
        for k, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
            if a < b:
                out[a:b] = self.stretch(k)[places[a:b] - k * STRETCH]
        return out

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending keys: place of the first element not below each, and whether it is the key."""
        place, equal = np.full(len(keys), self.n, np.int64), np.zeros(len(keys), bool)
        if not self.n or not len(keys):
            return place, equal
        # a key goes to the last stretch that starts below it, or on it
        edges = np.append(np.searchsorted(keys, self.first), len(keys))
        edges[0] = 0
        for k, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
            if a < b:
                v = self.stretch(k)
                i = np.searchsorted(v, keys[a:b])
                place[a:b] = i + k * STRETCH
                inside = i < len(v)
                equal[a:b][inside] = v[i[inside]] == keys[a:b][inside]
        return place, equal


class Trie:
    """Pairs (context, word) with a number each, kept in 16 bits.

    context, word: unsigned, ascending by (context, word) and distinct; value: the numbers, quantised on an even grid
    between their least and largest (their error is below 1/130000 of that range).
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, value: np.ndarray):
        self.store = Store()
        contexts, first = np.unique(context, return_index=True)
        size = np.diff(np.append(first, len(context)))
        last = word[first + size - 1].astype(np.uint64) if len(first) else np.zeros(0, np.uint64)
        base = np.concatenate([[0], np.cumsum(last + np.uint64(1))]).astype(np.uint64)  # one above the last value before
        self.contexts = EliasFano(contexts, self.store)
        self.pointers = EliasFano(np.append(first, len(context)), self.store)
        self.words = EliasFano(word.astype(np.uint64) + np.repeat(base[:-1], size), self.store)
        self.least = float(value.min()) if len(value) else 0.0
        self.step = max((float(value.max()) - self.least) / 65535, 1e-12) if len(value) else 1.0
        self.codes = self.store.put(np.rint((value - self.least) / self.step).astype(np.uint16))
        self.store.seal()

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs ascending by (context, word): whether they are kept, and their numbers (0 where not)."""
        hit, out = np.zeros(len(context), bool), np.zeros(len(context))
        if not self.words.n or not len(context):
            return hit, out
        own, back = np.unique(context, return_inverse=True)
        k, known = self.contexts.successor(own.astype(np.uint64))
        lo, hi = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        lo[known] = self.pointers.at(k[known]).astype(np.int64)
        hi[known] = self.pointers.at(k[known] + 1).astype(np.int64)
        base = np.zeros(len(own), np.uint64)
        later = known & (lo > 0)
        base[later] = self.words.at(lo[later] - 1) + np.uint64(1)
        ask = np.flatnonzero(known[back])
        key = base[back[ask]] + word[ask].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        place, equal = self.words.successor(key[order])
        equal &= place < hi[back[ask[order]]]  # else it is a value of a later context
        hit[ask[order[equal]]] = True
        out[ask[order[equal]]] = self.store.get(self.codes)[place[equal]] * self.step + self.least
        return hit, out

    def close(self) -> None:
        self.store.close()

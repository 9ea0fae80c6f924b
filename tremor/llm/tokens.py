"""Token ids of whole texts, equal to those of the tokenizers library, with a faster merge engine.

The vocabulary, its merges, the normal form and the treatment of special tokens are the tokenizers library's, read from
its file.  The merges themselves are run by tiktoken, which joins the neighbours whose joint bytes have the lowest rank.
That gives the same ids if (1) ids grow with the merges' order and (2) every token's own bytes merge to that token: the
merges inside a span are the same alone and in a longer text as long as nothing crosses its ends, so the last two parts
of a token's span can only be the pair that the token's merge names.  Both are checked when a vocabulary is loaded;
where one fails, and for texts that hold a special token's string or a character that the engines' Unicode tables may
class differently, the tokenizers library encodes.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata

import numpy as np

#: Words in a worker's memo; beyond it the memo starts anew (speed changes, results don't).
MEMO = 150_000

# The pre-token patterns of the two vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for a word's end in the merge engine; pieces that hold it go to the tokenizers library.
END = "\x01"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Whole texts to uint16 or uint32 ids and back."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.normalizer = self.whole.normalizer
        self.specials = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        # split() takes four control characters for white space, the library doesn't
        self.marks = [*self.specials, *("\x1c\x1d\x1e\x1f" if self.normalizer else "")]
        self.unsettled = re.compile(_unsettled())
        self.kind = np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32
        self.pattern = regex.compile(WORD_PATTERN if self.normalizer else BYTE_PATTERN)
        self.memo: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            self.merger = self._merger(json.load(f)["model"])

    def _merger(self, model: dict):
        """tiktoken's engine for the vocabulary, or None where its ids could differ."""
        import tiktoken

        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        ranks = {self._bytes(t, suffix): i for t, i in vocab.items() if t not in self.specials}
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        order = [vocab["".join(p)] for p in pairs]
        grow = all(a < b for a, b in zip(order, order[1:], strict=False)) and len(order) + (512 if suffix else 256) == len(ranks)
        one = self.whole.model.tokenize
        own = lambda t: [x.id for x in one(t.removesuffix(suffix) if suffix else t)]
        # A token that isn't a word's end can't be spelled alone by a model that ends every word: see it as a prefix.
        whole = (own(t) == [i] for t, i in vocab.items() if t not in self.specials and t.endswith(suffix))
        if not grow or not all(whole) or suffix and not self._prefixes_hold(pairs, suffix):
            return None
        return tiktoken.Encoding("own", pat_str=f"[^{END}]+{END}" if suffix else BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _prefixes_hold(pairs: list, suffix: str) -> bool:
        """Whether each token without suffix is what merging its characters by the pairs' order gives."""
        rank = {tuple(p): i for i, p in enumerate(pairs)}
        for a, b in pairs:
            if b.endswith(suffix):
                continue
            parts = list(a + b)
            while len(parts) > 1:
                k = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 30))
                if (parts[k], parts[k + 1]) not in rank:
                    return False
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return True

    def _bytes(self, token: str, suffix: str) -> bytes:
        end = bool(suffix) and token.endswith(suffix)
        return bytes(_byte_of()[c] for c in token.removesuffix(suffix) or token) + END.encode() * end

    def plain(self, text: str) -> str:
        """The library's normal form; lower() differs from its case mapping only for sigma and dotted I."""
        if "Σ" in text or "İ" in text:
            return self.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).lower()

    def _settled(self, text: str) -> bool:
        return not any(x in text for x in self.marks) and (text.isascii() or not self.unsettled.search(text))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        fast = [self.merger is not None and self._settled(t) for t in texts]
        if self.normalizer:
            todo = [self.plain(t).split() if f else [] for t, f in zip(texts, fast, strict=True)]
            self._learn({w for words in todo for w in words})
            join = lambda words: np.frombuffer(b"".join(map(self.memo.__getitem__, words)), self.kind)
        else:
            todo, join = texts, lambda t: self.merger.encode_to_numpy(t, disallowed_special=()).astype(self.kind)
        slow = lambda t: np.array(self.whole.encode(t, add_special_tokens=False).ids, self.kind)
        return [join(x) if f else slow(t) for t, x, f in zip(texts, todo, fast, strict=True)]

    def _learn(self, words: set[str]) -> None:
        """Put ids of new words into the memo. White space has no ids here, so words are encoded one by one."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = [w for w in words if w not in self.memo]
        odd = [w for w in new if END in w]
        for w in odd:
            self.memo[w] = np.array(self.whole.encode(w, add_special_tokens=False).ids, self.kind).tobytes()
        new = [w for w in new if END not in w] if odd else new
        if not new:
            return
        split = self.pattern.findall
        pieces = [split(w) for w in new]
        ids = self.merger.encode_to_numpy(END.join([p for own in pieces for p in own] + [""])).astype(self.kind)
        ends = np.append(0, np.flatnonzero(self.closes[ids]) + 1)
        raw, size = ids.tobytes(), ids.itemsize
        at = (ends[np.append(0, np.cumsum([len(own) for own in pieces]))] * size).tolist()
        self.memo.update((w, raw[a:b]) for w, a, b in zip(new, at, at[1:], strict=False))

    @functools.cached_property
    def closes(self) -> np.ndarray:
        return np.array([(self.whole.id_to_token(i) or "").endswith("</w>") for i in range(self.whole.get_vocab_size())])

    def decode(self, ids: np.ndarray) -> str:
        return self.whole.decode(ids.tolist(), skip_special_tokens=False)

    @functools.cached_property
    def spelled(self) -> list[bytes]:
        """The bytes of each id of a byte-level vocabulary."""
        names = (self.whole.id_to_token(i) for i in range(self.whole.get_vocab_size()))
        return [t.encode() if t in self.specials else self._bytes(t, "") for t in names]


@functools.lru_cache(maxsize=1)
def _unsettled() -> str:
    """Characters that became letters or numbers after Unicode 3.2, and the higher planes but for pictographs: regular
    expression engines of different age disagree about them."""
    kind = lambda c, table: k if (k := table.category(c)[0]) in "LNZ" else ""
    young = [c for c in map(chr, range(0x80, 0xD800)) if kind(c, unicodedata) != kind(c, unicodedata.ucd_3_2_0)]
    young += [c for c in map(chr, range(0xE000, 0x10000)) if kind(c, unicodedata) != kind(c, unicodedata.ucd_3_2_0)]
    return f"[{''.join(map(re.escape, young))}\U00010000-\U0001efff\U00020000-\U0010ffff]"


@functools.lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the characters from 256 on."""
    shown = {b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and worker."""
    return Encoder(path)

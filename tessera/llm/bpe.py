"""Encoding with a public byte-level BPE vocabulary by prefix dynamic programming.

BPE gives every byte prefix of a piece exactly one encoding, so a table of each
prefix's last token is a complete encoding of all prefixes.  Entry ``i`` is the
one token that ends at ``i`` and may follow the last token of the prefix before
it.  Appending bytes extends the table; after an edit only entries from the edit
on are renewed, until they agree with the old ones for the longest token's length.

Whether token ``y`` may follow ``x`` depends on the two alone: they may if no
merge crosses their border, that is, if no part on the right edge of ``x``'s
merge tree and part on the left edge of ``y``'s would merge while both exist.

``Encoder`` splits texts into the vocabulary's pieces with vector operations on
code points and looks pieces up in a table of those already encoded (a hash
finds the entry, a comparison of all code points decides); only pieces not met
before run the dynamic programme.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public tokenizers' files lie; every function takes another place.
TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# What follows an apostrophe to make a piece of its own.
SHORT_ENDINGS = ("s", "t", "m", "d")
LONG_ENDINGS = ("re", "ve", "ll")


class Vocabulary:
    """Tokens as ranks, their merge trees, and which may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.tails = {t[i:] for t in ranks for i in range(len(t))}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._edges: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self._follows: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self._halves:
            parts = [self.ranks[bytes([b])] for b in self.tokens[token]]
            while len(parts) > 2:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = self.ranks.get(self.tokens[parts[i]] + self.tokens[parts[i + 1]])
                    if r is not None and r < token and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at : at + 2] = [best]
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """Parts on one edge of the merge tree, each with the rank of the merge
        that ends it (the whole token is never ended)."""
        out = self._edges.get((token, right))
        if out is None:
            out, end = [], float("inf")
            part: int | None = token
            while part is not None:
                out.append((part, end))
                halves, end = self.halves(part), part
                part = halves[right] if halves else None
            self._edges[token, right] = out
        return out

    def follows(self, x: int, y: int) -> bool:
        key = x << 32 | y
        out = self._follows.get(key)
        if out is None:
            out = True
            for a, a_end in self.edge(x, True):
                left = self.tokens[a]
                for b, b_end in self.edge(y, False):
                    m = self.ranks.get(left + self.tokens[b])
                    # equal ranks merge from the left
                    if m is not None and m < a_end and m <= b_end:
                        out = False
                        break
                if not out:
                    break
            if len(self._follows) > 2_000_000:
                self._follows.clear()
            self._follows[key] = out
        return out


class PrefixTable:
    """Last token of every byte prefix of one piece, kept exact under edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = [-1]
        self.append(data)

    def _entry(self, data: bytes, last: list[int], i: int) -> int:
        v = self.vocabulary
        ranks, tails, follows = v.ranks, v.tails, v.follows
        for j in range(i - 1, max(-1, i - v.longest - 1), -1):
            tail = data[j:i]
            if tail not in tails:
                break
            token = ranks.get(tail)
            if token is not None and (j == 0 or follows(last[j], token)):
                return token
        raise ValueError("the vocabulary doesn't hold all bytes")

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        for i in range(start + 1, len(self.data) + 1):
            self.last.append(self._entry(self.data, self.last, i))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes ``start:end``; returns how many entries were renewed."""
        old, shift = self.last, len(new) - (end - start)
        data = self.data[:start] + new + self.data[end:]
        last, same = old[: start + 1], 0
        for i in range(start + 1, len(data) + 1):
            last.append(self._entry(data, last, i))
            same = same + 1 if i > start + len(new) and last[i] == old[i - shift] else 0
            if same >= self.vocabulary.longest and i >= start + len(new) + self.vocabulary.longest:
                renewed = i - start
                last.extend(old[i - shift + 1 :])
                break
        else:
            renewed = len(data) - start
        self.data, self.last = data, last
        return renewed

    def tokens(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= len(self.vocabulary.tokens[self.last[i]])
        return out[::-1]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: 0 other, 1 letter, 2 number, 3 white space."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    at = lambda i: i if i < 0xD800 else i + 0x800
    for k, kind in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(kind, every):
            a, b = at(m.start()), at(m.end() - 1) + 1
            out[a:b] = k
    out[0xD800:0xE000] = 0
    return out


def piece_starts(cp: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Where pieces begin in code points ``cp`` of texts that begin at ``new``.

    Pieces are runs of letters, numbers or other signs, each with one blank
    before it if there is one; short endings after a lone apostrophe; and runs of
    white space, less their last sign if something follows.
    """
    n = len(cp)
    cls = _classes()[cp]
    first = np.zeros(n + 1, bool)
    first[new] = True
    first[n] = True
    run = first.copy()
    run[1:n] |= cls[1:] != cls[:-1]
    start = run[:n].copy()
    space = cls == 3
    # last white space before another sign of the same text
    e = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
    start[e] = True
    start[e[cp[e] == 0x20] + 1] = False
    q = np.flatnonzero((cp[:-1] == 0x27) & start[:-1] & (cls[1:] == 1) & ~first[1:n])
    if len(q):
        one = np.isin(cp[q + 1], [ord(c) for c in SHORT_ENDINGS])
        two = np.zeros(len(q), bool)
        inside = (q + 2 < n) & ~first[np.minimum(q + 2, n)]
        nxt = cp[np.minimum(q + 2, n - 1)]
        for a, b in LONG_ENDINGS:
            two |= inside & (cp[q + 1] == ord(a)) & (nxt == ord(b))
        start[q[one | two] + 1] = False
        for hit, length in ((one, 2), (two & ~one, 3)):
            ends = q[hit] + length
            start[ends[ends < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of whole texts, with a bounded table of pieces already encoded."""

    BITS, MOST_PIECES, MOST_SIGNS = 20, 400_000, 8_000_000
    CHUNK = 1 << 18

    def __init__(self, path: str):
        self.vocabulary = Vocabulary.load(path)
        rng = np.random.default_rng(1)
        self._weights = rng.integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._reset()

    def _reset(self) -> None:
        self._slots = np.full(1 << self.BITS, -1, np.int32)
        self._n = self._signs_n = self._ids_n = 0
        self._hash = np.zeros(1024, np.uint64)
        self._at = np.zeros(1024, np.int64)
        self._len = np.zeros(1024, np.int32)
        self._id_at = np.zeros(1024, np.int64)
        self._count = np.zeros(1024, np.int32)
        self._signs = np.zeros(1 << 14, np.uint32)
        self._ids = np.zeros(1 << 14, np.int32)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.zeros(max(n, 2 * len(a)), a.dtype)
        out[: len(a)] = a
        return out

    def piece(self, text: str) -> list[int]:
        data = text.encode("utf-8", "surrogatepass")
        whole = self.vocabulary.ranks.get(data)
        return [whole] if whole is not None else PrefixTable(self.vocabulary, data).tokens()

    def _add(self, h: int, signs: np.ndarray) -> None:
        ids = self.piece(signs.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"))
        k = self._n
        for name in ("_hash", "_at", "_len", "_id_at", "_count"):
            setattr(self, name, self._room(getattr(self, name), k + 1))
        self._signs = self._room(self._signs, self._signs_n + len(signs))
        self._ids = self._room(self._ids, self._ids_n + len(ids))
        self._signs[self._signs_n : self._signs_n + len(signs)] = signs
        self._ids[self._ids_n : self._ids_n + len(ids)] = ids
        self._hash[k], self._at[k], self._len[k] = h, self._signs_n, len(signs)
        self._id_at[k], self._count[k] = self._ids_n, len(ids)
        self._n, self._signs_n, self._ids_n = k + 1, self._signs_n + len(signs), self._ids_n + len(ids)
        mask, slot = (1 << self.BITS) - 1, int(h) >> (64 - self.BITS)
        while self._slots[slot] >= 0:
            slot = (slot + 1) & mask
        self._slots[slot] = k

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 if there is none."""
        mask = (1 << self.BITS) - 1
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = self._slots[slot]
        todo = np.flatnonzero((out >= 0) & (self._hash[out] != h))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            k = self._slots[slot[todo]]
            out[todo] = k
            todo = todo[(k >= 0) & (self._hash[k] != h[todo])]
        return out

    def _entries(self, cp: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table entry and begin of every piece."""
        if self._n > self.MOST_PIECES or self._signs_n > self.MOST_SIGNS:
            self._reset()
        at = piece_starts(cp, new)
        size = np.diff(np.append(at, len(cp)))
        inside = np.arange(len(cp)) - np.repeat(at, size)
        mixed = (cp.astype(np.uint64) + np.uint64(0x9E37)) * self._weights[inside & 255] * (inside.astype(np.uint64) + np.uint64(1))
        h = np.add.reduceat(mixed, at)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + size.astype(np.uint64)
        k = self._find(h)
        lost = np.flatnonzero(k < 0)
        if len(lost):
            _, one = np.unique(h[lost], return_index=True)
            for i in lost[one].tolist():
                self._add(h[i], cp[at[i] : at[i] + size[i]])
            k[lost] = self._find(h[lost])
        # the hash only finds; all code points decide
        same = self._len[k] == size
        if not same.all():
            raise_at = np.flatnonzero(~same)
        else:
            flat = np.repeat(self._at[k], size) + inside
            bad = np.flatnonzero(self._signs[flat] != cp)
            raise_at = np.unique(np.searchsorted(at, bad, "right") - 1) if len(bad) else bad
        for i in raise_at.tolist():  # a collision gets an entry of its own, out of the table's reach
            slots = self._slots.copy()
            self._add(h[i], cp[at[i] : at[i] + size[i]])
            self._slots = slots
            k[i] = self._n - 1
        return k, at

    def _chunks(self, texts: list[str | None]):
        """Groups of texts of about CHUNK signs: first, last, code points, begins."""
        a = 0
        while a < len(texts):
            b, n = a, 0
            while b < len(texts) and (b == a or n + len(texts[b] or "") <= self.CHUNK):
                n += len(texts[b] or "")
                b += 1
            part = [t or "" for t in texts[a:b]]
            cp = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4")
            begins = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
            yield cp, begins
            a = b

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)`` of all texts; null and empty texts have no ids."""
        offsets, ids, base = [np.zeros(1, np.int64)], [], 0
        for cp, begins in self._chunks(texts):
            if not len(cp):
                offsets.append(np.full(len(begins) - 1, base, np.int64))
                continue
            new = begins[:-1][begins[:-1] < begins[1:]]
            k, at = self._entries(cp, new)
            count = self._count[k]
            total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
            where = np.repeat(self._id_at[k] - total[:-1], count) + np.arange(total[-1])
            ids.append(self._ids[where])
            offsets.append(base + total[np.searchsorted(at, begins[1:])])
            base += int(total[-1])
        return np.concatenate(offsets), np.concatenate(ids) if ids else np.zeros(0, np.int32)

    def count_batch(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        out = []
        for cp, begins in self._chunks(texts):
            if not len(cp):
                out.append(np.zeros(len(begins) - 1, np.int64))
                continue
            k, at = self._entries(cp, begins[:-1][begins[:-1] < begins[1:]])
            total = np.concatenate([[0], np.cumsum(self._count[k], dtype=np.int64)])
            out.append(np.diff(total[np.searchsorted(at, begins)]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[1].tolist()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file in a worker process."""
    return Encoder(path)


def _slices(batch: pa.RecordBatch, text: str, most: int = 1 << 23):
    """The batch in slices of about ``most`` bytes of text, so that long texts
    don't add up."""
    sizes = np.cumsum([0, *(len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text))])
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, bisect_right(sizes, sizes[a] + most) - 1)
        yield batch.slice(a, b - a)
        a = b


def encode_column(df: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``<key>, ids``: the ids of each row's whole ``text``, without special
    tokens; what looks like one is ordinary text.

    Null and empty texts give an empty array.  Rows are encoded where they are,
    without a shuffle; repeated rows stay repeated; other columns are not read.
    """
    path = f"{tokenizers}/{vocabulary}"
    src = df.select(key, text)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for part in _slices(batch, text):
                offsets, ids = enc.encode_batch(part.column(text).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(key), lists], names=[key, "ids"])

    kind = src.schema[key].dataType.simpleString()
    return src.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_column(df: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``<key>, n_tokens``: the number of ids ``encode_column`` gives (bigint)."""
    path = f"{tokenizers}/{vocabulary}"
    src = df.select(key, text)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for part in _slices(batch, text):
                n = enc.count_batch(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    kind = src.schema[key].dataType.simpleString()
    return src.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")

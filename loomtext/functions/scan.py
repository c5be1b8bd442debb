"""Finding many keys in many texts at once, inside a task: numpy over the bytes of an Arrow batch.

A key of n bytes is looked for by its first w, where w is the largest power of two up to n: hashes of all runs of w bytes tell where a
key of this class may begin, and at these few places the hashes of whole keys are compared, of each length that the class has. Sums
of prefixes give the hash of any run in one step, so neither keys with a common beginning nor short ones cost more than others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of texts that are searched at once (and as many as the longest key beyond).
PIECE = 1 << 20
#: Places times lengths that are compared at once.
PAIRS = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U)


class Runs:
    """Hashes of any runs of bytes of a buffer; equal runs have equal hashes, wherever they stand."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum((buf.astype(U) + U(1)) * _powers(_INVERSE, n), dtype=U)])
        self.powers = _powers(_BASE, n + 1)

    def at(self, begin: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[begin + size] - self.sums[begin]) * self.powers[begin] + U(size) if isinstance(size, int) else (self.sums[begin + size] - self.sums[begin]) * self.powers[begin] + size.astype(U))


def classes_of(sizes: np.ndarray) -> dict[int, np.ndarray]:
    """Of each class (a power of two) the lengths that it has."""
    out: dict[int, list[int]] = {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        out.setdefault(1 << (n.bit_length() - 1), []).append(n)
    return {w: np.array(lengths) for w, lengths in out.items()}


def places(buf: np.ndarray, ends: np.ndarray, upto: int, classes: dict[int, np.ndarray], head, full) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(begin, size, hash) of the runs that may be keys: of those that begin before `upto`, and end by the end of their text (`ends`, of each byte). head(w, hashes) and full(hashes) say which hashes are known."""
    runs = Runs(buf)
    for w, lengths in classes.items():
        n = min(upto, len(buf) - w + 1)
        if n <= 0:
            continue
        begin = np.flatnonzero(head(w, runs.at(np.arange(n), w)))
        begin = begin[begin + w <= ends[begin]]
        step = max(1, PAIRS // len(lengths))
        for k in range(0, len(begin), step):
            b = np.repeat(begin[k : k + step], len(lengths))
            size = np.tile(lengths, len(b) // len(lengths))
            fits = b + size <= ends[b]
            b, size = b[fits], size[fits]
            h = runs.at(b, size)
            known = full(h)
            if known.any():
                yield b[known], size[known], h[known]


def texts_in_pieces(texts: pa.Array, beyond: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """The bytes of all texts piece by piece, with so many bytes beyond: (bytes, the row of each, the place of each in its text, where its text ends among the bytes, how many bytes are the piece's own). Null texts hold nothing."""
    column = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    for at in range(0, len(buf), PIECE):
        to = min(len(buf), at + PIECE + beyond)
        row = np.searchsorted(offsets, np.arange(at, to), "right") - 1
        yield buf[at:to], row, np.arange(at, to) - offsets[row], np.minimum(offsets[row + 1], to) - at, min(PIECE, len(buf) - at)


class Keys:
    """Keys that fit into a task. Empty ones are never found."""

    def __init__(self, keys: list[str]):
        self.texts = keys
        data = [k.encode() for k in keys]
        self.sizes = np.array([len(b) for b in data], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.buf = np.frombuffer(b"".join(data) + b"\0" * 8, np.uint8)
        self.classes = classes_of(self.sizes)
        runs = Runs(self.buf)
        some = np.flatnonzero(self.sizes)
        hashes = runs.at(self.begins[some], self.sizes[some])
        order = np.argsort(hashes, kind="stable")
        self.full, self.number = hashes[order], some[order]
        self.heads = {}
        for w in self.classes:
            own = some[(self.sizes[some] >= w) & (self.sizes[some] < 2 * w)]
            heads = np.unique(runs.at(self.begins[own], w))
            table = np.zeros(1 << 20, bool)
            table[heads >> U(44)] = True
            self.heads[w] = (table, heads)

    def head(self, w: int, h: np.ndarray) -> np.ndarray:
        table, heads = self.heads[w]
        out = table[h >> U(44)]
        some = np.flatnonzero(out)
        out[some] = heads[np.minimum(np.searchsorted(heads, h[some]), len(heads) - 1)] == h[some]
        return out

    def known(self, h: np.ndarray) -> np.ndarray:
        return self.full[np.minimum(np.searchsorted(self.full, h), len(self.full) - 1)] == h

    def equal(self, buf: np.ndarray, begin: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Whether the bytes from `begin` on are those of the key, eight at a step."""
        padded = np.append(buf, np.zeros(8, np.uint8))
        eight, own = (np.ndarray(len(b) - 7, "<u8", np.ascontiguousarray(b), strides=(1,)) for b in (padded, self.buf))
        out, left, done = np.ones(len(begin), bool), np.arange(len(begin)), 0
        while len(left):
            rest = np.minimum(self.sizes[key[left]] - done, 8)
            mask = ~U(0) >> (U(64) - U(8) * rest.astype(U))
            same = (eight[begin[left] + done] ^ own[self.begins[key[left]] + done]) & mask == 0
            out[left[~same]] = False
            done += 8
            left = left[same & (self.sizes[key[left]] > done)]
        return out

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, byte where it begins, number of the key) of every occurrence, by row and place."""
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
        if len(self.full):
            for buf, row, place, ends, own in texts_in_pieces(texts, int(self.sizes.max())):
                for begin, size, h in places(buf, ends, own, self.classes, self.head, self.known):
                    first, last = (np.searchsorted(self.full, h, side) for side in ("left", "right"))
                    many = last - first  # more than one only where two keys share a hash or are equal
                    begin, size = np.repeat(begin, many), np.repeat(size, many)
                    key = self.number[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                    fits = self.sizes[key] == size
                    begin, key = begin[fits], key[fits]
                    same = self.equal(buf, begin, key)
                    begin, key = begin[same], key[same]
                    out.append((row[begin], place[begin], key))
        row, place, key = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((key, place, row))
        return row[order], place[order], key[order]


@dataclass
class Sieve:
    """What is sent to tasks in place of keys that are too many: two tables of bits, for heads and for whole keys, and their lengths. Its size is bounded, whatever the keys; more of them only pass more runs that are none."""

    bits: int
    classes: dict[int, np.ndarray]
    heads: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    whole: np.ndarray = field(default_factory=lambda: np.zeros(0, U))

    @staticmethod
    def spots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Two bits of the table for each hash."""
        return (h >> U(64 - bits)).astype(np.int64), (mix(h ^ U(0x5851F42D4C957F2D)) >> U(64 - bits)).astype(np.int64)

    def has(self, table: np.ndarray, h: np.ndarray) -> np.ndarray:
        one, two = self.spots(h, self.bits)
        out = (table[one >> 6] >> (one & 63).astype(U)) & U(1) > 0
        some = np.flatnonzero(out)
        two = two[some]
        out[some] = (table[two >> 6] >> (two & 63).astype(U)) & U(1) > 0
        return out

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(row, byte where it begins, SHA-256) of the runs that pass: all occurrences of keys, and a few others."""
        rows, at, digests = [], [], []
        most = max((int(x.max()) for x in self.classes.values()), default=0)
        for buf, row, place, ends, own in texts_in_pieces(texts, most):
            data = buf.tobytes()
            for begin, size, _ in places(buf, ends, own, self.classes, lambda w, h: self.has(self.heads, mix(h + U(w))), lambda h: self.has(self.whole, h)):
                rows.append(row[begin])
                at.append(place[begin])
                digests += [hashlib.sha256(data[x:y]).digest() for x, y in zip(begin.tolist(), (begin + size).tolist(), strict=True)]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *at]), digests


def sieve_hashes(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each key that isn't empty: the hashes of its head and of all of it, as a Sieve has them."""
    known = Keys([k for k in keys.to_pylist() if k])
    runs, w = Runs(known.buf), 1 << (np.floor(np.log2(np.maximum(known.sizes, 1))).astype(np.int64))
    return mix(runs.at(known.begins, w) + w.astype(U)), runs.at(known.begins, known.sizes)

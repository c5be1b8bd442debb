"""Texts of an Arrow batch as one run of bytes, so that numpy handles all of them at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash

#: White space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: All but ASCII letters and the bytes of letters beyond ASCII.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_tails = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Spans of more bytes than this are hashed one by one.
LONG = 512


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Texts:
    buf: np.ndarray
    #: Of each text, where it begins; then where the last one ends.
    offsets: np.ndarray
    #: Whether A-Z hash as a-z.
    fold: bool = True
    #: Which bytes end a word.
    gaps: np.ndarray = field(default_factory=lambda: SPACE)

    @classmethod
    def of(cls, column: pa.Array, fold: bool = True) -> Texts:
        """Nulls count as empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary()).fill_null(b"") if not pa.types.is_large_binary(column.type) else column.fill_null(b"")
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
        buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        return cls(buf, offsets - offsets[0], fold)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    @cached_property
    def filled(self) -> np.ndarray:
        """Which texts have bytes."""
        return np.flatnonzero(self.sizes)

    def total(self, of_byte: np.ndarray) -> np.ndarray:
        """Of each text, the sum over its bytes."""
        out = np.zeros(len(self))
        if len(self.filled):
            out[self.filled] = np.add.reduceat(of_byte, self.offsets[self.filled], dtype=np.int64)
        return out

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word begins and ends, and of each text the number of its first word (then the count of all)."""
        full = ~self.gaps[self.buf]
        begins, ends = full.copy(), full.copy()
        begins[1:] &= ~full[:-1]
        ends[:-1] &= ~full[1:]
        if len(self.filled):
            begins[self.offsets[self.filled]] = full[self.offsets[self.filled]]
            last = self.offsets[self.filled + 1] - 1
            ends[last] = full[last]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return begins, ends, np.searchsorted(begins, self.offsets)

    @cached_property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.words[2]))

    @cached_property
    def eights(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes as they hash, and the eight of them from each place on as one number."""
        padded = np.zeros(len(self.buf) + 8, np.uint8)
        padded[: len(self.buf)] = LOWER[self.buf] if self.fold else self.buf
        return padded, np.ndarray(len(self.buf) + 1, "<u8", padded, strides=(1,))

    def hashes(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the bytes between; equal bytes have equal hashes wherever they stand. Eight bytes a step, mixed between steps."""
        padded, eight = self.eights
        size = (ends - begins).astype(np.int64)
        out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for k in np.flatnonzero(size > LONG).tolist():
            out[k] = xxhash.xxh3_64_intdigest(padded[begins[k] : ends[k]])
        left, done = np.flatnonzero(size <= LONG), 0
        while len(left):
            rest = size[left] - done
            out[left] = mix(out[left] ^ (eight[begins[left] + done] & _tails[np.clip(rest, 0, 8)]))
            left, done = left[rest > 8], done + 8
        return out

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.hashes(*self.words[:2])


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Parts of the batches with about `most` bytes of text (one longer text stays whole), and their texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = Texts.of(batch.column(text))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(texts.offsets, texts.offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), Texts(texts.buf[texts.offsets[at] : texts.offsets[to]], texts.offsets[at : to + 1] - texts.offsets[at])
            at = to


def segments(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches that are ordered by them."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(n, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        starts = [0, *np.flatnonzero(new).tolist(), n]
        if held and before != first:
            yield pa.Table.from_batches(held)
            held = []
        for x, y in zip(starts, starts[1:], strict=False):
            if x:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
        before = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def string_array(values: list) -> pa.Array:
    return pa.array(values, pa.string())

"""Byte-pair encoding with forced boundaries, and decoding.

A pair of bytes that stands inside no token of the vocabulary can never be merged across, so a text may be cut there and
the fragments encoded one by one. Two guards keep the pre-tokeniser's view unchanged: no cut after white space (it looks
ahead from a run of it) or before an apostrophe (it may begin a contraction). Fragments repeat a lot, so each distinct one
is encoded once a worker (in a bounded memo) and a text is a row of memo entries.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import carried, column, others
from loomtext.llm.textbatch import Texts, slices, string_array

#: Fixed value: the pattern that the byte-level pre-tokeniser splits by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of fragments and their ids that a worker remembers, about; then it begins anew. Longer fragments are not remembered.
MEMO, LONG = 24 << 20, 256
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else the next free one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(free)) for b in range(256)]


class Vocabulary:
    """Tokens and merges of a byte-level BPE file (the JSON format of the tokenizers library)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only plain byte-level vocabularies are known here")
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        vocab = spec["model"]["vocab"]
        self.added = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token
        self.first = np.array([vocab[letter] for letter in byte_letters()], np.int64)
        self.base = len(self.bytes_of)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = np.append(keys[order], -1), np.append(order, NONE).astype(np.int32)
        # where a pair is among the keys: by its hash, and where two pairs share one, by another hash
        self.slots = [np.full(1 << 20, len(order), np.int32) for _ in range(2)]
        rest = np.arange(len(order))
        for k, slots in enumerate(self.slots):
            at = self.slot(self.keys[rest], k)
            slots[at] = rest
            rest = rest[slots[at] != rest]
        if len(rest):
            raise ValueError("two hashes don't tell all pairs apart")
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.inside = np.zeros((256, 256), bool)
        for token in self.bytes_of:
            b = np.frombuffer(token, np.uint8)
            self.inside[b[:-1], b[1:]] = True
        left, right = np.arange(256)[:, None], np.arange(256)[None, :]
        #: Pairs of bytes that a text is cut between.
        self.cut = (~self.inside & (left > 0x20) & (left < 0x7F) & ((right < 0x80) | (right >= 0xC0)) & (right != 0x27)).ravel()
        self.words = regex.compile(PATTERN)
        self.memo: dict[bytes, bytes] = {}
        self.held = 0

    @staticmethod
    def slot(keys: np.ndarray, k: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64((0x9E3779B97F4A7C15, 0xD1342543DE82EF95)[k])) >> np.uint64(44)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; NONE without one."""
        at = self.slots[0][self.slot(keys, 0)]
        if len(other := np.flatnonzero(self.keys[at] != keys)):
            at[other] = again = self.slots[1][self.slot(keys[other], 1)]
            at[other[self.keys[again] != keys[other]]] = len(self.keys) - 1
        return self.rank[at]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Of each word, its ids as little-endian 32-bit integers. All words advance together: in a round each makes its best merge, wherever that pair stands."""
        out: list[bytes] = [b""] * len(words)
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids, word = self.first[flat], np.repeat(np.arange(len(words)), [len(w) for w in words])
        while len(ids):
            same = word[1:] == word[:-1]
            key = ids[:-1] * self.base + ids[1:]
            rank = np.where(same, self.find(key), NONE)
            rank = np.append(rank, NONE).astype(np.int32)
            begins = np.flatnonzero(np.append(True, ~same))
            best = np.minimum.reduceat(rank, begins)
            counts = np.diff(np.append(begins, len(ids)))
            if (done := best == NONE).any():
                packed = ids.astype("<u4").tobytes()
                for k in np.flatnonzero(done).tolist():
                    out[word[begins[k]]] = packed[4 * begins[k] : 4 * (begins[k] + counts[k])]
                keep = np.repeat(~done, counts)
                ids, word, rank, best = ids[keep], word[keep], rank[keep], best[~done]
                counts = counts[~done]
                if not len(ids):
                    break
            hit = rank == np.repeat(best, counts)
            place = np.flatnonzero(hit)
            follows = np.append(False, (place[1:] == place[:-1] + 1)) if len(place) else np.zeros(0, bool)
            run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(place))))
            place = place[(np.arange(len(place)) - run) % 2 == 0]  # of a run of equal tokens, every other pair
            ids[place] = self.merged[rank[place]]
            keep = np.ones(len(ids), bool)
            keep[place + 1] = False
            ids, word = ids[keep], word[keep]
        return out

    def learn(self, fragments: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each of these fragments; the short ones go into the memo."""
        parts: list[list[bytes]] = []
        for f in fragments:
            x = f.decode("utf-8", "replace")
            parts.append([f] if (x[1:] if x[0] == " " else x).isalpha() else [w.encode() for w in self.words.findall(x)])
        new = list({w: None for p in parts for w in p})
        known = dict(zip(new, self.merge(new), strict=True))
        ids = {f: known[p[0]] if len(p) == 1 else b"".join(map(known.__getitem__, p)) for f, p in zip(fragments, parts, strict=True)}
        short = {f: i for f, i in ids.items() if len(f) <= LONG}
        size = sum(len(f) + len(i) + 200 for f, i in short.items())  # 200: what two objects and an entry take besides
        if self.held + size > MEMO:
            self.memo, self.held = {}, 0
        self.memo |= short
        self.held += size
        return ids

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (then where the last one's end)."""
        buf, offsets = texts.buf, texts.offsets
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data = buf.tobytes()
        begins = np.zeros(len(buf) + 1, bool)
        begins[1:-1] = self.cut[buf[:-1].astype(np.uint16) * np.uint16(256) + buf[1:]]
        bounds = set(offsets.tolist())
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                if bounds.isdisjoint(range(at + 1, at + len(token))):
                    begins[at + 1 : at + len(token)] = False
                    begins[[at, at + len(token)]] = True
                    at += len(token) - 1
                at = data.find(token, at + 1)
        begins[offsets] = True
        begins = np.flatnonzero(begins)
        one, which = distinct(texts, begins)
        fragments = [data[x:y] for x, y in zip(begins[one].tolist(), begins[one + 1].tolist(), strict=True)]
        memo = self.memo
        own = {token: np.array([i], "<u4").tobytes() for token, i in self.added.items()}
        if new := [f for f in fragments if f not in memo and f not in own]:
            own |= self.learn(new)
        packed = [own[f] if f in own else memo[f] for f in fragments]
        ids, sizes = gather(np.frombuffer(b"".join(packed), "<u4"), np.array([len(x) // 4 for x in packed]), which)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(begins, offsets)]

    @cached_property
    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(self.bytes_of), np.uint8), np.array([len(b) for b in self.bytes_of])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of these ids; bytes that are not UTF-8 become U+FFFD."""
        flat, sizes = gather(*self.token_bytes, ids)
        data, at = flat.tobytes(), np.concatenate([[0], np.cumsum(sizes)])[bounds].tolist()
        return [data[x:y].decode("utf-8", "replace") for x, y in zip(at, at[1:], strict=False)]


def gather(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `flat` (the i-th has sizes[i] items) that `which` names, one after another, and their sizes."""
    begins, taken = np.cumsum(sizes) - sizes, sizes[which]
    return flat[np.repeat(begins[which] - (np.cumsum(taken) - taken), taken) + np.arange(taken.sum())], taken


def distinct(texts: Texts, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fragments between `begins` that stand for all that are equal to them, and of each fragment the number of the one that does.

    Hashes find them, bytes decide: put in place of the fragments they stand for, they must give the buffer itself, and a
    fragment where they don't stands for itself.
    """
    _, one, which = np.unique(texts.hashes(begins[:-1], begins[1:]), return_index=True, return_inverse=True)
    sizes = np.diff(begins)
    equal = sizes[one][which] == sizes
    if equal.all():
        again = np.repeat(begins[one][which] - begins[:-1], sizes) + np.arange(len(texts.buf))
        wrong = np.flatnonzero(texts.buf[again] != texts.buf)
        equal[np.searchsorted(begins, wrong, "right") - 1] = False
    if not equal.all():  # two fragments share a hash: all are told apart by their bytes
        data = texts.buf.tobytes()
        first: dict[bytes, int] = {}
        named = [first.setdefault(data[x:y], len(first)) for x, y in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
        which = np.array(named)
        one = np.unique(which, return_index=True)[1]
    return one, which


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """One vocabulary a worker process."""
    text = shared.value
    if text not in _loaded:
        _loaded.clear()
        _loaded[text] = Vocabulary(text)
    return _loaded[text]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, proof: bool = False) -> DataFrame:
    """Adds `ids` (array<int>) of each whole text: what the tokenizers library gives without adding special tokens.

    A null text counts as empty (no ids); a text that holds the literal of an added token gets that token's id. Only the
    columns in `keep` (all but the text, if None) go along; rows may repeat and nothing depends on their order.
    With `proof` there is also decoded_sha256, of the UTF-8 of what the ids decode to.
    `vocabulary` is the JSON itself (about a megabyte, whatever the input), which Spark broadcasts.
    """
    added = ["ids array<int>", "decoded_sha256 string"][: 1 + proof]
    keep = others(docs.columns, text, *(x.split()[0] for x in added)) if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        v = _vocabulary(shared)
        for part, texts in slices(batches):
            texts.fold = False
            flat, bounds = v.encode(texts)
            ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield part, [ids, *([string_array([hashlib.sha256(x.encode()).hexdigest() for x in v.decode(flat, bounds)])] if proof else [])]

    return carried(docs, keep, {"text": column(text)}, ", ".join(added), work)


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds `decoded`, the text that the ids stand for; null ids give an empty text."""
    keep = others(rows.columns, ids, "decoded") if keep is None else keep
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        v = _vocabulary(shared)
        for batch in batches:
            lists = batch.column("ids").cast(pa.list_(pa.int32()))
            flat, bounds = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)))]).astype(int)
            yield batch, [string_array(v.decode(flat.astype(np.int64), bounds))]

    return carried(rows, keep, {"ids": column(ids)}, "decoded string", work)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Encodes and decodes in one pass, so the ids are not shuffled or stored."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared)
        for part, texts in slices(batches):
            texts.fold = False
            ids, bounds = v.encode(texts)
            packed, at = ids.tobytes(), bounds.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(bounds), pa.int64()),
                    string_array([hashlib.sha256(packed[4 * x : 4 * y]).hexdigest() for x, y in zip(at, at[1:], strict=False)]),
                    string_array([hashlib.sha256(x.encode()).hexdigest() for x in v.decode(ids, bounds)]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()

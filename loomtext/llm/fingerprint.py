"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests.

A paragraph is a line; a long one is cut where a word's hash says so, so that an edit moves no cut but its own. Equal
paragraphs of a text count as many as they are (the digest holds the number of the repetition). A sketch has cells of a
count, the XOR of the digests and the XOR of their check sums; a digest goes to three cells. Two sketches of one size
subtract cell by cell, and peeling cells of one digest recovers what the texts don't share.

A fingerprint is a sketch of a size that follows from its number of digests, doubled until it can be peeled by itself. So
a fingerprint gives back its digests, and two of different sizes can still be compared: the smaller one is laid out anew in the
other's size. Where the difference is too much for that size, both are laid out twice as large, until peeling ends.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import carried, column, others
from loomtext.llm.textbatch import Texts, mix, slices, string_array

#: Words of a paragraph: about so many between cuts by content, so many at most.
USUAL, MOST = 8, 32
#: Cells of a sketch for each digest at first; the least third of a sketch.
FIRST, LEAST = 1.5, 2
U = np.uint64


@dataclass
class Digests:
    """Paragraph digests of a batch of texts: those of text i are key[bounds[i]:bounds[i + 1]]."""

    key: np.ndarray
    bounds: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The digests of these texts, one after another, and for each the number of the row it is for."""
        sizes = self.sizes[rows]
        at = np.repeat(self.bounds[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(rows) else np.zeros(0, int)
        return self.key[at], np.repeat(np.arange(len(rows)), sizes)


def digests(texts: Texts) -> Digests:
    begins, ends, first = texts.words
    if not len(begins):  # only white space, if anything
        cut = texts.offsets[texts.filled]
    else:
        new = np.zeros(len(begins) + 1, bool)
        new[first[:-1]] = True
        new = new[:-1]
        line = np.concatenate([[0], np.cumsum(texts.buf == 10)])
        new[1:] |= line[begins[1:]] > line[ends[:-1]]
        new[1:] |= texts.word_hashes[:-1] % U(USUAL) == 0
        at = np.arange(len(begins))
        new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % MOST == 0
        cut = begins[new]
        # what stands before the first word belongs to it; texts of white space only are one paragraph
        own = np.searchsorted(cut, texts.offsets)
        has = own[1:] > own[:-1]
        cut[own[:-1][has]] = texts.offsets[:-1][has]
        blank = texts.filled[~has[texts.filled]]
        cut = np.sort(np.concatenate([cut, texts.offsets[blank]]))
    bounds = np.searchsorted(cut, texts.offsets)
    key = texts.hashes(cut, np.append(cut[1:], len(texts.buf))) if len(cut) else np.zeros(0, U)
    found = Digests(key, bounds)
    # the number of the repetition goes into the digest
    order = np.lexsort((key, owner := found.owner))
    k, o = key[order], owner[order]
    same = np.append(False, (k[1:] == k[:-1]) & (o[1:] == o[:-1])) if len(k) else np.zeros(0, bool)
    at = np.arange(len(k))
    nth = at - np.maximum.accumulate(np.where(same, 0, at)) if len(k) else at
    out = np.empty_like(key)
    out[order] = mix(k + nth.astype(U) * U(0xA24BAED4963EE407))
    return Digests(out, bounds)


def places(key: np.ndarray, cells: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The three cells of each digest in a sketch of so many cells (a multiple of three) that begins at `base`."""
    third = (cells // 3).astype(U)
    return np.concatenate([base + (mix(key + U((j + 1) * 0x9FB21C651E98DF25 % 2**64) + third) % third + U(j) * third).astype(np.int64) for j in range(3)])


def check(key: np.ndarray) -> np.ndarray:
    return (mix(key ^ U(0x5851F42D4C957F2D)) >> U(32)).astype(np.uint32)


class Sketches:
    """Sketches of a batch, one after another; cells[i] of them belong to the i-th."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.base = cells, np.concatenate([[0], np.cumsum(cells)])
        n = int(self.base[-1])
        self.count, self.keys, self.checks = np.zeros(n, np.int32), np.zeros(n, U), np.zeros(n, np.uint32)

    def add(self, key: np.ndarray, owner: np.ndarray, sign: np.ndarray | int) -> Sketches:
        at = places(key, self.cells[owner], self.base[owner])
        self.count += np.bincount(at, np.tile(np.broadcast_to(sign, key.shape), 3), len(self.count)).astype(np.int32)
        np.bitwise_xor.at(self.keys, at, np.tile(key, 3))
        np.bitwise_xor.at(self.checks, at, np.tile(check(key), 3))
        return self

    def less(self, other: Sketches) -> Sketches:
        """Cell by cell what is left of these sketches without the others, of the same sizes."""
        out = Sketches(self.cells)
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests, the sketch that each came from, its sign (1 in the first, -1 in what was subtracted), and of each sketch whether nothing is left in it. Empties the sketches."""
        found: list[tuple] = [(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        cell_owner = np.repeat(np.arange(len(self.cells)), self.cells)
        for _ in range(200):
            at = np.flatnonzero(np.abs(self.count) == 1)
            at = at[check(self.keys[at]) == self.checks[at]]
            if not len(at):
                break
            key, owner, sign = self.keys[at], cell_owner[at], self.count[at]
            order = np.lexsort((key, owner))
            fresh = np.append(True, (np.diff(owner[order]) != 0) | (key[order][1:] != key[order][:-1]))
            one = order[fresh]
            key, owner, sign = key[one], owner[one], sign[one]
            self.add(key, owner, -sign)
            found.append((key, owner, sign))
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        key, owner, sign = (np.concatenate(x) for x in zip(*found, strict=True))
        return key, owner, sign, np.bincount(cell_owner, left, len(self.cells)) == 0

    def part(self, rows: np.ndarray) -> Sketches:
        """The sketches of these rows."""
        out = Sketches(self.cells[rows])
        at = np.repeat(self.base[rows] - out.base[:-1], out.cells) + np.arange(out.base[-1])
        out.count, out.keys, out.checks = self.count[at], self.keys[at], self.checks[at]
        return out

    def text(self) -> list[str]:
        """Each sketch as a string: counts, digests and check sums of its cells, in base64."""
        out = []
        for a, b in zip(self.base.tolist(), self.base[1:].tolist(), strict=False):
            out.append(base64.b64encode(self.count[a:b].tobytes() + self.keys[a:b].tobytes() + self.checks[a:b].tobytes()).decode())
        return out

    @classmethod
    def of_text(cls, texts: list[str | None]) -> Sketches:
        raw = [base64.b64decode(x or "") for x in texts]
        out = cls(np.array([len(x) // 16 for x in raw], np.int64))
        for a, b, x in zip(out.base.tolist(), out.base[1:].tolist(), raw, strict=False):
            n = b - a
            out.count[a:b], out.keys[a:b], out.checks[a:b] = np.frombuffer(x, "<i4", n), np.frombuffer(x, "<u8", n, 4 * n), np.frombuffer(x, "<u4", n, 12 * n)
        return out


def sketched(x: Digests) -> Sketches:
    """The fingerprints: sketches that peel by themselves, each in the first size of its row that does."""
    n = len(x.bounds) - 1
    third = np.maximum(LEAST, 1 << np.ceil(np.log2(np.maximum(FIRST * x.sizes / 3, 1))).astype(np.int64))
    todo = np.arange(n)
    while len(todo):
        *_, whole = Sketches(3 * third[todo]).add(*x.take(todo), 1).peel()
        todo = todo[~whole]
        third[todo] *= 2
    return Sketches(3 * third).add(x.key, x.owner, 1)


def differences(a: Sketches, b: Sketches, of_a: Digests, of_b: Digests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row by row what two fingerprints don't share: digests, the rows, signs (1: only in a, -1: only in b). of_a and of_b are what the fingerprints give back when peeled."""
    cells = np.maximum(a.cells, b.cells)
    todo, found = np.arange(len(cells)), []
    while len(todo):
        sides = []
        for own, of in ((a, of_a), (b, of_b)):
            fits = own.cells[todo] == cells[todo]
            side = Sketches(cells[todo])
            at = np.repeat(fits, side.cells)
            if fits.any():
                as_they_are = own.part(todo[fits])
                side.count[at], side.keys[at], side.checks[at] = as_they_are.count, as_they_are.keys, as_they_are.checks
            if not fits.all():
                key, row = of.take(todo[~fits])
                side.add(key, np.flatnonzero(~fits)[row], 1)
            sides.append(side)
        key, row, sign, whole = sides[0].less(sides[1]).peel()
        good = whole[row]
        found.append((key[good], todo[row[good]], sign[good]))
        todo = todo[~whole]
        cells[todo] *= 2
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int32))


def likeness(a: Sketches, b: Sketches, of_a: Digests, of_b: Digests) -> np.ndarray:
    """Row by row, shared digests over all digests of both. Two empty texts: 1."""
    both = of_a.sizes + of_b.sizes
    differ = np.bincount(differences(a, b, of_a, of_b)[1], minlength=len(both))
    return np.where(both == 0, 1.0, (both - differ) / np.maximum(both + differ, 1))


def given_back(x: Sketches) -> Digests:
    """The digests that fingerprints hold."""
    n = len(x.cells)
    key, owner, _, whole = x.part(np.arange(n)).peel()
    if not whole.all():
        raise ValueError("not a fingerprint: its sketch can't be peeled")
    order = np.lexsort((key, owner))
    return Digests(key[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]))


def fingerprinted(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The rows of docs with a column `name`: the fingerprint of the whole text (null: of an empty one). It replaces a column of that name."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for part, texts in slices(batches):
            texts.fold = False
            yield part, [string_array(sketched(digests(texts)).text())]

    return carried(docs, others(docs.columns, name), {"text": column(text)}, f"`{name}` string", work)


def compared(rows: DataFrame, before: str, after: str) -> DataFrame:
    """The rows with `likeness` (0 to 1), `removed` and `added`: the paragraph digests (longs, in order) that only the fingerprint in column `before`, or only that in `after`, holds. A null fingerprint is that of an empty text. These columns replace others of their names."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a, b = (Sketches.of_text(part.column(c).to_pylist()) for c in ("before", "after"))
                of_a, of_b = given_back(a), given_back(b)
                key, row, sign = differences(a, b, of_a, of_b)
                lists = []
                for s in (1, -1):
                    mine = np.flatnonzero(sign == s)
                    mine = mine[np.lexsort((key[mine].view(np.int64), row[mine]))]
                    bounds = np.concatenate([[0], np.cumsum(np.bincount(row[mine], minlength=part.num_rows))])
                    lists.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(key[mine].view(np.int64))))
                yield part, [pa.array(likeness(a, b, of_a, of_b)), *lists]

    return carried(rows, others(rows.columns, "likeness", "removed", "added"), {"before": column(before), "after": column(after)}, "likeness double, removed array<bigint>, added array<bigint>", work)


def _range_of(key: F.Column, splits: list[int]) -> F.Column:
    """How many of the splits, which are in order, are at most the key: by halving."""
    lists = F.array(*map(F.lit, splits)) if splits else F.array().cast("array<bigint>")

    def halved(s: F.Column, _) -> F.Column:
        middle = ((s["lo"] + s["hi"]) / 2).cast("int")
        narrower = F.when(F.get(lists, middle) <= key, F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))
        return F.when(s["lo"] >= s["hi"], s).otherwise(narrower)

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splits)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(splits).bit_length()))), start, halved)["lo"]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, tail, key, doc_id, text), ordered within their partition, such that the document after each one in ascending doc_id follows it.

    Ids are dealt by range into buckets; the first document of each bucket also visits the end of the bucket before, that
    of all documents the end of the last. Only one id per bucket comes to the driver. Rows without id come first, in order of a hash
    of their texts (in buckets of their own, so many of them are many buckets); equal keys follow each other by text.
    """
    spark = docs.sparkSession
    none = F.col("doc_id").isNull()
    docs = docs.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("key"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = [sorted({int(x) for x in docs.where(part).approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n)}) for part in (none, ~none)]
    dealt = docs.withColumn("bucket", F.when(none, _range_of(F.col("key"), bounds[0])).otherwise(_range_of(F.col("key"), bounds[1]) + len(bounds[0]) + 1))
    firsts = dict(dealt.groupBy("bucket").agg(F.min("key")).collect())
    filled = sorted(firsts)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}  # the first one's is the last
    size = (filled[-1] + 1) if filled else 1
    least = F.array(*(F.lit(firsts.get(b)).cast("bigint") for b in range(size)))
    prior = F.array(*(F.lit(before.get(b)).cast("int") for b in range(size)))
    visits = F.get(least, F.col("bucket")) == F.col("key")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("tail"))
    guest = F.struct(F.get(prior, F.col("bucket")).alias("bucket"), F.lit(1).alias("tail"))
    rows = dealt.select("key", "doc_id", "text", F.explode(F.when(visits, F.array(own, guest)).otherwise(F.array(own))).alias("to"))
    return rows.select("to.bucket", "to.tail", "key", "doc_id", "text").repartition("bucket").sortWithinPartitions("bucket", "tail", "key", "text")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and how like its fingerprint is to the edited text's and to the next document's.

    The edited text has the last floor(n / 2) code points replaced by the first as many (or all) of the next document by
    ascending doc_id; after the last comes the first, and a lone document is its own next. Null text counts as empty.
    Each row gives one row, repeated ids too. Very long texts are read whole; an empty table gives no rows. Other columns play no part.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for b, t, i, x in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")), strict=True):
                rows.append((b, t, i, x or ""))
                held += len(rows[-1][3])
                if held >= 1 << 20 and len(rows) > 1:
                    yield from answer(rows)
                    rows = rows[-1:]
                    held = len(rows[0][3])
        yield from answer(rows)

    def answer(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """For each row of its bucket's own that another of that bucket follows."""
        at = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k + 1][0] == rows[k][0]]
        if not at:
            return
        here, after = [rows[k][3] for k in at], [rows[k + 1][3] for k in at]
        edited = [x[: len(x) - len(x) // 2] + y[: len(x) // 2] for x, y in zip(here, after, strict=True)]
        a, e = (digests(t) for t in (Texts.of(string_array([r[3] for r in rows]), fold=False), Texts.of(string_array(edited), fold=False)))
        prints, edits = sketched(a), sketched(e)
        at = np.array(at)
        (own, of_own), (following, of_following) = ((prints.part(x), Digests(a.take(x)[0], np.concatenate([[0], np.cumsum(a.sizes[x])]))) for x in (at, at + 1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][2] for k in at], pa.int64()),
                pa.array([len(x) for x in here], pa.int64()),
                string_array([hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in edited]),
                string_array(own.text()),
                string_array(edits.text()),
                pa.array(likeness(own, edits, of_own, e), pa.float64()),
                pa.array(likeness(own, following, of_own, of_following), pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return with_next(docs).mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

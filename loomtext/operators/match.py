"""Provenance: which reference keys occur in which texts, and what labels follow."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.batches import carried, column, spans
from loomtext.functions.scan import Keys, Sieve, classes_of, sieve_hashes
from loomtext.sources.readers import numbered_rows
from loomtext.sources.scratch import stored

#: Bytes of keys that are sent to every task as they are; of more keys a Sieve is.
KEY_BYTES = 32 << 20
#: Bits of each of a Sieve's two tables for a key, about, and the logarithm of how many there are at most (32 MB a table).
KEY_BITS, MOST_BITS = 16, 28
#: A key is hot if more than this part of all that was found is it: so there are fewer hot keys than that.
HOT = 1024


def keys_of(df: DataFrame, column: str, least: int, most: int | None = None) -> DataFrame:
    """Distinct keys of fitting length."""
    n = F.length(column)
    return df.select(F.col(column).alias("key")).where(n.between(least, most) if most else n >= least).distinct()


def _few(keys: DataFrame) -> bool:
    """Whether the keys are small enough to be sent to every task."""
    return (keys.agg(F.sum(F.octet_length("key"))).first()[0] or 0) <= KEY_BYTES


def digest(key: Column) -> Column:
    return F.unhex(F.sha2(key.cast("binary"), 256))


def sieve(keys: DataFrame) -> Sieve:
    """Of a table of keys: its tables are filled by tasks and joined by OR; what comes to the driver is bounded by their size."""
    sizes = keys.where("key <> ''").agg(F.collect_set(F.octet_length("key")), F.count("*")).first()  # as many lengths as the longest key is long, at most
    bits = min(MOST_BITS, max(10, math.ceil(math.log2(max(1, sizes[1]) * KEY_BITS))))
    out = Sieve(bits, classes_of(np.array(sizes[0], np.int64)), *(np.zeros(1 << bits >> 6, np.uint64) for _ in range(2)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, h in enumerate(sieve_hashes(batch.column("key"))):
                spots = np.concatenate(Sieve.spots(h, bits))
                word, one = spots >> 6, np.uint64(1) << (spots & 63).astype(np.uint64)
                at, place = np.unique(word, return_inverse=True)
                value = np.zeros(len(at), np.uint64)
                np.bitwise_or.at(value, place, one)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), which, np.int32)), pa.array(at), pa.array(value.view(np.int64))], ["which", "at", "bits"])

    words = keys.select("key").mapInArrow(work, "which int, at long, bits long").groupBy("which", "at").agg(F.bit_or("bits").alias("bits")).toArrow()
    which, at, value = (words.column(c).to_numpy() for c in ("which", "at", "bits"))
    for k, table in enumerate((out.heads, out.whole)):
        table[at[which == k]] = value[which == k].view(np.uint64)
    return out


def _sent(texts: DataFrame, text: str, keep: list[str], keys: list[tuple], work) -> DataFrame:
    """The columns `keep` of texts and a key, for the (rows, numbers of keys) that work() makes of what is found in a batch."""
    shared = texts.sparkSession.sparkContext.broadcast(keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        own = shared.value
        known = Keys([k for k, *_ in own])
        for batch in batches:
            row, key = work(*known.found(batch.column("text")), own)
            if len(row):
                yield batch.take(pa.array(row)), [pa.array([own[k][0] for k in key.tolist()], pa.string())]

    return carried(texts, keep, {"text": F.col(text)}, "key string", scan)


def _passing(texts: DataFrame, text: str, keep: list[str], keys: DataFrame) -> DataFrame:
    """The columns `keep` of texts, `at` and `digest` of every run of bytes that passes the sieve of the keys. Texts are read once."""
    shared = texts.sparkSession.sparkContext.broadcast(sieve(keys))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            row, at, digests = shared.value.found(batch.column("text"))
            if len(row):
                yield batch.take(pa.array(row)), [pa.array(at), pa.array(digests, pa.binary())]

    return carried(texts, keep, {"text": F.col(text)}, "at long, digest binary", scan)


def _named(found: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `found` whose digest is a key's, with the columns of keys. A key that very much of it is would be one task's work; such keys are few, and are broadcast."""
    keys = keys.withColumn("digest", digest(F.col("key")))
    many = stored(found.groupBy("digest").count())
    hot = many.where(F.col("count") * HOT > (many.agg(F.sum("count")).first()[0] or 0)).select("digest")
    often = keys.join(F.broadcast(hot), "digest", "left_semi")
    usual = found.join(F.broadcast(hot), "digest", "left_anti").join(keys, "digest")
    return found.join(F.broadcast(often), "digest").unionByName(usual).drop("digest")


def containment(texts: DataFrame, keys: DataFrame, text_id: str, text: str, *more: str) -> DataFrame:
    """(text_id, more columns, key) for each key (an empty one is never found) that the text contains; exact, each once.

    Texts are read once. Up to KEY_BYTES of keys go to every task, which finds and compares them where it reads a text. Of more keys
    a sieve of bounded size goes there: runs of bytes that pass it are known by their SHA-256, and are joined with the keys'.
    Only what is found is shuffled.
    """
    keep, keys = [text_id, *more], keys.select("key").where("key <> ''").distinct()
    if not _few(keys):
        found = stored(_passing(texts, text, keep, keys).drop("at").distinct())
        return _named(found, keys).select(*map(column, keep), "key")

    def once(row: np.ndarray, _, key: np.ndarray, own: list) -> tuple[np.ndarray, np.ndarray]:
        pair = np.unique(row * len(own) + key)
        return pair // max(1, len(own)), pair % max(1, len(own))

    return _sent(texts, text, keep, [(r["key"],) for r in keys.toLocalIterator()], once).distinct()


def nested_containment(texts: DataFrame, keys: DataFrame, text_id: str, text: str, few: int = 2000) -> DataFrame:
    """The same by comparing each text with each of a small list of keys, which is broadcast; a longer list goes by containment()."""
    if keys.limit(few + 1).count() > few:
        return containment(texts, keys, text_id, text)
    return texts.join(F.broadcast(keys), F.col(text).contains(F.col("key"))).select(text_id, "key").distinct()


def leftmost(row: np.ndarray, at: np.ndarray, rank: np.ndarray, size: np.ndarray, chunk: int) -> np.ndarray:
    """Which occurrences matching from left to right takes, of each row and chunk of ranks: of those that begin at one place the first in rank, then the next that doesn't overlap."""
    order = np.lexsort((rank, at, rank // chunk, row))
    taken, before, end = [], None, 0
    for k, r, c, a, n in zip(order.tolist(), row[order].tolist(), (rank // chunk)[order].tolist(), at[order].tolist(), size[order].tolist(), strict=True):
        if before != (r, c):
            before, end = (r, c), 0
        if a >= end:
            end = a + n
            taken.append(k)
    return np.array(taken, np.int64)


def alternation(texts: DataFrame, keys: DataFrame, text_id: str, text: str, chunk: int = 1000) -> DataFrame:
    """Keys that leftmost, non-overlapping matching finds, longest key first within a chunk of so many keys: a subset of containment(), with a row for every match.

    Keys are numbered by length and text; those of a chunk are matched as one pattern of alternatives would, but from the
    occurrences that a scan of the text gives, so no pattern is built, whatever the number of keys. As containment() does, texts are read once.
    """
    distinct = keys.select("key").where("key <> ''").distinct().withColumn("__n", -F.length("key"))
    ranked = numbered_rows(distinct, ["__n", "key"], "__rank").drop("__n")
    if _few(ranked):

        def taken(row: np.ndarray, at: np.ndarray, key: np.ndarray, own: list) -> tuple[np.ndarray, np.ndarray]:
            rank, size = (np.array([f(x) for x in own], np.int64)[key] for f in (lambda x: x[1], lambda x: len(x[0].encode())))
            first = leftmost(row, at, rank, size, chunk)
            return row[first], key[first]

        return _sent(texts, text, [text_id], [(r["key"], r["__rank"]) for r in ranked.toLocalIterator()], taken)
    rows = texts.select(F.monotonically_increasing_id().alias("__row"), text_id, text)
    found = _named(stored(_passing(rows, text, ["__row", text_id], ranked)), ranked)
    found = found.select("__row", (F.col("__rank") / chunk).cast("long").alias("chunk"), "at", "__rank", F.octet_length("key").cast("long").alias("size"), F.col(text_id).alias("id"), "key")
    found = found.repartition("__row", "chunk").sortWithinPartitions("__row", "chunk", "at", "__rank")

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, end = None, 0
        for own, part in spans(batches, ("__row", "chunk")):
            if own != before:
                before, end = own, 0
            taken = []
            for k, (a, n) in enumerate(zip(part.column("at").to_pylist(), part.column("size").to_pylist(), strict=True)):
                if a >= end:
                    end = a + n
                    taken.append(k)
            yield part.take(pa.array(taken, pa.int64()))

    return found.mapInArrow(in_order, found.schema).select(F.col("id").alias(text_id), "key")


def longest_match(texts: DataFrame, keys: DataFrame, text_id: str, text: str) -> DataFrame:
    """Of each text that contains a key: the best one, by kind (smaller first), then length, then the key. keys: key, kind."""
    found = containment(texts, keys.select("key").distinct(), text_id, text).join(keys.groupBy("key").agg(F.min("kind").alias("kind")), "key")
    return found.groupBy(text_id).agg(F.min(F.struct("kind", (-F.length("key")).alias("n"), "key")).alias("best")).select(text_id, F.col("best.kind").alias("kind"), F.col("best.key").alias("key"))


def majority(matches: DataFrame, key: str, category: str, order: str) -> DataFrame:
    """(key, category) most often seen with a key; of equally frequent ones the one seen first by `order`."""
    per = matches.where(F.col(category).isNotNull()).groupBy(key, category).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return per.groupBy(key).agg(F.max_by(category, F.struct("n", (-F.col("first")).alias("f"), category)).alias(category))


def coalesced_lookup(df: DataFrame, lookup: DataFrame, columns: list[str], value: str, out: str) -> DataFrame:
    """`out`: the value of the first of these key columns that the lookup (key, value; one row per key) has."""
    names = []
    for k, c in enumerate(columns):
        side = lookup.select(F.col("key").alias(f"__k{k}"), F.col(value).alias(f"__v{k}"))
        df = df.join(side, F.col(c) == F.col(f"__k{k}"), "left").drop(f"__k{k}")
        names.append(f"__v{k}")
    return df.withColumn(out, F.coalesce(*names)).drop(*names)


def propagate(df: DataFrame, norm: str, columns: list[str], order: str) -> DataFrame:
    """Fills nulls in these columns from the first row (by `order`) of equal `norm` whose first column is known, each column by itself. Blank texts share labels too.

    Texts are known by their SHA-256, so none is shuffled as a key. The first labels are aggregated by it and joined back, so that a
    very frequent text is one row of the lookup.
    """
    df = df.withColumn("__key", F.sha2(F.col(norm).cast("binary"), 256))
    known = df.where(F.col(columns[0]).isNotNull() & F.col(norm).isNotNull())
    firsts = known.groupBy("__key").agg(*(F.min_by(c, order).alias(f"__{c}") for c in columns))
    return df.join(firsts, "__key", "left").withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop("__key", *(f"__{c}" for c in columns))


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key by this order; equally ordered rows go by their other columns. Aggregated, not sorted, so a very frequent key is reduced before the shuffle; keys are known by a SHA-256."""
    texts = [F.coalesce(F.sha2(F.col(k).cast("string").cast("binary"), 256), F.lit("-")).alias(f"__{k}") for k in keys]
    ranked = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), *(F.col(c) for c in df.columns if c not in keys), *(F.col(k) for k in keys))
    first = df.select(*texts, ranked.alias("__row")).groupBy(*(f"__{k}" for k in keys)).agg(F.min("__row").alias("__row"))
    return first.select(*(F.col(f"__row.{c}").alias(c) for c in df.columns))

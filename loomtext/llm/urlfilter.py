"""URL rules by a cascade of Bloom filters: exact membership over the corpus's own keys, without joins.

A rule is a host and the beginning of a path; its key is both in one string. Every url yields the keys of all rules that
could fit it: its host and each parent domain, each with the beginnings of its path that are as long as a rule's. These
keys, over the whole corpus, are the key universe. Level 0 of a cascade encodes the listed keys; level 1 the keys of the
universe that level 0 takes for listed though they aren't; level 2 the listed keys that level 1 takes for those; and so on
until a level errs on none. Walking down the levels then answers exactly for any key of the universe. Level 0 has as many
bits for each listed key as leave about as many errors as there are listed keys, so all levels together grow with the list
and the logarithm of the universe. Two cascades are kept: of all rules, and of the rules that block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import cut, stored

#: Share of wrong answers of the levels after the first, and bytes that a level may take, as it is broadcast
#: (some 8 million rules; a longer list is split).
ERRORS, MOST_BYTES = 1 / 64, 64 << 20
#: Bytes of a level that a key of the list takes at most, whatever the universe.
KEY_BYTES = 8
U = np.uint64


@dataclass
class Bloom:
    seed: int
    hashes: int
    words: np.ndarray

    @classmethod
    def empty(cls, n: int, errors: float, seed: int) -> Bloom:
        """For n keys, of others `errors` (a share) are taken for one of them."""
        hashes = max(1, math.ceil(-math.log2(errors)))
        size = max(16, math.ceil(n * hashes / math.log(2) / 64))  # few bits would often meet by chance
        if 8 * size > MOST_BYTES:
            raise ValueError(f"a level of {n} keys takes {8 * size} bytes; split the list by a hash of its keys")
        return cls(seed, hashes, np.zeros(size, U))

    def positions(self, keys: np.ndarray) -> np.ndarray:
        """One row for each hash function, by double hashing of 64-bit key hashes."""
        x = keys.view(U) ^ U((self.seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
        x ^= x >> U(27)
        y = (x * U(0x81DADEF4BC2DD44D)) | U(1)
        return np.stack([(x + y * U(k)) % U(64 * len(self.words)) for k in range(self.hashes)])

    def add(self, keys: np.ndarray) -> None:
        at = self.positions(keys).ravel()
        np.bitwise_or.at(self.words, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self.positions(keys)
        return ((self.words[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1)).all(axis=0)


@dataclass
class Cascade:
    levels: list[Bloom] = field(default_factory=list)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key is listed. A key goes down as long as levels have it; the parity of the first that hasn't tells."""
        out = np.zeros(len(keys), bool)
        left = np.arange(len(keys))
        for depth, level in enumerate(self.levels):
            hit = level.has(keys[left])
            out[left[~hit]] = depth % 2 == 1
            left = left[hit]
        out[left] = len(self.levels) % 2 == 1
        return out


def filled(keys: DataFrame, n: int, errors: float, seed: int) -> Bloom:
    """A level with the n keys (column k, 64-bit hashes): tasks fill their own bits, which are joined by OR."""
    shape = Bloom.empty(n, errors, seed)
    size, hashes = len(shape.words), shape.hashes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Bloom(seed, hashes, np.zeros(size, U))
        for batch in batches:
            part.add(batch.column("k").to_numpy(zero_copy_only=False))
        at = np.flatnonzero(part.words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(part.words[at].view(np.int64))], ["at", "bits"])

    rows = keys.mapInArrow(work, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most MOST_BYTES / 8 rows
    shape.words[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(U)
    return shape


def tested(keys: DataFrame, level: Bloom) -> DataFrame:
    """The rows whose key k the level takes for its own."""
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = shared.value.has(batch.column("k").to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(hit))

    return keys.mapInArrow(work, keys.schema)


def cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade that tells the listed keys from all others of the universe. Both have `k`, 64-bit hashes, and `rule`, what was hashed; listed ones are distinct, those of the universe may repeat.

    The universe is read twice and never shuffled: its size is estimated, and of its keys only those that level 0 takes for
    listed go on, about twice as many as are listed. Where one of them has the hash of a listed key but isn't it, Collision is raised.
    """
    out = Cascade()
    r = listed.count()
    if not r:
        return out
    s = universe.agg(F.approx_count_distinct("k")).first()[0]
    out.levels.append(filled(listed.select("k"), r, min(0.5, r / max(s, 1)), 0))
    taken = cut(tested(universe.select("k", "rule"), out.levels[0]).distinct())
    ours = listed.select("k", F.col("rule").alias("own"))
    if not taken.join(ours, "k").where("rule <> own").isEmpty():
        raise Collision
    yes, no = cut(taken.join(ours, "k", "left_anti").select("k")), listed.select("k")
    for seed in range(1, 64):
        n = yes.count()
        if not n:
            return out
        out.levels.append(filled(yes, n, ERRORS, seed))
        yes, no = cut(tested(no, out.levels[-1])), yes
    raise ValueError("the cascade doesn't end")


class Collision(Exception):
    """Two keys have one hash."""


def host_of(url) -> F.Column:
    """After the first :// up to /, ?, # or the end, A-Z as a-z; empty without it."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url) -> F.Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels_of(host: str) -> int:
    return host.count(".") + 1


def candidates(labels: Sequence[int], lengths: Sequence[int]) -> F.Column:
    """Keys host + path that rules with hosts of so many labels and paths of these lengths could have, longest first (of equal ones the longer host). Only as many suffixes of the host are made as there are numbers of labels, however long it is."""
    labels, lengths = list(labels) or [1], list(lengths) or [0]
    hosts = F.array(*(F.when((F.length("host") - F.length(F.replace("host", F.lit("."))) + 1) >= n, F.substring_index("host", ".", -n)) for n in sorted(set(labels))))
    hosts = F.filter(hosts, lambda h: h.isNotNull())
    paths = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(set(lengths), reverse=True))), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct((-F.length(h) - F.length(p)).alias("n"), (-F.length(h)).alias("h"), F.concat(h, p).alias("rule")))))
    return F.when(F.col("host") != "", F.transform(F.array_sort(keys), lambda k: k["rule"])).otherwise(F.array().cast("array<string>"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, otherwise: str = "allow") -> DataFrame:
    """Per row: page_id, host, path, rule (`host` + `path` of the rule that decides, else null), verdict.

    Rules are (verdict, host, path), a list or a table of these columns; hosts and paths are compared as they stand. A rule fits
    its host and all subdomains, if the url's path begins with its path; of those that fit, the longest decides, and of equally long
    ones that of the longer host. A url that no rule fits, or null, or without ://, isn't in any list: it gets `otherwise`. Rows may
    repeat and page_id may be null; columns of pages other than page_id and url play no part, whatever their names. An empty table gives no rows.
    A very long url costs time in proportion to its length. Rules with one key must have one verdict. A list whose levels
    would be larger than MOST_BYTES is split by a hash of its keys, and the pages pass one part of it after another.
    """
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        named = rules.select("verdict", "host", F.col("path").alias("p"))
        shape = named.agg(F.collect_set(F.length("host") - F.length(F.replace("host", F.lit("."))) + 1), F.collect_set(F.length("p"))).first()  # as many numbers as the longest rule is long, at most
        labels, lengths = shape[0], shape[1]
        named = named.select("verdict", F.concat("host", "p").alias("rule"))
    else:
        named = spark.createDataFrame([(v, h + p) for v, h, p in rules], "verdict string, rule string")
        labels, lengths = [labels_of(h) for _, h, _ in rules], [len(p) for _, _, p in rules]
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = rows.withColumn("keys", candidates(labels, lengths))
    for salt in range(8):
        key = lambda rule: F.xxhash64(rule, F.lit(salt))  # noqa: B023, E731
        listed = cut(named.withColumn("k", key(F.col("rule"))).distinct())
        parts = max(1, math.ceil(listed.count() * KEY_BYTES / MOST_BYTES))
        universe = keyed.select(F.explode("keys").alias("rule")).select(key(F.col("rule")).alias("k"), "rule")
        found = keyed.select(*keyed.columns, F.transform("keys", key).alias("hashes"), F.lit(-1).alias("at"), F.lit(False).alias("blocks"))
        try:
            for part in range(parts):
                mine = listed.where(part_of(F.col("k"), parts) == part)
                every = cascade(mine.select("k", "rule").distinct(), universe.where(part_of(F.col("k"), parts) == part))
                blocking = cascade(mine.where("verdict = 'block'").select("k", "rule").distinct(), mine.select("k", "rule"))
                found = passed(found, every, blocking, parts, part)
                if parts > 1:
                    found = stored(found)
            break
        except Collision:  # by chance once in some billions of rules and keys: hash again
            continue
    rule = F.when(F.col("at") >= 0, F.get("keys", F.col("at")))
    return found.select("page_id", "host", "path", rule.alias("rule"), F.when(F.col("at") < 0, F.lit(otherwise)).when(F.col("blocks"), "block").otherwise("allow").alias("verdict"))


def part_of(k: F.Column, parts: int) -> F.Column:
    return F.pmod(F.shiftright(k, 7), F.lit(parts))


def passed(rows: DataFrame, every: Cascade, blocking: Cascade, parts: int, part: int) -> DataFrame:
    """The rows (keys, longest first, and their hashes) with `at`, the first key that this part of the list has if that comes before the one found so far, and whether it blocks."""
    shared = rows.sparkSession.sparkContext.broadcast((every, blocking))
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, blocking = shared.value
        for batch in batches:
            lists = batch.column("hashes")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            k = lists.flatten().to_numpy(zero_copy_only=False)
            begins = np.cumsum(sizes) - sizes
            own = np.flatnonzero((k >> 7) % parts == part)
            member = own[every.has(k[own])]
            owner = np.repeat(np.arange(len(sizes)), sizes)[member]
            has, first = np.unique(owner, return_index=True)
            at, blocks = batch.column("at").to_numpy().copy(), batch.column("blocks").to_numpy(zero_copy_only=False).copy()
            place = member[first] - begins[has]
            better = (at[has] < 0) | (place < at[has])
            has, first = has[better], first[better]
            at[has] = place[better]
            blocks[has] = blocking.has(k[member[first]])
            columns = [*(batch.column(c) for c in names[:-2]), pa.array(at.astype(np.int32)), pa.array(blocks)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(work, rows.schema)

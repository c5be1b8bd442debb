"""Near-duplicates by an inverted join on MinHash coordinates.

Every text has a signature of K minima, and each (coordinate, value) is a posting. A pair of Jaccard likeness 0.85 agrees
on 27 of 32 coordinates on average; one that agrees on fewer than T is left, where T follows from the likeness asked for such
that a pair of just that likeness is left once in a million. With postings in one global order, rarest first, two texts that
share T of K postings share one of the first K - T + 1 of each (the prefix), and a text with fewer than T postings that any other text has is skipped altogether. So
only prefixes make lists, frequent postings are hardly ever in one, and most texts drop out.

What is asked for are connected groups, so no list is expanded into all of its pairs:
  1. texts with equal sets of shingles are one node;
  2. each list links its members to its smallest one (as many pairs as postings);
  3. lists whose members are now in several groups compare members of different groups only, in tiles of bounded size.
     Wide signatures of the texts in question, of one byte a coordinate, spare the sets of pairs that aren't alike
     enough. The others are confirmed tile by tile, likeliest first, and pairs that are joined by then are skipped.
Every pair that is kept agreed on T coordinates and was confirmed on the full sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import components, stored
from loomtext.llm.textbatch import Texts, mix, segments, slices, string_array

#: Coordinates of a signature, and how rarely a pair that is just alike enough may fall short on a signature.
K, MISS = 32, 1e-6
#: Members of a tile's side, about; members of a block that a leader's set is sent to; shingles that count as one member more, so
#: that the sets of a tile's texts fit into a task (two sides of some 4 million shingles of 8 bytes).
TILE, BLOCK, HEAVY = 512, 512, 8192
#: Coordinates of the wide signature, of a byte each, that a pair is held against before its sets are compared, and how many
#: of them come first.
WIDE, NARROW = 512, 64
NO_TOKEN = np.iinfo(np.int64).max
U = np.uint64
_rng = np.random.default_rng(20240101)
XORS = _rng.integers(0, 2**64, WIDE + K, dtype=U)
TIMES = _rng.integers(0, 2**64, WIDE + K, dtype=U) | U(1)
#: What a word's hash is multiplied by at each place of a shingle, so that the order of words counts.
PLACES = _rng.integers(0, 2**64, 64, dtype=U) | U(1)


def must_agree(n: int, percent: int) -> int:
    """On how many of n coordinates a pair of this likeness agrees, but for odds of MISS."""
    p, below, t = percent / 100, 0.0, 0
    while t < n and (below := below + comb(n, t) * p**t * (1 - p) ** (n - t)) <= MISS:
        t += 1
    return max(t, 1)


def shingles(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `words` words of each text (of all its words, where it has fewer), and the bounds of each text's."""
    h, counts = texts.word_hashes, np.diff(texts.words[2])
    out = np.zeros(len(h), U)
    for k in range(words):
        out[: len(h) - k] += h[k:] * PLACES[k]
    last = texts.words[2][1:]
    keep = np.arange(len(h)) + words <= np.repeat(last, counts)
    for i in np.flatnonzero((counts > 0) & (counts < words)).tolist():
        a, b = texts.words[2][i], texts.words[2][i + 1]
        out[a] = (h[a:b] * PLACES[: b - a]).sum() ^ U(b - a)
        keep[a] = True
    return mix(out[keep]), np.concatenate([[0], np.cumsum(keep)])[texts.words[2]]


def sets(texts: Texts, words: int) -> list[np.ndarray]:
    """Of each text, its distinct shingles in order."""
    h, bounds = shingles(texts, words)
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        x = np.sort(h[a:b])
        out.append(x[np.append(True, x[1:] != x[:-1])] if b > a else x)
    return out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Per row: doc_id, hash (both as they come), n_shingles, digest of the set (null if empty), signature (array<long>), row (as it comes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found = sets(texts, words)
            n = np.array([len(x) for x in found], np.int64)
            signs = np.zeros((len(found), K), U)
            if n.sum():
                flat, has = np.concatenate(found), n > 0
                begins = (np.cumsum(n) - n)[has]
                for k in range(K):
                    signs[has, k] = np.minimum.reduceat((flat ^ XORS[k]) * TIMES[k], begins)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("hash"),
                    pa.array(n),
                    string_array([xxhash.xxh3_128_hexdigest(x.tobytes()) if len(x) else None for x in found]),
                    pa.FixedSizeListArray.from_arrays(pa.array(signs.ravel().view(np.int64)), K).cast(pa.list_(pa.int64())),
                    part.column("row"),
                ],
                ["doc_id", "hash", "n_shingles", "digest", "signature", "row"],
            )

    return docs.select("doc_id", "text", "hash", "row").mapInArrow(work, "doc_id long, hash string, n_shingles long, digest string, signature array<long>, row string")


def wide(texts: DataFrame, words: int) -> DataFrame:
    """node, wide: of WIDE further coordinates of each text's set, eight bits of their minima."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches):
            h, bounds = shingles(t, words)
            out = np.zeros((len(t), WIDE), np.uint8)
            has = np.flatnonzero(np.diff(bounds))
            for k in range(WIDE if len(has) else 0):
                out[has, k] = (np.minimum.reduceat((h ^ XORS[K + k]) * TIMES[K + k], bounds[has]) >> U(20)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([x.tobytes() for x in out], pa.binary())], ["node", "wide"])

    return texts.select("node", "text").mapInArrow(work, "node long, wide binary")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets of shingles are as alike as asked for.

    The rows of a leader `a` are split into blocks of about BLOCK; its text goes to each block once, and the text of
    every `b` to the one block that it is in.
    """
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    leaders = dealt.select("a", "block").distinct().select("a", "block", F.col("a").alias("b"))
    rows = leaders.withColumn("lead", F.lit(0)).unionByName(dealt.withColumn("lead", F.lit(1)))
    rows = rows.join(texts.select(F.col("node").alias("b"), "text"), "b").repartition("a", "block").sortWithinPartitions("a", "block", "lead")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, np.zeros(0, U)
        for part, t in slices(batches):
            out: tuple[list, list] = ([], [])
            for a, block, b, is_member, x in zip(*(part.column(c).to_pylist() for c in ("a", "block", "b", "lead")), sets(t, words), strict=True):
                if not is_member:
                    lead, own = (a, block), x
                elif lead == (a, block):
                    both = len(np.intersect1d(own, x, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(x) - both):
                        out[0].append(a)
                        out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    return rows.select("a", "block", "b", "lead", "text").mapInArrow(work, "a long, b long")


def across(lists: DataFrame, groups: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Per tile (token, i, j): pairs of its list that are in different groups and agree on enough coordinates, as arrays a and b, likeliest first.

    A list in one group only needs nothing. In others, members of the largest group meet members of other groups, and
    these meet each other, never members of one group. A tile has TILE members (a long text counts as several) of each of two blocks of its
    list. A pair that is in several lists is reported by the one of the smallest token only. groups: node, weight, component; signs: node, tokens, wide.
    """
    narrow, all_wide = must_agree(NARROW, percent), must_agree(WIDE, percent)
    rows = lists.join(groups.withColumnRenamed("component", "grp"), "node")
    per = rows.groupBy("token", "grp").agg(F.sum("weight").alias("n"))
    per = per.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.max(F.struct("n", "grp")).alias("top")).where("groups > 1")
    rows = rows.join(per.select("token", "n", F.col("top.grp").alias("main"), F.col("top.n").alias("n_main")), "token")
    big, salt = F.col("n") > TILE, F.xxhash64("node", "token")
    mains, others = F.ceil(F.col("n_main") / TILE).cast("int"), F.ceil((F.col("n") - F.col("n_main")) / TILE).cast("int")
    rows = rows.withColumn("mains", F.when(big, mains).otherwise(0)).withColumn("others", F.when(big, others).otherwise(1))
    own = F.when(~big, 0).when(F.col("grp") == F.col("main"), F.pmod(salt, F.col("mains"))).otherwise(F.col("mains") + F.pmod(salt, F.col("others"))).cast("int")
    rows = rows.withColumn("own", own)
    partners = F.when(F.col("own") < F.col("mains"), F.sequence(F.col("mains"), F.col("mains") + F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("mains") + F.col("others") - 1))
    rows = rows.select("token", "node", "grp", "own", F.explode(partners).alias("other")).select("token", "node", "grp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = rows.join(signs, "node").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "own")
    longest = K + 1

    def alike_pairs(col: dict[str, np.ndarray], sign: np.ndarray, tokens: np.ndarray, token: int, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        own, grp = col["own"], col["grp"]
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        agree = np.zeros((len(left), len(right)), np.uint8)
        for k in range(NARROW):
            agree += sign[left, k][:, None] == sign[right, k][None, :]
        a, b = np.nonzero((agree >= narrow) & (grp[left][:, None] != grp[right][None, :]))
        if i == j:
            a, b = a[a < b], b[a < b]
        a, b = left[a], right[b]
        alike = np.zeros(len(a), np.int64)
        for k in range(0, len(a), 4096):
            part = slice(k, k + 4096)
            alike[part] = (sign[a[part]] == sign[b[part]]).sum(1)
        a, b, alike = a[alike >= all_wide], b[alike >= all_wide], alike[alike >= all_wide]
        here = np.zeros(len(a), bool)
        for k in range(0, len(a), 4096):
            x, y = tokens[a[k : k + 4096]], tokens[b[k : k + 4096]]
            common = (x[:, :, None] == y[:, None, :]).any(2) & (x != NO_TOKEN)
            here[k : k + 4096] = np.where(common, x, NO_TOKEN).min(1) == token
        order = np.argsort(-alike[here], kind="stable")
        return col["node"][a[here][order]], col["node"][b[here][order]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in segments(batches, ("token", "i", "j")):
            sign = np.frombuffer(b"".join(rows.column("wide").to_pylist()), np.uint8).reshape(-1, WIDE)
            lists = rows.column("tokens").combine_chunks()
            tokens, size = np.full((rows.num_rows, longest), NO_TOKEN), lists.value_lengths().to_numpy()
            tokens[np.arange(longest)[None, :] < size[:, None]] = lists.flatten().to_numpy()
            col = {c: rows.column(c).to_numpy() for c in ("node", "grp", "own")}
            key = [rows.column(c)[0].as_py() for c in ("token", "i", "j")]
            a, b = alike_pairs(col, sign, tokens, *key)
            if len(a):
                yield pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=True)), pa.array([a.tolist()], pa.list_(pa.int64())), pa.array([b.tolist()], pa.list_(pa.int64()))], ["token", "i", "j", "a", "b"])

    return rows.select("token", "i", "j", "node", "grp", "own", "tokens", "wide").mapInArrow(work, "token long, i int, j int, a array<long>, b array<long>")


def confirmed_tiles(found: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) among the pairs of each tile, as many as join what they join: a text goes to a tile once, however many pairs it is in."""
    members = found.select("token", "i", "j", F.explode(F.array_distinct(F.concat("a", "b"))).alias("node")).join(texts, "node")
    rows = found.withColumn("node", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string"))
    none = F.lit(None).cast("array<long>")
    rows = rows.unionByName(members.withColumn("a", none).withColumn("b", none)).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", F.asc_nulls_first("node"))

    def joined(a: list, b: list, own: dict[int, np.ndarray]) -> Iterator[tuple[int, int]]:
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for x, y in zip(a, b, strict=True):
            if top(x) != top(y):
                s, t = own[x], own[y]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    root[top(x)] = top(y)
                    yield x, y

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, a, b = None, [], []
        own: dict[int, np.ndarray] = {}

        def answer() -> pa.RecordBatch:
            links = list(joined(a, b, own))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for part, t in slices(batches):
            columns = (part.column(c).to_pylist() for c in ("token", "i", "j", "node", "a", "b"))
            for token, i, j, node, x, y, shingled in zip(*columns, sets(t, words), strict=True):
                if node is None:
                    if key is not None:
                        yield answer()
                    key, a, b = (token, i, j), x, y
                    own.clear()
                elif key == (token, i, j):
                    own[node] = shingled
        if key is not None:
            yield answer()

    return rows.select("token", "i", "j", "node", "a", "b", "text").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, row: str | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (it is that one).

    The node of the links is the set, not the id, so texts that share an id are told apart. Given a column `row` of strings
    that differ from row to row, it is returned too, and one row of a group is kept even where several have its smallest doc_id.

    Words are runs of other than ASCII white space, A-Z as a-z; a text's set is its distinct runs of `words` words, the
    whole text as one where it has fewer. Links: 100 * intersection >= percent * union. A text without words, or null,
    has an empty set and no links. Rows of one doc_id count as copies of one document if their texts are equal; where they
    differ, each row has its own set, and of sets that are linked the one of the smallest digest is kept. Null ids are left out of all groups (component null).
    Very long texts are compared whole; an empty table gives no rows. Other columns play no part, whatever their names.
    """
    t = must_agree(K, percent)
    docs = docs.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("hash"), (F.col(row) if row else F.lit(None)).cast("string").alias("row"))
    found = stored(signatures(docs, words))
    classes = found.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "hash", "row")).alias("first"))
    classes = stored(classes.select("digest", "first.*", F.monotonically_increasing_id().alias("node")))  # numbered once, as they are stored
    weight = (1 + F.floor(F.col("n_shingles") / HEAVY)).cast("long").alias("weight")
    signs = found.select("digest", "doc_id", "hash", "signature", weight).join(classes.drop("row"), ["digest", "doc_id", "hash"]).select("node", "weight", "signature").dropDuplicates(["node"])
    tokens = signs.select("node", "weight", F.posexplode("signature").alias("at", "value")).select("node", "weight", F.xxhash64("at", "value").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    ranked = tokens.join(often, "token").groupBy("node", "weight").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("shared")).where(F.size("shared") >= t)
    prefixes = stored(ranked.select("node", "weight", F.slice("shared", F.lit(1), F.size("shared") - (t - 1))["token"].alias("tokens")))
    lists = prefixes.select("node", F.explode("tokens").alias("token"))
    wanted = classes.join(prefixes, "node", "left_semi").select("doc_id", "hash", "node")
    texts = stored(docs.select("doc_id", "hash", "text").join(wanted, ["doc_id", "hash"]).select("node", "text").dropDuplicates(["node"]))
    least = lists.groupBy("token").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = lists.join(least, "token").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    signs = stored(signs.drop("weight").join(prefixes.select("node"), "node"))
    sides = pairs.join(signs.select(F.col("node").alias("a"), F.col("signature").alias("x")), "a").join(signs.select(F.col("node").alias("b"), F.col("signature").alias("y")), "b")
    agree = F.expr("size(filter(zip_with(x, y, (p, q) -> p = q), e -> e))")
    links = stored(confirmed(sides.where(agree >= t).select("a", "b"), texts, words, percent))
    groups = prefixes.select("node", "weight").join(components(links), "node", "left").select("node", "weight", F.coalesce("component", "node").alias("component"))
    tiles = stored(across(lists, groups, stored(wide(texts, words).join(prefixes.drop("weight"), "node")), percent))
    links = links.unionByName(stored(confirmed_tiles(tiles, texts, words, percent)))
    groups = classes.join(components(links), "node").select("node", "component", F.struct("doc_id", "digest").alias("own"))
    heads = groups.groupBy("component").agg(F.min("own").alias("head"))
    groups = groups.join(heads, "component").select("node", "head")
    reps = classes.join(groups, "node", "left").select("digest", F.coalesce("head.doc_id", "doc_id").alias("component_id"), F.coalesce(F.col("head.digest") == F.col("digest"), F.lit(True)).alias("leads"), F.col("row").alias("lead"))
    out = found.select("doc_id", "n_shingles", "digest", "row").join(reps, "digest", "left")
    first = (F.col("component_id") == F.col("doc_id")) & F.col("leads") & F.coalesce(F.col("row") == F.col("lead"), F.lit(True))
    kept = F.coalesce(F.col("doc_id").isNull() | first, F.lit(True)).alias("kept")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), kept, *([F.col("row").alias(row)] if row else []))

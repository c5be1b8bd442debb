"""Hard negatives of anchors by product quantisation with stored residual norms.

Vectors are integers. Each is cut into parts of WIDTH components, and a part is described by the nearest of WORDS codewords
(integers too, fitted on a bounded sample) and by the norm of what is left over. For an anchor a table holds the inner product
of each of its parts with each codeword; the entries that a row's codes name add up to its looked-up score, and the true score
differs from that by the sum of (norm of the anchor's part) * (norm of the row's residual part) at most. What can't be among
the k best of a window by these bounds is left out; the integer inner products of the others decide. So codewords only decide
how much is computed again, never what is found.

Rows are dealt to blocks, and every anchor goes to every block: anchors are a stated part of the rows, and much smaller. A
block returns the k best of each anchor's window, and these are merged. Two rounds are needed: the positives of an anchor give
the windows of its negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions.batches import spans
from loomtext.llm.shared import stored

#: Components of a part, codewords of a part (a code is a byte), rows that codewords are fitted on (those with the smallest hashes), and rounds of fitting.
WIDTH, WORDS, SAMPLE, ROUNDS = 2, 256, 4096, 6
#: Dimensions, most frequent first, that have codewords of their own. Others have the origin as the only one, so that bounds are norms.
DIMENSIONS = 4
#: Rows of a block at most, and at least where there are fewer blocks than cores.
BLOCK, SMALL = 65_536, 4096
#: A component x becomes floor(SCALE * x). Up to the norm EXACT doubles hold every inner product exactly, beyond it 64-bit integers do, up to LIMIT.
SCALE, EXACT, LIMIT = 256, 1 << 26, 1 << 30
#: What rounding may move a bound by, as a part of the product of norms.
SLACK = 1e-9


def taking_part(embedding: Column) -> Column:
    """Whether a vector is there, without null or non-finite components and below LIMIT."""
    x = F.transform(embedding, lambda v: v.cast("double") * SCALE)
    inside = F.forall(x, lambda v: F.coalesce(F.abs(v) < LIMIT, F.lit(False)))
    norm = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) < (LIMIT - 1.0 * (1 << 20)) ** 2
    return F.coalesce(inside & norm, F.lit(False))


def cuts(dim: int) -> list[slice]:
    return [slice(k, min(k + WIDTH, dim)) for k in range(0, dim, WIDTH)]


def codewords(sample: np.ndarray) -> list[np.ndarray]:
    """Of each part, at most WORDS integer codewords: k-means from spread-out rows of the sample."""
    out = []
    for cut in cuts(sample.shape[1]):
        x = sample[:, cut]
        words = np.unique(x, axis=0)
        if len(words) > WORDS:
            words = words[np.linspace(0, len(words) - 1, WORDS).astype(int)].astype(float)
            for _ in range(ROUNDS):
                near = nearest(x, words)
                n = np.bincount(near, minlength=len(words))
                sums = np.stack([np.bincount(near, x[:, j], len(words)) for j in range(x.shape[1])], 1)
                words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
        out.append(np.rint(words))
    return out


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = ((words * words).sum(1) - 2 * (x[k : k + 4096] @ words.T)).argmin(1)
    return out


def packed(x: np.ndarray, of: str) -> pa.Array:
    """Rows as binary."""
    x = np.ascontiguousarray(x, of)
    size = x.shape[1] * x.itemsize
    return pa.array([x[k].tobytes() for k in range(len(x))], pa.binary()) if not size else pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * size).astype(np.int32)), pa.py_buffer(x.tobytes())])


def unpacked(column: pa.ChunkedArray | pa.Array, of: str, n: int) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), of)
    return data.reshape(n, -1) if len(data) else np.zeros((n, 0), of)


def coded(rows: DataFrame, words: dict[int, list[np.ndarray]]) -> DataFrame:
    """node, vec_id, label, dim, x (integers), code (a byte a part), left (norm of each part's residual, rounded up), same (hash of label and vector)."""
    shared = rows.sparkSession.sparkContext.broadcast(words)
    names = ["node", "vec_id", "label", "dim", "x", "code", "left"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False).astype(int)
            for dim in np.unique(size).tolist():
                own = np.flatnonzero(size == dim)
                for at in range(0, len(own), 4096):
                    part = batch.take(pa.array(own[at : at + 4096]))
                    n = part.num_rows
                    x = np.floor(SCALE * part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(n, dim)
                    code, left = np.zeros((n, len(cuts(dim))), np.uint8), np.zeros((n, len(cuts(dim))))
                    for m, cut in enumerate(cuts(dim)):
                        w = shared.value[dim][m] if dim in shared.value else np.zeros((1, cut.stop - cut.start))
                        code[:, m] = nearest(x[:, cut], w)
                        left[:, m] = np.sqrt(((x[:, cut] - w[code[:, m]]) ** 2).sum(1))
                    left = np.nextafter(left.astype(np.float32), np.float32(np.inf))
                    columns = [*(part.column(c) for c in names[:3]), pa.array(np.full(n, dim, np.int32)), packed(x, "<i4"), packed(code, "u1"), packed(left, "<f4")]
                    yield pa.RecordBatch.from_arrays(columns, names)

    plain = rows.select(F.monotonically_increasing_id().alias("node"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return plain.mapInArrow(work, "node long, vec_id long, label long, dim int, x binary, code binary, left binary").withColumn("same", F.xxhash64("label", "x"))


class Block:
    """Rows of one dimension, ordered by label; a row that repeats another in all counts once."""

    def __init__(self, s: pa.Table, dim: int):
        n, self.dim = s.num_rows, dim
        ids, same, label = (s.column(c).to_numpy() for c in ("vec_id", "same", "label"))
        order = np.lexsort((same, ids, label))
        again = np.append(False, (ids[order][1:] == ids[order][:-1]) & (same[order][1:] == same[order][:-1])) if n else np.zeros(0, bool)
        order = order[~again]
        self.ids, self.same, self.label = ids[order], same[order], label[order]
        x = unpacked(s.column("x"), "<i4", n)[order].astype(float)
        self.norms = np.sqrt((x * x).sum(1))
        self.most = self.norms.max(initial=0)
        self.x = x if self.most <= EXACT else x.astype(np.int64)
        code = unpacked(s.column("code"), "u1", n)[order]
        self.code = [np.ascontiguousarray(code[:, m], np.intp) for m in range(code.shape[1])]
        self.left = np.ascontiguousarray(unpacked(s.column("left"), "<f4", n)[order].T.astype(float))

    def own(self, label: int) -> slice:
        return slice(*np.searchsorted(self.label, [label, label + 1]))

    def bounds(self, a: np.ndarray, tables: list[np.ndarray], at: slice) -> tuple[np.ndarray, np.ndarray]:
        """What the scores of these rows can be at least and at most."""
        score = np.zeros(len(self.ids[at]))
        for table, code in zip(tables, self.code, strict=True):
            score += np.take(table, code[at])
        parts = np.sqrt(np.array([(a[cut] ** 2).sum() for cut in cuts(self.dim)]))
        wide = parts @ self.left[:, at] + (1 + SLACK * np.sqrt((a * a).sum()) * (self.most + 1)) if len(parts) else np.zeros(len(score))
        return score - wide, score + wide

    def exact(self, a: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.x.dtype == np.int64 or (a * a).sum() > EXACT * EXACT:
            return self.x[at].astype(np.int64) @ a.astype(np.int64)
        return np.rint(self.x[at] @ a).astype(np.int64)

    def first(self, score: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of these rows: highest score, then smaller vec_id."""
        order = np.lexsort((self.same[at], self.ids[at], -score))[:k]
        return score[order], at[order]


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest; -inf where there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def positives_in(block: Block, a: np.ndarray, tables: list[np.ndarray], anchor: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    own = block.own(label)
    low, high = block.bounds(a, tables, own)
    other = block.ids[own] != anchor
    at = np.flatnonzero(other & (high >= kth(low[other], k))) + own.start
    return block.first(block.exact(a, at), at, k)


def negatives_in(block: Block, a: np.ndarray, tables: list[np.ndarray], label: int, tops: list[int], k: int, share: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each window (its upper end, scores, rows): the k best rows of another label with share[0] * top <= share[1] * score <= share[1] * top."""
    low, high = block.bounds(a, tables, slice(None))
    own = block.own(label)
    high[own] = -np.inf
    floors = [-(-share[0] * top // share[1]) for top in tops]
    some = np.flatnonzero(high >= min(floors))
    low, high = low[some], high[some]
    chosen = np.zeros(len(some), bool)
    for top, floor in zip(tops, floors, strict=True):
        within = (high >= floor) & (low <= top)
        surely = within & (high <= top) & (low >= floor)
        chosen |= within & (high >= kth(low[surely], k))
    at = some[chosen]
    score = block.exact(a, at)
    for top, floor in zip(tops, floors, strict=True):
        inside = (score >= floor) & (score <= top)
        yield top, *block.first(score[inside], at[inside], k)


def tiled(rows: DataFrame, anchors: DataFrame, blocks: int, words: dict[int, list[np.ndarray]], found) -> DataFrame:
    """Every anchor against every block of rows: (anchor, top, score, vec_id, same) for what found(block, anchor's vector, tables, its row) yields."""
    shared = rows.sparkSession.sparkContext.broadcast(words)
    common = ["dim", "block", "side", "node", "vec_id", "label", "same", "x"]
    dealt = rows.withColumns({"block": F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"), "side": F.lit(0), "tops": F.lit(None).cast("array<long>")})
    asking = anchors.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "side": F.lit(1), "code": F.lit(None).cast("binary"), "left": F.lit(None).cast("binary")})
    if "tops" not in anchors.columns:
        asking = asking.withColumn("tops", F.lit(None).cast("array<long>"))
    columns = [*common, "code", "left", "tops"]
    both = dealt.select(columns).unionByName(asking.select(columns)).repartition("dim", "block").sortWithinPartitions("dim", "block", "side")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "top", "score", "vec_id", "same"]
        key, parts, block, held = None, [], None, [[] for _ in names]
        for (dim, number, side), part in spans(batches, ("dim", "block", "side")):
            if (dim, number) != key:
                key, parts, block = (dim, number), [], None
            if not side:
                parts.append(part)
                continue
            if block is None and parts:
                block, parts = Block(pa.Table.from_batches(parts), dim), []
            if block is None:
                continue
            vectors = unpacked(part.column("x"), "<i4", part.num_rows).astype(float)
            own = shared.value.get(dim)
            for a, row in zip(vectors, part.select(["node", "vec_id", "label", "tops"]).to_pylist(), strict=True):
                tables = [w @ a[cut] for w, cut in zip(own, cuts(dim), strict=True)] if own else [np.zeros(1)] * len(cuts(dim))
                for top, score, at in found(block, a, tables, row):
                    if len(at):
                        for h, v in zip(held, (np.full(len(at), row["node"]), np.full(len(at), top), score, block.ids[at], block.same[at]), strict=True):
                            h.append(v)
                if len(held[0]) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)) for h in held], names)
                    held = [[] for _ in names]
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)) for h in held], names)

    return both.mapInArrow(work, "anchor long, top long, score long, vec_id long, same long")


def merged(found: DataFrame, k: int, rank: str) -> DataFrame:
    """The k best of each anchor's window over all blocks; what two blocks found alike counts once."""
    w = Window.partitionBy("anchor", "top").orderBy(F.desc("score"), "vec_id", "same")
    return found.distinct().withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from vectors (vec_id, label, embedding).

    `anchor` says which rows are anchors. The score of a row is the inner product of its integers, floor(256 * x), with the
    anchor's. An anchor's positives are the first rows of its label with another vec_id, its negatives for one of them the first rows
    of other labels with share[0] * positive_score <= share[1] * negative_score <= share[1] * positive_score. Higher scores come first,
    equal ones by smaller vec_id; fewer are returned where there are fewer, none for a negative positive_score.

    Rows without vec_id or label or vector, with a null or non-finite component, or a norm of 2^22 or more take no part. Vectors
    have scores with those of their dimension only. Rows that repeat vec_id, label and vector count once; rows that share a
    vec_id only are rows of their own, and each an anchor of its own. An empty table gives no rows. Other columns play no part.
    """
    spark = vectors.sparkSession
    named = vectors.select("vec_id", "label", "embedding", F.coalesce(anchor, F.lit(False)).alias("asks"))
    good = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & taking_part(F.col("embedding")))
    sizes = good.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(DIMENSIONS).collect()
    words = {}
    for dim in [r["dim"] for r in sizes if r["dim"]]:
        sample = good.where(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(SAMPLE).select("embedding").collect()
        words[dim] = codewords(np.floor(SCALE * np.array([r[0] for r in sample], float)))
    rows = stored(coded(good, words))
    anchors = stored(coded(good.where("asks"), {}).dropDuplicates(["vec_id", "same"]).select("node", "vec_id", "label", "dim", "same", "x"))
    n = rows.count()
    blocks = max(1, -(-n // BLOCK), min(spark.sparkContext.defaultParallelism, -(-n // SMALL)))

    def alike(block: Block, a: np.ndarray, tables: list[np.ndarray], row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        yield 0, *positives_in(block, a, tables, row["vec_id"], row["label"], positives)

    def unlike(block: Block, a: np.ndarray, tables: list[np.ndarray], row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        yield from negatives_in(block, a, tables, row["label"], row["tops"], negatives, share)

    first = stored(merged(tiled(rows, anchors, blocks, words, alike), positives, "place").select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = first.where("positive_score >= 0").groupBy("anchor").agg(F.collect_set("positive_score").alias("tops"))
    asking = anchors.join(windows, F.col("node") == F.col("anchor")).drop("anchor")
    second = merged(tiled(rows, asking, blocks, words, unlike), negatives, "rank").select("anchor", F.col("top").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = first.join(second, ["anchor", "positive_score"]).join(anchors.select(F.col("node").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

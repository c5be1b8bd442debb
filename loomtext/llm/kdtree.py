"""Exact centroid clustering by filtering through kd-trees.

Every partition of the vectors is laid out, once, as kd-trees of up to TREE vectors: a node keeps the count, the componentwise
sums and the box of its vectors. In a round the centroids go down each tree. At a node the candidate nearest to the middle of
the box is set against each other one at the corner of the box that suits the other best: if it is nearer even there, it is
nearer to every vector of the node, and the other is dropped. A node with one candidate left is assigned as a whole, by its
count and sums; in leaves with several the distances decide. Only a strictly farther centroid is dropped, so ties go to the
smaller number as they do vector by vector. All numbers are integers, so rounds have one result, whatever the partitions.

The trees are stored, and a round reads them and returns a count and sums for each centroid and task; a lost executor's trees
are read again from the shared folder. No vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from loomtext.llm.shared import stored

#: Vectors of a tree and of a leaf, at most (more only if they are all equal).
TREE, LEAF = 8192, 64
#: A component x becomes floor(SCALE * x). Vectors with a component of this size (before scaling) or beyond aren't kept: their distances leave the range of a long.
SCALE, LIMIT = 256, 1 << 19
#: Up to this size of a component, doubles hold all sums exactly; beyond, Python's integers do.
EXACT = 1 << 21
#: Numbers of an intermediate array, about.
CHUNK = 1 << 18


def kept(embedding: F.Column, dim: int) -> F.Column:
    """Whether a vector takes part: `dim` components, none null, NaN or infinite (or beyond LIMIT)."""
    return F.coalesce((F.size(embedding) == dim) & F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < LIMIT, F.lit(False))), F.lit(False))


def integers(flat: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * flat.astype(np.float64)).astype(np.int64)


class Tree:
    """Vectors in the order of the leaves, and nodes: where their vectors begin and end, the first of two children (0: a leaf), box and sums."""

    def __init__(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray, child: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.x, self.begin, self.end, self.child, self.low, self.high, self.sums = x, begin, end, child, low, high, sums

    @classmethod
    def build(cls, x: np.ndarray) -> tuple[Tree, np.ndarray]:
        """Of n vectors (n > 0), and the order that they come in."""
        order, begin, end, child = np.arange(len(x)), [0], [len(x)], []
        low, high = [], []
        for k, (b, e) in enumerate(zip(begin, end)):  # noqa: B905  both grow meanwhile
            part = x[order[b:e]]
            low.append(part.min(0))
            high.append(part.max(0))
            spread = high[k] - low[k]
            wide = int(spread.argmax()) if len(spread) else 0
            if e - b <= LEAF or not len(spread) or not spread[wide]:
                child.append(0)
                continue
            half = (e - b) // 2
            order[b:e] = order[b:e][np.argpartition(part[:, wide], half)]
            child.append(len(begin))
            begin += [b, b + half]
            end += [b + half, e]
        x = x[order]
        upto = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, 0)])
        b, e = np.array(begin), np.array(end)
        return cls(x, b, e, np.array(child), np.stack(low), np.stack(high), upto[e] - upto[b]), order

    def split(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes that are assigned as a whole and their centroids; leaves that are open and which centroids are left there (a row of truths a leaf)."""
        whole, owner, leaves, left = [], [], [], []
        nodes, alive = np.zeros(1, int), np.ones((1, len(z)), bool)
        squares = (z * z).sum(1)
        step = max(1, CHUNK // max(1, z.size))
        while len(nodes):
            for at in range(0, len(nodes), step):
                own, live = nodes[at : at + step], alive[at : at + step]
                low, high = self.low[own].astype(z.dtype), self.high[own].astype(z.dtype)
                far = 4 * squares[None] - 4 * ((low + high) @ z.T)  # to the middle of the box, all four times and less a constant
                best = np.where(live, far, np.inf).argmin(1)
                near = z[best][:, None]
                corner = np.where(z[None] > near, high[:, None], low[:, None])
                live &= ~(((z[None] - near) * (z[None] + near - 2 * corner)).sum(2) > 0)
            one = alive.sum(1) == 1
            whole.append(nodes[one])
            owner.append(alive[one].argmax(1))
            leaf = ~one & (self.child[nodes] == 0)
            leaves.append(nodes[leaf])
            left.append(alive[leaf])
            down = ~one & ~leaf
            nodes = (self.child[nodes[down]][:, None] + np.arange(2)).ravel()
            alive = np.repeat(alive[down], 2, axis=0)
        return np.concatenate(whole), np.concatenate(owner), np.concatenate(leaves), np.concatenate(left)

    def places(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of these nodes' vectors, and of each which of the nodes it is in."""
        size = self.end[nodes] - self.begin[nodes]
        which = np.repeat(np.arange(len(nodes)), size)
        return np.arange(size.sum()) + np.repeat(self.begin[nodes] - (np.cumsum(size) - size), size), which

    def resolved(self, z: np.ndarray, leaves: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the vectors in open leaves, and the nearest of the centroids left there; of equally near ones the first."""
        at, which = self.places(leaves)
        nearest = np.zeros(len(at), int)
        squares = (z * z).sum(1)
        step = max(1, CHUNK // max(1, len(z)))
        for k in range(0, len(at), step):
            far = squares[None] - 2 * (self.x[at[k : k + step]].astype(z.dtype) @ z.T)
            nearest[k : k + step] = np.where(left[which[k : k + step]], far, np.inf).argmin(1)
        return at, nearest

    def numbers(self, centroids: np.ndarray) -> np.ndarray:
        """The centroids as numbers that are exact together with these vectors."""
        most = max(np.abs(self.low[0]).max(initial=0), np.abs(self.high[0]).max(initial=0), np.abs(centroids).max(initial=0))
        return centroids.astype(np.float64 if most <= EXACT else object)

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each centroid, how many vectors are nearest to it, and their sums."""
        z = self.numbers(centroids)
        whole, owner, leaves, left = self.split(z)
        n, sums = np.zeros(len(z), np.int64), np.zeros(z.shape, np.int64)
        np.add.at(n, owner, self.end[whole] - self.begin[whole])
        np.add.at(sums, owner, self.sums[whole])
        at, nearest = self.resolved(z, leaves, left)
        if len(at):
            order = np.argsort(nearest, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(nearest[order]) > 0))
            some = nearest[order][first]
            n[some] += np.diff(np.append(first, len(at)))
            sums[some] += np.add.reduceat(self.x[at[order]], first, axis=0)
        return n, sums

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector, its centroid and the squared distance."""
        z = self.numbers(centroids)
        whole, owner, leaves, left = self.split(z)
        cluster = np.zeros(len(self.x), np.int64)
        at, which = self.places(whole)
        cluster[at] = owner[which]
        at, nearest = self.resolved(z, leaves, left)
        cluster[at] = nearest
        away = self.x - centroids[cluster]
        return cluster, (away * away).sum(1)


def planted(vectors: DataFrame, dim: int) -> DataFrame:
    """Trees of the vectors (vec_id, embedding), each partition's own: a row a tree."""
    kind = StructType([
        StructField("ids", ArrayType(vectors.schema["vec_id"].dataType)), StructField("x", BinaryType()),
        *(StructField(c, ArrayType(IntegerType())) for c in ("begin", "end", "child")), *(StructField(c, BinaryType()) for c in ("low", "high", "sums")),
    ])

    def tree_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        x = integers(table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
        t, order = Tree.build(x)
        ids = table.column("vec_id").combine_chunks().take(pa.array(order))
        blob = lambda v, of: pa.array([v.astype(of).tobytes()], pa.binary())
        places = (pa.array([v.tolist()], pa.list_(pa.int32())) for v in (t.begin, t.end, t.child))
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([ids, blob(t.x, "<i4"), *places, blob(t.low, "<i4"), blob(t.high, "<i4"), blob(t.sums, "<i8")], kind.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, TREE - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == TREE:
                    yield tree_of(held)
                    held, n = [], 0
        if n:
            yield tree_of(held)

    return vectors.select("vec_id", "embedding").mapInArrow(work, kind)


def trees_in(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[Tree, pa.Array]]:
    """The trees of a batch and the ids of their vectors."""
    for k in range(batch.num_rows):
        ids = batch.column("ids")[k].values
        begin, end, child = (batch.column(c)[k].values.to_numpy() for c in ("begin", "end", "child"))
        x, low, high = (np.frombuffer(batch.column(c)[k].as_py(), "<i4").astype(np.int64) for c in ("x", "low", "high"))
        sums = np.frombuffer(batch.column("sums")[k].as_py(), "<i8")
        yield Tree(x.reshape(len(ids), dim), begin, end, child, *(v.reshape(len(begin), dim) for v in (low, high, sums))), ids


def first_centroids(vectors: DataFrame, k: int, dim: int, seed: str) -> np.ndarray:
    """The integers of the k vectors whose `seed` + vec_id have the smallest SHA-256, in that order; equal ids go by their vectors, rows without id come last."""
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(order.alias("place"), "embedding").orderBy(F.asc_nulls_last("place"), "embedding").limit(k).collect()
    return integers(np.array([r["embedding"] for r in rows], float).reshape(-1, dim))


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor of the mean, component by component; one without vectors stays."""
    shared = trees.sparkSession.sparkContext.broadcast(centroids)
    k, dim = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for tree, _ in trees_in(batch, dim):
                more, further = tree.totals(shared.value)
                n += more
                sums += further
        some = np.flatnonzero(n)
        columns = (np.repeat(some, dim), np.tile(np.arange(dim), len(some)), np.repeat(n[some], dim), sums[some].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["cluster", "at", "n", "total"])

    totals = trees.mapInArrow(work, "cluster long, at long, n long, total long").groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = centroids.copy()
    for r in totals.collect():  # a row a component of a centroid
        out[r["cluster"], r["at"]] = r["total"] // r["n"]
    return out


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: str = "2:") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared, to its centroid), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of `dim` components, none null or non-finite; a component x counts as floor(256 * x). Those with a
    component of LIMIT (524,288) or more in size aren't kept either. Rows that repeat are vectors of their own and count each;
    so are rows that share a vec_id, and rows without one (which become first centroids last). With fewer than k vectors there
    are as many centroids as vectors; equal centroids are allowed, and the smaller number gets the vectors. An empty table
    gives no rows. Other columns play no part.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").where(kept(F.col("embedding"), dim))
    centroids = first_centroids(rows, k, dim, seed)
    trees = stored(planted(rows, dim))
    for _ in range(rounds if len(centroids) else 0):
        before, centroids = centroids, moved(trees, centroids)
        if (before == centroids).all():
            break
    shared = spark.sparkContext.broadcast(centroids)
    kind = StructType([vectors.schema["vec_id"], StructField("cluster", IntegerType()), StructField("distance", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, ids in trees_in(batch, dim):
                cluster, distance = tree.assigned(shared.value)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], kind.names)

    found = stored(trees.mapInArrow(work, kind))
    inertia = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows at most
    most = (1 << 63) - 1
    every = min(sum(inertia.values()), most)
    named = [(c, min(v, most), every, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, v in sorted(inertia.items())]
    facts = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

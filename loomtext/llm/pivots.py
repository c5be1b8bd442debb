"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference points (pivots), nearest first. Two vectors are compared if their
first pivots (PREFIX and more of them) have two or more in common: postings are kept for each pair of pivots, so a list holds vectors that
share two already, and a pair is verified in the list of the smallest pair that it shares, once. A list returns how many
links each vector has in it and how they hang together, never the pairs. Links are cosines of 0.9 and more, in double
precision. Pivots lie more than the link's angle apart: were they closer, a loose group (members linked, but farther than
half that angle from each other) would hold many, and which of them are nearest to a member would be close to chance.

Dense groups don't go through lists. Angles obey the triangle inequality, so vectors within half the link's angle of one
pivot (its home class) are all linked with each other, whatever their number: they are counted, not paired. Between a
class and anything else the same inequality settles most cases from the distances to pivots alone; the few undecided
ones are compared in tiles that return counts. Pivots come from a sample of the vectors, those with the most neighbours
in it first, so a dense group that is as large as a few sampled rows stand for has one of its own. Their number grows with
the square root of the number of vectors, so that lists stay short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.shared import components, cut, stored
from loomtext.llm.textbatch import segments

#: Least and most pivots (about four times the square root of the number of vectors between), and rows that are sampled for each
#: of them (so the sample is bounded by 16,384 rows).
FEWEST, PIVOTS, SAMPLED = 512, 4096, 4
#: How many pivots describe a vector: PREFIX of USUAL ones, and one more each time that their number doubles, so that of pairs with
#: cosines of 0.90 to 0.93 as many share two (99.8 of 100 in a model of isotropic vectors) whatever the number of vectors.
PREFIX, USUAL = 9, 512
#: Vectors on a side of a tile.
TILE = 1024
#: Vectors that the lists of one pivot are compared with in one task, about.
GROUP = 16_384
#: What rounding may move an angle by: near 1, an error of 1e-16 in a cosine is one of 1.5e-8 in its angle.
SLACK = 1e-7


def unit(batch_column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of this dimension that can be compared, of length 1, and their rows."""
    column = batch_column.cast(pa.list_(pa.float64()))
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
    flat = column.flatten().to_numpy(zero_copy_only=False)  # null components come as NaN
    begins = np.cumsum(sizes) - sizes
    rows = np.flatnonzero(sizes == dim) if dim else np.zeros(0, int)
    x = flat[begins[rows][:, None] + np.arange(dim)[None, :]] if len(rows) else np.zeros((0, dim))
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.abs(x).max(axis=1, initial=0)
        good = np.isfinite(most) & np.isfinite(x).all(axis=1) & (most > 0)
        x, rows = x[good] / most[good][:, None], rows[good]
        return x / np.linalg.norm(x, axis=1)[:, None], rows


def choose(sample: np.ndarray, apart: float, most: int) -> np.ndarray:
    """At most so many rows of the sample, of which none is within the angle `apart` of another; those with the most neighbours within half of it come first."""
    near = np.concatenate([(sample[k : k + 1024] @ sample.T >= np.cos(apart / 2)).sum(1) for k in range(0, len(sample), 1024)]) if len(sample) else np.zeros(0)
    out, n = np.zeros((min(most, len(sample)), sample.shape[1])), 0
    for v in sample[np.argsort(-near, kind="stable")]:
        if n == len(out):
            break
        if not n or (out[:n] @ v).max() < np.cos(apart):
            out[n] = v
            n += 1
    return out[:n]


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def packed(x: np.ndarray) -> pa.Array:
    """Rows of doubles as binary."""
    data = np.ascontiguousarray(x, "<f8").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.array(np.arange(len(x) + 1, dtype=np.int32) * 8 * x.shape[1]).buffers()[1], pa.py_buffer(data)])


def unpacked(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def prefix_size(pivots: int) -> int:
    return min(pivots, PREFIX + max(0, math.ceil(math.log2(max(pivots, 1) / USUAL))))


def describe(vectors: DataFrame, pivots: np.ndarray, half: float) -> DataFrame:
    """node, vector (binary, of length 1), prefix (nearest pivots, nearest first), home (the nearest one, if within `half`; else -1), far (angle to it)."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        k = prefix_size(len(p))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, rows = unit(part.column("embedding"), p.shape[1])
                if not len(rows):
                    continue
                c = x @ p.T
                near = np.argpartition(-c, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(c, near, 1), axis=1, kind="stable"), 1)
                far = angle(np.take_along_axis(c, near[:, :1], 1)[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node").take(pa.array(rows)),
                        packed(x),
                        pa.FixedSizeListArray.from_arrays(pa.array(near.ravel().astype(np.int32)), k).cast(pa.list_(pa.int32())),
                        pa.array(np.where(far <= half - SLACK, near[:, 0], -1).astype(np.int32)),
                        pa.array(far),
                    ],
                    ["node", "vector", "prefix", "home", "far"],
                )

    return vectors.select("node", "embedding").mapInArrow(work, "node long, vector binary, prefix array<int>, home int, far double")


def hanging(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0..n-1 that each can reach by the links (a, b), which are in order of a and hold both directions."""
    root = np.arange(n)
    if not len(a):
        return root
    begins = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    node = a[begins]
    while True:
        low = root.copy()
        low[node] = np.minimum(root[node], np.minimum.reduceat(root[b], begins))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def pair_key(i: F.Column, j: F.Column) -> F.Column:
    return i.cast("long") * PIVOTS + j


def seconds(own: F.Column, i: F.Column) -> F.Column:
    """Pivots that are in a list with pivot i: the later ones, or i itself where it is the only one."""
    return F.when(F.size(own) == 1, own).otherwise(F.filter(own, lambda j: j > i))


def posted(lone: DataFrame, dim: int, k: int, least: float) -> DataFrame:
    """Links among vectors without a home, those in a common list of two of their k pivots, verified: (node, other, n): its links in a tile, and a vector that all it hangs together with there have in common.

    A vector is sent to the first pivot of each of its pairs, once for all lists there (once for each share of them, if that pivot has more
    than GROUP vectors), so k - 1 times for its k * (k - 1) / 2 lists. Lists of more than TILE vectors are compared in tiles of their own.
    """
    lone = lone.select("node", "vector", F.array_sort("prefix").alias("own"))
    firsts = lone.select("node", "own", F.explode(F.slice("own", 1, F.lit(max(1, k - 1)))).alias("i"))
    sizes = firsts.groupBy("i").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("shares"))  # a row a pivot
    pairs = firsts.select("node", F.explode(F.transform(seconds(F.col("own"), F.col("i")), lambda j: pair_key(F.col("i"), j))).alias("key"))
    long = cut(pairs.groupBy("key").count().where(F.col("count") > TILE).select("key", F.ceil(F.col("count") / TILE).cast("int").alias("blocks")))
    share = F.transform(seconds(F.col("own"), F.col("i")), lambda j: j % F.col("shares"))
    rows = lone.select("*", F.explode(F.slice("own", 1, F.lit(max(1, k - 1)))).alias("i")).join(F.broadcast(sizes), "i")
    rows = rows.select("i", "shares", F.explode(F.array_distinct(share)).alias("share"), "node", "vector", "own").repartition("i", "share").sortWithinPartitions("i", "share")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Links()
        for s in segments(batches, ("i", "share")):
            if s.num_rows > 1:
                i, shares, number = (s.column(c)[0].as_py() for c in ("i", "shares", "share"))
                at_once(out, *opened(s, dim), i, shares, number, least)
            if out.held > 50_000:
                yield out.batch()
        if out.held:
            yield out.batch()

    found = rows.mapInArrow(together, LINKS)
    if long.isEmpty():
        return found
    dealt = pairs.join(long, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node").join(lone, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def tile_by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Links()
        for s in segments(batches, ("key", "i", "j")):
            if s.num_rows < 2:
                continue
            x, ids, own = opened(s, dim)
            block = s.column("block").to_numpy()
            i, j = s.column("i")[0].as_py(), s.column("j")[0].as_py()
            left = np.flatnonzero(block == i)
            right = left if i == j else np.flatnonzero(block == j)
            a, b = np.nonzero(in_list(x, own, ids, left, right, *divmod(s.column("key")[0].as_py(), PIVOTS), least))
            a, b = left[a], right[b]
            out.add(ids, *((a, b) if i == j else (np.concatenate([a, b]), np.concatenate([b, a]))))
            if out.held > 50_000:
                yield out.batch()
        if out.held:
            yield out.batch()

    return found.unionByName(dealt.mapInArrow(tile_by_tile, LINKS))


LINKS = "node long, other long, n long"


class Links:
    """What tiles find, for a batch of rows."""

    def __init__(self):
        self.columns, self.held = ([], [], []), 0

    def add(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Links between these places, both directions of each."""
        if not len(a):
            return
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        n = np.bincount(a, minlength=len(ids))
        row = np.flatnonzero(n)
        for o, v in zip(self.columns, (ids[row], ids[hanging(a, b, len(ids))[row]], n[row]), strict=True):
            o.append(v)
        self.held += len(row)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in self.columns], ["node", "other", "n"])
        self.__init__()
        return out


def opened(s: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors, ids and pivots in order of a segment."""
    ids = s.column("node").to_numpy()
    return unpacked(s.column("vector"), dim), ids, s.column("own").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)


def in_list(x: np.ndarray, own: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, first: int, second: int, least: float) -> np.ndarray:
    """Which of the left link with which of the right, and have no two smaller pivots in common: only one list reports a pair."""
    hit = (x[left] @ x[right].T >= least) & (ids[left][:, None] != ids[right][None, :])
    earlier = (own < second) & (own != first)
    names, at = np.unique(own[earlier], return_inverse=True)
    if len(names) and hit.any():
        marks = np.zeros((len(ids), len(names)), np.float32)
        marks[np.nonzero(earlier)[0], at] = 1
        hit &= marks[left] @ marks[right].T == 0
    return hit


def at_once(out: Links, x: np.ndarray, ids: np.ndarray, own: np.ndarray, i: int, shares: int, number: int, least: float) -> None:
    """Adds the links of all lists of pivot i that are in this share and no longer than TILE. Few vectors are compared all at once, and links kept where the list is the pair's own; more are compared list by list."""
    n, k = own.shape
    mine = ((own > i) | (k == 1)) & (own % shares == number)
    names, which, size = np.unique(own[mine], return_inverse=True, return_counts=True)
    row = np.nonzero(mine)[0]
    if n <= 2 * TILE:
        a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
        short = names[size <= TILE]
        keep = np.zeros(len(a), bool)
        for at in range(0, len(a), 50_000):
            p, q = own[a[at : at + 50_000]], own[b[at : at + 50_000]]
            common = (p[:, :, None] == q[:, None, :]).any(2)
            first = common.argmax(1)
            line = np.arange(len(p))
            is_first = p[line, first] == i
            if k > 1:
                common[line, first] = False
            second = common.argmax(1)
            keep[at : at + 50_000] = is_first & common[line, second] & np.isin(p[line, second], short)
        a, b = a[keep], b[keep]
        out.add(ids, np.concatenate([a, b]), np.concatenate([b, a]))
        return
    order = np.argsort(which, kind="stable")
    for j, at in zip(names.tolist(), np.split(row[order], np.cumsum(size)[:-1]), strict=True):
        if 1 < len(at) <= TILE:
            a, b = np.nonzero(in_list(x[at], own[at], ids[at], *[np.arange(len(at))] * 2, i, j, least))
            out.add(ids[at], a, b)


def settled(lone: DataFrame, pivots: np.ndarray, homes: dict[str, np.ndarray], full: float) -> DataFrame:
    """Of each vector without a home and each class near it: (node, home, n): n = the class size if it links with all of it, null if that is open."""
    shared = lone.sparkSession.sparkContext.broadcast((pivots[homes["home"]], homes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, homes = shared.value
        far = homes["far"]
        for batch in batches:
            for at in range(0, batch.num_rows if len(p) else 0, 4096):
                part = batch.slice(at, 4096)
                ids = part.column("node").to_numpy()
                to = angle(np.frombuffer(b"".join(part.column("vector").to_pylist()), "<f8").reshape(len(ids), -1) @ p.T)
                row, k = np.nonzero(to - far <= full + SLACK)
                all_of_it = (to[row, k] + far[k]) <= full - SLACK
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(homes["home"][k].astype(np.int32)), pa.array(homes["n"][k], mask=~all_of_it)], ["node", "home", "n"])

    return lone.select("node", "vector").mapInArrow(work, "node long, home int, n long")


def compared(left: DataFrame, right: DataFrame, dim: int, least: float) -> DataFrame:
    """Between rows (pair, node, vector) of the left and the right: (node, other, n): its links on the other side, and one of them. Tiles of TILE by TILE."""

    def blocks(df: DataFrame, side: int) -> DataFrame:
        n = df.groupBy("pair").agg(F.ceil(F.count("*") / TILE).cast("int").alias(f"blocks{side}"))
        return n

    n = blocks(left, 0).join(blocks(right, 1), "pair")
    a = left.join(n, "pair").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks0")).cast("int")).select("pair", "i", F.explode(F.sequence(F.lit(0), F.col("blocks1") - 1)).alias("j"), F.lit(0).alias("side"), "node", "vector")
    b = right.join(n, "pair").withColumn("j", F.pmod(F.xxhash64("node"), F.col("blocks1")).cast("int")).select("pair", F.explode(F.sequence(F.lit(0), F.col("blocks0") - 1)).alias("i"), "j", F.lit(1).alias("side"), "node", "vector")
    rows = a.unionByName(b).repartition("pair", "i", "j").sortWithinPartitions("pair", "i", "j")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in segments(batches, ("pair", "i", "j")):
            x, ids, side = unpacked(s.column("vector"), dim), s.column("node").to_numpy(), s.column("side").to_numpy()
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(one) or not len(two):
                continue
            hit = x[one] @ x[two].T >= least
            for mine, theirs, h in ((one, two, hit), (two, one, hit.T)):
                n = h.sum(1)
                row = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[mine[row]]), pa.array(ids[theirs[h[row].argmax(1)]]), pa.array(n[row].astype(np.int64))], ["node", "other", "n"])

    return rows.mapInArrow(work, "node long, other long, n long")


def in_one_tile(vectors: DataFrame, least: float) -> DataFrame:
    """Links among the vectors of each dimension, of which there are TILE at most: (node, other, n) as posted() has it."""
    rows = vectors.repartition("dim").sortWithinPartitions("dim")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in segments(batches, ("dim",)):
            s = s.combine_chunks()
            x, row = unit(s.column("embedding").combine_chunks(), s.column("dim")[0].as_py())
            ids = s.column("node").to_numpy()[row]
            a, b = np.nonzero((x @ x.T >= least) & ~np.eye(len(x), dtype=bool))
            n = np.bincount(a, minlength=len(ids))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[hanging(a, b, len(ids))[some]]), pa.array(n[some])], ["node", "other", "n"])

    return rows.select("dim", "node", "embedding").mapInArrow(work, "node long, other long, n long")


def indexed(vectors: DataFrame, dim: int, count: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Links among the vectors (node, embedding), all of one dimension: (node, n), parts of each one's number of links, and edges (a, b) that hang together what links do."""
    spark = vectors.sparkSession
    most = min(PIVOTS, max(FEWEST, 1 << math.ceil(math.log2(4 * math.sqrt(count)))))
    sample = vectors.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(SAMPLED * most).select("embedding").toArrow().column(0).combine_chunks()
    full = float(np.arccos(least))
    pivots = choose(unit(sample, dim)[0], full, most)
    if not len(pivots):
        return spark.createDataFrame([], "node long, n long"), spark.createDataFrame([], "a long, b long")
    found = stored(describe(vectors, pivots, full / 2))
    lone, housed = found.where("home < 0"), found.where("home >= 0")
    classes = housed.groupBy("home").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.min("node").alias("head")).orderBy("home").toArrow()  # a row a pivot at most
    homes = {c: classes.column(c).to_numpy() for c in ("home", "n", "far", "head")}
    # pairs of classes: all linked, or open
    far, p = homes["far"], pivots[homes["home"]]
    apart = angle(p @ p.T)
    near = np.triu(apart - far[:, None] - far[None, :] <= full + SLACK, 1)
    surely = near & (apart + far[:, None] + far[None, :] <= full - SLACK)
    s, t = np.nonzero(near & ~surely)
    both = frame(spark, "s int, t int", homes["home"][s], homes["home"][t])
    own = homes["n"] - 1 + (surely | surely.T) @ homes["n"]
    heads = frame(spark, "home int, whole long, head long", homes["home"], own, homes["head"])
    near_one = cut(settled(lone, pivots, homes, full))
    opened = near_one.where("n IS NULL").select("node", F.col("home").alias("at"))
    alone = (F.col("at") * PIVOTS + F.col("at")).alias("pair")
    lefts = opened.join(lone.select("node", "vector"), "node").select(alone, "node", "vector")
    rights = housed.join(opened.select("at").distinct(), F.col("home") == F.col("at")).select(alone, "node", "vector")
    pair = (F.col("s") * PIVOTS + F.col("t")).alias("pair")
    lefts = lefts.unionByName(housed.join(both, F.col("home") == F.col("s")).select(pair, "node", "vector"))
    rights = rights.unionByName(housed.join(both, F.col("home") == F.col("t")).select(pair, "node", "vector"))
    tiles = cut(compared(lefts, rights, dim, least))
    lists = cut(posted(lone, dim, prefix_size(len(pivots)), least))
    whole = near_one.where("n IS NOT NULL")
    back = whole.groupBy("home").agg(F.count("*").alias("n"))  # what a class gets from vectors that link with all of it
    counts = (
        housed.join(heads, "home").select("node", F.col("whole").alias("n"))
        .unionByName(whole.select("node", "n"))
        .unionByName(tiles.select("node", "n"))
        .unionByName(lists.select("node", "n"))
        .unionByName(housed.join(back, "home").select("node", "n"))
    )
    a, b = np.nonzero(surely)
    edges = (
        housed.select("node", "home").unionByName(whole.select("node", "home")).join(heads, "home").select(F.col("node").alias("a"), F.col("head").alias("b"))
        .unionByName(tiles.unionByName(lists).select(F.col("node").alias("a"), F.col("other").alias("b")))
        .unionByName(frame(spark, "a long, b long", homes["head"][a], homes["head"][b]))
    )
    return counts, edges


def frame(spark: SparkSession, schema: str, *columns: np.ndarray) -> DataFrame:
    """A small table of numbers."""
    return spark.createDataFrame(list(zip(*(c.tolist() for c in columns), strict=True)), schema)


def linked(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest vec_id reachable by links, itself included), kept (it is that one).

    A vector is a vec_id with an embedding: rows that repeat both are one vector, count once, and all get its result; rows that
    share a vec_id only are different vectors, which may link. Vectors link with others of their dimension only. Null, empty or zero
    ones, and those with null or non-finite components, link with nothing; rows without vec_id are returned without links.
    Labels and other columns play no part. An empty table gives no rows. The usual dimension and every other one of more than TILE vectors have an
    index each; the others fit into a tile each.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", F.xxhash64("embedding").alias("same"))
    usable = rows.where("vec_id IS NOT NULL AND size(embedding) > 0").groupBy("vec_id", "same").agg(F.first("embedding").alias("embedding"))
    nodes = stored(usable.select("vec_id", "same", "embedding", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("node")))  # numbered once, as they are stored
    sizes = nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim")
    large = [(r["dim"], r["n"]) for r in sizes.limit(1).unionByName(sizes.where(F.col("n") > TILE)).distinct().collect()]
    counts, edges = spark.createDataFrame([], "node long, n long"), spark.createDataFrame([], "a long, b long")
    for dim, n in large:
        more = indexed(nodes.where(F.col("dim") == dim), dim, n, least)
        counts, edges = counts.unionByName(more[0]), edges.unionByName(more[1])
    rest = cut(in_one_tile(nodes.where(~F.col("dim").isin([d for d, _ in large])), least))
    counts, edges = counts.unionByName(rest.select("node", "n")), edges.unionByName(rest.select(F.col("node").alias("a"), F.col("other").alias("b")))
    names = nodes.select("node", "vec_id", "same")
    groups = components(edges).join(names, "node")
    groups = groups.join(groups.groupBy("component").agg(F.min("vec_id").alias("component_id")), "component").select("node", "component_id")
    counts = counts.groupBy("node").agg(F.sum("n").alias("n_links"))
    of_node = names.join(counts, "node", "left").join(groups, "node", "left").drop("node")
    component = F.coalesce("component_id", "vec_id").alias("component_id")
    out = rows.select("vec_id", "same").join(of_node, ["vec_id", "same"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component, F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))

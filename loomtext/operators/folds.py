"""Folds without leakage: groups, strata, quotas, balance, audits; and answer positions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomtext.functions.arrays import moved
from loomtext.functions.batches import spans
from loomtext.sources.readers import numbered_rows
from loomtext.sources.scratch import stored

#: Kinds of groups that the driver settles, and a task.
KINDS = 10_000


def dense_ids(df: DataFrame, column: str, out: str = "group_id") -> DataFrame:
    """0-based ids of the values in code-point order. Values are ranked once each: ranges of them are counted, and numbered within; they are joined back by a SHA-256."""
    key = F.sha2(F.col(column).cast("string").cast("binary"), 256).alias("__key")
    ids = numbered_rows(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], out).select(key, out)
    return df.withColumn("__key", key).join(ids, "__key").drop("__key")


def quantile_edges(df: DataFrame, column: str, q: int = 5) -> list[float]:
    """The distinct q-quantiles, by linear interpolation between the two values they fall between. Exact: equal values are counted first, then ranged and summed up."""
    counts = numbered_rows(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")), [column], "__i")
    counts = counts.withColumn("__range", (F.col("__i") / 65_536).cast("long"))
    ends = counts.groupBy("__range").agg(F.sum("n").alias("__n"))  # a row for 65,536 distinct values
    before = ends.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    upto = F.sum("n").over(Window.partitionBy("__range").orderBy(column)) + F.col("__before")
    ranked = counts.join(F.broadcast(before), "__range").select(F.col(column).cast("double").alias("v"), (upto - F.col("n")).alias("lo"), (upto - 1).alias("hi"))  # rows lo..hi have this value
    total = (ends.agg(F.sum("__n")).first()[0] or 0) - 1
    if total < 0:
        return []
    places = {k: k * total / q for k in range(q + 1)}
    wanted = sorted({i for p in places.values() for i in (math.floor(p), math.ceil(p))})
    of = {r["i"]: r["v"] for r in ranked.select("v", F.explode(F.filter(F.array(*map(F.lit, wanted)), lambda i: i.between(F.col("lo"), F.col("hi")))).alias("i")).collect()}
    return sorted({of[math.floor(p)] + (of[math.ceil(p)] - of[math.floor(p)]) * (p - math.floor(p)) for p in places.values()})


def quantile_bin(c: Column, edges: list[float]) -> Column:
    """Number of inner edges below the value: right-closed bins, duplicate edges dropped; null stays null."""
    inner = edges[1:-1]
    return F.when(c.isNotNull(), sum(((c > e).cast("int") for e in inner), F.lit(0)))


def shuffled(seed: str, *keys: str) -> list[Column]:
    """A seeded order that depends on the keys only."""
    return [F.md5(F.concat_ws(":", F.lit(seed), *keys)), *map(F.col, keys)]


def placed(df: DataFrame, same: str, key: str, seed: str, out: str) -> DataFrame:
    """`out`: 0-based place of each row among those with the same value of `same` (null is one), in a shuffled order.

    The order is that of a hash, so ranges of it are known beforehand: 4,096 of each value are counted, and numbered within. A
    value that holds most rows is thus spread over all tasks. Select few columns: all of them are shuffled.
    """
    rows = df.withColumn("__o", shuffled(seed, key)[0])
    rows = rows.withColumn("__part", F.conv(F.left("__o", F.lit(3)), 16, 10).cast("int"))
    ends = rows.groupBy(same, "__part").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(same).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.col(same).alias("__same"), F.col("__part").alias("__range"), F.coalesce(before, F.lit(0)).alias("__before"))
    rows = rows.withColumn("__within", F.row_number().over(Window.partitionBy(same, "__part").orderBy("__o", key)))
    rows = rows.join(ends, F.col(same).eqNullSafe(F.col("__same")) & (F.col("__part") == F.col("__range")))
    return rows.withColumn(out, F.col("__before") + F.col("__within") - 1).drop("__o", "__part", "__same", "__range", "__before", "__within")


def dealt(df: DataFrame, same: str, key: str, seed: str, n_folds: int, out: str = "fold") -> DataFrame:
    """Folds 0..n - 1 in turn, in a shuffled order within each value of `same`, so that sizes differ by one at most."""
    return placed(df, same, key, seed, "__at").withColumn(out, (F.col("__at") % n_folds).cast("int")).drop("__at")


def balanced_targets(df: DataFrame, options: str, key: str, seed: str) -> DataFrame:
    """`target`: answers 1..options in turn, in a shuffled order within each number of options, so that counts differ by one at most."""
    return placed(df, options, key, seed, "__at").withColumn("target", F.col("__at") % F.col(options) + 1).drop("__at")


def rebalanced(df: DataFrame, choices: str, answer: str, key: str, seed: str) -> DataFrame:
    """Moves the right choice to its target place; rows without a valid answer stay as they are."""
    n = F.coalesce(F.size(choices), F.lit(0))
    valid = F.coalesce(F.col(answer).between(1, n), F.lit(False))
    rows = df.withColumn("__n", n)
    good = balanced_targets(rows.where(valid), "__n", key, seed)
    good = good.withColumn(choices, moved(F.col(choices), F.col(answer), F.col("target"))).withColumn(answer, F.col("target"))
    return good.drop("__n", "target").unionByName(rows.where(~valid).drop("__n"))


def quota(df: DataFrame, key: str, first: int, eval_fold: int, n_folds: int, seed: str) -> DataFrame:
    """`fold`: the first rows of a shuffled order go to the evaluation fold, the rest to the others in turn."""
    rows = placed(df.withColumn("__all", F.lit(0)), "__all", key, seed, "__at")
    i = F.col("__at")
    turn = F.pmod(i - first, F.lit(n_folds))
    fold = F.when(i < first, eval_fold).when(turn == eval_fold, F.pmod(turn + 1, F.lit(n_folds))).otherwise(turn).cast("int")
    return rows.withColumn("fold", fold).drop("__all", "__at")


class Loads:
    """How much of each label the folds have, and where a group's labels leave the shares most even. Only the labels of a group are looked at, however many there are."""

    def __init__(self, total: np.ndarray, n_folds: int, have: np.ndarray | None = None):
        self.total, self.have = np.maximum(total, 1e-9), np.zeros((len(total), n_folds)) if have is None else have.astype(float)
        self.sizes = self.have.sum(0)

    def deal(self, labels: np.ndarray, counts: np.ndarray, groups: int) -> list[int]:
        """How many of so many like groups go to each fold, in turn; of thousands, a thousandth of the rest at a time."""
        n_folds = self.have.shape[1]
        given = [0] * n_folds
        while groups:
            step = max(1, groups // 1000)
            shares = self.have[labels] / self.total[labels][:, None]
            more = step * counts / self.total[labels]
            tried = shares[None] + more[None, :, None] * np.eye(n_folds)[:, None, :]
            spread = np.round((tried.std(2) - shares.std(1)[None]).sum(1), 12)
            best = int(np.lexsort((np.arange(n_folds), self.sizes, spread))[0])
            self.have[labels, best] += step * counts
            self.sizes[best] += step * counts.sum()
            given[best] += step
            groups -= step
        return given


def _ends(loads: Loads, labels: list[list[int]], counts: list[list[int]], groups: list[int]) -> list[list[int]]:
    """Of each kind, in turn, up to which of its groups each fold reaches."""
    return [np.cumsum(loads.deal(np.array(v, np.int64), np.array(c, float), n)).tolist() for v, c, n in zip(labels, counts, groups, strict=True)]


def stratified_group_folds(df: DataFrame, group: str, label: str, n_folds: int, seed: str) -> DataFrame:
    """(group, fold): each group, those with the most uneven labels first, goes where label shares stay most even.

    The choice is sequential by nature, but groups with the same counts of labels are of one kind, and only how many of a kind go to each
    fold is chosen; which ones follows from a shuffled order that is numbered on the cluster. The KINDS most uneven kinds
    are settled one after another. If there are more (there are many labels), the others are dealt to so many tasks that each
    has about KINDS of them, a fair sample; a task goes on from its share of the loads so far. What comes to the driver
    is KINDS kinds and a few numbers for each label.
    """
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    totals = counts.groupBy(label).agg(F.sum("n").alias("n")).collect()  # a row a label
    labels = sorted((r[label] for r in totals), key=str)
    width = max(1, len(labels))
    total = np.zeros(width)
    at = {v: k for k, v in enumerate(labels)}
    for r in totals:
        total[at[r[label]]] = r["n"]
    index = df.sparkSession.createDataFrame([(v, k) for v, k in at.items()], T.StructType([T.StructField("__v", df.schema[label].dataType), T.StructField("__at", T.IntegerType())]))
    numbered = counts.join(F.broadcast(index) if width <= KINDS else index, F.col(label).eqNullSafe(F.col("__v"))).select(group, "__at", "n")
    groups = numbered.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col("__at").alias("at"), "n"))).alias("__c"))
    groups = stored(groups.select(group, "__c", F.md5(F.to_json("__c")).alias("__kind")))
    squares, whole = F.aggregate("__c", F.lit(0.0), lambda s, x: s + x["n"] * x["n"]), F.aggregate("__c", F.lit(0.0), lambda s, x: s + x["n"])
    kinds = groups.groupBy("__kind").agg(F.count("*").alias("groups"), F.first("__c").alias("__c")).withColumn("__uneven", -F.round(squares - whole * whole / width, 9))
    kinds = stored(kinds)
    order = ["__uneven", "__kind"]
    first = kinds.orderBy(*order).limit(KINDS).collect()
    loads = Loads(total, n_folds)
    schema = T.StructType([T.StructField("__to", T.StringType()), T.StructField("__ends", T.ArrayType(T.LongType()))])
    ends = _ends(loads, *([[x[k] for x in r["__c"]] for r in first] for k in ("at", "n")), [r["groups"] for r in first])
    to = F.broadcast(df.sparkSession.createDataFrame([(r["__kind"], e) for r, e in zip(first, ends, strict=True)], schema))
    n = kinds.count()
    if n > KINDS:
        last = first[-1]
        rest = kinds.where((F.col("__uneven") > last["__uneven"]) | ((F.col("__uneven") == last["__uneven"]) & (F.col("__kind") > last["__kind"])))
        tasks = -(-(n - KINDS) // KINDS)
        shared = df.sparkSession.sparkContext.broadcast((total, loads.have / tasks))
        rows = rest.select(F.pmod(F.xxhash64("__kind"), F.lit(tasks)).cast("int").alias("task"), *order, "groups", F.col("__c.at").alias("labels"), F.col("__c.n").alias("counts"))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, mine = None, None
            for (task,), part in spans(batches, ("task",)):
                if task != own:
                    own, mine = task, Loads(shared.value[0], n_folds, shared.value[1])
                found = _ends(mine, *(part.column(c).to_pylist() for c in ("labels", "counts", "groups")))
                yield pa.RecordBatch.from_arrays([part.column("__kind"), pa.array(found, pa.list_(pa.int64()))], schema.names)

        to = to.unionByName(rows.repartition("task").sortWithinPartitions("task", *order).mapInArrow(work, schema))
    rows = placed(groups.drop("__c"), "__kind", group, seed, "__at").join(to, F.col("__kind") == F.col("__to"))
    return rows.select(group, F.size(F.filter("__ends", lambda e: e <= F.col("__at"))).cast("int").alias("fold"))


def least_loaded(df: DataFrame, group: str, fold: str, target: Column, n_folds: int) -> DataFrame:
    """Moves groups that hold target rows, largest first, to the fold with the fewest target rows. Counts begin with the present folds and only grow.

    The choice is sequential by nature, but groups of one size with equally many target rows are alike: only these sizes, and how
    many groups have each, come to the driver, which gives each fold runs of them; groups are numbered on the cluster.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(target).alias("t")).where("t > 0")
    kinds = sizes.groupBy("n", "t").agg(F.count("*").alias("groups")).orderBy(F.desc("n"), F.desc("t")).collect()
    load = {r[fold]: r["t"] for r in df.groupBy(fold).agg(F.count_if(target).alias("t")).collect()}
    have = [load.get(f, 0) for f in range(n_folds)]
    runs = []
    for r in kinds:
        at = 0
        while at < r["groups"]:
            best = min(range(n_folds), key=lambda f: (have[f], f))
            if max(have) - have[best] > r["t"]:  # until it is no longer the least, all go there
                next_load = min((have[f] for f in range(n_folds) if f != best), default=have[best])
                k = min(r["groups"] - at, max(1, (next_load - have[best]) // r["t"]))
            else:
                k = 1
            runs.append((r["n"], r["t"], at, at + k, best))
            have[best] += k * r["t"]
            at += k
            if at < r["groups"] and max(have) - min(have) < r["t"]:  # from now on they take turns
                order = sorted(range(n_folds), key=lambda f: (have[f], f))
                rounds = (r["groups"] - at) // n_folds
                if rounds > 1:
                    runs += [(r["n"], r["t"], at + i, -rounds, f) for i, f in enumerate(order)]
                    at += rounds * n_folds
                    have = [h + rounds * r["t"] for h in have]
    to = df.sparkSession.createDataFrame(runs, "n long, t long, lo long, hi long, __to int")
    ranked = numbered_rows(sizes.withColumn("__n", -F.col("n")).withColumn("__t", -F.col("t")), ["__n", "__t", group], "__i").drop("__n", "__t")
    first = ranked.groupBy("n", "t").agg(F.min("__i").alias("__first"))
    ranked = ranked.join(F.broadcast(first), ["n", "t"]).withColumn("__i", F.col("__i") - F.col("__first"))
    turn = (F.col("hi") < 0) & (F.col("__i") >= F.col("lo")) & (F.col("__i") < F.col("lo") - F.col("hi") * n_folds) & ((F.col("__i") - F.col("lo")) % n_folds == 0)
    moves = ranked.join(F.broadcast(to), ["n", "t"]).where(F.col("__i").between(F.col("lo"), F.col("hi") - 1) | turn).select(group, "__to")
    return df.join(moves, group, "left").withColumn(fold, F.coalesce("__to", fold)).drop("__to")


def leaking_groups(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups whose rows stand in more than one fold."""
    return df.groupBy(group).agg(F.sort_array(F.collect_set(fold)).alias("folds"), F.count_distinct(fold).alias("fold_count"), F.count("*").alias("sample_count")).where("fold_count > 1")


def cv_splits(df: DataFrame, fold: str, n_folds: int) -> DataFrame:
    """Each row once for each fold k (`split`): part `eval` where it is in fold k, else `train`; rows without a fold always train."""
    rows = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    return rows.withColumn("part", F.when(F.col(fold) == F.col("split"), "eval").otherwise("train"))


def split(df: DataFrame, fold: str, eval_fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and evaluation rows; rows without a fold train."""
    if fold not in df.columns:
        raise ValueError(f"no column {fold}")
    return df.where(F.coalesce(F.col(fold) != eval_fold, F.lit(True))), df.where(F.col(fold) == eval_fold)

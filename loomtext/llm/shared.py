"""What several operators of this subpackage need: tables, cut lineage, linked groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.batches import carried, column  # noqa: F401  what the operators take from here
from loomtext.sources import scratch

#: Folders made so far within each open passing().
_open: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the one that the cluster shares."""
    path = scratch.new_folder(spark)
    for made in _open:
        made.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and kept in the shared folder; a lost executor takes nothing with it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch.base_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut(), as Parquet: smaller, and read by column."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are stored within go when it ends, but those whose folders are taken out of the list. For work whose result is stored by then."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        remove(spark, made)


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders that shared_dir() named."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def others(names: list[str], *added: str) -> list[str]:
    """Names that none of the added ones replaces; case doesn't tell them apart, as Spark's resolution doesn't."""
    return [c for c in names if c.lower() not in {a.lower() for a in added}]


def held_out(doc_id) -> F.Column:
    """True for rows that nothing is learned from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the links (a, b) can reach, itself included.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so paths halve;
    a round is three joins on the link table, and ends in a checkpoint. Labels are aggregated before they are shuffled,
    so a node with very many links costs one partial minimum a task.
    """
    both = cut(edges.select("a", "b").where("a <> b").distinct().selectExpr("explode(array(struct(a, b), struct(b AS a, a AS b))) AS e").selectExpr("e.a AS a", "e.b AS b"))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        step = labels.join(near, "node").select("node", F.least("component", "low").alias("next"), "component")
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        step = cut(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("component"), F.col("component").alias("before")))
        changed = step.where("component <> before").limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels

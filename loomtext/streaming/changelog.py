"""The change log as a stream: by micro-batches that are kept apart, or with the last record of each key as state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomtext.sources.store import latest, tie
from loomtext.sources.versions import Versions


def follow(log: DataFrame, key: str, seq: str, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's last records below `path`, a folder per batch, so that a repeated batch replaces itself. state() reads them."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, seq).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark, path: str, key: str, seq: str) -> DataFrame:
    """The live records: last of each key over all batches, without tombstones."""
    rows = latest(spark.read.parquet(path).drop("batch"), key, seq)
    return rows.where("NOT coalesce(_deleted, false)").drop("_deleted") if "_deleted" in rows.columns else rows


class LastWriter(StatefulProcessor):
    """Of each key the record with the largest (seq, tie); returns it whenever it changes. Tombstones are records, so what was deleted doesn't come back with a late record."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("seq", LongType()), StructField("tie", LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = max(rows, key=lambda r: (r["seq"], r["tie"]))
        before = self.last.get() if self.last.exists() else None
        if before is None or (best["seq"], best["tie"]) > (before[0], before[1]):
            self.last.update((best["seq"], best["tie"]))
            yield Row(record=best["record"])

    def close(self) -> None:
        pass


def last_writers(log: DataFrame, key: str, seq: str) -> DataFrame:
    """A stream of the records of `log` that become the last of their key, each once, in whatever batches and order they come. State is a key and two numbers."""
    packed = log.where(F.col(key).isNotNull() & F.col(seq).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), tie(log.columns).alias("tie"), F.to_json(F.struct(*log.columns)).alias("record"))
    kept = packed.groupBy("key").transformWithState(statefulProcessor=LastWriter(), outputStructType=StructType([StructField("record", StringType())]), outputMode="Update", timeMode="None")
    return kept.select(F.from_json("record", log.schema).alias("r")).select("r.*")


def follow_keyed(log: DataFrame, key: str, seq: str, table: Versions, copy: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table of last records, and a JSON log of what changed it, up to date with a log: both are written in each batch, and a batch that is repeated after a failure changes neither.

    State needs the RocksDB store, which is set for the session of the log.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{copy}/batch={number}")
        table.commit(batch.sparkSession.read.schema(log.schema).json(f"{copy}/batch={number}"), run=str(number))

    return last_writers(log, key, seq).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

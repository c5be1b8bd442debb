"""A document store over a change log: upserts, tombstones, replay, snapshots, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.sources.readers import jsonl_lenient, write_jsonl, write_summary


def tie(columns: list[str]) -> Column:
    """A number that tells apart records with one seq by what they hold, the same in any layout of the log."""
    return F.xxhash64(F.to_json(F.struct(*columns)))


def latest(log: DataFrame, key: str, seq: str, line: str | None = None) -> DataFrame:
    """The last record of each key. Aggregated, not sorted: a key with very many changes is reduced before the shuffle.

    Of records with one seq that of the last `line` counts (a column, as readers.jsonl_in_order() has it, which is dropped); without one, a hash of
    the record decides, so that the result doesn't depend on how the log is dealt to tasks.
    """
    columns = [c for c in log.columns if c != line]
    others = [c for c in columns if c != seq]
    rows = log.where(F.col(key).isNotNull())
    order = F.struct(F.col(seq), F.col(line) if line else tie(columns))
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in [*others, seq]))


def replay(log: DataFrame, key: str, seq: str, required: str | None = None, parent: str | None = None, compat: bool = False) -> DataFrame:
    """Live records: the last of each key, without tombstones (`_deleted`) and records that lack `required`.

    A tombstone by parent (`_deleted_by_parent`, no key) also deletes the parent's records written before it; `compat`
    ignores such tombstones.
    """
    rows = latest(log, key, seq).where(~F.coalesce("_deleted", F.lit(False)))
    if required:
        rows = rows.where(F.col(required).isNotNull())
    if parent and not compat and "_deleted_by_parent" in log.columns:
        gone = log.where(F.coalesce("_deleted_by_parent", F.lit(False))).groupBy(parent).agg(F.max(seq).alias("__gone"))
        rows = rows.join(gone, parent, "left").where(F.col("__gone").isNull() | (F.col(seq) > F.col("__gone"))).drop("__gone")
    return rows.drop("_deleted", "_deleted_by_parent")


def upserted(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """The base with whole records of the delta in place of those with their keys."""
    return base.join(delta.select(key), key, "left_anti").select(base.columns).unionByName(delta.select(base.columns))


def deleted(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return base.join(ids.select(key), key, "left_anti").select(base.columns)


def deleted_where(base: DataFrame, condition: Column) -> DataFrame:
    return base.where(~F.coalesce(condition, F.lit(False)))


def tombstones(ids: DataFrame, key: str, by_parent: bool = False) -> DataFrame:
    return ids.select(F.col(key), F.lit(True).alias("_deleted_by_parent" if by_parent else "_deleted"))


def write_through(delta: DataFrame, log_path: str, table: str) -> None:
    """To the log first, then to the table (appended; latest() reads it)."""
    write_jsonl(delta, log_path, append=True)
    delta.write.mode("append").saveAsTable(table)


def backup(df: DataFrame, path: str) -> None:
    write_jsonl(df, path)
    write_summary(df, f"{path}.meta", at=F.max(F.current_timestamp()))


def restore(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return jsonl_lenient(spark, path, schema)


def tap(df: DataFrame, path: str, select: list[str] | None = None) -> DataFrame:
    """Appends (part of) the rows to a log and passes them on; a failing log doesn't stop the flow."""
    try:
        write_jsonl(df.select(select) if select else df, path, append=True)
    except Exception as e:  # noqa: BLE001
        print(f"log not written: {e}")
    return df


def with_defaults(df: DataFrame, version: str = "v1", vectors: tuple[str, ...] = ()) -> DataFrame:
    out = df.withColumn("version", F.coalesce("version", F.lit(version)) if "version" in df.columns else F.lit(version))
    return out.withColumns({v: F.coalesce(v, F.array().cast("array<float>")) for v in vectors})


def create(spark: SparkSession, table: str, schema: str, skip_existing: bool = True, location: str | None = None) -> bool:
    """Whether a table was made (with its files at `location`, if given)."""
    if spark.catalog.tableExists(table):
        if not skip_existing:
            raise ValueError(f"{table} exists")
        return False
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet" + (f" LOCATION '{location}'" if location else ""))
    return True


def drop(spark: SparkSession, table: str, confirm: bool = False) -> None:
    if not confirm:
        raise ValueError("dropping a table must be confirmed")
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def status(spark: SparkSession, table: str) -> dict:
    exists = spark.catalog.tableExists(table)
    return {"table": table, "exists": exists, "rows": spark.table(table).count() if exists else 0}

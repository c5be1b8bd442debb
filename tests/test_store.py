"""A versioned store and a keyed stream: ties, tombstones, late records, repeated batches, a restart, restoring and compacting."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.sources import readers, store
from loomtext.sources.versions import Conflict, Versions
from loomtext.streaming import changelog

RECORD = "id long, seq long, value string, _deleted boolean"


def live(rows):
    return sorted((r.id, r.seq, r.value) for r in rows.collect())


def test_equal_seq_has_one_result_in_any_layout(spark, tmp_path):
    rows = [(1, 5, f"v{k}", False) for k in range(20)] + [(2, 1, "a", False), (2, 1, "a", False), (None, 9, "x", False)]
    df = spark.createDataFrame(rows, RECORD)
    results = {tuple(live(store.latest(df.repartition(n).orderBy(F.rand(n)), "id", "seq"))) for n in (1, 3, 7)}
    assert len(results) == 1
    for k in range(3):  # of lines in files the last one wins, as a log is read
        readers.write_jsonl(spark.createDataFrame([(1, 5, f"file{k} line{n}", False) for n in range(50)], RECORD).coalesce(1), f"{tmp_path}/log", append=True)
    assert live(store.latest(readers.jsonl_in_order(spark, f"{tmp_path}/log", RECORD), "id", "seq", "line")) == [(1, 5, "file2 line49")]


def test_versions(spark, tmp_path):
    table = Versions(spark, f"{tmp_path}/t", "id", "seq")
    df = lambda *rows: spark.createDataFrame(list(rows), RECORD)
    with pytest.raises(ValueError):
        table.read()
    assert table.versions() == []
    assert table.commit(df(*((i, 1, "old", False) for i in range(10)))) == 1
    assert table.commit(df((1, 2, "new", False), (2, 2, None, True), (20, 2, "more", False)), run="a") == 2
    assert table.commit(df((3, 9, "again", False)), run="a") == 2  # that run is there
    assert table.commit(df((1, 1, "late", False), (2, 1, "late", False))) == 3
    now = [(0, 1, "old"), (1, 2, "new"), *((i, 1, "old") for i in range(3, 10)), (20, 2, "more")]
    assert live(table.read()) == now and live(table.read(1)) == [(i, 1, "old") for i in range(10)]
    assert table.compact() == 4 and live(table.read()) == now and table.records().where("_deleted").count() == 1 and len(table.manifest()["folders"]) == 1
    table.commit(df((2, 1, "later still", False)))
    assert live(table.read()) == now  # the tombstone is still there
    assert table.compact(horizon=3) == 6 and table.records().where("_deleted").count() == 0
    assert table.restore(1) == 7 and live(table.read()) == [(i, 1, "old") for i in range(10)] and live(table.read(6)) == now
    with pytest.raises(Conflict):
        table._put(table.manifest())
    gone = table.vacuum(keep=1)
    assert table.versions() == [7] and len(gone) == 5 and live(table.read()) == [(i, 1, "old") for i in range(10)]
    with pytest.raises(ValueError):
        table.read(1)


def test_keyed_stream_survives_a_restart_and_late_records(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randint(0, 30), rng.randint(0, 40), f"v{k}", rng.random() < 0.2) for k in range(600)] + [(None, 1, "x", False)]
    rng.shuffle(rows)
    table, schema = Versions(spark, f"{tmp_path}/t", "id", "seq"), spark.createDataFrame([], RECORD).schema
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    for part in range(3):  # each time the stream stops and is started again from its checkpoint
        readers.write_jsonl(spark.createDataFrame(rows[part::3], RECORD).repartition(4), f"{tmp_path}/log", append=True)
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).json(f"{tmp_path}/log")
        changelog.follow_keyed(log, "id", "seq", table, f"{tmp_path}/copy", f"{tmp_path}/progress").awaitTermination()
    assert spark.conf.get("spark.sql.shuffle.partitions") == partitions
    expected = live(store.replay(spark.createDataFrame(rows, RECORD), "id", "seq"))
    assert live(table.read()) == expected and len(table.versions()) == 6
    copy = spark.read.schema(schema).json(f"{tmp_path}/copy").drop("batch")
    assert live(store.replay(copy, "id", "seq")) == expected and copy.count() < len(rows)
    # a batch that is repeated after a failure changes neither
    before = table.versions()
    table.commit(copy.limit(1), run="0")
    assert table.versions() == before

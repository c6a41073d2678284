"""Batch store and manifest: bounded folders, replays, failures."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from liftlake.sources.manifest import Manifest
from liftlake.sources.store import BATCH, BatchStore

SCHEMA = "user_id bigint, day date, item string, value int"
DAY = dt.date(2026, 1, 1)


def folders(path):
    return sorted(os.listdir(f"{path}/data"))


def test_many_batches_leave_few_folders(spark, tmp_path):
    path = str(tmp_path / "s")
    store = BatchStore(spark, path, "k int, v int", ["k"], unique=True, fan=4)
    rng, expected = random.Random(1), {}
    for batch in range(20):
        given = {rng.randrange(30): batch * 100 + i for i in range(5)}
        expected |= given
        assert store.commit(batch, spark.createDataFrame(list(given.items()), "k int, v int").coalesce(1))
        assert len(store.entries()) <= 3 * 3 and sum(e["batches"] for e in store.entries()) == batch + 1
    assert rows(store.read()) == sorted(expected.items(), key=repr)
    # Besides the current folders only those of the version before are kept.
    assert len(folders(path)) <= 2 * 9 and len(os.listdir(f"{path}/manifest")) <= 2 * 3  # and their checksums


@pytest.mark.parametrize("partition_by", [[], ["day"]])
def test_a_batch_replaces_all_rows_of_its_keys(spark, tmp_path, partition_by):
    rng, expected = random.Random(2), {}
    store = BatchStore(spark, str(tmp_path / "s"), SCHEMA, ["user_id", "day"], partition_by=partition_by, fan=3)
    for batch in range(7):
        given = {}
        for _ in range(4):
            key = rng.choice([1, 2, None]), DAY + dt.timedelta(days=rng.randrange(3))
            given[key] = [(*key, f"i{n}", batch) for n in range(rng.randint(1, 3))]
        expected |= given
        store.commit(batch, spark.createDataFrame([r for v in given.values() for r in v], SCHEMA))
        assert rows(store.read()) == sorted((r for v in expected.values() for r in v), key=repr)
    some = store.read(F.col("day") == DAY)
    assert rows(some) == sorted((r for v in expected.values() for r in v if r[1] == DAY), key=repr)
    if partition_by:
        assert "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().executedPlan().toString()


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    store = BatchStore(spark, path, "k int, v int", ["k"], unique=True, fan=2)
    for batch in range(3):
        store.commit(batch, spark.createDataFrame([(1, batch), (batch + 10, batch)], "k int, v int"))
    before, names, version = rows(store.read()), folders(path), store.manifest.versions()
    for batch in (2, 0):
        assert not store.commit(batch, spark.createDataFrame([(1, 99)], "k int, v int"))
    assert (rows(store.read()), folders(path), store.manifest.versions()) == (before, names, version)
    assert rows(BatchStore(spark, path, "k int, v int", ["k"], unique=True).read()) == before


def test_a_failed_batch_is_never_read(spark, tmp_path):
    path = str(tmp_path / "s")
    store = BatchStore(spark, path, "k int, v int", ["k"], unique=True)
    store.commit(0, spark.createDataFrame([(1, 0)], "k int, v int"))
    bad = spark.range(4).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        store.commit(1, bad)
    assert rows(store.read()) == [(1, 0)] and store.last_batch() == 0
    assert store.commit(1, spark.createDataFrame([(2, 1)], "k int, v int"))
    assert rows(store.read()) == [(1, 0), (2, 1)]


def test_an_empty_store(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path / "s"), SCHEMA, ["user_id"])
    assert store.read().count() == 0 and store.last_batch() is None and BATCH not in store.read().columns
    store.commit(-1, spark.createDataFrame([], SCHEMA))
    assert store.read().count() == 0


def test_versions_are_published_in_order(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "m"))
    assert manifest.load() == {} and manifest.versions() == []
    for n in range(4):
        assert manifest.publish({"n": n, "text": "é"}) == n
    assert manifest.load() == {"n": 3, "text": "é"} and manifest.load(2)["n"] == 2
    assert manifest.versions() == [2, 3]

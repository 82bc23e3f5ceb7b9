import random

import pytest
from pyspark.sql import functions as F

from depsignal.sources import versions
from depsignal.sources.versions import ConcurrentCommit, create_versioned, drop_versions, numbers, read_version, upsert_version, version

SCHEMA = "id long, at int, label string, bucket int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    root = str(tmp_path / "t")
    create_versioned(spark, root, frame(spark, []).schema, "id", 4)
    return root


def test_repeated_upserts_equal_a_dictionary(spark, table, rows):
    rng, expected = random.Random(5), {}
    for step in range(5):
        batch = [(rng.choice([None, *range(30)]), rng.randrange(4), f"s{step}-{k}", k) for k in range(rng.choice([0, 3, 40]))]
        newest = {}
        for row in batch:
            if row[0] not in newest or (row[1], row[2]) > (newest[row[0]][1], newest[row[0]][2]):
                newest[row[0]] = row
        expected |= newest
        for _ in range(2):  # once more changes nothing
            upsert_version(spark, table, frame(spark, batch), "at", ("label",))
        assert rows(read_version(spark, table)) == sorted(expected.values(), key=repr)


def test_only_touched_buckets_are_rewritten(spark, table):
    before = upsert_version(spark, table, frame(spark, [(i, 0, "a", 0) for i in range(100)]), "at")
    after = upsert_version(spark, table, frame(spark, [(7, 1, "b", 0)]), "at")
    changed = [b for b in before.folders if after.folders[b] != before.folders[b]]
    assert len(before.folders) == 4 and len(changed) == 1
    assert upsert_version(spark, table, frame(spark, []), "at").number == after.number


def test_old_versions_stay_until_dropped(spark, table, rows):
    upsert_version(spark, table, frame(spark, [(1, 0, "a", 0), (2, 0, "a", 0)]), "at")
    upsert_version(spark, table, frame(spark, [(1, 1, "b", 0)]), "at")
    assert rows(read_version(spark, table, 1)) == [(1, 0, "a", 0), (2, 0, "a", 0)]
    assert drop_versions(spark, table) == 0 or numbers(spark, table) == [2]  # young folders stay
    assert drop_versions(spark, table, grace_hours=0) >= 1
    assert numbers(spark, table) == [2] and version(spark, table, 1) is None
    assert rows(read_version(spark, table)) == [(1, 1, "b", 0), (2, 0, "a", 0)]
    with pytest.raises(ValueError):
        read_version(spark, table, 1)


@pytest.mark.parametrize("step", ["write", "commit"])
def test_a_failure_leaves_the_old_version(spark, table, rows, monkeypatch, step):
    upsert_version(spark, table, frame(spark, [(1, 0, "a", 0)]), "at")
    stop = RuntimeError("lost")

    def fail(*args, **kwargs):
        raise stop

    with monkeypatch.context() as patch:
        patch.setattr(versions, "_commit" if step == "commit" else "materialize_once", fail)
        with pytest.raises(RuntimeError, match="lost"):
            upsert_version(spark, table, frame(spark, [(1, 1, "b", 0), (2, 1, "b", 0)]), "at")
    assert rows(read_version(spark, table)) == [(1, 0, "a", 0)] and numbers(spark, table) == [0, 1]
    upsert_version(spark, table, frame(spark, [(1, 1, "b", 0)]), "at")
    assert rows(read_version(spark, table)) == [(1, 1, "b", 0)]
    # what the failed run wrote goes with the unused folders
    drop_versions(spark, table, grace_hours=0)
    left = spark.read.schema(SCHEMA).parquet(table + "/data").count()
    assert left == 1


def test_a_faster_writer_is_not_overwritten(spark, table, rows, monkeypatch):
    other = frame(spark, [(1, 5, "other", 0)])
    commit, raced = versions._commit, []

    def race(s, root, new):
        if not raced:
            raced.append(True)
            upsert_version(s, root, other, "at")
        commit(s, root, new)

    monkeypatch.setattr(versions, "_commit", race)
    upsert_version(spark, table, frame(spark, [(2, 1, "mine", 0)]), "at")
    assert rows(read_version(spark, table)) == [(1, 5, "other", 0), (2, 1, "mine", 0)]
    with pytest.raises(ConcurrentCommit):
        commit(spark, table, version(spark, table, 0))
    raced.clear()
    with pytest.raises(ConcurrentCommit):
        upsert_version(spark, table, frame(spark, [(3, 1, "late", 0)]), "at", attempts=1)


def test_one_key_of_a_third_of_all_rows(spark, table):
    hot = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("id"), F.col("id").cast("int").alias("at"), F.lit("x").alias("label"), F.lit(0).alias("bucket")
    )
    upsert_version(spark, table, hot, "at")
    assert read_version(spark, table).count() == 20_000

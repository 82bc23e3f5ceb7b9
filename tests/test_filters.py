import pytest
from pyspark.sql import functions as F

from depsignal import schemas
from depsignal.checks import tables as t
from depsignal.operators.silver import dedup_latest
from depsignal.plans.ingestion import start_silver
from depsignal.sources import filters
from depsignal.sources.events import append_silver, days_of
from depsignal.sources.filters import Merged, candidates, key_filters, merge_filtered, read_filters, write_filters
from depsignal.sources.tables import materialize_once

SF = "/root/testdata/sf0.001"


@pytest.fixture
def target(spark, tmp_path):
    path = str(tmp_path / "silver")
    start_silver(t.first_delivery(spark, SF), path)
    return path


def stored(spark, path):
    return spark.read.schema(schemas.SILVER).parquet(path)


def test_merge_equals_the_deduplicated_batch(spark, target, rows):
    batch = materialize_once(t.silver_events(spark, SF))
    night = F.hour("created_at") < 6
    for part in (batch.filter(night), batch, batch.filter(~night)):
        merge_filtered(spark, target, materialize_once(part))
    columns = ["event_id", "event_type", "repo_full_name", "event_date"]
    assert rows(stored(spark, target), *columns) == rows(dedup_latest(batch), *columns)


def test_new_ids_read_no_files_and_known_ones_only_their_own(spark, target):
    batch = materialize_once(dedup_latest(t.first_delivery(spark, SF)))
    day = batch.filter("event_date = DATE'2024-01-05'")
    morning, evening = (materialize_once(day.filter(c)) for c in ("hour(created_at) < 12", "hour(created_at) >= 12"))
    first = merge_filtered(spark, target, morning)
    assert (first.read, first.inserted) == (first.files, morning.count())
    second = merge_filtered(spark, target, evening)
    assert second.files > 0 and second.read == 0 and second.inserted == evening.count()
    # other ids in hours that are there already
    other = materialize_once(morning.withColumn("event_id", F.sha2("event_id", 256)))
    third = merge_filtered(spark, target, other)
    assert third.read == 0 and third.inserted == other.count()
    again = merge_filtered(spark, target, materialize_once(evening.limit(1)))
    assert again.read == 1 < again.files and again.inserted == 0
    assert stored(spark, target).count() == day.count() + other.count()


def test_files_without_filters_are_read(spark, target):
    batch = materialize_once(dedup_latest(t.first_delivery(spark, SF)))
    append_silver(batch, target)  # a run that stopped before the filters
    done = merge_filtered(spark, target, batch)
    assert done.read == done.files > 0 and done.inserted == 0
    assert merge_filtered(spark, target, batch).inserted == 0 and write_filters(spark, target, days_of(batch)) == 0


def test_wrong_hits_only_cost_reading(spark, target, monkeypatch):
    batch = materialize_once(dedup_latest(t.first_delivery(spark, SF)))
    half = materialize_once(batch.filter("xxhash64(event_id) % 2 = 0"))
    merge_filtered(spark, target, half)
    monkeypatch.setattr(filters, "_hit", lambda *_: F.lit(True))
    done = merge_filtered(spark, target, batch)
    assert done.read > 0 and done.inserted == batch.count() - half.count()


def test_filters_hold_every_key_and_few_others(spark, target, monkeypatch):
    monkeypatch.setattr(filters, "KEYS", 50)
    batch = materialize_once(dedup_latest(t.first_delivery(spark, SF)))
    append_silver(batch, target)
    found = materialize_once(key_filters(stored(spark, target)))
    assert found.agg(F.sum("n")).first()[0] == batch.count() and found.agg(F.max("n")).first()[0] <= 50
    one = batch.limit(1)
    assert candidates(one, found).count() >= 1
    strangers = batch.withColumn("event_id", F.sha2("event_id", 256))
    assert candidates(strangers, found).count() == 0


def test_empty_batch(spark, target):
    none = materialize_once(t.first_delivery(spark, SF).limit(0))
    assert merge_filtered(spark, target, none) == Merged(0, 0, 0, 0) and read_filters(spark, target).count() == 0

from depsignal import schemas
from depsignal.checks import tables as t
from depsignal.operators import ingest, silver
from depsignal.plans.ingestion import start_silver
from depsignal.streaming import events as streams
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def write(spark, path, half=None):
    rows = t.bronze(spark, SF).drop("value")
    if half is not None:
        early = F.col("created_at") < "2024-01-16"
        rows = rows.filter(early if half == 0 else ~early)
    rows.write.mode("append").json(path)


def test_every_file_once(spark, tmp_path):
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "cp"))
    write(spark, source, 0)

    def run():
        stream = streams.stream_events(spark, source, 1)
        streams.run_available(stream, sink, progress).awaitTermination()
        return spark.read.schema(schemas.BRONZE).parquet(sink).count()

    first = run()
    assert run() == first
    write(spark, source, 1)
    assert run() == t.bronze(spark, SF).count()


def test_bad_lines_are_skipped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "1", "type": "PushEvent"}\n{"id": "2", "ty\n\nnot json\n{"id": "3"}\n')
    stream = streams.stream_events(spark, str(tmp_path / "in"))
    streams.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    stored = spark.read.schema(schemas.BRONZE).parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in stored.collect()) == ["1", "3"]


def test_insert_only_stream_keeps_late_events(spark, tmp_path, rows):
    source, target, progress = (str(tmp_path / n) for n in ("in", "silver", "cp"))
    batch = t.first_delivery(spark, SF)
    start_silver(batch, target)
    for half in (1, 0, 1):  # the later half comes first, and once more at the end
        write(spark, source, half)
        stream = streams.stream_events(spark, source)
        streams.stream_insert_only(stream, target, progress).awaitTermination()
    stored = spark.read.schema(schemas.SILVER).parquet(target)
    columns = ["event_id", "event_type", "repo_full_name", "payload_commits"]
    assert rows(stored, *columns) == rows(silver.dedup_latest(batch), *columns)


def test_hour_counts_keep_late_events_and_the_last_hour(spark, tmp_path, rows):
    source, store, progress = (str(tmp_path / n) for n in ("in", "counts", "cp"))
    projects = t.curated(spark, SF)
    for half in (1, 0):
        write(spark, source, half)
        streams.stream_hour_counts(streams.stream_events(spark, source), store, progress).awaitTermination()
    batch = ingest.ingest_hour_stats(t.bronze(spark, SF), projects)
    assert rows(streams.stored_hour_stats(spark, store, projects), *batch.columns) == rows(batch)


def test_a_repeated_batch_counts_once(spark, tmp_path, rows):
    source, store = str(tmp_path / "in"), str(tmp_path / "counts")
    projects = t.curated(spark, SF)
    write(spark, source)
    for progress in ("first", "lost"):  # without its progress the stream counts the same batch again
        stream = streams.stream_events(spark, source)
        streams.stream_hour_counts(stream, store, str(tmp_path / progress)).awaitTermination()
    batch = ingest.ingest_hour_stats(t.bronze(spark, SF), projects)
    assert rows(streams.stored_hour_stats(spark, store, projects), *batch.columns) == rows(batch)


def test_insert_once_keeps_late_events_and_drops_copies_in_its_state(spark, tmp_path, rows):
    source, target, progress = (str(tmp_path / n) for n in ("in", "silver", "cp"))
    batch = t.first_delivery(spark, SF)
    start_silver(batch, target)
    merged, done = [], []
    for half in (1, 0, 1, 0):  # the later half comes first, and both once more
        done.append(len(merged))
        write(spark, source, half)
        query = streams.stream_insert_once(streams.stream_events(spark, source), target, progress, "1 day", merged=merged)
        query.awaitTermination()
    stored = spark.read.schema(schemas.SILVER).parquet(target)
    columns = ["event_id", "event_type", "repo_full_name", "payload_commits"]
    assert rows(stored, *columns) == rows(silver.dedup_latest(batch), *columns)
    # no copy came as far as the merge
    assert sum(m.sent for m in merged[: done[2]]) >= stored.count()
    assert sum(m.sent for m in merged[done[2] :]) == 0 and sum(m.read for m in merged[done[2] :]) == 0


def test_state_of_insert_once_is_bounded_by_the_watermark(spark, tmp_path, rows):
    source, target, progress = (str(tmp_path / n) for n in ("in", "silver", "cp"))
    batch = t.first_delivery(spark, SF)
    start_silver(batch, target)
    kept, merged, done = [], [], []
    # arrivals run forward whatever the events' own time; each run is an hour after the one before
    for hour, half in enumerate((1, 0, 1)):
        done.append(len(merged))
        write(spark, source, half)
        at = F.lit(f"2024-03-01 0{hour}:00:00").cast("timestamp")
        query = streams.stream_insert_once(streams.stream_events(spark, source), target, progress, "10 minutes", arrived=at, merged=merged)
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    first, second = (t.bronze(spark, SF).filter(c).count() for c in ("created_at >= '2024-01-16'", "created_at < '2024-01-16'"))
    # what an earlier run left is gone, so no state holds both halves
    assert max(kept) <= max(first, second) and kept[0] > 0
    columns = ["event_id", "event_type", "repo_full_name", "payload_commits"]
    stored = spark.read.schema(schemas.SILVER).parquet(target)
    assert rows(stored, *columns) == rows(silver.dedup_latest(batch), *columns)
    # the copies of the third run were out of the state and were found by the merge
    last = merged[done[2] :]
    assert sum(m.sent for m in last) > 0 and sum(m.inserted for m in last) == 0 and sum(m.read for m in last) > 0


def test_two_streams_of_other_files_do_not_replace_each_other(spark, tmp_path, rows):
    store, projects = str(tmp_path / "counts"), t.curated(spark, SF)
    for half in (0, 1):  # both begin with batch 0
        source = str(tmp_path / f"in{half}")
        write(spark, source, half)
        stream = streams.stream_events(spark, source)
        streams.stream_hour_counts(stream, store, str(tmp_path / f"cp{half}")).awaitTermination()
    batch = ingest.ingest_hour_stats(t.bronze(spark, SF), projects)
    assert rows(streams.stored_hour_stats(spark, store, projects), *batch.columns) == rows(batch)


def test_closed_hours_are_written_once(spark, tmp_path, rows):
    source, sink, progress = (str(tmp_path / n) for n in ("in", "closed", "cp"))
    seen = []
    for half in (0, 1, 1):  # in the order of time, and the later half again when its hours are closed
        write(spark, source, half)
        streams.stream_tumbling_hours(streams.stream_events(spark, source), sink, progress).awaitTermination()
        found = spark.read.parquet(sink)
        assert found.groupBy("date", "hour", "repo").count().filter("count > 1").count() == 0
        seen.append(rows(found))
    last = t.bronze(spark, SF).agg(F.max(silver.event_time("created_at"))).first()[0]
    whole = ingest.repo_hour_counts(t.bronze(spark, SF)).filter(
        F.expr("make_timestamp(year(date), month(date), day(date), hour, 0, 0) + INTERVAL 3 HOURS") <= F.lit(last)
    )
    assert seen[1] == rows(whole) and set(seen[0]) <= set(seen[1])
    # hours that were still open took the repeated events in; closed ones did not
    assert set(seen[1]) <= set(seen[2])

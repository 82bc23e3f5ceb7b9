import datetime
import gzip
import hashlib
import json

from depsignal import schemas
from depsignal.operators import silver
from depsignal.plans.ingestion import load_silver, start_silver
from depsignal.sources import events
from pyspark.sql import functions as F


def event(**changes):
    base = {
        "id": "1",
        "type": "PushEvent",
        "actor": {"id": 7, "login": "ann"},
        "repo": {"id": 9, "name": "o/r"},
        "payload": {"commits": [{"sha": "a"}, {"sha": "b"}]},
        "public": True,
        "created_at": "2024-03-01T10:00:00Z",
        "ignored": 1,
    }
    base.update(changes)
    return {k: v for k, v in base.items() if v is not None}


EVENTS = [
    event(),
    event(payload={"commits": []}, created_at="2024-03-01T11:00:00Z"),
    event(payload={"action": "x"}, created_at="2024-03-01T12:00:00Z"),
    event(actor=None, created_at="2024-03-02T10:00:00Z"),
    event(repo=None),
    event(repo={"id": 1, "name": "noslash"}, created_at="2024-03-02T11:00:00Z"),
    event(created_at="2024-03-01 10:00"),
    event(type="CreateEvent"),
    event(),
]


def write(path, lines):
    with gzip.open(path, "wt") as f:
        f.write("\n".join(lines) + "\n")


def raw(spark, tmp_path, extra=()):
    file = tmp_path / "in.json.gz"
    write(file, [json.dumps(e) for e in EVENTS] + list(extra))
    return events.read_events(spark, str(file))


def test_corrupt_and_blank_lines(spark, tmp_path):
    df = raw(spark, tmp_path, ["", '{"id": "2", "type":', "   "])
    clean, bad = events.split_corrupt(df)
    assert clean.count() == len(EVENTS)
    assert schemas.CORRUPT not in clean.columns
    assert bad.count() == 1
    assert [r[0] for r in events.corrupt_sample(bad).collect()] == ['{"id": "2", "type":']


def test_to_silver(spark, tmp_path, rows):
    clean, _ = events.split_corrupt(raw(spark, tmp_path))
    got = silver.bronze_to_silver(clean)
    assert got.columns == schemas.SILVER_COLUMNS
    assert rows(got, F.date_format("created_at", "dd HH"), "payload_commits", "actor_login") == sorted(
        [
            ("01 10", 2, "ann"),
            ("01 10", 2, "ann"),
            ("01 11", 0, "ann"),
            ("01 12", None, "ann"),
            ("02 10", 2, None),
            ("02 11", 2, "ann"),
        ],
        key=repr,
    )
    key = hashlib.sha256(b"PushEvent|ann|o/r|2024-03-01T10:00:00Z").hexdigest()
    assert got.filter(F.col("event_id") == key).count() == 2
    no_actor = hashlib.sha256(b"PushEvent|o/r|2024-03-02T10:00:00Z").hexdigest()
    assert got.filter(F.col("event_id") == no_actor).count() == 1
    assert rows(got.filter("repo_full_name = 'noslash'"), "org_name", "repo_name") == [
        ("noslash", None)
    ]


def test_require_keys(spark):
    df = spark.createDataFrame(
        [("a", "r", "d"), (None, "r", "d"), ("b", None, "d"), ("c", "r", None)],
        "event_id string, repo_full_name string, event_date string",
    )
    assert [r[0] for r in silver.require_keys(df).collect()] == ["a"]


def test_dedup_takes_newest_and_limits_before_the_shuffle(spark, rows):
    df = spark.createDataFrame(
        [("k", 1, "a", 1), ("k", 3, "b", None), ("k", 3, "c", 1), ("k", None, "z", 9), ("l", 1, None, 0)],
        "event_id string, ingested_at int, payload_action string, payload_commits int",
    ).withColumns({"actor_id": F.lit(7), "repo_id": F.lit(8)})
    got = silver.dedup_latest(df)
    assert rows(got, "event_id", "payload_action") == [("k", "c"), ("l", None)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_type_filter_before_dedup_is_equivalent(spark, rows):
    df = spark.createDataFrame(
        [("p1", "PushEvent", 1), ("p1", "PushEvent", 2), ("i1", "IssuesEvent", 1)],
        "event_id string, event_type string, ingested_at int",
    ).withColumns({c: F.lit(None) for c in silver.TIES})
    early = silver.staged_events(df, ["PushEvent"])
    late = silver.staged_events(df).filter("event_type = 'PushEvent'")
    assert rows(early) == rows(late)


def test_watchlist_filter(spark, tmp_path):
    clean, _ = events.split_corrupt(raw(spark, tmp_path))
    projects = spark.createDataFrame([("o", "r"), ("o", "r"), ("p", "q")], "org string, repo string")
    assert silver.filter_watchlist(clean, projects).count() == 7


def test_load_is_idempotent(spark, tmp_path):
    a, b = tmp_path / "a.json.gz", tmp_path / "b.json.gz"
    write(a, [json.dumps(e) for e in EVENTS])
    write(b, [json.dumps(event()), json.dumps(event(created_at="2024-03-05T10:00:00Z"))])
    target = str(tmp_path / "silver")
    empty = silver.bronze_to_silver(events.split_corrupt(events.read_events(spark, str(a)))[0])
    start_silver(empty, target)

    def stored():
        return spark.read.schema(schemas.SILVER).parquet(target)

    load_silver(spark, str(a), target)
    assert stored().count() == 5
    load_silver(spark, str(a), target)
    assert stored().count() == 5
    load_silver(spark, [str(a), str(b)], target)
    assert stored().count() == 6
    days = events.select_days(stored(), "2024-03-02", "2024-03-05")
    assert days.count() == 3
    assert events.select_days(stored(), "2024-03-02", None).count() == 6
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_merge_keeps_batch_copies_only_on_request(spark):
    schema = "event_id string, ingested_at int, actor_id long, payload_action string, payload_commits int, repo_id long"
    none = (None,) * 4
    target = spark.createDataFrame([("a", 1, *none)], schema)
    incoming = spark.createDataFrame([("a", 2, *none), ("b", 1, *none), ("b", 2, *none)], schema)
    assert events.merge_insert_only(target, incoming).count() == 1
    assert events.merge_insert_only(target, incoming, dedup=False).count() == 2
    after = target.unionByName(events.merge_insert_only(target, incoming))
    stats = events.merge_stats(target, incoming, after).first().asDict()
    assert stats == {
        "rows_before": 1,
        "rows_incoming": 3,
        "rows_after": 2,
        "rows_added": 1,
        "rows_duplicate": 2,
    }


def test_bronze_layout(spark, tmp_path):
    clean, _ = events.split_corrupt(raw(spark, tmp_path))
    path = tmp_path / "out"
    events.write_bronze(clean.filter("repo.name = 'o/r'"), str(path))
    assert (path / "org_name=o" / "repo_name=r" / "date=2024-03-01" / "hour=11").is_dir()
    assert list(path.glob("**/*.json.gz"))


def test_create_silver(spark, tmp_path):
    table = events.create_silver(spark, "t_silver", str(tmp_path / "t"), recreate=True)
    assert table.schema["event_date"].dataType.simpleString() == "date"
    assert table.columns[-1] == "event_date"
    assert events.create_silver(spark, "t_silver").count() == 0
    spark.sql("DROP TABLE t_silver")


def test_days_of(spark):
    df = spark.sql("SELECT explode(array(date'2024-01-03', date'2024-01-01')) AS event_date")
    assert events.days_of(df) == [datetime.date(2024, 1, 1), datetime.date(2024, 1, 3)]


def test_merge_shuffles_the_batch_once(spark, tmp_path):
    from depsignal import schemas
    from depsignal.sources import events

    path, days = str(tmp_path / "silver"), [datetime.date(2024, 1, 1)]
    spark.createDataFrame([], schemas.SILVER).write.parquet(path)
    stored = spark.read.schema(schemas.SILVER).parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = events.merge_insert_only(stored, stored, days=days)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2

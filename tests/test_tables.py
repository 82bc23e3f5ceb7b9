from types import SimpleNamespace

import pytest
from depsignal import schemas
from depsignal.operators import quality
from depsignal.plans.gold import build_gold, score_table
from depsignal.session import scratch_path
from depsignal.sources import events, tables
from pyspark.sql import functions as F

from depsignal.checks import tables as t

SF = "/root/testdata/sf0.001"


class Session:
    """Just enough of a session to choose a scratch folder."""

    def __init__(self, master, **conf):
        self.values = {k.replace("_", "."): v for k, v in conf.items()}
        self.conf = self
        self.sparkContext = SimpleNamespace(master=master)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


def test_scratch_follows_the_session(tmp_path):
    cluster = Session("spark://host:7077", spark_checkpoint_dir="/shared/cp/")
    a, b = scratch_path(cluster, "x"), scratch_path(cluster, "x")
    assert a.startswith("/shared/cp/x-") and a != b
    local = Session("local[8]")
    assert scratch_path(local, "x").rsplit("/", 1)[0] == scratch_path(local, "y").rsplit("/", 1)[0]
    with pytest.raises(RuntimeError):
        scratch_path(Session("yarn"), "x")


def test_materialize_once_uses_the_scratch_folder(spark):
    df = tables.materialize_once(spark.range(5))
    assert df.count() == 5
    assert scratch_path(spark, "").rsplit("/", 1)[0] in df.inputFiles()[0]


def test_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "failed")], "repo_full_name string, error string")
    got = tables.overwrite_table(df, "t_card", str(tmp_path / "card"))
    assert [tuple(r) for r in got.collect()] == [("a",)]
    # the table may be read while it is replaced
    again = tables.overwrite_table(spark.table("t_card").withColumn("x", F.lit(1)), "t_card", str(tmp_path / "card"))
    assert again.columns == ["repo_full_name", "x"]
    with pytest.raises(ValueError):
        tables.overwrite_table(df.filter("error IS NOT NULL"), "t_card")
    assert spark.table("t_card").count() == 1
    spark.sql("DROP TABLE t_card")


def test_export(spark, tmp_path):
    scored = t.scored(spark, SF)
    tables.export_csv(scored, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == schemas.EXPORT_COLUMNS
    assert back.count() == scored.count()


def test_models(spark, tmp_path, rows):
    silver, cards = t.silver_events(spark, SF), t.cards(spark, SF)
    built = build_gold(spark, silver, cards, str(tmp_path))
    assert built[0] == "stg_events" and built[-1] == "gold_health_scores" and len(built) == 9
    kinds = {r.name: r.tableType for r in spark.catalog.listTables() if r.name in built}
    assert kinds["stg_events"] == "TEMPORARY" and kinds["gold_health_scores"] != "TEMPORARY"
    assert build_gold(spark, silver, cards, str(tmp_path), ["int_security"]) == ["int_security"]
    with pytest.raises(ValueError):
        build_gold(spark, silver, cards, str(tmp_path), ["nothing"])
    columns = ["repo_full_name", *schemas.SIGNALS]
    assert rows(spark.table("gold_health_scores"), *columns) == rows(score_table(silver, cards), *columns)
    for name in ("gold_project_health", "gold_health_scores"):
        spark.sql(f"DROP TABLE {name}")


def test_stored_and_derived_rollups_agree(spark, rows):
    assert rows(t.health(spark, SF)) == rows(t.health(spark, SF, stage=None))


def test_upsert_table_breaks_ties_and_can_be_repeated(spark, rows):
    spark.sql("DROP TABLE IF EXISTS t_upsert")
    old = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "id int, version int, label string")
    tables.upsert_table(spark, "t_upsert", old, "id", "version")
    new = spark.createDataFrame([(2, 1, "x"), (2, 1, "y"), (3, None, "z")], "id int, version int, label string")
    for _ in range(2):
        got = tables.upsert_table(spark, "t_upsert", new, "id", "version", ("label",))
    assert rows(got) == [(1, 0, "a"), (2, 1, "y"), (3, None, "z")]
    spark.sql("DROP TABLE t_upsert")


def test_merge_reads_the_days_of_the_batch_only(spark, tmp_path):
    path = str(tmp_path / "silver")
    stored = t.first_delivery(spark, SF)
    events.append_silver(stored, path)
    far = stored.filter("event_date IN (DATE'2024-01-02', DATE'2024-01-27')")
    target = spark.read.schema(schemas.SILVER).parquet(path)
    merged = events.merge_insert_only(target, far, days=events.days_of(far))
    assert merged.count() == 0
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_date" in plan.split("PartitionFilters")[1]


def test_unique_ignores_nulls(spark, rows):
    df = spark.createDataFrame([(None,), (None,), (1,), (2,), (2,)], "k int")
    assert rows(quality.check_unique(df, "k")) == [(2, 2)]


def test_recreated_table_is_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        table = events.create_silver(spark, "t_again", path, recreate=True)
        assert table.count() == 0
        t.first_delivery(spark, SF).select(table.columns).write.insertInto("t_again")
    assert spark.table("t_again").count() == t.first_delivery(spark, SF).count()
    spark.sql("DROP TABLE t_again")

import datetime
import random

import pytest
from pyspark.sql import functions as F

from depsignal.checks import tables as t
from depsignal.operators import history
from depsignal.operators.metrics import daily_activity
from depsignal.plans import gold, rolling
from depsignal.sources.events import days_of

SF = "/root/testdata/sf0.001"
DAY = datetime.date(2024, 1, 1)


def expected(snapshots):
    out, last = [], {}
    for day in sorted(snapshots):
        for repo, score in snapshots[day].items():
            before = last.get(repo, (None,))[0]
            trend = None if before is None or score is None else round(score - before, 2)
            out.append((day, repo, score, before, trend))
            last[repo] = (score,)
    return sorted(out, key=repr)


def test_any_order_of_snapshots_equals_the_window(spark, tmp_path, rows):
    rng, root = random.Random(8), str(tmp_path)
    history.start_history(spark, root, 2)
    assert history.read_history(spark, root).count() == 0
    snapshots = {}
    # new, late and repeated ones; repositories come, go, return and lose their score
    for step in (4, 6, 5, 1, 9, 5, 4, 9, 7):
        day = DAY + datetime.timedelta(days=step)
        snapshots[day] = {f"r{k}": rng.choice([1.0, 1.0, 2.5, None]) for k in range(6) if rng.random() < 0.75}
        frame = spark.createDataFrame(list(snapshots[day].items()), "repo_full_name string, health_score double")
        history.record_snapshot(spark, root, frame, day)
        assert rows(history.read_history(spark, root)) == expected(snapshots)


def test_an_unchanged_snapshot_writes_nothing(spark, tmp_path):
    root = str(tmp_path)
    history.start_history(spark, root, 2)
    scores = spark.range(20).select(F.concat(F.lit("r"), "id").alias("repo_full_name"), (F.col("id") / 2).alias("health_score"))
    assert history.record_snapshot(spark, root, scores, DAY) == 20
    assert history.record_snapshot(spark, root, scores, DAY + datetime.timedelta(days=2)) == 0
    assert history.record_snapshot(spark, root, scores, DAY + datetime.timedelta(days=1)) == 0
    changed = scores.withColumn("health_score", F.when(F.col("repo_full_name") == "r3", 9.0).otherwise(F.col("health_score")))
    assert history.record_snapshot(spark, root, changed, DAY + datetime.timedelta(days=3)) == 2
    assert history.read_runs(spark, root).count() == 21 and history.read_history(spark, root).count() == 80


@pytest.fixture(scope="module")
def daily(spark, tmp_path_factory):
    store, silver = str(tmp_path_factory.mktemp("daily") / "d"), t.silver_events(spark, SF)
    gold.refresh_daily(silver, store, days_of(silver))
    return store


def test_rolling_scores_equal_those_of_the_window(spark, daily, tmp_path, rows):
    root, at = str(tmp_path), F.lit(t.COMPUTED_AT).cast("timestamp")
    cards, silver = t.cards(spark, SF), t.staged(spark, SF)
    how = []
    for k in range(3, 9):
        day = DAY + datetime.timedelta(days=k)
        how.append(rolling.roll(spark, daily, root, day, 3))
        part = silver.filter(F.col("event_date").between(F.lit(day - datetime.timedelta(days=2)), F.lit(day)))
        wanted = gold.health_scores(gold.health_from_daily(daily_activity(part), cards, computed_at=at))
        assert rows(rolling.rolling_scores(spark, root, day, cards, at)) == rows(wanted)
    assert how == ["whole"] + ["step"] * 5
    assert rolling.roll(spark, daily, root, day, 3) == "there"
    # a day that changed: its states go, and the next one is made from what is left
    rolling.forget_from(spark, root, day, day)
    with pytest.raises(ValueError):
        rolling.rolling_scores(spark, root, day, cards, at)
    assert rolling.roll(spark, daily, root, day, 3) == "step"


def test_empty_days(spark, daily, tmp_path):
    day, root = datetime.date(2030, 1, 1), str(tmp_path)
    assert rolling.roll(spark, daily, root, day, 3) == "whole"
    assert rolling.rolling_scores(spark, root, day, t.cards(spark, SF)).count() == 0

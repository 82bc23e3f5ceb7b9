"""One hot key with a third of all rows, against a plain Python run of the rules."""

import random
from collections import Counter, defaultdict

from depsignal.operators import ingest, metrics, silver
from pyspark.sql import functions as F


def test_hot_event_and_hot_repository(spark):
    rng = random.Random(11)
    ids = ["hot" if rng.random() < 1 / 3 else f"e{rng.randrange(4000)}" for _ in range(6000)]
    repo_of = {i: "o/hot" if i == "hot" or rng.random() < 1 / 3 else f"o/r{rng.randrange(50)}" for i in set(ids)}
    actor_of = {i: None if rng.random() < 0.1 else f"u{rng.randrange(40)}" for i in set(ids)}
    rows = [
        (i, "PushEvent", actor_of[i], repo_of[i], "o", repo_of[i][2:], None, rng.randrange(5), rng.randrange(100))
        for i in ids
    ]
    df = spark.createDataFrame(
        rows,
        "event_id string, event_type string, actor_login string, repo_full_name string, org_name string,"
        " repo_name string, payload_action string, payload_commits int, ingested_at int",
    ).withColumn("event_date", F.lit("2024-01-01").cast("date")).repartition(8)

    best = {}
    for r in rows:
        best[r[0]] = max(best.get(r[0], (-1, -1)), (r[8], r[7]))
    unique = silver.dedup_latest(df.withColumns({"actor_id": F.lit(1), "repo_id": F.lit(1)}))
    assert {r.event_id: (r.ingested_at, r.payload_commits) for r in unique.collect()} == best

    per_actor = defaultdict(Counter)
    for i, (_, commits) in best.items():
        per_actor[repo_of[i]][actor_of[i]] += commits
    got = {r.repo_full_name: r for r in metrics.contributor_diversity(unique).collect()}
    assert set(got) == set(per_actor)
    for repo, actors in per_actor.items():
        assert got[repo].total_commits == sum(actors.values())
        assert got[repo].contributor_count == len(set(actors) - {None})
        assert got[repo].top3_commits == sum(sorted(actors.values(), reverse=True)[:3])


def test_hot_repository_is_one_row_per_hour_in_the_watchlist_join(spark):
    raw = spark.range(3000).select(
        F.lit("2024-01-01T05:00:00Z").alias("created_at"),
        F.struct(F.when(F.col("id") < 2000, "o/hot").otherwise(F.concat(F.lit("o/r"), F.col("id"))).alias("name")).alias("repo"),
    )
    watch = spark.createDataFrame([("o", "hot"), ("o", "hot"), ("o", "r2500")], "org string, repo string")
    (r,) = ingest.ingest_hour_stats(raw, watch).collect()
    assert (r.hour, r.events_downloaded, r.events_filtered, r.projects_with_events) == (5, 3000, 2001, 2)

import datetime

import pytest
from depsignal.operators import metrics, scorecard, scoring
from pyspark.sql import functions as F

DAY = datetime.date(2024, 1, 1)
SCHEMA = (
    "repo_full_name string, org_name string, repo_name string, event_type string, actor_login string,"
    " payload_action string, payload_commits int, event_date date"
)


def ev(repo, kind, actor="a", action=None, commits=None, day=0):
    org, name = repo.split("/")
    return (repo, org, name, kind, actor, action, commits, DAY + datetime.timedelta(days=day))


@pytest.fixture(scope="module")
def events(spark):
    push, issue, pr = "PushEvent", "IssuesEvent", "PullRequestEvent"
    data = [
        ev("o/p", push, "a", commits=5),
        ev("o/p", push, "b", commits=None),
        ev("o/p", push, None, commits=4, day=1),
        ev("o/p", push, "c", commits=1, day=1),
        ev("o/p", push, "d", commits=0, day=2),
        ev("o/p", issue, action="opened"),
        ev("o/p", issue, action="labeled"),
        ev("o/star", "WatchEvent"),
        ev("o/zero", push, "a", commits=0),
        ev("o/closedonly", issue, action="closed"),
        ev("o/nullaction", pr, action=None),
    ]
    data += [ev("o/backlog", issue, action="opened")] * 10 + [ev("o/backlog", issue, action="closed")]
    data += [ev("o/fast", issue, action="opened")] + [ev("o/fast", issue, action="closed", day=1)] * 2
    data += [ev("o/fast", pr, action="opened")] * 3 + [ev("o/fast", pr, action="closed", day=1)]
    data += [ev("o/ties", push, str(i), commits=2) for i in range(5)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def card(spark):
    data = [("o/p", True, True, None, False, True, 3, True, True), ("x/none", True, True, True, True, True, 0, True, True)]
    return spark.createDataFrame(
        data,
        "repo_full_name string, is_maintained boolean, has_license boolean, is_branch_protected boolean,"
        " requires_code_review boolean, has_security_policy boolean, vuln_count int,"
        " vuln_data_available boolean, has_dep_update_tool boolean",
    )


def test_commit_activity(events):
    got = {r.repo_full_name: r for r in metrics.commit_activity(events).collect()}
    p = got["o/p"]
    assert (p.push_event_count, p.total_commits, p.active_committers, p.active_days) == (5, 11, 4, 3)
    assert p.commits_per_week == 25.67
    assert got["o/zero"].commits_per_week == 0.0
    assert "o/star" not in got


def test_issue_health(events):
    got = {r.repo_full_name: r.issue_resolution_rate for r in metrics.issue_health(events).collect()}
    assert got == {"o/p": 0.0, "o/closedonly": None, "o/backlog": 0.3333, "o/fast": 2.0}


def test_pr_health(events):
    (r,) = metrics.pr_health(events).collect()
    assert (r.prs_opened, r.prs_closed, r.active_days) == (3, 1, 2)
    assert (r.prs_closed_per_week, r.pr_merge_rate) == (3.5, 0.3333)


def test_contributor_diversity(events):
    got = {r.repo_full_name: r for r in metrics.contributor_diversity(events).collect()}
    # the unknown actor is no contributor, yet its commits count and may lead
    assert got["o/p"].contributor_count == 4
    assert got["o/p"].top3_commits == 10
    assert got["o/p"].bus_factor_risk == 0.9091
    assert got["o/zero"].bus_factor_risk is None
    assert got["o/ties"].top3_commits == 6


def test_fused_health_equals_joined_metrics(events, card, rows):
    """The one-pass roll-up gives what six separately grouped views give."""
    fused = metrics.project_health(events, card).drop("computed_at")
    joined = metrics.repo_span(events)
    for view, columns in (
        (metrics.commit_activity(events), ["push_event_count", "total_commits", "active_committers", "active_days", "commits_per_week"]),
        (metrics.issue_health(events), ["issues_opened", "issues_closed", "issue_resolution_rate"]),
        (metrics.pr_health(events), ["prs_opened", "prs_closed", "prs_closed_per_week", "pr_merge_rate"]),
        (metrics.contributor_diversity(events), ["contributor_count", "bus_factor_risk"]),
        (scorecard.governance(card), ["governance_score", "is_maintained", "has_license", "is_branch_protected", "requires_code_review", "has_security_policy"]),
        (scorecard.security(card), ["security_score", "vuln_count", "vuln_data_available", "has_dep_update_tool"]),
    ):
        joined = joined.join(view.select("repo_full_name", *columns), "repo_full_name", "left")
    counts = ["push_event_count", "total_commits", "active_committers", "active_days", "issues_opened", "issues_closed", "prs_opened", "prs_closed"]
    joined = joined.fillna(0, counts)
    assert rows(fused) == rows(joined, *fused.columns)
    assert fused.count() == 8


def test_health_by_snapshot_equals_health_per_slice(events, card, rows):
    keyed = events.withColumn("snapshot_date", F.col("event_date"))
    every = metrics.project_health(keyed, card, by=("snapshot_date", "repo_full_name")).drop("computed_at")
    for n in range(3):
        day = DAY + datetime.timedelta(days=n)
        one = metrics.project_health(events.filter(F.col("event_date") == day), card).drop("computed_at")
        part = every.filter(F.col("snapshot_date") == day)
        assert rows(part, *one.columns) == rows(one)


def test_health_scores(events, card):
    got = {r.repo_full_name: r for r in scoring.health_scores(metrics.project_health(events, card)).collect()}
    star = got["o/star"]
    assert star.health_score == 5.0 and not star.has_push_data and star.vuln_data_available is False
    assert star.health_trend is None and star.prev_health_score is None
    p = got["o/p"]
    assert (p.commit_score, p.contributor_score, p.issue_score) == (10.0, 2.0, 0.0)
    assert (p.governance_score, p.security_score) == (6.67, 6.4)


def test_top_n_is_limited_before_the_shuffle(events):
    top = metrics.top_n_sum(metrics.actor_totals(events), 3)
    assert "row_number(), 3, Partial" in top._jdf.queryExecution().executedPlan().toString()


def test_summaries(events, spark, rows):
    assert [r.repo_full_name for r in metrics.repo_event_summary(events, 2).collect()] == ["o/backlog", "o/fast"]
    wanted = spark.createDataFrame([("o/p",), ("o/star",), ("o/absent",)], "repo_full_name string")
    coverage = metrics.coverage_by_type(events, wanted)
    assert rows(coverage, "repo_full_name", "event_type", "event_count", "distinct_actors") == [
        ("o/p", "IssuesEvent", 2, 1),
        ("o/p", "PushEvent", 5, 4),
        ("o/star", "WatchEvent", 1, 1),
    ]
    assert rows(metrics.push_verdict(coverage, wanted)) == [("o/absent", False), ("o/p", True), ("o/star", False)]
    assert ("PullRequestEvent", None, 1) in rows(
        metrics.action_breakdown(events), "event_type", "payload_action", "events"
    )
    assert metrics.action_breakdown(events, "o/p").count() == 2

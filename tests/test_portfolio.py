import datetime

import pytest
from depsignal.operators import ingest, portfolio, quality, watchlist
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def scored(spark):
    data = [("o/a", "o", 3.0), ("o/B.x", None, 5.0), ("p/c", "p", 6.0), ("p/d", "p", 7.0), ("p/e", "p", None)]
    return spark.createDataFrame(data, "repo_full_name string, org_name string, health_score double").withColumn(
        "computed_at", F.lit("2024-01-01").cast("timestamp")
    )


def names(df):
    return [r.repo_full_name for r in df.collect()]


def test_score_range(scored):
    assert names(portfolio.score_range(scored)) == ["o/a", "o/B.x"]
    assert names(portfolio.score_range(scored, 5.0, 7.0)) == ["o/B.x", "p/c"]
    assert names(portfolio.score_range(scored, 5.0, 7.0, inclusive_hi=True, ascending=False)) == ["p/d", "p/c", "o/B.x"]
    assert names(portfolio.score_range(scored, lo=6.0)) == ["p/c", "p/d"]
    assert portfolio.score_range(scored, default=None).count() == 5
    assert names(portfolio.flagged(scored, limit=1)) == ["o/a"]
    assert names(portfolio.flagged(scored, hi=8.0, limit=0)) == ["o/a", "o/B.x", "p/c", "p/d"]


def test_search(scored):
    assert names(portfolio.search_scores(scored, "b.X")) == ["o/B.x"]
    assert names(portfolio.search_scores(scored, "b?x")) == []
    assert names(portfolio.search_scores(scored, org="o", min_score=4.0)) == ["o/B.x"]
    assert names(portfolio.search_scores(scored, band="Healthy")) == ["p/d"]
    assert names(portfolio.lookup_repos(scored, ["p/d", "o/a", "x/y"])) == ["o/a", "p/d"]
    assert names(portfolio.lookup_repo(scored, "p/d")) == ["p/d"]


def test_summary(scored):
    r = portfolio.score_summary(scored).first()
    assert (r.total, r.critical, r.warning, r.healthy, r.avg_score) == (5, 1, 2, 1, 5.25)
    empty = portfolio.score_summary(scored.limit(0)).first()
    assert (empty.total, empty.avg_score) == (0, 0.0)
    b = portfolio.score_bands(scored).first()
    assert (b.critical, b.warning, b.healthy, b.warning_pct) == (1, 2, 1, 40.0)


def test_ranking_and_pages(scored):
    assert names(portfolio.most_at_risk(scored, 2)) == ["o/a", "o/B.x"]
    assert names(portfolio.healthiest(scored, 2)) == ["p/d", "p/c"]
    pages = [names(portfolio.paginate(scored, p, 2)) for p in (1, 2, 3, 4)]
    assert pages == [["o/a", "o/B.x"], ["p/c", "p/d"], ["p/e"], []]
    assert tuple(portfolio.page_info(scored, 2).first()) == (5, 3)
    assert tuple(portfolio.page_info(scored.limit(0)).first()) == (0, 1)
    assert [portfolio.page_count(n, 25) for n in (0, 25, 26)] == [1, 1, 2]


def test_missing(spark, scored):
    wanted = spark.createDataFrame([("o/a",), ("x/y",), ("x/y",)], "repo_full_name string")
    assert names(portfolio.missing_repos(wanted, scored)) == ["x/y"]


def test_vuln_buckets(spark, rows):
    data = [(0, True), (5, True), (6, True), (10, True), (11, True), (3, False), (None, True), (3, None)]
    df = spark.createDataFrame(data, "vuln_count int, vuln_data_available boolean").withColumn("repo_full_name", F.lit("r"))
    assert rows(portfolio.vuln_distribution(df), "bucket", "repos") == [
        ("one_to_five", 1), ("over_ten", 1), ("six_to_ten", 2), ("unknown", 2), ("zero", 1),
    ]


def test_top_items(spark):
    data = [("r", n, f"2024-01-{n:02d}", "open", n == 3) for n in range(1, 8)] + [("r", 9, "2024-02-01", "closed", False)]
    df = spark.createDataFrame(data, "repo_full_name string, number int, updated_at string, state string, is_pull_request boolean")
    got = portfolio.top_items_per_repo(df, 3).first()
    assert [i.number for i in got["items"]] == [7, 6, 5]
    assert [i.number for i in portfolio.top_items_per_repo(df, 3, True).first()["items"]] == [3]


PROJECT = "list_name string, org string, repo string, category string, description string"


def test_validate_projects(spark):
    df = spark.createDataFrame(
        [
            ("l1", "o", "a", "one", "d"),
            ("l1", "o", "a", "one", "d"),
            ("l1", "o", "b", "two", "d"),
            ("l2", "o", "c", "two", " "),
            ("l2", None, "d", "two", "d"),
        ],
        PROJECT,
    )
    lists = spark.createDataFrame([("l1", "one"), ("l2", "two"), ("l3", "three")], "list_name string, expected_category string")
    got = {r.rule: r.failures for r in watchlist.validate_projects(df, lists, minimum=6).collect()}
    assert got == {"missing_key": 1, "blank_value": 1, "category_mismatch": 1, "duplicate": 1, "too_few": 1, "empty_list": 1}


def test_watchlist_changes(spark, rows):
    schema = "org string, repo string, category string, description string"
    current = spark.createDataFrame([("o", "a", "one", ""), ("o", "b", "discovered", "")], schema)
    found = spark.createDataFrame([("o", "a", 0), ("o", "n", 2), ("o", "n", 1), ("o", "m", 3)], "org string, repo string, pos int")
    got = watchlist.new_projects(found, current, ["pos"])
    assert rows(got, "repo_full_name", "pos", "added") == [("o/a", 0, False), ("o/m", 3, True), ("o/n", 1, True), ("o/n", 2, False)]
    assert watchlist.remove_project(current, "o/a").count() == 2
    assert watchlist.remove_project(current, "o/b").count() == 1
    assert [watchlist.was_discovered(current, r).first().found for r in ("o/a", "o/b")] == [False, True]
    assert rows(watchlist.category_counts(current)) == [("discovered", 1), ("one", 1)]
    assert watchlist.project_set(watchlist.all_projects(current, current)).count() == 2


def test_quality(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 11.0), (None, -1.0)], "k string, v double")
    assert rows(quality.check_not_null(df, ["k", "v"])) == [("k", 1), ("v", 0)]
    assert rows(quality.check_unique(df.dropna(), "k")) == [("a", 2)]
    assert rows(quality.check_accepted(df, "k", ["b"])) == [("a", 2)]
    assert rows(quality.check_range(df, ["v"], 0, 10)) == [("v", 2)]


def test_declared_tests(spark):
    events = spark.sql("SELECT 'a' AS event_id, 'Odd' AS event_type, 'o/r' AS repo_full_name, NULL AS event_date")
    health = spark.sql("SELECT 'o/r' AS repo_full_name, 1 AS data_days_available")
    columns = ", ".join(f"11.0 AS {c}" for c in quality.SCORE_RANGE)
    scores = spark.sql(f"SELECT 'o/r' AS repo_full_name, 1 AS data_days_available, {columns}")
    tables = {"silver": events, "staged": events.union(events), "health": health, "scores": scores}
    got = quality.declared_tests(tables).collect()
    assert len(got) == 23
    bad = {(r.table_name, r.test, r["column"]): r.failures for r in got if r.failures}
    assert bad == {
        ("silver", "not_null", "event_date"): 1,
        ("staged", "not_null", "event_date"): 2,
        ("staged", "unique", "event_id"): 1,
        ("staged", "accepted_values", "event_type"): 2,
        **{("scores", "accepted_range", c): 1 for c in quality.SCORE_RANGE},
    }


def test_hours(spark):
    window = ingest.backfill_window(spark, 2, "2024-03-01")
    spine = ingest.hour_spine(window).collect()
    assert len(spine) == 48
    assert spine[0] == (datetime.date(2024, 2, 29), 0) and spine[-1] == (datetime.date(2024, 3, 1), 23)
    done = ingest.hour_spine(window).filter("hour < 23")
    assert ingest.missing_hours(ingest.hour_spine(window), done).count() == 2
    default = ingest.backfill_window(spark, 1).first()
    assert default.start == default.end < datetime.datetime.now(datetime.timezone.utc).date()


def test_backfill_summary(spark):
    schema = "events_downloaded bigint, events_filtered bigint, projects_with_events bigint, skipped boolean, error string"
    data = [(10, 5, 2, False, None), (7, 7, 1, True, None), (9, 9, 9, False, "timeout")]
    r = ingest.backfill_summary(spark.createDataFrame(data, schema)).first()
    assert (r.hours_attempted, r.hours_succeeded, r.hours_skipped, r.hours_failed) == (3, 1, 1, 1)
    assert (r.total_events_downloaded, r.total_events_filtered, r.total_files_written, r.success_rate) == (10, 5, 2, 0.5)
    assert ingest.backfill_summary(spark.createDataFrame([], schema)).first().success_rate == 1.0


def test_pages_after_a_row_equal_numbered_pages(spark):
    rows = [(f"r{k:02}", [None, 1.0, 2.0, 2.0][k % 4]) for k in range(30)]
    df = spark.createDataFrame(rows, "repo_full_name string, health_score double")
    score, repo = None, None
    for page in range(1, 7):
        found = [tuple(r) for r in portfolio.page_after(df, score, repo, 6).collect()]
        assert found == [tuple(r) for r in portfolio.paginate(df, page, 6).collect()]
        if found:
            repo, score = found[-1]

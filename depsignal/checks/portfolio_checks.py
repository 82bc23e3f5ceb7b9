"""Questions asked of scores, scorecards and watch-lists, and data tests."""

from pyspark.sql import functions as F

from depsignal import schemas
from depsignal.checks import tables as t
from depsignal.checks.prelude import mean, n, rnd
from depsignal.checks.registry import check
from depsignal.operators import portfolio, quality, scoring, watchlist
from depsignal.sources.tables import materialize_once

_SHORT = ["repo_full_name", "health_score"]


@check(
    "flt3_score_range",
    "SELECT repo_full_name, health_score FROM scores WHERE health_score BETWEEN 5.0 AND 6.5",
)
def flt3(spark, sf):
    return portfolio.score_range(t.scored(spark, sf), 5.0, 6.5, inclusive_hi=True).select(*_SHORT)


@check(
    "flt4_search_scores",
    """SELECT repo_full_name, health_score FROM scores WHERE contains(lower(repo_full_name), 'repo1')
      AND org_name = 'org1' AND health_score >= 5.5 AND health_score < 7""",
)
def flt4(spark, sf):
    found = portfolio.search_scores(t.scored(spark, sf), " REPO1", "org1", "Warning", 5.5)
    return found.select(*_SHORT)


@check(
    "flt5_lookup_repos",
    """SELECT repo_full_name, health_score FROM scores
    WHERE repo_full_name IN ('org1/repo1', 'org2/repo12', 'org9/repo99', 'no/such')""",
)
def flt5(spark, sf):
    wanted = ["org1/repo1", "org2/repo12", "org9/repo99", "no/such"]
    return portfolio.lookup_repos(t.scored(spark, sf), wanted).select(*_SHORT)


@check(
    "flt6_valid_repo_name",
    r"""SELECT c_custkey, name, regexp_matches(name, '^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+$') AS valid
    FROM (SELECT c_custkey, CASE WHEN c_nationkey < 8 THEN lower(c_mktsegment) || '/' || c_name
      WHEN c_nationkey < 16 THEN lower(c_mktsegment) ELSE c_mktsegment || '/c_' || c_custkey || '.x' END
      AS name FROM customer)""",
)
def flt6(spark, sf):
    from depsignal.functions.names import valid_repo_name

    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    name = (
        F.when(nation < 8, F.concat(F.lower(segment), F.lit("/"), F.col("c_name")))
        .when(nation < 16, F.lower(segment))
        .otherwise(F.concat(segment, F.lit("/c_"), F.col("c_custkey").cast("string"), F.lit(".x")))
    )
    rows = t.table(spark, sf, "customer").select("c_custkey", name.alias("name"))
    return rows.withColumn("valid", valid_repo_name(F.col("name")))


_PROJECT = "org, repo, category, p_name AS description"


@check(
    "flt7_projects_by_category", f"SELECT {_PROJECT} FROM parts WHERE category = 'discovered'"
)
def flt7(spark, sf):
    return watchlist.projects_by_category(t.projects(spark, sf), "discovered")


@check(
    "agg10_score_summary",
    f"""SELECT count(*) AS total, count(*) FILTER (health_score < 5) AS critical,
      count(*) FILTER (health_score >= 5 AND health_score < 7) AS warning,
      count(*) FILTER (health_score >= 7) AS healthy, {mean("health_score")} AS avg_score,
      '2024-02-01 00:00:00' AS last_run FROM scores""",
)
def agg10(spark, sf):
    summary = portfolio.score_summary(t.scored(spark, sf))
    return summary.withColumn("last_run", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss"))


def _pct(part, total="total", digits=1):
    return rnd(f"({part}::DOUBLE / nullif({total}, 0) * 100)", digits)


@check(
    "agg11_score_bands",
    f"""SELECT *, {_pct("critical")} AS critical_pct, {_pct("warning")} AS warning_pct,
      {_pct("healthy")} AS healthy_pct
    FROM (SELECT count(*) AS total, count(*) FILTER (health_score < 4) AS critical,
      count(*) FILTER (health_score >= 4 AND health_score < 7) AS warning,
      count(*) FILTER (health_score >= 7) AS healthy FROM scores)""",
)
def agg11(spark, sf):
    return portfolio.score_bands(t.scored(spark, sf))


@check(
    "agg12_average_signals",
    " UNION ALL ".join(
        f"SELECT '{c}' AS signal, {mean(c)} AS average FROM scores" for c in schemas.SIGNALS
    ),
)
def agg12(spark, sf):
    return portfolio.average_signals(t.scored(spark, sf))


_FLAGS = (
    "is_maintained",
    "has_license",
    "is_branch_protected",
    "requires_code_review",
    "has_security_policy",
    "has_dep_update_tool",
)


@check(
    "agg13_governance_coverage",
    f"SELECT *, {_pct('repos')} AS pct FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS flag, count(*) FILTER ({c}) AS repos, count(*) AS total FROM cards"
        for c in _FLAGS
    )
    + ")",
)
def agg13(spark, sf):
    return portfolio.governance_coverage(t.cards(spark, sf))


_BUCKETS = {
    "unknown": "vuln_data_available = false OR vuln_count IS NULL",
    "zero": "vuln_data_available AND vuln_count = 0",
    "one_to_five": "vuln_data_available AND vuln_count BETWEEN 1 AND 5",
    "six_to_ten": "vuln_data_available AND vuln_count BETWEEN 6 AND 10",
    "over_ten": "vuln_data_available AND vuln_count > 10",
}


@check(
    "agg14_vuln_distribution",
    f"SELECT *, {_pct('repos')} AS pct FROM ("
    + " UNION ALL ".join(
        f"SELECT '{k}' AS bucket, count(*) FILTER ({v}) AS repos, count(*) AS total FROM cards"
        for k, v in _BUCKETS.items()
    )
    + ")",
)
def agg14(spark, sf):
    return portfolio.vuln_distribution(t.cards(spark, sf))


@check(
    "agg15_push_coverage",
    f"""+ g AS (SELECT
        CASE WHEN h.commits_per_week IS NULL THEN 'no_push_events' ELSE 'has_push_events' END AS push_coverage,
        CASE WHEN h.contributor_count IS NULL THEN 'no_contributor_data'
          ELSE 'has_contributor_data' END AS contrib_coverage,
        count(*) AS project_count, {mean("commit_score")} AS avg_commit_score,
        {mean("contributor_score")} AS avg_contributor_score, {mean("health_score")} AS avg_health_score
      FROM health h JOIN scores USING (repo_full_name) GROUP BY 1, 2)
    SELECT *, {_pct("project_count", "(SELECT sum(project_count) FROM g)")} AS pct FROM g""",
)
def agg15(spark, sf):
    health = materialize_once(t.health(spark, sf))
    return portfolio.push_coverage(health, scoring.health_scores(health))


@check("agg16_category_counts", "SELECT category, count(*) AS projects FROM parts GROUP BY ALL")
def agg16(spark, sf):
    return watchlist.category_counts(t.projects(spark, sf))


@check(
    "top1_most_at_risk",
    """SELECT 'risk' AS side, * FROM (SELECT repo_full_name, health_score FROM scores
      ORDER BY health_score, repo_full_name LIMIT 5)
    UNION ALL SELECT 'best', * FROM (SELECT repo_full_name, health_score FROM scores
      ORDER BY health_score DESC, repo_full_name LIMIT 5)""",
)
def top1(spark, sf):
    table = t.scored(spark, sf).select(*_SHORT)
    risk = portfolio.most_at_risk(table).select(F.lit("risk").alias("side"), "*")
    return risk.unionByName(portfolio.healthiest(table).select(F.lit("best").alias("side"), "*"))


@check(
    "top2_flagged",
    """SELECT repo_full_name, health_score FROM scores WHERE health_score < 6.0
    ORDER BY health_score, repo_full_name LIMIT 10""",
)
def top2(spark, sf):
    return portfolio.flagged(t.scored(spark, sf), limit=10).select(*_SHORT)


_SAMPLE = """SELECT repo_full_name, h.commits_per_week, h.contributor_count, commit_score,
  contributor_score, health_score FROM health h JOIN scores USING (repo_full_name)
WHERE h.commits_per_week IS NULL OR h.contributor_count IS NULL
ORDER BY health_score DESC, repo_full_name LIMIT 20"""


@check("top3_fallback_sample", _SAMPLE)
def top3(spark, sf):
    health = materialize_once(t.health(spark, sf))
    return portfolio.fallback_sample(health, scoring.health_scores(health))


@check(
    "win5_paginate",
    """SELECT p.*, n.rows, n.pages FROM (SELECT repo_full_name, health_score FROM scores
      ORDER BY health_score, repo_full_name LIMIT 25 OFFSET 25) p,
    (SELECT count(*) AS rows, greatest(1, CAST(ceil(count(*) / 25.0) AS BIGINT)) AS pages FROM scores) n""",
)
def win5(spark, sf):
    table = materialize_once(t.scored(spark, sf).select(*_SHORT))
    info = portfolio.page_info(table).first()
    return portfolio.paginate(table, 2).select(
        "*",
        F.lit(info["rows"]).cast("bigint").alias("rows"),
        F.lit(info["pages"]).cast("bigint").alias("pages"),
    )


@check(
    "win5_keyset_page",
    """SELECT repo_full_name, health_score FROM scores ORDER BY health_score, repo_full_name LIMIT 25 OFFSET 50""",
)
def win5_keyset(spark, sf):
    table = materialize_once(t.scored(spark, sf).select("repo_full_name", "health_score"))
    score, repo = None, None
    for _ in range(2):  # the last row of a page leads to the next one
        page = portfolio.page_after(table, score, repo).collect()
        if page:
            score, repo = page[-1]["health_score"], page[-1]["repo_full_name"]
    return portfolio.page_after(table, score, repo)


@check(
    "win4_top_items_per_repo",
    """SELECT 'org' || (o_custkey % 10) || '/repo' || o_custkey AS repo_full_name,
      CAST(row_number() OVER w AS INTEGER) - 1 AS pos, o_orderkey AS number,
      strftime(o_orderdate, '%Y-%m-%d') AS updated_at
    FROM orders WHERE o_orderpriority NOT LIKE '1%' AND o_orderstatus <> 'F'
    WINDOW w AS (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey DESC)
    QUALIFY row_number() OVER w <= 10""",
)
def win4(spark, sf):
    top = portfolio.top_items_per_repo(t.items(spark, sf), 10)
    return top.select("repo_full_name", F.posexplode("items").alias("pos", "i")).select(
        "repo_full_name", "pos", "i.number", "i.updated_at"
    )


@check("set1_all_projects", f"SELECT {_PROJECT} FROM parts UNION ALL SELECT {_PROJECT} FROM curated")
def set1(spark, sf):
    return watchlist.all_projects(t.projects(spark, sf), t.curated(spark, sf))


@check("set2_project_set", "SELECT DISTINCT repo_full_name FROM parts")
def set2(spark, sf):
    both = watchlist.all_projects(t.projects(spark, sf), t.curated(spark, sf))
    return watchlist.project_set(both)


@check("set3_distinct_repos", "SELECT DISTINCT repo_full_name FROM trended")
def set3(spark, sf):
    return portfolio.distinct_repos(t.snapshots(spark, sf))


@check(
    "set4_remove_project",
    f"""+ target AS (SELECT min(repo_full_name) AS r FROM parts WHERE category = 'discovered')
    SELECT {_PROJECT}, true AS found FROM parts WHERE repo_full_name <> (SELECT r FROM target)""",
)
def set4(spark, sf):
    projects = t.projects(spark, sf)
    name = watchlist.full_name()
    repo = projects.filter("category = 'discovered'").agg(F.min(name).alias("r")).first()["r"]
    found = watchlist.was_discovered(projects, repo).first()["found"]
    return watchlist.remove_project(projects, repo).withColumn("found", F.lit(found))


@check(
    "jon9_with_scores",
    """SELECT repo_full_name, language, health_score, has_push_data FROM fetched
    LEFT JOIN scores USING (repo_full_name)""",
)
def jon9(spark, sf):
    records = t.fetched_cards(spark, sf).select("repo_full_name", "language")
    return scoring.with_scores(records, t.scored(spark, sf), ["health_score", "has_push_data"])


@check(
    "jon10_missing_repos",
    """SELECT repo_full_name FROM curated
    WHERE repo_full_name NOT IN (SELECT repo_full_name FROM scores)""",
)
def jon10(spark, sf):
    wanted = watchlist.project_set(t.curated(spark, sf))
    return portfolio.missing_repos(wanted, t.scored(spark, sf))


# -- data tests --------------------------------------------------------------


@check(
    "dq1_check_not_null",
    " UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", count(*) FILTER ({c} IS NULL) AS failures FROM silver'
        for c in ("event_id", "event_type", "repo_full_name", "event_date", "actor_login")
    ),
)
def dq1(spark, sf):
    columns = ["event_id", "event_type", "repo_full_name", "event_date", "actor_login"]
    return quality.check_not_null(t.silver_events(spark, sf), columns)


@check(
    "dq2_check_unique",
    "SELECT event_id, count(*) AS copies FROM silver WHERE event_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
)
def dq2(spark, sf):
    return quality.check_unique(t.silver_events(spark, sf), "event_id")


@check(
    "dq3_check_accepted",
    "SELECT type, count(*) AS failures FROM bronze WHERE type = 'CreateEvent' GROUP BY ALL",
)
def dq3(spark, sf):
    return quality.check_accepted(t.bronze(spark, sf), "type", schemas.EVENT_TYPES)


_RANGED = ["health_score", "commit_score", "issue_score", "pr_score", "contributor_score", "bus_factor_score"]


@check(
    "dq4_check_range",
    " UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", count(*) FILTER (NOT {c} BETWEEN 2 AND 9) AS failures FROM scores'
        for c in _RANGED
    ),
)
def dq4(spark, sf):
    # narrower than 0 to 10, so that the check finds something
    return quality.check_range(t.scored(spark, sf), _RANGED, 2, 9)


@check(
    "dq5_validate_projects",
    f"""+ p AS (
      SELECT 'list_' || category AS list_name, org, repo,
        CASE WHEN p_size = 48 THEN 'other' ELSE category END AS category,
        CASE p_size WHEN 50 THEN NULL WHEN 49 THEN ' ' ELSE p_name END AS description, p_size
      FROM parts),
    q AS (SELECT * FROM p UNION ALL SELECT * FROM p WHERE p_size = 47),
    d AS (SELECT count(*) AS copies FROM q GROUP BY org, repo),
    l AS (SELECT DISTINCT 'list_' || category AS list_name FROM parts UNION ALL SELECT 'list_none')
    SELECT 'missing_key' AS rule, count(*) FILTER (description IS NULL) AS failures FROM q
    UNION ALL SELECT 'blank_value', count(*) FILTER (trim(description) = '') FROM q
    UNION ALL SELECT 'category_mismatch', count(*) FILTER ('list_' || category <> list_name) FROM q
    UNION ALL SELECT 'duplicate', {n("sum(copies - 1)")} FROM d
    UNION ALL SELECT 'too_few', CASE WHEN count(*) < 800 THEN 1 ELSE 0 END FROM q
    UNION ALL SELECT 'empty_list', count(*) FROM l WHERE list_name NOT IN (SELECT list_name FROM q)""",
)
def dq5(spark, sf):
    part = t.table(spark, sf, "part").select(
        t.repo_of(F.col("p_partkey")).alias("full"), "p_size"
    )
    base = t.projects(spark, sf).withColumn("full", watchlist.full_name()).join(part, "full")
    size = F.col("p_size")
    rows = base.select(
        F.concat(F.lit("list_"), F.col("category")).alias("list_name"),
        "org",
        "repo",
        F.when(size == 48, "other").otherwise(F.col("category")).alias("category"),
        F.when(size == 50, None).when(size == 49, " ").otherwise(F.col("description")).alias("description"),
        "p_size",
    )
    rows = rows.unionByName(rows.filter("p_size = 47"))
    kinds = t.projects(spark, sf).select(
        F.concat(F.lit("list_"), F.col("category")).alias("list_name"),
        F.col("category").alias("expected_category"),
    )
    none = kinds.agg(F.lit("list_none").alias("list_name"), F.lit("none").alias("expected_category"))
    return watchlist.validate_projects(rows, kinds.distinct().unionByName(none))


@check(
    "dq6_null_fallback_report",
    f"""SELECT 'group' AS part, CASE WHEN h.commits_per_week IS NULL THEN 'no_push_events'
        ELSE 'has_push_events' END AS label, CAST(count(*) AS DOUBLE) AS value
      FROM health h GROUP BY 2
    UNION ALL SELECT 'sample', repo_full_name, health_score FROM ({_SAMPLE})""",
)
def dq6(spark, sf):
    health = materialize_once(t.health(spark, sf))
    scored = scoring.health_scores(health)
    groups = portfolio.push_coverage(health, scored).select(
        F.lit("group").alias("part"),
        F.col("push_coverage").alias("label"),
        F.col("project_count").cast("double").alias("value"),
    )
    sample = portfolio.fallback_sample(health, scored).select(
        F.lit("sample").alias("part"),
        F.col("repo_full_name").alias("label"),
        F.col("health_score").alias("value"),
    )
    return groups.unionByName(sample)


def _declared_sql(table, test, column):
    if test == "not_null":
        failing = f"SELECT 1 FROM {table} WHERE {column} IS NULL"
    elif test == "unique":
        failing = f"SELECT 1 FROM {table} GROUP BY {column} HAVING count(*) > 1"
    elif test == "accepted_range":
        failing = f"SELECT 1 FROM {table} WHERE {column} NOT BETWEEN 0 AND 10"
    else:
        kinds = ", ".join(f"'{k}'" for k in schemas.EVENT_TYPES)
        failing = f"SELECT 1 FROM {table} WHERE {column} NOT IN ({kinds})"
    return (
        f"SELECT '{table}' AS table_name, '{test}' AS test, '{column}' AS \"column\", "
        f"(SELECT count(*) FROM ({failing})) AS failures"
    )


@check(
    "dq_declared_tests",
    " UNION ALL ".join(
        _declared_sql(table, test, column)
        for table, test, columns in quality.DECLARED
        for column in columns
    ),
)
def dq_declared(spark, sf):
    health = materialize_once(t.health(spark, sf))
    return quality.declared_tests(
        {
            "silver": t.silver_events(spark, sf),
            "staged": t.staged(spark, sf),
            "health": health,
            "scores": scoring.health_scores(health),
        }
    )

"""Event metrics, scores and scorecards."""

from pyspark.sql import functions as F

from depsignal.checks import tables as t
from depsignal.checks.prelude import health_chain, rnd
from depsignal.checks.registry import check
from depsignal.functions import scores
from depsignal.operators import history, metrics, scorecard, scoring
from depsignal.operators.portfolio import coverage_join
from depsignal.plans import gold, rolling
from depsignal.session import scratch_path
from depsignal.sources import events
from depsignal.sources.tables import materialize_once


@check("agg1_commit_activity", "SELECT * FROM commit_activity")
def agg1(spark, sf):
    return metrics.commit_activity(t.staged(spark, sf, "PushEvent"))


@check("agg2_issue_health", "SELECT * FROM issue_health")
def agg2(spark, sf):
    return metrics.issue_health(t.staged(spark, sf, "IssuesEvent"))


@check("agg3_pr_health", "SELECT * FROM pr_health")
def agg3(spark, sf):
    return metrics.pr_health(t.staged(spark, sf, "PullRequestEvent"))


@check("agg4_contributor_diversity", "SELECT * FROM diversity")
def agg4(spark, sf):
    return metrics.contributor_diversity(t.staged(spark, sf, "PushEvent"))


@check("agg5_repo_span", "SELECT * FROM span")
def agg5(spark, sf):
    return metrics.repo_span(t.staged(spark, sf))


@check(
    "agg7_repo_event_summary",
    """SELECT repo_full_name, count(*) AS total_events, count(DISTINCT event_type) AS event_types,
      min(event_date) AS earliest_date, max(event_date) AS latest_date
    FROM staged GROUP BY ALL ORDER BY total_events DESC, repo_full_name LIMIT 20""",
)
def agg7(spark, sf):
    return metrics.repo_event_summary(t.staged(spark, sf))


_COVERAGE = """SELECT repo_full_name, event_type, count(*) AS event_count,
  count(DISTINCT actor_login) AS distinct_actors, min(event_date) AS earliest,
  max(event_date) AS latest
FROM staged WHERE repo_full_name IN (SELECT repo_full_name FROM curated) GROUP BY ALL"""


@check(
    "agg8_coverage_by_type",
    f"""SELECT c.*, has_push FROM ({_COVERAGE}) c JOIN (
      SELECT repo_full_name, bool_or(event_type = 'PushEvent') AS has_push
      FROM staged GROUP BY ALL) USING (repo_full_name)""",
)
def agg8(spark, sf):
    wanted = t.curated(spark, sf).select(F.concat_ws("/", "org", "repo").alias("repo_full_name"))
    coverage = metrics.coverage_by_type(t.staged(spark, sf), wanted)
    return coverage.join(metrics.push_verdict(coverage, wanted), "repo_full_name")


@check(
    "agg9_action_breakdown",
    """SELECT event_type, payload_action, count(*) AS events, min(event_date) AS earliest,
      max(event_date) AS latest FROM staged
    WHERE event_type IN ('IssuesEvent', 'PullRequestEvent') GROUP BY ALL""",
)
def agg9(spark, sf):
    return metrics.action_breakdown(t.staged(spark, sf, "IssuesEvent", "PullRequestEvent"))


@check("win2_top_n_sum", "SELECT * FROM top3")
def win2(spark, sf):
    return metrics.top_n_sum(metrics.actor_totals(t.staged(spark, sf, "PushEvent")), 3)


@check(
    "jon3_top3_join",
    """SELECT repo_full_name, total_commits, contributor_count, top3_commits FROM diversity""",
)
def jon3(spark, sf):
    actors = metrics.actor_totals(t.staged(spark, sf, "PushEvent"))
    totals = actors.groupBy("repo_full_name").agg(
        F.sum("actor_commits").alias("total_commits"),
        F.count("actor_login").alias("contributor_count"),
    )
    return metrics.with_top_n(totals, metrics.top_n_sum(actors, 3))


@check("jon2_project_health", f"SELECT *, '{t.COMPUTED_AT}' AS computed_at FROM health")
def jon2(spark, sf):
    return t.health(spark, sf).withColumn("computed_at", F.date_format("computed_at", "yyyy-MM-dd HH:mm:ss"))


_SCORES = """SELECT *, CAST(NULL AS DOUBLE) AS health_trend, CAST(NULL AS DOUBLE) AS prev_health_score
FROM scores"""


@check("sco7_health_scores", _SCORES)
def sco7(spark, sf):
    return t.scored(spark, sf).drop("computed_at")


@check("sco7_incremental", _SCORES)
def sco7_incremental(spark, sf):
    store, silver = scratch_path(spark, "daily"), t.silver_events(spark, sf)
    at = F.lit(t.COMPUTED_AT).cast("timestamp")
    day = F.dayofmonth("event_date")
    # odd days come first; then even days, and a part of the odd ones that was late
    early = silver.filter((day % 2 == 1) & (F.hour("created_at") < 15))
    late_days = events.days_of(silver.filter((day % 2 == 0) | (F.hour("created_at") >= 15)))
    gold.refresh_daily(early, store, events.days_of(early))
    gold.refresh_daily(silver, store, late_days)
    return gold.scores_from_daily(spark, store, t.cards(spark, sf), at).drop("computed_at")


_LAST_DAYS = 7


@check(
    "sco7_rolling_window",
    f"""+ recent AS (SELECT * FROM staged WHERE event_date > (SELECT max(event_date) FROM staged) - {_LAST_DAYS}),
    {health_chain("recent", "_r")}
    SELECT *, CAST(NULL AS DOUBLE) AS health_trend, CAST(NULL AS DOUBLE) AS prev_health_score FROM scores_r""",
)
def sco7_rolling(spark, sf):
    store, root, silver = scratch_path(spark, "daily"), scratch_path(spark, "window"), t.silver_events(spark, sf)
    gold.refresh_daily(silver, store, events.days_of(silver))
    last = silver.agg(F.max("event_date")).first()[0]
    # three days ahead a whole window, then day by day
    for back in (3, 2, 1, 0):
        rolling.roll(spark, store, root, last - back * rolling.MARGIN, _LAST_DAYS)
    at = F.lit(t.COMPUTED_AT).cast("timestamp")
    return rolling.rolling_scores(spark, root, last, t.cards(spark, sf), at).drop("computed_at")


@check(
    "jon4_coverage_join",
    """SELECT repo_full_name, commits_per_week, contributor_count, bus_factor_risk, commit_score,
      contributor_score, bus_factor_score, health_score FROM health JOIN scores USING (repo_full_name)""",
)
def jon4(spark, sf):
    # the second frame is derived from the first, so only one side reads events twice
    health = materialize_once(t.health(spark, sf))
    return coverage_join(health, scoring.health_scores(health))


_LOG = "log10(1.0::DOUBLE + {0} * 50.0::DOUBLE) / log10(501.0::DOUBLE) * 10.0::DOUBLE"


def _signal_sql(column, source, expr, name):
    value = rnd(f"(CASE WHEN {column} IS NULL THEN 5.0::DOUBLE ELSE {expr} END)")
    return f"SELECT repo_full_name, {column}, {value} AS {name} FROM {source}"


@check(
    "sco1_log_rate_score",
    _signal_sql(
        "prs_closed_per_week",
        "health",
        f"least({_LOG.format('prs_closed_per_week')}, 10.0::DOUBLE)",
        "pr_score",
    ),
)
def sco1(spark, sf):
    return t.health(spark, sf).select(
        "repo_full_name",
        "prs_closed_per_week",
        scores.log_rate_score(F.col("prs_closed_per_week")).alias("pr_score"),
    )


@check(
    "sco2_issue_score",
    _signal_sql(
        "issue_resolution_rate",
        "health",
        "least(issue_resolution_rate, 1.0::DOUBLE) * 10.0::DOUBLE",
        "issue_score",
    ),
)
def sco2(spark, sf):
    return t.health(spark, sf).select(
        "repo_full_name",
        "issue_resolution_rate",
        scores.issue_score(F.col("issue_resolution_rate")).alias("issue_score"),
    )


@check(
    "sco3_contributor_score",
    _signal_sql(
        "contributor_count",
        "health",
        "least(CAST(contributor_count AS DOUBLE) / 20.0::DOUBLE, 1.0::DOUBLE) * 10.0::DOUBLE",
        "contributor_score",
    ),
)
def sco3(spark, sf):
    return t.health(spark, sf).select(
        "repo_full_name",
        "contributor_count",
        scores.contributor_score(F.col("contributor_count")).alias("contributor_score"),
    )


@check(
    "sco4_bus_factor_score",
    _signal_sql(
        "bus_factor_risk",
        "health",
        "(1.0::DOUBLE - bus_factor_risk) * 10.0::DOUBLE",
        "bus_factor_score",
    ),
)
def sco4(spark, sf):
    return t.health(spark, sf).select(
        "repo_full_name",
        "bus_factor_risk",
        scores.bus_factor_score(F.col("bus_factor_risk")).alias("bus_factor_score"),
    )


@check("sco5_governance", "SELECT * FROM governance")
def sco5(spark, sf):
    return scorecard.governance(t.cards(spark, sf))


@check("sco6_security", "SELECT * FROM security")
def sco6(spark, sf):
    return scorecard.security(t.cards(spark, sf))


@check(
    "sco8_risk_action",
    f"""+ raw AS (SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 'unknown'
      WHEN c_nationkey = 1 THEN NULL
      ELSE CAST(CAST(floor(c_acctbal / 8) AS BIGINT) / 100 AS VARCHAR) END AS score FROM customer),
    r AS (SELECT *, try_cast(score AS DOUBLE) AS v,
      (10.0::DOUBLE - greatest(0.0::DOUBLE, least(10.0::DOUBLE, try_cast(score AS DOUBLE)))) / 10.0::DOUBLE
        AS risk FROM raw)
    SELECT c_custkey, score, {rnd("coalesce(CASE WHEN v IS NOT NULL THEN risk END, 0.5::DOUBLE)", 4)} AS risk_score,
      CASE WHEN v IS NULL THEN 'MONITOR' WHEN risk >= 0.65 THEN 'REPLACE' WHEN risk >= 0.5 THEN 'UPGRADE'
        ELSE 'MONITOR' END AS action FROM r""",
)
def sco8(spark, sf):
    # account balances stand in for scores: below 0, above 10, missing and not a number
    balance = F.floor(F.col("c_acctbal") / 8) / 100
    score = (
        F.when(F.col("c_nationkey") == 0, "unknown")
        .when(F.col("c_nationkey") == 1, None)
        .otherwise(balance.cast("string"))
    )
    rows = t.table(spark, sf, "customer").select("c_custkey", score.alias("score"))
    return scoring.recommend(rows, "score")


@check(
    "sco9_band",
    """SELECT repo_full_name, snapshot_date, health_trend,
      CASE WHEN health_score >= 7 THEN 'Healthy' WHEN health_score >= 5 THEN 'Warning'
        ELSE 'Critical' END AS band,
      CASE WHEN prev_health_score IS NULL THEN 'N/A' WHEN prev_health_score >= 7 THEN 'Healthy'
        WHEN prev_health_score >= 4 THEN 'Warning' ELSE 'Critical' END AS prev_band FROM trended""",
)
def sco9(spark, sf):
    return t.snapshots(spark, sf).select(
        "repo_full_name",
        "snapshot_date",
        "health_trend",
        scores.band(F.col("health_score")).alias("band"),
        scores.band(F.col("prev_health_score"), 4.0, 7.0).alias("prev_band"),
    )


_PUSHED = "CASE WHEN p_size = 50 THEN 'n/a' ELSE strftime(DATE '2024-01-30' - p_size * 4, '%Y-%m-%dT00:00:00Z') END"
AS_OF = "2024-01-30T00:00:00Z"


def _pushed_at():
    day = F.date_sub(F.lit("2024-01-30").cast("date"), F.col("p_size") * 4)
    return F.when(F.col("p_size") == 50, "n/a").otherwise(
        F.concat(day.cast("string"), F.lit("T00:00:00Z"))
    )


@check(
    "sco10_is_maintained",
    f"""SELECT p_partkey, {_PUSHED} AS pushed_at,
      CASE WHEN p_size < 50 THEN p_size * 4 < 90 END AS is_maintained FROM part""",
)
def sco10(spark, sf):
    as_of = F.lit(AS_OF)
    rows = t.table(spark, sf, "part").select("p_partkey", _pushed_at().alias("pushed_at"))
    return rows.withColumn("is_maintained", scores.is_maintained(F.col("pushed_at"), as_of))


@check(
    "sco11_scorecard",
    """+ eco AS (SELECT *, CASE p_type WHEN 'ECONOMY' THEN 'PyPI' WHEN 'STANDARD' THEN 'Go'
        WHEN 'MEDIUM' THEN 'crates.io' WHEN 'SMALL' THEN 'Maven' WHEN 'PROMO' THEN 'NuGet' END AS ecosystem
      FROM parts),
    v AS (SELECT l_partkey, CASE l_linestatus WHEN 'F' THEN 'PyPI' ELSE 'Go' END AS ecosystem,
        count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
    SELECT repo_full_name, CASE WHEN p_size < 50 THEN p_size * 4 < 90 END AS is_maintained,
      brand > 3 AS has_license, brand > 8 AS is_branch_protected,
      brand > 8 AND (p_size > 25 OR p_type IN ('SMALL', 'LARGE')) AS requires_code_review,
      p_size BETWEEN 10 AND 35 AS has_security_policy,
      CASE WHEN e.ecosystem IS NOT NULL THEN CAST(coalesce(n, 0) AS INTEGER) END AS vuln_count,
      e.ecosystem IS NOT NULL AS vuln_data_available, brand < 16 AS has_dep_update_tool,
      CASE p_type WHEN 'ECONOMY' THEN 'Python' WHEN 'STANDARD' THEN 'Go' WHEN 'MEDIUM' THEN 'Rust'
        WHEN 'SMALL' THEN 'Kotlin' WHEN 'LARGE' THEN 'Haskell' ELSE 'C#' END AS language
    FROM eco e LEFT JOIN v ON l_partkey = p_partkey AND v.ecosystem = e.ecosystem""",
)
def sco11(spark, sf):
    part = t.table(spark, sf, "part").withColumn("repo_full_name", t.repo_of(F.col("p_partkey")))
    brand, size = t._brand(), F.col("p_size")
    meta = part.select(
        "repo_full_name",
        F.to_json(
            F.struct(
                t.language().alias("language"),
                _pushed_at().alias("pushed_at"),
                F.when(brand > 3, F.struct(F.lit("mit").alias("key"))).alias("license"),
            )
        ).alias("body"),
    )
    level = F.when(F.col("p_type") == "SMALL", "everyone").when(
        F.col("p_type") == "LARGE", "non_admins"
    ).otherwise("off")
    branches = part.select(
        "repo_full_name",
        F.to_json(
            F.struct(
                (brand > 8).alias("protected"),
                F.struct(
                    F.when(size > 25, F.struct(F.lit(1).alias("approvals"))).alias(
                        "required_pull_request_reviews"
                    ),
                    F.struct(level.alias("enforcement_level")).alias("required_status_checks"),
                ).alias("protection"),
            )
        ).alias("body"),
    )
    paths = F.array_compact(
        F.array(
            F.lit("README.md"),
            F.when(brand < 16, "renovate.json"),
            F.when(size.between(10, 35), "docs/SECURITY.md"),
        )
    )
    files = part.select("repo_full_name", F.explode(paths).alias("path"))
    vulns = t.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.concat(F.lit("repo"), F.col("l_partkey").cast("string")).alias("package"),
        F.when(F.col("l_linestatus") == "F", "PyPI").otherwise("Go").alias("ecosystem"),
    )
    return scorecard.scorecard(meta, branches, files, vulns, F.lit(AS_OF))


@check(
    "jon12_language_ecosystem",
    """SELECT repo_full_name, language, CASE language WHEN 'Python' THEN 'PyPI' WHEN 'Go' THEN 'Go'
      WHEN 'Rust' THEN 'crates.io' WHEN 'Kotlin' THEN 'Maven' WHEN 'C#' THEN 'NuGet' END AS ecosystem
    FROM fetched""",
)
def jon12(spark, sf):
    return scorecard.language_ecosystem(
        t.fetched_cards(spark, sf).select("repo_full_name", "language")
    )


_TREND = ["snapshot_date", "repo_full_name", "health_score", "prev_health_score", "health_trend"]


@check("win3_health_trend", f"SELECT {', '.join(_TREND)} FROM trended")
def win3(spark, sf):
    return t.snapshots(spark, sf).select(*_TREND)


@check("win3_interval_history", f"SELECT {', '.join(_TREND)} FROM trended")
def win3_intervals(spark, sf):
    root, snapshots = scratch_path(spark, "history"), materialize_once(t.snapshots(spark, sf))
    history.start_history(spark, root, 4)
    days = sorted(r.snapshot_date for r in snapshots.select("snapshot_date").distinct().collect())
    # the second snapshot comes last, and the first one once more
    for day in [*days[:1], *days[2:], *days[1:2], days[0]]:
        history.record_snapshot(spark, root, snapshots.filter(F.col("snapshot_date") == day), day)
    return history.read_history(spark, root)


@check(
    "top4_score_history",
    f"SELECT {', '.join(_TREND)} FROM trended WHERE repo_full_name = 'org7/repo7'",
)
def top4(spark, sf):
    from depsignal.operators.portfolio import score_history

    return score_history(t.snapshots(spark, sf), "org7/repo7").select(*_TREND)


# -- scalar families ---------------------------------------------------------


@check(
    "fn1_string",
    r"""SELECT p_partkey, lower(w2) AS lower_word, trim('  ' || w1 || ' ') AS trimmed,
      concat_ws('|', w1, NULL, w2) AS joined, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits,
      regexp_extract(p_brand, '#(\d+)', 1) AS brand_no, substr(p_name, 1, 5) AS head,
      contains(p_name, 'ring') AS has_ring, split_part(p_name, ' ', 2) AS second,
      sha256(p_name) AS hashed, printf('%s-%d', p_type, p_size) AS label FROM parts""",
)
def fn1(spark, sf):
    name = F.col("p_name")
    words = F.split(name, " ")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    return t.table(spark, sf, "part").select(
        "p_partkey",
        F.lower(second).alias("lower_word"),
        F.trim(F.concat(F.lit("  "), first, F.lit(" "))).alias("trimmed"),
        F.concat_ws("|", first, F.lit(None).cast("string"), second).alias("joined"),
        F.regexp_replace("p_brand", "[^0-9]", "").alias("digits"),
        F.regexp_extract("p_brand", r"#(\d+)", 1).alias("brand_no"),
        F.substring(name, 1, 5).alias("head"),
        F.contains(name, F.lit("ring")).alias("has_ring"),
        second.alias("second"),
        F.sha2(name, 256).alias("hashed"),
        F.format_string("%s-%d", "p_type", "p_size").alias("label"),
    )


@check(
    "fn2_date",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) - 7 AS week_before,
      date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS age,
      CAST(hour(o_orderdate) AS INTEGER) AS hour,
      try_strptime(o_orderpriority, '%Y-%m-%d') IS NULL AS unparsable,
      CAST(max(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey) AS DATE) AS latest FROM orders""",
)
def fn2(spark, sf):
    day = F.to_date("o_orderdate")
    orders = t.table(spark, sf, "orders")
    latest = orders.groupBy("o_custkey").agg(F.max(day).alias("latest"))
    return orders.join(latest, "o_custkey").select(
        "o_orderkey",
        day.alias("day"),
        F.date_sub(day, 7).alias("week_before"),
        F.datediff(F.lit("2002-01-01").cast("date"), day).cast("bigint").alias("age"),
        F.hour("o_orderdate").alias("hour"),
        F.try_to_timestamp("o_orderpriority", F.lit("yyyy-MM-dd")).isNull().alias("unparsable"),
        "latest",
    )


@check(
    "fn3_math",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      {rnd("(l_extendedprice / nullif(l_quantity, 0))", 4)} AS unit_price,
      {rnd("log10(1.0::DOUBLE + l_extendedprice)", 6)} AS magnitude,
      least(l_discount, l_tax) AS low, greatest(l_discount, l_tax) AS high,
      l_extendedprice / nullif(l_tax, 0) AS ratio FROM lineitem""",
)
def fn3(spark, sf):
    price, tax = F.col("l_extendedprice"), F.col("l_tax")
    return t.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(price / F.nullif(F.col("l_quantity"), F.lit(0.0)), 4).alias("unit_price"),
        F.round(F.log10(F.lit(1.0) + price), 6).alias("magnitude"),
        F.least("l_discount", "l_tax").alias("low"),
        F.greatest("l_discount", "l_tax").alias("high"),
        (price / F.nullif(tax, F.lit(0.0))).alias("ratio"),
    )


@check(
    "fn4_conditional",
    """SELECT o_custkey, count(*) AS orders,
      count(*) FILTER (o_totalprice BETWEEN 100000 AND 200000) AS mid,
      count(*) FILTER (o_orderstatus IN ('O', 'P')) AS active,
      count(nullif(o_orderpriority, '5-LOW')) AS not_low,
      coalesce(max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END), 'none') AS top_closed
    FROM orders GROUP BY ALL""",
)
def fn4(spark, sf):
    status = F.col("o_orderstatus")
    return t.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("o_totalprice").between(100000, 200000)).alias("mid"),
        F.count_if(status.isin("O", "P")).alias("active"),
        F.count(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))).alias("not_low"),
        F.coalesce(F.max(F.when(status == "F", F.col("o_orderpriority"))), F.lit("none")).alias(
            "top_closed"
        ),
    )


@check(
    "fn5_array",
    """SELECT p_partkey, i AS step, len(string_split(p_name, ' ')) AS words,
      array_to_string(list_slice(string_split(p_name || ' x', ' '), 1, 2), '+') AS joined
    FROM (SELECT *, unnest(range(1, p_size + 1)) AS i FROM part)""",
)
def fn5(spark, sf):
    words = F.split(F.concat("p_name", F.lit(" x")), " ")
    return t.table(spark, sf, "part").select(
        "p_partkey",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("p_size"))).alias("step"),
        (F.size(words) - 1).cast("bigint").alias("words"),
        F.array_join(F.slice(words, 1, 2), "+").alias("joined"),
    )


@check(
    "fn6_json",
    """SELECT event_id, 'k' AS key, CAST(k AS VARCHAR) AS value, CAST(k AS INTEGER) AS typed FROM ev""",
)
def fn6(spark, sf):
    pairs = F.from_json("props", "MAP<STRING, STRING>")
    typed = F.from_json("props", "k INT")
    return t.table(spark, sf, "events").select(
        "event_id", typed.getField("k").alias("typed"), F.explode(pairs)
    )


@check(
    "fn7_cast",
    """+ raw AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'n/a' WHEN 'SMALL' THEN NULL
      WHEN 'MEDIUM' THEN 'TRUE' WHEN 'LARGE' THEN '1' ELSE p_size || '.75' END AS raw FROM part)
    SELECT p_partkey, raw, try_cast(CASE WHEN raw <> 'TRUE' THEN raw END AS DOUBLE) AS as_double,
      CAST(floor(try_cast(CASE WHEN raw <> 'TRUE' THEN raw END AS DOUBLE)) AS INTEGER) AS as_int,
      lower(raw) IN ('true', '1') AS as_boolean FROM raw""",
)
def fn7(spark, sf):
    from depsignal.functions.casts import safe_boolean, safe_double, safe_int

    kind = F.col("p_type")
    raw = (
        F.when(kind == "ECONOMY", "n/a")
        .when(kind == "SMALL", None)
        .when(kind == "MEDIUM", "TRUE")
        .when(kind == "LARGE", "1")
        .otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".75")))
    )
    rows = t.table(spark, sf, "part").select("p_partkey", raw.alias("raw"))
    value = F.col("raw")
    return rows.select(
        "*",
        safe_double(value).alias("as_double"),
        safe_int(value).alias("as_int"),
        safe_boolean(value).alias("as_boolean"),
    )

"""The test-table bindings of ``tables.py`` as SQL common table expressions."""


def rnd(expr: str, digits: int = 2) -> str:
    """Round half up on the shortest decimal text, as Spark does."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def mean(column: str, digits: int = 2) -> str:
    total = f"CAST(sum(CAST({column} AS DECIMAL(18,4))) AS DOUBLE)"
    return rnd(f"({total} / count({column}))", digits)


def repo(number: str) -> str:
    return f"('org' || ({number} % 10) || '/repo' || {number})"


def n(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


EVENTS = f"""
ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
),
bronze AS (
  SELECT CAST(event_id AS VARCHAR) AS id, ts, value,
    CASE WHEN event_type = 'click' AND k < 90 THEN 'PushEvent'
         WHEN event_type = 'click' THEN 'ForkEvent'
         WHEN event_type = 'view' THEN 'IssuesEvent'
         WHEN event_type = 'purchase' THEN 'PullRequestEvent'
         WHEN event_type = 'error' THEN 'IssueCommentEvent'
         WHEN value < 20 THEN 'CreateEvent' ELSE 'WatchEvent' END AS type,
    CASE WHEN value >= 1 THEN user_id END AS actor_id,
    CASE WHEN value >= 1 THEN 'user' || user_id END AS actor_login,
    k + 100 * (user_id // 50) AS repo_id,
    {repo("(k + 100 * (user_id // 50))")} AS repo_full_name,
    CASE WHEN event_type IN ('view', 'purchase') THEN
      CASE WHEN value < 30 THEN 'opened' WHEN value < 70 THEN 'closed' ELSE 'reopened' END
    END AS payload_action,
    CASE WHEN event_type = 'click' AND k < 90 AND value >= 5
         THEN CAST(floor(value / 60) AS INTEGER) END AS payload_commits,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_text,
    date_trunc('second', ts) AS created_at
  FROM ev
),
first_delivery AS (
  SELECT sha256(concat_ws('|', type, actor_login, repo_full_name, created_text)) AS event_id,
    type AS event_type, actor_login, actor_id, repo_full_name, repo_id, created_at,
    CAST(created_at AS DATE) AS event_date, payload_action, payload_commits,
    split_part(repo_full_name, '/', 1) AS org_name, split_part(repo_full_name, '/', 2) AS repo_name,
    date_trunc('hour', created_at) + INTERVAL 1 HOUR AS ingested_at
  FROM bronze WHERE type <> 'CreateEvent'
),
silver AS (
  SELECT * FROM first_delivery
  UNION ALL
  SELECT * REPLACE (date_trunc('day', created_at) + INTERVAL 26 HOUR AS ingested_at)
  FROM first_delivery WHERE hour(created_at) >= 18
),
staged AS (
  SELECT * FROM silver
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC,
    actor_id DESC NULLS LAST, payload_action DESC NULLS LAST, payload_commits DESC NULLS LAST,
    repo_id DESC NULLS LAST) = 1
),
sliced AS (
  SELECT *, DATE '2024-01-10' + CAST(10 * (date_diff('day', DATE '2024-01-01', event_date) // 10)
    AS INTEGER) AS snapshot_date FROM staged
)"""

PARTS = """
parts AS (
  SELECT *, CAST(substr(p_brand, 7) AS INTEGER) AS brand,
    'org' || (p_partkey % 10) AS org, 'repo' || p_partkey AS repo,
    'org' || (p_partkey % 10) || '/repo' || p_partkey AS repo_full_name,
    CASE p_type WHEN 'PROMO' THEN 'discovered' ELSE lower(p_type) END AS category,
    split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2
  FROM part
),
fetched AS (
  SELECT repo_full_name,
    CASE WHEN p_size <= 45 THEN p_size > 12 END AS is_maintained,
    CASE WHEN brand < 25 THEN brand > 3 END AS has_license,
    brand > 8 AS is_branch_protected,
    brand > 14 AS requires_code_review,
    p_size BETWEEN 10 AND 35 AS has_security_policy,
    CASE WHEN p_size <= 47 THEN p_size % 13 END AS vuln_count,
    CASE p_type WHEN 'SMALL' THEN NULL WHEN 'LARGE' THEN false ELSE true END AS vuln_data_available,
    brand < 16 AS has_dep_update_tool,
    CASE p_type WHEN 'ECONOMY' THEN 'Python' WHEN 'STANDARD' THEN 'Go' WHEN 'MEDIUM' THEN 'Rust'
      WHEN 'SMALL' THEN 'Kotlin' WHEN 'LARGE' THEN 'Haskell' ELSE 'C#' END AS language,
    CASE WHEN p_type = 'PROMO' THEN 'fetch failed' END AS error
  FROM parts
),
cards AS (SELECT * EXCLUDE (error) FROM fetched WHERE error IS NULL),
curated AS (SELECT * FROM parts WHERE category <> 'discovered')"""

CARDS = f"""
governance AS (
  SELECT repo_full_name, is_maintained, has_license, is_branch_protected, requires_code_review,
    has_security_policy,
    {rnd('''(((CASE WHEN is_maintained THEN 4 ELSE 0 END) + (CASE WHEN has_license THEN 2 ELSE 0 END)
      + (CASE WHEN is_branch_protected THEN 2 ELSE 0 END)
      + (CASE WHEN requires_code_review THEN 2 ELSE 0 END)
      + (CASE WHEN has_security_policy THEN 2 ELSE 0 END)) / 12.0::DOUBLE * 10.0::DOUBLE)''')}
      AS governance_score
  FROM cards
),
vulns AS (
  SELECT repo_full_name, vuln_count, vuln_data_available, has_dep_update_tool,
    CASE WHEN NOT vuln_data_available OR vuln_count IS NULL THEN 5.0::DOUBLE
      ELSE greatest(0.0::DOUBLE, 10.0::DOUBLE - vuln_count * 2.0::DOUBLE) END AS vuln_score,
    CASE WHEN has_dep_update_tool THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS dep_update_score
  FROM cards
),
security AS (
  SELECT *, {rnd("(vuln_score * 0.6::DOUBLE + dep_update_score * 0.4::DOUBLE)")} AS security_score
  FROM vulns
)"""


def health_chain(source: str, suffix: str = "", extra: str = "") -> str:
    """Six joined views per key, written the long way round."""
    keys = f"{extra}repo_full_name"
    grouped = f"{keys}, org_name, repo_name"
    log = "log10(1.0::DOUBLE + {0} * 50.0::DOUBLE) / log10(501.0::DOUBLE) * 10.0::DOUBLE"

    def scored(column: str, expr: str) -> str:
        return rnd(f"(CASE WHEN {column} IS NULL THEN 5.0::DOUBLE ELSE {expr} END)")

    def rate(column: str) -> str:
        return scored(column, f"least({log.format(column)}, 10.0::DOUBLE)")

    return f"""
commit_activity{suffix} AS (
  SELECT *, {rnd("(CAST(total_commits AS DOUBLE) / nullif(active_days, 0) * 7.0::DOUBLE)")}
    AS commits_per_week
  FROM (SELECT {grouped}, count(*) AS push_event_count,
      {n("sum(coalesce(payload_commits, 1))")} AS total_commits,
      count(DISTINCT actor_login) AS active_committers, count(DISTINCT event_date) AS active_days
    FROM {source} WHERE event_type = 'PushEvent' GROUP BY ALL)
),
issue_health{suffix} AS (
  SELECT *, CASE WHEN issues_opened = 0 THEN NULL WHEN issues_closed = 0 THEN 0.0::DOUBLE
    ELSE {rnd("(CAST(issues_closed AS DOUBLE) / least(issues_opened, issues_closed * 3))", 4)}
    END AS issue_resolution_rate
  FROM (SELECT {grouped}, count(*) FILTER (payload_action = 'opened') AS issues_opened,
      count(*) FILTER (payload_action = 'closed') AS issues_closed
    FROM {source} WHERE event_type = 'IssuesEvent' AND payload_action IN ('opened', 'closed')
    GROUP BY ALL)
),
pr_health{suffix} AS (
  SELECT *, {rnd("(CAST(prs_closed AS DOUBLE) / nullif(active_days, 0) * 7.0::DOUBLE)")}
      AS prs_closed_per_week,
    CASE WHEN prs_opened = 0 THEN NULL
      ELSE {rnd("(CAST(prs_closed AS DOUBLE) / prs_opened)", 4)} END AS pr_merge_rate
  FROM (SELECT {grouped}, count(*) FILTER (payload_action = 'opened') AS prs_opened,
      count(*) FILTER (payload_action = 'closed') AS prs_closed,
      count(DISTINCT event_date) AS active_days
    FROM {source} WHERE event_type = 'PullRequestEvent' AND payload_action IN ('opened', 'closed')
    GROUP BY ALL)
),
actors{suffix} AS (
  SELECT {grouped}, actor_login, {n("sum(coalesce(payload_commits, 1))")} AS actor_commits
  FROM {source} WHERE event_type = 'PushEvent' GROUP BY ALL
),
top3{suffix} AS (
  SELECT {keys}, {n("sum(actor_commits)")} AS top3_commits
  FROM (SELECT * FROM actors{suffix} QUALIFY row_number() OVER (
    PARTITION BY {keys} ORDER BY actor_commits DESC) <= 3) GROUP BY ALL
),
diversity{suffix} AS (
  SELECT t.*, top3_commits,
    {rnd("(CAST(top3_commits AS DOUBLE) / nullif(total_commits, 0))", 4)} AS bus_factor_risk
  FROM (SELECT {grouped}, {n("sum(actor_commits)")} AS total_commits,
      count(DISTINCT actor_login) AS contributor_count FROM actors{suffix} GROUP BY ALL) t
  LEFT JOIN top3{suffix} USING ({keys})
),
span{suffix} AS (
  SELECT {grouped}, count(DISTINCT event_date) AS data_days_available,
    min(event_date) AS first_event_date, max(event_date) AS last_event_date
  FROM {source} GROUP BY ALL
),
health{suffix} AS (
  SELECT m.*, coalesce(push_event_count, 0) AS push_event_count,
    coalesce(c.total_commits, 0) AS total_commits, coalesce(active_committers, 0) AS active_committers,
    coalesce(c.active_days, 0) AS active_days, commits_per_week,
    coalesce(issues_opened, 0) AS issues_opened, coalesce(issues_closed, 0) AS issues_closed,
    issue_resolution_rate, coalesce(prs_opened, 0) AS prs_opened,
    coalesce(prs_closed, 0) AS prs_closed, prs_closed_per_week, pr_merge_rate, contributor_count,
    bus_factor_risk, governance_score, is_maintained, has_license, is_branch_protected,
    requires_code_review, has_security_policy, security_score, vuln_count, vuln_data_available,
    has_dep_update_tool
  FROM span{suffix} m
  LEFT JOIN commit_activity{suffix} c USING ({keys})
  LEFT JOIN issue_health{suffix} i USING ({keys})
  LEFT JOIN pr_health{suffix} p USING ({keys})
  LEFT JOIN diversity{suffix} d USING ({keys})
  LEFT JOIN governance g USING (repo_full_name)
  LEFT JOIN security s USING (repo_full_name)
),
signals{suffix} AS (
  SELECT {grouped}, data_days_available, first_event_date, last_event_date,
    commits_per_week IS NOT NULL AS has_push_data,
    {rate("commits_per_week")} AS commit_score,
    {scored("issue_resolution_rate", "least(issue_resolution_rate, 1.0::DOUBLE) * 10.0::DOUBLE")}
      AS issue_score,
    {rate("prs_closed_per_week")} AS pr_score,
    {scored("contributor_count",
            "least(CAST(contributor_count AS DOUBLE) / 20.0::DOUBLE, 1.0::DOUBLE) * 10.0::DOUBLE")}
      AS contributor_score,
    {scored("bus_factor_risk", "(1.0::DOUBLE - bus_factor_risk) * 10.0::DOUBLE")}
      AS bus_factor_score,
    coalesce(governance_score, 5.0::DOUBLE) AS governance_score,
    coalesce(security_score, 5.0::DOUBLE) AS security_score,
    coalesce(vuln_data_available, false) AS vuln_data_available
  FROM health{suffix}
),
scores{suffix} AS (
  SELECT *, {rnd('''(commit_score * 0.20::DOUBLE + issue_score * 0.15::DOUBLE + pr_score * 0.15::DOUBLE
    + contributor_score * 0.15::DOUBLE + bus_factor_score * 0.00::DOUBLE
    + governance_score * 0.20::DOUBLE + security_score * 0.15::DOUBLE)''')} AS health_score
  FROM signals{suffix}
)"""


REPORTS = f"""
trended AS (
  SELECT *, lag(health_score) OVER w AS prev_health_score,
    {rnd("(health_score - lag(health_score) OVER w)")} AS health_trend
  FROM scores_s WINDOW w AS (PARTITION BY repo_full_name ORDER BY snapshot_date)
),
risked AS (
  SELECT *, (10.0::DOUBLE - greatest(0.0::DOUBLE, least(10.0::DOUBLE, health_score)))
      / 10.0::DOUBLE AS raw_risk,
    CASE WHEN health_score >= 7 THEN 'Healthy' WHEN health_score >= 5 THEN 'Warning'
      ELSE 'Critical' END AS band,
    CAST(substr(repo_name, 5) AS BIGINT) // 10 AS batch
  FROM trended
),
recs AS (
  SELECT *, {rnd("raw_risk", 4)} AS risk_score,
    CASE WHEN raw_risk >= 0.65 THEN 'REPLACE' WHEN raw_risk >= 0.5 THEN 'UPGRADE'
      ELSE 'MONITOR' END AS action,
    snapshot_date || 'T' || lpad(CAST(batch // 3600 AS VARCHAR), 2, '0') || ':'
      || lpad(CAST((batch // 60) % 60 AS VARCHAR), 2, '0') || ':'
      || lpad(CAST(batch % 60 AS VARCHAR), 2, '0') || '+00:00' AS run_ts,
    CASE band WHEN 'Healthy' THEN ''
      WHEN 'Warning' THEN '1. **Signal** — commits score ' || CAST(commit_score AS VARCHAR)
        || chr(10) || chr(10) || '2. **Advice** — watch it.'
      ELSE 'Look for a replacement.' END AS assessment
  FROM risked
),
filed AS (
  SELECT *, 'risk_report_' || replace(substr(run_ts, 1, 19), ':', '-') || '.md' AS file_name,
    format('{{:.2f}}', risk_score) AS risk_text,
    '- **Health score:** ' || CAST(health_score AS VARCHAR) || '/10  |  **Risk score:** '
      || format('{{:.2f}}', risk_score)
      || CASE WHEN health_trend IS NULL THEN '' ELSE '  (trend: '
         || format('{{:+.2f}}', health_trend) || ')' END AS metrics
  FROM recs
),
records AS (
  SELECT repo_full_name, action AS recommendation, health_score,
    CAST(risk_text AS DOUBLE) AS risk_score, assessment AS assessment_text,
    CAST(snapshot_date AS VARCHAR) AS report_date, file_name AS report_file
  FROM filed
)"""

PACKAGES = f"""
pk AS (
  SELECT p_partkey, p_size, p_type,
    CASE p_type WHEN 'SMALL' THEN 'node' WHEN 'MEDIUM' THEN 'go' WHEN 'LARGE' THEN 'rust'
      WHEN 'STANDARD' THEN 'java' ELSE 'python' END AS ecosystem,
    CASE p_type
      WHEN 'ECONOMY' THEN CASE p_size WHEN 50 THEN 'Pandas' WHEN 49 THEN 'NumPy'
        ELSE replace(p_name, ' ', '-') || p_partkey END
      WHEN 'SMALL' THEN '@js/' || replace(p_name, ' ', '-') || p_partkey
      WHEN 'MEDIUM' THEN CASE WHEN p_size < 10
          THEN 'golang.org/x/' || replace(p_name, ' ', '-') || p_partkey || '/v2'
        WHEN p_size < 20 THEN 'gopkg.in/' || replace(p_name, ' ', '-') || p_partkey
        ELSE 'github.com/' || {repo("p_partkey")} || '/v2' END
      WHEN 'LARGE' THEN replace(p_name, ' ', '-') || '_' || p_partkey
      WHEN 'STANDARD' THEN 'com.' || replace(p_name, ' ', '-') || ':a' || p_partkey
      ELSE 'promo-' || p_partkey END AS name,
    {repo("(p_partkey // 2)")} AS target, {repo("p_partkey")} AS own,
    replace(p_name, ' ', '-') || p_partkey AS dashed
  FROM part
),
hits AS (
  SELECT *,
    CASE
      WHEN p_size < 3 AND NOT (p_type = 'ECONOMY' AND p_size >= 49) THEN NULL
      WHEN p_size <= 8 THEN ['cached/repo' || (p_partkey // 3), 'npm', 'high']
      WHEN p_type = 'ECONOMY' AND p_size = 50 THEN ['pandas-dev/pandas', 'known_mapping', 'high']
      WHEN p_type = 'ECONOMY' AND p_size = 49 THEN ['numpy/numpy', 'known_mapping', 'high']
      WHEN ecosystem = 'python' AND p_size < 25 THEN [target, 'pypi', 'high']
      WHEN ecosystem = 'python' AND p_size % 2 = 0 THEN [target, 'pypi', 'medium']
      WHEN ecosystem = 'node' AND p_size < 30 THEN [target, 'npm', 'high']
      WHEN ecosystem = 'node' AND p_size % 2 = 0 THEN [target, 'npm', 'medium']
      WHEN ecosystem = 'rust' AND (p_size < 30 OR p_size % 2 = 0) THEN [target, 'crates', 'high']
      WHEN ecosystem = 'go' AND p_size < 10 THEN ['golang/' || dashed, 'go_module', 'high']
      WHEN ecosystem = 'go' AND p_size >= 20 THEN [own, 'go_module', 'high']
      WHEN p_size > 40 THEN [target, 'github_search', 'low']
    END AS hit
  FROM pk
),
deps AS (
  SELECT l_orderkey AS manifest, l_linenumber AS pos, ecosystem, name, hit
  FROM lineitem JOIN hits ON l_partkey = p_partkey
),
found AS (
  SELECT ecosystem, name, hit[1] AS full_name, hit[2] AS source, hit[3] AS confidence,
    count(*) AS occurrences, min((manifest, pos)) AS first
  FROM deps GROUP BY ALL
),
resolved AS (
  SELECT *, CASE WHEN full_name IS NULL THEN 'unresolved'
      WHEN full_name IN (SELECT repo_full_name FROM curated) THEN 'monitored'
      WHEN row_number() OVER (PARTITION BY full_name ORDER BY first, ecosystem, name) = 1
        THEN 'resolved' ELSE 'repeated' END AS status
  FROM found
)"""

PRELUDE = "WITH " + ",".join(
    [
        EVENTS,
        PARTS,
        CARDS,
        health_chain("staged"),
        health_chain("sliced", "_s", "snapshot_date, "),
        REPORTS,
        PACKAGES,
    ]
)

"""Schemas of the tables at rest, as Spark DDL."""

CORRUPT = "_corrupt_record"

# The event types that are kept.
EVENT_TYPES = (
    "PushEvent",
    "IssuesEvent",
    "PullRequestEvent",
    "IssueCommentEvent",
    "WatchEvent",
    "ForkEvent",
)

# One line of a public event dump. Fields not named here are dropped by the
# reader; created_at stays a string because the event key hashes the raw text.
BRONZE = """
    id STRING,
    type STRING,
    actor STRUCT<id: BIGINT, login: STRING, display_login: STRING,
                 gravatar_id: STRING, url: STRING, avatar_url: STRING>,
    repo STRUCT<id: BIGINT, name: STRING, url: STRING>,
    payload STRUCT<action: STRING, ref: STRING, ref_type: STRING, push_id: BIGINT,
                   size: INT, distinct_size: INT,
                   commits: ARRAY<STRUCT<sha: STRING, message: STRING, distinct: BOOLEAN>>,
                   number: INT>,
    public BOOLEAN,
    created_at STRING,
    org STRUCT<id: BIGINT, login: STRING>
"""
BRONZE_READ = f"{BRONZE.rstrip()}, {CORRUPT} STRING"

SILVER = """
    event_id STRING NOT NULL,
    event_type STRING,
    actor_login STRING,
    actor_id BIGINT,
    repo_full_name STRING,
    repo_id BIGINT,
    created_at TIMESTAMP,
    event_date DATE,
    payload_action STRING,
    payload_commits INT,
    org_name STRING,
    repo_name STRING,
    ingested_at TIMESTAMP
"""
SILVER_COLUMNS = [line.split()[0] for line in SILVER.strip().splitlines()]

SCORECARD_COLUMNS = [
    "repo_full_name",
    "is_maintained",
    "has_license",
    "is_branch_protected",
    "requires_code_review",
    "has_security_policy",
    "vuln_count",
    "vuln_data_available",
    "has_dep_update_tool",
    "language",
    "fetched_at",
]

SIGNALS = [
    "commit_score",
    "issue_score",
    "pr_score",
    "contributor_score",
    "bus_factor_score",
    "governance_score",
    "security_score",
    "health_score",
]

# The columns of the downloadable score table.
EXPORT_COLUMNS = [
    "repo_full_name",
    "health_score",
    "commit_score",
    "issue_score",
    "pr_score",
    "contributor_score",
    "bus_factor_score",
    "data_days_available",
]

DEPENDENCY = "file_name STRING, pos INT, name STRING, version STRING, ecosystem STRING"

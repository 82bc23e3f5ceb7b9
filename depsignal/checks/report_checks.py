"""Reports, records and vector search."""

from pyspark.sql import functions as F

from depsignal.checks import tables as t
from depsignal.checks.prelude import rnd
from depsignal.checks.registry import check
from depsignal.operators import reports, vector_index, vectors
from depsignal.plans.assessment import index_records
from depsignal.session import scratch_path
from depsignal.sources.tables import materialize_once

_RECORD = """repo_full_name, recommendation, health_score, risk_score, assessment_text, report_date,
  report_file"""


RENDERED = """+ blocks AS (SELECT run_ts, file_name, action, string_agg('### ' || repo_full_name || E'\\n\\n'
        || metrics || E'\\n\\n' || assessment || E'\\n\\n---\\n', E'\\n'
        ORDER BY risk_score DESC, repo_full_name) AS block, count(*) AS c FROM filed GROUP BY ALL),
    wide AS (SELECT run_ts, file_name,
        coalesce(max(c) FILTER (action = 'REPLACE'), 0) AS r, max(block) FILTER (action = 'REPLACE') AS rb,
        coalesce(max(c) FILTER (action = 'UPGRADE'), 0) AS u, max(block) FILTER (action = 'UPGRADE') AS ub,
        coalesce(max(c) FILTER (action = 'MONITOR'), 0) AS m, max(block) FILTER (action = 'MONITOR') AS mb
      FROM blocks GROUP BY ALL),
    rendered AS (
    SELECT run_ts, file_name, E'# Dependency Risk Report\\n\\n**Generated:** ' || run_ts
      || E'\\n**Projects assessed:** ' || (r + u + m) || E'\\n**Summary:** ' || r || ' REPLACE  |  ' || u
      || ' UPGRADE  |  ' || m || E' MONITOR\\n\\n---\\n'
      || coalesce(E'\\n## Critical — Replace\\n\\n' || rb, '')
      || coalesce(E'\\n## Warning — Upgrade\\n\\n' || ub, '')
      || coalesce(E'\\n## Monitor\\n\\n' || mb, '') AS content FROM wide)"""


@check("txt13_render_report", RENDERED + " SELECT * FROM rendered")
def txt13(spark, sf):
    return reports.render_report(t.recommendations(spark, sf))


@check(
    "txt13_report_blocks",
    """SELECT run_ts, CASE action WHEN 'REPLACE' THEN 0 WHEN 'UPGRADE' THEN 1 ELSE 2 END AS section,
      risk_score, repo_full_name, action, '### ' || repo_full_name || E'\\n\\n' || metrics || E'\\n\\n'
        || assessment || E'\\n\\n---\\n' AS block FROM filed""",
)
def txt13_blocks(spark, sf):
    return reports.report_blocks(t.recommendations(spark, sf))


@check(
    "agg19_action_counts",
    """SELECT run_ts, count(*) AS assessed, count(*) FILTER (action = 'REPLACE') AS replace,
      count(*) FILTER (action = 'UPGRADE') AS upgrade, count(*) FILTER (action = 'MONITOR') AS monitor
    FROM recs GROUP BY ALL""",
)
def agg19(spark, sf):
    return reports.action_counts(t.recommendations(spark, sf), ["run_ts"])


@check("txt10_parse_reports", f"SELECT {_RECORD} FROM records")
def txt10(spark, sf):
    return reports.parse_reports(t.reports(spark, sf))


@check(
    "txt11_report_sections",
    """SELECT file_name, repo_full_name, action, metrics || E'\\n\\n' || assessment || E'\\n\\n---' AS text
    FROM filed WHERE action = 'UPGRADE'""",
)
def txt11(spark, sf):
    return reports.report_sections(t.reports(spark, sf), action="UPGRADE")


@check(
    "txt12_report_distribution",
    """SELECT file_name, count(*) FILTER (action = 'REPLACE') AS replace,
      count(*) FILTER (action = 'UPGRADE') AS upgrade, count(*) FILTER (action = 'MONITOR') AS monitor
    FROM filed GROUP BY ALL""",
)
def txt12(spark, sf):
    # the second snapshot has lost its summary lines, so its sections are counted
    content = F.when(
        F.col("file_name").startswith("risk_report_2024-01-20"),
        F.regexp_replace("content", r"\*\*Summary:[^\n]*\n", ""),
    ).otherwise(F.col("content"))
    return reports.report_distribution(t.reports(spark, sf).withColumn("content", content))




@check(
    "agg20_report_meta",
    f"""{RENDERED}
    SELECT file_name, substr(run_ts, 1, 10) || ' ' || substr(run_ts, 12, 8) AS timestamp,
      CAST(len(regexp_extract_all(content, '(?m)^### .+')) AS BIGINT) AS project_count,
      CAST(round_even(CAST(strlen(content) AS DOUBLE) / 1024, 1) AS DOUBLE) AS size_kb FROM rendered""",
)
def agg20(spark, sf):
    return reports.report_meta(t.reports(spark, sf))


@check(
    "txt15_fallback_text",
    """SELECT *, substr(assessment_text, 1, 300) AS excerpt,
      substr(sha256(repo_full_name || '|' || report_file), 1, 40) AS vec_id
    FROM (SELECT * REPLACE (CASE WHEN trim(assessment_text) = '' THEN repo_full_name || ' — health score '
      || printf('%.1f', CAST(round(CAST(CAST(health_score AS VARCHAR) AS DECIMAL(9,4)), 1) AS DOUBLE))
      || '/10, recommendation: ' || recommendation
      || '. No detailed assessment text was captured for this project in this report.'
      ELSE assessment_text END AS assessment_text) FROM records)""",
)
def txt15(spark, sf):
    return index_records(t.reports(spark, sf))


_SIDE = "SELECT repo_full_name, recommendation AS action FROM records WHERE report_date = '{0}'"


@check(
    "jon7_compare_reports",
    f"""SELECT coalesce(a.repo_full_name, b.repo_full_name) AS repo_full_name,
      coalesce(a.action, '—') AS action_a, coalesce(b.action, '—') AS action_b,
      coalesce(a.action, '—') <> coalesce(b.action, '—') AS changed
    FROM ({_SIDE.format("2024-01-10")}) a FULL JOIN ({_SIDE.format("2024-01-20")}) b
      ON a.repo_full_name = b.repo_full_name""",
)
def jon7(spark, sf):
    records = materialize_once(reports.parse_reports(t.reports(spark, sf)))
    return reports.compare_reports(
        records.filter("report_date = '2024-01-10'"), records.filter("report_date = '2024-01-20'")
    )


@check(
    "jon8_assessed_flag",
    """SELECT repo_full_name, health_score, repo_full_name IN (SELECT repo_full_name FROM records
      WHERE recommendation <> 'MONITOR') AS assessed FROM scores""",
)
def jon8(spark, sf):
    records = reports.parse_reports(t.reports(spark, sf)).filter("recommendation <> 'MONITOR'")
    scored = t.scored(spark, sf).select("repo_full_name", "health_score")
    return reports.assessed_flag(scored, records)


@check(
    "jon11_latest_assessment",
    """SELECT repo_full_name, report_file, assessment_text FROM records
    WHERE report_file IN (SELECT DISTINCT report_file FROM records ORDER BY report_file DESC LIMIT 5)
    QUALIFY row_number() OVER (PARTITION BY repo_full_name ORDER BY report_file DESC) = 1""",
)
def jon11(spark, sf):
    return reports.latest_assessment(
        materialize_once(reports.parse_reports(t.reports(spark, sf)))
    )


@check(
    "txt14_assessment_brief",
    """+ it AS (SELECT 'org' || (o_custkey % 10) || '/repo' || o_custkey AS repo_full_name, o_orderkey,
        o_orderpriority LIKE '1%' AS pr, o_totalprice > 400000 AS draft,
        strftime(o_orderdate, '%Y-%m-%d') AS u, CAST(floor(o_totalprice / 10000) AS INTEGER) AS comments,
        CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN ', labels: ' || o_orderpriority ELSE '' END AS labels
      FROM orders WHERE o_orderstatus <> 'F'),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_full_name, pr ORDER BY u DESC, o_orderkey DESC)
      AS rn FROM it),
    listed AS (SELECT repo_full_name,
        string_agg('  - #' || o_orderkey || ': Order ' || o_orderkey || ' (' || comments || ' comments' || labels
          || ')', E'\\n' ORDER BY rn) FILTER (NOT pr AND rn <= 5) AS issues,
        string_agg('  - #' || o_orderkey || ': Order ' || o_orderkey
          || CASE WHEN draft THEN ' [draft]' ELSE '' END, E'\\n' ORDER BY rn) FILTER (pr AND rn <= 3) AS prs
      FROM ranked GROUP BY ALL),
    meta AS (SELECT 'org' || (c_custkey % 10) || '/repo' || c_custkey AS repo_full_name, * FROM customer)
    SELECT repo_full_name, concat_ws(E'\\n', 'Dependency under review: ' || repo_full_name,
      E'\\n## Scores (0 to 10, higher is healthier)',
      CASE WHEN has_push_data THEN '' ELSE E'\\nNote: no push events in this period. The commit and contributor '
        || E'scores are the neutral 5.00 and say nothing about real activity.\\n' END,
      E'| Signal | Score | Notes |\\n|---|---|---|',
      '| Overall health | ' || format('{:.2f}', health_score) || ' |  |',
      '| Commit frequency | ' || format('{:.2f}', commit_score) || ' | '
        || CASE WHEN has_push_data THEN '' ELSE 'estimated, no push data' END || ' |',
      '| Issue resolution | ' || format('{:.2f}', issue_score) || ' |  |',
      '| Pull-request throughput | ' || format('{:.2f}', pr_score) || ' |  |',
      '| Contributor diversity | ' || format('{:.2f}', contributor_score) || ' | '
        || CASE WHEN has_push_data THEN '' ELSE 'estimated, no push data' END || ' |',
      '| Bus factor (inverted) | ' || format('{:.2f}', bus_factor_score) || ' |  |',
      E'\\nHealth trend: N/A', E'\\n## Repository',
      '- Stars: ' || coalesce(format('{:,}', CAST(floor(abs(c_acctbal) * 10) AS BIGINT)), 'N/A'),
      '- Open issues: ' || coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_nationkey AS VARCHAR) END, 'N/A'),
      '- Forks: ' || coalesce(format('{:,}', c_custkey), 'N/A'),
      '- Language: ' || coalesce(lower(c_mktsegment), 'N/A'),
      '- Archived: ' || CASE WHEN c_nationkey = 0 THEN 'true' ELSE 'false' END,
      '- Last push: ' || CASE WHEN c_acctbal > 0 THEN '2024-01-15T00:00:00Z' ELSE 'N/A' END,
      E'\\n## Open issues (up to 5)', coalesce(issues, '  None retrieved.'),
      E'\\n## Open pull requests (up to 3)', coalesce(prs, '  None retrieved.')) AS brief
    FROM scores LEFT JOIN meta USING (repo_full_name) LEFT JOIN listed USING (repo_full_name)""",
)
def txt14(spark, sf):
    return reports.assessment_brief(t.scored(spark, sf), t.signals(spark, sf))


def _query_vector(spark, sf):
    """One vector of the table stands in for an embedded question."""
    row = t.table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding", "label").first()
    return row["embedding"], row["label"]


@check(
    "vec1_cosine_topk",
    f"""+ q AS (SELECT CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, e.label, {rnd("list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v)", 4)} AS similarity
    FROM embeddings e JOIN q ON e.label = q.label
    ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v) DESC, vec_id LIMIT 10""",
)
def vec1(spark, sf):
    query, label = _query_vector(spark, sf)
    found = vectors.cosine_topk(
        t.table(spark, sf, "embeddings"), query, 10, label, "label", range(10)
    )
    return found.drop("embedding")


@check(
    "vec1_cosine_topk_all",
    f"""+ q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, e.label, {rnd("list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM q))", 4)}
      AS similarity FROM embeddings e
    ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)) DESC, vec_id LIMIT 50""",
)
def vec1_all(spark, sf):
    query, _ = _query_vector(spark, sf)
    return vectors.cosine_topk(t.table(spark, sf, "embeddings"), query, 50).drop("embedding")


_EVERY_HUNDREDTH = f"""+ q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id % 100 = 0),
    r AS (SELECT query, vec_id AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v) AS s FROM q, embeddings e WHERE 1 = 1 {{0}}),
    p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS INTEGER) AS place FROM r)
    SELECT query, id, {rnd("s", 4)} AS similarity, place FROM p WHERE place <= 10"""


def _index(spark, sf):
    found = t.table(spark, sf, "embeddings")
    return vector_index.build_index(found, scratch_path(spark, "vector-lists"), 16), found.filter("vec_id % 100 = 0")


@check("vec1_topk_many", _EVERY_HUNDREDTH.format(""))
def vec1_many(spark, sf):
    index, queries = _index(spark, sf)
    return vector_index.search(index, queries, 10)


@check("vec1_topk_many_label", _EVERY_HUNDREDTH.format("AND e.label = 3"))
def vec1_many_label(spark, sf):
    index, queries = _index(spark, sf)
    return vector_index.search(index, queries, 10, label=3)


@check("vec1_index_recall", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def vec1_recall(spark, sf):
    """Whether the lists that are looked into hold 95 % of the exact answers of all queries."""
    index, queries = _index(spark, sf)
    probes = vector_index.fewest_probes(index, queries, 10, 0.95)
    exact = materialize_once(vector_index.search(index, queries, 10))
    share = vector_index.recall(vector_index.search(index, queries, 10, probes), exact)
    return queries.agg(F.count(F.lit(1)).alias("queries")).withColumn("enough", F.lit(share >= 0.95))


@check(
    "agg21_index_stats",
    """SELECT CAST(label AS VARCHAR) AS namespace, count(*) AS vectors FROM embeddings GROUP BY ALL
    UNION ALL SELECT 'all', count(*) FROM embeddings""",
)
def agg21(spark, sf):
    return vectors.index_stats(t.table(spark, sf, "embeddings"), "label")

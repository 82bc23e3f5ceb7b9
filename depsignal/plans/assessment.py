"""Scores to reports and searchable records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsignal.functions.names import vector_key
from depsignal.operators.portfolio import flagged
from depsignal.operators.reports import fallback_text, parse_reports, render_report
from depsignal.operators.scoring import recommend


def assess(scores: DataFrame, texts: DataFrame, run_ts: str, **bounds) -> DataFrame:
    """Report of one run: flagged repositories that have an assessment text, and texts without a score row.

    The latter are reported with an unknown score, for which
    ``recommend`` gives the middle risk and MONITOR.
    """
    chosen = flagged(scores, **bounds).join(texts, "repo_full_name")
    unscored = texts.join(scores.select("repo_full_name"), "repo_full_name", "left_anti")
    chosen = chosen.unionByName(unscored, allowMissingColumns=True)
    return render_report(recommend(chosen).withColumn("run_ts", F.lit(run_ts)))


def index_records(reports: DataFrame) -> DataFrame:
    """Records of reports with their stable vector id, ready for embedding."""
    records = fallback_text(parse_reports(reports))
    return records.withColumn(
        "vec_id", vector_key(F.col("repo_full_name"), F.col("report_file"))
    )

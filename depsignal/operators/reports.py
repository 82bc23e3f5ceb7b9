"""Markdown risk reports: rendering, parsing, comparing, indexing."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depsignal.functions.numeric import fixed_2
from depsignal.functions.text import blank, lines, strip

# Report sections in reading order, with their action.
SECTIONS = (
    ("REPLACE", "Critical — Replace"),
    ("UPGRADE", "Warning — Upgrade"),
    ("MONITOR", "Monitor"),
)

# Patterns of a report.
HEALTH = r"\*\*Health score:\*\*\s*([\d.]+)"
RISK = r"\*\*Risk score:\*\*\s*([\d.]+)"
DATE = r"(\d{4}-\d{2}-\d{2})"
SUMMARY = (
    r"(?i)\*\*Summary:\*\*\s+(\d+)\s+REPLACE\s+\|\s*(\d+)\s+UPGRADE\s+\|\s*(\d+)\s+MONITOR"
)
H2, H3 = r"(?md)^(?=## .)", r"(?md)^(?=### .)"


# -- rendering ---------------------------------------------------------------


def _lookup(c: Column, pairs) -> Column:
    out = F.lit(None).cast("string")
    for key, value in reversed(pairs):
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def _section_rank() -> Column:
    out = F.lit(None).cast("int")
    for i, (action, _) in enumerate(SECTIONS):
        out = F.when(F.col("action") == action, F.lit(i)).otherwise(out)
    return out


def _repo_block() -> Column:
    score = F.coalesce(F.col("health_score").cast("string"), F.lit("None"))
    trend = F.when(
        F.col("health_trend").isNotNull(),
        F.format_string("  (trend: %+.2f)", F.col("health_trend")),
    ).otherwise("")
    metrics = F.concat(
        F.lit("- **Health score:** "),
        score,
        F.lit("/10  |  **Risk score:** "),
        fixed_2(F.col("risk_score")),
        trend,
    )
    text = F.coalesce("assessment", F.lit("No assessment available."))
    gap = F.lit("\n\n")
    return F.concat(
        F.lit("### "), F.col("repo_full_name"), gap, metrics, gap, text, F.lit("\n\n---\n")
    )


def report_blocks(recs: DataFrame, run: str = "run_ts") -> DataFrame:
    """One text block per assessed repository with its place in the report.

    This is the form without a size limit: write it sorted by run, section,
    falling risk and name to get a report of any length.
    """
    return recs.select(
        run,
        _section_rank().alias("section"),
        "risk_score",
        "repo_full_name",
        "action",
        _repo_block().alias("block"),
    )


def action_counts(recs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Recommendations per action, over all or per group."""
    actions = [a for a, _ in SECTIONS]
    return recs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("assessed"),
        *[F.count_if(F.col("action") == a).alias(a.lower()) for a in actions],
    )


def render_report(
    recs: DataFrame, run: str = "run_ts", title: str = "Dependency Risk Report"
) -> DataFrame:
    """One Markdown text per run.

    A run covers the flagged repositories of one request and ends up in one
    file, so its size is bounded by the request; for anything larger use
    ``report_blocks``.
    """
    section = F.struct(
        "section", (-F.col("risk_score")).alias("falling"), "repo_full_name", "action", "block"
    )
    grouped = report_blocks(recs, run).groupBy(run).agg(
        F.sort_array(F.collect_list(section)).alias("_blocks"),
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col("action") == a).alias(a) for a, _ in SECTIONS],
    )
    head = F.concat(
        F.lit(f"# {title}\n\n**Generated:** "),
        F.col(run),
        F.lit("\n**Projects assessed:** "),
        F.col("_n").cast("string"),
        F.lit("\n**Summary:** "),
        F.array_join(
            F.array(*[F.concat(F.col(a).cast("string"), F.lit(f" {a}")) for a, _ in SECTIONS]),
            "  |  ",
        ),
        F.lit("\n\n---\n"),
    )
    parts = []
    for action, heading in SECTIONS:
        blocks = F.transform(
            F.filter("_blocks", lambda b: b.getField("action") == action),
            lambda b: b.getField("block"),
        )
        parts.append(
            F.when(
                F.col(action) > 0,
                F.concat(F.lit(f"\n## {heading}\n\n"), F.array_join(blocks, "\n")),
            ).otherwise("")
        )
    return grouped.select(
        run,
        report_file_name(F.col(run)).alias("file_name"),
        F.concat(head, *parts).alias("content"),
    )


def report_file_name(run: Column) -> Column:
    dashed = F.replace(F.replace(run, F.lit(":"), F.lit("-")), F.lit("+"), F.lit("Z"))
    return F.concat(F.lit("risk_report_"), F.substring(dashed, 1, 19), F.lit(".md"))


def _number(c: Column, template: str = "%,d") -> Column:
    return F.when(c.isNotNull(), F.format_string(template, c)).otherwise("N/A")


def assessment_brief(scored: DataFrame, signals: DataFrame, n_issues: int = 5, n_pulls: int = 3) -> DataFrame:
    """Text per repository that gathers scores and recent activity for a reviewer.

    ``signals`` holds stars, forks, open_issues, language, archived, pushed_at
    and the arrays issues and prs; the first ``n_issues`` and ``n_pulls`` of them are shown.
    """

    none = F.lit("")

    def row(label, column, note=none):
        value = _number(F.col(column), "%.2f")
        return F.concat(F.lit(f"| {label} | "), value, F.lit(" | "), note, F.lit(" |"))

    pushless = ~F.coalesce("has_push_data", F.lit(True))
    estimate = F.when(pushless, "estimated, no push data").otherwise("")
    notice = F.when(
        pushless,
        "\nNote: no push events in this period. The commit and contributor scores are the "
        "neutral 5.00 and say nothing about real activity.\n",
    ).otherwise("")

    def issue(i):
        labels = F.concat(F.lit(", labels: "), F.array_join(i["labels"], ", "))
        return F.concat(
            F.format_string("  - #%d: %s (%d comments", i["number"], i["title"], i["comments"]),
            F.when(F.size(i["labels"]) > 0, labels).otherwise(""),
            F.lit(")"),
        )

    def pull(p):
        return F.concat(
            F.format_string("  - #%d: %s", p["number"], p["title"]),
            F.when(p["draft"], " [draft]").otherwise(""),
        )

    def listing(column, n, fn, empty):
        shown = F.transform(F.slice(F.col(column), 1, n), fn)
        return F.when(F.size(shown) > 0, F.array_join(shown, "\n")).otherwise(empty)

    def plain(label, value):
        return F.concat(F.lit(f"- {label}: "), value)

    def missing(column):
        return F.coalesce(F.col(column).cast("string"), F.lit("N/A"))

    parts = [
        F.concat(F.lit("Dependency under review: "), F.col("repo_full_name")),
        F.lit("\n## Scores (0 to 10, higher is healthier)"),
        notice,
        F.lit("| Signal | Score | Notes |\n|---|---|---|"),
        row("Overall health", "health_score"),
        row("Commit frequency", "commit_score", estimate),
        row("Issue resolution", "issue_score"),
        row("Pull-request throughput", "pr_score"),
        row("Contributor diversity", "contributor_score", estimate),
        row("Bus factor (inverted)", "bus_factor_score"),
        F.concat(F.lit("\nHealth trend: "), _number(F.col("health_trend"), "%.2f")),
        F.lit("\n## Repository"),
        plain("Stars", _number(F.col("stars"))),
        plain("Open issues", _number(F.col("open_issues"))),
        plain("Forks", _number(F.col("forks"))),
        plain("Language", missing("language")),
        plain("Archived", F.coalesce(F.col("archived"), F.lit(False)).cast("string")),
        plain("Last push", missing("pushed_at")),
        F.lit(f"\n## Open issues (up to {n_issues})"),
        listing("issues", n_issues, issue, "  None retrieved."),
        F.lit(f"\n## Open pull requests (up to {n_pulls})"),
        listing("prs", n_pulls, pull, "  None retrieved."),
    ]
    joined = scored.join(signals, "repo_full_name", "left")
    return joined.select("repo_full_name", F.concat_ws("\n", *parts).alias("brief"))


# -- parsing -----------------------------------------------------------------


def _after_heading(section: Column) -> Column:
    return F.regexp_replace(section, r"^[^\n]*\n?", "")


def _heading(section: Column, level: int) -> Column:
    return strip(F.regexp_extract(section, rf"(?d)^#{{{level}}} (.+)", 1))


def _score(body: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(body, pattern, 1).try_cast("double"), F.lit(0.0))


def _assessment(body: Column) -> Column:
    def kept(line):
        bare = strip(line)
        return ~(bare.startswith("- **Health score") | (bare == "---"))

    return strip(F.array_join(F.filter(lines(body), kept), "\n"))


def _sections(reports: DataFrame) -> DataFrame:
    """Rows of (file_name, place, h2 heading, repo heading, body)."""
    h2 = reports.select("file_name", F.posexplode(F.split("content", H2)).alias("s2", "part"))
    h2 = h2.filter(F.col("part").startswith("## "))
    h3 = h2.select(
        "file_name",
        "s2",
        _heading(F.col("part"), 2).alias("heading"),
        F.posexplode(F.split(_after_heading(F.col("part")), H3)).alias("s3", "section"),
    ).filter(F.col("section").startswith("### "))
    return h3.select(
        "file_name",
        "s2",
        "s3",
        "heading",
        _heading(F.col("section"), 3).alias("repo_full_name"),
        _after_heading(F.col("section")).alias("body"),
    )


def parse_reports(reports: DataFrame) -> DataFrame:
    """One record per repository section under a known heading."""
    action = _lookup(F.col("heading"), [(h, a) for a, h in SECTIONS])
    return (
        _sections(reports)
        .withColumn("recommendation", action)
        .filter(F.col("recommendation").isNotNull() & F.col("repo_full_name").contains("/"))
        .select(
            "repo_full_name",
            "recommendation",
            _score(F.col("body"), HEALTH).alias("health_score"),
            _score(F.col("body"), RISK).alias("risk_score"),
            _assessment(F.col("body")).alias("assessment_text"),
            F.regexp_extract("file_name", DATE, 1).alias("report_date"),
            F.col("file_name").alias("report_file"),
        )
    )


def report_sections(
    reports: DataFrame, repo: str | None = None, action: str | None = None
) -> DataFrame:
    """Section texts, of one repository or of all with one action."""
    rows = _sections(reports).withColumn(
        "action", _lookup(F.col("heading"), [(h, a) for a, h in SECTIONS])
    )
    if repo is not None:
        rows = rows.filter(F.col("repo_full_name") == repo)
    if action is not None:
        rows = rows.filter(F.col("action") == action)
    return rows.select("file_name", "repo_full_name", "action", strip(F.col("body")).alias("text"))


def report_distribution(reports: DataFrame) -> DataFrame:
    """Counts per action from the summary line, else by counting sections."""
    has_summary = F.col("content").rlike(SUMMARY)

    def stated(i):
        return F.regexp_extract("content", SUMMARY, i).try_cast("bigint")

    chunks = F.filter(F.split("content", r"(?md)^(?=##\s)"), lambda s: s.rlike(r"^##\s"))

    def counted(word):
        # a heading counts for the first of the three words it contains
        words = [a.lower() for a, _ in SECTIONS]
        earlier = words[: words.index(word)]

        def matches(s):
            title = F.lower(F.substring_index(s, "\n", 1))
            hit = title.contains(word)
            for other in earlier:
                hit = hit & ~title.contains(other)
            return hit

        return F.aggregate(
            F.filter(chunks, matches),
            F.lit(0).cast("bigint"),
            lambda n, s: n + F.regexp_count(s, F.lit(r"(?md)^###\s")).cast("bigint"),
        )

    return reports.select(
        "file_name",
        *[
            F.when(has_summary, stated(i + 1)).otherwise(counted(a.lower())).alias(a.lower())
            for i, (a, _) in enumerate(SECTIONS)
        ],
    )


def report_meta(reports: DataFrame) -> DataFrame:
    """Readable time, number of sections and size of each report file."""
    stem = F.regexp_replace(F.regexp_replace("file_name", r"\.md$", ""), "risk_report_", "")
    parts = F.split(stem, "T")
    readable = F.concat_ws(
        " ", F.get(parts, F.lit(0)), F.replace(F.get(parts, F.lit(1)), F.lit("-"), F.lit(":"))
    )
    return reports.select(
        "file_name",
        F.when(F.size(parts) == 2, readable).otherwise(stem).alias("timestamp"),
        F.regexp_count("content", F.lit(r"(?md)^### .+")).cast("bigint").alias("project_count"),
        # the quotient is exact, ties go to the even digit
        F.bround(F.octet_length("content") / 1024, 1).alias("size_kb"),
    )


# -- records -----------------------------------------------------------------


def fallback_text(records: DataFrame, excerpt_chars: int = 300) -> DataFrame:
    """Replace blank assessments by a sentence; add an excerpt beside the full text."""
    # fixed value: the sentence
    sentence = F.concat(
        F.col("repo_full_name"),
        F.format_string(" — health score %.1f/10, recommendation: ", F.col("health_score")),
        F.col("recommendation"),
        F.lit(". No detailed assessment text was captured for this project in this report."),
    )
    text = F.when(blank(F.col("assessment_text")), sentence).otherwise(F.col("assessment_text"))
    return records.withColumn("assessment_text", text).withColumn(
        "excerpt", F.substring("assessment_text", 1, excerpt_chars)
    )


def compare_reports(a: DataFrame, b: DataFrame) -> DataFrame:
    """Actions of two reports side by side, sorted by repository."""

    def side(df, name):
        return df.groupBy("repo_full_name").agg(F.max("recommendation").alias(name))

    def shown(c):
        return F.coalesce(c, F.lit("—")).alias(c)

    both = side(a, "action_a").join(side(b, "action_b"), "repo_full_name", "full_outer")
    return (
        both.select("repo_full_name", shown("action_a"), shown("action_b"))
        .withColumn("changed", F.col("action_a") != F.col("action_b"))
        .orderBy("repo_full_name")
    )


def changed_count(comparison: DataFrame) -> DataFrame:
    return comparison.agg(F.count_if("changed").alias("changed"))


def assessed_flag(scored: DataFrame, records: DataFrame) -> DataFrame:
    """Whether each scored repository occurs in any report."""
    seen = records.select("repo_full_name").distinct().withColumn("_seen", F.lit(True))
    return scored.join(seen, "repo_full_name", "left").select(
        *scored.columns, F.col("_seen").isNotNull().alias("assessed")
    )


def latest_assessment(records: DataFrame, n_reports: int = 5) -> DataFrame:
    """Newest text per repository, from the n newest reports only."""
    newest = records.select("report_file").distinct().orderBy(F.desc("report_file")).limit(n_reports)
    w = Window.partitionBy("repo_full_name").orderBy(F.desc("report_file"))
    return (
        records.join(newest, "report_file", "left_semi")
        .withColumn("_n", F.row_number().over(w))
        .filter("_n = 1")
        .select("repo_full_name", "report_file", "assessment_text")
    )

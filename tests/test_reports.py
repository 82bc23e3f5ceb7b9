import math
import random

import pytest
from depsignal.functions.names import vector_key
from depsignal.operators import reports, scoring, vectors
from depsignal.plans.assessment import assess, index_records
from depsignal.sources import documents, tables
from pyspark.sql import functions as F

RUN = "2026-04-14T18:07:32.634805+00:00"


def recs(spark, data):
    df = spark.createDataFrame(data, "repo_full_name string, health_score double, health_trend double, assessment string")
    return scoring.recommend(df).withColumn("run_ts", F.lit(RUN))


@pytest.fixture(scope="module")
def rendered(spark):
    data = [
        ("o/low", 1.75, None, "1. **Bad** — x\n\n2. y"),
        ("o/lower", 0.75, -0.5, "text"),
        ("o/mid", 4.0, 0.25, ""),
        ("o/none", None, None, None),
    ] + [(f"o/ok{i}", 9.0, None, "fine") for i in range(11)]
    return reports.render_report(recs(spark, data))


def test_render(rendered):
    r = rendered.first()
    assert r.file_name == "risk_report_2026-04-14T18-07-32.md"
    assert r.content.startswith(
        "# Dependency Risk Report\n\n"
        f"**Generated:** {RUN}\n**Projects assessed:** 15\n**Summary:** 2 REPLACE  |  1 UPGRADE  |  12 MONITOR\n\n---\n\n"
        "## Critical — Replace\n\n### o/lower\n\n"
        "- **Health score:** 0.75/10  |  **Risk score:** 0.93  (trend: -0.50)\n\ntext\n\n---\n\n"
        "### o/low\n\n- **Health score:** 1.75/10  |  **Risk score:** 0.82\n\n1. **Bad** — x\n\n2. y\n\n---\n\n"
        "## Warning — Upgrade\n\n### o/mid\n\n- **Health score:** 4.0/10  |  **Risk score:** 0.60  (trend: +0.25)\n\n\n\n---\n\n"
        "## Monitor\n\n### o/none\n\n- **Health score:** None/10  |  **Risk score:** 0.50\n\nNo assessment available.\n\n---\n"
    )
    assert r.content.endswith("fine\n\n---\n")


def test_empty_sections(spark):
    text = reports.render_report(recs(spark, [("o/ok", 9.0, None, "a")])).first().content
    assert "Critical" not in text and "Upgrade" not in text


def test_blocks_rebuild_the_report(spark):
    """Sorted blocks joined by blank lines are the sections of the rendered text."""
    df = recs(spark, [("o/a", 1.0, None, "a"), ("o/b", 2.0, None, "b")])
    blocks = reports.report_blocks(df).orderBy("section", F.desc("risk_score"), "repo_full_name")
    text = reports.render_report(df).first().content
    assert "\n".join(r.block for r in blocks.collect()) == text[text.index("### o/a"):]


def test_round_trip(spark, rendered, rows):
    got = reports.parse_reports(rendered.select("file_name", "content"))
    assert got.count() == 15
    assert rows(got.filter("recommendation <> 'MONITOR'"), "repo_full_name", "recommendation", "health_score", "risk_score", "assessment_text") == [
        ("o/low", "REPLACE", 1.75, 0.82, "1. **Bad** — x\n\n2. y"),
        ("o/lower", "REPLACE", 0.75, 0.93, "text"),
        ("o/mid", "UPGRADE", 4.0, 0.6, ""),
    ]
    assert rows(got.filter("repo_full_name = 'o/none'"), "health_score", "report_date") == [(0.0, "2026-04-14")]


ODD = (
    "intro\n### o/early\nno\n## Other\n\n### o/skipped\n- **Health score:** 1\n## Monitor  \n### no slash\nx\n"
    "### o/x\r\n- **Health score:** 1.2.3/10 **Risk score:** .5\nline\n  ---  \n### o/y\n\n"
)


def test_parse_odd_reports(spark, rows):
    df = spark.createDataFrame([("risk_report_x.md", ODD)], "file_name string, content string")
    assert rows(reports.parse_reports(df), "repo_full_name", "health_score", "risk_score", "assessment_text", "report_date") == [
        ("o/x", 0.0, 0.5, "line", ""), ("o/y", 0.0, 0.0, "", ""),
    ]
    assert rows(reports.report_sections(df, repo="o/skipped"), "action", "text") == [(None, "- **Health score:** 1")]
    assert reports.report_sections(df, action="MONITOR").count() == 3


def test_distribution(spark, rows):
    data = [
        ("a", "**Summary:** 3 REPLACE  |  10 UPGRADE  |  127 MONITOR\n"),
        ("b", "# t\n### o/x\n## Critical — Replace\n### o/a\n### o/b\n## Upgrade or monitor\n### o/c\n## Else\n### o/d\n"),
        ("c", ""),
    ]
    df = spark.createDataFrame(data, "file_name string, content string")
    assert rows(reports.report_distribution(df)) == [("a", 3, 10, 127), ("b", 2, 1, 0), ("c", 0, 0, 0)]


def test_meta(spark, rows):
    data = [("risk_report_2026-04-12T19-36-29.md", "### o/a\n### o/é\n#### no\n" + "x" * 1500), ("risk_report_odd.md", "")]
    df = spark.createDataFrame(data, "file_name string, content string")
    size = round(len(data[0][1].encode()) / 1024, 1)
    assert rows(reports.report_meta(df)) == [
        (data[0][0], "2026-04-12 19:36:29", 2, size), ("risk_report_odd.md", "odd", 0, 0.0),
    ]


def test_size_ties_go_to_the_even_digit(spark):
    sizes = [256, 768, 1280, 1300, 51, 52]
    df = spark.createDataFrame([(str(n), "x" * n) for n in sizes], "file_name string, content string")
    got = {int(r.file_name): r.size_kb for r in reports.report_meta(df).collect()}
    assert got == {n: round(n / 1024, 1) for n in sizes}


def test_files(spark, tmp_path, rendered):
    path = str(tmp_path / "out")
    documents.write_reports(rendered, path)
    plain = tmp_path / "out" / "risk_report_2027-01-01T00-00-00.md"
    plain.write_text("## Monitor\n### o/new\n", encoding="utf-8")
    (tmp_path / "out" / "notes.md").write_text("x", encoding="utf-8")
    stored = documents.read_reports(spark, path)
    assert sorted((r.file_name for r in stored.collect()), reverse=True) == [plain.name, "risk_report_2026-04-14T18-07-32.md"]
    assert reports.parse_reports(stored).count() == 16
    assert [r.file_name for r in documents.read_reports(spark, path, latest_only=True).collect()] == [plain.name]


def test_reports_are_files_that_replace_each_other(spark, tmp_path, rows):
    path = tmp_path / "out"
    old = path / "report=risk_report_a.md"
    old.mkdir(parents=True)
    (old / "part-0.txt").write_text("earlier\n", encoding="utf-8")
    for texts in ([("a", "x\n"), ("b", "é")], [("a", "new\n\n"), ("c", None), ("d", "2"), ("d", "1")]):
        documents.write_reports(spark.createDataFrame([(f"risk_report_{n}.md", c) for n, c in texts], "file_name string, content string"), str(path))
    assert sorted(p.name for p in path.iterdir() if p.name[0] != ".") == [f"risk_report_{n}.md" for n in "abcd"]
    got = dict(rows(documents.read_reports(spark, str(path))))
    assert got == {"risk_report_a.md": "new\n\n", "risk_report_b.md": "é", "risk_report_c.md": "", "risk_report_d.md": "1\n2"}


RECORD = "repo_full_name string, recommendation string, health_score double, assessment_text string, report_file string"


def test_compare_and_flags(spark, rows):
    a = spark.createDataFrame([("o/a", "REPLACE"), ("o/b", "MONITOR")], "repo_full_name string, recommendation string")
    b = spark.createDataFrame([("o/b", "MONITOR"), ("o/c", "UPGRADE")], "repo_full_name string, recommendation string")
    both = reports.compare_reports(a, b)
    assert [tuple(r) for r in both.collect()] == [
        ("o/a", "REPLACE", "—", True), ("o/b", "MONITOR", "MONITOR", False), ("o/c", "—", "UPGRADE", True),
    ]
    assert reports.changed_count(both).first().changed == 2
    scored = spark.createDataFrame([("o/a",), ("o/z",)], "repo_full_name string")
    assert rows(reports.assessed_flag(scored, a.unionByName(a))) == [("o/a", True), ("o/z", False)]


def test_latest_assessment(spark, rows):
    data = [(r, "MONITOR", 1.0, f"{r}{n}", f"risk_report_{n}.md") for n in range(7) for r in ("o/a", "o/b") if (r, n) != ("o/b", 6)]
    data.append(("o/old", "MONITOR", 1.0, "old", "risk_report_1.md"))
    df = spark.createDataFrame(data, RECORD)
    assert rows(reports.latest_assessment(df), "repo_full_name", "assessment_text") == [("o/a", "o/a6"), ("o/b", "o/b5")]
    assert reports.latest_assessment(df, 1).count() == 1


def test_fallback_text(spark):
    df = spark.createDataFrame([("o/a", "REPLACE", 1.25, " \n", "f"), ("o/b", "MONITOR", 9.0, "é" * 400, "f")], RECORD)
    got = {r.repo_full_name: r for r in reports.fallback_text(df).collect()}
    assert got["o/a"].assessment_text.startswith("o/a — health score 1.3/10, recommendation: REPLACE. No detailed")
    assert got["o/b"].excerpt == "é" * 300


def test_assess_and_index(spark):
    scored = spark.createDataFrame(
        [("o/a", 3.0, None), ("o/b", 5.5, None), ("o/c", 9.0, None)],
        "repo_full_name string, health_score double, health_trend double",
    )
    texts = spark.createDataFrame([("o/a", "A"), ("o/b", " "), ("o/c", "C"), ("o/new", "N")], "repo_full_name string, assessment string")
    got = {r.repo_full_name: r for r in index_records(assess(scored, texts, RUN)).collect()}
    # a good score is not flagged; a text without a score is reported all the same
    assert set(got) == {"o/a", "o/b", "o/new"}
    assert (got["o/new"].recommendation, got["o/new"].risk_score) == ("MONITOR", 0.5)
    assert got["o/b"].assessment_text.startswith("o/b — health score 5.5/10, recommendation: MONITOR")
    assert len(got["o/a"].vec_id) == 40


def test_brief(spark):
    scored = spark.createDataFrame(
        [("o/a", 5.0, 5.0, 1.234, 0.0, 5.0, 5.0, None, False), ("o/b", 5.0, 5.0, 1.0, 0.0, 5.0, 5.0, 0.5, True)],
        "repo_full_name string, health_score double, commit_score double, issue_score double, pr_score double,"
        " contributor_score double, bus_factor_score double, health_trend double, has_push_data boolean",
    )
    item = "array<struct<number:int,title:string,comments:int,labels:array<string>,draft:boolean>>"
    signals = spark.createDataFrame(
        [("o/a", 1234567, 3, 1, "Go", False, "2024", [(n, "t", 2, ["x", "y"] if n else [], True) for n in range(7)], [])],
        f"repo_full_name string, stars bigint, forks bigint, open_issues bigint, language string, archived boolean,"
        f" pushed_at string, issues {item}, prs {item}",
    )
    got = {r.repo_full_name: r.brief for r in reports.assessment_brief(scored, signals).collect()}
    assert "- Stars: 1,234,567" in got["o/a"] and "Note: no push events" in got["o/a"]
    assert "| Issue resolution | 1.23 |  |" in got["o/a"] and "Health trend: N/A" in got["o/a"]
    assert "  - #0: t (2 comments)\n  - #1: t (2 comments, labels: x, y)" in got["o/a"]
    assert "#4:" in got["o/a"] and "#5:" not in got["o/a"]
    assert "- Stars: N/A" in got["o/b"] and got["o/b"].count("None retrieved.") == 2 and "Note:" not in got["o/b"]


# -- vectors -----------------------------------------------------------------


def test_cosine_topk_against_brute_force(spark):
    rng = random.Random(5)
    data = [(i, [rng.uniform(-1, 1) for _ in range(16)], ("REPLACE", "UPGRADE", "MONITOR")[i % 3]) for i in range(300)]
    df = spark.createDataFrame(data, "vec_id int, embedding array<float>, recommendation string").repartition(5)
    query = [rng.uniform(-1, 1) for _ in range(16)]

    def cos(v):
        dot = sum(a * b for a, b in zip(v, query))
        return dot / math.sqrt(sum(a * a for a in v)) / math.sqrt(sum(b * b for b in query))

    for label in (None, "UPGRADE"):
        want = sorted((d for d in data if label in (None, d[2])), key=lambda d: -cos(d[1]))[:7]
        got = vectors.cosine_topk(df, query, 7, label).collect()
        assert [r.vec_id for r in got] == [d[0] for d in want]
        assert [r.similarity for r in got] == pytest.approx([round(cos(d[1]), 4) for d in want], abs=1e-4)
    assert vectors.cosine_topk(df, query, 99).count() == min(99, df.count())
    assert vectors.cosine_topk(df, []).count() == 0
    with pytest.raises(ValueError):
        vectors.cosine_topk(df, query, label="OTHER")


def test_zero_vector_has_no_similarity(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "vec_id int, embedding array<float>")
    got = vectors.cosine_topk(df, [1.0, 0.0]).collect()
    assert [(r.vec_id, r.similarity) for r in got] == [(2, 1.0), (1, None)]


def test_index_upsert_and_stats(spark, rows):
    old = spark.createDataFrame([("a", "x", 1), ("b", "x", 1)], "vec_id string, namespace string, v int")
    new = spark.createDataFrame([("b", "y", 2), ("b", "z", 3), ("c", "y", 2)], "vec_id string, namespace string, v int")
    table = tables.upsert_by_id(old, new, "vec_id", "v")
    assert rows(table) == [("a", "x", 1), ("b", "z", 3), ("c", "y", 2)]
    assert rows(tables.upsert_by_id(table, new, "vec_id", "v")) == rows(table)
    assert rows(vectors.index_stats(table)) == [("all", 3), ("x", 1), ("y", 1), ("z", 1)]
    key = spark.range(1).select(vector_key(F.lit("o/r"), F.lit("f.md"))).first()[0]
    import hashlib

    assert key == hashlib.sha256(b"o/r|f.md").hexdigest()[:40]

import math
import random

import pytest
from depsignal.functions import names, scores
from depsignal.functions.casts import safe_boolean, safe_double, safe_int
from depsignal.functions.numeric import exact_mean, fixed_2, percent
from depsignal.operators import scorecard, scoring
from pyspark.sql import functions as F


def apply(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("r")).collect()]


def test_signal_scores(spark):
    rates = apply(spark, [None, 0.0, 1.0, 10.0, 50.0], "double", scores.log_rate_score)
    assert rates == [5.0, 0.0, round(math.log10(51) / math.log10(501) * 10, 2), 10.0, 10.0]
    assert apply(spark, [None, 0.0, 0.5, 2.0], "double", scores.issue_score) == [5.0, 0.0, 5.0, 10.0]
    assert apply(spark, [None, 0, 3, 20, 99], "bigint", scores.contributor_score) == [5.0, 0.0, 1.5, 10.0, 10.0]
    assert apply(spark, [None, 1.0, 0.3333], "double", scores.bus_factor_score) == [5.0, 0.0, 6.67]


@pytest.mark.parametrize(
    "score,risk,action",
    [
        ("3.5", 0.65, "REPLACE"),
        ("3.51", 0.649, "UPGRADE"),
        ("5.0", 0.5, "UPGRADE"),
        ("5.01", 0.499, "MONITOR"),
        ("-1", 1.0, "REPLACE"),
        ("11", 0.0, "MONITOR"),
        (None, 0.5, "MONITOR"),
        ("n/a", 0.5, "MONITOR"),
    ],
)
def test_risk_action(spark, score, risk, action):
    df = spark.createDataFrame([(score,)], "health_score string")
    r = scoring.recommend(df).first()
    assert (r.risk_score, r.action) == (risk, action)


def test_action_is_decided_before_rounding(spark):
    df = spark.createDataFrame([(5.00001,)], "health_score double")
    r = scoring.recommend(df).first()
    assert (r.risk_score, r.action) == (0.5, "MONITOR")


def test_band(spark):
    got = apply(spark, [None, 4.99, 5.0, 6.99, 7.0], "double", scores.band)
    assert got == ["N/A", "Critical", "Warning", "Warning", "Healthy"]
    assert apply(spark, [4.5], "double", lambda c: scores.band(c, 4.0)) == ["Warning"]


def test_is_maintained(spark):
    as_of = F.lit("2024-04-01T00:00:00Z")
    values = ["2024-01-02T00:00:01Z", "2024-01-02T00:00:00Z", "soon", None, ""]
    got = apply(spark, values, "string", lambda c: scores.is_maintained(c, as_of))
    assert got == [True, False, None, None, None]


def test_fixed_2_follows_the_stored_binary_value(spark):
    rng = random.Random(3)
    values = [k / 1000 for k in range(0, 1001)] + [rng.random() * 7.99 for _ in range(2000)]
    assert apply(spark, values, "double", fixed_2) == [f"{v:.2f}" for v in values]


def test_casts(spark):
    values = ["1", "TRUE", "true", "no", None, "2.9", "x"]
    assert apply(spark, values, "string", safe_boolean) == [True, True, True, False, None, False, False]
    assert apply(spark, values, "string", safe_double) == [1.0, None, None, None, None, 2.9, None]
    assert apply(spark, values, "string", safe_int) == [1, None, None, None, None, 2, None]


def test_mean_and_percent(spark):
    df = spark.createDataFrame([(1.01, 1), (1.02, 0)], "v double, z int")
    r = df.agg(exact_mean(F.col("v")).alias("m"), percent(F.sum("z"), F.count("z")).alias("p")).first()
    assert (r.m, r.p) == (1.02, 50.0)
    assert df.filter("v > 9").agg(percent(F.count("z"), F.count("v")).alias("p")).first().p is None


def test_names(spark):
    good = apply(spark, ["a/b", "a.b-c/d_e", "a/b/c", "a", "a b/c", "/b"], "string", names.valid_repo_name)
    assert good == [True, True, False, False, False, False]
    urls = [
        "https://github.com/o/r",
        "https://github.com/o/r.git",
        "git+https://github.com/o/r.git",
        "git@github.com:o/r.git",
        "https://github.com/o/r#readme",
        "https://github.com/o/r/tree/main?x",
        "github:o/r",
        "https://github.com/o",
        "",
        None,
    ]
    want = ["o/r"] * 6 + [None] * 4
    assert apply(spark, urls, "string", names.github_slug) == want
    modules = ["golang.org/x/net/http", "k8s.io/api", "sigs.k8s.io/yaml/v2", "github.com/o/r/v2", "gopkg.in/y"]
    assert apply(spark, modules, "string", names.go_module_slug) == [
        "golang/net", "kubernetes/api", "kubernetes-sigs/yaml", "o/r", None,
    ]


CARD = (
    "repo_full_name string, is_maintained boolean, has_license boolean, is_branch_protected boolean,"
    " requires_code_review boolean, has_security_policy boolean, vuln_count int,"
    " vuln_data_available boolean, has_dep_update_tool boolean"
)


def test_governance_and_security(spark):
    df = spark.createDataFrame(
        [
            ("all", True, True, True, True, True, 0, True, True),
            ("none", False, False, False, False, False, 6, True, False),
            ("null", None, None, None, None, None, None, None, None),
            ("some", True, False, None, True, False, 3, True, True),
            ("off", True, True, True, True, True, 3, False, False),
            ("unsure", True, True, True, True, True, 3, None, False),
        ],
        CARD,
    )
    gov = {r.repo_full_name: r.governance_score for r in scorecard.governance(df).collect()}
    assert gov == {"all": 10.0, "none": 0.0, "null": 0.0, "some": 5.0, "off": 10.0, "unsure": 10.0}
    sec = {r.repo_full_name: r.security_score for r in scorecard.security(df).collect()}
    assert sec == {"all": 10.0, "none": 0.0, "null": 3.0, "some": 6.4, "off": 3.0, "unsure": 2.4}
    both = {r.repo_full_name: (r.governance_score, r.security_score) for r in scorecard.governance_and_security(df).collect()}
    assert both == {k: (gov[k], sec[k]) for k in gov}


def test_scorecard_flags(spark):
    meta = spark.createDataFrame(
        [
            ("o/a", '{"language": "TypeScript", "pushed_at": "2024-03-30T00:00:00Z", "license": {"key": "mit"}}'),
            ("o/b", '{"language": "Haskell", "pushed_at": null, "license": null}'),
            ("o/c", '{"language": "Go", "pushed_at": "2023-01-01T00:00:00Z"}'),
        ],
        "repo_full_name string, body string",
    )
    branches = spark.createDataFrame(
        [
            ("o/a", '{"protected": true, "protection": {"required_status_checks": {"enforcement_level": "everyone"}}}'),
            ("o/b", '{"protected": false, "protection": {"required_pull_request_reviews": {"n": 1}}}'),
        ],
        "repo_full_name string, body string",
    )
    files = spark.createDataFrame(
        [("o/a", "renovate.json"), ("o/a", "x"), ("o/b", ".github/SECURITY.md")], "repo_full_name string, path string"
    )
    vulns = spark.createDataFrame(
        [("a", "npm"), ("a", "npm"), ("a", "PyPI"), ("b", "npm")], "package string, ecosystem string"
    )
    got = {r.repo_full_name: r for r in scorecard.scorecard(meta, branches, files, vulns, F.lit("2024-04-01T00:00:00Z")).collect()}
    a, b, c = got["o/a"], got["o/b"], got["o/c"]
    assert (a.is_maintained, a.has_license, a.is_branch_protected, a.requires_code_review) == (True, True, True, True)
    assert (a.vuln_count, a.vuln_data_available, a.has_dep_update_tool, a.has_security_policy) == (2, True, True, False)
    assert (b.is_maintained, b.has_license, b.requires_code_review, b.has_security_policy) == (None, False, False, True)
    assert (b.vuln_count, b.vuln_data_available) == (None, False)
    assert (c.is_maintained, c.vuln_count, c.has_dep_update_tool) == (False, 0, False)


def test_health_trend(spark, rows):
    df = spark.createDataFrame([("r", 2, 6.1), ("r", 1, 5.0), ("s", 1, 3.0)], "repo_full_name string, snapshot_date int, health_score double")
    got = rows(scoring.health_trend(df), "repo_full_name", "snapshot_date", "prev_health_score", "health_trend")
    assert got == [("r", 1, None, None), ("r", 2, 5.0, 1.1), ("s", 1, None, None)]

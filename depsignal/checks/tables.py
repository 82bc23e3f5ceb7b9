"""The given test tables seen as events, scorecards, watch-lists and manifests.

Every function reads whole tables; the oracles repeat the same projections in
SQL (see ``prelude.py``).
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depsignal.operators import metrics, resolution, scoring, silver
from depsignal.functions import scores
from depsignal.operators.portfolio import top_items_per_repo
from depsignal.operators.reports import render_report
from depsignal.sources.tables import materialize_once

COMPUTED_AT = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def repo_of(number: Column) -> Column:
    return F.concat(F.lit("org"), (number % 10).cast("string"), F.lit("/repo"), number.cast("string"))


# -- events ------------------------------------------------------------------


def bronze(spark: SparkSession, sf: str) -> DataFrame:
    """Nested events. Repositories grow with users; `value` drives actions and commits."""
    k = F.col("k")
    number = k + F.floor(F.col("user_id") / 50) * 100
    kind, value = F.col("event_type"), F.col("value")
    push = (kind == "click") & (k < 90)
    event_type = (
        F.when(push, "PushEvent")
        .when(kind == "click", "ForkEvent")
        .when(kind == "view", "IssuesEvent")
        .when(kind == "purchase", "PullRequestEvent")
        .when(kind == "error", "IssueCommentEvent")
        .when(value < 20, "CreateEvent")
        .otherwise("WatchEvent")
    )
    none = F.lit(None).cast("string")
    actor = F.when(
        value >= 1,
        F.struct(
            F.col("user_id").alias("id"),
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("login"),
            none.alias("display_login"),
            none.alias("gravatar_id"),
            none.alias("url"),
            none.alias("avatar_url"),
        ),
    )
    action = F.when(
        kind.isin("view", "purchase"),
        F.when(value < 30, "opened").when(value < 70, "closed").otherwise("reopened"),
    )
    commit = F.struct(
        F.lit("0").alias("sha"), F.lit("change").alias("message"), F.lit(True).alias("distinct")
    )
    commits = F.when(push & (value >= 5), F.array_repeat(commit, F.floor(value / 60).cast("int")))
    payload = F.struct(
        action.alias("action"),
        none.alias("ref"),
        none.alias("ref_type"),
        F.lit(None).cast("bigint").alias("push_id"),
        F.lit(None).cast("int").alias("size"),
        F.lit(None).cast("int").alias("distinct_size"),
        commits.alias("commits"),
        F.lit(None).cast("int").alias("number"),
    )
    repo = F.struct(number.alias("id"), repo_of(number).alias("name"), none.alias("url"))
    keyed = table(spark, sf, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("bigint")
    )
    return keyed.select(
        F.col("event_id").cast("string").alias("id"),
        event_type.alias("type"),
        actor.alias("actor"),
        repo.alias("repo"),
        payload.alias("payload"),
        F.lit(True).alias("public"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.struct(F.lit(None).cast("bigint").alias("id"), none.alias("login")).alias("org"),
        "value",
    )


def first_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """Silver as ingested one hour after each event."""
    hour_later = F.date_trunc("hour", "event_time") + F.expr("INTERVAL 1 HOUR")
    return silver.bronze_to_silver(bronze(spark, sf).drop("value"), hour_later)


def silver_events(spark: SparkSession, sf: str) -> DataFrame:
    """Silver with copies: evening events are delivered again the next morning."""
    once = first_delivery(spark, sf)
    again = F.date_trunc("day", "created_at") + F.expr("INTERVAL 26 HOURS")
    times = F.when(
        F.hour("created_at") >= 18, F.array(F.col("ingested_at"), again)
    ).otherwise(F.array("ingested_at"))
    rest = [c for c in once.columns if c != "ingested_at"]
    return once.select(*rest, F.explode(times).alias("ingested_at"))


def staged(spark: SparkSession, sf: str, *types: str) -> DataFrame:
    return silver.staged_events(silver_events(spark, sf), types)


# -- scorecards --------------------------------------------------------------


def _brand() -> Column:
    return F.substring("p_brand", 7, 10).cast("int")


def _by_type(**values) -> Column:
    out = None
    for name, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        match = F.col("p_type") == name
        out = F.when(match, value) if out is None else out.when(match, value)
    return out


def language() -> Column:
    return _by_type(
        ECONOMY="Python", STANDARD="Go", MEDIUM="Rust", SMALL="Kotlin", LARGE="Haskell", PROMO="C#"
    )


def fetched_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Scorecard fetch results; rows with an error carry no usable card."""
    size, brand = F.col("p_size"), _brand()
    return table(spark, sf, "part").select(
        repo_of(F.col("p_partkey")).alias("repo_full_name"),
        F.when(size <= 45, size > 12).alias("is_maintained"),
        F.when(brand < 25, brand > 3).alias("has_license"),
        (brand > 8).alias("is_branch_protected"),
        (brand > 14).alias("requires_code_review"),
        size.between(10, 35).alias("has_security_policy"),
        F.when(size <= 47, size % 13).alias("vuln_count"),
        _by_type(ECONOMY=True, STANDARD=True, MEDIUM=True, LARGE=False, PROMO=True).alias(
            "vuln_data_available"
        ),
        (brand < 16).alias("has_dep_update_tool"),
        language().alias("language"),
        F.lit(COMPUTED_AT).cast("timestamp").alias("fetched_at"),
        F.when(F.col("p_type") == "PROMO", "fetch failed").alias("error"),
    )


def cards(spark: SparkSession, sf: str) -> DataFrame:
    return fetched_cards(spark, sf).filter("error IS NULL").drop("error")


# -- health and scores -------------------------------------------------------


def health(spark: SparkSession, sf: str, stage=materialize_once) -> DataFrame:
    at = F.lit(COMPUTED_AT).cast("timestamp")
    return metrics.project_health(staged(spark, sf), cards(spark, sf), stage=stage, computed_at=at)


def scored(spark: SparkSession, sf: str, stage=materialize_once) -> DataFrame:
    return scoring.health_scores(health(spark, sf, stage))


SNAPSHOT = ("snapshot_date", "repo_full_name")


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of every ten-day slice, computed in one pass, with their trend."""
    slice_no = F.floor(F.datediff("event_date", F.lit("2024-01-01").cast("date")) / 10).cast("int")
    events = staged(spark, sf).withColumn(
        "snapshot_date", F.date_add(F.lit("2024-01-10").cast("date"), slice_no * 10)
    )
    wide = metrics.project_health(events, cards(spark, sf), SNAPSHOT, materialize_once)
    at = F.lit(COMPUTED_AT).cast("timestamp")
    return scoring.health_trend(scoring.health_scores(wide, by=SNAPSHOT, computed_at=at))


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """Recommendations of every snapshot, ten repositories per run."""
    batch = F.floor(F.substring("repo_name", 5, 20).cast("bigint") / 10)

    def two(c):
        return F.lpad(c.cast("string"), 2, "0")

    clock = F.concat_ws(
        ":", two(F.floor(batch / 3600)), two(F.floor(batch / 60) % 60), two(batch % 60)
    )
    band = scores.band(F.col("health_score"))
    text = (
        F.when(band == "Healthy", "")
        .when(
            band == "Warning",
            F.concat(
                F.lit("1. **Signal** — commits score "),
                F.col("commit_score").cast("string"),
                F.lit("\n\n2. **Advice** — watch it."),
            ),
        )
        .otherwise("Look for a replacement.")
    )
    return (
        scoring.recommend(snapshots(spark, sf))
        .withColumn("run_ts", F.concat(F.col("snapshot_date").cast("string"), F.lit("T"), clock, F.lit("+00:00")))
        .withColumn("assessment", text)
    )


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return render_report(recommendations(spark, sf)).select("file_name", "content")


# -- watch-list and packages -------------------------------------------------


def projects(spark: SparkSession, sf: str) -> DataFrame:
    """Every part is a project; its type is the category, PROMO means discovered."""
    key = F.col("p_partkey")
    category = F.when(F.col("p_type") == "PROMO", "discovered").otherwise(F.lower("p_type"))
    return table(spark, sf, "part").select(
        F.concat(F.lit("org"), (key % 10).cast("string")).alias("org"),
        F.concat(F.lit("repo"), key.cast("string")).alias("repo"),
        category.alias("category"),
        F.col("p_name").alias("description"),
    )


def curated(spark: SparkSession, sf: str) -> DataFrame:
    return projects(spark, sf).filter("category != 'discovered'")


def _package() -> tuple[Column, Column]:
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    dashed = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    own = repo_of(F.col("p_partkey"))
    python = (
        F.when(size == 50, "Pandas").when(size == 49, "NumPy").otherwise(F.concat(dashed, key))
    )
    go = (
        F.when(size < 10, F.concat(F.lit("golang.org/x/"), dashed, key, F.lit("/v2")))
        .when(size < 20, F.concat(F.lit("gopkg.in/"), dashed, key))
        .otherwise(F.concat(F.lit("github.com/"), own, F.lit("/v2")))
    )
    name = _by_type(
        ECONOMY=python,
        SMALL=F.concat(F.lit("@js/"), dashed, key),
        MEDIUM=go,
        LARGE=F.concat(dashed, F.lit("_"), key),
        STANDARD=F.concat(F.lit("com."), dashed, F.lit(":a"), key),
        PROMO=F.concat(F.lit("promo-"), key),
    )
    ecosystem = _by_type(
        ECONOMY="python", SMALL="node", MEDIUM="go", LARGE="rust", STANDARD="java", PROMO="python"
    )
    return ecosystem, name


def packages(spark: SparkSession, sf: str) -> DataFrame:
    ecosystem, name = _package()
    return table(spark, sf, "part").select(
        "p_partkey", "p_size", "p_type", ecosystem.alias("ecosystem"), name.alias("name")
    )


def dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Every order is a manifest, every line item one of its dependencies."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    named = packages(spark, sf).select("p_partkey", "ecosystem", "name")
    return lines.join(named, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("manifest"), F.col("l_linenumber").alias("pos"), "ecosystem", "name"
    )


def _target() -> Column:
    return repo_of(F.floor(F.col("p_partkey") / 2))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Registry entries; two neighbouring packages share one repository."""
    size, target = F.col("p_size"), _target()
    url = F.concat(F.lit("https://github.com/"), target)
    git = F.concat(F.lit("git+https://github.com/"), target, F.lit(".git"))
    urls = F.when(
        size < 15, F.create_map(F.lit("Documentation"), F.lit("https://example.org"), F.lit("Source"), url)
    ).when(size < 25, F.create_map(F.lit("Homepage"), F.lit("https://example.org"), F.lit("Code"), git))
    rows = packages(spark, sf).filter(~((F.col("ecosystem") == "python") & F.col("name").isin("Pandas", "NumPy")))
    return rows.select(
        "ecosystem",
        "name",
        urls.alias("project_urls"),
        F.when(size % 2 == 0, F.concat(url, F.lit("#readme"))).otherwise("https://example.org").alias("home_page"),
        F.when(size < 30, git).alias("repository"),
        F.when(size > 40, target).alias("search_hit"),
    )


def cache(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier resolutions of small parts; the smallest are negative entries."""
    found = F.col("p_size") >= 3
    return packages(spark, sf).filter("p_size <= 8").select(
        "ecosystem",
        "name",
        F.when(found, "cached").alias("org"),
        F.when(found, F.concat(F.lit("repo"), F.floor(F.col("p_partkey") / 3).cast("string"))).alias("repo"),
        F.when(found, "npm").alias("source"),
        F.when(found, "high").alias("confidence"),
    )


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.resolve_packages(
        dependencies(spark, sf),
        cache(spark, sf),
        registry(spark, sf),
        curated(spark, sf),
        ["manifest", "pos"],
    )


# -- issues and manifests ----------------------------------------------------


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Every order is an issue or pull request of its customer's repository."""
    priority = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        repo_of(F.col("o_custkey")).alias("repo_full_name"),
        F.col("o_orderkey").alias("number"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"),
        F.floor(F.col("o_totalprice") / 10000).cast("int").alias("comments"),
        F.when(priority == "4-NOT SPECIFIED", F.array().cast("array<string>"))
        .otherwise(F.array(priority))
        .alias("labels"),
        priority.startswith("1").alias("is_pull_request"),
        (F.col("o_totalprice") > 400000).alias("draft"),
    )


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all shuffle partitions: a small file of many rows is read by a task or two."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def manifest_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Five manifests per part, one per format, as (kind, file_name, content).

    Parsing takes far longer than reading parts, so the parts are dealt over tasks first.
    """
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    first = F.substring_index("p_name", " ", 1)
    second = F.substring_index("p_name", " ", -1)

    def text(*parts):
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    python = text(
        "# pinned for ", F.col("p_brand"), "\n-r base.txt\n\n", first, "==1.", size,
        "  # note\n", second, "[extra]>=2,<3 ; python_version < '4'\nbad name here\nplain", key, "\r\n",
    )
    node = F.when(
        F.col("p_size") == 1, text('{"dependencies": {"', first, '": ')
    ).otherwise(
        text(
            '{"name": "x", "devDependencies": {"', second, '": "~', size, '"}, "dependencies": {"',
            first, '": "^1.', size, '", "n', key, '": 7}}',
        )
    )
    go = text(
        "module example.org/m\n// require a v0\nrequire example.org/", first, " v1.", size,
        "\nrequire (\n\texample.org/", second, "/v2 v2.", size, " // indirect\n\t// skipped v1\n\tlonely\n)\n",
        "example.org/outside v9\n",
    )
    java = F.when(
        F.col("p_size") == 2, text("<project><dependency>")
    ).otherwise(
        text(
            '<project xmlns="http://maven.example/4.0"><dependencies><dependency><groupId>org.', first,
            "</groupId><artifactId>a", key, "</artifactId><version> 1.", size,
            "</version></dependency><dependency><groupId>org.", second,
            "</groupId><artifactId>b</artifactId></dependency><dependency><artifactId>no-group</artifactId>"
            "</dependency></dependencies></project>",
        )
    )
    rust = text(
        '[package]\nname = "x"\nversion = "0.1"\n\n[dependencies]\n', first, ' = "1.', size,
        '"\n# note = "1"\n', second, "_x = { features = [\"f\"], version = \"2.", size,
        '" }\npath_only = { path = "p" }\n[features]\ny = "1"\n[dev-dependencies]\nd', key, ' = ""\n',
    )
    file = F.struct
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return _dealt(parts, "p_partkey").select(
        F.inline(
            F.array(
                *[
                    file(F.lit(kind).alias("kind"), text(key, "-", name).alias("file_name"), content.alias("content"))
                    for kind, name, content in (
                        ("python", "requirements.txt", python),
                        ("node", "package.json", node),
                        ("go", "go.mod", go),
                        ("java", "pom.xml", java),
                        ("rust", "Cargo.toml", rust),
                    )
                ]
            )
        )
    )


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Hosting metadata from customers, with their newest issues and pull requests."""
    rows = items(spark, sf)
    issues = top_items_per_repo(rows, 10).withColumnRenamed("items", "issues")
    prs = top_items_per_repo(rows, 5, pull_requests=True).withColumnRenamed("items", "prs")
    meta = table(spark, sf, "customer").select(
        repo_of(F.col("c_custkey")).alias("repo_full_name"),
        F.floor(F.abs("c_acctbal") * 10).cast("bigint").alias("stars"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey").cast("bigint")).alias("open_issues"),
        F.col("c_custkey").alias("forks"),
        F.lower("c_mktsegment").alias("language"),
        (F.col("c_nationkey") == 0).alias("archived"),
        F.when(F.col("c_acctbal") > 0, "2024-01-15T00:00:00Z").alias("pushed_at"),
    )
    return meta.join(issues, "repo_full_name", "left").join(prs, "repo_full_name", "left")

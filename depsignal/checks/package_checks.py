"""Manifests, package resolution and onboarding."""

from pyspark.sql import functions as F

from depsignal.checks import tables as t
from depsignal.checks.prelude import n
from depsignal.checks.registry import check
from depsignal.functions.names import github_slug, go_module_slug
from depsignal.operators import manifests, resolution, watchlist
from depsignal.sources.tables import materialize_once


def _files(spark, sf, kind):
    return t.manifest_texts(spark, sf).filter(F.col("kind") == kind)


def _expected(ecosystem, file, rows):
    """SQL rows of (pos, name, version) for every part."""
    return " UNION ALL ".join(
        f"SELECT p_partkey || '-{file}' AS file_name, CAST({pos} AS INTEGER) AS pos, {name} AS name, "
        f"{version} AS version, '{ecosystem}' AS ecosystem FROM parts {where}"
        for pos, name, version, where in rows
    )


_PYTHON = _expected(
    "python",
    "requirements.txt",
    [
        (0, "w1", "'==1.' || p_size", ""),
        (1, "w2", "'>=2,<3'", ""),
        (2, "'plain' || p_partkey", "CAST(NULL AS VARCHAR)", ""),
    ],
)
_NODE = _expected(
    "node",
    "package.json",
    [
        (0, "w1", "'^1.' || p_size", "WHERE p_size > 1"),
        (1, "'n' || p_partkey", "'7'", "WHERE p_size > 1"),
        (2, "w2", "'~' || p_size", "WHERE p_size > 1"),
    ],
)
_GO = _expected(
    "go",
    "go.mod",
    [
        (0, "'example.org/' || w1", "'v1.' || p_size", ""),
        (1, "'example.org/' || w2 || '/v2'", "'v2.' || p_size", ""),
    ],
)
_JAVA = _expected(
    "java",
    "pom.xml",
    [
        (0, "'org.' || w1 || ':a' || p_partkey", "'1.' || p_size", "WHERE p_size <> 2"),
        (1, "'org.' || w2 || ':b'", "CAST(NULL AS VARCHAR)", "WHERE p_size <> 2"),
    ],
)
_RUST = _expected(
    "rust",
    "Cargo.toml",
    [
        (0, "w1", "'1.' || p_size", ""),
        (1, "w2 || '_x'", "'2.' || p_size", ""),
        (2, "'d' || p_partkey", "''", ""),
    ],
)


@check("txt1_parse_requirements", _PYTHON)
def txt1(spark, sf):
    return manifests.parse_requirements(_files(spark, sf, "python"))


@check("txt2_parse_package_json", _NODE)
def txt2(spark, sf):
    return manifests.parse_package_json(_files(spark, sf, "node"))


@check("txt3_parse_go_mod", _GO)
def txt3(spark, sf):
    return manifests.parse_go_mod(_files(spark, sf, "go"))


@check("txt4_parse_pom", _JAVA)
def txt4(spark, sf):
    return manifests.parse_pom(_files(spark, sf, "java"))


@check("txt5_parse_cargo", _RUST)
def txt5(spark, sf):
    return manifests.parse_cargo(_files(spark, sf, "rust"))


def _renamed(sql, file, column):
    return f"SELECT * REPLACE (replace(file_name, '-{file}', {column}) AS file_name) FROM ({sql})"


@check(
    "txt6_parse_manifests",
    " UNION ALL ".join(
        f"SELECT *, CAST(NULL AS VARCHAR) AS error FROM ({sql})"
        for sql in (
            _renamed(_PYTHON, "requirements.txt", "'.TXT'"),
            _renamed(_NODE, "package.json", "'.json'"),
            _renamed(_JAVA, "pom.xml", "'.xml'"),
        )
    )
    + """ UNION ALL SELECT p_partkey || '-' || f, NULL, NULL, NULL, NULL, 'unsupported manifest'
      FROM parts, (VALUES ('go.mod'), ('Cargo.toml')) v(f)""",
)
def txt6(spark, sf):
    # dispatch by suffix: go.mod and Cargo.toml are known by their exact name only
    name = (
        F.when(F.col("kind") == "python", F.replace("file_name", F.lit("-requirements.txt"), F.lit(".TXT")))
        .when(F.col("kind") == "node", F.replace("file_name", F.lit("-package.json"), F.lit(".json")))
        .when(F.col("kind") == "java", F.replace("file_name", F.lit("-pom.xml"), F.lit(".xml")))
        .otherwise(F.col("file_name"))
    )
    return manifests.parse_manifests(t.manifest_texts(spark, sf).withColumn("file_name", name))


@check(
    "txt7_github_slug",
    r"""+ u AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+',
        CASE WHEN page_id % 5 < 2 THEN 'git+https://github.com' ELSE 'https://code.example.org' END)
        || CASE WHEN contains(url, '#') THEN '' ELSE '.git' END AS link FROM pages),
    s AS (SELECT *, regexp_replace(regexp_replace(link, '^git\+', ''), '\.git$', '') AS plain FROM u)
    SELECT page_id, link, nullif(regexp_extract(plain, 'github\.com[/:]([^/\s]+)/([^/\s#?]+)', 1) || '/'
      || regexp_extract(plain, 'github\.com[/:]([^/\s]+)/([^/\s#?]+)', 2), '/') AS slug FROM s""",
)
def txt7(spark, sf):
    host = F.when(F.col("page_id") % 5 < 2, "git+https://github.com").otherwise(
        "https://code.example.org"
    )
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    ending = F.when(F.contains(F.col("url"), F.lit("#")), "").otherwise(".git")
    rows = t.table(spark, sf, "pages").select(
        "page_id", F.concat(host, path, ending).alias("link")
    )
    return rows.withColumn("slug", github_slug(F.col("link")))


@check(
    "txt8_go_module_slug",
    """SELECT DISTINCT name, CASE WHEN p_size < 10 THEN 'golang/' || dashed
      WHEN p_size >= 20 THEN own END AS slug FROM pk WHERE ecosystem = 'go'""",
)
def txt8(spark, sf):
    rows = t.packages(spark, sf).filter("ecosystem = 'go'").select("name")
    return rows.withColumn("slug", go_module_slug(F.col("name")))


_STATUS = ["ecosystem", "name", "occurrences", "full_name", "source", "confidence", "status"]


@check("txt9_resolve_packages", f"SELECT {', '.join(_STATUS)} FROM resolved")
def txt9(spark, sf):
    return t.resolved(spark, sf).select(*_STATUS)


@check(
    "txt9_cache_write_back",
    """SELECT ecosystem, name, split_part(full_name, '/', 1) AS org,
      substr(full_name, strpos(full_name, '/') + 1) AS repo, confidence FROM resolved""",
)
def txt9_cache(spark, sf):
    cache = t.cache(spark, sf)
    first = resolution.updated_cache(cache, t.resolved(spark, sf))
    again = resolution.updated_cache(first, t.resolved(spark, sf))
    return again.join(t.packages(spark, sf), ["ecosystem", "name"], "left_semi").drop("source")


@check(
    "agg22_resolution_summary",
    f"""+ c AS (SELECT {n("sum(occurrences)")} AS parsed,
      count(*) FILTER (status = 'resolved') AS resolved,
      {n("coalesce(sum(occurrences) FILTER (status = 'unresolved'), 0)")} AS unresolved FROM resolved)
    SELECT *, parsed - resolved - unresolved AS already_monitored,
      round_even(resolved * 100.0 / parsed, 0)::DOUBLE AS resolved_pct FROM c""",
)
def agg22(spark, sf):
    return resolution.resolution_summary(t.resolved(spark, sf))


@check(
    "jon5_new_projects",
    """+ d AS (SELECT manifest, pos, ecosystem, name, hit[1] AS repo_full_name FROM deps WHERE hit IS NOT NULL),
    f AS (SELECT repo_full_name, min((manifest, pos, ecosystem, name)) AS first FROM d GROUP BY ALL)
    SELECT repo_full_name, count(*) AS rows,
      count(*) FILTER ((manifest, pos, ecosystem, name) = first
        AND repo_full_name NOT IN (SELECT repo_full_name FROM curated)) > 0 AS added
    FROM d JOIN f USING (repo_full_name) GROUP BY ALL""",
)
def jon5(spark, sf):
    known = resolution.resolve_distinct(
        t.packages(spark, sf).select("ecosystem", "name").distinct(),
        t.cache(spark, sf),
        t.registry(spark, sf),
    ).filter("full_name IS NOT NULL")
    rows = t.dependencies(spark, sf).join(known, ["ecosystem", "name"])
    order = ["manifest", "pos", "ecosystem", "name"]
    flagged = watchlist.new_projects(rows, t.curated(spark, sf), order)
    return flagged.groupBy("repo_full_name").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_or("added").alias("added")
    )


@check(
    "jon6_classify_dependencies",
    """+ s AS (SELECT repo_full_name AS full_name, health_score FROM scores)
    SELECT 'ready' AS outcome, ecosystem, name, full_name, NULL AS confidence, health_score,
      occurrences AS rows FROM resolved LEFT JOIN s USING (full_name) WHERE status = 'monitored'
    UNION ALL SELECT 'added', ecosystem, name, full_name, confidence, NULL, 1
      FROM resolved WHERE status = 'resolved'
    UNION ALL SELECT 'unresolved', ecosystem, name, full_name, confidence, NULL, occurrences
      FROM resolved WHERE status = 'unresolved'""",
)
def jon6(spark, sf):
    # the outcome per package is read by two branches
    resolved = materialize_once(t.resolved(spark, sf))
    outcome = resolution.classify_dependencies(
        t.dependencies(spark, sf), resolved, t.scored(spark, sf)
    )
    return outcome.groupBy(*outcome.columns).agg(F.count(F.lit(1)).alias("rows"))


@check(
    "set_discovered_projects",
    """SELECT split_part(full_name, '/', 1) AS org, split_part(full_name, '/', 2) AS repo,
      'discovered' AS category, 'Discovered from manifest (' || ecosystem || ' package: ' || name || ')'
      AS description FROM resolved WHERE status = 'resolved'""",
)
def discovered(spark, sf):
    return resolution.discovered_projects(t.resolved(spark, sf))

from pyspark.sql import functions as F

from depsignal.operators import manifests, resolution
from depsignal.plans.onboarding import onboard
from depsignal.sources import documents


def parsed(spark, parser, *texts):
    df = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file_name string, content string")
    got = sorted(parser(df).collect(), key=lambda r: (r.file_name, r.pos))
    return [(r.name, r.version) for r in got]


def test_requirements(spark):
    text = (
        "﻿flask==1\nrequests>=2.0,<3\n# comment\n-r base.txt\n-e .\n\nuvicorn[standard]==0.1 # why\n"
        "attrs ; python_version < '3'\r\nweird @ https://x\nzope.interface\n  spaced == 1.0  \npkg[a,b]\n#x"
    )
    assert parsed(spark, manifests.parse_requirements, text) == [
        ("requests", ">=2.0,<3"),
        ("uvicorn", "==0.1"),
        ("attrs", None),
        ("zope.interface", None),
        ("spaced", "== 1.0"),
        ("pkg", None),
    ]


def test_package_json(spark):
    text = '{"peerDependencies": {"p": "1"}, "dependencies": {"b": "^1", "a": null, "n": 3}, "devDependencies": {"d": "*"}}'
    assert parsed(spark, manifests.parse_package_json, text) == [
        ("b", "^1"), ("a", "None"), ("n", "3"), ("d", "*"), ("p", "1"),
    ]
    assert parsed(spark, manifests.parse_package_json, '{"dependencies": {"a"', "{}", "", '{"dependencies": {}}') == []


def test_go_mod(spark):
    text = (
        "module m\n\nrequire a.b/one v1\nrequire (\n\ta.b/two v2 // indirect\n\t// a.b/no v0\n\tlonely\n"
        "\trequire a.b/three v3\n)\na.b/outside v9\n\trequire (\n a.b/four  v4\n"
    )
    assert parsed(spark, manifests.parse_go_mod, text) == [
        ("a.b/one", "v1"), ("a.b/two", "v2"), ("a.b/three", "v3"), ("a.b/four", "v4"),
    ]
    assert parsed(spark, manifests.parse_go_mod, "module m\n)\nx y\n") == []


def test_pom(spark):
    dep = "<dependency><groupId>g</groupId><artifactId>{}</artifactId>{}</dependency>"
    text = (
        '<project xmlns="http://m"><dependencyManagement>' + dep.format("x", "<version>1</version>")
        + "</dependencyManagement><dependencies>" + dep.format(" y ", "") + dep.format("", "")
        + "<dependency><artifactId>z</artifactId></dependency></dependencies></project>"
    )
    assert parsed(spark, manifests.parse_pom, text, "<project>") == [("g:x", "1"), ("g:y", None)]


def test_cargo(spark):
    text = (
        '[package]\nserde = "0"\n[dependencies]\nserde = "1" # c\n# x = "1"\ntokio = { features = ["a"], version = "2" }\n'
        'local = { path = "p" }\n\n[dependencies.big]\nversion = "3"\n[build-dependencies]\ncc="4"\n [dev-dependencies] \nd = ""\n'
    )
    assert parsed(spark, manifests.parse_cargo, text) == [("serde", "1"), ("tokio", "2"), ("cc", "4"), ("d", "")]


def test_dispatch(spark, rows):
    files = [
        ("requirements.txt", "a"), ("dev.TXT", "b"), ("package.json", '{"dependencies": {"c": "1"}}'),
        ("x.json", '{"dependencies": {"d": "1"}}'), ("go.mod", "require e v1"), ("Cargo.toml", '[dependencies]\nf = "1"'),
        ("other.toml", ""), (".txt", "g"), ("pom.xml", "<p><dependency><groupId>g</groupId><artifactId>h</artifactId></dependency></p>"),
    ]
    df = spark.createDataFrame(files, "file_name string, content string")
    assert rows(manifests.parse_manifests(df), "file_name", "name", "ecosystem", "error") == sorted(
        [
            ("requirements.txt", "a", "python", None), ("dev.TXT", "b", "python", None),
            ("package.json", "c", "node", None), ("x.json", "d", "node", None), ("go.mod", "e", "go", None),
            ("Cargo.toml", "f", "rust", None), ("pom.xml", "g:h", "java", None),
            ("other.toml", None, None, "unsupported manifest"), (".txt", None, None, "unsupported manifest"),
        ],
        key=repr,
    )


def test_read_manifests(spark, tmp_path, rows):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "requirements.txt").write_text("x\ny\n", encoding="utf-8")
    (tmp_path / "Base.TXT").write_text("", encoding="utf-8")
    df = documents.read_manifests(spark, str(tmp_path))
    assert ("requirements.txt", ".txt", "x\ny\n") in rows(df, "file_name", "suffix", "content")


CACHE = "ecosystem string, name string, org string, repo string, source string, confidence string"
REGISTRY = "ecosystem string, name string, project_urls map<string,string>, home_page string, repository string, search_hit string"
HUB = "https://github.com/"


def tables(spark):
    cache = spark.createDataFrame(
        [("python", "pandas", None, None, None, None), ("node", "kept", "c", "kept", "npm", "high")], CACHE
    )
    registry = spark.createDataFrame(
        [
            ("python", "pandas", {"Source": HUB + "w/w"}, None, None, None),
            ("python", "two", {"Code": HUB + "o/code", "Homepage": HUB + "o/home"}, None, None, None),
            ("python", "home", {"Docs": HUB + "no/no"}, HUB + "o/page", None, None),
            ("python", "found", None, "https://x", None, "s/hit"),
            ("python", "lost", None, "https://x", None, "nothit"),
            ("node", "kept", None, None, HUB + "w/w", None),
            ("node", "n", None, HUB + "o/h", "git+https://github.com/o/n.git", None),
            ("rust", "r", None, HUB + "o/r", None, None),
            ("java", "g:a", None, HUB + "o/never", None, None),
        ],
        REGISTRY,
    )
    return cache, registry


def test_resolution_priority(spark, rows):
    cache, registry = tables(spark)
    names = [
        ("python", "pandas"), ("python", "NumPy"), ("python", "two"), ("python", "home"), ("python", "found"),
        ("python", "lost"), ("python", "unlisted"), ("node", "kept"), ("node", "n"), ("rust", "r"), ("java", "g:a"),
        ("go", "k8s.io/api/v1"), ("node", "redis"),
    ]
    df = spark.createDataFrame(names, "ecosystem string, name string")
    got = {(r.ecosystem, r.name): (r.full_name, r.source, r.confidence) for r in resolution.resolve_distinct(df, cache, registry).collect()}
    none = (None, None, None)
    assert got == {
        ("python", "pandas"): none,  # a negative cache entry beats the known mapping
        ("python", "NumPy"): ("numpy/numpy", "known_mapping", "high"),
        ("python", "two"): ("o/home", "pypi", "high"),
        ("python", "home"): ("o/page", "pypi", "medium"),
        ("python", "found"): ("s/hit", "github_search", "low"),
        ("python", "lost"): none,
        ("python", "unlisted"): none,
        ("node", "kept"): ("c/kept", "npm", "high"),
        ("node", "n"): ("o/n", "npm", "high"),
        ("rust", "r"): ("o/r", "crates", "high"),
        ("java", "g:a"): none,
        ("go", "k8s.io/api/v1"): ("kubernetes/api", "go_module", "high"),
        ("node", "redis"): ("redis/redis-py", "known_mapping", "high"),
    }


def test_onboarding(spark, rows):
    """Against a row-by-row run of the rules, with a package in most manifests."""
    cache, registry = tables(spark)
    registry = registry.drop("search_hit")
    texts = [(f"m{i:02d}/requirements.txt", "two==1\nhome\nlost\n") for i in range(30)]
    texts = [(n.replace("/requirements", "-r"), c) for n, c in texts] + [("z.txt", "two\nNumPy\n"), ("setup.cfg", "[x]")]
    files = spark.createDataFrame(texts, "file_name string, content string")
    watch = spark.createDataFrame([("o", "page"), ("numpy", "numpy")], "org string, repo string")
    scores = spark.createDataFrame([("o/page", 6.5)], "repo_full_name string, health_score double")
    got = onboard(files, cache, registry, watch, scores)
    counted = got.groupBy("outcome", "name", "full_name", "confidence", "health_score").count()
    assert rows(counted) == sorted(
        [
            ("ready", "home", "o/page", None, 6.5, 30),
            ("ready", "NumPy", "numpy/numpy", None, None, 1),
            ("added", "two", "o/home", "high", None, 1),
            ("unresolved", "lost", None, None, None, 30),
            ("unsupported", "setup.cfg", None, None, None, 1),
        ],
        key=repr,
    )


def test_repeated_repositories(spark, rows):
    cache, registry = tables(spark)
    deps = spark.createDataFrame(
        [("f", 2, "rust", "r"), ("f", 1, "python", "r2"), ("f", 0, "python", "lost"), ("f", 3, "rust", "r")],
        "file_name string, pos int, ecosystem string, name string",
    )
    extra = spark.createDataFrame([("python", "r2", None, HUB + "o/r", None, None)], REGISTRY)
    watch = spark.createDataFrame([], "org string, repo string")
    got = resolution.resolve_packages(deps, cache, registry.unionByName(extra), watch, ["file_name", "pos"])
    assert rows(got, "name", "occurrences", "status") == [
        ("lost", 1, "unresolved"), ("r", 2, "repeated"), ("r2", 1, "resolved"),
    ]
    summary = resolution.resolution_summary(got).first().asDict()
    assert summary == {"parsed": 4, "resolved": 1, "unresolved": 1, "already_monitored": 2, "resolved_pct": 25.0}
    (project,) = resolution.discovered_projects(got).collect()
    assert project == ("o", "r", "discovered", "Discovered from manifest (python package: r2)")
    none = resolution.resolution_summary(got.limit(0)).first()
    assert (none.parsed, none.resolved_pct) == (0, 0.0)


def test_parts_of_one_small_file_are_parsed_by_many_tasks(spark):
    from depsignal.checks import tables

    files = tables.manifest_texts(spark, "/root/testdata/sf0.01").withColumn("task", F.spark_partition_id())
    assert files.select("task").distinct().count() >= 4

"""Dependency manifests to dependency rows.

Four formats are parsed by column expressions inside one projection; XML needs
a real parser and runs in Arrow batches.
"""

import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsignal import schemas
from depsignal.functions.text import empty_to_null, lines, strip

# Line patterns of the formats.
REQUIREMENT = r"^([A-Za-z0-9_.\-]+)(\[.*?\])?\s*([><=!~,\s\d.*]+)?$"
GO_REQUIRE = r"^require\s+(\S+)\s+(\S+)"
CARGO_SIMPLE = r'^([A-Za-z0-9_\-]+)\s*=\s*"([^"]*)"'
CARGO_INLINE = r'^([A-Za-z0-9_\-]+)\s*=\s*\{.*?version\s*=\s*"([^"]*)"'

# Sections that hold dependencies, in reading order.
NODE_SECTIONS = ("dependencies", "devDependencies", "peerDependencies")
CARGO_SECTIONS = ("[dependencies]", "[dev-dependencies]", "[build-dependencies]")

# Parser by exact file name, then by suffix.
BY_NAME = {
    "requirements.txt": "python",
    "package.json": "node",
    "go.mod": "go",
    "pom.xml": "java",
    "Cargo.toml": "rust",
}
BY_SUFFIX = {".txt": "python", ".json": "node", ".xml": "java"}


def _dep(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"))


def _requirement_deps(text: Column) -> Column:
    """Options, comments and environment markers are cut; odd lines are dropped."""

    def bare(line):
        line = strip(F.substring_index(line, "#", 1))
        return strip(F.substring_index(line, ";", 1))

    kept = F.filter(
        F.transform(lines(text), strip), lambda x: ~x.startswith("#") & ~x.startswith("-")
    )
    matched = F.filter(F.transform(kept, bare), lambda x: x.rlike(REQUIREMENT))
    return F.transform(
        matched,
        lambda x: _dep(
            F.regexp_extract(x, REQUIREMENT, 1),
            empty_to_null(strip(F.regexp_extract(x, REQUIREMENT, 3))),
        ),
    )


def _package_json_deps(text: Column) -> Column:
    ddl = ", ".join(f"{s} MAP<STRING, STRING>" for s in NODE_SECTIONS)
    parsed = F.from_json(text, ddl)
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = [F.coalesce(F.map_entries(parsed.getField(s)), none) for s in NODE_SECTIONS]
    return F.transform(
        F.concat(*entries),
        lambda e: _dep(e.getField("key"), F.coalesce(e.getField("value"), F.lit("None"))),
    )


def _plain(text: Column, comment: str) -> Column:
    """Stripped lines without comment lines, joined again."""
    kept = F.filter(F.transform(lines(text), strip), lambda x: ~x.startswith(comment))
    return F.array_join(kept, "\n")


def _go_deps(text: Column) -> Column:
    """Single requires anywhere, and every line inside a require block."""
    segments = F.split(_plain(text, "//"), r"(?md)^require \($")

    def tagged(block, inside):
        return F.transform(
            F.split(block, "\n"), lambda x: F.struct(F.lit(inside).alias("inside"), x.alias("line"))
        )

    def segment(block, i):
        parts = F.split(block, r"(?md)^\)$", 2)
        rest = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
        return F.when(i == 0, tagged(block, False)).otherwise(
            F.concat(tagged(F.get(parts, F.lit(0)), True), tagged(rest, False))
        )

    def dep(x):
        line = x.getField("line")
        words = F.split(line, r"(?U)\s+")
        return (
            F.when(
                line.rlike(GO_REQUIRE),
                _dep(F.regexp_extract(line, GO_REQUIRE, 1), F.regexp_extract(line, GO_REQUIRE, 2)),
            )
            .when(
                x.getField("inside") & (F.size(words) >= 2),
                _dep(F.get(words, F.lit(0)), F.get(words, F.lit(1))),
            )
        )

    tokens = F.flatten(F.transform(segments, segment))
    return F.filter(F.transform(tokens, dep), lambda d: d.isNotNull())


def _cargo_deps(text: Column) -> Column:
    """Entries of the three dependency sections with a version on the same line."""
    sections = F.filter(
        F.split(_plain(text, "#"), r"(?md)^(?=\[)"),
        lambda s: F.substring_index(s, "\n", 1).isin(*CARGO_SECTIONS),
    )

    def entry(line, pattern):
        return _dep(F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2))

    def dep(line):
        return F.when(line.rlike(CARGO_SIMPLE), entry(line, CARGO_SIMPLE)).when(
            line.rlike(CARGO_INLINE), entry(line, CARGO_INLINE)
        )

    entries = F.flatten(F.transform(sections, lambda s: F.split(s, "\n")))
    return F.filter(F.transform(entries, dep), lambda d: d.isNotNull())


_NATIVE = {
    "python": _requirement_deps,
    "node": _package_json_deps,
    "go": _go_deps,
    "rust": _cargo_deps,
}


def _exploded(files: DataFrame, deps: Column, ecosystem: Column) -> DataFrame:
    return files.select(
        "file_name", F.posexplode(deps).alias("pos", "d"), ecosystem.alias("ecosystem")
    ).select("file_name", "pos", "d.name", "d.version", "ecosystem")


def _parse(files: DataFrame, ecosystem: str) -> DataFrame:
    return _exploded(files, _NATIVE[ecosystem](F.col("content")), F.lit(ecosystem))


def parse_requirements(files: DataFrame) -> DataFrame:
    return _parse(files, "python")


def parse_package_json(files: DataFrame) -> DataFrame:
    return _parse(files, "node")


def parse_go_mod(files: DataFrame) -> DataFrame:
    return _parse(files, "go")


def parse_cargo(files: DataFrame) -> DataFrame:
    return _parse(files, "rust")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _pom_rows(file_name: str, content: str) -> Iterator[tuple]:
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError:
        return
    pos = 0
    for element in root.iter():
        if _local(element.tag) != "dependency":
            continue
        fields = {}
        for child in element:
            fields.setdefault(_local(child.tag), (child.text or "").strip() or None)
        group, artifact = fields.get("groupId"), fields.get("artifactId")
        if group and artifact:
            yield file_name, pos, f"{group}:{artifact}", fields.get("version"), "java"
            pos += 1


def _pom_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file_name", "pos", "name", "version", "ecosystem"]
    for batch in batches:
        rows = [
            row
            for name, content in zip(batch["file_name"], batch["content"])
            for row in _pom_rows(name, content)
        ]
        frame = pd.DataFrame(rows, columns=columns)
        yield frame.astype({"pos": "int32"})


def parse_pom(files: DataFrame) -> DataFrame:
    """Every <dependency> element with group and artifact; bad XML gives no rows."""
    return files.select("file_name", "content").mapInPandas(_pom_batches, schemas.DEPENDENCY)


def manifest_kind(file_name: Column) -> Column:
    """Parser for a file name: exact name first, then suffix; NULL if unsupported."""
    suffix = F.lower(F.regexp_extract(file_name, r".(\.[^.]+)$", 1))
    kind = None
    for name, value in BY_NAME.items():
        kind = F.when(file_name == name, value) if kind is None else kind.when(
            file_name == name, value
        )
    for ending, value in BY_SUFFIX.items():
        kind = kind.when(suffix == ending, value)
    return kind


def parse_manifests(files: DataFrame) -> DataFrame:
    """All dependencies of supported files, and one error row per unsupported file."""
    typed = files.withColumn("ecosystem", manifest_kind(F.col("file_name")))
    content, kind = F.col("content"), F.col("ecosystem")
    deps = None
    for name, parser in _NATIVE.items():
        value = parser(content)
        deps = F.when(kind == name, value) if deps is None else deps.when(kind == name, value)
    none = F.lit(None).cast("string")
    native = _exploded(typed.filter(kind.isin(*_NATIVE)), deps, kind).withColumn("error", none)
    pom = parse_pom(typed.filter(kind == "java")).withColumn("error", none)
    bad = typed.filter(kind.isNull()).select(
        "file_name",
        F.lit(None).cast("int").alias("pos"),
        none.alias("name"),
        none.alias("version"),
        none.alias("ecosystem"),
        F.lit("unsupported manifest").alias("error"),
    )
    return native.unionByName(pom).unionByName(bad)

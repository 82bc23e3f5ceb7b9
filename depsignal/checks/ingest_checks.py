"""Sources, sinks, projections, bookkeeping and streaming."""

from pyspark.sql import functions as F

from depsignal import schemas
from depsignal.checks import tables as t
from depsignal.checks.prelude import n
from depsignal.checks.registry import check
from depsignal.checks.report_checks import RENDERED
from depsignal.functions import names
from depsignal.operators import ingest, metrics, silver
from depsignal.plans import backfill, ingestion
from depsignal.session import scratch_path
from depsignal.sources import documents, events, filters, tables, versions
from depsignal.sources.tables import materialize_once
from depsignal.streaming import events as streams

_FLAT_SQL = """SELECT id, type, actor_login, repo_full_name, payload_action, payload_commits,
  created_text AS created_at FROM bronze"""


def _flat(df):
    return df.select(
        "id",
        "type",
        F.col("actor.login").alias("actor_login"),
        F.col("repo.name").alias("repo_full_name"),
        F.col("payload.action").alias("payload_action"),
        F.when(F.col("payload.commits").isNotNull(), F.size("payload.commits")).alias(
            "payload_commits"
        ),
        "created_at",
    )


def _event_files(spark, sf):
    """The bronze events as gzipped JSON lines in the scratch folder."""
    path = scratch_path(spark, "bronze")
    t.bronze(spark, sf).drop("value").write.option("compression", "gzip").json(path)
    return path


def _cut_lines(spark, sf):
    """The bronze events as JSON lines; those of small values lack their end."""
    path = scratch_path(spark, "lines")
    rows = t.bronze(spark, sf)
    line = F.to_json(F.struct(*[c for c in rows.columns if c != "value"]))
    cut = F.when(F.col("value") < 2, F.expr("left(line, length(line) - 3)")).otherwise(F.col("line"))
    rows.select(line.alias("line"), "value").select(cut.alias("value")).write.option(
        "compression", "gzip"
    ).text(path)
    return path


def _half(spark, sf, path, late):
    """Write one half of January's events, as more files of the same folder."""
    early = F.col("created_at") < "2024-01-16"
    rows = t.bronze(spark, sf).drop("value").filter(~early if late else early)
    rows.write.mode("append").option("compression", "gzip").json(path)


@check("src1_read_events", _FLAT_SQL)
def src1(spark, sf):
    clean, _ = events.split_corrupt(events.read_events(spark, _event_files(spark, sf)))
    return _flat(clean)


@check(
    "src2_split_corrupt",
    "SELECT CASE WHEN value >= 2 THEN id END AS id, value < 2 AS corrupt FROM bronze",
)
def src2(spark, sf):
    path = _cut_lines(spark, sf)
    clean, bad = events.split_corrupt(events.read_events(spark, path))
    return clean.select("id", F.lit(False).alias("corrupt")).unionByName(
        bad.select(F.lit(None).cast("string").alias("id"), F.lit(True).alias("corrupt"))
    )


@check(
    "src3_select_days",
    """SELECT event_id, event_type, repo_full_name, event_date FROM first_delivery
    WHERE event_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'""",
)
def src3(spark, sf):
    path = scratch_path(spark, "silver")
    events.append_silver(t.first_delivery(spark, sf), path)
    stored = spark.read.schema(schemas.SILVER).parquet(path)
    days = events.select_days(stored, "2024-01-10", "2024-01-12")
    return days.select("event_id", "event_type", "repo_full_name", "event_date")


@check(
    "src4_read_manifests",
    f"""SELECT brand AS brand, '.txt' AS suffix, count(*) AS lines,
      {n("sum(strlen(p_name || '==' || p_size) + 1)")} AS bytes,
      md5(string_agg(p_name || '==' || p_size, chr(10) ORDER BY p_name || '==' || p_size)) AS content_md5
    FROM parts GROUP BY ALL""",
)
def src4(spark, sf):
    path = scratch_path(spark, "manifests")
    t.table(spark, sf, "part").select(
        t._brand().alias("brand"),
        F.concat("p_name", F.lit("=="), F.col("p_size").cast("string")).alias("line"),
    ).write.partitionBy("brand").text(path)
    files = documents.read_manifests(spark, path)
    # Spark may write a brand as several files; their lines together are the manifest
    lines = F.filter(F.split("content", "\n"), lambda x: x != "")
    return (
        files.groupBy(
            F.regexp_extract("file_path", r"brand=(\d+)", 1).cast("int").alias("brand"), "suffix"
        )
        .agg(
            F.sum(F.size(F.split("content", "\n")) - 1).alias("lines"),
            F.sum(F.octet_length("content")).alias("bytes"),
            F.md5(F.array_join(F.sort_array(F.flatten(F.collect_list(lines))), "\n")).alias("content_md5"),
        )
    )


@check(
    "src5_read_reports",
    RENDERED
    + """, counted AS (SELECT file_name, count(*) AS sections FROM filed GROUP BY ALL)
    SELECT file_name, sections, md5(content) AS content_md5 FROM rendered JOIN counted USING (file_name)""",
)
def src5(spark, sf):
    path = scratch_path(spark, "reports")
    made = materialize_once(t.reports(spark, sf))
    for _ in range(2):  # a report of the same name replaces the earlier one
        documents.write_reports(made, path)
    stored = documents.read_reports(spark, path)
    return stored.select(
        "file_name",
        F.regexp_count("content", F.lit(r"(?m)^### .+")).cast("bigint").alias("sections"),
        F.md5("content").alias("content_md5"),
    )


@check(
    "snk1_write_bronze",
    """SELECT split_part(repo_full_name, '/', 1) AS org_name, CAST(created_at AS DATE) AS date,
      count(*) AS events FROM bronze GROUP BY ALL""",
)
def snk1(spark, sf, layout=("org_name", "date")):
    path = scratch_path(spark, "raw")
    for _ in range(2):  # the same hours once more replace themselves
        events.write_bronze(t.bronze(spark, sf).drop("value"), path, layout)
    clean, _ = events.split_corrupt(events.read_events(spark, path))
    return clean.groupBy("org_name", "date").agg(F.count("id").alias("events"))


def _morning(spark, sf):
    """The part of the first delivery that is already stored."""
    return silver.dedup_latest(t.first_delivery(spark, sf).filter(F.hour("created_at") < 12))


_MERGED = """+ stored AS (
  SELECT * FROM first_delivery WHERE hour(created_at) < 12
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY payload_action DESC NULLS LAST,
    payload_commits DESC NULLS LAST) = 1),
merged AS (
  SELECT * FROM stored UNION ALL
  SELECT * FROM staged WHERE event_id NOT IN (SELECT event_id FROM stored))
"""


@check(
    "snk2_merge_insert_only",
    _MERGED
    + """SELECT event_id, event_type, payload_action, payload_commits,
      strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS ingested_at FROM merged""",
)
def snk2(spark, sf):
    path = scratch_path(spark, "silver")
    events.append_silver(_morning(spark, sf), path)
    events.merge_into_path(spark, path, tables.materialize_once(t.silver_events(spark, sf)))
    return spark.read.schema(schemas.SILVER).parquet(path).select(
        "event_id",
        "event_type",
        "payload_action",
        "payload_commits",
        F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"),
    )


@check(
    "snk2_merge_filtered",
    """+ d AS (SELECT DISTINCT event_id, event_date FROM first_delivery)
    SELECT event_id, event_date FROM d""",
)
def snk2_filtered(spark, sf):
    target, batch = scratch_path(spark, "silver"), t.first_delivery(spark, sf)
    ingestion.start_silver(batch, target)
    # early hours, then late ones, then all events once more
    early = F.hour("created_at") < 12
    for part in (batch.filter(early), batch.filter(~early), batch):
        filters.merge_filtered(spark, target, materialize_once(part))
    return spark.read.schema(schemas.SILVER).parquet(target).select("event_id", "event_date")


@check(
    "snk3_merge_stats",
    _MERGED
    + """SELECT *, rows_after - rows_before AS rows_added,
      rows_incoming - (rows_after - rows_before) AS rows_duplicate
    FROM (SELECT (SELECT count(*) FROM stored) AS rows_before,
      (SELECT count(*) FROM silver) AS rows_incoming,
      (SELECT count(*) FROM merged) AS rows_after)""",
)
def snk3(spark, sf):
    before = _morning(spark, sf)
    incoming = t.silver_events(spark, sf)
    after = before.unionByName(events.merge_insert_only(before, incoming))
    return events.merge_stats(before, incoming, after)


@check(
    "snk4_materialize_once",
    """SELECT event_type, count(*) AS events, count(DISTINCT repo_full_name) AS repos
    FROM silver GROUP BY ALL""",
)
def snk4(spark, sf):
    once = tables.materialize_once(t.silver_events(spark, sf))
    return once.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("repo_full_name").alias("repos")
    )


@check("snk5_overwrite_table", "SELECT * FROM cards")
def snk5(spark, sf):
    name = "depsignal_scorecard"
    stored = tables.overwrite_table(t.fetched_cards(spark, sf), name, scratch_path(spark, name))
    return stored.drop("fetched_at")


@check(
    "snk6_build_model",
    """SELECT repo_full_name, health_score, commit_score, issue_score, pr_score, contributor_score,
      bus_factor_score, governance_score, security_score FROM scores""",
)
def snk6(spark, sf):
    from depsignal.plans.gold import build_gold

    build_gold(spark, t.silver_events(spark, sf), t.cards(spark, sf), scratch_path(spark, "gold"))
    return spark.table("gold_health_scores").select("repo_full_name", *schemas.SIGNALS)


@check(
    "snk7_export_csv",
    f"SELECT {', '.join(schemas.EXPORT_COLUMNS)} FROM scores WHERE health_score < 6",
)
def snk7(spark, sf):
    path = scratch_path(spark, "csv")
    tables.export_csv(t.scored(spark, sf).filter("health_score < 6"), path)
    kinds = ["STRING"] + ["DOUBLE"] * 6 + ["BIGINT"]
    ddl = ", ".join(f"{c} {k}" for c, k in zip(schemas.EXPORT_COLUMNS, kinds))
    return spark.read.schema(ddl).option("header", True).csv(path)


@check(
    "snk8_upsert_by_id",
    """SELECT vec_id, CASE WHEN label >= 5 THEN label + 200 ELSE label END AS label,
      CASE WHEN label >= 5 THEN 2 ELSE 0 END AS version FROM embeddings""",
)
def snk8(spark, sf):
    stored = t.table(spark, sf, "embeddings").select("vec_id", "label", F.lit(0).alias("version"))
    new = stored.filter("label >= 5").select(
        "vec_id", "label", F.explode(F.array(F.lit(1), F.lit(2))).alias("version")
    )
    new = new.withColumn("label", F.col("label") + F.col("version") * 100)
    name = "depsignal_vectors"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    tables.upsert_table(spark, name, stored, "vec_id", "version")
    for _ in range(2):
        found = tables.upsert_table(spark, name, new, "vec_id", "version", ("label",))
    return found


@check(
    "snk8_versioned_upsert",
    """SELECT vec_id, CASE WHEN label >= 5 THEN label + 200 ELSE label END AS label,
      CASE WHEN label >= 5 THEN 2 ELSE 0 END AS version FROM embeddings""",
)
def snk8_versioned(spark, sf):
    stored = t.table(spark, sf, "embeddings").select("vec_id", "label", F.lit(0).alias("version"))
    new = stored.filter("label >= 5").select(
        "vec_id", "label", F.explode(F.array(F.lit(1), F.lit(2))).alias("version")
    )
    new = new.withColumn("label", F.col("label") + F.col("version") * 100)
    root = scratch_path(spark, "vectors")
    versions.create_versioned(spark, root, stored.schema, "vec_id", 8)
    versions.upsert_version(spark, root, stored, "version")
    for _ in range(2):
        versions.upsert_version(spark, root, new, "version", ("label",))
    versions.drop_versions(spark, root, grace_hours=0)
    return versions.read_version(spark, root)


@check(
    "snk9_create_silver",
    "SELECT event_date, count(*) AS events FROM first_delivery GROUP BY ALL",
)
def snk9(spark, sf):
    name = "depsignal_silver"
    path = scratch_path(spark, name)
    for _ in range(2):  # made anew at the same path, the table begins empty
        events.create_silver(spark, name, path, recreate=True)
        t.first_delivery(spark, sf).select(*spark.table(name).columns).hint(
            "rebalance", "event_date"
        ).write.insertInto(name)
    return spark.table(name).groupBy("event_date").agg(F.count(F.lit(1)).alias("events"))


@check(
    "prj1_to_silver",
    """SELECT event_id, event_type, actor_login, actor_id, repo_full_name, repo_id, event_date,
      strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, payload_action, payload_commits,
      org_name, repo_name FROM first_delivery""",
)
def prj1(spark, sf):
    rows = silver.to_silver(silver.filter_event_types(t.bronze(spark, sf)))
    return rows.drop("ingested_at").withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    )


@check(
    "prj2_event_key",
    """SELECT id, sha256(concat_ws('|', type, actor_login, repo_full_name, created_text)) AS event_id
    FROM bronze""",
)
def prj2(spark, sf):
    key = names.event_key(
        F.col("type"), F.col("actor.login"), F.col("repo.name"), F.col("created_at")
    )
    return t.bronze(spark, sf).select("id", key.alias("event_id"))


@check(
    "prj3_vector_key",
    """SELECT repo_full_name, substr(sha256(repo_full_name || '|risk_report_' || p_type || '.md'), 1, 40)
      AS vec_id FROM parts""",
)
def prj3(spark, sf):
    repo = t.repo_of(F.col("p_partkey"))
    file = F.concat(F.lit("risk_report_"), F.col("p_type"), F.lit(".md"))
    return t.table(spark, sf, "part").select(
        repo.alias("repo_full_name"), names.vector_key(repo, file).alias("vec_id")
    )


@check("flt1_filter_event_types", "SELECT id, type FROM bronze WHERE type <> 'CreateEvent'")
def flt1(spark, sf):
    return silver.filter_event_types(t.bronze(spark, sf)).select("id", "type")


@check(
    "flt2_require_keys",
    """SELECT type AS event_type, count(*) AS events FROM bronze WHERE value >= 3 AND value <= 200
    GROUP BY ALL""",
)
def flt2(spark, sf):
    broken = t.bronze(spark, sf).withColumns(
        {
            "repo": F.when(F.col("value") >= 3, F.col("repo")),
            "created_at": F.when(F.col("value") > 200, "yesterday").otherwise(F.col("created_at")),
        }
    )
    rows = silver.require_keys(silver.to_silver(broken))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@check(
    "jon1_filter_watchlist",
    """SELECT id, repo_full_name FROM bronze
    WHERE repo_full_name IN (SELECT repo_full_name FROM curated)""",
)
def jon1(spark, sf):
    kept = silver.filter_watchlist(t.bronze(spark, sf), t.curated(spark, sf))
    return kept.select("id", F.col("repo.name").alias("repo_full_name"))


@check("win1_dedup_latest", "SELECT * REPLACE (CAST(ingested_at AS VARCHAR) AS ingested_at, CAST(created_at AS VARCHAR) AS created_at) FROM staged")
def win1(spark, sf):
    return t.staged(spark, sf).withColumns(
        {
            c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
            for c in ("ingested_at", "created_at")
        }
    )


_SPINE = """+ spine AS (
  SELECT CAST(d AS DATE) AS date, CAST(h AS INTEGER) AS hour
  FROM (SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS d
        FROM events), range(24) r(h))
"""


def _spine(spark, sf):
    day = F.to_date("ts")
    return ingest.hour_spine(
        t.table(spark, sf, "events").agg(F.min(day).alias("start"), F.max(day).alias("end"))
    )


@check("ing1_hour_spine", _SPINE + "SELECT * FROM spine")
def ing1(spark, sf):
    return _spine(spark, sf)


@check(
    "ing2_missing_hours",
    _SPINE
    + """SELECT * FROM spine WHERE (date, hour) NOT IN (
      SELECT (CAST(created_at AS DATE), CAST(hour(created_at) AS INTEGER)) FROM bronze
      WHERE type = 'ForkEvent')""",
)
def ing2(spark, sf):
    at = silver.event_time("created_at")
    done = t.bronze(spark, sf).filter("type = 'ForkEvent'").select(
        F.to_date(at).alias("date"), F.hour(at).alias("hour")
    )
    return ingest.missing_hours(_spine(spark, sf), done.distinct())


_HOURS = f"""SELECT CAST(created_at AS DATE) AS date, CAST(hour(created_at) AS INTEGER) AS hour,
  count(*) AS events_downloaded,
  count(*) FILTER (c.repo_full_name IS NOT NULL) AS events_filtered,
  count(DISTINCT c.repo_full_name) AS projects_with_events
FROM bronze b LEFT JOIN curated c USING (repo_full_name) GROUP BY ALL"""


@check("agg17_ingest_hour_stats", _HOURS)
def agg17(spark, sf):
    return ingest.ingest_hour_stats(t.bronze(spark, sf), t.curated(spark, sf))


_FIRST_DAYS = "DATE '2024-01-15'"


@check(
    "ing3_backfill_hours",
    _SPINE
    + f""", h AS ({_HOURS}),
    j AS (SELECT s.date, s.hour, h.events_downloaded, h.events_filtered, h.projects_with_events,
      s.date <= {_FIRST_DAYS} AND h.date IS NOT NULL AS skipped
      FROM spine s LEFT JOIN h ON h.date = s.date AND h.hour = s.hour)
    SELECT date, hour,
      CASE WHEN skipped THEN 0 ELSE coalesce(events_downloaded, 0) END AS events_downloaded,
      CASE WHEN skipped THEN 0 ELSE coalesce(events_filtered, 0) END AS events_filtered,
      CASE WHEN skipped THEN 0 ELSE coalesce(projects_with_events, 0) END AS projects_with_events, skipped,
      CASE WHEN NOT skipped AND events_downloaded IS NULL THEN 'no events landed' END AS error FROM j""",
)
def ing3(spark, sf):
    target, markers = scratch_path(spark, "raw"), scratch_path(spark, "markers")
    landed, day = t.bronze(spark, sf).drop("value"), F.to_date("ts")
    ends = t.table(spark, sf, "events").agg(F.min(day).alias("start"), F.max(day).alias("end"))
    first = ends.select("start", F.lit("2024-01-15").cast("date").alias("end"))
    layout = ("date", "hour")
    backfill.backfill(spark, first, landed, t.curated(spark, sf), target, markers, layout)
    return backfill.backfill(spark, ends, landed, t.curated(spark, sf), target, markers, layout)


@check(
    "ing4_silver_counters",
    f"""+ u AS (SELECT count(*) AS raw, count(*) FILTER (value < 2) AS corrupt FROM bronze),
    k AS (SELECT count(*) AS sent FROM bronze WHERE value >= 2 AND type <> 'CreateEvent'),
    d AS (SELECT count(DISTINCT sha256(concat_ws('|', type, actor_login, repo_full_name, created_text))) AS inserted
      FROM bronze WHERE value >= 2 AND type <> 'CreateEvent')
    SELECT 1 AS run, raw, corrupt, raw - corrupt AS kept, sent, inserted, sent - inserted AS duplicate FROM u, k, d
    UNION ALL SELECT 2, raw, corrupt, raw - corrupt, sent, 0, sent FROM u, k, d""",
)
def ing4(spark, sf):
    path, target = _cut_lines(spark, sf), scratch_path(spark, "silver")
    ingestion.start_silver(t.first_delivery(spark, sf), target)
    counts = [ingestion.load_silver_counted(spark, path, target) for _ in range(2)]
    rows = [{"run": k, **c} for k, c in enumerate(counts, 1)]
    return spark.createDataFrame(rows, "run INT, raw BIGINT, corrupt BIGINT, kept BIGINT, sent BIGINT, inserted BIGINT, duplicate BIGINT")


@check(
    "agg18_backfill_summary",
    f"""+ hours AS (SELECT *, projects_with_events = 0 AS skipped,
      CASE WHEN events_filtered > events_downloaded - 2 THEN 'timeout' END AS error FROM ({_HOURS})),
    s AS (SELECT count(*) AS hours_attempted,
      count(*) FILTER (NOT skipped AND error IS NULL) AS hours_succeeded,
      count(*) FILTER (skipped) AS hours_skipped,
      count(*) FILTER (NOT skipped AND error IS NOT NULL) AS hours_failed,
      {n("coalesce(sum(events_downloaded) FILTER (NOT skipped AND error IS NULL), 0)")} AS total_events_downloaded,
      {n("coalesce(sum(events_filtered) FILTER (NOT skipped AND error IS NULL), 0)")} AS total_events_filtered,
      {n("coalesce(sum(projects_with_events) FILTER (NOT skipped AND error IS NULL), 0)")} AS total_files_written
      FROM hours)
    SELECT *, coalesce(hours_succeeded::DOUBLE / nullif(hours_attempted - hours_skipped, 0), 1.0::DOUBLE)
      AS success_rate FROM s""",
)
def agg18(spark, sf):
    stats = agg17(spark, sf)
    hours = stats.withColumns(
        {
            "skipped": F.col("projects_with_events") == 0,
            "error": F.when(F.col("events_filtered") > F.col("events_downloaded") - 2, "timeout"),
        }
    )
    return ingest.backfill_summary(hours)


@check(
    "agg6_event_type_counts",
    "SELECT type, count(*) AS events FROM bronze WHERE type <> 'CreateEvent' GROUP BY ALL",
)
def agg6(spark, sf):
    return metrics.event_type_counts(silver.filter_event_types(t.bronze(spark, sf)))


@check("str1_stream_events", _FLAT_SQL + " WHERE value >= 2")
def str1(spark, sf):
    # lines of small values are cut, so that they are no JSON
    source, sink = _cut_lines(spark, sf), scratch_path(spark, "sink")
    stream = _flat(streams.stream_events(spark, source, max_files=4))
    streams.run_available(stream, sink, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


@check(
    "str2_stream_insert_only",
    "SELECT DISTINCT event_id, event_type, repo_full_name, event_date FROM first_delivery",
)
def str2(spark, sf):
    source, target = scratch_path(spark, "bronze"), scratch_path(spark, "silver")
    progress = scratch_path(spark, "progress")
    ingestion.start_silver(t.first_delivery(spark, sf), target)
    # the later half comes first, then the earlier one, then all events once more
    for late in (True, False, True, False):
        _half(spark, sf, source, late)
        stream = streams.stream_events(spark, source, max_files=6)
        streams.stream_insert_only(stream, target, progress).awaitTermination()
    stored = spark.read.schema(schemas.SILVER).parquet(target)
    return stored.select("event_id", "event_type", "repo_full_name", "event_date")


@check("str3_stream_hour_stats", _HOURS)
def str3(spark, sf):
    source, store = scratch_path(spark, "bronze"), scratch_path(spark, "counts")
    progress = scratch_path(spark, "progress")
    for late in (True, False):
        _half(spark, sf, source, late)
        streams.stream_hour_counts(streams.stream_events(spark, source, max_files=2), store, progress).awaitTermination()
    return streams.stored_hour_stats(spark, store, t.curated(spark, sf))


@check(
    "str2_insert_within_watermark",
    "SELECT DISTINCT event_id, event_type, repo_full_name, event_date FROM first_delivery",
)
def str2_once(spark, sf):
    source, target = scratch_path(spark, "bronze"), scratch_path(spark, "silver")
    progress = scratch_path(spark, "progress")
    ingestion.start_silver(t.first_delivery(spark, sf), target)
    # the later half comes first, then the earlier one, then all events once more
    for late in (True, False, True, False):
        _half(spark, sf, source, late)
        stream = streams.stream_events(spark, source, max_files=6)
        streams.stream_insert_once(stream, target, progress).awaitTermination()
    stored = spark.read.schema(schemas.SILVER).parquet(target)
    return stored.select("event_id", "event_type", "repo_full_name", "event_date")


@check(
    "str3_closed_hours",
    """SELECT CAST(created_at AS DATE) AS date, CAST(hour(created_at) AS INTEGER) AS hour, repo_full_name AS repo, count(*) AS n
    FROM bronze WHERE date_trunc('hour', created_at) + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM bronze) - INTERVAL 2 HOUR
    GROUP BY ALL""",
)
def str3_closed(spark, sf):
    source, sink = _event_files(spark, sf), scratch_path(spark, "closed")
    stream = streams.stream_events(spark, source)
    streams.stream_tumbling_hours(stream, sink, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(sink)

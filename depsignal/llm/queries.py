"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def put(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file, which is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


@registered("op1_token_store")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depsignal.llm import storage, token_store

    docs = table(spark, sf_dir, "documents")
    folder = storage.shared_folder(spark, "tokens")
    return token_store.read_digests(token_store.write_tokens(docs, folder, tokenizer_file("byte_bpe_50k.json"), end_id=2))


@registered("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depsignal.llm import sentencepiece_codec

    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@registered(
    "op6_url_filter",
    r"""
    WITH parts AS (
        SELECT page_id,
               CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
               CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
        FROM pages
    ),
    rules(verdict, rule_host, rule_path) AS (
        VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
               ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
    ),
    matched AS (
        SELECT page_id, host, path, r.rule_host || r.rule_path AS rule, r.verdict,
               row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.rule_host) DESC, length(r.rule_path) DESC) AS place
        FROM parts JOIN rules r ON (host = r.rule_host OR ends_with(host, '.' || r.rule_host)) AND starts_with(path, r.rule_path)
    )
    SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
    FROM parts p LEFT JOIN (SELECT DISTINCT page_id, host, path, rule, verdict FROM matched WHERE place = 1) m
      ON m.page_id = p.page_id AND m.host = p.host AND m.path = p.path
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depsignal.llm.url_filter import ALLOW, BLOCK, Rule, filter_urls

    rules = [
        Rule(ALLOW, "org", "/"),
        Rule(BLOCK, "example.org", "/es/"),
        Rule(BLOCK, "example.org", "/en/1"),
        Rule(ALLOW, "com", "/fr/"),
        Rule(BLOCK, "com", "/de/"),
    ]
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@registered(
    "op9_near_dedup",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
        FROM documents
    ),
    s AS (
        SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
               ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) END AS shingles
        FROM w
    ),
    sets AS (SELECT min(doc_id) AS rep, list_sort(shingles) AS shingles FROM s GROUP BY list_sort(shingles)),
    flat AS (SELECT rep, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
    links AS (
        SELECT a.rep AS x, b.rep AS y FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.rep <> b.rep
        GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
    ),
    reach(node, root) AS (
        SELECT rep, rep FROM sets WHERE len(shingles) > 0
        UNION
        SELECT links.y, reach.root FROM reach JOIN links ON links.x = reach.node
    ),
    root AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
    SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(root.component_id, s.doc_id) AS component_id,
           s.doc_id = coalesce(root.component_id, s.doc_id) AS kept
    FROM s JOIN sets ON list_sort(s.shingles) = sets.shingles LEFT JOIN root ON root.node = sets.rep AND len(s.shingles) > 0
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depsignal.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@registered(
    "op10_warc_index",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (
        SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
               CASE WHEN strlen(body) >= 1000 THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS answer
        FROM p
    )
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN answer = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN answer = page_id THEN NULL ELSE answer END AS refers_to
    FROM d
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depsignal.llm import storage, warc

    runs = warc.write_archives(table(spark, sf_dir, "pages"), storage.shared_folder(spark, "archives"))
    index = storage.written(warc.merge_runs(runs), "warc-index")
    return warc.read_records(index, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


LINE_SQL = r"""
    WITH l AS (
        SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'pos': i, 'line': x}), recursive := true)
        FROM documents WHERE text IS NOT NULL
    ),
    w AS (
        SELECT doc_id, pos, line, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
        FROM l
    ),
    t AS (
        SELECT doc_id, pos, line, list_transform(words, lambda x: CASE WHEN len(words) >= 5 AND regexp_matches(x, '[0-9@]|://') THEN '<*>' ELSE x END) AS m
        FROM w WHERE len(words) > 0
    ),
    k AS (
        SELECT doc_id, pos, CASE WHEN starts_with(template, 'all ') THEN least ELSE 10 END AS least, template
        FROM (
            SELECT doc_id, pos, CASE WHEN len(m) < 5 THEN 30 WHEN len(m) >= 20 THEN 2 ELSE 10 END AS least,
                   unnest(list_concat([concat_ws(' ', 'all', len(m), array_to_string(m, ' '))],
                   CASE WHEN len(m) < 8 THEN [] ELSE list_transform([0, 1, 2, 3], lambda w: concat_ws(' ', w, len(m),
                        array_to_string(list_slice(m, 1, 3), ' '),
                        array_to_string(list_slice(m, 1, len(m) * w // 4), ' '), '|',
                        array_to_string(list_slice(m, len(m) * (w + 1) // 4 + 1, len(m)), ' '))) END)) AS template
            FROM t
        )
    ),
    r AS (SELECT template, min(doc_id) AS first_doc FROM k GROUP BY template, least HAVING count(DISTINCT doc_id) >= least),
    gone AS (SELECT DISTINCT k.doc_id, k.pos FROM k JOIN r ON r.template = k.template AND k.doc_id <> r.first_doc),
    kept AS (
        SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped,
               string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text
        FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id
    )
"""


@registered(
    "op8_line_dedup",
    LINE_SQL
    + """
    SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
           CASE WHEN d.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS text_md5
    FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depsignal.llm.line_dedup import drop_recurring

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring(docs).select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


@registered("op7_decontaminate")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depsignal.llm.decontaminate import find_leaks

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_ids", "similarity", "contaminated", (~F.col("contaminated")).alias("kept"))


@registered("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depsignal.llm.quality_rules import COUNTS, quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_rules(docs, trusted).select("doc_id", *COUNTS, "base_failed", "kept", "llr")


@registered("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depsignal.llm.language_id import fit, fold, predict

    docs = table(spark, sf_dir, "documents")
    network = fit(docs.filter(F.coalesce(fold("doc_id", 3), F.lit(0)) != 1))
    found = predict(docs.select("doc_id", "text"), network)
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@registered("op5_quality_trees")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depsignal.llm.language_id import fold
    from depsignal.llm.quality_trees import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2)
    found = score(docs, fit(docs, labels))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0)
    return found.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


@registered(
    "op12_fill_middle",
    r"""
    WITH l AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
               sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
        FROM documents
    ),
    d AS (
        SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
               CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS y,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                         OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
                    WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
        FROM l
    ),
    p AS (
        SELECT doc_id, text, n, form, array_to_string(list_slice(units, 1, least(x, y)), '') AS prefix,
               array_to_string(list_slice(units, least(x, y) + 1, greatest(x, y)), '') AS middle,
               array_to_string(list_slice(units, greatest(x, y) + 1, n), '') AS suffix
        FROM d
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depsignal.llm.fill_middle import pieces, restore

    return restore(pieces(table(spark, sf_dir, "documents")))


@registered(
    "op11_turn_repair",
    r"""
    WITH RECURSIVE hashed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                   lambda x: CAST(ord(x) AS BIGINT)),
                   lambda crc, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, bit: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, x)),
                   4294967295), 4294967295) % 20 AS kind
        FROM conversations
    ),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
        FROM hashed WHERE kind <> 0
    ),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
               regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS shown
        FROM damaged
    ),
    faulty AS (
        SELECT conv_id, turn, n, role, text, left(role, 1) AS initial, shown = '' AS blank, shown <> '' AND again AS duplicate,
               shown <> '' AND NOT again AND NOT regexp_matches(shown, '[.!?]$') AS truncated
        FROM placed
    ),
    pairs AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM faulty),
    counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
               count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
               count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n
        FROM pairs GROUP BY conv_id
    ),
    paths(conv_id, i, z, s, u, a) AS (
        SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {'c': 0, 'a': '', 't': ''}, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)),
               {'c': 2, 'a': 'I', 't': chr(10) || 'user:'}, {'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}
        FROM conversations
        UNION ALL
        SELECT conv_id, i, z, s, u, list_min([a, {'c': u.c + 2, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}])
        FROM (
            SELECT conv_id, i, z, s, a, list_min([u, {'c': z.c + 2, 'a': z.a || 'I', 't': z.t || chr(10) || 'user:'},
                   CASE WHEN s IS NOT NULL THEN {'c': s.c + 2, 'a': s.a || 'I', 't': s.t || chr(10) || 'user:'} END,
                   {'c': a.c + 2, 'a': a.a || 'I', 't': a.t || chr(10) || 'user:'}]) AS u
            FROM (
                SELECT p.conv_id, f.n AS i, {'c': z.c + 3, 'a': z.a || 'D', 't': z.t} AS z,
                       list_min([CASE WHEN s IS NOT NULL THEN {'c': s.c + 3, 'a': s.a || 'D', 't': s.t} END,
                                 CASE WHEN stays AND initial = 's' THEN {'c': z.c + more, 'a': z.a || 'K', 't': z.t || line} END]) AS s,
                       list_min([{'c': u.c + 3, 'a': u.a || 'D', 't': u.t},
                                 CASE WHEN stays AND initial = 'u' THEN {'c': z.c + more, 'a': z.a || 'K', 't': z.t || line} END,
                                 CASE WHEN stays AND initial = 'u' AND s IS NOT NULL THEN {'c': s.c + more, 'a': s.a || 'K', 't': s.t || line} END,
                                 CASE WHEN stays AND initial = 'u' THEN {'c': a.c + more, 'a': a.a || 'K', 't': a.t || line} END,
                                 CASE WHEN stays THEN {'c': z.c + 2 + more, 'a': z.a || 'R', 't': z.t || chr(10) || 'user:' || text} END,
                                 CASE WHEN stays AND s IS NOT NULL THEN {'c': s.c + 2 + more, 'a': s.a || 'R', 't': s.t || chr(10) || 'user:' || text} END,
                                 CASE WHEN stays THEN {'c': a.c + 2 + more, 'a': a.a || 'R', 't': a.t || chr(10) || 'user:' || text} END]) AS u,
                       list_min([{'c': a.c + 3, 'a': a.a || 'D', 't': a.t},
                                 CASE WHEN stays AND initial = 'a' THEN {'c': u.c + more, 'a': u.a || 'K', 't': u.t || line} END,
                                 CASE WHEN stays THEN {'c': u.c + 2 + more, 'a': u.a || 'R', 't': u.t || chr(10) || 'assistant:' || text} END]) AS a
                FROM paths p JOIN (
                    SELECT conv_id, n, text, initial, NOT (blank OR duplicate) AS stays, CAST(truncated AS INTEGER) AS more,
                           chr(10) || role || ':' || text AS line
                    FROM faulty
                ) f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.i + 1
            )
        )
    ),
    best AS (
        SELECT conv_id, list_min([z, a]) AS way FROM paths
        WHERE i = coalesce((SELECT n FROM counted WHERE counted.conv_id IS NOT DISTINCT FROM paths.conv_id), 0)
    )
    SELECT b.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
           coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, CAST(b.way.c AS BIGINT) AS cost, b.way.a AS audit,
           sha256(substr(b.way.t, 2)) AS repaired_sha256
    FROM best b LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depsignal.llm.turn_repair import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations")), gone="gone")


@registered("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depsignal.llm.language_id import fold
    from depsignal.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)
    found = score(docs, fit(docs, labels))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0)
    return found.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))

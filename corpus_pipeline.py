"""A corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. ``run`` writes every stage's frame as Parquet to the shared folder and
rereads it as the next one's input, so a lost executor costs no earlier stage.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depsignal.llm import decontaminate, language_id, line_dedup, near_dedup, sentencepiece_codec
from depsignal.llm.queries import table, tokenizer_file
from depsignal.llm.storage import written

#: Below this share of known groups of letters a text is taken to be in none of the languages.
LEAST_FAMILIAR = 0.5

#: A trained network and tokenizer cannot be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter in a language that the network knows; it learns from the rows that name theirs."""
    inner = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    network = language_id.fit(docs)
    found = language_id.predict(inner, network, f"c{docs.columns.index('text')}", "familiar")
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("familiar") >= LEAST_FAMILIAR)
    return found.filter(known).drop("lang_pred", "score", "familiar").toDF(*docs.columns)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one that loses more than half of its characters goes.

    What it loses stands elsewhere, and what is left of a near copy after its
    lines are gone is debris that no later stage would know again.
    """
    inner = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    text, size = (f"c{docs.columns.index(c)}" for c in ("text", "n_chars"))
    found = line_dedup.drop_recurring(inner.withColumn("before", F.length(text)), f"c{docs.columns.index('doc_id')}", text)
    cut = F.col("n_dropped") > 0
    debris = cut & (2 * F.length(text) < F.col("before"))
    left = found.filter(~F.coalesce(debris, F.lit(False)))
    left = left.withColumn(size, F.when(cut, F.length(text).cast("long")).otherwise(F.col(size)))
    return left.drop("before", "n_lines", "n_dropped").toDF(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id, and of rows repeated under one id and text one."""
    kept = near_dedup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    inner = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    marked = inner.join(kept, inner[doc_id].eqNullSafe(kept["kept_id"]), "left_semi").withColumn("hash", F.xxhash64(text))
    return marked.dropDuplicates([doc_id, "hash"]).drop("hash").toDF(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~F.col("contaminated")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text and equal those of the reference library."""
    found = sentencepiece_codec.encode_texts(docs.select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip", "parity")


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_recurring_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontaminate", drop_benchmark_leaks),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

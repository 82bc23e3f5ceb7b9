"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams, in BUCKETS buckets,
are counted: one of the trusted target, one of the raw corpus. A document's
score is the mean over its n-grams of log(p_target / p_raw), in millionths. It
is kept if it passes the base rules and its score is at or above the threshold.

The threshold comes from the target itself: it lies as far below the LOW
quantile of the trusted documents' own scores as their median lies above it,
and never above 0, the score of a text that fits both alike. It so follows the
spread of the scores, which grows with the target. The quantiles are taken
over scores in whole thousandths, of which there are few.

The target's counts are smoothed by the raw distribution with the weight of
PRIOR n-grams per bucket, so buckets with little evidence count as neutral.
Ratios are rounded to whole millionths before they are summed; sums of whole
numbers do not depend on partitioning, so neither does any verdict.

Everything on the main path is DataFrame functions. A table of counts has at
most BUCKETS rows, whatever the corpus, and enters the scoring pass as one
array from a scalar subquery. Texts are not shuffled, only a sum for each.

Defined cases: a null text has no words; a document without n-grams scores 0;
an empty target or corpus scores everything 0 and its threshold is 0; repeated rows count each;
input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsignal.llm.storage import written

BUCKETS = 1 << 16
#: Weight of the raw distribution in the target, in n-grams for each bucket.
PRIOR = 2
#: Quantile of the trusted documents' own scores from which the threshold is laid.
LOW = 0.01
#: About so many trusted ids are sent to all tasks at a time; more of them take more passes.
TRUSTED_ROWS = 200_000
MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30
#: A word is a run of characters other than these (fixed value).
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def word_list(text: Column) -> Column:
    """The words of a text, as they are written."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), "")


def _runs(length: int) -> Column:
    """The hash of each run of ``length`` words, from the column _hashes."""
    starts = F.slice("_hashes", F.lit(1), F.greatest(F.size("_hashes") - (length - 1), F.lit(0)))
    return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get("_hashes", i + k) for k in range(1, length)]))


def _with_repeats(rows: DataFrame) -> DataFrame:
    """_repeats: how many words lie in a window that occurs twice or more, from the column _hashes.

    A text in which no run of half a window recurs has no such window; a set
    of the runs' hashes tells, and only the other texts go on. Their windows are
    sorted with their places; equal neighbours occur repeatedly. Over the
    sorted places of these, each adds its distance to the next one, up to a
    window. Each step is a column of its own, so that a function over its
    elements looks up neighbours in a finished array.
    """
    rows = rows.withColumn("_half", _runs(WINDOW // 2))
    placed = F.sort_array(F.transform(_runs(WINDOW), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_placed", F.when(F.size(F.array_distinct("_half")) < F.size("_half"), placed))
    near = lambda x, k: F.coalesce(F.get("_placed", k)["h"] == x["h"], F.lit(False))
    again = F.filter("_placed", lambda x, k: near(x, k + 1) | near(x, k - 1))
    rows = rows.withColumn("_places", F.sort_array(F.transform(again, lambda x: x["i"])))
    steps = F.transform("_places", lambda p, k: F.least(F.coalesce(F.get("_places", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return rows.withColumn("_repeats", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, s: a + s), F.lit(0)))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, the five counts and base_failed."""
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.withColumn("_words", word_list(plain))
    rows = _with_repeats(rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))))
    lines = F.filter(F.split(plain, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        *[f"`{c}`" for c in docs.columns],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(plain, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.col("_repeats").cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def grams(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """A row for each word of each text: the kept columns, the bucket of the word and that of it and the next (-1 at the end)."""
    rows = docs.select(*keep, word_list(F.col(text).cast("string")).alias("_words"))
    pairs = F.arrays_zip(F.col("_words").alias("word"), F.slice("_words", F.lit(2), F.size("_words") + 1).alias("next"))
    names = rows.columns[:-1]
    return rows.select(*names, F.explode(pairs).alias("_pair")).select(
        *names,
        F.pmod(F.xxhash64("_pair.word"), F.lit(BUCKETS)).cast("int").alias("single"),
        F.when(F.col("_pair.next").isNull(), -1)
        .otherwise(F.pmod(F.xxhash64("_pair.word", "_pair.next"), F.lit(BUCKETS)).cast("int"))
        .alias("double"),
    )


def bucket_counts(docs: DataFrame, text: str, trusted: Column) -> DataFrame:
    """(bucket, raw, target): n-grams in all documents and in those for which ``trusted`` holds."""
    found = grams(docs, text, F.coalesce(trusted, F.lit(False)).alias("trusted"))
    each = found.select("trusted", F.explode(F.array("single", "double")).alias("bucket")).filter("bucket >= 0")
    return each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("trusted").alias("target"))


def ratios(counts: DataFrame) -> DataFrame:
    """One row: an array of log(p_target / p_raw) in millionths, by bucket."""
    total = counts.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    prior = PRIOR * BUCKETS
    every = counts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    every = every.withColumns({"all_raw": total.select("all_raw").scalar(), "all_target": total.select("all_target").scalar()})
    share = F.col("raw") / F.col("all_raw")
    smoothed = (F.col("target") + prior * share) / (F.col("all_target") + prior)
    value = F.coalesce(F.round(F.log(smoothed / share) * 1_000_000).cast("long"), F.lit(0).cast("long"))
    listed = every.select(F.struct("bucket", value.alias("value")).alias("entry")).agg(F.collect_list("entry").alias("t"))
    return listed.select(F.sort_array("t").alias("t")).select(F.col("t.value").alias("table"))


def _key(doc_id: str, text: str) -> Column:
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))


def score_sums(docs: DataFrame, table: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_of, _sum, _grams) of each id and text with n-grams: summed millionths and n-grams; ``table`` comes from ``ratios``."""
    values = grams(docs, text, _key(doc_id, text).alias("_of")).withColumn("_table", table.scalar())
    worth = F.get("_table", "single") + F.when(F.col("double") < 0, 0).otherwise(F.coalesce(F.get("_table", F.greatest("double", F.lit(0))), F.lit(0)))
    # rows that repeat an id and text fall in one sum, in which the mean stays the same
    return values.groupBy("_of").agg(F.sum(worth).alias("_sum"), F.sum(F.when(F.col("double") < 0, 1).otherwise(2)).alias("_grams"))


def threshold_of(sums: DataFrame, trusted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row: the threshold in millionths, from the sums of all trusted documents."""
    ids = trusted.select(F.col(doc_id).alias("_trusted_id"))
    own = sums.join(ids, F.col("_of.id") == F.col("_trusted_id"), "left_semi")
    score = F.floor(F.col("_sum") / F.col("_grams") / 1000)
    found = own.agg(F.percentile(score, [LOW, 0.5]).alias("q"))
    low, middle = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    return found.select(F.coalesce(F.least(F.floor((2 * low - middle) * 1000), F.lit(0)), F.lit(0)).cast("long").alias("threshold"))


def judge(docs: DataFrame, sums: DataFrame, threshold: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns, the counts, base_failed, llr (per n-gram) and kept; ``threshold`` is in millionths."""
    taken = (*COUNTS, "base_failed", "llr", "kept")
    names = [c for c in docs.columns if c.lower() not in taken]
    rows = with_counts(docs.select(*[f"`{c}`" for c in names]).withColumn("_key", _key(doc_id, text)), text)
    rows = rows.join(sums, F.col("_key").eqNullSafe(F.col("_of")), "left")
    total, size = F.coalesce("_sum", F.lit(0)), F.coalesce("_grams", F.lit(1))
    # whole numbers on both sides: the verdict has no rounding
    enough = total >= size * threshold
    return rows.select(
        *[f"`{c}`" for c in names],
        *COUNTS,
        "base_failed",
        (total / size / 1_000_000).alias("llr"),
        (~F.col("base_failed") & enough).alias("kept"),
    )


def all_counts(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``bucket_counts`` of every document, written; trusted are those whose ids are in ``trusted``.

    Ids are dealt into parts of about TRUSTED_ROWS by their hash. A pass sends
    one part of the trusted ids to all tasks and counts the documents of the
    same part, so no text is shuffled to meet its label and each counts once.
    """
    ids = trusted.select(F.col(doc_id).try_cast(docs.schema[doc_id].dataType).alias("_trusted_id"))
    ids = written(ids.filter("_trusted_id is not null").distinct(), "trusted-ids")
    parts = ids.count() // TRUSTED_ROWS + 1
    counts = None
    for k in range(parts):
        own = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)) == k  # noqa: B023, E731
        marked = docs.select(doc_id, text).filter(own(doc_id))
        marked = marked.join(F.broadcast(ids.filter(own("_trusted_id"))), F.col(doc_id) == F.col("_trusted_id"), "left")
        found = bucket_counts(marked, text, F.col("_trusted_id").isNotNull())
        if counts is not None:
            found = counts.unionByName(found).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        counts = written(found, "bucket-counts")
    return counts


def quality_rules(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float | None = None) -> DataFrame:
    """Judge every document against the multinomial of the documents whose ids are in ``trusted``.

    A given ``threshold`` takes the place of the one that the target yields.
    """
    table = ratios(all_counts(docs, trusted, doc_id, text))
    # written once, since the threshold and the verdicts both need them
    sums = written(score_sums(docs, table, doc_id, text), "scores")
    least = threshold_of(sums, trusted, doc_id).scalar() if threshold is None else F.lit(int(round(threshold * 1_000_000)))
    return judge(docs, sums, least, doc_id, text)

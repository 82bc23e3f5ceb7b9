"""Toxicity of texts from two class-conditional language models.

Method: class-conditional Kneser-Ney. Of the labelled documents, words and the
words before them are counted in each class, once per document. A word's
probability after another is its discounted count in the class; what the
discount frees goes to the class's distribution of words, which counts the
different words before each (continuations), and what that frees goes to the
continuations of both classes together. So expressions that are rare in
a class have nearly the same probability in both. A document is judged by the
ratio of its two log-likelihoods, normalised by length: the mean over the
``TELLING`` share of its words that speak most for the toxic class. Labelled
documents that were not counted turn this ratio into a probability by an isotonic fit.

The discount is the count up to which chance alone would put some expression of
a corpus of this size wholly into the smaller class, log(tokens) / log(tokens /
tokens of the smaller class). Only expressions above it differ between the classes.
All counting covers every labelled document and is a shuffle of expressions.

The model is a table of all expressions above the discount. Of each kind the
``ENTRIES`` most frequent at most go to all tasks. The rest stays in the table, and a bit
array of fixed size tells the tasks which words of a text may need it: only these are
shuffled, once for each text, and joined with the table. So a text gets the same ratio
whatever ``ENTRIES`` is, and no task holds more than that.

Words are runs of letters, digits, apostrophes and bytes above 127, with A-Z
lower-cased, and stand as 32-bit hashes. Among the 2^32 of them the few
words that a model knows are hardly ever met by another word.

Defined cases: a null text is an empty one; a text without words gets the share
of toxic documents. Labels other than 0 and 1 and rows without label are not
learned from; of several labels of one id the smallest counts. Without
documents of both classes every score is that share (0.5 without any).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from depsignal.llm.storage import written
from depsignal.llm.textarrays import column_bytes, mix, slices, words
from depsignal.session import scratch_path

#: Most expressions of a kind that go to all tasks.
ENTRIES = 1_000_000
#: Bits that tell, by hash, which expressions the tasks have to look up elsewhere.
REST_BITS = 27
#: Of the words of a text, one in so many is looked at: those that speak most for the toxic class.
TELLING = 64
#: One labelled document in so many is not counted but sets the scale of scores; at most so many of each label.
SET_ASIDE, SAMPLE_PER_LABEL = 5, 4_000
#: So many different words before a pair are always enough; for each class they are told apart by WAY_BITS bits.
WAYS, WAY_BITS = 16, 32
#: 2^MARK_BITS bits mark the ids with a label, by hash, so that few other texts are shuffled to meet their label.
MARK_BITS = 25
#: Expressions that a task holds before it passes their counts on.
HELD = 1_000_000

#: Kinds of counted things.
WORD, CONTEXT, PAIR = 1, 2, 3

_KEPT = np.full(256, 32, np.uint8)
for _range in ((48, 58), (65, 91), (97, 123), (128, 256), (39, 40)):
    _KEPT[slice(*_range)] = np.arange(*_range)
#: What stands before the first word of a text.
_START = np.uint64(0x5DEECE66)


def expressions(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, of the word before each, and the first word of each text (one offset more than texts)."""
    raw, offsets = column_bytes(column)
    plain = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_KEPT[raw].tobytes()))
    found = words(plain)
    word = found.hashes >> np.uint64(32)
    return word, _shifted(word, found.first), found.first


def _shifted(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The value before each in its text."""
    before = np.empty_like(values)
    before[1:] = values[:-1]
    before[first[:-1][np.diff(first) > 0]] = _START
    return before


def pair_of(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return before << np.uint64(32) | word


_COUNTED = "pair long, t long, o long, ways long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to expressions: how many documents of either class hold them, and a bit for each kind of word before."""
    held, size = [], 0

    def flush():
        pair, way, toxic = (np.concatenate(part) for part in zip(*held, strict=True))
        order = np.argsort(pair, kind="stable")
        pair, toxic, way = pair[order], toxic[order], way[order]
        starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        columns = [pair[starts].view(np.int64), *[np.add.reduceat(v, starts) for v in (toxic, 1 - toxic)]]
        # the lower half of the bits is for the ordinary class
        columns.append(np.bitwise_or.reduceat(way << (toxic * WAY_BITS).astype(np.uint64), starts).view(np.int64))
        return pa.record_batch([pa.array(c) for c in columns], names=["pair", "t", "o", "ways"])

    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        for low, high in slices(batch.column(1)):
            word, before, first = expressions(batch.column(1).slice(low, high - low))
            pair, way = pair_of(before, word), np.uint64(1) << (mix(_shifted(before, first)) % np.uint64(WAY_BITS))
            text = np.repeat(np.arange(high - low), np.diff(first))
            once = np.unique(mix(pair ^ mix(text.astype(np.uint64))), return_index=True)[1]
            held.append((pair[once], way[once], labels[low:high][text[once]].astype(np.int64)))
            size += len(once)
            if size >= HELD:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _bit_array(rows: DataFrame, places: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """2^bits bits in words of 64, of which those are set that ``places`` tells of the rows; at most a row for each word comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(places(batch))
            if len(place):
                word, bit = place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63))
                starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                columns = [word[starts].astype(np.int32), np.bitwise_or.reduceat(bit, starts).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "bits"])

    found = rows.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    marks = np.zeros(1 << (bits - 6), np.uint64)
    marks[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return marks


def _is_set(marks: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (marks[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)) == 1


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Without most of the rows whose id is not among the given ones; a bit array of fixed size is sent to all tasks once.

    Only hashes of ids go to Python and only flags come back, so that texts stay where they are.
    """
    own = lambda hashed: hashed.to_numpy().view(np.uint64) >> np.uint64(64 - MARK_BITS)
    sent = docs.sparkSession.sparkContext.broadcast(_bit_array(ids.select(F.xxhash64("id")), lambda batch: own(batch.column(0)), MARK_BITS))

    def marked(hashed: pa.Array) -> pa.Array:
        return pa.array(_is_set(sent.value, own(hashed)))

    return docs.filter(F.arrow_udf(marked, "boolean")(F.xxhash64("id")))


def counts(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict]:
    """Counts of all expressions of labelled documents, written, and their totals.

    ``docs`` is (id, text) and ``labels`` (id, label), one row per id. Rows are of
    kind WORD, CONTEXT (what stands before a word) or PAIR. Those seen only once in either class are in
    the totals but are not stored, since no discount is below 1.
    """
    joined = _marked(docs, labels.select("id")).join(labels, "id").select(F.col("label").cast("int").alias("label"), "text")
    rows = joined.mapInArrow(_count, _COUNTED)
    pairs = rows.groupBy("pair").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.bit_or("ways").alias("ways"))
    zero, some = F.lit(0).cast("long"), lambda c: F.when(F.col(c) > 0, 1).otherwise(0).cast("long")

    def entry(kind, *values):
        return F.struct(F.lit(kind).alias("kind"), *[v.alias(c) for v, c in zip(values, ("key", "t", "o", "both", "ways"), strict=True)])

    again = F.greatest("t", "o") > 1
    pair, t, o, ways = (F.col(c) for c in ("pair", "t", "o", "ways"))
    word, context = pair.bitwiseAND(F.lit(2**32 - 1)), F.call_function("shiftrightunsigned", pair, F.lit(32))
    parts = F.array(entry(WORD, word, some("t"), some("o"), zero + 1, zero), entry(CONTEXT, context, t, o, zero, zero))
    own = F.when(again, F.concat(parts, F.array(entry(PAIR, pair, t, o, zero, ways)))).otherwise(parts)
    each = pairs.select(F.explode(own).alias("e")).select("e.*")
    found = each.groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in ("t", "o", "both")], F.bit_or("ways").alias("ways"))
    totals = Observation()
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    numbers = {"tokens_t": of(CONTEXT, "t"), "tokens_o": of(CONTEXT, "o"), "types_t": of(WORD, "t"), "types_o": of(WORD, "o")}
    numbers |= {"pairs": of(WORD, "both"), "words": F.count_if(F.col("kind") == WORD)}
    stored = written(found.observe(totals, *[v.alias(k) for k, v in numbers.items()]).filter(again), "expression-counts")
    return stored, totals.get


def _look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def _places(kind: int, key: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each expression, of 2^bits."""
    return mix(key ^ mix(np.array([kind], np.uint64))) >> np.uint64(64 - bits)


@dataclass
class Model:
    """Probabilities as sorted keys with a column for each class (toxic, ordinary); ``rare_share`` holds for all other words.

    ``rest`` is the folder of the whole table if not all of it is held here, and ``marks`` the bits of what is not.
    """

    word: np.ndarray
    word_share: np.ndarray
    rare_share: np.ndarray
    context: np.ndarray
    freed: np.ndarray
    pair: np.ndarray
    pair_share: np.ndarray
    rest: str | None = None
    marks: np.ndarray | None = None

    def log_ratio(self, word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithm of the toxic over the ordinary probability of each word after the one before it, and where the rest may change it."""
        pairs = pair_of(before, word)
        w, known = _look_up(self.word, word)
        c, lent = _look_up(self.context, before)
        p, frequent = _look_up(self.pair, pairs)
        logs = []
        for k in (0, 1):
            share = np.where(known, self.word_share[k][w], self.rare_share[k]) if len(self.word) else np.full(len(word), self.rare_share[k])
            if len(self.context):
                share = share * np.where(lent, self.freed[k][c], 1.0)
            if len(self.pair):
                share = share + np.where(frequent, self.pair_share[k][p], 0.0)
            logs.append(np.log(share))
        unsure = np.zeros(len(word), bool)
        if self.marks is not None:
            bits = (64 * len(self.marks)).bit_length() - 1
            for kind, key, held in ((WORD, word, known), (CONTEXT, before, lent), (PAIR, pairs, frequent)):
                unsure |= ~held & _is_set(self.marks, _places(kind, key, bits))
        return logs[0] - logs[1], unsure


def _most_telling(value: np.ndarray, text: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest values of each text, falling, no more than ``taken`` of it, and their texts."""
    order = np.lexsort((-value, text))
    value, text = value[order], text[order]
    size = np.bincount(text, minlength=len(taken))
    place = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
    return value[place < taken[text]], text[place < taken[text]]


def ratios(model: Model, column: pa.Array) -> np.ndarray:
    """The length-normalised log-likelihood ratio of each text, of what the model holds itself; nan without words."""
    word, before, first = expressions(column)
    size = np.diff(first)
    taken = -(-size // TELLING)
    value, text = _most_telling(model.log_ratio(word, before)[0], np.repeat(np.arange(len(size)), size), taken)
    return np.bincount(text, value, len(size)) / np.where(taken > 0, taken, np.nan)


def _lists(text: np.ndarray, texts: int, *values: np.ndarray) -> list[pa.Array]:
    """Values, in the order of their texts, as a list for each text."""
    ends = pa.array(np.append(0, np.cumsum(np.bincount(text, minlength=texts))).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(v)) for v in values]


def _joined_ratios(texts: DataFrame, model: Model) -> DataFrame:
    """(h1, h2, text) to (h1, h2, x), one row for each pair of hashes: ``ratios`` with the whole table."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(2)):
                part = batch.slice(low, high - low)
                word, before, first = expressions(part.column(2))
                size = np.diff(first)
                text = np.repeat(np.arange(len(size)), size)
                taken = -(-size // TELLING)
                value, unsure = sent.value.log_ratio(word, before)
                known, of_known = _most_telling(value[~unsure], text[~unsure], taken)
                pair, text = pair_of(before, word)[unsure], text[unsure]
                order = np.lexsort((pair, text))
                pair, text = pair[order], text[order]
                new = np.append(True, (pair[1:] != pair[:-1]) | (text[1:] != text[:-1]))[: len(pair)]
                starts = np.flatnonzero(new)
                times = np.diff(np.append(starts, len(pair))).astype(np.int32)
                columns = [*part.columns[:2], pa.array(taken.astype(np.int32)), *_lists(of_known, len(size), known)]
                columns += _lists(text[starts], len(size), pair[starts].view(np.int64), times)
                yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "taken", "known", "pair", "times"])

    found = texts.mapInArrow(run, "h1 long, h2 long, taken int, known array<double>, pair array<long>, times array<int>")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "unsure-words")
    words_of = found.select("row", F.inline(F.arrays_zip("pair", "times")))
    table = spark.read.schema(_MODEL).parquet(model.rest)

    def entries(kind, key, *names):
        return table.filter(F.col("kind") == kind).select(F.col("key").alias(key), *[F.col(c).alias(n) for c, n in zip(("t", "o"), names, strict=True)])

    own = words_of.select("pair").distinct()
    own = own.select("pair", F.col("pair").bitwiseAND(F.lit(2**32 - 1)).alias("word"), F.call_function("shiftrightunsigned", "pair", F.lit(32)).alias("before"))
    own = own.join(entries(WORD, "word", "word_t", "word_o"), "word", "left").join(entries(CONTEXT, "before", "freed_t", "freed_o"), "before", "left")
    own = own.join(entries(PAIR, "pair", "pair_t", "pair_o"), "pair", "left")
    logs = [
        F.log(
            F.coalesce(f"word_{c}", F.lit(float(model.rare_share[k]))) * F.coalesce(f"freed_{c}", F.lit(1.0)) + F.coalesce(f"pair_{c}", F.lit(0.0))
        )
        for k, c in enumerate("to")
    ]
    values = words_of.join(own.select("pair", (logs[0] - logs[1]).alias("value")), "pair").groupBy("row").agg(F.collect_list(F.struct("value", "times")).alias("own"))
    repeated = F.flatten(F.transform("own", lambda v: F.array_repeat(v.value, F.least(v.times, F.col("taken")))))
    every = F.sort_array(F.concat("known", F.coalesce(repeated, F.array().cast("array<double>"))), asc=False)
    mean = F.aggregate(F.slice(every, 1, F.col("taken")), F.lit(0.0), lambda s, v: s + v) / F.col("taken")
    whole = found.drop("pair", "times").join(values, "row", "left")
    return whole.select("h1", "h2", F.when(F.col("taken") > 0, mean).otherwise(float("nan")).alias("x")).groupBy("h1", "h2").agg(F.min("x").alias("x"))


def discount(tokens: tuple[int, int]) -> np.ndarray:
    """The discount of either class, from its number of tokens."""
    share = min(tokens) / sum(tokens)
    return np.full(2, max(np.log(sum(tokens)) / np.log(1 / share), 1.0))


_MODEL = "kind int, key long, t double, o double, level int"


def _table(found: DataFrame, total: dict) -> tuple[DataFrame, np.ndarray]:
    """The whole model as a table, and the shares of a word that is not in it.

    Sums are of integers, so that they do not depend on the order of rows. ``level`` rises with the count.
    """
    less = [float(x) for x in discount((total["tokens_t"], total["tokens_o"]))]
    names = list(zip("to", less, strict=True))
    known = found.filter((F.col("t") > less[0]) | (F.col("o") > less[1])).withColumn("level", F.floor(F.log2(F.greatest("t", "o")) * 16).cast("int"))
    word = known.filter(F.col("kind") == WORD)
    sums = [f(F.when(F.col(c) > x, F.col(c))).alias(f"{n}_{c}") for c, x in names for n, f in (("sum", F.sum), ("count", F.count))]
    seen = word.agg(*sums, F.sum("both").alias("both"), F.count(F.lit(1)).alias("words")).first()
    n = {c: float(total[f"types_{c}"]) for c in "to"}
    freed = {c: 1 - ((seen[f"sum_{c}"] or 0) - seen[f"count_{c}"] * x) / n[c] for c, x in names}
    rare = (total["pairs"] - (seen["both"] or 0)) / max(total["words"] - seen["words"], 1) / total["pairs"]
    kept = {c: F.greatest(F.col(c) - x, F.lit(0.0)) for c, x in names}
    words_of = [(kept[c] / n[c] + F.col("both") * freed[c] / float(total["pairs"])).alias(c) for c in "to"]

    context = known.filter(F.col("kind") == CONTEXT).select(F.col("key").alias("before"), *[F.greatest(c, F.lit(1)).alias(f"size_{c}") for c in "to"], "level")
    pair = known.filter(F.col("kind") == PAIR).withColumn("before", F.call_function("shiftrightunsigned", "key", F.lit(32)))
    half = {"t": F.call_function("shiftrightunsigned", "ways", F.lit(WAY_BITS)), "o": F.col("ways").bitwiseAND(F.lit(2**WAY_BITS - 1))}
    # so many different words are likely behind that share of the bits
    ways = {c: -WAY_BITS * F.log(F.greatest(1 - F.bit_count(half[c]) / WAY_BITS, F.lit(0.5 / WAY_BITS))) for c in "to"}
    pair = pair.select("key", "before", "level", *[F.when((F.col(c) > x) & (ways[c] > min(x, WAYS)), F.col(c)).alias(c) for c, x in names])
    sums = [f(c).alias(f"{n}_{c}") for c in "to" for n, f in (("sum", F.sum), ("count", F.count))]
    lost = context.join(pair.groupBy("before").agg(*sums), "before", "left")
    lent = [F.coalesce(1 - (F.col(f"sum_{c}") - F.col(f"count_{c}") * x) / F.col(f"size_{c}"), F.lit(1.0)).alias(c) for c, x in names]
    shares = [F.coalesce((F.col(c) - x) / F.col(f"size_{c}"), F.lit(0.0)).alias(c) for c, x in names]
    table = word.select("kind", "key", *words_of, "level")
    table = table.unionByName(lost.select(F.lit(CONTEXT).alias("kind"), F.col("before").alias("key"), *lent, "level"))
    paired = pair.join(context.drop("level"), "before").select(F.lit(PAIR).alias("kind"), "key", *shares, "level")
    return table.unionByName(paired), np.array([freed[c] * max(rare, 1e-12) for c in "to"])


def _marks(rest: DataFrame) -> np.ndarray:
    """The bits of all expressions of (kind, key)."""
    bits = REST_BITS

    def places(batch: pa.RecordBatch) -> np.ndarray:
        kind, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        return np.concatenate([_places(k, key[kind == k].view(np.uint64), bits) for k in (WORD, CONTEXT, PAIR)])

    return _bit_array(rest.select("kind", "key"), places, bits)


def model_of(found: DataFrame, total: dict) -> Model | None:
    """The model from the stored counts and their totals; None unless both classes have words."""
    if not total["tokens_t"] or not total["tokens_o"]:
        return None
    table, rare_share = _table(found, total)
    spark, folder = found.sparkSession, scratch_path(found.sparkSession, "toxicity-model")
    table.write.parquet(folder)
    table = spark.read.schema(_MODEL).parquet(folder)
    lowest, size = dict.fromkeys((WORD, CONTEXT, PAIR), 0), Counter()
    # a row for each level, at most 64 * 16 of each kind
    for row in sorted(table.groupBy("kind", "level").count().collect(), key=lambda r: -r["level"]):
        size[row["kind"]] += row["count"]
        if size[row["kind"]] > ENTRIES:
            lowest[row["kind"]] = max(lowest[row["kind"]], row["level"] + 1)
    is_kind = lambda kind: F.col("kind") == kind

    def held(kind):
        # at most ENTRIES rows, which are numbers only and stay in Arrow
        found = table.filter(is_kind(kind) & (F.col("level") >= lowest[kind])).select("key", "t", "o").toArrow()
        keys = found["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        return keys[order], np.stack([found[c].to_numpy()[order] for c in "to"])

    (word, word_share), (context, freed), (pair, pair_share) = map(held, lowest)
    model = Model(word, word_share, rare_share, context, freed, pair, pair_share)
    if max(size.values(), default=0) > ENTRIES:
        out = [is_kind(kind) & (F.col("level") < level) for kind, level in lowest.items()]
        model.rest, model.marks = folder, _marks(table.filter(out[0] | out[1] | out[2]))
    return model


@dataclass
class Scale:
    """Probability of label 1 by ratio, between knots a straight line; ``base`` is that of a text without words."""

    base: float
    at: np.ndarray
    share: np.ndarray

    def of(self, value: np.ndarray) -> np.ndarray:
        found = np.interp(value, self.at, self.share) if len(self.at) else np.full(len(value), self.base)
        return np.where(np.isnan(value), self.base, found)


def isotonic(value: np.ndarray, label: np.ndarray) -> Scale:
    """The rising steps of least squares, each drawn towards the share of all by one document."""
    base = float((label.sum() + 0.5) / (len(label) + 1))
    known = ~np.isnan(value)
    value, label = value[known], label[known]
    blocks: list[list[float]] = []  # lowest and highest ratio, sum of labels, documents
    different, inverse = np.unique(value, return_inverse=True)
    for x, s, n in zip(different, np.bincount(inverse, label, len(different)), np.bincount(inverse, minlength=len(different)), strict=True):
        blocks.append([x, x, s, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, high, s, n = blocks.pop()
            blocks[-1][1:] = [high, blocks[-1][2] + s, blocks[-1][3] + n]
    share = np.maximum.accumulate([(s + base) / (n + 1) for _, _, s, n in blocks]) if blocks else np.zeros(0)
    return Scale(base, np.array([x for b in blocks for x in b[:2]]), np.repeat(share, 2))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[Model | None, Scale]:
    """Count every labelled document but one in ``SET_ASIDE``, and set the scale by a bounded sample of those."""
    spoken = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).filter("id is not null and text is not null")
    known = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
        .filter("id is not null and label in (0, 1)")
        .groupBy("id")
        .agg(F.min("label").alias("label"))
    )
    aside = F.pmod(F.xxhash64("id"), F.lit(SET_ASIDE)) == 0
    model = model_of(*counts(spoken, known.filter(~aside)))
    sample = None
    for value in (0, 1):
        one = known.filter(aside & (F.col("label") == value)).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE_PER_LABEL)
        sample = one if sample is None else sample.union(one)
    share = known.filter(aside).agg(F.avg("label")).first()[0]
    if model is None:
        share = known.agg(F.avg("label")).first()[0]
        return None, Scale(0.5 if share is None else float(share), np.zeros(0), np.zeros(0))

    # at most SAMPLE_PER_LABEL ids of either label, so this side may be sent to all tasks
    chosen = spoken.join(F.broadcast(written(sample, "scale-sample")), "id").select(F.xxhash64("id", "text").alias("hash"), "label", "text")
    judged = _appended(chosen, "x", "text", model, lambda value: value).select("hash", "label", "x")
    found = sorted(set(map(tuple, judged.distinct().collect())), key=repr)
    return model, isotonic(np.array([r[2] for r in found], float), np.array([r[1] for r in found], float))


def _appended(docs: DataFrame, name: str, text: str, model: Model | None, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """All columns and one more, made of the ratio of each text (nan without a model); the model is sent to all tasks once.

    One pass without a shuffle if tasks hold the whole model. Otherwise ratios are joined by two hashes of the text.
    """
    names = [c for c in docs.columns if c.lower() != name]
    docs = docs.select(*[f"`{c}`" for c in names])
    if model is not None and model.rest:
        two = [F.xxhash64(F.lit(i), F.col(f"`{text}`").cast("string")) for i in (1, 2)]

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                value = of(batch.column(2).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(value)], names=["h1", "h2", "x"])

        texts = docs.select(two[0].alias("h1"), two[1].alias("h2"), F.col(f"`{text}`").cast("string").alias("text"))
        found = _joined_ratios(texts, model).mapInArrow(judged, "h1 long, h2 long, x double")
        keyed = docs.select(F.struct(*[f"`{c}`" for c in names]).alias("own"), two[0].alias("h1"), two[1].alias("h2"))
        return keyed.join(found, ["h1", "h2"], "left").select(*[F.col("own").getField(c).alias(c) for c in names], F.col("x").alias(name))
    place = [c.lower() for c in names].index(text.lower())
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(place)):
                part = batch.slice(low, high - low)
                column = part.column(place)
                value = np.full(len(column), np.nan) if sent.value is None else ratios(sent.value, column)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(of(value))], names=[*names, name])

    return docs.mapInArrow(run, f"{kinds}, `{name}` double")


def score(docs: DataFrame, fitted: tuple[Model | None, Scale], text: str = "text") -> DataFrame:
    """All columns and the score."""
    model, scale = fitted
    return _appended(docs, "score", text, model, scale.of)

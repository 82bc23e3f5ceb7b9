"""Scores of the trained queries, computed again by plain loops over whole small tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash

from depsignal.llm import language_id, quality_rules, quality_trees, queries
from depsignal.llm.language_id import OVERLAP, WIDTHS, WINDOW, fold

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def texts():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def labels(name):
    return {r["doc_id"]: r[name] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}


def bucket(*words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64(w.encode(), seed=seed).intdigest()
    return (seed - 2**64 if seed >= 2**63 else seed) % quality_rules.BUCKETS


def quantile(values, share):
    at = share * (len(values) - 1)
    low, high = sorted(values)[math.floor(at)], sorted(values)[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def test_quality_ratios_and_verdicts_equal_plain_multinomials(spark):
    docs, quality = texts(), labels("quality")
    grams = {}
    for i, text in docs.items():
        w = WORD.findall(text)
        grams[i] = [bucket(x) for x in w] + [bucket(x, y) for x, y in zip(w, w[1:], strict=False)]
    trusted = {i for i, q in quality.items() if q == 1}
    raw, target = Counter(), Counter()
    for i, found in grams.items():
        raw.update(found)
        if i in trusted:
            target.update(found)
    prior, all_raw, all_target = quality_rules.PRIOR * quality_rules.BUCKETS, sum(raw.values()), sum(target.values())
    value = {}
    for b, n in raw.items():
        share = n / all_raw
        value[b] = round(math.log((target[b] + prior * share) / (all_target + prior) / share) * 1_000_000)
    sums = {i: sum(value[b] for b in found) for i, found in grams.items() if found}
    own = [math.floor(sums[i] / len(grams[i]) / 1000) for i in sums if i in trusted]
    low, middle = quantile(own, quality_rules.LOW), quantile(own, 0.5)
    threshold = min(math.floor((2 * low - middle) * 1000), 0)
    found = queries.op3(spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        total, size = sums.get(r.doc_id, 0), len(grams[r.doc_id]) or 1
        # the logarithm may differ in its last digit, hence by a millionth for each n-gram
        assert abs(r.llr - total / size / 1e6) <= 2e-6
        if abs(total - size * threshold) > 2 * size:
            assert r.kept == (not r.base_failed and total >= size * threshold)


def plain_network(network, raw):
    """Mean log-probabilities of the languages over the windows of a text, by loops."""
    totals, at, windows = np.zeros(len(network.languages)), 0, 0
    while True:
        window = [*raw[at : at + WINDOW], *[0] * max(0, at + WINDOW - len(raw))]
        pooled = []
        for table in network.tables:
            width = len(table)
            best = np.max([sum(table[k][window[p + k]] for k in range(width)) for p in range(WINDOW - width + 1)], axis=0)
            pooled.append(best)
        hidden = np.maximum(np.concatenate(pooled) + network.bias, 0)
        logits = hidden @ network.weights + network.offset
        totals += logits - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
        windows += 1
        at += WINDOW - OVERLAP
        if at >= len(raw) - OVERLAP or len(raw) <= WINDOW:
            return totals / windows


def test_language_scores_equal_a_plain_network(spark):
    assert max(WIDTHS) - 1 == OVERLAP
    docs = queries.table(spark, SF, "documents")
    network = language_id.fit(docs.filter(fold("doc_id", 3) != 1))
    known = texts()
    checked = 0
    for r in queries.op4(spark, SF).collect():
        raw = known[r.doc_id].encode()
        if len(raw) > 3000 or r.lang_pred == "und":
            continue
        mean = plain_network(network, raw)
        share = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        best = network.languages.index(r.lang_pred)
        assert abs(share[best] - r.score) < 1e-3 and share[best] >= share.max() - 1e-3
        checked += 1
    assert checked > 50


def test_quality_scores_equal_a_plain_walk_of_the_trees(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text")
    forest = quality_trees.fit(docs, queries.table(spark, SF, "labels").filter(fold("doc_id", 4) != 2))
    known = texts()
    ids = sorted(known)
    x = dict(zip(ids, quality_trees.statistics(pa.array([known[i] for i in ids]).cast(pa.large_string())), strict=True))
    for r in queries.op5(spark, SF).collect():
        margin = forest.base
        for statistic, threshold, value in zip(forest.statistic, forest.threshold, forest.value, strict=True):
            node = 0
            while node < len(statistic):
                node = 2 * node + 1 + int(x[r.doc_id][statistic[node]] > threshold[node])
            margin += value[node - len(statistic)]
        assert abs(1 / (1 + math.exp(-margin)) - r.score) < 1e-9 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)

import numpy as np
import pytest
from pyspark.sql import functions as F

from depsignal.checks import tables as t
from depsignal.operators import vector_index
from depsignal.operators.vector_index import build_index, fewest_probes, recall, search

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id int, label int, embedding array<float>"


def brute(rows, queries, k, label=None):
    held = [(i, np.array(v, float)) for i, g, v in rows if v and None not in v and np.linalg.norm(v) > 0 and (label is None or g == label)]
    out = {}
    for q, _, v in queries:
        if not v or None in v or not np.linalg.norm(v):
            continue
        a = np.array(v, float)
        scores = sorted(((-float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), i) for i, b in held))
        out[q] = [i for _, i in scores[:k]]
    return out


def got(found):
    out = {}
    for r in found.orderBy("query", "place").collect():
        out.setdefault(r["query"], []).append(r["id"])
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    rows = [(i, i % 3, (centers[i % 6] + 0.4 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400, 1, [0.0] * 8), (401, 1, None), (402, 2, [1.0, None] + [0.0] * 6), (403, 0, rows[5][2]), (404, 1, [2 * x for x in rows[5][2]])]
    return rows


def test_all_lists_are_the_exact_scan(spark, data, tmp_path, monkeypatch):
    # small cells, so that every list is several of them
    monkeypatch.setattr(vector_index, "CELL_VECTORS", 20)
    monkeypatch.setattr(vector_index, "CELL_QUERIES", 7)
    vectors = spark.createDataFrame(data, VECTORS)
    index = build_index(vectors, str(tmp_path / "i"), 5)
    assert sum(index.sizes.values()) == 402 and len(index.centroids) == 5
    queries = [r for r in data if r[0] % 9 == 0 or r[0] >= 400]
    asked = spark.createDataFrame(queries, VECTORS)
    assert got(search(index, asked, 6)) == brute(data, queries, 6)
    assert got(search(index, asked, 500, label=1)) == brute(data, queries, 500, 1)
    few = search(index, asked, 6, probes=2)
    assert recall(few, search(index, asked, 6)) > 0.6 and set(got(few)) == set(brute(data, queries, 6))
    assert search(index, asked.limit(0), 6).count() == 0
    assert search(index, asked, 6, label=99).count() == 0


def test_similarity_is_that_of_the_single_search(spark, tmp_path):
    from depsignal.operators.vectors import cosine_topk

    vectors = t.table(spark, SF, "embeddings")
    index = build_index(vectors, str(tmp_path / "i"), 4)
    one = vectors.filter("vec_id = 0")
    alone = [(r.vec_id, r.similarity) for r in cosine_topk(vectors, one.first().embedding, 10).orderBy(F.desc("similarity"), "vec_id").collect()]
    many = [(r.id, r.similarity) for r in search(index, one, 10).orderBy(F.desc("similarity"), "id").collect()]
    assert alone == many


def test_recall_of_few_lists(spark, tmp_path):
    vectors = t.table(spark, SF, "embeddings")
    index = build_index(vectors, str(tmp_path / "i"), 8)
    queries = vectors.filter("vec_id % 10 = 0")
    probes = fewest_probes(index, queries, 10, 0.95, sample=20)
    exact = search(index, queries, 10)
    assert 1 <= probes <= 8 and recall(search(index, queries, 10, probes), exact) >= 0.9
    assert recall(exact, exact) == 1.0
    plan = search(index, queries, 10, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1][:200]

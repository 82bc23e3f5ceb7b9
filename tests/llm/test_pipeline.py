import corpus_pipeline
from depsignal.llm import language_id, near_dedup, storage
from depsignal.llm.queries import table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = storage.written(stage(spark, docs, SF), name)
        assert found.columns == columns and found.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        after = [r.doc_id for r in found.select("doc_id").collect()]
        assert set(after) <= before and len(after) == len(set(after))
        if name == "near_dedup":
            kept = {r.doc_id for r in near_dedup.near_duplicates(docs).filter("kept").collect()}
            assert set(after) == kept
        docs = found
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(coded) == docs.count() and all(r.round_trip and r.parity and r.n_tokens == len(r.ids) for r in coded)


def test_odd_rows_and_clashing_names(spark, make):
    good = " ".join(f"the word{i} and of" for i in range(20))
    docs = make([(None, None, None), (1, "", "en"), (2, "12 34", "en"), (3, good, "en"), (3, good, "en"), (4, good + " too", "en"), (None, good, None)])
    more = ["score", "lang_pred", "similarity", "n_lines", "lines", "_hash", "_kept", "before", "familiar"]
    wide = docs.selectExpr("*", *[f"{k} AS {c}" for k, c in enumerate(more)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        wide = storage.written(stage(spark, wide, SF), "odd")
        assert wide.columns == [*docs.columns, *more]
    assert [r.doc_id for r in wide.collect()] == [3]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = storage.written(stage(spark, empty, SF), "empty")
    assert empty.count() == 0


def test_unlabelled_corpus_has_no_language(spark, make):
    docs = make([(1, "some words")])
    assert language_id.fit(docs) is None
    assert corpus_pipeline.keep_known_language(spark, docs, SF).count() == 0


def test_other_languages_and_noise_are_refused(spark):
    import random

    rng = random.Random(6)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(400)) for _ in range(50)]
    other = [
        "\u0421\u0435\u0433\u043e\u0434\u043d\u044f \u0443\u0442\u0440\u043e\u043c \u043c\u044b \u043f\u043e\u0448\u043b\u0438 \u0432 \u043b\u0435\u0441",
        "\u4eca\u65e5\u306f\u5929\u6c17\u304c\u3044\u3044\u306e\u3067\u3001\u516c\u5712\u307e\u3067\u6563\u6b69\u306b\u884c\u304d\u307e\u3057\u305f",
        "T\u00e4n\u00e4\u00e4n aamulla menimme mets\u00e4\u00e4n ja l\u00f6ysimme paljon sieni\u00e4, koska y\u00f6ll\u00e4 oli satanut kovasti",
        "Dzisiaj rano poszli\u015bmy do lasu i znale\u017ali\u015bmy du\u017co grzyb\u00f3w, poniewa\u017c w nocy mocno pada\u0142o",
    ]
    planted = spark.createDataFrame([(10**9 + i, t, None, "x", len(t)) for i, t in enumerate(noise + other)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.keep_known_language(spark, docs.unionByName(planted), SF).select("doc_id").collect()}
    assert not {i for i in kept if i is not None and i >= 10**9}
    lettered = docs.filter("text rlike '[a-zA-Z]'").count()
    assert len(kept) >= 0.99 * lettered


def test_no_near_duplicate_leaves_as_debris(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    copies = {r.doc_id for r in near_dedup.near_duplicates(docs).filter("not kept").collect()}
    sizes = {r.doc_id: r.size for r in docs.selectExpr("doc_id", "length(text) AS size").collect()}
    known = storage.written(corpus_pipeline.keep_known_language(spark, docs, sf), "a")
    lines = storage.written(corpus_pipeline.drop_recurring_lines(spark, known, sf), "b")
    left = corpus_pipeline.keep_one_of_each_group(spark, lines, sf).selectExpr("doc_id", "length(text) AS size").collect()
    assert all(2 * r.size >= sizes[r.doc_id] for r in left)
    assert len([r for r in left if r.doc_id in copies]) <= 0.1 * len(copies), len(copies)

"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depsignal.llm import decontaminate, language_id, line_dedup, near_dedup, quality_rules, quality_trees
from depsignal.llm import sentencepiece_codec, storage, textarrays, token_store, url_filter, warc
from depsignal.llm.components import components
from depsignal.llm.queries import tokenizer_file

LONG = " ".join(f"w{i}" for i in range(60_000))
PASSAGE = " ".join(f"term{i}" for i in range(40))
ODD = [(None, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, LONG), (5, PASSAGE), (5, PASSAGE), (6, "é日本 ﬁ\x00 \x85end")]


def test_words_are_cut_at_the_six_blanks():
    found = textarrays.words(pa.array(["A b\u00a0c\tD", None, "", "  x  ", "a"]))
    assert np.diff(found.first).tolist() == [3, 0, 0, 1, 1]
    assert found.hashes[0] == found.hashes[4]


def test_shingles_of_short_texts():
    values, first = textarrays.shingles(textarrays.words(pa.array(["a b", "A B", "a b c d e f", None, "b a"])))
    assert np.diff(first).tolist() == [1, 1, 2, 0, 1]
    assert values[0] == values[1] != values[4]


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(1).integers(0, 2**bits, 9001).astype("<u4")
    assert (token_store.unpack(token_store.pack(ids, bits), len(ids), bits) == ids).all()
    with pytest.raises(ValueError):
        token_store.pack(np.array([2**bits], "<u8"), bits)


def test_random_access_to_a_shard(tmp_path):
    parts = [np.arange(n, dtype="<u4") for n in (0, 5, 9000, 1)]
    uri = storage.commit_file(str(tmp_path), "a.tokb", token_store.encode_shard([None, 1, 2, 3], parts, 14, 256))
    with token_store.ShardReader(uri) as shard:
        assert shard.doc_ids == [None, 1, 2, 3]
        for i, part in enumerate(parts):
            assert (shard.document(i) == part).all()
        assert shard.ids(300, 900).tolist() == list(range(295, 895))


def test_token_store(spark, make, tmp_path):
    path = tokenizer_file("byte_bpe_50k.json")
    shards = token_store.write_tokens(make(ODD), str(tmp_path), path, 2)
    rows = {}
    for r in token_store.read_tokens(shards).collect():
        rows.setdefault(r.doc_id, []).append(list(r.ids))
    assert rows[1] == [[2]] and rows[None] == [[2]] and len(rows[5]) == 2
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    for doc_id, text in ODD:
        assert [*library.encode(text or "", add_special_tokens=False).ids, 2] in rows[doc_id]
    empty = token_store.write_tokens(make([]), str(tmp_path), path, 2)
    assert token_store.read_digests(empty).count() == 0


def test_byte_level_cuts():
    import random

    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    encoder, _ = token_store.byte_level_encoder(path)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rng = random.Random(5)
    atoms = [" ", "  ", "\n", "\t", "a", "b", "!", "'s", "1", "é", "\r\n", "\x1c", "\x85", "<|endoftext|>", "   ", "\u3000", "word"]
    texts = ["".join(rng.choices(atoms, k=rng.randrange(20))) for _ in range(3000)]
    assert [e.tolist() for e in encoder.encode(pa.array(texts))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("pieces, together", [(3, 2), (1, 1), (256, 16)])
def test_new_pieces_in_any_groups(monkeypatch, pieces, together):
    import random

    import sentencepiece
    from tokenizers import Tokenizer

    from depsignal.llm import encoding

    monkeypatch.setattr(encoding, "JOINED_PIECES", pieces)
    monkeypatch.setattr(encoding, "JOINED_TEXTS", together)
    path, model = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    rng = random.Random(7)
    atoms = ["a", "word", "é", "日本", "12", "!", "'s", "▁", "\n", "<s>", "\U0001f600"]
    texts = [" ".join("".join(rng.choices(atoms, k=rng.randrange(1, 5))) for _ in range(rng.randrange(9))) + " " * rng.randrange(2) for _ in range(900)]
    library, codec = Tokenizer.from_file(path), sentencepiece_codec.Codec(model)
    library.encode_special_tokens = True
    encoder = token_store.byte_level_encoder(path)[0]
    expected, pieces_of = library.encode_batch(texts, add_special_tokens=False), sentencepiece.SentencePieceProcessor(model_file=model).encode(texts)
    for low in (0, 300, 0):  # in several batches, the first one again
        assert [e.tolist() for e in encoder.encode(pa.array(texts[low : low + 600]))] == [e.ids for e in expected[low : low + 600]]
        assert [e.tolist() for e in codec.encode(texts[low : low + 600])] == pieces_of[low : low + 600]


def test_new_pieces_take_array_steps():
    import cProfile
    import pstats

    encoder = token_store.byte_level_encoder(tokenizer_file("byte_bpe_50k.json"))[0]
    texts = pa.array([" ".join(f"{k * 7919 % 100003}{k:x}" for k in range(n, n + 400)) for n in range(0, 20_000, 400)])
    profile = cProfile.Profile()
    found = profile.runcall(encoder.encode, texts)
    assert len(found) == 50 and pstats.Stats(profile).total_calls < 20_000 / 4


def test_a_worker_keeps_its_encoder():
    path = tokenizer_file("byte_bpe_50k.json")
    encoder, _ = token_store._worker_encoder(path)
    encoder.encode(pa.array(["some words here"]))
    again, _ = token_store._worker_encoder(path)
    assert again is encoder and len(again.hashes) >= 3


def test_sentencepiece_parity_on_odd_texts():
    import random

    import sentencepiece

    codec = sentencepiece_codec.Codec(tokenizer_file("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=codec.path)
    rng = random.Random(5)
    atoms = [" ", "  ", "\n", "\t", "a", "b", "1", "é", "\x1c", "<s>", "</s>", "   ", "word", "日本", "▁", "<0x0A>", "<unk>", "\x00", "ﬁ", "①"]
    texts = ["".join(rng.choices(atoms, k=rng.randrange(20))) for _ in range(3000)]
    ids = codec.encode(texts)
    assert [i.tolist() for i in ids] == library.encode(texts)
    assert codec.decode(ids) == library.decode(library.encode(texts))
    random_ids = [np.array(rng.choices(range(3, 32000), k=4) + rng.choices(range(3, 259), k=3), "<u4") for _ in range(500)]
    assert codec.decode(random_ids) == codec.tokenizer.decode_batch([i.tolist() for i in random_ids], skip_special_tokens=False)


def test_unigram_model_is_rebuilt(tmp_path):
    """A model file written by hand: two control pieces, three words with scores and byte pieces."""

    def field(number, kind, value):
        return bytes([number << 3 | kind]) + value

    def text(number, value):
        return field(number, 2, bytes([len(value)]) + value)

    def piece(name, score, kind):
        return text(1, text(1, name.encode()) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind])))

    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("▁ab", -1.0, 1), ("▁a", -0.2, 1), ("b", -0.3, 1), ("c", -2.0, 1), ("▁", -3.0, 1)]
    pieces += [(f"<0x{b:02X}>", 0, 6) for b in range(256)]
    trainer = text(2, field(3, 0, b"\x01") + b"\x98\x02\x01")
    path = tmp_path / "m.model"
    path.write_bytes(b"".join(piece(*p) for p in pieces) + trainer + text(3, text(1, b"identity")))
    import sentencepiece

    codec = sentencepiece_codec.Codec(str(path))
    assert codec.model.kind == sentencepiece_codec.UNIGRAM and codec.model.byte_fallback
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    for value in ["ab", "a b", "abc é", "  cab  ab ", ""]:
        assert codec.encode([value])[0].tolist() == library.encode(value)


def test_sentencepiece_operator(make):
    docs = make(ODD).withColumn("ids", F.lit("mine"))
    found = sentencepiece_codec.encode_texts(docs, tokenizer_file("piece_bpe_32k.model"))
    assert found.columns[-4:] == ["ids", "decoded", "round_trip", "parity"] and found.columns.count("ids") == 1
    assert all(r.round_trip and r.parity for r in found.collect())
    assert sentencepiece_codec.encode_texts(docs.limit(0), tokenizer_file("piece_bpe_32k.model")).count() == 0


def test_quality_rules_on_odd_rows(spark, make):
    docs = make(ODD).withColumn("kept", F.lit("mine"))
    for trusted in (make([(4, "")]), make([])):
        found = quality_rules.quality_rules(docs, trusted).collect()
        assert len(found) == len(ODD)
        by_id = {r.doc_id: r for r in found}
        assert by_id[None].n_words == 0 and by_id[None].base_failed and by_id[4].n_words == 60_000
        assert by_id[3].base_failed and not by_id[5].base_failed
    assert quality_rules.quality_rules(docs.limit(0), make([])).count() == 0


def test_quality_score_does_not_depend_on_partitions(make):
    docs = make([(i, f"{PASSAGE} w{i % 7} {'junk ' * (i % 3)}") for i in range(60)])
    trusted = make([(i, "") for i in range(30)])
    one = {r.doc_id: r.llr for r in quality_rules.quality_rules(docs.coalesce(1), trusted).collect()}
    assert one == {r.doc_id: r.llr for r in quality_rules.quality_rules(docs.repartition(7), trusted).collect()}


def test_quality_target_counts_every_trusted_document(make, monkeypatch):
    docs = make([(i, f"{PASSAGE} w{i % 7} own{i} {'junk ' * (i % 3)}") for i in range(60)] + [(None, PASSAGE)])
    trusted = make([(i % 30, "") for i in range(45)] + [(None, "")])
    whole = {r.doc_id: r.llr for r in quality_rules.quality_rules(docs, trusted).collect()}
    monkeypatch.setattr(quality_rules, "TRUSTED_ROWS", 8)
    assert whole == {r.doc_id: r.llr for r in quality_rules.quality_rules(docs, trusted).collect()}
    marked = docs.withColumn("own", F.coalesce(F.col("doc_id") < 30, F.lit(False)))
    expected = {tuple(r) for r in quality_rules.bucket_counts(marked, "text", F.col("own")).collect()}
    assert expected == {tuple(r) for r in quality_rules.all_counts(docs, trusted).collect()}


def test_language_edges(make):
    learn = make([(i, "the cat and the dog of it " * 5, "en") for i in range(20)] + [(i, "der hund und die katze mit " * 5, "de") for i in range(20)] + [(99, "x", None), (98, None, "fr")])
    network = language_id.fit(learn)
    assert network.languages == ["de", "en"]
    docs = make([(None, None), (1, ""), (2, "123 ... !"), (3, "the dog and the cat"), (4, "die katze und der hund"), (5, "the cat of it " * 30_000)])
    found = {r.doc_id: r for r in language_id.predict(docs.withColumn("score", F.lit("mine")), network).collect()}
    assert [found[k].lang_pred for k in (None, 1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de", "en"]
    assert found[2].score == 0 and 0 < found[3].score <= 1
    assert language_id.fit(learn.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


def test_every_byte_lies_in_a_window():
    for size in (1, 255, 256, 257, 509, 510, 511, 5000):
        raw = np.arange(size) % 251 + 1
        windows, text = language_id.windows_of(raw.astype(np.uint8), np.array([0, size]))
        step = language_id.WINDOW - language_id.OVERLAP
        seen = {i * step + k for i, w in enumerate(windows) for k in np.flatnonzero(w).tolist()}
        assert seen == set(range(size)) and len(windows) * step + language_id.OVERLAP < size + step + language_id.WINDOW


def test_quality_trees_edges(spark, make):
    docs = make([(i, "good plain words here . " * 9) for i in range(40)] + [(i, "B@D | # $ % " * 9) for i in range(40, 80)])
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)] + [(1, 1), (None, 1), (3, None)], "doc_id long, quality int")
    forest = quality_trees.fit(docs, labels)
    found = {r.doc_id: r.score for r in quality_trees.score(make(ODD + [(70, "# $ % | " * 9)]).withColumn("score", F.lit("mine")), forest).collect()}
    assert found[70] < 0.3 and all(0 <= s <= 1 for s in found.values())
    assert quality_trees.fit(docs, labels.limit(0)).score(np.zeros((1, len(quality_trees.STATISTICS))))[0] == 0.5
    only = quality_trees.fit(docs, labels.filter("quality = 1"))
    assert only.score(np.zeros((1, len(quality_trees.STATISTICS))))[0] > 0.9


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(3)
    x = rng.random((300, len(quality_trees.STATISTICS)))
    forest = quality_trees.grow(x, (x[:, 0] + x[:, 3] > 1).astype(float))
    for row, got in zip(x[:20], forest.score(x[:20]), strict=True):
        margin = forest.base
        for t in range(quality_trees.TREES):
            node = 0
            for _ in range(quality_trees.DEPTH):
                node = 2 * node + 1 + int(row[forest.statistic[t, node]] > forest.threshold[t, node])
            margin += forest.value[t, node - (2**quality_trees.DEPTH - 1)]
        assert abs(got - 1 / (1 + np.exp(-margin))) < 1e-12
    assert ((forest.score(x) > 0.5) == (x[:, 0] + x[:, 3] > 1)).mean() > 0.95


@pytest.mark.parametrize(
    "url, rule",
    [
        (None, None),
        ("no scheme", None),
        ("http://A.Example.ORG/es/1", "example.org/es/"),
        ("http://a.example.org/es", "org/"),
        ("http://example.org/en/12/3?x", "example.org/en/1"),
        ("http://notexample.org/en/1", "org/"),
        ("http://example.org", None),
        ("http://x.com/de/", "com/de/"),
        ("http://x.com/d", None),
        ("http://org/#a", "org/"),
        ("x://y://z.org/", None),
    ],
)
def test_url_rules(url, rule):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("block", "com", "/de/")]
    trie = url_filter.UrlTrie(url_filter.Rule(*r) for r in rules)
    found = trie.match(*url_filter.split_url(url))
    assert (found and found.text) == rule


def test_url_filter_operator(spark):
    pages = spark.createDataFrame([(1, None, "h"), (1, None, "h"), (2, "http://a.b/c", "i")], "page_id long, url string, Host string")
    found = url_filter.filter_urls(pages, [url_filter.Rule("block", "b", "/")])
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted(r.verdict for r in found.collect()) == ["allow", "allow", "block"]
    assert url_filter.filter_urls(pages.limit(0), []).count() == 0


def test_leaks_on_odd_rows(spark, make):
    items = spark.createDataFrame([(7, PASSAGE), (8, PASSAGE), (None, "one two"), (9, None), (10, "")], "item_id long, text string")
    changed = PASSAGE.replace("term0 ", "other ").upper()
    docs = make([*ODD, (11, f"before it {changed} after it"), (12, PASSAGE[:150])]).withColumn("similarity", F.lit("mine"))
    found = {r.doc_id: r for r in decontaminate.find_leaks(docs, items).collect()}
    assert found[5].item_ids == [7, 8] and found[5].similarity == 1.0
    assert found[11].item_ids == [7, 8] and found[3].item_ids == [None]
    assert not any(found[k].contaminated for k in (None, 1, 2, 4, 6, 12))
    assert decontaminate.find_leaks(docs, items.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0


def test_benchmark_in_parts(monkeypatch, spark, make):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 100)
    items = spark.createDataFrame([(i, f"{PASSAGE} tail{i} of item{i}") for i in range(6)], "item_id long, text string")
    found = decontaminate.find_leaks(make([(1, f"{PASSAGE} tail3 of item3")]), items).first()
    assert found.item_ids == list(range(6)) and found.similarity == 1.0


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**64, 40, dtype=np.uint64)
    queries = np.concatenate([prints ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)), rng.integers(0, 2**64, 40, dtype=np.uint64)])
    for radius in (0, 3, 23):
        got = set(zip(*[a.tolist() for a in decontaminate.HammingIndex(prints, radius).within(queries)], strict=True))
        distance = np.bitwise_count(queries[:, None] ^ prints[None, :])
        assert got == set(zip(*[a.tolist() for a in np.nonzero(distance <= radius)], strict=True))


def test_line_dedup_on_odd_rows(make):
    line = "page 12 of the long guide ends here"
    rows = [(i, f"own number{i}\n{line.replace('12', str(i))}\nshort one") for i in range(20, 40)]
    docs = make([*ODD, *rows, (None, line)]).withColumn("n_lines", F.lit("mine"))
    found = line_dedup.drop_recurring(docs)
    assert found.columns[-2:] == ["n_lines", "n_dropped"] and found.columns.count("n_lines") == 1
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, by_id.values())) == len(ODD) + 21
    assert by_id[20][0].n_dropped == 0 and by_id[21][0].text == "own number21\nshort one"
    assert sorted((r.text is None, r.text or "") for r in by_id[None]) == [(False, ""), (True, "")]
    assert by_id[4][0].n_lines == 1 and by_id[2][0].n_lines == 2
    assert line_dedup.drop_recurring(docs.limit(0)).count() == 0


def test_a_free_quarter_is_generalised(make):
    rows = [(i, f"all of these eight words but {'abcdefghijkl'[i]}x stay") for i in range(12)]
    assert [r.n_dropped for r in line_dedup.drop_recurring(make(rows)).orderBy("doc_id").collect()] == [0] + [1] * 11
    # two free quarters are another template
    rows = [(i, f"all of these {'abcdefghijkl'[i]}y words but {'abcdefghijkl'[i]}x stay") for i in range(12)]
    assert line_dedup.drop_recurring(make(rows)).filter("n_dropped > 0").count() == 0


def test_short_and_long_lines_have_limits_of_their_own(make):
    short = [(i, f"text {i} alone\nAll rights reserved.\npage {i}") for i in range(line_dedup.SHORT_DOCS)]
    found = line_dedup.drop_recurring(make(short)).orderBy("doc_id").collect()
    assert [r.n_dropped for r in found] == [0] + [1] * (len(short) - 1) and found[3].text == "text 3 alone\npage 3"
    assert line_dedup.drop_recurring(make(short[1:])).filter("n_dropped > 0").count() == 0
    long = [(i, f"text {i}\n{PASSAGE}") for i in range(2)] + [(i, f"own {i}\nthese few words are no passage") for i in range(2, 11)]
    assert {r.doc_id for r in line_dedup.drop_recurring(make(long)).filter("n_dropped > 0").collect()} == {1}


def test_near_duplicates_on_odd_rows(make):
    near = PASSAGE + " more"
    docs = make([*ODD, (7, near), (None, near), (8, "Two One"), (9, "ONE TWO")])
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == len(ODD) + 4
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    assert [r.component_id for r in by_id[5]] == [5, 5] and by_id[7][0].component_id == 5
    assert {(r.n_shingles, r.component_id, r.kept) for r in by_id[None]} == {(0, None, True), (37, 5, False)}
    assert by_id[9][0].component_id == 3 and by_id[8][0].component_id == 8
    assert by_id[1][0].n_shingles == 0 and by_id[2][0].kept and by_id[4][0].n_shingles == 59_996
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_equal_brute_force(make):
    """Chains, hubs, groups around the threshold and a passage that many texts share."""
    import random

    rng = random.Random(11)
    texts = {}
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(80)]
        for _ in range(60):
            copy = list(base)
            for at in rng.sample(range(80), rng.randrange(6)):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(copy)
    shared = " ".join(f"shared{i}" for i in range(60))
    for i in range(150):
        texts[len(texts)] = shared + " " + " ".join(f"own{i}x{k}" for k in range(rng.randrange(5, 60)))
    sets = {d: frozenset(zip(*[t.split()[k:] for k in range(5)], strict=False)) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i in ids:
        for j in ids[i + 1 :]:
            common = len(sets[i] & sets[j])
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    found = near_dedup.near_duplicates(make(list(texts.items()))).collect()
    assert {r.doc_id: r.component_id for r in found} == {d: find(d) for d in texts}


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]
    ra, rb, both = (near_dedup.registers(v, np.array([0, len(v)])) for v in (a, b, np.union1d(a, b)))
    assert (near_dedup.merged(ra, rb) == both).all()
    got = near_dedup.estimate((ra > rb).sum(1), (ra < rb).sum(1), np.array([2000.0]), np.array([2000.0]))
    assert abs(got[0] - 0.6) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_archives_on_odd_rows(spark, tmp_path):
    big, other = "x" * 1000, "é" * 500
    rows = [(1, "http://a.b/", big), (2, "http://a.b/", big), (3, None, None), (4, "http://c.d/\r\nx", "small"), (5, "http://a.b/?q", "small")]
    rows += [(6, "http://a.b/", other), (9, "http://a.b/", other), (9, "http://a.b/", other), (None, "http://z/", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    runs = warc.write_archives(pages, str(tmp_path))
    index = warc.merge_runs(runs).collect()
    assert [(r.url_key, r.captured) for r in index] == sorted((r.url_key, r.captured) for r in index) and len(index) == len(rows)
    found = warc.read_records(warc.merge_runs(runs)).collect()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in found)
    assert kinds == sorted(
        [(1, "revisit", 2, 1000), (2, "response", 0, 1000), (0, "revisit", 2, 1000), (3, "response", 0, 0), (4, "response", 0, 5)]
        + [(5, "response", 0, 5), (6, "revisit", 9, 1000), (9, "response", 0, 1000), (9, "response", 0, 1000)]
    )
    assert {r.payload.decode() for r in found if r.payload is not None} == {big, other, "small", ""}
    empty = warc.write_archives(pages.limit(0), str(tmp_path))
    assert warc.read_records(warc.merge_runs(empty)).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    rng = np.random.default_rng(k)
    runs = [sorted((int(x), (r, i)) for i, x in enumerate(rng.integers(0, 20, rng.integers(0, 30)))) for r in range(k)]
    found = list(warc.LoserTree(runs))
    assert [key for key, _ in found] == sorted(key for run in runs for key, _ in run)
    assert sorted(found) == sorted(pair for run in runs for pair in run)


def test_url_keys():
    assert warc.url_key("http://www.A.example/b?c#d") == "example,a,www)/b?c"
    assert warc.url_key("https://u@a.b") == "b,a)/" and warc.url_key(None) == "" and warc.url_key("plain") == "plain"

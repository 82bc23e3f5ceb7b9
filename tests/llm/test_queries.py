"""Registered queries against their SQL, and the others against brute force, over whole small tables."""

import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from compare import connect, difference

from depsignal.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def texts():
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return {r["doc_id"]: r["text"] for r in rows}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, queries.QUERIES[name], queries.ORACLES[name], SF) is None


def test_stored_ids_are_those_of_the_library(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    start, expected = 0, []
    for doc_id in sorted(texts):
        ids = [*library.encode(texts[doc_id], add_special_tokens=False).ids, 2]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        expected.append((doc_id, start, len(ids), crc))
        start += len(ids)
    assert sorted(map(tuple, queries.op1(spark, SF).collect())) == expected


def test_pieces_are_those_of_sentencepiece(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    found = queries.op2(spark, SF).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = library.encode(texts[row.doc_id])
        assert row.n_tokens == len(ids) and row.round_trip and row.parity
        assert row.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert row.decoded_crc32 == zlib.crc32(library.decode(ids).encode())


def counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for places in windows.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(spark, texts):
    for row in queries.op3(spark, SF).collect():
        expected = counts(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == expected
        assert row.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (row.base_failed and row.kept)


def test_quality_rules_keep_good_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    found = [r for r in queries.op3(spark, SF).collect() if not r.base_failed and r.doc_id in labels]
    assert all(r.kept for r in found if labels[r.doc_id] == 1)


def test_quality_rules_reject_bad_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    found = [(labels[r.doc_id], r.kept) for r in queries.op3(spark, sf).collect() if not r.base_failed and r.doc_id in labels]
    good, bad = [kept for q, kept in found if q == 1], [kept for q, kept in found if q == 0]
    assert len(bad) > 20 and sum(bad) <= 0.05 * len(bad), (sum(bad), len(bad))
    assert sum(good) >= 0.995 * len(good), (sum(good), len(good))


def test_held_out_languages(spark):
    truth = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    held = [r for r in queries.op4(spark, SF).collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    held = [r for r in queries.op5(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_leaks_equal_brute_force(spark, texts):
    def runs(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []

    items = {r["item_id"]: runs(r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    found = {r.doc_id: r for r in queries.op7(spark, SF).collect()}
    for doc_id, text in texts.items():
        own, hits = runs(text), []
        held = set(own)
        for item, wanted in items.items():
            size = min(len(wanted), len(own))
            if held.isdisjoint(wanted):
                continue
            for at in range(len(own) - size + 1):
                common = sum((Counter(own[at : at + size]) & Counter(wanted)).values())
                if common >= 0.75 * (size + len(wanted) - common):
                    hits.append(item)
                    break
        assert found[doc_id].item_ids == sorted(hits)
    assert any(r.contaminated for r in found.values())

"""Words that a polynomial hash modulo 2^64 cannot tell apart, whatever its base."""

import random

import numpy as np
import pyarrow as pa

from depsignal.llm import near_dedup, textarrays, token_store
from depsignal.llm.queries import tokenizer_file


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


PAIR = thue_morse(2048), thue_morse(2048, "b", "a")


def test_words_and_spans_differ():
    assert len(set(textarrays.words(pa.array(PAIR)).hashes.tolist())) == 2
    raw, offsets = textarrays.column_bytes(pa.array(PAIR))
    spans = textarrays.span_hashes(raw, offsets[:-1], offsets[1:], np.array([True, True]))
    assert len(set(spans.tolist())) == 2


def test_hashes_tell_texts_apart_as_strings_do():
    rng = random.Random(9)
    texts = ["".join(rng.choices("abAB é", k=rng.randrange(1, 300))) for _ in range(3000)]
    found = textarrays.words(pa.array(texts))
    # A-Z are lower-cased, other letters are not
    lower = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
    spelled = [lower(w) for t in texts for w in t.split(" ") if w]
    assert len(spelled) == len(found.hashes)
    assert len(set(spelled)) == len(set(found.hashes.tolist())) == len(set(zip(spelled, found.hashes.tolist(), strict=True)))


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    encoder, _ = token_store.byte_level_encoder(path)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = [*PAIR, f"x {PAIR[0]} y", f"x {PAIR[1]} y"]
    assert [e.tolist() for e in encoder.encode(pa.array(texts))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_texts_of_such_words_are_not_linked(make):
    found = near_dedup.near_duplicates(make([(1, PAIR[0]), (2, PAIR[1]), (3, PAIR[0])])).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 2, 3: 1}


def test_long_lines_of_two_words_are_told_apart(make):
    from depsignal.llm.line_dedup import drop_recurring

    lines = [thue_morse(2048, "on ", "in "), thue_morse(2048, "in ", "on ")]
    found = drop_recurring(make([(k, f"text {k}\n{line}") for k, line in enumerate(lines)])).collect()
    assert all(r.n_dropped == 0 for r in found)

"""Fill-in-middle against a plain version of the same cuts, and its round trip."""

import hashlib
import re

import pytest

from depsignal.llm import fill_middle
from depsignal.llm.fill_middle import PIECE_BYTES, arrange, cuts, outputs, pieces, restore

TEXTS = [
    (None, None), (None, "a\nb"), (1, ""), (2, "one"), (3, "\n"), (4, "\n\n\nx"), (5, "has <P> in it\nx"), (6, "near < P>\n<S\n>M>"),
    (7, "é\n日本\n\U0001f600\n" * 5), (8, "line\n" * 60_000), (9, "é" * 200_000), (9, "é" * 200_000), (9, "other\ntext"), (10, "a\r\nb\x00\x85c\n"),
]


def expected(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, sha(text), sha(text), text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text), out


def key(row):
    return repr(row)


@pytest.mark.parametrize("seed, rate, spm", [(7, 100, 50), (7, 100, 0), (8, 100, 100), (9, 50, 50), (1, 0, 50)])
def test_restored_rows(spark, make, seed, rate, spm):
    docs = make(TEXTS).selectExpr("*", "1 AS place", "2 AS mark", "3 AS part", "4 AS form", "5 AS piece", "6 AS h1")
    cut = pieces(docs, seed=seed, rate=rate, spm_rate=spm)
    want = sorted((expected(*t, seed, rate, spm) for t in TEXTS), key=key)
    assert sorted((tuple(r) for r in restore(cut).collect()), key=key) == sorted((w[:-1] for w in want), key=key)
    whole = restore(cut, whole=True).collect()
    assert sorted((r.doc_id, r.text) for r in whole if r.doc_id) == sorted((i, t or "") for i, t in TEXTS if i)
    found = {(r.doc_id, r.output) for r in outputs(cut).collect()}
    assert found == {(w[0], w[-1]) for w in want}


def test_empty_table(spark, make):
    assert restore(pieces(make([]))).count() == 0


def test_pieces_end_with_units_and_hold_whole_characters():
    raw = ("é" * PIECE_BYTES + "\n" + "ab\n" * PIECE_BYTES).encode()
    _, found = arrange(raw, (5, 9, 0, 70), 100, 50)
    found = list(found)
    assert all(len(p) <= PIECE_BYTES + 3 for p in found) and len(found) > 4
    assert all(p.decode() is not None for p in found)
    import numpy as np

    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    assert b"".join(cuts(raw, 0, len(raw), ends)) == raw


def test_sentinels_are_found_inside_pieces():
    reader = fill_middle._Sentinels("spm")
    got = [part for piece in (b"<S>x\n", b"y<P><M>", b"m") for part in reader.take(piece)]
    assert [p for _, p in sorted(got)] == [b"m", b"x\n", b"y"]
    assert [p for _, p in got] == [b"x\n", b"y", b"m"]


def test_one_exchange(spark, make):
    plan = restore(pieces(make(TEXTS)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1

"""Conversation repair against plain dynamic programming over whole edit strings."""

import hashlib
import random

from pyspark.sql import functions as F

from depsignal.llm import turn_repair
from depsignal.llm.turn_repair import BLANKS, STOPS, Survivors

TURNS = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, lines) by trying all edits, with whole strings as states; rows are (role, text, forced, cut_off)."""
    lead = {"0": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def close(paths):
        todo = list(paths.items())
        while todo:
            end, (cost, audit, lines) = todo.pop()
            new = (cost + 2, audit + "I", (*lines, name[lead[end]] + ":"))
            if lead[end] not in paths or new < paths[lead[end]]:
                paths[lead[end]] = new
                todo.append((lead[end], new))
        return paths

    paths = close({"0": (0, "", ())})
    for role, text, forced, cut_off in rows:
        new = {}

        def put(end, way, new=new):
            if end not in new or way < new[end]:
                new[end] = way

        for end, (cost, audit, lines) in paths.items():
            put(end, (cost + 3, audit + "D", lines))
            if forced:
                continue
            more = int(cut_off)
            if role[:1] == lead[end] or role[:1] == "s" and end == "0":
                put(role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            put(lead[end], (cost + 2 + more, audit + "R", (*lines, f"{name[lead[end]]}:{text}")))
        paths = close(new)
    return min(paths[e] for e in ("0", "a") if e in paths)


def outcome(rows):
    paths = Survivors()
    for role, text, forced, cut_off in rows:
        paths.take(role, text.encode(), forced, cut_off)
    return paths.finish()


def test_survivors_equal_whole_strings():
    rng = random.Random(11)
    for trial in range(4000):
        mix = rng.choice([["user", "assistant"], ["user", "assistant", "system", "tool", ""], ["user"], ["system", "user"], ["assistant", "sys"]])
        rows = [(rng.choice(mix), f"t{i}", rng.random() < 0.15, rng.random() < 0.3) for i in range(rng.randrange(14))]
        cost, audit, lines = cheapest(rows)
        assert outcome(rows) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), (trial, rows)


def test_survivors_of_long_rows():
    rng = random.Random(12)
    rows = [(rng.choice(["user", "assistant", "system"]), f"t{i}", rng.random() < 0.1, rng.random() < 0.2) for i in range(600)]
    cost, audit, lines = cheapest(rows)
    assert outcome(rows) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_tree_holds_unresolved_edits_only():
    rng, paths, most = random.Random(13), Survivors(), 0
    for i in range(20_000):
        paths.take(rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[i % 2], b"x", False, False)
        most = max(most, paths.held())
    assert most < 200 and len(paths.audit) > 19_000
    # two paths that never meet are kept whole, and in few nodes
    paths = Survivors()
    for _ in range(20_000):
        paths.take("user", b"x", False, False)
    todo, nodes = [paths.root], 0
    while todo:
        node = todo.pop()
        nodes += 1
        todo += node.kids
    assert nodes <= 8 and paths.held() > 19_000
    # nothing but rows that must go
    paths = Survivors()
    for _ in range(1000):
        paths.take("user", b"", True, False)
    assert paths.held() < 10 and paths.finish()[:2] == (3000, "D" * 1000)


def brute(rows):
    """The whole result from Python rows (conv, turn, role, text), without damage."""
    found = {}
    for conv in {r[0] for r in rows}:
        own = sorted(
            ((t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv),
            key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()),
        )
        seen, blank, duplicate, truncated, states = set(), 0, 0, 0, []
        for _, role, text in own:
            shown = text.rstrip(BLANKS)
            again = (role, text) in seen
            seen.add((role, text))
            cut = bool(shown) and not again and shown[-1] not in STOPS
            blank, duplicate, truncated = blank + (not shown), duplicate + (bool(shown) and again), truncated + cut
            states.append((role, text, not shown or again, cut))
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines = cheapest(states)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def odd_rows():
    rng = random.Random(14)
    rows = [(None, None, None, None), (None, 2, "user", "a."), (None, 2, "user", "a."), (1, 5, "user", "long. " * 50_000)]
    rows += [(2, t, "user", "hot.") for t in range(300)] + [(2, None, "user", "hot.")]
    for conv in range(3, 60):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "União"])
            rows.append((conv, rng.choice([turn, turn, turn, None, -turn]), role, rng.choice(["a.", "b?", "c", " \n", "", None, "é!\t", "d. "])))
    return rows


def test_repair_equals_brute_force(spark):
    rows = odd_rows()
    found = turn_repair.repair(spark.createDataFrame(rows, TURNS)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == brute(rows) and len(found) == len({r[0] for r in rows})


def test_repaired_rows_are_those_of_the_digest(spark):
    turns = spark.createDataFrame(odd_rows(), TURNS)
    found = turn_repair.repair(turns)
    lines = {}
    for r in turn_repair.repaired_rows(turns, found).orderBy("conv_id", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in found.collect():
        assert hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_conversation_without_rows_and_empty_table(spark):
    turns = spark.createDataFrame([(1, 1, "user", "a."), (2, 1, "user", "b.")], TURNS).withColumn("gone", F.col("conv_id") == 1)
    wide = turns.selectExpr("*", "1 AS repeated", "2 AS audit", "3 AS _kind")
    found = {r.conv_id: r for r in turn_repair.repair(wide, gone="gone").collect()}
    assert tuple(found[1]) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (found[2].cost, found[2].audit) == (2, "KI")
    assert turn_repair.repair(turns.limit(0)).count() == 0 and turn_repair.damaged(wide).count() >= 2


def test_one_exchange(spark):
    plan = turn_repair.repair(turn_repair.damaged(spark.createDataFrame(odd_rows(), TURNS)), gone="gone")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1

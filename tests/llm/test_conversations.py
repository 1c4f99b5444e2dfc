import itertools
import random
import time

import pytest

from secstream.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"


def table(spark, rows, extra=""):
    return spark.createDataFrame([(*r, "own") if extra else r for r in rows], SCHEMA + extra)


def found(df, **kinds):
    rows = c.repair(df, **kinds).collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def dialogues(seed, n, length):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, length)):
            if r.random() < 0.1:
                continue
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]) if r.random() < 0.4 else ["user", "assistant"][turn % 2]
            text = r.choice(["Yes.", "What?", "No end", " ", "", "Stop!\n", f"word {r.random()}.", f"cut {r.random()}"])
            rows.append((conv, turn, role, text))
    return rows


def all_repairs(steps, most=2):
    """Every edit sequence of a short conversation, insertions of up to ``most`` rows anywhere."""
    best = None

    def walk(i, q, cost, audit, inserted):
        nonlocal best
        if i == len(steps) and q in (c.START, c.ASSISTANT):
            best = min(best or (cost, audit), (cost, audit))
        if inserted < most:
            walk(i, c._NEXT[q], cost + 5, audit + "I", inserted + 1)
        if i < len(steps):
            for e, more, to in c.edits(q, steps[i]):
                walk(i + 1, to, cost + more, audit + e, inserted)

    walk(0, c.START, 0, "", 0)
    return best


def test_search_equals_all_edit_sequences():
    r = random.Random(1)
    for _ in range(400):
        steps = [(k, cut if k != "d" else 0, behind) for k, cut, behind in ((r.choice("suaxd"), r.choice([0, 0, 5]), r.choice([0, 0, 0, 2])) for _ in range(r.randint(0, 6)))]
        assert c.search(steps, c.START, c.END)[:2] == all_repairs(steps)


def test_bounds_are_never_over_the_cost():
    r = random.Random(2)
    for _ in range(200):
        steps = [(k, cut if k != "d" else 0, 0) for k, cut in ((r.choice("suaxd"), r.choice([0, 5])) for _ in range(r.randint(1, 7)))]
        for ends in (c.END, *({q: (0, "")} for q in range(4))):
            low = c.suffix_bounds(steps, ends)
            for i, q in itertools.product(range(len(steps)), range(4)):
                found = c.search(steps[i:], q, ends)
                assert low[i][q] >= c.NEVER if found is None else low[i][q] <= found[0]


def test_long_hard_rows_are_searched_in_time():
    """Every way in and out of pieces of the full length, also where nothing can be kept."""
    r, began = random.Random(3), time.process_time()
    for kinds in ("ua", "u", "a", "s", "x", "suaxd", "uuaa", "usua"):
        for cuts in ([0], [0, 5], [5]):
            steps = [(k, r.choice(cuts) if k != "d" else 0, 0) for k in (r.choice(kinds) for _ in range(c.PIECE))]
            assert c.search(steps, c.START, c.END) is not None
            for before, after in itertools.product(range(4), repeat=2):
                c.search(steps, before, {after: (0, "")})
    assert time.process_time() - began < 60


@pytest.mark.parametrize("piece", [c.PIECE, 3, 1])
def test_equals_brute_force(spark, piece):
    rows = dialogues(4, 60, 9)
    assert found(table(spark, rows), piece=piece) == c.brute_force(rows)


@pytest.mark.parametrize("piece", [c.PIECE, 7])
def test_a_conversation_with_a_third_of_all_rows_spreads(spark, piece):
    rows = dialogues(5, 30, 8)
    r = random.Random(6)
    rows += [(1000, t, r.choice(["user", "assistant"]), r.choice(["Fine.", f"t {t}.", f"t {t}"])) for t in range(700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(table(spark, rows), piece=piece) == c.brute_force(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hostile_rows(spark):
    """Nulls in every column, repeated rows and turns, ties, long texts, odd roles, clashing names, nothing left."""
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (None, 3, "assistant", "Ho."), (7, None, "system", "Be brief."), (7, None, "user", None)]
    rows += [(8, 5, "user", "Same.")] * 40 + [(8, 6, "assistant", "x" * 300_000 + "."), (8, -9, "sys", "Odd."), (8, 1 << 62, "únicode", "é!")]
    rows += [(9, t, "user", "") for t in range(5)] + [(10, 2, "", "Role is empty."), (10, 3, "ua", "Longer role.")]
    dropped = next(k for k in range(100, 1000) if c.zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    got = found(table(spark, rows, ", _conv string"))
    assert got == c.brute_force(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", c.EMPTY_SHA)


def test_gaps_beyond_a_long(spark):
    rows = [(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")]
    (row,) = c.repair(table(spark, rows)).collect()
    assert row.gaps == (1 << 63) - 1


def test_empty_table(spark):
    out = c.repair(table(spark, []))
    assert out.collect() == []
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

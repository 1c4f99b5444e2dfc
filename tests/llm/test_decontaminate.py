import random

import pytest

from secstream.llm import decontaminate as d
from tests.llm.helpers import documents, hostile, prose


def slow_best(item, text):
    """Least edit distance of ``item`` to a substring of ``text``, by the full table."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(item, 1):
        new = [k]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row), row.index(min(row))


def edited(r, text, n):
    s = list(text)
    for _ in range(n):
        at, kind = r.randrange(len(s)), r.randrange(3)
        if kind == 0:
            s[at] = r.choice("xyz ")
        elif kind == 1:
            s.insert(at, r.choice("xyz "))
        else:
            del s[at]
    return "".join(s)


def test_myers_equals_the_table():
    r = random.Random(1)
    for _ in range(60):
        item = "".join(r.choice("abc ") for _ in range(r.randint(1, 90)))
        text = "".join(r.choice("abc ") for _ in range(r.randint(0, 120)))
        assert d.myers(d.bit_masks(item), len(item), text) == slow_best(item, text) or not text


def test_matches_equal_brute_force(spark):
    r = random.Random(2)
    items = [(k, prose(k, r.randint(3, 40))) for k in range(12)] + [(77, " "), (78, None), (None, prose(55, 12))]
    rows = [*hostile()[:9], (11, "x")]
    for k in range(40):
        item = items[k % 12][1]
        rows.append((100 + k, prose(200 + k, 10) + " " + edited(r, item, r.randint(0, 2 + len(item) // 10)).upper() + "\n" + prose(300 + k, 5)))
    rows.append((100, rows[-40][1]))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, text in rows:
        for item_id, item in items:
            item = d.normal(item)
            if item:
                best, _ = slow_best(item, d.normal(text))
                if best <= d.budget(len(item)):
                    want.append((i, item_id, best))
    for at_once in (2_000, 4):
        got = d.contaminated(documents(spark, rows, "start"), benchmark, at_once).collect()
        assert sorted(((r.doc_id, r.item_id, r.distance) for r in got), key=str) == sorted(want, key=str)
    by_text = {(i, t) for i, t in rows}
    for r in got:
        item = d.normal(dict((k, v) for k, v in items)[r.item_id])
        part = [d.normal(t)[r.start : r.end] for i, t in by_text if i == r.doc_id]
        assert any(slow_best(item, p)[0] == r.distance for p in part)


def test_pieces_make_up_the_item():
    for n in (1, 11, 12, 23, 24, 100, 394):
        item = "a" * n
        cut = d.pieces(item)
        assert "".join(p for _, p in cut) == item and len(cut) == d.budget(n) + 1
        assert all(len(p) >= min(n, d.EDIT_EVERY) - 1 for _, p in cut)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "clean")]])
def test_empty_and_clean(spark, rows):
    benchmark = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(documents(spark, rows), benchmark).collect() == []
    assert d.contaminated(documents(spark, rows), none).collect() == []

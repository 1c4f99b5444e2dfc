import collections

import pytest

from secstream.llm import substrings as u
from tests.llm.helpers import WORD, documents, hostile, prose


def brute(rows, window):
    """Every window against every earlier one; rows with one id and text are one document."""
    keyed = sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda x: x[0])
    first = {}
    for i, t in keyed:
        w = WORD.findall(t)
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (i, p))
            first[tuple(w[p : p + window])] = min(first[tuple(w[p : p + window])], (i, p))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (i, p):
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize(("window", "period"), [(20, 13), (5, 3), (20, 7), (8, 8)])
def test_equals_brute_force(spark, window, period):
    rows = [(i, t) for i, t in hostile() if i is not None]
    rows += [(20, "a b c " * 40), (21, "x " + "a b c " * 30), (22, prose(2, 30) + " " + prose(1, 60))]
    got = u.remove_repeats(documents(spark, rows, "kept").repartition(3), window, period).collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(brute(rows, window))


def test_many_small_batches_settle_alike(spark, monkeypatch):
    rows = [(k, prose(k % 5, 40) + " " + prose(100 + k, 10) + " " + prose(77, 25)) for k in range(60)]
    assert collections.Counter(tuple(r) for r in u.remove_repeats(documents(spark, rows).repartition(7)).collect()) == collections.Counter(brute(rows, 20))


def test_rows_without_id_come_last(spark):
    text = prose(1, 40)
    got = sorted((r.doc_id is None, r.n_removed) for r in u.remove_repeats(documents(spark, [(None, text), (5, text), (None, text + " " + prose(2, 30))])).collect())
    assert got == [(False, 0), (True, 40), (True, 40)]


@pytest.mark.parametrize("period", [2, 5, 7, 13, 31, 50, 97])
def test_difference_cover(period):
    cover = u.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    if period == 13:
        assert len(cover) == 4


def test_empty_table(spark):
    assert u.remove_repeats(documents(spark, [])).collect() == []


def test_long_made_up_words_do_not_meet(spark):
    """Thue-Morse words have equal sums modulo 2^64 whatever the multiplier."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    rest = " " + prose(9, 19)
    rows = [(1, word + rest), (2, word.translate(str.maketrans("ab", "ba")) + rest)]
    got = u.remove_repeats(documents(spark, rows)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0}

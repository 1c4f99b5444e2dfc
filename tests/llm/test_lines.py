import collections
import hashlib
import random

import numpy as np
import pytest

from secstream.llm import lines as d
from tests.llm.helpers import documents, hostile, prose


def found(spark, rows, **kinds):
    out = d.without_repeated_lines(documents(spark, rows, "keep"), **kinds).collect()
    return collections.Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out)


def wanted(rows):
    return collections.Counter((i, *x) for (i, _), x in zip(rows, d.brute_force(rows), strict=True))


def shared(seed, n, held):
    """``n`` documents with lines drawn from a few shared ones, whose case and margins differ."""
    r = random.Random(seed)
    lines = [prose(900 + k, 4) for k in range(held)] + ["short", "", "   ", "é" * 20, "É" * 20, "x" * 19, "x" * 20]
    rows = []
    for k in range(n):
        own = [prose(1000 * seed + 10 * k + j, 5) for j in range(3)]
        taken = [r.choice(lines) for _ in range(r.randrange(8))]
        text = [r.choice(["", " ", "\t\v"]) + (x.upper() if r.random() < 0.3 and x.isascii() else x) + r.choice(["", "\r", " \f"]) for x in own + taken]
        r.shuffle(text)
        rows.append((k * 3 % n if n % 3 else k, "\n".join(text)))
    return rows


@pytest.mark.parametrize(("pending", "partitions"), [(d.PENDING, 4), (5, 4), (0, 7)])
def test_equals_brute_force(spark, pending, partitions):
    rows = shared(2, 100, 9)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert found(spark, rows, pending=pending) == wanted(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_line_in_every_document_spans_ranges(spark):
    """A run over several ranges is decided once, and its keeper is in one range only."""
    rows = [(k, f"A line that all documents hold\nown line number {k:05d} of many") for k in range(3_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = d.without_repeated_lines(documents(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.doc_id: r.n_dropped for r in got} == {k: int(k < 2_999) for k in range(3_000)}


def test_two_documents_are_not_enough_and_repeats_inside_one_do_not_count(spark):
    line = "twenty code points or more of text"
    rows = [(1, f"{line}\n{line}\n{line}"), (2, line), (3, "other"), (10, "ß" * 20 + "\nz"), (11, "ß" * 20), (12, "ß" * 20 + "\n" + "ß" * 20)]
    assert found(spark, rows) == wanted(rows)
    out = {r.doc_id: r for r in d.without_repeated_lines(documents(spark, rows)).collect()}
    assert out[1].kept_text == rows[0][1] and out[10].kept_text == "z" and out[11].kept_text == "" and out[12].kept_text == rows[5][1]


def test_hostile_rows(spark):
    """Repeated rows and ids, nulls, empty and very long texts: each row has its result, repeats change nothing."""
    line = "a line that quite a few documents hold"
    rows = [*hostile(), (None, line), (None, line), (20, line), (20, line), (20, line + "\nand more text under one id"), (21, line), (22, line), (22, line), (30, "\n".join([line, *(prose(k, 3) for k in range(20_000))])), (31, None), (31, "")]
    out = d.without_repeated_lines(documents(spark, rows, "_doc")).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert [r.n_dropped for r in by[20]] == [1, 1, 1] and {r.kept_text for r in by[20]} == {"", "and more text under one id"}
    assert by[30][0].n_dropped == 0 and by[30][0].n_lines == 20_001
    assert [(r.n_lines, r.n_dropped, r.kept_text) for r in by[31]] == [(1, 0, "")] * 2
    assert sorted((r.n_dropped, r.n_lines) for r in by[None])[-2:] == [(1, 1)] * 2
    ids = [(i, t) for i, t in rows if i is not None and i not in (11, 20)]
    assert collections.Counter(x for x in found(spark, ids).elements()) == wanted(ids)


def test_documents_without_an_id_keep_a_line_only_among_themselves(spark):
    line = "a line that has twenty code points"
    rows = [(None, f"{line}\nx"), (None, f"{line}\ny"), (None, f"{line}\nz")]
    assert sorted(r.n_dropped for r in d.without_repeated_lines(documents(spark, rows)).collect()) == [0, 1, 1]
    assert sorted(r.n_dropped for r in d.without_repeated_lines(documents(spark, [*rows, (1, line)])).collect()) == [0, 1, 1, 1]


def test_bitmaps_round_trip_and_compress(spark):
    assert d.unpack(None, 3).tolist() == [True] * 3
    for at in ([0], [5, 2], list(range(50)), [100_000]):
        keep = d.unpack(d.pack(at), max(at) + 10)
        assert np.flatnonzero(~keep).tolist() == sorted(at)
    assert len(d.pack([100_000])) < 200


def test_empty_table(spark):
    out = d.without_repeated_lines(documents(spark, []))
    assert out.collect() == [] and out.columns == ["doc_id", "n_lines", "n_dropped", "keep", "kept_text"]

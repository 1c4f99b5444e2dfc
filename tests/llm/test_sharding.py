import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from secstream.llm import sharding as s
from tests.llm.helpers import documents, hostile


def slow_table(shards, slots):
    """Each shard's whole permutation, claimed in turns."""
    h = lambda n, salt: int(hashlib.md5(f"{salt}:{n}".encode()).hexdigest()[:15], 16)
    wish = [[(h(n, "offset") + j * (h(n, "skip") % (slots - 1) + 1)) % slots for j in range(slots)] for n in shards]
    table, turn = {}, 0
    while len(table) < slots:
        k = turn % len(shards)
        table[next(x for x in wish[k] if x not in table)] = k
        turn += 1
    return [table[x] for x in range(slots)]


@pytest.mark.parametrize(("n", "slots"), [(1, 7), (3, 31), (7, 101), (5, 5)])
def test_table_equals_brute_force(n, slots):
    names = s.shard_names(n)
    assert s.lookup_table(names, slots) == slow_table(names, slots)


def test_table_is_even_and_stable():
    names = s.shard_names(64)
    table = s.lookup_table(names)
    n = collections.Counter(table)
    assert max(n.values()) - min(n.values()) <= 1
    fewer = s.lookup_table(names[:-1])
    moved = sum(a != b for a, b in zip(table, fewer))
    assert moved < 0.06 * len(table)


def test_placement(spark):
    names = s.shard_names(5)
    docs = documents(spark, hostile(), "Shard")
    got = s.place(docs, F.col("doc_id"), names, 101)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "shard"]
    table = s.lookup_table(names, 101)
    rows = got.collect()
    assert len(rows) == len(hostile())
    for r in rows:
        key = "null" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, table[slot])


def test_plan_has_no_exchange_of_documents(spark):
    plan = s.place(documents(spark, [(1, "a")]), F.col("doc_id"), s.shard_names(5), 101)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize(("shards", "slots"), [(["a", "a"], 7), ([], 7), (["a"], 8), (["a"] * 3, 2)])
def test_bad_tables_are_refused(shards, slots):
    with pytest.raises(ValueError, match="table"):
        s.lookup_table(shards, slots)


def test_empty(spark):
    assert s.place(documents(spark, []), F.col("doc_id"), s.shard_names(3), 7).collect() == []

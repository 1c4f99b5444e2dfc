import collections
import re

import pytest

from secstream.llm import secrets as s
from tests.llm.helpers import documents, hostile, prose


def brute(text):
    """All spans by Python's expressions."""
    out = []
    for order, r in enumerate(s.RULES):
        for m in re.finditer(r.pattern, text or ""):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), order, r.kind, m.end()))
    return sorted(out)


TEXTS = [
    'password = "abcdefgh1"',
    "PassWd:x12345678 secret=token:abcdefghij",
    "secret=short secret='longer/than+8'",
    "é日 api_key: ABCD1234efgh\nApiKey=zzzzzzzz9 AKIAABCDEFGHIJKL",
    "AKIASHORT xAKIA0123456789ABCDE " + "0a" * 20 + " " + "f" * 31 + " " + "f" * 32,
    "-----BEGIN RSA PRIVATE KEY-----\nx\n-----BEGIN PRIVATE KEY-----",
    "ghp_" + "a1" * 20 + " xoxb-1234567890-abc AIza" + "b" * 35,
    "token=" + "deadbeef" * 5 + " token=" + "deadbeef" * 5,
    "secret==========",
    prose(1, 50) + " TOKEN=" + "q" * 3000 + " " + prose(2, 20_000),
]


def test_spans_equal_brute_force(spark):
    rows = [*hostile(), *((100 + k, t) for k, t in enumerate(TEXTS)), (100, TEXTS[0]), (None, TEXTS[0]), (None, TEXTS[7])]
    got = s.scan(documents(spark, rows, "spans")).collect()
    found = collections.Counter((r.doc_id, tuple((x.start, x.order, x.kind, x.end) for x in r.spans)) for r in got)
    assert found == collections.Counter((i, tuple(brute(t))) for i, t in rows)


@pytest.mark.parametrize("rule", s.RULES, ids=lambda r: r.kind)
def test_trigrams_are_mandatory(rule):
    query = s.trigram_query(rule.pattern)
    assert bool(query) == (rule.kind != "hex")
    for text in TEXTS:
        if any(len(m[rule.group]) >= rule.least for m in re.finditer(rule.pattern, text)):
            assert not query or any(all(t in text.lower() for t in c) for c in query)


def test_queries_of_some_expressions():
    q = lambda p: {"".join(sorted(c)) for x in s.trigram_query(p) for c in [x]}
    assert q("abcd") == {"abcbcd"}
    assert q("ab[cd]") == {"abc", "abd"}
    assert q("abc|def") == {"abc", "def"}
    assert q("abc|d") == set() == q("a*") == q("[a-z]+")
    assert q("(?i:ABC)x?") == {"abc"}
    assert q("abc.*def") == {"abcdef"}
    assert q("(abc)+") == {"abc"}
    assert q("(?:ab){2}") == {"abababab"[:3] + "bab"}


def test_scan_without_index_rules_and_empty_table(spark):
    only = (s.Rule("hex", r"[0-9a-f]{32,}"),)
    assert [len(r.spans) for r in s.scan(documents(spark, [(1, "f" * 40)]), only).collect()] == [1]
    assert s.scan(documents(spark, [])).collect() == []

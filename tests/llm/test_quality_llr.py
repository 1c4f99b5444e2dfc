import collections
import re

import numpy as np

from secstream.llm import quality_llr as q
from tests.llm.helpers import WORD, documents, hostile, prose


def base(text):
    """The base rules, word by word."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n = collections.Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_rules_equal_brute_force(spark):
    rows = [*hostile(), (20, "a b c d e f\n" * 4), (21, "x|y <b> #1 $2\nx|y <b> #1 $2\n\n \n" + prose(9, 80)), (22, "a b c d e a b c d e " + prose(3, 100))]
    got = q.judge(documents(spark, rows, "score"), np.zeros(q.BUCKETS)).collect()
    assert len(got) == len(rows)
    found = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert found == collections.Counter((i, *base(t)) for i, t in rows)
    assert all(not (r.kept and r.base_failed) for r in got)


def test_ratio_prefers_trusted_text_and_is_the_mean(spark):
    good = [(k, prose(k % 7, 50)) for k in range(20)]
    bad = [(100 + k, " ".join(f"zz{(j * 7 + k) % 23}##" for j in range(50)) + " " + prose(k + 50, 20)) for k in range(20)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in good] + [(k, 0, 0) for k, _ in bad] + [(None, 1, 0), (999, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in q.quality_verdicts(docs, labels, threshold=0.0).collect()}
    assert min(out[k].score for k, _ in good) > 0 > max(out[k].score for k, _ in bad)
    ratios = q.log_ratios(docs, labels)
    from secstream.llm.common import raw_bytes, word_bounds, word_hashes

    raw = raw_bytes(good[0][1])
    words = word_hashes(raw, *word_bounds(raw))
    assert abs(out[0].score - ratios[q.buckets(words)].mean()) < 1e-12
    assert {k: r.score for k, r in out.items()} == {r.doc_id: r.score for r in q.quality_verdicts(docs.repartition(5), labels, threshold=0.0).collect()}


def test_counts_equal_brute_force(spark):
    total = q.gram_counts(documents(spark, hostile()[:9])).sum()
    assert total == sum(max(0, 2 * len(WORD.findall(t or "")) - 1) for _, t in hostile()[:9])


def test_every_trusted_row_counts_once(spark):
    n = 20_001
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").union(spark.createDataFrame([(None, 1, 0)], "doc_id long, quality int, toxic int"))
    docs = documents(spark, [(k, f"w{k}") for k in range(0, n + 500, 100)] + [(5, "a b"), (5, "a b"), (None, "x"), (7, None), (8, "")])
    found = q.trusted_texts(docs, labels.union(labels))
    assert sorted(r._id for r in found.collect()) == sorted([*range(0, n, 100), 5, 5])


def test_texts_are_never_broadcast_nor_ids(spark):
    docs, labels = documents(spark, hostile()), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    plan = q.trusted_texts(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score == 0.0 for r in q.quality_verdicts(documents(spark, hostile()[:4]), none).collect())
    assert q.quality_verdicts(documents(spark, []), none).collect() == []

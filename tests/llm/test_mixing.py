import collections

from pyspark.sql import functions as F

from secstream.llm import mixing as m
from tests.llm.helpers import documents, hostile, prose


def corpus():
    good = [(k, prose(k, 60 + k % 50)) for k in range(120)]
    junk = [(200 + k, " ".join(["same###"] * 40) + str(k)) for k in range(60)]
    labels = [(k, 1) for k, _ in good[::2]] + [(k, 0) for k, _ in junk[::2]]
    return good, junk, labels


def tables(spark, extra=None):
    good, junk, labels = corpus()
    return documents(spark, good + junk, extra), spark.createDataFrame([*labels, (None, 1), (0, None)], "doc_id long, quality int")


def test_totals_match_the_targets(spark):
    docs, labels = tables(spark)
    for targets in ({1: 0.9, 0: 0.1}, {1: 0.3, 0: 0.7}, {1: 2.0, 0: 2.0}):
        rows = m.mixing_rates(docs, labels, targets=targets).collect()
        got = {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) for d in (0, 1)}
        before = {d: sum(r.n_tokens * r[f"p_{d}"] for r in rows) for d in (0, 1)}
        share = sum(targets.values())
        whole = sum(got.values())
        assert all(abs(got[d] / whole - targets[d] / share) < 1e-3 for d in (0, 1))
        assert all(got[d] > before[d] * 0.999 for d in (0, 1))
        assert all(r.rate >= 0 and abs(r.p_0 + r.p_1 - 1) < 1e-9 for r in rows)


def test_rates_equal_projected_gradient_in_numpy(spark):
    import numpy as np

    docs, labels = tables(spark)
    mix = m.fit(docs, labels, targets={1: 0.3, 0: 0.7})
    rows = sorted(m.applied(docs.select("doc_id", "text"), mix).select("_key", "_n", "_p0", "_p1", "_rate").collect())
    n, p, got = (np.array([r[1] for r in rows], float), np.array([[r[2], r[3]] for r in rows]), np.array([r[4] for r in rows]))
    x = n[:, None] * p
    now = x.sum(axis=0)
    weights = np.array([0.7, 0.3])
    goal = weights * (now / weights).max()
    step = 1 / ((x.T @ p).sum(axis=1) / goal).max()
    r = np.ones(len(n))
    for _ in range(m.MOST_STEPS):
        miss = (r @ x - goal) / goal
        if abs(miss).max() <= m.TOLERANCE:
            break
        r = np.maximum(0, r - step * (p @ miss))
    assert np.allclose(r, got, rtol=1e-6)


def test_classifier_separates_the_labels(spark):
    docs, labels = tables(spark)
    good, junk, _ = corpus()
    got = {r.doc_id: r.p_1 for r in m.mixing_rates(docs, labels).collect()}
    assert min(got[k] for k, _ in good) > 0.5 > max(got[k] for k, _ in junk)


def test_stage_repeats_and_keeps(spark, tmp_path):
    docs, labels = tables(spark, "_rate")
    labels.withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    out = m.mix_documents(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    n = collections.Counter(r.doc_id for r in out.collect())
    assert set(n) == {r.doc_id for r in docs.collect()}
    rates = {r.doc_id: r.rate for r in m.mixing_rates(docs, labels).collect()}
    assert all(int(rates[k] + 1e-3) <= c <= int(rates[k] + 1e-3) + 1 for k, c in n.items())


def test_hostile_rows_and_no_labels(spark):
    _, labels = tables(spark)
    docs, _ = tables(spark)
    mixed = docs.union(documents(spark, hostile()))
    got = m.mixing_rates(mixed, labels).collect()
    assert len(got) == mixed.count() and all(r.rate is not None and r.rate == r.rate for r in got)
    none = labels.limit(0)
    assert {r.rate for r in m.mixing_rates(docs, none).collect()} == {1.0}
    assert m.mixing_rates(documents(spark, []), none).collect() == []


def overlapping(spark, poor_share, n=4_000):
    """Texts of two kinds whose features overlap, the labels of all, and numbers that a mixture can be fitted to."""
    import numpy as np

    r = np.random.default_rng(5)
    poor = r.random(n) < poor_share
    odds = np.where(poor, 1.0, -1.0) * 1.5**2 / 2 + 1.5 * r.standard_normal(n) + np.log(poor_share / (1 - poor_share))
    p = 1 / (1 + np.exp(-odds))
    words = r.integers(50, 500, n)
    rows = [(k, int(words[k]), float(p[k]), float(1 - p[k])) for k in range(n)]
    return spark.createDataFrame(rows, "_key long, _n long, _p0 double, _p1 double"), words[:, None] * np.stack([p, 1 - p], axis=1)


def fitted(spark, monkeypatch, poor_share, least):
    own, x = overlapping(spark, poor_share)
    mix = m.Mixture([0, 1], {0: 0.5, 1: 0.5}, {0: [], 1: []})
    monkeypatch.setattr(m, "classifier", lambda *a: mix)
    monkeypatch.setattr(m, "with_features", lambda docs: docs)
    monkeypatch.setattr(m, "materialise", lambda df, name="": df.cache())
    monkeypatch.setattr(m.Mixture, "posteriors", lambda self, df: own)
    m.fit(spark.createDataFrame([], "doc_id long, text string"), None, least=least)
    rows = {r._key: r._rate for r in mix.rates(own).collect()}
    return mix, sum(rows[k] * x[k] for k in range(len(x))), x.sum(axis=0)


def test_targets_are_met_where_posteriors_overlap(spark, monkeypatch):
    for poor_share in (0.3, 0.5):
        mix, got, before = fitted(spark, monkeypatch, poor_share, 0.0)
        goal = max(before[0] / 0.1, before[1] / 0.9)
        assert abs(got[0] / (0.1 * goal) - 1) < 2 * m.TOLERANCE and abs(got[1] / (0.9 * goal) - 1) < 2 * m.TOLERANCE


def test_a_miss_that_stays_is_reported(spark, monkeypatch, caplog):
    mix, got, before = fitted(spark, monkeypatch, 0.3, 1.0)
    goal = max(before[0] / 0.1, before[1] / 0.9)
    miss = {0: got[0] / (0.1 * goal) - 1, 1: got[1] / (0.9 * goal) - 1}
    assert all(abs(mix.miss[d] - miss[d]) < 1e-6 for d in miss)
    assert 0.001 < max(map(abs, miss.values())) < 0.1
    assert "cannot match the targets" in caplog.text

import itertools
import random

import numpy as np
from pyspark.sql import functions as F
import pytest

from secstream.llm import toxicity as t
from tests.llm.helpers import documents, hostile, prose

BAD = ["grolt", "fnarbel", "snivok", "drubbish"]


def corpus(n=400):
    r = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        words = prose(k, r.randint(20, 120)).split()
        toxic = k % 5 == 1
        for _ in range(r.randint(2, 5) if toxic else 0):
            words[r.randrange(len(words))] = r.choice(BAD).title() + r.choice(["", "!", "%%%"])
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = corpus()
    table = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return rows, dict((i, x) for i, _, x in labels), t.train(documents(spark, rows), table)


def test_held_out_accuracy_and_spans(spark, trained):
    rows, truth, model = trained
    got = t.score_documents(documents(spark, rows, "score"), model).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 40
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    text = dict(rows)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    marked = [text[r.doc_id][s.start : s.end].lower() in BAD for r in got for s in r.spans]
    assert len(marked) > 150 and sum(marked) >= 0.97 * len(marked)


def test_marginals_equal_enumeration():
    r = np.random.default_rng(3)
    model = t.Model(r.normal(size=t.BUCKETS), -0.3, 0.4, 0.9, -0.2, -0.7, np.zeros(4))
    chains = [r.integers(0, t.BUCKETS, (n, t.FEATURES)).astype(np.int32) for n in (5, 1, 0, 8, 8)]
    got = np.split(t.marginals(model, chains), np.cumsum([len(c) for c in chains])[:-1])
    move = np.array([[0.0, model.enter], [model.leave, model.stay]])
    for chain, p in zip(chains, got):
        total, on = 0.0, np.zeros(len(chain))
        for path in itertools.product((0, 1), repeat=len(chain)):
            score = sum(s * (model.weights[f].sum() + model.bias) for s, f in zip(path, chain))
            score += sum(move[a, b] for a, b in zip(path, path[1:])) + (model.start * path[0] if path else 0)
            total += np.exp(score)
            on += np.exp(score) * np.array(path)
        assert np.allclose(on / total if len(chain) else [], p)


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(200)
    import zlib

    out = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    flipped = [(i, q, 1 - x if i in out else x) for i, q, x in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (t.train(documents(spark, rows), spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.curve, b.curve)
    got = t.score_documents(documents(spark, rows), a).collect()
    assert {r.doc_id for r in got if r.held_out} == out


def test_hostile_texts(spark, trained):
    rows = hostile()
    got = t.score_documents(documents(spark, rows, "spans"), trained[2]).collect()
    assert len(got) == len(rows)
    empty = {r.score for r in got if r.doc_id in (4, 5, 6)}
    assert len(empty) == 1 and max(empty) < 0.5


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = t.train(documents(spark, hostile()), none)
    assert {r.predicted for r in t.score_documents(documents(spark, hostile()), model).collect()} == {0}
    assert t.score_documents(documents(spark, []), model).collect() == []


def test_repeated_ids_send_each_text_once(spark, monkeypatch):
    """One labelled id with very many rows and texts: the driver gets the chosen texts, no row of the id beside them."""
    seen = []
    plain = t.fit
    monkeypatch.setattr(t, "fit", lambda texts, toxic, prior: seen.append(len(texts)) or plain(texts, toxic, prior))
    rows, labels = corpus(40)
    schema = "doc_id long, quality int, toxic int"
    learnt = next(i for i, _, _ in labels if i in {r.doc_id for r in spark.createDataFrame(labels, schema).filter(~t.held_out(F.col("doc_id"))).collect()})
    hot = [(learnt, f"text number {k} of one id") for k in range(30)] + [(learnt, "the same text again")] * 50 + [(learnt, "w " * (t.TRAIN_CHARS // 2 + 1))]
    most = 10
    t.train(documents(spark, rows + hot), spark.createDataFrame(labels, schema), most)
    assert len(seen) == 1 and seen[0] <= 2 * most

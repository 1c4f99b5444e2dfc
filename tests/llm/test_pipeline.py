import random

import pytest

import corpus_pipeline
from tests.llm.helpers import documents, hostile, prose

BAD = ["grolt", "fnarbel", "snivok", "drubbish"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean prose, toxic texts, copies, near copies and texts that hold a test item."""
    path, r = str(tmp_path_factory.mktemp("tables")), random.Random(1)
    items = [(k, prose(9000 + k, 25)) for k in range(5)]
    rows, labels = [], []
    for k in range(300):
        words = prose(k, 60).split()
        toxic = k % 6 == 1
        for _ in range(4 if toxic else 0):
            words[r.randrange(60)] = r.choice(BAD)
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 7 != 0), int(toxic)))
    rows += [(1000 + k, rows[6 * k][1]) for k in range(20)]
    rows += [(2000 + k, rows[6 * k][1] + " tail") for k in range(20)]
    rows += [(3000 + k, prose(700 + k, 30) + " " + items[k][1].upper() + " " + prose(800 + k, 30)) for k in range(5)]
    rows += [(None, None), (4000, ""), (4001, " \n"), *((i, t) for i, t in hostile() if i == 10)]
    documents(spark, rows, "slot").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_planted_cases(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "shard"]
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    clean = {k for k in range(300) if k % 6 != 1}
    assert clean <= kept and 10 in kept
    assert sum(k in kept for k in range(300) if k % 6 == 1) <= 2
    assert not kept & {*range(1000, 1020), *range(2000, 2020), *range(3000, 3005)}
    assert len(kept & {None, 4000, 4001}) == 1


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, folder)
        assert got.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == docs.columns


def test_operators_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries()

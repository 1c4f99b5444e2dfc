import collections
import uuid

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from secstream.llm import token_counts as t
from secstream.session import work_dir
from tests.llm.helpers import documents, hostile


def cache(spark):
    return f"{work_dir(spark)}/cache-{uuid.uuid4().hex}"


def test_counts_equal_the_library(spark):
    rows = [*hostile(), (30, "a<|endoftext|>b"), (31, "  spaces \n\n and\ttabs ")]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, text in rows:
        n = len(tok.encode(text or "", add_special_tokens=False).ids)
        want[(i, len((text or "").encode()), n, n > 1024)] += 1
    got = t.count_tokens(documents(spark, rows, "content"), cache(spark)).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_only_misses_are_encoded_and_appended(spark):
    where = cache(spark)
    first = documents(spark, [(1, "one two"), (2, "one two"), (3, None)])
    t.count_tokens(first, where).collect()
    stored = spark.read.parquet(where)
    assert stored.count() == 2
    wrong = spark.createDataFrame([(r.content_sha256, r.tokenizer_sha256, 77) for r in stored.collect()], t.CACHE_SCHEMA)
    other = cache(spark)
    wrong.write.parquet(other)
    got = {r.doc_id: r.n_tokens for r in t.count_tokens(documents(spark, [(1, "one two"), (4, "new text")]), other).collect()}
    assert got[1] == 77 and got[4] == 2
    assert spark.read.parquet(other).count() == 3


def test_tokenizer_versions_do_not_mix(spark):
    where = cache(spark)
    docs = documents(spark, [(1, "Hello there, tokenizers")])
    a = t.count_tokens(docs, where).first().n_tokens
    b = t.count_tokens(docs, where, tokenizer="piece_bpe_32k.model").first().n_tokens
    import sentencepiece

    assert b == len(sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).encode("Hello there, tokenizers"))
    assert t.count_tokens(docs, where).first().n_tokens == a
    assert spark.read.parquet(where).count() == 2


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_empty(spark, rows):
    assert [r.n_tokens for r in t.count_tokens(documents(spark, rows), cache(spark)).collect()] == [0] * len(rows)

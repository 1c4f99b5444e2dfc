"""Token counts with a digest cache.

A count belongs to the pair (SHA-256 of the normalised content, digest of the tokenizer version). Documents
are joined to the stored counts by that pair; only the distinct contents without a stored count are encoded,
and their counts are appended to the cache, a Parquet folder. Copies of a content, however many, meet in
a map-side aggregate, so a hot content reaches its reducer as one row from each task.

An append that is repeated after a lost driver may store a pair twice; readers take the pair once.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secstream.llm.common import blocks, table
from secstream.session import materialise, work_dir

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
CACHE_SCHEMA = "content_sha256 binary, tokenizer_sha256 string, n_tokens long"


def as_is(text: Column) -> Column:
    """The content that is encoded: the text itself, nothing for null. Byte-level BPE has no normaliser."""
    return F.coalesce(text, F.lit(""))


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library} {importlib.metadata.version(library)}".encode()).hexdigest()


_loaded: dict[str, Callable[[list[str]], list[int]]] = {}


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of whole texts as the library for the file gives them; one per worker."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _loaded[path] = lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[path]


def encode_counts(contents: DataFrame, name: str) -> DataFrame:
    """(content_sha256, n_tokens) of (content_sha256, content). The file is looked up where the task runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(public_tokenizers.path(name) if os.sep not in name else name)
        for batch in blocks(batches, "content"):
            tokens = count(batch.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("content_sha256"), pa.array(tokens, pa.int64())], ["content_sha256", "n_tokens"])

    return contents.select("content_sha256", "content").mapInArrow(run, "content_sha256 binary, n_tokens long")


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(content_sha256, n_tokens) stored for one tokenizer version; empty if nothing was stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA).select("content_sha256", "n_tokens")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer_sha256") == version)
    return stored.groupBy("content_sha256").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, tokenizer: str = TOKENIZER, limit: int = LIMIT, normalise: Callable[[Column], Column] = as_is) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, content_sha256 for every row of ``docs`` (doc_id, text).

    Appends the counts of contents that ``cache`` lacks, then joins. Null texts count as empty (0 tokens);
    null or repeated ids and repeated rows each give their own row; extra columns are ignored; an empty
    table gives an empty result and appends nothing that matters. Texts are never cut.
    """
    spark = docs.sparkSession
    version = tokenizer_version(public_tokenizers.path(tokenizer) if os.sep not in tokenizer else tokenizer)
    content = normalise(F.col("text"))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    known = read_cache(spark, cache, version)
    distinct = docs.select(digest.alias("content_sha256"), content.alias("content")).groupBy("content_sha256").agg(F.first("content").alias("content"))
    misses = distinct.join(known.select("content_sha256"), "content_sha256", "left_anti")
    fresh = encode_counts(misses, tokenizer).select("content_sha256", F.lit(version).alias("tokenizer_sha256"), "n_tokens")
    fresh.write.mode("append").parquet(cache)

    # written, so that both sides of the join are plain exchanges and a hot content can be split
    counts = materialise(read_cache(spark, cache, version), "token-counts")
    rows = docs.select("doc_id", digest.alias("content_sha256"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return rows.join(counts, "content_sha256").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("content_sha256")).alias("content_sha256")
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that each run encodes all distinct texts of its table."""
    cache = f"{work_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), cache)

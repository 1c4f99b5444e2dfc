"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text, after a few exact base rules.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials over the buckets are
estimated, with add-``SMOOTHING`` smoothing: the raw one from all documents, the trusted one from documents
that ``labels`` calls good. A document's score is the mean log ratio of its n-grams, so length does not
matter, and one fixed threshold decides every document; nothing is drawn at random.

Counts: every task adds up a vector of a fixed length and emits the non-zero buckets, so what is added up has
as many rows per task as buckets at most, whatever a word's frequency. The raw counts need no label and read
the table where it lies; texts are shuffled once, to find the trusted ones. The two vectors (BUCKETS numbers
each) are all that reaches the driver and goes back out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secstream.llm.common import blocks, raw_bytes, table, window_hashes, word_bounds, word_hashes

BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Mean log ratio per n-gram that a document must reach. Ordinary prose lies around zero by construction,
#: text that the trusted set hardly contains far below.
THRESHOLD = -0.15
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_grams long, score double, kept boolean"


def buckets(words: np.ndarray) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbours."""
    return (np.concatenate([words, window_hashes(words, 2)]) % np.uint64(BUCKETS)).astype(np.int64)


def repeat_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> int:
    """Words inside a window of five words that occurs twice or more in the text, its first occurrence included."""
    windows = window_hashes(words, REPEAT_WINDOW)
    _, where, n = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.flatnonzero(n[where] > 1)
    if not len(again):
        return 0
    text = raw.tobytes()  # equal hashes are only a hint; the words decide
    seen: dict[tuple[bytes, ...], list[int]] = {}
    for p in again.tolist():
        seen.setdefault(tuple(text[starts[k] : ends[k]] for k in range(p, p + REPEAT_WINDOW)), []).append(p)
    covered = np.zeros(len(words), bool)
    for places in seen.values():
        if len(places) > 1:
            at = np.asarray(places)
            for k in range(REPEAT_WINDOW):
                covered[at + k] = True
    return int(covered.sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def gram_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in blocks(batches):
            for text in batch.column("text").to_pylist():
                raw = raw_bytes(text)
                seen += np.bincount(buckets(word_hashes(raw, *word_bounds(raw))), minlength=BUCKETS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is labelled good.

    A sort-merge semi-join at every size: the ids are never broadcast, so the plan that is measured on small
    tables is the one that runs on large ones. Neither side is aggregated in front of it, which lets adaptive
    execution split an id that many rows share.
    """
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_trusted_id"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").filter("_id IS NOT NULL AND length(text) > 0")
    return keyed.join(good.hint("merge"), F.col("_id") == F.col("_trusted_id"), "left_semi")


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log P_trusted - log P_raw of every bucket; zero everywhere if no trusted text exists."""
    trusted = gram_counts(trusted_texts(docs, labels))
    if not trusted.sum():
        return np.zeros(BUCKETS)
    p, q = trusted + SMOOTHING, gram_counts(docs) + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """COLUMNS for every row of ``docs`` (doc_id, text).

    Null and empty texts have no words, fail the base rules and are not kept; their score is 0. Repeated
    rows and ids each give their own row; a null id stays null; other columns are ignored. An empty table
    gives no rows. A very long text is one row like any other: all its words count, in blocks of bytes.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in blocks(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = raw_bytes(text)
                starts, ends = word_bounds(raw)
                words = word_hashes(raw, starts, ends)
                n = len(words)
                chars = int(((raw & 0xC0) != 0x80).sum() - _SPACE[raw].sum())
                repeats = repeat_words(raw, starts, ends, words)
                grams = buckets(words)
                score = float(weight[grams].mean()) if len(grams) else 0.0
                failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
                rows.append((doc_id, n, chars, int(_SYMBOL[raw].sum()), dup_lines(text or ""), repeats, failed, len(grams), score, not failed and score >= threshold))
            types = [pa.int64()] * 6 + [pa.bool_(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COLUMNS)


def quality_verdicts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the given tables, then judge every document.

    Rows and nulls as in ``judge``. Without labels, without good ones or with none of their documents present,
    every score is 0 and the base rules decide. Rows without an id are never trusted; of rows that share a
    trusted id each counts.
    """
    return judge(docs, log_ratios(docs.select("doc_id", "text"), labels), threshold)


def op2_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

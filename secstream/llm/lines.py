"""Line dedup: long lines that several documents hold stay only in the last of them.

* Every line of LEAST_CHARS code points or more becomes a row of five numbers: 128 bits of hash of its key, the
  document, a digest of the document's text, and the position. No text is shuffled to find repeats.
* The rows are range-partitioned and sorted by hash, then document from the largest down, then position. A line
  that very many documents hold spreads over neighbouring ranges, because the document is part of the range key.
* Each range is read as a stream: the first document of a run of equal hashes is the one that keeps the line, and
  once a run is seen to hold LEAST_DOCS documents all others lose it. Only runs that touch a range's edge, or that
  outgrow PENDING rows, are passed on undecided; one small aggregate over these decides them.
* What comes out are compressed bitmaps, one for each document that loses lines; bit k is 0 if line k goes.
  Texts meet their bitmaps in one join.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secstream.llm.common import blocks, table
from secstream.session import materialise

LEAST_CHARS = 20
LEAST_DOCS = 3
#: Rows of one run that are held back until it is decided.
PENDING = 1 << 18
_SPACE = " \t\n\v\f\r"
_ROW = ("_h1", "_h2", "_rev", "_tag", "_pos")
_ROWS = "_h1 long, _h2 long, _rev long, _tag long, _pos long"
_FOUND = f"{_ROWS}, _open boolean"


def document(doc_id: Column, text: Column) -> Column:
    """A never-null long that orders documents: the id, or, without one, a value under -2^62 drawn from the text."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 62)) - F.xxhash64(text).bitwiseAND(F.lit((1 << 61) - 1)))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null), _doc and _tag; other columns are left out, so that their names cannot clash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("*", document(F.col("doc_id"), F.col("text")).alias("_doc"), F.xxhash64("text").alias("_tag"))


def line_rows(docs: DataFrame) -> DataFrame:
    """_ROWS for every long line; _rev orders documents from the largest down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in blocks(batches):
            hashes, owner, position = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                if len(text) < LEAST_CHARS:
                    continue
                for at, line in enumerate(text.split("\n")):
                    key = line.strip(_SPACE)
                    if len(key) >= LEAST_CHARS:
                        hashes.append(digest(key.encode("utf-8", "surrogatepass").lower()))  # of bytes: A-Z only
                        owner.append(k)
                        position.append(at)
            if hashes:
                h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                own = np.asarray(owner)
                rev, tag = (batch.column(c).to_numpy(zero_copy_only=False)[own] for c in ("_rev", "_tag"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[:, 0], h[:, 1], rev, tag, np.asarray(position, np.int64))], list(_ROW))

    return _keyed(docs).select("text", F.expr("~_doc").alias("_rev"), "_tag").mapInArrow(run, _ROWS)


class _Runs:
    """Decides the runs of one sorted range, a batch at a time.

    The range's first run may have begun in the range before, so its rows pass undecided; so do those of a run
    that outgrows PENDING rows, and of the last one.
    """

    def __init__(self, least_docs: int, pending: int) -> None:
        self.least_docs, self.pending = least_docs, pending
        self.held = np.empty((0, 5), np.int64)  # rows of the last run seen
        self.passing: tuple[int, int] | None = None  # the run whose rows pass undecided
        self.begun = False

    @staticmethod
    def _batch(rows: np.ndarray, undecided: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(5)), pa.array(np.full(len(rows), undecided))], [*_ROW, "_open"])

    def feed(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not self.begun:
            self.begun, self.passing = True, tuple(rows[0, :2])
        if self.passing is not None:
            same = (rows[:, 0] == self.passing[0]) & (rows[:, 1] == self.passing[1])
            n = len(rows) if same.all() else int(np.argmin(same))
            if n:
                yield self._batch(rows[:n], True)
            rows = rows[n:]
            if not len(rows):
                return
            self.passing = None
        rows = np.concatenate([self.held, rows])
        new_run = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
        starts = np.flatnonzero(new_run)
        last = int(starts[-1])
        if last:
            done, starts = rows[:last], starts[:-1]
            new_doc = new_run[:last] | np.r_[True, done[1:, 2] != done[:-1, 2]]
            sizes = np.diff(np.r_[starts, last])
            many = np.repeat(np.add.reduceat(new_doc.astype(np.int64), starts) >= self.least_docs, sizes)
            keeper = np.repeat(done[starts, 2], sizes)
            again = np.r_[False, (done[1:] == done[:-1]).all(axis=1)]  # a repeated row of the input
            goes = done[many & (done[:, 2] != keeper) & ~again]
            if len(goes):
                yield self._batch(goes, False)
        self.held = rows[last:].copy()
        if len(self.held) > self.pending:
            self.passing = tuple(self.held[0, :2])
            yield from self.finish()

    def finish(self) -> Iterator[pa.RecordBatch]:
        if len(self.held):
            yield self._batch(self.held, True)
            self.held = self.held[:0]


def lost_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, pending: int = PENDING) -> DataFrame:
    """(_doc, _tag, _pos) of every line that goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(least_docs, pending)
        for batch in batches:
            if batch.num_rows:
                yield from runs.feed(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)], axis=1))
        yield from runs.finish()

    ranged = line_rows(docs).repartitionByRange(*_ROW).sortWithinPartitions(*_ROW)
    found = materialise(ranged.mapInArrow(run, _FOUND), "line-runs").withColumn("_doc", F.expr("~_rev"))
    undecided = found.filter("_open")
    decided = undecided.groupBy("_h1", "_h2").agg(F.count_distinct("_doc").alias("_docs"), F.max("_doc").alias("_keeper"))
    decided = materialise(decided.filter(f"_docs >= {least_docs}").select("_h1", "_h2", "_keeper"), "edge-runs")
    late = undecided.join(decided, ["_h1", "_h2"]).filter("_doc <> _keeper")
    return found.filter("NOT _open").select("_doc", "_tag", "_pos").union(late.select("_doc", "_tag", "_pos"))


def pack(positions: list[int]) -> bytes:
    """A compressed bitmap whose zeros are the given lines; lines past its end are kept."""
    keep = np.ones(-(-(max(positions, default=-1) + 1) // 8) * 8, np.uint8)  # whole bytes
    keep[positions] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which of ``n_lines`` lines are kept."""
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n_lines]
        keep[: len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, least_docs: int = LEAST_DOCS, pending: int = PENDING) -> DataFrame:
    """(_doc, _tag, n_dropped, keep): a bitmap for every document that loses lines, by id and digest of the text.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Keys of LEAST_CHARS
    code points or more that ``least_docs`` documents hold lose their lines in all of them but the one with the
    largest id, which keeps each of its own. Rows with the same id are one document, each text with a bitmap of
    its own. Rows without an id are a document for each text and come before all others, so they keep a line
    only if no document with an id holds it. Null and empty texts are one empty line. Repeated rows change
    nothing; an empty table gives no rows; texts of any length are split whole.
    """
    kind = T.BinaryType()
    bitmap = F.pandas_udf(lambda at: at.map(lambda x: pack(list(x))).astype(object), kind)
    per_document = lost_lines(docs, least_docs, pending).groupBy("_doc", "_tag").agg(F.collect_set("_pos").alias("_at"))
    return per_document.select("_doc", "_tag", F.size("_at").cast("long").alias("n_dropped"), bitmap("_at").alias("keep"))


def without_repeated_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, pending: int = PENDING) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep and kept_text for every row of ``docs``; see ``keep_bitmaps``.

    One plan at every size: texts are shuffled once, to a sort-merge join with the written bitmaps, which adaptive
    execution can split where many rows share an id. A null ``keep`` stands for all lines; other columns of
    ``docs`` are ignored.
    """
    bitmaps = materialise(keep_bitmaps(docs, least_docs, pending), "keep-bitmaps")
    joined = _keyed(docs).join(bitmaps.hint("merge"), ["_doc", "_tag"], "left")

    @F.pandas_udf("kept_text string, n_lines long")
    def cut(text: pd.Series, keep: pd.Series) -> pd.DataFrame:
        rows = []
        for t, bits in zip(text, keep, strict=True):
            if bits is None:
                rows.append((t, t.count("\n") + 1))
            else:
                lines = t.split("\n")
                rows.append(("\n".join(line for line, stays in zip(lines, unpack(bits, len(lines)).tolist(), strict=True) if stays), len(lines)))
        return pd.DataFrame(rows, columns=["kept_text", "n_lines"])

    out = joined.select("doc_id", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep", cut("text", "keep").alias("_cut"))
    return out.select("doc_id", "_cut.n_lines", "n_dropped", "keep", "_cut.kept_text")


def op13_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple[int, int, str]]:
    """(n_lines, n_dropped, kept_sha256) of each (doc_id, text), all ids present: for tests."""
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(_SPACE))
    holders: dict[str, set] = {}
    for i, lines in split:
        for line in lines:
            if len(key(line)) >= LEAST_CHARS:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, lines in split:
        stay = [x for x in lines if len(h := holders.get(key(x), set())) < LEAST_DOCS or i == max(h)]
        out.append((len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


_SQL_SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, md5(coalesce(text, '')) AS tag, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, {_SQL_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (
  SELECT key, count(DISTINCT doc_id) AS docs, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {LEAST_CHARS} GROUP BY key),
judged AS (
  SELECT keyed.*, coalesce(docs >= {LEAST_DOCS} AND doc_id <> keeper, false) AS goes FROM keyed LEFT JOIN held ON keyed.key = held.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM judged GROUP BY doc_id, tag
"""

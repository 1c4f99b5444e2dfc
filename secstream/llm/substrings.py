"""Exact substring de-duplication over difference-cover anchors.

A window of ``window`` consecutive words that also starts earlier (in a document with a smaller id, or earlier in
the same one) is a repeat; every word that a repeat covers is removed.

With a difference cover D modulo v, any two positions i and j have a shift below v that takes both onto the
cover. So two equal windows of L words share an aligned anchor of L - v + 1 words at cover positions. Only
those anchors are hashed: |D|/v of all positions, 4 of 13 here. Anchors that occur once in the corpus end
there. Around the others the windows are extended to full length, and windows with equal content meet; all but
the first are repeats.

What is shuffled: anchor hashes with their place, then full windows near repeated anchors only, each
once per map batch: a batch settles among its own rows which are later copies, so a passage that a third
of all documents share reaches its reducer once from each batch, not once from each occurrence. Hashes travel
packed, one row for a batch and bucket of hashes, and a bucket is settled at a time. The documents are shuffled by id once, and both passes over their text read that exchange.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  for pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secstream.llm.common import blocks, doc_key, raw_bytes, table, window_hashes, word_bounds, word_hashes

WINDOW = 20
PERIOD = 13
#: Anchors or windows that a task gathers before it settles their first places and passes them on.
BATCH = 1 << 19


def difference_cover(period: int) -> list[int]:
    """A small set of residues whose differences give every residue; the smallest up to a period of 31."""
    everything = set(range(period))
    if period <= 31:
        for size in range(1, period + 1):
            for chosen in itertools.combinations(range(1, period), size - 1):
                cover = (0, *chosen)
                if {(a - b) % period for a in cover for b in cover} == everything:
                    return list(cover)
    root = int(period**0.5) + 1
    return sorted({*range(min(root, period)), *range(0, period, root)})


def _first_places(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, sorted by ``keys`` and then ``order``, and where in that sequence a new key starts."""
    rows = np.lexsort([*reversed(order), *reversed(keys)])
    new = np.ones(len(rows), bool)
    new[1:] = np.logical_or.reduce([k[rows][1:] != k[rows][:-1] for k in keys])
    return rows, new


def _place(at: np.ndarray, tag: int) -> np.ndarray:
    """Word position and a tag of the text in one long; the tag tells apart different texts under one id."""
    return at.astype(np.int64) << 16 | tag


def _by_key(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Places in one binary for each document."""
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.concatenate([[0], cuts])] if len(keys) else keys, [p.tobytes() for p in np.split(places, cuts)] if len(keys) else []


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length as one binary, byte plane by byte plane: high bytes are alike and compress well."""
    return b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


def _unpack(data: bytes, kinds: tuple[type, ...]) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(data) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * size
    return out


_ROW = "_bucket int, _data binary, _key long, _settled binary"


def _rows(buckets: np.ndarray, columns: list[np.ndarray], own: np.ndarray, settled: list[bytes], spread: int) -> pa.RecordBatch:
    """A packed row for each bucket of what other batches must see, and one for each document with settled
    places; the latter go anywhere."""
    order = np.argsort(buckets, kind="stable")
    buckets, columns = buckets[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    ends = [0, *cuts.tolist(), len(buckets)] if len(buckets) else [0]
    data = [_pack([c[lo:hi] for c in columns]) for lo, hi in zip(ends, ends[1:], strict=False)]
    n, m = len(data), len(own)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([buckets[ends[:-1]], own % spread]).astype(np.int32)),
            pa.array(data + [None] * m, pa.binary()),
            pa.array([None] * n + own.tolist(), pa.int64()),
            pa.array([None] * n + settled, pa.binary()),
        ],
        ["_bucket", "_data", "_key", "_settled"],
    )


def _settle(found: DataFrame, kinds: tuple[type, ...], judge: Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(_key, _settled): shuffle packed rows by bucket and let ``judge`` name the keys and places of a bucket's
    rows that are to be kept. A bucket is a small part of a partition; one is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "_settled"]

        def close(parts: list[bytes]) -> pa.RecordBatch:
            own, places = _by_key(*judge([np.concatenate(c) for c in zip(*(_unpack(x, kinds) for x in parts), strict=True)]))
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(places, pa.binary())], names)

        now, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            known = batch.filter(pa.compute.is_valid(batch.column("_settled")))
            yield pa.RecordBatch.from_arrays([known.column("_key"), known.column("_settled")], names)
            rest = batch.filter(pa.compute.is_valid(batch.column("_data")))
            for bucket, data in zip(rest.column("_bucket").to_pylist(), rest.column("_data").to_pylist(), strict=True):
                if bucket != now and parts:
                    yield close(parts)
                    parts = []
                now = bucket
                parts.append(data)
        if parts:
            yield close(parts)

    dealt = found.repartition("_bucket").sortWithinPartitions("_bucket")
    return dealt.mapInArrow(run, "_key long, _settled binary").groupBy("_key").agg(F.collect_list("_settled").alias("_settled"))


def _bucket_count(spark: SparkSession) -> int:
    """Buckets of hashes: several for each shuffle partition, whose number follows the data."""
    return max(1024, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h.view(np.uint64) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def repeated_anchors(docs: DataFrame, window: int, period: int) -> DataFrame:
    """(_key, _settled): packed word positions of anchors that occur more than once, from (_key, text)."""
    cover, size, spread = np.array(difference_cover(period)), window - period + 1, _bucket_count(docs.sparkSession)

    def settled(hashes: list, keys: list, ats: list) -> pa.RecordBatch:
        h, k, at = np.concatenate(hashes).view(np.int64), np.concatenate(keys), np.concatenate(ats).astype(np.int32)
        rows, new = _first_places([h], [])
        run = np.cumsum(new) - 1
        often = np.bincount(run)[run] > 1
        # repeats within the batch are settled; one row of them, without a place, tells other batches
        send = rows[~often | new]
        place = np.where(often[~often | new], -1, at[send]).astype(np.int32)
        own, packed = _by_key(k[rows[often]], at[rows[often]])
        return _rows(_bucket_of(h[send], spread), [h[send], k[send], place], own, packed, spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys, ats, held = [], [], [], 0
        for batch in blocks(batches):
            for key, text in zip(batch.column("_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = raw_bytes(text)
                words = word_hashes(raw, *word_bounds(raw))
                if len(words) < window:
                    continue
                whole = window_hashes(words, size)
                at = (np.arange(0, len(whole), period)[:, None] + cover).ravel()
                at = at[at < len(whole)]
                hashes.append(whole[at])
                keys.append(np.full(len(at), key))
                ats.append(at)
                held += len(at)
                if held >= BATCH:
                    yield settled(hashes, keys, ats)
                    hashes, keys, ats, held = [], [], [], 0
        if held:
            yield settled(hashes, keys, ats)

    def judge(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, k, at = columns
        rows, new = _first_places([h], [])
        run = np.cumsum(new) - 1
        shared = rows[(np.bincount(run)[run] > 1) & (at[rows] >= 0)]
        return k[shared], at[shared]

    return _settle(docs.select("_key", "text").mapInArrow(run, _ROW), (np.int64, np.int64, np.int32), judge)


def _later(keys: np.ndarray, places: np.ndarray, rows: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Of rows sorted by window, key and place: whether a row starts after the first of its window."""
    first = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return (keys[rows] > keys[first]) | (keys[rows] == keys[first]) & (places[rows] >> 16 > places[first] >> 16)


def repeated_windows(near: DataFrame, window: int, period: int) -> DataFrame:
    """(_key, _settled): packed places of the windows that are repeats, from (_key, _tag, text, _settled)."""
    spread = _bucket_count(near.sparkSession)

    def settled(h1: list, h2: list, keys: list, places: list) -> pa.RecordBatch:
        a, b = np.concatenate(h1).view(np.int64), (np.concatenate(h2) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        k, p = np.concatenate(keys), np.concatenate(places)
        rows, new = _first_places([a, b], [k, p])
        later = _later(k, p, rows, new)
        send, known = rows[~later], rows[later]
        own, packed = _by_key(k[known], p[known])
        return _rows(_bucket_of(a[send], spread), [a[send], b[send], k[send], p[send]], own, packed, spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h1, h2, keys, places, held = [], [], [], [], 0
        for batch in blocks(batches):
            for key, tag, text, anchors in zip(*(batch.column(c).to_pylist() for c in ("_key", "_tag", "text", "_settled")), strict=True):
                raw = raw_bytes(text)
                starts, ends = word_bounds(raw)
                n = len(starts) - window + 1
                if n <= 0:
                    continue
                # a repeated window holds one of the repeated anchors within its first ``period`` positions
                hit = np.zeros(len(starts) + period + 1, np.int32)
                for at in (np.frombuffer(x, np.int32) for x in anchors):
                    hit[at[at < len(hit)]] = 1  # another text under this id may be longer
                before = np.concatenate([[0], np.cumsum(hit)])
                at = np.flatnonzero(before[period : period + n] - before[:n])
                if not len(at):
                    continue
                h1.append(window_hashes(word_hashes(raw, starts, ends), window)[at])
                h2.append(window_hashes(word_hashes(raw, starts, ends, 1), window, 1)[at])
                keys.append(np.full(len(at), key))
                places.append(_place(at, tag))
                held += len(at)
                if held >= BATCH:
                    yield settled(h1, h2, keys, places)
                    h1, h2, keys, places, held = [], [], [], [], 0
        if held:
            yield settled(h1, h2, keys, places)

    def judge(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        a, b, k, p = columns
        rows, new = _first_places([a, b], [k, p])
        again = rows[_later(k, p, rows, new)]
        return k[again], p[again]

    return _settle(near.mapInArrow(run, _ROW), (np.int64, np.int32, np.int64, np.int64), judge)


def kept_text(text: str | None, places: list[bytes] | None, tag: int, window: int) -> tuple[int, int, str]:
    """Word count, removed words and the kept words with one space between them."""
    raw = raw_bytes(text)
    starts, ends = word_bounds(raw)
    gone = np.zeros(len(starts) + 1, np.int64)
    if places:
        p = np.concatenate([np.frombuffer(x, np.int64) for x in places])
        at = np.unique(p[(p & 0xFFFF) == tag] >> 16)
        np.add.at(gone, at, 1)
        np.add.at(gone, np.minimum(at + window, len(starts)), -1)
    keep = np.cumsum(gone[:-1]) == 0
    data = raw.tobytes()
    words = [data[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]
    return len(starts), int(len(starts) - keep.sum()), b" ".join(words).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words) for every row of ``docs`` (doc_id, text).

    Null and empty texts have no words. Ids lie below 2^62. Rows without an id come after all others, by their text. Rows that
    are repeated with their id count as one document: their windows are not earlier than each other's.
    Different texts under one id are told apart. Other columns are ignored.
    """
    if not 1 < period <= window:
        raise ValueError("the period must lie between 2 and the window")
    text = F.col("text").cast("string")
    # both joins take the same two columns, so that the texts are shuffled once
    keyed = docs.select(doc_key(F.col("doc_id"), text).alias("_key"), text.alias("text"))
    tag = F.xxhash64("text").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("_tag")
    near = keyed.join(repeated_anchors(keyed, window, period), "_key").select("_key", tag, "text", "_settled")
    joined = keyed.join(repeated_windows(near, window, period), "_key", "left").select("_key", tag, "text", "_settled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            columns = (batch.column(c).to_pylist() for c in ("text", "_settled", "_tag"))
            done = [kept_text(t, p, tag, window) for t, p, tag in zip(*columns, strict=True)]
            n, gone, kept = zip(*done, strict=True)
            ids = [k if k < 1 << 62 else None for k in batch.column("_key").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op4_substring_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p+{WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS p FROM d)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM again, (SELECT unnest(generate_series(0, {WINDOW - 1})) AS k)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN kept k USING (doc_id)"""

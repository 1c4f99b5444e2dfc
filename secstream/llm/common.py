"""What the corpus operators share: table access, document keys, word bounds and hashes inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  for pa.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step handles; bounds the temporary arrays.
BLOCK = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(doc_id: Column, text: Column) -> Column:
    """A never-null long that orders documents: the id itself, or, for rows without one, a value above
    2^62 drawn from the text. Such rows come after all others, equal texts share a key."""
    return F.coalesce(doc_id.cast("long"), F.lit(1 << 62) + F.xxhash64(text).bitwiseAND(F.lit((1 << 61) - 1)))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as _row, so that helper columns cannot clash with the input's."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about BLOCK bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // BLOCK
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)


def raw_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of a UTF-8 text start and end."""
    edge = np.zeros(len(raw) + 2, np.int8)
    np.logical_not(_IS_SPACE[raw], out=edge[1:-1].view(bool))
    at = np.flatnonzero(np.diff(edge))
    return at[::2], at[1::2]


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        factors = np.full(max(n, 4096), base, np.uint64)
        factors[0] = 1
        _powers[base] = np.multiply.accumulate(factors)
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


#: Two odd multipliers give two independent word hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Words of more bytes are hashed by XXH64.
LONG_WORD = 64


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every word, in vectorised steps of about BLOCK bytes."""
    out, sizes = np.empty(len(starts), np.uint64), ends - starts
    if not len(starts):
        return out
    part = np.cumsum(sizes) // BLOCK
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(starts)], strict=True):
        n = sizes[lo:hi]
        first = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(first, n)
        values = raw[within + np.repeat(starts[lo:hi], n)].astype(np.uint64) + np.uint64(1)
        values *= _power(BASES[which], int(n.max()))[within]
        out[lo:hi] = np.add.reduceat(values, first) + n.astype(np.uint64)
    out = mix(out)
    # sums modulo 2^64 meet for made-up words of a thousand bytes: long words take a hash that does not
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[k] = xxhash.xxh64_intdigest(raw[starts[k] : ends[k]].tobytes(), which)
    return out


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words, from the words' hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(BASES[1 - which])
        out += words[k : k + n]
    return mix(out)

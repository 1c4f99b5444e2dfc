"""Near duplicates by SimHash, with the generalised pigeonhole principle over unequal bit partitions.

Fingerprints within ``radius`` bits of each other are linked; a document's component is all it reaches.

* Copies first: documents with equal fingerprints are one node, found by a map-side aggregate, so that a group
  of copies, however large, never meets in one task.
* Bits that are correlated go to the same part, so that the parts fail independently.
* A part i with threshold t_i holds at least one pair witness if sum(t_i + 1) = radius + 1. The number of
  parts and the thresholds are chosen by dynamic programming over the costs: signatures to write and candidate
  pairs to look at, both estimated from a bounded sample of fingerprints. They change the cost only, never
  the result.
* Each fingerprint is indexed once per part and probes with all values within t_i bits of its own; matches are
  verified by their distance inside the join.
* A bucket with more than MOST_IN_BUCKET fingerprints is not paired. Its members write all values within
  radius/2 bits of their own instead; two of them share such a value exactly if they are within the radius,
  so linking every member to the smallest at each shared value connects the same components without pairs.
* The pipeline's stage asks for five-word shingles and a similarity of 0.8. Minima over the shingle sets find the
  candidates, 256 SimHash bits with a wide margin thin them out, and the exact shingle sets decide. Buckets are
  worked through centre by centre, so that a group of near copies costs its size times a few rounds; members that
  the rounds leave apart are then compared by their differences from one centre, in which only similar ones meet.
* Components come from alternating large-star and small-star steps over written tables.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secstream.llm.common import doc_key, mix, packed, raw_bytes, table, unpacked, window_hashes, word_bounds, word_hashes
from secstream.session import materialise

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints that the partition is planned on, at most; those with the smallest hash.
SAMPLE = 1_000
#: Fingerprints of one part value that are paired; larger buckets go by shared neighbours.
MOST_IN_BUCKET = 2_000
#: What a written signature costs, in looks at a candidate pair.
SIGNATURE_COST = 15.0
#: Shingle hashes whose bits are unpacked at once.
_AT_ONCE = 1 << 15

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text, as a signed long; 0 without words.

    A bit is set if it is set in more than half of the shingles' XXH64 values, repeats counted.
    """
    raw = _LOWER[raw_bytes(text)]
    starts, ends = word_bounds(raw)
    n = len(starts)
    if not n:
        return 0
    # the words with one space between them
    sizes = ends - starts
    to = np.cumsum(sizes + 1) - sizes - 1
    if n > 1 and not (len(raw) == to[-1] + sizes[-1] and (starts == to).all() and (raw[ends[:-1]] == 32).all()):
        joined = np.full(int(to[-1] + sizes[-1]), 32, np.uint8)
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        joined[within + np.repeat(to, sizes)] = raw[within + np.repeat(starts, sizes)]
        data = joined.tobytes()
    else:
        data, to = raw.tobytes(), starts
    k = min(shingle, n)
    first, last = to[: n - k + 1].tolist(), (to[k - 1 :] + sizes[k - 1 :]).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(first), _AT_ONCE):
        h = np.fromiter((digest(data[a:b], SEED) for a, b in zip(first[lo : lo + _AT_ONCE], last[lo : lo + _AT_ONCE])), np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in range(63) if 2 * ones[b] > len(first)) - ((1 << 63) if 2 * ones[63] > len(first) else 0)


def _fingerprints(text: pd.Series) -> pd.Series:
    return text.map(fingerprint)


def simhash(text: str) -> Column:
    return F.pandas_udf(_fingerprints, T.LongType())(text)


# --- planning: which bits go together, and each part's threshold


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """64 bit numbers in ``parts`` groups of nearly equal size; a group takes the bit most correlated with it."""
    centred = bits - bits.mean(axis=0)
    norm = np.sqrt((centred**2).sum(axis=0)) + 1e-9
    tie = np.abs(centred.T @ centred) / norm[:, None] / norm[None, :]
    np.fill_diagonal(tie, 0)
    left, groups = set(range(64)), []
    for k in range(parts):
        size = (64 * (k + 1)) // parts - (64 * k) // parts
        group = [max(sorted(left), key=lambda b: tie[b, sorted(left)].max())]
        left -= set(group)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: tie[b, group].sum())
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def close_shares(bits: np.ndarray, group: list[int], radius: int) -> list[float]:
    """For t = 0..radius the share of pairs within t bits on a group, from pairs of the sample.

    Never less than for independent even bits, as a sample cannot see rare meetings.
    """
    x = bits[:, group].astype(np.float32)
    d = np.rint(x @ (1 - x).T + (1 - x) @ x.T).astype(np.int64)
    n = np.bincount(d[np.triu_indices(len(x), 1)], minlength=len(group) + 1).astype(float)
    seen = np.cumsum(n) / max(1.0, n.sum())
    even = np.cumsum([math.comb(len(group), k) / 2.0 ** len(group) for k in range(len(group) + 1)])
    return [float(max(seen[min(t, len(group))], even[min(t, len(group))])) for t in range(radius + 1)]


def thresholds(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = radius + 1 of the least total cost; costs[i][t], -1 is free."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t in range(-1, radius - used + 1):
                now = total + (cost[t] if t >= 0 else 0.0)
                if used + t + 1 not in following or now < following[used + t + 1][0]:
                    following[used + t + 1] = (now, [*chosen, t])
        best = following
    return best[radius + 1]


def plan_parts(sample: list[int], n: int, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to use, for ``n`` distinct fingerprints."""
    u = np.array(sample or [0], np.int64).astype("<i8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(u, axis=1, bitorder="little")
    plans, n = [], max(n, 1)
    for parts in range(2, radius + 2):
        groups = group_bits(bits.astype(float), parts)
        costs = []
        for g in groups:
            shares = close_shares(bits, g, radius)
            signatures = np.cumsum([math.comb(len(g), k) for k in range(radius + 1)])
            costs.append([SIGNATURE_COST * n * (1 + float(s)) + shares[t] * n * n for t, s in enumerate(signatures)])
        total, chosen = thresholds(costs, radius)
        plans.append((total, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


# --- links


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _masks(bits: list[int], most: int) -> Iterator[int]:
    for k in range(most + 1):
        for chosen in itertools.combinations(bits, k):
            yield _signed(sum(1 << b for b in chosen))


def _long_array(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _signatures(nodes: DataFrame, parts: list[tuple[list[int], int]], probe: bool) -> DataFrame:
    """_part, _value and the columns of ``nodes``: a row per part, for probes one for every value within the
    part's threshold."""
    all_parts, own_columns = None, nodes.columns
    for k, (bits, t) in enumerate(parts):
        own = F.col("_fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
        rows = nodes.select(*own_columns, own.alias("_value"))
        if probe and t:
            rows = rows.select("*", F.explode(_long_array(list(_masks(bits, t)))).alias("_mask")).withColumn("_value", F.col("_value").bitwiseXOR(F.col("_mask")))
        rows = rows.select(F.lit(k).alias("_part"), "_value", *own_columns)
        all_parts = rows if all_parts is None else all_parts.union(rows)
    return all_parts


def _links_by_neighbours(members: DataFrame, radius: int) -> DataFrame:
    """Links that connect all ``members`` (_fp) within the radius, each to the smallest at a shared value.

    For an odd radius the halves differ: values within half of it, rounded down, meet values within the rest.
    """
    near, far = radius // 2, radius - radius // 2
    masks = _long_array(list(_masks(list(range(64)), near)))
    at = members.select("_fp", F.explode(masks).alias("_mask")).select("_fp", F.col("_fp").bitwiseXOR(F.col("_mask")).alias("_value"))
    if near == far:
        least = at.groupBy("_value").agg(F.min("_fp").alias("_least"))
        return at.join(least, "_value").filter("_fp <> _least").select(F.col("_fp").alias("_u"), F.col("_least").alias("_v")).distinct()
    wide = _long_array(list(_masks(list(range(64)), far)))
    probes = members.select("_fp", F.explode(wide).alias("_mask")).select("_fp", F.col("_fp").bitwiseXOR(F.col("_mask")).alias("_value"))
    centre = at.groupBy("_value").agg(F.min("_fp").alias("_least"))
    return probes.join(centre, "_value").filter(F.expr(f"_fp <> _least AND bit_count(_fp ^ _least) <= {radius}")).select(F.col("_fp").alias("_u"), F.col("_least").alias("_v")).distinct()


def links(nodes: DataFrame, n: int, radius: int = RADIUS, most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """(_u, _v): links between distinct fingerprints that connect exactly those within the radius."""
    sample = [r._fp for r in nodes.orderBy(F.xxhash64("_fp"), "_fp").limit(SAMPLE).collect()]
    parts = plan_parts(sample, n, radius)
    index, probe = _signatures(nodes, parts, False), _signatures(nodes, parts, True)
    hot = materialise(index.groupBy("_part", "_value").count().filter(F.col("count") > most_in_bucket).select("_part", "_value"), "hot-buckets")
    any_hot = hot.limit(1).count() > 0
    cold = index.join(hot, ["_part", "_value"], "left_anti") if any_hot else index
    a, b = probe.alias("a"), cold.alias("b")
    pairs = a.join(b, F.expr(f"a._part = b._part AND a._value = b._value AND a._fp <> b._fp AND bit_count(a._fp ^ b._fp) <= {radius}"))
    pairs = pairs.select(F.greatest("a._fp", "b._fp").alias("_u"), F.least("a._fp", "b._fp").alias("_v"))
    if any_hot:
        members = probe.join(hot, ["_part", "_value"], "left_semi").select("_fp").distinct()
        pairs = pairs.union(_links_by_neighbours(materialise(members, "hot-members"), radius))
    return pairs.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(_node, _root): every linked node's smallest reachable node, by alternating star steps."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("_v").alias("_u"), F.col("_u").alias("_v"))) if large else e
        least = both.groupBy("_u").agg(F.min("_v").alias("_m"))
        rows = both.join(least, "_u").select("_u", "_v", F.least("_u", "_m").alias("_m"))
        if large:
            moved = rows.filter("_v > _u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
        else:
            moved = rows.select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).union(rows.select("_u", F.col("_m").alias("_v")))
        return moved.filter("_u <> _v").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("_u", "_v").cast("decimal(20,0)"))).first()

    edges = materialise(edges.select(F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v")).filter("_u <> _v").distinct(), "links")
    before = mark(edges)
    while before[0]:
        edges = materialise(star(star(edges, True), False), "stars")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("_u").alias("_node"), F.col("_v").alias("_root"))


def roots(prints: DataFrame, radius: int = RADIUS, most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """(_fp, _first): for every fingerprint of ``prints`` (_key, _fp) the smallest key of its component."""
    nodes = materialise(prints.groupBy("_fp").agg(F.min("_key").alias("_key")), "fingerprints")
    found = components(links(nodes.select("_fp"), nodes.count(), radius, most_in_bucket))
    placed = nodes.join(found, F.col("_fp") == F.col("_node"), "left").select("_fp", "_key", F.coalesce("_root", "_fp").alias("_root"))
    first = placed.groupBy("_root").agg(F.min("_key").alias("_first"))
    return placed.join(first, "_root").select("_fp", "_first")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs`` (doc_id, text).

    Texts without words, null and empty ones among them, have fingerprint 0 and are linked like any other.
    Rows with a null id belong to the component of their fingerprint; a component of such rows only has a
    null component_id. Repeated rows each give their own row; other columns are ignored.
    """
    prints = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key(F.col("doc_id"), F.col("text")).alias("_key"), simhash("text").alias("_fp")), "prints")
    out = prints.join(roots(prints.select("_key", "_fp"), radius, most_in_bucket), "_fp")
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("_first") < 1 << 62, F.col("_first")).alias("component_id"),
    )


# --- the pipeline's stage: five words, a similarity of 0.8


#: Words of a shingle and the share of shingles in common that make two texts near duplicates.
WORDS, SIMILARITY = 5, 0.8
#: Candidates share one of BANDS values, each made of ROWS minima over the shingle set; at SIMILARITY all BANDS
#: miss in (1 - 0.8 ** 8) ** 64 = 8e-6 of the pairs, whatever the shape of the edit.
BANDS, ROWS = 64, 8
#: Shingles in which two similar texts differ at most, as a share of the sum of their numbers of shingles.
FAR = (1 - SIMILARITY) / (1 + SIMILARITY)
#: 256 SimHash bits of the shingle set, four longs, and the standard deviations above the mean at SIMILARITY up
#: to which they let a candidate pass. Shingle sets decide.
_WIDE, DEVIATIONS = 4, 6
_WIDE_NAMES = [f"_w{k}" for k in range(_WIDE)]
#: Members of a bucket that are compared in full; larger buckets go by centres.
SMALL = 8
#: Pairs of a member that are verified in each of the first two rounds, those that share most buckets; all later.
TRIES = 2
#: Rounds of centres at most. Every round after the first two connects a few members in a thousand, each at the
#: cost of all its shuffles; pairs that ROUNDS rounds have not decided are left to ``_apart``.
ROUNDS = 4
_FACTORS = np.random.default_rng(SEED + 1).integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
#: Shingles whose products with all factors are held at once.
_ROWS_AT_ONCE = 128


def most_bits() -> int:
    """Bits of the wide fingerprint in which candidates differ at most: the expected share at SIMILARITY, from
    the angle between the shingle vectors, and DEVIATIONS standard deviations."""
    share = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
    bits = 64 * _WIDE
    return int(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share)))


#: The other side's wide bits, and whether a pair passes them.
_OTHER_WIDE = [f"{w} AS _c{w}" for w in _WIDE_NAMES]
_NEAR = " + ".join(f"bit_count({w} ^ _c{w})" for w in _WIDE_NAMES) + f" <= {most_bits()}"


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _AT_ONCE):
        part = hashes[lo : lo + _AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return _signed(sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes))))


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the distinct five-word shingles, lower case, in order; of a shorter text the whole is one."""
    raw = _LOWER[raw_bytes(text)]
    words = word_hashes(raw, *word_bounds(raw))
    return np.unique(window_hashes(words, min(WORDS, len(words)))) if len(words) else np.empty(0, np.uint64)


def band_values(shingles: np.ndarray) -> np.ndarray:
    """BANDS values; two sets share each with a probability of their similarity to the power of ROWS."""
    if not len(shingles):
        return np.empty(0, np.int64)
    short, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(short), _ROWS_AT_ONCE):
        np.minimum(least, (short[lo : lo + _ROWS_AT_ONCE, None] * _FACTORS).min(axis=0), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out + least[k::ROWS])
    return out.view(np.int64)


def _digest(shingles: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)) if len(shingles) else 0


def _set_prints(text: pd.Series) -> pd.DataFrame:
    """Digest of the shingle set, the wide bits and the band values; a digest of 0 without words."""
    rows = []
    for x in text:
        s = shingle_set(x)
        rows.append((_digest(s), *(_majority(mix(s + np.uint64(k + 1))) for k in range(_WIDE)), band_values(s)))
    return pd.DataFrame(rows, columns=["_d", *_WIDE_NAMES, "_bands"])


def _sets(text: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(x) for x in text]
    return pd.DataFrame({"_d": [_digest(s) for s in sets], "_s": [s.view(np.int64) for s in sets]})


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (_u, _v) of digests whose shingle sets, in ``sets`` (_d, _s), have SIMILARITY or more in common."""
    size = F.size("_s")
    both = pairs.join(sets.select(F.col("_d").alias("_u"), F.col("_s").alias("_a"), size.alias("_na")), "_u")
    both = both.join(sets.select(F.col("_d").alias("_v"), F.col("_s").alias("_b"), size.alias("_nb")), "_v")
    both = both.filter(F.least("_na", "_nb") >= SIMILARITY * F.greatest("_na", "_nb"))
    both = both.withColumn("_both", F.size(F.array_intersect("_a", "_b")))  # row by row: sets of long texts are large
    return both.filter(F.col("_both") >= SIMILARITY * (F.col("_na") + F.col("_nb") - F.col("_both"))).select("_u", "_v")


def _candidates(placed: DataFrame, number: int) -> DataFrame:
    """(_d, _c): pairs of one bucket and different labels to look at, from ``placed`` (_value, _d, _label, _links).

    Members of buckets of SMALL or fewer meet each other, those of larger ones meet one centre: in even rounds the
    first in a random order that all buckets share, in odd ones the one with most links so far.
    """
    ahead = F.struct(F.lit(0) if number % 2 == 0 else F.col("_links"), F.xxhash64("_d", F.lit(number)))
    bucket = placed.groupBy("_value").agg(F.count("*").alias("_n"), F.min("_label").alias("_low"), F.max("_label").alias("_high"), F.max_by(F.struct(F.col("_d").alias("_c"), F.col("_label").alias("_clabel")), ahead).alias("_centre"))
    bucket = materialise(bucket.filter("_low < _high").select("_value", "_n", "_centre.*"), "buckets")
    rows = placed.join(bucket, "_value")
    met = rows.filter(f"_n > {SMALL} AND _label <> _clabel").select("_d", "_c")
    rows = rows.filter(f"_n <= {SMALL}")
    a, b = rows.select("_value", "_d", "_label"), rows.select("_value", F.col("_d").alias("_c"), F.col("_label").alias("_clabel"))
    return met.union(a.join(b, "_value").filter("_d > _c AND _label <> _clabel").select("_d", "_c"))


def _all_pairs(placed: DataFrame, prints: DataFrame) -> DataFrame:
    """(_u, _v): all pairs of one bucket whose wide bits pass, at the cost of the square of a bucket."""
    rows = materialise(placed.join(prints, "_d").select("_value", "_d", *_WIDE_NAMES), "rest-bands")
    a = rows.select("_value", F.col("_d").alias("_u"), *_WIDE_NAMES)
    b = rows.selectExpr("_value", "_d AS _v", *_OTHER_WIDE)
    return a.join(b, (a["_value"] == b["_value"]) & F.expr(f"_u > _v AND {_NEAR}")).select("_u", "_v").distinct()


def _apart(placed: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """What decides all pairs of one bucket and different labels: links to centres, which are exact, and candidates
    (_u, _v); None without such pairs.

    A bucket goes to the label of its member with most links, and on to the first label of that one's buckets, so that
    buckets of the same copies are few groups; a group's centre c is its member with most links. With D = the shingles
    that are in either x or c, not in both, x and y are similar exactly if D(x) and D(y) differ in at most FAR of
    |x| + |y| shingles, so they have (|D(x)| + |D(y)| - FAR (|x| + |y|)) / 2 in common, and the first one they have in
    common, rarest first, is that far from the end of both. Copies of one text that were edited each in its own way
    differ from it in rare shingles, so they do not meet. Where that number is not above 0, x and y are both similar
    to c.
    """
    ahead = F.struct("_links", F.xxhash64("_label"), "_label")
    bucket = placed.groupBy("_value").agg(F.min("_label").alias("_low"), F.max("_label").alias("_high"), F.max(ahead).alias("_first"))
    rows = materialise(placed.join(bucket.filter("_low < _high").select("_value", "_first"), "_value").select("_d", "_label", "_links", "_first").distinct(), "rest-bands")
    if rows.limit(1).count() == 0:
        return None
    best = rows.groupBy(F.col("_label").alias("_of")).agg(F.max("_first")["_label"].alias("_g"))
    members = rows.join(best, rows["_first"]["_label"] == best["_of"]).select("_g", "_d", "_label", "_links").distinct()
    centre = members.groupBy("_g").agg(F.max_by("_d", F.struct("_links", F.xxhash64("_d"))).alias("_d"))
    centre = centre.join(sets, "_d").select("_g", F.col("_d").alias("_c"), F.col("_s").alias("_cs"))
    both = members.join(sets, "_d").join(centre, "_g")
    differ = F.concat(F.array_except("_s", "_cs"), F.array_except("_cs", "_s"))
    both = both.select("_g", "_d", "_label", "_c", F.size("_s").alias("_n"), F.size("_cs").alias("_cn"), differ.alias("_diff"))
    both = materialise(both.withColumn("_m", F.size("_diff")), "differences")
    common = (F.col("_n") + F.col("_cn") - F.col("_m")) / 2
    near = both.filter(F.col("_d") != F.col("_c")).filter(common >= SIMILARITY * (F.col("_n") + F.col("_cn") - common))

    each = both.select("_g", "_d", "_label", "_n", "_m", F.explode("_diff").alias("_e"))
    met = each.groupBy("_g", "_e").agg(F.count("*").alias("_times")).filter("_times > 1")
    ranked = each.join(met, ["_g", "_e"]).groupBy("_g", "_d", "_label", "_n", "_m")
    ranked = ranked.agg(F.sort_array(F.collect_list(F.struct("_times", "_e"))).alias("_shared"))
    # shingles that no other member has come first; what lies beyond the most that a partner can leave is not needed
    ranked = ranked.withColumn("_own", F.col("_m") - F.size("_shared"))
    most = F.floor(F.col("_n") * ((1 - SIMILARITY) / SIMILARITY) + 1e-6).cast("int") + 1 - F.col("_own")
    at = ranked.select("_g", "_d", "_label", "_n", "_m", "_own", F.posexplode(F.slice("_shared", F.lit(1), F.greatest(most, F.lit(0)))).alias("_p", "_x"))
    at = materialise(at.select("_g", "_x._e", "_d", "_label", "_n", "_m", (F.col("_own") + F.col("_p")).alias("_p")), "rest-shingles")
    a = at.withColumnRenamed("_d", "_u")
    b = at.selectExpr("_g", "_e", "_d AS _v", "_label AS _vlabel", "_n AS _vn", "_m AS _vm", "_p AS _vp")
    slack = f"(_n + _vn) * {FAR} + 1e-6"
    meet = F.expr(f"_u > _v AND _label <> _vlabel AND 2 * _p <= _m - _vm + {slack} AND 2 * _vp <= _vm - _m + {slack}")
    pairs = a.join(b, (a["_g"] == b["_g"]) & (a["_e"] == b["_e"]) & meet).select("_u", "_v").distinct()
    return near.select(F.greatest("_d", "_c").alias("_u"), F.least("_d", "_c").alias("_v")), pairs


def _relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after two steps along the links, which is all of a star, and how many links each node has."""
    edges = materialise(found.select("_u", "_v").union(found.select(F.col("_v").alias("_u"), F.col("_u").alias("_v"))), "label-edges")
    for _ in range(2):
        near = edges.join(labels.select(F.col("_d").alias("_v"), "_label"), "_v").groupBy("_u").agg(F.min("_label").alias("_m"), F.count("*").alias("_n"))
        labels = labels.join(near, F.col("_d") == F.col("_u"), "left").select("_d", F.least("_label", "_m").alias("_label"), F.coalesce("_n", F.lit(0)).alias("_links"))
    return materialise(labels, "labels")


def similar_links(nodes: DataFrame, texts: DataFrame, exact: bool = False) -> DataFrame:
    """(_u, _v): links that connect similar ``nodes`` (_d, _key, the wide bits, _bands); ``texts`` (_key, text).

    Members of a large bucket are not paired with each other. In every round a member meets the centres of its
    buckets, and of these the TRIES that it shares most buckets with are verified by their shingle sets. What is
    connected gets one label and is not compared again. The centre with most links matters where copies are
    edited each in its own way: the text that they derive from is similar to all of them, two copies may not be
    similar to each other. There are ROUNDS rounds, fewer if one connects nothing; each writes rows in proportion to
    the members. What then is left, all pairs of a bucket that have different labels and were not tried, is decided
    exactly by their differences from a centre (``_apart``), so no candidate is lost and members that are similar to
    nothing do not meet. ``exact`` leaves out both: all members of every bucket are paired, at the cost of the square
    of a bucket.
    """
    rows = nodes.select("_d", F.explode("_bands").alias("_value"))
    met = rows.groupBy("_value").agg(F.count("*").alias("_n")).filter("_n > 1").select("_value")
    shared = materialise(rows.join(met, "_value").select("_value", "_d"), "shared-bands")
    keys = nodes.select("_d", "_key").join(shared.select("_d").distinct(), "_d").select("_key").distinct()
    kind = T.StructType([T.StructField("_d", T.LongType()), T.StructField("_s", T.ArrayType(T.LongType()))])
    sets = texts.join(keys, "_key", "left_semi").select(F.pandas_udf(_sets, kind)("text").alias("_f")).select("_f.*")
    sets = materialise(sets.groupBy("_d").agg(F.first("_s").alias("_s")), "shingle-sets")

    prints = sets.select("_d").join(nodes.select("_d", *_WIDE_NAMES), "_d")
    labels = sets.select("_d", F.col("_d").alias("_label"), F.lit(0).cast("long").alias("_links"))
    placed = shared.select("*", F.col("_d").alias("_label"), F.lit(0).cast("long").alias("_links"))
    tried, found, number = None, None, 0
    while not exact and number < ROUNDS:
        pairs = _candidates(placed, number).groupBy("_d", "_c").agg(F.count("*").alias("_n"))
        if tried is not None:
            pairs = pairs.join(tried, F.expr("greatest(_d, _c) = _u AND least(_d, _c) = _v"), "left_anti")
        if number < 2:
            first = Window.partitionBy("_d").orderBy(F.desc("_n"), F.xxhash64("_c"))
            pairs = pairs.withColumn("_rank", F.row_number().over(first)).filter(f"_rank <= {TRIES}")
        pairs = materialise(pairs.select(F.greatest("_d", "_c").alias("_u"), F.least("_d", "_c").alias("_v")).distinct(), "tries")
        near = pairs.join(prints.select(F.col("_d").alias("_u"), *_WIDE_NAMES), "_u").join(prints.selectExpr("_d AS _v", *_OTHER_WIDE), "_v")
        links_now = materialise(similar(near.filter(_NEAR).select("_u", "_v"), sets), "links-now")
        found = links_now if found is None else found.union(links_now)
        tried = pairs if tried is None else tried.union(pairs)
        number += 1
        if links_now.limit(1).count() == 0:
            break
        labels = _relabelled(labels, found)
        placed = materialise(shared.join(labels, "_d"), "placed-bands")
    if exact:
        return similar(materialise(_all_pairs(placed, prints), "rest-tries"), sets)
    if number > 2:  # the third round tries all pairs of buckets of SMALL or fewer
        large = shared.groupBy("_value").agg(F.count("*").alias("_n")).filter(f"_n > {SMALL}").select("_value")
        placed = placed.join(large, "_value")
    rest = _apart(placed, sets)
    if rest is None:
        return found
    to_centre, pairs = rest
    pairs = pairs.join(tried, ["_u", "_v"], "left_anti")
    return found.union(to_centre).union(similar(materialise(pairs, "rest-tries"), sets))


def keep_one(docs: DataFrame, exact: bool = False) -> DataFrame:
    """One document of each group of near duplicates, all columns unchanged: the one with the smallest id.

    Texts are similar if their sets of five-word shingles have SIMILARITY or more in common; groups are what
    similar pairs connect. Texts without words, null and empty ones among them, are one group. Rows without an
    id come last, by their text. Of repeated rows one stays; an id with several texts stays with each that is
    the first of its group. An empty table gives no rows. ``exact`` as in ``similar_links``.
    """
    keyed = packed(docs).select("_row", "text", doc_key(F.col("doc_id"), F.col("text")).alias("_key"))
    kind = T.StructType([*(T.StructField(c, T.LongType()) for c in ("_d", *_WIDE_NAMES)), T.StructField("_bands", T.ArrayType(T.LongType()))])
    prints = keyed.select("_key", F.xxhash64("text").alias("_text"), F.pandas_udf(_set_prints, kind)("text").alias("_f"))
    prints = materialise(prints.select("_key", "_text", "_f.*"), "set-prints")
    nodes = materialise(prints.groupBy("_d").agg(F.min("_key").alias("_key"), *(F.first(c).alias(c) for c in (*_WIDE_NAMES, "_bands"))), "nodes")
    found = components(similar_links(nodes, keyed.select("_key", "text"), exact))
    placed = nodes.select("_d", "_key").join(found, F.col("_d") == F.col("_node"), "left").select("_d", "_key", F.coalesce("_root", "_d").alias("_root"))
    first = placed.groupBy("_root").agg(F.min("_key").alias("_key"))
    chosen = placed.join(first, ["_root", "_key"]).groupBy("_root", "_key").agg(F.min("_d").alias("_d"))
    kept = prints.select("_key", "_d", "_text").join(chosen, ["_key", "_d"]).groupBy("_key", "_d").agg(F.min("_text").alias("_text"))
    rows = keyed.withColumn("_text", F.xxhash64("text")).join(materialise(kept.select("_key", "_text"), "kept"), ["_key", "_text"], "left_semi")
    one = Window.partitionBy("_key", "_text").orderBy(F.lit(0))
    return unpacked(rows.withColumn("_rank", F.row_number().over(one)).filter("_rank = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Stage: the rows that ``keep_one`` keeps, with all columns of ``docs``, whatever their names.

    Null and empty texts are one group, of which one row stays; an empty table gives an empty result.
    """
    return keep_one(docs)


def op6_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

import itertools
import random

import numpy as np
import pytest
import xxhash

from secstream.llm import simhash as h
from tests.llm.helpers import WORD, documents, hostile, prose


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    values = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def reach(prints, radius):
    """Component number of every fingerprint."""
    group = list(range(len(prints)))
    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius and group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    return group


def test_fingerprints_equal_brute_force():
    for _, text in hostile():
        assert h.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_components_of_documents(spark):
    rows = hostile()
    got = h.near_duplicates(documents(spark, rows, "component_id")).collect()
    assert len(got) == len(rows)
    prints = [slow_fingerprint(t) for _, t in rows]
    group = reach(prints, 4)
    want = []
    for (i, _), p, g in zip(rows, prints, group):
        ids = [j for (j, _), o in zip(rows, group) if o == g and j is not None]
        want.append((str(i), f"{p:016x}", min(ids, default=None)))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted(want, key=lambda x: x)


def clustered(seed, n):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        centre = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 2, 30])):
            flip = 0
            for b in r.sample(range(64), r.randint(0, 6)):
                flip |= 1 << b
            out.add(centre ^ flip)
    return sorted(out)


@pytest.mark.parametrize(("radius", "bucket"), [(4, 2_000), (4, 5), (3, 5), (2, 2_000), (1, 4)])
def test_links_connect_all_within_the_radius(spark, radius, bucket):
    prints = clustered(radius, 300)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(signed)], "_key long, _fp long")
    got = {r._fp: r._first for r in h.roots(df, radius, bucket).collect()}
    group = reach(prints, radius)
    least = {g: min(k for k, o in enumerate(group) if o == g) for g in group}
    assert [got[p] for p in signed] == [least[g] for g in group]


@pytest.mark.parametrize("radius", [1, 4, 8])
def test_plans_obey_the_pigeonhole(radius):
    sample = [r - (1 << 63) for r in (random.Random(3).getrandbits(64) for _ in range(200))]
    for n in (10, 10_000, 10_000_000):
        parts = h.plan_parts(sample, n, radius)
        assert sum(t + 1 for _, t in parts) == radius + 1
        bits = [b for group, _ in parts for b in group]
        assert len(bits) == len(set(bits)) <= 64


def test_correlated_bits_share_a_part():
    r = np.random.default_rng(1)
    bits = r.integers(0, 2, (400, 64)).astype(float)
    bits[:, 40] = bits[:, 3]
    assert any({3, 40} <= set(g) for g in h.group_bits(bits, 4))


def test_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(k + 1, k) for k in range(300)], "_u long, _v long")
    assert {(r._root) for r in h.components(chain).collect()} == {0}


def test_one_of_each_group_stays(spark):
    base = prose(1, 200).split()
    edited = lambda k, at: " ".join([*base[:at], f"edit{k}", *base[at + 1 :]])
    near = [(k, edited(k, 7 + 5 * k)) for k in range(10, 30)]
    other = [(k, prose(1000 + k, 200)) for k in range(50, 90)]
    rows = [(9, " ".join(base)), (9, " ".join(base)), *near, *other, (None, " ".join(base)), (None, "lone words without an id here"), (None, "lone words without an id here"), (91, None), (92, "")]
    got = h.keep_one(documents(spark, rows, "_key")).collect()
    kept = sorted(str(r.doc_id) for r in got)
    assert kept == sorted(["9", *(str(k) for k, _ in other), "None", "91"])
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "_key"}
    assert all(r._key == "own" for r in got)


def test_wide_link_matches_the_similarity(spark):
    """Texts with 0.85 or more of their shingles in common are found, nine in ten at least, those under a half are not."""
    r = random.Random(5)
    rows, want = [], {}
    for k in range(60):
        words = prose(k, 300).split()
        other = list(words)
        for at in r.sample(range(300), 4 if k % 2 else 60):
            other[at] = f"e{k}x{at}"
        a, b = ({tuple(w[j : j + 5]) for j in range(296)} for w in (words, other))
        want[k] = len(a & b) / len(a | b)
        rows += [(k, " ".join(words)), (100 + k, " ".join(other))]
    kept = {x.doc_id for x in h.keep_one(documents(spark, rows)).collect()}
    near = [k for k, j in want.items() if j >= 0.85]
    far = [k for k, j in want.items() if j < 0.5]
    assert len(near) > 20 and len(far) > 20
    assert sum(100 + k in kept for k in near) <= 0.1 * len(near)
    assert all(100 + k in kept for k in far)


def pair(shape, k, share):
    """A text of 300 words and one with about ``share`` of its five-word shingles in common, and their similarity."""
    words, r = prose(10_000 + k, 300).split(), random.Random(k)
    if shape == "appended":
        other = words + prose(20_000 + k, round(296 / share) - 296).split()
    elif shape == "cut":
        other = words[: 4 + round(296 * share)]
    else:
        other = list(words)
        while True:
            at = r.randrange(300)
            changed = [*other[:at], f"e{k}x{at}", *other[at + 1 :]]
            if jaccard(words, changed) < share:
                break
            other = changed
    return " ".join(words), " ".join(other), jaccard(words, other)


def jaccard(words, other):
    a, b = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (words, other))
    return len(a & b) / len(a | b)


def test_all_pairs_at_the_similarity_are_found_and_none_below(spark):
    """Scattered edits, passages appended and passages cut off, on both sides of 0.8."""
    rows, want = [], {}
    for k, (shape, share) in enumerate(itertools.product(["scattered", "appended", "cut"], [0.7, 0.75, 0.785, 0.8, 0.82, 0.85, 0.9])):
        for j in range(12):
            n = 100 * k + j
            a, b, want[n] = pair(shape, n, share)
            rows += [(n, a), (100_000 + n, b)]
    kept = {x.doc_id for x in h.keep_one(documents(spark, rows)).collect()}
    assert set(want) <= kept
    assert {n for n in want if 100_000 + n not in kept} == {n for n, j in want.items() if j >= h.SIMILARITY}


def edited_copies(n, share, shape):
    """A text of 150 words and ``n`` copies of it, each edited in its own places down to about ``share``."""
    base, out = prose(77, 150).split(), []
    for k in range(n):
        r, other = random.Random(k), list(base)
        if shape == "block":
            at, size = r.randrange(0, 100), max(1, round(146 * (1 - share) / (1 + share)) - 4)
            other[at : at + size] = [f"b{k}x{j}" for j in range(size)]
        else:
            while True:
                at = r.randrange(150)
                changed = [*other[:at], f"e{k}x{at}", *other[at + 1 :]]
                if jaccard(base, changed) < share:
                    break
                other = changed
        out.append((k + 1, " ".join(other)))
    return [(10**6, " ".join(base)), *out]


@pytest.mark.parametrize(("n", "share", "shape"), [(2_000, 0.81, "scattered"), (500, 0.84, "block"), (500, 0.8, "scattered")])
def test_a_large_group_writes_a_few_rows_a_member(spark, monkeypatch, n, share, shape):
    """Copies are similar to the text they derive from, mostly not to each other; rows compared grow with the group."""
    rows, looked_at, plain = edited_copies(n, share, shape), [], h.similar

    def counted(pairs, sets):
        looked_at.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(h, "similar", counted)
    base = rows[0][1].split()
    linked = sum(jaccard(base, t.split()) >= h.SIMILARITY for _, t in rows[1:])
    kept = {x.doc_id for x in h.keep_one(documents(spark, rows)).collect()}
    assert linked >= 0.95 * n
    assert len(kept) - 1 <= n - linked + 0.1 * linked
    assert sum(looked_at) <= 60 * n


def test_the_exact_form_looks_at_all_that_share_a_bucket(spark):
    rows = edited_copies(120, 0.8, "scattered")
    near = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if jaccard(x.split(), y.split()) >= h.SIMILARITY}
    group = {i: i for i, _ in rows}
    for a, b in near:
        lo, hi = sorted((group[a], group[b]))
        group = {i: lo if g == hi else g for i, g in group.items()}
    kept = {x.doc_id for x in h.keep_one(documents(spark, rows), exact=True).collect()}
    assert kept == set(group.values())


def test_what_the_rounds_leave_apart_is_compared_in_full(spark, monkeypatch):
    """One round with one try a member leaves most similar pairs undecided; none of them may be lost."""
    monkeypatch.setattr(h, "ROUNDS", 1)
    monkeypatch.setattr(h, "TRIES", 1)
    monkeypatch.setattr(h, "SMALL", 2)
    rows = edited_copies(120, 0.8, "scattered")
    apart = {x.doc_id for x in h.keep_one(documents(spark, rows), exact=True).collect()}
    assert {x.doc_id for x in h.keep_one(documents(spark, rows)).collect()} == apart


def brute_force(rows):
    """The smallest id of each group that pairs of SIMILARITY or more connect."""
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if group[a] != group[b] and both >= h.SIMILARITY * (len(sets[a]) + len(sets[b]) - both):
            lo, hi = sorted((group[a], group[b]))
            group = {i: lo if g == hi else g for i, g in group.items()}
    return set(group.values())


def test_copies_that_are_similar_to_nothing_do_not_meet(spark, monkeypatch):
    """Half of the copies are far from all others, though they share buckets with them: those pairs were all compared."""
    rows, looked_at, plain = edited_copies(250, 0.85, "scattered"), [], h.similar
    rows += [(1_000 + i, t) for i, t in edited_copies(250, 0.74, "scattered")[1:]]

    def counted(pairs, sets):
        looked_at.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(h, "similar", counted)
    assert {x.doc_id for x in h.keep_one(documents(spark, rows)).collect()} == brute_force(rows)
    assert sum(looked_at) <= 20 * len(rows)


@pytest.mark.parametrize("rounds", [1, 4])
def test_differences_from_a_centre_lose_no_pair(spark, monkeypatch, rounds):
    """Families of edited copies of edited copies, some near the centre, some near each other only, of unequal length."""
    monkeypatch.setattr(h, "ROUNDS", rounds)
    monkeypatch.setattr(h, "TRIES", 1)
    monkeypatch.setattr(h, "SMALL", 2)
    rows, base, r = [], prose(78, 150).split(), random.Random(9)

    def edited(words, n, tag):
        words = list(words)
        for j in range(n):
            at = r.randrange(len(words))
            words[at : at + r.choice([0, 1, 1, 2])] = r.choice([[], [f"{tag}x{j}"], [f"{tag}y{j}", "the"]])
        return words

    for k in range(30):
        head = edited(base, r.choice([1, 3, 4, 5]), f"h{k}") + prose(500 + k, r.choice([1, 1, 20])).split()
        rows.append((100 * k, " ".join(head)))
        rows += [(100 * k + j, " ".join(edited(head, r.choice([1, 2, 3, 4]), f"c{k}z{j}"))) for j in range(1, 6)]
    want = brute_force(rows)
    assert 10 < len(want) < len(rows) - 30
    assert {x.doc_id for x in h.keep_one(documents(spark, rows)).collect()} == want


def test_texts_of_one_id_are_judged_each(spark):
    rows = [(1, prose(1, 60)), (2, prose(1, 60)), (2, prose(2, 60)), (3, prose(2, 60) + " more"), (4, "One two"), (5, "one  TWO"), (None, "one two")]
    kept = sorted((x.doc_id, x.text) for x in h.keep_one(documents(spark, rows)).collect())
    assert kept == [(1, rows[0][1]), (2, rows[2][1]), (4, "One two")]


def test_empty_tables(spark):
    assert h.near_duplicates(documents(spark, [])).collect() == []
    assert h.keep_one(documents(spark, [])).collect() == []

import hashlib
import itertools

import numpy as np
import pytest

from secstream.llm import zones as z


def vectors(spark, rows, extra=""):
    return spark.createDataFrame([(*r, "own") if extra else r for r in rows], f"vec_id long, embedding array<float>{extra}")


def plain(rows, k=z.K, rounds=z.ROUNDS):
    """Every vector against every centroid, with Python's whole numbers."""
    import math

    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    centre = [v for _, _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centre))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, vs in groups.items():
            centre[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    return sorted(((i is None, i or 0, n, d, sum(y for _, y, m in found if m == n), sum(y for _, y, _ in found), hashlib.sha256(",".join(map(str, centre[n])).encode()).hexdigest()) for i, d, n in found))


def got(df, **kinds):
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in z.clusters(df, **kinds)[0].collect())


def made(n, seed=0, groups=6, width=0.02):
    r = np.random.default_rng(seed)
    centre = r.normal(0, 0.2, (groups, 64))
    return [(k, [float(x) for x in (centre[k % groups] + r.normal(0, width, 64)).astype(np.float32)]) for k in range(n)]


@pytest.mark.parametrize("width", [0.02, 0.3])
def test_equals_brute_force(spark, width):
    rows = made(300, 1, width=width)
    assert got(vectors(spark, rows)) == plain(rows)


def test_hostile_rows(spark):
    """Wrong lengths, nulls and non-finite components leave; copies, ties, repeated and null ids stay, clashing names do not matter."""
    rows = made(60, 2)
    same = rows[0][1]
    rows += [(100 + k, same) for k in range(50)] + [(7, same), (7, same), rows[3], rows[3], (None, same), (None, rows[5][1])]
    rows += [(200, None), (201, []), (202, same[:63]), (203, [*same, 0.0]), (204, [*same[:63], None]), (205, [float("nan"), *same[1:]]), (206, [float("inf"), *same[1:]]), (207, [0.0] * 64), (208, [-0.0] * 64)]
    assert got(vectors(spark, rows, ", _q string")) == plain(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = made(5, 3)
    assert got(vectors(spark, rows)) == plain(rows)
    out, centroids = z.clusters(vectors(spark, []))
    assert out.collect() == [] and centroids.shape == (0, 64)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_huge_components_count_as_the_limit(spark):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [2.0**19] * 64), (4, [1.0] * 64)]
    out = {r.vec_id: r for r in z.clusters(vectors(spark, rows), k=1, rounds=1)[0].collect()}
    mean = (z.LIMIT - z.LIMIT + z.LIMIT + 256) // 4
    assert out[1].distance == out[3].distance == 64 * (z.LIMIT - mean) ** 2
    assert out[4].distance == 64 * (256 - mean) ** 2


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 3), (3, 2), (4, 2), (3, 3)])
def test_the_curve_visits_neighbours(dimensions, bits):
    levels = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = [k.tobytes() for k in z.hilbert_keys(levels, bits)]
    assert len(set(keys)) == len(keys)
    walk = levels[sorted(range(len(keys)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_every_nearest_centroid():
    r = np.random.default_rng(4)
    left_out = 0
    for _ in range(200):
        rows = r.integers(-50, 50, 64) + r.integers(-4, 5, (40, 64))
        centroids = r.integers(-50, 50, (20, 64))
        centroids[5] = centroids[2]
        among = z.candidates(rows.min(axis=0), rows.max(axis=0), centroids)
        squares = ((rows[:, None] - centroids) ** 2).sum(axis=2)
        assert set(squares.argmin(axis=1)) <= set(among.tolist())
        to, far = z.nearest(rows, rows.min(axis=0), rows.max(axis=0), centroids)
        assert (to == squares.argmin(axis=1)).all() and (far == squares.min(axis=1)).all()
        left_out += 20 - len(among)
    assert left_out > 200 * 10

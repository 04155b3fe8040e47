"""Vector codes (op11) and centroids (op12) against plain loops over Python numbers."""
import hashlib
import math
import random

import numpy as np
import pytest

from firmlens.llm import centroids, product_codes
from firmlens.llm.registry import QUERIES, importable

SF = "/root/testdata/sf0.001"
ODD = "vec_id long, embedding array<double>, label int, code string, x int, distance string, products int"


def odd_rows(dim=64, n=90, seed=3):
    pick = random.Random(seed)
    rows = [(pick.choice([k, 2 ** 53 + k]), [pick.choice([-0.5, 0.25, 0.001, pick.uniform(-1, 1)]) for _ in range(dim)], pick.choice([None, 1, 2]), "c", 1, "d", 2)
            for k in range(n)]
    rows += [(700, rows[3][1], 1, None, None, None, None)] * 4 + [(rows[5][0], [0.5] * dim, None, "c", 1, "d", 2), (None, [0.125] * dim, 2, "c", 1, "d", 2)]
    rows += [(800, None, 1, "c", 1, "d", 2), (801, [math.nan] + [0.0] * (dim - 1), 1, "c", 1, "d", 2), (802, [None] * dim, 1, "c", 1, "d", 2),
             (803, [math.inf] * dim, 1, "c", 1, "d", 2), (804, [], 1, "c", 1, "d", 2), (805, [0.0] * dim, None, "c", 1, "d", 2), (806, [1.0] * (dim - 1), 1, "c", 1, "d", 2)]
    return rows


def usable(rows, scale, dim=64):
    return [(r[0], [math.floor(scale * c) for c in r[1]], r[2]) for r in rows
            if r[1] is not None and len(r[1]) == dim and all(c is not None and math.isfinite(c) for c in r[1])]


def mean(vectors):
    return [sum(c) // len(vectors) for c in zip(*vectors)]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def first_rows(kept):
    return sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def slow_codes(kept, parts=16, entries=64, rounds=2):
    width = len(kept[0][1]) // parts
    cut = [[x[p * width:(p + 1) * width] for p in range(parts)] for _, x, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def assign():
        return [[min((square(c[p], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        got = assign()
        books = [[mean(own) if (own := [c[p] for c, g in zip(cut, got) if g[p][1] == j]) else e for j, e in enumerate(books[p])] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(v, "".join(f"{j:02x}" for _, j in g), sum(d for d, _ in g), label) for (v, _, label), g in zip(kept, assign())], digest


def slow_clusters(kept, centroids_=16, rounds=3):
    def place(r):
        return (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])

    now = [x for _, x, _ in sorted(kept, key=place)[:centroids_]]
    for _ in range(rounds):
        got = [min((square(x, c), j) for j, c in enumerate(now))[1] for _, x, _ in kept]
        now = [mean(own) if (own := [x for (_, x, _), j in zip(kept, got) if j == k]) else c for k, c in enumerate(now)]
    return [(v, *min((square(x, c), j) for j, c in enumerate(now))[::-1]) for v, x, _ in kept], now


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.fixture
def odd(spark, monkeypatch):
    importable(spark)
    return spark.createDataFrame(odd_rows(), ODD).repartition(3)


def written(df, path, monkeypatch=None):
    df.write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_codes(spark, odd, tmp_path):
    found = QUERIES["op11_active_entry_codes"](spark, written(odd, tmp_path)).collect()
    want, digest = slow_codes(usable(odd_rows(), 256))
    by_label = {}
    for _, _, e, label in want:
        by_label[label] = by_label.get(label, 0) + e
    assert ordered((r.vec_id, r.code, r.error, r.label_error) for r in found) == ordered((v, c, e, by_label[label]) for v, c, e, label in want)
    assert {r.codebooks_sha256 for r in found} == {digest}


@pytest.mark.parametrize("n", [0, 1, 7])
def test_codes_of_few_rows(spark, n, tmp_path):
    rows = odd_rows()[:n]
    df = spark.createDataFrame(rows, ODD)
    found = QUERIES["op11_active_entry_codes"](spark, written(df, tmp_path)).collect()
    assert ordered((r.vec_id, r.code, r.error) for r in found) == (ordered((v, c, e) for v, c, e, _ in slow_codes(usable(rows, 256))[0]) if n else [])
    found = QUERIES["op12_incremental_centroids"](spark, str(tmp_path)).collect()
    assert ordered((r.vec_id, r.cluster, r.distance) for r in found) == (ordered(slow_clusters(usable(rows, 64))[0]) if n else [])


def test_reassign_equals_a_full_scan():
    pick = np.random.default_rng(1)
    for _ in range(50):
        x, old = pick.integers(-3, 4, (200, 2)), pick.integers(-3, 4, (12, 2))
        moved = pick.random(12) < pick.random()
        new = np.where(moved[:, None], pick.integers(-3, 4, (12, 2)), old)
        code, distance = product_codes.reassign(x, new, moved, *product_codes.nearest(x, old))
        want = product_codes.nearest(x, new)
        assert (code == want[0]).all() and (distance == want[1]).all()


def test_large_numbers_stay_exact():
    a, b = np.array([[1 << 28, -(1 << 28)]]), np.array([[-(1 << 28) + 1, 1 << 28]])
    assert product_codes.distances(a, b).tolist() == [[((1 << 29) - 1) ** 2 + (1 << 29) ** 2]]


def test_clusters(spark, odd, tmp_path):
    found = QUERIES["op12_incremental_centroids"](spark, written(odd, tmp_path)).collect()
    want, now = slow_clusters(usable(odd_rows(), 64))
    assert ordered((r.vec_id, r.cluster, r.distance) for r in found) == ordered(want)
    for r in found:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for _, _, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, now[r.cluster])).encode()).hexdigest()


def test_products_follow_changes():
    pick = np.random.default_rng(2)
    x, a, b = pick.integers(-9, 9, (50, 6)), pick.integers(-9, 9, (4, 6)), pick.integers(-9, 9, (4, 6))
    b[1], b[2, :5] = a[1], a[2, :5]
    assert (centroids.updated(x @ a.T, x, b - a) == x @ b.T).all()


def test_given_tables(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    assert ordered((r.vec_id, r.code, r.error) for r in QUERIES["op11_active_entry_codes"](spark, SF).collect()) == ordered(
        (v, c, e) for v, c, e, _ in slow_codes(usable([(r.vec_id, r.embedding, r.label) for r in rows], 256))[0])
    assert ordered((r.vec_id, r.cluster, r.distance) for r in QUERIES["op12_incremental_centroids"](spark, SF).collect()) == ordered(
        slow_clusters(usable([(r.vec_id, r.embedding, r.label) for r in rows], 64))[0])

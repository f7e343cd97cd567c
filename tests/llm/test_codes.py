import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tarn.llm import codes


def slow(rows, entries=16, rounds=6, length=None):
    """Plain Lloyd over Python's integers; ``rows``: (vec_id, vector, label) that are kept."""
    if not rows:
        return [], hashlib.sha256(b"").hexdigest()
    whole = [[math.floor(Fraction(float(x)) * 4096) for x in v] for _, v, _ in rows]
    size = len(whole[0]) // 8
    cut = [[v[p * size : (p + 1) * size] for p in range(8)] for v in whole]
    least = {}
    for (i, v, _), c in zip(rows, cut):
        if i not in least or v < least[i][0]:
            least[i] = (v, c)
    seeds = [least[i][1] for i in sorted(least, key=lambda i: (i is None, i or 0))[:entries]]
    books = [[list(s[p]) for s in seeds] for p in range(8)]

    def near(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        moved = []
        for p in range(8):
            groups = defaultdict(list)
            for c in cut:
                groups[near(p, c[p])[0]].append(c[p])
            moved.append([[sum(x) // len(groups[e]) for x in zip(*groups[e])] if groups[e] else books[p][e] for e in range(len(seeds))])
        books = moved
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(p, c[p]) for p in range(8)] for c in cut]
    error = [sum(d for _, d in f) for f in found]
    labels = defaultdict(int)
    for (_, _, label), e in zip(rows, error):
        labels[label] += e
    top = 2**63 - 1
    return sorted(((i, "".join(f"{e:02x}" for e, _ in f), min(e, top), min(labels[label], top)) for (i, _, label), f, e in zip(rows, found, map(int, error))), key=str), digest


def compare(spark, rows, kept=None, **sizes):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int")
    got = codes.compress(df, **sizes).collect()
    want, digest = slow(rows if kept is None else kept, **sizes)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} <= {digest}
    return got


def test_against_brute_force(spark, rng):
    rows = [(int(i), [float(x) for x in v], None if i % 7 == 0 else int(i % 3)) for i, v in zip(rng.permutation(300), rng.normal(0, 0.3, (300, 24)))]
    rows += rows[:40] + [(rows[0][0], rows[1][1], 0), (None, rows[2][1], None)]  # repeated rows, an id with two vectors, no id
    nan, inf = float("nan"), float("inf")
    odd = [(-5, None, 1), (-4, [nan] * 24, 1), (-3, [0.0] * 23 + [inf], 1), (-2, [None] + [0.0] * 23, 1), (-1, [], 1), (-6, [1.0] * 16, 1), (-7, [1.0] * 23, 0)]
    compare(spark, odd + rows, rows)


def test_few_ids_ties_and_equal_vectors(spark, rng):
    coarse = [(i, [float(x) / 4096 for x in rng.integers(-2, 3, 16)], i % 2) for i in range(200)]
    compare(spark, coarse, entries=5, rounds=3)
    same = [(i, [0.25] * 8, None) for i in range(100)]
    assert {r.error for r in compare(spark, same)} == {0}
    compare(spark, [(None, [0.5] * 8, 1), (3, [0.25, -0.25] * 4, 1)])


def test_components_of_any_size(spark, rng):
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(rng.normal(0, 1e5, (60, 8)))]
    compare(spark, rows, entries=4, rounds=2)
    got = compare(spark, [*rows, (60, [1e308] * 8, 0), (61, [-1.7e308, 1e300] * 4, 0), (62, [1e-320, 5e-324] * 4, 1)], entries=4, rounds=2)
    assert max(r.label_error for r in got) == 2**63 - 1


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert codes.compress(df).count() == 0
    none = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    assert codes.compress(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 100, 1000, 4096])
def test_trees_assign_as_all_distances(rng, n):
    for high, dims in ((3, 2), (4096, 8)):
        points, books = rng.integers(-high, high, (8, n, dims)), rng.integers(-high, high, (8, 16, dims))
        trees = codes.unpacked(codes.packed(codes.forest(points)))
        distance = ((points[:, :, None] - books[:, None]) ** 2).sum(-1)
        nearest = distance.argmin(-1)
        assert (codes.assigned(trees, books) == nearest).all()
        sums, counts = codes.filtered(trees, books)
        for p in range(8):
            for e in range(16):
                assert counts[p, e] == (nearest[p] == e).sum() and (sums[p, e] == points[p][nearest[p] == e].sum(0)).all()
        assert trees.levels[0].counts.ravel().tolist() == [n] * 8 and (trees.levels[0].sums[:, 0] == points.sum(1)).all()


def test_whole_subtrees_are_assigned(rng):
    """On well separated clusters hardly any point is looked at by itself."""
    centres = np.arange(16)[:, None] * 1000 * np.ones(8, np.int64)
    points = np.stack([centres[rng.permutation(4096) % 16] + rng.integers(-3, 4, (4096, 8)) for _ in range(8)]).astype(np.int64)
    told = []
    codes.filtered(codes.forest(points), np.stack([centres.astype(np.int64)] * 8), lambda part, rows, entry: told.append(rows.shape))
    assert min(rows[-1] for rows in told) >= 128 and sum(math.prod(rows) for rows in told) == points.shape[0] * points.shape[1]


def test_digits():
    values = np.array([0, 1, -1, 2**80, -(2**95) + 7, 2**33], object)
    at = np.arange(len(values))
    back = [0] * len(values)
    for p, _, _, digit, value in codes.digits(at, at, at, values):
        assert abs(value) < 2**33
        back[p] += value << codes.DIGIT * digit
    assert back == values.tolist()

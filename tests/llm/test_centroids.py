"""Centroid clustering: against Python's integers, whatever the magnitudes and partitions."""

import hashlib
import math

import numpy as np
import pytest

from tallyweave.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def brute(rows, dims, k, rounds, scale=64):
    """(id, cluster, distance, inertia of the cluster, inertia, digest) of every usable row, sorted."""
    kept = []
    for i, v in rows:
        if v is None or len(v) != dims or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, v, [math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale for x in v]))
    order = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()), r[1]))
    c = [q for *_, q in order[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        own = [near(q)[1] for *_, q in kept]
        for j in range(len(c)):
            mine = [q for (*_, q), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [near(q) for *_, q in kept]
    per = {j: sum(d for d, o in last if o == j) for j in range(len(c))}
    fit = lambda v: v if v < 2**63 else None
    out = [(i, j, fit(d), fit(per[j]), fit(sum(per.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, *_), (d, j) in zip(kept, last)]
    return sorted(out, key=str)


def run(spark, rows, parts, dims, k, rounds):
    # the further column has a name of the result's
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(parts)
    got, _ = ce.cluster(df, dims=dims, clusters=k, rounds=rounds)
    return sorted([tuple(r) for r in got.collect()], key=str)


def vectors(rng, n, dims, size):
    return [(int(i), [float(x) for x in rng.normal(0, size, dims)]) for i in range(n)]


@pytest.mark.parametrize("size", [1.0, 3e6, 2e8, 1e30])
def test_brute(spark, size):
    """Products, int64 and Python's integers, each alone and beside vectors of ordinary size."""
    rng = np.random.default_rng(3)
    rows = vectors(rng, 60, 5, 1.0) + [(100 + i, v) for i, v in vectors(rng, 25, 5, size)]
    rows += [(7, rows[0][1]), (7, rows[7][1]), (None, [0.5] * 5), (None, [0.5] * 5)]
    rows += [(200, None), (201, []), (202, [1.0] * 4), (203, [1.0, None, 1.0, 1.0, 1.0]), (204, [math.nan] + [0.0] * 4), (205, [-math.inf] + [0.0] * 4)]
    want = brute(rows, 5, 6, 3)
    assert len(want) == 60 + 25 + 4
    for parts in (1, 7):
        assert run(spark, rows, parts, 5, 6, 3) == want


def test_bounds_of_exactness():
    """At and beyond the bounds: equal to integers, with one centroid or vector out of the ordinary."""
    rng = np.random.default_rng(5)
    for power in (10, 20, 23, 24, 26, 29, 31, 40, 60, 200, 1017):
        x = rng.integers(-50, 50, (6, 4)).astype(float) / 64
        x[2] *= 2.0**power
        c = ce.Centroids([[int(v) for v in r] for r in ce.exact_rows(x[:3], 64)], 64)
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c.rows] for p in ce.exact_rows(x, 64)]
        assert c.distances(x).tolist() == want
        assert ce.column_sums(x, 64) == [sum(col) for col in zip(*ce.exact_rows(x, 64).tolist())]
    assert ce.exact(-1 / 128, 64) == -1 and ce.exact(1.5e308, 64) == int(1.5e308) * 64


def test_ties_and_few_vectors(spark):
    same = [(i, [1.0, 1.0]) for i in range(9)]
    got = run(spark, same, 3, 2, 4, 2)
    assert got == brute(same, 2, 4, 2) and {r[1] for r in got} == {0}
    two = [(1, [0.0, 0.0]), (2, [3.0, 0.0])]
    assert run(spark, two, 2, 2, 16, 3) == brute(two, 2, 16, 3)
    assert run(spark, [], 1, 2, 4, 2) == [] and run(spark, [(1, [1.0])], 1, 2, 4, 2) == []
    with pytest.raises(ValueError):
        ce.cluster(spark.createDataFrame([], SCHEMA), scale=10)


def test_query_brute(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted([tuple(r) for r in ce.op12_centroids(spark, sf).collect()], key=str)
    assert got == brute(rows, 64, 16, 3)

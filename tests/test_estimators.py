"""Estimators, quantiles, indices: hand-computed cases and properties."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.functions import estimators as E
from tallyweave.functions import expr as X
from tallyweave.operators import indices, quantile, tables


def frame(spark, rows, schema="v double, w double"):
    return spark.createDataFrame(rows, schema)


def value(df, col):
    return df.agg(col.alias("x")).first()["x"]


def test_weighted_mean_and_share(spark):
    assert value(frame(spark, [(0.0, 3.0), (10.0, 1.0)]), E.weighted_mean("v", "w")) == 2.5
    f = frame(spark, [(1.0, 1.0), (0.0, 1.0), (None, 1.0), (None, 1.0)])
    assert value(f, E.weighted_share("v", "w")) == 0.5
    assert value(f, E.weighted_share("v", "w", missing_as_no=True)) == 0.25
    assert value(frame(spark, [(1.0, None), (1.0, -1.0), (0.0, 2.0)]), E.weighted_mean("v", "w")) == 0.0
    assert value(frame(spark, []), E.weighted_mean("v", "w")) is None


def test_effective_n_and_interval(spark):
    assert value(frame(spark, [(1.0, 1.0)] * 10), E.effective_n("w")) == pytest.approx(10)
    assert value(frame(spark, [(1.0, 9.0)] + [(1.0, 0.1)] * 9), E.effective_n("w")) < 10
    assert value(frame(spark, []), E.effective_n("w")) == 0.0
    r = spark.range(1).select(E.wald_low(F.lit(0.5), F.lit(100.0)).alias("a"), E.wald_high(F.lit(0.5), F.lit(100.0)).alias("b"), E.wald_low(F.lit(0.5), F.lit(0.0)).alias("c"), E.wald_high(F.lit(0.99), F.lit(4.0)).alias("d")).first()
    assert (r["a"], r["b"]) == (pytest.approx(0.402), pytest.approx(0.598)) and r["c"] is None and r["d"] == 1.0


def brute_quantile(rows, q):
    rows = sorted((v, w) for v, w in rows if v is not None and w is not None and w > 0)
    if not rows:
        return None
    w = np.array([x[1] for x in rows])
    return float(np.interp(q, (np.cumsum(w) - w / 2) / w.sum(), [x[0] for x in rows]))


def q_of(spark, rows, *qs):
    r = quantile.weighted_quantiles(frame(spark, rows), "v", "w", qs, names=[f"q{i}" for i in range(len(qs))]).collect()
    return [r[0][f"q{i}"] if r else None for i in range(len(qs))]


def test_quantile_cases(spark):
    assert q_of(spark, [(float(x), 1.0) for x in range(1, 10)], 0.5) == [5.0]
    assert q_of(spark, [(1.0, 1.0), (2.0, 1.0), (10.0, 1.0)], 0.5) == [2.0]
    assert q_of(spark, [(1.0, 50.0), (2.0, 50.0), (10.0, 1.0)], 0.5)[0] < 2
    assert q_of(spark, [(1.0, 1.0), (2.0, 1.0), (100.0, 0.0)], 0.5) == [1.5]
    assert q_of(spark, [], 0.5) == [None]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), st.one_of(st.none(), st.floats(0, 100), st.just(1.0))), max_size=30))
def test_quantile_property(spark, rows):
    rows = [(v, w if w is None or w > 1e-3 else 0.0) for v, w in rows]
    qs = (0.0, 0.1, 0.5, 0.77, 1.0)
    for q, got in zip(qs, q_of(spark, rows, *qs)):
        want = brute_quantile(rows, q)
        assert (got is None) == (want is None)
        assert want is None or got == pytest.approx(want, rel=1e-6, abs=1e-6)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(st.integers(0, 1).map(float), st.floats(0.1, 10)), min_size=1, max_size=30), c=st.floats(0.5, 20))
def test_scaling_and_kish(spark, rows, c):
    both = frame(spark, [(v, w, w * c) for v, w in rows], "v double, w double, u double")
    r = both.agg(E.weighted_mean("v", "w").alias("a"), E.weighted_mean("v", "u").alias("b"), E.effective_n("w").alias("n"), E.effective_n("u").alias("m"), E.percentile_of(0.5, "v", "w").alias("p"), E.percentile_of(0.5, "v", "u").alias("q")).first()
    assert r["a"] == pytest.approx(r["b"]) and r["n"] == pytest.approx(r["m"]) and r["p"] == pytest.approx(r["q"])
    assert r["n"] <= len(rows) + 1e-9


def test_percentile_table_and_benchmark(spark):
    rows = [(float(i), 1.0, 1.0) for i in range(10)] + [(float(i), 1.0, 2.0) for i in range(250)]
    t = {r["group"]: r for r in quantile.percentile_table(frame(spark, rows, "v double, w double, age double"), "v", "age", "w").collect()}
    assert t["1.0"]["thin_cell"] and not t["2.0"]["thin_cell"] and not t["all"]["thin_cell"]
    assert t["all"]["n_rows"] == 260 and t["2.0"]["p50"] == 124.5
    b = quantile.benchmark(75, frame(spark, [(float(i), 1.0) for i in range(100)]), "v", "w")
    assert 70 <= b["percentile"] <= 80 and "%" in b["sentence"]
    assert quantile.benchmark(75, frame(spark, [(None, 1.0)]), "v", "w")["percentile"] is None


BANDS = {"water": "d1", "power": "d2", "gas_heating": "d3", "food": "d4", "medication": "d5"}


def horizon(spark, rows, na=(), k=3):
    data = [(*[None if x is None else float(x) for x in r], i in na, 1.0) for i, r in enumerate(rows)]
    return indices.horizon_index(spark.createDataFrame(data, "d1 double, d2 double, d3 double, d4 double, d5 double, na5 boolean, w double"), BANDS, {"medication": "na5"}, k)


def test_horizon_index(spark):
    r = horizon(spark, [(1, 4, 4, 4, 4), (4, 3, 2, 4, 4), (2, 3, 3, 4, 4), (1, 2, None, None, None), (2, 2, 2, None, None)]).collect()
    assert [(x["rhi_band"], x["rhi_binding_domain"], x["rhi_days"]) for x in r] == [(1, "water", 1.0), (2, "gas_heating", 2.5), (2, "water", 2.5), (None, None, None), (2, "water", 2.5)]
    r = horizon(spark, [(3, 3, 3, 3, None), (3, 3, 3, 3, None)], na={0}, k=4).collect()
    assert [x["rhi_partial"] for x in r] == [False, True]


def test_target_bounds_and_bands(spark):
    t = horizon(spark, [(1,) * 5, (2,) * 5, (4,) * 5])
    r = t.agg(*[c.alias(n) for n, c in indices.target_bounds("w").items()]).first()
    assert (r[0], r[1]) == (pytest.approx(1 / 3), pytest.approx(2 / 3))
    b = indices.band_distribution(t, "w").collect()
    assert [x["band"] for x in b] == [1, 2, 3, 4] and sum(x["share"] for x in b) == pytest.approx(1) and b[2]["share"] == 0
    p = indices.binding_profile(t, BANDS, "w").collect()
    assert p[0]["domain"] == "water" and sum(x["share_binding"] for x in p) == pytest.approx(1)


def gap_frame(spark, n=4000):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        aware = i % 2 == 0
        rows.append((aware, 1.0, *[float(rng.random() < (0.6 if aware else 0.3)) for _ in range(3)]))
    return spark.createDataFrame(rows, "aware boolean, w double, a double, b double, c double")


def test_gap_family(spark):
    d, items = gap_frame(spark), {x: x for x in "abc"}
    t = indices.gap_table(d, items, "w", "aware").collect()
    assert all(r["conversion"] + r["gap"] == pytest.approx(1) for r in t)
    assert sum(r["lift"] for r in t) / 3 == pytest.approx(2, abs=0.15)
    c = indices.gap_cells(d, items, "w", "aware").collect()
    assert [r["cell"] for r in c] == list(indices.CELLS) and sum(r["weighted_share"] for r in c) == pytest.approx(1)
    p = spark.createDataFrame([(True, 0.0, 0.0), (True, 1.0, 1.0), (False, 0.0, 0.0), (True, None, None), (None, 1.0, 1.0), (True, 0.0, 1.0)], "aware boolean, a double, b double")
    assert [r[0] for r in p.select(indices.person_gap(["a", "b"], "aware")).collect()] == [1.0, 0.0, None, None, None, 0.5]
    assert p.select(indices.person_gap(["a", "b"], "aware", {"a": 0.1}).alias("x")).collect()[5]["x"] == pytest.approx(0.1 / 1.1)


def test_composite_weights(spark):
    s = spark.createDataFrame([("x", 50.0, 2.0, 0.5, 1.0), ("y", 80.0, 4.0, None, 1.0)], "c string, pri double, rhi_band double, pgi double, w double")
    r = indices.composite(s, (2, 1, 1), "c").collect()
    assert len(r) == 1 and r[0]["composite"] == pytest.approx(0.5 * 50 + 0.25 * 100 / 3 + 0.25 * 50)
    with pytest.raises(ValueError):
        indices.composite(s, (0, 0, 0), "c")


def test_variance_audit(spark):
    d = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (None, 5.0, None)], "a double, b double, c double")
    t = {r["column"]: r for r in tables.variance_audit(d, ["a", "b", "c"]).collect()}
    assert not t["a"]["drop"] and t["a"]["n_unique"] == 2 and t["a"]["null_pct"] == pytest.approx(33.33)
    assert t["b"]["drop"] and t["b"]["std"] == 0 and t["c"]["drop"] and t["c"]["n_unique"] == 0


def test_share_by_group(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0)] * 40 + [("b", 0.0, 1.0)] * 5 + [("b", None, 1.0), (None, 1.0, 1.0)], "g string, f double, w double")
    r = tables.share_by_group(d, "f", "g", "w").collect()
    assert [(x["g"], x["share"], x["n_rows"], x["small_cell"]) for x in r] == [("a", 1.0, 40, False), ("b", 0.0, 5, True)]
    assert tables.share_by_group(d, "f", "g", "w", missing_as_no=True).collect()[1]["n_rows"] == 6


def test_scalars(spark):
    d = spark.createDataFrame([(None, None, "x"), (2.0, None, "1"), (2.0, 1.0, "nan"), (7.0, 9.0, None)], "a double, b double, s string")
    r = d.select(X.row_sum(["a", "b"]).alias("sum"), X.row_argmin(["a", "b"]).alias("arg"), X.clip_upper("a", 5).alias("clip"), X.number("s").alias("num"), X.decode_label("s", {"1": "one"}).alias("lab")).collect()
    assert [x["sum"] for x in r] == [None, 2.0, 3.0, 16.0]
    assert [x["arg"] for x in r] == [None, "a", "b", "a"]
    assert [x["clip"] for x in r] == [None, 2.0, 2.0, 5.0]
    assert [x["num"] for x in r] == [None, 1.0, None, None]
    assert [x["lab"] for x in r] == ["x", "one", "nan", None]
    p = spark.createDataFrame([(t,) for t in (-6.0, -1.0, 0.0, 1.96, 6.0)], "t double").select(X.percentile_score("t")).collect()
    assert [x[0] for x in p] == [0.0, 15.9, 50.0, 97.5, 100.0]
    assert all(abs(x[0] - 50 * (1 + math.erf(t / math.sqrt(2)))) < 0.06 for x, t in zip(p, (-6, -1, 0, 1.96, 6)))


def test_small_tables(spark):
    d = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 3.0), ("b", 5, 2.0)], "g string, k int, v double")
    assert sorted(tuple(r) for r in tables.first_per_group(d, "g", ["k"]).collect()) == [("a", 1, 3.0), ("b", 5, 2.0)]
    s = tables.stack_scopes({"x": d.select("g"), "y": d.select("k")})
    assert s.count() == 6 and set(s.columns) == {"g", "k", "scope"}
    assert tables.seeded_sample(d.repartition(3), "k", 2).collect() == tables.seeded_sample(d.coalesce(1), "k", 2).collect()
    f = {r["value"]: r for r in tables.frequency_table(spark.createDataFrame([("1",), ("1",), (None,)], "c string"), "c", {"1": "yes"}).collect()}
    assert f["1"]["label"] == "yes" and f["missing"]["pct"] == 33.3


def test_quantiles_whatever_the_partitions(spark):
    """Equal figures however rows lie and are cut, against numpy; ties, one hot value and long tails among them."""
    rng = np.random.default_rng(4)
    rows = [(float(rng.choice([1.0, 5.0, round(float(rng.lognormal(3, 2)), 1)], p=[0.2, 0.3, 0.5])), float(rng.integers(0, 4)), "abc"[int(rng.integers(0, 3))]) for _ in range(3000)]
    rows += [(None, 1.0, "a"), (7.0, 1.0, None)]
    qs = (0.0, 0.01, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0)
    want = {g: [brute_quantile([(v, w) for v, w, h in rows if h == g], q) for q in qs] for g in "abc"}
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for n, shuffled in ((1, 1), (8, 5), (200, 40)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", n < 200)
            d = frame(spark, rows, "v double, w double, g string").repartition(shuffled, F.rand(n))
            got = quantile.weighted_quantiles(d, "v", "w", qs, "g", [f"q{i}" for i in range(len(qs))]).collect()
            assert {r["g"] for r in got} == set("abc")
            for r in got:
                np.testing.assert_allclose([r[f"q{i}"] for i in range(len(qs))], want[r["g"]], rtol=1e-9)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_spearman_whatever_the_partitions(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 40, 2000)
    b = np.where(rng.random(2000) < 0.4, 7, a * a + rng.integers(0, 300, 2000))
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    want = np.corrcoef(rank(a), rank(b))[0, 1], np.corrcoef(a, b)[0, 1]
    rows = [(int(x), float(y)) for x, y in zip(a, b)] + [(None, 1.0), (3, None)]
    for n in (1, 30):
        r = tables.spearman(frame(spark, rows, "a int, b double").repartition(n), "a", "b").first()
        np.testing.assert_allclose((r["spearman"], r["pearson"]), want, rtol=1e-9)
        assert r["n"] == 2000
    r = tables.spearman(frame(spark, [(1, 2.0), (1, 3.0)], "a int, b double"), "a", "b").first()
    assert r["spearman"] is None and r["n"] == 2
    assert tables.spearman(frame(spark, [], "a int, b double"), "a", "b").first()["n"] == 0


def test_quantile_ranges_bound_a_task(spark):
    """Blocks lie in many ranges, whatever adaptive execution would join, and results don't show where these end."""
    from tallyweave.operators import quantile
    from tallyweave.operators.frozen import RANGES, in_order

    df = spark.range(3000).selectExpr("double(id % 1000) AS v", "double(1 + id % 7) AS w", "'a' AS g")
    t = in_order(quantile.blocks(df, "v", "w", "g"), "g", "v", "w")
    assert t.rdd.getNumPartitions() == RANGES and t.select("part").distinct().count() > 100
    rows = sorted((r.v, r.w) for r in df.collect())
    total, at, c = sum(w for _, w in rows), [], 0.0
    for v, w in rows:
        at.append(((c + w / 2) / total, v))
        c += w
    k = next(k for k, (f, _) in enumerate(at) if f >= 0.37)
    (f1, v1), (f2, v2) = at[k - 1], at[k]
    got = quantile.weighted_quantiles(df, "v", "w", [0.37], "g").first()["p37"]
    assert abs(got - (v1 + (0.37 - f1) / (f2 - f1) * (v2 - v1))) < 1e-9

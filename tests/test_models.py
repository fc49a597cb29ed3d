"""Item response, ordered probit, boosting, gate: parameter recovery and guards."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import boost, conversion, gate, irt, probit

B, A = np.array([-1.5, -0.5, 0.5, 1.5]), np.array([1.2, 1.4, 1.1, 1.3])
ITEMS = tuple(f"act_i{k}" for k in range(4))


@pytest.fixture(scope="module")
def answers(spark):
    rng = np.random.default_rng(3)
    theta = rng.normal(size=6000)
    x = (rng.random((6000, 4)) < 1 / (1 + np.exp(-A * (theta[:, None] - B)))).astype(float)
    rows = [(i, "t" if i % 4 == 0 else "r", *map(float, r)) for i, r in enumerate(x)] + [(9999, "r", 1.0, None, 0.0, 1.0)]
    return spark.createDataFrame(rows, "id long, grp string, " + ", ".join(f"{c} double" for c in ITEMS)).cache()


@pytest.fixture(scope="module")
def bank(answers):
    return irt.fit_2pl(irt.patterns(answers, ITEMS), ITEMS)


def test_calibration_recovers_parameters(bank):
    assert [r["item"] for r in bank] == list(ITEMS)
    b, a = np.array([r["difficulty"] for r in bank]), np.array([r["discrimination"] for r in bank])
    assert np.corrcoef(b, B)[0, 1] > 0.99 and np.abs(b - B).max() < 0.4 and np.abs(a - A).max() < 0.4


def test_too_few_cases(answers):
    with pytest.raises(ValueError, match="500"):
        irt.fit_2pl(irt.patterns(answers.limit(100), ITEMS), ITEMS)


def brute_eap(x, bank):
    p = np.stack([1 / (1 + np.exp(-r["discrimination"] * (irt.NODES - r["difficulty"]))) for r in bank])
    l = irt.prior() * np.prod([q if v else 1 - q for q, v in zip(p, x)], 0)
    return (irt.NODES * l).sum() / l.sum()


def test_scores(answers, bank):
    got = irt.score_persons(answers, ITEMS, bank).collect()
    assert len(got) == 6001
    for r in got[:50]:
        assert r["theta"] == pytest.approx(brute_eap([r[c] for c in ITEMS], bank), abs=1e-9)
    assert next(r for r in got if r["id"] == 9999)["theta"] is None
    t = np.array([(r["theta"], sum(r[c] for c in ITEMS)) for r in got if r["theta"] is not None])
    assert np.corrcoef(t.T)[0, 1] > 0.95


def test_fit_statistics(answers, bank):
    f = irt.item_fit(irt.patterns(answers, ITEMS), bank).collect()
    assert all(0.6 < r["infit"] < 1.3 and r["n"] == 6000 for r in f)


def test_face_validity():
    def rows(b, p):
        return [{"item": i, "difficulty": x, "p_observed": y} for i, x, y in zip(("flashlight_candles", "grab_bag"), b, p)]

    assert all(r["pass"] for r in irt.face_validity(rows((-0.3, 4.0), (0.6, 0.08))))
    assert not irt.face_validity(rows((4.0, -0.3), (0.6, 0.08)))[0]["pass"]


def test_dimensionality(spark):
    b = [{"item": f"i{k}", "discrimination": a, "difficulty": float(k), "p_observed": 0.5} for k, a in enumerate((1.5, 1.4, 1.2, 0.6, 0.5, 0.4))]
    r = irt.dimensionality(irt.bank_frame(spark, b)).collect()
    assert [x["n_items"] for x in r] == [3, 3] and r[0]["items"] == "i0, i1, i2"
    r = irt.dimensionality(irt.bank_frame(spark, b[:3])).collect()
    assert r[1]["n_items"] == 0 and r[1]["mean_a"] is None


def test_transfer(spark, answers):
    r = irt.transfer(answers, ITEMS, "grp", "t")
    assert r["n_target"] == 1500 and r["n_calibration_pooled"] == 4500
    assert r["theta_correlation"] > 0.95 and r["passes_transfer"] and r["mean_abs_pri_difference"] < 6
    assert irt.difficulty_comparison(spark, r["pooled"], r["native"]).count() == 4


def test_ordered_probit_recovers(spark):
    rng = np.random.default_rng(4)
    x, g = rng.integers(0, 5, 4000).astype(float), rng.integers(1, 4, 4000).astype(float)
    z = 0.6 * x - 0.8 * (g == 2) + rng.normal(size=4000)
    y = np.array([1, 2, 4])[np.digitize(z, [0.5, 1.8])].astype(float)
    d = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(y, x, g)] + [(None, 1.0, 1.0)], "y double, x double, g double")
    f = probit.fit(d, "y", ["x"], ["g"])
    coef = {r["term"]: r for r in f["coefficients"]}
    assert f["n"] == 4000 and f["levels"] == [1, 2, 4]
    assert coef["x"]["coef"] == pytest.approx(0.6, abs=0.08) and coef["g_2"]["coef"] == pytest.approx(-0.8, abs=0.12)
    assert coef["x"]["significant"] and coef["g_3"]["p_value"] > 0.01
    assert np.allclose(f["thresholds"], [0.5, 1.8], atol=0.15)
    assert f["lift"] > 0.1 and 0 < f["pseudo_r2"] < 1
    assert probit.summary({"d": f})[0]["beats_baseline"]
    with pytest.raises(ValueError):
        probit.fit(d.limit(100), "y", ["x"])


@pytest.mark.parametrize("name", ["act_grab_bag", "n_actions", "pri", "theta_action", "pgi", "took_any_action"])
def test_leakage_guard(name):
    with pytest.raises(ValueError, match=name):
        boost.no_leakage(["age", name])


def test_boosting_finds_the_planted_driver(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(1500):
        b = float(rng.integers(1, 5))
        rows.append((float(np.clip(0.4 + 0.1 * b + rng.normal() * 0.05, 0, 1)), b if i % 20 else None, float(rng.integers(18, 80)), str(rng.integers(1, 3)), "ABCDE"[i % 5]))
    d = spark.createDataFrame(rows, "pgi double, prep_no_time_or_money double, age double, gender string, country_grouped string")
    features = ["prep_no_time_or_money", "age", "gender"]
    m, oof, model, coded = boost.out_of_fold(d, features, "pgi", "country_grouped", 60)
    assert m["r2_oof"] > 0.5 and oof.count() == 1500 and oof.where("prediction IS NULL").count() == 0 and m["mae_oof"] < m["mae_baseline"]
    top = boost.importance(model, coded)
    assert top[0]["feature"] == "prep_no_time_or_money" and top[0]["mean_abs_shap"] > 3 * top[1]["mean_abs_shap"]
    assert abs(sum(r["gain"] for r in top) - 1) < 1e-9
    assert set(boost.folds(d, "country_grouped").values()) == set(range(5))
    table = boost.comparison(d, features, ["age"], "pgi", "country_grouped", 60)
    assert [r["n_features"] for r in table] == [0, 1, 3] and abs(table[2]["r2_oof"] - m["r2_oof"]) < 1e-9 and table[0]["mae_oof"] == m["mae_baseline"]


def boosted_rows(n, seed=9):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = float(rng.integers(0, 4)), float(rng.integers(0, 55)) / 7, str(rng.integers(0, 5))
        rows.append((a * 0.3 - 0.02 * b + (0.5 if c in "13" else 0) * (a > 1) + float(rng.normal()) * 0.1, a if i % 9 else None, b, c if i % 13 else None, "ABC"[i % 3]))
    return rows


BOOSTED = "pgi double, prep_no_time_or_money double, age double, gender string, country_grouped string"
BOOSTED_FEATURES = ["prep_no_time_or_money", "age", "gender"]


def plain_boost(rows, rounds, leaves, min_rows, rate=0.05):
    """Fitted values, row by row: the leaf that gains most first, every cut of every feature tried."""
    y, fit = np.array([r[0] for r in rows]), np.full(len(rows), np.mean([r[0] for r in rows]))
    nan = np.array([[math.nan if v is None else float(v) for v in r[1:4]] for r in rows])

    def best(idx, res):
        g, n, found = res[idx].sum(), len(idx), []
        for f in range(3):
            v = nan[idx, f]
            values = sorted({x for x in v if x == x})
            if f == 2:
                keys = sorted([math.nan] * bool(np.isnan(v).any()) + values, key=lambda c: round(res[idx][np.isnan(v) if c != c else v == c].mean(), 12))
                orders = [keys]
            else:
                orders = [[math.nan, *values], [*values, math.nan]]
            for keys in orders:
                left = np.zeros(n, bool)
                for c in keys[:-1]:
                    left = left | (np.isnan(v) if c != c else v == c)
                    k = left.sum()
                    if min(k, n - k) >= min_rows:
                        s = res[idx][left].sum()
                        found.append((s**2 / k + (g - s) ** 2 / (n - k) - g**2 / n, left))
        if not found:
            return None
        top = max(x for x, _ in found)
        return next((x, idx[m], idx[~m]) for x, m in found if x >= top - 1e-9 * abs(top))

    for _ in range(rounds):
        res = y - fit
        open_leaves = [(np.arange(len(y)), best(np.arange(len(y)), res))]
        while len(open_leaves) < leaves:
            some = [k for k, (_, s) in enumerate(open_leaves) if s and s[0] > 1e-12 * len(y)]
            if not some:
                break
            _, (_, l, r) = open_leaves.pop(max(some, key=lambda k: open_leaves[k][1][0]))
            open_leaves += [(l, best(l, res)), (r, best(r, res))]
        for idx, _ in open_leaves:
            fit[idx] += rate * res[idx].mean()
    return y, fit


def test_boosting_brute(spark):
    """400 rounds: fitted values and R2 of a plain version on rows; all features in every tree."""
    rows = boosted_rows(260)
    d = boost.design(spark.createDataFrame(rows, BOOSTED), BOOSTED_FEATURES, "pgi", "country_grouped")
    model = boost.train(d, [(None, BOOSTED_FEATURES)], leaves=7, min_rows=12, feature_share=1.0)[0]
    assert len(model.trees) == 400 and max(len(t.splits) for t in model.trees) == 6
    y, want = plain_boost(rows, 400, 7, 12)
    got = boost.predict(d, {None: model}).collect()
    pairs = sorted((r.y, r.prediction) for r in got)
    np.testing.assert_allclose([p for _, p in pairs], [w for _, w in sorted(zip(y, want))], atol=1e-7)
    m = boost.metrics(d, boost.predict(d, {None: model}), 3)
    assert abs(m["r2_oof"] - (1 - ((y - want) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-7


def test_boosting_over_many_tasks(spark, monkeypatch):
    """Histograms by jobs, over blocks, with saved predictions, give the models that tasks of their own give."""
    rows = spark.createDataFrame(boosted_rows(500), BOOSTED)
    models = [(0, BOOSTED_FEATURES), (1, BOOSTED_FEATURES[1:]), (None, BOOSTED_FEATURES)]
    small = dict(iterations=7, leaves=6, min_rows=10)
    want = boost.train(boost.design(rows, BOOSTED_FEATURES, "pgi", "country_grouped"), models, **small)
    monkeypatch.setattr(boost, "BLOCK", 60)
    monkeypatch.setattr(boost, "TASK", 1)
    monkeypatch.setattr(boost, "SAVE", 3)
    d = boost.design(rows, BOOSTED_FEATURES, "pgi", "country_grouped")
    assert d.tasks > 2
    for got in (boost.train(d, models, **small), boost.train(d, models, apart=True, **small)):
        for a, b in zip(want, got):
            assert [[(s[0], s[1], s[3]) for s in t.splits] for t in a.trees] == [[(s[0], s[1], s[3]) for s in t.splits] for t in b.trees]
            for t, u in zip(a.trees, b.trees):
                np.testing.assert_allclose(t.value, u.value, atol=1e-12)


def test_codings_of_features(spark):
    """Numbers in order of their bins, rare categories together, missing values and NaN in bin 0."""
    rows = [(0.5, float(i), float(i % 3) if i % 5 else None, f"c{min(i, 70)}" if i else None, "AB"[i % 2]) for i in range(400)] + [(0.1, math.nan, None, "c1", "A")]
    d = boost.design(spark.createDataFrame(rows, "y double, age double, few double, gender string, g string"), ["age", "few", "gender"], "y", "g")
    x = sorted(tuple(r.x) for r in d.rows.collect())
    assert {k for _, k, _ in x} == {0, 1, 2, 3} and {k for _, _, k in x} == set(range(64)) and x[0][0] == 0
    assert len({k for k, *_ in x}) > 50 and max(k for k, *_ in x) < 64
    with pytest.raises(ValueError):
        boost.design(spark.createDataFrame([], "y double, age double, g string"), ["age"], "y", "g")


def test_shapley_values(spark):
    """Against every coalition in turn, and every row's values sum to its prediction less the mean."""
    from itertools import combinations
    from math import factorial

    d = boost.design(spark.createDataFrame(boosted_rows(600), BOOSTED), BOOSTED_FEATURES, "pgi", "country_grouped")
    model = boost.train(d, [(None, BOOSTED_FEATURES)], iterations=8, leaves=8, min_rows=20)[0]
    got = boost.explain(d, model).collect()
    rows = [(r.y, tuple(r.x)) for r in d.rows.collect()]
    x, n = np.unique(np.array([r for _, r in rows], np.uint8), axis=0, return_counts=True)
    phi, mean = boost.shapley(model, x)
    assert len(got) == 600
    for r in got:
        assert abs(sum(r.shap) + mean - r.prediction) < 1e-9
    np.testing.assert_allclose(mean, np.mean([r.prediction for r in got]), atol=1e-9)
    top = {r["feature"]: r for r in boost.importance(model, d)}
    np.testing.assert_allclose([top[f]["mean_abs_shap"] for f in BOOSTED_FEATURES], n @ np.abs(phi) / n.sum(), atol=1e-12)
    np.testing.assert_allclose([top[f]["mean_shap"] for f in BOOSTED_FEATURES], n @ phi / n.sum(), atol=1e-12)

    def value(tree, row, known):
        splits = {node: rest for node, *rest in tree.splits}

        def below(node):
            if node not in splits:
                return tree.value[node]
            f, left, l, r = splits[node]
            if f in known:
                return below(l if left[row[f]] else r)
            return (tree.rows[l] * below(l) + tree.rows[r] * below(r)) / tree.rows[node]

        return below(0)

    k = x.shape[1]
    for row, want in list(zip(x, phi))[::17]:
        brute = np.zeros(k)
        for tree in model.trees:
            for f in range(k):
                rest = [g for g in range(k) if g != f]
                for size in range(k):
                    for s in combinations(rest, size):
                        brute[f] += factorial(size) * factorial(k - size - 1) / factorial(k) * (value(tree, row, {*s, f}) - value(tree, row, set(s)))
        np.testing.assert_allclose(want, brute, atol=1e-9)


def test_gate(spark):
    d = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0)], "f double, w double")
    r = gate.run_gate(d, [gate.Check("near", F.avg("f"), 0.52), gate.Check("far", F.avg("f"), 0.6), gate.Check("none", F.avg(F.lit(None).cast("double")), 0.5)])
    assert [x["pass"] for x in r.collect()] == [True, False, False]
    assert gate.report(r)[0] == 1 and gate.report(None)[0] == 2 and gate.report(r.where("pass"))[0] == 0


def test_survey_gate_runs(spark):
    from test_cleaning import raw

    from tallyweave.operators.clean import clean

    r = gate.run_gate(clean(raw(spark)), gate.survey_checks()).collect()
    assert len(r) == 7 and next(x for x in r if x["check"] == "qc7_5_over_7d_eu27")["computed"] == 0.0


def survey(spark, n=4000):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        aware = [int(rng.random() < 0.5) for _ in range(3)]
        acted = [int(rng.random() < (0.4 if a else 0.2)) for a in aware]
        rows.append((2021 + i % 2, float(rng.uniform(0.5, 2)), *aware, *acted, float(rng.integers(1, 6))))
    names = [f"{p}_{k}" for p in ("A3", "PREPB") for k in ("alerts", "supplies", "neighbors")]
    return spark.createDataFrame(rows, "survey_year int, weight double, " + ", ".join(f"{c} int" for c in names) + ", ST_STG1 double")


def test_discovery():
    r = {x["item"]: x for x in conversion.discover_columns(["A3_alerts", "PREPB_alerts", "Q_A3_supplies", "PREPB_neighbors"])}
    assert len(r) == 12 and r["alerts"]["paired"] and r["supplies"]["awareness_col"] == "Q_A3_supplies" and not r["supplies"]["paired"]
    assert conversion.find_weight(["x", "wgt", "weight"]) == "weight" and conversion.find_weight(["a_WT"]) == "a_WT" and conversion.find_weight(["a"]) is None
    assert conversion.pairing_gate(list(r.values())) == (0, "warning: only 1 of 12 items are paired")
    assert conversion.pairing_gate([])[0] == 1


def test_codings(spark):
    d = spark.createDataFrame([("1", "1", "Yes", "1", "1"), ("0", "2", "No", "0", "2"), (None, "1", "don't know", "9", "9"), ("1", "2", "yes ", "99", "1")], "a string, b string, c string, d string, e string")
    r = conversion.yes_no(d, list("abcde")).collect()
    assert [x["a"] for x in r] == [1, 0, None, 1]
    assert [x["b"] for x in r] == [1, 0, 1, 0]
    assert [x["c"] for x in r] == [1, 0, None, 1]
    assert [x["d"] for x in r] == [1, 0, None, None]
    assert [x["e"] for x in r] == [1, 0, None, 1]


def test_codings_by_year(spark):
    d = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 2), (2, 9), (None, 2)], "y int, a int")
    got = sorted((str(r["y"]), str(r["a"])) for r in conversion.yes_no(d, ["a"], within=["y"]).collect())
    assert got == sorted([("1", "0.0"), ("1", "1.0"), ("2", "1.0"), ("2", "0.0"), ("2", "None"), ("None", "0.0")])


def test_conversion_index(spark):
    d = survey(spark)
    pairs = {"alerts": ("A3_alerts", "PREPB_alerts"), "supplies": ("A3_supplies", "PREPB_supplies")}
    t = conversion.aci_table(d, pairs, "weight").collect()
    assert all(0.35 < r["aci"] < 0.45 and 1.7 < r["lift"] < 2.3 and r["weighted"] for r in t)
    assert not conversion.aci_table(d, pairs, "absent").first()["weighted"]
    assert conversion.aci_table(d, pairs, "weight", by=["survey_year"]).count() == 4
    s = conversion.stage_distribution(d, "ST_STG1", "weight").collect()
    assert [x["stage"] for x in s] == [1, 2, 3, 4, 5] and math.isclose(sum(x["share"] for x in s), 1)


def test_crosswalk(spark):
    c = spark.createDataFrame([("x", "alerts", "exact", "same"), ("y", None, "none", None), (None, "z", "none", None), ("w", "alerts", "partial", "wider")], "home_item string, other_item string, match_quality string, note string")
    a = spark.createDataFrame([("alerts", 0.4, 2.0)], "item string, aci double, lift double")
    g = spark.createDataFrame([("x", 0.3, 1.5), ("w", 0.5, 1.1)], "item string, conversion double, lift double")
    r = conversion.crosswalk_compare(c, a, g).collect()
    assert [(x["home_item"], round(x["conversion_gap_pp"], 6), x["match_quality"]) for x in r] == [("w", -10.0, "partial"), ("x", 10.0, "exact")]
    assert [(x["note"], x["recall_windows_differ"]) for x in r] == [("wider", True), ("same", True)]
    assert conversion.crosswalk_compare(c.drop("note"), a, g).where("note IS NULL").count() == 2


def test_normal_distribution_function():
    x = np.array([-37.5, -12, -6, -3.0001, -3, -2.9, -0.3, 0, 1e-9, 0.7, 2.999, 3.2, 8, 37, 40, -np.inf, np.inf])
    want = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    np.testing.assert_allclose(probit.below(x), want, rtol=1e-12)
    np.testing.assert_allclose(probit.between(np.array([8.0, -8.5]), np.array([8.5, -8.0])), [0.5 * (math.erfc(8 / math.sqrt(2)) - math.erfc(8.5 / math.sqrt(2)))] * 2, rtol=1e-12)


def test_ordered_probit_brute(spark, monkeypatch):
    """At the result, the likelihood's slope, taken numerically row by row, is 0 and its curvature gives the errors; any blocks."""
    rng = np.random.default_rng(14)
    x, g = rng.integers(0, 30, 900) / 10.0, rng.integers(1, 4, 900).astype(float)
    y = np.digitize(0.5 * x - 0.7 * (g == 3) + rng.normal(size=900), [0.2, 1.1, 2.0]).astype(float)
    d = spark.createDataFrame([(float(a), float(b), 7.0, float(c)) for a, b, c in zip(y, x, g)], "y double, x double, flat double, g double")
    f = probit.fit(d, "y", ["x", "flat"], ["g"])
    coef = {r["term"]: r for r in f["coefficients"]}
    assert set(coef) == {"x", "g_2", "g_3"}
    cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))

    def loss(t):
        cuts = np.concatenate([[-50], t[:3], [50]])
        eta = t[3] * x + t[4] * (g == 2) + t[5] * (g == 3)
        k = y.astype(int)
        return np.log(cdf(cuts[k + 1] - eta) - cdf(cuts[k] - eta)).sum()

    at = np.array([*f["thresholds"], *[coef[c]["coef"] for c in ("x", "g_2", "g_3")]])
    e = np.eye(6) * 1e-3
    slope = [(loss(at + v) - loss(at - v)) / 2e-3 for v in e]
    np.testing.assert_allclose(slope, 0, atol=1e-2)
    hess = np.array([[(loss(at + u + v) - loss(at + u - v) - loss(at - u + v) + loss(at - u - v)) / 4e-6 for u in e] for v in e])
    np.testing.assert_allclose([coef[c]["std_err"] for c in ("x", "g_2", "g_3")], np.sqrt(np.diag(np.linalg.inv(-hess)))[3:], rtol=1e-3)
    share = np.bincount(y.astype(int)) / 900
    assert f["pseudo_r2"] == pytest.approx(1 - loss(at) / (900 * (share * np.log(share)).sum()))
    monkeypatch.setattr(probit, "BLOCK", 20)
    monkeypatch.setattr(probit, "TASK", 2)
    again = probit.fit(d.repartition(5), "y", ["x", "flat"], ["g"])
    np.testing.assert_allclose([r["coef"] for r in again["coefficients"]], [r["coef"] for r in f["coefficients"]], rtol=1e-9)
    assert again["accuracy"] == f["accuracy"]
    with pytest.raises(ValueError, match="levels"):
        probit.fit(spark.range(600).selectExpr("CAST(id AS double) AS y", "CAST(id % 3 AS double) AS x"), "y", ["x"])


def test_best_domain():
    fit = lambda lift: {"n": 1, "accuracy": 0.5, "baseline": 0.5 - lift, "lift": lift, "pseudo_r2": 0.1}
    assert probit.best_domain({"b": fit(0.2), "a": fit(0.2), "c": fit(-0.1)})["domain"] == "a"


def test_em_over_many_tasks_and_items(spark, monkeypatch):
    """30 items; banks of their own tasks, of jobs over many blocks, and of plain EM on the persons agree."""
    rng = np.random.default_rng(21)
    k = 30
    a, b = rng.uniform(0.8, 1.8, k), np.linspace(-1.5, 1.5, k)
    theta = rng.normal(size=900)
    x = (rng.random((900, k)) < 1 / (1 + np.exp(-a * (theta[:, None] - b)))).astype(float)
    items = [f"i{j}" for j in range(k)]
    d = spark.createDataFrame([tuple(map(int, r)) for r in x], ", ".join(f"{c} int" for c in items))
    counts = irt.patterns(d, items)
    at = irt.begin(x.mean(0))
    for _ in range(12):
        at = irt.improved(irt.expected(x, np.ones(len(x)), *at), *at)
    same = dict(rounds=12, tolerance=0.0)
    one = irt.fit_banks(counts, items, {"all": {"n": 1.0}}, **same)["all"]
    monkeypatch.setattr(irt, "BLOCK", 100)
    monkeypatch.setattr(irt, "TASK", 2)
    many = irt.fit_banks(counts, items, {"all": {"n": 1.0}, "half": {"n": 0.5}}, **same)
    for bank in (one, many["all"], many["half"]):
        by = {r["item"]: r for r in bank}
        np.testing.assert_allclose([by[c]["discrimination"] for c in items], at[0], atol=1e-8)
        np.testing.assert_allclose([by[c]["difficulty"] for c in items], -at[1] / at[0], atol=1e-8)
    assert np.corrcoef([by[c]["difficulty"] for c in items], b)[0, 1] > 0.98


def test_transfers_of_all_groups(spark, answers):
    """A row per group, equal to one group at a time by hand; small, unknown and null groups."""
    d = answers.select(F.when(F.col("grp") == "t", "t").when(F.col("id") % 3 == 0, "u").when(F.col("id") % 500 == 1, "tiny").when(F.col("id") % 7 > 0, "v").alias("g"), *ITEMS)
    table, banks = irt.transfers(d, ITEMS, "g")
    rows = {r["target"]: r for r in table.collect()}
    assert set(rows) == {"t", "u", "v", "tiny"} and set(banks) == {"t", "u", "v"}
    assert rows["tiny"]["theta_correlation"] is None and 0 < rows["tiny"]["n_target"] < 300
    whole = [(r["g"], [r[c] for c in ITEMS]) for r in d.collect() if all(r[c] is not None for c in ITEMS)]
    for g, r in rows.items():
        if g == "tiny":
            continue
        native, pooled = ([x for h, x in whole if (h == g) == own] for own in (True, False))
        assert (r["n_target"], r["n_calibration_native"], r["n_calibration_pooled"]) == (len(native), len(native), len(pooled))
        x, theta = np.array(native), []
        for people, bank in ((np.array(pooled), banks[g][0]), (x, banks[g][1])):
            at = irt.begin(people.mean(0))
            for _ in range(500):
                before, at = at, irt.improved(irt.expected(people, np.ones(len(people)), *at), *at)
                if irt.moved(before, at) < irt.TOLERANCE:
                    break
            by = {q["item"]: q for q in bank}
            np.testing.assert_allclose([by[c]["discrimination"] for c in ITEMS], at[0], atol=1e-6)
            mass = irt.likelihoods(x, *at) * irt.prior()
            theta.append(mass @ irt.NODES / mass.sum(1))
        rank = [np.array([(v < w).sum() + ((v == w).sum() + 1) / 2 for w in v]) for v in map(lambda t: np.round(t, 9), theta)]
        assert r["theta_correlation"] == pytest.approx(np.corrcoef(*theta)[0, 1], abs=1e-6)
        assert r["theta_rank_correlation"] == pytest.approx(np.corrcoef(*rank)[0, 1], abs=1e-6)
        pri = [np.round(100 * probit.below(t), 1) for t in theta]
        assert r["mean_abs_pri_difference"] == pytest.approx(np.abs(pri[0] - pri[1]).mean(), abs=1e-3)
    with pytest.raises(ValueError):
        irt.transfer(d, ITEMS, "g", "tiny")
    assert irt.transfers(d, ITEMS, "g", ["nobody"])[0].first()["n_target"] == 0


def test_equal_rows_are_predicted_once(spark):
    rows = [(float(k % 3), "abc"[k % 3], float(k % 2)) for k in range(600)]
    d = boost.design(spark.createDataFrame(rows, "f double, g string, y double"), ["f"], "y", "g")
    models = {k: boost.Model(["f"], k / 10) for k in d.sums}
    counted = boost.predict(d, models, counted=True)
    assert sorted(r["n"] for r in counted.collect()) == [100.0] * 6
    a, b = (boost.metrics(d, p, 1) for p in (counted, boost.predict(d, models)))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)

"""Cleaning: codes, scales, battery, audit."""

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import clean as C
from tallyweave.plans import catalogue


def raw_rows(n=6, **changes):
    """Rows of a raw questionnaire; changes: column (dots as __) to a list of values."""
    countries = ["LV", "DE-W", "DE-E", "FR", "MT", "LV"]
    rows = []
    for i in range(n):
        r = {"uniqid": float(i), "serialid": float(i), "isocntry": countries[i % 6], "w1": 1.0, "w92": 1.0, "w22": 1.0}
        r |= {c: float((i * 7 + k) % 2) for k, c in enumerate(C.ACTIONS)}
        r |= {"qc6.14": 0.0, "qc6.15": 0.0, "qc6t": 1.0}
        r |= {c: 3.0 for c in C.HORIZONS}
        r |= {c: 2.0 for c in (*C.INFORMATION, *C.ATTITUDES)}
        r |= {c: 0.0 for c in ("qc3.15", "qc3t")} | {c: 1.0 for c in ("qc2a", "qc1a", "qc10", "qc11", "d10", "d11r2", "d25", "d60", "d63")} | {"d11": 40.0}
        rows.append(r)
    for c, values in changes.items():
        for r, v in zip(rows, values):
            r[c.replace("__", ".")] = v
    return rows


def raw(spark, n=6, **changes):
    rows = raw_rows(n, **changes)
    schema = ", ".join(f"`{c}` {'string' if c == 'isocntry' else 'double'}" for c in rows[0])
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def column(df, c):
    return [r[c] for r in df.orderBy("uniqid").select("uniqid", c).collect()]


def test_off_scale_codes_become_null(spark):
    d = C.clean(raw(spark, qc7_1=[5.0, 6.0]))
    assert column(d, "days_water")[:3] == [None, None, 3.0]
    assert column(d, "days_power") == [3.0] * 6


def test_flags_tell_not_applicable_from_dont_know(spark):
    d = C.clean(raw(spark, qc7_5=[5.0, 6.0, None, float("nan")]))
    assert list(zip(column(d, "days_medication_not_applicable"), column(d, "days_medication_dont_know")))[:4] == [(True, False), (False, True), (False, False), (False, False)]
    assert column(d, "days_medication")[2:4] == [None, None]


def test_scales_are_reversed(spark):
    d = C.clean(raw(spark, qc8_2=[1.0, 4.0]))
    assert column(d, "prep_feels_well_prepared")[:2] == [4.0, 1.0]
    assert column(d, "prep_feels_well_prepared_agree")[:2] == [True, False]


def test_two_denominators(spark):
    d = C.clean(raw(spark, 4, qc8_5=[1.0, 4.0, 6.0, 2.0]))
    r = d.agg(F.avg(F.col("prep_needs_more_info_agree").cast("double")).alias("a"), F.avg("prep_needs_more_info_agree_topline").alias("t")).first()
    assert r["a"] == pytest.approx(2 / 3) and r["t"] == 0.5


def test_unanswered_battery_is_null(spark):
    d = C.clean(raw(spark, qc6__15=[1.0]))
    assert all(column(d, c)[0] is None and column(d, c)[1] is not None for c in (*C.action_columns(), "n_actions", "act_other"))


def test_nothing_is_dropped_and_columns(spark):
    r = raw(spark, qc7_1=[6.0] * 6, qc6__15=[1.0] * 6)
    d = C.features(C.clean(r))
    assert d.count() == 6
    assert len(d.columns) == 97


def test_countries(spark):
    d = C.clean(raw(spark, isocntry=[" lv ", "DE-W", "DE-E", None]))
    assert column(d, "country")[:4] == ["LV", "DE-W", "DE-E", None]
    assert column(d, "country_grouped")[:4] == ["LV", "DE", "DE", None]


def test_audit(spark):
    rows = raw_rows(6, qc7_1=[6.0], qc7_2=[5.0])
    for r in rows:
        r["qc6t"] = min(sum(r[c] for c in C.ACTIONS) + r["qc6.14"], 5.0)
    r = spark.createDataFrame([tuple(x.values()) for x in rows], ", ".join(f"`{c}` {'string' if c == 'isocntry' else 'double'}" for c in rows[0]))
    a = C.audit(r, C.clean(r)).collect()
    assert len(a) == len({x["step"] for x in a}) == 7
    assert {x["step"]: x["cells_nulled"] for x in a}["2_durations"] == 2
    assert all(x["rows_lost"] == 0 for x in a)
    assert next(x for x in a if "own count" in x["step"])["reason"].startswith("0 of")


def test_missing_column_is_named(spark):
    with pytest.raises(KeyError, match="qc7_1"):
        C.clean(raw(spark).drop("qc7_1"))


def test_optional_columns(spark):
    assert C.clean(raw(spark).drop("d10", "qc10", "isocntry", "serialid")).count() == 6


def test_cleaning_is_repeatable(spark):
    r = raw(spark, qc7_1=[5.0])
    assert C.clean(r).collect() == C.clean(r).collect()


def test_audit_observed_while_writing(spark):
    """Counters taken during the write are those of two further scans; the counts reconcile as the audit says."""
    r = raw(spark, 6, qc7_1=[5.0, 6.0], qc6__15=[None, None, 1.0])
    cleaned, audit = C.clean_and_audit(r)
    assert sorted(map(tuple, audit.collect())) == sorted(map(tuple, C.audit(r, C.clean(r)).collect()))
    assert sorted(map(str, cleaned.collect())) == sorted(map(str, C.clean(r).collect()))
    one = C.reconcile(cleaned).first()
    assert f"{one['mismatches']} of {one['comparable']} " in [a["reason"] for a in audit.collect() if a["step"].endswith("own count")][0]


def test_wide_projections_are_compiled(spark):
    """The JVM interprets methods of over 8,000 bytes: what is fused into a longer one must run in pieces."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    df = catalogue.clean_questionnaire(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan()
    stats = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
    longest = max(stats.apply(k)._3().maxMethodCodeSize() for k in range(stats.size()))
    assert longest <= 8000 or int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_audit_query_writes_no_table(spark, monkeypatch):
    def frozen(df):
        raise AssertionError("the cleaned table is written")

    monkeypatch.setattr(C, "frozen", frozen)
    assert catalogue.clean_audit(spark, "/root/testdata/sf0.001").count() == len(C.STEPS)
    none = raw(spark).limit(0)
    assert [r["cells_nulled"] for r in C.audit(none, C.clean(none)).collect()] == [0] * len(C.STEPS)

"""From a raw questionnaire to result tables and pages."""

import numpy as np
import pytest
from test_cleaning import raw_rows

from tallyweave.operators import clean as C
from tallyweave.plans import survey_run
from tallyweave.sources.store import Reader


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(9)
    n, out = 3000, []
    base = raw_rows(1)[0]
    difficulty = np.linspace(-1, 2, 13)
    for i in range(n):
        r = dict(base, uniqid=float(i), serialid=float(i), isocntry=("LV", "FR", "DE-W", "DE-E", "MT", "SI")[i % 6])
        theta = rng.normal()
        for k, c in enumerate(C.ACTIONS):
            r[c] = float(rng.random() < 1 / (1 + np.exp(-1.2 * (theta - difficulty[k]))))
        for c in (*C.HORIZONS, *C.INFORMATION, *C.ATTITUDES):
            r[c] = float(rng.integers(1, 7))
        r |= {"d10": float(rng.integers(1, 3)), "d11": float(rng.integers(15, 90)), "d11r2": float(rng.integers(1, 5)), "d25": float(rng.integers(1, 4)), "d60": float(rng.integers(1, 4)), "d63": float(rng.integers(1, 6))}
        r["qc6t"] = min(sum(r[c] for c in C.ACTIONS), 5.0)
        out.append(tuple(r.values()))
    return spark.createDataFrame(out, ", ".join(f"`{c}` {'string' if c == 'isocntry' else 'double'}" for c in base)).cache()


@pytest.fixture(scope="module")
def database(spark):
    spark.sql("DROP DATABASE IF EXISTS tw_run CASCADE")
    spark.sql("CREATE DATABASE tw_run")
    spark.catalog.setCurrentDatabase("tw_run")
    yield "tw_run"
    spark.catalog.setCurrentDatabase("default")
    spark.sql("DROP DATABASE tw_run CASCADE")


def test_run(spark, raw, database):
    code, text = survey_run.run_all(spark, raw, iterations=3)
    assert code == 1 and text.count("\n") == 6
    years = {}
    rng = np.random.default_rng(2)
    for year, yes_no in ((2021, (1, 0)), (2022, (1, 2))):
        rows = [(float(rng.uniform(0.5, 2)), int(rng.choice(yes_no)), int(rng.choice(yes_no)), float(rng.integers(1, 6))) for _ in range(200)]
        years[year] = spark.createDataFrame(rows, f"wgt double, A3_alerts_{year} int, PREPB_alerts int, ST_STG1 double")
    crosswalk = spark.createDataFrame([("signed_up_alerts", "alerts", "exact")], "home_item string, other_item string, match_quality string")
    assert survey_run.run_conversion(spark, years, crosswalk)[0] == 0
    reader = Reader(spark, database)
    p = survey_run.pages(reader)
    assert set(p) == {"overview", "gap", "countries", "horizon", "items", "percentiles", "drivers", "composite", "transfer", "conversion"}
    assert all(df.count() > 0 for page in p.values() for df in page.values())
    assert len(reader.tables()) == 37
    assert p["gap"]["table"].groupBy("scope").count().collect() and p["items"]["bank"].count() == 13
    assert spark.table("conversion_by_year").where("n_rows = 200").count() == 2
    assert spark.table("survey_audit").count() == 8
    assert len(spark.table("survey_respondents").columns) == 97


def test_pages_need_their_tables(spark):
    spark.sql("DROP DATABASE IF EXISTS tw_empty CASCADE")
    spark.sql("CREATE DATABASE tw_empty")
    assert survey_run.pages(Reader(spark, "tw_empty")) == {}
    spark.sql("DROP DATABASE tw_empty")

"""From a raw questionnaire to all result tables, as named steps that can run by themselves.

``run_all`` cleans the survey and writes the respondent table and the gap, horizon, item-response,
driver, hold-out and percentile tables for the union and each focus country; ``run_conversion`` does
the same for yearly files of the paired survey. Tables go to the current database; ``Reader`` and
``pages`` read them back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import estimators as E
from ..operators import boost, clean, conversion, gate, indices, irt, probit, quantile, tables
from ..sources.store import Reader, write_table

FOCUS = ("LV", "FR")
DOMAINS = {n: f"days_{n}" for n in clean.HORIZONS.values()}
NOT_APPLICABLE = {"medication": "days_medication_not_applicable"}
ITEMS = {n: f"act_{n}" for n in clean.ACTIONS.values()}
# Labels of the measures, and the demographics that predict horizons.
ITEM_LABELS = {
    "emergency_food_drink": "Emergency food & drink stock",
    "emergency_water": "Emergency water (cooking, hygiene)",
    "flashlight_candles": "Flashlight or candles",
    "battery_radio": "Battery-powered radio",
    "first_aid_kit": "First-aid kit",
    "documents_safe": "Key documents copied / stored safely",
    "grab_bag": "Grab-bag ready for evacuation",
    "signed_up_alerts": "Signed up for official alerts",
    "training_exercise": "Took part in training or a drill",
    "knows_official_plan": "Knows the local emergency plan",
    "family_contact_plan": "Agreed family contact method",
    "neighbourhood_discussion": "Discussed protection with neighbours",
    "home_protection": "Invested in home protection",
}
PROBIT_NUMERIC, PROBIT_CATEGORICAL = ("age", "bill_difficulties"), ("community_type", "social_class", "gender")


def scopes(df: DataFrame, focus: Sequence[str] = FOCUS) -> dict[str, tuple[DataFrame, str]]:
    """Suffix to (rows, weight): the union with its weight, each focus country with the national one."""
    own = {c.lower(): (df.where(F.col("country_grouped") == c), "w_national") for c in focus}
    return {"eu": (df, "w_eu"), **own}


def labelled(df: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in ITEM_LABELS.items() for x in kv])
    return df.withColumn("label", F.try_element_at(names, F.col("item")))


def etl(spark: SparkSession, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The feature table, written as ``survey_respondents``, and the audit with the feature step."""
    cleaned, audit = clean.clean_and_audit(raw)
    n = write_table(clean.features(cleaned), "survey_respondents")
    last = audit.orderBy(F.desc("step")).limit(1).select(F.lit("8_features"), "rows_out", F.lit(n), F.col("rows_out") - n, F.lit(0), F.lit("awareness, any action and answered horizons added"))
    audit = audit.union(last)
    write_table(audit, "survey_audit")
    return spark.table("survey_respondents"), audit


def gap_tables(df: DataFrame, focus: Sequence[str] = FOCUS) -> None:
    for name, (rows, w) in scopes(df, focus).items():
        write_table(labelled(indices.gap_table(rows, ITEMS, w, "saw_info")), f"gap_table_{name}")
    write_table(indices.gap_cells(df, ITEMS, "w_eu", "saw_info"), "gap_cells_eu")
    p = df.withColumn("pgi", indices.person_gap(list(ITEMS.values()), "saw_info"))
    write_table(p.select("uniqid", "country_grouped", "pgi", "saw_info", "n_actions", "w_national", "w_eu"), "pgi_respondents")


def horizon_tables(spark: SparkSession, df: DataFrame, focus: Sequence[str] = FOCUS) -> None:
    t = indices.horizon_index(df, DOMAINS, NOT_APPLICABLE)
    write_table(indices.horizon_by_country(t, "w_national"), "rhi_by_country")
    for name, (rows, w) in scopes(t, focus).items():
        write_table(indices.band_distribution(rows, w), f"rhi_bands_{name}")
        write_table(indices.binding_profile(rows, DOMAINS, w), f"rhi_binding_{name}")
    write_table(t.select("uniqid", "country_grouped", "rhi_band", "rhi_days", "rhi_binding_domain", "rhi_n_domains", "rhi_partial", "w_national", "w_eu"), "rhi_respondents")
    fits, skipped = {}, {}
    for name, c in DOMAINS.items():
        try:
            fits[name] = probit.fit(df, c, PROBIT_NUMERIC, PROBIT_CATEGORICAL)
        except ValueError as e:
            skipped[name] = str(e)
    if fits:
        rows = [tuple(r.values()) for r in probit.summary(fits)]
        write_table(spark.createDataFrame([(*r[:6], bool(r[6])) for r in rows], "domain string, n long, accuracy double, baseline double, lift double, pseudo_r2 double, beats_baseline boolean"), "rhi_model_summary")
        best = probit.best_domain(fits)["domain"]
        found = [(best, r["term"], r["coef"], r["std_err"], r["p_value"], bool(r["significant"])) for r in fits[best]["coefficients"]]
        write_table(spark.createDataFrame(found, "domain string, term string, coef double, std_err double, p_value double, significant boolean"), "rhi_model_strongest")
    for name, why in skipped.items():
        print(f"horizon model of {name} left out: {why}")


def item_tables(spark: SparkSession, df: DataFrame) -> None:
    items = list(ITEMS.values())
    counts = irt.patterns(df, items).cache()
    bank = irt.fit_2pl(counts, items)
    short = lambda t: t.withColumn("item", F.regexp_replace("item", "^act_", ""))
    write_table(labelled(short(irt.bank_frame(spark, bank))), "item_bank")
    write_table(short(irt.item_fit(counts, bank)), "item_fit")
    counts.unpersist()
    named = [{**r, "item": r["item"].removeprefix("act_")} for r in bank]
    checks = [(r["check"], r["b_harder"], r["b_easier"], bool(r["pass"])) for r in irt.face_validity(named)]
    write_table(spark.createDataFrame(checks, "check string, b_harder double, b_easier double, pass boolean"), "item_face_validity")
    write_table(irt.dimensionality(irt.bank_frame(spark, named)), "item_dimensionality")
    scored = irt.score_persons(df, items, bank, "theta_action").withColumn("pri", irt.theta_to_score("theta_action"))
    write_table(scored.select("uniqid", "country_grouped", "theta_action", "pri", "w_national", "w_eu"), "pri_respondents")
    by = spark.table("pri_respondents").where("country_grouped IS NOT NULL AND pri IS NOT NULL").groupBy(F.col("country_grouped").alias("country"))
    write_table(by.agg(E.weighted_mean("pri", "w_national").alias("mean_pri"), F.count("*").alias("n")).orderBy(F.desc("mean_pri")), "pri_by_country")


def driver_tables(spark: SparkSession, df: DataFrame, iterations: int = 400) -> None:
    p = df.withColumn("pgi", indices.person_gap(list(ITEMS.values()), "saw_info")).where("pgi IS NOT NULL")
    names = [f for f in (*boost.BARRIERS, *boost.INFORMATION, *boost.CONTEXT, *boost.DEMOGRAPHICS) if f in p.columns]
    audit = tables.variance_audit(p, [f for f in names if f not in boost.CATEGORICAL])
    write_table(audit, "gap_variance_audit")
    flat = {r["column"] for r in spark.table("gap_variance_audit").where(F.col("drop")).collect()}
    kept = [f for f in names if f not in flat]
    demographic = [f for f in boost.DEMOGRAPHICS if f in kept]
    write_table(tables.level_spread(p, ["prep_no_time_or_money", "prep_needs_more_info"], "pgi").withColumnRenamed("spread", "spread_agree_minus_disagree"), "gap_barrier_direction")
    rows = [tuple(r.values()) for r in boost.comparison(p, kept, demographic, "pgi", "country_grouped", iterations)]
    write_table(spark.createDataFrame(rows, "model string, n_features long, r2_oof double, mae_oof double"), "gap_model_comparison")
    d = boost.design(p, kept, "pgi", "country_grouped")
    rows = [tuple(r.values()) for r in boost.importance(boost.train(d, [(None, kept)], iterations)[0], d)]
    write_table(spark.createDataFrame(rows, "feature string, mean_abs_shap double, mean_shap double, gain double"), "gap_importance")


def holdout_tables(spark: SparkSession, df: DataFrame, focus: Sequence[str] = FOCUS) -> None:
    items = list(ITEMS.values())
    table, banks = irt.transfers(df, items, "country_grouped", focus)
    few = [r["target"] for r in table.where("theta_correlation IS NULL").collect()]
    if few:
        raise ValueError(f"holdout_tables: too few complete cases in {', '.join(few)}")
    write_table(table.withColumnRenamed("target", "country"), "holdout_transfer")
    compared = None
    for c, (pooled, native) in banks.items():
        d = irt.difficulty_comparison(spark, pooled, native).withColumn("country", F.lit(c))
        compared = d if compared is None else compared.unionByName(d)
    if compared is not None:
        write_table(labelled(compared.withColumn("item", F.regexp_replace("item", "^act_", ""))), "holdout_difficulty_compare")


def percentile_tables(spark: SparkSession, df: DataFrame, focus: Sequence[str] = FOCUS) -> None:
    scored = spark.table("pri_respondents").select("uniqid", "pri").join(df, "uniqid")
    for name, (rows, w) in scopes(scored, focus).items():
        write_table(quantile.percentile_table(rows, "pri", "age_band", w), f"pri_percentiles_{name}")


def run_all(spark: SparkSession, raw: DataFrame, focus: Sequence[str] = FOCUS, iterations: int = 400) -> tuple[int, str]:
    """All tables; the validation gate's (exit code, report)."""
    df, _ = etl(spark, raw)
    result = gate.report(gate.run_gate(df, gate.survey_checks()))
    gap_tables(df, focus)
    horizon_tables(spark, df, focus)
    item_tables(spark, df)
    driver_tables(spark, df, iterations)
    holdout_tables(spark, df, focus)
    percentile_tables(spark, df, focus)
    return result


def run_conversion(spark: SparkSession, years: Mapping[int, DataFrame], crosswalk: DataFrame | None = None) -> tuple[int, str]:
    """Tables of the paired survey. Each year's columns are found and coerced by its own headers and codings,
    given one name per item, and stacked. (exit code, message) of the pairing gate."""
    from ..sources.readers import stack_years

    report, frames, message = [], {}, (1, "no year")
    for year, df in sorted(years.items()):
        found = conversion.discover_columns(df.columns)
        report += [(r["item"], r["label"], r["awareness_col"], r["action_col"], r["paired"], r["claimed_twice"], year) for r in found]
        message = conversion.pairing_gate(found)
        paired = [r for r in found if r["paired"]]
        w = conversion.find_weight(df.columns)
        stage = next((c for c in df.columns if c.upper() == "ST_STG1"), None)
        cols = [F.col(f"`{r[k]}`").cast("string").alias(f"{p}_{r['item']}") for r in paired for k, p in (("awareness_col", "aware"), ("action_col", "act"))]
        cols += [(F.col(f"`{w}`").try_cast("double") if w else F.lit(None).cast("double")).alias("weight"), (F.col(f"`{stage}`").try_cast("double") if stage else F.lit(None).cast("double")).alias("stage")]
        frames[year] = conversion.yes_no(df.select(*cols), [f"{p}_{r['item']}" for r in paired for p in ("aware", "act")])
    schema = "item string, label string, awareness_col string, action_col string, paired boolean, claimed_twice boolean, survey_year int"
    write_table(spark.createDataFrame(report, schema), "conversion_columns")
    data = stack_years(frames) if frames else None
    items = [i for i in conversion.ITEM_LABELS if data is not None and f"aware_{i}" in data.columns]
    if not items:
        return 1, "no item has both an awareness and an action column"
    pairs = {i: (f"aware_{i}", f"act_{i}") for i in items}
    weight = "weight" if data.where("weight IS NOT NULL").limit(1).count() else None
    write_table(conversion.aci_table(data, pairs, weight), "conversion_index")
    write_table(conversion.aci_table(data, pairs, weight, by=["survey_year"]), "conversion_by_year", "each year asks other people: not a panel")
    write_table(conversion.stage_distribution(data, "stage", weight), "conversion_stages")
    if crosswalk is not None and not Reader(spark, spark.catalog.currentDatabase()).require("gap_table_eu"):
        write_table(conversion.crosswalk_compare(crosswalk, spark.table("conversion_index"), spark.table("gap_table_eu")), "conversion_compared")
    return message


def pages(reader: Reader, focus: Sequence[str] = FOCUS) -> dict[str, dict[str, DataFrame]]:
    """The frames behind each page of a dashboard, from result tables alone; pages that lack a table are left out."""
    suffix = ["eu", *[c.lower() for c in focus]]
    scoped = lambda table: " UNION ALL ".join(f"SELECT '{s}' AS scope, * FROM {table}_{s}" for s in suffix)
    each = lambda *tables: [f"{t}_{s}" for t in tables for s in suffix]
    persons = "SELECT r.country_grouped, pri, rhi_band, pgi, r.w_national AS w FROM rhi_respondents r JOIN pri_respondents p USING (uniqid) JOIN pgi_respondents g USING (uniqid) WHERE pri IS NOT NULL AND rhi_band IS NOT NULL AND pgi IS NOT NULL"
    plan = {
        "overview": (["gap_cells_eu", "rhi_bands_eu"], {"cells": "SELECT * FROM gap_cells_eu", "bands": "SELECT * FROM rhi_bands_eu ORDER BY band"}),
        "gap": (each("gap_table"), {"table": scoped("gap_table") + " ORDER BY scope, conversion DESC"}),
        "countries": (["rhi_by_country", "pri_by_country"], {"horizon": "SELECT * FROM rhi_by_country ORDER BY below_target_certain DESC", "score": "SELECT * FROM pri_by_country ORDER BY mean_pri DESC"}),
        "horizon": (each("rhi_bands", "rhi_binding"), {"bands": scoped("rhi_bands"), "binding": scoped("rhi_binding")}),
        "items": (["item_bank", "item_fit"], {"bank": "SELECT * FROM item_bank JOIN item_fit USING (item) ORDER BY difficulty"}),
        "percentiles": (each("pri_percentiles"), {"table": scoped("pri_percentiles")}),
        "drivers": (["gap_model_comparison", "gap_importance"], {"models": "SELECT * FROM gap_model_comparison", "features": "SELECT * FROM gap_importance ORDER BY mean_abs_shap DESC LIMIT 15"}),
        "composite": (["rhi_respondents", "pri_respondents", "pgi_respondents"], {"persons": persons}),
        "transfer": (["holdout_transfer", "holdout_difficulty_compare"], {"table": "SELECT * FROM holdout_transfer ORDER BY country", "items": "SELECT * FROM holdout_difficulty_compare ORDER BY country, delta"}),
        "conversion": (["conversion_index", "conversion_by_year", "conversion_stages"], {"index": "SELECT * FROM conversion_index ORDER BY aci DESC", "years": "SELECT * FROM conversion_by_year ORDER BY survey_year, aci DESC", "stages": "SELECT * FROM conversion_stages ORDER BY stage"}),
    }
    return {page: {k: reader.query(sql) for k, sql in queries.items()} for page, (needed, queries) in plan.items() if not reader.require(*needed)}

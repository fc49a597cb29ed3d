"""Survey-shaped views over the star schema, as DataFrames and as SQL for the oracle.

Line items play respondents: nations are countries, quantities weights, remainders of keys the codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators.frozen import compiled

DOMAINS = {n: f"d{i}" for i, n in enumerate(("water", "power", "gas_heating", "food", "medication"), 1)}
NOT_APPLICABLE = {n: f"na{i}" for i, n in enumerate(DOMAINS, 1)}
ACTIONS = {f"a{i}": f"act{i}" for i in range(1, 6)}
BATTERY = ("i_click", "i_view", "i_purchase", "i_error", "i_signup")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    compiled(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", F.col("n_name").alias("country"), "n_regionkey", F.col("r_name").alias("region"))


def survey_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with country, weights and raw codes."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    t = read(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    t = t.join(nations(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    code = lambda c: (c.cast("long") % 6 + 1).cast("int")
    bit = lambda c: c.cast("int")
    c = F.col
    return t.select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        "country",
        "region",
        c("l_quantity").alias("w_national"),
        (c("l_quantity") * (1 + c("l_tax"))).alias("w_eu"),
        F.when(c("n_regionkey") != 4, c("l_quantity")).alias("w_legacy"),
        c("l_extendedprice").alias("price"),
        c("l_linenumber").alias("age_band"),
        code(c("l_partkey")).alias("h1"),
        code(c("l_partkey") + c("l_linenumber")).alias("h2"),
        code(c("l_quantity")).alias("h3"),
        code(c("l_suppkey")).alias("h4"),
        code(c("l_orderkey")).alias("h5"),
        code(c("l_suppkey") + c("l_linenumber")).alias("q_info"),
        code(c("l_partkey") + c("l_suppkey")).alias("q_prep"),
        code(F.round(c("l_discount") * 100)).alias("q_barrier"),
        bit(c("l_linestatus") == "O").alias("a1"),
        bit(c("l_discount") >= F.lit(0.05)).alias("a2"),
        bit(c("l_tax") >= F.lit(0.04)).alias("a3"),
        bit(c("l_quantity") >= 25).alias("a4"),
        bit(c("l_extendedprice") >= 50000).alias("a5"),
        (c("l_orderkey") % 17 == 0).alias("adk"),
    )


def survey_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned survey."""
    t = survey_raw(spark, sf_dir)
    new = {"country_grouped": X.merged_codes("country", {"NATION_1": "NATION_0"})}
    for i in range(1, 6):
        new[f"d{i}"] = X.off_scale(f"h{i}")
        new[f"na{i}"] = X.has_code(f"h{i}", 5)
        new[f"act{i}"] = X.null_if(F.col(f"a{i}").cast("double"), F.col("adk"))
    for q in ("info", "prep", "barrier"):
        new[q] = X.reversed_scale(f"q_{q}")
    t = t.withColumns(new)
    return t.withColumns({"aware": X.agrees("info"), "prep_agree": X.agrees("prep"), "prep_topline": X.agrees_topline("prep")})


SURVEY_SQL = """
WITH raw AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, n_name AS country, r_name AS region,
    l_quantity AS w_national, l_quantity * (1 + l_tax) AS w_eu,
    CASE WHEN n_regionkey <> 4 THEN l_quantity END AS w_legacy,
    l_extendedprice AS price, l_linenumber AS age_band,
    CAST(l_partkey % 6 + 1 AS INT) AS h1,
    CAST((l_partkey + l_linenumber) % 6 + 1 AS INT) AS h2,
    CAST(CAST(l_quantity AS BIGINT) % 6 + 1 AS INT) AS h3,
    CAST(l_suppkey % 6 + 1 AS INT) AS h4,
    CAST(l_orderkey % 6 + 1 AS INT) AS h5,
    CAST((l_suppkey + l_linenumber) % 6 + 1 AS INT) AS q_info,
    CAST((l_partkey + l_suppkey) % 6 + 1 AS INT) AS q_prep,
    CAST(CAST(round(l_discount * 100) AS BIGINT) % 6 + 1 AS INT) AS q_barrier,
    CAST(l_linestatus = 'O' AS INT) AS a1,
    CAST(l_discount >= 0.05E0 AS INT) AS a2,
    CAST(l_tax >= 0.04E0 AS INT) AS a3,
    CAST(l_quantity >= 25 AS INT) AS a4,
    CAST(l_extendedprice >= 50000 AS INT) AS a5,
    l_orderkey % 17 = 0 AS adk
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
), s AS (
  SELECT *, CASE WHEN country = 'NATION_1' THEN 'NATION_0' ELSE country END AS country_grouped,
""" + ",\n".join(
    f"    CASE WHEN h{i} NOT IN (5, 6) THEN CAST(h{i} AS DOUBLE) END AS d{i}, h{i} = 5 AS na{i}, CASE WHEN NOT adk THEN CAST(a{i} AS DOUBLE) END AS act{i}" for i in range(1, 6)
) + """,
    CASE WHEN q_info NOT IN (5, 6) THEN CAST(5 - q_info AS DOUBLE) END AS info,
    CASE WHEN q_prep NOT IN (5, 6) THEN CAST(5 - q_prep AS DOUBLE) END AS prep,
    CASE WHEN q_barrier NOT IN (5, 6) THEN CAST(5 - q_barrier AS DOUBLE) END AS barrier,
    CASE WHEN q_info NOT IN (5, 6) THEN 5 - q_info >= 3 END AS aware
  FROM raw
)
"""

RHI_SQL = SURVEY_SQL + """, n AS (
  SELECT *, (d1 IS NOT NULL)::INT + (d2 IS NOT NULL)::INT + (d3 IS NOT NULL)::INT + (d4 IS NOT NULL)::INT + (d5 IS NOT NULL)::INT AS k,
    na1::INT + na2::INT + na3::INT + na4::INT + na5::INT AS n_na, least(d1, d2, d3, d4, d5) AS low
  FROM s
), r AS (
  SELECT *, CASE WHEN k >= 3 THEN low END AS rhi_band,
    CASE WHEN k >= 3 THEN CASE low WHEN 1 THEN 1.0E0 WHEN 2 THEN 2.5E0 WHEN 3 THEN 5.5E0 WHEN 4 THEN 10.0E0 END END AS rhi_days,
    CASE WHEN k >= 3 THEN CASE WHEN d1 = low THEN 'water' WHEN d2 = low THEN 'power' WHEN d3 = low THEN 'gas_heating' WHEN d4 = low THEN 'food' ELSE 'medication' END END AS rhi_binding_domain,
    k AS rhi_n_domains, CASE WHEN k >= 3 THEN k + n_na < 5 END AS rhi_partial
  FROM n
)
"""


def _questions() -> dict[str, str]:
    """Column of the raw questionnaire to its expression over line items, in SQL that Spark and the oracle share."""
    from ..operators import clean as C

    code = lambda k, top: f"CAST((l_partkey + {k} * l_linenumber + l_suppkey) % {top} + 1 AS INT)"
    out = {"uniqid": "l_orderkey * 10 + l_linenumber", "serialid": "l_orderkey"}
    out["isocntry"] = "CASE l_suppkey % 4 WHEN 0 THEN ' lv ' WHEN 1 THEN 'DE-W' WHEN 2 THEN 'de-e' END"
    out |= {"w1": "l_quantity", "w92": "l_quantity * (1 + l_tax)", "w22": "CASE WHEN l_linenumber <> 4 THEN l_quantity END"}
    out |= {c: f"CASE WHEN l_linenumber % 7 <> {k % 7} THEN CAST((l_partkey + {k} * l_suppkey) % 3 = 0 AS INT) END" for k, c in enumerate(C.ACTIONS)}
    out |= {"qc6.14": "CAST(l_partkey % 5 = 0 AS INT)", "qc6.15": "CAST(l_orderkey % 17 = 0 AS INT)", "qc6t": "CAST((l_partkey + l_linenumber) % 7 AS INT)"}
    for k, c in enumerate((*C.HORIZONS, *C.INFORMATION, *C.ATTITUDES)):
        out[c] = f"CASE WHEN (l_orderkey + {k}) % 11 <> 0 THEN {code(k, 6)} END"
    return out | {c: code(k, 9) for k, c in enumerate((*C.CONTEXT, *C.DEMOGRAPHICS))}


def questionnaire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as answers to the survey's questionnaire, codes as they are asked."""
    return read(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(c) for c, e in _questions().items()])


def questionnaire_sql() -> str:
    """``questionnaire`` as q, and its cleaned form as c."""
    from ..operators import clean as C

    raw = ", ".join(f'{e} AS "{c}"' for c, e in _questions().items())
    num = lambda c: f'CAST("{c}" AS DOUBLE)'
    on = lambda c: f'(CASE WHEN "{c}" NOT IN ({C.NOT_APPLICABLE}, {C.DONT_KNOW}) THEN {num(c)} END)'
    cols = [f'{num("uniqid")} AS uniqid', f'{num("serialid")} AS serialid', "isocntry"]
    cols += [f"{num(c)} AS {n}" for c, n in C.WEIGHTS.items()]
    act = {f"act_{n}": f'(CASE WHEN "qc6.15" <> 1 THEN {num(c)} END)' for c, n in [*C.ACTIONS.items(), ("qc6.14", "other")]}
    cols += [f"{e} AS {n}" for n, e in act.items()]
    cols += [f'{num("qc6.15")} AS actions_dk', f'{num("qc6t")} AS n_actions_survey_banded']
    own = [e for n, e in act.items() if n != "act_other"]
    cols.append(f"CASE WHEN coalesce({', '.join(own)}) IS NOT NULL THEN {' + '.join(f'coalesce({e}, 0)' for e in own)} END AS n_actions")
    for c, n in C.HORIZONS.items():
        cols += [f"{on(c)} AS days_{n}", f'coalesce("{c}" = {C.NOT_APPLICABLE}, false) AS days_{n}_not_applicable', f'coalesce("{c}" = {C.DONT_KNOW}, false) AS days_{n}_dont_know']
    for prefix, items in (("info", C.INFORMATION), ("prep", C.ATTITUDES)):
        for c, n in items.items():
            r = f"({C.SCALE_TOP + 1}.0E0 - {on(c)})"
            cols += [f"{r} AS {prefix}_{n}", f"{r} >= 3 AS {prefix}_{n}_agree", f"CAST(coalesce({r} >= 3, false) AS BIGINT) AS {prefix}_{n}_agree_topline"]
    cols += [f"{num(c)} AS {n}" for c, n in (C.CONTEXT | C.DEMOGRAPHICS).items()]
    country = "upper(trim(isocntry))"
    cols += [f"{country} AS country", f"CASE WHEN {country} IN ({', '.join(repr(c) for c in C.MERGED_TERRITORIES)}) THEN 'DE' ELSE {country} END AS country_grouped"]
    return f"WITH q AS (SELECT {raw} FROM lineitem), c AS (SELECT {', '.join(cols)} FROM q)"


def battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per user and day: which kinds of event occurred."""
    e = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"))
    return e.agg(*[F.max((F.col("event_type") == c[2:]).cast("int")).alias(c) for c in BATTERY])


BATTERY_SQL = "WITH battery AS (SELECT user_id, CAST(ts AS DATE) AS day, " + ", ".join(f"max(CAST(event_type = '{c[2:]}' AS INT)) AS {c}" for c in BATTERY) + " FROM events GROUP BY 1, 2)\n"


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per order: score, band, gap, weight and the customer's nation."""
    from ..operators.indices import person_gap

    s = survey_lines(spark, sf_dir)
    lines = s.withColumn("gap", person_gap(["act1"], "aware"))
    o = lines.groupBy("l_orderkey").agg(
        F.avg((F.col("a1") + F.col("a2") + F.col("a3")) / 3.0 * 100).alias("pri"),
        F.min(F.least("d1", "d2", "d3")).alias("rhi_band"),
        F.avg("gap").alias("pgi"),
        F.sum("w_national").alias("w"),
    )
    c = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    c = c.join(nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_orderkey").alias("l_orderkey"), "country")
    return o.join(c, "l_orderkey")


ORDER_SCORES_SQL = SURVEY_SQL + """, o AS (
  SELECT l_orderkey, avg((a1 + a2 + a3) / 3.0E0 * 100) AS pri, min(least(d1, d2, d3)) AS rhi_band,
    avg(CASE WHEN aware AND act1 IS NOT NULL THEN 1 - act1 END) AS pgi, sum(w_national) AS w
  FROM s GROUP BY l_orderkey
), os AS (
  SELECT o.*, n_name AS country FROM o JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
)
"""


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line item and year; codings change between even (0/1) and odd (1/2) years, 9 is a refusal."""
    t = read(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate")

    def coded(yes):
        return F.when(F.col("l_tax") >= F.lit(0.08), 9).when(yes, 1).when(year % 2 == 0, 0).otherwise(2)

    return t.select(year.alias("survey_year"), F.col("l_quantity").alias("w"), coded(F.col("l_returnflag") != "N").alias("A3_supplies"), coded(F.col("l_linestatus") == "O").alias("PREPB_supplies"))


WAVES_SQL = """
WITH w AS (
  SELECT year(l_shipdate) AS survey_year, l_quantity AS w,
    CASE WHEN l_tax >= 0.08E0 THEN NULL WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS aware,
    CASE WHEN l_tax >= 0.08E0 THEN NULL WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS act
  FROM lineitem
), v AS (SELECT * FROM w WHERE aware IS NOT NULL AND act IS NOT NULL AND w > 0)
"""

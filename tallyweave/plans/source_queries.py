"""Queries over sources and sinks: tables go out in a format and come back through its reader.

What is written goes to spark.checkpoint.dir, which a cluster shares, or to a local folder if the master is
local; result tables go to the warehouse. Each call writes under a name of its own.
"""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import gate, indices, irt, tables
from ..sources import readers, store
from . import survey_run
from . import views as V
from .catalogue import BANK, SQL, TARGETS, query, rounded, survey


def place(spark: SparkSession, name: str) -> str:
    """A new path that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("place: on a cluster spark.checkpoint.dir must name a shared folder")
        shared = "file://" + tempfile.mkdtemp(prefix="tallyweave-io-")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}-{name}"


def put(spark: SparkSession, path: str, content: bytes) -> None:
    fs, p = readers._file_system(spark, path)
    out = fs.create(p)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


@query("SELECT n_nationkey::INT AS n_nationkey, n_name, n_regionkey::INT AS n_regionkey FROM nation")
def csv_round_trip(spark, sf):
    path = place(spark, "nation.csv")
    store.write_csv(V.read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return readers.read_csv(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT p_partkey, p_brand, p_size FROM part")
def parquet_round_trip(spark, sf):
    path = place(spark, "part")
    store.write_parquet(V.read(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), path)
    return readers.read_parquet(spark, path)


@query("SELECT 2000 + l_linenumber AS survey_year, count(*) AS n, round(sum(l_quantity), 4) AS quantity, count(CASE WHEN l_linenumber % 2 = 0 THEN l_tax END) AS n_tax FROM lineitem WHERE l_linenumber IN (1, 2, 4) GROUP BY 1")
def yearly_folder(spark, sf):
    """Years as files of a folder, with a column that odd years lack; only the years asked for that are there."""
    folder = place(spark, "years")
    t = V.read(spark, sf, "lineitem")
    for k in (1, 2, 3, 4):
        own = t.where(F.col("l_linenumber") == k).select("l_quantity", *(["l_tax"] if k % 2 == 0 else []))
        store.write_csv(own, f"{folder}/survey_{2000 + k}.csv")
    data, _ = readers.load_years(spark, folder, [1999, 2001, 2002, 2004])
    out = data.groupBy(F.col("survey_year").cast("long").alias("survey_year")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.count("l_tax").alias("n_tax"))
    return rounded(out, 4)


@query("SELECT n_nationkey::INT AS n_nationkey, n_name FROM nation")
def zip_largest_member(spark, sf):
    rows = V.read(spark, sf, "nation").select("n_nationkey", "n_name").toPandas()  # a table of 25 rows
    raw, path = io.BytesIO(), place(spark, "survey_2021.zip")
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("small.csv", "a\n1\n")
        z.writestr("readme.txt", "x" * 10_000)
        z.writestr("large.csv", rows.to_csv(index=False))
    put(spark, path, raw.getvalue())
    return readers.read_year(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("SELECT r_name AS home_item, n_name AS other_item, CAST(n_nationkey % 2 AS VARCHAR) AS note FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0")
def crosswalk_scan(spark, sf):
    path, n = place(spark, "crosswalk.csv"), V.nations(spark, sf)
    pairs = n.select(F.col("region").alias("home_item"), F.when(F.col("n_nationkey") % 3 != 0, F.col("country")).alias("other_item"), (F.col("n_nationkey") % 2).cast("string").alias("note"))
    store.write_csv(pairs, path)
    return readers.read_crosswalk(spark, path)


@query("SELECT n_regionkey::BIGINT AS n_regionkey, count(*) AS n, min(n_name) AS first_name FROM nation WHERE n_nationkey > 3 AND n_name IS NOT NULL GROUP BY 1")
def result_store(spark, sf):
    """Written twice (the second replaces the first), found by the reader, queried by SQL with predicates."""
    name = "tw_nation"
    nation = V.read(spark, sf, "nation")
    store.write_table(nation.limit(1), name)
    store.write_table(nation, name, "nations")
    reader = store.Reader(spark, "no_such_database", spark.catalog.currentDatabase())
    if reader.require(name):
        raise RuntimeError(f"result_store: {name} is missing")
    return reader.query(f"SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, count(*) AS n, min(n_name) AS first_name FROM {name} WHERE n_nationkey > 3 AND n_name IS NOT NULL GROUP BY 1 ORDER BY 1")


USED = ("l_quantity", "l_tax")


@query(f"SELECT ordinal_position::INT - 1 AS position, column_name AS variable, CASE column_name WHEN 'l_tax' THEN 'Tax rate' ELSE '' END AS label, column_name = 'l_returnflag' AS has_value_labels, column_name IN {USED} AS used FROM information_schema.columns WHERE table_name = 'lineitem'")
def metadata_inventory(spark, sf):
    """The schema alone: no row is read."""
    schema = readers.read_schema(spark, f"{sf}/lineitem.parquet")
    return store.variable_inventory(spark.createDataFrame([], schema), {"l_tax": "Tax rate"}, ["l_returnflag"], USED)


STATUS = {"F": "Filled", "O": "Open"}


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS \"o_orderstatus — Status of the order\" FROM orders")
def decoded_headers(spark, sf):
    return store.labelled(V.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), {"o_orderstatus": STATUS}, {"o_orderstatus": "Status of the order"})


@query(
    r"""WITH f AS (SELECT o_orderstatus AS value, count(*) AS n, round(100.0E0 * count(*) / (SELECT count(*) FROM orders), 1) AS pct FROM orders GROUP BY 1)
SELECT '# Codebook' || chr(10) || chr(10) || '## o_orderstatus: Status' || chr(10) || chr(10) || '| value | label | n | pct |' || chr(10) || '| --- | --- | --- | --- |' || chr(10)
  || string_agg('| ' || value || ' | ' || CASE value WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE value END || ' | ' || n || ' | ' || regexp_replace(CAST(pct AS VARCHAR), '\.0$', '') || ' |', chr(10) ORDER BY value) || chr(10) AS markdown FROM f"""
)
def codebook_markdown(spark, sf):
    return spark.createDataFrame([(store.codebook(V.read(spark, sf, "orders"), ["o_orderstatus"], {"o_orderstatus": "Status"}, {"o_orderstatus": STATUS}),)], "markdown string")


FOCUS = ("NATION_0", "NATION_2")


@query(
    V.SURVEY_SQL
    + "SELECT 'eu' AS scope, count(*) AS n, round(sum(w_eu), 4) AS weight FROM s"
    + "".join(f" UNION ALL SELECT '{c.lower()}', count(*), round(coalesce(sum(w_national), 0), 4) FROM s WHERE country_grouped = '{c}'" for c in FOCUS)
)
def focus_scopes(spark, sf):
    """The union and each focus country under its suffix, each with its own weight."""
    out = {k: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(w), F.lit(0.0)).alias("weight")) for k, (df, w) in survey_run.scopes(survey(spark, sf), FOCUS).items()}
    return rounded(tables.stack_scopes(out), 4)


@query(
    "SELECT f.*, discrimination, difficulty, CAST(NULL AS VARCHAR) AS label FROM ("
    + SQL["irt_item_fit_fixed_bank"]
    + ") f JOIN (VALUES "
    + ", ".join(f"('{r['item']}', {r['discrimination']}E0, {r['difficulty']}E0)" for r in BANK)
    + ") b(item, discrimination, difficulty) USING (item)"
)
def item_fit_with_bank(spark, sf):
    fit = irt.item_fit(irt.patterns(V.battery(spark, sf), V.BATTERY), BANK)
    return rounded(survey_run.labelled(fit.join(irt.bank_frame(spark, BANK).select("item", "discrimination", "difficulty"), "item")))


@query(f'SELECT CASE WHEN bool_and("pass") THEN 0 ELSE 1 END AS exit_code, count(*) AS checks FROM ({SQL["gate"]})')
def gate_exit(spark, sf):
    from ..functions import estimators as E

    computed = {"prep_agree": E.weighted_share("prep_agree", "w_eu", missing_as_no=True), "act1_share": E.weighted_share("act1", "w_eu"), "water_over_7d": indices.over_a_week("d1", "w_eu")}
    rows = gate.run_gate(survey(spark, sf), [gate.Check(k, c, TARGETS[k]) for k, c in computed.items()])
    code, _ = gate.report(rows)
    return spark.createDataFrame([(int(code), rows.count())], "exit_code int, checks long")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 100")
def seeded_sample(spark, sf):
    return tables.seeded_sample(V.read(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 100)


@query(
    "SELECT l_returnflag, l_linestatus, count(*) AS n, count(quantity) AS n_quantity, round(sum(quantity), 4) AS quantity, round(sum(l_extendedprice), 2) AS price "
    "FROM (SELECT *, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS quantity FROM lineitem) GROUP BY 1, 2"
)
def sav_round_trip(spark, sf):
    """Line items as SPSS files, one a partition, read back in ranges of cases and three of five columns at a time."""
    from ..sources.sav import SavDataSource

    spark.dataSource.register(SavDataSource)
    folder = place(spark, "lines")
    t = V.read(spark, sf, "lineitem").withColumn("quantity", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).cast("double"))
    t.select("l_returnflag", "l_linestatus", "quantity", F.col("l_extendedprice").cast("double").alias("price_of_the_line"), "l_linenumber").repartition(4).write.format("sav").option("textWidth", 8).mode("append").save(folder)
    d = spark.read.format("sav").option("rowsPerPartition", 5000).option("columns", "l_returnflag,l_linestatus,quantity,price_of_the_line").load(folder)
    out = d.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count("quantity").alias("n_quantity"), F.sum("quantity").alias("quantity"), F.sum("price_of_the_line").alias("price"))
    return rounded(out, 4, price=2)

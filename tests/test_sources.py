"""Readers, result tables, exports, streams."""

import struct
import zlib
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyweave.sources import readers, sav, store
from tallyweave.streaming import estimates


def test_years_csv_and_zip(spark, tmp_path):
    (tmp_path / "survey_2021.csv").write_text("id,A3_alerts,PREPB_alerts,weight\n1,1,0,0.5\n2,0,1,1.5\n")
    with zipfile.ZipFile(tmp_path / "nhs-2022.zip", "w") as z:
        z.writestr("readme.txt", "x" * 5000)
        z.writestr("small.csv", "a\n1\n")
        z.writestr("data.csv", "id,A3_alerts,extra\n" + "\n".join(f"{i},1,é" for i in range(50)))
    (tmp_path / "z_2021.csv").write_text("other\n1\n")
    (tmp_path / "notes_2020.txt").write_text("")
    found = readers.available_years(spark, str(tmp_path))
    assert {y: p.rsplit("/", 1)[1] for y, p in found.items()} == {2021: "survey_2021.csv", 2022: "nhs-2022.zip"}
    df, report = readers.load_years(spark, str(tmp_path))
    assert df.count() == 52 and set(df.columns) == {"id", "A3_alerts", "PREPB_alerts", "weight", "extra", "survey_year"}
    assert df.where("survey_year = 2022 AND weight IS NULL AND extra = 'é'").count() == 50
    assert len(report) == 24 and {r["survey_year"] for r in report} == {2021, 2022}
    assert readers.load_years(spark, str(tmp_path), [2021])[0].count() == 2
    with pytest.raises(readers.DataMissing, match="2019"):
        readers.load_years(spark, str(tmp_path), [2019])


def test_missing_data_says_what_to_do(spark, tmp_path):
    with pytest.raises(readers.DataMissing, match="names hold their year"):
        readers.require_years(spark, str(tmp_path / "none"))
    with pytest.raises(readers.DataMissing, match="b.txt"):
        readers.largest_member([("b.txt", 3)])


def test_csv_with_bad_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a,b\n1,caf\xe9\n2\n")
    rows = readers.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [r["a"] for r in rows] == [1, 2] and rows[0]["b"].startswith("caf") and rows[1]["b"] is None


def test_crosswalk(spark, tmp_path):
    (tmp_path / "c.csv").write_text('home_item,other_item,note\na,b,"x, y"\n,c,\nd,,z\n')
    assert [tuple(r) for r in readers.read_crosswalk(spark, str(tmp_path / "c.csv")).collect()] == [("a", "b", "x, y")]


def test_labels(spark, tmp_path):
    t = spark.createDataFrame([("q", 1.0, "yes"), ("q", 2.0, "no")], "variable string, code double, label string")
    assert readers.value_labels(t, "q") == {1.0: "yes", 2.0: "no"} and readers.value_labels(t, "r") == {}
    d = readers.with_labels(spark.range(1).withColumnRenamed("id", "q.1"), {"q.1": "A question"})
    d.write.parquet(str(tmp_path / "p"))
    assert readers.variable_labels(spark.read.parquet(str(tmp_path / "p"))) == {"q.1": "A question"}
    assert readers.read_schema(spark, str(tmp_path / "p")).names == ["q.1"]


def sav_file(path, compressed):
    """Two numbers and two texts (one of them of 300 bytes), three cases."""
    i = lambda *x: struct.pack(f"<{len(x)}i", *x)
    pad = lambda b, n: b + b" " * (-len(b) % n)
    cells_long = [32] * 1 + [6]  # 255 bytes in 32 cells, 48 in 6
    head = b"$FL2" + b"@(#) test".ljust(60) + i(2, 2 + 1 + 38, int(compressed), 0, 3) + struct.pack("<d", 100.0) + b" " * 84
    out = head[:176]

    def var(name, width, label=b""):
        rec = i(2, width, int(bool(label)), 0, 0, 0) + name.ljust(8)
        if label:
            rec += i(len(label)) + label + b"\0" * (-len(label) % 4)
        return rec

    cont = i(2, -1, 0, 0, 0, 0) + b" " * 8
    out += var(b"V1", 0, b"A number") + var(b"V2", 0) + var(b"S", 5, b"Short")
    out += var(b"T", 255) + cont * (cells_long[0] - 1) + var(b"T0", 48) + cont * (cells_long[1] - 1)
    out += i(3, 2) + struct.pack("<d", 1.0) + pad_label(b"yes") + struct.pack("<d", 2.0) + pad_label(b"no") + i(4, 1, 1)
    names = b"V1=qc6.1\tV2=weight\tS=isocntry\tT=long_text\tT0=T0"
    out += i(7, 13, 1, len(names)) + names
    wide = b"T=00300\0\t"
    out += i(7, 14, 1, len(wide)) + wide
    out += i(7, 20, 1, 5) + b"UTF-8" + i(999, 0)
    text = ("é" + "x" * 297 + "z").encode()
    cases = [(1.0, 0.5, b"LV", text), (2.0, None, b"", b""), (None, 1e6, "Ö".encode(), b"ab")]
    body, cells = b"", []
    for a, b, s, t in cases:
        for v in (a, b):
            cells.append(None if v is None else v)
        cells.append(s.ljust(8))
        first, second = t[:255].ljust(256), t[255:300].ljust(48)
        cells += [first[k : k + 8] for k in range(0, 256, 8)] + [second[k : k + 8] for k in range(0, 48, 8)]
    missing = struct.pack("<d", -1.7976931348623157e308)
    if not compressed:
        for c in cells:
            body += c if isinstance(c, bytes) else missing if c is None else struct.pack("<d", c)
    else:
        for k in range(0, len(cells), 8):
            codes, extra = b"", b""
            for c in cells[k : k + 8]:
                if c is None:
                    codes += b"\xff"
                elif isinstance(c, bytes):
                    codes += b"\xfe" if c == b" " * 8 else b"\xfd"
                    extra += b"" if c == b" " * 8 else c
                elif c == int(c) and 1 <= c + 100 <= 251:
                    codes += bytes([int(c) + 100])
                else:
                    codes += b"\xfd"
                    extra += struct.pack("<d", c)
            body += codes.ljust(8, b"\xfc") + extra
    if compressed == 2:  # zlib blocks of 40 bytes, their index at the end
        blocks = [body[k : k + 40] for k in range(0, len(body), 40)]
        packed, index, at, upto = b"", b"", len(out) + 24, 0
        for b in blocks:
            z = zlib.compress(b)
            index += struct.pack("<2q2i", len(out) + upto, at, len(b), len(z))
            packed, at, upto = packed + z, at + len(z), upto + len(b)
        trailer = struct.pack("<2q2i", -100, 0, 40, len(blocks)) + index
        body = struct.pack("<3q", len(out), at, len(trailer)) + packed + trailer
    path.write_bytes(out + body)


def pad_label(b):
    n = (len(b) + 8) // 8 * 8 - 1
    return bytes([len(b)]) + b.ljust(n)


@pytest.mark.parametrize("compressed", [0, 1, 2])
def test_sav(spark, tmp_path, compressed):
    path = tmp_path / "x.sav"
    sav_file(path, compressed)
    df, d = sav.read_sav(spark, str(path))
    assert df.dtypes == [("qc6.1", "double"), ("weight", "double"), ("isocntry", "string"), ("long_text", "string")]
    rows = [tuple(r) for r in df.collect()]
    assert rows[0][:3] == (1.0, 0.5, "LV") and rows[0][3].startswith("éx") and rows[0][3].endswith("z") and len(rows[0][3].encode()) == 300
    assert rows[1] == (2.0, None, "", "") and rows[2] == (None, 1e6, "Ö", "ab")
    assert d.value_labels == {"qc6.1": {1.0: "yes", 2.0: "no"}}
    assert readers.variable_labels(df) == {"qc6.1": "A number", "isocntry": "Short"}
    assert sav.read_sav(spark, str(path), metadata_only=True)[0] is None
    with pytest.raises(readers.DataMissing):
        sav.read_sav(spark, str(tmp_path / "none.sav"))


def test_sav_in_partitions(spark, tmp_path):
    """Files of a folder in ranges of cases, wanted columns alone; nulls, blank and long texts, empty partitions and folders."""
    spark.dataSource.register(sav.SavDataSource)
    rows = [(float(k) if k % 7 else None, "é" * (k % 5), None if k % 3 else "x", k) for k in range(1003)]
    d = spark.createDataFrame(rows, "`a.number` double, text_of_some_length string, t string, k long")
    folder = str(tmp_path / "many")
    d.repartition(3).write.format("sav").option("textWidth", 9).mode("append").save(folder)
    read = lambda **o: spark.read.format("sav").options(rowsPerPartition=100, **o).load(folder)
    got = read()
    assert got.dtypes == [("a.number", "double"), ("text_of_some_length", "string"), ("t", "string"), ("k", "double")]
    assert got.rdd.getNumPartitions() >= 11
    want = sorted((k, n, s, t or "") for n, s, t, k in rows)
    assert sorted((r["k"], r["a.number"], r["text_of_some_length"], r["t"]) for r in got.collect()) == want
    some = read(columns="k,t")
    assert some.columns == ["k", "t"] and sorted(map(tuple, some.collect())) == [(k, t) for k, _, _, t in want]
    d.where("k > 1000").repartition(1).write.format("sav").mode("append").save(folder)
    assert read().count() == 1005
    empty = str(tmp_path / "empty")
    d.limit(0).coalesce(1).write.format("sav").mode("append").save(empty)
    assert spark.read.format("sav").load(empty).count() == 0
    for bad in (lambda: read(columns="k,nothing").count(), lambda: d.write.format("sav").option("textWidth", 3).mode("append").save(str(tmp_path / "short"))):
        with pytest.raises(Exception, match="nothing|more than 3 bytes"):
            bad()


def test_tables(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert store.write_table(d, "tw_test_table", "a comment") == 2
    assert store.write_table(d.limit(1), "tw_test_table") == 1
    r = store.Reader(spark, "no_such_database", "default")
    assert "tw_test_table" in r.tables() and r.require("tw_test_table", "absent") == ["absent"]
    assert r.table("tw_test_table").count() == 1 and r.query("SELECT * FROM tw_test_table") is r.query("SELECT * FROM tw_test_table")
    assert not [m for m in dir(r) if "write" in m]
    with pytest.raises(PermissionError):
        r.query("DROP TABLE tw_test_table")
    with pytest.raises(FileNotFoundError):
        store.Reader(spark, "no_such_database")
    spark.sql("DROP TABLE tw_test_table")


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([("1", None), ("2", "x,y")], "q string, t string")
    assert store.write_csv_file(store.labelled(d, {"q": {"1": "yes"}}, {"q": "A question"}), str(tmp_path / "a.csv"), bom=True) == 2
    assert (tmp_path / "a.csv").read_bytes().decode("utf-8-sig").splitlines() == ["q — A question,t", "yes,", '2,"x,y"']
    assert store.markdown_table(d.collect()).splitlines()[2] == "| 1 |  |"
    assert "## S\n\n| a |" in store.model_card("T", {"P": "text", "S": [{"a": 0.123456789}]})
    inv = store.variable_inventory(d, {"q": "A question"}, ["q"], ["t"]).collect()
    assert [tuple(r) for r in inv] == [(0, "q", "A question", True, False), (1, "t", "", False, True)]
    assert "## q: A question" in store.codebook(d, ["q"], {"q": "A question"}, {"q": {"1": "yes"}})
    raw = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 1.0)], "id double, `q.1` double")
    cleaned = spark.createDataFrame([(1, None), (2, None), (3, 1.0)], "id long, v double")
    assert [tuple(r) for r in store.trace(raw, cleaned, "id", "q.1", "v").collect()] == [(1.0, 3, 1.0), (5.0, 1, None)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i // 20} 0{i % 9}:00:00", "ab"[i % 2], float(i), 1.0 + i % 3) for i in range(80)]
    d = spark.createDataFrame(rows, "ts string, g string, v double, w double").withColumn("ts", F.to_timestamp("ts"))
    d.repartition(1).write.parquet(str(tmp_path / "in"))
    # a last event long after closes the windows before
    d.limit(1).withColumn("ts", F.to_timestamp(F.lit("2024-03-01 00:00:00"))).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = estimates.write_estimates(estimates.windowed_estimates(stream, "ts", "g", "v", "w"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    key = lambda r: (str(r[0]), r[1])
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=key)
    want = sorted(map(tuple, estimates.windowed_estimates(d, "ts", "g", "v", "w").collect()), key=key)
    assert len(got) == 8 and [(a[0], a[1], a[3]) for a in got] == [(b[0], b[1], b[3]) for b in want]
    assert all(abs(a[2] - b[2]) < 1e-9 and abs(a[4] - b[4]) < 1e-9 for a, b in zip(got, want))


def test_engine_does_not_import_the_optional_package():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for p in (root / "tallyweave").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(from|import) [\w.]*\bllm\b", p.read_text()), p


def test_codebook_and_trace_of_many_columns(spark):
    """All columns in one scan; missing codes, dots in names, labels of one column not used for another."""
    from tallyweave.operators import tables

    d = spark.createDataFrame([(1, "a", None), (2, "a", "1"), (3, "b", "1"), (4, None, "1")], "id int, `q.1` string, q2 string")
    got = {(r["column"], r["value"]): (r["label"], r["n"], r["pct"]) for r in tables.frequencies(d, ["q.1", "q2"], {"q.1": {"a": "A", "1": "wrong"}}).collect()}
    assert got == {("q.1", "a"): ("A", 2, 50.0), ("q.1", "b"): ("b", 1, 25.0), ("q.1", "missing"): ("missing", 1, 25.0), ("q2", "1"): ("1", 3, 75.0), ("q2", "missing"): ("missing", 1, 25.0)}
    page = store.codebook(d, ["q.1", "q2"], {}, {"q.1": {"a": "A"}})
    assert page.index("## q.1") < page.index("| a | A | 2 | 50 |") < page.index("## q2")
    raw = spark.createDataFrame([(3, 1, 5), (2, 1, 6), (4, None, 5)], "id int, `q.1` int, q2 int")
    clean = spark.createDataFrame([(2, 1.5, None), (3, 1.0, 2.0), (4, None, 3.0)], "id int, v double, w double")
    rows = sorted((tuple(r) for r in store.trace_codes(raw, clean, "id", {"q.1": "v", "q2": "w"}).collect()), key=str)
    assert rows == sorted([("q.1", 1.0, 2, 1.5, 2), ("q.1", None, 4, None, 1), ("q2", 5.0, 3, 2.0, 2), ("q2", 6.0, 2, None, 1)], key=str)


def test_a_failed_write_keeps_the_old_table(spark):
    """Old rows stay readable after a write that fails half way; a table may be rewritten from itself."""
    d = spark.createDataFrame([(1,), (2,)], "a int")
    assert store.write_table(d, "tw_kept_table") == 2
    bad = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("int")).cast("int").alias("a"))
    with pytest.raises(Exception, match="no"):
        store.write_table(bad, "tw_kept_table")
    assert sorted(r.a for r in spark.table("tw_kept_table").collect()) == [1, 2]
    t = spark.table("tw_kept_table")
    assert store.write_table(t.union(t.selectExpr("a + 10 AS a")), "tw_kept_table") == 4
    assert sorted(r.a for r in spark.table("tw_kept_table").collect()) == [1, 2, 11, 12]
    assert not [x.name for x in spark.catalog.listTables() if x.name.startswith("tw_kept_table__")]
    spark.sql("DROP TABLE tw_kept_table")


def test_trace_hashes_rows(spark):
    """Joined rows are hashed by pairs of codes, not sorted by code; keys may repeat."""
    from tallyweave.sources import store

    rows = [(k % 150, k % 4 if k % 4 else None) for k in range(300)]
    raw = spark.createDataFrame(rows, "id long, a int")
    cleaned = spark.createDataFrame([(i, None if a == 3 or i == 5 else a and a * 10.0) for i, a in rows], "id long, b double")
    t = store.trace_codes(raw, cleaned, "id", {"a": "b"})
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[column" in plan.replace(" HashAgg", "HashAgg") and "partial_min(key" in plan
    joined = [(a, i, b) for i, a in rows for j, b in cleaned.collect() if i == j]
    want = {}
    for a in {a for a, *_ in joined}:
        own = [(i, b is not None, b) for x, i, b in joined if x == a]
        i, _, b = min(own, key=lambda r: (r[0], r[1], r[2] or 0))
        want[a] = (i, b, len(own))
    assert {r["raw_code"]: (r["example"], r["clean_value"], r["n"]) for r in t.collect()} == want

"""Readers: survey files with labels, yearly files as CSV, ZIP or Excel, stacked years, crosswalks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

YEAR_FILES = (".zip", ".csv", ".xlsx")


class DataMissing(FileNotFoundError):
    """No input where it is expected; the message says what to put there."""


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_schema(spark: SparkSession, path: str):
    """The schema alone: no data is read."""
    return spark.read.parquet(path).schema


def read_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """A CSV with a header; bytes that are no UTF-8 are replaced, malformed rows kept with nulls."""
    return spark.read.csv(path, header=True, inferSchema=infer, mode="PERMISSIVE", encoding="UTF-8", multiLine=True)


def read_excel(spark: SparkSession, path_or_bytes) -> DataFrame:
    """A workbook's first sheet, read on the driver (workbooks are small); needs an Excel reader."""
    import pandas as pd

    try:
        frame = pd.read_excel(path_or_bytes)
    except ImportError as e:
        raise ImportError("reading Excel files needs openpyxl; save the sheet as CSV instead") from e
    return spark.createDataFrame(frame)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def available_years(spark: SparkSession, folder: str) -> dict[int, str]:
    """Year (20xx in the file name) to path of .zip, .csv and .xlsx files; a year's first file by name."""
    fs, p = _file_system(spark, folder)
    if not fs.exists(p):
        return {}
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    out: dict[int, str] = {}
    for name in names:
        m = re.search(r"20\d{2}", name)
        if m and name.lower().endswith(YEAR_FILES):
            out.setdefault(int(m[0]), f"{folder.rstrip('/')}/{name}")
    return out


def require_years(spark: SparkSession, folder: str) -> dict[int, str]:
    found = available_years(spark, folder)
    if not found:
        raise DataMissing(f"no yearly file in {folder}: put .csv, .zip or .xlsx files there whose names hold their year, such as survey_2022.csv")
    return found


def largest_member(names_sizes: Iterable[tuple[str, int]]) -> str:
    """The largest .csv or .xlsx of an archive."""
    all_ = list(names_sizes)
    fit = [x for x in all_ if x[0].lower().endswith((".csv", ".xlsx"))]
    if not fit:
        raise DataMissing("the archive has no .csv or .xlsx: " + ", ".join(n for n, _ in all_[:10]))
    return max(fit, key=lambda x: x[1])[0]


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """The largest table of a ZIP archive. An archive is one file, unpacked by one task or, for Excel, the driver."""
    import pandas as pd

    raw = spark.read.format("binaryFile").load(path).select("content")

    def members(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    yield pd.DataFrame([(i.filename, i.file_size) for i in z.infolist()], columns=["name", "size"])

    name = largest_member((r["name"], r["size"]) for r in raw.mapInPandas(members, "name string, size long").collect())
    if not name.lower().endswith(".csv"):
        with zipfile.ZipFile(io.BytesIO(raw.first()["content"])) as z:
            return read_excel(spark, io.BytesIO(z.read(name)))

    def lines(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(name) as f:
                    held = []
                    for line in io.TextIOWrapper(f, "utf-8", errors="replace"):
                        held.append(line.rstrip("\r\n"))
                        if len(held) == 50_000:
                            yield pd.DataFrame({"value": held})
                            held = []
                    yield pd.DataFrame({"value": held}, dtype=object)

    text = raw.mapInPandas(lines, "value string")
    return spark.read.csv(text.rdd.map(lambda r: r[0]), header=True, inferSchema=True, mode="PERMISSIVE")


def read_year(spark: SparkSession, path: str) -> DataFrame:
    low = path.lower()
    return read_zip(spark, path) if low.endswith(".zip") else read_excel(spark, path) if low.endswith(".xlsx") else read_csv(spark, path)


def stack_years(frames: Mapping[int, DataFrame]) -> DataFrame:
    """Years under one another with ``survey_year``; columns that a year lacks are null. Differing types become string."""
    kinds: dict[str, set[str]] = {}
    for df in frames.values():
        for c, t in df.dtypes:
            kinds.setdefault(c, set()).add(t)
    out = None
    for year in sorted(frames):
        df = frames[year]
        cols = []
        for c, t in df.dtypes:
            numbers = kinds[c] <= {"int", "bigint", "double", "float", "smallint", "tinyint"}
            col = F.col(f"`{c}`")
            cols.append((col if len(kinds[c]) == 1 else col.cast("double") if numbers else col.cast("string")).alias(c))
        df = df.select(*cols).withColumn("survey_year", F.lit(year))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def load_years(spark: SparkSession, folder: str, years: Iterable[int] | None = None) -> tuple[DataFrame, list[dict]]:
    """(stacked data, column discovery by year) of the years that are there, or of those asked for."""
    from ..operators.conversion import discover_columns

    found = require_years(spark, folder)
    wanted = sorted(set(years) & set(found)) if years else sorted(found)
    if not wanted:
        raise DataMissing(f"none of the years {sorted(years or [])} is in {folder}; there are {sorted(found)}")
    frames = {y: read_year(spark, found[y]) for y in wanted}
    report = [{**r, "survey_year": y} for y in wanted for r in discover_columns(frames[y].columns)]
    return stack_years(frames), report


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """Item pairs of two surveys; rows without both items are left out."""
    return read_csv(spark, path, infer=False).dropna(subset=["home_item", "other_item"])


def value_labels(labels: DataFrame, variable: str) -> dict:
    """Code to text of one variable, from a (variable, code, label) table; empty if it has none."""
    return {r["code"]: r["label"] for r in labels.where(F.col("variable") == variable).select("code", "label").collect()}


def with_labels(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Variable labels kept in the schema, where Parquet preserves them."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={**df.schema[c].metadata, "label": labels[c]}) if c in labels else F.col(f"`{c}`") for c in df.columns])


def variable_labels(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["label"] for f in df.schema if "label" in f.metadata}

"""Result tables: a writer that replaces, a reader that cannot write, exports and generated documents."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, table: str, comment: str | None = None) -> int:
    """Replace ``table`` by ``df``; its number of rows, observed while writing.

    Rows go to a table of their own first, so a write that fails leaves the old table as it was, and ``df`` may read the
    table it replaces. Then the tables change names; the old one comes back if that fails, too.
    """
    spark, seen, own = df.sparkSession, Observation(), uuid.uuid4().hex[:12]
    new, old = f"{table}__new_{own}", f"{table}__old_{own}"
    try:
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.saveAsTable(new)
        if comment:
            spark.sql(f"ALTER TABLE {new} SET TBLPROPERTIES ('comment' = '{comment.replace(chr(39), '')}')")
        there = spark.catalog.tableExists(table)
        if there:
            spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
        try:
            spark.sql(f"ALTER TABLE {new} RENAME TO {table}")
        except Exception:
            if there:
                spark.sql(f"ALTER TABLE {old} RENAME TO {table}")
            raise
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {new}")
        raise
    if there:
        spark.sql(f"DROP TABLE IF EXISTS {old}")
    return seen.get["n"]


class Reader:
    """Read-only access to result tables, in the first of several databases that has any."""

    def __init__(self, spark: SparkSession, *databases: str):
        self._spark = spark
        there = {d.name for d in spark.catalog.listDatabases()}
        known = [d for d in databases or ("default",) if d in there]
        if not known:
            raise FileNotFoundError(f"none of the databases {', '.join(databases)} exists: write result tables first")
        self.database = next((d for d in known if spark.catalog.listTables(d)), known[0])
        self._memo: dict[str, DataFrame] = {}

    def tables(self) -> set[str]:
        return {t.name for t in self._spark.catalog.listTables(self.database) if not t.isTemporary}

    def require(self, *tables: str) -> list[str]:
        """The tables that are missing."""
        return sorted(set(tables) - self.tables())

    def query(self, sql: str) -> DataFrame:
        """A SELECT's result, cached by its text."""
        if sql.lstrip().split(None, 1)[0].upper() not in ("SELECT", "WITH", "FROM", "VALUES"):
            raise PermissionError("only queries can be read")
        if sql not in self._memo:
            before = self._spark.catalog.currentDatabase()
            self._spark.catalog.setCurrentDatabase(self.database)
            try:
                self._memo[sql] = self._spark.sql(sql).cache()
            finally:
                self._spark.catalog.setCurrentDatabase(before)
        return self._memo[sql]

    def table(self, name: str) -> DataFrame:
        return self.query(f"SELECT * FROM {name}")


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts, written in parallel."""
    df.write.mode("overwrite").csv(path, header=True)


def write_csv_file(df: DataFrame, path: str, bom: bool = False) -> int:
    """One CSV file, streamed through the driver a partition at a time; ``bom`` for spreadsheet programs."""
    n = 0
    with open(path, "w", newline="", encoding="utf-8-sig" if bom else "utf-8") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def labelled(df: DataFrame, labels: Mapping[str, Mapping], headers: Mapping[str, str]) -> DataFrame:
    """Codes decoded (unknown ones stay), headers as ``code - label``."""
    from ..functions.expr import decode_label

    return df.select(*[(decode_label(F.col(f"`{c}`"), labels[c]) if labels.get(c) else F.col(f"`{c}`")).alias(f"{c} — {headers[c]}" if c in headers else c) for c in df.columns])


def markdown_table(rows: Sequence, columns: Sequence[str] | None = None) -> str:
    """A small result as a Markdown table."""
    rows = [r.asDict() if hasattr(r, "asDict") else dict(r) for r in rows]
    columns = list(columns or (rows[0] if rows else []))
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    body = [[show(r.get(c)) for c in columns] for r in rows]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *map(line, body)])


def model_card(title: str, sections: Mapping[str, str | Sequence]) -> str:
    """A Markdown document of paragraphs and small tables."""
    out = io.StringIO()
    out.write(f"# {title}\n")
    for head, body in sections.items():
        out.write(f"\n## {head}\n\n{body if isinstance(body, str) else markdown_table(body)}\n")
    return out.getvalue()


def variable_inventory(df: DataFrame, labels: Mapping[str, str], with_values: Sequence[str] = (), used: Sequence[str] = ()) -> DataFrame:
    """A row per column: position, name, label, whether it has value labels, whether it is used."""
    rows = [(i, c, labels.get(c, ""), c in set(with_values), c in set(used)) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "position int, variable string, label string, has_value_labels boolean, used boolean")


def codebook(df: DataFrame, columns: Sequence[str], labels: Mapping[str, str], values: Mapping[str, Mapping]) -> str:
    """Markdown frequency tables of coded columns, from one scan. Codes are few: a column's values are lines of the page."""
    from ..operators.tables import frequencies

    rows: dict[str, list] = {c: [] for c in columns}
    for r in frequencies(df, columns, {c: dict(values.get(c, {})) for c in columns}).orderBy("column", "value").collect():
        rows[r["column"]].append({k: r[k] for k in ("value", "label", "n", "pct")})
    parts = ["# Codebook", *[f"## {c}: {labels.get(c, '')}\n\n{markdown_table(rows[c])}" for c in columns]]
    return "\n\n".join(parts) + "\n"


def trace_codes(raw: DataFrame, cleaned: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """(column, raw_code, example, clean_value, n): what each raw code of ``columns`` (raw to clean name) became.

    One join of both tables by ``key``; the example of a code is its smallest key, a partial minimum: first of each pair of
    codes (numbers, which are hashed, where structs would be sorted), then of the pairs. Codes are doubles; a missing code is one, too.
    """
    number = lambda c: F.col(f"`{c}`").cast("double")
    a = raw.select(number(key).alias("key"), *[number(r).alias(f"raw{k}") for k, r in enumerate(columns)])
    b = cleaned.select(number(key).alias("key"), *[number(c).alias(f"clean{k}") for k, c in enumerate(columns.values())])
    pairs = F.array(*[F.struct(F.lit(r).alias("column"), F.col(f"raw{k}").alias("raw_code"), F.col(f"clean{k}").alias("clean_value")) for k, r in enumerate(columns)])
    t = a.join(b, "key").select("key", F.explode(pairs).alias("p")).select("key", "p.*")
    t = t.groupBy("column", "raw_code", "clean_value").agg(F.min("key").alias("key"), F.count("*").alias("n"))
    t = t.groupBy("column", "raw_code").agg(F.min(F.struct("key", "clean_value")).alias("first"), F.sum("n").alias("n"))
    return t.select("column", "raw_code", F.col("first.key").cast("long").alias("example"), F.col("first.clean_value").alias("clean_value"), "n")


def trace(raw: DataFrame, cleaned: DataFrame, key: str, raw_col: str, clean_col: str) -> DataFrame:
    """``trace_codes`` of one column: an example per raw code of what it became."""
    t = trace_codes(raw, cleaned, key, {raw_col: clean_col})
    return t.select("raw_code", F.col("example").alias("key"), "clean_value").orderBy("raw_code")

"""9. Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep the smallest id.

DataFrame functions only. Two steps, neither of which gathers a group:

1. Classes. Rows are grouped by (128-bit hash, text). The hash decides where a text goes; the
   text as a second key is the byte comparison, so texts that merely share a hash stay apart.
   Partial aggregation leaves one row of a class per map task, however many copies there are.
2. Rows find their class by the two digests (hash and SHA-256) in a join whose sides are plain
   exchanges, which adaptive execution splits where a class is hot. Should two different texts
   ever share both digests, the query stops with an error rather than mix them up.

Defined cases: null text counts as empty; rows that repeat an id are separate copies (with the
smallest id all of them are ``kept``); a group of null ids only has a null ``keep_id`` and keeps
its rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_text, kept_rows, materialize, read_documents

#: White space that counts as one space.
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: F.Column) -> F.Column:
    return F.regexp_replace(text, SPACE, " ")


def _digests(t: F.Column) -> list[F.Column]:
    return [F.unhex(F.md5(t)).alias("h"), F.unhex(F.sha2(t, 256)).alias("s")]


def classes_of(t: DataFrame) -> DataFrame:
    """(h, s, keep, size) of each class of equal texts of ``t`` (id, t): a written table."""
    h, s = _digests(F.col("t"))
    classes = t.select("id", "t", h).groupBy("h", "t").agg(F.min("id").alias("keep"), F.count("*").alias("size"))
    classes = classes.select("h", s, "keep", "size").groupBy("h", "s")
    classes = classes.agg(F.min("keep").alias("keep"), F.sum("size").alias("size"), F.count("*").alias("texts"))
    clash = F.raise_error(F.lit("exact_dedup: two texts share both digests"))
    classes = classes.select("h", "s", F.when(F.col("texts") > 1, clash.cast("long")).otherwise(F.col("keep")).alias("keep"), "size")
    return materialize(classes, "classes")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    t = df.select(F.col(id_col).alias("id"), normalised(empty_text(text_col)).alias("t"))
    out = t.select("id", *_digests(F.col("t"))).join(classes_of(t), ["h", "s"])
    return out.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("s")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``exact_dedup`` calls kept, with all their columns."""
    t = df.select(F.col(id_col).alias("id"), normalised(empty_text(text_col)).alias("t"))
    keep = classes_of(t).select(F.struct("h", "s").alias("digest"), F.col("keep").alias("id"))
    return kept_rows(df, F.struct(*_digests(normalised(empty_text(text_col)))), F.col(id_col), keep)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_documents(spark, sf_dir))


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.t) AS text_sha256
FROM t JOIN g ON t.t = g.t
"""

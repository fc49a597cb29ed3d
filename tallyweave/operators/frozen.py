"""How work is run: results that are computed once (written to the checkpoint folder and read from there by every later use), and code that is compiled."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Ranges of an ordered table, at least.
RANGES = 200
#: Bytes of a method beyond which the JVM only interprets it.
COMPILED = 8000


def compiled(spark: SparkSession) -> None:
    """A setting of the session: steps whose fused code would be one method too long for the JVM's compiler run as several short ones.

    A projection of some dozens of coded columns is such a step: interpreted, it took 12 times the CPU seconds.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of checkpoints: the context's, that of spark.checkpoint.dir, or (local masters only) a new one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("checkpoint_dir: on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyweave-checkpoint-"))
    return sc.getCheckpointDir()


def frozen(df: DataFrame) -> DataFrame:
    """``df``, computed and written now, so that its uses can't differ and a lost executor repeats nothing before it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def in_order(df: DataFrame, *by: str) -> DataFrame:
    """``df`` frozen in ranges of ``by`` that ``part`` numbers in ascending order.

    The ranges follow the data (they come from a sample of it), rows equal in ``by`` share a part, and how many parts
    there are depends on the session alone. Which ranges it became matters to nobody: all uses read the same. Parts are
    asked for by number, as adaptive execution would join them to one a core, and what ranks a part holds it.
    """
    parts = max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return frozen(df.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()))

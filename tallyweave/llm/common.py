"""What the corpus operators share: written intermediate tables, components, blocked cells.

Conventions of every operator here:

* ``id_col`` holds integer ids and ``text_col`` strings; only these columns (and those an
  operator names) are read, so further columns may have any name. Results have the ids and
  the operator's own columns.
* A null text counts as empty unless the operator says otherwise, and a null id is a row
  like any other: it gets its result, but never serves as a group's representative.
* Python that runs on executors is pickled by value, so they need no copy of this package.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES, DEFAULT_BATCH = 4 << 20, f"{64 << 20}b"

_own_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []


def by_value(name: str) -> None:
    """Pickle the functions of module ``name`` by value."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one if unset and the master is local (tests)."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("shared_dir: on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
        spark.conf.set("spark.checkpoint.dir", _own_dir)
    return _own_dir


def small_batches(spark: SparkSession) -> None:
    """Let this session's Arrow batches hold ``BATCH_BYTES`` at most, unless it has a limit of its own.

    Texts reach Python in batches, and each worker, and the executor that feeds it, holds some at a time:
    the default of 64 MB is too much for small executors.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == DEFAULT_BATCH:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Hand a worker's free memory back: workers are reused, and what an idle one keeps stands beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def tidy(run):
    """``run``, a function over batches, that gives its worker's free memory back at the end."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean_up() -> None:
    """Delete the tables that ``materialize`` has written; frames built on them can't be read afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session is gone: the folder's owner cleans up
            return


atexit.register(clean_up)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The lineage ends there: a lost executor costs no recomputation of what lies before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    spark, path = df.sparkSession, df._written_to
    _written.remove((spark, path))
    _remove(spark, path)


def empty_text(col: str) -> F.Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def kept_rows(df: DataFrame, digest: F.Column, ident: F.Column, kept: DataFrame) -> DataFrame:
    """The rows of ``df``, with all their columns, whose digest and id (null-safe) are a row of ``kept`` (digest, id: distinct).

    ``kept`` is the join's hashed side, so that a hot digest is on the streamed side alone.
    """
    d = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), digest.alias("own"), ident.alias("ident"))
    same = (F.col("own") == F.col("digest")) & F.col("ident").eqNullSafe(F.col("id"))
    return d.join(kept.select("digest", "id").hint("shuffle_hash"), same, "left_semi").select("row.*")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node reachable.

    Large-star and small-star steps (Kiveris et al., 2014) as joins with per-node minima, so no
    node's neighbours are ever gathered. Each round is written, and the loop ends when a round
    changes nothing. Nulls and self-loops are dropped; an empty input gives an empty result.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = e.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    # a points to the smaller node b throughout
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    last = None
    for _ in range(rounds):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        before, e = e, materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(before)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last or now[0] == 0:
            break
        last = now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def named_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, name) of every row of ``nodes`` (node, rep): name is the smallest rep of the node's component.

    ``nodes`` is a written table; null reps name nothing. The joins' sides are plain exchanges, so a
    component that holds most nodes is split.
    """
    comp = components(links)
    placed = nodes.select("node", "rep").join(comp, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    placed = materialize(placed, "placed")
    names = materialize(placed.groupBy("component").agg(F.min("rep").alias("name")), "names")
    return placed.join(names, "component").select("node", "name")


def blocked(rows: DataFrame, cell: list[str], key: str, block: int, home: str | None = None) -> DataFrame:
    """Deal each cell's rows into tasks that together see every pair of the cell.

    A cell of n rows is cut into ceil(n / block) blocks by the hash of ``key``; a task, named by
    (cell, lo, hi), holds the rows of two blocks (or one). So no task grows with its cell, and no
    pair is lost. Cells of one row give nothing. With ``home`` (a boolean column) the blocks of
    columns are made of home rows only and each row meets every home block: (cell, lo, hi)
    then holds query block lo and home block hi, told apart by ``side`` ("q" or "h").
    """
    if home is None:
        sizes = rows.groupBy(*cell).agg(F.count("*").alias("n_cell")).where("n_cell > 1")
    else:
        sizes = rows.groupBy(*cell).agg(F.count("*").alias("n_cell"), F.count_if(F.col(home)).alias("n_home"))
        sizes = sizes.where("n_cell > 1 AND n_home > 0")
    j = rows.join(sizes, cell)
    parts = F.ceil(F.col("n_cell") / block).cast("int")
    j = j.withColumn("own", F.pmod(F.xxhash64(key), parts).cast("int"))
    if home is None:
        j = j.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        j = j.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
        return j.drop("n_cell", "own", "other")
    h_parts = F.ceil(F.col("n_home") / block).cast("int")
    q = j.withColumn("lo", F.col("own")).withColumn("hi", F.explode(F.sequence(F.lit(0), h_parts - 1)))
    h = j.where(F.col(home)).withColumn("hi", F.pmod(F.xxhash64(key), h_parts).cast("int"))
    h = h.withColumn("lo", F.explode(F.sequence(F.lit(0), parts - 1)))
    q, h = q.withColumn("side", F.lit("q")), h.withColumn("side", F.lit("h"))
    return q.unionByName(h).drop("n_cell", "n_home", "own")


def whole_groups(batches, keys: list[str]):
    """Tables of whole groups from sorted record batches: the last group of a batch waits for the next batch."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        at = np.ones(t.num_rows, bool)
        last = np.ones(t.num_rows, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            last &= v == v[-1]
        cut = int(np.argmax(last)) if last.any() else len(at)
        held = t.slice(cut)
        if cut:
            yield t.slice(0, cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def spanning(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) of the components that the links left-right make among ``ids``."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    l, r = at[: len(left)], at[len(left) :]
    own = ids[nodes]
    low = own.copy()
    while True:
        before = low.copy()
        m = np.minimum(low[l], low[r])
        np.minimum.at(low, l, m)
        np.minimum.at(low, r, m)
        # jump: a label is the id of a node, which may by now have a smaller label itself
        order = np.argsort(own, kind="stable")
        low = np.minimum(low, low[order[np.searchsorted(own[order], low)]])
        if (low == before).all():
            break
    keep = own != low
    return own[keep], low[keep]


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

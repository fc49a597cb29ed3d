"""3. Embedding near-dedup: spherical k-means cells, blocked cosine products within cells.

Vectors of a label are compared only with one another. Equal vectors are one row from the start,
with their number. Spherical k-means, fitted on a bounded sample (``sample`` vectors, the smallest
by hash), assigns every vector to the cell of its nearest centroid; a label has 4, 16, 64 ... cells, as its own
vectors ask for. Cells lose nothing: a vector x
of cell a may have links in cell c only if x . (a - c) / |a - c| <= sin(theta), where cos(theta) is the
threshold, since any vector of cell c lies beyond that hyperplane and hence further from x
otherwise. Of each two cells the vectors of one are such guests of the other. Home rows and guests of a
cell are dealt in blocks, so no task grows with a cell; each task multiplies its two blocks in double precision.

A link of two home rows counts for either in a task of its own, a link of a guest for both of its ends, so each
vector's count is a sum over tasks without any list of pairs; tasks hand on a spanning set of their links for the components.

Defined cases: a null label, or a vector that is null, empty, zero, or holds null or non-finite
components, links with nothing and is its own component; vectors of different lengths do not link;
repeated rows with equal ids are separate vectors (each counts the others as links); a null id
never names a component; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocked, by_value, discard, materialize, n_partitions, named_components, read_documents, small_batches, spanning, whole_groups

by_value(__name__)

#: Every label has cells, at least four; more of them aim at this many vectors each. Centroids are shipped with the tasks, so their number is bounded.
CELL_ROWS, MAX_CELLS = 2000, 1024
#: Each length of vector has centroids of its own; lengths beyond the most frequent ones have a single cell each.
MAX_LENGTHS = 16
#: Cosines this near the threshold are taken again from products in one order, so that a link counts for both of its ends.
ROUNDING = 1e-12


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k unit centroids of the unit vectors x."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def cells_of(x: np.ndarray, c: np.ndarray, sin_theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) of each vector's home cell and of those where it is a guest."""
    near = x @ c.T
    own = np.argmax(near, axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))[own]
    guest = near[np.arange(len(x)), own][:, None] - near <= (sin_theta + 1e-9) * apart
    # one way between two cells: to the higher one if their numbers add up to an odd one, else to the lower one
    other = np.arange(len(c))
    guest &= ((own[:, None] + other) % 2 == 1) == (own[:, None] < other)
    guest[np.arange(len(x)), own] = True
    row, cell = np.nonzero(guest)
    return row, cell, own[row] == cell


def embedding_groups(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.98, sample: int = 20_000, block: int = 2048) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    spark = df.sparkSession
    small_batches(spark)
    label = F.col(label_col) if label_col else F.lit(0)
    t = df.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    fine &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine &= F.exists("v", lambda x: x != 0.0)
    fine = F.coalesce(fine, F.lit(False))
    # -0.0 and 0.0 are one component value
    t = t.select("id", "label", F.when(fine, F.transform("v", lambda x: x + F.lit(0.0))).alias("v"))
    # doubles print in a way that reads back as they are, so digests stand for vectors
    digest = F.unhex(F.sha2(F.col("v").cast("string"), 256)).alias("digest")
    vectors = t.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    vectors = materialize(vectors.withColumn("node", F.monotonically_increasing_id()), "vectors")
    d, needed = F.size("v").alias("d"), F.least(F.ceil(F.col("n") / CELL_ROWS), F.lit(MAX_CELLS))
    sizes = vectors.groupBy("label", d).agg(F.count("*").alias("n"))
    sizes = materialize(sizes.withColumn("level", F.greatest(F.ceil(F.log(4.0, needed)), F.lit(1)).cast("int")), "sizes")
    fitted = sizes.groupBy("d").agg(F.sum("n").alias("n"), F.collect_set("level").alias("levels")).orderBy(F.desc("n"), "d").limit(MAX_LENGTHS).collect()
    centroids: dict[tuple[int, int], np.ndarray] = {}
    for r in fitted:
        picked = vectors.where(F.size("v") == r["d"]).orderBy(F.xxhash64("label", "v")).limit(sample).select("v").toPandas()["v"]
        x = np.stack(picked.to_numpy())
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for level in r["levels"]:
            centroids[r["d"], level] = spherical_kmeans(x, min(MAX_CELLS, 4**level))
    sin_theta = math.sqrt(1 - threshold * threshold)

    def deal(batches):
        for b in batches:
            vs = b.column("v").to_pylist()
            sizes = np.array([len(v) for v in vs])
            levels = b.column("level").to_numpy()
            for d, level in sorted(set(zip(sizes.tolist(), levels.tolist()))):
                at = np.flatnonzero((sizes == d) & (levels == level))
                x = np.array([vs[i] for i in at])
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for lo in range(0, len(at), 1024):
                    some = x[lo : lo + 1024]
                    if (d, level) in centroids:
                        row, cell, home = cells_of(some, centroids[d, level], sin_theta)
                    else:
                        row, cell, home = np.arange(len(some)), np.zeros(len(some), np.int64), np.ones(len(some), bool)
                    src = at[lo + row]
                    take = pa.array(src)
                    unit = pa.array([x[lo + r].tobytes() for r in row], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [b.column("label").take(take), pa.array(np.full(len(row), d), pa.int32()), pa.array(cell, pa.int32()), pa.array(home), b.column("node").take(take), b.column("copies").take(take), unit],
                        names=["label", "d", "cell", "home", "node", "copies", "unit"],
                    )

    levelled = vectors.select("label", d, "v", "node", "copies").join(sizes.drop("n"), ["label", "d"]).select("label", "v", "node", "copies", "level")
    dealt = levelled.mapInArrow(deal, "label string, d int, cell int, home boolean, node long, copies long, unit binary")
    dealt = materialize(dealt.withColumn("g", F.xxhash64("label", "d", "cell")), "dealt")
    tasks = blocked(dealt, ["g"], "node", block, home="home")
    keys = ["g", "lo", "hi"]
    tasks = tasks.select(*keys, "side", "home", "label", "node", "copies", "unit").repartition(n_partitions(spark), *keys).sortWithinPartitions(*keys)

    def link(batches):
        for t in whole_groups(batches, keys):
            k = [t.column(c).to_numpy() for c in keys]
            new = np.zeros(t.num_rows, bool)
            for v in k:
                new[1:] |= v[1:] != v[:-1]
            edges = np.append(np.flatnonzero(new), t.num_rows)
            side = np.array(t.column("side").to_pylist())
            labels = np.array(t.column("label").to_pylist(), object)
            node, copies = (t.column(c).to_numpy() for c in ("node", "copies"))
            guest = ~t.column("home").to_numpy()
            units = t.column("unit").to_pylist()
            lo = 0
            for hi in edges:
                if hi == lo:
                    continue
                r = np.arange(lo, hi)
                lo = hi
                q, h = r[side[r] == "q"], r[side[r] == "h"]
                if not len(q) or not len(h):
                    continue
                x, y = (np.frombuffer(b"".join(units[i] for i in k)).reshape(len(k), -1) for k in (q, h))
                cos = x @ y.T
                i, j = np.nonzero(np.abs(cos - threshold) < ROUNDING)
                cos[i, j] = (x[i] * y[j]).sum(axis=1)
                hit = (cos >= threshold) & (node[q][:, None] != node[h]) & (labels[q][:, None] == labels[h])
                if not hit.any():
                    continue
                # a guest's links count here for both ends
                n = np.append(hit @ copies[h], copies[q][guest[q]] @ hit[guest[q]])
                some = np.flatnonzero(n)
                ends = np.append(node[q], node[h])[some]
                i, j = np.nonzero(hit)
                own, at = np.unique(np.concatenate([node[q], node[h]]), return_inverse=True)
                a, b = spanning(own, at[: len(q)][i], at[len(q) :][j])
                a, b = (np.append(x, ends) for x in (a, b))
                links = np.append(np.zeros(len(a) - len(some), np.int64), n[some])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "n"])

    found = materialize(tasks.mapInArrow(link, "a long, b long, n long"), "links")
    discard(dealt)
    n_links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = named_components(vectors, found.where("a != b").select("a", "b").distinct())
    classes = named.join(n_links, "node", "left").join(vectors.select("node", "label", "v", "copies"), "node")
    classes = materialize(classes.select("label", digest, "name", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    valid = t.where("v IS NOT NULL").select("id", "label", digest).join(classes, ["label", "digest"], "left").select("id", "name", "n_links")
    out = valid.unionByName(t.where("v IS NULL").select("id"), allowMissingColumns=True)
    component = F.coalesce("name", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read_documents(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE t AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), g AS MATERIALIZED (
  SELECT r, label, v FROM t
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), f AS MATERIALIZED (
  SELECT r, label, list_transform(v, lambda x: x / list_max(list_transform(v, lambda y: abs(y)))) AS v FROM g
), l AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM f a JOIN f b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), c AS (
  SELECT r AS a, r AS b FROM t UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a
), m AS (
  SELECT c.a, min(t.vec_id) AS component_id FROM c JOIN t ON t.r = c.b GROUP BY c.a
), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM t JOIN m ON m.a = t.r LEFT JOIN n ON n.a = t.r
"""

"""12. Centroid clustering: Lloyd rounds in exact integers, by matrix products where these are exact.

Vectors become integers, floor(64 x). Distances to the centroids are |x|^2 - 2 x.c + |c|^2 over blocks of
vectors: products in float64, which are exact as long as no sum can reach 2^53. That is known from the
largest component of a vector and of a centroid; vectors and centroids beyond the bound are computed
in int64 below 2^62, else in Python's integers. So results don't depend on blocks or partitions.

Vectors are written once as blocks of rows. Each round is one pass over them: ``treeAggregate``
combines sums and counts by centroid in executors, and the driver sees centroids only, whatever
the number of vectors. The centroids, ``clusters`` vectors, go to the tasks with the code.

Defined cases: null vectors, and those of another length or with a null, NaN or infinite component, are
left out; a null id may be clustered, and starts a centroid only if there are too few others; of rows with
one id, each is a vector (ordered by their components as starting centroids); fewer vectors than clusters: as
many clusters as vectors; no vectors: no rows; a distance, or a sum of them, beyond 2^63 - 1 is null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, materialize, small_batches, tidy

by_value(__name__)

DIMS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Rows of a block: 1 MB of float64 at 64 components.
BLOCK = 2048
#: Sums of products below this are exact in float64 in any order; below LONG_EXACT in int64.
FLOAT_EXACT, LONG_EXACT, LONG_MAX = 2**53, 2**62, 2**63 - 1

BLOCKS = "n long, ids binary, known binary, x binary"


def exact(x: float, scale: int) -> int:
    """floor(scale * x) of a float, for a scale that is a power of two."""
    y = x * scale
    # a product that overflows belongs to a float that is whole
    return int(np.floor(y)) if np.isfinite(y) else int(x) * scale


def exact_rows(x: np.ndarray, scale: int) -> np.ndarray:
    """The vectors as Python integers."""
    return np.array([[exact(v, scale) for v in row] for row in x.tolist()], object).reshape(x.shape)


def as_blocks(df: DataFrame, id_col: str, vec_col: str, dims: int, block: int = BLOCK) -> DataFrame:
    """The usable vectors as written blocks: ids (int64, and which are known) and components (float64), row after row."""
    small_batches(df.sparkSession)
    v = F.col("v")
    t = df.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("v"))
    t = t.where(v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))

    @tidy
    def pack(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            ids, known = b.column(0).fill_null(0).to_numpy(), np.asarray(b.column(0).is_valid())
            parts = [slice(k, k + block) for k in range(0, len(x), block)]
            cut = lambda a: pa.array([np.ascontiguousarray(a[p]).tobytes() for p in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([len(x[p]) for p in parts], pa.int64()), cut(ids), cut(known), cut(x)], names=["n", "ids", "known", "x"])

    return materialize(t.mapInArrow(pack, BLOCKS), "blocks")


class Centroids:
    """Integer centroids, and the products of them that every block needs."""

    def __init__(self, rows: list[list[int]], scale: int):
        self.rows, self.scale = rows, scale
        self.largest = np.array([max(map(abs, r), default=0) for r in rows], object)
        small = self.largest < FLOAT_EXACT
        self.floats = np.array([[float(v) if s else 0.0 for v in r] for r, s in zip(rows, small)]).reshape(len(rows), -1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances (rows, centroids) of a block of float64 vectors: int64 if they fit, else Python integers."""
        with np.errstate(over="ignore"):
            y = np.floor(x * self.scale)
        most = np.abs(y).max(1, initial=0.0)
        dims = x.shape[1]
        # |x|^2 + 2 |x.c| + |c|^2 <= dims * (|x| + |c|)^2, with room for the rounding of this very bound
        reach = np.minimum(most, FLOAT_EXACT)[:, None] + np.minimum(self.largest, FLOAT_EXACT).astype(float)[None, :] + 1
        fits = dims * reach**2 < FLOAT_EXACT
        if fits.all():
            return self.by_product(y, self.floats).astype(np.int64)
        out = np.empty(fits.shape, object)
        rows, cols = np.flatnonzero(fits.any(1)), np.flatnonzero(fits.any(0))
        if len(rows) and len(cols):
            d = self.by_product(np.where(fits.any(1)[:, None], y, 0)[rows], self.floats[cols])
            ok = fits[np.ix_(rows, cols)]
            d = np.where(ok, d, 0).astype(np.int64).astype(object)
            out[np.ix_(rows, cols)] = d
        for r in np.flatnonzero(~fits.all(1)):
            v, far = exact_rows(x[r : r + 1], self.scale)[0], np.flatnonzero(~fits[r])
            out[r, far] = self.in_integers(v, far)
        return out

    @staticmethod
    def by_product(y: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (y * y).sum(1)[:, None] - 2 * (y @ c.T) + (c * c).sum(1)[None, :]

    def in_integers(self, v: np.ndarray, which: np.ndarray) -> list[int]:
        c = np.array([self.rows[k] for k in which], object)
        if len(v) * (max(map(abs, v)) + max(self.largest[which])) ** 2 < LONG_EXACT:
            v, c = v.astype(np.int64), c.astype(np.int64)
        d = c - v[None, :]
        return [int(s) for s in (d * d).sum(1)]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid, the smaller number of equal ones."""
        d = self.distances(x)
        at = d.argmin(1)
        return at, d[np.arange(len(d)), at]


def vectors(row, dims: int) -> np.ndarray:
    return np.frombuffer(row.x, np.float64).reshape(row.n, dims)


def column_sums(x: np.ndarray, scale: int) -> list[int]:
    """Exact sums of the vectors' integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if np.abs(y).max(initial=0.0) < FLOAT_EXACT / (len(y) + 1):
        return [int(s) for s in y.sum(0)]
    return [int(s) for s in exact_rows(x, scale).sum(0)]


def add(a: list, b: list) -> list:
    """Componentwise sums of Python integers, by cluster."""
    return [[p + q for p, q in zip(r, s)] for r, s in zip(a, b)]


def first_vectors(blocks: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """The k vectors whose ``seed:id`` has the smallest SHA-256; every partition hands on k at most."""

    def hashed(row):
        ids, known = np.frombuffer(row.ids, np.int64), np.frombuffer(row.known, bool)
        x = vectors(row, dims)
        names = [(0, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()) if ok else (1, "") for i, ok in zip(ids.tolist(), known.tolist())]
        last = sorted(names)[:k][-1]
        some = sorted((name, x[j].tolist()) for j, name in enumerate(names) if name <= last)
        yield from some[:k]

    fewest = lambda a, b: sorted(a + b)[:k]
    found = blocks.rdd.flatMap(hashed).treeAggregate([], lambda a, v: fewest(a, [v]), fewest)
    return np.array([v for _, v in found], float).reshape(-1, dims)


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector, final centroids).

    ``scale`` is a power of two. Centroids start as ``first_vectors``; a round assigns every vector to its nearest
    centroid and moves every centroid that has vectors to the floor of their mean.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError("cluster: the scale must be a power of two")
    spark = df.sparkSession
    blocks = as_blocks(df, id_col, vec_col, dims)
    start = first_vectors(blocks, clusters, dims, seed)
    rows = exact_rows(start, scale).tolist()
    columns = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not rows:
        return spark.createDataFrame([], columns), rows
    for _ in range(rounds):
        c = Centroids(rows, scale)

        def add_block(total, row, c=c):
            x = vectors(row, dims)
            at, _ = c.nearest(x)
            own = [[int((at == k).sum()), *column_sums(x[at == k], scale)] for k in range(len(c.rows))]
            return add(total, own)

        sums = blocks.rdd.treeAggregate([[0] * (dims + 1) for _ in rows], add_block, add)
        rows = [[s // n for s in own] if n else old for (n, *own), old in zip(sums, rows)]

    last = Centroids(rows, scale)

    def inertia_of(total, row):
        at, d = last.nearest(vectors(row, dims))
        return add(total, [[sum(map(int, d[at == k]))] for k in range(len(rows))])

    inertia = [s for (s,) in blocks.rdd.treeAggregate([[0] for _ in rows], inertia_of, add)]
    digest = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in rows]
    fits = lambda v: int(v) if v <= LONG_MAX else None
    whole = fits(sum(inertia))
    schema = pa.schema([(id_col, pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid_sha256", pa.string())])

    @tidy
    def place(batches):
        for b in batches:
            for n, ids, known, x in zip(*[b.column(c).to_pylist() for c in ("n", "ids", "known", "x")]):
                at, d = last.nearest(np.frombuffer(x, np.float64).reshape(n, dims))
                out = [
                    pa.array(np.frombuffer(ids, np.int64), mask=~np.frombuffer(known, bool)),
                    pa.array(at.astype(np.int32)),
                    pa.array([fits(v) for v in d], pa.int64()),
                    pa.array([fits(inertia[k]) for k in at], pa.int64()),
                    pa.array([whole] * n, pa.int64()),
                    pa.array([digest[k] for k in at], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(out, schema=schema)

    return blocks.mapInArrow(place, columns), rows


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def _rounds_sql() -> str:
    near = lambda c: f"""SELECT vec_id, v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
  SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, {c}) GROUP BY vec_id, v"""  # noqa: E731
    out = []
    for r in range(ROUNDS):
        out.append(f"near{r} AS ({near(f'c{r}')})")
        out.append(
            f"""part{r} AS (SELECT k, j, CAST(floor_div(sum(x), count(*)) AS BIGINT) AS m FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM near{r}) GROUP BY k, j),
c{r + 1} AS (SELECT c{r}.k, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT k, list(m ORDER BY j) AS c FROM part{r} GROUP BY k) m ON c{r}.k = m.k)""".replace(
                "floor_div(sum(x), count(*))", "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
            )
        )
    out.append(f"final AS ({near(f'c{ROUNDS}')})")
    return ",\n".join(out)


SQL = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE}.0E0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
), c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS k, v AS c FROM kept QUALIFY k < {CLUSTERS}
), {_rounds_sql()},
inertia AS (SELECT k, CAST(sum(d) AS BIGINT) AS cluster_inertia, CAST(sum(sum(d)) OVER () AS BIGINT) AS inertia FROM final GROUP BY k)
SELECT vec_id, f.k AS cluster, d AS distance, cluster_inertia, inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM final f JOIN inertia i ON f.k = i.k JOIN c{ROUNDS} c ON f.k = c.k
"""

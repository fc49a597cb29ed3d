"""6. Quality classifier: perplexity under an interpolated modified Kneser-Ney model of bytes.

The model is of order ``order`` (4 at most, so that an n-gram is an integer) over the bytes of
trusted texts, white space folded, each text padded at its start. Counting and scoring are sharded:

1. Texts are cut into chunks (twice: once for the chunks themselves, once for their shards). A chunk keeps, for each distinct n-gram, the documents that have
   it and how often, cut into ``shards`` by the n-gram's hash, and the counts of its trusted texts.
2. Counts, continuation counts, discounts and context masses are aggregations and joins over
   distinct n-grams, from all trusted texts; so is the probability of every n-gram that any text has.
3. Each shard's chunks meet the shard's probabilities, a split of the text at a time; what comes back are a document's partial sums
   of log probabilities, one per shard, added up per chunk. Shards and splits follow the number of distinct n-grams, so that
   neither a group grows with the text or the model, nor the copies of the probabilities exceed a tenth of the text.
4. Per language, a quantile of the perplexities of trusted texts, times ``slack``, is the threshold.
   A language without trusted texts takes the threshold over all of them.

Trusted ids come from a table of labels; they are broadcast up to ``BROADCAST_IDS`` of them and
joined by exchange beyond.

Defined cases: a null or empty text has no n-gram, a null perplexity and is kept; a null language is
a language of its own; a text in ``labels`` twice is trusted if any row says so; repeated rows are
scored each; without a trusted text there is no model: perplexities and thresholds are null and all
is kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import pack_ints, unpack_ints
from .common import by_value, materialize, n_partitions, read_documents, small_batches, tidy

by_value(__name__)

ORDER, QUANTILE, SLACK = 4, 0.99, 1.1
CHUNK_BYTES, SHARDS = 4 << 20, 16
#: Text that is counted at a time, and distinct n-grams that a task holds before it hands them on.
COUNT_BYTES, COUNT_GRAMS = 1 << 20, 2_000_000
#: Text whose n-grams of one shard are one group, in bytes; more where the model is large.
SPLIT_BYTES = 64 << 20
#: Distinct n-grams of a shard, and bytes of text for each distinct n-gram of a split.
SHARD_GRAMS, GRAM_BYTES = 1 << 20, 160
#: All 32-bit n-grams in shards of ``SHARD_GRAMS``.
MAX_SHARDS = 1 << 12
BROADCAST_IDS = 1_000_000

_SPACE = re.compile(rb"[\x00-\x20]+")


def grams(text: bytes, order: int) -> np.ndarray:
    """The n-gram that ends at each byte, as integers; zeros pad the start."""
    b = np.frombuffer(_SPACE.sub(b" ", text), np.uint8)
    x = np.concatenate([np.zeros(order - 1, np.uint32), b.astype(np.uint32)])
    g = np.zeros(len(b), np.uint32)
    for k in range(order):
        g = (g << np.uint32(8)) | x[k : k + len(b)]
    return g


def mixed(gram: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit n-grams; its top bits are the shard."""
    return (gram.astype(np.uint32) * np.uint32(0x9E3779B1)) ^ np.uint32(0x7F4A7C15)


def discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    n = counts.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.1) if n[k - 1] else 0.5 for k in (1, 2, 3)]


def probabilities(counts: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """(gram, p) of every distinct gram of ``wanted``: the interpolated probability of its last byte after the others."""
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = materialize(tables[k + 1].groupBy((F.col("gram") % (1 << 8 * k)).alias("gram")).agg(F.count("*").alias("n")), f"grams{k}")
    p = None
    for k in range(1, order + 1):
        need = wanted.select((F.col("gram") % (1 << 8 * k)).alias("gram")).distinct() if k < order else wanted.select("gram")
        d = discounts(tables[k])
        n = F.col("n")
        less = F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
        context = F.shiftright("gram", 8).alias("context")
        mass = tables[k].groupBy(context).agg(F.sum("n").alias("total"), F.sum(less).alias("freed"))
        low = (F.col("gram") % (1 << 8 * (k - 1))).alias("low")
        j = need.select("gram", context, low).join(tables[k], "gram", "left").join(mass, "context", "left")
        if k == 1:
            j = j.withColumn("p_low", F.lit(1 / 256))
        else:
            j = j.join(p.select(F.col("gram").alias("low"), F.col("p").alias("p_low")), "low")
        seen = F.coalesce((n - less) / F.col("total"), F.lit(0.0)) + F.col("freed") / F.col("total") * F.col("p_low")
        p = materialize(j.select("gram", F.when(F.col("total").isNull(), F.col("p_low")).otherwise(seen).alias("p")), f"p{k}")
    return p


def dealing(distinct: int, text_bytes: int, shards: int, partitions: int) -> tuple[int, int]:
    """(shards, splits): groups as many as partitions, or as the n-grams and the text ask for."""
    while shards * SHARD_GRAMS < distinct and shards < MAX_SHARDS:
        shards *= 2
    return shards, max(1, partitions // shards, -(-text_bytes // max(SPLIT_BYTES, GRAM_BYTES * distinct)))


CHUNK = "key long, chunk long, ids array<long>, langs array<string>, trusted array<boolean>, a binary, b binary"


def chunk_rows(chunk: int, rows: list[tuple], order: int, shards: int, splits: int) -> pa.RecordBatch:
    """The chunk's own row (key: its number) and a row for each shard (key: -1 - shard - shards * split)."""
    ids, langs, trusted, texts = zip(*rows)
    found = [np.unique(mixed(grams(t, order)), return_counts=True) for t in texts]
    g = np.concatenate([f[0] for f in found])
    n = np.concatenate([f[1] for f in found])
    sizes = np.array([int(f[1].sum()) for f in found], np.uint32)
    out = [(chunk, chunk, ids, langs, trusted, sizes.astype("<u4").tobytes(), None)]
    # by gram, then by document
    key = g.astype(np.uint64) << np.uint64(32) | np.repeat(np.arange(len(found), dtype=np.uint64), [len(f[0]) for f in found])
    at = np.argsort(key)
    key, n = key[at], n[at]
    g, doc = (key >> np.uint64(32)).astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cuts = np.searchsorted(g, np.arange(shards, dtype=np.uint64) << np.uint64(32 - shards.bit_length() + 1)).tolist() + [len(g)]
    for s in range(shards):
        a, b = cuts[s], cuts[s + 1]
        if a == b:
            continue
        new = np.ones(b - a, bool)
        new[1:] = g[a + 1 : b] != g[a : b - 1]
        at = np.flatnonzero(new)
        gaps = np.diff(doc[a:b], prepend=0)
        gaps[at] = doc[a:b][at]
        heads = pack_ints(np.concatenate([np.diff(g[a:b][at], prepend=np.uint32(0)), np.diff(np.append(at, b - a))]).astype(np.uint32))
        out.append((-1 - s - shards * (chunk % splits), chunk, None, None, None, heads, pack_ints(np.concatenate([gaps, n[a:b]]).astype(np.uint32))))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["key", "chunk", "ids", "langs", "trusted", "a", "b"])


def perplexities(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, shards: int = SHARDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, lang, trusted, n_grams, perplexity) of every row. ``trusted``: a column ``id``, distinct."""
    if not 2 <= order <= 4:
        raise ValueError("perplexities: the order is 2 to 4")
    if shards & (shards - 1):
        raise ValueError("perplexities: the number of shards is a power of two")
    spark = df.sparkSession
    t = df.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").cast("binary").alias("t"))
    trusted = materialize(trusted.select(F.col("id").cast("long").alias("id"), F.lit(True).alias("trusted")), "trusted")
    trusted = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted
    t = t.join(trusted, "id", "left").select("id", "lang", F.coalesce("trusted", F.lit(False)).alias("trusted"), "t")
    small_batches(spark)
    @tidy
    def cut(batches):
        part, n_chunks, rows, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for b in batches:
            for i, lang, ok, text in zip(*(c.to_pylist() for c in b.columns)):
                rows.append((i, lang, ok, text or b""))
                size += len(text or b"") + 16
                if size >= chunk_bytes:
                    yield chunk_rows(part + n_chunks, rows, order, shards, splits)
                    n_chunks, rows, size = n_chunks + 1, [], 0
        if rows:
            yield chunk_rows(part + n_chunks, rows, order, shards, splits)

    @tidy
    def batch_grams(batches):
        # n-grams and their trusted counts so far, in order
        g, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(n)], names=["gram", "n"])

        def add(g, n, parts, weight):
            more, counts = np.unique(np.concatenate(parts), return_counts=True)
            every = np.unique(np.concatenate([g, more]))
            total = np.zeros(len(every), np.int64)
            total[np.searchsorted(every, g)] = n
            if weight:
                total[np.searchsorted(every, more)] += counts
            return every, total

        held: dict[bool, list] = {True: [], False: []}
        size = {True: 0, False: 0}
        for b in batches:
            for ok, x in zip(b.column("trusted").to_pylist(), b.column("t").to_pylist()):
                held[ok].append(grams(x or b"", order))
                size[ok] += len(x or b"")
                if size[ok] >= COUNT_BYTES:
                    g, n = add(g, n, held[ok], ok)
                    held[ok], size[ok] = [], 0
                    if len(g) >= COUNT_GRAMS:
                        yield out()
                        g, n = g[:0], n[:0]
        for ok in held:
            if held[ok]:
                g, n = add(g, n, held[ok], ok)
        yield out()

    every = t.select("trusted", "t").mapInArrow(batch_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    every = materialize(every, "grams")
    shards, splits = dealing(every.count(), t.agg(F.sum(F.octet_length("t"))).first()[0] or 0, shards, n_partitions(spark))
    p = probabilities(every.where("n > 0"), every, order)

    def spread(batches):
        for b in batches:
            g = b.column("gram").to_numpy()
            m = mixed(g).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(m >> (32 - shards.bit_length() + 1)), pa.array(m), pa.array(np.log(b.column("p").to_numpy()))], names=["shard", "gram", "logp"])

    p = p.mapInArrow(spread, "shard long, gram long, logp double")
    p = p.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    p = p.select((-1 - F.col("shard") - shards * F.col("split")).cast("long").alias("key"), "gram", "logp")
    dealt = t.mapInArrow(cut, CHUNK).repartition(n_partitions(spark), "key")

    def score(own: pa.Table, probs: pa.Table) -> pa.Table:
        g = probs.column("gram").to_numpy()
        order_ = np.argsort(g)
        g, logp = g[order_], probs.column("logp").to_numpy()[order_]
        out = []
        for key, chunk, heads, body in zip(*(own.column(c).to_pylist() for c in ("key", "chunk", "a", "b"))):
            heads, body = unpack_ints(heads), unpack_ints(body)
            mine, runs = np.cumsum(heads[: len(heads) // 2].astype(np.int64)), heads[len(heads) // 2 :].astype(np.int64)
            gaps, n = body[: len(body) // 2].astype(np.int64), body[len(body) // 2 :]
            # gaps start anew with each gram
            total = np.cumsum(gaps)
            first = np.cumsum(runs) - runs
            doc = total - np.repeat(total[first] - gaps[first], runs)
            lp = np.repeat(logp[np.searchsorted(g, mine)], runs) * n
            out.append((chunk, zstandard.compress(np.bincount(doc, lp).astype("<f8").tobytes(), 1)))
        cols = list(zip(*out)) or [(), ()]
        return pa.table({"key": pa.array(cols[0], pa.int64()), "sums": pa.array(cols[1], pa.binary())})

    sums = dealt.where("key < 0").groupBy("key").cogroup(p.groupBy("key")).applyInArrow(score, "key long, sums binary")

    def gather(own: pa.Table, parts: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in range(5)]
        for key, ids, langs, ok, sizes in zip(*(own.column(c).to_pylist() for c in ("key", "ids", "langs", "trusted", "a"))):
            total, n = np.zeros(len(ids)), np.frombuffer(sizes, "<u4")
            for raw in sorted(parts.column("sums").to_pylist()):
                v = np.frombuffer(zstandard.decompress(raw), "<f8")
                total[: len(v)] += v
            ppl = [float(np.exp(-a / k)) if k else None for a, k in zip(total, n.tolist())]
            for c, v in zip(cols, (ids, langs, ok, n.tolist(), ppl)):
                c.extend(v)
        kinds = [pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.float64()]
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("id", "lang", "trusted", "n_grams", "perplexity"), cols, kinds)})

    return dealt.where("key >= 0").groupBy("key").cogroup(sums.groupBy("key")).applyInArrow(gather, "id long, lang string, trusted boolean, n_grams long, perplexity double")


def classify(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, quantile: float = QUANTILE, slack: float = SLACK, **sizes) -> DataFrame:
    """One row per input row: id, lang, perplexity, threshold, keep."""
    scored = materialize(perplexities(df, trusted, id_col, text_col, lang_col, order, **sizes), "perplexities")
    if not scored.where("trusted AND perplexity IS NOT NULL").limit(1).count():
        return scored.select(F.col("id").alias(id_col), "lang", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"))
    at = F.percentile_approx("perplexity", quantile, 100_000) * slack
    good = scored.where("trusted AND perplexity IS NOT NULL")
    each = good.groupBy(F.col("lang").alias("l")).agg(at.alias("own"))
    out = scored.join(each, F.col("lang").eqNullSafe(F.col("l")), "left")
    limit = F.coalesce("own", F.lit(good.agg(at.alias("every")).first()["every"]))
    keep = F.coalesce(F.col("perplexity") <= limit, F.lit(True))
    return out.select(F.col("id").alias(id_col), "lang", "perplexity", limit.alias("threshold"), keep.alias("keep"))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.where("quality = 1").select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_documents(spark, sf_dir), trusted_ids(read_documents(spark, sf_dir, "labels")))

"""2. Best-fit packing of documents into token sequences.

Large-item matching: pieces above a third of the capacity go at most two to a sequence, paired
greedily (the longest with the longest that still fits); smaller pieces, longest first, go to the
sequence with the smallest gap that holds them, and open a new one only if there is none.

Packing depends on lengths alone, so it runs on the histogram of piece lengths: at most
``capacity`` numbers reach the driver, whatever the size of the corpus. The result is a list of
runs (which ranks of a length go to which sequences at which offset), again bounded by the number
of lengths. Every piece then finds its place from its rank among the pieces of its length, which is
its rank within its shard (a partition of the written piece table) plus the shard's base.

Defined cases: a null text counts as empty and packs as the closing token alone; repeated rows are
packed each; null ids are packed like others; an empty table gives no rows; further columns are
ignored. Documents longer than the capacity are cut into whole sequences, the first piece shorter.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_value, materialize, read_documents, small_batches

by_value(__name__)


def load_tokenizer(path: str) -> dict:
    """Ranks, special tokens and pattern of a byte-level BPE tokenizer file, to ship with tasks.

    Its merges must be in the order of their tokens' ids, so that ids are ranks; else ValueError.
    """
    import public_tokenizers

    spec = json.load(open(path, encoding="utf-8"))
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in chars]
    byte_of = {chr(b): b for b in chars} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [vocab[a + b] for a, b in merges]
    kind = spec["pre_tokenizer"]
    if made != sorted(made) or kind["type"] != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError(f"load_tokenizer: not a plain byte-level BPE in rank order: {path}")
    return {"pat_str": public_tokenizers.PATTERN, "mergeable_ranks": ranks, "special_tokens": special}


#: Runs of white space this long are beyond the pattern engine's stack: such texts are encoded match by match.
LONG_SPACE = re.compile(r"\s{10000}")


def encoder(tokenizer: dict):
    """A function from a text to its ids, special tokens included where their strings occur."""
    whole = tiktoken.Encoding("texts", **{**tokenizer, "special_tokens": {}})
    word = tiktoken.Encoding("words", pat_str="(?s).+", mergeable_ranks=tokenizer["mergeable_ranks"], special_tokens={})
    special = tokenizer["special_tokens"]
    cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    matches = regex.compile(tokenizer["pat_str"]).findall

    def encode(text: str) -> list[int]:
        if cut and cut.search(text):
            return [i for part in cut.split(text) for i in ([special[part]] if part in special else encode(part))]
        if LONG_SPACE.search(text):
            return [i for w in matches(text) for i in word.encode_ordinary(w)]
        return whole.encode_ordinary(text)

    return encode


def pack(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, ranks, sequences, first sequence, offset) and the number of sequences.

    Rank r of a run's length, counted from its first rank, goes to sequence r % sequences of the
    run, at offset + length * (r // sequences).
    """
    left = {n: c for n, c in counts.items() if c}
    gaps: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity + 1)]
    large = [n for n in sorted(left, reverse=True) if 3 * n > capacity]
    for n in large:
        for partner in large:
            if not left[n] or partner > n or n + partner > capacity:
                continue
            m = left[n] // 2 if partner == n else min(left[n], left[partner])
            if m:
                gaps[capacity - n - partner].append((m, [(n, 1), (partner, 1)] if partner != n else [(n, 2)]))
                left[n] -= m
                left[partner] -= m
        if left[n]:
            gaps[capacity - n].append((left[n], [(n, 1)]))
            left[n] = 0
    for n in [n for n in sorted(left, reverse=True) if 3 * n <= capacity]:
        todo = left[n]
        while todo:
            gap = next((g for g in range(n, capacity + 1) if gaps[g]), capacity)
            # no sequence has room: open as many as it takes
            m, items = gaps[gap].pop() if gaps[gap] else (todo, [])
            each = gap // n
            full = min(m, todo // each)
            if full:
                gaps[gap - each * n].append((full, [*items, (n, each)]))
                todo -= full * each
                m -= full
            if m and todo:
                gaps[gap - todo * n].append((1, [*items, (n, todo)]))
                todo, m = 0, m - 1
            if m and items:
                gaps[gap].append((m, items))
    runs, used, base = [], dict.fromkeys(counts, 0), 0
    for group in gaps:
        for m, items in group:
            offset = 0
            for n, k in items:
                runs.append((n, used[n], m * k, m, base, offset))
                used[n] += m * k
                offset += n * k
            base += m
    return runs, base


def token_pieces(df: DataFrame, tokenizer: dict, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids binary, shard, rank): ids are little-endian unsigned 32-bit."""

    small_batches(df.sparkSession)

    def run(batches):
        encode = encoder(tokenizer)
        shard, rank = TaskContext.get().partitionId(), {}
        for b in batches:
            cols = [[] for _ in range(6)]
            for at, text in enumerate(b.column(1).to_pylist()):
                ids = encode(text or "")
                ids.append(end_id)
                raw = np.array(ids, "<u4").tobytes()
                n, start, piece = len(ids), 0, 0
                size = n % capacity or capacity
                while start < n:
                    r = rank.get(size, 0)
                    rank[size] = r + 1
                    for c, v in zip(cols, (at, piece, start, size, raw[4 * start : 4 * (start + size)], r)):
                        c.append(v)
                    start, piece, size = start + size, piece + 1, capacity
            at, piece, start, size, raw, r = cols
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(raw, pa.binary()), pa.array([shard] * len(r), pa.int32()), pa.array(r, pa.int64())],
                names=["id", "piece", "start", "length", "ids", "shard", "rank"],
            )

    t = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return t.mapInArrow(run, "id long, piece int, start long, length long, ids binary, shard int, rank long")


def with_crc(pieces: DataFrame) -> DataFrame:
    """The CRC-32 of a piece's ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with sequence_id and offset in place of shard and rank. The pieces must be a written table."""
    per_shard = pieces.groupBy("shard", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_shard.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = pack(counts, capacity)
    by_length: dict[int, list] = {}
    for r in runs:
        by_length.setdefault(r[0], []).append(r[1:])
    table = {n: np.array(v, np.int64) for n, v in by_length.items()}
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = per_shard.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = pieces.join(base, ["shard", "length"])
    placed = placed.withColumn("rank", F.col("rank") + F.col("base")).drop("shard", "base")
    names = [c for c in placed.columns if c != "rank"]

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            size, rank = t.column("length").to_numpy(), t.column("rank").to_numpy()
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                own = table[int(n)]
                k = np.searchsorted(own[:, 0], rank[at], "right") - 1
                r = rank[at] - own[k, 0]
                seq[at] = own[k, 3] + r % own[k, 2]
                off[at] = own[k, 4] + n * (r // own[k, 2])
            t = t.select(names).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
            yield from t.combine_chunks().to_batches()

    schema = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in names)
    return placed.mapInArrow(run, schema + ", sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer: dict, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (or ids_crc32 without keep_ids), sequence_id, offset."""
    pieces = token_pieces(df, tokenizer, id_col, text_col, capacity, end_id)
    pieces = materialize(pieces if keep_ids else with_crc(pieces), "pieces")
    return place(pieces, capacity).withColumnRenamed("id", id_col)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    tokenizer = load_tokenizer(path or public_tokenizers.path("byte_bpe_50k.json"))
    return pack_documents(read_documents(spark, sf_dir), tokenizer, keep_ids=False)

"""4. Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Encoding:

1. Texts are pre-tokenised where they are read and gathered into chunks (whole documents, about
   ``chunk_bytes``). A chunk keeps its pre-tokens as positions in its own list of distinct words and
   sends these words out, grouped by ``buckets`` hash buckets.
2. Chunks are dealt by their number and words by their bucket. A bucket sees all words that
   hash to it, from all chunks, and encodes each distinct one once.
3. The ids of a chunk's words go back to the chunk, which puts its documents together by position.

Chunks and words are dealt apart, each from a reading of the texts of its own: pre-tokenising twice costs
less than holding a bucket's words beside the chunks. A word is sent once per chunk, however often it occurs there, so no word is hotter than the number of
chunks. Memory is bounded by a chunk and by a bucket's distinct words; ``buckets`` follows
spark.sql.shuffle.partitions.

Decoding looks each id up in the token-byte table (a vocabulary, bounded by ``MAX_TOKENS``, shipped
with the tasks) and joins the bytes.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows and null ids
are encoded like any other row; an empty table gives no rows; further columns are ignored. An id
that the table lacks stops decoding with an error.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, n_partitions, read_documents, small_batches, tidy

by_value(__name__)

MAX_TOKENS = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(ranks) > MAX_TOKENS:
        raise ValueError(f"load_ranks: more than {MAX_TOKENS} tokens")
    return ranks


def pack_ints(values: np.ndarray) -> bytes:
    """Compressed unsigned integers, byte plane by byte plane."""
    v = np.ascontiguousarray(values, "<u4")
    return zstandard.compress(len(v).to_bytes(8, "little") + v.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_ints(raw: bytes) -> np.ndarray:
    b = zstandard.decompress(raw)
    n = int.from_bytes(b[:8], "little")
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, 4 * n, 8).reshape(4, n).T).view("<u4").ravel()


def pack_words(words: list[bytes]) -> list[bytes]:
    return [pack_ints(np.fromiter(map(len, words), np.uint32, len(words))), zstandard.compress(b"".join(words), 1)]


def unpack_words(lens: bytes, raw: bytes) -> list[bytes]:
    ends = np.cumsum(unpack_ints(lens).astype(np.int64))
    raw = zstandard.decompress(raw)
    starts = np.append(0, ends)[:-1]
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


CHUNK = "key long, chunk long, ids array<long>, a binary, b binary, c binary"


def chunk_rows(chunk: int, ids: list, counts: list[int], positions: list[int], words: dict[str, int], buckets: int) -> pa.RecordBatch:
    """A chunk's own row (key: its number) and one row for each bucket that its words fall in (key: -1 - bucket)."""
    raw = [w.encode() for w in words]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    rows = [(chunk, chunk, ids, pack_ints(np.array(counts)), pack_ints(np.array(positions, np.uint32)), None)]
    for part in np.split(order, cuts) if len(raw) else []:
        rows.append((-1 - int(bucket[part[0]]), chunk, None, pack_ints(np.diff(part, prepend=0)), *pack_words([raw[i] for i in part])))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "chunk", "ids", "a", "b", "c"])


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the slices (start, length), one after the other."""
    total = np.cumsum(lens)
    return np.repeat(starts - total + lens, lens) + np.arange(total[-1] if len(total) else 0)


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20, buckets: int | None = None) -> DataFrame:
    """(id, ids array<int>) of every row; each match of ``pattern`` is encoded by itself."""
    spark = df.sparkSession
    small_batches(spark)
    buckets = buckets or n_partitions(spark)

    @tidy
    def cut(batches):
        find = regex.compile(pattern).findall
        part, n_chunks = TaskContext.get().partitionId() << 32, 0
        ids, counts, positions, words, size = [], [], [], {}, 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = find(text or "")
                ids.append(i)
                counts.append(len(found))
                positions += [words.setdefault(w, len(words)) for w in found]
                size += len(text or "") + 16
                if size >= chunk_bytes:
                    yield chunk_rows(part + n_chunks, ids, counts, positions, words, buckets)
                    n_chunks += 1
                    ids, counts, positions, words, size = [], [], [], {}, 0
        if ids:
            yield chunk_rows(part + n_chunks, ids, counts, positions, words, buckets)

    @tidy
    def encode_words(batches):
        # every word is one match
        one = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        known: dict[bytes, np.ndarray] = {}
        for b in batches:
            rows = []
            for key, chunk, at, lens, raw in zip(*(b.column(c).to_pylist() for c in ("key", "chunk", "a", "b", "c"))):
                found = []
                for w in unpack_words(lens, raw):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = [ranks[w]] if w in ranks else one(w.decode())
                    found.append(ids)
                counts = np.fromiter(map(len, found), np.uint32, len(found))
                rows.append((chunk, at, pack_ints(counts), pack_ints(np.fromiter((i for x in found for i in x), np.uint32))))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), *[pa.binary()] * 3])], names=["key", "a", "b", "c"])

    def assemble(own: pa.Table, words: pa.Table) -> pa.Table:
        out_ids, offsets, values = [], [0], []
        for k, ids, counts, positions in zip(*(own.column(c).to_pylist() for c in ("key", "ids", "a", "b"))):
            at, n, flat = [], [], []
            for a, b, c in zip(*(words.column(x).to_pylist() for x in ("a", "b", "c"))):
                at.append(np.cumsum(unpack_ints(a).astype(np.int64)))
                n.append(unpack_ints(b).astype(np.int64))
                flat.append(unpack_ints(c))
            none = [np.zeros(0, np.int64)]
            at, n, flat = (np.concatenate(x or none) for x in (at, n, flat))
            lens, starts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            lens[at], starts[at] = n, np.cumsum(n) - n
            where = unpack_ints(positions)
            each = lens[where]
            total = np.append(0, np.cumsum(each))
            ends = total[np.cumsum(unpack_ints(counts).astype(np.int64))]
            values.append(flat[ragged(starts[where], each)].astype(np.int32))
            offsets += (offsets[-1] + ends).tolist()
            out_ids += ids
        flat = pa.array(np.concatenate(values) if values else np.zeros(0, np.int32))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
        return pa.table({"id": pa.array(out_ids, pa.int64()), "ids": lists})

    t = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    dealt = t.mapInArrow(cut, CHUNK).repartition(n_partitions(spark), "key")
    words = dealt.where("key < 0").mapInArrow(encode_words, "key long, a binary, b binary, c binary")
    # buckets' words go no further: a group is one chunk
    out = dealt.where("key >= 0").groupBy("key").cogroup(words.groupBy("key")).applyInArrow(assemble, "id long, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of ``ids_col``'s tokens as ``out_col`` (null ids: null)."""
    if len(ranks) > MAX_TOKENS:
        raise ValueError(f"decode: more than {MAX_TOKENS} tokens")
    small_batches(df.sparkSession)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    names = [c for c in df.columns if c != out_col]

    def run(batches):
        tokens = pa.array(table, pa.large_binary())
        for b in batches:
            col = b.column(names.index(ids_col))
            col = col if isinstance(col, pa.ListArray) else col.cast(pa.list_(pa.int32()))
            flat = col.flatten()
            n = np.append(0, np.cumsum(np.array([x or 0 for x in col.value_lengths().to_pylist()], np.int64)))
            got = tokens.take(flat)
            ends = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1, got.offset * 8) if len(got) else np.zeros(1, np.int64)
            raw = got.buffers()[2]
            data = memoryview(raw) if raw is not None else memoryview(b"")
            at = ends[n].tolist()
            null = col.is_null().to_pylist()
            out = [None if z else bytes(data[p:q]) for z, p, q in zip(null, at, at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*names, out_col])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, f"{schema}, `{out_col}` binary")


def op4_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = decode(encode(read_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN), ranks)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""10. SimHash near-dedup with pigeonring filtering.

A text's fingerprint has a bit for each of ``bits`` hash bits of its word shingles: 1 if the bit is
set in over half of them. Two fingerprints link at ``max_diff`` or fewer differing bits.

Fingerprints are cut into m segments. By the pigeonring principle (Qin and Xiao, 2018) a pair
within max_diff has a segment from which on, around the ring, the first l segments together differ
in at most l * max_diff / m bits, for every l. With m > max_diff that first segment is equal, and at
least m - max_diff segments are. So the index's keys are sets of m - max_diff equal segments: the
pair meets in a cell whose set holds its chain's first segment, and nothing is lost. (By default 5 segments,
2 of them a key of 25 or 26 bits: ten cells a fingerprint, each of which holds few of billions.)
Rows that share a key meet in blocked cells (no task grows with a cell), the chains of ``chain`` segments that start at
the key's segments are checked with their cumulative budgets, and what survives gets the full
Hamming check. With m <= max_diff no segment need be equal: such parameters, which would lose pairs, are an error.

Copies never multiply: equal fingerprints are one row from the start, each task hands on a
spanning set of links in place of all pairs, and groups come from distributed components.

Defined cases: a null or wordless text has fingerprint zero and links like any other; a text with
fewer words than a shingle is one shingle; repeated rows share fingerprint and group; rows that
share an id but not a text are told apart by their fingerprints; a row with a null id gets its fingerprint's group but never names one (null if the group has no other id); an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocked, by_value, materialize, n_partitions, named_components, read_documents, small_batches, spanning, whole_groups

by_value(__name__)

SEED = 42
#: Shingles whose bits are summed at a time, and pairs that are compared at a time.
AT_ONCE, PAIRS_AT_ONCE = 1 << 15, 1 << 18


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased text, repeats included."""
    low = text.lower()
    found = low.split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    line = b" ".join(found)
    lens = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray, bits: int) -> bytes:
    """The majority bits, as big-endian 64-bit words. Words after the first take mixed hashes."""
    n, out = len(hashes), []
    for word in range(bits // 64):
        count = np.zeros(64, np.int64)
        for at in range(0, n, AT_ONCE):
            h = hashes[at : at + AT_ONCE]
            if word:
                h = (h + np.uint64(word)) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(31)
            count += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * count > n).tobytes())
    return b"".join(out)


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int = 3, bits: int = 64) -> DataFrame:
    """(id, fp binary, sha binary: SHA-256 of the text) of every row, each judged where it is read."""

    small_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            texts = [x or b"" for x in b.column(1).to_pylist()]
            fps = [fingerprint(shingle_hashes(x, words), bits) for x in texts]
            shas = [hashlib.sha256(x).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), pa.array(shas, pa.binary())], names=["id", "fp", "sha"])

    t = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return t.mapInArrow(run, "id long, fp binary, sha binary")


def joined(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels (each names a row that carries it) after the links left-right."""
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def cut_segments(fps: list[bytes], m: int) -> np.ndarray:
    """(fingerprints, m): the fingerprints' bits in m runs of nearly equal length."""
    if not fps:
        return np.zeros((0, m), np.uint16)
    bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1).astype(np.uint16)
    runs = np.array_split(np.arange(bits.shape[1]), m)
    return np.stack([bits[:, r] @ (1 << np.arange(len(r))).astype(np.uint16) for r in runs], axis=1)


def chain_links(segments: np.ndarray, starts: np.ndarray, group: np.ndarray, max_diff: int, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of equal ``group`` that link, enough of them to join all rows that links join.

    segments: (rows, m); starts: each row's equal segments, any of which may start a chain. Rows of a group stand
    together: shift s compares each row with the s-th after it, unless earlier links have joined the two already.
    """
    n, m = segments.shape
    found_l, found_r = [], []
    label, left, s = np.arange(n), np.arange(n - 1), 0
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else left
    while len(left):
        s += 1
        left = left[left + s < n]
        left = left[group[left] == group[left + s]]
        todo = left[label[left] != label[left + s]]
        for at in range(0, len(todo), PAIRS_AT_ONCE):
            i = todo[at : at + PAIRS_AT_ONCE]
            chained = np.zeros(len(i), bool)
            for start in starts.T:
                go = np.flatnonzero(~chained)
                spent = np.zeros(len(go), np.int64)
                for length in range(1, chain + 1):
                    k = (start[i[go]] + length - 1) % m
                    spent = spent + np.bitwise_count(segments[i[go], k] ^ segments[i[go] + s, k])
                    ok = spent * m <= length * max_diff
                    go, spent = go[ok], spent[ok]
                chained[go] = True
            i = i[chained]
            i = i[np.bitwise_count(segments[i] ^ segments[i + s]).sum(axis=1, dtype=np.int64) <= max_diff]
            if len(i):
                found_l.append(i)
                found_r.append(i + s)
                label = joined(label, i, i + s)
        if s % 32 == 0:  # groups that hang together are done
            whole = np.minimum.reduceat(label, heads) == np.maximum.reduceat(label, heads)
            left = left[~whole[np.searchsorted(heads, left, "right") - 1]]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found_l or none), np.concatenate(found_r or none)


def hamming_groups(rows: DataFrame, bits: int = 64, max_diff: int = 3, segments: int = 5, chain: int = 3, block: int = 2048) -> DataFrame:
    """(fp, component) for each distinct fingerprint of ``rows`` (id, fp); components are named by the smallest id (null: none has any)."""
    keyed = np.array(list(combinations(range(segments), max(1, segments - max_diff))))
    width = -(-bits // segments)
    if width > 16 or len(keyed).bit_length() + width * keyed.shape[1] > 63:
        raise ValueError("hamming_groups: a segment has 16 bits at most, an index key 63")
    if segments <= max_diff:
        raise ValueError("hamming_groups: more segments than differing bits are needed, or pairs would be lost")
    spark = rows.sparkSession
    distinct = rows.groupBy("fp").agg(F.min("id").alias("rep"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "fingerprints")

    def index(batches):
        for b in batches:
            seg = cut_segments(b.column("fp").to_pylist(), segments).astype(np.int64)
            for n, key in enumerate(keyed):
                cell = np.full(len(seg), n)
                for k in key:
                    cell = cell << width | seg[:, k]
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("fp"), pa.array(cell)], names=["node", "fp", "cell"])

    cells = distinct.select("node", "fp").mapInArrow(index, "node long, fp binary, cell long")
    tasks = blocked(cells, ["cell"], "node", block)
    keys = ["cell", "lo", "hi"]
    tasks = tasks.select(*keys, "node", "fp").repartition(n_partitions(spark), *keys).sortWithinPartitions(*keys)

    def link(batches):
        for t in whole_groups(batches, keys):
            k = [t.column(x).to_numpy() for x in keys]
            seg = cut_segments(t.column("fp").to_pylist(), segments)
            new = np.zeros(t.num_rows, bool)
            for v in k:
                new[1:] |= v[1:] != v[:-1]
            ids = t.column("node").to_numpy()
            left, right = chain_links(seg, keyed[k[0] >> width * keyed.shape[1]], np.cumsum(new), max_diff, min(chain, segments))
            a, b = spanning_rows(ids, left, right)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = tasks.mapInArrow(link, "a long, b long").distinct()
    named = named_components(distinct, links)
    return materialize(distinct.select("node", "fp").join(named, "node").select("fp", F.col("name").alias("component")), "groups")


def spanning_rows(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``spanning`` for links between rows, where an id can have several rows."""
    own, at = np.unique(ids, return_inverse=True)
    return spanning(own, at[left], at[right]) if len(left) else (own[:0], own[:0])


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, bits: int = 64, max_diff: int = 3, segments: int = 5) -> DataFrame:
    """One row per input row: id, fingerprint (hex), component_id (smallest id of the group), text_sha256."""
    rows = materialize(fingerprints(df, id_col, text_col, words, bits), "simhash")
    groups = hamming_groups(rows, bits, max_diff, segments)
    out = rows.join(groups, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"), F.lower(F.hex("sha")).alias("text_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_documents(spark, sf_dir), words=3).drop("text_sha256")

"""7. Suffix-array dedup: byte strings of ``length`` that start more than once, by longest previous factors.

Which bytes are covered by a ``length``-byte string that also starts elsewhere? A suffix array of a
whole corpus is no distributed structure, so the corpus is cut into shards between which no such
string is shared:

* Of equal texts one stands for all (grouped by SHA-256); the others are judged by it.
* Every window of ``length`` bytes has an anchor, the first of the smallest hashes among its
  ``GRAM``-byte grams. Equal windows have anchors of equal hash, at the same place. The windows of
  one anchor are a region.
* A hash that only one region has belongs to windows that start nowhere else. The other regions
  are gathered by anchor: all windows that could be equal are in one shard.

A task takes anchors in turn, collapses equal regions, and over what differs builds a suffix array
to depth ``length`` (prefix doubling), ordered by text position within equal prefixes. The previous
and next smaller position in suffix order, where their common prefix reaches ``length``, are the
longest previous factor's source: such a window is a copy of an earlier one. ``keep="first"``
removes those later copies; ``keep="none"`` removes the earlier one too.

An anchor whose regions exceed ``HOT_BYTES`` does not go to one task: of its equal regions one stands
for all (grouped by their bytes), and the windows of those that differ are counted by a 128-bit digest
in an ordinary aggregation, which any number of tasks can share. A text that a large part of all documents
quote has the anchors of its edges in as many different regions, so this is not rare; regions that
differ outside of the quoted text alone can't be told apart by further grams, and comparing blocks of
them pair by pair would grow with the square of their number.

With ``words`` the same is asked of words: a text is then also a string of word hashes, of which
``CODE`` bytes are kept, so that a passage of so many words is a string of fixed length, whatever its
words' lengths and white space. Both questions share the scan, the exchanges and the shards.

Positions are ordered by (id, row). Matches never cross texts. Strings are judged on the input.

Defined cases: a null text counts as empty; texts shorter than ``length`` keep every byte; rows that
repeat an id and text are separate copies for ``keep="none"`` and cut alike; null ids sort last; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, discard, materialize, n_partitions, read_documents, small_batches, tidy

by_value(__name__)

LENGTH, GRAM = 400, 64
#: Words of a gram of words.
WORD_GRAM = 8
#: Text that is hashed at a time, that a suffix array is built over, beyond which an anchor is hot, and that is handed on at a time.
AT_ONCE, BATCH_BYTES, HOT_BYTES, OUT_BYTES = 1 << 20, 1 << 19, 4 << 20, 4 << 20
#: Windows of a region at most.
REGION_WINDOWS = 4096
#: Bytes that stand for a word.
CODE = 5
#: The two kinds of strings: of bytes, of words.
BYTES, WORDS = 0, 1
#: Mask of a place among the text that is hashed at a time, two pieces at most.
PLACE = (1 << 22) - 1

U = np.uint64


def units_of(text: bytes, kind: int) -> np.ndarray:
    """The text as a string of bytes, or of a hash for each word."""
    if kind == BYTES:
        return np.frombuffer(text, np.uint8)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in text.split()], U) & U((1 << 8 * CODE) - 1)


def packed(units: np.ndarray) -> bytes:
    """A string of either kind as bytes."""
    return units.tobytes() if units.dtype == np.uint8 else units.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE].tobytes()


def unpacked(raw: bytes, kind: int) -> np.ndarray:
    if kind == BYTES:
        return np.frombuffer(raw, np.uint8)
    out = np.zeros((len(raw) // CODE, 8), np.uint8)
    out[:, :CODE] = np.frombuffer(raw, np.uint8).reshape(-1, CODE)
    return out.view("<u8").ravel()


def first_keys(units: np.ndarray) -> tuple[np.ndarray, int]:
    """An integer for the first units from each place on, in their order, and how many: 8 bytes (zeros beyond the end) or a word."""
    if units.dtype != np.uint8:
        return units, 1
    padded = np.concatenate([units, np.zeros(8, np.uint8)])
    x = np.empty(len(units), U)
    for o in range(8):
        m = len(x[o::8])
        x[o::8] = np.frombuffer(padded[o : o + 8 * m].tobytes(), ">u8")
    return x, 8


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram of ``gram`` units (a power of two; at least 8 of bytes)."""
    x, size = first_keys(units)
    x = x[: len(units) - size + 1] * U(0x9E3779B97F4A7C15)
    x ^= x >> U(31)
    while size < gram:
        y = x[:-size] * U(0xBF58476D1CE4E5B9)
        y += x[size:]
        y ^= y >> U(29)
        y *= U(0x94D049BB133111EB)
        y ^= y >> U(32)
        x, size = y, size * 2
    return x


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours (van Herk)."""
    n = len(x)
    pad = np.full(-n % w, ~U(0))
    rows = np.concatenate([x, pad]).reshape(-1, w)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def regions_of(buf: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, start, windows, many) of the regions of the texts that end at ``ends`` in ``buf``.

    Neighbouring regions of equal hash, as in periodic text, are one of ``many`` anchors, in pieces of
    ``REGION_WINDOWS`` at most.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none
    hashes = gram_hashes(buf, gram)
    # the low bits give way to the place: of equal hashes the first counts, and places differ
    low = window_minimum((hashes & ~U(PLACE)) | np.arange(len(hashes), dtype=U), length - gram + 1)
    text = np.searchsorted(ends, np.arange(len(low)), "right")
    ok = np.arange(len(low)) + length <= ends[text]
    new = ok.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~ok[:-1]
    starts = np.flatnonzero(new)
    if not len(starts):
        return none, none, none, none
    # a region ends where the next starts or the text's windows do
    stop = np.minimum(np.append(starts[1:], len(low)), ends[text[starts]] - length + 1)
    anchor = hashes[(low[starts] & U(PLACE)).astype(np.int64)].view(np.int64)
    first = np.ones(len(starts), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (stop[:-1] != starts[1:])
    at = np.flatnonzero(first)
    anchors = np.diff(np.append(at, len(starts)))
    anchor, starts, stop = anchor[at], starts[at], stop[np.append(at[1:], len(stop)) - 1]
    pieces = -(-(stop - starts) // REGION_WINDOWS)
    own = np.repeat(np.arange(len(at)), pieces)
    begin = starts[own] + REGION_WINDOWS * (np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return anchor[own], begin, np.minimum(stop[own] - begin, REGION_WINDOWS), (anchors > 1)[own].astype(np.int64)


def text_regions(texts: list[np.ndarray], length: int, gram: int) -> list[tuple[list, list, list, list]]:
    """The regions of each text, AT_ONCE units at a time. Long texts are cut with windows whole."""
    out: list[tuple[list, list, list, list]] = [([], [], [], []) for _ in texts]
    held, size = [], 0

    def flush() -> None:
        if not held:
            return
        buf = np.concatenate([x[2] for x in held])
        ends = np.cumsum([len(x[2]) for x in held])
        anchor, start, windows, many = regions_of(buf, ends, length, gram)
        of = np.searchsorted(ends, start, "right")
        shift = np.array([x[1] for x in held]) - np.append(0, ends[:-1])
        at = np.searchsorted(of, np.arange(len(held) + 1))
        start = start + shift[of]
        for k, (i, _, _) in enumerate(held):
            for col, v in zip(out[i], (anchor, start, windows, many)):
                col.extend(v[at[k] : at[k + 1]].tolist())
        held.clear()

    for i, t in enumerate(texts):
        for o in range(0, max(1, len(t) - length + 1), AT_ONCE):
            part = t[o : o + AT_ONCE + length - 1]
            if len(part) >= length:
                held.append((i, o, part))
                size += len(part)
            if size >= AT_ONCE:
                flush()
                size = 0
    flush()
    return out


def ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the keys."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.zeros(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    del s
    out = np.empty(len(new), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def prefix_ranks(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Rank of the string of ``length`` units at each position of ``at`` in suffix order, by prefix doubling."""
    n = len(buf)
    x, size = first_keys(buf)
    r = ranks(x)
    del x
    while 2 * size <= length:
        pair = r.astype(np.int64)
        pair *= n + 1
        pair[: n - size] += r[size:]
        r = ranks(pair)
        size *= 2
    if size == length:
        return ranks(r[at])
    return ranks(r[at].astype(np.int64) * (n + 1) + r[np.minimum(at + length - size, n - 1)])


def smaller_positions(position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the previous and the next entry with a smaller position (-1: none)."""
    n = len(position)
    p = np.append(position, -1)  # index -1 stops every search
    both = []
    for step in (-1, 1):
        found = np.arange(n) + step
        found[found == n] = -1
        todo = np.flatnonzero(p[found] > position)
        while len(todo):
            # what lies between an entry and its candidate is larger than the entry: jump over it
            found[todo] = found[found[todo]]
            todo = todo[p[found[todo]] > position[todo]]
        both.append(found)
    return both[0], both[1]


def copied_windows(buf: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(has an earlier copy, has any copy) for the windows that start at ascending positions ``at``."""
    rank = prefix_ranks(buf, at, length)
    order = np.lexsort((at, rank))
    r = rank[order]
    before, after = smaller_positions(at[order])
    earlier = np.zeros(len(at), bool)
    for source in (before, after):
        earlier |= (source >= 0) & (r[source] == r)
    later = np.zeros(int(rank.max(initial=-1)) + 1, bool)
    later[r[earlier]] = True
    out = np.zeros(len(at), bool)
    out[order] = earlier
    return out, later[rank]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    d = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(d[::2].tolist(), d[1::2].tolist()))


def shard_spans(group: list[tuple], length: int, first: bool, kind: int = BYTES) -> list[tuple[int, int, int]]:
    """(row, from, to) of the units to remove, given the regions (anchor, row, start, windows, bytes, many) of whole anchors, in order."""
    distinct: dict[tuple, list] = {}
    per_anchor: dict[int, int] = {}
    for anchor, row, start, windows, raw, many in group:
        copies = distinct.setdefault((anchor, raw), [])
        if not copies:
            per_anchor[anchor] = per_anchor.get(anchor, 0) + 1 + many
        copies.append((row, start, windows))
    out = []
    differ = []
    for (anchor, raw), copies in distinct.items():
        same = copies[1:] if first else copies
        if len(copies) > 1:
            out += [(row, start, start + windows + length - 1) for row, start, windows in same]
        if per_anchor[anchor] > 1:
            differ.append((raw, copies))
    if differ:
        buf = unpacked(b"".join(raw for raw, _ in differ), kind)
        n = np.array([c[0][2] for _, c in differ])
        ends = np.cumsum(n + length - 1)
        base = np.append(0, ends[:-1])
        at = np.repeat(base - np.cumsum(n) + n, n) + np.arange(n.sum())
        earlier, both = copied_windows(buf, at, length)
        flags, cut = (earlier if first else both), np.append(0, np.cumsum(n))
        for k, (_, copies) in enumerate(differ):
            row, start, _ = copies[0]
            if first or len(copies) == 1:
                out += [(row, start + a, start + b + length - 1) for a, b in runs(flags[cut[k] : cut[k + 1]])]
    return out


def digest_windows(units: np.ndarray, windows: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each window."""
    out = []
    for seed in (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)):
        x, size = first_keys(units)
        x = x[: len(units) - size + 1] * seed
        x ^= x >> U(28)
        while size * 2 <= length:
            y = x[:-size] * (seed | U(1))
            y += x[size:]
            y ^= y >> U(31)
            y *= U(0x94D049BB133111EB)
            x, size = y, size * 2
        y = x[: len(x) - (length - size)] * U(0xE7037ED1A0B428DB) + x[length - size :]
        y ^= y >> U(30)
        out.append((y * seed)[:windows].view(np.int64))
    return out[0], out[1]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def tagged(anchor: list[int], kind: int) -> list[int]:
    """Anchors whose lowest bit is the kind."""
    return [a & ~1 | kind for a in anchor]


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: str = "none", gram: int = GRAM, words: int | None = None, word_gram: int = WORD_GRAM, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """One row per input row: id, sha (of the text), n_bytes, spans array<struct<from, to>> (maximal, ascending) to remove.

    With ``words``: also passages, the spans of words in repeated passages of so many words; ``in_bytes`` turns
    them into bytes of the text. Without it, passages are empty.
    """
    if keep not in ("none", "first"):
        raise ValueError("repeated_spans: keep is 'none' or 'first'")
    if length < 2 * gram or gram < 8 or gram & (gram - 1):
        raise ValueError("repeated_spans: gram is a power of two, 8 at least, and half the length at most")
    if words and (words < 2 * word_gram or word_gram & (word_gram - 1)):
        raise ValueError("repeated_spans: word_gram is a power of two, and half the words at most")
    spark, first = df.sparkSession, keep == "first"
    small_batches(spark)
    t = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    kinds = {BYTES: (length, gram)} | ({WORDS: (words, word_gram)} if words else {})

    @tidy
    def scan(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            shas = [hashlib.sha256(x).digest() for x in texts]
            found, n_words = [([], [], [], []) for _ in texts], [0] * len(texts)
            for kind, sizes in kinds.items():
                units = [units_of(x, kind) for x in texts]
                if kind == WORDS:
                    n_words = [len(x) for x in units]
                for all_, own in zip(found, text_regions(units, *sizes)):
                    for k, v in enumerate((tagged(own[0], kind), *own[1:])):
                        all_[k].extend(v)
            cols = [pa.array([r[k] for r in found], pa.list_(pa.int64())) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shas, pa.binary()), pa.array([len(x) for x in texts], pa.int64()), pa.array(n_words, pa.int64()), *cols], names=["id", "sha", "n_bytes", "n_words", "anchor", "start", "windows", "many"])

    rows = t.select("id", F.col("t").cast("binary")).mapInArrow(scan, "id long, sha binary, n_bytes long, n_words long, anchor array<long>, start array<long>, windows array<long>, many array<long>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "regions")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    reps = rows.groupBy("sha").agg(F.min(order).alias("rep"), F.count("*").alias("copies"))
    reps = materialize(reps.select("sha", F.col("rep.id").alias("id"), F.col("rep.row").alias("row"), "copies"), "texts")

    # regions whose anchor another region has, too
    regions = rows.where("size(anchor) > 0").join(reps.select("row"), "row")
    regions = regions.select("row", F.explode(F.arrays_zip("anchor", "start", "windows", "many")).alias("r")).select("row", "r.*")
    n_bytes = F.when(F.col("anchor") % 2 == BYTES, F.col("windows") + (length - 1)).otherwise((F.col("windows") + ((words or 1) - 1)) * CODE)
    shared = regions.groupBy("anchor").agg((F.count("*") + F.sum("many")).alias("n"), F.sum(n_bytes).alias("bytes"))
    shared = materialize(shared.where("n > 1").select("anchor", (F.col("bytes") > hot_bytes).alias("hot")), "anchors")
    regions = regions.join(shared, "anchor").groupBy("row").agg(F.collect_list(F.struct("anchor", "start", "windows", "many", "hot")).alias("rs"))
    regions = regions.join(reps.select("row", "id", "sha"), "row")
    with_text = t.withColumn("sha", F.unhex(F.sha2("t", 256))).select(F.col("id").alias("tid"), F.col("sha").alias("tsha"), F.col("t").cast("binary").alias("t"))
    cut = with_text.join(regions.hint("shuffle_hash"), (F.col("tsha") == F.col("sha")) & F.col("tid").eqNullSafe(F.col("id")))

    @tidy
    def extract(batches):
        types = [pa.int64()] * 5 + [pa.binary(), pa.int64(), pa.bool_()]
        names = ["anchor", "id", "row", "start", "windows", "raw", "many", "hot"]
        held, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*held)) or [()] * 8, types)], names=names)

        for b in batches:
            for row, i, t, rs in zip(*(b.column(c) for c in ("row", "id", "t", "rs"))):
                raw, row, i, rs = t.as_py(), row.as_py(), i.as_py(), rs.as_py()
                units = {kind: units_of(raw, kind) for kind in {r["anchor"] & 1 for r in rs}}
                for r in rs:
                    at, kind = r["start"], r["anchor"] & 1
                    piece = packed(units[kind][at : at + r["windows"] + kinds[kind][0] - 1])
                    held.append((r["anchor"], i, row, at, r["windows"], piece, r["many"], r["hot"]))
                    size += len(piece)
                    if size >= OUT_BYTES:
                        yield out()
                        held, size = [], 0
        yield out()

    pieces = cut.select("row", "id", "t", "rs").mapInArrow(extract, "anchor long, id long, row long, start long, windows long, raw binary, many long, hot boolean")
    pieces = materialize(pieces, "pieces")
    discard(shared)
    keys = ["anchor", F.col("id").asc_nulls_last(), "row", "start"]
    dealt = pieces.where("NOT hot").repartition(n_partitions(spark), "anchor").sortWithinPartitions(*keys)

    @tidy
    def judge(batches):
        def result(group):
            found = []
            for kind, (n, _) in kinds.items():
                found += [(row, kind, a, b) for row, a, b in shard_spans([x for x in group if x[0] & 1 == kind], n, first, kind)]
            cols = list(zip(*found)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row", "kind", "from", "to"])

        group, size, last = [], 0, None
        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("anchor", "row", "start", "windows", "raw", "many"))):
                if last and x[:3] == last[:3]:
                    continue  # a row that repeats id and text met the regions twice
                if last and x[0] != last[0] and size >= BATCH_BYTES:
                    yield result(group)
                    group, size = [], 0
                group.append(x)
                size += len(x[4])
                last = x
        if group:
            yield result(group)

    spans = dealt.mapInArrow(judge, "row long, kind long, from long, to long")

    # hot anchors: equal regions, then the windows of those that differ
    at = F.struct(F.col("id").isNull().alias("last"), "id", "row", "start")
    hot = pieces.where("hot").dropDuplicates(["row", "anchor", "start"])
    alike = hot.groupBy("anchor", "raw", "windows").agg(F.count("*").alias("copies"), F.min(at).alias("first"))
    alike = materialize(alike.withColumn("digest", F.md5("raw")), "alike")
    copies = hot.select("anchor", "windows", F.md5("raw").alias("digest"), "row", "start").join(alike.where("copies > 1").drop("raw"), ["anchor", "windows", "digest"])
    if first:
        copies = copies.where((F.col("first.row") != F.col("row")) | (F.col("first.start") != F.col("start")))
    kind = F.pmod("anchor", F.lit(2))
    size = F.when(kind == BYTES, length).otherwise(words or 1)
    copies = copies.select("row", kind.alias("kind"), F.col("start").alias("from"), (F.col("start") + F.col("windows") + size - 1).alias("to"))

    @tidy
    def digests(batches):
        for b in batches:
            for anchor, raw, windows, copies, at in zip(*(b.column(c).to_pylist() for c in ("anchor", "raw", "windows", "copies", "first"))):
                kind = anchor & 1
                d1, d2 = digest_windows(unpacked(raw, kind), windows, kinds[kind][0])
                n = len(d1)
                same = lambda v: pa.array(np.full(n, v))
                yield pa.RecordBatch.from_arrays([same(kind), pa.array(d1), pa.array(d2), pa.array([at["id"]] * n, pa.int64()), same(at["row"]), pa.array(at["start"] + np.arange(n)), same(copies)], names=["kind", "d1", "d2", "id", "row", "from", "copies"])

    hot = alike.select("anchor", "raw", "windows", "copies", "first").mapInArrow(digests, "kind long, d1 long, d2 long, id long, row long, from long, copies long")
    at = F.struct(F.col("id").isNull().alias("last"), "id", "row", "from")
    many = hot.groupBy("kind", "d1", "d2").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1")
    many = materialize(many, "digests")
    hot = hot.join(many, ["kind", "d1", "d2"])
    hot = hot.where((F.col("first.row") != F.col("row")) | (F.col("first.from") != F.col("from"))) if first else hot

    @F.udf("array<struct<from: bigint, to: bigint>>", useArrow=True)
    def merge(found):
        return merged([(x["from"], x["to"]) for x in found])

    # windows of a stretch of text first, so that a long text's are not gathered one by one
    hot = hot.select("row", "kind", "from", (F.col("from") + F.when(F.col("kind") == BYTES, length).otherwise(words or 1)).alias("to"))
    hot = hot.unionByName(copies).groupBy("row", "kind", F.floor(F.col("from") / REGION_WINDOWS)).agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    spans = spans.unionByName(hot.select("row", "kind", merge("spans").alias("spans")).select("row", "kind", F.inline("spans")))
    spans = spans.groupBy("row", "kind").agg(F.collect_list(F.struct("from", "to")).alias("spans")).select("row", "kind", merge("spans").alias("spans"))
    spans = spans.groupBy("row").agg(*[F.max(F.when(F.col("kind") == k, F.col("spans"))).alias(c) for k, c in ((BYTES, "spans"), (WORDS, "passages"))])
    per_text = materialize(reps.join(spans, "row", "left").select("sha", "row", "copies", "spans", "passages"), "spans")
    discard(pieces)
    discard(alike)
    discard(many)
    out = rows.select("id", "sha", "n_bytes", "n_words", "row").join(per_text.withColumnRenamed("row", "rep"), "sha")
    again = F.col("copies") > 1
    again = again & (F.col("row") != F.col("rep")) if first else again
    all_of = lambda n: F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col(n).alias("to")))
    none = F.expr("cast(array() as array<struct<from: bigint, to: bigint>>)")
    whole = lambda c, n, least: F.when(again & (F.col(n) >= least), all_of(n)).otherwise(F.coalesce(c, none)).alias(c)
    passages = whole("passages", "n_words", words) if words else none.alias("passages")
    return out.select(F.col("id").alias(id_col), "sha", "n_bytes", whole("spans", "n_bytes", length), passages)


def in_bytes(text: bytes, passages: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The bytes of ``text`` that spans of its words cover: whole words and the white space after them."""
    if not passages:
        return []
    starts, at = [], 0
    for w in text.split():
        at = text.index(w, at)
        starts.append(at)
        at += len(w)
    starts.append(len(text))
    return [(starts[a], starts[b]) for a, b in passages]


def pairs(found) -> list[tuple[int, int]]:
    return [(x["from"], x["to"]) for x in found or []]


def cut_spans(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "kept") -> DataFrame:
    """(id, n_bytes, spans, ``out_col`` binary: the bytes that stay, passages: in bytes), one row per row of ``df``. Passages are not cut.

    ``spans`` comes from ``repeated_spans`` on ``df``. Rows that repeat an id and text share the spans of one of them.
    """
    t = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    t = t.select("id", F.unhex(F.sha2("t", 256)).alias("sha"), F.col("t").cast("binary").alias("t"))
    s = spans.select(F.col(id_col).alias("sid"), F.col("sha").alias("ssha"), F.struct("spans", "passages").alias("found"))
    s = s.groupBy("sid", "ssha").agg(F.min("found").alias("found")).select("sid", "ssha", "found.*")
    j = t.join(s.hint("shuffle_hash"), (F.col("sha") == F.col("ssha")) & F.col("id").eqNullSafe(F.col("sid")))
    kind = "array<struct<from: bigint, to: bigint>>"

    @tidy
    def run(batches):
        for b in batches:
            out, sizes, passages = [], [], []
            for t, found, words in zip(b.column("t"), b.column("spans"), b.column("passages")):
                raw, at, parts = t.as_py(), 0, []
                for s in found.as_py():
                    parts.append(raw[at : s["from"]])
                    at = s["to"]
                out.append(b"".join([*parts, raw[at:]]))
                sizes.append(len(raw))
                passages.append([{"from": a, "to": z} for a, z in in_bytes(raw, pairs(words.as_py()))])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int64()), b.column("spans"), pa.array(out, pa.binary()), pa.array(passages, b.column("spans").type)], names=["id", "n_bytes", "spans", "out", "passages"])

    out = j.select("id", "t", "spans", "passages").mapInArrow(run, f"id long, n_bytes long, spans {kind}, out binary, passages {kind}")
    return out.select(F.col("id").alias(id_col), "n_bytes", "spans", F.col("out").alias(out_col), "passages")


def cut_texts(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``df`` with the spans and passages cut from its texts, and ``size_col`` (their characters) after them.

    Characters that a span covers in part stay. Texts of which only white space is left by a cut go;
    texts without a span, null ones included, stay as they are.
    """
    s = spans.where("size(spans) > 0 OR size(passages) > 0").select(F.col(id_col).alias("sid"), F.col("sha").alias("ssha"), F.struct("spans", "passages").alias("found"))
    s = s.groupBy("sid", "ssha").agg(F.min("found").alias("found"))
    # the caller's columns are one of ours, so that no name can clash
    own = lambda c: F.col("row").getField(c)
    d = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    d = d.withColumn("sha", F.unhex(F.sha2(F.coalesce(own(text_col).cast("string"), F.lit("")), 256)))
    j = d.join(s.hint("shuffle_hash"), (F.col("sha") == F.col("ssha")) & own(id_col).cast("long").eqNullSafe(F.col("sid")), "left")

    @F.udf("string", useArrow=True)
    def cut(text, spans, passages):
        raw, at, parts = text.encode(), 0, []
        inside = lambda k: k < len(raw) and raw[k] & 0xC0 == 0x80
        for a, b in merged(pairs(spans) + in_bytes(raw, pairs(passages))):
            while inside(a):
                a += 1
            while inside(b):
                b -= 1
            if a < b:
                parts.append(raw[at:a])
                at = b
        return b"".join([*parts, raw[at:]]).decode()

    hit = F.col("found").isNotNull()
    text = F.when(hit, own(text_col).cast("string")).otherwise("")
    done = j.withColumn("cut", F.when(hit, cut(text, F.col("found.spans"), F.col("found.passages"))))
    done = done.where(~hit | (F.trim("cut") != ""))
    new = {text_col: F.when(hit, F.col("cut")).otherwise(own(text_col))}
    if size_col in df.columns:
        new[size_col] = F.when(hit, F.length("cut").cast(df.schema[size_col].dataType)).otherwise(own(size_col))
    return done.select(*[new.get(c, own(c)).alias(c) for c in df.columns])


#: Passages of over 50 words are reported, too.
PASSAGE_WORDS = 51


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, judged by 400-byte strings, and n_passages, passage_bytes: repeated passages of 51 words, which are reported only."""
    docs = read_documents(spark, sf_dir)
    cut = cut_spans(docs, repeated_spans(docs, words=PASSAGE_WORDS))
    covered = F.aggregate("passages", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.size("passages").cast("long").alias("n_passages"),
        covered.alias("passage_bytes"),
    )

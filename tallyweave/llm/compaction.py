"""11. Small file compaction: which files of a partitioned table to rewrite together, in what order, and the rewrite.

A file is (source, block, slot) and holds rows, some of them deleted. Files with many deleted rows (dirty) and
small ones are gathered, per source in order, into groups of bounded size (next-fit); groups that merge files or
drop deleted rows queue by what they save, and the front of the queue, up to a share of its bytes, is rewritten.

RDDs throughout, as sorted streams over partitions and sums by key:

1. Rows become files by ``aggregateByKey``: a file is a sum (rows, deleted rows, bytes, live bytes, live rows,
   and the sum of the live rows' xxHash64 modulo 2^64, a hash of their multiset).
2. Next-fit goes through a source in order, but not in one task. The files lie in chunks of ``chunk`` blocks; what a
   chunk does is a function of the open group's bytes that is known without them: below a limit the
   group goes on, above it the group ends at a file that depends on the bytes only by steps (``Step``). Functions of ``fanout``
   chunks compose to one, level by level, until few are left of a source; then the states at the chunks' starts
   are handed down, and each chunk streams through next-fit from its own (``repartitionAndSortWithinPartitions``).
3. Groups are sums of files; ``sortByKey`` queues them. A partition's bytes and length go to the driver, two numbers
   each, and come back as the offsets of the partitions in the queue.
4. Decisions meet files, and files meet their live rows, as sorted streams: a decision precedes its files, a
   file's record its rows. Rows of rewritten groups move to their group, in the order of their ids; files that
   stay are digested where they are.
5. Files and groups cogroup with what was read back of them: a live row too many, too few or changed in either is an error.

No task holds a file, a group, a source or the queue: streams hold a row, and sums are a few numbers. A group's SHA-256 is
sequential by its definition, so one task reads a group's live rows: ``target`` bytes, a longer file, or, where texts are empty,
ids alone. Tables of files and groups are written, and nothing but partition totals and two block numbers reaches the driver.

Defined cases: a null source or text is empty; rows with a null id are a file of their own, first of their source, whose block
is null, and none of them is deleted; their id is written as nothing; rows that repeat an id are rows (ordered
by text); files without a live row are files; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from dataclasses import dataclass

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, materialize, n_partitions, read_documents

by_value(__name__)

#: The block of rows without an id, before all others.
NO_BLOCK = -(2**63)
WRAP = 2**64


@dataclass(frozen=True)
class Rules:
    """Sizes in bytes, shares in percent."""

    target: int = 32768
    dirty: int = 20
    small_num: int = 3
    small_den: int = 4
    rewrite: int = 50
    file_cost: int = 4096
    wave: int = 16
    #: Blocks of ids in a chunk, and chunks (of chunks) that one task composes.
    chunk: int = 16
    fanout: int = 64


FILES = "source string, block long, slot long, rows long, deleted long, bytes long, live_bytes long, live_rows long, hashed decimal(20,0)"
GROUPED = f"{FILES}, group_block long, group_slot long"
GROUPS = "source string, block long, slot long, n_files long, dirty boolean, bytes long, live_bytes long, live_rows long, hashed decimal(20,0)"
PLANNED = f"{GROUPED}, rewritten boolean"
QUEUED = f"{GROUPS}, wave long"
RESULT = "source string, block long, slot long, n_files long, live_rows long, bytes long, cost long, wave long, live_sha256 string"


def in_streams(rdd: RDD, n: int, prefix: int) -> RDD:
    """(key, value) records, those equal in the first ``prefix`` parts of the key in one partition, sorted by the whole key."""
    return rdd.repartitionAndSortWithinPartitions(n, lambda k: zlib.crc32(repr(k[:prefix]).encode()))


def plus(a: tuple, b: tuple) -> tuple:
    """Sums of numbers; hashes, the last, modulo 2^64."""
    return (*[x + y for x, y in zip(a[:-1], b[:-1])], (a[-1] + b[-1]) % WRAP)


def table(rdd: RDD, schema: str, name: str) -> DataFrame:
    """A written table."""
    spark = SparkSession.builder.getOrCreate()
    return materialize(spark.createDataFrame(rdd, schema, verifySchema=False), name)


# 1. Files


def file_rows(df: DataFrame, id_col: str, text_col: str, source_col: str, block: F.Column, slot: F.Column, deleted: F.Column) -> DataFrame:
    """(source, block, slot, id, text, dead, size, hash) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ident = F.col(id_col).cast("long")
    return df.select(
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(block.cast("long"), F.lit(NO_BLOCK)).alias("block"),
        slot.cast("long").alias("slot"),
        ident.alias("id"),
        text.alias("text"),
        F.coalesce(deleted, F.lit(False)).alias("dead"),
        F.octet_length(text).cast("long").alias("size"),
        F.xxhash64(F.coalesce(ident.cast("string"), F.lit("")), text).alias("hash"),
    )


def files_of(rows: DataFrame) -> DataFrame:
    """The files, each with its sums: a written table."""

    def one(r):
        live = not r.dead
        return (r.source, r.block, r.slot), (1, int(r.dead), r.size, r.size * live, int(live), r.hash % WRAP if live else 0)

    n = n_partitions(rows.sparkSession)
    sums = rows.drop("id", "text").rdd.map(one).aggregateByKey((0,) * 6, plus, plus, n)
    return table(sums.map(lambda kv: (*kv[0], *kv[1][:-1], _decimal(kv[1][-1]))), FILES, "files")


def _decimal(x: int):
    from decimal import Decimal

    return Decimal(x)


# 2. Next-fit


class Step:
    """What a run of files makes of the open group: a function of its bytes, 0 to cap + 1 (over, or no group at all).

    Up to ``top`` bytes all files join it, ``total`` bytes more. Beyond, by ``pieces`` (lowest bytes, bytes of the group
    that is open at the end, its first file), ascending.
    """

    __slots__ = ("cap", "total", "top", "pieces")

    def __init__(self, cap: int, total: int = 0, top: int | None = None, pieces=()):
        self.cap, self.total, self.pieces = cap, total, list(pieces)
        self.top = cap + 1 if top is None else top

    def __reduce__(self):
        return Step, (self.cap, self.total, self.top, self.pieces)

    def joined(self, load: int, size: int, start, name):
        return (load + size, start) if load + size <= self.cap else (min(size, self.cap + 1), name)

    def add(self, size: int, name) -> None:
        """One more file."""
        pieces = [(low, *self.joined(load, size, start, name)) for low, load, start in self.pieces]
        top = self.cap - self.total - size
        if top < self.top and self.top >= 0:
            pieces.insert(0, (max(top + 1, 0), min(size, self.cap + 1), name))
        self.total, self.top = self.total + size, min(self.top, top)
        self.pieces = [p for k, p in enumerate(pieces) if not k or p[1:] != pieces[k - 1][1:]]

    def __call__(self, load: int, start):
        if load <= self.top:
            return load + self.total, start
        _, load, start = self.pieces[bisect_right([p[0] for p in self.pieces], load) - 1]
        return load, start

    def then(self, other: "Step") -> "Step":
        """This run, then the other."""
        top = min(self.top, other.top - self.total)
        pieces = [(max(low - self.total, top + 1, 0), load, start) for low, load, start in other.pieces if low - self.total <= self.top]
        # a piece that begins below the first byte count in question counts from there
        pieces = [p for k, p in enumerate(pieces) if k + 1 == len(pieces) or pieces[k + 1][0] > p[0]] if self.top > top and self.top >= 0 else []
        pieces += [(low, *other(load, start)) for low, load, start in self.pieces]
        return Step(self.cap, self.total + other.total, top, [p for k, p in enumerate(pieces) if not k or p[1:] != pieces[k - 1][1:]])


def entries(steps: RDD, low: int, high: int, n: int, rules: Rules) -> RDD:
    """((source, chunk), (bytes, first file) of the group open at its start) of ((source, chunk), Step); chunks are low to high."""
    fanout, cap = rules.fanout, rules.target
    few = high - low < fanout
    parent = lambda chunk: 0 if few else chunk // fanout
    records = steps.map(lambda kv: ((kv[0][0], parent(kv[0][1]), 1, kv[0][1]), kv[1]))
    if not few:

        def composed(stream):
            at, step = None, None
            for (source, above, _, _), own in stream:
                if (source, above) != at:
                    if at:
                        yield at, step
                    at, step = (source, above), own
                else:
                    step = step.then(own)
            if at:
                yield at, step

        above = in_streams(records, n, 2).mapPartitions(composed)
        above = entries(above, low // fanout, high // fanout, n, rules)
        records = records.union(above.map(lambda kv: ((*kv[0], 0, 0), kv[1])))

    def handed_down(stream):
        at, state = None, None
        for (source, above, is_step, chunk), x in stream:
            if (source, above) != at:
                at, state = (source, above), (cap + 1, None)
            if is_step:
                yield (source, chunk), state
                state = x(*state)
            else:
                state = x

    return in_streams(records, n, 2).mapPartitions(handed_down)


def blocks_of(rows: DataFrame) -> tuple[int, int]:
    """The smallest and the largest block (a scan of the ids alone); two zeros without any."""
    return tuple(b or 0 for b in rows.where(F.col("block") != NO_BLOCK).agg(F.min("block"), F.max("block")).first())


def grouped(files: DataFrame, span: tuple[int, int], rules: Rules) -> DataFrame:
    """The files, of blocks in ``span``, each with the first file of its group (null: in none): a written table."""
    n = n_partitions(files.sparkSession)
    low, high = (b // rules.chunk for b in span)
    chunk_of = lambda block: low - 1 if block == NO_BLOCK else block // rules.chunk

    stream = in_streams(files.rdd.map(lambda f: ((f.source, chunk_of(f.block), 1, f.block, f.slot), tuple(f))), n, 2)
    names = [c.split()[0] for c in FILES.split(", ")]
    at_live, at_bytes, at_rows, at_deleted = (names.index(c) for c in ("live_bytes", "bytes", "rows", "deleted"))

    def gathered(f) -> bool:
        return 100 * f[at_deleted] >= rules.dirty * f[at_rows] or rules.small_den * f[at_bytes] < rules.small_num * rules.target

    def steps(part):
        at, step = None, None
        for (source, chunk, *_), f in part:
            if (source, chunk) != at:
                if at:
                    yield at, step
                at, step = (source, chunk), Step(rules.target)
            if gathered(f):
                step.add(f[at_live], (f[1], f[2]))
        if at:
            yield at, step

    begin = entries(stream.mapPartitions(steps), low - 1, high, n, rules)

    def next_fit(part):
        load, start = rules.target + 1, None
        for (*_, is_file, _, _), f in part:
            if not is_file:
                load, start = f
            elif gathered(f):
                if load + f[at_live] > rules.target:
                    load, start = 0, (f[1], f[2])
                load += f[at_live]
                yield (*f, *start)
            else:
                yield (*f, None, None)

    both = stream.union(begin.map(lambda kv: ((*kv[0], 0, 0, 0), kv[1])))
    return table(in_streams(both, n, 2).mapPartitions(next_fit), GROUPED, "grouped")


# 3. Queue


def is_dirty(f, rules: Rules) -> bool:
    return 100 * f.deleted >= rules.dirty * f.rows


def queue(files: DataFrame, rules: Rules) -> DataFrame:
    """The groups to rewrite, each with its wave: a written table."""
    n = n_partitions(files.sparkSession)
    one = lambda f: ((f.source, f.group_block, f.group_slot), (1, int(is_dirty(f, rules)), f.bytes, f.live_bytes, f.live_rows, int(f.hashed)))
    sums = files.where("group_slot IS NOT NULL").rdd.map(one).aggregateByKey((0,) * 6, plus, plus, n)
    sums = sums.filter(lambda kv: kv[1][0] > 1 or kv[1][1])
    groups = table(sums.map(lambda kv: (*kv[0], kv[1][0], kv[1][1] > 0, *kv[1][2:5], _decimal(kv[1][5]))), GROUPS, "groups")
    line = groups.rdd.map(lambda g: ((-g.n_files, g.bytes, g.source, g.block, g.slot), tuple(g))).sortByKey(numPartitions=n)

    def length(k, part):
        count = held = 0
        for (_, size, *_), _ in part:
            count, held = count + 1, held + size
        yield k, count, held

    offsets, index, before = {}, 0, 0
    for k, count, held in sorted(line.mapPartitionsWithIndex(length).collect()):  # a row per partition
        offsets[k] = index, before
        index, before = index + count, before + held
    whole = before

    def front(k, part):
        index, before = offsets[k]
        for (_, size, *_), g in part:
            before += size
            if 100 * before > rules.rewrite * whole:
                return
            yield (*g, index // rules.wave)
            index += 1

    return table(line.mapPartitionsWithIndex(front), QUEUED, "queue")


# 4. Rewrite


def planned(files: DataFrame, queued: DataFrame) -> DataFrame:
    """The files, each with whether its group is rewritten: a written table."""
    n = n_partitions(files.sparkSession)
    decisions = queued.rdd.map(lambda g: ((g.source, g.block, g.slot, 0, 0, 0), None))
    own = files.where("group_slot IS NOT NULL").rdd.map(lambda f: ((f.source, f.group_block, f.group_slot, 1, f.block, f.slot), tuple(f)))

    def decide(part):
        rewritten = None
        for (*group, is_file, _, _), f in part:
            if not is_file:
                rewritten = group
            else:
                yield (*f, group == rewritten)

    alone = files.where("group_slot IS NULL").rdd.map(lambda f: (*f, False))
    return table(in_streams(decisions.union(own), n, 3).mapPartitions(decide).union(alone), PLANNED, "planned")


def placed(rows: DataFrame, plan: DataFrame) -> RDD:
    """((source, block, slot of the unit, id, text), hash) of every live row, in order, units whole in a partition.

    A unit is a file that stays, or a rewritten group under its first file. Rows of both go by file first, where
    the plan's record precedes them.
    """
    n = n_partitions(rows.sparkSession)
    live = rows.where("NOT dead").select("source", "block", "slot", "id", "text", "hash")
    live = live.rdd.map(lambda r: ((r.source, r.block, r.slot, 1, r.id is not None, r.id or 0, r.text), r.hash))
    unit = lambda f: (f.group_block, f.group_slot) if f.rewritten else (f.block, f.slot)
    records = plan.rdd.map(lambda f: ((f.source, f.block, f.slot, 0, False, 0, ""), unit(f)))

    def to_units(part):
        own = None
        for (source, _, _, is_row, known, i, text), x in part:
            if not is_row:
                own = x
            else:
                yield (source, *own, known, i, text), x

    return in_streams(in_streams(live.union(records), n, 3).mapPartitions(to_units), n, 3)


def digests(stream: RDD) -> RDD:
    """((source, block, slot), (SHA-256, live rows, hash of their multiset)) of the units that have live rows."""

    def run(part):
        at, sha, count, hashed = None, None, 0, 0
        for (*unit, known, i, text), h in part:
            if unit != at:
                if at:
                    yield tuple(at), (sha.hexdigest(), count, hashed)
                at, sha, count, hashed = unit, hashlib.sha256(), 0, 0
            sha.update(f"{i if known else ''}:{text}\n".encode())
            count, hashed = count + 1, (hashed + h) % WRAP
        if at:
            yield tuple(at), (sha.hexdigest(), count, hashed)

    return stream.mapPartitions(run)


class Compaction:
    """A compaction of ``file_rows``: its plan, and the rows and digests after it."""

    def __init__(self, rows: DataFrame, rules: Rules = Rules()):
        self.rows, self.rules, self.spark = rows, rules, rows.sparkSession
        files = grouped(files_of(rows), blocks_of(rows), rules)
        self.queued = queue(files, rules)
        self.plan = planned(files, self.queued)

    def live_rows(self) -> DataFrame:
        """(source, block, slot, id, text): every live row under its file after the compaction; a file's rows are together, in order."""
        out = placed(self.rows, self.plan).map(lambda kv: (kv[0][0], None if kv[0][1] == NO_BLOCK else kv[0][1], kv[0][2], kv[0][4] if kv[0][3] else None, kv[0][5]))
        return self.spark.createDataFrame(out, "source string, block long, slot long, id long, text string", verifySchema=False)

    def report(self) -> DataFrame:
        """A row per rewritten group or untouched file: source, block, slot, n_files, live_rows, bytes, cost, wave, live_sha256."""
        rules = self.rules
        cost = lambda g: g.bytes + g.live_bytes + rules.file_cost * g.n_files
        moved = self.queued.rdd.map(lambda g: ((g.source, g.block, g.slot), (g.n_files, g.live_rows, g.bytes, cost(g), g.wave, int(g.hashed))))
        stays = self.plan.where("NOT rewritten").rdd.map(lambda f: ((f.source, f.block, f.slot), (1, f.live_rows, f.bytes, None, None, int(f.hashed))))
        found = digests(placed(self.rows, self.plan))

        def check(kv):
            (source, block, slot), (before, after) = kv
            before, after = list(before), list(after)  # one of each, or none after
            *shown, hashed = before[0] if before else (0, 0, 0, None, None, 0)
            sha, count, now = after[0] if after else (hashlib.sha256().hexdigest(), 0, 0)
            if len(before) != 1 or (shown[1], hashed) != (count, now):
                raise RuntimeError(f"compaction: the live rows of {(source, block, slot)} were not preserved: {shown[1]} before, {count} after")
            return (source, None if block == NO_BLOCK else block, slot, *shown, sha)

        out = moved.union(stays).cogroup(found, n_partitions(self.spark)).map(check)
        return self.spark.createDataFrame(out, RESULT, verifySchema=False)


# The query's table

ID_BLOCK, SLOTS, DELETED_STEP = 2000, 8, 9


def document_files(docs: DataFrame) -> DataFrame:
    """``documents`` as files: blocks of ids, and slots and deletions by the id's CRC-32."""
    ident = F.col("doc_id").cast("long")
    h = F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary"))
    block = F.expr(f"(CAST(doc_id AS BIGINT) - pmod(CAST(doc_id AS BIGINT), {ID_BLOCK})) DIV {ID_BLOCK}")
    slot = F.least(h % SLOTS, F.floor(h / SLOTS) % SLOTS)
    deleted = F.floor(h / SLOTS**2) % 100 < DELETED_STEP * F.pmod(slot + block, F.lit(SLOTS))
    return file_rows(docs, "doc_id", "text", "source", block, slot, deleted)


def op11_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Compaction(document_files(read_documents(spark, sf_dir))).report()


_R = Rules()
_JOINS = f"w.load + c.live_bytes <= {_R.target}"
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS h
  FROM documents
), e AS (
  SELECT *, CAST(floor(doc_id / {ID_BLOCK}) AS BIGINT) AS block, least(h % {SLOTS}, (h // {SLOTS}) % {SLOTS}) AS slot, strlen(text) AS size FROM d
), r AS (SELECT *, (h // {SLOTS**2}) % 100 < {DELETED_STEP} * ((slot + block) % {SLOTS}) AS dead FROM e),
f AS (
  SELECT source, block, slot, count(*) AS n, count(*) FILTER (dead) AS deleted, CAST(sum(size) AS BIGINT) AS bytes,
    CAST(coalesce(sum(size) FILTER (NOT dead), 0) AS BIGINT) AS live_bytes, count(*) FILTER (NOT dead) AS live_rows FROM r GROUP BY ALL
), c AS (
  SELECT *, 100 * deleted >= {_R.dirty} * n AS dirty, row_number() OVER (PARTITION BY source ORDER BY block, slot) AS k FROM f
  WHERE 100 * deleted >= {_R.dirty} * n OR {_R.small_den} * bytes < {_R.small_num} * {_R.target}
), walk AS (
  SELECT source, k, live_bytes AS load, k AS g FROM c WHERE k = 1
  UNION ALL
  SELECT c.source, c.k, CASE WHEN {_JOINS} THEN w.load ELSE 0 END + c.live_bytes, CASE WHEN {_JOINS} THEN w.g ELSE c.k END
  FROM walk w JOIN c ON c.source = w.source AND c.k = w.k + 1
), g AS (
  SELECT source, g, min_by(block, k) AS block, min_by(slot, k) AS slot, count(*) AS n_files, bool_or(dirty) AS dirty, CAST(sum(bytes) AS BIGINT) AS bytes,
    CAST(sum(live_bytes) AS BIGINT) AS live_bytes, CAST(sum(live_rows) AS BIGINT) AS live_rows FROM c JOIN walk w USING (source, k) GROUP BY source, g
), q AS (
  SELECT *, row_number() OVER o - 1 AS place, sum(bytes) OVER o AS upto, sum(bytes) OVER () AS whole FROM g WHERE n_files > 1 OR dirty
  WINDOW o AS (ORDER BY n_files DESC, bytes, source, block, slot ROWS UNBOUNDED PRECEDING)
), m AS (SELECT * FROM q WHERE 100 * upto <= {_R.rewrite} * whole),
u AS (
  SELECT f.source, f.block, f.slot, coalesce(m.block, f.block) AS ublock, coalesce(m.slot, f.slot) AS uslot, m.place IS NOT NULL AS moved FROM f
  LEFT JOIN c ON c.source = f.source AND c.block = f.block AND c.slot = f.slot LEFT JOIN walk w ON w.source = c.source AND w.k = c.k
  LEFT JOIN m ON m.source = w.source AND m.g = w.g
), s AS (
  SELECT u.source, ublock, uslot, sha256(string_agg(r.doc_id || ':' || text || chr(10), '' ORDER BY r.doc_id)) AS sha
  FROM u JOIN r ON r.source = u.source AND r.block = u.block AND r.slot = u.slot WHERE NOT dead GROUP BY ALL
), o AS (
  SELECT source, block, slot, n_files, live_rows, bytes, bytes + live_bytes + {_R.file_cost} * n_files AS cost, place // {_R.wave} AS wave FROM m
  UNION ALL
  SELECT source, f.block, f.slot, 1, live_rows, bytes, NULL, NULL FROM f JOIN u USING (source, block, slot) WHERE NOT moved
)
SELECT o.source, o.block, o.slot, n_files, live_rows, bytes, cost, wave, coalesce(sha, sha256('')) AS live_sha256
FROM o LEFT JOIN s ON s.source = o.source AND s.ublock = o.block AND s.uslot = o.slot
"""

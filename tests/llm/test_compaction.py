"""Small file compaction: against a plain version, whatever the chunks, levels and partitions."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.llm import compaction as co

SCHEMA = "doc_id long, text string, source string, block string"


def brute(rows, rules=co.Rules()):
    """The contract, in plain loops, over (doc_id, text, source)."""
    files = defaultdict(list)
    for i, text, source in rows:
        h = zlib.crc32(b"" if i is None else str(i).encode())
        block, slot = None if i is None else i // 2000, min(h % 8, h // 8 % 8)
        dead = i is not None and h // 64 % 100 < 9 * ((slot + block) % 8)
        files[source or "", block, slot].append((i, text or "", dead))
    order = lambda f: (f[0], f[1] is not None, f[1] or 0, f[2])
    size = lambda f: sum(len(t.encode()) for _, t, _ in files[f])
    live = lambda f: sum(len(t.encode()) for _, t, d in files[f] if not d)
    dirty = lambda f: 100 * sum(d for *_, d in files[f]) >= rules.dirty * len(files[f])
    groups, last = [], None
    for f in sorted(files, key=order):
        if dirty(f) or 4 * size(f) < 3 * rules.target:
            if last is None or last[0][0] != f[0] or sum(map(live, last)) + live(f) > rules.target:
                last = []
                groups.append(last)
            last.append(f)
    queue = [g for g in groups if len(g) > 1 or dirty(g[0])]
    queue.sort(key=lambda g: (-len(g), sum(map(size, g)), order(g[0])))
    whole, upto, out, gone = sum(size(f) for g in queue for f in g), 0, [], set()

    def unit(fs, cost, wave):
        kept = sorted(((i is not None, i or 0, t) for f in fs for i, t, d in files[f] if not d))
        sha = hashlib.sha256("".join(f"{i if known else ''}:{t}\n" for known, i, t in kept).encode()).hexdigest()
        return (*fs[0], len(fs), len(kept), sum(map(size, fs)), cost, wave, sha)

    for k, g in enumerate(queue):
        upto += sum(map(size, g))
        if 100 * upto > 50 * whole:
            break
        gone |= set(g)
        out.append(unit(g, sum(map(size, g)) + sum(map(live, g)) + 4096 * len(g), k // 16))
    out += [unit([f], None, None) for f in files if f not in gone]
    return sorted(out, key=str)


def run(spark, rows, rules=co.Rules(), parts=3):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(parts)
    return sorted([tuple(r) for r in co.Compaction(co.document_files(docs), rules).report().collect()], key=str)


def documents(rng, n, step=37, size=900):
    return [(k * step - 20_000, "é" * rng.randrange(size) if rng.random() < 0.9 else None, rng.choice(["a", "b", "b", "b", None])) for k in range(n)]


def test_brute_over_levels(spark):
    """One chunk, many, and several levels of chunks of chunks; negative ids among them."""
    import random

    rows = documents(random.Random(2), 1500)
    want = brute(rows)
    assert {r[6] is None for r in want} == {True, False}
    for rules in (co.Rules(), co.Rules(chunk=1, fanout=64), co.Rules(chunk=2, fanout=2)):
        assert run(spark, rows, rules) == want


def test_edges(spark):
    """Null ids, sources and texts, repeated rows, one very long text, files without live rows, empty tables."""
    import random

    rows = documents(random.Random(3), 200, step=301, size=300)
    rows += [(None, "x", "a"), (None, None, "a"), (None, "x", "a"), (None, "a", "b"), *rows[:5], (rows[0][0], "other", rows[0][2]), (77, "y" * 200_000, "b")]
    assert run(spark, rows, co.Rules(chunk=1, fanout=2)) == brute(rows)
    assert run(spark, []) == []
    # no text at all: groups without a bound but the source's
    bare = [(k * 400, None, "s") for k in range(400)]
    assert run(spark, bare, co.Rules(chunk=1, fanout=2)) == brute(bare)


def test_rows_after(spark):
    import random

    rows = documents(random.Random(5), 300)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    c = co.Compaction(co.document_files(docs))
    after = c.live_rows().collect()
    live = {i for i, *_ in rows if not (lambda h: h // 64 % 100 < 9 * ((min(h % 8, h // 8 % 8) + i // 2000) % 8))(zlib.crc32(str(i).encode()))}
    assert sorted(r.id for r in after) == sorted(live)
    units = defaultdict(list)
    for r in after:
        units[r.source, r.block, r.slot].append(r)
    for r in c.report().collect():
        own = units.pop((r.source, r.block, r.slot), [])
        assert [x.id for x in own] == sorted(x.id for x in own)
        assert hashlib.sha256("".join(f"{x.id}:{x.text}\n" for x in own).encode()).hexdigest() == r.live_sha256
    assert not units


@pytest.mark.parametrize("change", ["drop", "repeat", "alter"])
def test_lost_or_changed_rows_are_errors(spark, change):
    import random

    c = co.Compaction(co.document_files(spark.createDataFrame([(*r, "clash") for r in documents(random.Random(6), 60)], SCHEMA)))
    one = c.rows.where("NOT dead").orderBy("id").first()
    here = F.col("id") == one.id
    if change == "alter":
        c.rows = c.rows.withColumn("hash", F.when(here, F.col("hash") + 1).otherwise(F.col("hash")))
    else:
        c.rows = c.rows.where(~here) if change == "drop" else c.rows.unionAll(c.rows.where(here))
    with pytest.raises(Exception, match="not preserved"):
        c.report().collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 14)), min_size=1, max_size=14), st.lists(st.integers(1, 13), max_size=3))
def test_steps(sizes, cuts):
    """A run's function, made at once or of parts, is next-fit from any state."""
    cap = 10
    bounds = [0, *sorted({c for c in cuts if c < len(sizes)}), len(sizes)]
    whole = None
    for a, b in zip(bounds, bounds[1:]):
        s = co.Step(cap)
        for k in range(a, b):
            s.add(sizes[k], k)
        whole = s if whole is None else whole.then(s)
    for load in range(cap + 2):
        want, start = load, "before"
        for k, size in enumerate(sizes):
            if want + size > cap:
                want, start = min(size, cap + 1), k
            else:
                want += size
        assert whole(load, "before") == (want, start)

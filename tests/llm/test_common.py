"""Components, blocks, whole groups, written tables."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tallyweave.llm import bpe, common, simhash
from tests_llm_support import brute_components


@pytest.mark.parametrize("kind", ["chain", "star", "random", "pairs"])
def test_components(spark, kind):
    r = random.Random(kind)
    n = 300
    edges = {
        "chain": [(i, i + 1) for i in range(n)],
        "star": [(n // 2, i) for i in range(n)],
        "random": [(r.randrange(n), r.randrange(n)) for _ in range(n // 2)],
        "pairs": [(2 * i, 2 * i + 1) for i in range(n // 2)] + [(1, 0), (0, 1)],
    }[kind]
    r.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 3), (5, None)], "a long, b long")
    got = {x["node"]: x["component"] for x in common.components(df).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    low = brute_components({x for e in edges for x in e}, edges)
    assert got == {x: low[x] for x in nodes}
    assert common.components(df.limit(0)).count() == 0


def test_blocks_see_every_pair(spark):
    rows = [(c, i) for c, n in (("a", 50), ("b", 1), ("c", 7)) for i in range(n)]
    df = spark.createDataFrame([(c, 100 * ord(c) + i) for c, i in rows], "cell string, key long")
    seen = {}
    for r in common.blocked(df, ["cell"], "key", 8).collect():
        seen.setdefault((r["cell"], r["lo"], r["hi"]), []).append(r["key"])
    pairs = {p for (c, *_), keys in seen.items() for p in itertools.combinations(sorted(set(keys)), 2)}
    for c, n in (("a", 50), ("c", 7)):
        assert {p for p in itertools.combinations([100 * ord(c) + i for i in range(n)], 2)} <= pairs
    assert not any(k[0] == "b" for k in seen)
    assert max(map(len, seen.values())) < 50


def test_home_blocks(spark):
    df = spark.createDataFrame([("a", i, i % 3 == 0) for i in range(40)], "cell string, key long, home boolean")
    met = set()
    groups = {}
    for r in common.blocked(df, ["cell"], "key", 6, home="home").collect():
        groups.setdefault((r["lo"], r["hi"]), {"q": [], "h": []})[r["side"]].append(r["key"])
    for g in groups.values():
        assert len(set(g["q"])) == len(g["q"]) and len(set(g["h"])) == len(g["h"])
        for p in itertools.product(g["q"], g["h"]):
            assert p not in met  # each ordered pair once
            met.add(p)
    assert met == set(itertools.product(range(40), [i for i in range(40) if i % 3 == 0]))


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 7))
def test_whole_groups(values, size):
    values = sorted(values)
    batches = [pa.RecordBatch.from_arrays([pa.array(values[i : i + size], pa.int64())], names=["k"]) for i in range(0, len(values), size)]
    out = [t.column("k").to_pylist() for t in common.whole_groups(iter(batches), ["k"])]
    assert list(itertools.chain(*out)) == values
    assert len({v for t in out for v in set(t)}) == sum(len(set(t)) for t in out)


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=40))
def test_spanning_and_joined(links):
    ids = np.arange(21) * 10
    l, r = (np.array(x) for x in zip(*links))
    a, b = common.spanning(ids, l, r)
    low = brute_components(range(21), links)
    assert dict(zip(a.tolist(), b.tolist())) == {i * 10: 10 * low[i] for i in range(21) if low[i] != i}
    assert simhash.joined(np.arange(21), l, r).tolist() == [low[i] for i in range(21)]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_packed_integers(values):
    assert bpe.unpack_ints(bpe.pack_ints(np.array(values, np.uint32))).tolist() == values


def test_written_tables(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    t = common.materialize(df, "t")
    assert t.schema == df.schema and t.collect() == df.collect()
    assert common.materialize(df.limit(0), "t").count() == 0
    common.clean_up()
    with pytest.raises(Exception):  # noqa: B017
        t.count()

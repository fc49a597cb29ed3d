"""Suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tallyweave.llm import suffix_dedup as sd
from tests_llm_support import brute_passages
from tests_llm_support import brute_spans as brute

SF = "/root/testdata/sf0.001"


def random_rows(seed, length):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(30) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(r.randrange(0, 25)) for _ in range(3)]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(len(parts)), r.choice(passages)[r.randrange(20) : r.randrange(60, 160)])
        rows.append((i, "".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "ab" * 300), (107, (passages[1] + ". ") * 4), (108, "qu" + word() * 9), (105, "z" * 700), (106, "z" * length), (None, rows[5][1]), (None, "n" + passages[0])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,length,gram,hot,keep", [(1, 40, 16, 1 << 22, "none"), (2, 40, 16, 1 << 22, "first"), (3, 64, 32, 300, "none"), (4, 50, 8, 0, "first"), (5, 32, 16, 2000, "none")])
def test_spans_brute(spark, seed, length, gram, hot, keep, monkeypatch):
    monkeypatch.setattr(sd, "BATCH_BYTES", 500)
    monkeypatch.setattr(sd, "REGION_WINDOWS", 100)
    rows = random_rows(seed, length)
    df = spark.createDataFrame([(*x, 0, 0, 0) for x in rows], "doc_id long, text string, id long, row long, spans long").coalesce(1)
    got = sd.repeated_spans(df, length=length, gram=gram, hot_bytes=hot, keep=keep).collect()
    key = lambda x: (str(x[0]), x[1], x[2])
    want = [(i, hashlib.sha256((t or "").encode()).hexdigest(), s) for (i, t), s in zip(rows, brute(rows, length, keep == "first"))]
    assert sorted(((r.doc_id, r.sha.hex(), [tuple(s) for s in r.spans]) for r in got), key=key) == sorted(want, key=key)
    assert any(s for *_, s in want)


def test_op7(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in sd.op7_suffix_dedup(spark, SF).collect()}
    assert len(got) == len(rows)
    removed = 0
    for (i, t), spans in zip(rows, brute(rows, 400, False)):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for a, b in spans:
            gone[a:b] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        g = got[i]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (len(raw), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest())
        removed += g.n_removed
    assert removed


def test_repeated_rows_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(1, t), (1, t), (2, "x" + t)], "doc_id long, text string")
    got = sd.cut_spans(df, sd.repeated_spans(df)).collect()
    assert [(r.doc_id, len(r.kept)) for r in got] == [(1, 0), (1, 0), (2, 1)] or sorted((r.doc_id, len(r.kept)) for r in got) == [(1, 0), (1, 0), (2, 1)]
    assert sd.repeated_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1 << 20, 1 << 40])
def test_periodic_text(spark, hot):
    """A period puts an anchor at every place: regions must not multiply."""
    n = 2_000_000
    regions = sd.text_regions([np.full(n, 122, np.uint8)], 400, 64)[0]
    assert len(regions[0]) < n / 4000 and sum(regions[2]) == n - 399
    rows = [(1, "z" * n), (2, "ab" * 300 + "unique"), (3, "0123456789" * 39)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in sd.repeated_spans(df, hot_bytes=hot).collect()}
    assert got == {1: [(0, n)], 2: [(0, 600)], 3: []}
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in sd.repeated_spans(df, keep="first", hot_bytes=hot).collect()}
    assert got == {1: [(1, n)], 2: [(2, 600)], 3: []}


def test_texts_longer_than_a_piece(monkeypatch):
    r = random.Random(1)
    t = np.frombuffer(bytes(r.choice(b"abcd") for _ in range(5000)), np.uint8)
    whole = sd.text_regions([t], 100, 16)[0]
    monkeypatch.setattr(sd, "AT_ONCE", 700)
    parts = sd.text_regions([t], 100, 16)[0]
    of = lambda x: [a for a, n in zip(x[0], x[2]) for _ in range(n)]
    assert of(whole) == of(parts) and len(of(whole)) == 4901


@pytest.mark.parametrize("seed,words,gram,hot,keep", [(1, 8, 2, 1 << 22, "none"), (2, 9, 4, 1 << 22, "first"), (3, 16, 8, 0, "first"), (4, 8, 4, 100, "none")])
def test_passages_brute(spark, seed, words, gram, hot, keep, monkeypatch):
    """Passages of words, whatever their white space; byte spans stay the same beside them."""
    monkeypatch.setattr(sd, "BATCH_BYTES", 500)
    r = random.Random(seed)
    rows = [(i, t if t is None else t.replace(" ", r.choice([" ", "\n", " \t "]))) for i, t in random_rows(seed, 40)]
    rows += [(200, "q " * 700), (201, "\xa0 \u3000" * 40)]
    df = spark.createDataFrame([(*x, 0, 0, 0) for x in rows], "doc_id long, text string, id long, row long, words long").coalesce(1)
    got = sd.cut_spans(df, sd.repeated_spans(df, length=40, gram=16, words=words, word_gram=gram, hot_bytes=hot, keep=keep)).collect()
    first = keep == "first"
    want = []
    for (i, t), spans, passages in zip(rows, brute(rows, 40, first), brute_passages(rows, words, first)):
        want.append((i, len((t or "").encode()), spans, sd.in_bytes((t or "").encode(), passages)))
    key = lambda x: (str(x[0]), str(x[1:]))
    assert sorted(((x.doc_id, x.n_bytes, sd.pairs(x.spans), sd.pairs(x.passages)) for x in got), key=key) == sorted(want, key=key)
    assert any(p for *_, p in want)

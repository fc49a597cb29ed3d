"""BPE and packing against the tokenizer libraries."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tallyweave.llm import bpe, packing
from tests_llm_support import check_packing

SF = "/root/testdata/sf0.001"


def odd_texts():
    r = random.Random(4)
    any_char = lambda: chr(r.choice([r.randrange(1, 0xD800), r.randrange(0xE000, 0x110000), r.randrange(32, 127), r.randrange(1, 0x500)]))
    return [None, "", " ", "\x00a", "<|endoftext|>", "a<|endoftext|> b", "a" * 30_000, " " * 5_000, "x \n\n\t y  z", "It's WE'LL 123 ½²   \x1c\x85 é", *("".join(any_char() for _ in range(200)) for _ in range(40))]


def reference():
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk", [100, 8 << 20])
def test_encode_and_decode(spark, chunk):
    ranks, enc = reference()
    texts = odd_texts() + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids long, key long")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, ranks, P.PATTERN, chunk_bytes=chunk), ranks).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].ids == enc.encode_ordinary(t or ""), t
        assert bytes(got[i].decoded) == (t or "").encode()
    assert bpe.decode(bpe.encode(df.limit(0), ranks, P.PATTERN), ranks).count() == 0


def test_op4(spark):
    _, enc = reference()
    got = {r.doc_id: r for r in bpe.op4_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids, g = enc.encode_ordinary(r.text), got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_very_long_runs(spark):
    """Runs that a backtracking pattern engine can't hold."""
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [" " * 1_200_000, "a  " + "\n" * 1_100_000 + "<|endoftext|>  b", "漢字" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)}
    got = packing.pack_documents(df, packing.load_tokenizer(P.path("byte_bpe_50k.json")), keep_ids=False).collect()
    check_packing(got, {i: x + [0] for i, x in want.items()}, 2048)
    ranks, _ = reference()
    rows = bpe.encode(df, ranks, P.PATTERN).collect()
    assert {r.doc_id: r.ids for r in rows if r.doc_id != 1} == {i: want[i] for i in (0, 2)}


def test_op2(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = {r.doc_id: t.encode(r.text, add_special_tokens=False).ids + [0] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n = check_packing(packing.op2_best_fit_packing(spark, SF).collect(), docs, 2048)
    assert n <= -(-sum(map(len, docs.values())) // 2048) * 1.05 + 1


def test_packing_odd_rows(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    spec = packing.load_tokenizer(P.path("byte_bpe_50k.json"))
    texts = odd_texts()
    df = spark.createDataFrame([(i, x, 0, 0) for i, x in enumerate(texts)], "doc_id long, text string, length long, id long")
    docs = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in enumerate(texts)}
    check_packing(packing.pack_documents(df, spec, keep_ids=False).collect(), docs, 2048)
    check_packing(packing.pack_documents(df, spec, capacity=64, keep_ids=False).collect(), docs, 64)
    assert packing.pack_documents(df.limit(0), spec).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_pack_places_every_rank_once(seed):
    r = random.Random(seed)
    cap = 60
    counts = {n: r.randrange(0, 50) for n in r.sample(range(1, cap + 1), 25)}
    runs, n_seq = packing.pack(counts, cap)
    used, seen = defaultdict(list), defaultdict(set)
    for n, first, ranks, m, base, offset in runs:
        for x in range(ranks):
            assert first + x not in seen[n]
            seen[n].add(first + x)
            used[base + x % m].append((offset + n * (x // m), n))
    assert {n: len(v) for n, v in seen.items()} == {n: c for n, c in counts.items() if c}
    for s in used.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= cap
    assert len(used) == n_seq
    # plain best fit, piece by piece
    gaps = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(cap - n)
        else:
            gaps.remove(fit)
            gaps.append(fit - n)
    assert n_seq <= len(gaps) + 1


def test_repeated_and_null_ids(spark):
    """Each row has its own tokens and its own place, whatever its id."""
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(None, "one two"), (None, None), (1, "three " * 50), (1, "three " * 50), (1, "four"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = [t.encode(x or "", add_special_tokens=False).ids for _, x in rows]
    ranks, enc = reference()
    got = bpe.encode(df, ranks, P.PATTERN).collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=str) == sorted(((i, enc.encode_ordinary(x or "")) for i, x in rows), key=str)
    places = packing.pack_documents(df, packing.load_tokenizer(P.path("byte_bpe_50k.json")), capacity=32, keep_ids=False).collect()
    assert sum(r.length for r in places) == sum(len(x) + 1 for x in ids)
    assert sum(r.piece == 0 for r in places) == len(rows)
    fill = {}
    for r in sorted(places, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 32

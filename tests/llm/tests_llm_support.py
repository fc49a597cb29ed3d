"""Brute-force versions that several tests share."""

import re
import zlib
from collections import defaultdict

import numpy as np


def brute_components(ids, link):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in link:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def check_packing(rows, want, capacity):
    """rows: (id, piece, start, length, ids or crc, sequence, offset); want: id -> ids."""
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    assert docs.keys() == want.keys()
    for i, ids in want.items():
        at = 0
        for k, r in enumerate(sorted(docs[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert not k or r.length == capacity
            raw = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw)
            at += r.length
        assert at == len(ids)
        if len(ids) <= capacity:
            assert len(docs[i]) == 1
    return len(seqs)


def brute_spans(rows, length, first):
    """(id, text) in order -> [spans]"""
    raws = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen = defaultdict(list)
    for k in order:
        for p in range(len(raws[k]) - length + 1):
            seen[raws[k][p : p + length]].append((k, p))
    gone = [np.zeros(len(r), bool) for r in raws]
    for at in seen.values():
        if len(at) > 1:
            for k, p in at[1:] if first else at:
                gone[k][p : p + length] = True
    return [flag_runs(g) for g in gone]


def flag_runs(flags):
    d = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(d[::2].tolist(), d[1::2].tolist()))


def brute_passages(rows, words, first):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)):
        for p in range(len(texts[k]) - words + 1):
            seen.setdefault(tuple(texts[k][p : p + words]), []).append((k, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for at in seen.values():
        if len(at) > 1:
            for k, p in at[1:] if first else at:
                gone[k][p : p + words] = True
    return [flag_runs(g) for g in gone]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0

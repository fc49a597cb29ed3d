"""Exact, SimHash and embedding dedup and URL filters against brute force on small tables."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
import xxhash

from tallyweave.llm import embedding_dedup, exact_dedup, simhash, url_filter
from tests_llm_support import brute_components

SF = "/root/testdata/sf0.001"


def same(df, sql, tables=("documents", "pages")):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cols = sorted(df.columns)
    a = sorted(map(tuple, df.select(cols).collect()), key=str)
    b = sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall(), key=str)
    assert a == b


ODD = [(1, "a  b"), (2, "a\tb"), (3, None), (4, ""), (5, "a b c"), (5, "a b c"), (None, "x"), (None, "a b"), (7, " "), (8, "\u00a0"), (9, "long " * 50_000)]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, id long, t long, h long, fp long")


def test_exact_dedup_sql(spark):
    same(exact_dedup.op9_exact_dedup(spark, SF), exact_dedup.SQL)


def test_exact_dedup_odd_rows(spark):
    got = exact_dedup.exact_dedup(odd(spark)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    want = []
    for i, t in ODD:
        ids = [j for j, u in ODD if norm(u) == norm(t)]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert exact_dedup.exact_dedup(odd(spark, [])).count() == 0


def test_url_filter_sql(spark):
    same(url_filter.op1_url_filter(spark, SF), url_filter.SQL)


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        (None, "", "", None, "allow"),
        ("no scheme/casino", "", "", None, "block"),
        ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://m.www.example.com/en/casino", "m.www.example.com", "/en/casino", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        ("http://x.net/de/cheap-pills", "x.net", "/de/cheap-pills", None, "block"),
        ("http://x.net/de/cheapest-pills", "x.net", "/de/cheapest-pills", None, "allow"),
        ("http://x.net/free/free", "x.net", "/free/free", None, "allow"),
        ("http://casinos.org/", "casinos.org", "/", None, "allow"),
        ("http://x.org/de/Sportwetten-gratis", "x.org", "/de/Sportwetten-gratis", None, "block"),
        ("http://x.org/de/kredit", "x.org", "/de/kredit", None, "allow"),
        ("http://x.org/fr/paris-sportifs?jackpot", "x.org", "/fr/paris-sportifs", None, "block"),
        ("http://x.org/fr/paris/sportifs/gratuitement", "x.org", "/fr/paris/sportifs/gratuitement", None, "allow"),
        ("http://putas.x.org/", "putas.x.org", "/", None, "block"),
        ("http://x.org/es/gratis/GRATIS/apuesta", "x.org", "/es/gratis/GRATIS/apuesta", None, "allow"),
        ("http://x.org/es/ruleta/sexo", "x.org", "/es/ruleta/sexo", None, "block"),
        ("http://my-casino.org#a://b", "my-casino.org", "", None, "block"),
    ],
)
def test_url_cases(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, 0, 0)], "page_id long, url string, id long, rule long")
    r = url_filter.filter_urls(df).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_url_odd_rows(spark):
    """Null and repeated ids; hosts of very many labels."""
    far = "http://" + "a." * 1_000_000 + "www.example.com/en/"
    rows = [(None, far), (1, far), (1, far), (2, "http://" + "." * 1_000_000 + "/en/"), (3, "http://example.com./en/"), (4, "http://.com/x"), (5, "x" * 3_000_000 + "://net/fr/")]
    got = sorted(((r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()), key=str)
    deep = ("www.example.com/en/", "allow")
    assert got == sorted([(None, *deep), (1, *deep), (1, *deep), (2, None, "allow"), (3, None, "allow"), (4, "com/", "allow"), (5, "net/fr/", "block")], key=str)
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=()).collect()
    assert all(r.rule is None for r in got) and len(got) == len(rows)


def test_url_empty(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def brute_fingerprint(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_brute(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash(spark, SF).collect()}
    fps = {i: brute_fingerprint(t, 3) for i, t in rows}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    low = brute_components(fps, links)
    assert got == {i: (f"{fps[i]:016x}", low[i]) for i in fps}


@pytest.mark.parametrize("block,segments", [(7, 5), (512, 5), (512, 4), (64, 6)])
def test_hamming_groups_lose_nothing(spark, block, segments):
    rng = np.random.default_rng(3)
    fps = []
    for _ in range(60):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            x ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
            fps.append(x)
    rows = spark.createDataFrame([(i, x.to_bytes(8, "big")) for i, x in enumerate(fps)], "id long, fp binary")
    got = {bytes(r.fp): r.component for r in simhash.hamming_groups(rows, block=block, segments=segments).collect()}
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    low = brute_components(range(len(fps)), links)
    assert got == {x.to_bytes(8, "big"): low[i] for i, x in reversed(list(enumerate(fps)))}


def test_segments_hold_every_bit(spark):
    rng = np.random.default_rng(4)
    for m in (4, 5, 6, 7):
        x = rng.integers(0, 256, (50, 8), np.uint8)
        y = x ^ rng.integers(0, 256, (50, 8), np.uint8)
        a, b = (simhash.cut_segments([v.tobytes() for v in z], m) for z in (x, y))
        assert (np.bitwise_count(a ^ b).sum(axis=1) == np.bitwise_count(x ^ y).sum(axis=1)).all()
    assert simhash.cut_segments([], 5).shape == (0, 5)
    with pytest.raises(ValueError, match="16 bits"):
        simhash.hamming_groups(spark.createDataFrame([], "id long, fp binary"), segments=3)


def test_simhash_odd_rows(spark):
    got = simhash.simhash_groups(odd(spark), words=3).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {3}
    assert all(int(r.fingerprint, 16) == 0 for r in got if r.doc_id in (3, 4, 7))
    assert simhash.simhash_groups(odd(spark, []), words=3).count() == 0


def test_parameters_that_would_lose_pairs_are_errors(spark):
    """Wide fingerprints with more differing bits than segments have no equal segment to meet by."""
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for bits, max_diff, segments in ((512, 85, 32), (64, 6, 6), (64, 8, 5)):
        with pytest.raises(ValueError, match="lost"):
            simhash.simhash_groups(df, bits=bits, max_diff=max_diff, segments=segments)


def brute_embeddings(rows, threshold=0.98):
    unit = lambda v: (u := np.array(v, float) / max(map(abs, v))) / np.linalg.norm(u)
    ok = [(k, i, l, unit(v)) for k, (i, v, l) in enumerate(rows) if l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = [(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and a[2] == b[2] and len(a[3]) == len(b[3]) and a[3] @ b[3] >= threshold]
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    low = brute_components(range(len(rows)), links)
    return [(rows[k][0], n[k], rows[low[k]][0], rows[k][0] == rows[low[k]][0]) for k in range(len(rows))]


@pytest.mark.parametrize("block", [5, 512])
def test_embedding_groups_brute(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 40)
    rng = np.random.default_rng(2)
    rows = []
    for c in range(20):
        centre = rng.normal(size=16)
        for _ in range(25):
            rows.append((len(rows), [float(x) for x in centre + rng.normal(size=16) * 0.15 * rng.random()], int(c % 3)))
    rows += [(600, rows[0][1], 0), (601, [-0.0] * 16, 0), (602, None, 0), (603, rows[0][1], None), (604, [float("nan")] * 16, 1), (605, [None, 1.0], 1), (606, [], 1), (607, [1.0, 2.0], 1), (608, [2.0, 4.0], 1), (609, [1e300, 2e300], 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, node long")
    got = embedding_dedup.embedding_groups(df, block=block).collect()
    assert sorted(map(tuple, got)) == sorted(brute_embeddings(rows)) and sum(r.n_links for r in got) > 500
    # lengths beyond the fitted ones, and the SQL
    monkeypatch.setattr(embedding_dedup, "MAX_LENGTHS", 1)
    assert sorted(map(tuple, embedding_dedup.embedding_groups(df, block=block).collect())) == sorted(map(tuple, got))
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(con.sql(embedding_dedup.SQL).fetchall()) == sorted(map(tuple, got))
    assert embedding_dedup.embedding_groups(df.limit(0)).count() == 0


def test_every_label_has_cells(spark, monkeypatch):
    """The registered query fits centroids on the given tables and finds the same rows as without cells."""
    sizes = []
    fit = embedding_dedup.spherical_kmeans

    def counted(x, k):
        sizes.append(k)
        return fit(x, k)

    monkeypatch.setattr(embedding_dedup, "spherical_kmeans", counted)
    got = sorted(map(tuple, embedding_dedup.op3_embedding_dedup(spark, SF).collect()))
    assert sizes == [4]
    sizes.clear()
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 2)
    assert got == sorted(map(tuple, embedding_dedup.op3_embedding_dedup(spark, SF).collect())) and max(sizes) >= 16
    monkeypatch.setattr(embedding_dedup, "MAX_LENGTHS", 0)
    assert got == sorted(map(tuple, embedding_dedup.op3_embedding_dedup(spark, SF).collect()))


def test_embedding_sql(spark):
    same(embedding_dedup.op3_embedding_dedup(spark, SF), embedding_dedup.SQL, ("embeddings",))

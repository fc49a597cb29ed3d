"""Language ID, licence scan and quality classifier."""

import math
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tallyweave.llm import language_id as li
from tallyweave.llm import licences, quality

SF = "/root/testdata/sf0.01"


def test_language_id_held_out(spark):
    got = {r.doc_id: r for r in li.op5_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    right = []
    for r in docs:
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= g.score <= 1
        if g.held_out:
            right.append(g.lang_pred == r.lang)
    assert sum(right) / len(right) > 0.97


def test_predict_equals_training_pass():
    net = li.Network(["a", "b", "c"], seed=3)
    x = np.random.default_rng(1).integers(0, li.CLASSES, (9, li.WINDOW)).astype(np.int32)
    assert np.allclose(net.softmax(net.responses(x)[0]), net.predict(x, net.pair_tables()), atol=1e-5)


def test_prediction_brute(spark):
    """Labels and scores from each text's windows one by one, by the pass that training takes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = li.learned(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.identify(docs, net).collect()}
    for r in docs.collect():
        if not li.has_letter(r.text):
            assert got[r.doc_id] == (li.UND, 0.0)
            continue
        x, lens = li.windows_of(r.text.encode())
        p = np.average([net.softmax(net.responses(w[None])[0])[0] for w in x], axis=0, weights=lens)
        label, score = got[r.doc_id]
        assert abs(p[net.labels.index(label)] - p.max()) < 1e-4 and abs(score - p.max()) < 1e-4


def test_gradients():
    net = li.Network(["a", "b"], seed=3)
    for p in ("bias", "out", "out_bias"):
        setattr(net, p, getattr(net, p).astype(float))
    net.tables = [t.astype(float) for t in net.tables]
    rng = np.random.default_rng(1)
    x, y, w = rng.integers(0, li.CLASSES, (5, li.WINDOW)).astype(np.int32), np.array([0, 1, 1, 0, 1]), np.ones(5)
    loss = lambda: -np.log(net.softmax(net.responses(x)[0])[np.arange(5), y]).mean()
    grads = net.gradients(x, y, w)
    for p, g in zip([*net.tables, net.bias, net.out, net.out_bias], grads):
        for at in rng.integers(0, p.size, 6):
            i = np.unravel_index(at if rng.random() < 0.5 else np.abs(g).argmax(), p.shape)
            old = p[i]
            p[i] = old + 1e-5
            up = loss()
            p[i] = old - 1e-5
            down = loss()
            p[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-4


def test_language_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 ... ²", "en"), (None, "the cat", "en"), (4, "word " * 300_000, None), (5, "der Hund und die Katze " * 9, "de"), (6, "the dog and the cat " * 9, "en"), (6, "the dog and the cat " * 9, "en")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    net = li.learned(df)
    out = li.identify(df, net).collect()
    by = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in out}
    assert len(out) == len(rows)
    for i in (1, 2, 3):
        assert next(v for k, v in by.items() if k[0] == i) == ("und", 0.0)
    assert li.identify(df, None).first().lang_pred == "und"
    assert li.learned(df.limit(0)) is None
    assert li.identify(df.limit(0), net).count() == 0


def test_language_sample_is_bounded(spark, monkeypatch):
    """Ids that repeat, with one text or many, with one label or two, neither exceed nor use up the sample."""
    seen = []
    monkeypatch.setattr(li.Network, "fit", lambda self, x, y: seen.append((self.labels, len(x))))
    some = spark.range(3000)
    one = some.selectExpr("1L AS doc_id", "'the dog and the cat' AS text", "'en' AS lang")
    many = some.selectExpr("2L AS doc_id", "concat('der Hund ', id) AS text", "if(id % 2 = 0, 'de', 'nl') AS lang")
    rest = spark.range(10, 40).selectExpr("id AS doc_id", "concat('le chat ', id) AS text", "'fr' AS lang")
    li.train(one)
    li.train(many, sample_docs=50)
    li.train(one.union(many).union(rest), sample_docs=3200)
    assert seen == [(["en"], 1), (["de", "nl"], 50), (["de", "en", "fr", "nl"], 3031)]


def same(df, sql, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cols = sorted(df.columns)
    a = sorted(map(tuple, df.select(cols).collect()), key=str)
    b = sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall(), key=str)
    assert a == b
    return a


def test_licences_sql(spark):
    df = licences.op8_licence_scan(spark, SF)
    same(df, licences.SQL, SF)
    assert df.where("licence IS NOT NULL").count() > 30


MIT_TEXT = """Copyright (c) 2020 Some One. All rights reserved.
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_ITEMS = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""


def wrapped(text, width, lead="", end="\n"):
    lines = [y for x in text.split("\n") for y in (textwrap.wrap(x, width) or [""])]
    return end.join((lead + x).rstrip() for x in lines)


GNU = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.\n\n"
    "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
)
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
WHOLE = {
    GNU.format("program", "General Public License", "2"): "GPL-2.0-or-later",
    GNU.format("library", "Lesser General Public License", "3"): "LGPL-3.0-or-later",
    GNU.format("library", "Lesser General Public License", "2.1"): "LGPL-2.1-or-later",
    GNU.format("program", "Affero General Public License", "3"): "AGPL-3.0-or-later",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0",
    f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_AS_IS}": "ISC",
    f"{ISC_GRANT}.\n\n{ISC_AS_IS}": "0BSD",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": "Zlib",
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.": "Unlicense",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.": "EPL-2.0",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
}
DISCLAIMERS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
)


@pytest.mark.parametrize("width, lead", [(40, ""), (63, " * "), (79, "# "), (10_000, "")])
def test_more_licences_wrapped(spark, width, lead):
    """Whole notices, and the disclaimers of MIT and BSD, at several widths, with and without comment marks."""
    wrap = lambda t: "\n".join(lead + line for part in t.split("\n") for line in (textwrap.wrap(part, width, break_long_words=False, break_on_hyphens=False) or [""]))
    rows = [(k, wrap(t)) for k, t in enumerate([*WHOLE, *DISCLAIMERS])]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].licence for k in range(len(WHOLE))] == list(WHOLE.values())
    assert [got[len(WHOLE) + k].sentence_ids for k in (0, 1)] == ["mit-as-is,mit-liable", "bsd-as-is,bsd-liable"]


def test_rules_use_known_identifiers():
    known = {i for i, _ in licences.SENTENCES}
    assert all(i in known for _, _, seq in licences.RULES for i in seq)
    # a rule is not hidden behind an earlier one that it contains
    for k, (name, _, seq) in enumerate(licences.RULES):
        for other, _, before in licences.RULES[:k]:
            inside = any(seq[j : j + len(before)] == before for j in range(len(seq) - len(before) + 1))
            assert not inside or name == other


@pytest.mark.parametrize("width", [30, 63, 79, 10_000])
@pytest.mark.parametrize("lead,end", [("", "\n"), ("# ", "\n"), (" * ", "\r\n"), ("// ", "\n"), ("    ", "\r")])
def test_wrapped_licences(spark, width, lead, end):
    numbered = lambda k, mark: "\n".join([BSD_HEAD, *(mark.format(i + 1) + x for i, x in enumerate(BSD_ITEMS[:k]))])
    texts = {
        MIT_TEXT: "MIT",
        "The MIT License (MIT)\n\n" + MIT_TEXT: "MIT",
        numbered(2, "{}. "): "BSD-2-Clause",
        numbered(3, "({}) "): "BSD-3-Clause",
        numbered(3, "- "): "BSD-3-Clause",
        BSD_HEAD + "\n\n" + "\n\n".join(BSD_ITEMS): "BSD-3-Clause",
        APACHE: "Apache-2.0",
        GPL: "GPL-3.0-or-later",
        "Some notes\nReleased under the MIT License\nand more": "MIT" if width > 40 else None,
    }
    rows = [(i, wrapped(t, width, lead, end)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scan_licences(df).collect()}
    want = dict(enumerate(texts.values()))
    if width > 40 and not lead.strip():
        assert got == want
    assert {i: got[i] for i in list(want)[:8]} == {i: want[i] for i in list(want)[:8]}
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert sorted(con.sql(f"SELECT doc_id, licence FROM ({licences.SQL})").fetchall()) == sorted(got.items())


def test_licence_rules(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [
        (1, None, None, "none", "", ""),
        (2, "", None, "none", "", ""),
        (3, "x. Released  under the\tMIT License. y", "MIT", "permissive", "MIT", "mit-ref"),
        (4, f"{mit}.\n\n{notice}", "MIT", "permissive", "MIT", "mit-grant,mit-notice"),
        (5, f"{notice}\n{mit}", None, "none", "", "mit-notice,mit-grant"),
        (6, "All rights reserved. Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", "noncommercial", "CC-BY-NC-4.0,All-Rights-Reserved", "all-rights,cc-by-nc-4-ref"),
        (7, "a " * 200_000 + ".\nAll rights reserved!", "All-Rights-Reserved", "proprietary", "All-Rights-Reserved", "all-rights"),
        (7, "Licensed under the Apache License, Version 2.0 (the \"License\").", "Apache-2.0", "permissive", "Apache-2.0", "apache-2.0-ref"),
        (None, "not a licence", None, "none", "", ""),
        (8, "!" * 500_000 + "x\nReleased under the MIT License...\n" + "?!" * 300_000, "MIT", "permissive", "MIT", "mit-ref"),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t, *_ in rows], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.licence, r.licence_class, r.licences, r.sentence_ids) for r in licences.scan_licences(df).collect()), key=str)
    assert got == sorted(((r[0], *r[2:]) for r in rows), key=str)
    assert licences.scan_licences(df.limit(0)).count() == 0


def brute_kn(texts, trusted, order):
    """Perplexity of each text under interpolated modified Kneser-Ney, straight from its definition."""
    norm = [b"\0" * (order - 1) + re.sub(rb"[\x00-\x20]+", b" ", (t or "").encode()) for t in texts]
    counts = {order: Counter(t[i : i + order] for t, ok in zip(norm, trusted) if ok for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    model = {}
    for k, c in counts.items():
        n = [sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.1), j - 0.1) if n[j - 1] else 0.5 for j in (1, 2, 3)]
        total, freed = defaultdict(float), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            freed[g[:-1]] += d[min(v, 3) - 1]
        model[k] = (c, d, total, freed)

    def p(g):
        if not g:
            return 1 / 256
        c, d, total, freed = model[len(g)]
        low = p(g[1:])
        if g[:-1] not in total:
            return low
        v = c.get(g, 0)
        return (v - d[min(v, 3) - 1] if v else 0) / total[g[:-1]] + freed[g[:-1]] / total[g[:-1]] * low

    out = []
    for t in norm:
        n = len(t) - order + 1
        out.append(math.exp(-sum(math.log(p(t[i : i + order])) for i in range(n)) / n) if n > 0 else None)
    return out


@pytest.mark.parametrize("order,chunk", [(4, 8 << 20), (3, 2000), (2, 500)])
def test_perplexity_brute(spark, order, chunk):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()
    rows = [(r.doc_id, r.text[:1500], r.lang, 0) for r in docs] + [(900, None, "en", 0), (901, "", None, 0), (902, "\U0001f600 new \x00\x01 x", None, 0), (None, "the the", "en", 0), (903, "the the", "xx", 0)]
    trusted = [r[0] is not None and r[0] % 3 == 0 for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, id long")
    ids = spark.createDataFrame([(r[0],) for r, ok in zip(rows, trusted) if ok], "id long")
    got = {(r.id, r.lang): r for r in quality.perplexities(df, ids, order=order, chunk_bytes=chunk, shards=4).collect()}
    for r, ok, want in zip(rows, trusted, brute_kn([r[1] for r in rows], trusted, order)):
        g = got[(r[0], r[2])]
        assert g.trusted == ok
        assert (g.perplexity is None) == (want is None)
        assert want is None or abs(g.perplexity / want - 1) < 1e-9
    out = quality.classify(df, ids, order=order, shards=4).collect()
    assert len(out) == len(rows) and all(r.keep for r in out if r.perplexity is None)


def test_dealing_is_bounded():
    """Groups and the copies of the model stay bounded as text and n-grams grow."""
    for distinct in (0, 70_000, 5_000_000, 300_000_000, 1 << 32):
        for text in (0, 10**6, 10**12, 10**14):
            shards, splits = quality.dealing(distinct, text, 16, 8)
            assert shards & (shards - 1) == 0 and distinct <= shards * quality.SHARD_GRAMS
            assert text / splits / shards <= max(quality.SPLIT_BYTES / 16, quality.GRAM_BYTES * quality.SHARD_GRAMS)
            assert (splits - 1) * distinct * 16 <= text / 10
    assert quality.dealing(0, 0, 16, 800) == (16, 50)


def test_many_shards_and_splits(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    ids = docs.select(docs.doc_id.alias("id")).where("id % 2 = 0")
    key = lambda r: r.id
    few = sorted(quality.perplexities(docs, ids, shards=1, chunk_bytes=3000).collect(), key=key)
    for k, v in (("SHARD_GRAMS", 300), ("GRAM_BYTES", 0), ("SPLIT_BYTES", 10_000)):
        monkeypatch.setattr(quality, k, v)
    many = sorted(quality.perplexities(docs, ids, shards=1, chunk_bytes=3000).collect(), key=key)
    assert [r[:4] for r in few] == [r[:4] for r in many] and len(few) == 60
    assert all(abs(a.perplexity / b.perplexity - 1) < 1e-9 for a, b in zip(few, many))


def test_language_with_one_trusted_text(spark):
    """Its quantile is the text's own perplexity: with any slack the text stays, and so does its equal."""
    rows = [(i, f"the cat sat on mat number {i}", "en") for i in range(20)] + [(90, "ein Satz", "de"), (91, "ein Satz", "de"), (92, "\u4e00\u4e8c" * 50, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.classify(df, spark.createDataFrame([(i,) for i in [*range(20), 90]], "id long")).collect()}
    assert abs(got[90].threshold / (got[90].perplexity * quality.SLACK) - 1) < 1e-9
    assert got[90].keep and got[91].keep and not got[92].keep


def test_classify_brute(spark):
    """Thresholds and decisions from the perplexities: languages with, without and of no name; repeated ids, a very long text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).collect()
    rows = [(r.doc_id, r.text[:3000], None if r.doc_id % 7 == 0 else r.lang) for r in docs]
    rows += [rows[0], rows[1], (9000, "zq " * 400_000, "en"), (9001, "the the", "xx"), (9002, None, "yy"), (None, "zqxj", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = {i for i, *_ in rows if i is not None and i < 9000 and i % 2 == 0}
    ids = spark.createDataFrame([(i,) for i in trusted], "id long")
    ppl = {(r.id, r.lang): r.perplexity for r in quality.perplexities(df, ids, shards=4).collect()}
    quantile, slack = 0.9, 1.05
    at = lambda v: sorted(v)[math.ceil(quantile * len(v)) - 1] * slack
    good = [(l, ppl[i, l]) for i, _, l in rows if i in trusted and ppl[i, l] is not None]
    own, every = defaultdict(list), [p for _, p in good]
    for l, p in good:
        own[l].append(p)
    want = []
    for i, _, l in rows:
        limit = at(own[l]) if l in own else at(every)
        want.append((i, l, limit, ppl[i, l] is None or ppl[i, l] <= limit))
    got = quality.classify(df, ids, quantile=quantile, slack=slack, shards=4).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    for g, w in zip(sorted(((r.doc_id, r.lang, r.threshold, r.keep) for r in got), key=key), sorted(want, key=key), strict=True):
        assert (g[0], g[1], g[3]) == (w[0], w[1], w[3]) and abs(g[2] / w[2] - 1) < 1e-9
    assert None in own and "xx" not in own and not all(r.keep for r in got)


def test_quality_separates(spark):
    got = {r.doc_id: r.keep for r in quality.op6_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [got[r.doc_id] for r in labels if r.quality == 1]
    bad = [got[r.doc_id] for r in labels if r.quality == 0]
    assert len(got) == 1000 and sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.5


def test_quality_without_trusted(spark):
    df = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    ids = spark.createDataFrame([], "id long")
    assert [(r.keep, r.threshold) for r in quality.classify(df, ids).collect()] == [(True, None)] * 2
    assert quality.classify(df.limit(0), ids).count() == 0

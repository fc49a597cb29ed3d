"""13. Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters.

A word (lower case) enters as two vectors: its own, if enough of the learned documents have it, and the mean
of its characters' trigrams, whole words however long. The network reads windows of ``WINDOW`` words in both
directions, attention weighs its states into one vector, a logistic unit scores that. A text is cut into windows
that overlap by half, all of them are scored, and its score is the highest.

Training is numpy on the driver, by Adam through time, on at most ``sample_docs`` labelled documents of each class (the
smallest by hash of their id) with at most ``sample_windows`` windows of each. A label belongs to a document and not to its
windows, and some labels nothing in the words bears out. So each half of the documents is first scored by a network of the
other half, trained on all windows under their document's label, then on those that stand out. A toxic document that does
not stand out from the others there teaches no more; the final network learns the windows that stand out in
toxic documents, those that score highest in others, and as many of the others' rest.

The learned model is below a MB and shipped with the tasks; what a word contributes to the gates is computed once a
batch of words that a task meets. Texts are read once and nothing is shuffled.

Defined cases: a null label is never learned from, and neither is a row with a null id, which isn't held out; several labels of an
id: toxic if one says so; of rows with one id the smallest text is learned from; a text without a word (null and empty ones too) scores 0; without documents of both classes there
is no model and every score is 0; repeated rows get equal scores; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, give_back, read_documents, small_batches, tidy

by_value(__name__)

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 12, 12, 8
GRAMS = 4096
#: Words with a vector of their own: in so many learned documents at least, so many words at most.
WORD_DOCS, WORDS = 5, 20_000
#: Bounds of what is learned from: documents of each class, windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 1000, 24
#: Steps of training: of each half, of the whole. A toxic document teaches if the other half's network sees more in it than in this share of the others.
STEPS, CLEAN_QUANTILE = (100, 320), 0.98
REPEATED = 0.15
#: A score from which a document is called toxic.
TOXIC = 0.7

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def window_starts(n: int) -> np.ndarray:
    """Starts of a text's windows: a stride apart, the last at its end; one for a text of a window or less."""
    last = max(0, n - WINDOW)
    return np.append(np.arange(0, last, STRIDE), last)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words' trigrams in a row, how many each word has); words are bounded by spaces."""
    chars = np.frombuffer(" ".join(["", *words, ""]).encode("utf-32-le"), "<u4").astype(np.uint64)
    lens = np.array([len(w) for w in words])
    number = (chars[:-2] * np.uint64(0x9E3779B1) + chars[1:-1] * np.uint64(0x85EBCA77) + chars[2:] * np.uint64(0xC2B2AE3D)) >> np.uint64(13)
    # a word of n characters has n trigrams, the middle ones its characters
    return (number[chars[1:-1] != 32] % np.uint64(GRAMS)).astype(np.int64), lens


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def sums_by(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by key, 0 to n - 1."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        out[k[at]] = np.add.reduceat(rows[order], at, 0)
    return out


class Network:
    """Parameters by name. Gates stand side by side: update, reset, candidate; directions are the first axis."""

    def __init__(self, vocabulary: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, size: rng.normal(0, size, shape).astype(np.float32)
        self.vocabulary = {w: k + 1 for k, w in enumerate(vocabulary)}
        inputs = WORD_DIM + CHAR_DIM
        self.params = {
            "words": draw(len(vocabulary) + 1, WORD_DIM, size=0.3),
            "grams": draw(GRAMS, CHAR_DIM, size=0.3),
            "gates": draw(2, inputs, 3 * HIDDEN, size=inputs**-0.5),
            "gate_bias": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "states": draw(2, HIDDEN, 3 * HIDDEN, size=HIDDEN**-0.5),
            "attention": draw(2, HIDDEN, ATTENTION, size=HIDDEN**-0.5),
            "attention_bias": np.zeros(ATTENTION, np.float32),
            "heed": draw(ATTENTION, size=ATTENTION**-0.5),
            "out": draw(2, HIDDEN, size=HIDDEN**-0.5),
            "out_bias": np.zeros(1, np.float32),
        }

    def inputs(self, words: list[str]) -> dict:
        """The words' vectors and what they are made of."""
        p = self.params
        own = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        grams, lens = trigrams(words)
        chars = np.add.reduceat(p["grams"][grams], np.cumsum(lens) - lens, 0) / lens[:, None]
        return {"own": own, "grams": grams, "lens": lens, "x": np.concatenate([p["words"][own], chars.astype(p["words"].dtype)], 1)}

    def gate_inputs(self, x: np.ndarray) -> np.ndarray:
        """(direction, word, gates) of words' vectors."""
        return np.matmul(x[None], self.params["gates"]) + self.params["gate_bias"]

    def forward(self, table: np.ndarray, ids: np.ndarray, lens: np.ndarray, keep: bool = False):
        """Scores before the logistic function of windows (word numbers in ``table``); with ``keep`` also what training needs.

        Both directions take a step at a time; a window that is shorter keeps its state beyond its end.
        """
        p, (n, steps), h = self.params, ids.shape, None
        full = bool((lens == steps).all())
        h = np.zeros((2, n, HIDDEN), table.dtype)
        states, kept = np.empty((steps, 2, n, HIDDEN), table.dtype), []
        for t in range(steps):
            x = np.stack([table[0].take(ids[:, t], 0), table[1].take(ids[:, steps - 1 - t], 0)])
            u = np.matmul(h, p["states"])
            zr = sigmoid(x[..., : 2 * HIDDEN] + u[..., : 2 * HIDDEN])
            z, r, un = zr[..., :HIDDEN], zr[..., HIDDEN:], u[..., 2 * HIDDEN :]
            c = np.tanh(x[..., 2 * HIDDEN :] + r * un)
            new = c + z * (h - c)
            live = None
            if not full:
                live = np.stack([t < lens, steps - 1 - t < lens])[..., None]
                new = np.where(live, new, h)
            if keep:
                kept.append((h, z, r, un, c, live))
            h = new
            states[t, 0], states[steps - 1 - t, 1] = h[0], h[1]
        a = np.tanh(np.matmul(states[:, 0], p["attention"][0]) + np.matmul(states[:, 1], p["attention"][1]) + p["attention_bias"])
        e = a @ p["heed"]
        if not full:
            e = np.where(np.arange(steps)[:, None] < lens[None], e, -np.inf)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        context = (w[:, None, :, None] * states).sum(0)
        logit = (context * p["out"][:, None, :]).sum((0, 2)) + p["out_bias"][0]
        return (logit, (states, kept, a, w, context)) if keep else logit

    def gradients(self, words: list[str], ids: np.ndarray, lens: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Gradients of the weighted mean cross entropy of windows (numbers of ``words``)."""
        p, (n, steps) = self.params, ids.shape
        made = self.inputs(words)
        table = self.gate_inputs(made["x"])
        logit, (states, kept, a, w, context) = self.forward(table, ids, lens, keep=True)
        g = {}
        d = ((sigmoid(logit) - y) * weight / weight.sum()).astype(table.dtype)
        g["out"], g["out_bias"] = (d[None, :, None] * context).sum(1), d.sum(keepdims=True)
        d_context = d[None, :, None] * p["out"][:, None, :]
        d_states = w[:, None, :, None] * d_context[None]
        d_w = (states * d_context[None]).sum((1, 3))
        d_e = w * (d_w - (w * d_w).sum(0))
        g["heed"] = np.einsum("tn,tna->a", d_e, a)
        d_a = d_e[..., None] * p["heed"] * (1 - a * a)
        g["attention_bias"] = d_a.sum((0, 1))
        g["attention"] = np.stack([np.einsum("tnh,tna->ha", states[:, k], d_a) for k in (0, 1)])
        for k in (0, 1):
            d_states[:, k] += d_a @ p["attention"][k].T
        d_h, d_x, g["states"] = np.zeros((2, n, HIDDEN), table.dtype), np.zeros((2, steps, n, 3 * HIDDEN), table.dtype), np.zeros_like(p["states"])
        for t in reversed(range(steps)):
            h, z, r, un, c, live = kept[t]
            d_h = d_h + np.stack([d_states[t, 0], d_states[steps - 1 - t, 1]])
            d_new = d_h if live is None else d_h * live
            d_c = d_new * (1 - z) * (1 - c * c)
            d_zr = np.concatenate([d_new * (h - c) * z * (1 - z), d_c * un * r * (1 - r)], -1)
            d_u = np.concatenate([d_zr, d_c * r], -1)
            g["states"] += np.matmul(h.transpose(0, 2, 1), d_u)
            gate = np.concatenate([d_zr, d_c], -1)
            d_x[0, t], d_x[1, steps - 1 - t] = gate[0], gate[1]
            d_h = d_new * z + np.matmul(d_u, p["states"].transpose(0, 2, 1)) + (0 if live is None else d_h * ~live)
        flat = ids.T.ravel()
        d_table = np.stack([sums_by(flat, d_x[k].reshape(-1, 3 * HIDDEN), len(words)) for k in (0, 1)])
        g["gate_bias"] = d_table.sum(1, keepdims=True)
        g["gates"] = np.matmul(made["x"].T[None], d_table)
        d_in = np.matmul(d_table, p["gates"].transpose(0, 2, 1)).sum(0)
        g["words"] = sums_by(made["own"], d_in[:, :WORD_DIM], len(p["words"]))
        g["grams"] = sums_by(made["grams"], np.repeat(d_in[:, WORD_DIM:] / made["lens"][:, None], made["lens"], 0).astype(table.dtype), GRAMS)
        return g


def numbered(texts: list[list[str]]) -> tuple[list[str], list[np.ndarray]]:
    """Distinct words, and texts as their numbers."""
    number: dict[str, int] = {}
    out = [np.array([number.setdefault(w, len(number)) for w in t], np.int64) for t in texts]
    return list(number), out


def cut(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) of a text's word numbers, padded, and their lengths."""
    padded = np.pad(ids, (0, max(0, WINDOW - len(ids))))
    return padded[starts[:, None] + np.arange(WINDOW)], np.full(len(starts), min(len(ids), WINDOW))


class Lessons:
    """Windows to learn from: word numbers, lengths, the document of each and its label."""

    def __init__(self, found: list[tuple[list[str], int]], sample_windows: int):
        self.y = np.array([y for _, y in found])
        self.words, ids = numbered([w for w, _ in found])
        windows, lens, owner = [], [], []
        for k, t in enumerate(ids):
            starts = window_starts(len(t))
            x, n = cut(t, starts[np.unique(np.linspace(0, len(starts) - 1, sample_windows).round().astype(int))])
            windows.append(x)
            lens.append(n)
            owner.append(np.full(len(x), k))
        self.windows, self.lens, self.owner = np.concatenate(windows), np.concatenate(lens), np.concatenate(owner)
        self.label = self.y[self.owner]

    def scores(self, net: Network) -> np.ndarray:
        return scores(net, self.words, self.windows, self.lens)

    def tops(self, score: np.ndarray) -> np.ndarray:
        """The highest score of each document."""
        out = np.full(len(self.y), -np.inf)
        np.maximum.at(out, self.owner, score)
        return out

    def telling(self, score: np.ndarray, docs: np.ndarray, rng) -> np.ndarray:
        """Windows that tell: near the top of toxic documents (above 0), the top of others, and as many others at random."""
        top, mine = self.tops(score), docs[self.owner]
        toxic = mine & (self.label == 1) & (score >= np.maximum(top[self.owner] - 1, 0.0))
        hard = mine & (self.label == 0) & (score >= top[self.owner])
        rest = mine & (self.label == 0)
        return np.flatnonzero(toxic | hard | rest & (rng.random(len(score)) < hard.sum() / max(1, rest.sum())))

    def train(self, net: Network, docs: np.ndarray, steps: int, rng, first: np.ndarray | None = None, batch: int = 128, rate: float = 0.01) -> None:
        """``steps`` steps of Adam on documents ``docs``: a third on all their windows (or on the windows ``first``), then on those that tell."""
        m, v = ({k: np.zeros_like(p) for k, p in net.params.items()} for _ in range(2))
        step = 0
        while step < steps:
            if step < steps // 3:
                # a document's windows weigh as one
                share = 4 / np.bincount(self.owner)[self.owner]
                use = first if first is not None else np.flatnonzero(docs[self.owner] & (rng.random(len(self.owner)) < share))
            else:
                use = self.telling(self.scores(net), docs, rng)
            use = rng.permutation(use)
            toxic = self.label[use].mean() if len(use) else 0
            if not 0 < toxic < 1:
                return
            weight = np.where(self.label == 1, 0.5 / toxic, 0.5 / (1 - toxic)).astype(np.float32)
            for at in range(0, len(use), batch):
                i = use[at : at + batch]
                x = self.windows[i]
                # some windows of documents that are not toxic become one of their words again and again
                again = (self.label[i] == 0) & (self.lens[i] == WINDOW) & (rng.random(len(i)) < REPEATED)
                x[again] = x[again, :1]
                own, x = np.unique(x, return_inverse=True)
                g = net.gradients([self.words[k] for k in own], x.reshape(len(i), -1), self.lens[i], self.label[i].astype(np.float32), weight[i])
                step += 1
                for k, p in net.params.items():
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.01 * (g[k] * g[k] - v[k])
                    p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)


def fit(texts: list[str], labels: list[int], sample_windows: int = SAMPLE_WINDOWS, steps: tuple[int, int] = STEPS, seed: int = 6) -> Network | None:
    """A network learned from texts; None if a class is missing."""
    found = [(w, y) for w, y in ((words_of(t), y) for t, y in zip(texts, labels)) if w]
    if len({y for _, y in found}) < 2:
        return None
    spread = Counter(w for words, _ in found for w in set(words))
    known = sorted((w for w, n in spread.items() if n >= WORD_DOCS), key=lambda w: (-spread[w], w))[:WORDS]
    rng, lessons = np.random.default_rng(seed), Lessons(found, sample_windows)
    y = lessons.y
    # each half is scored by a network of the other half
    half, score = rng.permutation(len(y)) % 2 == 0, np.zeros(len(lessons.owner), np.float32)
    for mine in (half, ~half):
        net = Network(known)
        lessons.train(net, mine, steps[0], rng)
        other = ~mine[lessons.owner]
        score[other] = lessons.scores(net)[other]
    top = lessons.tops(score)
    bears = (y == 0) | (top > max(0.0, np.quantile(top[y == 0], CLEAN_QUANTILE)))
    net = Network(known)
    if bears[y == 1].mean() >= 0.5:
        lessons.train(net, bears, steps[1], rng, lessons.telling(score, bears, rng))
    else:
        # too little to learn from for halves of it to judge each other
        lessons.train(net, np.ones(len(y), bool), steps[1], rng)
    return net


def scores(net: Network, words: list[str], windows: np.ndarray, lens: np.ndarray, at_once: int = 2048) -> np.ndarray:
    """Scores before the logistic function, windows in batches: full ones, then shorter ones."""
    table = net.gate_inputs(net.inputs(words)["x"])
    out = np.empty(len(windows), np.float32)
    for some in (np.flatnonzero(lens == WINDOW), np.flatnonzero(lens < WINDOW)):
        for at in range(0, len(some), at_once):
            i = some[at : at + at_once]
            out[i] = net.forward(table, windows[i], lens[i])
    return out


def predict(net: Network | None, texts: list[str | None], at_once: int = 1 << 17) -> list[float]:
    """The texts' scores; words go through ``at_once`` at a time, a longer text in pieces that overlap as windows do."""
    out = np.full(len(texts), -np.inf)
    if net is None:
        return [0.0] * len(texts)
    held, owners, n = [], [], 0

    def flush() -> None:
        words, ids = numbered(held)
        parts = [cut(t, window_starts(len(t))) for t in ids]
        owner = np.repeat(owners, [len(x) for x, _ in parts])
        s = scores(net, words, np.concatenate([x for x, _ in parts]), np.concatenate([k for _, k in parts]))
        np.maximum.at(out, owner, s)

    for i, t in enumerate(texts):
        w = words_of(t)
        pieces = range(0, max(1, len(w) - (WINDOW - STRIDE)), at_once) if w else ()
        for at in pieces:
            held.append(w[at : at + at_once + WINDOW - STRIDE])
            owners.append(i)
            n += len(held[-1])
            if n >= at_once:
                flush()
                held, owners, n = [], [], 0
    if held:
        flush()
    return sigmoid(out).tolist()


def learned(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """A network learned from at most ``sample_docs`` documents of each class."""
    small_batches(df.sparkSession)
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg((F.max(F.col(label_col).cast("double")) > 0).cast("int").alias("y"))
    t = df.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    # ids first, so that texts are fetched for the sample only; it is bounded, and so is what is broadcast and collected
    y = y.join(t.select("i"), "i", "left_semi")
    parts = [y.where(F.col("y") == k).orderBy(F.xxhash64("i"), "i").limit(sample_docs) for k in (1, 0)]
    some = t.join(F.broadcast(parts[0].union(parts[1])), "i").groupBy("i", "y").agg(F.min("t").alias("t"))
    rows = sorted((r.t, r.y) for r in some.collect())
    return fit([t for t, _ in rows], [y for _, y in rows])


def score_texts(df: DataFrame, net: Network | None, text_col: str = "text", score_out: str = "score") -> DataFrame:
    """``df`` with the texts' scores; a score sees the text alone."""
    small_batches(df.sparkSession)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(predict(net, s.tolist()), dtype="float64")
        give_back()

    keep = [F.col(f"`{c}`") for c in df.columns if c != score_out]
    return df.select(*keep, run(F.col(f"`{text_col}`").cast("string")).alias(score_out))


def held_out(id_col: str = "doc_id") -> F.Column:
    """A third of the documents, whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    labels = read_documents(spark, sf_dir, "labels").where(~held_out())
    net = learned(docs.where(~held_out()), labels)
    out = score_texts(docs, net)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))

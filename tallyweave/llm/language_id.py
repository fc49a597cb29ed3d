"""5. Language ID: a byte convolutional network over fixed-length windows.

Filters of several widths run over the bytes of a window (upper case folded, runs of what is no
letter as one space), the largest response of each filter in the window is kept, and a softmax
layer turns these into language probabilities. Training is numpy on the driver, on windows of at
most ``sample_docs`` labelled documents (the smallest by hash of their id). A text's score for a
language is the mean over all its windows, weighted by their length.

On bytes, a filter is a table look-up per offset; for prediction two neighbouring offsets are one
look-up in a table of byte pairs. The model is a few MB at most and shipped with the tasks; texts
are read once and nothing is shuffled.

A softmax over the learned languages alone gives any text one of them. With ``others`` the network
has one more class, ``und``, learned from windows that are no language of the sample: learned ones with their letters
exchanged, each window by a permutation of its own, or written in bytes of other scripts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a null label is never
learned from; a row with a null id is not held out and not learned from; with nothing to learn from,
every text is ``und`` with score 0 (with ``others``, a positive score says that another language is likelier); repeated rows get equal results; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, give_back, read_documents, small_batches, tidy

by_value(__name__)

UND = "und"
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 24
#: Bounds of what is learned from: documents, windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 4000, 4

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPACES = re.compile(rb"  +")
_LETTER = re.compile(r"[^\W\d_]")
#: Folded bytes as classes: space, a to z, the bytes from 128.
_CLASS = np.array([0 if c < 97 else c - 96 if c <= 122 else 27 + c - 128 if c >= 128 else 0 for c in range(256)], np.int32)
CLASSES = 27 + 128


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def windows_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) byte classes of a text, the last padded with spaces, and their lengths."""
    t = _SPACES.sub(b" ", text.translate(_FOLD))
    n = -(-len(t) // WINDOW)
    x = np.zeros(n * WINDOW, np.int32)
    x[: len(t)] = _CLASS[np.frombuffer(t, np.uint8)]
    lens = np.full(n, WINDOW)
    if n:
        lens[-1] = len(t) - (n - 1) * WINDOW
    return x.reshape(n, WINDOW), lens


def other_windows(x: np.ndarray, seed: int = 13) -> np.ndarray:
    """As many windows of no learned language: in turn with exchanged letters, two bytes a letter, and three a letter without spaces."""
    rng = np.random.default_rng(seed)
    out = np.zeros_like(x)
    high = lambda byte: 27 + byte - 128
    for k, row in enumerate(x):
        letters = np.concatenate([[0], 1 + rng.permutation(26), np.arange(27, CLASSES)])
        if k % 3 == 0:
            out[k] = letters[row]
            continue
        inner = (letters[row] * 37 + int(rng.integers(64))) % 64
        leads = rng.integers(0xC4, 0xE0, 2) if k % 3 == 1 else rng.integers(0xE0, 0xF0, 8)
        lead = leads[inner % len(leads)]
        cols = [high(lead), high(0x80 + inner)]
        if k % 3 == 1:
            cols = [np.where(row == 0, 0, cols[0]), np.where(row == 0, -1, cols[1])]
        else:
            cols.append(high(0x80 + rng.integers(0, 64, len(row))))
        flat = np.stack(cols, axis=1).ravel()
        out[k] = flat[flat >= 0][: x.shape[1]]
    return out


class Network:
    """Weights: tables[w] (w, CLASSES, FILTERS), bias (widths * FILTERS), out (widths * FILTERS, labels), out_bias."""

    def __init__(self, labels: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def responses(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The largest response of each filter in each window, and where."""
        best, where = [], []
        for w, table in zip(WIDTHS, self.tables):
            n = x.shape[1] - w + 1
            r = table[0][x[:, :n]]
            for k in range(1, w):
                r = r + table[k][x[:, k : k + n]]
            at = r.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
        return np.concatenate(best, 1), where

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 12) -> None:
        """Adam on the cross entropy; classes weigh alike."""
        rng = np.random.default_rng(seed)
        share = np.bincount(y, minlength=len(self.labels))
        weight = (len(y) / (np.maximum(share, 1) * len(self.labels)))[y].astype(np.float32)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                i = order[at : at + batch]
                step += 1
                grads = self.gradients(x[i], y[i], weight[i])
                for p, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        pooled, where = self.responses(x)
        active = pooled + self.bias > 0
        dz = self.softmax(pooled)
        dz[np.arange(len(y)), y] -= 1
        dz *= weight[:, None] / len(y)
        hidden = np.maximum(pooled + self.bias, 0)
        dh = (dz @ self.out.T) * active
        tables = []
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        for k, (w, table) in enumerate(zip(WIDTHS, self.tables)):
            g = np.zeros_like(table)
            d = dh[:, k * FILTERS : (k + 1) * FILTERS]
            for o in range(w):
                np.add.at(g[o], (x[rows, where[k] + o], np.broadcast_to(cols, d.shape)), d)
            tables.append(g)
        return [*tables, dh.sum(0), hidden.T @ dz, dz.sum(0)]

    def pair_tables(self) -> list[list[np.ndarray]]:
        """For each width, tables by byte pair (and one by byte for an odd width)."""
        out = []
        for w, table in zip(WIDTHS, self.tables):
            pairs = [(table[k][:, None] + table[k + 1][None]).reshape(-1, FILTERS) for k in range(0, w - 1, 2)]
            out.append(pairs + [table[w - 1]] * (w % 2))
        return out

    def predict(self, x: np.ndarray, pairs: list[list[np.ndarray]]) -> np.ndarray:
        """Probabilities of each window."""
        both = x[:, :-1] * CLASSES + x[:, 1:]
        best = []
        for w, tables in zip(WIDTHS, pairs):
            n = x.shape[1] - w + 1
            r = tables[0].take(both[:, :n], 0)
            for k in range(2, w, 2):
                r += tables[k // 2].take(both[:, k : k + n] if k + 1 < w else x[:, k : k + n], 0)
            best.append(r.max(1))
        return self.softmax(np.concatenate(best, 1))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS, others: bool = False) -> Network | None:
    """A network learned from at most ``sample_docs`` documents with a label; None if there is none.

    With ``others``, ``und`` is a class of its own, learned from half as many windows as all languages have.

    Rows that repeat an id, a label and a text are one document; rows that share an id alone are several.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("t")).where("label IS NOT NULL AND id IS NOT NULL")
    rows = rows.withColumn("digest", F.xxhash64("t"))
    key = ["id", "label", "digest"]
    some = rows.select(*key).distinct().orderBy(F.xxhash64("id"), F.xxhash64(*key), *key).limit(sample_docs)

    small_batches(df.sparkSession)

    @tidy
    def cut(batches):
        for b in batches:
            labels, xs = [], []
            for label, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if has_letter(t):
                    x, lens = windows_of(t.encode())
                    x = x[lens >= min(64, lens.max())]
                    for k in np.unique(np.linspace(0, len(x) - 1, sample_windows).round().astype(int)):
                        labels.append(label)
                        xs.append(x[k].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(xs, pa.binary())], names=["label", "x"])

    # the sample is bounded by sample_docs, and so are the documents that it finds
    found = rows.join(F.broadcast(some), key).groupBy(*key).agg(F.min("t").alias("t"))
    found = found.select("label", "t").mapInArrow(cut, "label string, x binary").toPandas()
    if not len(found):
        return None
    found = found.sort_values(["label", "x"]).reset_index(drop=True)
    labels = sorted(set(found["label"]) | ({UND} if others else set()))
    net = Network(labels)
    x = np.frombuffer(b"".join(found["x"]), np.uint8).reshape(-1, WINDOW).astype(np.int32)
    y = found["label"].map(labels.index).to_numpy()
    if others:
        more = other_windows(x[::2])
        x, y = np.concatenate([x, more]), np.concatenate([y, np.full(len(more), labels.index(UND))])
    net.fit(x, y)
    return net


def predictor(net: Network | None, at_once: int = 256):
    """A function from a list of texts to (label, score) of each, windows in batches."""
    pairs = net and net.pair_tables()

    def predict(texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UND, 0.0)] * len(texts)
        if net is None:
            return out
        total = np.zeros((len(texts), len(net.labels)))
        held, n = [], 0

        def flush() -> None:
            x = np.concatenate([w for _, w, _ in held])
            own = np.concatenate([np.full(len(w), i) for i, w, _ in held])
            lens = np.concatenate([k for *_, k in held])
            for at in range(0, len(x), at_once):
                p = net.predict(x[at : at + at_once], pairs)
                np.add.at(total, own[at : at + at_once], p * lens[at : at + at_once, None])
            held.clear()

        known = [i for i, t in enumerate(texts) if has_letter(t)]
        for i in known:
            raw = texts[i].encode()
            # a long text goes through in pieces of whole windows' worth
            for at in range(0, len(raw), 1 << 20):
                w, lens = windows_of(raw[at : at + (1 << 20)])
                held.append((i, w, lens))
                n += len(w)
                if n >= at_once:
                    flush()
                    n = 0
        if held:
            flush()
        for i in known:
            p = total[i] / total[i].sum()
            out[i] = (net.labels[int(p.argmax())], float(p.max()))
        return out

    return predict


def identify(df: DataFrame, net: Network | None, text_col: str = "text", label_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``df`` with the predicted label and its score; the prediction sees the text alone."""

    small_batches(df.sparkSession)

    @F.pandas_udf("struct<label: string, score: double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = predictor(net)
        for s in batches:
            yield pd.DataFrame(predict(s.tolist()), columns=["label", "score"])
        del predict
        give_back()

    name = next(n for n in (f"_prediction{k}" for k in range(len(df.columns) + 1)) if n not in df.columns)
    out = df.withColumn(name, run(F.col(f"`{text_col}`").cast("string")))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (label_out, score_out)]
    return out.select(*keep, F.col(f"{name}.label").alias(label_out), F.col(f"{name}.score").alias(score_out))


def held_out(id_col: str = "doc_id") -> F.Column:
    """A quarter of the documents, never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(df: DataFrame, others: bool = False) -> Network | None:
    return train(df.where(~held_out()), others=others)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return identify(docs.select("doc_id", "text"), learned(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

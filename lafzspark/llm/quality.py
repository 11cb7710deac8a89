"""Quality: a score for each document by a generalised additive model with pairwise interactions.

Method: features are cut into bins at quantiles; shallow trees are boosted in cycles, one feature at a time, so that
each feature has one lookup table of its bins; then trees over pairs of features, the pairs that explain most of what
is left, add two-dimensional tables. A score is a sum of looked up numbers, made for a batch at once.

The model is fitted on at most SAMPLE labelled documents (labelled.py), never on held out ones; only their features
(a few numbers each) reach the driver. Scoring is one scan of the documents and shuffles nothing.

Defined cases: a null text counts as empty, and an empty text is scored like any other; without usable labels each
score is the labels' smoothed rate (one half without any label); repeated rows give a row each; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lafzspark.llm import labelled, scan, tables

MODULUS, HELD = 5, 0
THRESHOLD = 0.3
BINS, PAIR_BINS = 32, 8
CYCLES, PAIR_CYCLES, PAIRS = 80, 40, 8
RATE, LEAVES, RIDGE = 0.15, 4, 5.0
UPPER = bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
DIGITS = bytes(range(48, 58))
ENDS = b".!?"
SYMBOLS = bytes(b for b in range(33, 127) if bytes([b]) not in LETTERS + DIGITS and b not in b".,;:!?'\"-()")
FEATURES = (
    "log_words", "word_bytes", "distinct_words", "top_word", "repeats", "symbols", "digits", "upper", "ends", "distinct_lines", "line_words", "longest_word", "non_ascii",
)


def features(text: bytes) -> tuple[float, ...]:
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return (0.0,) * len(FEATURES)
    count = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    share = lambda which: (size - len(text.translate(None, which))) / size
    letters = max(1, size - len(text.translate(None, LETTERS)))
    ascii_size = len(text.translate(None, bytes(range(128, 256))))
    return (
        math.log1p(n),
        sum(map(len, words)) / n,
        len(count) / n,
        max(count.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        share(SYMBOLS),
        share(DIGITS),
        (size - len(text.translate(None, UPPER))) / letters,
        (size - len(text.translate(None, ENDS))) / n,
        len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        math.log(max(map(len, count))),
        1 - ascii_size / size,
    )


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """A step for each bin: bins are split into runs where that helps most, up to `leaves` runs."""
    value = lambda g, h: g * g / (h + RIDGE)
    runs = [(0, len(grad))]
    while len(runs) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(runs):
            g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
            if b - a > 1:
                gain = value(g[:-1], h[:-1]) + value(g[-1] - g[:-1], h[-1] - h[:-1]) - value(g[-1], h[-1])
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (float(gain[at]), k, a + at + 1)
        if best[1] is None:
            break
        a, b = runs[best[1]]
        runs[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in runs:
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + RIDGE)
    return out


def _cross(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a table into four quarters: what it gains, and a step for each cell."""
    g, h = np.cumsum(np.cumsum(grad, 0), 1), np.cumsum(np.cumsum(hess, 0), 1)
    parts = []
    for x in (g, h):
        a = x[:-1, :-1]
        b, c = x[:-1, -1:] - a, x[-1:, :-1] - a
        parts.append((a, b, c, x[-1, -1] - a - b - c))
    gain = sum(p * p / (q + RIDGE) for p, q in zip(*parts, strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    steps = [p[i, j] / (q[i, j] + RIDGE) for p, q in zip(*parts, strict=True)]
    out = np.empty_like(grad)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = steps
    return float(gain[i, j] - g[-1, -1] ** 2 / (h[-1, -1] + RIDGE)), out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Edges of bins, a table for each feature, pairs with their tables, and the base."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    n = x.shape[1]
    base = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    model = {"edges": edges, "coarse": coarse, "base": base, "tables": [np.zeros(len(e) + 1) for e in edges], "pairs": []}
    if not 0 < y.sum() < len(y):
        return model
    bins = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(n)]
    total = np.full(len(y), base)

    def slopes(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(total)
        return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

    for _ in range(CYCLES):
        for j in range(n):
            step = RATE * _tree(*slopes(bins[j], len(edges[j]) + 1), LEAVES)
            model["tables"][j] += step
            total += step[bins[j]]
    rough = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(n)]
    shapes = [len(c) + 1 for c in coarse]
    cell = lambda i, j: rough[i] * shapes[j] + rough[j]
    square = lambda i, j: [v.reshape(shapes[i], shapes[j]) for v in slopes(cell(i, j), shapes[i] * shapes[j])]
    able = [(i, j) for i in range(n) for j in range(i) if shapes[i] > 1 and shapes[j] > 1]
    best = sorted(able, key=lambda ij: (-_cross(*square(*ij))[0], ij))[:PAIRS]
    model["pairs"] = [(i, j, np.zeros((shapes[i], shapes[j]))) for i, j in best]
    for _ in range(PAIR_CYCLES):
        for i, j, table in model["pairs"]:
            step = RATE * _cross(*square(i, j))[1]
            table += step
            total += step[rough[i], rough[j]]
    return model


def score(model: dict, x: np.ndarray) -> np.ndarray:
    total = np.full(len(x), model["base"])
    rough = [np.searchsorted(c, v, side="right") for c, v in zip(model["coarse"], x.T, strict=True)]
    for e, t, v in zip(model["edges"], model["tables"], x.T, strict=True):
        total += t[np.searchsorted(e, v, side="right")]
    for i, j, t in model["pairs"]:
        total += t[rough[i], rough[j]]
    return _sigmoid(total)


def _rows(batches):
    for batch in batches:
        rows = [features(t or b"") for t in scan.as_bytes(batch.column("text")).to_pylist()]
        values = pa.array(rows, pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([values, batch.column("label")], names=["x", "y"])


def train_model(docs: DataFrame, labels: DataFrame, sample: int = labelled.SAMPLE) -> dict:
    """docs has doc_id and text."""
    rows = labelled.training_rows(docs, labels, "quality", MODULUS, HELD, sample).mapInArrow(_rows, "x array<double>, y int").collect()
    data = sorted((*r["x"], r["y"]) for r in rows)
    data = np.array(data, float).reshape(-1, len(FEATURES) + 1)
    return fit(data[:, :-1], data[:, -1])


def _score(model: dict):
    def run(batches):
        for batch in batches:
            for a, b in scan.slices(np.full(len(batch), 1), 2048):
                x = np.array([features(t or b"") for t in scan.as_bytes(batch.column("text").slice(a, b - a)).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(score(model, x))], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, sample: int = labelled.SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    own = tables.id_text(docs, id_col, text_col)
    scored = own.mapInArrow(_score(train_model(own, labels, sample)), tables.schema(own, "score double"))
    held = labelled.is_held_out(F.col("doc_id"), MODULUS, HELD).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

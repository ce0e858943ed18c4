"""Classifiers of transitions: one-vs-rest logistic regression and a sparse-input MLP.

Both train on mini-batches of a bounded CSR matrix in files of the driver, which
are mapped, not held (the training matrix has a byte cap; a larger one is an error
that asks for fewer columns or rows), and score in Spark by ``mapInPandas`` over
the feature rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import IO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import settle

MATRIX_BYTES = 4 << 30
#: Numbers of one intermediate array, about.
BLOCK = 1 << 20
#: Rows and their entries that come to the driver as one.
CHUNK_ROWS, CHUNK_ENTRIES = 4096, 1 << 17
#: Entries of one part of a matrix on its way to the driver, which holds a part at a time.
PART_ENTRIES = 1 << 20


@dataclass
class Sparse:
    """CSR rows with labels (class ids, -1: none)."""

    ptr: np.ndarray
    col: np.ndarray
    val: np.ndarray
    width: int
    label: np.ndarray

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def take(self, rows: np.ndarray) -> Sparse:
        n = np.diff(self.ptr)[rows]
        at = np.repeat(self.ptr[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return Sparse(np.concatenate(([0], np.cumsum(n))), self.col[at], self.val[at], self.width, self.label[rows])

    def blocks(self, wide: int) -> Iterator[tuple[int, Sparse]]:
        """Stretches of rows with about :data:`BLOCK` numbers at ``wide`` numbers an entry, and where they begin."""
        lo, most = 0, max(1, BLOCK // max(wide, 1))
        while lo < len(self):
            hi = int(np.searchsorted(self.ptr, self.ptr[lo] + most, "right")) - 1
            hi = min(max(hi, lo + 1), lo + most, len(self))
            a, b = self.ptr[lo], self.ptr[hi]
            yield lo, Sparse(np.asarray(self.ptr[lo : hi + 1]) - a, np.asarray(self.col[a:b]), np.asarray(self.val[a:b]), self.width, self.label[lo:hi])
            lo = hi

    def scaled(self, scale: np.ndarray) -> Sparse:
        return Sparse(self.ptr, self.col, self.val / scale[self.col], self.width, self.label)

    def dense(self) -> np.ndarray | None:
        """The matrix itself, if a quarter of it or more is entries."""
        if len(self) * self.width > 4 * len(self.col):
            return None
        at = np.repeat(np.arange(len(self)) * self.width, np.diff(self.ptr)) + self.col
        return np.bincount(at, self.val, len(self) * self.width).reshape(len(self), self.width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self), w.shape[1]))
        for lo, x in self.blocks(w.shape[1]):
            part = out[lo : lo + len(x)]
            if (dense := x.dense()) is not None:
                part[:] = dense @ w
            elif len(x.col):
                some = np.flatnonzero(np.diff(x.ptr))
                part[some] = np.add.reduceat(x.val[:, None] * w[x.col], x.ptr[some], axis=0)
        return out

    def outer(self, g: np.ndarray) -> np.ndarray:
        """Transposed product with dense rows."""
        out = np.zeros((self.width, g.shape[1]))
        for lo, x in self.blocks(g.shape[1]):
            rows = g[lo : lo + len(x)]
            if (dense := x.dense()) is not None:
                out += dense.T @ rows
            elif len(x.col):
                order = np.argsort(x.col, kind="stable")
                col = x.col[order]
                first = np.flatnonzero(np.concatenate(([True], col[1:] != col[:-1])))
                of = np.repeat(np.arange(len(x)), np.diff(x.ptr))[order]
                out[col[first]] += np.add.reduceat(x.val[order][:, None] * rows[of], first, axis=0)
        return out


def _mapped(f: IO, kind: type) -> np.ndarray:
    f.flush()
    return np.memmap(f, kind, "r") if f.tell() else np.zeros(0, kind)


def load_matrix(features: DataFrame, labels: DataFrame, width: int, most: int = MATRIX_BYTES) -> Sparse:
    """Rows of ``row, col, val`` with ``row, label`` as one matrix in order, if it fits ``most`` bytes.

    It comes partition by partition as packed numbers and is written to files
    without names on the driver, so neither side there holds it.
    """
    size = features.join(labels, "row", "left_semi").agg(F.count("*").alias("nnz")).first().nnz
    if size * 16 > most:
        raise ValueError(f"the training matrix needs {size * 16} bytes; at most {most} are allowed")
    packed = settle(labels.join(_packed(features), "row", "left").select("row", F.col("label").cast("long").alias("label"), "c"))
    packed = packed.repartitionByRange(1 + size // PART_ENTRIES, "row").sortWithinPartitions("row", "label", "c").select("label", *_parts("c"))

    def chunks(it):
        for df in it:
            if df["label"].isna().any():
                raise ValueError("a row without a label")
            n = df["col"].map(len).to_numpy(np.int64) if len(df) else np.zeros(0, np.int64)
            ends = np.concatenate(([0], np.cumsum(n)))
            lo = 0
            while lo < len(df):
                hi = min(max(int(np.searchsorted(ends, ends[lo] + CHUNK_ENTRIES, "right")) - 1, lo + 1), lo + CHUNK_ROWS, len(df))
                part = df.iloc[lo:hi]
                col, val = (np.concatenate(list(part[c])) for c in ("col", "val"))
                yield pd.DataFrame({"n": [n[lo:hi].tobytes()], "label": [part["label"].to_numpy(np.int64).tobytes()], "col": [col.astype(np.int64).tobytes()], "val": [val.astype(float).tobytes()]})
                lo = hi

    names = ("n", "label", "col", "val")
    files = {k: tempfile.TemporaryFile() for k in names}  # noqa: SIM115
    for r in packed.mapInPandas(chunks, "n binary, label binary, col binary, val binary").toLocalIterator():
        for k in names:
            files[k].write(r[k])
    n, label, col, val = (_mapped(files[k], float if k == "val" else np.int64) for k in names)
    return Sparse(np.concatenate(([0], np.cumsum(n))).astype(np.int64), col, val, width, np.array(label))


def _packed(features: DataFrame) -> DataFrame:
    return features.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val")))).alias("c"))


def _parts(packed: str) -> list:
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return [F.coalesce(F.col(f"{packed}.{f}"), none(kind)).alias(f) for f, kind in (("col", "bigint"), ("val", "double"))]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def loss(p: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    q = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-15))
    return float(np.average(q, weights=None if weight is None else weight[y]))


def class_weights(y: np.ndarray, classes: int, policy: str) -> np.ndarray:
    """``none``, ``balanced`` or ``inverse_sqrt`` (sample mean 1); absent classes weigh 0."""
    n = np.bincount(y, minlength=classes)
    if policy == "none":
        return (n > 0).astype(float)
    w = np.where(n > 0, len(y) / (np.count_nonzero(n) * np.maximum(n, 1)), 0.0)
    if policy == "inverse_sqrt":
        w = np.sqrt(w)
        w *= len(y) / (w * n).sum()
    return w


@dataclass
class History:
    """Losses by epoch; the best is the strictly lowest, patience counts from ``min_delta``."""

    patience: int
    min_delta: float
    losses: list[float] = field(default_factory=list)
    best: int = -1
    stop_loss: float = float("inf")
    stale: int = 0

    def add(self, value: float) -> bool:
        """Record a loss; whether it is the new best."""
        better = self.best < 0 or value < self.losses[self.best]
        self.losses.append(value)
        if better:
            self.best = len(self.losses) - 1
        if value < self.stop_loss - self.min_delta:
            self.stop_loss, self.stale = value, 0
        else:
            self.stale += 1
        return better

    @property
    def over(self) -> bool:
        return self.stale >= self.patience


@dataclass
class Logistic:
    """One weight vector per class; probabilities are the classes' sigmoids, normalised."""

    w: np.ndarray
    b: np.ndarray
    scale: np.ndarray

    def probabilities(self, x: Sparse) -> np.ndarray:
        out = np.zeros((len(x), self.w.shape[1]))
        for lo, part in x.blocks(self.w.shape[1]):
            p = 1 / (1 + np.exp(-np.clip(part.scaled(self.scale).dot(self.w) + self.b, -500, 500)))
            s = p.sum(1, keepdims=True)
            out[lo : lo + len(part)] = np.where(s > 0, p / np.where(s > 0, s, 1), 1 / p.shape[1])
        return out


def max_abs(x: Sparse) -> np.ndarray:
    out = np.zeros(x.width)
    for _, part in x.blocks(1):
        np.maximum.at(out, part.col, np.abs(part.val))
    out[out == 0] = 1
    return out


def fit_logistic(train: Sparse, valid: Sparse, classes: int, alpha: float = 1e-4, epochs: int = 5, patience: int = 5, min_delta: float = 1e-4, batch: int = 8192, l2: bool = True, rate: float = 0.5, seed: int = 0) -> tuple[Logistic, History]:
    """Stochastic gradient descent; the snapshot of the lowest validation loss is kept."""
    scale = max_abs(train)
    x = train
    w, b, rng = np.zeros((x.width, classes)), np.zeros(classes), np.random.default_rng(seed)
    history, best, step = History(patience, min_delta), None, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), min(batch, max(1, len(order)))):
            part = x.take(order[lo : lo + batch]).scaled(scale)
            y = np.eye(classes)[part.label]
            g = (1 / (1 + np.exp(-np.clip(part.dot(w) + b, -500, 500))) - y) / len(part)
            eta = rate / (1 + alpha * rate * step) * max(1.0, np.sqrt(len(part)))
            if l2:
                w *= 1 - min(eta * alpha, 0.5)
            w -= eta * part.outer(g)
            b -= eta * g.sum(0)
            step += 1
        model = Logistic(w.copy(), b.copy(), scale)
        if history.add(loss(model.probabilities(valid), valid.label)):
            best = model
        if history.over:
            break
    return best, history


@dataclass
class Mlp:
    """Sparse first layer, ReLU, dense tail."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    scale: np.ndarray

    def forward(self, x: Sparse, rng=None, dropout: float = 0.0) -> tuple[list, np.ndarray]:
        z = x.dot(self.layers[0][0]) + self.layers[0][1]
        kept = []
        for w, b in self.layers[1:]:
            h = np.maximum(z, 0)
            mask = np.ones_like(h) if rng is None or not dropout else (rng.random(h.shape) >= dropout) / (1 - dropout)
            kept.append((z, h * mask, mask))
            z = (h * mask) @ w + b
        return kept, softmax(z)

    def probabilities(self, x: Sparse) -> np.ndarray:
        out = np.zeros((len(x), len(self.layers[-1][1])))
        for lo, part in x.blocks(max(len(b) for _, b in self.layers)):
            out[lo : lo + len(part)] = self.forward(part.scaled(self.scale))[1]
        return out


def fit_mlp(train: Sparse, valid: Sparse, classes: int, hidden: tuple[int, ...] = (256,), rate: float = 1e-3, decay: float = 1e-4, dropout: float = 0.0, smoothing: float = 0.0, weights: str = "none", epochs: int = 50, patience: int = 10, min_delta: float = 0.0, batch: int = 512, seed: int = 0) -> tuple[Mlp, History]:
    """AdamW on weighted, label-smoothed cross-entropy; keeps the best validation snapshot."""
    rng = np.random.default_rng(seed)
    scale = max_abs(train)
    x = train
    sizes = [x.width, *hidden, classes]
    layers = [(rng.normal(0, np.sqrt(2 / max(a, 1)) if k else 0.05, (a, b)), np.zeros(b)) for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False))]
    net, cw = Mlp(layers, scale), class_weights(x.label, classes, weights)
    m = [[np.zeros_like(p) for p in layer] for layer in layers]
    v = [[np.zeros_like(p) for p in layer] for layer in layers]
    history, best, t = History(patience, min_delta), None, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), batch):
            part = x.take(order[lo : lo + batch]).scaled(scale)
            kept, p = net.forward(part, rng, dropout)
            y = np.eye(classes)[part.label] * (1 - smoothing) + smoothing / classes
            sample = cw[part.label]
            g = (p - y) * (sample / max(sample.sum(), 1e-12))[:, None]
            grads = []
            for (w, _), (z, h, mask) in zip(reversed(net.layers[1:]), reversed(kept), strict=True):
                grads.append((h.T @ g, g.sum(0)))
                g = (g @ w.T) * mask * (z > 0)
            grads.append((part.outer(g), g.sum(0)))
            t += 1
            new = []
            for k, (layer, grad) in enumerate(zip(net.layers, reversed(grads), strict=True)):
                out = []
                for j, (q, d) in enumerate(zip(layer, grad, strict=True)):
                    m[k][j] = 0.9 * m[k][j] + 0.1 * d
                    v[k][j] = 0.999 * v[k][j] + 0.001 * d * d
                    q = q * (1 - rate * decay) if j == 0 else q
                    out.append(q - rate * (m[k][j] / (1 - 0.9**t)) / (np.sqrt(v[k][j] / (1 - 0.999**t)) + 1e-8))
                new.append(tuple(out))
            net = Mlp(new, scale)
        if history.add(loss(net.probabilities(valid), valid.label)):
            best = net
        if history.over:
            break
    return best, history


def score(features: DataFrame, model, width: int, classes: int) -> DataFrame:
    """``row, cls, p`` of every row; the model is broadcast with the function."""
    packed = _packed(features).select("row", *_parts("c"))

    def body(it):
        for df in it:
            if not len(df):
                continue
            n = df["col"].map(len)
            x = Sparse(np.concatenate(([0], np.cumsum(n))).astype(np.int64), np.concatenate(list(df["col"])).astype(np.int64), np.concatenate(list(df["val"])).astype(float), width, np.full(len(df), -1))
            p = model.probabilities(x)
            yield pd.DataFrame({"row": np.repeat(df["row"].to_numpy(), classes), "cls": np.tile(np.arange(classes), len(df)), "p": p.ravel()})

    return packed.mapInPandas(body, "row long, cls long, p double")

"""Fully connected networks for one response: regression, two classes, and hybrid binding responses (MOD4, MOD5).

Weights are small and live on the driver; data stay where they are.  Each step every task sums the gradient of its rows in matrices of bounded
size, and one row per task comes back.  Steps are full passes with Adam, so results do not depend on the partitioning but for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicata.plans.storage import materialize, release

ROWS = 4096  # rows of a matrix inside a task
LN10 = float(np.log(10.0))


class Network:
    """Weights of a network with one output, and its forward and backward pass."""

    def __init__(self, sizes: list[int], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, np.sqrt(2.0 / a), (a, b)) for a, b in zip(sizes, [*sizes[1:], 1], strict=True)]
        self.b = [np.zeros(b) for b in [*sizes[1:], 1]]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        kept = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            x = x @ w + b
            if i < len(self.w) - 1:
                x = np.maximum(x, 0.0)
                kept.append(x)
        return x[:, 0], kept

    def backward(self, kept: list[np.ndarray], slope: np.ndarray) -> list[np.ndarray]:
        out, g = [], slope[:, None]
        for i in range(len(self.w) - 1, -1, -1):
            out += [g.sum(0), kept[i].T @ g]
            if i:
                g = (g @ self.w[i].T) * (kept[i] > 0)
        return out[::-1]

    def flat(self) -> list[np.ndarray]:
        return [a for w, b in zip(self.w, self.b, strict=True) for a in (w, b)]


def losses(loss: str, out: np.ndarray, y: np.ndarray, conc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each row and its slope in the output.

    ``l2``; ``log``: of a class 0 or 1; ``hybrid``, ``poisson``: squared error of an activity, and where a concentration in nM is given, squared or Poisson loss of the fraction
    bound at it.
    """
    if loss == "log":
        p = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
        return np.logaddexp(0, out) - y * out, p - y
    square, slope = (out - y) ** 2, 2 * (out - y)
    if loss == "l2":
        return square, slope
    if loss not in ("hybrid", "poisson"):
        raise ValueError(f"unknown loss {loss}")
    single = ~np.isnan(conc)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        bound = np.clip(1 / (1 + 10.0 ** (9 - out) / np.where(single, conc, 1.0)), 1e-7, 1 - 1e-7)
    turn = bound * (1 - bound) * LN10
    if loss == "poisson":
        return np.where(single, bound - y * np.log(bound), square), np.where(single, (1 - y / bound) * turn, slope)
    return np.where(single, (bound - y) ** 2, square), np.where(single, 2 * (bound - y) * turn, slope)


def _matrices(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    for i in range(0, b.num_rows, ROWS):
        s = b.slice(i, ROWS)
        x = s.column("x").flatten().to_numpy(zero_copy_only=False).reshape(s.num_rows, -1)
        yield (x, *(s.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "w", "conc")), s.column("held").to_numpy(zero_copy_only=False).astype(bool))


def _pass(rows: DataFrame, net: Network, loss: str) -> tuple[list[np.ndarray], float, float]:
    """Mean gradient over training rows, and the mean loss of training and of held rows."""
    shapes = [a.shape for a in net.flat()]
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, grad, sums = shared.value, None, np.zeros(4)
        for b in batches:
            for x, y, w, conc, held in _matrices(b):
                out, kept = own.forward(x)
                each, slope = losses(loss, out, y, conc)
                t = w * ~held
                g = own.backward(kept, slope * t)
                grad = g if grad is None else [p + q for p, q in zip(grad, g, strict=True)]
                sums += ((each * t).sum(), t.sum(), (each * w * held).sum(), (w * held).sum())
        if grad is not None:
            flat = np.concatenate([sums, *[a.ravel() for a in grad]])
            yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()], pa.list_(pa.float64()))], ["v"])

    total = np.sum([np.array(r.v) for r in rows.mapInArrow(run, "v array<double>").collect()], axis=0)
    shared.destroy()
    grads, at = [], 4
    for s in shapes:
        n = int(np.prod(s))
        grads.append(total[at : at + n].reshape(s) / max(total[1], 1e-300))
        at += n
    return grads, float(total[0] / max(total[1], 1e-300)), float(total[2] / total[3]) if total[3] else float("nan")


def fit_network(df: DataFrame, layers: list[int], loss: str = "l2", epochs: int = 200, rate: float = 0.01, patience: int = 30, min_gain: float = 0.0, penalty: float = 0.0, seed: int = 0) -> tuple[Network, list[tuple[float, float]], int]:
    """MOD4, MOD5: a network of ``features`` (array of doubles) for ``y``: ``(network, [(training loss, validation loss) per epoch], best epoch)``.

    Rows with ``subset`` train are learned from, those with valid are held out: training stops when their loss has not fallen by more than ``min_gain`` for ``patience`` epochs, and the
    network of the best epoch is returned (without such rows, that of the last).  Optional columns: ``w`` (weight, else 1), ``conc`` (hybrid losses).  Rows with a missing
    response, features or weight are left out.
    """
    has = lambda c, other: F.col(c).cast("double") if c in df.columns else F.lit(other)
    rows = df.filter(F.col("subset").isin("train", "valid")).select(F.col("features").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"), has("w", 1.0).alias("w"), F.coalesce(has("conc", float("nan")), F.lit(float("nan"))).alias("conc"), (F.col("subset") == "valid").alias("held"))
    rows = materialize(rows.filter("x is not null and y is not null and not isnan(y) and w is not null and not exists(x, v -> v is null or isnan(v))"))
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no rows to train on")
    net = Network([first.n, *layers], seed)
    m, v = [np.zeros_like(a) for a in net.flat()], [np.zeros_like(a) for a in net.flat()]
    history, best, kept = [], (np.inf, 0), [a.copy() for a in net.flat()]
    for e in range(epochs):
        grads, train, valid = _pass(rows, net, loss)
        history.append((train, valid))
        if np.isnan(valid) or valid < best[0] - min_gain:
            best, kept = (valid if not np.isnan(valid) else best[0], e), [a.copy() for a in net.flat()]
        elif e - best[1] >= patience:
            break
        for i, (a, g) in enumerate(zip(net.flat(), grads, strict=True)):
            g = g + penalty * a
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            a -= rate * (m[i] / (1 - 0.9 ** (e + 1))) / (np.sqrt(v[i] / (1 - 0.999 ** (e + 1))) + 1e-8)
    release(rows)
    for a, k in zip(net.flat(), kept, strict=True):
        a[...] = k
    return net, history, best[1]


def predict_network(net: Network, df: DataFrame, key: str, loss: str = "l2") -> DataFrame:
    """``key, pred``: the output, for ``log`` the probability of class 1; null where features are missing."""
    shared = df.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x")
            out = shared.value.forward(x.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))[0] if b.num_rows else np.zeros(0)
            if loss == "log":
                out = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(out)], ["k", "pred"])

    kind = dict(df.dtypes)[key]
    whole = df.filter("features is not null and not exists(features, v -> v is null or isnan(v))").select(F.col(key).alias("k"), F.col("features").cast("array<double>").alias("x"))
    return df.select(key).join(whole.mapInArrow(run, f"k {kind}, pred double").withColumnRenamed("k", key), key, "left")


def kfold_epochs(df: DataFrame, folds: int, layers: list[int], loss: str = "l2", **more) -> tuple[Network, int]:
    """MOD4: one network per fold (rows of the fold are held out), validation losses averaged per epoch, and a network retrained on all rows to the best epoch.

    Every fold runs the same number of epochs; the earliest epoch of the least mean loss counts.
    """
    curves = []
    for f in range(folds):
        split = df.filter("subset <> 'test'").withColumn("subset", F.when(F.col("fold") == f, "valid").otherwise("train"))
        curves.append([v for _, v in fit_network(split, layers, loss, **more)[1]])
    n = min(map(len, curves))
    best = int(np.argmin(np.mean([c[:n] for c in curves], axis=0)))
    net, _, _ = fit_network(df.filter("subset <> 'test'").withColumn("subset", F.lit("train")), layers, loss, **(more | {"epochs": best + 1}))
    return net, best

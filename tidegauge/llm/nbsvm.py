"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model.

Steps: (1) a bounded sample of labelled rows, both classes, chosen by a hash of the id; (2) hashed n-gram indicators of
their whole texts; (3) log-count ratios from sums over the sample; (4) dual coordinate descent on blocks of rows in
parallel, whose steps are averaged after each round; (5) a sigmoid on rows kept out of (4), weighted back to the class
frequencies of all labelled rows, turns margins into probabilities. Only the coefficients (a fixed number of hash
buckets) and one dual value for each sampled row come to the driver. Scoring is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import ID, append, lean, stored, text_of

BUCKETS = 1 << 18
#: Labelled rows used for a fit, at most, half of them for each class if there are as many.
MAX_TRAIN = 12_000
BLOCK = 2_000
ROUNDS = 4
EPOCHS = 4
COST = 0.05
Featurise = Callable[[str], np.ndarray]


@dataclass(frozen=True)
class Model:
    """Coefficient for each bucket (ratio times weight), bias, and the sigmoid's slope and offset."""

    coef: np.ndarray
    bias: float
    slope: float
    offset: float


def distinct(idx: np.ndarray) -> np.ndarray:
    if len(idx) < 2:
        return idx
    idx = np.sort(idx)
    return idx[np.concatenate(([True], idx[1:] != idx[:-1]))]


def buckets(h: np.ndarray) -> np.ndarray:
    """32-bit or 64-bit hashes to buckets by their top bits."""
    bits = BUCKETS.bit_length() - 1
    return (h >> h.dtype.type(h.dtype.itemsize * 8 - bits)).astype(np.int32)


def character_ngrams(codes: np.ndarray, n: int) -> np.ndarray:
    """Buckets of all runs of ``n`` characters."""
    if len(codes) < n:
        return np.empty(0, dtype=np.int32)
    h = np.full(len(codes) - n + 1, n, dtype=np.uint32)
    for i in range(n):
        h = h * np.uint32(0x01000193 * 5) + codes[i : len(codes) - n + 1 + i]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return buckets((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _sample(labels: DataFrame, label: str, trains: Column, limit: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y) of at most ``limit`` rows and the class sizes of all labelled rows that may train."""
    known = lean(labels, ID, label).filter(F.col(ID).isNotNull() & F.col(f"`{label}`").isin(0, 1) & trains).groupBy(ID).agg(F.max(f"`{label}`").cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    take1 = min(n1, max(limit // 2, limit - n0))
    take0 = min(n0, limit - take1)
    order = F.xxhash64(F.lit("sample"), F.col(ID)), F.col(ID)
    return known.filter("y = 0").orderBy(*order).limit(take0).unionByName(known.filter("y = 1").orderBy(*order).limit(take1)), {0: n0, 1: n1}


def _sums(rows: DataFrame, featurise: Featurise) -> np.ndarray:
    """Rows of each class that have each bucket: (2, BUCKETS)."""

    def partial(batches):
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        for b in batches:
            for y, text in zip(b["y"], b["text"]):
                total[y, featurise(text)] += 1
        hit = np.flatnonzero(total.any(axis=0))
        yield pd.DataFrame({"bucket": hit, "n0": total[0, hit], "n1": total[1, hit]})

    sums = rows.mapInPandas(partial, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    out = np.zeros((2, BUCKETS))
    out[:, sums["bucket"].to_numpy(dtype=int)] = sums[["n0", "n1"]].to_numpy(dtype=float).T
    return out


def _descend(rows: DataFrame, ratio: np.ndarray, featurise: Featurise, n_blocks: int, cost: dict[int, float], rounds: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; each round every block starts from the common weights."""
    weights, alphas = np.zeros(BUCKETS + 1, dtype=np.float64), {}
    for r in range(rounds):
        w0, a0, scale = weights.astype(np.float32), alphas, float(n_blocks)

        def local(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("row")
            w, x = w0.astype(np.float64), [featurise(t) for t in pdf["text"]]
            signs, ids = 2.0 * pdf["y"].to_numpy() - 1, pdf["row"].tolist()
            a = np.array([a0.get(i, 0.0) for i in ids])
            before, norm = a.copy(), np.array([float((ratio[i] ** 2).sum()) + 1 for i in x])
            rng = np.random.default_rng(r)
            for _ in range(EPOCHS):
                for i in rng.permutation(len(x)):
                    at, s = x[i], signs[i]
                    v = ratio[at]
                    gradient = s * (float(w[at] @ v) + w[BUCKETS]) - 1
                    new = min(max(a[i] - gradient / norm[i], 0.0), cost[int(s > 0)])
                    if new != a[i]:
                        step = (new - a[i]) * s
                        w[at] += step * v
                        w[BUCKETS] += step
                        a[i] = new
            change = (w - w0).astype(np.float32)
            return pd.DataFrame({"change": [change.tobytes()], "rows": [ids], "alphas": [(before + (a - before) / scale).tolist()]})

        total = np.zeros(BUCKETS + 1)
        for out in rows.groupBy("block").applyInPandas(local, "change binary, rows array<long>, alphas array<double>").toLocalIterator():
            total += np.frombuffer(out["change"], dtype=np.float32)
            alphas = {**alphas, **dict(zip(out["rows"], out["alphas"]))}
        weights = weights + total / n_blocks
    return weights[:BUCKETS], float(weights[BUCKETS])


def _sigmoid_fit(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic fit by Newton steps, with a little ridge."""
    scale = max(float(np.abs(margin).mean()), 1e-9)
    x = np.stack([margin / scale, np.ones_like(margin)], axis=1)
    # targets a little inside 0 and 1, as many as there are rows of the class
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (p - target)) + 1e-3 * beta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-6) / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, label: str, trains: Column, featurise: Featurise, max_train: int = MAX_TRAIN, smoothing: float = 1.0) -> Model:
    """``trains``: which ids may be learned from. Without rows of both classes the model is the class frequency."""
    sample, sizes = _sample(labels, label, trains, max_train)

    # the sample has max_train rows of twelve bytes at most
    picked = lean(docs, ID, "text").join(F.broadcast(sample), ID).select(F.xxhash64(ID, text_of()).alias("row"), "y", text_of().alias("text"))
    # texts are stored and not their n-grams, which take several times the room and are made again in a moment
    rows = stored(picked.dropDuplicates(["row"]).withColumn("calibrates", F.pmod("row", F.lit(5)) == 0), "sample")
    counts = {(r["y"], r["calibrates"]): r["n"] for r in rows.groupBy("y", "calibrates").agg(F.count("*").alias("n")).collect()}
    prior = (sizes[1] + 1) / (sizes[0] + sizes[1] + 2)
    if any(counts.get((y, c), 0) == 0 for y in (0, 1) for c in (False, True)):
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0, 1.0, float(np.log(prior / (1 - prior))))
    training = rows.filter(~F.col("calibrates"))
    n = counts[0, False] + counts[1, False]
    sums = _sums(training, featurise) + smoothing
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    n_blocks = -(-n // BLOCK)
    cost = {y: COST * n / (2 * counts[y, False]) for y in (0, 1)}
    blocks = training.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)))
    weights, bias = _descend(blocks, ratio.astype(np.float32), featurise, n_blocks, cost, ROUNDS)
    coef = (weights * ratio).astype(np.float32)

    def margins(batches):
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "m": [float(coef[featurise(t)].sum(dtype=np.float64)) + bias for t in b["text"]]})

    kept = rows.filter("calibrates").mapInPandas(margins, "y int, m double").toPandas()  # a fifth of the sample
    y = kept["y"].to_numpy(dtype=float)
    weight = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum()) * len(y) / (sizes[0] + sizes[1])
    slope, offset = _sigmoid_fit(kept["m"].to_numpy(), y, weight)
    return Model(coef, bias, slope, offset)


def score(docs: DataFrame, model: Model, featurise: Featurise) -> DataFrame:
    """All columns of ``docs`` and ``__score``, the probability of label 1. Empty and null texts have no n-grams."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(texts: list) -> dict:
        m = held.value
        margin = np.array([float(m.coef[featurise(t)].sum(dtype=np.float64)) if t else 0.0 for t in texts]) + m.bias
        return {"__score": 1 / (1 + np.exp(-np.clip(margin * m.slope + m.offset, -500, 500)))}

    return append(docs, run, "__score double")

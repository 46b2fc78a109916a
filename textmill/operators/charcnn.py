"""Character convolutions with max-pooling, trained by synchronised gradients.

A text is a sequence of code points (modulo ``SYMBOLS``); filters of three to
five characters slide over its whole length, each gives its greatest response,
and a logistic unit weighs these.  A text is read in pieces that overlap by a
filter's length, so memory doesn't grow with it, and the gradient needs only
the places of the greatest responses.  Null texts are empty; texts below five
characters are filled up with symbol 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.storage import cut

SYMBOLS, DIM, FILTERS, WIDTHS = 512, 8, 24, (3, 4, 5)
PIECE = 4096


def start(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"emb": rng.normal(0, 0.5, (SYMBOLS, DIM)), "out": rng.normal(0, 0.1, len(WIDTHS) * FILTERS), "bias": np.zeros(1)}
    for w in WIDTHS:
        p |= {f"w{w}": rng.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS)), f"b{w}": np.zeros(FILTERS)}
    return p


def symbols(text: str | None) -> np.ndarray:
    ids = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4") % SYMBOLS
    return np.concatenate([ids, np.zeros(max(0, max(WIDTHS) - len(ids)), ids.dtype)]).astype(np.int64)


def pooled(p: dict, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's greatest response over the whole text, and where it is
    (the first of equal ones)."""
    best, where = [], []
    for w in WIDTHS:
        top, at = np.full(FILTERS, -np.inf), np.zeros(FILTERS, np.int64)
        for a in range(0, len(ids) - w + 1, PIECE):
            e = p["emb"][ids[a : a + PIECE + w - 1]]
            n = len(e) - w + 1
            r = sum(e[j : j + n] @ p[f"w{w}"][j * DIM : (j + 1) * DIM] for j in range(w)) + p[f"b{w}"]
            i = r.argmax(0)
            new = r[i, np.arange(FILTERS)]
            at, top = np.where(new > top, a + i, at), np.maximum(new, top)
        best.append(top)
        where.append(at)
    return np.concatenate(best), np.concatenate(where)


def score(p: dict, text: str | None) -> float:
    top, _ = pooled(p, symbols(text))
    z = float(np.maximum(top, 0) @ p["out"] + p["bias"][0])
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def gradient(p: dict, text: str | None, y: float, weight: float, into: dict) -> float:
    """Adds a row's gradient of the weighted log loss to ``into``; the loss."""
    ids = symbols(text)
    top, where = pooled(p, ids)
    h = np.maximum(top, 0)
    z = float(h @ p["out"] + p["bias"][0])
    d = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
    into["out"] += d * h
    into["bias"] += d
    back = d * p["out"] * (top > 0)
    for k, w in enumerate(WIDTHS):
        b, at = back[k * FILTERS : (k + 1) * FILTERS], where[k * FILTERS : (k + 1) * FILTERS]
        seen = ids[at[:, None] + np.arange(w)]  # filters x w
        into[f"w{w}"] += p["emb"][seen].reshape(FILTERS, -1).T * b
        into[f"b{w}"] += b
        np.add.at(into["emb"], seen, (p[f"w{w}"].T * b[:, None]).reshape(FILTERS, w, DIM))
    return weight * float(np.logaddexp(0, z) - y * z)


def fit(rows: DataFrame, label: str, steps: int = 60, rate: float = 0.03, most: int = 4000, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters from at most ``most`` labelled rows (a documented bound, the
    smallest hashes of the text), classes weighed alike; rows without a label
    take no part.  Each step is one job over the sample, which lies in the
    shared folder; a task gives one sum of gradients, the driver takes a step
    of Adam.  One class, or no row, gives the start."""
    held = rows.filter(F.col(label).isNotNull()).select("text", F.col(label).cast("double").alias("y"))
    held = held.orderBy(F.xxhash64("text"), "text", "y").limit(most)
    tasks = min(32, rows.sparkSession.sparkContext.defaultParallelism)
    held = cut(held.repartition(tasks))
    n, ones = held.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    p = start(seed)
    if ones in (0, n):
        return p
    weights = {1.0: 0.5 / ones, 0.0: 0.5 / (n - ones)}
    names, sizes = list(p), [v.size for v in p.values()]
    m, v = np.zeros(sum(sizes)), np.zeros(sum(sizes))
    for step in range(1, steps + 1):
        def summed(batches: Iterator[pd.DataFrame], p=p) -> Iterator[pd.DataFrame]:
            into = {k: np.zeros_like(x) for k, x in p.items()}
            for pdf in batches:
                for text, y in zip(pdf["text"], pdf["y"]):
                    gradient(p, text, y, weights[y], into)
            yield pd.DataFrame({"g": [np.concatenate([into[k].ravel() for k in p]).tobytes()]})

        g = sum(np.frombuffer(r.g) for r in held.mapInPandas(summed, "g binary").collect())  # a row a task, 32 at most
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        p = {k: p[k] - part.reshape(p[k].shape) for k, part in zip(names, np.split(move, np.cumsum(sizes)[:-1]))}
    return p


def predict(p: dict, rows: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(``keep``, probability, predicted_label) of every row's whole text."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = [score(p, t) for t in pdf["text"]]
            yield pdf[list(keep)].assign(probability=s, predicted_label=[int(x >= 0.5) for x in s])

    kinds = dict(rows.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "probability double, predicted_label int"
    return rows.select(*dict.fromkeys([*keep, "text"])).mapInPandas(scored, schema)

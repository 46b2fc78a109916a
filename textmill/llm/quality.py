"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a text gets the label good or bad.  A line is described by
shares of byte kinds, its length, word length, repetition within the text and
the same figures of the lines beside it; transitions link neighbours.
Forward-backward gives each line's probability of being good, and a document's
quality is their mean weighted by line length.

Training reads at most ``sample`` labelled documents and ``lines`` lines of
them (documented bounds, the smallest crc32 of the id first) outside the
held-out remainder; a document's label holds for all its lines, so what is
maximised is the likelihood of a constant path, for each document a line's
share of it.

Null texts count as empty, an empty text is one empty line, null ids belong to
no fold and are scored as not held out, repeated rows get equal scores, an
empty table gives an empty result, other columns are ignored.  With no
labelled rows of both kinds every score is the share of good labels (1 if
there are none).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_thread, remainder, slices, text_or_empty

_KINDS = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": (9, 11, 12, 13, 32), "bar": (124,), "mark": b"!#$%&*", "stop": b".,;:?", "newline": (10,)}
_KIND = np.full(256, len(_KINDS), np.int64)
for _i, _k in enumerate(_KINDS.values()):
    _KIND[list(_k)] = _i
KINDS = len(_KINDS) + 1
WIDTH = 8
FEATURES = 3 * WIDTH + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[lines, FEATURES], [lines] weights (bytes + 1), [texts] first lines."""
    whole = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
    ends = np.flatnonzero(whole == 10)
    n = len(ends)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    line = np.repeat(np.arange(n), ends - starts + 1)
    counts = np.bincount(line * KINDS + _KIND[whole], minlength=n * KINDS).reshape(n, KINDS).astype(np.float32)
    size = (ends - starts).astype(np.float32)
    words = counts[:, 3] + 1
    first = np.cumsum([0, *(t.count(b"\n") + 1 for t in texts)])[:-1]
    repeated = np.zeros(n, np.float32)
    for at, t in zip(first.tolist(), texts, strict=True):
        lines = t.split(b"\n")
        if len(lines) > 1:
            seen = Counter(lines)
            if len(seen) < len(lines):
                repeated[at : at + len(lines)] = [seen[x] > 1 and len(x) > 0 for x in lines]
    share = counts / np.maximum(size, 1)[:, None]
    own = np.stack([np.log1p(size), share[:, 1], share[:, 2], share[:, 4], share[:, 5], share[:, 6], np.log1p(size / words), repeated], 1)
    last = np.concatenate([first[1:] - 1, [n - 1]]).astype(np.int64) if len(texts) else first
    before, after = np.concatenate([own[:1], own[:-1]]), np.concatenate([own[1:], own[-1:]])
    before[first], after[last] = own[first], own[last]
    return np.concatenate([own, before, after, np.ones((n, 1), np.float32)], 1), size + 1, first


class LineField:
    """Two labels (0 bad, 1 good); emission score of good is x.w, of bad 0."""

    def __init__(self):
        self.mean, self.std = np.zeros(FEATURES), np.ones(FEATURES)
        self.w, self.move, self.prior = np.zeros(FEATURES), np.zeros((2, 2)), 1.0
        self.fitted = False

    def marginals(self, x: np.ndarray, first: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """[lines] probability of good, [2, 2] expected transitions (each as
        often as its line's ``weight``).  All texts take a step together, the
        longest ones last."""
        emit = np.zeros((len(x), 2))
        emit[:, 1] = ((x - self.mean) / self.std) @ self.w
        emit -= emit.max(1, keepdims=True)
        e, a = np.exp(emit), np.exp(self.move - self.move.max())
        length = np.diff([*first, len(x)])
        order = np.argsort(-length, kind="stable")
        begin, length = np.asarray(first)[order], length[order]
        live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
        f, b = np.empty_like(e), np.ones_like(e)
        for t, n in enumerate(live):
            at = begin[:n] + t
            f[at] = e[at] if t == 0 else (f[at - 1] @ a) * e[at]
            f[at] /= f[at].sum(1, keepdims=True)
        moves = np.zeros((2, 2))
        for t in range(len(live) - 1, 0, -1):
            at = begin[: live[t]] + t
            ahead = b[at] * e[at]
            back = ahead @ a.T
            norm = (f[at - 1] * back).sum(1, keepdims=True)
            moves += np.einsum("ni,nj->ij", f[at - 1] / norm if weight is None else f[at - 1] * weight[at][:, None] / norm, ahead) * a
            b[at - 1] = back / back.sum(1, keepdims=True)
        p = f * b
        return p[:, 1] / p.sum(1), moves

    def gradient(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray, ridge: float) -> np.ndarray:
        """Of the mean over texts of a line's share of log p(constant path),
        less ridge / 2 times the weights' squares: [FEATURES + 4]."""
        sizes = np.diff([*first, len(x)])
        per = np.repeat(1.0 / sizes, sizes) / len(sizes)
        p, moves = self.marginals(x, first, per)
        z = (x - self.mean) / self.std
        stay = [((sizes - 1) / sizes)[labels == k].sum() / len(sizes) for k in (0, 1)]
        return np.concatenate([z.T @ ((np.repeat(labels, sizes) - p) * per) - ridge * self.w, (np.diag(stay) - moves).ravel() - ridge * self.move.ravel()])

    def fit(self, docs: list[np.ndarray], labels: list[int], steps: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> LineField:
        if len(set(labels)) < 2:
            self.prior = float(np.mean(labels)) if labels else 1.0
            return self
        x = np.concatenate(docs)
        first = np.cumsum([0, *map(len, docs)])[:-1]
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        self.mean[-1], self.std[-1] = 0, 1
        self.fitted, m, v = True, np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
        for step in range(1, steps + 1):
            grad = self.gradient(x, first, np.array(labels), ridge)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.w += move[:FEATURES]
            self.move += move[FEATURES:].reshape(2, 2)
        return self

    def quality(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if not self.fitted:
            return np.full(len(texts), self.prior)
        x, weight, first = line_features(texts)
        p, _ = self.marginals(x, first)
        return np.clip(np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first), 0, 1)


def fit_lines(docs: DataFrame, labels: DataFrame, sample: int = 3000, label: str = "quality", lines: int = 500_000) -> LineField:
    """A field from at most ``sample`` labelled texts of ``docs`` and ``lines``
    lines of them, by the hash of their ids; a text that would go beyond the
    bound is left out and the next is looked at.  Of the texts of a labelled id
    the one with the least digest is in the sample.  Features are made where
    the texts are, the driver gets figures only."""
    order = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("y")).dropna().filter("y in (0, 1)").distinct().orderBy(order, "doc_id", "y").limit(sample)

    def made(batches):
        for batch in slices(batches, "text"):
            for doc, y, text in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "y", "text")), strict=True):
                x, _, _ = line_features([text])
                yield pa.record_batch({"doc_id": pa.array([doc], pa.int64()), "y": pa.array([y], pa.int32()), "x": pa.array([x.astype("<f4").tobytes()], pa.binary())})

    held = docs.select("doc_id", text_or_empty().cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    held = held.select("doc_id", "y", F.sha2("text", 256).alias("digest"), (F.length(F.regexp_replace(F.col("text").cast("string"), "[^\n]", "")) + 1).alias("n"), "text")
    # the sample's ids, digests and lengths: at most ``sample`` rows
    short = held.filter(F.col("n") <= lines).groupBy("doc_id", "y").agg(F.min(F.struct("digest", "n")).alias("x"))
    fits, total = [], 0
    for r in short.select("doc_id", "y", "x.*").orderBy(order, "doc_id", "y").collect():
        if total + r.n <= lines:
            total += r.n
            fits.append((r.doc_id, r.y, r.digest))
    own = docs.sparkSession.createDataFrame(fits, "doc_id long, y int, digest string")
    picked = held.join(F.broadcast(own), ["doc_id", "y", "digest"]).groupBy("doc_id", "y", "digest").agg(F.first("text").alias("text"))
    rows = sorted(picked.select("doc_id", "y", "text").mapInArrow(made, "doc_id long, y int, x binary").collect(), key=lambda r: (r.doc_id, r.y, bytes(r.x)))
    return LineField().fit([np.frombuffer(r.x, "<f4").reshape(-1, FEATURES) for r in rows], [r.y for r in rows])


def score_quality(docs: DataFrame, model: LineField) -> DataFrame:
    """(doc_id, score double, n_lines long) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        one_thread()
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(shared.value.quality(texts), pa.float64()), "n_lines": pa.array([t.count(b"\n") + 1 for t in texts], pa.int64())})

    return docs.select("doc_id", text_or_empty().cast("binary").alias("text")).mapInArrow(scored, "doc_id long, score double, n_lines long")


def classify_quality(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> DataFrame:
    """Fit outside crc32(doc_id) mod 3 = 1, score every row."""
    model = fit_lines(docs, labels.filter(F.col("doc_id").isNotNull() & (remainder("doc_id", 3) != 1)), sample)
    scored = score_quality(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_lines")

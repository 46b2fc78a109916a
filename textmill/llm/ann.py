"""Approximate nearest neighbours by collision-counting hashing.

Every vector is projected on ``lines`` directions (orthonormal bases drawn at
random, so that the projections of one vector balance one another); each block
of the table keeps one sorted array of projections for each direction (QALSH,
Huang et al. 2015).  A query opens a window around its own projection in every
array and widens all windows step by step (virtual rehashing: the radius grows
by ``grow``, no array is rebuilt).  At radius r a window reaches ``width`` x r
to both sides: a vector at distance r collides on a line with the probability
that |N(0, 1)| < ``width``.  A vector that collides on the share ``hits`` of
the lines is a candidate, and only candidates' distances are computed, exactly.
A query stops when its k-th distance is within the radius that the windows
stand for, or when every vector of the block has been verified.  Collisions
are counted from the arrays' parts outside the windows where those are shorter.

Rows are dealt to blocks in turn, whatever their ids; a block's arrays are
built once, and the queries stream past them, so a task's memory is a block
and a batch of queries.  Each (query, block) gives its k best; the k best of
all blocks follow by rank, where partial ranks cut what is shuffled.

Null vectors, zero vectors and those with null or non-finite components take
no part; so do vectors of another length than the query's.  Equal distances go
to the smaller id, repeated rows count each, a repeated query id is one query
(its smallest vector) and none of its rows is a candidate, fewer than k
candidates are all returned, an empty table gives an empty result, other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import one_thread

LINES, WIDTH, HITS, GROW = 128, 1.5, 0.855, 1.08
BLOCK = 32_768


class SortedLines:
    """One block's projections, sorted on each line."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, lines: int = LINES, seed: int = 5):
        n, d = vectors.shape
        rng = np.random.default_rng(seed)
        bases = [np.linalg.qr(rng.normal(size=(d, d)))[0] * np.sqrt(d) for _ in range(-(-lines // d))]
        self.directions = np.concatenate(bases, 1)[:, :lines]
        at = (vectors @ self.directions).T
        self.ids, self.vectors, self.n = ids, vectors, n
        self.order = np.argsort(at, axis=1, kind="stable").ravel()
        # one ascending array for all lines: line i lies between 4i - 1 and 4i + 1
        self.reach = max(float(np.abs(at).max()), 1e-300)
        self.line = 4.0 * np.arange(at.shape[0])
        self.value = (np.sort(at, axis=1) / self.reach + self.line[:, None]).ravel()
        # the first radius: below most vectors' k-th distance in this block
        some = vectors[rng.permutation(n)[:24]]
        far = np.sqrt(np.maximum((some * some).sum(1)[:, None] + (vectors * vectors).sum(1) - 2 * some @ vectors.T, 0))
        self.radius = 0.85 * float(np.quantile(np.partition(far, min(n - 1, k), axis=1)[:, min(n - 1, k)], 0.1))

    def _bounds(self, centre: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        edge = [np.clip((centre + s * half) / self.reach, -2, 2) + self.line for s in (-1, 1)]
        return np.searchsorted(self.value, edge[0], "left"), np.searchsorted(self.value, edge[1], "right")

    def _tally(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each row stands in the given stretches of the arrays."""
        some = ends > starts
        parts = [self.order[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
        return np.bincount(np.concatenate(parts), minlength=self.n) if parts else np.zeros(self.n, np.int64)

    def search(self, query: np.ndarray, own: int | None, k: int, hits: float = HITS, grow: float = GROW, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and distances of the k best that were verified, and how many
        were; rows with the id ``own`` are left out."""
        lines = len(self.line)
        need = int(np.ceil(hits * lines - 1e-9))
        centre = query @ self.directions
        first = np.arange(lines) * self.n
        last = first + self.n
        taken = self.ids == own if own is not None else np.zeros(self.n, bool)
        left = self.n - int(taken.sum())
        rows, dist = np.zeros(0, np.int64), np.zeros(0)
        radius, count, verified = self.radius, None, 0
        while left:
            low, high = self._bounds(centre, width * radius)
            if count is None:
                if (high - low).sum() * 2 < lines * self.n:
                    count = self._tally(low, high)
                else:
                    count = lines - self._tally(np.concatenate([first, high]), np.concatenate([low, last]))
            else:
                count += self._tally(np.concatenate([low, before[1]]), np.concatenate([before[0], high]))
            before = low, high
            new = np.flatnonzero((count >= need) & ~taken)
            if len(new):
                taken[new] = True
                left -= len(new)
                verified += len(new)
                d = self.vectors[new] - query
                rows, dist = np.concatenate([rows, new]), np.concatenate([dist, np.sqrt((d * d).sum(1))])
                best = np.lexsort((self.ids[rows], dist))[:k]
                rows, dist = rows[best], dist[best]
            if len(rows) >= k and dist[k - 1] <= radius:
                break
            radius = radius * grow if radius > 0 else self.reach / 1e6
        return self.ids[rows], dist, verified


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(key).isNotNull() & F.col(column).isNotNull()).filter(fine).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def _by_width(parts: list[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vector length: (ids, [rows, length])."""
    found: dict[int, list] = {}
    for part in parts:
        v = part.column("v")
        size = v.value_lengths().to_numpy()
        flat, start = v.flatten().to_numpy(), np.cumsum(size) - size
        ids = part.column("id").to_numpy()
        for w in np.unique(size).tolist():
            at = np.flatnonzero(size == w)
            found.setdefault(w, []).append((ids[at], flat[start[at][:, None] + np.arange(w)]))
    return {w: tuple(np.concatenate(x) for x in zip(*got, strict=True)) for w, got in found.items()}


def neighbours(base: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, lines: int = LINES, hits: float = HITS, grow: float = GROW) -> DataFrame:
    """(query_id, rank, vec_id, score, verified) from frames of (id, v), ids of
    queries distinct; ``verified``: distances computed for the query."""
    blocks = max(1, -(-base.count() // block))
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int")
    rows = base.select(turn.alias("block"), F.lit(0).alias("kind"), "id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "v")

    def searched(batches):
        one_thread()
        last, held, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("block").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            turns = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for start, end in zip(turns[:-1], turns[1:], strict=True):
                number, kind = divmod(int(key[start]), 2)
                part = batch.slice(start, end - start)
                if number != last:
                    last, held, index = number, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if index is None:
                    index = {w: SortedLines(ids, v, k, lines) for w, (ids, v) in _by_width(held).items()}
                    held = []
                out = []
                for w, (ids, v) in _by_width([part]).items():
                    for q, x in zip(ids.tolist(), v, strict=True):
                        if w in index:
                            near, dist, verified = index[w].search(x, q, k, hits, grow)
                            out.append((np.full(len(near), q), near, dist, np.full(len(near), verified)))
                if out:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score", "verified"])

    dealt = rows.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind")
    found = dealt.mapInArrow(searched, "query_id long, vec_id long, score double, verified long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")


def search_table(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Queries: ids divisible by ``every``; candidates: all other rows."""
    base = usable(vectors)
    return neighbours(base, base.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), k)

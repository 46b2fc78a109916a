"""Centroid clustering by sort-means, in whole numbers.

Vectors are turned into integers floor(scale * x), so that distances, sums and
centroids are exact and the result depends neither on how the rows are dealt
nor on the order of a sum.  Each round orders, for every centroid, the others
by their distance from it.  A vector starts at the centroid of its previous
assignment, at distance d, and goes through the others in that order: one
that lies strictly beyond 2 d from the start is further from the vector than
the start is (triangle inequality), and so are all after it, so the scan ends.
One at exactly 2 d can tie and is still looked at.  Equal distances go to the
smaller number.  The vectors of a batch with one start are scanned together.

A round's assignments are written to the shared folder and are the next
round's starts, so a lost executor costs its tasks of one round.  The driver
holds the centroids; sums are aggregated by Spark, exactly.

Vectors that are null, of another length, or hold null or non-finite
components take no part; so do those whose integers reach 2^27, as their
distances would not fit a long.  Null ids are clustered like others and come
last among the starting centroids; rows with one hash follow in the order of
their vectors; repeated rows count each.  With fewer vectors than centroids each is a
start.  Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators.storage import spread

from .common import fresh_dir

#: Integers below this keep squared distances of 64 components within a long.
MOST = 1 << 27
STATE = "key long, v array<int>, cluster int"
FOUND = "key long, cluster int, distance long, scanned int"


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", width: int = 64, scale: int = 64) -> DataFrame:
    """(key, v array<int>) of the rows that take part."""
    v = F.col(f"`{column}`").cast("array<double>")
    held = vectors.select(F.col(f"`{key}`").cast("long").alias("key"), v.alias("x")).filter(F.size("x") == width)
    # a null compares as unknown, which forall passes on
    fine = F.coalesce(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST / scale)), F.lit(False))
    return held.filter(fine).select("key", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"))


def starts(kept: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """[k, width]: the vectors of the smallest SHA-256 of ``seed:key``."""
    name = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("key").cast("string")), 256)
    first = kept.select("v", F.when(F.col("key").isNotNull(), name).alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Scan:
    """One round's centroids, with the others of each in order of distance."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.apart = np.stack([_distances(centroids, c) for c in centroids])
        self.order = np.argsort(self.apart, axis=1, kind="stable")

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid of each vector, its squared distance, and how many
        centroids were looked at; ``before``: the previous assignment."""
        cluster = before.astype(np.int32).copy()
        distance = np.zeros(len(x), np.int64)
        scanned = np.ones(len(x), np.int32)
        for start in np.unique(before).tolist():
            rows = np.flatnonzero(before == start)
            own = _distances(x[rows], self.c[start])
            best, which = own.copy(), np.full(len(rows), start, np.int32)
            open_ = np.arange(len(rows))
            for j in self.order[start].tolist():
                if j == start:
                    continue
                # twice the distance is four times its square
                open_ = open_[own[open_] >= -(-int(self.apart[start, j]) // 4)]
                if not len(open_):
                    break
                d = _distances(x[rows[open_]], self.c[j])
                scanned[rows[open_]] += 1
                less = (d < best[open_]) | ((d == best[open_]) & (j < which[open_]))
                at = open_[less]
                best[at], which[at] = d[less], j
            cluster[rows], distance[rows] = which, best
        return cluster, distance, scanned


def _assigned(state: DataFrame, centroids: np.ndarray, last: bool) -> DataFrame:
    """``state`` with this round's clusters in place of the one before; the
    last round's rows have distances and no vectors."""
    def run(batches):
        scan = Scan(centroids)
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.int64)
            cluster, distance, scanned = scan.assign(x, b.column("cluster").to_numpy(zero_copy_only=False))
            rest = {"distance": pa.array(distance), "scanned": pa.array(scanned)}
            yield pa.record_batch({"key": b.column("key"), **({} if last else {"v": v}), "cluster": pa.array(cluster), **(rest if last else {})})

    return state.mapInArrow(run, FOUND if last else STATE)


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means; empty clusters' centroids stay."""
    width = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast("decimal(18,0)")).alias(f"s{i}") for i in range(width)])
    out = centroids.copy()
    for r in sums.collect():  # one row a centroid
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return out


def cluster(spark: SparkSession, vectors: DataFrame, k: int = 16, rounds: int = 3, key: str = "vec_id", column: str = "embedding", width: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance, scanned) after ``rounds`` rounds and a last
    assignment, and the centroids it went by."""
    at = fresh_dir(spark, "sortmeans")

    def held(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    rows = spread(vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("v")))
    state = held(usable(rows, "key", "v", width, scale).withColumn("cluster", F.lit(0)), "0")
    centroids = starts(state, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], FOUND), centroids
    for i in range(1, rounds + 1):
        state = held(_assigned(state, centroids, False), str(i))
        centroids = _moved(state, centroids)
    return held(_assigned(state, centroids, True), "last"), centroids


def report(spark: SparkSession, vectors: DataFrame, k: int = 16, rounds: int = 3, key: str = "vec_id", **kw) -> DataFrame:
    """A row for each vector: its cluster, squared distance, the sums of these
    over its cluster and over all, its centroid's digest, and ``scanned``, the
    distances computed for it in the last round."""
    found, centroids = cluster(spark, vectors, k, rounds, key, **kw)
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = F.array(*[F.struct(F.lit(sums.get(i, 0)).cast("long").alias("inertia"), F.lit(h).alias("sha")) for i, h in enumerate(digest)]) if digest else F.array(F.struct(F.lit(0).cast("long").alias("inertia"), F.lit("").alias("sha")))
    own = F.element_at(of, F.col("cluster") + 1)
    return found.select(F.col("key").alias(key), "cluster", "distance", own["inertia"].alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), own["sha"].alias("centroid_sha256"), F.col("scanned").cast("long").alias("scanned"))


def oracle_sql(k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The columns of the contract as one DuckDB statement, every vector
    against every centroid."""
    far = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, min({{'d': {far}, 'c': c.c}}) AS m FROM v, c{i} c GROUP BY r, vec_id)")
        if i < rounds:
            parts.append(f"e{i} AS (SELECT c, j, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i} JOIN v USING (r)) GROUP BY c, j)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) FILTER (j IS NOT NULL), any_value(c.v)) AS v FROM c{i} c LEFT JOIN e{i} e ON e.c = c.c GROUP BY c.c)")
    last = f"a{rounds}"
    return f"""WITH {', '.join(parts)} SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} c ON c.c = m.c"""

"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source has a target number of words: its weight's share of all words, at
most ``cap`` times what it has, the excess reshared by weight.  Sources and
their shards (documents dealt by a hash of their id, so that a hot source is
many shards) are cut into blocks of ``block`` words.  Whole blocks are
allocated by the highest quotients weight / (2 s + 1): first to sources, then
within a source to its shards.  A shard's quota q of n blocks takes every
block q // n times and q mod n of them once more, chosen by a seeded affine
permutation.  So no document is taken more than ``cap`` times.

Documents are laid end to end in a shard in the order of a hash of their id;
only (id, size) is shuffled.  The driver sees one row for each source and for
each shard, at most ``SHARDS`` a source; the plan is broadcast up to
``BROADCAST`` such rows and joined like any table beyond.  Blocks are equally
long, whatever the sources; only a source of less than 16 blocks is cut finer,
by itself, and gets the seats that its target rounds to (those of the same
rule at a divisor of its own block).

Null texts and empty ones have no words and take none; null sources are one
source, the last by order; repeated rows are rows of their own, in a fixed
order; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, takes_over

WEIGHTS = (5.0, 2.0, 1.0)
#: Shards of a source at most; documents that a shard is planned for.
SHARDS, SHARD_DOCS = 4096, 2000
#: Words of a block; rows of the plan that are broadcast at most.
BLOCK, BROADCAST = 32, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Words for each source: weights' shares of the whole, none above ``cap``
    times its size; what that leaves goes to the others by weight."""
    out, free = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = float(sum(sizes))
    while free:
        per = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * per >= cap * sizes[i]]
        if not full:
            for i in free:
                out[i] = weights[i] * per
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def apportion(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients w / (2 s + 1), none above ``most``.

    The seats of a divisor d are floor(w / d + 1/2); d is bracketed by halving
    until all but a few seats are fixed, and those are given one at a time by
    the next highest quotient, ties to the first.
    """
    w, most = np.asarray(weights, float), np.asarray(most, np.int64)
    most = np.where(w > 0, most, 0)
    seats = int(min(seats, most.sum()))
    if seats <= 0:
        return np.zeros(len(w), np.int64)
    given = lambda d: np.minimum(np.floor(w / d + 0.5), most).astype(np.int64)
    low, high = w[w > 0].min() / (4 * float(most.max()) + 4), 4 * w.max()  # at low all, at high none
    for _ in range(200):
        mid = math.sqrt(low * high)
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
        if high / low < 1 + 1e-15:
            break
    out = given(high)
    for _ in range(seats - int(out.sum())):
        out[int(np.argmax(np.where(out < most, w / (2 * out + 1), -1)))] += 1
    return out


def _step(n: int, seed: int) -> tuple[int, int]:
    """Multiplier prime to n, and offset, of the order in which blocks are
    chosen."""
    a = (seed * 2654435761 + 40503) % n if n > 1 else 1
    a = max(a, 1)
    while math.gcd(a, n) != 1:
        a += 1
    return a, (seed * 97 + 13) % n


def plan(docs: DataFrame, block: int = BLOCK, cap: float = 3.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 1) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, size, source,
    source_size, target, taken, whole (times that all of it is taken) and
    parts, the [start, end) words taken once more."""
    spark = docs.sparkSession
    sized = cut(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    per = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    sources = sorted(((r.source, r.size, r.n) for r in per.collect()), key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be", "replace")))
    goal = targets([s for _, s, _ in sources], [weights[i % len(weights)] for i in range(len(sources))], cap)
    table = [(i, name, size, float(t), max(1, min(SHARDS, -(-n // SHARD_DOCS)))) for i, ((name, size, n), t) in enumerate(zip(sources, goal, strict=True))]
    about = _local(spark, table, "source_no long, source string, source_size long, target double, shards long")
    own = sized.join(_small(about, len(table)), sized.source.eqNullSafe(about.source)).drop(about.source)
    mixed = F.xxhash64(F.lit(seed), "doc_id", "size")
    own = own.withColumn("shard", F.pmod(mixed, F.col("shards")))
    shards = sorted((r.source_no, r.shard, r.size) for r in own.groupBy("source_no", "shard").agg(F.sum("size").alias("size")).collect())
    quotas = _quotas(table, shards, block, cap, seed)
    chosen = _local(spark, quotas, "source_no long, shard long, length long, n long, whole long, more long, a long, b long")
    # running words within (source, shard): a shard's rows only are in a task
    from pyspark.sql import Window

    before = F.sum("size").over(Window.partitionBy("source_no", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    laid = own.withColumn("at", F.coalesce(before, F.lit(0))).join(_small(chosen, len(quotas)), ["source_no", "shard"])
    # blocks that the document touches, and of them those chosen
    picked = F.expr("filter(sequence(at div block, (at + size - 1) div block), j -> pmod(cast(j as decimal(38, 0)) * a + b, n) < more)".replace("block", "length"))
    spans = F.expr("transform(_j, j -> named_struct('start', greatest(j * length, at) - at, 'end', least((j + 1) * length, at + size) - at))")
    out = laid.withColumn("_j", F.when((F.col("size") > 0) & (F.col("more") > 0), picked).otherwise(F.expr("cast(array() as array<long>)"))).withColumn("parts", spans)
    extra = F.expr("aggregate(parts, 0L, (t, x) -> t + x.end - x.start)")
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("whole") + extra).alias("taken"), "whole", "parts")


def _local(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST else df


def _quotas(table: list[tuple], shards: list[tuple], length: int, cap: float, seed: int) -> list[tuple]:
    own_length = [max(1, min(length, t[2] // 16)) for t in table]
    blocks = [-(-t[2] // n) for t, n in zip(table, own_length, strict=True)]
    most = [math.floor(cap * n) for n in blocks]
    seats = [min(m, math.floor(t[3] / n + 0.5)) for t, n, m in zip(table, own_length, most, strict=True)]
    whole = [i for i, n in enumerate(own_length) if n == length]
    if whole:
        goal = np.array([table[i][3] for i in whole])
        for i, q in zip(whole, apportion(goal, round(goal.sum() / length), np.array([most[i] for i in whole])).tolist(), strict=True):
            seats[i] = q
    held: dict[int, list[tuple]] = {}
    for shard in shards:
        held.setdefault(shard[0], []).append(shard)
    out = []
    for t, q, length in zip(table, seats, own_length, strict=True):
        own = held.get(t[0], [])
        n = np.array([-(-s[2] // length) for s in own], np.int64)
        for (no, shard, _), n_s, q_s in zip(own, n.tolist(), apportion(np.array([s[2] for s in own], float), int(q), (cap * n).astype(np.int64)).tolist(), strict=True):
            a, b = _step(max(1, n_s), seed + shard * 131 + no * 7919)
            out.append((no, shard, length, max(1, n_s), q_s // max(1, n_s), q_s % max(1, n_s), a, b))
    return out


def mixed_documents(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time that
    all of a document is taken, and one with the words taken once more, cut
    from the text at word bounds.  n_chars (if there) is counted anew."""
    import re

    word = re.compile(WORD)
    from pyspark.sql import Window

    # a plan fits every text of its size: rows that agree in id, source and
    # size take theirs one by one.  A row is packed, so that its columns' names
    # meet no others
    keys = ["_d", "_dn", "_s", "_sn", "_size", "_no"]

    def numbered(df, size, order):
        df = df.withColumns({"_d": F.coalesce("doc_id", F.lit(0)), "_dn": F.col("doc_id").isNull(), "_s": F.coalesce("source", F.lit("")), "_sn": F.col("source").isNull(), "_size": size})
        return df.withColumn("_no", F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy(*order)))

    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), "doc_id", "source", "text")
    rows = numbered(packed, words, [F.xxhash64("text"), "text"])
    own = numbered(planned, F.col("size"), ["whole", "parts"]).filter("whole > 0 or size(parts) > 0")
    own = own.select(*keys, "whole", F.expr("transform(parts, x -> x.start)").alias("from"), F.expr("transform(parts, x -> x.end)").alias("to"))
    joined = rows.join(own, keys).select("row", "text", "whole", "from", "to")
    schema = docs.schema
    names = docs.columns
    where = names.index("text")

    def made(batches):
        takes_over("mixing")
        for batch in slices(batches, "text"):
            take, texts = [], []
            rows = zip(*(batch.column(k).to_pylist() for k in ("text", "whole", "from", "to")), strict=True)
            for i, (text, whole, start, end) in enumerate(rows):
                take += [i] * whole
                texts += [text] * whole
                if start:
                    at = [m.span() for m in word.finditer(text)]
                    take.append(i)
                    texts.append(" ".join(text[at[a][0] : at[b - 1][1]] for a, b in zip(start, end, strict=True)))
            if not take:
                continue
            row = batch.column("row").take(pa.array(take))
            columns = row.flatten()
            columns[where] = pa.array(texts, columns[where].type)
            if "n_chars" in names:
                at = names.index("n_chars")
                columns[at] = pa.array([len(t or "") for t in texts], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(made, schema)

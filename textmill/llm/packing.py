"""Best-fit packing planned over a histogram of lengths.

A document's ids (with the end id) are cut into pieces of at most ``most``;
only longer documents are cut.  The driver plans with counts of lengths, not
with documents: lengths from the longest down, each placed where the least
room is left that holds it (best fit, decreasing).  Bins with equal room are
one entry, so the plan has a few entries for each length whatever the number
of documents.  Pieces then take the planned slots by their rank within their
length.  Ranks are counted within (length, salt), with as many salts for a
length as its pieces need, so that a frequent length is many tasks; the salts'
counts give each its first rank.

Null and empty texts are the end id alone; repeated rows are packed each; an
empty table gives an empty result.  Pieces of a document may lie in different
sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, text_or_empty
from .vocab import encoder, with_end

MOST, END_ID = 2048, 0
#: Pieces of one length that a task ranks at least, and the most tasks.
RANKED, PARTS = 1000, 16_384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan_counts(counts: dict[int, int], most: int = MOST) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, items, first sequence, items a sequence, offset):
    the item of rank first + t goes to sequence first_sequence + t // per at
    offset + (t % per) * length."""
    out = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left: [(first sequence, sequences)]
    sizes: list[int] = []  # the rooms that there are, ascending
    following = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in rooms:
                rooms[room] = []
                insort(sizes, room)
            rooms[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect_left(sizes, length)
            if i < len(sizes):
                room = sizes[i]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    sizes.pop(i)
            else:
                room = most
                first, n = following, -(-left // (most // length))
                following += n
            per = room // length
            full = min(n, left // per)
            if full:
                out.append((length, rank, full * per, first, per, most - room))
                put(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left:  # fewer than ``per`` items are left
                out.append((length, rank, left, first + full, left, most - room))
                put(room - left * length, first + full, 1)
                put(room, first + full + 1, n - full - 1)
                left = 0
            else:
                put(room, first + full, n - full)
    return out


def pieces(docs: DataFrame, vocabulary: str, most: int = MOST, end_id: int = END_ID) -> DataFrame:
    """PIECES of every row of ``docs`` (doc_id, text)."""
    def made(batches):
        encode = encoder(vocabulary).encode_column
        for batch in slices(batches, "text", 2 << 20):
            ids, offsets = with_end(*encode(batch.column("text")), end_id)
            n = np.diff(offsets)
            cuts = -(-n // most)
            row = np.repeat(np.arange(len(n)), cuts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * most
            length = np.minimum(n[row] - start, most)
            data = np.ascontiguousarray(ids.astype("<u4"))
            first = offsets[row] + start
            crc = [zlib.crc32(data[a : a + m]) for a, m in zip(first.tolist(), length.tolist(), strict=True)]
            yield pa.record_batch({"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64())})

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(made, PIECES)


def pack(cut_pieces: DataFrame, most: int = MOST, ranked: int = RANKED) -> DataFrame:
    """PIECES with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    # at most ``most`` rows, and below ``most`` + PARTS salts
    counts = {r.length: r.n for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    share = max(ranked, -(-sum(counts.values()) // PARTS))
    salts = {k: -(-n // share) for k, n in counts.items()}
    dealt = F.broadcast(spark.createDataFrame(list(salts.items()), "length long, salts long"))
    salted = cut_pieces.join(dealt, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), "salts"))
    found = sorted((r.length, r.salt, r.n) for r in salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect())
    before: dict[int, int] = {}
    bases: dict[int, list[int]] = {k: [0] * n for k, n in salts.items()}
    for length, salt, n in found:
        bases[length][int(salt)] = before.get(length, 0)
        before[length] = before.get(length, 0) + n
    slots: dict[int, list[tuple]] = {}
    for length, *entry in plan_counts(counts, most):
        slots.setdefault(length, []).append(tuple(entry))
    table = spark.createDataFrame([(k, bases[k], v) for k, v in slots.items()], "length long, base array<long>, slots array<struct<rank:long,n:long,sequence:long,per:long,offset:long>>")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    placed = salted.withColumn("_r", rank - 1).join(F.broadcast(table), "length").withColumn("_r", F.col("_r") + F.expr("base[cast(salt as int)]"))
    placed = placed.withColumn("_s", F.expr("filter(slots, s -> _r >= s.rank and _r < s.rank + s.n)[0]")).withColumn("_t", F.expr("_r - _s.rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("_s.sequence + _t div _s.per").alias("sequence_id"), F.expr("_s.offset + _t % _s.per * length").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, most: int = MOST, end_id: int = END_ID) -> DataFrame:
    """Tokenises every row once and packs its pieces."""
    return pack(cut(pieces(docs, vocabulary, most, end_id)), most)

"""Near-duplicates by Order MinHash and banded alignment.

A text is the sequence of its five-word shingles (words cut at white space,
lower-cased), each labelled with its occurrence number, so that labels are
unique in a text.  Each of ``sketches`` sketches takes the ``length`` labels
that hash lowest and keeps them in text order (Marçais et al. 2019): two texts
agree on a sketch only if they share those labels in the same order.  Texts
with a sketch in common become candidates; two texts are near-duplicates if
the alignment of their label sequences, within the band that the threshold
leaves, matches m labels with m / (a + b - m) >= 0.8.  Labels being unique,
the best alignment is the longest increasing run of matched positions.

Nothing is dropped or capped:

* exact copies (equal words) are folded into one representative first;
* a sketch's bucket yields a star and not all pairs: texts whose 64-slot
  signatures agree within five standard deviations of the threshold, or the
  smaller of which has few labels, are joined
  to a root; the texts of a bucket above ``piece`` texts are all joined;
* the candidate groups that result are verified by alignment, where texts that
  are linked already need no further alignment.  Groups above ``piece`` texts
  or ``PIECE_LABELS`` labels are verified in salted pieces in ``rounds`` rounds
  with other salts; after them, every pair that shares a label of its prefixes
  (the rarest labels) and isn't linked yet is aligned, so that no pair depends
  on the salts.

Texts are told apart by a digest of their words and numbered, so that repeated
and null ids are rows like others: a row's class depends on its text alone.
Null texts count as empty; texts below five words are one shingle (all empty
texts are one class); the class is the smallest id in it, and a negative number
made from its digest if no row of it has an id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, by_group, components, cut, slices, takes_over, text_or_empty

WORDS, THRESHOLD = 5, 0.8
SLOTS = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Word hashes by a bounded per-process table."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            out = []
            for w in words:
                h = known.get(w)
                if h is None:
                    h = xxhash.xxh64_intdigest(w)
                    if len(known) < self.limit:
                        known[w] = h
                out.append(h)
            return np.array(out, np.uint64)


_HASH = Hasher()
KEPT["neardup"] = _HASH.known.clear


def split_words(text: str) -> list[bytes]:
    return (text.lower().encode("utf-8", "replace") if not text.isascii() else text.encode().lower()).split()


def labels(words: list[bytes]) -> np.ndarray:
    """Occurrence-labelled shingles in text order, 64-bit, unique."""
    h = _HASH(words)
    n = max(1, len(h) - WORDS + 1)
    s = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(h))):
        s = s * np.uint64(0x100000001B3) + h[i : i + n] * _ODD
    s = _mixed(s + np.uint64(len(h) < WORDS))
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not new.all():
        at = np.arange(n)
        occurrence = np.empty(n, np.uint64)
        occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        s = np.where(occurrence > 0, _mixed(s + occurrence * _ODD), s)
    return s


def sketches(s: np.ndarray, count: int, length: int) -> np.ndarray:
    """[count] sketch keys: the ``length`` lowest labels, in text order."""
    out = np.empty(count, np.int64)
    k = min(length, len(s))
    for i in range(count):
        h = (s ^ _SEEDS[i]) * _SEEDS[i + 24]
        h ^= h >> np.uint64(29)
        low = np.argpartition(h, k - 1)[:k] if k < len(h) else np.arange(len(h))
        key = np.uint64(i + 1)
        for v in s[np.sort(low)].tolist():
            key = np.uint64((int(key) * 0x100000001B3 + v) & 0xFFFFFFFFFFFFFFFF)
        out[i] = key.astype(np.int64)
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """[SLOTS] one-permutation minima of 32 bits, empty slots borrowed."""
    h = _mixed(s + np.uint64(0x5851F42D4C957F2D))
    slot = (h >> np.uint64(58)).astype(np.int64)
    out = np.full(SLOTS, 2**32 - 1, np.uint64)
    np.minimum.at(out, slot, h & np.uint64(0xFFFFFFFE) & np.uint64(0xFFFFFFFF))
    filled = np.flatnonzero(out != 2**32 - 1)
    if len(filled) < SLOTS:
        ahead = filled[np.searchsorted(filled, np.arange(SLOTS)) % len(filled)]
        out = np.where(out != 2**32 - 1, out, out[ahead])
    return out.astype(np.uint32)


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """m / (len(a) + len(b) - m) for the best alignment inside the band that
    the threshold allows; 0 as soon as it can't be reached."""
    n = len(a) + len(b)
    least = int(np.ceil(threshold * n / (1 + threshold) - 1e-9))
    if min(len(a), len(b)) < least:
        return 0.0
    band = n - 2 * least
    order = np.argsort(b, kind="stable")
    at = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    place = order[at]
    hit = (b[place] == a) & (np.abs(place - np.arange(len(a))) <= band)
    place = place[hit]
    if len(place) < least:
        return 0.0
    if (np.diff(place) > 0).all():
        m = len(place)
    else:
        tails: list[int] = []
        for p in place.tolist():
            i = bisect_left(tails, p)
            if i == len(tails):
                tails.append(p)
            else:
                tails[i] = p
        m = len(tails)
    return m / (n - m)


def describe(docs: DataFrame, count: int, length: int) -> DataFrame:
    """(doc_id, exact, key, size, sketch array, sig): one row for each
    document; exact and key are digests of the text and of its words."""
    def described(batches):
        takes_over("neardup")
        for batch in slices(batches, "text"):
            key, size, sketch, sig = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = split_words(text)
                s = labels(words)
                key.append(xxhash.xxh3_128_digest(b" ".join(words)))
                size.append(len(s))
                sketch.append(sketches(s, count, length).tolist())
                sig.append(signature(s).tobytes())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "exact": batch.column("exact"), "key": pa.array(key, pa.binary()), "size": pa.array(size, pa.int64()), "sketch": pa.array(sketch, pa.list_(pa.int64())), "sig": pa.array(sig, pa.binary())})

    return docs.select("doc_id", exact_text().alias("exact"), text_or_empty().alias("text")).mapInArrow(described, "doc_id long, exact string, key binary, size long, sketch array<long>, sig binary")


def exact_text():
    return F.md5(text_or_empty().cast("binary"))


#: Slots that a pair of similarity 0.8 agrees on in all but 3 of 10^6 cases;
#: below ``FEW`` labels borrowed slots hang together and decide nothing.
LIKELY_SLOTS, FEW = 34, 128


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SLOTS)


def _stars(rows: pa.RecordBatch) -> list[tuple[int, int]]:
    """Within one bucket's piece: links of a text to one earlier text of each
    group that it is likely near to."""
    ids, size = rows.column("doc_id").to_numpy(), rows.column("size").to_numpy()
    order = np.lexsort((ids, size))
    ids, size, sig = ids[order], size[order], _signatures(rows.column("sig"))[order]
    root, out = np.arange(len(ids)), []
    for j in range(1, len(ids)):
        # by size, so that the earlier text is the smaller one
        first = int(np.searchsorted(size[:j], (THRESHOLD - 1e-9) * size[j]))
        likely = (size[first:j] < FEW) | ((sig[first:j] == sig[j]).sum(1) >= LIKELY_SLOTS)
        near = first + np.flatnonzero(likely)
        if len(near):
            found = np.unique(root[near])
            out += [(int(ids[j]), int(ids[r])) for r in found]
            root[j] = found[0]
            if len(found) > 1:
                root[np.isin(root, found)] = found[0]
    return out


def candidate_links(texts: DataFrame, piece: int) -> DataFrame:
    """(a, b) between representatives that share a sketch and look alike; all
    of a bucket above ``piece`` texts is linked, and left to verification."""
    flat = texts.select("doc_id", F.posexplode("sketch").alias("i", "sk"))
    crowded = flat.groupBy("i", "sk").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).filter("n > 1")
    held = flat.join(crowded, ["i", "sk"])
    small = held.filter(F.col("n") <= piece).select("i", "sk", "doc_id").join(texts.select("doc_id", "size", "sig"), "doc_id")
    large = held.filter((F.col("n") > piece) & (F.col("doc_id") != F.col("low"))).select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    return by_group(small, ["i", "sk"], _stars).unionByName(large.distinct())


def _verified(ids: np.ndarray, seqs: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links by alignment among a piece's texts; texts that are linked already
    need no further one, nor do those with too few labels in common."""
    root, out = np.arange(len(ids)), []
    size = np.array([len(s) for s in seqs])
    start = np.concatenate([[0], np.cumsum(size)])
    names, number = np.unique(np.concatenate(seqs), return_inverse=True)
    number, held = number.astype(np.int32), np.zeros(len(names), bool)
    for j in range(1, len(ids)):
        own = number[start[j] : start[j + 1]]
        held[own] = True
        shared = np.add.reduceat(held[number[: start[j]]], start[:j], dtype=np.int64)
        held[own] = False
        near = np.flatnonzero(shared >= (THRESHOLD - 1e-9) * (size[:j] + size[j] - shared))
        todo = near[np.argsort(-shared[near], kind="stable")]
        while len(todo):
            i, todo = int(todo[0]), todo[1:]
            if aligned(seqs[i], seqs[j]) >= THRESHOLD:
                out.append((int(ids[j]), int(ids[i])))
                root[root == root[j]] = root[i]
                todo = todo[root[todo] != root[j]]
    return out


def _aligned_links(rows: pa.RecordBatch) -> list[tuple[int, int]]:
    ids, first = np.unique(rows.column("doc_id").to_numpy(), return_index=True)
    words = rows.column("words")
    return _verified(ids, [labels(words[i].as_py().split(b" ")) for i in first.tolist()]) if len(ids) > 1 else []


#: Labels of a piece at most, about: some 200 MB of texts and labels.
PIECE_LABELS = 2_000_000


def _large(groups: DataFrame, piece: int) -> DataFrame:
    """(root, n, pieces) of the groups that one piece doesn't hold."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("_l"))
    pieces = F.greatest(F.ceil(F.col("n") / piece), F.ceil(F.col("_l") / PIECE_LABELS))
    return sizes.select("root", "n", F.least(pieces, "n").alias("pieces")).filter("pieces > 1")


def verified_links(groups: DataFrame, words: DataFrame, piece: int, pivots: int, rounds: int, salts: int = 32) -> DataFrame:
    """(a, b): aligned links within groups (doc_id, root, size), by the texts'
    (doc_id, words binary)."""
    # a large group is many rows: they meet its size by salt
    large = _large(groups, piece).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sized = groups.select("doc_id", "root", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("_s")).join(large, ["root", "_s"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1).cast("long")))
    sized = sized.withColumn("turn", F.explode(F.expr(f"if(pieces = 1, array(0), sequence(0, {rounds - 1}))")))
    salt = F.pmod(F.xxhash64("doc_id", "turn"), F.col("pieces"))
    pivot = (F.col("pieces") > 1) & ((F.col("doc_id") == F.col("root")) | (F.pmod(F.xxhash64(F.lit("p"), "doc_id", "turn"), F.col("n")) < pivots))
    dealt = sized.withColumn("salt", F.explode(F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).otherwise(F.array(salt))))
    return by_group(dealt.select("doc_id", "root", "turn", "salt").join(words, "doc_id"), ["root", "turn", "salt"], _aligned_links)


def classes(docs: DataFrame, count: int = 12, length: int = 3, piece: int = 1024, pivots: int = 8, rounds: int = 2) -> DataFrame:
    """(doc_id, exact, key, text_id, class_id, class_key): a row for each row
    of ``docs``; class_key is the smallest digest of the class."""
    described = cut(describe(docs, count, length))
    folded = described.groupBy("key").agg(F.min("doc_id").alias("text_id"), F.first(F.struct("size", "sketch", "sig")).alias("x"))
    # distinct texts by a number of their own; fixed, as they are written
    texts = cut(folded.select("key", "text_id", F.monotonically_increasing_id().alias("doc_id"), "x.*"))
    loose = components(candidate_links(texts, piece))
    grouped = loose.unionByName(loose.select(F.col("root").alias("id"), "root").distinct()).withColumnRenamed("id", "doc_id")
    groups = cut(grouped.join(texts.select("doc_id", "key", "size"), "doc_id"))

    def packed(batches):
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            cut_ = [split_words(t) for t in texts]
            yield pa.record_batch({"key": pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in cut_], pa.binary()), "words": pa.array([b" ".join(w) for w in cut_], pa.binary())})

    # the texts that take part, once: every level below reads them again
    own = described.join(groups.select("key"), "key", "left_semi").groupBy("key").agg(F.min(F.struct("doc_id", "exact")).alias("x")).select(F.col("x.doc_id").alias("_d"), F.col("x.exact").alias("_e"))
    rows = docs.select("doc_id", exact_text().alias("exact"), text_or_empty().alias("text"))
    members = rows.join(own, (rows["exact"] == own["_e"]) & rows["doc_id"].eqNullSafe(own["_d"]), "left_semi").select("text")
    once_each = members.mapInArrow(packed, "key binary, words binary").groupBy("key").agg(F.first("words").alias("words"))
    words = cut(once_each.join(groups.select("key", "doc_id"), "key").select("doc_id", "words"))
    links = cut(verified_links(groups, words, piece, pivots, rounds))
    roots = components(_across_pieces(groups, words, links, piece)).withColumnRenamed("id", "doc_id")
    of_text = cut(texts.select("doc_id", "key", "text_id").join(roots, "doc_id", "left").select("key", "text_id", F.coalesce("root", "doc_id").alias("root")))
    # a class's smallest id and digest: partial minima, then a join back
    least = of_text.groupBy("root").agg(F.min("text_id").alias("_id"), F.min("key").alias("class_key"))
    unnamed = -1 - F.pmod(F.xxhash64("class_key"), F.lit(2**62))
    named = of_text.join(least, "root").select("key", "class_key", F.coalesce("_id", unnamed).alias("class_id"), F.coalesce("text_id", "_id", unnamed).alias("text_id"))
    return described.select("doc_id", "exact", "key").join(named, "key")


def near_duplicates(docs: DataFrame, count: int = 12, length: int = 3, piece: int = 1024, pivots: int = 8, rounds: int = 2) -> DataFrame:
    """(doc_id, class_id, text_id): every row's class, and its exact text's
    smallest id.  A class of one text has that text's id."""
    return classes(docs, count, length, piece, pivots, rounds).select("doc_id", "class_id", "text_id")


def representatives(docs: DataFrame, **how) -> DataFrame:
    """One row of ``docs`` for each class, all columns: the smallest id's (rows
    without an id last; equal ids by the text's digest, equal texts by the
    other columns)."""
    of = classes(docs, **how)
    last = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("exact").alias("c"))
    keep = of.groupBy("class_key").agg(F.min(last).alias("_x")).select(F.col("_x.b").alias("_b"), F.col("_x.c").alias("_c"))
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(row.alias("_row"), F.col("doc_id").alias("_b2"), exact_text().alias("_c"))
    # a class's row: the least of those that agree in id and text
    found = rows.join(keep, (rows["_c"] == keep["_c"]) & rows["_b2"].eqNullSafe(keep["_b"]), "left_semi")
    least = F.first if "map<" in docs.schema.simpleString() else F.min
    return found.groupBy("_c", "_b2").agg(least("_row").alias("_row")).select("_row.*")


#: Bins of the table of label frequencies; labels that share one are only
#: ordered worse.
BINS = 1 << 18


def _prefix(s: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The labels, rarest first, that a text shares at least one of with every
    text it reaches the threshold with: all but ceil(0.8 n) - 1 of n, in an
    order that is the same for all texts."""
    n = len(s)
    keep = n - int(np.ceil(THRESHOLD * n - 1e-9)) + 1
    return s[np.lexsort((s, often[(s & np.uint64(BINS - 1)).astype(np.int64)]))][:keep]


def _across_pieces(groups: DataFrame, words: DataFrame, links: DataFrame, piece: int) -> DataFrame:
    """Adds the links of groups above ``piece`` texts that no piece has shown.
    Of two texts in different components of ``links``, a pair must share a
    label in the prefixes of both (Xiao et al. 2011: the smaller text's up to
    n - ceil(2 t / (1 + t) n) + 1 labels, and enough labels after it); every
    such pair is aligned."""
    large = _large(groups, piece).select("root")
    if large.isEmpty():
        return links
    found = components(links).select(F.col("id").alias("doc_id"), F.col("root").alias("part"))
    own = groups.select("doc_id", "root").join(large, "root").join(found, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    several = own.groupBy("root").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("root")
    own = cut(own.join(several, "root").join(words, "doc_id"))

    def binned(batches):
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for w in batch.column("words"):
                total += np.bincount((labels(w.as_py().split(b" ")) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.record_batch({"bin": pa.array(at), "n": pa.array(total[at])})

    often = np.zeros(BINS, np.int64)
    for r in own.select("words").mapInArrow(binned, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        often[r.bin] = r.n
    shared = own.sparkSession.sparkContext.broadcast(often)

    def prefixes(batches):
        for batch in slices(batches, "words"):
            out = []
            for i, w in enumerate(batch.column("words")):
                s = labels(w.as_py().split(b" "))
                p = _prefix(s, shared.value).view(np.int64)
                out.append((np.full(len(p), i), p, np.arange(len(p)), np.full(len(p), len(s))))
            row, label, place, size = (np.concatenate(x) for x in zip(*out, strict=True))
            of = batch.select(["root", "part", "doc_id"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*of.columns, pa.array(label), pa.array(place), pa.array(size)], ["root", "part", "doc_id", "label", "place", "size"])

    rows = cut(own.mapInArrow(prefixes, "root long, part long, doc_id long, label long, place long, size long"))
    crowded = rows.groupBy("root", "label").agg(F.count("*").alias("n"), F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("root", "label", F.ceil(F.col("n") / piece).alias("pieces"))
    rows = rows.join(crowded, ["root", "label"])
    # a crowded label's pairs: every block of the smaller texts against all
    names = ("part", "doc_id", "place", "size")
    least = f"ceil({2 * THRESHOLD / (1 + THRESHOLD)!r} * size - 1e-9)"
    a = rows.filter(F.expr(f"place <= size - {least}")).select("root", "label", F.pmod(F.xxhash64("doc_id"), "pieces").alias("salt"), *[F.col(k).alias(f"{k}_a") for k in names])
    b = rows.select("root", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("salt"), *[F.col(k).alias(f"{k}_b") for k in names])
    need = F.expr(f"ceil({THRESHOLD / (1 + THRESHOLD)!r} * (size_a + size_b) - 1e-9)")
    reach = 1 + F.least(F.expr("size_a - place_a - 1"), F.expr("size_b - place_b - 1"))
    near = (F.col("part_a") != F.col("part_b")) & F.expr("size_a <= size_b") & (reach >= need)
    pairs = a.join(b, ["root", "label", "salt"]).filter(near).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()

    def kept(batches):
        for batch in slices(batches, "words_b"):
            hit = [aligned(labels(x.as_py().split(b" ")), labels(y.as_py().split(b" "))) >= THRESHOLD for x, y in zip(batch.column("words_a"), batch.column("words_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    of = [words.select(F.col("doc_id").alias(k), F.col("words").alias(f"words_{k}")) for k in ("a", "b")]
    more = pairs.join(of[0], "a").join(of[1], "b").select("a", "b", "words_a", "words_b").mapInArrow(kept, "a long, b long")
    return cut(links.unionByName(more))

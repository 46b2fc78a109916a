"""Near-duplicates of short texts: word bigrams, Jaccard >= 0.65.

``exact_pairs`` finds all pairs by an inverted index over prefixes: with a
text's shingles in a fixed order, two texts of similarity t share one of the
first n - ceil(t n) + 1.  Rare shingles come first, so that frequent ones are
hardly ever in a prefix.  ``minhash`` and ``lsh_candidates`` are the sketched
form.  Texts are distinct: copies are folded before and mapped back after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.keys import alnum_key
from textmill.operators.storage import cut, once

#: Modulus and multipliers of the 64 hash functions.
PRIME = 2**31 - 1
SLOTS, BANDS = 64, 16


def coefficients(i: int) -> tuple[int, int]:
    """a and b of hash i, by rule."""
    return 1 + (i * 40_503 + 12_345) % 65_521, (i * 69_069 + 1) % 1_000_003


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the smallest id of each text."""
    got = docs.groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.min_by("text", "doc_id").alias("text"))
    return got.select("doc_id", "text")


def with_shingles(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``shingles``: distinct word bigrams in lower case; the text
    without white space around it if it has one word; none below four characters."""
    words = f"filter(split(lower({text}), '(?U)[\\\\s\\\\x1c-\\\\x1f]+'), w -> w <> '')"
    df = once(docs, _w=F.expr(words))
    pairs = F.expr("array_distinct(transform(sequence(1, size(_w) - 1), i -> concat(_w[i - 1], ' ', _w[i])))")
    none = F.expr("cast(array() as array<string>)")
    return once(df, shingles=F.when(F.length(text) < 4, none).when(F.size("_w") >= 2, pairs).otherwise(F.expr("array(coalesce(try_element_at(_w, 1), ''))"))).drop("_w")


def exact_pairs(docs: DataFrame, threshold: float = 0.65) -> DataFrame:
    """(id_a, id_b, jaccard): distinct texts with Jaccard >= threshold."""
    from textmill.operators.nearcopies import similar_pairs  # which is built on this module

    return similar_pairs(docs, threshold)


def minhash(docs: DataFrame) -> DataFrame:
    """Adds ``signature``: 64 minima of (a h + b) mod 2^31 - 1 over shingle
    hashes of 31 bits (no product leaves 63 bits)."""
    df = once(docs, _h=F.expr("transform(shingles, s -> pmod(cast(conv(substring(md5(s), 1, 8), 16, 10) as bigint), 2147483647))"))
    minima = ", ".join(f"array_min(transform(_h, h -> (h * {a} + {b}) % {PRIME}))" for a, b in map(coefficients, range(SLOTS)))
    return once(df, signature=F.expr(f"array({minima})")).drop("_h")


def _bands(signed: DataFrame, rows: int, *more: str) -> DataFrame:
    """(doc_id, b, k, more): a row for each band of a signature."""
    bands = F.expr(f"transform(sequence(0, {SLOTS // rows - 1}), b -> named_struct('b', b, 'k', md5(array_join(transform(slice(signature, b * {rows} + 1, {rows}), x -> cast(x as string)), ','))))")
    return signed.filter("size(shingles) > 0").select("doc_id", *more, F.explode(bands).alias("x")).select("doc_id", "x.b", "x.k", *more)


def lsh_candidates(signed: DataFrame, rows: int = SLOTS // BANDS) -> DataFrame:
    """(id_a, id_b) that agree on a band.  A bucket's texts are linked to its
    smallest id only: components are the same, and a hot bucket makes a star."""
    flat = _bands(signed, rows)
    least = flat.groupBy("b", "k").agg(F.min("doc_id").alias("id_a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return flat.join(least, ["b", "k"]).filter("doc_id > id_a").select("id_a", F.col("doc_id").alias("id_b")).distinct()


#: Texts of a bucket from which it is divided, and by how many letters of the
#: alphanumeric key, step by step; the last is the whole key.
OVERSIZED, LETTERS = 200, (2, 4, 8, 64)


def lsh_pairs(signed: DataFrame, text: str = "text", limit: int = OVERSIZED, rows: int = SLOTS // BANDS) -> DataFrame:
    """(id_a, id_b) that agree on a band, all pairs of a bucket of less than
    ``limit`` texts.  Larger ones are divided by length in steps of 20 and by
    the beginning of the texts' alphanumeric key, and what is too large then by
    more of the key, so that no bucket makes more than limit^2 / 2 pairs and none
    is dropped.  Texts of one whole key are linked to the smallest id of them."""
    al = F.coalesce(alnum_key(F.col(text)), F.lit(""))
    flat = _bands(signed.withColumns({"_l": F.floor(F.length(text) / 20), "_al": al}), rows, "_l", "_al")
    rest = flat.select("doc_id", "_l", "_al", F.md5(F.concat_ws(":", "b", "k")).alias("key"))
    out = None
    for letters in (*LETTERS, None):
        counts = rest.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).filter("n > 1")
        held = rest.join(counts, "key")
        if letters is None:
            found = held.filter("doc_id > least").select(F.col("least").alias("id_a"), F.col("doc_id").alias("id_b"))
            out = out.unionByName(found)
            break
        small = held.filter(F.col("n") < limit)
        other = small.select("key", F.col("doc_id").alias("id_b"))
        found = small.select("key", F.col("doc_id").alias("id_a")).join(other, "key").filter("id_a < id_b").select("id_a", "id_b")
        out = found if out is None else out.unionByName(found)
        rest = cut(held.filter(F.col("n") >= limit).select("doc_id", "_l", "_al", F.md5(F.concat_ws("|", "key", F.col("_l").cast("string"), F.substring("_al", 1, letters))).alias("key")))
        if rest.isEmpty():
            break
    return out.distinct()


def similar(pairs: DataFrame, sets: DataFrame, threshold: float = 0.65) -> DataFrame:
    """``pairs`` (id_a, id_b) whose sets (doc_id, shingles) reach the
    threshold, with their ``jaccard``."""
    both = pairs.join(sets.select(F.col("doc_id").alias("id_a"), F.col("shingles").alias("a")), "id_a").join(sets.select(F.col("doc_id").alias("id_b"), F.col("shingles").alias("b")), "id_b")
    counted = once(both, shared=F.size(F.array_intersect("a", "b")))
    j = F.col("shared") / (F.size("a") + F.size("b") - F.col("shared"))
    return counted.withColumn("jaccard", F.round(j, 4)).filter(j >= threshold).select("id_a", "id_b", "jaccard")

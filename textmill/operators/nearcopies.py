"""Clusters of near copies by connectivity, without all of their pairs.

Two texts are near copies if the Jaccard similarity of their word bigrams
reaches a threshold t; clusters are what chains of them connect.  Only
connectivity is asked, so pairs that others connect are never made:

1. Texts of one set of shingles are one row.
2. With shingles ordered by rarity, of two sets the larger shares a shingle of
   its first n - ceil(t n) + 1 with the first n - ceil(2 t / (1 + t) n) + 1 of
   the smaller, as two sets share t / (1 + t) of their joint size at least.
   Shingles of one set only stand first and are in no bucket.
3. Stars: in each bucket (shingle and size class) all sets are compared with the
   smallest id only.  A set's label is the smallest id that it was verified
   with, so sets of one label are connected.
4. Pairs of different labels are compared where they meet in a bucket: those
   outside of the bucket's largest label with all others.  A family of m copies
   of a template costs m comparisons a bucket.  A match at places i and j leaves
   1 + min(n - i - 1, n' - j - 1) in common at most, which ends most others.

No pair is lost: one of two similar sets that aren't compared has the other's
label.  What is left of the square are unlike texts of unlike labels that
share a rare shingle.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators import graph
from textmill.operators.shingles import with_shingles
from textmill.operators.storage import cut, once, release


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, k: digest of the text, h: its shingles' hashes in order, digest
    of h, n) of each row of ``docs`` (doc_id, text) with a text."""
    rows = with_shingles(docs.select("doc_id", "text").filter("text is not null"))
    hashed = rows.select("doc_id", F.sha2("text", 256).alias("k"), F.sort_array(F.array_distinct(F.transform("shingles", lambda s: F.xxhash64(s)))).alias("h"))
    return once(hashed, digest=F.sha2(F.array_join(F.col("h").cast("array<string>"), " "), 256)).withColumn("n", F.size("h"))


def _ceil(x: str) -> str:
    return f"cast(ceil({x} - 1e-9) as int)"  # products of t aren't whole


def prefixes(sets: DataFrame, t: float) -> DataFrame:
    """(s, id, n, at: place of s in the set's order, indexed) of sets (id, h,
    n): the shingles by which a set is found."""
    each = sets.select("id", "n", F.explode("h").alias("s"))
    rarity = each.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    # a row a shingle on that side: a task's share of them is small and even
    ranked = each.join(rarity.hint("shuffle_hash"), "s").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("o"))
    alone = ranked.withColumn("alone", F.col("n") - F.size("o"))
    keep = alone.withColumn("keep", F.expr(f"n - {_ceil(f'{t!r}D * n')} + 1 - alone")).filter("keep > 0")
    rows = keep.select("id", "n", "alone", F.posexplode(F.expr("transform(slice(o, 1, keep), x -> x.s)")).alias("i", "s"))
    return rows.select("s", "id", "n", (F.col("alone") + F.col("i")).alias("at"), F.expr(f"alone + i < n - {_ceil(f'{2 * t / (1 + t)!r}D * n')} + 1").alias("indexed"))


def _verified(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets' similarity reaches t."""
    of = lambda k: sets.select(F.col("id").alias(k), F.col("h").alias(f"h{k}"))
    both = once(pairs.distinct().join(of("a"), "a").join(of("b"), "b"), o=F.size(F.array_intersect("ha", "hb")))
    return both.filter(F.col("o") / (F.size("ha") + F.size("hb") - F.col("o")) >= t).select("a", "b")


def star_links(found: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """(a, b): sets b that are similar to a bucket's smallest id a."""
    sized = found.withColumn("c", F.floor(F.log("n") / math.log(1 / t)))
    least = sized.groupBy("s", "c").agg(F.min("id").alias("a"), F.count("*").alias("m")).filter("m > 1").drop("m")
    near = sized.join(least, ["s", "c"]).filter("id > a")
    return _verified(near.select("a", F.col("id").alias("b")), sets, t)


def cross_links(found: DataFrame, labels: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """(a, b): similar sets of different labels (id, label)."""
    rows = found.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    # each bucket's largest label; buckets of one label are done
    each = rows.groupBy("s", "label").agg(F.count("*").alias("m"))
    large = each.groupBy("s").agg(F.max(F.struct("m", "label")).alias("x"), F.count("*").alias("labels")).filter("labels > 1").select("s", F.col("x.label").alias("most"))
    flagged = rows.join(large, "s").withColumn("big", F.col("label") == F.col("most"))
    low = flagged.filter("indexed").select("s", "big", F.col("id").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("label").alias("la"))
    # sets of the largest label meet the others only
    meets = F.when(F.col("big"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    high = flagged.select("s", F.explode(meets).alias("big"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("label").alias("lb"))
    fits = f"la <> lb and (na < nb or na = nb and a < b) and na >= {t!r}D * nb - 1e-9 and 1 + least(na - ia, nb - ib) - 1 >= {_ceil(f'{t / (1 + t)!r}D * (na + nb)')}"
    return _verified(low.join(high, ["s", "big"]).filter(fits).select("a", "b"), sets, t)


def clusters(docs: DataFrame, threshold: float = 0.65) -> DataFrame:
    """(doc_id, root) of each distinct text, by its smallest id: the smallest
    id that near copies lead to; its own, if it has none.  Texts of less than
    four characters have no shingles and no copies; null texts are left out."""
    rows = cut(shingle_sets(docs))
    texts = rows.groupBy("k", "digest", "n").agg(F.min("doc_id").alias("doc_id"))
    sets = cut(rows.filter("n > 0").groupBy("digest", "h", "n").agg(F.min("doc_id").alias("id")))
    # a set of one shingle is similar to its equals only
    many = sets.filter("n > 1").select("id", "h", "n")
    found = cut(prefixes(many, threshold))
    stars = cut(star_links(found, many, threshold))
    links = stars.unionByName(cross_links(found, stars.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label")), many, threshold))
    roots = graph.components(links)
    of = sets.select("digest", "id").join(roots, "id", "left").select("digest", F.coalesce("root", "id").alias("root"))
    return texts.join(of, "digest", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"))


def similar_pairs(docs: DataFrame, threshold: float = 0.65) -> DataFrame:
    """(id_a, id_b, jaccard): all pairs of distinct texts, by their smallest
    ids, whose similarity reaches the threshold.

    Only pairs of different sets of shingles are looked for, in the buckets of
    the shingles that lead a set's order, the smaller set being indexed; places and
    sizes end most of them before anything is shuffled.  Texts of one set are put
    back at the end."""
    spark = docs.sparkSession
    rows = cut(shingle_sets(docs).filter("n > 0"))
    texts = cut(rows.groupBy("k", "digest").agg(F.min("doc_id").alias("doc_id")).select("digest", "doc_id"))
    sets = cut(rows.groupBy("digest", "h", "n").agg(F.min("doc_id").alias("id")))
    del rows
    release(spark)
    many = sets.filter("n > 1").select("id", "h", "n")
    found = cut(prefixes(many, threshold))
    release(spark)
    high = found.select("s", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    low = found.filter("indexed").select("s", F.col("id").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"))
    t = threshold
    fits = f"(na < nb or na = nb and a < b) and na >= {t!r}D * nb - 1e-9 and least(na - ia, nb - ib) >= {_ceil(f'{t / (1 + t)!r}D * (na + nb)')}"
    near = cut(low.join(high, "s").filter(fits).select("a", "b").distinct())
    del found, low, high
    release(spark)
    # sets without a candidate aren't shuffled
    ids = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
    many = many.join(ids, "id", "left_semi")
    of = lambda k: many.select(F.col("id").alias(k), F.col("h").alias(f"h{k}"))
    both = once(near.join(of("a"), "a").join(of("b"), "b"), o=F.size(F.array_intersect("ha", "hb")))
    j = F.col("o") / (F.size("ha") + F.size("hb") - F.col("o"))
    pairs = both.filter(j >= t).select("a", "b", F.round(j, 4).alias("jaccard"))
    # a set's texts, among them the one that it is named by
    member = sets.select("digest", "id").join(texts, "digest").select("id", "doc_id")
    of = lambda k: member.select(F.col("id").alias(k), F.col("doc_id").alias(f"d{k}"))
    apart = pairs.join(of("a"), "a").join(of("b"), "b").select("da", "db", "jaccard")
    alike = of("a").join(of("a").toDF("a", "db"), "a").filter("da < db").select("da", "db", F.lit(1.0).alias("jaccard"))
    return apart.unionByName(alike).select(F.least("da", "db").alias("id_a"), F.greatest("da", "db").alias("id_b"), "jaccard")

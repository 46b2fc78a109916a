"""Pool building: harmonise, select, compare, isolate, reconcile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import keys as K
from textmill.operators import nearcopies
from textmill.sources.registry import SourceSpec


def harmonise(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """One source in canonical columns; text is kept as it is, null as ''."""
    number = F.col(spec.row_id).cast("long")
    return df.select(
        F.format_string(f"{spec.dataset}_%06d", number).alias("record_id"),
        F.lit(spec.dataset).alias("source_dataset"),
        F.lit(spec.lineage).alias("source_lineage"),
        number.alias("source_row_id"),
        F.coalesce(F.col(spec.text).cast("string"), F.lit("")).alias("text_raw"),
        (F.col(spec.label).cast("string") if spec.label else F.lit(None).cast("string")).alias("source_label"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def canonical_label(label: Column) -> Column:
    """'0', '1' or null from whatever a source has; never throws."""
    return label.cast("string").try_cast("double").cast("int").cast("string")


def canonical(df: DataFrame, key: str, order: list[str], invalid: Column | None = None) -> DataFrame:
    """One row of each key, the first by ``order`` (a total order) among all of
    its rows, and that row only if it isn't invalid: a grouped minimum, so a
    hot key needs no task for its rows."""
    rest = [c for c in df.columns if c not in (key, *order)]
    bad = F.lit(False) if invalid is None else invalid
    got = df.filter(F.col(key).isNotNull()).withColumn("_bad", bad).groupBy(key).agg(F.min(F.struct(*order, "_bad", *rest)).alias("_x"), F.count("*").alias("source_record_count"))
    return got.filter(~F.col("_x._bad")).select(key, *[F.col(f"_x.{c}").alias(c) for c in (*order, *rest)], "source_record_count")


def conflicts(df: DataFrame, key: str, dataset: str, label: str) -> DataFrame:
    """Keys with more than one label: within a dataset, and across datasets
    (two datasets' label sets differ)."""
    per = df.filter(F.col(key).isNotNull()).groupBy(key, dataset).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(label)).alias("set"))
    every = per.groupBy(key).agg(F.sum("n").alias("source_record_count"), F.array_join(F.sort_array(F.collect_set(dataset)), ";").alias("datasets_present"), F.size(F.array_distinct(F.flatten(F.collect_list("set")))).alias("labels"), F.max(F.size("set") > 1).alias("within_dataset_conflict"), (F.count_distinct("set") > 1).alias("cross_dataset_conflict"))
    return every.filter("labels > 1").drop("labels")


def conflict_summary(found: DataFrame) -> DataFrame:
    both = F.col("cross") + F.col("within") - F.col("total")
    sums = found.agg(F.count("*").alias("total"), F.count_if("cross_dataset_conflict").alias("cross"), F.count_if("within_dataset_conflict").alias("within"), F.coalesce(F.sum("source_record_count"), F.lit(0)).alias("rows"))
    return sums.select("total", "rows", "cross", "within", both.alias("both"), (F.col("cross") - both).alias("only_cross"), (F.col("within") - both).alias("only_within"))


def adjudicate(df: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Every record of a decided key gets its decision; others keep theirs."""
    return df.join(decisions, key, "left").withColumn("canonical_label", F.coalesce("decided_label", "label")).withColumn("label_status", F.coalesce("decided_status", F.lit("accepted"))).drop("decided_label", "decided_status")


LEVELS = ("exact", "whitespace", "normalized", "alnum")


def pairwise_overlap(df: DataFrame, dataset: str = "source") -> DataFrame:
    """For every two datasets: exact groups of either whose key of each level
    is on both sides, and distinct keys shared, for four levels of keys.

    One pass: the distinct (dataset, exact key) rows give a count for each
    (level, key, dataset), and pairs are made from a key's datasets, never
    from its rows.  Groups on both sides are counted twice by that, and are
    the exact keys that the pair shares, as far as they have a key of the level
    (a text without letters or digits has no alphanumeric one)."""
    names = df.select(dataset).distinct()
    pairs = names.select(F.col(dataset).alias("dataset_a")).join(names.select(F.col(dataset).alias("dataset_b")), F.col("dataset_a") < F.col("dataset_b"))
    # a text's keys follow from its exact key
    texts = df.groupBy(F.col(dataset).alias("d"), "exact_key").agg(*[F.first(f"{k}_key").alias(f"{k}_key") for k in LEVELS[1:]])
    held = F.array(*[F.col(f"{k}_key").isNotNull() for k in LEVELS])
    each = texts.select("d", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"{k}_key").alias("k"), F.when(F.lit(k == LEVELS[0]), held).alias("held")) for k in LEVELS])).alias("x")).select("d", "x.level", "x.k", "x.held").filter("k is not null")
    # of an exact key, the levels of which its text has keys
    per = each.groupBy("level", "k", "d").agg(F.count("*").alias("n"), F.max("held").alias("held"))
    # a key's datasets are few
    sides = per.groupBy("level", "k").agg(F.sort_array(F.collect_list(F.struct("d", "n", "held"))).alias("s")).filter("size(s) > 1")
    of = sides.select("level", F.posexplode("s").alias("i", "a"), "s").select("level", "a", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("b"))
    got = of.groupBy(F.col("a.d").alias("dataset_a"), F.col("b.d").alias("dataset_b")).agg(*[F.count_if(F.col("level") == k).alias(f"unique_{k}_shared") for k in LEVELS], *[F.sum(F.when(F.col("level") == k, F.col("a.n") + F.col("b.n")).otherwise(0)).alias(f"_{k}") for k in LEVELS], *[F.count_if((F.col("level") == LEVELS[0]) & F.col("a.held")[i]).alias(f"_both_{k}") for i, k in enumerate(LEVELS)])
    out = pairs.join(got, ["dataset_a", "dataset_b"], "left").fillna(0)
    return out.select("dataset_a", "dataset_b", *[c for k in LEVELS for c in ((F.col(f"_{k}") - F.col(f"_both_{k}")).alias(f"shared_{k}_groups"), F.col(f"unique_{k}_shared"))])


def overlap_monotonicity(overlap: DataFrame) -> DataFrame:
    """Pairs whose exact groups shrink at a coarser level."""
    cols = [F.col(f"shared_{level}_groups") for level in LEVELS]
    return overlap.filter((cols[0] > cols[1]) | (cols[1] > cols[2]) | (cols[2] > cols[3])).select("dataset_a", "dataset_b")


#: Keys by which a pool is isolated from held-out texts, first match first.
ISOLATION = ("exact", "whitespace", "normalized", "near_duplicate")


def with_near_duplicates(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text, exact_key) without their text and with
    ``near_duplicate_key``, the cluster of the text among all of these rows;
    null for a null text.  Give pool and held-out rows together, with ids that
    don't meet."""
    first = rows.filter("exact_key is not null").groupBy("exact_key").agg(F.min("doc_id").alias("first"))
    roots = nearcopies.clusters(rows.select("doc_id", "text").filter("text is not null")).toDF("first", "near_duplicate_key")
    return rows.drop("text").join(first.join(roots, "first").select("exact_key", "near_duplicate_key"), "exact_key", "left")


def isolate(pool: DataFrame, held: DataFrame, levels: tuple[str, ...] = ISOLATION) -> DataFrame:
    """``pool`` with ``overlap_level``, the first level at which its key is in
    ``held``; null: isolated.  A near copy counts as one through any chain of
    texts, of either side, that are near copies of each other."""
    out = pool
    for name in levels:
        key = f"{name}_key"
        seen = held.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(f"_{name}", F.lit(True))
        out = out.join(seen, key, "left")
    level = F.coalesce(*[F.when(F.col(f"_{n}"), F.lit(n)) for n in levels])
    return out.withColumn("overlap_level", level).drop(*[f"_{n}" for n in levels])


def reconciliation(df: DataFrame) -> DataFrame:
    """Per dataset and TOTAL, from rows (doc_id, source, exact_key, status,
    label): rows, invalid, duplicates within the dataset (TOTAL: in the pool),
    across datasets, with conflicting labels, for review (a conflict within a
    dataset only), accepted, representatives and excluded.

    No row is joined back: the rows of a (dataset, key) are counted first, and
    a key's datasets, which are few, are held together and taken apart."""
    per = df.groupBy("source", "exact_key").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.first("status").alias("status"), F.sort_array(F.collect_set("label")).alias("labels"))
    key = per.groupBy("exact_key", "status").agg(F.collect_list(F.struct("source", "n", "low")).alias("s"), F.sum("n").alias("n_all"), F.min("low").alias("low_all"), F.size(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("n_labels"), F.count_distinct("labels").alias("n_sets"))
    total = F.array(F.struct(F.lit("TOTAL").alias("source"), F.col("n_all").alias("n"), F.col("low_all").alias("low")))
    rows = key.select("*", F.explode(F.concat("s", total)).alias("x"), (F.size("s") > 1).alias("many")).select("x.*", "status", "low_all", "many", (F.col("n_labels") > 1).alias("conflict"), ((F.col("n_labels") > 1) & (F.col("n_sets") == 1)).alias("review"))
    valid = F.col("status") != "invalid"
    rows_if = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    final = F.count_if(valid & (F.col("low") == F.col("low_all")))
    got = rows.groupBy("source").agg(F.sum("n").alias("raw_rows"), rows_if(~valid).alias("invalid_rows"), rows_if(F.col("n") > 1).alias("exact_duplicate_rows"), rows_if(F.col("many")).alias("cross_duplicate_rows"), rows_if(F.col("conflict")).alias("conflict_rows"), rows_if(F.col("review") & valid).alias("review_rows"), rows_if(~F.col("review") & valid).alias("accepted_rows"), final.alias("final_rows"))
    return got.withColumn("excluded_rows", F.col("raw_rows") - F.col("final_rows"))


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    return docs.withColumns({"exact_key": K.exact_key(t), "whitespace_key": K.whitespace_key(t), "normalized_key": K.normalized_key(t), "alnum_key": K.alnum_key(t)})

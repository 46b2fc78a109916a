"""Every query of the library by name, and its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions import keys as K
from textmill.operators import evaluate as E
from textmill.operators import charcnn, ml, nearcopies, pool, shingles, svm
from textmill.operators import obfuscate as O
from textmill.operators import split as S
from textmill.operators.expect import count_violations
from textmill.operators.storage import cut, spread
from textmill.plans import sql
from textmill.sources import registry as R

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return spread(_t(spark, d, "documents"))


def _label(id_col: str = "doc_id"):
    """A label that differs between copies, as the tables have no conflicts."""
    return F.when(F.col(id_col) % 3 == 0, 1).otherwise(0).cast("long")


@query
def exact_dedup_canonical(spark, d):
    """Representative of each exact text with what its group holds."""
    keyed = _docs(spark, d).select("doc_id", "source", K.exact_key(F.col("text")).alias("exact_key"))
    got = keyed.groupBy("exact_key").agg(F.min_by("source", "doc_id").alias("source"), F.min("doc_id").alias("doc_id"), F.count("*").alias("source_record_count"), F.array_join(F.sort_array(F.collect_set("source")), ";").alias("source_datasets_combined"))
    return got.select("doc_id", "source", K.group_id("EDG_", F.col("exact_key")).alias("exact_duplicate_group"), "source_record_count", "source_datasets_combined")


@query
def text_keys(spark, d):
    k = pool.keyed(_docs(spark, d))
    return k.select("doc_id", "exact_key", "whitespace_key", "normalized_key", "alnum_key", K.group_id("EDG_", F.col("exact_key")).alias("edg"), K.group_id("WDG_", F.col("whitespace_key")).alias("wdg"), K.group_id("NVG_", F.col("normalized_key")).alias("nvg"))


@query
def quality_flags(spark, d):
    flags = _docs(spark, d).select("doc_id", K.quality_flags(F.col("text")).alias("f"))
    return flags.select("doc_id", F.array_join("f", ";").alias("data_quality_flags"), K.quality_status(F.col("f")).alias("data_quality_status"))


@query
def quality_summary(spark, d):
    t = F.col("text")
    rows = _docs(spark, d).select("source", F.length(t).alias("n"), K.quality_status(K.quality_flags(t)).alias("status"), *[t.rlike(p).cast("double").alias(k) for k, p in (("digit", "[0-9]"), ("url", K.URL), ("wide", "[^\\x00-\\x7F]"), ("gap", "[\\r\\n\\t\\x{A0}\\x{200B}]|  "))])
    return rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if(F.col("status") == "valid").alias("n_valid"), F.count_if(F.col("status") == "suspicious").alias("n_suspicious"), F.min("n").cast("long").alias("min_chars"), F.avg("n").alias("avg_chars"), F.max("n").cast("long").alias("max_chars"), *[(F.avg(k) * 100).alias(f"pct_{k}") for k in ("digit", "url", "wide", "gap")])


@query
def length_profile(spark, d):
    p = F.percentile(F.length("text"), F.lit(0.995))
    return _docs(spark, d).agg(F.min(F.length("text")).cast("long").alias("min_len"), F.percentile(F.length("text"), F.lit(0.5)).alias("median_len"), F.avg(F.length("text")).alias("mean_len"), F.max(F.length("text")).cast("long").alias("max_len"), p.alias("p995"), (F.ceil(p / 32) * 32).cast("long").alias("max_length"))


#: Terms that occur in the tables, matched as the entities are.
TERMS = {"license": "licen[sc]e", "mail": "@mail", "token": "token", "idiot_clown": "idiot|clown", "entertainment": "enter", "heading": "the"}


def _entities(spark, d, patterns):
    low = _docs(spark, d).select("doc_id", F.lower(K.nfkc("text")).alias("t"))
    return low.select("doc_id", K.matches(F.col("t"), patterns).alias("found"))


@query
def entity_report(spark, d):
    found = _entities(spark, d, TERMS)
    total = found.agg(F.count("*").alias("n"))
    per = found.select(F.explode("found").alias("term")).groupBy("term").agg(F.count("*").alias("documents"))
    return per.crossJoin(F.broadcast(total)).select("term", "documents", F.bround(F.col("documents") / F.col("n") * 100, 2).alias("pct_of_total")).orderBy(F.desc("documents"), "term")


#: What the documents are given to find, one each in turn (the tables hold
#: none of these names): every second one has nothing.
PHRASES = ("Toke 69 slot", "gunung WIN maxwin", "kakek zeus jp", "weton`88 depo", "slots gacorr", "pulau-win", "ga ruda_ho ki scatter", "Ambil4D judi wd")


@query
def brand_signals(spark, d):
    given = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, PHRASES)), ((F.col("doc_id") / 2).cast("int") % len(PHRASES)) + 1), F.lit(" ."))).otherwise("")
    low = _docs(spark, d).select("doc_id", F.lower(K.nfkc(F.concat("text", given))).alias("t"))
    return low.select("doc_id", F.array_join(K.matches(F.col("t"), K.BRANDS), ";").alias("known_brand_entity"), F.array_join(K.matches(F.col("t"), K.SIGNALS), ";").alias("gambling_signal_terms"))


@query
def heuristic_subtype(spark, d):
    rows = _docs(spark, d).select("doc_id", "text", F.lower(K.nfkc("text")).alias("low"), _label().alias("label"), F.when(F.col("doc_id") % 10 == 0, "review").otherwise("accepted").alias("status"))
    return rows.select("doc_id", K.subtype(F.col("text"), F.col("low"), F.col("label"), F.col("status"), K.matches(F.col("low"), K.SIGNALS)).alias("promotion_type_heuristic"))


@query
def obfuscation_candidate(spark, d):
    return _docs(spark, d).select("doc_id", K.obfuscation_candidate(F.col("text")).alias("obfuscation_candidate"))


@query
def author_groups(spark, d):
    return _t(spark, d, "events").groupBy(K.author_group("EV", F.col("user_id").cast("string")).alias("author_group_id")).agg(F.count("*").alias("n_events"))


@query
def timestamp_standardize(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", K.iso_from_string(F.col("ts").cast("string")).alias("ts_iso"), K.iso_from_seconds(F.col("event_id") * 1000).alias("from_seconds"), K.iso_from_seconds(F.concat(F.lit("x"), "event_type")).alias("from_bad"))


@query
def duplicate_flags(spark, d):
    """keep=False duplicates by a grouped count and a join back on the key."""
    rows = _docs(spark, d).select("doc_id", "source", K.exact_key(F.col("text")).alias("k"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("source").alias("s"))
    return rows.join(counts, "k").select("doc_id", (F.col("n") > 1).alias("is_duplicate"), (F.col("s") > 1).alias("is_cross_dataset_duplicate"))


@query
def duplicate_group_report(spark, d):
    rows = _docs(spark, d).select("doc_id", "source", _label().cast("string").alias("label"), K.exact_key(F.col("text")).alias("k"))
    got = rows.groupBy("k").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("source")), ";").alias("sources"), F.array_join(F.sort_array(F.collect_set("label")), ";").alias("labels"), F.min("doc_id").alias("first_id"))
    return got.filter("n > 1").select(K.group_id("EDG_", F.col("k")).alias("group_id"), "n", "sources", "labels", "first_id")


def _conflicts(spark, d):
    rows = _docs(spark, d).select("source", _label().alias("label"), K.exact_key(F.col("text")).alias("k"))
    return pool.conflicts(rows, "k", "source", "label")


@query
def label_conflicts(spark, d):
    return _conflicts(spark, d)


@query
def conflict_summary(spark, d):
    return pool.conflict_summary(_conflicts(spark, d))


@query
def adjudicate(spark, d):
    """Cross-dataset conflicts become label 1, others go to review."""
    decided = _conflicts(spark, d).select("k", F.when(F.col("cross_dataset_conflict"), 1).cast("long").alias("decided_label"), F.when(F.col("cross_dataset_conflict"), "accepted").otherwise("review").alias("decided_status"))
    rows = _docs(spark, d).select("doc_id", _label().alias("label"), K.exact_key(F.col("text")).alias("k"))
    return pool.adjudicate(rows, decided, "k").select("doc_id", "canonical_label", "label_status")


@query
def pair_label_conflicts(spark, d):
    """Keys whose first label in two datasets differs, per pair."""
    rows = _docs(spark, d).select("doc_id", "source", _label().alias("label"), K.exact_key(F.col("text")).alias("k"))
    first = rows.groupBy("k", "source").agg(F.min_by("label", "doc_id").alias("label"))
    a, b = first.toDF("k", "dataset_a", "label_a"), first.toDF("k", "dataset_b", "label_b")
    return a.join(b, "k").filter("dataset_a < dataset_b and label_a <> label_b").groupBy("dataset_a", "dataset_b").agg(F.count("*").alias("pair_label_conflicts"))


@query
def pairwise_overlap(spark, d):
    return pool.pairwise_overlap(pool.keyed(_docs(spark, d)).drop("text"))


@query
def overlap_monotonicity(spark, d):
    return pool.overlap_monotonicity(pool.pairwise_overlap(pool.keyed(_docs(spark, d)).drop("text")))


def _pools(spark, d):
    """Held out: the first source and the benchmark; pool: all other rows."""
    docs = _docs(spark, d).select("doc_id", "text", F.coalesce(F.col("source") == "src0", F.lit(False)).alias("held"))
    bench = _t(spark, d, "benchmark").select((-F.col("item_id") - 1).alias("doc_id"), "text", F.lit(True).alias("held"))
    rows = pool.with_near_duplicates(pool.keyed(docs.unionByName(bench)))
    return rows.filter(~F.col("held")), rows.filter("held")


@query
def isolate_pool(spark, d):
    return pool.isolate(*_pools(spark, d)).select("doc_id", "overlap_level")


@query
def isolation_report(spark, d):
    return pool.isolate(*_pools(spark, d)).groupBy(F.coalesce("overlap_level", F.lit("isolated")).alias("level")).agg(F.count("*").alias("n"))


#: The registered sources, one flag each.
SOURCES = tuple(f"src{i}" for i in range(20))


@query
def source_coverage(spark, d):
    rows = _docs(spark, d).select("doc_id", "source", K.exact_key(F.col("text")).alias("k"))
    got = rows.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.collect_set("source").alias("s"))
    return got.select("doc_id", F.size("s").cast("long").alias("source_count"), *[F.array_contains("s", x).alias(f"appears_in_{x}") for x in SOURCES])


@query
def reconciliation(spark, d):
    t = F.col("text")
    return pool.reconciliation(_docs(spark, d).select("doc_id", "source", K.exact_key(t).alias("exact_key"), K.quality_status(K.quality_flags(t)).alias("status"), _label().alias("label")))


@query
def harmonize_union(spark, d):
    conv = _t(spark, d, "conversations").withColumn("row", F.col("conv_id") * 1000 + F.col("turn"))
    return pool.union_all([pool.harmonise(_docs(spark, d), R.DOCUMENTS), pool.harmonise(conv, R.CONVERSATIONS), pool.harmonise(_t(spark, d, "benchmark"), R.BENCHMARK)]).withColumn("canonical_label", pool.canonical_label(F.col("source_label"))).drop("source_label")


@query
def byte_equality(spark, d):
    """Canonical text against its raw row: counts by outcome."""
    canonical = pool.harmonise(_docs(spark, d), R.DOCUMENTS).withColumnRenamed("source_row_id", "doc_id")
    raw = _docs(spark, d).filter("doc_id % 50 <> 7").select("doc_id", "text")
    got = canonical.join(raw, "doc_id", "left")
    return got.agg(F.count_if(F.col("text").isNull()).alias("missing_rows"), F.count_if(F.col("text") != F.col("text_raw")).alias("mismatches"), F.count_if(F.col("text") == F.col("text_raw")).alias("equal_rows"))


def _shingled(spark, d):
    return shingles.with_shingles(shingles.distinct_texts(_docs(spark, d)))


@query
def shingle_counts(spark, d):
    got = shingles.with_shingles(_docs(spark, d))
    return got.select("doc_id", F.size("shingles").cast("long").alias("n_shingles"), F.sha2(F.array_join(F.array_sort("shingles"), "|"), 256).alias("digest"))


@query
def near_dup_pairs_exact(spark, d):
    return shingles.exact_pairs(_docs(spark, d))


@query
def minhash_signature(spark, d):
    return shingles.minhash(_shingled(spark, d).filter("size(shingles) > 0")).select("doc_id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


@query
def lsh_candidates(spark, d):
    return shingles.lsh_candidates(shingles.minhash(_shingled(spark, d)))


@query
def lsh_pairs(spark, d):
    """All pairs of a bucket, large ones divided, and which are near copies."""
    texts = cut(shingles.minhash(_shingled(spark, d)).select("doc_id", "text", "shingles", "signature"))
    pairs = cut(shingles.lsh_pairs(texts))
    return pairs.join(shingles.similar(pairs, texts), ["id_a", "id_b"], "left")


def _components(spark, d):
    return nearcopies.clusters(_docs(spark, d))


@query
def near_dup_components(spark, d):
    return _components(spark, d).select("doc_id", F.format_string("NDG_%06d", "root").alias("near_duplicate_group"))


@query
def cluster_sizes(spark, d):
    return _components(spark, d).groupBy("root").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


@query
def largest_clusters(spark, d):
    return _components(spark, d).groupBy("root").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "root").limit(100)


@query
def leakage_groups(spark, d):
    """Every document's group, mapped back from distinct texts."""
    of = _docs(spark, d).select("doc_id", K.exact_key(F.col("text")).alias("k"))
    first = of.groupBy("k").agg(F.min("doc_id").alias("first"))
    comp = _components(spark, d).withColumnRenamed("doc_id", "first")
    return of.join(first, "k").join(comp, "first").select("doc_id", F.concat(F.lit("LG_"), F.substring(F.format_string("NDG_%06d", "root"), 5, 20)).alias("leakage_group_id"))


@query
def stratified_sample(spark, d):
    return S.sample_per_stratum(_docs(spark, d).select("doc_id", "lang", _label().alias("label")), ["lang", "label"], "doc_id", 20)


@query
def proportional_sample(spark, d):
    return S.sample_proportional(_docs(spark, d).select("doc_id", "lang"), "lang", "doc_id", 200)


@query
def review_queue_sample(spark, d):
    got = S.sample_per_stratum(O.conditions(_docs(spark, d).select("doc_id")).withColumn("label", _label()), ["family", "severity", "label"], "doc_id", 20)
    rank = F.row_number().over(Window.orderBy("family", "severity", "label", "doc_id"))  # 320 rows
    return got.select(F.format_string("REV_%04d", rank).alias("review_id"), "doc_id", "family", "severity", "label")


def _folds(spark, d):
    groups = leakage_groups(spark, d).select("doc_id", F.md5(F.col("leakage_group_id").cast("binary")).alias("g"))
    rows = cut(_docs(spark, d).select("doc_id", "source", _label().alias("label")).join(groups, "doc_id"))
    return rows.join(S.snake_folds(S.group_counts(rows, "g", "label"), "g").select("g", "fold"), "g").withColumn("split", S.split_name())


@query
def group_split(spark, d):
    return _folds(spark, d).select("doc_id", "fold", "split")


@query
def greedy_split(spark, d):
    """Ten folds by the published greedy rule over leakage groups."""
    groups = leakage_groups(spark, d).select("doc_id", F.md5(F.col("leakage_group_id").cast("binary")).alias("g"))
    rows = cut(_docs(spark, d).select("doc_id", _label().alias("label")).join(groups, "doc_id"))
    return rows.join(S.stratified_group_folds(S.group_counts(rows, "g", "label"), "g").select("g", "fold"), "g").select("doc_id", "label", "fold")


@query
def split_stats(spark, d):
    got = _folds(spark, d).groupBy("split").agg(F.count("*").alias("records"), F.count_if(F.col("label") == 1).alias("positives"), F.count_distinct("g").alias("groups"))
    return got.withColumn("positive_rate", F.col("positives") / F.col("records"))


@query
def split_by_source(spark, d):
    return _folds(spark, d).groupBy("split", "source").agg(F.count("*").alias("records"), F.count_if(F.col("label") == 1).alias("positives"))


@query
def split_leakage_check(spark, d):
    got = _folds(spark, d).groupBy("g").agg(F.count_distinct("split").alias("n"))
    return got.filter("n > 1").agg(F.count("*").alias("groups_in_several_splits"))


@query
def author_overlap(spark, d):
    """Distinct authors of three splits of the events, and shares in common
    (train against the other's count, validation and test the smaller)."""
    split = F.when(F.col("event_id") % 10 == 0, "test").when(F.col("event_id") % 10 == 1, "val").otherwise("train")
    who = F.trim(F.col("user_id").cast("string"))
    rows = _t(spark, d, "events").select(split.alias("s"), who.alias("a")).filter(F.col("a").isNotNull() & ~F.col("a").isin("", "nan", "None"))
    per = rows.groupBy("a").agg(*[F.max(F.col("s") == x).alias(x) for x in ("train", "val", "test")])
    both = lambda a, b: F.count_if(F.col(a) & F.col(b))
    got = per.agg(*[F.count_if(x).alias(f"n_{x}") for x in ("train", "val", "test")], both("train", "val").alias("train_val"), both("train", "test").alias("train_test"), both("val", "test").alias("val_test"))
    pct = lambda k, n: (F.col(k) / F.greatest(n, F.lit(1)) * 100).alias(f"pct_{k}")
    return got.select("*", pct("train_val", F.col("n_val")), pct("train_test", F.col("n_test")), pct("val_test", F.least("n_val", "n_test")))


@query
def eligible_tokens(spark, d):
    got = _docs(spark, d).select("doc_id", O.eligible_tokens().alias("e"))
    return got.select("doc_id", F.size("e").cast("long").alias("n_eligible"), F.sha2(F.array_join(F.transform("e", lambda x: F.concat(x["i"].cast("string"), F.lit(":"), x["t"])), " "), 256).alias("digest"))


@query
def protected_spans(spark, d):
    return _docs(spark, d).select("doc_id", O.protected_spans().alias("s")).select("doc_id", F.size("s").cast("long").alias("n_spans"), F.array_join("s", " ").alias("spans"))


def _records(spark, d):
    return _docs(spark, d).select("doc_id", "source", "text")


def _hashed(spark, d, family):
    return O.hash_mode(_records(spark, d), family)


def _obfuscated(n):
    def run(spark, d):
        got = _hashed(spark, d, O.FAMILIES[n])
        return got.select("doc_id", "severity", F.sha2("text_obfuscated", 256).alias("digest"), "modified_token_count", "changed")

    return run


for _n in range(4):
    _QUERIES[f"obfuscate_o{_n + 1}"] = _obfuscated(_n)


@query
def obfuscate_seeded(spark, d):
    """The seeded mode over all conditions."""
    rows = O.conditions(_docs(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("record_id"), "text"))
    got = O.edit_figures(O.mt_mode(rows))
    return got.select(F.concat_ws("_", F.lit("PAIR"), "family", "severity", "record_id").alias("pair_id"), "doc_id", "family", "severity", F.sha2("text_obfuscated", 256).alias("digest"), "status", "modified_char_count", "modified_char_ratio", "modified_token_count")


@query
def homoglyph_normalize(spark, d):
    """What the look-alike condition does is undone by the reverse map."""
    got = _hashed(spark, d, O.FAMILIES[3])
    return got.select("doc_id", "severity", F.sha2(O.normalize_homoglyphs(F.col("text_obfuscated")), 256).alias("digest"), (O.normalize_homoglyphs(F.col("text_obfuscated")) == F.col("text")).alias("restored"))


@query
def obfuscation_stats(spark, d):
    frames = [_hashed(spark, d, f).select(F.lit(f).alias("family"), "severity", "changed") for f in O.FAMILIES]
    got = pool.union_all(frames).groupBy("family", "severity").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"), F.count_if(~F.col("changed")).alias("n_no_target"))
    rate = F.col("n_changed") / F.col("n") * 100
    return got.select("*", F.round(rate, 2).alias("success_rate_pct"), (rate >= 90).alias("passes_gate"))


@query
def edit_diagnostics(spark, d):
    """Edits and lengths of each condition's changed rows, with those beyond
    the caps: counted where the changes are made, without a distance."""
    keep = lambda f: _hashed(spark, d, f).filter("changed").select(F.lit(f).alias("family"), "severity", F.length("text").alias("n"), F.length("text_obfuscated").alias("m"), F.col("modified_char_count").alias("edits"), O.excessive().alias("excess"))
    rows = pool.union_all([keep(f) for f in O.FAMILIES]).withColumns({"delta": F.abs(F.col("m") - F.col("n")), "ratio": F.col("edits") / F.greatest("n", F.lit(1))})
    length = F.col("m") / F.greatest("n", F.lit(1))
    figures = [f.alias(f"{name}_{c}") for c in ("edits", "ratio", "delta") for name, f in (("mean", F.avg(c)), ("median", F.percentile(c, F.lit(0.5))), ("max", F.max(c)))]
    return rows.groupBy("family", "severity").agg(F.count("*").alias("changed_count"), *figures, F.count_if("excess").alias("excessive_ratio_flags"), F.count_if((length < O.MIN_LENGTH_RATIO) | (length > O.MAX_LENGTH_RATIO)).alias("length_anomalies"))


CONDITIONS = [f"O{i}_{s}" for i in (1, 2, 3, 4) for s in O.SEVERITIES]
MODELS = ("svm", "cnn", "bert")


def _predictions(spark, d):
    """Rows (model, condition, source, doc_id, y, y_norm, y_obf, changed): no
    table holds predictions, so they are flips of the label by hashes."""
    rows = _docs(spark, d).join(_t(spark, d, "labels"), "doc_id").select("doc_id", "source", F.col("toxic").cast("long").alias("y"))
    rows = rows.withColumn("model", F.explode(F.array(*map(F.lit, MODELS)))).withColumn("condition", F.explode(F.array(*map(F.lit, CONDITIONS))))
    flip = lambda parts, n: F.when(K.hash_number(*parts, mod=100) < n, 1).otherwise(0).cast("long")
    y_norm = (F.col("y") + flip((F.lit("n"), "doc_id", "model"), 6)) % 2
    y_obf = (F.col("y_norm") + flip((F.lit("o"), "doc_id", "model", "condition"), 9)) % 2
    return rows.withColumn("y_norm", y_norm).withColumn("y_obf", y_obf).withColumn("changed", K.hash_number(F.lit("c"), "doc_id", "condition", mod=100) < 96)


@query
def confusion_metrics(spark, d):
    return E.metrics(_predictions(spark, d).withColumnRenamed("y_obf", "pred"), ["model", "condition"])


@query
def normal_metrics(spark, d):
    return E.metrics(_predictions(spark, d).filter(F.col("condition") == CONDITIONS[0]).withColumnRenamed("y_norm", "pred"), ["model"])


@query
def paired_robustness(spark, d):
    return E.paired(_predictions(spark, d), ["model", "condition"])


@query
def flip_summary(spark, d):
    return E.flips(_predictions(spark, d), ["model", "condition"])


@query
def source_stratified(spark, d):
    return E.metrics(_predictions(spark, d).filter("changed").withColumnRenamed("y_obf", "pred"), ["model", "condition", "source"])


@query
def error_rows(spark, d):
    return _predictions(spark, d).filter("changed and (y_obf <> y or y_norm <> y_obf)").select("model", "condition", "doc_id", "y", "y_norm", "y_obf")


@query
def robustness_pivot(spark, d):
    got = E.paired(_predictions(spark, d), ["model", "condition"]).withColumn("family", F.substring("condition", 1, 2))
    return got.groupBy("model").pivot("family", ["O1", "O2", "O3", "O4"]).agg(F.avg("f1_drop")).withColumnsRenamed({f"O{i}": f"drop_o{i}" for i in (1, 2, 3, 4)})


@query
def winner_per_condition(spark, d):
    got = E.paired(_predictions(spark, d), ["model", "condition"])
    return got.groupBy("condition").agg(F.max_by("model", F.struct("f1_obf", "model")).alias("winner"), F.max("f1_obf").alias("f1"))


@query
def model_ranks(spark, d):
    got = E.paired(_predictions(spark, d), ["model", "condition"]).groupBy("model").agg(F.avg("f1_drop").alias("mean_drop"), F.avg("retention_pct").alias("mean_retention"))
    return got.select("model", "mean_drop", "mean_retention", F.rank().over(Window.orderBy("mean_drop")).cast("long").alias("drop_rank"))


@query
def bootstrap_ci(spark, d):
    return E.bootstrap_ci(_predictions(spark, d), ["model", "condition"])


@query
def class_weights(spark, d):
    return ml.class_weights(_t(spark, d, "labels").select(F.col("toxic").cast("long").alias("toxic")), "toxic")


@query
def tfidf_terms(spark, d):
    """Document frequency and smoothed idf of every term."""
    words = _docs(spark, d).select("doc_id", F.explode(F.expr("regexp_extract_all(lower(text), '[\\\\p{L}\\\\p{N}_]{2,}', 0)")).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    total = _docs(spark, d).agg(F.count("*").alias("n"))
    per = words.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return per.crossJoin(F.broadcast(total)).select("term", "df", "cf", F.round(F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1, 9).alias("idf"))


@query
def best_candidate(spark, d):
    """Best model of each condition by F1, precision, recall, name."""
    got = E.metrics(_predictions(spark, d).withColumnRenamed("y_obf", "pred"), ["model", "condition"])
    order = F.struct(F.round("f1", 9), F.round("precision", 9), F.round("recall", 9), "model")
    return got.groupBy("condition").agg(F.max_by("model", order).alias("best_model"))


@query
def running_best(spark, d):
    """Best figure so far over steps, whether a step is it, steps since."""
    day = _t(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.max("value").alias("value"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a day
    got = day.withColumn("best_so_far", F.max("value").over(w)).withColumn("is_best", F.col("value") == F.col("best_so_far")).withColumn("step", F.row_number().over(Window.orderBy("day")))
    last = F.max(F.when(F.col("is_best"), F.col("step"))).over(w)
    return got.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "value", "best_so_far", "is_best", (F.col("step") - last).cast("long").alias("steps_since"))


def _labelled(spark, d):
    """Labelled texts, and a tenth of them set apart."""
    rows = _docs(spark, d).join(_t(spark, d, "labels"), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return rows.filter(~test), rows.filter(test)


@query
def svm_train_predict(spark, d):
    """Figures of the linear machine (squared hinge) on a held-out tenth."""
    train, test = _labelled(spark, d)
    rows, known, size = svm.prepared(train, "toxic")
    machine = svm.fit(rows, size)
    got = svm.decide(svm.vectors(svm.counted(test, keep=("toxic",)), known, ("toxic",)), machine, ("toxic",))
    return got.withColumnRenamed("predicted_label", "p").agg(*E.confusion("toxic", "p")).withColumns(E.figures())


@query
def svm_grid(spark, d):
    """Six candidates of the linear machine on the held-out tenth, and the best
    by the tie-break chain."""
    train, test = _labelled(spark, d)
    got = svm.grid(train, test, "toxic", tolerance=1e-2).withColumnRenamed("predicted_label", "p")
    rows = got.groupBy("unigram", "c").agg(*E.confusion("toxic", "p")).withColumns(E.figures())
    best = E.best_candidate(sorted((r.asDict() for r in rows.collect()), key=lambda r: (not r["unigram"], r["c"])))  # six rows
    return rows.withColumn("is_best", (F.col("unigram") == best["unigram"]) & (F.col("c") == best["c"]))


@query
def cnn_train_predict(spark, d):
    """Figures of the character convolutions on a held-out tenth."""
    train, test = _labelled(spark, d)
    got = charcnn.predict(charcnn.fit(train, "toxic"), test, ("doc_id", "toxic")).withColumnRenamed("predicted_label", "p")
    return got.agg(*E.confusion("toxic", "p")).withColumns(E.figures())


#: Character ids: printable ASCII from 2; 0 pads, 1 is unknown.
WIDTH = 576


@query
def char_encode(spark, d):
    head = F.substring("text", 1, WIDTH)
    ids = F.transform(F.filter(F.split(head, ""), lambda c: c != ""), lambda c: F.when((F.ascii(c) >= 32) & (F.ascii(c) <= 126), F.ascii(c) - 30).otherwise(1))
    got = _docs(spark, d).select("doc_id", F.greatest(F.size(ids), F.lit(1)).cast("long").alias("n"), F.concat(ids, F.array_repeat(F.lit(0), WIDTH - F.size(ids))).alias("x"))
    return got.select("doc_id", "n", F.sha2(F.array_join(F.transform("x", lambda v: v.cast("string")), " "), 256).alias("digest"))


@query
def oov_stats(spark, d):
    """Tokens of each language against the vocabulary of English words that at
    least two English documents hold."""
    words = _docs(spark, d).select("doc_id", "lang", F.explode(F.expr("regexp_extract_all(lower(text), '[^ \\\\t\\\\n]+', 0)")).alias("w")).groupBy("doc_id", "lang", "w").agg(F.count("*").alias("n"))
    known = words.filter("lang = 'en'").groupBy("w").agg(F.count("*").alias("c")).filter("c >= 2").select("w", F.lit(1).alias("known"))
    got = words.join(known, "w", "left").groupBy("doc_id", "lang").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("unk"))
    return got.groupBy("lang").agg(F.sum("tokens").alias("total_tokens"), F.avg("tokens").alias("avg_tokens"), F.sum("unk").alias("unk_tokens"), (F.avg(F.when(F.col("unk") > 0, 1.0).otherwise(0.0)) * 100).alias("pct_docs_with_unk"))


@query
def expectations(spark, d):
    docs = _docs(spark, d)
    keyed = docs.select("doc_id", "source", K.exact_key(F.col("text")).alias("exact_key"))
    labels = _t(spark, d, "labels")
    canonical = keyed.groupBy("exact_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    folds = _folds(spark, d).groupBy("g").agg(F.count_distinct("split").alias("n"))
    return count_violations({
        "ids_unique": docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1"),
        "text_not_null": docs.filter("text is null"),
        "labels_in_domain": labels.filter("toxic not in (0, 1) or quality not in (0, 1)"),
        "labels_have_documents": labels.join(docs, "doc_id", "left_anti"),
        "representatives_unique": canonical.groupBy("exact_key").agg(F.count("*").alias("c")).filter("c > 1"),
        "groups_in_one_split": folds.filter("n > 1"),
        "length_column_right": docs.filter(F.length("text") != F.col("n_chars")),
    })


@query
def star_join_revenue(spark, d):
    """Smoke query over the star tables: broadcast of dimensions is left to
    the optimizer's size check."""
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = _t(spark, d, "nation").select("n_nationkey", "n_name")
    got = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return got.groupBy("n_name").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.ORACLE.items() if k in _QUERIES}

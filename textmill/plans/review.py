"""Queries on review, freezing, model comparison and validation, with SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions import keys as K
from textmill.operators import evaluate as E
from textmill.operators import obfuscate as O
from textmill.operators import checks, pool, shingles, subwords
from textmill.operators.expect import count_violations
from textmill.operators.ranking import with_rank
from textmill.operators.storage import cut
from textmill.plans import catalogue as C
from textmill.plans import sql
from textmill.sources import registry as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- canonical rows, review queue, adjudication ---------------------------

#: Sources in the order in which they are preferred: those of even number last.
PRIORITY = {name: (1 if int(name[3:]) % 2 else 2) for name in C.SOURCES}


def _prioritised(spark, d):
    rank = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])[F.col("source")]
    status = K.quality_status(K.quality_flags(F.col("text")))
    return C._docs(spark, d).select(K.exact_key(F.col("text")).alias("exact_key"), rank.alias("rank"), "doc_id", "source", status.alias("status"))


@query
def canonical_by_priority(spark, d):
    """One row of each exact text: the preferred source's, the lowest id; none
    if that row is invalid."""
    got = pool.canonical(_prioritised(spark, d), "exact_key", ["rank", "doc_id"], F.col("status") == "invalid")
    return got.select("doc_id", "source", "rank", "status", "source_record_count")


@query
def review_queue(spark, d):
    """Rows set aside, with the reason."""
    rows = C._docs(spark, d).select("doc_id", "source", K.quality_flags(F.col("text")).alias("f"))
    reason = F.when(F.array_contains("f", "empty_or_whitespace_text"), "empty_text").when(F.array_contains("f", "digits_only"), "digits_only").when(F.array_contains("f", "no_alphanumeric_chars"), "no_letters").when(F.array_contains("f", "control_characters"), "control_characters").when(F.array_contains("f", "very_short"), "very_short")
    return rows.select("doc_id", "source", reason.alias("reason"), F.array_join("f", ";").alias("flags")).filter("reason is not null")


@query
def adjudicated_lookup(spark, d):
    """Labels by the benchmark's texts: the text as it is, else without white
    space around it; what is found by neither is unmatched."""
    table = C._t(spark, d, "benchmark").groupBy("text").agg(F.min("item_id").alias("item_id"))
    rows = C._docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  "), "text", F.lit("\n"))).otherwise(F.col("text")).alias("text"))
    asked = rows.unionByName(C._t(spark, d, "benchmark").select((-F.col("item_id") - 1).alias("doc_id"), F.concat(F.lit("\t"), "text").alias("text")))
    whole = table.select(F.col("text").alias("w"), F.col("item_id").alias("by_text"))
    bare = table.select(F.col("text").alias("b"), F.col("item_id").alias("by_stripped"))
    got = asked.join(whole, asked.text == F.col("w"), "left").join(bare, F.btrim("text", F.lit(K.BLANKS)) == F.col("b"), "left")
    return got.select("doc_id", F.coalesce("by_text", "by_stripped", F.lit(-1)).alias("item_id"), F.when(F.col("by_text").isNotNull(), "text").when(F.col("by_stripped").isNotNull(), "stripped").otherwise("unmatched").alias("found_by"))


@query
def combined_sources(spark, d):
    """Delimited lists taken apart, sorted and put together again."""
    held = C._docs(spark, d).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.array_join(F.sort_array(F.collect_set("source")), ";").alias("s"))
    parts = F.split("s", ";")
    return held.select("doc_id", F.size(parts).cast("long").alias("n_sources"), parts[0].alias("first_source"), F.array_join(F.reverse(parts), "|").alias("backwards"))


# --- clusters --------------------------------------------------------------


@query
def boundary_pairs(spark, d):
    """Pairs just above the threshold, to look at by hand: the 100 nearest."""
    pairs = shingles.exact_pairs(C._docs(spark, d)).filter(F.col("jaccard").between(0.65, 0.72))
    return pairs.orderBy("jaccard", "id_a", "id_b").limit(100)


@query
def cluster_review_sample(spark, d):
    """The 100 largest clusters and 100 random ones of two to five texts."""
    sizes = C._components(spark, d).groupBy("root").agg(F.count("*").alias("size"))
    largest = sizes.orderBy(F.desc("size"), "root").limit(100).withColumn("why", F.lit("largest"))
    small = sizes.filter("size between 2 and 5").orderBy(F.sha2(F.concat_ws("|", F.lit("42"), "root"), 256), "root").limit(100).withColumn("why", F.lit("small"))
    return largest.unionByName(small)


@query
def reverification_sample(spark, d):
    """A hundred rows of each condition of all four families, and whether
    taking look-alikes back undoes the change.  A condition holds every
    document, so the hundred are the same in each and are drawn first."""
    drawn = C._docs(spark, d).select("doc_id", "text").orderBy(F.sha2(F.concat_ws("|", F.lit("42"), "doc_id"), 256), "doc_id").limit(100)
    frames = [O.hash_mode(drawn, f).select(F.lit(f).alias("family"), "doc_id", "severity", "changed", (O.normalize_homoglyphs(F.col("text_obfuscated")) == F.col("text")).alias("restored")) for f in O.FAMILIES]
    return reduce(lambda x, y: x.unionByName(y), frames)


# --- profiles --------------------------------------------------------------


@query
def raw_profile(spark, d):
    """Characters, words and shares of rows by what they hold, per source."""
    t = F.col("text")
    symbols = F.length(F.regexp_replace(t, "[\\p{L}\\p{N}\\s]", "")) / F.greatest(F.length(t), F.lit(1))
    marks = {"emoji": t.rlike("[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]"), "digits": t.rlike("[0-9]"), "wide": t.rlike("[^\\x00-\\x7F]"), "symbols": symbols > 0.15}
    rows = C._docs(spark, d).select("source", F.length(t).alias("c"), F.regexp_count(t, F.lit("\\S+")).alias("w"), *[v.cast("double").alias(k) for k, v in marks.items()])
    return rows.groupBy("source").agg(*[f(k).cast(kind).alias(f"{n}_{name}") for k, name in (("c", "chars"), ("w", "words")) for n, f, kind in (("min", F.min, "long"), ("avg", F.avg, "double"), ("max", F.max, "long"))], *[(F.avg(k) * 100).alias(f"pct_{k}") for k in marks])


@query
def tfidf_bigrams(spark, d):
    """Document frequency of word bigrams that two documents hold."""
    words = C._docs(spark, d).select("doc_id", F.expr("regexp_extract_all(lower(text), '[\\\\p{L}\\\\p{N}_]{2,}', 0)").alias("w")).filter("size(w) > 1")
    pairs = words.select("doc_id", F.explode(F.expr("array_distinct(transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i])))")).alias("term"))
    return pairs.groupBy("term").agg(F.count("*").alias("df")).filter("df >= 2")


WORDS = "regexp_extract_all(lower(text), '[\\\\p{L}]+', 0)"


@query
def subword_stats(spark, d):
    """How far each language's words fall apart under a vocabulary counted on
    the English ones."""
    rows = cut(C._docs(spark, d).select("lang", "doc_id", F.explode(F.expr(WORDS)).alias("w")).groupBy("lang", "doc_id", "w").agg(F.count("*").alias("n")))
    clean = rows.filter("lang = 'en'").groupBy("w").agg(F.sum("n").alias("n"))
    return subwords.statistics(rows, ["lang"], subwords.vocabulary(clean))


@query
def length_batches(spark, d):
    """Batches of 32 texts of like length for inference, with their padded
    size; results carry the id, so nothing is put back in order."""
    rows = C._docs(spark, d).select("doc_id", F.length("text").cast("long").alias("n"))
    batch = with_rank(rows, ["n", "doc_id"]).withColumn("batch", F.floor(F.col("rank") / 32))
    return batch.groupBy("batch").agg(F.count("*").alias("rows"), F.min("n").alias("shortest"), F.max("n").alias("padded"), F.sum("n").alias("characters"))


# --- frozen test, predictions ----------------------------------------------


def _frozen(spark, d):
    test = C._folds(spark, d).filter("split = 'test'").select("doc_id", "label")
    return C._docs(spark, d).join(test, "doc_id").select(F.format_string("DS1_%06d", "doc_id").alias("record_id"), F.col("label").alias("canonical_label"), F.col("source").alias("source_dataset"), F.col("text").alias("text_raw"), "lang", "doc_id")


@query
def frozen_test(spark, d):
    """The held-out rows under their published names, leading columns first."""
    new = _frozen(spark, d).withColumnsRenamed({"record_id": "source_record_id", "text_raw": "text_original"})
    lead = ["source_record_id", "canonical_label", "source_dataset", "text_original"]
    return new.select(*lead, *sorted(c for c in new.columns if c not in lead))


@query
def frozen_test_hash(spark, d):
    """What a snapshot is checked by: rows, and the digest of rows' digests."""
    rows = frozen_test(spark, d).select(F.sha2(F.concat_ws("|", "source_record_id", F.col("canonical_label").cast("string"), "source_dataset", "text_original"), 256).alias("h"))
    # digests are added up in parts: no task sorts all rows
    part = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"part_{i}") for i in range(4)]
    return rows.agg(F.count("*").alias("n"), *part)


def _logits(spark, d):
    """Two scores of each document: rows of a scorer's output."""
    h = lambda k: K.hash_number(F.lit(k), "doc_id", mod=1000) / 100 - 5
    return C._docs(spark, d).select("doc_id", h("a").alias("z0"), h("b").alias("z1"))


@query
def softmax_predictions(spark, d):
    """Probability of the second class and the larger one (the first, if
    equal), from differences so that nothing overflows."""
    p = 1 / (1 + F.exp(F.col("z0") - F.col("z1")))
    return _logits(spark, d).select("doc_id", F.round(p, 9).alias("probability"), F.when(F.col("z1") > F.col("z0"), 1).otherwise(0).cast("long").alias("predicted_label"))


def _prediction_tables(spark, d):
    rows = C._predictions(spark, d)
    base = rows.select("condition", "doc_id", "source", "y", "changed").distinct()
    normal = rows.filter(F.col("condition") == C.CONDITIONS[0]).select("model", "doc_id", "y_norm")
    return base, normal, rows.select("model", "condition", "doc_id", "y_obf")


@query
def joined_robustness(spark, d):
    """Normal predictions, those of each condition and the condition's rows,
    three tables joined by record id."""
    rows = C._predictions(spark, d)
    normal = rows.filter(F.col("condition") == C.CONDITIONS[0]).select("model", "doc_id", "y_norm")
    base, _, other = _prediction_tables(spark, d)
    joined = other.join(base, ["condition", "doc_id"]).join(normal, ["model", "doc_id"])
    return E.paired(joined, ["model", "condition"])


@query
def stratified_by_key(spark, d):
    """Figures by source: predictions meet their rows by key, never by place."""
    _, _, other = _prediction_tables(spark, d)
    rows = C._docs(spark, d).join(C._t(spark, d, "labels"), "doc_id").select("doc_id", "source", F.col("toxic").cast("long").alias("y"))
    return E.metrics(other.filter("model = 'svm'").join(rows, "doc_id").withColumnRenamed("y_obf", "pred"), ["source"])


@query
def model_comparison(spark, d):
    """Two generations' figures under one another, with true flips, and the
    better one of each condition."""
    rows = C._predictions(spark, d)
    keep = ["generation", "model", "condition", "f1_norm", "f1_obf", "f1_drop", "total_flips"]

    def of(models, generation):
        own = rows.filter(F.col("model").isin(*models))
        return E.paired(own, ["model", "condition"]).join(E.flips(own, ["model", "condition"]).select("model", "condition", "total_flips"), ["model", "condition"]).withColumn("generation", F.lit(generation)).select(*keep)

    both = of(["svm", "cnn"], "v1").unionByName(of(["bert"], "v2"))
    best = both.groupBy("condition").agg(F.max_by("model", F.struct("f1_obf", "model")).alias("winner"))
    return both.join(best, "condition").withColumn("is_winner", F.col("winner") == F.col("model")).drop("winner")


@query
def homoglyph_ablation(spark, d):
    """Sub-words of English documents (the language that the vocabulary is
    counted on) under look-alike changes, raw and normalised, by severity, and of the clean
    texts."""
    docs = C._docs(spark, d).filter("lang = 'en'").select("doc_id", "text")
    words = docs.select(F.explode(F.expr("regexp_extract_all(lower(text), '\\\\S+', 0)")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    changed = O.hash_mode(docs, O.FAMILIES[3], fall_back=None).select(F.when(F.col("fall_back"), "orthographic").otherwise("homoglyph").alias("variant"), "severity", "doc_id", F.col("text_obfuscated").alias("text"))
    every = docs.select(F.lit("clean").alias("variant"), F.lit("none").alias("severity"), "doc_id", "text").unionByName(changed)
    # each as it is and normalised: a text is changed once for both
    forms = F.array(F.struct("variant", "text"), F.struct(F.concat("variant", F.lit("_normalized")).alias("variant"), O.normalize_homoglyphs(F.col("text")).alias("text")))
    rows = every.select("severity", "doc_id", F.explode(forms).alias("x")).select("x.variant", "severity", "doc_id", F.lower("x.text").alias("text"))
    return subwords.text_statistics(rows, ["variant", "severity"], subwords.vocabulary(words))


# --- assertions ------------------------------------------------------------


@query
def dataset_assertions(spark, d):
    """Ten checks of the built dataset; each row counts violations."""
    docs = C._docs(spark, d)
    flags = docs.select("doc_id", "source", "text", "n_chars", K.exact_key(F.col("text")).alias("k"), K.quality_status(K.quality_flags(F.col("text"))).alias("status"))
    final = canonical_by_priority(spark, d)
    overlap = pool.overlap_monotonicity(pool.pairwise_overlap(pool.keyed(docs).drop("text")))
    rest, held = C._pools(spark, d)
    isolated = pool.isolate(rest, held).filter("overlap_level is null")
    counts = C.reconciliation(spark, d)
    total = counts.filter("source = 'TOTAL'").select("raw_rows", "accepted_rows", "review_rows", "invalid_rows")
    sums = counts.filter("source <> 'TOTAL'").agg(F.sum("raw_rows").alias("s"))
    return count_violations({
        "ids_present": docs.filter("doc_id is null"),
        "ids_unique": docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1"),
        "texts_unique": final.join(flags.select("doc_id", "k"), "doc_id").groupBy("k").agg(F.count("*").alias("n")).filter("n > 1"),
        "no_invalid_representative": final.filter("status = 'invalid'"),
        "lengths_match": docs.filter(F.length("text") != F.col("n_chars")),
        "labels_in_domain": C._t(spark, d, "labels").filter("quality not in (0, 1) or toxic not in (0, 1)"),
        "review_is_apart": review_queue(spark, d).filter("reason = 'empty_text'").join(final, "doc_id", "left_semi"),
        "overlap_grows": overlap,
        "held_out_is_apart": isolated.join(held.select("exact_key").distinct(), "exact_key", "left_semi"),
        "totals_add_up": total.join(F.broadcast(sums)).filter("raw_rows <> s or raw_rows <> accepted_rows + review_rows + invalid_rows"),
        "status_known": flags.filter("status not in ('valid', 'suspicious', 'invalid')"),
    })


@query
def split_assertions(spark, d):
    """Eight checks of the split."""
    folds = C._folds(spark, d)
    docs = C._docs(spark, d).select("doc_id", K.exact_key(F.col("text")).alias("k"))
    stats = folds.groupBy("split").agg(F.count("*").alias("n"), F.avg("label").alias("rate"))
    total = folds.agg(F.count("*").alias("all"), F.avg("label").alias("mean"))
    both = stats.join(F.broadcast(total))
    return count_violations({
        "every_row_once": folds.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n <> 1"),
        "no_row_lost": docs.join(folds, "doc_id", "left_anti"),
        "no_row_added": folds.join(docs, "doc_id", "left_anti"),
        "labels_in_domain": folds.filter("label not in (0, 1)"),
        "groups_in_one_split": folds.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1"),
        "texts_in_one_split": folds.join(docs, "doc_id").groupBy("k").agg(F.count_distinct("split").alias("n")).filter("n > 1"),
        "test_is_about_a_tenth": both.filter("split = 'test' and abs(n / all - 0.1) > 0.05"),
        "rates_are_alike": both.filter("abs(rate - mean) > 0.1"),
    })


@query
def obfuscation_assertions(spark, d):
    """Checks of the obfuscated set, by family: text kept where unchanged,
    protected spans, caps on tokens, lengths, and the share that changed."""
    frames = []
    for family in O.FAMILIES:
        got = O.hash_mode(C._docs(spark, d).select("doc_id", "text"), family).withColumn("spans", O.protected_spans())
        ratio = F.length("text_obfuscated") / F.greatest(F.length("text"), F.lit(1))
        cap = F.when(F.col("severity") == "MILD", 1).otherwise(2)
        frames.append(got.agg(F.count_if(~F.col("changed") & (F.col("modified_token_count") > 0)).alias("unchanged_but_counted"), F.count_if(~O.spans_kept("spans", "text_obfuscated")).alias("spans_lost"), F.count_if(F.col("modified_token_count") > cap).alias("over_cap"), F.count_if((ratio < O.MIN_LENGTH_RATIO) | (ratio > O.MAX_LENGTH_RATIO)).alias("length_anomalies"), (F.avg(F.col("changed").cast("double")) < 0.9).cast("long").alias("gate_failed")).withColumn("family", F.lit(family)))
    return pool.union_all(frames)


@query
def pilot_assertions(spark, d):
    """The pilot, written once, against a second run and the source."""
    source = C._docs(spark, d).select("doc_id", "text", C._label().alias("label"))
    rows = source.filter("doc_id < 200")
    made = lambda: O.hash_mode(rows, O.FAMILIES[1]).select("doc_id", "severity", "text", "text_obfuscated", "label")
    control = rows.select("doc_id", F.col("text").alias("text_obfuscated"))
    return checks.pilot_checks(rows, cut(made()), made(), cut(control))


@query
def result_assertions(spark, d):
    """The robustness tables against the labelled records."""
    rows = C._predictions(spark, d)
    records = C._docs(spark, d).join(C._t(spark, d, "labels"), "doc_id").select("doc_id")
    return checks.result_checks(rows, E.paired(rows, ["model", "condition"]), records, len(C.MODELS) * len(C.CONDITIONS))


@query
def data_contract(spark, d):
    """What training asks of its rows: columns, no nulls, two classes, no text
    in both parts."""
    rows = R.require_columns(C._docs(spark, d).join(C._t(spark, d, "labels"), "doc_id"), ["doc_id", "text", "toxic"])
    part = F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train")
    keyed = rows.select("doc_id", "text", "toxic", K.exact_key(F.col("text")).alias("k")).withColumn("part", part)
    return count_violations({
        "null_text": keyed.filter("text is null"),
        "null_label": keyed.filter("toxic is null"),
        "label_not_binary": keyed.filter("toxic not in (0, 1)"),
        "one_class_only": keyed.groupBy("part").agg(F.count_distinct("toxic").alias("n")).filter("n < 2 and part = 'train'"),
        "text_in_both_parts": keyed.groupBy("k").agg(F.count_distinct("part").alias("n")).filter("n > 1"),
    })


# --- SQL -------------------------------------------------------------------

_LABEL, _FLAGS = sql._LABEL, sql._FLAGS
_rank = "CASE WHEN (substr(source, 4)::INT) % 2 = 1 THEN 1 ELSE 2 END"
_CANON = f"""{_FLAGS}, p AS (SELECT doc_id, source, {_rank} AS rank, status, count(*) OVER (PARTITION BY text) AS source_record_count, row_number() OVER (PARTITION BY text ORDER BY {_rank}, doc_id) AS r FROM stated),
canon AS (SELECT doc_id, source, rank, status, source_record_count FROM p WHERE r = 1 AND status <> 'invalid')"""
SQL["canonical_by_priority"] = f"WITH {_CANON} SELECT * FROM canon"
_REVIEW = """rq AS (SELECT doc_id, source, CASE WHEN list_contains(f, 'empty_or_whitespace_text') THEN 'empty_text' WHEN list_contains(f, 'digits_only') THEN 'digits_only' WHEN list_contains(f, 'no_alphanumeric_chars') THEN 'no_letters'
 WHEN list_contains(f, 'control_characters') THEN 'control_characters' WHEN list_contains(f, 'very_short') THEN 'very_short' END AS reason, array_to_string(f, ';') AS flags FROM stated)"""
SQL["review_queue"] = f"WITH {_FLAGS}, {_REVIEW} SELECT * FROM rq WHERE reason IS NOT NULL"
SQL["adjudicated_lookup"] = r"""WITH t AS (SELECT text, min(item_id) AS item_id FROM benchmark GROUP BY text), a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '  ' || text || chr(10) ELSE text END AS text FROM documents UNION ALL SELECT -item_id - 1, chr(9) || text FROM benchmark)
SELECT doc_id, coalesce(x.item_id, y.item_id, -1) AS item_id, CASE WHEN x.item_id IS NOT NULL THEN 'text' WHEN y.item_id IS NOT NULL THEN 'stripped' ELSE 'unmatched' END AS found_by FROM a LEFT JOIN t x ON x.text = a.text LEFT JOIN t y ON y.text = regexp_replace(regexp_replace(a.text, '^\s+', ''), '\s+$', '')"""
SQL["combined_sources"] = """WITH g AS (SELECT min(doc_id) AS doc_id, list_sort(list(DISTINCT source)) AS s FROM documents GROUP BY text) SELECT doc_id, len(s) AS n_sources, s[1] AS first_source, array_to_string(list_reverse(s), '|') AS backwards FROM g"""
SQL["boundary_pairs"] = f"WITH {sql._PAIRS} SELECT * FROM pairs WHERE jaccard BETWEEN 0.65 AND 0.72 ORDER BY jaccard, id_a, id_b LIMIT 100"
SQL["cluster_review_sample"] = f"""WITH RECURSIVE {sql._COMP}, z AS (SELECT root, count(*) AS size FROM comp GROUP BY root)
(SELECT root, size, 'largest' AS why FROM z ORDER BY size DESC, root LIMIT 100) UNION ALL (SELECT root, size, 'small' FROM z WHERE size BETWEEN 2 AND 5 ORDER BY sha256('42|' || root), root LIMIT 100)"""
SQL["reverification_sample"] = " UNION ALL ".join(f"SELECT '{O.FAMILIES[n]}' AS family, * FROM ({sql._changed(n)} SELECT doc_id, severity, out <> text AS changed, {sql._BACK} = text AS restored FROM done QUALIFY row_number() OVER (PARTITION BY severity ORDER BY sha256('42|' || doc_id), doc_id) <= 100)" for n in range(4))
_share = lambda p, k: f"avg(CASE WHEN regexp_matches(text, '{p}') THEN 1.0 ELSE 0.0 END) * 100 AS pct_{k}"
SQL["raw_profile"] = rf"""WITH w AS (SELECT source, text, length(text) AS c, len(regexp_extract_all(text, '\S+')) AS w, length(regexp_replace(text, '[\p{{L}}\p{{N}}\s]', '', 'g'))::DOUBLE / greatest(length(text), 1) AS sy FROM documents)
SELECT source, min(c) AS min_chars, avg(c) AS avg_chars, max(c) AS max_chars, min(w) AS min_words, avg(w) AS avg_words, max(w) AS max_words, {_share("[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]", "emoji")}, {_share("[0-9]", "digits")}, {_share("[^\\x00-\\x7F]", "wide")}, avg(CASE WHEN sy > 0.15 THEN 1.0 ELSE 0.0 END) * 100 AS pct_symbols FROM w GROUP BY source"""
SQL["tfidf_bigrams"] = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents), p AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w WHERE len(w) > 1) SELECT term, count(*) AS df FROM p GROUP BY term HAVING count(*) >= 2"""
_letters = lambda where: rf"SELECT lang, doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}]+')) AS w FROM documents{where}"
SQL["subword_stats"] = "WITH RECURSIVE " + sql.subword_sql(_letters(""), f"SELECT w FROM ({_letters(chr(32) + 'WHERE lang = ' + chr(39) + 'en' + chr(39))})", "lang")
SQL["length_batches"] = "WITH r AS (SELECT doc_id, length(text) AS n FROM documents), b AS (SELECT n, (row_number() OVER (ORDER BY n, doc_id) - 1) // 32 AS batch FROM r) SELECT batch, count(*) AS rows, min(n) AS shortest, max(n) AS padded, sum(n)::BIGINT AS characters FROM b GROUP BY batch"
_FROZEN = f"""{sql._SPLIT}, fz AS (SELECT printf('DS1_%06d', doc_id) AS source_record_id, label AS canonical_label, d.source AS source_dataset, d.text AS text_original, doc_id, lang FROM folds JOIN documents d USING (doc_id) WHERE split = 'test')"""
SQL["frozen_test"] = f"WITH RECURSIVE {_FROZEN} SELECT * FROM fz"
_parts = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::BIGINT AS part_{i}" for i in range(4))
SQL["frozen_test_hash"] = f"WITH RECURSIVE {_FROZEN}, hs AS (SELECT sha256(concat_ws('|', source_record_id, canonical_label::VARCHAR, source_dataset, text_original)) AS h FROM fz) SELECT count(*) AS n, {_parts} FROM hs"
_th = lambda k: f"(('0x' || substr(md5('{k}' || doc_id), 1, 4))::BIGINT % 1000)::DOUBLE / 100 - 5"
SQL["softmax_predictions"] = f"WITH z AS (SELECT doc_id, {_th('a')} AS z0, {_th('b')} AS z1 FROM documents) SELECT doc_id, round(1 / (1 + exp(z0 - z1)), 9) AS probability, CASE WHEN z1 > z0 THEN 1 ELSE 0 END::BIGINT AS predicted_label FROM z"
_NORMAL = "nm AS (SELECT model, doc_id, y_norm AS yn FROM pred WHERE condition = 'O1_MILD')"
_PAIRED3 = sql._PAIRED.replace("FROM pred WHERE changed GROUP BY 1, 2)", "FROM three WHERE changed GROUP BY 1, 2)", 1).replace(", c AS (SELECT model, condition, count(*) AS n_changed_pairs", f", {_NORMAL}, three AS (SELECT p.* REPLACE (yn AS y_norm) FROM pred p JOIN nm USING (model, doc_id)), c AS (SELECT model, condition, count(*) AS n_changed_pairs", 1)
SQL["joined_robustness"] = f"WITH {_PAIRED3} SELECT * FROM paired"
SQL["stratified_by_key"] = f"WITH {sql._PRED}, c AS (SELECT source, {sql._cells('y_obf')} FROM pred WHERE model = 'svm' GROUP BY 1) SELECT *, {sql._figs()} FROM c"
SQL["model_comparison"] = f"""WITH {sql._PAIRED}, fl AS (SELECT model, condition, count_if(y_norm <> y_obf)::BIGINT AS total_flips FROM pred WHERE changed GROUP BY 1, 2), m AS (SELECT CASE WHEN model = 'bert' THEN 'v2' ELSE 'v1' END AS generation, model, condition, f1_norm, f1_obf, f1_drop, total_flips FROM paired JOIN fl USING (model, condition))
SELECT *, row_number() OVER (PARTITION BY condition ORDER BY f1_obf DESC, model DESC) = 1 AS is_winner FROM m"""


def _variant(changed: str, name: str) -> str:
    return f"SELECT '{name}' AS variant, severity, doc_id, out AS text FROM ({changed} SELECT * FROM done) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') UNION ALL SELECT '{name}_normalized', severity, doc_id, {sql._BACK} FROM ({changed} SELECT * FROM done) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"


_only = sql._changed(3).replace("WHEN lower(c) IN ('a', 'e', 'i', 'o', 'u') THEN 1 WHEN p > 1 AND p < n AND regexp_matches(c, '[\\p{L}\\p{N}]') THEN 2 END", "END")
_VARIANTS = f"""SELECT 'clean' AS variant, 'none' AS severity, doc_id, text FROM documents WHERE lang = 'en' UNION ALL SELECT 'clean_normalized', 'none', doc_id, translate(text, '{O.LOOKALIKE_TO}', '{O.LOOKALIKE_FROM}') FROM documents WHERE lang = 'en'
 UNION ALL {_variant(_only, "homoglyph")} UNION ALL {_variant(sql._changed(3), "orthographic")}"""
_seen = "SELECT variant, severity, doc_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS w FROM vr"
SQL["homoglyph_ablation"] = f"WITH RECURSIVE vr AS ({_VARIANTS}), " + sql.subword_sql(_seen, f"SELECT w FROM ({_seen}) WHERE variant = 'clean'", "variant, severity")


SQL["dataset_assertions"] = f"""WITH {_CANON} SELECT 'ids_present' AS "check", count(*) AS violations FROM documents WHERE doc_id IS NULL UNION ALL SELECT 'ids_unique', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'texts_unique', count(*) FROM (SELECT text FROM documents JOIN canon USING (doc_id) GROUP BY text HAVING count(*) > 1) UNION ALL SELECT 'no_invalid_representative', count(*) FROM canon WHERE status = 'invalid'
UNION ALL SELECT 'lengths_match', count(*) FROM documents WHERE length(text) <> n_chars UNION ALL SELECT 'labels_in_domain', count(*) FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)
UNION ALL SELECT 'overlap_grows', count(*) FROM ({sql.ORACLE["overlap_monotonicity"]}) UNION ALL SELECT 'review_is_apart', count(*) FROM (WITH {_FLAGS}, {_REVIEW} SELECT doc_id FROM rq WHERE reason = 'empty_text') JOIN canon USING (doc_id)
UNION ALL SELECT 'held_out_is_apart', count(*) FROM ({sql.ORACLE["isolate_pool"]}) i JOIN documents d USING (doc_id) WHERE i.overlap_level IS NULL AND d.text IN (SELECT text FROM documents WHERE source = 'src0' UNION ALL SELECT text FROM benchmark)
UNION ALL SELECT 'totals_add_up', count(*) FROM ({sql.ORACLE["reconciliation"]}) t WHERE source = 'TOTAL' AND (raw_rows <> (SELECT count(*) FROM documents) OR raw_rows <> accepted_rows + review_rows + invalid_rows)
UNION ALL SELECT 'status_known', count(*) FROM stated WHERE status NOT IN ('valid', 'suspicious', 'invalid')"""
SQL["split_assertions"] = f"""WITH RECURSIVE {sql._SPLIT}, st AS (SELECT split, count(*) AS n, avg(label) AS rate FROM folds GROUP BY 1), al AS (SELECT count(*) AS a, avg(label) AS m FROM folds)
SELECT 'groups_in_one_split' AS "check", count(*) AS violations FROM (SELECT g FROM folds GROUP BY g HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'test_is_about_a_tenth', count(*) FROM st, al WHERE split = 'test' AND abs(n / a - 0.1) > 0.05
UNION ALL SELECT 'rates_are_alike', count(*) FROM st, al WHERE abs(rate - m) > 0.1 UNION ALL SELECT 'every_row_once', count(*) FROM (SELECT doc_id FROM folds GROUP BY 1 HAVING count(*) <> 1) UNION ALL SELECT 'no_row_lost', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM folds)
UNION ALL SELECT 'texts_in_one_split', count(*) FROM (SELECT text FROM folds JOIN documents USING (doc_id) GROUP BY text HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'no_row_added', count(*) FROM folds WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'labels_in_domain', count(*) FROM folds WHERE label NOT IN (0, 1)"""
_obf = " UNION ALL ".join(f"SELECT '{O.FAMILIES[n]}' AS family, * FROM ({sql._changed(n)} SELECT severity, text, out, changes FROM done)" for n in range(4))
SQL["obfuscation_assertions"] = rf"""WITH o AS ({_obf}), s AS (SELECT *, list_concat(list_concat(regexp_extract_all(text, '(?i)https?://\S+|www[.]\S+'), regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}')), list_filter(regexp_extract_all(text, '\S+'), lambda x: regexp_matches(x, '^[@#].'))) AS sp FROM o)
SELECT family, count_if(out = text AND changes > 0)::BIGINT AS unchanged_but_counted, count_if(len(list_filter(sp, lambda x: NOT contains(out, x))) > 0)::BIGINT AS spans_lost, count_if(changes > CASE WHEN severity = 'MILD' THEN 1 ELSE 2 END)::BIGINT AS over_cap,
 count_if(length(out)::DOUBLE / greatest(length(text), 1) NOT BETWEEN 0.5 AND 2.0)::BIGINT AS length_anomalies, (avg(CASE WHEN out <> text THEN 1.0 ELSE 0.0 END) < 0.9)::BIGINT AS gate_failed FROM s GROUP BY family"""
SQL["pilot_assertions"] = f"""WITH p AS (SELECT x.*, {_LABEL.replace("doc_id", "x.doc_id")} AS label FROM ({sql._changed(1)} SELECT doc_id, severity, text, out FROM done WHERE doc_id < 200) x)
SELECT 'deterministic' AS "check", count(*) AS violations FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM p) UNION ALL SELECT 'original_text', count(*) FROM p JOIN documents d USING (doc_id) WHERE p.text <> d.text UNION ALL SELECT 'label_kept', count(*) FROM p WHERE label <> {_LABEL}
UNION ALL SELECT 'control_unchanged', count(*) FROM (SELECT text FROM documents WHERE doc_id < 200 EXCEPT ALL SELECT text FROM documents) UNION ALL SELECT 'both_severities', count(*) FROM (SELECT doc_id FROM p GROUP BY doc_id HAVING count(*) <> 2 OR count(DISTINCT severity) <> 2)"""
SQL["result_assertions"] = f"""WITH {sql._PAIRED}, rec AS (SELECT doc_id FROM documents JOIN labels USING (doc_id)), per AS (SELECT model, condition, count(*) AS n, count(DISTINCT doc_id) AS ids FROM pred GROUP BY 1, 2)
SELECT 'files' AS "check", count(*) AS violations FROM (SELECT count(*) AS n FROM per) WHERE n <> 24 UNION ALL SELECT 'rows_of_each', count(*) FROM per WHERE n <> (SELECT count(*) FROM rec) UNION ALL SELECT 'ids_unique', count(*) FROM per WHERE n <> ids
UNION ALL SELECT 'ids_known', count(*) FROM pred WHERE doc_id NOT IN (SELECT doc_id FROM rec) UNION ALL SELECT 'binary', count(*) FROM pred WHERE y_norm NOT IN (0, 1) OR y_obf NOT IN (0, 1)
UNION ALL SELECT 'figures_in_range', count(*) FROM paired WHERE f1_norm NOT BETWEEN 0 AND 1 OR f1_obf NOT BETWEEN 0 AND 1 UNION ALL SELECT 'drops_add_up', count(*) FROM paired WHERE abs(f1_norm - f1_obf - f1_drop) > 1e-12"""
SQL["data_contract"] = """WITH r AS (SELECT doc_id, text, toxic FROM documents JOIN labels USING (doc_id)) SELECT 'null_text' AS "check", count(*) AS violations FROM r WHERE text IS NULL UNION ALL SELECT 'null_label', count(*) FROM r WHERE toxic IS NULL
UNION ALL SELECT 'label_not_binary', count(*) FROM r WHERE toxic NOT IN (0, 1) UNION ALL SELECT 'one_class_only', CASE WHEN count(DISTINCT toxic) < 2 THEN 1 ELSE 0 END FROM r WHERE doc_id % 10 <> 0
UNION ALL SELECT 'text_in_both_parts', count(*) FROM (SELECT text FROM r GROUP BY text HAVING count(DISTINCT doc_id % 10 = 0) > 1)"""

"""Checks of a pilot set and of result tables; each row counts violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.expect import count_violations


def pilot_checks(source: DataFrame, made: DataFrame, again: DataFrame, control: DataFrame) -> DataFrame:
    """``made`` (doc_id, severity, text, text_obfuscated, label) of ``source``
    (doc_id, text, label): a second run gives the same rows, originals and
    labels are the source's, the ``control`` (doc_id, text_obfuscated) is the
    source unchanged, and each record has both severities."""
    of = source.select("doc_id", F.col("text").alias("raw"), F.col("label").alias("own"))
    joined = made.join(of, "doc_id", "left")
    return count_violations({
        "deterministic": made.exceptAll(again).unionByName(again.exceptAll(made)),
        "original_text": joined.filter("not (text <=> raw)"),
        "label_kept": joined.filter("not (label <=> own)"),
        "control_unchanged": control.join(of, "doc_id", "full_outer").filter("not (text_obfuscated <=> raw)"),
        "both_severities": made.groupBy("doc_id").agg(F.count_distinct("severity").alias("k"), F.count("*").alias("n")).filter("n <> 2 or k <> 2"),
    })


def result_checks(rows: DataFrame, figures: DataFrame, records: DataFrame, files: int) -> DataFrame:
    """Prediction ``rows`` (model, condition, doc_id, y_norm, y_obf) and their
    ``figures`` (f1_norm, f1_obf, f1_drop) against the labelled ``records``
    (doc_id): as many files as expected, a row of each for every record and no
    other, binary predictions, figures between 0 and 1, drops that add up."""
    per = rows.groupBy("model", "condition").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))
    want = records.agg(F.count("*").alias("want"))
    return count_violations({
        "files": per.agg(F.count("*").alias("n")).filter(F.col("n") != files),
        "rows_of_each": per.join(F.broadcast(want)).filter("n <> want"),
        "ids_unique": per.filter("n <> ids"),
        "ids_known": rows.join(records.select("doc_id").distinct(), "doc_id", "left_anti"),
        "binary": rows.filter("not coalesce(y_norm in (0, 1) and y_obf in (0, 1), false)"),
        "figures_in_range": figures.filter("not coalesce(f1_norm between 0 and 1 and f1_obf between 0 and 1, false)"),
        "drops_add_up": figures.filter("not coalesce(abs(f1_norm - f1_obf - f1_drop) <= 1e-12, false)"),
    })

"""Every check of the pilot and of the result tables finds what is planted for it."""

import pytest
from pyspark.sql import functions as F

from textmill.operators import checks


def found(df):
    return {r.check: r.violations for r in df.collect() if r.violations}


@pytest.fixture(scope="module")
def pilot(spark):
    source = spark.createDataFrame([(i, f"text {i}", i % 2) for i in range(6)], "doc_id long, text string, label long")
    made = source.withColumn("severity", F.explode(F.array(F.lit("MILD"), F.lit("STRONG")))).withColumn("text_obfuscated", F.concat("text", F.lit("!")))
    return source, made, source.select("doc_id", F.col("text").alias("text_obfuscated"))


@pytest.mark.parametrize("planted", ["none", "deterministic", "original_text", "label_kept", "control_unchanged", "both_severities"])
def test_pilot(pilot, planted):
    source, made, control = pilot
    other = F.col("doc_id") == 3
    bad = {
        "original_text": made.withColumn("text", F.when(other, "else").otherwise(F.col("text"))),
        "label_kept": made.withColumn("label", F.when(other, 1 - F.col("label")).otherwise(F.col("label"))),
        "both_severities": made.filter(~other | (F.col("severity") == "MILD")),
    }.get(planted, made)
    again = made.withColumn("text_obfuscated", F.when(other, "?").otherwise(F.col("text_obfuscated"))) if planted == "deterministic" else bad
    kept = control.filter(~other) if planted == "control_unchanged" else control
    want = {} if planted == "none" else {planted: {"deterministic": 4, "control_unchanged": 1, "both_severities": 1}.get(planted, 2)}
    assert found(checks.pilot_checks(source, bad, again, kept)) == want


@pytest.mark.parametrize("planted", ["none", "files", "rows_of_each", "ids_unique", "ids_known", "binary", "figures_in_range", "drops_add_up"])
def test_results(spark, planted):
    records = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    rows = [(m, c, i, 0, 1) for m in ("a", "b") for c in ("x", "y") for i in range(5)]
    figures = [("a", 0.5, 0.25, 0.25)]
    if planted == "files":
        rows = [r for r in rows if r[:2] != ("b", "y")]
    elif planted == "rows_of_each":
        rows = rows[:-1]
    elif planted == "ids_unique":
        rows[0] = (*rows[0][:2], 1, 0, 1)
    elif planted == "ids_known":
        rows[0] = (*rows[0][:2], 99, 0, 1)
    elif planted == "binary":
        rows[0], rows[1] = (*rows[0][:3], 2, 0), (*rows[1][:3], 0, None)
    elif planted == "figures_in_range":
        figures.append(("b", 1.5, 0.5, 1.0))
    elif planted == "drops_add_up":
        figures.append(("b", 0.5, 0.25, 0.2))
    got = checks.result_checks(spark.createDataFrame(rows, "model string, condition string, doc_id long, y_norm int, y_obf int"), spark.createDataFrame(figures, "model string, f1_norm double, f1_obf double, f1_drop double"), records, 4)
    assert found(got) == ({} if planted == "none" else {planted: 2 if planted == "binary" else 1})

"""Confusion figures, paired robustness, flips, strata, bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(y: str, p: str, suffix: str = "") -> list[Column]:
    cell = lambda a, b: F.count_if((F.col(y) == a) & (F.col(p) == b))
    return [cell(0, 0).alias("tn" + suffix), cell(0, 1).alias("fp" + suffix), cell(1, 0).alias("fn" + suffix), cell(1, 1).alias("tp" + suffix)]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def figures(suffix: str = "") -> dict[str, Column]:
    """Precision, recall, F1 of class 1, accuracy, macro-F1; 0 for 0 / 0."""
    tn, fp, fn, tp = (F.col(k + suffix) for k in ("tn", "fp", "fn", "tp"))
    f1, f0 = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    got = {"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": f1, "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "macro_f1": (f1 + f0) / 2}
    return {k + suffix: v for k, v in got.items()}


def metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "pred") -> DataFrame:
    return df.groupBy(*by).agg(*confusion(y, p)).withColumns(figures())


def paired(df: DataFrame, by: list[str]) -> DataFrame:
    """From rows (y, y_norm, y_obf, changed): changed pairs only."""
    got = df.filter("changed").groupBy(*by).agg(F.count("*").alias("n_changed_pairs"), *confusion("y", "y_norm", "_norm"), *confusion("y", "y_obf", "_obf")).withColumns(figures("_norm") | figures("_obf"))
    drop = F.col("f1_norm") - F.col("f1_obf")
    return got.withColumns({"f1_drop": drop, "relative_drop_pct": F.try_divide(drop, F.col("f1_norm")) * 100, "retention_pct": F.try_divide(F.col("f1_obf"), F.col("f1_norm")) * 100})


def flips(df: DataFrame, by: list[str]) -> DataFrame:
    c = lambda *x: F.count_if((F.col("y") == x[0]) & (F.col("y_norm") == x[1]) & (F.col("y_obf") == x[2]))
    got = df.filter("changed").groupBy(*by).agg(F.count("*").alias("n_changed_pairs"), F.count_if((F.col("y") == 1) & (F.col("y_norm") == 1)).alias("n_tp_normal"), c(1, 1, 0).alias("evasion"), c(1, 0, 1).alias("recovery"), c(0, 0, 1).alias("new_fp"), F.count_if(F.col("y_norm") != F.col("y_obf")).alias("total_flips"))
    return got.withColumn("evasion_rate_pct", _ratio(F.col("evasion") * 100, F.col("n_tp_normal")))


def bootstrap_cells(cells: dict[tuple[int, int, int], int], n: int, seed: int) -> np.ndarray:
    """F1 drops of n resamples within each class: an F1 needs the eight cell
    counts only, so a resample is two multinomial draws."""
    rng = np.random.default_rng(seed)
    keys = [(a, b) for a in (0, 1) for b in (0, 1)]
    draws = {}
    for y in (0, 1):
        have = np.array([cells.get((y, *k), 0) for k in keys], float)
        total = int(have.sum())
        draws[y] = rng.multinomial(total, have / total, n) if total else np.zeros((n, 4), int)

    def f1(which: int) -> np.ndarray:
        on = [i for i, k in enumerate(keys) if k[which] == 1]
        tp, fp = draws[1][:, on].sum(1), draws[0][:, on].sum(1)
        den = tp + fp + draws[1].sum(1)
        return np.divide(2.0 * tp, den, out=np.zeros(n), where=den > 0)

    return f1(0) - f1(1)


def bootstrap_ci(df: DataFrame, by: list[str], n: int = 10_000, seed: int = 42) -> DataFrame:
    """mean, std and 95 % limits of the F1 drop for each group of ``by``."""
    cells = df.filter("changed").groupBy(*by, "y", "y_norm", "y_obf").agg(F.count("*").alias("n"))

    def resampled(key, pdf):
        d = bootstrap_cells({(int(r.y), int(r.y_norm), int(r.y_obf)): int(r.n) for r in pdf.itertuples()}, n, seed)
        return pd.DataFrame([[*key, d.mean(), d.std(), *np.percentile(d, [2.5, 97.5])]], columns=[*by, "drop_mean", "drop_std", "ci_95_lower", "ci_95_upper"])

    schema = ", ".join([*(f"{c} {t}" for c, t in df.dtypes if c in by)] + [f"{c} double" for c in ("drop_mean", "drop_std", "ci_95_lower", "ci_95_upper")])
    order = [c for c, _ in df.dtypes if c in by]
    return cells.groupBy(*order).applyInPandas(resampled, schema) if order == by else bootstrap_ci(df.select(*by, *[c for c in df.columns if c not in by]), by, n, seed)


def better(a: dict, b: dict, tolerance: float = 1e-5) -> bool:
    """Candidate order: F1, precision, recall, macro-F1, unigrams, small C."""
    for k in ("f1", "precision", "recall", "macro_f1"):
        if abs(a[k] - b[k]) > tolerance:
            return a[k] > b[k]
    if a["unigram"] != b["unigram"]:
        return a["unigram"]
    return a["c"] < b["c"]


def best_candidate(rows: list[dict]) -> dict:
    best = rows[0]
    for r in rows[1:]:
        if better(r, best):
            best = r
    return best

"""All similar pairs against brute force, and what their search makes."""

import random

import pytest

from test_nearcopies import family
from textmill.operators import nearcopies, shingles


@pytest.mark.parametrize("seed", [4, 5])
def test_pairs_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [a + b for a in "bcdfg" for b in ("a", "e", "io", "u")]
    texts = ["", "abc", "abcd", "ABCD", " abcd ", "a  b c d", "a b c d", "A B\tC D", "a b", None]
    for n, copies, edits in ((4, 12, 1), (9, 30, 3), (12, 30, 2), (31, 20, 3), (120, 12, 30)):
        texts += family(rng, words, n, copies, edits)
    texts += [t.upper() for t in texts[20:40]] + texts[30:50]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    first = {}
    for i, t in zip(ids, texts, strict=True):
        if t is not None:
            first[t] = min(i, first.get(t, i))
    sets = {}
    for t, i in first.items():
        w = t.lower().split()
        sets[i] = set() if len(t) < 4 else {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)} if len(w) > 1 else {w[0] if w else ""}
    j = lambda x, y: len(x & y) / len(x | y)
    want = {(a, b): round(j(sets[a], sets[b]), 4) for a in sets for b in sets if a < b and sets[a] and sets[b] and j(sets[a], sets[b]) >= 0.65}
    got = [((r.id_a, r.id_b), r.jaccard) for r in shingles.exact_pairs(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()]
    assert len(got) == len(want) > 100 and all(abs(want[k] - v) < 1.01e-4 for k, v in got)
    assert shingles.exact_pairs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_shingles_text_is_shuffled(spark):
    """Sets are looked for by 64-bit numbers, which are shorter than shingles."""
    df = spark.createDataFrame([(0, "a b c d"), (1, "a b c e")], "doc_id long, text string")
    plan = shingles.exact_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "array<string>" not in plan and "concat(" not in plan and "explode(shingles" not in plan
    assert nearcopies.similar_pairs(df.limit(1)).collect() == []

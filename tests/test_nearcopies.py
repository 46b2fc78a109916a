"""Clusters of near copies against all pairs, and what they cost."""

import itertools
import random

import pytest

from textmill.operators import nearcopies


def plain(rows, t=0.65):
    first = {}
    for i, text in rows:
        if text is not None and (text not in first or i < first[text]):
            first[text] = i
    sets = {}
    for text, i in first.items():
        w = text.lower().split()
        sets[i] = set() if len(text) < 4 else {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)} if len(w) > 1 else {w[0] if w else ""}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) / len(x | y) >= t:
            up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}


def family(rng, words, n, copies, edits):
    base = [rng.choice(words) for _ in range(n)]
    for _ in range(copies):
        got = list(base)
        for _ in range(rng.randrange(edits + 1)):
            got[rng.randrange(n)] = rng.choice(words) + str(rng.randrange(99))
        yield " ".join(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_are_those_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = [a + b for a in "bcdfg" for b in ("a", "e", "io", "u")]
    texts = ["", "ab", "abcd", "ABCD", " abcd ", "a  b c d", "a b c d", "a b", "a b ", None]
    for n, copies, edits in ((4, 12, 1), (9, 40, 3), (12, 30, 2), (30, 40, 9), (31, 20, 3), (200, 12, 40)):
        for _ in range(3):
            texts += family(rng, words, n, copies, edits)
    # a chain: each is near the next only
    chain = [f"k{i}" for i in range(90)]
    texts += [" ".join(chain[i * 3 : i * 3 + 20]) for i in range(22)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True)) + [(len(ids) + i, t) for i, t in enumerate(texts[20:60])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.root for r in nearcopies.clusters(df).collect()} == plain(rows)
    assert nearcopies.clusters(df.limit(0)).collect() == []


def test_a_family_costs_a_star(spark):
    """Copies of a template, each with words of its own, and strangers that
    share a line with it: links grow with the rows, not with their square."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    template = [rng.choice(words) + str(i) for i in range(40)]
    rows = [(i, " ".join([*template[:37], f"own{i}", f"more{i}", template[39]])) for i in range(1500)]
    rows += [(2000 + i, " ".join([*template[:12], *(f"x{i}y{j}" for j in range(12))])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = nearcopies.shingle_sets(df).selectExpr("doc_id as id", "h", "n")
    found = nearcopies.prefixes(sets, 0.65)
    stars = nearcopies.star_links(found, sets, 0.65)
    assert stars.count() < 3 * len(rows)
    labels = stars.groupBy("b").agg({"a": "min"}).toDF("id", "label")
    assert nearcopies.cross_links(found, labels, sets, 0.65).count() == 0
    assert nearcopies.clusters(df).filter("root = 0").count() == 1500

import pytest
from pyspark.sql import functions as F

from textmill.functions import keys as K
from textmill.operators import evaluate as E
from textmill.operators import graph, pool, shingles
from textmill.operators import obfuscate as O
from textmill.operators import split as S


def test_keys_collapse_spellings(spark):
    rows = [("TOKE69",), ("𝗧𝗢𝗞𝗘𝟲𝟵",), ("ＴＯＫＥ６９",), ("T O K E 6 9",)]
    got = spark.createDataFrame(rows, "t string").select(K.exact_key(F.col("t")).alias("e"), K.normalized_key(F.col("t")).alias("n"), K.alnum_key(F.col("t")).alias("a")).collect()
    assert len({r.e for r in got}) == 4 and len({r.n for r in got[:3]}) == 1
    assert got[3].n != got[0].n and len({r.a for r in got}) == 1


def test_alnum_key_of_nothing_is_null(spark):
    assert spark.createDataFrame([("!!",)], "t string").select(K.alnum_key(F.col("t"))).first()[0] is None


def test_quality_flags(spark):
    rows = [("",), (None,), ("ok",), ("12 34 56",), ("see www.x.id now",), ("a\tb c d",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(K.quality_flags(F.col("t"))).collect()]
    assert got[0] == got[1] == ["empty_or_whitespace_text"]
    assert "very_short" in got[2] and "digits_only" in got[3] and "has_url" in got[4] and "whitespace_anomaly" in got[5]


def test_seeded_vectors():
    cases = {
        "DS2_017670": ("Kamari punya ekspresi yang lucu dan natural 😂😂😂😂❤🎉", "Kаmari punya ekspresi yang lucu dan naturаl 😂😂😂😂❤🎉"),
        "DS2_022370": ("Ya BG kalau dijadiin series keren tuh", "Ya BG kalau dijadiin seriеs kerеn tuh"),
        "DS1_005020": ("Jualan produk ramah anak, pasarnya selalu ramai! 🧸", "Jualan рroduk rаmah anak, pasarnya selalu ramai! 🧸"),
        "DS2_024177": ("Aku Pulang Sekolah Nonton frost diamon ❤❤❤❤", "Aku Pulang Sekolah Nonton frоst diamоn ❤❤❤❤"),
    }
    for rid, (text, want) in cases.items():
        assert O.mt_obfuscate(text, rid, O.FAMILIES[3], "STRONG") == (want, 2)


def test_no_eligible_target():
    for text in ("123 456", "👍 🔥 ❤️", "di ke ya", "https://slot.com"):
        for family in O.FAMILIES:
            assert O.mt_obfuscate(text, "R", family, "STRONG") == (text, 0)


def test_hash_mode_keeps_protected_and_caps(spark):
    texts = ["kunjungi https://example.com/daftar sekarang juga", "hubungi admin@judi99.com sekarang", "follow @slotgacor dan gunakan #maxwin sekarang", "  daftar di situs slot gacor  sekarang\n"]
    rows = spark.createDataFrame([(i, t, s) for i, t in enumerate(texts) for s in O.SEVERITIES], "doc_id long, text string, severity string")
    for family in O.FAMILIES:
        got = O.edit_figures(O.hash_mode(rows, family)).collect()
        for r in got:
            assert r.changed and r.modified_token_count <= (1 if r.severity == "MILD" else 2) and 1 <= r.modified_char_count <= 4
            for span in ("https://example.com/daftar", "admin@judi99.com", "@slotgacor", "#maxwin"):
                assert (span in r.text) == (span in r.text_obfuscated)


def test_confusion_fixture(spark):
    rows = list(zip([0, 0, 0, 0, 1, 1, 1, 1], [0, 0, 0, 1, 0, 1, 1, 1], strict=True))
    r = E.metrics(spark.createDataFrame(rows, "y int, pred int"), []).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (3, 1, 1, 3) and r.precision == r.recall == r.f1 == r.accuracy == 0.75


def test_flips_fixture(spark):
    rows = [(1, 1, 0, True), (1, 1, 1, True), (1, 0, 0, True), (0, 0, 0, True)]
    r = E.flips(spark.createDataFrame(rows, "y int, y_norm int, y_obf int, changed boolean"), []).first()
    assert r.n_tp_normal == 2 and r.evasion == 1 and r.evasion_rate_pct == 50.0


def test_bootstrap_published_row():
    # a published row: 3,973 pairs, drop 0.03105, limits 0.01916 and 0.04447
    cells = {(1, 1, 0): 20, (1, 1, 1): 433, (1, 0, 1): 1, (1, 0, 0): 40, (0, 0, 1): 13, (0, 1, 1): 9, (0, 1, 0): 3, (0, 0, 0): 3454}
    import numpy as np

    low, high = np.percentile(E.bootstrap_cells(cells, 10_000, 1), [2.5, 97.5])
    assert abs(low - 0.019161915500419645) < 0.002 and abs(high - 0.04447409196363997) < 0.002


def test_best_candidate_chain():
    base = {"f1": 0.9, "precision": 0.9, "recall": 0.9, "macro_f1": 0.9, "unigram": False, "c": 1.0}
    assert E.best_candidate([base, base | {"f1": 0.91}])["f1"] == 0.91
    assert E.best_candidate([base, base | {"f1": 0.900001, "precision": 0.8}])["precision"] == 0.9
    assert E.best_candidate([base, base | {"unigram": True}])["unigram"] and E.best_candidate([base, base | {"c": 0.1}])["c"] == 0.1


@pytest.mark.parametrize("hub", [500, 3])
def test_components_against_union_find(spark, monkeypatch, hub):
    import random

    monkeypatch.setattr(graph, "HUB_LINKS", hub)
    monkeypatch.setattr(graph, "HUBS", 10**6)
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(150, rng.randrange(200)) for _ in range(12)] + [(i, i + 1) for i in range(170, 190)]
    up = list(range(200))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == find(i) for i in range(200))


def test_exact_pairs_brute_force(spark):
    words = "alpha beta gamma delta eps zeta eta theta".split()
    import random

    rng = random.Random(2)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["", "hi"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)

    def sh(t):
        w = t.split()
        return set() if len(t) < 4 else {a + " " + b for a, b in zip(w, w[1:])} if len(w) > 1 else {t}

    want = {(i, j) for t, i in first.items() for u, j in first.items() if i < j and sh(t) and sh(u) and len(sh(t) & sh(u)) / len(sh(t) | sh(u)) >= 0.65}
    assert {(r.id_a, r.id_b) for r in shingles.exact_pairs(docs).collect()} == want


def test_isolation_by_each_key_and_by_near_copies(spark):
    held = "the quick brown fox jumps over the lazy dog near the old stone bridge at dawn"
    near = held.replace("dawn", "noon")
    far = near.replace("quick brown", "slow red")  # near the near copy, not near what is held out
    rows = [(-1, held, True), (-2, None, True), (1, held, False), (2, held.replace(" ", "  "), False), (3, held.upper(), False), (4, near, False), (5, far, False), (6, "something else that nobody has written before", False), (7, None, False), (8, "", False)]
    got = pool.with_near_duplicates(pool.keyed(spark.createDataFrame(rows, "doc_id long, text string, held boolean")))
    out = pool.isolate(got.filter("not held"), got.filter("held")).select("doc_id", "overlap_level").collect()
    assert dict(map(tuple, out)) == {1: "exact", 2: "whitespace", 3: "normalized", 4: "near_duplicate", 5: "near_duplicate", 6: None, 7: None, 8: None}
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t, _ in rows if t}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert share(-1, 5) < 0.65 <= min(share(-1, 4), share(4, 5))


def test_overlap_that_shrinks_is_reported(spark):
    names = "dataset_a string, dataset_b string, " + ", ".join(f"shared_{k}_groups long" for k in pool.LEVELS)
    rows = [("a", "b", 3, 3, 4, 4), ("a", "c", 3, 2, 4, 4), ("b", "c", 1, 1, 1, 0)]
    assert {tuple(r) for r in pool.overlap_monotonicity(spark.createDataFrame(rows, names)).collect()} == {("a", "c"), ("b", "c")}


def test_edit_distance():
    import random

    from textmill.operators.obfuscate import edit_distance

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choices("ab", k=rng.randrange(12)))
        b = "".join(rng.choices("ab", k=rng.randrange(12)))
        want = plain(a, b)
        assert edit_distance(a, b, 4) == (want if want <= 4 else -1)
    long = "".join(rng.choices("abc ", k=300))
    assert edit_distance(long, long[:100] + "x" + long[100:250] + long[251:]) == plain(long, long[:100] + "x" + long[100:250] + long[251:])

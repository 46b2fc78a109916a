import numpy as np

from textmill.operators import charcnn as C


def _slow(p, text):
    """All responses at once, by the definition."""
    ids = [ord(c) % C.SYMBOLS for c in text or ""]
    ids += [0] * (max(C.WIDTHS) - len(ids))
    best = [max(sum(p["emb"][ids[i + j]] @ p[f"w{w}"][j * C.DIM : (j + 1) * C.DIM, f] for j in range(w)) + p[f"b{w}"][f] for i in range(len(ids) - w + 1)) for w in C.WIDTHS for f in range(C.FILTERS)]
    return np.array(best)


def test_responses_by_definition_over_piece_borders(monkeypatch):
    monkeypatch.setattr(C, "PIECE", 7)
    p = C.start()
    for text in ("", None, "ab", "né 😀 text that is longer than a piece"):
        assert np.allclose(C.pooled(p, C.symbols(text))[0], _slow(p, text))


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    p = C.start(3)
    for text, y in (("buy now at a bonus link", 1.0), ("", 0.0), ("aaaaaaa", 0.0)):
        got = {k: np.zeros_like(v) for k, v in p.items()}
        C.gradient(p, text, y, 0.7, got)
        for k in p:
            for at in rng.choice(p[k].size, min(20, p[k].size), replace=False):
                loss = []
                for e in (1e-6, -1e-6):
                    q = {n: v.copy() for n, v in p.items()}
                    q[k].ravel()[at] += e
                    loss.append(C.gradient(q, text, y, 0.7, {n: np.zeros_like(v) for n, v in p.items()}))
                assert abs((loss[0] - loss[1]) / 2e-6 - got[k].ravel()[at]) < 1e-5, (k, at)


def test_learns_a_pattern_anywhere_in_the_text(spark):
    rng = np.random.default_rng(2)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    rows = [(i, f"{words(8)}{' wxyz ' if i % 3 == 0 else ' '}{words(rng.integers(1, 9))}", int(i % 3 == 0)) for i in range(300)]
    rows += [(300, None, None), (301, "no label", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    p = C.fit(df.filter("doc_id < 200 or y is null"), "y", steps=25)
    got = {r.doc_id: r.predicted_label for r in C.predict(p, df).collect()}
    assert len(got) == 302 and np.mean([got[i] == y for i, _, y in rows[200:300]]) > 0.95
    again = C.fit(df.limit(0), "y")
    assert all((again[k] == v).all() for k, v in C.start().items()) and C.predict(p, df.limit(0)).count() == 0

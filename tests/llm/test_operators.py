"""Each operator against a brute-force version, a round trip or held-out
accuracy, and on nulls, empty texts and tables, ties and repeated rows."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.llm import ann, lm, media, mixing, neardup, packing, quality, secrets, tokenfile, toxicity
from textmill.llm.registry import vocabulary
from textmill.llm.vocab import FastEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, is_toxic string, size long"
WORDS = "the of and to in la de un el der die und token ment ation".split()


def _text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = [(i, _text(rng, rng.randrange(5, 120)), "en", f"s{i % 3}", 0, "x", 1) for i in range(60)]
    rows += [(60, None, None, None, None, None, None), (61, "", "en", "s0", 0, "x", 1), (62, "a  b\t\n c ", "en", None, 0, "x", 1), (63, rows[3][1], "en", "s1", 0, "x", 1), (64, _text(rng, 6000), "en", "s2", 0, "x", 1)]
    rows += [(None, "no id here at all", "en", "s0", 0, "x", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def _lm_truth(rows):
    """Tokens of each text, counts over the training ones."""
    toks = [(i, [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode()) if w] + [b" "]) for i, t in rows]
    train = collections.Counter()
    for i, w in toks:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(w)
    return toks, train


@pytest.mark.parametrize("known", [12, 1 << 17])
def test_lm_against_brute_force(spark, docs, known):
    # repeated rows and ids, one of them held out (1: remainder 2)
    assert zlib.crc32(b"1") % 7 == 2
    d = docs.unionByName(spark.createDataFrame([(1, "The second nine\x0b\x0cÀ la"), (5, "again five"), (5, "again five"), (1, None)], "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in d.collect()]
    toks, train = _lm_truth(rows)
    n, v = sum(train.values()), len(train)
    # within a symbol: (c + 1) / (N + V + 1); symbols by the fitted model
    frame = d.select("doc_id", lm.text_or_empty().alias("text"), (lm.remainder("doc_id", 7) == 2).alias("held_out"))
    alphabet = lm.fit_alphabet(lm.cut(lm.count_tokens(frame.filter("not held_out"))), 8, 4, known)
    model = lm.fit_model(lm.cut(lm.symbols(frame, alphabet)).filter("sym is not null and not held_out"), alphabet, 3, 16)
    members = collections.defaultdict(list)
    for w in train:
        members[int(alphabet.ids([w])[1][0])].append(w)
    mass = {s: sum(train[w] for w in ws) + len(ws) + 1 for s, ws in members.items()}
    want = []
    for i, w in toks:
        sym = alphabet.ids(w)[1].tolist()
        seq = [alphabet.end] * 3 + sym
        score = 0.0
        for k, s in enumerate(sym):
            h = sum(model.parts[0][seq[k + 2 - j]] * model.parts[2][j] for j in range(3)).astype(float)
            z = model.parts[1].astype(float) @ h + model.parts[3]
            score += (z[s] - math.log(np.exp(z).sum())) / math.log(10)
            if s >= alphabet.heads:
                score += math.log10(train[w[k]] + 1) - math.log10(mass.get(s, 1))
        base = sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(train[x] > 0 for x in w), n, base, score))
    got = lm.score_documents(d, heads=8, tails=4, known=known).select(*[f.split()[0] for f in lm.FIELDS.split(", ")]).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4], round(r[5], 6))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-3), (g, w)
    assert lm.score_documents(docs.limit(0)).count() == 0


def test_lm_gradient_and_normalisation():
    rng = np.random.default_rng(0)
    m = lm.LogBilinear(np.array([5.0, 3, 2, 1, 4]), dim=3, order=2)
    seq, target = rng.integers(0, 5, 40), (rng.random(38) < 0.8).astype(np.float32)
    drawn = np.array([0, 3, 1, 1])

    def objective():
        r, q, c, b = (p.astype(float) for p in m.parts)
        total = 0.0
        for t in range(38):
            h = r[seq[t + 1]] * c[0] + r[seq[t]] * c[1]
            s = lambda w: h @ q[w] + b[w] - math.log(4 * m.noise[w])
            total += target[t] * (-math.log1p(math.exp(-s(seq[t + 2]))) - sum(math.log1p(math.exp(s(w))) for w in drawn))
        return total

    got = m.gradients(seq, target, drawn)
    for p, g in zip(m.parts, got, strict=True):
        for at in [tuple(rng.integers(0, k) for k in p.shape) for _ in range(6)]:
            old = p[at]
            p[at] = old + 1e-2
            high = objective()
            p[at] = old - 1e-2
            low = objective()
            p[at] = old
            assert math.isclose((high - low) / 2e-2, g[at], rel_tol=2e-2, abs_tol=2e-2)
    assert math.isclose(sum(np.exp(m.logprob(np.array([*seq[:2], k]))[0]) for k in range(5)), 1, rel_tol=1e-5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
@pytest.mark.parametrize("parts", [4, 64])
def test_lm_learns_whatever_the_split(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(parts, "doc_id")
    r = lm.score_documents(docs).filter("held_out").agg(F.sum("n_tokens").alias("n"), F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert (r.s - r.b) / r.n > 0.2, ((r.s - r.b) / r.n, r.b / r.n)


def test_secrets(spark):
    forest = secrets.fit_forest(secrets.labelled_findings(spark))
    hexes = hashlib.sha1(b"x").hexdigest()
    rows = [(1, f'erist token = "{hexes}" and'), (2, f"commit {hexes} merged"), (3, None), (4, ""), (5, "4785380592391135 words only"), (6, f'TOKEN =!! "{hexes.upper()}"!! AND token = "{hexes}"'), (6, "plain")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars long")
    got = {(r.doc_id, r.n_secrets): r for r in secrets.scan_report(df, forest).collect()}
    assert (1, 1) in got and (2, 0) in got and (3, 0) in got and (4, 0) in got and (5, 0) in got and (6, 2) in got and (6, 0) in got
    s = got[1, 1].secrets[0]
    assert rows[0][1][s.start : s.end] == hexes
    new = {r.text for r in secrets.redact(df, forest).collect()}
    assert 'erist token = "<secret>" and' in new and f"commit {hexes} merged" in new and None in new
    assert secrets.scan_report(df.limit(0), forest).count() == 0
    # by spans: a known value goes wherever it is a candidate, a plain word that equals a short one stays
    text = f'é {hexes} then token = "{hexes}"; password="Elephants#9" near Elephants#9s, end'
    scored = {r.value: r.is_secret for r in secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), forest).filter("start > 20").collect()}
    assert scored[hexes]
    out = secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), forest).first().text
    assert hexes not in out and out.startswith("é <secret> then token =") and out.endswith("near Elephants#9s, end")


def _slow_mels(payload):
    """The definition, with float64 sums one frame at a time."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    h = np.ascontiguousarray(media._phases()[::-1]).ravel().astype(float)
    up = np.zeros(2 * (len(x) + 3))
    up[: 2 * len(x) : 2] = x
    y = np.convolve(up, h)[::3][: -(-len(x) // 3) * 2]
    y = np.concatenate([y, np.zeros(max(0, 256 - len(y)))])
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** ((mel(60) + (mel(4000) - mel(60)) * i / 21) / 2595) - 1) for i in range(22)]
    mels, energy = [], []
    for at in range(0, len(y) - 255, 128):
        part = y[at : at + 256] * np.hanning(256)
        power = [abs(sum(part * np.exp(-2j * np.pi * k * np.arange(256) / 256))) ** 2 for k in range(129)]
        band = lambda m, f: max(0.0, min((f - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - f) / (edges[m + 2] - edges[m + 1])))
        mels.append([math.log(sum(p * band(m, k * 8000 / 256) for k, p in enumerate(power)) + 1e-6) for m in range(20)])
        energy.append((part * part).mean())
    return np.array(mels), energy


def _slow_segments(energy):
    mid, on, out = float(np.median(energy)), None, []
    for i, e in enumerate(energy):
        if on is None and mid > 0 and e >= 1.1 * mid:
            on = i
        elif on is not None and e < 0.9 * mid:
            out.append((on, i))
            on = None
    return out + ([(on, len(energy))] if on is not None else [])


def test_forest_expression_and_held_out_findings(spark):
    labelled = secrets.labelled_findings(spark, 1600)
    forest = secrets.fit_forest(labelled)
    rows = secrets._found(labelled, path="path").select(F.explode("found").alias("x")).select("x.features", F.expr(forest.sql("x.features")).alias("p")).collect()
    assert len(rows) >= 1600 and np.allclose([r.p for r in rows], forest.predict(np.array([r.features for r in rows], float)))
    got = secrets.evaluate(secrets.labelled_findings(spark))
    print(got)
    assert got["precision"] > 0.97 and got["recall"] > 0.97 and got["findings"] > 900


def test_secret_candidates_against_a_plain_reading(spark):
    rng = random.Random(9)
    # any names, and names that the operator uses itself
    names = ["_all", "row", "t", "found", "value", "gap", "at", "near", "every", "secret", "bad", "new", "start"]
    run = "abcXYZ019_+/=-"
    texts = ["".join(rng.choice([" ", "\n", '"', ".", "é", *("".join(rng.choice(run) for _ in range(rng.randrange(1, 40))) for _ in range(4))]) for _ in range(30)) for _ in range(60)]
    texts += ['password = "' + "q!" * 4000 + '" end', "x" * 200_000 + " " + "7" * 30, "token: '" + "é" * 9 + "'"]
    df = spark.createDataFrame([(i, t, *([i] * len(names))) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    forest = secrets.fit_forest(secrets.labelled_findings(spark, 400))
    got = collections.defaultdict(list)
    for r in secrets.scan(df, forest).collect():
        got[r.doc_id].append((r.start, r.value))
    quoted = re.compile(r"(?i)(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|credential)[ \t:=!#$%&*>]{1,8}[\"']([^\s\"']{8,})[\"']")
    for i, t in enumerate(texts):
        want = [(m.start(), m[0]) for m in re.finditer(r"[A-Za-z0-9_+/=-]+", t) if len(m[0]) >= 16 and any(c in "0123456789" for c in m[0])] + [(m.start(1), m[1]) for m in quoted.finditer(t)]
        assert sorted(got[i]) == sorted(set(want)), i
    new = secrets.redact(df, forest)
    assert new.columns == df.columns and [r.bad for r in new.orderBy("doc_id").select("bad").collect()] == list(range(len(texts)))
    assert secrets.redact(df.limit(0), forest).count() == 0


def test_media_features_against_their_definition():
    rng = random.Random(3)
    for n in (0, 150, 700, 3000):
        payload = media.padded(_text(rng, 3000).encode()[:n])
        want, energy = _slow_mels(payload)
        mels, found = media.features(payload)
        assert mels.shape == want.shape and np.allclose(mels, want, atol=2e-3, rtol=1e-3)
        assert found == media.segments(np.array(energy, np.float32)) == _slow_segments(np.array(energy, np.float32))
        for piece in (1, 2, 7):
            again, others = media.features(payload, piece)
            assert np.allclose(again, mels, atol=1e-4) and others == found


def test_media_round_trip(spark, docs):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    stored = media.store_tensors(media.store_audio(docs))
    got = {r.doc_id: r for r in media.digest(stored).collect()}
    rows = collections.defaultdict(list)
    for r in media.audio_tensors(stored).collect():
        rows[r.doc_id].append((r.start_ms, r.end_ms, r.tensor))
    for i, t in texts.items():
        p = media.padded(t)
        assert got[i].n_bytes == len(t) and got[i].payload_bytes == len(p) and len(p) % 192 == 0 and got[i].payload_sha256 == hashlib.sha256(p).hexdigest() and got[i].tail_crc32 == zlib.crc32(p[-16:])
        m = media.store(p)
        assert media.samples(m) == p and got[i].media_bytes == len(m) and got[i].media_sha256 == hashlib.sha256(m).hexdigest()
        mels, found = media.features(p)
        own = sorted(rows[i])
        assert got[i].segments == len(found) and own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
        assert np.array_equal(np.concatenate([np.array(x, np.float32).reshape(media.FRAMES, media.MELS) for *_, x in own])[: len(mels)], mels)
        assert got[i].feature.split()[2:] == [f"{v:.3f}" for v in np.concatenate([np.array(x, np.float32).reshape(-1, media.MELS) for *_, x in own]).sum(0, dtype=float) / len(mels)]
    assert got[3].feature == got[63].feature and got[60].feature == got[61].feature
    assert media.digest(media.store_tensors(media.store_audio(docs.limit(0)))).count() == 0


def _slow_targets(sizes, weights, cap=3.0):
    """Words by weight, what is above a cap handed on until none is."""
    capped = {}
    while True:
        free = [i for i, s in enumerate(sizes) if s > 0 and i not in capped]
        left = sum(sizes) - sum(capped.values())
        out = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if out[i] >= cap * sizes[i]]
        if not over:
            return [capped.get(i, out.get(i, 0.0)) for i in range(len(sizes))]
        capped |= {i: cap * sizes[i] for i in over}


def test_mixing_targets_against_their_definition():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.choice([0, 3, 50, 400, 10_000]) + rng.randrange(9) * rng.randrange(2) for _ in range(rng.randrange(1, 9))]
        weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
        got = mixing.targets(sizes, weights)
        assert np.allclose(got, _slow_targets(sizes, weights)) and all(g <= 3 * s for g, s in zip(got, sizes, strict=True))


def test_mixing_apportions(docs):
    for seats in (0, 1, 7, 50):
        w, most = np.array([5.0, 2, 1, 0.3]), np.array([20, 9, 99, 99])
        slow = [0] * 4
        for _ in range(min(seats, most.sum())):
            j = max(range(4), key=lambda k: w[k] / (2 * slow[k] + 1) if slow[k] < most[k] else -1)
            slow[j] += 1
        assert mixing.apportion(w, seats, most).tolist() == slow
    plan = mixing.plan(docs)
    rows = plan.collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, mixing.plan(docs).collect()))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += words(r.text)
    order = sorted(sizes, key=lambda k: (k is None, k or ""))
    goal = dict(zip(order, _slow_targets([sizes[k] for k in order], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))]), strict=True))
    assert collections.Counter((r.doc_id, r.size) for r in rows) == collections.Counter((r.doc_id, words(r.text)) for r in docs.collect())
    by = collections.defaultdict(int)
    for r in rows:
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.source] and math.isclose(r.target, goal[r.source])
        by[r.source] += r.taken
    assert all(abs(n - goal[k]) <= 2 * mixing.BLOCK for k, n in by.items())
    mixed = mixing.mixed_documents(docs, plan)
    assert mixed.columns == docs.columns
    total = mixed.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert total == sum(r.taken for r in rows)
    assert mixing.plan(docs.limit(0)).count() == mixing.mixed_documents(docs.limit(0), mixing.plan(docs.limit(0))).count() == 0


def test_a_tiny_source_does_not_change_the_others_blocks(spark):
    rng = random.Random(5)
    big = [(i, _text(rng, 300), "s%d" % (i % 2)) for i in range(60)]
    spans = []
    for rows in (big, [*big, (99, "a b c", "tiny")]):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = mixing.plan(df).collect()
        spans.append([p.end - p.start for r in got for p in r.parts if r.doc_id != 99])
        assert all(r.taken == 9 for r in got if r.doc_id == 99)
    assert max(spans[1]) == max(spans[0]) == mixing.BLOCK


def test_mixing_gives_every_row_its_own_plan(spark):
    # rows without an id, and repeated ids, of unlike and of like sizes
    rng = random.Random(3)
    rows = [(None if i % 2 else 7, _text(rng, 10 + 9 * (i % 40)), "en", "s%d" % (i % 3), 0, "x", 1) for i in range(160)]
    rows += [(None, None, "en", "s0", 0, "x", 1), (None, "", "en", "s1", 0, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    planned = mixing.plan(df)
    want = {r.source: r.n for r in planned.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got, most = collections.Counter(), collections.Counter()
    for r in mixing.mixed_documents(df, planned).collect():
        got[r.source] += len((r.text or "").split())
        most[r.source, r.text] += 1
    assert got == want
    held = collections.Counter((r[3], r[1]) for r in rows)
    assert all(most[k] <= 3 * held[k] for k in most if k in held)


def test_quality_marginals_are_exact():
    rng = np.random.default_rng(3)
    f = quality.LineField()
    f.w, f.move = rng.normal(size=quality.FEATURES), rng.normal(size=(2, 2))
    x = rng.normal(size=(7, quality.FEATURES))
    got, _ = f.marginals(x, np.array([0, 4]))
    for a, b in ((0, 4), (4, 7)):
        z = np.zeros(b - a)
        total = 0.0
        for k in range(2 ** (b - a)):
            y = [k >> i & 1 for i in range(b - a)]
            s = math.exp(sum(x[a + i] @ f.w * y[i] for i in range(b - a)) + sum(f.move[p, q] for p, q in zip(y, y[1:])))
            total += s
            z += s * np.array(y)
        assert np.allclose(got[a:b], z / total)


def test_quality_gradient_and_length_weighting():
    rng = np.random.default_rng(4)
    f = quality.LineField()
    f.w, f.move = rng.normal(size=quality.FEATURES) * 0.3, rng.normal(size=(2, 2))
    x, first, labels = rng.normal(size=(9, quality.FEATURES)), np.array([0, 4, 5]), np.array([1, 0, 1])

    def objective():
        total = 0.0
        for (a, b), y in zip(((0, 4), (4, 5), (5, 9)), labels, strict=True):
            paths = []
            for k in range(2 ** (b - a)):
                s = [k >> i & 1 for i in range(b - a)]
                paths.append(sum(x[a + i] @ f.w * s[i] for i in range(b - a)) + sum(f.move[p, q] for p, q in zip(s, s[1:])))
            want = sum(x[a + i] @ f.w * y for i in range(b - a)) + (b - a - 1) * f.move[y, y]
            total += (want - np.log(np.exp(paths).sum())) / (b - a) / 3
        return total - 0.01 / 2 * ((f.w**2).sum() + (f.move**2).sum())

    got = f.gradient(x, first, labels, 0.01)
    for held, offset in ((f.w, 0), (f.move.reshape(-1), quality.FEATURES)):
        for i in range(0, len(held), 3):
            old = held[i]
            held[i] = old + 1e-5
            high = objective()
            held[i] = old - 1e-5
            low = objective()
            held[i] = old
            assert math.isclose((high - low) / 2e-5, got[offset + i], rel_tol=1e-4, abs_tol=1e-7)
    f.fitted = True
    texts = [b"one line\nAND ANOTHER ONE!!\n\nlast", b"", b"single"]
    feats, weight, starts = quality.line_features(texts)
    p, _ = f.marginals(feats, starts)
    assert weight.tolist() == [9, 18, 1, 5, 1, 7]
    assert np.allclose(f.quality(texts), [(p[:4] * weight[:4]).sum() / 33, p[4], p[5]])


def test_quality_learns_and_handles_edges(spark, docs):
    rng = random.Random(4)
    rows = [(i, _text(rng, 40) if i % 2 else "\n".join(w.upper() + "!!" for w in _text(rng, 40).split()), i % 2) for i in range(200)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = quality.classify_quality(d, lab).collect()
    assert np.mean([r.predicted == rows[r.doc_id][2] for r in got if r.held_out]) > 0.95
    edge = quality.classify_quality(docs, lab).collect()
    assert len(edge) == docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert quality.classify_quality(docs, lab.limit(0)).count() == docs.count()
    assert quality.classify_quality(docs.limit(0), lab).count() == 0
    assert quality.fit_lines(d, lab, lines=1000).fitted and not quality.fit_lines(d, lab, lines=0).fitted


def test_quality_bound_leaves_out_what_is_too_long(spark, monkeypatch):
    """A labelled text beyond the bound of lines is left out alone; a labelled
    id in many rows doesn't break the bound."""
    rng = random.Random(5)
    first = min(range(120), key=lambda i: zlib.crc32(str(i).encode()))
    rows = [(i, _text(rng, 40) if i % 2 else "\n".join(w.upper() + "!!" for w in _text(rng, 40).split())) for i in range(120)]
    lab = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    long = spark.createDataFrame([(i, "\n" * 20_001 if i == first else t) for i, t in rows], "doc_id long, text string")
    seen = []
    fit = quality.LineField.fit
    monkeypatch.setattr(quality.LineField, "fit", lambda self, x, y, *a, **k: (seen.append(sum(map(len, x))), fit(self, x, y, *a, **k))[1])
    model = quality.fit_lines(long, lab, lines=20_000)
    assert model.fitted and 1000 < seen[-1] <= 20_000
    often = long.filter(F.col("doc_id") != first).unionByName(spark.range(700).select(F.lit(first).alias("doc_id"), F.concat(F.lit("a\n" * 99), F.col("id").cast("string")).alias("text")))
    assert quality.fit_lines(often, lab, lines=2_000).fitted and seen[-1] <= 2_000
    same = long.unionByName(long).unionByName(long)  # equal rows count once
    assert np.allclose(quality.fit_lines(same, lab, lines=20_000).w, model.w)


def test_empty_texts_are_never_toxic(spark):
    rows = [(i, "" if i % 4 == 0 else "plain words number %d" % i, int(i % 4 == 0)) for i in range(400)]
    d = spark.createDataFrame([r[:2] for r in rows] + [(1000 + i, None) for i in range(50)] + [(None, "")], "doc_id long, text string")
    chain = toxicity.fit_chain(d, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    if chain is not None:  # whatever it says of a text without marks
        chain.weights[-1][-1] = 30.0
        left = toxicity.drop_toxic(d, chain)
        assert left.filter("text is null").count() == 50 and left.filter("text = ''").count() == 101
        assert toxicity.score_toxicity(d, chain, ("doc_id", "text")).filter("is_toxic and coalesce(text, '') = ''").count() == 0
        assert left.filter("text like 'plain%'").count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["_d", "_dn", "_s", "_sn", "_size", "_no", "_whole", "_from", "_to", "row", "whole", "from", "to", "a.b", "at", "parts"]
    rows = [(i, " ".join(["w%d" % i] * (20 + i)), "s%d" % (i % 2), *[f"{n}-{i}" for n in names]) for i in range(30)]
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("doc_id", LongType()), *[StructField(n, StringType()) for n in ("text", "source", *names)]])
    df = spark.createDataFrame(rows, schema)
    got = mixing.mixed_documents(df, mixing.plan(df))
    assert got.columns == df.columns
    of = {r[0]: r for r in rows}
    found = got.collect()
    assert len(found) >= 25 and all(tuple(r)[3:] == of[r.doc_id][3:] and set(r.text.split()) == {"w%d" % r.doc_id} for r in found)


def test_encoder_equals_library():
    rng = random.Random(1)
    some = ["a", "B", " ", "\n", "'s", "é", "ß", "1", "İ", "\u0301", "x", "The", "👍", ",", "…", "—"]
    odd = [*some, "\t", "\u2003", "\u00a0", "\u200b", "\u3000", "\ufeff", "\x00", "<|endoftext|>"]
    fixed = ["", " ", "a", "a  b", "\tx\r\n", "It's 12 345 o'clock\nÉlan ﬁ ½² Σας", "x<|endoftext|>y", "tail ", " n\u200bb", "a\n\nb", "👍🏽 ok!!???"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        for limit in (FastEncoder(vocabulary(name)).limit, 3):  # 3: the table of known units is full at once
            e = FastEncoder(vocabulary(name), limit)
            texts = fixed + ["".join(rng.choice(some if rng.random() < 0.9 else odd) for _ in range(rng.randrange(12))) for _ in range(1500)]
            for part in (texts[:700], texts[700:], texts):
                ids, at = e.encode_column(pa.array(part).slice(1))
                for i, t in enumerate(part[1:]):
                    assert ids[at[i] : at[i + 1]].tolist() == e.whole.encode(t, add_special_tokens=False).ids, t
            assert e.encode_column(pa.array([], pa.string()))[1].tolist() == [0]


def _expected_ids(docs, name, end):
    whole = FastEncoder(vocabulary(name)).whole
    return [(r.doc_id, np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, end], "<u4")) for r in docs.collect()]


def test_token_files(spark, docs, tmp_path):
    # null and repeated ids too: nulls first, repeated ones in any fixed order
    d = docs.unionByName(spark.createDataFrame([(None, "no id either"), (5, "again five"), (5, "again five")], "doc_id long, text string"), allowMissingColumns=True)
    want = collections.defaultdict(list)
    for i, ids in _expected_ids(d, "byte_bpe_50k.json", 2):
        want[i].append((len(ids), zlib.crc32(ids.tobytes())))
    got = sorted(tokenfile.encode_and_read(d, vocabulary("byte_bpe_50k.json")).collect(), key=lambda r: r.start)
    start, last, held = 0, -1, collections.defaultdict(list)
    for r in got:
        assert r.start == start and (r.doc_id is None and last == -1 or r.doc_id is not None and r.doc_id >= last)
        start += r.n_tokens
        last = -1 if r.doc_id is None else r.doc_id
        held[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in held.items()} == {k: sorted(v) for k, v in want.items()}
    assert tokenfile.encode_and_read(d.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_sequences_are_read_without_those_before(docs, tmp_path, monkeypatch):
    d = docs.filter("doc_id is not null")
    monkeypatch.setattr(tokenfile, "BATCH", 3)
    m = tokenfile.write_sequences(d.repartition(1), vocabulary("byte_bpe_50k.json"), str(tmp_path), length=64).orderBy("file_no").collect()
    whole = np.concatenate([ids for _, ids in sorted(_expected_ids(d, "byte_bpe_50k.json", 2), key=lambda x: x[0])])
    at = 0
    for f in m:
        with pa.memory_map(f.path) as source:
            kept = bytearray(source.read())
        for k in range(f.sequences):
            ids, mask = tokenfile.sequence(f.path, k)
            n = mask.true_count
            assert ids.dtype == np.uint16 and not ids.flags.owndata and len(ids) == len(mask) == 64
            assert mask.buffers()[1].address < ids.ctypes.data + f.sequences * 200 and not any(mask[n:].to_pylist())
            assert ids[:n].tolist() == whole[at : at + n].tolist()
            at += n
        with pytest.raises(IndexError):
            tokenfile.sequence(f.path, f.sequences)
        if f.sequences > 9:  # the second batch is spoilt: the third is read all the same
            with pa.memory_map(f.path) as source:
                schema = pa.ipc.read_schema(source)
                head = source.tell()
                pa.ipc.read_message(source)
                size = source.tell() - head
            want = tokenfile.sequence(f.path, 6)[0].tolist()
            kept[head + size : head + 2 * size] = bytes(size)
            spoilt = str(tmp_path / "spoilt.arrows")
            open(spoilt, "wb").write(kept)
            assert tokenfile.sequence(spoilt, 6)[0].tolist() == want and schema.metadata[b"format"] == b"token-sequences"
    assert at == len(whole)


@pytest.mark.parametrize("ranked", [3, packing.RANKED])
def test_packing(spark, docs, ranked):
    d = docs.unionByName(spark.createDataFrame([(None, "no id either"), (5, "again five"), (5, "again five")], "doc_id long, text string"), allowMissingColumns=True)
    got = packing.pack(packing.cut(packing.pieces(d, vocabulary("word_bpe_49k.json"))), ranked=ranked).collect()
    want = collections.Counter()
    for i, ids in _expected_ids(d, "word_bpe_49k.json", 0):
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 2048
    assert max(r.piece for r in got) > 0 and len(bins) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack_documents(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_packing_plan_is_best_fit():
    rng = random.Random(1)
    for _ in range(20):
        sizes = [rng.randrange(1, 40) for _ in range(300)]
        room = []
        for s in sorted(sizes, reverse=True):
            fit = [i for i, r in enumerate(room) if r >= s]
            if fit:
                room[min(fit, key=lambda i: room[i])] -= s
            else:
                room.append(40 - s)
        used = set()
        for _, _, n, first, per, _ in packing.plan_counts(collections.Counter(sizes), 40):
            used |= {first + t // per for t in range(n)}
        assert len(used) <= len(room) + 1


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    rows, truth = [], {}
    for g in range(12):
        words = rng.sample(base, 200)
        for c in range(5):
            new = list(words)
            for p in rng.sample(range(200), c % 3):
                new[p] = "edit%d" % rng.randrange(10**6)
            truth[len(rows)] = g
            rows.append((len(rows), " ".join(new)))
    shared = " ".join(rng.sample(base, 60))
    for _ in range(40):
        truth[len(rows)] = 1000 + len(rows)
        rows.append((len(rows), shared + " " + " ".join(rng.sample(base, 140))))
    rows += [(900, None), (901, ""), (902, "short one"), (903, "SHORT  one"), (904, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for piece in (1024, 16):
        got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df, piece=piece, pivots=2).collect()}
        assert all((got[a] == got[b]) == (truth[a] == truth[b]) for a in truth for b in truth)
        assert got[900] == got[901] and got[902] == got[903] != got[904]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("piece", [16, 64, 1024])
def test_a_chain_of_near_copies_is_one_class(spark, piece):
    # each text about 0.9 like the next, unlike those further on
    words = ["c%d" % i for i in range(300 * 6 + 120)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 120])) for i in range(300)]
    assert {r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), piece=piece).collect()} == {0}


def test_near_duplicates_recall_against_all_pairs(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    rows = []
    for g in range(150):
        words = rng.sample(base, rng.choice([12, 30, 80, 200]))
        for _ in range(rng.randrange(1, 5)):
            new = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 30)):
                k = rng.randrange(len(new))
                new[k : k + rng.randrange(2)] = [rng.choice(base)]
            rows.append((len(rows), " ".join(new)))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seqs = [neardup.labels(neardup.split_words(t)) for _, t in rows]
    up = list(range(len(rows)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if neardup.aligned(seqs[i], seqs[j]) >= 0.8]
    found = sum(got[i] == got[j] for i, j in pairs)
    for i, j in pairs:
        while up[i] != i:
            i = up[i]
        while up[j] != j:
            j = up[j]
        up[max(i, j)] = min(i, j)

    def root(i):
        return i if up[i] == i else root(up[i])

    together = [(i, j) for i in range(len(rows)) for j in range(i) if got[i] == got[j]]
    right = sum(root(i) == root(j) for i, j in together)
    print("pairs", len(pairs), "recall", found / len(pairs), "precision", right / len(together))
    assert len(pairs) > 100 and found / len(pairs) >= 0.99 and right == len(together)


def test_near_duplicates_with_repeated_and_null_ids(spark):
    one, two = " ".join("w%d" % i for i in range(60)), " ".join("v%d" % i for i in range(60))
    rows = [(7, one, "a"), (7, two, "b"), (None, one + " x", "c"), (None, "only here without an id at all", "d"), (None, "only here without an id at all", "e"), (3, two + " y", "f"), (9, None, "g"), (None, "", "h"), (3, two + " y", "f"), (4, "word " * 30_000, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string").withColumn("key", F.lit(1))
    got = {(r.doc_id, r.class_id, r.text_id) for r in neardup.near_duplicates(df).collect()}
    alone = next(c for d, c, _ in got if c < 0)
    assert got == {(7, 7, 7), (7, 3, 7), (None, 7, 7), (None, alone, alone), (3, 3, 3), (9, 9, 9), (None, 9, 9), (4, 4, 4)}
    kept = neardup.representatives(df)
    assert kept.columns == df.columns and sorted(r.class_id for r in kept.collect()) == ["a", "d", "f", "g", "i"]
    assert neardup.representatives(df.limit(0)).count() == 0


def test_near_duplicates_in_a_template_family(spark):
    # one group above a piece, pairwise 0.7; each pair has no other partner
    rng = random.Random(11)
    base = ["t%d" % i for i in range(120)]
    rows, pairs = [], []
    for i in range(1300):
        words = list(base)
        for p in (20, 45, 70, 95):
            words[p] = "own%d_%d" % (i, p)
        rows.append((len(rows), " ".join(words)))
        if i % 40 == 0:
            words[rng.choice([5, 33, 58, 110])] = "edit%d" % i
            pairs.append((len(rows) - 1, len(rows)))
            rows.append((len(rows), " ".join(words)))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), piece=128).collect()}
    assert all(got[b] == a for a, b in pairs) and len(set(got.values())) == 1300


def test_near_duplicates_of_short_texts():
    # one word after nine: 5 and 6 labels, 5 in common; after eight: 4 and 5
    for n in (8, 9, 12, 20):
        for g in range(500):
            w = [b"w%d_%d" % (g, i) for i in range(n)]
            a, b = neardup.labels(w), neardup.labels([*w, b"more%d" % g])
            assert neardup._verified(np.array([1, 2]), [a, b]) == [(2, 1)]
            rows = neardup.pa.record_batch({"doc_id": neardup.pa.array([1, 2]), "size": neardup.pa.array([len(a), len(b)]), "sig": neardup.pa.array([neardup.signature(x).tobytes() for x in (a, b)], neardup.pa.binary())})
            assert neardup._stars(rows) == [(2, 1)]


def test_alignment_against_dynamic_programming():
    rng = random.Random(6)
    for _ in range(30):
        w = [b"w%d" % rng.randrange(500) for _ in range(120)]
        v = list(w)
        for _ in range(rng.randrange(4)):
            v[rng.randrange(len(v))] = b"x%d" % rng.randrange(99)
        a, b = neardup.labels(w), neardup.labels(v)
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        j = t[-1, -1] / (len(a) + len(b) - t[-1, -1])
        got = neardup.aligned(a, b)
        assert math.isclose(got, j) if j >= 0.8 else got < 0.8


def test_toxicity(spark, docs):
    rng = random.Random(8)
    rows = [(i, _text(rng, 60) + (" you idiot scum" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(300)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    chain = toxicity.fit_chain(d, lab)
    got = {r.doc_id: r.is_toxic for r in toxicity.score_toxicity(d, chain).collect()}
    assert all(got[i] == bool(t) for i, _, t in rows)
    assert toxicity.drop_toxic(docs, chain).count() == docs.count() and toxicity.drop_toxic(docs, chain).columns == docs.columns
    # an inflected stem, each time another word; clean texts hold it rarely
    ends = [a + b for a in "aeiou" for b in "bdfgklmnprst"]
    stem = [(i, _text(rng, 60) + " " + " ".join("krötz" + rng.choice(ends) for _ in range(3 if i % 4 == 0 else 0)), int(i % 4 == 0)) for i in range(400)]
    d2 = spark.createDataFrame([r[:2] for r in stem], "doc_id long, text string")
    c2 = toxicity.fit_chain(d2.filter("doc_id < 300"), spark.createDataFrame([(r[0], r[2]) for r in stem], "doc_id long, toxic int"))
    assert all(r.is_toxic == (r.doc_id % 4 == 0) for r in toxicity.score_toxicity(d2.filter("doc_id >= 300"), c2).collect())
    assert toxicity.fit_chain(d, lab.filter("toxic = 0")) is None and toxicity.score_toxicity(docs, None).filter("is_toxic").count() == 0
    for c in (chain, None):
        assert toxicity.score_toxicity(docs.limit(0), c).count() == toxicity.drop_toxic(docs.limit(0), c).count() == 0
    assert toxicity.fit_chain(d.limit(0), lab) is None and toxicity.fit_chain(d, lab.limit(0)) is None
    # a category for each language with positives enough, and one for all
    l2 = d2.withColumn("lang", F.when(F.col("doc_id") % 8 == 0, "xx").otherwise("yy"))
    c3 = toxicity.fit_chain(l2, spark.createDataFrame([(r[0], r[2]) for r in stem], "doc_id long, toxic int"))
    assert c3.categories == ["toxic_xx", "toxic_yy", "toxic"] and len(c3.weights[2]) == len(c3.vocabulary) + 1 + 2 + 1


def test_toxicity_features_and_chain_by_hand():
    texts = pa.array(["", "Achtung achten, ACH! über-achten 12", "nothing", "a1b"])
    x = toxicity.features(texts, ["ach", "ach*", "achten", "a", "über"])
    assert np.allclose(np.expm1(x), [[0] * 6, [1, 3, 2, 0, 1, 5], [0, 0, 0, 0, 0, 1], [0, 0, 0, 1, 0, 2]])
    # out of fold: a fold's own rows change nothing in its predictions
    rng = np.random.default_rng(1)
    x, fold = rng.normal(size=(90, 3)), np.arange(90) % 3
    first = (x[:, 0] + rng.normal(size=90) > 0).astype(int)
    ys = np.stack([first, first * (x[:, 1] > 0)], 1)
    columns = [np.array([0, 2]), np.array([0, 1, 2]), np.array([1, 2]), np.array([0, 1, 2])]
    chain = toxicity.Chain(["u", "v"], ["a", "b"]).fit(x, ys, fold, columns)
    out = np.zeros(90)
    for k in range(3):
        w = toxicity._logistic(x[fold != k][:, columns[k]], ys[fold != k, 0].astype(float), 1.0)
        out[fold == k] = 1 / (1 + np.exp(-(x[fold == k][:, columns[k]] @ w[:-1] + w[-1])))
    w = toxicity._logistic(np.concatenate([x, out[:, None]], 1), ys[:, 1].astype(float), 1.0)
    assert np.allclose(chain.weights[1], w)
    p = chain.predict(x)
    assert np.allclose(p[:, 1], 1 / (1 + np.exp(-(np.concatenate([x, p[:, :1]], 1) @ w[:-1] + w[-1]))))


def _exact(ids, v, q, x, k=10):
    d = np.sqrt(((v - x) ** 2).sum(1))
    at = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return [(int(ids[i]), float(d[i])) for i in at]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[7] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1100, [1.0, None] + [0.0] * 14), (None, v[0].tolist()), (1200, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, block int, verified int")
    base = ann.usable(df)
    assert base.count() == 601
    got = collections.defaultdict(list)
    for block in (200, ann.BLOCK):
        got.clear()
        for r in ann.neighbours(base, base.filter("id % 100 = 0"), block=block).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        hits = 0
        for q in range(0, 600, 100):
            want = _exact(np.arange(600), v.astype(float), q, v[q].astype(float))
            hits += len({i for i, _ in want} & {i for i, _ in got[q]})
            assert len(got[q]) == 10 and all(math.isclose(s, np.sqrt(((v[i].astype(float) - v[q].astype(float)) ** 2).sum()), rel_tol=1e-12) for i, s in got[q])
            assert got[q] == sorted(got[q], key=lambda x: (x[1], x[0]))
        assert hits >= 54 and 1200 not in got
    # repeated ids: one query, its smallest vector; equal vectors: smaller ids first
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), *((i, [0.0, 1.0]) for i in range(1, 30)), *((i, [0.0, 1.0]) for i in range(1, 3))], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in ann.search_table(twice).orderBy("rank").collect()] == [(i, 0.0) for i in (1, 1, 2, 2, 3, 4, 5, 6, 7, 8)]
    assert ann.search_table(df.limit(0)).count() == 0


def test_neighbours_verify_few(spark):
    rng = np.random.default_rng(4)
    for v in (rng.normal(size=(9000, 64)), rng.normal(size=(9000, 64)) * 0.2 + rng.normal(size=(60, 64))[rng.integers(0, 60, 9000)]):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(4)
        got, verified = collections.defaultdict(set), {}
        for r in ann.search_table(df).collect():
            got[r.query_id].add(r.vec_id)
            verified[r.query_id] = r.verified
        recall = np.mean([len(got[q] & {i for i, _ in _exact(np.arange(9000), v, q, v[q])}) / 10 for q in range(0, 9000, 100)])
        share = np.mean(list(verified.values())) / 9000
        print("recall", recall, "verified", share)
        assert recall >= 0.9 and share <= 0.1

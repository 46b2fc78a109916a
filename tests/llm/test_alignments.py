"""License scans, cross-tokenizer alignment and sort-means against plain versions."""

import hashlib
import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import alignment, licenses, registry, sortmeans
from textmill.llm.common import vocabulary

SF = "/root/testdata/sf0.001"
FILES = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [
    "", None, "a", " ", "  two  blanks ", "\n\nline\n end\n", "tab\tand\r\nreturn", "<|endoftext|> and <s> stay text", "▁ is a sign", "naïve café señor Übung", "中文 文字 and 漢字", "emoji 👩‍👩‍👧 family", "nbsp here   wide", "x" * 5000,
    "don't we'll I'm", "zero​width", "combíned á ́x", "\x00nul \x7f", "123 4567 8,9", "a  b   c    d", "word " * 3000, "é à ü", "end　 ideographic",
]


def licence_reference(texts):
    """The definition, with every start of every passage considered."""
    known = licenses.passages()
    words = [re.findall(licenses.WORD, (t or "").translate(str.maketrans(licenses.CAPITALS, licenses.SMALL))) for t in texts]
    df = Counter(w for ws in words for w in set(ws))
    idf = {w: 1 + math.log((len(texts) + 1) / (df[w] + 1)) for p in known for w in p.words}
    out = []
    for ws in words:
        own, labels, score = [], set(), 0.0
        for p in known:
            rare = sorted(set(p.words), key=lambda w: (-idf[w], w))[: p.indexed]
            looked = [w for w in rare if w in ws][: licenses.LOOK]
            for at in range(-len(p.words), len(ws)):
                on = [0 <= at + k < len(ws) and ws[at + k] == w for k, w in enumerate(p.words)]
                if sum(o for o, w in zip(on, p.words, strict=True) if w in looked) < 2:
                    continue
                shifts = range(-p.slack, p.slack + 1)
                if not all(any(at + k + s >= 0 and ws[at + k + s : at + k + s + len(m)] == list(m) for s in shifts) for k, m in p.must):
                    continue
                labels.add(p.label)
                score = max(score, sum(idf[w] for o, w in zip(on, p.words, strict=True) if o) / sum(idf[w] for w in p.words))
                if p.base:
                    own.append((at, p.label))
        out.append((len(ws), len(own), min(own)[0] if own else None, max(own)[0] if own else None, ",".join(sorted({x for _, x in own})), ",".join(sorted(labels)), round(score, 6)))
    return out


LICENCES = [
    None, "", " \n ", "All rights reserved.", "ALL RIGHTS, (reserved) all rights reserved", "all rights are reserved", "CC BY-NC 4.0; Licensed under CC BY-NC 4.0.", "ccé by cc by", "This work is licensed under the GNU General Public License, version 3.",
    "GNU general public license version 2 or general public license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Permission is hereby granted, free of charge, to any OTHER person obtaining a copy of this programme and associated documentation files",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "license license license by by cc general public", "cc by " * 4000, "the license of the public is general", "Released under the MIT License. Released under the MIT License.", "mit license", "license",
]


def test_licence_scan_is_its_definition(spark):
    texts = LICENCES * 2 + ["plain words of no note, by the public"] * 9
    docs = spark.createDataFrame([(i if i % 5 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, `words` string")
    got = licenses.scan_report(docs).collect()
    want = Counter((i if i % 5 else None, *r) for i, r in enumerate(licence_reference(texts)))
    assert Counter(tuple(r) for r in got) == want
    labels = {r.labels for r in got}
    assert any("apache-2.0" in x for x in labels) and any("mit" in x.split(",") for x in labels) and any("gpl-3.0" in x for x in labels)


def test_licence_places_and_edges(spark):
    docs = spark.createDataFrame([(1, "see: all rights reserved"), (2, "none")], "doc_id long, text string")
    assert [tuple(r) for r in licenses.places(docs).collect()] == [(1, "reserved", 1, 3, True, 1.0)]
    assert licenses.scan_report(docs.limit(0)).collect() == []
    assert licenses.scan_report(docs.select(F.lit(None).cast("long").alias("doc_id"), "text")).count() == 2
    with pytest.raises(ValueError):
        licenses.passages(base=(("x", "one"),))
    with pytest.raises(ValueError):
        licenses.passages(more=(("x", "two words", ("other",)),))


def aligned_reference(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(vocabulary(FILES[0])), sentencepiece.SentencePieceProcessor(model_file=vocabulary(FILES[1]))
    a.encode_special_tokens = True
    bytes_a, bytes_b = alignment.pieces_of_a(vocabulary(FILES[0])), alignment.pieces_of_b(b)
    rows, holds = [], Counter()
    for t in texts:
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if t and not b"".join(bytes_a[i] for i in ids[0]) == (" " + t).encode() == b"".join(bytes_b[i] for i in ids[1]):
            ids = [], []
        spans = []
        for of, table in zip(ids, (bytes_a, bytes_b), strict=True):
            end = np.cumsum([len(table[i]) for i in of]).tolist()
            spans.append([(i, e - len(table[i]), e) for i, e in zip(of, end, strict=True)])
        links, first = [], 0
        for i, s, e in spans[0]:
            while first < len(spans[1]) and spans[1][first][2] <= s:
                first += 1
            for j, s2, _ in spans[1][first:]:
                if s2 >= e:
                    break
                links.append((i, j))
        ends = sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]})
        parts, low = [], 0
        for e in ends:
            parts.append("|".join(",".join(str(i) for i, _, x in side if low < x <= e) for side in spans))
            low = e
        rows.append((ids, links, parts))
        holds.update(set(links))
    top: dict = {}
    for (i, _), n in holds.items():
        top[i] = max(top.get(i, 0), n)
    digest = lambda parts: hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""
    return [(len(ids[0]), len(ids[1]), len(parts), len(links), sum(holds[x] == top[x[0]] for x in links), sum(holds[x] for x in links), digest(parts)) for ids, links, parts in rows]


def test_alignment_is_its_definition(spark, monkeypatch):
    prose = [" ".join(f"{w}{i % 7}ing, the {w}" for w in ("token", "völlig", "données", "Zeichen")) + "." * (i % 3) for i in range(40)]
    texts = ODD + prose + ODD
    docs = spark.createDataFrame([(i if i % 7 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, block int").repartition(3)
    got = alignment.report(spark, docs, *map(vocabulary, FILES)).collect()
    want = Counter((i if i % 7 else None, *r) for i, r in enumerate(aligned_reference(texts)))
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want
    assert sum(r.n_links > 0 for r in got) > len(prose) + 20
    assert alignment.report(spark, docs.limit(0), *map(vocabulary, FILES)).collect() == []


def test_alignment_starts_over_and_folds(monkeypatch):
    """Small bounds on what a worker keeps change nothing."""
    import pyarrow as pa

    texts = [t or "" for t in ODD]
    results = []
    for units, partial in ((alignment.UNITS, alignment.PARTIAL), (3, 1), (40, 1)):
        monkeypatch.setattr(alignment, "UNITS", units)
        monkeypatch.setattr(alignment, "PARTIAL", partial)
        own = alignment.Aligner(*map(vocabulary, FILES))
        own.begin()
        made = [own.batch(pa.array(texts[i : i + 4], pa.string())) for i in range(0, len(texts), 4)]
        counts = sorted(r for b in own.counts() for r in zip(*(b.column(c).to_pylist() for c in ("a", "b", "docs")), strict=True))
        results.append(([{k: v.to_pylist() for k, v in m.items()} for m in made], counts))
    assert results[0] == results[1] == results[2]


def plain_means(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    c = [v for _, v in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        found = [min((far(v, m), j) for j, m in enumerate(c)) for _, v in kept]
        if r < rounds:
            for j in range(len(c)):
                own = [v for (_, v), (_, g) in zip(kept, found, strict=True) if g == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    of = Counter()
    for d, j in found:
        of[j] += d
    return Counter((i, j, d, of[j], sum(of.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found, strict=True))


@pytest.mark.parametrize("n", [0, 5, 400])
def test_sort_means_is_plain_means(spark, n):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 64))
    rows = [(i, (centres[i % 6] + 0.4 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]
    if n:
        rows += [(None, rows[0][1]), (2, rows[1][1]), (3, rows[3][1]), (3, rows[3][1]), (901, None), (902, []), (903, [1.0] * 63), (904, [None] + [1.0] * 63), (905, [float("nan")] * 64), (906, [float("inf")] * 64), (907, [0.0] * 64), (908, [-0.015625] * 64)]
    if n == 400:  # ties: many vectors between few whole numbers
        rows += [(1000 + i, (rng.integers(-1, 2, 64) / 64).tolist()) for i in range(300)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, `cluster` int")
    got = sortmeans.report(spark, df)
    assert Counter(tuple(r)[:6] for r in got.collect()) == plain_means(rows)
    if n == 400:
        assert got.agg(F.avg("scanned")).first()[0] < 15


def test_scan_stops_strictly_beyond_twice():
    """A centroid at exactly twice the distance ties, and the smaller number wins."""
    c = np.array([[4, 0], [0, 0], [100, 0]], np.int64)
    cluster, distance, scanned = sortmeans.Scan(c).assign(np.array([[2, 0], [1, 0]], np.int64), np.array([1, 1]))
    assert cluster.tolist() == [0, 1] and distance.tolist() == [4, 1] and scanned.tolist() == [2, 1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["op11_license_scans", "op13_centroid_clusters"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = want.fetchall()
    assert len(rows) > 100 and Counter(map(tuple, got.select(*names).collect())) == Counter(rows)

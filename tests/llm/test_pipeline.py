"""The pipeline's stages on awkward rows, each against what it must do to its
own input, and the whole against a plain version of the stages' decisions."""

import collections
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from textmill.llm import mixing, neardup, secrets, toxicity
from textmill.llm.common import vocabulary
from textmill.llm.vocab import FastEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _all string, row long, key string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randrange(8, 200)), "en", "s%d" % (i % 3)) for i in range(240)]
    rows += [(1000 + i, text(60) + " you zorgach rotten zorgung", "en", "s1") for i in range(60)]
    rows += [(2000 + i, rows[i][1], "en", "s0") for i in range(20)] + [(2100 + i, rows[i][1] + " tail", "en", "s2") for i in range(20, 40) if len(rows[i][1].split()) > 40]
    rows += [(3000, None, None, None), (3001, "", "en", "s0"), (3002, text(30_000), "en", "s2"), (None, text(50), "en", "s1"), (None, text(70), "en", "s1"), (None, rows[3][1], "en", "s1"), (5, text(40), "en", "s1"), (5, text(40), "en", "s1")]
    rows += [(3003, 'here token = "%s" and more words that follow it' % ("0123456789abcdef" * 3)[:40].replace("0", "f7"), "en", "s0")]
    rows += [rows[7], rows[7]]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, None) for r in rows], SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("zorg" in (r[1] or ""))) for r in rows[:300]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def _rows(df):
    return collections.Counter(map(tuple, df.collect()))


def test_every_stage_on_its_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], folder).write.mode("overwrite").parquet(path := f"{folder}/out-{len(frames)}")
        frames.append(spark.read.parquet(path))
    assert all(f.columns == docs.columns for f in frames[:-1])
    start, clean, single, redacted, mixed, packed = (_rows(f) for f in frames)
    # toxicity: the documents with the offensive stem go, no other
    assert clean == collections.Counter({r: n for r, n in start.items() if "zorg" not in (r[1] or "")})
    # near-duplicates: a plain union-find over all pairs' alignments
    rows = sorted(clean.elements(), key=lambda r: (r[0] is None, r[0] or 0))
    seqs = [neardup.labels(neardup.split_words(r[1] or "")) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if root(i) != root(j) and neardup.aligned(seqs[i], seqs[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r)
    assert sum(single.values()) == len(groups)
    for members in groups.values():
        kept = [r for r in members if r in single]
        assert len(set(kept)) == 1 and kept[0][0] == members[0][0]
    # secrets: as many rows; only the planted one changes
    changed = redacted - single
    assert sum(redacted.values()) == sum(single.values()) and [(r[0], "<secret>" in r[1]) for r in changed] == [(3003, True)]
    # the mix: each source's words near its target, no document over its cap
    count = lambda t: len((t or "").split())
    have, got = collections.Counter(), collections.Counter()
    for r, n in redacted.items():
        have[r[3]] += n * count(r[1])
    for r, n in mixed.items():
        got[r[3]] += n * count(r[1])
    order = sorted(have, key=lambda k: (k is None, k or ""))
    for k, t in zip(order, mixing.targets([have[k] for k in order], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))]), strict=True):
        assert abs(got[k] - t) <= 3 * mixing.BLOCK
    # packing: the ids of every row of the mix, in sequences without gaps
    whole = FastEncoder(vocabulary("word_bpe_49k.json")).whole
    want = collections.Counter()
    for r, n in mixed.items():
        ids = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[r[0], k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += n
    made = frames[-1].collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in made) == want
    bins = collections.defaultdict(list)
    for r in made:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 2048
    # run() applies the same stages
    assert corpus_pipeline.run(spark, folder).select("doc_id", "piece", "start", "length", "ids_crc32").exceptAll(frames[-1].select("doc_id", "piece", "start", "length", "ids_crc32")).count() == 0


def test_an_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert toxicity.fit_chain(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")) is None
    assert secrets.redact(spark.read.parquet(f"{tmp_path}/documents.parquet"), secrets.fit_forest(secrets.labelled_findings(spark, 200))).count() == 0

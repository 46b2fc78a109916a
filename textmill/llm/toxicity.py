"""Toxicity: a classifier chain over categories.

Categories are predicted in a fixed order by logistic models on word presence;
each sees the probabilities of the categories before it.  In training those
are out-of-fold predictions, so that a link learns from the probabilities that
it will meet and not from fitted ones (Read et al. 2011; Senge et al. 2013).
A fold's predictions come from the other folds alone: their features are
chosen without the fold's rows, too.

Categories are what the labelled rows tell apart: toxic in each language that
has positives enough (the most frequent first), then toxic at all.  Languages
name what is learnt; a score's inputs are the text's words only.  Without a
column ``lang`` there is one category.

Features are counts of words and of words' beginnings (``ach*``: languages
that inflect and compound hold an offensive stem in many words) and the text's
number of words.  They are chosen from the labelled sample: of those that at
least ``share`` of the positives hold, the ``most`` with the largest p ln(lift)
(p: positives with it, lift: how much more often positives have it), which
leaves out what a small sample shows by chance.
Training reads at most ``sample`` labelled documents (a documented bound, the
smallest crc32 of the id first).

Null texts count as empty, repeated rows get equal scores, null ids are scored
and never learnt from, a label that is neither 0 nor 1 is left out, an empty
table gives an empty result.  Without positives and negatives nothing is toxic.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, one_thread, slices, takes_over, text_or_empty
from .vocab import column_bytes

#: Letters of the beginnings that are looked at.
BEGINNINGS = range(3, 8)
FOLDS = 5
#: Languages with a category of their own at most, and positives they need.
LANGUAGES, POSITIVES = 8, 20
#: How much likelier a mark must be among the positives.
LIFT = 3


_LETTERS = re.compile(r"[^\W\d_]+")
#: Bytes that stand in a word, or in a character beyond ASCII that may.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def distinct_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Row and code of each stretch of letters and other characters beyond
    ASCII, and for each distinct stretch its words: runs of letters,
    lower-cased."""
    data, at = column_bytes(column)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    inside = _INSIDE[data]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    border = np.zeros(len(data) + 1, bool)  # a text begins here
    border[at] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | border[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | border[1:])) + 1
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])]).dictionary_encode()
    words = [[w.decode()] if w.isascii() else _LETTERS.findall(w.decode("utf-8", "replace").lower()) for w in found.dictionary.to_pylist()]
    return np.searchsorted(at, starts, "right") - 1, found.indices.to_numpy(), words


def marks(word: str) -> list[str]:
    """The word and its beginnings, the latter with a star; all have the word's
    first letters, so that a look at those tells whether any can be known."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if k < len(word))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Newton steps; the last weight is the intercept, which isn't shrunk."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        move = np.linalg.solve(h, x.T @ (y - p) - shrink * w)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


def features(texts: pa.Array, vocabulary: list[str]) -> np.ndarray:
    """log(1 + count) of each mark of the vocabulary, and of all words."""
    place = {w: i for i, w in enumerate(vocabulary)}
    rows, code, words = distinct_words(texts)
    n, v = len(texts), len(vocabulary)
    # the marks among the vocabulary, as one list for all words
    heads, none = {m.rstrip("*")[: BEGINNINGS[0]] for m in vocabulary}, []
    found = [[place[m] for w in own if w[: BEGINNINGS[0]] in heads for m in marks(w) if m in place] if own else none for own in words]
    size = np.array([len(f) for f in found], np.int64)
    flat = np.array([i for f in found for i in f], np.int64)
    first = np.cumsum(size) - size
    of = size[code]
    at = np.repeat(first[code] - (np.cumsum(of) - of), of) + np.arange(int(of.sum()))
    x = np.empty((n, v + 1))
    x[:, :v] = np.bincount(np.repeat(rows, of) * v + flat[at], minlength=n * v).reshape(n, v) if v else 0
    x[:, v] = np.bincount(rows, weights=np.array([len(own) for own in words], float)[code], minlength=n)
    return np.log1p(x)


class Chain:
    """``fit(x, ys, fold, columns)`` with one 0/1 column of ``ys`` for each
    category; ``columns[k]``: those of x that may be used without fold k, the
    last entry: with all rows (these are ``vocabulary`` and the word count)."""

    def __init__(self, vocabulary: list[str], categories: list[str], ridge: float = 1.0):
        self.vocabulary, self.categories, self.ridge = vocabulary, categories, ridge
        self.weights: list[np.ndarray] = []

    def fit(self, x: np.ndarray, ys: np.ndarray, fold: np.ndarray, columns: list[np.ndarray]) -> Chain:
        earlier = np.zeros((len(x), 0))
        for j in range(ys.shape[1]):
            y = ys[:, j].astype(float)
            out = np.zeros(len(y))
            for k in range(len(columns) - 1):
                rest = fold != k
                if rest.any() and not rest.all():
                    own = np.concatenate([x[:, columns[k]], earlier], 1)
                    out[~rest] = self._apply(own[~rest], _logistic(own[rest], y[rest], self.ridge))
            self.weights.append(_logistic(np.concatenate([x[:, columns[-1]], earlier], 1), y, self.ridge))
            earlier = np.concatenate([earlier, out[:, None]], 1)
        return self

    @staticmethod
    def _apply(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """[texts, categories]: each probability feeds the later ones."""
        out = []
        for w in self.weights:
            out.append(self._apply(x, w))
            x = np.concatenate([x, out[-1][:, None]], 1)
        return np.stack(out, 1) if out else np.zeros((len(x), 0))

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.predict(features(texts, self.vocabulary))


def chosen_marks(sums: list, totals: tuple[float, float], p: str, q: str, share: float, gain: float, most: int) -> list[str]:
    """The marks of rows (word, p, q) with the largest gain; of beginnings and
    words that the same texts hold, the shortest."""
    found = []
    for r in sums:
        a, b = r[p], r[q]
        lift = (a + 0.5) / (totals[0] + 1) / ((b + 0.5) / (totals[1] + 1))
        if a >= max(2, share * totals[0]) and lift > LIFT and a * np.log(lift) >= gain:
            found.append((-a * np.log(lift), r.word, a, b))
    alone: dict[tuple, str] = {}
    for _, word, a, b in sorted(sorted(found)[:most], key=lambda r: (-len(r[1].rstrip("*")), r[1])):
        alone[a, b, word[: BEGINNINGS[0]]] = word
    return sorted(alone.values())


def fit_chain(docs: DataFrame, labels: DataFrame, sample: int = 8000, share: float = 0.04, gain: float = 14.0, most: int = 128, label: str = "toxic") -> Chain | None:
    """None if the sample lacks positives or negatives."""
    order = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("y")).dropna().filter("y in (0, 1)").distinct().orderBy(order, "doc_id", "y").limit(sample)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    # at most ``sample`` rows' texts, read once: all passes below are over these
    picked = cut(docs.select("doc_id", lang.alias("lang"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("fold", F.pmod(F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string")).cast("binary")), F.lit(FOLDS)).cast("int")))

    def counted(batches):
        for batch in slices(batches, "text"):
            got: dict[tuple[int, int], Counter] = {}
            rows, code, words = distinct_words(batch.column("text"))
            held = [set() for _ in range(batch.num_rows)]
            of = [[m for w in own for m in marks(w)] for own in words]
            for i, c in set(zip(rows.tolist(), code.tolist(), strict=True)):
                held[i].update(of[c])
            for h, y, k in zip(held, batch.column("y").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                got.setdefault((y, k), Counter()).update({"", *h})  # "" counts the rows
            for (y, k), c in got.items():
                yield pa.record_batch({"word": pa.array(list(c), pa.string()), "y": pa.array([y] * len(c), pa.int32()), "fold": pa.array([k] * len(c), pa.int32()), "n": pa.array(list(c.values()), pa.int64())})

    parts = picked.select("y", "fold", "text").mapInArrow(counted, "word string, y int, fold int, n long")
    names = [(f"p{k}" if y else f"q{k}", y, k) for y in (1, 0) for k in (*range(FOLDS), FOLDS)]
    sums = cut(parts.groupBy("word").agg(*[F.sum(F.expr(f"if(y = {y} and fold <> {k}, n, 0)")).alias(c) for c, y, k in names]))
    total = sums.filter("word = ''").first()
    if total is None or not total[f"p{FOLDS}"] or not total[f"q{FOLDS}"]:
        return None
    # what a subset of four folds may choose; at most (FOLDS + 1) x ``most`` x 2 rows
    def gained(k: int) -> str:
        lift = f"((p{k} + 0.5) / {total[f'p{k}'] + 1}D / ((q{k} + 0.5) / {total[f'q{k}'] + 1}D))"
        return f"if(p{k} >= greatest(2, {share * total[f'p{k}']}) and {lift} > {LIFT}, p{k} * ln({lift}), 0)"

    gains = F.greatest(*[F.expr(gained(k)) for k in range(FOLDS + 1)])
    some = sums.filter("word <> ''").withColumn("g", gains).filter(f"g >= {gain * (1 - 1 / FOLDS)}").orderBy(F.desc("g"), "word").limit((FOLDS + 1) * most * 2).collect()
    own = [chosen_marks(some, (total[f"p{k}"], total[f"q{k}"]), f"p{k}", f"q{k}", share, gain * (1 if k == FOLDS else 1 - 1 / FOLDS), most) for k in range(FOLDS + 1)]
    union = sorted({m for o in own for m in o})

    def made(batches):
        for batch in slices(batches, "text"):
            x = features(batch.column("text"), union)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "fold": batch.column("fold"), "lang": batch.column("lang"), "x": pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())})

    rows = sorted(picked.select("doc_id", "y", "fold", "lang", "text").mapInArrow(made, "doc_id long, y int, fold int, lang string, x binary").collect(), key=lambda r: (r.doc_id, r.y, bytes(r.x)))
    x = np.stack([np.frombuffer(r.x, "<f4") for r in rows]).astype(float)
    y = np.array([r.y for r in rows])
    held = Counter(r.lang for r in rows if r.y and r.lang is not None)
    languages = [k for k, n in sorted(held.items(), key=lambda r: (-r[1], r[0]))[:LANGUAGES] if n >= POSITIVES and n < y.sum()]
    ys = np.stack([*[y * np.array([r.lang == k for r in rows]) for k in languages], y], 1)
    place = {m: i for i, m in enumerate(union)}
    columns = [np.array([*(place[m] for m in o), len(union)], np.int64) for o in own]
    return Chain(own[-1], [*(f"toxic_{k}" for k in languages), label]).fit(x, ys, np.array([r.fold for r in rows]), columns)


def _some(texts: pa.Array) -> np.ndarray:
    """[texts] whether there is text at all."""
    return pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def score_toxicity(docs: DataFrame, chain: Chain | None, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """The ``keep`` columns of every row, p_<category> and ``is_toxic``, which
    null and empty texts never are."""
    names = chain.categories if chain else ["toxic"]
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    from pyspark.sql.types import BooleanType, DoubleType, StructType

    schema = StructType([docs.schema[k] for k in keep])
    for n in names:
        schema = schema.add(f"p_{n}", DoubleType())
    schema = schema.add("is_toxic", BooleanType())
    have = "text" in keep

    def scored(batches):
        one_thread()
        takes_over("toxicity")
        for batch in slices(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            p = shared.value.score(texts) if shared.value else np.zeros((len(texts), len(names)))
            out = {k: batch.column(k) for k in keep}
            out |= {f"p_{n}": pa.array(p[:, i], pa.float64()) for i, n in enumerate(names)}
            yield pa.record_batch(out | {"is_toxic": pa.array((p[:, -1] >= threshold) & _some(texts))})

    return docs.select(*keep, *([] if have else ["text"])).mapInArrow(scored, schema)


def drop_toxic(docs: DataFrame, chain: Chain | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose last category stays below the
    threshold; null and empty texts are kept, whatever the chain says of them."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def kept(batches):
        one_thread()
        takes_over("toxicity")
        for batch in slices(batches, "text"):
            model = shared.value
            if model:
                texts = pc.fill_null(batch.column("text"), "")
                batch = batch.filter(pa.array((model.score(texts)[:, -1] < threshold) | ~_some(texts)))
            if batch.num_rows:
                yield batch

    return docs.mapInArrow(kept, docs.schema)

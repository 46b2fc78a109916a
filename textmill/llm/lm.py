"""Language-model scoring: a log-bilinear model trained by noise contrast.

The output alphabet is a partition of all strings: each of the ``heads`` most
frequent tokens is a symbol of its own, all other tokens belong to the symbol
of their last two bytes (the ``tails`` heaviest, and one for the rest).  A
log-bilinear model (Mnih & Hinton 2007; diagonal position weights as in Mnih &
Kavukcuoglu 2013) predicts the next symbol from the ``order`` symbols before
it; within a symbol a token has probability (c + 1) / (N_s + V_s + 1), which
leaves one share for unseen tokens.  Both factors sum to one, so the product
is a normalised distribution over tokens; the softmax is evaluated in full as
batched matrix products.

Training covers every position of every training document.  It starts from
the whole corpus' counts of neighbouring symbols (a truncated singular value
decomposition of their log-ratios), which don't depend on how the input is
split, and goes on in synchronised rounds of noise-contrastive AdaGrad: each
round takes its share of the documents, every task starts from the same
weights and step sizes, and their means by number of targets start the next
round.  Symbols are written once and read by each round and by the scoring.

Null texts count as empty (their only token is the end), null ids as training
rows, repeated rows are scored row by row, an empty table gives an empty
result, other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, one_thread, remainder, slices, text_or_empty
from .vocab import column_bytes

#: The end's key: a blank is in no word.
END = b" "
FIELDS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def distinct_tokens(column: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Codes of all texts' tokens one after another (words cut at bytes 9 to
    13 and 32, A-Z lower-cased, and an end after each text), the distinct
    tokens that codes stand for, and [texts + 1] offsets."""
    data, at = column_bytes(column)
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    inside = ~_SPACE[data]
    border = np.zeros(len(data) + 1, bool)  # a text begins here
    border[at] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | border[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | border[1:])) + 1 if len(data) else starts
    # words as a column: the bytes inside words only, without a gap
    size = ends - starts
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(data[inside])]).dictionary_encode()
    names = [*words.dictionary.to_pylist(), END]
    before = np.searchsorted(starts, at)
    offsets = before + np.arange(len(at))
    code = np.full(len(starts) + len(at) - 1, len(names) - 1, np.int64)
    code[np.arange(len(starts)) + np.repeat(np.arange(len(at) - 1), np.diff(before))] = words.indices.to_numpy()
    return code, names, offsets


class LogBilinear:
    """Symbols in, log-probabilities out; ``order`` symbols of context."""

    def __init__(self, unigram: np.ndarray, dim: int = 16, order: int = 3, seed: int = 7):
        self.k, self.dim, self.order = len(unigram), dim, order
        rng = np.random.default_rng(seed)
        self.noise = unigram / unigram.sum()
        shapes = (self.k, dim), (self.k, dim), (order, dim), (self.k,)
        self.parts = [rng.normal(0, 0.3, shapes[0]), rng.normal(0, 0.1, shapes[1]), np.ones(shapes[2]) / order, np.log(self.noise)]
        self.parts = [p.astype(np.float32) for p in self.parts]
        self.state = [np.full_like(p, 1e-3) for p in self.parts]

    def start(self, pairs: np.ndarray) -> None:
        """Weights from [symbol, next symbol] counts: the best product of rank
        ``dim`` for the logarithm of how much likelier than overall a symbol
        is after another, rows and columns weighted by frequency."""
        n = pairs.sum()
        if not n:
            return
        rows, columns = pairs.sum(1) / n, pairs.sum(0) / n
        expected = np.outer(pairs.sum(1), columns)
        ratio = np.log((pairs + 2 * columns) / (expected + 2 * columns + 1e-12) + 1e-12)
        weight = np.sqrt(rows + 1e-6)[:, None], np.sqrt(columns + 1e-6)[None, :]
        u, s, v = np.linalg.svd(ratio * weight[0] * weight[1], full_matrices=False)
        m = min(self.dim, len(s))
        root = np.sqrt(s[:m])
        r, q, c, _ = self.parts
        r[:, :m] = u[:, :m] * root / weight[0]
        q[:, :m] = v[:m].T * root / weight[1].T
        c[:] = np.array([1.0, *[0.1] * (self.order - 1)])[:, None]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (*self.parts, *self.state)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for held in (self.parts, self.state):
            for i, p in enumerate(held):
                held[i] = np.asarray(flat[at : at + p.size], np.float32).reshape(p.shape)
                at += p.size

    def copy(self) -> LogBilinear:
        import copy

        return copy.deepcopy(self)

    def logprob(self, seq: np.ndarray, rows: int = 1024) -> np.ndarray:
        """Natural log-probability of each symbol of ``seq`` from ``order`` on,
        fully normalised."""
        r, q, c, b = self.parts
        n, o, d = len(seq) - self.order, self.order, self.dim
        weights, ones = np.concatenate([q.T, b[None]]), np.ones(self.k, np.float32)
        longest, most = float(np.sqrt((q * q).sum(1).max())), float(b.max())
        held = np.empty((rows, self.k), np.float32)
        out = np.empty(n, np.float64)
        for i in range(0, n, rows):
            m = min(rows, n - i)
            near = r[seq[i : i + m + o]]
            h = np.ones((m, d + 1), np.float32)
            h[:, :d] = near[o - 1 : o - 1 + m] * c[0]
            for j in range(1, o):
                h[:, :d] += near[o - 1 - j : o - 1 - j + m] * c[j]
            s = np.matmul(h, weights, out=held[:m])
            w = s[np.arange(m), seq[i + o : i + o + m]].astype(np.float64)
            # as long as no exponential can overflow, the greatest isn't needed
            top = 0.0
            if longest * float(np.sqrt((h[:, :d] ** 2).sum(1).max())) + most > 60:
                top = s.max(1)
                s -= top[:, None]
            np.exp(s, out=s)
            out[i : i + m] = w - top - np.log(s @ ones)
        return out

    def gradients(self, seq: np.ndarray, target: np.ndarray, drawn: np.ndarray) -> list[np.ndarray]:
        """Of the noise-contrastive objective, summed over the positions from
        ``order`` on with ``target`` 1; all share the ``drawn`` noise."""
        r, q, c, b = self.parts
        o, m, d = self.order, len(seq) - self.order, self.dim
        lift = np.log(len(drawn) * self.noise).astype(np.float32)
        near, w = r[seq], seq[o:]
        views = [near[o - 1 - j : o - 1 - j + m] for j in range(o)]
        h = views[0] * c[0]
        for j in range(1, o):
            h += views[j] * c[j]
        qw, qn = q[w], q[drawn]
        g = target / (1 + np.exp(np.einsum("ij,ij->i", h, qw) + b[w] - lift[w]))
        gn = -target[:, None] / (1 + np.exp(-(h @ qn.T + (b[drawn] - lift[drawn]))))
        dh = g[:, None] * qw + gn @ qn
        both = np.zeros((m + o, 2 * d), np.float32)
        dc = np.empty_like(c)
        for j in range(o):
            both[o - 1 - j : o - 1 - j + m, :d] += dh * c[j]
            dc[j] = np.einsum("ij,ij->j", dh, views[j])
        both[o:, d:] = g[:, None] * h
        cells = (seq[:, None] * (2 * d) + np.arange(2 * d)).ravel()
        summed = np.bincount(cells, weights=both.ravel(), minlength=self.k * 2 * d).reshape(self.k, 2 * d)
        dq = summed[:, d:]
        np.add.at(dq, drawn, gn.T @ h)
        db = np.bincount(w, weights=g, minlength=self.k) + np.bincount(drawn, weights=gn.sum(0), minlength=self.k)
        return [summed[:, :d], dq, dc, db]

    def train(self, seq: np.ndarray, target: np.ndarray, rng, noise: int = 32, rows: int = 1024, rate: float = 0.05) -> None:
        """One pass of AdaGrad over ``seq``, ``order`` symbols of context
        first; ``target`` is 0 for padding."""
        total = np.cumsum(self.noise)
        o = self.order
        for i in range(0, len(seq) - o, rows):
            here, at = seq[i : i + rows + o], target[i + o : i + o + rows]
            drawn = np.minimum(np.searchsorted(total, rng.random(noise)), self.k - 1)
            n = max(1.0, float(at.sum()))
            for p, g, s in zip(self.parts, self.gradients(here, at, drawn), self.state, strict=True):
                g = (g / n).astype(np.float32)
                s += g * g
                p += rate * g / np.sqrt(s)


class Alphabet:
    """Which symbol a token belongs to, and the share it has in it."""

    def __init__(self, known: dict[bytes, int], heads: list[bytes], suffixes: list[tuple[bytes, int, int]], tails: int, total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.heads = len(heads)
        kept, rest = suffixes[: tails - 1], suffixes[tails - 1 :]
        self.suffix = {s: self.heads + i for i, (s, _, _) in enumerate(kept)}
        self.other = self.heads + tails - 1
        mass = [n for _, n, _ in kept] + [0] * (tails - 1 - len(kept)) + [sum(n for _, n, _ in rest)]
        kinds = [v for _, _, v in kept] + [0] * (tails - 1 - len(kept)) + [sum(v for _, _, v in rest)]
        self.unigram = np.array([known[w] for w in heads] + mass, float) + 1
        #: log10 of what a tail token's c + 1 is divided by
        self.share = np.concatenate([np.zeros(self.heads), np.log10(np.array(mass, float) + np.array(kinds) + 1)])
        place = {w: i for i, w in enumerate(heads)}
        self.index = {w: i for i, w in enumerate(known)}
        self.symbol = np.array([place[w] if w in place else self.suffix.get(w[-2:], self.other) for w in known] or [0], np.int32)
        self.log_c = np.log10(np.array(list(known.values()) or [0], float) + 1)
        self.end = place.get(END, self.other)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index into the known tokens (-1: none), and the symbol, of each."""
        get = self.index.get
        at = np.array([get(w, -1) for w in words], np.int64)
        symbol = self.symbol[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            symbol[miss] = [self.suffix.get(words[i][-2:], self.other) for i in miss]
        return at, symbol


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token binary, c long) over the rows of ``docs``."""
    def counted(batches):
        def rows(got):
            return pa.record_batch({"token": pa.array(list(got), pa.binary()), "c": pa.array(list(got.values()), pa.int64())})

        held: Counter = Counter()
        for batch in slices(batches, "text", 4 << 20):
            code, names, _ = distinct_tokens(batch.column("text"))
            held.update(dict(zip(names, np.bincount(code, minlength=len(names)).tolist(), strict=True)))
            if len(held) > 400_000:
                yield rows(held)
                held = Counter()
        if held:
            yield rows(held)

    return docs.select("text").mapInArrow(counted, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")).filter("c > 0")


def fit_alphabet(counts: DataFrame, heads: int, tails: int, known: int) -> Alphabet:
    """``known``: so many of the most frequent tokens at most are sent to all
    tasks (a fixed bound, some megabytes); the others' counts are joined.

    They are found by a histogram of the counts' logarithms (some hundred
    rows) and a filter, so that what reaches the driver is what is kept."""
    step = F.floor(F.log2("c") * 16)
    least, held = 0.0, 0
    for r in sorted(counts.groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.b):
        if held + r.n > known:
            least = r.b + 1
            break
        held += r.n
    top = counts.filter(step >= least).collect()
    table = {bytes(r.token): r.c for r in sorted(top, key=lambda r: (-r.c, bytes(r.token)))}
    names = list(table)[:heads]
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # at most 65,793 different endings, whatever the corpus
    ending = F.when(F.length("token") > 2, F.expr("substring(token, -2, 2)")).otherwise(F.col("token"))
    ends = {bytes(r.s): [r.n, r.v] for r in counts.groupBy(ending.alias("s")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    for w in names:
        ends[w[-2:]][0] -= table[w]
        ends[w[-2:]][1] -= 1
    suffixes = sorted(((s, n, v) for s, (n, v) in ends.items() if v), key=lambda x: (-x[1], x[0]))
    return Alphabet(table, names, suffixes, tails, total, distinct)


#: A row for each document, and one for each token in it that isn't among the
#: known ones: its count is joined.
SYMBOLS = "rid long, doc_id long, held_out boolean, sym binary, token binary, tf long, n long, known long, log_c double, inner double"


def symbols(docs: DataFrame, alphabet: Alphabet) -> DataFrame:
    """SYMBOLS of ``docs`` (doc_id, held_out, text): symbols as 16-bit numbers;
    ``inner`` is the log10 probability of the tokens within their symbols, as
    far as counts are known."""
    shared = docs.sparkSession.sparkContext.broadcast(alphabet)
    all_known = alphabet.distinct <= len(alphabet.index)

    def made(batches):
        from pyspark import TaskContext

        alphabet = shared.value
        task, serial = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", 2 << 20):
            code, names, offsets = distinct_tokens(batch.column("text"))
            index, symbol = alphabet.ids(names)
            hit = index >= 0
            log_c = np.where(hit, alphabet.log_c[index], 0.0)
            inner = np.where(symbol >= alphabet.heads, log_c, 0.0) - alphabet.share[symbol]
            n, starts = batch.num_rows, offsets[:-1]
            sums = [np.add.reduceat(x[code], starts) if n else [] for x in (hit.astype(np.int64), log_c, inner)]
            ids = np.arange(serial, serial + n) + (task << 36)
            serial += n
            sym = np.ascontiguousarray(symbol[code].astype("<u2"))
            out = {"rid": pa.array(ids), "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "sym": pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((offsets * 2).astype(np.int64)), pa.py_buffer(sym)]).cast(pa.binary()), "token": pa.nulls(n, pa.binary()), "tf": pa.nulls(n, pa.int64()), "n": pa.array(np.diff(offsets))}
            out |= {k: pa.array(v, t) for k, v, t in zip(("known", "log_c", "inner"), sums, (pa.int64(), pa.float64(), pa.float64()), strict=True)}
            yield pa.record_batch(out)
            if all_known:
                continue
            miss = np.flatnonzero(~hit[code])
            where = np.searchsorted(offsets, miss, "right") - 1
            both, tf = np.unique(where * len(names) + code[miss], return_counts=True)
            m = len(both)
            blank = {k: pa.nulls(m, c.type) for k, c in out.items()}
            yield pa.record_batch(blank | {"rid": pa.array(ids[both // len(names)]), "token": pa.array(names, pa.binary()).take(pa.array(both % len(names))), "tf": pa.array(tf)})

    return docs.select("doc_id", "held_out", "text").mapInArrow(made, SYMBOLS)


def _padded(column: pa.Array, order: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts' symbols one after another, each with ``order`` ends before it,
    and 1 where a symbol is a text's own."""
    data, at = column_bytes(column)
    n = np.diff(at) // 2
    seq = np.full(int(n.sum()) + order * len(n), end, np.int64)
    own = np.arange(int(n.sum())) + order * (np.repeat(np.arange(len(n)), n) + 1)
    seq[own] = np.ascontiguousarray(data).view("<u2")
    target = np.zeros(len(seq), np.float32)
    target[own] = 1
    return seq, target


def count_pairs(train: DataFrame, k: int, end: int) -> np.ndarray:
    """[symbol, next symbol] counts over all of ``train`` (sym binary); at most
    k x k rows reach the driver, whatever the input."""
    def counted(batches):
        total = np.zeros(k * k, np.int64)
        for batch in slices(batches, "sym", 4 << 20):
            seq, target = _padded(batch.column("sym"), 1, end)
            total += np.bincount((seq[:-1] * k + seq[1:])[target[1:] > 0], minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.record_batch({"cell": pa.array(at), "n": pa.array(total[at])})

    out = np.zeros(k * k)
    rows = train.select("sym").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = rows.toPandas()
    out[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return out.reshape(k, k)


def fit_model(train: DataFrame, alphabet: Alphabet, order: int, dim: int, rounds: int = 3) -> LogBilinear:
    """From ``train`` (rid, sym): counts of pairs, then the rounds.  What a
    round sends to the driver is the model's size, whatever the input."""
    sc = train.sparkSession.sparkContext
    model = LogBilinear(alphabet.unigram, dim, order)
    model.start(count_pairs(train, model.k, alphabet.end))
    for turn in range(rounds):
        shared = sc.broadcast((model, alphabet.end))

        def fitted(batches, shared=shared, turn=turn):
            one_thread()
            (own, end), seen, rng = shared.value, 0.0, np.random.default_rng(11 + turn)
            own = own.copy()
            for batch in slices(batches, "sym", 1 << 20):
                seq, target = _padded(batch.column("sym"), order, end)
                own.train(seq, target, rng)
                seen += float(target.sum())
            if seen:
                yield pa.record_batch({"w": pa.array([seen]), "p": pa.array([own.flat().astype(float).tolist()], pa.list_(pa.float64()))})

        part = train.filter(F.pmod(F.xxhash64("rid"), F.lit(rounds)) == turn).select("sym")
        rows = part.mapInArrow(fitted, "w double, p array<double>").select("w", F.posexplode("p").alias("i", "x"))
        mean = rows.groupBy("i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x")).toPandas()
        if len(mean):
            flat = np.empty(len(mean))
            flat[mean["i"].to_numpy(np.int64)] = mean["x"].to_numpy()
            model.load(flat)
    return model


def score_documents(docs: DataFrame, heads: int = 256, tails: int = 128, known: int = 1 << 17, order: int = 3, dim: int = 16, rounds: int = 3) -> DataFrame:
    """Base and model scores of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", text_or_empty().alias("text"), (remainder("doc_id", 7) == 2).alias("held_out"))
    counts = cut(count_tokens(docs.filter("not held_out")))
    alphabet = fit_alphabet(counts, heads, tails, known)
    rows = cut(symbols(docs, alphabet))
    own = rows.filter("sym is not null")
    model = fit_model(own.filter("not held_out"), alphabet, order, dim, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((model, alphabet.end))

    def scored(batches):
        one_thread()
        model, end = shared.value
        for batch in slices(batches, "sym", 1 << 20):
            seq, target = _padded(batch.column("sym"), model.order, end)
            point = np.concatenate([np.zeros(model.order), model.logprob(seq)]) / math.log(10) * target
            starts = np.cumsum([0, *(np.diff(column_bytes(batch.column("sym"))[1]) // 2 + model.order).tolist()])[:-1]
            yield pa.RecordBatch.from_arrays([*batch.select([0, 1, 2, 4, 5, 6]).columns, pa.array(np.add.reduceat(point, starts) + batch.column("inner").to_numpy(zero_copy_only=False))], ["rid", "doc_id", "held_out", "n", "known", "log_c", "point"])

    fields = ["rid", "doc_id", "held_out", "sym", "n", "known", "log_c", "inner"]
    points = own.select(*fields).mapInArrow(scored, "rid long, doc_id long, held_out boolean, n long, known long, log_c double, point double")
    log_c, n_known, score = F.col("log_c"), F.col("known"), F.col("point")
    if alphabet.distinct > len(alphabet.index):
        rest = rows.filter("token is not null").select("rid", "token", "tf").join(counts, "token").groupBy("rid").agg(F.sum("tf").alias("_k"), F.sum(F.expr("tf * log10(c + 1)")).alias("_m"))
        points = points.join(rest, "rid", "left")
        k, m = F.coalesce("_k", F.lit(0)), F.coalesce("_m", F.lit(0.0))
        log_c, n_known, score = log_c + m, n_known + k, score + m
    base = math.log10(alphabet.total + alphabet.distinct + 1)
    return points.select("doc_id", "held_out", F.col("n").alias("n_tokens"), n_known.alias("n_known"), F.lit(alphabet.total).cast("long").alias("train_tokens"), (log_c - F.col("n") * F.lit(base)).alias("base_score"), score.alias("score"))

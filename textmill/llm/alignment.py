"""Two tokenizers' tokens of a text, aligned by the bytes that they cover.

Tokenizer A (byte-level pairs) encodes blank + text, B (sentencepiece, which
puts the blank itself) the text.  Each Arrow partition has a DuckDB connection of
its own in memory: token tables with byte intervals; an ASOF join finds the B
token in which an A token begins and the one in which it ends, a range join the
B tokens between, and these are the links.  Where tokens of both end a group
ends; a window sum over these marks numbers the groups.

Both encoders treat what stands before a blank or line end between two words
apart from what follows: no token of either goes across.  So a text is cut there, and each
distinct unit of a partition is encoded and aligned once; texts are sums over
their units, and their groups follow one another.  Where the neighbours of a
blank could be white space, or there is none, units are as long as need be: a
text may be one.

Counts: a partition gives the number of its documents that hold each linked id
pair; Spark merges these, finds the highest of each A id, and sends the
partition's pairs back to it, where documents are summed up.  What is shuffled
for this are a partition's distinct pairs, so a pair of all documents is a row
of each partition.  The rows of the first pass are written to the shared folder, so
a lost executor costs no more than its tasks.

Null and empty texts, and those whose tokens' bytes of either tokenizer aren't
blank + text, have no tokens: counts 0, digest ''.  Null ids and
repeated rows are rows (and documents) like others, other columns are ignored,
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.operators.storage import spread

from .common import KEPT, fresh_dir, slices, takes_over, trim
from .vocab import _byte_letters, column_bytes

#: Units that a worker keeps aligned, frequent ones being among the first; when
#: they are less than this share of a batch's units, it starts over.
UNITS, SERVED = 200_000, 0.25
#: Bytes of text that are aligned at a time.
BATCH = 2 << 20
#: Rows of partial counts in DuckDB before they are summed up.
PARTIAL = 2_000_000
FIRST = "block int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<int>, pair_a int, pair_b int, docs long"
#: (a, b) as one number: ids of B are below 2^31.
SHIFT = 31


def pieces_of_a(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary file."""
    from tokenizers import Tokenizer

    back = {c: i for i, c in enumerate(_byte_letters())}
    known = Tokenizer.from_file(path)
    out = [b""] * known.get_vocab_size(with_added_tokens=True)
    for token, i in known.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


def pieces_of_b(model) -> list[bytes]:
    """Bytes of each id of a sentencepiece model."""
    def of(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return [of(i) for i in range(model.get_piece_size())]


def _cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where units begin in ``data``: texts with a blank before each.  At each
    text's blank, and at blanks and line ends between two characters that surely
    aren't white space: printing ASCII, or two bytes long from U+00C0 on."""
    mark = np.zeros(len(data), bool)
    plain = (data > 32) & (data < 127)
    two = (data >= 0xC3) & (data <= 0xDF)
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:] = plain[:-1]
    before[2:] |= two[:-2]
    after[:-1] = plain[1:] | two[1:]
    mark[((data == 32) | (data == 10)) & before & after] = True
    mark[at[:-1]] = True
    return np.flatnonzero(mark)


#: Links of new units, from token tables ta and tb of (u, k: number, id, s, e:
#: first byte and the one after the last); k, s and e go on from unit to unit.
LINKS = """CREATE OR REPLACE TEMP TABLE links AS
WITH reach AS (
  SELECT x.u, x.id, x.k, x.low, y.k AS high FROM
    (SELECT ta.u, ta.id, ta.k, ta.e - 1 AS last, tb.k AS low FROM ta ASOF JOIN tb ON ta.s >= tb.s) x
    ASOF JOIN tb y ON x.last >= y.s)
SELECT reach.u, reach.k AS ka, reach.id AS a, tb.k AS kb, tb.id AS b FROM reach JOIN tb ON tb.k BETWEEN reach.low AND reach.high"""
#: Each token's group: the ends of both sides' tokens that stand before it.
GROUPS = """SELECT k, u, id, coalesce(sum((e IN (SELECT {0}.e FROM {0}))::INT) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM {1} ORDER BY k"""


class Pieces:
    """The bytes of a vocabulary's tokens."""

    def __init__(self, of: list[bytes]):
        self.size = np.array([len(x) for x in of], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(of), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.data[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums over runs of the lengths ``n``."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


class Aligner:
    """One worker's encoders, its DuckDB connection, and aligned units."""

    def __init__(self, path_a: str, path_b: str):
        import duckdb
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.pieces = Pieces(pieces_of_a(path_a)), Pieces(pieces_of_b(self.b))
        self.blank = self.b.piece_to_id("▁")
        # an id as it stands in a digest: within a group, at the end of its side
        self.shown = [[np.array([f"{i}{end}" for i in range(len(p.size))], object) for end in (",", last)] for p, last in zip(self.pieces, "|;", strict=True)]
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.fine, self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(0, np.int64) for _ in range(5))
        self.text: list[str] = []
        self.db.execute("CREATE OR REPLACE TABLE pair (u INTEGER, a INTEGER, b INTEGER, n INTEGER)")
        self.db.execute("CREATE OR REPLACE TEMP TABLE pair_new AS FROM pair")

    def begin(self) -> None:
        """Drops the partial counts of the partition before."""
        self.db.execute("CREATE OR REPLACE TABLE partial (a INTEGER, b INTEGER, docs BIGINT)")
        self.rows = 0

    def _tokens(self, units: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For A and B: all units' ids one after another, and how many each
        has; none where a unit's bytes differ.  And which units' don't."""
        texts = [u.decode() for u in units]
        of_a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # B puts a blank before: it stands for the unit's own, or, where a unit
        # begins with a line end, is a token by itself that isn't in the text
        led = [u[0] == 32 for u in units]
        of_b = self.b.encode([t[1:] if own else t for t, own in zip(texts, led, strict=True)], num_threads=1)
        of_b = [x if own or x[:1] != [self.blank] else x[1:] for x, own in zip(of_b, led, strict=True)]
        length = np.array([len(u) for u in units], np.int64)
        flat = np.frombuffer(b"".join(units), np.uint8)
        fine = np.ones(len(units), bool)
        both = []
        for ids, pieces in zip((of_a, of_b), self.pieces, strict=True):
            n = np.array([len(x) for x in ids], np.int64)
            every = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
            both.append((every, n))
            fine &= _sums(pieces.size[every], n) == length
        for (every, n), pieces in zip(both, self.pieces, strict=True):
            same = pieces.joined(every[np.repeat(fine, n)]) == flat[np.repeat(fine, length)]
            fine[fine] = _sums(~same, length[fine]) == 0
        return [every[np.repeat(fine, n)] for every, n in both], [n * fine for _, n in both], fine

    def _table(self, name: str, numbers: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Registers the tokens with their byte intervals."""
        end = np.cumsum(size[ids])
        self.db.register(name, pa.table({"u": numbers.astype(np.int32), "k": np.arange(len(ids)), "id": ids.astype(np.int32), "s": end - size[ids], "e": end}))

    def _groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In the order of the digests: every token's text, unit and whether
        it ends a group."""
        got = [self.db.execute(GROUPS.format(*x)).fetchnumpy() for x in (("tb", "ta"), ("ta", "tb"))]
        g = [x["g"] for x in got]
        place = [np.arange(len(g[0])) + np.searchsorted(g[1], g[0], "left"), np.arange(len(g[1])) + np.searchsorted(g[0], g[1], "right")]
        n = len(g[0]) + len(g[1])
        text, unit, ends = np.empty(n, object), np.zeros(n, np.int64), np.zeros(n, bool)
        for side, (x, at) in enumerate(zip(got, place, strict=True)):
            last = np.append(g[side][1:] != g[side][:-1], True)[: len(at)]
            text[at] = np.where(last, self.shown[side][1][x["id"]], self.shown[side][0][x["id"]])
            unit[at] = x["u"]
            if side:
                ends[at] = last
        return text, unit, ends

    def learn(self, units: list[bytes]) -> None:
        """Aligns units that aren't known yet."""
        first = len(self.known)
        self.known.update(zip(units, range(first, first + len(units)), strict=True))
        ids, n, fine = self._tokens(units)
        for name, x, k, pieces in zip(("ta", "tb"), ids, n, self.pieces, strict=True):
            self._table(name, first + np.repeat(np.arange(len(units)), k), x, pieces.size)
        self.db.execute(LINKS)
        self.db.execute("CREATE OR REPLACE TEMP TABLE pair_new AS SELECT u, a, b, count(*)::INTEGER AS n FROM links GROUP BY u, a, b")
        got = self.db.execute("SELECT u, count(*) AS n FROM links GROUP BY u").fetchnumpy()
        links = np.bincount(got["u"] - first, got["n"], len(units))
        text, unit, ends = self._groups()
        groups = np.bincount(unit - first, ends, len(units))
        bounds = np.searchsorted(unit, first + np.arange(len(units) + 1)).tolist()
        shown = text.tolist()
        self.text += ["".join(shown[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        for name, new in (("fine", fine), ("n_a", n[0]), ("n_b", n[1]), ("n_groups", groups), ("n_links", links)):
            setattr(self, name, np.concatenate([getattr(self, name), new.astype(np.int64)]))

    def settle(self, first: int, new: list[bytes]) -> None:
        """After a batch: its new units, numbered from ``first``, are kept or,
        where there are too many, forgotten."""
        if first + len(new) <= UNITS:
            self.db.execute("INSERT INTO pair FROM pair_new")
        else:
            for u in new:
                del self.known[u]
            del self.text[first:]
            for name in ("fine", "n_a", "n_b", "n_groups", "n_links"):
                setattr(self, name, getattr(self, name)[:first].copy())
        self.db.execute("DELETE FROM pair_new")

    def batch(self, texts: pa.Array) -> dict[str, pa.Array]:
        """The columns of the first pass for texts without nulls; adds their pairs
        to the partial counts."""
        data, at = column_bytes(texts)
        n_docs = len(texts)
        full = np.flatnonzero(at[1:] > at[:-1])  # empty ones have no tokens
        size = (at[1:] - at[:-1])[full]
        start = np.append(0, np.cumsum(size + 1))
        spaced = np.full(int(start[-1]), 32, np.uint8)
        spaced[np.arange(len(data)) + np.repeat(np.arange(len(full)) + 1, size)] = data
        begin = _cuts(spaced, start) if len(spaced) else np.zeros(0, np.int64)
        units = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(spaced)).astype(np.int64)), pa.py_buffer(spaced)]).dictionary_encode()
        names = units.dictionary.to_pylist()
        new = [u for u in names if u not in self.known]
        if len(self.known) + len(new) > UNITS and len(names) - len(new) < SERVED * len(names):
            self.clear()
            new = names
        first = len(self.known)
        if new:
            self.learn(new)
        number = np.array([self.known[u] for u in names], np.int64)[units.indices.to_numpy()] if names else np.zeros(0, np.int64)
        doc = full[np.searchsorted(start, begin, "right") - 1] if len(full) else np.zeros(0, np.int64)
        bad = np.zeros(n_docs, bool)
        bad[doc[self.fine[number] == 0]] = True
        keep = ~bad[doc]
        doc, number = doc[keep], number[keep]
        out = {c: pa.array(np.bincount(doc, getattr(self, c)[number], n_docs).astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")}
        bounds = np.searchsorted(doc, np.arange(n_docs + 1)).tolist()
        unit = number.tolist()
        digests = [hashlib.sha256("".join([self.text[u] for u in unit[i:j]])[:-1].encode()).hexdigest() if j > i else "" for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        self.db.register("held", pa.table({"doc": doc.astype(np.int32), "u": number.astype(np.int32)}))
        self.db.execute("CREATE OR REPLACE TEMP TABLE linked AS SELECT doc, a, b, sum(held.n * pair.n)::INTEGER AS n FROM (SELECT doc, u, count(*) AS n FROM held GROUP BY doc, u) held JOIN (FROM pair UNION ALL FROM pair_new) pair USING (u) GROUP BY doc, a, b")
        self.settle(first, new)
        got = self.db.execute("SELECT doc, a, b, n FROM linked ORDER BY doc, a, b").fetchnumpy()
        self.db.execute("INSERT INTO partial SELECT a, b, count(*) FROM linked GROUP BY a, b")
        self.rows += len(got["doc"])
        if self.rows > PARTIAL:
            self.fold()
        where = pa.array(np.searchsorted(got["doc"], np.arange(n_docs + 1)).astype(np.int32))
        lists = {c: pa.ListArray.from_arrays(where, pa.array(got[c].astype(np.int32))) for c in ("a", "b", "n")}
        return out | {"groups_sha256": pa.array(digests, pa.string())} | lists

    def fold(self) -> None:
        self.db.execute("CREATE OR REPLACE TEMP TABLE folded AS SELECT a, b, sum(docs)::BIGINT AS docs FROM partial GROUP BY a, b")
        self.db.execute("CREATE OR REPLACE TABLE partial AS SELECT * FROM folded")
        self.rows = 0

    def counts(self):
        self.fold()
        yield from self.db.sql("SELECT a, b, docs FROM partial").to_arrow_reader(50_000)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}
KEPT["alignment"] = _ALIGNERS.clear


def aligner(path_a: str, path_b: str) -> Aligner:
    """One a worker process for each two files."""
    takes_over("alignment")
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _record(rows: int, **have: pa.Array) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return pa.record_batch({n: have[n] if n in have else pa.nulls(rows, kinds[k]) for n, k in (x.split() for x in FIRST.split(", "))})


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """FIRST's rows: one for each document, with its distinct linked pairs and
    how often each is linked, and one for each distinct pair of a partition
    (``pair_a`` not null) with how many of its documents hold it."""
    held = spread(docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")))

    def first(batches):
        own = aligner(path_a, path_b)
        own.begin()
        block = TaskContext.get().partitionId()
        for b in slices(batches, "text", BATCH):
            made = own.batch(b.column("text"))
            yield _record(b.num_rows, block=pa.array(np.full(b.num_rows, block, np.int32)), doc_id=b.column("doc_id"), **made)
        for c in own.counts():
            yield _record(c.num_rows, block=pa.array(np.full(c.num_rows, block, np.int32)), pair_a=c.column("a"), pair_b=c.column("b"), docs=c.column("docs"))
        own.begin()
        trim()

    return held.mapInArrow(first, FIRST)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, docs, best): documents of the corpus that hold the pair, and
    whether no pair of its A id has more."""
    merged = aligned.filter("pair_a is not null").groupBy(F.col("pair_a").alias("a"), F.col("pair_b").alias("b")).agg(F.sum("docs").alias("docs"))
    top = F.max("docs").over(Window.partitionBy("a"))
    return merged.withColumn("best", F.col("docs") == top)


def report(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: n_a, n_b, n_groups, n_links, n_best, count_sum
    and groups_sha256."""
    at = fresh_dir(spark, "alignment")
    align(docs, path_a, path_b, key, text).write.option("compression", "zstd").parquet(at)
    aligned = spark.read.schema(FIRST).parquet(at)
    pairs = aligned.filter("pair_a is not null").select("block", F.col("pair_a").alias("a"), F.col("pair_b").alias("b"))
    back = pairs.join(pair_counts(aligned), ["a", "b"]).select("block", F.lit(0).alias("kind"), "a", "b", "docs", "best")
    rows = aligned.filter("pair_a is null").select("block", F.lit(1).alias("kind"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", F.col("a").alias("of_a"), F.col("b").alias("of_b"), F.col("n").alias("of_n"))
    dealt = rows.unionByName(back, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def summed(batches):
        now, held, table = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            turn = batch.column("block").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(turn[1:] != turn[:-1]) + 1).tolist(), len(turn)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                block, kind = divmod(int(turn[i]), 2)
                part = batch.slice(i, j - i)
                if block != now:
                    now, held, table = block, [], None
                if kind == 0:
                    code = (part.column("a").to_numpy().astype(np.int64) << SHIFT) | part.column("b").to_numpy()
                    held.append((code, part.column("docs").to_numpy(), part.column("best").to_numpy(zero_copy_only=False).astype(np.int64)))
                    continue
                if table is None:
                    code, count, best = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
                    order = np.argsort(code)
                    table, held = (code[order], count[order], best[order]), []
                n = part.column("of_n").value_lengths().to_numpy()
                a, b, times = (part.column(f"of_{c}").flatten().to_numpy().astype(np.int64) for c in "abn")
                where = np.searchsorted(table[0], (a << SHIFT) | b)
                sums = [_sums(times * x[where], n) for x in (table[2], table[1])]
                yield pa.record_batch([*(part.column(c) for c in out[:5]), pa.array(sums[0]), pa.array(sums[1]), part.column("groups_sha256")], names=[*out[:5], "n_best", "count_sum", "groups_sha256"])

    found = dealt.mapInArrow(summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return found.withColumnRenamed("doc_id", key)

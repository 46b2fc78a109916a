"""Sub-word statistics: how far words fall apart under a counted vocabulary.

The vocabulary holds the most frequent beginnings of words, and the most
frequent inner parts marked ``##``, counted over a table of words.  A word is
cut by longest match first, as WordPiece does: at each place the longest piece
that the vocabulary has; where there is none, the whole word is unknown and one
token.  Words are cut once each, however often they occur; for whole texts,
once a batch, so that no word is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of a beginning and of an inner part at most; pieces of a vocabulary.
HEAD, INNER, PIECES = 8, 6, 4000
#: Occurrences from which a word's parts are counted.
OFTEN = 2
#: Texts gone through at once, and words remembered with their pieces.
TEXTS, SEEN = 250, 200_000


def vocabulary(words: DataFrame, pieces: int = PIECES) -> list[str]:
    """The ``pieces`` most frequent parts (a documented bound; ties by code
    point) of words (w, n: occurrences), counted with the words' occurrences."""
    often = words.filter(F.col("n") >= OFTEN)
    heads = f"transform(sequence(1, least({HEAD}, length(w))), k -> substring(w, 1, k))"
    inner = f"flatten(transform(sequence(2, length(w)), i -> transform(sequence(1, least({INNER}, length(w) - i + 1)), k -> concat('##', substring(w, i, k)))))"
    parts = often.filter("w <> ''").select("n", F.explode(F.expr(f"if(length(w) > 1, concat({heads}, {inner}), {heads})")).alias("p"))
    most = parts.groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").limit(pieces)
    return sorted(r.p for r in most.collect())


def cut_word(word: str, known: set[str], longest: int) -> list[str] | None:
    """The pieces of a word; none if a place has no piece."""
    out, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        for end in range(min(len(word), at + longest), at, -1):
            if mark + word[at:end] in known:
                out.append(mark + word[at:end])
                at = end
                break
        else:
            return None
    return out


def cut_words(words: DataFrame, pieces: Iterable[str]) -> DataFrame:
    """``words`` (w, ...) with ``tokens``, ``unknown`` (0 or 1) and
    ``continuations`` of each."""
    known = set(pieces)
    longest = max([len(p.removeprefix("##")) for p in known], default=1)

    def made(batches):
        for b in batches:
            got = [cut_word(w, known, longest) for w in b.column("w").to_pylist()]
            yield pa.record_batch([*b.columns, pa.array([1 if g is None else len(g) for g in got], pa.int64()), pa.array([int(g is None) for g in got], pa.int64()), pa.array([0 if g is None else max(0, len(g) - 1) for g in got], pa.int64())], names=[*b.schema.names, "tokens", "unknown", "continuations"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType(list(words.schema.fields))
    for c in ("tokens", "unknown", "continuations"):
        schema = schema.add(c, LongType())
    return words.mapInArrow(made, schema)


def statistics(rows: DataFrame, by: list[str], pieces: Iterable[str]) -> DataFrame:
    """Per ``by``: documents, tokens, their mean, unknown tokens, documents
    (and their share) with one, and continuations, of rows (by, doc_id, w, n:
    the word's occurrences in the document)."""
    cuts = cut_words(rows.select("w").distinct(), pieces)
    per = rows.join(cuts, "w").groupBy(*by, "doc_id").agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in ("tokens", "unknown", "continuations")])
    return _summed(per, by)


def text_statistics(rows: DataFrame, by: list[str], pieces: Iterable[str]) -> DataFrame:
    """The same of rows (by, doc_id, text), a row a document, whose words are
    what white space of ASCII parts; texts without words are no documents."""
    known = set(pieces)
    longest = max([len(p.removeprefix("##")) for p in known], default=1)

    def worth(word, seen={}):
        """Tokens, unknown ones, and 1; nothing for what is no word."""
        got = seen.get(word)
        if got is None:
            if len(seen) >= SEEN:
                seen.clear()
            cuts = cut_word(word, known, longest)
            got = seen[word] = (1, 1, 1) if cuts is None else (len(cuts), 0, int(word != ""))
        return got

    def made(batches):
        for b in (x.slice(k, TEXTS) for x in batches for k in range(0, x.num_rows, TEXTS)):
            words = pc.ascii_split_whitespace(b.column("text").cast(pa.large_string()).fill_null(""))
            once = pc.dictionary_encode(words.flatten())
            each = np.array([worth(w) for w in once.dictionary.to_pylist()], np.int64).reshape(-1, 3)
            sums = np.zeros((len(once) + 1, 3), np.int64)
            np.cumsum(each[once.indices.to_numpy(zero_copy_only=False)], 0, out=sums[1:])
            ends = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))])
            tokens, unknown, n = (sums[ends[1:]] - sums[ends[:-1]]).T
            got = pa.record_batch([*(b.column(c) for c in by), pa.array(tokens), pa.array(unknown), pa.array(tokens - n), pa.array(n)], names=[*by, "tokens", "unknown", "continuations", "n"])
            yield got.filter(pc.greater(got.column("n"), 0))

    from pyspark.sql.types import LongType, StructType

    schema = StructType([rows.schema[c] for c in by])
    for c in ("tokens", "unknown", "continuations", "n"):
        schema = schema.add(c, LongType())
    return _summed(rows.select(*by, "text").mapInArrow(made, schema).drop("n"), by)


def _summed(per: DataFrame, by: list[str]) -> DataFrame:
    """The statistics from a row a document."""
    got = per.groupBy(*by).agg(F.count("*").alias("documents"), *[F.sum(c).alias(c) for c in ("tokens", "unknown", "continuations")], F.count_if(F.col("unknown") > 0).alias("documents_with_unknown"))
    return got.withColumns({"tokens_a_document": F.col("tokens") / F.col("documents"), "pct_with_unknown": F.col("documents_with_unknown") * 100.0 / F.col("documents")})

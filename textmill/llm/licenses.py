"""License scans: a positional index of licence passages' rare words.

A passage of :data:`PASSAGES` is a run of words with a label and phrases that
must stand in it.  Counted over all documents, the rarest half of a passage's
words (two at least, eight at most) are indexed with their places in it.  A
file looks up, for each passage, those of its words that have the highest
inverse document frequency (``LOOK`` of them); a word at place i of the file
and p of the passage says that the passage begins at i - p, and a start on
which two places agree is a candidate.  It is a match if every mandatory phrase
stands where the passage has it, give or take ``SLACK`` words.  A base phrase is
a passage that is mandatory as a whole, without slack: each of its places has
all of its words, so none is lost.  The score is the share of the passage's
words, weighed by rarity, that stand in their places.

Only expressions touch rows: a file's words are cut once, hits and candidates
stay in arrays of its row, and nothing is shuffled but the counts of the
passages' words (a bounded number of rows).

A null text is empty; an empty text has no words, labels '' and score 0.  Equal
words in several places are several places.  Words that tie in rarity follow
the order of code points.  Null ids and repeated rows are rows like others,
other columns are ignored whatever their names, an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.storage import once, spread

#: Words of lower-cased text: digits, small letters and what isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words looked up for a file and passage, and by how much a phrase may shift.
LOOK, SLACK = 4, 3
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and their labels (fixed values).
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Labels, passages and their mandatory phrases: public licences' own notices
#: (fixed values), in the words of :data:`WORD`.
PASSAGES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "to any person obtaining a copy")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2.0", "you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "are permitted provided that")),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ("neither the name of", "to endorse or promote products")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "for any purpose with or without fee")),
    ("gpl-2.0", "gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "gnu general public license version 3", ("general public license version 3",)),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("free software you can redistribute it and or modify it",)),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2",)),
    ("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc0", "released under cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "into the public domain")),
    ("as-is", "the software is provided as is without warranty of any kind", ("provided as is without warranty",)),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", ("unauthorized copying of this file", "strictly prohibited")),
    ("spdx-apache-2.0", "spdx license identifier apache 2 0", ("spdx license identifier apache 2 0",)),
    ("spdx-mit", "spdx license identifier mit", ("spdx license identifier mit",)),
)


@dataclass(frozen=True)
class Passage:
    label: str
    words: tuple[str, ...]
    must: tuple[tuple[int, tuple[str, ...]], ...]  # place in the passage, words
    base: bool

    @property
    def slack(self) -> int:
        return 0 if self.base else SLACK

    @property
    def indexed(self) -> int:
        """How many of its distinct words are indexed."""
        return min(8, max(2, -(-len(self.words) // 2)), len(set(self.words)))


def passages(base=BASE, more=PASSAGES) -> list[Passage]:
    """Raises for a phrase that isn't in its passage, and for passages of one
    word, as no two places could agree on them."""
    out = []
    for label, text, must, own in [*((a, t, (t,), True) for a, t in base), *((a, t, m, False) for a, t, m in more)]:
        words = tuple(text.split())
        if len(set(words)) < 2:
            raise ValueError(f"a passage needs two words: {text!r}")
        places = []
        for phrase in must:
            p = tuple(phrase.split())
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            if not at:
                raise ValueError(f"{phrase!r} is not in {text!r}")
            places.append((at[0], p))
        out.append(Passage(label, words, tuple(places), own))
    return out


def _words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words): the whole text's words in order."""
    low = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), CAPITALS, SMALL)
    held = spread(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias(text)))
    return once(held.select("key", low.alias("low")), words=F.regexp_extract_all("low", F.lit(WORD), F.lit(0))).select("key", "words")


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def rarity(docs: DataFrame, known: list[Passage], key: str = "doc_id", text: str = "text") -> dict[str, float]:
    """1 + ln((documents + 1) / (documents with the word + 1)) of each word of
    the passages, over all documents; the driver gets one row a word."""
    lexicon = sorted({w for p in known for w in p.words})
    cut = _words(docs, key, text)
    seen = cut.select(F.explode(F.expr(f"concat(array(''), array_distinct(filter(words, w -> w in ({_listed(lexicon)}))))")).alias("w"))
    n = {r.w: r.n for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: 1 + math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) for w in lexicon}


def _index(known: list[Passage], idf: dict[str, float]) -> tuple[str, list[str]]:
    """The passages as an SQL array, each with its postings (rarest words
    first), and the indexed words."""
    words: set[str] = set()
    out = []
    for i, p in enumerate(known):
        rare = sorted(set(p.words), key=lambda w: (-idf[w], w))[: p.indexed]
        words |= set(rare)
        post = ", ".join(f"named_struct('w', '{w}', 'at', array({', '.join(str(k) for k, x in enumerate(p.words) if x == w)}))" for w in rare)
        must = ", ".join(f"named_struct('at', {at}, 'words', array({_listed(ws)}))" for at, ws in p.must)
        weight = ", ".join(f"{idf[w]!r}D" for w in p.words)
        out.append(f"named_struct('id', {i}, 'slack', {p.slack}, 'words', array({_listed(p.words)}), 'idf', array({weight}), 'total', {sum(idf[w] for w in p.words)!r}D, 'index', array({post}), 'must', array({must}))")
    return f"array({', '.join(out)})", sorted(words)


def matches(docs: DataFrame, known: list[Passage] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, found): each document's matches as an array of (id of
    the passage, at: the word it begins with, score)."""
    known = passages() if known is None else known
    templates, indexed = _index(known, rarity(docs, known, key, text))
    cut = _words(docs, key, text)
    places = once(cut, at=F.expr(f"filter(sequence(0, size(words)), i -> get(words, i) in ({_listed(indexed)}))"))
    hits = once(places, hits=F.expr("transform(at, i -> named_struct('i', i, 'w', get(words, i)))"))
    held = once(hits, present=F.expr("array_distinct(transform(hits, h -> h.w))"))
    # the starts that the looked-up words' postings give, in order: equal
    # neighbours are places that agree
    starts = f"""sort_array(flatten(transform(slice(filter(t.index, x -> array_contains(present, x.w)), 1, {LOOK}),
        x -> flatten(transform(filter(hits, h -> h.w = x.w), h -> transform(x.at, p -> h.i - p))))))"""
    agreed = f"array_distinct(flatten(transform(array({starts}), v -> filter(v, (d, j) -> j > 0 and get(v, j - 1) = d))))"
    verified = f"""filter({agreed}, d -> forall(t.must, p -> exists(sequence(d + p.at - t.slack, d + p.at + t.slack),
        s -> s >= 0 and slice(words, greatest(s, 0) + 1, size(p.words)) = p.words)))"""
    share = "aggregate(sequence(0, size(t.words) - 1), 0D, (a, k) -> a + if(get(words, d + k) = get(t.words, k), get(t.idf, k), 0D)) / t.total"
    able = f"filter({templates}, t -> size(filter(t.index, x -> array_contains(present, x.w))) > 1)"
    found = F.expr(f"flatten(transform({able}, t -> transform({verified}, d -> named_struct('id', t.id, 'at', d, 'score', {share}))))")
    none = F.expr("cast(array() as array<struct<id:int,at:int,score:double>>)")
    return once(held, found=F.when(F.size("present") > 1, found).otherwise(none)).select(F.col("key").alias(key), F.size("words").cast("long").alias("n_words"), "found")


def places(docs: DataFrame, known: list[Passage] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each match: key, label, first word (from 0), words of the
    passage, whether it is a base phrase, score."""
    known = passages() if known is None else known
    names = F.array(*[F.struct(F.lit(p.label).alias("label"), F.lit(len(p.words)).cast("long").alias("n"), F.lit(p.base).alias("base")) for p in known])
    each = matches(docs, known, key, text).select(F.col(f"`{key}`").alias("k"), F.explode("found").alias("x"))
    own = F.element_at(names, F.col("x.id") + 1)
    return each.select(F.col("k").alias(key), own["label"].alias("label"), F.col("x.at").cast("long").alias("first_word"), own["n"].alias("words"), own["base"].alias("is_base"), "x.score")


def scan_report(docs: DataFrame, known: list[Passage] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: n_words, n_base (places of base phrases), their
    smallest and largest start, labels, and the best match's score."""
    known = passages() if known is None else known
    n_base = sum(p.base for p in known)  # they come first
    labels = f"array({_listed(p.label for p in known)})"
    own = F.expr(f"filter(found, x -> x.id < {n_base})")
    named = lambda c: f"array_join(array_sort(array_distinct(transform({c}, x -> get({labels}, x.id)))), ',')"
    got = once(matches(docs, known, key, text), own=own)
    return got.select(
        key, "n_words", F.size("own").cast("long").alias("n_base"),
        F.expr("array_min(transform(own, x -> x.at))").cast("long").alias("first_word"), F.expr("array_max(transform(own, x -> x.at))").cast("long").alias("last_word"),
        F.expr(named("own")).alias("base_labels"), F.expr(named("found")).alias("labels"),
        F.round(F.coalesce(F.expr("array_max(transform(found, x -> x.score))"), F.lit(0.0)), 6).alias("score"),
    )


def oracle_sql() -> str:
    """``scan_report`` of documents as one DuckDB statement over tables of the
    passages: words, postings and phrases are rows there."""
    known = passages()
    rows = lambda xs: ", ".join(f"({', '.join(map(str, x))})" for x in xs)
    return f"""WITH p(t, label, base, slack, n, most) AS (VALUES {rows((i, f"'{p.label}'", p.base, p.slack, len(p.words), p.indexed) for i, p in enumerate(known))}),
 tw(t, k, w) AS (VALUES {rows((i, k, f"'{w}'") for i, p in enumerate(known) for k, w in enumerate(p.words))}),
 must(t, pos, ws) AS (VALUES {rows((i, at, f"[{_listed(ws)}]") for i, p in enumerate(known) for at, ws in p.must)}),
 d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
 occ AS (SELECT r, i, w FROM (SELECT r, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM tw)),
 df AS (SELECT l.w, count(DISTINCT r) AS df, 1 + ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT r) + 1)) AS idf FROM (SELECT DISTINCT w FROM tw) l LEFT JOIN occ ON occ.w = l.w GROUP BY l.w),
 idx AS (SELECT t, w, k FROM (SELECT t, w, row_number() OVER (PARTITION BY t ORDER BY df, w) AS k FROM (SELECT DISTINCT t, w FROM tw) JOIN df USING (w)) JOIN p USING (t) WHERE k <= most),
 looked AS (SELECT r, t, w FROM (SELECT r, t, w, row_number() OVER (PARTITION BY r, t ORDER BY k) AS j FROM (SELECT DISTINCT r, w FROM occ) JOIN idx USING (w)) WHERE j <= {LOOK}),
 cand AS (SELECT r, t, i - k AS pos FROM looked JOIN occ USING (r, w) JOIN tw USING (t, w) GROUP BY ALL HAVING count(*) > 1),
 bad AS (SELECT DISTINCT c.r, c.t, c.pos FROM cand c JOIN must m USING (t) JOIN p USING (t) JOIN d USING (r)
   WHERE NOT list_bool_or(list_transform(range(c.pos + m.pos - p.slack, c.pos + m.pos + p.slack + 1), lambda s: s >= 0 AND d.ws[s + 1:s + len(m.ws)] = m.ws))),
 ver AS (SELECT * FROM cand ANTI JOIN bad USING (r, t, pos)),
 scored AS (SELECT v.r, v.t, v.pos, sum(idf) FILTER (occ.w IS NOT NULL) / sum(idf) AS score FROM ver v JOIN tw USING (t) JOIN df USING (w) LEFT JOIN occ ON occ.r = v.r AND occ.i = v.pos + tw.k AND occ.w = tw.w GROUP BY v.r, v.t, v.pos),
 f AS (SELECT r, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round(max(score), 6) AS score FROM scored JOIN p USING (t) GROUP BY r)
 SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN f USING (r)"""

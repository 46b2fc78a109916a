"""Seeded obfuscation of texts, with protected tokens and edit figures.

Two modes: ``hash_mode`` ranks tokens and positions by hashes and is one
expression over records x conditions; ``mt_mode`` follows the draws of a
seeded Mersenne Twister and gives the same strings for the same seed.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.operators.storage import once

#: Families, severities, look-alike digits, Cyrillic letters.
FAMILIES = ("O1_CHAR_SUBSTITUTION", "O2_CHAR_INSERT_DELETE", "O3_WHITESPACE", "O4_UNICODE_ORTHOGRAPHIC")
SEVERITIES = ("MILD", "STRONG")
DIGIT_FROM, DIGIT_TO = "aAeEiIoOsStTgGbB", "4433110055779988"
LOOKALIKE_FROM, LOOKALIKE_TO = "aAcCeEoOpPxX", "аАсСеЕоОрРхХ"
SEED = 42
MILD_MAX_RATIO, STRONG_MAX_RATIO, MIN_LENGTH_RATIO, MAX_LENGTH_RATIO = 0.20, 0.35, 0.5, 2.0
#: What is protected.
URL = r"(?i)https?://\S+|www\.\S+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
TAG = r"^[@#]\S+$"

#: A token x.t is open to change: four letters or digits, one of them no digit
#: of ASCII, and no address, mention or tag.  Cheap conditions come first.
OPEN = "x.t rlike '(?:[\\\\p{L}\\\\p{N}][^\\\\p{L}\\\\p{N}]*){4}' and x.t rlike '[\\\\p{L}\\\\p{N}&&[^0-9]]' and not (left(x.t, 1) in ('@', '#') and length(x.t) > 1) and not (contains(x.t, '@') and x.t rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}') and not ((contains(x.t, '://') or contains(x.t, '.')) and x.t rlike '(?i)https?://|www[.]')"


def conditions(df: DataFrame) -> DataFrame:
    """Records x the eight conditions; a generator, no join."""
    made = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(s).alias("severity")) for f in FAMILIES for s in SEVERITIES])
    return df.withColumn("_c", F.explode(made)).select(*df.columns, "_c.family", "_c.severity")


def eligible_tokens(tokens: str | None = None, text: str = "text") -> Column:
    """Array of struct(i, t): 1-based positions of open tokens."""
    tokens = tokens or f"regexp_extract_all({text}, '\\\\S+', 0)"
    return F.expr(f"filter(transform({tokens}, (t, i) -> named_struct('i', cast(i + 1 as long), 't', t)), x -> {OPEN})")


def protected_spans(text: str = "text") -> Column:
    """URLs, then e-mail addresses, then mentions and tags."""
    return F.expr(f"concat(regexp_extract_all({text}, '(?i)https?://\\\\S+|www[.]\\\\S+', 0), regexp_extract_all({text}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}', 0), filter(regexp_extract_all({text}, '\\\\S+', 0), x -> x rlike '^[@#].'))")


def spans_kept(spans: str, text: str) -> Column:
    return F.expr(f"forall({spans}, s -> contains({text}, s))")


ALNUM = "[\\\\p{L}\\\\p{N}]"
#: For each family: positions open to change in chars c (1-based), how many.
_OPEN = {
    "O1_CHAR_SUBSTITUTION": f"filter(sequence(1, size(c)), p -> instr('{DIGIT_FROM}', c[p - 1]) > 0)",
    "O2_CHAR_INSERT_DELETE": f"filter(sequence(1, size(c)), p -> p > 1 and p < size(c) and c[p - 1] rlike '{ALNUM}' and c[greatest(p - 2, 0)] rlike '{ALNUM}')",
    "O3_WHITESPACE": f"filter(sequence(1, size(c)), p -> p > 1 and c[p - 1] rlike '{ALNUM}' and c[greatest(p - 2, 0)] rlike '{ALNUM}')",
    "O4_UNICODE_ORTHOGRAPHIC": f"filter(sequence(1, size(c)), p -> instr('{LOOKALIKE_FROM}', c[p - 1]) > 0)",
}


def homoglyph_only(records: DataFrame, seed: int = SEED) -> DataFrame:
    """The look-alike family without its fall-back to doubled letters, so that
    :func:`normalize_homoglyphs` restores every text."""
    return hash_mode(records, FAMILIES[3], seed, fall_back=False)


def hash_mode(records: DataFrame, family: str, seed: int = SEED, fall_back: bool | None = True) -> DataFrame:
    """Adds severity (both, where ``records`` has none), text_obfuscated,
    modified_token_count, modified_char_count and changed to records with
    doc_id and text, for one family.  A text is cut into tokens once for both severities; only chosen
    tokens are taken apart, and the text around them is joined as it is.  With
    ``fall_back`` None, rows come with and without the look-alike family's fall-back,
    told apart by a column ``fall_back``, and are cut into tokens once for both."""
    key = lambda *more: "md5(concat_ws('|', '%d', doc_id, '%s', severity, %s))" % (seed, family, ", ".join(more))
    few = "if(severity = 'MILD', 1, 2)"
    # tokens with the white space before them
    df = once(records, _z=F.expr("regexp_extract_all(text, '\\\\s*\\\\S+', 0)"))
    tokens = F.expr("transform(_z, z -> regexp_replace(z, '^\\\\s+', ''))")
    df = once(once(df, _w=tokens), _e=eligible_tokens("_w"))
    ready = "filter(_e, x -> x.t rlike '[%s]')" % DIGIT_FROM if family == FAMILIES[0] else "_e"
    df = once(df, _i=F.expr(f"transform({ready}, x -> x.i)")).drop("_e")
    if "severity" not in records.columns:
        df = df.withColumn("severity", F.explode(F.array(*map(F.lit, SEVERITIES))))
    picks = once(df, _k=F.expr(f"slice(array_sort(transform(_i, i -> named_struct('k', {key('i')}, 'i', i))), 1, {few})"))
    df = once(picks, _k=F.expr("transform(_k, x -> named_struct('i', x.i, 'c', filter(split(_w[x.i - 1], ''), y -> y <> '')))")).drop("_i")
    many = few if family == FAMILIES[0] else "1"
    picked = lambda open_: f"transform(slice(array_sort(transform({open_}, p -> named_struct('k', {key('x.i', 'p')}, 'p', p))), 1, {many}), y -> y.p)"
    opened = _OPEN[family].replace("(c)", "(x.c)").replace("c[", "x.c[")
    df = once(df, _p=F.expr(f"transform(_k, x -> named_struct('i', x.i, 'c', x.c, 'p', {picked(opened)}, 'how', 0))"))
    if fall_back is None:
        df = df.withColumn("fall_back", F.explode(F.array(F.lit(False), F.lit(True))))
    if family == FAMILIES[3] and fall_back is not False:
        stays = "size(x.p) > 0" if fall_back else "size(x.p) > 0 or not fall_back"
        vowel = "filter(sequence(1, size(x.c)), p -> lower(x.c[p - 1]) in ('a', 'e', 'i', 'o', 'u'))"
        inner = f"filter(sequence(1, size(x.c)), p -> p > 1 and p < size(x.c) and x.c[p - 1] rlike '{ALNUM}')"
        df = once(df, _p=F.expr(f"transform(_p, x -> if({stays}, x, named_struct('i', x.i, 'c', x.c, 'p', {picked(vowel)}, 'how', 1)))"))
        df = once(df, _p=F.expr(f"transform(_p, x -> if({stays}, x, named_struct('i', x.i, 'c', x.c, 'p', {picked(inner)}, 'how', 1)))"))
    coin = f"size(filter(x.c, y -> y rlike '{ALNUM}')) >= 5 and substring({key('x.i', chr(39) + 'coin' + chr(39))}, 1, 1) in ('0', '1', '2', '3', '4', '5', '6', '7')"
    change = {
        FAMILIES[0]: f"translate(y, '{DIGIT_FROM}', '{DIGIT_TO}')",
        FAMILIES[1]: f"if({coin}, '', concat(y, y))",
        FAMILIES[2]: "concat(' ', y)",
        FAMILIES[3]: f"if(x.how = 0, translate(y, '{LOOKALIKE_FROM}', '{LOOKALIKE_TO}'), concat(y, y))",
    }[family]
    made = f"array_join(transform(x.c, (y, j) -> if(array_contains(x.p, j + 1), {change}, y)), '')"
    gap = "left(_z[x.i - 1], length(_z[x.i - 1]) - length(_w[x.i - 1]))"
    df = once(df, _n=F.expr(f"array_sort(transform(filter(_p, x -> size(x.p) > 0), x -> named_struct('i', x.i, 't', concat({gap}, {made}))))"))
    # the tokens before, between and after the (one or two) changed ones
    spliced = "aggregate(_n, named_struct('at', 1L, 'out', ''), (a, x) -> named_struct('at', x.i + 1, 'out', concat(a.out, array_join(slice(_z, cast(a.at as int), cast(x.i - a.at as int)), ''), x.t)), a -> concat(a.out, array_join(slice(_z, cast(a.at as int), size(_z)), '')))"
    tail = "regexp_extract(right(text, length(text) - length(array_join(_z, ''))), '^(\\\\s*)$', 1)"
    df = once(df, text_obfuscated=F.expr(f"if(size(_n) = 0, text, concat({spliced}, {tail}))"))
    # each place is one substitution, insertion or deletion
    edits = F.expr("aggregate(_p, 0L, (a, x) -> a + size(x.p))")
    df = df.withColumns({"modified_token_count": F.size("_n").cast("long"), "modified_char_count": edits, "changed": F.col("text_obfuscated") != F.col("text")})
    return df.drop("_k", "_p", "_n", "_z", "_w")


def excessive(count: str = "modified_char_count", text: str = "text") -> Column:
    """Whether more of a text is modified than its severity allows."""
    ratio = F.col(count) / F.greatest(F.length(text), F.lit(1))
    return ratio > F.when(F.col("severity") == "MILD", MILD_MAX_RATIO).otherwise(STRONG_MAX_RATIO)


def _common(a: str, i: int, b: str, j: int) -> int:
    """How far a[i:] and b[j:] agree; slices are compared, not characters."""
    n = min(len(a) - i, len(b) - j)
    at, step = 0, 64
    while at < n:
        end = min(at + step, n)
        if a[i + at : i + end] != b[j + at : j + end]:
            while end - at > 1:
                mid = (at + end) // 2
                if a[i + at : i + mid] == b[j + at : j + mid]:
                    at = mid
                else:
                    end = mid
            return at
        at, step = end, step * 2
    return n


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance (-1 above ``most``, if given): the furthest point
    on each diagonal for 0, 1, ... edits (Ukkonen 1985), so long texts with few
    edits take a few slice comparisons."""
    n, m = len(a), len(b)
    reach = {0: _common(a, 0, b, 0)}
    if n == m == reach[0]:
        return 0
    for edits in range(1, (max(n, m) if most is None else most) + 1):
        ahead = {}
        for d in range(max(-edits, -n), min(edits, m) + 1):
            at = min(max(reach.get(d, -2) + 1, reach.get(d - 1, -1), reach.get(d + 1, -2) + 1), n, m - d)
            if at >= 0 and at + d >= 0:
                ahead[d] = at + _common(a, at, b, at + d)
                if d == m - n and ahead[d] == n:
                    return edits
        reach = ahead
    return -1


def edit_figures(df: DataFrame) -> DataFrame:
    """status, modified_char_count (at most four edits are made) and its
    share.  Spark's own levenshtein, threshold or not, is quadratic in the
    text."""
    @F.pandas_udf("long")
    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edit_distance(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int64")

    df = df.withColumn("status", F.when(F.col("changed"), "SUCCESS").otherwise("NO_CHANGE"))
    df = df.withColumn("modified_char_count", edits("text", "text_obfuscated"))
    return df.withColumn("modified_char_ratio", F.bround(F.col("modified_char_count") / F.greatest(F.length("text"), F.lit(1)), 4))


def normalize_homoglyphs(text: Column) -> Column:
    return F.translate(text, LOOKALIKE_TO, LOOKALIKE_FROM)


# --- the seeded mode -------------------------------------------------------

_DIGITS = dict(zip(DIGIT_FROM, DIGIT_TO, strict=True))
_LOOKALIKES = dict(zip(LOOKALIKE_FROM, LOOKALIKE_TO, strict=True))


def protected(token: str) -> bool:
    core = [c for c in token if c.isalnum()]
    return len(core) < 4 or all(c.isdigit() for c in core) or bool(re.search(URL, token) or re.search(EMAIL, token) or re.fullmatch(TAG, token))


@lru_cache(maxsize=8)
def open_spans(text: str) -> tuple[tuple[int, int], ...]:
    """[start, end) of the tokens open to change; a text's conditions follow
    one another, so they share one pass."""
    return tuple(m.span() for m in re.finditer(r"\S+", text) if not protected(m[0]))


def _between(token: str, last: int) -> list[int]:
    """Positions from 1 up to before ``last`` with letters or digits there and
    just before."""
    return [i for i in range(1, last) if token[i].isalnum() and token[i - 1].isalnum()]


def _twice(token: str, at: int) -> str:
    return token[:at] + token[at] + token[at:]


def _edit(family: str, severity: str, token: str, rng: random.Random) -> str | None:
    """The changed token, or None; the order of draws is part of the format."""
    if family == FAMILIES[0]:
        spots = [i for i, c in enumerate(token) if c in _DIGITS]
        drawn = rng.sample(spots, k=min(len(spots), 1 if severity == "MILD" else 2))
        return "".join(_DIGITS[c] if i in drawn else c for i, c in enumerate(token))
    if family == FAMILIES[1]:
        if not (spots := _between(token, len(token) - 1)):
            return None
        at, low = rng.choice(spots), rng.random() < 0.5
        return token[:at] + token[at + 1 :] if low and sum(map(str.isalnum, token)) >= 5 else _twice(token, at)
    if family == FAMILIES[2]:
        if not (spots := _between(token, len(token))):
            return None
        at = rng.choice(spots)
        return f"{token[:at]} {token[at:]}"
    if spots := [i for i, c in enumerate(token) if c in _LOOKALIKES]:
        at = rng.choice(spots)
        return token[:at] + _LOOKALIKES[token[at]] + token[at + 1 :]
    spots = [i for i, c in enumerate(token) if c.lower() in "aeiou"] or [i for i in range(1, len(token) - 1) if token[i].isalnum()]
    return _twice(token, rng.choice(spots)) if spots else None


def mt_obfuscate(text: str, record_id: str, family: str, severity: str, seed: int = SEED) -> tuple[str, int]:
    """The changed text and the number of changed tokens."""
    if family not in FAMILIES or severity not in SEVERITIES:
        if family == "NORMAL" or severity == "NORMAL":
            return text, 0
        raise ValueError(f"unknown condition {family} {severity}")
    rng = random.Random(int(hashlib.sha256(f"{seed}|{record_id}|{family}|{severity}".encode()).hexdigest()[:16], 16))
    spans = list(open_spans(text))
    if family == FAMILIES[0]:
        spans = [s for s in spans if any(c in _DIGITS for c in text[slice(*s)])]
    if not spans:
        return text, 0
    chosen = rng.sample(spans, k=min(len(spans), 1 if severity == "MILD" else 2))
    new = {}
    for span in sorted(chosen, reverse=family == FAMILIES[0]):
        if (edited := _edit(family, severity, text[slice(*span)], rng)) is not None:
            new[span] = edited
    out, at = [], 0
    for (a, b), edited in sorted(new.items()):
        out += [text[at:a], edited]
        at = b
    return "".join([*out, text[at:]]), len(new)


def mt_mode(records: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds text_obfuscated, modified_token_count and changed to records with
    record_id, text, family, severity."""
    @F.pandas_udf("text_obfuscated string, modified_token_count long")
    def made(text: pd.Series, rid: pd.Series, family: pd.Series, severity: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mt_obfuscate(*r, seed) for r in zip(text.fillna(""), rid, family, severity, strict=True)], columns=["text_obfuscated", "modified_token_count"])

    df = records.withColumn("_o", made("text", "record_id", "family", "severity")).select(*records.columns, "_o.*")
    return df.withColumn("changed", F.col("text_obfuscated") != F.col("text"))


@dataclass(frozen=True)
class Obfuscation:
    """What became of one text."""

    source_record_id: str
    text_original: str
    text_obfuscated: str
    family: str
    severity: str
    seed: int
    changed: bool
    status: str
    modified_char_count: int
    modified_char_ratio: float
    modified_token_count: int
    failure_reason: str | None


def obfuscate(text: str, source_record_id: str, family: str, severity: str, seed: int = SEED) -> Obfuscation:
    """One text under one condition; the control (NORMAL, NORMAL) is a success
    without a change.  Raises on unknown conditions and values that are no
    text."""
    if not isinstance(text, str) or not isinstance(source_record_id, str):
        raise TypeError("text and record id must be strings")
    if (family == "NORMAL") != (severity == "NORMAL") or family not in (*FAMILIES, "NORMAL") or severity not in (*SEVERITIES, "NORMAL"):
        raise ValueError(f"unknown condition {family} {severity}")
    out, tokens = mt_obfuscate(text, source_record_id, family, severity, seed)
    changed = out != text
    edits = edit_distance(text, out) if changed else 0
    reason = None
    if not changed and family != "NORMAL":
        reason = "no token is open to change" if not open_spans(text) else "no open token can be changed in this way"
    return Obfuscation(source_record_id, text, out, family, severity, seed, changed, "SUCCESS" if changed or family == "NORMAL" else "NO_CHANGE", edits, round(edits / max(1, len(text)), 4), tokens, reason)

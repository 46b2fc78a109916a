"""Text keys, quality flags and heuristics as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode white space and the four information separators (fixed values).
#: Spelt out: a pattern in Unicode mode is several times slower.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_GAP = "\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACE = f"[{_GAP}]+"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility normal form; Spark has no function for it."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def exact_key(text: Column) -> Column:
    return F.sha2(text, 256)


def whitespace_key(text: Column) -> Column:
    return F.sha2(collapsed(text), 256)


def normalized_key(text: Column) -> Column:
    return F.sha2(collapsed(F.lower(nfkc(text))), 256)


def alnum_key(text: Column) -> Column:
    """Null where no ASCII letter or digit is left, so it joins nothing."""
    left = F.regexp_replace(F.lower(nfkc(text)), "[^a-z0-9]", "")
    return F.sha2(F.when(left != "", left), 256)


def group_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(key, 1, 12))


def author_group(scope: str, author: Column) -> Column:
    return F.concat(F.lit(scope + "_AUTH_"), F.substring(F.md5(F.lower(F.trim(author)).cast("binary")), 1, 10))


def iso_from_seconds(seconds: Column) -> Column:
    """UTC; null where the value is no number."""
    return F.date_format(F.timestamp_seconds(seconds.cast("string").try_cast("double")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_from_string(value: Column) -> Column:
    return F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd'T'HH:mm:ss'Z'")


#: Look-alike mathematical letters, marks of an address.
MATH = "[\\x{1D400}-\\x{1D7FF}\\x{2460}-\\x{24FF}\\x{2100}-\\x{214F}]"
URL = "(?i)https?://|www\\.|\\.com|\\.id|\\.net|\\.xyz|\\.link"
URL_MARKS = ("http://", "https://", "www.", ".com", ".id", ".net", ".xyz", ".link")


def quality_flags(text: Column) -> Column:
    """Array of flags, in their fixed order; a blank or null text has one flag
    only.  Each flag is a search that ends at its first hit."""
    stripped = F.btrim(text, F.lit(BLANKS))
    low = F.lower(text)
    tests = {
        "very_short": (F.length(stripped) < 4) | ~text.rlike(f"[^{_GAP}][{_GAP}]+[^{_GAP}]"),
        "very_long": F.length(stripped) > 1000,
        "digits_only": stripped.rlike(f"^[\\p{{Nd}}{_GAP}]+$"),
        "no_alphanumeric_chars": ~text.rlike("[\\p{L}\\p{N}]"),
        "has_url": reduce(or_, [low.contains(m) for m in URL_MARKS]),
        "has_unicode_math": text.rlike(MATH),
        "whitespace_anomaly": text.rlike("[\\r\\n\\t\\x{A0}\\x{200B}]|  "),
        "control_characters": text.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]"),
    }
    flags = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]), lambda x: x.isNotNull())
    return F.when(text.isNull() | (stripped == ""), F.array(F.lit("empty_or_whitespace_text"))).otherwise(flags)


def quality_status(flags: Column) -> Column:
    return F.when(F.array_contains(flags, "empty_or_whitespace_text"), "invalid").when(F.size(flags) > 0, "suspicious").otherwise("valid")


#: Named entities, matched on normalised lower-case text.
BRANDS = {
    "ambil4d": r"ambil\s*4\s*d",
    "gunungwin": r"gunung\s*win",
    "alexis17": r"alexis\s*[-_☯❤️]*\s*17",
    "wisdomtoto": r"wisdom\s*toto",
    "pas4d": r"pas\s*4\s*d",
    "bardi4d": r"bardi\s*4\s*d",
    "garudahoki": r"ga\s*ruda\s*[-_ ]*ho\s*ki|garuda\s*hoki",
    "kembar78": r"kembar\s*78",
    "pulauwin": r"pulau\s*win",
    "weton88": r"weton\s*`*88",
    "timo4d": r"timo\s*4\s*d",
    "wifi4d": r"wifi\s*4\s*d",
    "sendal4d": r"sendal\s*4\s*d",
    "takjub4d": r"takjub\s*4\s*d",
    "berkah99": r"berkah\s*99",
    "toke69": r"t\s*o\s*k\s*e\s*6\s*9|toke\s*69",
    "artis4d": r"artis\s*4\s*d",
    "dewa787": r"dewa\s*787",
    "mona4d": r"mona\s*4\s*d",
    "mamajitu": r"mamajitu",
    "poipet308": r"poipet\s*308",
    "dora77": r"dora\s*77",
}
#: Lexical signals.
SIGNALS = {
    "slot": r"\bslot\b",
    "gacor": r"\bgacor\b",
    "maxwin": r"\bmaxwin\b",
    "scatter": r"\bscatter\b",
    "pragmatic": r"\bpragmatic\b",
    "zeus_olympus": r"\bzeus\b|kakek\s*zeus|\bolympus\b",
    "depo_deposit": r"\bdepo\b|\bdeposit\b",
    "wd_withdraw": r"\bwd\b|\bwithdraw\b",
    "jp_jackpot": r"\bjp\b|\bjepe\b|\bjackpot\b",
    "freebet_freechip": r"\bfreebet\b|\bfreechip\b",
    "judi_judol": r"\bjudi\b|\bjudol\b|\btaruhan\b",
}
#: Subtypes by substring, in the order of their rank.
NEGATIVE_WARNING = "jangan|stop|bahaya|merusak|hancur|bego|tolol|haram|dosa|penipu|rungkad|rungkat|korban"
NEGATIVE_SUBTYPES = {
    "criticism": "lapor|polisi|pemerintah|kominfo|menteri|tangkap|berantas|koperasi|pasal|hukum|sadbor",
    "spam_complaint": "spam|bot|nyampah|blokir|penonton",
}
POSITIVE_SUBTYPES = {
    "obfuscated_promotion": r"[a-z]\s+[a-z]\s+[a-z]|[-_]{2,}",
    "call_to_action": r"daftar|link|klik|gabung|join|hubungi|ketik di google|depo disini|wa\.me",
    "explicit_ad": "bonus|freechip|gratis|event|garansi|cashback|diskon",
    "testimonial": "bukti|terima kasih|makasih|kebeli|cuan|hasil|narik|cair|wd|menang|jepe|jp",
    "promotional_claim": "gacor|maxwin|sensasional|mudah|gampang|terpercaya|terbaik|mantap|rekomendasi",
}
STYLED = "[\\x{1D400}-\\x{1D7FF}\\x{2460}-\\x{24FF}\\x{FF01}-\\x{FF5E}]"


def matches(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns found, in the patterns' order."""
    return F.filter(F.array(*[F.when(text.rlike("(?U)" + p), F.lit(k)) for k, p in patterns.items()]), lambda x: x.isNotNull())


def subtype(text: Column, lowered: Column, label: Column, status: Column, signals: Column) -> Column:
    some = F.size(signals) > 0
    negative = F.when(lowered.rlike(NEGATIVE_WARNING) & some, "anti_gambling")
    for name, pattern in NEGATIVE_SUBTYPES.items():
        negative = negative.when(lowered.rlike(pattern), name)
    negative = negative.when(some, "neutral_gambling_discussion").otherwise("non_gambling")
    positive = F.when(text.rlike(STYLED), "obfuscated_promotion")
    for name, pattern in POSITIVE_SUBTYPES.items():
        positive = positive.when(lowered.rlike("(?U)" + pattern), name)
    return F.when(label.isNull() | status.eqNullSafe("review"), "ambiguous").when(label == 0, negative).when(label == 1, positive.otherwise("site_endorsement")).otherwise("ambiguous")


def obfuscation_candidate(text: Column) -> Column:
    spaced = "(?U)\\b[A-Za-z0-9]\\s+[A-Za-z0-9]\\s+[A-Za-z0-9]\\b"
    marks = "\\[dot\\]|\\(dot\\)|\\*+[A-Za-z0-9]+\\*+|█|☯|✅|⭐"
    styled = "[\\x{1D400}-\\x{1D7FF}\\x{2460}-\\x{24FF}\\x{FF01}-\\x{FF5E}\\x{2100}-\\x{214F}]"
    return F.coalesce(text.rlike(styled) | text.rlike(spaced) | text.rlike(marks), F.lit(False))


def hash_number(*parts, mod: int) -> Column:
    """A number below ``mod`` from the first four hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, 4), 16, 10).cast("long") % mod

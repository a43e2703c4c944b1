"""Text expressions built from Spark's own functions; no Python runs per row.

Whitespace means what Unicode-aware ``str.split()`` / ``str.strip()`` mean by it, which is wider
than Java's ``\\s`` and much wider than the single space that ``trim`` removes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions.profiles import ScriptProfile

# All 29 code points with the Unicode whitespace behaviour described above.
WHITESPACE = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ],
    )
)
# As a Java character class. Single characters below 256 end up in one bit set, and the
# intersection lets any letter outside its range fail on one comparison; that halves the time of
# splitting against a flat list of ranges.
WS_CLASS = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0[\x{1680}-\x{3000}&&"
    r"[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
)

# The punctuation marks that the normaliser sets apart from words.
PUNCTUATION = ",।!?;:()[]{}\"“”‘’"
# Shaped like WS_CLASS, for the same reason.
PUNCT_CLASS = r'[,!?;:\(\)\[\]\{\}"।[\x{2018}-\x{201d}&&[“”‘’]]]'

# Letters that exist both precomposed and as letter + nukta; canonical composition excludes the
# precomposed forms, so NFC text holds the two-code-point form.
_NUKTA_PAIRS = (
    ("\u09dc", "\u09a1\u09bc"),
    ("\u09dd", "\u09a2\u09bc"),
    ("\u09df", "\u09af\u09bc"),
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    return F.btrim(_c(col), F.lit(WHITESPACE))


def unify_newlines(col: Column | str) -> Column:
    """``\\r\\n`` and ``\\r`` also end a line."""
    c = F.replace(_c(col), F.lit("\r\n"), F.lit("\n"))
    return F.replace(c, F.lit("\r"), F.lit("\n"))


def lines(col: Column | str) -> Column:
    """Stripped, non-empty lines."""
    stripped = F.transform(F.split(unify_newlines(col), "\n"), strip)
    return F.array_remove(stripped, "")


def document_text(col: Column | str) -> Column:
    """Stripped lines joined by one space; whitespace inside a line stays as it is."""
    return F.array_join(lines(col), " ")


def tokens(col: Column | str) -> Column:
    """Whitespace tokens; null gives an empty array."""
    parts = F.array_remove(F.split(_c(col), WS_CLASS + "+"), "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def primary_tokens(tokens_col: Column | str, profile: ScriptProfile) -> Column:
    return F.filter(_c(tokens_col), profile.is_primary)


def secondary_tokens(tokens_col: Column | str, profile: ScriptProfile) -> Column:
    return F.filter(_c(tokens_col), profile.is_secondary)


def is_script_token(token: Column | str, profile: ScriptProfile) -> Column:
    """Long enough and holding a primary-script character; punctuation stays attached."""
    t = _c(token)
    return (F.length(t) >= profile.min_token_length) & profile.is_primary(t)


def script_tokens(col: Column | str, profile: ScriptProfile) -> Column:
    return F.filter(tokens(col), lambda t: is_script_token(t, profile))


def content_hash(col: Column | str) -> Column:
    return F.sha2(_c(col), 256)


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def leading_shingle(tokens_col: Column | str, k: int) -> Column:
    return F.array_join(F.slice(_c(tokens_col), 1, k), " ")


def normalize_text(col: Column | str) -> Column:
    """Whitespace runs become one space, listed punctuation gets a space on both sides."""
    collapsed = F.regexp_replace(_c(col), WS_CLASS + "+", " ")
    spaced = F.regexp_replace(collapsed, PUNCT_CLASS, " $0 ")
    return F.coalesce(strip(spaced), F.lit(""))


def normalized_tokens(col: Column | str) -> Column:
    """``tokens(normalize_text(..))`` without the collapse, which splitting makes superfluous."""
    return tokens(F.regexp_replace(_c(col), PUNCT_CLASS, " $0 "))


def match_count(col: Column | str, pattern: str) -> Column:
    """Non-overlapping matches from the left; null counts as zero."""
    return F.coalesce(F.regexp_count(_c(col), F.lit(pattern)), F.lit(0))


def literal_count(col: Column | str, word: Column | str) -> Column:
    """Non-overlapping occurrences of a literal. ``contains`` keeps the replace off most rows."""
    c = _c(col)
    w = F.lit(word) if isinstance(word, str) else word
    hits = (F.length(c) - F.length(F.replace(c, w, F.lit("")))) / F.length(w)
    return F.when(F.contains(c, w), hits.cast("int")).otherwise(F.lit(0))


def contains_any(col: Column | str, words: Sequence[str]) -> Column:
    c = _c(col)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def decompose_nukta(col: Column | str) -> Column:
    c = _c(col)
    for whole, parts in _NUKTA_PAIRS:
        c = F.replace(c, F.lit(whole), F.lit(parts))
    return c


def decompose_nukta_str(s: str) -> str:
    for whole, parts in _NUKTA_PAIRS:
        s = s.replace(whole, parts)
    return s


def keyed_uniform(key: Column | str, salt: str) -> Column:
    """A number in [0, 1) that depends on nothing but the key and the salt."""
    digest = F.md5(F.concat(F.lit(salt), _c(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))

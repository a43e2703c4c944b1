"""Which script a corpus is written in, as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

# Token made of two or more ASCII letters and nothing else.
LATIN_WORD = "^[a-zA-Z]{2,}$"


def _starts_between(token: Column, low: str, high: str) -> Column:
    """Strings compare by their bytes, and UTF-8 keeps the order of code points."""
    return (token >= low) & (token < chr(ord(high) + 1))


@dataclass(frozen=True)
class ScriptProfile:
    """``primary`` is the inside of a character class (Java regex); a token belongs to the
    primary script when it holds at least one such character. ``secondary`` is a regex that a
    whole token must match to count towards the code-mixing rate.

    The two ranges only save time. ``primary_start`` lies inside the class, so a token that starts
    in it needs no regex; every match of ``secondary`` starts in ``secondary_start``, so a token
    that does not needs none either. A comparison is far cheaper than a regex on a token."""

    name: str
    primary: str
    secondary: str = LATIN_WORD
    min_token_length: int = 2
    primary_start: tuple[str, str] | None = None
    secondary_start: tuple[str, str] | None = ("A", "z")

    @property
    def primary_class(self) -> str:
        return f"[{self.primary}]"

    def is_primary(self, token: Column) -> Column:
        found = token.rlike(self.primary_class)
        return _starts_between(token, *self.primary_start) | found if self.primary_start else found

    def is_secondary(self, token: Column) -> Column:
        found = token.rlike(self.secondary)
        if not self.secondary_start:
            return found
        return _starts_between(token, *self.secondary_start) & found


BENGALI = ScriptProfile("bengali", r"\x{0980}-\x{09FF}", primary_start=("ঀ", "৿"))
LATIN = ScriptProfile("latin", "A-Za-zÀ-ÿ", primary_start=("a", "z"))

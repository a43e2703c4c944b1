"""Parameters of the registered queries: word lists and rules for the languages of the test tables."""

from __future__ import annotations

from corpuscope.functions.profiles import LATIN, ScriptProfile
from corpuscope.operators.domain import DomainModel, Rule
from corpuscope.operators.gender import GenderLexicon

# Counts accented tokens apart from all tokens.
ACCENTED = ScriptProfile("accented", "À-ÿ")
PROFILE = LATIN

SEEDS = {
    "en": ("the", "of", "and", "that"),
    "fr": ("le", "et", "des", "que"),
    "de": ("der", "und", "die", "von"),
    "es": ("el", "los", "que", "de"),
}
SHORT_TEXT = 30
MANY_THE = 5
HIGH_MIX = 0.8
HEX_RUN = "[0-9a-f]{8}"
SHOUT = "[!?]{2,}"
THE = "(?:the|The)"
UMLAUTS = ("ä", "ö", "ü", "ß")
MODEL = DomainModel(
    ("en", "fr", "de", "es"),
    SEEDS,
    (
        Rule("en", 3, "matches", pattern=HEX_RUN),
        Rule("en", 4, "count_at_least", pattern=THE, threshold=MANY_THE, guard=("the", "The")),
        Rule("fr", 2, "matches", pattern=SHOUT, guard=("!", "?")),
        Rule("de", 5, "any_of", phrases=UMLAUTS),
        Rule("en", 2, "mix_rate_above", threshold=HIGH_MIX),
        Rule("es", 1, "tokens_below", threshold=SHORT_TEXT),
    ),
)

_VOWELS, _CONSONANTS = "aeiou", "bcdfghlmnprst"
# Enough seeds for the automaton; doubled letters overlap with themselves, and some seeds are in
# two lists.
WIDE_SEEDS = {
    "open": tuple(c + v for c in _CONSONANTS for v in _VOWELS),
    "closed": tuple(v + c for v in _VOWELS for c in _CONSONANTS) + ("the", "th", "he"),
    "doubled": tuple(c * 2 for c in "abcdefghijklmnopqrstuvwxyz") + ("he", "en", "er"),
}
WIDE_MODEL = DomainModel(tuple(WIDE_SEEDS), WIDE_SEEDS)

STOPWORDS = ("the", "of", "and", "le", "la", "der", "die", "el", "de", "que")

PHRASES = ("the", "of the", "in the", "with", "that", "and the of")
OPENINGS = (2, 3, 4)
WORD_LEXICON = GenderLexicon.of(
    ("with", "that", "für", "never-seen-word"),
    ("the", "der", "with"),
    ("la", "die", "that"),
    male_prefixes=("and",),
    female_prefixes=("of",),
)
PHRASE_LEXICON = GenderLexicon.of(
    ("with", "that", "in the", "for"),
    ("the", "of", "of the", "and the of"),
    ("and", "the and", "to be", "by", "by the"),
    male_prefixes=("and",),
    female_prefixes=("of",),
)

# "la" before "las": in an alternation the earlier spelling wins.
PLACES = {"g1": ("the", "this"), "g2": ("der", "die"), "g3": ("la", "las")}

SHINGLE = 8
SAMPLE_FRACTION = 0.1
ODD_FRACTION = 0.37
SAMPLE_SALT = "42:"
COUNTED_PATTERN = "th|the|an"
COUNTED_WORDS = ("the", "anan", "ee")

# Words after "the", and bare "and"; only the former are in the group.
GROUP_PATTERN = r"the ([a-z]+)|and"

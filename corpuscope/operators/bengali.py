"""The shipped Bengali rule set. Seeds are not part of it: they are read from lexicon files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from corpuscope.functions.text import WS_CLASS
from corpuscope.operators.domain import DomainModel, Rule

# Fixed values from here to the end of RULES: results depend on every one of them. Letters with a
# nukta are written as letter + U+09BC throughout.
DOMAINS = ("news", "encyclopedia", "education", "blogs", "social", "literature")

NEWS_BYLINE = ("নিজস্ব প্রতিবেদক", "স্টাফ রিপোর্টার", "বিশেষ প্রতিনিধি")
NEWS_METADATA = ("প্রকাশিত", "সর্বশেষ আপডেট", "সংবাদ সম্মেলন", "প্রেস বিজ্ঞপ্তি")
MONTHS = (
    "জানুয়ারি",
    "ফেব্রুয়ারি",
    "মার্চ",
    "এপ্রিল",
    "মে",
    "জুন",
    "জুলাই",
    "আগস্ট",
    "সেপ্টেম্বর",
    "অক্টোবর",
    "নভেম্বর",
    "ডিসেম্বর",
)
ENCYCLOPEDIA_SECTIONS = ("তথ্যসূত্র", "বহিঃসংযোগ", "বিষয়শ্রেণী", "আরও দেখুন")
BIOGRAPHY_WORDS = ("জাতীয়তা", "পেশা", "জন্ম", "মৃত্যু")
EDUCATION_WORDS = (
    "সেমিস্টার",
    "জিপিএ",
    "সিজিপিএ",
    "গবেষণা",
    "থিসিস",
    "অ্যাসাইনমেন্ট",
    "মিডটার্ম",
    "ফাইনাল",
)

# Digits of any script, then whitespace, then a month.
DATE = r"\p{Nd}{1,2}" + WS_CLASS + "+(?:" + "|".join(MONTHS) + ")"

# First person under the rule that vowel signs are not word characters: the two forms ending in a
# letter match as whole words, the two ending in a vowel sign only in front of another letter.
FIRST_PERSON_COMPAT = (
    r"(?<![\p{L}\p{N}_])(?:(?:আমার|আমাদের)(?![\p{L}\p{N}_])|(?:আমি|আমাকে)(?=[\p{L}\p{N}_]))"
)
# First person as a reader would count it: vowel signs belong to the word.
FIRST_PERSON_WORD = r"(?<![\p{L}\p{M}\p{N}_])(?:আমি|আমার|আমাকে|আমাদের)(?![\p{L}\p{M}\p{N}_])"

EMOJI = r"[\x{1F300}-\x{1FAFF}]"
HANDLE = "[@#][A-Za-z0-9_]+"
SHOUTING = "[!?]{3,}"
# A quote: an opening mark, one or more characters of the same line, the nearest closing mark. Only
# a match with group 1 is a quote. The other branch swallows the rest of a line in which nothing
# closes any more; a lazy dot would search that rest again from every further opening mark.
QUOTED = '[“"](?:[^\\n][^”"\\n]*+([”"])|[^\\n]*+)'


def bengali_rules(first_person: str = "compat") -> tuple[Rule, ...]:
    patterns = {"compat": FIRST_PERSON_COMPAT, "word": FIRST_PERSON_WORD}
    return (
        Rule("news", 4, "any_of", phrases=NEWS_BYLINE),
        Rule("news", 6, "any_of", phrases=NEWS_METADATA),
        Rule("news", 2, "matches", pattern=DATE),
        Rule("encyclopedia", 6, "any_of", phrases=ENCYCLOPEDIA_SECTIONS),
        Rule("encyclopedia", 3, "any_of", phrases=BIOGRAPHY_WORDS),
        Rule("education", 4, "any_of", phrases=EDUCATION_WORDS),
        Rule(
            "blogs",
            4,
            "count_at_least",
            pattern=patterns[first_person],
            threshold=5,
        ),
        Rule("social", 3, "matches", pattern=EMOJI),
        Rule("social", 4, "matches", pattern=HANDLE, guard=("@", "#")),
        Rule("social", 2, "matches", pattern=SHOUTING, guard=("!", "?")),
        Rule("social", 2, "mix_rate_above", threshold=0.15),
        Rule("social", 1, "tokens_below", threshold=30),
        Rule(
            "literature",
            4,
            "count_at_least",
            pattern=QUOTED,
            group=1,
            threshold=5,
            guard=("“", '"'),
        ),
    )


def bengali_model(
    seeds: Mapping[str, Sequence[str]], first_person: str = "compat"
) -> DomainModel:
    return DomainModel(DOMAINS, dict(seeds), bengali_rules(first_person))


# The eight divisions with their spellings, in matching order.
PLACES: dict[str, tuple[str, ...]] = {
    "Dhaka": ("ঢাকা", "ঢাকাইয়া", "ডাকা", "জাহাঙ্গীরনগর"),
    "Chittagong": (
        "চট্টগ্রাম",
        "চিটাগং",
        "চাটগাইয়া",
        "চাটগাঁইয়া",
        "চাটগাঁ",
        "চাটগা",
        "চিটাগাং",
        "চাটগাও",
    ),
    "Sylhet": ("সিলেট", "ছিলট", "সিলট", "সিলেটি", "শ্রীহট্ট", "জালালাবাদ"),
    "Rajshahi": ("রাজশাহী", "রাজশাহি", "রামপুর বোয়ালিয়া"),
    "Khulna": ("খুলনা", "খুলনাইয়া", "জাহানাবাদ"),
    "Barisal": ("বরিশাল", "বইশাল", "বইরশাল", "বরিশাইল্যা", "চন্দ্রদ্বীপ", "বাকেরগঞ্জ"),
    "Rangpur": ("রংপুর", "রাংপুর", "রংপুরী", "রংপুরিয়া"),
    "Mymensingh": ("ময়মনসিংহ", "ময়মনসিং", "মৈমনসিং", "মোমেনশাহী", "নাসিরাবাদ"),
}

# Words that give the occupation they stand before a gender.
FEMALE_PREFIXES = ("নারী", "মহিলা")
MALE_PREFIXES = ("পুরুষ",)

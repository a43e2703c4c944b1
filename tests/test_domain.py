import random
import re

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import scan
from corpuscope.functions.profiles import BENGALI
from corpuscope.operators import bengali as B
from corpuscope.operators import domain as D

RULES = {i: r for i, r in enumerate(B.bengali_rules())}


def fired(frame, rule, *texts):
    df = frame(*texts).select(
        "id", rule.fires(F.col("text"), F.lit(100), F.lit(0.0)).alias("hit")
    )
    return [bool(r.hit) for r in df.orderBy("id").collect()]


def by_pattern(pattern):
    return next(r for r in RULES.values() if r.pattern == pattern)


def matches(frame, pattern, *texts):
    df = frame(*texts).select("id", F.regexp_count("text", F.lit(pattern)).alias("n"))
    return [r.n for r in df.orderBy("id").collect()]


def label(frame, model, *texts, **kw):
    df = D.infer_domain(frame(*texts), model, BENGALI, **kw).orderBy("id")
    return [(r.predicted_domain, r.confidence) for r in df.collect()]


def test_nukta_letters_are_decomposed_in_patterns():
    everything = "".join([B.DATE, *B.ENCYCLOPEDIA_SECTIONS, *B.BIOGRAPHY_WORDS])
    everything += "".join(s for spellings in B.PLACES.values() for s in spellings)
    assert "়" in everything
    assert not set("ড়ঢ়য়") & set(everything)
    assert len(B.PLACES) == 8 and sum(map(len, B.PLACES.values())) == 39


def test_seeds_count_as_substrings(frame):
    model = D.DomainModel(("a",), {"a": ("haha", "বই")})
    assert D.with_lexicon_scores(frame("hahaha বই বইমেলা"), model).first().lex_a == 3


def test_scores_equal_plain_counts(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abক") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    model = D.DomainModel(
        ("x", "y"),
        {"x": words[:18], "y": words[10:]},
        (D.Rule("x", 5, "any_of", phrases=("abab", "ককক")), D.Rule("y", 1, "tokens_below", threshold=4)),
    )
    texts = ["".join(rng.choice("ab ক") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate([*texts, None, ""])), "id int, text string")
    flags = {"seen": ("aab", "bক")}
    out = D.infer_domain(df, model, BENGALI, keep_scores=True, flags=flags)
    got = [tuple(r) for r in out.orderBy("id").collect()]
    for row, t in zip(got, [*texts, "", ""]):
        assert row[3] == sum(t.count(w) for w in model.seeds["x"]) + 5 * ("abab" in t or "ককক" in t)
        assert row[2] == ("aab" in t or "bক" in t)
    assert [r[-2] for r in got[200:]] == ["unknown"] * 2


def test_lists_of_any_length_have_one_plan(frame):
    long = tuple(f"seed{i}x" for i in range(150_000))
    df = frame("seed149999x seed1x", None)
    got = D.with_lexicon_scores(df, D.DomainModel(("a",), {"a": long})).orderBy("id").collect()
    assert [r.lex_a for r in got] == [2, 0]
    plans = []
    for seeds in (long, long[:1]):
        scored = D.with_lexicon_scores(df, D.DomainModel(("a",), {"a": seeds}))
        plans.append(re.sub(r"#\d+L?|\d+", "", scored._jdf.queryExecution().executedPlan().toString()))
    assert plans[0] == plans[1]


def test_scan_without_words(frame):
    assert frame("x", None).select(scan.literal_scan(F.col("text"), [[]], [[]]).alias("s")).first().s == [0, 0]


def test_ties_go_to_the_earlier_domain(frame):
    model = D.DomainModel(("b", "a"), {"a": ("x",), "b": ("y",)})
    assert label(frame, model, "x y") == [("b", 0.5)]


def test_rejection(frame):
    model = D.DomainModel(("a", "b", "c"), {"a": ("x",), "b": ("y",), "c": ("z",)})
    got = label(frame, model, "xxxyyyzzz", "xxy", "none", "")
    assert got == [
        ("unknown", pytest.approx(1 / 3)), ("a", pytest.approx(2 / 3)), ("unknown", None), ("unknown", None),
    ]


def test_short_text_is_social(frame):
    assert label(frame, B.bengali_model({}), "কখগ", "") == [("social", 1.0), ("unknown", None)]


def test_date_rule(frame):
    texts = ("১২ জুন", "12 জুন", "জুন ১২", "১২ জুন")
    assert fired(frame, by_pattern(B.DATE), *texts) == [True, True, False, True]


def test_first_person(frame):
    texts = ("x আমি y", "x আমিও y", "আমার।", "x আমাকে y", "আমাদের কথা")
    assert matches(frame, B.FIRST_PERSON_COMPAT, *texts) == [0, 1, 1, 0, 1]
    assert matches(frame, B.FIRST_PERSON_WORD, *texts) == [1, 0, 1, 1, 1]


def test_quotes(frame):
    rule = by_pattern(B.QUOTED)
    rng = random.Random(4)
    texts = ["“ক\u2028খ”", "“ক\nখ”", '"a" "b"', '""', '"a" ' * 5, '"a" ' * 4]
    texts += ["".join(rng.choice('“”"ab\n') for _ in range(rng.randint(0, 25))) for _ in range(400)]
    df = frame(*texts).select("id", rule.count(F.col("text")).alias("n")).orderBy("id")
    # the plain way to say it
    want = [len(re.findall('[“"].+?[”"]', t)) for t in texts]
    assert [r.n for r in df.collect()] == want and want[:4] == [1, 0, 2, 0]
    assert fired(frame, rule, *texts[4:6]) == [True, False]


def test_many_open_quotes_take_linear_time(frame):
    text = " ".join(["“কথা"] * 200_000)
    assert fired(frame, by_pattern(B.QUOTED), text, text + "”") == [False, False]


def test_social_rules(frame):
    assert fired(frame, by_pattern(B.EMOJI), "😂", "☺", "x") == [True, False, False]
    assert fired(frame, by_pattern(B.HANDLE), "@ab", "@ ab", "#1") == [True, False, True]
    assert fired(frame, by_pattern(B.SHOUTING), "!?!", "!!") == [True, False]


def test_points_per_rule(frame):
    long = " ".join(["কথা"] * 40)
    cases = {
        "স্টাফ রিপোর্টার": ("news", 4), "প্রেস বিজ্ঞপ্তি": ("news", 6), "৫ মার্চ": ("news", 2),
        "আরও দেখুন": ("encyclopedia", 6), "মৃত্যু": ("encyclopedia", 3), "থিসিস": ("education", 4),
    }
    for text, (name, points) in cases.items():
        df = D.infer_domain(frame(f"{text} {long}"), B.bengali_model({}), BENGALI, keep_scores=True)
        row = df.first().asDict()
        assert row["predicted_domain"] == name and row[f"score_{name}"] == points


def test_mix_rate_rule_is_strict(frame):
    model = D.DomainModel(("s",), {}, (D.Rule("s", 2, "mix_rate_above", threshold=0.15),))
    at, above = "ab cd ef " + "ক " * 17, "ab cd ef gh " + "ক " * 16
    assert label(frame, model, at, above) == [("unknown", None), ("s", 1.0)]


def test_rounded_rates_are_not_trusted(frame):
    model = D.DomainModel(("s",), {}, (D.Rule("s", 2, "mix_rate_above", threshold=0.15),))
    df = frame("x").withColumns(
        {"token_count": F.lit(20001), "latin_token_count": F.lit(3001), "mix_rate": F.lit(0.15)}
    )
    assert D.infer_domain(df, model, BENGALI).first().predicted_domain == "s"


def test_distribution(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "predicted_domain string")
    got = [tuple(r) for r in D.domain_distribution(df).collect()]
    assert got == [("b", 2), ("a", 1), ("c", 1)]


def test_model_is_checked(frame):
    with pytest.raises(ValueError):
        D.DomainModel(("a",), {"b": ("x",)})
    with pytest.raises(ValueError):
        D.DomainModel(("a",), {"a": ("",)})
    with pytest.raises(ValueError):
        D.Rule("a", 1, "nonsense").fires(F.lit("x"), F.lit(1), F.lit(0.0))

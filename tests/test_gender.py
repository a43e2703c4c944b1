import math
import random

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import gender as G

PUNCT = ",।!?;:()[]{}\"“”‘’"


def spec_tokens(text):
    return "".join(f" {c} " if c in PUNCT else c for c in text).split()


def spec_scan(tokens, entries, lo, hi):
    """Position by position: take the longest entry that fits in front of ``hi``."""
    spans, i = [], lo
    while i < hi:
        fits = [len(e) for e in entries if i + len(e) <= hi and tokens[i : i + len(e)] == e]
        if fits:
            spans.append((i, i + max(fits)))
        i += max(fits, default=1)
    return spans


def spec_document(text, lex, window):
    tokens = spec_tokens(text)
    markers = {
        "m": [p.split() for p in lex.male],
        "f": [p.split() for p in lex.female],
    }
    out = {}
    for occ in lex.occupations:
        if occ not in text:
            continue
        words = occ.split()
        points = {"m": 0, "f": 0}
        for a in range(len(tokens) - len(words) + 1):
            b = a + len(words)
            if tokens[a:b] != words:
                continue
            lo, hi = max(0, a - window), min(len(tokens), b + window)
            for side, entries in markers.items():
                for s, e in spec_scan(tokens, entries, lo, hi):
                    points[side] += (s, e) == (a, b) or not (s < b and e > a)
            for word in [words[0]] + ([tokens[a - 1]] if a else []):
                if word in lex.female_prefixes:
                    points["f"] += 1
                    break
                if word in lex.male_prefixes:
                    points["m"] += 1
                    break
        if points["m"] or points["f"]:
            out[occ] = (points["m"], points["f"])
    return out


def run(spark, texts, lex, window=10):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, d string")
    got = G.gender_scores(G.with_gender_evidence(df, lex, window), "d", key_cols=["id"]).collect()
    return {(r["id"], r.occupation): (r.male, r.female, r.score) for r in got}


def one(spark, text, lex, window=10):
    return {k[1]: v[:2] for k, v in run(spark, [text], lex, window).items()}


def test_random_documents_equal_plain_restatement(spark):
    rng = random.Random(7)
    words = list("abcdefgh") + [","]

    def entry(most):
        return " ".join(rng.choice(words[:8]) for _ in range(rng.randint(1, most)))

    for _ in range(4):
        lex = G.GenderLexicon.of(
            [entry(3) for _ in range(6)],
            [entry(4) for _ in range(8)],
            [entry(4) for _ in range(8)],
            male_prefixes=["c"],
            female_prefixes=["d", "e"],
        )
        texts = [
            "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n"]) for _ in range(rng.randint(0, 60)))
            for _ in range(60)
        ]
        want = {
            (i, occ): mf for i, t in enumerate(texts) for occ, mf in spec_document(t, lex, 5).items()
        }
        got = run(spark, texts, lex, 5)
        assert {k: v[:2] for k, v in got.items()} == want
        for m, f, score in got.values():
            assert score == pytest.approx(math.log((m + 0.5) / (f + 0.5)), abs=1e-12)


def test_longest_marker_is_taken_and_jumped_over(spark):
    lex = G.GenderLexicon.of(["o"], ["a", "a b", "b c"], ["z"])
    assert one(spark, "o a b c", lex) == {"o": (1, 0)}


def test_marker_must_lie_inside_the_window(spark):
    lex = G.GenderLexicon.of(["o"], ["m"], ["f f2"])
    gap = " ".join(["x"] * 9)
    assert one(spark, f"m {gap} o", lex) == {"o": (1, 0)}
    assert one(spark, f"m {gap} x o", lex) == {}
    assert one(spark, f"o {gap} m", lex) == {"o": (1, 0)}
    # the last word of the phrase falls outside
    assert one(spark, f"o {gap} f f2", lex) == {}


def test_overlap_rules(spark):
    assert one(spark, "x o y", G.GenderLexicon.of(["o"], ["q"], ["o"])) == {"o": (0, 1)}
    assert one(spark, "x o y", G.GenderLexicon.of(["o"], ["q"], ["x o"])) == {}


def test_prefixes(spark):
    lex = G.GenderLexicon.of(["ডাক্তার", "নারী ডাক্তার"], ["q"], ["z"], ["পুরুষ"], ["নারী", "মহিলা"])
    assert one(spark, "একজন পুরুষ ডাক্তার।", lex) == {"ডাক্তার": (1, 0)}
    assert one(spark, "মহিলা ডাক্তার", lex) == {"ডাক্তার": (0, 1)}
    assert one(spark, "নারী ডাক্তার", lex) == {"ডাক্তার": (0, 1), "নারী ডাক্তার": (0, 1)}
    assert one(spark, "ডাক্তার", lex) == {}


def test_several_word_occupation_needs_the_verbatim_text(spark):
    lex = G.GenderLexicon.of(["a b"], ["m"], ["f"])
    assert one(spark, "a b m", lex) == {"a b": (1, 0)}
    assert one(spark, "a\nb m", lex) == {}
    assert one(spark, "a\nb m a b", lex) == {"a b": (2, 0)}


def test_bias_rows(spark):
    lex = G.GenderLexicon.of(["o", "p", "never"], ["m"], ["f"])
    rows = [("x", "o m"), ("y", "o f"), ("x", "p m"), (None, "p m"), ("y", "p q")]
    df = spark.createDataFrame(rows, "d string, text string")
    scores = G.gender_scores(G.with_gender_evidence(df, lex), "d")
    got = {(r.occupation, r.domain): r for r in G.gender_bias(scores, lex.occupations, "d").collect()}
    assert set(got) == {
        ("o", "x"), ("o", "y"), ("o", "ALL"), ("p", "x"), ("p", None), ("p", "ALL"), ("never", "ALL"),
    }
    ln3 = round(math.log(3), 4)
    assert got["o", "x"][2:] == (ln3, 1, "male-leaning")
    assert got["o", "y"][2:] == (-ln3, 1, "female-leaning")
    assert got["o", "ALL"][2:] == (0.0, 2, "female-leaning")
    assert got["p", "ALL"][2:] == (ln3, 2, "male-leaning")
    assert got["never", "ALL"][2:] == (None, 0, "insufficient data")


def test_share_and_extremes(spark):
    rows = [(f"o{i}", "ALL", float(v), 3, G.MALE_LEANING if v > 0 else G.FEMALE_LEANING) for i, v in enumerate([3, 2, 1, 0, -1, -2])]
    rows += [("none", "ALL", None, 0, G.INSUFFICIENT), ("o0", "x", 9.0, 1, G.MALE_LEANING)]
    bias = spark.createDataFrame(rows, "occupation string, domain string, avg_bias_score double, doc_count bigint, direction string")
    share = G.gender_share(bias).collect()[0]
    assert (share.evaluated, share.male_leaning, share.male_leaning_share) == (6, 3, 0.5)
    got = G.gender_extremes(bias, 2).orderBy("side", "rank").collect()
    assert [(r.side, r["rank"], r.occupation) for r in got] == [
        ("female", 1, "o5"), ("female", 2, "o4"), ("male", 1, "o0"), ("male", 2, "o1"),
    ]


def test_nothing_but_the_final_aggregate_is_shuffled(spark):
    lex = G.GenderLexicon.of(["o"], ["m"], ["f"])
    df = spark.createDataFrame([("x", "o m")], "d string, text string")
    scores = G.gender_scores(G.with_gender_evidence(df, lex), "d")
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert scores.select(F.count("*")).first()[0] == 1

import hashlib
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import text as T
from corpuscope.functions.profiles import BENGALI, LATIN
from corpuscope.functions.rows import bind
from corpuscope.operators import docstats
from corpuscope.operators.sampling import keyed_sample

ODD = [
    "x\x1cy\x85z　w",
    "  lead and trail \n",
    "",
    "   \t ",
    "ক খ গ",
    "😂ক",
    None,
]


def values(df, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()]


def test_character_classes(spark):
    every = [chr(c) for c in range(0x10000) if chr(c).isspace()]
    assert set(T.WHITESPACE) == set(every)
    # every code point of the basic plane, in a frame: the class matches the same ones
    points = [(c,) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(chr(c),) for (c,) in points], "ch string")
    hit = {r.ch for r in df.filter(F.col("ch").rlike(T.WS_CLASS)).collect()}
    assert hit == set(every)
    hit = {r.ch for r in df.filter(F.col("ch").rlike(T.PUNCT_CLASS)).collect()}
    assert hit == set(T.PUNCTUATION)


def test_tokens_and_strip_follow_python(frame):
    df = frame(*ODD)
    assert values(df, T.tokens("text")) == [(t or "").split() for t in ODD]
    assert values(df, T.strip("text"))[:-1] == [t.strip() for t in ODD[:-1]]


def test_length_counts_code_points(frame):
    assert values(frame("😂ক"), F.length("text")) == [2]


def test_lines_and_document_text(frame):
    df = frame(" a  b \r\n \r c\r\rd\n")
    assert values(df, T.lines("text")) == [["a  b", "c", "d"]]
    assert values(df, T.document_text("text")) == ["a  b c d"]


def test_script_tokens_keep_punctuation(frame):
    df = frame("না। ক এই, abc", None, "")
    assert values(df, T.script_tokens("text", BENGALI)) == [["না।", "এই,"], [], []]


def test_doc_stats(frame):
    df = docstats.with_doc_stats(frame("", "ab 12 ক", "one\n\ntwo"), BENGALI).orderBy("id")
    rows = df.collect()
    assert [r.token_count for r in rows] == [0, 3, 2]
    assert [r.primary_token_count for r in rows] == [0, 1, 0]
    assert [r.latin_token_count for r in rows] == [0, 1, 2]
    assert [r.mix_rate for r in rows] == [0.0, pytest.approx(1 / 3), 1.0]
    assert [r.sentence_count for r in rows] == [0, 1, 2]
    assert rows[1].sha256 == hashlib.sha256("ab 12 ক".encode()).hexdigest()


def test_normalize_text(frame):
    text = "  কথা,বলা।\n(শেষ) “উদ্ধৃতি”  "
    df = frame(text, None)
    spaced = re.sub("([,।!?;:()\\[\\]{}\"“”‘’])", r" \1 ", re.sub(r"\s+", " ", text)).strip()
    assert values(df, T.normalize_text("text")) == [spaced, ""]
    assert values(df, T.normalized_tokens("text")) == [spaced.split(), []]


def test_counts(frame):
    df = frame("hahaha বই বইমেলা", "", None)
    assert values(df, T.literal_count("text", "haha"))[:2] == [1, 0]
    assert values(df, T.literal_count("text", "বই"))[:2] == [2, 0]
    assert values(df, T.match_count("text", "ha|বই")) == [5, 0, 0]


def test_leading_shingle(frame):
    df = frame("aa bb cc dd")
    assert values(df, T.leading_shingle(T.script_tokens("text", LATIN), 3)) == ["aa bb cc"]


def test_nukta_forms(frame):
    whole, parts = "হয় ড়ঢ়", "হয় ড়ঢ়"
    assert values(frame(whole, parts), T.decompose_nukta("text")) == [parts, parts]
    assert T.decompose_nukta_str(whole) == parts


def test_bind_is_a_fence_for_filters(frame):
    df = frame("a b", "c")
    bound = bind(df, n=F.size(T.tokens("text"))).filter("n > 1 and id >= 0")
    assert values(bound, "id", "text", "n") == [(0, "a b", 2)]
    plan = bound._jdf.queryExecution().optimizedPlan().toString()
    # the costly part occurs once
    assert plan.count("split(") == 1


def test_keyed_sample_ignores_layout(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    one = {r.k for r in keyed_sample(df.repartition(1), "k", 0.1).collect()}
    many = {r.k for r in keyed_sample(df.repartition(7), "k", 0.1).collect()}
    assert one == many and 130 < len(one) < 270
    assert one != {r.k for r in keyed_sample(df, "k", 0.1, "43:").collect()}
    assert keyed_sample(df, "k", 1.0).count() == 2000
    with pytest.raises(ValueError):
        keyed_sample(df, "k", 1.5)


def test_start_ranges_change_nothing(spark):
    points = [c for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    rows = [(p + chr(c) + q,) for c in points for p, q in (("", ""), ("", "b"), ("1", ""), ("", "1"))]
    df = spark.createDataFrame(rows, "t string")
    for profile in (BENGALI, LATIN):
        plain = replace(profile, primary_start=None, secondary_start=None)
        t = F.col("t")
        differ = df.filter(
            (profile.is_primary(t) != plain.is_primary(t))
            | (profile.is_secondary(t) != plain.is_secondary(t))
        )
        assert differ.count() == 0

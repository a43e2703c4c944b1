"""What the operators owe beyond the test tables: scripts, sizes and counts that these do not hold."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import language_id, lm_scoring, marks, near_duplicates

#: Words of languages in pairs that share a script.
WORDS = {
    "bn": "আমি তুমি ভালো বাংলা দেশ মানুষ জল বাড়ি সকাল রাত করে হয় থেকে এবং",
    "as": "মই তুমি ভাল অসমীয়া দেশ মানুহ পানী ঘৰ পুৱা ৰাতি কৰে হয় পৰা আৰু",
    "hi": "मैं तुम अच्छा हिन्दी देश लोग पानी घर सुबह रात करता है से और",
    "mr": "मी तू चांगले मराठी देश लोक पाणी घर सकाळ रात्र करतो आहे पासून आणि",
    "ar": "أنا أنت جيد العربية بلد الناس ماء بيت صباح ليل يفعل هو من على",
    "fa": "من تو خوب فارسی کشور مردم آب خانه صبح شب می‌کند است از و",
    "he": "אני אתה טוב עברית ארץ אנשים מים בית בוקר לילה עושה הוא מן של",
    "yi": "איך דו גוט ייִדיש לאַנד מענטשן וואַסער הויז מאָרגן נאַכט מאַכט איז פֿון און",
    "th": "ฉัน คุณ ดี ไทย ประเทศ คน น้ำ บ้าน เช้า คืน ทำ เป็น จาก และ",
    "ka": "მე შენ კარგი ქართული ქვეყანა ხალხი წყალი სახლი დილა ღამე აკეთებს არის საიდან და",
    "hy": "ես դու լավ հայերեն երկիր մարդիկ ջուր տուն առավոտ գիշեր անում է ից և",
    "vi": "tôi bạn tốt tiếng việt nước người nhà buổi sáng đêm làm là từ và",
    "zh": "我 你 好 中文 国家 人们 水 房子 早上 夜晚 做 是 从 和",
}


def test_languages_of_many_scripts(spark):
    rng = random.Random(4)
    rows = [(lang, " ".join(rng.choice(words.split()) for _ in range(12))) for lang, words in WORDS.items() for _ in range(24)]
    frame = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string")
    held = F.col("doc_id") % 4 == 2
    found = language_id.identify(frame, language_id.fit(frame, ~held)).where(held).collect()
    wrong = [(r.lang, r.lang_pred) for r in found if r.lang != r.lang_pred]
    assert len(wrong) <= 0.02 * len(found), wrong


@pytest.mark.parametrize("text", ["বাংলা", "हिन्दी", "עברית", "ไทย", "ქართული", "հայերեն", "ế", "中文", "한국어", "አማርኛ"])
def test_letters_of_every_script_are_kept(text):
    assert not np.array_equal(language_id.counts_of(text), language_id.counts_of("." * len(text)))
    assert np.array_equal(language_id.counts_of(text + "。"), language_id.counts_of(text + "."))


def nested(n_inner, n_outer, seed):
    """Two texts whose shingle sets hold so many, one inside the other."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**9)}" for _ in range(n_outer + 4)]
    return " ".join(words[: n_inner + 4]), " ".join(words)


NESTED = [(75, 100), (90, 120), (105, 140), (120, 160), (144, 192), (150, 200), (144, 192)]


def test_estimate_is_that_of_the_union(spark):
    pairs = [(i, *nested(*NESTED[i % len(NESTED)], i)) for i in range(700)]
    frame = spark.createDataFrame(pairs, "i bigint, x string, y string")
    rows = frame.select((F.col("i") * 2).alias("doc_id"), F.col("x").alias("text"))
    rows = rows.unionByName(frame.select((F.col("i") * 2 + 1).alias("doc_id"), F.col("y").alias("text")))
    made = rows.mapInArrow(near_duplicates._sketcher(near_duplicates.K, 5), "doc_id bigint, n bigint, key binary, values array<bigint>")
    made = made.select(F.shiftright("doc_id", 1).alias("i"), (F.col("doc_id") % 2).alias("outer"), "values")
    both = made.where("outer = 0").select("i", F.col("values").alias("x")).join(made.where("outer = 1").select("i", F.col("values").alias("y")), "i")
    got = np.array([r.e for r in both.select(near_duplicates.estimate(near_duplicates.K).alias("e")).collect()])
    assert len(got) == 700 and abs(got.mean() - 0.75) < 0.01
    assert got.min() >= near_duplicates.MIN_ESTIMATE


def test_nested_pairs_are_linked(spark):
    texts = [t for i in range(560) for t in nested(*NESTED[i % len(NESTED)], i)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = near_duplicates.near_duplicates(frame).collect()
    assert len(got) == len(texts)
    assert [r.doc_id for r in got if r.component_id != r.doc_id // 2 * 2] == []


def test_losses_are_those_of_real_counts(spark):
    """With more words than 32,000 and more than 2^18 pairs, in several chunks."""
    rng = random.Random(5)
    texts = [[f"w{int(60_000 * rng.random() ** 2)}" for _ in range(600)] for _ in range(1000)]
    target = set(range(0, 1000, 7))
    single, pairs = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for i, t in enumerate(texts):
        for k in (0, 1) if i in target else (0,):
            single[k].update(t)
            pairs[k].update(zip(["^", *t], t))
    size = len(single[0]) + 1
    assert size > 32_000 and len(pairs[0]) > 1 << 18

    def loss(k, text):
        total, out = sum(single[k].values()), 0.0
        for h, w in zip(["^", *text], text):
            seen = total / size if h == "^" else single[k][h]
            p = (single[k][w] + 0.5) / (total + 0.5 * size)
            out -= math.log((min(pairs[k][h, w], seen) + lm_scoring.PRIOR * p) / (seen + lm_scoring.PRIOR))
        return out / len(text)

    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    rows = lm_scoring.cross_entropy_difference(frame, frame.where(F.col("doc_id") % 7 == 0)).collect()
    assert len(rows) == 1000
    for r in rows[::20]:
        assert abs(r.background_loss - loss(0, texts[r.doc_id])) < 1e-9
        assert abs(r.target_loss - loss(1, texts[r.doc_id])) < 1e-9


def test_marks_and_target_texts_say_the_same(spark, monkeypatch):
    """Chunks and ranges far smaller than the table, texts longer than a chunk; marks and a frame of texts say
    the same, whether the marks come by a bitmap or by a shuffle."""
    rng = random.Random(4)
    rows = [(i if i % 11 else None, " ".join(f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(rng.choice([0, 1, 40, 900])))) for i in range(300)]
    frame = spark.createDataFrame([*rows, *rows[:20], (-7, "w1 w2"), (1 << 40, None)], "doc_id bigint, text string").repartition(3)
    good = spark.createDataFrame([(i,) for i in (*range(0, 300, 3), 5, 5, -7, 1 << 40, None)], "doc_id bigint")
    told = lm_scoring.cross_entropy_difference(frame, frame.join(good, "doc_id", "left_semi"))
    want = sorted(map(tuple, told.collect()), key=str)
    assert len(want) == 322
    monkeypatch.setattr(lm_scoring, "CHUNK", 1 << 12)
    monkeypatch.setattr(lm_scoring, "RANGE", 1 << 13)
    for most in (marks.MAX_BLOCKS, 0):
        monkeypatch.setattr(marks, "MAX_BLOCKS", most)
        found = marks.marked(frame, "doc_id", good, "mark")
        assert {r.doc_id for r in found.where("mark").collect()} == {i for i, _ in rows if i and i % 3 == 0} | {5, -7, 1 << 40}
        got = lm_scoring.cross_entropy_difference(found, "mark").drop("mark")
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_counts_are_packed():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 500_000, dtype=np.uint64))
    steps = np.diff(keys, prepend=np.uint64(0))
    coded = lm_scoring._coded(steps)
    assert len(coded) < 6.2 * len(keys) and len(lm_scoring._coded(np.ones(500_000, int))) < 1000
    assert np.array_equal(np.cumsum(lm_scoring._decoded(coded, len(keys))), keys)
    cuts = lm_scoring._cuts(keys, 7)
    assert cuts[0] == 0 and cuts[-1] == len(keys) and np.diff(cuts).min() > 70_000


def sharing(n_docs, n_passages, taken, length, rng):
    """Texts of some passages each, so that many meet in the same lists and few are linked."""
    passages = [" ".join(f"p{i}x{j}" for j in range(length)) for i in range(n_passages)]
    return [" ".join(passages[i] for i in sorted(rng.sample(range(n_passages), taken))) for _ in range(n_docs)]


def reachable(sets):
    """The smallest position reachable through pairs of sets with a similarity of 0.75 or more."""
    root = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize("length", [60, 260])
def test_last_round_pairs_are_few_and_whole(spark, monkeypatch, length):
    """Documents of shared passages, of more than 1,024 shingles or not: the last round's join puts out no
    pair twice and hardly one that is not linked, and no link is lost."""
    rng = random.Random(length)
    texts = sharing(80, 16, 8, length, rng)
    for t in texts[:10]:
        words = t.split()
        texts.append(" ".join([*words[: len(words) * 8 // 9], *(f"n{rng.random()}" for _ in range(len(words) // 12))]))
    cut = [t.split() for t in texts]
    want = reachable([{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in cut])
    made = []

    def kept(*args):
        made.append(meetings(*args))
        return made[-1]

    meetings = near_duplicates._meetings
    monkeypatch.setattr(near_duplicates, "_meetings", kept)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(frame).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert made[-1].count() == made[-1].distinct().count() <= len(texts)


def test_bitmaps_of_linked_sets_of_all_sizes(spark):
    """Sets with a similarity of 0.75 pass by their bitmaps at the levels of all lists they share, others with
    one of 0.4 do not."""
    rng, rows = np.random.default_rng(7), []
    for i, n in enumerate([40, 300, 700, 1100, 2500, 6000, 20000] * 12):
        near = i % 2 == 0
        own = n // 7 * (1 if near else 3)
        both = n // 7 * 7 - own
        x = rng.integers(-(1 << 63), 1 << 63, both + 2 * own, dtype=np.int64)
        c = int(math.log(n) / math.log(near_duplicates.SIZE_STEP))
        rows += [(2 * i, c, x[: both + own].tolist()), (2 * i + 1, c, np.concatenate([x[:both], x[both + own :]]).tolist())]
    sets = spark.createDataFrame([(i, v) for i, _, v in rows], "node bigint, values array<bigint>")
    members = spark.createDataFrame([(i, c + d, len(v)) for i, c, v in rows for d in (0, 1)], "node bigint, c bigint, n bigint")
    members = members.withColumn("level", near_duplicates._level(F.col("c")))
    full = members.join(near_duplicates._parity(sets, members), ["node", "level"])
    x = full.where("node % 2 = 0").withColumn("i", F.col("node") / 2)
    y = full.where("node % 2 = 1").select(((F.col("node") - 1) / 2).alias("i"), "c", *[F.col(k).alias(f"hub_{k}") for k in ("n", *near_duplicates._BITS)])
    passed = x.join(y, ["i", "c"]).select("i", "n", near_duplicates._few_differ(0.75).alias("few")).collect()
    assert len(passed) >= 168 and all(r.few for r in passed if r.i % 2 == 0)
    assert not [r for r in passed if r.few and r.i % 2 and r.n > 100]

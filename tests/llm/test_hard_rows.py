"""Every operator over hard rows and over no rows, with columns of its own names around."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from tests.llm.conftest import PROSE
from corpuscope.llm import byte_bpe, fingerprints, language_id, lm_scoring, near_duplicates, packing, pii, quality_rules, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def labels(docs):
    return docs.sparkSession.createDataFrame([(4, 1), (5, 0), (5, None), (None, 1)], "doc_id bigint, toxic int")


OPERATORS = {
    "quality": quality_rules.quality_rules,
    "pii": pii.find,
    "lm": lambda d: lm_scoring.cross_entropy_difference(d, d.where("doc_id = 5")),
    "lm_no_target": lambda d: lm_scoring.cross_entropy_difference(d, d.where("false")),
    "prints": fingerprints.fingerprints,
    "bpe": lambda d: byte_bpe.decode(byte_bpe.encode(d, RANKS), RANKS),
    "pack": lambda d: packing.pack(d, VOCABULARY),
    "near": near_duplicates.near_duplicates,
    "language": lambda d: language_id.identify(d, language_id.fit(d.withColumn("lang", F.lit("en")), F.lit(True))),
    "language_none": lambda d: language_id.identify(d, language_id.fit(d, F.lit(True))),
    "toxicity": lambda d: toxicity.toxicity(d, labels(d), F.lit(True)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(nothing, name):
    assert OPERATORS[name](nothing).count() == 0


def rows_of(df, *columns):
    out = {}
    for r in df.select("doc_id", *columns).collect():
        out.setdefault(r.doc_id, []).append(tuple(r)[1:])
    return out


def test_quality(hard):
    got = rows_of(OPERATORS["quality"](hard), "n_words", "word_chars", "n_repeat_words", "base_failed", "kept")
    assert got[1] == got[2] == got[3] == [(0, 0, 0, True, False)]
    chars = len("".join(PROSE.split())) * 3
    assert got[5] == [(54, chars, 54, True, False)] * 2 == got[None] * 2
    assert got[7] == [(1, 200_000, 0, True, False)]
    assert got[8] == [(120_000, 540_000, 120_000, True, False)]


def test_pii(hard):
    assert {len(b) for rows in rows_of(OPERATORS["pii"](hard), "base_spans", "spans").values() for r in rows for b in r} == {0}


def test_lm(hard):
    got = rows_of(OPERATORS["lm"](hard), "n_tokens", "score")
    assert got[1] == got[2] == got[3] == [(0, 0.0)]
    assert got[5][0] == got[5][1] and got[5][0][1] < got[8][0][1]
    assert got[7][0][0] == 1
    assert sum(map(len, rows_of(OPERATORS["lm_no_target"](hard), "score").values())) == 10


def test_prints(hard):
    got = rows_of(OPERATORS["prints"](hard), "n_chars", "near_edited", "near_next", "fingerprint")
    assert got[1][0][0] == got[2][0][0] == 0
    # Null ids come first; their next is 1, whose text is empty, as 2's is.
    assert got[1][0][1:3] == (1.0, 1.0) and got[None][0][2] == 0.0
    assert got[5][0][3] == got[5][1][3] == got[None][0][3]
    assert sorted(x[2] for x in got[5])[1] == 1.0
    assert got[8][0][0] == 660_000


def test_bpe(hard):
    got = rows_of(OPERATORS["bpe"](hard), "ids", "starts", "bytes", "text")
    assert got[1] == got[2] == [([], [], bytearray(), "")]
    assert got[3][0][3] == " \n\t\x0b \r\n"
    for i in (4, 5, 7, 8, 9):
        ids, starts, data, text = got[i][0]
        assert len(ids) == len(starts) and starts == sorted(starts) and starts[0] == 0
        assert bytes(data).decode() == text
    assert got[8][0][3] == "alpha beta " * 60_000


def test_pack(hard):
    got = rows_of(OPERATORS["pack"](hard), "start", "length", "doc_tokens", "ids_crc32")
    assert got[1] == got[2] == [(0, 1, 1, 0x2144DF1C)]
    assert len(got[5]) == 2 and sum(r[1] for r in got[8]) == got[8][0][2]


def test_near(hard):
    got = rows_of(OPERATORS["near"](hard), "n_shingles", "component_id", "kept")
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert got[4] == [(1, 4, True)] and got[7] == [(1, 7, True)] and got[8] == [(2, 8, True)]
    assert got[5] == [(18, 5, True)] * 2 and got[None] == [(18, 5, False)]


def test_language(hard):
    got = rows_of(OPERATORS["language"](hard), "lang_pred", "score")
    assert got[1] == got[2] == got[3] == [("und", 0.0)]
    assert got[4] == [("en", 1.0)] and got[9][0][0] == "en"
    assert {r for rows in rows_of(OPERATORS["language_none"](hard), "lang_pred", "score").values() for r in rows} == {("und", 0.0)}


def test_toxicity(hard):
    got = rows_of(OPERATORS["toxicity"](hard), "score", "predicted")
    assert got[1] == got[2] == got[3] == [(0.0, 0)]
    assert got[5][0] == got[5][1] == got[None][0]
    assert all(0 <= r[0] <= 1 and r[1] == (r[0] >= 0.5) for rows in got.values() for r in rows)


def test_toxicity_of_a_text_is_the_same_alone_and_in_any_batch(texts):
    """Bit for bit, among other texts, in another order, by itself."""
    made = toxicity.fit(["you vile idiot", "what a fine day"] * 20, [1, 0] * 20)
    some = [t or "" for t in list(texts.values())[:150]]
    together = toxicity.score_texts(made, pa.array(some))
    assert len(set(together.tolist())) > 100
    assert (toxicity.score_texts(made, pa.array(some[::-1]))[::-1] == together).all()
    assert [toxicity.score_texts(made, pa.array([t]))[0] for t in some] == together.tolist()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, tables, hard, nothing, name, stage):
    assert stage(spark, nothing, tables).count() == 0
    out = stage(spark, hard, tables)
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.dtypes == hard.dtypes
        assert all(r[c] is None for r in out.collect() for c in ("score", "kept", "spans", "n_words"))
    assert out.count() >= 0


def test_quality_stage_keeps_own_columns(spark, tables, hard):
    fine = hard.where("doc_id = 4").withColumns({"text": F.lit(" ".join(f"w{i}" for i in range(60))), "kept": F.lit("mine")})
    row = corpus_pipeline.quality(spark, fine, tables).first()
    assert row.kept == "mine" and row.n_words is None and row.text.startswith("w0 w1")


def test_duplicate_stage_keeps_one_row_of_each_group(spark, tables):
    """Repeated ids, null ids, and an id that stands for two different texts."""
    other = " ".join(f"w{i}" for i in range(80))
    rows = [(5, PROSE * 3), (5, PROSE * 3), (None, PROSE * 3), (5, other), (3, other), (None, "a b c d e f g")] + [(None, "x y z x y w")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("mine") for c in ("row", "id", "first", "none")})
    got = corpus_pipeline.duplicates(spark, docs.coalesce(1), tables)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id or -1, r.text) for r in got.collect())
    assert kept == sorted([(5, PROSE * 3), (3, other), (-1, "a b c d e f g"), (-1, "x y z x y w")])

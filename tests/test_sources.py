import json
import os
import re

import pytest
from pyspark.sql import functions as F

from corpuscope.functions.profiles import BENGALI, LATIN
from corpuscope.session import materialize, scratch_root
from corpuscope.sources import config, lexicons, shards, tables, writers


def put(folder, name, content):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(content.encode("utf-8"))
    return path


@pytest.mark.parametrize("eol", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("gap", ["", " ", " \t"])
def test_documents_survive_small_splits(spark, tmp_path, eol, gap):
    want = {f"নথি {i} প্রথম সারি দ্বিতীয় সারি {i}" for i in range(200)}
    text = f"{eol}{gap}{eol}".join(f"নথি {i} প্রথম সারি{eol}  দ্বিতীয় সারি {i}" for i in range(200))
    put(tmp_path, "a.txt", text + eol * 3)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        docs = shards.parse_documents(spark, f"{tmp_path}/*.txt", BENGALI, with_key=True)
        rows = docs.collect()
        assert len(rows) == 200 and {r.text for r in rows} == want
        assert {r.sentence_count for r in rows} == {2}
        number = {int(r.row_key.rpartition("#")[2]): r.text for r in rows}
        assert [number[i].split()[1] for i in range(200)] == [str(i) for i in range(200)]
        # No blank line of the plain kind is needed for the work to be split.
        assert docs.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_parsed_schema(spark, tmp_path):
    put(tmp_path, "a.txt", "ab 12 ক\n\n\n\nঢাকা")
    df = shards.parse_documents(spark, str(tmp_path), BENGALI, with_id=True)
    assert dict(df.dtypes) == {
        "doc_id": "string", "text": "string", "sentence_count": "int", "token_count": "int",
        "char_count": "int", "primary_token_count": "int", "latin_token_count": "int",
        "mix_rate": "double", "sha256": "string", "predicted_domain": "string", "id": "bigint",
    }
    rows = sorted(df.collect(), key=lambda r: r.text)
    assert [(r.text, r.token_count, r.mix_rate, r.predicted_domain) for r in rows] == [
        ("ab 12 ক", 3, 0.3333, "unknown"), ("ঢাকা", 1, 0.0, "unknown"),
    ]
    assert all(r.doc_id == r.sha256 for r in rows)
    files = shards.read_documents(spark, str(tmp_path), with_file=True).select("source_file").distinct()
    assert files.first()[0].endswith("a.txt")


@pytest.mark.parametrize("size", [7, 16, 40, 1 << 20])
def test_open_ends(spark, tmp_path, size):
    """Blank lines at both ends of files, documents longer than a split, a file without blank lines,
    an empty one, and one whose last line has no end."""
    files = {
        "a.txt": "\n\n one\ntwo \n\n\n" + "long line of a document\n" * 12 + "\nx\n\n",
        "b.txt": "only one document\n" * 9,
        "c.txt": "",
        "d.txt": "y\n\n \nz\nlast",
        "e.txt": "\n \n",
    }
    for name, content in files.items():
        put(tmp_path, name, content)
    want = {}
    for name, content in files.items():
        parts = re.split(r"\n\s*\n", content)
        docs = [[x.strip() for x in p.split("\n") if x.strip()] for p in parts]
        for i, lines in enumerate(d for d in docs if d):
            want[f"{name}#{i}"] = (" ".join(lines), len(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        rows = shards.read_documents(spark, str(tmp_path), with_key=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {r.row_key.rpartition("/")[2]: (r.text, r.sentence_count) for r in rows}
    assert got == want and len(rows) == len(want)


def test_script_checks(spark, tmp_path):
    unix = put(tmp_path, "unix.txt", "ক\n\nখ\n")
    dos = put(tmp_path, "dos.txt", "a\r\n\r\nb\r\n")
    assert shards.check_script(spark, unix, BENGALI) == 2
    assert shards.check_script(spark, dos, LATIN) == 2
    with pytest.raises(ValueError):
        shards.check_script(spark, dos, BENGALI)


def test_lexicons(spark, tmp_path):
    a = put(tmp_path, "a.txt", "  দুই শব্দ \n\nএক\r\nএক\n \nতিন টি শব্দ")
    b = put(tmp_path, "b.txt", "z\ny\n")
    got = lexicons.load_lexicons(spark, {"a": a, "b": b})
    assert got == {"a": ("দুই শব্দ", "এক", "তিন টি শব্দ"), "b": ("z", "y")}
    assert lexicons.load_lexicon(spark, b) == ("z", "y")
    rows = lexicons.read_lexicons(spark, {"a": a}).orderBy("ord").collect()
    assert [(r["list"], r["ord"], r.n_words) for r in rows] == [("a", 0, 2), ("a", 1, 1), ("a", 2, 3)]


def test_a_list_of_several_files(spark, tmp_path):
    os.mkdir(tmp_path / "l")
    put(tmp_path / "l", "2.txt", "c\na\n")
    put(tmp_path / "l", "1.txt", "a\nb")
    assert lexicons.load_lexicon(spark, str(tmp_path / "l")) == ("a", "b", "c")


def test_config(spark, tmp_path):
    path = put(tmp_path, "c.json", json.dumps({
        "paths": {"output": "out/"}, "sampling": {"vocabulary": 0.5},
        "duplicate_detection": {"shingle_size": 5}, "lda": {"topics": 3, "min_df": 1},
        "spark": {"shuffle_partitions": 12},
    }, indent=2))
    c = config.load_config(spark, path)
    assert (c.output, c.vocabulary_fraction, c.lda_fraction) == ("out/", 0.5, 0.2)
    assert (c.shingle_size, c.min_tokens, c.topics, c.min_df, c.shuffle_partitions) == (5, 5, 3, 1, 12)


def test_writers_replace_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, None), ("ক", 2, 0.5)], "a string, b int, c double")
    want = sorted(map(tuple, df.collect()))
    for write, read in (
        (writers.write_parquet, lambda p: spark.read.parquet(p)),
        (writers.write_csv, lambda p: spark.read.csv(p, header=True, schema=df.schema)),
        (writers.write_json_lines, lambda p: spark.read.schema(df.schema).json(p)),
    ):
        path = str(tmp_path / write.__name__)
        write(df.limit(1), path)
        write(df, path)
        assert sorted(map(tuple, read(path).collect())) == want
    path = str(tmp_path / "parts")
    writers.write_parquet(df, path, partition_by="b")
    assert {r.b for r in spark.read.parquet(path).collect()} == {1, 2}
    path = str(tmp_path / "report")
    writers.write_json_report(df.filter("b = 1"), path)
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    assert json.loads(text) == {"a": "x", "b": 1, "c": None}
    path = str(tmp_path / "lines")
    writers.write_json_lines(df, path)
    assert any('"c":null' in r.value for r in spark.read.text(path).collect())


def test_materialize_uses_the_shared_folder(spark):
    root = scratch_root(spark)
    assert root == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")
    df = materialize(spark.range(5).withColumn("a", F.array(F.lit("x"))), "t")
    assert df.count() == 5 and all(root.split(":")[-1] in f for f in df.inputFiles())


def test_small_tables_are_spread(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).coalesce(1).write.parquet(path)
    assert tables.read_table(spark, path).rdd.getNumPartitions() == 1
    spread = tables.read_table(spark, path, ["id"], spread_by="id")
    assert spread.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.range(100).repartition(2).write.parquet(path + "2")
    assert tables.read_table(spark, path + "2", spread_by="id").rdd.getNumPartitions() == 2


def test_folders_of_other_labels_are_not_read(spark, tmp_path):
    """Which label is wanted is known when the query runs; the scan reads that folder."""
    from corpuscope.sources.tables import read_labels

    rows = [(i, "abcd"[i % 4] if i else None, f"text {i}") for i in range(80)]
    path = str(tmp_path / "by-label")
    writers.write_parquet(spark.createDataFrame(rows, "id int, label string, text string"), path, partition_by="label")
    ranks = str(tmp_path / "ranks")
    spark.createDataFrame([("a", 2), ("b", 1), ("c", 3), (None, 1)], "label string, rank int").write.parquet(ranks)
    out = read_labels(spark.read.parquet(path), spark.read.parquet(ranks).where("rank = 1"), "label")
    assert sorted(r.id for r in out.collect()) == [i for i, label, _ in rows if label == "b"]
    assert "dynamicpruning" in out._jdf.queryExecution().toString()


def test_csv_cells_with_quotes_and_line_ends(spark, tmp_path):
    cells = ['a "quoted" word', "two\nlines", "comma, semicolon;", "", None, "back\\slash", ' spaces ', '"', "\r\n", '\\"', "é\u2028"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id int, cell string")
    path = str(tmp_path / "hard")
    writers.write_csv(df, path)
    got = {r.id: r.cell for r in writers.read_csv(spark, path, "id int, cell string").collect()}
    assert got == dict(enumerate(cells))

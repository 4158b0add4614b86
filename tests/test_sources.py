"""Readers and writers on files that a test has written."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import mining, project
from textloom.sources import files
from textloom.streaming import streams


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one\ntwo\n\nthree")
    (tmp_path / "b.txt").write_text("é four")
    (tmp_path / "sub" / "c.txt").write_text("deep")
    return tmp_path


def test_lines_and_whole_files(spark, folder):
    got = sorted((r.path.rpartition("/")[2], r.line) for r in files.read_lines(spark, f"{folder}/*.txt").collect())
    assert got == [("a.txt", ""), ("a.txt", "one"), ("a.txt", "three"), ("a.txt", "two"), ("b.txt", "é four")]
    assert sorted(r.text for r in files.read_whole(spark, f"{folder}/*.txt").collect()) == ["one\ntwo\n\nthree", "é four"]


def test_folders(spark, folder):
    name = lambda df: sorted((r.path.rpartition("/")[2], bytes(r.content)) for r in df.collect())
    flat = [("a.txt", b"one\ntwo\n\nthree"), ("b.txt", "é four".encode())]
    assert name(files.read_dir(spark, f"{folder}/*.txt")) == flat
    assert name(files.read_dir(spark, str(folder), recursive=True)) == [*flat, ("c.txt", b"deep")]
    assert name(files.read_dir(spark, str(folder), recursive=True, contains="/sub/")) == [("c.txt", b"deep")]
    assert sorted(bytes(r.content) for r in files.prefix(files.read_dir(spark, f"{folder}/*.txt"), 3).collect()) == [b"one", "é ".encode()]


def test_written_lines_come_back(spark, tmp_path):
    files.write_lines(spark.createDataFrame([("x",), ("y z",), ("",)], "line string"), f"{tmp_path}/out")
    assert sorted(r.line for r in files.read_lines(spark, f"{tmp_path}/out").collect()) == ["", "x", "y z"]


def test_word_sets_come_back(spark, tmp_path):
    sets, words = mining.encode_words(spark.createDataFrame([(1, "b a b"), (2, "c")], "id long, line string"), ["id"])
    assert {r.word: r.word_id for r in words.collect()} == {"a": 0, "b": 1, "c": 2}
    files.write_sets(sets, words, f"{tmp_path}/sets")
    back, dictionary = files.read_sets(spark, f"{tmp_path}/sets")
    assert {r.id: list(r.words) for r in back.collect()} == {1: ["a", "b"], 2: ["c"]} and dictionary.count() == 3


def test_wiki_xml(spark, tmp_path):
    page = "<page><title>T</title><text>'''Bold''' and [[a page|its label]], [[plain]] {{a box\nof text}}end\n\n\n== Part ==\nlast</text></page>"
    (tmp_path / "dump.xml").write_text(f"<mediawiki>{page}<page><text>two</text></page></mediawiki>")
    assert sorted(r.text for r in files.read_xml(spark, f"{tmp_path}/dump.xml", "page").collect()) == ["Bold and its label, plain end\nPart\nlast", "two"]


def test_changed_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "path string, line string")
    files.map_files(rows, lambda df: df.withColumn("line", F.upper("line")), f"{tmp_path}/out")
    assert sorted((r.path, r.line) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", "X"), ("a", "Y"), ("b", "Z")]


def test_lines_as_a_stream(spark, folder, tmp_path):
    got = streams.drain(streams.line_stream(spark, f"{folder}/*.txt"), f"{tmp_path}/work")
    assert sorted(r.line for r in got.collect()) == ["", "one", "three", "two", "é four"]


def test_window_counts(spark, tmp_path):
    spark.range(10).selectExpr("timestamp_seconds(id * 1000) AS ts", "id % 2 AS k").write.parquet(f"{tmp_path}/in")
    counts = streams.window_counts(streams.table_stream(spark, f"{tmp_path}/in/"), "ts", "k").select("window.start", "k", "n")
    got = streams.drain(counts, f"{tmp_path}/work").collect()
    # the last windows are still open when the stream ends
    assert sorted((r.k, r.n) for r in got) == [(0, 2), (1, 2)]


def test_piped_steps(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "line string")
    assert [r.line for r in project.then(df, lambda x: x.withColumn("line", F.upper("line")), lambda x: x.filter("line <> 'C'")).collect()] == ["A B"]

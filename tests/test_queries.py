"""Each query against its SQL, and rules of single operators on small frames."""

import os

import duckdb
import pytest

from textloom.functions import units as U
from textloom.operators import aggregate, filters, joins, project, rank
from textloom.plans.catalog import ORACLES, QUERIES
from textloom.sources import files

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return v.isoformat().replace("+00:00", "") if hasattr(v, "isoformat") else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"wordlist"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def rows(spark, *texts):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "doc_id long, line_no long, line string")


def test_entry_without_extras():
    import __spark_entry__ as e

    assert {"frqlist", "qc"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_clean_is_idempotent(spark):
    x = rows(spark, "  Hi\t\tthere ☃ 12!", "☃", "")
    once = [r.line for r in project.clean(x).collect()]
    assert once == ["Hi\tthere 12!"]
    assert [r.line for r in project.clean(project.clean(x)).collect()] == once


def test_dicer_keeps_alignment(spark):
    assert [r.line for r in project.dicer(rows(spark, "a\tb\tc", "a"), [2, 0]).collect()] == ["c\ta", ""]
    with pytest.raises(ValueError):
        project.dicer(rows(spark, "a"), [])


def test_column_spec():
    assert project.column_spec("2 1..5 ..6 3..") == [("col", 2, None), ("range", 1, 5), ("range", 0, 6), ("open", 3, None)]


def test_lengths_count_bytes(spark):
    assert filters.lengthfilter(rows(spark, "éé"), max_chars=3).count() == 0
    with pytest.raises(ValueError):
        filters.lengthfilter(rows(spark, "a"), max_words=0)


def test_ngrams_with_and_without_the_last(spark):
    x = rows(spark, "a b c", "a b c")
    assert {r.ngram: r.n for r in aggregate.ngrams(x, min_size=2, max_size=2).collect()} == {"a b": 2, "b c": 2}
    assert {r.ngram: r.n for r in aggregate.ngrams(x, min_size=2, max_size=3, compat=True).collect()} == {"a b": 2}


def test_recover_takes_the_last_duplicate(spark):
    build = rows(spark, "k\t1", "k\t2", "nokey")
    assert [r.recovered for r in joins.recover(spark.createDataFrame([("k",), ("x",)], "key string"), build).collect()] == ["k\t2"]


def test_global_rank_has_no_gaps(spark):
    x = spark.range(1000).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id % 13 AS DOUBLE) END AS v")
    got = [r.rank for r in rank.global_rank(x, "v", "id").orderBy("rank").collect()]
    assert got == list(range(1000))


def test_kv_requests(spark):
    x = spark.createDataFrame([(1, '{"key":"a"}'), (2, '{"key":"a","value":"1"}'), (3, '{"key":"a"}'), (4, "{}")], "seq long, request string")
    assert [(r.was_success, r.val) for r in files.kv_requests(x).orderBy("seq").collect()] == [(False, None), (True, None), (True, "1"), (False, None)]


def test_steps_undo(spark):
    from pyspark.sql import functions as F

    s = project.Steps().push("upper", F.upper).push("digits", lambda c: F.regexp_replace(c, "[0-9]", ""))
    x = rows(spark, "Hello222")
    assert x.select(s.apply(F.col("line"))).first()[0] == "HELLO"
    assert x.select(s.undo().apply(F.col("line"))).first()[0] == "HELLO222"


def test_pairs_are_adjacent_turns(spark):
    c = spark.createDataFrame([(1, 0, "user", "a\nb"), (1, 1, "assistant", "c"), (1, 2, "user", "d")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in U.pairs(c).collect()] == [(1000, "a b", "c")]

"""Curricula on a fixture."""

from textloom.plans import catalog


def test_wordlist_goes_on_until_no_line_has_one_unknown_word(spark, monkeypatch):
    words = ["one", "two", "three", "four", "five", "six", "seven", "eight"]
    chain = spark.createDataFrame([(i, 0, " ".join(words[: i + 1])) for i in range(8)], "doc_id long, line_no long, line string")
    monkeypatch.setattr(catalog, "lines", lambda spark, d: chain)
    monkeypatch.setattr(catalog, "_frequent", lambda spark, d: spark.createDataFrame([], "word string"))
    assert [(r.round, r.word) for r in catalog.wordlist(spark, "").orderBy("round").collect()] == list(enumerate(words))

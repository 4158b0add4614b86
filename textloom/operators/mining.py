"""Keywords, summaries, search and word alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import units as U
from .joins import pairwise_diff, small
from .rank import global_rank, unique_by


def rake(df: DataFrame, stopwords: DataFrame, id_cols: list[str], col: str = "line", minimum_score: float = 0.0, top_n: int | None = None) -> DataFrame:
    """(keyword, score): phrases between stop words and punctuation; a word scores its degree (the lengths
    of its phrases) over its frequency, a phrase the sum over its words. top_n is taken before the filter."""
    tokens = df.select(*id_cols, F.posexplode(F.regexp_extract_all(F.lower(F.col(col)), F.lit(r"[\p{L}\p{N}_']+|[^\p{L}\p{N}_'\s]"), F.lit(0))).alias("i", "word"))
    stop = small(stopwords.select("word").distinct().withColumn("stop", F.lit(1)))
    t = tokens.join(stop, "word", "left").withColumn("cut", F.col("stop").isNotNull() | ~F.col("word").rlike(r"[\p{L}\p{N}]"))
    per_row = t.groupBy(*id_cols).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "word", "cut"))), lambda x: F.when(x["cut"], F.lit("\u0001")).otherwise(x["word"])).alias("ws"))
    phrases = per_row.select(F.explode(F.split(F.array_join("ws", " "), " *\u0001 *", -1)).alias("keyword")).withColumn("keyword", F.trim("keyword")).filter("keyword <> ''")
    counts = phrases.groupBy("keyword").agg(F.count("*").alias("n")).withColumn("ws", F.split("keyword", " ", -1))
    words = counts.select(F.explode("ws").alias("word"), "n", F.size("ws").alias("len")).groupBy("word").agg((F.sum(F.col("n") * F.col("len")) / F.sum("n")).alias("s"))
    out = counts.select("keyword", F.explode("ws").alias("word")).join(words, "word").groupBy("keyword").agg(F.sum("s").alias("score"))
    if top_n is not None:
        out = out.orderBy(F.desc("score"), "keyword").limit(top_n)
    return out.filter(F.col("score") > minimum_score)


def _sentences(text: str, low: int, high: int) -> list[tuple[int, str]]:
    return [(i, s) for i, s in enumerate((text or "").split(".")) if low <= len(s.encode()) <= high]


#: Cells of a dense matrix of sentences and words; longer texts are counted by lists of the sentences of a word.
DENSE = 4_000_000


class _Shared:
    """How many words each sentence shares with all others, sentence by sentence.

    Memory is linear in the text: a dense matrix only up to DENSE cells.
    """

    def __init__(self, sentences: list[tuple[int, str]]):
        vocabulary: dict[str, int] = {}
        self.ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in set(s.split())], np.int64) for _, s in sentences]
        self.n = len(sentences)
        self.dense = self.holders = None
        if self.n * len(vocabulary) <= DENSE:
            self.dense = np.zeros((self.n, len(vocabulary)), np.float32)
            for i, x in enumerate(self.ids):
                self.dense[i, x] = 1
        else:
            word, at = np.concatenate(self.ids), np.repeat(np.arange(self.n), [len(x) for x in self.ids])
            order = np.argsort(word, kind="stable")
            self.holders = np.split(at[order], np.cumsum(np.bincount(word, minlength=len(vocabulary)))[:-1])

    def __iter__(self):
        """(first sentence, counts with all sentences) in blocks of rows."""
        if self.dense is not None:
            for a in range(0, self.n, 256):
                yield a, self.dense[a : a + 256] @ self.dense.T
        else:
            for i, words in enumerate(self.ids):
                row = np.zeros((1, self.n), np.float32)
                for w in words.tolist():
                    row[0, self.holders[w]] += 1
                yield i, row


def summarise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top_n: int = 3, length_penalty: float = 0.75, density: float = 2.6, bias: tuple[str, ...] = (), bias_strength: float = 2.0, low: int = 12, high: int = 169) -> DataFrame:
    """(doc_id, sentence_no, score): the top_n sentences of each text, by the words that they share with the
    sentences after them. With words of `bias`, what two sentences share counts the more, the more of those
    words they hold: 1 + (3 * both's number of them) ** bias_strength / bytes ** 0.64 times."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = _sentences(t, low, high)
                if len(s) < 2:
                    continue
                size = np.array([len(x.encode()) for _, x in s], float)
                score = np.zeros(len(s))
                held = np.array([len(set(bias) & set(x.split())) for _, x in s], float)
                for a, block in _Shared(s):
                    if bias:
                        mine = slice(a, a + len(block))
                        block = block * (1 + (3 * (held[mine, None] + held[None, :])) ** bias_strength / size[mine, None] ** 0.64)
                    after = np.arange(len(s))[None, :] > np.arange(a, a + len(block))[:, None]
                    score[a : a + len(block)] = (np.where(after, block, 0).astype(float) ** density).sum(1)
                score /= size**length_penalty
                for i in sorted(np.flatnonzero(score > 0).tolist(), key=lambda k: (-round(score[k], 9), s[k][0]))[:top_n]:
                    rows.append((d, s[i][0], float(score[i])))
            yield pd.DataFrame(rows, columns=["doc_id", "sentence_no", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, sentence_no long, score double")


def sentence_connections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: int = 12, high: int = 169) -> DataFrame:
    """(doc_id, i, j, shared): for sentences i < j of a text that share words, the number of those words.

    The result is quadratic in a text's sentences, as its definition is; memory is linear, since sentences
    are taken in blocks.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = _sentences(t, low, high)
                at = np.array([k for k, _ in s], np.int64)
                for a, block in _Shared(s) if len(s) > 1 else ():
                    i, j = np.nonzero(block)
                    i, j = (x[j > i + a] for x in (i, j))
                    if len(i):
                        yield pd.DataFrame({"doc_id": pd.Series([d] * len(i), dtype=object if d is None else None), "i": at[i + a], "j": at[j], "shared": block[i, j].astype(np.int64)})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, i long, j long, shared long")


def search(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", top_n: int = 3, low: int = 101) -> DataFrame:
    """(doc_id, sentence_no, score): the top_n sentences of each text for a query: over the sentences that
    share a word with it, (words shared with the query + 1)^3, divided by its own bytes."""
    kind = docs.schema[id_col].dataType.simpleString()
    want = set(query.split())

    def run(batches):
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = _sentences(t, low, 1 << 40)
                if len(s) < 2:
                    continue
                common = np.array([(len(want & set(x.split())) + 1.0) ** 3 for _, x in s])
                score = np.zeros(len(s))
                for a, block in _Shared(s):
                    near = block > 0
                    near[np.arange(len(near)), np.arange(a, a + len(near))] = False
                    score[a : a + len(near)] = near @ common
                score /= np.array([len(x.encode()) for _, x in s], float)
                for i in sorted(np.flatnonzero(score > 0).tolist(), key=lambda k: (-round(score[k], 9), s[k][0]))[:top_n]:
                    rows.append((d, s[i][0], float(score[i])))
            yield pd.DataFrame(rows, columns=["doc_id", "sentence_no", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, sentence_no long, score double")


def word_align(pairs: DataFrame, missing: float = -10_000.0) -> DataFrame:
    """(id, alignment): for each pair (id, l, r) its words' positions p1-p2 in the Moses form, by scores
    over all pairs of rows; each position is used once. Quadratic in the rows, as its definition is."""
    x = pairs.select("id", U.full_tokens("l").alias("lw"), U.full_tokens("r").alias("rw"))
    scores = pairwise_diff(x).withColumn("score", F.round("score", 9))
    left = x.select("id", F.posexplode("lw").alias("p1", "w1"), "rw")
    both = left.select("id", "p1", "w1", F.posexplode("rw").alias("p2", "w2"))
    scored = both.join(scores.select(F.col("p1").alias("w1"), F.col("p2").alias("w2"), "score"), ["w1", "w2"], "left").select(F.struct("id", "p1").alias("k1"), F.struct("id", "p2").alias("k2"), F.coalesce("score", F.lit(missing)).alias("score"))
    best = unique_by(scored, "k1", "k2").select(F.col("k1.id").alias("id"), F.col("k1.p1").alias("p1"), F.col("k2.p2").alias("p2"))
    rows = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("p1", "p2"))).alias("a"))
    return rows.select("id", F.array_join(F.transform("a", lambda y: F.concat_ws("-", y["p1"].cast("string"), y["p2"].cast("string"))), " ").alias("alignment"))


def encode_words(df: DataFrame, id_cols: list[str], col: str = "line") -> tuple[DataFrame, DataFrame]:
    """(id columns, words array) and (word, word_id): word sets of lines, and a dictionary with a number for
    each word, its position in the order of words."""
    sets = df.select(*id_cols, F.array_sort(F.array_distinct(U.words(col))).alias("words"))
    words = sets.select(F.explode("words").alias("word")).distinct().withColumn("__same", F.lit(0))
    dictionary = global_rank(words, "__same", "word", "word_id").drop("__same")
    return sets, dictionary

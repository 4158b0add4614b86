"""Packing token ids into fixed-length sequences by reciprocal-capacity classes.

A document's ids are cut into pieces whose lengths are a small fixed set: capacity // k for a few k,
and one last piece below the smallest of those. A piece of length n belongs to the class k =
capacity // n, and a sequence of that length takes exactly k pieces. Workers number their pieces of
each length by themselves; counts per worker and length then give every piece its place, so no worker
waits for another and only one sequence of each length is left part-filled. Those leftovers, a number
of pieces that depends on the capacity alone, are packed first-fit by decreasing length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .io import Stored, as_text, small_batches, table


def slots(capacity: int, least: int, waste: int) -> list[int]:
    """Lengths capacity // k >= least, falling, of which k leave at most `waste` of the capacity."""
    out = {capacity // k for k in range(1, capacity // least + 1) if capacity % (capacity // k) <= waste}
    return sorted(out, reverse=True)


def cuts(n: int, lengths: list[int]) -> list[int]:
    """Lengths of the pieces of n ids: the largest slots that fit, then the rest."""
    out = [lengths[0]] * (n // lengths[0])
    n %= lengths[0]
    for x in lengths:
        while x <= n:
            out.append(x)
            n -= x
    return [*out, n] if n else out


class Encoder:
    """Ids of a byte-level BPE as `tokenizers` gives them, with no special tokens added.

    Texts of plain letters go through `tiktoken`, whose ids over the same merges are the same and come
    faster; texts with characters from U+0250 on, where the two libraries' Unicode tables may differ,
    or with the name of a special token go through `tokenizers` itself.
    """

    def __init__(self, tokenizer: str, ranks: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer)
        self.special = [x.content for x in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers as P
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and (text.isascii() or max(text) < "ɐ") and not any(x in text for x in self.special):
            return self.fast.encode_to_numpy(text) if text else np.zeros(0, np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def _pieces(tokenizer: str, ranks: str | None, lengths: list[int], end_id: int):
    def run(batches):
        encode, worker, seen = Encoder(tokenizer, ranks), TaskContext.get().partitionId(), {}
        for b in batches:
            rows, doc = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = np.append(encode(text), end_id).astype("<u4")
                raw, at = ids.tobytes(), 0
                for n in cuts(len(ids), lengths):
                    seen[n] = seen.get(n, -1) + 1
                    rows.append((at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), len(ids), worker, seen[n]))
                    doc.append(i)
                    at += n
            cols = np.array(rows, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").take(pa.array(doc, pa.int64()))} | dict(zip(("start", "length", "ids_crc32", "doc_tokens", "worker", "nth"), cols, strict=True)))

    return run


def _first_fit(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        room: list[int] = []
        bins, offsets = [], []
        for n in pdf["length"]:
            k = next((i for i, r in enumerate(room) if r >= n), len(room))
            if k == len(room):
                room.append(capacity)
            bins.append(k)
            offsets.append(capacity - room[k])
            room[k] -= n
        pdf["sequence_id"] = pdf["first_free"] + np.array(bins, np.int64)
        pdf["offset"] = np.array(offsets, np.int64)
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str | None = None, ranks: str | None = None, end_id: int = 1, least: int = 64, waste: int = 8) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row for each piece.

    A document is its token ids and then end_id, cut into pieces; each id lies in one piece. Pieces of a
    sequence lie one after the other from offset 0, at most `capacity` ids together.

    Null or empty text: only end_id. Repeated rows are packed each for itself, null ids too. Other
    columns are not looked at. An empty table gives an empty table.
    """
    if tokenizer is None:
        import public_tokenizers as P

        tokenizer, ranks = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    small_batches(spark)
    store = Stored(spark)
    docs = as_text(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    lengths = slots(capacity, least, waste)
    pieces = store.keep(docs.mapInArrow(_pieces(tokenizer, ranks, lengths, end_id), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, worker long, nth long"))
    counts = pieces.groupBy("length", "worker").agg(F.count("*").alias("n"))
    by_length = Window.partitionBy("length")
    before = counts.select("length", "worker", (F.sum("n").over(by_length.orderBy("worker")) - F.col("n")).alias("before"))
    # a row for each length, of which there are at most `capacity`
    classes = pieces.groupBy("length").agg(F.count("*").alias("total")).withColumn("k", F.floor(F.lit(capacity) / F.col("length")))
    whole = F.floor(F.col("total") / F.col("k"))
    classes = classes.withColumn("whole", whole).withColumn("base", F.sum("whole").over(Window.orderBy(F.desc("length"))) - F.col("whole"))
    classes = classes.withColumn("first_free", F.sum("whole").over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    placed = pieces.join(before, ["length", "worker"]).join(F.broadcast(classes), "length").withColumn("i", F.col("before") + F.col("nth"))
    fits = F.col("i") < F.col("whole") * F.col("k")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = placed.filter(fits).select(*columns, (F.col("base") + F.floor(F.col("i") / F.col("k"))).cast("long").alias("sequence_id"), (F.pmod("i", "k") * F.col("length")).cast("long").alias("offset"))
    rest = placed.filter(~fits).select(*columns, "first_free")
    rest = rest.groupBy("first_free").applyInPandas(_first_fit(capacity), full.schema)
    return full.unionByName(rest)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts, sequences of 2048 ids."""
    return pack(table(spark, sf_dir, "documents"))

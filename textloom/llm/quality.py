"""Quality rules as a ledger: every rule is evaluated once, policies are bit masks over the outcome.

The ledger holds the measurements of a text and one bit for each rule that it fails. A policy is a
versioned set of rules; applying one, or taking a rule out of one, only needs `failures & mask`, so
ablations are sums over bits and no text is read again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .io import as_text, small_batches, table

#: Name and condition under which a text fails, over the measurements. The position is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines >= 3 AND 100 * n_dup_lines > 40 * n_lines"),
    ("few_letters", "100 * n_letter_words < 60 * n_words"),
    ("bullets", "n_lines >= 3 AND 100 * n_bullet_lines > 90 * n_lines"),
    ("ellipses", "n_lines >= 3 AND 100 * n_ellipsis_lines > 40 * n_lines"),
    ("endless_word", "max_word_bytes > 1000"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Versions of what must hold; each includes the base rules.
POLICIES: dict[str, int] = {
    "base": BASE,
    "2024.1": BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["short_words"] | BIT["long_words"],
    "2024.2": sum(BIT.values()),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_bullet_lines", "n_ellipsis_lines", "max_word_bytes"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _repeats(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its (row, key) occurs again, and whether it occurred before."""
    order = np.lexsort((np.arange(len(row)), key, row))
    r, k = row[order], key[order]
    same = np.zeros(len(row) + 1, bool)
    same[1:-1] = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    many, later = np.zeros(len(row), bool), np.zeros(len(row), bool)
    many[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return many, later


def _measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offs) - 1
    t = vec.prefix_hash(buf)
    s, e, row = vec.words(buf, offs)
    per = lambda at, w=None: np.bincount(at, w, n).astype(np.int64)
    within = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    chars, letters, symbols = within((buf & 0xC0) != 0x80), within(_LETTER[buf]), within(_SYMBOL[buf])
    out = {"n_words": per(row), "word_chars": per(row, chars[e] - chars[s]), "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]]}
    repeat = np.zeros(n, np.int64)
    if len(s) >= 5:
        wh = vec.span_hash(t, s, e)
        m = len(s) - 4
        by = vec.mix(np.arange(7, 12, dtype=np.uint64)) | np.uint64(1)
        window = sum(wh[i : i + m] * by[i] for i in range(5))
        whole = np.flatnonzero(row[:m] == row[4:])
        many, _ = _repeats(row[whole], window[whole])
        cover = np.zeros(len(s) + 5, np.int64)
        np.add.at(cover, whole[many], 1)
        np.add.at(cover, whole[many] + 5, -1)
        repeat = per(row, (np.cumsum(cover)[: len(s)] > 0).astype(float))
    out["n_repeat_words"] = repeat
    ends = np.flatnonzero(buf == 10)
    ls = np.sort(np.concatenate((offs[:-1], ends + 1)))
    le = np.sort(np.concatenate((offs[1:], ends)))
    lrow = np.repeat(np.arange(n), 1 + per(np.searchsorted(offs, ends, "right") - 1))
    first = np.searchsorted(s, ls)
    last = np.searchsorted(s, le)
    full = last > first
    ls, le, lrow, first, last = (x[full] for x in (ls, le, lrow, first, last))
    _, later = _repeats(lrow, vec.span_hash(t, ls, le))
    out["n_dup_lines"] = per(lrow[later])
    out["n_lines"] = per(lrow)
    out["n_letter_words"] = per(row[letters[e] > letters[s]])
    begin, end = buf[s[first]] if len(s) else buf[:0], e[last - 1] if len(s) else e
    out["n_bullet_lines"] = per(lrow[(begin == 42) | (begin == 45)])
    dots = np.concatenate(([0], np.cumsum(buf == 46)))
    out["n_ellipsis_lines"] = per(lrow[(end >= 3) & (dots[end] - dots[np.maximum(end - 3, 0)] == 3)])
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, e - s)
    out["max_word_bytes"] = longest
    return out


def _measured(batches):
    for b in batches:
        for i, j, buf, offs in vec.blocks(b.column("text")):
            found = _measure(buf, offs)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")[i:j]} | {k: found[k].astype(np.int64) for k in MEASURES})


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, failures): a row for each row of docs; failures has a bit for each rule.

    Words are [^\\x20\\x09-\\x0D]+. Null text: empty, which fails few_words. Repeated rows: each gets the
    same. Null ids stay null. Other columns are not looked at. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    docs = as_text(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(_measured, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in MEASURES))
    failures = F.lit(0).cast("long")
    for name, fails in RULES:
        failures = failures.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("failures", failures)


def verdict(policy: str | int = "2024.2", failures: str = "failures") -> Column:
    """Whether a row of the ledger meets a policy."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col(failures).bitwiseAND(F.lit(mask).cast("long")) == 0


def ablation(entries: DataFrame, policy: str | int = "2024.2") -> DataFrame:
    """(rule, n_failed, n_only, n_kept_without): per rule of a policy, rows that fail it, that fail it
    alone, and that the policy would keep without it; one aggregation over the ledger."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    of = F.col("failures").bitwiseAND(F.lit(mask).cast("long"))
    names = [n for n, _ in RULES if BIT[n] & mask]
    one = entries.groupBy(of.alias("m")).count()
    sums = one.agg(F.sum(F.when(F.col("m") == 0, F.col("count")).otherwise(0)).alias("kept"), *(F.sum(F.when(F.col("m").bitwiseAND(F.lit(BIT[n]).cast("long")) != 0, F.col("count")).otherwise(0)).alias(f"f_{n}") for n in names), *(F.sum(F.when(F.col("m") == BIT[n], F.col("count")).otherwise(0)).alias(f"o_{n}") for n in names))
    rows = F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(f"f_{n}", F.lit(0)).alias("n_failed"), F.coalesce(f"o_{n}", F.lit(0)).alias("n_only"), (F.coalesce("kept", F.lit(0)) + F.coalesce(f"o_{n}", F.lit(0))).alias("n_kept_without")) for n in names))
    return sums.select(F.inline(rows))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts, under the newest policy."""
    out = ledger(table(spark, sf_dir, "documents"))
    failed = F.col("failures").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return out.withColumn("base_failed", failed).withColumn("kept", verdict())

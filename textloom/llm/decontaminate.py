"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Benchmark items are cut into overlapping segments. A segment of m characters found with at most e
edits keeps at least m - q + 1 - e * q of its q-grams, all within e diagonals (place in the document
less place in the segment). Shared q-grams are counted in diagonal bands which overlap so that every
run of e + 1 diagonals lies in one of them; a band that meets the bound is a region, and the region is
verified by an alignment restricted to the band. The filter therefore loses nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .io import as_text, small_batches, table

Q = 8
#: Bytes of benchmark text that are indexed, and sent to the workers, at a time; more go in further passes.
INDEX_BYTES = 4 << 20
_LIGHT = np.zeros(256, bool)
_LIGHT[[32, *range(9, 14)]] = True


def normalise(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased, each run of ASCII white space one space, none at either end of a row."""
    buf = vec.lower(buf)
    space = _LIGHT[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1] & ~first[1:-1]
    kept = np.concatenate(([0], np.cumsum(keep)))
    out, at = np.where(space, np.uint8(32), buf)[keep], kept[offs]
    # a space that ends a row
    tail = at[1:][at[1:] > at[:-1]] - 1
    tail = tail[out[tail] == 32]
    if len(tail):
        gone = np.zeros(len(out) + 1, np.int64)
        gone[tail + 1] = 1
        mask = np.ones(len(out), bool)
        mask[tail] = False
        at = at - np.cumsum(gone)[at]
        out = out[mask]
    return out, at


def _grams(buf: np.ndarray) -> np.ndarray:
    if len(buf) < Q:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.as_strided(np.ascontiguousarray(buf), (len(buf) - Q + 1, Q), (1, 1)).copy().view(np.uint64).ravel()


def edits(m: int, percent: int) -> int:
    """The edit budget of m characters; the q-gram bound stays positive."""
    return max(0, min(m * percent // 100, (m - Q) // Q))


class Index:
    """Segments of some benchmark items and the places of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], length: int, least: int, percent: int):
        self.item, self.text, self.start = [], [], []
        for item, text in items:
            buf, _ = normalise(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
            t = buf.tobytes()
            if len(t) < least:
                continue
            starts = [*range(0, max(1, len(t) - length + 1), length // 2)]
            if starts[-1] + length < len(t):
                starts.append(len(t) - length)
            for s in starts:
                self.item.append(item)
                self.text.append(t[s : s + length])
                self.start.append(s)
        self.size = np.array([len(x) for x in self.text], np.int64)
        self.budget = np.array([edits(n, percent) for n in self.size.tolist()], np.int64)
        self.bound = self.size - Q + 1 - self.budget * Q
        parts = [(_grams(np.frombuffer(x, np.uint8)), k) for k, x in enumerate(self.text)]
        key = np.concatenate([g for g, _ in parts]) if parts else np.zeros(0, np.uint64)
        seg = np.repeat(np.arange(len(parts)), [len(g) for g, _ in parts])
        off = np.concatenate([np.arange(len(g)) for g, _ in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.seg, self.off = seg[order], off[order]
        self.keys, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(key))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self._slot(self.keys)] = True

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)

    def regions(self, buf: np.ndarray, offs: np.ndarray):
        """(row, segment, first diagonal) of bands that meet their bound; diagonals count from the buffer."""
        g = _grams(buf)
        if not len(g) or not len(self.keys):
            return
        hit = self.bits[self._slot(g)]
        # a region has its least bound of hits within the longest segment and its edits
        need, reach = int(self.bound.min()), int((self.size + self.budget).max())
        sums = np.concatenate(([0], np.cumsum(hit)))
        n = len(g)
        dense = sums[np.minimum(np.arange(n) + reach, n)] - sums[:n] >= need
        marks = np.zeros(n + reach + 1, np.int32)
        at = np.flatnonzero(dense)
        if not len(at):
            return
        np.add.at(marks, at, 1)
        np.add.at(marks, np.minimum(at + reach, n + reach), -1)
        pos = np.flatnonzero(hit & (np.cumsum(marks)[:n] > 0))
        k = np.searchsorted(self.keys, g[pos])
        k[k == len(self.keys)] = 0
        true = self.keys[k] == g[pos]
        pos, k = pos[true], k[true]
        row = np.searchsorted(offs, pos, "right") - 1
        inside = pos + Q <= offs[row + 1]
        pos, k, row = pos[inside], k[inside], row[inside]
        for c in range(0, len(pos), 200_000):
            # cut only where a region can't span
            yield from self._bands(pos[c : c + 200_000 + 4 * reach], k[c : c + 200_000 + 4 * reach], row[c : c + 200_000 + 4 * reach])

    def _bands(self, pos, k, row):
        count = self.first[k + 1] - self.first[k]
        src = np.repeat(np.arange(len(pos)), count)
        post = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + self.first[k][src]
        seg, off, row, diag = self.seg[post], self.off[post], row[src], pos[src] - self.off[post]
        wide = int(self.budget.max()) + 1  # bands of 2 * wide diagonals that begin every `wide`
        band = diag // wide
        seg, off, row, band = (np.concatenate(x) for x in ((seg, seg), (off, off), (row, row), (band, band - 1)))
        order = np.lexsort((off, band, seg, row))
        seg, off, row, band = seg[order], off[order], row[order], band[order]
        new = np.concatenate(([True], (seg[1:] != seg[:-1]) | (row[1:] != row[:-1]) | (band[1:] != band[:-1])))
        fresh = new | np.concatenate(([True], off[1:] != off[:-1]))
        at = np.flatnonzero(new)
        if not len(at):
            return
        distinct = np.add.reduceat(fresh.astype(np.int64), at)
        for i in at[distinct >= self.bound[seg[at]]].tolist():
            yield int(row[i]), int(seg[i]), int(band[i]) * wide, 2 * wide


def align(segment: bytes, text: bytes, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of segment in text among diagonals low <= d < low + width
    and `budget` more on either side; None beyond the budget. The earliest end wins a tie."""
    begin, end = max(0, low - budget), min(len(text), low + width + budget + len(segment))
    part = text[begin:end]
    if (at := part.find(segment)) >= 0:
        return 0, begin + at, begin + at + len(segment)
    n = len(part)
    a = np.frombuffer(part, np.uint8)
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    idx = np.arange(n + 1)
    for i, c in enumerate(segment, 1):
        sub = row[:-1] + (a != c)
        up = row[1:] + 1
        best, frm = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        best[0], frm[0] = i, 0
        best[1:] = np.minimum(sub, up)
        frm[1:] = np.where(sub <= up, start[:-1], start[1:])
        lead = np.minimum.accumulate(best - idx)  # insertions run along the row
        at = np.maximum.accumulate(np.where(best - idx == lead, idx, 0))
        row, start = lead + idx, frm[at]
    e = int(row.argmin())
    return (int(row[e]), begin + int(start[e]), begin + e) if row[e] <= budget else None


def _search(index):
    def run(batches):
        ix = index.value
        for b in batches:
            out = []
            for i, _, raw, raw_offs in vec.blocks(b.column("text")):
                buf, offs = normalise(raw, raw_offs)
                found: dict[tuple[int, int], tuple[int, int, int]] = {}
                done = set()
                for row, seg, low, width in ix.regions(buf, offs):
                    if (row, seg, low) in done:
                        continue
                    done.add((row, seg, low))
                    text = buf[offs[row] : offs[row + 1]].tobytes()
                    got = align(ix.text[seg], text, low - int(offs[row]), width, int(ix.budget[seg]))
                    if got and (got < found.get((row, seg), (1 << 30,))):
                        found[row, seg] = got
                for (row, seg), (e, s, t) in sorted(found.items()):
                    out.append((i + row, ix.item[seg], ix.start[seg], e, s, t))
            at = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").take(at), "uid": b.column("uid").take(at)} | {c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate(("item_id", "item_start", "edits", "start", "end"), 1)})

    return run


def passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 96, least: int = 32, percent: int = 7, with_uid: bool = False) -> DataFrame:
    """(doc_id, item_id, item_start, edits, start, end[, uid]): a row for each document and benchmark segment
    that occurs in it with at most percent / 100 edits a byte; its best place.

    Places count in UTF-8 bytes of the normalised text (A-Z lower-cased, white space runs one space).
    Items below `least` bytes are too short to tell and are left out, as are null texts on either side.
    Repeated rows: each has its own rows in the result. Ids of items are integers; null ones stay null.
    Other columns are not looked at. Empty tables give an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = as_text(docs, id_col, text_col).withColumn("uid", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total) // INDEX_BYTES + 1
    out = None
    for k in range(blocks):
        part = [(r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toLocalIterator()]
        index = spark.sparkContext.broadcast(Index(part, length, least, percent))
        kind = docs.schema["doc_id"].dataType.simpleString()
        found = docs.mapInArrow(_search(index), f"doc_id {kind}, uid long, item_id long, item_start long, edits long, start long, end long")
        out = found if out is None else out.unionByName(found)
    return out if with_uid else out.drop("uid")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

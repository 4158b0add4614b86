"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

A repeated string of `span` bytes is found from the one position in it that has the smallest q-gram
hash among its first `window` start positions: equal strings have that anchor at equal offsets. So
only anchors' suffixes need sorting, about 2 in `window` of all.

1. Prefix filter: the first span - window + 1 bytes of each anchor's suffix are hashed, and only
   anchors whose hash occurs again go on. No repeat can be lost here, since equal strings have equal
   hashes; a false hit only costs work.
2. Runs: workers sort their anchors' suffixes and front-code them (the length of the prefix shared
   with the one before, and the rest); equal neighbours become one entry with several owners. Runs are
   cut by prefix hash, so that suffixes with equal long prefixes meet.
3. Merge: a loser tree over the runs keeps, with each candidate, the prefix that it shares with the
   last winner. Two candidates are compared by those lengths first and by bytes only beyond them, so
   no known prefix is read again, and the shared prefixes of neighbours come out with the order.
4. In the merged order a window that starts o bytes before its anchor is repeated exactly if another
   suffix shares its span - o bytes (no smaller neighbour prefix lies between) and the o bytes before.

The same order answers for a second, shorter string length, by which repeated passages are reported.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .io import Stored, as_text, small_batches, table

_U = np.uint64
_OWNER = np.dtype([("doc", "<i8"), ("uid", "<i8"), ("a", "<i4")])
#: Entries of a front-coded run that travel together, and merged entries that are resolved together.
CHUNK, RESOLVE = 4000, 20_000


def _slide(x: np.ndarray, w: int, best) -> np.ndarray:
    """best over x[i:i+w], for each i with a whole window."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def _anchors(buf: np.ndarray, span: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last start position of the spans that it stands for, over one text."""
    starts = len(buf) - span + 1
    if starts <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    x = np.lib.stride_tricks.as_strided(np.ascontiguousarray(buf).view(np.uint8), (starts + window - 1, 8), (1, 1)).copy().view(_U).ravel()
    h = vec.mix(x)
    m = _slide(h, window, np.minimum)  # of the windows from each start
    cut = np.flatnonzero(m[1:] != m[:-1]) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [starts])) - 1
    # an anchor in each run of equal minima: the first place of that value; runs with ties take several
    hits = np.flatnonzero(_slide(np.concatenate((np.zeros(window - 1, _U), m, np.zeros(window - 1, _U))), window, np.maximum)[: len(h)] == h)
    out: list[tuple[int, int, int]] = []
    at = np.searchsorted(hits, first)
    for p, q, k in zip(first.tolist(), last.tolist(), at.tolist(), strict=True):
        v = m[p]
        while p <= q:
            while h[hits[k]] != v or hits[k] < p:
                k += 1
            a = int(hits[k])
            out.append((a, p, min(q, a)))
            p = a + 1
    a = np.array(out, np.int64)
    return a[:, 0], a[:, 1], a[:, 2]


def _find(span: int, window: int):
    pre = span - window + 1

    def run(batches):
        for b in batches:
            for i, j, buf, offs in vec.blocks(b.column("text")):
                t = vec.prefix_hash(buf)
                rows, found = [], []
                for k in range(j - i):
                    a, lo, hi = _anchors(buf[offs[k] : offs[k + 1]], span, window)
                    rows.append(np.full(len(a), i + k))
                    found.append((a, lo, hi, a + offs[k]))
                row = np.concatenate(rows)
                a, lo, hi, g = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").take(pa.array(row)), "uid": b.column("uid").take(pa.array(row)), "h": vec.span_hash(t, g, g + pre).view(np.int64), "a": a.astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)})

    return run


def _pack_run(entries: list[tuple[bytes, bytes, int, list]], last: bytes = b"") -> bytes:
    """Front-codes sorted (suffix, bytes before it, smallest offset of a window before the anchor, owners).

    last is the suffix that ends the chunk before. The first entry states what it shares with that, and
    is written in full all the same, so that a chunk can be read alone.
    """
    parts = []
    for i, (suffix, before, near, owners) in enumerate(entries):
        n = len(commonprefix((last, suffix))) if last else 0
        known = n if i else 0
        parts.append(struct.pack("<HHHHI", n, len(suffix) - known, len(before), near, len(owners)))
        parts.append(suffix[known:] + before)
        parts.append(b"".join(owners))
        last = suffix
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack_run(blob: bytes) -> Iterator[tuple[int, bytes, bytes, int, bytes, int]]:
    """(prefix shared with the one before, suffix, before, near, owners, number of owners)."""
    data, at, last = zstandard.ZstdDecompressor().decompress(blob), 0, b""
    while at < len(data):
        n, m, b, near, k = struct.unpack_from("<HHHHI", data, at)
        at += 12
        last = last[:n] + data[at : at + m]
        at += m
        before = data[at : at + b]
        at += b
        yield n, last, before, near, data[at : at + 20 * k], k
        at += 20 * k


def _runs(span: int, reach: int, buckets: int, limit: int = 40_000):
    """Rows (bucket, run, chunk, blob) of sorted front-coded suffixes, from texts with their anchors; a
    suffix ends reach bytes after the last start that its anchor stands for."""

    def run(batches):
        import uuid

        held: dict[int, dict[tuple, list]] = {}
        size = 0

        def flush():
            name = uuid.uuid4().hex
            out = []
            for bucket, group in held.items():
                rows = sorted((s, b, near, owners) for (s, b, near), owners in group.items())
                for c in range(0, len(rows), CHUNK):
                    out.append((bucket, name, c // CHUNK, _pack_run(rows[c : c + CHUNK], rows[c - 1][0] if c else b"")))
            held.clear()
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1]), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], ["bucket", "run", "chunk", "blob"])

        for batch in batches:
            for slot, z, spots in zip(batch.column("slot").to_pylist(), batch.column("z").to_pylist(), batch.column("spots").to_pylist(), strict=True):
                text = zstandard.ZstdDecompressor().decompress(z)
                for x in spots:
                    a, lo, hi = x["a"], x["lo"], x["hi"]
                    key = (text[a : hi + reach], text[lo:a], a - hi)
                    owner = struct.pack("<qqi", slot["i"], slot["u"], a)
                    held.setdefault(x["h"] % buckets, {}).setdefault(key, []).append(owner)
                    size += 1
                if size >= limit:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


class LoserTree:
    """Merges sorted runs of (shared, suffix, ...), comparing only beyond prefixes known to be shared.

    Each run's head carries lcp: the bytes it shares with the last winner overall. Of two heads the one
    with the longer lcp is smaller; with equal lcps the bytes from there decide, and the loser's lcp
    becomes what it shares with the winner that passed it.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = 1
        while self.k < len(runs):
            self.k *= 2
        self.head: list[tuple | None] = [next(r, None) for r in runs] + [None] * (self.k - len(runs))
        self.lcp = [0] * self.k
        self.tree = [0] * self.k
        self.tree[0] = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = self._play(a, b)
        self.tree[node] = lose
        return win

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        n, m = self.lcp[a], self.lcp[b]
        if n != m:
            return (a, b) if n > m else (b, a)
        s, t = x[1], y[1]
        i, end = n, min(len(s), len(t))
        if s[i:] == t[i:]:
            i = end
        else:
            while i + 32 <= end and s[i : i + 32] == t[i : i + 32]:
                i += 32
            while i < end and s[i] == t[i]:
                i += 1
        if (i == end and len(s) <= len(t)) or (i < end and s[i] < t[i]):
            self.lcp[b] = i
            return a, b
        self.lcp[a] = i
        return b, a

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        """(bytes shared with the entry before, entry), in order."""
        while (w := self.tree[0] if self.k > 1 else 0) is not None and (entry := self.head[w]) is not None:
            yield self.lcp[w], entry
            nxt = next(self.runs[w], None)
            self.head[w] = nxt
            if nxt is not None:
                self.lcp[w] = nxt[0]
            node = (w + self.k) // 2
            while node >= 1:
                w, self.tree[node] = self._play(w, self.tree[node])
                node //= 2
            if self.k > 1:
                self.tree[0] = w


def _resolve(rows: list[tuple[int, tuple]], span: int, apart: bool = False) -> list[tuple[int, int, int]]:
    """(row, first, last offset before the anchor) of repeated windows of span bytes, for whole groups of
    merged rows; apart: of those that are in two documents at least."""
    n = len(rows)
    shared = np.array([x[0] for x in rows], np.int64)
    size = np.array([len(x[1][1]) for x in rows], np.int64)
    many = np.array([x[1][5] for x in rows], np.int64)
    near = np.array([x[1][3] for x in rows], np.int64)
    lead = np.array([len(x[1][2]) for x in rows], np.int64)
    low = high = None
    if apart:
        low, high = np.empty(n, np.int64), np.empty(n, np.int64)
        for i, x in enumerate(rows):
            owners = np.frombuffer(x[1][4], _OWNER)
            of = vec.mix(owners["doc"].view(_U)) ^ owners["uid"].view(_U)
            low[i], high[i] = of.min().view(np.int64), of.max().view(np.int64)
    width = int(lead.max()) if n else 0
    left = np.zeros((width, n), np.uint8)
    for i, x in enumerate(rows):
        left[: lead[i], i] = np.frombuffer(x[1][2], np.uint8)[::-1]
    q, _ = vec.powers(width + 1)
    sums = np.zeros(n, _U)
    most, least = np.full(n, -1), np.full(n, -1)
    for o in range(width + 1):
        rows_o = np.flatnonzero((near <= o) & (o <= lead) & (size >= span - o))
        if len(rows_o):
            part = np.cumsum(shared < span - o)[rows_o]
            key = vec.mix(sums[rows_o] ^ (part.astype(_U) * _U(0x9E3779B97F4A7C15)))
            order = np.argsort(key)
            k, p, at = key[order], part[order], rows_o[order]
            begins = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (p[1:] != p[:-1]))))
            times = np.diff(np.append(begins, len(k)))
            total = np.minimum.reduceat(low[at], begins) != np.maximum.reduceat(high[at], begins) if apart else np.add.reduceat(many[at], begins) >= 2
            hit = at[np.repeat(total, times)]
            most[hit] = o
            least[hit[least[hit] < 0]] = o
        if o < width:
            sums += vec._BYTE[left[o]] * q[o]
    got = np.flatnonzero(most >= 0)
    return list(zip(got.tolist(), least[got].tolist(), most[got].tolist(), strict=True))


def _merge(spans_of: list[tuple[int, bool]], pre: int):
    """Rows (slot_id, uid, kind, s, e): the repeated bytes for each (span, apart), numbered by kind; pre: the
    bytes that suffixes which belong together share at least."""

    def spans(rows):
        out = []
        for kind, (span, apart) in enumerate(spans_of):
            for i, least, most in _resolve(rows, span, apart):
                owners = rows[i][1][4]
                for x in range(0, len(owners), 20):
                    doc, uid, a = struct.unpack_from("<qqi", owners, x)
                    out.append((doc, uid, kind, a - most, a - least + span))
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(cols)], ["slot_id", "uid", "kind", "s", "e"])

    def merged(chunks: dict[str, list[bytes]]):
        def entries(blobs):
            for blob in blobs:
                yield from _unpack_run(blob)

        rows: list[tuple[int, tuple]] = []
        for shared, entry in LoserTree([entries(x) for x in chunks.values()]):
            if len(rows) >= RESOLVE and shared < pre:
                yield spans(rows)
                rows = []
            rows.append((shared, entry))
        if rows:
            yield spans(rows)

    def run(batches):
        bucket, chunks = None, {}
        for b in batches:
            for k, name, blob in zip(b.column("bucket").to_pylist(), b.column("run").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if k != bucket and chunks:
                    yield from merged(chunks)
                    chunks = {}
                bucket = k
                chunks.setdefault(name, []).append(blob)
        if chunks:
            yield from merged(chunks)

    return run


def _shrink(batches):
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("uid"), pa.array([z.compress(x.encode()) for x in b.column("text").to_pylist()], pa.binary()), ], ["doc_id", "uid", "z"])


def _joined(spans) -> list[list[int]]:
    """Maximal runs of overlapping or touching spans, in order."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _cut(with_text: bool, least_words: int | None):
    kinds = {"spans": pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), "kept_sha256": pa.string(), "kept": pa.binary()}

    def run(batches):
        for b in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
            for z, spans in zip(b.column("z").to_pylist(), b.column("spans").to_pylist(), strict=True):
                text = zstandard.ZstdDecompressor().decompress(z)
                joined = _joined((y["s"], y["e"]) for y in spans or () if y["kind"] == 0)
                kept, at = [], 0
                for s, e in joined:
                    kept.append(text[at:s])
                    at = e
                kept = b"".join([*kept, text[at:]])
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(kept))
                out["n_spans"].append(len(joined))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["spans"].append([{"s": s, "e": e} for s, e in joined])
                if least_words is not None:
                    found = [e - s for s, e in _joined((y["s"], y["e"]) for y in spans or () if y["kind"] == 1) if len(text[s:e].split()) >= least_words]
                    out.setdefault("n_passages", []).append(len(found))
                    out.setdefault("passage_bytes", []).append(sum(found))
                if with_text:
                    out.setdefault("kept", []).append(kept)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400, window: int | None = None, with_text: bool = False, passages: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans[, n_passages, passage_bytes][, kept]): a row
    for each row of docs.

    A byte is removed if some string of `span` bytes that covers it starts at any other place of the
    input too. Overlapping occurrences count; strings are judged on the input. kept holds the remaining
    bytes, which need not be valid UTF-8 where a removed run ends inside a character. With passages
    (bytes, words), runs of bytes that strings of so many bytes cover which other documents hold too are
    reported, not removed, if they have so many words.

    Null text: empty. Texts shorter than span: untouched; very long ones are read in whole. Repeated rows:
    each repeats the other, so texts of at least span bytes lose all. Null ids: taken along, the id stays
    null. Ids are integers. Other columns are not looked at. An empty table gives an empty table.
    """
    least = min(span, passages[0]) if passages else span
    window = window or least // 2
    if not 8 <= window <= least - 8:
        raise ValueError("window must leave eight bytes on either side of span")
    spark = docs.sparkSession
    small_batches(spark)
    store = Stored(spark)
    docs = as_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.withColumn("uid", F.xxhash64("doc_id", "text", F.lit(1)))
    anchors = store.keep(docs.filter(F.octet_length("text") >= least).mapInArrow(_find(least, window), "doc_id long, uid long, h long, a int, lo int, hi int"))
    # written, so that the join below reads both sides from an exchange and a common prefix can be split
    again = store.keep(anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    spots = store.keep(anchors.join(again, "h", "left_semi").groupBy("doc_id", "uid").agg(F.collect_set(F.struct("h", "a", "lo", "hi")).alias("spots")))
    store.drop(anchors, again)
    packed = docs.mapInArrow(_shrink, "doc_id long, uid long, z binary")
    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["uid"] == y["uid"])
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
    joined = packed.alias("p").join(spots.alias("q"), same(packed, spots)).select(_slot("p"), "p.z", "q.spots")
    runs = joined.mapInArrow(_runs(least, max(span, least), buckets), "bucket int, run string, chunk int, blob binary")
    runs = runs.repartition(buckets, "bucket").sortWithinPartitions("bucket", "run", "chunk")
    wanted = [(span, False)] + ([(passages[0], True)] if passages else [])
    spans = store.keep(runs.mapInArrow(_merge(wanted, least - window + 1), "slot_id long, uid long, kind int, s int, e int"))
    store.drop(spots)
    spans = spans.groupBy("slot_id", "uid").agg(F.collect_set(F.struct("kind", "s", "e")).alias("spans"))
    out = packed.alias("p").join(spans.alias("q"), (F.coalesce(F.col("p.doc_id"), F.lit(-(2**63))) == F.col("q.slot_id")) & (F.col("p.uid") == F.col("q.uid")), "left").select("p.doc_id", "p.z", "q.spans")
    return out.mapInArrow(_cut(with_text, passages[1] if passages else None), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:int,e:int>>" + ", n_passages long, passage_bytes long" * bool(passages) + ", kept binary" * with_text)


def _slot(alias: str):
    """The id (null: the smallest number) and the hash that tell a row's spans from others'."""
    ids = F.coalesce(F.col(f"{alias}.doc_id"), F.lit(-(2**63)))
    return F.struct(ids.alias("i"), F.col(f"{alias}.uid").alias("u")).alias("slot")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts, strings of 400 bytes; beside that passages of over 50 words that other
    documents hold too, by strings of 256 bytes, which 51 words hardly ever fall short of."""
    return repeated_spans(table(spark, sf_dir, "documents"), passages=(256, 51)).drop("spans")

"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

Documents with equal shingle sets are one vertex. In each of several independent trees a vertex
follows a path of minwise tokens (the smallest shingle under one hash function after another), so
that a node of the tree holds vertices which agree in all tokens of its path. A node of at most
`node_size` vertices is compared exhaustively; a larger one branches by its next token. A node that is
still large at the last level is a crowd of vertices that all look alike: there each vertex is
compared with pivots from the middle of the crowd; what this leaves outside the crowd's main component
is held against the whole crowd in blocks, so no pair of different components goes unseen. Every link is confirmed on the full shingle sets. A pair of similarity s misses one tree, at level d, with
probability 1 - s**d, and all t trees with (1 - s**d)**t.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .components import components
from .io import Stored, as_text, small_batches, table

#: Minwise tokens in a signature, independent trees, levels of a tree.
WIDTH, TREES, DEPTH = 96, 16, 5
#: Pivots of a crowd; about as many vertices, or shingles, in a block of a crowd.
PIVOTS, BLOCK, BLOCK_SHINGLES = 2, 4096, 4_000_000
#: Vertices of a node that are compared exhaustively, and share of equal tokens below which a pair is not confirmed.
NODE_SIZE, SLACK = 24, 0.17
_U = np.uint64


def _sets(col, words: int) -> Iterator[list[np.ndarray]]:
    for i, j, buf, offs in vec.blocks(col):
        buf = vec.lower(buf)
        s, e, row = vec.words(buf, offs)
        yield vec.shingle_sets(vec.span_hash(vec.prefix_hash(buf), s, e), row, j - i, words)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise token (32 bits) of each non-empty set under each hash function."""
    full = [x for x in sets if len(x)]
    if not full:
        return np.zeros((0, WIDTH), np.uint32)
    flat = np.concatenate(full)
    starts = np.cumsum([0, *map(len, full[:-1])])
    seeds = vec.mix(np.arange(1, WIDTH + 1, dtype=_U)) | _U(1)
    out = np.empty((len(full), WIDTH), np.uint32)
    for k in range(WIDTH):
        out[:, k] = np.minimum.reduceat(((flat ^ (flat >> _U(29))) * seeds[k] >> _U(32)).astype(np.uint32), starts)
    return out


def _summaries(words: int):
    def run(batches):
        for b in batches:
            for sets in _chunks(_sets(b.column("text"), words)):
                n = np.array([len(x) for x in sets["sets"]], np.int64)
                sig = iter(_signatures(sets["sets"]))
                at = slice(sets["at"], sets["at"] + len(n))
                k1 = np.array([x.sum(dtype=_U) for x in sets["sets"]], _U).view(np.int64)
                k2 = np.array([np.bitwise_xor.reduce(vec.mix(x)) for x in sets["sets"]], _U).view(np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")[at], "uid": b.column("uid")[at], "n_shingles": n, "k1": k1, "k2": k2, "sig": pa.array([next(sig).tobytes() if x else None for x in n.tolist()], pa.binary())})

    return run


def _chunks(found) -> Iterator[dict]:
    at = 0
    for sets in found:
        yield {"at": at, "sets": sets}
        at += len(sets)


def _orders() -> list[np.ndarray]:
    """The hash functions that each tree branches by."""
    return [np.random.RandomState(1000 + t).permutation(WIDTH)[:DEPTH] for t in range(TREES)]


def _keys(sig: np.ndarray) -> list[np.ndarray]:
    """For each level, the keys of the nodes (a row for each tree) of signatures."""
    keys = np.empty((DEPTH, TREES, len(sig)), _U)
    for t, order in enumerate(_orders()):
        key = np.full(len(sig), t + 1, _U)
        for d, c in enumerate(order):
            keys[d, t] = key = vec.mix(key * _U(0x9E3779B97F4A7C15) + sig[:, c].astype(_U) + _U(1))
    return list(keys)


def _paths(batches):
    """A row for each vertex and tree, with the keys of its nodes on all levels."""
    for b in batches:
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, WIDTH)
        yield pa.RecordBatch.from_pydict({"rep": np.tile(b.column("rep").to_numpy(zero_copy_only=False), TREES)} | {f"n{d}": k.reshape(-1).view(np.int64) for d, k in enumerate(_keys(sig))})


def _likely(threshold: float):
    """Keeps pairs whose signatures agree often enough."""
    least = (threshold - SLACK) * WIDTH

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, WIDTH) for c in ("sa", "sb"))
                est = (x == y).sum(1)
                keep = np.flatnonzero(est >= least)
                yield pa.RecordBatch.from_pydict({"a": b.column("a").take(pa.array(keep)), "b": b.column("b").take(pa.array(keep)), "est": est[keep].astype(np.int32)})

    return run


def _set_rows(words: int):
    def run(batches):
        for b in batches:
            for sets in _chunks(_sets(b.column("text"), words)):
                yield pa.RecordBatch.from_pydict({"rep": b.column("v")[sets["at"] : sets["at"] + len(sets["sets"])], "members": pa.array([x.tobytes() for x in sets["sets"]], pa.binary())})

    return run


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    """Keeps pairs with 100 * intersection >= percent * union, on whole sets."""

    def run(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column("ma").to_pylist(), b.column("mb").to_pylist(), strict=True)):
                if _alike(np.frombuffer(x, _U), np.frombuffer(y, _U), percent):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_pydict({"a": b.column("a").take(keep), "b": b.column("b").take(keep)})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, with_groups: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept[, uid, group_id]): a row for each row of docs.

    Similarity is that of the sets of `words`-word shingles (A-Z lower-cased, words between ASCII
    white space); two documents are linked from `percent` per cent on. component_id is the smallest id
    reachable over links, kept says whether that is the document itself. If asked for, uid is a hash of
    the text, which tells rows that share an id apart, and group_id a number of the component, null where
    a row takes part in no links.

    Null or empty text, or text without words: an empty set, linked with nothing. Fewer words than
    `words`: one shingle of all of them. Very long texts are read in whole. Repeated rows: each gets the
    same answer. Different texts under one id: each has its own links and component. Null ids: the row
    takes part in no link and is its own component, with a null component_id and kept. Other columns
    are not looked at. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    store = Stored(spark)
    docs = as_text(docs, id_col, text_col).withColumn("uid", F.xxhash64("text"))
    schema = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    all_rows = store.keep(docs.mapInArrow(_summaries(words), f"doc_id {schema}, uid long, n_shingles long, k1 long, k2 long, sig binary"))
    by_set = ["n_shingles", "k1", "k2"]
    rows = all_rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # a vertex for each set, with its smallest document; the number that it gets is fixed once it is written
    sets = rows.groupBy(*by_set).agg(F.min(F.struct("doc_id", "uid")).alias("least"), F.min("sig").alias("sig"))
    vertices = store.keep(sets.select(F.monotonically_increasing_id().alias("rep"), "least.doc_id", "least.uid", *by_set, "sig", F.col("n_shingles").alias("n")))
    comp = store.keep(_linked(store, docs, vertices, words, percent))
    own = vertices.select("rep", "doc_id", *by_set).join(comp, F.col("rep") == F.col("v"), "left").withColumn("c", F.coalesce("c", "rep"))
    least = own.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    own = own.select("c", *by_set).join(least, "c").select(*by_set, "component_id", F.col("c").alias("group_id"))
    out = all_rows.select("doc_id", "uid", *by_set).join(own, by_set, "left")
    linked = F.col("n_shingles").cast("boolean") & F.col("doc_id").isNotNull()
    out = out.withColumn("component_id", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id"))).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", "kept", *(["uid", F.when(linked, F.col("group_id")).alias("group_id")] if with_groups else []))


def _linked(store: Stored, docs: DataFrame, vertices: DataFrame, words: int, percent: int) -> DataFrame:
    """(v, c): the components of the vertices that have confirmed links."""
    levels = [f"n{d}" for d in range(DEPTH)]
    rows = store.keep(vertices.select("rep", "sig").mapInArrow(_paths, "rep long, " + ", ".join(f"{c} long" for c in levels)))
    pairs = None
    for d, c in enumerate(levels):
        # both sides of the join are written first, so that it reads them from exchanges only and a node with
        # very many vertices can be split; the joined rows are read twice, by the pairs and by the next level
        sizes = store.keep(rows.groupBy(c).agg(F.count("*").alias("size")).filter("size > 1"))
        sized = store.keep(rows.drop("size").join(sizes, c).select("rep", *levels[d:], "size"))
        if d == 0:
            store.drop(rows)
        store.drop(sizes)
        small = sized.filter(F.col("size") <= NODE_SIZE).select(F.col(c).alias("node"), "rep")
        new = small.select("node", F.col("rep").alias("a")).join(small.select("node", F.col("rep").alias("b")), "node").filter("a < b").select("a", "b")
        pairs = new if pairs is None else pairs.unionByName(new)
        rows = sized.filter(F.col("size") > NODE_SIZE)
    crowd = rows.select("rep", F.col(levels[-1]).alias("node"))
    crowd = store.keep(crowd.join(crowd.groupBy("rep").agg(F.count("*").alias("degree")), "rep"))
    crowded = not crowd.isEmpty()
    pairs = pairs.distinct()
    signed = vertices.select(F.col("rep").alias("a"), F.col("sig").alias("sa"))
    other = vertices.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))

    def likely(df: DataFrame) -> DataFrame:
        return df.join(signed, "a").join(other, "b").select("a", "b", "sa", "sb").mapInArrow(_likely(percent / 100), "a long, b long, est int")

    found = store.keep(likely(pairs))
    # first what ties each vertex to its likeliest partners, then only pairs that this left apart
    best = found.select(F.col("b").alias("x"), "a", "b", "est").unionByName(found.select(F.col("a").alias("x"), "a", "b", "est")).groupBy("x").agg(F.max(F.struct("est", "a", "b")).alias("m"), F.min(F.struct("a", "b")).alias("l"))
    todo = best.select("m.a", "m.b").unionByName(best.select("l.a", "l.b"))
    if crowded:
        todo = todo.unionByName(likely(_with_pivots(crowd, _pivots(crowd))).select("a", "b"))
    tried = store.keep(todo.distinct())
    links = store.keep(_confirmed(_members(store, docs, vertices, _ends(tried), words), tried, percent))
    label = store.keep(components(store, links))
    ca, cb = (label.select(F.col("v").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
    apart = found.select("a", "b").join(tried, ["a", "b"], "left_anti").join(ca, "a", "left").join(cb, "b", "left")
    todo = store.keep(apart.filter(~F.coalesce("ca", "a").eqNullSafe(F.coalesce("cb", "b"))).select("a", "b"))
    outside = store.keep(_outside(crowd, label)) if crowded else None
    if todo.isEmpty() and (not crowded or outside.isEmpty()):
        return label
    wanted = _ends(todo)
    if crowded:
        crowd = crowd.join(outside.select("node").distinct(), "node", "left_semi")
        wanted = wanted.unionByName(crowd.select("rep")).distinct()
    members = _members(store, docs, vertices, wanted, words)
    more = _confirmed(members, todo, percent)
    if crowded:
        more = more.unionByName(_held(outside, crowd, label, vertices, members, percent))
    return components(store, links.unionByName(more))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()


def _pivots(crowd: DataFrame) -> DataFrame:
    """(node, p): two vertices of each node, of those that are in most crowded nodes: they carry the
    most frequent tokens, so they stand in the middle of what looks alike."""
    picks = [F.max(F.struct("degree", F.xxhash64("rep", F.lit(k)).alias("h"), "rep")).alias(f"p{k}") for k in range(PIVOTS)]
    chosen = crowd.groupBy("node").agg(*picks)
    return chosen.select("node", F.explode(F.array_distinct(F.array(*(F.col(f"p{k}.rep") for k in range(PIVOTS))))).alias("p"))


def _with_pivots(crowd: DataFrame, pivots: DataFrame) -> DataFrame:
    """Each vertex of a node with the node's pivots."""
    return crowd.join(pivots, "node").filter("rep <> p").select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).distinct()


def _outside(crowd: DataFrame, label: DataFrame) -> DataFrame:
    """(rep, node): the vertices of each node outside the component that has most of the node's vertices.
    Of two vertices of a node in different components, one is outside at least."""
    own = crowd.join(label, crowd["rep"] == label["v"], "left").select("rep", "node", F.coalesce("c", "rep").alias("c"))
    main = own.groupBy("node", "c").agg(F.count("*").alias("n")).groupBy("node").agg(F.max(F.struct("n", "c")).alias("m")).select("node", F.col("m.c").alias("main"))
    return own.join(main, "node").filter("c <> main").select("rep", "node")


def _held(outside: DataFrame, crowd: DataFrame, label: DataFrame, vertices: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of each vertex outside with vertices of other components in its nodes, which are read
    in blocks of bounded size; from one block at least one link to each component that has any."""
    blocks = crowd.join(vertices.select("rep", "n"), "rep").groupBy("node").agg(F.floor(F.count("*") / BLOCK + F.sum("n") / BLOCK_SHINGLES + 1).alias("blocks"))
    full = vertices.select("rep", "sig").join(label, vertices["rep"] == label["v"], "left").select("rep", "sig", F.coalesce("c", "rep").alias("c")).join(members, "rep")
    x = outside.join(blocks, "node").select("node", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"))
    y = crowd.select("node", "rep").join(blocks, "node").select("node", "rep", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), F.lit(0).alias("asks"))
    rows = x.unionByName(y).join(full, "rep").repartition("node", "block").sortWithinPartitions("node", "block", "asks")
    near = rows.select("node", "block", "asks", "rep", "c", "sig", "members").mapInArrow(_block_links(percent), "x long, y long")
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _block_links(percent: int):
    """Of the rows of a block, those that ask (they come last) with others that they are linked to.

    Candidates come from the whole signatures, without a limit on their number; a pair that shares
    several nodes is only looked at in the first tree that it shares."""
    least = (percent / 100 - SLACK) * WIDTH
    columns = np.array(_orders())

    def run(batches):
        at, held = None, []
        for b in batches:
            node, block, asks, comp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "block", "asks", "c"))
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, WIDTH)
            rep, sets = b.column("rep").to_pylist(), b.column("members")
            out: list[tuple] = []
            cut = np.flatnonzero((node[1:] != node[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(node)], strict=True):
                if i == j:
                    continue
                if (node[i], block[i]) != at:
                    at, held = (node[i], block[i]), []
                if not asks[i]:
                    held.append((rep[i:j], comp[i:j], sig[i:j], [np.frombuffer(m, _U) for m in sets[i : j].to_pylist()]))
                elif held:
                    held = [(sum((h[0] for h in held), []), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), sum((h[3] for h in held), []))]
                    reps, comps, sigs, full = held[0]
                    tree = (_keys(sig[i : i + 1])[-1][:, 0].view(np.int64) == node[i]).argmax()
                    for k in range(i, j):
                        same = sigs == sig[k]
                        est = same.sum(1)
                        near = np.flatnonzero((est >= least) & (comps != comp[k]))
                        near = near[same[near][:, columns].all(2).argmax(1) == tree]
                        mine, done = np.frombuffer(sets[k].as_py(), _U), set()
                        for m in near[np.argsort(-est[near], kind="stable")].tolist():
                            if comps[m] not in done and _alike(mine, full[m], percent):
                                done.add(comps[m])
                                out.append((rep[k], reps[m]))
            cols = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], ["x", "y"])

    return run


def _members(store: Stored, docs: DataFrame, vertices: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, members): the whole shingle sets of the wanted vertices, from one document of each."""
    wanted = vertices.join(wanted, "rep", "left_semi").select(F.col("rep").alias("v"), "doc_id", "uid")
    texts = docs.join(wanted, ["doc_id", "uid"]).select("v", "text")
    return store.keep(texts.mapInArrow(_set_rows(words), "rep long, members binary").dropDuplicates(["rep"]))


def _confirmed(members: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    joined = pairs.join(members.select(F.col("rep").alias("a"), F.col("members").alias("ma")), "a").join(members.select(F.col("rep").alias("b"), F.col("members").alias("mb")), "b")
    return joined.select("a", "b", "ma", "mb").mapInArrow(_confirm(percent), "a long, b long")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, three-word shingles, links from a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)

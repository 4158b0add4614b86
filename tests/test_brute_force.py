"""Queries without SQL against plain Python over whole small tables."""

import json
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex

from textloom.functions import units as U
from textloom.operators import aggregate, cover, distance, joins, rank
from textloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
WORD = regex.compile(r"[\p{L}\p{N}_]+(?:['.][\p{L}\p{N}_]+)*")


def size(b):
    return len(pa.compress(b, codec="lz4_raw", asbytes=True)) + 4 if b else 4


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


@pytest.fixture(scope="module")
def references(docs):
    out = {}
    for lang in sorted({x[2] for x in docs}):
        texts = [t[:20_000] for _, t, x in docs if x == lang][:12]
        out[lang] = "\n".join(texts).encode()[:20_000]
    return out


def test_langdetect(spark, docs, references):
    total = sum(map(size, references.values()))
    got = {r.doc_id: json.loads(r.detected) for r in QUERIES["langdetect"](spark, SF).collect()}
    for d, t, _ in docs:
        want = {k: (1 - size(v + t.encode()) / (size(v) + size(t.encode()))) * size(v) / total for k, v in references.items()}
        assert [x["language_name"] for x in got[d]] == sorted(want, key=lambda k: (want[k], k))
        assert all(x["likelihood"] == pytest.approx(want[x["language_name"]]) for x in got[d])


def test_langfilter(spark, docs, references):
    sizes = {k: size(v) for k, v in references.items()}
    mean = sum(sizes.values()) / len(sizes)
    want = set()
    for d, t, _ in docs:
        ratios = {k: size(v + t.encode()) / (sizes[k] + size(t.encode())) for k, v in references.items()}
        base = 1 - max(ratios.values())
        conf = {k: (1 - r) / base * sizes[k] / mean for k, r in ratios.items()}
        best = sorted(conf, key=lambda k: (-conf[k], k))[:2]
        if "fr" in best and conf["fr"] > 0.5:
            want.add(d)
    assert {r.doc_id for r in QUERIES["langfilter"](spark, SF).collect()} == want and want


@pytest.fixture(scope="module")
def matrix(spark):
    items = sorted((r.item_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    return {(i, j): size(a + b) / (size(a) + size(b)) for i, a in items for j, b in items if i != j}


def test_ncd_matrix(spark, matrix):
    got = {(r.i, r.j): r.d for r in QUERIES["ncd_matrix"](spark, SF).collect()}
    assert got.keys() == matrix.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in matrix.items())


def test_clusters_cannot_be_bettered_by_one_move(spark, matrix):
    of = {r.path: r.medoid for r in QUERIES["cluster"](spark, SF).collect()}
    names = sorted(of)
    d = lambda a, b: 0 if a == b else matrix[a, b]
    loss = lambda ms: sum(min(d(n, m) for m in ms) for n in names)
    medoids = sorted(set(of.values()))
    assert len(medoids) == 5 and all(d(n, of[n]) == min(d(n, m) for m in medoids) for n in names)
    now = loss(medoids)
    assert all(loss([*(m for m in medoids if m != out), new]) >= now - 1e-9 for out in medoids for new in names)
    moved = {r.path: r.cluster for r in QUERIES["cluster_reassign"](spark, SF).collect()}
    group = {n: medoids.index(of[n]) for n in names}
    for _ in range(1000):
        held = [[n for n in names if group[n] == c] for c in range(5)]
        mean = {n: [sum(d(n, x) for x in h) / max(len(h) - (n in h), 1) for h in held] for n in names}
        gain = {n: mean[n][group[n]] - min(mean[n]) for n in names}
        worst = max(names, key=lambda n: (gain[n], -n))
        if gain[worst] <= 1e-12:
            break
        group[worst] = mean[worst].index(min(mean[worst]))
    assert moved == group


def test_dundant(spark, docs):
    ratio = {d: len(t.encode()) / size(t.encode()) for d, t, _ in docs}
    mean = sum(ratio.values()) / len(ratio)
    got = {r.doc_id: r.value for r in QUERIES["dundant"](spark, SF).collect()}
    assert all(got[d] == pytest.approx(x / mean, abs=1e-8) for d, x in ratio.items()) and got.keys() == ratio.keys()


def test_diversify(spark):
    rows = {r.page_id: r.html.encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    want = {}
    for d, t in rows.items():
        parts = distance._chunks(t, 512)
        assert b"".join(parts) == t and all(0 < len(p) <= 512 for p in parts)
        for k, p in enumerate(parts):
            rest = b"".join(parts[:k] + parts[k + 1 :])
            want[d, k] = size(rest + p) / (size(rest) + size(p))
    got = {(r.page_id, r.chunk_no): r.redundancy for r in QUERIES["diversify"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-8) for k, v in want.items())


def test_word_align(spark):
    n = spark.read.parquet(f"{SF}/nation.parquet").collect()
    regions = {r.r_regionkey: r.r_name for r in spark.read.parquet(f"{SF}/region.parquet").collect()}
    rows = sorted((r.n_nationkey, r.n_name.split(), regions[r.n_regionkey].split()) for r in n)
    score = Counter()
    for x, (_, la, ra) in enumerate(rows):
        for _, lb, rb in rows[x + 1 :]:
            dl, dr, sl, sr = set(la) - set(lb), set(ra) - set(rb), set(la) & set(lb), set(ra) & set(rb)
            for p, q, w in ((dl, dr, lambda a, b: 1 / (a * b)), (sl, sr, lambda a, b: 1 / (a * b)), (dl, sr, lambda a, b: -1 + 1 / (a + b)), (sl, dr, lambda a, b: -1 + 1 / (a + b))):
                for a in p:
                    for b in q:
                        score[a, b] += w(len(p), len(q))
    got = {r.id: r.alignment for r in QUERIES["word_align"](spark, SF).collect()}
    for i, left, right in rows:
        best = {}
        for a, x in enumerate(left):
            s = lambda b: round(score.get((x, right[b]), -10_000.0), 9)  # noqa: E731, B023
            best[a] = min(range(len(right)), key=lambda b: (-s(b), b)), x
        taken = {}
        for a, (b, x) in best.items():
            s = round(score.get((x, right[b]), -10_000.0), 9)
            if b not in taken or (-s, a) < taken[b]:
                taken[b] = (-s, a)
        assert got[i] == " ".join(f"{a}-{b}" for a, b in sorted((a, b) for b, (_, a) in taken.items()))


def test_qc_fitted(spark):
    pairs = sorted((r.id, r.l, r.r) for r in U.pairs(spark.read.parquet(f"{SF}/conversations.parquet")).collect())
    letters = lambda t: [ord(c) for c in t if regex.match(r"[\p{L}\p{N}]", c)]
    scores = {i: [0.0, 0.0] for i, *_ in pairs}
    for side in (1, 2):
        points = {p[0]: letters(p[side]) for p in pairs}
        lo, hi = (math.floor(sum(f(x) for x in points.values() if x) / len(pairs)) for f in (min, max))
        top = Counter(w for p in pairs for w in WORD.findall(p[side].lower()))
        top = set(sorted(top, key=lambda w: (-top[w], w))[:5000])
        for p in pairs:
            x, ws = points[p[0]], WORD.findall(p[side])
            scores[p[0]][0] -= (abs(1 - (min(x) if x else lo) / lo) + abs(1 - (max(x) if x else hi) / hi)) / 2
            scores[p[0]][1] += sum(w in top for w in ws) / len(ws) if ws else math.nan
    total = Counter()
    for k in (0, 1):
        order = sorted(scores, key=lambda i: (math.isnan(scores[i][k]), -scores[i][k], i))
        for at, i in enumerate(order):
            total[i] += at
    want = sorted(scores, key=lambda i: (total[i], i))[: int(len(pairs) * 0.5)]
    assert sorted((r.id, r.total) for r in QUERIES["qc_fitted"](spark, SF).collect()) == sorted((i, total[i]) for i in want)


def test_curriculum_by_a_naive_loop(spark):
    rows = [r.line for r in U.lines(spark.read.parquet(f"{SF}/documents.parquet")).filter("doc_id < 40").select("line").collect()]
    sets = [set(WORD.findall(t.lower())) for t in rows]
    known = {w for w, _ in sorted(Counter(w for s in sets for w in s).items(), key=lambda x: (-x[1], x[0]))[:400]}
    unknown, want, total = [s - known for s in sets], [], 26
    while True:
        two = Counter()
        for s in unknown:
            if len(s) == 2:
                two.update(s)
        only = {w for s in unknown if len(s) == 1 for w in s}
        if not only:
            break
        got = sorted(only, key=lambda w: (-two[w], w))[: max(1, total // 2)]
        want.append(got)
        total += len(got)
        unknown = [s - set(got) for s in unknown]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, line string")
    assert len(want) > 1
    assert cover.curriculum(df, ["id"], existing=spark.createDataFrame([(w,) for w in known], "word string"), max_rounds=6) == want[:6]


def test_ranges_split_equal_numbers(spark):
    x = spark.range(5000).selectExpr("id", "id % 2 AS side", "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 1.0 END AS v")
    out = rank.global_rank(x, "v", "id", group="side", descending=True, range_rows=100)
    got = {(r.side, r.id): r.rank for r in out.collect()}
    none = lambda i: i % 5 == 0 or i % 7 == 0
    for side in (0, 1):
        order = sorted(range(side, 5000, 2), key=lambda i: (none(i), i))
        assert [got[side, i] for i in order] == list(range(2500))
    assert rank.global_rank(x.limit(0), "v", "id").count() == 0


def test_long_texts_are_counted_by_lists(monkeypatch):
    from textloom.operators import mining

    draw = np.random.RandomState(4)
    sentences = [(i, " ".join(f"w{k}" for k in draw.randint(0, 40, 9))) for i in range(300)]
    whole = np.concatenate([b for _, b in mining._Shared(sentences)])
    monkeypatch.setattr(mining, "DENSE", 0)
    assert np.array_equal(whole, np.concatenate([b for _, b in mining._Shared(sentences)]))


def test_biased_summary(spark):
    from textloom.operators import mining

    text = ".".join(["the red house on a hill", "a red cat and the dog", "some dog on the hill", "nothing in common", "the red dog"])
    s = [x for x in text.split(".") if len(x) >= 12]
    score = {}
    for i, a in enumerate(s):
        score[i] = 0.0
        for b in s[i + 1 :]:
            both = len({"red"} & set(a.split())) + len({"red"} & set(b.split()))
            score[i] += (len(set(a.split()) & set(b.split())) * (1 + (3 * both) ** 2.0 / len(a) ** 0.64)) ** 2.6
        score[i] /= len(a) ** 0.75
    got = mining.summarise(spark.createDataFrame([(1, text)], "doc_id long, text string"), bias=("red",)).collect()
    want = sorted((i for i in score if score[i] > 0), key=lambda i: (-score[i], i))[:3]
    assert [(r.sentence_no, round(r.score, 4)) for r in got] == [(i, round(score[i], 4)) for i in want]


def test_greedy_batches(spark):
    rows = [(g, i, n) for g in ("a", None) for i, n in enumerate([4, 4, 4, 11, 1, 9, None, 2])]
    out = aggregate.batch_by_size(spark.createDataFrame(rows, "g string, i int, n int"), ["i"], "n", 10, "g").collect()
    for g in ("a", None):
        assert [r.batch for r in sorted((r for r in out if r.g == g), key=lambda r: r.i)] == [0, 0, 1, 2, 3, 4, 4, 5]


def test_asof_join(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 5, 3), (None, 5, 4)], "k string, t int, x int")
    right = spark.createDataFrame([("a", 2, 10), ("a", 5, 11), ("a", 5, 12), ("a", 6, 13)], "k string, t int, v int")
    assert {r.x: r.value for r in joins.asof_join(left, right, "k", "t", "v").collect()} == {1: 12, 2: None, 3: None, 4: None}
    with pytest.raises(ValueError):
        joins.pairwise_diff(spark.range(joins.MAX_PAIRED + 1).selectExpr("id", "array('a') AS lw", "array('b') AS rw"))

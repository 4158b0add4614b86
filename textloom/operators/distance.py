"""Compression distance: language filters, redundancy, clustering. Sizes are those of LZ4 blocks with a
four-byte length, by pyarrow; pandas UDFs, since no built-in function compresses."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Files that a distance matrix is made of at most, since it is quadratic and its clustering sequential.
MAX_FILES = 2000


def size(data: bytes) -> int:
    return len(pa.compress(data, codec="lz4_raw", asbytes=True)) + 4 if data else 4


def ncd(a: bytes, b: bytes) -> float:
    """C(ab) / (C(a) + C(b)); 1 if either is empty."""
    return size(a + b) / (size(a) + size(b)) if a and b else 1.0


def _utf8(x) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x or b"")


def _sizes(x: pd.Series) -> pd.Series:
    return x.map(lambda v: size(_utf8(v)))


def _ncds(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ncd(_utf8(x), _utf8(y)) for x, y in zip(a, b, strict=True)], dtype=float)


def compressed_size(x) -> Column:
    return pandas_udf(_sizes, T.LongType())(x)


def compression_distance(a, b) -> Column:
    return pandas_udf(_ncds, T.DoubleType())(a, b)


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order: str = "doc_id", per_lang: int = 12, max_bytes: int = 20_000, sparsity: int = 1) -> dict[str, bytes]:
    """The first max_bytes of the first per_lang texts of each language, each sparsity-th byte block of 64:
    a bounded sample that languages are told by."""
    out = {}
    for (lang,) in sorted(docs.select(lang_col).filter(F.col(lang_col).isNotNull()).distinct().collect()):
        rows = docs.filter(F.col(lang_col) == lang).orderBy(order, text_col).select(F.substring(text_col, 1, max_bytes)).limit(per_lang).collect()
        data = "\n".join(r[0] or "" for r in rows).encode()[:max_bytes]
        out[lang] = b"".join(data[i : i + 64] for i in range(0, len(data), 64 * sparsity))
    return out


def confidences(text: bytes, refs: dict[str, bytes], sizes: dict[str, int]) -> list[tuple[str, float]]:
    """(language, confidence), best first: how much a reference helps to compress a text, in relation to
    the reference that helps least, weighted by the references' sizes."""
    own = size(text)
    ratios = {k: size(r + text) / (sizes[k] + own) for k, r in refs.items()}
    worst, mean = max(ratios.values()), sum(sizes.values()) / len(sizes)
    base = 1 - worst
    conf = {k: (1 - v) / base * sizes[k] / mean if base else float("inf") for k, v in ratios.items()}
    return sorted(conf.items(), key=lambda x: (-x[1], x[0]))


def with_languages(df: DataFrame, refs: dict[str, bytes], col: str = "text", top_n: int = 5) -> DataFrame:
    """Adds `languages`, an array of (lang, confidence), best first."""
    sizes = {k: size(r) for k, r in refs.items()}

    @pandas_udf("array<struct<lang:string,confidence:double>>")
    def guess(x: pd.Series) -> pd.Series:
        return x.map(lambda v: [{"lang": k, "confidence": c} for k, c in confidences(_utf8(v), refs, sizes)[:top_n]])

    return df.withColumn("languages", guess(F.col(col)))


def langfilter(df: DataFrame, refs: dict[str, bytes], desired: str, col: str = "text", also: tuple[str, ...] = (), top_n: int = 5, min_confidence: float = 2.0, confidence_ratio: float | None = None) -> DataFrame:
    """Rows in a desired language: among the top_n with a confidence above min_confidence, or, with a
    ratio, first and that much above the second."""
    want = F.array(*(F.lit(x) for x in (desired, *also)))
    x = with_languages(df, refs, col, max(top_n, 2))
    if confidence_ratio is None:
        keep = F.exists("languages", lambda g: F.array_contains(want, g["lang"]) & (g["confidence"] > min_confidence))
    else:
        first, second = F.get("languages", F.lit(0)), F.get("languages", F.lit(1))
        keep = F.array_contains(want, first["lang"]) & (first["confidence"] > min_confidence) & (second.isNull() | (first["confidence"] > second["confidence"] * confidence_ratio))
    return x.filter(keep).drop("languages")


def langdetect(df: DataFrame, refs: dict[str, bytes], col: str = "text") -> DataFrame:
    """Adds `detected`, JSON [{language_name, likelihood}], least likely first."""
    sizes = {k: size(r) for k, r in refs.items()}
    total = sum(sizes.values())

    @pandas_udf("array<struct<language_name:string,likelihood:double>>")
    def guess(x: pd.Series) -> pd.Series:
        def one(v):
            v = _utf8(v)
            own = size(v)
            conf = {k: (1 - size(r + v) / (sizes[k] + own)) * sizes[k] / total for k, r in refs.items()}
            return [{"language_name": k, "likelihood": c} for k, c in sorted(conf.items(), key=lambda y: (y[1], y[0]))]

        return x.map(one)

    return df.withColumn("detected", F.to_json(guess(F.col(col))))


def ncd_matrix(files: DataFrame, path: str = "path", content: str = "content", prefix: int = 200_000) -> DataFrame:
    """(i, j, d) for all pairs i <> j of at most MAX_FILES files, on their first `prefix` characters."""
    n = files.count()
    if n > MAX_FILES:
        raise ValueError(f"{n} files; a matrix of pairs is made for up to {MAX_FILES}")
    f = files.select(F.col(path).alias("p"), F.substring(content, 1, prefix).alias("c"))
    a, b = f.select(F.col("p").alias("i"), F.col("c").alias("ci")), f.select(F.col("p").alias("j"), F.col("c").alias("cj"))
    return a.join(b, F.col("i") != F.col("j")).select("i", "j", compression_distance("ci", "cj").alias("d"))


def _matrix(distances: DataFrame) -> tuple[list, np.ndarray]:
    rows = distances.toPandas()
    names = sorted(set(rows["i"]) | set(rows["j"]))
    at = {n: k for k, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    m[rows["i"].map(at), rows["j"].map(at)] = rows["d"]
    return names, m


def kmedoids(distances: DataFrame, k: int, seed: int = 0, rounds: int = 100) -> tuple[dict, float, int]:
    """({name: medoid}, loss, iterations) by swapping medoids while that lowers the loss, from a seeded start."""
    names, m = _matrix(distances)
    med = list(np.random.RandomState(seed).choice(len(names), min(k, len(names)), replace=False))
    loss, it = m[:, med].min(1).sum(), 0
    for it in range(1, rounds + 1):  # noqa: B007
        best = (loss, None, None)
        for s in range(len(med)):
            rest = m[:, med[:s] + med[s + 1 :]].min(1) if len(med) > 1 else np.full(len(names), np.inf)
            sums = np.minimum(rest[:, None], m).sum(0)
            x = int(sums.argmin())
            if sums[x] < best[0] - 1e-12:
                best = (sums[x], s, x)
        if best[1] is None:
            break
        loss, med[best[1]] = best[0], best[2]
    of = np.array(med)[m[:, med].argmin(1)] if names else []
    return {n: names[c] for n, c in zip(names, of, strict=True)}, float(loss), it


def reassign_worst(distances: DataFrame, clusters: dict, rounds: int = 1000) -> dict:
    """Moves, as long as it helps, the member that fits its cluster worst to where its mean distance is least."""
    names, m = _matrix(distances)
    of = np.array([sorted(set(clusters.values())).index(clusters[n]) for n in names])
    for _ in range(rounds):
        mean = np.stack([m[:, of == c].sum(1) / np.maximum((of == c).sum() - (of == c), 1) for c in range(of.max() + 1)], 1)
        own = mean[np.arange(len(of)), of]
        gain = own - mean.min(1)
        x = int(gain.argmax())
        if gain[x] <= 1e-12:
            break
        of[x] = int(mean[x].argmin())
    return {n: int(c) for n, c in zip(names, of, strict=True)}


def redundancy(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds `value`: bytes over compressed bytes, in relation to the mean of all files."""
    x = files.withColumn("__r", F.octet_length(content) / compressed_size(content))
    mean = x.agg(F.avg("__r").alias("__m"))
    return x.crossJoin(F.broadcast(mean)).withColumn("value", F.try_divide("__r", "__m")).drop("__r", "__m")  # one row


def _chunks(data: bytes, chunk: int) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + chunk)
        cut = data.rfind(b"\n", at + 1, end)
        if end < len(data) and cut > at:
            end = cut + 1
        out.append(data[at:end])
        at = end
    return out


def diversify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_size: int = 512, max_consider: int = 1000) -> DataFrame:
    """(doc_id, chunk_no, redundancy): for each chunk of a text, how well it compresses with the rest of it."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                parts = _chunks(_utf8(t), chunk_size)[:max_consider]
                whole = b"".join(parts)
                at = 0
                for k, p in enumerate(parts):
                    rest = whole[:at] + whole[at + len(p) :]
                    at += len(p)
                    rows.append((d, k, size(rest + p) / (size(rest) + size(p))))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "redundancy"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, chunk_no long, redundancy double")

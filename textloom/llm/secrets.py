"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

DataFrame operations only. Every part of a text that has the form of a key, a token or an assigned
password is a candidate, however many there are between two blanks. Each candidate is described by its
length, character transitions and classes, the share of it that dictionary words cover, the path it was
found under and the words before and after it; a random forest trained on labelled findings decides.
The dictionary is that of the corpus itself: the words that one in `RARITY` documents holds.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import Stored, small, table

#: What a candidate's value looks like: an access key, an assigned value, or a long run with a digit.
VALUE = r"(AKIA[0-9A-Z]{12,}|[A-Za-z0-9+/_\-]{16,}={0,2})"
#: The name that a value is assigned to; the value, which may hold further names, is only looked at.
NAME, TO = r"(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|auth)[\"']?\s*[:=]+\s*[\"']?", r"[^\s\"',;]{6,}"
ASSIGNED = rf"(?i){NAME}{TO}"
KEYWORD = r"(?i)(pass(word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)"
HARMLESS = r"(?i)(^|[\s\"'])(example|sample|dummy|fake|test|commit|sha1|sha256|md5|checksum|hash|uuid|version|placeholder|your)([\s:=\"']|$)"
PATH = r"(?i)(test|example|sample|doc|fixture|mock)"
#: Words of code and configuration, which join the words of the corpus in the dictionary.
CODE_WORDS = ["password", "changeme", "placeholder", "username", "handler", "service", "request", "example", "default", "controller", "manager", "factory", "value", "token", "secret", "config", "client", "server", "string", "number", "index", "admin", "hello", "world", "image", "thumb", "model", "table", "from", "with", "user", "test", "your", "here", "name", "data", "file", "page", "item"]
#: A dictionary word stands in one of so many documents at least, and has so many letters. So the dictionary
#: has at most RARITY times the mean number of different words in a document, however large the corpus.
RARITY, LETTERS = 1000, (4, 12)
FEATURES = ["length", "transitions", "digits", "uppers", "distinct", "hex", "covered", "vowels", "keyword", "harmless", "keyword_after", "harmless_after", "word_before", "word_after", "path", "prefix"]
#: Characters after a candidate that its next words are looked for in.
NEAR = 120
#: Labelled findings that a forest is trained on at most.
MAX_FINDINGS = 5000


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): the words a-z of the documents, lower-cased, that one in RARITY of them holds, and two at
    least, with the number of documents; code words are there in any case.

    Null and empty texts have no words; very long texts are read in whole; repeated rows count each. An
    empty table leaves the code words. Other columns are not looked at.
    """
    low, high = LETTERS
    words = F.split(F.lower(text_col), r"[^\p{L}]+")
    fits = lambda w: F.length(w).between(low, high) & w.rlike("^[a-z]+$")
    held = docs.select(F.explode(F.filter(F.array_distinct(words), fits)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    least = max(2, -(-docs.count() // RARITY))
    code = docs.sparkSession.createDataFrame([(w,) for w in CODE_WORDS], "word string").withColumn("n", F.lit(0).cast("long"))
    return held.filter(F.col("n") >= least).unionByName(code).groupBy("word").agg(F.max("n").alias("n"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(doc_id, start, value, before, after, path): start counts code points in the text, before is the three
    words in front of the candidate with what its own word has before the value, after what follows it,
    up to the third word.

    Null or empty texts have no candidates; very long texts are searched in whole. Repeated rows: each has
    its own. Null ids and paths are taken along, the path as an empty one. Other columns are not looked
    at. An empty table has none.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), path.alias("path"))
    rows = rows.filter(F.col("text").rlike(ASSIGNED) | (F.col("text").rlike("[0-9]") & F.col("text").rlike(VALUE)))
    every = lambda pattern, k: F.regexp_extract_all("text", F.lit(pattern), F.lit(k))
    upto = lambda xs: F.transform(xs, lambda _, i: F.aggregate(F.slice(xs, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x))
    # with what lies before each match, since its place is the sum of the lengths so far;
    # \G, or the text after the last match would be gone through from each of its places
    named = rf"(?i)\G([\s\S]*?)({NAME})(?=({TO}))"
    rows = rows.withColumns({"skip": every(named, 1), "name": every(named, 2), "to": every(named, 3)})
    rows = rows.withColumn("step", F.zip_with("skip", "name", lambda x, y: F.length(x) + F.length(y))).withColumn("at", upto(F.col("step")))
    # an assigned value ends where the next name begins, or before the next part of a URL's query
    ahead = lambda i: F.coalesce(F.length(F.get("skip", i + 1)), F.length(F.get("to", i)))
    value = lambda x, i: F.regexp_replace(F.substring(x, F.lit(1), ahead(i)), r"(?s)&[\w.\-]+=.*$", "")
    rows = rows.withColumn("to", F.transform("to", value))
    rows = rows.withColumn("assigned", F.filter(F.zip_with("at", "to", lambda i, x: F.struct(i.alias("i"), x.alias("v"))), lambda s: F.length(s["v"]) >= 6))
    run = rf"\G([\s\S]*?){VALUE}"
    rows = rows.select("doc_id", "path", "text", "assigned", every(run, 1).alias("skip"), every(run, 2).alias("v"))
    rows = rows.withColumn("step", F.zip_with("skip", "v", lambda x, y: F.length(x) + F.length(y))).withColumn("at", upto(F.col("step")))
    plain = F.zip_with("at", "v", lambda i, x: F.struct((i - F.length(x)).alias("i"), x.alias("v")))
    plain = F.filter(plain, lambda s: s["v"].rlike("[0-9]") & ~F.array_contains(F.col("assigned.i"), s["i"]))
    rows = rows.select("doc_id", "path", F.translate("text", "\t\r\n", "   ").alias("flat"), F.explode(F.concat("assigned", plain)).alias("hit"))
    before = F.substring_index(F.substring("flat", F.lit(1), F.col("hit.i")), " ", -4)
    after = F.substring_index(F.substring("flat", F.col("hit.i") + F.length("hit.v") + 1, F.lit(NEAR)), " ", 4)
    return rows.select("doc_id", F.col("hit.i").cast("long").alias("start"), F.col("hit.v").alias("value"), before.alias("before"), after.alias("after"), "path")


def _coverage(found: DataFrame, known: DataFrame) -> DataFrame:
    """(value, covered): the characters of each different value that dictionary words in its letter runs cover."""
    low, high = LETTERS
    values = found.select("value").distinct().withColumn("low", F.lower("value"))
    starts = values.filter(F.length("low") >= low).select("value", "low", F.explode(F.sequence(F.lit(1), F.length("low") - low + 1)).alias("at"))
    # the letters from each place on are looked at once, and tried in all lengths
    starts = starts.select("value", "at", F.regexp_extract(F.substring("low", F.col("at"), F.lit(high)), "^[a-z]*", 0).alias("run")).filter(F.length("run") >= low)
    tries = starts.select("value", "at", "run", F.explode(F.sequence(F.lit(low), F.length("run"))).alias("size"))
    hits = tries.withColumn("word", F.substring("run", F.lit(1), F.col("size"))).join(known.select("word"), "word", "left_semi")
    longest = hits.groupBy("value", "at").agg(F.max("size").alias("size"))
    places = longest.select("value", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("at"))
    return places.groupBy("value").agg(F.countDistinct("at").alias("covered"))


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the columns of FEATURES, all double, to rows with value, before, after and path; words: the dictionary."""
    known = small(words.select("word"))
    flagged = lambda c: known.select(F.col("word").alias(f"_{c}"), F.lit(1.0).alias(c))
    last = F.regexp_extract(F.lower(F.trim("before")), r"(?:^|\s)([a-z]+)[.,;:!?]*$", 1)
    first = F.regexp_extract(F.lower("after"), r"^[\s.,;:!?)]*([a-z]+)", 1)
    found = found.withColumns({"_word_before": last, "_word_after": first})
    found = found.join(_coverage(found, known), "value", "left")
    for c in ("word_before", "word_after"):
        found = found.join(flagged(c), f"_{c}", "left").drop(f"_{c}")
    v = F.col("value")
    n = F.greatest(F.length(v), F.lit(1))
    count = lambda r: F.regexp_count(v, F.lit(r))
    classes = F.translate(v, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    features: dict[str, Column] = {
        "length": F.length(v),
        "transitions": (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / n,
        "digits": count("[0-9]") / n,
        "uppers": count("[A-Z]") / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "hex": flag(v.rlike("^[0-9a-f]+$") & v.rlike("[a-f]")),
        "covered": F.col("covered") / n,
        "vowels": count("(?i)[aeiou]") / n,
        "keyword": flag(F.col("before").rlike(KEYWORD)),
        "harmless": flag(F.col("before").rlike(HARMLESS)),
        "keyword_after": flag(F.col("after").rlike(KEYWORD)),
        "harmless_after": flag(F.col("after").rlike(HARMLESS)),
        "word_before": F.col("word_before"),
        "word_after": F.col("word_after"),
        "path": flag(F.col("path").rlike(PATH)),
        "prefix": flag(v.rlike("^AKIA[A-Z0-9]{16}$")),
    }
    return found.withColumns({k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in features.items()})


def labelled_findings(words: DataFrame, n: int = 4800) -> DataFrame:
    """(value, before, after, path, label): findings with labels by construction; half are secrets.

    Stands in for a table of reviewed findings: keys, hex and base64 tokens and passwords, against
    placeholders, identifiers, digests, numbers and words. What a finding is decides its label; the words
    around it, taken from the dictionary, only lean to one side, so that no single one of them tells: a
    third of the keys stand in plain prose, and a part of the harmless values after a name like `token`.
    """
    common = [r.word for r in words.orderBy(F.desc("n"), "word").limit(200).collect()]
    h = lambda k: F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")), 256)
    b64 = lambda k: F.base64(F.unhex(h(k)))
    alnum = lambda k: F.regexp_replace(b64(k), "[^A-Za-z0-9]", "")
    pick = lambda xs, k: F.get(F.array(*(F.lit(x) for x in xs)), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(xs))).cast("int"))
    word = lambda k: pick(common, k)
    prose = lambda k: F.concat(word(k), F.lit(" "), word(k + 1), pick([" ", ", ", ". "], k + 2))
    named = lambda k: F.concat(word(k), F.lit(" "), pick(["password=", "secret: ", "token = \"", "api_key=", "export ACCESS_KEY=", "auth: "], k + 1))
    digest = lambda k: F.concat(word(k), F.lit(" "), pick(["commit ", "sha1 ", "md5: ", "checksum ", "uuid ", "version "], k + 1))
    sample = lambda k: F.concat(pick(["example ", "fake ", "dummy ", "your ", "sample "], k), pick(["token: ", "password=", "secret: "], k + 1))
    # each context as often as its number says, of ten
    mixed = lambda k, **share: F.get(F.array(*(c for c, n in zip((named(k), prose(k + 10), digest(k + 20), sample(k + 30)), (share.get(x, 0) for x in ("named", "prose", "digest", "sample")), strict=True) for _ in range(n))), F.pmod(F.xxhash64("id", F.lit(k + 40)), F.lit(10)).cast("int"))
    path = pick(["src/app", "deploy", "docs/guide", "", "wiki", "tests/unit"], 900)
    camel = F.concat(word(50), F.initcap(word(51)), F.initcap(word(52)), pick(["Handler", "Config", "2", "List3"], 53))
    kinds: list[tuple[int, Column, Column, Column]] = [
        (1, F.concat(F.lit("AKIA"), F.substring(F.upper(F.translate(h(1), "018e", "QXZK")), 1, 16)), mixed(100, named=6, prose=4), path),
        (1, F.substring(h(2), 1, 40), mixed(200, named=10), path),
        (1, F.substring(h(3), 1, 18), mixed(300, named=10), path),
        (1, F.substring(alnum(4), 1, 32), mixed(400, named=7, prose=3), path),
        (1, b64(5), mixed(500, named=7, prose=3), path),
        (0, F.concat(camel, F.lit("1")), mixed(600, named=3, prose=7), path),
        (0, F.concat(word(54), pick(["_", "-"], 55), word(56), F.lit("123")), mixed(700, named=4, prose=6), path),
        (0, F.substring(h(6), 1, 40), mixed(800, digest=7, prose=3), path),
        (0, F.concat(F.lit("4"), F.substring(F.regexp_replace(F.concat(h(7), h(17)), "[^0-9]", ""), 1, 15)), mixed(1000, prose=9, digest=1), path),
        (0, F.substring(alnum(8), 1, 24), mixed(1100, sample=10), pick(["tests/fixture", "docs/example"], 57)),
        (0, F.concat(word(58), word(59), word(60), word(61), F.lit("1")), mixed(1200, prose=8, named=2), path),
        (0, F.concat(F.lit("https//"), word(62), F.lit("-"), F.substring(h(9), 1, 8), F.lit("/page-2")), mixed(1300, prose=10), path),
    ]
    after = pick(["\" ", " ", ", ", "; ", "\"} "], 901)
    rows = words.sparkSession.range(0, n, 1, 2)
    # the five kinds of secrets come as often as the seven others together
    order = [0, 1, 2, 3, 4, 0, 1, 2, 3, 4, 1, 2, *range(5, 12), 5, 6, 7, 8, 9]
    kind = F.pmod(F.col("id"), F.lit(len(order)))
    choose = lambda field: F.get(F.array(*(F.lit(kinds[k][field]) if field == 0 else kinds[k][field] for k in order)), kind.cast("int"))
    return rows.select(choose(1).alias("value"), choose(2).alias("before"), F.concat(after, word(902), F.lit(" "), word(903)).alias("after"), choose(3).alias("path"), choose(0).cast("double").alias("label"))


def train(findings: DataFrame, words: DataFrame, trees: int = 24, depth: int = 7, seed: int = 7) -> RandomForestClassificationModel:
    """A random forest over labelled findings (value, before, after, path, label 0/1); words: the dictionary.

    At most MAX_FINDINGS rows, chosen by hash, are used. Rows with a null value or label are left out;
    other nulls are empty. Repeated rows count each; other columns are not looked at. An empty table
    can't be learnt from and raises an error.
    """
    around = ["before", "after", "path"]
    rows = findings.filter("value IS NOT NULL AND label IS NOT NULL").select("value", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in around), F.col("label").cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("value", *around, "label"), "value", *around, "label").limit(MAX_FINDINGS)
    # the forest reads its few rows many times, and in one order
    rows = Stored(findings.sparkSession).keep(with_features(rows, words).select(*FEATURES, "label").coalesce(1).sortWithinPartitions(*FEATURES, "label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features", cacheNodeIds=False).fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))


def scan(docs: DataFrame, model: RandomForestClassificationModel, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, length, value_sha256, score, secret): a row for each candidate of each document.

    The value itself is not repeated. Null or empty texts have no candidates; very long texts are searched
    in whole. Repeated rows: each has its own. Null ids and paths are taken along. Other columns are not
    looked at. Empty table: empty result.
    """
    found = Stored(docs.sparkSession).keep(candidates(docs, id_col, text_col, path_col))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(with_features(found, words))
    score = F.round(F.get(vector_to_array("probability"), 1), 6)
    return model.transform(rows).select("doc_id", "start", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), score.alias("score"), (score >= threshold).alias("secret"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts, against the dictionary of all documents."""
    docs = table(spark, sf_dir, "documents")
    words = Stored(spark).keep(dictionary(docs))
    return scan(docs, train(labelled_findings(words), words), words)

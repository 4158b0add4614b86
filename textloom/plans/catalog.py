"""A query for each operator over the whole tables, and the same in DuckDB's SQL where that can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import units as U
from ..operators import aggregate as A
from ..operators import cover as C
from ..operators import distance as D
from ..operators import filters as FI
from ..operators import joins as J
from ..operators import mining as M
from ..operators import project as P
from ..operators import rank as R
from ..sources import files as S
from ..streaming import streams as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
IDS = ["doc_id", "line_no"]

LINES = "lines AS (SELECT doc_id, unnest(range(len(s))) AS line_no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"
PAIRS = "pairs AS (SELECT conv_id * 1000 + turn AS id, replace(text, chr(10), ' ') AS l, replace(reply, chr(10), ' ') AS r FROM (SELECT *, lead(role) OVER w AS nxt, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nxt = 'assistant')"
WORD = r"[\p{L}\p{N}_]+(?:[''.][\p{L}\p{N}_]+)*"
PUNCT = r"[!-/:-@\[-`{-~]"


def words_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD}')"


def cased_sql(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}')"


def cleaned_sql(x: str, least: int = 1) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^\\p{{L}}\\s]', '', 'g'), '\\s+'), lambda w: strlen(w) >= {least})"


def count_sql(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{pattern}')) AS BIGINT)"


def once_sql(x: str) -> str:
    return f"len(list_filter({x}, lambda w, i: i = 1 OR w <> ({x})[i - 1]))"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return U.lines(t(spark, d, "documents"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return U.pairs(t(spark, d, "conversations"))


def md5(x):
    return F.md5(U.c(x))


# ---- sources


@query(f"WITH {LINES} SELECT doc_id, line_no, CAST(strlen(line) AS BIGINT) AS bytes, md5(line) AS digest FROM lines WHERE line <> ''")
def scan_lines(spark, d):
    return lines(spark, d).filter("line <> ''").select(*IDS, U.n_bytes("line").alias("bytes"), md5("line").alias("digest"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CAST(length(text) AS BIGINT) AS chars FROM documents")
def scan_whole(spark, d):
    return t(spark, d, "documents").select("doc_id", U.n_bytes("text").alias("bytes"), U.n_chars("text").alias("chars"))


@query("SELECT source AS path, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def scan_dir(spark, d):
    return t(spark, d, "documents").groupBy(F.col("source").alias("path")).agg(F.count("*").alias("files"), F.sum(U.n_bytes("text")).alias("bytes"))


@query("SELECT source AS path, count(*) AS files FROM documents WHERE contains(source, '1') GROUP BY source")
def scan_dir_recursive(spark, d):
    x = t(spark, d, "documents").select(F.col("source").alias("path"))
    return x.filter(F.contains("path", F.lit("1"))).groupBy("path").agg(F.count("*").alias("files"))


@query("SELECT page_id, CAST(least(strlen(html), 1000) AS BIGINT) AS bytes FROM pages")
def scan_file_prefix(spark, d):
    return S.prefix(t(spark, d, "pages").withColumnRenamed("html", "content"), 1000).select("page_id", F.octet_length("content").cast("long").alias("bytes"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def scan_markup(spark, d):
    return S.markup_text(t(spark, d, "pages"), "html").select("page_id", md5("html").alias("digest"))


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id")
def kv_put(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return S.kv_put(e.filter("seq % 2 = 0"), e.filter("seq % 2 = 1")).select("key", "value")


@query("WITH kv AS (SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id) SELECT c_custkey AS key, coalesce(value, 'Not found') AS value FROM customer LEFT JOIN kv ON key = c_custkey")
def kv_get(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return S.kv_get(S.kv_put(e.limit(0), e), t(spark, d, "customer").select(F.col("c_custkey").alias("key")))


@query("SELECT DISTINCT user_id AS key FROM events")
def kv_list(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return S.kv_list(S.kv_put(e.limit(0), e))


@query("SELECT event_type AS bucket, user_id AS key, arg_max(props, event_id) AS value FROM events JOIN customer ON c_custkey = user_id GROUP BY ALL")
def kv_bucket(spark, d):
    e = t(spark, d, "events").select(F.col("event_type").alias("bucket"), F.col("user_id").alias("key"), F.col("props").alias("value"), F.col("event_id").alias("seq"))
    asked = e.join(t(spark, d, "customer").select(F.col("c_custkey").alias("key")), "key").select("bucket", "key").distinct()
    return S.kv_get(S.kv_put(e.limit(0), e, "bucket"), asked, bucket="bucket")


@query("""WITH q AS (SELECT event_id AS seq, user_id AS key, CASE WHEN event_id % 3 <> 0 THEN event_type END AS value FROM events),
 l AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM q)
 SELECT seq, last IS NOT NULL AS was_success, CASE WHEN last IS NULL THEN 'not found' END AS err, CASE WHEN value IS NULL THEN last END AS val FROM l""")
def kv_requests(spark, d):
    e = t(spark, d, "events")
    q = e.select(F.col("event_id").alias("seq"), F.to_json(F.struct(F.col("user_id").cast("string").alias("key"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("value"))).alias("request"))
    return S.kv_requests(q)


@query("SELECT p_partkey, 'Part: ' || p_name || ' / brand ' || p_brand || ' ->' AS prompt FROM part")
def prompts(spark, d):
    return t(spark, d, "part").select("p_partkey", S.prompt("Part: {p_name} / brand {p_brand} ->", "p_name", "p_brand").alias("prompt"))


# ---- projections


def _clean_sql(keep: str, low: bool) -> str:
    x = rf"regexp_replace(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '[^{keep}]', ' ', 'g'), '(\s)\s+', '\1', 'g')"
    return rf"WITH {LINES} SELECT doc_id, line_no, md5(line) AS digest FROM (SELECT doc_id, line_no, {f'lower({x})' if low else x} AS line FROM lines) WHERE strlen(line) > 1"


@query(_clean_sql(r"\p{L}\s\p{N}!-/:-@\[-`{-~", False))
def clean(spark, d):
    return P.clean(lines(spark, d)).select(*IDS, md5("line").alias("digest"))


@query(_clean_sql(r"\p{L}\s", True))
def clean_strict(spark, d):
    return P.clean(lines(spark, d), no_punctuation=True, no_numbers=True, lowercase=True).select(*IDS, md5("line").alias("digest"))


@query("SELECT c_custkey AS id, c_mktsegment || '|' || c_custkey || '|' || c_mktsegment AS line FROM customer")
def dicer(spark, d):
    x = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("\t", "c_custkey", "c_name", "c_mktsegment").alias("line"))
    return P.dicer(x, [2, 0, 2], newsep="|")


@query("SELECT c_custkey AS id, c_mktsegment || chr(9) || c_custkey || chr(9) || c_name || chr(9) || c_name || chr(9) || c_mktsegment AS line FROM customer")
def column_spec(spark, d):
    x = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("\t", "c_custkey", "c_name", "c_mktsegment").alias("line"))
    return P.select_columns(x, "2 ..2 1..")


#: Fixed values, by code point.
_DELIM = "!\\?\\.\u00a1\u00bf\u037e\u055c\u055e\u061f\u06d4\u0700\u0701\u0702\u07f9\u109f\u1362\u1367\u1368\u166e\u1803\u1809\u1944\u203c\u2047\u2048\u2049\u225f\u2370\u2e2e\u3002\ua4ff\ua60e\ua60f\uff61"


@query(f"""WITH {LINES}, s AS (SELECT doc_id, line_no, unnest(string_split(regexp_replace(line, '([{_DELIM}])', '\\1' || chr(1), 'g'), chr(1))) AS sentence FROM lines)
 SELECT doc_id, line_no, sentence FROM s WHERE strlen(sentence) > 1 AND NOT contains(sentence, ' .')""")
def sentences(spark, d):
    return P.sentences(lines(spark, d)).select(*IDS, "sentence")


@query(f"""WITH {LINES}, s AS (SELECT doc_id, line_no, unnest(string_split(regexp_replace(line, '([{_DELIM}])', '\\1' || chr(1), 'g'), chr(1))) AS sentence FROM lines)
 SELECT doc_id, line_no, sentence FROM s WHERE strlen(sentence) > 20 AND NOT contains(sentence, ' .') AND regexp_matches(regexp_extract(sentence, '\\p{{L}}'), '^\\p{{Lu}}') AND NOT regexp_matches(sentence, '[\\p{{L}}\\p{{N}}]$')""")
def sentences_strict(spark, d):
    return P.sentences(lines(spark, d), reject_uncapitalized=True, reject_unpunctuated=True, min_length=20).select(*IDS, "sentence")


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\n', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM documents)
 SELECT doc_id, count(*) AS n, CAST(sum(length(sentence)) AS BIGINT) AS chars FROM s WHERE sentence <> '' GROUP BY doc_id""")
def sentence_seg(spark, d):
    return P.sentence_seg(t(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(U.n_chars("sentence")).alias("chars"))


@query(f"WITH {LINES} SELECT doc_id, line_no, md5(replace(strip_accents(line), 'ß', 'ss')) AS digest FROM lines")
def ascii_lines(spark, d):
    return P.ascii_only(lines(spark, d)).select(*IDS, md5("line").alias("digest"))


@query("SELECT n_nationkey, CASE n_name WHEN 'CHINA' THEN 'zhong1-guo2' WHEN 'JAPAN' THEN 'ri4-ben3' ELSE n_name END AS pinyin FROM nation")
def pinyin(spark, d):
    words = spark.range(2).select(F.when(F.col("id") == 0, "CHINA").otherwise("JAPAN").alias("word"), F.when(F.col("id") == 0, F.array(F.lit("zhong1"), F.lit("guo2"))).otherwise(F.array(F.lit("ri4"), F.lit("ben3"))).alias("syllables"))
    return P.pinyin(t(spark, d, "nation"), words, "n_name").select("n_nationkey", "pinyin")


#: What a pattern adds to the syllables of a word.
_SYLLABLES = [(1, "[aeiuo]+"), (1, "[dlmnrstz]y"), (-1, "[aiou][b-df-hj-np-rs-v-z]e"), (1, "[aiou][cs]es"), (-1, "aste"), (-1, "apse"), (1, "[^b-df-hj-np-tv-z]ted$"), (-1, "e[rsvy]e"), (1, "d[nv]"), (-1, "elve[^t]"), (1, "eing")]


def _syllables_sql(x: str) -> str:
    w = rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', '', 'g')"
    return "greatest(0, " + " + ".join(f"({k}) * {count_sql(w, p)}" for k, p in _SYLLABLES) + ")"


@query(f"WITH {LINES}, w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(line), '[^\\p{{L}}]+'), lambda x: x <> '')) AS word FROM lines) SELECT word, CAST({_syllables_sql('word')} AS BIGINT) AS syllables FROM w")
def syllables(spark, d):
    return A.frqlist(lines(spark, d)).select("word", P.syllables("word").alias("syllables"))


@query(f"WITH {LINES} SELECT doc_id, line_no, md5(regexp_replace(lower(line), '[^\\p{{L}}\\s]', '', 'g')) AS digest FROM lines")
def normalize_line(spark, d):
    return lines(spark, d).select(*IDS, md5(P.normalize_line("line")).alias("digest"))


@query(f"""WITH {LINES}, s AS (SELECT doc_id, line_no, unnest(regexp_split_to_array(line, '[,.;]')) AS s FROM lines), w AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(s, '\\s+'), lambda x: regexp_matches(x, '\\p{{L}}')) AS w FROM s),
 n AS (SELECT doc_id, line_no, w, list_transform(w, lambda x: CAST({_syllables_sql('x')} AS BIGINT)) AS n FROM w), c AS (SELECT doc_id, line_no, w, list_transform(range(1, len(n) + 1), lambda i: CAST(list_sum(n[1:i]) AS BIGINT)) AS c FROM n WHERE list_sum(n) = 17),
 p AS (SELECT *, list_position(c, 5) AS a, list_position(c, 12) AS b FROM c), k AS (SELECT doc_id, line_no, list_transform(w, lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\s]', '', 'g')) AS w, a, b FROM p WHERE a > 0 AND b > 0)
 SELECT doc_id, line_no, array_to_string(w[1:a], ' ') AS first, array_to_string(w[a + 1:b], ' ') AS second, array_to_string(w[b + 1:], ' ') AS third FROM k""")
def haiku(spark, d):
    return P.haiku(lines(spark, d)).select(*IDS, "first", "second", "third")


@query("SELECT p_partkey, regexp_replace(upper(p_name), '[0-9]', '', 'g') AS name FROM part")
def lazy_string(spark, d):
    steps = P.Steps().push("upper", F.upper).push("digits", lambda x: F.regexp_replace(x, "[0-9]", "")).push("reverse", F.reverse).undo()
    return t(spark, d, "part").select("p_partkey", steps.apply(F.col("p_name")).alias("name"))


@query("SELECT c_custkey, upper(c_name) AS c_name FROM customer WHERE c_acctbal > 0")
def defer(spark, d):
    steps = P.Steps().push("positive", lambda x: x.filter("c_acctbal > 0")).push("gone", lambda x: x.limit(0)).push("upper", lambda x: x.withColumn("c_name", F.upper("c_name"))).remove("gone")
    return steps.apply(t(spark, d, "customer")).select("c_custkey", "c_name")


@query("SELECT event_id, json_extract_string(props, '$.k') AS found FROM events")
def json_search(spark, d):
    return P.json_search(t(spark, d, "events"), "props", "$.k").select("event_id", "found")


@query("SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 3 THEN json_extract_string(props, '$.k') END AS found FROM events")
def json_find(spark, d):
    e = t(spark, d, "events").select("event_id", F.concat(F.lit('{"a": [1, {"b": '), "props", F.lit("}]}")).alias("j"))
    return P.json_find(e, "j", "k", "try_cast(value AS bigint) > 3", 4).select("event_id", "found")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN n_nationkey * 10 END AS found FROM nation")
def dot_path(spark, d):
    x = t(spark, d, "nation").select("n_nationkey", F.create_map(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.create_map(F.lit("x"), F.col("n_nationkey") * 10)).alias("m"))
    return P.dot_path(x, "m.r2.x").select("n_nationkey", "found")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size ELSE 7 END AS size, coalesce(p_brand, '') AS brand, CASE WHEN p_size > 25 AND p_size >= 45 THEN 1 ELSE 0 END AS n_errors FROM part")
def partial_record(spark, d):
    x = t(spark, d, "part").select("p_partkey", F.map_from_entries(F.filter(F.array(F.struct(F.lit("size").alias("k"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).alias("v")), F.struct(F.lit("brand").alias("k"), F.col("p_brand").alias("v"))), lambda e: e["v"].isNotNull())).alias("values"))
    x = P.partial_record(x, {"size": ("int", 7, "value < 45"), "brand": ("string", "", None)})
    return x.select("p_partkey", "record.size", "record.brand", F.size("errors").alias("n_errors"))


@query("SELECT p_partkey, CASE WHEN p_size <= 15 THEN 'small' WHEN p_size <= 35 THEN 'middle' ELSE 'large' END AS nearest FROM part")
def nearest_key(spark, d):
    return P.nearest_key(t(spark, d, "part"), {5: "small", 25: "middle", 45: "large"}, "p_size").select("p_partkey", "nearest")


@query("SELECT vec_id, CAST(round(e[1] + e[2] + e[9] + e[10], 4) AS DOUBLE) AS block, 8 AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)")
def matrix_rows(spark, d):
    x = t(spark, d, "embeddings").select("vec_id", P.rows(F.transform("embedding", lambda v: v.cast("double")), 8).alias("m"))
    b = F.get(F.get(P.quadrants("m"), F.lit(0)), F.lit(0))
    return x.select("vec_id", F.round(F.aggregate(b, F.lit(0.0), lambda a, v: a + v), 4).alias("block"), F.size("m").alias("n"))


@query("SELECT vec_id, CASE WHEN e[1] = 0 AND e[2] = 0 AND e[3] = 0 AND e[4] = 0 THEN ' ' WHEN sqrt(((e[1]-1)^2 + (e[2]-1)^2 + e[3]^2 + e[4]^2) / 4) <= sqrt((e[1]^2 + e[2]^2 + (e[3]-1)^2 + (e[4]-1)^2) / 4) THEN '^' ELSE '_' END AS glyph FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)")
def nearest_glyph(spark, d):
    return t(spark, d, "embeddings").select("vec_id", P.nearest_glyph(F.slice("embedding", 1, 4), {"^": [1, 1, 0, 0], "_": [0, 0, 1, 1]}).alias("glyph"))


@query("SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)#(\\d+)', 1) AS maker, regexp_extract(p_brand, '([A-Za-z]+)#(\\d+)', 2) AS number FROM part")
def named_groups(spark, d):
    return P.named_groups(t(spark, d, "part"), r"(?<maker>[A-Za-z]+)#(?<number>\d+)", "p_brand").select("p_partkey", "maker", "number")


# ---- filters


@query(f"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE strlen(line) BETWEEN 20 AND 600 AND len(string_split(line, ' ')) BETWEEN 3 AND 40")
def lengthfilter(spark, d):
    return FI.lengthfilter(lines(spark, d), min_words=3, max_words=40, min_chars=20).select(*IDS)


@query(f"WITH {LINES}, w AS (SELECT doc_id, line_no, list_filter({words_sql('line')}, lambda w: strlen(w) >= 3) AS w FROM lines) SELECT doc_id, line_no FROM w WHERE len(list_distinct(w)) = len(w)")
def norepeat(spark, d):
    return FI.norepeat(lines(spark, d)).select(*IDS)


@query(f"WITH {PAIRS} SELECT id FROM pairs WHERE NOT list_has_any({cleaned_sql('l', 3)}, {cleaned_sql('r', 3)})")
def nosame(spark, d):
    return FI.nosame(pairs(spark, d)).select("id")


def _wordlist(spark, d) -> DataFrame:
    """(rank, word) of the benchmark's words, most frequent first; the list is as large as the benchmark."""
    n = t(spark, d, "benchmark").select(F.explode(U.cleaned_words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return R.global_rank(n, "n", "word", "rank", descending=True).select((F.col("rank") + 1).alias("rank"), "word")


_WORDLIST = f"wl AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS rank FROM (SELECT unnest({cleaned_sql('text')}) AS word FROM benchmark) GROUP BY word)"


@query(f"WITH {LINES}, {_WORDLIST}, u AS (SELECT doc_id, line_no, count(*) AS n FROM (SELECT DISTINCT doc_id, line_no, unnest({cleaned_sql('line')}) AS word FROM lines) x WHERE word NOT IN (SELECT word FROM wl WHERE rank <= 200) GROUP BY ALL HAVING count(*) > 2) SELECT doc_id, line_no FROM lines ANTI JOIN u USING (doc_id, line_no)")
def frqcheck(spark, d):
    return J.known_words(lines(spark, d), _wordlist(spark, d), IDS, truncate=200, max_unknown=2).select(*IDS)


_SOFT = f"((CASE WHEN {count_sql('line', chr(92) + 'p{Lu}')} = 0 THEN 'inf'::DOUBLE ELSE 1.0::DOUBLE / {count_sql('line', chr(92) + 'p{Lu}')} END) + CASE WHEN length(line) = 0 THEN 'nan'::DOUBLE ELSE {count_sql('line', '[' + chr(92) + 'p{L}' + chr(92) + 's]')}::DOUBLE / length(line) END + 1.0::DOUBLE - 1.0::DOUBLE / (1.0::DOUBLE + list_max(list_transform(string_split(line, ' '), lambda w: strlen(w))) - list_min(list_transform(string_split(line, ' '), lambda w: strlen(w))))) / 3"


@query(f"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE line <> '' AND round({_SOFT}, 9) > 0.94")
def softscore(spark, d):
    x = lines(spark, d).filter("line <> ''").withColumn("s", F.round(FI.softscore("line", ["uppercased", "noisy", "word_length_variety"]), 9))
    return x.filter("s > 0.94").select(*IDS)


@query(f"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE {count_sql('line', chr(92) + 'p{Lu}')} < 4 AND length(line) > 0 AND {count_sql('line', '[' + chr(92) + 'p{L}' + chr(92) + 's]')}::DOUBLE / length(line) > 0.95")
def hardscore(spark, d):
    return FI.hard_filter(lines(spark, d).filter("line <> ''"), {"uppercased": 0.2501, "noisy": 0.95}).select(*IDS)


@query("SELECT p_partkey, p_name FROM part WHERE strlen(p_name) > 7 AND NOT ends_with(string_split(p_name, ' ')[1], 's') AND NOT list_bool_or(list_transform(string_split(p_name, ' '), lambda w: regexp_matches(w, '(ed|es|ly|ing)$'))) AND p_retailprice > 1000")
def keyword_filter(spark, d):
    return FI.keyword_filter(t(spark, d, "part"), "p_name", "p_retailprice", 1000).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE strlen(c_custkey || chr(9) || c_mktsegment) > 10")
def valid_pairs(spark, d):
    x = t(spark, d, "customer").select("c_custkey", F.concat_ws("\t", "c_custkey", "c_mktsegment").alias("line"))
    return FI.valid_pairs(x).filter(F.octet_length("line") > 10).select("c_custkey")


@query("SELECT doc_id FROM documents WHERE doc_id % 5 <> 0")
def valid_utf8(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("text").cast("binary"), F.lit(b"\xff"))).otherwise(F.col("text").cast("binary")).alias("b"))
    return FI.valid_utf8(x, "b").select("doc_id")


# ---- joins


@query("SELECT o_orderkey, c_custkey || chr(9) || c_name AS recovered FROM orders JOIN customer ON o_custkey = c_custkey")
def recover(spark, d):
    build = t(spark, d, "customer").select(F.concat_ws("\t", "c_custkey", "c_name").alias("line"), F.col("c_custkey").alias("line_no"))
    probe = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("key"))
    return J.recover(probe, build).select("o_orderkey", "recovered")


_FREQ = f"f AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS rank FROM (SELECT unnest({words_sql('text')}) AS word FROM documents) GROUP BY word)"


def _frequent(spark, d) -> DataFrame:
    n = t(spark, d, "documents").select(F.explode(U.words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "word")


@query(f"""WITH {LINES}, {_FREQ}, w AS (SELECT DISTINCT doc_id, line_no, unnest({words_sql('line')}) AS word FROM lines)
 SELECT doc_id, line_no FROM w LEFT JOIN (SELECT word, rank > 1000 AS want FROM f WHERE rank <= 1100) v USING (word) GROUP BY doc_id, line_no HAVING bool_and(want IS NOT NULL) AND bool_or(coalesce(want, false))""")
def frqcheck_opt(spark, d):
    top = _frequent(spark, d)
    known = top.limit(1000)
    desired = top.limit(1100).join(known.select("word"), "word", "left_anti")
    return J.contained(lines(spark, d), known.select("word"), desired.select("word"), IDS).select(*IDS)


@query(f"""WITH {LINES}, {_FREQ}, k AS (SELECT list(word) AS known FROM f WHERE rank <= 300), r AS (SELECT rank AS request_id, word AS focus FROM f WHERE rank BETWEEN 301 AND 320), l AS (SELECT doc_id, line_no, list_distinct({words_sql('line')}) AS ws FROM lines)
 SELECT request_id, doc_id, line_no FROM r, l, k WHERE list_contains(ws, focus) AND len(list_filter(ws, lambda w: w <> focus AND NOT list_contains(known, w))) = 0""")
def focus_query(spark, d):
    top = _frequent(spark, d).limit(320).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "word")).cast("long"))  # 320 rows
    known = top.filter("rank <= 300").agg(F.collect_list("word").alias("known"))
    requests = top.filter("rank > 300").select(F.col("rank").alias("request_id"), F.col("word").alias("focus")).crossJoin(known)
    return J.focus_queries(lines(spark, d), requests, IDS).select("request_id", *IDS)


@query(f"WITH w AS (SELECT DISTINCT item_id, unnest({words_sql('text')}) AS word FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, count(*) + 1 AS overlap FROM w a JOIN w b ON a.word = b.word AND a.item_id < b.item_id GROUP BY ALL")
def overlap_join(spark, d):
    return J.overlap_join(t(spark, d, "benchmark"), "item_id", U.words("text"))


def _nations(spark, d) -> DataFrame:
    n = t(spark, d, "nation").join(F.broadcast(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    return n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("l"), F.col("r_name").alias("r"))


_NATIONS = "n AS (SELECT n_nationkey AS id, list_distinct(list_filter(string_split(n_name, ' '), lambda w: w <> '')) AS lw, list_distinct(list_filter(string_split(r_name, ' '), lambda w: w <> '')) AS rw FROM nation JOIN region ON n_regionkey = r_regionkey)"
_DIFF = f"""{_NATIONS}, x AS (SELECT list_filter(a.lw, lambda w: NOT list_contains(b.lw, w)) AS dl, list_filter(a.rw, lambda w: NOT list_contains(b.rw, w)) AS dr, list_intersect(a.lw, b.lw) AS sl, list_intersect(a.rw, b.rw) AS sr FROM n a JOIN n b ON a.id < b.id),
 s AS (SELECT unnest(dl) AS p1, dr AS o, 1.0::DOUBLE / (len(dl) * len(dr)) AS w FROM x WHERE len(dl) > 0 AND len(dr) > 0 UNION ALL SELECT unnest(sl), sr, 1.0::DOUBLE / (len(sl) * len(sr)) FROM x WHERE len(sl) > 0 AND len(sr) > 0
 UNION ALL SELECT unnest(dl), sr, -1.0::DOUBLE + 1.0::DOUBLE / (len(dl) + len(sr)) FROM x WHERE len(dl) > 0 AND len(sr) > 0 UNION ALL SELECT unnest(sl), dr, -1.0::DOUBLE + 1.0::DOUBLE / (len(sl) + len(dr)) FROM x WHERE len(sl) > 0 AND len(dr) > 0)"""


@query(f"WITH {_DIFF} SELECT p1, p2, round(sum(w), 6) AS score FROM (SELECT p1, unnest(o) AS p2, w FROM s) GROUP BY ALL")
def pairwise_diff(spark, d):
    x = _nations(spark, d).select("id", U.full_tokens("l").alias("lw"), U.full_tokens("r").alias("rw"))
    return J.pairwise_diff(x).select("p1", "p2", F.round("score", 6).alias("score"))


# ---- aggregates


@query(f"WITH {LINES} SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(line), '[^\\p{{L}}]+'), lambda x: x <> '')) AS word FROM lines) GROUP BY word")
def frqlist(spark, d):
    return A.frqlist(lines(spark, d))


def _ngrams_sql(sizes, compat: bool) -> str:
    parts = " UNION ALL ".join(f"SELECT unnest(list_transform(range(1, len(w) - {n} + {1 if compat else 2}), lambda k: array_to_string(w[k:k + {n - 1}], ' '))) AS ngram FROM w" for n in sizes)
    return f"WITH {LINES}, w AS (SELECT string_split(line, ' ') AS w FROM lines), g AS ({parts}) SELECT ngram, count(*) AS n FROM g GROUP BY ngram HAVING count(*) > 1"


@query(_ngrams_sql(range(1, 4), False))
def ngrams(spark, d):
    return A.ngrams(lines(spark, d), max_size=3, top_n=None)


@query(_ngrams_sql(range(1, 4), True))
def ngrams_compat(spark, d):
    return A.ngrams(lines(spark, d), max_size=4, top_n=None, compat=True)


@query(f"{_ngrams_sql(range(2, 4), False)} ORDER BY n DESC, ngram LIMIT 100")
def ngrams_top(spark, d):
    return A.ngrams(lines(spark, d), min_size=2, max_size=3, top_n=100)


@query("SELECT CAST(sum(len(string_split(text, chr(10))) - 1) AS BIGINT) AS lines, CAST(sum(len(string_split(text, ' ')) - 1) AS BIGINT) AS words, CAST(sum(strlen(text)) AS BIGINT) AS chars FROM documents")
def newlines(spark, d):
    return A.wc(t(spark, d, "documents"))


@query(f"SELECT DISTINCT unnest({words_sql('text')}) AS word FROM documents")
def canslate(spark, d):
    return A.distinct_words(t(spark, d, "documents"), "text")


_WEIGHTS = f"df AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, line_no, unnest({words_sql('line')}) AS word FROM lines) GROUP BY word), wt AS (SELECT word, df, (SELECT sum(df) FROM df) / cbrt(df) AS weight FROM df)"


@query(f"WITH {LINES}, {_WEIGHTS} SELECT word, df, round(weight, 6) AS weight FROM wt")
def doc_freq_weight(spark, d):
    return A.doc_freq_weight(lines(spark, d)).select("word", "df", F.round("weight", 6).alias("weight"))


@query(f"WITH {PAIRS}, p AS (SELECT list_transform(regexp_extract_all(l, '[\\p{{L}}\\p{{N}}]'), lambda x: unicode(x)) AS p FROM pairs) SELECT CAST(sum(list_min(p)) // count(*) AS BIGINT) AS lo, CAST(sum(list_max(p)) // count(*) AS BIGINT) AS hi FROM p")
def charrange(spark, d):
    return A.char_range(pairs(spark, d), "l").select(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({words_sql('text')}) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 500")
def vocabulary(spark, d):
    return A.vocabulary(t(spark, d, "documents"), "text", 500)


@query(f"WITH {LINES}, s AS (SELECT list_distinct({words_sql('line')}) AS s FROM lines) SELECT word, CAST(sum(n) AS BIGINT) AS size FROM (SELECT unnest(s) AS word, len(s) AS n FROM s) GROUP BY word")
def fill_map(spark, d):
    return A.fill_map(lines(spark, d), U.words("line"))


@query("SELECT p_partkey, round(p_retailprice / (SELECT avg(p_retailprice) FROM part), 6) AS rescaled FROM part")
def mean_rescale(spark, d):
    return A.mean_rescale(t(spark, d, "part"), "p_retailprice").select("p_partkey", F.round("rescaled", 6).alias("rescaled"))


@query(f"""WITH RECURSIVE {LINES}, l AS (SELECT doc_id, line_no, strlen(line) + 1 AS n FROM lines),
 b AS (SELECT doc_id, line_no, n AS held, 0 AS batch FROM l WHERE line_no = 0 UNION ALL SELECT l.doc_id, l.line_no, CASE WHEN held > 0 AND held + n >= 1000 THEN n ELSE held + n END, CASE WHEN held > 0 AND held + n >= 1000 THEN batch + 1 ELSE batch END FROM b JOIN l ON l.doc_id = b.doc_id AND l.line_no = b.line_no + 1)
 SELECT doc_id, line_no, CAST(batch AS BIGINT) AS batch FROM b""")
def batch_by_size(spark, d):
    x = lines(spark, d).withColumn("n", U.n_bytes("line") + 1)
    return A.batch_by_size(x, ["line_no"], "n", 1000, "doc_id").select(*IDS, "batch")


# ---- ranking


@query(f"WITH {LINES} SELECT word, n, row_number() OVER (ORDER BY n, word) - 1 AS rank FROM (SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(line), '[^\\p{{L}}]+'), lambda x: x <> '')) AS word FROM lines) GROUP BY word)")
def cardinalise(spark, d):
    return R.cardinalise(A.frqlist(lines(spark, d)))


@query("SELECT user_id, arg_min(event_id, ts) AS event_id FROM (SELECT * FROM events ORDER BY event_id) GROUP BY user_id")
def keep_first(spark, d):
    return R.keep_first(t(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query(f"WITH {LINES} SELECT doc_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS i FROM lines) WHERE i = 1")
def dedup(spark, d):
    return R.dedup(lines(spark, d)).select(*IDS)


@query(f"WITH {LINES} SELECT doc_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(line, '{PUNCT}', '', 'g') ORDER BY doc_id, line_no) AS i FROM lines) WHERE i = 1")
def dedup_nopunct(spark, d):
    return R.dedup(lines(spark, d), no_punct=True).select(*IDS)


@query(f"""WITH {LINES}, w AS (SELECT doc_id, line_no, unnest(list_transform(string_split(line, ' '), lambda w: regexp_replace(w, '{PUNCT}', '', 'g'))) AS word FROM lines),
 r AS (SELECT word, row_number() OVER (ORDER BY count(*), word) - 1 AS rank FROM w GROUP BY word) SELECT doc_id, line_no, max(rank) AS score FROM w JOIN r USING (word) GROUP BY doc_id, line_no""")
def frqsort(spark, d):
    return R.frqsort(lines(spark, d), IDS).select(*IDS, "score")


@query(f"""WITH {LINES}, {_WORDLIST}, {_WEIGHTS}, w AS (SELECT DISTINCT doc_id, line_no, unnest({words_sql('line')}) AS word FROM lines), s AS (SELECT doc_id, line_no, sum(CASE WHEN wl.word IS NOT NULL THEN weight ELSE -weight END) AS score FROM w JOIN wt USING (word) LEFT JOIN wl ON wl.word = w.word GROUP BY ALL)
 SELECT doc_id, line_no, round(coalesce(score, 0), 3) + 0 AS score FROM lines LEFT JOIN s USING (doc_id, line_no)""")
def subset(spark, d):
    return R.subset(lines(spark, d), _wordlist(spark, d), IDS).select(*IDS, (F.round("score", 3) + 0).alias("score"))


def _pair_scores_sql() -> str:
    red = " + ".join(f"{once_sql('w' + s)}::DOUBLE / nullif(len(w{s}), 0)" for s in "lr")
    part = f"1 - {once_sql('list_concat(wl, wr)')}::DOUBLE / nullif(len(wl) + len(wr), 0)"
    non = " + ".join(f"{count_sql(s, '[' + chr(92) + 'p{L}' + chr(92) + 's]')}::DOUBLE / nullif(strlen({s}), 0)" for s in "lr")
    cap = " + ".join(f"(1 + {count_sql(f'substr({s}, 2)', chr(92) + 'p{Ll}')})::DOUBLE / nullif(strlen({s}), 0)" for s in "lr")
    well = " + ".join(f"CASE WHEN regexp_matches({s}, '^\\p{{Lu}}') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches({s}, '{PUNCT}$') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END" for s in "lr")
    diff = "1 - abs(len(wl)::DOUBLE / nullif(len(wr), 0))"
    return f"{PAIRS}, ws AS (SELECT *, {cased_sql('l')} AS wl, {cased_sql('r')} AS wr FROM pairs), sc AS (SELECT id, round({red}, 9) AS redundancy, round({part}, 9) AS translated_partial, round({non}, 9) AS nonalphabetic, round({cap}, 9) AS penalise_capitals, round({well}, 9) AS well_formed, round({diff}, 9) AS length_difference FROM ws)"


@query(f"WITH {_pair_scores_sql()} SELECT id, round(redundancy, 6) AS redundancy, round(translated_partial, 6) AS translated_partial, round(nonalphabetic, 6) AS nonalphabetic, round(penalise_capitals, 6) AS penalise_capitals, well_formed, round(length_difference, 6) AS length_difference FROM sc")
def pair_scores(spark, d):
    return pairs(spark, d).select("id", *(F.round(F.round(f(), 9), 6).alias(n) for n, f in R.PAIR_SCORERS.items()))


@query(f"WITH {PAIRS} SELECT id, round(" + " + ".join(f"CASE WHEN len({cased_sql(x)}) = 12 THEN 'inf'::DOUBLE ELSE 1.0::DOUBLE / abs(len({cased_sql(x)}) - 12) END" for x in "lr") + ", 9) AS score FROM pairs")
def ideal_length(spark, d):
    return pairs(spark, d).select("id", F.round(R.ideal_length(12), 9).alias("score"))


_RANKED = ["redundancy", "translated_partial", "nonalphabetic", "penalise_capitals", "well_formed", "length_difference"]


@query(f"WITH {_pair_scores_sql()}, k AS (SELECT id, " + " + ".join(f"row_number() OVER (ORDER BY {n} DESC NULLS LAST, id) - 1" for n in _RANKED) + " AS total FROM sc) SELECT id, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (ORDER BY total, id) AS i FROM k) WHERE i <= floor((SELECT count(*) FROM k) * 0.75)")
def qc(spark, d):
    return R.quality_rank(pairs(spark, d), _RANKED).select("id", F.col("total").cast("long").alias("total"))


@query()
def qc_fitted(spark, d):
    return R.quality_rank(pairs(spark, d), ["unicode_range", "out_of_freq"], 0.5).select("id", "total")


@query("WITH s AS (SELECT l_orderkey AS p1, l_partkey AS p2, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p1 ORDER BY score DESC, p2) AS i FROM s) WHERE i = 1) SELECT p1, p2 FROM (SELECT *, row_number() OVER (PARTITION BY p2 ORDER BY score DESC, p1) AS j FROM a) WHERE j = 1")
def unique_by(spark, d):
    s = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("p1"), F.col("l_partkey").alias("p2")).agg(F.max("l_extendedprice").alias("score"))
    return R.unique_by(s).select("p1", "p2")


# ---- cover


@query(f"""WITH {LINES}, {_WORDLIST}, w AS (SELECT DISTINCT doc_id, line_no, unnest({cleaned_sql('line')}) AS word FROM lines), a AS (SELECT doc_id, line_no, max(rank) AS rank FROM w LEFT JOIN wl USING (word) GROUP BY doc_id, line_no HAVING bool_and(rank IS NOT NULL)),
 i AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY doc_id, line_no) AS nth FROM a) SELECT rank, nth, doc_id, line_no FROM i WHERE nth <= 3""")
def minimal(spark, d):
    return C.minimal(lines(spark, d), _wordlist(spark, d), IDS).select("rank", "nth", *IDS)


@query()
def wordlist(spark, d):
    rounds = C.curriculum(lines(spark, d), IDS, existing=_frequent(spark, d).select("word").limit(2000))
    return spark.createDataFrame([(i, k, w) for i, ws in enumerate(rounds) for k, w in enumerate(ws)], "round long, nth long, word string")


# ---- compression distance


@query()
def langfilter(spark, d):
    docs = t(spark, d, "documents")
    return D.langfilter(docs.select("doc_id", "text"), D.references(docs), "fr", top_n=1, min_confidence=0.5).select("doc_id")


@query()
def langdetect(spark, d):
    docs = t(spark, d, "documents")
    return D.langdetect(docs.select("doc_id", "text"), D.references(docs)).select("doc_id", "detected")


def _items(spark, d) -> DataFrame:
    return t(spark, d, "benchmark").select(F.col("item_id").alias("path"), F.col("text").alias("content"))


@query()
def ncd_matrix(spark, d):
    return D.ncd_matrix(_items(spark, d)).select("i", "j", F.round("d", 9).alias("d"))


@query()
def cluster(spark, d):
    of, _, _ = D.kmedoids(D.ncd_matrix(_items(spark, d)), 5, seed=1)
    return spark.createDataFrame([(int(a), int(b)) for a, b in of.items()], "path long, medoid long")


@query()
def cluster_reassign(spark, d):
    m = D.ncd_matrix(_items(spark, d))
    of, _, _ = D.kmedoids(m, 5, seed=1)
    return spark.createDataFrame([(int(a), b) for a, b in D.reassign_worst(m, of).items()], "path long, cluster long")


@query()
def dundant(spark, d):
    return D.redundancy(t(spark, d, "documents").select("doc_id", F.col("text").alias("content"))).select("doc_id", F.round("value", 9).alias("value"))


@query()
def diversify(spark, d):
    return D.diversify(t(spark, d, "pages"), "page_id", "html").select(F.col("doc_id").alias("page_id"), "chunk_no", F.round("redundancy", 9).alias("redundancy"))


# ---- mining


@query(f"""WITH st AS (SELECT word FROM (SELECT unnest({words_sql('text')}) AS word FROM documents) GROUP BY word ORDER BY count(*) DESC, word LIMIT 60), {LINES},
 tk AS (SELECT doc_id, line_no, unnest(range(len(x))) AS i, unnest(x) AS word FROM (SELECT doc_id, line_no, regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_'']+|[^\\p{{L}}\\p{{N}}_''\\s]') AS x FROM lines)),
 ct AS (SELECT *, word IN (SELECT word FROM st) OR NOT regexp_matches(word, '[\\p{{L}}\\p{{N}}]') AS cut FROM tk), gr AS (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS g FROM ct),
 ph AS (SELECT string_agg(word, ' ' ORDER BY i) AS keyword, count(*) AS len FROM gr WHERE NOT cut GROUP BY doc_id, line_no, g), wd AS (SELECT word, sum(len)::DOUBLE / count(*) AS s FROM (SELECT unnest(string_split(keyword, ' ')) AS word, len FROM ph) GROUP BY word),
 dk AS (SELECT DISTINCT keyword FROM ph) SELECT keyword, round(sum(s), 6) AS score FROM (SELECT keyword, unnest(string_split(keyword, ' ')) AS word FROM dk) JOIN wd USING (word) GROUP BY keyword HAVING sum(s) > 3""")
def rake(spark, d):
    stop = _frequent(spark, d).select("word").limit(60)
    return M.rake(lines(spark, d), stop, IDS, minimum_score=3).select("keyword", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS s FROM (SELECT doc_id, string_split(text, '.') AS x FROM documents)), k AS (SELECT * FROM s WHERE strlen(s) BETWEEN 12 AND 169),
 w AS (SELECT DISTINCT doc_id, i, unnest(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')) AS word FROM k), c AS (SELECT a.doc_id, a.i, b.i AS j, count(*) AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.word = b.word AND a.i < b.i GROUP BY ALL),
 t AS (SELECT c.doc_id, c.i, sum(n::DOUBLE ^ 2.6) / strlen(any_value(k.s)) ^ 0.75 AS score FROM c JOIN k ON k.doc_id = c.doc_id AND k.i = c.i GROUP BY ALL)
 SELECT doc_id, i AS sentence_no, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, i) AS r FROM t) WHERE r <= 3""")
def summarise(spark, d):
    return M.summarise(t(spark, d, "documents")).select("doc_id", "sentence_no", F.round("score", 4).alias("score"))


@query("""WITH s AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS s FROM (SELECT doc_id, string_split(text, '.') AS x FROM documents)), k AS (SELECT * FROM s WHERE strlen(s) > 100),
 w AS (SELECT DISTINCT doc_id, i, unnest(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')) AS word FROM k), q AS (SELECT doc_id, i, (count(*) FILTER (word IN ('the', 'thing', 'of', 'and')) + 1) ^ 3 AS c FROM w GROUP BY ALL),
 n AS (SELECT DISTINCT a.doc_id, a.i, b.i AS j FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.word = b.word AND a.i <> b.i), t AS (SELECT n.doc_id, n.i, sum(q.c) / strlen(any_value(k.s)) AS score FROM n JOIN q ON q.doc_id = n.doc_id AND q.i = n.j JOIN k ON k.doc_id = n.doc_id AND k.i = n.i GROUP BY ALL)
 SELECT doc_id, i AS sentence_no, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, i) AS r FROM t) WHERE r <= 3""")
def search(spark, d):
    return M.search(t(spark, d, "documents"), "the thing of and").select("doc_id", "sentence_no", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS s FROM (SELECT doc_id, string_split(text, '.') AS x FROM documents)), k AS (SELECT * FROM s WHERE strlen(s) BETWEEN 12 AND 169),
 w AS (SELECT DISTINCT doc_id, i, unnest(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')) AS word FROM k), c AS (SELECT a.doc_id, a.i, b.i AS j, count(*) AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.word = b.word AND a.i < b.i GROUP BY ALL)
 SELECT doc_id, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS shared FROM c GROUP BY doc_id""")
def sentence_connections(spark, d):
    return M.sentence_connections(t(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("pairs"), F.sum("shared").alias("shared"))


@query()
def word_align(spark, d):
    return M.word_align(_nations(spark, d))


@query(f"WITH {LINES} SELECT doc_id, line_no, array_to_string(list_sort(list_distinct({words_sql('line')})), ' ') AS words FROM lines")
def encode_words(spark, d):
    sets, _ = M.encode_words(lines(spark, d), IDS)
    return sets.select(*IDS, F.array_join("words", " ").alias("words"))


# ---- streams


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_dedup(spark, d):
    out = ST.drain(ST.dedup_stream(ST.table_stream(spark, f"{d}/events.parquet").select("user_id", "event_type"), ["user_id", "event_type"]))
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id")
def stream_kv(spark, d):
    e = ST.table_stream(spark, f"{d}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return ST.drain(ST.kv_stream(e)).groupBy("key").agg(F.max_by("value", "seq").alias("value"))


@query(f"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE strlen(line) > 200")
def stream_lines(spark, d):
    docs = ST.table_stream(spark, f"{d}/documents.parquet")
    return ST.drain(U.lines(docs).filter(F.octet_length("line") > 200).select(*IDS))


# ---- relational coverage beyond text


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(spark, d):
    return t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def row_sets(spark, d):
    return t(spark, d, "customer").select("c_custkey").exceptAll(t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct())


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    return t(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("hour"), "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("qty"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS middle, round(quantile_cont(l_extendedprice, 0.9), 4) AS high FROM lineitem GROUP BY l_returnflag")
def percentiles(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.percentile("l_extendedprice", F.lit(0.5)), 4).alias("middle"), F.round(F.percentile("l_extendedprice", F.lit(0.9)), 4).alias("high"))


@query("SELECT c_custkey, s_suppkey, coalesce(c_nationkey, s_nationkey) AS nation FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")
def outer_join(spark, d):
    c, s = t(spark, d, "customer"), t(spark, d, "supplier")
    return c.join(s, (c.c_custkey == s.s_suppkey) & (c.c_nationkey == s.s_nationkey), "full").select("c_custkey", "s_suppkey", F.coalesce("c_nationkey", "s_nationkey").alias("nation"))


@query("SELECT l.event_id, max(r.event_id) FILTER (WHERE r.ts = m) AS before FROM (SELECT l.event_id, l.user_id, max(r.ts) AS m FROM events l LEFT JOIN events r ON r.user_id = l.user_id AND r.event_id % 2 = 1 AND r.ts <= l.ts WHERE l.event_id % 2 = 0 GROUP BY ALL) l LEFT JOIN events r ON r.user_id = l.user_id AND r.event_id % 2 = 1 AND r.ts = m GROUP BY l.event_id")
def asof_join(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts")
    return J.asof_join(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id", "ts", "event_id", "before").select("event_id", "before")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR lag(ts) OVER w + INTERVAL 1 DAY <= ts THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, s")
def session_windows(spark, d):
    return t(spark, d, "events").groupBy("user_id", F.session_window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("began"), "n")

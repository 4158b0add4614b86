"""Row transforms: cleaning, columns, sentences, syllables, haiku, reshaping, nested data."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units as U


def clean(df: DataFrame, col: str = "line", no_punctuation: bool = False, no_numbers: bool = False, lowercase: bool = False, ignore: str = "") -> DataFrame:
    """Keeps letters, white space, digits and ASCII punctuation (or fewer); the rest becomes spaces,
    white space collapses to its first character, rows left with one byte or none go."""
    keep = r"\p{L}\s" + ("" if no_numbers else r"\p{N}") + ("" if no_punctuation else r"!-/:-@\[-`{-~") + "".join(re.escape(x) for x in ignore)
    x = F.regexp_replace(F.col(col), r"^\s+|\s+$", "")
    x = F.regexp_replace(F.regexp_replace(x, f"[^{keep}]", " "), r"(\s)\s+", "$1")
    return df.withColumn(col, F.lower(x) if lowercase else x).filter(F.octet_length(col) > 1)


def dicer(df: DataFrame, order: list[int], col: str = "line", sep: str = "\t", newsep: str = "\t") -> DataFrame:
    """Columns of a delimited line, chosen, reordered or repeated; an empty line where one is missing."""
    if not order or min(order) < 0:
        raise ValueError("order must name columns from 0")
    parts = F.split(F.col(col), re.escape(sep), -1)
    return df.withColumn(col, F.when(F.size(parts) > max(order), F.concat_ws(newsep, *(F.get(parts, i) for i in order))).otherwise(""))


def column_spec(spec: str) -> list[tuple[str, int | None, int | None]]:
    """Parses "2 1..5 ..6 3..": columns, ranges, ranges from 0 and ranges without an end."""
    out: list[tuple[str, int | None, int | None]] = []
    for x in filter(None, re.split(r"[ ,]+", spec.strip())):
        if m := re.fullmatch(r"(\d*)\.\.(\d*)", x):
            if not (m[1] or m[2]):
                raise ValueError(f"not a column: {x}")
            out.append(("range", int(m[1] or 0), int(m[2])) if m[2] else ("open", int(m[1]), None))
        elif x.isdigit():
            out.append(("col", int(x), None))
        else:
            raise ValueError(f"not a column: {x}")
    return out


def select_columns(df: DataFrame, spec: str, col: str = "line", sep: str = "\t") -> DataFrame:
    """A delimited line's columns by column_spec; range ends are not included, missing columns are left out."""
    parts = F.split(F.col(col), re.escape(sep), -1)
    pick = []
    for kind, a, b in column_spec(spec):
        n = {"col": F.lit(1), "range": F.lit(max(0, (b or 0) - (a or 0))), "open": F.greatest(F.size(parts) - a, F.lit(0))}[kind]
        pick.append(F.slice(parts, a + 1, n))
    return df.withColumn(col, F.array_join(F.concat(*pick), sep))


def _class(chars: str) -> str:
    return "[" + "".join(re.escape(x) for x in sorted(set(chars))) + "]"


def sentences(df: DataFrame, col: str = "line", add: str = "", remove: str = "", only_use: str = "", reject_uncapitalized: bool = False, reject_unpunctuated: bool = False, min_length: int = 1) -> DataFrame:
    """A row for each sentence: lines cut after each delimiter, sentences of more than min_length bytes
    without a space before a full stop. Adds `sentence`."""
    delimiters = set(only_use) if only_use else (set(U.DELIMITERS) | set(add)) - set(remove)
    if not delimiters:
        raise ValueError("no delimiters are left")
    out = df.withColumn("sentence", F.explode(F.split(F.col(col), f"(?<={_class(''.join(delimiters))})", -1)))
    out = out.filter((F.octet_length("sentence") > min_length) & ~F.contains(F.col("sentence"), F.lit(" .")))
    if reject_uncapitalized:
        out = out.filter(F.regexp_extract("sentence", r"\p{L}", 0).rlike(r"^\p{Lu}"))
    if reject_unpunctuated:
        out = out.filter(~F.col("sentence").rlike(r"[\p{L}\p{N}]$"))
    return out.withColumn("sentence", F.replace(F.col("sentence"), F.lit("\n"), F.lit("")))


def sentence_seg(df: DataFrame, col: str = "text") -> DataFrame:
    """Sentences by closing marks followed by white space; escaped newlines and quotes are resolved."""
    x = F.regexp_replace(F.regexp_replace(F.col(col), r"\\n|\n", " "), r'\\"', "")
    return df.withColumn("sentence", F.explode(F.split(x, r"(?<=[.!?])\s+", -1))).filter("sentence <> ''")


#: Letters without a decomposition, as they are usually written in ASCII.
PLAIN = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ı": "i"}


def _accented() -> tuple[str, str]:
    import unicodedata

    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if unicodedata.normalize("NFD", chr(i))[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def ascii_only(df: DataFrame, col: str = "line") -> DataFrame:
    """Latin letters as ASCII, by tables; what has no ASCII form goes."""
    x = F.translate(F.col(col), *_accented())
    for a, b in PLAIN.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return df.withColumn(col, F.regexp_replace(x, r"[^\x00-\x7F]", ""))


def pinyin(df: DataFrame, dictionary: DataFrame, col: str = "word") -> DataFrame:
    """Tone-numbered syllables of each word, by a dictionary (word, syllables array), each second syllable
    after a hyphen; words that it lacks stay as they are. Adds `pinyin`."""
    d = dictionary.select(F.col("word").alias("__w"), "syllables").dropDuplicates(["__w"])
    joined = F.aggregate(F.transform("syllables", lambda s, i: F.concat(F.when(i % 2 == 1, "-").otherwise(""), s)), F.lit(""), lambda a, x: F.concat(a, x))
    return df.join(d, df[col] == d["__w"], "left").withColumn("pinyin", F.coalesce(joined, F.col(col))).drop("__w", "syllables")


#: Patterns that add to or take from the vowel groups of a word, in this order.
SYLLABLES = [(1, r"[aeiuo]+"), (1, r"[dlmnrstz]y"), (-1, r"[aiou][b-df-hj-np-rs-v-z]e"), (1, r"[aiou][cs]es"), (-1, r"aste"), (-1, r"apse"), (1, r"[^b-df-hj-np-tv-z]ted$"), (-1, r"e[rsvy]e"), (1, r"d[nv]"), (-1, r"elve[^t]"), (1, r"eing")]


def syllables(word) -> Column:
    """Syllables of a word, at least 0."""
    w = F.lower(F.regexp_replace(U.c(word), r"[^\p{L}\p{N}_\s]", ""))
    return F.greatest(reduce(lambda a, b: a + b, (F.lit(k) * F.regexp_count(w, F.lit(p)) for k, p in SYLLABLES)), F.lit(0)).cast("long")


def normalize_line(x) -> Column:
    return U.cleaned(x)


def haiku(df: DataFrame, col: str = "line") -> DataFrame:
    """Sentences (cut at , . ;) of 17 syllables whose words end at syllables 5 and 12: first, second, third."""
    s = df.withColumn("__s", F.explode(F.split(F.col(col), "[,.;]", -1)))
    s = s.withColumn("__w", F.filter(F.split("__s", r"\s+", -1), lambda w: w.rlike(r"\p{L}")))
    sums = F.aggregate("__w", F.array(F.lit(0).cast("long")), lambda acc, w: F.array_append(acc, F.element_at(acc, -1) + syllables(w)))
    # behind an explode the optimiser can't put the sums into each place that reads them
    s = s.withColumn("__c", F.explode(F.array(sums))).filter(F.element_at("__c", -1) == 17)
    a, b = ((F.array_position("__c", F.lit(k).cast("long")) - 1).cast("int") for k in (5, 12))
    s = s.filter((a > 0) & (b > 0))
    part = lambda lo, n: F.array_join(F.transform(F.slice("__w", lo, n), U.cleaned), " ")
    return s.withColumns({"first": part(F.lit(1), a), "second": part(a + 1, b - a), "third": part(b + 1, F.size("__w") - b)}).drop("__s", "__w", "__c")


class Steps:
    """A queue of named changes (Column to Column, or DataFrame to DataFrame), applied when asked for.

    Steps can be undone, removed, swapped and replayed; the source is never touched, since a DataFrame is
    itself only a plan.
    """

    def __init__(self, steps: list[tuple[str, Callable]] | None = None):
        self.steps = list(steps or [])

    def push(self, name: str, step: Callable) -> Steps:
        self.steps.append((name, step))
        return self

    def undo(self) -> Steps:
        if self.steps:
            self.steps.pop()
        return self

    def remove(self, name: str) -> Steps:
        self.steps = [x for x in self.steps if x[0] != name]
        return self

    def swap(self, name: str, step: Callable) -> Steps:
        self.steps = [(n, step if n == name else f) for n, f in self.steps]
        return self

    def before(self, name: str) -> Steps:
        names = [n for n, _ in self.steps]
        return Steps(self.steps[: names.index(name)])

    def history(self) -> list[str]:
        return [n for n, _ in self.steps]

    def apply(self, source):
        return reduce(lambda x, f: f[1](x), self.steps, source)


def then(value, *steps: Callable):
    """value through the steps; None at any point stays None."""
    for f in steps:
        if value is None:
            return None
        value = f(value)
    return value


def json_search(df: DataFrame, col: str, path: str) -> DataFrame:
    """Adds `found`: the value at a JSON path, null where there is none."""
    return df.withColumn("found", F.get_json_object(F.col(col), path))


def json_find(df: DataFrame, col: str, key: str, where: str = "true", depth: int = 6) -> DataFrame:
    """Adds `found`: the first value, depth first, of `key` anywhere in a JSON document that meets the SQL
    condition `where` over `value` (a string). Documents are followed `depth` levels down."""
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    level = rows.select("__row", F.array().cast("array<int>").alias("at"), F.lit(None).cast("string").alias("k"), F.col(col).alias("value"))
    seen = level
    for _ in range(depth):
        obj = F.from_json("value", "map<string,string>")
        arr = F.from_json("value", "array<string>")
        kids = F.when(F.col("value").startswith("{"), F.transform(F.map_entries(obj), lambda e, i: F.struct(i.alias("i"), e["key"].alias("k"), e["value"].alias("v")))).when(F.col("value").startswith("["), F.transform(arr, lambda v, i: F.struct(i.alias("i"), F.lit(None).cast("string").alias("k"), v.alias("v"))))
        level = level.filter("value LIKE '{%' OR value LIKE '[%'").select("__row", "at", F.explode(kids).alias("e")).select("__row", F.concat("at", F.array("e.i")).alias("at"), F.col("e.k").alias("k"), F.col("e.v").alias("value"))
        seen = seen.unionByName(level)
    first = seen.filter((F.col("k") == key) & F.expr(where)).groupBy("__row").agg(F.min_by("value", "at").alias("found"))
    return rows.join(first, "__row", "left").drop("__row")


def dot_path(df: DataFrame, path: str, name: str = "found") -> DataFrame:
    """Adds a value inside structs, maps and arrays by a dotted path; null where a step is missing."""
    first, *rest = path.split(".")
    x = F.col(first)
    for p in rest:
        x = F.try_element_at(x, F.lit(int(p)) if p.lstrip("-").isdigit() else F.lit(p)) if not p.startswith("@") else x.getField(p[1:])
    return df.withColumn(name, x)


def partial_record(df: DataFrame, fields: dict[str, tuple[str, object, str | None]], values: str = "values") -> DataFrame:
    """Adds `record`, a struct from a map of strings: for each field its SQL type, default and a condition
    over `value` that a given value must meet; `errors` lists the fields whose condition fails."""
    made, bad = [], []
    for name, (kind, default, check) in fields.items():
        v = F.expr(f"try_cast(element_at({values}, '{name}') AS {kind})")
        made.append(F.coalesce(v, F.lit(default).cast(kind)).alias(name))
        if check:
            ok = F.expr(check.replace("value", f"try_cast(element_at({values}, '{name}') AS {kind})"))
            bad.append(F.when(v.isNotNull() & ~ok, F.lit(name)))
    errors = F.filter(F.array(*bad), lambda x: x.isNotNull()) if bad else F.array().cast("array<string>")
    return df.withColumn("record", F.struct(*made)).withColumn("errors", errors)


def nearest_key(df: DataFrame, table: dict[float, object], col: str, name: str = "nearest") -> DataFrame:
    """The value of the key nearest to a number; the smaller key wins a tie."""
    rows = F.array(*(F.struct(F.abs(F.col(col) - k).alias("d"), F.lit(float(k)).alias("k"), F.lit(v).alias("v")) for k, v in table.items()))
    return df.withColumn(name, F.array_min(rows)["v"])


def rows(x, width: int) -> Column:
    """An array as rows of `width`; a last row that is not full goes."""
    a = U.c(x)
    n = F.floor(F.size(a) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.slice(a, i * width + 1, width))).otherwise(F.slice(F.array(a), 1, 0))


def quadrants(x) -> Column:
    """2 x 2 blocks (top left, top right, bottom left, bottom right) of a matrix; odd edges go."""
    m = U.c(x)
    h, w = F.floor(F.size(m) / 2).cast("int"), F.floor(F.size(F.get(m, F.lit(0))) / 2).cast("int")
    at = lambda i, j: F.get(F.get(m, i), j)
    idx = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    return F.transform(idx(h), lambda i: F.transform(idx(w), lambda j: F.array(at(i * 2, j * 2), at(i * 2, j * 2 + 1), at(i * 2 + 1, j * 2), at(i * 2 + 1, j * 2 + 1))))


def nearest_glyph(x, glyphs: dict[str, list[float]]) -> Column:
    """The glyph whose quadrants differ least (root mean square) from four numbers; a space for all zeros."""
    a = U.c(x)
    far = lambda q: sum((F.get(a, F.lit(i)).cast("double") - float(v)) * (F.get(a, F.lit(i)).cast("double") - float(v)) for i, v in enumerate(q)) / 4
    best = F.array_min(F.array(*(F.struct(F.sqrt(far(q)).alias("d"), F.lit(g).alias("g")) for g, q in glyphs.items())))["g"]
    return F.when(~F.exists(a, lambda v: v != 0), F.lit(" ")).otherwise(best)


def named_groups(df: DataFrame, pattern: str, col: str = "line") -> DataFrame:
    """Adds a column for each named group (?<name>...) of a pattern; empty where it doesn't match."""
    names = re.findall(r"\(\?<([A-Za-z]\w*)>", pattern)
    return df.withColumns({n: F.regexp_extract(col, pattern, i + 1) for i, n in enumerate(names)})


def translit_map(table: dict[str, str]) -> Column:
    return F.create_map(*chain(*((F.lit(k), F.lit(v)) for k, v in table.items())))

"""Loading dictionary lines while setting aside those that fail to parse.

A line becomes cells (row, column, position, value).  Cells meet the rules for
their column in a join with a rule table; broken rules are aggregated to one
list of reasons a row, and an anti-join with the broken rows leaves the clean
ones.  All rules run inside the JVM; only broken cells are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridrank.runtime import small_side

#: The form of a dictionary line.
HAN = "\\u4e00-\\u9fff"
WORD = f"[{HAN}A-Za-z0-9，·]+"
LINE = r"(?s)\A(\S+) (\S+) \[([^\]]*)\] /(.*)/\r?\z"
OPENING = rf"\A\s*({WORD}) ({WORD}) \[([^\[\]]*)\]\s*\z"

#: Column, kind of rule, its argument, reason given.
RULES = [
    ("line", "pattern", LINE, "not of the form: traditional simplified [pinyin] /definitions/"),
    ("traditional", "pattern", rf"\A{WORD}\z", "a character that headwords may not hold"),
    ("simplified", "pattern", rf"\A{WORD}\z", "a character that headwords may not hold"),
    ("simplified", "same length", "", "not as long as the traditional form"),
    ("pinyin", "same count", "", "not one pinyin item per character"),
    ("pinyin item", "reads peer", "", "pinyin item does not read its character"),
    ("definitions", "pattern", r"(?s).*[^/\s].*", "no definition"),
    ("definition", "brackets", "", "bracket not closed"),
    ("definition", "quotes", "", "quote not closed"),
    ("definition", "not opening", "", "another entry begins inside the line"),
]


@dataclass(frozen=True)
class Loaded:
    """``clean``: the input's columns and the four parsed fields of every valid
    line.  ``rejected``: the input's columns and ``reasons`` of every other."""

    clean: DataFrame
    rejected: DataFrame


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_column string, kind string, argument string, reason string")


def _closed(text: Column) -> Column:
    """Whether round and square brackets are closed in the order they open."""
    marks = F.filter(F.split(F.regexp_replace(text, r"[^()\[\]]", ""), ""), lambda c: c != "")

    def step(stack: Column, c: Column) -> Column:
        fits = F.right(stack, F.lit(1)) == F.translate(c, ")]", "([")
        return F.when(c.isin("(", "["), F.concat(stack, c)).when(fits, stack.substr(F.lit(1), F.length(stack) - 1)).otherwise(F.concat(stack, F.lit("!")))

    return F.aggregate(marks, F.lit(""), step) == ""


def _items(pinyin: Column) -> Column:
    return F.split(pinyin, " ", -1)


def _chars(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def _cell(column: str, position: Column, value: Column, peer: Column) -> Column:
    return F.struct(F.lit(column).alias("column"), position.cast("int").alias("position"), value.alias("value"), peer.alias("peer"))


def _cells(line: Column) -> Column:
    """All cells of a line; of a line without the right form, only itself."""
    none, zero = F.lit(None).cast("string"), F.lit(0)
    trad, simp, pinyin, defs = (F.regexp_extract(line, LINE, i) for i in (1, 2, 3, 4))
    whole = F.array(
        _cell("line", zero, line, none), _cell("traditional", zero, trad, none), _cell("simplified", zero, simp, trad),
        _cell("pinyin", zero, pinyin, trad), _cell("definitions", zero, defs, none),
    )
    items = F.transform(F.arrays_zip(_items(pinyin).alias("i"), _chars(trad).alias("c")), lambda x, i: _cell("pinyin item", i + 1, x["i"], x["c"]))
    each = F.transform(F.split(defs, "/", -1), lambda d, i: _cell("definition", i + 1, d, none))
    return F.when(line.rlike(LINE), F.concat(whole, F.filter(items, lambda x: x["value"].isNotNull() & x["peer"].isNotNull()), each)).otherwise(F.array(_cell("line", zero, line, none)))


def _holds(known: Column) -> Column:
    """Whether a cell keeps the rule it was joined with."""
    kind, value, peer = F.col("kind"), F.col("value"), F.col("peer")
    one, two, mid = (F.regexp_extract(value, OPENING, i) for i in (1, 2, 3))
    opening = value.rlike(OPENING) & (F.length(one) == F.length(two)) & (F.size(_items(mid)) == F.length(one))
    reads = F.when(peer.rlike(f"^[{HAN}]$"), known).when(peer == "，", value == ",").otherwise(value == peer)
    return (
        F.when(kind == "pattern", F.rlike(value, F.col("argument")))
        .when(kind == "same length", F.length(value) == F.length(peer))
        .when(kind == "same count", F.size(_items(value)) == F.length(peer))
        .when(kind == "reads peer", reads)
        .when(kind == "brackets", _closed(value))
        .when(kind == "quotes", F.length(F.regexp_replace(value, '[^"]', "")) % 2 == 0)
        .when(kind == "not opening", ~opening)
    )


def load_lines(lines: DataFrame, syllables: DataFrame, key: str = "line_no", line: str = "raw_line") -> Loaded:
    """Dictionary lines parsed into four fields, and those that do not parse.

    Null, blank and comment lines (first character ``#``) are in neither
    result.  A row is known by ``key`` and its text, so repeated rows share one
    verdict and each is returned; a null key is a key like any other.  A line
    with several faults is rejected once, with every reason: an array of
    (column, position, value, reason), in that order.  Extra columns pass
    through under their names, unless named like a field of the result, which
    then takes the place of the input's.  Empty tables give empty results.
    """
    spark = lines.sparkSession
    text = F.col(f"row.`{line}`")
    rows = (
        lines.select(F.struct("*").alias("row"))
        .where(text.rlike(r"\S") & ~text.startswith("#"))
        .select("row", F.col(f"row.`{key}`").alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))
    )
    cells = rows.select("k", "h", F.explode(_cells(F.col("text"))).alias("cell")).select("k", "h", "cell.*")
    spoken = F.regexp_extract(F.replace(F.lower("value"), F.lit("u:"), F.lit("ü")), r"(?s)\A(.+)[1-5]\z", 1)
    # Only pinyin items look a syllable up; a null key of the others matches nothing.
    ruled = (
        cells.join(F.broadcast(rule_table(spark)), F.col("column") == F.col("rule_column"))
        .withColumn("spoken", F.when(F.col("kind") == "reads peer", spoken))
        .join(small_side(syllables.select(F.col("syllable").alias("spoken"), F.lit(True).alias("known")).distinct()), "spoken", "left")
    )
    broken = ruled.where(~F.coalesce(_holds(F.coalesce("known", F.lit(False))), F.lit(False)))
    fault = F.struct("column", "position", "value", "reason")
    reasons = broken.groupBy("k", "h").agg(F.array_sort(F.collect_set(fault)).alias("reasons"))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["k"].eqNullSafe(b["k"]) & (a["h"] == b["h"])

    fields = [
        *(F.regexp_extract("text", LINE, i).alias(n) for i, n in ((1, "traditional"), (2, "simplified"), (3, "pinyin"))),
        F.filter(F.split(F.regexp_extract("text", LINE, 4), "/", -1), lambda d: d.rlike(r"\S")).alias("definitions"),
    ]
    named = ("traditional", "simplified", "pinyin", "definitions")
    kept = [F.col(f"row.`{c}`").alias(c) for c in lines.columns]
    clean = rows.join(reasons.select("k", "h"), same(rows, reasons), "left_anti").select(*[c for c, n in zip(kept, lines.columns) if n not in named], *fields)
    rejected = rows.join(reasons, same(rows, reasons)).select(*[c for c, n in zip(kept, lines.columns) if n != "reasons"], "reasons")
    return Loaded(clean, rejected)

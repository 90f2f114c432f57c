"""Queries on rows that fail to parse and on fields that hold several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridrank.operators.multivalue import explode_values, split_values
from hybridrank.operators.rejects import load_lines
from hybridrank.plans.catalogue import query
from hybridrank.runtime import table

_CHECKED = r"""
WITH parts AS (
  SELECT line_no, raw_line, regexp_extract(raw_line, '(?s)^(\S+) (\S+) \[([^\]]*)\] /(.*)/\r?$', ['t','s','p','d']) AS m,
         regexp_full_match(raw_line, '(?s)(\S+) (\S+) \[([^\]]*)\] /(.*)/\r?') AS shaped
  FROM cedict_lines WHERE regexp_matches(raw_line, '\S') AND raw_line NOT LIKE '#%'),
syl AS (SELECT list(syllable) AS known FROM pinyin_syllable),
checked AS (
  SELECT line_no, m, shaped
    AND regexp_full_match(m.t, '[\x{4e00}-\x{9fff}A-Za-z0-9，·]+') AND regexp_full_match(m.s, '[\x{4e00}-\x{9fff}A-Za-z0-9，·]+')
    AND length(m.t) = length(m.s)
    AND len(string_split(m.p, ' ')) = length(m.t)
    AND coalesce(list_bool_and(list_transform(range(1, length(m.t) + 1), lambda i:
      CASE WHEN regexp_full_match(substr(m.t, i, 1), '[\x{4e00}-\x{9fff}]')
           THEN regexp_full_match(string_split(m.p, ' ')[i], '(?s).+[1-5]')
                AND list_contains(known, replace(lower(left(string_split(m.p, ' ')[i], -1)), 'u:', 'ü'))
           WHEN substr(m.t, i, 1) = '，' THEN string_split(m.p, ' ')[i] = ','
           ELSE string_split(m.p, ' ')[i] = substr(m.t, i, 1) END)), true)
    AND regexp_matches(m.d, '[^/\s]')
    AND coalesce(list_bool_and(list_transform(string_split(m.d, '/'), lambda x:
      length(regexp_replace(x, '[^"]', '', 'g')) % 2 = 0
      AND regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[^()\[\]]', '', 'g'), '\(\)|\[\]', '', 'g'), '\(\)|\[\]', '', 'g'), '\(\)|\[\]', '', 'g') = ''
      AND NOT coalesce(regexp_full_match(x, '\s*[\x{4e00}-\x{9fff}A-Za-z0-9，·]+ [\x{4e00}-\x{9fff}A-Za-z0-9，·]+ \[[^\[\]]*\]\s*'), false))), true) AS valid
  FROM parts, syl)
"""


@query(_CHECKED + "SELECT DISTINCT line_no FROM checked WHERE NOT coalesce(valid, false)")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are not valid."""
    return load_lines(table(spark, sf_dir, "cedict_lines"), table(spark, sf_dir, "pinyin_syllable")).rejected.select("line_no").distinct()


@query(
    _CHECKED
    + r"SELECT line_no, m.t AS traditional, m.s AS simplified, m.p AS pinyin, array_to_string(list_filter(string_split(m.d, '/'), lambda x: regexp_matches(x, '\S')), '/') AS definitions FROM checked WHERE valid"
)
def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four fields of every valid line."""
    loaded = load_lines(table(spark, sf_dir, "cedict_lines"), table(spark, sf_dir, "pinyin_syllable"))
    return loaded.clean.select("line_no", "traditional", "simplified", "pinyin", F.array_join("definitions", "/").alias("definitions"))


_REASONS = _CHECKED.rstrip() + r""", cells AS (SELECT line_no, shaped, m.t AS t, m.s AS s, string_split(m.p, ' ') AS items, string_split(m.d, '/') AS defs, m.d AS d FROM parts),
word AS (SELECT '[\x{4e00}-\x{9fff}A-Za-z0-9，·]+' AS w),
faults AS (
  SELECT line_no, 'line' AS "column", 0 AS position, 'not of the form: traditional simplified [pinyin] /definitions/' AS reason FROM cells WHERE NOT shaped
  UNION ALL SELECT line_no, 'traditional', 0, 'a character that headwords may not hold' FROM cells, word WHERE shaped AND NOT regexp_full_match(t, w)
  UNION ALL SELECT line_no, 'simplified', 0, 'a character that headwords may not hold' FROM cells, word WHERE shaped AND NOT regexp_full_match(s, w)
  UNION ALL SELECT line_no, 'simplified', 0, 'not as long as the traditional form' FROM cells WHERE shaped AND length(t) <> length(s)
  UNION ALL SELECT line_no, 'pinyin', 0, 'not one pinyin item per character' FROM cells WHERE shaped AND len(items) <> length(t)
  UNION ALL SELECT line_no, 'pinyin item', i::INT, 'pinyin item does not read its character' FROM cells, syl, unnest(range(1, least(len(items), length(t)) + 1)) u(i) WHERE shaped AND NOT
    CASE WHEN regexp_full_match(substr(t, i, 1), '[\x{4e00}-\x{9fff}]') THEN regexp_full_match(items[i], '(?s).+[1-5]') AND list_contains(known, replace(lower(left(items[i], -1)), 'u:', 'ü'))
         WHEN substr(t, i, 1) = '，' THEN items[i] = ',' ELSE items[i] = substr(t, i, 1) END
  UNION ALL SELECT line_no, 'definitions', 0, 'no definition' FROM cells WHERE shaped AND NOT regexp_matches(d, '[^/\s]')
  UNION ALL SELECT line_no, 'definition', i::INT, 'quote not closed' FROM cells, unnest(range(1, len(defs) + 1)) u(i) WHERE shaped AND length(regexp_replace(defs[i], '[^"]', '', 'g')) % 2 = 1
  UNION ALL SELECT line_no, 'definition', i::INT, 'bracket not closed' FROM cells, unnest(range(1, len(defs) + 1)) u(i) WHERE shaped
    AND regexp_replace(regexp_replace(regexp_replace(regexp_replace(defs[i], '[^()\[\]]', '', 'g'), '\(\)|\[\]', '', 'g'), '\(\)|\[\]', '', 'g'), '\(\)|\[\]', '', 'g') <> ''
  UNION ALL SELECT line_no, 'definition', i::INT, 'another entry begins inside the line' FROM cells, unnest(range(1, len(defs) + 1)) u(i) WHERE shaped AND regexp_full_match(defs[i], '\s*[\x{4e00}-\x{9fff}A-Za-z0-9，·]+ [\x{4e00}-\x{9fff}A-Za-z0-9，·]+ \[[^\[\]]*\]\s*')
    AND length(regexp_extract(defs[i], '\s*(\S+) (\S+) \[([^\[\]]*)\]', 1)) = length(regexp_extract(defs[i], '\s*(\S+) (\S+) \[([^\[\]]*)\]', 2))
    AND len(string_split(regexp_extract(defs[i], '\s*(\S+) (\S+) \[([^\[\]]*)\]', 3), ' ')) = length(regexp_extract(defs[i], '\s*(\S+) (\S+) \[([^\[\]]*)\]', 1)))
SELECT line_no, "column", position, reason FROM faults"""


@query(_REASONS)
def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rejected line with the reasons for its failure."""
    rejected = load_lines(table(spark, sf_dir, "cedict_lines"), table(spark, sf_dir, "pinyin_syllable")).rejected
    return rejected.select("line_no", F.explode("reasons").alias("r")).select("line_no", "r.column", "r.position", "r.reason")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell that may hold several values, under one schema."""
    old = table(spark, sf_dir, "cedict").select(F.lit("definitions").alias("field_name"), F.col("entry_no").alias("row_no"), F.col("definitions").alias("cell"))
    new = table(spark, sf_dir, "chengyu_entry").select(F.lit("meaning").alias("field_name"), F.col("pos").alias("row_no"), F.col("meaning").alias("cell"))
    return old.unionByName(new)


@query()
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the values of every cell with two or more."""
    # A generated column is a barrier: a filter on a plain one would be pushed down, and every cell split twice.
    sized = _fields(spark, sf_dir).select("field_name", "row_no", F.explode(F.array(F.size(split_values("cell")))).alias("n"))
    cells = sized.where("n >= 2").groupBy("field_name", "row_no").agg(F.max("n").alias("n"))
    return cells.select("field_name", "row_no", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("value_pos"))


@query()
def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every cell on its own row, with its position."""
    return explode_values(_fields(spark, sf_dir), "cell").drop("cell")

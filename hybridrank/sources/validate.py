"""Checks of loaded artifacts, as constraint queries; and migrations of identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hybridrank.functions.text import single_spaced
from hybridrank.sources.export import template as template_text


def vector_findings(corpus: DataFrame, artifact: DataFrame, dims: int) -> DataFrame:
    """``(finding, n)``: missing, extra and duplicate ids, and null, misshapen or non-finite vectors."""
    v = artifact.select("ids", "vectors").distinct()
    bad = F.exists("vectors", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    named = {
        "missing": corpus.select(F.col("id").alias("ids")).join(v, "ids", "left_anti"),
        "extra": v.where("ids is not null").join(corpus.select(F.col("id").alias("ids")), "ids", "left_anti"),
        "duplicate": v.groupBy("ids").count().where("count > 1"),
        "null vector": v.where("vectors is null"),
        "dimensions": v.where(F.size("vectors") != dims).where("vectors is not null"),
        "not finite": v.where(bad),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("finding"), "n") for k, df in named.items()])


def link_findings(links: DataFrame, headwords: DataFrame) -> DataFrame:
    """``(finding, n)`` of a variant map: unknown ends or relations, links to itself, pairs given twice in either order."""
    known = headwords.select(F.col("headword").alias("h")).distinct()
    ends = links.select(F.explode(F.array("a", "b")).alias("h")).where("h is not null").distinct()
    pair = links.where("a is not null and b is not null").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).count()
    named = {
        "unknown headword": ends.join(known, "h", "left_anti"),
        "unknown relation": links.where("relation is null or relation not in ('same', 'full_form')"),
        "unknown common": links.where("common is not null and common not in ('a', 'b', 'equal')"),
        "missing end": links.where("a is null or b is null"),
        "to itself": links.where("a = b"),
        "given twice": pair.where("count > 1"),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("finding"), "n") for k, df in named.items()])


def corpus_hash(corpus: DataFrame, template: str, version: str) -> DataFrame:
    """``(version, template, n, hash)``: a hash of identifier, headword and embedded text of all rows in order.

    Rows are hashed where they are, blocks of 10,000 positions next, and the
    block hashes last, so no task gathers the corpus.
    """
    row = F.sha2(F.to_json(F.struct("id", single_spaced(F.col("chengyu")).alias("chengyu"), template_text(template).alias("text"))), 256)
    blocks = corpus.select("pos", row.alias("h")).groupBy(F.floor(F.col("pos") / 10_000).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), "")
    return blocks.agg(F.sum("n").alias("n"), F.sha2(F.concat(F.lit(f"{version}|{template}|"), whole), 256).alias("hash")).select(F.lit(version).alias("version"), F.lit(template).alias("template"), "n", "hash")


def migrated(saved: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(id, n, moved)``: saved records under their present identifier, each once.

    The first record saved under the present identifier wins; without one, the
    last record saved under an old one.  ``saved`` holds ``n`` (order) and ``id``.
    """
    rows = saved.join(aliases.select(F.col("old").alias("id"), "new"), "id", "left").select("n", F.coalesce("new", "id").alias("id"), F.col("new").isNotNull().alias("moved"))
    order = Window.partitionBy("id").orderBy("moved", F.when(F.col("moved"), -F.col("n")).otherwise(F.col("n")))
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").select("id", "n", "moved")


def refreshed(saved: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(n, id)``: the present entry of every saved record, null where there is none.

    A record with an identifier is found by it or not at all.  One without is
    found by headword and reading (a blank reading fits any), if that names a
    single entry.  ``saved`` holds ``n, id, chengyu, pinyin``.
    """
    ids = corpus.select("id", F.col("id").alias("by_id")).distinct()
    named = lambda keys: corpus.groupBy(*keys).agg(F.count(F.lit(1)).alias("many"), F.min("id").alias("found")).where("many = 1").drop("many")
    blank = F.coalesce(F.trim("pinyin"), F.lit("")) == ""
    rows = saved.join(ids, "id", "left").join(named(["chengyu", "pinyin"]).withColumnRenamed("found", "by_reading"), ["chengyu", "pinyin"], "left").join(named(["chengyu"]).withColumnRenamed("found", "by_head"), "chengyu", "left")
    return rows.select("n", F.when(F.col("id").isNotNull(), F.col("by_id")).when(blank, F.col("by_head")).otherwise(F.col("by_reading")).alias("id"))

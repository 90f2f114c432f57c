"""Named queries of the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridrank.llm.components import counted_links, star_components
from hybridrank.llm.lookalike import lookalike_pairs, unify
from hybridrank.llm.mixing import mix, shares
from hybridrank.llm.mojibake import restore_texts
from hybridrank.llm.neighbours import nearest
from hybridrank.llm.packing import pack
from hybridrank.llm.tokens import token_count
from hybridrank.runtime import Scratch, table

QUERIES, ORACLES = {}, {}

ENTRY_TEXTS = {"chengyu": "headword", "traditional": "headword", "pinyin": "pinyin"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(
    """
WITH RECURSIVE links AS (
  SELECT trim(a) AS x, trim(b) AS y FROM variant_families
  WHERE lower(trim(relation)) = 'same' AND trim(a) <> '' AND trim(b) <> ''),
edges AS (SELECT x, y FROM links WHERE x <> y UNION SELECT y, x FROM links WHERE x <> y),
reach AS (SELECT DISTINCT x AS head, x AS member FROM edges UNION SELECT r.head, e.y FROM reach r JOIN edges e ON e.x = r.member)
SELECT min(head) AS group_head, member AS headword FROM reach GROUP BY member HAVING min(head) <> member
"""
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headwords and the head of their group, by links of relation ``same``."""
    links = counted_links(table(spark, sf_dir, "variant_families"))
    return star_components(links, "a", "b").selectExpr("head AS group_head", "member AS headword")


@query(
    """
WITH good AS (
  SELECT ids, any_value(vectors::DOUBLE[]) AS v FROM embedding_artifact
  WHERE len(vectors) = 64 AND ids IS NOT NULL AND list_bool_and(list_transform(vectors, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(vectors, lambda x: x <> 0)) GROUP BY ids),
ranked AS (
  SELECT a.ids AS a, b.ids AS b, row_number() OVER (PARTITION BY a.ids ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.ids) AS n
  FROM good a JOIN good b ON a.ids <> b.ids)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM ranked WHERE n <= 5
"""
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of which either is among the five nearest to the other."""
    near = nearest(table(spark, sf_dir, "embedding_artifact"), "ids", "vectors", k=5, dims=64)
    return near.select(F.least("key", "neighbour").alias("id_a"), F.greatest("key", "neighbour").alias("id_b")).distinct()


@query()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entries that look alike and are typed differently."""
    pairs = lookalike_pairs(table(spark, sf_dir, "chengyu_entry"), "pos", ENTRY_TEXTS)
    return pairs.select(F.col("a").alias("pos_a"), F.col("b").alias("pos_b"))


@query()
def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with the consistent form of its headwords and pinyin."""
    return unify(table(spark, sf_dir, "chengyu_entry").select("pos", *ENTRY_TEXTS), ENTRY_TEXTS).select("pos", *[c + "_form" for c in ENTRY_TEXTS])


@query()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a garbled stretch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return restore_texts(docs).where("repair.garbled").select("doc_id").distinct()


@query()
def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with their text as far as it can be recovered, and whether any of it could."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    kind = F.when(F.col("repair.chain").isNotNull(), "restored").otherwise("beyond repair")
    return restore_texts(docs).where("repair.garbled").select("doc_id", F.col("repair.text").alias("restored_text"), F.col("repair.chain").alias("chain"), kind.alias("kind"))


def _sizes(spark: SparkSession, sf_dir: str, tag: str) -> DataFrame:
    """The documents with their size in tokens, counted once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"))
    return Scratch(spark, tag).keep(docs, "sizes")


@query()
def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text, or piece of a text, for every capacity."""
    sizes = _sizes(spark, sf_dir, "sizes")
    kinds = table(spark, sf_dir, "pack_capacity").distinct().orderBy("capacity_tokens", "container_kind").collect()
    out = None
    for k in kinds:
        one = pack(sizes, "doc_id", "n_tokens", k["capacity_tokens"]).withColumn("container_kind", F.lit(k["container_kind"])).withColumn("capacity_tokens", F.lit(k["capacity_tokens"]))
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("key", "doc_id")


@query()
def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of every capacity are."""
    packed = p6_packed(spark, sf_dir).where("container is not null")
    each = packed.groupBy("container_kind", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("used"))
    return each.groupBy("container_kind", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.avg(F.col("used") / F.col("capacity_tokens")).alias("fill"))


@query()
def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return mix(_sizes(spark, sf_dir, "sizes"), "source", "n_tokens", table(spark, sf_dir, "mix_target")).select("doc_id", "source", "n_tokens", "times")


@query()
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mix reached."""
    return shares(p7_mixed(spark, sf_dir), "source", "n_tokens", table(spark, sf_dir, "mix_target"))

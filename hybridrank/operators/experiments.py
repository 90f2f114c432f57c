"""Experiments over many configurations and queries in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hybridrank.functions.query import MODE_BY_TYPE
from hybridrank.functions.text import fnv1a, plain_pinyin
from hybridrank.operators.fusion import BLEND_BY_TYPE

QUERY_TYPES = tuple(MODE_BY_TYPE)

#: Profiles of the weights of vectors and of tokens, by type of query; other types keep the weights of ``fusion``.
PROFILES: dict[str, dict[str, tuple[float, float]]] = {
    "current": {},
    "balanced-plus": {"english_meaning": (0.75, 0.25), "thematic": (0.8, 0.2), "literal": (0.35, 0.65)},
    "semantic-heavy": {"english_meaning": (0.8, 0.2), "thematic": (0.85, 0.15), "literal": (0.4, 0.6)},
    "literal-token-heavy": {"english_meaning": (0.75, 0.25), "thematic": (0.8, 0.2), "literal": (0.25, 0.75)},
    "thematic-token-rescue": {"english_meaning": (0.7, 0.3), "thematic": (0.65, 0.35), "literal": (0.35, 0.65)},
    "english-token-rescue": {"english_meaning": (0.6, 0.4), "thematic": (0.8, 0.2), "literal": (0.35, 0.65)},
}
_RERANK = ("top", "share", "meaning_phrase", "literal_phrase", "coverage", "jaccard", "focused", "all_focused", "bigram", "trigram")
#: Profiles of reranking by word evidence, for all types of query or by type, in the order of ``_RERANK``.
RERANKERS: dict[str, dict[str, dict[str, float]]] = {
    "current": {},
    "rerank-light": {"": dict(zip(_RERANK, (20, 0.15, 0.8, 0.6, 0.5, 0.35, 0.2, 0.2, 0.35, 0.15)))},
    "rerank-medium": {"": dict(zip(_RERANK, (24, 0.25, 1.0, 0.7, 0.65, 0.45, 0.3, 0.35, 0.45, 0.2)))},
    "rerank-targeted": {
        "english_meaning": dict(zip(_RERANK, (24, 0.25, 1.0, 0.75, 0.7, 0.5, 0.35, 0.4, 0.5, 0.25))),
        "thematic": dict(zip(_RERANK, (18, 0.1, 0.6, 0.4, 0.35, 0.25, 0.15, 0.1, 0.2, 0.1))),
        "literal": dict(zip(_RERANK, (20, 0.2, 0.7, 1.0, 0.6, 0.35, 0.25, 0.25, 0.55, 0.2))),
    },
}


def blends(profiles: dict[str, dict[str, tuple[float, float]]] = PROFILES) -> dict[str, list[tuple[float, float]]]:
    """The different weights of vectors and of tokens that profiles give a type of query."""
    return {t: sorted({over.get(t) or BLEND_BY_TYPE.get(t, (0.5, 0.5)) for over in profiles.values()}) for t in QUERY_TYPES}


def sweep(parts: DataFrame, profiles: dict[str, dict[str, tuple[float, float]]] = PROFILES, k: int = 5) -> DataFrame:
    """``(profile, query, pos, score, rank)`` under every profile, in one job.

    ``parts`` holds ``query, query_type, pos, token, similarity``: the evidence
    is gathered once and weighed by a small table of profiles.
    """
    out = [(name, t, *(over.get(t) or BLEND_BY_TYPE.get(t, (0.5, 0.5)))) for name, over in profiles.items() for t in QUERY_TYPES]
    weights = F.broadcast(parts.sparkSession.createDataFrame(out, "profile string, query_type string, we double, wt double"))
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity")))
    squash = F.when(F.col("token") > 0, F.least(F.col("token") / 3, F.lit(1.0))).otherwise(0.0)
    scored = parts.join(weights, "query_type").withColumn("score", F.round((near * F.col("we") + squash * F.col("wt")) / (F.col("we") + F.col("wt")), 9))
    order = Window.partitionBy("profile", "query").orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("profile", "query", "pos", "score", "rank")


def generated_queries(corpus: DataFrame, seed: str = "queries-v1") -> DataFrame:
    """``(route, query)``: deterministic test queries: meanings whole, cut short, and with two letters exchanged; headwords; readings without tones.

    A hash of the seed and the position picks the place; no state is carried from row to row.
    """
    text = F.lower("meaning")
    rows = corpus.where("meaning is not null and length(meaning) >= 12").select("pos", text.alias("t"), fnv1a(F.concat_ws(":", F.lit(seed), F.col("pos").cast("string"))).alias("h"))
    at = (F.col("h") % (F.length("t") - 3) + 2).cast("int")
    swapped = F.concat(F.col("t").substr(F.lit(1), at - 1), F.col("t").substr(at + 1, F.lit(1)), F.col("t").substr(at, F.lit(1)), F.col("t").substr(at + 2, F.length("t")))
    made = F.array(F.struct(F.lit("en:whole").alias("route"), F.col("t").alias("query")), F.struct(F.lit("en:partial").alias("route"), F.trim(F.substring("t", 1, 10)).alias("query")), F.struct(F.lit("en:typo").alias("route"), swapped.alias("query")))
    heads = F.array(F.struct(F.lit("zh:headword").alias("route"), F.trim("chengyu").alias("query")), F.struct(F.lit("pinyin:plain").alias("route"), plain_pinyin(F.col("pinyin")).alias("query")))
    more = corpus.select(F.explode(heads).alias("m")).select("m.*").where("query <> ''")
    return rows.select(F.explode(made).alias("m")).select("m.*").unionByName(more).distinct()


def median_latency(samples: DataFrame) -> DataFrame:
    """``(group, n, p50, p95, most, mean)``: the median over passes of each query first, then percentiles over queries.

    ``samples`` holds ``group, query, duration_ms``, one row per pass.
    """
    disc = lambda p, c: F.expr(f"percentile_disc({p}) within group (order by {c})")
    each = samples.groupBy("group", "query").agg(disc(0.5, "duration_ms").alias("d"))
    return each.groupBy("group").agg(F.count(F.lit(1)).alias("n"), disc(0.5, "d").alias("p50"), disc(0.95, "d").alias("p95"), F.max("d").alias("most"), F.round(F.avg("d"), 6).alias("mean"))

"""Request metrics, rankings judged against labels, splits and reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hybridrank.functions.text import fnv1a

#: Gains of grades, the types of query that count as primary, and those routed by meaning.
GAINS = {0: 0.0, 1: 1.5, 2: 3.0}
PRIMARY = ("english_meaning", "thematic")
BY_MEANING = ("english_meaning", "thematic", "literal")
TOLERANCE = 1e-12


def once(log: DataFrame) -> DataFrame:
    """Every request once, as it was first received; one pre-aggregated grouping."""
    rest = [c for c in log.columns if c not in ("request_no", "received_at")]
    first = log.groupBy("request_no").agg(F.min(F.struct("received_at", *rest)).alias("r"))
    return first.select("request_no", "r.*")


def latency(value: Column) -> list[Column]:
    """Count, mean, extremes and nearest-rank percentiles of a duration."""
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by duration_ms)")
    return [F.count(value).alias("n"), F.round(F.avg(value), 3).alias("mean"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.sum(value), 3).alias("total")]


def latency_by(requests: DataFrame, *keys: str) -> DataFrame:
    return requests.where("duration_ms is not null").groupBy(*keys).agg(*latency(F.col("duration_ms")))


def latency_sets(requests: DataFrame) -> DataFrame:
    """Latency over all requests, by endpoint, and by mode, in one pass."""
    requests.createOrReplaceTempView("__requests")
    return requests.sparkSession.sql(
        "SELECT endpoint, mode, grouping_id(endpoint, mode) AS level, count(duration_ms) AS n, round(avg(duration_ms), 3) AS mean, min(duration_ms) AS least, max(duration_ms) AS most, round(sum(duration_ms), 3) AS total"
        " FROM __requests WHERE duration_ms IS NOT NULL GROUP BY GROUPING SETS ((), (endpoint), (mode))"
    )


def request_counts(requests: DataFrame) -> DataFrame:
    """Requests by endpoint, with failures, empty results and later pages."""
    return requests.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status_code") >= 400).alias("failed"), F.count_if((F.col("status_code") == 200) & (F.col("result_count") == 0)).alias("empty"),
        F.count_if(F.col("page_offset") > 0).alias("later_pages"), F.countDistinct("client_id").alias("clients"),
    )


def outcome_pivot(requests: DataFrame, modes: list[str]) -> DataFrame:
    """Requests by status, one column per mode."""
    return requests.groupBy("status_code").pivot("mode", modes).agg(F.count(F.lit(1))).fillna(0)


def ndcg(results: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """``(query, ndcg)``: linear gain over log2 discount, against the best order of all labels; 0 if that is 0.

    ``results`` holds ``query, item, rank``, ``labels`` ``query, item, relevance``.
    Every labelled query comes out; items without a label gain nothing.
    """
    gain = F.col("relevance") / F.log2(F.col("rank") + 1)
    got = results.where(F.col("rank") <= k).join(labels, ["query", "item"]).groupBy("query").agg(F.sum(gain).alias("dcg"))
    order = Window.partitionBy("query").orderBy(F.desc("relevance"))
    ideal = labels.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("query").agg(F.sum(gain).alias("ideal"))
    return ideal.join(got, "query", "left").select("query", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def score_summary(scores: DataFrame) -> DataFrame:
    """``(scope, n, ndcg)``: the mean over all, primary and meaning-routed queries, and by type.  ``scores`` holds ``query_type, ndcg``."""
    scopes = F.array(F.lit("overall"), F.concat(F.lit("type:"), "query_type"), F.when(F.col("query_type").isin(*PRIMARY), "primary"), F.when(F.col("query_type").isin(*BY_MEANING), "by_meaning"))
    return scores.select("ndcg", F.explode(F.array_compact(scopes)).alias("scope")).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


def label_coverage(results: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """``(slots, labelled, missing)`` of the first ``k`` results of labelled queries; the missing pairs are left in the shuffle-free anti-join."""
    slots = results.where(F.col("rank") <= k).join(labels.select("query").distinct(), "query", "left_semi").join(labels.select("query", "item", F.lit(1).alias("known")), ["query", "item"], "left")
    return slots.agg(F.count(F.lit(1)).alias("slots"), F.count("known").alias("labelled"), (F.count(F.lit(1)) - F.count("known")).alias("missing"))


def with_supplement(labels: DataFrame, supplement: DataFrame) -> DataFrame:
    """Labels and graded additions; no addition may grade a pair again, and grades map to fixed gains."""
    gains = F.create_map(*[F.lit(x) for kv in GAINS.items() for x in kv])
    added = supplement.join(labels, ["query", "item"], "left_anti").select("query", "item", F.try_element_at(gains, F.col("grade")).alias("relevance"))
    return labels.select("query", "item", "relevance").unionByName(added.where("relevance is not null"))


def gate(candidate: DataFrame, live: DataFrame) -> DataFrame:
    """``(scope, candidate, live, passed)`` for the overall and primary score: the candidate must not fall below the live one."""
    c, b = (x.where("scope in ('overall', 'primary')") for x in (candidate, live))
    return c.select("scope", F.col("ndcg").alias("candidate")).join(b.select("scope", F.col("ndcg").alias("live")), "scope").withColumn("passed", F.col("candidate") + TOLERANCE >= F.col("live"))


def route_audit(scores: DataFrame, least_gain: float = 0.0) -> DataFrame:
    """``(query, auto, best_mode, best, gain)`` where an explicit mode beats the routed one.  ``scores`` holds ``query, mode, ndcg``."""
    best = scores.where("mode <> 'auto'").groupBy("query").agg(F.min(F.struct((-F.col("ndcg")).alias("v"), "mode")).alias("m"))
    auto = scores.where("mode = 'auto'").select("query", F.col("ndcg").alias("auto"))
    return auto.join(best, "query").select("query", "auto", F.col("m.mode").alias("best_mode"), (-F.col("m.v")).alias("best")).withColumn("gain", F.round(F.col("best") - F.col("auto"), 9)).where(F.col("gain") > least_gain)


def worst(scores: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` queries that lose most (a report)."""
    return scores.withColumn("loss", F.round(1 - F.col("ndcg"), 9)).orderBy(F.desc("loss"), "query").limit(n)


def first_of_each(rows: DataFrame, kind: str, order: str, n: int = 2) -> DataFrame:
    """The first ``n`` rows of each kind."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(kind).orderBy(order))).where(F.col("n") <= n)


def holdout(cases: DataFrame, kind: str, key: str, ratio: float = 0.25, seed: str = "holdout-v1") -> DataFrame:
    """``cases`` with ``held_out``: a deterministic part of each kind, in the order of a hash.

    Each kind gives ``floor(ratio * size)``, never its last case; what is
    missing to the whole ratio goes to the largest remainders, then the larger
    kinds, then by name.  Only the sizes of the kinds reach the driver.
    """
    sizes = {r[kind]: r["count"] for r in cases.groupBy(kind).count().collect()}
    most = {t: n if ratio >= 1 else max(0, n - 1) for t, n in sizes.items()}
    take = {t: min(math.floor(n * ratio), most[t]) for t, n in sizes.items()}
    target = min(math.floor(sum(sizes.values()) * ratio + 0.5), sum(most.values()))
    while sum(take.values()) < target:
        take[min((t for t in sizes if take[t] < most[t]), key=lambda t: (take[t] - sizes[t] * ratio, -sizes[t], t))] += 1
    quota = F.broadcast(cases.sparkSession.createDataFrame(list(take.items()) or [("", 0)], f"{kind} string, quota int"))
    hashed = fnv1a(F.concat_ws("::", F.lit(seed), F.col(kind), F.col(key)))
    order = Window.partitionBy(kind).orderBy("h", key)
    return cases.withColumn("h", hashed).withColumn("place", F.row_number().over(order)).join(quota, kind).withColumn("held_out", F.col("place") <= F.col("quota")).drop("h", "quota")


def parity(mine: DataFrame, other: DataFrame, keys: list[str], score: str, tolerance: float = 1e-12) -> DataFrame:
    """Rows in which two rankings differ: keys in one only, or scores further apart than the tolerance."""
    a, b = mine.select(*keys, F.col(score).alias("mine")), other.select(*keys, F.col(score).alias("other"))
    return a.join(b, keys, "full_outer").where("mine is null or other is null or abs(mine - other) > " + repr(tolerance))


def leaderboard(summary: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a summary by several scores, the best first, missing scores last."""
    return summary.withColumn("place", F.rank().over(Window.partitionBy(F.lit(1)).orderBy(*[F.desc_nulls_last(c) for c in by])))

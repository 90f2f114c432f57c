"""Groups from pairwise matches, by alternating star rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridrank.runtime import Scratch

#: A node counts as hot from this share of all edges on.  At most
#: ``2 / HOT_SHARE`` nodes can be hot, which bounds the broadcast side.
HOT_SHARE, HOT_LEAST = 1 / 2000, 10_000
#: The most rounds by default; a chain of n members takes about log n.
ROUNDS = 60


def _with_least(edges: DataFrame, key: str, other: str, least: DataFrame, total: int) -> DataFrame:
    """``edges`` with the least neighbour of their ``key`` column.

    The edges of hot nodes meet their (few) minima in a broadcast join.  In the
    join by shuffle that gives all others theirs, an edge of a hot node goes by
    its other end, so that it never gathers with the rest of its node; what it
    may meet there is not used.
    """
    floor = max(HOT_LEAST, int(total * HOT_SHARE))
    hot = least.where(F.col("degree") >= floor).select(F.col("node").alias(key), F.col("least").alias("hot_least"))
    all_ = least.select(F.col("node").alias("meet"), F.col("least").alias("cold_least"))
    marked = edges.join(F.broadcast(hot), key, "left")
    met = marked.withColumn("meet", F.when(F.col("hot_least").isNull(), F.col(key)).otherwise(F.col(other))).join(all_, "meet", "left")
    return met.select("high", "low", F.coalesce("hot_least", "cold_least").alias("least"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every neighbour above a node moves to the node's least neighbour.

    An edge gives one edge, so what comes out twice waits for the small star to
    be told apart.
    """
    both = edges.select(F.col("low").alias("node"), F.col("high").alias("other"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("high").alias("node"), F.col("low").alias("other"), F.lit(1).alias("up"))
    )
    # Only nodes that are the lower end of an edge are asked for below.
    least = (
        both.groupBy("node")
        .agg(F.min("other").alias("other"), F.sum(1 - F.col("up")).alias("degree"))
        .where("degree > 0")
        .select("node", F.least("node", "other").alias("least"), "degree")
    )
    return _with_least(edges, "low", "high", least, total).select("high", F.col("least").alias("low"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node and its lower neighbours move to the least of them."""
    least = edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("degree"))
    moved = _with_least(edges, "high", "low", least, total).where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionByName(least.select(F.col("node").alias("high"), F.col("least").alias("low"))).distinct()


def star_components(pairs: DataFrame, a: str, b: str, rounds: int = ROUNDS) -> DataFrame:
    """``(member, head)`` for every member of a group of two or more but its head.

    ``pairs`` holds one match per row in the columns ``a`` and ``b``; other
    columns are ignored, whatever their names.  The head is the least member
    (strings: code point order).  Pairs with a null end and pairs of a value
    with itself tie nothing; repeated and reversed pairs count once; an empty
    table gives an empty result.

    Each round is a large-star and a small-star rewrite, both distributed joins
    on edges of the current graph, and ends with a table in the shared folder.
    The rewrites stop when neither the number of edges nor their hash changes:
    then all components are stars around their least member.  A graph that needs
    more than ``rounds`` rounds raises an error; nothing is cut off.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "components")
    x, y = F.col("x"), F.col("y")
    edges = (
        pairs.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("high"), F.least(x, y).alias("low"))
        .distinct()
    )
    facts = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))}
    edges, before = scratch.keep(edges, "edges-0", **facts), None
    for i in range(1, rounds + 1):
        now = dict(scratch.facts)
        if now == before or not now["n"]:
            break
        before = now
        edges = scratch.keep(_small_star(_large_star(edges, now["n"]), now["n"]), f"edges-{i}", **facts)
        if i > 1:
            scratch.drop(f"edges-{i - 2}")
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return edges.select(F.col("high").alias("member"), F.col("low").alias("head"))


def group_records(records: DataFrame, key: str, pairs: DataFrame, a: str, b: str, out: str = "group_id") -> DataFrame:
    """``records`` with the identifier of its group in ``out``.

    Every row of ``records`` is kept.  A record that no pair names is a group
    of its own; a null key gets a null group.
    """
    heads = star_components(pairs, a, b)
    named = heads.select(F.col("member").alias("__member"), F.col("head").alias("__head"))
    return (
        records.join(named, records[key] == F.col("__member"), "left")
        .withColumn(out, F.coalesce(F.col("__head"), records[key]))
        .drop("__member", "__head")
    )


def counted_links(links: DataFrame, relation: str = "same") -> DataFrame:
    """``(a, b)`` of the links whose relation, trimmed and lower-cased, is
    ``relation``, with both ends trimmed; null or blank ends do not count."""
    end = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    kind: Column = F.lower(F.trim(F.col("relation")))
    return links.where(kind == relation).select(end("a").alias("a"), end("b").alias("b")).where("a is not null and b is not null")

"""Filling containers of fixed capacity with texts, by optimal length buckets."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hybridrank.runtime import Scratch

#: How many length buckets at most, and items ranked by one task.
BUCKETS, RANK_ROWS = 256, 200_000


def _lower_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points, in order of ``x``, make up the lower convex hull.

    A point on or above the line between its neighbours of the moment cannot be
    part of it, so all such points go at once, until none is left.
    """
    at = np.arange(len(x))
    while len(at) > 2:
        a, b, c = at[:-2], at[1:-1], at[2:]
        below = (y[b] - y[a]) * (x[c] - x[b]) < (y[c] - y[b]) * (x[b] - x[a])
        if below.all():
            break
        at = np.concatenate([at[:1], b[below], at[-1:]])
    return at


def bucket_ends(counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most ``buckets`` buckets of lengths with the least padding.

    ``counts[n]`` items have length ``n``.  Padding is what is missing from an
    item to the end of its bucket, summed over all items.  Dynamic programming
    over the lengths that occur.  With ``M`` items and ``T`` tokens up to a
    length, a bucket after the length ``i`` that ends at ``j`` adds ``end[j] *
    (M[j] - M[i]) - (T[j] - T[i])``; so for all ``j`` of a layer at once, the
    best ``i`` lies on the lower hull of the points ``(M[i], best[i] + T[i])``,
    where its edges become steeper than ``end[j]``.  A layer takes time in the
    number of different lengths, give or take a logarithm, and memory in that
    number.
    """
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths > 0]
    m = len(lengths)
    if m <= buckets:
        return lengths.tolist()
    many = np.concatenate([[0], np.cumsum(counts[lengths])]).astype(float)
    total = np.concatenate([[0], np.cumsum(counts[lengths] * lengths)]).astype(float)
    ends = np.concatenate([[0], lengths]).astype(float)
    best = ends * many - total  # one bucket
    cuts = []
    for _ in range(buckets - 1):
        height = best + total
        hull = _lower_hull(many, height)
        steep = np.diff(height[hull]) / np.diff(many[hull])
        cut = hull[np.searchsorted(steep, ends, "left")]
        best = best[cut] + ends * (many - many[cut]) - (total - total[cut])
        cuts.append(cut.astype(np.int32))
    out, at = [], m
    for cut in reversed(cuts):
        if at == 0:
            break
        out.append(int(lengths[at - 1]))
        at = min(int(cut[at]), at - 1)
    if at:
        out.append(int(lengths[at - 1]))
    return out[::-1]


def plan_batches(capacity: int, ends: list[int], counts: list[int]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where the items of each bucket go: ``(bucket, first rank, items, first container, items a container)``.

    From the longest bucket down, batches of ``capacity // end`` items make
    containers.  What such a batch leaves free is a smaller budget, which
    batches of the shorter buckets fill first, the tightest gap before others.
    The plan grows with the number of buckets, not with the number of items.
    Returns the plan and the number of containers.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # free tokens, first container, containers
    used = 0
    for b in range(len(ends) - 1, -1, -1):
        end, left, rank = ends[b], counts[b], 0
        fitting = sorted(g for g in gaps if g[0] >= end)
        gaps = [g for g in gaps if g[0] < end]
        if left and not fitting or left:
            fitting.append((capacity, used, 0))  # containers still to be opened, as many as needed
        for free, first, n in fitting:
            if not left:
                if n:
                    gaps.append((free, first, n))
                continue
            each = free // end
            new = n == 0
            n = math.ceil(left / each) if new else n
            used += n if new else 0
            full = min(n, left // each)
            if full:
                plan.append((b, rank, full * each, first, each))
                gaps.append((free - each * end, first, full))
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                plan.append((b, rank, left, first + full, left))
                gaps.append((free - left * end, first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                gaps.append((free, first + full, n - full))
        gaps = [g for g in gaps if g[0] > 0]
    return plan, used


def pack(sizes: DataFrame, key: str, tokens: str, capacity: int, buckets: int = BUCKETS) -> DataFrame:
    """``(key, piece, start_token, n_tokens, container)`` for containers of ``capacity`` tokens.

    An item longer than the capacity is split into full pieces and a rest, from
    its start on; no other item is split.  Containers are numbered from 0.  Every row of
    ``sizes`` is kept: repeated keys are items of their own, and rows without
    tokens (0 or null) come out with a null container and no tokens.  An empty
    table gives an empty result; other columns are ignored.

    Lengths are put into the buckets with the least padding, found by dynamic
    programming over the global histogram (at most ``capacity`` rows reach the
    driver).  Batches form inside each bucket; what they leave free is filled by
    batches of shorter buckets (see ``plan_batches``).  Items take their places
    by their rank in their bucket, in the order of a hash of their key, so the
    result does not depend on how the table is partitioned.  Ranks are counted
    in salted parts of a bucket, so no bucket is ever gathered in one task.
    """
    if capacity < 1:
        raise ValueError("a container must hold a token")
    spark = sizes.sparkSession
    scratch = Scratch(spark, "pack")
    size = F.coalesce(F.col(f"`{tokens}`"), F.lit(0)).cast("long")
    rows = sizes.select(F.col(f"`{key}`").alias("key"), size.alias("size"))
    # At least one piece each, so that empty items come out as well.
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("int")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).select(
        "key", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.lit(capacity), F.col("size") - F.col("piece").cast("long") * capacity).cast("int").alias("n"),
        F.xxhash64("key", "piece").alias("row"),
    )
    pieces = scratch.keep(pieces, "pieces")
    seen = {r["n"]: r["count"] for r in pieces.where("n > 0").groupBy("n").count().collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in seen.items():
        counts[n] = c
    ends = bucket_ends(counts, buckets)
    inside = [int(counts[lo + 1 : hi + 1].sum()) for lo, hi in zip([0, *ends], ends)]
    plan, _ = plan_batches(capacity, ends, inside)
    names = "key", "piece", F.col("start").alias("start_token"), F.col("n").alias("n_tokens")
    empty = pieces.where("n <= 0").select(*names, F.lit(None).cast("long").alias("container"))
    if not plan:
        return empty

    bucket_of = spark.createDataFrame([(n, int(np.searchsorted(ends, n))) for n in seen], "n int, bucket int")
    salts = max(1, math.ceil(sum(inside) / RANK_ROWS))
    salted = pieces.where("n > 0").join(F.broadcast(bucket_of), "n").withColumn("salt", F.pmod(F.col("row"), F.lit(salts)).cast("int"))
    parts = salted.groupBy("bucket", "salt").agg(F.count(F.lit(1)).alias("many"))
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("bucket", "salt", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("offset"))
    ranked = salted.withColumn("place", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("row", "key", "piece", "n")) - 1)
    ranked = ranked.join(parts, ["bucket", "salt"]).withColumn("rank", F.col("place") + F.col("offset"))
    ranges = F.broadcast(spark.createDataFrame(plan, "in_bucket int, first_rank long, items long, first_container long, each long"))
    inside_range = (F.col("bucket") == F.col("in_bucket")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("items"))
    container = F.col("first_container") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("each"))
    return ranked.join(ranges, inside_range).select(*names, container.cast("long").alias("container")).unionByName(empty)

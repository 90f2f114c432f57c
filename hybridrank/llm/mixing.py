"""Mixing sources to target shares of all tokens, by Sainte-Laguë apportionment."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hybridrank.runtime import Scratch

#: How many blocks the whole mix has at least, and blocks of a shard; tokens of a shard at least, and shards of all sources at most.
BLOCKS, SHARD_BLOCKS, SHARD_TOKENS, SHARDS = 10_000, 16, 1 << 25, 1 << 16


def sainte_lague(weights: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """``seats`` given one by one to the highest quotient ``weight / (2 * given + 1)``.

    Nobody gets more than ``most``; seats that nobody may take stay empty.
    Ties go to whoever is listed first.  All seats but about one per weight are
    given at once: with a divisor above the final one, everybody's rounded
    share is a part of the final number.
    """
    most = [seats] * len(weights) if most is None else most
    given = [0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and most[i] > 0]
    while open_ and seats - sum(given) > 2 * len(open_):
        left = seats - sum(given) + sum(given[i] for i in open_)
        divisor = sum(weights[i] for i in open_) / max(1, left - len(open_))
        for i in open_:
            given[i] = min(most[i], max(given[i], math.ceil(weights[i] / divisor - 0.5)))
        full = [i for i in open_ if given[i] >= most[i]]
        if not full:
            break
        open_ = [i for i in open_ if given[i] < most[i]]
    heap = [(-weights[i] / (2 * given[i] + 1), i) for i, w in enumerate(weights) if w > 0 and given[i] < most[i]]
    heapq.heapify(heap)
    seats -= sum(given)
    while seats and heap:
        _, i = heapq.heappop(heap)
        given[i] += 1
        seats -= 1
        if given[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * given[i] + 1), i))
    return given


def mix(sizes: DataFrame, source: str, tokens: str, targets: DataFrame, total: int | None = None, seed: int = 11, blocks: int = BLOCKS) -> DataFrame:
    """The rows of ``sizes`` in the mix, with ``times``: how often each is used.

    ``targets`` holds ``source``, ``target_share`` and ``max_repeats`` (how often
    a row may be used at most); it is read to the driver, one row a source.
    ``total`` is the wanted size of the mix in tokens; by default it is the
    largest at which every source can fill its share.  Rows without tokens, of
    other sources or with a null source are left out.  A target source without
    tokens contributes nothing, and the others keep their proportions.  If a
    given total is out of reach of a source, that source gives all it may, and
    the others do not make up for it.  Repeated rows are rows of their own; an
    empty table gives an empty mix.  Columns keep their names, but a column
    ``times`` is replaced.

    The total is cut into ``blocks`` blocks of equal size, which Sainte-Laguë
    apportions to the sources, and those of a source to its shards, by their
    tokens.  Rows stand in a shard in seeded order, in blocks; a shard gives as
    many whole passes as its quota holds, and then its first blocks.  Shards
    are hashed parts of a source, so no source is gathered in one task.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "mix")
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").collect()}
    keep = [c for c in sizes.columns if c != "times"]
    packed = sizes.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("whole"), F.col(f"`{source}`").alias("s"), F.col(f"`{tokens}`").cast("long").alias("n"))
    rows = scratch.keep(packed.where((F.col("n") > 0) & F.col("s").isin(list(wanted))).withColumn("row", F.xxhash64("whole")), "rows")
    has = {r["s"]: r["n"] for r in rows.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    names = sorted(has)
    whole = sum(wanted[s][0] for s in names)
    share = {s: wanted[s][0] / whole for s in names}
    if total is None and names:
        total = int(min(has[s] * wanted[s][1] / share[s] for s in names))
    out = [F.col(f"whole.`{c}`").alias(c) for c in keep]
    if not names or not total:
        return rows.limit(0).select(*out, F.lit(0).alias("times"))
    shard_tokens = max(SHARD_TOKENS, sum(has.values()) / SHARDS)
    # Every shard has blocks to give, however many shards there are.
    block = max(min(total / blocks, shard_tokens / SHARD_BLOCKS), 1.0)
    quota = sainte_lague([share[s] for s in names], round(total / block), [math.floor(has[s] * wanted[s][1] / block + 0.5) for s in names])

    shards = {s: math.ceil(has[s] / shard_tokens) for s in names}
    per = spark.createDataFrame([(s, shards[s]) for s in names], "s string, shards int")
    placed = rows.join(F.broadcast(per), "s").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "row"), F.col("shards")).cast("int"))
    sums: dict[str, list[tuple[int, int]]] = {s: [] for s in names}
    for r in placed.groupBy("s", "shard").agg(F.sum("n").alias("n")).collect():
        sums[r["s"]].append((r["shard"], r["n"]))
    quotas = []
    for s, q in zip(names, quota):
        part = sorted(sums[s])
        most = wanted[s][1]
        for (shard, n), given in zip(part, sainte_lague([float(n) for _, n in part], q)):
            passes = min(most, int(given * block // n))
            rest = 0.0 if passes >= most else given * block - passes * n
            quotas.append((s, shard, passes, round(rest / block)))
    parts = spark.createDataFrame(quotas, "s string, shard int, passes int, more long")
    order = Window.partitionBy("s", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "row"), "row", "n")
    start = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    # A row belongs to the block in which its middle lies, so that long rows do not all round one way.
    chosen = placed.withColumn("block", F.floor((start + F.col("n") / 2) / block)).join(F.broadcast(parts), ["s", "shard"])
    used = F.col("passes") + (F.col("block") < F.col("more")).cast("int")
    return chosen.withColumn("times", used).where("times > 0").select(*out, "times")


def shares(mixed: DataFrame, source: str, tokens: str, targets: DataFrame) -> DataFrame:
    """The shares a mix reached: one row per target source, with its rows and tokens used."""
    used = mixed.groupBy(F.col(source).alias("source")).agg(
        F.sum(F.col(tokens) * F.col("times")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("times").alias("most_times")
    )
    out = targets.select("source", "target_share", "max_repeats").join(used, "source", "left").fillna(0, ["tokens", "documents", "most_times"])
    return out.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)))

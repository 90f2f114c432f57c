"""Exact dense retrieval: full scans with partial top-k lists per batch of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries whose vectors are held by every task at once; more are scanned in further passes.
QUERY_BLOCK = 4096
#: Fixed value: the distance of the best score from the mean, in deviations, below which a match is weak.
WEAK_BELOW = 3.85


class _Scan:
    def __init__(self, ids: list, matrix: np.ndarray, k: int):
        self.ids, self.matrix, self.k = ids, matrix, k

    def __call__(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            rows = np.stack(f["vec"].to_numpy()).astype(np.float64)
            scores = np.round((rows @ self.matrix.T) * f["scale"].to_numpy()[:, None] + f["prior"].to_numpy()[:, None], 9)
            pos = f["pos"].to_numpy()
            k = min(self.k, len(pos))
            for j, qid in enumerate(self.ids):
                s = scores[:, j]
                best = np.lexsort((pos, -s))[:k]
                yield pd.DataFrame({"query_id": [qid], "pos": [pos[best].tolist()], "score": [s[best].tolist()], "n": [len(s)], "mean": [float(s.mean())], "m2": [float(((s - s.mean()) ** 2).sum())]})


def scan(index: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``(query_id, n, mean, std, best)`` of a full scan for every query.

    ``index`` holds ``pos, vec, scale, prior``: a score is the dot product of the
    unit query with ``vec``, times ``scale``, plus ``prior``.  ``queries`` holds
    ``query_id`` (long) and ``vec``.  ``best`` lists ``(pos, score)`` by
    score, ties by position.  ``mean`` and ``std`` (of the population) are over
    all rows.  Every batch of rows sends only its own best and its moments, so
    the shuffle grows with batches and queries, not with their product.
    """
    asked = queries.select("query_id", "vec").collect()  # a stated query set, taken in blocks
    parts = None
    for lo in range(0, len(asked), QUERY_BLOCK):
        block = asked[lo : lo + QUERY_BLOCK]
        m = np.array([r["vec"] for r in block], np.float64)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        part = index.select("pos", "vec", F.col("scale").cast("double"), F.col("prior").cast("double")).mapInPandas(
            _Scan([r["query_id"] for r in block], m, k), "query_id long, pos array<long>, score array<double>, n long, mean double, m2 double"
        )
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return index.sparkSession.createDataFrame([], "query_id long, n long, mean double, std double, best array<struct<pos:long,score:double>>")
    listed = F.transform(F.flatten(F.collect_list(F.arrays_zip("score", "pos"))), lambda x: F.struct((-x["score"]).alias("far"), x["pos"].alias("pos")))
    total, first = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    merged = parts.groupBy("query_id").agg(total.alias("n"), (first / total).alias("mean"), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")).alias("sq"), F.slice(F.array_sort(listed), 1, k).alias("best"))
    variance = F.greatest(F.col("sq") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0))
    return merged.select("query_id", "n", "mean", F.sqrt(variance).alias("std"), F.transform("best", lambda b: F.struct(b["pos"].alias("pos"), (-b["far"]).alias("score"))).alias("best"))


def ranked(scanned: DataFrame) -> DataFrame:
    """``(query_id, pos, score, rank)`` of a scan."""
    return scanned.select("query_id", F.posexplode("best").alias("n", "b")).select("query_id", "b.pos", "b.score", (F.col("n") + 1).alias("rank"))


def match_strength(top: Column, mean: Column, std: Column) -> Column:
    """Whether the best score stands out from all scores."""
    return F.when(top.isNull() | (std <= 0) | ((top - mean) / std < WEAK_BELOW), "weak").otherwise("normal")


def ranking_prior(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``(pos, prior)``: a small bonus for vivid and frequent entries and those of the standard dictionary, a malus for phrases."""
    most = rows.agg(F.greatest(F.lit(1.0), F.coalesce(F.max("frequency"), F.lit(1.0))).alias("most"))
    r = rows.join(F.broadcast(most))  # one row
    bonus = weights["vividness"] * (F.col("vividness") - 1) / 2 + weights["frequency"] * F.log1p("frequency") / F.log1p("most") + weights["xinhua"] * F.col("xinhua")
    return r.select("pos", (bonus - weights["set_phrase"] * (F.col("kind") != "chengyu").cast("int")).alias("prior"))


def similar_items(index: DataFrame, asked: DataFrame, related: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, pos, score, rank)``: the nearest rows, without the row itself and those ``related`` to it.

    ``related`` holds ``query_id, pos`` and must name at most ``3 k`` rows a query for the list to stay full.
    """
    wide = ranked(scan(index, asked, 4 * k + 1)).where("query_id <> pos")
    rest = wide.join(related, ["query_id", "pos"], "left_anti")
    return rest.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)

"""Families of headwords: clusters of the same idiom and links between clusters.

A family is kept as membership and cluster links, never as all pairs.  Related
headwords are listed only for headwords that are asked about.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hybridrank.functions.text import compact, plain_pinyin
from hybridrank.runtime import Scratch


def clean_links(links: DataFrame) -> DataFrame:
    """``(link_no, a, b, relation, common)``: trimmed links of a known relation with two different ends, each once."""
    end = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    out = links.select("link_no", end("a").alias("a"), end("b").alias("b"), F.lower(F.trim("relation")).alias("relation"), F.lower(F.trim("common")).alias("common"))
    return out.where("a is not null and b is not null and a <> b and relation in ('same', 'full_form')").distinct()


#: Links that one task ties.
LINKS_PER_TASK = 250_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b)`` of every end but the least of what the links of a task tie, with the least one."""
    above: dict[str, str] = {}

    def least(x: str) -> str:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for batch in batches:
        for x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b"))):
            x, y = least(x), least(y)
            above[max(x, y)] = min(x, y)
    ends = [(x, least(x)) for x in list(above)]
    ends = [e for e in ends if e[0] != e[1]]
    for lo in range(0, len(ends), 10_000):
        yield pa.RecordBatch.from_pydict({"a": [x for x, _ in ends[lo : lo + 10_000]], "b": [y for _, y in ends[lo : lo + 10_000]]}, pa.schema([("a", pa.string()), ("b", pa.string())]))


def clusters(links: DataFrame) -> DataFrame:
    """``(headword, cluster)`` of every linked headword; the cluster is its least member.

    Each task first ties what its own share of the ``same`` links ties; where
    they are one task's work, that is all.  Else least labels spread over what
    is left and along the labels themselves, so that a chain takes a number of
    rounds in the logarithm of its length.
    """
    scratch = Scratch(links.sparkSession, "clusters")
    heads = links.select(F.col("a").alias("headword")).union(links.select("b")).distinct()
    same = links.where("relation = 'same'").select("a", "b")
    same = scratch.keep(same.distinct(), "same", n=F.count(F.lit(1)))
    parts = max(1, math.ceil(scratch.facts["n"] / LINKS_PER_TASK))
    stars = scratch.keep(same.repartition(parts).mapInArrow(_stars, "a string, b string"), "stars")
    if parts == 1:
        return scratch.keep(heads.join(stars, heads["headword"] == stars["a"], "left").select("headword", F.coalesce("b", "headword").alias("cluster")), "labels")
    edges = scratch.keep(stars.union(stars.select("b", "a")).distinct(), "edges")
    labels = scratch.keep(heads.withColumn("cluster", F.col("headword")), "labels-0")
    changed, i = 1, 0
    while changed:
        i += 1
        near = edges.join(labels, edges["b"] == labels["headword"]).groupBy("a").agg(F.min("cluster").alias("near"))
        met = labels.join(near, labels["headword"] == near["a"], "left").select("headword", F.col("cluster").alias("old"), F.least("cluster", F.coalesce("near", "cluster")).alias("mid"))
        jump = labels.select(F.col("headword").alias("mid"), F.col("cluster").alias("far"))
        now = met.join(jump, "mid").select("headword", F.least("mid", "far").alias("cluster"), "old")
        labels = scratch.keep(now, f"labels-{i}", changed=F.count_if(F.col("cluster") != F.col("old"))).drop("old")
        changed = scratch.facts["changed"]
        if i > 1:
            scratch.drop(f"labels-{i - 2}")
    return labels


def cluster_links(links: DataFrame, cluster: DataFrame) -> DataFrame:
    """``(cluster, other)``: clusters that a full form ties, both ways, one hop only."""
    of = lambda c, n: cluster.select(F.col("headword").alias(c), F.col("cluster").alias(n))
    tied = links.where("relation = 'full_form'").join(of("a", "ca"), "a").join(of("b", "cb"), "b").where("ca <> cb").select("ca", "cb")
    return tied.union(tied.select("cb", "ca")).distinct().toDF("cluster", "other")


def common_forms(links: DataFrame, cluster: DataFrame) -> DataFrame:
    """``(cluster, common, votes)``: the form of a cluster that wins the most pairwise votes, the first listed on a tie."""
    seen = links.select(F.col("a").alias("headword"), (F.col("link_no") * 2).alias("seen")).union(links.select("b", F.col("link_no") * 2 + 1)).groupBy("headword").agg(F.min("seen").alias("seen"))
    cast = links.where("relation = 'same' and common in ('a', 'b')")
    won = lambda side, n: cast.select(F.col(side).alias("headword"), (F.when(F.col("common") == side, 1).otherwise(-1)).alias("v"))
    votes = won("a", 1).union(won("b", -1)).groupBy("headword").agg(F.sum("v").alias("votes"))
    all_ = cluster.join(seen, "headword").join(votes, "headword", "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    best = all_.groupBy("cluster").agg(F.min(F.struct((-F.col("votes")).alias("v"), "seen", "headword")).alias("m"))
    return best.select("cluster", F.col("m.headword").alias("common"), (-F.col("m.v")).alias("votes"))


def preferred_forms(common: DataFrame, cluster: DataFrame, tied: DataFrame, headlines: DataFrame) -> DataFrame:
    """``(cluster, preferred)``: the common form, or that of the short form a headline names; a headline needs a link."""
    of = lambda c, n: cluster.select(F.col("headword").alias(c), F.col("cluster").alias(n))
    named = headlines.join(of("full", "cluster"), "full").join(of("short", "other"), "short").join(tied, ["cluster", "other"], "left_semi")
    by_line = named.join(common.select(F.col("cluster").alias("other"), F.col("common").alias("short_form")), "other").groupBy("cluster").agg(F.min("short_form").alias("short_form"))
    return common.join(by_line, "cluster", "left").select("cluster", F.coalesce("short_form", "common").alias("preferred"))


def related_of(asked: DataFrame, cluster: DataFrame, tied: DataFrame) -> DataFrame:
    """``(headword, other, relation)`` for the headwords in ``asked``: its own cluster, and those one full form away."""
    mine = asked.select("headword").distinct().join(cluster, "headword")
    members = cluster.select(F.col("headword").alias("other"), F.col("cluster").alias("of"))
    same = mine.join(members, F.col("cluster") == F.col("of")).where("headword <> other").select("headword", "other", F.lit("same").alias("relation"))
    far = mine.join(tied.withColumnRenamed("other", "of"), "cluster").join(members, "of").select("headword", "other", F.lit("full_form").alias("relation"))
    return same.unionByName(far)


def variants_of(asked: DataFrame, cluster: DataFrame, tied: DataFrame, common: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(headword, variants)``: every sense of every related headword, in order, for the headwords asked about."""
    head = F.coalesce(F.nullif(F.trim("simplified"), F.lit("")), F.col("chengyu"))
    senses = corpus.select(head.alias("other"), "pos", "id", "pinyin", F.coalesce("traditional", "chengyu").alias("traditional"))
    rows = related_of(asked, cluster, tied).join(senses, "other").join(cluster.select(F.col("headword").alias("other"), "cluster"), "other").join(common.select("cluster", "common"), "cluster")
    listed = F.sort_array(F.collect_list(F.struct((F.col("relation") != "same").alias("far"), "other", "pos", "id", "traditional", "pinyin", (F.col("other") == F.col("common")).alias("common"))))
    return rows.groupBy("headword").agg(listed.alias("variants"))


def display_entries(rows: DataFrame, cluster: DataFrame, preferred: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(query, pos, shown)``: the entry to show for each result, the first sense of its family's preferred form.

    An entry stays as it is outside families, where it is the preferred form,
    where the query is typed exactly as it, and where no entry has that form.
    ``rows`` holds ``query, pos``, ``preferred`` comes from ``preferred_forms``.
    """
    head = F.coalesce(F.nullif(F.trim("simplified"), F.lit("")), F.col("chengyu"))
    named = corpus.withColumn("headword", F.trim(head))
    first = named.groupBy("headword").agg(F.min("pos").alias("swap")).withColumnRenamed("headword", "preferred")
    met = rows.select("query", "pos").join(named, "pos").join(cluster, "headword", "left").join(preferred, "cluster", "left").join(first, "preferred", "left")
    own = typed_exactly(F.col("query"), F.coalesce("simplified", "chengyu"), F.coalesce("traditional", "chengyu"), F.col("chengyu"), F.col("pinyin"))
    stays = own | F.col("preferred").isNull() | (F.col("preferred") == F.col("headword")) | F.col("swap").isNull()
    return met.select("query", "pos", F.when(F.coalesce(stays, F.lit(True)), F.col("pos")).otherwise(F.col("swap")).alias("shown"))


def variant_groups(related: DataFrame, cluster: DataFrame, common: DataFrame) -> DataFrame:
    """``(headword, other, kind)``: related forms by how they are shown.

    Forms of the same idiom are ``same``; of those one full form away only the
    common one is listed, as ``full`` if it is longer than the headword, else
    ``short``.  ``related`` comes from ``related_of``.
    """
    usual = cluster.join(common.select("cluster", "common"), "cluster").select(F.col("headword").alias("other"), (F.col("headword") == F.col("common")).alias("usual"))
    rows = related.join(usual, "other", "left").where("relation <> 'full_form' or coalesce(usual, true)")
    kind = F.when(F.col("relation") != "full_form", "same").when(F.length("other") > F.length("headword"), "full").otherwise("short")
    return rows.select("headword", "other", kind.alias("kind"))


def collapse(ranked: DataFrame, cluster: DataFrame, tied: DataFrame) -> DataFrame:
    """``ranked`` without rows related to a row that is kept before them.

    ``ranked`` holds ``query, rank, headword`` and passes on its other columns.
    What is kept decides what is dropped, so each list is walked in order; it
    holds a page's window of rows, whatever the corpus.  The walk is stable: a
    longer list begins with the result of a shorter one.
    """
    near = tied.groupBy("cluster").agg(F.sort_array(F.collect_set("other")).alias("near"))
    rows = ranked.join(cluster, "headword", "left").join(near, "cluster", "left")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, kept = (), {}
        for batch in batches:
            keep = []
            for query, head, own, others in zip(*(batch.column(c).to_pylist() for c in ("query", "headword", "cluster", "near"))):
                if query != before:
                    before, kept = query, {}
                drop = own is not None and any(kept[c] - {head} for c in (own, *(others or ())) if c in kept)
                keep.append(not drop)
                if own is not None and not drop:
                    kept.setdefault(own, set()).add(head)
            yield batch.filter(pa.array(keep, pa.bool_()))

    # Lists follow one another in a task, and may go over from one batch to the next: a frame for each would cost more than the walk.
    out = rows.repartition("query").sortWithinPartitions("query", "rank").mapInArrow(walk, rows.schema).drop("cluster", "near")
    return out.withColumn("collapsed_rank", F.row_number().over(Window.partitionBy("query").orderBy("rank")))


def typed_exactly(query: Column, simplified: Column, traditional: Column, headword: Column, pinyin: Column) -> Column:
    """Whether a query is a form of an entry, or its reading, letter for letter."""
    typed = compact(query)
    forms = F.array(compact(simplified), compact(traditional), compact(headword))
    reading = F.replace(plain_pinyin(pinyin), F.lit(" "), F.lit(""))
    return (typed != "") & (F.array_contains(forms, typed) | ((reading != "") & (reading == F.replace(plain_pinyin(query), F.lit(" "), F.lit("")))))

"""Queries on vectors, fused rankings and families of headwords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridrank.functions import query as Q
from hybridrank.functions import vectors as V
from hybridrank.operators import families as M
from hybridrank.operators import fusion as G
from hybridrank.operators import lexical as L
from hybridrank.operators import vectors as D
from hybridrank.plans import sql as S
from hybridrank.plans.catalogue import query
from hybridrank.plans.text_queries import _scored_sql, corpus, known_syllables, log_queries, scored_ctes
from hybridrank.runtime import Scratch, table


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("pos"), V.unit(F.col("embedding")).alias("vec"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("prior"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"


@query(f"SELECT a.vec_id AS query_id, b.vec_id AS pos, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 QUALIFY rank <= 20")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ranked(D.scan(_index(spark, sf_dir), _asked(spark, sf_dir), 20)).withColumn("score", F.round("score", 6))


@query("SELECT a.vec_id AS query_id, b.vec_id AS pos, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0")
def cosine_same_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines as a column expression, within a label."""
    e = table(spark, sf_dir, "embeddings")
    a = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"), "label")
    return a.join(e, "label").select("query_id", F.col("vec_id").alias("pos"), F.round(V.cosine(F.col("v"), F.col("embedding")), 6).alias("cosine"))


def _int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), V.int8(F.col("embedding")).alias("vec"))
    return q.withColumn("scale", V.int8_scale(F.col("vec"))).withColumn("prior", F.lit(0.0))


_BYTES = "list_transform(embedding, lambda x: greatest(-127, least(127, floor(x::DOUBLE / list_max(list_transform(embedding, lambda y: abs(y::DOUBLE))) * 127 + 0.5)))::TINYINT)"


@query(f"SELECT vec_id AS pos, array_to_string({_BYTES}, ' ') AS bytes, round((1 / sqrt(list_sum(list_transform({_BYTES}, lambda x: x::DOUBLE * x)))), 6) AS scale FROM embeddings")
def int8_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _int8(spark, sf_dir).select("pos", F.array_join(F.col("vec").cast("array<string>"), " ").alias("bytes"), F.round(1 / V.norm(F.col("vec")), 6).alias("scale"))


@query(
    f"""WITH b AS (SELECT vec_id, {_BYTES} AS q FROM embeddings), i AS (SELECT vec_id, q, (1 / sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x))))::FLOAT::DOUBLE AS scale FROM b),
s AS (SELECT a.vec_id AS query_id, i.vec_id AS pos, round(list_dot_product(list_transform(a.embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))), i.q::DOUBLE[]) * i.scale, 9) AS x FROM embeddings a, i WHERE a.vec_id % 100 = 0)
SELECT query_id, pos, round(x, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, pos) AS rank FROM s QUALIFY rank <= 20"""
)
def int8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ranked(D.scan(_int8(spark, sf_dir), _asked(spark, sf_dir), 20)).withColumn("score", F.round("score", 6))


@query(
    f"""WITH s AS (SELECT a.vec_id AS query_id, {_COS} AS x FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
SELECT query_id, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, CASE WHEN (max(x) - avg(x)) / stddev_pop(x) < {D.WEAK_BELOW} THEN 'weak' ELSE 'normal' END AS strength FROM s GROUP BY query_id"""
)
def match_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.scan(_index(spark, sf_dir), _asked(spark, sf_dir), 1)
    return s.select("query_id", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), D.match_strength(F.get(F.col("best"), F.lit(0))["score"], F.col("mean"), F.col("std")).alias("strength"))


@query(f"WITH {S.CORPUS} SELECT pos, round(0.03 * (2 - 1) / 2.0 + 0.01 * ln(1 + coalesce(frequency, 0)) / ln(1 + greatest(1.0, (SELECT max(frequency) FROM corpus WHERE NOT isnan(frequency)))) - 0.015 * (kind <> 'chengyu')::INT, 9) AS prior FROM corpus")
def ranking_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).select("pos", "kind", F.coalesce("frequency", F.lit(0.0)).alias("frequency"), F.lit(2).alias("vividness"), F.lit(0).alias("xinhua"))
    return D.ranking_prior(rows, {"vividness": 0.03, "frequency": 0.01, "xinhua": 0.005, "set_phrase": 0.015}).withColumn("prior", F.round("prior", 9))


@query(
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS pos, {_COS} AS x FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND b.vec_id <> a.vec_id + 1)
SELECT query_id, pos, round(x, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, pos) AS rank FROM s QUALIFY rank <= 5"""
)
def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows to each asked row, leaving out itself and the row after it."""
    asked = _asked(spark, sf_dir)
    related = asked.select("query_id", (F.col("query_id") + 1).alias("pos"))
    return D.similar_items(_index(spark, sf_dir), asked, related).withColumn("score", F.round("score", 6))


def _channels(spark: SparkSession, sf_dir: str):
    scratch = Scratch(spark, "channels")
    c, q = scratch.keep(corpus(spark, sf_dir), "corpus"), scratch.keep(log_queries(spark, sf_dir), "queries")
    asked = scratch.keep(L.asked(q), "asked")
    semantic = L.token_topk(L.TokenIndex(c), asked).withColumn("score", F.least(F.col("score") / 3, F.lit(1.0)))
    keyword = L.first_containing(c.select("pos", F.lower("meaning").alias("text")), asked.select("query", F.lower("query").alias("low")), 20).withColumn("score", F.lit(0.8))
    types = q.select("query", Q.query_type(F.col("query"), known_syllables(spark, sf_dir)).alias("query_type"))
    return semantic, keyword, L.exact_pinyin(c, q), types


_FUSED = _scored_sql(
    f""",
sem AS (SELECT query, pos, least(score / 3, 1.0) AS s, row_number() OVER (PARTITION BY query ORDER BY score DESC, pos) AS r FROM s QUALIFY r <= 20),
kw AS (SELECT q_.query, c.pos, 0.8 AS w, row_number() OVER (PARTITION BY q_.query ORDER BY c.pos) AS r FROM q_ JOIN corpus c ON contains(lower(c.meaning), lower(q_.query)) QUALIFY r <= 20),
px AS (SELECT query, pos FROM asked JOIN corpus ON {S.plain_pinyin('query')} = {S.plain_pinyin('pinyin')} WHERE NOT {S.has_han('query')} AND {S.plain_pinyin('query')} <> ''),
keys AS (SELECT query, pos FROM sem UNION SELECT query, pos FROM kw UNION SELECT query, pos FROM px),
typed AS (SELECT query, {S.query_type('query')} AS t FROM asked, syl),
fused AS (SELECT k.query, k.pos, round(CASE WHEN px.pos IS NOT NULL THEN 11.0 ELSE coalesce(s, 0) * CASE t WHEN 'english_meaning' THEN 0.72 ELSE 0.85 END + coalesce(w, 0) * CASE t WHEN 'english_meaning' THEN 0.28 ELSE 0.15 END + CASE WHEN s IS NOT NULL AND w IS NOT NULL THEN 0.16 ELSE 0 END END, 9)::DOUBLE AS score,
  CASE WHEN s IS NOT NULL AND w IS NOT NULL THEN 'both' WHEN s IS NOT NULL THEN 'semantic' WHEN w IS NOT NULL THEN 'keyword' ELSE 'pinyin_exact' END AS source,
  CASE WHEN s IS NOT NULL THEN 0 WHEN w IS NOT NULL THEN 1 ELSE 2 END AS o1, coalesce(sem.r, kw.r, k.pos) AS o2
  FROM keys k LEFT JOIN sem USING (query, pos) LEFT JOIN kw USING (query, pos) LEFT JOIN px ON px.query = k.query AND px.pos = k.pos JOIN typed ON typed.query = k.query),
ranked AS (SELECT query, pos, score, source, row_number() OVER (PARTITION BY query ORDER BY score DESC, o1, o2) AS rank FROM fused QUALIFY rank <= 10)"""
)


@query(_FUSED + " SELECT query, pos, score, source, rank FROM ranked")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token scores, phrase matches and exact readings as one ranking."""
    return G.fuse(*_channels(spark, sf_dir))


@query(_FUSED + ", p AS (SELECT *, max(rank) OVER (PARTITION BY query) > 8 AS has_more FROM ranked) SELECT query, rank, c.id, CAST(greatest(0, least(100, floor(score * 100 + 0.5))) AS INTEGER) AS relevance_score, has_more, CASE WHEN has_more THEN 8 END AS next_offset FROM p JOIN corpus c USING (pos) WHERE rank > 3 AND rank <= 8")
def hydrate_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page, of five results after the first three, with the fields of the entries."""
    rows = G.payload(G.page(G.fuse(*_channels(spark, sf_dir)), 3, 5), corpus(spark, sf_dir))
    return rows.select("query", "rank", "id", "relevance_score", "has_more", "next_offset")


@query(
    _FUSED
    + """, raw AS (SELECT query, rank, pos, score, length(c.chengyu)::DOUBLE + c.pos % 7 AS x FROM ranked JOIN corpus c USING (pos)),
h AS (SELECT *, min(CASE WHEN rank <= 5 THEN x END) OVER w AS lo, max(CASE WHEN rank <= 5 THEN x END) OVER w AS hi, count(*) OVER w AS n FROM raw WINDOW w AS (PARTITION BY query)),
b AS (SELECT *, CASE WHEN rank <= 5 THEN score * 0.7 + CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0.5 END * 0.3 END AS blend FROM h),
f AS (SELECT query, pos, rank AS before, CASE WHEN n < 2 THEN score WHEN rank <= 5 THEN blend ELSE least(score, min(blend) OVER (PARTITION BY query) - (rank - 5) * 1e-12) END AS new FROM b)
SELECT query, pos, round(new, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY new DESC, before) AS rank FROM f"""
)
def minmax_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five results blended with an outside score, here made of the entry itself."""
    ranked = Scratch(spark, "fused").keep(G.fuse(*_channels(spark, sf_dir)), "ranked")
    raw = ranked.select("query", "pos").join(corpus(spark, sf_dir), "pos").select("query", "pos", (F.length("chengyu").cast("double") + F.col("pos") % 7).alias("raw"))
    return G.minmax_rerank(ranked, raw, 5, 0.3).withColumn("score", F.round("score", 6))


_LINKS = """links AS (SELECT DISTINCT link_no, trim(a) AS a, trim(b) AS b, lower(trim(relation)) AS relation, lower(trim(common)) AS common FROM variant_families
  WHERE trim(a) <> '' AND trim(b) <> '' AND trim(a) <> trim(b) AND lower(trim(relation)) IN ('same', 'full_form')),
heads AS (SELECT a AS headword FROM links UNION SELECT b FROM links),
edges AS (SELECT a AS x, b AS y FROM links WHERE relation = 'same' UNION SELECT b, a FROM links WHERE relation = 'same'),
reach AS (SELECT headword AS x, headword AS y FROM heads UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
cl AS (SELECT x AS headword, min(y) AS cluster FROM reach GROUP BY x),
tied AS (SELECT DISTINCT ca.cluster, cb.cluster AS other FROM (SELECT a, b FROM links WHERE relation = 'full_form' UNION SELECT b, a FROM links WHERE relation = 'full_form') l JOIN cl ca ON ca.headword = l.a JOIN cl cb ON cb.headword = l.b WHERE ca.cluster <> cb.cluster)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.clean_links(table(spark, sf_dir, "variant_families"))


@query(f"WITH RECURSIVE {_LINKS} SELECT headword, cluster FROM cl")
def family_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.clusters(_links(spark, sf_dir))


@query(f"WITH RECURSIVE {_LINKS} SELECT cluster, other FROM tied")
def family_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    return M.cluster_links(links, M.clusters(links))


@query(
    f"""WITH RECURSIVE {_LINKS}, seen AS (SELECT headword, min(n) AS seen FROM (SELECT a AS headword, link_no * 2 AS n FROM links UNION ALL SELECT b, link_no * 2 + 1 FROM links) GROUP BY headword),
v AS (SELECT headword, sum(v) AS votes FROM (SELECT a AS headword, CASE common WHEN 'a' THEN 1 ELSE -1 END AS v FROM links WHERE relation = 'same' AND common IN ('a', 'b') UNION ALL SELECT b, CASE common WHEN 'b' THEN 1 ELSE -1 END FROM links WHERE relation = 'same' AND common IN ('a', 'b')) GROUP BY headword)
SELECT cluster, headword AS common, coalesce(votes, 0)::BIGINT AS votes FROM cl JOIN seen USING (headword) LEFT JOIN v USING (headword) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY coalesce(votes, 0) DESC, seen, headword) = 1"""
)
def common_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    return M.common_forms(links, M.clusters(links))


@query(
    f"""WITH RECURSIVE {_LINKS}, {S.CORPUS}, ask AS (SELECT DISTINCT trim(chengyu, ' ') AS headword FROM corpus WHERE pos % 100 = 0)
SELECT headword, o.headword AS other, 'same' AS relation FROM ask JOIN cl m USING (headword) JOIN cl o ON o.cluster = m.cluster AND o.headword <> m.headword
UNION ALL SELECT ask.headword, o.headword, 'full_form' FROM ask JOIN cl m USING (headword) JOIN tied t ON t.cluster = m.cluster JOIN cl o ON o.cluster = t.other"""
)
def family_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The related headwords of every entry whose position is divisible by 100."""
    links = _links(spark, sf_dir)
    c = M.clusters(links)
    asked = corpus(spark, sf_dir).where("pos % 100 = 0").select(F.trim("chengyu").alias("headword"))
    return M.related_of(asked, c, M.cluster_links(links, c))


@query(
    f"""WITH RECURSIVE {_LINKS}, {S.CORPUS}, ask AS (SELECT DISTINCT trim(chengyu, ' ') AS headword FROM corpus WHERE pos % 100 = 0),
rel AS (SELECT ask.headword, o.headword AS other, 0 AS far FROM ask JOIN cl m USING (headword) JOIN cl o ON o.cluster = m.cluster AND o.headword <> m.headword
 UNION ALL SELECT ask.headword, o.headword, 1 FROM ask JOIN cl m USING (headword) JOIN tied t ON t.cluster = m.cluster JOIN cl o ON o.cluster = t.other),
sense AS (SELECT coalesce(nullif(trim(simplified, ' '), ''), chengyu) AS other, pos FROM corpus)
SELECT headword, count(*)::INT AS senses, string_agg(other, ',' ORDER BY far, other, pos) AS others FROM rel JOIN sense USING (other) GROUP BY headword"""
)
def family_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sense of the relatives of every entry whose position is divisible by 100."""
    links = _links(spark, sf_dir)
    c = M.clusters(links)
    tied, common = M.cluster_links(links, c), M.common_forms(links, c)
    e = corpus(spark, sf_dir)
    asked = e.where("pos % 100 = 0").select(F.trim("chengyu").alias("headword"))
    return M.variants_of(asked, c, tied, common, e).select("headword", F.size("variants").alias("senses"), F.array_join(F.transform("variants", lambda v: v["other"]), ",").alias("others"))


@query(
    f"""WITH RECURSIVE {_LINKS}, {scored_ctes()},
near AS (SELECT cluster, list(other) AS near FROM tied GROUP BY cluster),
top AS (SELECT query, pos, row_number() OVER (PARTITION BY query ORDER BY score DESC, pos) AS rank FROM s QUALIFY rank <= 40),
r AS (SELECT top.query, top.pos, top.rank, trim(c.chengyu, ' ') AS headword, cl.cluster, list_prepend(cl.cluster, coalesce(near.near, [])) AS around FROM top JOIN corpus c USING (pos) LEFT JOIN cl ON cl.headword = trim(c.chengyu, ' ') LEFT JOIN near ON near.cluster = cl.cluster),
w AS (SELECT query, rank, true AS keep, CASE WHEN cluster IS NULL THEN [] ELSE [{{'c': cluster, 'h': headword}}] END AS kept FROM r WHERE rank = 1
 UNION ALL SELECT query, rank, keep, CASE WHEN keep AND cluster IS NOT NULL THEN list_append(kept, {{'c': cluster, 'h': headword}}) ELSE kept END FROM (
  SELECT r.*, w.kept, r.cluster IS NULL OR len(list_filter(w.kept, lambda k: list_contains(r.around, k.c) AND k.h <> r.headword)) = 0 AS keep FROM w JOIN r ON r.query = w.query AND r.rank = w.rank + 1))
SELECT query, pos, headword, rank, row_number() OVER (PARTITION BY query ORDER BY rank) AS collapsed_rank FROM w JOIN r USING (query, rank) WHERE keep QUALIFY collapsed_rank <= 10"""
)
def collapse_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of the log's English queries, without rows related to a better one."""
    scratch = Scratch(spark, "collapsed")
    links = scratch.keep(_links(spark, sf_dir), "links")
    c = M.clusters(links)
    e = scratch.keep(corpus(spark, sf_dir), "corpus")
    ranked = L.token_topk(L.TokenIndex(e), L.asked(log_queries(spark, sf_dir)), 40).join(e.select("pos", F.trim("chengyu").alias("headword")), "pos")
    return M.collapse(ranked, c, M.cluster_links(links, c)).where("collapsed_rank <= 10").select("query", "pos", "headword", "rank", "collapsed_rank")


_TYPED_AS = S.compact("query")


@query(
    f"""WITH {S.CORPUS}, {S.ASKED}, px AS (SELECT query, pos FROM asked JOIN corpus ON {S.plain_pinyin('query')} = {S.plain_pinyin('pinyin')} WHERE NOT {S.has_han('query')} AND {S.plain_pinyin('query')} <> ''
  UNION SELECT query, pos FROM asked JOIN corpus ON trim(query) IN (chengyu, simplified, traditional)),
pairs AS (SELECT query, pos FROM px UNION SELECT query, pos + 1 FROM px)
SELECT query, pos, {_TYPED_AS} <> '' AND ({_TYPED_AS} IN ({S.compact('coalesce(simplified, chengyu)')}, {S.compact('coalesce(traditional, chengyu)')}, {S.compact('chengyu')})
 OR (replace({S.plain_pinyin('pinyin')}, ' ', '') <> '' AND replace({S.plain_pinyin('pinyin')}, ' ', '') = replace({S.plain_pinyin('query')}, ' ', ''))) AS typed FROM pairs JOIN corpus USING (pos)"""
)
def typed_exactly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact readings and headwords of the log, and the entries after them, tested as typed letter for letter."""
    e, q = corpus(spark, sf_dir), log_queries(spark, sf_dir)
    met = L.exact_pinyin(e, q).unionByName(L.exact_headwords(e, q)).distinct()
    rows = met.unionByName(met.withColumn("pos", F.col("pos") + 1)).distinct().join(e, "pos")
    return rows.select("query", "pos", M.typed_exactly(F.col("query"), F.coalesce("simplified", "chengyu"), F.coalesce("traditional", "chengyu"), F.col("chengyu"), F.col("pinyin")).alias("typed"))


_COMMON = """seen AS (SELECT headword, min(n) AS seen FROM (SELECT a AS headword, link_no * 2 AS n FROM links UNION ALL SELECT b, link_no * 2 + 1 FROM links) GROUP BY headword),
v AS (SELECT headword, sum(v) AS votes FROM (SELECT a AS headword, CASE common WHEN 'a' THEN 1 ELSE -1 END AS v FROM links WHERE relation = 'same' AND common IN ('a', 'b') UNION ALL SELECT b, CASE common WHEN 'b' THEN 1 ELSE -1 END FROM links WHERE relation = 'same' AND common IN ('a', 'b')) GROUP BY headword),
common_ AS (SELECT cluster, headword AS common FROM cl JOIN seen USING (headword) LEFT JOIN v USING (headword) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY coalesce(votes, 0) DESC, seen, headword) = 1)"""
_HEAD = "trim(coalesce(nullif(trim(simplified, ' '), ''), chengyu), ' ')"


@query(
    f"""WITH RECURSIVE {_LINKS}, {S.CORPUS}, {S.ASKED}, {_COMMON}, named AS (SELECT *, {_HEAD} AS headword FROM corpus), firsts AS (SELECT headword AS common, min(pos) AS swap FROM named GROUP BY 1),
found AS (SELECT DISTINCT query, pos FROM asked JOIN corpus ON trim(query) IN (chengyu, simplified, traditional)), pairs AS (SELECT query, pos FROM found UNION SELECT query, pos + 1 FROM found)
SELECT query, pos, CASE WHEN common IS NULL OR common = headword OR swap IS NULL OR ({_TYPED_AS} <> '' AND ({_TYPED_AS} IN ({S.compact('coalesce(simplified, chengyu)')}, {S.compact('coalesce(traditional, chengyu)')}, {S.compact('chengyu')})
 OR (replace({S.plain_pinyin('pinyin')}, ' ', '') <> '' AND replace({S.plain_pinyin('pinyin')}, ' ', '') = replace({S.plain_pinyin('query')}, ' ', '')))) THEN pos ELSE swap END AS shown
FROM pairs JOIN named USING (pos) LEFT JOIN cl USING (headword) LEFT JOIN common_ USING (cluster) LEFT JOIN firsts USING (common)"""
)
def display_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry shown for the headwords of the log and the entries after them."""
    links = _links(spark, sf_dir)
    c, e = M.clusters(links), corpus(spark, sf_dir)
    preferred = M.common_forms(links, c).select("cluster", F.col("common").alias("preferred"))
    met = L.exact_headwords(e, log_queries(spark, sf_dir))
    return M.display_entries(met.unionByName(met.withColumn("pos", F.col("pos") + 1)).distinct(), c, preferred, e)


@query(
    f"""WITH RECURSIVE {_LINKS}, {S.CORPUS}, {_COMMON}, ask AS (SELECT DISTINCT trim(chengyu, ' ') AS headword FROM corpus WHERE pos % 100 = 0)
SELECT headword, o.headword AS other, 'same' AS kind FROM ask JOIN cl m USING (headword) JOIN cl o ON o.cluster = m.cluster AND o.headword <> m.headword
UNION ALL SELECT ask.headword, k.common, CASE WHEN length(k.common) > length(ask.headword) THEN 'full' ELSE 'short' END FROM ask JOIN cl m USING (headword) JOIN tied t ON t.cluster = m.cluster JOIN common_ k ON k.cluster = t.other"""
)
def variant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the relatives of every entry whose position is divisible by 100 are shown."""
    links = _links(spark, sf_dir)
    c = M.clusters(links)
    asked = corpus(spark, sf_dir).where("pos % 100 = 0").select(F.trim("chengyu").alias("headword"))
    return M.variant_groups(M.related_of(asked, c, M.cluster_links(links, c)), c, M.common_forms(links, c))

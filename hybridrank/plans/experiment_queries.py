"""Queries on experiments, reranking, link checks and saved entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridrank.functions import query as Q
from hybridrank.functions import vectors as V
from hybridrank.functions.text import normalized
from hybridrank.operators import experiments as N
from hybridrank.operators import fusion as G
from hybridrank.operators import lexical as L
from hybridrank.operators import metrics as H
from hybridrank.operators import segment as W
from hybridrank.operators.fusion import BLEND_BY_TYPE
from hybridrank.plans import search as P
from hybridrank.plans import sql as S
from hybridrank.plans.catalogue import query
from hybridrank.plans.text_queries import _SYL, _scored_sql, corpus, known_syllables, log_queries, scored_ctes
from hybridrank.runtime import Scratch, numbered, table
from hybridrank.sources import export as X
from hybridrank.sources import validate as C


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ids, vec)``: the usable vectors of the artifact, of unit length."""
    e = table(spark, sf_dir, "embedding_artifact").where("ids is not null and size(vectors) = 64").groupBy("ids").agg(F.min("vectors").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.where(good).select("ids", V.unit(F.col("v")).alias("vec")).where("vec is not null")


def embedded(spark: SparkSession, sf_dir: str, k: int = 10) -> P.Batch:
    """The log's queries over the corpus, with vectors: that of an entry, and for a query that of the least entry a request for it led to."""
    e, v = corpus(spark, sf_dir), _vectors(spark, sf_dir)
    led = table(spark, sf_dir, "request_log").where("top_id is not null").groupBy(F.col("query_text").alias("query")).agg(F.min("top_id").alias("ids"))
    embed = lambda queries: queries.join(led, "query").join(v, "ids").select("query", "vec")
    return P.prepare(e, log_queries(spark, sf_dir), known_syllables(spark, sf_dir), k, embed, e.select("pos", F.col("id").alias("ids")).join(v, "ids").select("pos", "vec"))


_BLENDED = f"""{scored_ctes(by_type=True)},
good AS (SELECT ids, any_value(vectors::DOUBLE[]) AS v FROM embedding_artifact WHERE len(vectors) = 64 AND ids IS NOT NULL AND list_bool_and(list_transform(vectors, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(vectors, lambda x: x <> 0)) GROUP BY ids),
ev AS (SELECT c.pos, v FROM corpus c JOIN good ON ids = id), qv AS (SELECT query, v FROM (SELECT query_text AS query, min(top_id) AS ids FROM request_log WHERE top_id IS NOT NULL GROUP BY 1) JOIN good USING (ids)),
parts AS (SELECT s.query, s.pos, s.t, s.score AS token, coalesce(round(list_cosine_similarity(qv.v, ev.v), 9), 0) AS similarity FROM s LEFT JOIN qv ON qv.query = s.query LEFT JOIN ev ON ev.pos = s.pos),
profiles AS (SELECT * FROM (VALUES {", ".join(str((name, t, *map(float, over.get(t) or BLEND_BY_TYPE.get(t, (0.5, 0.5))))) for name, over in N.PROFILES.items() for t in N.QUERY_TYPES)}) v(profile, t, we, wt)),
blend AS (SELECT profile, query, pos, round((greatest(0.0, least(1.0, similarity)) * we::DOUBLE + CASE WHEN token > 0 THEN least(token / 3, 1.0) ELSE 0.0 END * wt::DOUBLE) / (we::DOUBLE + wt::DOUBLE), 9)::DOUBLE AS score FROM parts JOIN profiles USING (t))"""


@query(f"WITH {_BLENDED} SELECT profile, query, pos, score, row_number() OVER (PARTITION BY profile, query ORDER BY score DESC, pos) AS rank FROM blend QUALIFY rank <= 5")
def weight_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best entries for every English query of the log under every profile of weights of vectors and tokens."""
    return N.sweep(P.evidence(embedded(spark, sf_dir), 5, N.blends()))


@query(f"WITH {_BLENDED} SELECT query, pos, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, pos) AS rank FROM blend WHERE profile = 'current' QUALIFY rank <= 10")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by meaning of every query of the log, by vectors and tokens."""
    return P.semantic_only(embedded(spark, sf_dir))


_T = "lower(meaning)"
_H = S.fnv("'queries-v1:' || pos")


@query(
    f"""WITH {S.CORPUS}, r AS (SELECT {_T} AS t, {_H} AS h FROM corpus WHERE meaning IS NOT NULL AND length(meaning) >= 12), p AS (SELECT *, (h % (length(t) - 3) + 2)::INT AS i FROM r)
SELECT 'en:whole' AS route, t AS query FROM p UNION SELECT 'en:partial', trim(left(t, 10), ' ') FROM p UNION SELECT 'en:typo', left(t, i - 1) || substr(t, i + 1, 1) || substr(t, i, 1) || substr(t, i + 2) FROM p
UNION SELECT 'zh:headword', trim(chengyu, ' ') FROM corpus WHERE trim(chengyu, ' ') <> '' UNION SELECT 'pinyin:plain', {S.plain_pinyin('pinyin')} FROM corpus WHERE {S.plain_pinyin('pinyin')} <> ''"""
)
def generated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.generated_queries(corpus(spark, sf_dir))


@query(
    f"""WITH {S.REQUESTS}, e AS (SELECT query_type AS "group", query_text, quantile_disc(duration_ms, 0.5) AS d FROM requests WHERE duration_ms IS NOT NULL AND query_text IS NOT NULL GROUP BY ALL)
SELECT "group", count(*) AS n, quantile_disc(d, 0.5) AS p50, quantile_disc(d, 0.95) AS p95, max(d) AS most, round(avg(d), 6) AS mean FROM e GROUP BY "group" """
)
def median_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = H.once(table(spark, sf_dir, "request_log")).where("duration_ms is not null and query_text is not null")
    return N.median_latency(r.select(F.col("query_type").alias("group"), F.col("query_text").alias("query"), "duration_ms"))


_LIGHT = N.RERANKERS["rerank-light"][""]
_IN = lambda xs, ys: f"len(list_filter({xs}, lambda t: list_contains({ys}, t)))"


@query(
    _scored_sql(
        f""", r AS (SELECT query, pos, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, pos) AS rank FROM s QUALIFY rank <= 20),
raw AS (SELECT r.*, CASE WHEN contains(lower(c.meaning), lower(r.query)) THEN {_LIGHT['meaning_phrase']} ELSE 0 END + CASE WHEN contains(d.lx, lower(r.query)) THEN {_LIGHT['literal_phrase']} ELSE 0 END
 + {_IN('qt', 'cs')} / len(qt) * {_LIGHT['coverage']} + coalesce(shared / (qm.mass + dm.mass - shared), 0) * {_LIGHT['jaccard']}
 + CASE WHEN {_IN('qf', 'cs')} = len(qf) THEN {_LIGHT['all_focused']} ELSE {_IN('qf', 'cs')} / len(qf) * {_LIGHT['focused']} END
 + CASE WHEN len(q2) > 0 THEN {_IN('q2', 'f2')} / len(q2) * {_LIGHT['bigram']} ELSE 0 END + CASE WHEN len(q3) > 0 THEN {_IN('q3', 'f3')} / len(q3) * {_LIGHT['trigram']} ELSE 0 END AS raw
 FROM r JOIN q_ USING (query) JOIN d USING (pos) JOIN corpus c USING (pos) JOIN qm USING (query) LEFT JOIN dm USING (pos) LEFT JOIN inter ON inter.query = r.query AND inter.pos = r.pos),
n AS (SELECT query, pos, rank, CASE WHEN count(*) OVER w < 2 THEN score ELSE round(score * (1 - {_LIGHT['share']}) + raw / CASE WHEN max(raw) OVER w > 0 THEN max(raw) OVER w ELSE 1 END * {_LIGHT['share']}, 9) END::DOUBLE AS score FROM raw WINDOW w AS (PARTITION BY query))
SELECT query, pos, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank) AS rank FROM n"""
    )
)
def feature_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best entries by tokens, reranked by word evidence under the light profile."""
    scratch = Scratch(spark, "reranked")
    index = L.TokenIndex(scratch.keep(corpus(spark, sf_dir), "corpus"))
    asked = scratch.keep(L.asked(log_queries(spark, sf_dir)), "asked")
    texts = index.corpus.select("pos", F.lower("meaning").alias("meaning_text"), F.lower("example").alias("example_text"))
    return G.feature_rerank(scratch.keep(L.token_topk(index, asked), "ranked"), asked, index.feats.join(texts, "pos"), index.idf, int(_LIGHT["top"]), _LIGHT["share"], _LIGHT)


@query(
    f"""WITH {S.CORPUS}, l AS (SELECT DISTINCT link_no, nullif(trim(a, ' '), '') AS a, nullif(trim(b, ' '), '') AS b, lower(trim(relation)) AS relation, common FROM variant_families), h AS (SELECT DISTINCT trim(chengyu, ' ') AS h FROM corpus)
SELECT 'unknown headword' AS finding, count(*) AS n FROM (SELECT a AS h FROM l WHERE a IS NOT NULL UNION SELECT b FROM l WHERE b IS NOT NULL) WHERE h NOT IN (SELECT h FROM h WHERE h IS NOT NULL)
UNION ALL SELECT 'unknown relation', count(*) FROM l WHERE relation IS NULL OR relation NOT IN ('same', 'full_form')
UNION ALL SELECT 'unknown common', count(*) FROM l WHERE common NOT IN ('a', 'b', 'equal') UNION ALL SELECT 'missing end', count(*) FROM l WHERE a IS NULL OR b IS NULL
UNION ALL SELECT 'to itself', count(*) FROM l WHERE a = b UNION ALL SELECT 'given twice', count(*) FROM (SELECT least(a, b), greatest(a, b) FROM l WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)"""
)
def link_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")).alias(c)
    links = table(spark, sf_dir, "variant_families").select("link_no", end("a"), end("b"), F.lower(F.trim("relation")).alias("relation"), "common").distinct()
    return C.link_findings(links, corpus(spark, sf_dir).select(F.trim("chengyu").alias("headword")))


@query(
    f"""WITH {S.CORPUS}, f AS (SELECT coalesce(nullif(trim(simplified, ' '), ''), chengyu) AS headword, unnest(list_filter([chengyu, simplified, traditional], lambda x: x <> '')) AS alias FROM corpus)
SELECT alias, min(headword) AS headword FROM f GROUP BY alias HAVING min(headword) = max(headword)"""
)
def headword_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.headword_aliases(corpus(spark, sf_dir))


_ONCE = lambda x: f"array_to_string(list_transform(string_split({x}, ''), lambda c: coalesce(m[c], c)), '')"


_NORMAL = (
    f"""WITH {S.CORPUS}, {S.ASKED}, d AS (SELECT DISTINCT entry_no, traditional, simplified FROM cedict WHERE length(traditional) = length(simplified)),
p AS (SELECT entry_no, i, substr(traditional, i, 1) AS t, substr(simplified, i, 1) AS s FROM d, unnest(range(1, length(traditional) + 1)) u(i)),
v AS (SELECT t, s FROM (SELECT t, s, count(*) AS votes, min(entry_no * 1000 + i) AS seen FROM p GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY t ORDER BY votes DESC, seen) = 1),
rules AS (SELECT map(list(t), list(s)) AS m FROM v WHERE t <> s),
f AS (SELECT coalesce(nullif(trim(simplified, ' '), ''), chengyu) AS headword, unnest(list_filter([chengyu, simplified, traditional], lambda x: x <> '')) AS alias FROM corpus),
al AS (SELECT alias, min(headword) AS headword FROM f GROUP BY alias HAVING min(headword) = max(headword))
SELECT query, coalesce(headword, {_ONCE(_ONCE(_ONCE("trim(query, ' ')")))}) AS normalized FROM rules, asked LEFT JOIN al ON alias = trim(query, ' ') WHERE {S.has_han('query')}"""
)


@query(_NORMAL)
def han_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Han queries of the log as headwords, else in simplified characters by the dictionary's majority.

    The rules are at most one a character of Unicode.
    """
    rows = W.character_map(table(spark, sf_dir, "cedict").select("entry_no", "traditional", "simplified").distinct()).where("traditional <> simplified").collect()
    convert = W.Converter(set(), {}, {}, {r["traditional"]: r["simplified"] for r in rows})
    return W.han_normalized(log_queries(spark, sf_dir), W.headword_aliases(corpus(spark, sf_dir)), convert)


@query(f"WITH {S.CORPUS} SELECT pos, row_number() OVER (ORDER BY nfc_normalize(chengyu) COLLATE zh, pos) AS place FROM corpus WHERE chengyu IS NOT NULL")
def collated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every entry in the order of Chinese collation; canonically equal headwords are equal."""
    e = corpus(spark, sf_dir).where("chengyu is not null").select("pos", F.collate(normalized(F.col("chengyu"), "NFC"), "zh_Hans").alias("head"))
    return numbered(e, [F.col("head"), F.col("pos")], "place").select("pos", "place")


@query(
    f"""WITH {S.CORPUS} SELECT pos, array_to_string(list_filter([CASE WHEN meaning <> '' THEN 'Meaning: ' || meaning END, CASE WHEN literal <> '' THEN 'Literal: ' || literal END, CASE WHEN example <> '' THEN 'Example: ' || example END,
 CASE WHEN len(tags) > 0 THEN 'Topics: ' || array_to_string(tags, ', ') END], lambda x: x IS NOT NULL), '. ') AS text FROM corpus"""
)
def reranker_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("pos", X.reranker_text().alias("text"))


@query(
    f"""WITH {S.REQUESTS}, {S.CORPUS}, saved AS (SELECT request_no AS n, top_id AS id, NULL AS chengyu, NULL AS pinyin FROM requests WHERE top_id IS NOT NULL UNION ALL SELECT -1 - pos, NULL, chengyu, CASE WHEN formality IS NULL THEN NULL ELSE pinyin END FROM corpus),
ids AS (SELECT DISTINCT id FROM corpus), r AS (SELECT chengyu, pinyin, min(id) AS id FROM corpus GROUP BY 1, 2 HAVING count(*) = 1), h AS (SELECT chengyu, min(id) AS id FROM corpus GROUP BY 1 HAVING count(*) = 1)
SELECT n, CASE WHEN s.id IS NOT NULL THEN ids.id WHEN coalesce(trim(s.pinyin, ' '), '') = '' THEN h.id ELSE r.id END AS id FROM saved s LEFT JOIN ids ON ids.id = s.id LEFT JOIN r ON r.chengyu = s.chengyu AND r.pinyin = s.pinyin LEFT JOIN h ON h.chengyu = s.chengyu"""
)
def bookmark_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The present entry of those saved with a request, and of entries saved by headword and reading alone."""
    e = corpus(spark, sf_dir)
    none = F.lit(None).cast("string")
    by_id = H.once(table(spark, sf_dir, "request_log")).where("top_id is not null").select(F.col("request_no").alias("n"), F.col("top_id").alias("id"), none.alias("chengyu"), none.alias("pinyin"))
    by_name = e.select((-1 - F.col("pos")).alias("n"), none.alias("id"), "chengyu", F.when(F.col("formality").isNotNull(), F.col("pinyin")).alias("pinyin"))
    return C.refreshed(by_id.unionByName(by_name), e)


@query(
    f"""WITH {S.CORPUS}, {S.ASKED}, {_SYL}, n AS ({_NORMAL}), forms AS (SELECT unnest([chengyu, simplified, traditional]) AS form FROM corpus)
SELECT a.query, NOT (trim(a.query) = '' OR {S.query_type('a.query')} = 'pinyin' OR trim(a.query) IN (SELECT form FROM forms WHERE form IS NOT NULL)
 OR ({S.has_han('a.query')} AND (trim(normalized) IN (SELECT form FROM forms WHERE form IS NOT NULL) OR length(normalized) <= 4))) AS described FROM syl, asked a LEFT JOIN n ON n.query = a.query"""
)
def described_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which queries of the log describe a meaning."""
    q = log_queries(spark, sf_dir)
    typed = q.select("query", Q.query_type(F.col("query"), known_syllables(spark, sf_dir)).alias("query_type"))
    return L.described(typed, corpus(spark, sf_dir), han_normalized(spark, sf_dir))

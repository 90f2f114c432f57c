"""Queries on the request log, judged rankings, limits and validation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridrank.operators import metrics as H
from hybridrank.plans import sql as S
from hybridrank.plans.catalogue import query
from hybridrank.plans.text_queries import corpus
from hybridrank.runtime import table
from hybridrank.sources import export as X
from hybridrank.sources import validate as C
from hybridrank.streaming import limits as K

MODES = ["auto", "hybrid", "keyword", "semantic"]


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.once(table(spark, sf_dir, "request_log"))


_LAT = "count(duration_ms) AS n, round(avg(duration_ms), 3) AS mean, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95, min(duration_ms) AS least, max(duration_ms) AS most, round(sum(duration_ms), 3) AS total"


@query(f"WITH {S.REQUESTS} SELECT query_type, {_LAT} FROM requests WHERE duration_ms IS NOT NULL GROUP BY query_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.latency_by(_requests(spark, sf_dir), "query_type")


@query(f"WITH {S.REQUESTS} SELECT endpoint, mode, grouping(endpoint, mode)::BIGINT AS level, count(duration_ms) AS n, round(avg(duration_ms), 3) AS mean, min(duration_ms) AS least, max(duration_ms) AS most, round(sum(duration_ms), 3) AS total FROM requests WHERE duration_ms IS NOT NULL GROUP BY GROUPING SETS ((), (endpoint), (mode))")
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.latency_sets(_requests(spark, sf_dir))


@query(f"WITH {S.REQUESTS} SELECT endpoint, count(*) AS requests, count_if(status_code >= 400) AS failed, count_if(status_code = 200 AND result_count = 0) AS empty, count_if(page_offset > 0) AS later_pages, count(DISTINCT client_id) AS clients FROM requests GROUP BY endpoint")
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.request_counts(_requests(spark, sf_dir))


@query(f"WITH {S.REQUESTS} SELECT status_code, " + ", ".join(f"count_if(mode = '{m}') AS {m}" for m in MODES) + " FROM requests GROUP BY status_code")
def cache_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by status and mode."""
    return H.outcome_pivot(_requests(spark, sf_dir), MODES)


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rankings of entries by frequency for each tag, and labels by formality: a fixed exercise on the corpus."""
    rows = corpus(spark, sf_dir).select("pos", F.explode("tags").alias("query"), F.coalesce(F.nanvl("frequency", F.lit(None)), F.lit(0.0)).alias("f"), "formality").distinct()
    results = rows.selectExpr("query", "pos AS item", "row_number() OVER (PARTITION BY query ORDER BY f DESC, pos) AS rank")
    labels = rows.where("formality is not null").selectExpr("query", "pos AS item", "CASE formality WHEN 'literary' THEN 3.0D WHEN 'formal' THEN 1.5D ELSE 0.0D END AS relevance")
    return results, labels


_JUDGED = f"""WITH {S.CORPUS}, rows_ AS (SELECT DISTINCT pos, query, CASE WHEN frequency IS NULL OR isnan(frequency) THEN 0 ELSE frequency END AS f, formality FROM (SELECT pos, unnest(tags) AS query, frequency, formality FROM corpus)),
results AS (SELECT query, pos AS item, row_number() OVER (PARTITION BY query ORDER BY f DESC, pos) AS rank FROM rows_),
labels AS (SELECT query, pos AS item, CASE formality WHEN 'literary' THEN 3.0 WHEN 'formal' THEN 1.5 ELSE 0.0 END::DOUBLE AS relevance FROM rows_ WHERE formality IS NOT NULL),
got AS (SELECT query, sum(relevance / log2(rank + 1)) AS dcg FROM results JOIN labels USING (query, item) WHERE rank <= 5 GROUP BY query),
ideal AS (SELECT query, sum(relevance / log2(r + 1)) AS ideal FROM (SELECT query, relevance, row_number() OVER (PARTITION BY query ORDER BY relevance DESC) AS r FROM labels) WHERE r <= 5 GROUP BY query),
scores AS (SELECT query, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END AS ndcg FROM ideal LEFT JOIN got USING (query))"""


@query(_JUDGED + " SELECT query, round(ndcg, 6) AS ndcg FROM scores")
def ndcg_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.ndcg(*_judged(spark, sf_dir)).withColumn("ndcg", F.round("ndcg", 6))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(t) for t in ("english_meaning", "thematic", "literal", "partial")]), F.length("query") % 4 + 1)
    return H.ndcg(*_judged(spark, sf_dir)).withColumn("query_type", kind)


_TYPED = _JUDGED + ", typed AS (SELECT *, ['english_meaning', 'thematic', 'literal', 'partial'][length(query) % 4 + 1] AS t FROM scores), sums AS (SELECT 'overall' AS scope, ndcg FROM typed UNION ALL SELECT 'type:' || t, ndcg FROM typed UNION ALL SELECT 'primary', ndcg FROM typed WHERE t IN ('english_meaning', 'thematic') UNION ALL SELECT 'by_meaning', ndcg FROM typed WHERE t IN ('english_meaning', 'thematic', 'literal')), summary AS (SELECT scope, count(*) AS n, round(avg(ndcg), 6) AS ndcg FROM sums GROUP BY scope)"


@query(_TYPED + " SELECT scope, n, ndcg FROM summary")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.score_summary(_typed(spark, sf_dir))


@query(_TYPED + " SELECT scope, ndcg AS candidate, ndcg + CASE scope WHEN 'primary' THEN 0.01 ELSE 0 END AS live, scope = 'overall' AS passed FROM summary WHERE scope IN ('overall', 'primary')")
def gate_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate that scores as the live ranking does passes, one that scores a little less does not."""
    s = H.score_summary(_typed(spark, sf_dir))
    return H.gate(s, s.withColumn("ndcg", F.col("ndcg") + F.when(F.col("scope") == "primary", 0.01).otherwise(0.0)))


@query(_JUDGED + " SELECT count(*) AS slots, count(l.item) AS labelled, count(*) - count(l.item) AS missing FROM results r LEFT JOIN labels l USING (query, item) WHERE rank <= 5 AND query IN (SELECT query FROM labels)")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.label_coverage(*_judged(spark, sf_dir))


@query(_JUDGED + " SELECT query, round(ndcg, 6) AS ndcg, round(1 - ndcg, 6) AS loss FROM scores ORDER BY round(1 - ndcg, 9) DESC, query LIMIT 10")
def worst_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.worst(H.ndcg(*_judged(spark, sf_dir))).select("query", F.round("ndcg", 6).alias("ndcg"), F.round("loss", 6).alias("loss"))


@query(_JUDGED + " SELECT query, round(ndcg, 6) AS auto, 'keyword' AS best_mode, round(ndcg + length(query) % 3 * 0.1, 6) AS best, round(length(query) % 3 * 0.1, 6) AS gain FROM scores WHERE length(query) % 3 > 0")
def route_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = H.ndcg(*_judged(spark, sf_dir))
    modes = s.withColumn("mode", F.lit("auto")).unionByName(s.withColumn("mode", F.lit("keyword")).withColumn("ndcg", F.col("ndcg") + F.length("query") % 3 * 0.1)).unionByName(s.withColumn("mode", F.lit("semantic")))
    return H.route_audit(modes).where("best_mode = 'keyword'").select("query", F.round("auto", 6).alias("auto"), "best_mode", F.round("best", 6).alias("best"), F.round("gain", 6).alias("gain"))


@query(
    f"""WITH c AS (SELECT DISTINCT query_type, query_text FROM request_log WHERE query_text IS NOT NULL), k AS (SELECT query_type, count(*) AS n, greatest(0, count(*) - 1) AS most FROM c GROUP BY 1),
t AS (SELECT *, least(floor(n * 0.25)::BIGINT, most) AS take FROM k), g AS (SELECT least(floor(sum(n) * 0.25 + 0.5), sum(most))::BIGINT - sum(take)::BIGINT AS more FROM t),
quota AS (SELECT query_type, take + (take < most AND row_number() OVER (ORDER BY take >= most, take - n * 0.25, -n, query_type) <= more)::INT AS quota FROM t, g),
p AS (SELECT *, row_number() OVER (PARTITION BY query_type ORDER BY {S.fnv("'holdout-v1::' || query_type || '::' || query_text")}, query_text) AS place FROM c)
SELECT query_type, query_text, place, place <= quota AS held_out FROM p JOIN quota USING (query_type)"""
)
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "request_log").where("query_text is not null").select("query_type", "query_text").distinct()
    return H.holdout(cases, "query_type", "query_text")


@query(f"WITH {S.ASKED}, f AS (SELECT DISTINCT query_type, query_text FROM request_log) SELECT query_type, query_text, row_number() OVER (PARTITION BY query_type ORDER BY query_text) AS n FROM f QUALIFY n <= 2")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.first_of_each(table(spark, sf_dir, "request_log").select("query_type", "query_text").distinct(), "query_type", "query_text")


_EVENTS = lambda keys: f"""e AS (SELECT {keys}, request_no, epoch_us(event_at) / 1e6 AS tm, status_code < 400 AS ok, row_number() OVER (PARTITION BY {keys} ORDER BY event_at, request_no) AS rn FROM requests WHERE client_id IS NOT NULL AND event_at IS NOT NULL)"""


@query(
    f"""WITH RECURSIVE {S.REQUESTS}, {_EVENTS('endpoint, client_id')},
w AS (SELECT endpoint, client_id, request_no, rn, tm AS opened, 1 AS used, true AS admitted, 0 AS retry_after FROM e WHERE rn = 1
 UNION ALL SELECT e.endpoint, e.client_id, e.request_no, e.rn, CASE WHEN opened + 600 <= tm THEN tm ELSE opened END, CASE WHEN opened + 600 <= tm THEN 1 WHEN used >= 3 THEN used ELSE used + 1 END,
  opened + 600 <= tm OR used < 3, CASE WHEN opened + 600 <= tm OR used < 3 THEN 0 ELSE greatest(1, ceil(opened + 600 - tm))::INT END FROM w JOIN e ON e.endpoint = w.endpoint AND e.client_id = w.client_id AND e.rn = w.rn + 1)
SELECT endpoint, client_id, request_no, admitted, retry_after FROM w"""
)
def rate_limit_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests a limit of 3 per 10 minutes, path and client would have admitted."""
    return K.decide(_requests(spark, sf_dir).where("client_id is not null"), K.FixedWindow(3, 600), ["endpoint", "client_id"], "event_at", "request_no")


@query(
    f"""WITH RECURSIVE {S.REQUESTS}, {_EVENTS('client_id')},
w AS (SELECT client_id, request_no, rn, 1.0::DOUBLE AS tokens, tm, true AS admitted, 0 AS retry_after FROM e WHERE rn = 1
 UNION ALL SELECT client_id, request_no, rn, t - (t >= 1)::INT, tm, t >= 1, CASE WHEN t >= 1 THEN 0 ELSE greatest(1, ceil((1 - t) / (48.0::DOUBLE / 86400)))::INT END
 FROM (SELECT e.client_id, e.request_no, e.rn, e.tm, least(2.0::DOUBLE, w.tokens + (e.tm - w.tm) * (48.0::DOUBLE / 86400)) AS t FROM w JOIN e ON e.client_id = w.client_id AND e.rn = w.rn + 1))
SELECT client_id, request_no, admitted, retry_after FROM w"""
)
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.decide(_requests(spark, sf_dir).where("client_id is not null"), K.TokenBucket(2.0, 48.0), ["client_id"], "event_at", "request_no")


@query(
    f"""WITH RECURSIVE {S.REQUESTS}, {_EVENTS('client_id')},
w AS (SELECT client_id, request_no, rn, (NOT ok)::INT AS failed, 0.0::DOUBLE AS until, true AS admitted, 0 AS retry_after FROM e WHERE rn = 1
 UNION ALL SELECT client_id, request_no, rn, CASE WHEN shut THEN failed WHEN ok THEN 0 ELSE failed + 1 END, CASE WHEN shut THEN until WHEN ok THEN 0 WHEN failed + 1 >= 2 THEN tm + 86400 ELSE until END, NOT shut,
  CASE WHEN shut THEN greatest(1, ceil(until - tm))::INT ELSE 0 END FROM (SELECT e.*, w.failed, w.until, w.failed >= 2 AND e.tm < w.until AS shut FROM w JOIN e ON e.client_id = w.client_id AND e.rn = w.rn + 1))
SELECT client_id, request_no, admitted, retry_after FROM w"""
)
def breaker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _requests(spark, sf_dir).where("client_id is not null").withColumn("ok", F.col("status_code") < 400)
    return K.decide(rows, K.Breaker(2, 86400), ["client_id"], "event_at", "request_no", "ok")


@query(f"WITH {S.REQUESTS} SELECT CAST(event_at AT TIME ZONE 'UTC' AS DATE) AS day, round(sum(duration_ms), 3) AS spent, coalesce(round(sum(duration_ms), 3), 0) <= 1500 AS within FROM requests WHERE event_at IS NOT NULL GROUP BY 1")
def daily_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.daily_ledger(_requests(spark, sf_dir), "event_at", "duration_ms", 1500.0)


@query(
    f"""WITH {S.CORPUS}, v AS (SELECT DISTINCT ids, vectors FROM embedding_artifact)
SELECT 'missing' AS finding, count(*) AS n FROM corpus WHERE id NOT IN (SELECT ids FROM v WHERE ids IS NOT NULL) UNION ALL SELECT 'extra', count(*) FROM v WHERE ids NOT IN (SELECT id FROM corpus)
UNION ALL SELECT 'duplicate', count(*) FROM (SELECT ids FROM v GROUP BY ids HAVING count(*) > 1) UNION ALL SELECT 'null vector', count(*) FROM v WHERE vectors IS NULL
UNION ALL SELECT 'dimensions', count(*) FROM v WHERE len(vectors) <> 64 UNION ALL SELECT 'not finite', count(*) FROM v WHERE len(list_filter(vectors, lambda x: x IS NULL OR NOT isfinite(x))) > 0"""
)
def artifact_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.vector_findings(corpus(spark, sf_dir), table(spark, sf_dir, "embedding_artifact"), 64)


@query(
    f"""WITH {S.CORPUS}, r AS (SELECT pos, sha256('{{"id":' || to_json(id)::VARCHAR || ',"chengyu":' || to_json({S.spaced('chengyu')})::VARCHAR || ',"text":' || to_json(coalesce(nullif({S.spaced('meaning')}, ''), nullif({S.spaced('literal')}, ''), {S.spaced('chengyu')}))::VARCHAR || '}}') AS h FROM corpus),
b AS (SELECT pos // 10000 AS block, count(*) AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM r GROUP BY 1)
SELECT 'v1' AS version, 'meaning-only' AS template, sum(n)::BIGINT AS n, sha256('v1|meaning-only|' || string_agg(h, '' ORDER BY block)) AS hash FROM b"""
)
def corpus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.corpus_hash(corpus(spark, sf_dir), "meaning-only", "v1")


_CARD = lambda x: "regexp_replace(replace(" + S.html(f"coalesce({x}, '')") + r", chr(9), ' '), '\r?\n+', '<br>', 'g')"
_OR = lambda x: f"coalesce(nullif({x}, ''), chengyu)"


@query(
    f"""WITH {S.CORPUS} SELECT pos, array_to_string([{_CARD(_OR('simplified'))}, {_CARD(_OR('simplified'))}, {_CARD(_OR('traditional'))}, {_CARD('pinyin')},
 {_CARD("array_to_string(list_transform(string_split(pinyin, ' '), lambda s: " + S.tone_marked('s') + "), ' ')")}, {_CARD('meaning')}, {_CARD('literal')}, {_CARD('example')}, {_CARD("array_to_string(tags, ', ')")}, {_CARD('formality')}], chr(9)) AS value FROM corpus"""
)
def tsv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.flash_cards(corpus(spark, sf_dir))


@query(
    f"""WITH {S.REQUESTS}, {S.CORPUS}, al AS (SELECT max(id) AS old, min(id) AS new FROM corpus GROUP BY chengyu HAVING min(id) <> max(id)),
s AS (SELECT request_no AS n, coalesce(al.new, top_id) AS id, al.new IS NOT NULL AS moved FROM requests LEFT JOIN al ON al.old = top_id WHERE top_id IS NOT NULL)
SELECT id, n, moved FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY moved, CASE WHEN moved THEN -n ELSE n END) = 1"""
)
def alias_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved entries (those asked for first in the log) moved to the identifiers of the corpus."""
    saved = _requests(spark, sf_dir).where("top_id is not null").select(F.col("request_no").alias("n"), F.col("top_id").alias("id"))
    e = corpus(spark, sf_dir)
    aliases = e.groupBy("chengyu").agg(F.min("id").alias("new"), F.max("id").alias("old")).where("new <> old").select("old", "new")
    return C.migrated(saved, aliases)


def _template_sql(form: str) -> str:
    tags = lambda sep: f"array_to_string(list_transform(coalesce(tags, []), lambda t: {S.spaced('t')}), '{sep}')"
    field = lambda f: tags(", ") if f == "tags" else tags(" ") if f == "words" else "coalesce(" + ", ".join(f"nullif({S.spaced(x)}, '')" for x in f.split("|")) + ", '')"
    parts = [field(p[1:-1]) if p.startswith("{") else f"'{p}'" for p in re.split(r"(\{[^}]*\})", form) if p]
    return f"coalesce(nullif(trim({' || '.join(parts)}, ' '), ''), nullif({S.spaced('meaning')}, ''), nullif({S.spaced('literal')}, ''), {S.spaced('chengyu')})"


@query(f"WITH {S.CORPUS} SELECT pos, " + ", ".join(f"{_template_sql(form)} AS {name.replace('-', '_')}" for name, form in X.TEMPLATES.items()) + " FROM corpus")
def document_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text to embed for every entry by every template."""
    return corpus(spark, sf_dir).select("pos", *[X.template(name).alias(name.replace("-", "_")) for name in X.TEMPLATES])


@query(
    f"""WITH {S.CORPUS} SELECT pos, chengyu || '. Meaning: ' || coalesce(meaning, '') || '. Literal: ' || coalesce(literal, '') || '. Topics: ' || array_to_string(coalesce(tags, []), ', ') || chr(10) || '释义：'
 || coalesce(nullif(trim(meaning_zh, ' '), ''), nullif(regexp_extract(example, '^([^(（]*)', 1), ''), chengyu, '') AS text FROM corpus"""
)
def bilingual_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("pos", X.bilingual_text().alias("text"))

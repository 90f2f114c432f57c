"""Queries on text functions, query understanding and word scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridrank.functions import query as Q
from hybridrank.functions import text as X
from hybridrank.operators import lexical as L
from hybridrank.plans import sql as S
from hybridrank.plans.catalogue import query
from hybridrank.runtime import table


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.entries(table(spark, sf_dir, "chengyu_entry"))


def log_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different queries of the log, in the column ``query``."""
    return table(spark, sf_dir, "request_log").select(F.col("query_text").alias("query")).where("query is not null").distinct()


def known_syllables(spark: SparkSession, sf_dir: str):
    """The syllables of pinyin without dots, as an array literal: a fixed table of some 400 rows."""
    rows = table(spark, sf_dir, "pinyin_syllable").limit(5001).collect()
    if len(rows) > 5000:
        raise ValueError("a table of syllables has some 400 rows, not over 5,000")
    return Q.listed(sorted({r["syllable"].replace("ü", "u") for r in rows}))


_SYL = "syl AS (SELECT list(DISTINCT replace(syllable, 'ü', 'u')) AS known FROM pinyin_syllable)"


@query(f"SELECT doc_id, array_to_string({S.tokens('text')}, ' ') AS tokens FROM documents")
def tokens_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.content_tokens(F.col("text")), " ").alias("tokens"))


@query(f"WITH {S.CORPUS}, t AS (SELECT pos, {S.tokens('meaning')} AS tk FROM corpus) SELECT pos, array_to_string({S.grams('tk', 2)}, '|') AS bigrams, array_to_string({S.grams('tk', 3)}, '|') AS trigrams FROM t")
def token_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.content_tokens(F.col("meaning"))
    return corpus(spark, sf_dir).select("pos", F.array_join(X.ngrams(t, 2), "|").alias("bigrams"), F.array_join(X.ngrams(t, 3), "|").alias("trigrams"))


@query(f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({S.tokens('text')}) AS token FROM documents) GROUP BY ALL")
def token_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.content_tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))


@query(
    f"""WITH {S.CORPUS} SELECT pos, {S.plain_pinyin('pinyin')} AS plain, coalesce({S.has_han('chengyu')}, false) AS han, coalesce(regexp_matches(chengyu, '[\\x{{3400}}-\\x{{9fff}}]'), false) AS display_han,
  trim(translate(chengyu, '０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'), ' ') AS half,
  array_to_string({S.words('meaning')}, ' ') AS route, replace(replace(replace(replace(replace(meaning, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM corpus"""
)
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinyin without tones, script tests, half-width forms, routing text and escaping."""
    c = F.col("chengyu")
    return corpus(spark, sf_dir).select(
        "pos", X.plain_pinyin(F.col("pinyin")).alias("plain"), X.has_unified_han(c).alias("han"), X.has_display_han(c).alias("display_han"),
        X.half_width(c).alias("half"), X.route_text(F.col("meaning")).alias("route"), X.html_escaped(F.col("meaning")).alias("escaped"),
    )


@query(
    f"""WITH {S.CORPUS} SELECT pos, CASE WHEN frequency IS NULL OR isnan(frequency) OR frequency <= 0 OR isinf(frequency) THEN 0.0 ELSE least(frequency / 3, 1.0) END AS squashed,
  CAST(greatest(0, least(100, floor(frequency * 100 + 0.5))) AS INTEGER) AS percent,
  array_to_string(list_concat(coalesce(tags, [])[1:4], CASE WHEN formality <> 'formal' AND NOT list_contains(coalesce(tags, [])[1:4], formality) THEN [formality] ELSE [] END), ',') AS shown FROM corpus"""
)
def score_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.nanvl(F.col("frequency"), F.lit(None))
    return corpus(spark, sf_dir).select("pos", X.squashed(F.coalesce(F.col("frequency"), F.lit(0.0)), 3).alias("squashed"), X.percent(f).alias("percent"), F.array_join(X.visible_tags(F.col("tags"), F.col("formality")), ",").alias("shown"))


@query(f"WITH {S.CORPUS} SELECT pos, {S.fnv('chengyu')} AS fnv FROM corpus WHERE chengyu IS NOT NULL")
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32-bit FNV-1a hash of headwords."""
    return corpus(spark, sf_dir).where("chengyu is not null").select("pos", X.fnv1a(F.col("chengyu")).alias("fnv"))


_JSON = lambda f: f"to_json({S.spaced(f)})::VARCHAR"


@query(
    f"""WITH {S.CORPUS} SELECT pos, 'chengyu_' || left(sha1('{{"chengyu":' || {_JSON('chengyu')} || ',"pinyin":' || {_JSON('pinyin')} || '}}'), 16) AS stable_id,
 'chengyu_' || left(sha1('{{"chengyu":' || {_JSON('chengyu')} || ',"pinyin":' || {_JSON('pinyin')} || ',"literal":' || {_JSON('literal')} || ',"meaning":' || {_JSON('meaning')} || ',"example":' || {_JSON('example')}
 || ',"tags":[' || array_to_string(list_transform(coalesce(tags, []), lambda t: {_JSON('t')}), ',') || '],"formality":' || {_JSON('formality')} || '}}'), 16) AS legacy_id FROM corpus"""
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers by headword and reading, and those of old records by all their texts."""
    e = {f: F.col(f) for f in ("chengyu", "pinyin", "literal", "meaning", "example", "formality")}
    return corpus(spark, sf_dir).select("pos", X.stable_id(F.col("chengyu"), F.col("pinyin")).alias("stable_id"), X.legacy_id(e, F.col("tags")).alias("legacy_id"))


@query(
    rf"""WITH c AS (SELECT DISTINCT entry_no, simplified, pinyin FROM cedict WHERE pinyin IS NOT NULL), m AS (SELECT *, array_to_string(list_transform(string_split(pinyin, ' '), lambda s: {S.tone_marked('s')}), ' ') AS marked FROM c),
p AS (SELECT *, list_filter(string_split(simplified, ''), lambda x: x <> '') AS chars, list_filter(string_split(regexp_replace(regexp_replace(marked, '[,，]', ' ', 'g'), '\s+', ' ', 'g'), ' '), lambda x: x <> '') AS spoken FROM m)
SELECT entry_no, marked, array_to_string(list_transform(chars, lambda x, i: x || '=' || CASE WHEN regexp_matches(x, '[\x{{3400}}-\x{{9fff}}]') THEN coalesce(spoken[len(list_filter(chars[1:i], lambda y: regexp_matches(y, '[\x{{3400}}-\x{{9fff}}]')))], '') ELSE '' END), ' ') AS aligned FROM p"""
)
def pinyin_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary readings with tone marks, aligned to the characters."""
    c = table(spark, sf_dir, "cedict").where("pinyin is not null").select("entry_no", "simplified", "pinyin").distinct()
    marked = F.array_join(F.transform(F.split("pinyin", " "), X.tone_marked), " ")
    aligned = F.array_join(F.transform(X.aligned_syllables(F.col("simplified"), marked), lambda x: F.concat_ws("=", x["character"], F.coalesce(x["syllable"], F.lit("")))), " ")
    return c.select("entry_no", marked.alias("marked"), aligned.alias("aligned"))


_PARTS = r"'(?s)^(.*?)\s*[(（]([^()（）]*)[)）]\s*$'"
_NOTE = r"'(?i)\s*\(\s*idiom\b,?\s*([^()]*)\)'"


@query(
    rf"""WITH {S.CORPUS} SELECT pos, CASE WHEN regexp_matches(example, {_PARTS}) THEN regexp_extract(example, {_PARTS}, 1) ELSE example END AS zh, CASE WHEN regexp_matches(example, {_PARTS}) THEN regexp_extract(example, {_PARTS}, 2) END AS en,
 trim(regexp_extract(example, '^([^(（]*)', 1), ' ') AS annotated,
 array_to_string(list_filter(list_transform(regexp_extract_all(meaning, {_NOTE}, 1), lambda n: regexp_replace(trim(n, ' '), '\.$', '')), lambda n: n <> ''), '; ') AS note,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(meaning, {_NOTE}, '', 'g'), '\s+([;,.])', '\1', 'g'), ';\s*;', ';', 'g'), '^[;,\s]+|[;,\s]+$', '', 'g'), ' ') AS plain_meaning FROM corpus"""
)
def example_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples in two parts, the part to annotate, and meanings without their notes."""
    e, n = X.example_parts(F.col("example")), X.idiom_notes(F.col("meaning"))
    return corpus(spark, sf_dir).select("pos", e["zh"].alias("zh"), e["en"].alias("en"), X.before_parenthesis(F.col("example")).alias("annotated"), n["note"].alias("note"), n["meaning"].alias("plain_meaning"))


@query(
    r"""WITH d AS (SELECT DISTINCT entry_no, definitions FROM cedict WHERE definitions IS NOT NULL)
SELECT entry_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(definitions, '\(?CL:[^)]*\)?', '', 'g'), '(?i)\((?:variant of|old variant of|see|also written|same as)[^)]*\)', '', 'g'), '\[[^\]]*\]', '', 'g'), '(?i)\(bound form\)\s*', '', 'g'), '\s+', ' ', 'g'), '^[\s;,]+|[\s;,]+$', '', 'g') AS sense FROM d"""
)
def character_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary senses as one-line glosses."""
    d = table(spark, sf_dir, "cedict").where("definitions is not null").select("entry_no", "definitions").distinct()
    return d.select("entry_no", X.character_sense(F.col("definitions")).alias("sense"))


@query(
    f"""WITH {S.CORPUS}, z AS (SELECT pos, chengyu, trim(regexp_extract(example, '^([^(（]*)', 1), ' ') AS zh FROM corpus WHERE example IS NOT NULL AND chengyu <> ''),
a AS (SELECT *, instr(zh, chengyu) - 1 AS place FROM z), b AS (SELECT *, regexp_extract(left(zh, greatest(place, 0)), '(?s)^(.*[，。；：！？,;:])', 1) AS clause FROM a)
SELECT pos, CASE WHEN place >= 0 AND place + length(chengyu) > 12 AND clause <> '' THEN '…' || substr(zh, length(clause) + 1) ELSE zh END AS preview FROM b"""
)
def example_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples cut to the clause that holds the headword."""
    e = corpus(spark, sf_dir).where("example is not null and chengyu <> ''")
    return e.select("pos", X.example_preview(X.before_parenthesis(F.col("example")), F.col("chengyu"), 12).alias("preview"))


@query(f"WITH {S.ASKED}, {_SYL} SELECT query, {S.query_type('query')} AS query_type FROM asked, syl")
def query_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_queries(spark, sf_dir).select("query", Q.query_type(F.col("query"), known_syllables(spark, sf_dir)).alias("query_type"))


_EXPANSION = (
    "list_concat(" + ", ".join(f"CASE WHEN contains(lower(query), '{p}') THEN {S.strings(w)} ELSE [] END" for p, w in Q.PHRASES.items())
    + f", flatten(list_transform({S.tokens('query')}, lambda t: CASE t " + " ".join(f"WHEN '{k}' THEN {S.strings(v)}" for k, v in Q.SYNONYMS.items()) + " ELSE []::VARCHAR[] END)))"
)


@query(f"WITH {S.ASKED} SELECT query, CASE WHEN {S.has_han('query')} OR len({_EXPANSION}) = 0 THEN trim(query) ELSE trim(query) || ' ' || array_to_string({_EXPANSION}, ' ') END AS lexical_query FROM asked")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.variants(log_queries(spark, sf_dir)).select("query", "lexical_query")


_FEATS = f"""feats AS (SELECT pos, {S.tokens('meaning')} AS mt, {S.tokens('literal')} AS lt, {S.tokens('example')} AS et, {S.tokens("array_to_string(tags, ' ')")} AS tt,
  {S.tokens("concat_ws(' ', coalesce(meaning, ''), coalesce(literal, ''), coalesce(example, ''), coalesce(array_to_string(tags, ' '), ''))")} AS ct,
  {S.tokens("concat_ws(' ', coalesce(meaning, ''), coalesce(literal, ''), coalesce(example, ''))")} AS ft, lower(coalesce(literal, '')) AS lx FROM corpus),
post AS (SELECT pos, token, count(*) AS tf FROM (SELECT pos, unnest(ct) AS token FROM feats) GROUP BY ALL),
idf AS (SELECT token, count(*) AS df, ln(1 + ((SELECT count(*) FROM corpus) + 1) / (count(*) + 1)) AS idf FROM post GROUP BY token)"""


@query(f"WITH {S.CORPUS}, {_FEATS} SELECT token, df, round(idf, 9) AS idf FROM idf")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.TokenIndex(corpus(spark, sf_dir)).idf.withColumn("idf", F.round("idf", 9))


_LEXICAL = f"CASE WHEN {S.has_han('query')} OR len({_EXPANSION}) = 0 THEN trim(query) ELSE trim(query) || ' ' || array_to_string({_EXPANSION}, ' ') END"


def scored_ctes(by_type: bool = False) -> str:
    """Common tables up to ``s``: every pair of query and entry with its score, straight from the definition of the signals.

    With ``by_type`` the lexical form of queries is scored, under the weights of their type.
    """
    base = L.TokenWeights()

    class W:
        def __getattr__(self, name: str) -> str:
            cases = "".join(f" WHEN '{t}' THEN {more[name]}" for t, more in L.WEIGHTS_BY_TYPE.items() if by_type and name in more)
            return f"CASE q_.t{cases} ELSE {getattr(base, name)} END" if cases else str(getattr(base, name))

    w = W()
    lexed = f"lexed AS (SELECT query, {_LEXICAL} AS lex, {S.query_type('query')} AS t FROM asked, syl WHERE trim(query) <> '' AND length(query) <= 500)" if by_type else "lexed AS (SELECT query, query AS lex, '' AS t FROM asked)"
    n = "len(qt)"
    hits = lambda xs, ys: f"len(list_filter({xs}, lambda t: list_contains({ys}, t)))"
    return f"""{S.CORPUS}, {S.ASKED}, {_SYL}, {_FEATS}, {lexed},
q AS (SELECT *, list_distinct(qt) AS qs, {S.grams('qt', 2)} AS q2, {S.grams('qt', 3)} AS q3,
  list_filter(qt, lambda t: NOT list_contains(['feel', 'think', 'thing', 'make', 'becom', 'be', 'state', 'kind'], t)) AS rest FROM (SELECT query, lex, t, {S.tokens('lex')} AS qt FROM lexed WHERE NOT {S.has_han('query')}) WHERE len(qt) > 0),
q_ AS (SELECT *, CASE WHEN {n} <= 2 THEN qt WHEN len(rest) >= 2 THEN rest ELSE qt[-2:] END AS qf FROM q),
d AS (SELECT *, list_distinct(ct) AS cs, list_distinct({S.grams('lt', 2)}) AS l2, list_distinct({S.grams('ft', 2)}) AS f2, list_distinct({S.grams('ft', 3)}) AS f3 FROM feats),
qtok AS (SELECT query, token, count(*) AS qf FROM (SELECT query, unnest(qt) AS token FROM q_) GROUP BY ALL),
inter AS (SELECT query, pos, sum(least(qf, tf) * idf) AS shared, sum(ln(1 + tf)) AS log_tf FROM qtok JOIN post USING (token) JOIN idf USING (token) GROUP BY ALL),
qm AS (SELECT query, sum(qf * coalesce(idf, 1)) AS mass FROM qtok LEFT JOIN idf USING (token) GROUP BY ALL),
dm AS (SELECT pos, sum(tf * idf) AS mass FROM post JOIN idf USING (token) GROUP BY ALL),
s AS (SELECT q_.query, d.pos, round(
  {hits('qt', 'mt')} * {w.meaning} + {hits('qt', 'lt')} * {w.literal} + {hits('qt', 'et')} * {w.example} + {hits('qt', 'tt')} * {w.tag}
  + {hits('qs', 'lt')} / {n} * {w.literal_overlap} + CASE WHEN len(q2) > 0 THEN {hits('q2', 'l2')} / len(q2) * {w.literal_bigram} ELSE 0 END
  + CASE WHEN len(q2) > 0 THEN ({hits('q2', 'f2')} + {hits('q3', 'f3')}) / (len(q2) + len(q3)) * {w.multi_gram} ELSE 0 END
  + CASE WHEN contains(lx, lower(q_.lex)) THEN {w.literal_phrase} ELSE 0 END
  + coalesce(log_tf, 0) * {w.concept_tf} + {hits('qs', 'cs')} / {n} * {w.concept_overlap}
  + coalesce(shared / (qm.mass + dm.mass - shared), 0) * {w.jaccard} + {hits('qf', 'cs')} / len(qf) * {w.focused}
  + list_sum(list_transform(qt, lambda t: CASE WHEN list_contains(cs, t) OR length(t) < 4 THEN 0.0
      WHEN len(list_filter(cs, lambda v: length(v) >= 4 AND (starts_with(v, t) OR starts_with(t, v)))) > 0 THEN {w.fuzzy_prefix}
      WHEN len(list_filter(cs, lambda v: contains(v, t) OR contains(t, v))) > 0 THEN {w.fuzzy_contains} ELSE 0.0 END)), 9) AS score
  , q_.t FROM q_ CROSS JOIN d JOIN qm ON qm.query = q_.query LEFT JOIN dm ON dm.pos = d.pos LEFT JOIN inter ON inter.query = q_.query AND inter.pos = d.pos)"""


def _scored_sql(tail: str) -> str:
    return f"WITH {scored_ctes()}\n{tail}"


@query(_scored_sql("SELECT query, pos, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, pos) AS rank FROM s QUALIFY rank <= 20"))
def full_token_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best entries for every English query of the log, by all token signals."""
    return L.token_topk(L.TokenIndex(corpus(spark, sf_dir)), L.asked(log_queries(spark, sf_dir)))


@query(f"WITH {S.CORPUS}, {S.ASKED} SELECT DISTINCT query, pos FROM asked JOIN corpus ON trim(query) IN (chengyu, simplified, traditional)")
def exact_headword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.exact_headwords(corpus(spark, sf_dir), log_queries(spark, sf_dir))


@query(f"WITH {S.CORPUS}, {S.ASKED} SELECT query, pos FROM asked JOIN corpus ON {S.plain_pinyin('query')} = {S.plain_pinyin('pinyin')} WHERE NOT {S.has_han('query')} AND {S.plain_pinyin('query')} <> ''")
def normalize_latin_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.exact_pinyin(corpus(spark, sf_dir), log_queries(spark, sf_dir))


_SIGNALS = f"""WITH {S.CORPUS}, {S.ASKED}, {_SYL},
q AS (SELECT query, {S.words('query')} AS tk, {S.route_content(S.words('query'))} AS ck, {S.query_type('query')} AS query_type FROM asked, syl),
d AS (SELECT pos, array_to_string({S.words("concat_ws(' ', coalesce(meaning, ''), coalesce(literal, ''), coalesce(example, ''), coalesce(array_to_string(tags, ' '), ''))")}, ' ') AS tx,
  {S.words('meaning')} AS mw, {S.words('literal')} AS lw, {S.words('example')} AS ew, list_transform(coalesce(tags, []), lambda g: array_to_string({S.words('g')}, ' ')) AS tw FROM corpus),
sig AS (SELECT query, any_value(query_type) AS query_type, any_value(tk) AS tk, any_value(ck) AS ck,
  count_if(len(ck) > 0 AND contains(' ' || tx || ' ', ' ' || array_to_string(tk, ' ') || ' ')) AS phrase_hits,
  count_if(len(ck) > 0 AND list_has_all(string_split(tx, ' '), ck)) AS all_hits, count_if(list_has_any(string_split(tx, ' '), ck)) AS any_hits, count_if(list_has_any(tw, ck)) AS tag_hits,
  count_if(len(tk) = 1 AND list_contains(mw, tk[1])) AS meaning_hits, count_if(len(tk) = 1 AND list_contains(lw, tk[1])) AS literal_hits, count_if(len(tk) = 1 AND list_contains(ew, tk[1])) AS example_hits
  FROM q CROSS JOIN d GROUP BY query)"""


@query(_SIGNALS + " SELECT query, phrase_hits, all_hits, any_hits, tag_hits, meaning_hits, literal_hits, example_hits FROM sig")
def route_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.route_signals(corpus(spark, sf_dir), log_queries(spark, sf_dir)).drop("tokens", "content")


ROUTED = (
    _SIGNALS
    + """ SELECT query, query_type, CASE
 WHEN query_type = 'partial' AND len(tk) = 1 THEN CASE WHEN meaning_hits >= 40 THEN 'keyword' WHEN literal_hits >= 55 OR meaning_hits + literal_hits + example_hits + tag_hits >= 80 THEN 'hybrid' WHEN literal_hits >= 40 AND meaning_hits <= 10 THEN 'semantic' ELSE 'keyword' END
 WHEN query_type = 'thematic' AND len(tk) = 1 AND tag_hits >= 10 THEN 'keyword'
 WHEN query_type = 'thematic' AND len(ck) > 1 AND tag_hits >= 50 THEN 'semantic'
 WHEN query_type IN ('english_meaning', 'literal', 'thematic') AND phrase_hits > 0 AND len(ck) <= 3 THEN CASE WHEN len(ck) >= 3 AND any_hits > 100 THEN 'semantic' WHEN all_hits = 1 AND any_hits <= 30 THEN 'keyword' ELSE 'hybrid' END
 WHEN query_type IN ('english_meaning', 'literal', 'thematic') AND list_contains(tk, 'what') AND list_contains(tk, 'you') AND len(ck) <= 2 THEN 'hybrid'
 WHEN query_type IN ('english_meaning', 'literal', 'thematic') THEN 'semantic' ELSE 'hybrid' END AS mode FROM sig"""
)


@query(ROUTED)
def route_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = log_queries(spark, sf_dir)
    types = q.select("query", Q.query_type(F.col("query"), known_syllables(spark, sf_dir)).alias("query_type"))
    return L.routed(L.route_signals(corpus(spark, sf_dir), q), types)

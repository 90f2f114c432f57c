"""The corpus as features and inverted indexes, and scores by words."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hybridrank.functions.query import ROUTE_STOPWORDS, focused, listed, preferred_mode
from hybridrank.functions.text import content_tokens, frequencies, has_unified_han, ngrams, plain_pinyin, route_text, words
from hybridrank.operators.grams import containing
from hybridrank.operators.scoring import SIGNALS, best_entries, first_holding, signal_counts
from hybridrank.runtime import Scratch


@dataclass(frozen=True)
class TokenWeights:
    """What each kind of evidence counts in a token score."""

    meaning: float = 0.33
    literal: float = 0.20
    example: float = 0.08
    tag: float = 0.18
    literal_overlap: float = 0.6
    literal_bigram: float = 0.45
    literal_phrase: float = 0.8
    multi_gram: float = 0.3
    concept_tf: float = 0.08
    concept_overlap: float = 0.25
    jaccard: float = 0.36
    focused: float = 0.22
    fuzzy_prefix: float = 0.06
    fuzzy_contains: float = 0.03


#: Weights that differ by type of query.
WEIGHTS_BY_TYPE = {"thematic": {"tag": 0.45, "concept_overlap": 0.5}, "literal": {"literal_overlap": 0.7, "literal_phrase": 1.0}}


def entries(rows: DataFrame) -> DataFrame:
    """The corpus with one row per position; a position given twice counts once."""
    rest = [c for c in rows.columns if c not in ("pos", "updated_at", "loaded_at")]
    return rows.groupBy("pos").agg(F.min(F.struct("id", *[c for c in rest if c != "id"])).alias("r")).select("pos", *[f"r.{c}" for c in rest])


def _text(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def features(corpus: DataFrame) -> DataFrame:
    """``(pos, meaning, literal, example, tag, concept, fields)``: token arrays, and the literal's text."""
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")
    fields = _text(F.col("meaning"), F.col("literal"), F.col("example"))
    return corpus.select(
        "pos", content_tokens(F.col("meaning")).alias("meaning"), content_tokens(F.col("literal")).alias("literal"), content_tokens(F.col("example")).alias("example"),
        content_tokens(tags).alias("tag"), content_tokens(F.concat_ws(" ", fields, tags)).alias("concept"), content_tokens(fields).alias("fields"),
        F.lower(F.coalesce("literal", F.lit(""))).alias("literal_text"),
    )


def postings(feats: DataFrame) -> DataFrame:
    """``(token, pos, tf, m, l, e, t)``: one row per different token of an entry, and the fields it is in."""
    flag = lambda c: F.array_contains(c, F.col("token")).cast("int")
    rows = feats.select("pos", "meaning", "literal", "example", "tag", F.explode(frequencies(F.col("concept"))).alias("token", "tf"))
    return rows.select("token", "pos", "tf", flag("meaning").alias("m"), flag("literal").alias("l"), flag("example").alias("e"), flag("tag").alias("t"))


def idf_table(post: DataFrame, documents: int) -> DataFrame:
    """``(token, df, idf)`` with ``idf = ln(1 + (N + 1) / (df + 1))``."""
    return post.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(1 + F.lit(documents + 1) / (F.col("df") + 1)))


def asked(queries: DataFrame, query: str = "query") -> DataFrame:
    """Different queries with their tokens; queries in Han script or without tokens ask nothing here."""
    q = queries.select(F.col(query).alias("query")).where("query is not null").distinct()
    return q.where(~has_unified_han(F.col("query"))).withColumn("tokens", content_tokens(F.col("query"))).where(F.size("tokens") > 0)


@dataclass
class TokenIndex:
    """Everything that scoring by tokens needs of a corpus: tables written once, since many joins read them."""

    corpus: DataFrame
    feats: DataFrame = field(init=False)
    post: DataFrame = field(init=False)
    idf: DataFrame = field(init=False)
    documents: int = field(init=False)

    def __post_init__(self) -> None:
        scratch = Scratch(self.corpus.sparkSession, "tokens")
        self.feats = scratch.keep(features(self.corpus), "features", documents=F.count(F.lit(1)))
        self.documents = scratch.facts["documents"]
        self.post = scratch.keep(postings(self.feats), "postings")
        self.idf = scratch.keep(idf_table(self.post, self.documents), "idf")


def _related(index: TokenIndex, per_token: DataFrame) -> DataFrame:
    """``(v, token, prefix)``: words of the corpus that hold a token of four letters or more, and the other way round."""
    vocabulary = index.idf.select(F.col("token").alias("v"))
    part = per_token.where(F.length("token") >= 4).select("token").distinct()
    same = lambda df, c: df.select(F.col(c), F.col(c).alias("same"))
    wider = containing(part, "token", same(vocabulary, "v"), "same", "v").select("v", "token")
    narrower = containing(vocabulary, "v", same(part, "token"), "same", "token").select("v", "token")
    either = lambda f: f(F.col("v"), F.col("token")) | f(F.col("token"), F.col("v"))
    return wider.union(narrower).distinct().withColumn("prefix", (F.length("v") >= 4) & either(F.startswith))


def token_scores(index: TokenIndex, q: DataFrame, w: TokenWeights = TokenWeights()) -> DataFrame:
    """``(query, pos, score)`` for every entry with any evidence for a query.

    ``q`` comes from ``asked``.  Entries that are not in the result score 0.
    All evidence is found by equi-joins: of query tokens and n-grams with the
    inverted index, and for whole phrases and parts of words by their rarest
    run of characters.
    """
    post, n = index.post, F.size("tokens")
    per_token = q.select("query", n.alias("n"), focused(F.col("tokens")).alias("focus"), F.explode(frequencies(F.col("tokens"))).alias("token", "occ"))
    per_token = per_token.withColumn("in_focus", F.size(F.filter("focus", lambda t: t == F.col("token")))).withColumn("n_focus", F.size("focus")).drop("focus")
    weighed = per_token.join(index.idf.select("token", "idf"), "token", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    q_mass = weighed.groupBy("query").agg(F.sum(F.col("occ") * F.col("idf")).alias("q_mass"))
    d_mass = post.join(index.idf, "token").groupBy("pos").agg(F.sum(F.col("tf") * F.col("idf")).alias("d_mass"))
    hit = weighed.join(post, "token").groupBy("query", "pos").agg(
        F.first("n").alias("n"), F.first("n_focus").alias("n_focus"),
        F.sum(F.col("occ") * (F.col("m") * w.meaning + F.col("l") * w.literal + F.col("e") * w.example + F.col("t") * w.tag)).alias("fields"),
        F.sum("l").alias("literal_hits"), F.count(F.lit(1)).alias("concept_hits"), F.sum(F.log1p("tf")).alias("log_tf"),
        F.sum(F.least("occ", "tf") * F.col("idf")).alias("shared"), F.sum("in_focus").alias("focus_hits"),
    )
    hit = hit.join(q_mass, "query").join(d_mass, "pos")
    direct = hit.select(
        "query", "pos",
        (F.col("fields") + F.col("literal_hits") / F.col("n") * w.literal_overlap + F.col("log_tf") * w.concept_tf + F.col("concept_hits") / F.col("n") * w.concept_overlap
         + F.col("shared") / (F.col("q_mass") + F.col("d_mass") - F.col("shared")) * w.jaccard + F.col("focus_hits") / F.col("n_focus") * w.focused).alias("score"),
    )

    two, three = ngrams(F.col("tokens"), 2), ngrams(F.col("tokens"), 3)
    grams = q.select("query", F.size(two).alias("n2"), (F.size(two) + F.size(three)).alias("n_all"), F.explode(F.concat(two, three)).alias("gram"))
    grams = grams.groupBy("query", "gram").agg(F.first("n2").alias("n2"), F.first("n_all").alias("n_all"), F.count(F.lit(1)).alias("occ"))
    gram_post = index.feats.select("pos", F.array_distinct(ngrams(F.col("literal"), 2)).alias("lit"), F.array_distinct(F.concat(ngrams(F.col("fields"), 2), ngrams(F.col("fields"), 3))).alias("all"))
    gram_post = gram_post.select("pos", "lit", "all", F.explode(F.array_union("lit", "all")).alias("gram")).select(
        "pos", "gram", F.array_contains("lit", F.col("gram")).cast("int").alias("in_lit"), F.array_contains("all", F.col("gram")).cast("int").alias("in_all")
    )
    by_gram = grams.join(gram_post, "gram").select(
        "query", "pos", (F.coalesce(F.try_divide(F.col("occ") * F.col("in_lit"), F.col("n2")), F.lit(0.0)) * w.literal_bigram + F.col("occ") * F.col("in_all") / F.col("n_all") * w.multi_gram).alias("score")
    )

    asked_for = q.select("query", F.lower("query").alias("low"))
    texts = index.feats.where("literal_text <> ''").select("pos", "literal_text")
    phrase = containing(asked_for, "low", texts, "pos", "literal_text").join(asked_for, "low").select("query", "pos", F.lit(w.literal_phrase).alias("score"))

    related = _related(index, per_token)
    kin = per_token.select("query", "token", "occ").join(related, "token").join(post.select(F.col("token").alias("v"), "pos"), "v")
    kin = kin.groupBy("query", "token", "pos").agg(F.first("occ").alias("occ"), F.max(F.col("v") == F.col("token")).alias("same"), F.max("prefix").alias("prefix"))
    partial = kin.where("not same").select("query", "pos", (F.col("occ") * F.when(F.col("prefix"), w.fuzzy_prefix).otherwise(w.fuzzy_contains)).alias("score"))

    total = direct.unionByName(by_gram).unionByName(phrase).unionByName(partial).groupBy("query", "pos").agg(F.sum("score").alias("score"))
    return total.withColumn("score", F.round("score", 9))


def scored_entries(index: TokenIndex, vectors: DataFrame | None = None) -> DataFrame:
    """The entries of an index as ``scoring.best_entries`` takes them; ``vectors`` is ``(pos, vec)``."""
    scratch = Scratch(index.corpus.sparkSession, "scored")
    d_mass = index.post.join(index.idf, "token").groupBy("pos").agg(F.sum(F.col("tf") * F.col("idf")).alias("d_mass"))
    rows = index.feats.join(d_mass, "pos", "left")
    return scratch.keep(rows if vectors is None else rows.join(vectors.select("pos", "vec"), "pos", "left"), "entries")


def scored_queries(index: TokenIndex, q: DataFrame) -> DataFrame:
    """``q`` (``query, text, tokens, kind`` and more) as ``scoring.best_entries`` takes it: with the weight of every token, and the words of the corpus that hold it or are part of it."""
    scratch = Scratch(index.corpus.sparkSession, "asked")
    q = scratch.keep(q.withColumn("low", F.lower("text")).withColumn("focus", focused(F.col("tokens"))), "asked")
    per_token = q.select("query", "focus", F.explode(frequencies(F.col("tokens"))).alias("token", "occ"))
    per_token = per_token.withColumn("in_focus", F.size(F.filter("focus", lambda t: t == F.col("token")))).drop("focus")
    kin = _related(index, per_token).groupBy("token").agg(F.collect_list(F.struct("v", "prefix")).alias("kin"))
    weighed = per_token.join(index.idf.select("token", "idf"), "token", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0))).join(kin, "token", "left")
    terms = weighed.groupBy("query").agg(F.sum(F.col("occ") * F.col("idf")).alias("q_mass"), F.collect_list(F.struct("token", "occ", "in_focus", "idf", "kin")).alias("terms"))
    return scratch.keep(q.withColumn("n_focus", F.size("focus")).drop("focus", "text").join(terms, "query"), "queries")


def token_topk(index: TokenIndex, q: DataFrame, k: int = 20, w: TokenWeights = TokenWeights()) -> DataFrame:
    """``(query, pos, score, rank)``: the ``k`` best entries for each query.

    Entries without evidence score 0 and rank by their position.  No row is made
    for a pair of a query and an entry that is not among the best of its block.
    """
    asked_for = scored_queries(index, q.select("query", F.col("query").alias("text"), "tokens", F.lit(0).alias("kind")))
    best = best_entries(scored_entries(index), asked_for, [asdict(w)], k)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "pos")
    pos_type = dict(index.feats.dtypes)["pos"]
    return best.select("query", F.col("pos").cast(pos_type).alias("pos"), "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_containing(texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query, pos, rank)``: the first ``k`` entries whose text holds the phrase of a query.

    ``texts`` holds ``pos, text``, ``queries`` different queries as ``query,
    low``; an empty phrase is in none.  Every text is looked at in blocks, and of
    a block only its first ``k`` rows leave it.
    """
    scratch = Scratch(texts.sparkSession, "phrases")
    found = first_holding(scratch.keep(texts.where("text is not null"), "texts"), scratch.keep(queries, "queries"), k)
    order = Window.partitionBy("query").orderBy("pos")
    return found.select("query", F.col("pos").cast(dict(texts.dtypes)["pos"]).alias("pos")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_headwords(corpus: DataFrame, queries: DataFrame, query: str = "query") -> DataFrame:
    """``(query, pos)`` of entries of which a form is the trimmed query; every sense is kept."""
    forms = corpus.select("pos", F.explode(F.array_distinct(F.array_compact(F.array("chengyu", "simplified", "traditional")))).alias("form"))
    return queries.select(F.col(query).alias("query")).distinct().join(forms, F.trim("query") == F.col("form")).select("query", "pos").distinct()


def exact_pinyin(corpus: DataFrame, queries: DataFrame, query: str = "query") -> DataFrame:
    """``(query, pos)`` of entries that read like the query, tones aside."""
    keyed = corpus.select("pos", plain_pinyin(F.col("pinyin")).alias("key")).where("key <> ''")
    q = queries.select(F.col(query).alias("query")).distinct().where(~has_unified_han(F.col("query")))
    return q.withColumn("key", plain_pinyin(F.col("query"))).where("key <> ''").join(keyed, "key").select("query", "pos")


def route_signals(corpus: DataFrame, queries: DataFrame, query: str = "query") -> DataFrame:
    """``(query, tokens, content, phrase_hits, all_hits, any_hits, tag_hits, meaning_hits, literal_hits, example_hits)``.

    How many entries hold the query as a phrase, all or any of its content
    words, one of them as a tag, and (for one-word queries) the word in each
    field.  Entries are counted by sets of bits, block by block, so that no row
    is made for a pair; a phrase is looked for only in entries that hold all its
    words.
    """
    scratch = Scratch(corpus.sparkSession, "signals")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    text = route_text(_text(F.col("meaning"), F.col("literal"), F.col("example"), F.array_join(tags, " ")))
    docs = corpus.select(
        "pos", text.alias("text"), words(F.col("meaning")).alias("mw"), words(F.col("literal")).alias("lw"), words(F.col("example")).alias("ew"), F.transform(tags, route_text).alias("tw")
    )
    q = queries.select(F.col(query).alias("query")).where("query is not null").distinct()
    q = q.withColumn("tokens", words(F.col("query"))).withColumn("content", F.filter("tokens", lambda t: ~F.array_contains(listed(ROUTE_STOPWORDS), t)))
    q = scratch.keep(q, "queries")
    counts = signal_counts(scratch.keep(docs, "entries"), q)
    return q.join(counts, "query", "left").select("query", "tokens", "content", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in SIGNALS])


def routed(signals: DataFrame, types: DataFrame) -> DataFrame:
    """``(query, query_type, mode)`` from the signals and the type of each query."""
    s = {c: F.col(c) for c in signals.columns if c.endswith("_hits")}
    return signals.join(types.select("query", "query_type").distinct(), "query").select("query", "query_type", preferred_mode(F.col("query_type"), F.col("tokens"), F.col("content"), s).alias("mode"))


def described(queries: DataFrame, corpus: DataFrame, normalized: DataFrame) -> DataFrame:
    """``(query, described)``: whether a query describes a meaning, and is not a lookup.

    Blank queries, readings and exact headwords are lookups; so is a Han query
    whose normalized form (``query, normalized``) is a headword or at most four
    characters long.  ``queries`` holds ``query, query_type``.
    """
    rows = queries.select("query", "query_type").distinct().join(normalized, "query", "left")
    forms = exact_headwords(corpus, queries).select("query").distinct().withColumn("exact", F.lit(True))
    again = exact_headwords(corpus, normalized, "normalized").select(F.col("query").alias("normalized")).distinct().withColumn("exact_again", F.lit(True))
    rows = rows.join(forms, "query", "left").join(again, "normalized", "left")
    han = has_unified_han(F.col("query"))
    lookup = (F.trim("query") == "") | (F.col("query_type") == "pinyin") | F.coalesce("exact", F.lit(False)) | (han & (F.coalesce("exact_again", F.lit(False)) | (F.length(F.coalesce("normalized", "query")) <= 4)))
    return rows.select("query", (~lookup).alias("described"))


def hosted_status(asked: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(query, status, path)`` of each query of ``asked`` (``query, described``).

    A description with a vector in ``vectors`` (``query, reason``; a null reason
    means the vector is there) is complete by meaning; one that still waits is
    pending; one whose vector cannot be had falls back to the routed search, and
    is unavailable where that is in Han script, which no token search answers.
    """
    rows = asked.join(vectors.select("query", "reason", F.lit(True).alias("tried")), "query", "left")
    ready, waits = F.col("tried") & F.col("reason").isNull(), F.coalesce(F.col("reason") == "timeout", F.lit(False))
    status = F.when(~F.col("described") | F.coalesce(ready, F.lit(False)), "complete").when(waits, "pending").when(has_unified_han(F.col("query")), "unavailable").otherwise("complete")
    path = F.when(~F.col("described"), "routed").when(F.coalesce(ready, F.lit(False)), "meaning").when(status == "complete", "fallback")
    return rows.select("query", status.alias("status"), path.alias("path"))

"""Query understanding: what kind of question a text asks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridrank.functions.text import STOPWORDS, content_tokens, has_unified_han, plain_pinyin, words

#: Concrete nouns that mark a literal query.
CONCRETE = ["ant", "ape", "bird", "bull", "cat", "cow", "dog", "dragon", "elephant", "fish", "fox", "frog", "goat", "horse", "lion", "monkey", "pig", "rabbit", "snake", "tiger", "wolf", "arm", "back", "body", "ear", "eye", "face", "foot", "hand", "head", "heart", "leg", "mouth", "needle", "road", "seedling", "stump", "tail", "thread", "tree", "well", "window"]
#: Words that mark a theme.
THEMES = ["animal", "animals", "battle", "battles", "family", "food", "friendship", "government", "learning", "money", "moon", "nature", "politics", "relationship", "relationships", "scenery", "study", "studying", "war", "wealth"]
#: Abstract nouns.
ABSTRACT = ["anger", "battle", "beauty", "conflict", "courage", "destiny", "emotion", "fate", "fortune", "friendship", "government", "greed", "happiness", "hate", "honor", "hope", "justice", "knowledge", "love", "luck", "nature", "peace", "politics", "poverty", "power", "respect", "sadness", "scenery", "society", "success", "truth", "war", "wealth", "wisdom"]
#: Single words that ask for part of a headword.
PARTIAL = ["animal", "animals", "bird", "birds", "cow", "dog", "dragon", "elephant", "fish", "fox", "frog", "goat", "heart", "horse", "mountain", "moon", "rabbit", "snake", "tiger", "tree", "water", "well", "wolf"]
#: Phrases with the words they add, and stemmed tokens with theirs.
PHRASES = {"no way out": ["hopeless", "desperate"], "backfires": ["futile", "failed"], "working hard without rest": ["tireless", "diligent"], "doing something useless": ["futile", "fruitless", "vain"], "feeling nostalgic": ["homesick", "wistful", "yearning"], "pretending to be something": ["hypocrite", "fake", "pretense"], "two people in love": ["romance", "lovers", "couple"], "bittersweet feelings": ["mixed", "joy", "sorrow"], "accepting fate": ["destiny", "resigned", "inevitable"], "nature and scenery": ["landscape", "pastoral", "beautiful"], "food and eating": ["meal", "appetite", "feast"], "money and wealth": ["fortune", "prosperity", "rich"]}
SYNONYMS = {"hopeless": ["despair", "helpless", "desperate"], "useless": ["futile", "vain", "pointless"], "angry": ["furious", "rage", "wrath"], "rare": ["scarce", "uncommon", "precious"], "love": ["romance", "affection"], "nostalgic": ["wistful", "sentimental"], "mistake": ["error", "wrong"], "danger": ["risk", "peril"], "cooperate": ["cooperation", "unite", "together"], "wealth": ["rich", "fortune", "money"], "war": ["battle", "fight", "conflict"], "fate": ["destiny", "fortune"]}
#: The mode for a type of query that no rule decides.
MODE_BY_TYPE = {"english_meaning": "semantic", "thematic": "semantic", "literal": "semantic", "partial": "hybrid", "pinyin": "hybrid", "chinese_exact": "hybrid"}
#: Words without content for routing.
ROUTE_STOPWORDS = [*STOPWORDS, "what", "you", "your"]


def listed(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _without(tokens: Column, stop: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~F.array_contains(listed(stop), t))


def is_pinyin(query: Column, syllables: Column) -> Column:
    """Two to eight known syllables and nothing else; none of them a stopword."""
    tokens = F.split(plain_pinyin(query), " ")
    fits = F.forall(tokens, lambda t: F.array_contains(syllables, t) & ~F.array_contains(listed(STOPWORDS), t))
    return ~has_unified_han(query) & F.size(tokens).between(2, 8) & fits


def query_type(query: Column, syllables: Column) -> Column:
    """The kind of a query, decided in a fixed order; blank queries ask for a meaning."""
    tokens = words(query)
    content = _without(tokens, STOPWORDS)
    n = F.size(tokens)
    has = lambda xs, values: F.exists(xs, lambda t: F.array_contains(listed(values), t))
    literal = n.between(4, 8) & (F.size(content) >= 3) & has(content, CONCRETE)
    short = has(content, THEMES) | ((F.size(content) > 0) & F.forall(content, lambda t: F.array_contains(listed(ABSTRACT), t))) | (F.try_element_at(tokens, F.lit(1)) == "the")
    at = F.array_position(tokens, "and").cast("int")
    beside = lambda i: F.coalesce(F.array_contains(listed(ABSTRACT), F.get(tokens, i)), F.lit(False))
    joined = (at > 1) & (at < n) & beside(at - 2) & beside(at)
    thematic = (n == 1) | ((n <= 3) & short) | joined
    return (
        F.when(F.trim(F.coalesce(query, F.lit(""))) == "", "english_meaning")
        .when(has_unified_han(query), "chinese_exact")
        .when(is_pinyin(query, syllables), "pinyin")
        .when(n == 0, "english_meaning")
        .when((n == 1) & has(tokens, PARTIAL), "partial")
        .when(literal, "literal")
        .when(thematic, "thematic")
        .otherwise("english_meaning")
    )


def expanded(query: Column) -> Column:
    """A query with the words its phrases and stemmed tokens add; Han queries stay."""
    low = F.lower(F.trim(query))
    none = F.array().cast("array<string>")
    by_phrase = F.concat(*[F.when(low.contains(p), listed(ws)).otherwise(none) for p, ws in PHRASES.items()])
    table = F.create_map(*[x for k, ws in SYNONYMS.items() for x in (F.lit(k), listed(ws))])
    by_token = F.flatten(F.transform(content_tokens(query), lambda t: F.coalesce(F.try_element_at(table, t), none)))
    more = F.concat(by_phrase, by_token)
    return F.when(has_unified_han(query) | (F.size(more) == 0), F.trim(query)).otherwise(F.concat(F.trim(query), F.lit(" "), F.array_join(more, " ")))


def variants(queries: DataFrame, query: str = "query") -> DataFrame:
    """``queries`` with the direct, semantic and lexical form of each query."""
    q = F.col(query)
    return queries.withColumns({"direct_query": F.trim(q), "semantic_query": F.trim(q), "lexical_query": expanded(q)})


def focused(tokens: Column) -> Column:
    """Tokens without generic ones, or the last two if fewer than two are left."""
    generic = ["feel", "think", "thing", "make", "becom", "be", "state", "kind"]
    rest = _without(tokens, generic)
    return F.when(F.size(tokens) <= 2, tokens).when(F.size(rest) >= 2, rest).otherwise(F.slice(tokens, -2, 2))


def preferred_mode(query_type: Column, tokens: Column, content: Column, s: dict[str, Column]) -> Column:
    """The search mode for a query, from how often its words occur in the corpus."""
    single = s["meaning_hits"] + s["literal_hits"] + s["example_hits"] + s["tag_hits"]
    one, few = F.size(tokens) == 1, F.size(content) <= 3
    partial = (
        F.when(s["meaning_hits"] >= 40, "keyword").when((s["literal_hits"] >= 55) | (single >= 80), "hybrid")
        .when((s["literal_hits"] >= 40) & (s["meaning_hits"] <= 10), "semantic").otherwise("keyword")
    )
    phrase = (
        F.when((F.size(content) >= 3) & (s["any_hits"] > 100), "semantic")
        .when((s["all_hits"] == 1) & (s["any_hits"] <= 30), "keyword").otherwise("hybrid")
    )
    open_type = query_type.isin("english_meaning", "literal", "thematic")
    asks = F.array_contains(tokens, "what") & F.array_contains(tokens, "you") & (F.size(content) <= 2)
    by_type = F.create_map(*[F.lit(x) for kv in MODE_BY_TYPE.items() for x in kv])
    return (
        F.when((query_type == "partial") & one, partial)
        .when((query_type == "thematic") & one & (s["tag_hits"] >= 10), "keyword")
        .when((query_type == "thematic") & (F.size(content) > 1) & (s["tag_hits"] >= 50), "semantic")
        .when(open_type & (s["phrase_hits"] > 0) & few, phrase)
        .when(open_type & asks, "hybrid")
        .otherwise(F.coalesce(F.try_element_at(by_type, query_type), F.lit("hybrid")))
    )

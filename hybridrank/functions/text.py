"""Text functions as column expressions: everything stays inside the JVM.

Only ``normalized`` (compatibility and canonical forms) needs Python, since
Spark SQL has no Unicode normalisation.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "its", "of", "on", "or", "that", "the", "their", "this", "to", "with", "like", "up", "out", "off", "over", "under", "about", "through"]
#: The stemming endings with the least length of a word that loses them, first hit first.
ENDINGS = [("ing", 6), ("ed", 5), ("es", 5), ("s", 4)]
#: Pinyin vowels with tone marks by their plain letters.
PLAIN_VOWELS = {"a": "āáǎàăâäãå", "e": "ēéěèĕêë", "i": "īíǐìĭîï", "o": "ōóǒòŏôöõ", "u": "ūúǔùŭûüǖǘǚǜ", "n": "ñńňǹ", "c": "ç", "m": "ḿ"}
#: Marks that comparisons of variants ignore.
COMPACT_MARKS = r"[\s,，.。、;；:：!！?？'\"“”‘’()（）\-—·…]"


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; null and blank give none."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def stem(word: Column) -> Column:
    """A word without its first fitting ending; words of three letters stay."""
    out = word
    for end, least in reversed(ENDINGS):
        out = F.when(F.endswith(word, F.lit(end)) & (F.length(word) >= least), word.substr(F.lit(1), F.length(word) - len(end))).otherwise(out)
    return F.when(F.length(word) <= 3, word).otherwise(out)


def content_tokens(text: Column) -> Column:
    """Stemmed words, then without stopwords and single letters (in this order)."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.transform(words(text), stem), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring tokens, joined by spaces; none if there are fewer."""
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.when(F.size(tokens) >= n, F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def frequencies(tokens: Column) -> Column:
    """Map of token to its number."""
    return F.map_from_entries(F.transform(F.array_distinct(tokens), lambda t: F.struct(t, F.size(F.filter(tokens, lambda x: x == t)))))


def plain_pinyin(text: Column) -> Column:
    """Lower-case letters of pinyin without tones or digits, parted by single spaces."""
    accents = "".join(PLAIN_VOWELS.values())
    letters = "".join(k * len(v) for k, v in PLAIN_VOWELS.items())
    bare = F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), accents, letters), "[\\u0300-\\u036f0-9]", "")
    return F.trim(F.regexp_replace(bare, "[^a-z]+", " "))


def has_unified_han(text: Column) -> Column:
    """Whether a unified ideograph (U+4E00 to U+9FFF) occurs."""
    return F.coalesce(text.rlike("[\\u4e00-\\u9fff]"), F.lit(False))


def has_han_script(text: Column) -> Column:
    """Whether any character of the Han script occurs."""
    return F.coalesce(text.rlike("\\p{IsHan}"), F.lit(False))


def has_display_han(text: Column) -> Column:
    """Whether a character from U+3400 to U+9FFF occurs."""
    return F.coalesce(text.rlike("[\\u3400-\\u9fff]"), F.lit(False))


def half_width(text: Column) -> Column:
    """Full-width ASCII letters and digits as plain ones, trimmed."""
    plain = "".join(map(chr, [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]))
    return F.trim(F.translate(text, "".join(chr(ord(c) + 0xFEE0) for c in plain), plain))


def squashed(score: Column, scale: float) -> Column:
    """A positive score relative to ``scale``, at most 1; other scores give 0."""
    good = ~F.isnan(score) & (F.abs(score) < float("inf")) & (score > 0)
    return F.when(good, F.least(score / scale, F.lit(1.0))).otherwise(F.lit(0.0))


def percent(score: Column) -> Column:
    """A score as a whole percentage from 0 to 100, halves rounded up."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(score * 100 + 0.5))).cast("int")


def route_text(text: Column) -> Column:
    """Lower-case words joined by single spaces."""
    return F.array_join(words(text), " ")


def single_spaced(text: Column) -> Column:
    """Trimmed text with single spaces; null gives an empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def normalized(text: Column, form: str = "NFKC") -> Column:
    """Unicode normalisation, in Arrow batches."""

    @F.pandas_udf("string")
    def norm(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return norm(text)


def cache_key(text: Column, *about: str) -> Column:
    """The key under which the vector of a query is kept: normalised text after what produced it."""
    low = F.lower(normalized(text))
    return F.concat_ws("::", *[F.lit(a) for a in about], F.regexp_replace(F.trim(F.regexp_replace(low, r"(?U)\s+", " ")), "[.!?]+$", ""))


def dictionary_pinyin_key(text: Column) -> Column:
    """Pinyin as dictionaries compare it: lower case, single spaces, no other signs."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9üv:]+", " "))


def compact(text: Column) -> Column:
    """Text without spaces and punctuation, lower case: what variants are compared by."""
    return F.lower(F.regexp_replace(half_width(F.coalesce(text, F.lit(""))), COMPACT_MARKS, ""))


def html_escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def tone_marked(syllable: Column) -> Column:
    """A syllable with a tone number as one with a combining tone mark.

    The mark goes after a, else o, else e, else the last letter of iu or ui,
    else the first of i, u, ü.  Other texts stay as they are.
    """
    fits = syllable.rlike("(?i)^[a-züv:]+[1-5]$")
    tone = F.right(syllable, F.lit(1))
    base = F.translate(F.replace(F.lower(F.regexp_replace(syllable, "[1-5]$", "")), F.lit("u:"), F.lit("ü")), "v", "ü")
    at = F.lit(0)
    for vowel in ("ü", "u", "i"):
        at = F.when(base.contains(vowel), F.instr(base, vowel)).otherwise(at)
    at = F.when(base.contains("iu"), F.instr(base, "iu") + 1).when(base.contains("ui"), F.instr(base, "ui") + 1).otherwise(at)
    for vowel in ("e", "o", "a"):
        at = F.when(base.contains(vowel), F.instr(base, vowel)).otherwise(at)
    mark = F.translate(tone, "12345", "\u0304\u0301\u030c\u0300")
    toned = F.concat(base.substr(F.lit(1), at), mark, base.substr(at + 1, F.length(base)))
    return F.when(~fits, syllable).when(at == 0, base).otherwise(toned)


def aligned_syllables(headword: Column, pinyin: Column) -> Column:
    """Each character with its syllable; characters that are not Han take none."""
    chars = F.filter(F.split(headword, ""), lambda c: c != "")
    spoken = F.filter(F.split(F.regexp_replace(pinyin, "[,，]", " "), r"\s+"), lambda s: s != "")
    han = lambda c: c.rlike("[\\u3400-\\u9fff]")
    before = lambda i: F.size(F.filter(F.slice(chars, 1, i), han))
    return F.transform(chars, lambda c, i: F.struct(c.alias("character"), F.when(han(c), F.try_element_at(spoken, before(i + 1))).alias("syllable")))


def example_parts(example: Column) -> Column:
    """An example as its Chinese part and the translation in the closing parentheses."""
    form = r"(?s)^(.*?)\s*[(（]([^()（）]*)[)）]\s*$"
    split = example.rlike(form)
    return F.struct(F.when(split, F.regexp_extract(example, form, 1)).otherwise(example).alias("zh"), F.when(split, F.regexp_extract(example, form, 2)).alias("en"))


def before_parenthesis(text: Column) -> Column:
    """The text up to its first parenthesis of either width."""
    return F.trim(F.regexp_extract(text, "^([^(（]*)", 1))


def idiom_notes(meaning: Column) -> Column:
    """The remarks in ``(idiom, …)`` notes joined by ``; ``, and the meaning without the notes."""
    found = F.regexp_extract_all(meaning, F.lit(r"(?i)\s*\(\s*idiom\b,?\s*([^()]*)\)"), F.lit(1))
    notes = F.filter(F.transform(found, lambda n: F.regexp_replace(F.trim(n), r"\.$", "")), lambda n: n != "")
    rest = F.regexp_replace(meaning, r"(?i)\s*\(\s*idiom\b,?\s*([^()]*)\)", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"\s+([;,.])", "$1"), r";\s*;", ";")
    return F.struct(F.array_join(notes, "; ").alias("note"), F.trim(F.regexp_replace(rest, r"^[;,\s]+|[;,\s]+$", "")).alias("meaning"))


def visible_tags(tags: Column, formality: Column) -> Column:
    """The first four tags, and a formality other than formal that is not among them."""
    first = F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, 4)
    more = formality.isNotNull() & (formality != "formal") & ~F.array_contains(first, formality)
    return F.when(F.coalesce(more, F.lit(False)), F.array_append(first, formality)).otherwise(first)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text over its UTF-16 units; null counts as empty."""
    units = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE"))
    starts = F.when(F.length(units) > 0, F.sequence(F.lit(0), (F.length(units) / 4 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    codes = F.transform(starts, lambda i: F.conv(units.substr(i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: h.bitwiseXOR(c) * F.lit(16777619) % F.lit(4294967296))


def stable_id(headword: Column, pinyin: Column) -> Column:
    """An identifier that depends on the headword and its reading only."""
    body = F.to_json(F.struct(single_spaced(headword).alias("chengyu"), single_spaced(pinyin).alias("pinyin")))
    return F.concat(F.lit("chengyu_"), F.substring(F.sha1(body), 1, 16))


def legacy_id(entry: dict[str, Column], tags: Column) -> Column:
    """The identifier of old records, over all their texts; ``entry`` holds chengyu, pinyin, literal, meaning, example and formality."""
    order = ("chengyu", "pinyin", "literal", "meaning", "example")
    listed = F.transform(F.coalesce(tags, F.array().cast("array<string>")), single_spaced)
    body = F.to_json(F.struct(*[single_spaced(entry[f]).alias(f) for f in order], listed.alias("tags"), single_spaced(entry["formality"]).alias("formality")))
    return F.concat(F.lit("chengyu_"), F.substring(F.sha1(body), 1, 16))


def character_sense(sense: Column) -> Column:
    """A dictionary sense for a one-line gloss: without measure words, cross-references and pinyin in brackets."""
    out = F.coalesce(sense, F.lit(""))
    for pattern in (r"\(?CL:[^)]*\)?", r"(?i)\((?:variant of|old variant of|see|also written|same as)[^)]*\)", r"\[[^\]]*\]", r"(?i)\(bound form\)\s*"):
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^[\s;,]+|[\s;,]+$", "")


def example_preview(zh: Column, headword: Column, visible: int) -> Column:
    """An example from the clause on that holds the headword, where it would else end beyond ``visible`` characters."""
    at = F.instr(zh, headword) - 1
    clause = F.regexp_extract(zh.substr(F.lit(1), F.greatest(at, F.lit(0))), r"(?s)^(.*[，。；：！？,;:])", 1)
    late = (at >= 0) & (at + F.length(headword) > visible) & (clause != "")
    return F.when(late, F.concat(F.lit("…"), zh.substr(F.length(clause) + 1, F.length(zh)))).otherwise(zh)


def exact_match(rank: Column, relevance: Column, query_type: Column) -> Column:
    """Whether a result is what was looked up: the first, of full relevance, for a reading or a headword."""
    return (rank == 1) & (relevance == 100) & query_type.isin("pinyin", "chinese_exact")

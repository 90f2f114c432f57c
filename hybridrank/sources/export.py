"""Texts made from entries: embedding templates and flash cards; and their sinks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridrank.functions.text import html_escaped, single_spaced, tone_marked

#: The named templates of embedded texts; ``tags`` are joined by commas, ``words`` are the tags joined by spaces.
TEMPLATES = {
    "meaning-only": "{meaning}",
    "meaning-literal": "{meaning}. Literally: {literal}",
    "meaning-literal-tags": "{meaning}. Literally: {literal}. Topics: {tags}",
    "english-dense": "{meaning}. {literal}. Topics: {tags}",
    "rich": "Chinese idiom: {chengyu}. Pinyin: {pinyin}. Meaning: {meaning}. Literal: {literal}. Tags: {tags}",
    "tags-meaning": "{tags}. {meaning}",
    "example": "{meaning}. {example}",
    "meaning-boosted": "{meaning}. {meaning}. Literally: {literal}",
    "literal-first": "{literal}. Meaning: {meaning}",
    "literal-only": "{literal|meaning}",
    "query-style": "{meaning} {literal} {words}",
}
#: Labels of the fields that a reranker reads.
LABELS = {"meaning": "Meaning", "literal": "Literal", "example": "Example", "tags": "Topics"}


def _field(name: str) -> Column:
    if name in ("tags", "words"):
        each = F.transform(F.coalesce("tags", F.array().cast("array<string>")), single_spaced)
        return F.array_join(each, ", " if name == "tags" else " ")
    parts = [single_spaced(F.col(n)) for n in name.split("|")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in parts], F.lit(""))


def template(name: str) -> Column:
    """The text to embed for an entry; blank texts fall back to meaning, literal and headword.

    Whitespace in fields is single; empty fields leave their labels standing.
    """
    parts = [p for p in re.split(r"(\{[^}]*\})", TEMPLATES[name]) if p]
    text = F.trim(F.concat(*[_field(p[1:-1]) if p.startswith("{") else F.lit(p) for p in parts]))
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (text, _field("meaning"), _field("literal"), _field("chengyu"))], F.lit(""))


def reranker_text() -> Column:
    """The labelled fields of an entry that a reranker reads, as stored; empty ones are left out."""
    value = lambda f: F.array_join("tags", ", ") if f == "tags" else F.col(f)
    there = lambda f: F.size("tags") > 0 if f == "tags" else F.col(f) != ""
    return F.concat_ws(". ", *[F.when(there(f), F.concat(F.lit(label + ": "), value(f))) for f, label in LABELS.items()])


def bilingual_text(normalize: Callable[[Column], Column] = lambda c: c) -> Column:
    """The English fields of an entry, and in a second line its Chinese meaning, else its example up to a parenthesis, else its headword.

    ``normalize`` brings the Chinese part into one script.
    """
    blank = lambda c: F.nullif(c, F.lit(""))
    chinese = F.coalesce(blank(F.trim("meaning_zh")), blank(F.regexp_extract("example", "^([^(（]*)", 1)), F.col("chengyu"), F.lit(""))
    field = lambda n: F.coalesce(n, F.lit(""))
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", ")
    return F.concat("chengyu", F.lit(". Meaning: "), field("meaning"), F.lit(". Literal: "), field("literal"), F.lit(". Topics: "), tags, F.lit("\n释义："), normalize(chinese))


def flash_cards(entries: DataFrame) -> DataFrame:
    """``(pos, value)``: one line of ten tab-separated columns per entry, escaped for HTML."""
    clean = lambda c: F.regexp_replace(F.replace(html_escaped(F.coalesce(c, F.lit(""))), F.lit("\t"), F.lit(" ")), r"\r?\n+", "<br>")
    form = lambda n: F.coalesce(F.nullif(F.col(n), F.lit("")), F.col("chengyu"))
    marked = F.array_join(F.transform(F.split("pinyin", " "), tone_marked), " ")
    columns = [form("simplified"), form("simplified"), form("traditional"), F.col("pinyin"), marked, F.col("meaning"), F.col("literal"), F.col("example"), F.array_join("tags", ", "), F.col("formality")]
    return entries.select("pos", F.concat_ws("\t", *[clean(c) for c in columns]).alias("value"))


def write_flash_cards(entries: DataFrame, path: str) -> None:
    """Writes text files; each begins with the two header lines importers look for."""

    def headed(frames):
        import pandas as pd

        yield pd.DataFrame({"value": ["#separator:tab", "#html:true"]})
        for f in frames:
            yield f[["value"]]

    flash_cards(entries).select("value").mapInPandas(headed, "value string").write.mode("overwrite").text(path)

import pytest
from pyspark.sql import functions as F

from hybridrank.functions import query as Q
from hybridrank.functions import text as X
from hybridrank.sources.formats import deep_merge, load_config


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_tokens_stem_before_stopwords(spark):
    assert one(spark, X.content_tokens, "This is Feeling hopeless!") == ["thi", "feel", "hopeles"]
    assert one(spark, X.content_tokens, None) == []


def test_pinyin_and_tones(spark):
    assert one(spark, X.plain_pinyin, "Lǜ  zi3,hé") == "lu zi he"
    assert one(spark, X.tone_marked, "lu:e4") == "lüè"
    assert one(spark, X.tone_marked, "xiu1") == "xiū"
    assert one(spark, X.tone_marked, "gui4") == "guì" or one(spark, X.tone_marked, "gui4") == "guì"
    assert one(spark, X.tone_marked, ",") == ","


def test_notes_and_examples(spark):
    got = one(spark, X.idiom_notes, "one word says it all (idiom, from a classic); to be brief")
    assert (got["note"], got["meaning"]) == ("from a classic", "one word says it all; to be brief")
    assert one(spark, X.idiom_notes, "x (idiom)")["note"] == ""
    parts = one(spark, X.example_parts, "他说。（He speaks.）")
    assert (parts["zh"], parts["en"]) == ("他说。", "He speaks.")


def test_fnv(spark):
    assert one(spark, X.fnv1a, "abc") == 440920331


def test_cache_key(spark):
    keys = {one(spark, lambda c: X.cache_key(c, "m", "v1"), t) for t in ("feeling hopeless", " Feeling  hopeless. ", "FEELING HOPELESS?!", "ｆeeling hopeless")}
    assert keys == {"m::v1::feeling hopeless"}


def test_query_types(spark):
    syl = Q.listed(["ma", "ni", "hao"])
    got = {q: one(spark, lambda c: Q.query_type(c, syl), q) for q in ("", "山水", "nǐ hǎo", "dragon", "xyzzy", "the moon", "love and war", "add legs to a snake", "how do people feel about this")}
    assert got == {"": "english_meaning", "山水": "chinese_exact", "nǐ hǎo": "pinyin", "dragon": "partial", "xyzzy": "thematic", "the moon": "thematic", "love and war": "thematic", "add legs to a snake": "literal", "how do people feel about this": "english_meaning"}


def test_config():
    base = {"a": 1, "b": {"c": 2, "d": 3}}
    assert load_config(base, '{"b": {"c": 9}}', {"a": 0}) == {"a": 0, "b": {"c": 9, "d": 3}} and base["b"]["c"] == 2
    assert deep_merge({"a": {"x": 1}}, {"a": 5}) == {"a": 5}

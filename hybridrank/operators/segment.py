"""Segmenting Chinese text with a dictionary, and what is built on it."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The largest dictionary, in words, that tasks hold in memory; a larger one is refused, never cut.
MOST_WORDS = 2_000_000
_HAN = re.compile("[㐀-鿿]")


def reaches(words: Iterable[str]) -> dict[str, int]:
    """The length of the longest word by the two characters it begins with, so that one long word slows only texts with its beginning."""
    out: dict[str, int] = {}
    for w in words:
        out[w[:2]] = max(out.get(w[:2], 1), len(w))
    return out


def best_path(text: str, entries: dict[str, int], idioms: frozenset[str], longest: int, reach: dict[str, int] | None = None) -> list[tuple[str, str]]:
    """``(token, kind)`` of the best cut; kinds are word, uncovered and other.

    ``longest`` is the length of the longest word, ``reach`` what ``reaches`` says of the words.

    A word scores twice its length, 10 more if it is an idiom, 1 less if it is
    a single character, and less the more entries it has; an unknown Han
    character costs 2.  Of equal cuts the one with the longest last word stays.
    """
    n = len(text)
    score, back = [0.0] + [-math.inf] * n, [(0, "")] * (n + 1)
    many_of, reach_of = entries.get, None if reach is None else reach.get
    for j in range(n):
        own, far = score[j], longest if reach_of is None else reach_of(text[j : j + 2], 1)
        one = text[j]
        many = many_of(one)
        if many:
            s, kind = own + 2 + (10 if one in idioms else 0) - 1 - math.log2(many), "word"
        else:
            han = "㐀" <= one <= "鿿"
            s, kind = own - (2 if han else 0), "uncovered" if han else "other"
        if s > score[j + 1]:
            score[j + 1], back[j + 1] = s, (j, kind)
        for i in range(j + 2, min(n, j + far) + 1):
            word = text[j:i]
            many = many_of(word)
            if many:
                s = own + 2 * (i - j) + (10 if word in idioms else 0) - math.log2(many)
                if s > score[i]:
                    score[i], back[i] = s, (j, "word")
    out, i = [], n
    while i:
        j, kind = back[i]
        out.append((text[j:i], kind))
        i = j
    return out[::-1]


def word_parts(text: str, words: frozenset[str]) -> list[str]:
    """The words a headword is made of, never itself; characters where there is none."""
    n = len(text)
    if n <= 1:
        return [text] if text else []
    score, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for i in range(1, n + 1):
        for j in range(i):
            part = text[j:i]
            if part == text:
                continue
            han = bool(_HAN.match(part))
            gains = [10.0 * len(part)] if han and len(part) > 1 and part in words else []
            gains += [0.0 if han else 0.5] if i == j + 1 else []
            for g in gains:
                if score[j] + g > score[i]:
                    score[i], back[i] = score[j] + g, j
    out, i = [], n
    while i:
        out.append(text[back[i] : i])
        i = back[i]
    return out[::-1]


def _words(dictionary: DataFrame, word: str) -> dict[str, int]:
    """How many entries each word has; it comes to the driver in columns, as a row object a word would not fit there."""
    rows = dictionary.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("w")).count().limit(MOST_WORDS + 1).toArrow()
    if rows.num_rows > MOST_WORDS:
        raise ValueError(f"a dictionary of more than {MOST_WORDS} words does not fit into a task")
    return dict(zip(rows["w"].to_pylist(), rows["count"].to_pylist()))


#: Tokens that a task holds at once before it hands them on, whatever the texts of a batch come to.
BLOCK_TOKENS = 20_000


def _cut(frames: Iterator[pd.DataFrame], words: dict[str, int], idioms: frozenset[str]) -> Iterator[pd.DataFrame]:
    longest, reach = max(map(len, words), default=1), reaches(words)
    rows: list[tuple] = []
    made = lambda: pd.DataFrame(rows, columns=["key", "n", "token", "kind"])
    for f in frames:
        for k, body in zip(f["key"], f["text"]):
            for i, (t, kind) in enumerate(best_path(body, words, idioms, longest, reach) if body else (), 1):
                rows.append((k, i, t, kind))
                if len(rows) == BLOCK_TOKENS:
                    yield made()
                    rows.clear()
    yield made()


def segmented(texts: DataFrame, key: str, text: str, dictionary: DataFrame, word: str, idioms: DataFrame) -> DataFrame:
    """``(key, n, token, kind)``: the tokens of every text in order, from 1; null and empty texts have none."""
    spark = texts.sparkSession
    words, special = _words(dictionary, word), _words(idioms, "word")
    # An idiom is one string with its word, not a second copy in every task.
    held = spark.sparkContext.broadcast((words, [w for w in words if w in special]))
    key_type = dict(texts.dtypes)[key]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, special = held.value
        yield from _cut(frames, words, frozenset(special))

    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(cut, f"key {key_type}, n int, token string, kind string")


def headword_parts(headwords: DataFrame, column: str, dictionary: DataFrame, word: str) -> DataFrame:
    """``headwords`` with ``parts``: the dictionary words each is made of."""
    words = headwords.sparkSession.sparkContext.broadcast(frozenset(_words(dictionary, word)))

    @F.pandas_udf("array<string>")
    def parts(s: pd.Series) -> pd.Series:
        return s.map(lambda t: word_parts(t, words.value), na_action="ignore")

    return headwords.withColumn("parts", parts(F.col(column)))


def best_entries(dictionary: DataFrame) -> DataFrame:
    """The entry to show for every simplified form: ``entry_no`` by additive penalties, the first on a tie.

    ``dictionary`` holds ``entry_no, simplified, pinyin`` and ``definitions`` as an array.
    """
    # The patterns and what each takes off.
    text = F.array_join("definitions", " ")
    hit = lambda pattern, malus: F.when(text.rlike(pattern), F.lit(-malus)).otherwise(0.0)
    score = (
        hit("(?i)old variant|archaic|variant of|erudite", 10.0) + hit("(?i)surname |given name|place name", 8.0) + hit(r"(?i)abbr\.|abbreviation", 5.0) + hit("^used in ", 3.0)
        + F.when(text.contains("(idiom)"), 0.0).otherwise(1.0) + F.size("definitions") + F.when(F.col("pinyin").isNotNull() & ~F.col("pinyin").rlike("[,;]"), 0.5).otherwise(0.0) - F.length(text) * 0.005
    )
    rows = dictionary.withColumn("score", F.round(score, 9))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("simplified").orderBy(F.desc("score"), "entry_no"))).where("n = 1").select("simplified", "entry_no", "score")


def annotated(tokens: DataFrame, best: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``tokens`` with the dictionary entry of each word; ``overrides`` (``token, entry_no``) come first."""
    rows = tokens.join(best.select(F.col("simplified").alias("token"), "entry_no"), "token", "left")
    if overrides is not None:
        mine = overrides.select("token", F.col("entry_no").alias("__own"))
        rows = rows.join(mine, "token", "left").withColumn("entry_no", F.coalesce("__own", "entry_no")).drop("__own")
    return rows.withColumn("entry_no", F.when(F.col("kind") == "word", F.col("entry_no")))


def coverage(tokens: DataFrame, most: int = 80) -> DataFrame:
    """The most frequent Han characters that no word covers (a report of ``most`` rows)."""
    rows = tokens.where("kind = 'uncovered'").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("texts"))
    return rows.orderBy(F.desc("n"), "token").limit(most)


def traditional_forms(entries: DataFrame, dictionary: DataFrame, pinyin_key) -> DataFrame:
    """``(pos, traditional)``: an entry's own form, else the dictionary's for its reading, else for its headword.

    Of several dictionary entries the first counts.
    """
    d = dictionary.select("entry_no", "simplified", "traditional", pinyin_key(F.col("pinyin")).alias("key")).where("simplified is not null and traditional is not null")
    by_both = d.groupBy("simplified", "key").agg(F.min_by("traditional", "entry_no").alias("t1"))
    by_form = d.groupBy("simplified").agg(F.min_by("traditional", "entry_no").alias("t2"))
    e = entries.select("pos", F.col("chengyu").alias("simplified"), "traditional", pinyin_key(F.col("pinyin")).alias("key"))
    return e.join(by_both, ["simplified", "key"], "left").join(by_form, "simplified", "left").select("pos", F.coalesce(F.nullif("traditional", F.lit("")), "t1", "t2").alias("traditional"))


def character_map(dictionary: DataFrame) -> DataFrame:
    """``(traditional, simplified, votes)``: what each traditional character becomes, by majority of aligned pairs; ties go to the pair seen first."""
    pairs = dictionary.where("length(traditional) = length(simplified)").select("entry_no", F.posexplode(F.arrays_zip(F.split("traditional", "").alias("t"), F.split("simplified", "").alias("s"))).alias("i", "c"))
    votes = pairs.where("c.t <> ''").groupBy(F.col("c.t").alias("traditional"), F.col("c.s").alias("simplified")).agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("entry_no", "i")).alias("seen"))
    return votes.groupBy("traditional").agg(F.min_by(F.struct("simplified", "votes"), F.struct((-F.col("votes")).alias("v"), "seen")).alias("b")).select("traditional", "b.simplified", "b.votes")


class Converter:
    """Rewrites text into one script with dictionaries that are given.

    ``words`` are words to cut by, ``kept`` spellings that stay or have a
    conversion of their own, ``phrases`` longest-match rules, ``characters``
    the fallback.  The text is rewritten until nothing changes; rules that run
    in a circle raise an error.
    """

    def __init__(self, words: set[str], kept: dict[str, str], phrases: dict[str, str], characters: dict[str, str], rounds: int = 8):
        self.words, self.kept, self.phrases, self.characters, self.rounds = words, kept, phrases, characters, rounds
        self.longest = max(map(len, [*words, *kept, ""]), default=1)
        self.longest_phrase = max(map(len, phrases), default=0)

    def cut(self, text: str) -> list[str]:
        """The fewest pieces; of equal cuts, the one with the longer last piece."""
        n = len(text)
        best = [(0, 0)] + [(n + 1, 0)] * n
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                piece = text[j:i]
                if (i - j == 1 or piece in self.words or piece in self.kept) and best[j][0] + 1 < best[i][0]:
                    best[i] = (best[j][0] + 1, j)
        out, i = [], n
        while i:
            out.append(text[best[i][1] : i])
            i = best[i][1]
        return out[::-1]

    def once(self, text: str) -> str:
        out = []
        for piece in self.cut(text):
            if piece in self.kept:
                out.append(self.kept[piece])
                continue
            i = 0
            while i < len(piece):
                for n in range(min(self.longest_phrase, len(piece) - i), 0, -1):
                    if piece[i : i + n] in self.phrases:
                        out.append(self.phrases[piece[i : i + n]])
                        i += n
                        break
                else:
                    out.append(self.characters.get(piece[i], piece[i]))
                    i += 1
        return "".join(out)

    def __call__(self, text: str) -> str:
        seen = set()
        while text not in seen:
            seen.add(text)
            new = self.once(text)
            if new == text:
                return text
            if len(seen) > self.rounds:
                break
            text = new
        raise ValueError("the conversion rules run in a circle")


def converted(df: DataFrame, column: str, converter: Converter) -> DataFrame:
    """``df`` with ``column`` in one script; null stays null."""
    # Broadcasts hold plain data only; workers may have no copy of this package.
    held = df.sparkSession.sparkContext.broadcast((converter.words, converter.kept, converter.phrases, converter.characters, converter.rounds))

    @F.pandas_udf("string")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Converter(*held.value)
        for s in batches:
            yield s.map(own, na_action="ignore")

    return df.withColumn(column, convert(F.col(column)))


def headword_aliases(corpus: DataFrame) -> DataFrame:
    """``(alias, headword)``: forms that name exactly one headword."""
    forms = corpus.select(F.coalesce(F.nullif(F.trim("simplified"), F.lit("")), F.col("chengyu")).alias("headword"), F.explode(F.array_compact(F.array("chengyu", "simplified", "traditional"))).alias("alias"))
    return forms.where("alias <> ''").groupBy("alias").agg(F.min("headword").alias("headword"), F.max("headword").alias("other")).where("headword = other").select("alias", "headword")


def han_normalized(queries: DataFrame, aliases: DataFrame, converter: Converter) -> DataFrame:
    """``(query, normalized)`` of Han queries: the headword an alias names, else the converted text."""
    q = queries.select("query").distinct().where(F.col("query").rlike("[\\u4e00-\\u9fff]")).withColumn("normalized", F.trim("query"))
    q = q.join(aliases, F.col("normalized") == F.col("alias"), "left").drop("alias")
    return converted(q, "normalized", converter).select("query", F.coalesce("headword", "normalized").alias("normalized"))

"""One consistent form for text that looks the same but is typed differently.

Compatibility normalisation and the deletion of ignorable characters leave
tokens whose characters still have look-alikes.  Each token is a lattice: at
every place stand the character as typed and all that look like it, in both
directions.  The Viterbi path under character bigrams of the whole corpus,
which keep to one script, is the token's consistent form.  Two tokens that
look the same have the same lattice, or lattices that the context decides.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridrank.runtime import Scratch

#: Look-alikes of ASCII letters and digits in other scripts.
LATIN = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "lI", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "ѵ": "v", "ь": "b", "к": "k", "т": "t", "м": "m", "н": "h", "в": "b", "г": "r", "п": "n",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ғ": "F", "Н": "H", "І": "Il", "Ӏ": "Il", "Ј": "J", "К": "K", "М": "M", "О": "O0", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "З": "3", "Б": "6", "Ч": "4",
    "α": "a", "γ": "y", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "Il", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O0", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "ք": "f", "ա": "w", "լ": "l", "Օ": "O0", "Տ": "S", "Լ": "L", "Ս": "U",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ȷ": "j", "ɩ": "i", "ʋ": "v", "ɯ": "w", "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ɢ": "g", "ʜ": "h", "ɪ": "i", "ᴊ": "j", "ᴋ": "k", "ʟ": "l", "ᴍ": "m", "ɴ": "n", "ᴏ": "o", "ᴘ": "p", "ʀ": "r", "ꜱ": "s", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ʏ": "y", "ᴢ": "z",
    "ǀ": "lI", "∣": "lI", "〇": "O0", "○": "O0", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}

#: The unified characters that the radicals from U+2E80 on look like, in order; a space where there is none.
RADICALS = " 厂乛乚乙亻冂几刀刂卜㔾小小兀尣尢 巳幺彑彐忄㣺扌攵 旡日月歺母民氵氺灬爫爫丬牛犭王疋目示礻竹糹纟罓罒㓁㓁 羊羊 耂肀聿月臼艹艹艹虎衤覀西见角 讠贝足车辶辶辶阝钅長镸长门阜阝雨青韦页风飞食 飠饣首马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龟亀龟"

#: Kana and other signs that look like unified characters, with all they may stand for.
HAN_LIKE = {"ニ": "二", "ハ": "八", "ロ": "口囗", "ト": "卜", "エ": "工", "カ": "力", "タ": "夕", "ヒ": "匕", "ー": "一", "ミ": "三", "ノ": "丿", "ム": "厶", "オ": "才", "チ": "千", "セ": "七", "リ": "刂", "ㄧ": "一", "㇐": "一", "ㄚ": "丫", "ㄙ": "厶", "ㄩ": "凵", "ㄇ": "冂", "ㄏ": "厂", "〡": "丨", "〢": "刂", "〤": "乂", "ㅡ": "一", "ㅣ": "丨", "ㅁ": "口囗"}

#: Combining marks that look like the four tones and the dots of ü.
MARKS = {"̀": "̀", "́": "́", "̄": "̄", "̌": "̌", "̈": "̈", "̆": "̌", "̅": "̄", "̲": "", "̋": "̈", "҃": "̄", "̍": "́", "̊": "̌"}
TONES = "̀́̄̌"

#: Characters beside the format class that have no shape of their own.
BARE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2800, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

COMMAS = {",": ",", "，": ",", "、": ",", "‚": ",", "٫": ",", "،": ",", "︐": ",", "﹐": ",", "､": ",", "ꓹ": ","}
VOWELS = "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜüĀÁǍÀĒÉĚÈĪÍǏÌŌÓǑÒŪÚǓÙǕǗǙǛÜ"
ASCII = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Letters of consistent forms, beside unified Han characters.
ALPHABET = frozenset(ASCII + VOWELS + ",， ")
#: The loss, in nats, for every change of script within a token, and for every letter outside the alphabet.
SWITCH, FOREIGN = 2.0, 3.0
#: Counts are kept in so many rows of so many hashed places: the model's bound, whatever the corpus.  The least of
#: the rows is taken, so that what shares a place with a frequent pair in one row is not mistaken for it.
ROWS, PLACES = 3, 1 << 20
#: How much the count of a single character weighs in that of a pair.
BACK_OFF = 2.0
#: The end of a token; control characters are deleted from text, so none holds it.
END = "\0"

HAN_LIKE |= {chr(0x2E80 + i): han for i, han in enumerate(RADICALS) if han != " "}


def _unified(c: str) -> bool:
    return "一" <= c <= "鿿"


def _inside(letter: str) -> bool:
    return letter in ALPHABET or len(letter) == 1 and _unified(letter)


def _ordered(letters: set[str]) -> str:
    """The readings of a place in one order, so that it does not matter which of them was typed."""
    return "".join(sorted(letters, key=lambda c: (not _inside(c), not c.isalpha(), c)))


def _alike() -> dict[str, str]:
    """For every character with look-alikes, itself and all of them."""
    plain: dict[str, set[str]] = {}
    stands = {c: r for c, r in (LATIN | HAN_LIKE).items() if not 0x2E80 <= ord(c) < 0x2F00}
    for c, readings in stands.items():
        for r in readings:
            plain.setdefault(r, {r}).add(c)
    return {r: _ordered(cs) for r, cs in plain.items()} | {c: _ordered({c}.union(*[plain[r] for r in readings])) for c, readings in stands.items()}


ALIKE = _alike()


def ignorable(c: str) -> bool:
    """Whether a character has no shape: format and control characters, variation selectors, fillers."""
    if c in "\t\n\r\v\f\x1c\x1d\x1e\x1f\x85":
        return False
    return ord(c) in BARE or unicodedata.category(c) in ("Cf", "Cc")


def _settle(text: str) -> str:
    """Compatibility composition without ignorable characters; blanks are single spaces."""
    if text.isascii() and text.isprintable():
        return " ".join(text.split())
    if not all(c in ALPHABET or "一" <= c <= "鿿" for c in text):
        text = "".join(c for c in text if not ignorable(c))
        text = unicodedata.normalize("NFKC", "".join(HAN_LIKE.get(c, c) if 0x2E80 <= ord(c) < 0x2F00 else c for c in text))
        text = "".join(c for c in text if not ignorable(c))
    return " ".join(text.split())


@lru_cache(65_536)
def _headword_place(c: str) -> tuple[str, tuple[str, ...]]:
    if c in COMMAS:
        return "，", ("，",)
    if not (_unified(c) or c in ASCII or c in ALIKE):
        # A letter below marks that headwords do not carry; other characters stay.
        bare = unicodedata.normalize("NFD", c)
        c = bare[0] if bare[0] in ASCII and len(bare) > 1 else c
    return c, tuple(ALIKE.get(c, c))


@lru_cache(65_536)
def _pinyin_place(c: str, marks: str) -> tuple[str, tuple[str, ...]]:
    if c in COMMAS:
        return ",", (",",)
    # Dots first, then the tone, so that marks typed in either order agree.
    known = [MARKS[m] for m in marks if m in MARKS]
    dots, tone = "̈" if "̈" in known else "", "".join([m for m in known if m and m in TONES][:1])

    def made(r: str) -> str:
        return unicodedata.normalize("NFC", ("i" if r == "ı" and tone else r) + dots + tone)

    return made(c), tuple(dict.fromkeys(made(r) for r in ALIKE.get(c, c)))


def lattices(text: str, kind: str) -> Iterator[list[tuple[str, tuple[str, ...]]]]:
    """Of every token of a text, the letter typed at each place and all its readings.

    A headword is one token; blanks in it say nothing.  Pinyin has a token a syllable.
    """
    settled = _settle(text)
    if kind != "pinyin":
        yield [_headword_place(c) for c in settled if c != " "]
        return
    for token in settled.split(" "):
        places, parts, i = [], unicodedata.normalize("NFD", token), 0
        while i < len(parts):
            j = i + 1
            while j < len(parts) and unicodedata.combining(parts[j]):
                j += 1
            places.append(_pinyin_place(parts[i], parts[i + 1 : j]))
            i = j
        yield places


@lru_cache(65_536)
def _script(letter: str) -> str:
    """Script and case of a letter, digit for digits; others belong to no script."""
    c = letter[0]
    if _unified(c):
        return "han"
    if c.isdigit():
        return "digit"
    return unicodedata.name(c, "?").split()[0] + (" upper" if c.isupper() else "") if c.isalpha() else ""


def _places(a: str, b: str = "") -> list[int]:
    """Where the counts of ``b`` after ``a``, or of ``a`` alone, are kept: one place a row."""
    raw = f"{a}\1{b}".encode("utf-8", "replace")
    return [row * PLACES + zlib.crc32(raw, 0x9E37 * row) % PLACES for row in range(ROWS)]


def _telling(places: tuple[tuple[str, tuple[str, ...]], ...]) -> bool:
    """Whether a token tells how its letters are meant: all are inside the alphabet, or all
    of one script, which a letter without any look-alike inside the alphabet proves."""
    if all(_inside(letter) for letter, _ in places):
        return True
    scripts = {_script(letter).split(" ")[0] for letter, _ in places} - {""}
    return len(scripts) == 1 and any(not any(_inside(r) for r in readings) for _, readings in places)


def letter_pairs(tokens: Iterator[list[tuple[str, tuple[str, ...]]]]) -> Counter:
    """Counts of letters, and of neighbouring letters of which one has look-alikes; no others are ever asked for.

    Only tokens that keep to one script as typed are evidence, so that look-alikes typed among other letters are not learnt.
    """
    seen: Counter = Counter()
    for places in tokens:
        if not _telling(places):
            continue
        before, wide = END, False
        for letter, readings in [*places, (END, (END,))]:
            if wide or len(readings) > 1:
                seen[before, letter] += 1
                seen[letter, ""] += 1
            before, wide = letter, len(readings) > 1
    return seen


class Speller:
    """Finds the best path through lattices under hashed counts of letters."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.total = counts, float(counts[:PLACES].sum()) / 2 + 1.0
        self._steps: dict[tuple[str, str], float] = {}
        self._paths: dict[tuple, tuple[str, ...]] = {}
        self._texts: dict[tuple[str, str], str] = {}

    def count(self, a: str, b: str = "") -> float:
        return float(min(self.counts[i] for i in _places(a, b)))

    def step(self, a: str, b: str) -> float:
        """The score of letter ``b`` after ``a``: its share among pairs, backed by its share among letters, less the losses."""
        got = self._steps.get((a, b))
        if got is None:
            share = (self.count(b) + 0.01) / self.total
            got = math.log((self.count(a, b) + BACK_OFF * share) / (self.count(a) + BACK_OFF))
            sa, sb = _script(a), _script(b)
            got -= (SWITCH if sa and sb and sa != sb else 0.0) + (0.0 if b == END or _inside(b) else FOREIGN)
            self._steps[a, b] = got
        return got

    def path(self, before: str, places: tuple[tuple[str, ...], ...], after: str) -> tuple[str, ...]:
        """The Viterbi path through places that all have several readings; ties go to the reading listed first."""
        known = self._paths.get((before, places, after))
        if known is not None:
            return known
        scores, last, back = [0.0], (before,), []
        for readings in [*places, (after,)]:
            now, come = [], []
            for r in readings:
                each = [s + self.step(x, r) for s, x in zip(scores, last)]
                top = max(range(len(each)), key=each.__getitem__)
                now.append(each[top])
                come.append(top)
            scores, last = now, readings
            back.append(come)
        out, at = [], 0
        for i in range(len(places), 0, -1):
            at = back[i][at]
            out.append(places[i - 1][at])
        if len(self._paths) < 200_000:
            self._paths[before, places, after] = tuple(reversed(out))
        return tuple(reversed(out))

    def spelled(self, places: list[tuple[str, tuple[str, ...]]]) -> str:
        """The consistent form of a token; places with one reading part its lattice into independent stretches."""
        out: list[str] = []
        i, n = 0, len(places)
        while i < n:
            if len(places[i][1]) == 1:
                out.append(places[i][1][0])
                i += 1
                continue
            j = i
            while j < n and len(places[j][1]) > 1:
                j += 1
            out.extend(self.path(out[-1] if out else END, tuple(p[1] for p in places[i:j]), places[j][1][0] if j < n else END))
            i = j
        return "".join(out)

    def form(self, text: str, kind: str) -> str:
        got = self._texts.get((text, kind))
        if got is None:
            got = " ".join(x for x in (self.spelled(t) for t in lattices(text, kind)) if x)
            if len(self._texts) < 200_000 and len(text) < 200:
                self._texts[text, kind] = got
        return got


class _Count:
    def __init__(self, kinds: dict[str, str]):
        self.kinds = kinds

    def __call__(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for f in frames:
            for c, kind in self.kinds.items():
                texts = f[c].dropna().value_counts()
                tokens: Counter = Counter()
                for t, n in zip(texts.index, texts):
                    for token in lattices(t, kind):
                        tokens[tuple(token)] += n
                for token, n in tokens.items():
                    for pair, m in letter_pairs([token]).items():
                        seen[pair] += n * m
        sums: Counter = Counter()
        for pair, n in seen.items():
            for place in _places(*pair):
                sums[place] += n
        yield pd.DataFrame({"place": np.array(list(sums.keys()), np.int64), "n": np.array(list(sums.values()), np.int64)})


def letter_counts(df: DataFrame, kinds: dict[str, str]) -> np.ndarray:
    """Hashed counts of letters and their pairs over all of ``df``.

    ``kinds`` gives ``headword`` or ``pinyin`` for each column.  Every partition
    sums its own counts first; at most ``ROWS * PLACES`` sums exist.
    """
    texts = df.select([F.col(f"`{c}`").alias(c) for c in kinds])
    rows = texts.mapInPandas(_Count(kinds), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(ROWS * PLACES, np.float32)
    counts[rows["place"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return counts


def unify(df: DataFrame, kinds: dict[str, str], suffix: str = "_form") -> DataFrame:
    """``df`` with the consistent form of each column of ``kinds`` beside it.

    Nulls stay null and empty texts empty; a text of ignorable characters and
    blanks only becomes empty.  Different unified characters, letters of
    different case and different tones stay different.  Which of several
    look-alikes is meant follows the letters around it and the bigrams of all
    rows; equal look gives equal forms.  Whole texts are read, and every
    different text, token and stretch of a lattice is worked out once a task.
    Columns named like a form are replaced.
    """
    held = df.sparkSession.sparkContext.broadcast(letter_counts(df, kinds))
    forms = [_forming(held, kind)(F.col(f"`{c}`")).alias(c + suffix) for c, kind in kinds.items()]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in {k + suffix for k in kinds}], *forms)


def _forming(held, kind: str) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        speller = Speller(held.value)
        for texts in batches:
            yield texts.map(lambda t: speller.form(t, kind), na_action="ignore")

    return forms


#: Rows of one form that one task pairs with the others of the form.
PART = 5_000


def lookalike_members(df: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """``(key, form, stored, head)`` of rows whose form is typed in more than one way.

    ``form`` and ``stored`` are hashes of all consistent forms and of the texts
    as stored, ``head`` is the least key of the form: membership and one
    representative, without any pair.  Null agrees with null only; rows of a
    null key take no part; repeated rows count once.
    """
    scratch = Scratch(df.sparkSession, "lookalike")
    formed = unify(df.select(F.col(f"`{key}`").alias("__key"), *[F.col(f"`{c}`").alias(c) for c in kinds]).where("__key is not null"), kinds)
    forms = F.to_json(F.struct(*[F.col(c + "_form").alias(c) for c in kinds]))
    stored = F.to_json(F.struct(*[F.col(c) for c in kinds]))
    rows = scratch.keep(formed.select(F.col("__key").alias("key"), F.md5(forms).alias("form"), F.md5(stored).alias("stored")).distinct(), "forms")
    mixed = rows.groupBy("form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi"), F.min("key").alias("head")).where("lo <> hi").select("form", "head")
    return scratch.keep(rows.join(mixed, "form").select("key", "form", "stored", "head"), "members")


def lookalike_pairs(df: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """``(a, b)`` of rows that agree in all consistent forms but not as stored.

    ``a < b``.  Rows of the same key, and rows that are alike as stored, are no
    pair.  Only ``lookalike_members`` meet, by their form; the rows of a form
    are cut into parts of about ``PART`` rows, and every row meets each part in
    a task of its own, so that no form is paired in one task.
    """
    rows = lookalike_members(df, key, kinds).select("key", "form", "stored")
    sizes = rows.groupBy("form").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    rows = rows.join(sizes, "form")
    a = rows.select(F.col("key").alias("a"), "form", F.col("stored").alias("sa"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    b = rows.select(F.col("key").alias("b"), "form", F.col("stored").alias("sb"), F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    return a.join(b, ["form", "part"]).where("a < b and sa <> sb").select("a", "b").distinct()

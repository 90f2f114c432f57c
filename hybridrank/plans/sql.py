"""Pieces of SQL that the counterparts of several queries share."""

from __future__ import annotations

from hybridrank.functions.query import ABSTRACT, CONCRETE, PARTIAL, ROUTE_STOPWORDS, THEMES
from hybridrank.functions.text import COMPACT_MARKS, PLAIN_VOWELS, STOPWORDS


def strings(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def words(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


STEM = (
    "CASE WHEN length(w) <= 3 THEN w WHEN w LIKE '%ing' AND length(w) > 5 THEN left(w, length(w) - 3) WHEN w LIKE '%ed' AND length(w) > 4 THEN left(w, length(w) - 2)"
    " WHEN w LIKE '%es' AND length(w) > 4 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END"
)


def tokens(x: str) -> str:
    return f"list_filter(list_transform({words(x)}, lambda w: {STEM}), lambda t: length(t) > 1 AND NOT list_contains({strings(STOPWORDS)}, t))"


def grams(x: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({x}) - {n} + 2, 1)), lambda i: array_to_string({x}[i:i + {n - 1}], ' '))"


def plain_pinyin(x: str) -> str:
    accents = "".join(PLAIN_VOWELS.values())
    letters = "".join(k * len(v) for k, v in PLAIN_VOWELS.items())
    return f"trim(regexp_replace(regexp_replace(translate(lower(coalesce({x}, '')), '{accents}', '{letters}'), '[\\x{{0300}}-\\x{{036f}}0-9]', '', 'g'), '[^a-z]+', ' ', 'g'))"


def has_han(x: str) -> str:
    return f"regexp_matches({x}, '[\\x{{4e00}}-\\x{{9fff}}]')"


#: The corpus, one row per position.
CORPUS = "corpus AS (SELECT * FROM chengyu_entry QUALIFY row_number() OVER (PARTITION BY pos ORDER BY id) = 1)"
#: The different queries of the log.
ASKED = "asked AS (SELECT DISTINCT query_text AS query FROM request_log WHERE query_text IS NOT NULL)"
#: Every request once, as it was first received.
REQUESTS = "requests AS (SELECT * FROM request_log QUALIFY row_number() OVER (PARTITION BY request_no ORDER BY received_at) = 1)"


def query_type(q: str) -> str:
    """The type of a query; needs the common table ``syl`` with the list ``known``."""
    t, c = words(q), f"list_filter({words(q)}, lambda w: NOT list_contains({strings(STOPWORDS)}, w))"
    p = f"string_split({plain_pinyin(q)}, ' ')"

    def any_of(xs: str, values: list[str]) -> str:
        return f"len(list_filter({xs}, lambda w: list_contains({strings(values)}, w))) > 0"

    at = f"list_position({t}, 'and')"
    return f"""CASE WHEN trim({q}) = '' THEN 'english_meaning' WHEN {has_han(q)} THEN 'chinese_exact'
 WHEN len({p}) BETWEEN 2 AND 8 AND len(list_filter({p}, lambda w: NOT list_contains(known, w) OR list_contains({strings(STOPWORDS)}, w))) = 0 THEN 'pinyin'
 WHEN len({t}) = 0 THEN 'english_meaning' WHEN len({t}) = 1 AND {any_of(t, PARTIAL)} THEN 'partial'
 WHEN len({t}) BETWEEN 4 AND 8 AND len({c}) >= 3 AND {any_of(c, CONCRETE)} THEN 'literal'
 WHEN len({t}) = 1 OR (len({t}) <= 3 AND ({any_of(c, THEMES)} OR (len({c}) > 0 AND NOT len(list_filter({c}, lambda w: NOT list_contains({strings(ABSTRACT)}, w))) > 0) OR {t}[1] = 'the'))
   OR ({at} > 1 AND {at} < len({t}) AND list_contains({strings(ABSTRACT)}, {t}[{at} - 1]) AND list_contains({strings(ABSTRACT)}, {t}[{at} + 1])) THEN 'thematic'
 ELSE 'english_meaning' END"""


def route_content(x: str) -> str:
    return f"list_filter({x}, lambda w: NOT list_contains({strings(ROUTE_STOPWORDS)}, w))"


_SPACE = "[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def spaced(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_SPACE}', ' ', 'g'), ' ')"


def utf16(x: str) -> str:
    """The UTF-16 units of a text as a list."""
    return f"flatten(list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: CASE WHEN unicode(c) < 65536 THEN [unicode(c)::BIGINT] ELSE [55296 + ((unicode(c)::BIGINT - 65536) // 1024), 56320 + (unicode(c)::BIGINT - 65536) % 1024] END))"


def fnv(x: str) -> str:
    return f"list_reduce({utf16(x)}, lambda h, c: (xor(h, c) * 16777619) % 4294967296, 2166136261::BIGINT)"


def html(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"


def half(x: str) -> str:
    plain = "".join(map(chr, [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]))
    return f"trim(translate({x}, '{''.join(chr(ord(c) + 0xFEE0) for c in plain)}', '{plain}'), ' ')"


def compact(x: str) -> str:
    marks = COMPACT_MARKS.replace("'", "''")
    text = f"coalesce({x}, '')"
    return f"lower(regexp_replace({half(text)}, '{marks}', '', 'g'))"


def tone_marked(s: str) -> str:
    """A numbered syllable with its tone as a combining mark."""
    base = f"translate(replace(lower(regexp_replace({s}, '[1-5]$', '')), 'u:', 'ü'), 'v', 'ü')"
    has = lambda x, more=0: f"WHEN contains({base}, '{x}') THEN instr({base}, '{x}') + {more}"
    at = f"CASE {has('a')} {has('o')} {has('e')} {has('iu', 1)} {has('ui', 1)} {has('i')} {has('u')} ELSE instr({base}, 'ü') END"
    mark = f"CASE right({s}, 1) WHEN '1' THEN chr(772) WHEN '2' THEN chr(769) WHEN '3' THEN chr(780) WHEN '4' THEN chr(768) ELSE '' END"
    return f"CASE WHEN NOT regexp_matches({s}, '^[A-Za-züv:]+[1-5]$') THEN {s} WHEN {at} = 0 THEN {base} ELSE left({base}, {at}) || {mark} || substr({base}, {at} + 1) END"

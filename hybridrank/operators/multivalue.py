"""Several values packed into one field, split into one row per value.

The text is split on straight quotes: odd pieces are literals, even pieces are
cut into delimiters, brackets and plain text.  Array folds then carry the open
brackets along and turn every delimiter that stands free into a separator.
Everything is Spark SQL over arrays, inside one scan and without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Noncharacters, which no text holds: separator, backslash, escaped quote, doubled quote.
SEP, BACK, QUOTE, TWICE = "﷐", "﷑", "﷒", "﷓"

#: Brackets and curly quotes by opening and closing character.
OPEN = "([{（［｛〔【「『《〈“‘"
CLOSE = ")]}）］｝〕】」』》〉”’"

#: What an even piece is cut into, first match first.
ESCAPED = r"\\."
BREAK = r"(?i:<br\s*/?>)"
BULLET = r"(?<=\n)[ \t]*[-*–—]\s"
NUMBER = r"(?<![^\s;；/|¦、\x{FDD0}])[(（]?\d{1,3}[)）.．](?=\D)"
CIRCLED = r"[①-⒛⓵-⓾❶-➓]"
MARK = r"[/;；|¦、\n\r\t•●▪◦‣∙]"
APOSTROPHE = r"(?<=\p{L})’(?=\p{L})"
PLAIN = r"[^\\<\n\-*–—(（\d①-⒛⓵-⓾❶-➓/;；|¦、\r\t•●▪◦‣∙\[\]{}）)［］｛｝〔〕【】「」『』《》〈〉“”‘’]+"
#: What a cell must hold to be more than one bare value; without any of it, the folds would only carry the text through.
SIGNS = r"[\"\\<“”/;；|¦、\n\r\t•●▪◦‣∙①-⒛⓵-⓾❶-➓\x{FDD0}-\x{FDD3}]|\A\s*[-*–—]|\d[)）.．]"
TOKEN = "|".join(f"(?:{x})" for x in (ESCAPED, BREAK, BULLET, NUMBER, CIRCLED, MARK, APOSTROPHE, PLAIN, r"(?s:.)"))


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fold(tokens: str, state: str, step: str, emit: str, kind: str) -> str:
    """SQL that walks ``tokens`` with a state and gives one value a token.

    ``step`` and ``emit`` speak of the state ``s`` and the token ``x``.  The
    walk has two levels, over chunks and within them: appending to one array
    token by token would take time in the square of their number.
    """
    none = f"cast(array() as array<{kind}>)"
    size = f"greatest(32, cast(sqrt(size({tokens})) as int))"
    chunks = f"transform(sequence(0, greatest(size({tokens}) - 1, 0), {size}), i -> slice({tokens}, i + 1, {size}))"
    inner = f"aggregate(c, named_struct('s', A.s, 'o', {none}), (a, x) -> named_struct('s', {step.replace('$s', 'a.s')}, 'o', concat(a.o, array({emit.replace('$s', 'a.s')}))), r -> named_struct('s', r.s, 'o', concat(A.o, array(r.o))))"
    return f"flatten(aggregate({chunks}, named_struct('s', {state}, 'o', cast(array() as array<array<{kind}>>)), (A, c) -> {inner}, R -> R.o))"


def _tokens(text: str) -> str:
    """SQL: structs of kind and text.  Kinds: t(ext), d(elimiter), n(umber), o(pen), c(lose)."""
    pieces = f"split({text}, '\"', -1)"
    literal = "array(named_struct('k', 'l', 't', concat('\"', p, '\"')))"
    cut = f"regexp_extract_all(p, {_sql(f'({TOKEN})')}, 1)"
    named = f"transform({cut}, t -> named_struct('k', {_kind()}, 't', t))"
    # The last piece of an odd number of quotes has no closing quote: it is no literal.
    open_end = f"(i = size({pieces}) - 1)"
    loose = "named_struct('k', 't', 't', '\"')"
    doubled = f"named_struct('k', 'l', 't', '{TWICE}')"
    return (
        f"flatten(transform({pieces}, (p, i) -> case"
        f" when i % 2 = 1 and not {open_end} then {literal}"
        f" when i % 2 = 1 then concat(array({loose}), {named})"
        f" when p = '' and i > 0 and not {open_end} then array({doubled})"
        f" else {named} end))"
    )


def _kind() -> str:
    full = lambda x: _sql(rf"\A(?:{x})\z")
    return (
        f"case when length(t) > 1 and t rlike {full(ESCAPED)} then 't'"
        f" when t rlike {full(BREAK + "|" + MARK + "|" + CIRCLED + r"|[ \t]*[-*–—]\s")} then 'd'"
        f" when t rlike {full(r'[(（]?\d{1,3}[)）.．]')} then 'n'"
        f" when length(t) = 1 and instr({_sql(OPEN)}, t) > 0 then 'o'"
        f" when length(t) = 1 and instr({_sql(CLOSE)}, t) > 0 then 'c' else 't' end"
    )


def split_values(column: str) -> Column:
    """The values packed into the string ``column``, in order, as an array.

    Marks that part values: ``/ ; ； | ¦ 、``, line ends, tabs, ``<br>``, and
    bullets.  ``-`` and ``*`` are bullets only at the start of a line; list
    numbers part values only where they count up from 1 at the start of the
    cell.  A comma parts values only between two values that stand wholly in
    straight quotes.  Nothing parts values within straight or curly quotes or
    closed brackets, or after a backslash; a quote or bracket that is never
    closed protects nothing.  Values lose surrounding space, enclosing quotes,
    and the backslash of an escape; a doubled quote within quotes becomes one.
    Blank values do not count.  Null gives null, an empty text no values.
    """
    raw = f"`{column}`"
    clean = f"translate({raw}, '{SEP}{BACK}{QUOTE}{TWICE}', '')"
    coded = f"replace(replace(concat('\\n', {clean}), {_sql(chr(92) * 2)}, '{BACK}'), {_sql(chr(92) + chr(34))}, '{QUOTE}')"
    opener = f"translate(x.t, {_sql(CLOSE)}, {_sql(OPEN)})"
    # Backwards: an opening bracket counts if a closing one of its kind waits for it.
    pop = "substr($s, 1, length($s) - instr(reverse($s), x.t))"
    back_step = f"case when x.k = 'c' then concat($s, {opener}) when x.k = 'o' and instr($s, x.t) > 0 then {pop} else $s end"
    back_emit = "named_struct('k', case when x.k = 'o' and instr($s, x.t) = 0 then 't' else x.k end, 't', x.t)"
    back = _fold("reverse(tokens)", "''", back_step, back_emit, "struct<k:string,t:string>")
    # Forwards: the open brackets, the list number that would come next, and whether the cell has begun.
    digits = "cast(regexp_extract(x.t, '[0-9]+', 0) as int)"
    counts = f"(x.k = 'n' and $s.b = '' and {digits} = $s.n and ($s.n > 1 or not $s.g))"
    brackets = f"case when x.k = 'o' then concat($s.b, x.t) when x.k = 'c' and instr($s.b, {opener}) > 0 then substr($s.b, 1, length($s.b) - instr(reverse($s.b), {opener})) else $s.b end"
    fore_step = f"named_struct('b', {brackets}, 'n', $s.n + if({counts}, 1, 0), 'g', $s.g or x.t rlike '[^ \\\\s]')"
    fore_emit = f"case when {counts} or x.k = 'd' and $s.b = '' then '{SEP}' else x.t end"
    fore = _fold("marked", "named_struct('b', '', 'n', 1, 'g', false)", fore_step, fore_emit, "string")
    # A value of nothing but quoted texts and commas between them is parted at the commas.
    pieces = "split(v, '\"', -1)"
    listed = f"(size({pieces}) > 3 and size({pieces}) % 2 = 1 and forall(transform({pieces}, (p, i) -> i % 2 = 1 or if(i = 0 or i = size({pieces}) - 1, trim(p) = '', trim(p) = ',')), ok -> ok))"
    commas = f"flatten(transform(bare, v -> if({listed}, filter(transform({pieces}, (p, i) -> if(i % 2 = 1, concat('\"', p, '\"'), '')), p -> p <> ''), array(v))))"
    space = r"^[\s　 ]+|[\s　 ]+$"
    tidy = f"regexp_replace(replace(v, '\"{TWICE}\"', '{TWICE}'), {_sql(space)}, '')"
    unquoted = f"regexp_replace(regexp_replace({tidy}, {_sql(r'(?s)^\"([^\"]*)\"$')}, '$1'), {_sql(r'(?s)^“([^“”]*)”$')}, '$1')"
    plain = f"regexp_replace(replace(replace(regexp_replace({unquoted}, {_sql(space)}, ''), '{QUOTE}', '\"'), '{TWICE}', '\"'), {_sql(r'(?s)' + chr(92) * 2 + '(.)')}, '$1')"
    values = f"filter(transform({commas}, v -> replace({plain}, '{BACK}', {_sql(chr(92))})), v -> v <> '')"

    def let(name: str, value: str, body: str) -> str:
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    parted = f"split(array_join({fore}, ''), '{SEP}', -1)"
    whole = let("tokens", _tokens(coded), let("marked", f"reverse({back})", let("bare", parted, values)))
    bare_value = f"regexp_replace({raw}, {_sql(space)}, '')"
    return F.expr(f"case when {raw} rlike {_sql(SIGNS)} then {whole} when {raw} is not null then filter(array({bare_value}), v -> v <> '') end")


def explode_values(df: DataFrame, column: str, value: str = "value", position: str = "value_pos") -> DataFrame:
    """``df`` with one row per value packed into ``column``.

    ``value`` and ``position`` (from 1) replace columns of these names.  Rows
    whose field is null, empty or holds only blanks and marks give no row.
    """
    keep = [c for c in df.columns if c not in (value, position)]
    pairs = F.transform(split_values(column), lambda v, i: F.struct((i + 1).cast("int").alias("p"), v.alias("v")))
    # The outer form keeps the optimizer from a filter on the number of values, which would split every cell twice.
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.explode_outer(pairs).alias("__one")).where("__one is not null")
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.col("__one.p").alias(position), F.col("__one.v").alias(value))

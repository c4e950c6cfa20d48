"""Text, number and time functions beyond Spark's own, as JVM-side expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import pg


# text
def format_text(pattern: str, *args: Column) -> Column:
    """``format(pattern, ...)``: %s (NULL is empty), %I, %L, %%, positions ``%2$s`` and widths ``%-8s``."""
    parts, nth, at = [], 0, 0
    for m in re.finditer(r"%(?:(%)|(?:(\d+)\$)?(-)?(\d+)?([sIL]))", pattern):
        parts.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        if m[1]:
            parts.append(F.lit("%"))
            continue
        nth = int(m[2]) if m[2] else nth + 1
        if nth > len(args):
            raise ValueError("too few arguments for format")
        x = args[nth - 1].cast("string")
        if m[5] == "I":
            made = F.when(x.isNull(), F.raise_error(F.lit("null values cannot be formatted as an SQL identifier")).cast("string")).otherwise(pg.quote_ident(x))
        else:
            made = pg.quote_nullable(x) if m[5] == "L" else F.coalesce(x, F.lit(""))
        if m[4]:
            padded = F.rpad(made, int(m[4]), " ") if m[3] else F.lpad(made, int(m[4]), " ")
            made = F.when(F.char_length(made) >= int(m[4]), made).otherwise(padded)
        parts.append(made)
    rest = pattern[at:]
    if "%" in rest or any("%" in p for p in re.split(r"%(?:%|(?:\d+\$)?-?\d*[sIL])", pattern)):
        raise ValueError("unrecognized format specifier")
    return F.concat(*parts, F.lit(rest))


def like(x: Column, pattern: str, escape: str = "\\", blind: bool = False) -> Column:
    """``x LIKE pattern ESCAPE escape``; an empty escape makes every character plain."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape:
            i += 1
            if i == len(pattern):
                raise ValueError("a pattern must not end with the escape character")
            out.append(re.escape(pattern[i]))
        else:
            out.append({"%": "[\\s\\S]*", "_": "[\\s\\S]"}.get(c) or re.escape(c))
        i += 1
    return x.rlike(("(?i)" if blind else "") + "^" + "".join(out) + "\\z")


def regexp_match(x: Column, pattern: str, flags: str = "") -> Column:
    """First match: its groups, or the whole match without groups; NULL where nothing matches."""
    pattern = ("(?i)" if "i" in flags else "") + pattern
    groups = re.compile(pattern).groups
    took = [F.regexp_extract(x, pattern, i) for i in (range(1, groups + 1) if groups else [0])]
    return F.when(x.rlike(pattern), F.array(*took))


def regexp_matches(x: Column, pattern: str) -> Column:
    """All matches of a pattern without groups, or of its one group; explode it for rows."""
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(1 if re.compile(pattern).groups else 0))


def regexp_split(x: Column, pattern: str) -> Column:
    return F.split(x, pattern, -1)


def regexp_instr(x: Column, pattern: str) -> Column:
    """Place of the first match from 1; 0 without one."""
    return F.regexp_instr(x, F.lit(pattern))


def string_to_array_null(x: Column, sep: str, null: str) -> Column:
    """``string_to_array(x, sep, null)``: elements equal to ``null`` become NULL."""
    return F.transform(pg.string_to_array(x, sep), lambda e: F.nullif(e, F.lit(null)))


def concat_ws(sep: Column, *xs: Column) -> Column:
    """NULL arguments are left out; a NULL separator gives NULL."""
    kept = F.filter(F.array(*[x.cast("string") for x in xs]), lambda e: e.isNotNull())
    joined = F.aggregate(kept, F.lit(None).cast("string"), lambda a, e: F.when(a.isNull(), e).otherwise(F.concat(a, sep, e)))
    return F.when(sep.isNotNull(), F.coalesce(joined, F.lit("")))


def initcap(x: Column) -> Column:
    """Words are runs of letters and digits, whatever stands between them."""
    pieces = F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")


def to_number(x: Column, fmt: str) -> Column:
    """``to_number`` by digits: 9 and 0 are digits, D or . the point, G or , separators, S, MI, PR a sign, L and $ a currency mark."""
    scale = len(re.sub(r"[^90]", "", re.split(r"[D.]", fmt)[1])) if re.search(r"[D.]", fmt) else 0
    bare = F.regexp_replace(x, r"[,\s$€<>]", "")
    sign = F.when(x.rlike(r"-|<"), F.lit(-1)).otherwise(F.lit(1))
    return (F.regexp_replace(bare, r"[+-]", "").cast(f"decimal(30,{scale})") * sign).cast(f"decimal(30,{scale})")


# numbers
def log10(x: Column) -> Column:
    return F.log10(x)


def log_base(b: Column, x: Column) -> Column:
    """``log(b, x)``."""
    return F.ln(x) / F.ln(b)


def width_bucket(x: Column, low: float, high: float, n: int) -> Column:
    """0 below ``low``, n + 1 from ``high`` on; bounds may descend."""
    return F.width_bucket(x.cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(n)).cast("int")


def scale_of(x: Column) -> Column:
    """Digits after the point of a decimal's text."""
    return F.char_length(F.regexp_extract(x.cast("string"), r"\.(\d+)$", 1))


def min_scale(x: Column) -> Column:
    return F.char_length(F.regexp_extract(x.cast("string"), r"\.(\d*?)0*$", 1))


def trim_scale(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def bit_ops(a: Column, b: Column) -> dict[str, Column]:
    """& | # ~ of integers."""
    return {"and": a.bitwiseAND(b), "or": a.bitwiseOR(b), "xor": a.bitwiseXOR(b), "not": F.bitwise_not(a)}


def shift(a: Column, n: int) -> Column:
    """``a << n``; a negative ``n`` shifts right."""
    return F.shiftleft(a, n) if n >= 0 else F.shiftright(a, -n)


# time
def make_date(y: Column, m: Column, d: Column) -> Column:
    return F.make_date(y, m, d)


def make_timestamp(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """Without a zone; fields out of range raise."""
    return F.make_timestamp_ntz(y, mo, d, h, mi, s)


_TEMPLATE = [("YYYY", "yyyy"), ("Month", "MMMM"), ("Mon", "MMM"), ("MM", "MM"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("AM", "a"), ("PM", "a")]


def _java(fmt: str) -> str:
    out, i = "", 0
    while i < len(fmt):
        for a, b in sorted(_TEMPLATE, key=lambda p: -len(p[0])):
            if fmt.startswith(a, i):
                out, i = out + b, i + len(a)
                break
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return out


def to_timestamp(x: Column, fmt: str) -> Column:
    """By template; text that does not fit raises."""
    return F.to_timestamp_ntz(x, F.lit(_java(fmt)))


def to_date(x: Column, fmt: str) -> Column:
    return F.to_timestamp_ntz(x, F.lit(_java(fmt))).cast("date")


def age(later: Column, earlier: Column) -> Column:
    """Years, months, days and the rest of a day in seconds between two timestamps, each towards zero."""
    back = later < earlier
    a, b = F.when(back, later).otherwise(earlier), F.when(back, earlier).otherwise(later)
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    moved = lambda k: F.timestamp_add("MONTH", k, a)
    whole = F.when(moved(months) > b, months - 1).otherwise(months)
    rest = F.unix_micros(b.cast("timestamp")) - F.unix_micros(moved(whole).cast("timestamp"))
    sign = F.when(back, F.lit(-1)).otherwise(F.lit(1))
    days = F.floor(rest / 86_400_000_000)
    trunc = lambda x, n: F.floor(x / n)
    return F.struct((sign * trunc(whole, 12)).cast("int").alias("years"), (sign * (whole % 12)).cast("int").alias("months"), (sign * days).cast("int").alias("days"), (sign * (rest - days * 86_400_000_000) / 1e6).alias("seconds"))


def series(low: Column, high: Column, step: str) -> Column:
    """``generate_series`` over timestamps or dates, ``step`` an interval such as ``1 day``."""
    return F.sequence(low, high, F.expr(f"INTERVAL {step}"))


# arrays
def positions(a: Column, x: Column) -> Column:
    """``array_positions``: every place from 1."""
    return F.filter(F.transform(a, lambda e, i: F.when(e.eqNullSafe(x), i + 1)), lambda p: p.isNotNull())


def fill(x: Column, n: int) -> Column:
    return F.array_repeat(x, n)


def assign(a: Column, i: int, x: Column) -> Column:
    """``a[i] = x``: places beyond the end are filled with NULL."""
    whole = F.concat(a, F.array_repeat(F.lit(None), F.greatest(F.lit(0), F.lit(i) - F.size(a))))
    return F.transform(whole, lambda e, k: F.when(k == i - 1, x).otherwise(e))


def subscripts(a: Column) -> Column:
    """``generate_subscripts(a, 1)``."""
    return pg.generate_series(F.lit(1), F.size(a))


def dims(a: Column, depth: int = 1) -> Column:
    """``[1:n][1:m]``; NULL for an empty array."""
    parts, x = [], a
    for _ in range(depth):
        parts.append(F.concat(F.lit("[1:"), F.size(x).cast("string"), F.lit("]")))
        x = F.get(x, F.lit(0)) if depth > 1 else x
    return F.when(F.size(a) > 0, F.concat(*parts))


# XML
def xml_escape(x: Column, attribute: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if attribute else out


def xml_element(name: str, attributes: dict[str, Column] | None = None, *content: Column) -> Column:
    """``xmlelement(NAME name, xmlattributes(...), content...)``; text is escaped, NULL attributes are left out."""
    attrs = [F.coalesce(F.concat(F.lit(f' {k}="'), xml_escape(v.cast("string"), True), F.lit('"')), F.lit("")) for k, v in (attributes or {}).items()]
    if not content:
        return F.concat(F.lit(f"<{name}"), *attrs, F.lit("/>"))
    return F.concat(F.lit(f"<{name}"), *attrs, F.lit(">"), *[F.coalesce(c, F.lit("")) for c in content], F.lit(f"</{name}>"))


def xml_forest(**columns: Column) -> Column:
    """One element for each column that is not NULL."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"<{k}>"), xml_escape(v.cast("string")), F.lit(f"</{k}>")), F.lit("")) for k, v in columns.items()])


def xml_agg(x: Column, *order: Column) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], x.alias("x"))))
    return F.array_join(F.transform(rows, lambda r: r["x"]), "")


# full text
class _Query:
    def __init__(self, text: str):
        self.tokens = re.findall(r"<->|<\d+>|[&|!()]|'[^']*'|[\w]+(?::\*)?", text.lower())
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self):
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self, lowered):
        out = self.both(lowered)
        while self.peek() == "|":
            self.take()
            out = out | self.both(lowered)
        return out

    def both(self, lowered):
        out = self.phrase(lowered)
        while self.peek() == "&":
            self.take()
            out = out & self.phrase(lowered)
        return out

    def phrase(self, lowered):
        if self.peek() == "!":
            self.take()
            return ~self.phrase(lowered)
        if self.peek() == "(":
            self.take()
            out = self.either(lowered)
            if self.peek() != ")":
                raise ValueError("query syntax: ) expected")
            self.take()
            return out
        run = [(0, self.word())]
        while (op := self.peek()) and (op == "<->" or re.fullmatch(r"<\d+>", op)):
            self.take()
            run.append((run[-1][0] + (1 if op == "<->" else int(op[1:-1])), self.word()))
        return _phrase_found(lowered, run)

    def word(self):
        w = self.take() if self.peek() else None
        if w is None or not re.fullmatch(r"'[^']*'|\w+(?::\*)?", w):
            raise ValueError(f"query syntax at {w!r}")
        return w.strip("'")


_IN, _OUT = "[\\p{L}\\p{N}]", "[^\\p{L}\\p{N}]"  # of words, between words


def _phrase_found(lowered: Column, run: list[tuple[int, str]]) -> Column:
    """Whether each word of ``run`` stands at its step from one place of the text: one search by a pattern, which
    reads the text once and repeats nothing (its quantifiers are possessive)."""
    steps: dict[int, list[tuple[str, str]]] = {}
    for step, w in run:
        stem, end = (w[:-2], "") if w.endswith(":*") else (w, f"(?!{_IN})")
        if not stem or any(unicodedata.category(c)[0] not in "LN" for c in stem):
            return F.lit(False)  # no word of a text is like that
        steps.setdefault(step, []).append((stem, end))
    pattern, before = "", None
    for step, words in steps.items():
        if before is None:  # the word itself leads, which the search finds faster than what stands before it
            (stem, end), *words = words
            pattern = "".join(f"(?={s}{e})" for s, e in words) + f"{stem}(?<!{_IN}{stem}){end}"
        else:
            skipped = f"(?:{_IN}++{_OUT}++){{{step - before - 1}}}+" if step - before > 1 else ""
            pattern += f"{_IN}*+{_OUT}++{skipped}" + "".join(f"(?={s}{e})" for s, e in words)
        before = step
    return lowered.rlike(pattern)


def text_matches(x: Column, query: str) -> Column:
    """``to_tsvector('simple', x) @@ to_tsquery('simple', query)``: & | ! ( ) <-> <n> and prefixes ``w:*``."""
    q = _Query(query)
    out = q.either(F.lower(F.coalesce(x, F.lit(""))))
    if q.peek() is not None:
        raise ValueError(f"query syntax at {q.peek()!r}")
    return out

"""Splitting records with column expressions: one regular expression a token, no Python.

A line, prefixed by one separator, is a run of tokens (separator and field). A quote opens only at a field's
start; loops are possessive, so no input makes the matcher back up or recurse. The tokens cover the line exactly
when no quote is left open.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsmith.functions.dialect import BLANK, Dialect, doubtful


def java(text: str) -> str:
    """The text as a regular expression that matches itself, in Java's syntax and in Python's."""
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02x}" for c in text)


def pattern(d: Dialect, backslash: bool) -> str:
    s, q = java(d.col_sep), java(d.quote)
    blank = f"(?:(?!{s})[ \\t])*+" if d.strip else ""
    close = f"(?={s}|\\z)"
    if d.boundary == "legacy":  # any quote opens or closes, wherever it stands
        body = f"\\\\[\\s\\S]|[^{q}\\\\]++" if backslash else f"[^{q}]++"
        return f"{s}(?:{q}(?:{body})*+{q}|(?!{s})[^{q}])*+"
    # a quote that is part of a quoted field: doubled with something behind it, the first of two at the very end,
    # or one that nothing may close
    inner = f"{q}{q}(?=[\\s\\S])|{q}(?={q}\\z)|{q}(?!{q}|{s}|\\z)"
    body = f"\\\\[\\s\\S]|\\\\\\z|[^{q}\\\\]++|{inner}" if backslash else f"[^{q}]++|{inner}"
    return f"{s}(?:{blank}{q}(?:{body})*+{q}{close}|(?!{blank}{q})(?:(?!{s})[\\s\\S])*+)"


def _tokens(line: Column, d: Dialect, backslash: bool) -> Column:
    return F.regexp_extract_all(F.concat(F.lit(d.col_sep), line), F.lit(pattern(d, backslash)), F.lit(0))


def _covers(tokens: Column, line: Column, d: Dialect) -> Column:
    covered = F.aggregate(tokens, F.lit(0), lambda n, t: n + F.length(t))
    return covered == F.length(line) + len(d.col_sep)


def cell(raw: Column, d: Dialect) -> Column:
    """A raw field without blanks around it, its enclosing quotes, and with doubled quotes made single."""
    q = d.quote
    strip = (lambda c: F.btrim(c, F.lit(BLANK))) if d.strip else (lambda c: c)
    bare = strip(raw)
    quoted = (F.length(bare) > 1) & bare.startswith(q) & bare.endswith(q)
    inner = F.when(quoted, strip(bare.substr(F.lit(2), F.length(bare) - 2))).otherwise(bare)
    return F.when(F.instr(raw, q) == 0, bare).otherwise(F.replace(inner, F.lit(q + q), F.lit(q)))


def tokens(line: Column, d: Dialect) -> Column:
    """Raw tokens of a line under the dialect's escaping; null if a quote is open."""
    rfc, back = _tokens(line, d, False), _tokens(line, d, True)
    whole = lambda t: F.when(_covers(t, line, d), t)
    if d.escaping == "double_quotes":
        return whole(rfc)
    slash = F.instr(line, "\\") > 0
    if d.escaping == "backslash":
        return F.when(slash, whole(back)).otherwise(whole(rfc))
    return F.when(slash, F.coalesce(whole(back), whole(rfc))).otherwise(whole(rfc))


def raw_fields(line: Column, d: Dialect) -> Column:
    """Fields of a line as they stand, or null if a quote is open at its end; `cell` cleans those that are wanted."""
    quoted = F.transform(tokens(line, d), lambda t: F.substring(t, len(d.col_sep) + 1, 2_147_483_647))
    return F.when(F.instr(line, d.quote) == 0, F.split(line, java(d.col_sep), -1)).otherwise(quoted)


def fields(line: Column, d: Dialect) -> Column:
    """Clean fields of a line, or null if a quote is open at its end."""
    quoted = F.transform(tokens(line, d), lambda t: cell(F.substring(t, len(d.col_sep) + 1, 2_147_483_647), d))
    parts = F.split(line, java(d.col_sep), -1)
    plain = F.transform(parts, lambda x: F.btrim(x, F.lit(BLANK))) if d.strip else parts
    return F.when(F.instr(line, d.quote) == 0, plain).otherwise(quoted)


def quote_count(line: Column, d: Dialect, escaped: bool = False) -> Column:
    """Quote characters of a line; with `escaped`, without those behind an odd run of backslashes."""
    plain = F.regexp_replace(line, r"\\[\s\S]", "") if escaped else line
    return F.length(plain) - F.length(F.replace(plain, F.lit(d.quote), F.lit("")))


def take(array: Column, n: int) -> Column:
    """The first n fields."""
    return F.slice(array, 1, n)


def as_map(names: list[str], array: Column) -> Column:
    """Names to fields; null where a row is short."""
    return F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.get(array, F.lit(i)))])


def where(array: Column, keep) -> Column:
    """To be selected: the array, in rows where keep(array) holds; other rows vanish.

    A filter on a computed column would be pushed below it and compute it again; a generator isn't.
    """
    return F.explode(F.filter(F.array(array), keep))


def is_open(line: Column, d: Dialect) -> Column:
    """Whether a line, parsed alone, ends inside quotes."""
    return (F.instr(line, d.quote) > 0) & tokens(line, d).isNull()


def goes_on(line: Column, d: Dialect) -> Column:
    """Whether a line's last field closes only because its doubled quote stands at the end: all its quotes are doubled."""
    s, q = java(d.col_sep), java(d.quote)
    blank = f"(?:(?!{s})[ \\t])*+" if d.strip else ""
    ends = line.endswith(d.quote * 2)
    if d.escaping == "auto":
        ends = ends & (F.instr(line, "\\") == 0)
    found = _tokens(line, d, False)
    last = F.when(_covers(found, line, d), F.element_at(found, -1)).rlike(f"\\A{s}{blank}{q}(?:[^{q}]++|{q}{q})*+\\z")
    # a case, because what stands behind `&` twice is computed for all lines
    return F.when(ends, F.coalesce(last, F.lit(False))).otherwise(F.lit(False)) if doubtful(d) else F.lit(False)


def closing(line: Column, d: Dialect) -> Column:
    """Whether the first quote of a line that isn't doubled ends a field that was open before the line; null if it has none."""
    s, q = java(d.col_sep), java(d.quote)
    within = f"\\A(?:[^{q}]++|{q}{q})*+"
    return F.when((F.instr(line, d.quote) > 0) & ~line.rlike(within + "\\z"), line.rlike(f"{within}{q}(?={s}|\\z)"))


def python_pattern(d: Dialect, backslash: bool) -> re.Pattern:
    """The same expression for Python."""
    return re.compile(pattern(d, backslash).replace("\\z", "\\Z"))

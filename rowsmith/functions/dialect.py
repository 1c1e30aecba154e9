"""One record in Python: the quote state machine, field splitting, and framing of records that span lines.

Used on the driver for headers, in workers where records span lines or quotes may toggle anywhere, and in tests
as the yardstick of the column expressions in `tokenizer`.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

from rowsmith.options import ReadOptions

BLANK = " \t"


@dataclass(frozen=True)
class Dialect:
    """What splitting needs to know."""

    col_sep: str
    row_sep: str = "\n"
    quote: str = '"'
    escaping: str = "auto"
    boundary: str = "standard"
    strip: bool = True

    @classmethod
    def of(cls, options: ReadOptions, col_sep: str, row_sep: str = "\n") -> Dialect:
        return cls(col_sep, row_sep, options.quote_char, options.quote_escaping, options.quote_boundary, options.strip_whitespace)


def clean(field: str, d: Dialect) -> str:
    """A raw field without blanks around it, its enclosing quotes, and with doubled quotes made single."""
    q = d.quote
    if d.strip:
        field = field.strip(BLANK)
    if len(field) > 1 and field[0] == q == field[-1]:
        field = field[1:-1]
        if d.strip:
            field = field.strip(BLANK)
    return field.replace(q + q, q)


def _scan(line: str, d: Dialect, backslash: bool) -> tuple[list[str], bool]:
    """(raw fields, whether a quote is open at the end) under one escaping convention."""
    q, sep = d.quote, d.col_sep
    fields, start, at, inside = [], 0, 0, False
    fresh = True  # only blanks so far in this field
    n = len(line)
    escaped = False
    while at < n:
        c = line[at]
        if not inside and line.startswith(sep, at):
            fields.append(line[start:at])
            at += len(sep)
            start, fresh, escaped = at, True, False
            continue
        if backslash and inside and c == "\\" and not escaped:
            escaped = True
            at += 1
            continue
        if c == q and not escaped:
            if d.boundary == "legacy":
                inside = not inside
            elif not inside:
                inside = fresh
                fresh = False
            else:
                after = at + 1
                if line.startswith(q, after) and after + 1 < n:
                    at = after  # a doubled quote with something behind it
                elif after >= n or line.startswith(sep, after) or line.startswith(d.row_sep, after) or line[after:] == q:
                    inside = False
                    if line[after:] == q:
                        at = after
        elif not (d.strip and c in BLANK):
            fresh = False
        escaped = False
        at += 1
    fields.append(line[start:])
    return fields, inside


def split(line: str, d: Dialect) -> tuple[list[str], bool]:
    """(clean fields, whether a quote is still open). `auto` tries backslash escapes, then doubled quotes alone."""
    if d.quote not in line:
        return [x.strip(BLANK) if d.strip else x for x in line.split(d.col_sep)], False
    backslash = d.escaping != "double_quotes" and "\\" in line
    raw, still = _scan(line, d, backslash)
    if still and backslash and d.escaping == "auto":
        raw, still = _scan(line, d, False)
    return [clean(x, d) for x in raw], still


def split_record(line: str, options: ReadOptions, col_sep: str, row_sep: str = "\n") -> tuple[list[str], bool]:
    return split(line, Dialect.of(options, col_sep, row_sep))


def doubtful(d: Dialect, line: str | None = None) -> bool:
    """Whether doubled quotes at the end of lines (or of this one) may be part of a field that goes on: not where backslashes or legacy boundaries rule."""
    if d.boundary == "legacy" or d.escaping == "backslash":
        return False
    return line is None or line.endswith(d.quote * 2) and (d.escaping == "double_quotes" or "\\" not in line)


def goes_on(line: str, d: Dialect) -> bool:
    """Whether a line's last field closes only because its doubled quote stands at the end: all its quotes are doubled."""
    if not doubtful(d, line):
        return False
    raw, inside = _scan(line, d, False)
    last = raw[-1].lstrip(BLANK) if d.strip else raw[-1]
    return not inside and last.startswith(d.quote) and d.quote not in last[1:].replace(d.quote * 2, "")


@lru_cache(64)
def _closing(d: Dialect) -> re.Pattern:
    q = re.escape(d.quote)
    return re.compile(f"(?:[^{q}]|{q}{q})*+{q}(?={re.escape(d.col_sep)}|\\Z)")


class _Lines:
    """Lines one after the other, with a look at those that follow."""

    def __init__(self, lines: Iterable[str], d: Dialect) -> None:
        self.rest, self.d = iter(lines), d
        self.ahead: deque[str] = deque()
        #: what the last line of `ahead` told, the first one with a quote that isn't doubled; None before there is one
        self.told: bool | None = None

    def take(self) -> str | None:
        if not self.ahead:
            return next(self.rest, None)
        line = self.ahead.popleft()
        if not self.ahead:
            self.told = None
        return line

    def close(self, limit: int | None) -> bool:
        """Whether the next quote that isn't doubled ends a field, so that one which is open here goes on until there;
        also where it is more than `limit` bytes away."""
        size = 0
        if self.told is None and limit is not None:
            size = sum(len(x.encode()) for x in self.ahead)
        while self.told is None:
            if limit is not None and size > limit:
                return True
            line = next(self.rest, None)
            if line is None:
                return False
            self.ahead.append(line)
            size += len(line.encode()) if limit is not None else 0
            if self.d.quote in line.replace(self.d.quote * 2, ""):
                self.told = _closing(self.d).match(line) is not None
        return self.told


@dataclass
class Record:
    """A logical line: where it starts, how many physical lines it has, its text and fields."""

    file_line: int
    csv_line: int
    n_lines: int
    raw: str
    fields: list[str]
    status: str  # ok | malformed | field_too_large


def frame(lines: Iterable[str], d: Dialect, comment=None, first_line: int = 1, first_record: int = 1, limit: int | None = None) -> Iterator[Record]:
    """Records of consecutive physical lines. A record goes on while a quote is open; comments inside it are text.

    An open quote at the end makes one malformed record of all that it swallowed; one that grows beyond `limit`
    bytes for a field ends there as too large. A doubled quote at the end of a line is part of a field that goes on if
    the next quote that isn't doubled closes it; else it ends the field.
    """
    it = _Lines(lines, d)
    file_line, csv_line = first_line - 1, first_record - 1
    for line in iter(it.take, None):
        file_line += 1
        csv_line += 1
        if comment is not None and comment.search(line):
            continue
        start, raw, n, status = file_line, line, 1, "ok"
        fields, still = split(raw, d)
        still = still or goes_on(line, d) and it.close(limit)
        parts = [raw]
        while still:
            more = it.take()
            if more is None:
                status = "malformed"
                break
            file_line += 1
            n += 1
            parts.append(more)
            if limit is not None and len(d.row_sep.join(parts).encode()) > limit:
                status = "field_too_large"
                raw = d.row_sep.join(parts)
                break
            # only a line with a quote can close the record
            if d.quote in more:
                raw = d.row_sep.join(parts)
                fields, still = split(raw, d)
                still = still or goes_on(d.quote + more, d) and it.close(limit)
        if status == "malformed":
            raw = d.row_sep.join(parts)
        yield Record(start, csv_line, n, raw, fields if status == "ok" else [], status)

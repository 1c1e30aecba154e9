"""Dialect sniffing on the first bytes of an input: encoding marks, row separator, column separator."""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable

from rowsmith.errors import NoColSepDetected
from rowsmith.options import MAX_SNIFF, ReadOptions

#: Byte-order marks, longest first.
MARKS = ((codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF8, "utf-8"),
         (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
#: Candidate column separators; of equally frequent ones the first wins.
CANDIDATES = (",", "\t", ";", ":", "|")


def mark(head: bytes) -> tuple[str | None, int]:
    """(encoding, length) of a byte-order mark at the start."""
    for m, name in MARKS:
        if head.startswith(m):
            return name, len(m)
    return None, 0


def _windows(first: int) -> list[int]:
    """Ends of the growing windows: one of `first` characters, one more, then doubling to the cap."""
    ends, size = [first], first
    while ends[-1] < MAX_SNIFF:
        ends.append(min(ends[-1] + size, MAX_SNIFF) if len(ends) < 6 else MAX_SNIFF)
        size *= 2 if len(ends) > 2 else 1
    return ends


def row_sep(text: str, options: ReadOptions, warn: Callable[[str, str], None]) -> str:
    """The separator that outnumbers all others together outside quotes, in the smallest window that decides."""
    q = options.quote_char
    counts = {"\r\n": 0, "\n": 0, "\r": 0}
    inside, at = False, 0

    def winner() -> str | None:
        total = sum(counts.values())
        return next((s for s, n in counts.items() if n > total - n), None)

    for end in _windows(options.auto_row_sep_chars):
        stop = min(end, len(text))
        while at < stop:
            c = text[at]
            if c == q:
                inside = not inside
            elif not inside and c == "\r":
                if at + 1 == stop < len(text):
                    break  # its pair may follow in the next window
                if text[at + 1 : at + 2] == "\n":
                    counts["\r\n"] += 1
                    at += 1
                else:
                    counts["\r"] += 1
            elif not inside and c == "\n":
                counts["\n"] += 1
            at += 1
        if found := winner():
            return found
        if stop == len(text):
            break
    if text:
        if any(counts.values()):
            warn("no_clear_row_sep", f"no clear row separator: saw {counts}; taking LF")
        else:
            warn("no_row_sep_found", "no row separator found; taking LF")
    return "\n"


def col_sep(text: str, options: ReadOptions, sep: str) -> str:
    """The most frequent candidate outside quotes, in the header line or, without header, in five lines."""
    lines = text.split(sep)[: 1 if options.headers_in_file else 5]
    lines = [x for x in lines if x]
    if not lines:
        return ","
    q = re.escape(options.quote_char)
    plain = [re.sub(f"{q}[^{q}]*{q}", "", x) for x in lines]
    counts = {c: sum(x.count(c) for x in plain) for c in CANDIDATES}
    best = max(CANDIDATES, key=lambda c: counts[c])
    if counts[best]:
        return best
    if all(re.fullmatch(r"[\w\s]+", x) for x in lines):
        return ","
    raise NoColSepDetected("no column separator found; pass col_sep")

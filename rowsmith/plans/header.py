"""The header pipeline: from a raw header line to column names, in a fixed order, on the driver."""

from __future__ import annotations

import re

from rowsmith.errors import DuplicateHeaders, EmptyFileError, HeaderSizeMismatch, IncorrectOption, KeyMappingError, MalformedCSV, MissingKeys
from rowsmith.functions.dialect import split_record
from rowsmith.options import ReadOptions


#: What counts as blank in a header: ASCII alone, and NUL at its ends.
BLANK = " \t\n\v\f\r"


def raw_names(line: str, options: ReadOptions, col_sep: str) -> list[str]:
    """Fields of the header line, without comment match, unwanted characters and quotes."""
    if not line.strip(BLANK):
        raise EmptyFileError("no header line")
    if options.comment_regexp:
        line = re.sub(options.comment_regexp, "", line, count=1)
    if options.strip_chars_from_headers:
        line = re.sub(options.strip_chars_from_headers, "", line)
    fields, still_open = split_record(line, options, col_sep)
    if still_open:
        raise MalformedCSV("the header has an unclosed quote")
    fields = [f.replace(options.quote_char, "") for f in fields]
    return [f.strip(BLANK + "\0") for f in fields] if options.strip_whitespace else fields


def normalise(names: list[str], options: ReadOptions) -> list[str]:
    if not options.keep_original_headers:
        names = [re.sub(r"\s+|-+", "_", n, flags=re.ASCII) for n in names]
        if options.downcase_header:
            names = [n.lower() for n in names]
    if options.duplicate_header_suffix is None:
        return names
    taken = set(names)
    out = []
    for i, name in enumerate(names):
        if not name.strip(BLANK):
            name = f"{options.missing_header_prefix}{i + 1}"
            while name in taken:
                name += "_"
            taken.add(name)
        out.append(name)
    seen: dict[str, int] = {}
    for i, name in enumerate(out):
        seen[name] = seen.get(name, 0) + 1
        if seen[name] > 1:
            out[i] = f"{name}{options.duplicate_header_suffix}{seen[name]}"
    return out


def remap(names: list[str], options: ReadOptions) -> list[str | None]:
    """Names after key_mapping; None where a column is dropped."""
    mapping = options.key_mapping
    if mapping is None:
        return list(names)
    if not isinstance(mapping, dict) or not mapping:
        raise IncorrectOption("key_mapping must be a dictionary with entries")
    missing = [k for k in mapping if k not in names]
    silent = options.silence_missing_keys
    if isinstance(silent, list | tuple | set):
        missing = [k for k in missing if k not in silent]
    if missing and silent is not True:
        raise KeyMappingError(f"key_mapping names headers that are not there: {', '.join(missing)}")
    return [(mapping[n] or None) if n in mapping else None if options.remove_unmapped_keys else n for n in names]


def names_of(line: str | None, options: ReadOptions, col_sep: str) -> list[str | None]:
    """The columns in file order; None where one is dropped."""
    given = options.user_provided_headers
    if options.headers_in_file:
        if line is None:
            raise EmptyFileError("no header line")
        found = raw_names(line, options, col_sep)
        if given:
            if len(given) != len(found):
                raise HeaderSizeMismatch(f"{len(given)} headers given, the file has {len(found)}")
            names: list[str | None] = list(given)
        else:
            names = remap(normalise(found, options), options)
    elif given:
        names = list(given)
    else:
        raise IncorrectOption("without a header in the file, user_provided_headers must be given")
    check(names, options)
    return names


def check(names: list[str | None], options: ReadOptions) -> None:
    kept = [n for n in names if n is not None]
    twice = sorted({n for n in kept if kept.count(n) > 1})
    if twice:
        raise DuplicateHeaders(f"duplicate headers: {', '.join(twice)}", twice)
    lacking = [k for k in options.required_keys or [] if k not in kept]
    if lacking:
        raise MissingKeys(f"missing keys: {', '.join(lacking)}", lacking)


def extra_name(index: int, options: ReadOptions) -> str:
    """Name of the column at a 0-based position beyond the header."""
    return f"{options.missing_header_prefix}{index + 1}"

"""Options of the reader and the writer: defaults, deprecated spellings, validation."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Any

from rowsmith.errors import ValidationError

log = logging.getLogger("rowsmith")

# Bounds of the sniffing window and of the (inert) stream buffer, in bytes.
MIN_SNIFF, DEFAULT_SNIFF, MAX_SNIFF = 512, 4096, 65536
MIN_BUFFER, DEFAULT_BUFFER, MAX_BUFFER = 4096, 16384, 65536
DEFAULT_CHUNK = 100

#: Deprecated names and what they stand for now.
RENAMED = {"required_headers": "required_keys", "remove_values_matching": "nil_values_matching"}


def _names(value: Any) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


@dataclass
class ReadOptions:
    """How a file is read. Regular expressions are strings that both Java and Python understand."""

    acceleration: bool = True  # accepted, no effect
    auto_row_sep_chars: int = DEFAULT_SNIFF
    bad_row_limit: int | None = None
    buffer_size: int | None = DEFAULT_BUFFER  # accepted, no effect: files are read where they are
    chunk_size: int | None = None
    col_sep: str = "auto"
    collect_raw_lines: bool = True
    comment_regexp: str | None = None
    convert_values_to_numeric: Any = True  # bool, {"only": [...]} or {"except": [...]}
    decimal_precision: str = "auto"  # auto | float | bigdecimal
    downcase_header: bool = True
    duplicate_header_suffix: str | None = ""
    field_size_limit: int | None = None
    file_encoding: str = "utf-8"
    force_utf8: bool = False
    headers: dict | None = None  # {"only": [...]} or {"except": [...]}
    headers_in_file: bool | None = None
    invalid_byte_sequence: str = ""
    keep_original_headers: bool = False
    key_mapping: dict | None = None
    missing_header_prefix: str = "column_"
    missing_headers: str = "auto"  # auto | raise
    nil_values_matching: str | None = None
    on_bad_row: Any = "raise"  # raise | skip | collect | callable
    on_chunk: Callable | None = None
    on_complete: Callable | None = None
    on_start: Callable | None = None
    quote_boundary: str = "standard"  # standard | legacy
    quote_char: str = '"'
    quote_escaping: str = "auto"  # auto | double_quotes | backslash
    remove_empty_hashes: bool = True
    remove_empty_values: bool = True
    remove_unmapped_keys: bool = False
    remove_zero_values: bool = False
    required_keys: list[str] | None = None
    row_sep: str = "auto"
    silence_missing_keys: Any = False
    skip_lines: int | None = None
    strings_as_keys: bool = False  # accepted: names are strings here
    strip_chars_from_headers: str | None = None
    strip_whitespace: bool = True
    user_provided_headers: list[str] | None = None
    value_converters: dict | None = None
    verbose: Any = "normal"
    with_line_numbers: bool = False
    # ours
    typing: str = "column"  # column | cell (VARIANT) | string
    schema: dict | None = None  # name -> Spark type; no inference for these
    warnings: list[dict] = field(default_factory=list)

    @classmethod
    def of(cls, **given: Any) -> ReadOptions:
        given = dict(given)
        quiet = given.get("verbose") in ("quiet", False)
        notes: list[dict] = []

        def note(code: str, message: str, kind: str = "deprecation") -> None:
            notes.append({"type": kind, "code": code, "severity": "warning", "message": message, "count": 1})
            if not quiet:
                log.warning(message)

        for old, new in RENAMED.items():
            if (value := given.pop(old, None)) is not None:
                note(old, f"{old} is deprecated, use {new}")
                given.setdefault(new, value)
        if (strict := given.pop("strict", None)) is not None:
            note("strict", "strict is deprecated, use missing_headers")
            given.setdefault("missing_headers", "raise" if strict else "auto")
        chosen = dict(given.get("headers") or {})
        for old, new in (("only_headers", "only"), ("except_headers", "except")):
            if (value := given.pop(old, None)) is not None:
                note(old, f"{old} is deprecated, use headers={{'{new}': [...]}}")
                chosen.setdefault(new, value)
        if chosen:
            given["headers"] = {k: _names(v) for k, v in chosen.items()}
        if isinstance(given.get("verbose"), bool):
            given["verbose"] = "debug" if given["verbose"] else "normal"
        unknown = sorted(set(given) - {f.name for f in fields(cls)})
        if unknown:
            raise ValidationError(f"unknown options: {', '.join(unknown)}")
        out = cls(**given)
        if out.headers_in_file is None:
            out.headers_in_file = not out.user_provided_headers
            if out.user_provided_headers:
                note("header_a_method", "user_provided_headers: headers_in_file is taken as false; set it if the file has a header", "options")
        out._clamp(lambda m: note("option_bounds", m, "options"))
        out._validate()
        out.warnings += notes
        return out

    def _clamp(self, note: Callable[[str], None]) -> None:
        n = self.auto_row_sep_chars
        if not isinstance(n, int) or isinstance(n, bool) or n < MIN_SNIFF:
            note(f"auto_row_sep_chars {n!r} is not an integer of at least {MIN_SNIFF}; using {DEFAULT_SNIFF}")
            self.auto_row_sep_chars = DEFAULT_SNIFF
        elif n > MAX_SNIFF:
            note(f"auto_row_sep_chars {n} is above {MAX_SNIFF}; using {MAX_SNIFF}")
            self.auto_row_sep_chars = MAX_SNIFF
        b = self.buffer_size or DEFAULT_BUFFER
        if not isinstance(b, int) or isinstance(b, bool):
            note(f"buffer_size {b!r} is not an integer; using {DEFAULT_BUFFER}")
            b = DEFAULT_BUFFER
        self.buffer_size = min(max(b, MIN_BUFFER), MAX_BUFFER)
        if b != self.buffer_size:
            note(f"buffer_size {b} is out of bounds; using {self.buffer_size}")

    def _validate(self) -> None:
        bad = []
        text = lambda v: isinstance(v, str) and v != ""
        for name in ("row_sep", "col_sep", "quote_char"):
            if not text(getattr(self, name)):
                bad.append(f"{name} must be a non-empty string")
        if text(self.quote_char) and len(self.quote_char.encode()) > 1:
            bad.append("quote_char must be a single byte")
        for name, allowed in (
            ("quote_escaping", ("auto", "double_quotes", "backslash")), ("quote_boundary", ("standard", "legacy")),
            ("decimal_precision", ("auto", "float", "bigdecimal")), ("missing_headers", ("auto", "raise")),
            ("verbose", ("quiet", "normal", "debug")), ("typing", ("column", "cell", "string")),
        ):
            if getattr(self, name) not in allowed:
                bad.append(f"{name} must be one of {', '.join(allowed)}")
        limit = self.field_size_limit
        if limit is not None and (not isinstance(limit, int) or limit <= 0):
            bad.append("field_size_limit must be a positive integer")
        if not callable(self.on_bad_row) and self.on_bad_row not in ("raise", "skip", "collect"):
            bad.append("on_bad_row must be raise, skip, collect or callable")
        for name in ("on_start", "on_chunk", "on_complete"):
            if getattr(self, name) is not None and not callable(getattr(self, name)):
                bad.append(f"{name} must be callable")
        if self.chunk_size is not None and (not isinstance(self.chunk_size, int) or self.chunk_size < 1):
            bad.append("chunk_size must be a positive integer")
        for name in ("headers", "convert_values_to_numeric"):
            value = getattr(self, name)
            if isinstance(value, dict):
                if "only" in value and "except" in value:
                    bad.append(f"{name} takes only or except, not both")
                elif set(value) - {"only", "except"}:
                    bad.append(f"{name} takes only or except")
        if bad:
            raise ValidationError("; ".join(bad))

    def numeric(self, name: str) -> bool:
        """Whether a column's values are converted to numbers."""
        c = self.convert_values_to_numeric
        if isinstance(c, dict):
            return name in _names(c["only"]) if "only" in c else name not in _names(c.get("except", []))
        return bool(c)


@dataclass
class WriteOptions:
    """How rows are written."""

    col_sep: str = ","
    row_sep: str = "\n"
    quote_char: str = '"'
    headers: list[str] = field(default_factory=list)
    map_headers: dict = field(default_factory=dict)
    discover_headers: bool | None = None
    header_converter: Callable[[str], str] | None = None
    value_converters: dict = field(default_factory=dict)
    write_nil_value: str = ""
    write_empty_value: str = ""
    force_quotes: bool = False
    quote_headers: bool = False
    disable_auto_quoting: bool = False
    write_headers: bool = True
    write_bom: bool = False
    encoding: str | None = None

    @classmethod
    def of(cls, **given: Any) -> WriteOptions:
        unknown = sorted(set(given) - {f.name for f in fields(cls)})
        if unknown:
            raise ValidationError(f"unknown options: {', '.join(unknown)}")
        out = cls(**given)
        if out.discover_headers is None:
            out.discover_headers = not (out.headers or out.map_headers)
        bad = [f"{n} must be a non-empty string" for n in ("col_sep", "row_sep", "quote_char") if not isinstance(getattr(out, n), str) or not getattr(out, n)]
        if bad:
            raise ValidationError("; ".join(bad))
        return out



"""The value pipeline as column expressions, in a fixed order: null sentinels, blanks, zeros, numbers, converters.

Every function takes and returns string columns unless it says otherwise; none knows about files.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsmith.options import ReadOptions

# Fixed grammars. \A and \z, because $ would also match before a trailing line end.
NUMBER = r"\A[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\z"
WHOLE = r"\A[+-]?\d+\z"
ZERO = r"\A[+-]?0+(?:\.0+)?\z"
BLANK = r"\A\p{IsWhite_Space}*\z"
#: Digits that a double holds for certain; longer decimals stay exact under `auto`.
DOUBLE_DIGITS = 16


def null_matching(c: Column, pattern: str) -> Column:
    """Null where the pattern occurs in the value."""
    return F.when(~c.rlike(pattern), c)


def is_blank(c: Column) -> Column:
    """Whether there is nothing but Unicode white space; what begins with a visible ASCII character is told without a pattern."""
    return ~((c >= "!") & (c < "\x7f")) & c.rlike(BLANK)


def blank_to_null(c: Column) -> Column:
    """Null where there is nothing but Unicode white space."""
    return F.when(~is_blank(c), c)


def zero_to_null(c: Column) -> Column:
    """Null where the value is zero, as text or (0e5) as a number."""
    as_number = F.when(c.rlike(NUMBER), c.try_cast("double"))
    return F.when(~(c.rlike(ZERO) | F.coalesce(as_number == 0, F.lit(False))), c)


def is_number(c: Column) -> Column:
    return c.rlike(NUMBER)


def is_whole(c: Column) -> Column:
    return c.rlike(WHOLE)


def significant(c: Column) -> Column:
    """How many significant digits a number is written with: no leading zeros, no exponent, trailing zeros count."""
    mantissa = F.regexp_replace(F.regexp_replace(c, r"[eE].*\z", ""), r"\D", "")
    return F.length(F.ltrim(mantissa, F.lit("0")))


def to_double(c: Column) -> Column:
    return F.when(is_number(c), c.try_cast("double"))


def to_long(c: Column) -> Column:
    return F.when(is_whole(c), c.try_cast("bigint"))


def to_decimal(c: Column, precision: int = 38, scale: int = 18) -> Column:
    return F.when(is_number(c), c.try_cast(f"decimal({precision},{scale})"))


def number_cell(c: Column, policy: str = "auto") -> Column:
    """One value as a VARIANT: whole numbers as integers, others as double or decimal, text as text."""
    whole = F.coalesce(c.try_cast("bigint").cast("variant"), c.try_cast("decimal(38,0)").cast("variant"))
    exact = c.try_cast("decimal(38,18)").cast("variant")
    near = c.try_cast("double").cast("variant")
    decimal = near if policy == "float" else F.coalesce(exact, near) if policy == "bigdecimal" else F.when(
        significant(c) > DOUBLE_DIGITS, F.coalesce(exact, near)).otherwise(near)
    text = c.cast("variant")
    return F.when(is_whole(c), F.coalesce(whole, text)).when(is_number(c), decimal).otherwise(text)


def clean(c: Column, options: ReadOptions) -> Column:
    """Steps before numbers: null sentinels, blanks, zeros."""
    if options.nil_values_matching:
        c = null_matching(c, options.nil_values_matching)
    if options.remove_empty_values:
        c = blank_to_null(c)
    if options.remove_zero_values:
        c = zero_to_null(c)
    return c


def convert(c: Column, name: str, kind: str | None, options: ReadOptions) -> Column:
    """Numbers and converters of one cleaned column. kind: its Spark type, `cell` for VARIANT, None for text."""
    if kind == "cell":
        c = number_cell(c, options.decimal_precision) if options.numeric(name) else c.cast("variant")
    elif kind == "double":
        c = to_double(c)
    elif kind == "bigint":
        c = to_long(c)
    elif kind and kind.startswith("decimal"):
        c = F.when(is_number(c), c.try_cast(kind))
    elif kind and kind != "string":
        c = c.try_cast(kind)
    converter = (options.value_converters or {}).get(name)
    if converter is None:
        return c
    return converter.convert(c) if hasattr(converter, "convert") else converter(c)

"""Ready-made value converters: functions from column to column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Converter = Callable[[Column], Column]

#: Usual spellings of a missing value, as a pattern for `nil_values_matching`.
NULL_SENTINELS = r"\A(?:NULL|null|\\N|N/A|n/a|NaN|#N/A|nil|none|None|-)\z"


def boolean(true: str = "true|t|yes|y|1", false: str = "false|f|no|n|0") -> Converter:
    """True and false by their spellings, in any case; null for anything else."""
    return lambda c: F.when(c.cast("string").rlike(rf"(?i)\A(?:{true})\z"), True).when(c.cast("string").rlike(rf"(?i)\A(?:{false})\z"), False)


def money(scale: int = 2) -> Converter:
    """An amount without currency signs and thousands separators; parentheses mean less than zero."""

    def run(c: Column) -> Column:
        text = F.btrim(c.cast("string"))
        digits = F.regexp_replace(text, r"[^0-9.\-]", "")
        signed = F.when(text.rlike(r"\A\(.*\)\z"), F.concat(F.lit("-"), digits)).otherwise(digits)
        return signed.try_cast(f"decimal(38,{scale})")

    return run


def european(scale: int = 2) -> Converter:
    """A number written with points for thousands and a comma for decimals."""
    return lambda c: F.replace(F.replace(F.btrim(c.cast("string")), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast(f"decimal(38,{scale})")


def percent() -> Converter:
    return lambda c: F.regexp_replace(c.cast("string"), r"\s*%\s*\z", "").try_cast("double") / 100


def date(fmt: str) -> Converter:
    """A date in an explicit format; null where it doesn't fit."""
    return lambda c: F.try_to_timestamp(c.cast("string"), F.lit(fmt)).cast("date")


def timestamp(fmt: str) -> Converter:
    return lambda c: F.try_to_timestamp(c.cast("string"), F.lit(fmt))


def listed(sep: str = r"\|", strip: bool = True) -> Converter:
    """A cell with several values as an array; sep is a regular expression."""
    return lambda c: F.transform(F.split(c.cast("string"), sep, -1), lambda x: F.btrim(x)) if strip else F.split(c.cast("string"), sep, -1)

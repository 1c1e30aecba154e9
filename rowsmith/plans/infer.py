"""One aggregate over all rows that settles the frame's shape: width of the widest row, statuses, and a type per column.

A column is numeric only if every value that is left after cleaning is. Whole numbers are bigint, or decimal(p, 0)
up to 38 digits; others are double, or decimal where the policy or a value with too many digits asks for it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.functions import tokenizer
from rowsmith.functions import values as V
from rowsmith.options import ReadOptions

MOST_DIGITS = 38
LONG_DIGITS = 18


@dataclass
class Shape:
    """What one look at all records told; facts: by column, of those that were asked for."""

    width: int
    statuses: dict[str, int]
    backslash: bool = False
    doubled: bool = False  # whether a line ends with a doubled quote
    facts: dict[str, dict] = field(default_factory=dict)


#: Of a column: its values, how many are numbers, whole numbers, and numbers with more characters than a double's digits.
FACTS = ("n", "num", "int", "long")
#: What only long numbers, or exact decimals, need to be known of.
DETAILS = ("sig", "left", "right", "exp")


def survey(records: DataFrame, columns: dict[str, Column], options: ReadOptions) -> Shape:
    """Widest good row, rows by status, and the facts of `columns` (of a row's `fields`), in one aggregate."""
    wanted = [n for n in columns if options.numeric(n)]
    slash = F.max((F.instr("raw", "\\") > 0).cast("int")).alias("b")
    doubled = F.max(F.col("raw").endswith(options.quote_char * 2).cast("int")).alias("d")
    facts = [x for i, n in enumerate(wanted) for x in _facts(columns[n], f"c{i}")]
    rows = [r.asDict() for r in _once(records).groupBy("status").agg(F.max(F.size("fields")).alias("w"), F.count("*").alias("n"), slash, doubled, *facts).collect()]
    good = next((r for r in rows if r["status"] == "ok"), {})
    found = {name: {k: good.get(f"c{i}_{k}") or 0 for k in FACTS} for i, name in enumerate(wanted)}
    shape = Shape(good.get("w") or 0, {r["status"]: r["n"] for r in rows}, any(r["b"] for r in rows), any(r["d"] for r in rows), found)
    more = [n for n in wanted if _unsettled(found[n], options)]
    if more and "open" not in shape.statuses:  # else the records are framed and surveyed anew
        told = _once(records).filter("status = 'ok'").agg(*[x for i, n in enumerate(more) for x in _details(columns[n], f"c{i}")]).first().asDict()
        for i, n in enumerate(more):
            found[n] |= {k: told[f"c{i}_{k}"] or 0 for k in DETAILS}
    return shape


def _once(records: DataFrame) -> DataFrame:
    """Through a generator, which keeps the fields from being split once for each use of them."""
    return records.select("status", "raw", tokenizer.where(F.col("fields"), lambda f: F.lit(True)).alias("fields"))


def _unsettled(fact: dict, options: ReadOptions) -> bool:
    """Whether a numeric column's type depends on its values' digits."""
    return bool(fact["n"]) and fact["num"] == fact["n"] and (fact["long"] > 0 or fact["int"] < fact["n"] and options.decimal_precision == "bigdecimal")


def _facts(c: Column, key: str) -> list[Column]:
    number = V.is_number(c)
    return [
        F.count(c).alias(f"{key}_n"), F.count(F.when(number, 1)).alias(f"{key}_num"), F.count(F.when(number & V.is_whole(c), 1)).alias(f"{key}_int"),
        F.count(F.when(number & (F.length(c) > V.DOUBLE_DIGITS), 1)).alias(f"{key}_long"),
    ]


def _details(c: Column, key: str) -> list[Column]:
    mantissa = F.regexp_replace(c, r"[eE].*\z", "")
    return [
        F.max(V.significant(c)).alias(f"{key}_sig"),
        F.max(F.length(F.regexp_replace(F.substring_index(mantissa, ".", 1), r"\A[+-]?0*", ""))).alias(f"{key}_left"),
        F.max(F.when(mantissa.contains("."), F.length(F.substring_index(mantissa, ".", -1)))).alias(f"{key}_right"),
        F.count(F.when(c.rlike("[eE]"), 1)).alias(f"{key}_exp"),
    ]


def types(facts: dict[str, dict], columns: list[str], options: ReadOptions) -> tuple[dict[str, str], list[str]]:
    """(Spark type of each column, names of those whose numbers fit no type and stay text)."""
    out = dict.fromkeys(columns, "string")
    lost: list[str] = []
    for name in (n for n in columns if n in facts):
        n, num, whole = (facts[name][k] for k in FACTS[:3])
        if not n or num < n:
            continue
        if "sig" not in facts[name]:
            out[name] = "bigint" if whole == n else "double"
            continue
        sig, left, right, exp = (facts[name][k] for k in DETAILS)
        if whole == n:
            out[name] = "bigint" if left <= LONG_DIGITS else f"decimal({left},0)" if left <= MOST_DIGITS else "string"
        else:
            exact = options.decimal_precision == "bigdecimal" or options.decimal_precision == "auto" and sig > V.DOUBLE_DIGITS
            if exact and exp:
                right = max(right, 18)
            fits = left + right <= MOST_DIGITS
            out[name] = f"decimal({max(left + right, 1)},{right})" if exact and fits else "double"
            if exact and not fits:
                lost.append(name)
        if out[name] == "string":
            lost.append(name)
    return out, lost

"""Logical records: lines into fields.

Where every line stands alone, each is its own record. Where quotes span lines, a line is a function from "inside
quotes or not" before it to the same after it; composing these in order gives the state at every line, so records
are joined in parallel. Under `auto` escaping a record goes on only while it is open by either convention, so "inside"
is one state there too. Only files in which a record grows past `field_size_limit` are framed by a stream over each.

A doubled quote at the end of a line is a quote inside a field that goes on, or (leniently) the field's end: it goes on if
the next quote that isn't doubled, on whatever later line of the file, closes the field.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.functions import tokenizer
from rowsmith.functions.dialect import Dialect, doubtful, frame
from rowsmith.sources.scratch import scratch

SCHEMA = "file string, file_line long, csv_line long, n_lines int, raw string, fields array<string>, status string"


def single(lines: DataFrame, d: Dialect, comment: str | None) -> DataFrame:
    """Every line as its own record; status `open` where it ends inside quotes, or may. See SCHEMA."""
    if comment:
        lines = lines.filter(~F.col("raw").rlike(comment))
    base = lines.select("file", "file_line", F.col("file_line").alias("csv_line"), F.lit(1).alias("n_lines"), "raw")
    out = base.withColumn("fields", tokenizer.fields(F.col("raw"), d))
    return out.withColumn("status", F.when(F.col("fields").isNull() | tokenizer.goes_on(F.col("raw"), d), "open").otherwise("ok"))


#: Bytes of a record that spans lines beyond which it isn't put together: a quote that never closes may swallow a whole file.
MOST_BYTES = 256 << 20


def joined(
    lines: DataFrame, d: Dialect, comment: str | None, first_record: int = 1, stretch: int = 100_000, most: int | None = None, doubts: bool = True,
) -> DataFrame:
    """Records that may span lines, without a sequential pass. See SCHEMA.

    With `most`, a record of more bytes is malformed and has no text: its lines are counted, not gathered. Without
    `doubts`, no line ends with a doubled quote.

    A line's function is the identity, a flip, or a constant. The state before a line is the last constant's value,
    flipped as often as flips follow it; per stretch of lines by a window, between stretches by one row each.
    """
    row = F.lit(True) if comment is None else ~F.col("raw").rlike(comment)
    bare = F.instr("raw", d.quote) == 0
    quoted = F.concat(F.lit(d.quote), F.col("raw"))
    # inside quotes, a line without any stays inside
    base = lines.select(
        "file", "file_line", "raw", F.floor(F.col("file_line") / stretch).alias("part"), F.when(bare, False).otherwise(row & tokenizer.is_open(F.col("raw"), d)).alias("fresh"),
        F.when(bare, True).otherwise(tokenizer.is_open(quoted, d)).alias("within"))
    if doubts and doubtful(d):
        base = _followed(base.select(
            "*", (row & tokenizer.goes_on(F.col("raw"), d)).alias("fresh_on"), tokenizer.goes_on(quoted, d).alias("within_on"),
            tokenizer.closing(F.col("raw"), d).alias("told")))
        base = base.withColumn("fresh", F.expr("fresh OR fresh_on AND closes")).withColumn("within", F.expr("within OR within_on AND closes"))
    base = base.select("file", "file_line", "raw", "part", F.col("fresh").cast("int").alias("f0"), F.col("within").cast("int").alias("f1"))
    base = base.select("file", "file_line", "raw", "part", F.when(F.col("f0") == F.col("f1"), F.col("f0")).alias("const"), (F.col("f0") > F.col("f1")).cast("int").alias("flip"))

    def states(df: DataFrame, by: list[str], order: str) -> DataFrame:
        """df with `last` (constant before this row, if any) and `odd` (parity of flips since then, or since the start)."""
        past = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("flips", F.coalesce(F.sum("flip").over(past), F.lit(0)))
        # a constant remembers how many flips were before it; flips are counted after it only
        mark = F.when(F.col("const").isNotNull(), F.struct(F.col("const").alias("v"), (F.col("flips") + F.col("flip")).alias("at")))
        df = df.withColumn("mark", mark).withColumn("mark", F.last("mark", ignorenulls=True).over(past))
        return df.withColumn("last", F.col("mark.v")).withColumn("odd", (F.col("flips") - F.coalesce("mark.at", F.lit(0))) % 2).drop("mark", "flips")

    inner = states(base, ["file", "part"], "file_line")
    # what a whole stretch does is what its last line does after the state before it; how many records begin in it
    # is known but for the lines before its first constant, where it depends on the state at its start
    out_of = F.coalesce(F.col("const"), (F.col("last") + F.col("odd") + F.col("flip")) % 2)
    tail = F.max_by(F.struct(out_of.alias("const"), ((F.col("odd") + F.col("flip")) % 2).alias("odd")), "file_line")
    known = F.col("last").isNotNull()
    starts = inner.groupBy("file", "part").agg(
        tail.alias("t"), F.count(F.when(known & ((F.col("last") + F.col("odd")) % 2 == 0), 1)).alias("n"),
        F.count(F.when(~known & (F.col("odd") == 0), 1)).alias("n0"), F.count(F.when(~known & (F.col("odd") == 1), 1)).alias("n1"),
    ).select("file", "part", F.col("t.const").alias("const"), F.when(F.col("t.const").isNull(), F.col("t.odd")).otherwise(0).alias("flip"), "n", "n0", "n1")
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = states(starts, ["file"], "part").withColumn("enter", (F.coalesce("last", F.lit(0)) + F.col("odd")) % 2)
    begins = F.col("n") + F.when(F.col("enter") == 0, F.col("n0")).otherwise(F.col("n1"))
    starts = starts.select("file", "part", "enter", F.coalesce(F.sum(begins).over(before), F.lit(0)).alias("base"))
    at = inner.join(starts, ["file", "part"]).withColumn("begin", ((F.coalesce("last", "enter") + F.col("odd")) % 2 == 0).cast("int"))
    so_far = Window.partitionBy("file", "part").orderBy("file_line").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("record", F.col("base") + F.sum("begin").over(so_far))
    swallowed = None
    if most is not None:
        at = _written(at.select("file", "record", "file_line", "raw"))
        sizes = at.groupBy("file", "record").agg(F.sum(F.octet_length("raw") + len(d.row_sep.encode())).alias("bytes"), F.count("*").alias("n"), F.min("file_line").alias("first"))
        swallowed = _written(sizes.filter(F.col("bytes") > most))  # few rows, which Spark broadcasts by their size
        at = at.join(swallowed.select("file", "record"), ["file", "record"], "left_anti")
    whole = at.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("file_line", "raw"))).alias("l"))
    out = whole.select(
        "file", F.col("l")[0]["file_line"].alias("file_line"), (F.col("record") + first_record - 1).alias("csv_line"), F.size("l").alias("n_lines"),
        F.array_join(F.transform("l", lambda x: x["raw"]), d.row_sep).alias("raw"))
    if comment:
        out = out.filter(~((F.col("n_lines") == 1) & F.col("raw").rlike(comment)))
    out = out.withColumn("fields", tokenizer.fields(F.col("raw"), d))
    out = out.withColumn("status", F.when(F.col("fields").isNull(), "malformed").otherwise("ok"))
    if swallowed is None:
        return out
    return out.unionByName(swallowed.select(
        "file", F.col("first").alias("file_line"), (F.col("record") + first_record - 1).alias("csv_line"), F.col("n").cast("int").alias("n_lines"),
        F.lit(None).cast("string").alias("raw"), F.lit(None).cast("array<string>").alias("fields"), F.lit("malformed").alias("status")))


def _followed(told: DataFrame) -> DataFrame:
    """Lines with `closes`: whether the next quote in later lines that isn't doubled ends a field, as their `told` says.

    By a window from the end over each part; between parts by one row each.
    """
    first = F.min(F.when(F.col("told").isNotNull(), F.struct("file_line", "told")))["told"]
    later = Window.partitionBy("file").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = told.groupBy("file", "part").agg(first.alias("told")).select("file", "part", F.last("told", ignorenulls=True).over(later).alias("beyond"))
    back = Window.partitionBy("file", "part").orderBy(F.desc("file_line")).rowsBetween(Window.unboundedPreceding, -1)
    found = told.withColumn("closes", F.last("told", ignorenulls=True).over(back)).join(parts, ["file", "part"])
    return found.withColumn("closes", F.coalesce("closes", "beyond", F.lit(False))).drop("beyond")


def _written(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "records")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stitched(lines: DataFrame, d: Dialect, comment: str | None, limit: int | None = None) -> DataFrame:
    """Records that may span lines: one task a file, streaming through it. See SCHEMA."""
    pattern = re.compile(comment) if comment else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row for batch in batches
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        )
        for file, group in itertools.groupby(rows, key=lambda r: r[0]):
            first = next(group)
            texts = itertools.chain([first[2]], (r[2] for r in group))
            records = frame(texts, d, pattern, first[1], first[1], limit)
            while part := list(itertools.islice(records, 5000)):
                yield pa.RecordBatch.from_arrays([
                    pa.array([file] * len(part), pa.string()), pa.array([r.file_line for r in part], pa.int64()), pa.array([r.csv_line for r in part], pa.int64()),
                    pa.array([r.n_lines for r in part], pa.int32()), pa.array([r.raw for r in part], pa.string()),
                    pa.array([r.fields for r in part], pa.list_(pa.string())), pa.array([r.status for r in part], pa.string()),
                ], names=["file", "file_line", "csv_line", "n_lines", "raw", "fields", "status"])

    ordered = lines.select("file", "file_line", "raw").repartition("file").sortWithinPartitions("file", "file_line")
    return ordered.mapInArrow(run, SCHEMA)


def judge(records: DataFrame, width: int | None, field_size_limit: int | None) -> DataFrame:
    """Statuses of records beyond framing: `extra_columns` past `width`, `field_too_large` past the limit in bytes."""
    status: Column = F.col("status")
    if width is not None:
        status = F.when((status == "ok") & (F.size("fields") > width), "extra_columns").otherwise(status)
    if field_size_limit is not None:
        large = F.exists("fields", lambda x: F.octet_length(x) > field_size_limit)
        status = F.when((status == "ok") & large, "field_too_large").otherwise(status)
    return records.withColumn("status", status)

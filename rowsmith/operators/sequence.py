"""Dense row numbers and chunks in input order, from counts per stretch of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 100_000


def number(rows: DataFrame, file: str = "_file", line: str = "_line", into: str = "row_seq") -> DataFrame:
    """rows with their 1-based place in order of (file, line).

    Places inside a stretch of lines come from a window over it alone; stretches are summed up over one row each.
    """
    part = rows.withColumn("_part", F.floor(F.col(line) / STRETCH))
    place = F.row_number().over(Window.partitionBy(file, "_part").orderBy(line))
    counts = part.groupBy(file, "_part").agg(F.count("*").alias("_n"))
    in_file = Window.partitionBy(file).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    files = counts.groupBy(file).agg(F.sum("_n").alias("_of"))
    files = files.select(file, F.coalesce(F.sum("_of").over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(in_file), F.lit(0))).join(files, file).drop("_n")
    out = part.withColumn("_place", place).join(starts, [file, "_part"])
    return out.withColumn(into, (F.col("_base") + F.col("_before") + F.col("_place")).cast("long")).drop("_part", "_place", "_before", "_base")


def chunks(rows: DataFrame, size: int, seq: str = "row_seq", into: str = "chunk_index") -> DataFrame:
    """rows with the 0-based index of their chunk of `size` rows."""
    return rows.withColumn(into, F.floor((F.col(seq) - 1) / size).cast("long"))

"""Incremental imports: delimited files as they arrive, and chunks that survive a restart."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowsmith.sources.reader import parse_column


def _headless(sep: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Drops the first line of each file's first block where it is the header; a task reads a block in order."""
    plain = lambda x: x.replace('"', "").replace(" ", "").lower()
    want = plain(sep.join(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            drop = []
            for i, key in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if key != last and key[1] == 0 and plain(batch.column(0)[i].as_py().removeprefix("\ufeff")) == want:
                    drop.append(i)
                last = key
            keep = pc.invert(pc.is_in(pa.array(range(batch.num_rows), pa.int64()), value_set=pa.array(drop, pa.int64())))
            yield batch.filter(keep).select([0, 1])

    return run


def read_stream(
    spark: SparkSession, directory: str, names: list[str], header: bool = True, types: dict[str, str] | None = None,
    row_sep: str = "\n", status: str | None = None, max_files: int | None = None, **options: Any,
) -> DataFrame:
    """Rows of every file that arrives in a directory; for files whose records don't span lines.

    The first line of a file is taken for its header by its place at the file's beginning and its text.
    """
    source = spark.readStream.option("lineSep", row_sep)
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    lines = source.text(directory).select(F.col("value").alias("_line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = lines.mapInArrow(_headless(options.get("col_sep", ","), names), "_line string, file string") if header else lines.drop("_block")
    return parse_column(lines, "_line", names, keep=["file"], types=types, status=status, **options)


def import_chunks(
    rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True,
) -> StreamingQuery:
    """Calls handle(batch, index) for each micro-batch; a restart with the same checkpoint goes on where it stopped."""
    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

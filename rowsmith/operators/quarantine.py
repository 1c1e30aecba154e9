"""Bad rows: their records, and what happens when there are some."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.errors import FieldSizeLimitExceeded, HeaderSizeMismatch, MalformedCSV, RowsmithError, TooManyBadRows
from rowsmith.options import ReadOptions

#: Status of a record -> what it means.
ERRORS: dict[str, tuple[type[RowsmithError], str]] = {
    "malformed": (MalformedCSV, "a quoted field is still open at the end of the input"),
    "open": (MalformedCSV, "a quoted field is still open at the end of the line"),
    "extra_columns": (HeaderSizeMismatch, "the row has more fields than the header"),
    "field_too_large": (FieldSizeLimitExceeded, "a field is larger than field_size_limit"),
}


def bad_rows(records: DataFrame, raw: bool = True) -> DataFrame:
    """A row for each bad record, with where it is, what is wrong and, if asked for, its text."""
    names = F.create_map(*[F.lit(x) for k, (e, _) in ERRORS.items() for x in (k, e.__name__)])
    said = F.create_map(*[F.lit(x) for k, (_, m) in ERRORS.items() for x in (k, m)])
    columns = [
        F.col("file"), F.col("csv_line").alias("csv_line_number"), F.col("file_line").alias("file_line_number"),
        F.col("n_lines").cast("long").alias("file_lines_consumed"), names[F.col("status")].alias("error_class"), said[F.col("status")].alias("error_message"),
    ]
    if raw:
        columns.append(F.col("raw").alias("raw_logical_line"))
    return records.filter(F.col("status") != "ok").select(*columns)


def packed(records: DataFrame, raw: bool = True) -> DataFrame:
    """Bad records in input order, many to a row: compressed Arrow streams of what differs between them. See `unpack`."""
    names = ["file", "status", "file_line", "csv_line", "n_lines"] + ["raw"] * raw
    found = records.withColumn("raw", F.col("raw").cast("binary"))  # which may be no UTF-8
    found = found.filter(F.col("status") != "ok").select(*names).orderBy("file", "file_line")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            line, csv = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            columns = [
                batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode(),
                pa.array(np.diff(line, prepend=0)), pa.array(line - csv), *batch.columns[4:],  # steps and distances repeat themselves
            ]
            piece = pa.RecordBatch.from_arrays(columns, names=names)
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_batch(piece)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["rows"])

    return found.mapInArrow(pack, "rows binary")


def unpack(rows: bytes) -> Iterator[dict]:
    """The bad records of one row of `packed`, as those of `bad_rows`."""
    for batch in pa.ipc.open_stream(rows):
        line = 0
        for lo in range(0, batch.num_rows, 1000):
            for r in batch.slice(lo, 1000).to_pylist():
                line += r["file_line"]
                error, message = ERRORS[r["status"]]
                out = {
                    "file": r["file"], "csv_line_number": line - r["csv_line"], "file_line_number": line,
                    "file_lines_consumed": r["n_lines"], "error_class": error.__name__, "error_message": message,
                }
                if "raw" in r:
                    out["raw_logical_line"] = r["raw"] if r["raw"] is None else r["raw"].decode("utf-8", "replace")
                yield out


def enforce(records: DataFrame, counts: dict[str, int], options: ReadOptions) -> int:
    """Applies on_bad_row and bad_row_limit; returns the number of bad rows."""
    n = sum(k for s, k in counts.items() if s != "ok")
    if not n:
        return 0
    if options.on_bad_row == "raise":
        first = records.filter(F.col("status") != "ok").orderBy("file", "file_line").limit(1).first()
        error, message = ERRORS[first["status"]]
        raise error(f"{message} (line {first['file_line']})")
    if options.bad_row_limit is not None and n > options.bad_row_limit:
        raise TooManyBadRows(f"{n} bad rows, {options.bad_row_limit} allowed")
    if callable(options.on_bad_row):
        for piece in packed(records, options.collect_raw_lines).toLocalIterator():
            for row in unpack(piece["rows"]):
                options.on_bad_row(row)
    return n

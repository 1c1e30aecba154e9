"""Writing: rows to delimited lines as column expressions, to one file or a directory of parts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.errors import IncorrectOption, InvalidInputData
from rowsmith.options import WriteOptions


def needs_quotes(text: Column, o: WriteOptions) -> Column:
    """Whether a field has what makes it need quotes."""
    out = F.contains(text, F.lit(o.col_sep))
    for x in (o.row_sep, o.quote_char):
        out = out | F.contains(text, F.lit(x))
    return out


def never_quoted(df: DataFrame, name: str, o: WriteOptions) -> bool:
    """Whether a column's values, as numbers and the like, hold none of what makes a field need quotes."""
    if name not in df.columns or name in o.value_converters or "_all" in o.value_converters:
        return False
    kind = df.schema[name].dataType
    if not isinstance(kind, T.NumericType | T.BooleanType | T.DateType):
        return False
    written = set("0123456789+-.eEInfityNaruels") | set(o.write_nil_value) | set(o.write_empty_value)
    return not any(set(x) & written for x in (o.col_sep, o.row_sep, o.quote_char))


def quote(text: Column, o: WriteOptions, force: bool, never: bool = False) -> Column:
    """The field as it is written: quoted where it must be, inner quotes doubled."""
    q = o.quote_char
    wrapped = F.concat(F.lit(q), F.replace(text, F.lit(q), F.lit(q + q)), F.lit(q))
    if force:
        return wrapped
    return text if o.disable_auto_quoting or never else F.when(needs_quotes(text, o), wrapped).otherwise(text)


def quote_text(text: str, o: WriteOptions, force: bool) -> str:
    """`quote` for a header, on the driver."""
    q = o.quote_char
    if force or not o.disable_auto_quoting and any(x in text for x in (o.col_sep, o.row_sep, q)):
        return q + text.replace(q, q + q) + q
    return text


def header_line(columns: list[str], o: WriteOptions) -> str:
    shown = [o.map_headers.get(c, c) for c in columns]
    if o.header_converter:
        shown = [o.header_converter(c) for c in shown]
    return o.col_sep.join(quote_text(str(c), o, o.force_quotes or o.quote_headers) for c in shown)


def columns_of(df: DataFrame, o: WriteOptions) -> list[str]:
    """Columns in the order written: given ones (also those that df lacks), or mapped ones, or df's own."""
    if o.headers:
        more = [c for c in df.columns if c not in o.headers] if o.discover_headers else []
        return [*o.headers, *more]
    if o.map_headers and not o.discover_headers:
        return list(o.map_headers)
    return df.columns


def value(df: DataFrame, name: str, o: WriteOptions) -> Column:
    """A column as text: converters (its own, then `_all` with name and value), null and empty substitutes."""
    c = F.col(f"`{name}`") if name in df.columns else F.lit("")
    if name in o.value_converters:
        c = o.value_converters[name](c)
    if "_all" in o.value_converters:
        c = o.value_converters["_all"](F.lit(name), c)
    text = F.coalesce(c.cast("string"), F.lit(o.write_nil_value))
    return F.when(text == "", F.lit(o.write_empty_value)).otherwise(text) if o.write_empty_value else text


def lines(df: DataFrame, **options: Any) -> DataFrame:
    """One column `value`: each row as a line, without header and separator."""
    o = WriteOptions.of(**options)
    return df.select(F.concat_ws(o.col_sep, *[quote(value(df, c, o), o, o.force_quotes, never_quoted(df, c, o)) for c in columns_of(df, o)]).alias("value"))


def flatten(items: Any) -> list[dict]:
    """Dictionaries of arbitrarily nested lists; None is nothing."""
    if items is None:
        return []
    if isinstance(items, dict):
        return [items]
    if isinstance(items, Iterable) and not isinstance(items, str | bytes):
        return [x for item in items for x in flatten(item)]
    raise InvalidInputData(f"neither a row nor a list of rows: {type(items).__name__}")


def frame_of(spark: SparkSession, rows: Any) -> DataFrame:
    """In-memory rows (dictionaries, nested lists of them) as a DataFrame of text; columns in order of first sight."""
    found = flatten(rows)
    names = list(dict.fromkeys(str(k) for r in found for k in r))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r.get(n)) for n in names) for r in ({str(k): v for k, v in r.items()} for r in found)], schema)


def from_maps(df: DataFrame, column: str) -> DataFrame:
    """Rows held as maps, as columns: keys in order of their first place in any row, then of name."""
    keys = df.select(F.posexplode(F.map_keys(column)).alias("p", "k")).groupBy("k").agg(F.min("p").alias("p")).orderBy("p", "k")
    names = [r["k"] for r in keys.collect()]  # as many as the header has columns
    return df.select(*[F.col(column).getItem(n).cast("string").alias(n) for n in names])


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _headed(body: DataFrame, head: str) -> DataFrame:
    """Lines with `head` before those of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    return body.mapInArrow(run, "value string")


def _part_number(name: str) -> tuple[int, str]:
    found = re.match(r"part-(\d+)", name)
    return (int(found[1]) if found else 0, name)


def write(df: DataFrame, path: str, single: bool = True, order: list[str] | None = None, append: bool = False, **options: Any) -> None:
    """Writes df. With `single`, to exactly one file at `path`: parts are written in parallel beside it, joined stream
    by stream in the rows' order into a file beside it, which then takes its name, so nobody sees half of it. With
    `append`, behind what the file holds, and without a header then. Without `single`, to a directory of parts (more of
    them with `append`), each with its header."""
    o = WriteOptions.of(**options)
    spark = df.sparkSession
    if order:
        df = df.orderBy(*order)
    head = header_line(columns_of(df, o), o) if o.write_headers else None
    body = lines(df, **options)
    encoding = (o.encoding or "utf-8").split(":")[0]
    plain = encoding.lower().replace("_", "-") in ("utf-8", "utf8")
    mark = "\ufeff" if o.write_bom else ""
    if not single:
        if not plain:
            raise IncorrectOption("a directory of parts is written in UTF-8; other encodings need single=True")
        if mark and head is None:
            raise IncorrectOption("in a directory of parts, write_bom needs write_headers")
        body = body if head is None else _headed(body, mark + head)
        body.write.mode("append" if append else "overwrite").option("lineSep", o.row_sep).text(path)
        return
    jvm, target, fs = _hadoop(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}"
    body.write.mode("overwrite").option("lineSep", o.row_sep).text(f"{beside}.parts")
    _, parts, _ = _hadoop(spark, f"{beside}.parts")
    _, whole, _ = _hadoop(spark, f"{beside}.whole")
    found = sorted((s.getPath().getName() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-")), key=_part_number)
    old = append and fs.exists(target) and fs.getFileStatus(target).getLen() > 0
    start = "" if old else mark + (head + o.row_sep if head is not None else "")
    out = fs.create(whole, True)
    try:
        if old:
            source = fs.open(target)
            jvm.org.apache.commons.io.IOUtils.copyLarge(source, out)
            source.close()
        if start:
            out.write(bytearray(start.encode(encoding)))
        for name in found:
            source = fs.open(jvm.org.apache.hadoop.fs.Path(parts, name))
            if plain:
                jvm.org.apache.commons.io.IOUtils.copyLarge(source, out)
            else:
                reader = jvm.java.io.InputStreamReader(source, "UTF-8")
                sink = jvm.java.io.OutputStreamWriter(out, encoding)
                jvm.org.apache.commons.io.IOUtils.copyLarge(reader, sink)
                sink.flush()
            source.close()
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(whole, target):
        raise OSError(f"could not rename {whole} to {path}")
    fs.delete(parts, True)


def to_csv_string(df: DataFrame, **options: Any) -> str:
    """The whole output as a string; for results that fit the driver."""
    o = WriteOptions.of(**options)
    head = [header_line(columns_of(df, o), o)] if o.write_headers else []
    body = [r["value"] for r in lines(df, **options).toLocalIterator()]
    return ("﻿" if o.write_bom else "") + "".join(x + o.row_sep for x in [*head, *body])


class Writer:
    """Collects rows (`<<` or add) and writes them on finalize; also a context manager."""

    def __init__(self, spark: SparkSession, path: str | None = None, append: bool = False, **options: Any) -> None:
        self.spark, self.path, self.append, self.options, self.frames, self.rows = spark, path, append, options, [], []
        WriteOptions.of(**options)

    def add(self, data: Any) -> Writer:
        if isinstance(data, DataFrame):
            self._flush()
            self.frames.append(data)
        else:
            self.rows += flatten(data)
        return self

    __lshift__ = add

    def _flush(self) -> None:
        if self.rows:
            self.frames.append(frame_of(self.spark, self.rows))
            self.rows = []

    def finalize(self) -> str | None:
        """Writes to the path, or returns the text without one."""
        self._flush()
        df = self.frames[0] if self.frames else self.spark.createDataFrame([], T.StructType([]))
        for more in self.frames[1:]:
            df = df.unionByName(more, allowMissingColumns=True)
        if self.path is None:
            return to_csv_string(df, **self.options)
        write(df, self.path, append=self.append, **self.options)
        return None

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.finalize()


def generate(spark: SparkSession, rows: Any, path: str | None = None, **options: Any) -> str | None:
    """Rows (a DataFrame, dictionaries, or a function that is given a Writer) to text or to a file."""
    w = Writer(spark, path, **options)
    if callable(rows):
        rows(w)
    else:
        w.add(rows)
    return w.finalize()

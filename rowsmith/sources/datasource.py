"""`spark.read.format("rowsmith")`: a Python data source over the reader's framing, a partition a file.

Plain functions (`rowsmith.read`) prune columns and split files; this form is for SQL and for callers that can
only name a format. Bad rows raise, unless `on_bad_row` is skip; `collect` has nowhere to put them and is refused, as is
`bad_row_limit`, which no partition can count alone. Values are cast to the schema given, and one that doesn't fit is
null, as in Spark's own sources; without a schema every column is text. Paths and globs are of any store that Arrow knows.
"""

from __future__ import annotations

import codecs
import fnmatch
import os
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, DataType, DecimalType, FractionalType, IntegralType, StringType, StructField, StructType

from rowsmith.errors import ValidationError
from rowsmith.functions.dialect import Dialect, frame
from rowsmith.operators.quarantine import ERRORS
from rowsmith.options import ReadOptions
from rowsmith.plans import header
from rowsmith.sources import sniff


#: Names that Hadoop has for stores which Arrow knows by others.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    scheme, colon, rest = path.partition("://")
    if not colon:
        return pa.fs.LocalFileSystem(), os.path.abspath(path)
    return pa.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def _files(path: str) -> list[tuple[pa.fs.FileSystem, str]]:
    """The files of a path, a directory or a glob, in order of name; hidden ones are left out."""
    fs, where = _store(path)
    if not any(c in where for c in "*?["):
        info = fs.get_file_info(where)
        if info.type != pa.fs.FileType.Directory:
            return [(fs, where)]
        pattern, root = f"{where.rstrip('/')}/*", where
    else:
        pattern, root = where, re.split(r"[*?\[]", where)[0].rpartition("/")[0]
    depth = pattern.count("/")
    found = fs.get_file_info(pa.fs.FileSelector(root, allow_not_found=True, recursive=depth > root.count("/") + 1))
    names = [i.path for i in found if i.type == pa.fs.FileType.File and i.path.count("/") == depth and fnmatch.fnmatch(i.path, pattern) and i.base_name[0] not in "._"]
    return [(fs, x) for x in sorted(names)]


def _text(fs: pa.fs.FileSystem, path: str, encoding: str) -> Iterator[str]:
    """The file's text in pieces, decompressed by its suffix."""
    decode = codecs.getincrementaldecoder(encoding)("replace").decode
    with fs.open_input_stream(path) as f:
        while part := f.read(1 << 20):
            yield decode(part)
        yield decode(b"", True)


def _open(fs: pa.fs.FileSystem, path: str, options: dict) -> tuple[ReadOptions, str, str, list[str | None], int]:
    given = {k: v for k, v in options.items() if k in ReadOptions.__dataclass_fields__}
    if given.get("on_bad_row", "raise") not in ("raise", "skip"):
        raise ValidationError("format rowsmith: on_bad_row must be raise or skip")
    if "bad_row_limit" in given:
        raise ValidationError("format rowsmith: bad_row_limit is not supported")
    for k in ("skip_lines", "field_size_limit"):
        if k in given:
            given[k] = int(given[k])
    o = ReadOptions.of(**given)
    text = _text(fs, path, o.file_encoding)
    sample = next(text, "").removeprefix("\ufeff")
    first = sample[:65536]
    row_sep = sniff.row_sep(first, o, lambda *a: None) if o.row_sep == "auto" else o.row_sep
    # the sniffed beginning may end before the header does
    while first.count(row_sep) <= (o.skip_lines or 0) and len(first) < len(sample):
        first = sample
    while first.count(row_sep) <= (o.skip_lines or 0) and (part := next(text, None)) is not None:
        first += part
    rest = first.split(row_sep)[o.skip_lines or 0 :]
    sep = sniff.col_sep(row_sep.join(rest), o, row_sep) if o.col_sep == "auto" else o.col_sep
    names = header.names_of(rest[0] if rest and rest[0] else None, o, sep)
    return o, row_sep, sep, names, (o.skip_lines or 0) + 1


def _cast(text: str | None, kind: DataType) -> Any:
    """A field as a value of the schema's type, or None where it isn't one."""
    if text is None or isinstance(kind, StringType):
        return text
    text = text.strip()
    try:
        if isinstance(kind, IntegralType):
            return pa.scalar(int(text), to_arrow_type(kind)).as_py()
        if isinstance(kind, DecimalType):
            value = Decimal(text).quantize(Decimal(1).scaleb(-kind.scale), ROUND_HALF_UP)
            return value if len(value.as_tuple().digits) <= kind.precision else None
        if isinstance(kind, FractionalType):
            return float(text)
        if isinstance(kind, BooleanType):
            return {"true": True, "t": True, "yes": True, "y": True, "1": True, "false": False, "f": False, "no": False, "n": False, "0": False}.get(text.lower())
        return pc.cast(pa.scalar(text), to_arrow_type(kind)).as_py()
    except (ValueError, OverflowError, InvalidOperation, pa.ArrowException):
        return None


class RowsmithSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rowsmith"

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(self.options["path"])
        names = _open(*files[0], dict(self.options))[3]
        return StructType([StructField(n, StringType()) for n in names if n is not None])

    def reader(self, schema: StructType) -> DataSourceReader:
        return RowsmithReader(schema, dict(self.options))


class RowsmithReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        # names only: a store's handle stays where it was made
        scheme, colon, _ = self.options["path"].partition("://")
        return [InputPartition(f"{scheme}://{p}" if colon else p) for _, p in _files(self.options["path"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, path = _store(partition.value)
        o, row_sep, sep, names, skip = _open(fs, path, self.options)
        fields = [(names.index(f.name), f.dataType) for f in self.schema.fields]

        def lines() -> Iterator[str]:
            rest = ""
            for part in _text(fs, path, o.file_encoding):
                *whole, rest = (rest + part).split(row_sep)
                yield from whole
            if rest:
                yield rest

        body = lines()
        for _ in range(skip):
            next(body, None)
        comment = re.compile(o.comment_regexp) if o.comment_regexp else None
        for r in frame(body, Dialect.of(o, sep, row_sep), comment, skip + 1, skip + 1, o.field_size_limit):
            status = r.status
            if status == "ok" and o.missing_headers == "raise" and len(r.fields) > len(names):
                status = "extra_columns"
            elif status == "ok" and o.field_size_limit is not None and any(len(x.encode()) > o.field_size_limit for x in r.fields):
                status = "field_too_large"
            if status != "ok":
                if o.on_bad_row == "raise":
                    error, message = ERRORS[status]
                    raise error(f"{message} ({partition.value}, line {r.file_line})")
            elif any(x.strip() for x in r.fields):
                yield tuple(_cast((r.fields[i] or None) if i < len(r.fields) else None, kind) for i, kind in fields)


def register(spark) -> None:
    """Makes `spark.read.format("rowsmith")` and `CREATE TEMPORARY VIEW ... USING rowsmith` known."""
    spark.dataSource.register(RowsmithSource)

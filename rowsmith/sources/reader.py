"""Reading: dialect, header, records, quarantine and values, put together."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.errors import IncorrectOption
from rowsmith.functions import tokenizer
from rowsmith.functions import values as V
from rowsmith.functions.dialect import Dialect, frame
from rowsmith.operators import quarantine, records, sequence
from rowsmith.options import DEFAULT_CHUNK, ReadOptions, log
from rowsmith.plans import header, infer
from rowsmith.sources import lines, sniff
from rowsmith.sources.scratch import drop, scratch

FILE, LINE = "_file", "_line"
#: What this thread's latest reader said: `last_warnings()`, `last_errors()`.
_last = threading.local()


def last_warnings() -> list[dict]:
    return getattr(_last, "warnings", [])


def last_errors() -> DataFrame | None:
    return getattr(_last, "errors", None)


def select_names(names: list[str | None], options: ReadOptions) -> list[str]:
    """Names that `headers` keeps, in column order; unknown ones are ignored."""
    chosen = options.headers or {}
    kept = [n for n in names if n is not None]
    if "only" in chosen:
        return [n for n in kept if n in chosen["only"]]
    return [n for n in kept if n not in chosen.get("except", [])]


class CsvReader:
    """One input under one set of options. Opening it settles dialect and header; rows come as a DataFrame.

    Several files of a glob share the first one's dialect and header, and each has its own header line and preamble.
    What is written to the shared folder on the way (a row a file block, records that span lines, a copy of a stream) is
    there for as long as the rows are read; `close`, or leaving a `with` block, deletes it.
    """

    def __init__(self, spark: SparkSession, path: Any = None, text: str | None = None, **options: Any) -> None:
        self.spark, self.input = spark, path if text is None else text
        self._made: list[str] = []
        self.options = ReadOptions.of(**options)
        self.warnings: list[dict] = list(self.options.warnings)
        if hasattr(path, "read"):  # an open stream, seekable or not
            stream, path = path, self._scratch("input")
            lines.spool(spark, stream, path)
            self._check_mode(stream)
        self.errors: DataFrame | None = None
        self.bad_row_count = 0
        if text is None:
            data, self.files, self.file_size = lines.head(spark, path)
        else:
            data, self.files, self.file_size = text.encode(), [], len(text.encode())
        self._text = text
        encoding, skip = sniff.mark(data)
        if encoding and encoding != "utf-8" and lines.is_utf8(self.options):
            self.options.file_encoding = encoding
        decode = lines.decoder(self.options)
        sample, size = decode(data[skip:]), lines.MAX_SNIFF

        def more() -> str | None:
            """A longer beginning of the first file, or None where there is no more."""
            nonlocal data, size
            if text is not None or len(data) < size:
                return None
            size *= 4
            data = lines.head(spark, path, size)[0]
            return decode(data[skip:])

        self._open(sample, more)
        self._rows: DataFrame | None = None
        self.chunk_count = 0
        _last.warnings, _last.errors = self.warnings, None

    def _warn(self, code: str, message: str) -> None:
        for w in self.warnings:
            if w["code"] == code:
                w["count"] += 1
                return
        self.warnings.append({"type": "row_sep", "code": code, "severity": "error", "message": message, "count": 1})
        if self.options.verbose != "quiet":
            log.warning(message)

    def _scratch(self, name: str) -> str:
        self._made.append(scratch(self.spark, name))
        return self._made[-1]

    def close(self) -> None:
        """Deletes what this reader wrote; its rows can't be read any more then."""
        for path in self._made:
            drop(self.spark, path)
        self._made.clear()

    def __enter__(self) -> CsvReader:
        return self

    def __exit__(self, *error: Any) -> None:
        self.close()

    def _check_mode(self, stream: Any) -> None:
        """A stream of text was decoded by whoever opened it, so the declared encoding doesn't apply; UTF-8 is expected."""
        said = getattr(stream, "encoding", None)
        if not said:
            return
        if lines.is_utf8(self.options) and said.lower().replace("_", "-") not in ("utf-8", "utf8"):
            self._warn("utf8_missing_binary_mode", f"the input is taken as UTF-8, but was opened as text in {said}; open it in binary mode")
        self.options.file_encoding = "utf-8"

    def _open(self, sample: str, more: Callable[[], str | None]) -> None:
        o = self.options
        self.row_sep = sniff.row_sep(sample, o, self._warn) if o.row_sep == "auto" else o.row_sep
        parts = sample.split(self.row_sep)
        skip = o.skip_lines or 0
        # the sniffed beginning may end before the header does
        while len(parts) < skip + 1 + bool(o.headers_in_file) and (longer := more()) is not None:
            parts = longer.split(self.row_sep)
        rest = parts[skip:]
        self.raw_header = (rest[0] if rest and (rest[0] or len(rest) > 1) else None) if o.headers_in_file else None
        self.col_sep = sniff.col_sep(self.row_sep.join(rest), o, self.row_sep) if o.col_sep == "auto" else o.col_sep
        self.file_headers = header.names_of(self.raw_header, o, self.col_sep)
        self.dialect = Dialect.of(o, self.col_sep, self.row_sep)
        self.preamble = skip + bool(o.headers_in_file)

    @property
    def headers(self) -> list[str]:
        return select_names(self._names if self._rows is not None else self.file_headers, self.options)

    def _records(self) -> DataFrame:
        o = self.options
        if self._text is not None:
            found = self._text.removeprefix("﻿").split(self.row_sep)
            if found and not found[-1]:
                found.pop()
            comment = re.compile(o.comment_regexp) if o.comment_regexp else None
            n = self.preamble
            rows = [("", r.file_line, r.csv_line, r.n_lines, r.raw, r.fields, r.status) for r in frame(found[n:], self.dialect, comment, n + 1, n + 1, o.field_size_limit)]
            return self.spark.createDataFrame(rows, records.SCHEMA)
        data = lines.read(self.spark, self.files, o, self.row_sep, self._made).filter(F.col("file_line") > self.preamble)
        alone = self._judged(records.single(data, self.dialect, o.comment_regexp))
        # one pass decides whether lines may be read independently, how wide the widest is, and of which types columns are
        self._shape = self._survey(alone)
        if "open" not in self._shape.statuses:
            return alone
        doubts = self._shape.doubled or bool(o.comment_regexp)  # of comments, which may be text inside quotes, nothing is known
        self._shape = None
        most = records.MOST_BYTES if self.file_size > records.MOST_BYTES else None
        framed = records.joined(data, self.dialect, o.comment_regexp, self.preamble + 1, most=most, doubts=doubts)
        # framing shuffles, and width, types and rows all need it: it is done once
        path = self._scratch("records")
        framed.write.parquet(path)
        found = self.spark.read.schema(records.SCHEMA).parquet(path)
        if o.field_size_limit is not None:
            # a record that grows past the limit ends there, and what follows is read anew, in these files
            long = found.filter((F.col("n_lines") > 1) & (F.coalesce(F.octet_length("raw"), F.lit(2**31 - 1)) > o.field_size_limit)).select("file").distinct()
            if not long.isEmpty():
                again = records.stitched(data.join(long, "file", "left_semi"), self.dialect, o.comment_regexp, o.field_size_limit)
                found = found.join(long, "file", "left_anti").unionByName(again)
        return self._judged(found)

    def _judged(self, found: DataFrame) -> DataFrame:
        o = self.options
        return records.judge(found, len(self.file_headers) if o.missing_headers == "raise" else None, o.field_size_limit)

    def _survey(self, found: DataFrame, names: dict[int, str] | None = None) -> infer.Shape:
        """What all records look like, and the facts of columns (by place; the header's, if none are given) whose types are inferred."""
        o = self.options
        if names is None:
            names = dict(enumerate(self.file_headers))
        kept = select_names(list(names.values()), o) if o.typing == "column" else []
        cells = {n: V.clean(F.get("fields", F.lit(i)), o) for i, n in names.items() if n in kept and n not in (o.schema or {})}
        return infer.survey(found, cells, o)

    def dataframe(self) -> DataFrame:
        """Typed rows; absent values are null. Evaluates what needs a look at all rows: width, types, bad rows."""
        if self._rows is None:
            self._build()
        hidden = {FILE, LINE} | (set() if self.options.with_line_numbers else {"csv_line_number"})
        return self._rows.drop(*hidden)

    def _build(self) -> None:
        o = self.options
        self._shape = None
        found = self._records()
        if self._text is not None:
            found = self._judged(found)
        shape = self._shape or self._survey(found)
        self.bad_row_count = quarantine.enforce(found, shape.statuses, o)
        self.errors = _last.errors = quarantine.bad_rows(found, o.collect_raw_lines)
        self._found = found
        names = list(self.file_headers) + [header.extra_name(i, o) for i in range(len(self.file_headers), shape.width)]
        self._names = names
        kept = select_names(names, o)

        def wanted(f: Column) -> Column:
            ok = F.col("status") == "ok"
            return ok & F.exists(f, lambda x: ~V.is_blank(x)) if o.remove_empty_hashes else ok

        good = found.select("file", "file_line", "csv_line", tokenizer.where(F.col("fields"), wanted).alias("fields"))
        cleaned = good.select(
            F.col("file").alias(FILE), F.col("file_line").alias(LINE), F.col("csv_line").alias("csv_line_number"),
            *[V.clean(F.get("fields", F.lit(i)), o).alias(n) for i, n in enumerate(names) if n in kept],
        )
        cell = lambda n: F.col(f"`{n}`")
        if o.typing == "column":
            facts = shape.facts
            if len(names) > len(self.file_headers):  # columns that only rows wider than the header showed
                facts = facts | self._survey(found, {i: n for i, n in enumerate(names) if i >= len(self.file_headers)}).facts
            kinds, lost = infer.types(facts, [n for n in kept if n not in (o.schema or {})], o)
            for n in lost:
                self._warn("numeric_overflow", f"numbers of column {n} fit no decimal type")
        else:
            kinds = dict.fromkeys(kept, "cell" if o.typing == "cell" else "string")
        kinds |= o.schema or {}
        rows = cleaned.select(FILE, LINE, *[V.convert(cell(n), n, kinds[n], o).alias(n) for n in kept], "csv_line_number")
        if o.remove_empty_hashes and kept:
            rows = rows.filter(_any_present(kept))
        self.types = kinds
        self._rows = rows

    @property
    def csv_line_count(self) -> int:
        """Logical lines, the header among them."""
        self.dataframe()
        return self.preamble + self._found.count()

    @property
    def file_line_count(self) -> int:
        """Physical lines up to the end of the last record."""
        self.dataframe()
        return self._found.agg(F.max(F.col("file_line") + F.col("n_lines") - 1)).first()[0] or self.preamble

    def sparse(self, into: str = "row") -> DataFrame:
        """One map column a row: name to value (VARIANT), only of what is present."""
        df = self.dataframe()
        pairs = [x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`").cast("variant"))]
        return df.select(F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias(into))

    def sequenced(self) -> DataFrame:
        """The rows with row_seq, their 1-based place in the input."""
        self.dataframe()
        hidden = {FILE, LINE} | (set() if self.options.with_line_numbers else {"csv_line_number"})
        return sequence.number(self._rows, FILE, LINE).drop(*hidden)

    def chunked(self, size: int | None = None) -> DataFrame:
        """The rows with row_seq and chunk_index."""
        size = size or self.options.chunk_size or DEFAULT_CHUNK
        return sequence.chunks(self.sequenced(), size)

    def each(self) -> Iterator[dict]:
        """Rows in input order as dictionaries of what is present, a partition at a time."""
        self.dataframe()
        hidden = {FILE, LINE} | (set() if self.options.with_line_numbers else {"csv_line_number"})
        for row in self._rows.orderBy(FILE, LINE).toLocalIterator(prefetchPartitions=True):
            kept = {k: v for k, v in row.asDict().items() if k not in hidden}
            yield {k: v for k, v in kept.items() if v is not None} if self.options.remove_empty_values else kept

    __iter__ = each

    def each_chunk(self, size: int | None = None) -> Iterator[tuple[list[dict], int]]:
        """(rows, 0-based index) of consecutive chunks."""
        size = size or self.options.chunk_size
        if size is None:
            self._warn("chunk_size_default", f"chunk_size is not set; using {DEFAULT_CHUNK}")
            size = DEFAULT_CHUNK
        if size < 1:
            raise ValueError("chunk_size must be at least 1")
        part, index = [], 0
        for row in self.each():
            part.append(row)
            if len(part) == size:
                yield part, index
                part, index = [], index + 1
        if part:
            yield part, index

    def process(self, block: Callable[[list[dict], int], Any] | None = None) -> Any:
        """With a block: calls it with each chunk (of one row without chunk_size) and returns how many there were.
        Without: the rows, or the chunks with chunk_size. Hooks fire around either."""
        o = self.options
        began = time.monotonic()
        if o.on_start:
            o.on_start({"input": self.input, "file_size": self.file_size, "col_sep": self.col_sep, "row_sep": self.row_sep})
        out: list = []
        n_chunks = n_rows = 0
        for part, index in self.each_chunk(o.chunk_size or 1):
            n_chunks += 1
            n_rows += len(part)
            if o.on_chunk and o.chunk_size:
                o.on_chunk({"chunk_number": index + 1, "rows_in_chunk": len(part), "total_rows_so_far": n_rows})
            if block:
                block(part, index)
            else:
                out += [part] if o.chunk_size else part
        if o.on_complete:
            o.on_complete({"total_rows": n_rows, "total_chunks": n_chunks, "duration": time.monotonic() - began, "bad_rows": self.bad_row_count})
        self.chunk_count = n_chunks
        return n_chunks if block else out


def _any_present(names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.col(f"`{n}`").isNotNull()
    return out


def read(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """A delimited file, directory or glob as a DataFrame of typed rows."""
    return CsvReader(spark, path, **options).dataframe()


def parse(spark: SparkSession, text: str, **options: Any) -> DataFrame:
    """Delimited text that is already in memory."""
    return CsvReader(spark, text=text, **options).dataframe()


def parse_column(
    df: DataFrame, column: str, names: list[str], keep: list[str] | None = None, types: dict[str, str] | None = None,
    status: str | None = None, drop_blank: bool = True, **options: Any,
) -> DataFrame:
    """Records held in a string column, one a row, as columns `names`, beside the columns `keep` of df.

    All of it is column expressions: nothing leaves the JVM and unused fields are pruned. Types are given, not
    inferred. With `status`, bad records stay, with that column telling why; without, the first of them that is met
    fails the query, or with `on_bad_row="skip"` they are dropped.
    """
    o = ReadOptions.of(**({"col_sep": ",", "user_provided_headers": names, "headers_in_file": False} | options))
    if not status and o.on_bad_row not in ("raise", "skip"):
        raise IncorrectOption("parse_column: on_bad_row must be raise or skip; give `status` to keep bad records")
    d = Dialect.of(o, o.col_sep)
    keep = keep or []
    hidden = [F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)]
    raw = df.select(*hidden, F.col(f"`{column}`").alias("_raw"))
    if o.comment_regexp:
        raw = raw.filter(~F.col("_raw").rlike(o.comment_regexp))
    hidden = [f"_keep{i}" for i in range(len(keep))]

    def state(f: Column) -> Column:
        out = F.when(f.isNull(), "malformed")
        if o.missing_headers == "raise":
            out = out.when(F.size(f) > len(names), "extra_columns")
        if o.field_size_limit is not None:
            out = out.when(F.exists(f, lambda x: F.octet_length(tokenizer.cell(x, d)) > o.field_size_limit), "field_too_large")
        return out.otherwise("ok")

    def wanted(f: Column) -> Column:
        ok = F.lit(True) if status else state(f) == "ok"
        if not status and o.on_bad_row == "raise":
            ok = ok | F.raise_error(F.concat(F.lit("bad row ("), state(f), F.lit(") in column "), F.lit(column))).cast("boolean")
        if not (o.remove_empty_hashes and drop_blank):
            return ok
        some = F.exists(f, lambda x: ~V.is_blank(x) & ((F.instr(x, d.quote) == 0) | ~V.is_blank(tokenizer.cell(x, d))))
        return ok & (F.coalesce(some, F.lit(True)) if status else some)

    split = raw.select(*hidden, tokenizer.where(tokenizer.raw_fields(F.col("_raw"), d), wanted).alias("_f"))
    if status:
        split = split.withColumn("_s", state(F.col("_f")))
    mapped = header.remap(names, o)
    kept = select_names(mapped, o)
    kinds = types or {}
    cell = lambda i: V.clean(tokenizer.cell(F.get("_f", F.lit(i)), d), o)
    out = [V.convert(cell(i), n, kinds.get(n), o).alias(n) for i, n in enumerate(mapped) if n in kept]
    more = [F.col("_s").alias(status)] if status else []
    return split.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], *out, *more)


def parse_documents(
    df: DataFrame, column: str, key: str, names: list[str], types: dict[str, str] | None = None, header: bool = True,
    row_sep: str = "\n", **options: Any,
) -> DataFrame:
    """Whole delimited texts held in a string column, each named by `key`, as their rows: key, csv_line_number, names.

    One text gives many rows; records may span lines. Texts under one key are read as one after the other only if
    the key is unique, so it has to be.
    """
    o = ReadOptions.of(**({"col_sep": ",", "quote_escaping": "double_quotes", "user_provided_headers": names, "headers_in_file": header} | options))
    d = Dialect.of(o, o.col_sep, row_sep)
    parts = F.posexplode(F.split(F.regexp_replace(f"`{column}`", tokenizer.java(row_sep) + r"\z", ""), tokenizer.java(row_sep), -1))
    skip = (o.skip_lines or 0) + header
    lines_ = df.select(F.col(f"`{key}`").cast("string").alias("file"), parts.alias("p", "raw")).withColumn("file_line", F.col("p").cast("long") + 1)
    lines_ = lines_.filter(F.col("file_line") > skip).select("file", "file_line", "raw")
    # a text is taken apart where it is: its lines stay in one stretch
    framed = records.joined(lines_, d, o.comment_regexp, skip + 1, stretch=1 << 40)
    state = records.judge(framed, len(names) if o.missing_headers == "raise" else None, o.field_size_limit)

    def wanted(f: Column) -> Column:
        ok = F.col("status") == "ok"
        return ok & F.exists(f, lambda x: ~V.is_blank(x)) if o.remove_empty_hashes else ok

    good = state.select("file", "csv_line", tokenizer.where(F.col("fields"), wanted).alias("fields"))
    cells = [V.convert(V.clean(F.get("fields", F.lit(i)), o), n, (types or {}).get(n), o).alias(n) for i, n in enumerate(names)]
    kind = dict(df.dtypes)[key]
    return good.select(F.col("file").cast(kind).alias(key), F.col("csv_line").alias("csv_line_number"), *cells)

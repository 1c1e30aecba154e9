"""Queries for what the reader and the writer do beside returning rows (errors, warnings, callbacks, chunks, streams
in memory), and for Spark's own operators over parsed rows; registered with those of `rowsmith.queries`."""

from __future__ import annotations

import gzip
import io
from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

import rowsmith
from rowsmith import errors as E
from rowsmith.functions import converters as C
from rowsmith.functions import tokenizer
from rowsmith.functions.dialect import Dialect
from rowsmith.operators import writer
from rowsmith.queries import _bad_file, file_of, query, raw_file, text_of
from rowsmith.sources import datasource, lines
from rowsmith.sources.reader import CsvReader, last_errors, last_warnings, parse_column
from rowsmith.sources.scratch import scratch
from rowsmith.streaming.stream import import_chunks, read_stream


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


class _Pieces:
    """Rows that the driver comes by one after the other, written to the shared folder a piece at a time."""

    def __init__(self, spark: SparkSession, schema: str, size: int = 100_000) -> None:
        self.spark, self.size, self.path = spark, size, scratch(spark, "rows")
        self.schema = spark.createDataFrame([], schema).schema
        self.rows: list[tuple] = []
        self.n = 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        if len(self.rows) == self.size:
            self._write()

    def _write(self) -> None:
        kinds = to_arrow_schema(self.schema)
        columns = list(zip(*self.rows, strict=True)) or [()] * len(kinds)
        out = io.BytesIO()
        pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds), out)
        out.seek(0)
        lines.spool(self.spark, out, f"{self.path}/part-{self.n:06d}.parquet")
        self.rows, self.n = [], self.n + 1

    def __enter__(self) -> _Pieces:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None and (self.rows or not self.n):
            self._write()

    def dataframe(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def _error(f: Callable[[], object]) -> str:
    """The name of the error that f raises, or what it returns."""
    try:
        return str(f())
    except E.RowsmithError as e:
        return type(e).__name__


def parsed(t, table: str, types: dict[str, str]) -> DataFrame:
    """Columns of a table, written as delimited text and parsed again."""
    names = list(types)
    return parse_column(text_of(t(table), *names), "value", names, types={k: v for k, v in types.items() if v != "string"})


# --- entry points, streams in memory, encodings -------------------------------------------------------------


def _nation_text(t) -> str:
    return writer.to_csv_string(t("nation").select("n_nationkey", "n_name").orderBy("n_nationkey"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def each_row(spark, t):
    """Rows one after the other, as dictionaries."""
    path = file_of(spark, t("nation").select("n_nationkey", "n_name"), "n.csv")
    return _rows(spark, [(r["n_nationkey"], r["n_name"]) for r in CsvReader(spark, path).each()], "n_nationkey long, n_name string")


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1) // 7 AS chunk, n_nationkey::BIGINT AS n_nationkey FROM nation")
def each_chunk_rows(spark, t):
    """Chunks of a given size, with their index, in input order."""
    path = file_of(spark, t("nation").select("n_nationkey").orderBy("n_nationkey"), "n.csv")
    got = [(i, r["n_nationkey"]) for part, i in CsvReader(spark, path, col_sep=",").each_chunk(7) for r in part]
    return _rows(spark, got, "chunk long, n_nationkey long")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def open_bytes(spark, t):
    """An open stream of bytes, which can't be rewound."""

    class Once(io.BytesIO):
        def seekable(self):
            return False

        def seek(self, *a):
            raise OSError("not seekable")

    return CsvReader(spark, Once(_nation_text(t).encode())).dataframe()


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def open_text(spark, t):
    """An open stream of text."""
    return CsvReader(spark, io.StringIO(_nation_text(t))).dataframe()


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def gzip_stream(spark, t):
    """What a decompressing stream gives."""
    packed = gzip.compress(_nation_text(t).encode())
    return CsvReader(spark, gzip.GzipFile(fileobj=io.BytesIO(packed))).dataframe()


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def parse_text(spark, t):
    """Text in memory."""
    return rowsmith.parse(spark, _nation_text(t))


@query("SELECT c_custkey, '?' || c_name AS name FROM customer")
def utf8_repair(spark, t):
    """Bytes that are no UTF-8 are replaced as asked for, in the rows and in the header."""
    rows = t("customer").select("c_custkey", F.concat(F.lit("é"), "c_name").alias("naméx"))
    path = file_of(spark, rows, "broken.csv", encoding="ISO-8859-1")
    return CsvReader(spark, path, force_utf8=True, invalid_byte_sequence="?").dataframe().toDF("c_custkey", "name")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5")
def first_rows(spark, t):
    """The first rows of a lazy result."""
    path = file_of(spark, t("orders").select("o_orderkey").orderBy("o_orderkey"), "o.csv")
    return CsvReader(spark, path, col_sep=",", with_line_numbers=True).dataframe().orderBy("csv_line_number").limit(5).select("o_orderkey")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def format_with_schema(spark, t):
    """`format("rowsmith")`, cast to a schema."""
    datasource.register(spark)
    path = file_of(spark, t("nation").select("n_nationkey", "n_name"), "n.csv")
    return spark.read.format("rowsmith").schema("n_nationkey bigint, n_name string").load(path)


@query("SELECT 'raised' AS strict, 3 AS skipped")
def format_bad_rows(spark, t):
    """`format("rowsmith")` raises on bad rows, unless told to skip them."""
    datasource.register(spark)
    path = raw_file(spark, spark.sql("SELECT explode(array('a,b', '1,2', '3,4', '5,6,7', '8,9')) AS value").coalesce(1), "bad.csv")
    source = spark.read.format("rowsmith").option("missing_headers", "raise")
    try:
        strict = str(source.load(path).count())
    except Exception as e:  # a worker's error comes wrapped
        strict = "raised" if "HeaderSizeMismatch" in str(e) else repr(e)
    return _rows(spark, [(strict, source.option("on_bad_row", "skip").load(path).count())], "strict string, skipped int")


# --- errors, warnings, callbacks ----------------------------------------------------------------------------


@query("SELECT 'HeaderSizeMismatch' AS file, true AS named_line, 'failed' AS column_form")
def fail_fast(spark, t):
    """By default the first bad row fails the whole read, from files and from columns."""
    path = _bad_file(spark, t)
    try:
        CsvReader(spark, path, col_sep=",", missing_headers="raise").dataframe()
        file, line = "none", False
    except E.RowsmithError as e:
        file, line = type(e).__name__, "(line " in str(e)
    try:
        parse_column(spark.createDataFrame([('1,"open',)], "v string"), "v", ["a", "b"]).collect()
        column = "none"
    except Exception as e:
        column = "failed" if "malformed" in str(e) else repr(e)
    return _rows(spark, [(file, line, column)], "file string, named_line boolean, column_form string")


@query("SELECT o_orderkey + 2 AS line, 'HeaderSizeMismatch' AS error FROM orders WHERE o_orderkey % 7 = 0")
def bad_row_callback(spark, t):
    """Each bad row is handed to a function, in input order."""
    last = 0
    with _Pieces(spark, "line long, error string") as seen:

        def call(row: dict) -> None:
            nonlocal last
            if row["file_line_number"] < last:
                raise AssertionError("bad rows came out of order")
            last = row["file_line_number"]
            seen.add((last, row["error_class"]))

        CsvReader(spark, _bad_file(spark, t), col_sep=",", missing_headers="raise", on_bad_row=call).dataframe()
    return seen.dataframe()


@query("SELECT 'TooManyBadRows' AS below, count(*)::VARCHAR AS equal FROM orders WHERE o_orderkey % 7 = 0")
def bad_row_cap(spark, t):
    """One bad row more than the limit fails the read; as many as the limit don't."""
    path, n = _bad_file(spark, t), t("orders").filter("o_orderkey % 7 = 0").count()

    def read(limit: int) -> int:
        r = CsvReader(spark, path, col_sep=",", missing_headers="raise", on_bad_row="skip", bad_row_limit=limit)
        r.dataframe()
        return r.bad_row_count

    return _rows(spark, [(_error(lambda: read(n - 1)), _error(lambda: read(n)))], "below string, equal string")


@query("""SELECT 3::BIGINT AS good, 'MalformedCSV' AS error_class, 5::BIGINT AS file_line_number, count(*) + 1 AS lines FROM nation""")
def runaway_quote(spark, t):
    """A quote that never closes makes one bad row of the rest of the file."""
    rest = t("nation").orderBy("n_nationkey").select("n_name")
    top = spark.sql("SELECT explode(array('k', '1', '2', '3', '\"open')) AS n_name")
    path = raw_file(spark, top.coalesce(1).unionByName(rest.coalesce(1)).select(F.col("n_name").alias("value")), "open.csv")
    r = CsvReader(spark, path, col_sep=",", on_bad_row="collect", quote_escaping="double_quotes")
    good = r.dataframe().count()
    return r.errors.select(F.lit(good).cast("long").alias("good"), "error_class", "file_line_number", F.col("file_lines_consumed").alias("lines"))


@query("SELECT * FROM (VALUES ('malformed', 'MalformedCSV'), ('extra', 'HeaderSizeMismatch'), ('large', 'FieldSizeLimitExceeded')) AS v(kind, error)")
def what_is_bad(spark, t):
    """The ways in which a record is bad, each with its error class."""
    cases = {"malformed": ('a,b\n1,"x', {}), "extra": ("a,b\n1,2,3", {"missing_headers": "raise"}), "large": ("a,b\n1,xxxxxxxx", {"field_size_limit": 5})}
    got = [(k, _error(lambda: rowsmith.parse(spark, text, col_sep=",", **o).count())) for k, (text, o) in cases.items()]  # noqa: B023
    return _rows(spark, got, "kind string, error string")


@query("""SELECT * FROM (VALUES ('DuplicateHeaders'), ('MissingKeys'), ('KeyMappingError'), ('EmptyFileError'), ('NoColSepDetected'), ('HeaderSizeMismatch'),
 ('ValidationError'), ('InvalidInputData')) AS v(error)""")
def error_classes(spark, t):
    """Every failure of header, options and writer has its class."""
    parse = lambda text, **o: rowsmith.parse(spark, text, **o).count()
    cases = [
        lambda: parse("a,a\n1,2\n", col_sep=",", duplicate_header_suffix=None),
        lambda: parse("a,b\n1,2\n", col_sep=",", required_keys=["z"]),
        lambda: parse("a,b\n1,2\n", col_sep=",", key_mapping={"z": "y"}),
        lambda: parse("", col_sep=",", row_sep="\n"),
        lambda: parse("na%me\nva%lue\n"),
        lambda: parse("a,b\n1,2\n", col_sep=",", user_provided_headers=["x"], headers_in_file=True),
        lambda: parse("a,b\n1,2\n", quote_char=""),
        lambda: rowsmith.generate(spark, "no rows"),
    ]
    return _rows(spark, [(_error(f),) for f in cases], "error string")


@query("SELECT 'headers takes only or except, not both' AS said")
def option_validation(spark, t):
    """Contradicting options are refused before anything is read."""
    try:
        rowsmith.parse(spark, "a,b\n1,2\n", headers={"only": ["a"], "except": ["b"]})
        said = "nothing"
    except E.ValidationError as e:
        said = str(e)
    return _rows(spark, [(said,)], "said string")


@query("""SELECT * FROM (VALUES ('chunk_size_default'), ('header_a_method'), ('utf8_missing_binary_mode'), ('no_clear_row_sep'), ('no_row_sep_found'),
 ('option_bounds'), ('required_headers')) AS v(code)""")
def warning_codes(spark, t):
    """What the reader warns of, by code; quiet readers record it all the same."""

    def codes(text, wanted, then=lambda r: None, **o):
        r = CsvReader(spark, verbose="quiet", **(text if isinstance(text, dict) else {"text": text}), **o)
        then(r)
        return [(w["code"],) for w in last_warnings() if w["code"] == wanted]

    stream = io.TextIOWrapper(io.BytesIO(b"a,b\n1,2\n"), encoding="latin-1")
    got = (
        codes("a,b\n1,2\n", "chunk_size_default", lambda r: list(r.each_chunk()))
        + codes("1,2\n", "header_a_method", user_provided_headers=["a", "b"])
        + codes({"path": stream}, "utf8_missing_binary_mode")
        + codes("a,b\r\n1,2\n", "no_clear_row_sep", col_sep=",")
        + codes("a,b", "no_row_sep_found", col_sep=",")
        + codes("a,b\n1,2\n", "option_bounds", auto_row_sep_chars=10**9)
        + codes("a,b\n1,2\n", "required_headers", required_headers=["a"])
    )
    return _rows(spark, got, "code string")


@query("SELECT count(*) AS errors, 1 AS warnings FROM orders WHERE o_orderkey % 7 = 0")
def last_seen(spark, t):
    """What this thread's latest reader met is there after it."""
    path = _bad_file(spark, t)
    CsvReader(spark, path, col_sep=",", missing_headers="raise", on_bad_row="skip", required_headers=["o_orderkey"], verbose="quiet").dataframe()
    return _rows(spark, [(last_errors().count(), len(last_warnings()))], "errors long, warnings int")


@query("SELECT 1::BIGINT AS started, count(*) AS total, (count(*) + 9) // 10 AS chunks, (count(*) + 9) // 10 AS told, (count(*) + 9) // 10 AS returned FROM nation")
def hooks(spark, t):
    """Callbacks at the start, before each chunk and at the end; with a block, the number of chunks is returned."""
    path = file_of(spark, t("nation").select("n_nationkey"), "n.csv")
    seen: dict[str, list] = {"start": [], "chunk": [], "complete": []}
    r = CsvReader(spark, path, col_sep=",", chunk_size=10, on_start=seen["start"].append, on_chunk=seen["chunk"].append, on_complete=seen["complete"].append)
    told: list[int] = []
    n = r.process(lambda part, i: told.append(i))
    done = seen["complete"][0]
    return _rows(spark, [(len(seen["start"]), done["total_rows"], done["total_chunks"], len(told), n)], "started long, total long, chunks long, told long, returned long")


@query("SELECT count(*) AS n, (count(*) + 9) // 10 AS chunks FROM nation")
def process_returns(spark, t):
    """Without a block, rows are returned, or lists of them with a chunk size."""
    path = file_of(spark, t("nation").select("n_nationkey"), "n.csv")
    rows = CsvReader(spark, path, col_sep=",").process()
    parts = CsvReader(spark, path, col_sep=",", chunk_size=10).process()
    return _rows(spark, [(len(rows), len(parts))], "n long, chunks long")


# --- headers and fields -------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg FROM customer")
def header_in_comment(spark, t):
    """A header line that looks like a comment loses the comment mark."""
    rows = t("customer").select(F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment").alias("value"), F.col("c_custkey").alias("k"))
    top = spark.sql("SELECT '#id,name,seg' AS value, -1L AS k")
    path = raw_file(spark, top.unionByName(rows).orderBy("k").select("value"), "hash.csv")
    return CsvReader(spark, path, col_sep=",", comment_regexp=r"\A#").dataframe()


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def no_header(spark, t):
    """Names are given; the first line is a row."""
    path = file_of(spark, t("customer").select("c_custkey", "c_name"), "plain.csv", write_headers=False)
    return CsvReader(spark, path, col_sep=",", user_provided_headers=["id", "name"], headers_in_file=False).dataframe()


@query("SELECT 'a' AS first, 'a2' AS second, 'MissingKeys' AS required")
def header_checks(spark, t):
    """Duplicates are told apart, and required names must be there."""
    r = CsvReader(spark, text="a,a\n1,2\n", col_sep=",")
    return _rows(spark, [(*r.headers, _error(lambda: CsvReader(spark, text="a,b\n1,2\n", col_sep=",", required_keys=["c"])))], "first string, second string, required string")


@query("SELECT p_partkey, 2 AS quotes, 2 AS fields, p_name AS last FROM part")
def fields_as_map(spark, t):
    """Counted quotes, the first fields of many, and names with fields as a map."""
    d = Dialect(",")
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(',"'), F.col("p_name"), F.lit('",more,and more'))
    raw = t("part").select("p_partkey", line.alias("line")).select("p_partkey", "line", tokenizer.take(tokenizer.fields(F.col("line"), d), 2).alias("f"))
    return raw.select("p_partkey", tokenizer.quote_count(F.col("line"), d).alias("quotes"), F.size("f").alias("fields"), tokenizer.as_map(["k", "name"], F.col("f"))["name"].alias("last"))


@query("SELECT p_partkey, p_partkey % 2 = 0 AS open FROM part")
def open_lines(spark, t):
    """Whether a line's record goes on in the next one."""
    tail = F.when(F.col("p_partkey") % 2 == 0, F.lit('"goes on')).otherwise(F.lit('"ends"'))
    return t("part").select("p_partkey", tokenizer.is_open(F.concat(F.lit("k,"), tail), Dialect(",")).alias("open"))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS price FROM orders")
def european_numbers(spark, t):
    """Points between thousands and a decimal comma."""
    us = F.format_number("o_totalprice", 2)
    shown = F.translate(us, ",.", ".,")
    rows = parse_column(text_of(t("orders").select("o_orderkey", shown.alias("price")), "o_orderkey", "price", col_sep=";"), "value", ["o_orderkey", "price"],
                        types={"o_orderkey": "bigint"}, value_converters={"price": C.european()}, col_sep=";")
    return rows.select("o_orderkey", F.col("price").cast("decimal(15,2)").cast("string").alias("price"))


# --- writing ------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def generate_file(spark, t):
    """Rows to a file through a function that is given a writer."""
    path = scratch(spark, "g.csv")
    rows = [r.asDict() for r in t("nation").select("n_nationkey", "n_name").collect()]

    def fill(w):
        for r in rows:
            w << r

    rowsmith.generate(spark, fill, path)
    return CsvReader(spark, path).dataframe()


@query("SELECT n_nationkey::BIGINT AS k, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::BIGINT END AS region FROM nation")
def writer_object(spark, t):
    """Rows of different keys: columns in order of first sight, the header known only at the end."""
    path = scratch(spark, "w.csv")
    with writer.Writer(spark, path) as w:
        for r in t("nation").collect():
            w << [[{"k": r["n_nationkey"], "name": r["n_name"]} | ({"region": r["n_regionkey"]} if r["n_nationkey"] % 2 == 0 else {})], None]
    return CsvReader(spark, path).dataframe()


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey::BIGINT + 100, r_name FROM region")
def writer_append(spark, t):
    """Appending goes on behind the rows that are there, without a second header."""
    path = file_of(spark, t("nation").select("n_nationkey", "n_name"), "app.csv")
    writer.write(t("region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name")), path, append=True)
    return CsvReader(spark, path).dataframe()


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def directory_of_parts(spark, t):
    """A directory of parts, each with its header, read as one input."""
    path = scratch(spark, "parts")
    writer.write(t("orders").select("o_orderkey", "o_orderstatus").repartition(3), path, single=False)
    return CsvReader(spark, path, col_sep=",").dataframe()


# --- files as they arrive -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT NULL, 'o_orderstatus' FROM range(1)")
def stream_with_header(spark, t):
    """Each file's header goes, by its place; a row that reads like it stays."""
    folder = scratch(spark, "in")
    df = t("orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus")
    writer.write(df.unionByName(spark.sql("SELECT 'o_orderkey' AS o_orderkey, 'o_orderstatus' AS o_orderstatus")).coalesce(2), folder, single=False)
    rows = read_stream(spark, folder, ["o_orderkey", "o_orderstatus"], col_sep=",").drop("file")
    out, state = scratch(spark, "out"), scratch(spark, "state")
    import_chunks(rows, lambda part, i: part.write.mode("append").parquet(out), state).awaitTermination()
    return spark.read.schema("o_orderkey string, o_orderstatus string").parquet(out).select(F.expr("try_cast(o_orderkey AS bigint)").alias("o_orderkey"), "o_orderstatus")


def _arriving(spark, t) -> DataFrame:
    """Events as delimited text of files that arrive, with a time of their own."""
    folder = scratch(spark, "in")
    writer.write(t("events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "value"), folder, single=False, write_headers=False)
    return read_stream(spark, folder, ["event_id", "event_type", "at", "value"], header=False, col_sep=",", types={"event_id": "bigint", "value": "double"},
                       value_converters={"at": lambda c: F.to_timestamp(c, "yyyy-MM-dd HH:mm:ss")}).drop("file")


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL""")
def event_time_windows(spark, t):
    """Windows of an hour over the events' own time, under a watermark, over everything that has arrived."""
    counts = _arriving(spark, t).withWatermark("at", "400 days").groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    name = f"hours_{scratch(spark, 'x').rpartition('/')[2][:12]}"
    state = scratch(spark, "state")
    counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def state_per_key(spark, t):
    """State of any kind for each key, kept over micro-batches."""
    import pandas as pd

    def count(key, frames, state):
        n, last = state.get if state.exists else (0, -1)
        for f in frames:
            n, last = n + len(f), max(last, int(f["event_id"].max()))
        state.update((n, last))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "last": [last]})

    rows = _arriving(spark, t).groupBy("event_type").applyInPandasWithState(count, "event_type string, n long, last long", "n long, last long", "update", "NoTimeout")
    out, state = scratch(spark, "out"), scratch(spark, "state")
    rows.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("append").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_type string, n long, last long").parquet(out).groupBy("event_type").agg(F.max("n").alias("n"), F.max("last").alias("last"))


# --- Spark's own operators over parsed rows -----------------------------------------------------------------

CUSTOMER = {"c_custkey": "bigint", "c_nationkey": "bigint", "c_acctbal": "double"}
ORDER = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double"}


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
def left_join(spark, t):
    o = parsed(t, "orders", ORDER).filter("o_totalprice > 200000")
    return parsed(t, "customer", CUSTOMER).join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, r_regionkey::BIGINT AS r_regionkey FROM (SELECT * FROM customer WHERE c_custkey <= 8) FULL JOIN region ON c_custkey = r_regionkey")
def full_join(spark, t):
    c, r = parsed(t, "customer", CUSTOMER).filter("c_custkey <= 8"), parsed(t, "region", {"r_regionkey": "bigint", "r_name": "string"})
    return c.join(r, F.col("c_custkey") == F.col("r_regionkey"), "full").select("c_custkey", "r_regionkey")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS buys FROM customer")
def semi_anti_join(spark, t):
    c, o = parsed(t, "customer", CUSTOMER), parsed(t, "orders", ORDER)
    on = F.col("c_custkey") == F.col("o_custkey")
    return c.join(o, on, "left_semi").select("c_custkey", F.lit(True).alias("buys")).unionByName(c.join(o, on, "left_anti").select("c_custkey", F.lit(False).alias("buys")))


@query("SELECT a.n_name AS a, b.r_name AS b FROM nation a CROSS JOIN region b")
def cross_join(spark, t):
    a, b = parsed(t, "nation", {"n_name": "string", "n_nationkey": "bigint"}), parsed(t, "region", {"r_name": "string", "r_regionkey": "bigint"})
    return a.crossJoin(b).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS band FROM part""")
def range_join(spark, t):
    """Rows to the interval that holds them: a join on inequalities, the intervals broadcast by their size."""
    bands = rowsmith.parse(spark, "band,lo,hi\nsmall,0,10\nmiddle,10,30\nlarge,30,1000\n", col_sep=",")
    p = parsed(t, "part", {"p_partkey": "bigint", "p_size": "bigint"})
    return p.join(bands, (F.col("p_size") >= F.col("lo")) & (F.col("p_size") < F.col("hi"))).select("p_partkey", "band")


@query("""SELECT a.event_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND (b.ts, b.event_id) <= (a.ts, a.event_id)) AS bought
 FROM events a""")
def as_of_join(spark, t):
    """Each event with the latest purchase of its user up to then: one window over both sides, no inequality join."""
    e = t("events").select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))
    rows = parsed(lambda name: e, "events", {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "at": "string"})
    past = Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("event_id", F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(past).alias("bought"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_rows(spark, t):
    return parsed(t, "orders", {"o_orderstatus": "string", "o_orderpriority": "string"}).rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_rows(spark, t):
    return parsed(t, "orders", {"o_orderstatus": "string", "o_orderpriority": "string"}).cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def grouping_sets(spark, t):
    rows = parsed(t, "orders", {"o_orderstatus": "string", "o_orderpriority": "string"})
    return rows.groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, t):
    return parsed(t, "orders", {"o_orderstatus": "string", "o_orderpriority": "string"}).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, t):
    return parsed(t, "orders", ORDER).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT c_nationkey::BIGINT AS k FROM customer INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0")
def intersect_rows(spark, t):
    even = parsed(t, "nation", {"n_nationkey": "bigint", "n_name": "string"}).filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"))
    return parsed(t, "customer", CUSTOMER).select(F.col("c_nationkey").alias("k")).intersect(even)


@query("SELECT n_nationkey::BIGINT AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_custkey <= 20")
def except_rows(spark, t):
    few = parsed(t, "customer", CUSTOMER).filter("c_custkey <= 20").select(F.col("c_nationkey").alias("k"))
    return parsed(t, "nation", {"n_nationkey": "bigint", "n_name": "string"}).select(F.col("n_nationkey").alias("k")).subtract(few)


@query("""SELECT o_orderkey, rank() OVER w AS place, sum(CAST(o_totalprice AS DECIMAL(15,2))) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::DOUBLE AS last3
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def window_frames(spark, t):
    """Ranks, and sums over a moving frame."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = parsed(t, "orders", ORDER | {"o_totalprice": "decimal(15,2)"})
    return rows.select("o_orderkey", F.rank().over(w).alias("place"), F.sum("o_totalprice").over(w.rowsBetween(-2, 0)).cast("double").alias("last3"))

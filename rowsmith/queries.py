"""Queries over the test tables, one or more an operator: each makes delimited text from a table, sends it through
the operator and returns what comes back; SQL gives the same rows straight from the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsmith.functions import converters as C
from rowsmith.functions import values as V
from rowsmith.functions.dialect import Dialect
from rowsmith.operators import records, sequence, writer
from rowsmith.sources.reader import CsvReader, parse_column, parse_documents
from rowsmith.sources.scratch import scratch, ship
from rowsmith.streaming.stream import import_chunks, read_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def spread(df: DataFrame, least: int = 1 << 20) -> DataFrame:
    """A table over all cores where its file is one piece (a single row group) that one task would read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, df.columns[0]) if least < size < cores * (32 << 20) else df


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, lambda name: spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def text_of(df: DataFrame, *columns: str, **options) -> DataFrame:
    """The columns as one line a row, in column `value`."""
    return writer.lines(df.select(*columns), **options)


def file_of(spark: SparkSession, df: DataFrame, name: str, **options) -> str:
    path = scratch(spark, name)
    writer.write(df, path, **options)
    return path


def raw_file(spark: SparkSession, df: DataFrame, name: str, row_sep: str = "\n") -> str:
    """A file of ready lines (column `value`), as they are."""
    return file_of(spark, df, name, write_headers=False, disable_auto_quoting=True, row_sep=row_sep, col_sep="\x00")


LINEITEM = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
MONEY = "decimal(15,2)"


# --- splitting ----------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) AS sum_qty,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS sum_price, count(*) AS n FROM lineitem GROUP BY ALL""")
def parse_lineitem_q1(spark, t):
    """Unquoted split, typed columns, pruning, aggregation."""
    rows = parse_column(text_of(t("lineitem"), *LINEITEM), "value", LINEITEM, types={"l_quantity": MONEY, "l_extendedprice": MONEY})
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("double").alias("sum_qty"), F.sum("l_extendedprice").cast("double").alias("sum_price"), F.count("*").alias("n"))


@query("SELECT event_id, props FROM events")
def parse_events_props(spark, t):
    """Quoted fields with doubled quotes."""
    rows = parse_column(text_of(t("events"), "event_id", "event_type", "props"), "value", ["event_id", "event_type", "props"], types={"event_id": "bigint"})
    return rows.select("event_id", "props")


@query("SELECT doc_id, trim(text, e' \\t') AS text FROM documents")
def multiline_documents(spark, t):
    """Records that span lines, from a file, framed sequentially."""
    path = file_of(spark, t("documents").select("doc_id", "text"), "documents.csv")
    return CsvReader(spark, path, row_sep="\n", col_sep=",", quote_escaping="double_quotes").dataframe()


@query("SELECT page_id, trim(html, e' \\t') AS html FROM pages")
def multiline_pages(spark, t):
    path = file_of(spark, t("pages").select("page_id", "html"), "pages.csv")
    return CsvReader(spark, path, row_sep="\n", col_sep=",", quote_escaping="double_quotes").dataframe()


@query("SELECT event_id, replace(props, '\"', '\\\"') AS props FROM events")
def backslash_escape(spark, t):
    """Backslash escapes stay in the value."""
    q = F.concat(F.col("event_id").cast("string"), F.lit(',"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"'))
    return parse_column(t("events").select(q.alias("value")), "value", ["event_id", "props"], types={"event_id": "bigint"}, quote_escaping="backslash")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'C:\\dir\\' ELSE 'say \\\"hi\\\"' END AS path, c_mktsegment FROM customer")
def auto_escape(spark, t):
    """Backslash first; a line that stays open under it is read with doubled quotes alone."""
    path = F.when(F.col("c_custkey") % 2 == 0, '"C:\\dir\\"').otherwise('"say \\"hi\\""')
    raw = t("customer").select(F.concat_ws(",", "c_custkey", path, "c_mktsegment").alias("value"))
    return parse_column(raw, "value", ["c_custkey", "path", "c_mktsegment"], types={"c_custkey": "bigint"})


def _separated(sep: str):
    def run(spark, t):
        names = ["p_partkey", "p_name", "p_brand", "p_size"]
        raw = text_of(t("part"), *names, col_sep=sep)
        return parse_column(raw, "value", names, types={"p_partkey": "bigint", "p_size": "bigint"}, col_sep=sep)

    return run


for _name, _sep in {"multi_char_sep": "<=>", "ctrl_char_sep": "\x01", "tab_sep": "\t", "semicolon_sep": ";", "space_sep": " "}.items():
    _f = _separated(_sep)
    _f.__name__ = _name
    query("SELECT p_partkey, p_name, p_brand, CAST(p_size AS BIGINT) AS p_size FROM part")(_f)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name || '''s \"x\"' AS name FROM nation")
def other_quote_char(spark, t):
    """Another quote character; the usual one is then text."""
    raw = t("nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(",'"), F.col("n_name"), F.lit("''s \"x\"'")).alias("value"))
    return parse_column(raw, "value", ["n_nationkey", "name"], types={"n_nationkey": "bigint"}, quote_char="'")


@query("SELECT p_partkey, p_name || ' 6''2\" tall' AS size, '\"x\" y' AS odd FROM part")
def stray_quotes(spark, t):
    """Quotes inside a field, and behind a closing quote, are text."""
    raw = t("part").select(F.concat_ws(",", "p_partkey", F.concat("p_name", F.lit(" 6'2\" tall")), F.lit('"""x"" y"')).alias("value"))
    return parse_column(raw, "value", ["p_partkey", "size", "odd"], types={"p_partkey": "bigint"})


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name FROM part WHERE p_partkey % 3 <> 0")
def legacy_boundary(spark, t):
    """Under legacy boundaries any quote toggles, so a stray one leaves the record open: such rows are bad."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(' 6"'))).otherwise(F.concat(F.lit('"'), "p_name", F.lit('"')))
    raw = t("part").select(F.concat_ws(",", "p_partkey", name).alias("raw"), F.lit("").alias("file"), F.col("p_partkey").alias("file_line"))
    found = records.single(raw, Dialect(",", boundary="legacy"), None).filter("status = 'ok'")
    return found.select(F.get("fields", F.lit(0)).cast("bigint").alias("p_partkey"), F.get("fields", F.lit(1)).alias("p_name"))


@query("SELECT p_brand, p_partkey, p_name FROM part")
def texts_in_a_column(spark, t):
    """Whole delimited texts in a column: one text, many rows, with quoted line ends."""
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(',"'), F.replace("p_name", F.lit(" "), F.lit("\n")), F.lit('"'))
    texts = t("part").groupBy("p_brand").agg(F.concat(F.lit("key,name\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("body"))
    rows = parse_documents(texts, "body", "p_brand", ["p_partkey", "p_name"], types={"p_partkey": "bigint"})
    return rows.select("p_brand", "p_partkey", F.replace("p_name", F.lit("\n"), F.lit(" ")).alias("p_name"))


# --- files: dialect, header, layout -------------------------------------------------------------------------


ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def _sniffed(row_sep: str, col_sep: str):
    def run(spark, t):
        df = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
        return CsvReader(spark, file_of(spark, df, "orders.csv", row_sep=row_sep, col_sep=col_sep)).dataframe()

    return run


for _name, _pair in {"crlf_sniffed": ("\r\n", ","), "cr_sniffed": ("\r", ";"), "lf_tab_sniffed": ("\n", "\t"), "pipe_sniffed": ("\n", "|"), "colon_sniffed": ("\r\n", ":")}.items():
    _f = _sniffed(*_pair)
    _f.__name__ = _name
    query(ORDERS)(_f)


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def odd_row_sep(spark, t):
    """Any text may separate rows."""
    path = file_of(spark, t("orders").select("o_orderkey", "o_orderstatus"), "orders.bin", row_sep="\x02\x03;", col_sep="\x01")
    return CsvReader(spark, path, row_sep="\x02\x03;", col_sep="\x01").dataframe()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 5 <> 0")
def skip_and_comment(spark, t):
    """Lines before the header, and comment lines between rows."""
    key = F.concat_ws(",", "o_orderkey", "o_custkey")
    rows = t("orders").select(F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("# "), key)).otherwise(key).alias("value"), F.col("o_orderkey").alias("k"))
    top = spark.sql("SELECT * FROM VALUES ('made by hand', -3L), ('on some day', -2L), ('o_orderkey,o_custkey', -1L) AS t(value, k)")
    path = raw_file(spark, top.unionByName(rows).orderBy("k").select("value"), "commented.csv")
    return CsvReader(spark, path, skip_lines=2, comment_regexp=r"\A#").dataframe()


def _headed(spark, t, line: str, **options) -> DataFrame:
    rows = t("customer").select(F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment").alias("value"), F.col("c_custkey").alias("k"))
    top = spark.createDataFrame([(line, -1)], "value string, k long")
    path = raw_file(spark, top.unionByName(rows).orderBy("k").select("value"), "headed.csv")
    return CsvReader(spark, path, col_sep=",", **options).dataframe()


@query("SELECT c_custkey AS cust_key, c_name AS full_name, c_mktsegment AS market___segment FROM customer")
def header_normalize(spark, t):
    return _headed(spark, t, '"Cust Key", Full-Name ,Market - Segment')


@query("SELECT c_custkey AS name, c_name AS name2, c_mktsegment AS name3 FROM customer")
def header_dups(spark, t):
    return _headed(spark, t, "name,name,Name")


@query("SELECT c_custkey AS id, c_name AS column_2, c_mktsegment AS column_3 FROM customer")
def header_blank(spark, t):
    return _headed(spark, t, "id,, ")


@query("SELECT c_custkey AS \"Cust Key\", c_name AS \"Full-Name\", c_mktsegment AS \"Seg\" FROM customer")
def header_kept(spark, t):
    return _headed(spark, t, "Cust Key,Full-Name,Seg", keep_original_headers=True)


@query("SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def key_mapping_drop(spark, t):
    """Renamed and dropped columns."""
    return _headed(spark, t, "a,b,c", key_mapping={"a": "id", "b": None, "c": "segment"})


@query("SELECT c_custkey AS id FROM customer")
def key_mapping_only(spark, t):
    return _headed(spark, t, "a,b,c", key_mapping={"a": "id", "zzz": "none"}, remove_unmapped_keys=True, silence_missing_keys=True)


@query("SELECT c_custkey AS k, c_name AS n, c_mktsegment AS m FROM customer")
def user_headers(spark, t):
    return _headed(spark, t, "x,y,z", user_provided_headers=["k", "n", "m"], headers_in_file=True)


@query("SELECT c_custkey AS id, c_mktsegment AS seg FROM customer")
def strip_header_chars(spark, t):
    return _headed(spark, t, "#id?,name!,seg", strip_chars_from_headers=r"[#?!]").drop("name")


@query("SELECT l_orderkey, l_tax FROM lineitem")
def only_columns(spark, t):
    rows = parse_column(text_of(t("lineitem"), *LINEITEM), "value", LINEITEM, types=dict.fromkeys(LINEITEM[:1], "bigint") | {"l_tax": "double"}, headers={"only": ["l_orderkey", "l_tax", "nope"]})
    return rows


@query("SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem")
def except_columns(spark, t):
    return parse_column(text_of(t("lineitem"), *LINEITEM), "value", LINEITEM, types={"l_orderkey": "bigint"}, headers={"except": LINEITEM[1:6]})


# --- values -------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name, p_brand FROM part")
def strip_ws(spark, t):
    """Blanks around fields, also inside quotes."""
    raw = t("part").select(F.concat(F.lit("  "), F.col("p_partkey").cast("string"), F.lit(' ,\t"  '), "p_name", F.lit(' \t",\t '), "p_brand", F.lit(" ")).alias("value"))
    return parse_column(raw, "value", ["p_partkey", "p_name", "p_brand"], types={"p_partkey": "bigint"})


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS p_name FROM part")
def blank_to_null(spark, t):
    """Fields of nothing but white space, of any kind, are absent."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.lit("   ")).otherwise(F.col("p_name"))
    raw = t("part").select(F.concat_ws(",", "p_partkey", name).alias("value"))
    return parse_column(raw, "value", ["p_partkey", "p_name"], types={"p_partkey": "bigint"})


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS p_name FROM part")
def empty_kept(spark, t):
    name = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_name"))
    raw = t("part").select(F.concat_ws(",", "p_partkey", name).alias("value"))
    return parse_column(raw, "value", ["p_partkey", "p_name"], types={"p_partkey": "bigint"}, remove_empty_values=False)


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 4 <> 0")
def blank_rows_dropped(spark, t):
    line = F.when(F.col("p_partkey") % 4 == 0, F.lit(" , ")).otherwise(F.concat_ws(",", "p_partkey", "p_name"))
    return parse_column(t("part").select(line.alias("value")), "value", ["p_partkey", "p_name"], types={"p_partkey": "bigint"})


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 THEN o_orderpriority END AS priority FROM orders")
def nil_sentinels(spark, t):
    p = F.when(F.col("o_orderkey") % 5 == 0, "NULL").when(F.col("o_orderkey") % 5 == 1, "N/A").otherwise(F.col("o_orderpriority"))
    raw = t("orders").select(F.concat_ws(",", "o_orderkey", p).alias("value"))
    return parse_column(raw, "value", ["o_orderkey", "priority"], types={"o_orderkey": "bigint"}, nil_values_matching=C.NULL_SENTINELS)


@query("SELECT nullif(l_orderkey, 0) AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, nullif(l_discount, 0) AS l_discount FROM lineitem")
def zero_removed(spark, t):
    names = ["l_orderkey", "l_linenumber", "l_discount"]
    return parse_column(text_of(t("lineitem"), *names), "value", names, types={"l_orderkey": "bigint", "l_linenumber": "bigint", "l_discount": "double"}, remove_zero_values=True)


_ODD = "CASE c_custkey % 6 WHEN 0 THEN '007' WHEN 1 THEN '.5' WHEN 2 THEN '5.' WHEN 3 THEN '-1.25e2' WHEN 4 THEN '1_000' ELSE '+42' END"


@query(f"""SELECT c_custkey, {_ODD} AS raw, CASE WHEN regexp_full_match({_ODD}, '[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?')
 THEN TRY_CAST({_ODD} AS DOUBLE) END AS num FROM customer""")
def numeric_gate(spark, t):
    """What counts as a number."""
    raw = t("customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(","), F.expr(_ODD)).alias("value"))
    rows = parse_column(raw, "value", ["c_custkey", "raw"], types={"c_custkey": "bigint"})
    return rows.withColumn("num", V.to_double(F.col("raw")))


@query("SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def numeric_except(spark, t):
    df = t("customer").select("c_custkey", "c_nationkey")
    return CsvReader(spark, file_of(spark, df, "c.csv"), convert_values_to_numeric={"except": ["c_nationkey"]}).dataframe()


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice, l_returnflag FROM lineitem")
def column_typing(spark, t):
    """Types inferred over all rows of a file."""
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    return CsvReader(spark, file_of(spark, df, "l.csv")).dataframe()


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'bigint' ELSE 'string' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::BIGINT END AS n FROM customer")
def cell_typing(spark, t):
    """A type a cell: numbers and text in one column."""
    v = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise(F.concat(F.lit("x"), F.col("c_nationkey")))
    raw = t("customer").select(F.concat_ws(",", "c_custkey", v).alias("value"))
    rows = parse_column(raw, "value", ["c_custkey", "v"], types={"c_custkey": "bigint", "v": "cell"})
    kind = F.lower(F.schema_of_variant("v"))
    return rows.select("c_custkey", kind.alias("kind"), F.try_variant_get("v", "$", "bigint").alias("n"))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS price FROM orders")
def decimal_exact(spark, t):
    names = ["o_orderkey", "price"]
    raw = t("orders").select(F.concat_ws(",", "o_orderkey", F.col("o_totalprice").cast(MONEY)).alias("value"))
    return parse_column(raw, "value", names, types={"o_orderkey": "bigint", "price": MONEY}).select("o_orderkey", F.col("price").cast("string").alias("price"))


@query("SELECT o_orderkey, o_totalprice AS price FROM orders")
def decimal_float(spark, t):
    raw = t("orders").select(F.concat_ws(",", "o_orderkey", "o_totalprice").alias("value"))
    return parse_column(raw, "value", ["o_orderkey", "price"], types={"o_orderkey": "bigint", "price": "double"})


@query("SELECT o_orderkey, length(ltrim(replace(replace(CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR), '.', ''), '-', ''), '0'))::INT AS digits FROM orders")
def sig_digits(spark, t):
    raw = t("orders").select(F.concat_ws(",", "o_orderkey", F.col("o_totalprice").cast(MONEY)).alias("value"))
    rows = parse_column(raw, "value", ["o_orderkey", "price"], types={"o_orderkey": "bigint"})
    return rows.select("o_orderkey", V.significant(F.col("price")).alias("digits"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS price FROM orders""")
def converters_date_money(spark, t):
    amount = F.format_number("o_totalprice", 2)
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("($"), amount, F.lit(")"))).otherwise(F.concat(F.lit("$"), amount))
    df = t("orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"), shown.alias("price"))
    rows = parse_column(text_of(df, "o_orderkey", "day", "price"), "value", ["o_orderkey", "day", "price"], types={"o_orderkey": "bigint"},
                        value_converters={"day": C.date("dd.MM.yyyy"), "price": C.money()})
    return rows.select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("price").cast(MONEY).cast("string").alias("price"))


@query("SELECT p_partkey, p_partkey % 2 = 0 AS flag, p_size / 100.0 AS share, len(string_split(p_name, ' '))::INT AS parts FROM part")
def converters_more(spark, t):
    """Booleans, percentages, several values in a cell."""
    df = t("part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "Yes").otherwise("no").alias("flag"),
                          F.concat(F.col("p_size").cast("string"), F.lit(" %")).alias("share"), F.replace("p_name", F.lit(" "), F.lit("|")).alias("parts"))
    rows = parse_column(text_of(df, *df.columns), "value", df.columns, types={"p_partkey": "bigint"},
                        value_converters={"flag": C.boolean(), "share": C.percent(), "parts": C.listed()})
    return rows.withColumn("parts", F.size("parts"))


@query("SELECT doc_id FROM documents WHERE strlen(text) <= 2000")
def field_size_limit(spark, t):
    """Fields over the limit, in bytes, make their row bad."""
    raw = text_of(t("documents").select("doc_id", F.regexp_replace("text", r'[\n\r"\\]', " ").alias("text")), "doc_id", "text")
    return parse_column(raw, "value", ["doc_id", "text"], types={"doc_id": "bigint"}, field_size_limit=2000, strip_whitespace=False, on_bad_row="skip").select("doc_id")


# --- rows: ragged, bad, numbered ----------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice FROM orders")
def ragged_short(spark, t):
    line = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).otherwise(F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_totalprice"))
    return parse_column(t("orders").select(line.alias("value")), "value", ["o_orderkey", "o_orderstatus", "o_totalprice"], types={"o_orderkey": "bigint", "o_totalprice": "double"})


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS column_3 FROM orders")
def ragged_long(spark, t):
    """Fields beyond the header get columns of their own."""
    two = F.concat_ws(",", "o_orderkey", "o_orderstatus")
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws(",", two, "o_orderpriority")).otherwise(two)
    rows = t("orders").select(line.alias("value"), F.col("o_orderkey").alias("k"))
    top = spark.sql("SELECT 'o_orderkey,o_orderstatus' AS value, -1L AS k")
    return CsvReader(spark, raw_file(spark, top.unionByName(rows).orderBy("k").select("value"), "r.csv"), col_sep=",").dataframe()


def _bad_file(spark, t) -> str:
    two = F.concat_ws(",", "o_orderkey", "o_orderstatus")
    rows = t("orders").select(F.when(F.col("o_orderkey") % 7 == 0, F.concat(two, F.lit(",x"))).otherwise(two).alias("value"), F.col("o_orderkey").alias("k"))
    top = spark.sql("SELECT 'o_orderkey,o_orderstatus' AS value, -1L AS k")
    return raw_file(spark, top.unionByName(rows).orderBy("k").select("value"), "bad.csv")


@query("SELECT o_orderkey + 2 AS file_line_number, 'HeaderSizeMismatch' AS error_class, o_orderkey || ',' || o_orderstatus || ',x' AS raw_logical_line FROM orders WHERE o_orderkey % 7 = 0")
def ragged_raise_quarantine(spark, t):
    """Rows wider than the header, collected with their place."""
    r = CsvReader(spark, _bad_file(spark, t), col_sep=",", missing_headers="raise", on_bad_row="collect")
    r.dataframe()
    return r.errors.select("file_line_number", "error_class", "raw_logical_line")


@query("SELECT count(*) FILTER (o_orderkey % 7 <> 0) AS good, count(*) FILTER (o_orderkey % 7 = 0) AS bad FROM orders")
def bad_row_counts(spark, t):
    r = CsvReader(spark, _bad_file(spark, t), col_sep=",", missing_headers="raise", on_bad_row="skip", bad_row_limit=10**9)
    good = r.dataframe().agg(F.count("*").alias("good"))
    return good.withColumn("bad", F.lit(r.bad_row_count).cast("long"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'malformed' ELSE 'ok' END AS state FROM orders")
def open_quotes_flagged(spark, t):
    name = F.when(F.col("o_orderkey") % 9 == 0, F.lit('"open')).otherwise(F.lit('"shut"'))
    raw = t("orders").select("o_orderkey", F.concat_ws(",", "o_orderkey", name).alias("value"))
    return parse_column(raw, "value", ["k", "v"], keep=["o_orderkey"], status="state").select("o_orderkey", "state")


@query("SELECT o_orderkey, o_orderkey + 2 AS csv_line_number FROM orders")
def line_numbers(spark, t):
    df = t("orders").select("o_orderkey").orderBy("o_orderkey")
    return CsvReader(spark, file_of(spark, df, "n.csv"), with_line_numbers=True).dataframe()


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_seq, (row_number() OVER (ORDER BY o_orderkey) - 1) // 250 AS chunk_index FROM orders WHERE o_orderkey % 4 <> 0")
def chunk_index(spark, t):
    """Chunks of good rows in input order."""
    line = F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).otherwise(F.col("o_orderkey").cast("string"))
    rows = t("orders").select(line.alias("value"), F.col("o_orderkey").alias("k"))
    top = spark.sql("SELECT 'o_orderkey' AS value, -1L AS k")
    path = raw_file(spark, top.unionByName(rows).orderBy("k").select("value"), "k.csv")
    return CsvReader(spark, path, col_sep=",").chunked(250)


@query("SELECT text_in AS text, text_in AS again FROM (SELECT 'é' || c_name AS text_in FROM customer)")
def latin1_encoding(spark, t):
    """A declared encoding other than UTF-8."""
    df = t("customer").select(F.concat(F.lit("é"), "c_name").alias("text"), F.concat(F.lit("é"), "c_name").alias("again"))
    return CsvReader(spark, file_of(spark, df, "l1.csv", encoding="ISO-8859-1"), file_encoding="iso-8859-1").dataframe()


@query("SELECT c_custkey, c_name FROM customer")
def utf8_bom(spark, t):
    path = file_of(spark, t("customer").select("c_custkey", "c_name"), "bom.csv", write_bom=True)
    return CsvReader(spark, path).dataframe()


# --- writing ------------------------------------------------------------------------------------------------


@query("""SELECT event_id || ',' || event_type || ',"' || replace(props, '"', '""') || '"' AS value FROM events""")
def writer_quoting(spark, t):
    return writer.lines(t("events").select("event_id", "event_type", "props"))


@query("SELECT '\"' || p_partkey || '\";\"' || p_name || '\"' AS value FROM part")
def writer_force_quotes(spark, t):
    return writer.lines(t("part").select("p_partkey", "p_name"), force_quotes=True, col_sep=";")


@query("SELECT p_partkey || ',' || CASE WHEN p_partkey % 3 = 0 THEN 'NIL' WHEN p_partkey % 3 = 1 THEN 'EMPTY' ELSE p_name END AS value FROM part")
def writer_nil_empty(spark, t):
    name = F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).when(F.col("p_partkey") % 3 == 1, "").otherwise(F.col("p_name"))
    return writer.lines(t("part").select("p_partkey", name.alias("p_name")), write_nil_value="NIL", write_empty_value="EMPTY")


@query("""SELECT n_name || ',' || n_nationkey || ',-' AS value FROM nation UNION ALL SELECT 'NATION,KEY,REMARK'""")
def writer_headers(spark, t):
    """Order, names and a column that the rows lack."""
    text = writer.to_csv_string(t("nation").select("n_nationkey", "n_name"), headers=["n_name", "n_nationkey", "remark"], map_headers={"n_nationkey": "key", "n_name": "nation"},
                                header_converter=str.upper, discover_headers=False, write_empty_value="-")
    return spark.createDataFrame([(x,) for x in text.splitlines()], "value string")


@query("SELECT p_partkey || ',' || upper(p_name) || ',<' || p_brand || '>' AS value FROM part")
def writer_converters(spark, t):
    conv = {"p_name": F.upper, "_all": lambda n, c: F.when(n == "p_brand", F.concat(F.lit("<"), c, F.lit(">"))).otherwise(c)}
    return writer.lines(t("part").select("p_partkey", "p_name", "p_brand"), value_converters=conv)


@query("SELECT event_id, event_type, value, props FROM events")
def roundtrip_events(spark, t):
    df = t("events").select("event_id", "event_type", "value", "props")
    return CsvReader(spark, file_of(spark, df, "e.csv")).dataframe()


@query("SELECT conv_id, turn, role, trim(text, e' \\t') AS text FROM conversations WHERE length(trim(text)) > 0")
def roundtrip_conversations(spark, t):
    df = t("conversations").filter(F.length(F.trim("text")) > 0)
    return CsvReader(spark, file_of(spark, df, "conv.csv"), quote_escaping="double_quotes", col_sep=",", row_sep="\n").dataframe()


@query("SELECT c_custkey, c_mktsegment, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal > 0")
def read_transform_write(spark, t):
    """Read, filter, compute, write, read again."""
    first = CsvReader(spark, file_of(spark, t("customer"), "a.csv")).dataframe()
    moved = first.filter("c_acctbal > 0").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") * 2).alias("twice"))
    return CsvReader(spark, file_of(spark, moved, "b.csv")).dataframe()


# --- beside Spark's own operators ---------------------------------------------------------------------------


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_parsed(spark, t):
    c = parse_column(text_of(t("customer"), "c_custkey", "c_nationkey"), "value", ["c_custkey", "c_nationkey"], types={"c_nationkey": "bigint"})
    n = parse_column(text_of(t("nation"), "n_nationkey", "n_name"), "value", ["n_nationkey", "n_name"], types={"n_nationkey": "bigint"})
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("customers"))


@query("SELECT n_nationkey::BIGINT AS k, n_name AS name, NULL::BIGINT AS region FROM nation UNION ALL BY NAME SELECT r_regionkey::BIGINT AS k, r_name AS name, r_regionkey::BIGINT AS region FROM region")
def union_ragged(spark, t):
    a = parse_column(text_of(t("nation"), "n_nationkey", "n_name"), "value", ["k", "name"], types={"k": "bigint"})
    line = F.concat_ws(",", "r_regionkey", "r_name", "r_regionkey")
    b = parse_column(t("region").select(line.alias("value")), "value", ["k", "name", "region"], types={"k": "bigint", "region": "bigint"})
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def top_per_group(spark, t):
    names = ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]
    rows = parse_column(text_of(t("customer"), *names), "value", names, types={"c_custkey": "bigint", "c_nationkey": "bigint", "c_acctbal": "double"})
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return rows.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def stream_files(spark, t):
    """Files of a directory as a stream, into a table, from a checkpoint."""
    folder, out, state = (scratch(spark, x) for x in ("in", "out", "state"))
    writer.write(t("orders").select("o_orderkey", "o_totalprice"), folder, single=False, write_headers=False)
    rows = read_stream(spark, folder, ["o_orderkey", "o_totalprice"], header=False, types={"o_orderkey": "bigint", "o_totalprice": "double"}, col_sep=",")
    for _ in range(2):  # a restart finds nothing left to do
        import_chunks(rows.drop("file"), lambda df, i: df.write.mode("append").parquet(out), state).awaitTermination()
    return spark.read.schema("o_orderkey long, o_totalprice double").parquet(out)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS row_seq FROM orders")
def sequence_rows(spark, t):
    """Dense numbers in a given order."""
    n = t("orders").agg(F.max("o_orderkey")).first()[0]
    rows = t("orders").select("o_orderkey", F.lit("").alias("_file"), (F.lit(n) - F.col("o_orderkey")).alias("_line"))
    return sequence.number(rows).select("o_orderkey", "row_seq")

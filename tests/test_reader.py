"""Files and texts to rows: sniffing, header pipeline, values, ragged and bad rows, chunks, hooks."""

import gzip
import os
import pickle

import pytest

import rowsmith
from rowsmith import errors as E
from rowsmith.options import ReadOptions
from rowsmith.plans import header
from rowsmith.sources import sniff
from rowsmith.sources.reader import CsvReader

O = ReadOptions.of


def rows(spark, text, **options):
    return list(CsvReader(spark, text=text, **options).each())


@pytest.fixture
def put(tmp_path):
    def write(name, text, encoding="utf-8"):
        p = tmp_path / name
        data = text if isinstance(text, bytes) else text.encode(encoding)
        p.write_bytes(data)
        return str(p)

    return write


# --- sniffing


@pytest.mark.parametrize(("text", "want"), [("a\r\nb\r\n", "\r\n"), ("a\nb\n", "\n"), ("a\rb\r", "\r"), ('"x\r\ny\r\nz"\nb\n', "\n"), ("", "\n"), ("abc", "\n")])
def test_row_sep(text, want):
    assert sniff.row_sep(text, O(), lambda *a: None) == want


def test_row_sep_across_windows_and_warnings():
    o, notes = O(auto_row_sep_chars=512), []
    assert sniff.row_sep("x" * 511 + "\r\n" + "y" * 600 + "\r\n", o, lambda *a: notes.append(a)) == "\r\n"
    assert sniff.row_sep("a\nb\rc", o, lambda *a: notes.append(a)) == "\n"
    assert notes[-1][0] == "no_clear_row_sep"
    sniff.row_sep("abc", o, lambda *a: notes.append(a))
    assert notes[-1][0] == "no_row_sep_found"


@pytest.mark.parametrize(("line", "want"), [("a,b;c,d", ","), ("a\tb\tc,d", "\t"), ("a;b", ";"), ("a:b", ":"), ("a|b|c", "|"), ('"x,y,z";b', ";"), ("name", ","), ("", ","), ("a,b;c", ",")])
def test_col_sep(line, want):
    assert sniff.col_sep(line + "\n1", O(), "\n") == want


def test_col_sep_not_found():
    with pytest.raises(E.NoColSepDetected):
        sniff.col_sep("a#b\n", O(), "\n")


# --- header


def names(line, **options):
    return header.names_of(line, O(**options), ",")


def test_header_pipeline():
    assert names(' First Name ,LAST-NAME,"Dogs, Cats"') == ["first_name", "last_name", "dogs,_cats"]
    assert names("a - b,c") == ["a___b", "c"]
    assert names("id,, ") == ["id", "column_2", "column_3"]
    assert names("column_2,,x") == ["column_2", "column_2_", "x"]
    assert names("n,n,n") == ["n", "n2", "n3"]
    assert names("n,n", duplicate_header_suffix="_") == ["n", "n_2"]
    assert names("A b,C", keep_original_headers=True) == ["A b", "C"]
    assert names("A,B", downcase_header=False) == ["A", "B"]
    assert names("#a,b", comment_regexp="^#") == ["a", "b"]
    assert names("a,b,c", key_mapping={"a": "x", "b": None}) == ["x", None, "c"]
    assert names("a,b", key_mapping={"a": "x"}, remove_unmapped_keys=True) == ["x", None]
    assert names("a,b", user_provided_headers=["X", "Y"], headers_in_file=True) == ["X", "Y"]


@pytest.mark.parametrize(
    ("line", "options", "error"),
    [
        ("n,n,n2", {}, E.DuplicateHeaders), ("a,b", {"required_keys": ["z"]}, E.MissingKeys), ("a,b", {"key_mapping": {"z": "y"}}, E.KeyMappingError),
        ("", {}, E.EmptyFileError), ("a,b", {"user_provided_headers": ["x"], "headers_in_file": True}, E.HeaderSizeMismatch),
        (None, {"headers_in_file": False}, E.IncorrectOption), ('a,"b', {}, E.MalformedCSV), ("a,b", {"key_mapping": {}}, E.IncorrectOption),
    ],
)
def test_header_errors(line, options, error):
    with pytest.raises(error):
        names(line, **options)


def test_silenced_keys():
    assert names("a", key_mapping={"a": "x", "z": "y"}, silence_missing_keys=True) == ["x"]
    assert names("a", key_mapping={"a": "x", "z": "y"}, silence_missing_keys=["z"]) == ["x"]


# --- options


def test_options():
    with pytest.raises(E.ValidationError) as e:
        O(col_sep="", quote_char="xx", quote_escaping="no", on_bad_row="no", field_size_limit=0)
    assert str(e.value).count(";") == 4
    assert O(strict=True).missing_headers == "raise"
    assert O(required_headers=["a"]).required_keys == ["a"]
    assert O(only_headers="a").headers == {"only": ["a"]}
    assert O(auto_row_sep_chars=3).auto_row_sep_chars == 4096
    assert O(auto_row_sep_chars=10**6).auto_row_sep_chars == 65536
    with pytest.raises(E.ValidationError):
        O(headers={"only": ["a"], "except": ["b"]})
    with pytest.raises(E.ValidationError):
        O(nonsense=1)


# --- values


def test_values_and_types(spark):
    got = rows(spark, "a,b,c,d\n1,2.5,x,\n007,-3,  ,0\n")
    assert got == [{"a": 1, "b": 2.5, "c": "x"}, {"a": 7, "b": -3.0, "d": 0}]
    assert rows(spark, "a\n.5\n") == [{"a": ".5"}]
    assert rows(spark, "a,b\n0,0.0\n5,1\n", remove_zero_values=True) == [{"a": 5, "b": 1.0}]
    assert rows(spark, "a,b\nNULL,1\n", nil_values_matching=r"\ANULL\z") == [{"b": 1}]
    assert rows(spark, "a,b\n1,2\n", convert_values_to_numeric={"only": ["a"]}) == [{"a": 1, "b": "2"}]
    assert rows(spark, "a,b\n1,2\n", convert_values_to_numeric=False) == [{"a": "1", "b": "2"}]


def test_wide_numbers(spark):
    r = CsvReader(spark, text="a,b,c\n12345678901234567890,0.12345678901234567,1e3\n1,2.5,4\n")
    r.dataframe()
    assert r.types == {"a": "decimal(20,0)", "b": "decimal(18,17)", "c": "double"}
    r = CsvReader(spark, text="a\n" + "9" * 50 + "\n")
    assert r.dataframe().dtypes == [("a", "string")]
    assert [w["code"] for w in r.warnings] == ["numeric_overflow"]
    assert CsvReader(spark, text="a\n1.5\n", decimal_precision="bigdecimal").dataframe().dtypes == [("a", "decimal(2,1)")]


def test_empty_values_kept(spark):
    assert rows(spark, "a,b,c\n1,,\n2\n", remove_empty_values=False, convert_values_to_numeric=False) == [{"a": "1", "b": "", "c": ""}, {"a": "2", "b": None, "c": None}]


def test_blank_rows(spark):
    assert len(rows(spark, "a,b\n,\n\n \n1,2\n")) == 1


def test_converters_and_schema(spark):
    from rowsmith.functions import converters as C

    got = rows(spark, "d,m,s\n05.02.2024,\"$1,234.50\",7\n", value_converters={"d": C.date("dd.MM.yyyy"), "m": C.money()}, schema={"s": "int"})
    assert str(got[0]["d"]) == "2024-02-05" and str(got[0]["m"]) == "1234.50" and got[0]["s"] == 7


def test_cell_typing(spark):
    df = rowsmith.parse(spark, "a,b\n1,x\ny,2.5\n", typing="cell")
    assert df.selectExpr("schema_of_variant(a) AS k").toPandas().k.tolist() == ["BIGINT", "STRING"]


# --- rows


def test_extra_and_missing_columns(spark):
    assert rows(spark, "a,b\n1\n1,2,3\n") == [{"a": 1}, {"a": 1, "b": 2, "column_3": 3}]
    with pytest.raises(E.HeaderSizeMismatch):
        rows(spark, "a,b\n1,2,3\n", missing_headers="raise")


def test_column_selection(spark):
    assert rows(spark, "a,b,c\n1,2,3\n", headers={"only": ["c", "a"]}) == [{"a": 1, "c": 3}]
    assert rows(spark, "a,b,c\n1,2,3\n", headers={"except": "b"}, with_line_numbers=True) == [{"a": 1, "c": 3, "csv_line_number": 2}]


def test_bad_rows(spark):
    text = 'a,b\n1,2\n3,4,5\n"open,6\n7,8\n'
    with pytest.raises(E.MalformedCSV):
        rows(spark, text)
    r = CsvReader(spark, text=text, missing_headers="raise", on_bad_row="collect")
    assert list(r.each()) == [{"a": 1, "b": 2}]
    bad = r.errors.orderBy("file_line_number").collect()
    assert [(x["file_line_number"], x["file_lines_consumed"], x["error_class"]) for x in bad] == [(3, 1, "HeaderSizeMismatch"), (4, 2, "MalformedCSV")]
    assert bad[1]["raw_logical_line"] == '"open,6\n7,8'
    with pytest.raises(E.TooManyBadRows):
        rows(spark, text, missing_headers="raise", on_bad_row="skip", bad_row_limit=1)
    seen = []
    rows(spark, text, missing_headers="raise", on_bad_row=seen.append)
    assert len(seen) == 2
    assert len(rows(spark, "a\nxx\nxxxx\n", field_size_limit=3, on_bad_row="skip")) == 1


def test_files(spark, put):
    p = put("a.csv", 'skip me\nName;Note\nBob;"two\nlines"\n#Eve;x\nEve;y\n')
    r = CsvReader(spark, p, skip_lines=1, comment_regexp="^#", with_line_numbers=True)
    assert (r.row_sep, r.col_sep, r.raw_header) == ("\n", ";", "Name;Note")
    assert list(r.each()) == [{"name": "Bob", "note": "two\nlines", "csv_line_number": 3}, {"name": "Eve", "note": "y", "csv_line_number": 5}]


def test_bom_gzip_encodings(spark, put, tmp_path):
    assert list(CsvReader(spark, put("b.csv", "﻿a,b\n1,é\n")).each()) == [{"a": 1, "b": "é"}]
    assert list(CsvReader(spark, put("u16.csv", "﻿a,b\n1,é\n", "utf-16-le")).each()) == [{"a": 1, "b": "é"}]
    assert list(CsvReader(spark, put("l1.csv", "a,b\n1,é\n", "latin-1"), file_encoding="latin-1").each()) == [{"a": 1, "b": "é"}]
    assert list(CsvReader(spark, put("bad.csv", b"a,b\n1,x\xffy\n"), force_utf8=True).each()) == [{"a": 1, "b": "xy"}]
    assert list(CsvReader(spark, put("bad2.csv", b"a,b\n1,x\xffy\n"), force_utf8=True, invalid_byte_sequence="?").each()) == [{"a": 1, "b": "x?y"}]
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("a,b\n1,2\n")
    assert list(CsvReader(spark, str(tmp_path / "z.csv.gz")).each()) == [{"a": 1, "b": 2}]


def test_partitions_do_not_matter(spark, put):
    body = "".join(f"{i},v{i % 7}\n" for i in range(2000))
    p = put("big.csv", "k,v\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    out = []
    for size in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        out.append([tuple(r) for r in CsvReader(spark, p, with_line_numbers=True).sequenced().orderBy("row_seq").collect()])
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert out[0] == out[1]
    assert out[0][0] == (0, "v0", 2, 1) and out[0][-1] == (1999, "v4", 2001, 2000)


def test_many_files(spark, put):
    os.makedirs(put("d", "") + "s")
    folder = put("d", "") + "s"
    for n in "ab":
        with open(f"{folder}/{n}.csv", "w") as f:
            f.write(f"x,y\n1,{n}\n2,{n}\n")
    assert sorted(tuple(r) for r in rowsmith.read(spark, f"{folder}/*.csv").collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]


def test_chunks_and_hooks(spark):
    text = "a\n" + "".join(f"{i}\n" for i in range(7))
    seen = []
    r = CsvReader(spark, text=text, chunk_size=3, on_start=lambda x: seen.append("start"), on_chunk=lambda x: seen.append(x["rows_in_chunk"]), on_complete=lambda x: seen.append(x["total_rows"]))
    assert r.process(lambda part, i: None) == 3
    assert seen == ["start", 3, 3, 1, 7]
    assert [i for _, i in CsvReader(spark, text=text).each_chunk(4)] == [0, 1]
    assert len(CsvReader(spark, text=text).process()) == 7
    r = CsvReader(spark, text=text)
    list(r.each_chunk())
    assert [w["code"] for w in r.warnings] == ["chunk_size_default"]
    assert CsvReader(spark, text=text).chunked(3).groupBy("chunk_index").count().orderBy("chunk_index").toPandas()["count"].tolist() == [3, 3, 1]


def test_parse_column_status(spark):
    df = spark.createDataFrame([(1, "a,1"), (2, '"x'), (3, "b,2,3"), (4, " , ")], "id int, v string")
    got = rowsmith.parse_column(df, "v", ["n", "k"], keep=["id"], types={"k": "bigint"}, status="s", missing_headers="raise").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", 1, "ok"), (2, None, None, "malformed"), (3, "b", 2, "extra_columns")]


def test_data_source(spark, put):
    from rowsmith.sources.datasource import RowsmithSource

    spark.dataSource.register(RowsmithSource)
    p = put("s.csv", 'Name,Note\nBob,"two\nlines"\n\nEve,\n')
    assert [tuple(r) for r in spark.read.format("rowsmith").load(p).collect()] == [("Bob", "two\nlines"), ("Eve", None)]


# --- writing


def test_writer(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', None), (2, "a,b", "")], "id int, t string, n string")
    assert rowsmith.to_csv_string(df) == 'id,t,n\n1,"say ""hi""",\n2,"a,b",\n'
    assert rowsmith.to_csv_string(df.limit(1), force_quotes=True, write_nil_value="-", col_sep=";") == '"id";"t";"n"\n"1";"say ""hi""";"-"\n'
    assert rowsmith.to_csv_string(df.limit(1), headers=["t", "id", "zz"], map_headers={"id": "key"}, discover_headers=False, quote_headers=True) == '"t","key","zz"\n"say ""hi""",1,\n'
    p = str(tmp_path / "o.csv")
    rowsmith.write(df, p, order=["id"], write_bom=True, row_sep="\r\n")
    assert open(p, newline="", encoding="utf-8").read() == '﻿id,t,n\r\n1,"say ""hi""",\r\n2,"a,b",\r\n'
    assert not os.path.exists(p + ".parts")


def test_generate(spark):
    assert rowsmith.generate(spark, [{"a": 1}, [[{"b": "x"}], None]]) == "a,b\n1,\n,x\n"
    assert rowsmith.generate(spark, lambda w: w << {"a": 1} << {"a": 2}) == "a\n1\n2\n"
    with pytest.raises(E.InvalidInputData):
        rowsmith.generate(spark, [1])


def test_maps_to_columns(spark):
    from rowsmith.operators.writer import from_maps

    df = spark.createDataFrame([({"x": "1", "y": "2"},), ({"y": "3", "z": "4"},)], "m map<string,string>")
    assert sorted(from_maps(df, "m").columns) == ["x", "y", "z"]


@pytest.mark.parametrize("gz", [False, True])
@pytest.mark.parametrize("preamble", [0, 3])
def test_header_past_the_sniffed_beginning(spark, put, preamble, gz):
    """Header lines and preambles longer than the 64 KB that are sniffed."""
    names = [f"{'long_' * 900}{i}" for i in range(20 if not preamble else 3)]
    body = "".join(f"note {i} " + "x" * 120_000 + "\n" for i in range(preamble)) + ",".join(names) + "\n" + ",".join(str(i) for i in range(len(names))) + "\n"
    path = put("wide.csv.gz" if gz else "wide.csv", gzip.compress(body.encode()) if gz else body)
    reader = CsvReader(spark, path, skip_lines=preamble or None, row_sep="\n", col_sep=",", missing_headers="raise")
    assert reader.headers == names
    assert [r[names[-1]] for r in reader.dataframe().select(names[-1]).collect()] == [len(names) - 1]


def test_data_source_header_past_the_sniffed_beginning(put):
    from rowsmith.sources.datasource import RowsmithSource

    names = [f"a_rather_long_column_name_{i:05d}" for i in range(3000)]
    path = put("wide.csv", "note\n" + ",".join(names) + "\n" + ",".join("1" for _ in names) + "\n")
    assert RowsmithSource({"path": path, "skip_lines": "1"}).schema().fieldNames() == names


def test_data_source_bad_rows_comments_and_limits(put):
    """Bad rows raise unless skipped; comments and the size limit count."""
    from rowsmith.sources.datasource import RowsmithSource

    def read(path, **options):
        source = RowsmithSource({"path": path, "row_sep": "\n", "col_sep": ",", **options})
        reader = source.reader(source.schema())
        return [r for p in reader.partitions() for r in reader.read(p)]

    open_quote = put("open.csv", 'a,b\n1,2\n3,"x\n5,6\n')
    with pytest.raises(E.MalformedCSV, match="line 3"):
        read(open_quote)
    assert read(open_quote, on_bad_row="skip") == [("1", "2")]
    assert read(put("c.csv", "a,b\n#1,2\n3,4\n"), comment_regexp="^#") == [("3", "4")]
    with pytest.raises(E.FieldSizeLimitExceeded):
        read(put("long.csv", "a,b\n1," + "x" * 50 + "\n"), field_size_limit="10")
    with pytest.raises(E.ValidationError):
        read(open_quote, on_bad_row="collect")


# --- streaming


def test_stream_drops_only_the_first_line(spark, put, tmp_path):
    """A data row that equals the header stays; the header goes from each file."""
    from rowsmith.streaming import stream

    (tmp_path / "in").mkdir()
    put("in/a.csv", "\ufeffid, Name\n1,x\nid,name\n2,y\n")
    put("in/b.csv", "id,name\n3,z\n")
    put("in/c.csv", "4,w\nid,name\n")
    got = []
    query = stream.import_chunks(stream.read_stream(spark, str(tmp_path / "in"), ["id", "name"], types={}), lambda df, _: got.extend((r["id"], r["name"]) for r in df.collect()), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert sorted(got, key=str) == sorted([("1", "x"), ("id", "name"), ("2", "y"), ("3", "z"), ("4", "w"), ("id", "name")], key=str)


@pytest.mark.parametrize("raw", [True, False])
def test_bad_rows_reach_the_callback_in_few_bytes(spark, tmp_path, monkeypatch, raw):
    for k in range(2):
        (tmp_path / f"f{k}.csv").write_text("a,b\n" + "".join(f"{i},x{',y' * (i % 3 == 0)}\n" for i in range(9000)))
    sent, seen = [], []
    frames = type(spark.range(1))
    local = frames.toLocalIterator

    def counted(df, *args, **options):
        for r in local(df, *args, **options):
            sent.append(len(pickle.dumps(tuple(r))))
            yield r

    monkeypatch.setattr(frames, "toLocalIterator", counted)
    r = CsvReader(spark, str(tmp_path), col_sep=",", missing_headers="raise", collect_raw_lines=raw, on_bad_row=seen.append)
    r.dataframe()
    assert len(seen) == r.bad_row_count == 6000 and sum(sent) < 20 * len(seen)
    assert seen == [x.asDict() for x in r.errors.orderBy("file", "file_line_number").collect()]
    assert list(seen[0]) == r.errors.columns


def test_bad_rows_of_several_kinds_and_lines_reach_the_callback(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\n1,"x\ny"\n2,"p\nq",z\n3,é,ü\n4,5\n6,' + "x" * 30 + '\n7,"open\nrest\n')
    seen = []
    r = CsvReader(spark, str(tmp_path / "m.csv"), col_sep=",", missing_headers="raise", field_size_limit=20, on_bad_row=seen.append)
    r.dataframe()
    assert [(x["file_line_number"], x["csv_line_number"], x["file_lines_consumed"], x["error_class"], x["raw_logical_line"]) for x in seen] == [
        (4, 3, 2, "HeaderSizeMismatch", '2,"p\nq",z'), (6, 4, 1, "HeaderSizeMismatch", "3,é,ü"), (8, 6, 1, "FieldSizeLimitExceeded", "6," + "x" * 30),
        (9, 7, 2, "MalformedCSV", '7,"open\nrest')]
    assert seen == [x.asDict() for x in r.errors.orderBy("file_line_number").collect()]


def test_bad_rows_that_are_no_utf8_reach_the_callback(spark, put):
    seen = []
    r = CsvReader(spark, put("l.csv", b"a,b\n1,2\n3,\xe9,\xff\xc3\n4,caf\xc3\xa9,5\n"), col_sep=",", missing_headers="raise", on_bad_row=seen.append)
    r.dataframe()
    assert [x["raw_logical_line"] for x in seen] == ["3,\ufffd,\ufffd\ufffd", "4,café,5"]
    assert seen == [x.asDict() for x in r.errors.orderBy("file_line_number").collect()]

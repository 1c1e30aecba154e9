"""Joining records in parallel against framing them in sequence."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rowsmith.functions.dialect import Dialect, frame
from rowsmith.operators import records
from rowsmith.sources.reader import CsvReader


def lines_of(spark, texts):
    rows = [(f, i + 1, x) for f, text in texts.items() for i, x in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, file_line long, raw string")


def both(spark, texts, d, comment=None, stretch=100_000):
    lines = lines_of(spark, texts)
    a = records.joined(lines, d, comment, 1, stretch)
    b = records.stitched(lines, d, comment)
    key = lambda df: sorted((r["file"], r["file_line"], r["csv_line"], r["n_lines"], r["raw"], tuple(r["fields"] or ()), r["status"]) for r in df.collect())
    return key(a), key(b)


@pytest.mark.parametrize("escaping", ["double_quotes", "backslash", "auto"])
@pytest.mark.parametrize("boundary", ["standard", "legacy"])
@pytest.mark.parametrize("stretch", [1, 3, 100_000])
def test_joined_equals_stitched(spark, escaping, boundary, stretch):
    rng = random.Random(stretch)
    alphabet = ['"', ",", "a", "\n", "\n", " ", "#", '""', '","', '"\n'] + (["\\", '\\"'] if escaping != "double_quotes" else [])
    texts = {f"f{k}": "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for k in range(60)}
    for comment in (None, r"\A#"):
        a, b = both(spark, texts, Dialect(",", escaping=escaping, boundary=boundary), comment, stretch)
        assert a == b


@pytest.mark.parametrize("stretch", [1, 2, 100_000])
def test_doubled_quotes_at_line_ends(spark, stretch):
    rng = random.Random(stretch)
    quoted = lambda: '"' + "".join(rng.choice(['""', '""\n', "a", ",", "\n"]) for _ in range(rng.randint(0, 6))) + '"'
    texts = {f"f{k}": "\n".join(f"{i},{quoted()}" for i in range(8)) for k in range(40)}
    texts |= {f"g{k}": x.replace('"\n', rng.choice(['\n', '""\n', '"x\n']), 2) for k, x in enumerate(list(texts.values()))}
    for escaping in ("double_quotes", "auto"):
        a, b = both(spark, texts, Dialect(",", escaping=escaping), None, stretch)
        assert a == b
        assert all(len(r[5]) == 2 and r[6] == "ok" for r in a if r[0].startswith("f")) and sum(r[0].startswith("f") for r in a) == 320


@pytest.mark.parametrize(("text", "want"), [
    ('k,v\n1,"say ""x""\nfoo"\n2,b\n', [(1, 'say "x"\nfoo'), (2, "b")]), ('k,v\n1,"x""\n2,b\n3,"c"\n', [(1, 'x"'), (2, "b"), (3, "c")]),
    ('k,v\n1,"a\n# b ""x""\nfoo"\n2,b\n', [(1, 'a\n# b "x"\nfoo'), (2, "b")])])
@pytest.mark.parametrize("options", [{}, {"quote_escaping": "double_quotes"}, {"comment_regexp": r"\A#"}])
def test_reading_doubled_quotes_at_line_ends(spark, tmp_path, text, want, options):
    p = tmp_path / "q.csv"
    p.write_text(text)
    assert [tuple(r.values()) for r in CsvReader(spark, str(p), col_sep=",", **options).each()] == want
    assert [tuple(r.values()) for r in CsvReader(spark, text=text, col_sep=",", **options).each()] == want


def test_swallowed_files_are_counted_not_gathered(spark):
    text = '"a\nb"\n1,2\n"open\n' + "x\n" * 50
    found = records.joined(lines_of(spark, {"f": text}), Dialect(",", escaping="double_quotes"), None, 1, most=40).orderBy("csv_line").collect()
    assert [(r["file_line"], r["n_lines"], r["status"], r["raw"]) for r in found] == [(1, 2, "ok", '"a\nb"'), (3, 1, "ok", "1,2"), (4, 52, "malformed", None)]


def test_limit_cuts_only_the_files_that_it_meets(spark, tmp_path):
    for i, text in enumerate(('k,v\n1,"a\nb"\n', 'k,v\n2,"' + "y\n" * 30 + '"\n3,z\n')):
        (tmp_path / f"f{i}.csv").write_text(text)
    r = CsvReader(spark, str(tmp_path), col_sep=",", field_size_limit=20, on_bad_row="collect")
    got = [(x["k"], x.get("v")) for x in r.each()]
    # the record ends where it grows too large; its other lines are rows, up to its closing quote, which opens a record
    assert got[0] == ("1", "a\nb") and got[1:] and set(got[1:]) == {("y", None)}
    assert sorted(x["error_class"] for x in r.errors.collect()) == ["FieldSizeLimitExceeded", "MalformedCSV"]


def test_no_quotes_or_only_one(spark):
    for text in ("", "a\nb", '"', 'x\n"\ny', '"a\n"\n"b\n"'):
        a, b = both(spark, {"f": text}, Dialect(",", escaping="double_quotes"), None, 2)
        assert a == b, text


def test_reader_numbers_joined_records(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('k,v\n1,"a\nb"\n2,"c"\n3,"d\n\ne"\n')
    r = CsvReader(spark, str(p), with_line_numbers=True)
    assert list(r.each()) == [
        {"k": 1, "v": "a\nb", "csv_line_number": 2}, {"k": 2, "v": "c", "csv_line_number": 3}, {"k": 3, "v": "d\n\ne", "csv_line_number": 4}]
    assert (r.csv_line_count, r.file_line_count) == (4, 7)
    got = [r["m"] for r in r.sparse("row").select(F.map_keys("row").alias("m")).collect()]
    assert all(sorted(x) == ["csv_line_number", "k", "v"] for x in got)


def test_streams_and_last_warnings(spark):
    import io

    import rowsmith

    assert list(CsvReader(spark, io.StringIO("a,b\n1,2\n")).each()) == [{"a": 1, "b": 2}]
    assert list(CsvReader(spark, io.BytesIO("a\né\n".encode())).each()) == [{"a": "é"}]
    CsvReader(spark, text="abc")
    assert [w["code"] for w in rowsmith.last_warnings()] == ["no_row_sep_found"]
    CsvReader(spark, text='a\n"x', on_bad_row="collect").dataframe()
    assert rowsmith.last_errors().count() == 1
    assert re.search("quoted", rowsmith.last_errors().first()["error_message"])


def test_closing_a_reader_deletes_what_it_wrote(spark, tmp_path):
    import os

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    p = tmp_path / "m.csv"
    p.write_text('k,v\n1,"a\nb"\n')
    before = set(os.listdir(shared))
    with CsvReader(spark, str(p)) as r:
        assert list(r.each()) == [{"k": 1, "v": "a\nb"}] and set(os.listdir(shared)) > before
    assert set(os.listdir(shared)) == before


def test_diagnostics(spark):
    from rowsmith.functions import tokenizer

    df = spark.createDataFrame([('a"b\\"c""',)], "v string")
    d = Dialect(",")
    row = df.select(
        tokenizer.quote_count(F.col("v"), d).alias("n"), tokenizer.quote_count(F.col("v"), d, True).alias("e"),
        tokenizer.take(tokenizer.fields(F.lit("a,b,c"), d), 2).alias("t"), tokenizer.as_map(["x", "y"], F.array(F.lit("1"))).alias("m"),
    ).first()
    assert (row["n"], row["e"], row["t"], row["m"]) == (4, 3, ["a", "b"], {"x": "1", "y": None})


def test_texts_in_a_column(spark):
    import rowsmith

    df = spark.createDataFrame([(7, 'n,v\n1,"a\nb"\n\n2,c\n'), (8, "n,v\n"), (9, 'n,v\n3,"open'), (10, None)], "id int, body string")
    got = rowsmith.parse_documents(df, "body", "id", ["n", "v"], types={"n": "bigint"}).orderBy("id", "n").collect()
    assert [tuple(r) for r in got] == [(7, 2, 1, "a\nb"), (7, 4, 2, "c")]

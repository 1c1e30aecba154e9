"""The state machine by example, and the token expressions against it."""

import itertools

import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowsmith.functions import tokenizer
from rowsmith.functions.dialect import Dialect, clean, frame, split

COMMA = Dialect(",")


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("a,b,c", ["a", "b", "c"]),
        ("a,,", ["a", "", ""]),
        ("", [""]),
        ('"a,b",c', ["a,b", "c"]),
        ('"a ""b"" c",d', ['a "b" c', "d"]),
        (' "a" ,b', None),
        ('6\'2",x', ["6'2\"", "x"]),
        ('"C:\\dir\\",x', ["C:\\dir\\", "x"]),
        ('"say \\"hi\\"",x', ['say \\"hi\\"', "x"]),
        ('"open,x', None),
        ('" a ",b', ["a", "b"]),
        ('"""",x', ['"', "x"]),
        ('"",x', ["", "x"]),
        ('"ab""', ["ab\""]),
        ('"a"b",c', ['a"b', "c"]),
    ],
)
def test_split(line, want):
    fields, still = split(line, COMMA)
    assert still == (want is None)
    if want is not None:
        assert fields == want


def test_escaping_modes():
    assert split('"abc\\",x', Dialect(",", escaping="backslash"))[1]
    assert split('"abc\\",x', Dialect(",", escaping="double_quotes")) == (["abc\\", "x"], False)
    assert split('"abc\\",x', COMMA) == (["abc\\", "x"], False)


def test_legacy_boundary():
    d = Dialect(",", boundary="legacy")
    assert split('a"b,c', d)[1]
    assert split('a"b,c"d,e', d) == (['a"b,c"d', "e"], False)


def test_no_strip():
    assert split('a," b "', Dialect(",", strip=False))[0] == ["a", " b "]
    assert split(' a ,b', Dialect(",", strip=False))[0] == [" a ", "b"]


def python_tokens(line, d, backslash):
    found = [m.group(0) for m in tokenizer.python_pattern(d, backslash).finditer(d.col_sep + line)]
    if sum(map(len, found)) != len(d.col_sep + line):
        return None
    return [clean(x[len(d.col_sep):], d) for x in found]


def by_tokens(line, d):
    if d.quote not in line:
        return split(line, d)[0]
    if d.escaping == "double_quotes" or "\\" not in line:
        return python_tokens(line, d, False)
    found = python_tokens(line, d, True)
    return python_tokens(line, d, False) if found is None and d.escaping == "auto" else found


@pytest.mark.parametrize("escaping", ["auto", "double_quotes", "backslash"])
@pytest.mark.parametrize("sep", [",", "::", "\t", " "])
@pytest.mark.parametrize("strip", [True, False])
def test_tokens_equal_the_state_machine(escaping, sep, strip):
    d = Dialect(sep, escaping=escaping, strip=strip)
    for n in range(6):
        for x in itertools.product('"a \\' + sep[0], repeat=n):
            line = "".join(x)
            fields, still = split(line, d)
            assert by_tokens(line, d) == (None if still else fields), line


@given(st.lists(st.text(alphabet='ab",;\\ \n', max_size=6), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_written_records_come_back(values):
    assume(not any('"\n' in v for v in values))  # a doubled quote at a line's end may close the field: leniency wins
    d = Dialect(",", escaping="double_quotes", strip=False)
    line = ",".join('"' + v.replace('"', '""') + '"' for v in values)
    records = list(frame(line.split("\n"), d))
    assert [r.status for r in records] == ["ok"]
    # doubled quotes inside a field that was itself doubled stay what the writer meant
    assert records[0].fields == values


@given(st.lists(st.lists(st.text(alphabet='a"\n, ', max_size=6), min_size=2, max_size=2), min_size=1, max_size=4), st.sampled_from(["double_quotes", "auto"]))
@settings(max_examples=300, deadline=None)
def test_written_quotes_before_line_ends_come_back(rows, escaping):
    lines = "\n".join(",".join('"' + v.replace('"', '""') + '"' for v in r) for r in rows).split("\n")
    assert [r.fields for r in frame(lines, Dialect(",", escaping=escaping, strip=False))] == rows


@pytest.mark.parametrize("rest", ["", "\n2,x", '\n2,x\n3,"y"', '\n2,"x ""y""\nz"', '\n2,""\n3,"y"'])
def test_a_doubled_quote_that_nothing_closes_ends_its_field(rest):
    found = list(frame(('1,"ab""' + rest).split("\n"), Dialect(",", escaping="double_quotes")))
    assert found[0].fields == ["1", 'ab"'] and {r.status for r in found} == {"ok"}


def test_spark_splits_like_python(spark):
    lines = ['a,b', '"a,b",c', '"x ""y""",z', '"open,x', ' " s " ,t', 'q"r,s', '"C:\\",x', '"\\"",x', ",,", "", '"é,ü",日本']
    for escaping in ("auto", "double_quotes", "backslash"):
        d = Dialect(",", escaping=escaping)
        df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, v string")
        got = {r["i"]: r["f"] for r in df.select("i", tokenizer.fields(F.col("v"), d).alias("f")).collect()}
        for i, x in enumerate(lines):
            fields, still = split(x, d)
            assert got[i] == (None if still else fields), x


def test_frame_numbers_comments_and_limits():
    import re

    text = 'a,b\n# note\n"x\n# not a comment\ny",2\n\n"open\nrest'
    records = list(frame(text.split("\n"), COMMA, re.compile("^#")))
    assert [(r.file_line, r.csv_line, r.n_lines, r.status) for r in records] == [
        (1, 1, 1, "ok"), (3, 3, 3, "ok"), (6, 4, 1, "ok"), (7, 5, 2, "malformed")]
    assert records[1].fields == ["x\n# not a comment\ny", "2"]
    big = list(frame(['"' + "x" * 50, "y" * 50, '"'], COMMA, limit=60))
    assert big[0].status == "field_too_large"

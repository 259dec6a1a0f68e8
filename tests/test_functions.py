import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skarn.functions import positions
from skarn.functions.predicates import CAMELCASE, EXACT, PATTERN, PREFIX, ellipsis, has_modifier, matches_name, package_of
from skarn.operators.navigation import offset_of, position_of


def test_name_rules(spark):
    cases = [
        ("MyClass", "MyClass", EXACT, True), ("MyClass", "My", PREFIX, True), ("MyClass", "My*", PATTERN, True), ("MyClass", "My?lass", PATTERN, True),
        ("MyClass", "Class", PREFIX, False), ("MyLongClassName", "MLC", CAMELCASE, True), ("MyLongClassName", "MLCN", CAMELCASE, True), ("MyLongClassName", "mcn", CAMELCASE, True),
        ("myLong", "ml", CAMELCASE, False), ("", "", CAMELCASE, True), ("A", "", CAMELCASE, False), ("axb", "a.b", PATTERN, True), ("ab\n", "ab", PATTERN, False),
        (None, "a", EXACT, False), (None, "a", CAMELCASE, False), ("a", None, PREFIX, False), ("a", "a", None, True),
    ]
    for name, pattern, rule, expected in cases:
        df = spark.createDataFrame([(name,)], "n string")
        assert df.select(matches_name(F.col("n"), pattern, rule)).first()[0] is expected, (name, pattern, rule)


def test_camel_case_is_a_subsequence_of_capitals(spark):
    names = ["MyLongClassName", "HTTPServer", "a", "ABC", "aBcD", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for p in ["ML", "hs", "hts", "ac", "cba", "bd", "x"]:
        got = {r[0]: r[1] for r in df.select("n", matches_name(F.col("n"), p, CAMELCASE)).collect()}
        for n in names:
            capitals = iter(c.lower() for c in n if c.isupper())
            assert got[n] == all(c in capitals for c in p.lower()), (n, p)


def test_ellipsis_and_modifiers(spark):
    df = spark.createDataFrame([("x" * 51, 9), ("y" * 50, 1)], "s string, m int")
    rows = df.select(ellipsis(F.col("s")), has_modifier(F.col("m"), "public", "static")).collect()
    assert rows[0][0] == "x" * 47 + "..." and rows[0][1] is True
    assert rows[1][0] == "y" * 50 and rows[1][1] is False


def test_package_of(spark):
    cases = {"/p/src/main/java/a/b/C.java": "a.b", "/p/src/test/java/C.java": "", "/p/src/a/C.java": "a", "/p/source/a/b/C.java": "a.b", "/w/x/y/z/C.java": "x.y.z", "/C.java": "", "C.java": "", "C:\\p\\src\\main\\java\\q\\C.java": "q"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", package_of(F.col("p"))).collect()} == cases


@settings(max_examples=50, deadline=None)
@given(st.text("ab\n", max_size=30), st.integers(0, 40))
def test_positions_round_trip(text, offset):
    line, char = position_of(text, offset)
    assert offset_of(text, line, char) == min(offset, len(text))


def test_position_columns_agree(spark):
    texts = ["", "a", "ab\ncd\n\nxyz", "\n\n", "line one\nline two"]
    cases = [(t, o, line, c) for t in texts for o in range(0, 12, 2) for line, c in ((0, 0), (1, 1), (2, 0), (3, 5), (9, 0))]
    df = spark.createDataFrame(cases, "t string, o int, l int, c int")
    out = df.select("*", positions.line_of(F.col("t"), F.col("o")).alias("gl"), positions.char_of(F.col("t"), F.col("o")).alias("gc"), positions.position_to_offset(F.col("t"), F.col("l"), F.col("c")).alias("go")).collect()
    for r in out:
        assert (r.gl, r.gc) == position_of(r.t, r.o)
        assert r.go == offset_of(r.t, r.l, r.c)


def test_glob_is_a_whole_string_match():
    from skarn.functions.predicates import _glob

    assert re.fullmatch(_glob("a*c?").replace("\\z", "\\Z"), "abbcd")

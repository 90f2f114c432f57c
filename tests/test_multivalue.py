import pytest

from hybridrank.operators.multivalue import explode_values, split_values

CASES = {
    "/a b/c d/": ["a b", "c d"],
    '"x, y", "p; q","z"': ["x, y", "p; q", "z"],
    'a "x; y" b; c': ['a "x; y" b', "c"],
    "(w; u) k / l": ["(w; u) k", "l"],
    "1. a b 2. c d 3. e": ["a b", "c d", "e"],
    "(1) a (2) b": ["a", "b"],
    "①a ②b": ["a", "b"],
    "- a\n- b-c": ["a", "b-c"],
    "* a\n* b": ["a", "b"],
    "a\\; b; c": ["a; b", "c"],
    "a • b": ["a", "b"],
    "x<br>y": ["x", "y"],
    "a||b|c": ["a", "b", "c"],
    "“p / q”/r": ["p / q", "r"],
    "he “it’s; x” y; z": ["he “it’s; x” y", "z"],
    'a 5" b; c': ['a 5" b', "c"],
    "no. 39 #8; k": ["no. 39 #8", "k"],
    '"a ""b; c"" d"; e': ['a "b; c" d', "e"],
    "(a; b": ["(a", "b"],
    "a) ; b": ["a)", "b"],
    "(x [y; z) w] ; v": ["(x [y; z) w]", "v"],
    "to wait 2. b": ["to wait 2. b"],
    '"a", "b" c': ['"a", "b" c'],
    "【a；b】；c": ["【a；b】", "c"],
    "": [],
    " ;； / ": [],
    '"";"x"': ["x"],
    "one, two. three: four": ["one, two. three: four"],
}


@pytest.fixture(scope="module")
def split(spark):
    df = spark.createDataFrame([(c,) for c in [*CASES, None]], "c string")
    return {r["c"]: r["v"] for r in df.withColumn("v", split_values("c")).collect()}


def test_cases(split):
    assert {k: v for k, v in split.items() if k is not None} == CASES
    assert split[None] is None


def test_rows_and_positions(spark):
    df = spark.createDataFrame([(1, "a;b", "v", 9), (1, "a;b", "v", 9), (2, None, "v", 9), (3, " / ", "v", 9)], "k int, c string, value string, value_pos int")
    got = explode_values(df, "c").collect()
    assert sorted((r["k"], r["value_pos"], r["value"]) for r in got) == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]
    assert explode_values(df.limit(0), "c").count() == 0


def test_long_cells(spark):
    n = 3_000
    df = spark.createDataFrame([("w;" * n,), ("ab " * n,), ('"' + "x;" * n + '"; y',)], "c string")
    assert [r["n"] for r in df.selectExpr("c").withColumn("v", split_values("c")).selectExpr("size(v) AS n").collect()] == [n, 1, 2]

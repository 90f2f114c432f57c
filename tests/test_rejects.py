from hybridrank.operators.rejects import load_lines

SYL = ["shi", "ren", "lü"]


def load(spark, rows, schema="line_no long, raw_line string"):
    return load_lines(spark.createDataFrame(rows, schema), spark.createDataFrame([(s,) for s in SYL], "syllable string"))


def reasons(spark, line):
    got = load(spark, [(1, line)]).rejected.collect()
    return {r["column"] for r in got[0]["reasons"]} if got else set()


def test_valid_lines(spark):
    lines = ["石 石 [shi2] /stone/", "人石 人石 [Ren2 SHI4] /a/ /b (c) [d] \"e\"/\r", "A綠，人 A绿，人 [A lu:4 , ren5] /x//", "石 石 [shi2] /see also 人石|人石[ren2 shi2]/"]
    got = load(spark, list(enumerate(lines)))
    assert got.rejected.count() == 0
    rows = {r["line_no"]: r for r in got.clean.collect()}
    assert rows[1]["definitions"] == ["a", 'b (c) [d] "e"'] and rows[2]["pinyin"] == "A lu:4 , ren5"


def test_reasons(spark):
    assert reasons(spark, "石 [shi2] /stone/") == {"line"}
    assert reasons(spark, "石  石 [shi2] /stone/") == {"line"}
    assert reasons(spark, "石人 石 [shi2 ren2] /x/") == {"simplified"}
    assert reasons(spark, "石 石 [shi6] /x/") == {"pinyin item"}
    assert reasons(spark, "石 石 [shi2 ren2] /x/") == {"pinyin"}
    assert reasons(spark, "石 石 [shi2] / /") == {"definitions"}
    assert reasons(spark, "石 石 [shi2] /(a/b)/") == {"definition"}
    assert reasons(spark, '石 石 [shi2] /"a/') == {"definition"}
    assert reasons(spark, "石 石 [shi2] /a/ 人 人 [ren2] /b/") == {"definition"}
    assert reasons(spark, "ア 石 [shi2] /a/") == {"traditional", "pinyin item"}


def test_nulls_blanks_repeats_clashes(spark):
    bad, good = "石 [shi2] /x/", "石 石 [shi2] /x/"
    rows = [(None, bad, 1, "k"), (None, bad, 1, "k"), (None, good, 1, "k"), (1, None, 2, "k"), (2, "  ", 2, None), (3, "# note", 2, "k"), (4, "", 2, "k")]
    got = load(spark, rows, "line_no long, raw_line string, position int, k string")
    assert got.rejected.count() == 2 and got.clean.count() == 1  # a null key is a key; repeated rows share a verdict
    assert {"position", "k", "reasons"} <= set(got.rejected.columns)


def test_empty_and_long(spark):
    got = load(spark, [], "line_no long, raw_line string")
    assert got.clean.count() == got.rejected.count() == 0
    long = "石 石 [shi2] /" + "(a)/" * 5_000
    assert load(spark, [(1, long)]).clean.count() == 1

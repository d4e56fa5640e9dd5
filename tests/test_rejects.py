from terrane.operators import rejects

GOOD = "1,500000,6500000,2020,1,GBIF,Winter,2020-Winter,1,ok"
CASES = {
    2: (GOOD, None),
    3: (GOOD + "\r", None),
    4: ('1, 5e5 ," 6500000.25 ",2020.00,,,,,,"a ""b"", c\nd"', None),
    5: (" \t\r", None),
    6: ("", None),
    7: ('1,500000,6500000,2020,1,GBIF,Winter,2020-Winter,1,"open', "quoting"),
    8: ('1,500000",6500000,2020,1,GBIF,Winter,2020-Winter,1,x', "quoting"),
    9: ('1,"500000"x,6500000,2020,1,GBIF,Winter,2020-Winter,1,x', "quoting"),
    10: (' "1",500000,6500000,2020,1,GBIF,Winter,2020-Winter,1,x', "quoting"),
    11: ("1,500000,6500000", "columns"),
    12: (GOOD + ",more", "columns"),
    13: (GOOD.replace("500000,6", "1091000,6"), "value"),
    14: (GOOD.replace("500000,6", "1090999.9,6"), None),
    15: (GOOD.replace("500000,6", "500000d,6"), "value"),
    16: (GOOD.replace("500000,6", "1e400,6"), "value"),
    17: (GOOD.replace("500000,6", "NaN,6"), "value"),
    18: (GOOD.replace("500000,6", "５,6"), "value"),
    19: (GOOD.replace("2020,1", "2025,1"), "value"),
    20: (GOOD.replace("2020,1", "2020.5,1"), "value"),
    21: (GOOD.replace("500000,6", ",6"), "value"),
    22: (None, None),
    23: ('1,500000,6500000,2020,1,GBIF,Winter,2020-Winter,1,"' + '""' * 200_000 + '"', None),
    24: ("," * 100_000, "columns"),
}


def lines(spark, rows):
    return spark.createDataFrame(rows, "file_name string, line_no long, raw_line string")


def test_reasons_and_loading(spark):
    rows = [("f", 1, "occ_id,dd long")] + [("f", n, t) for n, (t, _) in CASES.items()] + [("g", None, "x"), (None, 2, "y")]
    got = {(r.file_name, r.line_no): r.reason for r in rejects.rejected(lines(spark, rows)).collect()}
    assert got == {("f", n): r for n, (_, r) in CASES.items() if r} | {("g", None): "columns", (None, 2): "columns"}
    kept = {r.line_no: r for r in rejects.loaded(lines(spark, rows)).collect()}
    assert set(kept) == {2, 3, 4, 14, 23}
    assert (kept[4]["dd long"], kept[4]["dd lat"], kept[4]["year-int"], kept[4]["remarks"]) == (5e5, 6500000.25, 2020.0, 'a "b", c\nd')
    assert kept[4]["source"] is None


def test_repeats_empty_and_extra_columns(spark):
    rows = [("f", 2, "bad"), ("f", 2, "bad")]
    extra = lines(spark, rows).selectExpr("*", "'x' as reason", "1 as fields", "2 as place")
    assert [r.reason for r in rejects.rejected(extra).collect()] == ["columns"]
    assert rejects.rejected(lines(spark, [])).count() == 0

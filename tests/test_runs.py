import json

import pytest
from pyspark.sql import functions as F

from terrane.operators import audit, runs
from terrane.sources import inventory, sinks


def test_rules_in_texts(spark):
    rules = spark.createDataFrame([("Boar",), ("no such",), ("ÉTÉ",), ("",), (None,), ("boar",)], "pattern string")
    texts = spark.createDataFrame([(1, "wild boar; BOAR"), (2, "un été"), (3, None), (4, "")], "id int, text string")
    got = {(r.pattern, r.id) for r in audit.matched_rules(rules, texts).collect()}
    assert got == {("Boar", 1), ("boar", 1), ("ÉTÉ", 2), ("no such", None), ("", None), (None, None)}
    assert audit.matched_rules(rules.limit(0), texts).count() == 0
    with pytest.raises(ValueError):
        audit.matched_rules(rules, texts, most_rules=2)


def test_sole_is_the_only_one(spark):
    v = spark.createDataFrame([("Hunting_bag",), ("Hunting_bag",), ("slope",)], "variable string")
    assert [r.variable for r in runs.sole(v, "variable", "hunt").collect()] == ["Hunting_bag"]
    with pytest.raises(Exception, match="2 values match"):
        runs.sole(v, "variable", "hunt|slope").collect()


def test_engines_in_order_and_unknown(spark):
    from terrane.functions.text import engine

    v = spark.createDataFrame([(1, " MaxEnt"), (2, "gbm "), (3, "elapid")], "k int, e string")
    assert [tuple(r) for r in runs.engines(v, engine("e"), "k").orderBy("place").collect()] == [("gbm", 1), ("elapid", 2)]
    with pytest.raises(Exception, match="unknown engine"):
        runs.engines(v.withColumn("e", F.lit("forest")), engine("e"), "k").collect()


def test_audit_of_a_scenario(spark):
    m = spark.createDataFrame([("a", "gbm", 2019, 0.5), ("a", "elapid", 2019, None), ("b", "gbm", 2019, 0.5), ("b", "gbm", 2020, 0.6)], "s string, e string, y int, auc double")
    got = {r.s: r for r in runs.audited(m, "s", "e", "y", [2019, 2020], F.col("auc").isNotNull()).collect()}
    assert got["a"].issues == "missing years: 2020 | no maps: elapid | 1 unsound runs" and got["b"].issues == "" and got["b"].maps == {"gbm": 2}


def test_shares_pairs_and_empty_tables(spark):
    p = spark.createDataFrame([("A", 2019, 0.4, None), ("A", 2020, 0.6, None), ("B", None, None, 0.5)], "source string, year int, share double, flat double")
    assert {tuple(r) for r in runs.effective_share(p).collect()} == {(2019, 0.4), (2020, 0.5)}
    n = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "v string")
    assert {tuple(r) for r in runs.unordered_pairs(n, "v").collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert runs.unordered_pairs(n.limit(0), "v").count() == 0 and runs.effective_share(p.limit(0)).count() == 0


def test_features_in_json(spark, tmp_path):
    f = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"id": 7}}, {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, "properties": {"id": 8}}, {"type": "Feature", "geometry": None, "properties": {"id": 9}}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": f}, indent=1))
    assert [tuple(r) for r in inventory.read_geojson(spark, str(tmp_path), {"id": "int"}).collect()] == [(1.5, 2.5, 7)]


def test_listing_and_years(spark, tmp_path):
    for name in ("in/2019/ndvi.tif", "in/2020/other.tif", "elsewhere/x_2020.tif"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    have = inventory.listed(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", f"^.*{tmp_path.name}/", ""))
    assert {(r.name, r.size) for r in have.collect()} == {("ndvi.tif", 1), ("other.tif", 1), ("x_2020.tif", 1)}
    got = {r.year: (r.present, r.configured, r.found) for r in inventory.yearly(have, "in/x_{year}.tif", [2019, 2020], ["in/x_2019.tif"]).collect()}
    assert got == {2019: (False, True, None), 2020: (False, False, "elsewhere/x_2020.tif")}
    assert [r.stem for r in inventory.expected_layers(have, ["in/{year}/ndvi.tif"], {"year": [2019, 2020]}).collect()] == ["ndvi"]


def test_text_is_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/a.txt"
    sinks.write_text(spark, path, "one")
    sinks.write_text(spark, path, "two é")
    assert open(path).read() == "two é" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["a.txt"]


def test_append_is_done_once(spark, tmp_path):
    path = f"{tmp_path}/log"
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    for _ in range(2):
        assert sinks.append_new(a, path, ["k"]).count() == 2
    assert {r.k for r in sinks.append_new(a.withColumn("k", F.col("k") + 1), path, ["k"]).collect()} == {1, 2, 3}


def test_archive(spark, tmp_path):
    f = spark.createDataFrame([("a", 3, "abc"), ("b", 9, "abcdefghi"), ("c", None, "x")], "name string, size int, content string")
    left = sinks.write_archive(f, f"{tmp_path}/z", 5)
    assert {(r.name, r.reason) for r in left.collect()} == {("b", "over 5 bytes"), ("c", "unknown size")}
    assert [(r.name, r.sound) for r in sinks.archive_checked(spark, f"{tmp_path}/z").collect()] == [("a", True)]

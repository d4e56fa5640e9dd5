import math
import os

import pytest
from pyspark.sql import functions as F

from terrane.functions import running
from terrane.functions.grid import Grid
from terrane.operators import layers, metrics, points, stats
from terrane.sources import tables


def scores(spark, rows):
    return spark.createDataFrame(rows, "y int, s double")


def test_auc_and_ap_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.3), (1, 0.3), (0, 0.1), (1, None), (0, math.nan)]
    known = [(y, s) for y, s in rows if s is not None and not math.isnan(s)]
    pos, neg = [s for y, s in known if y], [s for y, s in known if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(scores(spark, rows)).first().auc == pytest.approx(want)
    assert metrics.roc_auc(scores(spark, [(1, 0.5)])).first().auc is None
    assert metrics.roc_auc(scores(spark, [])).first().auc is None


def test_running_sums(spark):
    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(1).alias("v"))
    got = running.running_sums(d, "k", ["v"]).collect()
    assert all(r.run_v == r.k + 1 for r in got)
    down = running.running_sums(d, "k", ["v"], descending=True, pieces=7).collect()
    assert all(r.run_v == 1000 - r.k for r in down)


def test_student_t():
    assert stats.student_quantile(0.975, 2) == pytest.approx(4.302652729696142, abs=1e-9)
    assert stats.student_quantile(0.975, 200) == pytest.approx(1.971896224, abs=1e-6)
    assert stats.student_p(0, 5) == pytest.approx(1.0)


def test_exact_percentiles(spark):
    r = __import__("random").Random(5)
    values = [r.gauss(0, 1) for _ in range(3000)] + [2.5] * 2000 + [1e9] + [0.25] * 1500
    d = spark.createDataFrame([(v,) for v in values] + [(None,), (math.nan,), (math.inf,)], "v double").repartition(5)
    ranked = sorted(values)

    def want(q):
        at = q * (len(ranked) - 1)
        low = ranked[int(at)]
        return low + (at - int(at)) * (ranked[min(int(at) + 1, len(ranked) - 1)] - low)

    for most in (100_000, 50):
        got = stats.exact_percentiles(d, {f"p{i}": ("v", q) for i, q in enumerate((0.0, 0.01, 0.37, 0.5, 0.8, 0.99, 1.0))}, most)
        assert list(got.values()) == pytest.approx([want(q) for q in (0.0, 0.01, 0.37, 0.5, 0.8, 0.99, 1.0)])
    assert stats.exact_percentiles(d.limit(0), {"x": ("v", 0.5)}) == {"x": None}


def test_sampling_with_and_without_replacement(spark):
    from terrane.functions.hashing import uniform

    c = spark.createDataFrame([(i, float(i % 4)) for i in range(400)] + [(900, None), (901, math.nan), (902, -1.0)], "k int, w double")
    got = points.with_replacement(c, F.col("w"), 20_000, ["k"]).collect()
    assert len(got) == 20_000 and len({r.draw for r in got}) == 20_000 and not {r.k for r in got} & {900, 901, 902}
    share = {w: sum(r.w == w for r in got) / 20_000 for w in (0.0, 1.0, 2.0, 3.0)}
    assert share[0.0] == 0 and all(abs(share[w] - w / 6) < 0.02 for w in share)
    assert points.with_replacement(c.filter("w = 0"), F.col("w"), 10, ["k"]).count() == 0
    some = points.weighted_without_replacement(c, F.col("w"), uniform("k"), 0.25, ["k"]).collect()
    assert len(some) == len({r.k for r in some}) == 101 and all(r.w > 0 for r in some) and sum(r.w == 3 for r in some) > sum(r.w == 1 for r in some)
    placed = points.jittered(spark.createDataFrame([(2, 1)], "row int, col int"), Grid(0.0, 0.0, 10.0, 3, 3), "row", "col").first()
    assert 10 <= placed.x < 20 and 0 <= placed.y < 10


def test_welch_without_spread(spark):
    d = spark.createDataFrame([("v", "a", 1.0), ("v", "a", 1.0), ("v", "b", 1.0), ("v", "b", 1.0), ("w", "a", 1.0), ("w", "b", 2.0), ("z", "a", 1.0)], "g string, s string, v double")
    got = {r.g: r for r in stats.welch(d, ["g"], "s", "a", "b", "v").collect()}
    assert set(got) == {"v", "w"} and (got["v"].t, got["v"].p) == (0.0, 1.0) and got["w"].p is None and got["w"].percent == 100.0


def test_year_names(spark):
    d = spark.createDataFrame([("2018_conifers",), ("hunting_bag_2019",), ("tmax_2018_summer",), ("plain",)], "layer string")
    assert [r.b for r in d.select(layers.base_name("layer").alias("b")).collect()] == ["conifers", "hunting_bag", "tmax_summer", "plain"]


def test_grid_floor_and_missing(spark):
    g = Grid(0.0, 0.0, 10.0, 3, 3)
    d = spark.createDataFrame([(-0.5, 29.9), (25.0, 0.0), (None, 1.0), (math.nan, 1.0)], "x double, y double")
    assert [(r.row, r.col) for r in points.placed(d, g).collect()] == [(0, -1), (3, 2), (2, None), (2, None)]


def test_thinning_shares(spark):
    rows = [(i, src, i) for src in ("RRN", "GBIF") for i in range(4)]
    p = spark.createDataFrame(rows, "id int, source string, k int").withColumn("draw", F.col("k") / 4)
    policy = spark.createDataFrame([("RRN", 0.33), ("GBIF", 0.67)], "source string, share double")
    got = {r.source: r["count"] for r in points.thinned_by_policy(p, policy, ["source"], "draw", ["k"], few=0).groupBy("source").count().collect()}
    assert got == {"RRN": 1, "GBIF": 2}


def test_farthest_points_are_spread(spark):
    rows = [(i, "g", float(i), 0.0 if i else None) for i in range(11)]
    p = spark.createDataFrame(rows, "id int, g string, a double, b double")
    got = sorted(r.id for r in points.farthest_points(p, ["g"], ["a", "b"], "id", 0.3).collect())
    assert got == [0, 5, 10]


def test_farthest_points_of_a_large_group(spark):
    """A group walked over the cluster gives what one task gives."""
    r = __import__("random").Random(8)
    rows = [(i, "g" if i % 7 else None, r.gauss(0, 1), r.gauss(0, 3) if r.random() < 0.9 else None) for i in range(700)]
    p = spark.createDataFrame(rows, "id int, g string, a double, b double").repartition(4)
    want = sorted(x.id for x in points.farthest_points(p, ["g"], ["a", "b"], "id", 0.2).collect())
    for batch in (5, 60):
        assert sorted(x.id for x in points.farthest_points(p, ["g"], ["a", "b"], "id", 0.2, largest=300, batch=batch).collect()) == want


def test_greedy_walk_against_all_distances():
    """looking only into boxes that can change gives the walk over all rows, ties included."""
    import numpy as np

    r = np.random.default_rng(3)
    for x in (r.normal(size=(700, 2)), r.integers(0, 9, (700, 3)).astype(float), np.ones((50, 1))):
        want, near = [0], ((x - x[0]) ** 2).sum(1)
        near[0] = -1
        while len(want) < len(x) // 2:
            want.append(int(near.argmax()))
            near = np.minimum(near, ((x - x[want[-1]]) ** 2).sum(1))
            near[want[-1]] = -1
        assert points._greedy(x, len(x) // 2, leaf=16).tolist() == want


def test_farthest_points_that_are_equal_count_once_each(spark):
    """a group of any size gives its share, with equal places and repeated keys too, and no row twice."""
    rows = [(i % 40, i, float(i % 5), 1.0) for i in range(200)]
    p = spark.createDataFrame(rows, "id int, n int, a double, b double").repartition(3).withColumn("g", F.lit("g"))
    for largest, held in ((300, 300), (100, 300), (100, 100)):
        got = [x.n for x in points.farthest_points(p, ["g"], ["a", "b"], "id", 0.2, largest=largest, batch=7, held=held).collect()]
        assert len(got) == len(set(got)) == 40


def test_farthest_points_of_a_group_over_the_cluster(spark):
    """a group that no task holds gives what one task gives."""
    r = __import__("random").Random(9)
    p = spark.createDataFrame([(i, "g", r.gauss(0, 1), r.gauss(0, 3)) for i in range(300)], "id int, g string, a double, b double").repartition(4)
    want = sorted(x.id for x in points.farthest_points(p, ["g"], ["a", "b"], "id", 0.2).collect())
    assert sorted(x.id for x in points.farthest_points(p, ["g"], ["a", "b"], "id", 0.2, largest=10, batch=20, held=10).collect()) == want


def test_draws_look_at_each_row_once(spark):
    """no window reaches to the end of its piece, as that is summed anew for each of its rows."""
    c = spark.createDataFrame([(k, float(k % 3)) for k in range(60)], "k int, w double")
    got = points.with_replacement(c, F.col("w"), 500, ["k"])
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    rows = got.collect()
    assert sorted(r.draw for r in rows) == list(range(500)) and all(r.w > 0 and r.w == r.k % 3 for r in rows)


def test_farthest_points_of_large_groups_with_repeated_keys(spark):
    """a key that comes twice in a group of more than 50 000 points, missing features and ties take nothing from its
    share and add nothing to it."""
    n = F.col("id")
    p = spark.range(100_400, numPartitions=4).select((n % 25_000).alias("id"), (n % 2).alias("g"), F.when(n % 11 != 0, (n * 7919 % 1000).cast("double")).alias("a"), (n * 104729 % 333).cast("double").alias("b"))
    got = points.farthest_points(p, ["g"], ["a", "b"], "id", 0.001).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {0: 50, 1: 50}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_farthest_points_make_only_cells_of_their_points(spark, monkeypatch):
    """of the stack, only the cells in which a thinned point lies are made, and the rows are those of the whole stack."""
    from terrane.plans import adapters
    from terrane.queries import registry, spatial

    d, stacks, sampled = "/root/testdata/sf0.001", [], points.sampled
    monkeypatch.setattr(points, "sampled", lambda p, stack, *a: stacks.append((p, stack)) or sampled(p, stack, *a))
    got = registry.queries()["g4_farthest_points"](spark, d)
    p, stack = stacks[0]
    assert stack.join(p, ["row", "col"], "left_anti").isEmpty() and stack.count() > 0
    whole = adapters.cells(spark, d)
    assert sorted(stack.collect()) == sorted(whole.join(p, ["row", "col"], "left_semi").collect())
    thinned = points.thinned_to_grid(points.placed(adapters.points(spark, d)), 20, spatial._order(), ["source", "year"])
    want = points.farthest_points(sampled(thinned, whole, ["price", "balance"]).select("id", "source", "year", "price", "balance"), ["source", "year"], ["price", "balance"], "id", 0.1)
    key = lambda r: (r.id, r.source, r.year, r.price is None, r.price, r.balance)
    assert got.columns == want.columns and sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_guarded_thinning_makes_its_points_once(spark):
    """what is counted and thinned is read from what was written once, not made from lineitem each time."""
    from terrane.queries import registry

    got = registry.queries()["g28_guarded_thinning"](spark, "/root/testdata/sf0.001")
    assert "lineitem" not in got._jdf.queryExecution().toString()
    assert all(r.known == max(1, r.unknown // 10) for r in got.collect())


def test_nearest_fill_ties_to_smaller_row(spark):
    c = spark.createDataFrame([(0, 0, 1.0), (1, 0, None), (2, 0, 3.0), (9, 9, None)], "row int, col int, value double")
    assert {(r.row, r.value) for r in layers.nearest_fill(c).collect()} == {(0, 1.0), (1, 1.0), (2, 3.0), (9, 3.0)}
    assert layers.nearest_fill(c.limit(0)).count() == 0 and layers.nearest_fill(c.filter("value is null")).filter("value is not null").count() == 0


def test_nearest_fill_against_brute_force(spark):
    r = __import__("random").Random(2)
    for known in (0.02, 0.3):
        rows = [(i, j, float(r.random()) if r.random() < known else None) for i in range(5, 40) for j in range(-3, 30) if r.random() < 0.8]
        have = [x for x in rows if x[2] is not None]
        want = {(i, j): v if v is not None else min(((i - a) ** 2 + (j - b) ** 2, a, b, x) for a, b, x in have)[3] for i, j, v in rows}
        got = layers.nearest_fill(spark.createDataFrame(rows, "row int, col int, value double")).collect()
        assert {(x.row, x.col): x.value for x in got} == want


def test_nearest_fill_looks_at_a_line_once(spark):
    """no window reaches to the end of a column, as that is made anew for each cell; other columns and kinds stay."""
    rows = [(i, j, "v" if (i, j) in ((3, 1), (40, 7)) else None, i * 10 + j) for i in range(50) for j in range(9) if j != 4]
    got = layers.nearest_fill(spark.createDataFrame(rows, "row bigint, col int, value string, also int").withColumn("value", F.when(F.col("value").isNotNull(), F.concat("value", F.col("row").cast("string")))), band=8)
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    near = lambda i, j: "v3" if (i - 3) ** 2 + (j - 1) ** 2 <= (i - 40) ** 2 + (j - 7) ** 2 else "v40"
    assert sorted(map(tuple, got.collect())) == sorted((i, j, near(i, j), k) for i, j, _, k in rows)


def test_directional_fill_looks_at_a_line_once(spark):
    """no window reaches to the end of a line, as that is made anew for each cell."""
    c = spark.createDataFrame([(i, 0, float(i) if i in (2, 6) else None) for i in range(9)] + [(3, 2, None), (9, 9, None)], "row int, col int, value double")
    got = layers.directional_fill(c)
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    assert {(r.row, r.col): r.value for r in got.collect()} == {**{(i, 0): 2.0 if i <= 4 else 6.0 for i in range(9)}, (3, 2): 2.0, (9, 9): None}


def test_ascii_rows_cost_their_cells(spark):
    """a line is put together from its known cells; a place isn't looked up for each column of the grid."""
    from terrane.sources import sinks

    cells = [(0, 0, 1.5), (0, 3, None), (0, 4, 2.0), (2, 6, -3.25), (3, 2, math.nan), (9, 0, 1.0), (2, 7, 1.0)]
    d = spark.createDataFrame(cells, "row bigint, col bigint, value double")
    rows = sinks.ascii_rows(d, Grid(rows=4, cols=7))
    assert "map_from_entries" not in rows._jdf.queryExecution().toString()
    n = "-9999.000000"
    assert {r.row: r.line.split(" ") for r in rows.collect()} == {0: ["1.500000", n, n, n, "2.000000", n, n], 2: [n] * 6 + ["-3.250000"], 3: [n] * 7}
    with pytest.raises(Exception, match="more than one cell"):
        sinks.ascii_rows(d.unionByName(d), Grid(rows=4, cols=7)).collect()


def test_ascii_grid_read_in_pieces(spark, tmp_path):
    """Rows keep their numbers though several tasks read one file."""
    body = [" ".join(str(float(r * 50 + c)) for c in range(50)) for r in range(400)]
    (tmp_path / "a.asc").write_text("\n".join(["ncols 50", "nrows 400", "xllcorner 0", "yllcorner 0", "cellsize 1", "NODATA_value -9999", *body]) + "\n")
    names = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 1
        got = tables.read_ascii_grids(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 20000 and all(r.value == r.row * 50 + r.col for r in got)
    (tmp_path / "b.asc").write_text("\n".join(["ncols 50", "nrows 401", *body]) + "\n")
    with pytest.raises(Exception, match="has 400 rows, not 401"):
        tables.read_ascii_grids(spark, str(tmp_path)).agg(F.sum("row")).collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_whole_grid_round_trip(spark):
    from terrane.plans import adapters
    from terrane.queries import registry

    d = "/root/testdata/sf0.001"
    got = registry.queries()["s3_ascii_round_trip"](spark, d).collect()
    want = adapters.cells(spark, d).filter("size % 3 <> 0").groupBy("row").count().collect()
    assert {r.row: r.n for r in got} == {r["row"]: r["count"] for r in want}

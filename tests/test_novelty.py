import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import collinear, models, novelty


def test_similarity_surface(spark):
    ref = novelty.reference(spark.createDataFrame([(0.0, 0.0), (5.0, 2.0), (10.0, 4.0)] * 2, "var1 double, var2 double"), ["var1", "var2"])
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 5.0, 1.0), (1, 0, 10.0, 2.0), (1, 1, 15.0, 3.0), (2, 2, None, None), (2, 3, None, 9.0)], "row int, col int, var1 double, var2 double")
    got = {(r.row, r.col): r for r in novelty.mess(cells, ["row", "col"], ref, ["var1", "var2"]).collect()}
    assert [round(got[k].mess, 4) for k in ((0, 0), (0, 1), (1, 0), (1, 1))] == [66.6667, 66.6667, 0.0, -50.0]
    assert [got[k].limiting for k in ((0, 0), (0, 1), (1, 0), (1, 1))] == ["var1"] * 4
    assert got[2, 2].mess is None and got[2, 3].limiting == "var2" and got[2, 3].mess == -125.0


def test_no_spread(spark):
    ref = novelty.reference(spark.createDataFrame([(5.0,)] * 3, "v double"), ["v"])
    cells = spark.createDataFrame([(0, 5.0), (1, 4.0), (2, 6.0)], "k int, v double")
    assert {r.k: r.mess for r in novelty.mess(cells, ["k"], ref, ["v"]).collect()} == {0: 100.0, 1: -100.0, 2: -100.0}


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    ref, grid = rng.normal(0, 1, 500).round(1), rng.normal(0, 2, 300).round(1)
    r = novelty.reference(spark.createDataFrame([(float(x),) for x in ref], "v double"), ["v"])
    got = {x.k: x.mess for x in novelty.mess(spark.createDataFrame([(i, float(x)) for i, x in enumerate(grid)], "k int, v double"), ["k"], r, ["v"]).collect()}
    lo, hi = ref.min(), ref.max()
    for i, x in enumerate(grid):
        f = (ref <= x).mean()
        want = 100 * (x - lo) / (hi - lo) if x < lo else 100 * (hi - x) / (hi - lo) if x > hi else 200 * f if f <= 0.5 else 200 * (1 - f)
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_vif_and_selection(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) + 2
    x = np.column_stack([x, x[:, 0] + x[:, 1] + rng.normal(size=400) * 0.01])
    names = list("abcd")
    d = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    sums = collinear.product_sums(d, names)
    assert sums[0] == 400
    got = collinear.vif(*sums, intercept=True)
    for j in range(4):
        others = np.column_stack([np.ones(400), np.delete(x, j, 1)])
        fit = others @ np.linalg.lstsq(others, x[:, j], rcond=None)[0]
        r2 = 1 - ((x[:, j] - fit) ** 2).sum() / ((x[:, j] - x[:, j].mean()) ** 2).sum()
        assert got[j] == pytest.approx(1 / (1 - r2), rel=1e-5)
    keep = collinear.stepwise(names, *sums, limit=5.0, intercept=True)
    assert len(keep) == 3 and "c" in keep
    assert collinear.product_sums(d.limit(0), names)[0] == 0


def test_exchange_keeps_values(spark):
    """Every value stays in use as often as before, in every repeat, and other columns stay as they are."""
    d = spark.range(500).select("id", (F.col("id") * 3).cast("double").alias("v"), F.col("id").cast("double").alias("w"), (F.col("id") % 2).alias("y"))
    seen = []

    def score(x):
        seen.append(x)
        return x.withColumn("s", F.col("v") + F.col("w"))

    got = {r.variable: r for r in models.permutation_importance(d, ["v", "w"], "id", score, repeats=2, blocks=3).collect()}
    assert set(got) == {"v", "w"}
    rows = seen[1].collect()
    for t in (0, 1):
        v = sorted((r.id, r.v, r.w) for r in rows if r.variable == "v" and r["__t"] == t)
        assert sorted(x[1] for x in v) == [3.0 * i for i in range(500)] and all(x[2] == x[0] for x in v) and any(x[1] != 3.0 * x[0] for x in v)


def test_response_grid_and_folds(spark):
    d = spark.createDataFrame([(float(i), float(i % 3)) for i in range(11)], "a double, b double")
    g = models.response_grid(d, ["a", "b"], 3).collect()
    assert {(r.step, r.a, r.b) for r in g if r.variable == "a"} == {(0, 0.0, 1.0), (1, 5.0, 1.0), (2, 10.0, 1.0)}
    folds = models.cluster_folds(d.withColumn("a", F.when(F.col("a") < 9, F.col("a"))), ["a"], 2)
    assert {r.fold for r in folds.collect()} == {-1, 0, 1} and folds.count() == 11


def test_linkages_against_definition():
    rng = np.random.default_rng(3)
    r = np.corrcoef(rng.normal(size=(7, 30)) + rng.normal(size=30))
    for linkage in ("single", "complete", "average"):
        x, groups = np.abs(r), [[i] for i in range(7)]
        far = lambda g, h: {"single": min, "complete": max, "average": lambda v: sum(v) / len(v)}[linkage]([float(np.linalg.norm(x[i] - x[j])) for i in g for j in h])  # noqa: B023, E731
        while len(groups) > 1:
            d, g, h = min((far(g, h), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
            if d > 0.9:
                break
            groups[g] += groups.pop(h)
        of = collinear.clusters(r, 0.9, linkage)
        assert len(groups) < 7 and sorted(sorted(np.flatnonzero(of == k)) for k in set(of)) == sorted(sorted(g) for g in groups)
    with pytest.raises(ValueError):
        collinear.clusters(r, 0.9, "none")


def test_grouped_selection(spark):
    """One of a correlated pair of bio and reanalysis stays; barred and anomaly names never do."""
    t = spark.createDataFrame([("bio10", 2.0), ("bio11", 1.0), ("bio08_x", 0.1), ("2m_temperature_var1", 2.0), ("pet_anom", 0.1), ("04_nbr", None), ("slope", 9.0)], "variable string, vif double")
    pairs = spark.createDataFrame([("2m_temperature_var1", "bio10", -0.95), ("bio11", "2m_temperature_var1", 0.5)], "a string, b string, r double")
    got = {r.variable: r.family for r in collinear.selected(t, {"bio": 3, "satellite": 3, "era5": 3}, pairs, 0.8).collect()}
    assert got == {"bio11": "bio", "2m_temperature_var1": "era5", "04_nbr": "satellite", "slope": "other"}
    assert collinear.selected(t.limit(0), {"bio": 3}, pairs).count() == 0


def test_sample_matrix(spark):
    rows = [(i, float(i), 1.0 if i else None, 5.0) for i in range(200)]
    d = spark.createDataFrame(rows, "id int, a double, b double, c double")
    got, names = collinear.sample_matrix(d.withColumn("d", F.col("a") * 2), ["a", "b", "d"], 0.5, F.col("id") / 200, ["id"])
    assert got.count() == 99 and names == ["a", "d"]
    with pytest.raises(ValueError):
        collinear.sample_matrix(d, ["a", "c"], 0.5, F.col("id") / 200, ["id"])


def test_entropy_model_bends(spark):
    """A response with a bend is told by hinges and not by a line; a bad set of features falls back to a line."""
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, 3000)
    y = rng.uniform(size=3000) < np.where(np.abs(x) < 0.3, 0.6, 0.05)
    d = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    auc = lambda m: models.roc_auc(models.scored(m, d)).first().auc
    assert auc(models.fit_maxent(d, ["x"], features=("linear", "hinge"), knots=8)) > 0.75 > 0.6 > auc(models.fit_maxent(d, ["x"], features=("linear",)))
    same = d.withColumn("x", F.lit(1.0))
    assert models.fitted_names(models.fit_maxent(same, ["x"], features=("hinge",))) == ["x"]


def test_cross_validation_of_one_class(spark):
    rng = np.random.default_rng(2)
    pres = spark.createDataFrame([(i, float(rng.normal(1))) for i in range(60)], "id int, x double")
    back = spark.createDataFrame([(i, float(rng.normal(-1))) for i in range(60)], "id int, x double")
    folds = pres.select("id", (F.col("id") % 3 - 1).alias("fold"))
    cv = {r.fold: r for r in models.cross_validated(pres, back, {"m": folds}, "id", lambda t: models.fit_maxent(t, ["x"], product=False)).collect()}
    assert set(cv) == {"0", "1", "mean"} and cv["mean"].auc == np.mean([cv["0"].auc, cv["1"].auc]) and cv["0"].auc > 0.8
    none = models.cross_validated(pres, back, {"m": pres.select("id", F.lit(1).alias("fold"))}, "id", lambda t: models.fit_maxent(t, ["x"]))
    assert [(r.fold, r.auc) for r in none.orderBy("fold").collect()] == [("1", None), ("mean", None)]


def test_search_prunes_and_goes_on():
    def objective(own, report):
        for step in range(3):
            report(step, -abs(own["x"] - 3))
        return -abs(own["x"] - 3)

    log = models.search({"x": {"low": 0.0, "high": 10.0}}, objective, 40, enqueued=[{"x": 9.0}], startup=4)
    assert {t["state"] for t in log} == {"COMPLETE", "PRUNED"} and abs(models.best_trial(log)["x"] - 3) < 0.5 and log[0]["x"] == 9.0
    assert models.search({"x": {"low": 0.0, "high": 1.0}}, lambda own, report: float("nan"), 2)[1]["state"] == "FAIL" and models.best_trial([]) is None

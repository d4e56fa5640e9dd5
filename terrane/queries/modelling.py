"""Queries on collinearity, novelty, models, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import text as X
from terrane.functions.grid import STUDY
from terrane.operators import collinear as C
from terrane.operators import layers as L_
from terrane.operators import models as L
from terrane.operators import novelty as N
from terrane.operators import points as P
from terrane.operators import stats as S
from terrane.plans import adapters as A
from terrane.session import scratch, staged, table
from terrane.sources import sinks as K
from terrane.sources import tables as R

Q, SQL = {}, {}
V = ["v0", "v1", "v2", "v3"]


def reg(name, body=None, *needs, also=""):
    def add(f):
        Q[name] = f
        if body:
            SQL[name] = A.sql(body, *needs, also=also) if needs else body
        return f

    return add


# collinearity


def _sums(s, d, k=4):
    return C.product_sums(A.design(s, d, k), V[:k])


@reg("c1_vif_uncentred", ", k AS (SELECT sum(v0 * v0) AS a, sum(v1 * v1) AS b, sum(v0 * v1) AS c FROM design) SELECT 'v0' AS variable, round(a * b / (a * b - c * c), 6) AS vif FROM k UNION ALL SELECT 'v1', round(a * b / (a * b - c * c), 6) FROM k", "design")
def _(s, d):
    v = C.vif(*_sums(s, d, 2), intercept=False)
    return s.createDataFrame([(n, round(float(x), 6)) for n, x in zip(V, v)], "variable string, vif double")


@reg("c2_vif_intercept", ", k AS (SELECT corr(v0, v1) AS r FROM design) SELECT 'v0' AS variable, round(1 / (1 - r * r), 6) AS vif FROM k UNION ALL SELECT 'v1', round(1 / (1 - r * r), 6) FROM k", "design")
def _(s, d):
    v = C.vif(*_sums(s, d, 2), intercept=True)
    return s.createDataFrame([(n, round(float(x), 6)) for n, x in zip(V, v)], "variable string, vif double")


@reg("c3_stepwise", "SELECT unnest(['v1', 'v2', 'v3', 'v4']) AS variable")
def _(s, d):
    x = A.design(s, d).withColumn("v4", F.col("v0") + F.col("v1") + F.col("v2") / 100)
    names = [*V, "v4"]
    keep = C.stepwise(names, *C.product_sums(x, names), limit=5.0, intercept=True)
    return s.createDataFrame([(n,) for n in keep], "variable string")


@reg("c5_clusters", "SELECT linkage, unnest(['v0', 'v1', 'v2', 'v3']) AS variable FROM (SELECT unnest(['average', 'complete', 'single', 'ward']) AS linkage)")
def _(s, d):
    """v4 is v0 in another unit: whatever the linkage, one of the two stays, the first of equal ones."""
    x = A.design(s, d).withColumn("v4", F.col("v0") * 2 + 0.001)
    names = [*V, "v4"]
    corr = C.correlation_matrix(*C.product_sums(x, names)).round(9)
    return s.createDataFrame([(k, n) for k in ("average", "complete", "single", "ward") for n in C.representatives(names, corr, 0.5, k)], "linkage string, variable string")


@reg("c5_select_group", "SELECT unnest(['v0', 'v1', 'v2', 'v3']) AS variable")
def _(s, d):
    """Constants go, of v0 and its double one stays, and the inflation of those left is below the limit."""
    x = A.design(s, d).withColumns({"v4": F.col("v0") * 2, "same": F.lit(3.0)})
    names = [*V, "v4", "same"]
    return s.createDataFrame([(n,) for n in C.select_group(names, *C.product_sums(x, names), cut=0.3, limit=1e6)], "variable string")


_VIFS = """vifs AS (SELECT variable, avg(vif) AS vif FROM importance WHERE variable IS NOT NULL GROUP BY variable), f AS (SELECT variable, vif, lower(variable) AS n, CASE
  WHEN contains(n, 'anom') OR n LIKE 'bio08%' OR n LIKE 'bio09%' THEN NULL
  WHEN regexp_matches(n, 'ndvi|evi|nbr|ndwi|ndbi|ndmi|ndsi|bsi|vssi') THEN 'satellite' WHEN n LIKE 'bio%' THEN 'bio'
  WHEN regexp_matches(n, '^(2m_temperature|soil_temperature|snow_depth|precip|pet|skin_t|soil_moist|ssrd|surface_solar_radiation|volumetric_soil_water_layer|vpd|tmax|tmean)') THEN 'era5' ELSE 'other' END AS family FROM vifs)"""


def _vifs(s, d):
    return table(s, d, "importance").filter("variable is not null").groupBy("variable").agg(F.avg("vif").alias("vif"))


@reg("c7_families", f"WITH {_VIFS} SELECT variable, family FROM f")
def _(s, d):
    return _vifs(s, d).select("variable", C.family("variable").alias("family"))


@reg("c7_routes", "SELECT variable, CASE WHEN regexp_matches(variable, '(^|[0-9]{4}_)class[0-9]+_') THEN 'landcover' WHEN regexp_matches(lower(variable), 'fragment|hunting') THEN 'unfiltered' WHEN lower(variable) LIKE 'bio%' THEN 'bio' WHEN regexp_matches(variable, '(^|_)04_') THEN 'sat_04' WHEN regexp_matches(variable, '(^|_)07_') THEN 'sat_07' WHEN regexp_matches(variable, '(^|_)10_') THEN 'sat_10' WHEN variable LIKE 'DEM_%' OR regexp_matches(lower(variable), 'small_woody|zones_humides|humanfootprint') THEN 'aux' ELSE 'other' END AS route FROM (SELECT DISTINCT variable FROM importance WHERE variable IS NOT NULL AND NOT contains(variable, 'class11_URBAN'))")
def _(s, d):
    v = table(s, d, "importance").select("variable").dropna().distinct()
    return v.select("variable", C.routed("variable").alias("route")).filter("route is not null")


_BY_RUN = ", m AS (SELECT scenario, combo_name, variable, avg(importance_mean) AS x FROM importance WHERE isfinite(importance_mean) AND scenario IS NOT NULL AND combo_name IS NOT NULL GROUP BY ALL), pr AS (SELECT a.variable AS a, b.variable AS b, corr(a.x, b.x) AS r FROM m a JOIN m b USING (scenario, combo_name) JOIN f fa ON fa.variable = a.variable JOIN f fb ON fb.variable = b.variable WHERE fa.family = 'bio' AND fb.family = 'era5' GROUP BY ALL)"


@reg("c4_grouped_selection", f"""WITH {_VIFS}{_BY_RUN}, k AS (SELECT * FROM f WHERE family IS NOT NULL QUALIFY row_number() OVER (PARTITION BY family ORDER BY vif NULLS LAST, variable) <= CASE family WHEN 'bio' THEN 4 WHEN 'satellite' THEN 3 WHEN 'era5' THEN 3 ELSE 999 END),
gone AS (SELECT DISTINCT CASE WHEN x.vif >= y.vif THEN a ELSE b END AS variable FROM pr JOIN k x ON x.variable = a JOIN k y ON y.variable = b WHERE isfinite(r) AND abs(round(r, 9)) >= 0.2) SELECT variable, family FROM k ANTI JOIN gone USING (variable)""")
def _(s, d):
    """Inflation and correlations over runs: the importance of a variable in each scenario and combination is a column of it."""
    i = table(s, d, "importance").filter("scenario is not null and combo_name is not null").withColumn("x", X.finite("importance_mean")).filter("x is not null")
    m = i.groupBy("scenario", "combo_name", "variable").agg(F.avg("x").alias("x"))
    side = lambda k, v: m.filter(C.family("variable") == k).select("scenario", "combo_name", F.col("variable").alias(v), F.col("x").alias(f"x{v}"))
    pairs = side("bio", "a").join(side("era5", "b"), ["scenario", "combo_name"]).groupBy("a", "b").agg(F.round(X.finite(F.corr("xa", "xb")), 9).alias("r"))
    return C.selected(_vifs(s, d), {"bio": 4, "satellite": 3, "era5": 3}, pairs, 0.2)


@reg("c5_selection", "SELECT * FROM (VALUES ('class1_A', 0), ('hunting_x', 1), ('bio01', 2), ('04_ndvi', 3)) t(variable, place)")
def _(s, d):
    """Land cover and unfiltered ones stay; bio02 is bio01 in another unit; `near` overlaps with the land cover."""
    e = F.col("embedding")
    x = table(s, d, "embeddings").select(*[e[i].cast("double").alias(n) for i, n in enumerate(("class1_A", "hunting_x", "bio01", "04_ndvi"))])
    x = x.withColumns({"bio02": F.col("bio01") * 3 + 1, "near": F.col("class1_A") + F.col("bio01") / 1000, "class11_URBAN": F.lit(1.0)})
    names = x.columns
    groups = {r.n: r.g for r in s.createDataFrame([(n,) for n in names], "n string").select("n", C.routed("n").alias("g")).collect()}
    return s.createDataFrame(list(zip(*[(k := C.selection(x, groups, cut=0.3, limits={"bio": 1e6})), range(len(k))])), "variable string, place int")


@reg("c6_overlap", ", x AS (SELECT *, v0 + v1 / 100 AS w FROM design) SELECT 'w' AS variable, round(abs(corr(v0, w)), 9) AS r FROM x", "design")
def _(s, d):
    pairs = S.correlations(A.design(s, d).withColumn("w", F.col("v0") + F.col("v1") / 100), ["v0", "v1", "w"])
    families = s.createDataFrame([("v0", "landcover"), ("v1", "bio"), ("w", "other")], "variable string, family string")
    return C.overlapping(pairs, families).withColumn("r", F.round("r", 9))


@reg("c8_cap", f"WITH {_VIFS} SELECT variable FROM vifs ORDER BY vif NULLS LAST, variable LIMIT 20")
def _(s, d):
    return _vifs(s, d).orderBy(F.asc_nulls_last("vif"), "variable").limit(20).select("variable")


@reg("c10_fitted_order", "SELECT context_id, p AS variable, i - 1 AS idx, p IN (SELECT variable FROM importance) AS present FROM (SELECT context_id, unnest(predictors) AS p, generate_subscripts(predictors, 1) AS i FROM training_context)")
def _(s, d):
    """The predictors of each training context in their order, and whether the runs know them."""
    fitted = table(s, d, "training_context").select("context_id", F.posexplode("predictors").alias("idx", "variable"))
    have = table(s, d, "importance").select("variable").distinct().withColumn("present", F.lit(True))
    return fitted.join(have, "variable", "left").select("context_id", "variable", "idx", F.coalesce("present", F.lit(False)).alias("present"))


@reg("c11_vif_sample", "SELECT id FROM design QUALIFY row_number() OVER (ORDER BY (id * 2654435761 + 42 * 40503) % 1000003 / 1000003.0::DOUBLE, id) <= greatest(2, round((SELECT count(*) FROM design) * 0.05::DOUBLE))", "design")
def _(s, d):
    rows, _ = C.sample_matrix(A.design(s, d), V, 0.05, A.hashed("id", 42) / 1000003.0, ["id"])
    return rows.select("id")


# novelty

_X = ["size", "price", "balance"]
_GRID = "g AS (SELECT row, col, size, price * 1.5 - 300 AS price, balance * 1.2 AS balance FROM cells), tr AS (SELECT size, price, balance FROM cells WHERE size % 3 <> 0)"


def _novel(s, d):
    c = A.cells(s, d)
    return c.select("row", "col", "size", (F.col("price") * 1.5 - 300).alias("price"), (F.col("balance") * 1.2).alias("balance")), P.in_mask(c, A.mask(s, d)).select(*_X)


_MESS = (
    _GRID
    + ", rl AS (UNPIVOT (SELECT size::DOUBLE AS size, price, balance FROM tr) ON size, price, balance INTO NAME variable VALUE value), gl AS (UNPIVOT (SELECT row, col, size::DOUBLE AS size, price, balance FROM g) ON size, price, balance INTO NAME variable VALUE value),"
    + " ends AS (SELECT variable, min(value) AS lo, max(value) AS hi, count(*) AS n FROM rl GROUP BY variable),"
    + " cum AS (SELECT variable, value, sum(count(*)) OVER (PARTITION BY variable ORDER BY value) AS upto FROM rl GROUP BY variable, value),"
    + " f AS (SELECT gl.*, coalesce(cum.upto, 0) / n::DOUBLE AS f, lo, hi FROM gl JOIN ends USING (variable) ASOF LEFT JOIN cum ON gl.variable = cum.variable AND gl.value >= cum.value),"
    + " sc AS (SELECT row, col, variable, CASE variable WHEN 'size' THEN 0 WHEN 'price' THEN 1 ELSE 2 END AS o, CASE WHEN value < lo THEN 100 * (value - lo) / (hi - lo) WHEN value > hi THEN 100 * (hi - value) / (hi - lo) WHEN f <= 0.5 THEN 200 * f ELSE 200 * (1 - f) END AS score FROM f),"
    + " mess AS (SELECT row, col, score AS mess, variable AS limiting FROM sc QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY round(score, 9), o) = 1)"
)


@reg("n3_mess", "SELECT row, col, round(mess, 6) AS mess, limiting FROM mess", "cells", also=_MESS)
def _(s, d):
    g, tr = _novel(s, d)
    return N.mess(g, ["row", "col"], N.reference(tr, _X), _X).withColumn("mess", F.round("mess", 6))


@reg("n1_reference", ", rl AS (UNPIVOT (SELECT size::DOUBLE AS size, price, balance FROM tr) ON size, price, balance INTO NAME variable VALUE value) SELECT variable, min(value) AS low, max(value) AS high, count(*) AS total, count(DISTINCT value) AS kinds FROM rl GROUP BY variable", "cells", also=_GRID)
def _(s, d):
    return N.cumulative(N.reference(_novel(s, d)[1], _X)).groupBy("variable").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("upto").alias("total"), F.count("*").alias("kinds"))


_NT2 = ", m AS (SELECT avg(price) AS mp, avg(balance) AS mb, var_samp(price) AS a, var_samp(balance) AS b, covar_samp(price, balance) AS c FROM tr), t AS (SELECT quantile_cont((b * (price - mp) ** 2 - 2 * c * (price - mp) * (balance - mb) + a * (balance - mb) ** 2) / (a * b - c * c), 0.99) AS tau FROM tr, m), nt AS (SELECT row, col, (b * (price - mp) ** 2 - 2 * c * (price - mp) * (balance - mb) + a * (balance - mb) ** 2) / (a * b - c * c) / tau AS nt2 FROM g, m, t)"


@reg("n5_nt2", ", ".join(["", _NT2.lstrip(", ")]) + " SELECT row, col, round(nt2, 6) AS nt2 FROM nt", "cells", also=_GRID)
def _(s, d):
    g, tr = _novel(s, d)
    return N.nt2(g, tr, ["price", "balance"]).select("row", "col", F.round("nt2", 6).alias("nt2"))


@reg("n6_class_shares", _NT2 + ", k AS (SELECT CASE WHEN mess < 0 THEN 1 ELSE 0 END + CASE WHEN nt2 > 1 THEN 2 ELSE 0 END AS cls FROM mess JOIN nt USING (row, col)) SELECT cls, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share, count(*)::DOUBLE AS km2 FROM k GROUP BY cls", "cells", also=_MESS)
def _(s, d):
    g, tr = _novel(s, d)
    m = N.mess(g, ["row", "col"], N.reference(tr, _X), _X).join(N.nt2(g, tr, ["price", "balance"]).select("row", "col", "nt2"), ["row", "col"])
    return N.class_shares(m.select(N.novelty_class(F.col("mess"), F.col("nt2")).alias("cls")))


@reg("a27_limiting_counts", "SELECT v.variable, count(limiting) AS n, count(*) FILTER (mess < 0) AS negative FROM (SELECT unnest(['size', 'price', 'balance', 'none']) AS variable) v LEFT JOIN mess ON limiting = v.variable GROUP BY v.variable", "cells", also=_MESS)
def _(s, d):
    g, tr = _novel(s, d)
    return N.limiting_counts(N.mess(g, ["row", "col"], N.reference(tr, _X), _X), [*_X, "none"])


@reg("n8_summary", "SELECT count(*) AS n, avg(mess) AS mean, min(mess) AS low, avg((mess < 0)::INT) AS negative FROM mess", "cells", also=_MESS)
def _(s, d):
    g, tr = _novel(s, d)
    m = N.mess(g, ["row", "col"], N.reference(tr, _X), _X)
    return m.agg(F.count("*").alias("n"), F.avg("mess").alias("mean"), F.min("mess").alias("low"), F.avg((F.col("mess") < 0).cast("int")).alias("negative"))


# models


@reg("l1_stacked", "SELECT CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS y, count(*) AS n, sum(v0) AS v0, count(*) FILTER (id % 2 = 0) AS marked FROM design GROUP BY 1", "design")
def _(s, d):
    x = A.design(s, d).select("id", "v0")
    both = L.stacked(x.filter("id % 2 = 0").withColumn("mark", F.lit(1)), x.filter("id % 2 = 1"))
    return both.groupBy("y").agg(F.count("*").alias("n"), F.sum("v0").alias("v0"), F.count("mark").alias("marked"))


@reg("l7_mean_impute", ", h AS (SELECT id, CASE WHEN id % 5 <> 0 THEN v0 END AS v0 FROM design) SELECT id, round(coalesce(v0, avg(v0) OVER ()), 9) AS v0 FROM h", "design")
def _(s, d):
    x = A.design(s, d).select("id", F.when(F.col("id") % 5 != 0, F.col("v0")).alias("v0"))
    return L.imputed(x, ["v0"]).withColumn("v0", F.round("v0", 9))


@reg("l12_response_grid", ", k AS (SELECT min(v0) AS l0, max(v0) AS h0, median(v0) AS m0, min(v1) AS l1, max(v1) AS h1, median(v1) AS m1 FROM design) SELECT 'v0' AS variable, i::INT AS step, l0 + (h0 - l0) * i / 49 AS v0, m1 AS v1 FROM k, range(50) t(i) UNION ALL SELECT 'v1', i::INT, m0, l1 + (h1 - l1) * i / 49 FROM k, range(50) t(i)", "design")
def _(s, d):
    return L.response_grid(A.design(s, d), ["v0", "v1"])


def _linear(x):
    return x.withColumn("s", 1 / (1 + F.exp(-(8 * F.col("v0") - 5 * F.col("v1")))))


def _shuffle_sql(columns: list[str], repeats: int, seed: int, std: str) -> str:
    """The exchange by the same hash in SQL: rows of a block, in the order of the key, take the values in the order of the draw."""
    score = lambda v: "1 / (1 + exp(-(8 * {} - 5 * {})))".format(*[f"b.{c}" if c == v else f"a.{c}" for c in ("v0", "v1")])
    draw = lambda r: f"((id * 2654435761 + {seed + r} * 40503) % 1000003)"
    parts = [f"SELECT '{v}' AS variable, {r} AS t, a.y, {score(v)} AS s FROM ra a JOIN (SELECT *, row_number() OVER (PARTITION BY id % 7 ORDER BY {draw(r)}, id) AS rn FROM design) b ON a.id % 7 = b.id % 7 AND a.rn = b.rn" for v in columns for r in range(repeats)]
    auc = lambda src, by: f"SELECT {by}(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y <> 1))::DOUBLE AS auc FROM (SELECT *, rank() OVER (PARTITION BY {by.replace(', ', ',').rstrip(',') or '1'} ORDER BY s) + (count(*) OVER (PARTITION BY {(by + 's').lstrip()}) - 1) / 2.0::DOUBLE AS rk FROM {src}) {'GROUP BY variable, t' if by else ''}"
    return (
        ", ra AS (SELECT *, row_number() OVER (PARTITION BY id % 7 ORDER BY id) AS rn FROM design), base AS (SELECT y, 1 / (1 + exp(-(8 * v0 - 5 * v1))) AS s FROM design), ex AS (" + " UNION ALL ".join(parts) + "), "
        f"b0 AS ({auc('base', '')}), e0 AS ({auc('ex', 'variable, t, ')}) SELECT variable, round(avg(b0.auc - e0.auc), 9) AS mean, round({std}(b0.auc - e0.auc), 9) AS std FROM e0, b0 GROUP BY variable"
    )


def _permuted(s, d, columns, **k):
    p = L.permutation_importance(A.design(s, d), columns, "id", _linear, draw=lambda r: A.hashed("id", r), block=F.col("id") % 7, **k)
    return p.select("variable", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@reg("l8_permutation_importance", _shuffle_sql(["v0", "v1", "v2"], 2, 1, "stddev_pop"), "design")
def _(s, d):
    return _permuted(s, d, ["v0", "v1", "v2"], repeats=2)


@reg("l9_permutation_one_variable", _shuffle_sql(["v0"], 3, 42, "stddev_samp"), "design")
def _(s, d):
    return _permuted(s, d, ["v0"], repeats=3, seed=42, ddof=1)


def _auc_of(df):
    from terrane.operators.metrics import roc_auc

    return roc_auc(df).first().auc


@reg("l2_maxent_scores", "SELECT count(*) AS n, true AS known, true AS told FROM embeddings")
def _(s, d):
    """Linear, quadratic, product and hinge features: a score in [0, 1] for each row, and an AUC on rows it was fitted on
    above that of chance."""
    x = A.design(s, d)
    f = L.scored(L.fit_maxent(x.filter("id % 4 <> 0"), V, features=("linear", "quadratic", "product", "hinge"), knots=4), x, cloglog=True)
    return f.agg(F.count("*").alias("n"), F.bool_and(F.col("s").between(0, 1)).alias("known")).withColumn("told", F.lit(_auc_of(f) > 0.55))


@reg("l3_tree_scores", "SELECT count(*) AS n, true AS known, true AS told FROM embeddings")
def _(s, d):
    x = A.design(s, d)
    held = P.stratified_split(x.withColumn("__d", A.hashed("id", 3) / 1000003.0), ["y"], 0.2, "__d", ["id"]).withColumn("held", F.col("part") == "test").drop("__d", "part")
    f = L.scored(L.fit_trees(held, V, validation="held", rounds=5), x)
    return f.agg(F.count("*").alias("n"), F.bool_and(F.col("s").between(0, 1)).alias("known")).withColumn("told", F.lit(_auc_of(f) > 0.55))


@reg("l4_calibrated_scores", "SELECT count(*) AS n, true AS same_order, true AS same_mean FROM embeddings")
def _(s, d):
    """Calibration keeps the order of scores, and its mean is the share of presences."""
    x = A.design(s, d)
    raw = L.scored(L.fit_trees(x, V, rounds=3), x)
    f = L.calibrated(raw, raw)
    told = f.agg(F.count("*").alias("n"), (F.abs(F.avg("s") - F.avg("y")) < 0.01).alias("same_mean"))
    return told.withColumn("same_order", F.lit(abs(_auc_of(raw) - _auc_of(f)) < 1e-9))


@reg("l10_gain_importance", "SELECT 4 AS variables, true AS sums_to_one, true AS in_order")
def _(s, d):
    g = L.gains(L.fit_trees(A.design(s, d), V, rounds=3), V)
    return s.createDataFrame([(len(g), abs(sum(v for _, v in g) - 1) < 1e-9, g == sorted(g, key=lambda x: (-x[1], x[0])))], "variables int, sums_to_one boolean, in_order boolean")


@reg("l11_jackknife", "SELECT variable, kind, true AS known FROM (SELECT unnest(['v0', 'v1']) AS variable) CROSS JOIN (SELECT unnest(['only', 'without']) AS kind)")
def _(s, d):
    x = A.design(s, d)
    j = L.jackknife(x.filter("id % 3 <> 0"), x.filter("id % 3 = 0"), ["v0", "v1"], lambda t, c: L.fit_maxent(t, c, product=False))
    return j.select("variable", "kind", F.col("auc").between(0, 1).alias("known"))


@reg("l6_grid_scores", "SELECT count(*) AS n, true AS known FROM mask", "mask")
def _(s, d):
    c = A.cells(s, d).withColumn("y", (F.col("size") > 25).cast("int"))
    model = L.fit_maxent(c, ["price", "balance"], product=False)
    return L.scored(model, P.in_mask(L.imputed(c, ["price", "balance"]), A.mask(s, d))).agg(F.count("*").alias("n"), F.bool_and(F.col("s").between(0, 1)).alias("known"))


@reg("l15_search", "SELECT 10 AS trials, 1 AS failed, true AS improved, true AS inside")
def _(s, d):
    """A search over three kinds of spaces, an enqueued trial first and one that fails, by the AUC of a linear score."""
    x = A.design(s, d).select("y", "v0", "v1").cache()

    def objective(own, report):
        if own["kind"] == "none":
            raise ValueError("no such kind")
        a = _auc_of(x.select("y", (F.col("v0") * own["a"] + F.col("v1") * own["b"]).alias("s")))
        report(0, a)
        return a

    space = {"a": {"low": -4.0, "high": 4.0}, "b": {"low": -4, "high": 4, "step": 2}, "kind": {"choices": ["linear"]}, "scale": {"low": 0.01, "high": 10.0, "log": True}}
    log = L.search(space, objective, 10, enqueued=[{"a": 0.0, "b": 2, "kind": "linear", "scale": 1.0}, {"a": 0.0, "b": 0, "kind": "none", "scale": 1.0}])
    x.unpersist()
    best = L.best_trial(log)
    inside = all(-4 <= t["a"] <= 4 and t["b"] in (-4, -2, 0, 2, 4) and 0.01 <= t["scale"] <= 10 for t in log)
    return s.createDataFrame([(len(log), sum(t["state"] == "FAIL" for t in log), best["value"] > log[0]["value"], inside)], "trials int, failed int, improved boolean, inside boolean")


@reg("v3_environment_folds", "SELECT count(*) FILTER (id % 9 = 0) AS always_trained, count(*) AS n, 3 AS folds FROM design", "design")
def _(s, d):
    x = A.design(s, d).withColumn("v0", F.when(F.col("id") % 9 != 0, F.col("v0")))
    return L.cluster_folds(x, ["v0", "v1"], 3).agg(F.count_if(F.col("fold") == -1).alias("always_trained"), F.count("*").alias("n"), F.countDistinct(F.when(F.col("fold") >= 0, F.col("fold"))).cast("int").alias("folds"))


@reg("v4_geographic_folds", "SELECT count(*) AS n, 4 AS folds, 0::BIGINT AS unassigned FROM points", "points")
def _(s, d):
    return L.cluster_folds(A.points(s, d), ["x", "y"], 4).agg(F.count("*").alias("n"), F.countDistinct("fold").cast("int").alias("folds"), F.count_if(F.col("fold") < 0).alias("unassigned"))


@reg("v6_cross_validation", "SELECT method, fold, true AS known FROM (SELECT unnest(['random_kfold', 'env_block']) AS method) CROSS JOIN (SELECT unnest(['1', '2', '3', 'mean']) AS fold)")
def _(s, d):
    """Presences of the design in random folds and in folds by environment, a linear model fitted for each fold."""
    x = A.design(s, d)
    pres, back = x.filter("y = 1").drop("y"), x.filter("y = 0").drop("y")
    folds = {"random_kfold": P.random_folds(pres, 3, A.hashed("id", 2) / 1000003.0), "env_block": L.cluster_folds(pres, V, 3).withColumn("fold", F.col("fold") + 1)}
    cv = L.cross_validated(pres, back, folds, "id", lambda t: L.fit_maxent(t, V, product=False))
    return cv.select("method", "fold", (F.col("auc").between(0, 1) & F.col("omission").between(0, 1)).alias("known"))


# sources and sinks


@reg("s1_points_scan", """SELECT count(*) AS n, sum("dd long") AS x, sum("dd lat") AS y FROM presence WHERE isfinite("dd long") AND isfinite("dd lat")""")
def _(s, d):
    return R.located(table(s, d, "presence")).agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))


@reg("s1_csv_points", """SELECT count(*) AS n, sum("dd long") AS x FROM presence WHERE isfinite("dd long") AND isfinite("dd lat")""")
def _(s, d):
    path = scratch(s)
    table(s, d, "presence").select("occ_id", "dd long", "dd lat", "source").write.option("header", True).csv(path)
    return R.read_points(s, path).agg(F.count("*").alias("n"), F.sum("x").alias("x"))


@reg("s2_semester_scan", """SELECT lower(trim(source)) AS source, count(*) AS n FROM presence WHERE lower(trim(semester)) IN ('2020-winter', '2021-summer') AND lower(trim(source)) IN ('gbif', 'rrn') AND isfinite("dd long") AND isfinite("dd lat") GROUP BY 1""")
def _(s, d):
    from terrane.functions.text import folded

    p = R.of_semesters(R.located(table(s, d, "presence")), ["2020-Winter", "2021-Summer"], sources=["GBIF", "RRN"])
    return p.groupBy(folded("source").alias("source")).agg(F.count("*").alias("n"))


@reg("s2_year_scan", """SELECT count(*) AS n FROM presence WHERE "year-int" BETWEEN 2019 AND 2021 AND isfinite("dd long") AND isfinite("dd lat")""")
def _(s, d):
    return R.of_semesters(R.located(table(s, d, "presence")), years=(2019, 2021)).agg(F.count("*").alias("n"))


@reg("s4_band_collapse", "SELECT row, col, avg(v) AS value FROM (SELECT row, col, price AS v FROM cells UNION ALL SELECT row, col, CASE WHEN balance > 0 THEN balance END FROM cells) GROUP BY row, col", "cells")
def _(s, d):
    c = A.cells(s, d)
    bands = c.select("row", "col", F.col("price").alias("value")).unionByName(c.select("row", "col", F.when(F.col("balance") > 0, F.col("balance")).otherwise(float("nan")).alias("value")))
    return R.collapsed_bands(bands)


@reg("s6_numeric_predictors", "SELECT count(*) AS n, sum(p_size) AS p_size, sum(p_retailprice) AS p_retailprice FROM part")
def _(s, d):
    p = R.read_predictors(s, f"{d}/part.parquet")
    return p.agg(F.count("*").alias("n"), F.sum("p_size").alias("p_size"), F.sum("p_retailprice").alias("p_retailprice"))


@reg("s8_templates", "SELECT 'in/' || y || '/' || CASE WHEN m < 10 THEN '0' ELSE '' END || m || '_' || lower(i) || '.tif' AS path FROM (SELECT unnest([2019, 2020]) AS y), (SELECT unnest([4, 10]) AS m), (SELECT unnest(['NDVI', 'EVI']) AS i)")
def _(s, d):
    return R.expanded("in/{year}/{month}_{index_lower}.tif", {"year": [2019, 2020], "month": [4, 10], "index": ["NDVI", "EVI"]}, s)


@reg("s13_name_lists", "WITH p AS (SELECT context_id, unnest(predictors) AS name, generate_subscripts(predictors, 1) AS i FROM training_context) SELECT name, row_number() OVER (ORDER BY min((context_id, i)))::INT AS place FROM p GROUP BY name")
def _(s, d):
    """The predictors of each context as a line of a list with a remark; the first mention of a name counts."""
    t = table(s, d, "training_context").select(F.col("context_id").alias("line_no"), F.concat(F.array_join("predictors", ", "), F.lit(" # of context "), F.col("context_id").cast("string")).alias("value"))
    return R.named_list(t)


@reg("s14_path_labels", "SELECT source_file, nullif(regexp_extract(source_file, '(?:^|/)test_([0-9]{4})(?:/|$)', 1), '')::INT AS test_year, nullif(lower(regexp_extract(source_file, '(?i)(?:^|/)(elapid|maxent|gbm)(?:/|$)', 1)), '') AS engine FROM importance")
def _(s, d):
    labels = R.path_labels("source_file")
    return table(s, d, "importance").select("source_file", labels["test_year"].alias("test_year"), labels["engine"].alias("engine"))


@reg("s15_first_existing", "WITH i AS (SELECT meta_run, source_file AS path, test_year, loaded_at FROM importance), w AS (SELECT DISTINCT meta_run, path, CASE test_year WHEN 2022 THEN 0 ELSE 1 END AS priority FROM i WHERE test_year IN (2020, 2022)), h AS (SELECT path, max(loaded_at) AS modified FROM i WHERE test_year <> 2022 OR meta_run < 'meta_run_2' GROUP BY path) SELECT meta_run, path FROM w JOIN h USING (path) QUALIFY row_number() OVER (PARTITION BY meta_run ORDER BY priority, modified DESC, path) = 1")
def _(s, d):
    """Of each run the first of two wanted years' files that is there."""
    i = table(s, d, "importance").select("meta_run", F.col("source_file").alias("path"), "test_year", "loaded_at")
    wanted = i.select("meta_run", "path", F.when(F.col("test_year") == 2022, 0).when(F.col("test_year") == 2020, 1).alias("priority")).filter("priority is not null").distinct()
    have = i.filter("test_year <> 2022 or meta_run < 'meta_run_2'").groupBy("path").agg(F.max("loaded_at").alias("modified"))
    return R.first_existing(wanted, have, "meta_run")


@reg("s16_search_roots", "SELECT DISTINCT source_file AS path, CASE WHEN contains(source_file, 'multitemporal') THEN 0 WHEN contains(source_file, 'monotemporal') THEN 2 ELSE 1 END AS rank FROM importance")
def _(s, d):
    roots = table(s, d, "importance").select(F.col("source_file").alias("path")).distinct()
    return R.prioritised(roots, "multitemporal", "monotemporal")


@reg("s19_union_by_name", "SELECT scenario, count(auc) AS auc, count(cbi) AS cbi FROM (SELECT scenario, auc, NULL AS cbi FROM metrics WHERE run_id % 2 = 0 UNION ALL SELECT scenario, NULL, cbi FROM metrics WHERE run_id % 2 = 1) GROUP BY scenario", "metrics")
def _(s, d):
    m = A.metrics(s, d)
    return R.united([m.filter("run_id % 2 = 0").select("scenario", "auc"), m.filter("run_id % 2 = 1").select("cbi", "scenario")]).groupBy("scenario").agg(F.count("auc").alias("auc"), F.count("cbi").alias("cbi"))


@reg("s21_vif_table", "SELECT combo_name, variable, vif FROM importance WHERE vif IS NOT NULL QUALIFY row_number() OVER (PARTITION BY combo_name, variable ORDER BY loaded_at DESC, record_id DESC) = 1")
def _(s, d):
    i = R.alias(table(s, d, "importance").withColumnRenamed("vif", "Variance_Inflation_Factor"), "vif", "variance_inflation_factor").filter("vif is not null")
    return P.first_per(i, ["combo_name", "variable"], [F.desc("loaded_at"), F.desc("record_id")]).select("combo_name", "variable", "vif")


@reg("s23_test_years", "SELECT DISTINCT test_year FROM importance WHERE test_year IS NOT NULL")
def _(s, d):
    return table(s, d, "importance").select("test_year").dropna().distinct()


_ROWS = f"(SELECT max(p_partkey) // {A.PARTS_A_ROW} + 1 FROM part)"


@reg("k3_ascii_grid", f""", n AS (SELECT {_ROWS} AS n), w AS (SELECT i AS place, string_agg(CASE WHEN c.price IS NULL THEN '-9999.000000' ELSE printf('%.6f', c.price) END, ' ' ORDER BY j) AS line FROM (SELECT unnest(range(n)) AS i FROM n) CROSS JOIN range({A.COLS}) b(j) LEFT JOIN cells c ON c.row = i AND c.col = j AND size % 3 <> 0 GROUP BY i)
SELECT * FROM w UNION ALL SELECT -6, 'ncols {A.COLS}' UNION ALL SELECT -5, 'nrows ' || n FROM n UNION ALL SELECT -4, 'xllcorner 91000.000000' UNION ALL SELECT -3, printf('yllcorner %.6f', 7124000.0::DOUBLE - n * 1000) FROM n UNION ALL SELECT -2, 'cellsize 1000.000000' UNION ALL SELECT -1, 'NODATA_value -9999.000000'""", "cells")
def _(s, d):
    return K.ascii_grid(P.in_mask(A.cells(s, d), A.mask(s, d)), A.extent(s, d), "price")


@reg("s3_ascii_round_trip", "SELECT row, count(*) AS n, round(sum(price), 3) AS total, sum(col) AS cols FROM cells WHERE size % 3 <> 0 GROUP BY row", "cells")
def _(s, d):
    path = scratch(s)
    c = P.in_mask(A.cells(s, d), A.mask(s, d))
    # a grid file is one file; its lines, not its cells, are brought to one task
    K.ascii_grid(c, A.extent(s, d), "price").repartition(1).sortWithinPartitions("place").select("line").write.text(path)
    return R.read_ascii_grids(s, path).filter("value is not null").groupBy("row").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.sum("col").alias("cols"))


@reg("k1_stack_round_trip", "SELECT row, count(*) AS n, sum(price) AS price FROM cells GROUP BY row", "cells")
def _(s, d):
    path = scratch(s)
    K.write_stack(A.cells(s, d).withColumn("year", F.lit(1997)), path, ["year"])
    return s.read.parquet(path).filter("year = 1997").groupBy("row").agg(F.count("*").alias("n"), F.sum("price").alias("price"))


@reg("k4_interop_points", "SELECT 'wild boar' AS species, printf('%.6f', x) AS longitude, printf('%.6f', y) AS latitude FROM points", "points")
def _(s, d):
    return K.interop_points(A.points(s, d), "wild boar")


@reg("k4_bundle", "SELECT 'points' AS part, (SELECT count(*) FROM points) AS n, NULL::DOUBLE AS total UNION ALL SELECT 'size', count(size), round(sum(size), 3) FROM cells UNION ALL SELECT 'price', count(price), round(sum(price), 3) FROM cells", "points", "cells")
def _(s, d):
    """A bundle that is written and read back part by part, by its own list of them."""
    path = scratch(s)
    K.interop_bundle(A.points(s, d), staged(A.cells(s, d).select("row", "col", "size", "price")), A.extent(s, d), ["size", "price"], "wild boar", path, {"season": "Winter"})
    told = s.read.json(f"{path}/bundle.json").first()
    out = s.read.option("header", True).csv(f"{path}/{told.points}").agg(F.lit("points").alias("part"), F.count("*").alias("n"), F.lit(None).cast("double").alias("total"))
    for v, folder in told.layers.asDict().items():
        out = out.unionByName(R.read_ascii_grids(s, f"{path}/{folder}").agg(F.lit(v).alias("part"), F.count("value").alias("n"), F.round(F.sum("value"), 3).alias("total")))
    return out


@reg("k6_markdown", "SELECT '| ' || subject || ' | ' || replace(coalesce(description, ''), '|', '\\|') || ' |' AS line FROM subjects")
def _(s, d):
    return K.markdown(table(s, d, "subjects").select("subject", "description"))


@reg("k8_signature_cache", "SELECT count(*) AS n FROM cells", "cells")
def _(s, d):
    folder = scratch(s)
    make = lambda: A.cells(s, d).agg(F.count("*").alias("n"))
    K.cached(make, s, folder, {"season": "Winter", "km": 5})
    return K.cached(make, s, folder, {"km": 5, "season": "Winter"})


@reg("k9_append_new", "SELECT count(*) AS n, count(DISTINCT run_id) AS runs FROM metrics", "metrics")
def _(s, d):
    path = scratch(s)
    m = A.metrics(s, d).select("run_id", "auc")
    K.append_new(m.filter("auc is not null"), path, ["run_id"])
    return K.append_new(m, path, ["run_id"]).agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("runs"))


@reg("k2_replicated_layers", "SELECT row, col, step, price FROM cells, (SELECT unnest(range(3))::INT AS step)", "cells")
def _(s, d):
    return L_.replicated(A.cells(s, d), "step", [0, 1, 2]).select("row", "col", "step", "price")


@reg("proj23_storable_types", "SELECT * FROM (VALUES ('float64', 'float64'), ('uint8', 'int32'), ('int8', 'int32'), ('int16', 'int16'), ('bool', 'float32')) t(kind, stored)")
def _(s, d):
    return s.createDataFrame([("float64",), ("uint8",), ("int8",), ("int16",), ("bool",)], "kind string").select("kind", K.storable("kind").alias("stored"))


@reg("proj8_half_cell_shift", "SELECT row, col, 91000 + 1000 * (col + 0.5::DOUBLE) - 500 AS x, 7124000 - 1000 * (row + 0.5::DOUBLE) + 500 AS y FROM mask", "mask")
def _(s, d):
    g = STUDY.shifted(-500, 500)
    return A.mask(s, d).select("row", "col", g.center_x().alias("x"), g.center_y().alias("y"))


@reg("proj18_predictor_intersection", "SELECT context_id, p AS variable, i - 1 AS idx FROM (SELECT context_id, unnest(predictors) AS p, generate_subscripts(predictors, 1) AS i FROM training_context) WHERE p IN (SELECT variable FROM importance WHERE test_year = 2020)")
def _(s, d):
    """The predictors of each context, in order, that the runs of test year 2020 have."""
    train = table(s, d, "training_context").select("context_id", F.posexplode("predictors").alias("idx", "variable"))
    return train.join(table(s, d, "importance").filter("test_year = 2020").select("variable"), "variable", "left_semi").select("context_id", "variable", "idx")


QUERIES = Q

"""Queries on points, masks, layers and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.grid import STUDY, Grid
from terrane.operators import layers as L
from terrane.operators import points as P
from terrane.plans import adapters as A
from terrane.session import staged, table

BASE = ["size", "price", "balance"]


def _points(s, d):
    return P.placed(A.points(s, d))


def _order():
    return [A.hashed("id", 7), "id", "x", "y", "year", "quantity"]


_TIE = ["id", "x", "y", "quantity"]


def _drawn(s, d):
    return A.points(s, d).withColumn("draw", A.hashed("id", 7) / 1000003.0)


def slice_presence_background(s: SparkSession, d: str) -> DataFrame:
    """Season's points in the mask, one a cell, sampled on the stack and summarised by source."""
    p = P.in_mask(P.placed(P.of_season(A.points(s, d), "winter", 1997)), A.mask(s, d))
    p = P.first_per(p, ["source", "row", "col"], ["id", "x", "y", "quantity"])
    return P.sampled(p, A.cells(s, d), BASE).groupBy("source").agg(F.count("*").alias("n"), *[f(v).alias(f"{n}_{v}") for v in BASE for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


Q, SQL = {}, {}


def reg(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


reg(
    "slice_presence_background",
    A.sql(
        """, inside AS (SELECT * FROM placed SEMI JOIN mask USING (row, col) WHERE season = 'Winter' AND year = 1997),
one AS (SELECT * FROM inside QUALIFY row_number() OVER (PARTITION BY source, row, col ORDER BY id, x, y, quantity) = 1)
SELECT source, count(*) AS n, avg(size) AS mean_size, stddev_samp(size) AS sd_size, avg(price) AS mean_price, stddev_samp(price) AS sd_price, avg(balance) AS mean_balance, stddev_samp(balance) AS sd_balance
FROM one LEFT JOIN cells USING (row, col) GROUP BY source""",
        "placed",
        "mask",
    ),
)(slice_presence_background)


@reg("g1_cell_counts", A.sql("SELECT row, col, count(*) AS n, min(x) AS x FROM placed GROUP BY row, col", "placed"))
def _(s, d):
    return _points(s, d).groupBy("row", "col").agg(F.count("*").alias("n"), F.min("x").alias("x"))


@reg("f1_season_filter", A.sql("SELECT source, count(*) AS n, sum(quantity) AS q FROM points WHERE lower(season) = 'summer' AND year = 1999 GROUP BY source", "points"))
def _(s, d):
    return P.of_season(A.points(s, d), "SUMMER", 1999).groupBy("source").agg(F.count("*").alias("n"), F.sum("quantity").alias("q"))


@reg("f2_mask_points", A.sql("SELECT source, year, count(*) AS n FROM placed SEMI JOIN mask USING (row, col) GROUP BY source, year", "placed", "mask"))
def _(s, d):
    return P.in_mask(_points(s, d), A.mask(s, d)).groupBy("source", "year").agg(F.count("*").alias("n"))


@reg("f3_masked_layer", A.sql("SELECT count(*) AS n, count(m.row) AS inside, sum(CASE WHEN m.row IS NOT NULL THEN price END) AS price FROM cells c LEFT JOIN mask m ON c.row = m.row AND c.col = m.col", "cells", "mask"))
def _(s, d):
    return L.masked(A.cells(s, d), A.mask(s, d), ["price"]).agg(F.count("*").alias("n"), F.count("price").alias("inside"), F.sum("price").alias("price"))


@reg("f4_valid_range", A.sql("SELECT count(CASE WHEN balance BETWEEN 0 AND 5000 THEN 1 END) AS kept, avg(CASE WHEN balance BETWEEN 0 AND 5000 THEN balance END) AS mean FROM cells", "cells"))
def _(s, d):
    v = L.known("balance", low=0, high=5000)
    return A.cells(s, d).agg(F.count(v).alias("kept"), F.avg(v).alias("mean"))


@reg("g2_cell_dedupe", A.sql("SELECT id, row, col FROM placed QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY year, id, x, y, quantity) = 1", "placed"))
def _(s, d):
    return P.first_per(_points(s, d), ["row", "col"], ["year", "id", "x", "y", "quantity"]).select("id", "row", "col")


@reg("g2_cell_dedupe_yearly", A.sql("SELECT year, count(*) AS n, sum(id) AS ids FROM (SELECT id, year FROM placed QUALIFY row_number() OVER (PARTITION BY year, row, col ORDER BY id, x, y, quantity) = 1) GROUP BY year", "placed"))
def _(s, d):
    return P.first_per(_points(s, d), ["year", "row", "col"], ["id", "x", "y", "quantity"]).groupBy("year").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@reg("g3_grid_thinning", A.sql("SELECT source, count(*) AS n, sum(id) AS ids FROM (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY source, floor(x / 5000), floor(y / 5000) ORDER BY (id * 2654435761 + 7 * 40503) % 1000003, id, x, y, year, quantity) = 1) GROUP BY source", "points"))
def _(s, d):
    return P.thinned_to_grid(A.points(s, d), 5, _order(), ["source"]).groupBy("source").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


_POLICY = [("GBIF", 1995, 0.25), ("GBIF", 1996, 0.5), ("RRN", 1997, 0.67), ("SNCF", 1998, 1.0), ("SNCF", 1999, 0.00001)]
_POLICY_SQL = "policy(source, year, share) AS (VALUES " + ", ".join(f"('{a}', {b}, {c}::DOUBLE)" for a, b, c in _POLICY) + ")"


@reg(
    "g5_policy_thinning",
    A.sql(
        """, n AS (SELECT source, year, count(*) AS n FROM points GROUP BY ALL),
q AS (SELECT n.source, n.year, CASE WHEN share IS NULL OR share >= 1 OR n <= 3 THEN n ELSE greatest(1, floor(n * share)) END AS q FROM n LEFT JOIN policy USING (source, year)),
r AS (SELECT *, row_number() OVER (PARTITION BY source, year ORDER BY (id * 2654435761 + 7 * 40503) % 1000003, id, x, y, quantity) AS rn FROM points)
SELECT source, year, count(*) AS n, sum(id) AS ids FROM r JOIN q USING (source, year) WHERE rn <= q GROUP BY source, year""",
        "points",
        also=_POLICY_SQL,
    ),
)
def _(s, d):
    policy = s.createDataFrame(_POLICY, "source string, year int, share double")
    return P.thinned_by_policy(_drawn(s, d), policy, ["source", "year"], "draw", _TIE).groupBy("source", "year").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@reg("g6_equalise", A.sql(", l AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM points GROUP BY year)) SELECT year, count(*) AS n, sum(id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY (id * 2654435761 + 7 * 40503) % 1000003, id, x, y, quantity) AS rn FROM points), l WHERE rn <= least GROUP BY year", "points"))
def _(s, d):
    return P.equalised(_drawn(s, d), "year", "draw", _TIE).groupBy("year").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@reg("j1_sample_stack", A.sql("SELECT id, year, source, size, price, balance FROM placed LEFT JOIN cells USING (row, col)", "placed", "cells"))
def _(s, d):
    return P.sampled(_points(s, d), A.cells(s, d), BASE).select("id", "year", "source", *BASE)


@reg("j4_background_without_presence", A.sql("SELECT row, count(*) AS n FROM mask ANTI JOIN placed USING (row, col) GROUP BY row", "placed", "mask"))
def _(s, d):
    return P.without_cells(A.mask(s, d), _points(s, d)).groupBy("row").agg(F.count("*").alias("n"))


@reg("proj6_shifted_years", A.sql("SELECT year, count(*) AS n, min(x + (year % 3) * 1000000) AS x, max(y + floor((year - 1995) / 3) * 1000000) AS y FROM points GROUP BY year", "points"))
def _(s, d):
    offsets = A.points(s, d).select("year").distinct().select("year", (F.col("year") % 3 * 1000000).alias("dx"), (F.floor((F.col("year") - 1995) / 3) * 1000000).alias("dy"))
    return P.shifted(A.points(s, d), offsets).groupBy("year").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.max("y").alias("y"))


@reg("proj7_cell_centres", A.sql("SELECT row, col, 91000 + 1000 * (col + 0.5::DOUBLE) AS x, 7124000 - 1000 * (row + 0.5::DOUBLE) AS y, row * 1000 + col AS idx FROM mask", "mask"))
def _(s, d):
    return A.mask(s, d).select("row", "col", STUDY.center_x().alias("x"), STUDY.center_y().alias("y"), STUDY.index().alias("idx"))


_LAYERS = "v AS (SELECT DISTINCT variable, test_year FROM importance WHERE variable IS NOT NULL AND test_year IS NOT NULL), layers AS (SELECT test_year || '_' || variable AS layer, variable AS base, test_year AS year FROM v UNION ALL SELECT variable || '_' || test_year, variable, test_year FROM v UNION ALL SELECT DISTINCT variable, variable, NULL FROM v)"


def _layers(s, d):
    """Names of layers: each variable with its years before or behind it, and alone."""
    v = table(s, d, "importance").select("variable", F.col("test_year").cast("string").alias("y")).dropna().distinct()
    return v.select(F.concat_ws("_", "y", "variable").alias("layer")).unionByName(v.select(F.concat_ws("_", "variable", "y").alias("layer"))).unionByName(v.select(F.col("variable").alias("layer")).distinct())


@reg("proj2_strip_year", f"WITH {_LAYERS} SELECT layer, base, year FROM layers")
def _(s, d):
    return _layers(s, d).select("layer", L.base_name("layer").alias("base"), L.layer_year("layer").alias("year"))


@reg("proj3_year_columns", f"WITH {_LAYERS} SELECT layer FROM layers WHERE year IS NULL OR year = 2020")
def _(s, d):
    return L.of_year(_layers(s, d), 2020)


@reg("proj4_drop_rules", f"WITH {_LAYERS} SELECT layer FROM layers WHERE layer NOT IN (SELECT unnest(predictors) FROM training_context WHERE context_id <= 2) AND NOT contains(lower(layer), 'anom')")
def _(s, d):
    rules = table(s, d, "training_context").filter("context_id <= 2").select(F.explode("predictors").alias("layer")).distinct().withColumn("action", F.lit("DROP"))
    rules = rules.unionByName(s.createDataFrame([("slope", "keep")], rules.schema))
    return L.without_words(L.without_rules(_layers(s, d), rules))


_YEARLY = """, y AS (SELECT unnest([1995, 1996, 1997]) AS year), yearly AS (SELECT row, col, year || '_size' AS layer, CASE WHEN (row + col + year) % 4 <> 0 THEN size * (year - 1994) END::DOUBLE AS value FROM cells, y)
"""


def _yearly(s, d):
    c = A.cells(s, d).select("row", "col", "size", F.explode(F.array(*[F.lit(y) for y in (1995, 1996, 1997)])).alias("year"))
    return c.select("row", "col", F.concat(F.col("year").cast("string"), F.lit("_size")).alias("layer"), F.when((F.col("row") + F.col("col") + F.col("year")) % 4 != 0, F.col("size") * (F.col("year") - 1994)).cast("double").alias("value"))


@reg("j8_first_not_null", A.sql(_YEARLY + "SELECT row, col, 'size' AS layer, arg_min(value, layer) AS value FROM yearly WHERE value IS NOT NULL GROUP BY row, col", "cells"))
def _(s, d):
    return L.fused(_yearly(s, d))


@reg("a1_year_mean", A.sql(_YEARLY + "SELECT row, col, 'size' AS layer, avg(value) AS value FROM yearly GROUP BY row, col", "cells"))
def _(s, d):
    return L.year_mean(_yearly(s, d))


@reg("a4_coverage", "SELECT 'size' AS layer, [1995, 1996, 1997] AS available, [1998] AS missing, false AS excluded")
def _(s, d):
    e = s.createDataFrame([("size", y) for y in (1995, 1996, 1997, 1998)], "layer string, year int")
    return L.coverage(_yearly(s, d), e)


@reg("g24_satellite_fill", A.sql(", n AS (SELECT row, col, unnest([1995, 1997]) AS year, size FROM cells) SELECT row, col, '1996_04_ndvi' AS layer, avg(size * (year - 1990)::DOUBLE) AS value FROM n GROUP BY row, col", "cells"))
def _(s, d):
    c = A.cells(s, d).select("row", "col", "size", F.explode(F.array(F.lit(1995), F.lit(1997))).alias("year"))
    have = c.select("row", "col", F.concat(F.col("year").cast("string"), F.lit("_04_ndvi")).alias("layer"), (F.col("size") * (F.col("year") - 1990)).cast("double").alias("value"))
    wanted = s.createDataFrame([(1996, "04_ndvi"), (1995, "04_ndvi"), (1996, "class0_distance")], "year int, suffix string")
    return L.filled_from_other_years(have, wanted)


@reg("j7_mosaic", A.sql(", t AS (SELECT row, col, price AS v FROM cells WHERE col % 100 < 60 UNION ALL SELECT row, col, balance FROM cells WHERE col % 100 >= 40) SELECT row, col, coalesce(max(v), 0) AS value FROM t GROUP BY row, col", "cells"))
def _(s, d):
    c = A.cells(s, d)
    return L.mosaic(c.filter("col % 100 < 60").select("row", "col", F.col("price").alias("value")).unionByName(c.filter("col % 100 >= 40").select("row", "col", F.col("balance").alias("value"))))


@reg("j5_layers_joined", A.sql("SELECT row, col, size::DOUBLE AS size, price, CASE WHEN size % 3 <> 0 THEN balance END AS balance FROM cells", "cells"))
def _(s, d):
    c = A.cells(s, d)
    masked = L.masked(c.select("row", "col", "balance"), A.mask(s, d), ["balance"])
    return L.wide(L.long(c, ["size", "price"]).unionByName(L.long(masked, ["balance"])), BASE)


@reg("j6_years_aligned", A.sql("SELECT row, col, 1995 AS year, size, NULL::DOUBLE AS price FROM cells UNION ALL SELECT row, col, 1996, NULL, price FROM cells", "cells"))
def _(s, d):
    c = A.cells(s, d)
    return c.select("row", "col", F.lit(1995).alias("year"), "size").unionByName(c.select("row", "col", F.lit(1996).alias("year"), "price"), allowMissingColumns=True)


@reg("g9_bias_weights", A.sql("SELECT row, col, (0.7::DOUBLE * greatest(balance, 0) / 10000 + 0.3::DOUBLE) / sum(0.7::DOUBLE * greatest(balance, 0) / 10000 + 0.3::DOUBLE) OVER () AS p FROM cells WHERE size % 3 <> 0", "cells"))
def _(s, d):
    c = P.in_mask(A.cells(s, d), A.mask(s, d)).select("row", "col", (F.greatest("balance", F.lit(0.0)) / 10000).alias("bias"))
    return P.bias_weights(c, "bias", 0.7).select("row", "col", "p")


_U = "((({k}) * 2654435761 + {seed} * 40503) % 1000003 + 0.5::DOUBLE) / 1000003"


def _cell_u(seed):
    return (A.hashed(F.col("row") * 1000 + F.col("col"), seed) + 0.5) / 1000003


@reg("g9_weighted_background", A.sql(f", w AS (SELECT row, col, greatest(balance, 0) AS w, {_U.format(k='row * 1000 + col', seed=3)} AS u FROM cells WHERE size % 3 <> 0) SELECT row, col FROM w WHERE w > 0 QUALIFY row_number() OVER (ORDER BY -ln(u) / w, row, col) <= greatest(2, round((SELECT count(*) FROM w) * 0.1::DOUBLE))", "cells"))
def _(s, d):
    c = P.in_mask(A.cells(s, d), A.mask(s, d))
    return P.weighted_without_replacement(c, F.col("balance"), _cell_u(3), 0.1, ["row", "col"]).select("row", "col")


@reg("g7_uniform_background", A.sql(f", w AS (SELECT row, col, row * 1000 + col AS k FROM mask), t AS (SELECT * FROM w QUALIFY row_number() OVER (ORDER BY {_U.format(k='k', seed=5)}, row, col) <= greatest(2, round((SELECT count(*) FROM w) * 0.2::DOUBLE))) SELECT row, col, round(91000 + 1000 * (col + {_U.format(k='k', seed=8)}), 6) AS x, round(7124000 - 1000 * (row + {_U.format(k='k', seed=9)}), 6) AS y FROM t", "mask"))
def _(s, d):
    c = P.sampled_share(A.mask(s, d), 0.2, _cell_u(5), ["row", "col"])
    return c.select("row", "col", F.round(91000 + 1000 * (F.col("col") + _cell_u(8)), 6).alias("x"), F.round(7124000 - 1000 * (F.col("row") + _cell_u(9)), 6).alias("y"))


@reg("g8_background_with_replacement", A.sql("SELECT (count(*) // 10)::BIGINT AS draws, 0::BIGINT AS outside, true AS near FROM mask", "mask"))
def _(s, d):
    """Draws by weight with replacement and jitter: how many there are, how many lie outside the mask's cells, and whether
    the mean weight drawn is that of the weights (sum of squares over sum)."""
    all_ = staged(A.cells(s, d).select("row", "col", "size", "balance"))
    c = staged(P.in_mask(all_, A.inside(all_)).select("row", "col", "balance").withColumn("w", F.greatest("balance", F.lit(0.1))))
    want = c.agg((F.sum(F.col("w") * F.col("w")) / F.sum("w")).alias("want"), F.count("*").alias("n")).first()
    got = P.placed(P.jittered(P.with_replacement(c, F.col("w"), want.n // 10, ["row", "col"]), STUDY, "draw").withColumnsRenamed({"row": "r", "col": "c"}))
    return got.agg(F.count("*").alias("draws"), F.count_if((F.col("row") != F.col("r")) | (F.col("col") != F.col("c"))).alias("outside"), (F.abs(F.avg("w") / want.want - 1) < 0.05).alias("near"))


@reg("g10_tiled_mask", A.sql("SELECT row % 7 AS r, count(*) AS n FROM cells WHERE (row % 2) = (col % 2) GROUP BY r", "cells"))
def _(s, d):
    tile = s.createDataFrame([(0, 0), (1, 1)], "row int, col int")
    return L.tiled_mask(A.cells(s, d), tile, 2, 2).groupBy((F.col("row") % 7).alias("r")).agg(F.count("*").alias("n"))


@reg("g13_nearest_resample", A.sql("SELECT floor(row / 4)::BIGINT AS row, floor(col / 4)::BIGINT AS col, size FROM cells WHERE row % 4 = 2 AND col % 4 = 2", "cells"))
def _(s, d):
    return L.resampled(A.cells(s, d), 0.25, ["size"])


@reg("g13_finer_grid", A.sql("SELECT row * 2 + i AS row, col * 2 + j AS col, size FROM cells, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)", "cells"))
def _(s, d):
    return L.resampled(A.cells(s, d), 2, ["size"])


@reg("g15_directional_fill", A.sql(""", g AS (SELECT row, col, CASE WHEN (row * 31 + col * 17) % 5 = 0 THEN size END AS v FROM cells),
a AS (SELECT row, col, v, last_value(CASE WHEN v IS NOT NULL THEN row END IGNORE NULLS) OVER b AS br, last_value(v IGNORE NULLS) OVER b AS bv, first_value(CASE WHEN v IS NOT NULL THEN row END IGNORE NULLS) OVER f AS ar, first_value(v IGNORE NULLS) OVER f AS av
  FROM g WINDOW b AS (PARTITION BY col ORDER BY row ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY col ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
h AS (SELECT row, col, coalesce(v, CASE WHEN bv IS NOT NULL AND (av IS NULL OR row - br <= ar - row) THEN bv ELSE av END) AS v FROM a),
a2 AS (SELECT row, col, v, last_value(CASE WHEN v IS NOT NULL THEN col END IGNORE NULLS) OVER b AS br, last_value(v IGNORE NULLS) OVER b AS bv, first_value(CASE WHEN v IS NOT NULL THEN col END IGNORE NULLS) OVER f AS ar, first_value(v IGNORE NULLS) OVER f AS av
  FROM h WINDOW b AS (PARTITION BY row ORDER BY col ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY row ORDER BY col ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT row, col, coalesce(v, CASE WHEN bv IS NOT NULL AND (av IS NULL OR col - br <= ar - col) THEN bv ELSE av END) AS value FROM a2""", "cells"))
def _(s, d):
    g = A.cells(s, d).select("row", "col", F.when((F.col("row") * 31 + F.col("col") * 17) % 5 == 0, F.col("size")).alias("value"))
    return L.directional_fill(g)


@reg("g14_nearest_fill", A.sql(""", g AS (SELECT row, col, CASE WHEN (row * 31 + col * 17) % 5 <> 0 THEN size END AS v FROM cells),
st AS (SELECT i, j FROM (SELECT unnest(range(-9, 10)) AS i) CROSS JOIN (SELECT unnest(range(-9, 10)) AS j)), a AS (SELECT row, col, i, j, row + i AS r2, col + j AS c2 FROM g CROSS JOIN st WHERE v IS NULL),
n AS (SELECT a.row, a.col, arg_min(b.v, (i * i + j * j, r2, c2)) AS v FROM a JOIN g b ON b.row = r2 AND b.col = c2 WHERE b.v IS NOT NULL GROUP BY a.row, a.col)
SELECT g.row, g.col, coalesce(g.v, n.v) AS value FROM g LEFT JOIN n ON g.row = n.row AND g.col = n.col""", "cells"))
def _(s, d):
    g = A.cells(s, d).select("row", "col", F.when((F.col("row") * 31 + F.col("col") * 17) % 5 != 0, F.col("size")).alias("value"))
    return L.nearest_fill(g)


@reg("g13_foreign_grid", A.sql(f""", n AS (SELECT max(p_partkey) // {A.PARTS_A_ROW} + 1 AS n FROM part), t AS (SELECT i AS row, j AS col, floor((700 * (i + 0.5::DOUBLE) - 300) / 1000)::BIGINT AS sr, floor((700 * (j + 0.5::DOUBLE) + 250) / 1000)::BIGINT AS sc
  FROM (SELECT unnest(range(n * 1000 // 700 + 2)) AS i FROM n) CROSS JOIN range(1430) x(j)) SELECT t.row, t.col, size FROM t JOIN cells ON cells.row = sr AND cells.col = sc WHERE t.row < (SELECT n * 1000 // 700 FROM n) AND t.col < 1428""", "cells"))
def _(s, d):
    g = A.extent(s, d)
    rows = g.rows * 1000 // 700
    return L.regridded(A.cells(s, d), g, Grid(g.x0 + 250, g.top + 300 - rows * 700, 700.0, rows, 1428), ["size"])


@reg("g12_outline", A.sql(", e AS (SELECT 0 AS k, row AS r, col AS c FROM mask UNION ALL SELECT 0, row + 1, col FROM mask UNION ALL SELECT 1, row, col FROM mask UNION ALL SELECT 1, row, col + 1 FROM mask), o AS (SELECT k, r, c FROM e GROUP BY ALL HAVING count(*) = 1) SELECT 91000 + c * 1000.0::DOUBLE AS x1, 7124000 - r * 1000.0::DOUBLE AS y1, 91000 + (c + 1 - k) * 1000.0::DOUBLE AS x2, 7124000 - (r + k) * 1000.0::DOUBLE AS y2 FROM o", "mask"))
def _(s, d):
    return L.outline(A.mask(s, d), STUDY)


@reg("g18_predefined_bias", "SELECT meta_run, CASE WHEN count(DISTINCT season) = 1 THEN 'bias/' || min(season) || '.tif' ELSE 'bias/All_Semesters.tif' END AS path, count(DISTINCT season) <> 1 OR min(season) = 'Winter' AS exists FROM importance GROUP BY meta_run")
def _(s, d):
    runs = table(s, d, "importance").groupBy("meta_run").agg(F.collect_set("season").alias("seasons"))
    have = s.createDataFrame([("bias/All_Semesters.tif",), ("bias/Winter.tif",)], "path string")
    return L.predefined(runs, "seasons", "bias/{season}.tif", have).select("meta_run", "path", "exists")


@reg("g16_density", A.sql(""", k AS (SELECT unnest([-2, -1, 0, 1, 2]) AS i), w AS (SELECT i, exp(-0.5 * i * i) / (SELECT sum(exp(-0.5 * i * i)) FROM k) AS w FROM k),
c AS (SELECT row, col, count(*)::DOUBLE AS v FROM placed GROUP BY ALL),
a AS (SELECT row + i AS row, col, sum(v * w) AS v FROM c, w GROUP BY ALL), b AS (SELECT row, col + i AS col, sum(v * w) AS v FROM a, w GROUP BY ALL)
SELECT row, col, round(v / (SELECT max(v) FROM b), 9) AS value FROM b""", "placed"))
def _(s, d):
    return L.density(_points(s, d), 1.0, 2).withColumn("value", F.round("value", 9))


@reg("g17_urban_decay", A.sql(", e AS (SELECT row, col, exp(-3.0::DOUBLE * least(1, greatest(0, balance / 10000))) AS e FROM cells) SELECT row, col, (e - min(e) OVER ()) / (max(e) OVER () - min(e) OVER () + 1e-6::DOUBLE) AS value FROM e", "cells"))
def _(s, d):
    return L.urban_decay(A.cells(s, d).select("row", "col", (F.col("balance") / 10000).alias("value")), 3)


@reg("g19_bias_year_mean", A.sql(_YEARLY + "SELECT row, col, avg(value) AS value FROM yearly GROUP BY row, col", "cells"))
def _(s, d):
    return _yearly(s, d).groupBy("row", "col").agg(F.avg("value").alias("value"))


@reg("g20_validation_split", A.sql("SELECT CASE WHEN (id * 2654435761 + 9 * 40503) % 1000003 < 100000 THEN 'validation' ELSE 'train' END AS part, count(*) AS n, sum(quantity) AS q FROM points GROUP BY part", "points"))
def _(s, d):
    return A.points(s, d).groupBy(F.when(A.hashed("id", 9) < 100000, "validation").otherwise("train").alias("part")).agg(F.count("*").alias("n"), F.sum("quantity").alias("q"))


@reg("g21_stratified_split", A.sql(", r AS (SELECT *, row_number() OVER (PARTITION BY source, year ORDER BY (id * 2654435761 + 7 * 40503) % 1000003, id, x, y, quantity) AS rn, count(*) OVER (PARTITION BY source, year) AS n FROM points) SELECT source, year, CASE WHEN n >= 2 AND rn <= ceil(0.3::DOUBLE * n) THEN 'test' ELSE 'train' END AS part, count(*) AS n, sum(id) AS ids FROM r GROUP BY ALL", "points"))
def _(s, d):
    r = P.stratified_split(_drawn(s, d), ["source", "year"], 0.3, "draw", _TIE)
    return r.groupBy("source", "year", "part").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@reg("g22_row_sample", A.sql(f"SELECT row, col, size FROM cells QUALIFY row_number() OVER (ORDER BY {_U.format(k='row * 1000 + col', seed=6)}, row, col) <= greatest(4, round((SELECT count(*) FROM cells) * 0.05::DOUBLE))", "cells"))
def _(s, d):
    return P.sampled_share(A.cells(s, d), 0.05, _cell_u(6), ["row", "col"], least=len(BASE) + 1).select("row", "col", "size")


@reg("g23_control_layer", A.sql("SELECT m.row, m.col, CASE WHEN p.row IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS value FROM mask m LEFT JOIN (SELECT DISTINCT row, col FROM placed) p ON m.row = p.row AND m.col = p.col", "placed", "mask"))
def _(s, d):
    return L.control_layer(A.mask(s, d), _points(s, d))


@reg("g25_crowding_weights", A.sql(""", k AS (SELECT *, floor(x / 20000) AS cx, floor(y / 20000) AS cy FROM points), c AS (SELECT cx, cy, count(*) AS n FROM k GROUP BY ALL),
near AS (SELECT a.cx, a.cy, sum(b.n) AS near FROM c a JOIN c b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 GROUP BY ALL)
SELECT source, count(*) AS n, round(sum(w / m), 6) AS weight FROM (SELECT source, 1.0::DOUBLE / near AS w, avg(1.0::DOUBLE / near) OVER () AS m FROM k JOIN near USING (cx, cy)) GROUP BY source""", "points"))
def _(s, d):
    return P.crowding_weights(A.points(s, d), 20000).groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@reg("g25_distance_weights", ", p AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE, 2) AS x, round(embedding[2]::DOUBLE, 2) AS y FROM embeddings), r AS (SELECT a.id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS rn FROM p a JOIN p b ON a.id <> b.id), m AS (SELECT id, avg(d) AS d FROM r WHERE rn <= 8 GROUP BY id) SELECT id, round(d, 9) AS distance, round(d / avg(d) OVER (), 6) AS weight FROM m".lstrip(", ").join(["WITH ", ""]))
def _(s, d):
    e = F.col("embedding")
    p = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(e[0].cast("double"), 2).alias("x"), F.round(e[1].cast("double"), 2).alias("y"))
    return P.neighbour_weights(p, "id", "x", "y", 8, 0.02).select("id", F.round("distance", 9).alias("distance"), F.round("weight", 6).alias("weight"))


@reg("g26_grid_consistency", A.sql(", h AS (SELECT source || year AS layer, max(col) - min(col) AS width, max(row) - min(row) AS height, min(row)::DOUBLE AS a FROM placed GROUP BY ALL), f AS (SELECT * FROM h ORDER BY layer LIMIT 1) SELECT h.layer, h.width = f.width AND h.height = f.height AND abs(h.a - f.a) <= 1e-6 AS same FROM h, f", "placed"))
def _(s, d):
    """The extents of each source's and year's points as grids, against the first of them."""
    n = lambda c: F.max(c) - F.min(c)
    h = _points(s, d).groupBy(F.concat("source", F.col("year").cast("string")).alias("layer")).agg(n("col").alias("width"), n("row").alias("height"), F.min("row").cast("double").alias("a"))
    return L.consistent_grids(h, ["a"])


@reg("v1_leave_one_year_out", A.sql("SELECT t AS test_year, CASE WHEN year = t THEN 'test' ELSE 'train' END AS role, count(*) AS n, count(DISTINCT year) AS years FROM points, (SELECT unnest([1995, 1996, 1997]) AS t) GROUP BY ALL", "points"))
def _(s, d):
    return P.leave_one_year_out(A.points(s, d), [1995, 1996, 1997]).groupBy("test_year", "role").agg(F.count("*").alias("n"), F.countDistinct("year").alias("years"))


@reg("v2_block_folds", A.sql(", k AS (SELECT *, floor(x / 50000)::BIGINT AS bx, floor(y / 50000)::BIGINT AS b_y FROM points), b AS (SELECT bx, b_y, ntile(5) OVER (ORDER BY ((bx * 1000 + b_y) * 2654435761 + 40503) % 1000003, bx, b_y) AS fold FROM (SELECT DISTINCT bx, b_y FROM k)) SELECT fold, count(*) AS n, sum(id) AS ids FROM k JOIN b USING (bx, b_y) GROUP BY fold", "points"))
def _(s, d):
    order = A.hashed(F.col("bx") * 1000 + F.col("by"), 1)
    return P.block_folds(A.points(s, d), 50, 5, order).groupBy("fold").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@reg("v5_random_folds", A.sql("SELECT floor((id * 2654435761 + 2 * 40503) % 1000003 / 1000003.0::DOUBLE * 5)::BIGINT + 1 AS fold, count(*) AS n FROM points GROUP BY fold", "points"))
def _(s, d):
    return P.random_folds(A.points(s, d), 5, A.hashed("id", 2) / 1000003.0).groupBy("fold").agg(F.count("*").alias("n"))


@reg("g4_farthest_points")
def _(s, d):
    """Points are placed once thinned and written once, and of the stack only their cells are made."""
    thinned = P.thinned_to_grid(A.points(s, d), 20, _order(), ["source", "year"])
    p = staged(P.placed(thinned).select("id", "source", "year", "row", "col"))
    sampled = P.sampled(p, A.cells(s, d, p), ["price", "balance"])
    return P.farthest_points(sampled.select("id", "source", "year", "price", "balance"), ["source", "year"], ["price", "balance"], "id", 0.1)


QUERIES = Q

"""Queries on scores: classification and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import metrics as M
from terrane.plans import adapters as A

Q, SQL = {}, {}


def reg(name, body=None, also=""):
    def add(f):
        Q[name] = f
        if body:
            SQL[name] = A.sql(body, "scores", also=also)
        return f

    return add


_CURVE = """c AS (SELECT s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM scores GROUP BY s),
curve AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c)"""
_BOYCE = """b AS (SELECT least(floor(s * 25), 24)::BIGINT AS bin, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS a FROM scores WHERE s BETWEEN 0 AND 1 GROUP BY bin),
boyce AS (SELECT bin, (bin + 0.5::DOUBLE) / 25 AS centre, p * ta / (a * tp)::DOUBLE AS ratio FROM (SELECT *, sum(p) OVER () AS tp, sum(a) OVER () AS ta FROM b) WHERE a > 0)"""


@reg("m1_roc_auc", "SELECT (sum(CASE WHEN y = 1 THEN r END) - max(p) * (max(p) + 1) / 2.0::DOUBLE) / (max(p) * (count(*) - max(p))) AS auc FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r, sum(y) OVER () AS p FROM scores)")
def _(s, d):
    return M.roc_auc(A.scores(s, d))


@reg("m2_precision_recall", "SELECT s AS threshold, tp / (tp + fp)::DOUBLE AS precision, tp / p::DOUBLE AS recall FROM curve", _CURVE)
def _(s, d):
    return M.precision_recall(A.scores(s, d))


@reg("m2_average_precision", "SELECT sum(pos / p::DOUBLE * tp / (tp + fp)) AS ap FROM curve", _CURVE)
def _(s, d):
    return M.average_precision(A.scores(s, d))


@reg("m3_partial_auc", ", r AS (SELECT fp / n::DOUBLE AS x, tp / p::DOUBLE AS t FROM curve), z AS (SELECT 0.0::DOUBLE AS x, 0.0::DOUBLE AS t UNION ALL SELECT x, t FROM r WHERE x <= 0.1 UNION ALL SELECT 0.1::DOUBLE, arg_max(t, x) FROM r WHERE x <= 0.1), q AS (SELECT x - lag(x) OVER o AS dx, (t + lag(t) OVER o) / 2 AS h FROM z WINDOW o AS (ORDER BY x, t)) SELECT sum(dx * h) / 0.1::DOUBLE AS proc FROM q", _CURVE)
def _(s, d):
    return M.partial_auc(A.scores(s, d))


@reg("m4_confusion", "SELECT count(*) FILTER (s >= 0.4 AND y = 1) AS tp, count(*) FILTER (s >= 0.4 AND y = 0) AS fp, count(*) FILTER (s < 0.4 AND y = 1) AS fn, count(*) FILTER (s < 0.4 AND y = 0) AS tn FROM scores")
def _(s, d):
    return M.confusion(A.scores(s, d), 0.4)


_M5 = ", k AS (SELECT count(*) FILTER (s >= 0.4 AND y = 1) AS tp, count(*) FILTER (s >= 0.4 AND y = 0) AS fp, count(*) FILTER (s < 0.4 AND y = 1) AS fn, count(*) FILTER (s < 0.4 AND y = 0) AS tn FROM scores), r AS (SELECT *, tp / (tp + fn)::DOUBLE AS h, fp / (fp + tn)::DOUBLE AS f FROM k) "


@reg("m5_rates", _M5.lstrip() + "SELECT tp, fp, fn, tn, tp / (tp + fp)::DOUBLE AS precision, h AS recall, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1, 1 - h AS omission, (ln(f) - ln(h) - ln(1 - f) + ln(1 - h)) / (ln(f) + ln(h) + ln(1 - f) + ln(1 - h)) AS sedi FROM r")
def _(s, d):
    return M.rates(M.confusion(A.scores(s, d), 0.4))


@reg("m6_best_threshold", "SELECT s AS threshold, 2 * pr * r / (pr + r + 1e-9::DOUBLE) AS f1 FROM (SELECT s, tp / (tp + fp)::DOUBLE AS pr, tp / p::DOUBLE AS r FROM curve) ORDER BY f1 DESC, threshold LIMIT 1", _CURVE)
def _(s, d):
    return M.best_threshold(A.scores(s, d))


@reg("m6_best_threshold_shifted", ", f AS (SELECT s, lag(s) OVER (ORDER BY s) AS below, 2 * pr * r / (pr + r + 1e-9::DOUBLE) AS f1 FROM (SELECT s, tp / (tp + fp)::DOUBLE AS pr, tp / p::DOUBLE AS r FROM curve)) SELECT below AS threshold, f1 FROM f WHERE below IS NOT NULL ORDER BY f1 DESC, s LIMIT 1", _CURVE)
def _(s, d):
    return M.best_threshold(A.scores(s, d), "reference")


@reg("m8_boyce_curve", "SELECT * FROM boyce", _BOYCE)
def _(s, d):
    return M.boyce(A.scores(s, d))


@reg("m9_boyce_index", ", r AS (SELECT *, rank() OVER (ORDER BY centre) AS c, rank() OVER (ORDER BY ratio) + (count(*) OVER (PARTITION BY ratio) - 1) / 2.0::DOUBLE AS q FROM boyce) SELECT corr(centre, ratio) AS cbi_pearson, corr(c, q) AS cbi_spearman FROM r", _BOYCE)
def _(s, d):
    return M.boyce_index(A.scores(s, d))


@reg("m10_information", ", l AS (SELECT sum(CASE WHEN y = 1 THEN ln(s + 1e-9::DOUBLE) ELSE ln(1 - s + 1e-9::DOUBLE) END) AS ll, count(*) AS n FROM scores) SELECT ll, 10 - 2 * ll AS aic, 10 - 2 * ll + 60.0::DOUBLE / (n - 6) AS aicc FROM l")
def _(s, d):
    return M.information(A.scores(s, d), 5)


@reg("m11_omission_10", "SELECT avg(CASE WHEN s < (SELECT quantile_cont(s, 0.1) FROM scores WHERE y = 1 AND id % 3 <> 0) THEN 1.0::DOUBLE ELSE 0 END) AS or10 FROM scores WHERE y = 1 AND id % 3 = 0")
def _(s, d):
    x = A.scores(s, d)
    return M.omission_at_10(x.filter("id % 3 <> 0"), x.filter("id % 3 = 0"))


_AUC = lambda where: f"(SELECT (sum(CASE WHEN y = 1 THEN r END) - max(p) * (max(p) + 1) / 2.0::DOUBLE) / (max(p) * (count(*) - max(p))) FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r, sum(y) OVER () AS p FROM scores WHERE {where}))"


@reg("m12_auc_difference", f"SELECT round({_AUC('id % 3 <> 0')} - {_AUC('id % 3 = 0')}, 9) AS auc_diff")
def _(s, d):
    x = A.scores(s, d)
    return M.roc_auc(x.filter("id % 3 <> 0")).join(M.roc_auc(x.filter("id % 3 = 0")).withColumnRenamed("auc", "b")).select(F.round(F.col("auc") - F.col("b"), 9).alias("auc_diff"))


@reg("m13_topsis", ", v AS (SELECT id, s AS g, greatest(0, s * 100) / (1 + greatest(0, s * 100)) AS c, s / (1 + s) AS o, (1 - s) / (2 - s) AS f FROM scores) SELECT id, sqrt(4 * g * g + (1 - c) ** 2 + (1 - o) ** 2 + (1 - f) ** 2) / (sqrt(4 * (1 - g) ** 2 + c * c + o * o + f * f) + sqrt(4 * g * g + (1 - c) ** 2 + (1 - o) ** 2 + (1 - f) ** 2)) AS score FROM v")
def _(s, d):
    v = F.col("s")
    return A.scores(s, d).select("id", M.topsis(v, v, v, v, v, v - 1, v * 100).alias("score"))


@reg("m14_calibration", ", b AS (SELECT floor(s * 10)::BIGINT AS bin, avg(y)::DOUBLE AS v FROM scores WHERE s < 1 GROUP BY bin) SELECT t.bin, coalesce(v, 0) AS share FROM (SELECT unnest(range(10)) AS bin) t LEFT JOIN b ON b.bin = t.bin")
def _(s, d):
    return M.calibration(A.scores(s, d))


_SWEEP = """t AS (SELECT unnest(range(5, 95)) AS t), u AS (SELECT t, y, s, floor(s * 100 + 1e-9::DOUBLE) >= t AS up FROM scores, t),
auc AS (SELECT t, (count(*) FILTER (up AND y = 1) / (count(*) FILTER (y = 1))::DOUBLE + count(*) FILTER (NOT up AND y = 0) / (count(*) FILTER (y = 0))::DOUBLE) / 2 AS auc FROM u GROUP BY t),
sb AS (SELECT t, least(floor(s * 25), 24) AS bin, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS a FROM u WHERE up GROUP BY ALL),
sr AS (SELECT t, (bin + 0.5::DOUBLE) / 25 AS x, p * ta / (a * tp)::DOUBLE AS r FROM (SELECT *, sum(p) OVER (PARTITION BY t) AS tp, sum(a) OVER (PARTITION BY t) AS ta FROM sb) WHERE a > 0 AND tp >= 2 AND ta >= 2),
cb AS (SELECT t, CASE WHEN count(*) > 1 AND stddev_samp(r) > 0 THEN corr(x, r) END AS cbi FROM sr GROUP BY t), sweep AS (SELECT t / 100.0::DOUBLE AS threshold, auc, cbi FROM auc LEFT JOIN cb USING (t))"""


@reg("m15_threshold_sweep", "SELECT threshold, round(auc, 9) AS auc, round(cbi, 6) AS cbi FROM sweep", _SWEEP)
def _(s, d):
    return M.sweep(A.scores(s, d)).select("threshold", F.round("auc", 9).alias("auc"), F.round("cbi", 6).alias("cbi"))


@reg("m16_optimal_threshold", "SELECT threshold, round(cbi, 6) AS cbi FROM sweep WHERE cbi IS NOT NULL ORDER BY round(cbi, 9) DESC, threshold LIMIT 1", _SWEEP)
def _(s, d):
    return M.sweep(A.scores(s, d)).filter("cbi is not null").orderBy(F.desc(F.round("cbi", 9)), "threshold").limit(1).select("threshold", F.round("cbi", 6).alias("cbi"))


@reg("m17_crossing", ", z AS (SELECT centre, ratio - 1 AS d, lead(ratio) OVER o - 1 AS nd, lead(centre) OVER o AS nx FROM boyce WINDOW o AS (ORDER BY centre)), h AS (SELECT centre, centre - d * (nx - centre) / (nd - d) AS at_ FROM z WHERE d * nd <= 0 AND d <> nd ORDER BY centre LIMIT 1) SELECT coalesce((SELECT at_ FROM h), (SELECT centre FROM boyce ORDER BY abs(ratio - 1), centre LIMIT 1)) AS \"at\"", _BOYCE)
def _(s, d):
    return M.crossing(M.boyce(A.scores(s, d)))


@reg("f8_rejected_scores", "SELECT s IS NULL AS rejected, count(*) AS n FROM (SELECT CASE WHEN id % 13 = 0 THEN NULL ELSE s END AS s FROM scores) GROUP BY rejected")
def _(s, d):
    x = A.scores(s, d).withColumn("s", F.when(F.col("id") % 13 != 0, F.col("s")).otherwise(float("nan")))
    good, all_ = M.scored(x).agg(F.count("*").alias("n")), x.filter(F.col("s").isNull() | F.isnan("s")).agg(F.count("*").alias("n"))
    return good.select(F.lit(False).alias("rejected"), "n").unionByName(all_.select(F.lit(True).alias("rejected"), "n"))


QUERIES = Q

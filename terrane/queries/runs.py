"""Queries on run tables: summaries, comparisons, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import quota
from terrane.functions import text as X
from terrane.operators import audit as U
from terrane.operators import runs as T
from terrane.operators import stats as S
from terrane.plans import adapters as A
from terrane.session import table
from terrane.sources import inventory as V
from terrane.sources import sinks as K

Q, SQL = {}, {}
KEY = ["scenario", "season", "temporal", "engine"]


def reg(name, body=None, *needs, also=""):
    def add(f):
        Q[name] = f
        if body:
            SQL[name] = A.sql(body, *needs, also=also) if needs else body
        return f

    return add


@reg("a5_summary_all_rows", "SELECT scenario, engine, count(auc) AS n, avg(auc) AS mean, stddev_samp(auc) AS sd, 1.96 * stddev_samp(auc) / sqrt(count(*)) AS half FROM metrics GROUP BY ALL", "metrics")
def _(s, d):
    return S.interval(A.metrics(s, d), ["scenario", "engine"], "auc", "rows")


@reg("a6_summary_normal", "SELECT scenario, engine, split, count(auc) AS n, avg(auc) AS mean, stddev_samp(auc) AS sd, CASE WHEN count(auc) > 1 THEN 1.96 * stddev_samp(auc) / sqrt(count(auc)) END AS half FROM metrics WHERE lower(split) = 'test' GROUP BY ALL", "metrics")
def _(s, d):
    return S.interval(A.metrics(s, d).filter(F.lower("split") == "test"), ["scenario", "engine", "split"], "auc")


#: Student's t at 0.975 for 1 to 11 degrees of freedom.
_T = (12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163, 2.228138852, 2.200985160)


@reg("a7_summary_student", ", f AS (SELECT scenario, engine, test_year, avg(cbi) AS cbi FROM metrics GROUP BY ALL), g AS (SELECT scenario, engine, count(cbi) AS n, avg(cbi) AS mean, stddev_samp(cbi) AS sd FROM f GROUP BY ALL) SELECT scenario, engine, n, mean, sd, round(t, 6) AS t, round(t * sd / sqrt(n), 6) AS half FROM g JOIN (VALUES " + ", ".join(f"({i + 2}, {t}::DOUBLE)" for i, t in enumerate(_T)) + ") t(n, t) USING (n)", "metrics")
def _(s, d):
    folds = A.metrics(s, d).groupBy("scenario", "engine", "test_year").agg(F.avg("cbi").alias("cbi"))
    g = S.interval(folds, ["scenario", "engine"], "cbi", "student")
    return g.withColumns({"t": F.round("t", 6), "half": F.round("half", 6)})


@reg("a8_combination_summary", "SELECT scenario, season, temporal, engine, split, avg(cbi) AS cbi_mean, stddev_samp(cbi) AS cbi_std, avg(auc) AS auc_mean, stddev_samp(auc) AS auc_std, count(DISTINCT test_year) AS years FROM metrics WHERE split IN ('validation', 'test') GROUP BY ALL", "metrics")
def _(s, d):
    return T.combinations(A.metrics(s, d), KEY, ["cbi", "auc"])


@reg("a9_pivot_splits", "SELECT scenario, engine, avg(auc) FILTER (split = 'validation') AS auc_validation, avg(auc) FILTER (split = 'test') AS auc_test, avg(cbi) FILTER (split = 'validation') AS cbi_validation, avg(cbi) FILTER (split = 'test') AS cbi_test FROM metrics GROUP BY ALL", "metrics")
def _(s, d):
    return T.by_split(A.metrics(s, d), ["scenario", "engine"], ["auc", "cbi"])


@reg("a10_importance_summary", "SELECT meta_run, variable, avg(value) AS mean, stddev_samp(value) AS std, median(value) AS median, count(value) AS n, stddev_samp(value) / nullif(avg(value), 0) AS cv FROM importances GROUP BY ALL", "importances")
def _(s, d):
    return T.importance_summary(A.importances(s, d), ["meta_run", "variable"], "value")


@reg("a11_relative_importance", "SELECT id, round(value / nullif(sum(value) OVER (PARTITION BY meta_run, combo), 0), 6) AS relative FROM importances", "importances")
def _(s, d):
    i = A.importances(s, d).withColumn("value", F.col("value"))
    return S.share_of_total(i, ["meta_run", "combo"], "value").select("id", F.round("relative", 6).alias("relative"))


@reg("a12_fold_importance", "SELECT meta_run, variable, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, round(stddev_samp(value) / sqrt(count(value)), 9) AS se, min(value) AS min, max(value) AS max, count(*) FILTER (value > 0) AS positive FROM importances GROUP BY ALL", "importances")
def _(s, d):
    f = T.fold_summary(A.importances(s, d), ["meta_run", "variable"], "value")
    # the interval over the root's own quantile: t is checked by a7
    return f.select("meta_run", "variable", "n", "mean", "sd", F.round(F.col("half") / F.col("t"), 9).alias("se"), "min", "max", "positive")


@reg("a13_repeats", "SELECT variable, combo, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, min(value) AS min, max(value) AS max FROM importances GROUP BY ALL", "importances")
def _(s, d):
    return T.repeats(A.importances(s, d), ["variable", "combo"], "value")


@reg("a14_bias_strength", "SELECT (o_custkey % 5) / 4.0::DOUBLE AS bias_strength, count(*) AS n, avg(floor(o_totalprice) % 500 / 500.0::DOUBLE) AS auc_mean, stddev_samp(floor(o_totalprice) % 500 / 500.0::DOUBLE) AS auc_std, avg(CASE WHEN o_orderkey % 3 <> 0 THEN floor(o_totalprice) % 97 / 97.0::DOUBLE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) % 83 / 83.0::DOUBLE END) AS pearson_mean, avg(floor(o_totalprice) % 89 / 89.0::DOUBLE) AS spearman_mean FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def _(s, d):
    """Orders as trials: a strength, metrics of which some are missing, and a state."""
    k = F.col("o_orderkey")
    o = table(s, d, "orders").select(
        (F.col("o_custkey") % 5 / 4).alias("bias_strength"), (F.floor("o_totalprice") % 500 / 500).alias("auc"), F.when(k % 3 != 0, F.floor("o_totalprice") % 97 / 97).alias("pearson"),
        (F.floor("o_totalprice") % 89 / 89).alias("spearman"), F.when(k % 2 == 0, F.floor("o_totalprice") % 83 / 83).alias("cbi"), F.when(F.col("o_orderstatus") == "P", "FAIL").otherwise("complete").alias("state"),
    )
    return T.strength_summary(o, "bias_strength")


@reg("a15_class_summary", ", l AS (UNPIVOT design ON v0, v1, v2, v3 INTO NAME variable VALUE value) SELECT variable, y, avg(value) AS mean, stddev_samp(value) AS std FROM l GROUP BY ALL", "design")
def _(s, d):
    return T.class_summary(A.design(s, d), ["v0", "v1", "v2", "v3"])


@reg("a16_score_distribution", "SELECT y, count(s) AS n, min(s) AS min, quantile_cont(s, 0.05) AS p05, quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.5) AS median, quantile_cont(s, 0.75) AS q3, quantile_cont(s, 0.95) AS p95, max(s) AS max, avg(s) AS mean FROM scores GROUP BY y", "scores")
def _(s, d):
    return S.distribution(A.scores(s, d), ["y"], "s")


@reg("a17_missing_unique", "SELECT 'auc' AS variable, count(*) FILTER (auc IS NULL) AS missing, count(DISTINCT auc) AS uniques FROM metrics UNION ALL SELECT 'cbi', count(*) FILTER (cbi IS NULL), count(DISTINCT cbi) FROM metrics", "metrics")
def _(s, d):
    return T.missing_and_unique(A.metrics(s, d), ["auc", "cbi"])


_V = ["v0", "v1", "v2", "v3"]
_PAIRS = ", ".join(f"corr({a}, {b}) AS {a}{b}" for i, a in enumerate(_V) for b in _V[i + 1 :])
_CORR = f"k AS (SELECT {_PAIRS} FROM design), corrs AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a}{b} AS r FROM k" for i, a in enumerate(_V) for b in _V[i + 1 :]) + ")"


@reg("a18_correlation_pairs", "SELECT a, b, round(r, 9) AS r FROM corrs", "design", also=_CORR)
def _(s, d):
    return S.correlations(A.design(s, d), _V).withColumn("r", F.round("r", 9))


@reg("a19_correlation_complete", "SELECT round(corr(auc, cbi), 9) AS r FROM metrics WHERE auc IS NOT NULL AND cbi IS NOT NULL", "metrics")
def _(s, d):
    return S.correlations(A.metrics(s, d), ["auc", "cbi"], complete=True).select(F.round("r", 9).alias("r"))


@reg("a20_uniqueness", ", b AS (SELECT a AS variable, r FROM corrs UNION ALL SELECT b, r FROM corrs) SELECT variable, round(1 - max(abs(r)), 9) AS uniqueness FROM b GROUP BY variable", "design", also=_CORR)
def _(s, d):
    return S.uniqueness(S.correlations(A.design(s, d), _V)).withColumn("uniqueness", F.round("uniqueness", 9))


@reg("a21_domain_correlations", "SELECT * FROM (SELECT 'bio' AS domain, 'v0' AS a, 'v1' AS b, round(corr(v0, v1), 9) AS r FROM design UNION ALL SELECT 'era5', 'v2', 'v3', round(corr(v2, v3), 9) FROM design)", "design")
def _(s, d):
    domain = s.createDataFrame([("v0", "bio"), ("v1", "bio"), ("v2", "era5"), ("v3", "era5")], "variable string, domain string")
    return S.within_domains(S.correlations(A.design(s, d), _V), domain).withColumn("r", F.round("r", 9))


@reg("a22_moments", "SELECT meta_run, count(*) AS n, sum(value) AS total, sum(value * value) AS squares, min(value) AS min, max(value) AS max, count(*) FILTER (value < 0) AS negative, count(*) FILTER (value < -0.01) AS below_low, count(*) FILTER (value > 0.05) AS above_high, avg(value) AS mean, stddev_pop(value) AS sd FROM importances GROUP BY meta_run", "importances")
def _(s, d):
    return S.merged_moments(S.moments(A.importances(s, d), ["meta_run", "variable"], "value", -0.01, 0.05), ["meta_run"])


_HIST = "h AS (SELECT least(floor((greatest(-500, least(100, balance / 20)) + 500) / 0.5::DOUBLE), 1199)::BIGINT AS bin, count(*) AS n FROM cells GROUP BY bin)"


@reg("a23_histogram", "SELECT * FROM h", "cells", also=_HIST)
def _(s, d):
    return S.histogram(A.cells(s, d).withColumn("v", F.col("balance") / 20), [], "v", -500, 100, 0.5)


@reg("a24_histogram_quantile", ", c AS (SELECT bin, n, sum(n) OVER (ORDER BY bin) AS c, sum(n) OVER () AS t FROM h) SELECT -500 + 0.5::DOUBLE * (bin + (0.95::DOUBLE * t - (c - n)) / n) AS value FROM c WHERE c >= 0.95 * t ORDER BY bin LIMIT 1", "cells", also=_HIST)
def _(s, d):
    h = S.histogram(A.cells(s, d).withColumn("v", F.col("balance") / 20), [], "v", -500, 100, 0.5)
    return S.histogram_quantile(h, [], 0.95, -500, 0.5)


@reg("a25_boxplot", "SELECT season, engine, temporal, count(auc) AS n, min(auc) AS min, quantile_cont(auc, 0.05) AS p05, quantile_cont(auc, 0.25) AS q1, quantile_cont(auc, 0.5) AS median, quantile_cont(auc, 0.75) AS q3, quantile_cont(auc, 0.95) AS p95, max(auc) AS max, avg(auc) AS mean FROM metrics GROUP BY ALL", "metrics")
def _(s, d):
    return S.distribution(A.metrics(s, d), ["season", "engine", "temporal"], "auc")


@reg("a28_correlation_change", ", o AS (SELECT corr(v0, v1) AS a, corr(v0, v2) AS b, corr(v1, v2) AS c FROM design WHERE y = 0), n AS (SELECT corr(v0, v1) AS a, corr(v0, v2) AS b, corr(v1, v2) AS c FROM design WHERE y = 1), d AS (SELECT unnest([n.a - o.a, n.b - o.b, n.c - o.c]) AS d FROM o, n) SELECT avg(abs(d)) AS mean_abs, max(abs(d)) AS max_abs, sqrt(2 * sum(d * d) / 9) AS frobenius FROM d", "design")
def _(s, d):
    x = A.design(s, d)
    return S.correlation_change(S.correlations(x.filter("y = 0"), _V[:3]), S.correlations(x.filter("y = 1"), _V[:3]), 3)


@reg("a32_coverage_counts", "SELECT scenario, engine, count(DISTINCT test_year) AS years, count(DISTINCT test_year) = 7 AS complete FROM metrics GROUP BY ALL", "metrics")
def _(s, d):
    return T.covered(A.metrics(s, d), ["scenario", "engine"], "test_year", 7)


@reg("a31_group_mean", "SELECT avg(auc) AS mean FROM metrics WHERE scenario = 'BUILDING' AND temporal = 'monotemporal' AND engine = 'gbm'", "metrics")
def _(s, d):
    return T.by_split(A.metrics(s, d).filter("scenario = 'BUILDING' and temporal = 'monotemporal' and engine = 'gbm'").withColumn("split", F.lit("all")), ["scenario"], ["auc"], ["all"]).select(F.col("auc_all").alias("mean"))


@reg("a30_fold_means", "SELECT test_year, avg(auc) AS auc, avg(cbi) AS cbi FROM metrics GROUP BY test_year", "metrics")
def _(s, d):
    return S.means(A.metrics(s, d), ["test_year"], ["auc", "cbi"])


@reg("a33_distinct_predictors", "SELECT variable, min(id) AS first FROM importances GROUP BY variable", "importances")
def _(s, d):
    return U.deduped(A.importances(s, d), "variable", "id").select("variable", F.col("id").alias("first"))


@reg("a34_effective_percentage", "WITH t AS (SELECT source, CAST(semester[1:4] AS INT) AS year, round(sum(target_per_10k / 10000.0::DOUBLE), 9) AS share FROM sample_targets WHERE source <> 'SNCF' GROUP BY ALL) SELECT year, least(min(share), 0.03::DOUBLE) AS share FROM t GROUP BY year")
def _(s, d):
    """Targets by source and year as shares, SNCF's flat."""
    t = table(s, d, "sample_targets").select("source", F.substring("semester", 1, 4).cast("int").alias("year"), (F.col("target_per_10k") / 10000).alias("share"))
    t = t.groupBy("source", "year").agg(F.round(F.sum("share"), 9).alias("share")).filter("source <> 'SNCF'").withColumn("flat", F.lit(None).cast("double"))
    flat = s.createDataFrame([("SNCF", None, None, 0.03)], t.schema)
    return T.effective_share(t.unionByName(flat))


@reg("a35_vif_summary", "SELECT meta_run AS run, variable, CASE WHEN variable = 'var_3' THEN max(vif) + 1 ELSE max(vif) END AS vif, CASE WHEN variable = 'var_3' THEN 'computed' ELSE 'table' END AS kind FROM importances WHERE variable <> 'var_7' OR meta_run = 'F' GROUP BY meta_run, variable", "importances")
def _(s, d):
    """Requested: all variables of a run; its table: those but var_3; computed: what runs of the other kind have of it."""
    i = A.importances(s, d).select(F.col("meta_run").alias("run"), "variable", "vif")
    return T.inflation_summary(i, i.filter("variable <> 'var_3'"), i.filter("variable in ('var_3', 'var_5')").withColumn("vif", F.col("vif") + 1)).filter("variable <> 'var_7' or run = 'F'")


@reg("a36_audit_rollup", "SELECT scenario, count(*) AS n, string_agg(issue, ' | ' ORDER BY issue) AS issues FROM (SELECT DISTINCT scenario, split || ' ' || test_year AS issue FROM metrics WHERE auc IS NULL) GROUP BY scenario", "metrics")
def _(s, d):
    m = A.metrics(s, d)
    return T.issues(m, "scenario", F.when(F.col("auc").isNull(), F.concat_ws(" ", "split", F.col("test_year").cast("string"))))


@reg("a37_best_test_row", "SELECT engine, run_id, auc, coalesce(cbi, auc / 2) AS cbi FROM metrics WHERE split = 'test' QUALIFY row_number() OVER (PARTITION BY engine ORDER BY auc DESC NULLS LAST, run_id) = 1", "metrics")
def _(s, d):
    m = A.metrics(s, d).withColumn("pearson", F.col("auc") / 2)
    return T.best_test(m, "engine", "run_id", "cbi", "pearson")


@reg("r1_welch", ", g AS (SELECT variable, count(value) FILTER (meta_run = 'F') AS n_a, count(value) FILTER (meta_run = 'O') AS n_b, avg(value) FILTER (meta_run = 'F') AS mean_a, avg(value) FILTER (meta_run = 'O') AS mean_b, var_samp(value) FILTER (meta_run = 'F') AS va, var_samp(value) FILTER (meta_run = 'O') AS vb FROM importances GROUP BY variable), e AS (SELECT *, va / n_a AS ea, vb / n_b AS eb FROM g) SELECT variable, n_a, n_b, mean_a, mean_b, mean_b - mean_a AS difference, round((mean_b - mean_a) / sqrt(ea + eb), 6) AS t, round((ea + eb) ** 2 / (ea ** 2 / (n_a - 1) + eb ** 2 / (n_b - 1)), 4) AS df, round((mean_b - mean_a) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 6) AS cohen_d FROM e", "importances")
def _(s, d):
    w = S.welch(A.importances(s, d), ["variable"], "meta_run", "F", "O", "value")
    return w.select("variable", "n_a", "n_b", "mean_a", "mean_b", "difference", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"), F.round("cohen_d", 6).alias("cohen_d"))


@reg("r1_welch_tests", ", g AS (SELECT variable, count(value) FILTER (meta_run = 'F') AS n_a, count(value) FILTER (meta_run = 'O') AS n_b, avg(value) FILTER (meta_run = 'F') AS a, avg(value) FILTER (meta_run = 'O') AS b, var_samp(value) FILTER (meta_run = 'F') AS va, var_samp(value) FILTER (meta_run = 'O') AS vb FROM importances GROUP BY variable) SELECT variable, round((b - a) / sqrt(va / n_a + vb / n_b), 6) AS t, true AS agree, true AS inside FROM g", "importances")
def _(s, d):
    """The test and its interval agree: p is below 0.05 where the interval of the difference leaves 0 out."""
    w = S.welch(A.importances(s, d), ["variable"], "meta_run", "F", "O", "value")
    return w.select("variable", F.round("t", 6).alias("t"), ((F.col("p") < 0.05) == ((F.col("low") > 0) | (F.col("high") < 0))).alias("agree"), F.col("difference").between(F.col("low"), F.col("high")).alias("inside"))


@reg("r3_run_comparison", ", g AS (SELECT variable, avg(value) FILTER (meta_run = 'F') AS mean_a, avg(value) FILTER (meta_run = 'O') AS mean_b, avg(vif) FILTER (meta_run = 'F') AS vif_a, avg(vif) FILTER (meta_run = 'O') AS vif_b FROM importances GROUP BY variable) SELECT variable, mean_a, mean_b, round(100 * (mean_b - mean_a) / nullif(abs(mean_a), 0), 6) AS percent, vif_a, vif_b FROM g WHERE mean_a IS NOT NULL AND mean_b IS NOT NULL", "importances")
def _(s, d):
    return T.compared(A.importances(s, d), "variable", "meta_run", "F", "O", "value", "vif").withColumn("percent", F.round("percent", 6))


@reg("r4_temporal_comparison", "SELECT scenario, avg(auc) FILTER (temporal = 'monotemporal') AS mean_a, avg(auc) FILTER (temporal = 'multitemporal') AS mean_b, avg(auc) FILTER (temporal = 'multitemporal') - avg(auc) FILTER (temporal = 'monotemporal') AS difference FROM metrics GROUP BY scenario", "metrics")
def _(s, d):
    return S.welch(A.metrics(s, d).withColumn("temporal", F.lower("temporal")), ["scenario"], "temporal", "monotemporal", "multitemporal", "auc").select("scenario", "mean_a", "mean_b", "difference")


@reg("r5_season_report", "SELECT lower(season) AS season, engine, count(*) AS n, avg(cbi) AS cbi FROM metrics GROUP BY ALL", "metrics")
def _(s, d):
    return A.metrics(s, d).groupBy(F.lower("season").alias("season"), "engine").agg(F.count("*").alias("n"), F.avg("cbi").alias("cbi"))


@reg("r6_top_differences", ", g AS (SELECT variable, avg(value) FILTER (meta_run = 'O') - avg(value) FILTER (meta_run = 'F') AS difference FROM importances GROUP BY variable) SELECT variable, difference FROM g ORDER BY round(abs(difference), 12) DESC, variable LIMIT 5", "importances")
def _(s, d):
    w = S.welch(A.importances(s, d), ["variable"], "meta_run", "F", "O", "value")
    return T.top_differences(w, "difference", "variable", 5).select("variable", "difference")


@reg("r7_extremes", ", b AS (SELECT engine, test_year, avg(auc) AS auc FROM metrics GROUP BY ALL) SELECT engine, arg_min(test_year, (auc, test_year)) AS worst, arg_max(test_year, (auc, -test_year)) AS best, count(*) FILTER (auc < 0.745) AS low, max(auc) - min(auc) AS spread FROM b GROUP BY engine", "metrics")
def _(s, d):
    return T.extremes(A.metrics(s, d), "engine", "test_year", "auc", 0.745)


@reg("r10_stable_hash", "SELECT run_id, sha256('{\"engine\":\"' || engine || '\",\"scenario\":\"' || scenario || '\"}') AS hash FROM metrics", "metrics")
def _(s, d):
    return A.metrics(s, d).select("run_id", F.sha2(F.to_json(F.struct("engine", "scenario")), 256).alias("hash"))


@reg("r11_validation_checks", "SELECT 'has_rows' AS check, count(*) > 0 AS passed FROM metrics UNION ALL SELECT 'auc_in_range', bool_and(auc BETWEEN 0 AND 1) FROM metrics UNION ALL SELECT 'all_known', bool_and(cbi IS NOT NULL) FROM metrics", "metrics")
def _(s, d):
    return U.checks(A.metrics(s, d), {"has_rows": F.count("*") > 0, "auc_in_range": F.bool_and(F.col("auc").between(0, 1)), "all_known": F.bool_and(F.col("cbi").isNotNull())})


@reg("r13_override_class", "SELECT run_id, CASE WHEN scenario LIKE 'B%' THEN 'intended' WHEN engine = 'gbm' THEN 'engine' ELSE 'review' END AS class FROM metrics", "metrics")
def _(s, d):
    return T.classified(A.metrics(s, d), [("scenario", "begins", "B", "intended"), ("engine", "equals", "gbm", "engine")]).select("run_id", "class")


@reg("r16_register", "SELECT scenario, test_year, row_number() OVER (ORDER BY scenario, test_year) AS place FROM (SELECT DISTINCT scenario, test_year FROM metrics)", "metrics")
def _(s, d):
    from pyspark.sql import Window as W

    return A.metrics(s, d).select("scenario", "test_year").distinct().withColumn("place", F.row_number().over(W.orderBy("scenario", "test_year")).cast("bigint"))


@reg("r22_artifact_status", "SELECT scenario AS name, count(*) AS n, 'generated' AS status FROM metrics GROUP BY scenario UNION ALL SELECT 'NOWHERE', 0, 'missing' UNION ALL SELECT 'later', 0, 'skipped'", "metrics")
def _(s, d):
    """Scenarios of the run table and one that was never made, as wanted artifacts."""
    m = A.metrics(s, d).withColumnRenamed("scenario", "name")
    wanted = m.select("name").distinct().unionByName(s.createDataFrame([("NOWHERE",), ("later",)], "name string"))
    return T.statuses(wanted, m, "name", ["later"])


@reg("l13_best_runs", "SELECT scenario, season, temporal, engine, run_id, cbi FROM metrics WHERE split = 'test' QUALIFY row_number() OVER (PARTITION BY scenario, season, temporal, engine ORDER BY cbi DESC NULLS LAST, run_id) = 1", "metrics")
def _(s, d):
    return S.top_row(A.metrics(s, d).filter("split = 'test'"), KEY, "cbi", ["run_id"]).select(*KEY, "run_id", "cbi")


@reg("l14_top_per_engine", "SELECT engine, scenario, run_id FROM metrics QUALIFY row_number() OVER (PARTITION BY engine ORDER BY cbi DESC NULLS LAST, run_id) <= 20", "metrics")
def _(s, d):
    return T.top_first(A.metrics(s, d), ["engine"], [F.desc_nulls_last("cbi"), "run_id"], 20).select("engine", "scenario", "run_id")


@reg("l17_objective", "SELECT run_id, coalesce(auc, 0) + coalesce(cbi, 0) AS total, (coalesce(auc, 0) + coalesce(cbi, 0)) / 2 AS mean FROM metrics", "metrics")
def _(s, d):
    return T.objective(A.metrics(s, d), ["auc", "cbi"]).select("run_id", "total", "mean")


@reg("l16_grid_trials", ", y AS (SELECT DISTINCT test_year FROM metrics) SELECT test_year, km, b / 10.0::DOUBLE AS bias, row_number() OVER (ORDER BY test_year, km, b) AS trial FROM y, (SELECT unnest([5, 10, 20, 40, 80]) AS km), (SELECT unnest([0, 2, 4, 6, 8, 10]) AS b)", "metrics")
def _(s, d):
    """Trials of every distance and strength, laid out over the years of the run table."""
    g = T.expected(A.metrics(s, d), {"km": [5, 10, 20, 40, 80], "b": [0, 2, 4, 6, 8, 10]}, "test_year")
    return K.numbered(g.select("test_year", "km", (F.col("b") / 10.0).alias("bias")), "test_year", "km", "bias").withColumn("trial", F.col("n").cast("bigint")).drop("n")


@reg("j9_importance_vif", "SELECT i.variable, i.n, v.vif FROM (SELECT variable, count(*) AS n FROM importances GROUP BY variable) i LEFT JOIN (SELECT variable, max(vif) AS vif FROM importances WHERE variable < 'var_3' GROUP BY variable) v USING (variable)", "importances")
def _(s, d):
    i = A.importances(s, d)
    return T.with_inflation(i.groupBy("variable").agg(F.count("*").alias("n")), i.filter("variable < 'var_3'"), ["variable"])


@reg("j10_validation_of_best", ", t AS (SELECT * FROM metrics WHERE split = 'test' QUALIFY row_number() OVER (PARTITION BY scenario, engine ORDER BY cbi DESC NULLS LAST, run_id) = 1), v AS (SELECT scenario, engine, test_year, max(cbi) AS validation FROM metrics WHERE split = 'validation' GROUP BY ALL) SELECT scenario, engine, test_year, t.cbi AS test, validation FROM t LEFT JOIN v USING (scenario, engine, test_year)", "metrics")
def _(s, d):
    return T.validation_of_best(A.metrics(s, d), ["scenario", "engine"], "test_year", "cbi", "run_id")


@reg("j11_shared_variables", "SELECT variable FROM importances WHERE meta_run = 'F' INTERSECT SELECT variable FROM importances WHERE meta_run = 'O'", "importances")
def _(s, d):
    return T.shared(A.importances(s, d), "meta_run", ["F", "O"], "variable")


@reg("j12_run_pairs", ", g AS (SELECT season, test_year, temporal, avg(auc) AS auc FROM metrics GROUP BY ALL), p AS (SELECT a.season, a.test_year, a.auc AS mono, b.auc AS multi FROM g a JOIN g b USING (season, test_year) WHERE a.temporal = 'monotemporal' AND b.temporal = 'multitemporal') SELECT season, test_year, 'mono' AS kind, mono AS auc FROM p UNION ALL SELECT season, test_year, 'multi', multi FROM p UNION ALL SELECT season, test_year, 'difference', multi - mono FROM p", "metrics")
def _(s, d):
    return T.paired(A.metrics(s, d), ["season", "test_year"], "temporal", {"mono": "monotemporal", "multi": "multitemporal"}, "auc")


@reg("j13_predictor_pairs", "WITH p AS (SELECT DISTINCT context_id, unnest(predictors) AS v FROM training_context) SELECT context_id, a.v AS a, b.v AS b FROM p a JOIN p b USING (context_id) WHERE a.v < b.v")
def _(s, d):
    p = table(s, d, "training_context").select("context_id", F.explode("predictors").alias("variable"))
    return T.unordered_pairs(p, "variable", ["context_id"])


@reg("j14_missing_runs", ", e AS (SELECT scenario, engine, test_year, split FROM (SELECT DISTINCT scenario FROM metrics), (SELECT DISTINCT engine FROM metrics), (SELECT unnest(range(1990, 2010)) AS test_year), (SELECT unnest(['train', 'validation', 'test']) AS split)) SELECT * FROM e ANTI JOIN metrics USING (scenario, engine, test_year, split)", "metrics")
def _(s, d):
    m = A.metrics(s, d)
    e = T.expected(m, {"test_year": range(1990, 2010), "split": ["train", "validation", "test"]}, "scenario", "engine")
    return U.missing_rows(e, m, ["scenario", "engine", "test_year", "split"])


@reg("j15_config_diff", ", a AS (SELECT 'u' || user_id AS path, min(json_extract_string(props, '$.k')) AS value FROM events WHERE event_type = 'view' GROUP BY user_id), b AS (SELECT 'u' || user_id AS path, min(json_extract_string(props, '$.k')) AS value FROM events WHERE event_type = 'click' GROUP BY user_id) SELECT coalesce(a.path, b.path) AS path, a.value AS \"left\", b.value AS \"right\", CASE WHEN coalesce(a.path, b.path) IN ('u1', 'u7') THEN 'allowed' ELSE 'unexpected' END AS kind FROM a FULL JOIN b ON a.path = b.path WHERE a.value IS DISTINCT FROM b.value".lstrip(", ").join(["WITH ", ""]))
def _(s, d):
    e = table(s, d, "events").select("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.get_json_object("props", "$.k").alias("value"))
    side = lambda t: e.filter(F.col("event_type") == t).groupBy("path").agg(F.min("value").alias("value"))
    return U.differences(side("view"), side("click"), ["u1", "u7"])


_RULES = ["Hunting", "seen from above", "wild BOAR", "no such words"]


@reg("j16_rules_in_texts", "SELECT p.pattern, count(d.doc_id) AS n, min(d.doc_id) AS first FROM (VALUES " + ", ".join(f"('{r}')" for r in _RULES) + ") p(pattern) LEFT JOIN documents d ON contains(lower(d.text), lower(p.pattern)) GROUP BY p.pattern")
def _(s, d):
    r = s.createDataFrame([(x,) for x in _RULES], "pattern string")
    return U.matched_rules(r, table(s, d, "documents").select("doc_id", "text")).groupBy("pattern").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("first"))


@reg("f12_keyword_flags", "SELECT lang, count(*) FILTER (regexp_matches(lower(text), 'hunt|chasse|jagd')) AS hunting, count(*) FILTER (regexp_matches(text, '(?m)^#')) AS marked FROM documents GROUP BY lang")
def _(s, d):
    return table(s, d, "documents").groupBy("lang").agg(F.count_if(F.lower("text").rlike("hunt|chasse|jagd")).alias("hunting"), F.count_if(F.col("text").rlike("(?m)^#")).alias("marked"))


@reg("j17_order_map", "SELECT scenario, coalesce(o, 99) AS place, count(*) AS n FROM metrics LEFT JOIN (VALUES ('BUILDING', 1), ('MACHINERY', 2)) m(scenario, o) USING (scenario) GROUP BY ALL", "metrics")
def _(s, d):
    g = A.metrics(s, d).groupBy("scenario").agg(F.count("*").alias("n"))
    return T.placed_by(g, "scenario", ["BUILDING", "MACHINERY"])


@reg("j18_levels", ", n AS (SELECT source, year, count(*) AS n FROM points GROUP BY ALL), t AS (SELECT level, source, year, least(n, greatest(1, floor(n * level)))::BIGINT AS target FROM n, (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS level)), r AS (SELECT *, row_number() OVER (PARTITION BY source, year ORDER BY (id * 2654435761 + 7 * 40503) % 1000003, id, x, y, quantity) AS rn FROM points) SELECT level, source, year, target, count(*) AS kept, sum(id) AS ids FROM t JOIN r USING (source, year) WHERE rn <= target GROUP BY ALL", "points")
def _(s, d):
    """Thinned by each level: the points kept, those of smallest draw, beside the target."""
    p = A.points(s, d).withColumn("draw", A.hashed("id", 7) / 1000003.0)
    t = T.level_targets(p, ["source", "year"], [0.1, 0.5, 1.0])
    parts = None
    for level in (0.1, 0.5, 1.0):
        kept = quota.take(p, t.filter(F.col("level") == level), ["source", "year"], "draw", ["id", "x", "y", "quantity"], F.lit(1), "target")
        g = kept.groupBy("source", "year").agg(F.count("*").alias("kept"), F.sum("id").alias("ids")).withColumn("level", F.lit(level))
        parts = g if parts is None else parts.unionByName(g)
    return t.join(parts, ["level", "source", "year"]).select("level", "source", "year", "target", "kept", "ids")


@reg("j19_map_index", ", r AS (SELECT scenario, test_year, max(run_id) FILTER (auc IS NOT NULL) AS path FROM metrics GROUP BY ALL), e AS (SELECT scenario, unnest(range(1995, 2003)) AS test_year FROM (SELECT DISTINCT scenario FROM metrics)) SELECT scenario, test_year, path FROM e LEFT JOIN r USING (scenario, test_year)", "metrics")
def _(s, d):
    m = A.metrics(s, d)
    return T.indexed(m, T.expected(m, {"test_year": range(1995, 2003)}, "scenario"), ["scenario", "test_year"], "run_id", F.col("auc").isNotNull())


@reg("j20_paired_flags", ", f AS (SELECT scenario, max(cbi) FILTER (temporal = 'monotemporal') > 0.99 AS mono, max(cbi) FILTER (temporal = 'multitemporal') > 0.99 AS multi FROM metrics GROUP BY scenario) SELECT *, mono = multi AS matched FROM f", "metrics")
def _(s, d):
    return T.paired_flags(A.metrics(s, d), "scenario", "temporal", {"mono": "monotemporal", "multi": "multitemporal"}, F.col("cbi") > 0.99)


@reg("j21_dataset_pairs", ", m AS (SELECT scenario, arg_min(run_id, (-coalesce(cbi, -1), run_id)) AS mono FROM metrics WHERE temporal = 'monotemporal' AND engine = 'elapid' GROUP BY scenario), n AS (SELECT scenario, arg_min(run_id, (-coalesce(cbi, -1), run_id)) AS multi FROM metrics WHERE temporal = 'multitemporal' GROUP BY scenario) SELECT scenario, mono, multi FROM m JOIN n USING (scenario)", "metrics")
def _(s, d):
    m = A.metrics(s, d)
    mono, multi = (F.col("temporal") == "monotemporal") & (F.col("engine") == "elapid"), F.col("temporal") == "multitemporal"
    return T.dataset_pairs(m, "scenario", mono, multi, [F.desc_nulls_last("cbi"), "run_id"], "run_id")


@reg("k9_resume_anti", ", done AS (SELECT scenario, engine, test_year FROM metrics WHERE split = 'test' AND auc IS NOT NULL AND cbi > 0.9) SELECT count(*) AS n FROM metrics ANTI JOIN done USING (scenario, engine, test_year)", "metrics")
def _(s, d):
    m = A.metrics(s, d)
    done = m.filter("split = 'test' and auc is not null and cbi > 0.9").select("scenario", "engine", "test_year")
    return m.join(done, ["scenario", "engine", "test_year"], "left_anti").agg(F.count("*").alias("n"))


@reg("k12_size_limited", "SELECT doc_id, coalesce(n_chars, 0) <= 1000 AS included, CASE WHEN coalesce(n_chars, 0) > 1000 THEN 'over 1000 bytes' END AS reason FROM documents")
def _(s, d):
    f = table(s, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("size"))
    return K.size_limited(f, 1000).select("doc_id", "included", "reason")


@reg("s18_prediction_rank", "WITH n AS (SELECT DISTINCT meta_run, source_file, lower(regexp_extract(source_file, 'outputs/[^/]*/(.*)$', 1)) AS p FROM importance), k AS (SELECT meta_run, source_file, contains(p, 'test')::INT * 5 + contains(p, 'importance')::INT * 4 + regexp_matches(p, '(19|20)[0-9]{2}')::INT AS score FROM n WHERE NOT contains(p, 'stack')) SELECT meta_run, source_file, score FROM k QUALIFY row_number() OVER (PARTITION BY meta_run ORDER BY score DESC, source_file DESC) = 1")
def _(s, d):
    """Of each run the file name that tells most of a test prediction by year."""
    f = table(s, d, "importance").select("meta_run", "source_file").distinct()
    return V.ranked_files(f, "meta_run", "source_file").select("meta_run", "source_file", "score")


@reg("proj12_combo_key", "SELECT run_id, replace(lower(season) || '_' || temporal || '_' || engine || '_' || test_year, '/', '_') AS combo FROM metrics", "metrics")
def _(s, d):
    return A.metrics(s, d).select("run_id", F.replace(F.concat_ws("_", F.lower("season"), "temporal", "engine", F.col("test_year").cast("string")), F.lit("/"), F.lit("_")).alias("combo"))


@reg("proj13_sanitised", r"SELECT doc_id, coalesce(nullif(trim(regexp_replace(regexp_replace(coalesce(origin, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '_.'), ''), 'unnamed') AS name FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.sanitised("origin").alias("name"))


@reg("proj15_booleans", "SELECT doc_id, lower(trim(coalesce(lang, ''))) IN ('true', '1', 'yes', 'y', 'en') AS flag FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.truthy("lang", ("true", "1", "yes", "y", "en")).alias("flag"))


@reg("proj20_sigmoid", "SELECT id, 1 / (1 + exp(-v0)) AS p, 1 - exp(-exp(v1)) AS c FROM design", "design")
def _(s, d):
    return A.design(s, d).select("id", X.sigmoid("v0").alias("p"), X.cloglog("v1").alias("c"))


@reg("proj24_season_years", "SELECT DISTINCT CAST(regexp_extract(trim(semester), '^([0-9]{4})-', 1) AS INT) AS year FROM presence WHERE regexp_matches(trim(semester), '^[0-9]{4}-')")
def _(s, d):
    return table(s, d, "presence").select(F.regexp_extract(X.trimmed("semester"), r"^([0-9]{4})-", 1).try_cast("int").alias("year")).filter("year is not null").distinct()


@reg("proj19_engines", "SELECT engine, row_number() OVER (ORDER BY engine <> 'gbm', o, engine)::INT AS place FROM (SELECT CASE WHEN lower(trim(engine)) IN ('elapid', 'maxent') THEN 'elapid' ELSE lower(trim(engine)) END AS engine, min(record_id) AS o FROM importance WHERE engine IS NOT NULL GROUP BY 1)")
def _(s, d):
    """Engines of the records in their own names, gbm first; an unknown one would be an error."""
    i = table(s, d, "importance").filter("engine is not null")
    return T.engines(i, X.engine("engine"), "record_id")


@reg("proj21_metric_order", "SELECT variable, row_number() OVER (ORDER BY CASE variable WHEN 'slope' THEN 1 WHEN 'bio10' THEN 2 ELSE 99 END, o, variable)::INT AS place FROM (SELECT variable, min(record_id) AS o FROM importance WHERE variable IS NOT NULL GROUP BY variable)")
def _(s, d):
    i = table(s, d, "importance").filter("variable is not null")
    return T.fronted(i, "variable", "record_id", ["slope", "bio10"])


@reg("f5_complete_cases", "SELECT engine, count(*) AS n FROM metrics WHERE auc IS NOT NULL AND cbi IS NOT NULL GROUP BY engine", "metrics")
def _(s, d):
    return A.metrics(s, d).dropna(subset=["auc", "cbi"]).groupBy("engine").agg(F.count("*").alias("n"))


@reg("f6_finite_importances", "SELECT count(*) AS n, sum(importance_mean) AS total FROM importance WHERE isfinite(importance_mean)")
def _(s, d):
    from terrane.operators.layers import known

    v = known("importance_mean")
    return table(s, d, "importance").agg(F.count(v).alias("n"), F.sum(v).alias("total"))


@reg("f7_all_missing_rows", "SELECT count(*) AS n FROM metrics WHERE auc IS NOT NULL OR cbi IS NOT NULL", "metrics")
def _(s, d):
    return A.metrics(s, d).dropna(how="all", subset=["auc", "cbi"]).agg(F.count("*").alias("n"))


@reg("f9_constant_columns", "SELECT unnest(['v0', 'v1', 'zero']) AS variable, unnest([var_pop(v0) > 0, var_pop(v1) > 0, false]) AS kept FROM design", "design")
def _(s, d):
    return S.varying(A.design(s, d).withColumn("zero", F.lit(0.0)), ["v0", "v1", "zero"])


@reg("f10_few_values", "SELECT 'engine' AS variable, count(DISTINCT engine) + max((engine IS NULL)::INT) AS kinds FROM importance UNION ALL SELECT 'season', count(DISTINCT season) + max((season IS NULL)::INT) FROM importance")
def _(s, d):
    return S.kinds(table(s, d, "importance"), ["engine", "season"])


@reg("f14_outside_set", "SELECT count(*) FILTER (size % 3 = 0) AS changed, sum(CASE WHEN size % 3 = 0 THEN -9999.0::DOUBLE ELSE price END) AS total FROM cells", "cells")
def _(s, d):
    from terrane.operators import layers as L

    m = L.masked(A.cells(s, d), A.mask(s, d), ["price"])
    return m.agg(F.count_if(F.col("price").isNull()).alias("changed"), F.sum(F.coalesce("price", F.lit(L.NODATA))).alias("total"))


@reg("f16_source_only", "SELECT count(*) AS n FROM presence WHERE lower(trim(source)) = 'gbif'")
def _(s, d):
    return table(s, d, "presence").filter(X.folded("source") == "gbif").agg(F.count("*").alias("n"))


@reg("f17_split_from_name", "SELECT source_file, CASE WHEN contains(source_file, 'train') THEN 'train' WHEN contains(source_file, 'val') THEN 'val' WHEN contains(source_file, 'test') THEN 'test' END AS split, CASE WHEN contains(source_file, 'background') THEN 0 ELSE 1 END AS label, count(*) AS n FROM importance GROUP BY ALL")
def _(s, d):
    n = F.col("source_file")
    split = F.when(n.contains("train"), "train").when(n.contains("val"), "val").when(n.contains("test"), "test")
    return table(s, d, "importance").groupBy("source_file").agg(F.count("*").alias("n")).select("source_file", split.alias("split"), F.when(n.contains("background"), 0).otherwise(1).alias("label"), "n")


QUERIES = Q

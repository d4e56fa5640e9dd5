"""Queries on inventories, settings and further shapes of layers and run tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions import text as X
from terrane.functions.grid import STUDY
from terrane.operators import audit as U
from terrane.operators import collinear as C
from terrane.operators import layers as L
from terrane.operators import novelty as N
from terrane.operators import points as P
from terrane.operators import runs as T
from terrane.operators import stats as S
from terrane.plans import adapters as A
from terrane.plans import config
from terrane.session import scratch, staged, table
from terrane.sources import inventory as V
from terrane.sources import sinks as K
from terrane.sources import tables as R

Q, SQL = {}, {}


def reg(name, body=None, *needs, also=""):
    def add(f):
        Q[name] = f
        if body:
            SQL[name] = A.sql(body, *needs, also=also) if needs else body
        return f

    return add


@reg("s10_expected_layers", "SELECT DISTINCT regexp_extract(source_file, '([^/]*)/permutation_importance.csv$', 1) || '_permutation_importance' AS stem FROM importance WHERE regexp_matches(source_file, '^outputs/[^/]*/winter_multitemporal_(gbm|elapid)_test_(2019|2020|2021)/permutation_importance.csv$')")
def _(s, d):
    """Of the files of all runs and years that a template names, those there are, by stem with the run before it."""
    i = table(s, d, "importance").select(F.col("source_file").alias("path")).distinct()
    runs = [r[0] for r in table(s, d, "importance").select("meta_run").distinct().collect()]  # the run table's few runs
    pattern = "outputs/{run}/{season_lower}_multitemporal_{engine}_test_{year}/permutation_importance.csv"
    return V.expected_layers(i.withColumn("path", F.replace("path", F.lit("/permutation_importance"), F.lit("_permutation_importance"))), [pattern.replace("/permutation", "_permutation")], {"run": runs, "season": ["Winter"], "engine": ["gbm", "elapid"], "year": [2019, 2020, 2021]})


@reg("s12_settings", "SELECT * FROM (VALUES ('a.b', '1'), ('a.c', '[1, 2]'), ('root', '\"/data\"'), ('path', '\"/data/x_${other}\"')) t(path, value)")
def _(s, d):
    top = {"root": "/data"}
    return config.as_table(s, config.merged({"a": {"b": 0, "c": [1, 2]}, "path": config.substituted("${root}/x_${other}", top)}, {"a": {"b": 1}, **top}))


@reg("s22_required_columns", "SELECT count(*) AS n FROM importance")
def _(s, d):
    return R.require(table(s, d, "importance"), ["record_id", "variable"]).agg(F.count("*").alias("n"))


@reg("s24_aligned_mask", "SELECT floor(row / 2)::BIGINT AS row, floor(col / 2)::BIGINT AS col FROM mask WHERE row % 2 = 1 AND col % 2 = 1", "mask")
def _(s, d):
    return L.resampled(A.mask(s, d), 0.5, [])


@reg("s25_yearly_inventory", "WITH y AS (SELECT unnest(range(2015, 2027))::INT AS year), w AS (SELECT year, 'outputs/meta_run_02/summer_monotemporal_elapid_test_' || year || '/permutation_importance.csv' AS p FROM y) SELECT year, p IN (SELECT source_file FROM importance) AS present, year = 2020 AS configured, true AS found FROM w")
def _(s, d):
    i = table(s, d, "importance").select(F.col("source_file").alias("path")).distinct()
    one = "outputs/meta_run_02/summer_monotemporal_elapid_test_{year}/permutation_importance.csv"
    return V.yearly(i, one, range(2015, 2027), [one.format(year=2020)]).select("year", "present", "configured", (F.col("found").isNotNull()).alias("found"))


@reg("s26_run_directories", "SELECT DISTINCT regexp_extract(source_file, '^(.*)/[^/]*$', 1) AS folder, nullif(regexp_extract(n, '(summer|winter)', 1), '') AS season, nullif(regexp_extract(n, '(mono|multi)temporal', 1), '') AS temporal, nullif(regexp_extract(n, '(elapid|maxent|gbm)', 1), '') AS engine, nullif(regexp_extract(n, 'test_([0-9]{4})', 1), '')::INT AS test_year FROM (SELECT source_file, lower(regexp_extract(source_file, '([^/]+)/[^/]*$', 1)) AS n FROM importance)")
def _(s, d):
    return V.run_folders(table(s, d, "importance"), "source_file")


@reg("s27_domain_columns", "SELECT row, col, size::DOUBLE AS bio_size, balance AS era5_balance FROM mask JOIN cells USING (row, col)", "mask")
def _(s, d):
    return L.by_domain(P.in_mask(A.cells(s, d), A.mask(s, d)), {"size": "bio", "balance": "era5"})


@reg("s20_importance_union", "SELECT lower(trim(scenario)) AS scenario, variable, count(*) AS n, sum(importance_mean) FILTER (isfinite(importance_mean)) AS total FROM importance WHERE scenario IS NOT NULL GROUP BY ALL")
def _(s, d):
    """Tables of separate runs, whose columns have other names and orders, by name; a value that is no number is null."""
    i = table(s, d, "importance").filter("scenario is not null")
    newer = i.filter("temporal = 'monotemporal'").select("scenario", "variable", F.col("importance_mean").alias("Importance"))
    older = i.filter("temporal is null or temporal <> 'monotemporal'").select(F.col("importance_mean").cast("string").alias("IMPORTANCE_MEAN"), "variable", "scenario")
    u = R.united([R.alias(newer, "value", "importance").drop("Importance"), R.alias(older, "value", "importance_mean").drop("IMPORTANCE_MEAN")])
    return u.withColumn("v", X.finite("value")).groupBy(X.folded("scenario").alias("scenario"), "variable").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@reg("k5_json_round_trip", "SELECT count(*) AS n, sum(auc) AS auc FROM metrics", "metrics")
def _(s, d):
    path = scratch(s)
    m = A.metrics(s, d).select("run_id", "auc")
    m.write.json(path)
    return s.read.schema(m.schema).json(path).agg(F.count("*").alias("n"), F.sum("auc").alias("auc"))


@reg("k13_trial_log", "SELECT run_id AS number, CASE WHEN auc IS NULL THEN 'failed' ELSE 'success' END AS status, auc AS value FROM metrics", "metrics")
def _(s, d):
    """A log that grows: trials of a run are appended, and once more after a restart, without a trial twice."""
    path = scratch(s)
    m = A.metrics(s, d).select(F.col("run_id").alias("number"), F.when(F.col("auc").isNull(), "failed").otherwise("success").alias("status"), F.col("auc").alias("value"))
    K.append_new(m.filter("number % 3 = 0"), path, ["number"])
    return K.append_new(m, path, ["number"])


@reg("k14_name_file", "SELECT DISTINCT variable AS value FROM importances", "importances")
def _(s, d):
    path = scratch(s)
    A.importances(s, d).select("variable").distinct().write.text(path)
    return s.read.text(path)


@reg("proj1_header", 'SELECT sum("dd long") FILTER (isfinite("dd long")) AS x, max("year-int") AS year FROM presence')
def _(s, d):
    p = R.normalised(table(s, d, "presence"))
    return p.agg(F.sum(L.known("x", float("-inf"))).alias("x"), F.max("year").alias("year"))


@reg("proj9_georeference", "SELECT row, col, 91000 + 1000 * col - 250 AS left_, 7124000 - 1000 * row + 125 AS top_ FROM mask", "mask")
def _(s, d):
    g = STUDY.shifted(-250, 125)
    half = g.cell / 2
    return A.mask(s, d).select("row", "col", (g.center_x() - half).cast("bigint").alias("left_"), (g.center_y() + half).cast("bigint").alias("top_"))


@reg("proj10_labels", "SELECT run_id, lower(season) AS season, upper(season[1]) || lower(season[2:]) AS title, 'loyo' AS scenario FROM metrics", "metrics")
def _(s, d):
    return A.metrics(s, d).select("run_id", F.lower("season").alias("season"), F.initcap("season").alias("title"), F.lit("loyo").alias("scenario"))


@reg("proj11_alias_columns", "SELECT run_id, cbi AS score, 'elapid' AS fitted FROM metrics", "metrics")
def _(s, d):
    m = R.alias(A.metrics(s, d), "score", "cbi_spearman", "CBI")
    return R.alias(m, "fitted", "nothing", kind="string").select("run_id", "score", F.coalesce("fitted", F.lit("elapid")).alias("fitted"))


@reg("proj14_pivot_names", "SELECT engine, avg(auc) FILTER (season = 'Winter') AS auc_Winter, avg(auc) FILTER (season = 'Summer') AS auc_Summer FROM metrics GROUP BY engine", "metrics")
def _(s, d):
    p = A.metrics(s, d).groupBy("engine").pivot("season", ["Winter", "Summer"]).agg(F.avg("auc"))
    return p.select("engine", *[F.col(c).alias(f"auc_{c}") for c in p.columns[1:]])


@reg("proj16_score_column", "SELECT vec_id AS id, embedding[2]::DOUBLE AS s FROM embeddings")
def _(s, d):
    e = F.col("embedding")
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.size(e) > 1, e[1]).otherwise(e[0]).cast("double").alias("s"))


@reg("proj17_linear_index", "SELECT row * 1000 + col AS idx, price FROM cells", "cells")
def _(s, d):
    return A.cells(s, d).select(STUDY.index().alias("idx"), "price")


@reg("f11_empty_layers", "SELECT unnest(['nothing', 'nan']) AS layer")
def _(s, d):
    c = A.cells(s, d).withColumns({"nothing": F.lit(None).cast("double"), "nan": F.lit(float("nan"))})
    return L.empty(c, ["size", "nothing", "nan"])


@reg("f13_split_filter", "SELECT engine, count(*) AS n FROM metrics WHERE lower(split) = 'test' GROUP BY engine", "metrics")
def _(s, d):
    return A.metrics(s, d).filter(X.folded("split") == "test").groupBy("engine").agg(F.count("*").alias("n"))


@reg("f18_spec_selection", "SELECT source AS id, CASE WHEN target_per_10k > 500 THEN target_per_10k ELSE 999 END AS place FROM mix_targets WHERE max_repeats > 1 AND NOT contains(source, 'config')")
def _(s, d):
    """Targets as specifications, of which those that may be repeated and aren't config are chosen, in their order."""
    spec = table(s, d, "mix_targets").select(F.col("source").alias("id"), (F.col("max_repeats") > 1).alias("enabled"), F.when(F.contains("source", F.lit("config")), "reference").otherwise("corrected").alias("kind"), F.when(F.col("target_per_10k") > 500, F.col("target_per_10k")).alias("place"))
    return T.chosen_specs(spec, "enabled", "kind", ["reference"], "place").select("id", "place")


@reg("j2_probe_coordinates", "SELECT id, year, size FROM placed LEFT JOIN cells USING (row, col)", "placed", "cells")
def _(s, d):
    return P.sampled(P.placed(A.points(s, d)), A.cells(s, d), ["size"]).select("id", "year", "size")


@reg("j3_semi_join", "SELECT count(*) AS n FROM placed SEMI JOIN mask USING (row, col)", "placed", "mask")
def _(s, d):
    return P.in_mask(P.placed(A.points(s, d)), A.mask(s, d)).agg(F.count("*").alias("n"))


@reg("g8_background_weights", "SELECT row, col, greatest(balance, 0.1::DOUBLE) / sum(greatest(balance, 0.1::DOUBLE)) OVER () AS p FROM cells", "cells")
def _(s, d):
    c = A.cells(s, d).select("row", "col", F.greatest("balance", F.lit(0.1)).alias("bias"))
    return P.bias_weights(c, "bias", 1.0).select("row", "col", "p")


@reg("a2_class_means", "SELECT row, col, 'class1' AS layer, (size + size * 3)::DOUBLE / 2 AS value FROM cells", "cells")
def _(s, d):
    c = A.cells(s, d).withColumns({"2018_class1": F.col("size"), "2019_class1": F.col("size") * 3})
    return L.year_mean(L.long(c, ["2018_class1", "2019_class1"]))


@reg("a3_season_combined", "SELECT row, col, '1996_size' AS layer, (size + size * 2)::DOUBLE / 2 AS value FROM cells", "cells")
def _(s, d):
    c = A.cells(s, d).withColumns({"1995_size": F.col("size"), "1996_size": F.col("size") * 2})
    l = L.long(c.drop("size"), ["1995_size", "1996_size"])
    last = l.groupBy(L.base_name("layer").alias("b")).agg(F.max(L.layer_year("layer")).alias("y"))
    m = L.year_mean(l)
    return m.join(last, m.layer == last.b).select("row", "col", F.concat_ws("_", F.col("y").cast("string"), "layer").alias("layer"), "value")


@reg("a26_class_area", "SELECT size % 3 AS cls, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share, count(*)::DOUBLE AS km2 FROM cells GROUP BY cls", "cells")
def _(s, d):
    return N.class_shares(A.cells(s, d).select((F.col("size") % 3).alias("cls")))


@reg("l5_cloglog", "SELECT id, 1 - exp(-exp(v0 * 2)) AS s FROM design", "design")
def _(s, d):
    return A.design(s, d).withColumn("eta", F.col("v0") * 2).select("id", X.cloglog("eta").alias("s"))


@reg("l18_sweep_grid", ", m AS (SELECT DISTINCT season FROM metrics), y AS (SELECT DISTINCT test_year FROM metrics) SELECT season, test_year, cutoff, strategy FROM m, y, (SELECT unnest([0.7::DOUBLE, 0.9::DOUBLE]) AS cutoff), (SELECT unnest(['density', 'urban']) AS strategy)", "metrics")
def _(s, d):
    """Every combination of seasons and years that the runs have with cutoffs and strategies."""
    return T.expected(A.metrics(s, d), {"cutoff": [0.7, 0.9], "strategy": ["density", "urban"]}, "season", "test_year")


@reg("l19_special_predictor", "SELECT DISTINCT variable FROM importance WHERE regexp_matches(lower(variable), 'hunting|hunt|tableau')")
def _(s, d):
    return T.sole(table(s, d, "importance"), "variable", "hunting|hunt|tableau")


def _settings(s, d):
    """The training contexts as nested settings, a parameter table of twelve rows."""
    t = table(s, d, "training_context").orderBy("context_id").collect()
    return {f"c{r.context_id}": {"season": r.season, "fit": {"temporal": r.temporal, "quantile": r.nt2_quantile}, "predictors": list(r.predictors)} for r in t}


@reg("r8_flattened", "WITH t AS (SELECT 'c' || context_id AS c, * FROM training_context), flat AS (SELECT c || '.season' AS path, '\"' || season || '\"' AS value FROM t UNION ALL SELECT c || '.fit.temporal', '\"' || temporal || '\"' FROM t UNION ALL SELECT c || '.fit.quantile', nt2_quantile::VARCHAR FROM t UNION ALL SELECT c || '.predictors', '[\"' || array_to_string(predictors, '\", \"') || '\"]' FROM t) SELECT * FROM flat")
def _(s, d):
    return config.as_table(s, _settings(s, d))


@reg("r12_audit", ", g AS (SELECT scenario, list_sort(list(DISTINCT test_year)) AS years, count(*) FILTER (auc IS NULL) AS unsound, count(auc) FILTER (engine = 'gbm') AS gbm, count(auc) FILTER (engine = 'elapid') AS elapid FROM metrics GROUP BY scenario), m AS (SELECT *, list_filter(range(1992, 2002), lambda y: NOT list_contains(years, y)) AS missing FROM g) SELECT scenario, years, missing, gbm, elapid, concat_ws(' | ', CASE WHEN len(missing) > 0 THEN 'missing years: ' || array_to_string(missing, ', ') END, CASE WHEN unsound > 0 THEN unsound || ' unsound runs' END) AS issues FROM m", "metrics")
def _(s, d):
    return T.audited(A.metrics(s, d), "scenario", "engine", "test_year", range(1992, 2002), F.col("auc").isNotNull()).select("scenario", "years", "missing", F.col("maps.gbm").alias("gbm"), F.col("maps.elapid").alias("elapid"), "issues")


@reg("r15_duplicate_contents", "SELECT sha256(text) AS sha256, count(*) AS n, min(concat_ws('.', doc_id, lang)) AS first, count(*) FILTER (lower(lang) IN ('fr', 'de')) AS forbidden, count(*) FILTER (regexp_matches(text, '(?m)^(<{7}|>{7})( |$)')) AS conflicts FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    f = V.hygiene(table(s, d, "documents").filter("text is not null").select(F.concat_ws(".", F.col("doc_id").cast("string"), "lang").alias("path"), F.col("text").alias("content")), ["fr", "de"])
    return f.groupBy("sha256").agg(F.count("*").alias("n"), F.min("first").alias("first"), F.count_if("forbidden").alias("forbidden"), F.count_if("conflict").alias("conflicts")).filter("n > 1")


@reg("r19_settings_off", "WITH o AS (SELECT 'c' || context_id AS id, season, lower(season) = 'winter' AND temporal = 'monotemporal' AND context_id % 2 <> 0 AS off FROM training_context) SELECT id AS name, id AS scenario, NULL AS problem FROM o WHERE off AND id NOT IN ('c5', 'c10') UNION ALL SELECT season, id, NULL FROM o WHERE off UNION ALL SELECT id, NULL, 'no settings' FROM o WHERE id IN ('c5', 'c10')")
def _(s, d):
    """Contexts as settings of their own and, by season, as lists; every fifth text is cut short."""
    t = table(s, d, "training_context")
    one = F.struct(F.concat(F.lit("c"), F.col("context_id").cast("string")).alias("id"), "season", "temporal", F.struct((F.col("context_id") % 2 == 0).alias("hunting")).alias("flags"))
    alone = t.select(F.concat(F.lit("c"), F.col("context_id").cast("string")).alias("name"), F.to_json(one).alias("text"))
    alone = alone.withColumn("text", F.when(F.col("name").isin("c5", "c10"), F.substring("text", 1, 9)).otherwise(F.col("text")))
    lists = t.groupBy("season").agg(F.to_json(F.struct(F.collect_list(one).alias("scenarios"))).alias("text")).select(F.col("season").alias("name"), "text")
    return config.disabled(alone.unionByName(lists), "name", "text", "flags.hunting", {"season": "winter", "temporal": "Monotemporal"})


@reg("r21_run_checks", ", n AS (SELECT scenario, engine, count(DISTINCT split) AS splits, count(DISTINCT test_year) AS years, count(*) FILTER (auc IS NULL) AS unknown, count(*) FILTER (auc NOT BETWEEN 0 AND 1) AS outside FROM metrics GROUP BY ALL) SELECT unnest(['registered', 'splits', 'years', 'in_range', 'all_known', 'has_runs']) AS check, unnest([count(*) FILTER (scenario IS NULL OR engine IS NULL) = 0, bool_and(splits = 3), bool_and(years = 7), sum(outside) = 0, sum(unknown) = 0, count(*) > 0]) AS passed FROM n", "metrics")
def _(s, d):
    """Registry, completeness, flags and artifacts of the run table as one list of checks."""
    m = A.metrics(s, d)
    n = m.groupBy("scenario", "engine").agg(F.countDistinct("split").alias("splits"), F.countDistinct("test_year").alias("years"), F.count_if(F.col("auc").isNull()).alias("unknown"), F.count_if(~F.col("auc").between(0, 1)).alias("outside"))
    return U.checks(n, {"registered": F.count_if(F.col("scenario").isNull() | F.col("engine").isNull()) == 0, "splits": F.bool_and(F.col("splits") == 3), "years": F.bool_and(F.col("years") == 7), "in_range": F.sum("outside") == 0, "all_known": F.sum("unknown") == 0, "has_runs": F.count("*") > 0})


@reg("c9_reference_year", "SELECT DISTINCT test_year || '_' || variable AS layer FROM importance WHERE test_year IS NOT NULL AND variable IS NOT NULL AND (contains('_' || variable, '_class') OR test_year = 2020) UNION ALL SELECT DISTINCT variable FROM importance WHERE variable IS NOT NULL AND test_year IS NOT NULL")
def _(s, d):
    """Layers of all years of the stack: land cover, the reference year's and those without a year stay."""
    y = table(s, d, "importance").select("variable", "test_year").dropna().distinct()
    l = y.select(F.concat_ws("_", F.col("test_year").cast("string"), "variable").alias("layer")).unionByName(y.select(F.col("variable").alias("layer")).distinct())
    return L.of_reference_year(l, 2020)


@reg("c12_predictor_preflight", "WITH w AS (SELECT list_sort(predictors) AS w FROM training_context WHERE context_id = 1), h AS (SELECT scenario, test_year, list(DISTINCT variable) AS v FROM importance WHERE scenario IS NOT NULL AND test_year IS NOT NULL AND variable IS NOT NULL GROUP BY ALL) SELECT scenario, test_year, len(v) AS n, array_to_string(list_filter(w, lambda x: NOT list_contains(v, x)), ', ') AS removed, len(list_filter(w, lambda x: NOT list_contains(v, x))) = 0 AS passed FROM h, w")
def _(s, d):
    want = table(s, d, "training_context").filter("context_id = 1").select(F.explode("predictors").alias("variable"))
    i = table(s, d, "importance").filter("scenario is not null and test_year is not null")
    return T.preflight(i, ["scenario", "test_year"], "variable", want).select("scenario", "test_year", "n", F.array_join("removed", ", ").alias("removed"), "passed")


@reg("c1_vif_wide", "SELECT 'v' || i AS variable, true AS same, true AS one_at_least FROM range(16) t(i)")
def _(s, d):
    """Of 16 columns the inflation about the mean equals that of the columns less their means about zero, and is 1 at least."""
    names = [f"v{i}" for i in range(16)]
    x = A.design(s, d, 16)
    sums = C.product_sums(x, names)
    centred = C.product_sums(x, names, sums[1] / max(sums[0], 1))
    a, b = C.vif(*sums, intercept=True), C.vif(*centred, intercept=False)
    return s.createDataFrame([(n, bool(abs(p - q) < 1e-6 * p), bool(p >= 1 - 1e-9)) for n, p, q in zip(names, a, b)], "variable string, same boolean, one_at_least boolean")


@reg("n2_similarity", ", x AS (SELECT DISTINCT price * 1.5 - 300 AS v FROM cells), r AS (SELECT price AS v, count(*) AS n FROM cells WHERE size % 3 <> 0 GROUP BY price), e AS (SELECT min(v) AS lo, max(v) AS hi, sum(n) AS t FROM r), c AS (SELECT v, sum(n) OVER (ORDER BY v) AS upto FROM r), f AS (SELECT x.v, coalesce(upto, 0) / t::DOUBLE AS f, lo, hi FROM x CROSS JOIN e ASOF LEFT JOIN c ON x.v >= c.v) SELECT v AS value, round(CASE WHEN v < lo THEN 100 * (v - lo) / (hi - lo) WHEN v > hi THEN 100 * (hi - v) / (hi - lo) WHEN f <= 0.5 THEN 200 * f ELSE 200 * (1 - f) END, 9) AS score FROM f", "cells")
def _(s, d):
    """The price of every cell against the reference's, each distinct value ranked once."""
    from terrane.queries.modelling import _novel

    g, tr = _novel(s, d)
    ranked = N.counted(N.reference(tr, ["price"]), g.select(F.lit("price").alias("variable"), F.col("price").cast("double").alias("value")))
    return ranked.select("value", F.round(N.similarity(F.col("value"), F.col("upto"), F.col("total"), F.col("low"), F.col("high")), 9).alias("score"))


@reg("n4_distance", ", m AS (SELECT avg(v0) AS a, avg(v1) AS b, var_samp(v0) AS p, var_samp(v1) AS q, covar_samp(v0, v1) AS c FROM design) SELECT id, round((q * (v0 - a) ** 2 - 2 * c * (v0 - a) * (v1 - b) + p * (v1 - b) ** 2) / (p * q - c * c), 6) AS d2 FROM design, m", "design")
def _(s, d):
    x = A.design(s, d)
    mean, inverse = N.training(x, ["v0", "v1"])
    return x.select("id", F.round(N.distance2(["v0", "v1"], mean, inverse), 6).alias("d2"))


@reg("a29_importance_means", "SELECT variable, avg(value) AS mean, stddev_pop(value) AS std FROM importances GROUP BY variable", "importances")
def _(s, d):
    return A.importances(s, d).groupBy("variable").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


@reg("k11_box_data", "SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM importances GROUP BY variable", "importances")
def _(s, d):
    return S.distribution(A.importances(s, d), ["variable"], "value").select("variable", "q1", "q3")


@reg("k6_table_bundle", "SELECT k AS kind, subject, description FROM subjects, (SELECT unnest(['csv', 'tsv']) AS k) UNION ALL SELECT kind, NULL, NULL FROM (VALUES ('md'), ('tex')) t(kind)")
def _(s, d):
    """A table in four forms, of which the delimited ones are read back and the others counted."""
    path = scratch(s)
    t = table(s, d, "subjects").select("subject", "description")
    K.bundle(t, path)
    read = lambda k, sep: s.read.option("header", True).option("sep", sep).option("escape", '"').csv(f"{path}/{k}").select(F.lit(k).alias("kind"), "subject", "description")
    lines = lambda k: s.read.text(f"{path}/{k}").agg(F.count("*").alias("n")).join(t.agg(F.count("*").alias("m"))).filter("n = m").select(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("description"))
    return read("csv", ",").unionByName(read("tsv", "\t")).unionByName(lines("md")).unionByName(lines("tex"))


@reg("k7_text_replaced", "SELECT 'two' AS value")
def _(s, d):
    """A text file that is replaced is always the old or the new one."""
    path = f"{scratch(s)}/note.txt"
    K.write_text(s, path, "one\n")
    K.write_text(s, path, "two\n")
    return s.read.text(path)


@reg("k12_archive", "SELECT count(*) FILTER (n_chars <= 1000) AS members, true AS sound, count(*) FILTER (coalesce(n_chars, 0) > 1000) AS left_out FROM documents WHERE text IS NOT NULL")
def _(s, d):
    """Texts of a limited size as an archive, whose members are read back and compared by their hash."""
    path = scratch(s)
    f = table(s, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("size"), F.col("text").alias("content"))
    left = K.write_archive(f, path, 1000)
    sound = K.archive_checked(s, path)
    return sound.agg(F.count("*").alias("members"), F.bool_and("sound").alias("sound")).join(left.agg(F.count("*").alias("left_out")))


@reg("n9_season_years", "SELECT season, list_sort(list(DISTINCT test_year)) AS years FROM (SELECT lower(regexp_extract(source_file, '(summer|winter)_[a-z]*_[a-z]*_test_', 1)) AS season, regexp_extract(source_file, 'test_([0-9]{4})', 1)::INT AS test_year FROM importance) GROUP BY season")
def _(s, d):
    return V.season_years(V.run_folders(table(s, d, "importance"), "source_file"))


@reg("g4_counts", ", t AS (SELECT source, year, count(DISTINCT (floor(x / 20000), floor(y / 20000))) AS n FROM points GROUP BY ALL) SELECT source, year, greatest(1, floor(n * 0.5::DOUBLE))::BIGINT AS n FROM t", "points")
def _(s, d):
    p = P.thinned_to_grid(P.placed(A.points(s, d)), 20, [A.hashed("id", 7), "id", "x", "y", "year", "quantity"], ["source", "year"])
    return P.farthest_points(p.select("id", "source", "year", "x", "y"), ["source", "year"], ["x", "y"], "id", 0.5).groupBy("source", "year").agg(F.count("*").alias("n"))


@reg("p5_regions_by_cell", "SELECT 'west' AS region, count(*) AS n FROM points WHERE x >= 100000 AND x < 130000 AND y >= 7030000 AND y < 7100000 UNION ALL SELECT 'north', count(*) FROM points WHERE x >= 110000 AND x < 160000 AND y >= 7060000 AND y < 7110000", "points")
def _(s, d):
    from terrane.operators import proximity

    box = lambda a, b, c, e: [{"x": float(x), "y": float(y)} for x, y in ((a, c), (b, c), (b, e), (a, e))]
    r = s.createDataFrame([("west", box(100000, 130000, 7030000, 7100000)), ("north", box(110000, 160000, 7060000, 7110000))], "region string, ring array<struct<x: double, y: double>>")
    n = proximity.in_regions(A.points(s, d), "x", "y", r, "region", "ring", 50000.0).groupBy("region").agg(F.count("*").alias("n"))
    return r.select("region").join(n, "region", "left").select("region", F.coalesce("n", F.lit(0)).alias("n"))



@reg("s5_column_subset", "SELECT count(importance_mean) AS n, count(DISTINCT variable) AS variables FROM importance")
def _(s, d):
    return table(s, d, "importance").select("importance_mean", "variable").agg(F.count("importance_mean").alias("n"), F.countDistinct("variable").alias("variables"))


@reg("s9_source_dispatch", "SELECT * FROM (VALUES ('a_2019.tif'), ('a_2020.tif'), ('b.tif')) t(path)")
def _(s, d):
    found = R.dispatched({"pattern": "a_{year}.tif"}, {"year": [2019, 2020]}) + R.dispatched(["b.tif"], {})
    return s.createDataFrame([(x,) for x in found], "path string")


@reg("s11_point_file", """SELECT count(*) AS n, sum("dd long") AS x, sum(occ_id)::BIGINT AS ids FROM presence WHERE isfinite("dd long") AND isfinite("dd lat")""")
def _(s, d):
    """Points written as features, one a line, and read back."""
    path = scratch(s)
    p = R.located(table(s, d, "presence")).select("occ_id", "x", "y", "source")
    f = p.select(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"), F.struct("occ_id", "source").alias("properties"))
    f.write.json(path)
    return V.read_geojson(s, path, {"occ_id": "bigint", "source": "string"}, lines=True).agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("occ_id").alias("ids"))


@reg("s17_caption_flags", r"WITH l AS (SELECT unnest(regexp_split_to_array(text, '\r?\n')) AS line FROM documents WHERE text IS NOT NULL) SELECT count(*) FILTER (regexp_matches(line, '(?i)^\s*(figure|table|photographs)\b')) AS captions, count(*) FILTER (regexp_matches(line, '(?i)hunt')) AS hunting FROM l")
def _(s, d):
    """All texts as files of one folder, read as binary: lines that begin with a caption's word, and those that name hunting."""
    path = scratch(s)
    table(s, d, "documents").filter("text is not null").repartition(8, "doc_id").select("text").write.text(path, lineSep="\x1e\n")
    files = s.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    f = V.text_flags(files, {"captions": r"(?i)^\s*(figure|table|photographs)\b", "hunting": r"(?i)hunt"})
    return f.agg(F.sum("captions").cast("bigint").alias("captions"), F.sum("hunting").cast("bigint").alias("hunting"))


@reg("k10_model_round_trip", "SELECT count(*) AS n, 0.0::DOUBLE AS off FROM embeddings")
def _(s, d):
    """A model that is written and loaded gives every row the score it gave before."""
    from pyspark.ml import PipelineModel

    from terrane.operators import models

    path = scratch(s)
    x = A.design(s, d)
    model = models.fit_maxent(x, ["v0", "v1"], features=("linear", "hinge"), knots=3)
    model.write().save(path)
    a, b = models.scored(model, x).select("id", "s"), models.scored(PipelineModel.load(path), x).select("id", F.col("s").alias("t"))
    return a.join(b, "id").agg(F.count("*").alias("n"), F.max(F.abs(F.col("s") - F.col("t"))).alias("off"))


@reg("proj5_words_dropped", "SELECT DISTINCT variable AS layer FROM importance WHERE variable IS NOT NULL AND NOT regexp_matches(lower(variable), 'hunting|urban')")
def _(s, d):
    v = table(s, d, "importance").select(F.col("variable").alias("layer")).dropna().distinct()
    return L.without_words(v, ["hunting", "URBAN"])


@reg("proj22_record_table", "SELECT record_id, scenario, engine, importance_mean, importance_std, vif FROM importance")
def _(s, d):
    return table(s, d, "importance").select("record_id", "scenario", "engine", "importance_mean", "importance_std", "vif")


@reg("f15_one_year", "SELECT count(*) AS n FROM importance WHERE test_year = (SELECT coalesce(min(test_year) FILTER (test_year = 2021), min(test_year)) FROM importance)")
def _(s, d):
    i = table(s, d, "importance")
    year = i.agg(F.coalesce(F.min(F.when(F.col("test_year") == 2021, 2021)), F.min("test_year")).alias("test_year"))
    return i.join(F.broadcast(year), "test_year").agg(F.count("*").alias("n"))


@reg("g11_points_in_area", "SELECT (SELECT greatest(2, round(count(*) * 0.1::DOUBLE))::BIGINT FROM mask) AS n, 0::BIGINT AS outside", "mask")
def _(s, d):
    """Points at random places of the mask's cells, as a rejection sampler gives them; each is looked up in the mask again."""
    mask = A.mask(s, d)
    u = (A.hashed(F.col("row") * 1000 + F.col("col"), 5) + 0.5) / 1000003
    p = P.placed(P.jittered(P.sampled_share(mask, 0.1, u, ["row", "col"]), STUDY, "row", "col").select("x", "y"))
    inside = mask.withColumn("in", F.lit(True))
    return p.join(inside, ["row", "col"], "left").agg(F.count("*").alias("n"), F.count_if(F.col("in").isNull()).alias("outside"))


@reg("g27_bias_strategy", "SELECT row, col, greatest(balance, 0) / (SELECT max(balance) FROM cells) AS value FROM cells", "cells")
def _(s, d):
    c = A.cells(s, d).select("row", "col", F.greatest("balance", F.lit(0.0)).alias("value"))
    grids = {"urban": lambda: L.urban_decay(c, 3), "given": lambda: c.join(F.broadcast(c.agg(F.max("value").alias("top")))).select("row", "col", (F.col("value") / F.col("top")).alias("value"))}
    return L.chosen(grids, "nothing", "given")


@reg("g28_guarded_thinning", ", t AS (SELECT source, count(DISTINCT (floor(x / 5000), floor(y / 5000))) AS n FROM points GROUP BY source) SELECT source, n AS unknown, greatest(1, floor(n * 0.1::DOUBLE))::BIGINT AS known FROM t", "points")
def _(s, d):
    """With a feature that is known nowhere nothing is thinned; with known ones a tenth of each group stays."""
    # written once, as it is counted and thinned twice
    p = staged(P.thinned_to_grid(P.placed(A.points(s, d)), 5, [A.hashed("id", 7), "id", "x", "y", "year", "quantity"], ["source"]).select("id", "source", "x", "y").withColumn("price", F.lit(None).cast("double")))
    none, some = P.thinned_if_known(p, ["source"], ["price"], "id", 0.1), P.thinned_if_known(p, ["source"], ["x", "y"], "id", 0.1)
    n = lambda f, name: f.groupBy("source").agg(F.count("*").alias(name))
    return n(none, "unknown").join(n(some, "known"), "source")


@reg("g29_control_run", ", pc AS (SELECT DISTINCT row, col FROM placed), k AS (SELECT CASE WHEN pc.row IS NULL THEN 0 ELSE 1 END AS y, ((m.row * 1000 + m.col) * 2654435761 + 4 * 40503) % 1000003 AS h FROM mask m LEFT JOIN pc ON m.row = pc.row AND m.col = pc.col), n AS (SELECT sum(y)::BIGINT AS presences, count(*) FILTER (y = 0) AS background FROM k), r AS (SELECT y, rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2.0::DOUBLE AS rk FROM k) SELECT 'control' AS layer, presences, background, 1.0::DOUBLE AS auc FROM n UNION ALL SELECT 'chance', presences, background, round(((SELECT sum(rk) FROM r WHERE y = 1) - presences * (presences + 1) / 2) / (presences * background)::DOUBLE, 9) FROM n", "placed", "mask")
def _(s, d):
    """A control is scored by a layer that knows it and by one that doesn't: an AUC of 1 and one near chance."""
    from terrane.operators import metrics

    control = L.control_layer(A.mask(s, d), P.placed(A.points(s, d)))
    rows = control.select(F.col("value").cast("int").alias("y"), F.col("value").alias("s"), (A.hashed(F.col("row") * 1000 + F.col("col"), 4) / 1000003).alias("chance"))
    auc = metrics.roc_auc(rows.select("y", F.explode(F.array(F.struct(F.lit("control").alias("layer"), "s"), F.struct(F.lit("chance").alias("layer"), F.col("chance").alias("s")))).alias("k")).select("y", "k.layer", "k.s"), ["layer"])
    n = rows.agg(F.sum("y").alias("presences"), F.count_if(F.col("y") == 0).alias("background"))
    return auc.join(F.broadcast(n)).select("layer", "presences", "background", F.round("auc", 9).alias("auc"))


@reg("m7_sedi", ", k AS (SELECT count(*) FILTER (s >= 0.3 AND y = 1) / count(*) FILTER (y = 1)::DOUBLE AS h, count(*) FILTER (s >= 0.3 AND y = 0) / count(*) FILTER (y = 0)::DOUBLE AS f FROM scores) SELECT (ln(f) - ln(h) - ln(1 - f) + ln(1 - h)) / (ln(f) + ln(h) + ln(1 - f) + ln(1 - h)) AS sedi FROM k", "scores")
def _(s, d):
    from terrane.operators import metrics

    return metrics.rates(metrics.confusion(A.scores(s, d), 0.3)).select("sedi")


@reg("m7_sedi_reference", ", k AS (SELECT count(*) FILTER (s >= 0.3 AND y = 1) / count(*) FILTER (y = 1)::DOUBLE AS h, count(*) FILTER (s >= 0.3 AND y = 0) / count(*) FILTER (y = 0)::DOUBLE AS f FROM scores) SELECT (ln(h * (1 - f)) - ln((1 - h) * f)) / (ln(h * (1 - f)) + ln((1 - h) * f)) AS sedi FROM k", "scores")
def _(s, d):
    from terrane.operators import metrics

    return metrics.rates(metrics.confusion(A.scores(s, d), 0.3), "reference").select("sedi")


@reg("m18_parameters", "SELECT unnest(['linear', 'product']) AS features, true AS bounded")
def _(s, d):
    """Parameters of a linear model of two columns (an intercept and two at most) and of one of second degree (six)."""
    from terrane.operators import models

    x = A.design(s, d)
    n = {k: models.parameters(models.fit_maxent(x, ["v0", "v1"], product=p)) for k, p in (("linear", False), ("product", True))}
    return s.createDataFrame([("linear", 1 <= n["linear"] <= 3), ("product", 1 <= n["product"] <= 6)], "features string, bounded boolean")


@reg("c13_fitted_names", "SELECT * FROM (VALUES ('v0', 0), ('v1', 1)) t(variable, idx)")
def _(s, d):
    from terrane.operators import models

    names = models.fitted_names(models.fit_maxent(A.design(s, d), ["v0", "v1"], product=False))
    return s.createDataFrame(list(zip(names, range(len(names)))), "variable string, idx int")


@reg("n7_tiles", "SELECT floor(row / 256)::BIGINT AS tile_row, floor(col / 256)::BIGINT AS tile_col, count(*) AS n FROM cells GROUP BY ALL", "cells")
def _(s, d):
    r, c = STUDY.tile(256)
    return A.cells(s, d).groupBy(r.alias("tile_row"), c.alias("tile_col")).agg(F.count("*").alias("n"))


@reg("r2_effect_labels", ", g AS (SELECT variable, count(value) FILTER (meta_run = 'F') AS n, count(value) FILTER (meta_run = 'O') AS m, avg(value) FILTER (meta_run = 'O') - avg(value) FILTER (meta_run = 'F') AS d, var_samp(value) FILTER (meta_run = 'F') AS va, var_samp(value) FILTER (meta_run = 'O') AS vb FROM importances GROUP BY variable), c AS (SELECT variable, abs(d / sqrt(((n - 1) * va + (m - 1) * vb) / (n + m - 2))) AS c FROM g) SELECT variable, CASE WHEN c < 0.2 THEN 'negligible' WHEN c < 0.5 THEN 'small' WHEN c < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM c", "importances")
def _(s, d):
    return S.welch(A.importances(s, d), ["variable"], "meta_run", "F", "O", "value").select("variable", "effect")


@reg("r9_deep_merge", "WITH t AS (SELECT 'c' || context_id AS c, * FROM training_context), flat AS (SELECT c || '.season' AS path, '\"' || season || '\"' AS value FROM t UNION ALL SELECT c || '.fit.temporal', '\"' || temporal || '\"' FROM t UNION ALL SELECT c || '.fit.quantile', nt2_quantile::VARCHAR FROM t UNION ALL SELECT c || '.predictors', '[\"' || array_to_string(predictors, '\", \"') || '\"]' FROM t) SELECT path, CASE path WHEN 'c1.season' THEN '\"any\"' WHEN 'c1.predictors' THEN '[\"slope\"]' ELSE value END AS value FROM flat")
def _(s, d):
    """All contexts with the season of the first one set and its list of predictors replaced whole."""
    return config.as_table(s, config.merged(_settings(s, d), {"c1": {"season": "any", "predictors": ["slope"]}}))


@reg("r14_one_scenario", "SELECT season, temporal, nt2_quantile FROM training_context WHERE context_id = 3")
def _(s, d):
    t = [r.asDict() for r in table(s, d, "training_context").select("context_id", "season", "temporal", "nt2_quantile").collect()]  # twelve rows
    one = config.only(t, context_id=3)
    return s.createDataFrame([(one["season"], one["temporal"], one["nt2_quantile"])], "season string, temporal string, nt2_quantile double")


@reg("r20_resolved_scenario", "SELECT 'c' || context_id || '.fit.quantile' AS path, nt2_quantile::VARCHAR AS \"left\", '0.5' AS \"right\", CASE context_id WHEN 1 THEN 'allowed' ELSE 'unexpected' END AS kind FROM training_context WHERE nt2_quantile <> 0.5")
def _(s, d):
    """The differences that a patch makes to the contexts, those in the first one being allowed."""
    before = _settings(s, d)
    after = config.merged(before, {k: {"fit": {"quantile": 0.5}} for k in before})
    return U.differences(config.as_table(s, before), config.as_table(s, after), ["c1"])


QUERIES = Q

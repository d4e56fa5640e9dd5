"""Mixing sources to target shares of the tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import quota
from terrane.functions.hashing import uniform
from terrane.functions.text import folded
from terrane.llm.tokens import encoded
from terrane.session import staged


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None) -> DataFrame:
    """(key, source folded, n_tokens) of each document, written once as several steps read it. A null source stays null."""
    told = docs.select(F.struct(F.col(key).alias("k"), folded(source).alias("s")).alias("__k"), text)
    counted = encoded(told, "__k", text, path, ids=False)
    return staged(counted.select(F.col("__k.k").alias(key), F.col("__k.s").alias("__source"), "n_tokens"))


def plan(tokens: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """One row for each row of targets: tokens there are, tokens wanted, whole copies, and the tokens of one copy more.

    The wanted total is `budget`, or all tokens of the listed sources. `whole` copies of each document are certain, at most
    max_repeats, and documents of `part` tokens more are drawn.
    """
    have = tokens.groupBy("__source").agg(F.sum("n_tokens").alias("n"))
    t = targets.select("source", folded("source").alias("__source"), F.col("target_per_10k").cast("bigint").alias("target_per_10k"), F.col("max_repeats").cast("bigint").alias("max_repeats"))
    t = t.join(have, "__source", "left").withColumn("available", F.coalesce("n", F.lit(0)).cast("bigint")).drop("n")
    # each source counts once in the total, though targets may spell it twice
    total = F.lit(budget) if budget is not None else F.expr("sum(available) over ()")
    t = t.withColumn("total", total.cast("bigint"))
    wanted = F.col("target_per_10k") * F.col("total")  # in ten-thousandths of a token, so all below is exact
    copies = F.when(F.col("available") > 0, F.floor(wanted / (F.col("available") * 10000)))
    t = t.withColumn("whole", F.least(F.coalesce(copies, F.lit(0)), F.col("max_repeats")).cast("bigint"))
    part = F.when(F.col("whole") < F.col("max_repeats"), F.floor(wanted / 10000) - F.col("whole") * F.col("available")).otherwise(0)
    return t.withColumn("part", F.greatest(F.lit(0), part).cast("bigint"))


def inclusion(rows: DataFrame) -> DataFrame:
    """(source, __c): the scale c of a source for which its documents' inclusion p = min(1, c / root(n_tokens)) gives
    `part` tokens on average, that is, sum(p x n_tokens) = part.

    Documents of few tokens reach p = 1 first, and what they can't give goes to the longer ones. Sums are made by source and by
    power of the root of two of n_tokens, of which there are few; the documents of one power become certain together.
    """
    step = F.floor(2 * F.log2("n_tokens")).cast("int")
    sums = rows.groupBy("source", step.alias("__step")).agg(F.first("part").alias("part"), F.sum("n_tokens").alias("__n"), F.sum(F.sqrt("n_tokens")).alias("__root"), F.min("n_tokens").alias("__least"))
    lists = sums.groupBy("source").agg(F.first("part").cast("double").alias("part"), F.array_sort(F.collect_list(F.struct("__least", "__n", "__root"))).alias("__s"))
    # certain ones are the shortest: of each number of certain steps, what is left over the roots of the others
    prefix = lambda k: F.aggregate(F.slice("__s", 1, k), F.lit(0.0), lambda a, x: a + x["__n"])
    rest = lambda k: F.aggregate(F.slice("__s", k + 1, F.size("__s")), F.lit(0.0), lambda a, x: a + x["__root"])
    c = lambda k: F.greatest(F.lit(0.0), F.col("part") - prefix(k)) / F.greatest(rest(k), F.lit(1e-9))
    # the first number of certain steps at which the next step isn't certain any more
    tried = F.transform(F.sequence(F.lit(0), F.size("__s") - 1), lambda k: F.struct(c(k).alias("c"), F.sqrt(F.get("__s", k)["__least"]).alias("root")))
    fit = F.coalesce(F.get(F.filter(tried, lambda t: t["c"] <= t["root"]), F.lit(0))["c"], F.element_at(tried, -1)["c"])
    return lists.select("source", fit.alias("__c"))


def drawn(tokens: DataFrame, planned: DataFrame, key: str = "doc_id", seed: int = 1) -> DataFrame:
    """(key, source, n_tokens, copies) of the documents in the mix.

    Beyond the whole copies, a source's documents are ranked by Pareto's key: random odds over the odds of inclusion,
    u / (1 - u) : p / (1 - p). p falls with the root of the length, is 1 at most, and sums to the tokens wanted (see
    `inclusion`), so that the tokens drawn come from many documents. Documents are taken in that order while they fit in
    the tokens wanted; one that doesn't is passed over.
    """
    rows = tokens.filter(F.col("n_tokens") > 0).join(planned.select("__source", "source", "whole", "part", "available"), "__source")
    some = rows.filter(F.col("part") > 0)
    some = some.join(inclusion(some), "source")
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("__c") / F.sqrt("n_tokens")))
    u = uniform(key, seed=seed)
    odds = (u / (1 - u)) / (p / (1 - p))
    # the order's end is near odds of 1, so the key, laid into [0, 1), is fine around 1/2
    some = some.withColumn("__key", odds / (odds + F.lit(1.0)))
    extra = quota.take(some, planned.filter(F.col("part") > 0), ["source"], "__key", [key], F.col("n_tokens"), "part", rounds=8)
    certain = rows.filter(F.col("whole") > 0).select(key, "source", "n_tokens", F.col("whole").alias("copies"))
    return certain.unionByName(extra.select(key, "source", "n_tokens", F.lit(1).cast("bigint").alias("copies"))).groupBy(key, "source", "n_tokens").agg(F.sum("copies").alias("copies"))


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", budget: int | None = None, path: str | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of a mix in which each source gives its target share of the tokens.

    sample: key, source as spelled in targets, n_tokens, copies. report: for each row of targets its tokens there are, the
    tokens wanted, given, spare (that documents in the mix and out of it could still give) and missing, the shares in
    ten-thousandths wanted and reached, and `short`: the tokens given are fewer than its share and none are spare, which
    is counted over the mix drawn. A source that isn't short misses at most what no document left fits into. Sources are
    compared without outer blanks and regardless of case; documents of null or unlisted sources take no part, nor do texts
    without tokens. A target without documents has 0 tokens and is short unless its share is 0. No documents at all give
    an empty sample. Keys must be unique. A source's size doesn't matter: sums are made by cut of the order key, none is
    ranked whole.
    """
    tokens = sized(docs, key, text, source, path)
    planned = staged(plan(tokens, targets, budget))
    sample = drawn(tokens, planned, key, seed)
    given = sample.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("given"), F.sum("copies").alias("rows"))
    report = planned.join(given, "source", "left").withColumns({"given": F.coalesce("given", F.lit(0)).cast("bigint"), "rows": F.coalesce("rows", F.lit(0)).cast("bigint")})
    report = report.withColumn("spare", F.col("available") * F.col("max_repeats") - F.col("given"))
    report = report.withColumn("short", (F.col("given") * 10000 < F.col("target_per_10k") * F.col("total")) & (F.col("spare") == 0))
    report = report.select("source", "target_per_10k", "max_repeats", "available", F.floor(F.col("target_per_10k") * F.col("total") / 10000).alias("wanted"), "given", "rows", "spare", "short")
    whole = F.expr("sum(given) over ()")
    return sample, report.withColumn("reached_per_10k", F.round(F.try_divide(F.col("given") * 10000.0, whole), 2)).withColumn("missing", F.greatest(F.lit(0), F.col("wanted") - F.col("given")))

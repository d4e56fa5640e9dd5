"""Collinearity of predictors: product sums, variance inflation, selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.quota import share_of


def product_sums(df: DataFrame, columns: Sequence[str], about: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, products) over rows in which all columns are known and finite: one pass, whatever the number of columns.
    about: numbers taken off the columns first (their means, for centred sums).

    Each task gives one matrix of columns by columns; only their sums (bounded by the columns) reach the driver.
    """
    k = len(columns)
    shift = np.zeros(k) if about is None else np.asarray(about, float)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(k), np.zeros((k, k))
        for batch in it:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) if len(batch) else np.zeros((0, k))
            x = x[np.isfinite(x).all(1)] - shift
            n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        flat = [float(n), *s, *p.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["i", "v"])

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(1 + k + k * k)
    for r in rows:
        flat[r.i] = r.v
    return int(flat[0]), flat[1 : 1 + k], flat[1 + k :].reshape(k, k)


def correlation_matrix(n: int, sums: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Pearson's correlations of product sums; NaN for columns without spread, 1 on the diagonal."""
    cov = products - np.outer(sums, sums) / max(n, 1)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd = np.where(sd > 1e-12 * np.sqrt(np.maximum(np.diag(products), 1e-300)), sd, np.nan)
    r = cov / np.outer(sd, sd)
    np.fill_diagonal(r, 1.0)
    return r


def vif(n: int, sums: np.ndarray, products: np.ndarray, intercept: bool) -> np.ndarray:
    """Variance inflation of each column, about its mean (with intercept) or about zero (without); inf if it is implied by
    the others."""
    m = correlation_matrix(n, sums, products) if intercept else products
    if not len(m):
        return np.zeros(0)
    if np.isnan(m).any() or np.linalg.cond(m) > 1e14:
        inv = np.linalg.pinv(np.nan_to_num(m))
        out = np.diag(m) * np.diag(inv)
        return np.where(np.isfinite(out) & (out >= 1), out, np.inf)
    return np.diag(m) * np.diag(np.linalg.inv(m))


def stepwise(columns: Sequence[str], n: int, sums: np.ndarray, products: np.ndarray, limit: float = 5.0, intercept: bool = False) -> list[str]:
    """Columns left when the one of largest inflation is dropped while it is over the limit; no further pass is made."""
    keep = list(range(len(columns)))
    while len(keep) > 1:
        v = vif(n, sums[keep], products[np.ix_(keep, keep)], intercept)
        worst = int(np.argmax(v))
        if v[worst] <= limit:
            break
        keep.pop(worst)
    return [columns[i] for i in keep]


def clusters(corr: np.ndarray, cut: float, linkage: str = "average") -> np.ndarray:
    """Clusters of the rows of |corr| as points, joined nearest first while their distance is at most cut.

    linkage: single, complete, average or ward, how far a joined cluster is from the others."""
    if linkage not in ("single", "complete", "average", "ward"):
        raise ValueError(f"no linkage: {linkage}")
    x = np.nan_to_num(np.abs(corr))
    sizes, groups = np.ones(len(x)), [[i] for i in range(len(x))]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    while len(groups) > 1:
        a, b = np.unravel_index(int(d.argmin()), d.shape)
        far = d[a, b]
        if far > cut:
            break
        na, nb = sizes[a], sizes[b]
        if linkage == "single":
            new = np.minimum(d[a], d[b])
        elif linkage == "complete":
            new = np.maximum(d[a], d[b])
        elif linkage == "average":
            new = (na * d[a] + nb * d[b]) / (na + nb)
        else:
            new = np.sqrt(((na + sizes) * d[a] ** 2 + (nb + sizes) * d[b] ** 2 - sizes * far**2) / (na + nb + sizes))
        d[a], d[:, a] = new, new
        d[a, a] = np.inf
        sizes[a] += nb
        groups[a] += groups[b]
        d, sizes = np.delete(np.delete(d, b, 0), b, 1), np.delete(sizes, b)
        groups.pop(b)
    out = np.zeros(len(x), int)
    for k, g in enumerate(sorted(groups, key=min)):
        out[g] = k
    return out


def representatives(columns: Sequence[str], corr: np.ndarray, cut: float, linkage: str = "average") -> list[str]:
    """Of each cluster the column of lowest mean |correlation| with the cluster's, the first of equal ones."""
    of, x = clusters(corr, cut, linkage), np.nan_to_num(np.abs(corr))
    out = []
    for k in range(of.max() + 1 if len(of) else 0):
        own = np.flatnonzero(of == k)
        mean = x[np.ix_(own, own)].mean(0)
        out.append(columns[min(zip(mean, own))[1]])
    return out


def select_group(columns: Sequence[str], n: int, sums: np.ndarray, products: np.ndarray, cut: float, limit: float = 5.0, linkage: str = "average") -> list[str]:
    """Columns of one group that stay: constant ones are left out, then one of each cluster of correlated ones is taken, and
    of these the one of largest inflation is dropped while it is over the limit. A single column stays as it is."""
    if len(columns) <= 1:
        return list(columns)
    varies = [i for i in range(len(columns)) if n * products[i, i] - sums[i] ** 2 > 1e-12 * max(n * products[i, i], 1e-300)]
    if len(varies) <= 1:
        return [columns[i] for i in varies]
    take = lambda idx: (sums[idx], products[np.ix_(idx, idx)])
    names = [columns[i] for i in varies]
    kept = representatives(names, correlation_matrix(n, *take(varies)), cut, linkage)
    at = [columns.index(c) for c in kept]
    return stepwise(kept, n, *take(at), limit=limit)


#: Parts and beginnings of names that tell the kinds of predictors.
SATELLITE = ("ndvi", "evi", "nbr", "ndwi", "ndbi", "ndmi", "ndsi", "bsi", "vssi")
REANALYSIS = ("2m_temperature", "soil_temperature", "snow_depth", "precip", "pet", "skin_t", "soil_moist", "ssrd", "surface_solar_radiation", "volumetric_soil_water_layer", "vpd", "tmax", "tmean")
BARRED = ("bio08", "bio09")
AUXILIARY = ("small_woody", "zones_humides", "humanfootprint")
UNFILTERED = ("fragment", "hunting")
MONTHS = ("04", "07", "10")


def family(name: Column | str) -> Column:
    """The kind a predictor's name tells, for the selection by inflation: satellite, bio, era5 or other; null for names that
    are left out (with anom, or beginning with a barred one)."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    begins = lambda ps: F.greatest(*[F.startswith(n, F.lit(p)) for p in ps])
    has = lambda ps: F.greatest(*[F.contains(n, F.lit(p)) for p in ps])
    return F.when(F.contains(n, F.lit("anom")) | begins(BARRED), None).when(has(SATELLITE), "satellite").when(F.startswith(n, F.lit("bio")), "bio").when(begins(REANALYSIS), "era5").otherwise("other")


def routed(name: Column | str, year: int | None = None) -> Column:
    """The group of variable selection a name belongs to: landcover, unfiltered, bio, a month's satellite layers (sat_04 and
    so on, of `year` if given), aux or other; null for the urban class, which is left out."""
    n = F.col(name) if isinstance(name, str) else name
    low = F.lower(n)
    has = lambda ps: F.greatest(*[F.contains(low, F.lit(p)) for p in ps])
    land = n.rlike(r"(^|\d{4}_)class\d+_")
    out = F.when(land & F.contains(n, F.lit("class11_URBAN")), None).when(land, "landcover").when(has(UNFILTERED), "unfiltered").when(F.startswith(low, F.lit("bio")), "bio")
    for m in MONTHS:
        out = out.when(n.rlike(rf"{year}_{m}_" if year else rf"(^|_){m}_"), f"sat_{m}")
    return out.when(F.startswith(n, F.lit("DEM_")) | n.rlike(r"^LC\d+_") | has(AUXILIARY), "aux").otherwise("other")


def selected(table: DataFrame, most: dict[str, int], pairs: DataFrame | None = None, cutoff: float = 0.7) -> DataFrame:
    """(variable, family) of a table (variable, vif): in the families of `most` those of lowest inflation, then by name, up
    to so many; other families whole. pairs (a, b, r): of a chosen bio and a chosen era5 variable with |r| >= cutoff the one
    of higher inflation goes, the bio one if they are equal. A missing inflation counts as the highest."""
    t = table.withColumn("family", family("variable")).filter(F.col("family").isNotNull())
    limit = F.lit(None).cast("int")
    for k, n in most.items():
        limit = F.when(F.col("family") == k, n).otherwise(limit)
    rank = F.row_number().over(W.partitionBy("family").orderBy(F.asc_nulls_last("vif"), "variable"))
    kept = t.withColumns({"__r": rank, "__m": limit}).filter(F.col("__m").isNull() | (F.col("__r") <= F.col("__m"))).select("variable", "family", F.coalesce("vif", F.lit(float("inf"))).alias("vif"))
    if pairs is not None:
        both = pairs.select("a", "b", "r").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).filter(F.abs("r") >= cutoff)
        side = lambda k, v: kept.filter(F.col("family") == k).select(F.col("variable").alias(v), F.col("vif").alias(f"vif_{v}"))
        near = both.join(side("bio", "a"), "a").join(side("era5", "b"), "b")
        gone = near.select(F.when(F.col("vif_a") >= F.col("vif_b"), F.col("a")).otherwise(F.col("b")).alias("variable")).distinct()
        kept = kept.join(gone, "variable", "left_anti")
    return kept.select("variable", "family")


def sample_matrix(df: DataFrame, columns: Sequence[str], share: float, draw: Column, tie: Sequence[str], least: int = 2) -> tuple[DataFrame, list[str]]:
    """(rows, columns) to measure inflation on: max(least, round(share x rows)) rows of smallest draw, of these the ones in which all
    columns are known and finite, and the columns that vary in them. Fewer than two of either is an error."""
    rows = share_of(df.withColumn("__draw", draw), share, "__draw", tie, least).drop("__draw")
    known = F.lit(True)
    for c in columns:
        v = F.col(c).cast("double")
        known &= v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = rows.filter(known)
    told = rows.agg(F.count("*").alias("__n"), *[(F.max(c) > F.min(c)).alias(c) for c in columns]).first()
    varies = [c for c in columns if told[c]]
    if told["__n"] < 2 or len(varies) < 2:
        raise ValueError(f"{told['__n']} rows and {len(varies)} columns are too few for inflation")
    return rows, varies


def selection(df: DataFrame, groups: dict[str, str | None], cut: float, limits: dict[str, float] | None = None, linkage: str = "average", overlap: float = 0.9, most: int | None = None) -> list[str]:
    """The predictors that variable selection keeps, in order: land cover and unfiltered ones, then those chosen from bio, each
    month's satellite layers, and aux with other together, of the others only those not correlated by `overlap` or more
    with any land cover; `most` at most. groups: predictor -> its group (`routed`). One pass over df, whatever the columns.
    """
    names = [c for c, g in groups.items() if g is not None]
    n, sums, products = product_sums(df, names)
    corr = np.nan_to_num(np.abs(correlation_matrix(n, sums, products)))
    of = lambda *gs: [c for c in names if groups[c] in gs]
    at = {c: i for i, c in enumerate(names)}
    land = [at[c] for c in of("landcover")]
    others = [c for c in of("other") if not land or corr[at[c], land].max() < overlap]
    out = of("landcover") + of("unfiltered")
    for label, members in (("bio", of("bio")), *((f"sat_{m}", of(f"sat_{m}")) for m in MONTHS), ("aux", of("aux") + others)):
        idx = [at[c] for c in members]
        out += select_group(members, n, sums[idx], products[np.ix_(idx, idx)], cut, (limits or {}).get(label, 5.0), linkage)
    return out[:most]


def overlapping(pairs: DataFrame, families: DataFrame, family_: str = "landcover", limit: float = 0.9) -> DataFrame:
    """Variables outside the family whose |correlation| (a, b, r) with one of it reaches the limit."""
    both = pairs.select("a", "b", "r").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    f = families.select("variable", "family")
    j = both.join(f.withColumnsRenamed({"variable": "a", "family": "fa"}), "a").join(f.withColumnsRenamed({"variable": "b", "family": "fb"}), "b")
    return j.filter((F.col("fa") != family_) & (F.col("fb") == family_)).groupBy(F.col("a").alias("variable")).agg(F.max(F.abs("r")).alias("r")).filter(F.col("r") >= limit)

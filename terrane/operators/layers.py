"""Layers of grid cells: names, fusing, averaging, filling, resampling. Long layers are (row, col, layer, value)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions.grid import Grid
from terrane.session import staged

#: The value that stands for missing in raster files, and names of satellite indices.
NODATA = -9999.0
SATELLITE = ("ndvi", "ndwi", "ndmi", "evi", "bsi")


def known(value: Column | str, nodata: float = NODATA, low: float | None = None, high: float | None = None) -> Column:
    """The value, or null if it is nodata, NaN, infinite or outside [low, high]."""
    v = F.col(value) if isinstance(value, str) else value
    ok = (v != nodata) & ~F.isnan(v) & (F.abs(v) < float("inf"))
    if low is not None:
        ok &= v >= low
    if high is not None:
        ok &= v <= high
    return F.when(ok, v)


def base_name(layer: Column | str) -> Column:
    """The name without its first year: a year between two parts, at the start, or at the end, in this order of rules."""
    n = F.col(layer) if isinstance(layer, str) else layer
    return (
        F.when(n.rlike(r"^.+?_\d{4}_.+"), F.regexp_replace(n, r"^(.+?)_\d{4}_(.+)$", "$1_$2"))
        .when(n.rlike(r"^\d{4}_.+"), F.regexp_replace(n, r"^\d{4}_(.+)$", "$1"))
        .when(n.rlike(r"^.+_\d{4}$"), F.regexp_replace(n, r"^(.+)_\d{4}$", "$1"))
        .otherwise(n)
    )


def layer_year(layer: Column | str) -> Column:
    """The first year token of a name, or null."""
    return F.nullif(F.regexp_extract(layer, r"(?:^|_)(\d{4})(?:_|$)", 1), F.lit("")).try_cast("int")


def of_year(layers: DataFrame, year: int, always: Sequence[str] = ("mask",)) -> DataFrame:
    """Layers without a year or of that year, and those always kept."""
    y = layer_year("layer")
    return layers.filter(y.isNull() | (y == year) | F.col("layer").isin(*always))


def of_reference_year(layers: DataFrame, year: int) -> DataFrame:
    """Layers of land cover (with _class in their name after the year), of that year, or without a year."""
    y = layer_year("layer")
    return layers.filter(F.contains("layer", F.lit("_class")) | y.isNull() | (y == year))


def without_rules(layers: DataFrame, rules: DataFrame) -> DataFrame:
    """Layers that no rule (layer, action) drops; actions are compared in lower case."""
    return layers.join(rules.filter(F.lower("action") == "drop").select("layer"), "layer", "left_anti")


def without_words(layers: DataFrame, words: Sequence[str] = ("anom",)) -> DataFrame:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower("layer"), F.lit(w.lower()))
    return layers.filter(~hit)


def fused(layers: DataFrame, order: Column | str = "layer") -> DataFrame:
    """One layer for each base name: in each cell, the first value that isn't null, by the order."""
    named = layers.withColumn("__b", base_name("layer"))
    first = F.min(F.when(F.col("value").isNotNull(), F.struct((F.col(order) if isinstance(order, str) else order).alias("o"), "value")))
    return named.groupBy("row", "col", F.col("__b").alias("layer")).agg(first["value"].alias("value"))


def year_mean(layers: DataFrame) -> DataFrame:
    """One layer for each base name: the mean over years of the values that aren't null."""
    return layers.groupBy("row", "col", base_name("layer").alias("layer")).agg(F.avg("value").alias("value"))


def coverage(layers: DataFrame, expected: DataFrame) -> DataFrame:
    """For each base name of expected (layer, year): the years there are, those missing, and whether none is there."""
    have = layers.filter(F.col("value").isNotNull()).select(base_name("layer").alias("layer"), layer_year("layer").alias("year")).distinct().withColumn("__h", F.lit(True))
    both = expected.join(have, ["layer", "year"], "left")
    return both.groupBy("layer").agg(F.sort_array(F.collect_set(F.when(F.col("__h"), F.col("year")))).alias("available"), F.sort_array(F.collect_set(F.when(F.col("__h").isNull(), F.col("year")))).alias("missing")).withColumn("excluded", F.size("available") == 0)


def filled_from_other_years(layers: DataFrame, wanted: DataFrame, indices: Sequence[str] = SATELLITE) -> DataFrame:
    """Cells of wanted (year, suffix) layers that are not there: the mean of the same suffix in other years.

    Only suffixes with a satellite index among their parts are filled. Gives (row, col, layer, value).
    """
    have = layers.withColumns({"__y": layer_year("layer"), "__s": F.regexp_replace("layer", r"^\d{4}_", "")}).filter(F.col("__y").isNotNull() & F.col("value").isNotNull())
    token = F.arrays_overlap(F.split(F.lower("suffix"), r"[_\W]+"), F.array(*[F.lit(i) for i in indices]))
    missing = wanted.filter(token).join(have.select(F.col("__y").alias("year"), F.col("__s").alias("suffix")).distinct(), ["year", "suffix"], "left_anti")
    others = have.join(missing, (F.col("__s") == F.col("suffix")) & (F.col("__y") != F.col("year")))
    return others.groupBy("row", "col", F.concat_ws("_", F.col("year").cast("string"), "suffix").alias("layer")).agg(F.avg("value").alias("value"))


def masked(cells: DataFrame, mask: DataFrame, layers: Sequence[str]) -> DataFrame:
    """All cells, their layers being null outside the mask."""
    inside = mask.select("row", "col").distinct().withColumn("__in", F.lit(True))
    return cells.join(inside, ["row", "col"], "left").withColumns({v: F.when(F.col("__in"), F.col(v)) for v in layers}).drop("__in")


def mosaic(tiles: DataFrame, fill: float = 0.0) -> DataFrame:
    """(row, col, value) of overlapping tiles: the largest value of a cell, `fill` if all are null."""
    return tiles.groupBy("row", "col").agg(F.coalesce(F.max(known("value")), F.lit(fill)).alias("value"))


def resampled(cells: DataFrame, factor: float, layers: Sequence[str]) -> DataFrame:
    """The same layers on a grid `factor` times as fine (or as coarse, below 1): each new cell takes its centre's value."""
    if factor >= 1:
        k = int(factor)
        steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(k) for j in range(k)])
        fine = cells.select("row", "col", *layers, F.inline(steps))
        return fine.select((F.col("row") * k + F.col("i")).alias("row"), (F.col("col") * k + F.col("j")).alias("col"), *layers)
    k = round(1 / factor)
    at = k // 2
    return cells.filter((F.col("row") % k == at) & (F.col("col") % k == at)).select(F.floor(F.col("row") / k).alias("row"), F.floor(F.col("col") / k).alias("col"), *layers)


def regridded(cells: DataFrame, source: Grid, target: Grid, layers: Sequence[str]) -> DataFrame:
    """The layers on another grid of the same coordinates, whatever its origin and cell size: each cell of the target takes
    the values of the source cell that its centre lies in; centres outside the source have no row.

    Every source cell tells itself which centres lie in it, so nothing is joined and no cell meets another.
    """
    # the first and the last target cell whose centre is at or behind the source cell's near edge, and before its far one
    first = lambda edge: F.ceil(edge / F.lit(target.cell) - 0.5)
    left, top = F.lit(source.x0 - target.x0) + F.col("col") * source.cell, F.lit(target.top - source.top) + F.col("row") * source.cell
    span = lambda edge, most: (F.greatest(F.lit(0), first(edge)).cast("bigint"), F.least(F.lit(most - 1), first(edge + source.cell) - 1).cast("bigint"))
    (r0, r1), (c0, c1) = span(top, target.rows), span(left, target.cols)
    kept = cells.filter((r0 <= r1) & (c0 <= c1)).select(F.explode(F.sequence(r0, r1)).alias("__r"), c0.alias("__c0"), c1.alias("__c1"), *layers)
    return kept.select(F.col("__r").alias("row"), F.explode(F.sequence("__c0", "__c1")).alias("col"), *layers)


def outline(mask: DataFrame, grid: Grid) -> DataFrame:
    """(x1, y1, x2, y2) of the sides of the mask's cells that face a cell outside it, each side once: a polygon's edges.

    A side is named by the cell below or right of it; one that two cells of the mask share is counted twice and dropped."""
    sides = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("row") + i).alias("r"), (F.col("col") + j).alias("c")) for k, i, j in (("top", 0, 0), ("top", 1, 0), ("left", 0, 0), ("left", 0, 1))])
    once = mask.select("row", "col").distinct().select(F.inline(sides)).groupBy("k", "r", "c").agg(F.count("*").alias("n")).filter("n = 1")
    x, y = F.lit(grid.x0) + F.col("c") * grid.cell, F.lit(grid.top) - F.col("r") * grid.cell
    flat = F.col("k") == "top"
    return once.select(x.alias("x1"), y.alias("y1"), F.when(flat, x + grid.cell).otherwise(x).alias("x2"), F.when(flat, y).otherwise(y - grid.cell).alias("y2"))


def tiled_mask(cells: DataFrame, mask: DataFrame, height: int, width: int) -> DataFrame:
    """Cells whose place within the tile is in the mask (a mask repeated, not scaled)."""
    tile = mask.select(F.col("row").alias("__r"), F.col("col").alias("__c")).distinct()
    keyed = cells.withColumns({"__r": F.pmod("row", F.lit(height)), "__c": F.pmod("col", F.lit(width))})
    return keyed.join(tile, ["__r", "__c"], "left_semi").drop("__r", "__c")


def directional_fill(cells: DataFrame, value: str = "value") -> DataFrame:
    """Missing values take the nearest value along the column, then along the row, the earlier of two equally near."""
    out = cells
    for line, along in (("col", "row"), ("row", "col")):
        # each way from its own end, as a window to the end of a line is made anew for each of its cells
        w, back = (W.partitionBy(line).orderBy(o).rowsBetween(W.unboundedPreceding, 0) for o in (F.asc(along), F.desc(along)))
        seen = F.when(F.col(value).isNotNull(), F.struct(F.col(along).alias("a"), F.col(value).alias("v")))
        before, after = F.last(seen, ignorenulls=True).over(w), F.last(seen, ignorenulls=True).over(back)
        earlier = F.col("__a.v").isNull() | (F.col(along) - F.col("__b.a") <= F.col("__a.a") - F.col(along))
        near = F.when(F.col("__b.v").isNotNull() & earlier, F.col("__b.v")).otherwise(F.col("__a.v"))
        out = out.withColumns({"__b": before, "__a": after}).withColumn(value, F.coalesce(value, near)).drop("__b", "__a")
    return out


def nearest_fill(cells: DataFrame, value: str = "value", band: int = 64) -> DataFrame:
    """Missing values take that of the nearest known cell, however far; of equally near ones the one of smallest row, then
    column. Without any known cell they stay null. cells: one row a cell; they are written once.

    The squared distance comes apart by direction: in each column every place first finds the nearest known cell, and then a
    missing one looks along its row for the column for which both distances together are least. A task holds the known
    cells of a column, or a band of rows, never the grid; known cells are not moved a second time.
    """
    cells = staged(cells)
    lacking = F.col(value).isNull()
    ends = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count(value).alias("known"), F.count_if(lacking).alias("lacking")).first()
    if not ends.known or not ends.lacking:
        return cells
    r0, r1, c0, wide = int(ends.r0), int(ends.r1), int(ends.c0), int(ends.c1 - ends.c0) + 1
    schema = cells.schema

    def down(column: pa.Table) -> pa.Table:
        """For each band the way to the nearest known row of this column, the upper of equally near ones, and its value."""
        rows = column.column("__r").to_numpy()
        order = np.argsort(rows, kind="stable")
        rows, all_ = rows[order], np.arange(r0, r1 + 1)
        below = np.minimum(np.searchsorted(rows, all_), len(rows) - 1)
        above = np.maximum(below - 1, 0)
        pick = np.where(np.abs(all_ - rows[above]) <= np.abs(rows[below] - all_), above, below)
        at = np.append(np.arange(0, len(all_), band), len(all_)).astype(np.int32)
        listed = lambda v: pa.ListArray.from_arrays(pa.array(at), v)
        own = column.column("__v").combine_chunks()
        return pa.table({"__band": np.arange(len(at) - 1), "__c": np.full(len(at) - 1, column.column("__c")[0].as_py()), "__gap": listed(pa.array(rows[pick] - all_)), "__v": listed(own.take(pa.array(order[pick])))})

    def along(columns: pa.Table, gone: pa.Table) -> pa.Table:
        if not len(gone):
            return gone.select(schema.names)
        lists = columns.column("__v").combine_chunks()
        start = lists.offsets.to_numpy()[:-1]
        far = np.iinfo(np.int64).max // 4
        gap = columns.column("__gap").combine_chunks().flatten().to_numpy().reshape(len(columns), -1)
        of = np.full(wide, -1)
        of[columns.column("__c").to_numpy() - c0] = np.arange(len(columns))
        row, col = gone.column("row").to_numpy().astype(np.int64), gone.column("col").to_numpy().astype(np.int64) - c0
        inner = (row - r0) % band

        def look(who: np.ndarray, c: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
            """The squared distance by way of the columns c, and the row reached there."""
            k = np.where((c >= 0) & (c < wide), of[np.clip(c, 0, wide - 1)], -1)
            g = gap[k, inner[who]]
            return np.where(k >= 0, g * g + step * step, far), row[who] + g

        left, step = np.arange(len(row)), 0
        best, at, by = np.full(len(row), far), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        while len(left):
            for c in (col[left] - step, col[left] + step) if step else (col[left],):
                d, r = look(left, c, step)
                less = (d < best[left]) | ((d == best[left]) & ((r < at[left]) | ((r == at[left]) & (c < by[left]))))
                who = left[less]
                best[who], at[who], by[who] = d[less], r[less], c[less]
            step += 1
            left = left[best[left] >= step * step] if step < wide else left[:0]
        found = lists.values.take(pa.array(start[of[by]] + inner))
        return pa.table({n: found if n == value else gone.column(n) for n in schema.names})

    known = cells.filter(~lacking).select(F.col("col").cast("bigint").alias("__c"), F.col("row").cast("bigint").alias("__r"), F.col(value).alias("__v"))
    kind = cells.select(F.array(value).alias("v")).schema["v"].dataType
    ways = known.groupBy("__c").applyInArrow(down, T.StructType([T.StructField("__band", T.LongType()), T.StructField("__c", T.LongType()), T.StructField("__gap", T.ArrayType(T.LongType())), T.StructField("__v", kind)]))
    gone = cells.filter(lacking).withColumn("__band", F.floor((F.col("row") - r0) / band).cast("bigint"))
    filled = gone.groupBy("__band").cogroup(ways.groupBy("__band")).applyInArrow(lambda a, b: along(b, a), T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
    return cells.filter(~lacking).unionByName(filled)


def density(points: DataFrame, sigma: float, reach: int) -> DataFrame:
    """(row, col, value): points counted by cell, smoothed by a Gaussian cut off at `reach` cells, scaled to a maximum of 1.

    Occupied cells are counted first and spread in one direction after the other.
    """
    from math import exp

    w = [exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    steps = F.array(*[F.struct(F.lit(i - reach).alias("i"), F.lit(v / sum(w)).alias("w")) for i, v in enumerate(w)])
    cells = points.groupBy("row", "col").agg(F.count("*").cast("double").alias("value"))
    for axis in ("row", "col"):
        other = "col" if axis == "row" else "row"
        cells = cells.select("row", "col", "value", F.inline(steps)).groupBy((F.col(axis) + F.col("i")).alias(axis), other).agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    cells = staged(cells)  # the maximum is asked of what the result is read from
    top = cells.agg(F.max("value").alias("__top"))
    return cells.join(F.broadcast(top)).select("row", "col", (F.col("value") / F.col("__top")).alias("value"))


def urban_decay(cells: DataFrame, alpha: float, value: str = "value") -> DataFrame:
    """exp(-alpha * share of towns), the share cut to [0, 1], scaled to [0, 1] with a little added to the range."""
    raw = cells.withColumn("__e", F.exp(-F.lit(float(alpha)) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))))
    ends = raw.agg(F.min("__e").alias("__lo"), F.max("__e").alias("__hi"))
    return raw.join(F.broadcast(ends)).withColumn(value, (F.col("__e") - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-6)).drop("__e", "__lo", "__hi")


def control_layer(mask: DataFrame, presences: DataFrame) -> DataFrame:
    """(row, col, value): 1 in cells with presences, 0 elsewhere in the mask."""
    taken = presences.select("row", "col").distinct().withColumn("__p", F.lit(1.0))
    return mask.join(taken, ["row", "col"], "left").select("row", "col", F.coalesce("__p", F.lit(0.0)).alias("value"))


def consistent_grids(headers: DataFrame, coefficients: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """(layer, same) for headers (layer, width, height, coefficients...) against the first layer by name."""
    first = headers.orderBy("layer").limit(1).select(*[F.col(c).alias(f"__{c}") for c in ("width", "height", *coefficients)])
    same = (F.col("width") == F.col("__width")) & (F.col("height") == F.col("__height"))
    for c in coefficients:
        same &= F.abs(F.col(c) - F.col(f"__{c}")) <= tolerance
    return headers.join(F.broadcast(first)).select("layer", same.alias("same"))


def by_domain(cells: DataFrame, domains: dict[str, str]) -> DataFrame:
    """(row, col, <domain>_<layer>...) of the layers that have a domain, each under its domain's name."""
    return cells.select("row", "col", *[F.col(v).cast("double").alias(f"{d}_{v}") for v, d in domains.items()])


def empty(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """(layer) of the layers without any known value."""
    n = cells.agg(*[F.count(known(F.col(v).cast("double"))).alias(v) for v in names]).unpivot([], list(names), "layer", "n")
    return n.filter("n = 0").select("layer")


def replicated(cells: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Each cell once for each of the values, as a layer that stands for several times."""
    return cells.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def long(cells: DataFrame, layers: Sequence[str]) -> DataFrame:
    return cells.unpivot(["row", "col"], [F.col(v).cast("double").alias(v) for v in layers], "layer", "value")


def wide(layers: DataFrame, names: Sequence[str]) -> DataFrame:
    """(row, col, names...) of long layers; a layer that a cell doesn't have is null."""
    return layers.groupBy("row", "col").agg(*[F.max(F.when(F.col("layer") == n, F.col("value"))).alias(n) for n in names])


def season_label(seasons: Column) -> Column:
    """The season that names a predefined grid, of an array of active seasons: the only one, else All_Semesters."""
    known_ = F.array_distinct(F.filter(seasons, lambda v: v.isNotNull()))
    return F.when(F.size(known_) == 1, known_[0]).otherwise("All_Semesters")


def predefined(runs: DataFrame, seasons: str, pattern: str, inventory: DataFrame) -> DataFrame:
    """runs with `path`, the predefined grid of their seasons (an array) by a pattern with {season}, and whether the
    inventory (path) has it."""
    before, after = pattern.split("{season}") if "{season}" in pattern else (pattern, "")
    path = F.concat(F.lit(before), season_label(F.col(seasons)), F.lit(after)) if "{season}" in pattern else F.lit(pattern)
    have = inventory.select("path").distinct().withColumn("exists", F.lit(True))
    return runs.withColumn("path", path).join(have, "path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def chosen(grids: dict[str, Callable[[], DataFrame]], name: str, fallback: str) -> DataFrame:
    """The grid of that name or, if there is none, the fallback."""
    return grids.get(name, grids[fallback])()

"""Points on a grid: placing, filtering, thinning, sampling, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.grid import STUDY, Grid
from terrane.functions.hashing import uniform
from terrane.functions.quota import last_taken, share_of, smallest, take
from terrane.session import staged


def placed(points: DataFrame, grid: Grid = STUDY) -> DataFrame:
    """Adds row and col by floor; a null or NaN coordinate gives a null cell. Points outside the grid keep their numbers."""
    x, y = F.nanvl("x", F.lit(None)), F.nanvl("y", F.lit(None))
    return points.withColumns({"row": grid.row(y), "col": grid.col(x)})


def of_season(points: DataFrame, season: str, year: int) -> DataFrame:
    return points.filter((F.lower("season") == season.lower()) & (F.col("year") == year))


def shifted(points: DataFrame, offsets: DataFrame, key: str = "year") -> DataFrame:
    """points moved by the offsets (key, dx, dy) of their key; a key without offsets leaves them where they are."""
    p = points.join(offsets.select(key, F.col("dx").alias("__dx"), F.col("dy").alias("__dy")), key, "left")
    return p.withColumns({"x": F.col("x") + F.coalesce("__dx", F.lit(0.0)), "y": F.col("y") + F.coalesce("__dy", F.lit(0.0))}).select(*points.columns)


def in_mask(points: DataFrame, mask: DataFrame) -> DataFrame:
    """Points whose cell is in the mask; points outside the grid are not."""
    return points.join(mask.select("row", "col"), ["row", "col"], "left_semi")


def first_per(points: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by a total order; rows equal in it are equal for it."""
    return points.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def without_cells(points: DataFrame, taken: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    return points.join(taken.select(*keys).distinct(), list(keys), "left_anti")


def sampled(points: DataFrame, stack: DataFrame, layers: Sequence[str], keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Each point with the layers of its cell; a point without one keeps its row, with nulls. stack: one row a cell."""
    return points.join(stack.select(*keys, *layers), list(keys), "left")


def thinned_to_grid(points: DataFrame, km: float, order: Sequence[Column | str], also: Sequence[str] = ()) -> DataFrame:
    """One point of each square of km by km kilometres (of each value of `also`), the first by `order`.

    Squares are sorted by a hash first, as a sort that begins with a column of few values compares whole rows.
    """
    keyed = points.withColumns({"__tx": F.floor(F.col("x") / (km * 1000)), "__ty": F.floor(F.col("y") / (km * 1000))})
    keyed = keyed.withColumn("__h", F.hash("__tx", "__ty", *also))
    return first_per(keyed, ["__h", "__tx", "__ty", *also], order).drop("__h", "__tx", "__ty")


def thinned_by_policy(points: DataFrame, policy: DataFrame, keys: Sequence[str], draw: str, tie: Sequence[str], few: int = 3) -> DataFrame:
    """At most max(1, floor(n * share)) points of each key; keys without a share, and groups of up to `few`, are kept.

    policy: (keys, share). draw: a number in [0, 1) for each point, the smallest of a group being kept, in doubt by tie.
    Groups are counted, and cut by the draw, so that one of any size is spread over the cluster.
    """
    n = points.groupBy(*keys).agg(F.count("*").alias("__n"))
    all_ = F.col("share").isNull() | (F.col("share") >= 1) | (F.col("__n") <= few)
    quota = n.join(policy.select(*keys, "share"), list(keys), "left").withColumn("__q", F.when(all_, F.col("__n")).otherwise(F.greatest(F.lit(1), F.floor(F.col("__n") * F.col("share")))))
    return take(points, quota, keys, draw, tie, F.lit(1), "__q")


def equalised(points: DataFrame, key: str, draw: str, tie: Sequence[str]) -> DataFrame:
    """As many points of each key as the smallest has, those of smallest draw."""
    n = points.groupBy(key).agg(F.count("*").alias("__n"))
    least = n.agg(F.min("__n").alias("__least"))
    return take(points, n.join(F.broadcast(least)), [key], draw, tie, F.lit(1), "__least")


def weighted_without_replacement(rows: DataFrame, weight: Column, u: Column, share: float, tie: Sequence[str], least: int = 2) -> DataFrame:
    """max(least, round(share x rows)) rows drawn with probability in proportion to weight: the smallest exponential keys
    -ln(u) / weight; weights of 0, NaN or null never. No more rows than have a weight."""
    key = -F.ln(u) / F.when((weight > 0) & ~F.isnan(weight), weight)
    n = staged(rows.agg(F.greatest(F.lit(least), F.round(F.count("*") * share)).cast("bigint").alias("n")))
    # the key laid into [0, 1) around its own scale, so that cuts of it are filled
    keyed = rows.withColumn("__key", key).filter(F.col("__key").isNotNull())
    scale = F.broadcast(keyed.agg(F.percentile_approx("__key", max(min(share, 1.0), 1e-4), 1000).alias("__scale")))
    # written once, as the cuts are summed before rows are taken
    laid = staged(keyed.join(scale).withColumn("__order", F.col("__key") / (F.col("__key") + F.greatest("__scale", F.lit(1e-300)))).drop("__scale"))
    return smallest(laid, n, "__order", ["__key", *tie]).select(*rows.columns)


def sampled_share(rows: DataFrame, share: float, u: Column, tie: Sequence[str], least: int = 2) -> DataFrame:
    """max(least, round(share x rows)) rows, those of smallest u, a number in [0, 1); all rows if there are fewer."""
    return share_of(staged(rows.withColumn("__order", u)), share, "__order", tie, least).drop("__order")


def with_replacement(cells: DataFrame, weight: Column, n: int, key: Sequence[str], seed: int = 1) -> DataFrame:
    """n draws from the rows with probability in proportion to weight, a row for each draw (`draw`, from 0).

    Each draw is a point on the line of all weights; weights are summed by pieces of the key's hash first, so that a draw
    finds its piece in a small table and its row within that piece. Weights of 0, NaN or null are never drawn. Nothing is
    drawn if there is no weight at all.
    """
    pieces = 256
    w = F.when((weight > 0) & ~F.isnan(weight), weight.cast("double"))
    rows = cells.withColumns({"__w": w, "__p": F.pmod(F.xxhash64(*key), F.lit(pieces)).cast("int")}).filter(F.col("__w").isNotNull())
    sums = rows.groupBy("__p").agg(F.sum("__w").alias("__s"))
    upto = sums.withColumn("__e", F.sum("__s").over(W.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(W.unboundedPreceding, 0)))
    # one row: where each piece (at most `pieces`) ends on the line, so a draw finds its own in it
    line = upto.agg(F.array_sort(F.collect_list(F.struct("__e", "__s", "__p"))).alias("__line"))
    draws = cells.sparkSession.range(n).withColumnRenamed("id", "draw").join(F.broadcast(line)).filter(F.size("__line") > 0)
    at = draws.withColumn("__at", uniform("draw", seed=seed) * F.element_at("__line", -1)["__e"])
    hit = at.withColumn("__h", F.coalesce(F.get(F.filter("__line", lambda p: p["__e"] > F.col("__at")), F.lit(0)), F.element_at("__line", -1)))
    placed = hit.select("draw", F.col("__h.__p").alias("__p"), (F.col("__at") - F.col("__h.__e") + F.col("__h.__s")).alias("__x"))
    # from the end, so that what lies behind a draw is kept as it is passed (a window to the end is summed anew for each row)
    own = W.partitionBy("__p").orderBy(F.desc("__x"), F.desc("__k"), *[F.desc(f"__row.`{c}`") for c in key])
    lines = rows.withColumn("__x", F.sum("__w").over(W.partitionBy("__p").orderBy(*key).rowsBetween(W.unboundedPreceding, 0)))
    kept = F.struct(*[F.col(f"`{c}`") for c in cells.columns]).alias("__row")
    both = lines.select("__p", "__x", F.lit(1).alias("__k"), kept, F.lit(None).cast("bigint").alias("draw"))
    asked = placed.select("__p", "__x", F.lit(0).alias("__k"), F.lit(None).cast(both.schema["__row"].dataType).alias("__row"), "draw")
    found = both.unionByName(asked).withColumn("__row", F.last("__row", ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, 0)))
    return found.filter(F.col("draw").isNotNull() & F.col("__row").isNotNull()).select("draw", "__row.*")


def jittered(cells: DataFrame, grid: Grid, *ids: str, seed: int = 1) -> DataFrame:
    """Adds x and y: a place in the row's cell, uniform by a hash of ids."""
    u, v = uniform(*ids, seed=seed), uniform(*ids, seed=seed + 1)
    return cells.withColumns({"x": F.lit(grid.x0) + F.lit(grid.cell) * (F.col("col") + u), "y": F.lit(grid.top) - F.lit(grid.cell) * (F.col("row") + v)})


def bias_weights(cells: DataFrame, bias: str, strength: float) -> DataFrame:
    """Adds p, in proportion to strength * bias + (1 - strength), a null bias counting as 0; sums to 1, null if all are 0."""
    w = F.greatest(F.lit(0.0), F.lit(float(strength)) * F.coalesce(F.nanvl(bias, F.lit(0.0)), F.lit(0.0)) + (1.0 - strength))
    total = cells.agg(F.sum(w).alias("__total"))
    return cells.join(F.broadcast(total)).withColumn("p", F.try_divide(w, F.col("__total"))).drop("__total")


def leave_one_year_out(points: DataFrame, years: Sequence[int]) -> DataFrame:
    """Each point once for each test year, with the role train or test in that fold."""
    folds = F.explode(F.array(*[F.lit(y) for y in years])).alias("test_year")
    return points.select("*", folds).withColumn("role", F.when(F.col("year") == F.col("test_year"), "test").otherwise("train"))


def block_folds(points: DataFrame, km: float, k: int, order: Column, tie: Sequence[str] = ("bx", "by")) -> DataFrame:
    """Adds fold 1..k: blocks of km by km kilometres in a shuffled order, cut into k parts that differ by one block at most.

    Only the blocks are ranked (as many as the area holds, whatever the number of points); a shuffled order is a hash of
    bx and by.
    """
    keyed = points.withColumns({"bx": F.floor(F.col("x") / (km * 1000)), "by": F.floor(F.col("y") / (km * 1000))})
    blocks = keyed.select("bx", "by").distinct().withColumn("fold", F.ntile(k).over(W.orderBy(order, *tie)))
    return keyed.join(blocks, ["bx", "by"])


def random_folds(points: DataFrame, k: int, draw: Column) -> DataFrame:
    """Adds fold 1..k by where `draw`, a number in [0, 1), falls."""
    return points.withColumn("fold", (F.floor(draw * k) + 1).cast("bigint"))


def stratified_split(rows: DataFrame, strata: Sequence[str], share: float, draw: str, tie: Sequence[str]) -> DataFrame:
    """Adds part: of each stratum of two rows or more, ceil(share * n) rows, those of smallest draw, are test and others
    train. Rows that are equal in all columns go together."""
    n = rows.groupBy(*strata).agg(F.count("*").alias("__n")).withColumn("__q", F.when(F.col("__n") >= 2, F.ceil(F.lit(share) * F.col("__n"))).otherwise(0))
    ends = last_taken(rows, n, strata, draw, tie, "__q")
    mine = F.struct(draw, *tie)
    return rows.join(ends, list(strata), "left").withColumn("part", F.when(mine <= F.col("__last"), "test").otherwise("train")).drop("__last")


def _whitening(n: int, mean, cov):
    """A matrix that turns features less their means into ones whose distances are Mahalanobis distances."""
    import numpy as np

    # fixed value: 1e-6 keeps a covariance of no spread invertible
    values, vectors = np.linalg.eigh(np.atleast_2d(cov) + 1e-6 * np.eye(len(mean)))
    return vectors / np.sqrt(np.where(values <= 0, 1e-6, values))


def _greedy(x, target: int, leaf: int = 512):
    """The places of `target` rows of x, as a greedy walk chooses them: it starts at the first row and adds the row farthest
    from those chosen, of equally far ones the first. A row is chosen once. target: no more than there are rows.

    Rows lie in boxes of up to `leaf`, and a step looks only into boxes to which the new row can be nearer than their farthest
    row is to those chosen; to all others it makes no difference, as a distance to a box is none larger than one to its rows.
    """
    import numpy as np

    parts, boxes = [np.arange(len(x))], []
    while parts:
        p = parts.pop()
        if len(p) <= leaf:
            boxes.append(np.sort(p))
            continue
        own = x[p]
        cut = np.argpartition(own[:, int((own.max(0) - own.min(0)).argmax())], len(p) // 2)
        parts += [p[cut[: len(p) // 2]], p[cut[len(p) // 2 :]]]
    order, ends = np.concatenate(boxes), np.cumsum([len(p) for p in boxes])
    starts = ends - [len(p) for p in boxes]
    cols = [np.ascontiguousarray(x[order, j]) for j in range(x.shape[1])]
    low, high = [np.minimum.reduceat(c, starts) for c in cols], [np.maximum.reduceat(c, starts) for c in cols]
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    box = np.repeat(np.arange(len(boxes)), [len(p) for p in boxes])
    spans = list(zip(starts.tolist(), ends.tolist()))
    # squared distance to the nearest chosen row, below 0 for chosen ones; the largest of each box and whose it is
    near, far, whose = np.full(len(x), np.inf), np.full(len(boxes), np.inf), np.zeros(len(boxes), np.int64)
    chosen, row = [], 0
    while True:
        chosen.append(row)
        if len(chosen) >= target:
            return np.array(chosen)
        at = x[row].tolist()
        gap = np.zeros(len(boxes))
        for lo, hi, c in zip(low, high, at):
            gap += np.maximum(np.maximum(lo - c, c - hi), 0.0) ** 2
        mine = int(box[place[row]])
        near[place[row]] = -1.0
        hit = gap < far
        hit[mine] = True
        for k in np.flatnonzero(hit).tolist():
            i, j = spans[k]
            d = np.zeros(j - i)
            for col, c in zip(cols, at):
                d += (col[i:j] - c) ** 2
            v = near[i:j]
            np.minimum(v, d, out=v)
            top = int(v.argmax())
            far[k], whose[k] = v[top], order[i + top]
        row = int(whose[far == far.max()].min())


def _spread(x, target: int):
    """Places of `target` rows of features, the rows being in order of their key; missing features take the mean."""
    import numpy as np

    mean = np.nan_to_num(np.nanmean(np.where(np.isnan(x).all(0), 0.0, x), 0))
    x = np.where(np.isnan(x), mean, x) - mean
    return _greedy(x @ _whitening(len(x), mean, np.cov(x, rowvar=False)), target)


def farthest_points(points: DataFrame, keys: Sequence[str], features: Sequence[str], key: str, share: float, largest: int = 50_000, batch: int = 2000, held: int = 4_000_000) -> DataFrame:
    """Of each group, max(1, floor(n * share)) points spread most widely by Mahalanobis distance.

    Missing features take the group's mean; distances are those after whitening by the group's covariance. The walk starts
    at the smallest key and adds the point farthest from those chosen, of equally far ones that of smallest key, then of
    smallest features; points are counted one by one, even if they are equal in all. A group of up to `largest` points is
    one task, which holds its rows. Of one of up to `held` a task holds the key, the features and some numbers of each point,
    and the rows are looked up. A larger one is walked over the cluster (`_walked`). All have the same result.
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    import pyarrow.compute as pc

    schema = points.schema
    # written once, so that a point keeps its number
    rows = staged(points.withColumn("__row", F.monotonically_increasing_id()))
    sizes = staged(rows.groupBy(*keys).agg(F.count("*").alias("__n")))
    large = sizes.filter(F.col("__n") > largest).collect()  # few, as each stands for so many points
    whole = rows.drop("__row")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, *features], kind="stable").reset_index(drop=True)
        target = max(1, int(len(pdf) * share))
        if target >= len(pdf):
            return pdf
        return pdf.iloc[np.sort(_spread(pdf[list(features)].to_numpy(float), target))]

    if not large:
        return whole.groupBy(*keys).applyInPandas(walk, schema)

    def numbers(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, [("__k", "ascending"), *[(f"__f{i}", "ascending") for i in range(len(features))]]).to_numpy()
        x = np.column_stack([group.column(f"__f{i}").to_numpy()[order] for i in range(len(features))])
        taken = _spread(x, max(1, int(len(x) * share)))
        return pa.table({"__row": group.column("__row").to_numpy()[order[taken]]})

    def of(groups: DataFrame, frame: DataFrame) -> DataFrame:
        named = groups.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)])
        return frame.join(named, [F.col(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)], "left_semi")

    out = of(sizes.filter(F.col("__n") <= largest), whole).groupBy(*keys).applyInPandas(walk, schema)
    if any(g["__n"] <= held for g in large):
        value = [F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f"__f{i}") for i, f in enumerate(features)]
        sent = of(sizes.filter((F.col("__n") > largest) & (F.col("__n") <= held)), rows).select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)], F.col(key).alias("__k"), *value, "__row")
        found = staged(sent.groupBy(*[f"__g{i}" for i in range(len(keys))]).applyInArrow(numbers, "__row bigint"))
        out = out.unionByName(rows.join(found, "__row", "left_semi").select(*points.columns))
    for group in large:
        if group["__n"] > held:
            own = rows
            for k in keys:
                own = own.filter(F.col(k).eqNullSafe(F.lit(group[k])))
            out = out.unionByName(_walked(own, features, key, max(1, int(group["__n"] * share)), batch).select(*points.columns))
    return out


def _walked(points: DataFrame, features: Sequence[str], key: str, target: int, batch: int) -> DataFrame:
    """`target` points of one group of any size, as a greedy walk chooses them. points: with `__row`, a number of each.

    Each pass sends the `batch` points farthest from those chosen to the driver. As distances only fall, the farthest of
    them is the farthest of all while it is farther than the last of the batch was, so many steps are made a pass; then
    all points' distances to the ones chosen in it are taken, and what was chosen is written.
    """
    import numpy as np
    import pyarrow as pa

    from terrane.operators.collinear import product_sums

    spark = points.sparkSession
    value = {f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features}
    mean = np.nan_to_num(np.array([v if v is not None else 0.0 for v in points.agg(*[F.avg(v) for v in value.values()]).first()], float))
    rows = points.select(F.col(key).alias("k"), F.col("__row").alias("r"), *[F.coalesce(v, F.lit(float(m))).alias(f"f{i}") for i, (v, m) in enumerate(zip(value.values(), mean))])
    names = [f"f{i}" for i in range(len(features))]
    n, s, p = product_sums(rows, names, mean)
    turn = _whitening(n, mean, (p - np.outer(s, s) / max(n, 1)) / max(n - 1, 1))
    kind = rows.schema["k"].dataType.simpleString()

    def taken(frame: DataFrame, found: np.ndarray) -> DataFrame:
        """(k, r, f.., d): d the squared distance to the nearest of all chosen so far."""
        sent = spark.sparkContext.broadcast(found)

        def run(it):
            for b in it:
                x = np.column_stack([b.column(2 + i).to_numpy() for i in range(len(names))])
                d = b.column(2 + len(names)).to_numpy().copy()
                for c in sent.value:
                    d = np.minimum(d, ((x - c) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*b.columns[: 2 + len(names)], pa.array(d)], names=["k", "r", *names, "d"])

        return staged(frame.mapInArrow(run, ", ".join([f"k {kind}", "r bigint", *[f"{x} double" for x in names], "d double"])))

    # equal keys in order of the features themselves, as tasks that hold a group have them
    plain = [f"o{i}" for i in range(len(names))]
    white = rows.select("k", "r", *[sum(((F.col(f) - F.lit(float(m))) * F.lit(float(turn[i, j])) for i, (f, m) in enumerate(zip(names, mean))), F.lit(0.0)).alias(names[j]) for j in range(len(names))], F.lit(float("inf")).alias("d"))
    start = rows.select("k", "r", *[F.col(f).alias(o) for f, o in zip(names, plain)]).orderBy("k", *plain, "r").limit(1).select("r").first().r
    first = white.filter(F.col("r") == F.lit(start)).collect()[0]
    chosen = [start]
    state = taken(white.filter(F.col("r") != F.lit(start)), np.array([[first[x] for x in names]]))
    while len(chosen) < target:
        top = state.orderBy(F.desc("d"), "k", "r").limit(batch).collect()
        if not top:
            break
        x, d = np.array([[r[f] for f in names] for r in top]), np.array([r.d for r in top])
        floor = d[-1] if len(top) == batch else -1.0
        step = []
        while len(chosen) < target:
            far = int(d.argmax())
            if step and d[far] <= floor:
                break
            if d[far] < 0:
                break
            step.append(far)
            chosen.append(top[far].r)
            d = np.minimum(d, ((x - x[far]) ** 2).sum(1))
            d[far] = -1.0
        if len(chosen) < target:
            state = taken(state, x[step])
            state = state.filter(~F.col("r").isin([top[i].r for i in step])) if len(step) <= 100 else state.join(F.broadcast(spark.createDataFrame([(top[i].r,) for i in step], "r bigint")), "r", "left_anti").select("k", "r", *names, "d")
    return points.join(spark.createDataFrame([(r,) for r in chosen], "__row bigint"), "__row", "left_semi")


def crowding_weights(points: DataFrame, cell: float) -> DataFrame:
    """Adds weight: one over the number of points in the 3 by 3 neighbourhood of the point's square, so that crowded places
    count less; the mean weight is 1. Squares are counted first, so no point meets another."""
    keyed = points.withColumns({"__cx": F.floor(F.col("x") / cell), "__cy": F.floor(F.col("y") / cell)})
    counts = keyed.groupBy("__cx", "__cy").agg(F.count("*").alias("__n"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = counts.select("__cx", "__cy", "__n", F.inline(steps)).groupBy((F.col("__cx") + F.col("i")).alias("__cx"), (F.col("__cy") + F.col("j")).alias("__cy")).agg(F.sum("__n").alias("__near"))
    raw = keyed.join(around, ["__cx", "__cy"]).withColumn("weight", 1.0 / F.col("__near"))
    mean = counts.join(around, ["__cx", "__cy"]).agg((F.sum(F.col("__n") / F.col("__near")) / F.sum("__n")).alias("__mean"))
    return raw.join(F.broadcast(mean)).withColumn("weight", F.col("weight") / F.col("__mean")).drop("__cx", "__cy", "__near", "__mean")


def neighbour_weights(points: DataFrame, key: str, x: str, y: str, k: int, cell: float) -> DataFrame:
    """(key, distance, weight): the mean distance of each point to its k nearest others (all others if there are fewer; 0
    without any), and that over its mean, so that points in crowded places count less. Points without a place have no row.

    Points of one place are taken together. A place looks at the places of its own and the neighbouring cells; if these
    hold k points no further off than a cell is wide, they are its nearest, else it goes on to cells of twice the width,
    until a cell spans all places. Each round is a join on cells, and of the pairs in it only the k nearest are kept.
    """
    known = points.select(F.col(key), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).dropna().filter(~F.isnan("__x") & ~F.isnan("__y"))
    places = staged(known.groupBy("__x", "__y").agg(F.count("*").alias("__n")))
    ends = places.agg(F.greatest(F.max("__x") - F.min("__x"), F.max("__y") - F.min("__y")).alias("span"), F.sum("__n").alias("n")).first()
    span, most = ends.span or 0.0, min(k, (ends.n or 1) - 1)
    left, width, done = places, float(cell), []
    while True:
        last = width >= span or most <= 0
        at = lambda c: F.floor(F.col(c) / F.lit(width))  # noqa: B023, E731
        steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        look = left.select("__x", "__y", F.inline(steps)).select("__x", "__y", (at("__x") + F.col("i")).alias("cx"), (at("__y") + F.col("j")).alias("cy"))
        there = places.select(F.col("__x").alias("x2"), F.col("__y").alias("y2"), F.col("__n").alias("n2"), at("__x").alias("cx"), at("__y").alias("cy"))
        # the point itself is none of the others of its place
        d = F.sqrt(F.pow(F.col("__x") - F.col("x2"), 2) + F.pow(F.col("__y") - F.col("y2"), 2))
        pairs = look.join(there, ["cx", "cy"]).select("__x", "__y", "x2", "y2", d.alias("d"), F.when(d == 0, F.col("n2") - 1).otherwise(F.col("n2")).alias("n2"))
        w = W.partitionBy("__x", "__y").orderBy("d", "x2", "y2")
        near = pairs.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k + 1)
        upto = F.sum("n2").over(w.rowsBetween(W.unboundedPreceding, 0))
        near = near.withColumn("__take", F.greatest(F.lit(0), F.least(F.col("n2"), F.lit(most) - (upto - F.col("n2")))))
        near = near.groupBy("__x", "__y").agg(F.sum("__take").alias("__got"), F.max(F.when(F.col("__take") > 0, F.col("d"))).alias("__far"), F.sum(F.col("__take") * F.col("d")).alias("__sum"))
        near = staged(near.withColumn("__ok", F.lit(last) | ((F.col("__got") >= most) & (F.col("__far") <= width))))
        done.append(near.filter("__ok").select("__x", "__y", F.coalesce(F.try_divide(F.col("__sum"), F.col("__got")), F.lit(0.0)).alias("distance")))
        if last:
            break
        left = near.filter(~F.col("__ok")).select("__x", "__y")
        if left.isEmpty():
            break
        width *= 2
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    own = known.join(found, ["__x", "__y"]).select(key, "distance")
    mean = own.agg(F.avg("distance").alias("__mean"))
    return own.join(F.broadcast(mean)).select(key, "distance", F.coalesce(F.try_divide("distance", "__mean"), F.lit(1.0)).alias("weight"))


def thinned_if_known(points: DataFrame, keys: Sequence[str], features: Sequence[str], key: str, share: float) -> DataFrame:
    """`farthest_points`, or all points if some feature is known nowhere."""
    known = points.agg(*[F.count(f).alias(f) for f in features]).first()
    if not features or not all(known[f] for f in features):
        return points
    return farthest_points(points, keys, features, key, share)

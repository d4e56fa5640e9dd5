"""A sample whose categories match target shares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import quota
from terrane.functions.hashing import uniform
from terrane.functions.text import folded
from terrane.session import staged

#: Rows of the target table that the driver rakes at most; it is a parameter table, and beyond that an error.
MAX_CELLS = 200_000


def rake(have: np.ndarray, target: np.ndarray, margins: list[np.ndarray], rounds: int = 200, near: float = 1e-10, size: int | None = None, least: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Shares of the cells by iterative proportional fitting, and the largest gap left in a margin.

    Starts from the observed shares (the counts `have`), which are fitted to the cells' own targets first, the finest
    margin, and then in turn to each coarser margin's until these hold; margins: for each category the number of the value
    a cell has. A value none of whose cells has rows can't be met: its share goes to the others, and the gap is returned.
    With the size of a sample, no cell's share exceeds the rows it has nor falls below `least` rows, and what a cell lacks
    goes to others of its values.
    """
    n = max(float(have.sum()), 1.0)
    low, high = np.zeros(len(have)), np.where(have > 0, np.inf, 0.0)
    if size:
        high = have / size
        low = np.minimum(np.zeros(len(have)) if least is None else least / size, high)
    cells = np.arange(len(have))
    fits = [(m, np.bincount(m, target)) for m in (cells, *margins)]

    def fitted(share: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
        now = np.bincount(m, share, len(w))
        return np.clip(share * np.divide(w, now, out=np.zeros_like(w), where=now > 0)[m], low, high)

    share = fitted(have / n, *fits[0])
    if not share.sum():
        return share, float(target.max(initial=0.0))
    for _ in range(rounds):
        before = share.copy()
        for m, w in fits[1:]:
            share = fitted(share, m, w)
        share = np.clip(share / max(share.sum(), 1e-300) * target.sum(), low, high)
        if np.abs(share - before).max() < near:
            break
    return share, max((float(np.abs(np.bincount(m, share, len(w)) - w).max()) for m, w in fits[1:]), default=0.0)


def whole(share: np.ndarray, have: np.ndarray, least: np.ndarray, size: int) -> np.ndarray:
    """Whole rows of each cell near share x size, from least to have, `size` together as far as these allow.

    Running totals are rounded, so that neighbouring cells (those of one source) are off by less than a row together.
    """
    least, most = np.minimum(least, have), np.where(share > 0, have, np.minimum(least, have))
    f = [0.0, 1.0]
    at = lambda x: np.clip(share * size * x, least, most)
    while at(f[1]).sum() < min(size, most.sum()) and f[1] < 1e18:
        f[1] *= 2
    for _ in range(100):
        mid = sum(f) / 2
        f = [mid, f[1]] if at(mid).sum() < size else [f[0], mid]
    upto = np.floor(np.cumsum(at(f[1])) + 0.5)
    return np.clip(np.diff(upto, prepend=0.0), least, most).astype(np.int64)


def minima(least: np.ndarray, per: np.ndarray, have: np.ndarray, size: int) -> np.ndarray:
    """Rows each cell gets at least: what it needs, or what there is of that.

    If that is more than the sample has, shares are rounded down, and then only the targets' own minima hold.
    """
    for share in (-(-per * size // 10000), per * size // 10000):
        rows = np.minimum(np.maximum(least, share), have)
        if rows.sum() <= size:
            return rows
    return np.minimum(least, have)


def counted(points: DataFrame, cells: DataFrame, key: str, year: str, seed: int = 1) -> DataFrame:
    """(key, __cell, __u) of each point that counts, one row a key, written once: its cell's number and a random number.

    cells: (__cell, source, semester); a key that is in several counts in the first of them."""
    t = cells.select("__cell", folded("source").alias("__s"), folded("semester").alias("__p"))
    p = points.filter(F.col(key).isNotNull()).select(key, folded("source").alias("__s"), folded("semester").alias("__p"), F.col(year).cast("int").alias("__y"))
    own = F.regexp_extract("__p", r"^([0-9]{4})", 1).try_cast("int") == F.col("__y")
    return staged(p.filter(own).join(t, ["__s", "__p"]).groupBy(key).agg(F.min("__cell").alias("__cell")).withColumn("__u", uniform(key, seed=seed)))


def sample(points: DataFrame, targets: DataFrame, key: str = "occ_id", year: str = "year-int", divisor: int = 4, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of a draw of S = floor(points that count / divisor) rows with the target shares by source and semester.

    A point counts once for its key, if source and semester, without outer blanks and regardless of case, are a row of
    targets and `year` is the semester's year; nulls never match. In steps:

    1. The observed counts of the cells are raked to the targets, and to the margins of source, semester and year (`rake`);
       a cell's weight is its share of the sample over the rows it has.
    2. The S points of smallest exponential keys, -ln(u) over the rate at which a point of its weight is drawn, are drawn.
    3. Rows drawn are counted by cell. A cell below its need (the larger of min_rows and the share of the sample, rounded up)
       is lifted to it by its next keys, as far as it has rows; these too are counted, and what is still missing is the
       gap: a cell with one is `unmet`.
    4. Cells over their raked rows give up those of largest key, and cells under them get their next, so that S rows stay
       and the margins hold; none falls below its minimum. If needs are more than S, see `minima`; if min_rows alone are,
       the sample grows by what they are over.

    sample: key, source, semester, weight. report: for each row of targets the rows there are, needed, drawn (step 2),
    repaired (step 3) and in the sample (step 4), the gap, and unmet; `margin_gap` is how far the sample's shares are off
    the target (of all targets' sum) in the worst source, semester or year. An empty table gives an empty sample and a
    report in which every row of positive need is unmet.

    Only counts of cells (as many as rows of targets, MAX_CELLS at most) reach the driver. Keys are cut and summed, and
    points of any number are ranked only in the cut where the rows end.
    """
    spark = points.sparkSession
    told = targets.select("source", "semester", "target_per_10k", "min_rows").dropDuplicates(["source", "semester"]).limit(MAX_CELLS + 1).collect()
    if len(told) > MAX_CELLS:
        raise ValueError(f"targets have more than {MAX_CELLS} rows")
    told = sorted(told, key=lambda r: (str(r.source), str(r.semester)))
    cells = spark.createDataFrame([(i, r.source, r.semester) for i, r in enumerate(told)], "__cell int, source string, semester string")
    own = counted(points, cells, key, year, seed)

    def by_cell(rows: DataFrame) -> np.ndarray:
        """At most as many rows as targets."""
        out = np.zeros(len(told), np.int64)
        for r in rows.groupBy("__cell").agg(F.count("*").alias("n")).collect():
            out[r[0]] = r.n
        return out

    have = by_cell(own)
    per = np.array([r.target_per_10k or 0 for r in told], np.int64)
    size = int(have.sum()) // divisor
    least = np.array([r.min_rows or 0 for r in told], np.int64)
    need = np.maximum(least, -(-per * size // 10000))
    target = per / max(int(per.sum()), 1)
    place = lambda values: np.unique(np.array([str(v) for v in values]), return_inverse=True)[1]
    margins = [place(r.source for r in told), place(r.semester for r in told), place(str(r.semester).strip()[:4] for r in told)] if told else []
    floor = minima(least, per, have, size)
    share = rake(have, target, margins, size=size, least=floor)[0] if size else np.zeros(len(told))
    raked = whole(share, have, floor, size) if size else np.minimum(floor, have)

    weight = np.clip(np.divide(share * size, have, out=np.zeros(len(told)), where=have > 0), 0.0, 1.0)
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weight)], "__cell int, weight double")
    # a point of weight w has an exponential key of at most 1 with probability w: its rate is -ln(1 - w)
    rate = F.greatest(-F.ln(F.greatest(F.lit(1e-12), 1 - F.col("weight"))), F.lit(1e-12))
    keyed = own.join(weights, "__cell").withColumn("__order", -F.ln("__u") / (rate - F.ln("__u")))  # key / (key + 1)

    def of_each(rows: DataFrame, n: np.ndarray) -> DataFrame:
        """The rows of smallest key of each cell, so many."""
        quotas = spark.createDataFrame([(i, int(x)) for i, x in enumerate(n)], "__cell int, __n bigint")
        return quota.take(rows, quotas, ["__cell"], "__order", [key], F.lit(1), "__n")

    none = np.zeros(len(told), np.int64)
    drawn = by_cell(quota.smallest(keyed.filter("weight > 0"), size, "__order", [key])) if size else none
    # what the lifting and the margins ask of each cell; about as many rows as the sample has
    lifted = staged(of_each(keyed, np.maximum(np.maximum(drawn, need), raked)).select(key, "__cell", "weight", "__order"))
    repaired = np.minimum(by_cell(lifted), np.maximum(drawn, need)) if size else none
    gap = need - np.minimum(repaired, need)
    chosen = staged(of_each(lifted, raked).join(cells, "__cell").select(key, "source", "semester", "weight", "__cell"))
    rows = by_cell(chosen)
    reached = rows / max(int(rows.sum()), 1)
    worst = max((float(np.abs(np.bincount(m, reached) - np.bincount(m, target)).max()) for m in margins), default=0.0)
    report = spark.createDataFrame(
        [(r.source, r.semester, int(p), int(n), int(h), int(d), int(k), int(x), int(g), bool(g > 0), float(worst)) for r, p, n, h, d, k, x, g in zip(told, per, need, have, drawn, repaired, rows, gap)],
        "source string, semester string, target_per_10k bigint, needed bigint, available bigint, drawn bigint, repaired bigint, rows bigint, gap bigint, unmet boolean, margin_gap double",
    )
    return chosen.drop("__cell"), report

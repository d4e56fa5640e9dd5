"""Points near other points, and points in regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.session import staged

#: Fixed value: mean radius of the earth in metres.
EARTH_M = 6371008.8


def one_version(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """One row for each non-null key, that of the latest `order`; rows equal in it are told apart by their values."""
    best = F.max(F.struct(order, *columns)).alias("__v")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"__v.{c}").alias(c) for c in columns])


def planar(dx: Column, dy: Column, radius: float) -> Column:
    return dx * dx + dy * dy <= F.lit(float(radius) ** 2)


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two places given in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * F.lit(EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def near_places(places: DataFrame, radius: float) -> DataFrame:
    """(x, y, s, x2, y2, bs) of places of different kind s at most `radius` apart, each pair of places once.

    places: distinct (x, y, s). Cells as wide as the radius are paired with the neighbouring cells of other kinds, so a cell
    of a single kind costs its places once; of two kinds the one in fewer cells looks around. No place is copied to cells of
    which none needs it. As a result of its own, with the points of each place as membership, this is what a crowd of
    points at few places should be kept as.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius)))
    places = staged(places.withColumns({"cx": cell("x"), "cy": cell("y")}))
    cells = places.select("cx", "cy", "s").distinct()
    # of two kinds the one in fewer cells looks around, so that the commonest never does
    size = cells.groupBy("s").agg(F.count("*").alias("n"))
    most = size.agg(F.max(F.struct("n", "s")).alias("most"))
    cells = cells.join(size.join(F.broadcast(most)), "s")
    step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = cells.filter(F.struct("n", "s") < F.col("most")).select(F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("s").alias("bs"), F.col("n").alias("bn"), F.inline(step)).withColumns({"cx": F.col("bx") + F.col("i"), "cy": F.col("by") + F.col("j")}).drop("i", "j")
    meet = cells.join(around, ["cx", "cy"]).filter(F.struct("n", "s") > F.struct(F.col("bn").alias("n"), F.col("bs").alias("s"))).select("cx", "cy", "s", "bx", "by", "bs")
    there = places.select(F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("s").alias("bs"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return places.join(meet, ["cx", "cy", "s"]).join(there, ["bx", "by", "bs"]).filter(planar(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"), radius)).select("x", "y", "s", "x2", "y2", "bs")


def near_places_on_earth(places: DataFrame, radius: float) -> DataFrame:
    """(x, y, s, x2, y2, bs) as `near_places`, x and y being degrees of longitude and latitude and the distance that of the
    great circle, in metres. Across the date line and at the poles, too.

    Cells are bands of latitude as high as the radius, cut into longitudes as wide as the radius is at the band's edge
    nearest to a pole (a single one around the pole). A place looks into the bands next to its own, at the longitudes that
    its circle can reach there, and the distance is verified.
    """
    high = float(radius) / EARTH_M * 180 / 3.141592653589793 * (1 + 1e-9)  # degrees of latitude
    band = lambda y: F.floor(F.col(y) / F.lit(high))
    # cells around the earth in a band: none narrower than what the circle spans at its widest, at the band's inner edge
    pole = lambda b: F.least(F.lit(90.0), F.greatest(F.abs(b), F.abs(b + 1)) * F.lit(high) + F.lit(high))
    # (a circle that holds the pole spans all longitudes)
    sine, cosine = F.sin(F.radians(F.lit(high))), lambda b: F.cos(F.radians(pole(b)))
    cells = lambda b: F.when(sine >= cosine(b), 1).otherwise(F.greatest(F.lit(1), F.floor(F.lit(360.0) / F.degrees(F.asin(F.least(F.lit(1.0), sine / cosine(b))))))).cast("bigint")
    at = lambda x, b: F.pmod(F.floor((x + 180) / 360 * cells(b)), cells(b))
    p = places.withColumn("b", band("y"))
    there = p.select("x", "y", "s", "b", at(F.col("x"), F.col("b")).alias("c"))
    look = p.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("s").alias("bs"), F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(F.floor((F.col("x2") + 180) / 360 * cells(F.col("b"))) + k, cells(F.col("b")))))
    look = look.select("x2", "y2", "bs", "b", F.explode(near).alias("c"))
    # each pair from one side only
    one = F.struct("bs", "x2", "y2") > F.struct(F.col("s").alias("bs"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    close = great_circle(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")) <= F.lit(float(radius))
    return there.join(look, ["b", "c"]).filter((F.col("s") != F.col("bs")) & one & close).select("x", "y", "s", "x2", "y2", "bs")


def near_pairs(points: DataFrame, key: str, x: str, y: str, kind: str, radius: float, degrees: bool = False) -> DataFrame:
    """Every pair (a, b) of keys, a < b, of points of different kind at most `radius` apart, each pair once.

    points: one row for each key; rows with a null or NaN in any of the columns don't take part. Distances are straight
    lines or, with degrees (x longitude, y latitude), great circles in metres. Points of one place and kind are first taken
    together, so a crowded place costs once and not the square of its points; distances are verified between places before
    their points are paired.
    """
    # written once, as points are asked for their places and again for the pairs' members
    p = staged(points.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(kind).alias("s")).dropna())
    places = p.select("x", "y", "s").distinct()
    close = near_places_on_earth(places, radius) if degrees else near_places(places, radius)
    other = p.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("s").alias("bs"), F.col("k").alias("k2"))
    pairs = close.join(p, ["x", "y", "s"]).join(other, ["x2", "y2", "bs"])
    return pairs.select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b"))


#: Cells along the longer side of a region at most.
ALONG = 64


def in_regions(points: DataFrame, x: str, y: str, regions: DataFrame, region: str, ring: str, cell: float) -> DataFrame:
    """points with the region that contains each of them; a point in several regions gives a row for each, in none no row.

    regions: `ring` is an array of structs (x, y), the corners of a simple polygon in order. A region is laid out over
    cells of `cell` or, if it is longer than ALONG of them, of twice, four times ... that, so that it has at most ALONG x
    ALONG cells whatever its size; a point is looked up once for each size of cell in use. A cell that no edge passes is
    all inside and has no edges to test, or isn't kept; others have the edges of their row, and the even-odd rule decides.
    A point on an upper or right edge is outside.
    """
    r = F.col(ring)
    edges = F.transform(F.sequence(F.lit(1), F.size(r)), lambda i: F.struct(F.element_at(r, i).alias("p"), F.element_at(r, F.when(i == F.size(r), 1).otherwise(i + 1)).alias("q")))
    along = {f: F.transform(r, lambda c: c["x"] if f == "x" else c["y"]) for f in ("x", "y")}
    ends = {n: pick(along[f]) for n, pick, f in (("__x0", F.array_min, "x"), ("__x1", F.array_max, "x"), ("__y0", F.array_min, "y"), ("__y1", F.array_max, "y"))}
    sound = regions.filter(F.size(r) >= 3).select(F.col(region).alias("__r"), edges.alias("__e"), *[c.alias(n) for n, c in ends.items()])
    longest = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0"))
    sound = sound.withColumn("__l", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(longest, F.lit(float(cell))) / F.lit(float(cell) * ALONG)))).cast("int")).withColumn("__w", F.lit(float(cell)) * F.pow(F.lit(2.0), "__l"))
    span = lambda a, z: F.sequence(F.floor(F.col(a) / F.col("__w")), F.floor(F.col(z) / F.col("__w")))
    rows = sound.select("*", F.explode(span("__y0", "__y1")).alias("__cy"))
    low, high = F.col("__cy") * F.col("__w"), (F.col("__cy") + 1) * F.col("__w")
    rows = rows.withColumn("__e", F.filter("__e", lambda e: (F.least(e.p.y, e.q.y) < high) & (F.greatest(e.p.y, e.q.y) >= low)))
    cover = rows.select("__r", "__l", "__w", "__cy", "__e", F.explode(span("__x0", "__x1")).alias("__cx"))
    left, right = F.col("__cx") * F.col("__w"), (F.col("__cx") + 1) * F.col("__w")
    passed = F.exists("__e", lambda e: (F.least(e.p.x, e.q.x) <= right) & (F.greatest(e.p.x, e.q.x) >= left))

    def inside(px: Column, py: Column) -> Column:
        crosses = lambda e: ((e.p.y > py) != (e.q.y > py)) & (px < (e.q.x - e.p.x) * (py - e.p.y) / F.nullif(e.q.y - e.p.y, F.lit(0.0)) + e.p.x)
        return F.size(F.filter("__e", crosses)) % 2 == 1

    middle = inside(left + F.col("__w") / 2, low + F.col("__w") / 2)
    cover = cover.withColumn("__full", ~passed).filter(~F.col("__full") | middle).withColumn("__e", F.when(~F.col("__full"), F.col("__e")))
    px, py = F.col(x), F.col(y)
    levels = sorted(row[0] for row in sound.select("__l").distinct().collect())  # a few numbers, whatever the number of regions
    if not levels:
        return points.limit(0).withColumn(region, F.lit(None).cast(regions.schema[region].dataType))
    keyed = points.filter(px.isNotNull() & py.isNotNull() & ~F.isnan(px) & ~F.isnan(py)).withColumn("__l", F.explode(F.array(*[F.lit(n) for n in levels])))
    width = F.lit(float(cell)) * F.pow(F.lit(2.0), "__l")
    keyed = keyed.withColumns({"__cx": F.floor(px / width), "__cy": F.floor(py / width)})
    return keyed.join(cover.drop("__w"), ["__l", "__cx", "__cy"]).filter(F.col("__full") | inside(px, py)).select(*points.columns, F.col("__r").alias(region))

import math
import random

from pyspark.sql import functions as F

from terrane.operators import proximity


def test_pairs_match_brute_force(spark):
    r = random.Random(3)
    rows = [(i, r.choice([0.0, 50.0, 100.0, r.randrange(-800, 800) / 4]), r.randrange(-800, 800) / 4, r.choice("abcd")) for i in range(600)]
    rows += [(1000 + i, 10.0, 10.0, "a") for i in range(40)] + [(2000 + i, 10.0, 10.0, "b") for i in range(3)] + [(9001, None, 1.0, "a"), (9002, 1.0, 1.0, None)]
    p = spark.createDataFrame(rows, "occ long, px double, py double, src string").withColumns({"x": F.lit("clash"), "cx": F.lit(7)})
    got = [tuple(t) for t in proximity.near_pairs(p, "occ", "px", "py", "src", 50.0).collect()]
    known = [t for t in rows if None not in t]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(known) for b in known[:i] if a[3] != b[3] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 2500}
    assert len(got) == len(set(got)) and set(got) == want
    assert proximity.near_pairs(p.limit(0), "occ", "px", "py", "src", 50.0).count() == 0


def test_one_version_takes_the_latest(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (None, 9, "c"), (2, None, None)], "k long, t int, v string")
    assert {tuple(r) for r in proximity.one_version(d, "k", "t", "v").collect()} == {(1, "b"), (2, None)}


def test_regions(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 4.0), (0.0, 10.0)]
    regions = spark.createDataFrame([("m", [{"x": x, "y": y} for x, y in ring]), ("line", [{"x": 0.0, "y": 0.0}] * 2), ("none", None)], "region string, ring array<struct<x: double, y: double>>")
    r = random.Random(1)
    pts = [(i, r.uniform(-2, 12), r.uniform(-2, 12)) for i in range(400)]

    def inside(x, y):
        hit = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    p = spark.createDataFrame(pts + [(999, None, 1.0), (998, math.nan, 1.0)], "id long, x double, y double")
    got = {x.id for x in proximity.in_regions(p, "x", "y", regions, "region", "ring", 3.0).collect()}
    assert got == {i for i, x, y in pts if inside(x, y)}
    # cells far smaller than the region, which then takes larger ones, beside a small region that keeps them
    both = regions.unionByName(spark.createDataFrame([("small", [{"x": 1.0, "y": 1.0}, {"x": 1.5, "y": 1.0}, {"x": 1.5, "y": 1.5}, {"x": 1.0, "y": 1.5}])], regions.schema))
    got = {(x.id, x.region) for x in proximity.in_regions(p, "x", "y", both, "region", "ring", 0.01).collect()}
    assert got == {(i, "m") for i, x, y in pts if inside(x, y)} | {(i, "small") for i, x, y in pts if 1 <= x < 1.5 and 1 <= y < 1.5}
    assert proximity.in_regions(p, "x", "y", regions.limit(0), "region", "ring", 1.0).columns == ["id", "x", "y", "region"]


def test_great_circle(spark):
    d = spark.range(1).select(proximity.great_circle(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0)).alias("d")).first().d
    assert abs(d - math.pi / 2 * proximity.EARTH_M) < 1e-3


def test_pairs_on_earth_match_brute_force(spark):
    r = random.Random(9)
    rows = [(r.uniform(178, 180) * r.choice([-1, 1]), r.uniform(-1, 1)) for _ in range(150)]  # about the date line
    rows += [(r.uniform(-180, 180), r.choice([-1, 1]) * r.uniform(88.5, 90)) for _ in range(200)]  # about the poles
    rows += [(r.uniform(2, 4), r.uniform(44, 46)) for _ in range(150)]
    rows = [(i, x, y, r.choice("ab")) for i, (x, y) in enumerate(rows)] + [(9000, 10.0, 10.0, "a"), (9001, 10.0, 10.0, "b"), (9002, None, 1.0, "a")]

    def metres(a, b):
        x1, y1, x2, y2 = map(math.radians, (a[1], a[2], b[1], b[2]))
        h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
        return 2 * proximity.EARTH_M * math.asin(min(1, math.sqrt(h)))

    p = spark.createDataFrame(rows, "id long, lon double, lat double, src string")
    known = [t for t in rows if None not in t]
    for radius in (20_000.0, 60_000.0):
        got = [tuple(t) for t in proximity.near_pairs(p, "id", "lon", "lat", "src", radius, degrees=True).collect()]
        want = {(b[0], a[0]) for i, a in enumerate(known) for b in known[:i] if a[3] != b[3] and metres(a, b) <= radius}
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100

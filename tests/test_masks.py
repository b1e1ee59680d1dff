import math
import random

import pytest
from pyspark.sql import functions as F

from quillmatch.functions import text as X
from quillmatch.operators import masks


def page(page_id, height, width, seed):
    rng = random.Random(seed)
    return [(page_id, y, x, rng.choice([30, 60, 150, 200, 210, 220, 230]) if y % 5 else 90) for y in range(height) for x in range(width)]


@pytest.mark.parametrize("reach", [1, 30])
def test_ink_is_what_is_darker_than_its_box(spark, reach):
    cells = page(1, 13, 17, 1) + page(2, 1, 9, 2) + page(3, 8, 1, 3)
    odd = [(1, None, 1, 5), (1, 1, 1, None), (None, 1, 1, 5), (2, 0, 0, 400)]
    frame = spark.createDataFrame([(*c, 7) for c in cells + odd], "page_id int, y int, x int, grey int, n int")
    want = []
    for p in (1, 2, 3):
        grey = {(y, x): g for q, y, x, g in cells if q == p}
        ordered = sorted(grey.values())
        bright = ordered[min(len(ordered) - 1, int(len(ordered) * 0.75))]
        for (y, x), g in grey.items():
            box = [v for (a, b), v in grey.items() if abs(a - y) <= reach and abs(b - x) <= reach]
            n, s = len(box), sum(box)
            if s * 10 > bright * 6 * n and g * 100 * n < s * 84:
                want.append((p, y, x, g * 100 * n < s * 72, g * 100 * n < s * 80, True))
    assert sorted(tuple(r) for r in masks.ink(frame, reach).collect()) == sorted(want)


def plain_tilt(points, width):
    def score(t):
        bins = {}
        for y, x in points:
            at = math.floor(y + t / 1000 * (x - width * 0.5) + 100)
            bins[at] = bins.get(at, 0) + 1
        n = len(bins)
        return sum(c * c for c in bins.values()) / n - (sum(bins.values()) / n) * (sum(bins.values()) / n)

    best, at = max((score(t), -k) for k, t in enumerate(range(-90, 91, 10)))
    tilt = -90 - 10 * at
    for t in range(tilt - 9, tilt + 10, 2):
        if score(t) > best:
            best, tilt = score(t), t
    return 0 if abs(tilt) < 2 else tilt


def test_tilt_of_lines(spark):
    rows, width = [], 300
    for p, slope in ((1, 0.0), (2, 0.05), (3, -0.031), (4, 0.09)):
        rows += [(p, int(20 * k + 0.5 - slope * (x - 150)), x) for k in range(5) for x in range(0, width, 3)]
    rows += [(5, 1, 1)]
    points = spark.createDataFrame(rows, "page_id int, y int, x int")
    widths = spark.createDataFrame([(p, width) for p in range(7)], "page_id int, w int")
    found = {r.page_id: r.tilt for r in masks.tilts(points, widths, 100).collect()}
    assert found == {p: plain_tilt([(y, x) for q, y, x in rows if q == p], width) for p in (1, 2, 3, 4)}
    assert all(abs(found[p] - 1000 * s) <= 8 for p, s in ((1, 0), (2, 0.05), (3, -0.031), (4, 0.09)))
    straight = masks.straightened(points, masks.tilts(points, widths, 100), widths)
    assert {r.page_id: r.n for r in straight.groupBy("page_id").agg(F.countDistinct("y").alias("n")).collect()}[2] <= 15


def test_no_rows(spark):
    none = spark.createDataFrame([], "page_id int, y int, x int, grey int")
    assert masks.ink(none, 2).count() == 0
    assert masks.tilts(none, spark.createDataFrame([], "page_id int, w int")).count() == 0


def test_versions(spark):
    names = ["v10.2", "v9.11", "v9.2", "v9", "plain", None, "v9.2.1", "v99999999999999999999.1", "v007"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").orderBy(X.version_key(F.col("name")).asc_nulls_first()).collect()
    assert [r.name for r in rows] == [None, "plain", "v007", "v9", "v9.2", "v9.2.1", "v9.11", "v10.2", "v99999999999999999999.1"]

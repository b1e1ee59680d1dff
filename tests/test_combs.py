import math
import random

import pytest

from quillmatch.operators import combs


def marks_of(page, block, lean, count, seed, left=100, pitch=20, teeth=4):
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        y = rng.randrange(0, 600)
        rows.append((page, block, round(left + pitch * rng.randrange(teeth) + lean * (y - 300) + rng.choice([-1, 0, 0, 1])), y))
    return rows


def plain_lean(marks, twice, pitch):
    best = None
    for s in range(-600, 1001, 25):
        at = sorted(20000 * x - s * (2 * y - twice) for x, y in marks)
        cost = sum(min(b - a, int(0.4 * pitch * 20000)) for a, b in zip(at, at[1:]))
        if best is None or cost < best[0]:
            best = cost, s
    return best[1]


def test_leans(spark):
    rows = marks_of(1, 1, 0.05, 40, 1) + marks_of(1, 2, -0.03, 30, 2) + marks_of(2, 1, 0.0, 25, 3) + marks_of(2, 2, 0.0, 5, 4) + marks_of(3, 1, 0.0, 9, 5)
    frame = spark.createDataFrame([(*r, 1.0) for r in rows + [(1, 1, None, 3), (None, 1, 2, 3)]], "page_id int, block int, x int, y int, lean double")
    ends = spark.createDataFrame([(1, 0, 600), (2, 1, 602), (4, 0, 1)], "page_id int, y0 int, y1 int")
    found = {(r.page_id, r.block): r for r in combs.leans(frame, ends, 20).collect()}
    assert set(found) == {(1, 1), (1, 2), (2, 1)}
    for (p, b), r in found.items():
        own = [(x, y) for q, c, x, y in rows if (q, c) == (p, b)]
        assert r.lean == plain_lean(own, 600 if p == 1 else 603, 20) and r.n == len(own) and math.isclose(r.mean_x, sum(x for x, _ in own) / len(own))
    assert abs(found[1, 1].lean - 500) <= 50 and abs(found[1, 2].lean + 300) <= 50
    straight = combs.upright(frame.where("page_id = 1 and block = 1"), combs.leans(frame, ends, 20), ends).dropna().collect()
    assert all(min(abs(r.x - 100 - 20 * k) for k in range(4)) < 3.5 for r in straight)


def test_leans_make_no_rows(spark):
    frame = spark.createDataFrame(marks_of(1, 1, 0.05, 40, 1), "page_id int, block int, x int, y int")
    found = combs.leans(frame, spark.createDataFrame([(1, 0, 600)], "page_id int, y0 int, y1 int"), 20)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def plain_comb(profile, xs, pitch, teeth):
    xs = sorted(xs)
    n = len(xs)
    low, high = (xs[math.floor(0.1 * (n - 1))], xs[math.floor(0.9 * (n - 1))]) if n >= 8 else (xs[0], xs[-1])
    up = lambda v: math.floor(v + 0.5)
    best = {}
    for i in range(19):
        p = (0.72 + 0.04 * i) * pitch
        for j in range(int(2.75 * pitch / 1.5 + 1e-9) + 1):
            first = low - 1.55 * pitch + j * 1.5
            if not high - 1.35 * pitch <= first + (teeth - 1) * p <= high + 1.35 * pitch:
                continue
            ink = sum(profile.get(x, 0) for k in range(teeth) for x in range(up(first + k * p - 0.18 * pitch), up(first + k * p + 0.18 * pitch) + 1))
            met = sum(min(abs(x - (first + k * p)) for k in range(teeth)) <= min(0.5 * p, 0.55 * pitch) for x in xs)
            fits = n - met <= max(2, up(0.25 * n))
            if fits not in best or ink > best[fits][0]:
                best[fits] = ink, first, p, met
    found = best.get(True) or best.get(False)
    return found if found and found[0] > 0 else None


@pytest.mark.parametrize("teeth", [2, 4])
def test_combs(spark, teeth):
    rng = random.Random(teeth)
    profile, marks = {}, {}
    for page in (1, 2, 3):
        profile[page] = {x: (30 if any(abs(x - left - 21 * k) <= 2 for left in (60, 200) for k in range(teeth)) else rng.randrange(4)) for x in range(400)}
        for block, left in ((1, 60), (2, 200)):
            marks[page, block] = [left + 21 * rng.randrange(teeth) + rng.randrange(-3, 4) for _ in range(rng.choice([3, 9, 30]))] + ([left - 45] if page == 2 else [])
    marks[4, 1] = [5, 9]
    frame = spark.createDataFrame([(p, x, v) for p, rows in profile.items() for x, v in rows.items()], "page_id int, x int, v int")
    dots = spark.createDataFrame([(p, b, x, "z") for (p, b), xs in marks.items() for x in xs] + [(1, 1, None, "z")], "page_id int, block int, x int, pitch string")
    found = {(r.page_id, r.block): r for r in combs.combs(frame, dots, 20.0, teeth).collect()}
    want = {k: w for k, xs in marks.items() if (w := plain_comb(profile.get(k[0], {}), xs, 20.0, teeth))}
    assert set(found) == set(want)
    for k, (ink, first, pitch, met) in want.items():
        r = found[k]
        assert (r.ink, r.explained, r.n) == (ink, met, len(marks[k])) and math.isclose(r.first, first) and math.isclose(r.pitch, pitch)
    even = combs.even_pages(combs.combs(frame, dots, 20.0, teeth), dots, 20.0)
    assert 4 not in {r.page_id for r in even.collect()}


def test_even_pages(spark):
    firsts = {1: [0.0, 100.0, 205.0], 2: [0.0, 100.0, 300.0], 3: [0.0, 10.0], 4: [5.0], 5: [0.0, None, 200.0]}
    found = spark.createDataFrame([(p, b, f) for p, row in firsts.items() for b, f in enumerate(row) if f is not None], "page_id int, block int, first double")
    blocks = spark.createDataFrame([(p, b) for p, row in firsts.items() for b, _ in enumerate(row)], "page_id int, block int")
    assert sorted(r.page_id for r in combs.even_pages(found, blocks, 20.0).collect()) == [1, 4]


def test_no_rows(spark):
    none = spark.createDataFrame([], "page_id int, block int, x int, y int")
    assert combs.leans(none, spark.createDataFrame([], "page_id int, y0 int, y1 int"), 20).count() == 0
    assert combs.combs(spark.createDataFrame([], "page_id int, x int, v int"), none, 20.0, 4).count() == 0

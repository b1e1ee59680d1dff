import math
import random

import pytest

from quillmatch.operators import regions


def plain_regions(cells, corners):
    """Flood fill of each page."""
    left, out = {c for c in cells if None not in c}, []
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    while left:
        todo = [left.pop()]
        found = list(todo)
        while todo:
            p, y, x = todo.pop()
            for a, b in near:
                c = (p, y + a, x + b)
                if c in left:
                    left.remove(c)
                    todo.append(c)
                    found.append(c)
        ys, xs = [c[1] for c in found], [c[2] for c in found]
        runs = sum((c[0], c[1], c[2] - 1) not in found for c in found)
        out.append((found[0][0], min(ys), min(x for y, x in zip(ys, xs) if y == min(ys)), len(found), runs, max(ys), min(xs), max(xs), sum(ys), sum(xs)))
    return sorted(out)


def noise(pages, height, width, share, seed):
    rng = random.Random(seed)
    return [(p, y, x) for p in range(pages) for y in range(height) for x in range(width) if rng.random() < share]


def spiral(size):
    cells, y, x, dy, dx = {(0, 0)}, 0, 0, 0, 1
    inside = lambda a, b: 0 <= a < size and 0 <= b < size
    while True:
        if inside(y + dy, x + dx) and not (inside(y + 2 * dy, x + 2 * dx) and (y + 2 * dy, x + 2 * dx) in cells) and (y + dy, x + dx) not in cells:
            y, x = y + dy, x + dx
            cells.add((y, x))
            continue
        dy, dx = dx, -dy
        if not inside(y + dy, x + dx) or (y + 2 * dy, x + 2 * dx) in cells or (y + dy, x + dx) in cells:
            return sorted((9, a, b) for a, b in cells)


@pytest.mark.parametrize(("corners", "share"), [(True, 0.3), (False, 0.55)])
def test_regions_are_those_of_a_flood_fill(spark, corners, share):
    cells = noise(3, 14, 150, share, 7) + spiral(21) + [(5, y, x) for y in (0, 2) for x in range(-70, 200)] + [(5, 1, -70), (5, 1, 199)]
    frame = spark.createDataFrame([(*c, 1) for c in cells + cells[:20] + [(None, 1, 1), (1, None, 1), (1, 1, None)]], "page_id int, y int, x int, root int")
    assert sorted(tuple(r) for r in regions.regions(frame, corners).collect()) == plain_regions(cells, corners)


def test_a_long_region_takes_few_rounds(spark, monkeypatch):
    kept = []
    once = regions.checkpointed
    monkeypatch.setattr(regions, "checkpointed", lambda df, replaces=None: kept.append(1) or once(df, replaces))
    links = spark.range(3000).selectExpr("(id * 7919) % 3001 AS a", "((id + 1) * 7919) % 3001 AS b")
    found = regions.roots(links).collect()
    assert {r.root for r in found} == {0} and len(found) == 3001
    assert len(kept) < 40


def test_no_cells_and_no_links(spark):
    assert regions.regions(spark.createDataFrame([], "page_id int, y int, x int")).count() == 0
    found = regions.regions(spark.createDataFrame([(1, 2, 3), (1, 5, 3)], "page_id int, y int, x int")).collect()
    assert sorted((r.y0, r.cells) for r in found) == [(2, 1), (5, 1)]


def test_discs(spark):
    height, width = 12, 15
    cells = noise(2, height, width, 0.5, 3)
    rng = random.Random(2)
    discs = [(p, f"d{k}", rng.uniform(-2, 16), rng.uniform(-2, 13), rng.choice([0.0, 0.4, 1.5, 3.0, 40.0])) for p in range(3) for k in range(25)]
    odd = [(0, "none", None, 1.0, 1.0), (0, "off", -50.0, 3.0, 2.0), (0, "whole", 3.0, 4.0, 2.0)]
    found = regions.disc_fill(spark.createDataFrame(cells, "page_id int, y int, x int"), spark.createDataFrame(discs + odd, "page_id int, disc string, cx double, cy double, radius double"), height, width)
    dark, want = set(cells), []
    for p, k, cx, cy, r in discs + odd[1:]:
        inside = [(y, x) for y in range(height) for x in range(width) if (y - cy) ** 2 + (x - cx) ** 2 <= r * r]
        hit = sum((p, y, x) in dark for y, x in inside)
        want.append((p, k, len(inside), hit, hit / len(inside) if inside else 0.0))
    got = sorted(tuple(r) for r in found.collect())
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want)]
    assert all(math.isclose(g[4], w[4]) for g, w in zip(got, sorted(want)))


def test_modal_side_and_marked_option(spark):
    rows = [(1, 0, 0, 4, 4), (1, 9, 9, 12, 13), (1, 20, 0, 23, 3), (1, 30, 0, 30, 90), (2, 0, 0, 0, 0), (3, 0, 0, 2, 2), (3, 5, 5, 9, 9)]
    found = regions.modal_side(spark.createDataFrame(rows, "page_id int, y0 int, x0 int, y1 int, x1 int")).collect()
    assert sorted(tuple(r) for r in found) == [(1, 4, 2), (3, 5, 1)]
    fills = spark.createDataFrame([(1, 1, 0, 0.5), (1, 1, 1, 0.5), (1, 2, 0, 0.2), (1, 2, 1, 0.44), (2, 1, 3, 0.45)], "page_id int, item int, option int, fill double")
    assert sorted(tuple(r) for r in regions.marked_option(fills).collect()) == [(1, 1, 0, 0.5), (1, 2, None, 0.44), (2, 1, 3, 0.45)]

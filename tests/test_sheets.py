import math
import random

import pytest

from quillmatch.operators import sheets


def plain_lattice(tops, h):
    best = {}
    for at, ink in tops:
        best[at] = max(ink, best.get(at, ink))
    at = sorted(best)
    diffs = [b - a for a, b in zip(at, at[1:])]
    votes, pitch = 0, 0
    for d in range(10, 161):
        n = sum(abs(x - d) <= 2 for x in diffs)
        if n > votes:
            votes, pitch = n, d
    if votes < 4:
        return []
    runs = [[at[0]]]
    for a, b in zip(at, at[1:]):
        if b - a <= 1.45 * pitch:
            runs[-1].append(b)
        else:
            runs.append([b])
    big = min(runs, key=lambda r: (-len(r), abs(r[0] + r[-1] - h), r[0]))
    if len(big) < 5:
        return []
    gaps = sorted(b - a for a, b in zip(big, big[1:]))
    p = gaps[len(gaps) // 2]
    if p < 8:
        return []
    rows = [(big[0], best[big[0]], False)]
    for y in big[1:]:
        prev = rows[-1]
        k = math.floor((y - prev[0]) / p + 0.5)
        if k < 1:
            if best[y] > prev[1]:
                rows[-1] = (y, best[y], False)
            continue
        if abs(y - prev[0] - k * p) > 0.32 * p:
            continue
        rows += [(prev[0] + (y - prev[0]) * i / k, 0, True) for i in range(1, k)] + [(y, best[y], False)]
    return [(i + 1, r[0], r[2], p) for i, r in enumerate(rows)] if len(rows) >= 5 else []


@pytest.mark.parametrize("seed", range(2))
def test_lattice(spark, seed):
    rng = random.Random(seed)
    pages = {}
    for page in range(12):
        pitch = rng.choice([12, 20, 33])
        rows = [100 + pitch * k + rng.choice([0, 0, 1, -1]) for k in range(rng.choice([4, 8, 25])) if rng.random() < 0.85]
        rows += [rng.randrange(1200) for _ in range(rng.randrange(5))] + [700 + 9 * k for k in range(rng.randrange(4))]
        pages[page] = [(y, rng.randrange(1, 9)) for y in rows]
    pages[50] = [(0, 3), (40, 2)]
    tops = spark.createDataFrame([(p, y, float(i), 1) for p, rows in pages.items() for y, i in rows] + [(1, None, 1.0, 1), (None, 1, 1.0, 1)], "page_id int, at int, ink double, run int")
    heights = spark.createDataFrame([(p, 1200) for p in pages], "page_id int, h int")
    found = sorted(tuple(r) for r in sheets.row_lattice(tops, heights).collect())
    want = sorted((p, *r) for p, rows in pages.items() for r in plain_lattice(rows, 1200))
    assert [(f[0], f[1], f[3]) for f in found] == [(w[0], w[1], w[3]) for w in want]
    assert all(math.isclose(f[2], w[2]) and f[4] == w[4] for f, w in zip(found, want)) and len(want) > 20


def test_marks(spark):
    rng = random.Random(4)
    height, width, pitch = 120, 160, 24.0
    bubbles = [(1, no, o, 20.0 + pitch * o, 20.0 + 26 * no, pitch) for no in range(4) for o in range(4)]
    dark = set()
    for _, no, o, cx, cy, _ in bubbles:
        filled = (no, o) in {(0, 2), (1, 0), (1, 3)}
        for y in range(height):
            for x in range(width):
                d = math.hypot(x - cx - 3, y - cy + 2)
                if (filled and d <= 8 and rng.random() < 0.9) or 8 <= d <= 9:
                    dark.add((y, x))
    loose = dark | {(y, x) for y in range(height) for x in range(width) if math.hypot(x - 20 - pitch, y - 20 - 52) <= 9}
    frame = lambda cells: spark.createDataFrame([(1, y, x) for y, x in cells], "page_id int, y int, x int")
    spots = spark.createDataFrame(bubbles + [(1, 9, 0, None, 1.0, 2.0)], "page_id int, no int, option int, cx double, cy double, pitch double")
    found = sorted(tuple(r) for r in sheets.disc_marks(frame(dark), frame(loose), spots, height, width).collect())

    def best(cells, cx, cy):
        out = 0
        for a in sheets.ASIDE:
            for b in sheets.ABOVE:
                bx, by, r = math.floor(cx + a * pitch + 0.5), math.floor(cy + b * pitch + 0.5), max(4, 0.32 * pitch)
                inside = [(y, x) for y in range(height) for x in range(width) if (y - by) ** 2 + (x - bx) ** 2 <= r * r]
                out = max(out, sum(c in cells for c in inside) / len(inside) if inside else 0)
        return out

    for page, no, option, tight, loosest in found:
        fills = [(best(dark, c[3], c[4]), best(loose, c[3], c[4])) for c in bubbles if c[1] == no]
        t, k = max(f[0] for f in fills), max(f[1] for f in fills)
        assert math.isclose(t, tight) and math.isclose(k, loosest)
        assert option == ([f[0] for f in fills].index(t) if t >= 0.4 else [f[1] for f in fills].index(k) if k >= 0.75 else None)
    assert [(r[1], r[2]) for r in found] == [(0, 2), (1, 0), (2, 1), (3, None)]


def test_no_rows(spark):
    tops = spark.createDataFrame([], "page_id int, at int, ink double")
    assert sheets.row_lattice(tops, spark.createDataFrame([], "page_id int, h int")).count() == 0

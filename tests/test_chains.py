import math
import random

import pytest

from quillmatch.operators import chains


def plain(rows, pitch, least):
    """The programme over all earlier candidates of each key."""
    out = []
    for key in sorted({r[0] for r in rows}):
        best_of = {}
        for _, at, w in (r for r in rows if r[0] == key):
            best_of[at] = max(w, best_of.get(at, w))
        c = sorted(best_of.items())
        if len(c) < least:
            continue
        top, score, prev, step = max(best_of.values()), [], [], []
        for i, (at, w) in enumerate(c):
            s, p, k = w, None, 0
            for j in range(i):
                gap = at - c[j][0]
                if not 0.62 * pitch <= gap <= 2.4 * pitch:
                    continue
                m = max(1, min(2, math.floor(gap / pitch + 0.5)))
                found = score[j] + w - (abs(gap - m * pitch) / pitch + 0.12 * (m - 1)) * 0.6 * top
                if found > s:
                    s, p, k = found, j, m
            score.append(s), prev.append(p), step.append(k)
        i = max(range(len(c)), key=lambda j: (score[j], -j))
        best, places = score[i], []
        while i is not None:
            places.append((c[i][0], False))
            if step[i] == 2:
                places.append(((c[i][0] + c[prev[i]][0]) / 2, True))
            i = prev[i]
        out += [(key, n, at, made, best) for n, (at, made) in enumerate(sorted(places), 1)]
    return out


@pytest.mark.parametrize(("least", "pitch"), [(5, 10.0), (1, 3.0)])
def test_chains_are_those_of_the_whole_programme(spark, least, pitch):
    rng = random.Random(least * 7 + int(pitch))
    rows = [(k, float(rng.randrange(60 * (k + 1))), float(rng.choice([0.5, 1, 2, 2, 7]))) for k in range(6) for _ in range(rng.randrange(1, 60))]
    rows += [(9, 1000.0 * i + 10 * j, 2.0) for i in range(5) for j in range(3)] + [(8, float(10 * i), 1.0) for i in range(300)]
    odd = [(1, None, 1.0), (1, 5.0, None), (None, 5.0, 1.0), (1, math.nan, 1.0)]
    frame = spark.createDataFrame([(*r, 4) for r in rows + odd], "key int, at double, weight double, id int")
    found = sorted(tuple(r) for r in chains.best_chains(frame, str(pitch), least).collect())
    want = plain(rows, pitch, least)
    assert [r[:4] for r in found] == [w[:4] for w in want]
    assert all(math.isclose(r[4], w[4]) for r, w in zip(found, want))


def test_no_rows(spark):
    frame = spark.createDataFrame([(1, 2.0, 3.0, 0.0)], "key int, at double, weight double, pitch double")
    assert chains.best_chains(frame, "pitch").count() == 0
    assert chains.best_chains(frame.where("key > 1"), "1").count() == 0

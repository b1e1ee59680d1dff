import math
import random

import brute
import numpy as np
import pytest

from quillmatch.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, h int, rep long"


def fixture(seed=8, size=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, size))
    rows = []
    for i in range(260):
        v = (centres[i % 12] + rng.standard_normal(size) * rng.choice([0.05, 0.2, 0.28, 0.35])) * rng.choice([0.1, 1, 30])
        rows.append([i, [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 2))])
    rows += [[260 + k, list(rows[3][1]), rows[3][2]] for k in range(5)]
    odd = [None, [], [0.0] * size, [math.nan] + [1.0] * (size - 1), [math.inf] + [1.0] * (size - 1), [None] + [1.0] * (size - 1), rows[3][1][:-1]]
    rows += [[270 + k, v, 1] for k, v in enumerate(odd)] + [[280, list(rows[3][1]), None], [None, list(rows[3][1]), rows[3][2]]]
    return [tuple(r) for r in rows]


def expected(rows):
    """{vec_id: (n_links, component_id)}"""
    known = [r for r in rows if r[0] is not None]
    sound = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links, count = [], [0] * len(known)
    for i, (_, a, s) in enumerate(known):
        for j in range(i):
            b, t = known[j][1:]
            if s is not None and s == t and sound(a) and sound(b) and len(a) == len(b):
                x, y = np.array(a, np.float64), np.array(b, np.float64)
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.93:
                    links.append((j, i))
                    count[i] += 1
                    count[j] += 1
    return {known[i][0]: (count[i], known[r][0]) for i, r in enumerate(brute.groups(len(known), links))}


@pytest.mark.parametrize("block", [3000, 30])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = fixture()
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    found = vectors.linked(docs).collect()
    assert len(found) == len(rows)
    by_id = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert {r.vec_id: (r.n_links, r.component_id) for r in found if r.vec_id is not None} == expected(by_id)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert [(r.n_links, r.kept) for r in found if r.vec_id is None] == [(0, True)]


def test_no_rows(spark):
    assert vectors.linked(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_group_of_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0], 5, "", 0, 0) for i in range(2000)]
    found = vectors.linked(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(1999, 0)}


def test_calibrated_count_meets_its_recall():
    """Pairs right at the threshold collide often enough."""
    rng = np.random.default_rng(3)
    size, least, half = 64, vectors.least_count(), vectors.WIDTH * math.sqrt(2 - 2 * vectors.COSINE)
    to = vectors.directions(size)
    a = rng.standard_normal((4000, size))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((4000, size))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    near = vectors.COSINE * a + math.sqrt(1 - vectors.COSINE**2) * b
    hits = (np.abs(a @ to - near @ to) <= half).sum(1)
    assert (hits >= least).mean() > 0.999

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from quillmatch.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x long, size int, n long, w0 double"


def made(size=6, count=150, seed=4):
    rng = np.random.default_rng(seed)
    rows = (rng.standard_normal((count, size)) @ rng.standard_normal((size, size))).astype(np.float32)
    out = [(i, [float(c) for c in r]) for i, r in enumerate(rows)]
    return out + [(900, out[3][1]), (3, out[3][1]), (None, out[5][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, 8, 9, 0.5) for i, v in rows], SCHEMA)


def expected(rows):
    """Exact sums and deviations, and NumPy's eigenvectors of the exact covariance."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, size = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(size)]
    y = [[n * r[j] - s[j] for j in range(size)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(size)] for i in range(size)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    return n, [sum(c * c for c in r) for r in y], np.array(y, np.float64) / n @ v / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(cov)


@pytest.mark.parametrize("size", [2, 6, 12])
def test_against_exact_covariance(spark, size):
    rows = made(size)
    n, deviations, white, shares = expected(rows)
    shuffled = list(enumerate(rows))
    random.Random(2).shuffle(shuffled)
    numbered = spark.createDataFrame([(k, v, 1, 7, 8, 9, 0.5) for k, (_, v) in shuffled], SCHEMA)
    found = whitening.whitened(numbered).collect()
    kept = min(8, size)
    assert len(found) == len(rows) * kept
    got = np.full((len(rows), kept), np.nan)
    for r in found:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviations[r.vec_id] == int(r.deviation_exact)
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-10) and r.identity_error < 1e-9
    signs = np.sign((got * white[:, :kept]).sum(0))
    assert np.abs(got * signs - white[:, :kept]).max() < 1e-8


def test_unsound_vectors_go_and_others_lengths_are_left_out(spark):
    rows = made()
    odd = [None, [], [math.nan] + [1.0] * 5, [math.inf] + [1.0] * 5, [None] + [1.0] * 5, [1.0, 2.0], [3e38] * 6]
    found = whitening.whitened(frame(spark, rows + [(1000 + k, v) for k, v in enumerate(odd)])).collect()
    assert {r.n for r in found} == {len(rows)}
    assert sorted(str(r.vec_id) for r in found) == sorted(str(i) for i, _ in rows for _ in range(6))


def test_dependent_dimensions_have_no_component(spark):
    rows = [(i, [v[0], v[1], v[0], 2.0]) for i, v in made(2)]
    found = whitening.whitened(frame(spark, rows)).collect()
    assert {r.component for r in found} == {1, 2} and max(r.identity_error for r in found) < 1e-9
    assert sum({r.component: r.explained for r in found}.values()) == pytest.approx(1, rel=1e-9)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2.0**40 * i), float(i * i % 7), float(-i)]) for i in range(40)]
    n, deviations, *_ = expected(rows)
    found = whitening.whitened(frame(spark, rows)).collect()
    assert {r.vec_id: int(r.deviation_exact) for r in found} == dict(enumerate(deviations))
    assert all(r.deviation is None or r.deviation == deviations[r.vec_id] for r in found)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(50)]])
def test_nothing_to_scale(spark, rows):
    found = whitening.whitened(frame(spark, rows))
    assert found.count() == 0 and found.columns[:3] == ["vec_id", "component", "n"]

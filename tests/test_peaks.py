"""Local maxima against their definition, on random profiles with plateaus and ties."""

import random

from quillmatch.operators import sequence


def plain(profile, apart, share=0.15, least=2):
    """Maxima in order; one nearer than `apart` to a kept one takes its place where it is higher, and else goes."""
    level = max(least, share * max(v for _, v in profile))
    kept = []
    for (_, a), (at, v), (_, b) in zip(profile, profile[1:], profile[2:]):
        if not (v >= a and v > b and v > level):
            continue
        near = next((k for k, (x, _) in enumerate(kept) if abs(at - x) < apart), None)
        if near is None:
            kept.append((at, v))
        elif v > kept[near][1]:
            kept[near] = (at, v)
    return kept


def test_peaks(spark):
    rng = random.Random(12)
    pages = {p: [(at, float(rng.randrange(rng.choice([3, 12, 40])))) for at in range(rng.randint(1, 80))] for p in range(40)}
    pages[40] = [(k, 5.0) for k in range(10)]
    rows = [(p, at, v) for p, profile in pages.items() for at, v in profile]
    found = sequence.peaks(spark.createDataFrame(rows, "p int, at int, v double").repartition(7), "p", "at", "v", 8).collect()
    assert sorted((r.p, r.at, r.v) for r in found) == sorted((p, at, v) for p, profile in pages.items() for at, v in plain(profile, 8))

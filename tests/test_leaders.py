import random

import pytest
from pyspark.sql import functions as F

from quillmatch.operators import leaders


def plain(rows, cells, near):
    """In order, each picture against all leaders so far."""
    known, out = {}, {}
    for key, place, bits in sorted((r for r in rows if None not in r and len(r[2]) == cells and set(r[2]) <= set("01")), key=lambda r: (r[0], r[1], r[2])):
        found = known.setdefault(key, [])
        apart = [(sum(a != b for a, b in zip(bits, other)), i) for i, (_, other) in enumerate(found)]
        d, i = min(apart, default=(cells, None))
        if i is not None and d / cells < near:
            out.setdefault((key, place, bits), []).append((found[i][0], d))
        else:
            found.append((place, bits))
            out.setdefault((key, place, bits), []).append((place, 0))
    return sorted((k[0], k[1], x, d, len(known[k[0]])) for k, v in out.items() for x, d in v)


def glyphs(cells, count, flips, seed):
    rng = random.Random(seed)
    shapes = ["".join(rng.choice("01") for _ in range(cells)) for _ in range(5)]
    rows = []
    for i in range(count):
        bits = list(rng.choice(shapes))
        for _ in range(rng.randint(0, flips)):
            at = rng.randrange(cells)
            bits[at] = "10"[int(bits[at])]
        rows.append((rng.choice(["p", "q"]), i // 2 if i % 5 else i // 4, "".join(bits)))
    return rows


@pytest.mark.parametrize(("cells", "near", "flips"), [(16, 0.15, 3), (100, 0.055, 7), (9, 0.5, 4)])
def test_leaders_are_those_of_one_pass(spark, cells, near, flips):
    rows = glyphs(cells, 160, flips, cells)
    rows += [("p", 3, rows[0][2]), (None, 1, rows[0][2]), ("q", None, rows[0][2]), ("q", 5, None), ("q", 5, "01"), ("q", 6, "x" * cells)]
    frame = spark.createDataFrame([(*r, "other") for r in rows], "key string, ord long, bits string, leader string")
    found = [tuple(r) for r in leaders.glyph_leaders(frame, cells, near).collect()]
    assert len(found) == len(rows)
    assert sorted(r for r in found if r[2] is not None) == plain(rows, cells, near)
    assert sum(r[2:] == (None, None, None) for r in found) == 5


def test_a_later_copy_joins_a_leader_that_came_between(spark):
    rows = [(1, 1, "11110000"), (1, 2, "11111100"), (1, 3, "11111111"), (1, 4, "11111110"), (1, 5, "11111100"), (1, 6, "11011111"), (1, 7, "11001101")]
    # 6 joins 3; 7 leads; a copy of 6 that comes after 7 is as near to both, and the earlier one counts
    rows += [(1, 8, "11011111"), (1, 9, "11001111")]
    found = leaders.glyph_leaders(spark.createDataFrame(rows, "key int, ord int, bits string"), 8, 0.3)
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, 8, 0.3)


def test_copies_and_no_rows(spark):
    rows = spark.range(3000).select(F.lit(1).alias("key"), F.col("id").alias("ord"), F.when(F.col("id") < 2999, "1" * 30).otherwise("0" * 30).alias("bits"))
    found = leaders.glyph_leaders(rows, 30).groupBy("leader", "leaders").count().collect()
    assert sorted(tuple(r) for r in found) == [(0, 2, 2999), (2999, 2, 1)]
    assert leaders.glyph_leaders(rows.where("id < 0"), 30).count() == 0
    with pytest.raises(ValueError):
        leaders.glyph_leaders(rows, 30, 0.0)


def test_shrunk_picture(spark):
    rows = [([1.0, 1.0, -9.0, 0.0] * 2 + [0.0, 0.0, 3.0, -1.0] * 2,), ([None] * 16,), ([1.0],)]
    found = spark.createDataFrame(rows, "v array<double>").select(leaders.shrunk(F.col("v"), 4, 2)).collect()
    assert [r[0] for r in found] == ["1001", None, None]

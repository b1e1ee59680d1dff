import random

import pytest
from pyspark.sql import functions as F

from quillmatch.operators import flights

SCHEMA = "k string, at long, id long, takes long, ok boolean, lead string"


def plain(reads, life):
    """One proxy: for each key the flight under way, or the answer that it keeps."""
    out, held = [], {}
    for k, at, id, takes, ok in sorted((r for r in reads if None not in (r[0], r[1], r[3], r[4]) and r[3] >= 0), key=lambda r: (r[1], r[2])):
        lead = held.get(k)
        if lead and at < lead[1]:
            out.append((k, at, id, "wait", lead[0], lead[1], lead[2]))
        elif lead and lead[2] and at < lead[1] + life:
            out.append((k, at, id, "hit", lead[0], at, True))
        else:
            held[k] = (id, at + takes, ok)
            out.append((k, at, id, "lead", id, at + takes, ok))
    return sorted(out)


def reads(count, seed, longest):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", f"k{i % 9}"]), rng.randrange(4000), i, rng.choice([0, 0, 5, longest]), rng.random() < 0.6) for i in range(count)]


@pytest.mark.parametrize(("longest", "life"), [(3, 0), (40, 90), (700, 1000)])
def test_roles_are_those_of_a_proxy(spark, longest, life):
    rows = reads(500, longest + life, longest)
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in flights.flights(frame, life, 3).collect()) == plain(rows, life)


def test_one_key_over_many_ranges(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * 3).alias("at"), "id", (F.col("id") % 11).alias("takes"), (F.col("id") % 5 > 0).alias("ok"))
    found = sorted(tuple(r) for r in flights.flights(rows, 20, 7).collect())
    assert found == plain([tuple(r) for r in rows.collect()], 20)
    assert flights.ranged(rows, "k", ["at", "id"], 7).select("_part").distinct().count() > 1


def test_unsound_reads_and_no_reads(spark):
    rows = [(None, 1, 1, 5, True), ("a", None, 2, 5, True), ("a", 3, 3, None, True), ("a", 4, 4, 5, None), ("a", 5, 5, -1, True), ("a", 6, 6, 5, False), ("a", 8, 7, 5, True)]
    found = {r.id: tuple(r)[3:] for r in flights.flights(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    assert found == {1: ("lead", 1, 6, True), 2: ("lead", 2, None, True), 3: ("lead", 3, None, True), 4: ("lead", 4, 9, None), 5: ("lead", 5, None, True), 6: ("lead", 6, 11, False), 7: ("wait", 6, 11, False)}
    assert flights.flights(spark.createDataFrame([], SCHEMA)).count() == 0


def test_counts(spark):
    rows = spark.createDataFrame([("a", 0, 0, 10, False, ""), ("a", 5, 1, 10, True, ""), ("a", 10, 2, 10, True, ""), ("a", 21, 3, 1, True, "")], SCHEMA)
    assert [tuple(r) for r in flights.upstream_reads(flights.flights(rows, 100)).collect()] == [("a", 2, 1, 1, 2)]

"""The filled lattice against its SQL where gaps are wide and places far along, and rounding against DuckDB."""

import duckdb
from pyspark.sql import functions as F

from quillmatch.functions.numbers import round_half_away
from quillmatch.plans import catalogue


def test_wide_gaps(spark, tmp_path):
    # 877 steps and 876, one of them with made places that end in a five at the seventh digit, seen from the text of the double
    orders = [(0, 33129141), (0, 34005870), (3, 33127073), (3, 34002747), (3, 34002747), (3, 34002848), (5, 7), (None, 5), (None, 9005), (7, None), (7, 4000)]
    spark.createDataFrame(orders, "o_custkey long, o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    expected = con.sql(catalogue.ORACLES["filled_lattice"]).select("o_custkey", "pos", "made").fetchall()
    found = [tuple(r) for r in catalogue.QUERIES["filled_lattice"](spark, str(tmp_path)).select("o_custkey", "pos", "made").collect()]
    assert len(found) == 877 + 876 + 4 + 1 + 10 + 2
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_round_half_away(spark):
    values = [0.0078125, 1.0078125, 0.0, 2.5e-6, 4e-7, 0.49999999999999994e-6, 33758946.3249715, 33813929.3295325, 4503599627.370497, 9007199254.740993, 1e13 + 0.25, 1e17]
    values = [s * v for v in values for s in (1, -1)] + [None]
    found = [r.r for r in spark.createDataFrame([(v,) for v in values], "v double").select(round_half_away(F.col("v"), 6).alias("r")).collect()]
    con = duckdb.connect()
    assert found == [con.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values]
    assert [r.r for r in spark.createDataFrame([(0.5,), (1.5,), (-2.5,)], "v double").select(round_half_away(F.col("v")).alias("r")).collect()] == [1.0, 2.0, -3.0]

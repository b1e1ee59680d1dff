"""The printed benchmark where a booklet holds more items than the parsers' limits let numbers reach."""

import random

import duckdb
import pytest

from quillmatch.plans import catalogue

ITEMS = 10_100


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("large")
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("bcdfghklmnprstvw", k=9))
    rows = [(i, " ".join(word() for _ in range(6))) for i in range(ITEMS)]
    spark.createDataFrame(rows, "item_id long, text string").coalesce(1).write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_questions_equal_their_sql(spark, large):
    con = duckdb.connect()
    con.sql(f"create view benchmark as select * from '{large}/benchmark.parquet/*.parquet'")
    found = catalogue.QUERIES["parse_questions"](spark, large).select("doc_id", "idx", "no", "text")
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(catalogue.ORACLES["parse_questions"]).fetchall())


def test_every_item_is_chained_and_found_by_its_stem(spark, large):
    assert catalogue.QUERIES["chain_segments"](spark, large).count() == ITEMS
    found = catalogue.QUERIES["stem_match"](spark, large)
    assert found.select("p_idx").distinct().count() == ITEMS
    assert found.where("p_idx % 1000 - p_idx % 10 <> (no - 1) * 10").count() == 0

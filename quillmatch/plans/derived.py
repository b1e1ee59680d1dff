"""Papers, keys and answers derived from the synthetic tables, for there are no exam documents among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.operators import match, score


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a paper and each of its lines a question: (match_id, p_idx, no, key, mine, has_key)."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    rows = match.dealt(rows, rows.count(), "l_orderkey")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return rows.select(
        F.col("l_orderkey").alias("match_id"), F.row_number().over(order).alias("no"),
        F.char(65 + F.col("l_suppkey") % 4).alias("key"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.char(65 + F.col("l_partkey") % 4)).alias("mine"),
        (~((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"))).alias("has_key"),
    ).withColumn("p_idx", F.col("no"))


def parts(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paper, keys and answers of line_items."""
    paper = items.select("match_id", "p_idx", "no")
    keys = items.where("has_key").select("match_id", "no", F.col("no").alias("k_idx"), F.col("key").alias("answer"))
    return paper, keys, items.select("match_id", "p_idx", "mine")


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of the match by number."""
    paper, keys, answers = parts(line_items(spark, sf_dir))
    return score.result_rows(paper, match.by_offset(paper, keys), keys, answers)


def benchmark_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One match: the benchmark items as a paper, and the same items under permuted numbers, cut to three quarters, as a key."""
    items = table(spark, sf_dir, "benchmark")
    rows = items.crossJoin(F.broadcast(items.agg(F.count("*").alias("n"))))
    none = [F.lit(None).cast("array<string>").alias("options"), F.lit(None).cast("string").alias("alt"), F.lit(None).cast("array<string>").alias("alt_options")]
    paper = rows.select(F.lit(1).alias("match_id"), F.col("item_id").alias("p_idx"), (F.col("item_id") + 1).alias("no"), "text", *none)
    cut = F.substring("text", F.lit(1), (F.length("text") * 3 / 4).cast("int"))
    keys = rows.select(F.lit(1).alias("match_id"), ((7 * F.col("item_id") + 3) % F.col("n")).alias("k_idx"), ((7 * F.col("item_id") + 3) % F.col("n") + 1).alias("no"), cut.alias("text"), *none)
    return paper, keys


def match_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    paper, keys = benchmark_pair(spark, sf_dir)
    return match.by_content(paper, keys)

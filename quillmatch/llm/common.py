"""What several operators share: scratch tables, checked broadcasts, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: A side of at most so many bytes is broadcast; larger sides are shuffled.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session gets one of its own; a cluster has to name one that all share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        where = context.getCheckpointDir()
    return where.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, files = _hadoop_path(spark, path)
    files.deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, which cuts the lineage.

    The table goes when the driver's file system closes; losing an executor loses nothing of it.
    """
    return _written(df, label)[0]


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcasts a written table of numbers that takes at most limit bytes in rows, about; a larger one joins by a shuffle."""
    return F.broadcast(df) if df.count() * (24 + 8 * len(df.columns)) <= limit else df.hint("shuffle_merge")


def set_aside(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns of docs, and all others in one struct `_rest`, where no name of theirs can meet one of an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*rest) if rest else F.lit(None).cast("string")).alias("_rest"))


def put_back(columns: list[str], used: dict[str, Column]) -> list[Column]:
    """The columns of docs as they were, but for the used ones, which come as given."""
    return [(used[c] if c in used else F.col("_rest")[c]).alias(c) for c in columns]


def components(links: DataFrame) -> DataFrame:
    """Connected components of links(a, b), a != b: one row (id, root) per linked id, root the smallest id reachable.

    Alternates the large-star and small-star steps until no edge changes. Every star is one grouped
    aggregate and one join, the edges stay as many as they were, and each round is written to the shared folder, where the
    round before then goes.
    """
    spark = links.sparkSession
    edges, path = _written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.unionByName(edges.groupBy("u").agg(F.min("v").alias("v"))).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before_path = path
        edges, path = _written(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        target, files = _hadoop_path(spark, before_path)
        files.delete(target, True)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            )
        before = now

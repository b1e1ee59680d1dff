"""Mixing sources to target weights by weighted fair queueing, in built-in expressions only.

Documents are shuffled by a hash of doc_id. Each gets a virtual finish time: the words of its source up to and with it,
over the source's target. A source may go round EPOCHS times, each round after the last. All of this is range-sorted
by finish time, and taken in that order while the words stay within the total budget.

Defined results: null text has size 0; null is a source of its own, last; a document of size 0 is never taken (0 words);
repeated rows are queued one after the other; an empty table gives no rows. Only doc_id, text and source are read; in the pipeline, other columns go along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, put_back, set_aside, table, written

#: Times that a source may be repeated at most.
EPOCHS = 3
#: Rows of a bucket within a source, and of a range of the global sort, about.
BUCKET_ROWS = 100_000


def size_of_text():
    """Words of the text."""
    return F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE + "+"), "")).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix")))
    return docs.select("doc_id", "source", size_of_text().alias("size"), key.alias("key"))


def targets(by_source: DataFrame) -> DataFrame:
    """(source, source_size) to (source, rank, source_size, target): one row per source, so that one task can order them.

    The cap of EPOCHS times the size binds the sources with the least size for their weight. The level at which the
    others settle is the first, in that order, that lies below the next source's own cap.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    rows = by_source.withColumn("rank", F.row_number().over(order))
    rows = rows.withColumn("weight", F.pmod(F.col("rank") - 1, F.lit(3)) + 1).withColumn("cap", F.lit(EPOCHS) * F.col("source_size"))
    by_need = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = W.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("level", left / F.sum("weight").over(by_need.rowsBetween(0, W.unboundedFollowing)))
    settled = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)
    rows = rows.withColumn("target", F.least(F.col("cap").cast("double"), settled["level"] * F.col("weight")))
    return rows.select("source", "rank", "source_size", "target")


def queued(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key, rank, source_size, target, upto): upto counts the source's words up to and with the row."""
    rows = written(sizes(docs), "sizes")
    n, digits = rows.count(), 1
    while 16**digits * BUCKET_ROWS < n:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    by_source = sums.groupBy("source").agg(F.sum("s").alias("source_size"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    facts = offsets.alias("o").join(targets(by_source).alias("t"), F.expr("o.source <=> t.source")).select("o.*", "rank", "source_size", "target")
    within = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("size").over(within))
    both = rows.alias("r").join(facts.alias("f"), F.expr("r.source <=> f.source and r.bucket = f.bucket"))
    return both.select("doc_id", "r.source", "size", "key", "rank", "source_size", "target", (F.col("_upto") + F.col("offset")).alias("upto"))


def finish(epoch: int):
    return (F.col("upto") + epoch * F.col("source_size")) / F.col("target")


def mix(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, text) to (doc_id, source, size, source_size, target, taken), one row for each of docs."""
    spark = docs.sparkSession
    rows = written(queued(docs), "queued")
    facts = rows.agg(F.sum("size"), F.count("*")).first()
    if not facts[0]:
        return rows.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    budget = facts[0]
    some = rows.where("size > 0")
    copies = some.select("rank", "key", "size", F.explode(F.array(*[finish(e) for e in range(EPOCHS)])).alias("at"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), facts[1] * EPOCHS // BUCKET_ROWS)
    ranged = copies.repartitionByRange(parts, "at", "rank", "key").sortWithinPartitions("at", "rank", "key")
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("part").agg(F.sum("size").alias("s"))  # a row for each range
    sums = sums.withColumn("upto", F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)))
    cut = sums.where(F.col("upto") > budget).orderBy("part").first()
    edge = ranged.where(F.col("part") == cut["part"])  # one range of the sort, which holds the last word taken
    total = F.sum("size").over(W.orderBy("at", "rank", "key").rowsBetween(W.unboundedPreceding, 0)) + (cut["upto"] - cut["s"])
    first_out = edge.withColumn("total", total).where(F.col("total") > budget).orderBy("at", "rank", "key").first()
    limit = F.struct(F.lit(first_out["at"]), F.lit(first_out["rank"]), F.lit(first_out["key"]))
    rounds = sum((F.struct(finish(e), "rank", "key") < limit).cast("long") for e in range(EPOCHS))
    taken = F.when(F.col("size") > 0, F.col("size") * rounds).otherwise(F.lit(0))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def take_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, with its columns as they were.

    Rows that share doc_id, source and size come as often as the most taken of them.
    """
    chosen = mix(docs.select("doc_id", "source", "text")).where("taken > 0")
    chosen = chosen.groupBy("doc_id", "source", "size").agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("_times"))
    used = ["doc_id", "source", "text"]
    sized = set_aside(docs, *used).withColumn("_size", size_of_text())
    both = sized.alias("d").join(chosen.alias("c"), F.expr("d.doc_id <=> c.doc_id and d.source <=> c.source and d._size = c.size"))
    both = both.select("d.*", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_round"))
    return both.select(*put_back(docs.columns, {c: F.col(c) for c in used}))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM weighed),
settled AS (SELECT arg_min(level, (cap / weight, rank)) AS level FROM levels WHERE level <= cap / weight),
targets AS (SELECT source, rank, source_size, least(cap::DOUBLE, (SELECT level FROM settled) * weight) AS target FROM levels),
queued AS (
  SELECT s.doc_id, s.source, size, key, rank, source_size, target,
         sum(size) OVER (PARTITION BY rank ORDER BY key, s.doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT q.*, (upto + e * source_size)::DOUBLE / target AS fin FROM queued q, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
totals AS (SELECT *, sum(size) OVER (ORDER BY fin, rank, key ROWS UNBOUNDED PRECEDING) AS total FROM copies),
kept AS (SELECT rank, doc_id, sum(size)::BIGINT AS taken FROM totals WHERE total <= (SELECT sum(size) FROM sized) GROUP BY rank, doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken, q.source
FROM queued q LEFT JOIN kept k ON q.rank = k.rank AND q.doc_id = k.doc_id
"""

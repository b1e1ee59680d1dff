"""Reads that arrive while an equal one is under way share its answer, and later ones the cached answer: leads, waiters and hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.operators.match import checkpointed

#: Life of an answer in the cache, in milliseconds from its arrival; a hit does not renew it.
LIFE = 12 * 3600 * 1000


def lasting(rows: DataFrame, key: str, order: list[str], last: dict[str, Column], back: bool = False) -> DataFrame:
    """rows with, under each name of `last`, the last value that is not null at or before each row of its key, in order; with `back`, the next one.

    rows carry _part, a range of (key, order) that a task sorts: a key with a third of all rows is spread over many. A running value
    covers a range, and what it takes over from the ranges before comes from one row for each range that a key goes on into,
    so these are no more than the ranges.
    """
    turn = lambda c: F.col(c).desc() if back else F.col(c).asc()
    within = W.partitionBy(key, "_part").orderBy(*[turn(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
    here = rows.select("*", *[F.last(c, ignorenulls=True).over(within).alias(n) for n, c in last.items()])
    edge = F.max_by if not back else F.min_by
    place = F.struct(*order)
    ends = rows.groupBy(key, "_part").agg(*[edge(c, F.when(c.isNotNull(), place)).alias(n) for n, c in last.items()])
    over = W.partitionBy(key).orderBy(turn("_part")).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(key, "_part", F.count("*").over(W.partitionBy(key)).alias("_parts"), *[F.last(n, ignorenulls=True).over(over).alias(f"_{n}") for n in last]).where("_parts > 1").drop("_parts")
    joined = here.join(F.broadcast(carried), [key, "_part"], "left")
    return joined.select(*rows.columns, *[F.coalesce(n, f"_{n}").alias(n) for n in last])


def ranged(rows: DataFrame, key: str, order: list[str], ranges: int | None = None) -> DataFrame:
    """rows, written in ranges of (key, order), with the number of their range as _part."""
    dealt = rows.repartitionByRange(ranges, key, *order) if ranges else rows.repartitionByRange(key, *order)
    return checkpointed(dealt.withColumn("_part", F.spark_partition_id()))


def next_leads(asking: DataFrame, reads: DataFrame, ranges: int | None = None) -> DataFrame:
    """asking(k, id, opens), reads(k, at, id) to (id, next): the first read of the key, in order of (at, id), at or after `opens`; next is null where there is none."""
    asks = asking.select("k", F.col("opens").alias("at"), F.lit(None).cast("long").alias("id"), F.col("id").alias("of"))
    both = ranged(reads.select("k", "at", "id", F.lit(None).cast("long").alias("of")).unionByName(asks), "k", ["at", "id"], ranges)
    found = lasting(both, "k", ["at", "id"], {"next": F.when(F.col("of").isNull(), F.col("id"))}, back=True)
    return found.where("of is not null").select(F.col("of").alias("id"), "next")


def reached(first: DataFrame, next_of: DataFrame) -> DataFrame:
    """first(id) and pointers next_of(id, next) to all ids that the first ones lead to, by doubling.

    Only ids that something points to, or that are first, can be reached, so pointers start from these. After k rounds the ids
    of the first 2 ** k steps are known and pointers span 2 ** k steps; it ends when no pointer starts from a known id.
    """
    starts = next_of.where("next is not null").select(F.col("next").alias("id")).unionByName(first.select("id")).distinct()
    jump = checkpointed(next_of.where("next is not null").join(starts, "id", "left_semi"))
    known = checkpointed(first.select("id"))
    while True:
        more = checkpointed(jump.join(known, "id", "left_semi").select(F.col("next").alias("id")).join(known, "id", "left_anti").distinct())
        if more.isEmpty():
            return known
        known = checkpointed(known.unionByName(more), replaces=known)
        jump = checkpointed(jump.join(jump.select(F.col("id").alias("next"), F.col("next").alias("further")), "next").select("id", F.col("further").alias("next")), replaces=jump)


def flights(reads: DataFrame, life: int = LIFE, ranges: int | None = None) -> DataFrame:
    """reads(k, at, id, takes, ok) to (k, at, id, role, lead, answered, good): what each read of a proxy with one upstream read a key at a time gets.

    at and takes are whole milliseconds. A read that finds neither an answer nor an equal read under way leads: it goes upstream and takes its
    time. Reads of its key before it ends wait and get its answer at its end, or its failure. An answer is cached for `life` from its end
    on; reads until then are hits, answered at once. A failed lead leaves nothing, so the next read from its end on leads again.

    role is 'lead', 'wait' or 'hit', lead the id of the read that went upstream, answered when its answer came. Equal times are in order of id.
    The next lead after a lead is the first read of the key at or after the end of its flight, or of its answer's life: an as-of join for
    every read, after which pointers from the first read of each key are doubled. Sorting is by ranges of key and time, so a frequent key is
    no task of its own; `ranges` is their number, which Spark chooses otherwise.

    Reads without a key, a time, a duration or an outcome, or with a negative duration, go upstream by themselves: role 'lead', answered after
    their duration if they have one, good null if no outcome. ids are unique; no reads give no rows.
    """
    rows = reads.select("k", F.col("at").cast("long").alias("at"), F.col("id").cast("long").alias("id"), F.col("takes").cast("long").alias("takes"), "ok")
    whole = F.col("k").isNotNull() & F.col("at").isNotNull() & F.col("ok").isNotNull() & F.coalesce(F.col("takes") >= 0, F.lit(False))
    ends = F.col("at") + F.col("takes")
    sound = rows.where(whole).select("*", ends.alias("ends"))
    # a flight of no time ends as it begins, and the next read leads if it failed: it opens after this one
    sound = checkpointed(sound.withColumn("opens", F.col("ends") + F.when(F.col("ok"), F.lit(life)).otherwise(0)))
    longer = sound.withColumn("opens", F.greatest("opens", F.col("at")))
    instant = longer.where("opens = at")
    pointers = next_leads(longer.where("opens > at"), sound, ranges).unionByName(_followers(sound, instant, ranges))
    first = sound.groupBy("k").agg(F.min_by("id", F.struct("at", "id")).alias("id"))
    leads = reached(first, pointers).withColumn("leads", F.lit(True))
    marked = ranged(sound.join(leads, "id", "left"), "k", ["at", "id"], ranges)
    lead = F.when(F.col("leads"), F.struct("id", "ends", "ok"))
    seen = lasting(marked, "k", ["at", "id"], {"lead": lead})
    role = F.when(F.col("leads"), "lead").when(F.col("at") < F.col("lead.ends"), "wait").otherwise("hit")
    shared = seen.select("k", "at", "id", role.alias("role"), F.col("lead.id").alias("lead"), F.greatest(F.col("lead.ends"), F.col("at")).alias("answered"), F.col("lead.ok").alias("good"))
    alone = rows.where(~F.coalesce(whole, F.lit(False))).select("k", "at", "id", F.lit("lead").alias("role"), F.col("id").alias("lead"), F.when(F.col("takes") >= 0, ends).alias("answered"), F.col("ok").alias("good"))
    return shared.unionByName(alone)


def _followers(sound: DataFrame, instant: DataFrame, ranges: int | None) -> DataFrame:
    """(id, next) of failed reads that take no time: the read after each."""
    if instant.isEmpty():
        return sound.sparkSession.createDataFrame([], "id long, next long")
    rows = ranged(sound.select("k", "at", "id", (F.col("opens") <= F.col("at")).alias("asks")), "k", ["at", "id"], ranges)
    over = W.partitionBy("k", "_part").orderBy("at", "id")
    here = rows.select("*", F.lead("id").over(over).alias("next"))
    firsts = rows.groupBy("k", "_part").agg(F.min_by("id", F.struct("at", "id")).alias("head"))
    heads = firsts.select("k", "_part", F.lead("head").over(W.partitionBy("k").orderBy("_part")).alias("head")).where("head is not null")
    joined = here.where("asks").join(F.broadcast(heads), ["k", "_part"], "left")
    return joined.select("id", F.coalesce("next", "head").alias("next"))


def upstream_reads(found: DataFrame) -> DataFrame:
    """flights to (k, leads, waits, hits, failed): the reads of each key by what they got; failed counts all that got a failure."""
    count = lambda role: F.count_if(F.col("role") == role)
    return found.groupBy("k").agg(count("lead").alias("leads"), count("wait").alias("waits"), count("hit").alias("hits"), F.count_if(~F.col("good")).alias("failed"))

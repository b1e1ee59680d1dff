"""Chains of evenly spaced places: of candidates along an axis, those with most weight less a penalty for leaving the pitch."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.operators.flights import reached
from quillmatch.operators.match import checkpointed

#: Gaps that a chain may have, in pitches; what a skipped place costs, and what a penalty of one pitch costs, in greatest weights.
SHORTEST, LONGEST, SKIP, COST = 0.62, 2.4, 0.12, 0.6


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of stretch and place, each with the score of the best chain that ends there and the candidate before it.

    Only the candidates within the longest gap are kept.
    """
    held, near = None, deque()
    for pdf in batches:
        scores, before, steps = [], [], []
        for id, key, stretch, at, weight, pitch, top in pdf[["id", "key", "stretch", "at", "weight", "pitch", "top"]].itertuples(index=False, name=None):
            if (key, stretch) != held:
                held = key, stretch
                near.clear()
            while near and at - near[0][1] > LONGEST * pitch:
                near.popleft()
            score, prev, step = weight, None, 0
            for j, place, reach in near:
                gap = at - place
                if gap < SHORTEST * pitch:
                    break
                k = max(1, min(2, int(gap / pitch + 0.5)))
                found = reach + weight - (abs(gap - k * pitch) / pitch + SKIP * (k - 1)) * COST * top
                if found > score:
                    score, prev, step = found, j, k
            near.append((id, at, score))
            scores.append(score)
            before.append(prev)
            steps.append(step)
        yield pd.DataFrame({"id": pdf["id"], "score": pd.Series(scores, dtype="float64"), "prev": pd.array(before, dtype="Int64"), "step": pd.Series(steps, dtype="int32")})


def best_chains(candidates: DataFrame, pitch: str, least: int = 1) -> DataFrame:
    """candidates(key, at, weight, <pitch>) to (key, seq, at, made, score): the best chain of each key, in order.

    A chain's score is the sum of its weights less, for each gap, what it departs from one or two pitches, and something for a place
    left out; gaps lie between SHORTEST and LONGEST pitches. Of equal scores the chain that ends first counts, and of equal ways to a
    candidate the one from the earlier candidate. A gap of two pitches gets the place between made up (`made`). The pitch is a column, or a
    number as SQL.

    Where candidates lie more than the longest gap apart no chain goes on, so each stretch between such gaps is scored by itself, in a stream that
    keeps the last few candidates. Chains are then read back by doubling pointers, not in one task.

    Of candidates of one place the heaviest counts; rows with nulls, a NaN or a pitch of nought or less are none. A key with fewer than `least`
    candidates has no chain; no rows give none.
    """
    rows = candidates.select("key", F.col("at").cast("double").alias("at"), F.col("weight").cast("double").alias("weight"), F.expr(pitch).cast("double").alias("pitch")).dropna().where("pitch > 0 and not isnan(at) and not isnan(weight)")
    rows = rows.groupBy("key", "at").agg(F.max_by(F.struct("weight", "pitch"), F.struct("weight", "pitch")).alias("b")).select("key", "at", "b.*")
    tops = rows.groupBy("key").agg(F.max("weight").alias("top"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    order = W.partitionBy("key").orderBy("at")
    far = F.coalesce((F.col("at") - F.lag("at").over(order) > LONGEST * F.col("pitch")).cast("int"), F.lit(0))
    rows = rows.withColumn("_far", far).withColumn("stretch", F.sum("_far").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_far")
    rows = checkpointed(rows.join(tops, "key").withColumn("id", F.monotonically_increasing_id()))
    dealt = rows.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "at")
    scored = checkpointed(dealt.mapInPandas(_scored, "id long, score double, prev long, step int"))
    placed = rows.select("key", "at", "id").join(scored, "id")
    ends = placed.groupBy("key").agg(F.max_by("id", F.struct("score", -F.col("at"))).alias("id"), F.max("score").alias("score"))
    taken = reached(ends.select("id"), scored.select("id", F.col("prev").alias("next")))
    chain = placed.join(taken, "id", "left_semi").join(ends.select("key", F.col("score").alias("best")), "key")
    before = F.lag("at").over(order)
    pairs = chain.select("key", F.col("best").alias("score"), F.when(F.col("step") == 2, F.array((F.col("at") + before) / 2, "at")).otherwise(F.array("at")).alias("places"), F.col("at").alias("own"))
    out = pairs.select("key", "score", "own", F.explode("places").alias("at"))
    return out.select("key", F.row_number().over(order).alias("seq"), "at", (F.col("at") != F.col("own")).alias("made"), "score")

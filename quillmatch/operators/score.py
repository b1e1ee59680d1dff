"""States, scores and re-scoring with overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.numbers import round_up_half


def plain(answer: Column) -> Column:
    return F.upper(F.trim(F.coalesce(answer, F.lit(""))))


def state(matched: Column, correct: Column, mine: Column) -> Column:
    """An answer to a question whose key is empty is wrong; a question without a key is unmatched."""
    given, correct = plain(mine), plain(correct)
    return F.when(~matched, "unmatched").when(given == "", "blank").when(given == correct, "correct").otherwise("wrong")


def result_rows(paper: DataFrame, assigned: DataFrame, keys: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per question with its key answer, the given answer and its state."""
    rows = paper.join(assigned, ["match_id", "p_idx"], "left")
    rows = rows.join(keys.select("match_id", "k_idx", F.col("no").alias("key_no"), "answer"), ["match_id", "k_idx"], "left")
    rows = rows.join(answers, ["match_id", "p_idx"], "left")
    matched = F.col("k_idx").isNotNull()
    return rows.select(
        "match_id", "p_idx", "no", "key_no", plain(F.col("answer")).alias("correct"), plain(F.col("mine")).alias("mine"),
        state(matched, F.col("answer"), F.col("mine")).alias("state"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("method", F.lit("")).alias("method"),
    )


def totals(rows: DataFrame, right: float = 1.0, wrong: float = 0.0, total: float | None = None) -> DataFrame:
    """Counts and scores of each match. A mark of 0 per right answer means 1; the sign of the penalty does not matter."""
    right = right or 1.0
    counts = rows.groupBy("match_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in ("correct", "wrong", "blank", "unmatched")]
    )
    most = F.lit(float(total)) if total is not None else F.col("total") * F.lit(right)
    exact = F.col("correct") * F.lit(float(right)) - F.col("wrong") * F.lit(float(abs(wrong)))
    out = counts.withColumn("score", round_up_half(exact, 2)).withColumn("max", most)
    share = F.when(F.col("max") > 0, round_up_half(exact / F.col("max") * 100, 1)).otherwise(F.lit(0.0))
    return out.withColumn("matched", F.col("total") - F.col("unmatched")).withColumn("percent", share)


def overridden(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rows with an override get their key and state anew, unmatched ones too; an empty override is a blank. The others stay."""
    out = rows.join(overrides, ["match_id", "p_idx"], "left").withColumn("override", F.upper("override"))
    anew = F.when((F.col("override") == "") | (F.col("mine") == ""), "blank").when(F.col("override") == F.col("mine"), "correct").otherwise("wrong")
    out = out.withColumn("state", F.when(F.col("override").isNotNull(), anew).otherwise(F.col("state")))
    return out.withColumn("correct", F.coalesce("override", "correct")).drop("override")

"""Roll-ups and lists over result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.functions.numbers import round_up_half
from quillmatch.functions.text import preview

# Subjects and the words that put a question there; the first that hits wins.
BUCKETS = [
    ("Mathematics", r"\d|\+|-|×|x |sum|hcf|lcm|average|percent|profit|simple interest|ratio|number|square|angle|age of|:.*="),
    ("Science", r"planet|gas|vitamin|acid|oxygen|water|gravity|sound|light|energy|atmosphere|crop|disease|blood|heat|force|atom|cell"),
    ("English", r"grammar|tense|synonym|antonym|article|preposition|sentence|vocabulary|passage|word|phrase"),
    (
        "Social Science",
        r"river|state|capital|constitution|article|dynasty|battle|governor|president|prime minister|slogan|wrote|founder|district|desert|reef|railway|currency|"
        r"national|discovered|constitution|yoga|established|lives|passed|known as|who |which (state|river|city|country|article|instrument|layer|is the largest|platform)",
    ),
]


def bucket(question: Column) -> Column:
    out = F
    for name, pattern in BUCKETS:
        out = out.when(question.rlike("(?i)" + pattern), name)
    return out.otherwise("Other")


def subjects(rows: DataFrame) -> DataFrame:
    """rows(match_id, question, state) to (match_id, subject, total, correct, percent)."""
    out = rows.groupBy("match_id", bucket(F.coalesce("question", F.lit(""))).alias("subject"))
    out = out.agg(F.count("*").alias("total"), F.count_if(F.col("state") == "correct").alias("correct"))
    return out.withColumn("percent", round_up_half(100 * F.col("correct") / F.col("total")))


def headline(totals: DataFrame) -> DataFrame:
    """(match_id, accuracy, percent): right answers of those given, and the score of the most possible, both in whole percent."""
    given = F.col("correct") + F.col("wrong")
    accuracy = F.when(given > 0, round_up_half(100 * F.col("correct") / given)).otherwise(F.lit(0.0))
    percent = F.when(F.col("max") > 0, round_up_half(100 * F.col("score") / F.col("max"))).otherwise(F.lit(0.0))
    return totals.select("match_id", accuracy.alias("accuracy"), percent.alias("percent"))


def wrong_list(rows: DataFrame) -> DataFrame:
    """Questions that were answered wrongly or not at all."""
    return rows.where(F.col("state").isin("wrong", "blank"))


def page(rows: DataFrame, by: list[str], number: int, size: int = 25) -> DataFrame:
    """One page of each match's rows; size 0 is all, and a page beyond the last is the last."""
    if size == 0:
        return rows
    keyed = rows.withColumn("_k", F.row_number().over(W.partitionBy("match_id").orderBy(*by))).withColumn("_n", F.count("*").over(W.partitionBy("match_id")))
    at = F.least(F.lit(number), F.ceil(F.col("_n") / size))
    return keyed.where((F.col("_k") > (at - 1) * size) & (F.col("_k") <= at * size)).drop("_k", "_n")


def short_list(rows: DataFrame) -> DataFrame:
    return rows.withColumn("preview", preview(F.col("question")))


def confidence_tag(confidence: Column, method: Column) -> Column:
    """What a table shows beside a match that needs a look; empty where it needs none."""
    clear = (confidence == 0) | (method == "same-number") | (confidence >= 0.72)
    return F.when(clear, "").otherwise(F.concat(F.lit("check ~"), F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%")))


def coverage(rows: DataFrame) -> DataFrame:
    """(match_id, matched, with_answer, low): how far the matching went, and how much of it is doubtful."""
    low = (F.col("confidence") > 0) & (F.col("confidence") < 0.55)
    return rows.groupBy("match_id").agg(
        F.count_if(F.col("state") != "unmatched").alias("matched"), F.count_if(F.col("correct") != "").alias("with_answer"), F.count_if(low).alias("low")
    )


def letters(rows: DataFrame, least: int = 4) -> DataFrame:
    """(match_id, letters): how many options the sheet has: those printed, or more where a later letter occurs."""
    code = lambda c: F.when(F.col(c).rlike("^[A-H]$"), F.ascii(c) - 64)
    return rows.groupBy("match_id").agg(F.greatest(F.max(code("correct")), F.max(code("mine")), F.lit(least)).alias("letters"))


def alphabet(correct: Column, mine: Column, options: Column, sheet_letters: int | None = None) -> Column:
    """The answers that a row offers: digits where its answers are digits, the sheet's letters, or as many letters as options are numbered."""
    letters = F.array(*[F.lit(c) for c in "ABCDEFGH"])
    digits = F.array(*[F.lit(c) for c in "12345"])
    digit = lambda c: F.coalesce(c.rlike("^[0-9]$"), F.lit(False))
    printed = F.array_join(F.coalesce(options, F.array().cast("array<string>")), " ")
    numbered = F.regexp_count(printed, F.lit(r"\(\s*[1-5]\s*\)"))
    if sheet_letters:
        return F.when(digit(correct) | digit(mine), digits).otherwise(F.slice(letters, 1, min(8, sheet_letters)))
    few = (numbered > 0) & ~printed.rlike(r"[A-Ha-h]\s*[).:]\s*\S")
    return F.when(digit(correct), digits).when(few, F.slice(letters, F.lit(1), F.greatest(F.lit(2), F.least(F.lit(5), numbered)))).otherwise(F.slice(letters, 1, 5))


def weak_read(role: Column, found: Column, pages: Column, badness: Column, paper: Column) -> Column:
    """Whether a document's reading is so poor that it is worth another: too few items, for its pages or the paper, or broken Hindi."""
    second = (found < 4) | (found < paper * 0.7)
    first = (found < 6) | ((pages >= 3) & (found < pages * 1.5)) | F.coalesce(badness > 0.06, F.lit(False))
    return F.when(role == "key2", second).otherwise(first)


def adopt_read(found: Column, before: Column, badness: Column) -> Column:
    """Whether a second reading takes the first one's place: it found more, or nearly as much where the first one's Hindi is broken."""
    return (found > before) | (F.coalesce(badness > 0.06, F.lit(False)) & (found >= before * 0.9) & (found >= 4))

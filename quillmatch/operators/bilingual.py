"""Two languages in one print: glued columns cut apart, options and questions that come twice folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.functions import text as X

#: A cut may misplace so many letters, each half must have so many of its own, and so many cut lines make a two-column print.
MISPLACED, OWN, GLUED = 3, 6, 8


def cut_line(line: Column) -> Column:
    """(side, left, right): where a line is Hindi and then English, its halves; else its script, null without letters of either.

    One pass over the words keeps the cheapest cut so far: Latin letters before it and Devanagari ones after it, and two more where
    the left half ends in a number, which belongs to what follows. The first of equal cuts is taken.
    """
    words = F.filter(F.split(F.coalesce(line, F.lit("")), " "), lambda w: w.rlike(r"\S"))
    dev, lat = X.count_of(line, X.DEVANAGARI), X.count_of(line, X.LATIN)
    start = F.struct(
        F.lit(0).alias("k"), F.lit(0).alias("lat"), F.lit(0).alias("dev"), F.lit("").alias("last"),
        F.lit(1 << 30).alias("cost"), F.lit(0).alias("at"), F.struct(F.lit(0).alias("dev"), F.lit(0).alias("lat")).alias("own"),
    )

    def step(a: Column, w: Column) -> Column:
        number = a["last"].rlike(r"[0-9०-९] ?[).:॰]?$")
        cost = F.when(a["k"] == 0, 1 << 30).otherwise(a["lat"] + dev - a["dev"] + F.when(number, 2).otherwise(0))
        better = cost < a["cost"]
        return F.struct(
            (a["k"] + 1).alias("k"), (a["lat"] + X.count_of(w, X.LATIN)).alias("lat"), (a["dev"] + X.count_of(w, X.DEVANAGARI)).alias("dev"),
            F.when(w.rlike(r"^[).:॰]$"), F.concat(F.substring(a["last"], -1, 1), F.lit(" "), w)).otherwise(w).alias("last"),
            F.when(better, cost).otherwise(a["cost"]).alias("cost"), F.when(better, a["k"]).otherwise(a["at"]).alias("at"),
            F.when(better, F.struct(a["dev"].alias("dev"), (lat - a["lat"]).alias("lat"))).otherwise(a["own"]).alias("own"),
        )

    best = F.aggregate(words, start, step)
    cut = (dev > 0) & (lat > 0) & (best["cost"] <= MISPLACED) & (best["own"]["dev"] >= OWN) & (best["own"]["lat"] >= OWN)
    side = F.when(dev > lat, "hi").when(lat > 0, "en")
    part = lambda first, n: F.when(cut, F.array_join(F.slice(words, first, n), " "))
    return F.struct(
        F.when(~cut, side).alias("side"), part(F.lit(1), best["at"]).alias("left"), part(best["at"] + 1, F.greatest(F.size(words) - best["at"], F.lit(0))).alias("right")
    )


def split_scripts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (doc_id, text): all Hindi halves, then all English ones, where GLUED lines or more are glued.

    A line without letters goes with the last line before it that is of one script, or else with the English ones.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"\S"))
    lines = lines.withColumn("_cut", cut_line(F.col("line")))
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    side = F.coalesce(F.last(F.col("_cut.side"), ignorenulls=True).over(before), F.lit("en"))
    halves = lines.withColumn("_side", side).withColumn("_glued", F.col("_cut.left").isNotNull())
    halves = halves.select(
        "doc_id", "pos", "_glued",
        F.when(F.col("_glued"), F.col("_cut.left")).when(F.col("_side") == "hi", F.col("line")).alias("hi"),
        F.when(F.col("_glued"), F.col("_cut.right")).when(F.col("_side") == "en", F.col("line")).alias("en"),
    )
    column = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("pos", c)))), lambda x: x[c]), "\n")
    made = halves.groupBy("doc_id").agg(F.count_if("_glued").alias("_n"), F.concat(column("hi"), F.lit("\n"), column("en")).alias("_text"))
    both = docs.join(made, "doc_id", "left")
    return both.select("doc_id", X.join_devanagari(F.when(F.col("_n") >= GLUED, F.col("_text")).otherwise(F.col("text"))).alias("text"))


def fold_option(body: Column, letter: Column) -> Column:
    """An option that is printed again under its letter, as one: both languages, or one copy where they read the same."""
    mark = F.concat(F.lit(r"\(\s*"), letter, F.lit(r"\s*\)\s*"))
    parts = F.split(body, mark, 2)
    first, second = F.trim(F.get(parts, 0)), F.trim(F.get(parts, 1))
    same = (second == "") | (X.normalize(first) == X.normalize(second))
    return F.when(F.size(parts) < 2, body).when(same, first).otherwise(F.regexp_replace(F.concat(first, F.lit(" "), second), r"\s+", " "))


def own_number_split(no: Column, text: Column) -> Column:
    """(text, alt) of a question in whose text its own number comes again, ten characters in or later, between two scripts; else null."""
    mark = F.concat(F.lit("(?:^|[^0-9.])"), no.cast("string"), F.lit(r"\s*[).:]\s"))
    at = F.regexp_instr(text, mark)
    left, right = F.trim(F.substring(text, F.lit(1), at)), F.trim(F.regexp_replace(F.substring(text, at + 1, F.length(text)), r"^[0-9]+\s*[).:]\s*", ""))
    solid = lambda c: F.length(F.regexp_replace(c, r"\s", "")) >= 6
    english = X.script(left) == "en"
    fits = (at >= 10) & solid(left) & solid(right) & (X.script(left) != X.script(right))
    return F.when(fits, F.struct(F.when(english, left).otherwise(right).alias("text"), F.when(english, right).otherwise(left).alias("alt")))

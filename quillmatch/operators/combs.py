"""Columns of marks: how far a block of them leans, and the evenly spaced comb that fits it.

Marks are rows (page_id, block, x, y) in whole units; pages and blocks are groups of a few hundred at most, and any number of them is
tried at once: candidates are rows, a fit is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Leans that are tried, in ten-thousandths of a column for each row, and the marks that a block needs for its own.
LEANS, MARKS = range(-600, 1001, 25), 6
#: A gap between marks counts up to this share of the pitch.
GAP = 0.4
#: Pitches and first teeth that are tried, in row pitches; the step between first teeth in units; half the width of a tooth.
PITCHES, STEP = [0.72 + 0.04 * k for k in range(19)], 1.5
BEFORE, AFTER, ENDS, TOOTH = 1.55, 1.2, 1.35, 0.18
#: Reach of a tooth for a mark, in its own pitch and in row pitches; the share of marks, and their number, that may be out of reach.
OWN_REACH, ROW_REACH, LOST, FEW = 0.5, 0.55, 0.25, 2
#: Blocks stand at even distances: at least so many pitches, and none further than this share from the middle one.
APART, UNEVEN = 1.5, 0.45


def leans(marks: DataFrame, ends: DataFrame, pitch: int) -> DataFrame:
    """marks(page_id, block, x, y), ends(page_id, y0, y1) to (page_id, block, n, mean_x, lean): ten-thousandths of a column that a block's columns lean for each row.

    Of the leans tried, the one that packs the marks tightest once straightened about the middle between the page's first and last row: the sum
    of gaps between neighbours, each up to GAP pitches, is least; the first on ties. All in whole numbers. Blocks of fewer than MARKS
    marks, and pages without ends, have no row; marks with nulls are none; equal marks count each. A block's marks are gathered once, and the
    leans tried on them where they lie: a row for each mark and lean would be 65 times the marks to shuffle and sort.
    """
    rows = marks.select("page_id", "block", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).dropna()
    rows = rows.join(ends.select("page_id", (F.col("y0") + F.col("y1")).cast("long").alias("twice")).dropna(), "page_id")
    blocks = rows.groupBy("page_id", "block").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.collect_list(F.struct("x", "y", "twice")).alias("marks")).where(F.col("n") >= MARKS)
    at = lambda lean: F.sort_array(F.transform("marks", lambda p: 20_000 * p["x"] - lean * (2 * p["y"] - p["twice"])))
    gap = lambda places, k: F.least(F.get(places, k) - F.get(places, k - 1), F.lit(int(GAP * pitch * 20_000)).cast("long"))
    cost = lambda places: F.aggregate(F.sequence(F.lit(1), F.size(places) - 1), F.lit(0).cast("long"), lambda total, k: total + gap(places, k))
    tries = F.array(*[F.lit(k) for k in LEANS])
    # the array of one gives the sorted places a name, so that they are sorted once for each lean
    tried = F.transform(tries, lambda lean: F.get(F.transform(F.array(at(lean)), lambda places: F.struct(cost(places).alias("cost"), lean.alias("lean"))), 0))
    best = blocks.select("page_id", "block", "n", "sum_x", F.array_min(tried).alias("b"))
    return best.select("page_id", "block", "n", (F.col("sum_x") / F.col("n")).alias("mean_x"), F.col("b.lean").alias("lean"))


def upright(marks: DataFrame, found: DataFrame, ends: DataFrame) -> DataFrame:
    """marks with x moved back by their block's lean; blocks without one stay as they are."""
    rows = marks.join(found.select("page_id", "block", F.col("lean").alias("_lean")), ["page_id", "block"], "left").join(ends.select("page_id", ((F.col("y0") + F.col("y1")) / 2).alias("_mid")), "page_id", "left")
    moved = F.col("x") - F.coalesce(F.col("_lean") / 10_000 * (F.col("y") - F.col("_mid")), F.lit(0.0))
    return rows.withColumn("x", moved).select(marks.columns)


def _window(profile: DataFrame, spots: DataFrame) -> DataFrame:
    """spots(page_id, lo, hi, ...) and ink: the profile's sum from lo to hi, by two look-ups in its running sum. Beyond the profile there is nothing."""
    upto = profile.groupBy("page_id", "x").agg(F.sum("v").alias("v")).select("page_id", "x", F.sum("v").over(W.partitionBy("page_id").orderBy("x")).alias("upto"))
    edges = profile.groupBy("page_id").agg(F.min("x").alias("_first"), F.max("x").alias("_last"))
    rows = spots.join(edges, "page_id").withColumn("_a", F.greatest("lo", "_first") - 1).withColumn("_b", F.least("hi", "_last"))
    low, high = upto.select("page_id", F.col("x").alias("_a"), F.col("upto").alias("_low")), upto.select("page_id", F.col("x").alias("_b"), F.col("upto").alias("_high"))
    rows = rows.join(low, ["page_id", "_a"], "left").join(high, ["page_id", "_b"], "left")
    ink = F.when(F.col("_b") > F.col("_a"), F.col("_high") - F.coalesce("_low", F.lit(0))).otherwise(F.lit(0))
    return rows.withColumn("ink", ink).drop("_a", "_b", "_first", "_last", "_low", "_high")


def rounded(c: Column) -> Column:
    """Halves go up."""
    return F.floor(c + 0.5)


def combs(profile: DataFrame, marks: DataFrame, pitch: float, teeth: int) -> DataFrame:
    """profile(page_id, x, v), every x of a stretch, and marks(page_id, block, x) to (page_id, block, first, pitch, ink, explained, n): the comb of each block.

    Combs of `teeth` evenly spaced columns are tried whose first tooth lies near the block's leftmost mark and whose last near its rightmost;
    of eight marks or more, the outer tenths are strays and don't bound it. A comb explains the marks in reach of a tooth. Of those that
    leave at most a quarter (or two) unexplained, the one on most ink counts; where none does, of all; the first tried on ties. Blocks
    whose combs all miss their ends, or stand on no ink, have no row; marks with nulls are none.
    """
    rows = marks.select("page_id", "block", F.col("x").cast("double").alias("x")).dropna()
    spans = rows.groupBy("page_id", "block").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    size = F.size("xs")
    inner = lambda share: F.get("xs", F.when(size >= 8, F.floor(share * (size - 1))).otherwise(F.when(F.lit(share < 0.5), 0).otherwise(size - 1)).cast("int"))
    spans = spans.select("page_id", "block", size.alias("n"), inner(0.1).alias("low"), inner(0.9).alias("high"))
    steps = int((BEFORE + AFTER) * pitch / STEP + 1e-9)
    tries = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(p * pitch).alias("pitch")) for i, p in enumerate(PITCHES)])
    each = spans.select("*", F.explode(tries).alias("t")).select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("j"))
    each = each.select("page_id", "block", "n", "high", (F.col("t.turn") * (steps + 1) + F.col("j")).alias("turn"), F.col("t.pitch").alias("pitch"), (F.col("low") - BEFORE * pitch + F.col("j") * STEP).alias("first"))
    last = F.col("first") + (teeth - 1) * F.col("pitch")
    each = each.where((last >= F.col("high") - ENDS * pitch) & (last <= F.col("high") + ENDS * pitch)).drop("high")
    spots = each.select("page_id", "block", "turn", F.explode(F.sequence(F.lit(0), F.lit(teeth - 1))).alias("k"), "first", "pitch")
    at = F.col("first") + F.col("k") * F.col("pitch")
    spots = spots.select("page_id", "block", "turn", rounded(at - TOOTH * pitch).cast("int").alias("lo"), rounded(at + TOOTH * pitch).cast("int").alias("hi"))
    inks = _window(profile.select("page_id", F.col("x").cast("int").alias("x"), "v").dropna(), spots).groupBy("page_id", "block", "turn").agg(F.sum("ink").alias("ink"))
    nearest = F.greatest(F.lit(0), F.least(F.lit(teeth - 1), rounded((F.col("x") - F.col("first")) / F.col("pitch"))))
    reach = F.least(OWN_REACH * F.col("pitch"), F.lit(ROW_REACH * pitch))
    met = F.abs(F.col("x") - (F.col("first") + nearest * F.col("pitch"))) <= reach
    met_by = each.join(rows, ["page_id", "block"]).groupBy("page_id", "block", "turn").agg(F.count_if(met).alias("explained"))
    every = each.join(inks, ["page_id", "block", "turn"]).join(met_by, ["page_id", "block", "turn"])
    fits = F.col("n") - F.col("explained") <= F.greatest(F.lit(FEW), rounded(LOST * F.col("n")))
    best = every.groupBy("page_id", "block").agg(F.max(F.struct(fits.alias("fits"), "ink", (-F.col("turn")).alias("turn"), "first", "pitch", "explained", "n")).alias("b"))
    return best.where("b.ink > 0").select("page_id", "block", "b.first", "b.pitch", "b.ink", "b.explained", "b.n")


def even_pages(found: DataFrame, blocks: DataFrame, pitch: float) -> DataFrame:
    """combs and blocks(page_id, block), all there are, to (page_id): pages each of whose blocks has a comb, at even distances from one another: near the middle gap, of two the greater."""
    both = blocks.select("page_id", "block").distinct().join(found.select("page_id", "block", "first"), ["page_id", "block"], "left")
    gaps = both.withColumn("gap", F.col("first") - F.lag("first").over(W.partitionBy("page_id").orderBy("block")))
    pages = gaps.groupBy("page_id").agg(F.bool_and(F.col("first").isNotNull()).alias("whole"), F.sort_array(F.collect_list("gap")).alias("gaps"))
    n = F.size("gaps")
    middle = F.get("gaps", F.floor(n / 2).cast("int"))
    even = (n == 0) | ((middle >= APART * pitch) & F.forall("gaps", lambda g: F.abs(g - middle) <= UNEVEN * middle))
    return pages.where(F.col("whole") & even).select("page_id")

"""Ink and tilt of grey pages as relations: local brightness by running sums, masks of what is darker than the paper around it, the shear that makes lines sharpest.

A page is its cells, rows (page_id, y, x, grey) of whole numbers, a full rectangle of them; any number of pages at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.operators import sequence
from quillmatch.operators.match import checkpointed

#: Shares of the local brightness, in hundredths, below which a cell is ink: the pen alone, the pen and light marks, print.
TIGHT, LIGHT, PRINT = 72, 80, 84
#: A cell counts where the paper around it has over so many tenths of the brightness that a quarter of the page reaches.
GATE, BRIGHT = 6, 0.75
#: Greatest tilt, and the steps of the two searches, in thousandths; a tilt of less than the last step is none.
TILT, COARSE, FINE = 90, 10, 2


def _along(rows: DataFrame, axis: str, across: str, reach: int, sums: list[str]) -> DataFrame:
    """Each column of `sums` summed over the cells at most `reach` before and after along the axis: two look-ups in its running sum."""
    line = W.partitionBy("page_id", across).orderBy(axis)
    whole = W.partitionBy("page_id", across)
    upto = {c: F.sum(c).over(line.rowsBetween(W.unboundedPreceding, 0)) for c in sums}
    rows = rows.select("*", *[e.alias(f"_{c}") for c, e in upto.items()], *[F.sum(c).over(whole).alias(f"_all_{c}") for c in sums])
    box = lambda c: F.coalesce(F.lead(f"_{c}", reach).over(line), f"_all_{c}") - F.coalesce(F.lag(f"_{c}", reach + 1).over(line), F.lit(0))
    kept = [c for c in rows.columns if c not in sums and not c.startswith("_")]
    return rows.select(*kept, *[box(c).alias(c) for c in sums])


def local_sums(cells: DataFrame, reach: int) -> DataFrame:
    """cells(page_id, y, x, grey) and n, s: how many cells lie within `reach` rows and columns of each, itself included, and the sum of their grey.

    A running sum along rows, then one of these along columns, so a cell costs the same whatever the reach; a page's rows and
    then its columns are the groups. Of a cell that comes twice the darkest counts; cells with nulls are none.
    """
    rows = cells.select("page_id", "y", "x", F.col("grey").cast("long").alias("grey")).dropna().groupBy("page_id", "y", "x").agg(F.min("grey").alias("grey"))
    rows = rows.withColumn("n", F.lit(1).cast("long")).withColumn("s", F.col("grey"))
    return _along(_along(rows, "x", "y", reach, ["n", "s"]), "y", "x", reach, ["n", "s"])


def ink(cells: DataFrame, reach: int) -> DataFrame:
    """cells(page_id, y, x, grey) to (page_id, y, x, tight, light, print) of the cells that are ink by the loosest measure, each a flag.

    A cell is ink if its grey lies below a share of the mean around it, so shadow and exposure cancel out, and if the paper around it is
    no desk or deep shadow: brighter than a share of the page's own brightness. All in whole numbers, so nothing is rounded.
    """
    near = checkpointed(local_sums(cells, reach))
    bright = sequence.upper_percentiles(near, "page_id", "grey", BRIGHT).withColumnRenamed("grey", "bright")
    below = lambda share: F.col("grey") * 100 * F.col("n") < F.col("s") * share
    rows = near.join(bright, "page_id").where(F.col("s") * 10 > F.col("bright") * GATE * F.col("n"))
    return rows.where(below(PRINT)).select("page_id", "y", "x", below(TIGHT).alias("tight"), below(LIGHT).alias("light"), below(PRINT).alias("print"))


def _sharpest(points: DataFrame, tilts: Column) -> DataFrame:
    """(page_id, tilt, score): the tilt of the array `tilts`, in thousandths, whose profile of rows varies most, the first on ties."""
    rows = points.select("page_id", "y", "x", "centre", F.posexplode(tilts).alias("turn", "tilt"))
    bins = rows.groupBy("page_id", "turn", "tilt", F.floor(F.col("y") + F.col("tilt") / 1000 * (F.col("x") - F.col("centre")) + 100).alias("bin")).agg(F.count("*").alias("c"))
    sums = bins.groupBy("page_id", "turn", "tilt").agg(F.count("*").alias("n"), F.sum("c").alias("s1"), F.sum(F.col("c") * F.col("c")).alias("s2"))
    score = F.col("s2") / F.col("n") - (F.col("s1") / F.col("n")) * (F.col("s1") / F.col("n"))
    best = sums.groupBy("page_id").agg(F.max(F.struct(score.alias("score"), (-F.col("turn")).alias("turn"), "tilt")).alias("b"))
    return best.select("page_id", "b.tilt", "b.score")


def tilts(points: DataFrame, widths: DataFrame, least: int = 800) -> DataFrame:
    """Cells of ink (page_id, y, x) and widths(page_id, w) to (page_id, tilt): thousandths of a row that the lines of each page sink for each column.

    The profile of rows, sheared about the page's middle, varies most where printed lines fall into rows of their own. It is tried for tilts of
    -90 to 90 by tens, then around the best by twos; each try is one histogram, all tries and pages in one aggregate. Pages with fewer
    than `least` cells of ink have no row.
    """
    some = points.groupBy("page_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rows = points.join(some.select("page_id"), "page_id", "left_semi").join(widths.select("page_id", (F.col("w") * 0.5).alias("centre")), "page_id")
    rows = checkpointed(rows.select("page_id", "y", "x", "centre"))
    first = checkpointed(_sharpest(rows, F.sequence(F.lit(-TILT), F.lit(TILT), F.lit(COARSE))).withColumnRenamed("score", "first"))
    around = F.sequence(F.col("tilt") - COARSE + 1, F.col("tilt") + COARSE - 1, F.lit(FINE))
    second = _sharpest(rows.join(first, "page_id").withColumnRenamed("tilt", "from").withColumn("tilt", F.col("from")), around).withColumnRenamed("tilt", "fine")
    best = first.join(second, "page_id").select("page_id", F.when(F.col("score") > F.col("first"), F.col("fine")).otherwise(F.col("tilt")).alias("tilt"))
    return best.select("page_id", F.when(F.abs("tilt") < FINE, 0).otherwise(F.col("tilt")).cast("int").alias("tilt"))


def straightened(points: DataFrame, found: DataFrame, widths: DataFrame) -> DataFrame:
    """Cells of ink in the page's own frame: (page_id, y, x) with y moved by the tilt, rounded to a row; pages without a tilt stay out."""
    rows = points.join(found, "page_id").join(widths.select("page_id", (F.col("w") * 0.5).alias("centre")), "page_id")
    return rows.select("page_id", F.floor(F.col("y") + F.col("tilt") / 1000 * (F.col("x") - F.col("centre")) + 0.5).cast("int").alias("y"), "x")

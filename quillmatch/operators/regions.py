"""Regions of dark cells in grids, as relations: runs along the rows, joins of touching runs, roots by pointer jumping, fill of discs.

A grid is rows (page_id, y, x) of its dark cells, of any number of pages at once; nothing holds a page in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.operators.match import checkpointed

#: Width of the stretches of a row in which runs are held against those of the next row.
STRETCH = 64


def dark_cells(pictures: DataFrame, values: str, side: int, dark: Column | None = None) -> DataFrame:
    """pictures(page_id, values), square and row by row, to their dark cells (page_id, y, x): those above nought, or for which `dark` holds of column v."""
    cells = pictures.select("page_id", F.posexplode(values).alias("at", "v")).where(F.col("v") > 0 if dark is None else dark)
    return cells.select("page_id", F.floor(F.col("at") / side).cast("int").alias("y"), (F.col("at") % side).cast("int").alias("x"))


def row_runs(cells: DataFrame) -> DataFrame:
    """(page_id, y, x0, x1): maximal stretches of dark cells along a row, ends included. A repeated cell is one; cells without a place are none."""
    rows = cells.dropna(subset=["page_id", "y", "x"])
    rank = F.dense_rank().over(W.partitionBy("page_id", "y").orderBy("x"))
    marked = rows.select("page_id", "y", "x", (F.col("x") - rank).alias("_run"))
    return marked.groupBy("page_id", "y", "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_run")


def touching(runs: DataFrame, corners: bool = True) -> DataFrame:
    """runs(id, page_id, y, x0, x1) to (a, b): runs of neighbouring rows that share a column, or touch at a corner.

    Rows are cut into stretches, so that the join is an equi-join and a long row does not meet all of the next. A pair counts in the
    stretch where the two begin to overlap.
    """
    more = 1 if corners else 0
    stretch = lambda x: F.floor(x / STRETCH)
    spread = lambda rows, a, b: rows.select("*", F.explode(F.sequence(stretch(a), stretch(b))).alias("_cell"))
    low = spread(runs.select("page_id", "y", F.col("id").alias("a"), (F.col("x0") - more).alias("a0"), (F.col("x1") + more).alias("a1")), F.col("a0"), F.col("a1"))
    high = spread(runs.select("page_id", (F.col("y") - 1).alias("y"), F.col("id").alias("b"), "x0", "x1"), F.col("x0"), F.col("x1"))
    hit = low.join(high, ["page_id", "y", "_cell"]).where((F.col("x0") <= F.col("a1")) & (F.col("x1") >= F.col("a0")))
    return hit.where(F.col("_cell") == stretch(F.greatest("a0", "x0"))).select("a", "b")


def roots(links: DataFrame) -> DataFrame:
    """links(a, b) to (id, root): the least id of each one's component, for all that have a link.

    Every id points to one no greater. In a round it learns the least id that its neighbours' pointers lead to, hands it to the id
    that it points to itself, and jumps to where its pointer leads. Rounds grow with the logarithm of a component's size; each is
    three joins over the links, and is written.
    """
    both = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    tree = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")))
    while True:
        far = tree.select("a", "to").join(tree.select(F.col("a").alias("to"), F.col("to").alias("far")), "to")
        around = both.join(far.select(F.col("a").alias("b"), "far"), "b").groupBy("a").agg(F.min("far").alias("near"))
        seen = far.join(around, "a")
        told = seen.groupBy(F.col("to").alias("a")).agg(F.min("near").alias("told"))
        tree = checkpointed(seen.join(told, "a", "left").select("a", F.col("to").alias("was"), F.least("to", "far", "near", "told").alias("to")), replaces=tree)
        if tree.where("to < was").isEmpty():
            return tree.select(F.col("a").alias("id"), F.col("to").alias("root"))


def regions(cells: DataFrame, corners: bool = True) -> DataFrame:
    """Dark cells (page_id, y, x) to one row for each region of touching ones.

    (page_id, y0, x_at_y0, cells, runs, y1, x0, x1, sum_y, sum_x): region's first row and its least column there, which name it; its
    number of cells and runs; its last row, its outermost columns, and the sums of its cells' places, for its centre. No cells give no rows.
    """
    runs = checkpointed(row_runs(cells).withColumn("id", F.monotonically_increasing_id()))
    found = roots(touching(runs, corners))
    of = runs.join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    n = (F.col("x1") - F.col("x0") + 1).cast("long")
    first = F.min(F.struct("y", "x0"))
    out = of.groupBy("page_id", "root").agg(
        first.alias("f"), F.sum(n).alias("cells"), F.count("*").alias("runs"), F.max("y").alias("y1"), F.min("x0").alias("left"), F.max("x1").alias("right"),
        F.sum(n * F.col("y")).alias("sum_y"), F.sum(F.expr("(cast(x0 as long) + x1) * (x1 - x0 + 1) div 2")).alias("sum_x"),
    )
    return out.select("page_id", F.col("f.y").alias("y0"), F.col("f.x0").alias("x_at_y0"), "cells", "runs", "y1", F.col("left").alias("x0"), F.col("right").alias("x1"), "sum_y", "sum_x")


def modal_side(found: DataFrame, least: int = 2) -> DataFrame:
    """regions to (page_id, side, n): the most frequent height among those about as wide as high; the greater on ties. Pages without one have no row."""
    high, wide = F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1
    round_ones = found.where((high >= least) & (F.abs(high - wide) * 4 <= F.greatest(high, wide)))
    counts = round_ones.groupBy("page_id", high.alias("side")).agg(F.count("*").alias("n"))
    best = counts.groupBy("page_id").agg(F.max(F.struct("n", "side")).alias("b"))
    return best.select("page_id", "b.side", "b.n")


def disc_fill(cells: DataFrame, discs: DataFrame, height: int, width: int) -> DataFrame:
    """discs(page_id, disc, cx, cy, radius) to (page_id, disc, inside, dark, fill): the cells within, how many are dark, and their share.

    A disc is a chord of cells on each row that it crosses, within the grid; chords meet the runs of that row. A disc off the grid has
    no cells and a fill of nought. Where a disc's name comes twice on a page, its cells are counted together. Discs without a place
    or a radius have no row.
    """
    whole = discs.select("page_id", "disc", *[F.col(c).cast("double").alias(c) for c in ("cx", "cy", "radius")]).dropna()
    rows = F.sequence(F.greatest(F.lit(0), F.floor(F.col("cy") - F.col("radius"))).cast("int"), F.least(F.lit(height - 1), F.ceil(F.col("cy") + F.col("radius"))).cast("int"))
    fits = F.least(F.lit(height - 1), F.ceil(F.col("cy") + F.col("radius"))) >= F.greatest(F.lit(0), F.floor(F.col("cy") - F.col("radius")))
    chords = whole.select("*", F.explode_outer(F.when(fits, rows)).alias("y"))
    rest = F.col("radius") * F.col("radius") - (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    half = F.when(rest >= 0, F.sqrt(rest))
    chords = chords.withColumn("lo", F.greatest(F.lit(0), F.ceil(F.col("cx") - half)).cast("int")).withColumn("hi", F.least(F.lit(width - 1), F.floor(F.col("cx") + half)).cast("int"))
    chords = chords.withColumn("n", F.when(rest >= 0, F.greatest(F.col("hi") - F.col("lo") + 1, F.lit(0))).otherwise(0))
    inside = chords.groupBy("page_id", "disc").agg(F.sum("n").alias("inside"))
    shared = F.greatest(F.least("hi", "x1") - F.greatest("lo", "x0") + 1, F.lit(0))
    # chords are so alike that they shuffle small and would be broadcast large
    dark = chords.where("n > 0").join(row_runs(cells).hint("merge"), ["page_id", "y"]).groupBy("page_id", "disc").agg(F.sum(shared).alias("dark"))
    both = inside.join(dark.hint("merge"), ["page_id", "disc"], "left").withColumn("dark", F.coalesce("dark", F.lit(0)))
    return both.select("page_id", "disc", "inside", "dark", F.when(F.col("inside") > 0, F.col("dark") / F.col("inside")).otherwise(F.lit(0.0)).alias("fill"))


def marked_option(fills: DataFrame, least: float = 0.45) -> DataFrame:
    """(page_id, item, option, fill) to (page_id, item, option, fill): the fullest option of each item, the first on ties; null where none has the least fill."""
    best = fills.groupBy("page_id", "item").agg(F.max(F.struct("fill", (-F.col("option")).alias("o"))).alias("b"))
    return best.select("page_id", "item", F.when(F.col("b.fill") >= least, -F.col("b.o")).alias("option"), F.col("b.fill").alias("fill"))

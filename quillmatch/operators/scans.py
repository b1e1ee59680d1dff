"""Scanned pages as relations of their cells: enhancement for reading, and the gutter between two columns of print.

Cells are rows (page_id, y, x, grey), a full rectangle of each page, of any number of pages at once. `raster` has the same for one page in NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.operators import raster, sequence
from quillmatch.operators.match import checkpointed

#: Tails that are cut off when grey is stretched, the least distance between them, and how much of the difference to the blur is added.
TAIL, SPREAD, SHARPEN = 0.02, 40, 0.8
#: Print is darker than this; at most so many rows are looked at, in an even step; a column's ink is the mean of so many on either side.
PRINT, SAMPLED, REACH = 140, 400, 5
#: Where the gutter is looked for, in hundredths of the width; what is clear, of all rows and of the middle column; its least width; the ink of its flanks.
FROM, TO, CLEAR, CLEAR_SHARE, LEAST, FLANK = 34, 66, 0.04, 0.15, 10, 0.25


def grey_cells(pages: DataFrame) -> DataFrame:
    """pages(page_id, w, h, rgba) to their cells (page_id, y, x, grey); pages with nulls have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(zip(*[batch.column(c).to_pylist() for c in ("w", "h", "rgba")], strict=True)):
                w, h, data = row
                grey = raster.luma(raster.pixels(w, h, data)).reshape(-1)
                for at in range(0, len(grey), 100_000):
                    place = np.arange(at, min(len(grey), at + 100_000))
                    ids = batch.column("page_id").take(pa.array(np.full(len(place), k)))
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(x.astype(np.int32)) for x in (place // w, place % w, grey[place])]], ["page_id", "y", "x", "grey"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "w", "h", "rgba").dropna(subset=["w", "h", "rgba"]).mapInArrow(run, f"page_id {kind}, y int, x int, grey int")


def enhanced(cells: DataFrame) -> DataFrame:
    """cells(page_id, y, x, grey) with grey stretched between its tails and sharpened, from 0 to 255.

    A cell at the edge is its own neighbour there. Cells with nulls are none; of a cell that comes twice the darkest counts.
    """
    rows = checkpointed(cells.select("page_id", "y", "x", "grey").dropna().groupBy("page_id", "y", "x").agg(F.min("grey").alias("grey")))
    low = sequence.upper_percentiles(rows, "page_id", "grey", TAIL).withColumnRenamed("grey", "low")
    high = sequence.upper_percentiles(rows, "page_id", "grey", 1 - TAIL).withColumnRenamed("grey", "high")
    wide = (F.col("grey") - F.col("low")) * 255 / F.greatest(F.lit(SPREAD), F.col("high") - F.col("low"))
    rows = rows.join(low, "page_id").join(high, "page_id").select("page_id", "y", "x", F.least(F.lit(255.0), F.greatest(F.lit(0.0), wide)).alias("v"))
    across, down = W.partitionBy("page_id", "y").orderBy("x"), W.partitionBy("page_id", "x").orderBy("y")
    beside = lambda f, w: F.coalesce(f("v").over(w), "v")
    rows = rows.select("*", beside(F.lag, across).alias("_left"), beside(F.lead, across).alias("_right"))
    rows = rows.select("*", beside(F.lag, down).alias("_up"), beside(F.lead, down).alias("_low"))
    blur = (4 * F.col("v") + 2 * (F.col("_up") + F.col("_low") + F.col("_left") + F.col("_right"))) / 12
    sharp = F.col("v") + SHARPEN * (F.col("v") - blur)
    return rows.select("page_id", "y", "x", F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), sharp))).cast("int").alias("grey"))


def gutters(cells: DataFrame) -> DataFrame:
    """cells(page_id, y, x, grey) to (page_id, gutter): the column in the middle of the empty channel between two columns of print, or -1.

    The channel is the widest stretch of clear columns near the page's middle, the first on ties; print has to stand on both sides of it.
    """
    rows = cells.select("page_id", "y", "x", "grey").dropna()
    size = rows.groupBy("page_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    size = size.withColumn("step", F.greatest(F.lit(1), F.floor(F.col("h") / SAMPLED))).withColumn("rows", F.ceil(F.col("h") / F.col("step")))
    some = rows.join(size, "page_id").where(F.col("y") % F.col("step") == 0)
    counts = some.groupBy("page_id", "x").agg(F.count_if(F.col("grey") < PRINT).alias("c"), F.any_value("w").alias("w"), F.any_value("rows").alias("rows"))
    near = W.partitionBy("page_id").orderBy("x").rowsBetween(-REACH, REACH)
    ink = checkpointed(counts.select("page_id", "x", "w", (F.sum("c").over(near) / F.count("*").over(near) / F.col("rows")).alias("ink")))
    ink = ink.join(ink.groupBy("page_id").agg(F.median("ink").alias("mid")), "page_id")
    low, high = F.floor(F.col("w") * FROM / 100), F.floor(F.col("w") * TO / 100)
    middle = ink.where((F.col("x") >= low) & (F.col("x") < high))
    clear = middle.where(F.col("ink") <= F.least(F.lit(CLEAR), CLEAR_SHARE * F.col("mid"))).where("mid > 0")
    runs = clear.select("page_id", "x", (F.col("x") - F.row_number().over(W.partitionBy("page_id").orderBy("x"))).alias("_run")).groupBy("page_id", "_run").agg(F.min("x").alias("a"), F.count("*").alias("n"))
    best = runs.groupBy("page_id").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("b")).where(F.col("b.n") >= LEAST)
    best = best.join(size.select("page_id", "w"), "page_id").select("page_id", (low + F.floor((2 * (-F.col("b.a") - low) + F.col("b.n")) / 2)).cast("int").alias("at"))
    flanks = middle.join(best, "page_id").groupBy("page_id", "at").agg(F.avg(F.when(F.col("x") < F.col("at"), F.col("ink"))).alias("l"), F.avg(F.when(F.col("x") >= F.col("at"), F.col("ink"))).alias("r"), F.any_value("mid").alias("mid"))
    found = flanks.where((F.col("l") >= FLANK * F.col("mid")) & (F.col("r") >= FLANK * F.col("mid"))).select("page_id", "at")
    return size.select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("at", F.lit(-1)).alias("gutter"))

"""A bubble sheet out of its ink: the rows that keep repeating, and the disc test of every bubble."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.operators import regions

#: Pitches that rows may have, how far a gap may be off to count for one, the gaps that must, and the rows that a sheet has at least.
PITCHES, OFF, GAPS, ROWS = (10, 160), 2, 4, 5
#: A gap of so many pitches ends a chain; a row so far off the lattice, in pitches, is none.
BREAK, ASTRAY, LEAST_PITCH = 1.45, 0.32, 8
#: A bubble's radius in its pitch, and at least; how far a mark may sit from its bubble; the fill of the pen, and of pen and light marks.
RADIUS, LEAST_RADIUS = 0.32, 4.0
ASIDE, ABOVE = (-0.3, -0.15, 0.0, 0.15, 0.3), (-0.15, 0.0, 0.15)
TIGHT, LOOSE = 0.40, 0.75


def modal_pitch(tops: DataFrame) -> DataFrame:
    """tops(page_id, at), whole numbers, to (page_id, pitch, n): the pitch that most gaps between neighbours lie within OFF of, the least on ties."""
    gaps = tops.select("page_id", "at").dropna().distinct()
    gaps = gaps.select("page_id", (F.col("at") - F.lag("at").over(W.partitionBy("page_id").orderBy("at"))).alias("gap")).where("gap is not null")
    near = F.sequence(F.greatest(F.lit(PITCHES[0]), F.col("gap") - OFF), F.least(F.lit(PITCHES[1]), F.col("gap") + OFF))
    fits = F.col("gap").between(PITCHES[0] - OFF, PITCHES[1] + OFF)
    votes = gaps.where(fits).select("page_id", F.explode(near).alias("pitch")).groupBy("page_id", "pitch").agg(F.count("*").alias("n"))
    best = votes.groupBy("page_id").agg(F.max(F.struct("n", (-F.col("pitch")).alias("p"))).alias("b"))
    return best.select("page_id", (-F.col("b.p")).alias("pitch"), "b.n")


def row_lattice(tops: DataFrame, heights: DataFrame) -> DataFrame:
    """tops(page_id, at, ink), heights(page_id, h) to (page_id, seq, at, made, pitch): the rows of each sheet, blank ones put back.

    The rows are the longest chain of tops without a gap of over BREAK modal pitches, on ties the one nearer the page's middle, then the upper.
    Their pitch is the middle gap, of two the greater. Going down, a top that is off the lattice is no row, one that lies on the row before
    replaces it if it has more ink, and a gap of several pitches gets its rows evenly (`made`). A page with fewer than GAPS gaps of
    its modal pitch, a chain or lattice of under ROWS, or a pitch of under LEAST_PITCH has none. A page's tops are few hundred: only the
    chosen chain is folded, in order. Of tops at one place the one with most ink counts; rows with nulls are none.
    """
    rows = tops.select("page_id", "at", F.col("ink").cast("double").alias("ink")).dropna().groupBy("page_id", "at").agg(F.max("ink").alias("ink"))
    modal = modal_pitch(rows).where(F.col("n") >= GAPS).select("page_id", "pitch")
    order = W.partitionBy("page_id").orderBy("at")
    rows = rows.join(modal, "page_id").withColumn("gap", F.col("at") - F.lag("at").over(order))
    rows = rows.withColumn("run", F.count_if(F.col("gap") > BREAK * F.col("pitch")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy("page_id", "run").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last")).join(heights, "page_id")
    big = runs.groupBy("page_id").agg(F.max(F.struct("n", (-F.abs(F.col("first") + F.col("last") - F.col("h"))).alias("off"), (-F.col("first")).alias("up"), "run")).alias("b"))
    chain = rows.join(big.where(F.col("b.n") >= ROWS).select("page_id", "b.run"), ["page_id", "run"]).withColumn("gap", F.col("at") - F.lag("at").over(order))
    lists = chain.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(F.col("at").cast("double").alias("at"), "ink"))).alias("tops"), F.sort_array(F.collect_list("gap")).alias("gaps"))
    lists = lists.select("page_id", "tops", F.get("gaps", F.floor(F.size("gaps") / 2).cast("int")).cast("double").alias("pitch")).where(F.col("pitch") >= LEAST_PITCH)

    def step(kept, top):
        prev = F.element_at(kept, -1)
        gap = top["at"] - prev["at"]
        k = F.floor(gap / F.col("pitch") + 0.5).cast("int")
        own = F.struct(top["at"].alias("at"), top["ink"].alias("ink"), F.lit(False).alias("made"))
        between = F.transform(F.when(k > 1, F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1)))).otherwise(F.array().cast("array<int>")), lambda i: F.struct((prev["at"] + gap * i / k).alias("at"), F.lit(0.0).alias("ink"), F.lit(True).alias("made")))
        replaced = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(own))
        near = F.when(top["ink"] > prev["ink"], replaced).otherwise(kept)
        return F.when(k < 1, near).when(F.abs(gap - k * F.col("pitch")) > ASTRAY * F.col("pitch"), kept).otherwise(F.concat(kept, between, F.array(own)))

    first = F.get("tops", 0)
    start = F.array(F.struct(first["at"].alias("at"), first["ink"].alias("ink"), F.lit(False).alias("made")))
    folded = lists.select("page_id", "pitch", F.aggregate(F.slice("tops", 2, F.size("tops")), start, step).alias("rows")).where(F.size("rows") >= ROWS)
    return folded.select("page_id", F.posexplode("rows").alias("seq", "r"), "pitch").select("page_id", (F.col("seq") + 1).alias("seq"), "r.at", "r.made", "pitch")


def disc_marks(tight: DataFrame, loose: DataFrame, bubbles: DataFrame, height: int, width: int) -> DataFrame:
    """Cells of ink by two masks (page_id, y, x), and bubbles(page_id, no, option, cx, cy, pitch), to (page_id, no, option, tight, loose).

    A filled bubble is a disc of ink, an empty one a ring. Each bubble's disc is tried a little aside and above, for hands wander; its best fill
    counts. An item's answer is its fullest bubble where the pen fills TIGHT of it, else the fullest by the looser mask where that fills
    LOOSE, the first on ties, else null. Bubbles with nulls are none.
    """
    spots = bubbles.select("page_id", "no", "option", *[F.col(c).cast("double").alias(c) for c in ("cx", "cy", "pitch")]).dropna()
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate((a, b) for a in ASIDE for b in ABOVE)])
    each = spots.select("*", F.explode(shifts).alias("s"))
    moved = lambda c, by: F.floor(F.col(c) + F.col(f"s.{by}") * F.col("pitch") + 0.5).cast("double").alias(c)
    radius = F.greatest(F.lit(LEAST_RADIUS), RADIUS * F.col("pitch"))
    discs = each.select("page_id", F.struct("no", "option", "s.i").alias("disc"), moved("cx", "a"), moved("cy", "b"), radius.alias("radius"))
    fill = lambda cells, c: regions.disc_fill(cells, discs, height, width).groupBy("page_id", "disc.no", "disc.option").agg(F.max("fill").alias(c))
    both = fill(tight, "tight").join(fill(loose, "loose").hint("merge"), ["page_id", "no", "option"])
    best = lambda c: F.max(F.struct(c, (-F.col("option")).alias("o")))
    items = both.groupBy("page_id", "no").agg(best("tight").alias("t"), best("loose").alias("l"))
    option = F.when(F.col("t.tight") >= TIGHT, -F.col("t.o")).when(F.col("l.loose") >= LOOSE, -F.col("l.o"))
    return items.select("page_id", "no", option.alias("option"), F.col("t.tight").alias("tight"), F.col("l.loose").alias("loose"))

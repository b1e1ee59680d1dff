"""Leader clustering of small black-and-white pictures: in order, each one joins the nearest leader before it, or becomes a leader."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.operators.match import checkpointed

#: Mean difference of a cell below which two pictures show one letter, and the number of letters beyond which a table is not read.
NEAR, MOST_LEADERS = 0.055, 20
#: Cells that go into one long.
WORD = 60


def shrunk(values: Column, side: int, box: int) -> Column:
    """A square picture, row by row in an array, as box x box cells of '0' and '1': 1 where a cell's part of the picture sums above nought."""
    step = side // box

    def cell(y: int, x: int) -> Column:
        part = [F.get(values, F.lit((y * step + j) * side + x * step + i)).cast("double") for j in range(step) for i in range(step)]
        total = part[0]
        for p in part[1:]:
            total = total + p
        return F.when(total > 0, "1").when(total.isNotNull(), "0")

    return F.concat(*[cell(y, x) for y in range(box) for x in range(box)])


def most_unlike(cells: int, near: float) -> int:
    """How many of the cells two pictures within the distance differ in at most."""
    return max([d for d in range(cells + 1) if d / cells < near], default=-1)


def near_patterns(patterns: DataFrame, cells: int, most: int) -> DataFrame:
    """patterns(key, id, first, bits) to (a, b, at_a, at_b, apart): pairs of a key that differ in at most so many cells, a before b.

    Of most + 2 segments of both pictures at least two are equal. Pictures meet under each pair of segments, and a meeting
    counts only under the first pair on which they agree, so each pair comes once. at_a and at_b are their first and bits.
    """
    cuts = [cells * k // (most + 2) for k in range(most + 3)]
    segments = [F.substring("bits", a + 1, b - a) for a, b in zip(cuts, cuts[1:])]
    words = [F.conv(F.substring("bits", a + 1, min(WORD, cells - a)), 2, 10).cast("long").alias(f"w{k}") for k, a in enumerate(range(0, cells, WORD))]
    rows = patterns.select("key", "id", "first", "bits", F.array(*segments).alias("s"), *words)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in combinations(range(most + 2), 2)])
    met = rows.select("*", F.explode(pairs).alias("p")).select("*", F.get("s", F.col("p.i")).alias("si"), F.get("s", F.col("p.j")).alias("sj"))
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("key", "p", "si", "sj")]
    before = F.struct("l.first", "l.bits") < F.struct("r.first", "r.bits")
    apart = sum((F.bit_count(F.col(f"l.w{k}").bitwiseXOR(F.col(f"r.w{k}"))) for k in range(len(words))), F.lit(0))
    same = F.filter(F.transform(F.arrays_zip(F.col("l.s").alias("x"), F.col("r.s").alias("y")), lambda z, i: F.when(z["x"] == z["y"], i)), lambda i: i.isNotNull())
    joined = met.alias("l").join(met.alias("r"), [*on, before, apart <= most])
    joined = joined.where((F.get(same, F.lit(0)) == F.col("l.p.i")) & (F.get(same, F.lit(1)) == F.col("l.p.j")))
    return joined.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.struct("l.first", "l.bits").alias("at_a"), F.struct("r.first", "r.bits").alias("at_b"), apart.cast("int").alias("apart"))


def covered_by_leaders(links: DataFrame) -> DataFrame:
    """links(a, b), a before b, to (b): those that have a leader before them.

    Whoever has no open link to an earlier one leads; whoever has a link from a leader is covered, and its own links go. A round
    decides all such at once, and what is left is written. In no particular order that takes as many rounds as the logarithm
    of the number of pictures; a long chain in which each is near the one before only takes a round for every other member.
    """
    spark = links.sparkSession
    done = [spark.createDataFrame([], "b long")]
    edges = links.select("a", "b")
    while not edges.isEmpty():
        lead = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        covered = checkpointed(edges.join(lead, "a", "left_semi").select("b").distinct())
        done.append(covered)
        rest = edges.join(covered, "b", "left_anti").join(covered.select(F.col("b").alias("a")), "a", "left_anti")
        edges = checkpointed(rest, replaces=edges)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def glyph_leaders(glyphs: DataFrame, cells: int, near: float = NEAR) -> DataFrame:
    """glyphs(key, ord, bits) to (key, ord, leader, apart, leaders): the leader's ord, the cells in which it differs, the key's number of leaders.

    In order of ord (of equal ones, of their bits), a picture joins the nearest leader of its key before it that differs in a share of
    cells below `near`, the earlier one on ties; where there is none, it leads. A leader is its own.

    Equal pictures of a key are one pattern, so copies cost a row each; patterns meet by equal segments, and rounds over the near pairs
    choose the leaders. Rows without a key, an ord or bits of that many cells have no leader; of such a key, and of no rows, the
    number is null.
    """
    most = most_unlike(cells, near)
    if most < 0:
        raise ValueError("near must be above 0")
    rows = glyphs.select("key", "ord", "bits")
    good = F.coalesce(F.col("key").isNotNull() & F.col("ord").isNotNull() & F.rlike("bits", F.lit(f"^[01]{{{cells}}}$")), F.lit(False))
    fine = rows.where(good)
    patterns = fine.groupBy("key", "bits").agg(F.min("ord").alias("first"))
    patterns = checkpointed(patterns.withColumn("id", F.monotonically_increasing_id()))
    links = checkpointed(near_patterns(patterns, cells, most))
    covered = checkpointed(covered_by_leaders(links).withColumnRenamed("b", "id"))
    leaders = patterns.join(covered, "id", "left_anti")
    # the leaders near a pattern, before and after its first picture, as far as each is nearer than all before it: at most as many as cells may differ
    both = links.select("a", "b", F.col("at_a.*"), "apart").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("at_b.*"), "apart"))
    near_ones = both.join(leaders.select(F.col("id").alias("a")), "a", "left_semi")
    order = W.partitionBy("b").orderBy("first", "bits").rowsBetween(W.unboundedPreceding, -1)
    nearer = near_ones.withColumn("so_far", F.min("apart").over(order)).where("so_far is null or apart < so_far")
    steps = nearer.groupBy(F.col("b").alias("id")).agg(F.sort_array(F.collect_list(F.struct("first", "bits", "apart"))).alias("steps"))
    number = leaders.groupBy("key").agg(F.count("*").cast("int").alias("leaders"))
    facts = patterns.join(steps, "id", "left").join(number, "key").select("key", "bits", F.col("first").alias("own"), "steps", "leaders")
    found = fine.join(facts, ["key", "bits"])
    last = F.element_at(F.filter("steps", lambda s: (s["first"] < F.col("ord")) | ((s["first"] == F.col("ord")) & (s["bits"] < F.col("bits")))), -1)
    step = F.when(F.col("steps").isNotNull(), last)
    out = found.select("key", "ord", F.coalesce(step["first"], "own").alias("leader"), F.coalesce(step["apart"], F.lit(0)).alias("apart"), "leaders")
    none = rows.where(~good).select("key", "ord", F.lit(None).cast(rows.schema["ord"].dataType).alias("leader"), F.lit(None).cast("int").alias("apart"), F.lit(None).cast("int").alias("leaders"))
    return out.unionByName(none)

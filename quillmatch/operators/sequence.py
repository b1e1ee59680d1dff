"""Operators over ordered rows: blocks, clusters, as-of, interval and positional joins, and dedup."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.functions import text as X
from quillmatch.operators.match import checkpointed


def split_blocks(lines: DataFrame) -> DataFrame:
    """lines(doc_id, ord, text) to (doc_id, block, no, text): a numbered line opens a block; what stands before the first is block 0."""
    no = F.regexp_extract("text", r"^\s*(?:[Qq](?:uestion)?[\s.:#-]*)?([0-9]{1,3})\s*[).:\-]", 1)
    rows = lines.withColumn("_no", no).withColumn("_opens", (F.col("_no") != "").cast("int"))
    rows = rows.withColumn("block", F.sum("_opens").over(W.partitionBy("doc_id").orderBy("ord")))
    out = rows.groupBy("doc_id", "block").agg(F.max(F.when(F.col("_opens") == 1, F.col("_no").cast("int"))).alias("no"), F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("l"))
    return out.select("doc_id", "block", "no", F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("text"))


def cluster_axis(values: DataFrame, key: str, value: str, gap: float) -> DataFrame:
    """(key, cluster, n, mean): neighbours no further than gap apart are one cluster."""
    order = W.partitionBy(key).orderBy(value)
    opens = F.coalesce((F.col(value) - F.lag(value).over(order) > gap).cast("int"), F.lit(0))
    rows = values.where(F.col(value).isNotNull()).withColumn("_opens", opens)
    rows = rows.withColumn("cluster", F.sum("_opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(key, "cluster").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def moving_average(rows: DataFrame, key: str, order: list[str], value: str, reach: int) -> DataFrame:
    """Adds the mean over so many rows on either side, fewer at the ends."""
    return rows.withColumn("smooth", F.avg(value).over(W.partitionBy(key).orderBy(*order).rowsBetween(-reach, reach)))


def islands(rows: DataFrame, key: str, order: list[str], over) -> DataFrame:
    """(key, island, n, first, last): maximal runs of rows for which `over` holds; first and last are row numbers."""
    by = W.partitionBy(key).orderBy(*order)
    numbered = rows.withColumn("_at", F.row_number().over(by)).where(over)
    numbered = numbered.withColumn("_group", F.col("_at") - F.row_number().over(W.partitionBy(key).orderBy("_at")))
    runs = numbered.groupBy(key, "_group").agg(F.count("*").alias("n"), F.min("_at").alias("first"), F.max("_at").alias("last"))
    return runs.select(key, F.row_number().over(W.partitionBy(key).orderBy("first")).alias("island"), "n", "first", "last")


def mode(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, n): the most frequent value of each key; of equally frequent ones, that which was so first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.max(order).alias("_full"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "_full", value)).alias("b"))
    return best.select(key, F.col("b")[value].alias(value), (-F.col("b.m")).alias("n"))


def peaks(profile: DataFrame, key: str, at: str, value: str, apart: float, share: float = 0.15, least: float = 2) -> DataFrame:
    """(key, at, value): local maxima above a share of the key's greatest value; of those nearer than `apart`, the higher one.

    A profile is one page's or line's; windows find its maxima, and only these are folded, in order.
    """
    order = W.partitionBy(key).orderBy(at)
    level = F.greatest(F.max(value).over(W.partitionBy(key)) * share, F.lit(least))
    rows = profile.select(key, at, value, F.lag(value).over(order).alias("_a"), F.lead(value).over(order).alias("_b"), level.alias("_level"))
    tops = rows.where((F.col(value) >= F.col("_a")) & (F.col(value) > F.col("_b")) & (F.col(value) > F.col("_level")))
    lists = tops.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("v")))).alias("tops"))

    def step(kept, x):
        near = F.array_position(F.transform(kept, lambda k: F.abs(x["at"] - k["at"]) < apart), True)
        higher = F.transform(kept, lambda k, i: F.when((i + 1 == near) & (x["v"] > k["v"]), x).otherwise(k))
        return F.when(near == 0, F.concat(kept, F.array(x))).otherwise(higher)

    kept = F.aggregate("tops", F.slice("tops", 1, 0), step)
    return lists.select(key, F.explode(kept).alias("k")).select(key, F.col("k.at").alias(at), F.col("k.v").alias(value))


def fill_lattice(rows: DataFrame, key: str, at: str, pitch: float) -> DataFrame:
    """(key, at, made): the rows of each key, and evenly between neighbours the rows that a gap of several pitches lacks."""
    ahead = F.lead(at).over(W.partitionBy(key).orderBy(at))
    gap = ahead - F.col(at)
    steps = F.coalesce(F.greatest(F.floor(gap / pitch + 0.5), F.lit(1)), F.lit(1)).cast("int")
    spread = rows.select(key, at, gap.alias("_gap"), steps.alias("_n")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    place = F.col(at) + F.when(F.col("_k") > 0, F.col("_gap") * F.col("_k") / F.col("_n")).otherwise(0)
    return spread.select(key, place.alias(at), (F.col("_k") > 0).alias("made"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, order: list[str], carry: str) -> DataFrame:
    """Adds to each left row the `carry` of the last right row of its key at or before it.

    One sort of both sides by key and time: a running last value, no pairs. Right rows come before left ones at equal times.
    """
    a = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(right.schema[carry].dataType))
    b = right.select(F.col(key), F.col(at), *[F.col(c) for c in order if c not in (key, at)], F.col(carry).alias("_value")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    window = W.partitionBy(key).orderBy(at, "_side", *[c for c in order if c not in (key, at)]).rowsBetween(W.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_side") == 0, F.col("_value")), ignorenulls=True).over(window)
    return both.withColumn("as_of", found).where("_side = 1").drop("_side", "_value")


def pair_lines(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """Interval join: a block of right(page_id, block, y0, y1) takes the left(page_id, ord, text, y) lines whose centre it spans.

    A line goes to the first block that claims it. Both sides are dealt to cells of the axis, so that the join is an equi-join.
    """
    cell = lambda c, size: F.floor(c / size)
    size = 100.0
    spans = right.withColumn("_cell", F.explode(F.sequence(cell(F.col("y0") - reach, size), cell(F.col("y1") + reach, size))))
    lines = left.withColumn("_cell", cell(F.col("y"), size))
    hit = lines.alias("l").join(spans.alias("r"), ["page_id", "_cell"]).where((F.col("y") >= F.col("y0") - reach) & (F.col("y") <= F.col("y1") + reach))
    return hit.groupBy("page_id", "ord").agg(F.min("block").alias("block"), F.first("text").alias("text"))


NUMBERED = r"^\s*(?:[Qq](?:uestion)?[\s.:#-]*)?([0-9]{1,3})\s*[).:\-॰°]\s*(.*)$"


def bind_columns(lines: DataFrame) -> DataFrame:
    """lines(page_id, side, ord, text, y0, y1), side l or r, to (page_id, text): the column without numbers bound to the other by height.

    A numbered line opens a block of the column that has more of them, the right one on ties. A block takes the lines of the other
    column whose middle lies within it, nine tenths of a line's height more on either side; both bear its number. The text is null
    where no line has a number, there are fewer than two blocks, or less than a quarter of the other column's lines are bound.
    What binds is worked out on places alone; the texts are shuffled once, to the places that they have found.
    """
    no = F.regexp_extract("text", NUMBERED, 1).try_cast("int")
    page, column = W.partitionBy("page_id"), W.partitionBy("page_id", "side").orderBy("ord")
    places = lines.where(F.col("page_id").isNotNull()).select("page_id", "side", "ord", "y0", "y1", F.when(no > 0, no).alias("no")).repartition("page_id")
    of = lambda side, *also: F.count_if(F.col("side") == side if not also else (F.col("side") == side) & F.col("no").isNotNull()).over(page)
    places = places.select("*", of("l", "no").alias("l"), of("r", "no").alias("r"), of("l").alias("n_l"), of("r").alias("n_r"), F.count("no").over(column).alias("block"))
    main = F.when(F.col("r") >= F.col("l"), "r").otherwise("l")
    fit = (F.col("l") + F.col("r") > 0) & (F.col("n_l") > 0) & (F.col("n_r") > 0)
    places = places.where(fit).select("page_id", "side", "ord", "y0", "y1", "no", "block", (F.col("side") == main).alias("own"), F.when(main == "r", F.col("n_l")).otherwise(F.col("n_r")).alias("others"))
    places = checkpointed(places)  # without texts: these are dealt once, below

    own = places.where("own")
    heights = F.sort_array(F.collect_list(F.greatest(F.col("y1") - F.col("y0"), F.lit(4))))
    reach = own.groupBy("page_id").agg(heights.alias("h")).select("page_id", (F.get("h", F.floor(F.size("h") / 2).cast("int")) * 0.9).alias("reach"))
    blocks = own.groupBy("page_id", "block").agg(F.min_by("y0", "ord").alias("y0"), F.max_by("y1", "ord").alias("y1"))
    spans = blocks.join(reach, "page_id").select("page_id", "block", (F.col("y0") - F.col("reach")).alias("y0"), (F.col("y1") + F.col("reach")).alias("y1"))
    other = places.where("not own").select("page_id", "ord", F.col("side").alias("text"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    hit = pair_lines(other, spans, 0.0).select("page_id", F.col("text").alias("side"), "ord", "block", F.lit(False).alias("own"))
    bound = own.select("page_id", "side", "ord", "block", "own", "no", "others").unionByName(hit, allowMissingColumns=True).repartition("page_id")
    blocks_of = F.max("block").over(page) - F.min("block").over(page) + 1
    enough = (blocks_of >= 2) & (F.count_if(~F.col("own")).over(page) >= F.ceil(F.max("others").over(page) * 0.25))
    number = F.max("no").over(W.partitionBy("page_id", "block")).cast("string")
    bound = bound.select("page_id", "side", "ord", "block", "own", F.coalesce(F.concat(number, F.lit(". ")), F.lit("")).alias("label"), enough.alias("_enough")).where("_enough")

    # a line follows its place, if it has one, and takes it over
    place = F.struct("block", "own", "ord", "label")
    rows = lines.select("page_id", "side", "ord", "text", F.lit(True).alias("said")).unionByName(bound.select("page_id", "side", "ord", place.alias("place"), F.lit(False).alias("said")), allowMissingColumns=True).repartition("page_id")
    same = W.partitionBy("page_id", "side", "ord").orderBy("said").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("page_id", "text", "said", F.last("place", ignorenulls=True).over(same).alias("place")).where("said")
    listed = F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place.*", F.coalesce("text", F.lit("")).alias("text")))))

    def part(x, i):
        before = F.get("l", i - 1)
        goes_on = (i > 0) & (before["block"] == x["block"]) & (before["own"] == x["own"])
        return F.concat(F.when(goes_on, " ").when(i > 0, F.concat(F.lit("\n"), x["label"])).otherwise(x["label"]), x["text"])

    texts = rows.groupBy("page_id").agg(listed.alias("l"))
    return texts.select("page_id", F.when(F.size("l") > 0, X.tidy_lines(F.array_join(F.transform("l", part), ""))).alias("text"))


def zip_texts(pages: DataFrame) -> DataFrame:
    """pages(page_id, left, right) to (page_id, text): the blocks of two columns in turn, under the numbers of the one that has more.

    Where they are not as many, or none is numbered, the columns follow one another.
    """
    sides = []
    for side in ("left", "right"):
        lines = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.split(F.coalesce(side, F.lit("")), "\n")).alias("ord", "text"))
        blocks = split_blocks(lines).withColumn("text", X.without_number(F.trim(F.regexp_replace("text", r"\s+", " ")))).where(F.length("text") > 1)
        sides.append(blocks.groupBy(F.col("doc_id").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("block", "no", "text"))).alias(f"{side}_blocks")))
    both = pages.join(sides[0], "page_id", "left").join(sides[1], "page_id", "left")
    counted = lambda c: F.size(F.filter(c, lambda b: b["no"] > 0))
    a, b = F.col("left_blocks"), F.col("right_blocks")
    more = counted(a) >= counted(b)
    mine, theirs = F.when(more, a).otherwise(b), F.when(more, b).otherwise(a)

    def pair(x, i):
        label = F.when(x["no"] > 0, F.concat(x["no"].cast("string"), F.lit(". "))).otherwise("")
        return F.concat(label, F.get(theirs, i)["text"], F.lit("\n"), label, x["text"])

    fit = F.coalesce((F.size(a) == F.size(b)) & (F.size(a) > 0) & (counted(a) + counted(b) > 0), F.lit(False))
    one = F.concat(F.coalesce("left", F.lit("")), F.lit("\n"), F.coalesce("right", F.lit("")))
    return both.select("page_id", F.when(fit, F.array_join(F.transform(mine, pair), "\n")).otherwise(one).alias("text"))


def finished_text(pages: DataFrame, deadline) -> DataFrame:
    """pages(doc_id, page_no, done_at, text) to (doc_id, text, skipped): the pages read by the deadline, and how many were not."""
    done = F.coalesce(F.col("done_at") <= deadline, F.lit(False))
    read = F.sort_array(F.collect_list(F.when(done, F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))))
    rows = pages.groupBy("doc_id").agg(read.alias("read"), F.count_if(~done).alias("skipped"))
    return rows.select("doc_id", X.tidy_lines(F.array_join(F.transform("read", lambda x: x["text"]), "\n")).alias("text"), "skipped")


def upper_percentiles(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """(key, value): each key's sorted value at floor(n * share), without interpolation.

    Equal values are counted first; the counts are range-sorted, so a key with most of the rows is spread over ranges. A range needs only its
    own rows and the number of those before it.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    ranged = checkpointed(counts.repartitionByRange(key, value).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(key, "_part").agg(F.sum("_n").alias("_in"))
    order = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    every = F.sum("_in").over(W.partitionBy(key))
    parts = parts.select(key, "_part", "_in", F.coalesce(F.sum("_in").over(order), F.lit(0)).alias("_before"), F.least(every - 1, F.floor(every * F.lit(share))).alias("_at"))
    hit = parts.where((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_in")))
    within = F.sum("_n").over(W.partitionBy(key, "_part").orderBy(value))
    rows = ranged.join(hit, [key, "_part"]).withColumn("_upto", within + F.col("_before"))
    return rows.where(F.col("_upto") > F.col("_at")).groupBy(key).agg(F.min(value).alias(value))


def items_to_lines(items: DataFrame) -> DataFrame:
    """PDF_ITEMS to (page_id, text): a new line where y moves by more than 2.5, a space where x leaves a gap of more than 1.2."""
    order = W.partitionBy("page_id").orderBy("ord")
    dy, gap = F.abs(F.col("y") - F.lag("y").over(order)), F.col("x") - (F.lag("x").over(order) + F.lag("width").over(order))
    before = F.when(dy > 2.5, "\n").when(gap > 1.2, " ").otherwise("")
    parts = items.withColumn("_part", F.concat(before, "str"))
    return parts.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("ord", "_part"))).alias("l")).select("page_id", F.array_join(F.transform("l", lambda x: x["_part"]), "").alias("text"))


def longest_text(rows: DataFrame, least: int = 0) -> DataFrame:
    """(match_id, no, text, ord): the longest text of each number, the first on ties."""
    long = rows.where(F.length("text") >= least)
    best = long.groupBy("match_id", "no").agg(F.min(F.struct((-F.length("text")).alias("n"), "ord", "text")).alias("b"))
    return best.select("match_id", "no", "b.text", "b.ord")


def prefix_dedup(rows: DataFrame, key: list[str], order: str, chars: int = 40) -> DataFrame:
    """The first row of each key and first `chars` normalised characters."""
    head = F.substring(X.normalize(F.col("text")), 1, chars)
    rows = rows.withColumn("_head", head)
    first = rows.groupBy(*key, "_head").agg(F.min(order).alias(order))
    return rows.join(first, [*key, "_head", order], "left_semi").drop("_head")


def adjacent_dedup(rows: DataFrame, key: str, order: str, same: list[str], chars: int = 60) -> DataFrame:
    """Rows whose neighbour before has the same columns and first normalised characters go."""
    head = F.struct(*same, F.substring(X.normalize(F.col("text")), 1, chars).alias("_h"))
    rows = rows.withColumn("_head", head)
    again = F.coalesce(F.lag("_head").over(W.partitionBy(key).orderBy(order)) == F.col("_head"), F.lit(False))
    return rows.withColumn("_again", again).where(~F.col("_again")).drop("_head", "_again")


def read_key(route, text, image):
    """One key for one picture under one instruction, whatever model reads it."""
    return F.sha2(F.concat_ws("|", route, F.coalesce(image, text), F.when(image.isNotNull(), text)), 256)


def request_key(route, rest, texts, images, body):
    """The key of a request: base64 of a SHA-256 over its parts, each with its length before it, so that no two requests share a text.

    A request with pictures (an array) is its pictures and instructions (an array) under its route, whatever model and path it goes
    to; one without is its route, path and whole body. Null parts are empty.
    """
    part = lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)
    one = lambda x: part(F.coalesce(x, F.lit("")))
    listed = lambda x: F.coalesce(F.filter(x, lambda y: y.isNotNull()), F.array().cast("array<string>"))
    many = lambda x: F.concat(F.size(listed(x)).cast("string"), F.lit(";"), F.array_join(F.transform(listed(x), part), ""))
    page = F.concat(F.lit("page|"), one(route), many(texts), many(images))
    whole = F.concat(F.lit("req|"), one(route), one(rest), one(body))
    return F.base64(F.unhex(F.sha2(F.when(F.size(listed(images)) > 0, page).otherwise(whole), 256)))


def read_dedup(reads: DataFrame, hours: int = 12) -> DataFrame:
    """reads(k, at, ...): those that a cache with a fixed life from the first read would have to make; a hit does not renew it.

    The reads of a key come in order, as a stream of which only the last read that was made is kept. Reads without a time are none.
    """
    life = hours * 3600 * 1_000_000
    rows = reads.select("k", F.unix_micros(F.col("at").cast("timestamp")).alias("at")).where("at is not null").distinct()

    def run(batches):
        key = last = None
        for pdf in batches:
            keys, ats = [], []
            for k, g in pdf.groupby("k", sort=False, dropna=False):
                times = g["at"].to_numpy()
                if last is None or not (k == key or (pd.isna(k) and pd.isna(key))):
                    key, last = k, times[0] - life
                i = times.searchsorted(last + life)
                while i < len(times):
                    last = times[i]
                    keys.append(None if pd.isna(k) else k)
                    ats.append(last)
                    i = times.searchsorted(last + life)
            yield pd.DataFrame({"k": pd.Series(keys, dtype=object), "at": pd.Series(ats, dtype="int64")})

    made = rows.repartition("k").sortWithinPartitions("k", "at").mapInPandas(run, f"k {reads.schema['k'].dataType.simpleString()}, at long")
    return made.select("k", F.timestamp_micros("at").alias("at"))

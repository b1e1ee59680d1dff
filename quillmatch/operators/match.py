"""Joins of papers and keys: by number, by offset, by wording, by position.

Every frame carries match_id, the pair of documents that a row belongs to, so one job serves any number of pairs.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.functions import text as X

THRESHOLD = 0.42
LADDER = (0.42, 0.34, 0.28)
COVERED = 0.9
#: Scored pairs of a match, at most, that one task assigns; larger matches take rounds over all tasks, with the same result.
TOGETHER = 200_000
#: Width of the stretches of an index that are ranked apart.
STRETCH = 1000
#: Rows of a partition, about, beyond which a frame is dealt out to more partitions than the session's.
SHARE = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder. Where none is set, a local session gets one; a cluster has to name one that all share."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return (where or context.getCheckpointDir()).rstrip("/")


def checkpointed(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """df, computed once and read again from a table in the checkpoint folder, so that later joins know its size.

    The table goes when the driver's file system closes; a lost executor loses nothing of it. A round of a loop that `replaces`
    the one before deletes that one's table once its own is written.
    """
    spark = df.sparkSession
    place = lambda path: spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place(shared_dir(spark)).getFileSystem(spark._jsc.hadoopConfiguration())
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    files.deleteOnExit(place(path))
    if replaces is not None and hasattr(replaces, "_scratch"):
        files.delete(place(replaces._scratch), True)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, which has so many rows, dealt by the keys to as many partitions as they ask for, so that a task's share doesn't grow with the input.

    Where the session's number is enough, df stays as it is, and Spark shuffles it when it has to.
    """
    n = -(-rows // SHARE)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def last_of_number(keys: DataFrame) -> DataFrame:
    """One key row for each number: the last."""
    return keys.groupBy("match_id", "no").agg(F.max_by(F.struct(*[c for c in keys.columns if c not in ("match_id", "no")]), "k_idx").alias("r")).select("match_id", "no", "r.*")


def by_offset(paper: DataFrame, keys: DataFrame, offset: int = 0) -> DataFrame:
    """(match_id, p_idx, k_idx, confidence, method) where paper number + offset is a key number; 0 is the identity join."""
    k = last_of_number(keys).select("match_id", (F.col("no") - offset).alias("no"), "k_idx")
    confidence, method = (1.0, "same-number") if offset == 0 else (0.5, "offset")
    return paper.join(k, ["match_id", "no"]).select("match_id", "p_idx", "k_idx", F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))


def signatures(items: DataFrame, idx: str) -> DataFrame:
    """items(match_id, idx, text, options, alt, alt_options) to one row for each language variant, with its sets."""
    variants = F.array(F.struct("text", "options"), F.struct(F.col("alt").alias("text"), F.col("alt_options").alias("options")))
    rows = items.select("match_id", idx, F.explode(variants).alias("v")).where((F.col("v.text").isNotNull()) & (F.col("v.text") != ""))
    listed = X.tokens(F.col("v.text"))
    more = X.tokens(F.array_join(F.coalesce("v.options", F.array().cast("array<string>")), " "))
    rows = rows.withColumn("listed", listed).withColumn("tok", F.array_distinct("listed"))
    return rows.select("match_id", idx, "tok", F.array_union("tok", F.array_distinct(more)).alias("wide"), X.bigrams(F.col("v.text")).alias("bg"), F.size("listed").alias("len"))


def candidate_pairs(p: DataFrame, k: DataFrame) -> DataFrame:
    """(match_id, p_idx, k_idx) of signatures that share a token. A pair without one scores 0.3 at most."""
    left = p.select("match_id", "p_idx", F.explode("wide").alias("token")).distinct()
    right = k.select("match_id", "k_idx", F.explode("wide").alias("token")).distinct()
    return left.join(right, ["match_id", "token"]).select("match_id", "p_idx", "k_idx").distinct()


def alike_pairs(p: DataFrame, k: DataFrame, least: float) -> DataFrame:
    """(match_id, p_idx, k_idx) of signatures, among them all whose character pairs have a dice of least (above 0) or more.

    Two such sets have least / (2 - least) of each one's members in common, so in one order of the members they meet in the
    first ones of each, as many as leave fewer than that.
    """
    size = F.size("bg")
    first = F.greatest(size - F.ceil(size * (least / (2 - least)) - 1e-6) + 1, F.lit(0)).cast("int")
    head = lambda df, idx: df.select("match_id", idx, F.explode(F.slice(F.sort_array("bg"), F.lit(1), first)).alias("pair")).distinct()
    return head(p, "p_idx").join(head(k, "k_idx"), ["match_id", "pair"]).select("match_id", "p_idx", "k_idx").distinct()


def content_scores(p: DataFrame, k: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(match_id, p_idx, k_idx, s): the best score over the language variants, where it reaches the threshold.

    What bounds the score from above without the character pairs is tried first. Thresholds up to 0.3 can be reached
    without a common token, by character pairs alone. Only a threshold of 0, which every pair reaches, scores all pairs of a match.
    """
    if threshold > 0:
        ids = candidate_pairs(p, k)
        if threshold <= 0.3:
            ids = ids.unionByName(alike_pairs(p, k, threshold / 0.3)).distinct()
    else:
        ids = p.select("match_id", "p_idx").distinct().join(k.select("match_id", "k_idx").distinct(), "match_id")
    a = p.select("match_id", "p_idx", *[F.col(c).alias(f"a_{c}") for c in ("tok", "wide", "bg", "len")])
    b = k.select("match_id", "k_idx", *[F.col(c).alias(f"b_{c}") for c in ("tok", "wide", "bg", "len")])
    rows = ids.join(a, ["match_id", "p_idx"]).join(b, ["match_id", "k_idx"])
    short = F.when(F.least("a_len", "b_len") < 3, 0.82).otherwise(1.0)
    rows = rows.withColumn("cap", (0.72 + 0.28 * F.least("a_len", "b_len") / F.greatest("a_len", "b_len", F.lit(1))) * short)
    rows = rows.withColumn("base", 0.46 * X.overlap(F.col("a_tok"), F.col("b_tok")) + 0.24 * X.overlap(F.col("a_wide"), F.col("b_wide")))
    rows = rows.where((F.col("base") + 0.3) * F.col("cap") >= threshold)
    rows = rows.withColumn("s", (F.col("base") + 0.3 * X.dice(F.col("a_bg"), F.col("b_bg"))) * F.col("cap"))
    return rows.groupBy("match_id", "p_idx", "k_idx").agg(F.max("s").alias("s")).where(F.col("s") >= threshold)


def _greedy(pairs: pd.DataFrame) -> pd.DataFrame:
    taken_p, taken_k, rows = set(), set(), []
    pairs = pairs.sort_values(["s", "p_idx", "k_idx"], ascending=[False, True, True])
    for at, (p, k) in enumerate(zip(pairs["p_idx"], pairs["k_idx"], strict=True)):
        if p not in taken_p and k not in taken_k:
            taken_p.add(p)
            taken_k.add(k)
            rows.append(at)
    return pairs.iloc[rows].rename(columns={"s": "confidence"}).assign(method="content")


def greedy(pairs: DataFrame, keys: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """One-to-one assignment in each match, by falling score, ties by p_idx, then k_idx.

    A match is told by the columns `keys`. Matches of at most TOGETHER pairs are assigned in one task each. In larger ones, each round
    takes the pairs that come first in that order both for their p_idx and for their k_idx, which are those that going through the
    pairs one by one takes too.
    """
    pairs = checkpointed(pairs.select(*keys, "p_idx", "k_idx", "s"))
    schema = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in (*keys, "p_idx", "k_idx")) + ", confidence double, method string"
    done, left = None, pairs
    while True:
        count = left.groupBy(*keys).count()
        more = (count.agg(F.max("count")).first()[0] or 0) > TOGETHER
        large = checkpointed(count.where(F.col("count") > TOGETHER).select(*keys)) if more else None
        small = left.join(large, [*keys], "left_anti") if more else left
        found = small.groupBy(*keys).applyInPandas(_greedy, schema)
        done = found if done is None else done.unionByName(found)
        if not more:
            return done
        left = left.join(large, [*keys], "left_semi")
        place = F.min(F.struct((-F.col("s")).alias("order"), "p_idx", "k_idx")).alias("b")
        firsts = [left.groupBy(*keys, c).agg(place).select(*keys, "b.p_idx", "b.k_idx", (-F.col("b.order")).alias("confidence")) for c in ("p_idx", "k_idx")]
        both = checkpointed(firsts[0].join(firsts[1].drop("confidence"), [*keys, "p_idx", "k_idx"]))
        done = done.unionByName(both.withColumn("method", F.lit("content")))
        left = checkpointed(left.join(both, [*keys, "p_idx"], "left_anti").join(both, [*keys, "k_idx"], "left_anti"))


def ranked(rows: DataFrame, idx: str) -> DataFrame:
    """rows(match_id, idx), idx a number, with its rank in the match and n, the rows of the match; stretches of idx are ranked apart."""
    rows = rows.withColumn("_stretch", F.floor(F.col(idx) / STRETCH))
    order = W.partitionBy("match_id").orderBy("_stretch")
    counts = rows.groupBy("match_id", "_stretch").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(order) - F.col("_n")).withColumn("n", F.sum("_n").over(W.partitionBy("match_id")))
    rows = rows.withColumn("_rank", F.row_number().over(W.partitionBy("match_id", "_stretch").orderBy(idx)))
    return rows.join(counts, ["match_id", "_stretch"]).select("match_id", idx, (F.col("_rank") + F.col("_before")).alias("rank"), "n")


def position_fallback(paper: DataFrame, keys: DataFrame, assigned: DataFrame) -> DataFrame:
    """Pairs what is left over on both sides in order, where it is as many and few: 3 or a quarter of the paper."""
    left = ranked(paper.select("match_id", "p_idx").join(assigned, ["match_id", "p_idx"], "left_anti"), "p_idx")
    right = ranked(keys.select("match_id", "k_idx").join(assigned, ["match_id", "k_idx"], "left_anti"), "k_idx")
    size = paper.groupBy("match_id").agg(F.count("*").alias("size"))
    both = left.join(right, ["match_id", "rank", "n"]).join(size, "match_id").where(F.col("n") <= F.greatest(F.lit(3.0), 0.25 * F.col("size")))
    return both.select("match_id", "p_idx", "k_idx", F.lit(0.3).alias("confidence"), F.lit("position").alias("method"))


def by_content(paper: DataFrame, keys: DataFrame, threshold: float = THRESHOLD, fallback: bool = True, scores: DataFrame | None = None) -> DataFrame:
    """Assignment of paper items to key items by their wording."""
    scores = content_scores(signatures(paper, "p_idx"), signatures(keys, "k_idx"), threshold) if scores is None else scores.where(F.col("s") >= threshold)
    found = checkpointed(greedy(scores))
    return found.unionByName(position_fallback(paper, keys, found)) if fallback else found


def ladder(paper: DataFrame, keys: DataFrame, rungs: Iterable[float] = LADDER) -> DataFrame:
    """The first rung that covers COVERED of the paper, or else the one with most content rows, the earliest on ties.

    Pairs are scored once, for the lowest rung, and all rungs are assigned as one frame, by match and rung. What is left over is paired
    by position for the chosen rung alone; a match without a content row at any rung is paired so altogether.
    """
    rungs = list(rungs)
    scores = content_scores(signatures(paper, "p_idx"), signatures(keys, "k_idx"), min(rungs))
    reached = F.filter(F.array(*[F.when(F.col("s") >= r, i) for i, r in enumerate(rungs)]), lambda x: x.isNotNull())
    found = checkpointed(greedy(scores.withColumn("rung", F.explode(reached)), ("match_id", "rung")))
    size = paper.groupBy("match_id").agg(F.count("*").alias("size"))
    count = found.groupBy("match_id", "rung").agg(F.count("*").alias("content")).join(size, "match_id")
    covers = F.col("content") >= COVERED * F.col("size")
    best = count.groupBy("match_id").agg(F.coalesce(F.min(F.when(covers, F.col("rung"))), F.min_by("rung", F.struct(-F.col("content"), "rung"))).alias("rung"))
    content = found.join(best, ["match_id", "rung"]).drop("rung")
    return content.unionByName(position_fallback(paper, keys, content))


def recovered(paper: DataFrame, assigned: DataFrame, found: DataFrame) -> DataFrame:
    """(match_id, no, k_idx, confidence, method): paper numbers that only the key's wordings tell.

    found(match_id, k_idx, no) are key items whose phrases stand in the paper's text, with the number printed before them; numbers that
    the paper has and key items that are assigned already stay as they are.
    """
    new = found.join(paper.select("match_id", "no"), ["match_id", "no"], "left_anti").join(assigned.select("match_id", "k_idx"), ["match_id", "k_idx"], "left_anti")
    first = new.groupBy("match_id", "no").agg(F.min("k_idx").alias("k_idx"))
    return first.select("match_id", "no", "k_idx", F.lit(0.5).alias("confidence"), F.lit("rev").alias("method"))


def three_way(paper: DataFrame, other: DataFrame, official: DataFrame) -> DataFrame:
    """paper(match_id, p_idx) through an assignment to the other series' numbers, and on to the official answers; the first key row wins."""
    first = official.groupBy("match_id", "no").agg(F.min_by("answer", "k_idx").alias("answer"))
    return paper.join(other, ["match_id", "p_idx"], "left").join(first, ["match_id", "no"], "left").select("match_id", "p_idx", "no", F.coalesce("answer", F.lit("")).alias("answer"))


def dense(marks: DataFrame, key: DataFrame) -> DataFrame:
    """(match_id, no, mine, correct) for each number from 1 to the greatest on either side; the last mark wins.

    Both sides are dealt by match and grouped as one frame; each number brings those that lack before it, so there is one shuffle and
    one sort. Numbers below 1 are none; rows without a match get numbers, but no answers.
    """
    side = lambda df, mine: df.select("match_id", F.col("no").cast("int").alias("no"), F.lit(mine).alias("is_mark"), "ord", "answer").where("no >= 1")
    both = side(marks, True).unionByName(side(key, False)).repartition("match_id")
    last = lambda mark: F.max_by("answer", F.when(F.col("is_mark") == mark, F.col("ord")))
    rows = both.groupBy("match_id", "no").agg(last(True).alias("mine"), last(False).alias("correct"))
    rows = rows.withColumn("from", F.coalesce(F.lag("no").over(W.partitionBy("match_id").orderBy("no")), F.lit(0)) + 1)
    rows = rows.select("match_id", F.explode(F.sequence("from", "no")).alias("at"), "no", "mine", "correct")
    own = lambda c: F.when((F.col("at") == F.col("no")) & F.col("match_id").isNotNull(), F.col(c)).alias(c)
    return rows.select("match_id", F.col("at").alias("no"), own("mine"), own("correct"))


def dense_sheet(marks: DataFrame, key: DataFrame, sizes: DataFrame, most: int = 300) -> DataFrame:
    """dense() for sheets of sizes(match_id, n) questions, n from 1 to `most`; key entries beyond `most` and marks beyond n are none."""
    rows = sizes.select("match_id", F.greatest(F.lit(1), F.least(F.lit(most), "n")).cast("int").alias("n"))
    rows = rows.select("match_id", F.explode(F.sequence(F.lit(1), "n")).alias("no"))
    last = lambda df, name: df.where(F.col("no").between(1, most)).groupBy("match_id", "no").agg(F.max_by("answer", "ord").alias(name))
    return rows.join(last(marks, "mine"), ["match_id", "no"], "left").join(last(key, "correct"), ["match_id", "no"], "left")


def merge_copies(items: DataFrame, key: str, idx: str) -> DataFrame:
    """items(key, idx, no, text, options, alt, alt_options, raw, stmt, script) and place: a Hindi copy of a number goes into the English one.

    The Hindi rows before the first English one go into the English ones in turn, each of which takes its copy's place in the
    order. Those after it all go into the first English row, of which the last is its alt. What finds no English row stays.
    Rows of one number of one document are few.
    """
    items = items.withColumn("place", F.col(idx))
    fields = [c for c in items.columns if c not in (key, "no")]
    groups = items.groupBy(key, "no").agg(F.sort_array(F.collect_list(F.struct(idx, *[c for c in fields if c != idx]))).alias("all"))
    of = lambda script: F.filter("all", lambda x: x["script"] == script)
    groups = groups.withColumn("en", of("en")).withColumn("hi", of("hi"))
    start = F.get("en", 0)[idx]
    early, late = F.filter("hi", lambda x: start.isNull() | (x[idx] < start)), F.filter("hi", lambda x: x[idx] > start)
    groups = groups.withColumn("early", early).withColumn("late", late)

    def with_copies(e: Column, k: Column) -> Column:
        mates = F.concat(F.slice("early", k + 1, F.lit(1)), F.when(k == 0, F.col("late")).otherwise(F.slice("late", 1, 0)))
        mate, own = F.get(mates, F.size(mates) - 1), F.size(F.coalesce(e["options"], F.array().cast("array<string>"))) > 0
        options = F.get(F.filter(F.transform(mates, lambda m: m["options"]), lambda o: F.size(o) > 0), 0)
        made = {
            "place": F.coalesce(F.get("early", k)[idx], e[idx]),
            "alt": F.when(F.size(mates) > 0, mate["text"]).otherwise(e["alt"]), "alt_options": F.when(F.size(mates) > 0, mate["options"]).otherwise(e["alt_options"]),
            "options": F.when(own, e["options"]).otherwise(F.coalesce(options, e["options"])),
            "raw": F.array_join(F.concat(F.array(e["raw"]), F.transform(mates, lambda m: m["raw"])), " "),
        }
        return F.struct(*[made.get(c, e[c]).alias(c) for c in [idx, *[c for c in fields if c != idx]]])

    left = F.slice("early", F.size("en") + 1, F.greatest(F.size("early") - F.size("en"), F.lit(0)))
    rows = groups.select(key, "no", F.explode(F.concat(F.transform("en", with_copies), left)).alias("q"))
    return rows.select(key, "no", "q.*")


def merge_translations(items: DataFrame) -> DataFrame:
    """items(match_id, no, p_idx, text, script): the English row of a number takes the other one's text as alt."""
    none = {"options": "array<string>", "alt": "string", "alt_options": "array<string>", "raw": "string", "stmt": "boolean"}
    rows = items.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in none.items()])
    return merge_copies(rows, "match_id", "p_idx").select("match_id", "no", "p_idx", "text", "script", "alt")


#: Questions that a key's own document has at least where it is a whole booklet.
BOOKLET = 8


def enrich(keys: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds the texts of questions(match_id, idx, no, text) parsed from the key's own document, where these are many enough to trust."""
    solid = lambda c: F.length(F.regexp_replace(c, r"\s", ""))
    n = keys.groupBy("match_id").agg(F.count("*").alias("n_keys"), F.count_if(solid("text") > 20).alias("with_text"))
    m = questions.groupBy("match_id").agg(F.count("*").alias("n_questions"))
    gate = m.join(n, "match_id", "left").fillna(0, ["n_keys", "with_text"])
    gate = gate.where((F.col("n_questions") >= F.greatest(F.lit(float(BOOKLET)), 0.5 * F.col("n_keys"))) & (F.col("n_questions") > F.col("with_text")))
    q = questions.where(solid("text") >= 12).join(gate.select("match_id"), "match_id", "left_semi")
    q = q.groupBy("match_id", "no").agg(F.min_by("text", "idx").alias("q_text"))
    rows = keys.join(q, ["match_id", "no"], "full")
    text = F.when(F.coalesce("text", F.lit("")) == "", F.coalesce("q_text", F.lit(""))).otherwise(F.col("text"))
    return rows.select("match_id", "no", F.coalesce("answer", F.lit("")).alias("answer"), text.alias("text"))

"""Whole results out of matched documents: the choice of how to match, and the map of one paper's numbers to another's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.operators import match, parse, score

#: Characters of a key text, without blanks, from which on a key is matched by wording, and from which on a row takes part in it.
WORDED, TELLING = 12, 3


def longest_of_number(paper: DataFrame) -> DataFrame:
    """paper(match_id, p_idx, no, text, ...): the row of each number with the longest text, the first on ties, p_idx anew by number."""
    rest = [c for c in paper.columns if c not in ("match_id", "no")]
    order = F.struct(-F.length(F.coalesce("text", F.lit(""))), "p_idx")
    best = paper.groupBy("match_id", "no").agg(F.min_by(F.struct(*rest), order).alias("b")).select("match_id", "no", "b.*")
    place = F.row_number().over(W.partitionBy("match_id").orderBy("no")) - 1
    return best.withColumn("p_idx", place).select(paper.columns)


def chosen(paper: DataFrame, keys: DataFrame) -> DataFrame:
    """(match_id, p_idx, k_idx, confidence, method): by wording where a key has texts, else by equal numbers."""
    solid = parse.solid(F.coalesce("text", F.lit("")))
    worded = match.checkpointed(keys.groupBy("match_id").agg(F.bool_or(solid > WORDED).alias("worded")).where("worded").select("match_id"))
    telling = keys.where(solid > TELLING).join(worded, "match_id", "left_semi")
    by_wording = match.ladder(paper.join(worded, "match_id", "left_semi"), telling)
    return by_wording.unionByName(match.by_offset(paper.join(worded, "match_id", "left_anti"), keys))


def results(papers: DataFrame, key_texts: DataFrame, answers: DataFrame) -> DataFrame:
    """Two texts of each match, papers(match_id, text) and key_texts(match_id, text), and answers(match_id, no, mine), to result rows."""
    none = F.lit(None)
    items = parse.questions(papers.withColumnRenamed("match_id", "doc_id"))
    paper = items.select(F.col("doc_id").alias("match_id"), F.col("idx").alias("p_idx"), "no", "text", "options", "alt", "alt_options")
    entries = parse.answer_key(key_texts.withColumnRenamed("match_id", "doc_id"))
    keys = entries.select(
        F.col("doc_id").alias("match_id"), F.col("idx").alias("k_idx"), "no", "answer", "text",
        none.cast("array<string>").alias("options"), none.cast("string").alias("alt"), none.cast("array<string>").alias("alt_options"),
    )
    paper, keys = match.checkpointed(paper), match.checkpointed(keys)
    mine = paper.select("match_id", "p_idx", "no").join(answers, ["match_id", "no"]).select("match_id", "p_idx", "mine")
    return score.result_rows(paper, chosen(paper, keys), keys, mine)


def number_map(paper: DataFrame, keys: DataFrame, paper_texts: DataFrame, key_texts: DataFrame) -> DataFrame:
    """(match_id, idx, no, key_no, text, confidence, method): which number of the other paper each question of this one bears.

    paper and keys are questions of both papers, the texts what these were parsed from. Wording comes first; a question that it
    leaves is looked for by its phrases in the other text; last, questions of the other paper that are still free are looked for in
    this paper's text, and add the numbers that its own parse has lost.
    """
    paper = match.checkpointed(longest_of_number(paper))
    keys = match.checkpointed(keys)
    assigned = match.checkpointed(match.ladder(paper, keys))
    numbers = keys.select("match_id", "k_idx", F.col("no").alias("key_no"))
    by_wording = assigned.join(numbers, ["match_id", "k_idx"]).select("match_id", "p_idx", "key_no", "k_idx", "confidence", "method")

    stems = parse.by_stem(paper.select("match_id", "p_idx", "text"), key_texts).withColumnRenamed("no", "key_no")
    free = stems.join(by_wording, ["match_id", "p_idx"], "left_anti").join(by_wording, ["match_id", "key_no"], "left_anti")
    last = match.last_of_number(keys.select("match_id", "no", "k_idx")).withColumnRenamed("no", "key_no")
    by_stem = free.join(last, ["match_id", "key_no"], "left").select("match_id", "p_idx", "key_no", "k_idx", "confidence", "method")

    found = match.checkpointed(by_wording.unionByName(by_stem))
    reverse = parse.by_stem(keys.select("match_id", F.col("k_idx").alias("p_idx"), "text"), paper_texts).withColumnRenamed("p_idx", "k_idx")
    lost = match.recovered(paper, found.where("k_idx is not null"), reverse.select("match_id", "k_idx", "no"))
    lost = lost.join(keys.select("match_id", "k_idx", F.col("no").alias("key_no"), "text"), ["match_id", "k_idx"])

    rows = paper.select("match_id", "p_idx", "no", "text").join(found, ["match_id", "p_idx"], "left")
    columns = ["match_id", "no", "key_no", "text", "confidence", "method"]
    rows = rows.select(columns).unionByName(lost.select(columns))
    place = F.row_number().over(W.partitionBy("match_id").orderBy("no")) - 1
    return rows.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("method", F.coalesce("method", F.lit(""))).select("match_id", place.alias("idx"), *columns[1:])


def answers_through(rows: DataFrame, official: DataFrame) -> DataFrame:
    """number_map rows with the answer that official(match_id, k_idx, no, answer) has for the other paper's number."""
    first = official.groupBy("match_id", F.col("no").alias("key_no")).agg(F.min_by("answer", "k_idx").alias("answer"))
    return rows.join(first, ["match_id", "key_no"], "left").withColumn("answer", F.coalesce("answer", F.lit("")))


def misread(keys: DataFrame, letters: DataFrame) -> DataFrame:
    """(match_id): keys(match_id, answer) in which an answer lies outside the sheet's letters(match_id, n), and so is to be read again."""
    allowed = F.substring(F.lit("ABCDEFGH"), F.lit(1), F.col("n"))
    return keys.join(letters.where("n > 0"), "match_id").where(~F.contains(allowed, F.col("answer"))).select("match_id").distinct()

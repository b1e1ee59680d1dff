"""Quality rules by a hashed n-gram log-likelihood ratio, in built-in expressions only.

Base counts per text; then the mean, over a text's words and word pairs, of log p_target(bucket) - log p_raw(bucket).
p_raw are the bucket shares over every document. p_target are those over every trusted document.
A document is kept when its base rules hold and its mean ratio reaches what all but SHARE of the trusted documents reach
that have enough words: one number for a corpus, no random draw.

Null or empty text: no words, all counts 0, base_failed, not kept, score 0. Without trusted documents every score is 0, and all
that pass the base rules are kept. Repeated rows each get a row. Columns
of the input other than doc_id and text are not read, and the pipeline's stage hands them on, whatever their names; score()
itself adds its own columns, in place of any that bear their names. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, put_back, set_aside, small_or_shuffled, table, written

BUCKETS = 1 << 14
#: Share of the trusted documents that the threshold leaves below it, and the step of scores in which it is told.
SHARE, STEP = 0.001, 0.001
WINDOW = 5
#: Words that a text has at least.
WORDS = 10


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def bigrams_of(hashes: Column) -> Column:
    """Hash of each word with the next one; the last word goes with the end of the text."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + 1)))


def bucket(pair: Column) -> Column:
    return F.pmod(pair, F.lit(BUCKETS)).cast("int")


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and _grams, the hashes of words and word pairs, to docs(text, ...)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_words", words_of(F.col("text"))).withColumn("n_words", F.size("_words"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    without = text
    for symbol in "#*$%&|<>":
        without = F.replace(without, F.lit(symbol), F.lit(""))
    df = (
        df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(without)).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .drop("_lines")
    )
    df = df.withColumn("_hashes", hashes_of(F.col("_words"))).drop("_words")
    df = df.withColumn("_pairs", bigrams_of(F.col("_hashes")))
    df = df.withColumn("_fours", F.transform("_pairs", lambda x, i: F.xxhash64(x, F.get("_pairs", i + 2))))
    fives = F.transform("_fours", lambda x, i: F.xxhash64(x, F.get("_hashes", i + 4)))
    df = df.withColumn("_fives", F.slice(fives, 1, F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)))).drop("_fours")
    df = df.withColumn("_grams", F.concat("_hashes", "_pairs")).drop("_hashes", "_pairs")
    repeated = F.size(F.array_distinct("_fives")) < F.size("_fives")
    ranked = F.when(repeated, F.sort_array(F.transform("_fives", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_ranked", ranked).drop("_fives")

    def twice(x: Column, k: Column) -> Column:
        same = lambda at: F.coalesce(F.get(F.col("_ranked"), at)["h"] == x["h"], F.lit(False))
        return same(k + 1) | F.when(k > 0, same(k - 1)).otherwise(F.lit(False))

    at = F.sort_array(F.transform(F.filter("_ranked", twice), lambda x: x["i"]))
    df = df.withColumn("_at", at).drop("_ranked")
    covered = F.aggregate(
        F.transform("_at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), k + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("_at")


def bucket_counts(docs: DataFrame, name: str) -> DataFrame:
    """(bucket, name): how often each hashed word and word pair occurs in docs(text)."""
    hashes = docs.select(hashes_of(words_of(F.col("text"))).alias("h"))
    grams = hashes.select(F.explode(F.concat("h", bigrams_of(F.col("h")))).alias("gram"))
    return grams.groupBy(bucket(F.col("gram")).alias("bucket")).agg(F.count("*").alias(name))


def ratio_table(docs: DataFrame, trusted_docs: DataFrame) -> DataFrame:
    """One row, one column: the array of BUCKETS log ratios, add-one smoothed. Its size does not grow with docs."""
    target, every = bucket_counts(trusted_docs, "t"), bucket_counts(docs, "r")
    both = (
        docs.sparkSession.range(BUCKETS)
        .select(F.col("id").cast("int").alias("bucket"))
        .join(every, "bucket", "left")
        .join(target, "bucket", "left")
        .fillna(0)
    )
    # BUCKETS rows at most reach this one task, however large the corpus is
    packed = both.agg(F.sort_array(F.collect_list(F.struct("bucket", "t", "r"))).alias("all"), F.sum("t").alias("nt"), F.sum("r").alias("nr"))
    share = lambda n, total: F.log((n + 1) / (F.col(total) + BUCKETS))
    none = F.col("nt") == 0
    return packed.select(
        F.transform("all", lambda x: F.when(none, F.lit(0.0)).otherwise(share(x["t"], "nt") - share(x["r"], "nr"))).alias("ratios")
    )


def mean_ratio(df: DataFrame, ratios: Column) -> DataFrame:
    """Adds score to a frame with n_words and _grams, which goes."""
    # the scalar subquery is a column of its own, for lambdas may not hold one; the optimiser folds it into its one use
    df = df.withColumn("_ratios", ratios)
    df = df.withColumn("_total", F.aggregate("_grams", F.lit(0.0), lambda a, x: a + F.get("_ratios", bucket(x)))).drop("_ratios")
    return df.withColumn("score", F.when(F.col("n_words") > 0, F.col("_total") / (2 * F.col("n_words"))).otherwise(F.lit(0.0))).drop("_grams", "_total")


def rated(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds the base counts, base_failed and score to docs(doc_id, text, ...); ids(doc_id) are the trusted ones, each once."""
    texts = docs.select("doc_id", "text")
    ratios = ratio_table(texts, texts.join(small_or_shuffled(ids), "doc_id", "left_semi")).scalar()
    df = base_counts(docs)
    df = df.withColumn("base_failed", (F.col("n_words") < WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return mean_ratio(df, ratios)


def cutoff(scores: DataFrame, share: float = SHARE) -> float | None:
    """The score, down to the STEP, of the row at floor(n * share) from below, of those with enough words; null if there is none."""
    counts = scores.where(F.col("n_words") >= WORDS).groupBy(F.floor(F.col("score") / STEP).alias("step")).agg(F.count("*").alias("n"))
    upto, every = F.sum("n").over(W.orderBy("step")), F.sum("n").over(W.partitionBy())  # scores span few steps
    found = counts.select("step", upto.alias("upto"), every.alias("every")).where(F.col("upto") > F.floor(F.col("every") * share))
    least = found.agg(F.min("step")).first()[0]
    return None if least is None else least * STEP


def decided(rows: DataFrame, ids: DataFrame, threshold: float | None = None) -> DataFrame:
    """Adds kept to a written table of rated rows; without a threshold the trusted ones among them tell it."""
    if threshold is None:
        threshold = cutoff(rows.select("doc_id", "n_words", "score").join(small_or_shuffled(ids), "doc_id", "left_semi"))
    enough = F.lit(True) if threshold is None else F.col("score") >= threshold
    return rows.withColumn("kept", ~F.col("base_failed") & enough)


def distinct_ids(trusted_ids: DataFrame) -> DataFrame:
    return written(trusted_ids.select("doc_id").where("doc_id is not null").distinct(), "trusted")


def score(docs: DataFrame, trusted_ids: DataFrame, threshold: float | None = None) -> DataFrame:
    """Adds the base counts, base_failed, score and kept to docs(doc_id, text, ...)."""
    ids = distinct_ids(trusted_ids)
    return decided(written(rated(docs, ids), "rated"), ids, threshold)


def trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    ids = distinct_ids(trusted(table(spark, sf_dir, "labels")))
    rows = rated(table(spark, sf_dir, "documents").select("doc_id", "text"), ids).drop("text")
    return decided(written(rows, "rated"), ids).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "score",
    )


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the quality rules keep, with their columns as they were."""
    ids = distinct_ids(trusted(table(spark, sf_dir, "labels")))
    rows = rated(set_aside(docs, "doc_id", "text"), ids).select("doc_id", "text", "_rest", "n_words", "base_failed", "score")
    return decided(written(rows, "rated"), ids).where("kept").select(*put_back(docs.columns, {c: F.col(c) for c in ("doc_id", "text")}))

import math
import random
import struct
from collections import Counter

import brute
import pytest
import xxhash

from quillmatch.llm import common, quality

SCHEMA = "doc_id long, text string, score string, _words string, kept string"


def fixture():
    rng = random.Random(3)
    good = [f"w{k}" for k in range(40)]
    bad = [f"z{k}" for k in range(40)]
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=rng.randint(5, 60)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, "a b c d e f g h i j " * 9), (64, "x # y\nx # y\n\nx # y\n|<>&%$*"), (65, "ä ß\x0bé ü  漢字"), (66, rows[1][1]), (66, rows[1][1]), (None, rows[3][1])]
    rows += [(67, " ".join(rng.choices(["p", "q"], k=300))), (68, "one " * 20_000), (69, rows[1][1] + " " + rows[5][1] + " " + rows[1][1])]
    return [(i, t, f"s{k}", "w", "k") for k, (i, t) in enumerate(rows)]


def signed(data, seed=42):
    value = xxhash.xxh64(data, seed=seed % 2**64).intdigest()
    return value - 2**64 if value >> 63 else value


def buckets(words):
    """Of the words, and of each word with the next one."""
    hashes = [signed(w.encode()) for w in words]
    pack = lambda x: struct.pack("<q", x)
    pairs = [signed(pack(a)) if b is None else signed(pack(b), signed(pack(a))) for a, b in zip(hashes, [*hashes[1:], None])]
    return [x % quality.BUCKETS for x in hashes + pairs]


def expected_scores(rows, trusted):
    grams = [buckets(brute.WORD.findall(r[1] or "")) for r in rows]
    raw = Counter(g for x in grams for g in x)
    target = Counter(g for x, r in zip(grams, rows) if r[0] in trusted for g in x)
    nr, nt, b = sum(raw.values()), sum(target.values()), quality.BUCKETS
    ratio = lambda g: math.log((target[g] + 1) / (nt + b)) - math.log((raw[g] + 1) / (nr + b))
    return [sum(map(ratio, x)) / len(x) if x else 0.0 for x in grams]


def test_counts_and_scores_follow_the_definition(spark):
    rows = fixture()
    trusted = {i for i in range(60) if i % 2}
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("score", "tag").drop("_words", "kept")
    labels = spark.createDataFrame([(i,) for i in trusted] + [(None,), (1,)], "doc_id long")
    found = {r.tag: r for r in quality.score(docs, labels).collect()}
    assert len(found) == len(rows)
    scores = expected_scores(rows, trusted)
    # all but a thousandth of the trusted documents with ten words or more reach the threshold: here the least of them
    least = min(s for r, s in zip(rows, scores, strict=True) if r[0] in trusted and len(brute.WORD.findall(r[1])) >= 10)
    threshold = math.floor(least / quality.STEP) * quality.STEP
    for row, score in zip(rows, scores, strict=True):
        got = found[row[2]]
        counts = brute.quality_counts(row[1])
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == counts
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        assert got.base_failed == failed and got.kept == (not failed and got.score >= threshold)
        assert got.score == pytest.approx(score, abs=1e-9)


def test_stage_keeps_columns_of_any_name(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame([(i, 1) for i in range(1, 60, 2)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = quality.keep_good(spark, docs, str(tmp_path))
    verdict = quality.score(docs.select("doc_id", "text"), spark.createDataFrame([(i,) for i in range(1, 60, 2)], "doc_id long"))
    texts = {(r.doc_id, r.text) for r in verdict.collect() if r.kept}
    assert kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(repr(r) for r in rows if r[:2] in texts)
    assert texts and len(texts) < len(rows)


def test_no_rows_and_no_labels(spark):
    docs = spark.createDataFrame(fixture(), SCHEMA).select("doc_id", "text")
    none = spark.createDataFrame([], "doc_id long")
    assert quality.score(docs.limit(0), none).count() == 0
    unlabelled = quality.score(docs, none).collect()
    assert {r.score for r in unlabelled} == {0.0} and all(r.kept == (not r.base_failed) for r in unlabelled)


def test_cutoff_leaves_a_share_below(spark):
    rng = random.Random(8)
    scores = [rng.uniform(-1, 1) for _ in range(400)]
    rows = spark.createDataFrame([(10 + k % 5, s) for k, s in enumerate(scores)] + [(9, -5.0)], "n_words int, score double").repartition(5)
    for share in (0.0, 0.001, 0.1, 0.5):
        assert quality.cutoff(rows, share) == pytest.approx(math.floor(sorted(scores)[int(400 * share)] / quality.STEP) * quality.STEP)
    assert quality.cutoff(rows.where("n_words < 10")) is None


@pytest.mark.parametrize("limit", [10**6, 0])
def test_every_trusted_document_counts(spark, monkeypatch, limit):
    monkeypatch.setattr(quality, "small_or_shuffled", lambda ids: common.small_or_shuffled(ids, limit), raising=False)
    rows = [(i, f"w{i} x{i % 7}") for i in range(21_000)]
    trusted = set(range(20_500))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = dict(quality.score(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).select("doc_id", "score").collect())
    assert found == pytest.approx(dict(enumerate(expected_scores(rows, trusted))), abs=1e-9)

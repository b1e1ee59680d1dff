import random

import brute
import pytest

from quillmatch.llm import mixing

SCHEMA = "doc_id long, source string, text string, _times int, _size string, c string"


def fixture(n=200, seed=1):
    rng = random.Random(seed)
    sources = ["a", "b", "B", "é", None, "c"]
    rows = [(i, rng.choices(sources, [60, 5, 1, 8, 4, 1])[0], "w " * rng.randint(0, 40)) for i in range(n)]
    return [*rows, (n, "a", None), (n + 1, "empty", ""), (n + 2, "a", "x " * 3000)]


def test_mix_follows_the_queue(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert len(found) == len(rows)
    for doc, size, source_size, target, taken in brute.mixed(rows):
        got = found[doc]
        assert (got.size, got.source_size, got.taken) == (size, source_size, taken)
        assert got.target == pytest.approx(target)
        assert got.taken <= 3 * size


def test_sources_come_near_their_targets(spark):
    rows = fixture(3000, 2)[:3000]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    for source in {r.source for r in found}:
        mine = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) + 1
    assert sum(brute.mix_targets({r.source: r.source_size for r in found}).values()) == pytest.approx(sum(r.size for r in found))


def test_many_buckets_give_the_same_mix(spark, monkeypatch):
    docs = spark.createDataFrame(fixture(), "doc_id long, source string, text string")
    whole = sorted(map(repr, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    assert sorted(map(repr, mixing.mix(docs.repartition(7)).collect())) == whole


def test_stage_repeats_whole_rows(spark):
    rows = [(*r, k, f"s{k}", "c") for k, r in enumerate(fixture())]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = {d: t // s if s else 0 for d, s, _, _, t in brute.mixed([r[:3] for r in rows])}
    expected = [repr(r) for r in rows for _ in range(taken[r[0]])]
    out = mixing.take_mix(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(repr(tuple(r)) for r in out.collect()) == sorted(expected)


def test_empty_tables_and_wordless_texts(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs).collect()] == [0, 0]
    assert mixing.take_mix(spark, docs, "").count() == 0


def test_repeated_rows_queue_one_after_the_other(spark):
    rows = [(1, "a", "w w w")] * 4 + [(None, "b", "w")] * 2
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert len(found) == 6 and all(r.taken % r.size == 0 for r in found)

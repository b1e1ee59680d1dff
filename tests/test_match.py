import random

from hypothesis import given, settings
from hypothesis import strategies as st
import pandas as pd
from pyspark.sql import functions as F

from quillmatch.operators import analyze, match, score, sequence

ITEM = "match_id int, {0} int, no int, text string, options array<string>, alt string, alt_options array<string>"


def items(spark, idx, texts, first=1):
    return spark.createDataFrame([(1, i, i + first, t, None, None, None) for i, t in enumerate(texts)], ITEM.format(idx))


def pairs(df):
    return sorted((r.p_idx, r.k_idx, r.method) for r in df.collect())


def test_scores(spark):
    text = "Which planet is known as the Red Planet?"
    p, k = items(spark, "p_idx", [text, "Capital of Australia is?"]), items(spark, "k_idx", [text, "Capital of Australia is?"])
    found = {(r.p_idx, r.k_idx): round(r.s, 6) for r in match.content_scores(match.signatures(p, "p_idx"), match.signatures(k, "k_idx")).collect()}
    assert found == {(0, 0): 1.0, (1, 1): 0.82}


def test_content_and_fallback(spark):
    texts = ["Which planet is called the red planet today", "Largest river on the continent of Africa", "Inventor of the electric light bulb was", "zzz qqq"]
    found = pairs(match.by_content(items(spark, "p_idx", texts), items(spark, "k_idx", [texts[2], texts[0], texts[1], "yyy www"])))
    assert found == [(0, 1, "content"), (1, 2, "content"), (2, 0, "content"), (3, 3, "position")]
    found = pairs(match.by_content(items(spark, "p_idx", [*texts, "vvv uuu"]), items(spark, "k_idx", [texts[2], texts[0], texts[1], "yyy www"])))
    assert len(found) == 3


def test_ladder_takes_an_early_rung(spark):
    texts = ["Which planet is called the red planet today", "Largest river on the continent of Africa"]
    assert pairs(match.ladder(items(spark, "p_idx", texts), items(spark, "k_idx", texts))) == [(0, 0, "content"), (1, 1, "content")]


def test_offset(spark):
    p = items(spark, "p_idx", ["a", "b", "c"])
    k = spark.createDataFrame([(1, 0, 21), (1, 1, 22), (1, 2, 22)], "match_id int, k_idx int, no int")
    assert pairs(match.by_offset(p, k, 20)) == [(0, 0, "offset"), (1, 2, "offset")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.sampled_from([0.5, 0.6, 0.7])), max_size=20, unique_by=lambda x: x[:2]))
def test_greedy_is_a_matching_and_equals_mutual_best_rounds(rows):
    found = match._greedy(pd.DataFrame([(1, *r) for r in rows], columns=["match_id", "p_idx", "k_idx", "s"]))
    assert found.p_idx.is_unique and found.k_idx.is_unique
    left, rounds = sorted(rows, key=lambda r: (-r[2], r[0], r[1])), set()
    while left:
        p, k, _ = left[0]
        rounds.add((p, k))
        left = [r for r in left if r[0] != p and r[1] != k]
    assert set(zip(found.p_idx, found.k_idx, strict=True)) == rounds


def test_states_and_totals(spark):
    rows = spark.createDataFrame([(1, s) for s in ["correct"] * 3 + ["wrong"] * 2 + ["blank"]] + [(2, "wrong")], "match_id int, state string")
    found = {r.match_id: (r.score, r.max, r.percent) for r in score.totals(rows.where("match_id = 1"), wrong=-0.25).collect()}
    assert found == {1: (2.5, 6.0, 41.7)}
    assert score.totals(rows.where("match_id = 2"), right=0, wrong=0.125).first().score == -0.12


def test_overrides(spark):
    rows = spark.createDataFrame([(1, i, "", m, s) for i, m, s in [(0, "B", "unmatched"), (1, "B", "correct"), (2, "A", "wrong")]], "match_id int, p_idx int, correct string, mine string, state string")
    anew = spark.createDataFrame([(1, 0, "b"), (1, 1, "")], "match_id int, p_idx int, override string")
    assert [r.state for r in score.overridden(rows, anew).orderBy("p_idx").collect()] == ["correct", "blank", "wrong"]
    state = spark.range(1).select(score.state(F.lit(True), F.lit(""), F.lit("B")).alias("a"), score.state(F.lit(False), F.lit(None), F.lit("B")).alias("b")).first()
    assert (state.a, state.b) == ("wrong", "unmatched")


def test_subjects(spark):
    rows = spark.createDataFrame([("HCF of 12 and 18 is?",), ("Which gas is most abundant",), ("plain",)], "q string")
    assert [r.b for r in rows.select(analyze.bucket(F.col("q")).alias("b")).collect()] == ["Mathematics", "Science", "Other"]


def test_clusters(spark):
    rows = spark.createDataFrame([(1, float(v)) for v in [1, 2, 10, 11, 30]], "k int, v double")
    assert sorted(r["mean"] for r in sequence.cluster_axis(rows, "k", "v", 2).collect()) == [1.5, 10.5, 30]


def test_items(spark):
    rows = [(1, 0, "A", 0.0, 100.0, 5.0), (1, 1, "B", 6.0, 100.0, 5.0), (1, 2, "C", 20.0, 100.0, 5.0), (1, 3, "D", 0.0, 80.0, 5.0)]
    assert sequence.items_to_lines(spark.createDataFrame(rows, "page_id int, ord int, str string, x double, y double, width double")).first().text == "AB C\nD"


def test_reads(spark):
    rows = spark.sql("select 'k' as k, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,h) as at from values (0), (11), (13), (24), (26) as t(h)")
    assert [r["at"].hour for r in sequence.read_dedup(rows).orderBy("at").collect()] == [0, 13, 2]


def test_a_large_match_takes_rounds_with_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(match, "TOGETHER", 60, raising=False)
    rng = random.Random(5)
    rows = [(m, p, k, rng.choice([0.5, 0.6, 0.7, rng.random()])) for m, n in ((1, 20), (2, 5)) for p in range(n) for k in range(n) if rng.random() < 0.8]
    frame = pd.DataFrame(rows, columns=["match_id", "p_idx", "k_idx", "s"])
    expected = pd.concat([match._greedy(g) for _, g in frame.groupby("match_id")])
    whole = match._greedy
    monkeypatch.setattr(match, "_greedy", lambda pdf: whole(pdf) if len(pdf) <= 60 else pdf.loc[-1])
    found = match.greedy(spark.createDataFrame(rows, "match_id int, p_idx int, k_idx int, s double"))
    assert sorted(map(tuple, found.collect())) == sorted(expected.itertuples(index=False, name=None))


def test_low_thresholds_need_no_cross_join(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(2, 14))) for _ in range(60)] + ["aaa aaaa aaaaa", "aaaaaa aaaaaaa aaaaaaaa", "of the", "", "zq zq"]
    p, k = match.signatures(items(spark, "p_idx", texts), "p_idx"), match.signatures(items(spark, "k_idx", texts[::-1]), "k_idx")
    every = {(r.p_idx, r.k_idx): r.s for r in match.content_scores(p, k, 0.0).collect()}
    for threshold in (0.28, 0.2):
        rows = match.content_scores(p, k, threshold)
        assert {(r.p_idx, r.k_idx): r.s for r in rows.collect()} == {i: s for i, s in every.items() if s >= threshold}
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "pair" in plan
    shared = {(r.p_idx, r.k_idx) for r in match.candidate_pairs(p, k).collect()}
    assert {i for i, s in every.items() if s >= 0.28} - shared  # some are alike without a common token


def test_left_over_ranks_go_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(match, "STRETCH", 3, raising=False)
    p = spark.createDataFrame([(m, i * 2) for m in (1, 2) for i in range(40)], "match_id int, p_idx int")
    k = spark.createDataFrame([(m, i * 5) for m in (1, 2) for i in range(40)], "match_id int, k_idx int")
    done = spark.createDataFrame([(m, i * 2, i * 5) for m in (1, 2) for i in range(40) if i % 5], "match_id int, p_idx int, k_idx int")
    rows = match.position_fallback(p, k, done)
    assert sorted((r.match_id, r.p_idx, r.k_idx) for r in rows.collect()) == [(m, i * 2, i * 5) for m in (1, 2) for i in range(0, 40, 5)]
    assert "_stretch" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_cached_reads_are_a_stream(spark):
    rng = random.Random(6)
    hours = [(rng.choice(["a", "b", None]), rng.randint(0, 200)) for _ in range(300)] + [("c", None), ("d", 7)]
    expected, last = [], {}
    for k, h in sorted((x for x in hours if x[1] is not None), key=lambda x: x[1]):
        if k not in last or h - last[k] >= 12:
            last[k] = h
            expected.append((k, h * 3600))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        rows = sequence.read_dedup(spark.createDataFrame(hours, "k string, h long").select("k", F.timestamp_seconds(F.col("h") * 3600).alias("at")))
        found = [(r.k, r.at) for r in rows.select("k", F.col("at").cast("long").alias("at")).collect()]
    finally:
        spark.conf.set(name, before)
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert "collect_list" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_dense_by_one_shuffle(spark):
    marks = spark.createDataFrame([(1, 3, "A", 5), (1, 3, "B", 7), (2, 0, "A", 1), (None, 2, "C", 1), (4, None, "D", 1), (5, 1, "A", None)], "match_id long, no int, answer string, ord long")
    key = spark.createDataFrame([(1, 2, "C", 1), (1, 4, None, 9), (1, 4, "D", 8), (3, 1, "A", 1), (1, -2, "E", 1)], "match_id long, no int, answer string, ord long")
    found = match.dense(marks, key)
    want = [(1, 1, None, None), (1, 2, None, "C"), (1, 3, "B", None), (1, 4, None, None), (3, 1, None, "A"), (5, 1, None, None), (None, 1, None, None), (None, 2, None, None)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    plan = match.dense(marks, key)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmatch.llm import toxicity
from quillmatch.llm.bytescan import flat

DATA = "/root/testdata/sf0.1"  # sf0.01 has 45 toxic rows to learn from and 6 to judge by


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    texts = ["the cat sat on the mat", "you are " + "a very bad thing " * 12, "", "ok ok"]
    t = toxicity._tokens(texts)
    y, w = np.array([0, 1, 0, 1], np.float64), np.array([1, 2, 1, 1], np.float64)
    model = {k: v.astype(np.float64) for k, v in toxicity.new_model().items()}
    _, g = toxicity.gradients(model, t, y, w)
    for name, value in model.items():
        flat_g = g[name].reshape(-1)
        for k in rng.choice(np.flatnonzero(np.abs(flat_g) > np.abs(flat_g).max() / 4), 3):
            old, step = value.reshape(-1)[k], 3e-3
            value.reshape(-1)[k] = old + step
            above = toxicity.gradients(model, t, y, w)[0]
            value.reshape(-1)[k] = old - step
            below = toxicity.gradients(model, t, y, w)[0]
            value.reshape(-1)[k] = old
            assert flat_g[k] == pytest.approx((above - below) / (2 * step), rel=0.05, abs=1e-5), name


def test_a_text_is_read_to_its_end():
    good, bad = ["calm water and green hills", "bread with butter today", "rain over the quiet town"], ["foul awful scum", "hateful scum again", "awful hateful words"]
    mixed = [f"{g} {b} {h}" for g in good for b in bad for h in good]
    longer = [f"{g} {h} {k}" for g in good for h in good for k in good]
    model = toxicity.train(longer + mixed, [0] * len(longer) + [1] * len(mixed))
    long_ = "calm water and green hills " * 400
    made = toxicity.scores(model, *flat(pa.array([long_, long_ + "foul awful hateful scum", "", None, "scum"])))
    assert made[0] < 0.5 < made[1]
    assert ((made >= 0) & (made <= 1)).all()
    alone = toxicity.scores(model, *flat(pa.array([long_ + "foul awful hateful scum"])))
    assert alone[0] == pytest.approx(made[1], abs=1e-6)  # a text's score does not depend on its neighbours


def test_words_after_windows_are_counted():
    t = toxicity._tokens(["a " * 24, "a " * 25, "", "a " * 100])
    begin, end, at = t.windows()
    assert np.diff(at).tolist() == [1, 2, 1, 6]
    for k in range(4):
        some = slice(at[k], at[k + 1])
        assert begin[some][-1] + toxicity.WINDOW >= end[some][-1]


def test_rows_without_labels_or_text(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, None, "y"), (2, "", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert [(x[0], x[2]) for x in toxicity.sample(docs, labels)] == [(1, 1)]
    assert toxicity.train(["a"], [1]) is None and toxicity.train([], []) is None
    assert [r.score for r in toxicity.scored(docs, None).collect()] == [0.0] * 4
    assert toxicity.scored(docs.limit(0), None).count() == 0


def test_null_ids_and_ids_with_several_texts(spark, tmp_path):
    """A null id is not held out; of several texts of one id the least is learnt from, whatever the order of the rows."""
    texts = [(k, f"{'foul' if k % 2 else 'fair'} words of text {k}") for k in range(1, 40)]
    rows = [*texts, (None, "no id"), (None, None), (7, "another text of seven"), (7, "a text of seven")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2) for k, _ in texts] + [(None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = toxicity.op1_toxicity(spark, str(tmp_path))
    found = out.collect()
    assert len(found) == len(rows) and not any(r.held_out for r in found if r.doc_id is None)
    assert all(r.held_out is not None and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    again = toxicity.op1_toxicity(spark, str(tmp_path)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.read.parquet(str(tmp_path / "labels.parquet"))
    learnt = {d: t for d, t, _ in toxicity.sample(docs, labels)}
    assert learnt.get(7, "a text of seven") == "a text of seven" and None not in learnt


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_rows_are_told_apart(spark):
    out = toxicity.op1_toxicity(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    print(f"held out: {len(rows)} rows, {len(toxic)} toxic, auc {auc:.3f}, right {np.mean([r.predicted == r.toxic for r in rows]):.3f}")
    assert auc > 0.9 and np.mean([r.predicted == r.toxic for r in rows]) > 0.9
    assert out.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    held = spark.read.parquet(f"{DATA}/documents.parquet").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0)
    taught = {x[0] for x in toxicity.sample(spark.read.parquet(f"{DATA}/documents.parquet"), labels)}
    assert not taught & {r.doc_id for r in held.select("doc_id").collect()}

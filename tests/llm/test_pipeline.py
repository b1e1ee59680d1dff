"""The queries with SQL against DuckDB, and the pipeline, stage by stage, against plain versions."""

import os

import brute
import duckdb
import pytest
from sentencepiece import SentencePieceProcessor

import __spark_entry__ as entry
import corpus_pipeline
from quillmatch.llm import pieces, queries
from quillmatch.llm.common import components, shared_dir

DATA = "/root/testdata/sf0.001"
need_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@need_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found, expected = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLES[name])
    columns = sorted(found.columns)
    shown = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert columns == sorted(expected.columns)
    assert shown(found.select(columns).collect()) == shown(expected.select(*columns).fetchall())


def test_queries_are_registered():
    found = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in found if k.startswith("op") and k[2].isdigit()}
    assert found["pipeline"] is corpus_pipeline.run


@need_data
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, rows = docs.columns, [tuple(r) for r in docs.collect()]
    verdict = {r.doc_id: r.kept for r in queries.QUERIES["op7_quality"](spark, DATA).collect()}
    shown = lambda rows: sorted(map(repr, rows))

    def stage(k, given):
        df = spark.createDataFrame(given, docs.schema)
        out = corpus_pipeline.STAGES[k][1](spark, df, DATA)
        assert k == 4 or out.columns == columns
        return [tuple(r) for r in out.collect()]

    good = stage(0, rows)
    assert shown(good) == shown(r for r in rows if verdict[r[0]])
    plain = stage(1, good)
    kept = brute.lines_kept([r[:2] for r in good])
    at = columns.index("n_chars")
    changed = [(r[0], t := brute.without_lines(r[0], r[1], kept), *r[2:at], len(t), *r[at + 1 :]) for r in good]
    assert shown(plain) == shown(changed)
    single = stage(2, plain)
    classes = brute.near_classes([r[:2] for r in plain])
    assert shown(single) == shown(r for r in plain if classes[r[0]] == r[0])
    mix = stage(3, single)
    where = columns.index("source")
    taken = {d: t // max(1, s) for d, s, _, _, t in brute.mixed([(r[0], r[where], r[1]) for r in single])}
    assert shown(mix) == shown(r for r in single for _ in range(taken[r[0]]))
    coded = stage(4, mix)
    processor = SentencePieceProcessor(model_file=pieces.MODEL)
    assert sorted((r[0], r[3]) for r in coded) == sorted((r[0], processor.encode(r[1])) for r in mix)
    whole = corpus_pipeline.run(spark, DATA)
    assert shown(map(tuple, whole.collect())) == shown(coded)


def test_components(spark):
    import random

    rng = random.Random(4)
    pairs = [(a, b) for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(130)) if a != b] + [(k, k + 1) for k in range(300, 420)]
    found = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).distinct().collect()))
    root = brute.groups(500, pairs)
    assert found == {x: root[x] for p in pairs for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_with_nulls_clashing_columns_and_no_rows(spark, tmp_path):
    """Columns named like those of the operators go along; null ids, texts and sources, repeated rows and empty texts are borne."""
    words = [f"word{k}" for k in range(60)]
    text = lambda k: " ".join(words[(k * 7 + i * (k % 5 + 1)) % 60] for i in range(30 + k % 9)) + f"\nanother line of document number {k}"
    rows = [(k, text(k), "en", f"s{k % 3}", 1, "a", 1.0, True, [1], "r") for k in range(40)]
    rows += [(None, text(90), None, None, None, None, None, None, None, None), (41, None, "en", "s1", 0, "b", 0.0, False, [2], "r"), (42, "", "en", None, 0, "b", 0.0, False, [2], "r"), rows[3], rows[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, score double, kept boolean, ids array<int>, _rest string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "some/documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(0, 40, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "some/labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "some/documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path / "some"))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
    found = corpus_pipeline.run(spark, str(tmp_path / "some"))
    assert found.columns[:3] == ["doc_id", "lang", "source"] and found.where("not parity or not round_trip").count() == 0
    assert {r.doc_id for r in found.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert found.where("doc_id in (41, 42)").count() == 0 < found.count()
    none = spark.read.parquet(str(tmp_path / "some/documents.parquet")).limit(0)
    none.write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    assert all(entry.queries()[q](spark, str(tmp_path / "none")).count() == 0 for q in ("op1_toxicity", "op2_pieces", "op3_nearcopies", "op5_repeats", "op6_mixing", "op7_quality", "op10_lines", "op12_counts", "op13_periods"))


def test_a_cluster_has_to_name_a_shared_folder():
    class Named:
        master = "spark://somewhere:7077"
        sparkContext = property(lambda self: self)
        conf = property(lambda self: self)

        def __init__(self, folder):
            self.folder = folder

        def get(self, name, default):
            return self.folder

        def getCheckpointDir(self):
            return None

    assert shared_dir(Named("file:///shared/scratch/")) == "file:///shared/scratch"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Named(None))

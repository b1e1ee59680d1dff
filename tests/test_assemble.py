import datetime as dt
import random

from quillmatch.operators import assemble, match, parse, sequence
from quillmatch.streaming import read_cache

KIND = "match_id int, {0} int, no int, text string, options array<string>, alt string, alt_options array<string>"


def items(spark, idx, rows):
    return spark.createDataFrame([(m, i, no, text, None, None, None) for m, i, no, text in rows], KIND.format(idx))


def wording(no):
    rng = random.Random(no)
    return " ".join("".join(rng.choices("bcdfghklmnprstvw", k=8)) for _ in range(6))


def test_number_map_by_wording_then_stems_then_in_reverse(spark):
    """Question n of the paper is 11 - n of the other one; what either parse has lost still stands in its text."""
    texts = [(1, "\n".join(f"{n}. {wording(n)}" for n in range(1, 11)))]
    others = [(1, "\n".join(f"{11 - n}. {wording(n)}" for n in range(10, 0, -1)))]
    paper = items(spark, "p_idx", [(1, n - 1, n, wording(n)) for n in range(1, 11) if n not in (4, 5)] + [(1, 20, 2, "short")])
    keys = items(spark, "k_idx", [(1, i, 11 - n, wording(n)) for i, n in enumerate(range(10, 0, -1)) if n != 7])
    kind = "match_id int, text string"
    rows = assemble.number_map(paper, keys, spark.createDataFrame(texts, kind), spark.createDataFrame(others, kind)).orderBy("idx").collect()
    assert [(r.idx, r.no, r.key_no) for r in rows] == [(n - 1, n, 11 - n) for n in range(1, 11)]
    assert {r.no: r.method for r in rows if r.method != "content"} == {4: "rev", 5: "rev", 7: "stem"}
    official = spark.createDataFrame([(1, 0, 3, "A"), (1, 1, 3, "B"), (1, 2, 10, "C")], "match_id int, k_idx int, no int, answer string")
    through = {r.no: r.answer for r in assemble.answers_through(spark.createDataFrame(rows), official).collect()}
    assert (through[8], through[1], through[2]) == ("A", "C", "")


def test_keys_without_wording_match_by_number(spark):
    paper = items(spark, "p_idx", [(m, n - 1, n, wording(n)) for m in (1, 2) for n in (1, 2, 3)])
    keys = items(spark, "k_idx", [(1, 0, 3, wording(1)), (1, 1, 9, "abc"), (2, 0, 3, "few words"), (2, 1, 1, "")])
    found = {(r.match_id, r.p_idx): (r.k_idx, r.method) for r in assemble.chosen(paper, keys).collect()}
    assert found == {(1, 0): (0, "content"), (2, 2): (0, "same-number"), (2, 0): (1, "same-number")}


def test_letters_outside_the_sheet(spark):
    keys = spark.createDataFrame([(1, "E"), (1, "A"), (2, "D"), (3, "E")], "match_id int, answer string")
    letters = spark.createDataFrame([(1, 4), (2, 4), (3, 0)], "match_id int, n int")
    assert [r.match_id for r in assemble.misread(keys, letters).collect()] == [1]


def test_dense_sheet(spark):
    kind = "match_id int, no int, answer string, ord int"
    marks, key = spark.createDataFrame([(1, 2, "A", 0), (1, 9, "B", 1)], kind), spark.createDataFrame([(1, 1, "C", 0), (1, 301, "D", 1)], kind)
    rows = match.dense_sheet(marks, key, spark.createDataFrame([(1, 3), (2, 0)], "match_id int, n int")).orderBy("match_id", "no").collect()
    assert [tuple(r) for r in rows] == [(1, 1, None, "C"), (1, 2, "A", None), (1, 3, None, None), (2, 1, None, None)]
    assert match.dense_sheet(marks, key, spark.createDataFrame([(1, 1000)], "match_id int, n int")).count() == 300


def test_columns_bound_by_height(spark):
    kind = "page_id int, side string, ord int, text string, y0 double, y1 double"
    right = [("r", 0, "Section A", 0, 10), ("r", 1, "1. first", 20, 30), ("r", 2, "goes on", 40, 50), ("r", 3, "2. second", 60, 70)]
    left = [("l", 0, "kopf", 1, 11), ("l", 1, "eins", 21, 31), ("l", 2, "weiter", 41, 51), ("l", 3, "zwei", 61, 71), ("l", 4, "far", 200, 210)]
    rows = [(1, s, o, t, float(a), float(b)) for s, o, t, a, b in right + left]
    rows += [(2, s, o, t.lstrip("12. "), float(a), float(b)) for s, o, t, a, b in right + left]  # no numbers
    rows += [(3, s, o, t, float(a) + (900 if s == "l" else 0), float(b) + (900 if s == "l" else 0)) for s, o, t, a, b in right + left]  # nothing meets
    found = {r.page_id: r.text for r in sequence.bind_columns(spark.createDataFrame(rows, kind)).collect()}
    assert found == {1: "kopf\nSection A\n1. eins weiter\n1. 1. first goes on\n2. zwei\n2. 2. second", 2: None, 3: None}


def test_columns_zipped(spark):
    rows = [(1, "1. one\nmore\n2. two", "eins\n\n2) zwei"), (2, "1. one\n2. two", "eins"), (3, "one", "eins"), (4, None, "1. eins")]
    found = {r.page_id: r.text for r in sequence.zip_texts(spark.createDataFrame(rows, "page_id int, left string, right string")).collect()}
    assert found == {1: "1. eins\n1. one more\n2. zwei\n2. two", 2: "1. one\n2. two\neins", 3: "one\neins", 4: "\n1. eins"}


def test_deadline_keeps_finished_pages(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, 2, at(5), "two"), (1, 1, at(9), "one"), (1, 3, at(11), "three"), (1, 4, None, None)]
    pages = spark.createDataFrame(rows, "doc_id int, page_no int, done_at timestamp, text string")
    from pyspark.sql import functions as F

    assert [tuple(r) for r in sequence.finished_text(pages, F.lit(at(10))).collect()] == [(1, "one\ntwo", 2)]


def test_upper_percentiles_against_sorting(spark):
    rng = random.Random(1)
    rows = [(k, float(rng.randrange(50))) for k in "abc" for _ in range({"a": 1, "b": 10, "c": 3000}[k])] + [("d", None)]
    found = {r.k: r.v for r in sequence.upper_percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", 0.75).collect()}
    expected = {}
    for k in "abc":
        values = sorted(v for x, v in rows if x == k)
        expected[k] = values[min(len(values) - 1, int(len(values) * 0.75))]
    assert found == expected


def test_first_reads_as_a_stream(spark, tmp_path):
    """Each batch is a file; a hit does not prolong a life, and late reads near an entry are hits."""
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [[("a", 0), ("a", 11), ("b", 1)], [("a", 13), ("a", 12.5), ("b", 2), (None, 3)], [("a", 5), ("b", 14), ("c", 40)], [("b", 41)]]
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, at(h)) for k, h in rows], "k string, at timestamp").coalesce(1).write.parquet(str(source / f"d{i}"))
    stream = spark.readStream.schema("k string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    query = read_cache.first_reads(stream, late="30 hours").writeStream.format("memory").queryName("made").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    made = sorted(((r.k or "", r.at) for r in spark.table("made").collect()))
    assert made == [("", at(3)), ("a", at(0)), ("a", at(12.5)), ("b", at(1)), ("b", at(14)), ("b", at(41)), ("c", at(40))]


def test_bound_texts_are_shuffled_once(spark):
    rows = [(1, "r", 0, "1. a", 0.0, 12.0), (1, "r", 1, "2. b", 20.0, 32.0), (1, "l", 0, "x", 0.0, 12.0), (1, "l", 1, "y", 20.0, 32.0), (2, "l", 0, "z", 0.0, 12.0), (None, "r", 0, "1. n", 0.0, 12.0)]
    found = sequence.bind_columns(spark.createDataFrame(rows, "page_id int, side string, ord int, text string, y0 double, y1 double"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract" not in plan and plan.count("Scan ExistingRDD") == 1  # places are a table of their own
    assert {tuple(r) for r in found.collect()} == {(1, "1. x\n1. 1. a\n2. y\n2. 2. b"), (2, None), (None, None)}

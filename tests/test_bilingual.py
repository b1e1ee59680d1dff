import pytest
from pyspark.sql import functions as F

from quillmatch.operators import analyze, bilingual, match, sequence

HINDI = "नीचे दो कथन दिए गए हैं"


def one(spark, row, kinds, column):
    return spark.createDataFrame([row], kinds).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        (f"12. {HINDI} 12. Given below are two", (None, f"12. {HINDI}", "12. Given below are two")),
        (f"{HINDI} 7 ) Given below", (None, HINDI, "7 ) Given below")),
        ("Given below are two statements", ("en", None, None)),
        (HINDI, ("hi", None, None)),
        (f"(A) {HINDI} (B)", ("hi", None, None)),
        ("1 2 3", (None, None, None)),
        ("", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_cut_line(spark, line, expected):
    assert tuple(one(spark, (line,), "v string", bilingual.cut_line(F.col("v")))) == expected


def test_split_scripts(spark):
    glued = [f"{HINDI} given below number {c}" for c in "abcdefgh"]
    whole = "\n".join([HINDI, "12", *glued, "", "english only", "99"])
    rows = [(1, whole), (2, "\n".join(glued[:7])), (3, None)]
    found = {r.doc_id: r.text for r in bilingual.split_scripts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == "\n".join([HINDI, "12", *[HINDI] * 8] + [f"given below number {c}" for c in "abcdefgh"] + ["english only", "99"])
    assert found[2] == rows[1][1] and found[3] is None


def test_options_and_questions_printed_twice(spark):
    fold = lambda body: one(spark, (body,), "v string", bilingual.fold_option(F.col("v"), F.lit("A")))
    assert fold("केंद्र (A) Centre") == "केंद्र Centre"
    assert fold("Centre ( A ) centre.") == "Centre"
    assert fold("Centre (A) ") == "Centre" and fold("Centre (B) x") == "Centre (B) x"
    split = lambda no, text: one(spark, (no, text), "n int, v string", bilingual.own_number_split(F.col("n"), F.col("v")))
    assert tuple(split(5, f"{HINDI} 5. Given below are two")) == ("Given below are two", HINDI)
    assert split(5, f"{HINDI} 15. Given below are two") is None
    assert split(5, "क 5. Given below are two") is None


def test_profiles(spark):
    ink = {k: 1.0 for k in range(40)} | {5: 9.0, 10: 12.0, 11: 12.0, 25: 6.0, 30: 5.0, 38: 1.5}
    rows = spark.createDataFrame([(1, k, v) for k, v in ink.items()], "p int, at int, v double")
    assert sorted(map(tuple, sequence.peaks(rows, "p", "at", "v", 8).collect())) == [(1, 11, 12.0), (1, 25, 6.0)]
    rows = spark.createDataFrame([(1, 0.0), (1, 10.0), (1, 41.0), (2, 5.0)], "p int, at double")
    found = sorted(map(tuple, sequence.fill_lattice(rows, "p", "at", 10.0).collect()))
    assert [(p, round(a, 3), m) for p, a, m in found] == [(1, 0.0, False), (1, 10.0, False), (1, 20.333, True), (1, 30.667, True), (1, 41.0, False), (2, 5.0, False)]
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate("abbac")], "p int, k int, v string")
    assert [tuple(r) for r in sequence.mode(rows, "p", "v", "k").collect()] == [(1, "b", 2)]


def test_readings_and_alphabets(spark):
    weak = lambda *row: one(spark, row, "r string, f int, p int, b double, n int", analyze.weak_read(*map(F.col, "rfpbn")))
    assert weak("q", 5, 1, None, 0) and weak("q", 40, 30, None, 0) and weak("q", 40, 2, 0.2, 0) and not weak("q", 40, 2, None, 0)
    assert weak("key2", 10, 1, None, 100) and not weak("key2", 80, 90, 0.9, 100)
    adopt = lambda *row: one(spark, row, "f int, h int, b double", analyze.adopt_read(*map(F.col, "fhb")))
    assert adopt(5, 4, None) and adopt(9, 10, 0.1) and not adopt(9, 10, 0.01) and not adopt(3, 3, 0.5)
    letters = lambda c, m, o, n=None: "".join(one(spark, (c, m, o), "c string, m string, o array<string>", analyze.alphabet(F.col("c"), F.col("m"), F.col("o"), n)))
    assert letters("2", "", None) == "12345" and letters("B", "3", None) == "ABCDE" and letters("B", "3", None, 6) == "12345"
    assert letters("B", "", ["(1) x (2) y (3) z"]) == "ABC" and letters("B", "", ["(1) x"]) == "AB" and letters("B", "", ["(1) A. x"]) == "ABCDE"
    assert letters("B", "", None, 6) == "ABCDEF"


def test_recovered_numbers(spark):
    paper = spark.createDataFrame([(1, 1)], "match_id long, no int")
    assigned = spark.createDataFrame([(1, 0)], "match_id long, k_idx int")
    found = spark.createDataFrame([(1, 0, 9), (1, 2, 1), (1, 4, 7), (1, 3, 7)], "match_id long, k_idx int, no int")
    assert [tuple(r) for r in match.recovered(paper, assigned, found).collect()] == [(1, 7, 3, 0.5, "rev")]

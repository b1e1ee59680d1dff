import pytest
from pyspark.sql import functions as F

from quillmatch.functions import text as X
from quillmatch.functions.numbers import round_up_half, upper_percentile


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "expected"),
    [("Born in 1945. pi is 3.14", "born in 1 pi is 14"), ("किताब का सूची कल", "क त ब क स च कल"), (None, ""), ("A B", "a b")],
)
def test_normalize(spark, text, expected):
    assert one(spark, text, X.normalize) == expected


def test_tokens(spark):
    assert one(spark, "Which planet is known as the Red Planet?", X.tokens) == ["planet", "known", "red", "planet"]
    assert one(spark, "किताब का सूची कल", X.tokens) == ["कल"]
    assert one(spark, "the constructor of", X.tokens) == []


def test_bigrams(spark):
    assert sorted(one(spark, "a ba b", X.bigrams)) == ["ab", "ba"]
    assert one(spark, "a", X.bigrams) == []


def test_scripts(spark):
    assert one(spark, "अब ab", X.script) == "en"
    assert one(spark, "अबक ab", X.script) == "hi"
    assert one(spark, "", X.latin_share) == 0
    assert one(spark, "सूची " * 25, X.hindi_badness) == 0
    assert one(spark, "ूसच " * 25, X.hindi_badness) == 1
    assert one(spark, "abc", X.hindi_badness) is None
    assert one(spark, "ब् लॉक हु ए", X.join_devanagari) == "ब्लॉक हुए"


def test_lines(spark):
    assert one(spark, "“a”\r\n\n  b\t c ٣", X.tidy_lines) == '"a"\n\nb c 3'
    assert one(spark, "(1) Earth (2) Mars", X.options_line)
    assert one(spark, "1) Which planet is known", X.options_line)
    assert not one(spark, "1. Which planet is known", X.options_line)
    assert one(spark, "| 1 | C |\n|---|:--|\nx", X.untable) == "1 - C\n\nx"
    assert one(spark, "x" * 95, X.preview) == "x" * 90 + "…"


def test_marks(spark):
    assert one(spark, "(b) ✓", X.marked_answer) == "B"
    assert one(spark, "( 3 ) ●", X.marked_answer) == "3"
    assert one(spark, "none", X.marked_answer) == ""


def test_stems(spark):
    assert one(spark, "capital city of great australia nation", X.stems) == ["capital city great", "city great australia", "great australia nation"]
    assert one(spark, "a b", X.stems) == []


def test_numbers(spark):
    assert one(spark, -12.5, round_up_half, "double") == -12
    assert one(spark, 3, X.letter_of, "int") == "C"
    rows = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int")
    assert rows.agg(upper_percentile(F.col("v"), 0.5).alias("r")).first().r == 3

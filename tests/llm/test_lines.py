import random

import brute
import pytest

from quillmatch.llm import lines

SCHEMA = "doc_id long, text string, n_chars long, kept string, _lines string, n_near int, pos int"


def fixture():
    rng = random.Random(5)
    letter = lambda: rng.choice("abcdefgh éß漢")
    base = ["".join(letter() for _ in range(rng.choice([3, 19, 20, 21, 22, 30, 60]))) for _ in range(25)] + ["x" * 25, "ab" * 15]

    def changed(line):
        out = list(line)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(out) + 1)
            out[at : at + rng.randint(0, 1)] = [letter()] * rng.randint(0, 1)
        return "".join(out)

    rows = [(i, "\n".join(changed(rng.choice(base)) if rng.random() < 0.8 else rng.choice(["", "  ", "short", base[0]]) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    return [*rows, (60, None), (61, ""), (62, "\n\n \n"), (63, "\n".join(changed(rng.choice(base)) for _ in range(200))), (64, "long " * 5000), (65, "long " * 5000 + "x")]


@pytest.mark.parametrize("block", [lines.BLOCK, 3])
def test_lines_that_stay(spark, block):
    """Also with buckets that are cut into blocks of three lines."""
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute.lines_kept(rows)
    found = {r.doc_id: r for r in lines.with_kept(docs, block=block).collect()}
    for doc, (keep, _, near) in expected.items():
        got = found[doc]
        assert [k.pos for k in got.kept or []] == keep
        assert (got.n_near or 0) == near
    assert sum(n for _, _, n in expected.values()) > 20


def test_texts_without_them_and_columns_of_any_name(spark):
    rows = fixture()
    kept = brute.lines_kept(rows)
    full = [(d, t, len(t or ""), f"k{d}", "l", d, -d) for d, t in rows] + [(None, "a null id\nb", 11, None, None, None, None)]
    out = lines.dedup_lines(spark.createDataFrame(full, SCHEMA))
    assert out.columns == ["doc_id", "text", "n_chars", "kept", "_lines", "n_near", "pos"]
    found = {r.doc_id: tuple(r) for r in out.collect()}
    for row in full[:-1]:
        text = brute.without_lines(row[0], row[1], kept)
        assert found[row[0]] == (row[0], text, None if text is None else len(text), *row[3:])
    assert found[None] == full[-1]


def test_null_ids_are_one_document_before_all_others(spark):
    line = "a line of more than twenty letters"
    rows = [(None, f"{line}\nown"), (None, f"{line}!\nother"), (1, f"{line}?\nown\nlast"), (2, "last")]
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # neither of the two lines at place 0 of the null document is earlier
    assert sorted((r.doc_id or 0, r.text) for r in found) == sorted([(0, f"{line}!\nother"), (0, f"{line}\nown"), (1, "last"), (2, "")])


def test_many_rows_without_an_id(spark, tmp_path):
    """Each gets its own lines back, not those of all."""
    line = "a line of more than twenty letters, and of these number {:05d}"
    other = [f"{c * 30} one of its own" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(None, f"{other[i % 26]}\nshared by them all\n{line.format(i)}") for i in range(500)] + [(3, f"shared by them all\n{line.format(7)}\nmine"), (None, None), (None, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _row string")
    found = sorted((r.doc_id or 0, r.text or "") for r in lines.dedup_lines(docs).collect())
    # lines at one place of the document without a name are not earlier than one another
    assert found == sorted([(0, r[1] or "") for r in rows if r[0] is None] + [(3, "mine")])
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    counts = lines.op10_lines(spark, str(tmp_path)).collect()
    assert sorted({len(r.kept_lines) for r in counts if r.doc_id is None}) == [0, 3] and {(r.n_lines, r.n_removed) for r in counts if r.doc_id == 3} == {(3, 2)}


def test_a_hot_group_of_near_copies_settles_without_pairs(spark):
    """Every line of one large group finds its witness in the first: nothing is left to the search in blocks."""
    rng = random.Random(3)
    base = "the one line that a great many documents hold with another letter"
    rows = [(0, base)] + [(i, base[:k] + rng.choice("abcxyz") + base[k + 1 :]) for i in range(1, 800) for k in [rng.randrange(len(base))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines.near_lines(docs).count() == len({t for _, t in rows}) - 1
    tasks = lines.bucket_members(docs, 2, 20)
    assert tasks.count() <= 12 * len(rows)


def test_query_counts(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in lines.op10_lines(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    for doc, (keep, equal, near) in brute.lines_kept(rows).items():
        got = found[doc]
        assert (got.kept_lines, got.n_equal, got.n_near, got.n_lines) == (keep, equal, near, len(keep) + equal + near)


def test_one_very_common_line(spark):
    rows = [(i, f"the very common line of all documents\nits own line number {i:06d} {i * 7919:08d}") for i in range(300)]
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = brute.lines_kept(rows)
    assert {r.doc_id: r.text for r in found} == {d: brute.without_lines(d, t, kept) for d, t in rows}


def test_repeated_rows_are_one_document(spark):
    docs = spark.createDataFrame([(7, "a line of more than twenty letters\nb")] * 3, "doc_id long, text string")
    assert {r.text for r in lines.dedup_lines(docs).collect()} == {"a line of more than twenty letters\nb"}
    assert lines.dedup_lines(docs).count() == 3
    assert lines.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(edits):
    rng = random.Random(edits)
    for _ in range(3000):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [rng.choice("abc")] * rng.randint(0, 1)
        assert lines.within("".join(a), "".join(b), edits) == (brute.levenshtein(a, b) <= edits)

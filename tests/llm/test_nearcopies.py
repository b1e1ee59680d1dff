import random

import brute
import pytest

from quillmatch.llm import nearcopies


def fixture(n=160, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(300)] + ["é", "漢字"]
    base = [rng.choices(vocabulary, k=rng.choice([3, 5, 12, 40, 80, 200])) for _ in range(20)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 2)] = rng.choices(vocabulary, k=rng.randint(0, 2))
            words = words or ["w"]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a b"), (n + 4, "a  b\n"), (n + 5, "b a")]
    big = rng.choices(vocabulary, k=4000)
    return [*rows, (n + 6, " ".join(big)), (n + 7, " ".join(big[:3700])), (n + 8, " ".join(big[2000:] + big[:2000]))]


@pytest.mark.parametrize("block", [2000, 6])
def test_classes_are_the_components_of_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.class_id for r in nearcopies.classes(docs).collect()}
    expected = brute.near_classes(rows)
    assert found == expected
    assert len(set(expected.values())) < 120


def test_stage_keeps_one_of_each_and_the_columns(spark):
    rows = [(d, t, f"k{d}", d, -d) for d, t in fixture()] + [(None, fixture()[0][1], "null", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string, rep long, root long")
    out = nearcopies.one_of_each(spark, docs, "")
    stays = set(brute.near_classes([r[:2] for r in rows[:-1]]).values()) | {None}
    assert out.columns == docs.columns
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(r) for r in rows if r[0] in stays)


def test_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(5, "one two three four five six")] * 2 + [(3, "one two three four five six")], "doc_id long, text string")
    assert sorted(map(tuple, nearcopies.classes(docs).collect())) == [(3, 3), (5, 3)]
    assert nearcopies.classes(docs.limit(0)).count() == 0


def test_of_several_texts_of_an_id_one_counts_at_each_place(spark):
    base = [f"w{k}" for k in range(60)]
    texts = {name: " ".join(base[:at] + [name] + base[at:]) for name, at in (("x", 30), ("y", 31))} | {"far": " ".join(f"z{k}" for k in range(60))}
    near = spark.createDataFrame([(9, " ".join(base), 1)], "doc_id long, text string, t int")
    for order in (["x", "far"], ["far", "x"]):
        docs = near.unionByName(spark.createDataFrame([(4, texts[k], 1) for k in order] + [(7, texts["y"], 1)], "doc_id long, text string, t int"))
        taken = min(("x", "far"), key=lambda k: spark.createDataFrame([(texts[k],)], "text string").selectExpr("xxhash64(text)").first()[0])
        found = {r.doc_id: r.class_id for r in nearcopies.classes(docs.repartition(3)).collect()}
        assert found == ({4: 4, 7: 4, 9: 4} if taken == "x" else {4: 4, 7: 7, 9: 7})


def test_common_length():
    rng = random.Random(2)
    for _ in range(2000):
        a = [rng.randrange(5) for _ in range(rng.randint(0, 14))]
        b = [x for x in a if rng.random() < 0.8] + [rng.randrange(5) for _ in range(rng.randint(0, 3))]
        exact = brute.common(a, b)
        for least in (0, exact, exact + 1, max(len(a), len(b))):
            got = nearcopies.common_length(a, b, least)
            assert got == exact if exact >= least else got < least

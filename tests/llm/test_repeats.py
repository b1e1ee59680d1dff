import hashlib
import random

import brute
import numpy as np
import pytest

from quillmatch.llm import repeats


def fixture():
    rng = random.Random(6)
    some = lambda n, letters="abcdefg hij\n": "".join(rng.choice(letters) for _ in range(n))
    passages = [some(n) for n in (399, 400, 401, 700, 1500)] + [some(200, "éß漢 ab"), some(500, "éß漢 ab")]
    rows = ["".join(rng.choice([some(rng.randint(1, 300)), rng.choice(passages)]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rows += [None, "", "short", some(3000), passages[4], passages[4], passages[4][1:] + "z", "ab" * 600, "q" * 399, "q" * 400, "r" * 401, some(40) * 30, "x" + passages[3] + passages[3]]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("shard", [400_000, 3_000])
def test_every_repeated_byte_goes(spark, shard):
    rows = fixture()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, ranges string, t int").repartition(6)
    found = {r.doc_id: tuple(r)[1:] for r in repeats.without_repeats(docs, shard).collect()}
    expected = dict(zip([d for d, _ in rows], brute.without_repeats([t for _, t in rows]), strict=True))
    assert found == expected
    assert sum(x[1] > 0 for x in expected.values()) > 30


def test_rows_of_one_id_and_no_rows(spark):
    texts = [fixture()[63][1], fixture()[63][1], "other", None]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[2]), (None, texts[3])], "doc_id long, text string")
    assert sorted(tuple(r)[1:] for r in repeats.without_repeats(docs).collect()) == sorted(brute.without_repeats(texts))
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for n, letters, first in ((1, 2, 97), (50, 2, 97), (300, 2, 97), (300, 20, 97), (400, 1, 97), (400, 1, 0), (300, 2, 0), (0, 1, 97)):
        data = rng.integers(first, first + letters, n).astype(np.uint8)
        raw = data.tobytes()
        order = repeats.suffix_array(data)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        out = repeats.common_prefixes(data, order, 60)
        for a, b in zip(order, order[1:], strict=False):
            same = 0
            while max(a, b) + same < n and raw[a + same] == raw[b + same] and same < 60:
                same += 1
            assert out[b] == same


def test_common_prefixes_where_much_longer_ones_repeat():
    """Passages that agree for many times the length that is asked for, and then differ."""
    rng = np.random.default_rng(1)
    for _ in range(40):
        base = rng.integers(97, 99, 400).astype(np.uint8)
        parts = []
        for _ in range(12):
            at = rng.integers(0, 200)
            parts += [base[at : at + rng.integers(1, 200)], rng.integers(97, 99, rng.integers(0, 3)).astype(np.uint8)]
        raw = np.concatenate(parts).tobytes()
        data = np.frombuffer(raw, np.uint8)
        order = repeats.suffix_array(data)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        out = repeats.common_prefixes(data, order, 20)
        for a, b in zip(order, order[1:], strict=False):
            assert (out[b] == 20) == (raw[a : a + 20] == raw[b : b + 20] and max(a, b) + 20 <= len(raw))


def test_runs_that_agree_far_beyond_the_length(spark):
    """Texts of one passage of 3,000 bytes, cut and changed in many places: nothing but what repeats may go."""
    rng = random.Random(9)
    base = "".join(rng.choice("abc de") for _ in range(3000))
    rows = []
    for i in range(60):
        a, b = sorted(rng.sample(range(3000), 2))
        at = rng.randrange(a, b)
        rows.append((i, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 3))) + base[a:at] + rng.choice(["", "z", "zz"]) + base[at:b]))
    found = {r.doc_id: tuple(r)[1:] for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert found == dict(enumerate(brute.without_repeats([t for _, t in rows])))


def test_kept_bytes_and_spans(spark):
    """The operator gives the texts themselves: what is left, and maximal runs of what is not."""
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    texts, cut = dict(rows), repeats.cut_repeats(docs).collect()
    expected = dict(zip([d for d, _ in rows], brute.without_repeats([t for _, t in rows]), strict=True))
    assert sorted(r.doc_id for r in cut) == sorted(texts)
    for r in cut:
        data, spans = (texts[r.doc_id] or "").encode(), [(x["from"], x["to"]) for x in r.spans]
        ends = [0, *(x for span in spans for x in span), len(data)]
        assert all(a < b for a, b in zip(ends[1:-2], ends[2:-1], strict=True))
        assert b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)) == r.kept
        assert (len(data), len(data) - len(r.kept), len(spans), hashlib.sha256(r.kept).hexdigest()) == expected[r.doc_id]


def test_passages_of_over_fifty_words(spark):
    """A shared passage goes if it has 400 bytes, however many words; n_bytes is the input's length in either case."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    some = lambda n: " ".join(word(rng.randint(3, 9)) for _ in range(n))
    shared = {"long": " ".join(word(7) for _ in range(60)), "short": " ".join(word(5) for _ in range(60)), "none": ""}
    assert len(shared["short"]) < 400 < len(shared["long"])
    rows = [(f"{kind}{i}", f"{some(80)}A {shared[kind]} Z{some(80)}") for kind in shared for i in range(20)]
    # a letter of its own on either side, so that no two passages share more than is meant
    rows = [(d, t.replace("A ", f"{i}A ").replace(" Z", f" Z{i}")) for i, (d, t) in enumerate(rows)]
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id for r in found if r.n_removed} == {d for d, _ in rows if d.startswith("long")}
    assert {r.doc_id: r.n_bytes for r in found} == {d: len(t) for d, t in rows}

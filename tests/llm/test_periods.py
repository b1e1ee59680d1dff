import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmatch.llm import periods

SCHEMA = "doc_id long, text string, start string, period string, n_runs int"


def plain_runs(words):
    """Every period of every maximal stretch, tried; of equal stretches the smallest period counts."""
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *longest, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def found(documents):
    words = [w for d in documents for w in d]
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    rows = periods.runs(np.array([known[w] for w in words], np.int64), np.cumsum([0] + [len(d) for d in documents]))
    out = [[] for _ in documents]
    for doc, *run in zip(*(x.tolist() for x in rows)):
        out[doc].append(tuple(run))
    return out


letters = st.lists(st.sampled_from("ab"), max_size=70) | st.lists(st.sampled_from("abc"), max_size=50)
repeats = st.builds(lambda u, k, v: u * k + v, st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 12), letters)


@settings(max_examples=500, deadline=None)
@given(st.lists(letters | repeats | st.builds(lambda a, b: a + b, repeats, repeats), max_size=6))
def test_all_runs(documents):
    assert found(documents) == [plain_runs(d) for d in documents]


def test_short_documents_beside_longer_ones():
    """A document that is done at a level finds no squares there, though others go on."""
    documents = [list("bababab"), list("aaaaaaaa"), list("abcabcabcab"), list("xyz" * 4), list("ab" * 4)]
    assert found(documents) == [plain_runs(d) for d in documents] == [[], [(0, 8, 1)], [], [(0, 12, 3)], [(0, 8, 2)]]


def test_structured_words():
    fib, thue = ["a"], ["a"]
    other = ["a", "b"]
    for _ in range(10):
        fib, other = other, other + fib
        thue = thue + ["b" if x == "a" else "a" for x in thue]
    rng = random.Random(5)
    nested = (["a"] * 9 + ["b"]) * 7 + ["c"]
    documents = [fib, thue, nested * 5, ["x"] * 300, [], ["y"], [rng.choice("abcdefgh") for _ in range(40)] * 6, (["p", "q"] * 6 + ["r"]) * 8]
    assert found(documents) == [plain_runs(d) for d in documents]


def test_classes_are_those_of_equal_factors():
    """At each level, live places share a class just where their factors are equal, in order; the stretch of each class holds its places."""
    rng = random.Random(9)
    documents = [[rng.choice("ab") for _ in range(60)], list("abcab" * 9), list("aab" * 20)]
    flat = [ord(w) - 97 for d in documents for w in d]
    state = periods.Refinement(np.array(flat), np.cumsum([0] + [len(d) for d in documents]))
    line = [x for d in documents for x in [*d, None]]
    while True:
        groups = {}
        doc = np.cumsum([0] + [x is None for x in line])[:-1]
        for i in range(len(line)):
            factor = line[i : i + state.level]
            if len(factor) == state.level and None not in factor and state.limit[i] >= state.level:
                groups.setdefault((doc[i], *factor), []).append(i)
        for places in groups.values():
            names = {int(state.name[i]) for i in places}
            assert len(names) == 1 and (names == {-1}) == (len(places) < periods.MEMBERS)
            if names != {-1}:
                k = names.pop()
                assert sorted(state.order[state.start[k] : state.start[k] + state.size[k]].tolist()) == places
                assert [int(state.next[i]) for i in places] == [*places[1:], state.end]
        if not state.refine():
            break


def test_rows(spark):
    rng = random.Random(3)
    ids = list(range(60))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids) >= 3
    texts = [" ".join(rng.choice(["so", "it", "Goes", "é", "x y"]) for _ in range(rng.choice([0, 1, 7, 90, 260]))) for _ in ids]
    texts[:4] = [None, "", " \n\t", "a b " * 9 + "tail"]
    rows = [(i, x, "s", "p", 1) for i, x in zip(ids, texts)] + [(None, "la " * 8, "s", "p", 1), (7, texts[7], "s", "p", 1)]
    result = periods.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted(map(str, [(r[0], *plain(r[0], r[1])) for r in rows]))
    assert sorted(str(tuple(r)) for r in result) == want
    assert periods.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("unit", [["a"], [str(i) for i in range(3000)]])
def test_time_is_near_linear(unit):
    """A long repetition takes a level for each word of its period, not a pass over all words."""

    def taken(times):
        words = np.array([hash(w) % 10_000 for w in unit] * times)
        began = time.perf_counter()
        periods.runs(words, np.array([0, len(words)]))
        return time.perf_counter() - began

    base = 24_000 // len(unit)
    taken(base)
    assert taken(4 * base) < 12 * taken(base) + 1

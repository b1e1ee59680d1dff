"""Near-copy classes by Order MinHash, verified by a banded alignment.

A text is its sequence of five-word shingles. Each of SKETCHES hash functions takes the PICKED least occurrence-labelled
shingles and keeps their text order; equal picks in equal order make two texts candidates. A pair is linked when its
aligned similarity, common / (all - common) with `common` the longest common subsequence of the two shingle sequences,
is SIMILARITY or more. Classes are the connected components of the links; equal word sequences are one text from the start.

The members of a bucket travel with their texts, which are no longer than their shingles' hashes. A bucket beyond BLOCK texts is cut into blocks, and each pair of blocks
is a task of its own, so that no task holds an unbounded group. Inside a task a pair of texts that is connected already
is not aligned again; only links that join two classes leave the task, fewer than it has texts.

Defined results: null, empty or wordless texts are each a class of their own; texts of under five words have one shingle,
the whole text; rows that repeat a doc_id are one document, and of several texts of one id that with the least hash counts; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import BASE, flat, mix64, pieces, word_hashes, words
from .common import components, small_or_shuffled, table, written

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at similarity 0.8 agrees in a sketch with chance 0.64, and in none of 10 with chance 0.00004.
SKETCHES = 10
PICKED = 2
BLOCK = 2_000


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, the index of each text's first one (one more at the end), and the texts' numbers of words."""
    starts, ends, first = words(data, offsets)
    hashes, n = word_hashes(data, starts, ends), np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(first[:-1], count) + np.arange(at[-1]) - np.repeat(at[:-1], count)
    stop = np.repeat(first[1:], count)
    out = np.zeros(len(begin), np.uint64)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            out = mix64(out * BASE + np.where(begin + k < stop, padded[begin + k], np.uint64(0)) + np.uint64(k + 1))
    return out, at, n


def labelled(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each shingle hash together with how often the same one stands before it in its text."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, text))
    same = np.zeros(len(order), bool)
    same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    run = np.arange(len(order))
    begin = np.maximum.accumulate(np.where(same, 0, run))
    seen = np.zeros(len(order), np.uint64)
    seen[order] = (run - begin).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix64(hashes + seen * BASE)


def sketches(hashes: np.ndarray, at: np.ndarray, count: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """(count, texts): for each hash function the hash of a text's least labelled shingles in text order. Texts need a shingle each."""
    items, size, begin = labelled(hashes, at), np.diff(at), at[:-1]
    out = np.zeros((count, len(size)), np.uint64)
    last = np.uint64(0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        for k in range(count):
            value = mix64(items ^ (np.uint64(k + 1) * BASE))
            where = np.full((picked, len(size)), np.int64(at[-1]))
            for j in range(min(picked, int(size.max(initial=0)))):
                least = np.minimum.reduceat(value, begin)
                hit = np.flatnonzero(value == np.repeat(least, size))
                text = np.searchsorted(at, hit, "right") - 1
                one, index = np.unique(text, return_index=True)
                some = size[one] > j
                where[j, one[some]] = hit[index[some]]
                value[hit[index]] = last
            where.sort(0)
            longer = np.append(items, np.uint64(0))
            for j in range(picked):
                out[k] = mix64(out[k] * BASE + longer[where[j]] + np.uint64(k + 1))
    return out


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            hashes, at, n = shingles(*flat(batch.column("text")))
            some = np.flatnonzero(n)
            if not len(some):
                continue
            begin = at[:-1][some]
            keys = sketches(hashes, np.append(begin, at[-1]))
            with np.errstate(over="ignore"):
                place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(begin, np.diff(np.append(begin, at[-1]))).astype(np.uint64)
                whole_text = [np.add.reduceat(mix64(hashes ^ mix64(place * BASE + np.uint64(s))), begin) + n[some].astype(np.uint64) for s in (1, 2)]
            columns = [batch.column("doc_id").take(pa.array(some)), batch.column("t").take(pa.array(some)), *[pa.array(x.view(np.int64)) for x in whole_text]]
            flat_keys = pa.array(np.ascontiguousarray(keys.T).reshape(-1).view(np.int64))
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * len(keys)), flat_keys))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "s1", "s2", "keys"])


def common_length(a: list[int], b: list[int], least: int) -> int:
    """Length of the longest common subsequence, or less than `least` when it can't be reached.

    Bit i of `row` is 0 where the length grows at a[i]. A row looks at the band of diagonals that `least` leaves open.
    """
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    a, b = a[same:], b[same:]
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    same += tail
    if same + min(len(a), len(b)) < least or not a or not b:
        return same
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    skip_a, skip_b = len(a) - (least - same), len(b) - (least - same)  # so many of each may go unmatched
    full = (1 << len(a)) - 1
    width = (1 << (skip_a + skip_b + 1)) - 1
    row = full
    for j, x in enumerate(b):
        match = where.get(x, 0)
        if match:
            match &= width << (j - skip_b) if j >= skip_b else width >> (skip_b - j)
            met = row & match
            row = ((row + met) | (row - met)) & full
    return same + len(a) - row.bit_count()


def least_common(a, b, similarity: float):
    """How many shingles two sequences of these lengths must have in common."""
    return np.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)


def shared(texts: list[np.ndarray], columns: int = 1024) -> np.ndarray:
    """How many occurrence-labelled shingles each two texts share, which no alignment exceeds."""
    n = len(texts)
    text = np.repeat(np.arange(n), [len(t) for t in texts])
    every, index, count = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    common = count > 1
    column = np.cumsum(common) - 1
    some = common[index]
    text, index = text[some], column[index[some]]
    order = np.argsort(index, kind="stable")
    text, index = text[order], index[order]
    out = np.zeros((n, n), np.float32)
    for low in range(0, int(common.sum()), columns):
        part = slice(np.searchsorted(index, low), np.searchsorted(index, low + columns))
        block = np.zeros((n, columns), np.float32)
        block[text[part], index[part] - low] = 1
        out += block @ block.T
    return out


def _links_of(ids: list[int], sides: list[int], texts: list[np.ndarray], similarity: float, apart: bool) -> list[tuple[int, int]]:
    """Links that connect the texts of a task; with `apart`, pairs within one side are another task's."""
    if len(ids) < 2:
        return []
    size = np.array([len(t) for t in texts])
    ends = np.concatenate([[0], np.cumsum(size)])
    items = labelled(np.concatenate(texts), ends)
    maybe = shared([items[ends[i] : ends[i + 1]] for i in range(len(ids))]) >= least_common(size[:, None], size[None, :], similarity)
    if apart:
        side = np.array(sides)
        maybe &= side[:, None] != side[None, :]
    group = np.arange(len(ids))
    out = []
    for i in np.argsort(-maybe.sum(1), kind="stable"):
        for j in np.flatnonzero(maybe[i]):
            if group[i] != group[j]:
                least = int(least_common(size[i], size[j], similarity))
                if common_length(texts[i].tolist(), texts[j].tolist(), least) >= least:
                    group[group == group[j]] = group[i]
                    out.append((ids[i], ids[j]))
    return out


def _verify(similarity: float):
    names = ["bucket", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by their task; a task may go on in the next batch."""
        held: tuple | None = None
        ids: list[int] = []
        sides: list[int] = []
        texts: list[np.ndarray] = []

        def close() -> pa.RecordBatch | None:
            found = _links_of(ids, sides, texts, similarity, held is not None and held[1] != held[2])
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())}) if found else None

        for whole in batches:
            for batch in pieces(whole, "text"):
                hashes, at, _ = shingles(*flat(batch.column("text")))
                tasks = zip(*[batch.column(c).to_pylist() for c in names], strict=True)
                for k, (task, doc, side) in enumerate(zip(tasks, batch.column("doc_id").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                    if task != held:
                        if (made := close()) is not None:
                            yield made
                        held, ids, sides, texts = task, [], [], []
                    ids.append(doc)
                    sides.append(side)
                    texts.append(hashes[at[k] : at[k + 1]])
        if (made := close()) is not None:
            yield made

    return run


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs(doc_id, text) to (doc_id, class_id): one row per doc_id, class_id the least doc_id of its class."""
    named = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").where("doc_id is not null")
    rows = named.mapInArrow(_sketch_rows, "doc_id long, t long, s1 long, s2 long, keys array<long>")
    # of several texts of an id one is taken, by its hash, here and where texts are read again
    rows = written(rows.groupBy("doc_id").agg(F.min(F.struct("t", "s1", "s2", "keys")).alias("r")).select("doc_id", "r.*"), "sketches")
    same = written(rows.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "texts")
    reps = rows.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    keys = reps.select("doc_id", F.explode("keys").alias("bucket"))
    buckets = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("members")).where("n > 1")
    buckets = buckets.groupBy("n", "members").agg(F.min("bucket").alias("bucket"))  # sketches often make the same bucket again
    member = keys.join(buckets.select("bucket", "n"), "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    member = member.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    member = member.select("bucket", "doc_id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    member = written(member.select("bucket", "doc_id", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")), "members")
    ids = written(reps.join(member.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "t"), "ids")
    texts = named.join(small_or_shuffled(ids), ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id"])
    full = member.join(texts, "doc_id")
    links = full.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").mapInArrow(_verify(similarity), "a long, b long")
    rooted = components(links).withColumnRenamed("id", "rep")
    of_text = same.join(rooted, "rep", "left").select("s1", "s2", F.coalesce("root", "rep").alias("class_id"))
    found = rows.join(of_text, ["s1", "s2"]).select("doc_id", "class_id")
    return docs.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def op3_nearcopies(spark, sf_dir: str) -> DataFrame:
    """Every document with its class; the one that stays has the least doc_id."""
    found = classes(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.expr("doc_id <=> class_id"))


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays; a null doc_id is a class of its own."""
    out = classes(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(out, "doc_id", "left_anti")

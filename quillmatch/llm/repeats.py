"""Removal of repeated passages by suffix arrays over shards of text that can hold them.

Every byte that lies in a LENGTH-byte string which also starts elsewhere goes. A text's strings are grouped into runs: a
run is a stretch of starts whose strings have the same least GRAM-gram hash, so equal strings are always in runs of one key.
Runs equal as a whole need no search. Of the others, those whose key occurs again (or that may repeat within themselves)
are sorted into shards by key. A shard's suffix array is built by Larsson-Sadakane refinement, its common prefixes by
Kasai's bound, both in NumPy. A key too large for one shard is cut into several, and pairs of these are merged by binary
search of the one's strings among the other's sorted ones. So no task holds more than two shards, and what is shuffled is
a few numbers for each run, the text of the unresolved runs, and each text once.

Defined results: null is the empty text; texts under LENGTH bytes keep all; repeated rows count as places of their own; rows
that share doc_id and text share their result; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import flat, mix64, pieces
from .common import table, written

LENGTH = 400
GRAM = 100
#: Bytes of a shard: what one suffix array is built over.
SHARD = 400_000
_STEPS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class _Hash:
    """Hashes of any substrings of some bytes."""

    def __init__(self, data: np.ndarray, step: int):
        with np.errstate(over="ignore"):
            ahead, back = np.full(len(data) + 1, step, np.uint64), np.full(len(data) + 1, pow(step, -1, 1 << 64), np.uint64)
            ahead[0] = back[0] = 1
            self.back = np.multiply.accumulate(back)
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(ahead)[:-1], out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[stop] - self.sums[start]) * self.back[start])


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or greatest of each `width` values, by prefixes and suffixes of blocks."""
    n, pick = len(values), np.minimum if least else np.maximum
    fill = np.uint64(0xFFFFFFFFFFFFFFFF if least else 0)
    block = np.concatenate([values, np.full(-n % width + width, fill, np.uint64)]).reshape(-1, width)
    ahead = pick.accumulate(block, axis=1).reshape(-1)
    back = pick.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, key, content, alone) of each run; starts count from the text's own start.

    `alone` is false where the least gram occurs more than once, so that strings of the run may equal each other.
    """
    empty = np.zeros(0, np.int64)
    n, width = len(data), length - gram + 1
    if n < length:
        return empty, empty, empty, empty, empty, empty.astype(bool)
    grams = _Hash(data, _STEPS[0]).of(np.arange(n - gram + 1), np.arange(gram, n + 1))
    low = sliding(grams, width, True)
    text = np.searchsorted(offsets, np.arange(n - length + 1), "right") - 1
    fits = np.arange(n - length + 1) + length <= offsets[1:][text]
    begins = fits.copy()
    begins[1:] &= ~fits[:-1] | (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    ends = fits.copy()
    ends[:-1] &= ~fits[1:] | begins[1:]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    key = low[a]
    # where a gram is the least of some string, the greatest such least among the strings that hold it is its own hash
    held = sliding(np.concatenate([np.zeros(width - 1, np.uint64), np.where(fits, low, np.uint64(0)), np.zeros(width - 1, np.uint64)]), width, False)
    hits = np.flatnonzero(held == grams)
    first, last = np.searchsorted(hits, a), np.searchsorted(hits, b + width)
    count = last - first
    which = np.repeat(np.arange(len(a)), count)
    hit = hits[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
    alone = np.bincount(which, grams[hit] == key[which], len(a)) < 2
    content = _Hash(data, _STEPS[1]).of(a, b + length) ^ mix64((b - a).astype(np.uint64))
    t = text[a]
    return t, a - offsets[t], b - offsets[t], key.view(np.int64), content.view(np.int64), alone


def _emit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "t", "a", "b", "key", "content", "alone"]
    for whole in batches:
        for batch in pieces(whole, "text", 1_000_000):
            text, a, b, key, content, alone = runs(*flat(batch.column("text")))
            if len(text):
                at = pa.array(text)
                columns = [batch.column("doc_id").take(at), batch.column("t").take(at), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(key), pa.array(content), pa.array(alone)], names)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes in order, to their ends: the bound on common prefixes does not hold where ties are left.

    Each round orders only the groups that are still tied, by the rank of what stands `h` bytes further on, and doubles h.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    head = np.zeros(n, np.uint64)
    for k in range(8):
        head = head << np.uint64(8) | padded[k : k + n]
    left = np.minimum(np.arange(n, 0, -1), 8)  # a text may hold the byte that fills up the last heads; what ends first comes first
    order = np.lexsort((left, head))
    rank = np.zeros(n + 1, np.int64)  # the last is that of the empty suffix, before all others

    def number(at: np.ndarray, new: np.ndarray) -> None:
        """Ranks of the suffixes order[at], where new marks the first of each group."""
        rank[order[at]] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] + 1

    every = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = (head[order][1:] != head[order][:-1]) | (left[order][1:] != left[order][:-1])
    number(every, new)
    tied = ~new
    tied[:-1] |= ~new[1:]
    at, h = every[tied], 8
    while len(at):
        suffix = order[at]
        mine, further = rank[suffix], rank[np.minimum(suffix + h, n)]
        by = np.argsort(mine.astype(np.uint64) << np.uint64(32) | further.astype(np.uint64), kind="stable")
        order[at] = suffix[by]
        mine, further = mine[by], further[by]
        new = np.ones(len(at), bool)
        new[1:] = (mine[1:] != mine[:-1]) | (further[1:] != further[:-1])
        number(at, new)
        tied = ~new
        tied[:-1] |= ~new[1:]
        at, h = at[tied], h * 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, the bytes it has in common with the one before it in the array, `most` at most.

    Kasai's bound: it is at least that of the suffix one byte earlier, less one. Sampled suffixes are compared from
    their first byte on; those after them begin where the bound of the sample leaves them.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    out = np.zeros(n, np.int64)
    stride = 16

    def extend(at: np.ndarray) -> None:
        at = at[before[at] >= 0]
        while len(at):
            i, j = at + out[at], before[at] + out[at]
            same = (padded[i] == padded[j]) & (i < n) & (j < n) & (out[at] < most)
            at = at[same]
            out[at] += 1

    for step in (stride, 1):
        at = np.arange(0, n, step)
        if step == 1:
            sample = out[at - at % stride]
            out[:] = np.where(before >= 0, np.maximum(out, sample - at % stride), 0)
        extend(at)
    return out


class Shard:
    """Runs of text one after the other, parted by a byte that no UTF-8 text has."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.data = np.frombuffer(b"\xff".join(texts), np.uint8)
        size = np.array([len(t) for t in texts])
        self.begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        starts = np.maximum(size - length + 1, 0)
        at = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
        self.starts = np.repeat(self.begin, starts) + at
        self.valid = np.zeros(len(self.data), bool)
        self.valid[self.starts] = True
        self.order = suffix_array(self.data)

    def repeated(self) -> np.ndarray:
        """Starts whose string starts elsewhere in the shard too."""
        common = common_prefixes(self.data, self.order, self.length) >= self.length
        both = common[self.order]
        both[:-1] |= common[self.order][1:]
        out = self.order[both]
        return np.sort(out[self.valid[out]])

    def strings(self, at: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.data, self.length)[at].view(f"S{self.length}")[:, 0]

    def found_in(self, other: Shard) -> np.ndarray:
        """Starts whose string is among the other shard's, by binary search in its sorted ones."""
        theirs = other.strings(other.order[other.valid[other.order]])
        out = []
        for k in range(0, len(self.starts), 50_000):
            at = self.starts[k : k + 50_000]
            mine = self.strings(at)
            place = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
            out.append(at[theirs[place] == mine])
        return np.concatenate(out) if out and len(theirs) else np.zeros(0, np.int64)

    def ranges(self, at: np.ndarray) -> list[tuple[int, int, int]]:
        """Sorted starts as (run, first start, last start)."""
        if not len(at):
            return []
        run = np.searchsorted(self.begin, at, "right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(run) > 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        return list(zip(run[first].tolist(), (at[first] - self.begin[run[first]]).tolist(), (at[last] - self.begin[run[first]]).tolist(), strict=True))


def _search(length: int, shard: int):
    def solve(rows: list[tuple], low: int, high: int) -> pa.RecordBatch:
        out: list[tuple[int, int, int, int]] = []
        parts = [[r for r in rows if r[3] == p] for p in ([low] if low == high else [low, high])]
        made = [Shard([r[2] for r in part], length) for part in parts] if all(parts) else []
        hits = [] if not made else [made[0].repeated()] if low == high else [made[0].found_in(made[1]), made[1].found_in(made[0])]
        for part, s, at in zip(parts, made, hits, strict=False):
            out += [(part[run][0], part[run][1], a, b) for run, a, b in s.ranges(at)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:2]] + [pa.array(c, pa.int32()) for c in columns[2:]], ["key", "content", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, low and high. Small keys share a shard; each pair of shards of a large key is solved alone."""
        held, rows, size = None, [], 0
        for batch in batches:
            for key, content, text, part, parts, low, high in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                task = (key, low, high) if parts > 1 else None
                if rows and (task != held or (task is None and key != rows[-1][0] and size > shard)):
                    yield solve(rows, *(held[1:] if held else (0, 0)))
                    rows, size = [], 0
                held = task
                rows.append((key, content, text, part))
                size += len(text)
        if rows:
            yield solve(rows, *(held[1:] if held else (0, 0)))

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each run that is asked for: key, content, text, and the shard columns."""
    for batch in batches:
        out: list[tuple] = []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            data = text.encode()
            out += [(w["key"], w["content"], data[w["a"] : w["b"] + LENGTH], w["parts"]) for w in wanted]
            if len(out) > 2000:
                yield _run_rows(out)
                out = []
        if out:
            yield _run_rows(out)


def _run_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "content", "text", "parts"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is kept of each text, and the runs that are not."""
    for whole in batches:
        for batch in pieces(whole, "text"):
            kept, spans = [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                data, gone = (text or "").encode(), []
                for a, b in sorted((r["a"], r["b"] + LENGTH) for r in ranges or []):
                    if gone and a <= gone[-1]["to"]:
                        gone[-1]["to"] = max(b, gone[-1]["to"])
                    else:
                        gone.append({"from": a, "to": b})
                kept.append(b"".join(data[a:b] for a, b in zip([0, *(g["to"] for g in gone)], [*(g["from"] for g in gone), len(data)], strict=True)))
                spans.append(gone)
            kinds = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(spans, kinds)], ["doc_id", "kept", "spans"])


def repeated_ranges(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """docs(doc_id, text, t) to (doc_id, t, ranges): first and last starts of the strings that start elsewhere too."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.mapInArrow(_emit_runs, f"doc_id {kind}, t long, a int, b int, key long, content long, alone boolean")
    found = written(found, "runs")
    one = found.groupBy("key", "content").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "t", "a", "b")).alias("at"), F.bool_and("alone").alias("alone"))
    one = written(one, "contents")
    size = F.col("at.b") - F.col("at.a") + LENGTH
    by_key = one.groupBy("key").agg(F.count("*").alias("k"), F.sum(size.cast("long")).alias("bytes"), F.bool_and("alone").alias("_alone"))
    open_keys = by_key.where((F.col("k") > 1) | ~F.col("_alone")).select("key", "k", F.ceil(F.col("bytes") / shard).cast("int").alias("parts"))
    asked = one.join(open_keys, "key").where((F.col("k") > 1) | (F.col("n") == 1))
    wanted = asked.select("at.doc_id", "at.t", F.struct("key", "content", "at.a", "at.b", "parts").alias("w"))
    wanted = written(wanted.groupBy("doc_id", "t").agg(F.collect_list("w").alias("wanted")), "wanted")
    # what is asked for grows with the corpus, so it is not broadcast at any size
    texts = docs.alias("d").join(wanted.alias("w"), F.expr("d.doc_id <=> w.doc_id and d.t = w.t")).select("d.doc_id", "d.t", "d.text", "wanted")
    texts = texts.mapInArrow(_cut, "key long, content long, text binary, parts int")
    texts = texts.withColumn("part", F.pmod(F.xxhash64("content"), "parts").cast("int"))
    texts = texts.select("key", "content", "text", "part", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    texts = texts.select("key", "content", "text", "part", "parts", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    texts = texts.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "content")
    parts = texts.mapInArrow(_search(LENGTH, shard), "key long, content long, from int, to int").distinct()
    parts = parts.groupBy("key", "content").agg(F.collect_set(F.struct("from", "to")).alias("found"))
    parts = written(parts, "found")
    again = one.where("n > 1").select("key", "content", F.lit(True).alias("whole"))
    verdict = again.join(parts, ["key", "content"], "full")
    hit = found.join(verdict, ["key", "content"])
    whole = F.array(F.struct("a", "b"))
    some = F.transform("found", lambda x: F.struct((F.col("a") + x["from"]).alias("a"), (F.col("a") + x["to"]).alias("b")))
    ranges = F.when(F.col("whole"), whole).otherwise(some)
    return hit.select("doc_id", "t", ranges.alias("r")).groupBy("doc_id", "t").agg(F.array_distinct(F.flatten(F.collect_list("r"))).alias("ranges"))


def cut_repeats(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """docs(doc_id, text) to (doc_id, kept, spans), one row for each.

    `kept` are the remaining bytes, which need not be UTF-8, for a cut can fall within a character. `spans` are the maximal
    removed runs in order, each from its first byte to the one after its last.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    ranges = repeated_ranges(docs.where(F.octet_length("text") >= LENGTH), shard)
    both = docs.alias("d").join(ranges.alias("r"), F.expr("d.doc_id <=> r.doc_id and d.t = r.t"), "left").select("d.doc_id", "d.text", "ranges")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(_cut_out, f"doc_id {kind}, kept binary, spans array<struct<from: long, to: long>>")


def without_repeats(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each: what `cut_repeats` gives, in figures."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    cut = cut_repeats(docs, shard).withColumn("n_removed", removed)
    n_bytes = F.octet_length("kept") + F.col("n_removed")
    return cut.select("doc_id", n_bytes.alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_repeats(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))

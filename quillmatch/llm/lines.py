"""Line dedup by a segment-partition edit join.

A line (a \\n-part of a text that holds a word) goes when an equal line stands earlier in the corpus, or when it and an
earlier line both have MIN_CHARS characters or more and lie within EDITS edits of each other. Earlier means a lesser
(doc_id, position). Such pairs share a segment: a line of n characters is cut into EDITS + 1 segments, and every line
probes, for each admissible length, the substrings that an alignment within EDITS edits could map to a segment.
Lines that meet under a key are held against the earliest one there, then, where that fails, against the others in
blocks, until one earlier line is verified. Pairs whose character parities differ too much are ruled out, which loses
nothing; the rest is verified by a bit-parallel automaton over a band of 2 * EDITS + 1 diagonals.

Defined results: null or empty texts have no lines and stay as they are; lines without a word are not judged and stay;
rows that repeat a doc_id count as one document, in which lines at one position are neither earlier than the other; so
do rows with a null doc_id, a document before all others; extra columns go along; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import flat, mix64, pieces
from .common import WORD, put_back, set_aside, small_or_shuffled, table, written

EDITS = 2
MIN_CHARS = 20
#: Lines of a bucket, and seekers among them, that one task holds at most, about.
BLOCK = 4_000
_STEP = 0x9E3779B97F4A7C15


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line): every line that holds a word, positions from 0."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.col("line").rlike(WORD))


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lines one after the other, and where each line starts."""
    data, offsets = flat(column)
    first = (data & 0xC0) != 0x80
    count = np.concatenate([[0], np.cumsum(first)])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), count[offsets]


def _parity(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each line, bit c is the parity of its number of characters with code point c modulo 32."""
    n = len(starts) - 1
    line = np.repeat(np.arange(n), np.diff(starts))
    odd = np.bincount(line * 32 + (codes & 31), minlength=n * 32).reshape(n, 32) & 1
    return (odd.astype(np.uint32) << np.arange(32, dtype=np.uint32)).sum(1, dtype=np.uint32).view(np.int32)


class _Rolling:
    """Hashes of any substrings of a run of code points."""

    def __init__(self, codes: np.ndarray):
        with np.errstate(over="ignore"):
            step = np.full(len(codes) + 1, _STEP, np.uint64)
            back = np.full(len(codes) + 1, pow(_STEP, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self.back = np.multiply.accumulate(back)
            powers = np.multiply.accumulate(step)[:-1]
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[start + length] - self.sums[start]) * self.back[start]


def _segment(n: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of lines of n characters; the last n % parts segments are one longer."""
    short, longer = n // parts, n % parts
    from_end = parts - i
    start = i * short + np.maximum(longer - from_end, 0)
    return start, short + (from_end <= longer)


def keys_of(codes: np.ndarray, starts: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(line index, key, own) for the substrings of the lines that probe the segments of lines no longer than they are.

    `own` marks a line's own segments, which are among its probes.
    """
    rolling, n, parts = _Rolling(codes), np.diff(starts), edits + 1
    for i in range(parts):
        for less in range(edits + 1):
            start, length = _segment(n - less, i, parts)
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            with np.errstate(over="ignore"):
                salt = mix64((n - less).astype(np.uint64) * np.uint64(parts) + np.uint64(i))
            for shift in range(low, high + 1):
                at = start + shift
                which = np.flatnonzero((at >= 0) & (at + length <= n))
                found = rolling.of(starts[:-1][which] + at[which], length[which])
                yield which, mix64(found ^ salt[which]).view(np.int64), less == 0 and shift == 0


def _emit_keys(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "line"):
                h, first = np.unique(batch.column("h").to_numpy(), return_index=True)  # equal lines give equal keys
                codes, starts = _codes(batch.column("line").take(pa.array(first)))
                for which, key, own in keys_of(codes, starts, edits):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(h[which]), pa.array(np.full(len(key), own))], ["key", "h", "own"])

    return run


def within(a: str, b: str, edits: int) -> bool:
    """Whether a and b lie within so many insertions, deletions and substitutions.

    Bit o of reach[d] says that, with d edits and j characters of b read, j - edits + o characters of a can have been read.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    a, b = a[same:], b[same:]
    same = 0
    while same < min(len(a), len(b)) and a[-1 - same] == b[-1 - same]:
        same += 1
    a, b = a[: len(a) - same], b[: len(b) - same]
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << (i + edits)
    band = (1 << (2 * edits + 1)) - 1
    reach = [((1 << (d + 1)) - 1) << edits & band for d in range(edits + 1)]
    for j, c in enumerate(b):
        match = where.get(c, 0) >> j & band
        new: list[int] = []
        for d, old in enumerate(reach):
            now = old & match
            if d:
                now |= reach[d - 1] | reach[d - 1] >> 1 | new[d - 1] << 1
            new.append(now & band)
        if not new[-1]:
            return False
        reach = new
    return bool(reach[-1] >> (len(a) - len(b) + edits) & 1)


def _bits(column: pa.Array) -> np.ndarray:
    return _parity(*_codes(column)).view(np.uint32)


def _verify(edits: int):
    """Keeps the (h, g) of the rows whose two lines lie within so many edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # an edit changes two parities at most
            maybe = np.flatnonzero(np.bitwise_count(_bits(batch.column("line")) ^ _bits(batch.column("lead_line"))) <= 2 * edits)
            some = batch.take(pa.array(maybe))
            lines = zip(some.column("line").to_pylist(), some.column("lead_line").to_pylist(), strict=True)
            keep = some.filter(pa.array([within(x, y, edits) for x, y in lines], pa.bool_()))
            yield pa.RecordBatch.from_arrays([keep.column("h"), keep.column("g")], ["h", "g"])

    return run


class _Task:
    """Witnesses and seekers of one block of a bucket, each in the order of their first places."""

    def __init__(self):
        self.rank, self.last = 0, None
        self.witnesses: list[tuple[int, bool, int, str]] = []
        self.seekers: list[tuple[int, bool, int, str, int, int]] = []

    def add(self, seeks: bool, own: bool, first: tuple, bits: int, line: str, h: int, g: int) -> None:
        if first != self.last:
            self.rank, self.last = self.rank + 1, first
        if seeks:
            self.seekers.append((self.rank, own, bits, line, h, g))
        else:
            self.witnesses.append((self.rank, own, bits, line))

    def found(self, edits: int) -> Iterator[tuple[int, int]]:
        """(h, g) of the seekers that have an earlier witness; the first one ends a seeker's search."""
        if not self.witnesses:
            return
        ranks, owns, bits, lines = zip(*self.witnesses, strict=True)
        ranks, owns, bits = np.array(ranks), np.array(owns), np.array(bits, np.uint32)
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        for rank, own, mine, line, h, g in self.seekers:
            stop = int(np.searchsorted(ranks, rank))
            for at in range(0, stop, 1024):
                part = slice(at, min(stop, at + 1024))
                maybe = (np.bitwise_count(bits[part] ^ np.uint32(mine)) <= 2 * edits) & (np.abs(size[part] - len(line)) <= edits)
                if not own:
                    maybe &= owns[part]
                if any(within(lines[at + k], line, edits) for k in np.flatnonzero(maybe)):
                    yield h, g
                    break


def _seek(edits: int):
    names = ["key", "block", "turn", "seeks", "own", "doc_id", "pos", "h", "g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by their task and then by first place; a task may go on in the next batch."""
        held, task = None, _Task()
        for batch in batches:
            out: list[tuple[int, int]] = []
            lines, bits = batch.column("line").to_pylist(), _bits(batch.column("line")).tolist()
            columns = zip(*[batch.column(c).to_pylist() for c in names], lines, bits, strict=True)
            for key, block, turn, seeks, own, doc, pos, h, g, line, mine in columns:
                if (key, block, turn) != held:
                    out += task.found(edits)
                    held, task = (key, block, turn), _Task()
                task.add(seeks, own, (doc, pos), mine, line, h, g)
            yield _hashes(out)
        yield _hashes(list(task.found(edits)))

    return run


def _hashes(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["h", "g"])


def bucket_members(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(key, own, h, g, first, line): the different lines of every bucket that holds two of them and a segment of one."""
    lines = lines_of(docs).where(F.length("line") >= min_chars).withColumn("h", F.xxhash64("line"))
    keys = lines.select("h", "line").mapInArrow(_emit_keys(edits), "key long, h long, own boolean")
    # equal lines and hot keys shrink to a row a task before they are shuffled
    shared = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max("own").alias("some"))
    shared = written(shared.where("low <> high and some").select("key"), "buckets")
    members = keys.join(small_or_shuffled(shared), "key").groupBy("key", "h").agg(F.max("own").alias("own"))
    members = written(members, "members")
    ids = written(members.select("h").distinct(), "ids")
    texts = lines.join(small_or_shuffled(ids), "h", "left_semi").groupBy("h", "line").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    return members.join(texts.withColumn("g", second_hash(F.col("line"))), "h")


def near_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """(h, g): the two hashes of each line that lies within so many edits of an earlier one.

    One earlier line is enough, so no list of pairs is made. Every member of a bucket is held against the earliest one that
    has a segment there; what that settles seeks no further. The others look through the earlier members of their buckets.
    """
    full = written(bucket_members(docs, edits, max(min_chars, edits + 1)), "lines")
    lead = full.where("own").groupBy("key").agg(F.min(F.struct("first", "h", "line")).alias("lead"))
    facts = full.groupBy("key").agg(F.count("*").alias("n"), F.min("first").alias("start"))
    with_lead = full.join(lead, "key").where(F.expr(f"first > lead.first and abs(length(line) - length(lead.line)) <= {edits}"))
    settled = with_lead.select("h", "g", "line", F.col("lead.line").alias("lead_line")).mapInArrow(_verify(edits), "h long, g long")
    settled = written(settled.distinct(), "settled")

    open_ = full.join(settled, ["h", "g"], "left_anti").join(facts.join(lead, "key"), "key")
    # a bucket of two is left open only where the earlier one has no segment of its own in it
    open_ = open_.where("first > start and (n > 2 or (own and start < lead.first))")
    seekers = written(open_.select("key", "own", "h", "g", "first", "line", "n"), "seekers")
    cuts = seekers.groupBy("key").agg(F.ceil(F.max("n") / block).cast("int").alias("blocks"), F.ceil(F.count("*") / block).cast("int").alias("turns"))
    place = lambda count: F.pmod(F.col("g"), count).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    rest = ["own", "first.doc_id", "first.pos", "h", "g", "line"]
    witnesses = full.join(cuts, "key").select("key", place("blocks").alias("block"), each("turns").alias("turn"), F.lit(False).alias("seeks"), *rest)
    asking = seekers.join(cuts, "key").select("key", each("blocks").alias("block"), place("turns").alias("turn"), F.lit(True).alias("seeks"), *rest)
    tasks = witnesses.unionByName(asking).repartition("key", "block", "turn").sortWithinPartitions("key", "block", "turn", "doc_id", "pos")
    found = tasks.mapInArrow(_seek(edits), "h long, g long")
    return settled.unionByName(found).distinct()


def second_hash(line):
    return F.xxhash64(F.lit("second"), line)


def judged_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """(h, g, first, near): each different line, by its two hashes, where it stands first, and whether it goes as a near copy."""
    hashed = lines_of(docs).select("doc_id", "pos", F.xxhash64("line").alias("h"), second_hash(F.col("line")).alias("g"))
    firsts = hashed.groupBy("h", "g").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    near = near_lines(docs, edits, min_chars, block).withColumn("near", F.lit(True))
    return firsts.join(near, ["h", "g"], "left").withColumn("near", F.coalesce("near", F.lit(False)))


def _stays():
    return F.sort_array(F.collect_list(F.when(~F.col("near"), F.struct("pos", "h"))))


def kept_lines(judged: DataFrame) -> DataFrame:
    """judged_lines to (doc_id, kept, n_near): positions and hashes of the lines that stay, and how many first lines went as near copies, of each doc_id."""
    mine = judged.where("first.doc_id is not null").select(F.col("first.doc_id").alias("doc_id"), F.col("first.pos").alias("pos"), "h", "near")
    return mine.groupBy("doc_id").agg(_stays().alias("kept"), F.count_if("near").alias("n_near"))


def kept_of_unnamed(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """rows(_row, text) without a doc_id to (_row, kept, n_near): as kept_lines, of each row, for these may be any number."""
    lines = rows.select("_row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.where(F.col("line").rlike(WORD)).select("_row", "pos", F.xxhash64("line").alias("h"), second_hash(F.col("line")).alias("g"))
    first = judged.where("first.doc_id is null").select("h", "g", F.col("first.pos").alias("pos"), "near")
    return lines.join(first, ["h", "g", "pos"]).groupBy("_row").agg(_stays().alias("kept"), F.count_if("near").alias("n_near"))


def with_kept(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text, ...) and kept, n_near; rows without a doc_id, if there are any, are judged each by itself."""
    judged = judged_lines(docs.select("doc_id", "text"), edits, min_chars, block)
    if docs.where("doc_id is null").isEmpty():
        return docs.join(kept_lines(judged), "doc_id", "left")
    judged = written(judged, "judged")
    unnamed = written(docs.where("doc_id is null").withColumn("_row", F.monotonically_increasing_id()), "unnamed")
    named = docs.where("doc_id is not null").join(kept_lines(judged), "doc_id", "left")
    return named.unionByName(unnamed.join(kept_of_unnamed(unnamed.select("_row", "text"), judged), "_row", "left").drop("_row"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of docs with their texts without the lines that go; n_chars, where there is one, follows the text."""
    used = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    out = with_kept(set_aside(docs, *used), edits, min_chars).withColumn("_lines", F.split("text", "\n"))
    mine = F.filter(F.coalesce("kept", F.array().cast("array<struct<pos:int,h:bigint>>")), lambda k: F.xxhash64(F.get("_lines", k["pos"])) == k["h"])
    blank = F.filter(F.transform("_lines", lambda x, i: F.when(~x.rlike(WORD), i)), lambda i: i.isNotNull())
    out = out.withColumn("_at", F.sort_array(F.concat(F.transform(mine, lambda k: k["pos"]), blank)))
    text = F.array_join(F.transform("_at", lambda i: F.get("_lines", i)), "\n")
    out = out.withColumn("_text", F.when(F.col("text").isNotNull(), text))
    new = {"doc_id": F.col("doc_id"), "text": F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in used else {})
    return out.select(*put_back(docs.columns, new))


def op10_lines(spark, sf_dir: str) -> DataFrame:
    """Per document: how many lines it has, how many go as equal or as near copies, and the positions that stay."""
    count = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(WORD))).cast("long")
    # counted first, so that no text goes through the join
    docs = with_kept(table(spark, sf_dir, "documents").select("doc_id", "text", count.alias("n_lines")))
    out = docs.select("doc_id", "n_lines", F.transform("kept", lambda k: k["pos"]).alias("kept_lines"), "n_near")
    out = out.withColumn("kept_lines", F.coalesce("kept_lines", F.array().cast("array<int>"))).withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    removed = F.col("n_lines") - F.size("kept_lines")
    return out.select("doc_id", "n_lines", (removed - F.col("n_near")).alias("n_equal"), "n_near", removed.alias("n_removed"), "kept_lines")


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, without the lines that go."""
    return dedup_lines(docs)

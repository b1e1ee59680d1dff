"""Near-equal vectors by collision-counting projections.

Vectors are compared within a label. Each of PROJECTIONS random directions gives every vector a value; the values are
sorted, and a window of fixed half-width around a query's value collides with the vectors in it. Pairs with as many
collisions as a pair at the threshold reaches with chance RECALL are verified by their cosine in double precision.

Equal vectors are one from the start, with their number. A label beyond BLOCK distinct vectors is cut into blocks, and
each pair of blocks is a task. Out of a task come numbers of links, one for each vector, and the links that join its
vectors into classes: never all pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null label or vec_id,
link with nothing (no links, a class of their own); vectors of different lengths never link; repeated rows count each;
extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, table, written

COSINE = 0.93
PROJECTIONS = 48
#: Half-width of the window, in standard deviations of the distance between two projections of a pair at the threshold.
WIDTH = 1.5
RECALL = 0.99999
BLOCK = 3_000


def least_count(projections: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL) -> int:
    """The greatest count that a pair at the threshold reaches with chance `recall`: collisions are binomial."""
    p = math.erf(width / math.sqrt(2))
    below, count = 0.0, 0
    while True:
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > 1 - recall:
            return count
        count += 1


def directions(length: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(length).standard_normal((length, projections))


def candidates(queries: np.ndarray, others: np.ndarray, cosine: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each unit vector, the others that collide with it often enough."""
    to = directions(queries.shape[1])
    q, o = queries @ to, others @ to
    half, least = WIDTH * math.sqrt(2 - 2 * cosine), least_count()
    order = np.argsort(o, axis=0)
    ordered = np.take_along_axis(o, order, 0)
    low = np.stack([np.searchsorted(ordered[:, k], q[:, k] - half) for k in range(to.shape[1])], 1)
    high = np.stack([np.searchsorted(ordered[:, k], q[:, k] + half, "right") for k in range(to.shape[1])], 1)
    columns = [np.ascontiguousarray(order[:, k]) for k in range(to.shape[1])]
    for i in range(len(q)):
        hits = np.concatenate([c[a:b] for c, a, b in zip(columns, low[i], high[i], strict=True)])
        yield i, np.flatnonzero(np.bincount(hits, minlength=len(others)) >= least)


def _solve(ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, sides: np.ndarray, apart: bool, cosine: float) -> pa.RecordBatch:
    unit = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
    group, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    rows: list[tuple[int, int | None, int]] = []
    queries = np.flatnonzero(sides == sides.min()) if apart else np.arange(len(ids))
    others = np.flatnonzero(sides != sides.min()) if apart else queries
    norms = np.sqrt((vectors * vectors).sum(1))
    if len(queries) and len(others):
        for i, found in candidates(unit[queries], unit[others], cosine):
            mine, them = queries[i], others[found]
            them = them[them > mine] if not apart else them
            them = them[vectors[them] @ vectors[mine] / (norms[them] * norms[mine]) >= cosine]
            if not len(them):
                continue
            links[mine] += counts[them].sum()
            links[them] += counts[mine]
            for j in them[np.unique(group[them], return_index=True)[1]]:
                if group[j] != group[mine]:
                    group[group == group[j]] = group[mine]
                    rows.append((int(ids[mine]), int(ids[j]), 0))
    rows += [(int(ids[k]), None, int(links[k])) for k in np.flatnonzero(links)]
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])


def _search(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by their task: label, length and the two blocks."""
        held, rows = None, []

        def solve() -> pa.RecordBatch:
            ids, counts, sides, vectors = zip(*rows, strict=True)
            return _solve(np.array(ids), np.array(counts), np.array(vectors, np.float64), np.array(sides), held[2] != held[3], cosine)

        for batch in batches:
            for label, size, low, high, rep, n, block, vector in zip(*[batch.column(c).to_pylist() for c in ("label", "size", "low", "high", "rep", "n", "block", "v")], strict=True):
                task = (label, size, low, high)
                if rows and task != held:
                    yield solve()
                    rows = []
                held = task
                rows.append((rep, n, block, vector))
        if rows:
            yield solve()

    return run


def linked(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vectors(vec_id, embedding, label) to (vec_id, n_links, component_id, kept), one row for each."""
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    good = good.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit("second"), "v"))
    some = good.groupBy("label", "h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    distinct = written(some, "vectors")
    # one row of each group carries the vector; equal rows of one vec_id are one of them
    reps = good.join(distinct.select("label", "h", "g", F.col("rep").alias("vec_id"), "rep", "n"), ["label", "h", "g", "vec_id"]).dropDuplicates(["label", "h", "g"])
    reps = reps.withColumn("size", F.size("v"))
    blocks = reps.groupBy("label", "size").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = reps.join(blocks, ["label", "size"]).withColumn("block", F.pmod("h", "blocks").cast("int"))
    tasks = placed.select("label", "size", "rep", "n", "block", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    keys = ["label", "size", "low", "high"]
    made = tasks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_search(cosine), "a long, b long, n long")
    made = written(made, "links")
    counts = made.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    roots = components(made.where("b is not null").select("a", "b")).select(F.col("id").alias("rep"), "root")
    facts = distinct.join(counts, "rep", "left").join(roots, "rep", "left")
    facts = facts.select("label", "h", "g", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    of_good = good.select("vec_id", "label", "h", "g").join(facts, ["label", "h", "g"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))))
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return of_good.unionByName(rest).withColumn("kept", F.expr("vec_id <=> component_id"))


def op9_vectors(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))

"""Whitening of vectors by MLlib's computeSVD on centred rows.

Each entry c becomes the whole number x = floor(1024 * c) + 100000, so that sums are exact. Rows less their mean are an MLlib
RowMatrix; computeSVD is asked for all singular values, by which it sums the Gram matrix over the cluster and solves it by
LAPACK (for a few values only it would take ARPACK, to ten digits). Singular values are rescaled: the eigenvalue of the covariance
with divisor n is s * s / n. The total variance is not that of the values, but comes from each row's exact deviation.

What passes the driver is a number for each dimension and one matrix of them, whatever the number of rows.

Defined results: rows whose vector is null, or holds null or non-finite entries, go, as do those with an entry that makes x too
large for a long. Of vectors of several lengths those of the most frequent one are fitted and returned (ties: the
shorter), empty ones never. A component whose eigenvalue is nought to working precision (LEAST of the greatest) has no scale and
is left out, so equal vectors only, or one vector, give no rows. Repeated rows and null or repeated ids each count and are
returned; other columns are not read; an empty table gives no rows. `deviation` is null where it exceeds a long (from some ten
million rows on); `deviation_exact` holds 38 digits, and is null beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

COMPONENTS = 8
#: Share of the greatest eigenvalue below which one is nought: a double keeps sixteen digits of the greatest.
LEAST = 1e-11
SCHEMA = "vec_id long, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"


def whole_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, size, x): sound vectors as arrays of whole numbers."""
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * 1024) < float(1 << 62))
    rows = vectors.select("vec_id", F.col("embedding").alias("v")).where(F.coalesce(F.forall("v", fits), F.lit(False)))
    return rows.select("vec_id", F.size("v").alias("size"), F.transform("v", lambda c: F.floor(F.when(fits(c), c.cast("double") * 1024)) + 100000).alias("x"))


class Centre:
    """n, the sums S of each dimension as m = floor(S / n) and the rest r, and how far x lies from m at most."""

    def __init__(self, rows: DataFrame):
        sums = rows.select(F.posexplode("x").alias("pos", "x")).groupBy("pos").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.min("x").alias("low"), F.max("x").alias("high"))
        found = sums.orderBy("pos").collect()  # a row for each dimension
        self.n, totals = found[0]["n"], [int(r["s"]) for r in found]
        self.mean = [s // self.n for s in totals]
        self.rest = [s % self.n for s in totals]
        self.reach = max(max(r["high"] - m, m - r["low"]) for r, m in zip(found, self.mean, strict=True)) + 1

    def centred(self, x):
        """Column x less its mean: the whole part exactly, then the fraction."""
        whole = F.zip_with(x, F.lit(self.mean), lambda a, m: (a - m).cast("double"))
        return F.zip_with(whole, F.lit([r / self.n for r in self.rest]), lambda a, f: a - f)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n * x - S) ** 2, exact."""
        small = x.shape[1] * (self.n * self.reach) ** 2 < 1 << 63
        y = (x - np.array(self.mean, np.int64)).astype(np.int64 if small else object) * self.n - np.array(self.rest, np.int64 if small else object)
        return (y * y).sum(1).tolist()


def solve(rows: DataFrame, centre: Centre) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues of the covariance, falling, and their unit vectors as columns."""
    size = len(centre.mean)
    dense = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centre.centred(F.col("x"))).alias("row")), "row")
    found = RowMatrix(dense, centre.n, size).computeSVD(size, computeU=False)
    values = np.array(found.s.toArray()) ** 2 / centre.n
    axes = np.array(found.V.toArray())
    return values, axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors(vec_id, embedding) to a row for each sound vector and component."""
    spark = vectors.sparkSession
    rows = whole_rows(vectors)
    common = rows.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if common is None:
        return spark.createDataFrame([], SCHEMA)
    rows = rows.where(F.col("size") == common["size"])
    centre = Centre(rows)
    values, axes = solve(rows, centre)
    keep = [k for k in range(min(components, len(values))) if values[k] > LEAST * values[0]]
    if not keep:
        return spark.createDataFrame([], SCHEMA)
    scaled = axes[:, keep] / np.sqrt(values[keep])
    names = [f"w{k}" for k in range(len(keep))]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, part = np.array(centre.mean, np.int64), np.array(centre.rest, np.float64) / centre.n
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            exact = pa.array([d if d < 10**38 else None for d in centre.deviations(x)], pa.decimal128(38, 0))
            w = ((x - mean).astype(np.float64) - part) @ scaled
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), exact, *map(pa.array, np.ascontiguousarray(w.T))], ["vec_id", "exact", *names])

    made = rows.select("vec_id", "x").mapInArrow(project, ", ".join(["vec_id long", "exact decimal(38,0)", *(f"{c} double" for c in names)]))
    made = written(made, "whitened")
    # covar_pop subtracts the means before it multiplies; a sum of decimals that needs over 38 digits goes on in doubles
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    total = F.coalesce(F.try_sum("exact").cast("double"), F.sum(F.col("exact").cast("double")))
    facts = made.agg(total.alias("total"), *[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()
    trace = facts["total"] / centre.n / centre.n / centre.n
    error = max(abs(facts[f"{a}_{b}"] - (a == b)) for a, b in pairs)
    each = made.select("vec_id", "exact", F.posexplode(F.array(*names)).alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(centre.n).cast("long").alias("n"), F.col("exact").try_cast("long").alias("deviation"), F.col("exact").alias("deviation_exact"),
        "whitened", F.get(F.lit([float(values[k] / trace) for k in keep]), "k").alias("explained"), F.lit(float(error)).alias("identity_error"),
    )


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))

"""Documents in: text and binary files, page pictures carved from PDFs; results out and in again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.functions import text as X


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one row for each text file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, kind, size, content): files with how they have to be read."""
    files = spark.read.format("binaryFile").load(path)
    name = F.lower("path")
    kind = F.when(name.rlike(r"\.pdf$"), "pdf").when(name.rlike(r"\.(png|jpe?g|webp|bmp|gif)$"), "image").otherwise("text")
    return files.select(F.col("path").alias("doc_id"), kind.alias("kind"), F.col("length").alias("size"), "content")


def needs_pictures(text, size, forced=False):
    """Whether a PDF's text layer is of no use: too little of it, unprintable, or damaged Hindi."""
    solid = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))
    broken = F.contains(text, F.lit("�")) | ~F.coalesce(text, F.lit("")).rlike(r"[\p{L}\p{N}]")
    damaged = (F.coalesce(X.hindi_badness(text), F.lit(0.0)) > 0.06) & (X.latin_share(text) < 0.3)
    return F.lit(forced) | (solid < F.greatest(F.lit(150.0), size / 800)) | broken | damaged


PICTURE = re.compile(rb"/Filter\s*/DCTDecode")
#: Bytes that a page's picture exceeds; logos and thumbnails do not.
LEAST_PICTURE = 40_000


def carve(pdf: bytes, expected: int | None = None) -> list[bytes] | None:
    """The JPEG streams of a PDF whose pages are pictures, in order; null unless they are as many as expected and all as large as pages."""
    out: list[bytes] = []
    for mark in PICTURE.finditer(pdf):
        head = re.compile(rb"stream\r?\n?").search(pdf, mark.start())
        stop = pdf.find(b"endstream", head.end()) if head else -1
        if stop < 0:
            continue
        body = pdf[head.end() : stop]
        last = body.rfind(b"\xd9")
        if body.startswith(b"\xff\xd8") and last > 0 and body[last - 1] == 0xFF:
            out.append(body[: last + 1])
    whole = bool(out) and (not expected or len(out) == expected) and all(len(x) > LEAST_PICTURE for x in out)
    return out if whole else None


def page_pictures(files: DataFrame) -> DataFrame:
    """files(doc_id, content), and n_pages where it is known, to (doc_id, page_no, bytes): all pages of a file or none."""
    files = files.select("doc_id", "content", F.col("n_pages") if "n_pages" in files.columns else F.lit(None).cast("int").alias("n_pages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, content, n in zip(pdf["doc_id"], pdf["content"], pdf["n_pages"], strict=True):
                pages = carve(bytes(content), None if pd.isna(n) else int(n)) or []
                yield pd.DataFrame([(doc, i + 1, b) for i, b in enumerate(pages)], columns=["doc_id", "page_no", "bytes"])

    return files.mapInPandas(run, "doc_id string, page_no int, bytes binary")


def page_counts(files: DataFrame) -> DataFrame:
    """files(doc_id, content) to (doc_id, n_pages), 0 where the pages are no pictures."""
    counts = page_pictures(files).groupBy("doc_id").agg(F.count("*").cast("int").alias("n_pages"))
    return files.select("doc_id").distinct().join(counts, "doc_id", "left").fillna(0, ["n_pages"])


def picture_pdf(pages: list[tuple[int, int, bytes]]) -> bytes:
    """A PDF of JPEG pages (width, height, bytes)."""
    body, places = bytearray(b"%PDF-1.4\n"), []

    def put(data: bytes) -> None:
        places.append(len(body))
        body.extend(b"%d 0 obj\n" % len(places) + data + b"\nendobj\n")

    kids = b" ".join(b"%d 0 R" % (3 + 3 * i) for i in range(len(pages)))
    put(b"<< /Type /Catalog /Pages 2 0 R >>")
    put(b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), kids))
    for i, (w, h, jpeg) in enumerate(pages):
        n = 3 + 3 * i
        put(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Contents %d 0 R /Resources << /XObject << /I %d 0 R >> >> >>" % (w, h, n + 1, n + 2))
        draw = b"q %d 0 0 %d 0 0 cm /I Do Q" % (w, h)
        put(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(draw), draw))
        head = b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode /Length %d >>"
        put(head % (w, h, len(jpeg)) + b"\nstream\n" + jpeg + b"\nendstream")
    table = len(body)
    body.extend(b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places))
    body.extend(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, table))
    return bytes(body)


def picture_pdfs(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_no, w, h, bytes) to (doc_id, pdf); pages without bytes go."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.w, r.h, bytes(r.bytes)) for r in group.sort_values("page_no").itertuples() if r.bytes]
        return pd.DataFrame({"doc_id": [group["doc_id"].iloc[0]], "pdf": [picture_pdf(rows)]})

    return pages.groupBy("doc_id").applyInPandas(run, "doc_id string, pdf binary")


def save_result(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def load_result(spark: SparkSession, path: str, sample: DataFrame | None = None) -> DataFrame:
    """A saved result, or the sample where none has been saved."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if sample is not None and not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return sample
    return spark.read.parquet(path)

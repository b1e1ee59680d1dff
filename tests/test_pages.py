import numpy as np

from quillmatch.operators import raster
from quillmatch.sources import documents


def sheet(marks, rows=6, options=4, blocks=2, gap=30):
    """A page whose bubbles are all filled lightly, the marked ones fully; the rest are outlines of their size."""
    px = np.full((rows * gap + 60, blocks * (options + 2) * gap + 60, 3), 255, np.int32)
    yy, xx = np.mgrid[: px.shape[0], : px.shape[1]]
    for b in range(blocks):
        for r in range(rows):
            for o in range(options):
                d = (xx - (40 + (b * (options + 2) + o) * gap)) ** 2 + (yy - (40 + r * gap)) ** 2
                if (b * rows + r + 1, chr(65 + o)) in marks:
                    px[d <= 100] = 0
    return px


def test_bubbles():
    marks = {(i + 1, "ABCD"[i % 4]) for i in range(12)}
    assert set(raster.bubbles(sheet(marks), 4)) == marks
    assert raster.bubbles(np.full((300, 300, 3), 255, np.int32), 4) == []


def test_gutter_and_enhance():
    gray = np.full((400, 600), 255)
    gray[::4, 20:280], gray[::4, 320:580] = 0, 0
    assert 280 <= raster.gutter(gray) <= 320
    assert raster.gutter(np.full((400, 600), 255)) == -1
    flat = np.tile(np.linspace(100, 150, 50).astype(int), (20, 1))
    assert raster.enhance(flat).min() == 0 and raster.enhance(flat).max() == 255


def test_pdf_round_trip(spark):
    jpeg = b"\xff\xd8" + bytes(50_000) + b"\xff\xd9"
    pdf = documents.picture_pdf([(600, 800, jpeg), (600, 800, jpeg)])
    assert documents.carve(pdf) == documents.carve(pdf, 2) == [jpeg, jpeg]
    # all pages or none: another count, or one stream that is no page's
    assert documents.carve(pdf, 3) is None and documents.carve(b"") is None
    assert documents.carve(documents.picture_pdf([(600, 800, jpeg), (9, 9, jpeg[:100] + jpeg[-2:])])) is None
    pages = spark.createDataFrame([("a", 2, 6, 8, jpeg), ("a", 1, 6, 8, jpeg)], "doc_id string, page_no int, w int, h int, bytes binary")
    back = documents.page_pictures(documents.picture_pdfs(pages).withColumnRenamed("pdf", "content")).collect()
    assert [(r.page_no, bytes(r.bytes)) for r in back] == [(1, jpeg), (2, jpeg)]


def test_page_counts_and_saved_results(spark, tmp_path):
    jpeg = b"\xff\xd8" + bytes(50_000) + b"\xff\xd9"
    files = spark.createDataFrame([("a", documents.picture_pdf([(1, 1, jpeg)] * 3)), ("b", b"no pictures")], "doc_id string, content binary")
    assert {r.doc_id: r.n_pages for r in documents.page_counts(files).collect()} == {"a": 3, "b": 0}
    known = spark.createDataFrame([("a", documents.picture_pdf([(1, 1, jpeg)] * 3), 4)], "doc_id string, content binary, n_pages int")
    assert documents.page_pictures(known).count() == 0
    sample = spark.createDataFrame([(0, "sample")], "no int, state string")
    assert documents.load_result(spark, str(tmp_path / "none"), sample).collect() == sample.collect()
    documents.save_result(sample.where("no > 0"), str(tmp_path / "saved"))
    assert documents.load_result(spark, str(tmp_path / "saved"), sample).count() == 0


def test_files_in(spark, tmp_path):
    for name, data in (("a.txt", b"one\ntwo"), ("b.PDF", b"%PDF"), ("c.jpg", b"x")):
        (tmp_path / name).write_bytes(data)
    assert {(r.doc_id.rsplit("/")[-1], r.kind, r.size) for r in documents.read_files(spark, str(tmp_path)).collect()} == {("a.txt", "text", 7), ("b.PDF", "pdf", 4), ("c.jpg", "image", 1)}
    assert [r.text for r in documents.read_texts(spark, str(tmp_path / "a.txt")).collect()] == ["one\ntwo"]


def test_text_layers_of_no_use_and_pages_with_hindi(spark):
    from pyspark.sql import functions as F

    from quillmatch.functions import text as X

    words = "plain words of a page " * 20
    broken = "क ख ग ा ि ी " * 30
    rows = [(0, words, 1000), (1, "too little", 1000), (2, words, 10**6), (3, words + "\ufffd", 1000), (4, broken, 1000), (5, None, 0), (6, "-- .. " * 100, 0)]
    df = spark.createDataFrame(rows, "i int, text string, size long")
    found = {r.i: (r.pictures, r.hindi) for r in df.select("i", documents.needs_pictures(F.col("text"), F.col("size")).alias("pictures"), X.has_hindi(F.col("text")).alias("hindi")).collect()}
    assert found == {0: (False, False), 1: (True, False), 2: (True, False), 3: (True, False), 4: (True, True), 5: (True, False), 6: (True, False)}

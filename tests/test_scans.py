import numpy as np

from quillmatch.operators import raster, scans


def page(seed, h=60, w=200, gap=True):
    """Lines of dark dashes in two columns, on grey paper."""
    rng = np.random.default_rng(seed)
    grey = rng.integers(190, 240, (h, w))
    for y in range(4, h - 4, 6):
        for a, b in ((8, w // 2 - 12), (w // 2 + 12, w - 10)) if gap else ((8, w - 10),):
            grey[y : y + 3, a:b] = np.where(rng.random((3, b - a)) < 0.7, 40, grey[y : y + 3, a:b])
    return grey


def rgba(grey):
    return np.dstack([grey] * 3 + [np.full_like(grey, 255)]).astype(np.uint8).tobytes()


def test_pages_are_those_of_the_kernels_of_one_page(spark):
    pages = {1: page(1), 2: page(2, 61, 240), 3: page(3, gap=False), 4: np.full((20, 90), 255), 5: np.random.default_rng(5).integers(0, 256, (7, 9)), 6: page(6, 900, 150)}
    rows = [(k, g.shape[1], g.shape[0], rgba(g), "z") for k, g in pages.items()] + [(9, None, 3, b"", "z")]
    cells = scans.grey_cells(spark.createDataFrame(rows, "page_id int, w int, h int, rgba binary, grey string")).cache()
    assert cells.count() == sum(g.size for g in pages.values())
    for k, r in {k: raster.luma(raster.pixels(g.shape[1], g.shape[0], rgba(g))) for k, g in pages.items()}.items():
        pages[k] = r
    assert {r.page_id: r.gutter for r in scans.gutters(cells).collect()} == {k: raster.gutter(g) for k, g in pages.items()}
    assert [k for k, g in pages.items() if raster.gutter(g) > 0] == [1, 2, 6]
    found = {k: np.full(g.shape, -1) for k, g in pages.items()}
    for r in scans.enhanced(cells.where("page_id < 6")).collect():
        found[r.page_id][r.y, r.x] = r.grey
    for k in (1, 2, 3, 4, 5):
        assert np.abs(found[k] - raster.enhance(pages[k]).astype(int)).max() <= 1 and (found[k] == raster.enhance(pages[k])).mean() > 0.999


def test_no_cells(spark):
    none = spark.createDataFrame([], "page_id int, y int, x int, grey int")
    assert scans.enhanced(none).count() == 0 and scans.gutters(none).count() == 0

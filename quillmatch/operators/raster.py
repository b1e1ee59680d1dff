"""Kernels over page rasters: enhancement, column gutter and filled bubbles. A page is a row (page_id, w, h, rgba)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def pixels(w: int, h: int, rgba: bytes) -> np.ndarray:
    return np.frombuffer(rgba, np.uint8).reshape(h, w, 4)[:, :, :3].astype(np.int32)


def luma(px: np.ndarray) -> np.ndarray:
    return (px @ np.array([299, 587, 114])) // 1000


def enhance(gray: np.ndarray) -> np.ndarray:
    """Stretches grey between its 2 % tails, at least 40 apart, and sharpens by 0.8 against a 4-neighbour blur."""
    flat = np.sort(gray.ravel())
    low, high = flat[int(0.02 * len(flat))], flat[min(len(flat) - 1, int(0.98 * len(flat)))]
    wide = np.clip((gray - low) * 255 / max(40, high - low), 0, 255)
    edge = np.pad(wide, 1, mode="edge")
    blur = (4 * wide + 2 * (edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:])) / 12
    return np.clip(wide + 0.8 * (wide - blur), 0, 255).astype(np.uint8)


def gutter(gray: np.ndarray) -> int:
    """x of the empty channel between two columns of print, or -1."""
    h, w = gray.shape
    rows = gray[:: max(1, h // 400)]
    ink = np.convolve((rows < 140).sum(0), np.ones(11), "same") / np.convolve(np.ones(w), np.ones(11), "same") / len(rows)
    mid = np.median(ink)
    low, high = int(0.34 * w), int(0.66 * w)
    clear = np.concatenate([[0], (ink[low:high] <= min(0.04, 0.15 * mid)).astype(int), [0]])
    begins, ends = np.flatnonzero(np.diff(clear) == 1), np.flatnonzero(np.diff(clear) == -1)
    if not len(begins) or mid == 0:
        return -1
    best = int(np.argmax(ends - begins))
    if ends[best] - begins[best] < 10:
        return -1
    x = low + (begins[best] + ends[best]) // 2
    flanks = ink[low:x].mean(), ink[x:high].mean()
    return -1 if min(flanks) < 0.25 * mid else int(x)


def components(grid: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(area, x0, y0, x1, y1) of the 4-connected regions of true cells: labels sink to the least neighbour until none moves."""
    label = np.where(grid, np.arange(grid.size).reshape(grid.shape) + 1, 0)
    while True:
        edge = np.pad(np.where(label > 0, label, grid.size + 1), 1, constant_values=grid.size + 1)
        least = np.minimum.reduce([edge[1:-1, 1:-1], edge[:-2, 1:-1], edge[2:, 1:-1], edge[1:-1, :-2], edge[1:-1, 2:]])
        new = np.where(grid, least, 0)
        new = np.where(new > 0, np.where(new.ravel()[np.maximum(new, 1) - 1] > 0, new.ravel()[np.maximum(new, 1) - 1], new), 0)
        if (new == label).all():
            break
        label = new
    ys, xs = np.nonzero(label)
    if not len(ys):
        return []
    of = pd.DataFrame({"l": label[ys, xs], "x": xs, "y": ys}).groupby("l").agg(a=("x", "size"), x0=("x", "min"), y0=("y", "min"), x1=("x", "max"), y1=("y", "max"))
    return [tuple(r) for r in of.itertuples(index=False)]


def axis(values: np.ndarray, gap: float) -> np.ndarray:
    """Means of the clusters of values no further than gap apart."""
    values = np.sort(values)
    return np.array([c.mean() for c in np.split(values, np.flatnonzero(np.diff(values) > gap) + 1)]) if len(values) else values


def bubbles(px: np.ndarray, options: int) -> list[tuple[int, str]]:
    """(number, letter) of the filled bubbles of a flat scan; nothing where the sheet's lattice is not plain."""
    h, w, _ = px.shape
    f = int(np.clip(round(w / 380), 3, 8))
    dark = (px.max(2)[: h // f * f, : w // f * f] < 110).reshape(h // f, f, w // f, f).mean((1, 3))
    shapes = []
    for area, x0, y0, x1, y1 in components(dark > 0):
        bw, bh = x1 - x0 + 1, y1 - y0 + 1
        if 0.7 <= bw / bh <= 1.4 and area / (bw * bh) >= 0.5 and (bw + bh) / 2 >= 3:
            shapes.append(((x0 + x1) / 2, (y0 + y1) / 2, (bw + bh) / 2))
    if len(shapes) < 2 * options:
        return []
    sizes = np.array([s[2] for s in shapes])
    values, counts = np.unique(np.round(sizes), return_counts=True)
    d = values[np.argmax(counts)]
    disks = np.array([s for s in shapes if 0.7 * d <= s[2] <= 1.4 * d])
    if len(disks) < 2 * options:
        return []
    columns, rows = axis(disks[:, 0], max(1, 0.5 * d)), axis(disks[:, 1], max(1, 0.5 * d))
    if len(columns) < options or len(rows) < 3:
        return []
    gaps = np.diff(columns)
    pitch = np.sort(gaps)[len(gaps) // 4]
    blocks, k = [], 0
    while k + options <= len(columns):
        inside = gaps[k : k + options - 1]
        if inside.max(initial=0) <= 1.25 * pitch and inside.max(initial=0) <= 1.3 * inside.min(initial=np.inf):
            blocks.append(columns[k : k + options])
            k += options
        else:
            k += 1
    yy, xx = np.mgrid[: dark.shape[0], : dark.shape[1]]
    out = []
    for b, block in enumerate(blocks):
        for r, y in enumerate(rows):
            fill = [dark[(xx - x) ** 2 + (yy - y) ** 2 <= max(1, 0.34 * d) ** 2].mean() for x in block]
            if max(fill) >= 0.45:
                out.append((b * len(rows) + r + 1, chr(65 + int(np.argmax(fill)))))
    return out


def read_sheets(pages: DataFrame, options: int = 4) -> DataFrame:
    """pages(page_id, w, h, rgba) to (page_id, no, answer)."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                yield pd.DataFrame([(r.page_id, *x) for x in bubbles(pixels(r.w, r.h, r.rgba), options)], columns=["page_id", "no", "answer"])

    return pages.select("page_id", "w", "h", "rgba").mapInPandas(run, f"page_id {kind}, no int, answer string")

"""Grid lines from pixels as rows, and morphology and components of masks: one row a page, whole pages in one Arrow batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far a pixel may lie from a crossing of two lines, in each direction.
REACH = 2


def line_projection(pixels: DataFrame, axis: str, least: float, *, key: str = "page_id") -> DataFrame:
    """(key, pos, share): columns (axis x) or rows (axis y) of which at least ``least`` is ink (``on``)."""
    out = pixels.groupBy(key, F.col(axis).alias("pos")).agg(F.avg(F.col("on").cast("double")).alias("share"))
    return out.where(F.col("share") >= least)


def intersecting(lines: DataFrame, others: DataFrame, ink: DataFrame, *, vertical: bool, key: str = "page_id") -> DataFrame:
    """Lines (key, pos) that cross at least max(3, 55 %) of the other direction's lines.

    Two lines cross where some ink (key, x, y) lies within two pixels of their meeting point. Ink goes to the points
    near it, so the join has exact keys.
    """
    need = others.groupBy(key).agg(F.greatest(F.lit(3), F.floor(F.count(F.lit(1)) * F.lit(0.55))).alias("need"))
    steps = F.array(*[F.lit(d) for d in range(-REACH, REACH + 1)])
    along, across = ("x", "y") if vertical else ("y", "x")
    near = ink.select(key, F.explode(F.transform(steps, lambda d: F.col(along) + d)).alias("pos"), F.col(across).alias("_a"))
    near = near.join(lines.select(key, "pos").distinct(), [key, "pos"])
    near = near.select(key, "pos", F.explode(F.transform(steps, lambda d: F.col("_a") + d)).alias("other"))
    met = near.join(others.select(key, F.col("pos").alias("other")).distinct(), [key, "other"]).groupBy(key, "pos").agg(F.count_distinct("other").alias("n"))
    return met.join(need, key).where("n >= need").select(key, "pos")


def grid_lines(verticals: DataFrame, horizontals: DataFrame, ink: DataFrame, *, key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """Vertical lines that cross enough horizontal ones, then the horizontal ones that cross enough of those left."""
    v = intersecting(verticals, horizontals, ink, vertical=True, key=key)
    return v, intersecting(horizontals, v, ink, vertical=False, key=key)


def continuous_rows(rows: DataFrame, verticals: DataFrame, ink: DataFrame, *, key: str = "page_id", least: float = 0.85) -> DataFrame:
    """Rows (key, pos) that are inked for 85 % between the first and the last of two or more vertical lines."""
    span = verticals.groupBy(key).agg(F.min("pos").alias("_a"), F.max("pos").alias("_b"), F.count_distinct("pos").alias("_n")).where("_n >= 2")
    dots = ink.select(key, "x", F.col("y").alias("pos")).distinct()
    found = rows.join(span, key).join(dots, [key, "pos"]).where("x BETWEEN _a AND _b").groupBy(key, "pos", "_a", "_b").agg(F.count(F.lit(1)).alias("_ink"))
    return found.where(F.col("_ink") / (F.col("_b") - F.col("_a") + 1) >= least).select(key, "pos")


# ---------------------------------------------------------------- masks


def shifted(mask: np.ndarray, size: int, grow: bool) -> np.ndarray:
    """Dilation (``grow``) or erosion with a square; outside the page counts as ink for erosion and as none for dilation."""
    before = size // 2 if grow else (size - 1) // 2
    pad = np.pad(mask, ((before, size - 1 - before),) * 2, constant_values=not grow)
    windows = np.lib.stride_tricks.sliding_window_view(pad, (size, size))
    return windows.any((2, 3)) if grow else windows.all((2, 3))


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    return shifted(shifted(mask, size, False), size, True)


def closed(mask: np.ndarray, size: int) -> np.ndarray:
    return shifted(shifted(mask, size, True), size, False)


def components_of(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, area) of the mask's components, neighbours touching at corners, too; by their first pixel in reading order.

    Runs of ink in a row are joined with those they touch in the row above.
    """
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    head = list(range(len(row)))

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        above, i = first[y - 1], first[y]
        while above < first[y] and i < first[y + 1]:
            if start[above] <= stop[i] and start[i] <= stop[above]:
                a, b = find(above), find(i)
                head[max(a, b)] = min(a, b)
            if stop[above] < stop[i]:
                above += 1
            else:
                i += 1
    groups: dict[int, list[int]] = {}
    for i in range(len(row)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for _, runs in sorted(groups.items()):
        x, y = start[runs].min(), row[runs].min()
        out.append((int(x), int(y), int(stop[runs].max() - x), int(row[runs].max() + 1 - y), int((stop[runs] - start[runs]).sum())))
    return out


def mask_components(masks: DataFrame, *, key: str = "page_id", open_size: int = 0, close_size: int = 0) -> DataFrame:
    """(key, ordinal, x, y, w, h, area, page_area) of the components of each page's mask (width, on), opened or closed before."""
    kind = dict(masks.dtypes)[key]

    def run(batches):
        for pdf in batches:
            rows = []
            for k, width, on in zip(pdf[key], pdf["width"], pdf["on"], strict=True):
                m = np.asarray(on, bool).reshape(-1, int(width)) if on is not None and width == width and width and len(on) else np.zeros((0, 0), bool)
                if m.size and open_size:
                    m = opened(m, open_size)
                if m.size and close_size:
                    m = closed(m, close_size)
                rows += [(k, i, *c, m.size) for i, c in enumerate(components_of(m) if m.size else [])]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "x", "y", "w", "h", "area", "page_area"])

    return masks.select(key, "width", "on").mapInPandas(run, f"{key} {kind}, ordinal int, x int, y int, w int, h int, area int, page_area int")

"""Box arithmetic on x, y, w, h in page units, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in "xywh")


def bbox_error(a, b) -> Column:
    """Largest absolute difference of coordinates; 1 where the second box is missing."""
    return F.coalesce(F.greatest(*[F.abs(p - q) for p, q in zip(a, b, strict=True)]), F.lit(1.0))


def intersection(a, b) -> Column:
    wide = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def area(a) -> Column:
    return F.greatest(F.lit(0.0), a[2]) * F.greatest(F.lit(0.0), a[3])


def overlap_of_smaller(a, b) -> Column:
    """Intersection over the smaller area; 0 if that is 0."""
    return F.coalesce(F.try_divide(intersection(a, b), F.nullif(F.least(area(a), area(b)), F.lit(0.0))), F.lit(0.0))


def iou(a, b) -> Column:
    common = intersection(a, b)
    return F.coalesce(F.try_divide(common, F.nullif(area(a) + area(b) - common, F.lit(0.0))), F.lit(0.0))


def relation_error(kind, s, t) -> Column:
    """How far two boxes are from a stated relation; 1 where a box is missing or the relation is unknown."""
    right = lambda b: b[0] + b[2]
    low = lambda b: b[1] + b[3]
    zero = F.lit(0.0)
    outside = F.greatest(zero, t[0] - s[0], t[1] - s[1], right(s) - right(t), low(s) - low(t))
    # Which of the two comes first does not matter.
    beside = F.least(F.abs(right(s) - t[0]), F.abs(right(t) - s[0]))
    stacked = F.least(F.abs(low(s) - t[1]), F.abs(low(t) - s[1]))
    formulas = {
        "align_left": F.abs(s[0] - t[0]),
        "align_right": F.abs(right(s) - right(t)),
        "align_top": F.abs(s[1] - t[1]),
        "align_bottom": F.abs(low(s) - low(t)),
        "align_center_x": F.abs(s[0] + s[2] / 2 - t[0] - t[2] / 2),
        "align_center_y": F.abs(s[1] + s[3] / 2 - t[1] - t[3] / 2),
        "equal_width": F.abs(s[2] - t[2]),
        "equal_height": F.abs(s[3] - t[3]),
        "adjacent_x": beside,
        "adjacent_y": stacked,
        "gap_x": beside,
        "gap_y": stacked,
        "inside": outside,
    }
    out = F.lit(1.0)
    for name, formula in formulas.items():
        out = F.when(kind == name, formula).otherwise(out)
    return F.when(s[0].isNull() | t[0].isNull(), 1.0).otherwise(F.coalesce(out, F.lit(1.0)))


RELATIONS = ("align_left", "align_right", "align_top", "align_bottom", "align_center_x", "align_center_y", "equal_width", "equal_height", "adjacent_x", "adjacent_y", "gap_x", "gap_y", "inside")


def crop_pixels(a, width, height) -> Column:
    """Integer pixel box, banker's rounding, clamped to the raster; it may be empty."""
    left = F.greatest(F.lit(0), F.bround(a[0] * width).cast("int"))
    top = F.greatest(F.lit(0), F.bround(a[1] * height).cast("int"))
    right = F.least(width.cast("int"), F.bround((a[0] + a[2]) * width).cast("int"))
    bottom = F.least(height.cast("int"), F.bround((a[1] + a[3]) * height).cast("int"))
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def padded(a, width, height, share_x: float = 0.06, share_y: float = 0.12, least: int = 2):
    """A pixel box widened by a share of itself, clamped to the raster."""
    px = F.greatest(F.lit(float(least)), a[2] * share_x)
    py = F.greatest(F.lit(float(least)), a[3] * share_y)
    x, y = F.greatest(F.lit(0.0), a[0] - px), F.greatest(F.lit(0.0), a[1] - py)
    return x, y, F.least(width, a[0] + a[2] + px) - x, F.least(height, a[1] + a[3] + py) - y


def inset(a, share_x: float = 0.04, share_y: float = 0.08, least: int = 3):
    """A cell's box narrowed by a share of itself."""
    px = F.greatest(F.lit(float(least)), a[2] * share_x)
    py = F.greatest(F.lit(float(least)), a[3] * share_y)
    return a[0] + px, a[1] + py, F.greatest(F.lit(1.0), a[2] - 2 * px), F.greatest(F.lit(1.0), a[3] - 2 * py)


def page_mm(width, height, long_side: float = 297.0) -> Column:
    """Page size in mm with the longer side fixed; landscape if it is as wide as high."""
    wide = width >= height
    return F.struct(
        F.when(wide, F.lit(long_side)).otherwise(long_side * width / height).alias("w_mm"),
        F.when(wide, long_side * height / width).otherwise(F.lit(long_side)).alias("h_mm"),
        F.when(wide, "landscape").otherwise("portrait").alias("orientation"),
    )


def units(mm) -> Column:
    """A length in mm in the units of the writers: hundredths of mm, twips, EMU, half-points."""
    return F.struct(F.bround(mm * 100).cast("long").alias("mm100"), F.bround(mm * 1440 / 25.4).cast("long").alias("twips"), F.bround(mm * 36000).cast("long").alias("emu"), F.bround(mm * 144 / 25.4).cast("long").alias("half_points"))


def quantize(c, k: int) -> Column:
    """The centre of a channel's bucket of ``k``, within 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c / k).cast("int") * k + k // 2))


def hamming(a, b) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def color_delta(a, b) -> Column:
    """(l1, widest): the sum and the largest of the channels' absolute differences of two (r, g, b)."""
    parts = [F.abs(a[c] - b[c]) for c in "rgb"]
    return F.struct((parts[0] + parts[1] + parts[2]).alias("l1"), F.greatest(*parts).alias("widest"))


def aspect_error(width, height, reference_width, reference_height) -> Column:
    """How far a page's aspect is from its reference's, as a share."""
    return F.abs((width / height) / (reference_width / reference_height) - 1)


def contrast(hi, lo) -> Column:
    return (hi + 0.05) / (lo + 0.05)

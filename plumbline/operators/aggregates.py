"""Aggregates over a scene: coverage, areas, tiling, extrema, and statistics of rasters held as arrays of luma."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extrema(errors: DataFrame, *, key: str = "scene_id", threshold: float = 0.025) -> DataFrame:
    """The largest error of each scene and whether it is within the threshold, inclusive."""
    out = errors.groupBy(key).agg(F.coalesce(F.max("max_error"), F.lit(0.0)).alias("max_error"))
    return out.withColumn("passed", F.col("max_error") <= threshold)


def ratio(part, whole) -> Column:
    """part / whole, at most 1; 1 where the whole is 0."""
    return F.least(F.lit(1.0), F.coalesce(F.try_divide(part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0))), F.lit(1.0)))


def ordered(order, *values) -> Column:
    """A group's rows of ``order`` and ``values``, by ``order``, for ``ordered_sum``."""
    return F.array_sort(F.collect_list(F.struct(*order, *values)))


def ordered_sum(rows, value) -> Column:
    """The sum of ``value`` of each row, added one by one in the rows' order; nulls count as 0.

    Doubles added in another order may differ in the last bit, which decides where a share meets its threshold; a plain sum
    adds rows as they arrive, and after a shuffle they arrive anyhow.
    """
    return F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + F.coalesce(value(r), F.lit(0.0)))


def union_area(boxes: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """Exact area covered by each scene's boxes inside the unit square: vertical slabs of merged intervals."""
    b = boxes.select(key, F.greatest(F.lit(0.0), "x").alias("x0"), F.greatest(F.lit(0.0), "y").alias("y0"), F.least(F.lit(1.0), F.col("x") + F.col("w")).alias("x1"), F.least(F.lit(1.0), F.col("y") + F.col("h")).alias("y1")).where("x1 > x0 AND y1 > y0")
    edges = b.select(key, F.explode(F.array("x0", "x1")).alias("left")).distinct()
    slabs = edges.withColumn("right", F.lead("left").over(Window.partitionBy(key).orderBy("left"))).where("right IS NOT NULL")
    inside = slabs.join(b, key).where("x0 <= (left + right) / 2 AND x1 >= (left + right) / 2")
    slab = Window.partitionBy(key, "left").orderBy("y0", "y1")
    reach = F.max("y1").over(slab.rowsBetween(Window.unboundedPreceding, -1))
    run = inside.withColumn("_new", F.when(reach.isNull() | (F.col("y0") > reach), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(slab.rowsBetween(Window.unboundedPreceding, 0)))
    islands = run.groupBy(key, "left", "right", "_island").agg((F.max("y1") - F.min("y0")).alias("length"))
    area = islands.groupBy(key).agg(F.least(F.lit(1.0), F.sum(F.col("length") * (F.col("right") - F.col("left")))).alias("area"))
    return boxes.select(key).distinct().join(area, key, "left").withColumn("area", F.coalesce("area", F.lit(0.0)))


def tiling(boxes: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """(key, tiled): whether at least four boxes cover much of the page, and their envelope, with little overlap."""
    s = boxes.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        (F.greatest(F.lit(0.0), F.max(F.col("x") + F.col("w")) - F.min("x")) * F.greatest(F.lit(0.0), F.max(F.col("y") + F.col("h")) - F.min("y"))).alias("envelope"),
        F.sum(F.greatest(F.lit(0.0), "w") * F.greatest(F.lit(0.0), "h")).alias("total"),
    )
    out = s.join(union_area(boxes, key=key), key)
    good = "n >= 4 AND area >= 0.5D AND envelope >= 0.55D AND coalesce(try_divide(area, envelope), 0D) >= 0.9D AND coalesce(try_divide(total, area), 99D) <= 1.15D"
    return out.select(key, F.expr(good).alias("tiled"), "area")


def unjustified(images: DataFrame, flags: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """Counts and areas of images without a justification; a tiled, embedded or flattened page justifies none."""
    i = images.join(flags, key).where("any_flag OR justification IS NULL")
    u = i.groupBy(key).agg(F.count(F.lit(1)).alias("unjustified"), F.max(F.col("w") * F.col("h")).alias("largest"))
    return u.join(union_area(i, key=key).withColumnRenamed("area", "total"), key)


# ---------------------------------------------------------------- rasters as arrays of luma


def nonwhite(luma, limit: int = 245) -> Column:
    return F.size(F.filter(luma, lambda v: v < limit)) / F.size(luma)


def percentile(luma, share: float) -> Column:
    """Nearest rank with banker's rounding; 255 for none."""
    at = F.bround((F.size(luma) - 1) * F.lit(share)).cast("int")
    return F.coalesce(F.get(F.array_sort(luma), at), F.lit(255))


def upper_median(values) -> Column:
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def luminance(v) -> Column:
    """Relative luminance of a grey level."""
    s = v / F.lit(255.0)
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def contrast(luma, low: float = 0.002, high: float = 0.998) -> Column:
    """Ratio of the light and dark percentiles' luminances."""
    return (luminance(percentile(luma, high)) + 0.05) / (luminance(percentile(luma, low)) + 0.05)


def mode_bucket(luma, k: int = 16) -> Column:
    """The centre of the commonest bucket; the one seen first wins a tie."""
    b = F.transform(luma, lambda v: F.floor(v / k).cast("int") * k + k // 2)
    scored = F.transform(F.array_distinct(b), lambda x: F.struct((-F.size(F.filter(b, lambda y: y == x))).alias("n"), F.array_position(b, x).alias("p"), x.alias("v")))
    return F.array_min(scored)["v"]


def _sum(values) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def mean(values) -> Column:
    return _sum(values) / F.size(values)


def palette_delta(a, b) -> Column:
    """Difference of mean grey, as the mean of three equal channels."""
    return F.abs(mean(a) - mean(b)) / 255


def ssim(a, b) -> Column:
    """One global SSIM from population moments; values are scaled to 0..1."""
    x, y = F.transform(a, lambda v: v / 255.0), F.transform(b, lambda v: v / 255.0)
    mx, my = mean(x), mean(y)
    vx = mean(F.transform(x, lambda v: v * v)) - mx * mx
    vy = mean(F.transform(y, lambda v: v * v)) - my * my
    cov = mean(F.zip_with(x, y, lambda p, q: p * q)) - mx * my
    return ((2 * mx * my + 1e-4) * (2 * cov + 9e-4)) / ((mx * mx + my * my + 1e-4) * (vx + vy + 9e-4))


def edges(luma, width: int) -> Column:
    """Eight times each pixel less its neighbours, within 0..255; the outermost pixels stay as they are."""
    n = F.size(luma)

    def at(i):
        inner = (i % width > 0) & (i % width < width - 1) & (i >= width) & (i < n - width)
        around = [F.get(luma, i + d) for d in (-width - 1, -width, -width + 1, -1, 1, width - 1, width, width + 1)]
        total = around[0]
        for v in around[1:]:
            total = total + v
        return F.when(inner, F.greatest(F.lit(0), F.least(F.lit(255), F.get(luma, i) * 8 - total))).otherwise(F.get(luma, i))

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def edge_f1(a, b, width: int = 8, limit: int = 24) -> Column:
    """F1 of the edge masks; 1 if both are empty, 0 if one is."""
    pairs = F.zip_with(edges(a, width), edges(b, width), lambda p, q: F.struct((p > limit).alias("a"), (q > limit).alias("b")))

    def score(p):
        both, either = F.size(F.filter(p, lambda v: v["a"] & v["b"])), F.size(F.filter(p, lambda v: v["a"])) + F.size(F.filter(p, lambda v: v["b"]))
        return F.when(either == 0, 1.0).otherwise(2.0 * both / either)

    return F.get(F.transform(F.array(pairs), score), F.lit(0))


def edge_density(luma, width: int = 8, limit: int = 35, trim: int = 2) -> Column:
    """Share of edge pixels, without the outer ``trim`` where there is more than that; 0 below two pixels a side."""
    rows = F.floor(F.size(luma) / width).cast("int")
    cut = (F.lit(width) > 2 * trim) & (rows > 2 * trim)
    inside = lambda i: ~cut | ((i % width >= trim) & (i % width < width - trim) & (i >= trim * width) & (i < (rows - trim) * width))
    kept = F.filter(F.transform(edges(luma, width), lambda v, i: F.when(inside(i), v)), lambda v: v.isNotNull())
    return F.when((rows < 2) | F.lit(width < 2), 0.0).otherwise(F.get(F.transform(F.array(kept), lambda k: F.size(F.filter(k, lambda v: v > limit)) / F.size(k)), F.lit(0)))


def dhash(luma, width: int = 9) -> Column:
    """One bit for each pair of neighbours in a row that falls, row by row, most significant first; 64 of nine by eight pixels."""
    pairs = F.filter(F.sequence(F.lit(0), F.size(luma) - 2), lambda i: i % width != width - 1)
    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, i: F.call_function("shiftleft", acc, F.lit(1)).bitwiseOR(F.when(F.get(luma, i) > F.get(luma, i + 1), 1).otherwise(0).cast("bigint")))


def border_coverage(luma, width: int = 8, limit: int = 225) -> Column:
    """Share of dark pixels in four bands of 1.5 % of the short side, two pixels at least; corners count in both of theirs.

    0 where a side has fewer than three pixels.
    """
    rows = F.floor(F.size(luma) / width).cast("int")
    band = F.greatest(F.lit(2), F.bround(F.least(F.lit(width), rows) * F.lit(0.015)).cast("int"))
    times = lambda i: sum(c.cast("int") for c in (i < band * width, i >= (rows - band) * width, i % width < band, i % width >= width - band))
    counted = F.transform(luma, lambda v, i: F.struct(times(i).alias("n"), (v < limit).cast("int").alias("dark")))
    total = lambda f: F.aggregate(counted, F.lit(0), lambda acc, p: acc + f(p))
    share = total(lambda p: p["n"] * p["dark"]) / total(lambda p: p["n"])
    return F.when((rows < 3) | F.lit(width < 3), 0.0).otherwise(share)


def text_color(luma) -> Column:
    """Dark ink on a background whose 65 % rank of grey is light, else white."""
    at = F.floor((F.size(luma) - 1) * F.lit(0.65)).cast("int")
    return F.when(F.get(F.array_sort(luma), at) >= 145, "#111111").otherwise("#ffffff")


# ---------------------------------------------------------------- rasters as arrays of (r, g, b)


def is_artwork(pixels) -> Column:
    """Whether an image is colourful: 8 % of its pixels or more are, in three or more buckets of 24."""
    least, most = (lambda p: F.least(p["r"], p["g"], p["b"])), (lambda p: F.greatest(p["r"], p["g"], p["b"]))
    colorful = F.filter(pixels, lambda p: (most(p) - least(p) >= 28) & (least(p) < 245))

    def judge(found):
        buckets = F.array_distinct(F.transform(found, lambda p: F.struct(*[F.floor(p[c] / 24).alias(c) for c in "rgb"])))
        return (F.size(found) >= F.size(pixels) * F.lit(0.08)) & (F.size(buckets) >= 3)

    return F.when(F.size(pixels) > 0, F.get(F.transform(F.array(colorful), judge), F.lit(0))).otherwise(False)


def dominant(pixels, k: int = 16) -> Column:
    """(color, share) of the commonest bucket of ``k``; of several the least (r, g, b)."""
    b = F.transform(pixels, lambda p: F.struct(*[F.least(F.lit(255), F.floor(p[c] / k).cast("int") * k + k // 2).alias(c) for c in "rgb"]))
    scored = F.transform(F.array_distinct(b), lambda x: F.struct((-F.size(F.filter(b, lambda y: y == x))).alias("n"), x.alias("color")))
    return F.get(F.transform(F.array(F.array_min(scored)), lambda m: F.struct(m["color"].alias("color"), (-m["n"] / F.size(pixels)).alias("share"))), F.lit(0))


def color_histogram(pixels: DataFrame, *, key: str = "scene_id", least: float = 0.001, apart: int = 10) -> DataFrame:
    """(key, r, g, b, share): colours in buckets of 8 that are common enough and stand off the background (bg_r, bg_g, bg_b)."""
    q = pixels.select(key, *[F.least(F.lit(255), F.floor(F.col(c) / 8).cast("int") * 8 + 4).alias(c) for c in "rgb"], "bg_r", "bg_g", "bg_b")
    n = pixels.groupBy(key).agg(F.count(F.lit(1)).alias("_of"))
    out = q.groupBy(key, "r", "g", "b").agg(F.count(F.lit(1)).alias("_n"), *[F.first(f"bg_{c}").alias(f"bg_{c}") for c in "rgb"]).join(n, key)
    off = F.greatest(*[F.abs(F.col(c) - F.col(f"bg_{c}")) for c in "rgb"])
    return out.withColumn("share", F.col("_n") / F.col("_of")).where((F.col("share") >= least) & (off >= apart)).select(key, "r", "g", "b", "share")


def page_extrema(measures: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """The worst of each scene's (alignment_error, relation_error, border_coverage, contrast); 0, 0, 1 and 21 for none."""
    worst = {"alignment_error": (F.max, 0.0), "relation_error": (F.max, 0.0), "border_coverage": (F.min, 1.0), "contrast": (F.min, 21.0)}
    return measures.groupBy(key).agg(*[F.coalesce(f(c), F.lit(v)).alias(c) for c, (f, v) in worst.items()])

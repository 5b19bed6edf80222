"""Filters, projections and unions over recovered shapes, lines and components; built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t

# Kinds whose strokes are borders, kinds that are panels, the default stroke colour.
STROKED = ("grid", "rectangle", "rounded_rectangle", "ellipse")
PANELS = ("rectangle", "rounded_rectangle")
DEFAULT_STROKE = (96, 96, 96)


# ---------------------------------------------------------------- filters


def within_margin(lines: DataFrame, size, *, at: str = "pos", margin: float = 0.01) -> DataFrame:
    """Lines that do not lie in the outermost share of the page."""
    return lines.where(F.col(at).between(size * margin, size * (1 - margin)))


def grid_words_only(words: DataFrame) -> DataFrame:
    """Without the words that pass 3 found outside a grid cell (``cell``, null outside)."""
    return words.where(~(F.col("pass").eqNullSafe(F.lit(3)) & F.col("cell").isNull()))


def solid_components(components: DataFrame) -> DataFrame:
    """Components (w, h, area in pixels, page_area) of a plausible size that fill most of their box."""
    box = F.col("w") * F.col("h")
    return components.where((F.col("w") >= 18) & (F.col("h") >= 10) & (box / F.col("page_area") <= 0.12) & (F.col("area") / F.col("page_area") >= 0.00045) & (F.col("area") / F.greatest(F.lit(1), box) >= 0.62))


def graphic_components(components: DataFrame) -> DataFrame:
    """Components that may be artwork: of some size and at most 11 % of the page."""
    share = F.col("w") * F.col("h") / F.col("page_area")
    return components.where(share.between(0.00045, 0.11) & (F.col("w") >= 10) & (F.col("h") >= 10))


def dark_panels(panels: DataFrame, width, height) -> DataFrame:
    """Wide dark rectangles that may hold light text, with the least confidence that a word on them needs."""
    rgb = t.hex_to_rgb(F.col("fill"))
    mean = (rgb["r"] + rgb["g"] + rgb["b"]) / 3
    aspect = F.col("w") * width / F.greatest(F.col("h") * height, F.lit(1.0))
    px = g.crop_pixels(g.box(), F.lit(1.0) * width, F.lit(1.0) * height)
    kept = panels.where(F.col("type").isin(*PANELS) & (mean <= 90) & (aspect >= 2)).withColumns({"aspect": aspect, "_px": px})
    kept = kept.where((F.col("_px.right") - F.col("_px.left") >= 10) & (F.col("_px.bottom") - F.col("_px.top") >= 10)).drop("_px")
    return kept.withColumn("min_confidence", F.when((F.col("aspect") >= 3) & (F.col("w") * F.col("h") >= 0.02), 10).otherwise(20))


def is_flat_shape(dominant_share, density, background_delta):
    """One colour fills most of the component, the component most of its box, and it stands off the background."""
    return (dominant_share >= 0.55) & (density >= 0.55) & (background_delta >= 10)


def stroked(nodes: DataFrame) -> DataFrame:
    """Nodes whose stroke is a visible border."""
    return nodes.where(F.col("type").isin(*STROKED) & (F.coalesce("stroke", F.lit("")) != "") & (F.coalesce("stroke_width", F.lit(0.0)) > 0))


def group_gate(candidates: DataFrame, *, key: str = "scene_id", color: str = "color") -> DataFrame:
    """Candidates of the colours that have two or more, or one that overlaps text (``overlaps``)."""
    w = Window.partitionBy(key, color)
    return candidates.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_any", F.bool_or("overlaps").over(w)).where("_n >= 2 OR _any").drop("_n", "_any")


def family_floor(shapes: DataFrame, width, height, *, key: str = "scene_id") -> DataFrame:
    """Shapes (x, y, w, h, support, mean) that belong to a large enough family, or are dark panels.

    The floor is 30 % of the largest support among shapes brighter than 90, and at least three.
    """
    most = shapes.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("mean") > 90, F.col("support"))), F.lit(0)).alias("_most"))
    area = F.col("w") * F.col("h")
    floor = F.greatest(F.lit(3), F.ceil(F.col("_most") * F.lit(0.30) - 1e-9))
    aspect = F.col("w") * width / F.greatest(F.col("h") * height, F.lit(1.0))
    keep = ((area >= 0.0015) & (F.col("h") > 0.025) & (F.col("support") >= floor)) | ((F.col("mean") <= 90) & (aspect >= 2) & (area >= 0.004))
    return shapes.join(most, key).where(keep).drop("_most")


# ---------------------------------------------------------------- projections


def line_as_rect(nodes: DataFrame) -> DataFrame:
    """A line is drawn as a rectangle filled with its stroke."""
    line = F.col("type") == "line"
    return nodes.withColumns({"fill": F.when(line, F.col("stroke")).otherwise(F.col("fill")), "stroke": F.when(~line, F.col("stroke")), "stroke_width": F.when(line, 0.0).otherwise(F.col("stroke_width"))})


def weight_of(ink_height, page_height):
    """600 for text of 3.5 % of the page height or more, else 400."""
    return F.when(ink_height >= page_height * F.lit(0.035), 600).otherwise(400)


def is_bold(weight):
    return weight >= 600


def draw_style(fill, stroke, stroke_width, opacity):
    """What a writer sets: no fill or line where there is none, line width in hundredths of mm, transparency in percent."""
    filled, lined = F.coalesce(fill, F.lit("")) != "", (F.coalesce(stroke, F.lit("")) != "") & (F.coalesce(stroke_width, F.lit(0.0)) > 0)
    return F.struct(
        F.when(filled, "SOLID").otherwise("NONE").alias("fill_style"),
        F.when(filled, F.lower(fill)).alias("fill_color"),
        F.when(lined, "SOLID").otherwise("NONE").alias("line_style"),
        F.when(lined, F.lower(stroke)).alias("line_color"),
        F.when(lined, F.bround(stroke_width * F.lit(35.2778)).cast("int")).alias("line_width"),
        F.bround((1 - F.coalesce(opacity, F.lit(1.0))) * 100).cast("int").alias("transparency"),
    )


def recovered(shapes: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """Shapes of a page (index, name, shape_type, position and size, page size) as objects with normalised boxes.

    Of two geometries the first that is there counts; a shape without a name is called by its index.
    """
    c = F.col
    x, y = F.coalesce(c("x"), c("anchor_x")), F.coalesce(c("y"), c("anchor_y"))
    w, h = F.coalesce(c("w"), c("frame_w")), F.coalesce(c("h"), c("frame_h"))
    name = F.coalesce(F.nullif(c("name"), F.lit("")), F.concat(F.lit("shape-"), c("index").cast("string")))
    return shapes.select(key, F.col("index").alias("ordinal"), name.alias("id"), F.coalesce("shape_type", F.lit("unknown")).alias("shape_type"), (x / c("page_width")).alias("x"), (y / c("page_height")).alias("y"), (w / c("page_width")).alias("w"), (h / c("page_height")).alias("h"))


def redactions(nodes: DataFrame, width, height, *, key: str = "scene_id") -> DataFrame:
    """(key, left, top, right, bottom): pixel boxes to paint over, of all texts and shapes, wider by 0.4 % of the short side."""
    pad = F.greatest(F.lit(2), F.bround(F.least(width, height) * F.lit(0.004)).cast("int"))
    boxed = nodes.where("type <> 'group' AND type <> 'image'").select(key, g.crop_pixels(g.box(), width, height).alias("b"))
    return boxed.select(
        key, F.greatest(F.lit(0), F.col("b.left") - pad).alias("left"), F.greatest(F.lit(0), F.col("b.top") - pad).alias("top"),
        F.least(width.cast("int"), F.col("b.right") + pad).alias("right"), F.least(height.cast("int"), F.col("b.bottom") + pad).alias("bottom"),
    ).distinct()


# ---------------------------------------------------------------- unions and choices


def union_nodes(*parts: DataFrame, key: str = "scene_id") -> DataFrame:
    """The parts' nodes one after the other, numbered anew in each scene; columns that a part lacks are null."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    order = F.row_number().over(Window.partitionBy(key).orderBy("_part", "ordinal")) - 1
    return out.withColumn("ordinal", order).drop("_part")


def prepend(nodes: DataFrame, first: DataFrame, *, key: str = "scene_id", drop_images: bool = False) -> DataFrame:
    """``first`` (a background or texture) before the nodes of its scene; a texture replaces all other images there."""
    rest = nodes
    if drop_images:
        rest = nodes.join(first.select(key).distinct().withColumn("_has", F.lit(True)), key, "left").where("NOT (coalesce(_has, false) AND type = 'image')").drop("_has")
    return first.withColumn("ordinal", F.lit(-1)).unionByName(rest, allowMissingColumns=True)


def best_panel(texts: DataFrame, components: DataFrame, *, key: str = "scene_id", least: float = 0.45) -> DataFrame:
    """For each text the component that it shares most area with, the first of several, if that is 45 % of the text."""
    c = components.select(key, F.col("ordinal").alias("component"), *[F.col(v).alias(f"c_{v}") for v in "xywh"])
    both = texts.select(key, "id", *"xywh").join(c, key).withColumn("_shared", g.intersection(g.box(), g.box("c_")))
    best = both.groupBy(key, "id").agg(F.max(F.struct("_shared", (-F.col("component")).alias("c"), g.area(g.box()).alias("area"))).alias("b"))
    return best.where(F.col("b._shared") >= F.col("b.area") * least).select(key, "id", (-F.col("b.c")).alias("component"), F.col("b._shared").alias("shared"))


def panel_text(readings: DataFrame, *, key: str = "panel_id") -> DataFrame:
    """For each panel the reading (ordinal, text, conf) of highest mean confidence plus 1.5 a character, at most 30; the first of several."""
    score = F.col("conf") + F.least(F.lit(30.0), F.length("text") * F.lit(1.5))
    best = readings.groupBy(key).agg(F.max(F.struct(score.alias("score"), (-F.col("ordinal")).alias("o"), "text")).alias("b"))
    return best.select(key, F.col("b.text").alias("text"), F.col("b.score").alias("score"))

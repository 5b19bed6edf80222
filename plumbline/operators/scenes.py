"""Scene validation: every broken rule is a row; a scene's error is its first in rule order. Valid scenes have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Version, node kinds, relation kinds, text directions and alignments, raster justifications, error codes.
VERSION = "scene-graph.v1"
NODE_TYPES = ("group", "text", "rectangle", "rounded_rectangle", "ellipse", "line", "polygon", "grid", "image")
DIRECTIONS = ("ltr", "rtl", "mixed")
ALIGNMENTS = ("left", "right", "center", "justify")
JUSTIFICATIONS = ("source_artwork", "source_illustration", "source_logo", "source_photo", "source_texture")
ORIENTATIONS = ("landscape", "portrait")
TOLERANCE = 1.000001
#: Where errors of a scene stand that belong to no node: before all nodes, and after them.
PAGE_RANK, PARENT_RANK, CONSTRAINT_RANK = -1, 1 << 30, (1 << 30) + 1


def bbox_code(x="x", y="y", w="w", h="h") -> F.Column:
    """SCENE_BOUNDS for a box with a missing part, without area, or outside the page; else null."""
    x, y, w, h = (F.col(c) for c in (x, y, w, h))
    inside = (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= TOLERANCE) & (y + h <= TOLERANCE)
    return F.when(~F.coalesce(inside, F.lit(False)), "SCENE_BOUNDS")


def _node_rules(have: set[str]) -> list[tuple[str, F.Column]]:
    """(code, broken) in the order in which a node is read; a rule whose columns are absent does not apply."""
    c, text, image = F.col, F.col("type") == "text", F.col("type") == "image"
    no = lambda cond: ~F.coalesce(cond, F.lit(False))
    odd_color = lambda name: c(name).isNotNull() & no(c(name).rlike("^#[0-9a-fA-F]{6}$"))
    rules = [
        ({"id"}, "SCENE_NODE_ID", no(F.trim("id") != "")),
        ({"_again"}, "SCENE_DUPLICATE_ID", c("_again") > 0),
        ({"type"}, "SCENE_NODE_TYPE", no(c("type").isin(*NODE_TYPES))),
        ({"x"}, "SCENE_BOUNDS", bbox_code().isNotNull()),
        ({"z"}, "SCENE_Z", c("z").isNull()),
        ({"editable"}, "SCENE_EDITABILITY", no(c("editable"))),
        ({"value"}, "SCENE_TEXT", text & c("value").isNull()),
        ({"direction"}, "SCENE_TEXT", text & no(c("direction").isin(*DIRECTIONS))),
        ({"align"}, "SCENE_TEXT", text & no(c("align").isin(*ALIGNMENTS))),
        ({"font_size_pt"}, "SCENE_TEXT", text & no(c("font_size_pt") > 0)),
        ({"weight"}, "SCENE_TEXT", text & no(c("weight").between(100, 900))),
        ({"color"}, "SCENE_COLOR", text & odd_color("color")),
        ({"stroke_width"}, "SCENE_STYLE", ~text & no(c("stroke_width") >= 0)),
        ({"corner_radius"}, "SCENE_STYLE", ~text & no(c("corner_radius") >= 0)),
        ({"opacity"}, "SCENE_STYLE", ~text & no(c("opacity").between(0, 1))),
        ({"fill"}, "SCENE_COLOR", ~text & odd_color("fill")),
        ({"stroke"}, "SCENE_COLOR", ~text & odd_color("stroke")),
        ({"content_ref"}, "SCENE_IMAGE", image & no(c("content_ref") != "")),
        ({"raster_justification"}, "SCENE_IMAGE", image & c("raster_justification").isNotNull() & ~c("raster_justification").isin(*JUSTIFICATIONS)),
        ({"rows", "columns"}, "SCENE_GRID", (c("type") == "grid") & no((c("rows") > 0) & (c("columns") > 0))),
    ]
    return [(code, broken) for needed, code, broken in rules if needed <= have]


def page_violations(pages: DataFrame, nodes: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """Errors of (key, version, width, height, orientation) and of scenes without nodes, as of ``violations``."""
    c = F.col
    some = nodes.select(key).distinct().withColumn("_some", F.lit(True))
    sized = F.coalesce((c("width") > 0) & (c("height") > 0), F.lit(False)) & F.coalesce(c("orientation").isin(*ORIENTATIONS), c("orientation").isNull())
    tests = [("SCENE_VERSION", ~c("version").eqNullSafe(F.lit(VERSION))), ("SCENE_PAGE", ~sized), ("SCENE_NODES", c("_some").isNull())]
    coded = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(i).alias("rank"), F.lit(code).alias("code"))) for i, (code, bad) in enumerate(tests)]))
    found = pages.join(some, key, "left").select(key, F.explode(coded).alias("v"))
    return found.select(key, F.lit(PAGE_RANK).alias("ordinal"), "v.rank", "v.code", F.lit(None).cast("string").alias("id"))


def violations(nodes: DataFrame, constraints: DataFrame | None = None, *, key: str = "scene_id", relations=(), pages: DataFrame | None = None) -> DataFrame:
    """(key, ordinal, rank, code, id): every broken rule, ordered as a scene is read: page, nodes, parents, constraints."""
    again = F.row_number().over(Window.partitionBy(key, "id").orderBy("ordinal")) - 1
    marked = nodes.withColumn("_again", F.when(F.col("id").isNotNull(), again).otherwise(0))
    rules = _node_rules(set(marked.columns))
    coded = F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(i).alias("rank"), F.lit(code).alias("code"))) for i, (code, broken) in enumerate(rules)]))
    out = marked.select(key, "ordinal", "id", F.explode(coded).alias("v")).select(key, "ordinal", "v.rank", "v.code", "id")
    ids = nodes.select(key, "id").distinct()
    orphans = nodes.where("parent IS NOT NULL").join(ids.withColumnRenamed("id", "parent"), [key, "parent"], "left_anti")
    out = out.unionByName(orphans.select(key, F.lit(PARENT_RANK).alias("ordinal"), F.col("ordinal").alias("rank"), F.lit("SCENE_REFERENCE").alias("code"), "id"))
    if pages is not None:
        out = page_violations(pages, nodes, key=key).unionByName(out)
    if constraints is not None:
        known = lambda end: ids.select(key, F.col("id").alias(end), F.lit(True).alias(f"_{end}"))
        c = constraints.join(known("source"), [key, "source"], "left").join(known("target"), [key, "target"], "left")
        tests = [("SCENE_REFERENCE", F.col("_source").isNull() | F.col("_target").isNull())]
        if relations:
            tests.insert(0, ("SCENE_CONSTRAINT", ~F.coalesce(F.col("type").isin(*relations), F.lit(False))))
        if "tolerance" in constraints.columns:
            tests.append(("SCENE_CONSTRAINT", F.col("tolerance").isNotNull() & ~F.col("tolerance").between(0, 1)))
        first = F.coalesce(*[F.when(bad, F.lit(code)) for code, bad in tests])
        out = out.unionByName(c.select(key, F.lit(CONSTRAINT_RANK).alias("ordinal"), F.col("idx").cast("int").alias("rank"), first.alias("code"), F.col("source").alias("id")).where("code IS NOT NULL"))
    return out


def first_error(found: DataFrame, *, key: str = "scene_id") -> DataFrame:
    return found.groupBy(key).agg(F.min(F.struct("ordinal", "rank", "code")).alias("e")).select(key, F.col("e.code").alias("code"))


def valid(nodes: DataFrame, found: DataFrame, *, key: str = "scene_id") -> DataFrame:
    return nodes.join(found.select(key).distinct(), key, "left_anti")

"""Audit of a package against its scene: media, justification of images, source embedding, flattening, evidence for the gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..sources.scratch import cut
from .aggregates import ordered, ordered_sum, tiling, union_area
from .joins import last_by_id
from .scenes import JUSTIFICATIONS

# Suffixes of vector media, kinds of shape that are images, where own content is kept, kinds of raster that may hold no text.
VECTOR_SUFFIX = r"(?i)\.(emf|svg|wmf)$"
IMAGE_SHAPE = r"(?i)frame|graphic|picture"
REGION_PREFIX = "reference-region:"
GENERIC_RASTERS = ("source_artwork", "source_illustration", "source_texture")
MEDIA_PREFIX = "word/media/"
NEAR_SOURCE, LARGE, EMPTY_NATIVE = 4, 0.50, 0.50


def is_image_shape(shape_type) -> F.Column:
    return F.coalesce(shape_type.rlike(IMAGE_SHAPE), F.lit(False))


def media_of(parts: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """(key, name) of the media among a package's parts (key, name)."""
    return parts.where(F.startswith("name", F.lit(MEDIA_PREFIX)) & ~F.endswith("name", F.lit("/"))).select(key, "name").distinct()


def is_embedded(near, largest) -> F.Column:
    """Some media is near the source and the largest image takes half the page or more."""
    return F.coalesce(near, F.lit(False)) & (F.coalesce(largest, F.lit(0.0)) >= LARGE)


def is_monolithic(vector, largest, native_area_ratio) -> F.Column:
    """There is vector media, and a large image or little native area."""
    return F.coalesce(vector, F.lit(False)) & ((F.coalesce(largest, F.lit(0.0)) >= LARGE) | (native_area_ratio < EMPTY_NATIVE))


def media_facts(media: DataFrame, sources: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """(key, near, vector): whether some media (name, dhash) is near the source's dhash, and whether some is vector media."""
    m = media.join(sources.select(key, F.col("dhash").alias("_source")), key)
    return m.groupBy(key).agg(F.bool_or(g.hamming(F.col("dhash"), F.col("_source")) <= NEAR_SOURCE).alias("near"), F.bool_or(F.col("name").rlike(VECTOR_SUFFIX)).alias("vector"))


def justified(images: DataFrame, expected: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """Recovered images (all rows) with classification, area_ratio and allowed, from the scene's image of their id.

    An image without a stated justification whose content is a region of the reference counts as source artwork.
    """
    e = last_by_id(expected.where("type = 'image'"), key).select(key, "id", F.col("raster_justification").alias("_said"), F.col("content_ref").alias("_ref"))
    said = F.coalesce(F.nullif("_said", F.lit("")), F.when(F.startswith("_ref", F.lit(REGION_PREFIX)), F.lit("source_artwork")))
    out = images.join(e, [key, "id"], "left").withColumn("classification", F.coalesce(said, F.lit("unsupported_fallback")))
    return out.withColumns({"area_ratio": g.area(g.box()), "allowed": F.col("classification").isin(*JUSTIFICATIONS)}).drop("_said", "_ref")


def raster_text(images: DataFrame, read: DataFrame, native_text: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """(key, raster_text_complete, raster_text_regions, duplicate_text_layers, exclusivity) of generic image regions.

    ``images`` are (key, id); ``read`` holds (key, id, text), null where it could not be read. A text that shares a word with
    the native text is a duplicate layer. A region that was not read at all makes the audit incomplete.
    """
    tokens = lambda c: F.array_distinct(F.filter(F.split(t.normalize(c), " "), lambda w: w != ""))
    rows = images.select(key, "id").join(read.select(key, "id", "text"), [key, "id"], "left").join(native_text.select(key, F.col("text").alias("_native")), key, "left")
    some = t.normalize(F.col("text")) != ""
    again = some & F.arrays_overlap(tokens(F.col("text")), tokens(F.col("_native")))
    out = rows.groupBy(key).agg(F.bool_and(F.col("text").isNotNull()).alias("raster_text_complete"), F.count_if(some).cast("int").alias("raster_text_regions"), F.count_if(again).cast("int").alias("duplicate_text_layers"))
    return out.withColumn("exclusivity", F.when(F.col("raster_text_regions") == 0, 1.0).otherwise(0.0))


def audit(pages: DataFrame, expected: DataFrame, actual: DataFrame, media: DataFrame, native_text: DataFrame, read: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """One row a page: the evidence that the package gates ask for.

    ``pages``: key, integrity, dhash of the source. ``expected``: scene nodes with value, raster_justification and content_ref.
    ``actual``: recovered objects with shape_type; of repeated ids the last counts as that id, all count as objects.
    ``media``: key, name, dhash. ``native_text``: key, text of the package. ``read``: key, id, text read from image regions.
    A page without integrity has no other evidence, so that every gate that needs it fails.
    """
    scene = expected.where("type <> 'group'")
    images = actual.where(is_image_shape(F.col("shape_type")))
    known = last_by_id(actual, key).select(key, "id", is_image_shape(F.col("shape_type")).alias("_image"))
    nodes = last_by_id(scene, key).join(known, [key, "id"], "left").withColumn("_native", F.coalesce(~F.col("_image"), F.lit(False)))
    nodes = cut(nodes, "audit-nodes")

    value = t.normalize(F.col("value"))
    told = nodes.join(native_text.select(key, F.col("text").alias("_package")), key, "left")
    is_text, is_other = F.col("type") == "text", F.col("type") != "image"
    own = told.withColumn("_said", F.col("_native") & (value != "") & F.contains(t.normalize(F.col("_package")), value))
    area = g.area(g.box())
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(1.0))
    by_page = own.groupBy(key).agg(
        share(F.count_if(is_text & F.col("_said")), F.count_if(is_text)).alias("native_text_ratio"),
        share(F.count_if(is_other & F.col("_native")), F.count_if(is_other)).alias("node_coverage"),
        ordered(["ordinal", "id"], "_native", F.when(is_other, area).alias("_area")).alias("_areas"),
    )
    native, whole = ordered_sum("_areas", lambda r: F.when(r["_native"], r["_area"])), ordered_sum("_areas", lambda r: r["_area"])
    by_page = by_page.withColumn("native_area_ratio", F.least(F.lit(1.0), share(native, whole))).drop("_areas")
    objects = actual.withColumn("_image", is_image_shape(F.col("shape_type")))
    counts = objects.groupBy(key).agg(F.count_if("_image").alias("embedded_image_objects"), F.count_if(~F.col("_image")).alias("native_shape_objects"))

    # What is unjustified follows from flags of the page: both answers are worked out, and the flags choose.
    judged = cut(justified(images, scene, key=key), "audit-images")
    refused = judged.where("NOT allowed")
    sizes = judged.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n_all"), F.max("area_ratio").alias("_largest_all"), F.count_if(~F.col("allowed")).alias("_n_refused"), F.max(F.when(~F.col("allowed"), F.col("area_ratio"))).alias("_largest_refused")
    )
    tiled = tiling(judged, key=key).select(key, F.col("tiled").alias("raster_tiling"), F.col("area").alias("_total_all"))
    total = union_area(refused, key=key).withColumnRenamed("area", "_total_refused")

    generic = nodes.where(F.col("_image") & (F.col("type") == "image") & F.col("raster_justification").isin(*GENERIC_RASTERS))
    texts = raster_text(generic, read, native_text, key=key)
    tables = [by_page, counts, sizes, tiled, total, media_facts(media, pages, key=key), texts]
    known_pages = pages.select(key, F.coalesce("integrity", F.lit(False)).alias("package_integrity"))
    out = reduce(lambda a, b: a.join(b, key, "left"), [cut(x, f"audit-{i}") for i, x in enumerate(tables)], known_pages)
    out = out.na.fill(1.0, ["native_text_ratio", "node_coverage", "native_area_ratio"]).na.fill(False, ["raster_tiling"])
    out = out.withColumns({"source_reference_embedded": is_embedded(F.col("near"), F.col("_largest_all")), "monolithic": is_monolithic(F.col("vector"), F.col("_largest_all"), F.col("native_area_ratio"))})
    all_ = F.col("source_reference_embedded") | F.col("raster_tiling") | F.col("monolithic")
    pick = lambda name, none: F.coalesce(F.when(all_, F.col(f"_{name}_all")).otherwise(F.col(f"_{name}_refused")), F.lit(none))
    out = out.withColumns({"unjustified_rasters": pick("n", 0).cast("int"), "largest_raster": pick("largest", 0.0), "total_raster": pick("total", 0.0)})
    out = out.na.fill(0, ["embedded_image_objects", "native_shape_objects", "raster_text_regions", "duplicate_text_layers"])
    out = out.withColumns({"raster_text_complete": F.coalesce("raster_text_complete", F.lit(True)), "exclusivity": F.coalesce("exclusivity", F.lit(1.0))})
    evidence = (
        "native_text_ratio", "node_coverage", "native_area_ratio", "embedded_image_objects", "native_shape_objects", "raster_tiling", "source_reference_embedded", "monolithic",
        "unjustified_rasters", "largest_raster", "total_raster", "raster_text_complete", "raster_text_regions", "duplicate_text_layers", "exclusivity",
    )
    out = out.select(key, "package_integrity", *[F.when(F.col("package_integrity"), F.col(c)).alias(c) for c in evidence])
    return out.withColumn("audit_complete", F.coalesce(F.col("package_integrity") & F.col("raster_text_complete"), F.lit(False)))


def manifest(nodes: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """Counts, stroke widths, text colours and right-to-left texts of each scene, from columns that may be null."""
    image = F.col("type") == "image"
    rtl = (F.col("type") == "text") & F.col("direction").isin("rtl", "mixed")
    return nodes.groupBy(key).agg(
        F.count_if(F.col("type") != "group").alias("native_shape_count"),
        F.count_if(image).alias("image_object_count"),
        F.count_if(image & (F.col("w") >= 0.95) & (F.col("h") >= 0.95)).alias("full_page_image_count"),
        F.array_sort(F.collect_set(F.when(F.col("stroke_width") > 0, F.col("stroke_width")))).alias("stroke_widths"),
        F.array_sort(F.collect_set(F.when(F.col("type") == "text", F.col("color")))).alias("text_colors"),
        F.transform(F.array_sort(F.collect_list(F.when(rtl, F.struct("ordinal", "id")))), lambda s: s["id"]).alias("rtl_text_nodes"),
    )

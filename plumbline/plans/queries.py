"""The registered queries: each applies one operator to a carrier view. Doubles are rounded to six places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import aggregates as agg
from ..operators import documents as docs_ops
from ..operators import folds, gates, joins, package, requests, scenes, windows
from ..sources import carriers as c

#: The moment at which expiry is asked for.
NOW = "2024-01-15 00:00:00"


def r6(col) -> F.Column:
    return F.round(col.cast("double"), 6)


def align_error_by_node(s, d):
    return joins.align(c.nodes(s, d), c.actuals(s, d)).select(F.col("scene_id").alias("scene"), "id", r6(F.col("max_error")).alias("max_error"))


def align_gate_by_scene(s, d):
    out = agg.extrema(joins.align(c.nodes(s, d), c.actuals(s, d)))
    return out.select(F.col("scene_id").alias("scene"), r6(F.col("max_error")).alias("max_error"), "passed")


def _reconstructable(s, d) -> tuple[DataFrame, DataFrame]:
    n = c.nodes(s, d)
    hit = joins.covered(n, c.actuals(s, d)).select("scene_id", "id").distinct().withColumn("hit", F.lit(1))
    return n, n.where("type NOT IN ('group', 'image')").join(hit, ["scene_id", "id"], "left")


def node_coverage(s, d):
    n, r = _reconstructable(s, d)
    per = r.groupBy("scene_id").agg(F.count("hit").alias("a"), F.count(F.lit(1)).alias("b"))
    out = n.select("scene_id").distinct().join(per, "scene_id", "left")
    return out.select(F.col("scene_id").alias("scene"), r6(agg.ratio(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))).alias("coverage"))


def native_area_ratio(s, d):
    n, r = _reconstructable(s, d)
    per = r.groupBy("scene_id").agg(F.sum(F.when(F.col("hit") == 1, F.col("w") * F.col("h")).otherwise(0.0)).alias("a"), F.sum(F.col("w") * F.col("h")).alias("b"))
    out = n.select("scene_id").distinct().join(per, "scene_id", "left")
    return out.select(F.col("scene_id").alias("scene"), r6(agg.ratio(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0)))).alias("ratio"))


def relation_error_by_type(s, d):
    out = joins.relations(c.constraints(s, d), c.actuals(s, d))
    return out.groupBy("type").agg(F.count(F.lit(1)).alias("n"), r6(F.max("error")).alias("max_error"), F.round(F.avg("error"), 6).alias("mean_error"))


def duplicate_ids(s, d):
    return joins.duplicate_ids(c.nodes(s, d), id_col="raw_id").select(F.col("scene_id").alias("scene"), F.col("raw_id").alias("id"), "n")


def orphan_parents(s, d):
    kept = c.nodes(s, d).where("ordinal % 5 <> 2")
    return joins.orphan_parents(kept).select(F.col("scene_id").alias("scene"), "id", "parent")


def bbox_violations(s, d):
    wide = c.nodes(s, d).withColumn("w", F.col("w") * 2).withColumn("x", F.col("x") - 0.005)
    return wide.select(F.col("scene_id").alias("scene"), "id", scenes.bbox_code().alias("code")).where("code IS NOT NULL")


def scene_first_error(s, d):
    wide = c.nodes(s, d).withColumn("w", F.col("w") * 2).where("ordinal % 5 <> 2")
    return scenes.first_error(scenes.violations(wide)).select(F.col("scene_id").alias("scene"), "code")


def overlap_pairs(s, d):
    return joins.pairs(c.nodes(s, d), g.overlap_of_smaller, least=0.45).select(F.col("scene_id").alias("scene"), "a", "b", r6(F.col("ratio")).alias("ratio"))


def iou_pairs(s, d):
    return joins.pairs(c.nodes(s, d), g.iou, least=0.2).select(F.col("scene_id").alias("scene"), "a", "b", r6(F.col("ratio")).alias("ratio"))


def box_on_text(s, d):
    n = c.nodes(s, d)
    return joins.box_on_text(n.where("type = 'rounded_rectangle'"), n.where("type = 'text'"), least=0.35).select(F.col("scene_id").alias("scene"), "id")


def union_area(s, d):
    return agg.union_area(c.nodes(s, d)).select(F.col("scene_id").alias("scene"), r6(F.col("area")).alias("area"))


def tiling_detect(s, d):
    big = c.nodes(s, d).withColumn("w", F.col("w") * 4).withColumn("h", F.col("h") * 6)
    return agg.tiling(big).select(F.col("scene_id").alias("scene"), "tiled")


def family_support(s, d):
    return joins.family_support(c.nodes(s, d)).select(F.col("scene_id").alias("scene"), "id", "support")


def line_clusters(s, d):
    days = c.table(s, d, "lineitem").select(F.col("l_suppkey").alias("scene_id"), F.datediff("l_shipdate", F.lit("1992-01-01")).alias("value")).distinct()
    return windows.clusters(days).select("scene_id", "grp", "centre", "n")


def crop_pixels(s, d):
    box = g.crop_pixels(g.box(), F.lit(1200.0), F.lit(800.0))
    return c.nodes(s, d).select(F.col("scene_id").alias("scene"), "id", box.alias("b")).select("scene", "id", "b.left", "b.top", "b.right", "b.bottom")


def page_geometry(s, d):
    page = g.page_mm(F.col("p_size").cast("double"), (F.col("p_partkey") % 40 + 5).cast("double"))
    return c.table(s, d, "part").select("p_partkey", page.alias("g")).select("p_partkey", r6(F.col("g.w_mm")).alias("w_mm"), r6(F.col("g.h_mm")).alias("h_mm"), "g.orientation")


def grid_expand(s, d):
    grids = c.nodes(s, d).where("type = 'rectangle'").withColumn("rows", F.col("z") % 4).withColumn("columns", F.col("ordinal") % 3)
    return windows.grid_lines(grids).select(F.col("scene_id").alias("scene"), "id", "axis", r6(F.col("at")).alias("at"))


def draw_order(s, d):
    return windows.draw_order(c.nodes(s, d)).select(F.col("scene_id").alias("scene"), "id", "draw")


def first_three(s, d):
    return windows.first_n(c.nodes(s, d).where("type = 'image'"), 3).select(F.col("scene_id").alias("scene"), "id")


def word_filter(s, d):
    w = windows.keep_words(c.words(s, d))
    return w.groupBy("page_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("left").alias("sum_left"))


def line_assembly(s, d):
    lines = windows.assemble_lines(c.words(s, d))
    return lines.select("page_id", "line", F.md5("text").alias("text"), "left", "top", "right", "bottom", r6(F.col("conf")).alias("conf"), r6(F.col("score")).alias("score"))


def segment_words(s, d):
    w = windows.segments(c.words(s, d))
    return w.groupBy("page_id").agg(F.sum("segment").alias("segments"))


def row_breaks(s, d):
    return windows.rows(c.words(s, d)).groupBy("page_id").agg((F.max("row") + 1).alias("rows"))


def best_pass(s, d):
    lines = windows.assemble_lines(c.words(s, d))
    keyed = lines.withColumn("block", F.col("page_id") % 50)
    return windows.best(keyed, ["block", "line"], ordinal="page_id").select("block", "line", F.col("pass"), r6(F.col("score")).alias("score"))


def renumbered(s, d):
    return windows.renumber(c.nodes(s, d).where("type = 'text'")).select(F.col("scene_id").alias("scene"), "ordinal", "id")


def width_units(s, d):
    return c.table(s, d, "documents").select("doc_id", F.round(t.width_units(F.col("text")), 4).alias("units"), F.round(t.max_line_units(F.col("text")), 4).alias("widest"), t.direction(F.col("text")).alias("direction"))


def font_fit(s, d):
    b = c.table(s, d, "benchmark")
    size = t.font_size((F.col("item_id") % 9 + 1) / F.lit(200.0), F.lit(297.0), F.lit(180.0), F.lit(20.0), F.col("text"))
    return b.select("item_id", r6(size).alias("points"))


def text_normalize(s, d):
    return c.table(s, d, "conversations").select("conv_id", "turn", F.md5(t.normalize(F.col("text"))).alias("norm"), F.md5(t.key(F.col("text"))).alias("key"))


def token_overlap(s, d):
    a = c.table(s, d, "documents").select((F.col("doc_id") % 40).alias("item_id"), "doc_id", "text")
    return joins.token_overlap(a, c.table(s, d, "benchmark"), key="item_id").select("doc_id", "duplicate")


def _tokens(s, d):
    w = c.table(s, d, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).select(F.regexp_replace("w", "[^a-z]", "").alias("token")).where("length(token) >= 4")
    return w.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def edit_distance_top1(s, d):
    words = _tokens(s, d)
    return joins.nearest_words(words.where("n = 1").select("token"), words.where("n > 1").select(F.col("token").alias("word"), F.col("n").alias("freq")))


def seq_ratio(s, d):
    b = c.table(s, d, "benchmark")
    return b.select("item_id", r6(t.seq_ratio(F.col("text"), F.reverse("text"))).alias("ratio"))


def url_guard(s, d):
    return c.table(s, d, "pages").select("page_id", requests.url_code(F.col("url")).alias("code"))


def filename_sanitize(s, d):
    return c.table(s, d, "pages").select("page_id", t.filename(F.col("url")).alias("out"))


def diagnostic_redact(s, d):
    said = F.concat(F.lit("failed at  "), F.col("url"), F.lit(" key=abcdefghijklmnopqrstuvwxyz0123456789"))
    return c.table(s, d, "pages").select("page_id", t.redact(said).alias("out"))


def html_text_runs(s, d):
    runs = docs_ops.text_runs(F.col("html"))
    return c.table(s, d, "pages").select("page_id", F.size(F.expr("regexp_extract_all(html, '<[^>]*>', 0)")).alias("tags"), (F.size(runs) > 0).alias("has_text"))


def xml_escaped(s, d):
    return c.table(s, d, "pages").select("page_id", F.md5(t.xml_escape(F.col("html"))).alias("escaped"))


def raster_stats(s, d):
    l = F.col("luma")  # noqa: E741
    return c.rasters(s, d).select("vec_id", r6(agg.nonwhite(l)).alias("nonwhite"), agg.percentile(l, 0.2).alias("p20"), agg.upper_median(l).alias("median"), r6(agg.contrast(l)).alias("contrast"), r6(agg.border_coverage(l)).alias("border"))


def raster_mode_bucket(s, d):
    return c.rasters(s, d).select("vec_id", agg.mode_bucket(F.col("luma")).alias("bucket"))


def raster_compare(s, d):
    a, b = F.col("reference"), F.col("rendered")
    return c.raster_pairs(s, d).select("vec_id", r6(agg.palette_delta(a, b)).alias("palette"), r6(agg.ssim(a, b)).alias("ssim"), r6(agg.edge_f1(a, b)).alias("f1"))


def raster_dhash_dist(s, d):
    r = c.hash_rasters(s, d).select("vec_id", agg.dhash(F.col("luma")).alias("dhash"))
    both = r.alias("a").join(r.alias("b"), F.expr("b.vec_id = a.vec_id + 1"))
    return both.select("a.vec_id", g.hamming(F.col("a.dhash"), F.col("b.dhash")).alias("distance"))


def raster_edges(s, d):
    l = F.col("luma")  # noqa: E741
    return c.rasters(s, d).select("vec_id", r6(agg.edge_density(l)).alias("density"), agg.text_color(l).alias("color"))


def artwork(s, d):
    p = F.col("pixels")
    top = c.color_rasters(s, d).select("vec_id", agg.is_artwork(p).alias("artwork"), agg.dominant(p).alias("d"))
    return top.select("vec_id", "artwork", F.format_string("%d-%d-%d", "d.color.r", "d.color.g", "d.color.b").alias("color"), r6(F.col("d.share")).alias("share"))


def image_justification(s, d):
    images = c.objects(s, d).where(package.is_image_shape(F.col("shape_type")))
    return package.justified(images, c.scene_nodes(s, d)).select(F.col("scene_id").alias("scene"), "id", "classification", r6(F.col("area_ratio")).alias("area_ratio"), "allowed")


def _audit(s, d) -> DataFrame:
    return package.audit(c.packages(s, d), c.scene_nodes(s, d), c.objects(s, d), c.media(s, d), c.package_texts(s, d), c.read_texts(s, d))


def package_audit(s, d):
    ratios = ("native_text_ratio", "node_coverage", "native_area_ratio", "largest_raster", "total_raster", "exclusivity")
    counts = ("embedded_image_objects", "native_shape_objects", "unjustified_rasters", "raster_text_regions", "duplicate_text_layers")
    flags = ("package_integrity", "audit_complete", "raster_text_complete", "source_reference_embedded", "monolithic", "raster_tiling")
    return _audit(s, d).select(F.col("scene_id").alias("scene"), *[F.coalesce(F.col(x), F.lit(False)).alias(x) for x in flags], *[F.coalesce(F.col(x), F.lit(-1)).cast("long").alias(x) for x in counts], *[r6(F.coalesce(F.col(x), F.lit(-1.0))).alias(x) for x in ratios])


def render_manifest(s, d):
    m = package.manifest(c.scene_nodes(s, d))
    joined = [F.array_join(F.transform(x, lambda v: v.cast("string")), ",").alias(x) for x in ("stroke_widths", "text_colors", "rtl_text_nodes")]
    return m.select(F.col("scene_id").alias("scene"), "native_shape_count", "image_object_count", "full_page_image_count", *joined)


def gate_hints(s, d):
    return gates.hints(gates.gates(_evidence(s, d))).groupBy("gate", "hint").agg(F.count(F.lit(1)).alias("scenes"))


def job_failure(s, d):
    j = c.jobs(s, d).where("status = 'FAILED'")
    has = F.col("event_id") % 3 != 0
    told = F.when(F.col("event_id") % 5 == 0, "EDITABILITY_FAILED").otherwise("DONE")
    return j.select("event_id", requests.failure_status(F.col("error_code"), told, has).alias("recorded"), requests.error_code(told).alias("code"))


def gate_status(s, d):
    res = c.gates(s, d)
    complete = res.where("gate = 'G_AUDIT'").select("doc_id", F.col("passed").alias("complete"))
    return gates.status(res, complete, key="doc_id", editability=("G_QUALITY",))


def gate_findings(s, d):
    return gates.findings(c.gates(s, d), key="doc_id").select("doc_id", F.array_join("findings", ",").alias("findings"))


#: Measures that need page images, of which the carriers have none.
UNMEASURED = {"nonwhite": 0.5, "pages": 1, "aspect_error": 0.0, "border_coverage": 1.0, "contrast": 21.0, "edge_f1": 1.0, "palette_delta": 0.0, "ssim": 1.0, "text_complete": True, "text_coverage": 1.0}


def _evidence(s, d) -> DataFrame:
    err = agg.extrema(joins.align(c.nodes(s, d), c.actuals(s, d))).select("scene_id", F.col("max_error").alias("alignment_error"))
    rel = joins.relations(c.constraints(s, d), c.actuals(s, d)).groupBy("scene_id").agg(F.max("error").alias("relation_error"))
    ev = _audit(s, d).join(err, "scene_id", "left").join(rel, "scene_id", "left")
    return ev.withColumns({k: F.lit(v) for k, v in UNMEASURED.items()})


def fidelity_report(s, d):
    """All 23 gates of each scene from what the carriers measure: the package audit, alignment and relations."""
    rep = gates.report(_evidence(s, d))
    return rep.select(F.col("scene_id").alias("scene"), "status", F.array_join("findings", ",").alias("findings"))


def job_latest(s, d):
    return requests.latest(c.jobs(s, d)).select("job_id", "event_id", "status")


def job_response(s, d):
    return requests.response(requests.latest(c.jobs(s, d))).select("job_id", "response")


def job_ttl(s, d):
    return requests.with_expiry(c.jobs(s, d), NOW).groupBy("job_id").agg(F.count_if("expired").alias("expired"), F.count(F.lit(1)).alias("n"))


def retry_schedule(s, d):
    b = c.table(s, d, "customer").select(F.col("c_custkey").alias("job_id"), (F.col("c_custkey") % 60 + 1).cast("double").alias("budget"))
    return requests.retry_schedule(b)


def dedupe_text_greedy(s, d):
    n = c.nodes(s, d).where("type = 'text'").withColumn("text", F.repeat(F.lit("a"), F.col("raw_id")))
    return folds.fold(n, folds.keep_texts).select(F.col("scene_id").alias("scene"), "id")


def dedupe_visual_greedy(s, d):
    return folds.fold(c.nodes(s, d), folds.keep_visuals).select(F.col("scene_id").alias("scene"), "id")


def regular_run(s, d):
    lines = c.table(s, d, "orders").select((F.col("o_custkey") % 997).alias("scene_id"), (F.col("o_orderkey") % 600).cast("long").alias("pos")).distinct()
    return folds.regular_runs(lines).select("scene_id", "pos")


def nodes_by_type(s, d):
    return c.nodes(s, d).groupBy("scene_id").agg(F.count_if(F.col("type") != "image").alias("native"), F.count_if(F.col("type") == "image").alias("images"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("kinds")).withColumnRenamed("scene_id", "scene")


QUERIES = {f.__name__: f for f in (
    align_error_by_node, align_gate_by_scene, node_coverage, native_area_ratio, relation_error_by_type, duplicate_ids, orphan_parents, bbox_violations, scene_first_error,
    overlap_pairs, iou_pairs, box_on_text, union_area, tiling_detect, family_support, line_clusters, crop_pixels, page_geometry, grid_expand, draw_order, first_three,
    word_filter, line_assembly, segment_words, row_breaks, best_pass, renumbered, width_units, font_fit, text_normalize, token_overlap, edit_distance_top1, seq_ratio,
    url_guard, filename_sanitize, diagnostic_redact, html_text_runs, xml_escaped, raster_stats, raster_mode_bucket, raster_compare, raster_dhash_dist, gate_status,
    gate_findings, fidelity_report, gate_hints, package_audit, image_justification, render_manifest, raster_edges, artwork, job_failure, job_latest, job_response, job_ttl, retry_schedule, dedupe_text_greedy, dedupe_visual_greedy, regular_run, nodes_by_type,
)}

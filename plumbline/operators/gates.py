"""Fidelity gates: measured evidence against a policy, then findings, hints and a status. Missing evidence fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The policy's version, gates in order, and thresholds.
POLICY_VERSION = "fidelity-v2"
EDITABILITY_GATES = (
    "G_PACKAGE_MEDIA_AUDIT", "G_NO_SOURCE_REFERENCE_EMBED", "G_NO_FULL_PAGE_RASTER", "G_VISIBLE_TEXT_NATIVE", "G_SCENE_NODE_COVERAGE", "G_NATIVE_OBJECT_RATIO",
    "G_OBJECT_EDITABILITY", "G_RASTER_JUSTIFICATION", "G_NO_RASTERIZED_TEXT", "G_NO_DUPLICATE_TEXT_LAYERS", "G_TEXT_REGION_EXCLUSIVITY",
)
CRITICAL_GATES = (
    *EDITABILITY_GATES, "S_EDITABILITY", "R_NONBLANK", "R_SINGLE_PAGE", "G_PAGE_GEOMETRY", "G_ALIGNMENT", "G_RELATIONSHIPS",
    "G_BORDER_CONTINUITY", "V_CONTRAST", "V_EDGE_SIMILARITY", "V_PALETTE", "V_STRUCTURE", "V_TEXT_COVERAGE",
)

#: Gate -> condition over the evidence columns of ``EVIDENCE``; each already has its failing default.
CONDITIONS = {
    "G_PACKAGE_MEDIA_AUDIT": "audit_complete AND package_integrity",
    "G_NO_SOURCE_REFERENCE_EMBED": "audit_complete AND NOT source_reference_embedded",
    "G_NO_FULL_PAGE_RASTER": "audit_complete AND largest_raster <= 0.10D AND total_raster <= 0.15D AND NOT raster_tiling",
    "G_VISIBLE_TEXT_NATIVE": "audit_complete AND native_text_ratio >= 1.0D",
    "G_SCENE_NODE_COVERAGE": "audit_complete AND node_coverage >= 0.90D",
    "G_NATIVE_OBJECT_RATIO": "audit_complete AND native_area_ratio >= 0.90D",
    "G_OBJECT_EDITABILITY": "audit_complete AND NOT monolithic",
    "G_RASTER_JUSTIFICATION": "audit_complete AND unjustified_rasters = 0",
    "G_NO_RASTERIZED_TEXT": "audit_complete AND raster_text_complete AND raster_text_regions = 0",
    "G_NO_DUPLICATE_TEXT_LAYERS": "audit_complete AND raster_text_complete AND duplicate_text_layers = 0",
    "G_TEXT_REGION_EXCLUSIVITY": "audit_complete AND raster_text_complete AND exclusivity >= 1.0D",
    "R_NONBLANK": "nonwhite >= 0.002D",
    "R_SINGLE_PAGE": "pages = 1",
    "G_PAGE_GEOMETRY": "aspect_error <= 0.01D",
    "G_ALIGNMENT": "alignment_error <= 0.025D",
    "G_RELATIONSHIPS": "relation_error <= 0.025D",
    "G_BORDER_CONTINUITY": "border_coverage >= 0.12D",
    "V_CONTRAST": "contrast >= 3.0D",
    "V_EDGE_SIMILARITY": "edge_f1 >= 0.30D",
    "V_PALETTE": "palette_delta <= 0.28D",
    "V_STRUCTURE": "ssim >= 0.45D",
    "V_TEXT_COVERAGE": "text_complete AND text_coverage >= 1.0D",
}

#: Evidence column -> value that stands for missing evidence, on the failing side; relations and borders may be absent.
EVIDENCE = {
    "audit_complete": False, "package_integrity": True, "source_reference_embedded": True, "largest_raster": 1.0, "total_raster": 1.0, "raster_tiling": True,
    "native_text_ratio": 0.0, "node_coverage": 0.0, "native_area_ratio": 0.0, "monolithic": True, "unjustified_rasters": 1, "raster_text_complete": False,
    "raster_text_regions": 1, "duplicate_text_layers": 1, "exclusivity": 0.0, "nonwhite": 0.0, "pages": 0, "aspect_error": 1.0, "alignment_error": 0.0,
    "relation_error": 0.0, "border_coverage": 1.0, "contrast": 21.0, "edge_f1": 0.0, "palette_delta": 1.0, "ssim": 0.0, "text_complete": False, "text_coverage": 0.0,
}

# What to do about a failed gate, the gates and the measures that prove editability.
HINTS = {
    "G_ALIGNMENT": "restore measured bounding boxes and constraints",
    "G_PAGE_GEOMETRY": "restore the source page aspect ratio",
    "G_BORDER_CONTINUITY": "restore visible native strokes",
    "V_CONTRAST": "increase foreground-background contrast",
    "V_EDGE_SIMILARITY": "restore missing or displaced visual edges",
    "V_PALETTE": "restore the measured source palette",
    "V_STRUCTURE": "restore the source region hierarchy",
    "V_TEXT_COVERAGE": "restore missing or undersized native text",
}
DEFAULT_HINT = "rebuild and rerender the affected primitives"
EVIDENCE_GATES = (*EDITABILITY_GATES[:8], "S_EDITABILITY")
EVIDENCE_METRICS = ("native_text_ratio", "node_coverage", "native_area_ratio", "largest_raster", "total_raster", "source_reference_embedded", "monolithic")


def evaluated(evidence: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """One row a scene: ``results`` holds (gate, passed) of every critical gate in policy order, ``complete`` whether the evidence is.

    Columns that are missing or null take the failing side. All is worked out inside the row.
    """
    have = set(evidence.columns)
    full = evidence.select(
        key,
        *[(F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v)).alias(c) for c, v in EVIDENCE.items()],
        F.struct(*[(F.col(c) if c in have else F.lit(None)).alias(c) for c in EVIDENCE_METRICS]).alias("metrics"),
    ).withColumn("audit_complete", F.col("audit_complete") & F.col("package_integrity"))
    tests = [F.struct(F.lit(n).alias("gate"), F.coalesce(F.expr(" AND ".join(f"({CONDITIONS[e]})" for e in EDITABILITY_GATES) if n == "S_EDITABILITY" else CONDITIONS[n]), F.lit(False)).alias("passed")) for n in CRITICAL_GATES]
    return full.select(key, F.array(*tests).alias("results"), (F.col("audit_complete") & F.col("text_complete")).alias("complete"), "metrics")


def gates(evidence: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """(key, gate, ordinal, passed) for every critical gate."""
    return evaluated(evidence, key=key).select(key, F.posexplode_outer("results").alias("ordinal", "g")).select(key, "g.gate", "ordinal", "g.passed")


def findings(results: DataFrame, *, key: str = "scene_id", most: int = 24) -> DataFrame:
    """(key, findings): the failed gates of each scene in policy order, at most ``most``."""
    failed = F.filter(F.array_sort(F.collect_list(F.struct("ordinal", "gate", "passed"))), lambda s: ~s["passed"])
    return results.groupBy(key).agg(F.slice(F.transform(failed, lambda s: s["gate"]), 1, most).alias("findings"))


def hint_of(gate) -> F.Column:
    table = F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, gate), F.lit(DEFAULT_HINT))


def hints(results: DataFrame) -> DataFrame:
    """Failed gates with what to do about them."""
    return results.where("NOT passed").withColumn("hint", hint_of(F.col("gate")))


def status_of(all_passed, complete, editable) -> F.Column:
    """PASS if every gate passes; else INCOMPLETE without complete evidence; else what kind of gate failed."""
    return F.when(all_passed, "PASS").when(~complete, "VALIDATION_INCOMPLETE").when(~editable, "EDITABILITY_FAILED").otherwise("FIDELITY_FAILED")


def status(results: DataFrame, complete: DataFrame | None = None, *, key: str = "scene_id", editability=EDITABILITY_GATES) -> DataFrame:
    s = results.groupBy(key).agg(F.bool_and("passed").alias("all_passed"), F.bool_and(F.when(F.col("gate").isin(*editability), F.col("passed")).otherwise(True)).alias("editable"))
    s = s.withColumn("complete", F.lit(True)) if complete is None else s.join(complete.select(key, "complete"), key, "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
    return s.select(key, status_of(F.col("all_passed"), F.col("complete"), F.col("editable")).alias("status"))


def report(evidence: DataFrame, *, key: str = "scene_id", most: int = 24) -> DataFrame:
    """One row a scene: status, gates as a map, findings, hints and the editability measures. No shuffle."""
    passed = lambda g: F.exists("results", lambda r: (r["gate"] == g) & r["passed"])
    failed = F.transform(F.filter("results", lambda r: ~r["passed"]), lambda r: r["gate"])
    out = evaluated(evidence, key=key).withColumns({"findings": F.slice(failed, 1, most), "editable": passed("S_EDITABILITY")})
    return out.select(
        key,
        status_of(F.forall("results", lambda r: r["passed"]), F.col("complete"), F.col("editable")).alias("status"),
        F.map_from_entries("results").alias("gates"),
        "findings",
        F.transform("findings", lambda g: F.struct(g.alias("gate"), hint_of(g).alias("action"))).alias("correction_hints"),
        F.struct(F.col("editable").alias("passed"), "metrics.*").alias("editability"),
        F.lit(POLICY_VERSION).alias("version"),
    )


def evidence_complete(reports: DataFrame) -> DataFrame:
    """Reports that passed, are editable, carry every needed gate as true and every needed measure; what is missing counts against them."""
    gates_ = F.forall(F.array(*[F.lit(g) for g in EVIDENCE_GATES]), lambda g: F.coalesce(F.try_element_at("gates", g), F.lit(False)))
    measured = [F.col(f"editability.{m}").isNotNull() for m in EVIDENCE_METRICS]
    out = reports.where((F.col("status") == "PASS") & F.coalesce(F.col("editability.passed"), F.lit(False)) & gates_)
    for m in measured:
        out = out.where(m)
    return out


def incomplete(reports: DataFrame) -> DataFrame:
    """Reports with the audit gates turned off and one more finding, for evidence that could not be taken."""
    off = F.create_map(F.lit("G_PACKAGE_MEDIA_AUDIT"), F.lit(False), F.lit("S_EDITABILITY"), F.lit(False))
    rest = F.map_filter("gates", lambda k, v: ~k.isin("G_PACKAGE_MEDIA_AUDIT", "S_EDITABILITY"))
    out = reports.withColumn("gates", F.map_concat(rest, off)).withColumn("findings", F.array_union("findings", F.array(F.lit("G_PACKAGE_MEDIA_AUDIT")))).withColumn("status", F.lit("VALIDATION_INCOMPLETE"))
    return out.withColumn("editability", F.col("editability").withField("passed", F.lit(False))) if "editability" in reports.columns else out


def reopened(measures: DataFrame) -> DataFrame:
    """Gates of a document that was opened again (opened, nonwhite, pages): accepted, and which gates failed."""
    tests = F.array(F.when(F.coalesce(F.col("nonwhite"), F.lit(0.0)) < 0.002, F.lit("R_NONBLANK")), F.when(~F.col("pages").eqNullSafe(F.lit(1)), F.lit("R_SINGLE_PAGE")))
    failed = F.when(F.coalesce("opened", F.lit(False)), F.array_compact(tests)).otherwise(F.array(F.lit("R_REOPEN")))
    return measures.withColumn("failed_gates", failed).withColumn("accepted", F.size("failed_gates") == 0)


def word_ratio(rendered, reference) -> F.Column:
    """Rendered words as a share of the reference's, at most 1; 1 where that has none, null where either was not measured."""
    share = F.least(F.lit(1.0), F.try_divide(rendered.cast("double"), F.nullif(reference.cast("double"), F.lit(0.0))))
    return F.when(rendered.isNotNull() & reference.isNotNull(), F.coalesce(share, F.lit(1.0)))


def text_coverage(nodes: DataFrame, *, key: str = "scene_id", least_ink: float = 0.30) -> DataFrame:
    """(key, text_complete, text_coverage) of text nodes' ink densities (reference_density, rendered_density).

    A node's ratio is rendered over reference ink, at most 1, and 0 without reference ink; it counts from ``least_ink``
    on. The measure is complete if every reference holds some ink.
    """
    ratio = F.when(F.col("reference_density") > 0, F.least(F.lit(1.0), F.col("rendered_density") / F.col("reference_density"))).otherwise(0.0)
    return nodes.groupBy(key).agg(F.bool_and(F.col("reference_density") >= 0.002).alias("text_complete"), F.avg((ratio >= least_ink).cast("double")).alias("text_coverage"))

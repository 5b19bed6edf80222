"""Structural checks of document packages and blueprints, and the writer whose output passes them."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import xml_escape

# Parts of every package, and what a render report must have passed.
REQUIRED_PARTS = ("[Content_Types].xml", "word/document.xml")
RENDER_FLAGS = ("header_containment", "grid_alignment", "pill_geometry", "rtl_layout", "word_compatible_render")
_TEXT = r"(?s)<(?:\w+:)?t(?:\s[^>]*)?>(.*?)</(?:\w+:)?t>"


def count_of(xml, path: str) -> F.Column:
    return F.size(F.xpath(xml, F.lit(path)))


def _unescaped(text) -> F.Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def texts_of(xml) -> F.Column:
    """The texts of all text elements, in order."""
    return F.transform(F.regexp_extract_all(xml, F.lit(_TEXT), F.lit(1)), _unescaped)


def shapes_of(xml) -> F.Column:
    """(text, rtl) of all word-processing shapes: rtl if the first bidi mark is set and a run is right-to-left."""
    found = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?wsp(?:\s[^>]*)?>.*?</(?:\w+:)?wsp>"), F.lit(0))
    bidi = lambda s: F.regexp_extract(s, r"<(?:\w+:)?bidi\b([^>]*)>", 1).rlike(r'\bval="1"')
    return F.transform(found, lambda s: F.struct(F.array_join(texts_of(s), "").alias("text"), F.array_join(texts_of(s), "\n").alias("lines"), (bidi(s) & s.rlike(r"<(?:\w+:)?rtl\b")).alias("rtl")))


def structure(packages: DataFrame) -> DataFrame:
    """Counts and gates S-01 to S-09 of (docx_id, xml, n_media) and what is expected of each package.

    Expectations that are absent or null ask for nothing: expected_round_rects, forbid_media, forbid_tables, and the arrays
    required_text, required_shape_text, rtl_shape_text, required_shape_names. Without XML only S-01 is judged.
    """
    local = lambda n: f"//*[local-name()='{n}']"
    xml, have = F.col("xml"), set(packages.columns)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(False)
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in have else F.array().cast("array<string>")
    c = packages.select(
        "*",
        count_of(xml, f"{local('br')}[@*[local-name()='type']='page']/@*[local-name()='type']").alias("page_breaks"),
        F.xpath_int(xml, F.lit(f"count({local('tbl')})")).alias("tables"),
        F.xpath_int(xml, F.lit(f"count({local('prstGeom')}[@prst='roundRect'])")).alias("round_rects"),
        F.xpath(xml, F.lit(f"{local('docPr')}/@name")).alias("_names"),
        texts_of(xml).alias("_texts"),
        shapes_of(xml).alias("_shapes"),
    ).withColumn("text", F.array_join("_texts", ""))
    blob = F.array_join("_texts", "\n")
    nested = F.array_join(F.transform("_shapes", lambda s: s["lines"]), "\n")
    holding = lambda label: F.get(F.filter("_shapes", lambda s: F.contains(s["text"], label)), F.lit(0))
    expected = F.col("expected_round_rects") if "expected_round_rects" in have else F.lit(None).cast("int")
    missing = {
        "S-04_editable_text": F.filter(listed("required_text"), lambda v: ~F.contains(blob, v)),
        "S-05_text_inside_shapes": F.filter(listed("required_shape_text"), lambda v: ~F.contains(nested, v)),
        "S-08_rtl_inside_shape": F.filter(listed("rtl_shape_text"), lambda v: ~F.coalesce(holding(v)["rtl"], F.lit(False))),
        "S-09_required_shape_primitives": F.array_except(listed("required_shape_names"), F.col("_names")),
    }
    rules = {
        "S-01_native_docx": xml.isNotNull(),
        "S-02_no_flattened_media": ~flag("forbid_media") | (F.col("n_media") == 0),
        "S-03_round_rect_count": expected.isNull() | (F.col("round_rects") == expected),
        "S-04_editable_text": F.size(missing["S-04_editable_text"]) == 0,
        "S-05_text_inside_shapes": F.size(missing["S-05_text_inside_shapes"]) == 0,
        "S-06_no_schedule_table": ~flag("forbid_tables") | (F.col("tables") == 0),
        "S-07_single_page_structure": F.col("page_breaks") == 0,
        "S-08_rtl_inside_shape": F.size(missing["S-08_rtl_inside_shape"]) == 0,
        "S-09_required_shape_primitives": F.size(missing["S-09_required_shape_primitives"]) == 0,
    }
    tests = F.array(*[F.struct(F.lit(g).alias("gate"), F.coalesce(ok, F.lit(False)).alias("passed")) for g, ok in rules.items()])
    judged = c.withColumn("_tests", F.when(xml.isNotNull(), tests).otherwise(F.slice(tests, 1, 1)))
    out = judged.withColumn("findings", F.transform(F.filter("_tests", lambda t: ~t["passed"]), lambda t: F.substring(t["gate"], 1, 4)))
    out = out.withColumn("gates", F.map_from_entries("_tests")).withColumn("status", F.when(F.size("findings") == 0, "PASS").otherwise("FAIL"))
    return out.drop("_tests", "_names", "_texts", "_shapes")


def render_gate(reports: DataFrame) -> DataFrame:
    """Flags of each report (a map) that are not PASS, sorted; a report that is absent is V-00, one with such flags V-01."""
    need = F.array(*[F.lit(f) for f in sorted(RENDER_FLAGS)])
    got = F.map_keys(F.map_filter("flags", lambda k, v: v == "PASS"))
    out = reports.withColumn("missing", F.when(F.col("flags").isNull(), need).otherwise(F.array_except(need, got)))
    return out.withColumn("finding", F.when(F.col("flags").isNull(), "V-00").when(F.size("missing") > 0, "V-01"))


def blueprint_errors(blueprints: DataFrame) -> DataFrame:
    """All broken rules of (id, required present keys, directions, features, plan, editable, rendered)."""
    covered = F.array_except(F.transform(F.filter("features", lambda f: f["critical"]), lambda f: f["id"]), F.transform("plan", lambda p: p["feature"]))
    rules = [
        (F.size("features") < 5, "fewer than five features"),
        (F.col("mixed") & (F.size(F.array_except(F.array(F.lit("ltr"), F.lit("rtl")), "directions")) > 0), "mixed without both directions"),
        (F.size(covered) > 0, "critical features without a plan"),
        (F.exists("plan", lambda p: ~p["editable"]), "plan item is not editable"),
        (~F.coalesce("rendered", F.lit(False)), "not rendered"),
    ]
    return blueprints.withColumn("errors", F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules])))


def text_runs(html) -> F.Column:
    """Texts between tags; for markup that is not well-formed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.filter(F.transform(F.split(bare, r"<[^>]*>"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def shapes_xml(elements: DataFrame, *, key: str = "task_id") -> DataFrame:
    """(key, xml): one minimal document for each task from its elements, in order."""
    run = F.concat(
        F.when(F.col("kind") == "round_rect", F.lit('<wps:wsp><a:prstGeom prst="roundRect"/><w:p>')).otherwise(F.lit("<w:p>")),
        F.when(F.col("rtl"), F.lit('<w:pPr><w:bidi w:val="1"/></w:pPr>')).otherwise(F.lit("")),
        F.lit("<w:r>"), F.when(F.col("rtl"), F.lit("<w:rPr><w:rtl/></w:rPr>")).otherwise(F.lit("")), F.lit("<w:t>"), xml_escape(F.coalesce("text", F.lit(""))), F.lit("</w:t></w:r></w:p>"),
        F.when(F.col("kind") == "round_rect", F.lit("</wps:wsp>")).otherwise(F.lit("")),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", run.alias("x")))), lambda s: s["x"]), "")
    head = '<w:document xmlns:w="urn:w" xmlns:wps="urn:wps" xmlns:a="urn:a"><w:body>'
    return elements.groupBy(key).agg(F.concat(F.lit(head), body, F.lit("</w:body></w:document>")).alias("xml"))


def zip_documents(documents: DataFrame, *, key: str = "task_id") -> DataFrame:
    """(key, content): each document's XML in a package with its required parts."""

    def run(batches):
        for pdf in batches:
            out = []
            for xml in pdf["xml"]:
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(REQUIRED_PARTS[0], "<Types/>")
                    z.writestr(REQUIRED_PARTS[1], xml)
                out.append(data.getvalue())
            yield pd.DataFrame({key: pdf[key], "content": out})

    return documents.select(key, "xml").mapInPandas(run, f"{key} {dict(documents.dtypes)[key]}, content binary")


def zip_parts(files: DataFrame, *, key: str = "docx_id") -> DataFrame:
    """(key, name, content, error): the parts of each package; one row with an error where it cannot be read."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, content in zip(pdf[key], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        if (bad := z.testzip()) or not set(REQUIRED_PARTS) <= set(z.namelist()):
                            rows.append((k, bad, None, "PACKAGE_INTEGRITY"))
                        else:
                            rows += [(k, n, z.read(n), None) for n in sorted(z.namelist())]
                except (zipfile.BadZipFile, TypeError):
                    rows.append((k, None, None, "PACKAGE_OPEN"))
            yield pd.DataFrame(rows, columns=[key, "name", "content", "error"])

    return files.select(key, "content").mapInPandas(run, f"{key} {dict(files.dtypes)[key]}, name string, content binary, error string")

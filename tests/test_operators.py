"""Oracles and one mutation a gate, over small inline rows."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.functions import text as t
from plumbline.operators import aggregates, documents, folds, gates, joins, requests, scenes, windows

NODE = "scene_id string, id string, type string, x double, y double, w double, h double, z int, parent string, ordinal int"


def nodes(spark, rows):
    return spark.createDataFrame(rows, NODE)


def test_displacement_fails_alignment(spark):
    a = nodes(spark, [("s", "n", "text", 0.1, 0.1, 0.2, 0.2, 0, None, 0), ("s", "m", "text", 0.5, 0.5, 0.2, 0.2, 0, None, 1)])
    b = nodes(spark, [("s", "n", "text", 0.22, 0.1, 0.2, 0.2, 0, None, 0)])
    got = {r["id"]: r["max_error"] for r in joins.align(a, b).collect()}
    assert got["n"] == pytest.approx(0.12) and got["m"] == 1.0
    assert not aggregates.extrema(joins.align(a, b)).first()["passed"]


def test_last_duplicate_counts(spark):
    a = nodes(spark, [("s", "n", "text", 0.1, 0.1, 0.2, 0.2, 0, None, 0)])
    b = nodes(spark, [("s", "n", "text", 0.9, 0.1, 0.2, 0.2, 0, None, 0), ("s", "n", "text", 0.1, 0.1, 0.2, 0.2, 0, None, 1)])
    assert joins.align(a, b).first()["max_error"] == 0.0


def test_four_tiles(spark):
    tiles = nodes(spark, [("s", f"t{i}", "image", x, y, 0.5, 0.5, 0, None, i) for i, (x, y) in enumerate([(0.0, 0.0), (0.5, 0.0), (0.0, 0.5), (0.5, 0.5)])])
    row = aggregates.tiling(tiles).first()
    assert row["tiled"] and row["area"] >= 0.99


def test_union_area_of_random_boxes(spark):
    rng = random.Random(3)
    rows = [(f"s{i % 4}", f"n{i}", "image", rng.random() * 0.8, rng.random() * 0.8, 0.05 + rng.random() * 0.4, 0.05 + rng.random() * 0.4, 0, None, i) for i in range(40)]
    got = {r["scene_id"]: r["area"] for r in aggregates.union_area(nodes(spark, rows)).collect()}
    for s, area in got.items():
        boxes = [(x, y, min(1, x + w), min(1, y + h)) for k, _, _, x, y, w, h, *_ in rows if k == s]
        xs, ys = sorted({v for b in boxes for v in (b[0], b[2])}), sorted({v for b in boxes for v in (b[1], b[3])})
        want = sum((x1 - x0) * (y1 - y0) for x0, x1 in zip(xs, xs[1:]) for y0, y1 in zip(ys, ys[1:]) if any(b[0] <= x0 and b[2] >= x1 and b[1] <= y0 and b[3] >= y1 for b in boxes))
        assert area == pytest.approx(want)


def test_relations_with_missing_end(spark):
    a = nodes(spark, [("s", "a", "text", 0.1, 0.1, 0.2, 0.2, 0, None, 0), ("s", "b", "text", 0.3, 0.1, 0.2, 0.3, 0, None, 1)])
    kinds = [("align_top", "b", 0.0), ("adjacent_x", "b", 0.0), ("equal_height", "b", 0.1), ("inside", "b", 0.2), ("inside", "zz", 1.0), ("nothing", "b", 1.0)]
    c = spark.createDataFrame([("s", i, k, "a", b) for i, (k, b, _) in enumerate(kinds)], "scene_id string, idx int, type string, source string, target string")
    got = {r["idx"]: r["error"] for r in joins.relations(c, a).collect()}
    for i, (_, _, want) in enumerate(kinds):
        assert got[i] == pytest.approx(want)


def evidence(spark, **change):
    good = dict(audit_complete=True, package_integrity=True, source_reference_embedded=False, largest_raster=0.0, total_raster=0.0, raster_tiling=False, native_text_ratio=1.0, node_coverage=1.0, native_area_ratio=1.0, monolithic=False, unjustified_rasters=0, raster_text_complete=True, raster_text_regions=0, duplicate_text_layers=0, exclusivity=1.0, nonwhite=0.5, pages=1, aspect_error=0.0, alignment_error=0.0, relation_error=0.0, border_coverage=1.0, contrast=21.0, edge_f1=1.0, palette_delta=0.0, ssim=1.0, text_complete=True, text_coverage=1.0)
    good.update(change)
    return spark.range(1).select(F.lit("s").alias("scene_id"), *[F.lit(v).alias(k) for k, v in good.items()])


MUTATIONS = [
    ({}, "PASS", None), (dict(source_reference_embedded=True), "EDITABILITY_FAILED", "G_NO_SOURCE_REFERENCE_EMBED"), (dict(raster_tiling=True), "EDITABILITY_FAILED", "G_NO_FULL_PAGE_RASTER"),
    (dict(native_text_ratio=0.9), "EDITABILITY_FAILED", "G_VISIBLE_TEXT_NATIVE"), (dict(monolithic=True), "EDITABILITY_FAILED", "G_OBJECT_EDITABILITY"), (dict(pages=2), "FIDELITY_FAILED", "R_SINGLE_PAGE"),
    (dict(alignment_error=0.12), "FIDELITY_FAILED", "G_ALIGNMENT"), (dict(contrast=2.9), "FIDELITY_FAILED", "V_CONTRAST"), (dict(ssim=0.4), "FIDELITY_FAILED", "V_STRUCTURE"),
    (dict(audit_complete=False), "VALIDATION_INCOMPLETE", "G_PACKAGE_MEDIA_AUDIT"), (dict(text_complete=False), "VALIDATION_INCOMPLETE", "V_TEXT_COVERAGE"),
]


@pytest.mark.parametrize("change,status,gate", MUTATIONS)
def test_one_mutation_a_gate(spark, change, status, gate):
    row = gates.report(evidence(spark, **change)).first()
    assert row["status"] == status and len(row["gates"]) == 23
    assert gate is None and row["findings"] == [] or gate in row["findings"]


def test_evidence_and_incomplete(spark):
    rep = gates.report(evidence(spark))
    assert gates.evidence_complete(rep).count() == 1
    off = gates.incomplete(rep).first()
    assert off["status"] == "VALIDATION_INCOMPLETE" and off["gates"]["G_PACKAGE_MEDIA_AUDIT"] is False


def test_scene_errors_in_order(spark):
    rows = [("a", "n", "text", 0.1, 0.1, 0.2, 0.2, 0, None, 0), ("b", "n", "circle", 0.1, 0.1, 2.0, 0.2, 0, None, 0), ("c", "n", "text", 0.1, 0.1, 0.2, 0.2, 0, "gone", 0), ("d", "n", "text", 0.1, 0.1, 0.2, 0.2, 0, None, 0), ("d", "n", "text", 0.1, 0.1, 0.2, 0.2, 0, None, 1), ("e", "n", "text", 0.9, 0.1, 0.2, 0.2, 0, None, 0), ("f", " ", "text", 0.1, 0.1, 0.0, 0.2, None, None, 0)]
    n = nodes(spark, rows)
    found = scenes.violations(n)
    got = {r["scene_id"]: r["code"] for r in scenes.first_error(found).collect()}
    assert got == {"b": "SCENE_NODE_TYPE", "c": "SCENE_REFERENCE", "d": "SCENE_DUPLICATE_ID", "e": "SCENE_BOUNDS", "f": "SCENE_NODE_ID"}
    assert [r["scene_id"] for r in scenes.valid(n, found).collect()] == ["a"]


def test_widths_and_directions(spark):
    rows = [("اكتب هنا",), ("Ab 1.",), ("漢字",), (None,), ("",), ("ab\nabcd",)]
    df = spark.createDataFrame(rows, "s string").select(t.width_units(F.col("s")).alias("u"), t.max_line_units(F.col("s")).alias("m"), t.direction(F.col("s")).alias("d")).collect()
    assert df[0]["u"] < 4 and df[0]["d"] == "rtl"
    assert df[1]["u"] == pytest.approx(0.67 + 0.52 + 0.32 + 0.56 + 0.34) and df[2]["u"] == 2.0
    assert df[3]["u"] == 0 and df[4]["m"] == 0.5 and df[5]["m"] == pytest.approx(4 * 0.52)


def test_strings(spark):
    one = lambda e: spark.range(1).select(e.alias("v")).first()["v"]
    assert one(t.normalize(F.lit("  A  Straße "))) == "a strasse"
    assert one(t.key(F.lit("Ab-1 ك!"))) == "ab1ك"
    assert one(t.filename(F.lit("a/b c.docx"))) == "a-b-c.docx" and one(t.filename(F.lit("///"))) == "document.docx"
    assert one(t.redact_secret(F.lit("x access_token=abc&y"))) == "x access_token=[REDACTED]&y"
    assert one(t.xml_escape(F.lit("<a&\"'>"))) == "&lt;a&amp;&quot;&#x27;&gt;"
    assert one(t.seq_ratio(F.lit("Schedule"), F.lit("Schedu1e"))) == pytest.approx(0.875)
    assert one(t.hex_to_rgb(F.lit("#10ff0A")))["g"] == 255 and one(t.rgb_to_hex(F.lit(16), F.lit(255), F.lit(10))) == "#10ff0a"
    assert one(g.quantize(F.lit(250), 16)) == 248 and one(g.hamming(F.lit(5), F.lit(6))) == 2


def test_urls_types_and_jobs(spark):
    urls = {"https://a.example/x": "OK", "http://a.example": "REF_HTTPS_REQUIRED", "https://localhost/": "REF_PRIVATE_ADDRESS", "https://x.local": "REF_PRIVATE_ADDRESS", "https://10.1.2.3/": "REF_PRIVATE_ADDRESS", "https://172.20.0.1": "REF_PRIVATE_ADDRESS", "https://172.32.0.1": "OK", "https://[fd00::1]/": "REF_PRIVATE_ADDRESS", "https://8.8.8.8/": "OK"}
    got = {r["u"]: r["c"] for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", requests.url_code(F.col("u")).alias("c")).collect()}
    assert got == urls
    heads = {bytes.fromhex("89504E470D0A1A0A00"): "image/png", b"\xff\xd8\xff\xe0": "image/jpeg", b"RIFF1234WEBP": "image/webp", b"%PDF-1.7": "application/pdf", b"hello": "unsupported"}
    for b, m in heads.items():
        assert spark.range(1).select(requests.mime(F.lit(bytearray(b))).alias("m")).first()["m"] == m
    jobs = spark.createDataFrame([("j", 1, "2024-01-01 00:00:00", "PROCESSING", None), ("j", 2, "2024-01-01 00:00:00", "FAILED", "ODD"), ("k", 3, "2024-01-02 00:00:00", "FAILED", "PACKAGE_INVALID")], "job_id string, event_id long, ts string, status string, error_code string").withColumn("ts", F.to_timestamp("ts"))
    assert {r["job_id"]: r["response"] for r in requests.response(requests.latest(jobs)).collect()} == {"j": "VALIDATION_INCOMPLETE", "k": "PACKAGE_INVALID"}
    assert [r["expired"] for r in requests.with_expiry(jobs, "2024-01-02 00:00:00").orderBy("event_id").collect()] == [True, True, False]


def test_folds_and_windows(spark):
    rows = [("s", "a", "rectangle", 0.1, 0.1, 0.2, 0.2, 0, None, 0), ("s", "b", "rectangle", 0.1, 0.1, 0.2, 0.21, 0, None, 1), ("s", "c", "image", 0.1, 0.1, 0.2, 0.2, 0, None, 2), ("u", "d", "rectangle", 0.1, 0.1, 0.2, 0.2, 0, None, 0)]
    assert sorted(r["id"] for r in folds.fold(nodes(spark, rows), folds.keep_visuals).collect()) == ["a", "c", "d"]
    assert folds.regular_run([10, 20, 30, 33, 40]) == [10, 20, 30, 40] and folds.regular_run([5]) == []
    v = spark.createDataFrame([("s", x) for x in (1, 3, 6, 20, 21)], "scene_id string, value int")
    assert [(r["centre"], r["n"]) for r in windows.clusters(v).orderBy("grp").collect()] == [(3, 3), (20, 2)]
    one = nodes(spark, [("s", "g", "grid", 0.0, 0.0, 1.0, 1.0, 0, None, 0)]).withColumn("rows", F.lit(1)).withColumn("columns", F.lit(3))
    assert sorted(r["id"] for r in windows.grid_lines(one).collect()) == ["g-column-1", "g-column-2"]


def test_writer_passes_its_own_checks(spark):
    els = spark.createDataFrame([("t", i, "round_rect", f"a<{i}", i % 2 == 0) for i in range(6)], "task_id string, ordinal int, kind string, text string, rtl boolean")
    docs = documents.shapes_xml(els)
    parts = documents.zip_parts(documents.zip_documents(docs).withColumnRenamed("task_id", "docx_id")).where("name = 'word/document.xml'")
    row = documents.structure(parts.select("docx_id", F.col("content").cast("string").alias("xml"), F.lit(0).alias("n_media"), F.lit(6).alias("expected_round_rects"), F.lit(True).alias("forbid_media"), F.lit(True).alias("forbid_tables"))).first()
    assert row["status"] == "PASS" and row["findings"] == [] and row["round_rects"] == 6 and row["text"] == "".join(f"a<{i}" for i in range(6))
    bad = spark.createDataFrame([("x", bytearray(b"no zip")), ("y", None)], "docx_id string, content binary")
    assert {r["error"] for r in documents.zip_parts(bad).collect()} == {"PACKAGE_OPEN"}


def test_empty_tables(spark):
    empty = nodes(spark, [])
    assert joins.align(empty, empty).count() == 0 and aggregates.union_area(empty).count() == 0 and folds.fold(empty, folds.keep_texts).count() == 0


def test_regular_run_takes_all_lines(spark, tmp_path):
    from itertools import combinations

    from plumbline.plans.queries import QUERIES

    def even(run):
        gaps = sorted(b - a for a, b in zip(run, run[1:], strict=False))
        m = gaps[len(gaps) // 2]
        return m > 4 and all(abs(g - m) <= max(5, 0.45 * m) for g in gaps)

    rng = random.Random(3)
    for _ in range(150):
        pos = sorted(rng.randrange(rng.choice([12, 40, 100, 600])) for _ in range(rng.randrange(12)))
        runs = next((r for n in range(len(pos), 2, -1) if (r := [c for c in combinations(pos, n) if even(c)])), [])
        assert folds.regular_run(pos) == list(max(runs, key=lambda c: c[-1] - c[0], default=[])), pos
    lines = list(range(5, 500, 20))
    spark.createDataFrame([(7, x) for x in [*lines, 131]], "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r["pos"] for r in QUERIES["regular_run"](spark, str(tmp_path)).collect()) == lines


def test_relations_do_not_depend_on_which_comes_first(spark):
    a = nodes(spark, [("s", "a", "text", 0.5, 0.1, 0.2, 0.2, 0, None, 0), ("s", "b", "text", 0.3, 0.3, 0.2, 0.3, 0, None, 1)])
    c = spark.createDataFrame([("s", i, k, "a", "b") for i, k in enumerate(("adjacent_x", "gap_x", "adjacent_y", "gap_y"))], "scene_id string, idx int, type string, source string, target string")
    assert [r["error"] for r in joins.relations(c, a).orderBy("idx").collect()] == pytest.approx([0, 0, 0, 0])


def test_scene_rules_of_page_and_constraints(spark):
    ok = ("n", "text", 0.1, 0.1, 0.2, 0.2, 0, None, 0)
    n = nodes(spark, [(s, *ok) for s in "abcdefg"])
    pages = spark.createDataFrame([("a", "scene-graph.v1", 4.0, 3.0, None), ("b", "v0", 4.0, 3.0, None), ("c", "scene-graph.v1", 0.0, 3.0, None), ("z", "scene-graph.v1", 4.0, 3.0, "landscape"), *[(s, "scene-graph.v1", 4.0, 3.0, "portrait") for s in "defg"]], "scene_id string, version string, width double, height double, orientation string")
    cons = spark.createDataFrame([("a", 0, "inside", "n", "n", 0.1), ("d", 0, "inside", "n", "gone", 0.1), ("e", 0, "odd", "n", "gone", 0.1), ("f", 0, "inside", "n", "n", 2.0), ("g", 0, "inside", "n", "n", None)], "scene_id string, idx int, type string, source string, target string, tolerance double")
    found = scenes.violations(n, cons, relations=g.RELATIONS, pages=pages)
    got = {r["scene_id"]: r["code"] for r in scenes.first_error(found).collect()}
    assert got == {"b": "SCENE_VERSION", "c": "SCENE_PAGE", "z": "SCENE_NODES", "d": "SCENE_REFERENCE", "e": "SCENE_CONSTRAINT", "f": "SCENE_CONSTRAINT"}


def test_scene_rules_of_text_style_image_and_grid(spark):
    base = dict(type="text", value="a", direction="ltr", align="left", font_size_pt=12.0, weight=400, color="#000000", stroke_width=0.0, corner_radius=0.0, opacity=1.0, fill=None, stroke=None, content_ref="r", raster_justification=None, rows=1, columns=1)
    cases = [({}, None), ({"value": None}, "SCENE_TEXT"), ({"align": "middle"}, "SCENE_TEXT"), ({"weight": 950}, "SCENE_TEXT"), ({"font_size_pt": 0.0}, "SCENE_TEXT"), ({"color": "red"}, "SCENE_COLOR"), ({"type": "line", "opacity": 1.5}, "SCENE_STYLE"), ({"type": "line", "fill": "#12"}, "SCENE_COLOR"), ({"type": "image", "content_ref": ""}, "SCENE_IMAGE"), ({"type": "image", "raster_justification": "other"}, "SCENE_IMAGE"), ({"type": "grid", "rows": 0}, "SCENE_GRID"), ({"type": "line", "value": None}, None)]
    kinds = "type string, value string, direction string, align string, font_size_pt double, weight int, color string, stroke_width double, corner_radius double, opacity double, fill string, stroke string, content_ref string, raster_justification string, rows int, columns int"
    rows = [(f"s{i}", "n", 0.1, 0.1, 0.2, 0.2, 0, None, 0, True, *{**base, **c}.values()) for i, (c, _) in enumerate(cases)]
    n = spark.createDataFrame(rows, "scene_id string, id string, x double, y double, w double, h double, z int, parent string, ordinal int, editable boolean, " + kinds)
    got = {r["scene_id"]: r["code"] for r in scenes.first_error(scenes.violations(n)).collect()}
    assert got == {f"s{i}": code for i, (_, code) in enumerate(cases) if code}


def test_types_scopes_and_failures(spark):
    one = lambda e: spark.range(1).select(e.alias("v")).first()["v"]
    png = F.lit(bytearray(bytes.fromhex("89504E470D0A1A0A00")))
    none = F.lit(None).cast("string")
    assert one(requests.content_code(png, F.lit("image/PNG; q=1"), none)) == "OK"
    assert one(requests.content_code(png, F.lit("image/jpeg"), none)) == "REF_MIME_MISMATCH"
    assert one(requests.content_code(png, none, F.lit("image/jpeg"))) == "REF_MIME_MISMATCH" and one(requests.content_code(png, none, F.lit("text/html"))) == "OK"
    assert one(requests.content_code(F.lit(bytearray(b"hello")), none, none)) == "REF_TYPE_UNSUPPORTED"
    lits = lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(requests.narrowed_scopes(lits("b", "x", "a", "b"), lits("a", "b"))) == ["b", "a"] and one(requests.narrowed_scopes(lits("x"), lits("a"))) is None
    assert one(requests.principal_code(F.lit("p"), lits("draw"), F.lit("o"), F.lit("o"), "draw")) == "OK"
    assert one(requests.principal_code(none, lits("draw"), F.lit("o"), F.lit("o"), "draw")) == "auth_required"
    assert one(requests.principal_code(F.lit("p"), lits("x"), F.lit("o"), F.lit("o"), "draw")) == "forbidden_scope"
    assert one(requests.principal_code(F.lit("p"), lits("draw"), F.lit("q"), F.lit("o"), "draw")) == "resource_audience_mismatch"
    assert one(requests.numeric_ids(F.lit("1, 02,3,1,x"))) == ["1", "3"]
    assert one(requests.failure_status(F.lit("PACKAGE_INVALID"), F.lit("ODD"), F.lit(True))) == "PACKAGE_INVALID" and one(requests.failure_status(F.lit("PACKAGE_INVALID"), none, F.lit(False))) == "VALIDATION_INCOMPLETE"
    assert one(requests.error_code(F.lit("PASS"))) == "FIDELITY_FAILED"
    jobs = spark.createDataFrame([("j",), ("k",)], "job_id string")
    flows = spark.createDataFrame([("j", "errored", None, "see https://a.b/c " + "k" * 40)], "job_id string, status string, error_name string, error_message string")
    got = {r["job_id"]: r for r in requests.with_workflow(jobs, flows).collect()}
    assert got["j"]["workflow_error"]["message"] == "see [url] [redacted]" and got["j"]["workflow_error"]["name"] == "Error"
    assert got["k"]["workflow_status"] == "unknown" and got["k"]["workflow_error"] is None


def test_strings_as_the_contract_has_them(spark):
    one = lambda e: spark.range(1).select(e.alias("v")).first()["v"]
    assert one(t.redact(F.lit("x HTTPS://a.b/c  " + "k" * 32))) == "x [url] [redacted]"
    assert one(t.redact_secret(F.lit("zipcode=1 code=2&x"))) == "zipcode=1 code=[REDACTED]&x"
    assert one(t.filename(F.lit("a.DOCX"))) == "a.DOCX.docx"
    assert one(t.width_units(F.lit("⺀。é́"))) == pytest.approx(1.0 + 1.0 + 0.52)
    assert one(t.sha256(F.lit("abc"))).startswith("ba7816bf")
    rgb = lambda r, g_, b: F.struct(F.lit(r).alias("r"), F.lit(g_).alias("g"), F.lit(b).alias("b"))
    assert tuple(one(g.color_delta(rgb(10, 20, 30), rgb(0, 40, 30)))) == (30, 20)
    assert one(g.aspect_error(F.lit(4.0), F.lit(3.0), F.lit(8.0), F.lit(6.0))) == 0


def test_structure_gates_one_by_one(spark):
    shape = lambda text, marks="": f"<wps:wsp><w:p>{marks}<w:r><w:rPr>{'<w:rtl/>' if marks else ''}</w:rPr><w:t>{text}</w:t></w:r></w:p></wps:wsp>"
    doc = lambda body: f'<w:document xmlns:w="urn:w" xmlns:wps="urn:wps" xmlns:a="urn:a" xmlns:wp="urn:wp"><w:body>{body}</w:body></w:document>'
    good = doc('<wp:docPr name="Header"/><a:prstGeom prst="roundRect"/>' + shape("a &amp; b", '<w:pPr><w:bidi w:val="1"/></w:pPr>') + "<w:p><w:r><w:t>plain</w:t></w:r></w:p>")
    cases = {
        "good": (good, 0, []), "none": (None, 0, ["S-01"]), "media": (good, 1, ["S-02"]), "rects": (good.replace("roundRect", "rect"), 0, ["S-03"]), "text": (good.replace("plain", "x"), 0, ["S-04"]),
        "nested": (good.replace("a &amp; b", "c"), 0, ["S-04", "S-05", "S-08"]), "table": (good.replace("<w:body>", "<w:body><w:tbl/>"), 0, ["S-06"]), "break": (good.replace("<w:body>", '<w:body><w:br w:type="page"/>'), 0, ["S-07"]),
        "rtl": (good.replace('w:val="1"', 'w:val="0"'), 0, ["S-08"]), "names": (good.replace("Header", "Footer"), 0, ["S-09"]),
    }
    rows = [(k, x, n, 1, True, True, ["plain", "a & b"], ["a & b"], ["a & b"], ["Header"]) for k, (x, n, _) in cases.items()]
    df = spark.createDataFrame(rows, "docx_id string, xml string, n_media int, expected_round_rects int, forbid_media boolean, forbid_tables boolean, required_text array<string>, required_shape_text array<string>, rtl_shape_text array<string>, required_shape_names array<string>")
    got = {r["docx_id"]: (r["findings"], r["status"]) for r in documents.structure(df).collect()}
    assert got == {k: (f, "FAIL" if f else "PASS") for k, (_, _, f) in cases.items()}
    flags = {k: "PASS" for k in documents.RENDER_FLAGS}
    reports = spark.createDataFrame([("a", flags), ("b", None), ("c", {**flags, "rtl_layout": "FAIL"})], "id string, flags map<string,string>")
    assert {r["id"]: (r["finding"], r["missing"]) for r in documents.render_gate(reports).collect()} == {"a": (None, []), "b": ("V-00", sorted(documents.RENDER_FLAGS)), "c": ("V-01", ["rtl_layout"])}


def test_evidence_needs_gates_and_measures(spark):
    rep = gates.report(evidence(spark))
    assert gates.evidence_complete(rep).count() == 1
    assert gates.evidence_complete(rep.withColumn("editability", F.col("editability").withField("total_raster", F.lit(None).cast("double")))).count() == 0
    assert gates.evidence_complete(gates.report(evidence(spark, ssim=0.1))).count() == 0 and gates.evidence_complete(gates.incomplete(rep)).count() == 0
    bad = gates.report(evidence(spark, contrast=1.0, raster_tiling=True, package_integrity=True)).first()
    assert {h["gate"]: h["action"] for h in bad["correction_hints"]}["V_CONTRAST"] == "increase foreground-background contrast"
    assert gates.report(evidence(spark, package_integrity=False)).first()["status"] == "VALIDATION_INCOMPLETE"
    assert gates.report(evidence(spark, raster_text_complete=False)).first()["status"] == "EDITABILITY_FAILED"
    m = spark.createDataFrame([("a", True, 0.5, 1), ("b", True, 0.001, 2), ("c", False, None, None)], "id string, opened boolean, nonwhite double, pages int")
    assert {r["id"]: r["failed_gates"] for r in gates.reopened(m).collect()} == {"a": [], "b": ["R_NONBLANK", "R_SINGLE_PAGE"], "c": ["R_REOPEN"]}
    one = lambda e: spark.range(1).select(e.alias("v")).first()["v"]
    assert one(gates.word_ratio(F.lit(3), F.lit(2))) == 1 and one(gates.word_ratio(F.lit(3), F.lit(0))) == 1 and one(gates.word_ratio(F.lit(None).cast("int"), F.lit(2))) is None
    ink = spark.createDataFrame([("s", 0.1, 0.05), ("s", 0.1, 0.01), ("u", 0.001, 0.5)], "scene_id string, reference_density double, rendered_density double")
    assert {r["scene_id"]: (r["text_complete"], r["text_coverage"]) for r in gates.text_coverage(ink).collect()} == {"s": (True, 0.5), "u": (False, 1.0)}

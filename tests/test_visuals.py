"""Filters, projections, unions, grid lines and components over small inline rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import aggregates, joins, package, rasters, visuals

BOX = "scene_id string, id string, type string, x double, y double, w double, h double, ordinal int"


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_filters_at_their_limits(spark):
    lines = spark.createDataFrame([(9,), (10,), (990,), (991,)], "pos int")
    assert [r["pos"] for r in visuals.within_margin(lines, F.lit(1000)).collect()] == [10, 990]
    words = spark.createDataFrame([("a", 3, None), ("b", 3, "c1"), ("c", 6, None)], "id string, pass int, cell string")
    assert ids(visuals.grid_words_only(words)) == ["b", "c"]
    comps = spark.createDataFrame([("ok", 100, 50, 4000), ("thin", 100, 9, 900), ("sparse", 100, 50, 3000), ("huge", 500, 400, 200000), ("narrow", 17, 50, 850)], "id string, w int, h int, area int").withColumn("page_area", F.lit(1_000_000))
    assert ids(visuals.solid_components(comps)) == ["ok"]
    assert ids(visuals.graphic_components(comps)) == ["narrow", "ok", "sparse"]
    flat = spark.createDataFrame([("a", 0.55, 0.55, 10), ("b", 0.54, 0.9, 99), ("c", 0.9, 0.9, 9)], "id string, d double, e double, f int")
    assert ids(flat.where(visuals.is_flat_shape(F.col("d"), F.col("e"), F.col("f")))) == ["a"]
    nodes = spark.createDataFrame([("a", "grid", "#000000", 1.0), ("b", "line", "#000000", 1.0), ("c", "ellipse", None, 1.0), ("d", "rectangle", "#000000", 0.0)], "id string, type string, stroke string, stroke_width double")
    assert ids(visuals.stroked(nodes)) == ["a"]


def test_panels_groups_and_families(spark):
    p = spark.createDataFrame([("s", "wide", "rectangle", 0.1, 0.1, 0.5, 0.1, 0, "#101010"), ("s", "small", "rectangle", 0.1, 0.1, 0.1, 0.04, 1, "#101010"), ("s", "light", "rectangle", 0.1, 0.1, 0.5, 0.1, 2, "#f0f0f0"), ("s", "text", "text", 0.1, 0.1, 0.5, 0.1, 3, "#101010"), ("s", "square", "rectangle", 0.1, 0.1, 0.1, 0.1, 4, "#101010")], BOX + ", fill string")
    got = {r["id"]: r["min_confidence"] for r in visuals.dark_panels(p, F.lit(1000.0), F.lit(1000.0)).collect()}
    assert got == {"wide": 10, "small": 20}
    c = spark.createDataFrame([("s", "a", "red", False), ("s", "b", "red", False), ("s", "c", "blue", False), ("s", "d", "green", True)], "scene_id string, id string, color string, overlaps boolean")
    assert ids(visuals.group_gate(c)) == ["a", "b", "d"]
    f = spark.createDataFrame([("s", "a", 0.1, 0.05, 12, 200.0), ("s", "b", 0.1, 0.05, 3, 200.0), ("s", "c", 0.2, 0.05, 1, 50.0), ("u", "d", 0.1, 0.05, 3, 200.0), ("u", "e", 0.1, 0.02, 3, 200.0)], "scene_id string, id string, w double, h double, support int, mean double")
    assert ids(visuals.family_floor(f, F.lit(1000.0), F.lit(1000.0))) == ["a", "c", "d"]


def test_projections(spark):
    n = spark.createDataFrame([("a", "line", "#111111", "#222222", 2.0), ("b", "rectangle", "#111111", "#222222", 2.0)], "id string, type string, fill string, stroke string, stroke_width double")
    got = {r["id"]: (r["fill"], r["stroke"], r["stroke_width"]) for r in visuals.line_as_rect(n).collect()}
    assert got == {"a": ("#222222", None, 0.0), "b": ("#111111", "#222222", 2.0)}
    one = lambda e: spark.range(1).select(e.alias("v")).first()["v"]
    assert one(visuals.weight_of(F.lit(35.0), F.lit(1000.0))) == 600 and one(visuals.weight_of(F.lit(34.0), F.lit(1000.0))) == 400
    assert tuple(one(visuals.draw_style(F.lit("#AABBCC"), F.lit("#000000"), F.lit(0.0), F.lit(0.25)))) == ("SOLID", "#aabbcc", "NONE", None, None, 75)
    assert one(visuals.draw_style(F.lit(None).cast("string"), F.lit("#000000"), F.lit(1.5), F.lit(None).cast("double")))["line_width"] == 53
    shapes = spark.createDataFrame([("s", 0, "", None, None, None, 10.0, 20.0, 50.0, 40.0), ("s", 1, "n", "Frame", 5.0, 5.0, None, None, 20.0, 10.0)], "scene_id string, index int, name string, shape_type string, x double, y double, anchor_x double, anchor_y double, w double, h double")
    shapes = shapes.withColumns({"frame_w": F.lit(None).cast("double"), "frame_h": F.lit(None).cast("double"), "page_width": F.lit(100.0), "page_height": F.lit(200.0)})
    rows = [tuple(r)[1:] for r in visuals.recovered(shapes).orderBy("ordinal").collect()]
    assert rows == [(0, "shape-0", "unknown", 0.1, 0.1, 0.5, 0.2), (1, "n", "Frame", 0.05, 0.025, 0.2, 0.05)]
    boxes = spark.createDataFrame([("s", "a", "text", 0.1, 0.1, 0.2, 0.2, 0), ("s", "b", "image", 0.1, 0.1, 0.2, 0.2, 1)], BOX)
    assert [tuple(r) for r in visuals.redactions(boxes, F.lit(100.0), F.lit(100.0)).collect()] == [("s", 8, 8, 32, 32)]


def test_unions_and_choices(spark):
    a = spark.createDataFrame([("s", "a", "text", 0.0, 0.0, 0.1, 0.1, 5), ("s", "b", "image", 0.0, 0.0, 0.1, 0.1, 7)], BOX)
    b = spark.createDataFrame([("s", "c", 0, "#000000")], "scene_id string, id string, ordinal int, fill string")
    u = visuals.union_nodes(a, b)
    assert [(r["id"], r["ordinal"], r["fill"]) for r in u.orderBy("ordinal").collect()] == [("a", 0, None), ("b", 1, None), ("c", 2, "#000000")]
    back = spark.createDataFrame([("s", "bg", "image", 0)], "scene_id string, id string, type string, ordinal int")
    assert ids(visuals.prepend(a, back)) == ["a", "b", "bg"] and ids(visuals.prepend(a, back, drop_images=True)) == ["a", "bg"]
    texts = spark.createDataFrame([("s", "t", "text", 0.0, 0.0, 0.2, 0.1, 0), ("s", "far", "text", 0.8, 0.8, 0.1, 0.1, 1)], BOX)
    comps = spark.createDataFrame([("s", "x", "c", 0.0, 0.0, 0.1, 0.1, 0), ("s", "y", "c", 0.1, 0.0, 0.1, 0.1, 1)], BOX)
    assert [(r["id"], r["component"]) for r in visuals.best_panel(texts, comps).collect()] == [("t", 0)]
    reads = spark.createDataFrame([("p", 0, "ab", 50.0), ("p", 1, "abcdefgh", 45.0), ("q", 0, "x", 1.0)], "panel_id string, ordinal int, text string, conf double")
    assert {r["panel_id"]: r["text"] for r in visuals.panel_text(reads).collect()} == {"p": "abcdefgh", "q": "x"}


def test_grid_lines_cross_and_continue(spark):
    ink = [(1, x, y) for x in (10, 20, 30, 40) for y in range(0, 60)] + [(1, x, y) for y in (5, 15, 25, 35) for x in range(10, 41)] + [(1, 50, y) for y in range(0, 4)] + [(1, x, 45) for x in range(10, 20)]
    df = spark.createDataFrame(ink, "page_id int, x int, y int").distinct()
    v = spark.createDataFrame([(1, x) for x in (10, 20, 30, 40, 50)], "page_id int, pos int")
    h = spark.createDataFrame([(1, y) for y in (5, 15, 25, 35)], "page_id int, pos int")
    vs, hs = rasters.grid_lines(v, h, df)
    assert sorted(r["pos"] for r in vs.collect()) == [10, 20, 30, 40] and sorted(r["pos"] for r in hs.collect()) == [5, 15, 25, 35]
    rows = spark.createDataFrame([(1, 5), (1, 45)], "page_id int, pos int")
    assert [r["pos"] for r in rasters.continuous_rows(rows, vs, df).collect()] == [5]
    pixels = spark.createDataFrame([(1, x, y, x == 3 or y > 7) for x in range(10) for y in range(10)], "page_id int, x int, y int, on boolean")
    assert [r["pos"] for r in rasters.line_projection(pixels, "x", 0.4).collect()] == [3]


def test_components_and_morphology(spark):
    rng = random.Random(6)
    for _ in range(40):
        width = rng.randrange(1, 14)
        m = np.array([[rng.random() < 0.45 for _ in range(width)] for _ in range(rng.randrange(1, 14))], bool)
        seen, want = set(), []
        for y, x in zip(*np.nonzero(m), strict=True):
            if (y, x) in seen:
                continue
            todo, own = [(int(y), int(x))], set()
            while todo:
                p = todo.pop()
                if p in own or not (0 <= p[0] < m.shape[0] and 0 <= p[1] < m.shape[1]) or not m[p]:
                    continue
                own.add(p)
                todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            seen |= {(a, b) for a, b in own}
            ys, xs = [p[0] for p in own], [p[1] for p in own]
            want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(own)))
        assert sorted(rasters.components_of(m)) == sorted(want)
        grown = rasters.shifted(m, 3, True)
        assert all(grown[y, x] == m[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].any() for y in range(m.shape[0]) for x in range(m.shape[1]))
    dot = np.zeros((9, 9), bool)
    dot[4, 4] = dot[1:4, 6:9] = True
    assert not rasters.opened(dot, 3)[4, 4] and rasters.opened(dot, 3)[2, 7] and rasters.closed(dot, 3)[4, 4]
    df = spark.createDataFrame([(1, 3, [True, False, True] * 2), (2, 3, None), (3, None, [True])], "page_id int, width int, on array<boolean>")
    assert [tuple(r) for r in rasters.mask_components(df).orderBy("ordinal").collect()] == [(1, 0, 0, 0, 1, 2, 2, 6), (1, 1, 2, 0, 1, 2, 2, 6)]


def test_package_audit_mutations(spark):
    node = "scene_id string, id string, type string, x double, y double, w double, h double, ordinal int, value string, raster_justification string, content_ref string"
    scene = [("s", "t", "text", 0.1, 0.1, 0.2, 0.1, 0, "Hello  World", None, None), ("s", "r", "rectangle", 0.1, 0.3, 0.2, 0.1, 1, None, None, None), ("s", "p", "image", 0.5, 0.5, 0.2, 0.2, 2, None, "source_artwork", "reference-region:1")]
    objects = [("s", "t", "CustomShape", 0.1, 0.1, 0.2, 0.1, 0), ("s", "r", "CustomShape", 0.1, 0.3, 0.2, 0.1, 1), ("s", "p", "GraphicObjectShape", 0.5, 0.5, 0.2, 0.2, 2)]

    def run(scene=scene, objects=objects, media=(("s", "word/media/a.png", 255),), text="hello world again", read=(("s", "p", ""),), integrity=True):
        pages = spark.createDataFrame([("s", integrity, 0)], "scene_id string, integrity boolean, dhash long")
        made = lambda rows, kind: spark.createDataFrame(list(rows), kind)
        out = package.audit(pages, made(scene, node), made([(s, i, k, x, y, w, h, o) for s, i, k, x, y, w, h, o in objects], "scene_id string, id string, shape_type string, x double, y double, w double, h double, ordinal int"), made(media, "scene_id string, name string, dhash long"), made([("s", text)], "scene_id string, text string"), made(read, "scene_id string, id string, text string"))
        return out.first().asDict()

    good = run()
    assert good["audit_complete"] and good["native_text_ratio"] == good["node_coverage"] == good["native_area_ratio"] == 1.0 and good["unjustified_rasters"] == 0 and good["exclusivity"] == 1.0
    whole = [*objects[:2], ("s", "p", "GraphicObjectShape", 0.0, 0.0, 1.0, 0.6, 2)]
    near = run(objects=whole, media=[("s", "word/media/a.png", 3)])
    assert near["source_reference_embedded"] and near["unjustified_rasters"] == 1 and near["largest_raster"] == pytest.approx(0.6) and near["total_raster"] == pytest.approx(0.6)
    assert run(objects=whole, media=[("s", "word/media/a.EMF", 255)])["monolithic"]
    assert run(text="other")["native_text_ratio"] == 0.0
    other = [scene[0], scene[1], (*scene[2][:9], None, "upload:1")]
    assert run(scene=other)["unjustified_rasters"] == 1
    dup = run(read=[("s", "p", "World cup")])
    assert dup["raster_text_regions"] == dup["duplicate_text_layers"] == 1 and dup["exclusivity"] == 0.0
    assert not run(read=[("s", "p", None)])["audit_complete"] and not run(integrity=False)["audit_complete"]


def test_operators_that_no_query_runs(spark):
    nodes = spark.createDataFrame([("s", "a", "text", 0.1, 0.1, 0.2, 0.1, 0, "Hello")], BOX + ", value string")
    actual = spark.createDataFrame([("s", "a", "text", 0.1, 0.1, 0.2, 0.1, 0)], BOX)
    texts = spark.createDataFrame([("s", "say hello there")], "scene_id string, text string")
    assert ids(joins.text_native(nodes, actual, texts)) == ["a"]
    need = spark.createDataFrame([("s", ["say", "absent"])], "scene_id string, required array<string>")
    assert [r["required"] for r in joins.required_text(need, texts).collect()] == ["absent"]
    m = spark.createDataFrame([("s", 0.1, None, 0.5, 5.0), ("s", 0.3, 0.2, None, 3.0), ("u", None, None, None, None)], "scene_id string, alignment_error double, relation_error double, border_coverage double, contrast double")
    assert {r["scene_id"]: tuple(r)[1:] for r in aggregates.page_extrema(m).collect()} == {"s": (0.3, 0.2, 0.5, 3.0), "u": (0.0, 0.0, 1.0, 21.0)}
    px = spark.createDataFrame([("s", 200, 10, 10)] * 3 + [("s", 255, 255, 255)] * 7, "scene_id string, r int, g int, b int").withColumns({f"bg_{c}": F.lit(255) for c in "rgb"})
    assert [tuple(r) for r in aggregates.color_histogram(px).collect()] == [("s", 204, 12, 12, 0.3)]

"""SQL for the registered queries, for a second engine over the same tables."""

from __future__ import annotations

_N = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS ordinal FROM lineitem),
laid AS (SELECT l_orderkey AS scene, printf('n%03d', ordinal) AS id, l_linenumber AS raw_id, ordinal,
  CASE WHEN l_returnflag = 'A' THEN 'text' WHEN l_returnflag = 'R' THEN 'rounded_rectangle' WHEN l_linestatus = 'O' THEN 'rectangle' ELSE 'image' END AS type,
  (l_partkey % 80) / 100.0::DOUBLE AS x, (l_suppkey % 80) / 100.0::DOUBLE AS y, 0.02::DOUBLE + l_quantity / 50 * 0.18::DOUBLE AS w, 0.02::DOUBLE + l_tax AS h,
  l_linenumber AS z, CASE WHEN ordinal > 1 THEN printf('n%03d', ordinal - 1) END AS parent, l_discount, l_returnflag, l_linenumber FROM numbered),
node AS (SELECT scene, id, raw_id, ordinal, type, x, y, w, h, z, parent FROM laid),
actual AS (SELECT scene, id, raw_id, ordinal, type, x + l_discount / 3 AS x, y, w, h, z, parent FROM laid WHERE NOT (l_returnflag = 'N' AND l_linenumber % 7 = 0)),
err AS (SELECT n.scene, n.id, coalesce(greatest(abs(n.x - a.x), abs(n.y - a.y), abs(n.w - a.w), abs(n.h - a.h)), 1.0) AS e FROM node n LEFT JOIN actual a ON n.scene = a.scene AND n.id = a.id),
rec AS (SELECT n.*, a.id IS NOT NULL AS hit FROM node n LEFT JOIN (SELECT DISTINCT scene, id FROM actual WHERE type <> 'image') a ON n.scene = a.scene AND n.id = a.id WHERE n.type NOT IN ('group', 'image')),
rel_names AS (SELECT ['align_left','align_right','align_top','align_bottom','align_center_x','align_center_y','equal_width','equal_height','adjacent_x','adjacent_y','gap_x','gap_y','inside'] AS l),
cons AS (SELECT scene, ordinal AS idx, l[((scene + ordinal) % 13 + 1)::INT] AS type, id AS source, lead(id) OVER (PARTITION BY scene ORDER BY ordinal) AS target FROM node, rel_names),
rel AS (SELECT c.scene, c.type, coalesce(CASE c.type WHEN 'align_left' THEN abs(s.x - t.x) WHEN 'align_right' THEN abs(s.x + s.w - (t.x + t.w)) WHEN 'align_top' THEN abs(s.y - t.y)
  WHEN 'align_bottom' THEN abs(s.y + s.h - (t.y + t.h)) WHEN 'align_center_x' THEN abs(s.x + s.w / 2 - t.x - t.w / 2) WHEN 'align_center_y' THEN abs(s.y + s.h / 2 - t.y - t.h / 2)
  WHEN 'equal_width' THEN abs(s.w - t.w) WHEN 'equal_height' THEN abs(s.h - t.h) WHEN 'adjacent_x' THEN least(abs(s.x + s.w - t.x), abs(t.x + t.w - s.x)) WHEN 'gap_x' THEN least(abs(s.x + s.w - t.x), abs(t.x + t.w - s.x))
  WHEN 'adjacent_y' THEN least(abs(s.y + s.h - t.y), abs(t.y + t.h - s.y)) WHEN 'gap_y' THEN least(abs(s.y + s.h - t.y), abs(t.y + t.h - s.y))
  WHEN 'inside' THEN CASE WHEN s.x IS NULL OR t.x IS NULL THEN NULL ELSE greatest(0, t.x - s.x, t.y - s.y, s.x + s.w - (t.x + t.w), s.y + s.h - (t.y + t.h)) END END, 1.0) AS e
  FROM cons c LEFT JOIN actual s ON c.scene = s.scene AND c.source = s.id LEFT JOIN actual t ON c.scene = t.scene AND c.target = t.id WHERE c.target IS NOT NULL)
"""
_PAIR = """
pair AS (SELECT p.scene, p.id AS a, q.id AS b, greatest(0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x)) * greatest(0, least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y)) AS i,
  p.w * p.h AS pa, q.w * q.h AS qa, p.type AS pt, q.type AS qt FROM node p JOIN node q ON p.scene = q.scene AND p.ordinal < q.ordinal)
"""
_W = """
split AS (SELECT doc_id AS page_id, unnest(string_split_regex(text, '[ \\n]')) AS text, generate_subscripts(string_split_regex(text, '[ \\n]'), 1) - 1 AS i FROM documents),
word AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 11 WHEN 1 THEN 3 ELSE 6 END AS pass, (i // 10)::INT AS line, i AS ordinal, ((i % 10) * 60 + i * 7 % 13 * 5)::INT AS "left",
  ((i // 10) * 20 + i * 5 % 7)::INT AS top, length(text) * 6 AS width, 10 + i % 5 AS height, 40.0::DOUBLE + (i * 37 + page_id * 11) % 60 AS conf, text FROM split),
line AS (SELECT page_id, pass, line, string_agg(text, ' ' ORDER BY "left", ordinal, text) AS text, min("left") AS "left", min(top) AS top, max("left" + width) AS "right", max(top + height) AS bottom, avg(conf) AS conf,
  avg(conf) + least(20.0::DOUBLE, 1.2::DOUBLE * sum(length(text))) AS score FROM word GROUP BY ALL)
"""
_R = """
px AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE AS rg FROM embeddings),
ras AS (SELECT vec_id, list_transform(e, lambda v: CASE WHEN rg = 0 THEN 0 ELSE round_even(255.0::DOUBLE * (v - lo) / rg, 0)::INT END) AS luma FROM px),
two AS (SELECT a.vec_id, a.luma AS a, b.luma AS b FROM ras a JOIN ras b ON b.vec_id = a.vec_id + 1)
"""
_G = """
gate AS (SELECT doc_id, unnest(['G_AUDIT', 'G_QUALITY', 'G_CLEAN', 'G_SIZE']) AS gate, unnest([0, 1, 2, 3]) AS o, unnest([doc_id % 11 <> 0, quality = 1, toxic = 0, n_chars >= 200]) AS passed FROM labels JOIN documents USING (doc_id))
"""
_J = """
job AS (SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'PASS' WHEN 'error' THEN 'FAILED' ELSE 'PROCESSING' END AS status FROM events),
last AS (SELECT * FROM job QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1)
"""
_LUM = "CASE WHEN {v} / 255.0::DOUBLE <= 0.04045 THEN {v} / 255.0::DOUBLE / 12.92 ELSE pow(({v} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
_NORM = r"replace(lower(trim(regexp_replace({c}, '[\x09-\x0D\x1c-\x20\x85\xA0]+', ' ', 'g'))), 'ß', 'ss')"


def _rank(share: float) -> str:
    return f"list_sort(luma)[round_even((len(luma) - 1) * {share}::DOUBLE, 0)::INT + 1]"


_HI, _LO = _LUM.format(v=_rank(0.998)), _LUM.format(v=_rank(0.002))
_BITS = "list_sum(list_transform(range(0, 71), lambda i: CASE WHEN i % 9 = 8 THEN 0 WHEN ({c}[i + 1] > {c}[i + 2]) <> ({d}[i + 1] > {d}[i + 2]) THEN 1 ELSE 0 END))"
_EDGES = "list_transform(range(0, 64), lambda i: CASE WHEN i % 8 = 0 OR i % 8 = 7 OR i < 8 OR i >= 56 THEN {c}[i + 1] ELSE greatest(0, least(255, 8 * {c}[i + 1] - ({c}[i - 8] + {c}[i - 7] + {c}[i - 6] + {c}[i] + {c}[i + 2] + {c}[i + 8] + {c}[i + 9] + {c}[i + 10]))) END)"
_CLASSES = (("\\p{M}", 0.0), ("\\x09-\\x0D\\x20\\x85\\xA0", 0.32), ("\u0600-\u06ff", 0.42), ("\u2e80-\u9fff\uac00-\ud7af", 1.0), ("\\p{Nd}", 0.56), ("\\p{Lu}", 0.67), ("\\p{Ll}", 0.52), ("\\p{P}", 0.34))


def _width(c: str) -> str:
    """Width units of a text whose classes do not overlap, as in the test tables."""
    return f"(length({c}) * 0.7::DOUBLE" + "".join(f" + (length({c}) - length(regexp_replace({c}, '[{k}]+', '', 'g'))) * {w - 0.7!r}::DOUBLE" for k, w in _CLASSES) + ")"


_LINES = "string_split_regex({c}, '\\r\\n|[\\n\\r\\x0b\\x0c]')"


def _widest(c: str) -> str:
    return f"greatest(0.5::DOUBLE, list_max(list_transform({_LINES.format(c=c)}, lambda s: {_width('s')})))"


def _union(p: str, boxes: str) -> str:
    """``p``_area (scene, a): the exact area of boxes (scene, x, y, w, h) inside the unit square."""
    return f"""{p}_b AS (SELECT scene, greatest(0, x) AS x0, greatest(0, y) AS y0, least(1.0, x + w) AS x1, least(1.0, y + h) AS y1 FROM {boxes}),
        {p}_xs AS (SELECT scene, x, lead(x) OVER (PARTITION BY scene ORDER BY x) AS nx FROM (SELECT scene, x0 AS x FROM {p}_b UNION SELECT scene, x1 FROM {p}_b)),
        {p}_ys AS (SELECT scene, y, lead(y) OVER (PARTITION BY scene ORDER BY y) AS ny FROM (SELECT scene, y0 AS y FROM {p}_b UNION SELECT scene, y1 FROM {p}_b)),
        {p}_cell AS (SELECT DISTINCT xs.scene, x, nx, y, ny FROM {p}_xs xs JOIN {p}_ys ys ON xs.scene = ys.scene JOIN {p}_b b ON b.scene = xs.scene AND b.x0 <= x AND b.x1 >= nx AND b.y0 <= y AND b.y1 >= ny WHERE nx IS NOT NULL AND ny IS NOT NULL),
        {p}_area AS (SELECT scene, least(1.0, sum((nx - x) * (ny - y))) AS a FROM {p}_cell GROUP BY 1)"""


def _tiled(p: str, boxes: str) -> str:
    """``p``_tiled (scene, tiled) beside the CTEs of ``_union``."""
    return f"""{_union(p, boxes)}, {p}_tiled AS (SELECT s.scene, n >= 4 AND a >= 0.5 AND e >= 0.55 AND a / e >= 0.9 AND t / a <= 1.15 AS tiled
        FROM (SELECT scene, count(*) AS n, (max(x + w) - min(x)) * (max(y + h) - min(y)) AS e, sum(w * h) AS t FROM {boxes} GROUP BY 1) s JOIN {p}_area u ON s.scene = u.scene)"""


_P = f"""{_N},
sn AS (SELECT *, CASE WHEN type = 'text' THEN 'T' || raw_id || ' x' END AS value, CASE WHEN type = 'image' THEN CASE ordinal % 4 WHEN 0 THEN 'source_photo' WHEN 1 THEN 'source_artwork' WHEN 3 THEN 'wallpaper' END END AS just,
  CASE WHEN type = 'image' THEN CASE WHEN z % 2 = 0 THEN 'reference-region:1' ELSE 'upload:1' END END AS ref FROM node),
obj AS (SELECT scene, id, type, x, y, CASE WHEN type = 'image' THEN w * 3 ELSE w END AS w, CASE WHEN type = 'image' THEN h * 8 ELSE h END AS h, type = 'image' AS img FROM actual),
img AS (SELECT o.scene, o.id, o.x, o.y, o.w, o.h, o.w * o.h AS area, coalesce(just, CASE WHEN starts_with(ref, 'reference-region:') THEN 'source_artwork' END, 'unsupported_fallback') AS classification
  FROM obj o JOIN sn ON o.scene = sn.scene AND o.id = sn.id WHERE img),
allow AS (SELECT *, classification IN ('source_artwork', 'source_illustration', 'source_logo', 'source_photo', 'source_texture') AS allowed FROM img),
pt AS (SELECT scene, lower(string_agg(value, ' ' ORDER BY ordinal)) AS text FROM sn WHERE type = 'text' AND ordinal % 6 <> 5 GROUP BY scene),
told AS (SELECT sn.*, o.id IS NOT NULL AND NOT o.img AS native, coalesce(o.img, false) AS pic, coalesce(contains(pt.text, lower(value)), false) AS said, pt.text AS pack FROM sn LEFT JOIN obj o ON o.scene = sn.scene AND o.id = sn.id LEFT JOIN pt ON pt.scene = sn.scene),
share AS (SELECT scene, coalesce(count(*) FILTER (type = 'text' AND native AND said) / nullif(count(*) FILTER (type = 'text'), 0)::DOUBLE, 1.0) AS ntr, coalesce(count(*) FILTER (type <> 'image' AND native) / nullif(count(*) FILTER (type <> 'image'), 0)::DOUBLE, 1.0) AS cov,
  least(1.0, coalesce(sum(CASE WHEN type <> 'image' AND native THEN w * h ELSE 0 END) / nullif(sum(CASE WHEN type <> 'image' THEN w * h ELSE 0 END), 0), 1.0)) AS nar FROM told GROUP BY scene),
big AS (SELECT scene, max(area) AS largest FROM img GROUP BY 1),
med AS (SELECT scene, bool_or(bit_count(xor(scene * 7919, xor(scene * 7919, CASE WHEN ordinal % 3 = 0 THEN 5 ELSE 1023 END))) <= 4) AS near, bool_or(ordinal % 5 = 0) AS vector FROM node WHERE type = 'image' GROUP BY 1),
{_tiled('t', 'img')},
flag AS (SELECT s.scene, coalesce(near, false) AND coalesce(largest, 0) >= 0.5 AS emb, coalesce(vector, false) AND (coalesce(largest, 0) >= 0.5 OR nar < 0.5) AS mono, coalesce(tiled, false) AS tiled FROM share s LEFT JOIN med ON med.scene = s.scene LEFT JOIN big ON big.scene = s.scene LEFT JOIN t_tiled ON t_tiled.scene = s.scene),
bad AS (SELECT allow.* FROM allow JOIN flag USING (scene) WHERE NOT allowed OR emb OR mono OR tiled),
{_union('u', 'bad')},
cnt AS (SELECT scene, count(*) FILTER (img) AS pics, count(*) FILTER (NOT img) AS shapes FROM obj GROUP BY 1),
unj AS (SELECT scene, count(*) AS n, max(area) AS largest FROM bad GROUP BY 1),
txt AS (SELECT scene, pack, CASE WHEN raw_id % 3 = 0 THEN 't' || raw_id || ' y' WHEN raw_id % 3 = 2 AND scene % 5 = 0 THEN NULL ELSE '' END AS t FROM told WHERE pic AND just = 'source_artwork'),
rt AS (SELECT scene, bool_and(t IS NOT NULL) AS done, count(*) FILTER (t <> '') AS regions, count(*) FILTER (t <> '' AND list_has_any(string_split(t, ' '), string_split(coalesce(pack, ''), ' '))) AS dup FROM txt GROUP BY 1),
aud AS (SELECT s.scene, s.scene % 17 <> 0 AS integ, coalesce(rt.done, true) AS done, coalesce(regions, 0) AS regions, coalesce(dup, 0) AS dup, CASE WHEN coalesce(regions, 0) = 0 THEN 1.0 ELSE 0.0 END AS excl, coalesce(pics, 0) AS pics, coalesce(shapes, 0) AS shapes, ntr, cov, nar, emb, mono, tiled,
  coalesce(unj.n, 0) AS un, coalesce(unj.largest, 0) AS ul, coalesce(u_area.a, 0) AS ut FROM share s JOIN flag ON flag.scene = s.scene LEFT JOIN cnt ON cnt.scene = s.scene LEFT JOIN unj ON unj.scene = s.scene LEFT JOIN u_area ON u_area.scene = s.scene LEFT JOIN rt ON rt.scene = s.scene)"""
_GATED = f"""{_P},
ae AS (SELECT scene, max(e) AS e FROM err GROUP BY 1), re AS (SELECT scene, max(e) AS e FROM rel GROUP BY 1),
gated AS (SELECT aud.scene, integ AND done AS ac, ae.e <= 0.025::DOUBLE AS al, coalesce(re.e, 0.0) <= 0.025::DOUBLE AS rl,
  [NOT emb, ul <= 0.1 AND ut <= 0.15 AND NOT tiled, ntr >= 1, cov >= 0.9, nar >= 0.9, NOT mono, un = 0, regions = 0, dup = 0, excl >= 1] AS g FROM aud JOIN ae ON ae.scene = aud.scene LEFT JOIN re ON re.scene = aud.scene),
named AS (SELECT *, ac AND list_bool_and(g) AS ed, ['G_NO_SOURCE_REFERENCE_EMBED', 'G_NO_FULL_PAGE_RASTER', 'G_VISIBLE_TEXT_NATIVE', 'G_SCENE_NODE_COVERAGE', 'G_NATIVE_OBJECT_RATIO', 'G_OBJECT_EDITABILITY', 'G_RASTER_JUSTIFICATION', 'G_NO_RASTERIZED_TEXT', 'G_NO_DUPLICATE_TEXT_LAYERS', 'G_TEXT_REGION_EXCLUSIVITY'] AS nm FROM gated),
said AS (SELECT scene, ac, al, rl, ed, CASE WHEN ac THEN [] ELSE ['G_PACKAGE_MEDIA_AUDIT'] END || list_transform(list_filter(range(1, 11), lambda i: NOT (ac AND g[i])), lambda i: nm[i]) || CASE WHEN ed THEN [] ELSE ['S_EDITABILITY'] END || CASE WHEN al THEN [] ELSE ['G_ALIGNMENT'] END || CASE WHEN rl THEN [] ELSE ['G_RELATIONSHIPS'] END AS f FROM named)"""
_CODE = "CASE event_id % 4 WHEN 0 THEN 'FIDELITY_FAILED' WHEN 1 THEN 'PACKAGE_INVALID' WHEN 2 THEN 'E2' ELSE 'TIMEOUT' END"
_KNOWN = "('EDITABILITY_FAILED', 'FIDELITY_FAILED', 'VALIDATION_INCOMPLETE', 'PACKAGE_INVALID', 'GENERATION_FAILED', 'UNSUPPORTED_NATIVE_RECONSTRUCTION', 'RASTER_FALLBACK_PROHIBITED')"

ORACLE_SQL = {
    "align_error_by_node": f"WITH {_N} SELECT scene, id, round(e, 6) AS max_error FROM err",
    "align_gate_by_scene": f"WITH {_N} SELECT scene, round(max(e), 6) AS max_error, max(e) <= 0.025::DOUBLE AS passed FROM err GROUP BY scene",
    "node_coverage": f"WITH {_N} SELECT n.scene, round(coalesce(least(1.0, c.a::DOUBLE / c.b), 1.0), 6) AS coverage FROM (SELECT DISTINCT scene FROM node) n LEFT JOIN (SELECT scene, count(*) FILTER (hit) AS a, count(*) AS b FROM rec GROUP BY 1) c ON n.scene = c.scene",
    "native_area_ratio": f"WITH {_N} SELECT n.scene, round(coalesce(least(1.0, c.a / c.b), 1.0), 6) AS ratio FROM (SELECT DISTINCT scene FROM node) n LEFT JOIN (SELECT scene, sum(CASE WHEN hit THEN w * h ELSE 0 END) AS a, sum(w * h) AS b FROM rec GROUP BY 1) c ON n.scene = c.scene",
    "relation_error_by_type": f"WITH {_N} SELECT type, count(*) AS n, round(max(e), 6) AS max_error, round(avg(e), 6) AS mean_error FROM rel GROUP BY type",
    "duplicate_ids": f"WITH {_N} SELECT scene, raw_id AS id, count(*) AS n FROM node GROUP BY ALL HAVING count(*) > 1",
    "orphan_parents": f"WITH {_N}, kept AS (SELECT * FROM node WHERE ordinal % 5 <> 2) SELECT scene, id, parent FROM kept k WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kept p WHERE p.scene = k.scene AND p.id = k.parent)",
    "bbox_violations": f"WITH {_N}, wide AS (SELECT scene, id, x - 0.005::DOUBLE AS x, y, w * 2 AS w, h FROM node) SELECT * FROM (SELECT scene, id, CASE WHEN x < 0 OR y < 0 OR w <= 0 OR h <= 0 OR x + w > 1.000001::DOUBLE OR y + h > 1.000001::DOUBLE THEN 'SCENE_BOUNDS' END AS code FROM wide) WHERE code IS NOT NULL",
    "scene_first_error": f"WITH {_N}, kept AS (SELECT scene, id, parent, ordinal, x, y, w * 2 AS w, h FROM node WHERE ordinal % 5 <> 2), bad AS (SELECT scene, ordinal, 'SCENE_BOUNDS' AS code FROM kept WHERE x + w > 1.000001::DOUBLE OR y + h > 1.000001::DOUBLE UNION ALL SELECT scene, 1000000, 'SCENE_REFERENCE' FROM kept k WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kept p WHERE p.scene = k.scene AND p.id = k.parent)) SELECT scene, arg_min(code, ordinal) AS code FROM bad GROUP BY scene",
    "overlap_pairs": f"WITH {_N}, {_PAIR} SELECT scene, a, b, round(i / least(pa, qa), 6) AS ratio FROM pair WHERE i / least(pa, qa) > 0.45::DOUBLE",
    "iou_pairs": f"WITH {_N}, {_PAIR} SELECT scene, a, b, round(i / (pa + qa - i), 6) AS ratio FROM pair WHERE i / (pa + qa - i) > 0.2::DOUBLE",
    "box_on_text": f"WITH {_N}, {_PAIR} SELECT DISTINCT scene, CASE WHEN pt = 'text' THEN b ELSE a END AS id FROM pair WHERE (pt = 'text' AND qt = 'rounded_rectangle' OR pt = 'rounded_rectangle' AND qt = 'text') AND i / least(pa, qa) >= 0.35::DOUBLE",
    "family_support": f"WITH {_N} SELECT p.scene, p.id, count(*) AS support FROM node p JOIN node q ON p.scene = q.scene AND p.type = q.type AND greatest(p.w, q.w) <= least(p.w, q.w) * 1.2::DOUBLE AND greatest(p.h, q.h) <= least(p.h, q.h) * 1.2::DOUBLE GROUP BY ALL",
    "union_area": f"""WITH {_N}, b AS (SELECT scene, greatest(0, x) AS x0, greatest(0, y) AS y0, least(1.0, x + w) AS x1, least(1.0, y + h) AS y1 FROM node),
        xs AS (SELECT scene, x, lead(x) OVER (PARTITION BY scene ORDER BY x) AS nx FROM (SELECT scene, x0 AS x FROM b UNION SELECT scene, x1 FROM b)),
        ys AS (SELECT scene, y, lead(y) OVER (PARTITION BY scene ORDER BY y) AS ny FROM (SELECT scene, y0 AS y FROM b UNION SELECT scene, y1 FROM b)),
        cell AS (SELECT DISTINCT xs.scene, x, nx, y, ny FROM xs JOIN ys ON xs.scene = ys.scene JOIN b ON b.scene = xs.scene AND b.x0 <= x AND b.x1 >= nx AND b.y0 <= y AND b.y1 >= ny WHERE nx IS NOT NULL AND ny IS NOT NULL)
        SELECT n.scene, round(coalesce(least(1.0, a), 0), 6) AS area FROM (SELECT DISTINCT scene FROM node) n LEFT JOIN (SELECT scene, sum((nx - x) * (ny - y)) AS a FROM cell GROUP BY 1) c ON n.scene = c.scene""",
    "line_clusters": """WITH v AS (SELECT DISTINCT l_suppkey AS scene_id, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS value FROM lineitem),
        m AS (SELECT *, CASE WHEN value - lag(value) OVER (PARTITION BY scene_id ORDER BY value) > 3 THEN 1 ELSE 0 END AS f FROM v), s AS (SELECT *, sum(f) OVER (PARTITION BY scene_id ORDER BY value)::BIGINT AS grp FROM m)
        SELECT scene_id, grp, round_even(avg(value), 0)::BIGINT AS centre, count(*) AS n FROM s GROUP BY ALL""",
    "crop_pixels": f"""WITH {_N}, p AS (SELECT scene, id, greatest(0, round_even(x * 1200, 0)::INT) AS "left", greatest(0, round_even(y * 800, 0)::INT) AS top, least(1200, round_even((x + w) * 1200, 0)::INT) AS r, least(800, round_even((y + h) * 800, 0)::INT) AS b FROM node)
        SELECT scene, id, "left", top, r AS "right", b AS bottom FROM p""",
    "page_geometry": "WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, (p_partkey % 40 + 5)::DOUBLE AS b FROM part) SELECT p_partkey, round(CASE WHEN a >= b THEN 297 ELSE 297 * a / b END, 6) AS w_mm, round(CASE WHEN a >= b THEN 297 * b / a ELSE 297 END, 6) AS h_mm, CASE WHEN a >= b THEN 'landscape' ELSE 'portrait' END AS orientation FROM p",
    "grid_expand": f"WITH {_N}, gr AS (SELECT *, z % 4 AS r, ordinal % 3 AS c FROM node WHERE type = 'rectangle'), rr AS (SELECT *, unnest(range(1, r)) AS k FROM gr), cc AS (SELECT *, unnest(range(1, c)) AS k FROM gr) SELECT scene, id || '-row-' || k AS id, 'row' AS axis, round(y + h * k / r, 6) AS at FROM rr UNION ALL SELECT scene, id || '-column-' || k, 'column', round(x + w * k / c, 6) FROM cc",
    "draw_order": f"WITH {_N} SELECT scene, id, row_number() OVER (PARTITION BY scene ORDER BY z, ordinal) AS draw FROM node",
    "first_three": f"WITH {_N} SELECT scene, id FROM node WHERE type = 'image' QUALIFY row_number() OVER (PARTITION BY scene ORDER BY ordinal) <= 3",
    "renumbered": f"WITH {_N} SELECT scene, ordinal, printf('text-%03d', row_number() OVER (PARTITION BY scene ORDER BY y, x, ordinal)) AS id FROM node WHERE type = 'text'",
    "nodes_by_type": f"WITH {_N} SELECT scene, count(*) FILTER (type <> 'image') AS native, count(*) FILTER (type = 'image') AS images, string_agg(DISTINCT type, ',' ORDER BY type) AS kinds FROM node GROUP BY scene",
    "word_filter": f"""WITH {_W} SELECT page_id, count(*) AS kept, sum("left")::BIGINT AS sum_left FROM word WHERE conf >= 60 AND width >= 2 AND height >= 2 AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]') GROUP BY page_id""",
    "line_assembly": f"""WITH {_W} SELECT page_id, line, md5(text) AS text, "left", top, "right", bottom, round(conf, 6) AS conf, round(score, 6) AS score FROM line""",
    "segment_words": f"""WITH {_W}, m AS (SELECT *, list_sort(list(height) OVER (PARTITION BY page_id, line)) AS hs, "left" - lag("left" + width) OVER (PARTITION BY page_id, line ORDER BY "left", ordinal) AS gap FROM word),
        f AS (SELECT *, CASE WHEN gap > greatest(20.0, hs[len(hs) // 2 + 1] * 1.6::DOUBLE) THEN 1 ELSE 0 END AS n FROM m), s AS (SELECT page_id, sum(n) OVER (PARTITION BY page_id, line ORDER BY "left", ordinal) AS segment FROM f) SELECT page_id, sum(segment)::BIGINT AS segments FROM s GROUP BY page_id""",
    "row_breaks": f"WITH {_W}, f AS (SELECT page_id, CASE WHEN top - lag(top) OVER (PARTITION BY page_id ORDER BY top, ordinal) > greatest(4.0, height * 0.65::DOUBLE) THEN 1 ELSE 0 END AS n FROM word) SELECT page_id, sum(n)::BIGINT + 1 AS rows FROM f GROUP BY page_id",
    "best_pass": f"WITH {_W} SELECT page_id % 50 AS block, line, pass, round(score, 6) AS score FROM line QUALIFY row_number() OVER (PARTITION BY page_id % 50, line ORDER BY score DESC, page_id) = 1",
    "text_normalize": f"SELECT conv_id, turn, md5({_NORM.format(c='text')}) AS norm, md5(regexp_replace(lower(text), '[^a-z0-9؀-ۿ]+', '', 'g')) AS key FROM conversations",
    "token_overlap": f"SELECT d.doc_id, list_has_any(list_filter(string_split({_NORM.format(c='d.text')}, ' '), lambda x: x <> ''), list_filter(string_split({_NORM.format(c='b.text')}, ' '), lambda x: x <> '')) AS duplicate FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id",
    "edit_distance_top1": """WITH w AS (SELECT regexp_replace(unnest(string_split(lower(text), ' ')), '[^a-z]', '', 'g') AS token FROM benchmark), t AS (SELECT token, count(*) AS n FROM w WHERE length(token) >= 4 GROUP BY token)
        SELECT a.token, arg_min(b.token, {'d': levenshtein(a.token, b.token), 'f': -b.n, 'w': b.token}) AS best, min(levenshtein(a.token, b.token))::INT AS distance FROM t a JOIN t b ON a.n = 1 AND b.n > 1 AND levenshtein(a.token, b.token) <= greatest(1, round_even(length(a.token) * 0.45::DOUBLE, 0)) GROUP BY a.token""",
    "url_guard": r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)) AS h FROM pages),
        o AS (SELECT *, regexp_matches(h, '^\d{1,3}(\.\d{1,3}){3}$') AS ip, try_cast(split_part(h, '.', 1) AS INT) AS a, try_cast(split_part(h, '.', 2) AS INT) AS b FROM u)
        SELECT page_id, CASE WHEN s = '' OR h = '' OR ip AND (a > 255 OR b > 255) THEN 'REF_URL_INVALID' WHEN s <> 'https' THEN 'REF_HTTPS_REQUIRED' WHEN h = 'localhost' OR regexp_matches(h, '\.(localhost|local)$') OR ip AND (a IN (0, 10, 127) OR a = 169 AND b = 254 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a >= 224) THEN 'REF_PRIVATE_ADDRESS' ELSE 'OK' END AS code FROM o""",
    "filename_sanitize": "WITH b AS (SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS n FROM pages) SELECT page_id, CASE WHEN n = '' THEN 'document.docx' WHEN ends_with(n, '.docx') THEN n ELSE n || '.docx' END AS out FROM b",
    "diagnostic_redact": r"SELECT page_id, left(trim(regexp_replace(regexp_replace(regexp_replace('failed at  ' || url || ' key=abcdefghijklmnopqrstuvwxyz0123456789', '(?i)https?://[^\s]+', '[url]', 'g'), '[A-Za-z0-9_-]{32,}', '[redacted]', 'g'), '\s+', ' ', 'g')), 240) AS out FROM pages",
    "html_text_runs": r"SELECT page_id, len(regexp_extract_all(html, '<[^>]*>')) AS tags, len(list_filter(string_split_regex(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]*>'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')) <> '')) > 0 AS has_text FROM pages",
    "xml_escaped": "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages",
    "raster_stats": f"""WITH {_R} SELECT vec_id, round(len(list_filter(luma, lambda v: v < 245)) / 64.0::DOUBLE, 6) AS nonwhite, {_rank(0.2)} AS p20, list_sort(luma)[33] AS median, round(({_HI} + 0.05) / ({_LO} + 0.05), 6) AS contrast,
        round(len(list_filter(luma[1:16] || luma[49:64] || list_transform(range(0, 16), lambda i: luma[i // 2 * 8 + i % 2 + 1]) || list_transform(range(0, 16), lambda i: luma[i // 2 * 8 + 7 + i % 2]), lambda v: v < 225)) / 64.0::DOUBLE, 6) AS border FROM ras""",
    "raster_mode_bucket": f"WITH {_R}, u AS (SELECT vec_id, unnest(luma) // 16 * 16 + 8 AS b, generate_subscripts(luma, 1) AS p FROM ras), g AS (SELECT vec_id, b, count(*) AS n, min(p) AS p FROM u GROUP BY ALL) SELECT vec_id, b AS bucket FROM g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, p) = 1",
    "raster_compare": f"""WITH {_R}, e AS (SELECT *, {_EDGES.format(c='a')} AS ea, {_EDGES.format(c='b')} AS eb FROM two), u AS (SELECT vec_id, unnest(a) AS a, unnest(b) AS b, unnest(ea) > 24 AS ea, unnest(eb) > 24 AS eb FROM e),
        m AS (SELECT vec_id, avg(a) AS pa, avg(b) AS pb, avg(a / 255.0::DOUBLE) AS mx, avg(b / 255.0::DOUBLE) AS my, var_pop(a / 255.0::DOUBLE) AS vx, var_pop(b / 255.0::DOUBLE) AS vy, covar_pop(a / 255.0::DOUBLE, b / 255.0::DOUBLE) AS c,
        count(*) FILTER (ea) AS na, count(*) FILTER (eb) AS nb, count(*) FILTER (ea AND eb) AS ab FROM u GROUP BY vec_id)
        SELECT vec_id, round(abs(pa - pb) / 255, 6) AS palette, round((2 * mx * my + 1e-4) * (2 * c + 9e-4) / ((mx * mx + my * my + 1e-4) * (vx + vy + 9e-4)), 6) AS ssim, round(CASE WHEN na = 0 AND nb = 0 THEN 1.0 ELSE 2.0::DOUBLE * ab / (na + nb) END, 6) AS f1 FROM m""",
    "raster_dhash_dist": f"WITH {_R}, nine AS (SELECT vec_id, a || a[1:8] AS a, b || b[1:8] AS b FROM two) SELECT vec_id, {_BITS.format(c='a', d='b')}::INT AS distance FROM nine",
    "raster_edges": f"WITH {_R}, e AS (SELECT vec_id, luma, {_EDGES.format(c='luma')} AS e FROM ras) SELECT vec_id, round(len(list_filter(range(0, 16), lambda i: e[(i // 4 + 2) * 8 + i % 4 + 3] > 35)) / 16.0::DOUBLE, 6) AS density, CASE WHEN list_sort(luma)[41] >= 145 THEN '#111111' ELSE '#ffffff' END AS color FROM e",
    "artwork": f"""WITH {_R}, p AS (SELECT vec_id, unnest(range(0, 21)) AS i, luma FROM ras), q AS (SELECT vec_id, luma[3 * i + 1] AS r, luma[3 * i + 2] AS g, luma[3 * i + 3] AS b FROM p),
        a AS (SELECT vec_id, count(*) FILTER (greatest(r, g, b) - least(r, g, b) >= 28 AND least(r, g, b) < 245) >= 21 * 0.08::DOUBLE AND count(DISTINCT (r // 24, g // 24, b // 24)) FILTER (greatest(r, g, b) - least(r, g, b) >= 28 AND least(r, g, b) < 245) >= 3 AS artwork FROM q GROUP BY 1),
        k AS (SELECT vec_id, least(255, r // 16 * 16 + 8) AS r, least(255, g // 16 * 16 + 8) AS g, least(255, b // 16 * 16 + 8) AS b, count(*) AS n FROM q GROUP BY ALL),
        t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, r, g, b) = 1)
        SELECT vec_id, artwork, concat(r, '-', g, '-', b) AS color, round(n / 21.0::DOUBLE, 6) AS share FROM a JOIN t USING (vec_id)""",
    "image_justification": f"WITH {_P} SELECT scene, id, classification, round(area, 6) AS area_ratio, allowed FROM allow",
    "package_audit": f"""WITH {_P} SELECT scene, integ AS package_integrity, integ AND done AS audit_complete, integ AND done AS raster_text_complete, integ AND emb AS source_reference_embedded, integ AND mono AS monolithic, integ AND tiled AS raster_tiling,
        CASE WHEN integ THEN pics ELSE -1 END AS embedded_image_objects, CASE WHEN integ THEN shapes ELSE -1 END AS native_shape_objects, CASE WHEN integ THEN un ELSE -1 END AS unjustified_rasters, CASE WHEN integ THEN regions ELSE -1 END AS raster_text_regions, CASE WHEN integ THEN dup ELSE -1 END AS duplicate_text_layers,
        CASE WHEN integ THEN round(ntr, 6) ELSE -1.0 END::DOUBLE AS native_text_ratio, CASE WHEN integ THEN round(cov, 6) ELSE -1.0 END::DOUBLE AS node_coverage, CASE WHEN integ THEN round(nar, 6) ELSE -1.0 END::DOUBLE AS native_area_ratio, CASE WHEN integ THEN round(ul, 6) ELSE -1.0 END::DOUBLE AS largest_raster, CASE WHEN integ THEN round(ut, 6) ELSE -1.0 END::DOUBLE AS total_raster, CASE WHEN integ THEN excl ELSE -1.0 END::DOUBLE AS exclusivity FROM aud""",
    "render_manifest": f"""WITH {_N} SELECT scene, count(*) FILTER (type <> 'group') AS native_shape_count, count(*) FILTER (type = 'image') AS image_object_count, count(*) FILTER (type = 'image' AND w >= 0.95 AND h >= 0.95) AS full_page_image_count,
        coalesce(string_agg(DISTINCT (z % 3)::DOUBLE::VARCHAR, ',' ORDER BY (z % 3)::DOUBLE::VARCHAR) FILTER (type <> 'text' AND z % 3 > 0), '') AS stroke_widths, coalesce(string_agg(DISTINCT '#00000' || raw_id, ',' ORDER BY '#00000' || raw_id) FILTER (type = 'text'), '') AS text_colors,
        coalesce(string_agg(id, ',' ORDER BY ordinal) FILTER (type = 'text' AND ordinal % 3 <> 1), '') AS rtl_text_nodes FROM node GROUP BY scene""",
    "gate_hints": f"""WITH {_GATED}, u AS (SELECT unnest(f) AS gate FROM said) SELECT gate, CASE gate WHEN 'G_ALIGNMENT' THEN 'restore measured bounding boxes and constraints' ELSE 'rebuild and rerender the affected primitives' END AS hint, count(*) AS scenes FROM u GROUP BY ALL""",
    "tiling_detect": f"WITH {_N}, wide AS (SELECT scene, x, y, w * 4 AS w, h * 6 AS h FROM node), {_tiled('t', 'wide')} SELECT scene, tiled FROM t_tiled",
    "width_units": f"SELECT doc_id, round({_width('text')}, 4) AS units, round({_widest('text')}, 4) AS widest, CASE WHEN regexp_matches(text, '[\u0600-\u06ff]') THEN 'rtl' ELSE 'ltr' END AS direction FROM documents",
    "font_fit": f"""WITH m AS (SELECT item_id, (item_id % 9 + 1) / 200.0::DOUBLE * 297 * (72 / 25.4::DOUBLE) * 1.45::DOUBLE AS ink, len({_LINES.format(c='text')}) AS lines, {_widest('text')} AS widest FROM benchmark)
        SELECT item_id, round(least(greatest(6, least(72, ink)), greatest(6, 20 * (72 / 25.4::DOUBLE * 0.92) / lines), greatest(6, 180 * (72 / 25.4::DOUBLE * 0.86) / widest)), 6) AS points FROM m""",
    "job_failure": f"""WITH j AS (SELECT event_id, {_CODE} AS code, CASE WHEN event_id % 5 = 0 THEN 'EDITABILITY_FAILED' ELSE 'DONE' END AS told FROM events WHERE event_type = 'error')
        SELECT event_id, CASE WHEN event_id % 3 <> 0 AND told IN {_KNOWN} THEN told WHEN event_id % 3 <> 0 AND code IN {_KNOWN} THEN code ELSE 'VALIDATION_INCOMPLETE' END AS recorded, CASE WHEN told IN ('EDITABILITY_FAILED', 'FIDELITY_FAILED', 'VALIDATION_INCOMPLETE') THEN told ELSE 'FIDELITY_FAILED' END AS code FROM j""",
    "gate_status": f"WITH {_G} SELECT doc_id, CASE WHEN bool_and(passed) THEN 'PASS' WHEN NOT bool_and(passed OR gate <> 'G_AUDIT') THEN 'VALIDATION_INCOMPLETE' WHEN NOT bool_and(passed OR gate <> 'G_QUALITY') THEN 'EDITABILITY_FAILED' ELSE 'FIDELITY_FAILED' END AS status FROM gate GROUP BY doc_id",
    "gate_findings": f"WITH {_G} SELECT doc_id, coalesce(string_agg(gate, ',' ORDER BY o) FILTER (NOT passed), '') AS findings FROM gate GROUP BY doc_id",
    "fidelity_report": f"""WITH {_GATED} SELECT scene, CASE WHEN ac AND ed AND al AND rl THEN 'PASS' WHEN NOT ac THEN 'VALIDATION_INCOMPLETE' WHEN NOT ed THEN 'EDITABILITY_FAILED' ELSE 'FIDELITY_FAILED' END AS status, array_to_string(f, ',') AS findings FROM said""",
    "job_latest": f"WITH {_J} SELECT job_id, event_id, status FROM last",
    "job_response": f"WITH {_J} SELECT job_id, CASE WHEN status = 'FAILED' THEN CASE WHEN {_CODE} IN {_KNOWN} THEN {_CODE} ELSE 'VALIDATION_INCOMPLETE' END ELSE status END AS response FROM last",
    "job_ttl": f"WITH {_J} SELECT job_id, count(*) FILTER (TIMESTAMP '2024-01-15 00:00:00' >= ts + INTERVAL 24 HOUR) AS expired, count(*) AS n FROM job GROUP BY job_id",
    "retry_schedule": "WITH b AS (SELECT c_custkey AS job_id, (c_custkey % 60 + 1)::DOUBLE AS budget, unnest(range(0, 4))::INT AS attempt FROM customer) SELECT job_id, attempt, least(5.0 * pow(2, attempt), budget - 5.0 * (pow(2, attempt) - 1)) AS delay FROM b WHERE least(5.0 * pow(2, attempt), budget - 5.0 * (pow(2, attempt) - 1)) > 0",
}

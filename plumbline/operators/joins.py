"""Joins of scenes with what was recovered, and spatial and fuzzy joins within a scene.

Every join has an equality key, so that a spatial predicate is a residual of a hash or merge join and never a
cross product over the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t


def last_by_id(df: DataFrame, key: str = "scene_id", order: str = "ordinal") -> DataFrame:
    """The last row of each id, as a dictionary filled in order keeps it."""
    w = Window.partitionBy(key, "id").orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def align(expected: DataFrame, actual: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """(key, id, max_error): the largest coordinate error of each expected box; 1 where it is missing."""
    a = last_by_id(actual, key).select(F.col(key).alias("_k"), F.col("id").alias("_id"), *[F.col(c).alias(f"a_{c}") for c in "xywh"])
    joined = expected.join(a, (expected[key] == a["_k"]) & (expected["id"] == a["_id"]), "left")
    return joined.select(key, "id", g.bbox_error(g.box(), g.box("a_")).alias("max_error"))


def relations(constraints: DataFrame, actual: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """Each constraint with its error against the recovered boxes."""
    a = last_by_id(actual, key)
    s = a.select(F.col(key), F.col("id").alias("source"), *[F.col(c).alias(f"s_{c}") for c in "xywh"])
    u = a.select(F.col(key), F.col("id").alias("target"), *[F.col(c).alias(f"t_{c}") for c in "xywh"])
    out = constraints.join(s, [key, "source"], "left").join(u, [key, "target"], "left")
    return out.select(key, "idx", "type", "source", "target", g.relation_error(F.col("type"), g.box("s_"), g.box("t_")).alias("error"))


def covered(expected: DataFrame, actual: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """Expected nodes that were recovered as native objects (groups and images are not reconstructable)."""
    native = actual.where("type <> 'image'").select(key, "id").distinct()
    return expected.where("type NOT IN ('group', 'image')").join(native, [key, "id"], "left_semi")


def text_native(expected: DataFrame, actual: DataFrame, package_text: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """Text nodes whose object is native and whose normalised value stands in the package's text."""
    native = actual.where("type <> 'image'").select(key, "id").distinct()
    rows = expected.join(native, [key, "id"]).join(package_text.select(key, F.col("text").alias("_package")), key)
    value = t.normalize(F.col("value"))
    return rows.where((value != "") & F.contains(t.normalize(F.col("_package")), value)).select(key, "id")


def duplicate_ids(df: DataFrame, *, key: str = "scene_id", id_col: str = "id") -> DataFrame:
    return df.groupBy(key, id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphan_parents(df: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """Nodes whose parent is not in their scene."""
    ids = df.select(key, F.col("id").alias("parent")).distinct()
    return df.where("parent IS NOT NULL").join(ids, [key, "parent"], "left_anti").select(key, "id", "parent")


def orphan_ends(constraints: DataFrame, nodes: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """Constraints with an end that is not in their scene: one row for each such end."""
    ends = constraints.select(key, "idx", F.explode(F.map_from_arrays(F.array(F.lit("source"), F.lit("target")), F.array("source", "target"))).alias("side", "id"))
    return ends.join(nodes.select(key, "id").distinct(), [key, "id"], "left_anti").select(key, "idx", "side", "id")


def pairs(df: DataFrame, measure, *, key: str = "scene_id", least: float = 0.0) -> DataFrame:
    """(key, a, b, ratio) of unordered pairs of a scene's boxes whose measure exceeds ``least``."""
    cols = ["ordinal", "id", *"xywh"]
    a = df.select(key, *[F.col(c).alias(f"p_{c}") for c in cols])
    b = df.select(key, *[F.col(c).alias(f"q_{c}") for c in cols])
    ratio = measure(g.box("p_"), g.box("q_"))
    return a.join(b, key).where("p_ordinal < q_ordinal").select(key, F.col("p_id").alias("a"), F.col("q_id").alias("b"), ratio.alias("ratio")).where(F.col("ratio") > least)


def box_on_text(boxes: DataFrame, texts: DataFrame, *, least: float = 0.45, key: str = "scene_id") -> DataFrame:
    """Boxes that share at least ``least`` of the smaller area with some text."""
    t_ = texts.select(F.col(key).alias("_k"), *[F.col(c).alias(f"t_{c}") for c in "xywh"])
    on = (boxes[key] == t_["_k"]) & (g.overlap_of_smaller(g.box(), g.box("t_")) >= least)
    return boxes.join(t_, on, "left_semi")


def family_support(df: DataFrame, *, ratio: float = 1.20, key: str = "scene_id") -> DataFrame:
    """(key, id, support): how many boxes of a scene, itself included, have its type and about its size."""
    a = df.select(key, "type", "id", F.col("w").alias("aw"), F.col("h").alias("ah"))
    b = df.select(key, "type", F.col("w").alias("bw"), F.col("h").alias("bh"))
    close = lambda p, q: F.greatest(p, q) <= F.least(p, q) * F.lit(ratio)
    j = a.join(b, [key, "type"]).where(close(F.col("aw"), F.col("bw")) & close(F.col("ah"), F.col("bh")))
    return j.groupBy(key, "id").agg(F.count(F.lit(1)).alias("support"))


def point_in_cell(points: DataFrame, lines: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """The first cell (column, row) that holds each point; on a shared edge the lower one."""
    def cells(axis, name):
        w = Window.partitionBy(key).orderBy("pos")
        c = lines.where(F.col("axis") == axis).withColumn("hi", F.lead("pos").over(w)).withColumn(name, F.row_number().over(w) - 1)
        return c.where("hi IS NOT NULL").select(key, F.col("pos").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi"), name)

    out = points.join(cells("v", "column"), key).where("px BETWEEN column_lo AND column_hi").join(cells("h", "row"), key).where("py BETWEEN row_lo AND row_hi")
    return out.groupBy(key, "id").agg(F.min(F.struct("column", "row")).alias("cell")).select(key, "id", "cell.column", "cell.row")


def token_overlap(a: DataFrame, b: DataFrame, *, key: str) -> DataFrame:
    """Rows of ``a`` without their text, with whether its tokens meet those of ``b`` under the same key."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(t.normalize(F.col(c)), " "), lambda x: x != ""))
    other = b.select(key, F.col("text").alias("_other"))
    rest = [c for c in a.columns if c != "text"]
    return a.join(other, key).select(*rest, F.arrays_overlap(tokens("text"), tokens("_other")).alias("duplicate"))


def nearest_words(tokens: DataFrame, dictionary: DataFrame, *, share: float = 0.45) -> DataFrame:
    """The dictionary word nearest each token by (distance, frequency, word), among those within the allowed distance.

    The dictionary is joined on a band of lengths; distance is bounded by max(1, round(share * length)).
    """
    most = F.greatest(F.lit(1), F.bround(F.length("token") * share).cast("int"))
    t_ = tokens.select("token", most.alias("most")).withColumn("len", F.explode(F.sequence(F.greatest(F.lit(1), F.length("token") - F.col("most")), F.length("token") + F.col("most"))))
    d = dictionary.select("word", "freq", F.length("word").alias("len"))
    near = t_.join(d, "len").withColumn("distance", F.levenshtein("token", "word")).where("distance <= most")
    best = near.groupBy("token").agg(F.min(F.struct("distance", (-F.col("freq")).alias("f"), "word")).alias("b"))
    return best.select("token", F.col("b.word").alias("best"), F.col("b.distance").alias("distance"))


def required_text(required: DataFrame, texts: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """Required strings that stand in no text of their document."""
    r = required.select(F.col(key), F.explode("required").alias("required"))
    blob = texts.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("_blob"))
    return r.join(blob, key, "left").where(~F.contains(F.coalesce("_blob", F.lit("")), F.col("required"))).select(key, "required")


def supported_lines(lines: DataFrame, *, key: str = "scene_id", overlap: float = 0.45, ratio: float = 0.60, passes: int = 2) -> DataFrame:
    """Lines seen alike, in place and wording, by at least ``passes`` distinct passes (their own included)."""
    a = lines.select(key, F.col("id").alias("p_id"), F.col("text").alias("p_text"), *[F.col(c).alias(f"p_{c}") for c in "xywh"])
    b = lines.select(key, F.col("pass").alias("q_pass"), F.col("text").alias("q_text"), *[F.col(c).alias(f"q_{c}") for c in "xywh"])
    near = a.join(b, key).where(g.overlap_of_smaller(g.box("p_"), g.box("q_")) >= overlap)
    alike = near.withColumn("r", t.seq_ratio(t.key(F.col("p_text")), t.key(F.col("q_text")))).where(F.col("r") >= ratio)
    good = alike.groupBy(key, F.col("p_id").alias("id")).agg(F.count_distinct("q_pass").alias("passes")).where(F.col("passes") >= passes)
    return lines.join(good, [key, "id"])

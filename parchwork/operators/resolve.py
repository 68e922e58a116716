"""Cross-references, objects, page trees and encodings as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchwork.kernels.objects import ALIASES


def first_match(xref: DataFrame) -> DataFrame:
    """The newest entry in use for each (path, object_number, generation_number); entries that free an object are passed over."""
    keys = ["path", "object_number", "generation_number"]
    rest = [c for c in xref.columns if c not in (*keys, "section_ord", "seq")]
    best = xref.where("in_use").groupBy(*keys).agg(F.min_by(F.struct("section_ord", "seq", *rest), F.struct("section_ord", "seq")).alias("_e"))
    return best.select(*keys, "_e.*")


def merge_trailers(items: DataFrame, precedence: str = "newest") -> DataFrame:
    """(path, key, value) of merged trailers, from (path, section_ord, key, value) with 0 the newest section."""
    pick = F.min_by if precedence == "newest" else F.max_by
    return items.groupBy("path", "key").agg(pick("value", "section_ord").alias("value"))


def resolve(rows: DataFrame, objects: DataFrame, reference: str = "ref") -> DataFrame:
    """Rows with the value of the object that ``reference`` (a struct) names; null where it is null."""
    r = F.col(reference)
    target = objects.select(F.col("path").alias("_p"), F.col("object_number").alias("_n"), F.col("generation_number").alias("_g"), F.col("value").alias(f"{reference}_value"))
    return rows.join(target, (F.col("path") == F.col("_p")) & (r["object_number"] == F.col("_n")) & (r["generation_number"] == F.col("_g")), "left").drop("_p", "_n", "_g")


def orphans(rows: DataFrame, objects: DataFrame, reference: str = "ref") -> DataFrame:
    """Rows whose reference names no object."""
    r = F.col(reference)
    target = objects.select(F.col("path").alias("_p"), F.col("object_number").alias("_n"), F.col("generation_number").alias("_g"))
    return rows.where(r.isNotNull()).join(target, (F.col("path") == F.col("_p")) & (r["object_number"] == F.col("_n")) & (r["generation_number"] == F.col("_g")), "left_anti")


def page_tree(nodes: DataFrame, depth: int = 100) -> DataFrame:
    """(path, node, trail, media_box) of the leaves below roots, depth first by ``trail``.

    ``nodes`` is (path, node, parent, ordinal, is_leaf, media_box); a root has a
    null parent. Each level is a join with the level above, a node takes the
    nearest ancestor's box, and a node that is its own ancestor is not entered
    again. Levels number as deep as the deepest tree, not as many as nodes.
    """
    spark = nodes.sparkSession
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(max(depth, int(spark.conf.get("spark.sql.cteRecursionLevelLimit")))))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(
        """
        WITH RECURSIVE tree(path, node, is_leaf, media_box, trail, seen) AS (
          SELECT path, node, is_leaf, media_box, array(ordinal), array(node) FROM {nodes} WHERE parent IS NULL
          UNION ALL
          SELECT n.path, n.node, n.is_leaf, coalesce(n.media_box, t.media_box), array_append(t.trail, n.ordinal), array_append(t.seen, n.node)
          FROM {nodes} n JOIN tree t ON n.path = t.path AND n.parent = t.node WHERE NOT array_contains(t.seen, n.node)
        ) SELECT path, node, trail, media_box FROM tree WHERE is_leaf
        """,
        nodes=nodes,
    )


def number_pages(leaves: DataFrame) -> DataFrame:
    """Add page_no, from 1, in tree order."""
    return leaves.withColumn("page_no", F.row_number().over(W.partitionBy("path").orderBy("trail")))


def alias_of(operator: Column) -> Column:
    """What a content-stream operator does; null for an unknown one. The table is a literal of fixed size."""
    return F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[operator]


def unknown_operators(operations: DataFrame) -> DataFrame:
    """(operator, n) of operators without an alias."""
    return operations.where(alias_of(F.col("operator")).isNull()).groupBy("operator").agg(F.count("*").alias("n"))


def overlay(layers: DataFrame, keys: tuple[str, ...] = ("font_id", "code")) -> DataFrame:
    """(keys, text) from (keys, layer, text): the highest layer that defines a code."""
    return layers.where(F.col("text").isNotNull()).groupBy(*keys).agg(F.max_by("text", "layer").alias("text"))


def expand_differences(items: DataFrame) -> DataFrame:
    """(font_id, code, glyph) from (font_id, pos, number, glyph): a number sets the code, each name takes the next, the later wins."""
    order = W.partitionBy("font_id").orderBy("pos")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    runs = items.withColumn("_base", F.coalesce(F.last("number", ignorenulls=True).over(upto), F.lit(0))).withColumn("_run", F.count("number").over(upto))
    offset = F.count("glyph").over(W.partitionBy("font_id", "_run").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)) - 1
    named = runs.withColumn("code", F.col("_base") + offset).where(F.col("glyph").isNotNull())
    return named.groupBy("font_id", "code").agg(F.max_by("glyph", "pos").alias("glyph"))


def expand_ranges(ranges: DataFrame) -> DataFrame:
    """(font_id, code, text) of code ranges (font_id, low, high, dst), dst being the first code's character number."""
    codes = ranges.select("font_id", "low", "dst", F.explode(F.sequence("low", "high")).alias("code"))
    return codes.select("font_id", "code", F.decode(F.unhex(F.lpad(F.hex(F.col("dst") + F.col("code") - F.col("low")), 4, "0")), "UTF-16BE").alias("text"))


def measure(codes: DataFrame, widths: DataFrame, default: float = 1000.0) -> DataFrame:
    """(font_id, string_id, width): the sum of the codes' widths; a code without one has the default."""
    joined = codes.join(widths.select("font_id", "code", "width"), ["font_id", "code"], "left")
    return joined.groupBy("font_id", "string_id").agg(F.sum(F.coalesce("width", F.lit(default))).alias("width"))


def advances(glyphs: DataFrame) -> DataFrame:
    """Add x, the sum of the advances before a glyph: ((w / 1000) size + char_space + word_space on spaces) scale / 100."""
    step = (F.col("width") / 1000 * F.col("size") + F.col("char_space") + F.when(F.col("text") == " ", F.col("word_space")).otherwise(0.0)) * F.col("scale") / 100
    before = W.partitionBy("string_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return glyphs.withColumn("_step", step).withColumn("x", F.coalesce(F.sum("_step").over(before), F.lit(0.0))).drop("_step")

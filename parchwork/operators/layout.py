"""Spans to lines, words, columns and paragraphs.

Order is meaning here: every window is ordered by ``span_seq`` or an id made
from it. All windows of a page share the partitioning by ``keys``, so a page
is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchwork.functions.geometry import bounding, gap

KEYS = ("path", "page_no")
#: Tops that a step of the fold over a page takes.
BLOCK = 500


def line_rows(spans: DataFrame, keys: tuple[str, ...] = KEYS, dy: float = 5.0) -> DataFrame:
    """(keys, line_id, spans): one row for each line, with its spans in order. A line ends where a span's top is more than ``dy`` from the least top of the line so far.

    That running minimum starts anew with each line, so no window expresses it.
    It is a fold over the page's tops that keeps only where lines begin, and
    the lines are cut from the array at once. A fold copies what it has kept at
    each step: it goes over blocks of ``BLOCK`` tops, and within each over its
    own, so the cost stays near linear in the spans of a page.
    """
    rest = [c for c in spans.columns if c not in keys]
    row = F.struct("span_seq", *[c for c in rest if c != "span_seq"])
    pages = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    none = F.expr("cast(array() as array<int>)")

    def step(acc: Column, y: Column) -> Column:
        new = acc["top"].isNull() | (F.abs(y - acc["top"]) > dy)
        top = F.when(new, y).otherwise(F.least(acc["top"], y))
        return F.struct(top.alias("top"), (acc["at"] + 1).alias("at"), F.when(new, F.array_append(acc["begins"], acc["at"])).otherwise(acc["begins"]).alias("begins"))

    def block_step(acc: Column, block: Column) -> Column:
        mine = F.aggregate(block, F.struct(acc["top"].alias("top"), acc["at"].alias("at"), none.alias("begins")), step)
        return F.transform(F.array(mine), lambda m: F.struct(m["top"].alias("top"), m["at"].alias("at"), F.concat(acc["begins"], m["begins"]).alias("begins")))[0]

    tops = F.transform("_rows", lambda r: r["min_y"])
    last = F.floor((F.size("_rows") - 1) / BLOCK).cast("int")
    blocks = F.transform(F.array(tops), lambda t: F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(t, k * BLOCK + 1, F.lit(BLOCK))))[0]
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0).alias("at"), none.alias("begins"))
    pages = pages.withColumn("_begins", F.aggregate(blocks, start, block_step, lambda acc: acc["begins"]))
    ends = F.concat(F.slice(F.col("_begins"), 2, F.size("_begins")), F.array(F.size("_rows")))
    lines = F.zip_with("_begins", ends, lambda b, e: F.slice(F.col("_rows"), b + 1, e - b))
    return pages.select(*keys, F.posexplode(lines).alias("line_id", "spans"))


def exploded(lines: DataFrame) -> DataFrame:
    """Lines with ``spans`` to one row for each span."""
    rest = [c for c in lines.columns if c != "spans"]
    return lines.select(*rest, F.explode("spans").alias("_span")).select(*rest, "_span.*")


def group_lines(spans: DataFrame, keys: tuple[str, ...] = KEYS, dy: float = 5.0) -> DataFrame:
    """Add line_id, see ``line_rows``."""
    return exploded(line_rows(spans, keys, dy))


def partition_words(lined: DataFrame, keys: tuple[str, ...] = KEYS, space_width: float = 1.0) -> DataFrame:
    """Add word_id, counted within the line: a new word begins more than ``space_width`` after the span before."""
    order = W.partitionBy(*keys, "line_id").orderBy("span_seq")
    new = F.when(F.col("min_x") - F.lag("max_x").over(order) > space_width, 1).otherwise(0)
    return lined.withColumn("_new", new).withColumn("word_id", F.sum("_new").over(order)).drop("_new")


def line_boxes(lined: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row for each line, with its bounding rectangle."""
    return lined.groupBy(*keys, "line_id").agg(*bounding())


def group_columns(lines: DataFrame, keys: tuple[str, ...] = KEYS, dx: float = 0.0, dy: float = 5.0) -> DataFrame:
    """Add column_id: a new column begins where a line is farther than ``dx`` or ``dy`` from the line before."""
    order = W.partitionBy(*keys).orderBy("line_id")
    prior = {s: F.lag(s).over(order) for s in ("min_x", "min_y", "max_x", "max_y")}
    across = gap(prior["min_x"], prior["max_x"], F.col("min_x"), F.col("max_x"))
    down = gap(prior["min_y"], prior["max_y"], F.col("min_y"), F.col("max_y"))
    new = F.when(prior["min_x"].isNotNull() & ((across > dx) | (down > dy)), 1).otherwise(0)
    return lines.withColumn("_new", new).withColumn("column_id", F.sum("_new").over(order)).drop("_new")


def split_paragraphs(columned: DataFrame, keys: tuple[str, ...] = KEYS, indent: float = 5.0) -> DataFrame:
    """Add paragraph_id, counted within the page.

    A paragraph begins with a column's first line and with every line whose
    left offset differs by more than ``indent`` from the typical one: the
    median of the column, or of two lines the second's.
    """
    column = W.partitionBy(*keys, "column_id")
    order = column.orderBy("line_id")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = columned.withColumn("_left", F.col("min_x") - F.min("min_x").over(column))
    typical = F.when(F.count("*").over(column) == 2, F.nth_value("_left", 2).over(whole)).otherwise(F.median("_left").over(column))
    new = F.when((F.row_number().over(order) == 1) | (F.abs(typical - F.col("_left")) > indent), 1).otherwise(0)
    found = found.withColumn("_new", new)
    return found.withColumn("paragraph_id", F.sum("_new").over(W.partitionBy(*keys).orderBy("line_id")) - 1).drop("_new", "_left")


def layout(spans: DataFrame, keys: tuple[str, ...] = KEYS, line_dy: float = 5.0, space_width: float = 1.0, dx: float = 0.0, dy: float = 5.0, indent: float = 5.0) -> DataFrame:
    """Spans with line_id, word_id, column_id and paragraph_id.

    Columns and paragraphs are found on rows of lines, which carry their spans
    along, so a page is dealt out once and joined with nothing.
    """
    of = lambda name: F.transform("spans", lambda s: s[name])
    lines = line_rows(spans, keys, line_dy)
    boxed = lines.withColumns({c: F.array_min(of(c)) for c in ("min_x", "min_y")} | {c: F.array_max(of(c)) for c in ("max_x", "max_y")})
    placed = split_paragraphs(group_columns(boxed, keys, dx, dy), keys, indent)
    return partition_words(exploded(placed.select(*keys, "line_id", "column_id", "paragraph_id", "spans")), keys, space_width)

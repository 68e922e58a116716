"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow. Its documents stand in a pseudo-random but repeatable
order, up to ``max_repeat`` times over, and a document's virtual finish time is
the source's running number of words up to and including it, divided by the
source's weight. Served in order of finish time until the budget is spent, the
flows get shares in proportion to their weights; a flow that runs dry leaves
its share to the others. So the targets are the water-filling
``min(max_repeat * size, weight * level)``.

Plan. Neither a source nor the whole corpus is ever gathered in one task:

* words and order key are computed once and kept in a narrow table (no text);
* the running sum of a source is split by ranges of its order key, a few
  thousand documents each: sums per range, an offset per range, then a window
  inside each range;
* the global order by finish time is a range partition into slices of equal
  virtual time, which are of even size since flows are served evenly. Slices
  are summed; only the slice in which the budget ends is sorted;
* the cut is one row. A document is taken once for each repeat whose key does
  not come after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchwork.llm.text import n_words
from parchwork.session import cut, output_columns

#: Hexadecimal digits of the order key that decide a document's range.
RANGE_DIGITS = 8


@dataclass
class MixPlan:
    """What the mix needs besides the documents: one row per range of a source, and the key of the last repeat taken."""

    ranges: DataFrame
    edge: Row | None
    n_ranges: int
    max_repeat: int
    seed: int


def _keyed(docs: DataFrame, n_ranges: int, seed: int) -> DataFrame:
    """Add size, order key and range. Rows with equal id and size are interchangeable."""
    size = n_words(F.col("text"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), size.cast("string")).cast("binary"))
    docs = docs.withColumns({"_size": size, "_key": key})
    place = F.conv(F.substring("_key", 1, RANGE_DIGITS), 16, 10).cast("long")
    return docs.withColumn("_range", F.floor(place * F.lit(n_ranges) / F.lit(16**RANGE_DIGITS)))


def source_targets(sources: DataFrame, weights: tuple[float, ...], max_repeat: int, share: float) -> DataFrame:
    """Targets from one row (source, source_size) for each source.

    A window over the sources sorts them by the level at which they run dry
    and finds the level at which all together serve the budget.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumns({"rank": rank, "weight": weight, "cap": F.col("source_size") * max_repeat})
    total = W.partitionBy().orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumns({"budget": F.floor(F.sum("source_size").over(total) * F.lit(share)), "dry": F.col("cap") / F.col("weight")})
    before = W.orderBy("dry", "rank").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy("dry", "rank").rowsBetween(W.currentRow, W.unboundedFollowing)
    s = s.withColumn("fill", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    # the level is right at the first source that does not run dry below it
    ascending = W.orderBy("dry", "rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("level", F.first(F.when(F.col("fill") <= F.col("dry"), F.col("fill")), ignorenulls=True).over(ascending))
    target = F.when(F.col("level").isNull() | (F.col("weight") * F.col("level") > F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return s.select("source", "source_size", "rank", "weight", "budget", "level", target.alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, max_repeat: int = 3, seed: int = 0, rows_per_range: int = 2000) -> MixPlan:
    """Size the sources and find where the budget ends."""
    narrow = cut(_keyed(docs.select("doc_id", "text", "source"), 1, seed).select("doc_id", "source", "_size", "_key"))
    sums = narrow.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("n"))
    rows = narrow.count()
    n_ranges = max(1, -(-rows // rows_per_range))
    targets = source_targets(sums.select("source", "source_size"), weights, max_repeat, share)
    place = F.conv(F.substring("_key", 1, RANGE_DIGITS), 16, 10).cast("long")
    narrow = narrow.withColumn("_range", F.floor(place * F.lit(n_ranges) / F.lit(16**RANGE_DIGITS)))
    per = narrow.groupBy("source", "_range").agg(F.sum("_size").alias("n"))
    earlier = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ranges = cut(per.join(targets, per["source"].eqNullSafe(targets["source"])).select(per["source"].alias("r_source"), F.col("_range").alias("r_range"), "offset", "source_size", "rank", "weight", "budget", "level", "target"))
    times = _finish_times(narrow, ranges, max_repeat)
    slices = max(1, -(-rows // rows_per_range))
    step = F.when(F.col("level") > 0, F.col("level") / F.lit(slices)).otherwise(F.lit(1.0))
    each = times.select("rank", "_key", "doc_id", "_size", "budget", step.alias("step"), F.posexplode("_finish").alias("repeat", "finish"))
    # virtual times are positive; everything far beyond the level shares the last slice
    each = each.withColumn("slice", F.least(F.floor(F.col("finish") / F.col("step")), F.lit(2 * slices + 2)))
    sizes = each.groupBy("slice").agg(F.sum("_size").alias("n"), F.max("budget").alias("budget"))
    upto = W.orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = sizes.withColumn("upto", F.sum("n").over(upto))
    last = sizes.where(F.col("upto") > F.col("budget")).agg(F.min_by(F.struct("slice", (F.col("upto") - F.col("n")).alias("before")), "slice").alias("x")).select("x.slice", "x.before").first()
    order = ["finish", "rank", "_key", "doc_id", "_size", "repeat"]
    key = F.struct(*order)
    if last is None or last["slice"] is None:  # all repeats fit in the budget, or there are no documents
        edge = each.agg(F.max(key).alias("edge"))
    else:
        within = each.where(F.col("slice") == last["slice"])
        running = F.sum("_size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) + last["before"]
        kept = within.withColumn("running", running).where(F.col("running") <= F.col("budget"))
        below = each.where(F.col("slice") < last["slice"])
        edge = kept.agg(F.max(key).alias("edge")).union(below.agg(F.max(key).alias("edge"))).agg(F.max("edge").alias("edge"))
    return MixPlan(ranges, edge.first()["edge"], n_ranges, max_repeat, seed)


def _finish_times(docs: DataFrame, ranges: DataFrame, max_repeat: int) -> DataFrame:
    """Add the finish time of each repeat, and the source's figures."""
    same = docs["source"].eqNullSafe(ranges["r_source"]) & (docs["_range"] == ranges["r_range"])
    joined = docs.join(ranges, same)
    inside = W.partitionBy("r_source", "r_range").orderBy("_key", "doc_id", "_size").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.col("offset") + F.sum("_size").over(inside)
    times: list[Column] = [(F.col("_upto") + F.lit(i) * F.col("source_size")) / F.col("weight") for i in range(max_repeat)]
    return joined.withColumn("_upto", upto).withColumn("_finish", F.array(*times))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Documents with size, source_size, target, copies (0 to ``max_repeat``) and taken.

    ``docs`` has doc_id, text and source; other columns pass through, and those
    named like an output give way to it. A null or blank text has size 0 and
    takes nothing; the null source is a source of its own, ranked last. Equal
    rows are ordered among themselves arbitrarily, which no result can show.
    Sizes are of whole texts, however long. An empty table gives an empty result.
    """
    plan = plan_mix(docs, **options)
    out = ["size", "source_size", "target", "copies", "taken"]
    columns = output_columns(docs, out)
    inner = [f"_in_{i}" for i in range(len(columns))]
    renamed = docs.select("doc_id", "text", "source", *[F.col(f"`{c}`").alias(i) for c, i in zip(columns, inner, strict=True)])
    keyed = _keyed(renamed, plan.n_ranges, plan.seed).drop("text")
    timed = _finish_times(keyed, plan.ranges, plan.max_repeat)
    copies = F.lit(0)
    if plan.edge is not None:
        edge = F.struct(*[F.lit(v).alias(k) for k, v in plan.edge.asDict().items()])
        for i in range(plan.max_repeat):
            key = F.struct(F.element_at("_finish", i + 1).alias("finish"), "rank", "_key", "doc_id", "_size", F.lit(i).alias("repeat"))
            copies = copies + F.when(key <= edge, 1).otherwise(0)
    result = timed.withColumn("_copies", copies.cast("int"))
    return result.select(
        *[F.col(i).alias(c) for c, i in zip(columns, inner, strict=True)],
        F.col("_size").alias("size"),
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").alias("target"),
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).cast("long").alias("taken"),
    )


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    mixed = mix(docs, **options)
    return mixed.where(F.col("copies") > 0).withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*[mixed[c] for c in output_columns(docs, ["size", "source_size", "target", "copies", "taken"])])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), k AS (
  SELECT *, md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || size::VARCHAR) AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS budget FROM s
), w AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM r
), o AS (
  SELECT *, cap / weight AS dry FROM w
), f AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY dry, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
       / sum(weight) OVER (ORDER BY dry, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fill FROM o
), l AS (
  SELECT *, first_value(CASE WHEN fill <= dry THEN fill END IGNORE NULLS) OVER (ORDER BY dry, rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM f
), t AS (
  SELECT source, source_size, rank, weight, budget,
         CASE WHEN level IS NULL OR weight * level > cap THEN cap::DOUBLE ELSE weight * level END AS target FROM l
), c AS (
  SELECT k.doc_id, k.size, k.key, t.source_size, t.rank, t.weight, t.budget, t.target,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT c.*, i AS repeat, (upto + i * source_size)::DOUBLE / weight AS finish FROM c CROSS JOIN (VALUES (0), (1), (2)) AS v(i)
), g AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, key, doc_id, size, repeat ROWS UNBOUNDED PRECEDING) AS served FROM e
)
SELECT doc_id, size, source_size, target, (sum(CASE WHEN served <= budget THEN 1 ELSE 0 END))::INTEGER AS copies,
       (sum(CASE WHEN served <= budget THEN size ELSE 0 END))::BIGINT AS taken
FROM g GROUP BY doc_id, size, source_size, target, upto
"""

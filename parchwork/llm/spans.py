"""Spans of regular expressions as native column expressions.

Spark can list the matches of a pattern but not where they are. A text split
by a pattern gives what lies between its matches, so the lengths of both give
every position, in code points, without leaving the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


#: Matches of a block. A fold copies what it has gathered at each step, so it gathers no more than this.
BLOCK = 64
#: A character that stands for one of a masked span.
MASK = "\ue000"


def matches(text: Column, pattern: str, groups: tuple[int, ...] = (0,), context: int = 0) -> Column:
    """The leftmost non-overlapping matches: structs of start, end and g0, g1... for the groups asked for.

    Start and end count code points, the end is exclusive. The pattern must not
    match the empty string. With ``context``, before and after hold as many
    code points on either side, as far as the neighbouring matches.
    """

    def located(parts: Column) -> Column:
        found, between = parts["g0"], parts["between"]
        sizes = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("size")))
        spans = F.expr("cast(array() as array<struct<start:int,end:int>>)")
        total = lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x["gap"] + x["size"])

        def before(acc: Column, n: Column) -> Column:
            return F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            end = begin + x["size"]
            return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end"))).alias("out"))

        def placed(blocks: Column) -> Column:
            none_yet = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
            begins = F.aggregate(F.transform(blocks, total), none_yet, before, lambda acc: acc["out"])
            return F.flatten(F.zip_with(blocks, begins, lambda block, at: F.aggregate(block, F.struct(at.alias("at"), spans.alias("out")), step, lambda acc: acc["out"])))

        number = F.floor((F.greatest(F.size(found), F.lit(1)) - 1) / BLOCK).cast("int")
        where = let(sizes, lambda every: let(F.transform(F.sequence(F.lit(0), number), lambda k: F.slice(every, k * BLOCK + 1, F.lit(BLOCK))), placed))
        columns = [where.alias("w"), *[parts[f"g{i}"].alias(f"g{i}") for i in range(len(groups))]]
        if context:
            columns += [F.slice(between, 1, F.size(found)).alias("b"), F.slice(between, 2, F.size(found)).alias("a")]
        around = lambda z: [F.right(z["b"], F.lit(context)).alias("before"), F.left(z["a"], F.lit(context)).alias("after")] if context else []
        return F.transform(F.arrays_zip(*columns), lambda z: F.struct(z["w"]["start"].alias("start"), z["w"]["end"].alias("end"), *[z[f"g{i}"].alias(f"g{i}") for i in range(len(groups))], *around(z)))

    all_groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{i}") for i, g in enumerate(groups)]
    return let(F.struct(F.split(text, pattern, -1).alias("between"), *all_groups), located)


def masked(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """The text with ``MASK`` for each character of the matches that ``keep`` accepts (as structs with g0)."""
    hidden = lambda m: F.when(keep(F.struct(m.alias("g0"))), F.repeat(F.lit(MASK), F.length(m))).otherwise(m)
    parts = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return let(parts, lambda p: F.array_join(F.zip_with(p["between"], p["found"], lambda b, m: F.concat(b, F.coalesce(hidden(m), F.lit("")))), ""))


def overlaid(first: Column, second: Column) -> Column:
    """Two masked forms of one text as one: masked where either is."""
    either = F.zip_with(F.split(first, ""), F.split(second, ""), lambda a, b: F.when(a == MASK, a).otherwise(b))
    return F.array_join(either, "")


def plain(spans: Column) -> Column:
    """Structs of start and end only."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def none() -> Column:
    """No spans."""
    return F.expr("cast(array() as array<struct<start:int,end:int>>)")


def written(kinds: dict[str, Column], by_start: bool) -> Column:
    """``kind:start:end``, comma-joined, by start and then kind as listed, or by kind and then start."""

    def rows(kind: str, order: int, spans: Column) -> Column:
        def row(s: Column) -> Column:
            text = F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))
            first, second = (s["start"], F.lit(order)) if by_start else (F.lit(order), s["start"])
            return F.struct(first.alias("a"), second.alias("b"), s["end"].alias("c"), text.alias("t"))

        return F.transform(spans, row)

    every = F.concat(*[rows(kind, order, spans) for order, (kind, spans) in enumerate(kinds.items())])
    return F.array_join(F.transform(F.array_sort(every), lambda x: x["t"]), ",")

"""Approximate nearest neighbours with a hash-prefix forest.

Each of ``TREES`` trees gives a vector a long hash string. A character is the
axis of a random rotation along which the vector reaches farthest, and its
sign: near vectors agree on it far more often than distant ones. A tree is the
array of these strings in order. A query has several strings in each tree, its
own and those that differ from it where the second farthest axes are hardly
nearer; their *loss* is how much farther the own ones reach, squared.

A query descends in every tree to the longest prefixes it shares with others.
Then all trees ascend together, one character at a time, until the prefixes
hold ``reach`` times the square root of the number of entries. Of the last
level only the prefixes of least loss are taken. A first pass over the strings
counts what each prefix holds, and so fixes where each query stops; the second
ranks what these prefixes hold by distance to an 8-bit copy of the vectors, and
the best ``spare`` of each query are compared with the vectors themselves. So a
vector travels whole only where it is among a query's best, and once to the
table of entries.

Equal vectors are one entry with their least ids, as many as a result can show,
so a vector with very many copies is one candidate. Strings are dealt by tree
and a short prefix; such a group is split at random, entries and queries alike,
where it holds more of them than a task should.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchwork.session import cut

TREES, AXES, LENGTH, BITS = 32, 64, 4, 7
#: Strings that a query has in a tree.
PROBES = 64
#: Entries and queries that a group should hold; one is split from twice as many on.
GROUP_ENTRIES, GROUP_QUERIES = 20_000, 5_000
#: Vectors packed at a time.
PACK = 5_000

_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotations(dimension: int, seed: int) -> np.ndarray:
    """Orthonormal directions for each tree and character, the same on every machine: (tree, character, axis, dimension)."""
    key = (dimension, seed)
    if key not in _rotations:
        axes = min(AXES, dimension)
        found = np.zeros((TREES, LENGTH, axes, dimension), dtype=np.float32)
        for t in range(TREES):
            for c in range(LENGTH):
                found[t, c] = np.linalg.qr(np.random.default_rng([seed, t, c]).normal(size=(dimension, axes)))[0].T
        _rotations.clear()
        _rotations[key] = found
    return _rotations[key]


def _reaches(vectors: np.ndarray, tree: int, place: int, seed: int) -> np.ndarray:
    """How far vectors reach along each character of a place of the string: twice the axis, plus one for the positive side."""
    along = vectors @ rotations(vectors.shape[1], seed)[tree, place].T
    return np.stack([-along, along], axis=2).reshape(len(vectors), -1)


def strings(vectors: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Hash strings of vectors as integers, ``BITS`` for each character, the first one highest."""
    out = np.zeros(len(vectors), dtype=np.int64)
    for place in range(LENGTH):
        out = out << BITS | _reaches(vectors, tree, place, seed).argmax(axis=1)
    return out


def probes(vectors: np.ndarray, tree: int, seed: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``PROBES`` strings of least loss that differ from the own one in the first ``depth`` characters, and their losses: (vector, probe)."""
    out, loss = np.zeros((len(vectors), 1), dtype=np.int64), np.zeros((len(vectors), 1), dtype=np.float32)
    for place in range(LENGTH):
        reach = _reaches(vectors, tree, place, seed)
        if place >= depth:
            out = out << BITS | reach.argmax(axis=1)[:, None]
            continue
        more = (reach.max(axis=1, keepdims=True) - reach) ** 2
        loss = (loss[:, :, None] + more[:, None, :]).reshape(len(vectors), -1)
        out = (out[:, :, None] << BITS | np.arange(reach.shape[1])).reshape(len(vectors), -1)
        best = np.argpartition(loss, PROBES - 1, axis=1)[:, :PROBES] if loss.shape[1] > PROBES else np.arange(loss.shape[1])[None, :].repeat(len(loss), 0)
        out, loss = np.take_along_axis(out, best, 1), np.take_along_axis(loss, best, 1)
    return out, loss


def usable(vector: Column) -> Column:
    """Whether a vector is neither null, empty nor zero and has only finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True)) & F.exists(vector, lambda x: x != 0)


def distinct_vectors(vectors: DataFrame, keep: int) -> DataFrame:
    """(entry, ids, vector) for each different vector: its ``keep`` least ids, entry being the least."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(set(i))[:keep] for i in held.values()], pa.list_(pa.int64()))], names=["vector", "ids"])

        for batch in batches:
            ids = batch.column("ids").to_pylist()
            for vector, more in zip(batch.column("vector").to_pylist(), ids, strict=True):
                mine = held.setdefault(vector, [])
                mine += more
                if len(mine) > 20 * keep:
                    mine[:] = sorted(set(mine))[:keep]
            if len(held) > 50_000:
                yield out()
                held.clear()
        yield out()

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("vector").to_pylist()
            packed = [(np.array(r, dtype=np.float64) + 0.0).tobytes() for r in rows]  # -0.0 as 0.0
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array([[i] for i in batch.column("vec_id").to_pylist()], pa.list_(pa.int64()))], names=["vector", "ids"])

    schema = "vector binary, ids array<long>"
    # combined where they lie, then by a share of a vector's tasks, then whole: each step bounds what one task gathers
    first = vectors.mapInArrow(raw, schema).mapInArrow(least, schema)
    once = first.repartition("vector", F.pmod(F.xxhash64("ids"), F.lit(32))).mapInArrow(least, schema)
    # a partition may have given a vector more than once
    whole = once.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))
    return whole.select(F.col("ids")[0].alias("entry"), "ids", "vector")


def _unit(packed: list[bytes]) -> np.ndarray:
    """Packed vectors, scaled so that the largest component is one; hash strings do not depend on length."""
    x = np.frombuffer(b"".join(packed), dtype=np.float64).reshape(len(packed), -1)
    return (x / np.abs(x).max(axis=1, keepdims=True)).astype(np.float32)


class Plan:
    """How strings are dealt: by tree and a hash of the first ``base`` characters to ``groups`` groups, and which groups are split."""

    def __init__(self, total: int, axes: int) -> None:
        long = math.log(max(total, 2)) / math.log(2 * max(axes, 2))
        self.depth = min(LENGTH, max(1, round(long)))  # characters in which probes vary: about one entry holds as many
        self.base = self.depth - 1  # the shortest prefix that is searched
        self.groups = max(1, math.ceil(total / GROUP_ENTRIES)) if self.base else 1
        self.split: dict[tuple[int, int], tuple[int, int]] = {}

    def group_of(self, keys: np.ndarray) -> np.ndarray:
        prefix = (keys >> BITS * (LENGTH - self.base)).astype(np.uint64)
        return ((prefix * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(self.groups)).astype(np.int64)


_DEALT = "tree int, group int, part int, query_part int, query boolean, keys binary, ids binary, codes binary, scales binary, losses binary, sizes binary, levels binary, stops binary"


def _row(**values: object) -> dict[str, object]:
    return dict.fromkeys(("codes", "scales", "losses", "sizes", "levels", "stops"), b"") | values


def _table(rows: list[dict[str, object]]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _DEALT.split(", ")]
    types = [*[pa.int32()] * 4, pa.bool_(), *[pa.binary()] * 8]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes], pa.Table]]:
    """(ids, packed vectors, all columns) of about ``PACK`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= PACK:
            yield _whole(held)
            held, rows = [], 0
    if rows:
        yield _whole(held)


def _whole(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, list[bytes], pa.Table]:
    table = pa.Table.from_batches(batches)
    return table["id"].to_numpy(), table["vector"].to_pylist(), table


def _dealt_entries(rows: DataFrame, plan: Plan, seed: int) -> DataFrame:
    """Entries (id, vector) packed by tree and group, with their strings and 8-bit copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, packed, _ in _batches(batches):
            x = np.frombuffer(b"".join(packed), dtype=np.float64).reshape(len(packed), -1)
            scale = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(np.float64).tiny)
            codes, scale, unit = np.rint(x / scale[:, None]).astype(np.int8), scale, _unit(packed)
            for t in range(TREES):
                keys = strings(unit, t, seed)
                groups, out = plan.group_of(keys), []
                for g in np.unique(groups).tolist():
                    parts, query_parts = plan.split.get((t, g), (1, 1))
                    mine = np.flatnonzero(groups == g)
                    for p in range(parts):
                        at = mine[ids[mine] % 1_000_003 % parts == p] if parts > 1 else mine
                        row = _row(tree=t, group=g, part=p, query=False, keys=keys[at].tobytes(), ids=ids[at].tobytes(), codes=codes[at].tobytes(), scales=scale[at].tobytes())
                        out += [row | {"query_part": q} for q in range(query_parts)] if len(at) else []
                yield _table(out)

    return rows.mapInArrow(run, _DEALT)


def _dealt_queries(rows: DataFrame, plan: Plan, seed: int) -> DataFrame:
    """Queries (id, vector, level, loss) packed by tree and group, with the strings that they have there and where they stop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, packed, table in _batches(batches):
            levels, stops = table["level"].to_numpy().astype(np.int32), table["loss"].to_numpy()
            x, unit = np.frombuffer(b"".join(packed), dtype=np.float64).reshape(len(packed), -1), _unit(packed)
            for t in range(TREES):
                keys, losses = probes(unit, t, seed, plan.depth)
                groups, out = plan.group_of(keys), []
                for g in np.unique(groups).tolist():
                    parts, query_parts = plan.split.get((t, g), (1, 1))
                    here = groups == g
                    mine = np.flatnonzero(here.any(axis=1))
                    for q in range(query_parts):
                        at = mine[ids[mine] % 999_983 % query_parts == q] if query_parts > 1 else mine
                        if len(at):
                            row = _row(tree=t, group=g, query_part=q, query=True, keys=keys[at][here[at]].tobytes(), losses=losses[at][here[at]].astype(np.float32).tobytes(), sizes=here[at].sum(axis=1).astype(np.int32).tobytes(), ids=ids[at].tobytes(), codes=x[at].tobytes(), levels=levels[at].tobytes(), stops=stops[at].tobytes())
                            out += [row | {"part": p} for p in range(parts)]
                yield _table(out)

    return rows.mapInArrow(run, _DEALT)


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), dtype=kind)


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    query = table["query"].to_numpy()
    return table.filter(pa.array(~query)), table.filter(pa.array(query))


def _prefixes(keys: np.ndarray, losses: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The different prefixes of a query's strings, lowest string of each, with the least loss of each."""
    shift = BITS * (LENGTH - level)
    prefix = keys >> shift
    order = np.lexsort((losses, prefix))
    first = np.ones(len(order), dtype=bool)
    first[1:] = prefix[order[1:]] != prefix[order[:-1]]
    return prefix[order[first]] << shift, losses[order[first]]


def _held(entries: np.ndarray, low: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted strings of entries have each prefix."""
    return np.searchsorted(entries, low), np.searchsorted(entries, low + (1 << BITS * (LENGTH - level)))


def _each_query(asked: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    keys, losses, edges = _joined(asked, "keys", "i8"), _joined(asked, "losses", "f4"), np.append(0, np.cumsum(_joined(asked, "sizes", "i4")))
    for i, query in enumerate(_joined(asked, "ids", "i8").tolist()):
        yield query, keys[edges[i] : edges[i + 1]], losses[edges[i] : edges[i + 1]]


def _counter(plan: Plan):  # noqa: ANN202
    def count(table: pa.Table) -> pa.Table:
        """(id, levels, losses, counts): what each prefix of each query holds in this part of the group."""
        entries, asked = _sides(table)
        strings_here = np.sort(_joined(entries, "keys", "i8"))
        out: list[list] = [[], [], [], []]
        for query, keys, losses in _each_query(asked) if len(strings_here) else []:
            found = []
            for level in range(max(plan.base, 1), LENGTH + 1) if plan.base else range(LENGTH + 1):
                low, loss = _prefixes(keys, losses, level)
                begins, ends = _held(strings_here, low, level)
                some = ends > begins
                found.append((np.full(int(some.sum()), level, dtype=np.int8), loss[some], (ends - begins)[some]))
            levels, loss, counts = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(levels):
                for column, value in zip(out, (query, levels.tobytes(), loss.astype(np.float32).tobytes(), counts.astype(np.int64).tobytes()), strict=True):
                    column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, [pa.int64(), *[pa.binary()] * 3], strict=True)], names=["id", "levels", "losses", "counts"])

    return count


def _stopper(enough: int):  # noqa: ANN202
    def stop(table: pa.Table) -> pa.Table:
        """(id, level, loss, candidates): the level to which a query ascends in all trees, and the largest loss it takes there."""
        levels, losses, counts = _joined(table, "levels", "i1"), _joined(table, "losses", "f4"), _joined(table, "counts", "i8")
        for level in sorted(set(levels.tolist()), reverse=True):
            mine = levels == level
            if counts[mine].sum() >= enough:
                break
        order = np.argsort(losses[mine], kind="stable")
        so_far = np.cumsum(counts[mine][order])
        at = min(int(np.searchsorted(so_far, enough)), len(so_far) - 1)
        return pa.table({"id": table["id"][:1], "level": pa.array([int(level)], pa.int32()), "loss": pa.array([float(losses[mine][order][at])], pa.float64()), "candidates": pa.array([int(so_far[at])], pa.int64())})

    return stop


def _ranker(spare: int):  # noqa: ANN202
    def rank(table: pa.Table) -> pa.Table:
        """(q, entry, about): the nearest entries of each query by their 8-bit copies."""
        entries, asked = _sides(table)
        out: list[list] = [[], [], []]
        keys, ids, scales = _joined(entries, "keys", "i8"), _joined(entries, "ids", "i8"), _joined(entries, "scales", "f8")
        if len(keys):
            order = np.argsort(keys, kind="stable")
            keys, ids, scales = keys[order], ids[order], scales[order]
            codes = _joined(entries, "codes", "i1").reshape(len(keys), -1)[order]
            x = _joined(asked, "codes", "f8").reshape(-1, codes.shape[1])
            levels, stops = _joined(asked, "levels", "i4").tolist(), _joined(asked, "stops", "f8").tolist()
            for i, (query, own, losses) in enumerate(_each_query(asked)):
                level, most = levels[i], stops[i] + 1e-6
                found = []
                for at in (level, level + 1) if level < LENGTH else (level,):
                    low, loss = _prefixes(own, losses, at)
                    begins, ends = _held(keys, low[(loss <= most) | (at > level)], at)
                    found += [np.arange(a, b) for a, b in zip(begins.tolist(), ends.tolist(), strict=True) if b > a]
                if not found:
                    continue
                near = np.unique(np.concatenate(found))
                square = ((codes[near] * scales[near][:, None] - x[i]) ** 2).sum(axis=1)
                best = np.argpartition(square, spare - 1)[:spare] if len(near) > spare else np.arange(len(near))
                out[0].append(np.full(len(best), query))
                out[1].append(ids[near[best]])
                out[2].append(square[best])
        flat = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"q": flat[0].astype(np.int64), "entry": flat[1].astype(np.int64), "about": flat[2].astype(np.float64)})

    return rank


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, reach: float = 30.0, spare: int = 50, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of ``vectors`` for each of ``queries``, both (vec_id, vector).

    A query's own id is no candidate. Score is the Euclidean distance; ties go
    to the smaller id. The trees ascend until together they hold ``reach``
    times the root of the number of entries, counting one for each tree that
    finds an entry; a query for which they hold fewer than ``k`` others is
    compared with all entries. Unusable vectors and null ids take no part.
    Vectors are compared within each length, with a forest for each length
    asked for. Rows that repeat an id and vector count once; an id with several
    vectors gets one list, of the nearest to any of them. Empty tables give no
    rows, and further columns are not looked at.
    """
    ok = vectors.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    asked = queries.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    sizes = sorted(r[0] for r in asked.select(F.size("vector")).distinct().collect()) or [0]
    fits = lambda rows, size: rows.where(F.size("vector") == size)
    found = [_nearest(fits(ok, size), fits(asked, size).distinct(), size, k, reach, spare, seed) for size in sizes]
    if len(found) == 1:
        return found[0]
    rows = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # an id may have vectors of several lengths
    return _ranked(rows, k)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(r, dtype=np.float64).tobytes() for r in batch.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "vector"])

    return rows.mapInArrow(run, "id long, vector binary")


def _descents(entries: DataFrame, asked: DataFrame, total: int, dimension: int, reach: float, seed: int) -> tuple[Plan, DataFrame, DataFrame]:
    """The plan, the dealt entries, and (id, level, loss, candidates) of each query (id, vector) that shares a prefix with an entry."""
    plan = Plan(total, min(AXES, dimension))
    one = entries.select(F.col("entry").alias("id"), "vector")
    nowhere = asked.withColumns({"level": F.lit(0), "loss": F.lit(0.0)})
    deal = lambda: cut(_dealt_entries(one, plan, seed).unionByName(_dealt_queries(nowhere, plan, seed)))
    dealt = deal()
    # groups that hold too much are split; they are few, as the mean group is within the bounds
    sizes = dealt.groupBy("tree", "group").agg(*[F.sum(F.when(F.col("query") == q, F.length("ids") / 8).otherwise(0)).alias(n) for q, n in ((False, "entries"), (True, "queries"))])
    for r in sizes.where((F.col("entries") > 2 * GROUP_ENTRIES) | (F.col("queries") > 2 * GROUP_QUERIES)).collect():
        plan.split[r["tree"], r["group"]] = (max(1, math.ceil(r["entries"] / GROUP_ENTRIES)), max(1, math.ceil(r["queries"] / GROUP_QUERIES)))
    if plan.split:
        dealt = deal()
    counts = dealt.drop("codes", "scales").groupBy(_GROUP).applyInArrow(_counter(plan), "id long, levels binary, losses binary, counts binary")
    stops = counts.groupBy("id").applyInArrow(_stopper(math.ceil(reach * math.sqrt(total))), "id long, level int, loss double, candidates long")
    return plan, dealt.where(~F.col("query")), cut(stops)


_GROUP = ["tree", "group", "part", "query_part"]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, added up from the first component to the last."""
    return np.sqrt(np.cumsum((x - y) ** 2, axis=1)[:, -1])


def _compared(pairs: DataFrame) -> DataFrame:
    """(q, entry, x, y) to (q, entry, score): distances of packed vectors, in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.float64).reshape(batch.num_rows, -1) for c in ("x", "y"))
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("entry"), pa.array(_distances(x, y))], names=["q", "entry", "score"])

    return pairs.select("q", "entry", "x", "y").mapInArrow(run, "q long, entry long, score double")


def _against_all(few: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(q, entry, score): the ``k`` nearest of all entries for queries (id, vector), block by block."""
    blocks, query_blocks = (max(1, math.ceil(x.count() / n)) for x, n in ((entries, GROUP_ENTRIES), (few, GROUP_QUERIES)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    there = entries.select(of("entry", blocks).alias("block"), every(query_blocks).alias("query_block"), F.lit(False).alias("query"), F.col("entry").alias("id"), "vector")
    asking = few.select(every(blocks).alias("block"), of("id", query_blocks).alias("query_block"), F.lit(True).alias("query"), "id", "vector")

    def nearest_of(table: pa.Table) -> pa.Table:
        held, asked = _sides(table)
        out: list[list] = [[], [], []]
        if len(held):
            x, ids = np.frombuffer(b"".join(held["vector"].to_pylist()), dtype=np.float64).reshape(len(held), -1), held["id"].to_numpy()
            for query, packed in zip(asked["id"].to_pylist(), asked["vector"].to_pylist(), strict=True):
                distance = _distances(x, np.frombuffer(packed, dtype=np.float64))
                best = np.lexsort((ids, distance))[:k]
                for column, value in zip(out, (np.full(len(best), query), ids[best], distance[best]), strict=True):
                    column.append(value)
        flat = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"q": flat[0].astype(np.int64), "entry": flat[1].astype(np.int64), "score": flat[2].astype(np.float64)})

    return there.unionByName(asking).groupBy("block", "query_block").applyInArrow(nearest_of, "q long, entry long, score double")


def _nearest(ok: DataFrame, asked: DataFrame, dimension: int, k: int, reach: float, spare: int, seed: int) -> DataFrame:
    """``nearest`` for usable vectors (vec_id, vector) and queries (id, vector) of one length."""
    entries = cut(distinct_vectors(ok, k + 1))
    named = cut(_packed(asked).select(F.monotonically_increasing_id().alias("q"), F.col("id").alias("query_id"), "vector"))
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    questions = cut(named.select(F.col("q").alias("id"), "vector").repartition(tasks, "id"))  # few bytes, but much work each
    total = entries.count()
    plan, dealt, stops = _descents(entries, questions, total, dimension, reach, seed)
    stopped = _dealt_queries(questions.join(stops, "id").select("id", "vector", "level", "loss").repartition(tasks, "id"), plan, seed)
    ranked = dealt.unionByName(stopped).groupBy(_GROUP).applyInArrow(_ranker(max(spare, k + 1)), "q long, entry long, about double")
    closest = W.partitionBy("q").orderBy("about", "entry")
    best = ranked.groupBy("q", "entry").agg(F.min("about").alias("about")).withColumn("place", F.row_number().over(closest)).where(F.col("place") <= max(spare, k + 1))
    pairs = best.join(entries.select("entry", F.col("vector").alias("y")), "entry").join(named.select("q", F.col("vector").alias("x")), "q")

    def listed(scored: DataFrame) -> DataFrame:
        rows = scored.join(entries.select("entry", "ids"), "entry").join(named.select("q", "query_id"), "q")
        return rows.select("q", "query_id", "score", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))

    found = cut(listed(_compared(pairs)))
    short = cut(questions.join(found.groupBy(F.col("q").alias("id")).agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k), "id", "left_anti"))
    if not short.isEmpty():
        found = found.join(short.select(F.col("id").alias("q")), "q", "left_anti").unionByName(listed(_against_all(short, entries, k + 1)))
    return _ranked(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), k)


#: Each query's nearest among all, which the forest finds wherever its recall is 1.
SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

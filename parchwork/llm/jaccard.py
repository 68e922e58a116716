"""Near-duplicate groups: a Jaccard self-join on word shingles with PartEnum signatures.

Two documents link when the Jaccard similarity of their shingle sets is at
least 75 %. No link is lost and none is accepted without comparing the sets.
Equal sets are one *key* (a hash of the set) from the start, so exact copies
cost nothing further.

Signatures. Set sizes fall into bands; linked sets a and b meet in a band that
both emit in. A band parts the shingles' hash domain into ``parts(band)``
partitions and each of these into three cells; for each partition, every
subset of two cells is a signature with the shingles in it. Linked sets differ
in at most k = (a + b) / 7 shingles. A partition in which they do not differ
shares all three subsets, one with a single difference shares the subset that
leaves its cell out: both together at least 2 P - k signatures. P counts the
partitions in which a set occupies two cells or more, where no subset is empty.
That bound is the set's *need*. Small bands are parted so finely that every
shingle is a signature; there the need is 75 % of the set. A set whose bound is
below one also emits its single shingles, and its need is one.

Groups. The holders of a signature form a bucket, named by its least key, the
*pivot*; all buckets with one pivot are one group, in which a key counts as
often as it is in these buckets. A key in fewer buckets than it needs drops
out. The others leave out their largest groups as long as what they leave out
counts less than they need (all keys rank the groups alike, by size). A linked
pair shares at least what either needs, so neither leaves out the smallest
group that they share, and they meet there. A passage that many documents hold
thus makes no work, as few buckets of a document come from it.

Comparison. First each key goes to the group it counts most in; then groups
that still hold several components are searched again. A group is dealt in
blocks of bounded size. A block is compared within one task, set against set,
but only sets that are in different components so far, and what leaves it are
links that join two components: fewer than it has members. In the second
round, the queries are those members that are not in the group's largest
component, against all of the group's blocks. So nearly connected groups cost
work in proportion to their size, and no row is ever made for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchwork.llm.caches import begin
from parchwork.llm.components import components
from parchwork.llm.shingles import mix, set_key, shingle_sets
from parchwork.session import cut

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Signatures that a part of the hash range should hold.
PART_SIGNATURES = 500_000
#: Signatures that a task packs at a time.
PACK = 250_000
#: Members and shingles that a block of a group should hold at most.
BLOCK_MEMBERS, BLOCK_SHINGLES = 2048, 500_000
#: Documents looked at for signatures with very many holders, and the holders among them from which a signature counts as such.
SAMPLE, HOT = 20_000, 200
#: Sets that are compared one by one; larger groups are compared through an index.
FEW = 6

#: Upper ends of the size bands: up to 3, and then doubling.
BAND_ENDS = np.array([3 * 2**i for i in range(40)], dtype=np.int64)
#: The last band in which every shingle is a signature of its own.
FINE = 3


def band_of(size: int) -> int:
    return int(np.searchsorted(BAND_ENDS, size))


def parts_of(band: int) -> int:
    """First-level partitions of a band: a set at its upper end has about five shingles in each."""
    return int(0.2 * BAND_ENDS[band]) + 6


def bands_for(size: int) -> list[int]:
    """The bands in which a size emits: its own, and the one below if a set of 3/4 of the size may be in it.

    Sets of three, which link to sets of four, emit in the band of four.
    """
    own = max(1, band_of(size))
    least = -(-PERCENT * size // 100)
    return [own, own - 1] if own > 1 and least <= BAND_ENDS[own - 1] else [own]


def signatures(shingles: np.ndarray) -> tuple[np.ndarray, int]:
    """Signatures of a sorted set, and its need: how many of them it shares at least with each set it links to."""
    size = len(shingles)
    if size < BAND_ENDS[0]:  # links to equal sets only, which have its key
        return np.zeros(0, dtype=np.uint64), 1
    found, needs = [], []
    own = max(1, band_of(size))
    for band in bands_for(size):
        if band <= FINE:
            found.append(mix(shingles + np.uint64(0x9D2C5680 + band)))
            needs.append(-(-PERCENT * size // 100))
            continue
        n = parts_of(band)
        cell = ((mix(shingles + np.uint64(band + 1)) >> np.uint64(32)) * np.uint64(3 * n) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.ones(size, dtype=bool)
        np.not_equal(cell[1:], cell[:-1], out=first[1:])
        at = np.flatnonzero(first)
        content = np.zeros(3 * n, dtype=np.uint64)
        content[cell[at]] = np.add.reduceat(mix(shingles[order] ^ np.uint64(0x5851F42D4C957F2D)), at)
        held = np.zeros(3 * n, dtype=bool)
        held[cell[at]] = True
        content, held = content.reshape(n, 3), held.reshape(n, 3)
        cells = held.sum(axis=1)
        subset = content.sum(axis=1, dtype=np.uint64, keepdims=True) - content  # without one cell
        name = np.arange(3 * n, dtype=np.uint64).reshape(n, 3) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(band)
        some = cells[:, None] - held > 0
        found.append(mix(mix(subset) + name)[some])
        # a partner in the own band has up to 4/3 of the size, one in the band below no more than its end
        differ = (size + 4 * size // 3) // 7 if band == own else (size + int(BAND_ENDS[band])) // 7
        needs.append(2 * int((cells > 1).sum()) - differ)
    need = min(needs)
    if need < 1:
        found.append(mix(shingles + np.uint64(0x1B873593)))
    return np.concatenate(found), max(1, need)


def document_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, version, n_shingles, set_key) of every row; the key is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for row, found in shingle_sets(batch.column("text")):
                sizes[row] = len(found)
                if len(found):
                    keys[row] = set_key(found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(sizes), pa.array(keys, mask=sizes == 0)], names=["doc_id", "version", "n_shingles", "set_key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "version", "text").mapInArrow(run, "doc_id long, version long, n_shingles long, set_key long")


def _range_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _runs(values: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in sorted arrays."""
    first = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    for x in more:
        first[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(first)


def _rows(part: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row for each part, with the packed values of each column."""
    order = np.argsort(part, kind="stable")
    part, at = part[order], _runs(part[order])
    ends = np.append(at[1:], len(part))
    packed = []
    for column in columns:
        data = column[order]
        packed.append(pa.array([data[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), *packed], names=["part", *names])


def _unpacked(batches: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> list[np.ndarray]:
    """The columns of packed rows, each as one array."""
    held: dict[str, list[np.ndarray]] = {name: [] for name in kinds}
    for batch in batches:
        for name, kind in kinds.items():
            held[name] += [np.frombuffer(x, dtype=kind) for x in batch.column(name).to_pylist()]
    return [np.concatenate(x) if x else np.zeros(0, dtype=kinds[name]) for name, x in held.items()]


#: The low 40 bits of a signature; the part it is dealt to stands for the high ones.
_SHORT = np.dtype(("V", 5))


def _shorten(hashes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).view(_SHORT).reshape(-1)


def _lengthen(short: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(short), 8), dtype=np.uint8)
    wide[:, :5] = short.view(np.uint8).reshape(-1, 5)
    return wide.view("<u8").reshape(-1)


def hot_signatures(docs: DataFrame, rows: int, parts: int) -> dict[int, int]:
    """Signatures that one in a hundred documents holds or more, each with a name for its bucket.

    Found among about ``SAMPLE`` documents, so there are at most a hundred times
    as many as a document has, whatever the input. The name is the least key
    seen. This decides only where holders meet, not whether: the bucket of a
    signature that is missed has its least key for a name.
    """
    part = F.lit(1.0 if rows <= SAMPLE else SAMPLE / rows)
    some = docs.where(F.pmod(F.xxhash64("doc_id", "version"), F.lit(1_000_003)) < part * 1_000_003)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, found in shingle_sets(batch.column("text")):
                if len(found) >= BAND_ENDS[0] and (key := set_key(found)) not in held:
                    held[key] = signatures(found)[0]
            if sum(map(len, held.values())) > PACK:
                yield packed(held)
                held = {}
        if held:
            yield packed(held)

    def packed(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        hashes = np.concatenate(list(held.values())) if held else np.zeros(0, dtype=np.uint64)
        keys = np.repeat(np.array(list(held), dtype=np.int64), [len(x) for x in held.values()])
        return _rows(_range_of(hashes, parts), [hashes, keys], ["hashes", "keys"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys = _unpacked(batches, {"hashes": "u8", "keys": "i8"})
        if not len(hashes):
            return
        order = np.lexsort((keys, hashes))
        at = order[_runs(hashes[order], keys[order])]
        hashes, keys = hashes[at], keys[at]
        begins = _runs(hashes)
        hot = np.diff(np.append(begins, len(hashes))) >= HOT
        yield pa.RecordBatch.from_arrays([pa.array(hashes[begins[hot]].view(np.int64)), pa.array(keys[begins[hot]])], names=["signature", "name"])

    found = some.select("text").mapInArrow(each, "part int, hashes binary, keys binary").repartitionById(parts, F.col("part")).mapInArrow(count, "signature long, name long")
    return {r["signature"]: r["name"] for r in found.collect()}


def _packed_signatures(docs: DataFrame, parts: int, hot: dict[int, int]) -> DataFrame:
    """The signatures of all texts, dealt by hash range: (part, hashes, keys, needs, sizes, counts), in order of keys.

    Those in ``hot`` are dealt by key instead, to parts numbered from ``parts``
    on, with the number of their name for a hash: no task gathers the holders.
    """
    hot_hashes = np.array(sorted(hot), dtype=np.int64).view(np.uint64)
    hot_hashes.sort()

    def pack(held: list[tuple[int, np.ndarray, int, int]]) -> pa.RecordBatch:
        hashes = np.concatenate([s for _, s, _, _ in held])
        owner = np.repeat(np.arange(len(held)), [len(s) for _, s, _, _ in held])
        keys = np.array([k for k, _, _, _ in held], dtype=np.int64)
        needs = np.minimum([n for _, _, n, _ in held], 65535).astype(np.uint16)  # a lower need is safe
        sizes = np.array([n for _, _, _, n in held], dtype=np.uint32)
        part = _range_of(hashes, parts)
        if len(hot_hashes):
            place = np.minimum(np.searchsorted(hot_hashes, hashes), len(hot_hashes) - 1)
            is_hot = hot_hashes[place] == hashes
            part[is_hot] = parts + _range_of(mix(keys[owner[is_hot]].view(np.uint64)), parts)
            hashes[is_hot] = place[is_hot].astype(np.uint64)  # as the number of its name
        order = np.argsort(part, kind="stable")
        hashes, owner, part = _shorten(hashes[order]), owner[order], part[order]
        at = _runs(part)
        rows: list[list] = [[], [], [], [], [], []]
        for a, b in zip(at.tolist(), np.append(at[1:], len(part)).tolist(), strict=True):
            first = a + _runs(owner[a:b])
            counts = np.diff(np.append(first, b)).astype(np.uint32)
            mine = owner[first]
            for column, value in zip(rows, (int(part[a]), hashes[a:b].tobytes(), keys[mine].tobytes(), needs[mine].tobytes(), sizes[mine].tobytes(), counts.tobytes()), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(c, pa.binary()) for c in rows[1:]]], names=["part", "hashes", "keys", "needs", "sizes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        held, size = [], 0
        for batch in batches:
            for _, found in shingle_sets(batch.column("text")):
                if len(found) < BAND_ENDS[0] or (key := set_key(found)) in done:  # a copy in the same task; others meet in the buckets
                    continue
                if len(done) > 200_000:
                    done.clear()
                done.add(key)
                sigs, need = signatures(found)
                held.append((key, sigs, need, len(found)))
                size += len(sigs)
                if size >= PACK:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return docs.select("text").mapInArrow(run, "part int, hashes binary, keys binary, needs binary, sizes binary, counts binary")


def _hot_names(hot: dict[int, int]) -> np.ndarray:
    """Names in order of their signatures as unsigned numbers."""
    return np.array([hot[h] for h in sorted(hot, key=lambda h: h & (1 << 64) - 1)], dtype=np.int64)


def _memberships(packed: DataFrame, parts: int, hot: dict[int, int]) -> DataFrame:
    """(key, need, size, pivot, n): in how many buckets with that pivot a key is, for keys in as many buckets as they need.

    Buckets are found by hash range; their (key, pivot) pairs, counted, are
    dealt by key range, packed again, and summed.
    """
    kinds = {"keys": "i8", "needs": "u2", "sizes": "u4", "pivots": "i8", "n": "u4"}
    names = _hot_names(hot)

    def hot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys, needs, sizes, counts = _unpacked(batches, {"hashes": _SHORT, "keys": "i8", "needs": "u2", "sizes": "u4", "counts": "u4"})
        if not len(hashes):
            return
        owner, numbers = np.repeat(np.arange(len(keys)), counts), _lengthen(hashes).astype(np.int64)
        order = np.lexsort((numbers, keys[owner]))
        at = order[_runs(keys[owner[order]], numbers[order])]  # copies in several tasks bring a key more than once
        keys, needs, sizes, pivots = keys[owner[at]], needs[owner[at]], sizes[owner[at]], names[numbers[at]]
        order = np.lexsort((pivots, keys))
        keys, needs, sizes, pivots = keys[order], needs[order], sizes[order], pivots[order]
        at = _runs(keys, pivots)
        n = np.diff(np.append(at, len(keys))).astype(np.uint32)
        yield _rows(_range_of(mix(keys[at].view(np.uint64)), parts), [keys[at], needs[at], sizes[at], pivots[at], n], list(kinds))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys, needs, sizes, counts = _unpacked(batches, {"hashes": _SHORT, "keys": "i8", "needs": "u2", "sizes": "u4", "counts": "u4"})
        if not len(hashes):
            return
        hashes, owner = _lengthen(hashes), np.repeat(np.arange(len(keys), dtype=np.int32), counts)
        order = np.argsort(hashes, kind="stable")
        sorted_hashes = hashes[order]
        again = np.zeros(len(order), dtype=bool)
        np.equal(sorted_hashes[1:], sorted_hashes[:-1], out=again[1:])
        again[:-1] |= again[1:].copy()
        order = order[again]  # all that occur once go before anything else is sorted
        if not len(order):
            return
        hashes, owner = hashes[order], owner[order]
        order = np.lexsort((keys[owner], hashes))
        at = order[_runs(hashes[order], keys[owner[order]])]
        hashes, owner = hashes[at], owner[at]
        begins = _runs(hashes)
        held = np.diff(np.append(begins, len(hashes)))
        pivots, several = np.repeat(keys[owner[begins]], held), np.repeat(held > 1, held)
        owner, pivots = owner[several], pivots[several]
        if not len(owner):
            return
        order = np.lexsort((pivots, keys[owner]))
        owner, pivots = owner[order], pivots[order]
        at = _runs(keys[owner], pivots)
        n = np.diff(np.append(at, len(owner))).astype(np.uint32)
        owner, pivots = owner[at], pivots[at]
        yield _rows(_range_of(mix(keys[owner].view(np.uint64)), parts), [keys[owner], needs[owner], sizes[owner], pivots, n], list(kinds))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, needs, sizes, pivots, n = _unpacked(batches, kinds)
        if not len(keys):
            return
        order = np.lexsort((pivots, keys))
        keys, needs, sizes, pivots = keys[order], needs[order].astype(np.int64), sizes[order].astype(np.int64), pivots[order]
        at = _runs(keys, pivots)
        n = np.add.reduceat(n[order].astype(np.int64), at)
        keys, needs, sizes, pivots = keys[at], needs[at], sizes[at], pivots[at]
        own = _runs(keys)
        enough = np.flatnonzero(np.repeat(np.add.reduceat(n, own) >= needs[own], np.diff(np.append(own, len(keys)))))
        for lo in range(0, len(enough), 50_000):
            some = enough[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (keys, needs, sizes, pivots, n)], names=["key", "need", "size", "pivot", "n"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from (buckets if batch.column("part")[0].as_py() < parts else hot_counts)(chain([batch], batches))

    made = "part int, keys binary, needs binary, sizes binary, pivots binary, n binary"
    found = packed.repartitionById(2 * parts if hot else parts, F.col("part")).mapInArrow(either, made)
    return found.repartitionById(parts, F.col("part")).mapInArrow(sums, "key long, need long, size long, pivot long, n long")


def _kept(edges: DataFrame) -> DataFrame:
    """Memberships without the largest groups that a key can leave out, and without groups of one."""
    of_group = edges.groupBy("pivot").agg(F.count("*").alias("members"))
    before = W.partitionBy("key").orderBy(F.desc("members"), "pivot").rowsBetween(W.unboundedPreceding, W.currentRow)
    left = edges.join(of_group, "pivot").withColumn("so_far", F.sum("n").over(before)).where(F.col("so_far") >= F.col("need")).select("key", "size", "pivot", "n")
    left = cut(left)
    return cut(left.join(left.groupBy("pivot").agg(F.count("*").alias("members")).where("members > 1").select("pivot"), "pivot", "left_semi"))


def _sets(docs: DataFrame, owners: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, shingles) for the wanted keys, each from the text of its owner."""
    wanted = keys.join(owners, "set_key").select("doc_id", F.col("set_key").alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, keys, values = batch.column("wanted").to_pylist(), [], []
            for row, found in shingle_sets(batch.column("text")):
                if len(found) and set_key(found) == wanted[row]:  # rows may repeat a doc_id
                    keys.append(wanted[row])
                    values.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.binary())], names=["key", "shingles"])

    found = docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(run, "key long, shingles binary")
    return cut(found)


def links_within(keys: np.ndarray, labels: np.ndarray, queries: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between members of different labels, of which one is a query: enough of them to join all labels that they can join."""
    members, sizes, labels = len(keys), np.array([len(x) for x in sets]), labels.copy()
    found: list[tuple[int, int]] = []

    def join(x: int, near: np.ndarray) -> None:
        for y in near.tolist():
            if labels[y] != labels[x]:
                found.append((int(keys[x]), int(keys[y])))
                labels[labels == labels[y]] = labels[x]

    if members <= FEW:
        for x in np.flatnonzero(queries).tolist():
            near = []
            for y in np.flatnonzero(labels != labels[x]).tolist():
                both = np.sort(np.concatenate([sets[x], sets[y]]), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= PERCENT * (len(both) - common):
                    near.append(y)
            join(x, np.array(near, dtype=np.int64))
        return found
    values, owner = np.concatenate(sets), np.repeat(np.arange(members, dtype=np.int32), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    at = _runs(values)
    held = np.diff(np.append(at, len(values)))
    column = np.repeat(np.arange(len(at)), held)
    held_by_many = held > max(8, members // 16)
    # shingles of many members are bits of each member, those of few are lists of members
    number = np.cumsum(held_by_many) - 1
    many = held_by_many[column]
    bits = np.zeros((members, -(-max(1, int(held_by_many.sum())) // 64) * 64), dtype=bool)
    bits[owner[many], number[column[many]]] = True
    bits = np.packbits(bits, axis=1).view(np.uint64)
    few = ~many & (held[column] > 1)
    few_owner, few_column = owner[few], column[few]  # in order of columns: the lists
    own_order = np.argsort(few_owner, kind="stable")
    own_columns, own_edges = few_column[own_order], np.searchsorted(few_owner[own_order], np.arange(members + 1))
    list_begins = np.searchsorted(few_column, own_columns)
    list_sizes = held[own_columns]
    for x in np.flatnonzero(queries).tolist():
        low, high = -(-PERCENT * int(sizes[x]) // 100), 100 * int(sizes[x]) // PERCENT
        others = np.flatnonzero((labels != labels[x]) & (sizes >= low) & (sizes <= high))
        if not len(others):
            continue
        common = np.bitwise_count(bits[others] & bits[x]).sum(axis=1, dtype=np.int64)
        a, b = own_edges[x], own_edges[x + 1]
        if b > a:
            n = list_sizes[a:b]
            steps = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            common += np.bincount(few_owner[np.repeat(list_begins[a:b], n) + steps], minlength=members)[others]
        join(x, others[100 * common >= PERCENT * (sizes[others] + sizes[x] - common)])
    return found


def _named(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each end of the links, the least key that they connect it with."""
    least: dict[int, int] = {}

    def name(k: int) -> int:
        while least.setdefault(k, k) != k:
            least[k] = k = least[least[k]]
        return k

    for x, y in links:
        x, y = sorted((name(x), name(y)))
        least[y] = x
    return [(k, name(k)) for k in list(least)]


def _searched(members: DataFrame, sets: DataFrame, labelled: bool = False) -> DataFrame:
    """(a, b): links found among ``members`` (pivot, x, y, key, label, query), block by block; x and y number a group's blocks.

    ``labelled`` for each linked key with the least key that links of its block
    connect it with.
    """
    names = ["pivot", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple[list, list, list, list]]:
            last, held = None, ([], [], [], [])
            for batch in batches:
                for row in zip(*[batch.column(c).to_pylist() for c in (*names, "key", "label", "query")], batch.column("shingles"), strict=True):
                    if row[:3] != last:
                        if len(held[0]) > 1:
                            yield held
                        last, held = row[:3], ([], [], [], [])
                    for column, value in zip(held, row[3:], strict=True):
                        column.append(value)
            if len(held[0]) > 1:
                yield held

        begin("shingles")
        out: list[tuple[int, int]] = []
        for keys, labels, queries, shingles in groups():
            found = links_within(np.array(keys, dtype=np.int64), np.array(labels, dtype=np.int64), np.array(queries, dtype=bool), [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in shingles])
            out += _named(found) if labelled else found
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    with_sets = members.join(sets.select("key", "shingles"), "key").select(*names, "key", "label", "query", "shingles")
    return cut(with_sets.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long").distinct())


def _blocks(members: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(members / BLOCK_MEMBERS, shingles / BLOCK_SHINGLES)).cast("int")


def _labels(kept: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, label) for keys that links connect with others: equal labels where links connect."""
    one = F.lit(0)
    best = cut(kept.groupBy("key").agg(F.max_by("pivot", F.struct("n", "pivot")).alias("pivot"), F.first("size").alias("size")))
    of_group = best.groupBy("pivot").agg(F.count("*").alias("members"), F.sum("size").alias("total")).where("members > 1")
    first = best.join(of_group, "pivot").withColumn("x", F.pmod(F.xxhash64("key"), _blocks(F.col("members"), F.col("total"))).cast("int"))
    # each key is in one block here, so what the blocks find needs no joining up: pairs are keys and labels
    labels = _searched(first.select("pivot", "x", one.alias("y"), "key", F.col("key").alias("label"), F.lit(True).alias("query")), sets, labelled=True)
    labels = labels.select(F.col("a").alias("node"), F.col("b").alias("label"))
    held = cut(kept.join(labels, F.col("key") == F.col("node"), "left").select("key", "pivot", "size", F.coalesce("label", "key").alias("label")))
    of_label = held.groupBy("pivot", "label").agg(F.count("*").alias("members"), F.sum("size").alias("total"))
    of_group = of_label.groupBy("pivot").agg(F.max_by("label", F.struct("members", "label")).alias("largest"), F.sum("members").alias("members"), F.sum("total").alias("total"), F.max("members").alias("most"), F.max_by("total", F.struct("members", "label")).alias("most_total")).where("members > most")
    queries = _blocks(F.col("members") - F.col("most"), F.col("total") - F.col("most_total"))
    open_ = of_group.select("pivot", "largest", queries.alias("x_blocks"), _blocks(F.col("members"), F.col("total")).alias("y_blocks"))
    again = cut(held.join(open_, "pivot"))
    every = lambda n: F.explode(F.sequence(one, F.col(n) - 1))
    number = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    asking = again.where("label != largest").select("pivot", number("x_blocks").alias("x"), every("y_blocks").alias("y"), "key", "label", F.lit(True).alias("query"))
    asked = again.select("pivot", every("x_blocks").alias("x"), number("y_blocks").alias("y"), "key", "label", F.lit(False).alias("query"), ((F.col("label") != F.col("largest")) & (number("x_blocks") == F.col("x"))).alias("there"))
    rows = asking.unionByName(asked.where("not there").drop("there"))  # a query is in its own cell already
    links = _searched(rows, sets)
    if links.isEmpty():
        return labels
    # components of labels, which are far fewer than keys
    for k in ("a", "b"):
        links = links.join(labels, F.col(k) == F.col("node"), "left").withColumn(k, F.coalesce("label", k)).select("a", "b")
    joined = cut(components(links).select(F.col("node").alias("was"), F.col("label").alias("now")))
    renamed = labels.join(joined, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label"))
    return renamed.unionByName(joined.select(F.col("was").alias("node"), F.col("now").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach. Texts that are null
    or hold no word have no shingles and are alone, as are rows whose doc_id is
    null (component null). Rows that repeat a doc_id are documents of their own
    with the same id. Texts are read whole, however long; an empty table gives
    no rows; further columns, of whatever name, are not looked at.
    """
    return _grouped(docs.withColumn("version", F.lit(0).cast("long"))).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` of ``docs`` (doc_id, version, text) with each row's version and its group's label (null without shingles)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "version", "text")
    keyed = cut(document_keys(docs))
    owners = cut(keyed.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")))
    total = owners.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // PART_SIGNATURES))
    named = docs.where(F.col("doc_id").isNotNull())
    hot = hot_signatures(named, keyed.count(), parts)
    edges = cut(_memberships(_packed_signatures(named, parts, hot), parts, hot))
    kept = _kept(edges)
    sets = _sets(docs, owners, kept.select(F.col("key").alias("set_key")).distinct())
    labels = _labels(kept, sets)
    named = owners.select("set_key", F.col("doc_id").alias("own")).join(labels, F.col("set_key") == F.col("node"), "left")
    named = cut(named.select("set_key", "own", F.coalesce("label", "set_key").alias("label")))
    least_id = cut(named.groupBy("label").agg(F.min("own").alias("component")))
    of_key = cut(named.join(least_id, "label").select("set_key", "component", "label"))
    found = keyed.join(of_key, "set_key", "left")
    return found.select("doc_id", "version", "label", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group, of the least doc_id; rows without a doc_id or a word are alone."""
    version = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])  # tells rows of a doc_id apart, but for equal ones
    found = _grouped(docs.withColumn("version", version)).where(F.col("doc_id").isNotNull())
    rows = found.groupBy("doc_id", "version").agg(F.first("label").alias("label"), F.count("*").alias("n"))
    first = rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(F.struct("doc_id", "version", "n")).alias("first")).select("first.*", F.lit(True).alias("grouped"))
    kept = cut(first.unionByName(rows.where(F.col("label").isNull()).select("doc_id", "version", "n", F.lit(False).alias("grouped"))))
    once, same = kept.where(~F.col("grouped") | (F.col("n") == 1)), kept.where(F.col("grouped") & (F.col("n") > 1))
    named = lambda some: some.select(F.col("doc_id").alias("_kept"), F.col("version").alias("_version"))
    is_kept = (F.col("doc_id").cast("long") == F.col("_kept")) & (version == F.col("_version"))
    one_of_same = docs.join(named(same), is_kept).dropDuplicates(["_kept", "_version"]).select(docs.columns)
    return docs.join(named(once), is_kept, "left_semi").unionByName(one_of_same).unionByName(docs.where(F.col("doc_id").isNull()))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  WITH RECURSIVE r(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN edges e ON e.a = r.other
  ) SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.doc_id = d.doc_id
"""

"""Line deduplication by aligning documents that share lines.

A document is compared with earlier ones (smaller doc_id) by patience diff:
lines that occur once in either document are anchors, the longest increasing
chain of them is kept, and lines that recur are matched, occurrence by
occurrence, within the gaps of the chain. Aligned lines that follow one another
in both documents, with only blank lines between, form a block. Blocks of at
least ``min_words`` words are deleted from the later document; deletions of all
its partners are united, and the first document keeps its lines.

The result is that of comparing with all earlier documents, but most pairs are
never formed: documents meet through shared hashes of lines, rare ones first. A block holds, around each of its lines, a shortest run of
``min_words`` words (from the line on, or up to it); so only holders of such a
run can delete the line. A run is tried against its first holder, and, as long
as a line of it stays, against 2, 4, 8 ... further earlier ones until none is
left; so a rare run is settled after few documents, and a common one that still
stays meets its other holders later. Runs that their first holder aligns, however many documents share them,
lead to one pair a document; only those that stand in another order there meet
more.

What is shuffled is one narrow row per line, then two per line that several
documents have, then the lines of the pairs. All that is gathered is bounded by
the length of one document. Texts move once, to meet their deletions.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchwork.llm.caches import begin
from parchwork.session import cut, output_columns

#: Words from which an aligned block is deleted.
MIN_WORDS = 10

_LINES = "doc_id long, version long, line binary, pos int, ord int, words int, single boolean"


def document_lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: who holds it, what it is (hash of content and occurrence), and where it stands.

    ``version`` hashes the text, so that rows repeating a doc_id are told apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("lines")
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        names = ["doc_id", "version", "line", "pos", "ord", "words", "single"]
        for batch in batches:
            out: list[list] = [[] for _ in types]
            ids, versions = batch.column("doc_id").to_pylist(), batch.column("version").to_pylist()
            for doc_id, version, text in zip(ids, versions, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                lines = [x.strip() for x in text.split(b"\n")]
                times, seen = Counter(lines), Counter()
                order = 0
                for pos, line in enumerate(lines):
                    if not line:
                        continue
                    occurrence = seen[line]
                    seen[line] += 1
                    row = (doc_id, version, xxhash.xxh3_128_digest(line, seed=occurrence), pos, order, len(line.split()), times[line] == 1)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    order += 1
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
                    out = [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return docs.mapInArrow(run, _LINES)


def chain(pairs: list[tuple[int, int]]) -> list[int]:
    """Indices of a longest chain of pairs (sorted by the first) whose second parts increase; of several, one that ends first."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    end = -1
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        if k == len(tails):
            tails.append(y)
            at.append(i)
            end = i
        else:
            tails[k], at[k] = y, i
        back.append(at[k - 1] if k else -1)
    out, i = [], end
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(shared: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """Aligned lines as (position in the later document, earlier position), from (position, earlier position, anchor)."""
    shared = sorted(shared)
    anchors = [(x, y) for x, y, anchor in shared if anchor]
    anchors = [anchors[i] for i in chain(anchors)]
    rest = [(x, y) for x, y, anchor in shared if not anchor]
    aligned = list(anchors)
    if rest:
        bounds = [(-1, -1), *anchors, (1 << 62, 1 << 62)]
        lo = 0
        for (x0, y0), (x1, y1) in zip(bounds[:-1], bounds[1:], strict=True):
            gap = []
            while lo < len(rest) and rest[lo][0] < x1:
                if rest[lo][0] > x0 and y0 < rest[lo][1] < y1:
                    gap.append(rest[lo])
                lo += 1
            aligned += [gap[i] for i in chain(gap)]
    return sorted(aligned)


def deletions(rows: list[dict], min_words: int) -> list[tuple[int, int, int]]:
    """Lines that a pair of documents deletes from the later one: (ord, position, words)."""
    at = {r["ord"]: (r["pos"], r["words"]) for r in rows}
    blocks: list[list[tuple[int, int]]] = []
    for x, y in patience([(r["ord"], r["partner_ord"], r["anchor"]) for r in rows]):
        if blocks and blocks[-1][-1] == (x - 1, y - 1):
            blocks[-1].append((x, y))
        else:
            blocks.append([(x, y)])
    out = []
    for block in blocks:
        if sum(at[x][1] for x, _ in block) >= min_words:
            out += [(x, *at[x]) for x, _ in block]
    return out


def runs(rows: list[dict], min_words: int) -> dict[tuple[int, int], bytes]:
    """Shortest runs of following lines with ``min_words`` words from and up to each line: (first, last ord) to a hash of the lines."""
    rows = sorted(rows, key=lambda r: r["ord"])
    found: dict[tuple[int, int], bytes] = {}

    def keep(first: int, last: int) -> None:
        span = (rows[first]["ord"], rows[last]["ord"])
        if span not in found:
            found[span] = xxhash.xxh3_128_digest(b"".join(r["line"] for r in rows[first : last + 1]))

    begin = 0
    while begin < len(rows):
        end = begin + 1
        while end < len(rows) and rows[end]["ord"] == rows[end - 1]["ord"] + 1:
            end += 1
        first, words, reached = begin, 0, False
        for last in range(begin, end):
            words += rows[last]["words"]
            if words < min_words:
                continue
            if not reached:
                keep(first, last)
                reached = True
            while words - rows[first]["words"] >= min_words:
                words -= rows[first]["words"]
                first += 1
                keep(first, last)  # from the first line
            keep(first, last)  # up to the last line
        begin = end
    return found


def _common(lines: DataFrame) -> DataFrame:
    """For each document, its lines that other documents have too."""
    several = lines.groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("last") > F.col("first")).select("line")
    row = F.struct("line", "pos", "ord", "words", "single")
    return lines.join(several, "line", "left_semi").groupBy("doc_id", "version").agg(F.collect_set(row).alias("rows"))  # a set: equal rows of the table bring equal lines


def _holders(common: DataFrame, min_words: int) -> DataFrame:
    """Who holds each run: (run, doc_id, version, lo, hi), numbered by doc_id, and how many of smaller doc_id come before."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, version, rows in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "rows")), strict=True):
                for (lo, hi), run in runs(rows, min_words).items():
                    for column, value in zip(out, (run, doc_id, version, lo, hi), strict=True):
                        column.append(value)
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["run", "doc_id", "version", "lo", "hi"])

    of_run = W.partitionBy("run")
    number = F.row_number().over(of_run.orderBy("doc_id", "version"))
    return common.mapInArrow(found, "run binary, doc_id long, version long, lo int, hi int").withColumns({"number": number, "before": F.rank().over(of_run.orderBy("doc_id")) - 1})


def _aligned(pairs: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    """The lines that each of ``pairs`` (doc_id, version, p_id, p_version) deletes from the later document."""
    theirs = lines.select(F.col("doc_id").alias("p_id"), F.col("version").alias("p_version"), "line", F.col("ord").alias("partner_ord"), F.col("single").alias("p_single"))
    row = F.struct("pos", "ord", "words", "partner_ord", (F.col("single") & F.col("p_single")).alias("anchor"))
    both = pairs.join(lines, ["doc_id", "version"]).join(theirs, ["p_id", "p_version", "line"])
    gathered = both.groupBy("doc_id", "version", "p_id", "p_version").agg(F.collect_list(row).alias("rows")).select("doc_id", "version", "rows")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [deletions(rows, min_words) for rows in batch.column("rows").to_pylist()]
            lines = pa.array([[dict(zip(("ord", "pos", "words"), line, strict=True)) for line in f] for f in found], pa.list_(pa.struct([(c, pa.int32()) for c in ("ord", "pos", "words")])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), lines], names=["doc_id", "version", "lines"])

    return gathered.mapInArrow(align, "doc_id long, version long, lines array<struct<ord int, pos int, words int>>").where(F.size("lines") > 0)


def _united(deleted: DataFrame) -> DataFrame:
    """For each document, which leading lines stay, which lines with words are deleted (by ord), and how many lines and words."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for pairs in batch.column("pairs").to_pylist():
                lines = {line["ord"]: line for pair in pairs for line in pair}
                keep = [True] * (max(line["pos"] for line in lines.values()) + 1)
                for x, line in lines.items():  # with the blank lines after another deleted one
                    since = lines[x - 1]["pos"] + 1 if x - 1 in lines else line["pos"]
                    keep[since : line["pos"] + 1] = [False] * (line["pos"] + 1 - since)
                gone = [x in lines for x in range(max(lines) + 1)]
                for column, value in zip(out, (keep, gone, len(lines), sum(line["words"] for line in lines.values())), strict=True):
                    column.append(value)
            types = (pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], names=["d_id", "d_version", "keep", "gone", "lines", "words"])

    gathered = deleted.groupBy("doc_id", "version").agg(F.collect_list("lines").alias("pairs"))
    return gathered.mapInArrow(unite, "d_id long, d_version long, keep array<boolean>, gone array<boolean>, lines long, words long")


def _of(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The ``rows`` whose keys are among those of ``wanted``."""
    return cut(rows.join(wanted.select(keys).distinct(), keys, "left_semi"))


def _gone(readable: DataFrame, min_words: int) -> DataFrame:
    """``_united`` deletions of all pairs of ``readable`` (doc_id, version, text) that can delete a line.

    Lines are laid out once. What a later round of tries reads is narrowed to
    runs that are still open: their further holders, the lines of these, and
    the pairs already tried of documents with such a run.
    """
    min_words = max(min_words, 1)
    of_doc = ["doc_id", "version"]
    common = cut(_common(cut(document_lines(readable))))
    holders = cut(_holders(common, min_words))
    lines = cut(common.select(*of_doc, F.explode("rows").alias("r")).select(*of_doc, "r.*"))
    open_runs = holders.where(F.col("before") > 0).select("run", *of_doc, F.sequence("lo", "hi").alias("left"), "before")
    held = holders.select("run", "number", *of_doc)
    tried = deleted = None
    tries, step = 0, 1
    while True:
        ahead = open_runs.withColumn("number", F.explode(F.sequence(F.lit(tries + 1), F.least("before", F.lit(tries + step)))))
        partners = held.select("run", "number", F.col("doc_id").alias("p_id"), F.col("version").alias("p_version"))
        pairs = ahead.join(partners, ["run", "number"]).select(*of_doc, "p_id", "p_version").distinct()
        pairs = cut(pairs if tried is None else pairs.join(tried, pairs.columns, "left_anti"))
        tried = pairs if tried is None else tried.union(pairs)
        found = cut(_aligned(pairs, lines, min_words))
        deleted = found if deleted is None else deleted.union(found)
        tries, step = tries + step, 2 * step
        later = open_runs.where(F.col("before") > tries)
        now = _united(found.join(later.select(of_doc).distinct(), of_doc, "left_semi")).select(F.col("d_id").alias("doc_id"), F.col("d_version").alias("version"), "gone")
        left = F.filter("left", lambda i: ~F.coalesce(F.get(F.col("gone"), i), F.lit(False)))
        open_runs = cut(later.join(now, of_doc, "left").withColumn("left", left).drop("gone").where(F.size("left") > 0))
        if open_runs.isEmpty():
            return cut(_united(deleted)).drop("gone")
        held = _of(held.where(F.col("number") > tries), open_runs, ["run"])  # with the open documents themselves
        lines, tried = _of(lines, held, of_doc), _of(tried, open_runs, of_doc)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and others) with shared blocks deleted from text, and deleted_lines and deleted_words.

    Null texts stay null and empty ones empty. Rows without a doc_id are left
    alone. Rows that repeat a doc_id are not compared with one another; equal
    rows lose the same lines. Input columns named like an added one give way.
    Texts are aligned whole, however long; an empty table gives no rows. Of two
    documents with the same lines in another order, the later one loses the
    longest chain that both have.
    """
    added = ["deleted_lines", "deleted_words"]
    columns = output_columns(docs, added)
    inner = {c: f"_in_{i}" for i, c in enumerate(columns)}
    named = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in inner.items()])
    text, doc_id = F.col(inner[next(c for c in columns if c.lower() == "text")]), F.col(inner[next(c for c in columns if c.lower() == "doc_id")]).cast("long")
    version = F.xxhash64(text)
    readable = named.where(text.isNotNull() & doc_id.isNotNull()).select(doc_id.alias("doc_id"), version.alias("version"), text.alias("text"))
    gone = _gone(readable, min_words)
    joined = named.join(gone, (doc_id == F.col("d_id")) & (version == F.col("d_version")), "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda line, i: F.coalesce(F.get(F.col("keep"), i), F.lit(True))), "\n")
    cleaned = F.when(F.col("keep").isNull(), text).otherwise(left)
    return joined.select(
        *[(cleaned if c.lower() == "text" else F.col(i)).alias(c) for c, i in inner.items()],
        F.coalesce("lines", F.lit(0)).alias("deleted_lines"),
        F.coalesce("words", F.lit(0)).alias("deleted_words"),
    )

"""Quality rules: counts of a document, and its divergence from its language.

Base rules are plain counts. The method compares two histograms of a document,
of character classes and of common words, with references for each language by
Jensen-Shannon distance (base 2, so 0 to 1). A document is dropped if either
histogram is too far from every language's. Short documents have erratic
histograms, so each comparison has a minimum length.

References are sums over all documents of a language. Counting and comparing
are expressions on arrays inside one row; the shuffled state is one row of sums
for each language.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchwork.llm.spans import let
from parchwork.llm.text import WORD, words
from parchwork.session import cut

#: Words of a window in which repetition is looked for.
WINDOW = 5

# Common words of each language with a reference.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine auch es".split(),
    "en": "the of and to in is that for it was on with as be by at this are from or".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur il au plus".split(),
}
#: All common words; each stands for one bucket and is written as one character.
VOCABULARY = sorted({w for ws in COMMON.values() for w in ws})
MARKS = [chr(0x4E00 + i) for i in range(len(VOCABULARY))]
#: Character classes, each with a pattern of runs of it; what remains is a class of its own.
CLASSES = {"lower": r"\p{Ll}+", "upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "blank": r"[\s\x85]+", "symbol": r"[#*$%&|<>]+", "stop": r"[.,;:!?'\"()-]+"}


@dataclass(frozen=True)
class Limits:
    """Greatest distances, and the least lengths at which they hold."""

    characters: float = 0.30
    least_characters: int = 200
    words: float = 0.32
    least_words: int = 100


def repeated_words(ws: Column) -> Column:
    """Number of words within windows of ``WINDOW`` words that occur twice or more, first occurrences included."""

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        steps = F.zip_with(F.slice(starts, 2, n), F.slice(starts, 1, n - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.when(n == 0, 0).otherwise(F.aggregate(steps, F.lit(WINDOW), lambda acc, x: acc + x))

    def starts(order: Column) -> Column:
        again = lambda x, i: F.equal_null(x["h"], F.get(order, i - 1)["h"]) | F.equal_null(x["h"], F.get(order, i + 1)["h"])
        return F.array_sort(F.transform(F.filter(order, again), lambda x: x["i"]))

    def of(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(let(order, starts), covered))

    windows = F.transform(F.sequence(F.lit(1), F.size(ws) - WINDOW + 1), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))
    return F.when(F.size(ws) > WINDOW, let(windows, of)).otherwise(0).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """Add the counts, and the two histograms ``_chars`` and ``_common``, to doc_id and lang."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    left = text
    sizes = [F.length(left)]
    for pattern in CLASSES.values():
        left = F.regexp_replace(left, pattern, "")
        sizes.append(F.length(left))
    forms = dict(zip(VOCABULARY, MARKS, strict=True)) | {w.capitalize(): m for w, m in zip(VOCABULARY, MARKS, strict=True)}
    listed = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])
    first = docs.select("doc_id", "lang", text.alias("_text"), words(F.col("text")).alias("_words"), lines.alias("_lines"), *[s.alias(f"_left_{i}") for i, s in enumerate(sizes)])
    known = F.filter("_words", lambda w: w.isin(list(forms)))
    marks = F.array_join(F.transform(known, lambda w: F.element_at(listed, w)), "")
    second = first.select(
        "doc_id",
        "lang",
        F.size("_words").cast("long").alias("n_words"),
        (F.length("_text") - F.length(F.regexp_replace("_text", WORD, ""))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.array(*[F.col(f"_left_{i}") - F.col(f"_left_{i + 1}") for i in range(len(CLASSES))], F.col(f"_left_{len(CLASSES)}")).alias("_chars"),
        marks.alias("_marks"),
    )
    each = [F.length("_marks") - F.length(F.replace(F.col("_marks"), F.lit(m), F.lit(""))) for m in MARKS]
    return second.withColumn("_common", F.array(*each, (F.col("n_words") - F.length("_marks")).cast("int"))).drop("_marks")


def references(measured: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Shares of the character classes and common words for each language that has a word list, over all its documents."""
    sums = [F.sum(F.col(name)[i]).alias(f"{name}{i}") for name, n in (("_chars", len(CLASSES) + 1), ("_common", len(VOCABULARY) + 1)) for i in range(n)]
    rows = measured.where(F.col("lang").isin(list(COMMON))).groupBy("lang").agg(*sums).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["lang"]):
        parts = [[r[f"{name}{i}"] for i in range(n)] for name, n in (("_chars", len(CLASSES) + 1), ("_common", len(VOCABULARY) + 1))]
        if all(map(sum, parts)):
            found[r["lang"]] = tuple([x / sum(p) for x in p] for p in parts)
    return found


def distance(counts: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram from reference shares; null for an empty histogram."""

    def given(total: Column) -> Column:
        def term(n: Column, q: Column) -> Column:
            p = n / total
            m = (p + q) / 2
            return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

        terms = F.zip_with(counts, F.array(*[F.lit(x) for x in shares]), term)
        return F.when(total > 0, F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / 2, F.lit(0.0))))

    return let(F.aggregate(counts, F.lit(0), lambda acc, x: acc + x), given)


def judge(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, char_distance, word_distance, kept.

    ``docs`` has doc_id, text and lang; lang tells which documents make up a
    language's reference, and that a document is in a language without one: on
    these only the base rules decide. Each distance is to the nearest language.
    A null text counts as empty: it fails the base rules and has null distances.
    With no reference at all, only the base rules decide. Equal rows are judged
    alike, texts are counted whole however long, an empty table gives no rows,
    and further columns, of whatever name, are left out.
    """
    limits = limits or Limits()
    measured = cut(measure(docs))
    refs = references(measured)
    nearest = lambda ds: F.least(*ds) if len(ds) > 1 else ds[0]
    null = F.lit(None).cast("double")
    characters = nearest([distance(F.col("_chars"), c) for c, _ in refs.values()]) if refs else null
    common = nearest([distance(F.col("_common"), w) for _, w in refs.values()]) if refs else null
    n = F.aggregate("_chars", F.lit(0), lambda acc, x: acc + x)
    judged = measured.withColumns({"_n": n, "char_distance": characters, "word_distance": common})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = ((F.col("_n") >= limits.least_characters) & (F.col("char_distance") > limits.characters)) | ((F.col("n_words") >= limits.least_words) & (F.col("word_distance") > limits.words))
    known = F.col("lang").isNull() | F.col("lang").isin(list(refs))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, failed.alias("base_failed"), (~failed & ~F.coalesce(far & known, F.lit(False))).alias("kept"), "char_distance", "word_distance")

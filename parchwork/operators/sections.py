"""Paragraphs to sections and papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchwork.functions.texts import blank, normalize, normalize_blanks
from parchwork.session import cut


def header_size(spans: DataFrame, margin: float = 0.5, interpolate: bool = False) -> DataFrame:
    """(path, header_size): the third quartile of a document's font sizes, plus a margin."""
    rule = "percentile(font_size, 0.75)" if interpolate else "percentile_disc(0.75) WITHIN GROUP (ORDER BY font_size)"
    return spans.groupBy("path").agg((F.expr(rule) + margin).alias("header_size"))


def bag_of_words(laid: DataFrame) -> DataFrame:
    """(path, word, n): how often each word, in lower case, occurs in a document."""
    return words_of(laid).groupBy("path", F.lower("word").alias("word")).agg(F.count("*").alias("n"))


def words_of(laid: DataFrame) -> DataFrame:
    """One row for each word: its spans' texts joined in order."""
    keys = ["path", "page_no", "line_id", "word_id", *[c for c in ("paragraph_id",) if c in laid.columns]]
    return laid.groupBy(*keys).agg(ordered("span_seq", F.col("text"), "").alias("word"))


def ordered(by: str, value: Column, separator: str) -> Column:
    """An aggregate: values joined in the order of another column."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), value.alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), separator)


def classify(laid: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, page_no, paragraph_id, cls): W where all spans are blank, else H where all are of header size, else B where all are bold, else N."""
    spans = laid.join(sizes, "path")
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    cls = F.when(every(blank(F.col("text"))), "W").when(every(F.col("font_size") > F.col("header_size")), "H").when(every(F.col("font_bold")), "B").otherwise("N")
    return spans.groupBy("path", "page_no", "paragraph_id").agg(cls.alias("cls"))


def group_sections(classed: DataFrame) -> DataFrame:
    """Add section_id and role. A section begins with a header after content; headers are titles, and so are bold and blank paragraphs until content comes."""
    order = W.partitionBy("path").orderBy("page_no", "paragraph_id")
    prior = F.last(F.when(F.col("cls").isin("H", "N"), F.col("cls")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    found = classed.withColumn("_prior", prior)
    found = found.withColumn("_new", F.when((F.col("cls") == "H") & (F.col("_prior") == "N"), 1).otherwise(0))
    title = (F.col("cls") == "H") | (F.col("cls").isin("B", "W") & (F.col("_prior").isNull() | (F.col("_prior") != "N")))
    return found.withColumn("section_id", F.sum("_new").over(order)).withColumn("role", F.when(title, "title").otherwise("body")).drop("_new", "_prior")


_HYPHEN = r"(\w+)-\n(\w+)"


def unwrap_lines(paragraphs: DataFrame, bag: DataFrame) -> DataFrame:
    """Replace ``text``, lines joined by newlines, by running text.

    Where a line ends in a hyphen between words, the hyphen stays if the
    document has the hyphenated form more often than the joined one; on a tie,
    if the right part does not begin with a small letter or if both parts occur
    more than twice together. The four forms of each place are rows that meet
    the document's counts in one join; texts themselves are not moved to it.
    """
    keys = ["path", "page_no", "paragraph_id"]
    places = F.arrays_zip(F.regexp_extract_all("text", F.lit(_HYPHEN), F.lit(1)).alias("l"), F.regexp_extract_all("text", F.lit(_HYPHEN), F.lit(2)).alias("r"))
    rows = paragraphs.select(*keys, F.posexplode(places).alias("at", "p")).select(*keys, "at", F.col("p.l").alias("l"), F.col("p.r").alias("r"))
    forms = {"dashed": F.concat_ws("-", "l", "r"), "joined": F.concat("l", "r"), "left": F.col("l"), "right": F.col("r")}
    listed = F.array(*[F.struct(F.lit(name).alias("form"), F.lower(form).alias("word")) for name, form in forms.items()])
    asked = rows.select(*keys, "at", "l", "r", F.explode(listed).alias("f")).select(*keys, "at", "l", "r", "f.form", "f.word")
    counted = asked.join(bag.select("path", "word", "n"), ["path", "word"], "left")
    rows = counted.groupBy(*keys, "at", "l", "r").agg(*[F.max(F.when(F.col("form") == name, F.col("n"))).alias(name) for name in forms])
    n = {name: F.coalesce(name, F.lit(0)) for name in forms}
    first = F.substring("r", 1, 1)
    stays = F.when(n["dashed"] != n["joined"], n["dashed"] > n["joined"]).otherwise((first == F.upper(first)) | (n["left"] + n["right"] > 2))
    word = F.concat("l", F.when(stays, "-").otherwise(""), "r")
    fixed = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", word.alias("w")))), lambda x: x["w"]).alias("_words"))
    joined = paragraphs.join(fixed, keys, "left")
    between = F.split("text", _HYPHEN, -1)
    rebuilt = F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size("_words")), F.col("_words"), lambda b, w: F.concat(b, w)), ""), F.element_at(between, -1))
    text = F.when(F.col("_words").isNull(), F.col("text")).otherwise(rebuilt)
    return joined.withColumn("text", F.translate(text, "\n", " ")).drop("_words")


def paragraph_texts(laid: DataFrame) -> DataFrame:
    """(path, page_no, paragraph_id, text): spans joined to words, words by spaces to lines, lines by newlines."""
    lines = words_of(laid).groupBy("path", "page_no", "paragraph_id", "line_id").agg(ordered("word_id", F.col("word"), " ").alias("line"))
    return lines.groupBy("path", "page_no", "paragraph_id").agg(ordered("line_id", F.col("line"), "\n").alias("text"))


def papers(laid: DataFrame, compatibility: bool = True, interpolate: bool = False) -> DataFrame:
    """(path, sections): each document's sections, as a title and paragraphs.

    Sections run on across pages. With ``compatibility`` off, texts keep their
    characters and only blanks are normalised. What is laid out is written to
    the shared folder once, as words, counts, sizes and classes are all read
    from it.
    """
    laid = cut(laid.select("path", "page_no", "line_id", "word_id", "paragraph_id", "span_seq", "text", "font_size", "font_bold"))
    texts = unwrap_lines(paragraph_texts(laid), bag_of_words(laid))
    texts = texts.withColumn("text", (normalize if compatibility else normalize_blanks)(F.col("text")))
    placed = group_sections(classify(laid, header_size(laid, interpolate=interpolate))).join(texts, ["path", "page_no", "paragraph_id"])
    row = F.struct("page_no", "paragraph_id", "text")
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, row))), lambda r: r["text"])
    sections = placed.groupBy("path", "section_id").agg(F.array_join(of("title"), " ").alias("title"), of("body").alias("paragraphs"))
    every = F.array_sort(F.collect_list(F.struct("section_id", "title", "paragraphs")))
    return sections.groupBy("path").agg(F.transform(every, lambda s: F.struct(s["title"].alias("title"), s["paragraphs"].alias("paragraphs"))).alias("sections"))


def with_empty(found: DataFrame, paths: DataFrame) -> DataFrame:
    """Papers for all ``paths``: a document without paragraphs has one empty section."""
    empty = F.expr("array(named_struct('title', '', 'paragraphs', cast(array() as array<string>)))")
    return paths.select("path").distinct().join(found, "path", "left").withColumn("sections", F.coalesce("sections", empty))


def paper_text(sections: Column) -> Column:
    """``# title`` and the paragraphs, each on a line; an empty line between sections."""
    return F.array_join(F.transform(sections, lambda s: F.concat(F.lit("# "), s["title"], F.lit("\n"), F.array_join(s["paragraphs"], "\n"))), "\n\n")

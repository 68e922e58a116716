"""Secret scanning with an incremental ledger of blobs.

Every version of a file (here: a document) is addressed by the SHA-256 of its
content. The ledger says which rule, in which version, has seen which blob and
what it found there. A scan computes only (blob, rule version) pairs that the
ledger lacks, one text for each blob however many paths hold it, and joins the
findings back to all paths.

The whole path is DataFrame expressions. Texts are shuffled once, to keep one
row of each unseen blob; the ledger is written, to its own folder (``update``)
or to the shared checkpoint folder (``scan``), before it is joined back, so that
adaptive execution can split a blob that very many paths hold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchwork.llm import spans as S
from parchwork.session import cut

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Rule:
    """A named, versioned rule: a cheap test of a text, and the spans of one that passes it."""

    name: str
    version: int
    test: Callable[[Column], Column]
    spans: Callable[[Column], Column]


def _assign(text: Column) -> Column:
    return S.plain(F.filter(S.matches(text, ASSIGN, (0, 2)), lambda m: F.length(m["g1"]) >= 12))


def _of(pattern: str, least: int) -> Callable[[Column], Column]:
    return lambda text: S.plain(F.filter(S.matches(text, pattern), lambda m: F.length(m["g0"]) >= least))


#: The rules in the order in which their findings are listed. The first three are the base, the others the method's own.
RULES = (
    Rule("assign", 1, lambda t: t.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"'\x20]*[:=]"), _assign),
    Rule("access", 1, lambda t: F.contains(t, F.lit("AKIA")), _of(r"AKIA[A-Z0-9]+", 18)),
    # a maximal run: what a shorter pattern would start within it can't be longer
    Rule("hex", 1, lambda t: t.rlike(r"[0-9a-f]{16}"), _of(r"[0-9a-f]{16,}", 16)),
    Rule("private_key", 1, lambda t: F.contains(t, F.lit("PRIVATE KEY-----")), _of(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1)),
    Rule("web_token", 1, lambda t: F.contains(t, F.lit("eyJ")), _of(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}", 1)),
)
BASE = ("assign", "access", "hex")


LEDGER = "blob string, rule string, version int, found array<struct<start:int,end:int>>"


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger kept in ``folder``; one that has seen nothing, if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001  the store may be one that only Spark reads
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # noqa: SLF001
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(folder)


def update(versions: DataFrame, folder: str, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """Scan what the ledger in ``folder`` lacks of ``versions``, append it there, and return the whole ledger.

    Nothing that is written is written again. A scan that is lost midway leaves
    the ledger as it was, and the next one makes up for it.
    """
    spark = versions.sparkSession
    unseen(versions, load(spark, folder), rules or RULES).write.mode("append").parquet(folder)
    return load(spark, folder)


def addressed(versions: DataFrame) -> DataFrame:
    """(path, blob, content): null content counts as empty."""
    content = F.coalesce(F.col("content"), F.lit(""))
    return versions.select("path", F.sha2(content, 256).alias("blob"), content.alias("content"))


def unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What ``ledger`` lacks: a row for each pair of a blob of ``versions`` (path, content) and a rule version, with its spans.

    ``versions`` may hold any number of versions of a path, and equal rows.
    Null content counts as empty, and so does a null path as a path; an empty
    table gives no rows, and other columns are not looked at.
    """
    paths = addressed(versions)
    wanted = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    first = paths.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("none"), "path")).alias("first"))
    if ledger is None:
        missing = first.withColumn("missing", F.transform(wanted, lambda r: r["rule"]))
    else:
        known = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("known"))
        left = F.filter(wanted, lambda r: ~F.coalesce(F.array_contains("known", r), F.lit(False)))
        missing = first.join(known, "blob", "left").withColumn("missing", F.transform(left, lambda r: r["rule"])).where(F.size("missing") > 0)
    missing = missing.select(F.col("blob").alias("u_blob"), F.col("first.path").alias("u_path"), "missing")
    texts = paths.join(missing.hint("shuffle_hash"), (F.col("blob") == F.col("u_blob")) & F.col("path").eqNullSafe(F.col("u_path")))
    results = []
    for r in rules:
        found = F.when(F.array_contains("missing", r.name) & r.test(F.col("content")), r.spans(F.col("content"))).otherwise(S.none())
        results.append(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), found.alias("found")))
    seen = texts.select("blob", "missing", F.explode(F.array(*results)).alias("r")).where(F.array_contains("missing", F.col("r.rule"))).select("blob", "r.*")
    return seen.groupBy("blob", "rule", "version").agg(F.first("found").alias("found"))  # where rows repeat a path


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger after all blobs of ``versions`` (path, content) have been seen by all rules."""
    seen = cut(unseen(versions, ledger, rules))
    return seen if ledger is None else ledger.select("blob", "rule", "version", "found").unionByName(seen)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, found_<rule>...) for every row of ``versions``: the spans that each rule, in its present version, has in it."""
    of_rule = {(r.name, r.version): f"found_{r.name}" for r in rules}
    columns = [F.first(F.when((F.col("rule") == name) & (F.col("version") == version), F.col("found")), ignorenulls=True).alias(alias) for (name, version), alias in of_rule.items()]
    hits = cut(ledger.where(F.size("found") > 0).groupBy("blob").agg(*columns))
    paths = addressed(versions).select("path", "blob")
    return paths.join(hits, "blob", "left").select("path", "blob", *[F.coalesce(a, S.none()).alias(a) for a in of_rule.values()])


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (
  SELECT doc_id, t, 1 AS o, 'assign' AS kind, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS p, 2 AS g, 12 AS least FROM d
  UNION ALL SELECT doc_id, t, 2, 'access', 'AKIA[A-Z0-9]+', 0, 18 FROM d
  UNION ALL SELECT doc_id, t, 3, 'hex', '[0-9a-f]+', 0, 16 FROM d
), f AS (
  SELECT doc_id, o, kind, least, CASE o WHEN 1 THEN regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)
         WHEN 2 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(t, '[0-9a-f]+') END AS inner_,
         CASE o WHEN 1 THEN regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
         WHEN 2 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(t, '[0-9a-f]+') END AS m,
         CASE o WHEN 1 THEN regexp_split_to_array(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
         WHEN 2 THEN regexp_split_to_array(t, 'AKIA[A-Z0-9]+') ELSE regexp_split_to_array(t, '[0-9a-f]+') END AS b
  FROM k
), u AS (
  SELECT doc_id, o, kind, least, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(inner_) AS g, unnest(b[1:len(m)]) AS b FROM f
), w AS (
  SELECT *, sum(length(b) + length(m)) OVER (PARTITION BY doc_id, o ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM u
), s AS (
  SELECT doc_id, o, kind, stop - length(m) AS start, kind || ':' || (stop - length(m))::VARCHAR || ':' || stop::VARCHAR AS t FROM w WHERE length(g) >= least
), a AS (
  SELECT doc_id, sum(CASE WHEN o = 1 THEN 1 ELSE 0 END)::BIGINT AS n_assign, sum(CASE WHEN o = 2 THEN 1 ELSE 0 END)::BIGINT AS n_access,
         sum(CASE WHEN o = 3 THEN 1 ELSE 0 END)::BIGINT AS n_hex, string_agg(t, ',' ORDER BY start, o) AS spans FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

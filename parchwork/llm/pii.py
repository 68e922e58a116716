"""Personal data: spans found by rules, and more by weak supervision.

Base spans (email, ip, card, phone) come from their patterns and stay as they
are. Looser patterns propose further candidates in what is left of the text:
long numbers without a valid check digit, keys and passwords, phones without a
country code, social security numbers, bank account numbers, spelled-out
addresses. On each candidate, labelers vote for (+), against (-) or not at all
(0): patterns of strict form, gazetteers of prefixes, key words and domains,
words of the context, and personal data of other kinds beside it. Expectation-maximisation estimates for each kind how reliable each
labeler is and how likely each pattern of votes is right; what it needs is the
number of candidates for each kind and vote pattern, at most kinds * 3^labelers
rows whatever the input. The resulting probabilities train the final span
classifier, naive Bayes over votes and shape features, and the classifier
alone decides which candidates are added.

The path over the documents is DataFrame expressions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchwork.llm import spans as S
from parchwork.session import cut

# A run of one class can't match from within if it doesn't match from its start: trying only there, or where the
# last match ended, keeps long runs linear. Possessive runs never give back what they took, and a possessive group is
# repeated in a loop, while a greedy one recurses once for each repetition.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

BASE = ("email", "ip", "card", "phone")
#: Further candidates: kind, a test of the text, pattern.
PROPOSED = {
    "long_number": (r"[0-9](?:[\x20-]?[0-9]){12}", r"(?<![0-9A-Za-z_.,$-])[0-9]{4}(?:[\x20-]?[0-9]){9,15}(?![0-9A-Za-z_]|[.,-][0-9])"),
    "key": (r"(?i:password|passwd|passphrase|secret|token|api[_-]?key|credential)", r"""(?i:password|passwd|passphrase|secret|token|api[_-]?key|credentials?)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9+/_.=-]{8,}+"""),
    "local_phone": (r"[0-9]{2}[)\x20./-]", r"(?<![0-9+().-])(?<!\+[0-9]{1,3}[\x20.-])(?:\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}|0[1-9](?:[\x20.][0-9]{2}){4}|0[1-9][0-9]{1,4}[\x20/-]{1,3}[0-9]{5,8}|[679][0-9]{2}(?:\x20[0-9]{3}){2})(?![0-9-])"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "spelled_email": (r"(?i:[\[(\x20]at[\])\x20])", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(\x20]at[\])\x20]\x20?[A-Za-z0-9-]{1,63}\x20?[\[(\x20]dot[\])\x20]\x20?[A-Za-z]{2,10}(?![A-Za-z0-9])"),
}
#: Code points of context on either side of a candidate, as far as its neighbours of the same kind.
CONTEXT = 40
LABELERS = ("form", "gazetteer", "context", "company", "against", "filler")

# Gazetteers and context words.
CONTEXT_WORDS = {
    "long_number": r"(?i)\b(card|credit|debit|visa|mastercard|amex|account|payment|karte|konto|carte|compte|tarjeta|cuenta)\b",
    "key": r"(?i)\b(login|user|username|auth|authorization|bearer|access|private|config|env|export)\b",
    "local_phone": r"(?i)\b(phone|tel|telephone|call|mobile|cell|fax|contact|dial|whatsapp|telefon|llame|appelez)\b",
    "ssn": r"(?i)\b(ssn|social security|social insurance|taxpayer|tax id)\b",
    "iban": r"(?i)\b(iban|bank|account|transfer|bic|swift|konto|compte|cuenta)\b",
    "spelled_email": r"(?i)\b(e-?mail|mail|contact|write|reach)\b",
}
FORMS = {
    "long_number": r"^([0-9]{13}|[0-9]{15}|[0-9]{16}|[0-9]{4}([\x20-])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\3[0-9]{5})$",
    "key": r"(?=[^:=]*[:=].*[0-9])(?=[^:=]*[:=].*[A-Za-z]).{28,}",
    "local_phone": r"^((\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}|0[1-9](?:[\x20.][0-9]{2}){4}|0[1-9][0-9]{1,4}[/-][0-9]{5,8}|[679][0-9]{2}(?:\x20[0-9]{3}){2})$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){3,7}(\x20?[A-Z0-9]{1,3})?$",
    "spelled_email": r"(?i)^[a-z0-9._%+-]+\x20?[\[(]at[\])]\x20?[a-z0-9-]+\x20?[\[(]dot[\])]\x20?[a-z]+$",
}
GAZETTEERS = {
    "long_number": r"^(3[47]|4|5[1-5]|6011|65|2[2-7])",
    "key": r"(?i)^(password|passwd|secret|token|api[_-]?key)",
    "local_phone": r"^\(?(201|202|206|212|213|214|215|267|281|301|302|303|305|310|312|313|323|347|404|408|415|503|512|602|617|646|650|702|713|718|773|800|808|818|832|855|866|877|888|917|949|972)",
    "ssn": r"^(00[1-9]|0[1-9][0-9]|[1-5][0-9]{2}|6[0-57-9][0-9]|66[0-57-9]|7[0-6][0-9]|77[0-2])",
    "iban": r"^(AT|BE|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK)",
    "spelled_email": r"(?i)(dot[\])\x20]\x20?(com|org|net|edu|gov|io|de|fr|es|uk))$",
}
AGAINST_WORDS = r"(?i)\b(version|isbn|issn|doi|build|release|figure|table|page|section|order no|part no|serial|example|sample|placeholder|dummy)\b"
FILLER = r"([0-9])\1{4}|0123|1234567|(?i:xxxx|changeme|your[_-])"
#: Personal data of another kind in the context: masked base spans, or an assigned secret.
COMPANY = rf"{S.MASK}|(?i:token|password|secret)\x20?[:=]"


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    return F.call_function("luhn_check", digits)


class Has(NamedTuple):
    """Cheap facts of a text, found once: without them, most patterns need not be tried."""

    digits: Column
    at: Column
    assign: Column
    dot: Column


def facts(text: Column) -> Has:
    return Has(text.rlike(r"[0-9][\x20().0-9/-]"), F.contains(text, F.lit("@")), F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), F.contains(F.lower(text), F.lit("dot")))


#: What a text must have for candidates of a kind.
NEEDS = {"long_number": "digits", "key": "assign", "local_phone": "digits", "ssn": "digits", "iban": "digits", "spelled_email": "dot"}


def _base(text: Column, has: Has) -> dict[str, tuple[Column, str, Callable[[Column], Column]]]:
    """For each base kind: a test of the text, the pattern, and which matches count."""
    digits = lambda m: F.regexp_replace(m["g0"], r"[^0-9]", "")
    small = lambda m: F.forall(F.split(m["g0"], r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")).between(1, 3) & (F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255))
    card = lambda m: S.let(digits(m), lambda d: F.length(d).between(16, 19) & luhn(d))
    phone = lambda m: F.length(digits(m)).between(8, 15)
    return {
        "email": (has.at, EMAIL, lambda m: F.lit(True)),
        "ip": (has.digits & text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), IP, small),
        "card": (has.digits & text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), CARD, card),
        "phone": (has.digits & text.rlike(r"\+[0-9]"), PHONE, phone),
    }


def base_spans(text: Column, has: Has) -> dict[str, Column]:
    """Spans of the four base kinds in a text that is not null."""
    return {kind: F.when(test, S.plain(F.filter(S.matches(text, pattern), keep))).otherwise(S.none()) for kind, (test, pattern, keep) in _base(text, has).items()}


def without_base(text: Column, has: Has) -> Column:
    """The text with its base spans masked, so that what is found in it lies apart from them."""
    found = text
    for test, pattern, keep in _base(text, has).values():
        mine = S.masked(text, pattern, keep)
        found = F.when(test & (mine != text), F.when(found == text, mine).otherwise(S.overlaid(found, mine))).otherwise(found)
    return F.when(has.digits | has.at, found).otherwise(text)


def candidates(text: Column, has: Has) -> Column:
    """Proposed spans of all kinds in a masked text, with their votes and shape."""

    def row_of(kind: str) -> Callable[[Column], Column]:
        def row(m: Column) -> Column:
            value, before = m["g0"], m["before"]
            around = F.concat(before, F.lit(" "), m["after"])
            vote = lambda yes, no: F.when(yes, "+").when(no, "-").otherwise("0")
            votes = F.concat(
                vote(value.rlike(FORMS[kind]), ~value.rlike(FORMS[kind])),
                vote(value.rlike(GAZETTEERS[kind]), F.lit(False)),
                vote(around.rlike(CONTEXT_WORDS[kind]), F.lit(False)),
                vote(around.rlike(COMPANY), F.lit(False)),
                vote(F.lit(False), around.rlike(AGAINST_WORDS)),
                vote(F.lit(False), value.rlike(FILLER)),
            )
            shape = F.concat(F.when(F.length(value) > 16, "L").otherwise("S"), F.when(before.rlike(r"[:=]\x20?$"), "C").when(before.rlike(r"\n$|^$"), "B").otherwise("W"))
            return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), votes.alias("votes"), shape.alias("shape"))

        return row

    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,votes:string,shape:string>>)")
    return F.concat(*[F.when(getattr(has, NEEDS[kind]) & text.rlike(test), F.transform(S.matches(text, pattern, context=CONTEXT), row_of(kind))).otherwise(empty) for kind, (test, pattern) in PROPOSED.items()])


def _read(documents: DataFrame, *columns: str) -> tuple[DataFrame, Has]:
    """``columns``, the text, and its facts as columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [f"_has_{n}" for n in Has._fields]
    rows = documents.select(*columns, text.alias("_text")).select(*columns, "_text", *[c.alias(n) for c, n in zip(facts(F.col("_text")), names, strict=True)])
    return rows, Has(*map(F.col, names))


@dataclass(frozen=True)
class SpanModel:
    """Log-odds of the final classifier: a prior for each kind, and a weight for each kind, feature and value."""

    prior: dict[str, float]
    weights: dict[tuple[str, int, str], float]


def estimate(counts: Iterable[tuple[str, str, int]], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Probability that a candidate is right, for each (kind, votes), by EM over their counts.

    A labeler that votes is right with an unknown probability, by kind. It
    starts at 0.8 and is smoothed by two imagined votes of that rate, so that
    few votes move it little.
    """
    found: dict[tuple[str, str], float] = {}
    by_kind: dict[str, dict[str, int]] = {}
    for kind, votes, n in counts:
        by_kind.setdefault(kind, {})[votes] = n
    for kind, patterns in by_kind.items():
        right, prior = [0.8] * len(LABELERS), 0.5
        belief: dict[str, float] = {}
        for _ in range(rounds):
            for votes in patterns:
                odds = math.log(prior / (1 - prior))
                for j, v in enumerate(votes):
                    odds += {"+": 1, "-": -1, "0": 0}[v] * math.log(right[j] / (1 - right[j]))
                belief[votes] = 1 / (1 + math.exp(-odds))
            total = sum(patterns.values())
            prior = min(0.95, max(0.05, (sum(n * belief[v] for v, n in patterns.items()) + 1) / (total + 2)))
            for j in range(len(LABELERS)):
                cast = sum(n for v, n in patterns.items() if v[j] != "0")
                agreed = sum(n * (belief[v] if v[j] == "+" else 1 - belief[v]) for v, n in patterns.items() if v[j] != "0")
                right[j] = min(0.99, max(0.51, (agreed + 1.6) / (cast + 2)))
        found |= {(kind, v): p for v, p in belief.items()}
    return found


def train(documents: DataFrame) -> SpanModel:
    """The final classifier from the candidates in ``documents`` (text), weighted by what EM believes of them."""
    rows, has = _read(documents)
    some = has.digits | has.assign | has.dot
    left = rows.where(some).select(without_base(F.col("_text"), has).alias("_left"), *[f"_has_{n}" for n in Has._fields])
    each = left.select(F.explode(candidates(F.col("_left"), has)).alias("c")).select("c.kind", "c.votes", "c.shape")
    rows = [(r["kind"], r["votes"], r["shape"], r["n"]) for r in cut(each.groupBy("kind", "votes", "shape").agg(F.count("*").alias("n"))).collect()]
    counts: dict[tuple[str, str], int] = {}
    for kind, votes, _, n in rows:
        counts[kind, votes] = counts.get((kind, votes), 0) + n
    belief = estimate((k, v, n) for (k, v), n in sorted(counts.items()))
    yes: dict[tuple[str, int, str], float] = {}
    no: dict[tuple[str, int, str], float] = {}
    totals: dict[str, list[float]] = {}
    for kind, votes, shape, n in sorted(rows):
        p = belief[kind, votes]
        total = totals.setdefault(kind, [0.0, 0.0])
        total[0] += n * p
        total[1] += n * (1 - p)
        for feature, value in enumerate([*votes, *shape]):
            yes[kind, feature, value] = yes.get((kind, feature, value), 0.0) + n * p
            no[kind, feature, value] = no.get((kind, feature, value), 0.0) + n * (1 - p)
    prior = {kind: math.log((a + 1) / (b + 1)) for kind, (a, b) in totals.items()}
    weights = {key: math.log((yes[key] + 1) / (totals[key[0]][0] + 3)) - math.log((no[key] + 1) / (totals[key[0]][1] + 3)) for key in yes}
    return SpanModel(prior, weights)


def accepted(found: Column, model: SpanModel) -> Column:
    """The candidates that the classifier takes for personal data."""

    def right(c: Column) -> Column:
        total = F.lit(None).cast("double")
        for kind, prior in model.prior.items():
            odds = F.lit(prior)
            for (k, feature, value), weight in sorted(model.weights.items()):
                if k == kind:
                    where = F.substring(c["votes"], feature + 1, 1) if feature < len(LABELERS) else F.substring(c["shape"], feature + 1 - len(LABELERS), 1)
                    odds = odds + F.when(where == value, F.lit(weight)).otherwise(F.lit(0.0))
            total = F.when(c["kind"] == kind, odds).otherwise(total)
        return F.coalesce(total > 0, F.lit(False))

    return F.filter(found, right)


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda c: c["kind"] == kind


def find(documents: DataFrame, model: SpanModel) -> DataFrame:
    """``documents`` (doc_id, text) to (doc_id, found_<kind>...): base kinds, then proposed ones that were accepted.

    No proposed span overlaps a base span or another of its kind; of different
    proposed kinds that overlap, each keeps its own. Null and empty texts have
    no spans, an empty table gives no rows, equal rows give equal rows, and
    other columns are left out. A text of millions of digits, dots or matches
    takes time in proportion to its length.
    """
    rows, has = _read(documents, "doc_id")
    base = base_spans(F.col("_text"), has)
    rows = rows.select("doc_id", *[f"_has_{n}" for n in Has._fields], *[c.alias(f"found_{k}") for k, c in base.items()], without_base(F.col("_text"), has).alias("_left"))
    rows = rows.select("doc_id", *[f"found_{k}" for k in base], accepted(candidates(F.col("_left"), has), model).alias("more"))
    return rows.select("doc_id", *[f"found_{k}" for k in base], *[S.plain(F.filter("more", _is(kind))).alias(f"found_{kind}") for kind in PROPOSED])


#: The base columns in SQL; what the method adds is not in them.
BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT doc_id, 1 AS o, 'email' AS kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS m, regexp_split_to_array(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS b FROM d
  UNION ALL SELECT doc_id, 2, 'ip', regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), regexp_split_to_array(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM d
  UNION ALL SELECT doc_id, 3, 'card', regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), regexp_split_to_array(t, '[0-9]([\x20-]?[0-9])+') FROM d
  UNION ALL SELECT doc_id, 4, 'phone', regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), regexp_split_to_array(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM d
), u AS (
  SELECT doc_id, o, kind, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(b[1:len(m)]) AS b FROM f
), w AS (
  SELECT *, sum(length(b) + length(m)) OVER (PARTITION BY doc_id, o ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS stop, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM u
), v AS (
  SELECT *, CASE o WHEN 1 THEN true
    WHEN 2 THEN len(list_filter(string_split(m, '.'), lambda p: length(regexp_replace(p, '^0+', '')) > 3 OR coalesce(try_cast(regexp_replace(p, '^0+', '') AS INTEGER), 0) > 255)) = 0
    WHEN 3 THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
           CASE WHEN i % 2 = 1 THEN substr(digits, (length(digits) - i + 1)::INTEGER, 1)::INTEGER
                WHEN substr(digits, (length(digits) - i + 1)::INTEGER, 1)::INTEGER * 2 > 9 THEN substr(digits, (length(digits) - i + 1)::INTEGER, 1)::INTEGER * 2 - 9
                ELSE substr(digits, (length(digits) - i + 1)::INTEGER, 1)::INTEGER * 2 END)) % 10 = 0
    ELSE length(digits) BETWEEN 8 AND 15 END AS good FROM w
), s AS (
  SELECT doc_id, o, stop - length(m) AS start, kind || ':' || (stop - length(m))::VARCHAR || ':' || stop::VARCHAR AS t FROM v WHERE good
), a AS (
  SELECT doc_id, sum(CASE WHEN o = 1 THEN 1 ELSE 0 END)::BIGINT AS n_email, sum(CASE WHEN o = 2 THEN 1 ELSE 0 END)::BIGINT AS n_ip,
         sum(CASE WHEN o = 3 THEN 1 ELSE 0 END)::BIGINT AS n_card, sum(CASE WHEN o = 4 THEN 1 ELSE 0 END)::BIGINT AS n_phone,
         string_agg(t, ',' ORDER BY o, start) AS spans FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

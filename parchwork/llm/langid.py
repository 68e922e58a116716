"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds
(multiplies) its letters' vectors, each permuted (rolled) by its place, so
order matters. A text's vector bundles (adds) its trigrams' vectors, a
language's prototype bundles those of its training texts, and a text is given
the language whose prototype has the largest cosine with it.

Letters are compared in lower case; every run of other characters is one
separator, which has a vector too. Training adds up trigram counts where the
text lies, so what moves is one vector per language and task, summed per
dimension; prototypes are ``dimensions`` numbers for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchwork.llm.caches import begin, keep

#: Characters handled at a time; longer texts go through in steps that carry two letters over.
STEP = 1_000_000
#: Largest alphabet for which trigrams are numbered by their letters' places in it.
SMALL_ALPHABET = 128

_letters: dict[tuple[int, int, int], np.ndarray] = {}
keep("langid", _letters.clear)
_is_letter = np.full(0x110000, -1, dtype=np.int8)


def letter_vector(code: int, dimensions: int, seed: int) -> np.ndarray:
    """The +1/-1 vector of a letter (0: the separator), the same on every machine."""
    key = (code, dimensions, seed)
    if key not in _letters:
        if len(_letters) > 20_000:
            _letters.clear()
        _letters[key] = np.random.default_rng([seed, code]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1
    return _letters[key]


def letter_codes(text: str) -> np.ndarray:
    """Code points in lower case, with each run of other characters as one 0."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _is_letter[codes]
    if (kind < 0).any():
        for c in np.unique(codes[kind < 0]):
            _is_letter[c] = chr(c).isalpha()
        kind = _is_letter[codes]
    codes = np.where(kind == 1, codes, 0)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def _segments(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, codes) pieces; each text starts and ends with a separator."""
    zero = np.zeros(1, dtype=np.uint32)
    for row, text in enumerate(texts):
        if not text:
            continue
        carried = zero
        for at in range(0, len(text), STEP):
            codes = letter_codes(text[at : at + STEP])
            if len(codes) and codes[0] == 0 and carried[-1] == 0:
                codes = codes[1:]
            codes = np.concatenate([carried, codes])
            if at + STEP >= len(text) and codes[-1] != 0:
                codes = np.concatenate([codes, zero])
            yield row, codes
            carried = codes[-2:]


def bundle(texts: list[str | None], groups: np.ndarray, n_groups: int, dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the groups (rows of a float32 matrix) and whether each has a letter."""
    out, lettered = np.zeros((n_groups, dimensions), dtype=np.float32), np.zeros(n_groups, dtype=bool)
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        if held:
            _add(held, groups, out, lettered, dimensions, seed)
            held.clear()

    for row, codes in _segments(texts):
        held.append((row, codes))
        size += len(codes)
        if size >= STEP // 2 or len(held) >= 128:
            flush()
            size = 0
    flush()
    return out, lettered


def _add(held: list, groups: np.ndarray, out: np.ndarray, lettered: np.ndarray, dimensions: int, seed: int) -> None:
    codes = np.concatenate([c for _, c in held])
    lengths = np.array([len(c) for _, c in held])
    rows = np.repeat(np.array([groups[r] for r, _ in held]), lengths)
    first = np.cumsum(lengths) - lengths
    inside = np.ones(len(codes), dtype=bool)  # a trigram may start here
    for back in (1, 2):
        inside[np.maximum(first + lengths - back, first)] = False
    seen = np.zeros(int(codes.max()) + 1, dtype=bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(len(seen), dtype=np.int64)
    place[alphabet] = np.arange(len(alphabet))
    k = len(alphabet)
    c = place[codes]
    start = np.flatnonzero(inside)
    if not len(start):
        return
    keys = (c[start] * k + c[start + 1]) * k + c[start + 2]
    if k <= SMALL_ALPHABET:
        there = np.zeros(k**3, dtype=bool)
        there[keys] = True
        distinct = np.flatnonzero(there)
        number = np.zeros(k**3, dtype=np.int64)
        number[distinct] = np.arange(len(distinct))
        numbers = number[keys]
    else:
        distinct, numbers = np.unique(keys, return_inverse=True)
    at, which = np.unique(rows[start], return_inverse=True)
    letters = np.stack([letter_vector(int(a), dimensions, seed) for a in alphabet])
    once, twice = np.roll(letters, 1, axis=1), np.roll(letters, 2, axis=1)
    for lo in range(0, len(distinct), 8192):  # bounds the trigram matrix
        d = distinct[lo : lo + 8192]
        vectors = (twice[d // (k * k)] * once[d // k % k] * letters[d % k]).astype(np.float32)
        mine = (numbers >= lo) & (numbers < lo + len(d)) if len(distinct) > 8192 else slice(None)
        counts = np.bincount(which[mine] * len(d) + numbers[mine] - lo, minlength=len(at) * len(d)).reshape(len(at), len(d))
        out[at] += counts.astype(np.float32) @ vectors
    lettered[np.unique(rows[codes != 0])] = True


@dataclass(frozen=True)
class Profiles:
    """Language prototypes of unit length."""

    languages: list[str]
    matrix: np.ndarray
    dimensions: int
    seed: int


def train(docs: DataFrame, dimensions: int = 1024, seed: int = 7) -> Profiles:
    """Prototypes from the text and lang of ``docs``; rows with null lang or text teach nothing."""
    schema = "language string, dimension int, value double"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid")
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            groups = np.array([names.index(x) for x in langs])
            vectors, _ = bundle(batch.column("text").to_pylist(), groups, len(names), dimensions, seed)
            for name, vector in zip(names, vectors, strict=True):
                sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        for name, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions, pa.string()), pa.array(np.arange(dimensions), pa.int32()), pa.array(vector)], names=["language", "dimension", "value"])

    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    rows = taught.mapInArrow(partial, schema).groupBy("language", "dimension").agg(F.sum("value").alias("value")).collect()
    languages = sorted({r["language"] for r in rows})
    matrix = np.zeros((len(languages), dimensions))
    for r in rows:
        matrix[languages.index(r["language"]), r["dimension"]] = r["value"]
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    known = norms[:, 0] > 0  # a language whose texts have no letter has no profile
    return Profiles([x for x, k in zip(languages, known, strict=True) if k], (matrix[known] / norms[known]).astype(np.float32), dimensions, seed)


def predict(text: Column, profiles: Profiles) -> Column:
    """A struct of lang_pred and score (the cosine, not below 0).

    ``und`` with score 0 if the text is null or has no letter, or if nothing
    was learned. Ties go to the language first by code point. Equal texts get
    equal answers, and a text is read whole, in steps, however long.
    """
    languages, matrix = np.array([*profiles.languages, "und"], dtype=object), profiles.matrix
    dimensions, seed = profiles.dimensions, profiles.seed

    @F.arrow_udf("lang_pred string, score double")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin("langid")
        for texts in batches:
            n = len(texts)
            vectors, lettered = bundle(texts.to_pylist(), np.arange(n), n, dimensions, seed)
            norms = np.linalg.norm(vectors, axis=1)
            best, score = np.full(n, len(languages) - 1), np.zeros(n)
            if len(matrix):
                cosines = vectors @ matrix.T / np.where(norms > 0, norms, 1)[:, None]
                ok = lettered & (norms > 0)
                best = np.where(lettered, np.where(ok, cosines.argmax(axis=1), 0), best)
                score = np.where(ok, np.clip(cosines.max(axis=1), 0, 1), 0.0)
            yield pa.StructArray.from_arrays([pa.array(languages[best].tolist(), pa.string()), pa.array(score.astype(np.float64))], names=["lang_pred", "score"])

    return udf(text)


#: Letters from which a text must reach ``LEAST_SCORE``; a shorter one has too few trigrams to score high.
LONG_LETTERS = 80
#: Least cosine of a long text. Letter junk comes to 0.18 however long it is, learned documents start at 0.22.
LEAST_SCORE = 0.2
#: Least cosine of a short text, in standard deviations (1 / sqrt(dimensions)) of an unrelated text's cosine.
SHORT_DEVIATIONS = 4.0


def accept(docs: DataFrame, profiles: Profiles, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents in a learned language: those whose cosine stands clear of what unrelated texts get.

    That is ``least_score`` for texts of ``LONG_LETTERS`` letters, and
    ``SHORT_DEVIATIONS`` (but at most ``least_score``) for shorter ones.
    """
    found = predict(F.col("text"), profiles)
    long = F.col("text").rlike(rf"^(?:\P{{L}}*+\p{{L}}){{{LONG_LETTERS}}}")  # ends at that letter
    short_score = min(least_score, SHORT_DEVIATIONS / profiles.dimensions**0.5)
    return docs.where((found["lang_pred"] != "und") & (found["score"] >= F.when(long, least_score).otherwise(short_score)))

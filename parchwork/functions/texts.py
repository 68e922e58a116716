"""Text functions: normalisation, codes and byte strings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parchwork.kernels.blanks import BLANK, compose
from parchwork.kernels.encodings import decode_text, glyph_text
from parchwork.kernels.filters import apply_filters


def blank(text: Column) -> Column:
    """Whether a text holds white space only."""
    return ~text.rlike(f"[^{BLANK}]")


def normalize_blanks(text: Column) -> Column:
    """Runs of white space become one space, control characters vanish."""
    return F.regexp_replace(F.regexp_replace(text, f"[{BLANK}]+", " "), r"[\x00-\x1F]+", "")


@F.arrow_udf(StringType())
def _compose(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([None if t is None else t if t.isascii() and "^" not in t and "`" not in t else compose(t) for t in texts.to_pylist()], pa.string())


def normalize(text: Column) -> Column:
    """Blanks, control characters, modifiers, then compatibility composition."""
    return _compose(normalize_blanks(text))


@F.arrow_udf(StringType())
def decode_string(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Text of a byte string: UTF-16 after a byte order mark, else the document encoding."""
    for rows in batches:
        yield pa.array([None if b is None else decode_text(b) for b in rows.to_pylist()], pa.string())


def filtered(data: Column, filters: list[str], parms: list[dict] | None = None) -> Column:
    """Binary data with stream filters undone."""

    @F.arrow_udf("binary")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array([None if b is None else apply_filters(b, filters, parms) for b in rows.to_pylist()], pa.binary())

    return udf(data)


@F.arrow_udf(StringType())
def glyph_name_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Text of a glyph name."""
    for rows in batches:
        yield pa.array([glyph_text(n) for n in rows.to_pylist()], pa.string())


def hex_bytes(digits: Column) -> Column:
    """Bytes of hexadecimal digits; blanks are skipped and an odd last digit is a high half."""
    clean = F.regexp_replace(digits, r"[\x00\t\n\f\r ]+", "")
    return F.unhex(F.rpad(clean, F.length(clean) + F.length(clean) % 2, F.lit("0")))


def char_codes(data: Column, width: int = 1) -> Column:
    """Big-endian codes of ``width`` bytes."""
    n = F.ceil(F.length(data) / width).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(at, lambda i: F.conv(F.hex(F.substring(data, i * width + 1, F.lit(width))), 16, 10).cast("long"))


def hex_codes(digits: Column, width: int) -> Column:
    """Codes of ``width`` hexadecimal digits."""
    n = F.ceil(F.length(digits) / width).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(at, lambda i: F.conv(F.substring(digits, i * width + 1, F.lit(width)), 16, 10).cast("long"))


def utf16_text(data: Column) -> Column:
    return F.decode(data, "UTF-16BE")


def swap_bytes(data: Column) -> Column:
    """Byte pairs swapped; an odd last byte stays."""
    n = F.ceil(F.length(data) / 2).cast("int")
    swapped = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.hex(F.substring(data, i * 2 + 2, F.lit(1))), F.hex(F.substring(data, i * 2 + 1, F.lit(1)))))
    last = F.when(F.length(data) % 2 == 1, F.hex(F.substring(data, F.length(data), F.lit(1)))).otherwise("")
    whole = F.slice(swapped, 1, F.floor(F.length(data) / 2).cast("int"))
    return F.when(F.length(data) == 0, data).otherwise(F.unhex(F.concat(F.array_join(whole, ""), last)))


def as_reference(text: Column) -> Column:
    """A struct of object_number and generation_number from ``number`` or ``number:generation``."""
    return F.struct(F.split_part(text, F.lit(":"), F.lit(1)).cast("int").alias("object_number"), F.coalesce(F.try_element_at(F.split(text, ":"), F.lit(2)), F.lit("0")).cast("int").alias("generation_number"))


def reference_text(number: Column, generation: Column) -> Column:
    return F.concat_ws(":", number.cast("string"), generation.cast("string"))

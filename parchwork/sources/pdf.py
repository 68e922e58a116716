"""PDF files as tables.

Files come from ``binaryFile`` as rows of path and content. Each table is one
kernel over these rows, so a query for metadata or cross-references never runs
the text machine, and a file is parsed where it lies: no table here shuffles.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchwork.kernels.document import Document, type_of
from parchwork.kernels.encodings import decode_text
from parchwork.kernels.fonts import Font
from parchwork.kernels.objects import PdfError, Ref, Stream, parse_content, tagged
from parchwork.kernels.vm import form_spans, page_spans
from parchwork.operators.documents import OUT_BYTES, OUT_ROWS
from parchwork.operators.layout import layout
from parchwork.operators.sections import paper_text, papers, with_empty
from parchwork.session import attach

SCHEMAS = {
    "xref": "path string, section_ord int, seq int, object_number int, generation_number int, in_use boolean, offset long, object_stream_object_number int, object_stream_index int",
    "trailers": "path string, section_ord int, key string, value string",
    "metadata": "path string, size long, root string, info string",
    "objects": "path string, object_number int, generation_number int, type string, subtype string, value string, stream binary",
    "pages": "path string, page_no int, object_number int, media_box array<double>, resources string, content binary",
    "page_ops": "path string, page_no int, op_seq int, operator string, alias string, operands string",
    "fonts": "path string, page_no int, font_id string, subtype string, base_font string, bold boolean, italic boolean, char_bytes int",
    "font_encoding": "path string, page_no int, font_id string, code int, text string, width double",
    "simplified": "path string, object_number int, generation_number int, value string",
    "views": "path string, object_number int, generation_number int, model string, value string",
    "form_spans": "path string, object_number int, span_seq int, min_x double, min_y double, max_x double, max_y double, font_name string, font_size double, font_bold boolean, font_italic boolean, buffer binary, text string",
    "text_spans": "path string, page_no int, span_seq int, min_x double, min_y double, max_x double, max_y double, font_name string, font_size double, font_bold boolean, font_italic boolean, buffer binary, text string",
}


#: What a malformed file may raise.
MALFORMED = (PdfError, KeyError, TypeError, ValueError, IndexError)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the PDF files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def simplify(document: Document, value: Any) -> Any:
    """A value for JSON: streams and references as what they hold, strings as text. A container met before becomes a note instead."""
    seen: set[int] = set()

    def walk(v: Any) -> Any:
        if isinstance(v, Ref):
            v = document.resolve(v)
        if isinstance(v, bytes):
            return decode_text(v)
        if isinstance(v, Stream):
            return {"dictionary": walk(v.dictionary), "buffer": decode_text(v.data)}
        if isinstance(v, (list, dict)):
            if id(v) in seen:
                return f"[Circular {'Array' if isinstance(v, list) else 'Object'}]"
            seen.add(id(v))
            return [walk(x) for x in v] if isinstance(v, list) else {k: walk(x) for k, x in v.items()}
        return v

    return walk(value)


#: What a view of a model shows, besides its type.
VIEWS = {
    "Catalog": ("Pages", "Names", "Dests", "ViewerPreferences", "PageLayout", "PageMode", "Outlines"),
    "Pages": ("Kids",),
    "Page": ("MediaBox", "Resources", "Contents"),
    "Resources": ("ExtGState", "ColorSpace", "Pattern", "Shading", "XObject", "Font", "ProcSet", "Properties"),
    "Stream": ("Length",),
    "Font": ("Subtype", "BaseFont", "Encoding", "FontDescriptor", "Widths", "ToUnicode", "DescendantFonts"),
}


def model_of(document: Document, value: Any) -> str | None:
    """Which of ``VIEWS`` an object is."""
    if isinstance(value, Stream):
        return "Stream"
    if not isinstance(value, dict):
        return None
    kind = value.get("Type")
    if kind in VIEWS:
        return str(kind)
    return "Resources" if {"Font", "ProcSet", "ExtGState", "XObject"} & value.keys() and kind is None else None


def view(document: Document, value: Any, media_box: list[float] | None = None) -> dict:
    """The fields of a model as they stand, references unresolved; a stream's decoded content as text, and a page's box as inherited."""
    model = model_of(document, value)
    fields = {k: tagged(document.get(value, k) if isinstance(value, Stream) else value.get(k)) for k in VIEWS[model]} if model else {}
    if media_box:
        fields["MediaBox"] = media_box
    if isinstance(value, Stream):
        return fields | {"buffer": decode_text(document.decoded(value))}
    return {"Type": model} | fields


def graphics_state(document: Document, resources: dict | None, name: str) -> dict | None:
    """A named entry of the resources' ExtGState."""
    return document.get(document.get(resources, "ExtGState"), name)


def _json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def _xref(d: Document, _: dict) -> Iterator[tuple]:
    for section, i, e in d.xref:
        yield section, i, e.object_number, e.generation_number, e.in_use, e.offset, e.container, e.index


def _trailers(d: Document, _: dict) -> Iterator[tuple]:
    for section, (_entries, trailer) in enumerate(d.sections):
        for key, value in trailer.items():
            yield section, key, _json(tagged(value))


def _metadata(d: Document, _: dict) -> Iterator[tuple]:
    size = d.trailer.get("Size")
    yield size if isinstance(size, int) else None, _json(tagged(d.catalog)), None if d.info is None else _json(simplify(d, d.info))


def _objects(d: Document, options: dict) -> Iterator[tuple]:
    for ref in sorted(d._in_use):
        value = d.object(ref)
        kind, sub = type_of(value)
        yield ref.number, ref.generation, kind, sub, _json(tagged(value)), d.decoded(value) if "stream" in options["columns"] and isinstance(value, Stream) and kind not in ("XRef",) and sub != "Image" else None


def _simplified(d: Document, _: dict) -> Iterator[tuple]:
    for ref in sorted(d._in_use):
        yield ref.number, ref.generation, _json(simplify(d, d.object(ref)))


def _views(d: Document, _: dict) -> Iterator[tuple]:
    boxes = {p.ref: p.media_box for p in d.pages}
    for ref in sorted(d._in_use):
        value = d.object(ref)
        model = model_of(d, value)
        if model and not (isinstance(value, Stream) and (type_of(value)[0] == "XRef" or type_of(value)[1] == "Image")):
            yield ref.number, ref.generation, model, _json(view(d, value, boxes.get(ref)))


def _form_spans(d: Document, options: dict) -> Iterator[tuple]:
    for ref in sorted(d._in_use):
        value = d.object(ref)
        if isinstance(value, Stream) and value.dictionary.get("Subtype") == "Form":
            for i, s in enumerate(form_spans(d, value, metrics=options.get("metrics"), glyphs=options.get("glyphs"))):
                yield ref.number, i, *s


def _pages(d: Document, options: dict) -> Iterator[tuple]:
    for p in d.pages:
        yield p.number, p.ref.number, p.media_box, _json(tagged(p.resources)) if "resources" in options["columns"] else None, d.content(p) if "content" in options["columns"] else None


def _page_ops(d: Document, options: dict) -> Iterator[tuple]:
    for p in d.pages:
        for i, o in enumerate(parse_content(d.content(p))):
            yield p.number, i, o.operator, o.alias, _json(tagged(o.operands)) if "operands" in options["columns"] else None


def _page_fonts(d: Document, options: dict) -> Iterator[tuple[int, str, Font]]:
    for p in d.pages:
        for name, ref in (d.get(p.resources, "Font") or {}).items():
            found = d.resolve(ref)
            if isinstance(found, dict):
                yield p.number, name, Font(d, found, options.get("metrics"), options.get("glyphs"))


def _fonts(d: Document, options: dict) -> Iterator[tuple]:
    for page, name, font in _page_fonts(d, options):
        yield page, name, str(font.dictionary.get("Subtype") or ""), font.base_font, font.bold, font.italic, font.char_bytes


def _font_encoding(d: Document, options: dict) -> Iterator[tuple]:
    for page, name, font in _page_fonts(d, options):
        widths, default = font.widths
        for code, text in sorted(font.encoding.items()):
            yield page, name, code, text, float(widths.get(code, default))


def _text_spans(d: Document, options: dict) -> Iterator[tuple]:
    for p in d.pages:
        for i, s in enumerate(page_spans(d, p, options.get("metrics"), options.get("glyphs"))):
            yield p.number, i, *s


KERNELS: dict[str, Callable[[Document, dict], Iterator[tuple]]] = {
    "xref": _xref,
    "trailers": _trailers,
    "metadata": _metadata,
    "objects": _objects,
    "simplified": _simplified,
    "views": _views,
    "form_spans": _form_spans,
    "pages": _pages,
    "page_ops": _page_ops,
    "fonts": _fonts,
    "font_encoding": _font_encoding,
    "text_spans": _text_spans,
}


def read_table(files: DataFrame, name: str, mode: str = "failfast", trailer_precedence: str = "newest", metrics: dict | None = None, glyphs: dict | None = None, columns: tuple[str, ...] | None = None, opened: Callable[[pa.RecordBatch], Iterator[tuple[str, bytes]]] | None = None) -> DataFrame:
    """One of the tables of ``SCHEMAS`` from (path, content), or the named columns of it, in its order.

    What only other columns need is not made. ``opened`` gives the files of a
    batch of rows of another shape, one after the other: none is held besides
    the one that is read.

    ``failfast`` raises on a malformed file. ``permissive`` keeps the rows that
    came before the error and adds a column ``_error``: one row with only path
    and error for each malformed file.
    """
    if mode not in ("failfast", "permissive"):
        raise ValueError(f"unknown mode {mode}")
    every = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    if columns is not None and not set(columns) <= set(every):
        raise ValueError(f"{name} has no columns {sorted(set(columns) - set(every))}")
    wanted = [i for i, c in enumerate(every) if columns is None or c in columns]
    kernel, options = KERNELS[name], {"metrics": metrics, "glyphs": glyphs, "columns": {every[i] for i in wanted}}
    schema = ", ".join(SCHEMAS[name].split(", ")[i] for i in wanted) + (", _error string" if mode == "permissive" else "")
    attach(files.sparkSession)
    target = files.sparkSession.createDataFrame([], schema).schema
    types = pickle.loads(pickle.dumps(_arrow(target)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for path, content in (opened or _held)(batch):
                try:
                    for row in kernel(Document(content, trailer_precedence), options):
                        rows.append((path, *row))
                        if len(rows) >= OUT_ROWS:
                            yield made(rows)
                            rows, size = [], 0
                except MALFORMED as error:
                    if mode == "failfast":
                        raise PdfError(f"{path}: {error}") from error
                    rows.append((path, *[None] * (len(every) - 1), str(error)))
                size += len(content)
                if size >= OUT_BYTES:  # of files, as rows of small ones go together
                    if rows:
                        yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        places = [*wanted, len(every)] if mode == "permissive" else wanted
        full = [r if len(r) > len(every) else (*r, None) for r in rows] if mode == "permissive" else rows
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in full], t) for i, (_, t) in zip(places, types, strict=True)], names=[n for n, _ in types])

    return (files if opened else files.select("path", "content")).mapInArrow(run, schema)


def _held(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
        yield path, content.as_py()


def _arrow(schema) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return [(f.name, f.type) for f in to_arrow_schema(schema)]


class Pdf:
    """The files below a folder. Each method is a DataFrame; nothing is read before an action."""

    def __init__(self, spark: SparkSession, path: str, **options: Any):
        self.spark, self.options, self.files = attach(spark), options, files(spark, path)

    def table(self, name: str) -> DataFrame:
        return read_table(self.files, name, **self.options)

    def metadata(self) -> DataFrame:
        return self.table("metadata")

    def xref(self) -> DataFrame:
        return self.table("xref")

    def layout(self) -> DataFrame:
        return layout(self.table("text_spans").where(F.col("span_seq").isNotNull()))

    def form_layout(self) -> DataFrame:
        """Forms laid out by themselves, each within its bounding box."""
        return layout(self.table("form_spans").where(F.col("span_seq").isNotNull()), ("path", "object_number"))

    def papers(self) -> DataFrame:
        return with_empty(papers(self.layout()), self.files)

    def text(self) -> DataFrame:
        return self.papers().select("path", paper_text(F.col("sections")).alias("text"))

    def read(self, type: str = "string") -> DataFrame:
        """What ``type`` names: pdf (objects), metadata, xref, paper or string."""
        found = {"pdf": lambda: self.table("objects"), "metadata": self.metadata, "xref": self.xref, "paper": self.papers, "string": self.text}
        if type not in found:
            raise ValueError(f"unknown type {type}")
        return found[type]()

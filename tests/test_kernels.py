"""Byte-level kernels: parsing, filters, character maps, cross-references, encodings, fonts."""

import os
import random
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parchwork.kernels import filters as F
from parchwork.kernels.cmap import CodeRange, parse_cmap
from parchwork.kernels.document import Document, xref_table
from parchwork.kernels.encodings import decode_text, expand_differences, glyph_text, glyphmap
from parchwork.kernels.fonts import cid_widths, overlay, type1_program
from parchwork.kernels.objects import Indirect, Name, PdfError, Ref, Stream, parse_content, parse_value, tagged
from parchwork.kernels.vm import Machine, page_spans
from parchwork.kernels.writer import encoded, file_of, paged_file, stream


@pytest.mark.parametrize(
    ("source", "value"),
    [
        (b"null", None), (b"true", True), (b"-12", -12), (b"4.5", 4.5), (b"/A#42c", Name("ABc")), (b"<48 656>", b"He`"), (b"(a(b)c)", b"a(b)c"),
        (rb"(\(\101\53\n\q)", b"(A+\nq"), (b"[1 /x [2]]", [1, "x", [2]]), (b"<</A 1/B<</C(d)>>>>", {"A": 1, "B": {"C": b"d"}}), (b"7 0 R", Ref(7, 0)),
        (b"% comment\n 3", 3), (b"3 0 obj (x) endobj", Indirect(Ref(3), b"x")), (b"(a\\\r\nb)", b"ab"),
    ],
)
def test_values(source, value):
    assert parse_value(source) == value


def test_names_and_strings_differ():
    assert isinstance(parse_value(b"/x"), Name) and isinstance(parse_value(b"(x)"), bytes)
    assert tagged(parse_value(b"[/x (x) 1 0 R]")) == ["x", {"$bin": "eA=="}, {"$ref": [1, 0]}]


def test_stream_lengths():
    assert parse_value(b"<</Length 3>>stream\nabc\nendstream") == Stream({"Length": 3}, b"abc")
    assert parse_value(b"<</Length 9 0 R>>stream\r\nabc\nendstream", resolve=lambda r: 3).data == b"abc"
    assert parse_value(b"<</Length 99>>stream\nabc\nendstream").data == b"abc"  # a wrong length
    with pytest.raises(PdfError):
        parse_value(b"<</Length 9 0 R>>stream\nabc\nendstream")


@pytest.mark.parametrize("source", [b"<</A>>", b"[1", b"(a", b"<</A 1]", b"<4g>", b""])
def test_malformed_values(source):
    with pytest.raises(PdfError):
        parse_value(source)


def test_deep_nesting_needs_no_recursion():
    assert parse_value(b"[" * 20000 + b"]" * 20000) is not None


def test_content():
    ops = parse_content(b"q BT /F 9 Tf (a) ' null 2 xx BI /W 1 ID \x00EIq\x01 EI Q")
    assert [(o.operator, o.alias is not None) for o in ops] == [("q", True), ("BT", True), ("Tf", True), ("'", True), ("xx", False), ("BI", True), ("EI", True), ("Q", True)]
    assert ops[4].operands == [None, 2]
    assert parse_content(b"<414> Tj")[0].operands == [b"A@"]


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_filter_round_trips(data):
    for chain in (("ASCII85Decode",), ("ASCIIHexDecode",), ("LZWDecode",), ("FlateDecode",), ("ASCII85Decode", "FlateDecode")):
        assert F.apply_filters(encoded(data, chain)[0], list(chain)) == data


def test_filter_edges():
    assert F.ascii85_decode(b"z~>\n") == bytes(4)
    assert F.asciihex_decode(b"4 1 4>") == b"A@"
    assert F.lzw_decode(bytes.fromhex("800B6050220C0C8501")) == b"-----A---B"
    assert F.lzw_decode(F.lzw_encode(b"\xff" * 300)) == b"\xff" * 300
    for bad in (lambda: F.ascii85_decode(b"ab~>c"), lambda: F.ascii85_decode(b"abz"), lambda: F.apply_filters(b"", ["DCTDecode"]), lambda: F.flate_decode(b"nope")):
        with pytest.raises(PdfError):
            bad()
    reader = F.BitReader(bytes([0b10110011, 0b01010101]))
    assert [reader.next(n) for n in (3, 5, 4, 4)] == [0b101, 0b10011, 0b0101, 0b0101]


@pytest.mark.parametrize("kind", range(5))
def test_png_predictors(kind):
    rows = [os.urandom(12) for _ in range(5)]
    above, out = bytes(12), b""
    for row in rows:
        line = bytearray()
        for i, b in enumerate(row):
            left, up, corner = row[i - 3] if i >= 3 else 0, above[i], above[i - 3] if i >= 3 else 0
            line.append(b - (0, left, up, (left + up) // 2, F._paeth(left, up, corner))[kind] & 255)
        out += bytes([kind]) + bytes(line)
        above = row
    assert F.flate_decode(zlib.compress(out), {"Predictor": 15, "Columns": 4, "Colors": 3}) == b"".join(rows)


def test_cmaps():
    found = parse_cmap(b"1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfchar <01> <0041> <02> <00660069> endbfchar 1 beginbfrange <10> <12> <0061> endbfrange 1 beginbfrange <20> <21> [<0078> <0079>] endbfrange 1 begincidrange <00> <10> 5 endcidrange")
    assert found.code_space == [CodeRange(0, 255)]
    assert {m.src: m.dst for m in found.mappings} == {1: "A", 2: "fi", 16: "a", 17: "b", 18: "c", 32: "x", 33: "y"}
    assert parse_cmap(b"").byte_length == 1
    for bad in (b"1 beginbfrange <00> <0001> <0041> endbfrange", b"1 beginbfrange <00> <02> [<0041>] endbfrange", b"1 beginbfchar <00> endbfchar"):
        with pytest.raises(PdfError):
            parse_cmap(bad)


def test_xref_table():
    entries, _ = xref_table(b"xref\r\n0 1\r\n0000000023 65535 f\r\n3 2\r\n0000025324 00000 n\r\n0000025518 00002 n\r\n")
    assert [(e.object_number, e.generation_number, e.in_use, e.offset) for e in entries] == [(0, 65535, False, 23), (3, 0, True, 25324), (4, 2, True, 25518)]


def test_encodings():
    assert [len(glyphmap(e)) for e in ("StandardEncoding", "PDFDocEncoding")] == [149, 229]
    assert glyphmap("StandardEncoding")[0x27] == "quoteright" and glyphmap("WinAnsiEncoding")[0x80] == "Euro"
    assert [glyph_text(n) for n in ("Aacute", "uni00660069", "u1F600", "char41", ".notdef", "nothing")] == ["Á", "fi", "😀", "A", None, None]
    assert expand_differences([5, Name("a"), Name("b"), 5, Name("c")]) == {5: "c", 6: "b"}
    assert decode_text(b"\xfe\xff\x00A") == "﻿A" and decode_text(b"A\x80\x9f") == "A•"
    assert overlay({1: "a", 2: "b"}, None, {2: "c"}) == {1: "a", 2: "c"}
    assert cid_widths([1, [10, 20], 5, 7, 30, 6, [40]]) == {1: 10, 2: 20, 5: 30, 6: 40, 7: 30}
    assert type1_program(b"/Weight (Bold) def /Encoding StandardEncoding def dup 65 /B put") == ("StandardEncoding", {65: "B"}, "Bold")


@pytest.mark.parametrize("xref", ["table", "stream"])
@pytest.mark.parametrize("filters", [(), ("FlateDecode",), ("ASCII85Decode", "LZWDecode"), ("ASCIIHexDecode",)])
def test_files_round_trip(xref, filters):
    lines = [[(10.0, 20.0, 12.0, "one (two)"), (90.0, 20.0, 12.0, "tré")], [(10.0, 40.0, 12.0, "x")]]
    data = paged_file([lines, [[(1.0, 2.0, 3.0, "second")]]], filters, xref, packed=xref == "stream")
    document = Document(data)
    assert [[s.text for s in page_spans(document, p)] for p in document.pages] == [["one (two)", "tré", "x"], ["second"]]
    first = page_spans(document, document.pages[0])[0]
    assert (first.min_x, first.min_y, first.max_x, first.max_y) == (10.0, 20.0, 64.0, 32.0)


def _with_content(content: bytes, extra: bytes = b"", objects: dict | None = None) -> Document:
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /X-BoldItalic /Encoding /WinAnsiEncoding /FontDescriptor << /MissingWidth 1000 >> >>"
    base = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 800 600] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F 5 0 R >> " + extra + b" >> >>", 4: stream(content), 5: font}
    return Document(file_of(base | (objects or {}), 1))


def test_machine():
    d = _with_content(b"BT /F 10 Tf 20 TL 100 500 Td (ab) Tj T* [(c) -1000 (d)] TJ 2 0 0 2 0 0 Tm 1 Tc 50 Tz (ee) ' ET")
    spans = page_spans(d, d.pages[0])
    assert [(s.text, s.min_x, s.min_y, s.max_x - s.min_x, s.font_size) for s in spans] == [("ab", 100, 100, 20, 10), ("c", 100, 120, 10, 10), ("d", 120, 120, 10, 10), ("ee", 0, 640, 22, 20)]
    assert spans[0].font_bold and spans[0].font_italic


@pytest.mark.parametrize(("levels", "shown"), [(3, True), (4, True), (5, False)])
def test_form_depth(levels, shown):
    forms = {10 + i: stream(b"/N Do", b" /Type /XObject /Subtype /Form /Resources << /XObject << /N %d 0 R >> >>" % (11 + i)) for i in range(levels - 1)}
    forms[10 + levels - 1] = stream(b"BT /F 1 Tf (deep) Tj ET", b" /Subtype /Form /Resources << /Font << /F 5 0 R >> >>")
    d = _with_content(b"/A Do", b"/XObject << /A 10 0 R >>", forms)
    assert bool(page_spans(d, d.pages[0])) is shown


def test_document_errors():
    good = paged_file([[[(1.0, 2.0, 3.0, "x")]]])
    for bad in (b"", good.replace(b"startxref", b"nothing__"), good.replace(b"/Root 1 0 R", b"/Root 9 0 R")):
        with pytest.raises(PdfError):
            Document(bad).pages  # noqa: B018
    d = _with_content(b"BT /Other 1 Tf (x) Tj ET")
    with pytest.raises(PdfError):
        page_spans(d, d.pages[0])


def test_newest_trailer_wins_and_chains_end():
    base = paged_file([[[(1.0, 2.0, 3.0, "x")]]])
    start = base.rfind(b"xref\n0")
    newer = base + b"xref\n0 0\ntrailer\n<< /Root 1 0 R /Own (new) /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (start, len(base))
    assert Document(newer).trailer["Own"] == b"new" and len(Document(newer).sections) == 2
    looped = newer.replace(b"/Prev %d" % start, b"/Prev %d" % len(base))
    assert len(Document(looped).sections) == 1


def test_machine_is_extensible():
    class Loud(Machine):
        def show(self, data):
            heard.append(data)

    heard = []
    d = _with_content(b"BT /F 1 Tf (x) Tj ET")
    Loud(d, d.pages[0].resources, 600.0).run(parse_content(d.content(d.pages[0])))
    assert heard == [b"x"]


def test_random_bytes_never_hang():
    rng = random.Random(3)
    for _ in range(200):
        data = bytes(rng.choice(b"<>[]()/ 0123 obj Rstream\n") for _ in range(80))
        try:
            parse_value(data)
        except PdfError:
            pass


def test_glyph_names_by_rule():
    from parchwork.kernels.encodings import glyph_texts, parse_glyph_list

    known = {
        "afii10023": "Ё", "afii10049": "Я", "afii57448": "و", "afii57690": "ת", "asmallhiragana": "ぁ", "akatakana": "ア", "alefhebrew": "א", "finalkaf": "ך",
        "behfinalarabic": "ﺐ", "onearabic": "١", "aavowelsigndeva": "ा", "kokaithai": "ก", "aybarmenian": "ա", "kiyeokkorean": "ㄱ", "onecircle": "①", "aparen": "⒜",
        "Amonospace": "Ａ", "commamonospace": "，", "foursuperior": "⁴", "nsuperior": "ⁿ", "Oneroman": "Ⅰ", "oneroman": "ⅰ", "acircumflexacute": "ấ", "alphatonos": "ά",
        "Ssmall": "\uf773", "Agravesmall": "\uf7e0", "trademarkserif": "\uf6db", "sevenoldstyle": "\uf737", "universal": "∀", "mu": "µ", "Delta": "∆",
    }
    assert {n: glyph_texts().get(n) for n in known} == known and len(glyph_texts()) > 3000
    more = parse_glyph_list("# own names\nfoo;0041 0042\nA;0391\n")
    assert [glyph_text(n, more) for n in ("foo", "A", "A.alt", "foo_A", "B", "unheard")] == ["AB", "Α", "Α", "ABΑ", "B", None]


def own_file(font, content=b"BT /F1 10 Tf 1 0 0 1 10 700 Tm (A i) Tj (W) Tj ET", more=b""):
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 1 /MediaBox [0 0 612 792] /Kids [3 0 R] >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> /ExtGState << /G1 << /LW 2 >> >> " + more + b" >> >>",
        4: stream(content), 5: b"<< /Type /Font /Subtype /Type1 " + font + b" >>",
    }
    return objects


@pytest.mark.parametrize(("name", "widths"), [("Helvetica", (667, 278, 222, 944)), ("Helvetica-BoldOblique", (722, 278, 278, 944)), ("Times-Roman", (722, 250, 278, 944)), ("Times-BoldItalic", (667, 250, 278, 889)), ("Courier-Bold", (600,) * 4), ("Symbol", (1000,) * 4)])
def test_core_fonts_need_no_widths(name, widths):
    document = Document(file_of(own_file(b"/BaseFont /" + name.encode()), 1))
    first, second = page_spans(document, document.pages[0])
    assert abs(first.max_x - first.min_x - sum(widths[:3]) / 100) < 1e-9 and abs(second.min_x - first.max_x) < 1e-9
    assert abs(second.max_x - second.min_x - widths[3] / 100) < 1e-9
    with pytest.raises(PdfError, match="no widths"):
        page_spans(other := Document(file_of(own_file(b"/BaseFont /Unheard"), 1)), other.pages[0])


def test_forms_views_and_states():
    from parchwork.kernels.vm import form_spans
    from parchwork.sources.pdf import graphics_state, simplify, view

    objects = own_file(b"/BaseFont /Courier", more=b"/XObject << /X 6 0 R >>")
    objects[6] = stream(b"BT /F1 10 Tf 1 0 0 1 5 80 Tm (in a form) Tj ET", b" /Type /XObject /Subtype /Form /BBox [0 0 200 100] /Resources << /Font << /F1 5 0 R >> >>")
    document = Document(file_of(objects, 1))
    (span,) = form_spans(document, document.resolve(Ref(6)))
    assert (span.text, span.min_x, span.min_y) == ("in a form", 5.0, 20.0)
    assert graphics_state(document, document.pages[0].resources, "G1") == {"LW": 2} and graphics_state(document, document.pages[0].resources, "G2") is None
    page = view(document, document.object(Ref(3)), document.pages[0].media_box)
    assert page["Type"] == "Page" and page["MediaBox"] == [0, 0, 612, 792] and page["Contents"] == {"$ref": [4, 0]}
    assert view(document, document.object(Ref(4)))["buffer"].startswith("BT /F1") and view(document, document.object(Ref(2)))["Kids"] == [{"$ref": [3, 0]}]
    assert "[Circular Object]" in str(simplify(document, document.object(Ref(2)))) or simplify(document, document.object(Ref(2)))["Count"] == 1


def test_errors_show_what_stands_around():
    error = PdfError("odd", 300, b"a" * 300 + b"!" + b"b" * 400)
    assert str(error).count("a") >= 256 and str(error).count("b") >= 250


def test_ascii85_takes_long_data_at_once():
    """Zeros, part groups and 4 MB in a time that a loop over its bytes does not meet."""
    for n in range(23):
        for data in (bytes(n), bytes(range(n)), bytes(4) + bytes(range(n)) + bytes(n)):
            assert F.ascii85_decode(F.ascii85_encode(data)) == data
    assert F.ascii85_encode(bytes(6)) == b"z!!!~>" and F.ascii85_decode(b"z!!!~>") == bytes(6)
    data = bytes(range(256)) * 16_000
    began = time.time()
    assert F.ascii85_decode(F.ascii85_encode(data)) == data
    assert time.time() - began < 1


def test_lzw_is_linear_in_its_data():
    """Bits that are written no longer move with each code after them."""
    rng = random.Random(4)
    data = bytes(rng.choices(b"abcdefgh ", k=1_500_000))
    began = time.time()
    assert F.lzw_decode(F.lzw_encode(data)) == data
    assert time.time() - began < 10

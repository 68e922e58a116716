"""DataFrame operators against folds in Python, sources and sinks on written files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parchwork.functions import texts as X
from parchwork.kernels.writer import paged_file
from parchwork.operators import layout as L
from parchwork.operators import sections as S
from parchwork.plans.queries import QUERIES
from parchwork.sources.datasource import register
from parchwork.sources.pdf import Pdf, files, read_table
from parchwork.streaming.files import stream_table

SPANS = "path string, page_no int, span_seq int, min_x double, min_y double, max_x double, max_y double, font_size double, font_bold boolean, text string"


def spans_of(tops):
    return [("d", 1, i, 0.0, float(y), 1.0, float(y) + 10, 10.0, False, "x") for i, y in enumerate(tops)]


def test_lines_are_a_fold(spark):
    rng = random.Random(1)
    rows, expected = [], {}
    for doc in range(30):
        tops = [rng.choice([100, 104, 105, 108, 95, 106, 100 + 1e-9]) for _ in range(rng.randint(1, 60))]
        top, line = None, -1
        for i, y in enumerate(tops):
            if top is None or abs(y - top) > 5:
                top, line = y, line + 1
            top = min(top, y)
            expected[str(doc), i] = line
            rows.append((str(doc), 1, i, 0.0, float(y), 1.0, float(y), 10.0, False, "x"))
    found = L.group_lines(spark.createDataFrame(rows, SPANS)).collect()
    assert {(r.path, r.span_seq): r.line_id for r in found} == expected
    three = L.group_lines(spark.createDataFrame(spans_of([100, 104, 108]), SPANS)).orderBy("span_seq").collect()
    assert [r.line_id for r in three] == [0, 0, 1]


def test_words_at_the_threshold(spark):
    rows = [("d", 1, i, x, 0.0, x + 10, 10.0, 10.0, False, "x") for i, x in enumerate([0.0, 11.0, 22.0 + 1e-9, 20.0])]
    found = L.partition_words(L.group_lines(spark.createDataFrame(rows, SPANS))).orderBy("span_seq").collect()
    assert [r.word_id for r in found] == [0, 0, 1, 1]


def test_sections_are_a_fold(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for doc in range(60):
        section, titled = 0, True  # titled: no content in this section yet
        content = False
        for i in range(rng.randint(1, 25)):
            c = rng.choice("HNBW")
            if c == "H" and content:
                section, content, titled = section + 1, False, True
            role = "title" if c == "H" or (c in "BW" and titled) else "body"
            if c == "N":
                content, titled = True, False
            rows.append((str(doc), 1, i, c))
            expected[str(doc), i] = (section, role)
    found = S.group_sections(spark.createDataFrame(rows, "path string, page_no int, paragraph_id int, cls string")).collect()
    assert {(r.path, r.paragraph_id): (r.section_id, r.role) for r in found} == expected


def test_unwrap(spark):
    bag = spark.createDataFrame([("d", "well-known", 2), ("d", "wellknown", 1), ("d", "ab", 2), ("d", "cd", 2)], "path string, word string, n long")
    texts = ["a well-\nknown fact", "in-\nform me", "Jean-\nPaul", "ab-\ncd", "no-\n\nmatch", "a-\nb-\nc"]
    rows = [("d", 1, i, t) for i, t in enumerate(texts)]
    found = S.unwrap_lines(spark.createDataFrame(rows, "path string, page_no int, paragraph_id int, text string"), bag).orderBy("paragraph_id").collect()
    assert [r.text for r in found] == ["a well-known fact", "inform me", "Jean-Paul", "ab-cd", "no-  match", "ab- c"]


def test_normalize(spark):
    rows = [("a  b\t\nc\x07d",), ("x^2 ´e ´ ﬁ",), (None,), ("",)]
    found = [r[0] for r in spark.createDataFrame(rows, "t string").select(X.normalize(F.col("t"))).collect()]
    assert found[0] == "a b cd" and found[2:] == [None, ""]
    assert found[1] == "x2\u0302 \u00e9 \u0301fi"  # a modifier before a space is the mark alone


def test_byte_functions(spark):
    row = spark.createDataFrame([(bytearray(b"\x01\x02\x03"), "4a4")], "b binary, h string").select(X.char_codes(F.col("b"), 2).alias("c"), X.swap_bytes(F.col("b")).alias("s"), X.hex_bytes(F.col("h")).alias("x"), X.hex_codes(F.col("h"), 2).alias("k"), X.as_reference(F.lit("7")).alias("r")).first()
    assert row.c == [258, 3] and bytes(row.s) == b"\x02\x01\x03" and bytes(row.x) == b"\x4a\x40" and row.k == [0x4A, 4] and tuple(row.r) == (7, 0)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    body = [[(36.0, 20.0, 20.0, "Title")], [(36.0, 60.0, 10.0, "First line of text")], [(36.0, 72.0, 10.0, "second line")]]
    (top / "a.pdf").write_bytes(paged_file([body, [[(36.0, 20.0, 10.0, "next page")]]]))
    (top / "b.pdf").write_bytes(paged_file([[]], xref="stream", packed=True))
    return str(top)


def test_public_reads(spark, folder):
    pdf = Pdf(spark, folder)
    text = {r.path[-5:]: r.text for r in pdf.read("string").collect()}
    assert text["b.pdf"] == "# \n" and "First line of text" in text["a.pdf"] and "next page" in text["a.pdf"] and text["a.pdf"].startswith("# Title")
    assert pdf.read("xref").count() > 5 and pdf.read("metadata").count() == 2 and pdf.read("pdf").where("type = 'Page'").count() == 3
    assert pdf.table("fonts").first().base_font == "Own"
    with pytest.raises(ValueError):
        pdf.read("other")


def test_permissive(spark, folder, tmp_path):
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "ok.pdf").write_bytes(paged_file([[[(1.0, 2.0, 3.0, "x")]]]))
    found = read_table(files(spark, str(tmp_path)), "text_spans", mode="permissive").collect()
    assert sorted((r.path[-6:], r.text, r._error is None) for r in found) == [("ad.pdf", None, False), ("ok.pdf"[-6:], "x", True)]
    with pytest.raises(Exception, match="startxref"):
        read_table(files(spark, str(tmp_path)), "text_spans").collect()


def test_data_source(spark, folder):
    register(spark)
    assert spark.read.format("pdf").option("table", "page_ops").load(folder).where("alias = 'showString'").count() == 4


def test_stream(spark, folder, tmp_path):
    q = stream_table(spark, folder, "text_spans").writeStream.format("memory").queryName("spans").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("spans").count() == 4


def made_documents(spark, folder):
    """A folder with long documents, whose numbers and letters leave no short code of much use."""
    rng = random.Random(5)
    texts = ["short", "".join(rng.choice("abcdefghij klmnopqrstuvwxyzäé€😀0123456789\n") for _ in range(30_000)), "x" * 9000, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return texts


@pytest.mark.parametrize("name", ["ascii85_roundtrip", "asciihex_roundtrip", "flate_roundtrip", "lzw_roundtrip", "filter_chain_roundtrip"])
def test_round_trips_take_whole_texts(spark, tmp_path, name):
    texts = made_documents(spark, tmp_path)
    assert {r.doc_id: r.text for r in QUERIES[name](spark, str(tmp_path)).collect()} == dict(enumerate(texts))


def test_glyphs_of_whole_texts(spark, tmp_path):
    texts = made_documents(spark, tmp_path)
    want, widths = {}, {}
    for i, text in enumerate(texts):
        x = 0.0
        for seq, c in enumerate(text or "", 1):
            want[i, seq] = x
            x += ord(c) % 7 * 100 / 1000 * 12 + 0.5 + (0.25 if c == " " else 0)
            widths[i] = widths.get(i, 0) + (1000 if ord(c) % 5 == 0 or ord(c) >= 0x3000 else ord(c) % 7 * 100)
    found = {(r.string_id, r.seq): r.x for r in QUERIES["text_advance"](spark, str(tmp_path)).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-5 for k in want)
    assert {r.string_id: r.width for r in QUERIES["measure_text"](spark, str(tmp_path)).collect()} == widths


def test_differences_of_all_orders(spark, tmp_path):
    rng = random.Random(6)
    rows = [(order, line, rng.randint(1, 999)) for order in range(1, 41) for line in range(1, 8)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want, code = {}, 0
    for order, line, part in rows:
        if line % 3 == 1:
            code = part % 200
        else:
            want[order, code], code = f"g{part % 50}", code + 1
    assert {(r.font_id, r.code): r.glyph for r in QUERIES["expand_differences"](spark, str(tmp_path)).collect()} == want


def test_lines_of_a_very_long_page(spark):
    """Thousands of lines on one page, over several blocks of the fold, as the rule gives them one by one."""
    import random
    import time

    from parchwork.operators import layout as L

    rng = random.Random(9)
    tops, y = [], 0.0
    for _ in range(60_000):
        y += rng.choice([0, 0, 0, 1, 4, 6, 14])
        tops.append(y + rng.choice([0, -1, 2]))
    spans = spark.createDataFrame([("a", 1, i, t) for i, t in enumerate(tops)], "path string, page_no int, span_seq int, min_y double")
    began = time.time()
    found = {r.span_seq: r.line_id for r in L.group_lines(spans).collect()}
    assert time.time() - began < 60
    top, line, want = None, -1, {}
    for i, t in enumerate(tops):
        if top is None or abs(t - top) > 5:
            top, line = t, line + 1
        top = min(top, t)
        want[i] = line
    assert found == want


def test_tables_of_forms_and_views(spark):
    from parchwork.kernels import writer
    from parchwork.sources.pdf import read_table

    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 1 /MediaBox [0 0 612 792] /Kids [3 0 R] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << >> >>", 4: writer.stream(b"")}
    objects[5] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /Differences [65 /foo] >> >>"
    objects[6] = writer.stream(b"BT /F1 10 Tf 1 0 0 1 5 80 Tm (A) Tj ET", b" /Subtype /Form /BBox [0 0 200 100] /Resources << /Font << /F1 5 0 R >> >>")
    made = spark.createDataFrame([("f", bytearray(writer.file_of(objects, 1)))], "path string, content binary")
    assert [(r.object_number, r.text, r.min_y) for r in read_table(made, "form_spans", glyphs={"foo": "xyz"}).collect()] == [(6, "xyz", 20.0)]
    assert {r.object_number: r.model for r in read_table(made, "views").collect()} == {1: "Catalog", 2: "Pages", 3: "Page", 4: "Stream", 5: "Font", 6: "Stream"}
    assert read_table(made, "simplified").count() == 6


def test_columns_of_a_table(spark):
    from parchwork.kernels.writer import paged_file
    from parchwork.sources.pdf import read_table

    made = spark.createDataFrame([("f", bytearray(paged_file([[[(10.0, 20.0, 10.0, "a b")]]]))), ("g", bytearray(b"none"))], "path string, content binary")
    good = made.where("path = 'f'")
    assert read_table(good, "page_ops", columns=("alias", "path")).columns == ["path", "alias"]
    assert [tuple(r) for r in read_table(good, "text_spans", columns=("path", "text")).collect()] == [("f", "a b")]
    found = {r.path: (r.text, r._error is None) for r in read_table(made, "text_spans", mode="permissive", columns=("path", "text")).collect()}
    assert found == {"f": ("a b", True), "g": (None, False)}
    with pytest.raises(ValueError, match="no columns"):
        read_table(good, "text_spans", columns=("path", "nothing"))


def test_work_is_spread_and_folders_are_shared(spark, monkeypatch):
    from types import SimpleNamespace

    from parchwork.session import shared_folder, spread

    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() >= 4
    many = spark.range(100).repartition(9)
    assert spread(many) is many
    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context))


def test_data_source_groups_files_and_forgives(spark, tmp_path, monkeypatch):
    from parchwork.sources import datasource

    for i in range(5):
        (tmp_path / f"{i}.pdf").write_bytes(paged_file([[[(10.0, 20.0, 10.0, f"text {i}")]]]) if i != 3 else b"broken")
    monkeypatch.setattr(datasource, "PART_FILES", 2)
    reader = datasource._Reader({"path": str(tmp_path), "mode": "permissive"})
    assert [len(p.paths) for p in reader.partitions()] == [2, 2, 1]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[-2] for r in rows] == ["text 0", "text 1", "text 2", None, "text 4"] and [r[-1] is None for r in rows] == [True, True, True, False, True]
    register(spark)
    assert spark.read.format("pdf").option("mode", "permissive").load(str(tmp_path)).where("_error is null").count() == 4


def test_cut_drops_its_shuffle_files(spark, tmp_path):
    import time
    from pathlib import Path

    from parchwork.session import cut, stored

    folders = [Path(str(d)) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {f for d in folders for f in d.glob("*/shuffle_*.data")}
    before, setting = shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    found = cut(spark.range(10_000).repartition(4, "id").groupBy(F.col("id") % 7).count())
    again = stored(found.repartition(3, "count"), "again")
    time.sleep(2)
    assert shuffles() <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert found.count() == 7 == again.count() and sum(r["count"] for r in found.collect()) == 10_000


#: Queries whose results come from one document each.
IN_ROWS = ["paper_string", "bag_of_words", "group_sections", "partition_words", "split_paragraphs", "group_columns", "group_lines", "spans_project", "unwrap_lines", "text_advance"]


@pytest.mark.parametrize("name", IN_ROWS)
def test_documents_stay_in_their_rows(spark, tmp_path, name):
    """Over a table in as many files as there are cores, nothing is dealt, sorted or gathered: what is written to disk does not grow with spans."""
    spark.createDataFrame([(i, f"one two-\nthree {i} " * 9) for i in range(80)], "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and not re.search("Exchange|Sort|Window|Aggregate|ExistingRDD", plan)


def test_a_file_of_few_row_groups_is_dealt_out(spark, tmp_path):
    """Spark plans more parts of such a file than have rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from parchwork.session import spread

    rng = random.Random(3)
    pq.write_table(pa.table({"doc_id": range(400), "text": ["".join(rng.choices("abcdefgh ", k=2000)) for _ in range(400)]}), f"{tmp_path}/d.parquet", row_group_size=200)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        found = spread(spark.read.parquet(f"{tmp_path}/d.parquet"), "doc_id")
        assert sum(n > 0 for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) >= 4 and found.count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_layout_in_a_row_is_that_of_the_operators(spark):
    """Pages of odd spans: arrays of one document against tables of spans."""
    import numpy as np

    from parchwork.kernels import layout as K
    from parchwork.kernels.blanks import normalize_blanks

    rng, rows, pages = random.Random(12), [], {}
    for path in map(str, range(40)):
        for page in (1, 2):
            x, y, made = 0.0, 100.0, []
            for i in range(rng.choice([1, 2, 3, 30, 120])):
                if rng.random() < 0.3:
                    x, y = rng.choice([0.0, 0.0, 3.0, 7.5, 40.0, 300.0]), y + rng.choice([-3, 4, 5, 5.5, 12, 12, 12, 30, -90])
                w, size = rng.choice([5.0, 8.25]), rng.choice([10.0, 10.0, 10.0, 12.5, 14.0])
                made.append((path, page, i, x, y + rng.choice([0, 0, 1, -1]), x + w, y + size, size, rng.random() < 0.6, rng.choice(["a", "Word", "well-", " ", "ΣΑΣ", "x", "known"])))
                x += w + rng.choice([0, 1, 1.5, 6])
            rows += made
            columns = list(zip(*made, strict=True))
            pages.setdefault(path, []).append(K.Page(K.Spans(*[np.array(c) for c in columns[3:9]], list(columns[9]))))
    spans = spark.createDataFrame(rows, SPANS)
    laid = {(r.path, r.page_no, r.span_seq): (r.line_id, r.word_id, r.column_id, r.paragraph_id) for r in L.layout(spans).collect()}
    mine = {}
    for path, found in pages.items():
        for n, p in enumerate(found, 1):
            words = np.repeat(p.word_id, np.diff(p.words, append=p.n))
            for i in range(p.n):
                line = int(p.line_id[i])
                mine[path, n, i] = (line, int(words[i]), int(p.column_id[line]), int(p.paragraph_id[line]))
    assert mine == laid
    for interpolate in (False, True):
        papers = {r.path: [(s.title, s.paragraphs) for s in r.sections] for r in S.papers(L.layout(spans), compatibility=False, interpolate=interpolate).collect()}
        assert {path: K.paper(found, normalize_blanks, interpolate) for path, found in pages.items()} == papers


def test_advances_in_a_row_are_those_of_the_operator(spark):
    import numpy as np

    from parchwork.kernels.advance import advances, rounded
    from parchwork.operators import resolve as R

    rng = random.Random(13)
    rows = [("s", i, rng.choice(" ab"), rng.uniform(0, 1500), 12.0, 0.3, 0.7, 90.0) for i in range(300)]
    found = R.advances(spark.createDataFrame(rows, "string_id string, seq int, text string, width double, size double, char_space double, word_space double, scale double")).orderBy("seq").collect()
    assert [r.x for r in found] == advances(np.array([r[3] for r in rows]), np.array([r[2] == " " for r in rows]), 12.0, 0.3, 0.7, 90.0).tolist()
    odd = [0.0, 0.0000005, 1.0000005, 2.5000015, -1.0000005, 12345.6789015, 1e9 + 0.0000005, 3e12 + 1 / 3, 0.05 * 7, 1e300, *[rng.randint(0, 10**12) / 2e6 for _ in range(300)], *[rng.uniform(-1e6, 1e6) for _ in range(300)]]
    asked = spark.createDataFrame(list(enumerate(odd)), "i int, x double").select("i", F.round("x", 6).alias("x")).orderBy("i")
    assert [r.x for r in asked.collect()] == rounded(np.array(odd), 6).tolist()


#: Queries that write a file for each document and read it.
FILES_IN_ROWS = ["pdf_roundtrip_text", "pdf_fonts", "pdf_page_ops", "pdf_objects", "pdf_pages", "pdf_xref"]


@pytest.mark.parametrize("name", FILES_IN_ROWS)
def test_files_are_written_and_read_in_one_worker(spark, tmp_path, name):
    """Files do not go from one Python worker of a task through Spark to another."""
    spark.createDataFrame([(i, "one\ntwo") for i in range(80)], "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and not {"content", "stream", "resources"} & set(re.findall(r"(\w+)#", plan))


def test_rows_of_small_files_go_together(spark):
    """Many files, one batch, in both modes; and what columns are left out is not decoded."""
    from parchwork.kernels import writer

    broken = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 1 /MediaBox [0 0 612 792] /Kids [3 0 R] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 4: b"<< /Length 4 /Filter /FlateDecode >>\nstream\nnone\nendstream"}
    made = [(str(i), bytearray(b"none" if i == 7 else paged_file([[[(10.0, 20.0, 10.0, f"text {i}")]]]))) for i in range(300)]
    table = spark.createDataFrame([*made, ("broken", bytearray(writer.file_of(broken, 1)))], "path string, content binary").coalesce(1)
    found = read_table(table, "text_spans", mode="permissive", columns=("path", "text")).collect()
    assert {r.path: r.text for r in found} == {str(i): None if i == 7 else f"text {i}" for i in range(300)} | {"broken": None} and sum(r._error is not None for r in found) == 2
    assert read_table(table.where("path <> '7'"), "objects", columns=("path", "value")).where("path = 'broken'").count() == 4


def test_widths_and_texts_of_whole_strings():
    """Strings are read at once where that gives the same, else code by code."""
    from parchwork.kernels.document import Document
    from parchwork.kernels.fonts import Font
    from parchwork.kernels.objects import Name

    document = Document(paged_file([[]]))
    for widths, differences in (([500] * 256, []), ([333.3, 500, 7] * 85, []), ([250] * 9, [65, "fi", "Euro", "space"])):
        font = Font(document, {"Subtype": "Type1", "BaseFont": "Own", "Encoding": {"BaseEncoding": "WinAnsiEncoding", "Differences": [Name(d) if isinstance(d, str) else d for d in differences]}, "FirstChar": 0, "Widths": widths})
        data = bytes(range(256)) * 2
        assert font.decode(data) == "".join(font.encoding.get(c, "") for c in data)
        assert font.measure(data) == sum(float(widths[c]) if c < len(widths) else 0.0 for c in data)

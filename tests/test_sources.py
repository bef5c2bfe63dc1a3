import io
import zipfile
import zlib

from pyspark.sql import functions as F

from quillspark.sources import files, pdf_text


def docx(*parts):
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>{p}</w:t></w:r></w:p>' if isinstance(p, str) else "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in p) + "</w:tbl>" for p in parts)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return buffer.getvalue()


def test_load(spark, tmp_path):
    for name, data in {"a.txt": "xin chào".encode(), "b.md": "# é".encode("cp1252"), "c.CSV": b"x;y\n1;2\n", "d.html": b"<p>a<script>no</script>  b</p>\n<p>c</p>", "e.docx": docx("one", [["1", "2"]]), "f.docx": b"broken", "g.xyz": b"?", "h.pdf": b"pdf"}.items():
        (tmp_path / name).write_bytes(data)
    rows = files.load(spark, str(tmp_path), {".pdf": lambda b: [("page one", {"page": "0"}), (" ", {})]}).orderBy("source_file", "part").collect()
    got = {(r.source_file, r.part): r.page_content for r in rows}
    assert got == {("a.txt", 0): "xin chào", ("b.md", 0): "# é", ("c.CSV", 0): "x\ty\n1\t2", ("d.html", 0): "a b c", ("e.docx", 0): "one", ("e.docx", 1): "1\t2", ("f.docx", 0): None, ("h.pdf", 0): "page one"}
    assert [r.error is not None for r in rows if r.source_file == "f.docx"] == [True]
    assert files.documents(files.load(spark, str(tmp_path))).count() == 6


def test_uploads(spark):
    df = spark.createDataFrame([("a.PDF", 5), ("b.exe", 5), (None, 5), ("c.txt", 60 * 1024 * 1024)], "filename string, size long")
    assert [r[0] for r in df.select(files.upload_error()).collect()] == [None, "unsupported extension", "a name is needed", "too large"]


def pdf(*contents, font=b"", objstm=False):
    """A small PDF: one page for each content stream."""
    n = len(contents)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(n)) + b"] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % n, b"<< /Type /Font /Subtype /Type1 " + font + b" >>"]
    for i, c in enumerate(contents):
        packed = zlib.compress(c)
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * i), b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream"]
    extra = [b"<< /Length 90 >>\nstream\n" + b"1 beginbfchar <01> <1EA1> endbfchar 1 beginbfrange <41> <43> <0061> endbfrange".ljust(90) + b"\nendstream"] if font else []
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects + extra))


def test_pdf_text():
    one = b"BT /F1 12 Tf 72 700 Td (Hello \\(big\\) w) Tj [(or) -20 (ld) -300 (again)] TJ 0 -14 Td (second (nested) line) Tj ET"
    two = b"BT /F1 12 Tf 1 0 0 1 72 700 Tm <48 69> Tj T* (\\101\\n) ' ET"
    got = pdf_text.pages(pdf(one, two))
    assert [t for t, _ in got] == ["Hello (big) world again\nsecond (nested) line", "Hi\nA"] and [a["page"] for _, a in got] == ["0", "1"]
    mapped = pdf_text.pages(pdf(b"BT /F1 9 Tf (ABC\\001) Tj ET", font=b"/ToUnicode 6 0 R"))
    assert mapped[0][0] == "abcạ"


def test_pdf_cascade(spark, tmp_path):
    def broken(data):
        raise ValueError("no")

    f = files.pdf_extractor(broken, lambda b: [("from the second", {}), (" ", {})], lambda b: [[], [[["a", None], ["b", "c"]]]])
    assert [(t, a.get("page"), a["extraction_method"]) for t, a in f(b"")] == [("from the second", "0", "fallback"), ("a\t\nb\tc", "1", "tables")]
    (tmp_path / "x.pdf").write_bytes(pdf(b"BT /F1 12 Tf (Words of a page.) Tj ET"))
    (tmp_path / "y.pdf").write_bytes(b"not a pdf")
    rows = files.load(spark, str(tmp_path)).collect()
    assert [(r.source_file, r.page_content, r.attrs["page"]) for r in rows] == [("x.pdf", "Words of a page.", "0")]


def test_raw_files(spark, tmp_path):
    df = spark.createDataFrame([("c", "a.TXT", b"one", "2024-01-02 03:04:05")], "collection string, filename string, content binary, at string").withColumn("uploaded_at", F.to_timestamp("at")).drop("at")
    (row,) = files.store(df, str(tmp_path / "f")).collect()
    assert (row.storage_path, row["size"], row.file_extension) == ("c/20240102_030405_a.TXT", 3, ".txt")
    got = files.stored_file(spark, str(tmp_path / "f"), "c", "a.TXT").head()
    assert bytes(got.content) == b"one" and got.storage_path == row.storage_path

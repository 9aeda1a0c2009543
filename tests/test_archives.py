import json

import pytest
from fixtures import docx, pdf, png, zip_of

from quillmark.operators import audit, correlate
from quillmark.plans import reports
from quillmark.sources import archives, parsers


def test_two_identical_zips(spark, tmp_path):
    paths = []
    for name in ("Alpha供应商", "Beta供应商"):
        path = tmp_path / f"{name}.zip"
        path.write_bytes(zip_of([("internal/folder/", b""), ("internal/folder/document.txt", b"identical tender content")]))
        paths.append(str(path))
    files = archives.read_submissions(spark, [*paths, paths[0]]).cache()
    assert files.count() == 2 and {r["supplier"] for r in files.select("supplier").collect()} == {"Alpha供应商", "Beta供应商"}
    assert audit.identical_packages(audit.manifest_hashes(files)).count() == 1 == audit.exact_groups(files).count()
    assert correlate.correlate(files, False, False, False, False).count() == 0
    project = reports.Project("p", files)
    for ending in ("xlsx", "html", "pdf", "json"):
        reports.write_report(project, str(tmp_path / f"r.{ending}"))
    assert parsers.parse_pdf((tmp_path / "r.pdf").read_bytes()).attributes["pageCount"] == "1"
    assert "完全相同文件" in (tmp_path / "r.html").read_text()
    assert len(json.loads((tmp_path / "r.json").read_text())["findings"]) == 2
    again = reports.load_json(spark, str(tmp_path / "r.json"))
    assert audit.exact_groups(again.files).count() == 1
    import zipfile

    with zipfile.ZipFile(tmp_path / "r.xlsx") as book:
        assert sum(n.startswith("xl/worksheets/") for n in book.namelist()) == 7


@pytest.mark.parametrize("entry", ["../escape.txt", "/abs.txt", "C:/x.txt", "a\\..\\b"])
def test_unsafe_paths(spark, tmp_path, entry):
    (tmp_path / "a.zip").write_bytes(zip_of([(entry, b"x")]))
    (tmp_path / "b.zip").write_bytes(zip_of([("ok.txt", b"x")]))
    paths = [str(tmp_path / "a.zip"), str(tmp_path / "b.zip")]
    with pytest.raises(Exception, match="unsafe path"):
        archives.read_submissions(spark, paths).count()
    files, bad = archives.quarantined(archives.read_submissions(spark, paths, on_error="quarantine"))
    assert files.count() == 1 and bad.count() == 1


def test_ratio_limit():
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(zip_of([("bomb", b"0" * 10_000_000)]))) as archive, pytest.raises(ValueError, match="too large"):
        parsers.safe_entries(archive)


def test_loose_files(spark, tmp_path):
    (tmp_path / "sample.txt").write_text("一句中文。")
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 broken")
    rows = {r["name"]: r for r in archives.read_submissions(spark, [str(tmp_path / "sample.txt"), str(tmp_path / "x.pdf")], mode="files").collect()}
    assert rows["sample.txt"]["kind"] == "text" and rows["sample.txt"]["supplier"] == "本地文件" and rows["x.pdf"]["parse_error"]


def test_office():
    data = docx("<dc:creator>me</dc:creator><dcterms:created xsi:type='dcterms:W3CDTF'>2020-01-01T00:00:00Z</dcterms:created>", "<Company>ACME</Company><AppVersion>16</AppVersion>", 'x <a href="https://e.org/1">C:\\t\\a</a> 01234567-89ab-cdef-0123-456789abcdef', [("word/media/i.png", b"i"), ("word/vbaProject.bin", b"v")])
    mime, kind, own = parsers.parse_file("a.DOCX", data)
    assert (kind, own.attributes["author"], own.attributes["version"], own.attributes["created"], own.attributes["hasMacros"]) == ("word", "ACME", "16", "2020-01-01T00:00:00Z", "true")
    assert parsers.parse_file("a.docx", data, "core")[2].attributes["author"] == "me"
    assert own.lists["localPaths"] == ["C:\\t\\a"] and "https://e.org/1" in own.lists["externalLinks"] and own.lists["documentIds"] == ["01234567-89ab-cdef-0123-456789abcdef"] and len(own.lists["mediaHashes"]) == 1
    book = zip_of([("xl/workbook.xml", '<workbook><sheets><sheet name="A"/><sheet name="B" state="hidden"/></sheets></workbook>')])
    assert parsers.parse_file("a.xlsx", book)[2].lists["sheets"] == ["A (visible)", "B (hidden)"]


def test_images_and_pdf():
    own = parsers.parse_image(png([(b"tEXt", b"Author\0me"), (b"iTXt", b"Title\0\0\0en\0t\0caf\xc3\xa9")]), "image/png").attributes
    assert (own["dimensions"], own["author"], own["title"]) == ("1 × 1", "me", "café")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x02\x00\x03\x01\x01\x11\x00\xff\xd9"
    assert parsers.parse_image(jpeg, "image/jpeg").attributes["dimensions"] == "3 × 2"
    own = parsers.parse_pdf(pdf())
    assert (own.attributes["creator"], own.attributes["producer"], own.attributes["scannedDocument"], own.attributes["pdfVersion"], own.attributes["pageCount"]) == ("Microsoft Word 2016", "Acrobat Distiller 17.0 (Windows)", "否", "PDF-1.7", "1")
    assert parsers.parse_pdf(pdf(content=b"q /I Do Q", image=True)).attributes["scannedDocument"] == "是"


def test_stream_ingest(spark, tmp_path):
    from quillmark.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.zip").write_bytes(zip_of([("f.txt", b"same")]))
    (tmp_path / "in/b.zip").write_bytes(zip_of([("f.txt", b"same")]))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    (tmp_path / "in/c.zip").write_bytes(zip_of([("g.txt", b"same")]))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    exact, _ = ingest.current_groups(spark, str(tmp_path / "t"))
    assert [(r["n_files"], r["n_suppliers"]) for r in exact.collect()] == [(3, 3)]

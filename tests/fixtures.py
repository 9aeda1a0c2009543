"""Small files made with the standard library."""

import io
import struct
import zipfile
import zlib

CORE = '<?xml version="1.0"?><cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">{}</cp:coreProperties>'
APP = '<?xml version="1.0"?><Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties">{}</Properties>'


def zip_of(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in entries:
            archive.writestr(name, data)
    return out.getvalue()


def docx(core="<dc:creator>old</dc:creator><cp:lastModifiedBy>editor</cp:lastModifiedBy>", app="<Application>WPS</Application><TotalTime>37</TotalTime>", body="hello world text", more=()):
    return zip_of([("docProps/core.xml", CORE.format(core)), ("docProps/app.xml", APP.format(app)), ("word/document.xml", f"<w:document><w:t>{body}</w:t></w:document>"), *more])


def png(texts=()):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 6, 0, 0, 0)) + b"".join(chunk(k, d) for k, d in texts) + chunk(b"IDAT", zlib.compress(b"\0\0\0\0\0")) + chunk(b"IEND", b"")


def pdf(info=b"/Creator (Microsoft Word 2016) /Producer (Acrobat Distiller 17.0 \\(Windows\\))", content=b"BT /F1 12 Tf (Hi) Tj ET", xmp=None, image=False):
    objects = [b"<< /Type /Catalog /Pages 2 0 R" + (b" /Metadata 6 0 R" if xmp else b"") + b" >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>"]
    objects.append(b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << " + (b"/XObject << /I 7 0 R >> " if image else b"") + b">> >>")
    packed = zlib.compress(content)
    objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream")
    objects.append(b"<< " + info + b" >>")
    objects.append(b"<< /Type /Metadata /Subtype /XML /Length %d >>\nstream\n" % len(xmp or b"") + (xmp or b"") + b"\nendstream")
    objects.append(b"<< /Type /XObject /Subtype /Image /Length 1 >>\nstream\nx\nendstream")
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n" % (i + 1) + o + b"\nendobj\n" for i, o in enumerate(objects)) + b"trailer\n<< /Root 1 0 R /Info 5 0 R /Size 8 >>\nstartxref\n0\n%%EOF\n"

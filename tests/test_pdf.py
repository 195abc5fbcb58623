import random
import zlib

from corvex.sources import pdf as P


def test_pdf_files(spark, tmp_path):
    pixels = random.Random(1).randbytes(90 * 90 * 3)
    (tmp_path / "a.pdf").write_bytes(P.write_pdf(["one (two) \\three\nfour é", "", "last"], [(90, 90, pixels), (2, 2, bytes(12))]))
    (tmp_path / "b.txt").write_text("no")
    files = P.read_pdfs(spark, str(tmp_path))
    rows = sorted((r.page_number, r.content, r.word_count) for r in P.pdf_chunks(files).collect())
    assert rows == [(1, "one (two) \\three four é", 5), (3, "last", 1)]
    (image,) = P.pdf_images(files).collect()
    assert (image.page_number, image.image_index, image.width, image.height, image.format) == (1, 0, 90, 90, "png")
    data = bytes(image.data)
    at = data.index(b"IDAT")
    lines = zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")])
    assert b"".join(lines[i * 271 + 1 : (i + 1) * 271] for i in range(90)) == pixels


def test_pdf_operators():
    assert P.show_text(rb"BT [(Hel) -20 (lo) -300 <776f>] TJ T* (a\051\\\101) Tj ET") == "Hello wo\na)\\A\n"
    body = zlib.compress(b"1 0 2 36 " + b"<< /Type /Catalog /Pages 2 0 R >>".ljust(36) + b"<< /Type /Pages /Kids [3 0 R] >>")
    data = b"9 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode >> stream\n" + body + b"\nendstream endobj 3 0 obj << /Type /Page /Contents 4 0 R >> endobj 4 0 obj << >> stream\n(x) Tj\nendstream endobj"
    pdf = P.Pdf(data)
    assert [pdf.text(p) for p in pdf.pages()] == ["x"]
    assert P.Pdf(b"junk").pages() == []


def test_cmyk_and_jpeg():
    data = b"1 0 obj << /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceCMYK >> stream\nabcd\nendstream endobj 2 0 obj << /Subtype /Image /Width 3 /Height 2 /ColorSpace /DeviceRGB /Filter /DCTDecode >> stream\nJPEG\nendstream endobj"
    assert P.Pdf(data).images(b"<< /Resources << /XObject << /A 1 0 R /B 2 0 R >> >> >>") == [(3, 2, "jpeg", b"JPEG")]


CMAP = b"""1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0001> <0041> <0002> <D83DDE00> endbfchar
2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00660066> <4E2D>] endbfrange"""


def stream(head: bytes, body: bytes) -> bytes:
    return b"<< %s /Length %d >> stream\n" % (head, len(body)) + body + b"\nendstream"


def test_composite_fonts_and_forms():
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Resources 5 0 R >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>",
        stream(b"", b"BT /F1 12 Tf <00010010001100120020> Tj T* [<0021> -300 <0002>] TJ /F2 9.5 Tf (plain \xe9) Tj ET /X1 Do"),
        b"<< /Font << /F1 6 0 R /F2 8 0 R >> /XObject << /X1 9 0 R >> >>", b"<< /Subtype /Type0 /Encoding /Identity-H /ToUnicode 7 0 R >>", stream(b"", CMAP), b"<< /Subtype /Type1 >>",
        stream(b"/Subtype /Form /Resources << /Font << /G 6 0 R >> /XObject << /X1 9 0 R >> >>", b"BT /G 8 Tf <0001> Tj ET /X1 Do"),
    ]
    pdf = P.Pdf(b"".join(b"%d 0 obj " % (i + 1) + o + b" endobj\n" for i, o in enumerate(objects)))
    assert [pdf.text(p) for p in pdf.pages()] == ["Aabcff\n中 😀plain é\nA\n"]

"""PDF text and tags, on files made here."""

import zlib

from pyspark.sql import functions as F

from quire.functions import content as B
from quire.functions import pdf

CMAP = b"""1 begincodespacerange <0000> <FFFF> endcodespacerange
1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0012> <0430> <0020> <0021> [<0416> <00660069>] endbfrange"""


def stream(body: bytes, head: bytes = b"", flate: bool = True) -> bytes:
    body = zlib.compress(body) if flate else body
    return b"<< /Length %d %s%s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode " if flate else b"", head, body)


def made(packed: bool = False, more: bytes = b"") -> bytes:
    pages = [b"BT /F1 12 Tf 10 10 Td (Old \\(text\\)) Tj T* [(spli) 20 (t) -300 (words\\041)] TJ ET", b"BT /F2 9 Tf <00100011001200030020> Tj <0021> Tj ET"]
    info = b"<< /Title <FEFF0416> /Author (J. \\304 (Doe)\\\n Jr) /Subject 11 0 R >>"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 2 0 R 4 0 R] /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R] >>",
        4: b"<< /Type /Page /Contents 6 0 R >>",
        5: stream(pages[0], flate=False),
        6: stream(pages[1]),
        7: b"<< /Type /Font /Subtype /Type1 >>",
        8: b"<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>",
        9: stream(CMAP),
        11: b"(History)",
    }
    if packed:
        objects[12] = stream(b"10 0 " + info, b"/Type /ObjStm /N 1 /First 5 ")
    else:
        objects[10] = info
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items())
    return b"%PDF-1.5\n" + body + b"trailer << /Root 1 0 R /Info 10 0 R " + more + b">>\n%%EOF"


def test_text_of_the_first_page_and_of_all():
    first = B.text_of(made(), ".pdf", 1800)
    assert first == "Old (text) split words!"
    assert B.text_of(made(), ".pdf", 1800, whole=True) == first + " абв Жfi"
    assert B.text_of(made(), ".pdf", 5, whole=True) == "Old ("


def test_tags_plain_and_in_an_object_stream():
    want = {"title": "Ж", "author": "J. Ä (Doe) Jr", "genre": "History"}
    assert B.tags_of(made(), ".pdf") == B.tags_of(made(packed=True), ".pdf") == want


def test_unreadable_files_are_empty():
    none = {"title": "", "author": "", "genre": ""}
    bad = [b"%PDF-1.7", b"", made(more=b"/Encrypt 5 0 R "), made().replace(b"/Kids [", b"/Kids ((("), made()[:300], b"1 0 obj << /A " * 200, b"%PDF /Root 1 0 R 1 0 obj 1 0 R endobj"]
    for raw in bad[:3] + bad[4:]:
        assert B.text_of(raw, ".pdf", 100) == ""
    for raw in bad[:3]:
        assert B.tags_of(raw, ".pdf") == none
    assert list(pdf.items(b"1 " + b"%" * 5000)) == [(1, 1)]  # comments are passed over once
    for cut in range(0, len(made(True)), 7):  # never an exception
        pdf.text(made(True)[:cut], 100, True), pdf.tags(made(True)[:cut])


def test_columns(spark):
    df = spark.createDataFrame([("a.pdf", made()), ("b.PDF", b"junk"), ("c.pdf", None)], "path string, raw binary")
    got = df.select("path", B.snippet(F.col("raw"), F.col("path")).alias("s"), B.tags(F.col("raw"), F.col("path"))["author"].alias("a")).collect()
    assert {r["path"]: (r["s"], r["a"]) for r in got} == {"a.pdf": ("Old (text) split words!", "J. Ä (Doe) Jr"), "b.PDF": ("", ""), "c.pdf": ("", "")}

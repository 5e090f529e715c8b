import pytest
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import content as B
from quire.functions import genre as G
from quire.functions import isbn as I
from quire.functions import payload as P
from quire.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def each(spark, f, inputs):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r["y"] for r in rows.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_constant_counts():
    sizes = {"ARCHIVE_EXTENSIONS": 14, "BOOK_EXTENSIONS": 27, "BOOK_FILETYPE_MIMES": 14, "BOOK_FILETYPE_EXTENSIONS": 12, "BOOK_ZIP_CONTAINER_EXTENSIONS": 7, "ARCHIVE_FILETYPE_MIMES": 8, "STRONG_NONBOOK_EXTENSIONS": 77, "TEXT_EXTENSIONS": 10, "BOOK_CONTENT_TOKENS": 18, "GENRES": 29, "GENRE_RULES": 28}
    assert {k: len(getattr(C, k)) for k in sizes} == sizes
    assert sum(len(keys) for _, keys in C.GENRE_RULES) == 234
    assert {g for g, _ in C.GENRE_RULES} | {"Unknown"} == set(C.GENRES) and {g for g, _ in C.PATH_GENRES} <= set(C.GENRES)


def test_clean(spark):
    got = each(spark, T.clean, ["  <b>a</b>\n\tb ", None, "x  y​﻿", "<>a<b", "a\u001cb", ""])
    assert got == ["a b", "", "x y", "<>a<b", "a b", ""]
    assert each(spark, T.clean, got) == got


@pytest.mark.parametrize(
    "raw,want",
    [("sf_action", "Фантастика"), ("Science", "Наука"), ("computer science", "Программирование и IT"), ("Учебная литература", "Образование"), ("party games", "Искусство и дизайн"), ("Домашняя кухня", "Дом, хобби и ремесла"), ("roman history", "История"), ("war stories", "Военное дело"), ("warm", "Unknown"), ("ISBN 123", "Unknown"), ("12345", "Unknown"), ("", "Unknown"), (None, "Unknown"), ("Quantum", "Unknown"), ("ECONOMY", "Экономика и бизнес"), ("a" * 65, "Unknown"), ("спорт", "Спорт")],
)
def test_genre(spark, raw, want):
    assert value(spark, G.normalize(F.lit(raw).cast("string"))) == want


def test_genre_idempotent_and_translated(spark):
    assert each(spark, G.normalize, list(C.GENRES)) == list(C.GENRES)
    assert each(spark, lambda x: G.translated(x, "en-US"), list(C.GENRES)) == list(C.GENRES.values())
    assert G.output_language("auto", "en") == "en" and G.output_language("de") == "ru"


def test_genre_from_path(spark):
    got = each(spark, G.from_path, ["/lib/Science Fiction/a.txt", "/lib/Учебная литература/a.txt", "/lib/Lawrence/a.txt", "/lib/misc/x.txt"])
    assert got == ["Фантастика", "Образование", "Политика и право", ""]


def test_parse_filename(spark):
    stems = ["Frank Herbert - Dune", "Dune (Frank Herbert)", "Herbert. Dune", "Sci-Fi Stories", "A – B – C", "Ivanov_Petr_Kniga", ""]
    got = [(r["author"], r["title"]) for r in each(spark, T.parse_filename, stems)]
    assert got == [("Frank Herbert", "Dune"), ("Frank Herbert", "Dune"), ("Herbert", "Dune"), ("Sci", "Fi Stories"), ("A", "B – C"), ("", "Ivanov Petr Kniga"), ("", "")]


def test_shapes_and_values(spark):
    assert each(spark, T.looks_like_book_stem, ["Ivanov_Petr_Kniga", "ivanov_petr_kniga", "Ivanov_Petr", "Ivanov-Petr_A_Bc_De"]) == [True, False, False, False]
    assert each(spark, T.is_garbage, ["1984", "It", "12-34", "665224", "2_530", "12-345", "Unknown", "неизвестно", "A", None]) == [False] * 3 + [True] * 7
    assert each(spark, T.first_letter, ["толстой", "_x", "9 lives", "", ' "q']) == ["Т", "#", "9", "#", "#"]
    safe = each(spark, T.sanitize, ["a/b:c?", "  ..x.. ", "<b>Title</b>", "", "...", "y" * 99])
    assert safe == ["a_b_c_", "x", "Title", "Unknown", "Unknown", "y" * 90]
    assert each(spark, T.sanitize, safe) == safe
    assert each(spark, lambda x: T.in_script(x, "ru"), ["Глава", "ab", "Chapter", ""]) == [True, True, False, True]


def test_paths(spark):
    paths = ["/a/b.c/Book.Name.TXT", ".hidden", "/x/noext", "/a/.b.txt"]
    assert each(spark, T.suffix_of, paths) == [".txt", "", "", ".txt"]
    assert each(spark, T.stem_of, paths) == ["Book.Name", ".hidden", "noext", ".b"]
    assert value(spark, T.relative(F.lit("/a/b/c"), F.lit("/a"))) == "b/c"
    assert value(spark, T.relative(F.lit("/z/c"), F.lit("/a"))) == "c"
    chain = F.array(*map(F.lit, ["a.zip", "b.zip", "c.zip", "d.zip"]))
    assert value(spark, T.nobook_path("/nb", F.lit("/s/x.bin"), F.lit("/s"), chain, True)) == "/nb/FromArchives/b.zip__c.zip__d.zip/x.bin"
    assert value(spark, T.duration_hms(F.lit(3725))) == "01:02:05" and value(spark, T.duration_hms(F.lit(None).cast("int"))) == "--:--:--"


def test_title_without_author(spark):
    rows = [("Дилья Эникиева Счастье есть", "Дилья Эникиева", "Счастье есть"), ("Эникиева Дилья. Счастье", "Дилья Эникиева", "Счастье"), ("Тайна рода.294160", "", "Тайна рода"), ("Dune", "Unknown Author", "Dune"), ("294160", "X Y", "294160")]
    df = spark.createDataFrame(rows, "t string, a string, want string")
    assert all(r["x"] == r["want"] for r in df.select("want", T.clean_book_title(F.col("t"), F.col("a")).alias("x")).collect())


def test_isbn(spark):
    got = each(spark, I.extract, ["ISBN 978-0-306-40615-7", "ISBN: 0-8044-2957-x", "9780306406158", "call 4785380592391140", "a 0306406152 b 9780306406157", None])
    assert got == [["9780306406157"], ["080442957X"], [], [], ["0306406152", "9780306406157"], []]


@pytest.mark.parametrize("codec", ["utf-8", "utf-8-sig", "utf-16", "cp1251"])
def test_decode(spark, codec):
    text = "Глава первая, в которой всё начинается"
    raw = spark.createDataFrame([(text.encode(codec),)], "b binary")
    assert raw.select(B.smart_decode("b").alias("x")).first()["x"] == text
    declared = '<?xml version="1.0" encoding="windows-1251"?><p>Ёж</p>'
    assert B.decode(declared.encode("cp1251")) == declared
    assert B.decode(b"") == B.decode(None) == ""
    # the first guess with the most Cyrillic letters wins, so KOI8-R reads as the code page before it
    assert B.decode("Глава".encode("koi8-r")) == "зМБЧБ"


def test_binary_and_magic(spark):
    assert [B.binary_like(x) for x in (b"", None, b"plain", b"a\0b", b"\x80" * 50, "да".encode("utf-16"))] == [False, False, False, True, True, False]
    raw = spark.createDataFrame([(b"%PDF-1.7",), (b"\xef\xbb\xbf<?xml ",), (b"<?xml",), (bytes.fromhex("D0CF11E0A1B11AE1"),), (b"no",), (None,)], "b binary")
    assert [r["m"] for r in raw.select(B.magic(F.col("b")).alias("m")).collect()] == ["pdf", "xml_utf8bom", "xml", "ole_doc", "", ""]


def test_payloads():
    assert P.parse('{"title": "Dune", "confidence": "4"}') == {"title": "Dune", "confidence": 4.0}
    assert P.parse("```json\n{'title': 'Dune', 'genre': 'sf',}\n```") == {"title": "Dune", "genre": "sf"}
    assert P.parse('text {"results": [{"title": "A {b}", "genre_analysis": {"primary_genre": "x", "subgenres": ["y", ""], "confidence_score": 3}}]} end') == {"title": "A {b}", "genre": "x", "subgenres": ["y"], "confidence": 3.0}
    assert P.parse("Название: Дюна\nавтор - Герберт\nconfidence: 3.5") == {"title": "Дюна", "author": "Герберт", "confidence": 3.5}
    assert P.parse("nothing here") is None and P.parse("") is None and P.parse(None) is None


def test_payload_columns(spark):
    rows = spark.createDataFrame([('{"title": "Dune", "genre": "sf", "confidence": 4}',), ("x",), (None,)], "t string")
    got = [r.asDict() for r in rows.select(P.parse_payload(F.col("t")).alias("p")).select("p.*").collect()]
    assert got[0]["title"] == "Dune" and got[0]["confidence"] == 4.0 and got[1]["title"] is None and got[2]["genre"] is None


def test_whole_contents_come_in_few_rows(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    try:
        rows = spark.range(0, 3000, 1, 1).select(F.col("id").cast("string").cast("binary").alias("b"))
        assert rows.select(B.smart_decode("b").alias("x")).agg(F.sum(F.col("x").cast("long"))).first()[0] == 2999 * 1500
        assert int(spark.conf.get(key)) < 1000
        spark.conf.set(key, "77")
        B.xxh64(F.col("b"))
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.unset(key)

from samples import W, archive, docx, pptx, xlsx

from docquarry.sources.extract import EXTRACTORS, extract, paragraphs, with_bodies

KOREAN = "도서관 휴관 안내"


def body(ext, content):
    return extract(ext, content)


def test_txt():
    for content in (KOREAN.encode(), b"\xef\xbb\xbf" + KOREAN.encode(), KOREAN.encode("euc-kr"), KOREAN.encode("utf-16")):
        assert body("TXT", content) == (KOREAN, None)


def test_office_files():
    assert body("docx", docx(("도서관", " 휴관"), ("안내",), ())) == ("도서관 휴관\n안내\n", None)
    assert body("xlsx", xlsx([["도서관", "휴관"], [], ["안내"]])) == ("도서관 휴관\n안내\n", None)
    slides = {n: f"쪽 {n}" for n in range(1, 12)}
    assert body("pptx", pptx(slides)) == ("".join(f"쪽 {n}\n" for n in range(1, 12)), None)


def test_workbooks():
    """Sheets as the workbook lists them, readings left out, numbers as numbers."""
    sheet = lambda *cells: "<worksheet><sheetData><row>" + "".join(cells) + "</row></sheetData></worksheet>"
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"
    book = archive(**{
        "xl/workbook.xml": f'<workbook {r}><sheets><sheet name="b" sheetId="7" r:id="r2"/><sheet name="a" sheetId="3" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships><Relationship Id="r1" Type="{kind}" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{kind}" Target="/xl/worksheets/extra.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>図書</t><rPh><t>トショ</t></rPh></si></sst>",
        "xl/worksheets/sheet1.xml": sheet('<c t="s"><v>0</v></c>', "<c><v>1.10</v></c>", "<c><v>1E3</v></c>", "<c><v>-2.50E-2</v></c>", "<c><v>7.0</v></c>"),
        "xl/worksheets/extra.xml": sheet('<c t="b"><v>1</v></c>', '<c t="str"><v>last</v></c>'),
    })
    assert body("xlsx", book) == ("true last\n図書 1.1 1000 -0.025 7\n", None)


def test_oddities():
    assert paragraphs(f"<w:d {W}><w:p><w:t>a &amp; b</w:t></w:p><w:p><w:t>cut".encode()) == "a & b\ncut\n"
    assert body("docx", archive(other="x"))[1].startswith("parse") and body("docx", b"no zip")[1].startswith("parse")
    assert body("pdf", b"%PDF-broken")[1].startswith("parse") and body("exe", b"")[1] == "unsupported" and body("txt", None)[1].startswith("io")
    assert extract("x", b"1", {**EXTRACTORS, "x": lambda c: "own"}) == ("own", None)


def test_in_a_plan(spark):
    rows = spark.createDataFrame([("a", "txt", bytearray(b"one")), ("b", "docx", bytearray(b"bad")), ("c", "txt", None)], "path string, extension string, content binary")
    found = {r["path"]: (r["body"], r["error"]) for r in with_bodies(rows).collect()}
    assert found["a"] == ("one", None) and found["b"][0] is None and found["c"][1].startswith("io")

import io
import zipfile

from docloom.sources import office, readers


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


W = '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>1.1 Lamps</w:t></w:r></w:p><w:p><w:r><w:t>a </w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x&lt;y</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl></w:body></w:document>'
S = '<worksheet xmlns="s"><sheetData><row><c t="s"><v>0</v></c><c><v>2</v></c></row></sheetData></worksheet>'
P = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>Head</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>Point</a:t></a:r></a:p></p:sp></p:sld>'


def test_word_sheet_slide_book_xml():
    assert office.word_items(archive(word__document_dot_xml=W)) == [
        ("title", 2, "1.1 Lamps", ""), ("paragraph", None, "a b", ""), ("list", None, "item", ""), ("table", None, "", "<table><tr><td>x&lt;y</td><td></td></tr></table>"),
    ]
    sheet = archive(xl__workbook_dot_xml='<workbook><sheets><sheet name="One"/></sheets></workbook>', xl__sharedStrings_dot_xml="<sst><si><t>k</t></si></sst>", xl__worksheets__sheet1_dot_xml=S)
    assert office.sheet_items(sheet) == [("title", 1, "One", ""), ("table", None, "", "<table><tr><td>k</td><td>2</td></tr></table>")]
    assert office.slide_items(archive(ppt__slides__slide1_dot_xml=P)) == [("title", 1, "Head", ""), ("paragraph", None, "Point", "")]
    package = '<package><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'
    book = {"META-INF__container_dot_xml": '<container><rootfile full-path="o/p.opf"/></container>', "o__p_dot_opf": package, "o__a_dot_xhtml": "<h1>A</h1>", "o__b_dot_xhtml": "<p>b</p>"}
    assert [(k, t) for k, _, t, _ in office.book_items(archive(**book))] == [("title", "A"), ("paragraph", "b")]
    assert office.xml_items(b"<r><title>T</title><p>  x  y </p><v key='k'>1</v><e/></r>") == [("title", 1, "T", ""), ("paragraph", None, "x y", ""), ("paragraph", None, "k: 1", "")]


def test_a_second_parser_takes_over(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(archive(word__document_dot_xml=W))
    (tmp_path / "b.docx").write_bytes(b"no archive")
    got = readers.parse_documents(spark, str(tmp_path), {".docx": [office.word_items, lambda b: [("paragraph", None, "second", "")]]}).collect()
    assert [r.type for r in got if r.doc_id.endswith("a.docx")] == ["title", "paragraph", "list", "table"]
    (other,) = [r for r in got if r.doc_id.endswith("b.docx")]
    assert other.text == "second" and "BadZipFile" in other.warnings[0]

from __future__ import annotations

import io
import json
import tarfile
import time
import zipfile
import zlib

import numpy as np
import pytest

from folio.operators.archive import Budget, tar_members, zip_members
from folio.operators import archive, isolate
from folio.operators.extract import common, data, dispatch, markup, office, page, rich
from folio.operators.isolate import extract_isolated
from folio.operators.pack import pack_df, with_unique_ids
from folio.options import Options


def make_zip(members: dict[str, bytes | str], method: int = zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for n, b in members.items():
            z.writestr(n, b)
    return out.getvalue()


def test_strip_tags_by_rule():
    page = "<table><tr><td>quince</td><td>12 kg</td></tr><tr><th>plum</th> <th>7 kg</th></tr></table>"
    assert markup.strip_tags(page) == "quince | 12 kg\nplum | 7 kg"
    page = "<title>Gate &#8211; north</title><style>b {}</style><p>a &lt; b &nope; c&nbsp;d<script>'</p> </scripted>'</script><!-- <p>gone --><ul><li>one<li>two</ul>end"
    assert markup.strip_tags(page) == "Gate – north\n\na < b &nope; c d\none\ntwo\nend"
    assert markup.strip_tags("") == ""


def test_strip_tags_is_linear():
    began = time.time()
    markup.strip_tags("&" * (1 << 20))
    markup.strip_tags("<a " * 100_000)
    markup.strip_tags("<!--" * 100_000)
    assert time.time() - began < 10


LAID_OUT = [
    ("<h2>Trees</h2><p>See <a href='/q?a=1&amp;b=2'>the <em>list</em></a> <code>x</code>.", "## Trees\n\nSee [the *list*][1] `x`.\n\n[1]: /q?a=1&b=2\n"),
    ("<ul><li>one<li>two<ol><li>a<li>b</ol></ul>", "* one\n* two\n\n  1. a\n  2. b\n"),
    ("<table><tr><td>1<td>2<tr><td colspan=2>both</table>", "─┬──\n1│2\n─┴──\nboth\n────\n"),
    ("<blockquote><p>q<p>r</blockquote><pre> a\n  b</pre>", "> q\n>\n> r\n\n a\n  b\n"),
    ("<p><b>x<p>y</b> z", "**x**\n\n**y** z\n"),
    ("<head><title>no</title></head><body>a<br>b<hr><img alt='pic'><script>1</script></body>", "a\nb[pic]\n"),
    ("<dl><dt>k<dd>v</dl>", "*k*\n  v\n"),
    ("<table><tr><td>1</table>after<p>x", "─\n1\n─\n\nafter\n\nx\n"),
    ("a < b &amp; c", "a < b & c\n"), ("", ""),
]


@pytest.mark.parametrize(("source", "text"), LAID_OUT)
def test_pages_are_laid_out(source, text):
    assert page.render(source) == text


def test_wrapping_and_limits():
    lines = page.render("<p>" + "word " * 60).split("\n")
    assert max(map(len, lines)) <= 100 and len(lines[0]) > 90
    assert page.render("<p>" + "漢" * 120).split("\n")[0] == "漢" * 50
    for deep in ("<div>" * 400 + "deep &amp; text", "<p><b>" * 3000 + "t", "<div>" + "".join(f"<b id={k}>" for k in range(16)) + "</div>" + "<p>t</p>" * 500):
        with pytest.raises(page.TooDeep):
            page.render(deep)
    assert markup.html_text(b"<div>" * 400 + b"deep &amp; text") == "deep & text"
    assert markup.html_text("<p>Caf&eacute; <b>x</b>".encode("utf-16")) == "Café **x**\n"
    began = time.time()
    for odd in ("<a href=x " * 50_000, "<!--" * 50_000, '<a b="' * 50_000, "<p>x" * 10_000, "&" * 500_000):
        page.render(odd) if len(odd) > 3 else None
    assert time.time() - began < 20


def test_legacy_pages_are_guessed_alike_everywhere():
    for text, name in (("Größe und Länge, très café déjà", "cp1252"), ("Файл закрывает ошибка и узел после проверки", "cp1251"), ("Каталог читает буфер и курсор", "koi8_r"), ("記録の更新を確認してから検査を行う", "shift_jis"), ("記録の更新を確認してから検査を行う", "euc_jp"), ("如果文件过大则先拆分再处理", "gb18030")):
        assert common.decode(text.encode(name)) == text, name


def test_list_markers_come_as_words():
    rtf = rb"{\rtf1\ansi{\fonttbl{\f0\fcharset0 A;}{\f1\fcharset2 Symbol;}}\f0 Pick:\par {\listtext\f0 1.\tab}early plums\par {\listtext\f1\'b7\tab}\f0 late plums\par {\pntext\f0 b)\tab}{\*\pn x}\f0 pears\par}"
    assert rich.rtf_text(rtf) == "Pick:\n1. early plums\n• late plums\nb) pears"


def test_raw_bytes_and_long_streams():
    assert rich.rtf_text(b"{\\rtf1 a\\bin5 {}}\\xb\\par}") == "ab"
    big = zlib.compress(b" " * ((32 << 20) + 9))
    with pytest.raises(common.Unreadable):
        rich.pdf_text(b"%PDF-1.4\n1 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + big + b"\nendstream\nendobj\n")


def test_pdf_pages_come_in_their_order():
    def text(n: int, s: bytes, filters: bytes = b"") -> bytes:
        return b"%d 0 obj\n<< %s >>\nstream\n%s\nendstream\nendobj\n" % (n, filters, s)

    body = b"BT (%s) Tj ET"
    pdf = b"%PDF-1.4\n" + text(4, body % b"second") + text(5, (body % b"first").hex().encode() + b">", b"/Filter [/ASCIIHexDecode]")
    pdf += b"1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [7 0 R 6 0 R] >>\nendobj\n6 0 obj\n<< /Type /Page /Contents 4 0 R >>\nendobj\n7 0 obj\n<< /Type /Page /Contents [5 0 R] >>\nendobj\n"
    assert rich.pdf_text(pdf) == "first\n\nsecond"


def test_repeats_in_open_sheets():
    cell = "<t:table-cell t:number-columns-repeated='{}'>{}</t:table-cell>"
    row = "<t:table-row t:number-rows-repeated='{}'>{}</t:table-row>"
    rows = row.format(1, cell.format(1, "a") + cell.format(2, "b") + cell.format(16000, "")) + row.format(1, cell.format(9, "")) + row.format(2, cell.format(1, "c")) + row.format(1_000_000, cell.format(16000, ""))
    doc = f"<o xmlns:t='t'><t:table t:name='S'>{rows}</t:table></o>"
    assert office.sheet_text(make_zip({"content.xml": doc})) == "## S\n| a | b | b |\n| --- | --- | --- |\n|  |  |  |\n| c |  |  |\n| c |  |  |"


def test_a_broken_archive_keeps_what_was_read(spark, monkeypatch):
    from folio.operators import pack

    def broken(*_):
        yield archive.Member("a.txt", "file", 1, b"1")
        raise ValueError("broken")

    monkeypatch.setattr(pack, "members", broken)
    rows = pack.Packer(Options(follow_archives=True)).pack("z", "z.zip", b"PK")
    assert [(r[0], r[4], r[8]) for r in rows] == [("z!z.zip/a.txt", "1", True)]


def test_isolation_ends_floods_and_hangs(monkeypatch):
    monkeypatch.setattr(isolate, "MAX_STDOUT", 50)
    assert isolate.extract_isolated(b"{\\rtf1 " + b"long text " * 50 + b"}", "rtf").detail == "text is over 50 bytes"
    assert isolate.extract_isolated(b"x", "rtf", timeout_s=0).detail.startswith("timed out")


def test_json_keeps_tokens():
    assert data.json_text(b'{"a": 1.10, "b":[1e400,{}], "a":"x"}') == '{\n  "a": 1.10,\n  "b": [\n    1e400,\n    {}\n  ],\n  "a": "x"\n}'
    assert data.json_text(b"[NaN]") == "[NaN]"
    assert data.json_text(b'{"a":1}\n\n{"b":2}\n') == '{\n  "a": 1\n}\n{\n  "b": 2\n}'
    assert data.json_text(b"[" * 200 + b"]" * 200) == "[" * 200 + "]" * 200


def test_tables():
    assert data.table_text(b"tree,kg,row\nquince,12,4\n") == "| tree | kg | row |\n| --- | --- | --- |\n| quince | 12 | 4 |\n"
    assert data.table_text(b"a,b\n1\n") == "a,b\n1\n"
    assert data.table_text(b"") == ""
    assert data.table_text(b"a|b\n\"x\ny\"\n") == "| a\\|b |\n| --- |\n| x y |\n"


def test_notebook():
    book = {"cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "1", "outputs": [{"text": "out"}, {"data": {"text/plain": ["p"]}}]}]}
    raw = json.dumps(book).encode()
    assert data.notebook_text(raw) == "## Cell 0 (markdown)\n# T\nx\n\n## Cell 1 (code)\n1\n"
    assert data.notebook_text(raw, True).endswith("1\nout\np\n")
    with pytest.raises(common.Unreadable):
        data.notebook_text(b"{}")


def test_arrays():
    def npy(a):
        out = io.BytesIO()
        np.save(out, a)
        return out.getvalue()

    assert data.npy_text(npy(np.array([[1.5, 2], [3, 4]], "<f4"))) == "format: npy\ndescr: <f4\nfortran_order: false\nshape: (2, 2)\nelements: 4\npreview: [[1.5, 2.0], [3.0, 4.0]]"
    assert data.npy_text(npy(np.asfortranarray(np.arange(6, dtype="<i8").reshape(2, 3)))).endswith("preview: [[0, 1, 2], [3, 4, 5]]")
    assert data.npy_text(npy(np.zeros(10_000))).endswith("preview: omitted (too large or unsupported dtype)")
    z = make_zip({"b.npy": npy(np.array([1], "u1")), "a.txt": "x", "../e.npy": b"", "c.npy": b"junk"})
    text = data.npz_text(z)
    assert text.startswith("[skipped non-npy entry a.txt, 1 bytes]\n\n## b.npy\n") and "[unreadable npy:" in text and "e.npy" not in text


def test_office():
    doc = "<w:document xmlns:w='w'><w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>Hi</w:t><w:tab/><w:t>x&amp;y</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:document>"
    assert office.docx_text(make_zip({"word/document.xml": doc})) == "Hi\tx&y\ntwo"
    slide = "<p:sld xmlns:p='p' xmlns:a='a'><a:p><a:t>{}</a:t></a:p></p:sld>"
    assert office.pptx_text(make_zip({"ppt/slides/slide10.xml": slide.format("ten"), "ppt/slides/slide2.xml": slide.format("two")})) == "## Slide 2\ntwo\n\n## Slide 10\nten"
    odt = "<o xmlns:t='t'><t:h>Head</t:h><t:p>a<t:s t:c='3'/>b<t:tab/>c</t:p></o>"
    assert office.opendocument_text(make_zip({"content.xml": odt})) == "Head\na   b\tc"
    x = {
        "xl/workbook.xml": "<workbook xmlns:r='r'><sheets><sheet name='S' r:id='r1'/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships><Relationship Id='r1' Target='worksheets/sheet1.xml'/></Relationships>",
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><t>n</t></si></sst>",
        "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row r='1'><c r='A1' t='s'><v>0</v></c><c r='B1' t='s'><v>1</v></c></row><row r='2'><c r='B2'><v>5</v></c></row></sheetData></worksheet>",
    }
    assert office.sheet_text(make_zip(x)) == "## S\n| name | n |\n| --- | --- |\n|  | 5 |"
    epub = {
        "META-INF/container.xml": "<container><rootfiles><rootfile full-path='OEBPS/c.opf'/></rootfiles></container>",
        "OEBPS/c.opf": "<package><manifest><item id='b' href='b.xhtml'/><item id='a' href='a.xhtml'/></manifest><spine><itemref idref='b'/><itemref idref='a'/></spine></package>",
        "OEBPS/a.xhtml": "<p>A</p>",
        "OEBPS/b.xhtml": "<p>B</p>",
    }
    assert office.epub_text(make_zip(epub)) == "# OEBPS/b.xhtml\nB\n\n# OEBPS/a.xhtml\nA"
    with pytest.raises(common.Unreadable):
        office.docx_text(b"PK\x03\x04broken")


def test_rtf_and_pdf():
    rtf = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0\fcharset204 X;}}{\*\generator no;}caf\'e9 \u8364?\par a\cell b\row note{\footnote foot}\par}"
    assert rich.rtf_text(rtf) == "café €\na\tb\nnote[1]\n\n[1] foot"
    assert rich.rtf_text(b"plain") == "plain"
    began = time.time()
    rich.rtf_text(b"{\\rtf1 " + b"word \\par " * 300_000 + b"}")
    assert time.time() - began < 20
    pdf = b"%PDF-1.4\n1 0 obj\n<< /Length 44 >>\nstream\nBT /F1 12 Tf (Hello \\(x\\)) Tj 0 -14 Td [(Wor) -20 (ld) -300 (again)] TJ ET\nendstream\nendobj\n"
    assert rich.pdf_text(pdf) == "Hello (x)\nWorld again"


def test_encodings():
    for name in ("utf-8-sig", "utf-16", "utf-32"):
        assert common.decode("héllo".encode(name)) == "héllo"
    assert common.decode("hello world text".encode("utf-16-le")) == "hello world text"
    assert not common.looks_binary("wide text of some length".encode("utf-16-le"))
    assert common.looks_binary(bytes(range(256)) * 20)
    assert common.decode(b"") == ""


def test_misnamed_and_contained():
    got = dispatch.extract(b"<html><title>Login &amp; go</title><p>x</p>", "pdf")
    assert got.text == '[not a PDF: it holds an HTML page ("Login & go")]\nx\n'
    assert dispatch.extract(b"", "epub").text == "[not an EPUB: the file is empty]"
    assert dispatch.extract(b"\x89PNG\r\n\x1a\n" + bytes(50), "docx") == dispatch.Extracted("unreadable", None, "not a Word document: it holds a PNG image")
    assert dispatch.extract(b"PK\x03\x04junk", "docx").status == "unreadable"
    assert dispatch.extract(bytes(100), "text").status == "skipped_binary"
    assert dispatch.extract(b"<a", "html", source_mode=True).text == "<a"


def test_isolated_equals_in_process():
    raw = b"{\\rtf1 hello\\par}"
    assert extract_isolated(raw, "rtf") == dispatch.extract(raw, "rtf")


def test_archives():
    b = Budget(copied=10)
    z = make_zip({"a": "12345678", "b": "123456", "c": "12", "../x": "no", "d/": ""})
    assert [(m.name, m.tag) for m in zip_members(z, 100, b)] == [("a", "file"), ("c", "file")] and b.cut
    assert [(m.name, m.tag) for m in zip_members(z, 4, Budget())] == [("a", "too_large"), ("b", "too_large"), ("c", "file")]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for n in ("x", "x", "/abs"):
            i = tarfile.TarInfo(n)
            i.size = 3
            t.addfile(i, io.BytesIO(b"abc"))
    assert [m.name for m in tar_members(out.getvalue(), 100, Budget(), gz=True)] == ["x", "x"]
    with tarfile.open(fileobj=(plain := io.BytesIO()), mode="w") as t:
        for n in ("p", "q"):
            i = tarfile.TarInfo(n)
            i.size = 2000
            t.addfile(i, io.BytesIO(b"z" * 2000))
    cut = Budget()
    assert [m.name for m in tar_members(plain.getvalue()[:3500], 10_000, cut)] == ["p"] and cut.cut


def test_pack_expands_nested_archives_to_depth_three(spark):
    inner = make_zip({"leaf.txt": "deep"})
    for k in range(4):
        inner = make_zip({f"n{k}.zip": inner, f"t{k}.txt": f"level {k}"})
    files = spark.createDataFrame([("z", "z.zip", bytearray(inner), 1), ("a", "a.csv", bytearray(b"x,y\n1,2\n"), 2), ("n", "n.txt", None, 3), ("b", "b.bin", bytearray(b"\x00" * 9), 4)], "id string, relative string, bytes binary, extra int")
    rows = {r["id"]: r for r in pack_df(files, Options(follow_archives=True)).collect()}
    assert rows["a"]["text"].startswith("| x | y |")
    assert rows["n"]["status"] == "changed"
    assert "b" not in rows  # *.bin is left out by default
    assert rows["z!z.zip/t3.txt"]["text"] == "level 3"
    assert sum(r["status"] == "skipped_archive" for r in rows.values()) == 1
    kept = {r["id"]: r for r in pack_df(files, Options()).collect()}
    assert kept["z"]["status"] == "skipped_archive" and "pass --archives" in kept["z"]["text"]
    assert pack_df(files.where("false"), Options()).count() == 0
    assert [r["id"] for r in pack_df(files, Options(selection=("a.csv",))).collect()] == ["a"]
    assert pack_df(files, Options(selection=())).count() == 0


def test_repeated_ids_get_numbers(spark):
    rows = [("a", "b.txt", bytearray(b"2")), ("a", "a.txt", bytearray(b"1")), ("a", "b.txt", bytearray(b"3")), ("c", "c.txt", bytearray(b"4")), (None, "n.txt", bytearray(b"5")), (None, "n.txt", bytearray(b"6"))]
    files = spark.createDataFrame(rows, "id string, relative string, bytes binary")
    got = {(r["id"], r["text"]) for r in pack_df(with_unique_ids(files), Options()).collect()}
    assert {i for i, _ in got} == {"a", "a#2", "a#3", "c", None} and ("a", "1") in got and len(got) == 6
    assert with_unique_ids(files.where("id = 'c'")).collect() == files.where("id = 'c'").collect()


def test_pack_budget_is_a_prefix_of_the_path_order(spark):
    files = spark.createDataFrame([(f"{k}", n, bytearray(b"x" * 40)) for k, n in enumerate(("a-c.txt", "a/b.txt", "a.txt", "B.txt", "a/a/z.txt"))], "id string, relative string, bytes binary")
    kept = lambda **o: [r["relative"] for r in pack_df(files, Options(**o)).orderBy("relative").collect()]
    assert kept(max_total_bytes=100) == ["B.txt", "a/a/z.txt"]
    assert kept(max_entries=3) == ["B.txt", "a/a/z.txt", "a/b.txt"]
    assert kept(max_total_bytes=10) == []
    assert len(kept()) == 5

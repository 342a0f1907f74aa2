"""Readers of every format, on inputs built with the standard library."""

from __future__ import annotations

import io
import json
import zipfile
from email.message import EmailMessage

import pytest

from quirespark.operators.chain import Converter, Registry, Source, load
from quirespark.operators.html import html_title, html_to_markdown
from quirespark.operators.office import column_index, heading_level, strip_rtf
from quirespark.operators.pdf import body_size, heading_sizes, in_columns, is_caps, join_lines, normalise, overlaps
from quirespark.operators.structured import flatten, sniff_delimiter, tabular
from quirespark.operators.textual import cues, lift_front_matter, outline, plain_to_markdown
from quirespark.plans.convert import convert_one
from quirespark.schemas import Document, Options

REG = load()


def read(name, raw, **options):
    raw = raw.encode() if isinstance(raw, str) else raw
    return convert_one(name, raw, Options.of(options), REG)


def body(name, raw, **options):
    return Document(parts=read(name, raw, **options)["parts"]).markdown


def codes(made):
    return {w["code"]: w["severity"] for w in made["warnings"]}


def package(**parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, mode="w", compression=zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return buffer.getvalue()


HTML = {
    "<p>uno</p><p>dos</p>": "uno\n\ndos", "<ul><li>ox</li><li>elk</li></ul>": "- ox\n- elk", "<ol><li>ox</li><li>elk</li></ol>": "1. ox\n2. elk",
    "<ul><li>call <code>-x</code> twice</li></ul>": "- call `-x` twice", "<p><strong>up <em>to</em> ten</strong></p>": "**up *to* ten**",
    "<p><em>salt</em> or <em>ice</em></p>": "*salt* or *ice*", "<p><code>cd</code> or <code>ls</code></p>": "`cd` or `ls`",
    '<a href="http://y.test/z"><b>Strong words</b></a>': "[**Strong words**](http://y.test/z)", "<h2>On <code>sed</code> again</h2>": "## On `sed` again",
    "<p>upper<br>lower</p>": "upper  \nlower", "<ul><li><p>x</p></li><li>y</li></ul>": "- x\n- y",
    "<blockquote><p>q</p></blockquote>": "> q", "<nav><ul><li><a href=/x>menu</a><li>other</nav><p>kept</p>": "kept",
    "<header><h1>Top</h1></header><footer><a href=/a>b</a></footer>": "# Top", "<p>a<script>var t='</p>';</script>b</p>": "ab",
    "<ul><li>top<ul><li>sub</li></ul></li><li>end</li></ul>": "- top\n  - sub\n- end", '<pre><code class="language-ruby">puts 7\nend</code></pre>': "```ruby\nputs 7\nend\n```",
    "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>x|y<br>z</td></tr></table>": "| A | B |\n| --- | --- |\n| 1 | x\\|y z |",
    '<a href="javascript:x()">l</a> <img src="i.png" alt="[a]"> <hr> &copy;': "l ![(a)](i.png)\n\n---\n\n©", "<del>gone</del> <b> </b>x": "~~gone~~ x",
    "<p><b>open<p>next": "**open**\n\nnext", "": "",
}


@pytest.mark.parametrize("html", HTML)
def test_html(html):
    assert html_to_markdown(html)[0] == HTML[html]


def test_html_options_and_titles():
    assert html_to_markdown("<a href='/elsewhere'>words</a>", keep_links=False)[0] == "words"
    assert html_to_markdown('<a href="b">l</a>', base_url="https://x.test/a/")[0] == "[l](https://x.test/a/b)"
    first = html_to_markdown("<table><tr><td>x</td><td>yes</td></tr></table>")[0].split("\n")
    assert "(no header)" in first[0] and first[-1] == "| x | yes |"
    assert [html_title(h) for h in ("<h1>Real Title</h1><title>x</title>", "<title>Only Title</title>", "<h1><span>Hello</span> World</h1>", "x")] == ["Real Title", "Only Title", "Hello World", ""]
    with pytest.raises(ValueError):
        html_to_markdown("x", engine="other")
    made = read("a.html", "<script>x</script>")
    assert made["status"] == "empty" and codes(made) == {"empty-html": "error", "no-content": "error"}
    assert "link-heavy" in codes(read("a.html", "<h1>x</h1>" + "<a href='https://x.test'>y</a>" * 51))


def test_text():
    assert plain_to_markdown("Title\n=====\nx\n- a\n\nPart\n---")[0] == "# Title\nx\n\\- a\n\n## Part"
    assert plain_to_markdown("1.2 Setup steps\nChapter 3 End", numbered=True) == ("## 1.2 Setup steps\n# Chapter 3 End", 2)
    made = read("a.txt", "中文".encode("gb18030"))
    assert made["meta"]["encoding"] == "gb18030" and codes(made) == {"non-utf8-source": "info"} and made["status"] == "ok"
    assert lift_front_matter("---\ntitle: 'A'\ntags:\n  - x\n---\nbody") == ({"title": "A", "tags": ""}, "body")
    made = read("a.md", "---\ntitle: T\n---\n## h\n")
    assert made["title"] == "T" and codes(made) == {"no-top-level-heading": "info"} and json.loads(made["meta"]["front_matter"]) == {"title": "T"}


def test_code_and_configuration():
    assert outline("def f():\nclass C:\n  def f(self):\nfunction g() {\npub fn h()") == [("f", "def", 1), ("C", "class", 2), ("g", "function", 4), ("h", "item", 5)]
    assert body("a.py", "def f():\n    return '```'").endswith("````python\ndef f():\n    return '```'\n````\n")
    assert "## server" in body("a.ini", "[server]\nHost = x\n") and "| host | x |" in body("a.ini", "[server]\nHost = x\n")
    assert codes(read("a.env", "A=1")) == {"config-parse-failed": "warning"} and body("a.env", "A=1") == "```ini\nA=1\n```\n"
    assert read("a.yaml", "a: 1\nb: 2")["meta"]["top_level_keys"] == '["a", "b"]' and "yaml-parse-failed" in codes(read("a.yaml", "a: [1"))
    assert "| k | [1, 2] |" in body("a.toml", "x = 1\n[t]\nk = [1, 2]\n") and "toml-parse-failed" in codes(read("a.toml", "x ="))
    assert "| Files touched | 2 |" in body("a.diff", "--- a/x\n+++ b/x\n+n\n-o\n")
    assert "- Label" in body("a.svg", "<svg><text>Label</text></svg>") and "no-text-in-svg" in codes(read("a.svg", "<svg/>"))


def test_subtitles():
    srt = "4\n00:00:01,000 --> 00:00:03,500\nWell\n\n2\n00:00:04,000 --> 00:00:05,000\nthere\nyou\n"
    assert cues(srt) == [(1.0, 3.5, "Well"), (4.0, 5.0, "there you")]
    assert cues("[Events]\nDialogue: 0,0:00:01.00,0:00:02.50,D,,0,0,0,,{\\b1}Hi,\\Nyou")[0] == (1.0, 2.5, "Hi, you")
    assert body("a.srt", srt).startswith("**[00:00:01]** Well") and "| Start | End | Text |" in body("a.srt", srt, subtitle_table=True)
    assert read("a.srt", srt)["meta"]["duration"] == "00:00:05" and "no-cues" in codes(read("a.srt", "\n"))


def test_delimited():
    assert [sniff_delimiter(t) for t in ("a;b\n1;2", "a\tb\n1\t2", "x", "a,b|c\n1,2|3")] == [";", "\t", ",", ","]
    assert body("a.csv", 'name,notes\nA,"x, y|z"\n') == "| name | notes |\n| --- | --- |\n| A | x, y\\|z |\n"
    made = read("a.tsv", "a\tb\tc\n1\t2\n1\t2\t3\t4\n")
    assert codes(made) == {"ragged-rows": "info"} and made["meta"]["columns"] == "4"
    big = read("a.csv", "a,b\n" + "1,2\n" * 200, csv_max_rows=10)
    assert codes(big) == {"table-too-large": "info"} and "Preview (first 10 rows" in "\n".join(big["parts"])
    assert read("a.csv", "\n")["status"] == "empty" and codes(read("a.csv", "a,b\n1,2", csv_header=False)) == {"no-header": "info"}


def test_json():
    assert flatten({"a": {"b": [1, 2]}, "c": [{"d": 1}, {"d": 2}], "e": [1, {}]}) == {"a.b": "1, 2", "c": "[2 objects]", "c[0].d": 1, "c[1].d": 2, "e": "[2 items]"}
    assert flatten(3) == {"(root)": 3} and tabular({"a": True}) == [["Key", "Value"], ["a", "True"]]
    assert tabular([{"a": 1}, {"b": 2.0}]) == [["a", "b"], ["1", ""], ["", "2"]] and tabular([]) is None and tabular([{"a": []}]) is None
    assert "| Root type | dict |" in body("a.json", '{"a": {"b": 1}}') and "## Fields" in body("a.json", '{"a": {"b": 1}}')
    assert "## Data" in body("a.json", '[{"a": 1}]') and "json-parse-failed" in codes(read("a.json", '{"a": '))
    made = read("a.jsonl", '{"a": 1}\nbad\n{"a": 2}\n')
    assert made["status"] == "partial" and made["meta"]["records"] == "2" and "jsonl-bad-lines" in codes(made)
    assert read("a.jsonl", "x\n")["status"] == "empty" and "| p | 2 |" in body("a.xml", "<r><p/><p/></r>")


def test_notebook():
    cells = [{"cell_type": "markdown", "source": ["# Hi"]}, {"cell_type": "code", "source": "1+1", "outputs": [
        {"output_type": "execute_result", "data": {"text/plain": "2"}}, {"output_type": "error", "traceback": ["\x1b[31mBoom\x1b[0m"]}]}, {"cell_type": "odd"}]
    text = body("a.ipynb", json.dumps({"cells": cells, "metadata": {"kernelspec": {"name": "python3"}}}))
    assert "# Hi" in text and "```python\n1+1\n```" in text and "```text\n2\n```" in text and "Boom" in text and "\x1b" not in text
    assert read("a.ipynb", '{"cells": []}')["status"] == "empty"


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_word():
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    xml = f"<w:document {W}><w:body>{p('Spec', 'Heading1')}{p('text')}<w:tbl><w:tr><w:tc>{p('A')}</w:tc><w:tc>{p('B')}</w:tc></w:tr></w:tbl>{p('after', 'ListBullet')}</w:body></w:document>"
    made = read("a.docx", package(**{"word/document.xml": xml}))
    assert made["parts"] == ["# Spec", "text", "| A | B |\n| --- | --- |", "- after"] and made["converter"] == "ooxml-stdlib"
    assert {"fallback-converter": "info", "optional-dependency-missing": "info"} == codes(made) and made["status"] == "ok"
    assert codes(read("a.docx", package(**{"x": "y"}), force_format="docx"))["all-converters-failed"] == "error"
    assert [heading_level(s) for s in ("Heading 2", "Title", "标题 3", "Normal")] == [2, 1, 3, None]


def test_slides_and_sheets():
    a, pm = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    shape = lambda *t: "<p:sp><p:txBody>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in t) + "</p:txBody></p:sp>"
    slide = lambda *s: f'<p:sld xmlns:p="{pm}" xmlns:a="{a}">{"".join(s)}</p:sld>'
    deck = package(**{"ppt/presentation.xml": "<x/>", "ppt/slides/slide10.xml": slide(shape("Last")), "ppt/slides/slide2.xml": slide(shape("First"), shape("x", "y"))})
    assert read("a.pptx", deck)["parts"] == ["## First", "- x\n- y", "## Last"]
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = package(**{
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="Metrics" r:id="rId1"/><sheet name="Empty" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>Metric</t></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Q2</t></is></c></row><row><c r="A2"><v>3.5</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{s}"><sheetData/></worksheet>'})
    assert read("a.xlsx", book)["parts"] == ["## Metrics", "| Metric |  | Q2 |\n| --- | --- | --- |\n| 3.5 |  |  |", "## Empty", "*(empty sheet)*"]
    assert "sheet-truncated" in codes(read("a.xlsx", book, xlsx_max_rows=1))
    assert [column_index(x) for x in ("A1", "Z9", "AA10", "b7")] == [0, 25, 26, 1] and read("a.xlsx", b"junk")["status"] == "failed"


def test_open_document():
    ns = 'xmlns:o="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'
    xml = f'<o:d {ns}><text:h text:outline-level="2">Head</text:h><text:p>para</text:p><table:table><table:table-row><table:table-cell><text:p>c</text:p></table:table-cell></table:table-row></table:table></o:d>'
    made = read("a.odt", package(**{"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": xml}))
    assert made["parts"] == ["## Head", "para", "| c |\n| --- |"] and made["format"]["key"] == "odf"


def test_rich_and_legacy_text():
    assert strip_rtf(r"{\rtf1\ansi Some \b strong\b0 }") == "Some strong"
    assert strip_rtf(r"{\rtf1{\fonttbl{\f0 Arial;}}caf\'e9\par\u8364?\tab \{x\}{\*\gen y}}") == "café\n€\t{x}"
    assert "rtf-lossy" in codes(read("a.rtf", r"{\rtf1 text}")) and read("a.rtf", r"{\rtf1}")["status"] == "empty"
    ole = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(64) + "Unbrokenrunoflegibletextinoneword".encode("utf-16-le") + bytes(64)
    made = read("a.doc", ole)
    assert made["parts"] == ["Unbrokenrunoflegibletextinoneword"] and codes(made) == {"legacy-format-lossy": "warning"}


def test_books():
    opf = '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b%20c.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="z"/></spine></package>'
    book = package(**{"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>',
                      "o/p.opf": opf, "o/a.xhtml": "<h1>Two</h1>", "o/b c.xhtml": "<h1>One</h1><ul><li>x</li></ul>"})
    made = read("a.epub", book)
    assert made["title"] == "Book" and [p.split("\n\n")[1] for p in made["parts"]] == ["# One", "# Two"] and made["status"] == "ok"
    assert codes(read("a.epub", b"junk"))["all-converters-failed"] == "error"
    fb = '<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><body><section><title><p>Ch</p></title><p>text</p></section></body></FictionBook>'
    assert read("a.fb2", fb)["parts"] == ["## Ch", "text"] and read("a.mobi", "x")["status"] == "empty"


def test_mail_and_archives():
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = "Grüße", "a@x.test", "b@x.test"
    m.set_content("Hello\n\nthere")
    m.add_alternative("<p>Hello <b>html</b></p>", subtype="html")
    m.add_attachment(b"a,b", maintype="text", subtype="csv", filename="../d.csv")
    made = read("a.eml", m.as_bytes())
    text = "\n".join(made["parts"])
    assert made["title"] == "Grüße" and "| From | a@x.test |" in text and "Hello\n\nthere" in text and "| d.csv | text/csv | 3 |" in text
    m = EmailMessage()
    m.set_content("<p>only</p>", subtype="html")
    assert "html-only-email" in codes(read("a.eml", m.as_bytes()))
    made = read("a.zip", package(**{"x/y.txt": "abc"}))
    assert made["format"]["key"] == "archive" and "| y.txt | 3 | .txt |" in "\n".join(made["parts"]) and codes(made) == {"archive-not-extracted": "info"}
    bomb = read("a.zip", package(**{"z": b"\0" * (80 << 20)}))
    assert bomb["status"] == "failed" and "200" in bomb["error"]


def test_images_refusals_and_pdf():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (240).to_bytes(4, "big") + (120).to_bytes(4, "big") + bytes(8)
    made = read("d.png", png)
    assert "| Dimensions | 240 x 120 |" in "\n".join(made["parts"]) and made["assets"][0]["media_type"] == "image/png" and made["status"] == "partial"
    for name, raw in (("a.exe", b"MZ\0"), ("a.parquet", b"PAR1"), ("a.mp3", b"ID3")):
        made = read(name, raw)
        assert made["status"] == "empty" and codes(made) == {"unsupported-format": "error"} and made["parts"]
    assert codes(read("a.pdf", b"%PDF-1.4"))["all-converters-failed"] == "error"
    assert join_lines(["exam-", "ple text", "more"]) == "example text more" and join_lines(["中", "文"]) == "中文" and normalise("ﬁ\u00ad“x”") == 'fi"x"'
    assert body_size([10, 10, 24]) == 10 and heading_sizes([10, 24, 16, 10], 10) == {24: 1, 16: 2} and is_caps("ABCD e") is False and is_caps("ABCDE")
    assert overlaps((0, 0, 10, 10), (0, 0, 10, 6)) and not overlaps((0, 0, 10, 10), (0, 0, 10, 4)) and in_columns([(0, 0, 100, 9)] * 4 + [(300, 0, 500, 9)] * 4, 600)


def test_limits_and_forcing():
    assert codes(read("a.txt", "x" * 50, max_bytes=10)) == {"security-limit": "error"}
    assert read("a.txt", "x" * 50, max_bytes=10, sniff=False)["status"] == "ok"
    assert read("a.txt", "a,b\n1,2", force_format="csv")["format"]["confidence"] == "forced" and codes(read("x", "y", force_format="nope")) == {"no-converter": "error"}
    assert convert_one("x", None, Options(), REG)["status"] == "failed"


def test_the_chain():
    r = Registry()

    def broken(source, options):
        raise RuntimeError("no")

    def blank(source, options):
        return Document()

    def good(source, options):
        d = Document()
        d.add("text")
        return d

    run = lambda: r.run("k", Source("a", b""), Options())
    assert run().document.warnings[0]["code"] == "no-converter"
    r.register(Converter("k", "b", broken, 10))
    assert run().document.status == "failed" and run().document.warnings[0]["code"] == "all-converters-failed"
    r.register(Converter("k", "e", blank, 20))
    assert run().document.status == "empty" and run().document.warnings[0]["code"] == "no-content"
    r.register(Converter("k", "m", good, 5, "no_such_module"))
    r.register(Converter("k", "g", good, 30))
    out = run()
    assert out.converter == "g" and {w["code"] for w in out.document.warnings} == {"fallback-converter", "optional-dependency-missing"} and out.document.status == "partial"
    r.register(Converter("k", "b", good, 10), replace=True)
    assert run().converter == "b" and [c.name for c in r.chain("k")] == ["m", "b", "e", "g"]


def test_document_rules():
    d = Document()
    d.info("x", "y")
    assert d.status == "ok"
    d.flag("x", "y")
    d.worsen("ok")
    assert d.status == "partial"
    d.worsen("empty")
    d.worsen("failed")
    assert d.status == "empty"
    d = Document(parts=["a", "b\n\n\n\nc"])
    assert d.markdown == "a\n\nb\n\nc\n"
    assert Options.of({"csv_max_rows": 3, "nope": 1, "delimiter": None}).csv_max_rows == 3 and len(Options().as_dict()) == 39

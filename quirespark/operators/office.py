"""Readers of office packages, rich text and legacy binary files."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from collections.abc import Iterator

from quirespark.functions import markdown as md
from quirespark.functions.safety import check_archive
from quirespark.operators.chain import Source, reads
from quirespark.schemas import Document, Options

WIDEST = 12
_OOXML, _ODF = "{http://schemas.openxmlformats.org/%s}", "{urn:oasis:names:tc:opendocument:xmlns:%s:1.0}"
_W, _P, _S, _A = (_OOXML % f"{part}ml/2006/main" for part in ("wordprocessing", "presentation", "spreadsheet", "drawing"))
_R = _OOXML % "officeDocument/2006/relationships"
_OT, _OTAB = _ODF % "text", _ODF % "table"


def open_package(source: Source) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(source.raw))
    check_archive(len(source.raw), sum(i.file_size for i in z.infolist()))
    return z


def grid(rows: list[list[str]]) -> str:
    """A table, or bare lines where it would be too wide to read; empty rows are left out."""
    rows = [r for r in rows if any(r)]
    if not rows:
        return ""
    if max(map(len, rows)) > WIDEST:
        return "\n".join(map(" | ".join, rows))
    return md.table(rows)


def heading_level(style: str) -> int | None:
    """The level that a paragraph style of a Word document stands for, in six languages."""
    bare = style.strip().lower()
    if bare in ("title", "标题"):
        return 1
    if bare in ("subtitle", "副标题"):
        return 2
    m = re.match(r"(?:heading|überschrift|berschrift|titre|título|titulo|titolo|标题|見出し)\s*([1-9])", bare)
    return int(m[1]) if m else None


def is_list_style(style: str, numbered: bool = False) -> bool:
    bare = style.strip().lower()
    return numbered or bool(re.match("(?:列表|list)(?!.*paragraph)", bare))


def column_index(ref: str) -> int:
    """B7 -> 1."""
    n = 0
    for c in re.match(r"[A-Za-z]*", ref)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def _look(properties: ET.Element | None) -> tuple[str, bool]:
    """A paragraph's style, and whether it is numbered."""
    if properties is None:
        return "", False
    styles = [n.get(f"{_W}val", "") for n in properties if n.tag == f"{_W}pStyle"]
    return "".join(styles[:1]), any(n.tag == f"{_W}numPr" for n in properties)


def _texts(node: ET.Element, tag: str) -> str:
    return "".join(x.text or "" for x in node.iter(tag))


@reads("docx/python-docx", 10, "Word with styles, lists, tables, images", needs="docx")
def read_docx_full(source: Source, options: Options) -> Document:
    import docx

    doc, book = Document(), docx.Document(io.BytesIO(source.raw))
    stats = dict.fromkeys(("headings", "tables", "paragraphs", "lists", "images"), 0)
    from docx.table import Table
    from docx.text.paragraph import Paragraph

    for child in book.element.body.iterchildren():
        if child.tag == f"{_W}p":
            p = Paragraph(child, book)
            text, style = p.text.strip(), p.style.name if p.style is not None else ""
            if not text:
                continue
            level = heading_level(style)
            kind = "headings" if level else "paragraphs"
            if level:
                doc.heading(level, text)
            elif is_list_style(style, _look(child.find(f"{_W}pPr"))[1]):
                doc.add("- " + text)
                kind = "lists"
            else:
                doc.add(text)
            stats[kind] += 1
        elif child.tag == f"{_W}tbl":
            rows = [r for r in ([md.squash(c.text) for c in row.cells] for row in Table(child, book).rows) if any(r)]
            if rows:
                if max(map(len, rows)) > WIDEST:
                    doc.info("wide-table", f"a table of {max(map(len, rows))} columns is shown as lines")
                doc.add(grid(rows))
                stats["tables"] += 1
    if options.extract_images:
        for rel in book.part.rels.values():
            if "image" in rel.reltype and not rel.is_external:
                name = rel.target_ref.rsplit("/", 1)[-1]
                doc.asset(name, rel.target_part.blob, rel.target_part.content_type, f"docx: {name}")
                doc.add(md.image(name, f"assets/{name}"))
                stats["images"] += 1
    core = book.core_properties
    doc.title = core.title or ""
    doc.meta |= stats | {k: str(v) for k, v in (("title", core.title), ("author", core.author), ("subject", core.subject), ("created", core.created)) if v}
    return doc if not doc.blank() else doc.fail("empty", "empty-document", "the document has no text")


@reads("docx/ooxml-stdlib", 90, "Word by its XML alone")
def read_docx(source: Source, options: Options) -> Document:
    doc, part = Document(), "word/document.xml"
    try:
        z = open_package(source)
    except zipfile.BadZipFile as e:
        return doc.fail("failed", "package-invalid", f"not a package: {e}")
    if part not in z.namelist():
        return doc.fail("failed", "missing-part", f"the package lacks {part}")
    try:
        root = ET.fromstring(z.read(part))
    except ET.ParseError as e:
        return doc.fail("failed", "xml-parse-failed", f"{part}: {e}")
    stats = Counter()
    celled = {id(p) for t in root.iter(f"{_W}tbl") for p in t.iter(f"{_W}p")}
    inner = {id(t) for o in root.iter(f"{_W}tbl") for t in o.iter(f"{_W}tbl") if t is not o}
    for node in root.iter():  # in the document's order; what is in cells shows in its table alone
        if node.tag == f"{_W}p" and id(node) not in celled:
            text = _texts(node, f"{_W}t").strip()
            look = node.find(f"{_W}pPr")
            style, numbered = _look(look)
            level = heading_level(style)
            if text:
                doc.add(md.heading(level, text) if level else "- " + text if is_list_style(style, numbered) else text)
                stats["headings" if level else "paragraphs"] += 1
        elif node.tag == f"{_W}tbl" and id(node) not in inner:
            rows = [[md.squash(_texts(c, f"{_W}t")) for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            doc.add(grid(rows))
            stats["tables"] += any(map(any, rows))
    doc.meta |= {k: stats[k] for k in ("tables", "headings", "paragraphs")}
    doc.info("fallback-converter", "read by the built-in reader, without properties and images")
    return doc if not doc.blank() else doc.fail("empty", "empty-document", "the document has no text")


@reads("pptx/python-pptx", 10, "slides with tables and notes", needs="pptx")
def read_pptx_full(source: Source, options: Options) -> Document:
    import pptx

    doc, deck, images = Document(), pptx.Presentation(io.BytesIO(source.raw)), 0

    def shapes(group) -> Iterator:
        for s in group:
            if s.shape_type == 6:
                yield from shapes(s.shapes)
            else:
                yield s

    for n, slide in enumerate(deck.slides, 1):
        title = slide.shapes.title
        doc.heading(2, (title.text_frame.text.strip() if title is not None and title.has_text_frame else "") or f"Slide {n}")
        for s in shapes(slide.shapes):
            if title is not None and s.shape_id == title.shape_id:
                continue
            if s.has_text_frame:
                doc.add("\n".join("  " * p.level + "- " + p.text.strip() for p in s.text_frame.paragraphs if p.text.strip()))
            elif getattr(s, "has_table", False) and s.has_table and options.pptx_tables:
                doc.table([[c.text for c in r.cells] for r in s.table.rows])
            elif s.shape_type == 13 and options.extract_images:
                images += 1
                name = f"slide-{n}-{images}.{s.image.ext}"
                doc.asset(name, s.image.blob, s.image.content_type, f"slide {n}")
                doc.add(md.image(s.name, f"assets/{name}"))
        if options.pptx_notes and slide.has_notes_slide:
            notes = slide.notes_slide.notes_text_frame.text.strip()
            doc.add(md.blockquote("Notes: " + notes) if notes else None)
    doc.meta |= {"slides": len(deck.slides), "images": images}
    return doc if len(deck.slides) else doc.fail("empty", "no-slides", "the deck has no slides")


@reads("pptx/ooxml-stdlib", 90, "slides by their XML alone")
def read_pptx(source: Source, options: Options) -> Document:
    doc, z = Document(), open_package(source)
    found = sorted((int(m[1]), m[0]) for m in (re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n) for n in z.namelist()) if m)
    if not found:
        return doc.fail("empty", "no-slides", "the package has no slides")
    for _, name in found:
        titled = False
        for shape in ET.fromstring(z.read(name)).iter(f"{_P}sp"):
            texts = [t for t in (_texts(p, f"{_A}t").strip() for p in shape.iter(f"{_A}p")) if t]
            if texts:
                doc.add(md.bullets(texts) if titled else md.heading(2, " ".join(texts)))
                titled = True
    doc.info("fallback-converter", "read by the built-in reader, without notes, tables and images")
    return doc


Sheet = tuple[str, list[list[str]]]


def sheets(source: Source) -> list[Sheet]:
    """(name, rows) of a workbook, with gaps filled."""
    z = open_package(source)
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = [_texts(si, f"{_S}t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    if "xl/workbook.xml" not in names:
        return []
    rels = {}
    links = "xl/_rels/workbook.xml.rels"
    if links in names:
        rels = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read(links))}
    out = []
    for n, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"), 1):
        target = rels.get(sheet.get(f"{_R}id"), f"worksheets/sheet{n}.xml")
        part = target.lstrip("/") if target.startswith("/") else "xl/" + target
        if part not in names:
            continue
        rows = []
        for row in ET.fromstring(z.read(part)).iter(f"{_S}row"):
            cells: list[str] = []
            for c in row.iter(f"{_S}c"):
                at = column_index(c.get("r", "")) if c.get("r") else len(cells)
                cells += [""] * (at - len(cells))
                value = c.findtext(f"{_S}v") or ""
                kind = c.get("t")
                if kind == "s":
                    value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                elif kind == "inlineStr":
                    value = _texts(c, f"{_S}t")
                elif kind == "b":
                    value = "true" if value == "1" else "false"
                cells.append(value)
            rows.append(cells)
        out.append((sheet.get("name", f"Sheet{n}"), rows))
    return out


def _add_sheets(doc: Document, found: list[Sheet], most: int) -> None:
    total = 0
    for name, rows in found:
        doc.heading(2, name)
        filled = [r for r in rows if "".join(r).strip()]
        if len(filled) > most:
            doc.flag("sheet-truncated", f"sheet {name} is cut after {most} rows")
        doc.add(grid(filled[:most]) or "*(empty sheet)*")
        total += len(filled[:most])
    doc.meta |= {"sheets": len(found), "rows": total}


@reads("xlsx/openpyxl", 10, "workbook with typed cells", needs="openpyxl")
def read_xlsx_full(source: Source, options: Options) -> Document:
    import openpyxl

    doc = Document()
    book = openpyxl.load_workbook(io.BytesIO(source.raw), read_only=True, data_only=True)
    show = lambda v: v.isoformat() if hasattr(v, "isoformat") else md.inline_value(v)
    found = []
    for ws in book.worksheets:
        rows = []
        for row in ws.iter_rows(values_only=True):
            rows.append([show(v) for v in row])
            if len(rows) > options.xlsx_max_rows + 50:
                break
        found.append((ws.title, rows))
    if not found:
        return doc.fail("empty", "no-sheets", "the workbook has no sheets")
    _add_sheets(doc, found, options.xlsx_max_rows)
    return doc


@reads("xlsx/xlsx-stdlib", 90, "workbook by its XML alone")
def read_xlsx(source: Source, options: Options) -> Document:
    doc = Document()
    try:
        found = sheets(source)
    except zipfile.BadZipFile as e:
        return doc.fail("failed", "package-invalid", f"not a package: {e}")
    except (ET.ParseError, KeyError, ValueError) as e:
        return doc.fail("failed", "xlsx-read-failed", str(e))
    if not found:
        return doc.fail("failed", "no-sheets-found", "the package has no sheet that can be read")
    _add_sheets(doc, found, options.xlsx_max_rows)
    doc.info("fallback-converter", "read by the built-in reader, without formulas and types")
    return doc


@reads("odf/odf", 10, "OpenDocument text, tables and headings")
def read_odf(source: Source, options: Options) -> Document:
    doc, z = Document(), None
    if source.raw[:2] == b"PK":
        z = open_package(source)
        if "content.xml" not in z.namelist():
            return doc.fail("failed", "missing-part", "the package lacks content.xml")
    root = ET.fromstring(z.read("content.xml") if z else source.raw)
    kind = str(z.read("mimetype").strip(), "latin-1") if z and "mimetype" in z.namelist() else ""
    stats = Counter()

    def visit(node: ET.Element) -> None:
        if node.tag == f"{_OTAB}table":
            rows = [[md.squash("".join(c.itertext())) for c in r.findall(f"{_OTAB}table-cell")] for r in node.iter(f"{_OTAB}table-row")]
            doc.add(grid(rows))
            stats["tables"] += any(map(any, rows))
        elif node.tag in (f"{_OT}h", f"{_OT}p"):
            words, level = "".join(node.itertext()), None
            text = md.squash(words)
            if node.tag == f"{_OT}h":
                level = int(node.get(f"{_OT}outline-level") or 1)
            doc.add(md.heading(level, text) if level and text else text)
            stats["headings" if level else "paragraphs"] += bool(text)
        else:
            for child in node:
                visit(child)

    visit(root)
    doc.meta |= {"mimetype": kind, **{k: stats[k] for k in ("tables", "headings", "paragraphs")}}
    return doc if not doc.blank() else doc.fail("empty", "empty-document", "no text was found")


_SKIPPED = frozenset(
    "fonttbl colortbl stylesheet info pict object header footer footnote themedata datastore listtable listoverridetable generator xmlnstbl".split()
)
_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([\da-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.I | re.S)


def strip_rtf(text: str) -> str:
    """The text of an RTF file, its paragraphs as lines."""
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    skip, uni, owed = False, 1, 0
    signs = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "tab": "\t", "bullet": "•", "emdash": "—", "endash": "–",
             "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
    for m in _RTF.finditer(text):
        word, number, code, mark, brace, char = m.groups()
        if brace == "{":
            stack.append((skip, uni))
            owed = 0
        elif brace == "}":
            skip, uni = stack.pop() if stack else (False, 1)
            owed = 0
        elif mark:
            if mark == "*":
                skip = True
            elif not skip and mark in "{}\\":
                out.append(mark)
            elif not skip and mark == "~":
                out.append(" ")
        elif word:
            if word in _SKIPPED:
                skip = True
            elif skip:
                continue
            elif word in signs:
                out.append(signs[word])
            elif word == "uc":
                uni = int(number or 1)
            elif word == "u" and number:
                out.append(chr(int(number) % 65536))
                owed = uni
        elif code:
            if owed:
                owed -= 1
            elif not skip:
                out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif char:
            if owed:
                owed -= 1
            elif not skip:
                out.append(char)
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()


@reads("rtf/rtf", 20, "the text alone")
def read_rtf(source: Source, options: Options) -> Document:
    doc, text = Document(), strip_rtf(source.text)
    if not text.strip():
        return doc.fail("empty", "empty-document", "no text was recovered")
    doc.add(md.paragraphs(text))
    doc.info("rtf-lossy", "headings, tables and formatting were not recovered")
    return doc


_CONTROLS = r"[^\x0e-\x1f\x0b\x0c\x00-\x08]"


def text_runs(raw: bytes) -> list[str]:
    """Runs of plausible text in a binary file, each once, in order."""
    found: dict[str, None] = {}
    for encoding, least in {"utf-16-le": 24, "cp1252": 40}.items():
        for m in re.finditer(_CONTROLS + "{%d,}" % least, raw.decode(encoding, "ignore")):
            run = m[0]
            if sum(c.isprintable() and not c.isspace() for c in run) >= 0.85 * len(run) and len(md.squash(run)) >= least:
                found.setdefault(md.squash(run))
    return list(found)


def _legacy(key: str, name: str, what: str) -> None:
    @reads(f"{key}/{name}", 20, f"runs of text in a legacy {what}")
    def read(source: Source, options: Options) -> Document:
        doc, runs = Document(), text_runs(source.raw)
        if not runs:
            return doc.fail("empty", "empty-document", f"no text was recovered from the legacy {what}")
        doc.add("\n\n".join(runs))
        doc.meta["runs"] = len(runs)
        doc.flag("legacy-format-lossy", f"a legacy {what} has no structure that can be relied on: runs of text were recovered")
        return doc


for _key, _name, _what in (
    ("doc_legacy", "ole-doc", "document"), ("ppt_legacy", "ole-ppt", "presentation"), ("xls_legacy", "ole-xls", "workbook"), ("msg_legacy", "ole-msg", "message"),
):
    _legacy(_key, _name, _what)

"""PDF readers. Both need a package that may be absent; what they decide by is plain functions."""

from __future__ import annotations

import io
import re
import unicodedata
from collections import Counter

from quirespark.functions import markdown as md
from quirespark.operators.chain import Source, reads
from quirespark.schemas import Document, Options

SPARSE, WIDEST = 25, 14
_CJK = r"[　-鿿＀-￯]"
_FORMS = str.maketrans({"­": None, " ": " ", "‘": "'", "’": "'", "“": '"', "”": '"'})


def normalise(text: str) -> str:
    return unicodedata.normalize("NFKC", text).translate(_FORMS)


def join_lines(lines: list[str]) -> str:
    """One paragraph of a block's lines: words divided at line ends are rejoined."""
    out = ""
    for line in (x.strip() for x in lines):
        if not line or not out:
            out = out or line
        elif re.search(r"\w-$", out) and line[0].islower():
            out = out[:-1] + line
        elif re.search(_CJK + "$", out) or re.match(_CJK, line):
            out += line
        else:
            out += " " + line
    return out


def body_size(sizes: list[float]) -> float:
    """The commonest font size; the first seen of equally common ones."""
    return Counter(round(s, 1) for s in sizes).most_common(1)[0][0] if sizes else 0.0


def heading_sizes(sizes: list[float], body: float) -> dict[float, int]:
    """Levels of the sizes above the body's, the largest first."""
    return {s: min(i, 6) for i, s in enumerate(sorted({round(x, 1) for x in sizes if x > body * 1.12})[::-1], 1)}


def is_bold(flags: list[bool]) -> bool:
    return bool(flags) and sum(flags) / len(flags) > 0.6


def is_caps(text: str) -> bool:
    letters = [c for c in text if c.isalpha()]
    return len(letters) > 3 and sum(c.isupper() for c in letters) / len(letters) > 0.8


def overlaps(a: tuple, b: tuple) -> bool:
    """Whether more than half of box a lies in box b."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    area = (a[2] - a[0]) * (a[3] - a[1])
    return w > 0 and h > 0 and area > 0 and w * h / area > 0.5


def in_columns(boxes: list[tuple], width: float) -> bool:
    mid = width / 2
    return len(boxes) >= 8 and sum(b[2] < mid + 40 and b[0] < mid - 40 for b in boxes) >= 3 and sum(b[0] > mid - 40 for b in boxes) >= 3


@reads("pdf/pymupdf", 10, "headings by font size, tables, page marks", needs="fitz")
def read_pdf(source: Source, options: Options) -> Document:
    import fitz

    doc = Document()
    try:
        book = fitz.open(stream=source.raw, filetype="pdf")
    except Exception as e:  # noqa: BLE001
        return doc.fail("failed", "pdf-open-failed", str(e))
    if book.needs_pass:
        return doc.fail("failed", "pdf-encrypted", "the file is protected by a password")
    total = book.page_count
    pages = []
    for page in list(book)[: options.pdf_max_pages or total]:
        blocks = []
        for b in page.get_text("dict")["blocks"]:
            spans = [s for x in b.get("lines", ()) for s in x["spans"] if s["text"].strip()]
            if spans:
                text = join_lines([normalise("".join(s["text"] for s in x["spans"])) for x in b["lines"]])
                blocks.append({"text": text, "size": max(s["size"] for s in spans), "bold": is_bold([bool(s["flags"] & 16) for s in spans]), "bbox": b["bbox"]})
        pages.append((page, blocks))
    if not pages:
        return doc.fail("empty", "empty-pdf", "the file has no pages")
    chars = [sum(len(b["text"]) for b in blocks) for _, blocks in pages]
    empty = [n for n, c in enumerate(chars, 1) if c < SPARSE]
    if len(empty) == len(pages):
        return doc.fail("empty", "scanned-pdf", "no page has text; the file seems to be scanned")
    sizes = [b["size"] for _, blocks in pages for b in blocks]
    body = body_size(sizes)
    levels = heading_sizes(sizes, body)
    stats = dict.fromkeys(("tables", "images", "headings", "paragraphs"), 0)
    for n, (page, blocks) in enumerate(pages, 1):
        if options.pdf_page_markers and len(pages) > 1:
            doc.add(f"<!-- page {n} -->")
        boxes = []
        if options.pdf_tables:
            try:
                for t in page.find_tables().tables:
                    rows = [[md.inline_value(c) for c in r] for r in t.extract()]
                    if rows and any(any(r) for r in rows) and max(map(len, rows)) <= WIDEST:
                        boxes.append(t.bbox)
                        doc.table(rows)
                        stats["tables"] += 1
            except Exception as e:  # noqa: BLE001
                doc.info("table-detection-failed", f"page {n}: {e}")
        if in_columns([b["bbox"] for b in blocks], page.rect.width):
            doc.info("multi-column-layout", f"page {n} seems to have columns; their order may be wrong")
        seen: set[str] = set()
        for b in blocks:
            if any(overlaps(b["bbox"], x) for x in boxes) or b["text"] in seen:
                continue
            seen.add(b["text"])
            level = levels.get(round(b["size"], 1)) or (3 if len(b["text"]) < 80 and b["bold"] and is_caps(b["text"]) else None)
            doc.add(md.heading(level, b["text"]) if level and len(b["text"]) <= 200 else b["text"])
            stats["headings" if level else "paragraphs"] += 1
        stats["images"] += len(page.get_images())
    if empty:
        doc.flag("scanned-pages", f"pages without text: {md.page_ranges(empty)}")
    if len(pages) < total:
        doc.flag("page-limit", f"only {len(pages)} of {total} pages were read")
    if not stats["headings"]:
        doc.flag("no-headings-recovered", "no font size stands out as a heading's")
    facts = book.metadata or {}
    doc.title = facts.get("title") or ""
    doc.meta |= {"pages": total, "pages_extracted": len(pages), "scanned_pages": empty, "body_font_size": body, "heading_font_sizes": list(levels), **stats}
    doc.meta |= {k: v for k, v in (("pdf_title", facts.get("title")), ("author", facts.get("author"))) if v}
    return doc


@reads("pdf/pdf-plaintext", 80, "text page by page", needs="pypdf")
def read_pdf_text(source: Source, options: Options) -> Document:
    import pypdf

    doc, book = Document(), pypdf.PdfReader(io.BytesIO(source.raw))
    if book.is_encrypted:
        return doc.fail("failed", "pdf-encrypted", "the file is protected by a password")
    for n, page in enumerate(book.pages[: options.pdf_max_pages or len(book.pages)], 1):
        text = normalise(page.extract_text() or "").strip()
        doc.add(f"<!-- page {n} -->\n\n{text}" if text else None)
    doc.meta["pages"] = len(book.pages)
    if doc.blank():
        return doc.fail("empty", "scanned-pdf", "no page has text")
    doc.flag("lossy-pdf-fallback", "text only: headings and tables were not recovered")
    return doc

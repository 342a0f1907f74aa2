"""Readers of books, mail and archives."""

from __future__ import annotations

import email
import email.policy
import os
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from urllib.parse import unquote

from quirespark.functions import markdown as md
from quirespark.functions.safety import UnsafeInput, safe_filename
from quirespark.operators.chain import Source, reads
from quirespark.operators.html import html_to_markdown
from quirespark.operators.office import open_package
from quirespark.schemas import Document, Options

Facts = dict[str, str]
_BODIES = ("text/html", "text/plain")
_PICTURES = tuple(".svg .webp .gif .jpeg .jpg .png".split())


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def package_file(z: zipfile.ZipFile) -> str:
    """Where a book's package document is; empty if its container does not say."""
    try:
        root = ET.fromstring(z.read("META-INF/container.xml"))
    except (KeyError, ET.ParseError):
        return ""
    return next((n.get("full-path", "") for n in root.iter() if _local(n.tag) == "rootfile"), "")


def spine(z: zipfile.ZipFile, opf: str) -> tuple[list[str], Facts]:
    """Parts in reading order (all text parts if there is no spine), and the book's facts."""
    root = ET.fromstring(z.read(opf))
    base, manifest, order, facts = posixpath.dirname(opf), {}, [], {}
    for n in root.iter():
        tag = _local(n.tag)
        if tag == "item":
            manifest[n.get("id")] = (posixpath.normpath(posixpath.join(base, unquote(n.get("href", "")))), n.get("media-type", ""))
        elif tag == "itemref":
            order.append(n.get("idref"))
        elif n.tag.startswith("{http://purl.org/dc/") and (n.text or "").strip():
            facts.setdefault(tag, md.squash(n.text))
    parts = [manifest[i][0] for i in order if i in manifest]
    return parts or [p for p, kind in manifest.values() if "html" in kind], facts


@reads("epub/epub", 10, "chapters in reading order")
def read_epub(source: Source, options: Options) -> Document:
    doc = Document()
    try:
        z = open_package(source)
    except zipfile.BadZipFile as e:
        return doc.fail("failed", "epub-invalid", f"not a container: {e}")
    opf = package_file(z)
    if not opf:
        return doc.fail("failed", "epub-invalid", "its container names no package document")
    try:
        parts, facts = spine(z, opf)
    except (KeyError, ET.ParseError) as e:
        return doc.fail("failed", "epub-invalid", f"its package document cannot be read: {e}")
    doc.meta |= {k: facts[k] for k in "identifier title creator publisher date language".split() if k in facts}
    doc.title = facts.get("title", "")
    names, missing, chapters, headings = set(z.namelist()), [], 0, 0
    for part in parts:
        if part not in names:
            missing.append(part)
            continue
        body, stats, _ = html_to_markdown(
            z.read(part).decode("utf-8", "replace"), engine=options.html_engine, keep_links=options.keep_links, keep_images=options.keep_images
        )
        headings += stats["headings"]
        if body:
            chapters += 1
            doc.add("\n\n".join((f"<!-- chapter: {posixpath.basename(part)} -->", body)))
    pictures = []
    for name in z.namelist() if options.extract_images else ():
        ext = os.path.splitext(name)[1].lower()
        if ext in _PICTURES and z.getinfo(name).file_size >= 2048:
            safe = safe_filename(name)
            doc.asset(safe, z.read(name), f"image/{ext[1:]}", f"epub: {name}")
            pictures.append(md.image(safe, f"assets/{safe}"))
    if pictures:
        doc.folded("Images in the book (%d)" % len(pictures), "\n\n".join(pictures))
    doc.meta |= {"chapters": chapters, "spine_items": len(parts), "images": len(pictures)}
    if missing:
        doc.flag("epub-missing-parts", f"parts that are absent ({len(missing)}): {', '.join(missing[:5])}")
    if chapters and not headings:
        doc.info("no-headings", "no chapter has a heading")
    return doc if chapters else doc.fail("empty", "empty-document", "no chapter has text")


@reads("fb2/fb2", 10, "sections of a FictionBook")
def read_fb2(source: Source, options: Options) -> Document:
    doc = Document()
    try:
        root = ET.fromstring(source.text)
    except (ET.ParseError, ValueError) as e:
        return doc.fail("failed", "xml-parse-failed", str(e))
    text = lambda n: md.squash("".join(n.itertext()))
    for name in ("annotation", "author", "book_title"):
        nodes = [n for n in root.iter() if _local(n.tag).replace("-", "_") == name]
        doc.meta |= {name: t for t in map(text, nodes[:3]) if t}
    sections = 0
    for section in (s for b in root.iter() if _local(b.tag) == "body" for s in b.iter() if _local(s.tag) == "section"):
        for child in section:
            if _local(child.tag) == "title" and text(child):
                doc.heading(2, text(child))
                sections += 1
            elif _local(child.tag) == "p":
                doc.add(text(child))
    doc.meta["sections"] = sections
    return doc if not doc.blank() else doc.fail("empty", "empty-document", "no text was found")


@reads("mobi/mobi-unsupported", 10, "refused; says what to do instead")
def read_mobi(source: Source, options: Options) -> Document:
    doc = Document()
    doc.add("> **Unsupported format.** MOBI and AZW books have to be converted to EPUB first.")
    return doc.fail("empty", "unsupported-mobi", "MOBI and AZW are proprietary containers; convert the book to EPUB first")


@reads("email/eml", 10, "headers, body and a list of attachments")
def read_email(source: Source, options: Options) -> Document:
    doc = Document()
    try:
        message = email.message_from_bytes(source.raw, policy=email.policy.default)
        header = {n: md.squash(str(message.get(n) or "")) for n in ("Subject", "From", "To", "Cc", "Date", "Reply-To")}
    except Exception as e:  # noqa: BLE001 - malformed headers raise many kinds
        return doc.fail("failed", "eml-parse-failed", str(e))
    if header["Subject"]:
        doc.title = header.pop("Subject")
        doc.heading(1, doc.title)
    doc.facts(pair for pair in header.items() if pair[0] != "Subject")
    bodies, attached = {}, []
    for part in (p for p in message.walk() if not p.is_multipart()):
        kind, name = part.get_content_type(), part.get_filename()
        payload = part.get_payload(decode=True) or b""
        if part.get_content_disposition() == "attachment" or (name and kind not in _BODIES):
            attached.append((safe_filename(name or "attachment.bin"), kind, f"{len(payload):,}"))
        elif kind in _BODIES and kind not in bodies:
            try:
                bodies[kind] = part.get_content().replace("\r\n", "\n")
            except (LookupError, ValueError, KeyError):
                bodies[kind] = payload.decode("utf-8", "replace")
    plain, html = bodies.get("text/plain", ""), bodies.get("text/html", "")
    rendered = html_to_markdown(html, engine=options.html_engine)[0] if html.strip() and (options.eml_prefer_html or not plain.strip()) else ""
    if plain.strip() or rendered:
        doc.heading(2, "Body")
        doc.add(md.paragraphs(plain) if plain.strip() else rendered)
    if plain.strip() and rendered:
        doc.folded("HTML version of the body", rendered)
    elif rendered:
        doc.info("html-only-email", "the message has no plain text; its HTML was rendered")
    if attached:
        doc.heading(2, "Attachments")
        doc.table([("Filename", "Type", "Bytes"), *attached])
        doc.info("attachments-not-converted", f"{len(attached)} attachments are listed but not converted")
    doc.meta["attachments"] = len(attached)
    return doc if not doc.blank() else doc.fail("empty", "empty-document", "the message has no text")


def archive_entries(source: Source) -> list[dict]:
    return [
        {"entry": safe_filename(i.filename.rstrip("/")), "size": i.file_size, "kind": "dir" if i.is_dir() else os.path.splitext(i.filename)[1] or "-"}
        for i in open_package(source).infolist()
    ]


@reads("archive/zip-listing", 10, "an inventory; nothing is extracted")
def read_archive(source: Source, options: Options) -> Document:
    doc = Document()
    try:
        entries = archive_entries(source)
    except zipfile.BadZipFile as e:
        return doc.fail("failed", "zip-invalid", str(e))
    except (UnsafeInput, OSError, RuntimeError) as e:
        return doc.fail("failed", "zip-rejected", str(e))
    doc.heading(1, f"Archive: {source.name}")
    total = sum(e["size"] for e in entries)
    sizes = {"Total uncompressed": total, "Compressed": len(source.raw)}
    doc.facts([("Entries", len(entries)), *((k, f"{n:,} bytes") for k, n in sizes.items())])
    doc.table([("Entry", "Size", "Type"), *((e["entry"], f"{e['size']:,}", re.sub(r"[|\s]", "_", e["kind"])) for e in entries[:500])])
    doc.meta["entries"] = len(entries)
    doc.info("archive-not-extracted", "the archive was listed, not converted")
    return doc

"""What a source is: extension tables, signatures and content sniffing."""

from __future__ import annotations

import codecs
import io
import json
import os
import re
import zipfile
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXTENSIONS = {
    "text": "txt text log nfo rst adoc asciidoc org tex", "markdown": "md markdown mdown mkd mdx", "csv": "csv tsv tab psv",
    "json": "json", "jsonl": "jsonl ndjson", "xml": "xml xsd xsl", "svg": "svg", "yaml": "yaml yml", "toml": "toml",
    "ini": "ini cfg conf properties env", "diff": "diff patch", "subtitle": "srt vtt ass ssa",
    "code": "py pyi js mjs cjs ts tsx jsx java kt kts scala go rs c h cc cpp hpp cs rb php swift m mm pl lua r jl sh bash zsh fish "
    "ps1 psm1 bat cmd sql graphql proto dockerfile makefile cmake gradle vue svelte dart ex exs erl clj hs elm zig nim v f90 asm",
    "html": "html htm xhtml", "docx": "docx docm dotx", "pptx": "pptx ppsx", "xlsx": "xlsx xlsm", "doc_legacy": "doc",
    "ppt_legacy": "ppt", "xls_legacy": "xls", "odf": "odt ods odp odg fodt", "rtf": "rtf", "epub": "epub",
    "mobi": "mobi azw azw3", "fb2": "fb2", "pdf": "pdf", "notebook": "ipynb", "email": "eml", "msg_legacy": "msg",
    "archive": "zip", "image": "png jpg jpeg gif bmp webp tif tiff ico heic", "unsupported_parquet": "parquet",
    "unsupported_binary": "sqlite db exe dll bin",
}
EXTENSIONS = {"." + e: key for key, all_ in _EXTENSIONS.items() for e in all_.split()}
_NAMES = {
    "code": "dockerfile makefile cmakelists.txt rakefile gemfile procfile", "markdown": "readme changelog",
    "text": "license .gitignore .dockerignore .gitattributes", "ini": ".editorconfig",
}
NAMES = {n: key for key, all_ in _NAMES.items() for n in all_.split()}
_LANGUAGES = {
    "python": "py pyi", "javascript": "js mjs cjs", "typescript": "ts", "kotlin": "kt kts", "rust": "rs", "cpp": "cc cpp hpp",
    "csharp": "cs", "ruby": "rb", "objectivec": "m mm", "perl": "pl", "julia": "jl", "bash": "sh bash", "powershell": "ps1 psm1",
    "batch": "bat cmd", "protobuf": "proto", "groovy": "gradle", "elixir": "ex exs", "erlang": "erl", "clojure": "clj",
    "haskell": "hs", "verilog": "v", "fortran": "f90", "xml": "xml xsd xsl svg", "yaml": "yaml yml", "jsonl": "jsonl ndjson",
    "diff": "diff patch", "latex": "tex", "asciidoc": "adoc", "dotenv": "env", "graphql": "graphql graphqls", "text": "txt", "c": "c h",
}
LANGUAGES = {"." + e: lang for lang, all_ in _LANGUAGES.items() for e in all_.split()}
LANGUAGES |= {
    "." + e: e
    for e in "tsx jsx java scala go php swift lua r zsh fish sql cmake vue svelte dart elm zig nim asm toml ini json rst org srt vtt ass ssa "
    "properties dockerfile makefile".split()
}
_MEDIA = """
text text/plain|ini text/plain|code text/plain|markdown text/markdown|html text/html|csv text/csv|diff text/x-diff|subtitle text/vtt
json application/json|xml application/xml|yaml application/yaml|toml application/toml|rtf application/rtf|pdf application/pdf
archive application/zip|epub application/epub+zip|jsonl application/x-ndjson|notebook application/x-ipynb+json|binary application/octet-stream
xls_legacy application/vnd.ms-excel|ppt_legacy application/vnd.ms-powerpoint|doc_legacy application/msword|email message/rfc822
xlsx application/vnd.openxmlformats-officedocument.spreadsheetml.sheet|pptx application/vnd.openxmlformats-officedocument.presentationml.presentation
docx application/vnd.openxmlformats-officedocument.wordprocessingml.document|odf application/vnd.oasis.opendocument.text|image image/*|svg image/svg+xml
"""
MEDIA_TYPES = dict(entry.split(" ") for entry in _MEDIA.strip().replace("\n", "|").split("|"))
FALLBACK_MEDIA = MEDIA_TYPES["binary"]
SIGNATURES = [
    ("255044462d", "pdf"), ("504b0304", "zip"), ("d0cf11e0a1b11ae1", "ole"), ("7b5c727466", "rtf"), ("89504e470d0a1a0a", "image"),
    ("ffd8ff", "image"), ("474946383761", "image"), ("474946383961", "image"), ("424d", "image"), ("49492a00", "image"),
    ("4d4d002a", "image"), ("52494646", "riff"), ("494433", "audio"), ("4f676753", "audio"), ("664c6143", "audio"),
    ("1a45dfa3", "video"), ("377abcaf271c", "unsupported_binary"), ("526172211a07", "unsupported_binary"),
    ("53514c69746520666f726d6174203300", "unsupported_binary"), ("50415231", "unsupported_parquet"), ("7f454c46", "unsupported_binary"),
    ("4d5a", "unsupported_binary"),
]
_MAGIC = [(bytes.fromhex(h), k) for h, k in SIGNATURES]
_TEXTUAL = {"text", "markdown", "csv", "json", "jsonl", "xml", "svg", "yaml", "toml", "ini", "diff", "subtitle", "code", "html", "notebook", "email"}
_HEAD = 8192


@dataclass(frozen=True)
class Format:
    key: str
    extension: str = ""
    media_type: str = FALLBACK_MEDIA
    language: str = ""
    confidence: str = "extension"
    text_encoding: str = "utf-8"
    note: str = ""

    # Formats that are only refused say so in their name.
    @property
    def supported(self) -> bool:
        return self.key.partition("_")[0] != "unsupported"

    def row(self) -> dict:
        return asdict(self)


def suffix(name: str) -> str:
    return os.path.splitext(os.path.basename(name.replace("\\", "/")))[1].lower()


def describe(key: str, ext: str, **more: str) -> Format:
    return Format(key, ext, MEDIA_TYPES.get(key, FALLBACK_MEDIA), LANGUAGES.get(ext, ""), **more)


def detect_encoding(raw: bytes) -> str:
    """The encoding that a text's bytes are in; UTF-8 and then GB18030 before any statistics."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if raw[: len(mark)] == mark:
            return name
    for name in ("utf-8", "gb18030"):
        try:
            raw.decode(name)
        except UnicodeDecodeError:
            continue
        return name
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return "utf-8"
    best = from_bytes(raw[: 1 << 16]).best()
    return best.encoding if best else "utf-8"


@dataclass(frozen=True)
class Text:
    text: str
    encoding: str
    had_errors: bool
    newline: str


def decode(raw: bytes) -> Text:
    encoding = detect_encoding(raw)
    try:
        text, bad = raw.decode(encoding), False
    except (UnicodeDecodeError, LookupError):
        text, bad = raw.decode(encoding if encoding != "utf-8-sig" else "utf-8", "replace"), True
    newline = next((n for n in ("\r\n", "\n", "\r") if n in text), "\n")
    return Text(re.sub(r"\r\n?", "\n", text), encoding, bad or "�" in text, newline)


def zip_kind(raw: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            names = set(z.namelist())
            for kind, part in {"xlsx": "xl/workbook", "pptx": "ppt/presentation", "docx": "word/document"}.items():
                if f"{part}.xml" in names:
                    return kind
            if "mimetype" in names:
                return "epub" if z.read("mimetype").startswith(b"application/epub") else "odf"
            booked = [n for n in names if n[:9] == "META-INF/"]
            return "epub" if booked else "archive"
    except (zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError):
        return "archive"


def looks_html(text: str) -> bool:
    head = text[:_HEAD // 4].lower()
    marked = re.search("<(?:!doctype html|html|head|body)", head)
    return marked is not None or len(re.findall(r"<(?:h[1-6]|li|ul|table|span|div|a|p)[\s>]", head)) >= 3


def looks_json(text: str) -> bool:
    text = text.lstrip()
    if text[:1] not in ("{", "["):
        return False
    try:
        json.loads(text)
    except ValueError:
        return bool(re.match(r'[{\[]\s*["}\]{]', text))
    return True


def looks_delimited(text: str) -> bool:
    lines = [x for x in text.split("\n") if x.strip()][:12]
    if not lines[1:]:
        return False
    for mark in ",\t;|":
        counts = [x.count(mark) for x in lines]
        if min(counts) >= 1 and max(counts) - min(counts) <= max(1, 0.34 * max(counts)):
            return True
    return False


def detect(name: str, raw: bytes, sniff: bool = True) -> Format:
    """Signature, then binary content, then (for plain or unknown names) text content."""
    ext = suffix(name)
    key = EXTENSIONS.get(ext) or NAMES.get(os.path.basename(name).lower(), "")
    if not sniff:
        return describe(key or "text", ext)
    head = raw[:_HEAD]
    for mark, kind in _MAGIC:
        if not head.startswith(mark):
            continue
        note = ""
        if kind == "zip":
            kind = zip_kind(raw)
        elif kind == "ole":
            kind = f"{ext[1:]}_legacy" if ext in (".msg", ".ppt", ".xls", ".doc") else "unsupported_binary"
        elif kind == "riff" and head.find(b"WEBP", 8, 12) == 8:
            kind = "image"
        elif kind in ("riff", "audio", "video"):
            kind, note = "unsupported_media", "audio or video, by its signature"
        return describe(kind, ext, confidence="magic", note=note)
    if b"\0" in head:
        if key and key not in _TEXTUAL:
            return describe(key, ext, confidence="extension")
        return describe("unsupported_binary", ext, confidence="content", note="holds NUL bytes")
    part = raw[: 1 << 16]
    if len(raw) > len(part):  # never judge a code point that the cut divides
        part = part[: len(part) - next((n for n in range(4) if _whole(part[: len(part) - n])), 0)]
    encoding = detect_encoding(part)
    if key in ("", "text"):
        text = part.decode(encoding if encoding != "utf-16" else "utf-8", "replace")
        for kind, test in (("html", looks_html), ("json", looks_json), ("csv", looks_delimited)):
            if test(text):
                return describe(kind, ext, text_encoding=encoding, confidence="content")
        if re.search(r"(?m)^#{1,6}\s+\S", text):
            return describe("markdown", ext, text_encoding=encoding, confidence="content")
        return describe("text", ext, text_encoding=encoding, confidence="extension" if key else "fallback")
    return describe(key, ext, text_encoding=encoding)


def _whole(raw: bytes) -> bool:
    try:
        raw[-8:].lstrip(bytes(range(0x80, 0xC0))).decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


# ---- as Columns, for text that is already in a table


@cache
def _map(kind: str) -> Column:
    table = {"extension": EXTENSIONS, "name": NAMES, "language": LANGUAGES, "media": MEDIA_TYPES}[kind]
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def lookup(kind: str, key: Column) -> Column:
    """Equi-lookup in a table that is part of the plan; null where it has no such key."""
    return F.try_element_at(_map(kind), key)


def suffix_column(name: Column) -> Column:
    base = F.lower(F.regexp_replace(F.regexp_replace(name, r"\\", "/"), r"^.*/", ""))
    return F.regexp_extract(base, r"^.+(\.[^.]+)$", 1)


def signature_column(content: Column) -> Column:
    """The first signature that the bytes start with, or null."""
    head = F.lower(F.hex(F.substring(content, 1, 16)))
    out = None
    for mark, kind in SIGNATURES:
        out = (F if out is None else out).when(head.startswith(mark), F.lit(kind))
    return out


def html_column(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 2048))
    return head.contains("<") & (head.rlike(r"<!doctype html|<html|<head|<body") | (F.regexp_count(head, F.lit(r"<(?:h[1-6]|li|ul|table|span|div|a|p)[\s>]")) >= 3))


def json_column(text: Column) -> Column:
    cut = F.regexp_replace(text, r"^\s+", "")
    valid = F.try_parse_json(cut).isNotNull()
    return F.substring(cut, 1, 1).isin("{", "[") & (valid | cut.rlike(r'^[{\[]\s*["}\]{]'))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def delimited_column(text: Column) -> Column:
    lines = F.slice(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1, 12)
    marks = F.array(*[F.lit(m) for m in ",\t;|"])
    even = lambda high, low: (low >= 1) & ((high - low) <= F.greatest(F.lit(1.0), high * F.lit(0.34)))
    count = lambda m: lambda x: F.length(x) - F.length(F.replace(x, m, F.lit("")))
    fits = lambda ls: F.exists(marks, lambda m: bind(F.transform(ls, count(m)), lambda n: even(F.array_max(n), F.array_min(n))))
    return bind(lines, lambda ls: (F.size(ls) >= 2) & fits(ls))


def markdown_column(text: Column) -> Column:
    return text.rlike(r"(?m)^#{1,6}\s+\S")


def text_format(text: Column) -> Column:
    """The format of a text without a name, by its content."""
    return (
        F.when(html_column(text), "html").when(json_column(text), "json").when(delimited_column(text), "csv")
        .when(markdown_column(text), "markdown").otherwise("text")
    )

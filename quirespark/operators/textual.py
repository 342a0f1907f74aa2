"""Readers of text, markup, configuration and subtitles."""

from __future__ import annotations

import configparser
import json
import re
import tomllib

from quirespark.functions import markdown as md
from quirespark.functions.formats import LANGUAGES
from quirespark.operators.chain import Source, reads
from quirespark.operators.html import html_title, html_to_markdown
from quirespark.schemas import Document, Options

_NUMBERED = re.compile(r"(\d+(?:[.]\d+)*)[).]?\s+(\S.{0,80})$")
_CHAPTER = re.compile(r"(?:第.{1,12}?[章节篇部]|Chapter\s+\d+).*$", re.I)


def promote_underlined(lines: list[str]) -> tuple[list[str], int]:
    """Titles underlined with three or more of one mark become headings of levels 1 and 2."""
    out, found, i = [], 0, 0
    while i < len(lines):
        title, rule = lines[i].strip(), lines[i + 1].strip() if i + 1 < len(lines) else ""
        if title and len(title) <= 120 and len(rule) >= 3 and rule[0] in "=-*_" and set(rule) == {rule[0]} and set(title) - set("=-*_ "):
            out.append(("# " if rule[0] == "=" else "## ") + title)
            found, i = found + 1, i + 2
        else:
            out.append(lines[i])
            i += 1
    return out, found


def promote_numbered(lines: list[str]) -> tuple[list[str], int]:
    out, found = [], 0
    for line in lines:
        bare = line.strip()
        m = _NUMBERED.match(bare)
        if m and len(m[2].strip()) >= 2:
            line, found = md.heading(min(m[1].count(".") + 1, 4), bare), found + 1
        elif len(bare) <= 100 and _CHAPTER.match(bare):
            line, found = md.heading(1, bare), found + 1
        out.append(line)
    return out, found


def plain_to_markdown(text: str, numbered: bool = False) -> tuple[str, int]:
    """Text with its real headings kept and everything that only looks like Markdown escaped."""
    found = 0
    lines = text.split("\n")
    if text.strip():
        lines, found = promote_underlined(lines)
        if numbered:
            lines, more = promote_numbered(lines)
            found += more
    # Headings split the text; what is between them is escaped by itself.
    out, run = [], []
    for line in lines:
        if re.match(r"#{1,6}\s+", line):
            out += [md.escape_structure("\n".join(run))] if run else []
            out.append(line)
            run = []
        else:
            run.append(line)
    out += [md.escape_structure("\n".join(run))] if run else []
    return "\n".join(out), found


def _uncertain(doc: Document, source: Source) -> None:
    if source.read.had_errors:
        doc.flag("encoding-uncertain", f"characters were replaced while decoding {source.read.encoding}")


@reads("text/plain-text", 10, "escaped text, underlined titles as headings")
def read_text(source: Source, options: Options) -> Document:
    doc = Document()
    _uncertain(doc, source)
    body, found = plain_to_markdown(source.text, options.numbered_headings)
    doc.add(body)
    doc.meta |= {"encoding": source.read.encoding, "headings_detected": found}
    if source.read.encoding not in PLAIN:
        doc.info("non-utf8-source", f"was {source.read.encoding}")
    return doc


PLAIN, MANY_LINKS = frozenset(("ascii", "utf-8", "utf-8-sig")), 50


def lift_front_matter(text: str) -> tuple[dict[str, str], str]:
    m = re.match(r"-{3}\s*\n(.*?)\n-{3}\s*\n?", text, re.S)
    if not m:
        return {}, text
    found = {}
    for line in m[1].split("\n"):
        key, colon, value = line.partition(":")
        if colon and not line.lstrip().startswith("-"):
            found[key.strip()] = value.strip().strip("\"'")
    return found, text[m.end() :]


@reads("markdown/markdown-passthrough", 10, "kept as it is, front matter lifted")
def read_markdown(source: Source, options: Options) -> Document:
    doc = Document()
    matter, body = lift_front_matter(source.text)
    if matter:
        doc.meta["front_matter"] = matter
        doc.title = matter.get("title", "")
    doc.add(body)
    levels = [len(x) for x in re.findall(r"^(#{1,6})\s+(?=\S)", body, re.M)]
    doc.meta |= {"headings": len(levels)}
    if not levels:
        doc.info("no-headings", "the text has no headings")
    elif 1 not in levels:
        doc.info("no-top-level-heading", "no heading is of the first level")
    _uncertain(doc, source)
    return doc


SYMBOLS = [
    (r"\s*(?:(?:export|async)\s+)*def\s+(\w+)", "def"), (r"\s*class\s+(\w+)", "class"),
    (r"\s*(?:(?:export|async)\s+)*function\s+(\w+)", "function"),
    (r"\s*(?:export\s+)?(?:var|let|const)\s+(\w+)\s*[=]\s*(?:async)?\s*\(", "function"),
    (r"\s*(?:(?:public|private|protected|static)\s+)*[\w<>\[\],]+(?:\s+[\w<>\[\],]+)*\s+(\w+)\s*[(][^;]*[)]\s*\{", "method"),
    (r"\s*func\s+(?:[(][^)]*[)]\s*)?(\w+)", "func"), (r"\s*(?:pub\s+)?(?:struct|enum|trait|fn)\s+(\w+)", "item"),
    (r"\s*(?:create|CREATE)\s+(?:INDEX|VIEW|TABLE)\s+([\w.\"]+)", "object"), (r"\s*[#]{1,6}\s*(.+)$", "section"),
]
_SYMBOLS = [(re.compile(p), kind) for p, kind in SYMBOLS]


def outline(text: str, most: int = 200) -> list[tuple[str, str, int]]:
    """(name, kind, line) of the symbols that a source text defines, each once."""
    found: dict[tuple[str, str], int] = {}
    for n, line in enumerate(text.split("\n"), 1):
        if len(line) > 300 or len(found) >= most:
            continue
        for pattern, kind in _SYMBOLS:
            m = pattern.match(line)
            if m:
                if m[1].strip():
                    found.setdefault((m[1].strip(), kind), n)
                break
    return [(name, kind, n) for (name, kind), n in found.items()]


@reads("code/source-code", 10, "fenced source under an outline of its symbols")
def read_code(source: Source, options: Options) -> Document:
    doc = Document()
    language = LANGUAGES.get(source.ext, source.ext.lstrip("."))
    if options.code_outline:
        symbols = outline(source.text)
        if symbols:
            doc.add("## Outline\n\n" + "\n".join(f"- `{s}` ({kind}) — line {at}" for s, kind, at in symbols))
    doc.fenced(source.text, language)
    doc.meta |= {"language": language, "lines": source.text.count("\n") + 1}
    _uncertain(doc, source)
    return doc


@reads("ini/config-ini", 10, "sections as headings, settings as tables")
def read_ini(source: Source, options: Options) -> Document:
    doc = Document()
    found = configparser.RawConfigParser(delimiters=(":", "="), strict=False)
    try:
        found.read_string(source.text)
    except configparser.Error as e:
        doc.flag("config-parse-failed", f"kept as raw text: {e}")
        doc.fenced(source.text, "ini")
        return doc
    for name in found.sections():
        doc.heading(2, name)
        doc.facts(found.items(name))
    if found.defaults():
        doc.heading(2, "(defaults)")
        doc.facts(found.defaults().items())
    if not doc.parts:
        doc.fenced(source.text, "ini")
    doc.meta |= {"sections": len(found.sections())}
    return doc


@reads("yaml/config-yaml", 10, "fenced, top-level keys listed", needs="yaml")
def read_yaml(source: Source, options: Options) -> Document:
    import yaml

    doc = Document()
    doc.fenced(source.text, "yaml")
    try:
        data = yaml.safe_load(source.text)
    except Exception as e:  # noqa: BLE001 - whatever is wrong, the text itself is kept
        doc.flag("yaml-parse-failed", f"kept as raw text: {e}")
        return doc
    if isinstance(data, dict):
        doc.meta |= {"top_level_keys": [str(k) for k in data][:50]}
    if isinstance(data, list):
        doc.meta |= {"items": len(data)}
    return doc


@reads("yaml/config-yaml-raw", 90, "fenced only")
def read_yaml_raw(source: Source, options: Options) -> Document:
    doc = Document()
    doc.fenced(source.text, "yaml")
    doc.info("no-yaml-parser", "no YAML parser is installed")
    return doc


@reads("toml/config-toml", 10, "scalars and tables as Markdown tables")
def read_toml(source: Source, options: Options) -> Document:
    doc = Document()
    try:
        data = tomllib.loads(source.text)
    except tomllib.TOMLDecodeError as e:
        doc.flag("toml-parse-failed", f"kept as raw text: {e}")
        doc.fenced(source.text, "toml")
        return doc
    doc.facts((k, v) for k, v in data.items() if type(v) not in (list, dict))
    for name, inner in data.items():
        if isinstance(inner, dict):
            doc.heading(2, name)
            doc.facts((k, json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (list, dict)) else str(v)) for k, v in inner.items())
    doc.folded("Raw TOML", md.fence(source.text, "toml"))
    return doc


def diff_stats(text: str) -> tuple[int, int, int]:
    """(files, lines added, lines removed); both sides of a file count."""
    lines = text.split("\n")
    names = {m[1] for m in re.finditer(r"^(?:-{3}|\+{3})\s+([^\n\t]+)", text, re.M)} - {"/dev/null"}
    return len(names), sum(x[:1] == "+" and x[:3] != "+++" for x in lines), sum(x[:1] == "-" and x[:3] != "---" for x in lines)


@reads("diff/diff-patch", 10, "counts and the fenced patch")
def read_diff(source: Source, options: Options) -> Document:
    doc = Document()
    doc.facts(zip(("Files touched", "Lines added", "Lines removed"), diff_stats(source.text)))
    doc.fenced(source.text, "diff")
    return doc


Cue = tuple[float | None, float | None, str]


def cues(text: str) -> list[Cue]:
    """(start, end, text) of SRT, VTT and ASS subtitles."""
    if re.search(r"^\[(?:Script Info|Events)\]", text, re.M):
        rows = (x.split(",", 9) for x in text.split("\n") if x.startswith("Dialogue:"))
        return [(md.seconds(r[1]), md.seconds(r[2]), md.squash(re.sub(r"\\[Nn]", " ", re.sub(r"[{][^}]*[}]", "", r[9])))) for r in rows if len(r) == 10]
    out: list[Cue] = []
    for block in md.blocks(text.strip()):
        lines = [x for x in block.split("\n") if x.strip()]
        for mark in (r"\s*(?:WEBVTT|NOTE)", r"\s*\d+\s*$"):
            if lines and re.match(mark, lines[0], re.I):
                del lines[0]
        if not lines:
            continue
        times = lines[0].split("-->", 1)
        arrow, left, right = len(times) == 2, times[0], times[-1]
        said = md.squash(" ".join(lines[1:] if arrow else lines))
        if said:
            out.append((md.seconds(left), md.seconds(right), said) if arrow else (None, None, said))
    return out


@reads("subtitle/subtitle", 10, "cues with their times")
def read_subtitle(source: Source, options: Options) -> Document:
    doc = Document()
    found = cues(source.text)
    if not found:
        doc.flag("no-cues", "no subtitle cue was recognised")
        doc.fenced(source.text, "text")
        return doc
    if options.subtitle_table:
        doc.table([("Start", "End", "Text"), *((md.clock(a), md.clock(b), t) for a, b, t in found)])
    else:
        for begin, _, line in found:
            doc.add(f"**[{md.clock(begin)}]** {line}")
    doc.meta["cues"] = len(found)
    if found[0][0] is not None:
        last = found[-1]
        doc.meta |= {"duration": md.clock(last[1] or last[0])}
    return doc


def svg_labels(text: str) -> list[str]:
    inner = re.findall(r"<(?:desc|title|t(?:span|ext))\b[^<>]*>(.*?)</(?:desc|title|t(?:span|ext))>", text, re.S | re.I)
    return [x for x in (md.squash(re.sub("<[^<>]+>", "", i)) for i in inner) if x]


@reads("svg/svg", 10, "labels and source")
def read_svg(source: Source, options: Options) -> Document:
    doc = Document()
    labels = svg_labels(source.text)
    if labels:
        doc.heading(2, "Text in image")
        doc.add(md.bullets(labels))
    doc.folded("SVG source", md.fence(source.text, "xml"))
    doc.meta["labels"] = len(labels)
    if not labels:
        doc.info("no-text-in-svg", "no label was found in the drawing")
    return doc


@reads("html/html", 10, "structured Markdown without page chrome")
def read_html(source: Source, options: Options) -> Document:
    doc = Document()
    doc.title = html_title(source.text, engine=options.html_engine)
    body, stats, engine = html_to_markdown(
        source.text, engine=options.html_engine, keep_links=options.keep_links, keep_images=options.keep_images, drop_chrome=options.drop_chrome
    )
    if not body.strip():
        return doc.fail("empty", "empty-html", "the page has no content to convert")
    doc.add(body)
    doc.meta |= {**stats, "engine": engine}
    if not stats["headings"]:
        doc.info("no-headings", "the page has no headings")
    _uncertain(doc, source)
    external = len(re.findall(r"[\]][(]https?:/", body))
    if options.keep_links and external > MANY_LINKS:
        doc.info("link-heavy", f"{external} links to other sites")
    return doc

"""Readers of delimited data, JSON, XML and notebooks."""

from __future__ import annotations

import csv
import io
import json
import re
from collections import Counter
from typing import Any

from quirespark.functions import markdown as md
from quirespark.operators.chain import Source, reads
from quirespark.operators.textual import _uncertain
from quirespark.schemas import Document, Options


def sniff_delimiter(text: str) -> str:
    """The mark that is on each of the first twenty lines most evenly; a comma if none is."""
    lines = [x for x in text.split("\n") if x.strip()][:20]
    best, score = ",", float("-inf")
    for mark in ",\t;|:":
        n = [x.count(mark) for x in lines]
        if n and min(n) >= 1 and (s := sum(n) / len(n) - (max(n) - min(n))) > score:
            best, score = mark, s
    return best


def delimited_rows(text: str, delimiter: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text), delimiter=delimiter))


@reads("csv/delimited", 10, "a table, or a fenced block with a preview")
def read_csv(source: Source, options: Options) -> Document:
    doc = Document()
    mark = options.delimiter or sniff_delimiter(source.text)
    try:
        rows = delimited_rows(source.text, mark)
    except csv.Error as e:
        doc.flag("csv-parse-failed", f"kept as raw text: {e}")
        doc.fenced(source.text, "csv")
        return doc
    rows = [r for r in rows if "".join(r).strip()]
    if not rows:
        return doc.fail("empty", "empty-file", "there is no row with data")
    width = max(map(len, rows))
    ragged = sum(len(r) != width for r in rows)
    doc.meta |= {"encoding": source.read.encoding, "columns": width, "rows": len(rows), "delimiter": mark}
    _uncertain(doc, source)
    if ragged:
        doc.info("ragged-rows", f"{ragged} rows are narrower than the widest of {width} and were padded")
    if len(rows) > options.csv_max_rows + 1 or width > options.csv_max_cols:
        doc.info("table-too-large", f"over the limits, {len(rows)} x {width} to {options.csv_max_rows} x {options.csv_max_cols}")
        doc.heading(2, "Data")
        doc.fenced(source.text, "csv")
        preview = md.table(rows[: options.csv_max_rows + 1], header=options.csv_header)
        doc.folded(f"Preview (first {options.csv_max_rows} rows as a table)", preview)
        return doc
    doc.table(rows, header=options.csv_header)
    if not options.csv_header:
        doc.info("no-header", "the first row is data")
    return doc


def flatten(value: Any, deepest: int = 6, shown: int = 3) -> dict[str, Any]:
    """Dotted paths and their values; arrays of objects show their first ones."""
    out: dict[str, Any] = {}

    def visit(v: Any, path: str, depth: int) -> None:
        here = path or "(root)"
        if depth > deepest:
            out[here] = "…"
        elif isinstance(v, dict):
            for k, inner in v.items():
                visit(inner, f"{path}.{k}" if path else str(k), depth + 1)
        elif isinstance(v, list):
            if all(not isinstance(x, (dict, list)) for x in v):
                out[here] = ", ".join(md.inline_value(x) for x in v)
            elif all(isinstance(x, dict) for x in v):
                out[here] = f"[{len(v)} objects]"
                for i, x in enumerate(v[:shown]):
                    visit(x, f"{path}[{i}]", depth + 1)
            else:
                out[here] = f"[{len(v)} items]"
        else:
            out[here] = v

    visit(value, "", 0)
    return out


def _nested(value: Any) -> bool:
    return isinstance(value, (list, dict))


def tabular(value: Any, widest: int = 24) -> list[list[Any]] | None:
    """Rows with a header, if the value is a flat object or a list of such; else None."""
    if isinstance(value, dict):
        whole = value and not any(map(_nested, value.values()))
        return [["Key", "Value"], *([key, str(inner)] for key, inner in value.items())] if whole else None
    if not isinstance(value, list) or not value or not all(isinstance(x, dict) for x in value):
        return None
    keys = list(dict.fromkeys(k for x in value for k in x))
    if not keys or len(keys) > widest or any(_nested(v) for x in value for v in x.values()):
        return None
    return [keys, *([md.inline_value(x.get(k)) for k in keys] for x in value)]


def kind_of(value: Any) -> str:
    return type(value).__name__


def shape(data: Any) -> dict[str, Any]:
    out = {"Root type": kind_of(data)}
    if isinstance(data, dict):
        out |= {"Keys": len(data), "Top-level keys": ", ".join([str(k) for k in data][:20])}
    if isinstance(data, list):
        out |= {"Items": len(data)} | {"Item type": kind_of(x) for x in data[:1]}
    return out


@reads("json/json", 10, "shape, table or fields, and the source")
def read_json(source: Source, options: Options) -> Document:
    doc = Document()
    try:
        data = json.loads(source.text)
    except (ValueError, RecursionError) as e:
        doc.flag("json-parse-failed", f"kept as raw text: {e}")
        doc.fenced(source.text, "json")
        return doc
    _uncertain(doc, source)
    doc.facts(shape(data).items())
    doc.meta["root_type"] = kind_of(data)
    nested = _nested(data)
    if nested:
        doc.meta["size"] = len(data)
    rows = tabular(data)
    if rows and options.json_table:
        if len(rows) > options.json_max_rows + 1:
            doc.info("table-too-large", f"over {options.json_max_rows} rows: {len(rows)}")
        else:
            doc.heading(2, "Data")
            doc.table(rows)
    elif rows is None and nested:
        flat = flatten(data)
        if flat and len(flat) < 401:
            doc.heading(2, "Fields")
            doc.table([("Path", "Value"), *flat.items()])
    doc.folded("Raw JSON", md.fence(json.dumps(data, indent=2, ensure_ascii=False), "json"))
    return doc


@reads("jsonl/jsonl", 10, "records as a table or fenced")
def read_jsonl(source: Source, options: Options) -> Document:
    doc, records, bad = Document(), [], 0
    for line in filter(None, map(str.strip, source.text.split("\n"))):
        try:
            records.append(json.loads(line))
        except (ValueError, RecursionError):
            bad += 1
    if not records:
        return doc.fail("empty", "empty-file", "no line holds valid JSON")
    doc.meta["records"] = len(records)
    doc.facts({"Records": len(records), "Root types": ", ".join(sorted(set(map(kind_of, records))))}.items())
    if bad > 0:
        doc.flag("jsonl-bad-lines", f"{bad} lines are not valid JSON and were left out")
    rows = tabular(records)
    doc.heading(2, "Records")
    if rows and len(rows) <= options.json_max_rows + 1:
        doc.table(rows)
    else:
        doc.info("table-too-large", f"shown as JSON: {len(records)} records")
        doc.fenced("\n".join(json.dumps(r, ensure_ascii=False) for r in records[: options.json_max_rows]), "json")
    return doc


@reads("xml/xml", 10, "element counts and the source")
def read_xml(source: Source, options: Options) -> Document:
    doc = Document()
    tags = re.findall(r"<\s*([_A-Za-z][\w:.-]*)", source.text)
    if tags:
        counts = Counter(tags)
        named = ("Root element", "Elements", "Distinct tags")
        doc.facts(zip(named, (tags[0], len(tags), len(counts))))
        doc.heading(2, "Most frequent elements")
        doc.table([("Tag", "Count"), *counts.most_common(15)])
    else:
        doc.flag("no-elements", "no element was recognised")
    doc.folded("Raw XML", md.fence(source.text, "xml"))
    doc.meta["elements"] = len(tags)
    return doc


def _cell_output(output: dict) -> str:
    kind, out = output.get("output_type"), []
    if output.get("name"):
        out.append("<!-- output: %s -->" % output["name"])
    data = output.get("data", {}) if kind in ("display_data", "execute_result") else {}
    shown = output.get("text", "") if kind == "stream" else data.get("text/markdown", data.get("text/plain"))
    out.append("".join(shown or ""))
    picture = "".join(data.get("image/png", ""))
    if picture:
        out.append(f"*(PNG output of {len(picture) // 4} B, not extracted)*")
    if kind == "error":
        trace = re.sub("\x1b\\[[\\d;]*m", "", "\n".join(output.get("traceback") or []))
        out.append(trace or ": ".join(str(output.get(k)) for k in ("ename", "evalue")))
    return "\n".join(filter(None, out)).strip()


@reads("notebook/jupyter", 10, "cells and their outputs")
def read_notebook(source: Source, options: Options) -> Document:
    doc = Document()
    try:
        book = json.loads(source.text)
    except ValueError as e:
        doc.flag("notebook-parse-failed", f"kept as raw text: {e}")
        doc.fenced(source.text, "json")
        return doc
    cells, meta = book.get("cells", []), book.get("metadata", {})
    info = meta.get("language_info") or {}
    names = [n for n in (d.get("name") for d in (meta.get("kernelspec") or {}, info)) if n]
    doc.meta |= {"kernel": n for n in names[:1]}
    doc.meta |= {"cells": len(cells), "code_cells": sum(c.get("cell_type") == "code" for c in cells)}
    if not cells:
        return doc.fail("empty", "no-cells", "the notebook has no cells")
    for n, c in enumerate(cells, 1):
        body = "".join(c.get("source", []))
        match c.get("cell_type"):
            case "markdown":
                doc.add(body)
            case "code":
                doc.fenced(body, info.get("name", "python"))
                for shown in filter(None, map(_cell_output, c.get("outputs", []) if options.notebook_outputs else [])):
                    doc.add("\n\n".join(("**Output:**", md.fence(shown, "text"))))
            case "raw":
                doc.fenced(body, "text")
            case other:
                doc.info("unknown-cell-type", f"{other!r} is the type of cell {n}")
    return doc

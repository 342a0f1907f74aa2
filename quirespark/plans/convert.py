"""Conversion of rows (name, content) to Markdown and diagnostics: one lazy plan."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from quirespark.functions import markdown as md
from quirespark.functions.formats import Format, describe, detect, suffix
from quirespark.operators.chain import Registry, Source, load
from quirespark.schemas import DOCUMENT_FIELDS, FORMAT_TYPE, SEVERITY_RANK, Document, Options, as_text

RESULT_FIELDS = f"format {FORMAT_TYPE}, converter string, {DOCUMENT_FIELDS}, error string, elapsed_ms double"
_FACTS = "author creator language date pages sheets slides rows".split()


def convert_one(name: str, raw: bytes | None, options: Options, registry: Registry) -> dict:
    """One source's result. Every failure is a diagnosis in the row."""
    began = time.perf_counter()
    doc, fmt, converter, error = Document(), Format("unsupported_format", suffix(name)), "", ""
    try:
        if raw is None:
            doc.fail("failed", "not-a-file", f"{name} cannot be read")
        elif options.force_format:
            fmt = describe(options.force_format, suffix(name), confidence="forced")
        elif options.sniff and options.max_bytes is not None and len(raw) > options.max_bytes:
            doc.fail("failed", "security-limit", f"{len(raw)} bytes are over the limit of {options.max_bytes}")
        else:
            fmt = detect(name, raw, options.sniff)
        if doc.status != "failed":
            made = registry.run(fmt.key, Source(name, raw), options)
            doc, converter = made.document, made.converter
    except Exception as e:  # noqa: BLE001 - one row's failure is never the job's
        doc, error = Document().fail("failed", "internal-error", f"{type(e).__name__}: {e}"), str(e)
    if doc.status == "failed" and not error:
        error = "; ".join(w["message"] for w in doc.warnings if w["severity"] == "error")
    return {
        "format": fmt.row(), "converter": converter, "title": doc.title, "parts": doc.parts, "assets": doc.assets,
        "warnings": doc.warnings, "meta": {k: as_text(v) for k, v in doc.meta.items()}, "status": doc.status,
        "error": error or None, "elapsed_ms": round((time.perf_counter() - began) * 1000, 1),
    }


def convert(sources: DataFrame, options: Options | None = None, name_col: str = "name", content_col: str = "content", batch_bytes: int = 8 << 20) -> DataFrame:
    """The columns of ``sources`` but the content, and format, converter, title, parts, assets,
    warnings, meta, status, error, elapsed_ms.

    Content may be binary or text. Rows are converted independently: no shuffle. Results leave
    the worker in batches of about ``batch_bytes``, so that a task holds few documents.
    """
    options = options or Options()
    kept = [c for c in sources.columns if c != content_col]
    schema = StructType([sources.schema[c] for c in kept] + list(_parse_datatype_string(RESULT_FIELDS)))
    arrow = to_arrow_schema(schema)
    at = kept.index(name_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = load()
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                values = [batch.column(c)[i].as_py() for c in range(len(kept))]
                raw = batch.column(len(kept))[i].as_py()
                raw = raw.encode("utf-8", "surrogatepass") if isinstance(raw, str) else raw
                made = convert_one(values[at] or "", raw, options, registry)
                made["meta"] = list(made["meta"].items())
                rows.append({**dict(zip(kept, values)), **made})
                held += len(raw or b"")
                if held >= batch_bytes:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return sources.select(*kept, content_col).mapInArrow(work, schema)


def front_matter_of(name: str, fmt: dict, converter: str, title: str, meta: dict, status: str, warnings: list[dict], stamp: str) -> str:
    data = {"source": name, "format": fmt["key"], "converter": converter, "converted": stamp, "title": (title or "")[:200]}
    data |= {k: meta[k] for k in _FACTS if k in meta}
    if status != "ok":
        data["fidelity"] = status
    codes = sorted({w["code"] for w in warnings if w["severity"] != "info"})
    return md.front_matter(data | ({"warnings": codes} if codes else {}))


def report_of(name: str, fmt: dict, converter: str, meta: dict, status: str, warnings: list[dict], elapsed_ms: float) -> str:
    facts = [("Source", name), ("Detected as", f"{fmt['key']} ({fmt['media_type']})"), ("Identified by", fmt["confidence"]), ("Converter", converter),
             ("Status", status), ("Time", f"{elapsed_ms:.0f} ms")]
    blocks = ["<!-- conversion-report -->\n## Conversion report", md.kv_table(facts, key_header="Item")]
    shown = [(k, v) for k, v in meta.items() if k != "front_matter"][:20]
    if shown:
        blocks += ["**Extracted facts**", md.kv_table(shown, key_header="Key")]
    for severity in sorted({w["severity"] for w in warnings}, key=lambda s: SEVERITY_RANK.get(s, 3)):
        of = [w for w in warnings if w["severity"] == severity]
        blocks += [f"**{severity.capitalize()} ({len(of)})**", "\n".join(f"- `{w['code']}` — {w['message']}" for w in of)]
    if not warnings:
        blocks.append("No issues detected.")
    return "\n\n".join([*blocks, "<!-- /conversion-report -->"])


def assembled(results: DataFrame, options: Options | None = None, name_col: str = "name") -> DataFrame:
    """``results`` with markdown: front matter, title, body and report as the options say.

    Body and title come from Column functions; front matter and report are made in one
    vectorised pass over their small inputs.
    """
    from quirespark.functions import columns as C

    options = options or Options()

    @F.pandas_udf("struct<front:string,report:string>")
    def extras(inputs):
        import pandas as pd

        out = []
        for r in inputs.to_dict("records"):
            meta, warnings, fmt = dict(r["meta"] or {}), list(r["warnings"] if r["warnings"] is not None else []), r["format"]
            warnings = [w if isinstance(w, dict) else w.asDict() for w in warnings]
            fmt = fmt if isinstance(fmt, dict) else fmt.asDict()
            out.append((
                front_matter_of(r["name"], fmt, r["converter"], r["title"], meta, r["status"], warnings, r["stamp"]) if options.front_matter else "",
                report_of(r["name"], fmt, r["converter"], meta, r["status"], warnings, r["elapsed_ms"]) if options.report else "",
            ))
        return pd.DataFrame(out, columns=["front", "report"])

    body = C.body_of(F.col("parts"))
    if not (options.front_matter or options.report):
        return results.withColumn("markdown", C.assemble(F.lit(None).cast("string"), F.col("title"), body, F.lit(None).cast("string")))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    given = F.struct(F.col(name_col).alias("name"), "format", "converter", "title", "meta", "status", "warnings", "elapsed_ms", stamp.alias("stamp"))
    made = results.withColumn("__extra", extras(given))
    return made.withColumn("markdown", C.assemble(F.col("__extra.front"), F.col("title"), body, F.col("__extra.report"))).drop("__extra")

"""The row model: documents, warnings, assets, statuses, and their Spark types."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Sequence
from typing import Any

from quirespark.functions import markdown as md

STATUS_RANK = {s: n for n, s in enumerate("ok partial failed empty".split())}
SEVERITY_RANK = {s: n for n, s in enumerate("error warning info".split())}
BAD_STATUSES = ("empty", "failed")

WARNING_TYPE = "struct<code:string,message:string,severity:string>"
ASSET_TYPE = "struct<filename:string,data:binary,media_type:string,origin:string>"
FORMAT_TYPE = "struct<key:string,extension:string,media_type:string,language:string,text_encoding:string,confidence:string,note:string>"
DOCUMENT_FIELDS = (
    f"title string, parts array<string>, assets array<{ASSET_TYPE}>, warnings array<{WARNING_TYPE}>, "
    "meta map<string,string>, status string"
)


class Document:
    """What one reader makes of one source: a builder of parts, facts and diagnoses."""

    def __init__(self, parts: list[str] | None = None) -> None:
        self.parts = parts or []
        self.title, self.status = "", "ok"
        self.assets: list[dict] = []
        self.warnings: list[dict] = []
        self.meta: dict[str, Any] = {}

    # -- content

    def add(self, part: str | None) -> None:
        if part and part.strip():
            self.parts.append(part)

    def heading(self, level: int, text: str) -> None:
        self.add(md.heading(level, text))

    def table(self, rows: Iterable[Sequence[Any]], header: bool = True) -> None:
        self.add(md.table(rows, header))

    def facts(self, pairs: Iterable[tuple[Any, Any]], key_header: str = "Field") -> None:
        self.add(md.kv_table(pairs, key_header))

    def fenced(self, text: str, language: str = "") -> None:
        self.add(md.fence(text, language))

    def folded(self, summary: str, body: str) -> None:
        self.add(md.details(summary, body))

    def asset(self, filename: str, data: bytes, media_type: str, origin: str) -> None:
        self.assets.append({"filename": filename, "data": data, "media_type": media_type, "origin": origin})

    # -- diagnoses

    def _say(self, severity: str, code: str, message: str) -> None:
        self.warnings.append({"code": code, "message": message, "severity": severity})

    def info(self, code: str, message: str) -> None:
        self._say("info", code, message)

    def flag(self, code: str, message: str) -> None:
        """A warning: the document is partial from now on, if it was whole."""
        self._say("warning", code, message)
        self.status = "partial" if self.status == "ok" else self.status

    def fail(self, status: str, code: str, message: str) -> Document:
        self.worsen(status)
        self._say("error", code, message)
        self.status = "partial" if self.status == "ok" else self.status
        return self

    def error(self, code: str, message: str) -> None:
        self.fail(self.status, code, message)

    def worsen(self, status: str) -> None:
        if STATUS_RANK[status] >= STATUS_RANK[self.status]:
            self.status = status

    # -- what has been built

    @property
    def markdown(self) -> str:
        return body_of(self.parts)

    def blank(self) -> bool:
        return self.markdown == ""


def body_of(parts: list[str]) -> str:
    """Parts as one body: blank lines between, never more than one, one newline at the end."""
    whole = re.sub("\n\n\n+", "\n\n", "\n\n".join(part.strip("\n") for part in parts)).strip()
    return f"{whole}\n" if whole else ""


def as_text(value: Any) -> str:
    """A meta value as the string that the meta map holds; nested ones as JSON."""
    if isinstance(value, str):
        return value
    if isinstance(value, bool) or value is None or isinstance(value, (list, dict, tuple)):
        return json.dumps(value, default=str, ensure_ascii=False)
    return str(value)


_SWITCHED_ON = (
    "code_outline csv_header drop_chrome extract_images front_matter json_table keep_going keep_images keep_links mirror notebook_outputs "
    "pdf_page_markers pdf_tables pptx_notes pptx_tables report sniff write_assets"
)
_SWITCHED_OFF = "debug eml_prefer_html numbered_headings overwrite pdf_page_details report_json subtitle_table"
_NUMBERS = {"csv_max_cols": 16, "csv_max_rows": 50, "json_max_rows": 200, "max_bytes": 512 << 20, "xlsx_max_rows": 200}
_CHOICES = {"assets_dir": "assets", "delimiter": None, "force_format": None, "html_engine": "auto", "output_dir": None, "pdf_max_pages": None, "suffix": ".md"}
#: Accepted, without effect.
_IDLE = {"min_heading_len": 2, "recurse_archives": False}
DEFAULTS = dict.fromkeys(_SWITCHED_ON.split(), True) | dict.fromkeys(_SWITCHED_OFF.split(), False) | _NUMBERS | _CHOICES | _IDLE


class Options:
    """Every knob of a conversion, as attributes. Unknown names are ignored by of()."""

    def __init__(self, **values: Any) -> None:
        vars(self).update(DEFAULTS | values)

    @classmethod
    def of(cls, values: dict[str, Any] | None = None, **more: Any) -> Options:
        """Options of the given values; None leaves a default as it is."""
        return cls(**{k: v for k, v in {**(values or {}), **more}.items() if k in DEFAULTS and v is not None})

    def as_dict(self) -> dict[str, Any]:
        """All values by name; paths as text."""
        return {k: os.fspath(v) if isinstance(v, os.PathLike) else v for k, v in vars(self).items()}

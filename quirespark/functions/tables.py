"""Table functions (UDTFs) over texts, and the functions registered for SQL."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.udtf(returnType="cue int, start double, end double, text string")
class Cues:
    """The cues of a subtitle text."""

    def eval(self, text: str):
        from quirespark.operators.textual import cues

        for n, (start, end, said) in enumerate(cues(text or ""), 1):
            yield n, start, end, said


@F.udtf(returnType="name string, kind string, line int")
class Outline:
    """The symbols that a source text defines."""

    def eval(self, text: str):
        from quirespark.operators.textual import outline

        yield from outline(text or "")


@F.udtf(returnType="level int, title string, line int")
class Headings:
    def eval(self, text: str):
        import re

        for n, line in enumerate((text or "").split("\n"), 1):
            m = re.match(r"(#{1,6})\s+(\S.*)", line)
            if m:
                yield len(m[1]), m[2].strip(), n


@F.udtf(returnType="path string, value string")
class JsonPaths:
    """Dotted paths of a JSON text; none if it is not valid."""

    def eval(self, text: str):
        from quirespark.functions.markdown import inline_value
        from quirespark.operators.structured import flatten

        try:
            data = json.loads(text or "")
        except ValueError:
            return
        for path, value in flatten(data).items():
            yield path, inline_value(value)


@F.udtf(returnType="entry string, size bigint, kind string")
class ArchiveEntries:
    def eval(self, content: bytes):
        from zipfile import BadZipFile

        from quirespark.operators.books import archive_entries
        from quirespark.operators.chain import Source

        try:
            found = archive_entries(Source("", bytes(content or b"")))
        except (BadZipFile, ValueError, OSError):
            return
        for e in found:
            yield e["entry"], e["size"], e["kind"]


@F.pandas_udf(StringType())
def html_markdown(html: pd.Series) -> pd.Series:
    from quirespark.operators.html import html_to_markdown

    return html.map(lambda h: html_to_markdown(h or "")[0])


@F.pandas_udf(StringType())
def text_markdown(text: pd.Series) -> pd.Series:
    from quirespark.operators.textual import plain_to_markdown

    return text.map(lambda t: plain_to_markdown(t or "")[0])


@F.pandas_udf(StringType())
def rtf_text(text: pd.Series) -> pd.Series:
    from quirespark.operators.office import strip_rtf

    return text.map(lambda t: strip_rtf(t or ""))


@F.pandas_udf(StringType())
def file_name(name: pd.Series) -> pd.Series:
    from quirespark.functions.safety import safe_filename

    return name.map(lambda n: safe_filename(n or ""))


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL, under names that begin with md_."""
    for name, fn in (("cues", Cues), ("outline", Outline), ("headings", Headings), ("json_paths", JsonPaths), ("archive_entries", ArchiveEntries)):
        spark.udtf.register(f"md_{name}", fn)
    for name, fn in (("html", html_markdown), ("text", text_markdown), ("rtf", rtf_text), ("file_name", file_name)):
        spark.udf.register(f"md_{name}", fn)

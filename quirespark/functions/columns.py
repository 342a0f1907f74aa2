"""Text, table and document functions as Columns: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ITEM = r"^\s{0,3}(?:[*+-]|\d+[).])\s+\S"
_THREE_ITEMS = r"(?m)(?:^\s{0,3}(?:[*+-]|\d+[).])[ \t]+\S.*(?:\n|$)){3}"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squash(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"[\r\n]", " "), r"[ \t 　]+", " "))


def clean_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def escape_inline(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]<>|])", r"\\$1")


def escape_block_lines(text: Column) -> Column:
    """Every line's block-starting token gets a backslash before it."""
    return F.regexp_replace(text, r"(?m)^( {0,3})(#{1,6}(?= )|>|[-*+](?= )|\d+[.)](?= )|```|~~~|\|)", r"$1\\$2")


def escape_structure(text: Column) -> Column:
    """Blocks with three list items in a row keep their items; all other lines are escaped.

    Whether a block is such a list is asked once a block, and the others are escaped whole, so
    the work is linear in the text.
    """
    blocks = F.split(text, r"\n\s*\n")
    trimmed = lambda x: F.regexp_replace(x, r"(?md)[ \t\x0B\f\r]+$", "")

    def block(b: Column) -> Column:
        items = F.transform(_lines(b), lambda x: F.when(x.rlike(_ITEM), x).otherwise(escape_block_lines(x)))
        return trimmed(F.when(b.rlike(_THREE_ITEMS), F.array_join(items, "\n")).otherwise(escape_block_lines(b)))

    return F.array_join(F.transform(blocks, block), "\n\n")


def paragraphs(text: Column) -> Column:
    trimmed = F.transform(F.split(text, r"\n\s*\n"), lambda b: F.regexp_replace(F.regexp_replace(b, r"(?md)[ \t\r]+$", ""), r"^\n+|\n+$", ""))
    return F.array_join(F.filter(trimmed, lambda b: F.trim(b) != ""), "\n\n")


def longest_ticks(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length)), F.lit(0))


def fence(text: Column, language: Column | str = "", least: int = 3) -> Column:
    run = longest_ticks(text)
    ticks = F.repeat(F.lit("`"), F.when(run >= least, run + 1).otherwise(least))
    lang = F.lit(language) if isinstance(language, str) else language
    return F.concat(ticks, lang, F.lit("\n"), F.regexp_replace(text, r"^\n+|\n+$", ""), F.lit("\n"), ticks)


def heading(level: Column | int, text: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.rtrim(F.concat(F.repeat(F.lit("#"), F.least(F.greatest(level, F.lit(1)), F.lit(6))), F.lit(" "), squash(text)))


def render(value: Column, kind: T.DataType) -> Column:
    """A value as a cell shows it, by its type: whole doubles as integers, nested ones as JSON."""
    if isinstance(kind, T.BooleanType):
        text = F.lower(value.cast("string"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        plain = F.regexp_replace(F.format_string("%.12f", value.cast("double")), r"(\.\d*?)0+$", "$1")
        text = F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("bigint").cast("string")).otherwise(
            F.when(F.isnan(value), "nan").when(F.abs(value) == float("inf"), F.when(value > 0, "inf").otherwise("-inf")).otherwise(plain)
        )
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def cell(value: Column, kind: T.DataType | None = None) -> Column:
    return F.replace(squash(render(value, kind or T.StringType())), F.lit("|"), F.lit("\\|"))


def table_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))


def table(rows: Column, header: bool = True) -> Column:
    """A pipe table of an array of arrays of strings; empty if no row has text."""
    grid = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: cell(c))), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(grid, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    blank = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit(""), width), " | "), F.lit(" |"))
    lines = F.transform(grid, line)
    if header:
        body = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))
    else:
        body = F.concat(F.array(blank, rule), lines)
    return F.when(F.size(grid) > 0, F.array_join(body, "\n")).otherwise("")


def kv_table(pairs: Column, key_header: str = "Field") -> Column:
    """A two-column table of an array of (key, value) structs, without empty values."""
    kept = F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != ""))
    rows = F.transform(kept, lambda p: F.array(p["key"], p["value"]))
    return F.when(F.size(kept) > 0, table(F.concat(F.array(F.array(F.lit(key_header), F.lit("Value"))), rows))).otherwise("")


def bullets(items: Column) -> Column:
    kept = F.filter(F.transform(items, strip), lambda x: x != "")
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), F.replace(x, F.lit("\n"), F.lit("\n  ")))), "\n")


def numbered(items: Column) -> Column:
    """Skipped items take a number as well."""
    out = F.transform(items, lambda x, i: F.when(strip(x) != "", F.concat((i + 1).cast("string"), F.lit(". "), F.replace(strip(x), F.lit("\n"), F.lit("\n   ")))))
    return F.array_join(F.array_compact(out), "\n")


def image(alt: Column, path: Column) -> Column:
    return F.concat(F.lit("!["), F.translate(alt, "[]", "()"), F.lit("]("), path, F.lit(")"))


def link(text: Column, url: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(F.nullif(text, F.lit("")), url), F.lit("]("), url, F.lit(")"))


def blockquote(text: Column) -> Column:
    return F.array_join(F.transform(_lines(text), lambda x: F.when(F.trim(x) == "", ">").otherwise(F.concat(F.lit("> "), x))), "\n")


def details(summary: Column, body: Column) -> Column:
    safe = F.replace(F.replace(F.replace(summary, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<details>\n<summary>"), safe, F.lit("</summary>\n\n"), body, F.lit("\n\n</details>"))


def promote_underlined(text: Column) -> Column:
    """Titles underlined with marks become headings; a fold that remembers the line before."""
    rule = r"^\s*(={3,}|_{3,}|-{3,}|\*{3,})\s*$"
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))

    def step(a: Column, x: Column) -> Column:
        title = F.trim(a["held"])
        takes = a["held"].isNotNull() & (title != "") & (F.length(title) <= 120) & x.rlike(rule) & title.rlike(r"[^=\-*_ ]")
        made = F.concat(F.when(F.trim(x).startswith("="), "# ").otherwise("## "), title)
        done = F.when(takes, F.concat(a["done"], F.array(made))).when(a["held"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["held"])))
        return F.struct(done.alias("done"), F.when(takes, F.lit(None)).otherwise(x).alias("held"))

    out = F.aggregate(_lines(text), zero, step, lambda a: F.concat(a["done"], F.when(a["held"].isNull(), F.array().cast("array<string>")).otherwise(F.array(a["held"]))))
    return F.array_join(out, "\n")


def promote_numbered(text: Column) -> Column:
    def line(x: Column) -> Column:
        bare = F.trim(x)
        depth = F.length(F.regexp_extract(bare, r"^(\d+(?:[.]\d+)*)", 1)) - F.length(F.replace(F.regexp_extract(bare, r"^(\d+(?:[.]\d+)*)", 1), F.lit("."), F.lit(""))) + 1
        return (
            F.when(bare.rlike(r"^\d+(?:\.\d+)*[.)]?\s+\S.{1,80}$"), heading(F.least(depth, F.lit(4)), bare))
            .when((F.length(bare) <= 100) & bare.rlike(r"^(?:第.{1,12}?[章节篇部]|[Cc]hapter\s+\d+)"), heading(1, bare)).otherwise(x)
        )

    return F.array_join(F.transform(_lines(text), line), "\n")


def heading_levels(text: Column) -> Column:
    """Lengths of the ATX marks, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6})\s+\S"), F.lit(1)), F.length)


def front_matter_block(text: Column) -> Column:
    return F.regexp_extract(text, r"^---\s*\n(?s:(.*?))\n---\s*\n?", 1)


def lift_front_matter(text: Column) -> Column:
    """map of the keys of a front matter block; empty if there is none."""
    lines = F.filter(_lines(front_matter_block(text)), lambda x: x.contains(":") & ~F.ltrim(x).startswith("-"))
    entry = lambda x: F.struct(
        F.trim(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), "^[\"']+|[\"']+$", "").alias("value")
    )
    return F.map_from_entries(F.array_compact(F.transform(lines, entry)))


def yaml_scalar(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    odd = (text == "") | text.rlike(r"""[%@!*&|>#:'"`{}\[\]]""") | F.lower(text).isin("no", "yes", "null", "false", "true")
    return F.when(odd, quoted).otherwise(text)


def front_matter(fields: list[tuple[str, Column]]) -> Column:
    """A front matter block of (key, string) pairs, without nulls and empty values."""
    lines = [F.when(c.isNotNull() & (c != ""), F.concat(F.lit(k + ": "), yaml_scalar(c))) for k, c in fields]
    return F.array_join(F.array_compact(F.array(F.lit("---"), *lines, F.lit("---"))), "\n")


def body_of(parts: Column) -> Column:
    text = F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"^\n+|\n+$", "")), "\n\n")
    text = strip(F.regexp_replace(text, r"\n\n\n+", "\n\n"))
    return F.when(text == "", "").otherwise(F.concat(text, F.lit("\n")))


def title_in_body(title: Column, body: Column) -> Column:
    """Whether a line of the body, without its marks, is the title or one begins the other."""
    target = F.lower(squash(title))

    def says(line: Column) -> Column:
        bare = F.regexp_replace(F.lower(squash(F.regexp_replace(line, r"^[\s*>#-]+", ""))), r"^[*_` ]+|[*_` ]+$", "")
        return (bare != "") & (bare.startswith(target) | F.startswith(target, bare)) & (F.least(F.length(bare), F.length(target)) >= 4)

    return (target == "") | F.exists(_lines(body), says)


def assemble(front: Column, title: Column, body: Column, report: Column) -> Column:
    """Front matter, title (if the body does not say it), body and report as one text."""
    head = F.when((title != "") & ~title_in_body(title, body), heading(1, title))
    parts = F.filter(F.array_compact(F.array(front, head, body, report)), lambda p: F.trim(p) != "")
    return F.concat(F.regexp_replace(F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"^\n+|\n+$", "")), "\n\n"), r"\s+$", ""), F.lit("\n"))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*m", "")


def seconds(stamp: Column) -> Column:
    p = r"(\d\d?):(\d\d):(\d\d)[,.](\d{1,3})"
    part = lambda i: F.regexp_extract(stamp, p, i)
    whole = part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("int")
    return F.when(part(1) != "", whole + part(4).cast("int") / F.pow(F.lit(10.0), F.length(part(4))))


def clock(at: Column) -> Column:
    s = F.floor(at).cast("bigint")
    return F.when(at.isNull(), "").otherwise(F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def column_index(ref: Column) -> Column:
    letters = F.filter(F.split(F.upper(F.regexp_extract(ref, "^([A-Za-z]*)", 1)), ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1


def diff_stats(text: Column) -> Column:
    names = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"(?m)^(?:-{3}|\+{3})\s+([^\n\t]+)"), F.lit(1)), lambda n: n != "/dev/null"))
    count = lambda a, b: F.size(F.filter(_lines(text), lambda x: x.startswith(a) & ~x.startswith(b)))
    return F.struct(F.size(names).alias("files"), count("+", "+++").alias("added"), count("-", "---").alias("removed"))


def svg_labels(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?is)<(?:desc|title|t(?:span|ext))\b[^<>]*>(.*?)</(?:desc|title|t(?:span|ext))>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: squash(F.regexp_replace(x, r"<[^>]+>", ""))), lambda x: x != "")


def xml_tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"<\s*([_A-Za-z][\w:.-]*)"), F.lit(1))


def best_delimiter(text: Column) -> Column:
    """The mark that is on each of the first twenty lines most evenly; a comma if none is."""
    lines = F.slice(F.filter(_lines(text), lambda x: F.trim(x) != ""), 1, 20)

    def score(mark: str, order: int) -> Column:
        n = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit(""))))
        mean = F.aggregate(n, F.lit(0), lambda a, x: a + x) / F.size(n)
        worth = F.when(F.array_min(n) >= 1, mean - (F.array_max(n) - F.array_min(n)))
        return F.struct(worth.alias("s"), F.lit(-order).alias("o"), F.lit(mark).alias("m"))

    ranked = F.filter(F.array(*[score(m, i) for i, m in enumerate(",\t;|:")]), lambda x: x["s"].isNotNull())
    return F.when(F.size(ranked) > 0, F.array_max(ranked)["m"]).otherwise(",")


def html_title(html: Column) -> Column:
    """The first h1's text, or else the title's; the five XML entities and two signs decoded."""
    def inner(tag: str) -> Column:
        text = F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), r"<[^>]+>", "")
        for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
            text = F.replace(text, F.lit(name), F.lit(sign))
        return squash(text)

    return F.coalesce(F.nullif(inner("h1"), F.lit("")), inner("title"))


def json_kind(text: Column) -> Column:
    """Name of a JSON text's root type; null if it is not valid."""
    s = F.schema_of_variant(F.try_parse_json(text))
    return (
        F.when(s.startswith("OBJECT"), "dict").when(s.startswith("ARRAY"), "list").when(s == "STRING", "str").when(s == "BOOLEAN", "bool")
        .when(s == "BIGINT", "int").when(s == "VOID", "NoneType").when(s.isNotNull(), "float")
    )


def image_dimensions(content: Column) -> Column:
    """(width, height) from the header of a PNG, GIF or BMP; null for others."""
    head = F.hex(F.substring(content, 1, 32))
    big = lambda at, n: F.conv(F.substring(head, 2 * at + 1, 2 * n), 16, 10).cast("int")
    little = lambda at, n: F.conv(F.concat(*[F.substring(head, 2 * (at + i) + 1, 2) for i in range(n - 1, -1, -1)]), 16, 10).cast("int")
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    long = lambda n: F.octet_length(content) >= n
    return (
        F.when(head.startswith("89504E470D0A1A0A") & long(24), size(big(16, 4), big(20, 4)))
        .when(head.startswith("474946") & long(10), size(little(6, 2), little(8, 2)))
        .when(head.startswith("424D") & long(26), size(little(18, 4), little(22, 4)))
    )


def relative(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))

"""Row-level functions and their Column forms agree, on given cases and on random texts."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.functions import columns as C
from quirespark.functions import formats, safety
from quirespark.functions import markdown as md
from quirespark.operators import textual

TEXTS = [
    "", "plain", "a_b*c[d]", "- x", "- x\n- y", "- a\n- b\n- c", "1. a\n2. b\n3. c\n\n- lone", "# h\n> q\n| t |\n```\n~~~", "a ``` b", "````x````",
    "Title\n=====\ntext\nPart\n---\nmore", "  a \t b\r\nc d　e  ", "\n\n\nx\n\n\n\ny  \n", "####### seven", "   ### three", "    ### four", "x\n\n  \n\ny",
]


def column(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", fn(F.col("t"))).collect())]


PAIRS = [
    (C.squash, md.squash), (C.escape_inline, md.escape_inline), (C.escape_structure, md.escape_structure), (C.paragraphs, md.paragraphs),
    (C.fence, md.fence), (lambda t: C.heading(2, t), lambda t: md.heading(2, t)), (C.blockquote, md.blockquote),
    (C.promote_underlined, lambda t: "\n".join(textual.promote_underlined(t.split("\n"))[0])),
]


@pytest.mark.parametrize("pair", range(len(PAIRS)))
def test_columns_equal_functions(spark, pair):
    as_column, plain = PAIRS[pair]
    assert column(spark, TEXTS, as_column) == [plain(t) for t in TEXTS]


def test_given_cases():
    assert md.escape_inline("x_y [z]*") == r"x\_y \[z\]\*"
    assert md.escape_structure("- x\n- y") == "\\- x\n\\- y" and md.escape_structure("- a\n- b\n- c") == "- a\n- b\n- c"
    assert md.table([("x", "y", "z"), (7,)]).splitlines()[2] == "| 7 |  |  |"
    assert [md.inline_value(v) for v in (True, False, None, 2.0, 2.5, 7, [1, 2])] == ["true", "false", "", "2", "2.5", "7", "[1, 2]"]
    assert md.fence("a\n```\nb").startswith("````") and md.fence("a\n```\nb").endswith("````")
    assert md.page_ranges([1, 2, 3, 7]) == "1-3, 7"
    assert md.yaml_scalar("a: b") == '"a: b"' and md.yaml_scalar("yes") == '"yes"' and md.yaml_scalar("ok") == "ok"
    assert [safety.safe_filename(n) for n in ("../../etc/passwd", "bad:name?.txt", "trailing...", "", "con.txt")] == ["passwd", "bad_name_.txt", "trailing", "untitled", "con_.txt"]
    assert md.seconds("01:02:03.5") == 3723.5 and md.seconds("02:03.5") is None and md.clock(3723.9) == "01:02:03"
    assert md.numbered(["a", "", "b"]) == "1. a\n3. b" and md.bullets(["a\nb", " "]) == "- a\n  b"


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="#>-*+1.)`~| \nabc", max_size=50))
def test_escaped_text_starts_no_block(text):
    out = md.escape_structure(text)
    for block in out.split("\n\n"):
        items = [x for x in block.split("\n") if md._ITEM.match(x)]
        assert not items or len(items) >= 3
        assert not any(x.lstrip(" ").startswith(("```", "~~~", ">", "|")) and len(x) - len(x.lstrip(" ")) <= 3 for x in block.split("\n"))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_squash_is_idempotent(text):
    assert md.squash(md.squash(text)) == md.squash(text)


def test_render_by_type(spark):
    df = spark.createDataFrame([(2.0, 2.5, True, [1, 2], None), (-0.25, 1e9, False, [], "x|y")], "a double, b double, c boolean, d array<int>, e string")
    rows = df.select(*[C.cell(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns]).collect()
    assert list(rows[0]) == ["2", "2.5", "true", "[1,2]", ""] and list(rows[1]) == ["-0.25", "1000000000", "false", "[]", "x\\|y"]
    assert isinstance(df.schema["c"].dataType, T.BooleanType)


def test_tables_and_lists(spark):
    df = spark.createDataFrame([([["u", "v", "w"], ["7"], ["", ""]], ["x", " ", "y\nz"])], "rows array<array<string>>, items array<string>")
    r = df.select(C.table(F.col("rows")).alias("t"), C.table(F.col("rows"), False).alias("n"), C.bullets(F.col("items")).alias("b"), C.numbered(F.col("items")).alias("o")).first()
    assert r["t"] == md.table([("u", "v", "w"), ("7",)]) and r["n"] == md.table([("u", "v", "w"), ("7",)], header=False)
    assert r["b"] == md.bullets(["x", " ", "y\nz"]) and r["o"] == md.numbered(["x", " ", "y\nz"])


def test_assembly(spark):
    cases = [("Report 2025", "# Report 2025\n\nx\n", True), ("Annual Report", "# **Annual** Report\n", False), ("T", "T\n", False), ("", "x\n", True), ("Other", "# Title\n", False)]
    df = spark.createDataFrame(cases, "title string, body string, says boolean")
    got = df.select(C.title_in_body(F.col("title"), F.col("body")), "says").collect()
    assert all(a == b for a, b in got)
    none = F.lit(None).cast("string")
    assert df.select(C.assemble(none, F.lit("New"), F.lit("a\n"), none)).first()[0] == "# New\n\na\n"
    parts = spark.createDataFrame([(["\na\n", "b\n\n\n\nc", ""],)], "p array<string>")
    assert parts.select(C.body_of(F.col("p"))).first()[0] == "a\n\nb\n\nc\n"


def test_detection():
    cases = {
        ("a.txt", b"%PDF-1.4"): "pdf", ("a.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 9): "doc_legacy", ("a.txt", b'{"a": 1}'): "json",
        ("a.txt", b"a,b\n1,2\n"): "csv", ("a.txt", b"# Title\n\ntext"): "markdown", ("blob", bytes(range(256))): "unsupported_binary",
        ("a.txt", b"<html><body>x"): "html", ("a.py", b"x = 1"): "code", ("x", b"words only"): "text", ("a.txt", b"RIFF1234WEBP"): "image",
        ("a.wav", b"RIFF1234WAVE"): "unsupported_media", ("Makefile", b"all:\n"): "code", ("a.zip", b"PK\x03\x04junk"): "archive",
    }
    for (name, raw), key in cases.items():
        assert formats.detect(name, raw).key == key, name
    assert formats.detect("x", b"words").confidence == "fallback" and formats.detect("a.json", b"[").confidence == "extension"
    assert formats.detect("a.bin", b"x", sniff=False).key == "unsupported_binary" and not formats.detect("a.bin", b"x", sniff=False).supported
    long = ("ü" * 40000).encode()
    assert formats.detect("a.txt", b"x" + long).text_encoding == "utf-8"
    assert len(formats.EXTENSIONS) == 142 and len(set(formats.EXTENSIONS.values())) == 33 and len(formats.NAMES) == 13 and len(formats.LANGUAGES) == 83
    assert len(formats.MEDIA_TYPES) == 29 and len(formats.SIGNATURES) == 22


def test_decoding():
    assert formats.decode("中文文本".encode("gb18030")).text == "中文文本" and formats.decode("中文".encode("gb18030")).encoding == "gb18030"
    assert formats.decode(b"\xef\xbb\xbfa\r\nb\rc").text == "a\nb\nc" and formats.decode(b"\xef\xbb\xbfa").encoding == "utf-8-sig"
    assert formats.decode("x".encode("utf-16")).text == "x" and formats.decode("a�b".encode()).had_errors


def test_image_dimensions(spark):
    from quirespark.operators.media import dimensions

    heads = [b"\x89PNG\r\n\x1a\n" + bytes(8) + (240).to_bytes(4, "big") + (120).to_bytes(4, "big"), b"GIF89a" + bytes([3, 1, 9, 0]),
             b"BM" + bytes(16) + (640).to_bytes(4, "little") + (480).to_bytes(4, "little"), b"\xff\xd8\xff", b"GIF", b""]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, c binary").orderBy("i")
    got = [(r[0]["width"], r[0]["height"]) if r[0] else (None, None) for r in df.select(C.image_dimensions(F.col("c"))).collect()]
    assert got == [dimensions(h) for h in heads] and got[0] == (240, 120) and got[2] == (640, 480)


def test_urls(spark):
    urls = ["https://ok.test/a", "http://localhost", "http://127.0.0.1", "https://10.1.1.1", "ftp://x.y", "http://[::1]/", "http://172.16.0.1", "http://172.32.0.1", "", "x", "http://169.254.1.1"]
    assert column(spark, urls, safety.url_allowed) == [safety.may_fetch(u) for u in urls]
    with pytest.raises(safety.UnsafeInput):
        safety.check_archive(10, 10_000)
    with pytest.raises(safety.UnsafeInput):
        safety.inside("/tmp/a", "/tmp/b")

"""Plans over files and tables: conversion, corpora, streams, SQL and the command line."""

from __future__ import annotations

import io
import json
import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quirespark.__main__ import main
from quirespark.functions.tables import register
from quirespark.oracle import SQL
from quirespark.plans import corpus
from quirespark.plans.convert import assembled, convert
from quirespark.queries import QUERIES
from quirespark.schemas import Options
from quirespark.sources.files import _listing, binary_files, glob_regex, read_contents, walk
from quirespark.streaming.incremental import arriving, convert_stream, once_each

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    for name, text in {"a.txt": "Title\n=====\nbody", "b/People.csv": "n,r\nA,B|C\n", ".hid.md": "# Hidden\n", "node_modules/x.txt": "skip", "b/empty.csv": "", "b/a.txt": "other"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "blob.bin").write_bytes(b"\x7fELF" + bytes(range(256)))
    return root


def test_walk(spark, tree):
    names = [r["path"][len(str(tree)) + 1 :] for r in walk(spark, str(tree)).collect()]
    assert names == [".hid.md", "a.txt", "b/a.txt", "b/empty.csv", "b/People.csv", "blob.bin"]
    assert [r["name"] for r in walk(spark, str(tree), patterns=["*.txt"], exclude=["*/b/*"]).collect()] == ["a.txt"]
    assert walk(spark, str(tree), recursive=False).count() == 3 and walk(spark, str(tree / "a.txt")).first()["name"] == "a.txt"
    assert walk(spark, str(tree), skip_paths=[str(tree / "a.txt")]).count() == 5
    assert walk(spark, str(tree), output_dir=str(tree / "b")).count() == 3 and glob_regex("a?.*") == r"^a.\..*$"
    limited = read_contents(walk(spark, str(tree)), max_bytes=20).collect()
    assert sum(r["content"] is None for r in limited) == 1


def test_scan_prunes_and_pushes(spark, tree):
    plan = binary_files(spark, str(tree), max_bytes=10).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,10)" in plan and "content" not in plan.split("ReadSchema")[1]


def test_convert_and_assemble(spark, tree):
    made = convert(read_contents(walk(spark, str(tree))))
    rows = {r["path"][len(str(tree)) + 1 :]: r for r in assembled(made).collect()}
    text = rows["a.txt"]["markdown"]
    assert text.startswith("---\nsource: a.txt\nformat: text\nconverter: plain-text\n") and "\n# Title\nbody\n" in text and "## Conversion report" in text and "No issues detected." in text
    assert rows["b/empty.csv"]["status"] == "empty" and "**Error (" in rows["b/empty.csv"]["markdown"] and "fidelity: empty" in rows["b/empty.csv"]["markdown"]
    assert rows["b/People.csv"]["parts"] == ["| n | r |\n| --- | --- |\n| A | B\\|C |"] and rows["blob.bin"]["format"]["key"] == "unsupported_binary"
    bare = {r["name"]: r["markdown"] for r in assembled(made, Options.of(front_matter=False, report=False)).collect()}
    assert bare[".hid.md"] == "# Hidden\n"
    counts = corpus.rollup(made).first()
    assert (counts["total"], counts["converted"], counts["empty"], counts["failed"]) == (6, 4, 2, 0)
    flat = corpus.flat(made).collect()
    assert {r["source"] for r in flat} == {"a.txt", "People.csv", ".hid.md", "empty.csv", "blob.bin"} and flat[0]["skipped"] is False
    assert {(r["severity"], r["code"]) for r in corpus.warning_rollup(made).collect()} >= {("error", "empty-file"), ("error", "unsupported-format")}
    lines = [r["line"] for r in corpus.report_lines(made).orderBy("at").collect()]
    assert lines[0].startswith("| .hid.md | markdown | ok | markdown-passthrough |")


def test_a_reader_that_fails_is_a_row_not_a_failed_job(spark):
    rows = convert(spark.createDataFrame([("a.xlsx", b"PK\x03\x04junk"), ("b.txt", b"ok"), ("c.txt", None)], "name string, content binary"), Options.of(force_format=None)).collect()
    assert sorted(r["status"] for r in rows) == ["failed", "failed", "ok"]


def test_outputs_collisions_and_skipping(spark):
    df = spark.createDataFrame([("/in/x/a.csv",), ("/in/x/a.txt",), ("/in/b.tar.gz",)], "path string")
    out = [r[0] for r in df.select(corpus.output_path(F.col("path"), "/out", "/in")).collect()]
    assert out == ["/out/x/a.md", "/out/x/a.md", "/out/b.tar.md"]
    assert [r[0] for r in df.select(corpus.output_path(F.col("path"), None)).collect()][0] == "/in/x/.md/a.md"
    outs = df.withColumn("output", corpus.output_path(F.col("path"), "/out", mirror=False))
    assert corpus.collisions(outs).collect()[0]["output"] == "/out/a.md"
    assert corpus.not_yet(outs, spark.createDataFrame([("/out/a.md",)], "output string")).count() == 1


def test_assets(spark):
    rows = [(1, 0, "a.png", b"x"), (1, 1, "b.png", b"x"), (1, 2, "a.png", b"y"), (2, 0, "a.png", b"y")]
    got = corpus.content_addressed(spark.createDataFrame(rows, "doc int, pos int, filename string, data binary"), "doc").orderBy("doc", "pos").collect()
    assert [r["file"] for r in got] == ["a.png", "a.png", f"a-{got[2]['sha1'][:8]}.png", "a.png"] and [r["first"] for r in got] == [True, False, True, True]
    df = spark.createDataFrame([(["![x](assets/a.png) (assets/b.png)"], {"a.png": "u/1.png"})], "parts array<string>, names map<string,string>")
    assert df.select(corpus.relink(F.col("parts"), F.col("names"))).first()[0] == ["![x](u/1.png) (assets/b.png)"]


def test_writing(spark, tree, tmp_path):
    made = convert(read_contents(walk(spark, str(tree), patterns=["a.txt"])))
    named = assembled(made.withColumn("output", F.concat(F.lit(f"{tmp_path}/o/"), F.col("name"), F.lit(".md"))).where(~F.col("path").contains("/b/")), Options.of(front_matter=False, report=False))
    options = Options.of(report_json=True)
    first = [r["output"] for r in corpus.write_files(named, options).collect()]
    second = [r["output"] for r in corpus.write_files(named, options).collect()]
    assert first == [f"{tmp_path}/o/a.txt.md"] and second != first and second == [r["output"] for r in corpus.write_files(named, options).collect()]
    assert open(first[0]).read() == "# Title\nbody\n" and json.load(open(first[0] + ".json"))["status"] == "ok"
    corpus.write_corpus(made, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).where("format_key = 'text'").count() == made.count()
    blob = corpus.bundle(named).first()["bundle"]
    assert zipfile.ZipFile(io.BytesIO(blob)).namelist() == ["a.md"]


def _assets(spark, tmp_path, rows):
    made = [(n, f"{tmp_path}/{n}.md", f"see ![x](assets/{a})\n", [(a, d, "image/png", "")], "ok") for n, a, d in rows]
    kind = "name string, output string, markdown string, assets array<struct<filename:string,data:binary,media_type:string,origin:string>>, status string"
    return (
        spark.createDataFrame(made, kind).withColumn("format", F.struct(F.lit("docx").alias("key"), F.lit("m").alias("media_type"), F.lit("content").alias("confidence")))
        .withColumns({"converter": F.lit("c"), "elapsed_ms": F.lit(1.0), "warnings": F.array().cast("array<string>"), "error": F.lit(None).cast("string"),
                      "meta": F.create_map(F.lit("k"), F.lit("v"))})
    )


def test_assets_of_one_folder_keep_their_bytes_and_links(spark, tmp_path):
    """Two documents with pictures of one name: both are there, and each text links to its own."""
    rows = [("a", "image1.png", b"one"), ("b", "image1.png", b"two"), ("c", "copy.png", b"one"), ("d", "other.png", b"four")]
    df = _assets(spark, tmp_path / "o", rows)
    for _ in range(2):  # a second run over the same files writes the same
        done = {r["output"]: r for r in corpus.write_files(df, Options.of(overwrite=True, report_json=True)).collect()}
        assert len(done) == 4 and all(r["written"] and r["status"] == "ok" for r in done.values())
        for name, _, data in rows:
            text = (tmp_path / f"o/{name}.md").read_text()
            assert (tmp_path / "o" / text.split("(")[1].split(")")[0]).read_bytes() == data
        assert len(os.listdir(tmp_path / "o/assets")) == 3
    facts = json.load(open(tmp_path / "o/a.md.json"))
    assert set(facts) == set("source format media_type detected_by converter status output assets elapsed_ms skipped warnings meta error".split())
    assert facts["meta"] == {"k": "v"} and facts["assets"] == [f"{tmp_path}/o/assets/image1.png"] and facts["source"] == "a"
    # Later batches leave the files of earlier ones alone.
    corpus.write_files(_assets(spark, tmp_path / "o", [("e", "image1.png", b"five")]), Options.of()).collect()
    text = (tmp_path / "o/e.md").read_text()
    assert (tmp_path / "o/assets/image1.png").read_bytes() == b"one" and (tmp_path / "o" / text.split("(")[1].split(")")[0]).read_bytes() == b"five"


def test_a_row_that_cannot_be_written_is_told_and_the_others_go_on(spark, tmp_path):
    (tmp_path / "file").write_text("not a folder")
    df = _assets(spark, tmp_path, [("file/x", "p.png", b"1"), ("ok", "p.png", b"2")])
    rows = {r["written"]: r for r in corpus.write_files(df, Options.of()).collect()}
    assert rows[True]["output"] == f"{tmp_path}/ok.md" and rows[False]["status"] == "failed" and rows[False]["error"].startswith("write-failed")


def test_batch_reports(spark, tree, tmp_path):
    made = convert(read_contents(walk(spark, str(tree))))
    lines = [r["line"] for r in corpus.report_text(made).orderBy("part", "at").collect()]
    assert lines[0].startswith("| File |") and lines[-1] == "6 files: 4 clean, 0 with warnings, 2 empty, 0 failed, 0 skipped." and len(lines) == 9
    corpus.write_batch_report(made, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/summary")).first()["total"] == 6
    assert set(spark.read.json(str(tmp_path / "r/results")).columns) >= {"source", "detected_by", "warnings", "skipped"}


def test_walk_lists_folders_in_many_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}/f.txt").write_text("x")
    (tmp_path / "d0/gone").symlink_to(tmp_path / "nowhere")
    level = spark.createDataFrame([(f"{tmp_path}/d{i}",) for i in range(40)] + [(f"{tmp_path}/missing",)], "path string")
    assert _listing(level.repartition(16, "path"), False).select("task").distinct().count() > 8
    assert walk(spark, str(tmp_path), tasks=16).count() == 40


def test_stream(spark, tree, tmp_path):
    seen = []
    files = once_each(arriving(spark, str(tree), glob="*.txt"))
    sink = lambda df, n: seen.extend((r["name"], r["status"]) for r in df.collect())
    q = convert_stream(files, sink, str(tmp_path / "cp"))
    q.awaitTermination(120)
    (tree / "c.txt").write_text("Title\n=====\nbody")  # a copy
    (tree / "d.txt").write_text("new")
    convert_stream(files, sink, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(seen) == [("a.txt", "ok"), ("a.txt", "ok"), ("d.txt", "ok"), ("x.txt", "ok")]


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT md_html('<h1>x</h1>') a, md_rtf('{\\\\rtf1 hi}') b, md_file_name('../x?') c").first().asDict() == {"a": "# x", "b": "hi", "c": "x_"}
    assert spark.sql("SELECT count(*) FROM md_json_paths('{\"a\": {\"b\": 1}, \"c\": [1]}')").first()[0] == 2
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "x")
    spark.createDataFrame([(z.getvalue(),)], "z binary").createOrReplaceTempView("zips")
    assert spark.sql("SELECT e.entry, e.size FROM zips, LATERAL md_archive_entries(z) e").collect() == [("a.txt", 1)]


def test_command_line(spark, tree, tmp_path, capsys):
    assert main(["--formats"]) == 0 and "ooxml-stdlib" in capsys.readouterr().out and main([]) == 2
    assert main([str(tree), "--out", str(tmp_path / "o"), "--pattern", "*.txt", "--no-report"]) == 0
    assert (tmp_path / "o/b/a.md").exists() and "# Title" in (tmp_path / "o/a.md").read_text()
    assert main([str(tree / "blob.bin"), "--stdout"]) == 1
    (tree / "new.txt").write_text("new")
    assert main([str(tree), "--out", str(tmp_path / "o"), "--pattern", "*.txt", "--summary", "--batch-report", str(tmp_path / "r")]) == 0
    said = capsys.readouterr().out
    assert "written: 1" in said and "3 files: 1 clean, 0 with warnings, 0 empty, 0 failed, 2 skipped." in said and len(os.listdir(tmp_path / "o")) == 3


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in os.listdir(SF):
        c.sql(f"CREATE VIEW {n.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{n}'")
    return c


def normal(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, duck, name):
    assert normal(QUERIES[name](spark, SF).toPandas()) == normal(duck.sql(SQL[name]).df())


def test_queries_without_sql(spark):
    pages = {r["page_id"]: r for r in QUERIES["html_markdown"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        made = pages[r["page_id"]]
        assert made["status"] == "ok" and made["headings"] == 1 and f"# {made['title']}" in made["markdown"]
        assert "track(" not in made["markdown"] and "<p>" not in made["markdown"] and "](/" not in made["markdown"]
    rows = QUERIES["document_conversion"](spark, SF).collect()
    assert len(rows) == 200 and {r["status"] for r in rows} <= {"ok", "partial"} and {r["format"] for r in rows} >= {"text"}
    assert {r["kind"] for r in QUERIES["document_outline"](spark, SF).collect()} == {"cue", "def", "class", "heading", "path"}
    assert entry.entry(spark).count() == 50 and set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_run_before_python(spark):
    made = convert(spark.read.parquet(f"{SF}/pages.parquet").where("page_id < 5").withColumn("name", F.lit("a.html")), content_col="html")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Filter") and "PushedFilters: [IsNotNull(page_id), LessThan(page_id,5)]" in plan

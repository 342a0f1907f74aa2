"""Work over a corpus of results: rollups, collisions, skipping, assets, reports and writing."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirespark.functions import columns as C
from quirespark.functions.safety import filename_column
from quirespark.schemas import Options
from quirespark.sources.files import folder_of, name_of


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def output_path(path: Column, base: str | None, root: str = "", mirror: bool = True, suffix: str = ".md") -> Column:
    """Where a source's Markdown goes: beside it in .md/, or below ``base``, mirrored or flat."""
    file = F.concat(stem(name_of(path)), F.lit(suffix))
    if base is None:
        return F.concat(folder_of(path), F.lit("/.md/"), file)
    if not mirror:
        return F.concat(F.lit(base.rstrip("/") + "/"), file)
    below = F.regexp_replace(F.substring(folder_of(path), len(root.rstrip("/")) + 1, 1 << 20), "^/+", "")
    return F.concat(F.lit(base.rstrip("/") + "/"), F.when(below == "", "").otherwise(F.concat(below, F.lit("/"))), file)


def collisions(outputs: DataFrame, col: str = "output") -> DataFrame:
    """Output paths that more than one source would write, and how many."""
    return outputs.groupBy(col).agg(F.count("*").alias("sources")).where("sources > 1")


def not_yet(outputs: DataFrame, existing: DataFrame, col: str = "output") -> DataFrame:
    """Sources whose output does not exist yet: an anti join."""
    return outputs.join(existing.select(col), col, "left_anti")


def skipped_rows(sources: DataFrame, schema: StructType) -> DataFrame:
    """Sources that were not converted again, as rows of a result table: skipped, of no status."""
    values = {f.name: F.lit(None).cast(f.dataType) for f in schema} | {c: F.col(c) for c in sources.columns if c in schema.names} | {"skipped": F.lit(True)}
    values |= {"format": F.struct(*[F.lit({"key": "skipped", "confidence": "cached"}.get(f.name, "")).alias(f.name) for f in schema["format"].dataType])}
    values |= {c: F.array().cast(schema[c].dataType) for c in ("parts", "assets", "warnings")} | {"status": F.lit("ok"), "converter": F.lit(""), "elapsed_ms": F.lit(0.0)}
    return sources.select([values[f.name].cast(f.dataType).alias(f.name) for f in schema])


def rollup(results: DataFrame, *keys: str) -> DataFrame:
    """Counts by status; a skipped row is counted as skipped whatever its status."""
    skipped = F.col("skipped") if "skipped" in results.columns else F.lit(False)
    of = lambda s: F.count_if(~skipped & (F.col("status") == s)).alias("converted" if s == "ok" else s)
    return results.groupBy(*keys).agg(F.count("*").alias("total"), of("ok"), of("partial"), of("empty"), of("failed"), F.count_if(skipped).alias("skipped"))


def warning_rollup(results: DataFrame) -> DataFrame:
    """How often each warning occurs, and in how many sources."""
    named = results.withColumn("__row", F.monotonically_increasing_id())
    each = named.select("__row", F.explode("warnings").alias("w")).select("__row", "w.code", "w.severity")
    return each.groupBy("severity", "code").agg(F.count("*").alias("n"), F.count_distinct("__row").alias("sources"))


def content_addressed(
    assets: DataFrame, doc_col: str, name_col: str = "filename", data_col: str = "data", pos_col: str = "pos", hashed: bool = False
) -> DataFrame:
    """Assets named by content: equal bytes are one file; equal names of other bytes get a hash.

    Adds sha1, file (the name to write) and first (whether this row is the one to write). With
    ``hashed`` the data column already holds the hash, so that no bytes are shuffled.
    """
    named = assets.withColumn("sha1", F.col(data_col) if hashed else F.sha1(data_col))
    by_bytes = Window.partitionBy(doc_col, "sha1").orderBy(pos_col)
    firsts = named.withColumn("__n", F.row_number().over(by_bytes)).withColumn("first", F.col("__n") == 1)
    firsts = firsts.withColumn("__name", F.first(name_col).over(by_bytes.rowsBetween(Window.unboundedPreceding, 0)))
    by_name = Window.partitionBy(doc_col, "__name").orderBy(F.desc("first"), pos_col).rowsBetween(Window.unboundedPreceding, 0)
    owner = F.first("sha1").over(by_name)
    ext = F.regexp_extract(F.col("__name"), r"(?<=.)(\.[^.]*)$", 1)
    other = F.concat(stem(F.col("__name")), F.lit("-"), F.substring("sha1", 1, 8), ext)
    return firsts.withColumn("file", F.when(owner == F.col("sha1"), F.col("__name")).otherwise(other)).drop("__n", "__name")


def relink(parts: Column, names: Column, folder: str = "assets") -> Column:
    """Parts with ``(assets/name)`` replaced by the url that ``names`` (a map) has for the name."""
    entries = F.map_entries(names)
    return F.transform(
        parts,
        lambda p: F.aggregate(entries, p, lambda a, e: F.replace(a, F.concat(F.lit(f"({folder}/"), e["key"], F.lit(")")), F.concat(F.lit("("), e["value"], F.lit(")")))),
    )


def _flat_columns(results: DataFrame, name_col: str) -> list[Column]:
    return [
        F.col(name_col).alias("source"), F.col("format.key").alias("format"), F.col("format.media_type"), F.col("format.confidence").alias("detected_by"),
        F.col("converter"), F.col("status"), *([F.col("output")] if "output" in results.columns else []), F.transform("assets", lambda a: a["filename"]).alias("assets"),
        F.round("elapsed_ms", 1).alias("elapsed_ms"), (F.col("skipped") if "skipped" in results.columns else F.lit(False)).alias("skipped"),
        F.col("warnings"), F.col("meta"), F.col("error"),
    ]


def flat(results: DataFrame, name_col: str = "name") -> DataFrame:
    """The public flat form of a result: no contents, formats unfolded."""
    return results.select(_flat_columns(results, name_col))


def report_lines(results: DataFrame, name_col: str = "name") -> DataFrame:
    """Rows of the batch report's table, to be read in order of ``at``; the corpus is not gathered."""
    codes = F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("warnings", lambda w: w["severity"] != "info"), lambda w: w["code"]))), ", ")
    cells = [F.col(name_col), F.col("format.key"), F.col("status"), F.col("converter"), F.format_string("%.0f ms", "elapsed_ms"), codes]
    return results.select(F.lower(name_col).alias("at"), C.table_row([C.cell(c) for c in cells]).alias("line"))


def write_corpus(results: DataFrame, path: str, format: str = "parquet") -> None:
    """The main sink: a partitioned table of results."""
    results.withColumn("format_key", F.col("format.key")).write.mode("overwrite").partitionBy("format_key").format(format).save(path)


def named_assets(results: DataFrame, folder: Column, links: str = "assets") -> DataFrame:
    """``results`` with files (array<struct<file,first>>, one an asset): what each asset is to
    be called below ``folder``, over all rows that share the folder, and markdown relinked.

    Names go to the outputs in order of their paths. Only hashes and names are shuffled to find
    them; rows without assets are not joined.
    """
    sums = F.transform("assets", lambda a: F.sha1(a["data"]))
    rows = results.withColumns({"__folder": folder, "__key": F.sha1(F.concat_ws(" ", F.coalesce("output", F.lit("")), sums, F.transform("assets", lambda a: a["filename"])))})
    files = "array<struct<file:string,first:boolean>>"
    bare = rows.where(F.coalesce(F.size("assets"), F.lit(0)) <= 0).withColumn("files", F.array().cast(files))
    some = rows.where(F.size("assets") > 0)
    narrow = some.select("__folder", "__key", "output", F.posexplode(F.transform("assets", lambda a: F.struct(a["filename"].alias("filename"), F.sha1(a["data"]).alias("sha1")))).alias("at", "a"))
    narrow = narrow.distinct().select("__folder", "__key", "output", "at", filename_column(F.col("a.filename")).alias("filename"), F.col("a.sha1").alias("data"))
    named = content_addressed(narrow.withColumn("pos", F.struct("output", "__key", "at")), "__folder", hashed=True)
    lists = named.groupBy("__folder", "__key").agg(F.array_sort(F.collect_list(F.struct("at", "file", "first"))).alias("f"))
    lists = lists.select("__folder", "__key", F.transform("f", lambda x: F.struct(x["file"].alias("file"), x["first"].alias("first"))).alias("files"))
    # A name that stands for several assets of one row links to the last of them.
    pairs = F.filter(
        F.transform("files", lambda f, i: F.struct(F.get("assets", i)["filename"].alias("key"), F.concat(F.lit(links + "/"), f["file"]).alias("value"))),
        lambda e: e["value"] != F.concat(F.lit(links + "/"), e["key"]),
    )
    later = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["key"] == e["key"]))
    linked = some.join(lists, ["__folder", "__key"]).withColumn("markdown", relink(F.array("markdown"), F.map_from_entries(later), links)[0])
    return bare.unionByName(linked).drop("__folder", "__key")


def write_files(assembled: DataFrame, options: Options, output_col: str = "output", name_col: str = "name") -> DataFrame:
    """One Markdown file a row, on a mounted file system, and its assets and JSON if asked.

    An existing file is kept unless overwriting is on: the new text then gets a name with its
    own hash, so that a task that runs again writes the same file. Assets are named by content
    over all rows of an output folder, and never replace a file of other bytes that an earlier
    run left; the Markdown links to the names that were written. Returns output, written,
    status, assets, error; a row that cannot be written is failed, with a write-failed warning
    in its JSON and error, and the others go on.
    """
    rows = assembled.withColumn("output", F.col(output_col))
    if options.write_assets:
        rows = named_assets(rows, folder_of(F.col("output")), options.assets_dir)
    else:
        rows = rows.withColumn("files", F.array().cast("array<struct<file:string,first:boolean>>"))
    rows = rows.select("output", "markdown", "assets", "files", "status", F.struct(*_flat_columns(rows, name_col)).alias("facts"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["output", "written", "status", "assets", "error"]
        kinds = [pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.string()]
        for batch in batches:
            made = [_put(row, options) for row in batch.to_pylist()]
            yield pa.record_batch([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names)

    return rows.mapInArrow(put, "output string, written boolean, status string, assets array<string>, error string")


def _put(row: dict, options: Options) -> tuple[str, bool, str, list[str], str | None]:
    """Write one row's files; (output, written, status, assets, error)."""
    path, text, kept = row["output"], row["markdown"], []
    try:
        folder = os.path.dirname(path)
        os.makedirs(folder or ".", exist_ok=True)
        for asset, to in zip(row["assets"] or (), row["files"] or ()):
            name = _free_name(os.path.join(folder, options.assets_dir), to["file"], asset["data"])
            if name != to["file"]:
                text = text.replace(f"({options.assets_dir}/{to['file']})", f"({options.assets_dir}/{name})")
            kept.append(os.path.join(folder, options.assets_dir, name))
            if to["first"] or not os.path.exists(kept[-1]):
                os.makedirs(os.path.dirname(kept[-1]), exist_ok=True)
                _replace(kept[-1], asset["data"])
        data = text.encode("utf-8", "replace")
        if os.path.exists(path) and not options.overwrite:
            base, ext = os.path.splitext(path)
            path = f"{base}.{hashlib.sha1(data).hexdigest()[:8]}{ext}"
        _replace(path, data)
        if options.report_json:
            _replace(path + ".json", sidecar({**row["facts"], "output": path, "assets": kept}).encode("utf-8", "replace"))
        return path, True, row["status"], kept, None
    except OSError as e:
        return path, False, "failed", kept, f"write-failed: {e}"


def _free_name(folder: str, name: str, data: bytes) -> str:
    """``name``, or one with the bytes' hash where another file has it already."""
    try:
        with open(os.path.join(folder, name), "rb") as f:
            same = f.read() == data
    except FileNotFoundError:
        return name
    base, ext = os.path.splitext(name)
    return name if same else f"{base}-{hashlib.sha1(data).hexdigest()[:8]}{ext}"


def sidecar(facts: dict) -> str:
    """A result's public facts as JSON text; maps come from Arrow as lists of pairs."""
    return json.dumps({k: dict(v or ()) if k == "meta" else v for k, v in facts.items()}, ensure_ascii=False, default=str)


def summary(results: DataFrame) -> DataFrame:
    """One row that counts the batch: total, converted, partial, empty, failed, skipped."""
    return rollup(results)


def write_batch_report(results: DataFrame, path: str, name_col: str = "name") -> None:
    """The machine-readable report as a folder: ``results`` (JSON lines, written by the
    executors, in as many files as there are tasks) and ``summary`` (one row)."""
    flat(results, name_col).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/results")
    summary(results).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def report_text(results: DataFrame, name_col: str = "name") -> DataFrame:
    """(part, at, line) of the batch report as text, in that order: header, a row a source, counts."""
    head = ["| File | Format | Status | Converter | Time | Warnings |", "| --- | --- | --- | --- | --- | --- |"]
    spark = results.sparkSession
    top = spark.createDataFrame([(0, str(i), x) for i, x in enumerate(head)], "part int, at string, line string")
    rows = report_lines(results, name_col).select(F.lit(1).alias("part"), "at", "line")
    said = ["total", " files: ", "converted", " clean, ", "partial", " with warnings, ", "empty", " empty, ", "failed", " failed, ", "skipped", " skipped."]
    counts = F.concat(*[F.col(x).cast("string") if x.isalpha() else F.lit(x) for x in said])
    return top.unionAll(rows).unionAll(summary(results).select(F.lit(2), F.lit(""), counts))


def _replace(path: str, data: bytes) -> None:
    temporary = f"{path}.{os.getpid()}.tmp"
    try:
        with open(temporary, "wb") as f:
            f.write(data)
        os.replace(temporary, path)
    except OSError:
        with contextlib.suppress(OSError):
            os.remove(temporary)
        raise


def bundle(assembled: DataFrame, name_col: str = "name") -> DataFrame:
    """Every row's Markdown and assets as one zip file: name, bundle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import zipfile

        for batch in batches:
            for row in batch.to_pylist():
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, mode="w", compression=zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"{os.path.splitext(row[name_col])[0]}.md", row["markdown"])
                    for a in row["assets"] or ():
                        z.writestr(f"assets/{a['filename']}", a["data"])
                yield pa.record_batch([pa.array([row[name_col]]), pa.array([buffer.getvalue()], pa.binary())], [name_col, "bundle"])

    return assembled.select(name_col, "markdown", "assets").mapInArrow(pack, f"{name_col} string, bundle binary")

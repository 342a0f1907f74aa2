"""Files as rows: enumeration that includes hidden names, size limits, and contents."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Globs = list[str] | None
SKIPPED = frozenset(
    ".git .hg .svn .idea .vscode __pycache__ node_modules .venv venv .mypy_cache .pytest_cache .ruff_cache .tox dist build .md".split()
)


def glob_regex(pattern: str) -> str:
    """A glob's regular expression in the dialect that Spark and DuckDB share."""
    out = ""
    for c in pattern:
        out += {"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or c in "_ []-" else "\\" + c)
    return f"^{out}$"


def name_of(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"/?[^/]*$", "")


def admitted(path: Column, patterns: Globs = None, exclude: Globs = None, skip_dirs: set[str] | None = None, output_dir: str | None = None, skip_paths: Globs = None, root: str = "") -> Column:
    """Whether a walk takes a path: names match a pattern, nothing excludes name or path.

    A long list of paths to skip is better anti-joined (corpus.not_yet)."""
    below = F.regexp_replace(folder_of(path), "^" + "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in root.rstrip("/")), "")
    keep = ~F.exists(F.split(below, "/"), lambda p: p.isin(*sorted(SKIPPED | (skip_dirs or set()))))
    if patterns:
        keep = keep & _any([name_of(path).rlike(glob_regex(p)) for p in patterns])
    if exclude:
        keep = keep & ~_any([name_of(path).rlike(glob_regex(p)) | path.rlike(glob_regex(p)) for p in exclude])
    if skip_paths:
        keep = keep & ~path.isin(*skip_paths)
    if output_dir:
        keep = keep & ~path.startswith(output_dir.rstrip("/") + "/")
    return keep


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def walk(spark: SparkSession, root: str, *, recursive: bool = True, tasks: int | None = None, **filters) -> DataFrame:
    """path, name, length of a mounted tree's files, hidden ones included, in path order.

    Folders are listed level by level on the executors: each level's folders are spread by a
    hash over as many tasks as there are folders, ``tasks`` at most (four times the default
    parallelism if not given). Folders and files that cannot be read are left out. A level is
    kept by checkpoint() where the session has a checkpoint folder, and else persisted on disk.
    """
    root = os.path.abspath(root)
    if os.path.isfile(root):
        found = spark.createDataFrame([(root, os.path.basename(root), os.path.getsize(root))], "path string, name string, length bigint")
        return found
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    shared = spark.sparkContext.getCheckpointDir() is not None
    here = _listing(spark.createDataFrame([(root,)], "path string"), shared)
    found = []
    skip = sorted(SKIPPED | set(filters.get("skip_dirs") or ()))
    while True:
        found.append(here.where("NOT dir").select("path", "length"))
        level = here.where("dir").where(~name_of(F.col("path")).isin(*skip)).select("path")
        folders = level.count() if recursive else 0
        if not folders:
            break
        # A number of its own, so that adaptive execution does not fold the small rows into one task.
        here = _listing(level.repartition(min(folders, tasks), "path"), shared)
    out = found[0]
    for part in found[1:]:
        out = out.unionAll(part)
    return out.where(admitted(F.col("path"), root=root, **filters)).select("path", name_of(F.col("path")).alias("name"), "length").orderBy(F.lower("path"))


def _listing(folders: DataFrame, shared: bool) -> DataFrame:
    """path, length, dir, task of all entries of ``folders``, kept for the next level."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for batch in batches:
            rows = [entry for folder in batch.column(0).to_pylist() for entry in _entries(folder)]
            kinds = [("path", pa.string()), ("length", pa.int64()), ("dir", pa.bool_())]
            columns = [pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)]
            yield pa.record_batch([*columns, pa.array([task] * len(rows), pa.int32())], [*[n for n, _ in kinds], "task"])

    made = folders.mapInArrow(listed, "path string, length bigint, dir boolean, task int")
    return made.checkpoint() if shared else made.persist(StorageLevel.DISK_ONLY)


def _entries(folder: str) -> Iterator[tuple[str, int, bool]]:
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                try:
                    if e.is_dir(follow_symlinks=False):
                        yield e.path, 0, True
                    elif e.is_file():
                        yield e.path, e.stat().st_size, False
                except OSError:
                    continue
    except OSError:
        return


def read_contents(paths: DataFrame, max_bytes: int | None = 512 << 20) -> DataFrame:
    """path, name, length, content; content is null where a file is over the limit or gone."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, length in zip(*(c.to_pylist() for c in batch.columns[:3])):
                raw = None
                if max_bytes is None or length <= max_bytes:
                    try:
                        with open(path, "rb") as f:
                            raw = f.read()
                    except OSError:
                        raw = None
                yield pa.record_batch(
                    [pa.array([path]), pa.array([name]), pa.array([length], pa.int64()), pa.array([raw], pa.binary())], ["path", "name", "length", "content"]
                )

    return paths.select("path", "name", "length").mapInArrow(load, "path string, name string, length bigint, content binary")


def binary_files(spark: SparkSession, root: str, glob: str | None = None, max_bytes: int | None = 512 << 20) -> DataFrame:
    """The same from any file system that Spark reads; names that begin with . or _ are hidden."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(root)
    if max_bytes is not None:
        df = df.where(F.col("length") <= max_bytes)  # pushed into the listing
    return df.select("path", name_of(F.col("path")).alias("name"), "length", "content")

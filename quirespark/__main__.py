"""python -m quirespark PATH... --out FOLDER: convert files or trees, and report."""

from __future__ import annotations

import argparse
import os
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quirespark", description="Convert documents to Markdown with Spark.")
    p.add_argument("paths", nargs="*", help="files or folders")
    p.add_argument("--out", help="folder of the output; beside the sources in .md/ if not given")
    p.add_argument("--table", help="write the results as a Parquet table instead of files")
    p.add_argument("--batch-report", help="write the machine-readable report of the batch into this folder")
    p.add_argument("--format", dest="force_format", help="skip detection")
    p.add_argument("--pattern", action="append", dest="patterns", help="glob of names to take")
    p.add_argument("--exclude", action="append", help="glob of names or paths to leave out")
    switches = {"stdout": "print the Markdown", "formats": "list formats and their readers", "overwrite": "replace files", "flat": "do not mirror the tree", "summary": "print the batch report",
                "numbered-headings": "see headings in numbered lines", "report-json": "write diagnoses beside each file"}
    for name, meaning in switches.items():
        p.add_argument("--" + name, action="store_true", help=meaning)
    p.add_argument("--master", default="local[*]")
    for name in ("front-matter", "report", "links", "images", "chrome-filter", "code-outline", "csv-header"):
        p.add_argument(f"--no-{name}", action="store_true")
    for name in ("csv-max-rows", "json-max-rows"):
        p.add_argument(f"--{name}", type=int)
    return p


def main(words: list[str] | None = None) -> int:
    """0: all converted; 1: some failed or are empty; 2: nothing to do."""
    from pyspark.sql import functions as F

    from quirespark.operators.chain import load
    from quirespark.plans import corpus
    from quirespark.plans.convert import assembled, convert
    from quirespark.schemas import BAD_STATUSES, Options
    from quirespark.session import session
    from quirespark.sources.files import read_contents, walk

    args = parser().parse_args(words)
    if args.formats:
        for r in load().describe():
            print(f"{r['format']:22} {r['converter']:22} {'yes' if r['available'] else 'needs ' + r['requires']}")
        return 0
    if not args.paths:
        return 2
    options = Options.of(
        output_dir=args.out, overwrite=args.overwrite, mirror=not args.flat, force_format=args.force_format, front_matter=not args.no_front_matter,
        report=not args.no_report, keep_links=not args.no_links, keep_images=not args.no_images, drop_chrome=not args.no_chrome_filter,
        code_outline=not args.no_code_outline, csv_header=not args.no_csv_header, csv_max_rows=args.csv_max_rows,
        json_max_rows=args.json_max_rows, numbered_headings=args.numbered_headings, report_json=args.report_json,
    )
    spark = session(args.master)
    spark.sparkContext.setLogLevel("ERROR")
    made = None
    out = os.path.abspath(args.out) if args.out else None
    for path in args.paths:
        root = os.path.abspath(path)
        base = root if os.path.isdir(root) else os.path.dirname(root)
        found = walk(spark, root, patterns=args.patterns, exclude=args.exclude, output_dir=out)
        named = found.withColumn("output", corpus.output_path(F.col("path"), out, base, options.mirror, options.suffix)).withColumn("skipped", F.lit(False))
        # In a tree, sources whose output is there already are skipped: counted, not converted.
        target = out or os.path.join(base, ".md")
        there = walk(spark, target).select(F.col("path").alias("output")) if os.path.isdir(root) and os.path.isdir(target) and not args.overwrite else None
        todo = named if there is None else corpus.not_yet(named, there)
        done = convert(read_contents(todo, options.max_bytes).join(todo.select("path", "output", "skipped"), "path"), options)
        if there is not None:
            done = done.unionByName(corpus.skipped_rows(named.join(there, "output", "left_semi"), done.schema))
        made = done if made is None else made.unionByName(done)
    # Each row is converted once: the table is what files, counts and printing are made from.
    made = made.persist()
    if made.isEmpty():
        return 2
    failed = 0
    if args.stdout:
        for row in assembled(made, options).select("markdown").toLocalIterator():
            print(row["markdown"], end="")
    elif args.table:
        corpus.write_corpus(made, args.table)
    else:
        written = corpus.write_files(assembled(made.where("NOT skipped"), options), options).groupBy("written").count().collect()
        failed = sum(r["count"] for r in written if not r["written"])
        print("written:", sum(r["count"] for r in written if r["written"]))
    if args.batch_report:
        corpus.write_batch_report(made, args.batch_report)
    if args.summary:
        for row in corpus.report_text(made).orderBy("part", "at", "line").toLocalIterator():
            print(row["line"])
    counts = corpus.summary(made).first().asDict()
    print(counts, file=sys.stderr)
    return int(bool(failed) or any(counts[s] for s in BAD_STATUSES))


if __name__ == "__main__":
    sys.exit(main())

"""The table functions over whole texts and tables."""

from __future__ import annotations

import json

from quirespark.functions.tables import register
from quirespark.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_json_paths_are_never_cut(spark):
    register(spark)
    wide = json.dumps({f"k{i}": i for i in range(1000)})
    found = spark.createDataFrame([(wide,)], "t string").createOrReplaceTempView("wide")
    assert found is None and spark.sql("SELECT f.path FROM wide, LATERAL md_json_paths(t) f").count() == 1000


def test_outline_reads_the_tables(spark):
    found = QUERIES["document_outline"](spark, SF)
    wanted = sum(len(json.loads(r["props"])) for r in spark.read.parquet(f"{SF}/events.parquet").select("props").collect())
    assert found.where("kind = 'path'").count() == wanted + 2

"""Character references that lack their semicolon, as a text has that was cut inside of one."""

from __future__ import annotations

import duckdb
import pytest

from quirespark.operators.html import html_title, html_to_markdown
from quirespark.oracle import SQL
from quirespark.queries import QUERIES

CUT = [
    "one&amp;&amp;&amp", "two&amp;&am", "three &", "say &quot;x&quot", "it&#39", "a &lt b &gt c", "R&D &copy 2", "&amp;lt; &amp;amp", "&lt;b&gt;&amp;", "&ampx; &notit;",
    "own \ufdd0 sign&amp",
]


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cut")
    page = "<!doctype html><html><head><title>{0}</title></head><body><h1>{0}</h1><p>{0}</p><p><b>{0}<br></p><p>{0}</p><div>end &copy; &middot;</div></body></html>"
    rows = [(i, f"https://x.test/{i}", page.format(t)) for i, t in enumerate(CUT)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def held_against_sql(spark, folder, name):
    made = QUERIES[name](spark, str(folder))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return sorted(map(tuple, made.collect())), sorted(c.sql(f"SELECT {', '.join(made.columns)} FROM ({SQL[name]})").fetchall())


def test_facts_of_titles_cut_inside_a_reference_equal_their_sql(spark, cut):
    made, expected = held_against_sql(spark, cut, "html_conversion_facts")
    assert made == expected and made[0][1] == "one&&&amp" and len(made) == len(CUT)


def test_markdown_of_pages_cut_inside_a_reference_equals_its_sql(spark, cut):
    made, expected = held_against_sql(spark, cut, "html_markdown")
    assert made == expected and made[0][3].startswith("# one&&&amp\n\none&&&amp\n\n**one&&&amp**") and len(made) == len(CUT)


def test_titles_take_open_references_or_leave_them():
    html = "<title>x</title><h1>a&amp;b &lt c&ampd; &#233 &eacute;</h1>"
    assert html_title(html) == "a&b < c&d; é é"
    assert html_title(html, engine="strict") == "a&b &lt c&ampd; &#233 é"


def test_bodies_take_open_references_or_leave_them():
    html = '<p>a&amp;b &lt c</p><pre>x &gt y &amp;&amp z</pre><a href="/?a=1&copy=2&amp;b">l&#39s</a>'
    assert html_to_markdown(html)[0].startswith("a&b < c\n\n```\nx > y && z\n```\n\n")
    assert html_to_markdown(html, engine="strict")[0] == "a&b &lt c\n\n```\nx &gt y &&amp z\n```\n\n[l&#39s](/?a=1&copy=2&b)"

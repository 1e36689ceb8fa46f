"""Tables of HTML pages come whole: nested ones, ones without end tags, and all their rows in the query."""

import random

import pytest

from sheaf.operators import chunking
from sheaf.plans import catalog
from sheaf.sources import extract


def told(source):
    return [(e["kind"], e.get("rows") or e["text"]) for e in extract.read_html(source.encode())]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<table><tr><td>a<table><tr><td>in</td></tr></table>b</td><td>c</td></tr><tr><td>d</td></tr></table>x", [("table", [["in"]]), ("table", [["a b", "c"], ["d", ""]]), ("paragraph", "x")]),
        ("<table><tr><td>a<td>b<tr><th>c</table>x", [("table", [["a", "b"], ["c", ""]]), ("paragraph", "x")]),
        ("<table><thead><tr><th>k<tbody><tr><td>v</tbody></table>", [("table", [["k"], ["v"]])]),
        ("<table><tr><td>k</td><td>v</table><p>x", [("table", [["k", "v"]]), ("paragraph", "x")]),
        ("a<table><tr><td>k</td></tr><h2>h</h2><p>x<table><tr><td>v</td></tr></table>y", [("paragraph", "a"), ("table", [["k"]]), ("heading", "h"), ("paragraph", "x"), ("table", [["v"]]), ("paragraph", "y")]),
        ("<table><tr><td>a<table><tr><td>b", [("table", [["a"]]), ("table", [["b"]])]),
        ("<table><td>a<td>b</table>x", [("table", [["a", "b"]]), ("paragraph", "x")]),
        ("<table><tr><td>a<template><table><tr><td>no</td></tr></table></td></template></td><td>b</td></tr></table>", [("table", [["a", "b"]])]),
        ("<table></table><table><tr></table></table>x", [("paragraph", "x")]),
    ],
)
def test_tables(source, want):
    assert told(source) == want


def test_each_word_comes_once():
    r = random.Random(4)
    tags = [f"<{end}{t}>" for t in "table tr td th tbody p h2 div template".split() for end in ("", "/")]
    tags = [t for t in tags if "template" not in t] * 3 + ["<template></template>"]
    for _ in range(2000):
        words = [f"w{i}" for i in range(r.randrange(1, 25))]
        page = "".join(f"{r.choice(tags)}{r.choice(tags)} {w} " for w in words)
        said = [w for _, x in told(page) for w in (" ".join(c for row in x for c in row) if isinstance(x, list) else x).split()]
        assert sorted(said) == sorted(words), page


def test_query_has_all_rows(spark, tmp_path):
    page = "<h1>t</h1><table><tr><th>k</th><th>v</th></tr>" + "".join(f"<tr><td>{i}</td><td></td></tr>" for i in range(300)) + "<tr><td>x</td><td>y</td></tr></table><table><tr><td>lone</td></tr></table><p>end</p>"
    spark.createDataFrame([(7, "u", page)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = catalog.QUERIES["html_elements"](spark, str(tmp_path)).orderBy("ordinal").collect()
    whole = "\n".join(["k | v", *(f"{i} | " for i in range(300)), "x | y"])
    assert [tuple(x) for x in rows] == [("page-7.html", 0, "heading", 1, "t"), ("page-7.html", 1, "table", None, whole), ("page-7.html", 2, "table", None, "lone"), ("page-7.html", 3, "paragraph", None, "end")]
    assert "Section: t\nlone" in [x["text"] for x in catalog.QUERIES["html_chunks"](spark, str(tmp_path)).collect()]


def test_a_lone_row_is_a_chunk():
    made = chunking.build_chunks([{"ordinal": 0, "kind": "table", "text": "a | b", "rows": [["a", "b"]]}])
    assert [(c["text"], c["locator"], c["elements"]) for c in made] == [("a | b", "row 1", [0])]

"""Trees of pages: text once, siblings noted by the parser, the node table spread out of them."""

from pyspark.sql import functions as F

from registrum.sources import html

PAGE = """<html><body>top<div class="card"><table><tr><th>Reference</th><td>A <b>1</b></td></tr><tr><td>Site Address</td><td>2 Lane</td></tr></table>
<dl><dt>Proposal<dd>Gates &amp; walls<dt>Ward<dd>North</dl><p class="label">Status</p><p>Open</p><script>var a = "<p>";</script><style>p {}</style><input type="hidden" name="caseNo" value="7">
<ul><li>one<ul><li>two</ul><li>three</ul></div>tail</body></html>"""


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id int, html string")


def test_text_is_stored_once(spark):
    deep = "<div>" * 60 + "words that stand deep" + "</div>" * 60
    t = html.trees(pages(spark, PAGE, deep, None, "", "bare text"))
    kept = {r["page_id"]: sum(map(len, r["pieces"])) + sum(map(len, r["code"])) for r in t.collect()}
    assert kept[1] == len("words that stand deep") and kept[0] <= len(PAGE) and kept[2] == kept[3] == 0 and kept[4] == len("bare text")
    texts = html.spread(t).filter("page_id = 1").select("text").distinct().collect()
    assert [r[0] for r in texts] == ["words that stand deep"]


def test_nodes_and_their_texts(spark):
    n = html.nodes(pages(spark, PAGE))
    one = {(r["tag"], r["node"]): r for r in n.collect()}
    text = lambda tag: [" ".join(r["text"].split()) for (t, _), r in sorted(one.items(), key=lambda x: x[0][1]) if t == tag]
    assert text("td") == ["A 1", "Site Address", "2 Lane"] and text("dd") == ["Gates & walls", "North"] and text("script") == ['var a = "<p>";'] and text("style") == ["p {}"]
    assert text("li") == ["one two", "two", "three"] and "var a" not in text("body")[0] and text("body")[0].startswith("top Reference A 1") and text("body")[0].endswith("three tail")
    assert all(r["up"][-1:] == ([r["parent"]] if r["parent"] >= 0 else []) for r in one.values())
    assert got(html.text_sequence(pages(spark, "<p>a</p><script>b</script> <i>c</i>d")), "place", "text") == [(0, "a"), (1, "b"), (3, "c"), (4, "d")]


def test_pairs_of_trees_equal_those_of_the_node_table(spark):
    p = pages(spark, PAGE, "<table><tr><td>Ward</td><input><td>x</td><td>y</td></tr></table><dl><dt>a<p>z</p><dd>b</dl>", None)
    for marks in (False, True):
        cols = ("page_id", "source", "ordinal", "label", "value")
        over = got(html.labelled_pairs(html.trees(p), class_labels=marks), *cols)
        assert over == got(html.labelled_pairs(html.nodes(p), class_labels=marks), *cols) and len(over) >= 6
        assert any(r[3:] == ("status", "Open") for r in over) == marks


def test_enclosing_and_first_within(spark):
    n = html.nodes(pages(spark, '<div class="a"><div><ul><li><a href="/1">x</a> y</ul></div></div><a href="/2">z</a>', '<tr><td><div class="a"><a href="/3">w</a></div></tr>'))
    a = html.anchors(n)
    outer = html.enclosing(a, n, [F.col("tag") == "tr", html.has_class("a")])
    assert got(outer, "href", F.trim("outer_text")) == [("/1", "x  y"), ("/2", None), ("/3", "w")]
    assert got(html.enclosing(a.drop("up"), n, [F.col("tag") == "tr", html.has_class("a")]), "href", "outer") == got(outer, "href", "outer")
    assert got(html.first_within(outer, n, F.col("tag") == "li", "item"), "href", "item") == [("/1", "x y"), ("/2", None), ("/3", None)]
    assert got(html.containers(n), "href", "context") == [("/1", "x y"), ("/2", None), ("/3", "w")]


def test_joins_go_by_node_not_by_page(spark):
    n = html.nodes(pages(spark, PAGE))
    plan = html.enclosing(html.anchors(n), n, [F.col("tag") == "tr"])._jdf.queryExecution().optimizedPlan().toString()
    assert "page_id" in plan and "<= last" not in plan and "> _n" not in plan

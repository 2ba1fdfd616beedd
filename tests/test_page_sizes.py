"""Trees and listings of pages with very many rows: what is held and moved grows with the page, not with its square."""

from pyspark.sql import functions as F

from registrum.sources import html
from registrum.sources import portals as P


def test_rows_without_end_tags_do_not_nest(spark):
    n = 300
    page = "<table><tr><th>Application Number<th>Location" + "".join(f'<tr><td><a href="/d?{i}">A{i}</a><td>{i} Road <b>x' for i in range(n)) + "</table>"
    rows = html.parse(page).rows
    assert {len(r[7]) for r in rows if r[2] == "tr"} == {1} and max(len(r[7]) for r in rows) <= 4
    assert sum(r[5] - r[4] for r in rows) < 20 * n  # pieces of all nodes' texts
    h = html.header_tables(html.nodes(spark.createDataFrame([(1, page)], "page_id int, html string"))).filter("column = 'address'")
    assert sorted(tuple(r) for r in h.select("value", "href").collect()) == sorted((f"{i} Road x", f"/d?{i}") for i in range(n))


def test_open_elements_end_up_to_their_scope(spark):
    tags = lambda page: [(r[2], [t for k in r[7] for t in [html_rows[k][2]]]) for html_rows in [html.parse(page).rows] for r in html_rows]
    assert tags("<table><tr><td><table><tr><td>a<tr><td>b</table><tr><td>c</table>") == [
        ("table", []), ("tr", ["table"]), ("td", ["table", "tr"]), ("table", ["table", "tr", "td"]), ("tr", ["table", "tr", "td", "table"]), ("td", ["table", "tr", "td", "table", "tr"]),
        ("tr", ["table", "tr", "td", "table"]), ("td", ["table", "tr", "td", "table", "tr"]), ("tr", ["table"]), ("td", ["table", "tr"]),
    ]
    assert tags("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == [("ul", []), ("li", ["ul"]), ("ul", ["ul", "li"]), ("li", ["ul", "li", "ul"]), ("li", ["ul", "li", "ul"]), ("li", ["ul"])]


def test_texts_of_ancestors_stay_where_they_are(spark):
    """The text of a table around many tables goes along with none of them, and results are the same."""
    n = 200
    one = '<tr><td><table><tr><td><a href="PlAppDets.asp?casefullref=N{0}">N{0}</a></td><td>Registered : 05/06/2026</td></tr><tr><td colspan="2">Gates at {0} Road</td></tr><tr><td colspan="2"><form>a form with a far longer text</form></td></tr></table></td></tr>'
    p = spark.createDataFrame([(k, "<table>" + "".join(one.format(i) for i in range(n)) + "</table>") for k in range(2)], "page_id int, html string")
    nodes = html.stored_nodes(p)
    got = P.nested_results(nodes, F.lit("https://r.example/a/list.do"))
    assert sorted(tuple(r) for r in got.select("page_id", "reference", "description", "address").collect()) == sorted((k, f"N{i}", f"Gates at {i} Road", f"{i} Road") for k in range(2) for i in range(n))
    met = html.nearest(html.anchors(nodes), nodes, [F.col("tag") == "table"])
    assert "outer_text" not in met.columns and met.select("outer").distinct().count() == n
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and " > " in x]  # no pairs of all numbers of a page

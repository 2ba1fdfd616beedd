"""Operators over small tables, HTML and payload decoding, the limiter, and the whole lead search."""

import base64
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from registrum.functions import fixed
from registrum.operators import relations as R
from registrum.plans import leads
from registrum.sources import html, payloads, sinks
from registrum.streaming import limiter


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_first_wins_and_union(spark):
    d = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "k string, o int, v string")
    assert rows(R.first_wins(d, ["k"], ["o"])) == [("a", 1, "y"), ("b", 1, None)]
    assert rows(R.union_distinct([d.filter("o = 2"), d.filter("o = 1")], ["k"], ["o"])) == [("a", 2, "x"), ("b", 1, None)]
    assert rows(R.first_wins(d.limit(0), ["k"], ["o"])) == []


def test_merge_and_conditional_fallback(spark):
    m = spark.createDataFrame([("t", " 1 ", "", "d1"), ("t", "2", "a2", None)], "authority string, reference string, address string, description string")
    f = spark.createDataFrame([("t", "1", "fa", "fd"), ("t", "3", "a3", "d3"), ("u", "9", "a9", "d9")], m.schema)
    got = rows(R.merge_fallback(m, f, "reference", ["address", "description"], ["authority"]).select("reference", "address", "description", "supplemented"))
    assert got == [(" 1 ", "fa", "d1", True), ("2", "a2", None, False), ("3", "a3", "d3", False), ("9", "a9", "d9", False)]
    s = spark.createDataFrame([("t", False, False), ("u", False, False)], "authority string, failed boolean, feed_first boolean")
    assert [r[1] for r in rows(R.conditional_fallback(s, m, f, "authority").select("authority", "reference"))] == [" 1 ", "2", "9"]
    assert [r[0] for r in rows(leads.reconciled(m, f, s).select("reference"))] == [" 1 ", "2", "9"]


def test_overlay_keeps_stubs(spark):
    s = spark.createDataFrame([(1, "a", "d"), (2, "b", "e")], "k int, x string, y string")
    d = spark.createDataFrame([(1, "", "D")], s.schema)
    assert rows(R.overlay(s, d, ["k"], ["x", "y"])) == [(1, "a", "D", True), (2, "b", "e", False)]


def test_bisection_covers_the_range(spark):
    from datetime import date, timedelta

    d = spark.createDataFrame([(date(2026, 1, 1) + timedelta(days=i), i % 7) for i in range(60)], "day date, n long")
    w = rows(R.bisect_windows(d, "2026-01-01", "2026-03-01", 20))
    assert w[0][0] == date(2026, 1, 1) and w[-1][1] == date(2026, 3, 1)
    assert all((b[0] - a[1]).days == 1 for a, b in zip(w, w[1:])) and all(n <= 20 or s == e for s, e, n in w)


PAGE = """<html><head><title>Application  Summary</title></head><body><table>
<tr><th>Reference</th><td>26/001/FUL</td><tr><th>Proposal<td>Gates &amp; wall</tr><tr><td>Site Address:</td><td>1 Road</td></tr></table>
<dl><dt>Ward<dd>North</dl><ul><li>26/002 <a href="/d?keyVal=K1">View</a> text<li><a href='/docs/plan.pdf'>Plan</a></ul>
<p>first 10 shown, there are 25 in total</p><a href="?page=3">3</a><a href="?page=2">2</a></body></html>"""


def test_html_operators(spark):
    p = spark.createDataFrame([(1, PAGE), (2, None), (3, "<a href=x>broken")], "page_id int, html string")
    n = html.nodes(p).cache()
    f = html.label_columns(html.labelled_pairs(n), "generic").select("page_id", "reference", "description", "address", "ward")
    assert rows(f) == [(1, "26/001/FUL", "Gates & wall", "1 Road", "North")]
    assert rows(html.single_summary(n)) == [(1,)]
    c = {r["href"]: r["context"] for r in html.containers(n).filter("page_id = 1").collect()}
    assert c["/d?keyVal=K1"] == "26/002 View text" and c["/docs/plan.pdf"] == "Plan"
    assert [r[0] for r in rows(html.document_links(n, F.lit("https://h/x")).select("url"))] == ["https://h/docs/plan.pdf"]
    assert [r["page"] for r in html.next_pages(n).orderBy("page").collect()] == [2, 3]
    t = p.filter("page_id = 1").select(html.reported_total(F.col("html")).alias("t")).first()["t"]
    assert (t["total"], t["shown"]) == (25, 10)


def test_header_table(spark):
    h = "<table><tr><td>Search</td></tr><tr><th>Application No</th><th>x</th><th>Location</th></tr><tr><td><a href='/1'>A1</a></td><td></td><td>Here</td></tr></table>"
    n = html.nodes(spark.createDataFrame([(1, h)], "page_id int, html string"))
    assert rows(html.header_tables(n).select("column", "value", "href")) == [("address", "Here", "/1"), ("reference", "A1", "/1")]


def test_json_families(spark):
    body = json.dumps({"actions": [{"state": "SUCCESS", "returnValue": {"returnValue": {"records": [{"Id": "a", "Name": "R1", "Site_Address__c": "x AB1 2CD", "Received_Date__c": "2026-06-05T00:00:00"}]}}}]})
    p = spark.createDataFrame([(1, body), (2, "no json"), (3, '{"actions":[{"state":"ERROR"}]}')], "k int, body string")
    a = payloads.applications(p, "arcus").select("k", "uid", "reference", "address", "date_received", "postcode")
    assert rows(a) == [(1, "a", "R1", "x AB1 2CD", "2026-06-05", "AB1 2CD")]
    assert rows(payloads.json_errors(p, "body").select("k", "reason")) == [(2, "invalid json"), (3, "error action")]
    items = spark.createDataFrame([([("a", "A", "1"), ("a", None, "2")],)], "i array<struct<n: string, l: string, v: string>>")
    assert items.select(payloads.attribute_map(F.col("i"), ["n", "l"], ["v"])).first()[0] == {"a": "2", "A": "1"}


def test_csv_xml_binary(spark):
    text = '﻿Weekly\r\n\r\napplication_number,proposal1\r\nA/1,"two\r\nlines"\r\n'
    p = spark.createDataFrame([(1, base64.b64encode(text.encode()).decode().rstrip("="))], "k int, body string")
    assert payloads.weekly_csv(p, "k", "body").first()["cells"] == {"application_number": "A/1", "proposal1": "two lines"}
    r = [(1, 2, 3, 4, 5, 6, 7, 8, 1.5, -2.5, ["é"] * payloads.BINARY_TEXTS)]
    assert payloads.decode_records(payloads.encode_records(r)) == r
    with pytest.raises(ValueError):
        payloads.decode_records(payloads.encode_records(r) + b"\0")
    b = payloads.binary_records(spark.createDataFrame([(1, b"\1\0\0\0")], "k int, body binary"), "k", "body").first()
    assert b["ordinal"] == -1 and b["error"]
    x = spark.createDataFrame([(1, "<Rows><Row id='1'><result column='c'>v</result></Row></Rows>")], "k int, body string")
    assert rows(payloads.xml_rows(x, "body").select("column", "value")) == [("c", "v")]


def test_payload_source(spark, tmp_path):
    (tmp_path / "p1.json").write_text('[{"pk": "1"}]')
    d = payloads.stored_payloads(spark, str(tmp_path), "socrata")
    assert rows(d) == [("socrata", "p1.json", '[{"pk": "1"}]')]


def test_limiter_states():
    s = limiter.Limiter.of("idox")
    assert [s.apply(0, "service_unavailable"), s.apply(1, "service_unavailable"), s.limit, s.blocked_until] == [False, True, 2, 9.0]
    assert s.apply(2, "rate_limited") and s.limit == 1 and s.blocked_until == 17.0
    assert [s.apply(3, "success") for _ in range(4)] == [False, False, False, True] and s.limit == 2
    assert not s.apply(4, "failed") and s.streak == 0
    assert s.apply(5, "blocked") and s.apply(6, "blocked") and s.limit == 1
    one = limiter.Limiter.of("planit")
    assert one.apply(0, "blocked") and one.limit == 1


def test_limiter_stream_equals_replay(spark, tmp_path):
    signals = ["success", "rate_limited", "blocked", "service_unavailable", "failed"]
    e = spark.createDataFrame([(f"p{i % 3}", float(i), i, signals[i * 7 % 5]) for i in range(60)], "platform string, at double, event_id long, signal string")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = limiter.stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("limits")) == rows(limiter.replay(e))
    d = limiter.dispatch(spark.createDataFrame([("a", "civica", "h1", 0), ("b", "civica", "h1", 1), ("c", "civica", "h2", 2)], "item string, platform string, host string, ordinal int"))
    # a platform passes over a task whose host is busy, so c doesn't wait behind b
    assert {r["item"]: r["started"] for r in d.collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}
    shared = [("a", "civica", "h1", 0), ("b", "idox", "h1", 1), ("c", "idox", "h2", 2), ("d", "idox", "h3", 3), ("e", "idox", "h4", 4)]
    d = limiter.dispatch(spark.createDataFrame(shared, "item string, platform string, host string, ordinal int"))
    assert {r["item"]: (r["turn"], r["started"]) for r in d.collect()} == {"a": (0, 0.0), "c": (1, 0.0), "d": (2, 0.0), "e": (3, 0.0), "b": (4, 1.0)}


def test_catalogue_and_sinks(spark, tmp_path):
    g = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}
    c = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"authority": "Nuneaton", "portal_family": "idox", "link_test_ok": True}, "geometry": g}, {"type": "Feature", "properties": {"council_name": "Far", "planning_url": "https://f"}, "geometry": {"type": "Polygon", "coordinates": [[[9, 9], [10, 9], [10, 10]]]}}]}
    (tmp_path / "c.json").write_text(json.dumps(c))
    (tmp_path / "b.json").write_text(json.dumps({"type": "Polygon", "coordinates": [[[1, 1], [3, 1], [3, 3], [1, 3]]]}))
    cat = payloads.catalogue(spark, str(tmp_path / "c.json"))
    assert rows(cat.select("authority", "portal_family", "listing_url", "link_test_ok")) == [("Far", "unknown", "https://f", False), ("Nuneaton", "tascomi", "https://idoxcloud.nuneatonandbedworth.gov.uk/planning/index.html?fa=search", True)]
    area = payloads.boundary(spark, str(tmp_path / "b.json"))
    assert [r["authority"] for r in leads.targets(cat, area).collect()] == ["Nuneaton"]
    sinks.write_failures(spark.createDataFrame([("a", "f", "s", None, "r")], ", ".join(f"{c} string" for c in fixed.FAILURE_COLUMNS)), str(tmp_path / "f"))
    assert next((tmp_path / "f").glob("part-*.csv")).read_text().split() == [",".join(fixed.FAILURE_COLUMNS), "a,f,s,,r"]


def test_lead_search(spark):
    schema = "authority string, target_ordinal int, ordinal int, uid string, reference string, url string, source_url string, address string, description string, date_received string, date_validated string, raw string"
    at = lambda x, y: json.dumps({"location": {"coordinates": [x, y]}})
    a = spark.createDataFrame([
        ("T", 0, 0, "u1", "R1", "https://x/1", None, "1 Road", "New gates", "2026-06-05", None, at(1, 1)),
        ("T", 0, 1, "u2", "R1", "https://x/2", None, "1 Road", "New gates again", "2026-06-05", None, at(1, 1)),
        ("T", 0, 2, "u3", "R3", None, None, "2 Road", "Railings", "2026-07-05", None, at(1, 1)),
        ("T", 0, 3, "u4", None, None, "https://s", None, "Front wall", "", "2026-06-06", "{}"),
        ("T", 0, 4, "u5", "R5", "https://x/5", None, "3 Road", "Railings", "2026-06-05", None, at(7, 7)),
        ("U", 1, 0, "u6", "R6", "https://x/6", None, "Gateshead", "Discharge of condition 3", "2026-06-05", None, "{}"),
    ], schema)
    area = leads.boxed(spark.range(1), F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D, 'y', 0D), named_struct('x', 2D, 'y', 2D), named_struct('x', 0D, 'y', 2D))"))
    got = leads.leads(a, area, "2026-06-01", "2026-06-30")
    assert got.columns == fixed.APPLICATION_COLUMNS
    assert rows(got) == [("R1", "1 Road", "https://x/1", "New gates", "2026-06-05", "T"), ("u4", "", "https://s", "Front wall", "2026-06-06", "T")]
    t = spark.createDataFrame([("T", 0, 1, True, 0), ("T", 0, 2, False, 5), ("U", 1, 1, False, 0)], "authority string, ordinal int, attempt int, failed boolean, n int")
    h = leads.run_summary(t, got, fixed.STANDARD_KEYWORDS, "d", "t").first()
    assert tuple(h) == ("d", "t", "Standard", 5, 2, "40.00%", "", "U", "Completed", 0)


def test_the_entry_needs_no_session():
    """Names and SQL can be read before Spark runs."""
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent, timeout=120)


def test_every_query_has_stable_columns(spark):
    import __spark_entry__ as e

    q = e.queries()
    assert set(e.oracle_sql()) <= set(q) and "lead_funnel" in q
    assert e.entry(spark).columns == ["authority", "total", "relevant", "ratio"]


def test_streamed_leads_come_once(spark, tmp_path):
    row = lambda r, day: (r, "a", f"2026-06-0{day} 00:00:00")
    schema = "Reference string, council string, at timestamp"
    write = lambda rows_, mode: spark.createDataFrame(rows_, "Reference string, council string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode(mode).parquet(str(tmp_path / "in"))
    for batch in ([row("1", 1), row("2", 1)], [row("2", 2), row("3", 2)]):
        write(batch, "append")
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        sinks.stream_applications(s, str(tmp_path / "out"), str(tmp_path / "c"), "at").awaitTermination(120)
    assert [r[0] for r in rows(spark.read.parquet(str(tmp_path / "out")).select("Reference"))] == ["1", "2", "3"]

"""Column functions against values written here."""

import hashlib
from datetime import date, datetime

from pyspark.sql import functions as F

from registrum.functions import dates, files, fixed, geometry, text, urls


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*cols).collect()]


def test_clean_text_and_labels(spark):
    rows = [("  A&amp;B   c d\n",), ("",), (None,), (" \x1c ",)]
    assert values(spark, rows, "t string", text.clean_text("t"), text.normalize_label("t")) == [("A&B c d", "aandb_c_d"), (None, ""), (None, ""), (None, "")]


def test_postcode_takes_first_column_that_has_one(spark):
    rows = [(None, "1 Road, ab1 2cd"), ("x SW1A1AA", "AB1 2CD"), ("", "none")]
    assert values(spark, rows, "a string, b string", text.extract_postcode("a", "b")) == [("AB1 2CD",), ("SW1A 1AA",), (None,)]


def test_dates_in_every_format(spark):
    rows = [(s,) for s in ("05/06/2026", "5/6/69", "5-6-68", "2026-06-05", "05-June-2026", "5-jun-2026", "5 June 2026", "Fri 05 Jun 2026", "Friday 5 June 2026", "31/02/2026", "soon", " ", None)]
    got = [r[0] for r in values(spark, rows, "t string", dates.parse_council_date("t"))]
    assert got == ["2026-06-05", "1969-06-05", "2068-06-05"] + ["2026-06-05"] * 6 + ["31/02/2026", "soon", None, None]


def test_iso_date_is_strict(spark):
    rows = [("2026-06-05T10:00:00",), ("2026",), ("20260605",), ("2026-13-01",)]
    assert values(spark, rows, "t string", dates.iso_date("t")) == [(date(2026, 6, 5),), (None,), (None,), (None,)]


def test_windows(spark):
    rows = [(date(2026, 6, 1), date(2026, 6, 14)), (date(2026, 6, 2), date(2026, 6, 14))]
    got = values(spark, rows, "s date, e date", dates.week_starts(F.col("s"), F.col("e")), dates.whole_weeks(F.col("s"), F.col("e")), F.size(dates.days(F.col("s"), F.col("e"))))
    assert got == [([date(2026, 6, 1), date(2026, 6, 8)], True, 14), ([date(2026, 6, 1), date(2026, 6, 8)], False, 13)]


def test_retry_after(spark):
    rows = [("7",), ("900",), ("Mon, 01 Jun 2026 00:00:30 GMT",), ("later",)]
    now = F.lit(datetime(2026, 6, 1)).cast("timestamp")
    assert values(spark, rows, "t string", dates.retry_after_seconds("t", now, 60)) == [(7.0,), (60.0,), (30.0,), (None,)]


def test_exclusions(spark):
    rows = [("T10 works",), ("Erect gates, condition 4 applies",), ("Retrospective gates",), ("Part  retrospective gates",), ("Variation\nof condition",), ("New gates",), (None,)]
    assert [r[0] for r in values(spark, rows, "t string", text.proposal_excluded("t"))] == [True, True, True, False, True, False, False]
    assert [r[0] for r in values(spark, [(" OLDHAM/1",), ("new",), (None,)], "t string", text.reference_excluded("t"))] == [True, False, False]


def test_keywords(spark):
    rows = [(' "gates" \n\n“Walls”\r\nGATES\n',), ("",)]
    assert values(spark, rows, "t string", text.parse_keywords("t")) == [(["gates", "Walls"],), ([],)]
    rows = [(fixed.STANDARD_KEYWORDS,), (["gates"],)]
    assert values(spark, rows, "k array<string>", text.keyword_set_name("k")) == [("Standard",), ("Custom",)]
    assert len(fixed.STANDARD_KEYWORDS) == 39 and len(fixed.EXCLUDED_PHRASES) == 27


def test_titles_and_paths(spark):
    rows = [("Site Plan.PDF", "site-plan"), ("", "x"), ("a", "b")]
    assert values(spark, rows, "a string, b string", text.titles_match("a", "b"), text.sanitize_path_part("a")) == [(True, "Site Plan.PDF"), (True, "untitled"), (False, "a")]


def test_signatures_take_the_first(spark):
    rows = [("", "https://x/online-applications/"), ("Planning Explorer", ""), ("fa=search ocella", ""), (None, None)]
    assert [r[0] for r in values(spark, rows, "h string, u string", text.portal_family("h", "u"))] == ["idox", "northgate", "ocella", None]


def test_failures(spark):
    rows = [("HTTP 429",), ("HTTP 403 Forbidden",), ("http 503",), ("boom",), ("connection refused",)]
    got = values(spark, rows, "e string", text.failure_signal("e"), text.failure_degraded("e"))
    assert got == [("rate_limited", True), ("blocked", True), ("service_unavailable", False), ("failed", True), ("failed", False)]


def test_urls(spark):
    rows = [("https://H.example/a/b?keyVal=X%2F1#t",), ("/rel?x=1",), (None,)]
    got = values(spark, rows, "u string", urls.uid_from_url("u", ["id", "keyVal"], "/([^/]+)$"), urls.base_url("u"), urls.path("u"))
    assert got == [("X/1", "https://H.example", "/a/b"), ("rel", "", "/rel"), (None, None, None)]
    rows = [("https://h/d/e.html", "../f g.pdf"), ("https://h/d/", "/x"), ("https://h/d", "https://o/y")]
    assert [r[0] for r in values(spark, rows, "b string, h string", urls.resolve("b", "h"))] == ["https://h/f%20g.pdf", "https://h/x", "https://o/y"]


def test_document_hrefs(spark):
    rows = [("/files/plan.pdf",), ("javascript:download()",), ("/privacy.pdf",), ("/design and access statement.pdf",), ("/search.do?document=1",), ("/page#documents",), (None,)]
    assert [r[0] for r in values(spark, rows, "h string", urls.is_document_href("h"))] == [True, False, False, True, False, False, False]


def test_file_types(spark):
    rows = [(b"%PDF-1", "text/html", "u"), (b"MZ..", "application/pdf", "u.pdf"), (b"<html>", "application/pdf", "u"), (b"abc", "image/x-dwg; q=1", "u"), (b"", "image/png", "u.png"), (None, "image/png", "u.png")]
    p, k, u = F.col("p"), F.col("k"), F.col("u")
    got = values(spark, rows, "p binary, k string, u string", files.is_real_file(p, k, u), files.extension(F.lit(None).cast("string"), u, k, p))
    assert got == [(True, ".pdf"), (False, ".pdf"), (False, ".pdf"), (True, ".dwg"), (False, ".png"), (False, ".png")]
    names = values(spark, [(["a.pdf", "A.pdf", "b", "a.pdf"],)], "n array<string>", files.unique_names(F.col("n")))
    assert names == [(["a.pdf", "A-2.pdf", "b", "a-3.pdf"],)]


def test_geometry_rules(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 4.0}]
    hole = [{"x": 1.0, "y": 1.0}, {"x": 2.0, "y": 1.0}, {"x": 2.0, "y": 2.0}, {"x": 1.0, "y": 2.0}]
    rows = [([[square, hole]], 3.0, 3.0), ([[square, hole]], 1.5, 1.5), ([[square]], 0.0, 0.0), ([[square]], 4.0, 2.0), ([[square[:2]]], 1.0, 0.0), ([], 1.0, 1.0)]
    got = values(spark, rows, f"g {geometry.GEOMETRY}, x double, y double", geometry.point_in_geometry(F.col("x"), F.col("y"), F.col("g")))
    assert [r[0] for r in got] == [True, False, True, False, False, False]


def test_geojson(spark):
    rows = [('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}',), ('{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1]]]]}',), ('{"type":"Point","coordinates":[0,0]}',)]
    assert [r[0] for r in values(spark, rows, "j string", F.size(geometry.from_geojson(F.col("j"))))] == [1, 1, 0]


def test_adapters_follow_the_rule_order(spark):
    rows = [("Wiltshire", "Idox", ""), ("Camden", "Idox", ""), ("Town", "Idox Tascomi", ""), ("Town", "Tascomi", "https://x/planning/index.html"), ("North Lincs", "Idox", ""), ("Town", "", "")]
    got = values(spark, rows, "a string, s string, l string", text.adapter("a", "s", F.lit("unknown"), "l"))
    assert [r[0] for r in got] == ["wiltshire", "authority:forms", "idox", "tascomi", "northlincs", "generic"]


def test_label_query_reads_whole_texts(spark, tmp_path):
    from registrum.plans.registry import QUERIES

    texts = ["Site & Address " + "word " * 30 + "End!", "Site & Address " + "word " * 30 + "Other"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = dict(tuple(r) for r in QUERIES["label_project"](spark, str(tmp_path)).collect())
    assert out == {i: hashlib.sha256(("site_and_address_" + "word_" * 30 + end).encode()).hexdigest() for i, end in enumerate(["end", "other"])}

"""Listing, document and catalogue operators over values written here."""

import json

from pyspark.sql import functions as F

from registrum.functions import urls
from registrum.operators import documents
from registrum.plans import catalogue
from registrum.sources import html, listings, payloads


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_free_text(spark):
    t = "x P/AB/2026/01 Location: 1 Road AB1 2CD Proposal: Gates Decision: None Decision Date: View this application P/AB/2026/01 Location: again Proposal: z Decision: d Decision Date: e"
    p = spark.createDataFrame([(1, t)], "page_id int, t string")
    assert rows(listings.free_text_records(p, "t", "cced"), "reference", "address", "description", "postcode") == [("P/AB/2026/01", "1 Road AB1 2CD", "Gates", "AB1 2CD")]
    p = spark.createDataFrame([(1, "26/00001/FUL Address: A Description: B 26/00002/FUL Location: C Proposal: D")], "page_id int, t string")
    assert rows(listings.free_text_records(p, "t", "astun"), "reference", "address", "description") == [("26/00001/FUL", "A", "B"), ("26/00002/FUL", "C", "D")]


def test_labelled_text_and_cells(spark):
    d = spark.createDataFrame([("App. No. 12/3 Site Address: Here Description: Gates Received Date: 1 June", ["Plan A", "05/06/2026", "12 KB", "Drawing", "note"])], "t string, c array<string>")
    r = d.select(listings.labelled_text("t").alias("l"), listings.document_cells(F.col("c"), F.lit(""), F.lit("Plan A")).alias("m")).first()
    assert r["l"]["app_no"] == "12/3" and r["l"]["site_address"] == "Here" and r["l"]["description"] == "Gates"
    assert tuple(r["m"]) == ("05/06/2026", "12 KB", "Drawing", "note")


def test_cards_and_quality(spark):
    h = "<a href='/OnlinePlanningOverview?applicationNumber=26%2F1'>1 Road AB1 2CD</a><a href='/OnlinePlanningOverview?applicationNumber=26%2F1'>26/1 | Registered: 05/06/2026</a><a href='/OnlinePlanningOverview?applicationNumber=26%2F1'>Gates</a>"
    busy = "<p>The website is busy</p><table><tr><th>Application Number</th></tr></table>"
    n = html.nodes(spark.createDataFrame([(1, h), (2, busy), (3, "<p>No records found</p>"), (4, "<p>ok</p>")], "page_id int, html string"))
    assert rows(listings.cards(n, F.lit("https://h/x")), "reference", "address", "description", "date_received", "url") == [("26/1", "1 Road AB1 2CD", "Gates", "2026-06-05", "https://h/OnlinePlanningOverview?applicationNumber=26%2F1")]
    assert rows(listings.page_quality(n), "page_id", "quality") == [(1, None), (2, "busy_empty"), (3, "explicit_empty"), (4, None)]


def test_small_rules(spark):
    d = spark.createDataFrame([(["txtDecisionDateFrom", "txtDateReceivedFrom", "txtDateReceivedTo", "name"], ["Date decided", "Date valid"])], "n array<string>, l array<string>")
    r = d.select(listings.date_fields(F.col("n")).alias("f"), listings.preferred_criterion(F.col("l")).alias("c")).first()
    assert tuple(r["f"]) == ("txtDateReceivedFrom", "txtDateReceivedTo") and r["c"] == "Date valid"
    a = spark.createDataFrame([(None, None), ("", "2026-06-01"), ("2026-06-02", None)], "date_received string, date_validated string")
    assert rows(listings.infer_dates(a, F.lit("2026-05-01")), "date_received", "date_inferred") == [("", False), ("2026-05-01", True), ("2026-06-02", False)]
    t = spark.createDataFrame([("a", 1, "boom", 0), ("a", 2, None, 3), ("b", 1, None, 1)], "authority string, attempt int, error string, n int")
    assert rows(listings.final_attempts(t), "authority", "error", "n", "retried") == [("a", None, 3, True), ("b", None, 1, False)]
    log = spark.createDataFrame([("x", 0), ("x", 130), ("y", 0), ("y", 100)], "attempt string, at int")
    assert rows(listings.slow_attempts(log, 120, 1200), "attempt", "reason") == [("x", "inactive")]
    p = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2")], "k string, body string")
    assert rows(listings.repeated_pages(p, "k", "body"), "k", "n") == [("a", 2)]


def test_document_candidates_and_sources(spark):
    d = spark.createDataFrame([("https://h/a/documentviewer.do?keyVal=1",), ("https://h/a/ViewDocument?id=7",), ("https://h/x.pdf",)], "u string")
    got = [r[0] for r in d.coalesce(1).select(urls.document_candidates("u")).collect()]
    assert got[0][1] == "https://h/a/documentdownload.do?keyVal=1" and "https://h/a/documentdownload.do?module=planning&keyVal=1" in got[0]
    assert got[1][-1] == "https://h/DownloadDocument?id=7" and got[2] == ["https://h/x.pdf"]
    s = spark.createDataFrame([("https://h/applicationDetails.do?keyVal=K&activeTab=summary", "https://h/search/advanced", None)], "url string, source string, none string")
    one = s.select(documents.document_sources(F.col("none"), F.col("none"), F.col("url"), F.col("source"), F.col("source")).alias("d")).first()["d"]
    assert one == ["https://h/applicationDetails.do?keyVal=K&activeTab=documents", "https://h/applicationDetails.do?keyVal=K&activeTab=summary"]


def test_document_dialects(spark):
    page = F.lit("https://h/pr/s/detail/1")
    script = 'x var model = {"Rows":[{"Guid":"g 1","Doc_Ref2":"Plan"},{"Guid":""}]};'
    rows_ = json.dumps([["Plan", "05/06/2026", "Site plan", "01/01/2020", "/getfile?id=1"], ["short"]])
    versions = json.dumps([{"Id": "v1", "FileExtension": "PDF", "Title": "Plan"}, {"Title": "none"}])
    p = spark.createDataFrame([(1, script, rows_, versions, "<table><tr data-module='p' data-recordnumber='1/2' data-planid='3.0' data-imageid='x' data-filename='a\\b.pdf'></tr></table>")], "page_id int, s string, r string, v string, html string")
    m = documents.model_rows(p, "s", F.lit("https://h/a/b/c"))
    assert rows(m, "title", "url") == [("Plan", "https://h/a/Document/ViewDocument?id=g+1")]
    r = documents.publisher_rows(p, "r", page, F.lit("/ctx"))
    assert rows(r, "title", "url", "document_type", "date_published") == [("Site plan", "https://h/ctx/getfile?id=1", "Plan", "05/06/2026")]
    v = documents.content_versions(p, "v", page)
    assert rows(v, "title", "url") == [("Plan.pdf", "https://h/pr/sfc/servlet.shepherd/version/download/v1")]
    a = documents.attribute_rows(html.nodes(p), page)
    assert rows(a, "title", "url") == [("b.pdf", "https://h/Document/GetFileBinary?module=p&recordNumber=1%2F2&planID=3&imageID=0&isPlan=false")]
    assert documents.all_documents([m, r, v, a, r]).count() == 4
    f = spark.createDataFrame([(None, "Plan", "https://h/x", ".pdf"), ("a/b.PDF", "t", "u", ".bin")], "h string, t string, u string, e string")
    assert rows(f, documents.file_name(F.col("h"), F.col("t"), F.col("u"), F.lit("doc"), F.col("e"))) == [("Plan.pdf",), ("b.PDF",)]


def test_catalogue_build(spark):
    schema = "ordinal int, area_id string, area_name string, long_name string, area_type string, gss_code string, scraper_type string, planning_url string, borders string"
    a = spark.createDataFrame([
        (0, "1", "Fife", "Fife Council", "Council", "x", "Idox", "https://f.example/online-applications/search.do", "{}"), (1, "1", "Fife", "twice", "Council", "x", "", "", "{}"),
        (2, "2", "Carlisle", None, "Council", "E1", None, "https://c.example/p/Search/Advanced", "{}"), (3, "3", "N", None, "Council", "N09", None, None, "{}"), (4, "4", "J", None, "Crown Dependency", "J1", None, None, "{}"),
    ], schema)
    one = "area_name string, ok boolean, status int, final_url string, tls_verified boolean, tested_at string"
    tests = catalogue.link_tests(spark.createDataFrame([("Fife", True, 200, "u", True, "b")], one), spark.createDataFrame([("Fife", False, 500, "v", False, "a")], one))
    got = rows(catalogue.features(a, tests), "authority", "council_name", "gss_code", "covered_councils", "portal_family", "base_url", "link_test_ok")
    assert got == [("Carlisle", "Carlisle", "E1", ["Cumberland"], "atrium", "https://c.example/p", False), ("Fife", "Fife Council", "S12000047", None, "idox", "https://f.example", True)]


def test_more_families(spark):
    body = json.dumps({"Records": [{"Id": "u1", "Attributes": [{"Name": "new_name", "DisplayValue": "R/1"}, {"Name": "new_registration_date", "FormattedValue": "05/06/2026"}]}, {"Attributes": []}]})
    p = spark.createDataFrame([(body,)], "body string")
    assert rows(payloads.grid_applications(p), "uid", "reference", "date_received", "complete") == [("u1", "R/1", "2026-06-05", True), (None, None, None, False)]
    w = json.dumps({"returnValue": json.dumps({"records": [{"Id": "i", "arcusbuiltenv__Valid_Date__c": "2026-06-05"}]})})
    assert rows(payloads.applications(spark.createDataFrame([(w,)], "body string"), "wiltshire", inner="$.returnValue"), "uid", "reference", "date_validated") == [("i", "i", "2026-06-05")]

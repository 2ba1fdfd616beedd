"""The whole lead search over small tables, and its plan."""

import json

import pytest
from pyspark.sql import functions as F

from registrum.functions import geometry
from registrum.plans import leads, search
from registrum.plans import search_queries as Q
from registrum.sources.scratch import clear, kept, scratch_path

APP = "authority string, ordinal long, uid string, reference string, url string, source_url string, address string, description string, status string, decision string, date_received string, date_validated string, postcode string, raw string"


def app(authority, ordinal, reference, description="New gates", day="2026-06-05", address="1 Main Street", at=None, uid=None, **raw):
    if at:
        raw["location"] = {"type": "Point", "coordinates": at}
    return (authority, ordinal, uid or f"{authority}{ordinal}", reference, "https://u", "https://s", address, description, None, None, day, None, None, json.dumps(raw))


def boxes(spark, rows, schema):
    d = spark.createDataFrame(rows, f"{schema}, x double, y double, w double")
    return leads.boxed(d, geometry.box_ring(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w"))).drop("x", "y", "w")


@pytest.fixture(scope="module")
def found(spark):
    names = ["Aville", "Btown", "Cford", "Dham", "Surrey", "Wycombe", "Elsewhere", "Ftown", "Gton"]
    catalogue = boxes(spark, [(k, n, "idox" if n == "Aville" else None, f"https://{n}.example/online-applications/search.do?action=weekly", 90.0 if n == "Elsewhere" else 2.0 * k, 0.0, 1.5) for k, n in enumerate(names)], "ordinal int, authority string, portal_family string, planning_url string")
    areas = leads.boxed(spark.createDataFrame([(0.5, 0.5, 20.0)], "x double, y double, w double"), geometry.box_ring(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w"))).select("geometry", "box")
    apps = [
        app("Aville", 1, "R1"), app("Aville", 2, "R1", "Second gates"), app("Aville", 3, "R2", "A shed"), app("Aville", 4, "R3", day="2026-08-01"), app("Aville", 5, " ", uid="only-uid"), app("Aville", 6, "R6", at=[0.1, 0.1]), app("Aville", 7, "R7", at=[1.0, 1.0]),
        app("Aville", 8, "R8", day=""), app("Aville", 9, "Old/9"), app("Aville", 10, "R10", "Discharge of condition for gates"),
        app("Btown", 1, "R1", "Gates of another council"), app("Btown", 2, "B2", "gates", address=""), app("Btown", 3, "B3", detail_fetch_error="timed out"),
        app("Cford", 1, "C1"), app("Dham", 1, "D1"), app("Surrey", 1, "S1"), app("Wycombe", 1, "W1"), app("Elsewhere", 1, "E1"), app("Gton", 1, "G1", day="2026-01-01"),
    ]
    feed = [
        app("Btown", 1, "B2", "gates", address="from the feed"), app("Btown", 2, "B9", "Feed gates"), app("Cford", 1, "C2", "Feed gates"), app("Surrey", 1, "S2", "Feed gates"), app("Surrey", 2, "S3", "Feed gates", day="2026-01-01"),
        app("Buckinghamshire", 1, "W2", "Feed gates"), app("Wycombe", 1, "W3", "Feed gates"), app("Aville", 1, "A9", "Feed gates"), app("Gton", 1, "G2", "Feed gates"),
    ]
    attempts = [("Aville", 1, "HTTP 429", 0), ("Aville", 2, None, 7), ("Cford", 1, "HTTP 503", 0), ("Dham", 1, "HTTP 503 connection refused", 0), ("Ftown", 1, "HTTP 403", 0), ("Wycombe", 1, None, 1)]
    path = scratch_path(spark, "applications")
    search.store(spark.createDataFrame(apps, APP), path)
    s = search.search(catalogue, search.stored(spark, path), spark.createDataFrame(feed, APP), spark.createDataFrame(attempts, "authority string, attempt int, error string, n int"), areas, "2026-06-01", "2026-06-30", ["GATES"])
    yield s
    clear(spark)


def test_where_councils_have_their_applications_from(found):
    got = {r["authority"]: (r["source"], r["total"], r["relevant"]) for r in found.councils.collect()}
    assert got == {
        "Aville": ("portal", 8, 3),  # an undated row stays but is no lead, one out of the window and a second row of R1 go; references, proposals and places that don't count are no leads
        "Btown": ("merged", 4, 3),  # a detail page failed: the feed fills rows and adds one; R1 went to the council before
        "Cford": ("feed", 1, 1), "Dham": ("failed", 0, 0), "Surrey": ("feed", 1, 1), "Wycombe": ("feed", 1, 1), "Ftown": ("failed", 0, 0),
        "Gton": ("merged", 1, 1),  # nothing in the window
    }


def test_leads_are_one_a_reference(found):
    got = {r["Reference"]: (r["council"], r["address"], r["proposal"], r["date received"]) for r in found.leads.collect()}
    day = "2026-06-05"
    assert got == {
        "R1": ("Aville", "1 Main Street", "New gates", day), "only-uid": ("Aville", "1 Main Street", "New gates", day), "R7": ("Aville", "1 Main Street", "New gates", day), "B2": ("Btown", "from the feed", "gates", day),
        "B3": ("Btown", "1 Main Street", "New gates", day), "B9": ("Btown", "1 Main Street", "Feed gates", day), "C2": ("Cford", "1 Main Street", "Feed gates", day), "S2": ("Surrey", "1 Main Street", "Feed gates", day),
        "W2": ("Wycombe", "1 Main Street", "Feed gates", day), "G2": ("Gton", "1 Main Street", "Feed gates", day),
    }


def test_failures_and_history(found):
    got = {r["council"]: (r["reason"], r["fatal"], r["listing_url"]) for r in found.failures.collect()}
    listing = "https://{}.example/online-applications/search.do?action=weekly".format
    assert got == {"Dham": ("HTTP 503 connection refused", True, listing("Dham")), "Ftown": ("Responsive portal search issue after final retry: HTTP 403", False, listing("Ftown"))}
    (h,) = search.history(found, ["GATES"], "2026-06-30", "10:00:00").collect()
    assert (h["List of failed councils"], h["List of councils with no applications"], h["Completion"]) == ("Dham", "", "Failed")
    assert int(h["Total Applications"]) == found.applications.count()


def test_stored_applications_are_pruned_at_run_time(spark):
    s = search.search(**Q.inputs(spark, "/root/testdata/sf0.001"), start=Q.START, end=Q.END, keywords=Q.KEYWORDS)
    s.leads.collect()
    plan = s.leads._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.split("PartitionFilters", 1)[1]
    clear(spark)


def test_kept_tables_are_deleted(spark):
    t = kept(spark.range(3), "three")
    assert t.count() == 3
    clear(spark)
    with pytest.raises(Exception, match="(?i)not_exist|not exist|PATH"):
        t.count()

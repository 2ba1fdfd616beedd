"""Building the authority catalogue from area records and link tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.functions.text import blank_to_null, first_marker, portal_family
from registrum.functions.urls import base_url
from registrum.operators.relations import first_wins, union_distinct

# --- fixed values: excluded area types, current codes, authorities that share a register, family names ----------------
EXCLUDED_TYPES = ["Crown Dependency", "Northern Ireland District", "Other Planning Entity"]
CURRENT_CODES = {"Fife": "S12000047", "Gateshead": "E08000037", "Glasgow": "S12000049", "North Lanarkshire": "S12000050", "Perth": "S12000048"}
COVERAGE = {
    "Adur and Worthing": [("Adur", "E07000223"), ("Worthing", "E07000229")],
    "Babergh Mid Suffolk": [("Babergh", "E07000200"), ("Mid Suffolk", "E07000203")],
    "Bromsgrove Redditch": [("Bromsgrove", "E07000234"), ("Redditch", "E07000236")],
    "Mid Kent": [("Maidstone", "E07000110"), ("Swale", "E07000113")],
    "South Norfolk Broadland": [("Broadland", "E07000144"), ("South Norfolk", "E07000149")],
    "South West Devon": [("South Hams", "E07000044"), ("West Devon", "E07000047")],
    "Allerdale": [("Cumberland", "E06000063")],
    "Carlisle": [("Cumberland", "E06000063")],
    "Copeland": [("Cumberland", "E06000063")],
}
FAMILY_NAMES = [
    ("idox", ["idox"]), ("arcus", ["arcus"]), ("ocella", ["ocella"]), ("agile", ["agile"]), ("achieveforms", ["achieveforms"]), ("atrium", ["atrium"]), ("tascomi", ["tascomi"]),
    ("appsearchserv", ["appsearchserv"]), ("northgate", ["planningexplorer", "northgate"]), ("civica", ["civica"]),
]


def included(area_type: Column, gss_code: Column) -> Column:
    return ~F.coalesce(area_type.isin(*EXCLUDED_TYPES), F.lit(False)) & ~F.coalesce(F.startswith(gss_code, F.lit("N")), F.lit(False))


def derive_base_url(url: Column, family: Column) -> Column:
    low, cut = F.lower(url), F.length(url) - F.length(F.regexp_extract(F.lower(url), "^.*(/search.*)$", 1))
    other = F.when(F.contains(low, F.lit("/search")), F.substring(url, F.lit(1), cut)).otherwise(F.regexp_replace(url, "[^/]*$", ""))
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(family == "idox", F.coalesce(F.nullif(base_url(url), F.lit("")), url)).otherwise(other)


def link_tests(cache: DataFrame, previous: DataFrame) -> DataFrame:
    """Link tests by area_name: the cache's, then those a previous catalogue recorded."""
    return union_distinct([cache, previous], ["area_name"], ["tested_at"])


def features(areas: DataFrame, tests: DataFrame) -> DataFrame:
    """Catalogue rows of area records: ordinal, area_id, area_name, long_name, area_type, gss_code, scraper_type, planning_url, borders."""
    a = first_wins(areas, ["area_id", "area_name", "gss_code"], ["ordinal"]).filter(included(F.col("area_type"), F.col("gss_code")))
    code = F.coalesce(*[F.when(F.col("area_name") == n, F.lit(c)) for n, c in CURRENT_CODES.items()], F.col("gss_code"))
    cover = lambda k: F.coalesce(*[F.when(F.col("area_name") == n, F.array(*[F.lit(x[k]) for x in v])) for n, v in COVERAGE.items()])
    family = F.coalesce(first_marker(F.lower(F.trim(F.coalesce("scraper_type", F.lit("")))), FAMILY_NAMES), portal_family(F.lit(""), "planning_url"), F.lit("unknown"))
    a = a.select(
        "ordinal", F.col("area_name").alias("authority"), F.coalesce(blank_to_null("long_name"), F.col("area_name")).alias("council_name"), "area_id", "area_type", code.alias("gss_code"),
        cover(0).alias("covered_councils"), cover(1).alias("covered_gss_codes"), family.alias("portal_family"), "scraper_type", F.coalesce("planning_url", F.lit("")).alias("listing_url"), "borders",
    )
    a = a.withColumn("base_url", derive_base_url(F.col("listing_url"), F.col("portal_family")))
    t = tests.select(F.col("area_name").alias("authority"), "ok", "status", "final_url", "tls_verified")
    false = F.lit(False)
    return a.join(t, "authority", "left").select(*a.columns, F.coalesce("ok", false).alias("link_test_ok"), F.col("status").alias("link_test_status"), F.col("final_url").alias("link_test_final_url"), F.coalesce("tls_verified", false).alias("link_test_tls_verified"))

"""The lead search as one plan: targets, applications, exclusions, keywords, area, distinct, funnel, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.functions import dates, fixed, geometry
from registrum.functions.text import blank_to_null, contains_any, first_value, keyword_set_name, platform, proposal_excluded, reference_excluded, resolved_adapter
from registrum.functions.urls import application_root, base_url
from registrum.operators.relations import FALLBACK_COLUMNS, first_wins, merge_fallback, points_in_areas, spatial_semi_join

CELL = 0.5


def targets(catalogue: DataFrame, areas: DataFrame, cell: float = CELL) -> DataFrame:
    """Authorities whose geometry meets the areas. Both have geometry and box."""
    return spatial_semi_join(catalogue, areas, cell)


def haystack(*cols: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def matches(start: str, end: str, keywords: list[str], text: list[str], reference: str = "reference", description: str = "description", received: str = "date_received", validated: str = "date_validated") -> Column:
    """The lead predicate: a date in the window, no excluded reference or proposal, and any keyword. Cheap terms first."""
    day = dates.iso_date(dates.effective_date(received, validated))
    return dates.in_window(day, start, end) & ~reference_excluded(reference) & ~proposal_excluded(description) & contains_any(haystack(*text), [k.lower() for k in keywords])


def effective_target(target: DataFrame) -> DataFrame:
    """Adds adapter, platform: the resolution rules over target columns."""
    return target.withColumns({"adapter": resolved_adapter("authority", "scraper_type", "portal_family", "listing_url"), "platform": platform("authority", "scraper_type", "portal_family")})


def target_rows(catalogue: DataFrame, *keep: Column) -> DataFrame:
    """Targets of catalogue rows with their defaults: authority, portal_family, scraper_type, base_url, listing_url, and the columns keep."""
    text = lambda *c: first_value(*[F.col(x) if x in catalogue.columns else F.lit(None).cast("string") for x in c])
    listing = text("listing_url", "planning_url")
    base = F.coalesce(F.regexp_replace(text("base_url"), "/+$", ""), blank_to_null(base_url(listing)))
    return catalogue.select(text("authority", "council_name").alias("authority"), F.coalesce(text("portal_family"), F.lit("unknown")).alias("portal_family"), F.coalesce(text("scraper_type", "portal_family"), F.lit("unknown")).alias("scraper_type"), base.alias("base_url"), listing.alias("listing_url"), application_root(listing).alias("application_root"), *keep)


def application_point() -> tuple[Column, Column]:
    """x and y of an application: a GeoJSON location in raw, else longitude and latitude keys; not numeric: null."""
    at = lambda p: F.get_json_object("raw", p).try_cast("double")
    return F.coalesce(at("$.location.coordinates[0]"), at("$.longitude"), at("$.location_x")), F.coalesce(at("$.location.coordinates[1]"), at("$.latitude"), at("$.location_y"))


def link() -> Column:
    raw = lambda k: blank_to_null(F.get_json_object("raw", f"$.{k}"))
    return F.coalesce(raw("portal_url"), raw("docs_url"), raw("source_url"), blank_to_null("url"), blank_to_null("source_url"), F.lit(""))


def reconciled(main: DataFrame, fallback: DataFrame, status: DataFrame) -> DataFrame:
    """Main rows filled from the feed and feed-only rows, for authorities whose main source failed, was empty or is feed-first; else main rows."""
    n = main.groupBy("authority").agg(F.count("*").alias("_n"))
    use = status.join(n, "authority", "left").filter(F.col("failed") | F.col("feed_first") | F.col("_n").isNull()).select("authority")
    also = ["uid"] if "uid" in main.columns and "uid" in fallback.columns else []
    return merge_fallback(main, fallback.join(use, "authority", "left_semi"), "reference", [c for c in FALLBACK_COLUMNS if c in main.columns], ["authority"], also)


def leads(applications: DataFrame, areas: DataFrame | None, start: str, end: str, keywords: list[str] | None = None, per_authority: bool = False) -> DataFrame:
    """The published columns of matching applications, first by (catalogue ordinal, listing ordinal) for each reference.

    Only the six published columns leave; names of people and officers stay in the application table.
    """
    a = applications.filter(matches(start, end, keywords or fixed.STANDARD_KEYWORDS, ["reference", "address", "description", "raw"]))
    if areas is not None:
        x, y = application_point()
        a = points_in_areas(a.withColumns({"_x": x, "_y": y}), areas, "_x", "_y").drop("_x", "_y")
    a = a.withColumn("_key", first_value("reference", "uid"))
    a = first_wins(a, (["authority"] if per_authority else []) + ["_key"], ["target_ordinal", "ordinal"])
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = [first_value("reference", "uid"), text("address"), link(), text("description"), F.coalesce(dates.effective_date("date_received", "date_validated"), F.lit("")), F.col("authority")]
    return a.select(*[c.alias(n) for c, n in zip(out, fixed.APPLICATION_COLUMNS)])


def funnel(rows: DataFrame, key: str, matched: str) -> DataFrame:
    """total, relevant and ratio for each key; a ratio of nothing is 0."""
    n = F.sum(F.col(matched).cast("long"))
    return rows.groupBy(key).agg(F.count("*").alias("total"), n.alias("relevant"), F.when(F.count("*") == 0, F.lit(0.0)).otherwise(n / F.count("*")).alias("ratio"))


def run_summary(attempts: DataFrame, leads_: DataFrame, keywords: list[str], date: str, time: str, cancelled: bool = False) -> DataFrame:
    """One history row. attempts: authority, ordinal, attempt, failed, n; the last attempt of an authority counts."""
    last = attempts.groupBy("authority").agg(F.max_by("failed", "attempt").alias("failed"), F.max_by("n", "attempt").alias("n"), F.min("ordinal").alias("ordinal"))
    names = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ordinal", "authority")))), lambda x: x["authority"]), "; ")
    s = last.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), names(F.col("failed")).alias("failed"), names(~F.col("failed") & (F.col("n") == 0)).alias("empty"), F.coalesce(F.max("failed"), F.lit(False)).alias("any"))
    documents = F.count_distinct(F.when(F.col("n_documents") > 0, F.col("Reference"))) if "n_documents" in leads_.columns else F.lit(0).cast("long")
    m = leads_.agg(F.count("*").alias("relevant"), documents.alias("documents"))
    ratio = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(100 * F.col("relevant") / F.col("total"))
    done = F.when(F.lit(cancelled), "Cancelled").when(F.col("any"), "Failed").otherwise("Completed")
    kind = keyword_set_name(F.array(*map(F.lit, keywords)))
    both = s.withColumn("_one", F.lit(1)).join(m.withColumn("_one", F.lit(1)), "_one")  # one row each
    out = [F.lit(date), F.lit(time), kind, F.col("total"), F.col("relevant"), F.format_string("%.2f%%", ratio), F.col("failed"), F.col("empty"), done, F.col("documents")]
    return both.select(*[c.alias(n) for c, n in zip(out, fixed.HISTORY_COLUMNS)])


def boxed(df: DataFrame, ring: Column) -> DataFrame:
    """Adds geometry (one polygon of one ring) and box."""
    d = df.withColumn("geometry", F.array(F.array(ring)))
    return d.withColumn("box", geometry.bbox(F.col("geometry")))

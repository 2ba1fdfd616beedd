"""The lead search as one plan: from a catalogue, areas and stored applications to leads, failures, funnel and history.

Applications are stored a folder an authority. The authorities that meet the areas are few and are broadcast, so the scan of the
stored applications opens only their folders, which the plan decides at run time. Selected authorities, and what the sources gave for
each, are written once, a row an authority; everything else is one plan over the stored rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.functions import dates, fixed
from registrum.functions.text import failure_degraded, first_value
from registrum.operators.relations import FALLBACK_COLUMNS, first_alias, first_wins, merge_fallback
from registrum.plans import leads as L
from registrum.sources.listings import final_attempts
from registrum.sources.scratch import kept

#: Catalogues up to this many authorities, which is counted first, are broadcast.
FEW = 4096
#: Listing ordinals of feed rows come after all of a portal's.
AFTER = 1 << 48


class Search(NamedTuple):
    #: authority, target_ordinal, platform, adapter, source (portal, feed, merged or failed), error, total, relevant, ratio: one row a selected authority.
    councils: DataFrame
    #: Every application of the search, before the lead predicate.
    applications: DataFrame
    #: The six published columns, one row a reference.
    leads: DataFrame
    #: council, portal_family, scraper_type, listing_url, reason, fatal.
    failures: DataFrame


def store(applications: DataFrame, path: str, mode: str = "append") -> None:
    """Writes applications a folder an authority; a large authority's rows are split over several tasks and files."""
    applications.hint("rebalance", "authority").write.mode(mode).partitionBy("authority").parquet(path)


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).parquet(path)


def targets(catalogue: DataFrame, areas: DataFrame) -> DataFrame:
    """Selected authorities with their defaults, adapter and platform; of rows with one name the first by ordinal. catalogue: ordinal, geometry, box and a feature's text columns."""
    met = L.target_rows(L.targets(catalogue, areas), F.col("ordinal").alias("target_ordinal")).filter("authority > ''")
    return L.effective_target(first_wins(met, ["authority"], ["target_ordinal"]))


def _feed_names(t: DataFrame) -> DataFrame:
    """authority, ordinal and name: under which names a feed may know an authority, in the order of trial."""
    alias = F.create_map(*[x for k, v in fixed.AGGREGATOR_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    names = F.concat(F.coalesce(F.try_element_at(alias, F.col("authority")), F.array().cast("array<string>")), F.array("authority"))
    return t.select("authority", F.posexplode(names).alias("ordinal", "name"))


def _count(rows: DataFrame, name: str, *more: Column) -> DataFrame:
    return rows.groupBy("authority").agg(F.count("*").alias(name), *more)


def search(catalogue: DataFrame, applications: DataFrame, feed: DataFrame, attempts: DataFrame, areas: DataFrame, start: str, end: str, keywords: list[str] | None = None) -> Search:
    """The search from start to end, both included.

    applications and feed: authority, ordinal, uid, reference, url, source_url, address, description, status, decision,
    date_received, date_validated, postcode, raw (JSON). attempts: authority, attempt, error, n; without a row an authority's
    only attempt went well. A portal's rows are one a reference (or uid, or url), the first listed, and in the window or
    undated. The feed stands in for a portal that failed and comes before one that the feed knows better; it completes a portal's
    rows where there are none or a detail page failed (raw has detail_fetch_error). A failed portal without feed rows is a failure, fatal
    unless its service answered.
    """
    t = kept(targets(catalogue, areas), "search-targets").filter("authority > ''")
    few = F.broadcast if len(t.select(F.lit(1)).limit(FEW + 1).take(FEW + 1)) <= FEW else lambda x: x
    t = few(t)
    last = final_attempts(attempts).select("authority", "error")
    state = t.join(last, "authority", "left").withColumn("first", F.col("authority").isin(*fixed.AGGREGATOR_ALIASES, *fixed.AGGREGATOR_FIRST))
    when = dates.iso_date(dates.effective_date("date_received", "date_validated"))
    inside = dates.in_window_or_unknown(when, start, end)

    listed = applications.join(t.select("authority", "target_ordinal"), "authority").withColumn("_key", first_value("reference", "uid", "url"))
    flawed = F.get_json_object("raw", "$.detail_fetch_error").isNotNull()
    once = first_wins(listed.withColumn("_flawed", flawed), ["authority", "_key"], ["ordinal"])
    held = once.groupBy("authority").agg(F.count_if(inside).alias("main_n"), F.max("_flawed").alias("flawed"))
    known = first_alias(feed.withColumnRenamed("authority", "name").filter(inside), _feed_names(t), "name").drop("alias")
    known = known.join(t.select("authority", "target_ordinal"), "authority").withColumn("ordinal", F.col("ordinal") + AFTER)

    state = state.join(held, "authority", "left").join(_count(known, "feed_n"), "authority", "left")
    failed, fed = F.col("error").isNotNull(), F.coalesce(F.col("feed_n") > 0, F.lit(False))
    empty = F.coalesce(F.col("main_n") == 0, F.lit(True)) | F.coalesce("flawed", F.lit(False))
    source = F.when(fed & (F.col("first") | failed), "feed").when(failed, "failed").when(fed & empty, "merged").otherwise("portal")
    state = kept(state.withColumn("source", source).drop("first", "main_n", "flawed", "feed_n"), "search-sources")

    use = few(state.select("authority", "source"))
    main = once.filter(inside).drop("_key", "_flawed").join(use.filter("source in ('portal', 'merged')"), "authority")
    other = known.join(use.filter("source in ('feed', 'merged')"), "authority")
    merged = merge_fallback(main.filter("source = 'merged'"), other.filter("source = 'merged'"), "reference", FALLBACK_COLUMNS, ["authority"], ["uid"], ["ordinal"])
    rows = main.filter("source = 'portal'").unionByName(other.filter("source = 'feed'"), allowMissingColumns=True).unionByName(merged, allowMissingColumns=True)
    rows = rows.withColumns({"from_main": F.coalesce("from_main", F.col("source") == "portal"), "supplemented": F.coalesce("supplemented", F.lit(False))}).drop("source")

    found = L.leads(rows, areas, start, end, keywords)
    n = found.groupBy(F.col("council").alias("authority")).agg(F.count("*").alias("relevant"))
    councils = state.join(_count(rows, "total"), "authority", "left").join(n, "authority", "left").fillna(0, ["total", "relevant"])
    councils = councils.withColumn("ratio", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("relevant") / F.col("total")))
    degraded = failure_degraded("error")
    reason = F.concat(F.when(degraded, "Responsive portal search issue after final retry: ").otherwise(""), "error")
    failures = state.filter("source = 'failed'").select(F.col("authority").alias("council"), "portal_family", "scraper_type", first_value("listing_url", "base_url").alias("listing_url"), reason.alias("reason"), (~degraded).alias("fatal"))
    return Search(councils, rows, found, failures)


def history(found: Search, keywords: list[str], date: str, time: str) -> DataFrame:
    """The run's history row: a fatal failure fails it; an authority that answered without an application is listed as empty."""
    c = found.councils.join(found.failures.select(F.col("council").alias("authority"), "fatal"), "authority", "left")
    n = F.when(F.col("fatal").isNull() | (F.col("total") > 0), F.col("total"))
    attempts = c.select("authority", F.col("target_ordinal").alias("ordinal"), F.lit(1).alias("attempt"), F.coalesce("fatal", F.lit(False)).alias("failed"), n.alias("n"))
    return L.run_summary(attempts, found.leads, keywords, date, time)

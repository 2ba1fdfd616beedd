"""Listing operators over text and node tables: free-text records, cards, labelled text, document cells, page quality, inferred dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registrum.functions.dates import iso_date, parse_council_date
from registrum.functions.text import blank_to_null, clean_text, col, contains_any, extract_postcode, let, normalize_label, reference
from registrum.functions.urls import join_root, query_param, uid_from_url
from registrum.sources.html import anchors

# --- fixed values: record patterns of listings, labels of detail texts, page texts -------------------------------------
FREE_TEXT = {
    "cced": r"(?i)(P/[A-Z]+/\d{4}/\d+)\s+Location:\s*(.*?)\s+Proposal:\s*(.*?)\s+Decision:\s*(.*?)\s+Decision Date:\s*(.*?)(?:View this application|$)",
    "astun": r"(?i)(\d{2}/\d{5}/[A-Z]+|[A-Z]+/\d{2}/\d{4,5})\s+(?:Location|Address):\s*(.*?)\s+(?:Proposal|Description):\s*(.*?)(?=\s+\d{2}/\d{5}/[A-Z]+|\s+[A-Z]+/\d{2}/\d{4,5}|$)",
}
FREE_TEXT_COLUMNS = {"cced": ["reference", "address", "description", "decision", "decision_date"], "astun": ["reference", "address", "description"]}
DETAIL_LABELS = ["App. No.", "Site Address:", "Description:", "Received Date:", "Decision Sent Date:", "Decision Date:"]
CELL_TYPES = ["drawing", "plan", "decision_notice", "application_form", "supporting_document"]
NO_RESULTS = ["no matching applications", "no applications found", "no records found", "your search returned no results"]
BUSY = "website is busy"
DATE_PRIORITY = [(0, ["regdate", "received", "registered", "valid"]), (20, ["decision", "appeal", "committee", "comm"])]
DATE_SIDES = {"from": ["from", "start", "min", "regdate1", "date1"], "to": ["to", "end", "max", "regdate2", "date2"]}
CRITERIA = ["received", "valid", "validated", "submitted", "application"]


def free_text_records(pages: DataFrame, text: str, dialect: str) -> DataFrame:
    """Page columns, ordinal and the record columns of a dialect; the first of a reference wins."""
    t = clean_text(text)
    groups = [F.regexp_extract_all(t, F.lit(FREE_TEXT[dialect]), F.lit(i + 1)).alias(c) for i, c in enumerate(FREE_TEXT_COLUMNS[dialect])]
    keep = [c for c in pages.columns if c != text]
    r = pages.select(*keep, F.posexplode(F.arrays_zip(*groups)).alias("ordinal", "r")).select(*keep, "ordinal", *[clean_text(f"r.{c}").alias(c) for c in FREE_TEXT_COLUMNS[dialect]])
    w = Window.partitionBy(*keep, "reference").orderBy("ordinal")
    return r.withColumn("_n", F.row_number().over(w)).filter("_n = 1 and reference is not null").drop("_n").withColumn("postcode", extract_postcode("address"))


def labelled_text(text: Column | str) -> Column:
    """A struct of the six labels' values: each runs to the next later label or the end."""
    plain = lambda s: "\\Q" + s + "\\E"
    def one(i: int) -> Column:
        later = "|".join(plain(x) for x in DETAIL_LABELS[i + 1 :])
        end = f"(?={later}|$)" if later else "$"
        return clean_text(F.regexp_extract(col(text), rf"(?is){plain(DETAIL_LABELS[i])}\s*:?\s*(.*?){end}", 1)).alias(normalize_name(DETAIL_LABELS[i]))

    return F.struct(*[one(i) for i in range(len(DETAIL_LABELS))])


def normalize_name(label: str) -> str:
    return "_".join("".join(c if c.isalnum() else " " for c in label.lower()).split())


def cards(nodes: DataFrame, base: Column, marker: str = "OnlinePlanningOverview", key: str = "page_id") -> DataFrame:
    """Cards of a listing: links to one address hold, in order, the site, the reference line and the proposal."""
    a = anchors(nodes, key).filter(F.contains("href", F.lit(marker)) & (F.col("title") != ""))
    g = a.groupBy(key, "href").agg(F.array_sort(F.collect_list(F.struct("node", "title"))).alias("v"))
    v = F.transform("v", lambda x: x["title"])
    line = F.get(F.filter(v, lambda x: F.contains(F.lower(x), F.lit("registered"))), F.lit(0))
    day = parse_council_date(F.regexp_extract(line, r"(?i)Registered\s*:\s*([^|]+)$", 1))
    ref = F.coalesce(query_param("href", "applicationNumber"), reference(F.array_join(v, " "), "forms"))
    out = g.select(key, ref.alias("reference"), join_root(base, F.col("href")).alias("url"), F.get(v, F.lit(0)).alias("address"), F.get(v, F.lit(2)).alias("description"), day.alias("date_received"))
    return out.filter("reference is not null").withColumn("postcode", extract_postcode("address"))


def anchor_listing(containers: DataFrame, base: Column, params: list[str], dialect: str = "generic", key: str = "page_id") -> DataFrame:
    """Applications from links with their container text (sources.html.containers): the first of a uid wins."""
    uid = F.coalesce(uid_from_url("href", params, None, dialect), reference("context", dialect))
    c = containers.select(key, "node", uid.alias("uid"), F.coalesce(reference("context", dialect), reference("title", dialect)).alias("reference"), join_root(base, F.col("href")).alias("url"), "context").filter("uid is not null")
    return c.groupBy(key, "uid").agg(F.min_by(F.struct("node", "reference", "url", "context"), "node").alias("m")).select(key, "uid", "m.*")


def document_cells(cells: Column, row_text: Column, title: Column) -> Column:
    """date_published, file_size, document_type, description: the first cell of each sort that is not the title."""
    others = F.filter(cells, lambda c: c != title)
    day = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b|\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+\d{1,2}\s+\w+\s+\d{4}\b"
    sort = lambda c: F.when(c.rlike(day), "day").when(c.rlike(r"(?i)\b\d+(?:\.\d+)?\s*(?:kb|mb|gb)\b"), "size").when(normalize_label(c).isin(*CELL_TYPES), "type").otherwise("text")

    def told(sorted_: Column) -> Column:
        first = lambda kind: F.get(F.filter(sorted_, lambda x: x["sort"] == kind), F.lit(0))["cell"]
        shown = F.coalesce(first("day"), blank_to_null(F.regexp_extract(row_text, day, 0)))
        return F.struct(shown.alias("date_published"), first("size").alias("file_size"), first("type").alias("document_type"), first("text").alias("description"))

    return let(F.transform(others, lambda c: F.struct(c.alias("cell"), sort(c).alias("sort"))), told)


def page_quality(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """key, quality: explicit_empty, busy_empty (an empty result table and a busy notice) or null."""
    rows = nodes.filter("tag = 'tr'").select(key, F.col("node").alias("r"))
    tables = nodes.filter("tag = 'table'").select(key, F.col("node").alias("t"), "last", "text")
    held = tables.join(rows, key).filter("r > t and r <= last").groupBy(key, "t").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    bare = held.filter((F.col("n") == 1) & F.contains(F.lower(clean_text("text")), F.lit("application number"))).select(key, F.lit(True).alias("bare")).distinct()
    whole = nodes.filter("parent = -1").groupBy(key).agg(F.lower(clean_text(F.array_join(F.collect_list("text"), " "))).alias("text"))
    q = F.when(contains_any(F.col("text"), NO_RESULTS), "explicit_empty").when(F.coalesce("bare", F.lit(False)) & F.contains("text", F.lit(BUSY)), "busy_empty")
    return whole.join(bare, key, "left").select(key, q.alias("quality"))


def infer_dates(apps: DataFrame, start: Column, target: str = "date_received") -> DataFrame:
    """Applications without either date get the window's start in target, and a flag that says so."""
    none = blank_to_null("date_received").isNull() & blank_to_null("date_validated").isNull()
    return apps.withColumns({"date_inferred": none, target: F.when(none, start).otherwise(F.col(target))})


def repeated_pages(pages: DataFrame, key: str, body: str) -> DataFrame:
    """key, digest, n of page bodies that a paged feed gave more than once."""
    return pages.groupBy(key, F.sha2(body, 256).alias("digest")).agg(F.count("*").alias("n")).filter("n > 1")


def date_fields(names: Column) -> Column:
    """The form fields for the window's ends: least (priority, name) of the date fields on each side."""
    def best(side: str) -> Column:
        def rank(n: Column) -> Column:
            label = normalize_label(n)
            p = F.lit(10)
            for value, tokens in reversed(DATE_PRIORITY):
                p = F.when(contains_any(label, tokens), value).otherwise(p)
            return F.struct(p.alias("p"), n.alias("name"))

        fit = F.filter(names, lambda n: F.contains(normalize_label(n), F.lit("date")) & contains_any(normalize_label(n), DATE_SIDES[side]))
        return F.array_min(F.transform(fit, rank))["name"]

    return F.struct(best("from").alias("from"), best("to").alias("to"))


def preferred_criterion(labels: Column) -> Column:
    """The first criterion that a label holds: criteria in order, then labels in order."""
    hits = [_holding(labels, c) for c in CRITERIA]
    return F.coalesce(*hits, F.get(labels, F.lit(0)))


def _holding(labels: Column, criterion: str) -> Column:
    return F.get(F.filter(labels, lambda x: F.contains(F.lower(x), F.lit(criterion))), F.lit(0))


def final_attempts(attempts: DataFrame) -> DataFrame:
    """Two-phase runs: the last attempt of each authority, and whether it was retried. attempts: authority, attempt, error, n."""
    return attempts.groupBy("authority").agg(F.max_by(F.struct("attempt", "error", "n"), "attempt").alias("m"), (F.count("*") > 1).alias("retried")).select("authority", "m.*", "retried")


def slow_attempts(log: DataFrame, inactivity: int, total: int) -> DataFrame:
    """attempt, reason of attempts silent for over inactivity seconds or over total seconds long. log: attempt, at (seconds)."""
    w = Window.partitionBy("attempt").orderBy("at")
    g = log.withColumn("gap", F.col("at") - F.lag("at").over(w)).groupBy("attempt").agg(F.max("gap").alias("gap"), (F.max("at") - F.min("at")).alias("span"))
    reason = F.when(F.col("gap") > inactivity, "inactive").when(F.col("span") > total, "too long")
    return g.select("attempt", reason.alias("reason")).filter("reason is not null")


def received_in(apps: DataFrame, start: str, end: str) -> DataFrame:
    """The null-tolerant filter of listings over strict ISO dates."""
    from registrum.functions.dates import in_window_or_unknown

    return apps.filter(in_window_or_unknown(iso_date("date_received"), start, end))

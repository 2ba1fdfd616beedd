"""Listings and details of the portal families, as queries over the node table (sources.html).

Each gives key, uid, reference, url and what its family shows, one row a uid, the first in the page's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registrum.functions import dates, fixed, urls
from registrum.functions.text import application_number, blank_to_null, clean_text, contains_any, extract_postcode, idox_reference, northgate_reference, reference, trim_text, without_label, without_reference
from registrum.operators.relations import first_wins
from registrum.sources.html import anchors, enclosing, first_within, has_class, header_tables, label_columns, labelled_pairs, nearest, row_cells, sequential_pairs
from registrum.sources.listings import labelled_text

def _row() -> Column:
    return F.col("tag") == "tr"


def _item() -> Column:
    return F.col("tag").isin("li", "article", "div")


def _low(c: str) -> Column:
    return F.lower(F.col(c))


def _rows(nodes: DataFrame, key: str, found: Column) -> DataFrame:
    """Links that pass found, with the text of their row, else of the nearest item, else their own: row_text."""
    a = enclosing(anchors(nodes, key).filter(found), nodes, [_row(), _item()], key)
    return a.withColumn("row_text", F.coalesce(clean_text("outer_text"), F.col("title")))


def _cells(a: DataFrame, nodes: DataFrame, key: str, tags: tuple[str, ...] = ("td",)) -> DataFrame:
    return a.join(row_cells(nodes, tags, key), [key, "outer"], "left")


def _cell(i: int) -> Column:
    return blank_to_null(F.get("cells", F.lit(i)))


def _first(df: DataFrame, key: str, name: str = "uid") -> DataFrame:
    return first_wins(df, [key, name], ["node"])


def idox_listing(nodes: DataFrame, page: Column, key: str = "page_id") -> DataFrame:
    """Result items, with detail_complete: a description, an address and a date are there."""
    a = _rows(nodes, key, F.contains("href", F.lit("applicationDetails.do")))
    a = a.withColumns({"uid": F.coalesce(urls.query_param("href", "keyVal")), "reference": idox_reference(F.col("title"), F.col("row_text"))}).filter("uid is not null").drop("outer", "outer_last", "outer_text")
    item = ((F.col("tag") == "li") & has_class("searchresult")) | (F.col("tag") == "article") | ((F.col("tag") == "div") & has_class("searchresult"))
    a = enclosing(a, nodes, [item], key)
    for name, test in (("clamp", has_class("summaryLinkTextClamp")), ("place", has_class("address")), ("meta", has_class("metaInfo"))):
        a = first_within(a, nodes, test, name, key)
    badge = nodes.filter(has_class("badge-status")).select(key, F.col("node").alias("outer"), F.col("last").alias("outer_last"))
    shown = first_within(badge, nodes, has_class("value"), "status", key).filter("status is not null").select(F.col(key).alias("_k"), F.col("outer").alias("_b"), "status")
    j = a.select(key, "outer", "outer_last").filter("outer is not null").distinct().join(shown, (F.col(key) == F.col("_k")) & (F.col("_b") > F.col("outer")) & (F.col("_b") <= F.col("outer_last")))
    a = a.join(j.groupBy(key, "outer").agg(F.min_by("status", "_b").alias("status")), [key, "outer"], "left")
    a = a.select(
        key, "node", "uid", "reference", urls.summary_url(page, F.col("uid")).alias("url"),
        F.coalesce("place", without_reference("row_text", "reference", labels=True)).alias("address"),
        F.coalesce("clamp", F.when(F.col("title") != F.coalesce("reference", F.lit("")), blank_to_null("title"))).alias("description"), "status",
        dates.labelled_date(F.col("meta"), "Received").alias("date_received"), dates.labelled_date(F.col("meta"), "Validated").alias("date_validated"),
    )
    whole = F.col("description").isNotNull() & F.col("address").isNotNull() & F.coalesce("date_received", "date_validated").isNotNull()
    return _first(a, key).withColumns({"detail_complete": whole, "postcode": extract_postcode("address")}).drop("node")


def idox_detail(nodes: DataFrame, page: Column, key: str = "page_id") -> DataFrame:
    """One row a page: the labelled columns; the uid is the address's, else the page's technical key, else the reference."""
    d = label_columns(labelled_pairs(nodes, key), "idox", key, {"technical": ["casetechnicalkey", "case_technical_key"], "own_postcode": ["postcode"]})
    uid = F.coalesce(urls.query_param(page, "keyVal"), "technical", "reference")
    read = {c: dates.parse_council_date(c) for c in ("date_received", "date_validated")}
    return d.withColumns({"uid": uid, "postcode": extract_postcode("address", "own_postcode"), **read}).drop("technical", "own_postcode")


def generic_detail(nodes: DataFrame, texts: DataFrame, page: Column, fallback: Column, key: str = "page_id") -> DataFrame:
    """Labelled fields from every source a page has; the uid is the address's, else fallback, else the reference."""
    pairs = labelled_pairs(nodes, key, class_labels=True, inputs=False).unionByName(sequential_pairs(texts, "generic", key))
    d = label_columns(pairs, "generic", key)
    ref = F.coalesce("reference", fallback)
    read = {c: dates.parse_council_date(c) for c in ("date_received", "date_validated")}
    return d.withColumns({"uid": F.coalesce(urls.uid_from_url(page, ["id", "ref"], fixed.DETAIL_PATH), ref), "reference": ref, "postcode": extract_postcode("address"), **read})


def form_fields(fields: DataFrame, listing_text: Column, fallback: Column, url: Column, key: str = "page_id") -> DataFrame:
    """Form-dialect columns; the reference is the mapped one, else fallback, else one in the listing's text or in any value."""
    d = label_columns(fields, "forms", key)
    values = fields.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "ordinal", "value"))), lambda x: x["value"]), " ").alias("values"))
    d = d.join(values, key)
    ref = F.coalesce("reference", fallback, reference(listing_text, "forms"), reference("values", "forms"))
    read = {c: dates.parse_council_date(c) for c in ("date_received", "date_validated")}
    return d.withColumns({"reference": ref, "postcode": extract_postcode("address"), **read}).withColumn("uid", F.coalesce("reference", url)).drop("values")


def atrium_listing(nodes: DataFrame, page: Column, key: str = "page_id") -> DataFrame:
    """Rows with mobile headings, rows by position, or cards."""
    a = enclosing(anchors(nodes, key).filter(F.contains(_low("href"), F.lit("/planning/display"))), nodes, [_row()], key)
    a = a.withColumn("uid", F.coalesce(urls.query_param("href", "applicationNumber"), urls.display_uid(F.col("href")))).filter("uid is not null")
    a = _cells(a, nodes, key)
    head = F.trim(F.regexp_replace(_low("heading"), "[^a-z]+", " "))
    cells = nodes.filter("tag = 'td'").select(key, F.col("parent").alias("row"), F.col("node").alias("outer"), F.col("last").alias("outer_last"), F.col("text").alias("whole"))
    cells = first_within(cells, nodes, has_class("mobile-heading"), "heading", key).filter("heading is not null")
    value = blank_to_null(F.replace(clean_text("whole"), F.col("heading"), F.lit("")))
    has = lambda *names: contains_any(F.col("h"), list(names))
    name = F.when(has("application") & has("no", "number"), "reference").when(has("location", "address"), "address").when(has("proposal", "description"), "description").when(has("status"), "status").when(has("date"), "date")
    cells = cells.select(key, F.col("row").alias("outer"), F.col("outer").alias("node"), head.alias("h"), value.alias("value")).filter("value is not null").withColumn("name", name)
    pick = lambda n: F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("node"))).alias(f"m_{n}")
    a = a.join(cells.groupBy(key, "outer").agg(*map(pick, ("reference", "address", "description", "status", "date")), F.lit(True).alias("headed")), [key, "outer"], "left")
    card = ((F.col("tag") == "div") & (has_class("results__item") | has_class("searchResultsCardRow")))
    box = enclosing(a.select(key, "node"), nodes, [card], key).select(key, "node", F.col("outer_text").alias("card_text"))
    titles = enclosing(nodes.filter(F.col("tag").isin("h1", "h2", "h3")).select(key, "node", "text"), nodes, [card | _row()], key).groupBy(key, "outer").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", clean_text("text").alias("t")))), lambda x: x["t"]).alias("titles"))
    boxed = enclosing(a.select(key, "node"), nodes, [_row(), card], key).select(key, "node", F.col("outer").alias("box"))
    a = a.join(box, [key, "node"], "left").join(boxed, [key, "node"], "left").join(titles.withColumnRenamed("outer", "box"), [key, "box"], "left")
    headed, rows = F.coalesce("headed", F.lit(False)), F.coalesce(F.size("cells"), F.lit(0)) > 0
    status = F.split(F.get("cells", F.lit(6)), " - ", 2)
    candidates = F.transform(F.concat(F.array("title"), F.coalesce("titles", F.array().cast("array<string>"))), application_number)
    shown = F.get(F.filter(candidates, lambda c: (F.lower(c) == _low("uid")) | (F.contains(c, F.lit("/")) & (F.length(c) < 80))), F.lit(0))
    by = lambda m, i: F.when(headed, F.col(m)).when(rows, _cell(i))
    day = F.when(headed, F.date_format(dates.council_date("m_date"), "yyyy-MM-dd")).when(rows, dates.parse_council_date(_cell(4))).otherwise(dates.parse_council_date(blank_to_null(F.regexp_extract("card_text", fixed.CARD_DATE, 1))))
    a = a.select(
        key, "node", F.lower("uid").alias("_u"), "uid", F.coalesce(shown, "uid").alias("reference"), urls.join_root(page, F.col("href")).alias("url"),
        F.coalesce(by("m_address", 2), F.when(~rows & (_low("title") != _low("uid")), blank_to_null("title"))).alias("address"), by("m_description", 3).alias("description"),
        F.when(headed, F.col("m_status")).when(rows, blank_to_null(F.get(status, F.lit(0)))).alias("status"), F.when(~headed & rows, blank_to_null(F.get(status, F.lit(1)))).alias("decision"), day.alias("date_validated"),
    )
    return _first(a, key, "_u").drop("node", "_u").withColumn("postcode", extract_postcode("address"))


def ocella_listing(nodes: DataFrame, page: Column, params: list[str], key: str = "page_id") -> DataFrame:
    """Rows of three, four or five cells and more: address, description, then a date or a status, or both."""
    a = _rows(nodes, key, F.lit(True)).withColumn("uid", F.coalesce(*[urls.query_param("href", p) for p in params])).filter("uid is not null")
    a = _cells(a.filter(urls.is_application_link(F.col("href"), F.col("title"), F.lit(None).cast("string"), F.col("uid"), "ocella")), nodes, key)
    n = F.coalesce(F.size("cells"), F.lit(0))
    dated = _cell(3).rlike(fixed.ROW_DATE)
    ref = F.coalesce(F.when(urls.query_param("href", "reference").isNotNull(), F.col("uid")), reference("title", "ocella"), reference("row_text", "ocella"), blank_to_null("title"), "uid")
    a = a.withColumn("reference", ref)
    own = F.when(n >= 3, _cell(1))
    a = a.select(
        key, "node", "uid", "reference", urls.join_root(page, F.col("href")).alias("url"), F.coalesce(own, without_reference("row_text", "reference")).alias("address"), F.when(n >= 3, _cell(2)).alias("description"),
        F.when(n >= 5, _cell(4)).when((n == 4) & ~F.coalesce(dated, F.lit(False)), _cell(3)).alias("status"), F.when((n >= 5) | ((n == 4) & dated), dates.parse_council_date(_cell(3))).alias("date_received"),
        extract_postcode(F.coalesce(own, "row_text")).alias("postcode"),
    )
    return _first(a, key).drop("node")


def ocella_cap(text: Column) -> Column:
    """shown and total of a capped result page; other pages: null."""
    at = lambda k: F.regexp_extract(clean_text(text), fixed.RESULT_CAP, k).try_cast("int")
    return F.when(at(1).isNotNull(), F.struct(at(1).alias("shown"), at(2).alias("total")))


def northgate_listing(pages: DataFrame, nodes: DataFrame, params: list[str], start: str | None, key: str = "page_id") -> DataFrame:
    """Result pages in order, cut at the reported total; rows without dates get the window's start. pages: key, register, turn, url."""
    a = _rows(nodes, key, F.lit(True)).withColumn("uid", F.coalesce(*[urls.query_param("href", p) for p in params]))
    a = a.filter(urls.is_application_link(F.col("href"), F.col("title"), F.lit(None).cast("string"), F.col("uid"), "northgate"))
    a = a.withColumn("reference", northgate_reference(F.col("title"), F.col("row_text"), F.col("uid")))
    body = nodes.filter("parent = -1").groupBy(key).agg(clean_text(F.array_join(F.collect_list("text"), " ")).alias("body"))
    total = body.select(key, F.regexp_extract("body", fixed.RESULT_TOTAL, 1).try_cast("int").alias("total"))
    j = a.join(pages.select(key, "register", "turn", F.col("url").alias("page_url")), key)
    most = total.join(pages.select(key, "register", "turn"), key).filter("total is not null").groupBy("register").agg(F.min_by("total", "turn").alias("total"))
    one = first_wins(j.select("register", "turn", "node", "uid", "reference", urls.join_root(F.col("page_url"), F.col("href")).alias("url"), without_reference("row_text", "reference").alias("address")), ["register", "uid"], ["turn", "node"])
    place = F.row_number().over(Window.partitionBy("register").orderBy("turn", "node"))
    out = one.join(most, "register", "left").withColumn("_n", place).filter("total is null or _n <= total")
    return out.withColumns({"date_received": F.lit(start), "date_inferred": F.lit(start is not None)}).drop("turn", "node", "_n", "total")


def northgate_pages(nodes: DataFrame, page: Column, key: str = "page_id") -> DataFrame:
    """Addresses of further result pages, each once by its canonical form."""
    a = anchors(nodes, key).filter(F.contains(_low("href"), F.lit("stdresults.aspx")) & F.col("href").rlike(r"(?i)[?&]\s*p\s*="))
    a = a.withColumn("url", urls.join_root(page, F.regexp_replace("href", r"[\r\n\t]+", ""))).withColumn("canonical", urls.canonical_url("url"))
    return first_wins(a.select(key, "node", "url", "canonical"), [key, "canonical"], ["node"]).drop("node")


def legacy_pages(nodes: DataFrame, page: Column, most: int = 50, key: str = "page_id") -> DataFrame:
    """Addresses of further result pages by start index, each once, in the page's order, most at most."""
    a = anchors(nodes, key)
    for marker in fixed.LEGACY_PAGES:
        a = a.filter(F.contains(_low("href"), F.lit(marker)))
    a = first_wins(a.select(key, "node", urls.join_root(page, F.col("href")).alias("url")).filter(F.col("url") != page), [key, "url"], ["node"])
    return a.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy("node"))).filter(F.col("turn") <= most).select(key, "turn", "url")


def legacy_listing(nodes: DataFrame, page: Column, params: list[str], key: str = "page_id") -> DataFrame:
    """Links by key: the reference is the link's, else the row's, else the key; a date in a link counts as one, as it has the form."""
    a = _rows(nodes, key, F.lit(True)).withColumn("uid", F.coalesce(*[urls.query_param("href", p) for p in params])).filter("uid is not null")
    a = a.withColumn("reference", F.coalesce(reference("title", "generic"), reference("row_text", "generic"), "uid"))
    return _first(a.select(key, "node", "uid", "reference", urls.join_root(page, F.col("href")).alias("url"), without_reference("row_text", "reference").alias("address")), key).drop("node")


def paged_tables(pages: DataFrame, nodes: DataFrame, start: str | None, key: str = "page_id") -> DataFrame:
    """Header-table rows of numbered result pages, up to the first page that brings no new reference (equal but for case).

    pages: key, register, turn (from 1). Rows without dates get start.
    """
    rows = header_tables(nodes, "forms", key)
    pick = lambda c: F.max(F.when(F.col("column") == c, F.col("value"))).alias(c)
    r = rows.groupBy(key, "row", "href").agg(*map(pick, ("reference", "address", "description", "status", "date_received", "date_validated"))).filter("reference is not null")
    r = r.join(pages.select(key, "register", "turn"), key).withColumn("_k", F.lower("reference"))
    one = first_wins(r, ["register", "_k"], ["turn", "row"])
    new = pages.select("register", "turn").join(one.groupBy("register", "turn").agg(F.count("*").alias("n")), ["register", "turn"], "left")
    stop = new.filter("turn > 1 and n is null").groupBy("register").agg(F.min("turn").alias("stop"))
    out = one.join(stop, "register", "left").filter("stop is null or turn < stop")
    day = {c: dates.parse_council_date(c) for c in ("date_received", "date_validated")}
    out = out.withColumns(day)
    none = F.coalesce("date_received", "date_validated").isNull() & F.lit(start is not None)
    return out.withColumns({"date_inferred": none, "date_received": F.when(none, F.lit(start)).otherwise(F.col("date_received"))}).select("register", "turn", "reference", "href", "address", "description", "status", "date_received", "date_validated", "date_inferred")


def followed(pages: DataFrame, nodes: DataFrame, key: str = "page_id", exact: bool = False) -> DataFrame:
    """Stored pages of a chain of "next" links up to the first that has none or leads back. pages: key, register, turn, url.

    exact: the link's text is "next" and no more.
    """
    a = anchors(nodes, key)
    a = a.filter(_low("title") == "next") if exact else a.filter(F.contains(_low("title"), F.lit("next")))
    nxt = a.groupBy(key).agg(F.min_by("href", "node").alias("href"))
    p = pages.join(nxt, key, "left").withColumn("next_url", urls.join_root(F.col("url"), F.col("href")))
    seen = pages.select("register", F.col("url").alias("next_url"), F.col("turn").alias("met"))
    back = p.join(seen, ["register", "next_url"], "left").groupBy("register", "turn").agg(F.coalesce(F.min("met") <= F.first("turn"), F.lit(False)).alias("back"), F.first("next_url").alias("next_url"))
    last = back.filter("next_url is null or back").groupBy("register").agg(F.min("turn").alias("last"))
    return pages.join(last, "register", "left").filter("last is null or turn <= last").drop("last")


def fastweb_listing(nodes: DataFrame, page: Column, key: str = "page_id") -> DataFrame:
    """Detail links, each with the labelled text of the table around it."""
    table = (F.col("tag") == "table") & F.contains("text", F.lit("App. No."))
    a = enclosing(anchors(nodes, key).filter(F.contains(_low("href"), F.lit("detail.asp"))), nodes, [table], key)
    a = a.withColumn("f", labelled_text(clean_text("outer_text")))
    ref = F.trim(F.coalesce(urls.query_param("href", "AltRef"), "f.app_no", reference("href", "forms")))
    a = a.select(key, "node", ref.alias("reference"), urls.join_root(page, F.col("href")).alias("url"), F.col("f.site_address").alias("address"), F.col("f.description").alias("description"), dates.parse_council_date("f.received_date").alias("date_received")).filter("reference is not null")
    return _first(a.withColumn("_k", F.lower("reference")), key, "_k").drop("node", "_k").withColumns({"uid": F.col("reference"), "postcode": extract_postcode("address")})


def list_items(nodes: DataFrame, page: Column, key: str = "page_id") -> DataFrame:
    """Links with a reference in text or address: the item's text gives an address of 240 and a description of 500 characters."""
    a = anchors(nodes, key).withColumn("reference", reference(F.concat_ws(" ", "title", "href"), "forms"))
    a = a.filter(urls.is_application_link(F.col("href"), F.col("title"), F.col("reference"), F.col("reference"), "htmllist"))
    a = enclosing(a, nodes, [F.col("tag").isin("article", "li", "div")], key).withColumn("text", F.coalesce(clean_text("outer_text"), F.col("title")))
    a = a.select(
        key, "node", F.lower("reference").alias("_k"), "reference", F.col("reference").alias("uid"), urls.join_root(page, F.col("href")).alias("url"), trim_text(F.replace("text", F.col("reference"), F.lit(" ")), 240).alias("address"),
        trim_text("text", 500).alias("description"), dates.parse_council_date(dates.first_date("text")).alias("date_received"), extract_postcode("text").alias("postcode"),
    )
    return _first(a, key, "_k").drop("node", "_k")


def table_or_list(nodes: DataFrame, page: Column, key: str = "page_id") -> DataFrame:
    """Rows of header tables; pages that have none are read as lists of links."""
    t = header_tables(nodes, "forms", key)
    pick = lambda c: F.max(F.when(F.col("column") == c, F.col("value"))).alias(c)
    t = t.groupBy(key, "row", "href").agg(*map(pick, ("reference", "address", "description", "date_received"))).filter("reference is not null")
    t = first_wins(t.withColumn("_k", F.lower("reference")), [key, "_k"], ["row"])
    table = t.select(key, "reference", urls.join_root(page, F.col("href")).alias("url"), "address", "description", dates.parse_council_date("date_received").alias("date_received"), F.lit("table").alias("source"))
    items = list_items(nodes, page, key).join(t.select(key).distinct(), key, "left_anti")
    return table.unionByName(items.select(key, "reference", "url", "address", "description", "date_received", F.lit("list").alias("source")))


def nested_results(nodes: DataFrame, page: Column, key: str = "page_id") -> DataFrame:
    """Result tables within a table: the longest wide cell that tells no decision is the description, its end after "at" the address."""
    a = anchors(nodes, key).filter(F.contains(_low("href"), F.lit("plappdets")))
    t = nearest(a, nodes, [F.col("tag") == "table"], key).filter("outer is not null").groupBy(key, "outer").agg(F.min_by("href", "node").alias("href"))
    forms = nodes.filter("tag = 'form'").select(key, F.explode("up").alias("_n")).distinct()
    wide = nodes.filter("tag = 'td' and attrs['colspan'] = '2'").select(key, F.col("node").alias("_n"), clean_text("text").alias("_t"), "up").filter("_t is not null and not contains(lower(_t), 'decision has')")
    wide = wide.join(forms, [key, "_n"], "left_anti")
    own = wide.select(key, "_n", F.length("_t").alias("_l"), F.explode("up").alias("outer")).join(t.select(key, "outer"), [key, "outer"])  # numbers first, the chosen texts then
    best = own.groupBy(key, "outer").agg(F.max_by("_n", F.struct("_l", -F.col("_n"))).alias("_n"))
    best = best.join(wide.select(key, "_n", F.col("_t").alias("description")), [key, "_n"]).drop("_n")
    tables = nodes.filter("tag = 'table'").select(key, F.col("node").alias("outer"), F.col("text").alias("outer_text"))
    d = t.join(best, [key, "outer"], "left").join(tables, [key, "outer"], "left")
    text = clean_text("outer_text")
    ref = F.coalesce(urls.query_param("href", "casefullref"), blank_to_null(F.regexp_extract(text, fixed.TABLE_NUMBER, 1)))
    place = F.when(F.contains(_low("description"), F.lit(" at ")), F.rtrim(F.regexp_extract("description", fixed.AFTER_AT, 1), F.lit(".")))
    out = d.select(key, F.col("outer").alias("node"), ref.alias("reference"), urls.join_root(page, F.col("href")).alias("url"), "description", place.alias("address"), dates.parse_council_date(blank_to_null(F.regexp_extract(text, fixed.TABLE_DATE, 1))).alias("date_received"))
    return _first(out.filter("reference is not null").withColumn("_k", F.lower("reference")), key, "_k").drop("node", "_k")


def positional_rows(nodes: DataFrame, page: Column, marker: str, key: str = "page_id") -> DataFrame:
    """Rows around links to summary pages: reference, valid date, address, proposal by position."""
    a = enclosing(anchors(nodes, key).filter(F.contains(_low("href"), F.lit(marker))), nodes, [_row()], key).filter("outer is not null and title != ''")
    a = _cells(a, nodes, key, ("td", "th"))
    out = a.select(key, "node", F.col("title").alias("reference"), urls.join_root(page, F.col("href")).alias("url"), dates.parse_council_date(_cell(1)).alias("date_validated"), _cell(2).alias("address"), _cell(3).alias("description"))
    return _first(out.withColumn("_k", F.lower("reference")), key, "_k").drop("node", "_k").withColumn("postcode", extract_postcode("address"))


def form_rows(nodes: DataFrame, page: Column, key: str = "page_id") -> DataFrame:
    """Rows of a classic register: a form with the reference in a hidden field, the address in the row's first cell."""
    forms = nodes.filter("tag = 'form'").select(key, "node", F.col("last").alias("_fl"), F.col("attrs")["action"].alias("action"))
    inputs = nodes.filter("tag = 'input' and attrs['name'] is not null").select(F.col(key).alias("_k"), F.col("node").alias("_i"), F.col("attrs")["name"].alias("name"), F.coalesce(F.col("attrs")["value"], F.lit("")).alias("value"), F.lower(F.coalesce(F.col("attrs")["type"], F.lit("text"))).alias("type"))
    j = forms.join(inputs, (F.col(key) == F.col("_k")) & (F.col("_i") > F.col("node")) & (F.col("_i") <= F.col("_fl")))
    field = F.concat(F.url_encode("name"), F.lit("="), F.url_encode("value"))
    query = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("type").isin("submit", "button", "image", "reset"), F.struct("_i", field.alias("f"))))), lambda x: x["f"]), "&")
    f = j.groupBy(key, "node", "action").agg(clean_text(F.min_by(F.when(F.col("name") == "vUPRN", F.col("value")), F.when(F.col("name") == "vUPRN", F.col("_i")))).alias("reference"), query.alias("query")).filter("reference is not null")
    f = _cells(enclosing(f, nodes, [_row()], key), nodes, key, ("td", "th"))
    return f.select(key, "reference", F.concat(urls.join_root(page, F.col("action")), F.lit("?"), "query").alias("url"), _cell(0).alias("address"), F.lit(False).alias("detail_complete"))


def weekly_records(cells: DataFrame, root: Column, report: Column) -> DataFrame:
    """Applications of a weekly report's rows (payloads.weekly_csv); rows without a received date get the report's day."""
    c = lambda n: F.col("cells")[n]
    ref = application_number(c("application_number"))
    received = dates.parse_council_date(without_label(c("valid_start_date"), "Registered"))
    out = cells.withColumns({
        "reference": ref, "address": clean_text(F.coalesce(blank_to_null(c("location1")), c("location"))), "description": clean_text(F.coalesce(blank_to_null(c("proposal1")), c("proposal"))),
        "date_received": F.coalesce(received, report), "date_validated": dates.parse_council_date(without_label(c("received_complete_date"), "Valid")), "date_inferred": received.isNull(),
    })
    return out.filter("reference is not null").withColumn("url", urls.with_query(F.concat(root, F.lit("/Planning/Display")), ("applicationNumber", F.col("reference")))).drop("cells")


def page_cap(text: Column, current: Column) -> Column:
    """Whether a result page holds fewer than it reports, and how many to ask for: 250 at least, 1,000 at most."""
    counts = F.transform(F.regexp_extract_all(text, F.lit(fixed.REPORTED_COUNT), F.lit(1)), lambda x: x.cast("int"))
    most = F.coalesce(F.array_max(counts), F.lit(0))
    return F.struct((most > current).alias("more"), F.least(F.greatest(most, F.lit(250)), F.lit(1000)).alias("ask"))


def grid_pages(rows: DataFrame, start: str) -> DataFrame:
    """Rows of a register's pages, newest first, up to the first page whose least date is before start. rows: register, turn, date_received."""
    d = rows.withColumn("_d", dates.iso_date("date_received"))
    stop = d.groupBy("register", "turn").agg(F.min("_d").alias("least")).filter(F.col("least") < F.lit(start).cast("date")).groupBy("register").agg(F.min("turn").alias("stop"))
    return d.join(stop, "register", "left").filter("stop is null or turn <= stop").drop("_d", "stop")

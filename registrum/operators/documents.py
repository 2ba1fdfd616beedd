"""Documents of applications: source addresses, the dialects in which registers list them, their union and file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.functions import fixed
from registrum.functions.dates import date_part, parse_council_date, weekday_date
from registrum.functions.files import known
from registrum.functions.text import blank_to_null, clean_text, contains_any, sanitize_path_part, without_title
from registrum.functions.urls import base_url, downloadable_document, is_dialect_document, is_document_href, is_document_link_text, join_root, path, query_param, set_param, title_from_url, with_query
from registrum.operators.relations import first_wins
from registrum.sources.html import anchors, enclosing, first_within, row_cells
from registrum.sources.listings import document_cells

# --- fixed values: markers of listing and application addresses --------------------------------------------------------
LISTING_MARKERS = ["search.do?action=advanced", "search.do?action=simple", "search/advanced", "advancedsearch", "advanced-search", "public-register", "register-view", "weekly/monthly"]
APPLICATION_PATHS = ["/planning/display/", "/planning/application/", "/planningapplications/"]
DOCUMENT = ["title", "url", "document_type", "date_published", "file_size", "description", "source_url"]


def is_listing_url(url: Column) -> Column:
    p = F.regexp_replace(F.lower(path(url)), "/+$", "")
    detail = F.contains(p, F.lit("applicationdetails.do"))
    return ~detail & (contains_any(F.lower(url), LISTING_MARKERS) | p.rlike("/search(/advanced)?$"))


def document_source(url: Column) -> Column:
    """Where an application address lists its documents; listings and others: null."""
    p = F.lower(path(url))
    keyed = F.when(F.lower(url).rlike("[?&]keyval="), set_param(url, "activeTab", "documents")).otherwise(url)
    return F.when(is_listing_url(url), None).when(F.contains(p, F.lit("applicationdetails.do")), keyed).when(contains_any(p, APPLICATION_PATHS) | is_document_href(url), url)


def document_sources(docs_url: Column, portal_url: Column, url: Column, raw_source: Column, source: Column) -> Column:
    """Addresses to read for documents, in order, each once: the register's own, those derived, then plain ones but no listings."""
    plain = [blank_to_null(c) for c in (portal_url, url, raw_source, source)]
    kept = [F.when(~is_listing_url(c), c) for c in plain]
    return F.array_distinct(F.array_compact(F.array(blank_to_null(docs_url), *[document_source(c) for c in plain], *kept)))


def shaped(df: DataFrame, key: str, **cols: Column) -> DataFrame:
    """key, ordinal and the columns of DOCUMENT, null where cols has none."""
    return df.select(key, "ordinal", *[cols.get(c, F.lit(None).cast("string")).alias(c) for c in DOCUMENT])


def model_rows(pages: DataFrame, html: str, page: Column, key: str = "page_id") -> DataFrame:
    """Rows of a `var model = {...};` script."""
    body = F.regexp_extract(html, r"(?s)var\s+model\s*=\s*(\{.*?\})\s*;", 1)
    r = pages.select(key, page.alias("_page"), F.posexplode(F.from_json(F.get_json_object(body, "$.Rows"), "array<struct<Guid: string, Doc_Ref2: string, Doc_Type: string>>")).alias("ordinal", "r"))
    title = F.coalesce(clean_text("r.Doc_Ref2"), clean_text("r.Doc_Type"), F.lit("Document"))
    up = F.regexp_replace(F.regexp_replace("_page", r"[?#].*$", ""), r"[^/]*/[^/]*$", "")
    return shaped(r.filter("r.Guid != ''"), key, title=title, url=F.concat(up, F.lit("Document/ViewDocument?id="), F.url_encode("r.Guid")), source_url=F.col("_page"))


def publisher_rows(pages: DataFrame, json: str, page: Column, context: Column, key: str = "page_id") -> DataFrame:
    """Array rows: the last document address, and before it the nearest text that is no date."""
    r = pages.select(key, page.alias("_page"), context.alias("_ctx"), F.posexplode(F.from_json(json, "array<array<string>>")).alias("ordinal", "r"))
    places = F.filter(F.sequence(F.lit(0), F.size("r") - 1), lambda i: is_document_href(F.get("r", i)))
    r = r.filter(F.size("r") >= 2).withColumn("_at", F.element_at(F.when(F.size(places) > 0, places), -1)).filter("_at is not null")
    texts = F.filter(F.slice("r", F.lit(1), F.col("_at")), lambda x: clean_text(x).isNotNull() & ~clean_text(x).rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"))
    href = F.get("r", F.col("_at"))
    href = F.when(F.startswith(href, F.lit("/")), F.concat(F.coalesce("_ctx", F.lit("")), href)).otherwise(href)
    title = F.coalesce(clean_text(F.when(F.size(texts) > 0, F.element_at(texts, -1))), F.lit("Document"))
    return shaped(r, key, title=title, url=join_root(F.col("_page"), href), document_type=clean_text(F.get("r", F.lit(0))), date_published=clean_text(F.get("r", F.lit(1))), source_url=F.col("_page"))


def attribute_rows(nodes: DataFrame, page: Column, key: str = "page_id") -> DataFrame:
    """Table rows that carry a document's keys in data attributes."""
    a = lambda n: F.coalesce(F.col("attrs")[f"data-{n}"], F.lit(""))
    n = nodes.filter("tag = 'tr' and attrs['data-module'] is not null and attrs['data-recordnumber'] is not null and attrs['data-planid'] is not null and attrs['data-imageid'] is not null").withColumn("ordinal", F.col("node"))
    whole = lambda c: F.coalesce(F.floor(c.try_cast("double")).cast("long"), F.lit(0)).cast("string")
    parts = [("module", F.url_encode(a("module"))), ("recordNumber", F.url_encode(a("recordnumber"))), ("planID", whole(a("planid"))), ("imageID", whole(a("imageid"))), ("isPlan", (F.lower(a("storedindatabase")) == "true").cast("string"))]
    query = F.concat_ws("&", *[F.concat(F.lit(f"{k}="), v) for k, v in parts])
    name = F.coalesce(blank_to_null(F.regexp_extract(a("filename"), r"([^/\\]*)$", 1)), F.lit("Document"))
    return shaped(n, key, title=name, url=F.concat(base_url(page), F.lit("/Document/GetFileBinary?"), query), source_url=page)


def content_versions(pages: DataFrame, json: str, page: Column, key: str = "page_id") -> DataFrame:
    """Version records of a content store: name with its extension, and a download address under the site's prefix."""
    kind = "array<struct<Id: string, FileExtension: string, Title: string, Document_Type__c: string, arcshared__Category__c: string, FileType: string, arcshared__Document_Date__c: string, ContentSize: string>>"
    r = pages.select(key, page.alias("_page"), F.posexplode(F.from_json(json, kind)).alias("ordinal", "r")).filter("r.Id != ''")
    ext, title = F.lower(F.coalesce(clean_text("r.FileExtension"), F.lit(""))), F.coalesce(clean_text("r.Title"), F.lit("Document"))
    named = F.when((ext != "") & ~F.endswith(F.lower(title), F.concat(F.lit("."), ext)), F.concat_ws(".", title, ext)).otherwise(title)
    prefix = F.regexp_replace(F.regexp_extract(path(F.col("_page")), r"^(.*?)/s(/|$)", 1), "/+$", "")
    url = F.concat(base_url(F.col("_page")), prefix, F.lit("/sfc/servlet.shepherd/version/download/"), F.col("r.Id"))
    return shaped(r, key, title=named, url=url, document_type=F.coalesce(clean_text("r.Document_Type__c"), clean_text("r.arcshared__Category__c"), clean_text("r.FileType")), date_published=clean_text("r.arcshared__Document_Date__c"), file_size=blank_to_null("r.ContentSize"), source_url=F.col("_page"))


def _link_rows(nodes: DataFrame, base: Column, dialect: str, key: str) -> DataFrame:
    """Document links in a dialect, the first of an address, with the text of their row or item."""
    a = anchors(nodes, key)
    a = a.filter(is_document_href("href") | is_document_link_text("title", "href") if dialect == "site" else is_dialect_document("href", dialect)).withColumn("url", join_root(base, F.col("href")))
    a = first_wins(a, [key, "url"], ["node"])
    return enclosing(a, nodes, [F.col("tag") == "tr", F.col("tag").isin("li", "article", "div")], key).withColumn("ordinal", F.col("node"))


def table_documents(nodes: DataFrame, base: Column, dialect: str = "idox", key: str = "page_id") -> DataFrame:
    """Links with what the other cells of their row tell."""
    a = _link_rows(nodes, base, dialect, key).join(row_cells(nodes, ("th", "td"), key), [key, "outer"], "left")
    title = F.coalesce(blank_to_null("title"), title_from_url("url"))
    cells = F.filter(F.coalesce("cells", F.array().cast("array<string>")), lambda c: c != "")
    a = a.withColumns({"_t": title, "_c": cells, "_r": clean_text("outer_text")})
    a = a.withColumn("_m", document_cells(F.col("_c"), F.col("_r"), F.col("_t")))
    return shaped(a, key, title=F.col("_t"), url=F.col("url"), document_type=F.col("_m.document_type"), date_published=parse_council_date("_m.date_published"), file_size=F.col("_m.file_size"), description=F.col("_m.description"), source_url=base)


def item_documents(nodes: DataFrame, base: Column, dialect: str = "generic", key: str = "page_id") -> DataFrame:
    """Links with the rest of their row's or item's text as description, and its first date."""
    a = _link_rows(nodes, base, dialect, key).withColumn("_c", clean_text("outer_text"))
    return shaped(a, key, title=F.coalesce(blank_to_null("title"), title_from_url("url")), url=F.col("url"), date_published=parse_council_date(weekday_date(F.col("_c"))), description=without_title(F.col("_c"), blank_to_null("title")), source_url=base)


def store_endpoint(nodes: DataFrame, page: Column, key: str = "page_id") -> DataFrame:
    """key, endpoint: where a store's page asks for its documents; the application number is the address's or the page's."""
    ask = nodes.filter("attrs['id'] = 'divDisplayDocumentsUrl'").groupBy(key).agg(F.min_by(F.col("attrs")["data-url"], "node").alias("u"))
    number = nodes.filter("attrs['id'] = 'spnApplicationId'").groupBy(key).agg(clean_text(F.min_by("text", "node")).alias("n"))
    j = ask.join(number, key, "left").withColumn("n", F.coalesce(query_param(page, "applicationNumber"), "n")).filter("n is not null")
    pairs = [("applicationNumber", F.col("n")), *((k, F.lit(v)) for k, v in fixed.STORE_QUERY)]
    return j.select(key, with_query(join_root(page, F.col("u")), *pairs).alias("endpoint"))


def fragment_documents(nodes: DataFrame, page: Column, key: str = "page_id") -> DataFrame:
    """Links of the fragment that a store gives."""
    a = anchors(nodes, key).filter(F.contains(F.lower("href"), F.lit("displaysearchdocument"))).withColumn("ordinal", F.col("node"))
    return shaped(a, key, title=F.coalesce(blank_to_null("title"), title_from_url("href")), url=join_root(page, F.col("href")), source_url=page)


def _records(pages: DataFrame, json: Column, kind: str, key: str, *more: Column) -> DataFrame:
    return pages.select(key, *more, F.posexplode(F.from_json(json, f"array<struct<{kind}>>")).alias("ordinal", "r"))


def stream_documents(pages: DataFrame, json: str, api: Column, page: Column, key: str = "page_id") -> DataFrame:
    """Records of a document list whose files come from a page stream."""
    r = _records(pages, F.get_json_object(json, "$.CompleteDocument"), "DocNo: string, Title: string, DocDesc: string, TypeCode: string, DocDate: string, DocCategory: string", key, api.alias("_api")).filter("r.DocNo is not null and r.DocNo not in ('', '0')")
    title = F.coalesce(clean_text("r.Title"), clean_text("r.DocDesc"), F.concat(F.lit("Document "), F.col("r.DocNo")))
    r = r.withColumn("_t", title)
    url = with_query(join_root(F.col("_api"), F.lit("Doc/pagestream")), ("cd", F.lit("download")), ("pdf", F.lit("false")), ("docno", F.col("r.DocNo")), ("filename", F.col("_t")))
    return shaped(r, key, title=F.col("_t"), url=url, document_type=F.coalesce(clean_text("r.DocDesc"), clean_text("r.TypeCode")), date_published=parse_council_date(date_part("r.DocDate")), description=clean_text("r.DocCategory"), source_url=page)


def hashed_documents(pages: DataFrame, json: str, api: Column, client: Column, key: str = "page_id") -> DataFrame:
    """Records whose address is made of the client's code and a hash; those without a hash are left out."""
    r = _records(pages, F.col(json), "documentHash: string, name: string, description: string, mediaDescription: string, receivedDate: string", key).filter("r.documentHash != ''")
    url = F.concat(api, F.lit("application/document/"), F.url_encode(client), F.lit("/"), F.url_encode("r.documentHash"))
    title = F.coalesce(clean_text("r.name"), clean_text("r.description"), clean_text("r.mediaDescription"), F.lit("Document"))
    return shaped(r, key, title=title, url=url, document_type=clean_text("r.mediaDescription"), date_published=parse_council_date(date_part("r.receivedDate")), description=clean_text("r.description"))


def lookup_documents(pages: DataFrame, json: str, page: Column, key: str = "page_id") -> DataFrame:
    """Rows of a form's lookup."""
    at = lambda *names: F.coalesce(*[clean_text(F.get_json_object("r", f"$.{n}")) for n in names])
    r = pages.select(key, F.posexplode(F.from_json(json, "array<string>")).alias("ordinal", "r")).withColumns({"_u": at("URL", "url"), "_t": F.coalesce(at("display", "value"), F.lit("Document"))}).filter("_u is not null")
    return shaped(r, key, title=F.col("_t"), url=join_root(page, F.col("_u")), source_url=page)


def field_documents(nodes: DataFrame, page: Column, key: str = "page_id") -> DataFrame:
    """Download links of rows whose fields are named by a data attribute."""
    a = anchors(nodes, key).filter(F.contains(F.lower("href"), F.lit(fixed.FIELD_DOWNLOAD))).withColumn("ordinal", F.col("node"))
    a = enclosing(a, nodes, [F.col("tag") == "tr"], key)
    for name, field in (("_d", "description"), ("_k", "document_type")):
        a = first_within(a, nodes, F.col("attrs")["data-field-name"] == field, name, key)
    return shaped(a, key, title=F.coalesce("_d", "_k", title_from_url("href")), url=join_root(page, F.col("href")), document_type=F.col("_k"), source_url=page)


def expand_bridges(docs: DataFrame, nested: DataFrame, key: str = "page_id") -> DataFrame:
    """Documents that are bridges to another list give way to that list's, in its order, if it has any. nested: bridge_url and the columns of shaped()."""
    d = docs.withColumn("_bridge", F.contains(F.lower("url"), F.lit(fixed.BRIDGE)))
    n = nested.select(key, F.col("bridge_url").alias("url"), F.struct(*DOCUMENT).alias("_n"), F.col("ordinal").alias("_o"))
    j = d.join(n, [key, "url"], "left")
    row = F.when(F.col("_bridge") & F.col("_n").isNotNull(), F.col("_n")).otherwise(F.struct(*DOCUMENT))
    return j.select(key, F.struct("ordinal", F.coalesce("_o", F.lit(0)).alias("nested")).alias("ordinal"), row.alias("r")).select(key, "ordinal", "r.*").distinct()


def all_documents(parts: list[DataFrame], key: str = "page_id") -> DataFrame:
    """Lists in their order, one row for each address of an application; only downloadable ones."""
    u = reduce(lambda a, b: a.unionByName(b), [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    u = first_wins(u, [key, "url"], ["part", "ordinal"])
    return u.filter(downloadable_document(*[F.col(c) for c in ("title", "url", "description", "document_type", "source_url")]))


def file_name(header: Column, title: Column, url: Column, fallback: Column, extension: Column) -> Column:
    """The first usable of header name, title, address and fallback, with an extension."""
    base = lambda c: sanitize_path_part(F.regexp_extract(c, r"([^/\\]*)$", 1))
    name = F.coalesce(*[F.when(blank_to_null(c).isNotNull(), base(c)) for c in (header, title, title_from_url(url), fallback)])
    has = F.regexp_extract(name, r".(\.[^.]*)$", 1) != ""
    return F.when(has, name).otherwise(F.concat(name, F.coalesce(known(extension), F.lit(".bin"))))

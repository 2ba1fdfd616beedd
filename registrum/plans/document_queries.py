"""Registered queries of document lists, files and payload families, made of suppliers, customers and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.functions import dates, files, text, urls
from registrum.operators import documents as D
from registrum.plans.registered import query, table
from registrum.sources import html, payload_source, payloads
from registrum.sources import listings as L
from registrum.sources.scratch import scratch_path


def base() -> Column:
    return F.lit("https://r.example/a/b/view.do?x=1")


def bodies(spark: SparkSession, sf_dir: str, record: str, wrap: str = "{}") -> DataFrame:
    """A JSON body for each nation: its suppliers as records, wrapped."""
    g = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", F.expr(record).alias("r")))).alias("r"))
    inner = F.to_json(F.transform("r", lambda x: x["r"]))
    before, after = wrap.split("{}")
    return g.select("s_nationkey", F.concat(F.lit(before), inner, F.lit(after)).alias("body"))


def family(spark: SparkSession, sf_dir: str, name: str, record: str, wrap: str, *columns: str) -> DataFrame:
    return payloads.applications(bodies(spark, sf_dir, record, wrap), name).select("s_nationkey", *columns)


@query("select s_nationkey, 'u' || s_suppkey uid, 'u' || s_suppkey reference, case when s_suppkey % 2 = 0 then 'l' || s_suppkey else 'w' || s_suppkey end url, s_name address, 'Open' status, '2026-06-05' date_received, 'Agent' agent_name, s_suppkey::varchar x from supplier")
def aggregator_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregator's records, with nested fields before plain ones."""
    r = "named_struct('uid', 'u' || s_suppkey, 'reference', ' ', 'url', if(s_suppkey % 2 = 0, 'l' || s_suppkey, ''), 'link', 'w' || s_suppkey, 'address', s_name, 'app_state', 'Closed', 'start_date', '2026-06-05T00:00', 'location_x', s_suppkey, 'other_fields', named_struct('status', 'Open', 'agent_name', 'Agent'))"
    return family(spark, sf_dir, "aggregator", r, '{"records":{},"total":9}', "uid", "reference", "url", "address", "status", "date_received", "agent_name", "x")


@query("select s_nationkey, s_suppkey::varchar uid, 'R' || s_suppkey reference, s_name address, '2026-06-05' date_received from supplier")
def map_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return family(spark, sf_dir, "statmap", "named_struct('id', s_suppkey, 'name', 'R' || s_suppkey, 'address', s_name, 'receivedDate', '2026-06-05T09:00:00')", '{"records":{}}', "uid", "reference", "address", "date_received")


@query("select s_nationkey, 'i' || s_suppkey uid, 'R' || s_suppkey reference, s_name address, '2026-06-05' date_received, '2026-06-06' date_validated from supplier")
def salesforce_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records two return values deep, plain or prefixed field names."""
    r = "named_struct('Id', 'i' || s_suppkey, 'Name', 'R' || s_suppkey, 'arcusbuiltenv__Site_Address__c', s_name, 'Received_Date__c', '2026-06-05', 'Valid_Date__c', '06/06/2026')"
    return family(spark, sf_dir, "arcus", r, '{"actions":[{"state":"SUCCESS","returnValue":{"returnValue":{"records":{}}}}]}', "uid", "reference", "address", "date_received", "date_validated")


@query("select s_nationkey, 'i' || s_suppkey uid, 'i' || s_suppkey reference, 'Gates' description, '2026-06-05' date_validated from supplier")
def string_encoded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result that is JSON text within JSON; a record without a name is called by its id."""
    p = bodies(spark, sf_dir, "named_struct('Id', 'i' || s_suppkey, 'Hidden_Proposal__c', 'Gates', 'arcusbuiltenv__Valid_Date__c', '2026-06-05')", '{"records":{}}')
    p = p.select("s_nationkey", F.to_json(F.struct(F.col("body").alias("returnValue"))).alias("body"))
    return payloads.applications(p, "wiltshire", inner="$.returnValue").select("s_nationkey", "uid", "reference", "description", "date_validated")


@query("select s_nationkey, s_suppkey::varchar uid, 'R' || s_suppkey reference, s_name address, case when s_suppkey % 2 = 0 then '2026-06-05' else '2026-06-01' end date_received from supplier")
def agile_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = "named_struct('id', s_suppkey, 'reference', 'R' || s_suppkey, 'location', s_name, 'receivedDate', if(s_suppkey % 2 = 0, '2026-06-05T00:00:00Z', cast(null as string)), 'registrationDate', '2026-06-01')"
    return family(spark, sf_dir, "agile", r, '{"results":{}}', "uid", "reference", "address", "date_received")


@query("select s_nationkey, s_suppkey::varchar uid, s_name address, 'Granted' decision, '2026-06-05' date_received from supplier")
def related_address_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address in a related record comes before the plain one."""
    r = "named_struct('Id', s_suppkey, 'arcusbuilt__SiteAddress__r', named_struct('Name', s_name), 'arcusbuilt__Site_Address__c', 'other', 'arcusbuilt__Last_Decision__c', 'Granted', 'arcusbuilt__ReceivedDate__c', '2026-06-05')"
    return family(spark, sf_dir, "eastleigh", r, '{"records":{}}', "uid", "address", "decision", "date_received")


@query("select s_nationkey, 'N' || s_suppkey reference, 'W1' ward, 'P1' parish, 'https://d/' || s_suppkey docs_url, '2026-06-05' date_received from supplier")
def variant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = "named_struct('Name', 'N' || s_suppkey, 'arcusbuiltenv__Wards__c', 'W1', 'arcusbuiltenv__Parishes__c', 'P1', 'Documents_URL__c', 'https://d/' || s_suppkey, 'arcusbuiltenv__Registration_Date__c', '2026-06-05T00:00')"
    return family(spark, sf_dir, "carmarthenshire", r, '{"records":{}}', "reference", "ward", "parish", "docs_url", "date_received")


@query("select s_nationkey, 'S/' || s_suppkey uid, 'S/' || s_suppkey reference, 'https://s/' || s_suppkey url, 'Open' status, '2026-06-05' date_validated from supplier")
def plain_api_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = "named_struct('reference', 'S/' || s_suppkey, 'link', 'https://s/' || s_suppkey, 'status', 'Open', 'validDate', '05/06/2026')"
    return family(spark, sf_dir, "stratford", r, "{}", "uid", "reference", "url", "status", "date_validated")


@query("select c_custkey, 'V' || c_custkey uid, c_name address, '2026-06-05' date_received, '2026-06-06' date_validated, 'Applicant' applicant_name from customer")
def single_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body with one record."""
    r = F.expr("named_struct('planningData', named_struct('refval', 'V' || c_custkey, 'addressline', c_name, 'dateaprecv_text', '05/06/2026', 'dateapval_text', 'Sat 06 Jun 2026', 'appname', 'Applicant'))")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.to_json(r).alias("body"))
    return payloads.applications(c, "civica").select("c_custkey", "uid", "address", "date_received", "date_validated", "applicant_name")


@query("select s_nationkey, s_suppkey::varchar key_number, 'R' || s_suppkey reference, 'last' address from supplier")
def key_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key objects whose items are named by field and by label; the last of a name counts."""
    r = "named_struct('KeyNumber', s_suppkey, 'KeyText', 'R' || s_suppkey, 'Items', array(named_struct('FieldName', 'Address', 'Label', 'Site Address', 'Value', 'first'), named_struct('FieldName', cast(null as string), 'Label', 'Site Address', 'Value', 'last'), named_struct('FieldName', 'RefVal', 'Label', 'Ref', 'Value', 'R' || s_suppkey)))"
    p = payloads.key_objects(bodies(spark, sf_dir, r, '{"TotalRows":1,"KeyObjects":{}}'))
    return p.select("s_nationkey", "key_number", F.col("fields")["refval"].alias("reference"), F.col("fields")["site address"].alias("address"))


@query("select s_nationkey, s_suppkey, case when s_suppkey % 2 = 0 then 'invalid json' else 'error action' end reason from supplier where s_suppkey % 2 = 0 or s_suppkey % 3 = 0")
def payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that are no JSON and actions that report an error; empty results are none."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.expr("case when s_suppkey % 2 = 0 then '{\"a\": ' when s_suppkey % 3 = 0 then '{\"actions\":[{\"state\":\"ERROR\"}]}' else '{\"actions\":[{\"state\":\"SUCCESS\"}]}' end").alias("body"))
    return payloads.json_errors(s, "body").select("s_nationkey", "s_suppkey", "reason")


@query("select c_custkey k, i::int ordinal, c_custkey / 2 x, date '2022-10-03' + ((c_custkey % 300)::int) as \"day\", 't' || c_custkey || '-3' t, case when c_custkey % 50 = 0 then 'trailing bytes' end error from customer, (values (0), (1)) v(i) where c_custkey % 50 > 0 union all select c_custkey, -1, null, null, null, 'trailing bytes' from customer where c_custkey % 50 = 0")
def record_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary stream of two records for each customer, some with bytes left over."""
    from collections.abc import Iterator

    import pyarrow as pa

    def encode(it: Iterator) -> Iterator:
        for b in it:
            ks = b.column("c_custkey").to_pylist()
            rows = [[(1, 0, 1, i, k, 638_003_520_000_000_000 + (k % 300) * 864_000_000_000, 0, 0, k / 2, -0.5, [f"t{k}-{j}" for j in range(payloads.BINARY_TEXTS)]) for i in range(2)] for k in ks]
            yield pa.record_batch([pa.array(ks, pa.int64()), pa.array([payloads.encode_records(r) + b"x" * (k % 50 == 0) for k, r in zip(ks, rows)], pa.binary())], names=["k", "body"])

    p = table(spark, sf_dir, "customer").select("c_custkey").mapInArrow(encode, "k long, body binary")
    return payloads.binary_records(p, "k", "body").select("k", "ordinal", "x", dates.ticks_to_london_date(F.get("ticks", F.lit(0))).alias("day"), F.get("texts", F.lit(3)).alias("t"), "error")


@query("select p_partkey, p_size % 7 > 0 kept from part where p_size % 2 = 0")
def planning_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enforcement cases and records without a reference are left out."""
    p = table(spark, sf_dir, "part").withColumn("flags", F.array(F.when(F.col("p_size") % 2 == 0, 0).otherwise(1), F.lit(0), F.lit(0)))
    p = p.withColumn("reference", F.when(F.col("p_size") % 7 > 0, F.col("p_name")))
    r = payloads.planning_cases(p, F.get("flags", F.lit(0)) == 1, "reference")
    return r.select("p_partkey", (F.col("complete")).alias("kept"))


_SUPPLIER_DOC = "'<li><a href=\"getfile?id=' || s_suppkey || '\">Plan ' || s_suppkey || '</a></li>'"


@query("""select page_id, kind, url, title from (select page_id from pages), (values ('anchor', 'https://r.example/files/plan.pdf', 'Plan'), ('data', 'https://r.example/a/b/getfile?id=1', 'Get'),
 ('click', 'https://r.example/download/2', 'Open'), ('form', 'https://r.example/a/b/showimage', ''), ('frame', 'https://r.example/x.tiff', ''), ('anchor', 'https://r.example/a/b/searchresult?x', 'Documents')) v(kind, url, title)""")
def document_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all kinds of elements; site pages, repeated addresses and forms that post are left out."""
    body = "<a href='/files/plan.pdf'>Plan</a><a href='/files/plan.pdf'>again</a><a href='/privacy.pdf'>Privacy</a><button data-href='getfile?id=1'>Get</button><b onclick=\"go('/download/2')\">Open</b><form method='get' action='showimage'></form><form method='post' action='download'></form><iframe src='/x.tiff'></iframe><a href='searchresult?x'>Documents</a><a href='mailto:a@b.pdf'>m</a>"
    p = table(spark, sf_dir, "pages").select("page_id", F.lit(body).alias("html"))
    return html.document_links(html.nodes(p), base()).select("page_id", "kind", "url", "title")


@query("""select page_id, d dialect, n from (select page_id from pages), (values ('generic', 4::bigint), ('ocella', 3::bigint), ('idox', 1::bigint)) v(d, n)""")
def document_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of five links each dialect takes for documents."""
    links = ["/docview/1", "/attachment/2", "applicationDetails.do?document=1", "/documentviewer?x", "/about"]
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(*map(F.lit, links))).alias("href"))
    hit = lambda d: F.sum(urls.is_dialect_document("href", d).cast("long")).alias(d)
    g = p.groupBy("page_id").agg(hit("generic"), hit("ocella"), hit("idox"))
    return g.select("page_id", F.explode(F.create_map(*[x for d in ("generic", "ocella", "idox") for x in (F.lit(d), F.col(d))])).alias("dialect", "n"))


@query("select s_nationkey page_id, 'Plan ' || s_suppkey title, 'https://r.example/a/b/getfile?id=' || s_suppkey url, '2026-06-05' date_published, '512 KB' file_size, 'Plan' document_type, 'Front' description from supplier")
def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document tables: the cells beside a link tell date, size, type and description."""
    row = "'<tr><td>05/06/2026</td><td>Plan</td><td>512 KB</td><td>Front</td><td><a href=\"getfile?id=' || s_suppkey || '\">Plan ' || s_suppkey || '</a></td></tr>'"
    from registrum.plans.portal_queries import listing

    p = listing(spark, sf_dir, row, "'<table>'", "'</table>'")
    return D.table_documents(html.nodes(p), base(), "site").select("page_id", "title", "url", "date_published", "file_size", "document_type", "description")


@query("select s_nationkey page_id, 'View' title, 'https://r.example/a/b/download/' || s_suppkey url, 'Front ' || s_suppkey description from supplier")
def described_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands beside a document's link describes it."""
    from registrum.plans.portal_queries import listing

    p = listing(spark, sf_dir, "'<li><a href=\"download/' || s_suppkey || '\">View</a> Front ' || s_suppkey || '</li>'")
    return D.item_documents(html.nodes(p), base(), "generic").select("page_id", "title", "url", "description")


@query("select s_nationkey page_id, 'd' || s_suppkey || '.pdf' title, 'https://r.example/Document/GetFileBinary?module=p&recordNumber=' || s_suppkey || '&planID=' || s_suppkey || '&imageID=7&isPlan=' || (s_suppkey % 2 = 0) url from supplier")
def attribute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from registrum.plans.portal_queries import listing

    row = "'<tr data-module=\"p\" data-recordnumber=\"' || s_suppkey || '\" data-planid=\"' || s_suppkey || '.0\" data-imageid=\"7\" data-storedindatabase=\"' || (s_suppkey % 2 = 0) || '\" data-filename=\"x/d' || s_suppkey || '.pdf\"></tr><tr data-module=\"p\"></tr>'"
    p = listing(spark, sf_dir, row, "'<table>'", "'</table>'")
    return D.attribute_rows(html.nodes(p), base()).select("page_id", "title", "url")


@query("select s_nationkey, 'Plan ' || s_suppkey title, 'https://r.example/a/Document/ViewDocument?id=g' || s_suppkey url from supplier")
def script_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a model in a page's script."""
    p = bodies(spark, sf_dir, "named_struct('Guid', 'g' || s_suppkey, 'Doc_Ref2', '', 'Doc_Type', 'Plan ' || s_suppkey)", '<script>var model = {"Rows":{}};</script>')
    return D.model_rows(p, "body", F.lit("https://r.example/a/b/c"), "s_nationkey").select("s_nationkey", "title", "url")


@query("select s_nationkey page_id, case when s_suppkey % 2 = 0 then 'Plan' else 'OpenSearchDocument' end title, 'https://r.example/OnlineDisplayDocument/OpenSearchDocument?displaysearchdocument=' || s_suppkey url, 'https://r.example/list?applicationNumber=E' || s_nationkey || '&currentPageIndex=0&IsDatePublishSortedDescending=false&pageSize=1000' endpoint from supplier")
def store_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's document list: the address to ask, and the links of the fragment it gives."""
    from registrum.plans.portal_queries import listing

    p = listing(spark, sf_dir, "'<a href=\"/OnlineDisplayDocument/OpenSearchDocument?displaysearchdocument=' || s_suppkey || '\">' || if(s_suppkey % 2 = 0, 'Plan', '') || '</a><a href=\"/other\">x</a>'")
    page = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page_id")).distinct().withColumn("html", F.expr("'<div id=\"divDisplayDocumentsUrl\" data-url=\"/list\"></div><span id=\"spnApplicationId\"> E' || page_id || ' </span>'"))
    ask = D.store_endpoint(html.nodes(page), base())
    return D.fragment_documents(html.nodes(p), base()).join(ask, "page_id").select("page_id", "title", "url", "endpoint")


@query("select s_nationkey, case when s_suppkey % 2 = 0 then 'Plan' else 'Document ' || s_suppkey end title, 'https://c.example/api/Doc/pagestream?cd=download&pdf=false&docno=' || s_suppkey || '&filename=' || case when s_suppkey % 2 = 0 then 'Plan' else 'Document+' || s_suppkey end url, '2026-06-05' date_published, 'Maps' description from supplier where s_suppkey > 0")
def stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bodies(spark, sf_dir, "named_struct('DocNo', s_suppkey, 'Title', if(s_suppkey % 2 = 0, 'Plan', ''), 'DocDate', '2026-06-05T00:00:00', 'DocCategory', 'Maps', 'TypeCode', 'P')", '{"CompleteDocument":{}}')
    return D.stream_documents(p, "body", F.lit("https://c.example/api/"), base(), "s_nationkey").select("s_nationkey", "title", "url", "date_published", "description")


@query("select s_nationkey, 'Site plan' title, 'https://g.example/api/application/document/C1/h%2F' || s_suppkey url, 'Site plan' document_type, '2026-06-05' date_published from supplier where s_suppkey % 3 > 0")
def hashed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bodies(spark, sf_dir, "named_struct('documentHash', if(s_suppkey % 3 > 0, 'h/' || s_suppkey, cast(null as string)), 'name', ' ', 'mediaDescription', 'Site plan', 'receivedDate', '2026-06-05T01:00')")
    return D.hashed_documents(p, "body", F.lit("https://g.example/api/"), F.lit("C1"), "s_nationkey").select("s_nationkey", "title", "url", "document_type", "date_published")


@query("select s_nationkey, case when s_suppkey % 2 = 0 then 'Plan' else 'Document' end title, 'https://f.example/files/' || s_suppkey url from supplier")
def lookup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bodies(spark, sf_dir, "named_struct('URL', '/files/' || s_suppkey, 'display', if(s_suppkey % 2 = 0, 'Plan', ''))")
    return D.lookup_documents(p, "body", F.lit("https://f.example/x"), "s_nationkey").select("s_nationkey", "title", "url")


@query("select s_nationkey, 'R' || s_suppkey || '.pdf' title, 'https://h.example/pr/sfc/servlet.shepherd/version/download/v' || s_suppkey url, (s_suppkey * 100)::varchar file_size from supplier")
def version_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = "named_struct('Id', 'v' || s_suppkey, 'Title', 'R' || s_suppkey, 'FileExtension', 'PDF', 'ContentSize', cast(s_suppkey * 100 as string))"
    return D.content_versions(bodies(spark, sf_dir, r), "body", F.lit("https://h.example/pr/s/detail/1"), "s_nationkey").select("s_nationkey", "title", "url", "file_size")


@query("select s_nationkey, 'https://r.example/a/b/getfile?id=' || s_suppkey url, min(part)::int part from supplier, (values (0), (1), (3)) v(part) where part = 1 or (part = 0 and s_acctbal > 0) or (part = 3 and s_nationkey > 10) group by s_nationkey, s_suppkey")
def enriched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of several sources in order: the first of an address counts, and only downloadable ones stay."""
    s = table(spark, sf_dir, "supplier")
    doc = lambda d, name: D.shaped(d.withColumn("ordinal", F.col("s_suppkey")), "s_nationkey", title=F.lit(name), url=F.concat(F.lit("https://r.example/a/b/getfile?id="), F.col("s_suppkey").cast("string")))
    old = D.shaped(s.withColumn("ordinal", F.col("s_suppkey")), "s_nationkey", title=F.lit("Existing plan"), url=F.concat(F.lit("https://r.example/old.pdf?"), F.col("s_suppkey").cast("string")))
    parts = [doc(s.filter("s_acctbal > 0"), "first"), doc(s, "second"), old, doc(s.filter("s_nationkey > 10"), "last")]
    return D.all_documents(parts, "s_nationkey").select("s_nationkey", "url", "part")


@query("select p_partkey, p_size % 4 in (1, 3) downloadable, p_size % 4 = 2 excluded, p_size % 4 = 3 site from part")
def document_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to fetch, existing plans and programs, and pages of the site."""
    kind = F.col("p_size") % 4
    href = F.when(kind == 1, "https://x/files/getfile?id=1").when(kind == 2, "https://x/existing%20plan.pdf").when(kind == 3, "https://x/cookie-policy.pdf").otherwise("https://x/page")
    p = table(spark, sf_dir, "part").select("p_partkey", href.alias("u"))
    none = F.lit(None).cast("string")
    t = urls.document_text(none, F.col("u"), none, none, none)
    return p.select("p_partkey", urls.downloadable_document(none, F.col("u"), none, none, none).alias("downloadable"), urls.excluded_document(t, F.col("u")).alias("excluded"), urls.is_site_document("u").alias("site"))


@query("select p_partkey, case when p_size % 3 = 0 then 'plan ' || p_partkey || '.pdf' when p_size % 3 = 1 then 'Site ' || p_partkey || '.docx' else 'n' || p_partkey || '.bin' end name, case when p_size % 3 = 0 then 'plan ' || p_partkey || '.pdf' end header from part")
def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names: the header's, the title's, the address's, with an extension."""
    n = F.col("p_partkey").cast("string")
    k = F.col("p_size") % 3
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, F.concat(F.lit('attachment; filename="x/plan%20'), n, F.lit('.pdf"'))).alias("h"), F.when(k == 1, F.concat(F.lit("Site "), n)).alias("t"), F.concat(F.lit("https://x/d?name=n"), n).alias("u"), F.when(k == 1, ".docx").otherwise(".exe").alias("e"))
    h = files.name_from_headers(F.col("h"))
    return p.select("p_partkey", D.file_name(h, F.col("t"), F.col("u"), F.lit("doc"), F.col("e")).alias("name"), h.alias("header"))


@query("select c_custkey, case c_custkey % 6 when 0 then '.pdf' when 1 then '.docx' when 2 then '.png' when 3 then '.csv' when 4 then '.dwg' else '.bin' end extension, c_custkey % 6 < 5 \"real\" from customer")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of a whole table typed by bytes, content type and name."""
    k = F.col("c_custkey") % 6
    name = F.col("c_name").cast("binary")
    head = F.when(k == 0, F.unhex(F.lit("255044462D"))).when(k == 1, F.unhex(F.lit("504B0304"))).when(k == 2, F.unhex(F.lit("89504E470D0A1A0A"))).when(k == 5, F.unhex(F.lit("4D5A"))).otherwise(F.unhex(F.lit("")))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(head, name).alias("payload"), F.when(k == 3, "text/csv; charset=utf-8").otherwise("").alias("kind"), F.when(k == 4, F.concat(F.lit("http://u/plan%20"), F.col("c_custkey").cast("string"), F.lit(".DWG?x"))).otherwise("http://u/a").alias("url"))
    p, t, u = F.col("payload"), F.col("kind"), F.col("url")
    return c.select("c_custkey", files.extension(F.lit(None).cast("string"), u, t, p).alias("extension"), files.is_real_file(p, t, u).alias("real"))


@query("select page_id, page_id % 3 = 0 explicit, page_id % 3 = 1 busy from pages")
def empty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that say they found nothing, and busy ones with a bare result table."""
    body = F.expr("case page_id % 3 when 0 then '<div>No  records found</div>' when 1 then '<div>The website is busy<table><tr><th>Application Number</th></tr></table></div>' else html end")
    p = table(spark, sf_dir, "pages").select("page_id", body.alias("html"))
    q = L.page_quality(html.nodes(p))
    return p.select("page_id").join(q, "page_id", "left").select("page_id", F.coalesce(F.col("quality") == "explicit_empty", F.lit(False)).alias("explicit"), F.coalesce(F.col("quality") == "busy_empty", F.lit(False)).alias("busy"))


@query("select page_id, 'https://r.example/next?' || page_id url, case when page_id % 2 = 0 then '/agree' end disclaimer from pages")
def refresh_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("'<meta http-equiv=\"Refresh\" content=\"0; URL=https://r.example/next?' || page_id || '\">' || if(page_id % 2 = 0, '<form action=\"/agree\">Please read the Disclaimer</form>', '')")
    p = table(spark, sf_dir, "pages").select("page_id", body.alias("html"))
    return html.refresh_target(html.nodes(p))


@query("select page_id, 'https://c.example/api/' || page_id api_url, case when page_id % 2 = 0 then 'GF' else 'PL' end ref_type, '/viewer' viewer, 'sandbox-publish://AF-' || page_id form_uri, '/lists/getDocumentList?' || page_id document_list, '/ctx' context, 'r' || page_id root, 'fw' || page_id fwuid, case when page_id % 3 = 0 then 'DEV' else 'PROD' end \"mode\" from pages")
def script_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that pages keep in scripts and script addresses."""
    body = F.expr("""'Civica.APIUrl = "https://c.example/api/' || page_id || '"; Civica.KeyObjectViewerUrl="/viewer";' || if(page_id % 2 = 0, '{"PlanningApplicationRefType" : "GF"}', 'x = {RefType: ''PL''}') || '{"publish-uri":"sandbox-publish:\\\\/\\\\/AF-' || page_id || '"} {"url" : "/lists/getDocumentList?' || page_id || '"} var ctx = ''/ctx''; var APIroot = "r' || page_id || '"; src="/s/sfsites/l/bad/inline.js" src="/s/sfsites/l/' || url_encode('{"fwuid":"fw' || page_id || '","loaded":{"a":"b"}' || if(page_id % 3 = 0, ',"mode":"DEV"', '') || '}') || '/bootstrap.js"'""")
    p = table(spark, sf_dir, "pages").select("page_id", body.alias("h"))
    s, b = html.script_strings(F.col("h")), html.boot_context(F.col("h"))
    return p.select("page_id", s.alias("s"), html.js_string(F.col("h"), "APIroot").alias("root"), b.alias("b")).select("page_id", "s.*", "root", "b.fwuid", "b.mode")


@query("select s_nationkey page_id, 'G' || s_suppkey uid, '26/' || lpad(s_suppkey::varchar, 5, '0') reference, 'https://r.example/a/b/view?id=G' || s_suppkey url, 'row' context from supplier")
def anchor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the text around them; the first of a uid counts."""
    from registrum.plans.portal_queries import listing

    row = "'<tr><td><a href=\"view?id=G' || s_suppkey || '\">26/' || lpad(s_suppkey::STRING, 5, '0') || '</a></td><td>row</td></tr><tr><td><a href=\"view?id=G' || s_suppkey || '\">again</a></td></tr>'"
    r = L.anchor_listing(html.containers(html.nodes(listing(spark, sf_dir, row, "'<table>'", "'</table>'"))), base(), ["id"])
    return r.select("page_id", "uid", "reference", "url", F.trim(F.replace("context", F.col("reference"), F.lit(""))).alias("context"))


@query("select s_nationkey, '26/' || lpad(s_suppkey::varchar, 5, '0') || '/FUL' reference, s_name address, 'Gates ' || s_suppkey description from supplier")
def other_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second dialect of records in running text: each ends where the next begins."""
    line = F.expr("'26/' || lpad(s_suppkey::STRING, 5, '0') || '/FUL Address: ' || s_name || ' Proposal: Gates ' || s_suppkey || ' '")
    p = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(line), "").alias("t"))
    return L.free_text_records(p, "t", "astun").select("s_nationkey", "reference", "address", "description")


@query("select c_custkey, 'A' || c_custkey app_no, c_name site_address, 'Gates' description, '05/06/2026' received_date, null::varchar decision_sent_date, '06/06/2026' decision_date from customer")
def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that run to the next label."""
    c = table(spark, sf_dir, "customer").select("c_custkey", L.labelled_text(F.expr("'App. No. A' || c_custkey || ' Site Address: ' || c_name || ' Description: Gates Received Date: 05/06/2026 Decision Date: 06/06/2026'")).alias("f"))
    return c.select("c_custkey", "f.*")


@query("select p_partkey, '05/06/2026' date_published, (p_size) || ' KB' file_size, 'Plan' document_type, p_name description from part")
def document_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", L.document_cells(F.array(F.lit("Link"), "p_name", F.concat(F.col("p_size").cast("string"), F.lit(" KB")), F.lit("Plan"), F.lit("05/06/2026")), F.lit("row"), F.lit("Link")).alias("c"))
    return p.select("p_partkey", "c.*")


@query("select c_custkey, c_name || ' & Sons <Ltd> é' whole, c_name || ' & Sons' title from customer")
def unescaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All HTML entities, named and numbered."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" &amp; Sons &lt;Ltd&gt; &eacute;")).alias("t"))
    return c.select("c_custkey", text.unescape("t").alias("whole"), text.clean_text(F.split_part("t", F.lit(" &lt;"), F.lit(1))).alias("title"))


@query("select s_nationkey page_id, case when s_suppkey % 2 = 0 then 'Front ' || s_suppkey else 'Drawing' end title, 'https://r.example/a/b/index.html?fa=downloadDocument&id=' || s_suppkey url, 'Drawing' document_type from supplier")
def field_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose fields carry their names."""
    from registrum.plans.portal_queries import listing

    row = "'<tr><td data-field-name=\"description\">' || if(s_suppkey % 2 = 0, 'Front ' || s_suppkey, '') || '</td><td><b data-field-name=\"document_type\"> Drawing </b></td><td><a href=\"index.html?fa=downloadDocument&amp;id=' || s_suppkey || '\">get</a></td></tr>'"
    return D.field_documents(html.stored_nodes(listing(spark, sf_dir, row, "'<table>'", "'</table>'")), base()).select("page_id", "title", "url", "document_type")


@query("select s_nationkey, 'https://r.example/plan/' || s_suppkey url from supplier union all select s_nationkey, 'https://r.example/nested/' || s_suppkey || '/' || k from supplier, (values (1), (2)) v(k) where s_acctbal > 0 union all select s_nationkey, 'https://r.example/RunThirdPartySearch?x=' || s_suppkey from supplier where s_acctbal <= 0")
def bridged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridges to other lists: those that lead to documents give way to them."""
    s = table(spark, sf_dir, "supplier").withColumn("ordinal", F.col("s_suppkey"))
    n = F.col("s_suppkey").cast("string")
    bridge = F.concat(F.lit("https://r.example/RunThirdPartySearch?x="), n)
    docs = D.shaped(s, "s_nationkey", title=F.lit("Plan"), url=F.concat(F.lit("https://r.example/plan/"), n)).unionByName(D.shaped(s, "s_nationkey", title=F.lit("More"), url=bridge))
    more = s.filter("s_acctbal > 0").withColumns({"bridge_url": bridge, "k": F.explode(F.array(F.lit(1), F.lit(2)))}).withColumn("ordinal", F.col("k"))
    nested = more.select("s_nationkey", "bridge_url", "ordinal", *[F.concat(F.lit("https://r.example/nested/"), n, F.lit("/"), F.col("k").cast("string")).alias(c) if c == "url" else F.lit("Nested").alias(c) for c in D.DOCUMENT])
    return D.expand_bridges(docs, nested, "s_nationkey").select("s_nationkey", "url")


def _stored_by_day(spark: SparkSession, sf_dir: str, family: str, record: str, wrap: str) -> str:
    """Orders as a family's payloads, a file a month; each line of a file's text is a part of one JSON body."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.trunc(F.col("o_orderdate").cast("date"), "month"))
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.to_json(F.expr(record)).alias("r")))), lambda x: x["r"]), ",\n")
    body = o.groupBy("day").agg(part.alias("r")).select("day", F.lit(family).alias("family"), F.replace(F.lit(wrap), F.lit("{}"), F.concat(F.lit("["), F.col("r"), F.lit("]"))).alias("value"))
    path = scratch_path(spark, "payloads")
    body.repartition("day").write.partitionBy("family", "day").text(path)
    return path


@query("select o_orderkey::varchar uid, 'N' || o_orderkey reference, o_orderpriority || ' Road AB1 2CD' address, strftime(o_orderdate, '%Y-%m-%d') date_received, 'AB1 2CD' postcode, date_trunc('month', o_orderdate)::date as \"day\" from orders where date_trunc('month', o_orderdate) between date '1996-01-01' and date '1998-12-31'")
def payload_data_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored payloads of a built-in family read by the data source; only the window's files are opened."""
    record = "named_struct('id', o_orderkey, 'name', 'N' || o_orderkey, 'address', ' ' || o_orderpriority || ' Road AB1 2CD', 'receivedDate', date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\"))"
    path = _stored_by_day(spark, sf_dir, "statmap", record, '{"records":{}}')
    return payload_source.applications(spark, path, "statmap", "1996-01-01", "1998-12-31").select("uid", "reference", "address", "date_received", "postcode", "day")


@query("select 'A/' || o_orderkey uid, case when o_orderstatus = 'F' then 'F' || o_custkey else 'A/' || o_orderkey end reference, o_orderpriority address, strftime(o_orderdate, '%Y-%m-%d') date_validated from orders where o_totalprice > 200000")
def registered_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored payloads of a family that the user has registered; records have nested fields and fields in order of preference."""
    payloads.register_family("district", "$.result[0].cases", {"uid": ["case.no"], "reference": ["case.ref", "case.no"], "address": ["site.street"], "date_validated": ["valid"], "description": ["price"]})
    record = "named_struct('case', named_struct('no', 'A/' || o_orderkey, 'ref', if(o_orderstatus = 'F', 'F' || o_custkey, ' ')), 'site', named_struct('street', o_orderpriority), 'valid', date_format(o_orderdate, 'dd/MM/yyyy'), 'price', o_totalprice)"
    path = _stored_by_day(spark, sf_dir, "district", record, '{"result":[{"cases":{}}]}')
    d = payload_source.applications(spark, path, "district").filter(F.col("description").cast("double") > 200000)
    return d.select("uid", "reference", "address", "date_validated")

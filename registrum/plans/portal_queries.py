"""Registered queries of the portal families: listings and details made of suppliers and customers, read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.functions import dates
from registrum.plans.registered import query, table
from registrum.sources import html, payloads
from registrum.sources import portals as P

def page() -> Column:
    return F.lit("https://r.example/a/list.do?x=1")



def listing(spark: SparkSession, sf_dir: str, item: str, before: str = "''", after: str = "''") -> DataFrame:
    """A page for each nation, with an item for each of its suppliers in order."""
    s = table(spark, sf_dir, "supplier").withColumn("item", F.expr(item))
    g = s.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "item"))), lambda x: x["item"]), "").alias("items"), F.count("*").alias("n"))
    return g.select(F.col("s_nationkey").alias("page_id"), F.concat(F.expr(before.replace("s_nationkey", "page_id")) if "page_id" in before else F.expr(before), F.col("items"), F.expr(after)).alias("html"))


_IDOX = """'<li class="x searchresult"><a href="applicationDetails.do?activeTab=summary&amp;keyVal=K' || s_suppkey || '">' || case when s_suppkey % 3 = 0 then 'Gates ' || s_name else 'View' end || '</a>'
|| case when s_suppkey % 4 = 0 then '' else '<p class="address">' || s_suppkey || ' High Road, AB1 ' || (s_suppkey % 10) || 'CD</p>' end
|| '<p class="metaInfo">Ref. No: 26/' || lpad(s_suppkey::STRING, 5, '0') || '/FUL | ' || case when s_suppkey % 5 = 0 then '' else 'Received: Fri 05 Jun 2026 | Validated: 06/06/2026' end || '</p>'
|| case when s_suppkey % 2 = 0 then '<span class="badge-status">Status <b class="value"> Pending </b></span>' else '' end || '</li>'"""


@query("""select s_nationkey page_id, 'K' || s_suppkey uid, '26/' || lpad(s_suppkey::varchar, 5, '0') || '/FUL' reference, 'https://r.example/a/applicationDetails.do?activeTab=summary&keyVal=K' || s_suppkey url,
  case when s_suppkey % 4 > 0 then s_suppkey || ' High Road, AB1 ' || (s_suppkey % 10) || 'CD' end address, case when s_suppkey % 3 = 0 then 'Gates ' || s_name else 'View' end description,
  case when s_suppkey % 2 = 0 then 'Pending' end status, case when s_suppkey % 5 > 0 then '2026-06-05' end date_received, case when s_suppkey % 5 > 0 then '2026-06-06' end date_validated,
  s_suppkey % 5 > 0 and s_suppkey % 4 > 0 detail_complete, case when s_suppkey % 4 > 0 then 'AB1 ' || (s_suppkey % 10) || 'CD' end postcode from supplier""")
def idox_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result items; a repeated link of an item comes once. Addresses that only the row's text has are left to idox_rows."""
    p = listing(spark, sf_dir, _IDOX + " || '<a href=\"applicationDetails.do?keyVal=K' || s_suppkey || '\">again</a>'")
    r = P.idox_listing(html.stored_nodes(p), page())
    own = F.col("address").rlike("High Road")
    return r.withColumns({"address": F.when(own, F.col("address")), "detail_complete": F.col("detail_complete") & own})


@query("select s_nationkey page_id, 'K' || s_suppkey uid, '26/' || lpad(s_suppkey::varchar, 5, '0') || '/FUL' reference, s_suppkey || ' High Road' address from supplier")
def idox_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows: the address is the row's text less reference and labels."""
    p = listing(spark, sf_dir, "'<tr><td>Application: <a href=\"/o/applicationDetails.do?keyVal=K' || s_suppkey || '\">26/' || lpad(s_suppkey::STRING, 5, '0') || '/FUL</a></td><td>' || s_suppkey || ' High Road</td><td>Status:</td></tr>'", "'<table>'", "'</table>'")
    return P.idox_listing(html.stored_nodes(p), page()).select("page_id", "uid", "reference", "address")


@query("select c_custkey, case when c_custkey % 3 = 0 then 'T' || c_custkey when c_custkey % 3 = 1 then 'U' || c_custkey else 'R/' || c_custkey end uid, 'R/' || c_custkey reference, c_name || ' Road' address, 'second' description, '2026-06-05' date_received, case when c_custkey % 2 = 0 then 'EF2 3GH' end postcode, c_custkey % 2 = 1 single from customer")
def idox_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail pages: the last value of a label wins, hidden inputs fill in, tokens are left out; which pages are a single summary."""
    body = """'<title>' || case when c_custkey % 2 = 1 then 'Application  Summary' else 'Documents' end || '</title><table><tr><th>Reference</th><td>R/' || c_custkey || '</td></tr><tr><th>Proposal</th><td>first</td></tr><tr><th>Proposal</th><td>second</td></tr><tr><th>Address</th><td>' || c_name || ' Road</td></tr><tr><th>Received</th><td>Fri 05 Jun 2026</td></tr></table>'
    || case when c_custkey % 3 = 0 then '<input type="hidden" name="caseTechnicalKey" value="T' || c_custkey || '">' else '' end || '<input type="hidden" name="csrfToken" value="x"><input type="hidden" name="_postcode" value="no">' || case when c_custkey % 2 = 0 then '<input type="hidden" name="postcode" value="ef23gh">' else '' end"""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.expr(body).alias("html"))
    t = html.stored_trees(c)
    url = F.expr("if(page_id % 3 = 1, 'https://r.example/applicationDetails.do?keyVal=U' || page_id, 'https://r.example/x')")
    single = html.single_summary(html.spread(t)).withColumn("single", F.lit(True))
    d = P.idox_detail(t, url).join(single, "page_id", "left")
    return d.select(F.col("page_id").alias("c_custkey"), "uid", "reference", "address", "description", "date_received", "postcode", F.coalesce("single", F.lit(False)).alias("single"))


@query("select s_nationkey page_id, 2 + k as page, k::int turn from (select distinct s_nationkey from supplier), (values (1), (2), (3)) v(k)")
def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paging links, each once, in the order of their numbers."""
    p = listing(spark, sf_dir, "''", "'<a href=\"?action=page&searchCriteria.page=5\">5</a><a href=\"?action=page&page=3\">3</a><a href=\"?action=page&page=4\">4</a><a href=\"?action=page&page=4\">next</a><a href=\"?action=first\">first</a>'")
    return html.next_pages(html.nodes(p)).select("page_id", "page", "turn")


@query("select c_custkey page_id, case when c_custkey % 2 = 0 then 'D' || c_custkey else 'R/' || c_custkey end uid, 'R/' || c_custkey reference, c_name address, 'by class' description, 'W' || c_nationkey ward, case when c_custkey % 3 = 0 then 'next ' || c_custkey end status from customer")
def generic_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields from rows, class labels and running text, in this order of trust."""
    body = """'<div id="x"><table><tr><td>Application No.</td><td>R/' || c_custkey || '</td></tr></table><span class="fieldLabel">Description</span><b>by class</b><p class="LABEL">Address</p><p>' || c_name || '</p>'
    || '<h3>Ward</h3><i>View map</i><i>Description</i><i>W' || c_nationkey || '</i>' || case when c_custkey % 3 = 0 then '<em>Status</em><u>next ' || c_custkey || '</u>' else '' end || '</div>'"""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.expr(body).alias("html"))
    url = F.expr("if(page_id % 2 = 0, 'https://r.example/view?id=D' || page_id, 'https://r.example/')")
    t = html.stored_trees(c)
    return P.generic_detail(t, html.text_pieces(t), url, F.lit(None).cast("string")).select("page_id", "uid", "reference", "address", "description", "ward", "status")


@query("select c_custkey, case c_custkey % 4 when 0 then '26/00001/FUL' when 1 then 'F' || c_custkey when 2 then 'M/' || c_custkey else '25/12345' end reference, c_name address, '2026-06-05' date_received from customer")
def form_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference: mapped, else the listing's, else in the listing's text, else in any value."""
    body = "'<table><tr><td>Site address</td><td>' || c_name || '</td></tr>' || case c_custkey % 4 when 2 then '<tr><td>Application Reference</td><td>M/' || c_custkey || '</td></tr>' when 3 then '<tr><td>Notes</td><td>see 25/12345 too</td></tr>' else '' end || '<tr><td>Received date</td><td>05/06/2026</td></tr></table>'"
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr(body).alias("html"))
    p = html.labelled_pairs(html.trees(c, "c_custkey"), "c_custkey")
    n = F.col("c_custkey")
    return P.form_fields(p, F.when(n % 4 == 0, "see 26/00001/FUL"), F.when(n % 4 == 1, F.concat(F.lit("F"), n.cast("string"))), F.lit("u"), "c_custkey").select("c_custkey", "reference", "address", "date_received")


_ATRIUM_ROW = "'<tr><td><a href=\"/Planning/Display/A%2F' || s_suppkey || '\">A/' || s_suppkey || '</a></td><td>x</td><td>' || s_name || '</td><td>Gates ' || s_suppkey || '</td><td>05/06/2026</td><td></td><td>' || case when s_suppkey % 2 = 0 then 'Decided - Granted' else 'Open' end || '</td></tr>'"


@query("select s_nationkey page_id, 'A/' || s_suppkey uid, 'A/' || s_suppkey reference, 'https://r.example/Planning/Display/A%2F' || s_suppkey url, s_name address, 'Gates ' || s_suppkey description, case when s_suppkey % 2 = 0 then 'Decided' else 'Open' end status, case when s_suppkey % 2 = 0 then 'Granted' end decision, '2026-06-05' date_validated from supplier")
def atrium_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by position; status and decision share a cell."""
    p = listing(spark, sf_dir, _ATRIUM_ROW, "'<table>'", "'</table>'")
    return P.atrium_listing(html.stored_nodes(p), page()).drop("postcode")


_ATRIUM_HEADED = "'<tr><td><span class=\"mobile-heading\">Application No:</span><a href=\"/planning/display?applicationNumber=B' || s_suppkey || '\">Application No. B/' || s_suppkey || '</a></td><td><div class=\"mobile-heading\">Location</div> ' || s_name || ' </td><td><p class=\"mobile-heading\">Proposal</p>Gates</td><td><i class=\"mobile-heading\">Status</i>Open</td><td><i class=\"mobile-heading\">Date</i>05/06/2026</td></tr>'"


@query("select s_nationkey page_id, 'B' || s_suppkey uid, 'B/' || s_suppkey reference, s_name address, 'Gates' description, 'Open' status, '2026-06-05' date_validated from supplier")
def atrium_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that name themselves for small screens."""
    p = listing(spark, sf_dir, _ATRIUM_HEADED, "'<table>'", "'</table>'")
    return P.atrium_listing(html.stored_nodes(p), page()).select("page_id", "uid", "reference", "address", "description", "status", "date_validated")


@query("select s_nationkey page_id, 'C' || s_suppkey uid, 'C/' || s_suppkey reference, s_name || ' Lane' address, '2026-06-05' date_validated from supplier")
def atrium_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards: the heading has the reference, the link the address, the text a date."""
    card = "'<div class=\"results__item\"><h2>Application Number: C/' || s_suppkey || '</h2><a href=\"/Planning/Display/C' || s_suppkey || '\">' || s_name || ' Lane</a><p>Valid 05/06/2026, then 07/06/2026</p></div>'"
    return P.atrium_listing(html.stored_nodes(listing(spark, sf_dir, card)), page()).select("page_id", "uid", "reference", "address", "date_validated")


@query("select s_nationkey page_id, case when count(*) > 3 then true else false end more, greatest(least(count(*), 1000), 250)::int ask from supplier group by s_nationkey")
def page_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that report more cases than the three they show."""
    p = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    c = P.page_cap(F.concat(F.lit("Planning (2) Planning ("), F.col("n").cast("string"), F.lit(")")), F.lit(3))
    return p.select(F.col("s_nationkey").alias("page_id"), c["more"].alias("more"), c["ask"].alias("ask"))


_OCELLA = "'<tr><td><a href=\"/detail?id=O' || s_suppkey || '\">26/' || lpad(s_suppkey::STRING, 4, '0') || '/F</a></td><td>' || s_name || '</td><td>Gates</td>' || case s_suppkey % 4 when 0 then '<td>05-06-2026</td><td>Open</td>' when 1 then '<td>05/06/26</td>' when 2 then '<td>Closed</td>' else '' end || '</tr>'"


@query("select s_nationkey page_id, 'O' || s_suppkey uid, '26/' || lpad(s_suppkey::varchar, 4, '0') || '/F' reference, s_name address, 'Gates' description, case s_suppkey % 4 when 0 then 'Open' when 2 then 'Closed' end status, case when s_suppkey % 4 < 2 then '2026-06-05' end date_received from supplier")
def ocella_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three, four and five cells."""
    p = listing(spark, sf_dir, _OCELLA, "'<table>'", "'</table>'")
    return P.ocella_listing(html.nodes(p), page(), ["reference", "id"]).select("page_id", "uid", "reference", "address", "description", "status", "date_received")


@query("select p_partkey, case when p_size % 2 = 0 then p_size end shown, case when p_size % 2 = 0 then p_partkey::int end total from part")
def result_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps that result pages report in their text."""
    t = F.expr("if(p_size % 2 = 0, 'The first ' || p_size || ' results shown,  there are ' || p_partkey || ' in total.', p_size || ' results')")
    c = P.ocella_cap(t)
    return table(spark, sf_dir, "part").select("p_partkey", c["shown"].alias("shown"), c["total"].alias("total"))


@query("""with p as (select s_nationkey register, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) k from supplier)
select register, 'P' || s_suppkey uid, case when s_suppkey % 2 = 0 then 'N/26/' || lpad(s_suppkey::varchar, 4, '0') else '26/' || lpad(s_suppkey::varchar, 4, '0') end reference, s_suppkey || ' Mill Lane' address, '2026-06-01' date_received, true date_inferred from p where k <= 3""")
def northgate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two result pages a register, cut at the total that the first reports; dates are inferred from the window."""
    row = "'<tr><td><a href=\"StdDetails.aspx?PARAM0=P' || s_suppkey || '\">' || case when s_suppkey % 2 = 0 then 'N/26/' else '26/' end || lpad(s_suppkey::STRING, 4, '0') || '</a></td><td>' || s_suppkey || ' Mill Lane</td></tr>'"
    p = listing(spark, sf_dir, row, "'<p>Records 1 to 3 of 3</p><a href=\"/Home.aspx?PARAM0=\">home</a><table>'", "'</table>'")
    pages = p.select((F.col("page_id") * 2).alias("page_id"), F.col("page_id").alias("register"), F.lit(1).alias("turn"), "html").unionByName(p.select((F.col("page_id") * 2 + 1).alias("page_id"), F.col("page_id").alias("register"), F.lit(2).alias("turn"), "html"))
    r = P.northgate_listing(pages.withColumn("url", F.lit("https://n.example/x/StdResults.aspx")), html.stored_nodes(pages), ["PARAM0"], "2026-06-01")
    return r.select("register", "uid", "reference", "address", "date_received", "date_inferred")


@query("select s_nationkey page_id, 'https://r.example/a/stdresults.aspx?p=' || k canonical from (select distinct s_nationkey from supplier), (values (2), (3)) v(k)")
def northgate_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paging links that differ in case and spaces are one."""
    p = listing(spark, sf_dir, "''", "'<a href=\"StdResults.aspx?p=2\">2</a><a href=\"STDRESULTS.aspx? p =2\">2</a><a href=\"StdResults.aspx?P=3\">3</a><a href=\"StdResults.aspx?q=3\">x</a>'")
    return P.northgate_pages(html.nodes(p), page()).select("page_id", "canonical")


@query("""with s as (select s_nationkey register, s_suppkey, s_name, row_number() over (partition by s_nationkey order by s_suppkey) k from supplier)
select register, (case when k <= 2 then 1 else 2 end)::int turn, 'T/' || s_suppkey reference, s_name address, case when s_suppkey % 2 = 0 then '2026-06-05' else '2026-06-01' end date_received, s_suppkey % 2 = 1 date_inferred from s""")
def tascomi_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered result pages: two rows, the rest, the first two again, and what follows that is not read."""
    s = table(spark, sf_dir, "supplier")
    cell = F.expr("'<tr><td>' || case when s_suppkey % 3 = 0 then 'T/' else 't/' end || s_suppkey || '</td><td>' || s_name || '</td><td>' || case when s_suppkey % 2 = 0 then '05/06/2026' else '' end || '</td></tr>'")
    again = F.expr("'<tr><td>T/' || s_suppkey || '</td><td>again</td><td></td></tr>'")
    late = F.expr("'<tr><td>Z/' || s_suppkey || '</td><td>late</td><td></td></tr>'")
    g = s.groupBy(F.col("s_nationkey").alias("register")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", cell.alias("c"), again.alias("d"), late.alias("e")))).alias("r"))
    cut = lambda a, c: F.array_join(F.transform(a, lambda x: x[c]), "")
    parts = F.array(cut(F.slice("r", 1, 2), "c"), cut(F.slice("r", F.lit(3), F.greatest(F.size("r") - 2, F.lit(0))), "c"), cut(F.slice("r", 1, 2), "d"), cut(F.col("r"), "e"))
    p = g.select("register", F.posexplode(parts).alias("i", "rows")).filter("rows != ''")
    p = p.select((F.col("register") * 10 + F.col("i")).alias("page_id"), "register", (F.col("i") + 1).alias("turn"), F.concat(F.lit("<table><tr><th>Reference</th><th>Site address</th><th>Received date</th></tr>"), "rows", F.lit("</table>")).alias("html"))
    r = P.paged_tables(p, html.stored_nodes(p), "2026-06-01")
    return r.select("register", "turn", F.upper("reference").alias("reference"), "address", "date_received", "date_inferred")


@query("select s_nationkey register, k::int turn from (select distinct s_nationkey from supplier), (values (1), (2), (3)) v(k) where k <= case when s_nationkey % 3 = 0 then 1 when s_nationkey % 3 = 1 then 2 else 3 end")
def followed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of next links: one ends at once, one leads back from its second page, one goes on."""
    n = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("register")).distinct()
    p = n.select("register", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("turn"))
    body = F.expr("case when turn = 3 or (register % 3 = 0 and turn = 1) then '<a href=\"/x\">home</a>' when register % 3 = 1 and turn = 2 then '<a href=\"/p1\">Next</a>' else '<a href=\"/p' || (turn + 1) || '\"> Next </a>' end")
    p = p.select((F.col("register") * 10 + F.col("turn")).alias("page_id"), "register", "turn", F.concat(F.lit("https://f.example/p"), F.col("turn").cast("string")).alias("url"), body.alias("html"))
    return P.followed(p, html.nodes(p), exact=True).select("register", "turn")


@query("select s_nationkey page_id, 'F/' || s_suppkey reference, 'https://r.example/a/detail.asp?AltRef=F/' || s_suppkey url, s_name address, 'Gates' description, '2026-06-05' date_received from supplier")
def fastweb_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = "'<table><tr><td>App. No. F/' || s_suppkey || '</td></tr><tr><td>Site Address: ' || s_name || ' Description: Gates Received Date: 05/06/2026 Decision Date:</td><td><a href=\"detail.asp?AltRef=F/' || s_suppkey || '\">more</a></td></tr></table>'"
    return P.fastweb_listing(html.nodes(listing(spark, sf_dir, t)), page()).select("page_id", "reference", "url", "address", "description", "date_received")


@query("select s_nationkey page_id, '26/' || lpad(s_suppkey::varchar, 5, '0') reference, left('For ' || s_name || ' on 05/06/2026, AB1 2CD ' || repeat('x', 300), 240) address, left('For 26/' || lpad(s_suppkey::varchar, 5, '0') || ' ' || s_name || ' on 05/06/2026, AB1 2CD ' || repeat('x', 300), 500) description, '2026-06-05' date_received, 'AB1 2CD' postcode from supplier")
def html_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with a reference; links to other places are left out."""
    item = "'<li>For <a href=\"/planning/' || s_suppkey || '\">26/' || lpad(s_suppkey::STRING, 5, '0') || '</a> ' || s_name || ' on 05/06/2026, AB1 2CD ' || repeat('x', 300) || '</li><li><a href=\"/news/1\">26/99999</a></li>'"
    return P.list_items(html.nodes(listing(spark, sf_dir, item)), page()).select("page_id", "reference", "address", "description", "date_received", "postcode")


@query("select s_nationkey page_id, '26/' || lpad(s_suppkey::varchar, 5, '0') reference, case when s_nationkey % 2 = 0 then 'table' else 'list' end source from supplier")
def table_or_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a header table are read as such, others as lists."""
    item = "case when s_nationkey % 2 = 0 then '<tr><td>26/' || lpad(s_suppkey::STRING, 5, '0') || '</td><td>' || s_name || '</td></tr>' else '<tr><td><a href=\"/application/' || s_suppkey || '\">26/' || lpad(s_suppkey::STRING, 5, '0') || '</a></td></tr>' end"
    p = listing(spark, sf_dir, item, "'<table><tr><th>Reference</th><th>Address</th></tr>'", "'</table>'")
    p = p.withColumn("html", F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.replace("html", F.lit("<th>Reference</th><th>Address</th>"), F.lit("<th>Found</th>"))))
    return P.table_or_list(html.stored_nodes(p), page()).select("page_id", "reference", "source")


@query("select s_nationkey page_id, 'N' || s_suppkey reference, 'Erection of gates at ' || s_name || ' at the corner.' description, s_name || ' at the corner' address, '2026-06-05' date_received from supplier")
def nested_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables within a table: the longest text that tells no decision."""
    t = "'<tr><td><table><tr><td><a href=\"PlAppDets.asp?casefullref=N' || s_suppkey || '\">N' || s_suppkey || '</a></td><td>Registered : 05/06/2026</td></tr><tr><td colspan=\"2\">Erection of gates at ' || s_name || ' at the corner.</td></tr><tr><td colspan=\"2\">short</td></tr><tr><td colspan=\"2\">A decision has been made and this is a far longer text than any other of this table, as all can see</td></tr><tr><td colspan=\"2\"><form action=\"x\">A form with a very long text that is not to be taken for the description of the works</form></td></tr></table></td></tr>'"
    p = listing(spark, sf_dir, t, "'<table>'", "'</table>'")
    return P.nested_results(html.stored_nodes(p), page()).select("page_id", "reference", "description", "address", "date_received")


@query("select s_nationkey page_id, 'TW/' || s_suppkey reference, '2026-06-05' date_validated, s_name address, 'Gates' description from supplier")
def daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one day's window by position, equal references once."""
    row = "'<tr><td><a href=\"PA-ApplicationSummary.aspx?n=' || s_suppkey || '\">TW/' || s_suppkey || '</a></td><td>05/06/2026</td><td>' || s_name || '</td><td>Gates</td></tr><tr><td><a href=\"pa-applicationsummary.aspx?n=' || s_suppkey || '\">tw/' || s_suppkey || '</a></td></tr>'"
    return P.positional_rows(html.nodes(listing(spark, sf_dir, row, "'<table>'", "'</table>'")), page(), "pa-applicationsummary.aspx").select("page_id", "reference", "date_validated", "address", "description")


@query("select s_nationkey page_id, 'U' || s_suppkey reference, 'https://r.example/a/show.asp?vUPRN=U' || s_suppkey || '&k=a+b' url, s_name address, false detail_complete from supplier")
def form_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose detail address is a form's."""
    row = "'<tr><td>' || s_name || '</td><td><form action=\"show.asp\"><input type=\"hidden\" name=\"vUPRN\" value=\"U' || s_suppkey || '\"><input name=\"k\" value=\"a b\"><input type=\"submit\" name=\"go\" value=\"Go\"></form></td></tr>'"
    return P.form_rows(html.stored_nodes(listing(spark, sf_dir, row, "'<table>'", "'</table>'")), page())


@query("select s_nationkey, 'W' || s_suppkey reference, s_name address, case when s_suppkey % 2 = 0 then '2026-06-05' else '2026-06-01' end date_received, '2026-06-06' date_validated, s_suppkey % 2 = 1 date_inferred, 'https://w.example/Planning/Display?applicationNumber=W' || s_suppkey url from supplier")
def weekly_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weekly report's rows as applications: prefixes and labels are cut off, missing dates are the report's."""
    line = F.expr("'Application No. W' || s_suppkey || ',' || s_name || ',Valid 06/06/2026,' || case when s_suppkey % 2 = 0 then 'Registered 05/06/2026' else '' end")
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(line), "\r\n").alias("l"))
    p = s.select("s_nationkey", F.base64(F.encode(F.concat(F.lit("application_number,location1,received_complete_date,valid_start_date\r\n"), "l"), "UTF-8")).alias("body"))
    r = P.weekly_records(payloads.weekly_csv(p, "s_nationkey", "body"), F.lit("https://w.example"), F.lit("2026-06-01"))
    return r.select("s_nationkey", "reference", "address", "date_received", "date_validated", "date_inferred", "url")


@query("""with o as (select o_custkey register, o_orderkey, o_orderdate::date d, (row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) - 1) // 2 + 1 turn from orders),
s as (select register, min(turn) stop from (select register, turn, min(d) m from o group by register, turn) where m < date '1997-01-01' group by register)
select register, o_orderkey, turn from o left join s using (register) where stop is null or turn <= stop""")
def grid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a grid sorted by date, read until one reaches back before the window."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("register"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_received"), (F.floor((F.row_number().over(w) - 1) / 2) + 1).alias("turn"))
    return P.grid_pages(o, "1997-01-01").select("register", "o_orderkey", "turn")


@query("""with r as (select lower('B/' || o_custkey) k, 'B/' || o_custkey reference, o_orderkey, 0 part from orders where o_orderdate::date between date '1997-01-01' and date '1997-03-31' union all
select lower('b/' || o_custkey), 'b/' || o_custkey, o_orderkey, 1 from orders where o_orderstatus = 'F' and o_orderdate::date between date '1997-03-01' and date '1997-04-30')
select reference, o_orderkey from r qualify row_number() over (partition by k order by part, o_orderkey) = 1""")
def two_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queries of one register, by validation and by publication: the first of a reference, equal but for case, wins."""
    from registrum.operators import relations as R

    o = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    ref = lambda p: F.concat(F.lit(p), F.col("o_custkey").cast("string"))
    a = o.filter(dates.in_window(F.col("d"), "1997-01-01", "1997-03-31")).select(ref("B/").alias("reference"), "o_orderkey")
    b = o.filter((F.col("o_orderstatus") == "F") & dates.in_window(F.col("d"), "1997-03-01", "1997-04-30")).select(ref("b/").alias("reference"), "o_orderkey")
    key = [p.withColumn("k", F.lower("reference")) for p in (a, b)]
    return R.union_distinct(key, ["k"], ["o_orderkey"]).select("reference", "o_orderkey")


@query("select s_nationkey page_id, k::int turn, 'https://r.example/a/wphappsearchres.displayResultsURL?StartIndex=' || (k * 10) url from (select distinct s_nationkey from supplier), (values (1), (2)) v(k)")
def legacy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = "'<a href=\"wphappsearchres.displayResultsURL?StartIndex=10\">2</a><a href=\"wphappsearchres.displayResultsURL?StartIndex=20\">3</a><a href=\"wphappsearchres.displayResultsURL?StartIndex=10\">back</a><a href=\"other?startindex=5\">x</a>'"
    return P.legacy_pages(html.nodes(listing(spark, sf_dir, "''", links)), page())


@query("select s_nationkey page_id, 'G/' || s_suppkey uid, case when s_suppkey % 2 = 0 then 'G/' || s_suppkey else '05/06/2026' end reference, case when s_suppkey % 2 = 0 then 'Ref ' || s_suppkey else '26/00' || lpad(s_suppkey::varchar, 3, '0') end || ' ' || s_suppkey || ' Elm Row' address from supplier")
def legacy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with slashes, plain link texts and dates in links."""
    row = "'<li><a href=\"wphappdetail.displayUrl?theApnID=G/' || s_suppkey || '\">' || if(s_suppkey % 2 = 0, 'Ref ' || s_suppkey, '05/06/2026') || '</a> ' || if(s_suppkey % 2 = 0, '', '26/00' || lpad(s_suppkey::STRING, 3, '0')) || ' ' || s_suppkey || ' Elm Row</li>'"
    return P.legacy_listing(html.nodes(listing(spark, sf_dir, row, "'<ul>'", "'</ul>'")), page(), ["theApnID"]).select("page_id", "uid", "reference", "address")

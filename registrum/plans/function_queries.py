"""Registered queries of scalar functions: text, dates, addresses, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.functions import dates, fixed, geometry, text, urls
from registrum.plans import leads
from registrum.plans.registered import query, table
from registrum.sources import html, payloads
from registrum.sources import listings as L

_DIALECTS = {"generic": "26/0012-A", "forms": "AB/26/0012", "idox": "26/00123/FUL", "northgate": "N.26.0012", "ocella": "2026.77"}


@query("select p_partkey, d dialect, case d " + " ".join(f"when '{d}' then '{r}'" for d, r in _DIALECTS.items()) + " end || p_partkey reference from part, (select unnest([" + ", ".join(f"'{d}'" for d in _DIALECTS) + "]) d)")
def reference_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of five dialects within running text."""
    n = F.col("p_partkey").cast("string")
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.create_map(*[x for d, r in _DIALECTS.items() for x in (F.lit(d), text.reference(F.concat(F.lit(f"see {r}"), n, F.lit(" now")), d))])).alias("dialect", "reference"))
    return p


@query("select p_partkey, case p_size % 3 when 0 then 'A26/00' || p_partkey when 1 then '26/1' || p_partkey else 'plain' end idox, case p_size % 3 when 0 then 'N/26/' || p_partkey when 1 then '26/1' || p_partkey else 'u' || p_partkey end northgate from part")
def reference_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference after a label, in a link, in a row; else the link's text or the uid."""
    n, k = F.col("p_partkey").cast("string"), F.col("p_size") % 3
    anchor = F.when(k == 0, F.lit("26/999 N/26/")).otherwise(F.lit("plain"))
    anchor = F.when(k == 0, F.concat(anchor, n)).otherwise(anchor)
    row = F.when(k == 0, F.concat(F.lit("x Application No.: A26/00"), n)).when(k == 1, F.concat(F.lit("row 26/1"), n)).otherwise("no number")
    return table(spark, sf_dir, "part").select("p_partkey", text.idox_reference(anchor, row).alias("idox"), text.northgate_reference(anchor, row, F.concat(F.lit("u"), n)).alias("northgate"))


@query("select p_partkey, p_name address, 'Mill ' || p_size labelled, p_name described, '05/06/2026' unlabelled, 'P' || p_partkey number from part")
def text_remainders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts less a reference, labels, a title, a prefix."""
    n = F.col("p_partkey").cast("string")
    ref = F.concat(F.lit("26/"), n)
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", text.without_reference(F.concat(ref, F.lit("  "), "p_name", F.lit(" "), ref), ref).alias("address"),
        text.without_reference(F.concat(F.lit("Application: "), ref, F.lit(" Mill "), F.col("p_size").cast("string"), F.lit(" status: Validated")), ref, labels=True).alias("labelled"),
        text.without_title(F.concat(F.lit("View "), "p_name"), F.lit("View")).alias("described"), text.without_label(F.lit("REGISTERED 05/06/2026"), "Registered").alias("unlabelled"),
        text.application_number(F.concat(F.lit("Application Number: P"), n)).alias("number"),
    )


@query("select p_partkey, 'a ' || p_partkey part, case when p_size % 2 = 0 then 'untitled' else rtrim(left(repeat('x', p_size) || '.', p_size)) end other, (p_size % 3 > 0)::bool titles from part")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe path parts, and titles that match."""
    n = F.col("p_partkey").cast("string")
    odd = F.when(F.col("p_size") % 2 == 0, " .?. ").otherwise(F.concat(F.expr("repeat('x', p_size)"), F.lit(".")))
    other = F.when(F.col("p_size") % 3 == 0, "Elevation").when(F.col("p_size") % 3 == 1, "Site plan (rev B)").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", text.sanitize_path_part(F.concat(F.lit(' a<:>"'), n, F.lit("|. "))).alias("part"), text.sanitize_path_part(odd).alias("other"), text.titles_match(F.lit("Site Plan.pdf"), other).alias("titles"))


@query("select o_orderkey, case when o_orderkey % 4 = 0 then null else o_orderdate::date end iso, strftime(o_orderdate, '%d/%m/%Y') first, '2026-06-05' labelled, case when o_orderkey % 3 = 0 then 'v' else 'r' end effective, strftime(o_orderdate, '%d-%m-%Y') formed, '2026-01-02T03:04:05+00:00' clock, strftime(o_orderdate, '%d/%m/%Y') weekday from orders")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.date_format("o_orderdate", "dd/MM/yyyy")
    iso = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.iso_date(iso).alias("iso"), dates.first_date(F.concat(F.lit("on "), d, F.lit(" and 01/01/2001"))).alias("first"), dates.labelled_date(F.lit("Valid: 1/1/2020 Received : Fri 05 Jun 2026"), "Received").alias("labelled"),
        dates.effective_date(F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise("r"), F.lit("v")).alias("effective"), dates.form_date(F.col("o_orderdate"), F.lit("Use the format  dd-mm-yyyy")).alias("formed"), dates.run_clock("2026-01-02T03:04:05+00:00").alias("clock"),
        dates.weekday_date(F.concat(F.lit("x "), d, F.lit(" Fri 05 Jun 2026"))).alias("weekday"),
    )


@query("select o_orderkey, case o_orderkey % 4 when 0 then least(o_orderkey % 400, 300)::double when 1 then 90.0::double when 2 then 0.0::double end \"seconds\", least(1.5, 0.5 + 0.15 * (o_orderkey % 9))::double stagger from orders")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds or an HTTP date, held within bounds; unreadable texts give none. Start delays of workers."""
    from registrum.streaming.limiter import worker_stagger

    k = F.col("o_orderkey") % 4
    c = F.when(k == 0, (F.col("o_orderkey") % 400).cast("string")).when(k == 1, "Fri, 05 Jun 2026 10:01:30 GMT").when(k == 2, "Fri, 05 Jun 2026 09:00:00 GMT").otherwise("soon")
    now = F.lit("2026-06-05 10:00:00").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.retry_after_seconds(c, now, 300).alias("seconds"), worker_stagger(F.col("o_orderkey") % 9 + 1).cast("double").alias("stagger"))


@query("select p_partkey, 'https://h.example/a/c%20d?x=' || p_partkey relative, 'https://h.example/r/' || p_partkey root, 'https://h.example/x?p=1&k=v' canonical, case when p_size % 2 = 0 then 'plan ' || p_partkey else 'b' || p_partkey || '.pdf' end title, '.pdf' suffix from part")
def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    base = F.lit("https://h.example/a/b?y=1")
    t = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://h/d?name=plan%20"), n)).otherwise(F.concat(F.lit("https://h/a/b"), n, F.lit(".pdf?x=1")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", urls.resolve(base, F.concat(F.lit(" c d?x="), n)).alias("relative"), urls.join_root(base, F.concat(F.lit("/r/"), n)).alias("root"),
        urls.canonical_url(F.lit("HTTPS://h.example/X?\tp =1& k=v")).alias("canonical"), urls.title_from_url(t).alias("title"), urls.path_suffix(F.concat(F.lit("https://h/a/"), n, F.lit(".PDF?y.doc"))).alias("suffix"),
    )


@query("""select p_partkey, 'https://h.example/pa/search.do?action=weeklyList&dateStart=01%2F06%2F2026&dateEnd=07%2F06%2F2026' weekly, 'https://h.example/pa/applicationDetails.do?activeTab=documents&keyVal=K' || p_partkey tab, 'https://h.example/v/?KeyNo=' || p_partkey || '&RefType=GF&KeyText=Subject' viewer,
 'https://h.example/pr/s/sfsites/aura?r=1' aura, 'A ' || p_partkey record, 'A/' || p_partkey display, case p_size % 3 when 0 then 'town' when 1 then 'city' end slug, '/pa/' root, 'https://h.example/i?fa=getList&x=1' replaced,
 'https://www.copeland.gov.uk/planning/application-search?field_plan_app_date_received_value%5Bmin%5D%5Bdate%5D=2026-06-01&field_plan_app_date_received_value%5Bmax%5D%5Bdate%5D=2026-06-07' dated, 'https://n.example/search?status=2&dateType=valid&startDate=2026-06-01&endDate=2026-06-07' valid from part""")
def url_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of searches, tabs, viewers and actions, and what addresses tell."""
    n, day = F.col("p_partkey").cast("string"), lambda d: F.lit(d).cast("date")
    s, e = day("2026-06-01"), day("2026-06-07")
    slug = F.expr("case p_size % 3 when 0 then 'https://planning.agileapplications.co.uk/town/search' when 1 then 'https://city.example.org/' else 'https://www.example.org/' end")
    return table(spark, sf_dir, "part").select(
        "p_partkey", urls.weekly_list_url(F.lit("https://h.example/"), F.lit("/pa/"), s, e).alias("weekly"), urls.summary_url(F.lit("https://h.example/pa/results.do?x"), F.concat(F.lit("K"), n), "documents").alias("tab"),
        urls.viewer_url(F.lit("https://h.example/x/y"), F.lit("/v/"), n, F.lit("GF"), F.lit(None).cast("string")).alias("viewer"), urls.aura_endpoint(F.lit("https://h.example/pr/s/register?c__r=x"), ("r", "1")).alias("aura"),
        urls.record_id(F.concat(F.lit("https://h/pr/s/Detail/A%20"), n, F.lit("/x"))).alias("record"), urls.display_uid(F.concat(F.lit("https://h/planning/display/A%2F"), n, F.lit("/"))).alias("display"), urls.client_slug(slug).alias("slug"),
        urls.application_root(F.lit("https://h/pa/search.do?x")).alias("root"), urls.replaced_action(F.lit("https://h.example/i?fa=search&x=1"), "getList").alias("replaced"),
        urls.dated_search(F.lit("https://www.copeland.gov.uk/planning/application-search"), s, e).alias("dated"), urls.valid_search(F.lit("https://n.example/x"), s, e).alias("valid"),
    )


@query("select p_partkey, case p_size % 4 when 0 then 'generic' when 1 then 'northgate' when 2 then 'htmllist' else '' end family from part")
def application_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which family takes a link for an application's."""
    k = F.col("p_size") % 4
    href = F.when(k == 0, "/case/1").when(k == 1, "/StdDetails.aspx?x").when(k == 2, "/eplanning/1").otherwise("/about")
    title, ref, uid = F.lit("more"), F.when(k != 3, "26/1"), F.when(k == 1, "u")
    is_link = lambda f, r=ref, u=uid: urls.is_application_link(href, title, r, u, f)
    family = F.when((k == 0) & is_link("generic"), "generic").when(is_link("northgate"), "northgate").when(is_link("htmllist") & ~is_link("ocella"), "htmllist").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", family.alias("family"))


@query("select p_partkey, 'DateReceivedFrom' \"from\", case when p_size % 2 = 0 then 'decision_date_to' else 'DateReceivedTo' end \"to\", case when p_size % 2 = 0 then 'Validated date' else 'Other' end criterion, case when p_size % 3 = 0 then 7 end total, case when p_size % 3 = 0 then 5 end shown from part")
def form_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields a search form takes dates in, the criterion it prefers, the totals its page reports."""
    even = F.col("p_size") % 2 == 0
    names = F.concat(F.array(F.lit("decision date from"), F.lit("DateReceivedFrom"), F.lit("decision_date_to")), F.when(even, F.array().cast("array<string>")).otherwise(F.array(F.lit("DateReceivedTo"))))
    f = L.date_fields(names)
    t = html.reported_total(F.when(F.col("p_size") % 3 == 0, "The first 5 results shown, there are 7 in total").otherwise("none"))
    c = L.preferred_criterion(F.when(even, F.array(F.lit("Decision"), F.lit("Validated date"))).otherwise(F.array(F.lit("Other"), F.lit("Decision"))))
    return table(spark, sf_dir, "part").select("p_partkey", f["from"].alias("from"), f["to"].alias("to"), c.alias("criterion"), t["total"].alias("total"), t["shown"].alias("shown"))


@query("select n_nationkey, n_nationkey % 3 = 0 crosses, (n_nationkey % 5 + 0.5)::double x, case when n_nationkey % 2 = 0 then 1.5::double end y from nation")
def geometry_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thin boxes that cross without a corner in each other; points of applications."""
    at = F.when(F.col("n_nationkey") % 3 == 0, F.lit(1.0)).otherwise(F.lit(9.0))
    tall, wide = geometry.box_ring(at, F.lit(-2.0), at + 0.5, F.lit(2.0)), geometry.box_ring(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(0.5))
    raw = F.expr("if(n_nationkey % 4 < 2, '{\"location\":{\"coordinates\":[' || (n_nationkey % 5 + 0.5) || ',' || if(n_nationkey % 2 = 0, '1.5', '\"north\"') || ']}}', '{\"longitude\":\"' || (n_nationkey % 5 + 0.5) || '\",\"latitude\":' || if(n_nationkey % 2 = 0, '1.5', 'null') || '}')")
    x, y = leads.application_point()
    n = table(spark, sf_dir, "nation").withColumn("raw", raw)
    return n.select("n_nationkey", geometry.polygons_intersect(F.array(tall), F.array(wide)).alias("crosses"), x.alias("x"), y.alias("y"))


@query("select n_nationkey, k::int ordinal, case when k = 0 then 1 else 2 end::int polygons, n_nationkey::double x0, (n_nationkey + 1 + k)::double x1 from nation, (values (0), (1)) v(k) where n_nationkey % 2 = 0 union all select n_nationkey, 0, 1, n_nationkey::double, (n_nationkey + 1)::double from nation where n_nationkey % 2 = 1")
def boundary_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON: collections of a polygon and a multipolygon, and bare polygons."""
    ring = lambda a: f"'[[[' || {a} || ',0],[' || ({a} + 1) || ',0],[' || ({a} + 1) || ',1],[' || {a} || ',0]]]'"
    one = f"'{{\"type\":\"Polygon\",\"coordinates\":' || {ring('n_nationkey')} || '}}'"
    many = f"'{{\"type\":\"MultiPolygon\",\"coordinates\":[' || {ring('n_nationkey')} || ',' || {ring('(n_nationkey + 1)')} || ']}}'"
    whole = f"if(n_nationkey % 2 = 0, '{{\"type\":\"FeatureCollection\",\"features\":[{{\"type\":\"Feature\",\"properties\":{{\"n\":1}},\"geometry\":' || {one} || '}},{{\"type\":\"Feature\",\"geometry\":' || {many} || '}}]}}', {one})"
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.expr(whole).alias("value"))
    parts = payloads.boundary_rows(n)
    return parts.select(F.floor("box.x0").cast("int").alias("n_nationkey"), "ordinal", F.size("geometry").alias("polygons"), F.col("box.x0").alias("x0"), F.col("box.x1").alias("x1"))


@query("select s_suppkey, case when s_suppkey % 4 = 0 then 'Nuneaton' else 'A' || s_suppkey end authority, case when s_suppkey % 4 = 0 then 'tascomi' when s_suppkey % 2 = 0 then 'idox' else 'unknown' end portal_family, case when s_suppkey % 4 = 0 then 'https://idoxcloud.nuneatonandbedworth.gov.uk/planning/index.html?fa=search' else 'https://p/' || s_suppkey end listing_url, s_suppkey % 3 > 0 link_test_ok from supplier")
def catalogue_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of catalogue features: current portals of some authorities override what the catalogue says."""
    f = "'{\"type\":\"Feature\",\"properties\":{\"' || if(s_suppkey % 2 = 0, 'authority', 'council_name') || '\":\"' || if(s_suppkey % 4 = 0, 'Nuneaton', 'A' || s_suppkey) || '\",' || if(s_suppkey % 2 = 0, '\"portal_family\":\"idox\",', '') || '\"planning_url\":\"https://p/' || s_suppkey || '\",\"link_test_ok\":' || (s_suppkey % 3 > 0) || '},\"geometry\":{\"type\":\"Polygon\",\"coordinates\":[[[' || s_suppkey || ',0],[' || (s_suppkey + 1) || ',0],[' || (s_suppkey + 1) || ',1]]]}}'"
    s = table(spark, sf_dir, "supplier").select(F.expr(f).alias("value"))
    c = payloads.catalogue_rows(payloads.boundary_rows(s))
    return c.select(F.col("box.x0").cast("long").alias("s_suppkey"), "authority", "portal_family", "listing_url", "link_test_ok")


_ADAPTERS = ", ".join(f"({i}, '{k.title()}', '{n}')" for i, (k, n, _) in enumerate(fixed.AUTHORITIES))


@query(f"select c_custkey, case when c_custkey % 50 < {len(fixed.AUTHORITIES)} then a else 'Town' end authority, case when c_custkey % 50 < {len(fixed.AUTHORITIES)} then n when c_custkey % 2 = 0 then 'civica' else 'generic' end adapter from customer left join (values {_ADAPTERS}) v(i, a, n) on i = c_custkey % 50")
def authority_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every authority with an adapter of its own, and others by their family."""
    names = F.array(*[F.lit(k.title()) for k, _, _ in fixed.AUTHORITIES])
    c = table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.get(names, (F.col("c_custkey") % 50).cast("int")), F.lit("Town")).alias("authority"), F.when(F.col("c_custkey") % 2 == 0, "Civica").otherwise("").alias("s"))
    return c.select("c_custkey", "authority", text.resolved_adapter("authority", "s", F.lit("unknown"), F.lit("")).alias("adapter"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'C' || c_custkey else 'A' || c_custkey end authority, case when c_custkey % 2 = 0 then 'unknown' else 'idox' end portal_family, case when c_custkey % 5 = 0 then 'https://b.example' else 'https://l.example' end base_url, case when c_custkey % 2 = 0 then '/online-applications/' else '/pa/' end application_root from customer")
def target_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of catalogue rows with their defaults."""
    n = F.col("c_custkey").cast("string")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("A"), n)).alias("authority"), F.concat(F.lit("C"), n).alias("council_name"), F.when(F.col("c_custkey") % 2 == 1, "idox").otherwise("").alias("portal_family"), F.when(F.col("c_custkey") % 5 == 0, "https://b.example//").alias("base_url"), F.when(F.col("c_custkey") % 2 == 1, "https://l.example/pa/search.do?x").otherwise("https://l.example/x").alias("planning_url"))
    keyed = leads.target_rows(c).withColumn("c_custkey", F.regexp_extract("authority", r"(\d+)", 1).cast("long"))
    return keyed.select("c_custkey", "authority", "portal_family", "base_url", "application_root")

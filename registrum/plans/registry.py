"""The registered queries by name, and the SQL that DuckDB can run for them.

The driver's tables hold no planning data, so each operator runs on stand-in columns: orders are applications, nations
authorities, regions search areas, customers sites, events request logs, documents proposals, pages stored HTML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.functions import dates, files, fixed, geometry, text, urls
from registrum.operators import documents as D
from registrum.operators import relations as R
from registrum.plans import catalogue as C
from registrum.plans import leads
from registrum.plans.registered import ORACLES, QUERIES, query, quoted, table
from registrum.sources import html, payloads
from registrum.sources import listings as L

WORDS = ["building", "urgent", "household"]
START, END = "1996-01-01", "1998-12-31"
SQL_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(f"""
with a as (select n_name authority, o_custkey reference, o_orderkey ordinal, o_orderdate::date d, lower(c_mktsegment || ' ' || o_orderpriority) hay
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name in ('EUROPE', 'ASIA')),
m as (select *, d between date '{START}' and date '{END}' and ({' or '.join(f"contains(hay, '{w}')" for w in WORDS)}) hit from a),
f as (select *, hit and row_number() over (partition by reference, hit order by ordinal) = 1 as lead from m)
select authority, count(*) total, count(*) filter (where lead) relevant, count(*) filter (where lead) / count(*)::double ratio from f group by authority""")
def lead_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of each authority in a window: area, date, keywords, first wins, funnel."""
    t = lambda n: table(spark, sf_dir, n)
    area = t("nation").join(t("region").filter(F.col("r_name").isin("EUROPE", "ASIA")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("authority"))
    site = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(area, F.col("c_nationkey") == F.col("n_nationkey"))
    a = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").join(site, F.col("o_custkey") == F.col("c_custkey"))
    hit = dates.in_window(F.col("o_orderdate").cast("date"), START, END) & text.contains_any(leads.haystack("c_mktsegment", "o_orderpriority"), WORDS)
    a = a.select("authority", "o_custkey", "o_orderkey", hit.alias("hit"))
    per = a.groupBy("authority", "o_custkey").agg(F.count("*").alias("n"), F.max("hit").cast("long").alias("lead"))
    return per.groupBy("authority").agg(F.sum("n").alias("total"), F.sum("lead").alias("relevant"), (F.sum("lead") / F.sum("n")).alias("ratio"))


KEYWORDS = ["the", "nation", "gates", "license", "table", "wall"]


@query("select doc_id, list_filter([" + quoted(KEYWORDS) + "], lambda k: contains(lower(text), k)) hits from documents where " + " or ".join(f"contains(lower(text), '{k}')" for k in KEYWORDS))
def keyword_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with any keyword as a substring, and which."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.keyword_hits(F.lower("text"), KEYWORDS).alias("hits"))
    return d.filter(F.size("hits") > 0)


@query("select k keyword, count(*) n from documents, (select unnest([" + quoted(KEYWORDS) + "]) k) where contains(lower(text), k) group by k")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each keyword hits."""
    return table(spark, sf_dir, "documents").select(F.explode(text.keyword_hits(F.lower("text"), KEYWORDS)).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


_PROPOSAL = "case p_partkey % 8 when 0 then 'Details of condition ' || p_size when 1 then 'Works under  Condition ' || p_size || ' of consent' when 2 then 'Retrospective ' || p_name when 3 then 'Part retrospective ' || p_name when 4 then 'Discharge of Condition: ' || p_name when 5 then 'T1 ' || p_name else p_name end"
_REFERENCE = "case when p_partkey % 11 = 0 then ' Old/' else 'P/' end || p_partkey"
_P = f"trim(regexp_replace(lower(coalesce(proposal, '')), '{SQL_SPACE}', ' ', 'g'))"


@query(f"""
with s as (select p_partkey, {_PROPOSAL} proposal, {_REFERENCE} reference from part), p as (select *, {_P} p from s)
select p_partkey, starts_with(lower(trim(reference)), 'old') by_reference,
  {' or '.join(f"starts_with(p, '{x}')" for x in fixed.EXCLUDED_PREFIXES)} or regexp_matches(p, '\\bcondition\\s+\\d+\\b') or (contains(p, 'retrospective') and not regexp_matches(p, '\\bpart\\b'))
  or {' or '.join(f"contains(p, '{x}')" for x in fixed.EXCLUDED_PHRASES)} by_proposal from p""")
def proposal_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_PROPOSAL).alias("proposal"), F.expr(_REFERENCE).alias("reference"))
    return p.select("p_partkey", text.reference_excluded("reference").alias("by_reference"), text.proposal_excluded("proposal").alias("by_proposal"))


_ENT = "text"
for _e, _v in text.ENTITIES:
    _ENT = f"replace({_ENT}, '{_e.replace(chr(39), chr(39) * 2)}', '{_v.replace(chr(39), chr(39) * 2)}')"
_CLEAN = f"nullif(trim(regexp_replace({_ENT}, '{SQL_SPACE}', ' ', 'g')), '')"


@query(f"select doc_id, sha256(coalesce({_CLEAN}, '')) cleaned, left({_CLEAN}, 40) short from documents")
def clean_text_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts cleaned, as a digest, and their trimmed form."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.clean_text("text").alias("c"))
    return d.select("doc_id", F.sha2(F.coalesce("c", F.lit("")), 256).alias("cleaned"), text.trim_text("c", 40).alias("short"))


@query(f"select doc_id, sha256(trim(regexp_replace(replace(lower(coalesce({_CLEAN}, '')), '&', 'and'), '[^a-z0-9]+', '_', 'g'), '_')) label from documents")
def label_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of each whole text, as a digest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize_label("text"), 256).alias("label"))


@query("select doc_id, regexp_extract(text, '" + fixed.REFERENCES["generic"].replace(r"\b", r"\b") + "', 0) reference from documents where regexp_matches(text, '" + fixed.REFERENCES["generic"] + "')")
def reference_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.reference("text").alias("reference")).filter("reference is not null")


_FORMATS = ["dd/MM/yyyy", "dd/MM/yy", "dd-MM-yyyy", "dd-MM-yy", "yyyy-MM-dd", "dd-MMMM-yyyy", "dd-MMM-yyyy", "dd MMMM yyyy", "dd MMM yyyy", "EEE dd MMM yyyy", "EEEE dd MMMM yyyy"]


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') parsed, o_orderdate::date d from orders")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in every register format and read back."""
    shown = F.coalesce(*[F.when(F.col("o_orderkey") % 11 == i, F.date_format("o_orderdate", f)) for i, f in enumerate(_FORMATS)])
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("  "), shown, F.lit(" ")).alias("shown"))
    return o.select("o_orderkey", dates.parse_council_date("shown").alias("parsed"), dates.council_date("shown").alias("d"))


@query("with o as (select o_orderkey, case when o_orderkey % 7 = 0 then null else o_orderdate::date end d from orders) select o_orderkey, d between date '1996-01-01' and date '1998-12-31' and d is not null required, coalesce(d >= date '1996-01-01' and d <= date '1998-12-31', true) tolerant, coalesce(d >= date '1996-01-01', true) since from o")
def date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.in_window(d, START, END).alias("required"), dates.in_window_or_unknown(d, START, END).alias("tolerant"), dates.in_window_or_unknown(d, START, None).alias("since"))


@query("select user_id, unnest(generate_series(date_trunc('week', min(ts))::date, max(ts)::date, interval 7 day))::date as \"week\" from events group by user_id")
def week_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mondays of the weeks each user's events span."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").cast("date").alias("s"), F.max("ts").cast("date").alias("e"))
    return e.select("user_id", F.explode(dates.week_starts(F.col("s"), F.col("e"))).alias("week"))


@query("with d as (select o_orderkey, o_orderdate::date d from orders) select o_orderkey, d, unnest(generate_series(d, d + 3, interval 1 day))::date as \"day\", date_trunc('week', d)::date - 7 prev_start, date_trunc('week', d)::date - 1 prev_end, dayofweek(d) = 1 and dayofweek(d + 6) = 0 whole from d")
def day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    p = dates.previous_week(F.col("d"))
    return o.select("o_orderkey", "d", F.explode(dates.days(F.col("d"), F.date_add("d", 3))).alias("day"), p["start"].alias("prev_start"), p["end"].alias("prev_end"), dates.whole_weeks(F.col("d"), F.date_add("d", 6)).alias("whole"))


@query("with e as (select user_id, ts, coalesce(epoch(ts)::bigint - epoch(lag(ts) over w)::bigint > 7200, true)::int f, event_id from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(f) over (partition by user_id order by ts, event_id rows unbounded preceding) session from e) select user_id, session::bigint as \"session\", count(*) n, min(ts) started, max(ts) ended from s group by user_id, session")
def inactivity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gap_sessions(table(spark, sf_dir, "events"), "user_id", "ts", 7200)


@query("with o as (select o_orderdate::date d from orders), r as (with recursive w(s, e) as (select date '1995-01-01', date '2001-08-01' union all select case when k = 0 then s else (s + ((e - s) // 2)::int + 1)::date end, case when k = 0 then (s + ((e - s) // 2)::int)::date else e end from w, (values (0), (1)) v(k) where (select count(*) from o where d between s and e) > 300 and s < e) select * from w) select s, e, (select count(*) from o where d between s and e) n from r where not ((select count(*) from o where d between s and e) > 300 and s < e)")
def bisect_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return R.bisect_windows(daily, "1995-01-01", "2001-08-01", 300)


_RINGS = {"outer": [(-0.2, -0.2), (0.2, -0.15), (0.25, 0.2), (0.0, 0.05), (-0.15, 0.25)], "hole": [(-0.05, -0.1), (0.05, -0.1), (0.05, 0.0), (-0.05, 0.0)]}


def _ring(points: list[tuple[float, float]]) -> str:
    return "array(" + ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in points) + ")"


def _crossings(points: list[tuple[float, float]]) -> str:
    prev = [points[-1], *points[:-1]]
    terms = [f"(case when (({by}::double > y) != ({ay}::double > y)) and x < ({ax}::double - {bx}::double) * (y - {by}::double) / ({ay}::double - {by}::double) + {bx}::double then 1 else 0 end)" for (ax, ay), (bx, by) in zip(prev, points) if ay != by]
    return "(" + " + ".join(terms) + ") % 2 = 1"


@query(f"with p as (select vec_id, embedding[1]::double x, embedding[2]::double y from embeddings) select vec_id, {_crossings(_RINGS['outer'])} and not ({_crossings(_RINGS['hole'])}) inside from p")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    area = F.expr(f"array({_ring(_RINGS['outer'])}, {_ring(_RINGS['hole'])})")
    return p.select("vec_id", geometry.point_in_polygon(F.col("x"), F.col("y"), area).alias("inside"))


@query(f"with p as (select vec_id, case when vec_id % 9 != 0 then embedding[1]::double end x, embedding[2]::double y from embeddings) select vec_id from p where x is null or {_crossings(_RINGS['outer'])}")
def points_in_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the area; those without a point pass."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 9 != 0, F.get("embedding", F.lit(0)).cast("double")).alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    area = leads.boxed(spark.range(1), F.expr(_ring(_RINGS["outer"])))
    return R.points_in_areas(p, area, "x", "y").select("vec_id")


@query("with s as (select s_suppkey, (s_suppkey % 37) + 0.25::double x, (s_suppkey % 23) + 0.25::double y from supplier), n as (select (n_nationkey * 1.5)::double x, (n_nationkey % 7 * 3)::double y from nation where n_regionkey = 1) select s_suppkey from s where exists (select 1 from n where s.x <= n.x + 2.5 and n.x <= s.x + 1.5 and s.y <= n.y + 2.5 and n.y <= s.y + 1.5)")
def overlap_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of suppliers that overlap boxes of one region's nations."""
    box = lambda x, y, w: geometry.box_ring(x, y, x + w, y + w)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 37 + 0.25).alias("x"), (F.col("s_suppkey") % 23 + 0.25).alias("y"))
    n = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select((F.col("n_nationkey") * 1.5).cast("double").alias("x"), (F.col("n_nationkey") % 7 * 3 + 0.0).alias("y"))
    return R.spatial_semi_join(leads.boxed(s, box(F.col("x"), F.col("y"), 1.5)), leads.boxed(n, box(F.col("x"), F.col("y"), 2.5)), 3.0).select("s_suppkey")


@query("with a as (select ' ' || o_orderkey || ' ' reference, case when o_orderkey % 3 = 0 then '' else o_orderpriority end address, case when o_orderkey % 5 != 0 then o_orderstatus end status from orders where o_orderkey % 4 < 3), b as (select o_orderkey::varchar reference, 'feed ' || o_orderpriority address, 'F' status from orders where o_orderkey % 4 > 0), j as (select a.reference ar, b.reference br, a.address aa, a.status ast, b.address ba, b.status bs from a full join b on trim(a.reference) = b.reference) select coalesce(ar, br) reference, coalesce(nullif(trim(aa), ''), ba) address, coalesce(nullif(trim(ast), ''), bs) status, ar is not null from_main, ar is not null and br is not null supplemented from j")
def merge_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = o.filter("o_orderkey % 4 < 3").select(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("reference"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("address"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"))
    b = o.filter("o_orderkey % 4 > 0").select(F.col("o_orderkey").cast("string").alias("reference"), F.concat(F.lit("feed "), "o_orderpriority").alias("address"), F.lit("F").alias("status"))
    return R.merge_fallback(a, b, "reference", ["address", "status"])


@query("with s as (select n_nationkey k, n_nationkey % 5 = 0 failed, n_nationkey % 7 = 0 first from nation), m as (select c_nationkey k, c_custkey id, 'main' src from customer where c_nationkey % 3 > 0), f as (select s_nationkey k, s_suppkey id, 'feed' src from supplier), u as (select k from s where failed or first or k not in (select k from m)) select * from m union all select * from f where k in (select k from u)")
def conditional_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed only for authorities that failed, were empty, or prefer it."""
    s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 5 == 0).alias("failed"), (F.col("n_nationkey") % 7 == 0).alias("feed_first"))
    m = table(spark, sf_dir, "customer").filter("c_nationkey % 3 > 0").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.lit("main").alias("src"))
    f = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"), F.lit("feed").alias("src"))
    return R.conditional_fallback(s, m, f, "k")


@query("with al as (select n_name authority, o ordinal, case when o = 0 then 'X' || n_nationkey when o = 1 then case when n_nationkey % 2 = 0 then (n_nationkey + 1)::varchar else 'none' end else n_nationkey::varchar end name from nation, (values (0), (1), (2)) v(o)), r as (select s_suppkey, s_nationkey::varchar name from supplier), h as (select authority, min_by(name, ordinal) name from al where name in (select name from r) group by authority) select authority, s_suppkey, name alias from h join r using (name)")
def alias_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under the first alias of an authority that has any."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("authority"), F.posexplode(F.expr("array('X' || n_nationkey, if(n_nationkey % 2 = 0, cast(n_nationkey + 1 as string), 'none'), cast(n_nationkey as string))")).alias("ordinal", "name"))
    r = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("name"))
    return R.first_alias(r, n, "name").select("authority", "s_suppkey", "alias")


@query("select o_orderkey, coalesce(nullif(l_returnflag, ''), o_orderstatus) status, coalesce(l_shipdate, o_orderdate) as \"day\", l_orderkey is not null found from orders left join lineitem on l_orderkey = o_orderkey and l_linenumber = 1 and l_orderkey % 3 > 0")
def detail_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("day"))
    d = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1 and l_orderkey % 3 > 0").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("status"), F.col("l_shipdate").alias("day"))
    return R.overlay(s, d, ["o_orderkey"], ["status", "day"])


@query("select o_custkey, o_orderkey, o_orderdate, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1")
def first_wins_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_wins(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("with u as (select 0 part, o_custkey k, o_orderkey id from orders where o_orderstatus = 'F' union all select 1, o_custkey, o_orderkey from orders where o_orderpriority like '1%') select k, id from u qualify row_number() over (partition by k order by part, id) = 1")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")
    return R.union_distinct([o.filter("o_orderstatus = 'F'").select("k", "id"), o.filter("o_orderpriority like '1%'").select("k", "id")], ["k"], ["id"])


_FAMILY = "case " + " ".join("when " + " or ".join(f"contains(h, '{m}')" for m in ms) + f" then '{f}'" for f, ms in fixed.SIGNATURES) + " end"
_URL = "url || case page_id % 6 when 0 then '/online-applications/search.do' when 1 then '/apas/run/x?theApnID=1' when 2 then '?fa=search' when 3 then '/Northgate/General_Search.aspx' else '' end"


@query(f"with p as (select page_id, lower({_URL} || chr(10) || html) h from pages) select page_id, {_FAMILY} family from p")
def family_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(_URL).alias("url"), "html")
    return p.select("page_id", text.portal_family("html", "url").alias("family"))


@query(r"select page_id, coalesce(nullif(regexp_extract(url, '(?i)[?&]ref=([^&#]*)', 1), ''), nullif(regexp_extract(url, '(?i)[?&]page=([^&#]*)', 1), ''), nullif(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/([^/]+)$', 1), '')) uid, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) host from pages")
def uid_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.uid_from_url("url", ["ref", "page"], "/([^/]+)$").alias("uid"), urls.host("url").alias("host"))


@query("""with h as (select page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) href from pages) select page_id, href, count(*) n from h group by page_id, href""")
def href_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = html.anchors(html.nodes(table(spark, sf_dir, "pages")))
    return a.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("select page_id, 'anchor' kind, 'https://register.example/files/plan-' || page_id || '.pdf' url, 'Plan' title from pages union all select page_id, 'data', 'https://x.example/getfile?id=' || page_id, 'Get' from pages")
def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document links of pages to which a register's document list is added."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.expr("'<ul><li><a href=\"/files/plan-' || page_id || '.pdf\">Plan</a><li><a href=\"/privacy.pdf\">Privacy</a><li><button data-href=\"https://x.example/getfile?id=' || page_id || '\">Get</button></ul>'")).alias("html"))
    return html.document_links(html.nodes(p), F.lit("https://register.example/a/b")).select("page_id", "kind", "url", "title")


_ROWS = "'<table><tr><th>Application Reference<td>' || c_custkey || '</tr><tr><th>Site Address</th><td>' || c_name || ' &amp; Sons</td></tr><tr><td>Proposal:<td>' || c_mktsegment || '<tr><td>Address</td><td>ignored</td></table><dl><dt>Ward</dt><dd> W' || c_nationkey || '</dd></dl>'"


@query("select c_custkey, c_custkey::varchar reference, c_name || ' & Sons' address, c_mktsegment description, 'W' || c_nationkey ward from customer")
def labelled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled HTML made of customers, read back by the label map: first value wins."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_ROWS).alias("html"))
    p = html.labelled_pairs(html.trees(c, "c_custkey"), "c_custkey")
    return html.label_columns(p, "generic", "c_custkey").select("c_custkey", "reference", "address", "description", "ward")


_TABLE = "'<table><tr><th>Ref</th><th>Application Number</th><th>Location</th></tr>' || array_join(transform(s, x -> '<tr><td>' || x.s_nationkey || '<td><a href=\"/d?id=' || x.s_suppkey || '\">A' || x.s_suppkey || '</a><td>' || x.s_name), '') || '</table>'"


@query("select s_nationkey, 'A' || s_suppkey reference, s_name address, '/d?id=' || s_suppkey href from supplier")
def header_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct("s_nationkey", "s_suppkey", "s_name")).alias("s")).select("s_nationkey", F.expr(_TABLE).alias("html"))
    h = html.header_tables(html.nodes(s, "s_nationkey"), "forms", "s_nationkey")
    return R.eav_pivot(h, ["s_nationkey", "row", "href"], "row", "column", "value", ["reference", "address"]).select("s_nationkey", "reference", "address", "href")


@query("select user_id, max_by(json_extract_string(props, '$.k'), event_id) filter (where event_type = 'click') click, max_by(json_extract_string(props, '$.k'), event_id) filter (where event_type = 'view') view from events group by user_id")
def eav_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("v", F.get_json_object("props", "$.k"))
    return R.eav_pivot(e, ["user_id"], "event_id", "event_type", "v", ["click", "view"])


@query("select user_id, event_id::varchar uid, event_type reference, strftime(ts, '%Y-%m-%d') date_received from events")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events wrapped as a JSON feed and decoded by a family specification."""
    e = table(spark, sf_dir, "events")
    r = F.struct(F.col("event_id").cast("string").alias("pk"), F.col("event_type").alias("application_number"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("registered_date"))
    p = e.groupBy("user_id").agg(F.to_json(F.collect_list(r)).alias("body"))
    return payloads.applications(p, "socrata").select("user_id", "uid", "reference", "date_received")


@query("select n_regionkey, n_nationkey::varchar k, n_name v from nation")
def xml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("r", F.expr("'<Row id=\"' || n_nationkey || '\"><result column=\"' || n_nationkey || '\">' || n_name || '</result></Row>'"))
    p = n.groupBy("n_regionkey").agg(F.concat(F.lit("<Rows>"), F.array_join(F.collect_list("r"), ""), F.lit("</Rows>")).alias("body"))
    return payloads.xml_rows(p, "body").select("n_regionkey", F.col("column").alias("k"), F.col("value").alias("v"))


@query("select s_nationkey, 'S' || s_suppkey number, s_name || ' line two' address from supplier")
def weekly_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("'S' || s_suppkey || ',\"' || s_name || '\r\nline two\"'")
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(line), "\r\n").alias("l"))
    p = s.select("s_nationkey", F.base64(F.encode(F.concat(F.lit("﻿Weekly list\r\n\r\napplication_number,location1\r\n"), "l"), "UTF-8")).alias("body"))
    return payloads.weekly_csv(p, "s_nationkey", "body").select("s_nationkey", F.col("cells")["application_number"].alias("number"), F.col("cells")["location1"].alias("address"))


_ERROR = "case event_type when 'click' then 'HTTP 429: slow down' when 'view' then 'HTTP 503 from host' when 'purchase' then 'Could not find form' else case when event_id % 3 = 0 then 'HTTP 403 Forbidden' when event_id % 3 = 1 then 'Connection refused' else 'odd failure' end end"


def _any(tokens: list[str]) -> str:
    return "(" + " or ".join(f"contains(e, '{t}')" for t in tokens) + ")"


@query(f"with x as (select event_id, lower({_ERROR}) e from events) select event_id, case when {_any(fixed.RATE_LIMITED)} then 'rate_limited' when {_any(fixed.BLOCKED)} then 'blocked' when {_any(fixed.UNAVAILABLE)} then 'service_unavailable' else 'failed' end signal, {_any(fixed.RESPONSIVE)} or not {_any(fixed.OUTAGE)} degraded, {_any(fixed.FRESH_SESSION)} retry from x")
def failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_ERROR).alias("e"))
    return e.select("event_id", text.failure_signal("e").alias("signal"), text.failure_degraded("e").alias("degraded"), text.retry_with_fresh_session("e").alias("retry"))


@query("with m as (select *, row_number() over (partition by user_id order by ts, event_id) i, row_number() over (partition by user_id, event_type order by ts, event_id) j from events) select user_id, event_type, count(*) n, min(i) as \"first\", max(i) as \"last\" from m group by user_id, event_type, i - j")
def streak_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.streaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    return r.select("user_id", "event_type", "n", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) <= 3")
def limit_per_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.limit_per(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("with t as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by c_custkey) turn from customer) select c_custkey, c_mktsegment, turn, min(c_custkey) over (partition by c_mktsegment) platform_order from t")
def fair_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fair_order(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey").withColumn("turn", F.col("turn").cast("long"))


_TITLE = "p_name || case p_partkey % 4 when 0 then '.PDF' when 1 then '  (Rev B).docx' else '' end"


@query(f"select p_partkey, trim(regexp_replace(regexp_replace(lower({_TITLE}), '\\.[a-z0-9]{{2,5}}$', ''), '[^a-z0-9]+', ' ', 'g')) title, upper(substr(p_brand, 1, 2)) || (p_partkey % 90 + 10) || ' ' || (p_size % 10) || 'AB' postcode from part")
def title_and_postcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_TITLE).alias("t"), F.expr("'Road, ' || lower(substr(p_brand, 1, 2)) || (p_partkey % 90 + 10) || '  ' || (p_size % 10) || 'ab, Town'").alias("a"))
    return p.select("p_partkey", text.comparable_title("t").alias("title"), text.extract_postcode(F.lit(None).cast("string"), "a").alias("postcode"))


@query("with t as (select c_custkey, ['Idox', 'Arcus', 'Ocella', 'Civica', 'Unknown', 'Atrium'][c_custkey % 6 + 1] s, case when c_custkey % 50 = 0 then 'Wiltshire' when c_custkey % 50 = 1 then 'Kirklees' when c_custkey % 50 = 2 then 'Surrey' else 'Town' end a from customer) select c_custkey, case when a = 'Wiltshire' then 'wiltshire' when a = 'Surrey' then 'authority:atrium' when s = 'Arcus' then 'arcus' when s = 'Atrium' then 'atrium' when a = 'Kirklees' then 'queryform' when s = 'Unknown' then 'generic' else lower(s) end adapter, case when a = 'Surrey' then 'planit' when a = 'Wiltshire' then 'salesforce' when s = 'Unknown' then 'custom' else lower(s) end platform from t")
def adapter_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").select("c_custkey", F.expr("element_at(array('Idox', 'Arcus', 'Ocella', 'Civica', 'Unknown', 'Atrium'), cast(c_custkey % 6 + 1 as int))").alias("s"), F.expr("case c_custkey % 50 when 0 then 'Wiltshire' when 1 then 'Kirklees' when 2 then 'Surrey' else 'Town' end").alias("a"))
    return t.select("c_custkey", text.adapter("a", "s", F.lit("unknown"), F.lit("")).alias("adapter"), text.platform("a", "s", F.lit("unknown")).alias("platform"))


@query("select s_nationkey, 'P/AB/2026/' || s_suppkey reference, s_name || ' Road' address, 'Gates for ' || s_suppkey description, 'Granted' decision from supplier")
def free_text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records cut from running text by one pattern."""
    line = F.expr("'P/AB/2026/' || s_suppkey || ' Location: ' || s_name || ' Road  Proposal: Gates for ' || s_suppkey || ' Decision: Granted Decision Date: View this application '")
    p = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(line), "").alias("t"))
    return L.free_text_records(p, "t", "cced").select("s_nationkey", "reference", "address", "description", "decision")


@query("select s_nationkey, s_suppkey::varchar reference, s_name address, 'Gates ' || s_suppkey description, '2026-06-05' date_received from supplier")
def listing_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = "'<a href=\"/OnlinePlanningOverview?applicationNumber=' || s_suppkey || '\">'"
    card = F.expr(f"{a} || s_name || '</a>' || {a} || 'No ' || s_suppkey || ' | Registered: 05/06/2026</a>' || {a} || 'Gates ' || s_suppkey || '</a>'")
    p = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(card), "").alias("html"))
    return L.cards(html.nodes(p, "s_nationkey"), F.lit("https://h.example/x"), key="s_nationkey").select("s_nationkey", "reference", "address", "description", "date_received")


@query("select s_nationkey, 'R' || s_suppkey || '.pdf' title, 'https://h.example/pr/sfc/servlet.shepherd/version/download/v' || s_suppkey url, s_acctbal::bigint::varchar file_size from supplier")
def content_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.expr("named_struct('Id', 'v' || s_suppkey, 'Title', 'R' || s_suppkey, 'FileExtension', 'PDF', 'ContentSize', cast(cast(bround(s_acctbal) as bigint) as string))")
    p = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(r)).alias("j"))
    return D.content_versions(p, "j", F.lit("https://h.example/pr/s/detail/1"), "s_nationkey").select("s_nationkey", "title", "url", "file_size")


@query("select s_nationkey, 'Plan ' || s_suppkey title, 'https://h.example/ctx/getfile?id=' || s_suppkey url, 'Plan' document_type from supplier")
def publisher_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.expr("array('Plan', '05/06/2026', 'Plan ' || s_suppkey, '01/01/2020', '/getfile?id=' || s_suppkey)")
    p = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(r)).alias("j"))
    return D.publisher_rows(p, "j", F.lit("https://h.example/a/b"), F.lit("/ctx"), "s_nationkey").select("s_nationkey", "title", "url", "document_type")


_APP_URL = "case page_id % 4 when 0 then 'https://h.example/applicationDetails.do?keyVal=K' || page_id || '&activeTab=summary' when 1 then 'https://h.example/planning/display/' || page_id when 2 then 'https://h.example/search/advanced' else 'https://h.example/x/' || page_id end"


@query(f"with p as (select page_id, {_APP_URL} u from pages) select page_id, case page_id % 4 when 0 then replace(u, 'summary', 'documents') || ' ' || u when 2 then '' else u end sources, page_id % 4 = 2 listing from p")
def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, none = F.expr(_APP_URL), F.lit(None).cast("string")
    p = table(spark, sf_dir, "pages").select("page_id", u.alias("u"))
    return p.select("page_id", F.array_join(D.document_sources(none, none, F.col("u"), none, none), " ").alias("sources"), D.is_listing_url(F.col("u")).alias("listing"))


@query("select n_name authority, case when n_nationkey % 4 = 0 then 'idox' when n_nationkey % 4 = 1 then 'northgate' else 'unknown' end portal_family, case when n_nationkey % 4 = 0 then 'https://h.example' when n_nationkey % 4 = 1 then 'https://h.example/p' else '' end base_url, n_nationkey % 3 = 0 link_test_ok from nation where n_regionkey != 2")
def catalogue_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as area records; one region is of an excluded type."""
    n = table(spark, sf_dir, "nation")
    a = n.select(F.col("n_nationkey").alias("ordinal"), F.col("n_nationkey").cast("string").alias("area_id"), F.col("n_name").alias("area_name"), F.lit(None).cast("string").alias("long_name"), F.when(F.col("n_regionkey") == 2, "Crown Dependency").otherwise("Council").alias("area_type"), F.lit("E1").alias("gss_code"), F.expr("element_at(array('Idox', 'PlanningExplorer', '', cast(null as string)), cast(n_nationkey % 4 + 1 as int))").alias("scraper_type"), F.expr("case n_nationkey % 4 when 0 then 'https://h.example/search.do' when 1 then 'https://h.example/p/Search/x' end").alias("planning_url"), F.lit("{}").alias("borders"))
    t = n.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("area_name"), F.lit(True).alias("ok"), F.lit(200).alias("status"), F.lit("u").alias("final_url"), F.lit(True).alias("tls_verified"))
    return C.features(a.unionByName(a), t).select("authority", "portal_family", "base_url", "link_test_ok")


@query("select o_orderkey, case when o_orderkey % 5 = 0 then '1990-01-01' when o_orderkey % 5 = 1 then '' else strftime(o_orderdate, '%Y-%m-%d') end date_received, o_orderkey % 5 = 0 date_inferred from orders")
def infer_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    a = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 1, day).otherwise("").alias("date_received"), F.when(F.col("o_orderkey") % 5 == 1, day).alias("date_validated"))
    return L.infer_dates(a, F.lit("1990-01-01")).select("o_orderkey", "date_received", "date_inferred")


@query("with a as (select *, l_linenumber * 100000000 + l_partkey * 10 + ascii(l_returnflag) % 10 attempt from lineitem) select l_orderkey, max_by(l_returnflag, attempt) error, max_by(l_partkey, attempt) n, count(*) > 1 retried from a group by l_orderkey")
def final_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as attempts: the last of each order counts."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("authority"), F.expr("l_linenumber * 100000000 + l_partkey * 10 + ascii(l_returnflag) % 10").alias("attempt"), F.col("l_returnflag").alias("error"), F.col("l_partkey").alias("n"))
    return L.final_attempts(a).select(F.col("authority").alias("l_orderkey"), "error", "n", "retried")


@query("with g as (select user_id, max(d) gap, max(s) - min(s) span from (select user_id, epoch(ts)::bigint s, epoch(ts)::bigint - lag(epoch(ts)::bigint) over (partition by user_id order by ts) d from events) group by user_id) select user_id, case when gap > 200000 then 'inactive' else 'too long' end reason from g where gap > 200000 or span > 2000000")
def slow_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("attempt"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return L.slow_attempts(e, 200_000, 2_000_000).select(F.col("attempt").alias("user_id"), "reason")


@query("select lang, sha256(text) digest, count(*) n from documents group by lang, sha256(text) having count(*) > 1")
def repeated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that a source gave more than once."""
    return L.repeated_pages(table(spark, sf_dir, "documents"), "lang", "text").select("lang", "digest", "n")


@query("select c_custkey, [c_name, 'Gates'] keywords from customer")
def keyword_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit(' "'), "c_name", F.lit('"\r\n\n“Gates”\nGATES\n'))
    return table(spark, sf_dir, "customer").select("c_custkey", text.parse_keywords(t).alias("keywords"))


@query("select s_nationkey, 'g' || s_suppkey uid, s_name reference, case when s_suppkey % 2 = 0 then '2026-06-05' end date_received from supplier")
def grid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute lists of an entity grid."""
    r = F.expr("named_struct('Id', 'g' || s_suppkey, 'Attributes', array(named_struct('Name', 'new_name', 'DisplayValue', s_name), named_struct('Name', 'new_registration_date', 'DisplayValue', if(s_suppkey % 2 = 0, '05/06/2026', cast(null as string)))))")
    p = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(r).alias("Records"))).alias("body"))
    return payloads.grid_applications(p).select("s_nationkey", "uid", "reference", "date_received")


@query("select page_id, 'https://h.example/DownloadDocument?id=' || page_id last, 3::bigint n from pages")
def document_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", urls.document_candidates(F.concat(F.lit("https://h.example/a/ViewDocument?id="), F.col("page_id").cast("string"))).alias("c"))
    return p.select("page_id", F.element_at("c", -1).alias("last"), F.size("c").cast("long").alias("n"))


@query("with o as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) k from orders) select o_custkey, list(case when k = 1 then 'plan.pdf' else 'plan-' || k || '.pdf' end order by k) names from o group by o_custkey")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of one folder made unique."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.lit("plan.pdf")).alias("n"))
    return o.select("o_custkey", files.unique_names(F.col("n")).alias("names"))


from registrum.plans import document_queries, function_queries, portal_queries, run_queries, search_queries  # noqa: E402, F401  they register themselves

__all__ = ["ORACLES", "QUERIES"]

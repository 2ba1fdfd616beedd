"""Registered queries of searches and runs: the lead predicate, merges, caches, sinks, the limiter, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.functions import dates, fixed, geometry, text
from registrum.operators import relations as R
from registrum.plans import catalogue, leads, runs
from registrum.plans.registered import query, table
from registrum.sources import payloads, sinks
from registrum.sources.scratch import scratch_path
from registrum.streaming import limiter

START, END = "1996-01-01", "1998-12-31"


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers and nations as applications: references, proposals, dates and exclusions of all kinds."""
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nations: an authority a row
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 10
    return o.select(
        F.col("n_name").alias("authority"), F.col("n_nationkey").alias("target_ordinal"), F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("uid"),
        F.when(k == 1, F.concat(F.lit(" Old/"), F.col("o_custkey").cast("string"))).when(k == 2, " ").otherwise(F.concat(F.lit("R"), F.col("o_custkey").cast("string"))).alias("reference"),
        F.when(k == 3, "https://u").otherwise(" ").alias("url"), F.lit("https://s").alias("source_url"), F.col("c_name").alias("address"),
        F.when(k == 4, "Discharge of condition for gates").when(k == 5, "Retrospective gates").when(k == 6, "A garden shed").otherwise(F.concat(F.lit("New GATES "), "c_mktsegment")).alias("description"),
        F.when(k == 7, "").otherwise(day).alias("date_received"), F.when(k == 7, day).alias("date_validated"),
        F.when(k == 8, '{"portal_url":"https://p","docs_url":"https://d"}').when(k == 9, '{"docs_url":" ","source_url":"https://raw"}').otherwise("{}").alias("raw"),
    )


_APPLICATIONS = f"""select n_name authority, n_nationkey target, o_orderkey ordinal, o_orderkey % 10 k, o_custkey, c_name address, strftime(o_orderdate, '%Y-%m-%d') d, c_mktsegment seg,
  case when o_orderkey % 10 = 2 then 'u' || o_orderkey else 'R' || o_custkey end ref, o_orderdate::date between date '{START}' and date '{END}' and o_orderkey % 10 not in (1, 4, 5, 6) hit
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"""


@query(f"""with a as ({_APPLICATIONS}), f as (select * from a where hit qualify row_number() over (partition by ref order by target, ordinal) = 1)
select ref "Reference", address, case k when 3 then 'https://u' when 8 then 'https://p' when 9 then 'https://raw' else 'https://s' end "application link", 'New GATES ' || seg proposal, d "date received", authority council from f""")
def lead_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published leads of a search: the whole predicate, first wins, links in order of trust, blanks for nulls."""
    return leads.leads(applications(spark, sf_dir), None, START, END, ["gates"])


@query(f"with a as ({_APPLICATIONS}) select authority, count(*) total, count(*) filter (where hit) relevant, count(*) filter (where hit) / count(*)::double ratio from a group by authority")
def lead_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel over the whole lead predicate, both exclusions included."""
    hit = leads.matches(START, END, ["Gates"], ["reference", "address", "description", "raw"])
    return leads.funnel(applications(spark, sf_dir).withColumn("hit", hit), "authority", "hit")


@query("""with a as (select n_nationkey, n_name, n_nationkey % 9 = 0 failed, (select count(*) from customer where c_nationkey = n_nationkey and c_acctbal > 5000) n from nation),
l as (select count(*) r, count(distinct case when o_orderstatus = 'F' then o_custkey end) d from orders where o_totalprice > 100000)
select 'Custom' kind, sum(n)::bigint total, any_value(r)::bigint relevant, case when sum(n) = 0 then 0 else round(100.0 * any_value(r) / sum(n), 2) end percent, string_agg(n_name, '; ' order by n_nationkey) filter (where failed) failed, 'Failed' completion, any_value(d)::bigint documents from a, l""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history row with its percentage and the leads that have documents, over whole tables."""
    n = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    a = table(spark, sf_dir, "nation").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("authority"), F.col("n_nationkey").alias("ordinal"), F.lit(1).alias("attempt"), (F.col("n_nationkey") % 9 == 0).alias("failed"), F.coalesce("n", F.lit(0)).alias("n"))
    found = table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("Reference"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(0).alias("n_documents"))
    h = leads.run_summary(a, found, ["gates"], "2020-01-02", "03:04:05")
    c = lambda i: F.col(f"`{fixed.HISTORY_COLUMNS[i]}`")
    return h.select(c(2).alias("kind"), c(3).alias("total"), c(4).alias("relevant"), F.regexp_replace(c(5), "%", "").cast("double").alias("percent"), c(6).alias("failed"), c(8).alias("completion"), c(9).alias("documents"))


_MERGE = """with m as (select o_custkey k, o_orderkey id, case when o_orderkey % 3 = 0 then null else 'R' || o_custkey end reference, 'R' || o_custkey uid, case when o_orderkey % 4 = 0 then '' else 'main' end address from orders where o_orderstatus = 'F'),
f as (select o_custkey k, o_orderkey id, 'R' || o_custkey kk, case when o_orderkey % 2 = 0 then 'feed ' || o_orderkey end address from orders where o_orderstatus = 'O'),
fa as (select kk, min_by(address, id) filter (where address is not null) address, min(id) id from f group by kk),
ml as (select *, row_number() over (partition by uid order by id desc) = 1 last from m)"""


@query(_MERGE + """ select ml.id, case when ml.address = '' then case when last then fa.address end else ml.address end address, true from_main, last and fa.kk is not null supplemented from ml left join fa on ml.uid = fa.kk
union all select fa.id, fa.address, false, false from fa where kk not in (select uid from m)""")
def merge_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main rows and a feed on reference or uid, with null, blank and repeated keys on both sides."""
    o = table(spark, sf_dir, "orders")
    ref = F.concat(F.lit("R"), F.col("o_custkey").cast("string"))
    m = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(ref, F.lit(" "))).alias("reference"), ref.alias("uid"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise("main").alias("address"))
    f = o.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), ref.alias("reference"), F.lit("x").alias("uid"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("feed "), F.col("o_orderkey").cast("string"))).alias("address"))
    return R.merge_fallback(m, f, "reference", ["address"], None, ["uid"], ["id"]).select("id", "address", "from_main", "supplemented")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'detail' else 'stub' end a, 'stub' b, case when o_orderkey % 3 = 0 then 'detail' end c, 'P' || o_orderkey portal_url from orders")
def raw_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw maps of stub and detail merged, provenance keys over both."""
    o = table(spark, sf_dir, "orders")
    stub = F.create_map(F.lit("a"), F.lit("stub"), F.lit("b"), F.lit("stub"), F.lit("portal_url"), F.lit("old"))
    detail = F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("a"), F.lit("detail"), F.lit("c"), F.lit("detail")))
    m = R.provenance(stub, detail, portal_url=F.concat(F.lit("P"), F.col("o_orderkey").cast("string")), scraper_type=F.lit(None))
    return o.select("o_orderkey", m.alias("m")).select("o_orderkey", *[F.col("m")[k].alias(k) for k in ("a", "b", "c", "portal_url")])


@query("with e as (select event_id, user_id, case when event_id % 3 > 0 then 'K' || user_id end k, event_type from events), s as (select *, coalesce(k, event_type || '|' || user_id) s from e) select event_id from s qualify row_number() over (partition by s order by event_id) = 1")
def signature_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First wins on a key, or on the whole record where it has none."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("K"), F.col("user_id").cast("string"))).alias("Id"), "user_id", "event_type")
    return R.first_wins(e.withColumn("s", R.signature("Id", of=["event_type", "user_id"])), ["s"], ["event_id"]).select("event_id")


@query("select s_suppkey, s_name, s_nationkey from supplier where exists (select 1 from nation where n_regionkey = 2 and s_suppkey % 37 + 0.25 <= n_nationkey * 1.5 + 2.5 and n_nationkey * 1.5 <= s_suppkey % 37 + 1.75) union all select s_suppkey, s_name, s_nationkey from supplier where exists (select 1 from nation where n_regionkey = 2 and s_suppkey % 37 + 0.25 <= n_nationkey * 1.5 + 2.5 and n_nationkey * 1.5 <= s_suppkey % 37 + 1.75)")
def repeated_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spatial semi-join keeps equal rows as many as they are; one area spans many cells."""
    box = lambda x, w: geometry.box_ring(x, F.lit(-500.0), x + w, F.lit(500.0))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", (F.col("s_suppkey") % 37 + 0.25).alias("x"))
    n = table(spark, sf_dir, "nation").filter("n_regionkey = 2").select((F.col("n_nationkey") * 1.5).cast("double").alias("x"))
    l = leads.boxed(s.unionByName(s), box(F.col("x"), 1.5))
    return R.spatial_semi_join(l, leads.boxed(n, box(F.col("x"), 2.5)), 0.5).select("s_suppkey", "s_name", "s_nationkey")


@query("with p as (select c_custkey, (c_custkey % 101) / 2.0 + 0.2 x, (c_custkey % 67) / 3.0 + 0.05 y from customer) select c_custkey from p where exists (select 1 from supplier where p.x > s_suppkey % 41 and p.x < s_suppkey % 41 + 1.5 and p.y > s_suppkey % 23 + 0.1 and p.y < s_suppkey % 23 + 0.9)")
def points_in_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in any of many areas, which meet in grid cells."""
    p = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 101 / 2.0 + 0.2).alias("x"), (F.col("c_custkey") % 67 / 3.0 + 0.05).alias("y"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 41 + 0.0).alias("x"), (F.col("s_suppkey") % 23 + 0.1).alias("y"))
    areas = leads.boxed(s, geometry.box_ring(F.col("x"), F.col("y"), F.col("x") + 1.5, F.col("y") + 0.8))
    return R.points_in_areas(p, areas, "x", "y", 0.5, few=1).select("c_custkey")


@query("select c_custkey from customer where c_acctbal > 0 and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P' or o_totalprice < 50000)")
def open_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that none of a run's completed ones covers."""
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' or o_totalprice < 50000").select(F.col("o_custkey").alias("c_custkey"))
    return R.anti(table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey"), done, ["c_custkey"])


@query("""with recursive e as (select user_id::varchar platform, floor(epoch(ts))::double t, event_id, case event_type when 'click' then 'success' when 'view' then 'success' when 'purchase' then 'service_unavailable' else case when event_id % 2 = 0 then 'rate_limited' else 'blocked' end end signal,
  row_number() over (partition by user_id order by floor(epoch(ts)), event_id) i from events),
s as (select platform, 0::bigint i, 2 lim, 0::double blocked, 0 streak, 0 bad, 0::double t, 0::bigint event_id, '' signal, false adjusted from e where i = 1
union all select e.platform, e.i,
  case when e.signal = 'success' then case when lim < 2 and streak + 1 >= 4 then lim + 1 else lim end when e.signal = 'service_unavailable' then case when bad = 1 then greatest(1, lim - 1) else lim end else greatest(1, lim - 1) end,
  case when e.signal = 'success' then blocked when e.signal = 'service_unavailable' then case when bad = 1 then greatest(blocked, e.t + 8) else blocked end when e.signal = 'rate_limited' then greatest(blocked, e.t + 15) else greatest(blocked, e.t + 8) end,
  case when e.signal = 'success' and lim < 2 and streak + 1 < 4 then streak + 1 else 0 end,
  case when e.signal = 'success' then 0 when e.signal = 'service_unavailable' then 1 - bad else bad end, e.t, e.event_id, e.signal,
  case when e.signal = 'success' then lim < 2 and streak + 1 >= 4 when e.signal = 'service_unavailable' then bad = 1 else true end
  from s join e on e.platform = s.platform and e.i = s.i + 1)
select platform, t "at", event_id, signal, lim "limit", blocked blocked_until, adjusted from s where i > 0""")
def limiter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limiter's state after every event, platform by platform."""
    names = {"click": "success", "view": "success", "purchase": "service_unavailable"}
    signal = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()], F.when(F.col("event_id") % 2 == 0, "rate_limited").otherwise("blocked"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("platform"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"), "event_id", signal.alias("signal"))
    return limiter.replay(e)


@query("select c_custkey, case when c_custkey % 3 = 0 then 'planit' else 'civica' end platform from customer")
def failure_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which platform a failure counts against."""
    e = F.when(F.col("c_custkey") % 3 == 0, "HTTP 429 from https://WWW.planit.org.uk/api").otherwise("HTTP 503 from https://x")
    return table(spark, sf_dir, "customer").select("c_custkey", text.failure_platform(e, F.lit("civica")).alias("platform"))


@query("with t as (select n_nationkey k, n_regionkey r, row_number() over (partition by n_regionkey order by n_nationkey) i from nation) select n_nationkey::varchar item, ((i - 1) // 2)::double started from t join nation on n_nationkey = k")
def dispatched_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorities of five platforms, each with hosts of its own: two run at once on a platform."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("item"), F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("platform"), F.concat(F.lit("h"), F.col("n_nationkey").cast("string")).alias("host"), F.col("n_nationkey").alias("ordinal"))
    return limiter.dispatch(n).select("item", "started")


@query("select o_orderkey, o_orderkey % 5 = 0 failed, case when o_orderkey % 7 = 0 then null else 'R' || o_orderkey end reference from orders")
def exported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows exported as CSV with a header and read again: nulls are blank, text is quoted as needed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5 == 0).alias("failed"), F.when(F.col("o_orderkey") % 7 > 0, F.concat(F.lit("R"), F.col("o_orderkey").cast("string"))).alias("reference"), F.lit('a "quoted", text').alias("note"))
    path = scratch_path(spark, "export")
    sinks.write_csv(o, path, escape='"')
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.filter("note = 'a \"quoted\", text'").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), (F.col("failed") == "true").alias("failed"), F.nullif("reference", F.lit("")).alias("reference"))


@query("""select 'Nations' council, 5::bigint columns, 25::bigint n union all select 'history', 10, 2 union all select 'leads', 6, (select count(*) from nation)""")
def published_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads, failures and two history rows written by their sinks: columns and rows read again."""
    n = table(spark, sf_dir, "nation")
    lead = n.select(*[F.col("n_name").alias(c) for c in fixed.APPLICATION_COLUMNS])
    failed = n.select(*[F.col("n_name").alias(c) for c in fixed.FAILURE_COLUMNS])
    history = spark.range(1).select(*[F.lit(str(i)).alias(c) for i, c in enumerate(fixed.HISTORY_COLUMNS)])
    paths = [scratch_path(spark, name) for name in ("failures", "history", "leads")]
    sinks.write_failures(failed, paths[0])
    sinks.append_history(history, paths[1])
    sinks.append_history(history, paths[1])
    sinks.write_applications(lead, paths[2])
    read = lambda p: spark.read.option("header", True).csv(p)
    rows = [read(p).agg(F.lit(name).alias("council"), F.lit(len(read(p).columns)).cast("long").alias("columns"), F.count("*").alias("n")) for name, p in zip(("Nations", "history", "leads"), paths)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("select n_nationkey, '{\"' || 'name\":\"' || n_name || '\"' || case when n_nationkey % 2 = 0 then ',\"ref\":\"r\"' else '' end || '}' json, case when n_nationkey % 3 = 0 then 'undated' else '2026-06-05' end || '/' || n_name || '/A B' folder from nation")
def lead_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of what is not empty, and the folder of a lead."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "r").otherwise("").alias("ref"), F.array().cast("array<string>").alias("docs"), F.when(F.col("n_nationkey") % 3 > 0, "2026-06-05").otherwise(" ").alias("d"))
    return n.select("n_nationkey", sinks.drop_empty_json("name", "ref", "docs").alias("json"), sinks.lead_folder(F.col("d"), F.col("name"), F.lit("A/B")).alias("folder"))


@query("select r_regionkey, count(*)::bigint features, '2026-01-02' generated_at, 'https://areas.example' source_url, string_agg(n_name, ',' order by n_name) names from nation join region on n_regionkey = r_regionkey group by r_regionkey")
def catalogue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue file for each region, read back."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("authority"), F.lit('{"type":"Polygon","coordinates":[]}').alias("borders"))
    parts = []
    for k in range(5):  # five regions, a file each
        f = sinks.catalogue_collection(n.filter(F.col("n_regionkey") == k), ["authority"], "borders", F.lit("2026-01-02"), "https://areas.example")
        parts.append(f.select(F.lit(k).alias("r_regionkey"), "json"))
    j = parts[0]
    for p in parts[1:]:
        j = j.unionByName(p)
    features = F.from_json(F.get_json_object("json", "$.features"), "array<string>")
    names = F.array_join(F.array_sort(F.transform(features, lambda x: F.get_json_object(x, "$.properties.authority"))), ",")
    return j.select("r_regionkey", F.size(features).cast("long").alias("features"), F.get_json_object("json", "$.generated_at").alias("generated_at"), F.get_json_object("json", "$.source_url").alias("source_url"), names.alias("names"))


@query("select n_nationkey, n_regionkey < 2 cached, n_regionkey > 0 ok from nation")
def record_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area records and link tests of a written cache come before those fetched or recorded earlier."""
    n = table(spark, sf_dir, "nation")
    area = lambda d, cached: d.select(F.col("n_nationkey").alias("ordinal"), F.col("n_nationkey").cast("string").alias("area_id"), F.col("n_name").alias("area_name"), F.lit("E").alias("gss_code"), F.lit(cached).alias("cached"))
    cache = runs.write_cache(area(n.filter("n_regionkey < 2"), True), scratch_path(spark, "areas"))
    areas = runs.cached_areas(cache, area(n, False))
    test = lambda d, ok: d.select(F.col("n_name").alias("area_name"), F.lit(ok).alias("ok"), F.lit("t").alias("tested_at"))
    tests = catalogue.link_tests(runs.write_cache(test(n.filter("n_regionkey > 0"), True), scratch_path(spark, "tests")), test(n, False))
    return areas.join(tests, "area_name").select(F.col("ordinal").alias("n_nationkey"), "cached", "ok")


@query("select count(*) n, sum(o_totalprice > 100000)::bigint large, max(o_orderkey) last, 'orders' stage from orders")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that a stage reports beside its result, in the same pass."""
    told: dict = {}
    config = runs.RunConfig(START, END, ("gates",), report=lambda stage, m: told.update({**m, "stage": stage}))
    df, o = runs.observed(table(spark, sf_dir, "orders"), "orders", large=F.sum((F.col("o_totalprice") > 100000).cast("long")), last=F.max("o_orderkey"))
    df.write.format("noop").mode("overwrite").save()
    runs.reported(config, "orders", o)
    return spark.createDataFrame([(told["rows"], told["large"], told["last"], told["stage"])], "n long, large long, last long, stage string")


@query("select p_partkey, case p_size % 4 when 0 then 'no date' when 1 then 'window' when 2 then 'keywords' end error from part")
def setting_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, "soon").when(k == 1, "2026-07-01").otherwise("2026-06-01").alias("s"), F.lit("2026-06-30").alias("e"), F.when(k == 2, ' "" \n').otherwise("gates").alias("w"))
    return runs.config_errors(p, "s", "e", "w").select("p_partkey", "error")


@query("select o_orderkey, o_custkey % 3 kind from orders where o_custkey % 3 = 2 or (o_custkey % 3 = 0 and o_orderkey % 200 <= 100) or (o_custkey % 3 = 1 and o_orderkey % 200 <= 50)")
def capped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages within their family's cap; a family without one is read whole."""
    name = F.element_at(F.array(F.lit("idox"), F.lit("agile"), F.lit("other")), (F.col("o_custkey") % 3 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("kind"), name.alias("family"), (F.col("o_orderkey") % 200).alias("turn"))
    return runs.capped(o, spark.createDataFrame(fixed.CAPS, "family string, cap long"), "family", "turn").select("o_orderkey", "kind")


@query("select o_orderkey, case when o_orderkey % 6 = 0 then o_custkey when o_orderkey % 6 between 2 and 5 then o_custkey + 20 end next_offset, case when o_orderkey % 6 = 0 then 10 when o_orderkey % 6 between 2 and 5 then 20 end next_size from orders where o_orderkey % 6 != 5 union all select o_orderkey, null, null from orders where o_orderkey % 6 = 5")
def area_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a paged scan asks next: halved pages, the next page, or nothing."""
    k = F.col("o_orderkey") % 6
    log = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("offset"), F.lit(20).alias("size"), (k == 0).alias("too_large"), F.when(k == 1, 0).otherwise(20).alias("n"), (F.col("o_custkey") + 19).alias("to"), F.when(k == 5, F.col("o_custkey") + 20).otherwise(10_000_000).alias("total"))
    r = payloads.area_requests(log)
    return r.select("o_orderkey", F.col("next_offset").cast("long").alias("next_offset"), F.col("next_size").cast("int").alias("next_size"))


@query(f"select o_orderkey, o_orderdate from orders where o_orderdate >= timestamp '{START}' and o_orderdate < timestamp '{END}' + interval 1 day order by o_orderdate desc, o_orderkey limit 100")
def pushed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds, order and limit that reach the scan (a top-k report)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    return payloads.pushed_window(o, "o_orderdate", START, END, 100).select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


@query("select s_nationkey, 'L' || s_nationkey search, 'D' || s_nationkey documents from supplier group by s_nationkey")
def form_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookups that a form's definition names."""
    f = F.expr("'{\"fields\":[{\"name\":\"Search_Results\",\"lookup\":\"L' || s_nationkey || '\"},{\"name\":\"documents\",\"lookup\":\"D' || s_nationkey || '\"},{\"name\":\"other\"}]}'")
    s = table(spark, sf_dir, "supplier").select("s_nationkey").distinct().withColumn("body", f)
    return payloads.form_definition(s, "body", {"search": "search_results", "documents": "documents"})


@query("select date '1995-01-01' + (k * 21)::int s, date '1995-01-21' + (k * 21)::int e, 42::bigint n from (values (0), (1), (2), (3)) v(k) union all select date '1995-03-26', date '1995-06-17', least(60, (select count(*) * 4 from nation))")
def gaining_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that are halved only while that brings more records: the later half has the same records every day."""
    day = F.date_add(F.lit("1995-01-01").cast("date"), F.col("i").cast("int"))
    few = table(spark, sf_dir, "nation").select(F.explode(F.sequence(F.col("n_nationkey") * 7, F.col("n_nationkey") * 7 + 6)).alias("i"))
    every = few.filter("i < 168").select(day.alias("day"), F.when(F.col("i") < 84, F.array(F.concat(F.lit("k"), F.lpad(F.col("i").cast("string"), 3, "0")), F.concat(F.lit("m"), F.lpad(F.col("i").cast("string"), 3, "0")))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(79)), lambda x: F.concat(F.lit("z"), F.lpad(x.cast("string"), 3, "0")))).alias("keys"))
    return R.gaining_windows(every, "1995-01-01", "1995-06-17", 60)


@query("select o_orderkey, case when o_orderkey % 2 = 0 then 'Idox' else 'Town' end authority, 'W' || o_orderkey week_key from orders where o_orderkey < 0 union all select o_orderkey, case when o_orderkey % 2 = 0 then 'idox' else 'custom' end, strftime(o_orderdate - interval ((dayofweek(o_orderdate) + 6) % 7) day, '%Y-%m-%d') from orders")
def platform_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The platform of an attempt and the Monday of its week."""
    d = F.col("o_orderdate").cast("date")
    p = text.platform(F.lit("Town"), F.when(F.col("o_orderkey") % 2 == 0, "Idox").otherwise(""), F.lit("unknown"))
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("authority"), F.date_format(F.get(dates.week_starts(d, d), F.lit(0)), "yyyy-MM-dd").alias("week_key"))


@query("select o_orderkey, ['P/' || lpad((y % 100)::varchar, 2, '0'), 'P/' || lpad(((y + 1) % 100)::varchar, 2, '0')] keywords from (select o_orderkey, year(o_orderdate) y from orders)")
def keyword_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of two years as the reference prefixes to search for."""
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.year_keywords(d, F.add_months(d, 12)).alias("keywords"))


@query("select s_nationkey, s_suppkey::varchar uid, s_name address, 'statmap' family from supplier")
def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads written as files, one a nation, and read again by the reader of stored payloads."""
    r = F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("address"), F.col("s_nationkey").alias("nation"))
    p = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(r).alias("records"))).alias("value"))
    path = scratch_path(spark, "payloads")
    p.write.partitionBy("s_nationkey").text(path)
    s = payloads.stored_payloads(spark, f"{path}/*", "statmap")
    a = payloads.applications(s.withColumn("s_nationkey", F.get_json_object("body", "$.records[0].nation").cast("int")), "statmap")
    return a.select("s_nationkey", "uid", "address", "family")


@query("select distinct o_custkey::varchar \"Reference\", 'found' council from orders")
def streamed_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads appended by a stream as they are found, each reference once; the stream ends with its input."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("Reference"), F.lit("found").alias("council"), F.lit("2026-06-05 10:00:00").cast("timestamp").alias("at"))
    given, out, state = (scratch_path(spark, n) for n in ("found", "appended", "state"))
    o.write.parquet(given)
    sinks.stream_applications(spark.readStream.schema(o.schema).parquet(given), out, state, "at").awaitTermination(600)
    return spark.read.schema(o.schema).parquet(out).select("Reference", "council")

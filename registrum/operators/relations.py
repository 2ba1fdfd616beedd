"""Order-aware distinct, overlays, merges, spatial semi-joins and window generators."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from datetime import date, timedelta
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registrum.functions import geometry as G
from registrum.functions.text import blank_to_null

#: Columns that a fallback row, or a stub, fills where the main row has none.
FALLBACK_COLUMNS = ["address", "description", "status", "decision", "date_received", "date_validated", "postcode"]
OVERLAY_COLUMNS = ["reference", *FALLBACK_COLUMNS[:2], *FALLBACK_COLUMNS[2:6], "applicant_name", "agent_name", "case_officer", "ward", "parish", "postcode"]
#: Areas are broadcast up to this many, which is counted first.
BROADCAST_ROWS = 64
#: Parts that the keys of one window are dealt into before the first ones are taken.
SALT = 64
#: Ranges of ordered rows for each shuffle partition, so that tasks that get several are alike.
SPREAD = 4


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first by order. Only (order, key) meet per key, by a map-side aggregate, not a sort of whole rows."""
    cols = df.columns
    row = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in cols]).alias("_row"))
    if any(t.startswith(("map", "variant")) for _, t in df.dtypes):
        w = Window.partitionBy(*key).orderBy(*order)
        return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min(row).alias("_m")).select("_m._row.*")


def last_wins(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def union_distinct(parts: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """Parts in order, one row a key: the first part wins, then order."""
    marked = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    return first_wins(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked), key, ["_part", *order]).drop("_part")


def overlay(stubs: DataFrame, details: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Every stub; details come first, the stub fills what they lack. found tells whether there was a detail row."""
    d = details.select(*key, *[F.col(c).alias(f"_d_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = stubs.join(d, key, "left")
    filled = {c: F.coalesce(_text_or(f"_d_{c}", out), F.col(c)) for c in columns}
    return out.withColumns({**filled, "found": F.coalesce("_hit", F.lit(False))}).drop("_hit", *[f"_d_{c}" for c in columns])


def _text_or(c: str, df: DataFrame) -> Column:
    return F.nullif(F.col(c), F.lit("")) if dict(df.dtypes)[c] == "string" else F.col(c)


def merge_fallback(main: DataFrame, fallback: DataFrame, key: str, columns: list[str], scope: list[str] | None = None, also: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Full outer merge within scope on the trimmed key, or the first of also where it is blank.

    Every main row stays; of equal keys the last by order is filled in columns, from the first fallback row that has a value.
    Fallback rows without a main row follow, one a key, filled alike. Rows without any key meet nothing. from_main and
    supplemented mark where a row is from and whether a fallback row met it. order: columns; none: all of them.
    """
    scope, also = scope or [], also or []
    name = F.coalesce(*[blank_to_null(c) for c in (key, *also)])
    place = lambda d: F.struct(*[F.col(c) for c in order or sorted(c for c, t in d.dtypes if not t.startswith(("map", "variant")))])
    text = lambda d, c: blank_to_null(c) if dict(d.dtypes)[c] == "string" else F.col(c)
    held = [c for c in main.columns if c not in scope]
    f = fallback.withColumns({"_k": name, "_o": place(fallback)})
    first = {c: F.min_by(text(f, c), F.when(text(f, c).isNotNull(), F.col("_o"))) if c in columns else F.min_by(c, "_o") for c in held if c in fallback.columns}
    folded = f.filter("_k is not null").groupBy(*scope, "_k").agg(*[v.alias(f"f_{c}") for c, v in first.items()], F.lit(True).alias("_f"))
    loose = f.filter("_k is null").select(*scope, F.lit(None).cast("string").alias("_k"), *[F.col(c).alias(f"f_{c}") for c in first], F.lit(True).alias("_f"))
    m = main.withColumns({"_k": name, "_o": place(main)})
    last = F.row_number().over(Window.partitionBy(*scope, "_k").orderBy(F.desc("_o"))) == 1
    m = m.withColumn("_last", F.col("_k").isNotNull() & last).withColumn("_m", F.lit(True)).drop("_o").withColumnsRenamed({c: f"m_{c}" for c in held})
    met = m.withColumn("_k", F.when(F.col("_last"), F.col("_k"))).drop("_last")
    j = met.filter("_k is not null").join(folded, [*scope, "_k"], "full").unionByName(met.filter("_k is null"), allowMissingColumns=True).unionByName(loose, allowMissingColumns=True)

    def pick(c: str) -> Column:
        if c not in first:
            return F.col(f"m_{c}")
        kind = dict(main.dtypes)[c]
        own = blank_to_null(f"m_{c}") if kind == "string" and c in columns else F.col(f"m_{c}")
        return F.coalesce(own, F.col(f"f_{c}")) if c in columns else F.when(F.col("_m"), own).otherwise(F.col(f"f_{c}"))

    flag = lambda c: F.coalesce(c, F.lit(False))
    return j.select(*scope, *[pick(c).alias(c) for c in held], flag(F.col("_m")).alias("from_main"), flag(F.col("_m") & F.col("_f")).alias("supplemented"))


def conditional_fallback(status: DataFrame, main: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Main rows, and fallback rows of those authorities whose main source failed, was empty, or is marked feed_first.

    status: key, failed, feed_first. One aggregate of main decides; no row is read twice.
    """
    n = main.groupBy(key).agg(F.count("*").alias("_n"))
    use = status.join(n, key, "left").filter(F.col("failed") | F.col("feed_first") | F.col("_n").isNull()).select(key)
    return main.unionByName(fallback.join(use, key, "left_semi"), allowMissingColumns=True)


def first_alias(rows: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """rows of the first alias that has any. aliases: authority, ordinal, name."""
    held = aliases.join(rows.select(name).distinct(), name, "left_semi")
    best = held.groupBy("authority").agg(F.min_by(name, "ordinal").alias(name))
    return rows.join(best, name).withColumnRenamed(name, "alias")


#: Grid levels; a box stands in the cells of the level at which its longer side is at most one cell, so in four at most.
LEVELS = 24


def _level(cell: float) -> Column:
    side = F.greatest(F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0"))
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(F.greatest(side / cell, F.lit(1.0)))).cast("int")))


def _levels(df: DataFrame) -> list[int]:
    """Levels that df's boxes have, LEVELS at most."""
    return sorted(r[0] for r in df.select("_level").distinct().collect())


def _cells(df: DataFrame, cell: float, levels: list[int]) -> DataFrame:
    """A row for each cell a box meets at its own level and at coarser ones of levels; _own tells which."""
    at = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x >= F.col("_level"))
    d = df.withColumn("_at", F.explode(at)).withColumn("_size", F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_at")))
    span = lambda a, b: F.sequence(F.floor(F.col(f"box.{a}") / F.col("_size")), F.floor(F.col(f"box.{b}") / F.col("_size")))
    d = d.withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1")))
    return d.withColumn("_own", F.col("_at") == F.col("_level")).drop("_size")


def spatial_semi_join(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """left rows whose geometry meets any of right's. Both have geometry and box; grid cells of their boxes meet first.

    Distinct geometries are joined, so equal rows stay as many as they are. A box meets another in the cells of the coarser
    one's level: that makes an equi-join in which no box has more than four cells a level, however large it is. Geometries
    that are null meet nothing.
    """
    l = left.select("geometry", "box").filter("geometry is not null").distinct().withColumn("_level", _level(cell))
    r = right.select("geometry", "box").filter("geometry is not null").distinct().withColumn("_level", _level(cell))
    levels = sorted({*_levels(l), *_levels(r)})
    if not levels:
        return left.limit(0)
    a = _cells(l, cell, levels)
    b = _cells(r, cell, levels).select(F.col("geometry").alias("_g"), F.col("box").alias("_b"), "_at", "_cx", "_cy", F.col("_own").alias("_o"))
    met = a.join(b, (a["_at"] == b["_at"]) & (a["_cx"] == b["_cx"]) & (a["_cy"] == b["_cy"]) & (a["_own"] | b["_o"]) & G.geometries_intersect(a["geometry"], b["_g"], a["box"], b["_b"]), "left_semi")
    return left.join(met.select("geometry").distinct(), "geometry", "left_semi").select(left.columns)


def points_in_areas(points: DataFrame, areas: DataFrame, x: str, y: str, cell: float = 0.5, few: int = BROADCAST_ROWS) -> DataFrame:
    """Rows whose point is in any area; rows without a point pass. areas: geometry, box.

    A few areas (counted first) are broadcast; more of them meet the distinct points in grid cells, an equi-join.
    """
    px, py = F.col(x), F.col(y)
    located, loose = points.filter(px.isNotNull() & py.isNotNull()), points.filter(px.isNull() | py.isNull())
    a = areas.select("geometry", "box").filter("geometry is not null")
    inside = lambda u, v, g, b: u.between(b["x0"], b["x1"]) & v.between(b["y0"], b["y1"]) & G.point_in_geometry(u, v, g)
    if len(a.limit(few + 1).select(F.lit(1)).take(few + 1)) <= few:
        small = F.broadcast(a.select(F.col("geometry").alias("_g"), F.col("box").alias("_b")))
        return located.join(small, inside(px, py, F.col("_g"), F.col("_b")), "left_semi").unionByName(loose)
    a = a.withColumn("_level", _level(cell))
    levels = _levels(a)
    own = _cells(a, cell, levels).filter("_own").select(F.col("geometry").alias("_g"), F.col("box").alias("_b"), "_at", "_cx", "_cy")
    p = located.select(px.alias("_x"), py.alias("_y")).distinct().withColumn("_at", F.explode(F.array(*[F.lit(v) for v in levels])))
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_at"))
    p = p.withColumns({"_cx": F.floor(F.col("_x") / size), "_cy": F.floor(F.col("_y") / size)})
    met = p.join(own, (p["_at"] == own["_at"]) & (p["_cx"] == own["_cx"]) & (p["_cy"] == own["_cy"]) & inside(p["_x"], p["_y"], own["_g"], own["_b"]), "left_semi").select("_x", "_y").distinct()
    return located.join(met, (px == F.col("_x")) & (py == F.col("_y")), "left_semi").unionByName(loose)


def limit_per(df: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def _ranged(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """events with _part: parts of about equal size, in which the rows of a key are consecutive. However many rows a key has, they are spread."""
    parts = SPREAD * int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id())


def _numbered(local: DataFrame, key: str, goes_on: Column, rows: str) -> DataFrame:
    """local (a row for each run of a key within a part: _part, _run from 1, _head and _tail) with run, its number over all parts, and before: rows of the key in earlier parts.

    Only borders are carried, a row for each key and part: goes_on tells from _tail of the part before and _head whether a run goes on.
    """
    p = local.groupBy(key, "_part").agg(F.min_by("_head", "_run").alias("_head"), F.max_by("_tail", "_run").alias("_last"), F.max("_run").alias("_runs"), F.sum(rows).alias("_rows"))
    w = Window.partitionBy(key).orderBy("_part")
    p = p.withColumn("_tail", F.lag("_last").over(w)).withColumn("_on", F.when(F.lag("_part").over(w).isNotNull() & F.coalesce(goes_on, F.lit(False)), 1).otherwise(0))
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.col("_runs") - F.col("_on")).over(earlier), F.lit(0)) - F.col("_on")
    p = p.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), base.alias("_base"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("before"))
    return local.join(p, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p"))).withColumn("run", F.col("_base") + F.col("_run")).drop("_k", "_p", "_base")


def gap_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions of a key split by inactivity: n, started, ended. Ranges of a key's rows are scanned alone, open sessions are carried over their borders.

    Times count in whole seconds, to the nearest (the even one of two), before the gap is taken, as SQL casts them.
    """
    order = [ts, "event_id"] if "event_id" in events.columns else [ts]
    d = _ranged(events.select(key, *order), key, order)
    w = Window.partitionBy("_part", key).orderBy(*order)
    seconds = lambda c: F.rint(F.unix_micros(c.cast("timestamp")) / 1_000_000).cast("long")
    fresh = F.coalesce((seconds(F.col(ts)) - seconds(F.lag(ts).over(w)) > gap_seconds).cast("int"), F.lit(1))
    d = d.withColumn("_f", fresh).withColumn("_run", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = d.groupBy(key, "_part", "_run").agg(F.count("*").alias("n"), F.min(ts).alias("started"), F.max(ts).alias("ended")).withColumns({"_head": F.col("started"), "_tail": F.col("ended")})
    s = _numbered(local, key, seconds(F.col("_head")) - seconds(F.col("_tail")) <= gap_seconds, "n")
    return s.groupBy(key, F.col("run").alias("session")).agg(F.sum("n").alias("n"), F.min("started").alias("started"), F.max("ended").alias("ended"))


def streaks(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal values in order: key, value, n and their first and last place. Scanned and carried like sessions."""
    d = _ranged(events.select(*dict.fromkeys([key, *order, value])), key, order)
    w = Window.partitionBy("_part", key).orderBy(*order)
    held = F.struct(F.col(value).alias("v"))
    d = d.withColumn("_i", F.row_number().over(w)).withColumn("_f", F.when(F.lag(held).over(w) == held, 0).otherwise(1))
    d = d.withColumn("_run", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = d.groupBy(key, "_part", "_run").agg(F.first(held).alias("_head"), F.count("*").alias("n"), F.min("_i").alias("first"), F.max("_i").alias("last")).withColumn("_tail", F.col("_head"))
    s = _numbered(local, key, F.col("_head") == F.col("_tail"), "n")
    r = s.groupBy(key, "run").agg(F.first("_head.v").alias(value), F.sum("n").alias("n"), F.min(F.col("first") + F.col("before")).cast("int").alias("first"), F.max(F.col("last") + F.col("before")).cast("int").alias("last"))
    return r.select(key, value, "n", "first", "last")


def bisect_windows(daily: DataFrame, start: str, end: str, cap: int) -> DataFrame:
    """s, e, n: windows from halving [start, end] while they hold over cap rows and more than a day. daily: day, n.

    Only the range's days with their counts reach the driver, one row a day however many rows there are.
    """
    days = daily.filter(F.col("day").between(start, end)).groupBy("day").agg(F.sum("n").alias("n")).orderBy("day").collect()
    at = [r["day"].toordinal() for r in days]
    before = [0, *accumulate(r["n"] for r in days)]
    count = lambda a, b: before[bisect_right(at, b)] - before[bisect_left(at, a)]
    todo, out = [(date.fromisoformat(start).toordinal(), date.fromisoformat(end).toordinal())], []
    while todo:
        a, b = todo.pop()
        if count(a, b) > cap and a < b:
            m = a + (b - a) // 2
            todo += [(m + 1, b), (a, m)]
        else:
            out.append((date.fromordinal(a), date.fromordinal(b), count(a, b)))
    return daily.sparkSession.createDataFrame(out, "s date, e date, n long")


def gaining_windows(daily: DataFrame, start: str, end: str, cap: int, keys: str = "keys") -> DataFrame:
    """s, e, n of a search that gives at most cap records of a window: a capped window is halved while that brings more records.

    daily: day, keys (the distinct record keys of the day); a record may come up on several days. n: what the window gives.
    A window is given up to its cap in the order of keys, so what a split gains is known from the keys alone; the first keys
    of salted parts meet in one task, SALT * cap of a window at most. Only windows and counts are kept on the driver; a level
    of the recursion is one query.
    """
    d = daily.select("day", F.explode(keys).alias("k"))
    todo, out = [(date.fromisoformat(start), date.fromisoformat(end))], []
    while todo:
        halves = {w: (w[0] + (w[1] - w[0]) // 2) for w in todo if w[0] < w[1]}
        asked = [*todo, *[x for w, m in halves.items() for x in ((w[0], m), (m + timedelta(days=1), w[1]))]]
        windows = d.sparkSession.createDataFrame([(i, s, e) for i, (s, e) in enumerate(asked)], "i int, s date, e date")
        given = d.join(F.broadcast(windows), F.col("day").between(F.col("s"), F.col("e"))).select("i", "k").distinct()  # a window a row
        given = limit_per(limit_per(given.withColumn("_s", F.pmod(F.xxhash64("k"), F.lit(SALT))), ["i", "_s"], ["k"], cap).drop("_s"), ["i"], ["k"], cap)
        count = {r["i"]: r["n"] for r in given.groupBy("i").agg(F.count("*").alias("n")).collect()}
        both = {w: (asked.index((w[0], m)), asked.index((m + timedelta(days=1), w[1]))) for w, m in halves.items()}
        split = d.sparkSession.createDataFrame([(i, asked.index(w)) for w, pair in both.items() for i in pair], "i int, w int")
        gain = {r["w"]: r["n"] for r in given.join(F.broadcast(split), "i").select("w", "k").distinct().groupBy("w").agg(F.count("*").alias("n")).collect()} if both else {}
        nxt = []
        for i, w in enumerate(todo):
            n = count.get(i, 0)
            if n < cap or w not in halves or gain.get(i, 0) <= n:
                out.append((*w, n))
            else:
                nxt += [asked[j] for j in both[w]]
        todo = nxt
    return daily.sparkSession.createDataFrame(out, "s date, e date, n long")


def signature(*cols: str, of: list[str]) -> Column:
    """The first of cols that is not blank, else the columns of as JSON: a key for rows that may lack one."""
    return F.coalesce(*[blank_to_null(F.col(c).cast("string")) for c in cols], F.to_json(F.struct(*of)))


def provenance(stub: Column, detail: Column, **keys: Column) -> Column:
    """Maps merged: the detail's entries over the stub's, then keys over both."""
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    empty = F.create_map().cast("map<string,string>")
    last = F.map_filter(F.create_map(*[x for k, v in keys.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    return over(over(F.coalesce(stub, empty), F.coalesce(detail, empty)), last)


def eav_pivot(items: DataFrame, key: list[str], order: str, name: str, value: str, names: list[str]) -> DataFrame:
    """Named columns from attribute rows; a later value of a name replaces an earlier one."""
    return items.groupBy(*key).agg(*[F.max_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, F.col(order))).alias(n) for n in names])


def anti(tasks: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return tasks.join(done.select(*key).distinct(), key, "left_anti")


def fair_order(tasks: DataFrame, platform: str, ordinal: str) -> DataFrame:
    """Round-robin over platforms in their first-seen order; adds turn and place (no single global sort is forced)."""
    turn = F.row_number().over(Window.partitionBy(platform).orderBy(ordinal))
    first = tasks.groupBy(platform).agg(F.min(ordinal).alias("_first"))
    return tasks.withColumn("turn", turn).join(first, platform).withColumnRenamed("_first", "platform_order")

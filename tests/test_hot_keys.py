"""Sessions and runs of a key that has all rows, and exports without a single task."""

import csv
import random
from datetime import datetime, timedelta
from itertools import groupby
from statistics import median

from pyspark.sql import functions as F

from registrum.functions import fixed
from registrum.operators import relations as R
from registrum.sources import sinks

START = datetime(2026, 1, 1)


def events(n, keys, seed=1):
    rng = random.Random(seed)
    rows, at = [], dict.fromkeys(keys, START)
    for i in range(n):
        k = rng.choice(keys)
        at[k] += timedelta(seconds=rng.choice([0, 10, 10, 500, 4000]))
        rows.append((i, k, None if rng.random() < 0.01 else at[k], rng.choice(["a", "a", "b", None])))
    return rows


def ordered(rows, key):
    return sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or START, r[0]))


def brute_sessions(rows, gap):
    for key in {r[1] for r in rows}:
        out = []
        for _, _, t, _ in ordered(rows, key):
            if out and t and out[-1][-1] and (t - out[-1][-1]).total_seconds() <= gap:
                out[-1].append(t)
            else:
                out.append([t])
        yield from ((key, i, len(s), s[0], s[-1]) for i, s in enumerate(out, 1))


def brute_streaks(rows):
    for key in {r[1] for r in rows}:
        place = 1
        for v, run in groupby(ordered(rows, key), key=lambda r: r[3]):
            n = len(list(run))
            yield key, v, n, place, place + n - 1
            place += n


def test_sessions_and_streaks(spark):
    for keys in ([7], [7] * 20 + [1, 2, None]):
        rows = events(1500, keys)
        d = spark.createDataFrame(rows, "event_id long, k int, ts timestamp_ntz, v string").repartition(5)
        got = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
        assert got(R.gap_sessions(d, "k", "ts", 600).select("k", "session", "n", "started", "ended")) == sorted(brute_sessions(rows, 600), key=repr)
        assert got(R.streaks(d, "k", ["ts", "event_id"], "v").select("k", "v", "n", "first", "last")) == sorted(brute_streaks(rows), key=repr)
    assert R.gap_sessions(d.limit(0), "k", "ts", 600).count() == R.streaks(d.limit(0), "k", ["ts"], "v").count() == 0


def test_one_key_is_spread(spark):
    d = spark.range(60_000).select(F.col("id").alias("event_id"), F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 10).alias("ts"))
    sizes = sorted(r["count"] for r in R._ranged(d, "k", ["ts"]).groupBy("_part").count().collect())
    assert len(sizes) >= 16 and sizes[-1] <= 2 * median(sizes)
    (s,) = R.gap_sessions(d, "k", "ts", 600).collect()
    assert (s["session"], s["n"]) == (1, 60_000)


def test_exports_in_order_without_one_task(spark, tmp_path):
    n = 20_000
    lead = spark.range(n).select(*[(F.concat(F.lit("C"), F.lpad((F.col("id") % 7).cast("string"), 2, "0")) if c == "council" else F.concat(F.lit('R "x",\n'), F.lpad(F.hash("id").cast("string"), 12, "0"))).alias(c) for c in fixed.APPLICATION_COLUMNS])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts would be joined
    try:
        sinks.write_applications(lead, str(tmp_path / "leads"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    m = sinks.manifest(spark, str(tmp_path / "leads")).collect()
    assert len(m) > 1 and all(r["bytes"] > 0 for r in m)
    assert sinks.join_parts(spark, str(tmp_path / "leads"), str(tmp_path / "leads.csv")) == len(m)
    with open(tmp_path / "leads.csv", newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == fixed.APPLICATION_COLUMNS and len(rows) == n + 1
    place = [(r[5], r[0]) for r in rows[1:]]
    assert place == sorted(place) and rows[1][1].startswith('R "x",\n')

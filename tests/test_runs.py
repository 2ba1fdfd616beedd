"""Settings, metrics, cancellation, families, stored payloads and merges."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from registrum.functions import geometry
from registrum.operators import relations as R
from registrum.plans import leads, runs
from registrum.sources import payloads
from registrum.sources.scratch import scratch_path


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def test_settings_are_checked(spark):
    assert runs.RunConfig("2026-01-01", "2026-01-01", ("gates",), workers=99).workers == 8
    for bad in (("2026-02-01", "2026-01-01", ("x",)), ("2026-01-01", "2026-01-02", (" ",)), ("soon", "2026-01-02", ("x",))):
        with pytest.raises(ValueError):
            runs.RunConfig(*bad)
    with pytest.raises(ValueError):
        runs.checked_targets(spark.range(0))
    assert runs.checked_targets(spark.range(1)).count() == 1


def test_observed_metrics_reach_the_callback(spark):
    seen = []
    config = runs.RunConfig("2026-01-01", "2026-01-02", ("x",), report=lambda stage, m: seen.append((stage, m)))
    df, o = runs.observed(spark.range(100), "targets", most=F.max("id"))
    assert df.filter("id > 90").count() == 9
    assert runs.reported(config, "targets", o) == {"rows": 100, "most": 99} and seen == [("targets", {"rows": 100, "most": 99})]


def test_tagged_jobs_can_be_cancelled(spark):
    def slow(it):
        for b in it:
            time.sleep(60)
            yield b

    failed = []

    def work():
        with runs.cancellable(spark, "search"):
            try:
                spark.range(4).mapInArrow(slow, "id long").count()
            except Exception as e:
                failed.append(e)

    t = threading.Thread(target=work)
    t.start()
    deadline = time.time() + 45
    while t.is_alive() and time.time() < deadline:
        time.sleep(1)
        runs.cancel(spark, "search")
    t.join(60)
    assert failed and not t.is_alive()


def test_families_can_be_added(spark):
    payloads.register_family("own", "$.items", {"uid": ["no"], "reference": ["ref", "no"], "address": ["where.street"]})
    try:
        p = spark.createDataFrame([('{"items":[{"no":7,"where":{"street":"1 Road, AB1 2CD"}}]}',)], "body string")
        assert rows(payloads.applications(p, "own"), "uid", "reference", "address", "postcode") == [("7", "7", "1 Road, AB1 2CD", "AB1 2CD")]
    finally:
        del payloads.FAMILIES["own"]
    with pytest.raises(ValueError):
        payloads.register_family("bad", "$", {"reference": ["ref"]})


def test_stored_streams(spark, tmp_path):
    record = (1, 0, 0, 5, 6, 0, 0, 0, 1.5, 2.5, ["t"] * payloads.BINARY_TEXTS)
    (tmp_path / "a.bin").write_bytes(payloads.encode_records([record, record]))
    s = payloads.stored_streams(spark, str(tmp_path))
    assert rows(payloads.binary_records(s, "page", "body"), "page", "ordinal", "x", "error") == [("a.bin", 0, 1.5, None), ("a.bin", 1, 1.5, None)]


def test_merge_keeps_main_rows_without_a_reference(spark):
    schema = "reference string, uid string, address string"
    m = spark.createDataFrame([(None, "u1", None), (" r2 ", "u2", ""), ("r2", "u3", "own"), (None, None, "loose")], schema)
    f = spark.createDataFrame([("u1", "x", "fed"), ("r2", "x", None), ("r2", "x", "later"), (None, None, "stray"), ("new", "x", None), ("new", "x", "filled")], schema)
    got = rows(R.merge_fallback(m, f, "reference", ["address"], None, ["uid"], ["uid", "address"]), "reference", "uid", "address", "from_main", "supplemented")
    assert got == sorted([
        (None, "u1", "fed", True, True), (" r2 ", "u2", None, True, False), ("r2", "u3", "own", True, True), (None, None, "loose", True, False), (None, None, "stray", False, False), ("new", "x", "filled", False, False),
    ], key=repr)
    assert R.merge_fallback(m.limit(0), f, "reference", ["address"], None, ["uid"]).count() == 4 and R.merge_fallback(m, f.limit(0), "reference", ["address"]).count() == 4


def test_spatial_joins_on_large_equal_and_null_geometries(spark):
    box = lambda x, w: geometry.box_ring(x, F.lit(0.0), x + w, F.lit(1.0))
    l = leads.boxed(spark.createDataFrame([(1, 0.0, 1.0), (1, 0.0, 1.0), (2, 50.0, 4000.0), (3, 9000.0, 1.0)], "k int, x double, w double"), box(F.col("x"), F.col("w"))).drop("x", "w")
    l = l.unionByName(l.limit(1).withColumns({"k": F.lit(9), "geometry": F.lit(None).cast(geometry.GEOMETRY)}))
    r = leads.boxed(spark.createDataFrame([(0.5, 0.1), (3000.2, 0.1)], "x double, w double"), box(F.col("x"), F.col("w"))).drop("x", "w")
    assert rows(R.spatial_semi_join(l, r, 0.5), "k") == [(1,), (1,), (2,)]
    assert R.spatial_semi_join(l, r.limit(0), 0.5).count() == 0 and R.spatial_semi_join(l.limit(0), r, 0.5).count() == 0
    p = spark.createDataFrame([(1, 0.55, 0.5), (1, 0.55, 0.5), (2, None, 1.0), (3, 77.0, 0.5), (4, 3000.25, 0.5)], "k int, px double, py double")
    for few in (0, 100):
        assert rows(R.points_in_areas(p, r, "px", "py", 0.5, few), "k") == [(1,), (1,), (2,), (4,)]


def test_written_caches(spark):
    c = runs.write_cache(spark.range(3), scratch_path(spark, "cache"))
    assert c.count() == 3 and c.columns == ["id"]

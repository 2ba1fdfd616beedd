"""The data source of stored payloads: families, filters, files that can't be read."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from registrum.sources import payload_source, payloads


def stored(root, family, day, name, text):
    folder = root / f"family={family}" / f"day={day}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def pages(tmp_path):
    stored(tmp_path, "statmap", "2026-06-01", "a.json", '{"records":[{"id":7,"name":" N7 ","address":"1 Road, ab1 2cd","receivedDate":"2026-05-30T09:00:00"},{"id":8,"proposal":"","status":"Open"}]}')
    stored(tmp_path, "statmap", "2026-06-02", "b.json", '{"records":[]}')
    stored(tmp_path, "statmap", "2026-06-03", "c.json", '{"records": [')
    stored(tmp_path, "arcus", "2026-06-01", "d.json", '{"actions":[{"state":"SUCCESS","returnValue":{"returnValue":{"records":[{"Id":"i1","Name":"R1","Site_Address__c":null,"arcusbuiltenv__Site_Address__c":"2 Lane"}]}}}]}')
    stored(tmp_path, "arcus", "2026-06-02", "e.json", '{"actions":[{"state":"ERROR"}]}')
    stored(tmp_path, "civica", "2026-06-01", "f.json", '{"planningData":{"refval":"C1","dateaprecv_text":"Fri 05 Jun 2026"}}')
    stored(tmp_path, "unheard-of", "2026-06-01", "g.json", "{}")
    stored(tmp_path, "statmap", "2026-06-01", "_SUCCESS", "")
    stored(tmp_path, "statmap", "2026-06-09", "bad.json", b"\xff\xfe")
    return str(tmp_path)


def load(spark, path, **options):
    payload_source.register(spark)
    return spark.read.format("planning_payload").options(**options).load(path)


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_records_of_all_families(spark, pages):
    d = load(spark, pages)
    assert got(d.filter("error is null"), "family", "day", "page", "ordinal", "uid", "reference", "address", "status", "date_received") == sorted([
        ("statmap", date(2026, 6, 1), "a.json", 0, "7", "N7", "1 Road, ab1 2cd", None, "2026-05-30T09:00:00"), ("statmap", date(2026, 6, 1), "a.json", 1, "8", "8", None, "Open", None),
        ("arcus", date(2026, 6, 1), "d.json", 0, "i1", "R1", "2 Lane", None, None), ("civica", date(2026, 6, 1), "f.json", 0, "C1", "C1", None, None, "Fri 05 Jun 2026"),
    ], key=repr)
    assert got(d.filter("error is not null"), "page", "ordinal") == [("bad.json", -1), ("c.json", -1), ("e.json", -1)]
    assert got(d.filter("uid = '7'"), F.get_json_object("raw", "$.name")) == [(" N7 ",)]


def test_filters_choose_files(spark, pages):
    d = load(spark, pages, family="statmap").filter("day <= '2026-06-02' and day >= '2026-06-02'")
    reader = payload_source.PayloadReader(pages, dict(payloads.FAMILIES), "statmap")
    left = list(reader.pushFilters([payload_source.GreaterThanOrEqual(("day",), date(2026, 6, 2)), payload_source.LessThan(("day",), date(2026, 6, 4)), payload_source.EqualTo(("uid",), "7")]))
    assert [f.attribute for f in left] == [("uid",)] and [f[0].rsplit("/", 1)[-1] for f in reader.listed()] == ["b.json", "c.json"]
    assert d.count() == 0 and d.filter("error is not null").count() == 0
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # both bounds are the source's
    assert load(spark, pages).filter("family in ('civica', 'arcus') and day = '2026-06-01'").count() == 2


def test_small_files_are_read_together(spark, pages, monkeypatch):
    reader = payload_source.PayloadReader(pages, dict(payloads.FAMILIES), None)
    assert len(reader.partitions()) == 1
    monkeypatch.setattr(payload_source, "TASK_BYTES", 1)
    assert len(reader.partitions()) == len(reader.listed()) == 7


def test_families_of_the_user(spark, tmp_path):
    stored(tmp_path, "own", "2026-06-01", "a.json", '{"items":[{"no":1,"where":[{"street":"x"}]}]}')
    with pytest.raises(Exception, match="no family own"):
        load(spark, str(tmp_path), family="own").count()
    payloads.register_family("own", "$.items", {"uid": ["no"], "address": ["where[0].street"]})
    try:
        assert got(load(spark, str(tmp_path), family="own"), "uid", "address") == [("1", "x")]
    finally:
        del payloads.FAMILIES["own"]


def test_normalised_applications(spark, pages):
    a = payload_source.applications(spark, pages, "statmap", "2026-06-01", "2026-06-08")
    assert got(a, "uid", "postcode", "date_received") == [("7", "AB1 2CD", "2026-05-30"), ("8", None, None)]

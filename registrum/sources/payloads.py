"""Decoders of stored payloads: JSON families, attribute lists, XML rows, weekly CSV, binary record streams, GeoJSON.

A family is a row specification, not code: where its records are, and for each application column an ordered list of fields.
"""

from __future__ import annotations

import struct as _struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.functions.dates import parse_council_date
from registrum.functions.text import SPACE, blank_to_null, extract_postcode

# --- fixed values: by family where its records are and, by column, their JSON fields in order of preference ------------
FAMILIES: dict[str, tuple[str, dict[str, list[str]]]] = {
    "aggregator": ("$.records", {"uid": ["uid"], "reference": ["reference", "uid", "name"], "url": ["url", "link"], "address": ["address"], "description": ["description"], "status": ["other_fields.status", "app_state"], "date_received": ["other_fields.date_received", "start_date"], "date_validated": ["other_fields.date_validated"], "applicant_name": ["other_fields.applicant_name"], "agent_name": ["other_fields.agent_name"], "case_officer": ["other_fields.case_officer"], "parish": ["other_fields.parish"], "postcode": ["postcode"], "x": ["location_x"], "y": ["location_y"]}),
    "statmap": ("$.records", {"uid": ["id", "name"], "reference": ["name", "id"], "address": ["address"], "description": ["proposal"], "status": ["status"], "date_received": ["receivedDate"]}),
    "socrata": ("$", {"uid": ["pk", "application_number"], "reference": ["application_number"], "address": ["development_address"], "description": ["development_description"], "date_received": ["registered_date"]}),
    "arcus": ("$.actions[0].returnValue.returnValue.records", {"uid": ["Id"], "reference": ["Name"], "address": ["Site_Address__c", "arcusbuiltenv__Site_Address__c"], "description": ["Proposal__c", "arcusbuiltenv__Proposal__c"], "date_received": ["Received_Date__c", "arcusbuiltenv__Received_Date__c"], "date_validated": ["Valid_Date__c", "arcusbuiltenv__Valid_Date__c"], "status": ["Status__c", "arcusbuiltenv__Status__c"]}),
    "agile": ("$.results", {"uid": ["id"], "reference": ["reference"], "address": ["location"], "description": ["proposal"], "status": ["status"], "date_received": ["receivedDate", "registrationDate"], "date_validated": ["validDate"]}),
    "civica": ("$.planningData", {"uid": ["refval"], "reference": ["refval"], "address": ["addressline"], "description": ["proposal"], "status": ["dcstat_text"], "date_received": ["dateaprecv_text"], "date_validated": ["dateapval_text"], "applicant_name": ["appname"], "agent_name": ["agtname"], "case_officer": ["officer_name"], "ward": ["ward_text"], "parish": ["parish_text"]}),
    "wiltshire": ("$.records", {"uid": ["Id"], "reference": ["Name", "Id"], "address": ["arcusbuiltenv__Site_Address__c"], "description": ["Hidden_Proposal__c", "arcusbuiltenv__Proposal__c"], "status": ["arcusbuiltenv__Status__c"], "date_validated": ["arcusbuiltenv__Valid_Date__c"]}),
    "eastleigh": ("$.records", {"uid": ["Id"], "reference": ["Name", "Id"], "address": ["arcusbuilt__SiteAddress__r.Name", "arcusbuilt__Site_Address__c"], "description": ["arcusbuilt__Proposal__c"], "status": ["arcusbuilt__Status__c"], "decision": ["arcusbuilt__Last_Decision__c"], "date_received": ["arcusbuilt__ReceivedDate__c"], "date_validated": ["arcusbuilt__Validation_Date__c"]}),
    "carmarthenshire": ("$.records", {"uid": ["Id"], "reference": ["Name"], "address": ["arcusbuiltenv__Site_Address__c"], "description": ["Hidden_Proposal__c"], "status": ["arcusbuiltenv__Status__c"], "date_received": ["arcusbuiltenv__Registration_Date__c"], "ward": ["arcusbuiltenv__Wards__c"], "parish": ["arcusbuiltenv__Parishes__c"], "docs_url": ["Documents_URL__c"]}),
    "stratford": ("$", {"uid": ["id", "reference"], "reference": ["reference"], "url": ["link"], "address": ["address"], "description": ["proposal"], "status": ["status"], "decision": ["decision"], "date_validated": ["validDate"]}),
    "achieveforms": ("$", {"uid": ["referenceNumber", "reference"], "reference": ["referenceNumber", "reference"], "address": ["location"], "description": ["description"], "status": ["applicationStatus"], "decision": ["decision"], "date_received": ["dateReceived", "ReceivedDate"], "date_validated": ["dateAccepted", "Adate"], "applicant_name": ["applicant"], "agent_name": ["agent"], "case_officer": ["officer"]}),
}
# --- fixed values: attribute names of the entity grid's records --------------------------------------------------------
GRID = {"uid": "new_wamplanningid", "reference": "new_name", "address": "new_concatenatedaddress", "description": "new_development_desc", "status": "new_application_status", "date_received": "new_registration_date"}


def grid_applications(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Applications of entity-grid pages, whose records are attribute lists; incomplete records have complete = false."""
    kind = "array<struct<Name: string, DisplayValue: string, FormattedValue: string, Value: string>>"
    r = json_records(payloads, body, "$.Records").withColumn("a", attribute_map(F.from_json(F.get_json_object("record", "$.Attributes"), kind), ["Name"], ["DisplayValue", "FormattedValue", "Value"]))
    c = {k: blank_to_null(F.col("a")[v]) for k, v in GRID.items()}
    c["uid"] = F.coalesce(blank_to_null(F.get_json_object("record", "$.Id")), c["uid"])
    c["date_received"] = parse_council_date(c["date_received"])
    out = r.select(*payloads.columns, "ordinal", *[v.alias(k) for k, v in c.items()])
    return out.withColumns({"complete": F.col("uid").isNotNull() & F.col("reference").isNotNull(), "postcode": extract_postcode("address")})


def json_records(payloads: DataFrame, body: str, path: str = "$") -> DataFrame:
    """Payload columns, ordinal and record (JSON text). A single object counts as one record; unreadable bodies give none (see json_errors)."""
    at = F.col(body) if path == "$" else F.get_json_object(F.col(body), path)
    many = F.from_json(at, "array<string>")
    one = F.when(F.startswith(F.ltrim(at), F.lit("{")), F.array(at))
    return payloads.select("*", F.posexplode(F.coalesce(one, many)).alias("ordinal", "record"))


def json_errors(payloads: DataFrame, body: str) -> DataFrame:
    """Payloads that are no JSON, and those whose first action reports an error rather than an empty result."""
    bad = F.try_parse_json(F.col(body)).isNull()
    state = F.get_json_object(F.col(body), "$.actions[0].state")
    reason = F.when(bad, "invalid json").when(state == "ERROR", "error action")
    return payloads.withColumn("reason", reason).filter("reason is not null")


def applications(payloads: DataFrame, family: str, body: str = "body", inner: str | None = None) -> DataFrame:
    """Application columns of a family's records; inner: a field holding JSON text that is decoded first."""
    path, columns = FAMILIES[family]
    p = payloads.withColumn(body, F.get_json_object(F.col(body), inner)) if inner else payloads
    r = json_records(p, body, path)
    text = {c: F.coalesce(*[blank_to_null(F.get_json_object("record", f"$.{f}")) for f in fields]) for c, fields in columns.items()}
    dates = {c: parse_council_date(F.split_part(text[c], F.lit("T"), F.lit(1))) for c in ("date_received", "date_validated") if c in text}
    out = r.select(*payloads.columns, "ordinal", *[v.alias(c) for c, v in (text | dates).items()])
    return out if "postcode" in columns or "address" not in columns else out.withColumn("postcode", extract_postcode("address"))


def attribute_map(items: Column, names: list[str], value: list[str]) -> Column:
    """Map of attribute structs by each of names; later ones replace earlier ones of the same name."""
    v = F.filter(items, lambda x: F.coalesce(*[x[n] for n in names]).isNotNull())
    keys = F.flatten(F.transform(v, lambda x: F.array_compact(F.array(*[x[n] for n in names]))))
    values = F.flatten(F.transform(v, lambda x: F.transform(F.array_compact(F.array(*[x[n] for n in names])), lambda _: F.coalesce(*[x[c] for c in value]))))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def xml_rows(payloads: DataFrame, body: str) -> DataFrame:
    """row, column, value of <Row><result column=...> elements."""
    rows = F.expr(f"xpath({body}, '//Row/result/text()')")
    cols = F.expr(f"xpath({body}, '//Row/result/@column')")
    counts = F.expr(f"xpath({body}, '//Row/@id')")
    return payloads.select("*", F.posexplode(F.arrays_zip(cols.alias("column"), rows.alias("value"))).alias("place", "c"), F.size(counts).alias("n_rows")).select(*payloads.columns, "place", "n_rows", "c.column", "c.value")


def weekly_csv(payloads: DataFrame, key: str, encoded: str, first_cell: str = "application_number") -> DataFrame:
    """key, ordinal and a map of each data row of a base64 CSV; the header is the row whose first cell says so."""
    bare = F.regexp_replace(encoded, r"[\s=]", "")
    padded = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("="))
    d = payloads.select(key, csv_rows(F.regexp_replace(F.decode(F.unbase64(padded), "UTF-8"), "^\\ufeff", "")).alias("rows"))
    d = d.withColumn("at", F.array_position(F.transform("rows", lambda r: F.trim(F.get(r, F.lit(0)))), first_cell).cast("int"))
    d = d.withColumn("head", F.transform(F.get("rows", F.col("at") - 1), lambda c: F.trim(c))).select(key, "at", "head", F.posexplode("rows").alias("ordinal", "row"))
    pairs = F.filter(F.arrays_zip(F.col("head").alias("k"), F.col("row").alias("v")), lambda p, i: p["k"].isNotNull() & p["v"].isNotNull() & (F.array_position("head", p["k"]) == i + 1))
    tidy = F.transform(pairs, lambda p: F.struct(p["k"].alias("key"), F.trim(F.regexp_replace(p["v"], SPACE + "+", " ")).alias("value")))
    return d.filter("at > 0 and ordinal >= at and size(row) > 0").select(key, "ordinal", F.map_from_entries(tidy).alias("cells"))


#: Stand between cells, between rows and for an empty cell in quotes, once the quotes of a CSV are gone; characters that no text may hold.
_CELL, _ROW, _EMPTY = "\ufdd0", "\ufdd1", "\ufdd2"
_QUOTED = r'"(?:[^"]++|"")*+'
_FIELD = rf'({_QUOTED}(?:"[^,\r\n]*|\z)|[^,\r\n]*)(,|\r\n|\n|\r|\z)'


def csv_rows(text: Column) -> Column:
    """Rows of cells of CSV text: cells in quotes hold commas, line ends and doubled quotes; a blank line is a row without cells.

    A cell begins behind a comma or a line end, so whether a quote opens one is known where it stands. Expressions only.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{_CELL}{_ROW}{_EMPTY}]", "")
    cells, ends = (F.regexp_extract_all(t, F.lit(_FIELD), F.lit(i)) for i in (1, 2))
    quoted = rf'(?s)^"((?:[^"]++|"")*+)"?(.*)$'
    inner = lambda c: F.concat(F.replace(F.regexp_extract(c, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, quoted, 2))
    plain = lambda c: F.when(F.startswith(c, F.lit('"')), F.coalesce(F.nullif(inner(c), F.lit("")), F.lit(_EMPTY))).otherwise(c)
    sign = lambda e: F.when(e == ",", _CELL).when(e == "", "").otherwise(_ROW)
    joined = F.array_join(F.transform(F.arrays_zip(cells.alias("c"), ends.alias("e")), lambda x: F.concat(plain(x["c"]), sign(x["e"]))), "")
    rows = F.split(joined, _ROW)
    rows = F.when(F.element_at(rows, -1) == "", F.slice(rows, F.lit(1), F.size(rows) - 1)).otherwise(rows)
    return F.transform(rows, lambda r: F.when(r == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(r, _CELL), lambda c: F.replace(c, F.lit(_EMPTY), F.lit("")))))


_HEAD = _struct.Struct("<BBBIIQQQdd")
#: Text fields of a binary record, in order, and records of a stream at most.
BINARY_TEXTS, BINARY_MOST = 11, 100_000


def decode_records(data: bytes) -> list[tuple]:
    """Little-endian count, then records: 3 flags, 2 ids, 3 tick counts, 2 coordinates, length-prefixed texts. Trailing bytes are an error."""
    (n,), at = _struct.unpack_from("<I", data), 4
    if n > BINARY_MOST:
        raise ValueError("too many records")
    out = []
    for _ in range(n):
        head = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        texts = []
        for _ in range(BINARY_TEXTS):
            (size,) = _struct.unpack_from("<I", data, at)
            if at + 4 + size > len(data):
                raise ValueError("record ends early")
            texts.append(data[at + 4 : at + 4 + size].decode("utf-8"))
            at += 4 + size
        out.append((*head, texts))
    if at != len(data):
        raise ValueError("trailing bytes")
    return out


def encode_records(rows: list[tuple]) -> bytes:
    """The inverse of decode_records."""
    return _struct.pack("<I", len(rows)) + b"".join(_HEAD.pack(*r[:10]) + b"".join(_struct.pack("<I", len(t.encode())) + t.encode() for t in r[10]) for r in rows)


def binary_records(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """key, ordinal, flags, ids, ticks, x, y, texts and error (a stream that can't be read gives one row with it)."""
    kind = payloads.schema[key].dataType.simpleString()
    names = ["ordinal", "flags", "ids", "ticks", "x", "y", "texts", "error"]
    kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.string()]

    def signed(v: int) -> int:
        return v - (1 << 64) if v >= 1 << 63 else v

    def run(it: Iterator) -> Iterator:
        for b in it:
            keys, rows = [], []
            for k, data in zip(b.column(key).to_pylist(), b.column(body).to_pylist()):
                try:
                    got = [(i, list(r[:3]), list(r[3:5]), [signed(t) for t in r[5:8]], r[8], r[9], r[10], None) for i, r in enumerate(decode_records(data or b"\0\0\0\0"))]
                except (ValueError, _struct.error) as e:
                    got = [(-1, None, None, None, None, None, None, str(e))]
                keys += [k] * len(got)
                rows += got
            cols = list(zip(*rows)) or [()] * 8
            yield pa.record_batch([pa.array(keys, b.schema.field(key).type), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=[key, *names])

    return payloads.select(key, body).mapInArrow(run, f"{key} {kind}, ordinal int, flags array<int>, ids array<long>, ticks array<long>, x double, y double, texts array<string>, error string")


def boundary(spark: SparkSession, path: str) -> DataFrame:
    """A GeoJSON file's geometries: ordinal, properties (JSON text), geometry, box. Features, collections and bare geometries."""
    return boundary_rows(spark.read.text(path, wholetext=True))


def boundary_rows(t: DataFrame) -> DataFrame:
    """The same of GeoJSON texts in column value."""
    from registrum.functions import geometry as G

    kind = F.get_json_object("value", "$.type")
    many = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    f = t.select(F.posexplode(F.when(kind == "FeatureCollection", many).otherwise(F.array("value"))).alias("ordinal", "f"))
    g = F.coalesce(F.get_json_object("f", "$.geometry"), F.col("f"))
    out = f.select("ordinal", F.get_json_object("f", "$.properties").alias("properties"), G.from_geojson(g).alias("geometry"))
    return out.withColumn("box", G.bbox(F.col("geometry")))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Targets of a catalogue file, overrides applied: authority, portal_family, scraper_type, base_url, listing_url, link_test_ok, geometry, box, ordinal."""
    return catalogue_rows(boundary(spark, path))


def catalogue_rows(features: DataFrame) -> DataFrame:
    """The same of boundary_rows()."""
    from registrum.functions import fixed

    spark = features.sparkSession
    p = lambda k: blank_to_null(F.get_json_object("properties", f"$.{k}"))
    b = features.withColumn("authority", F.coalesce(p("authority"), p("council_name")))
    o = spark.createDataFrame([(a, f, s, u, u + fixed.PORTAL_OVERRIDE_QUERY) for a, (f, s, u) in fixed.PORTAL_OVERRIDES.items()], "authority string, of string, os string, ob string, ol string")
    j = b.join(F.broadcast(o), "authority", "left")  # a fixed table of two rows
    return j.select("authority", F.coalesce("of", p("portal_family"), F.lit("unknown")).alias("portal_family"), F.coalesce("os", p("scraper_type"), F.lit("unknown")).alias("scraper_type"), F.coalesce("ob", p("base_url")).alias("base_url"), F.coalesce("ol", p("listing_url"), p("planning_url")).alias("listing_url"), (F.coalesce(p("link_test_ok"), F.lit("false")) != "false").alias("link_test_ok"), "geometry", "box", "ordinal")


def stored_payloads(spark: SparkSession, path: str, family: str = "") -> DataFrame:
    """family, page (file name), body of stored payloads under a path of any store that Spark reads; a file is one payload."""
    return spark.read.text(path, wholetext=True).select(F.lit(family).alias("family"), F.col("_metadata.file_name").alias("page"), F.col("value").alias("body"))


def stored_streams(spark: SparkSession, path: str) -> DataFrame:
    """page, body (BINARY) of stored record streams."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("page"), F.col("content").alias("body"))


def register_family(name: str, path: str, columns: dict[str, list[str]]) -> None:
    """Adds or replaces a family: where its records are, and for each application column its fields in order."""
    if "uid" not in columns:
        raise ValueError(f"family {name} has no uid")
    FAMILIES[name] = (path, {c: list(f) for c, f in columns.items()})


def key_objects(payloads: DataFrame, body: str = "body") -> DataFrame:
    """key_number, key_text and fields of key objects: a map by field name and by label, lower case; the last of a name counts."""
    kind = "array<struct<FieldName: string, Label: string, Value: string>>"
    r = json_records(payloads, body, "$.KeyObjects")
    items = F.filter(F.from_json(F.get_json_object("record", "$.Items"), kind), lambda x: blank_to_null(x["Value"]).isNotNull())
    items = F.transform(items, lambda x: F.struct(F.lower(F.nullif(x["FieldName"], F.lit(""))).alias("FieldName"), F.lower(F.nullif(x["Label"], F.lit(""))).alias("Label"), F.trim(x["Value"]).alias("Value")))
    at = lambda n: blank_to_null(F.get_json_object("record", f"$.{n}"))
    return r.withColumn("_i", items).select(*payloads.columns, "ordinal", at("KeyNumber").alias("key_number"), at("KeyText").alias("key_text"), attribute_map(F.col("_i"), ["FieldName", "Label"], ["Value"]).alias("fields"))


def planning_cases(records: DataFrame, enforcement: Column, reference: str) -> DataFrame:
    """Records that are no enforcement cases, with complete: whether they have a reference."""
    return records.filter(~F.coalesce(enforcement, F.lit(False))).withColumn("complete", blank_to_null(reference).isNotNull())


def form_definition(payloads: DataFrame, body: str, lookups: dict[str, str]) -> DataFrame:
    """The ids of a form definition's lookups by the names their fields have: lookups is column by field name."""
    kind = "array<struct<name: string, lookup: string>>"
    fields = F.from_json(F.get_json_object(body, "$.fields"), kind)
    one = lambda name: F.get(F.filter(fields, lambda x: F.lower(x["name"]) == name.lower()), F.lit(0))["lookup"]
    return payloads.select(*[c for c in payloads.columns if c != body], *[blank_to_null(one(name)).alias(c) for c, name in lookups.items()])


def area_requests(log: DataFrame) -> DataFrame:
    """The next request after each answer of a paged area scan: halved pages while an answer is too large, else the page after it.

    log: turn, offset, size, too_large, n (records of the answer), to (place of the last), total. Adds next_offset and next_size,
    null when the scan ends: an empty answer, or the last place reaches the total; failed: a page of one is still too large.
    """
    done = (F.col("n") == 0) | (F.coalesce("to", "offset") + 1 >= F.col("total"))
    big = F.col("too_large")
    return log.withColumns({
        "next_offset": F.when(big, F.when(F.col("size") > 1, F.col("offset"))).when(~done, F.coalesce("to", "offset") + 1),
        "next_size": F.when(big, F.when(F.col("size") > 1, F.greatest(F.lit(1), F.floor(F.col("size") / 2)))).when(~done, F.col("size")),
        "failed": big & (F.col("size") <= 1),
    })


def pushed_window(rows: DataFrame, day: str, start: str, end: str, most: int) -> DataFrame:
    """The newest rows of a window, most at most: bounds, order and limit that the store can take over."""
    d = F.col(day)
    return rows.filter((d >= F.lit(start).cast("timestamp")) & (d < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))).orderBy(F.desc(day), *[c for c in rows.columns if c != day]).limit(most)

"""Stored payloads as a data source: spark.read.format("planning_payload").option("family", ...).load(path).

    payload_source.register(spark)
    spark.read.format("planning_payload").option("family", "statmap").load(path).filter("day >= '2026-06-01'")

A source's payloads stand in files under family=.../day=.../; a task reads a file, or small ones together. Filters on family and day decide which
files are listed for reading at all. Records are read where the family's row specification has them, its own fields first; a payload
that can't be read gives one row with error. Families are those that are registered when the source is: register again after
payloads.register_family(). Files are opened through pyarrow, so path is of a store that pyarrow knows (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from registrum.functions.dates import parse_council_date
from registrum.functions.text import extract_postcode
from registrum.sources import payloads

FORMAT = "planning_payload"
#: Application columns that a family may have, in the order of the schema.
COLUMNS = ["uid", "reference", "url", "address", "description", "status", "decision", "date_received", "date_validated", "applicant_name", "agent_name", "case_officer", "ward", "parish", "postcode", "docs_url", "x", "y"]
_KINDS = {"family": pa.string(), "day": pa.date32(), "page": pa.string(), "ordinal": pa.int32(), **dict.fromkeys(COLUMNS, pa.string()), "raw": pa.string(), "error": pa.string()}
#: Files up to this many bytes together are one task, and rows of an Arrow batch.
TASK_BYTES, BATCH = 16 << 20, 2000

Spec = tuple[str, dict[str, list[str]]]


def value_at(record: object, path: str) -> object:
    """The value at a path of keys and places ("$.actions[0].records"); None where there is none."""
    for key in re.findall(r"[^.\[\]$]+", path):
        if isinstance(record, list):
            record = record[int(key)] if key.isdigit() and int(key) < len(record) else None
        else:
            record = record.get(key) if isinstance(record, dict) else None
    return record


def text_of(value: object) -> str | None:
    """A value as text, trimmed; blank is None."""
    if value is None:
        return None
    text = (value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))).strip(" ")
    return text or None


def records(body: str, spec: Spec) -> list[dict[str, str | None]]:
    """Column texts of a payload's records; ValueError if it is no JSON or reports an error."""
    data = json.loads(body)
    if value_at(data, "$.actions[0].state") == "ERROR":
        raise ValueError("error action")
    path, columns = spec
    found = value_at(data, path)
    out = []
    for r in [found] if isinstance(found, dict) else found or []:
        row = {c: next((t for t in map(text_of, (value_at(r, f) for f in fields)) if t), None) for c, fields in columns.items()}
        out.append({**row, "raw": json.dumps(r, ensure_ascii=False, separators=(",", ":"))})
    return out


@dataclass
class Files(InputPartition):
    """Files of one task: path, family, day."""

    files: list[tuple[str, str, date | None]]


class PayloadReader(DataSourceReader):
    def __init__(self, path: str, families: dict[str, Spec], family: str | None):
        self.path, self.families = path, families
        self.tests: list[tuple[str, object]] = [("family", lambda v: v == family)] if family else []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on family and day hold for whole files; all others are left to Spark."""
        tests = {
            EqualTo: lambda f: lambda v: v == f.value, In: lambda f: lambda v: v in f.value, IsNotNull: lambda f: lambda v: v is not None,
            GreaterThan: lambda f: lambda v: v is not None and v > f.value, GreaterThanOrEqual: lambda f: lambda v: v is not None and v >= f.value,
            LessThan: lambda f: lambda v: v is not None and v < f.value, LessThanOrEqual: lambda f: lambda v: v is not None and v <= f.value,
        }
        for f in filters:
            if type(f) in tests and f.attribute in (("family",), ("day",)):
                self.tests.append((f.attribute[0], tests[type(f)](f)))
            else:
                yield f

    def listed(self) -> list[tuple[str, str, date | None, int]]:
        """Files of known families that pass all tests, by path, with their sizes."""
        fs, root = pa.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pa.fs.LocalFileSystem(), self.path)
        out = []
        for info in fs.get_file_info(pa.fs.FileSelector(root, recursive=True)):
            if info.type != pa.fs.FileType.File or info.base_name.startswith(("_", ".")):
                continue
            keys = dict(re.findall(r"([^/=]+)=([^/]*)/", info.path.removeprefix(root)))
            family, day = unquote(keys.get("family", "")), keys.get("day", "")
            place = {"family": family, "day": date.fromisoformat(day) if re.fullmatch(r"\d{4}-\d\d-\d\d", day) else None}
            if family in self.families and all(test(place[c]) for c, test in self.tests):
                out.append((info.path, family, place["day"], info.size))
        return sorted(out, key=lambda f: f[0])

    def partitions(self) -> list[InputPartition]:
        out, size = [], TASK_BYTES + 1
        for path, family, day, n in self.listed():
            if size + n > TASK_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].files.append((path, family, day))
            size += n
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs = pa.fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else pa.fs.LocalFileSystem()
        rows: list[dict] = []
        for path, family, day in partition.files:
            key = {"family": family, "day": day, "page": path.rsplit("/", 1)[-1]}
            with fs.open_input_stream(path) as f:
                body = f.read()
            try:
                found = records(body.decode("utf-8"), self.families[family])
                rows += [{**key, "ordinal": i, **r} for i, r in enumerate(found)]
            except (ValueError, RecursionError) as e:
                rows.append({**key, "ordinal": -1, "error": str(e)})
            while len(rows) >= BATCH:
                yield _batch(rows[:BATCH])
                del rows[:BATCH]
        if rows:
            yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(c) for r in rows], k) for c, k in _KINDS.items()], names=list(_KINDS))


class PayloadSource(DataSource):
    """The source; register() makes one of the families there are."""

    families: dict[str, Spec] = {}

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "family string, day date, page string, ordinal int, " + ", ".join(f"{c} string" for c in COLUMNS) + ", raw string, error string"

    def reader(self, schema) -> PayloadReader:
        family = self.options.get("family")
        if family and family not in self.families:
            raise ValueError(f"no family {family}: register it, and the source after it")
        return PayloadReader(self.options["path"], self.families, family)


def register(spark: SparkSession) -> None:
    """Registers the source with the families there are now, and lets Spark hand it filters."""
    known = type("RegisteredPayloadSource", (PayloadSource,), {"families": dict(payloads.FAMILIES), "__module__": "__main__"})
    spark.dataSource.register(known)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def applications(spark: SparkSession, path: str, family: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The readable records of a family, stored from start to end: dates in ISO form, a postcode of the address where the family has none."""
    register(spark)
    d = spark.read.format(FORMAT).option("family", family).load(path)
    d = d.filter(F.col("day") >= F.lit(start).cast("date")) if start else d
    d = d.filter(F.col("day") <= F.lit(end).cast("date")) if end else d
    iso = {c: parse_council_date(F.split_part(c, F.lit("T"), F.lit(1))) for c in ("date_received", "date_validated")}
    return d.filter("error is null").drop("error").withColumns(iso).withColumn("postcode", F.coalesce("postcode", extract_postcode("address")))

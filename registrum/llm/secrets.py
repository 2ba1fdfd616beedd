"""Secret scans with an incremental blob ledger.

A text is a blob named by its SHA-256; rows of documents are paths to blobs. Only pairs of blob and rule version that the
ledger doesn't have are scanned, each once however many paths lead to it, and findings are joined back to every path.

The ledger is a stored table that runs append to: a row has a blob, the rule versions it was scanned with and what they found,
so it holds pairs without findings too. LEDGER names its folder in the session; a later run then reads only new blobs, or old
ones under new rules. Without that setting a run begins a ledger of its own in the shared folder. A run that is repeated after
a failure appends pairs that are there already; readers take each finding once.

Defined cases: null text counts as empty and finds nothing; repeated rows stay repeated; rows without a doc_id and unlike texts
under one are paths like others; extra columns are ignored; an empty table gives an empty result; spans are code points, end
exclusive.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.llm.common import batches, doc_texts, documents, join_paths, shared_dir


@dataclass(frozen=True)
class Rule:
    """hints: lower-case strings of which a text must hold one (none: any text). least: characters of group, at least."""

    kind: str
    version: int
    pattern: str
    hints: tuple[str, ...] = ()
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_NAME = "|".join([*map(_any_case, NAMES[:4]), _any_case("api") + "_?" + _any_case("key")])
#: The first three are the base kinds.
RULES = (
    Rule("assign", 1, rf"""({_NAME})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", NAMES, 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", ("akia",), 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("forge", 1, r"gh[opsur]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}", ("gho_", "ghp_", "ghs_", "ghu_", "ghr_", "glpat-")),
    Rule("chat", 1, r"xox[abposr]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
    Rule("pem", 1, r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", ("private key-----",)),
    Rule("url", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,100}:[^\s:/@]{3,100}@", ("://",)),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<kind: string, start: int, end: int, rule: string>>"
ROWS = f"blob binary, rules array<string>, spans {SPANS}"
#: Session setting: the folder of a ledger that is kept between runs.
LEDGER = "registrum.secrets.ledger"


def find(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """Spans of the rules, by start and then in the order of RULES."""
    low = text.lower()
    out = []
    for k, r in enumerate(rules):
        if not r.hints or any(h in low for h in r.hints):
            out += [(m.start(), k, m.end(), r.kind) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def paths(docs: DataFrame) -> DataFrame:
    """doc_id, text, blob."""
    return doc_texts(docs).withColumn("blob", F.unhex(F.sha2("text", 256)))


def unseen(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, doc_id (a path to it), todo: the names of rules that the ledger has not seen it with."""
    every = F.array(*[F.lit(r.name) for r in rules])
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    one = blobs.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(seen, "blob", "left")
    todo = F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, "seen"))
    return one.select("blob", "doc_id", todo.alias("todo")).filter(F.size("todo") > 0)


def scan(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New rows of the ledger: blob, rules (versions it is now scanned with), spans."""

    def run(it: Iterator) -> Iterator:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("rule", pa.string())]))
        for blobs, todo, texts in batches(it, "blob", "todo", "text"):
            spans = []
            for names, t in zip(todo, texts):
                mine = {r.kind: r for r in rules if r.name in names}
                spans.append([{"kind": k, "start": a, "end": b, "rule": mine[k].name} for k, a, b in find(t, tuple(mine.values()))])
            yield pa.record_batch([pa.array(blobs, pa.binary()), pa.array(todo, pa.list_(pa.string())), pa.array(spans, kind)], names=["blob", "rules", "spans"])

    p = paths(docs)
    new = unseen(p.select("doc_id", "blob"), ledger, rules)
    held = join_paths(p, new).select("blob", "todo", "text")
    return held.mapInArrow(run, ROWS).dropDuplicates(["blob"])


class Ledger:
    """The stored pairs of blob and rule version under a folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or spark.conf.get(LEDGER, None) or f"{shared_dir(spark)}/registrum-secret-ledger-{uuid.uuid4().hex}"

    def rows(self) -> DataFrame:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(self.path)

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans what is unseen, appends it, and gives all rows."""
        scan(docs, self.rows(), rules).write.mode("append").option("compression", "zstd").parquet(self.path)
        return self.rows()


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob, spans (by start, then in the order of rules) of every path under these versions of the rules."""
    at = {r.name: k for k, r in enumerate(rules)}
    hits = ledger.filter(F.size("spans") > 0).select("blob", F.filter("spans", lambda x: x["rule"].isin(*at)).alias("spans"))
    place = F.create_map(*[F.lit(x) for pair in at.items() for x in pair])
    hits = hits.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    keyed = F.transform("spans", lambda x: F.struct(x["start"], place[x["rule"]].alias("at"), x["kind"], x["end"], x["rule"]))
    spans = F.transform(F.sort_array(keyed), lambda x: F.struct(x["kind"], x["start"], x["end"], x["rule"]))
    none = F.array().cast(SPANS)
    return paths(docs).select("doc_id", "blob").join(hits.select("blob", spans.alias("spans")), "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, spans: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping spans replaced by mark; spans: doc_id, blob, spans of documents that have some."""
    cols = docs.columns

    def run(it: Iterator) -> Iterator:
        for b in it:
            texts = []
            for t, ss in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist()):
                out, at = [], 0
                for s in sorted(ss or [], key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        out += [t[at : s["start"]], mark]
                    at = max(at, s["end"])
                texts.append("".join(out) + t[at:] if out else t)
            yield pa.record_batch([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in cols], names=cols)

    d = docs.withColumn("_blob", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    hits = spans.dropDuplicates(["doc_id", "blob"]).select(F.col("doc_id").alias("_doc_id"), F.col("blob").alias("_found"), F.col("spans").alias("_spans"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_blob") == F.col("_found"))
    return d.join(hits, same, "left").select(*cols, "_spans").mapInArrow(run, docs.schema)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ledger = Ledger(spark).update(docs)
    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
    of = lambda k: F.filter(spans, lambda x: x["kind"] == k)
    n = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return findings(docs, ledger).select("doc_id", *n, F.sha2(digest(base), 256).alias("base_sha256"), digest(spans).alias("spans"))


def _found_sql(k: int, r: Rule) -> str:
    """The spans of a rule in text t as a list of structs: places come from the parts between matches."""
    p = r.pattern.replace("'", "''")
    start = "list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    spans = f"list_transform(range(1, len(m) + 1), lambda i: {{'start': ({start})::int, 'k': {k}, 'kind': '{r.kind}', 'end': ({start} + length(m[i]))::int, 'n': length(g[i])}})"
    lists = f"select regexp_extract_all(t, '{p}') m, regexp_extract_all(t, '{p}', {r.group}) g, string_split_regex(t, '{p}') s"
    return f"coalesce((select list_filter({spans}, lambda x: x.n >= {r.least}) from ({lists})), [])"


_TEXT = "list_transform({}, lambda x: x.kind || ':' || x.start || ':' || x.end)"
_BASE = "list_filter(f, lambda x: x.k < 3)"
OP6_SQL = f"""
with d as (select doc_id, coalesce(text, '') t from documents),
f as (select doc_id, list_sort(flatten([{", ".join(_found_sql(k, r) for k, r in enumerate(RULES))}])) f from d)
select doc_id, {", ".join(f"len(list_filter(f, lambda x: x.k = {k}))::bigint n_{kind}" for k, kind in enumerate(BASE))},
  sha256(coalesce(array_to_string({_TEXT.format(_BASE)}, ','), '')) base_sha256, coalesce(array_to_string({_TEXT.format("f")}, ','), '') spans from f"""

"""Filter interaction audit by Walsh-Hadamard sums.

A document's five filter failures are a mask of five bits. Per part and label class, 32 signed parity sums (the sum over documents
of (-1) to the number of bits that mask and index share) are aggregated on the map side; the transform is its own inverse up to a
factor of 32, so the documents of each mask follow exactly, in whole numbers. All 120 orders of the filters are evaluated on those
32 cells, and a filter's removals over all orders have a closed form: a document that fails k filters is removed by each of them
in 120 / k orders.

Defined cases: a null text is an empty one, a null lang the part ""; a row without a doc_id is nobody's earlier copy and never
fails E; rows with one doc_id and one text don't make each other fail E; labels of one doc_id are joined by "any", a row without
labels is neither good nor toxic; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.llm.common import doc_texts, documents

FILTERS = "ABCDE"
BIT = {c: 1 << i for i, c in enumerate(FILTERS)}
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]


def text_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and the bits of the filters that look at one text alone (A to D)."""
    d = doc_texts(docs, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    w = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    upper = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    seen = d.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), (100 * upper > 10 * F.length("text")).alias("C"), F.col("text").rlike(r"[#$%&*|]").alias("D"), w.alias("w"))
    seen = seen.withColumns({"A": F.size("w") < 100, "B": 100 * F.size(F.array_distinct("w")) < 80 * F.size("w")})
    return seen.select("doc_id", "part", "digest", sum((F.when(F.col(c), F.lit(BIT[c])).otherwise(F.lit(0)) for c in "ABCD"), F.lit(0)).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds label: 1 for quality 1, plus 2 for toxic 1. Rows without a doc_id, which meet no label, are spread by their digest."""
    one = lambda c, b: F.max(F.when(F.col(c) == 1, F.lit(b)).otherwise(F.lit(0)))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg((one("quality", 1) + one("toxic", 2)).alias("label")).withColumn("spread", F.lit(0).cast("long"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("spread", spread).join(known, ["doc_id", "spread"], "left").drop("spread").withColumn("label", F.coalesce("label", F.lit(0)))


def counted(rows: DataFrame) -> DataFrame:
    """part, label, mask and n: documents counted, with the bit of E added to those whose text a smaller doc_id has.

    Copies are counted before they meet: a text's rows are folded to one a part and label, with the least doc_id and its rows.
    """
    key = ["digest", "part", "label", "mask"]
    at = rows.groupBy(*key, "doc_id").agg(F.count("*").alias("n"))
    named, n = F.col("doc_id").isNotNull(), F.col("n")
    own = at.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.when(named, F.lit(0)).otherwise(n)).alias("loose"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"))
    least = own.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    own = own.join(least, "digest").withColumn("early", F.col("loose") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0)))
    both = F.array(F.struct("mask", F.col("early").alias("n")), F.struct((F.col("mask") + BIT["E"]).alias("mask"), (n - F.col("early")).alias("n")))
    return own.select("part", "label", F.explode(both).alias("c")).select("part", "label", "c.mask", "c.n").filter("n > 0")


def _sign(a: Column, b: Column) -> Column:
    return 1 - 2 * F.bit_count(a.bitwiseAND(b)).bitwiseAND(F.lit(1))


def parity_sums(rows: DataFrame) -> DataFrame:
    """part, label and s: the 32 signed parity sums of rows (part, label, mask, n)."""
    return rows.groupBy("part", "label").agg(F.array(*[F.sum(F.col("n") * _sign(F.col("mask"), F.lit(u))) for u in range(CELLS)]).alias("s"))


def cells(sums: DataFrame) -> DataFrame:
    """part and cells, an array of (mask, n, good, toxic): the sums inverted."""
    inverse = lambda m: F.aggregate(F.transform("s", lambda v, u: v * _sign(u, m)), F.lit(0).cast("long"), lambda a, v: a + v)
    cell = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda m: F.struct(m.alias("mask"), F.shiftright(inverse(m), len(FILTERS)).alias("n")))
    c = sums.select("part", "label", F.explode(cell).alias("c")).select("part", "label", "c.mask", "c.n")
    has = lambda b: F.sum(F.when(F.col("label").bitwiseAND(F.lit(b)) > 0, F.col("n")).otherwise(F.lit(0)))
    c = c.groupBy("part", "mask").agg(F.sum("n").alias("n"), has(1).alias("good"), has(2).alias("toxic"))
    return c.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))


def evaluate(parts: DataFrame) -> DataFrame:
    """A row for each part, order and step, from the part's 32 cells."""
    steps = [{"filter_order": o, "step": k + 1, "bit": BIT[o[k]], "before": sum(BIT[c] for c in o[:k])} for o in ORDERS for k in range(len(o))]
    each = F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")).alias("o")
    d = parts.select("part", "cells", each).select("part", "cells", "o.*")
    bit, before = F.col("bit"), F.col("before")
    fails, earlier = (lambda m: m.bitwiseAND(bit) > 0), (lambda m: m.bitwiseAND(before) > 0)

    def total(which, what=lambda c: c["n"]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(which(c["mask"]), what(c)).otherwise(F.lit(0)))

    removed = lambda m: fails(m) & ~earlier(m)
    share = lambda c: c["n"] * F.floor(F.lit(len(ORDERS)) / F.bit_count(c["mask"]))
    return d.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & ~earlier(m)).alias("kept"), total(removed).alias("removed"), total(lambda m: fails(m) & earlier(m)).alias("redundant"), total(lambda m: m == bit).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"), total(removed, lambda c: c["toxic"]).alias("toxic_lost"), total(fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over all of docs: rows of part, filter_order and step."""
    return evaluate(cells(parity_sums(counted(labelled(text_masks(docs), labels)))))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """600 rows a part; every count is over whole documents."""
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents),
e as (select t, min(doc_id) least from d group by t),
w as (select d.*, least, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w from d join e using (t)),
l as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id),
f as (select part, coalesce(good, false) good, coalesce(toxic, false) toxic, (case when len(w) < 100 then 'A' else '' end)
  || (case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' else '' end) || (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 'C' else '' end)
  || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end) || (case when doc_id > least then 'E' else '' end) fails from w left join l using (doc_id)),
g as (select part, fails, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from f group by part, fails),
c as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
o as (select a.x || b.x || c.x || d.x || e.x filter_order from c a, c b, c c, c d, c e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step, substr(filter_order, 1, step - 1) before, substr(filter_order, step, 1) own from o, range(1, 6) r(step)),
x as (select part, filter_order, step, own, n, good, toxic, fails = own single, contains(fails, own) bad, translate(fails, before, '') <> fails gone from s, g),
y as (select part, filter_order, step::int step, own, coalesce(sum(n) filter (not bad and not gone), 0)::bigint kept, coalesce(sum(n) filter (bad and not gone), 0)::bigint removed,
  coalesce(sum(n) filter (bad and gone), 0)::bigint redundant, coalesce(sum(n) filter (single), 0)::bigint unique_fails,
  coalesce(sum(good) filter (bad and not gone), 0)::bigint good_lost, coalesce(sum(toxic) filter (bad and not gone), 0)::bigint toxic_lost from x group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint shapley from y"""

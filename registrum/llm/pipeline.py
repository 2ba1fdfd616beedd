"""Stages of the corpus pipeline; see corpus_pipeline.py.

Decisions are made for rows, named by doc_id and text together, so rows without a doc_id or with that of another text are kept or
dropped for their own text. Only repeated rows, equal in both, are one.

Defined cases of every stage: null and empty texts are rows like others (quality rejects them, as they have too few words);
repeated rows stay repeated but in near_dedup, which keeps one; of ties in near_dedup the row with the least name stays; extra
columns pass through, whatever their names, unless they begin with an underscore and are named like one of the library's own;
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.llm import decontaminate, packing, quality_rules, secrets, simhash
from registrum.llm.common import discard, documents, row_key, staged
from registrum.llm.tokens import tokenizer_path

#: The column that names a row within a stage.
KEY = "_row_key"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the strict policy keeps."""
    bad = quality_rules.apply_policy(quality_rules.stored_ledger(docs.select(row_key().alias("doc_id"), "text")), quality_rules.STRICT).filter("not kept").select(F.col("doc_id").alias(KEY)).distinct()
    return docs.withColumn(KEY, row_key()).join(bad, KEY, "left_anti").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id (one without comes last) of each group of near copies."""
    d = docs.withColumn(KEY, row_key())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", KEY)).alias("first")
    fps = staged(simhash.fingerprints(d, simhash.WORDS, KEY).groupBy("fp").agg(first), "distinct-fingerprints")
    edges = simhash.links(fps.select(F.col("fp").alias("node"), "fp"))
    named = simhash.joined(fps, simhash.components(edges).withColumnRenamed("node", "fp"), "fp", "left")
    discard(edges)
    kept = named.groupBy(F.coalesce("component", "fp")).agg(F.min("first").alias("first")).select(f"first.{KEY}")
    return d.join(kept, KEY, "left_semi").dropDuplicates([KEY]).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a test item."""
    d = docs.withColumn(KEY, row_key())
    found = decontaminate.contaminated(d, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=KEY)
    return d.join(found.select(KEY).distinct(), KEY, "left_anti").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every secret found is replaced by a mark, and n_chars follows."""
    hits = secrets.findings(docs, secrets.Ledger(spark).update(docs)).filter(F.size("spans") > 0)
    out = secrets.redact(docs, hits)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read again; a stage's table goes when the next one's is written."""
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return docs

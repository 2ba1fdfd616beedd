"""Exact fingerprints of canonical texts: Unicode, case and white space are folded, then a 128-bit xxhash names the text.

The hash only deals texts into buckets. Inside a bucket canonical texts are compared byte by byte, once for each different one, and
should unlike ones meet they get fingerprints of their own. Only DataFrame functions are used; normalisation (NFKC) and case folding
come from the ICU library that Spark's collations bring along, called by reflect().

Likeness of two exact fingerprints is 1 or 0: a text that differs by a word is another text.

Defined cases: a null text is an empty one, whose canonical form is empty, as is that of white space alone; rows are ordered by doc_id
(none comes first), then by the signed 64-bit hash of the text, then by text, and the row after a row is its next document, the first
one after the last, itself where it is alone; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from registrum.llm.common import discard, doc_texts, documents, staged

WHITE = "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
#: Keys of buckets with several rows are broadcast up to this many, which is counted first; beyond, every text is compared.
FEW = 1 << 18
#: Bytes of text in a block of consecutive rows, and the most blocks that their borders are kept for.
BLOCK_BYTES, BLOCKS = 32 << 20, 1 << 16


def canonical(text: Column) -> Column:
    """Compatibility normalisation, full case folding, normalisation again, and one space for every run of white space."""
    icu = lambda of, what, t: F.reflect(F.lit(f"com.ibm.icu.{of}"), F.lit(what), t, F.lit(True))
    compose = lambda t: icu("text.Normalizer", "compose", t)
    ascii_only = F.octet_length(text) == F.length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(compose(icu("lang.UCharacter", "foldCase", compose(text))))
    return F.trim(F.regexp_replace(folded, WHITE, " "))


def wide(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text with different seeds."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def hashed(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds {prefix}canon, {prefix}a and {prefix}b: the canonical form of a column and its two hashes."""
    d = df.withColumn(f"{prefix}canon", canonical(F.col(text)))
    return d.withColumns(dict(zip((f"{prefix}a", f"{prefix}b"), wide(F.col(f"{prefix}canon")))))


def variants(docs: DataFrame, keys: DataFrame) -> DataFrame | None:
    """a, b, canon and variant (from 2) of buckets in which unlike canonical texts meet; None if there are none.

    keys: a, b of every row. Only texts whose bucket has several rows are compared. Copies are folded before they are moved.
    """
    shared = staged(keys.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b"), "shared-buckets")
    d = hashed(doc_texts(docs), "text", "").select("a", "b", "canon")
    if len(shared.limit(FEW + 1).select(F.lit(1)).take(FEW + 1)) <= FEW:
        d = d.join(F.broadcast(shared), ["a", "b"], "left_semi")
    unlike = staged(d.groupBy("a", "b", "canon").agg(F.lit(1)).groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b"), "unlike-buckets")
    discard(shared)
    if unlike.isEmpty():
        discard(unlike)
        return None
    texts = hashed(doc_texts(docs), "text", "").select("a", "b", "canon").join(unlike, ["a", "b"], "left_semi").distinct()
    return texts.withColumn("variant", F.row_number().over(Window.partitionBy("a", "b").orderBy("canon"))).filter("variant > 1")


def named(df: DataFrame, unlike: DataFrame | None, prefix: str, name: str) -> DataFrame:
    """Adds name: the fingerprint of {prefix}canon."""
    hexed = F.lower(F.concat(*[F.lpad(F.hex(f"{prefix}{c}"), 16, "0") for c in "ab"]))
    if unlike is None:
        return df.withColumn(name, hexed)
    u = unlike.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("a", "b", "canon")], F.concat(F.lit("-"), F.col("variant").cast("string")).alias("_variant"))
    return df.join(u, [f"{prefix}a", f"{prefix}b", f"{prefix}canon"], "left").withColumn(name, F.concat(hexed, F.coalesce("_variant", F.lit("")))).drop("_variant")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""
    keys = staged(hashed(doc_texts(docs), "text", "").select("a", "b"), "fingerprint-keys")
    unlike = variants(docs, keys)
    discard(keys)
    return named(hashed(doc_texts(docs), "text", ""), unlike, "", "fingerprint").select("doc_id", "fingerprint")


def groups(fps: DataFrame) -> DataFrame:
    """fingerprint, n and doc_id (the smallest) of every class of equal texts of fingerprints()."""
    return fps.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))


def borders(keys: DataFrame) -> list[list]:
    """The first doc_id and order of each block of rows in order; keys: doc_id, order, bytes."""
    size = keys.agg(F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    least = min(4 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), size["rows"] // 64)
    n = max(1, min(BLOCKS, max(least, size["bytes"] // BLOCK_BYTES)))
    at = keys.select("doc_id", "order").repartitionByRange(n, "doc_id", "order").withColumn("part", F.spark_partition_id())
    firsts = at.groupBy("part").agg(F.min(F.struct("doc_id", "order")).alias("first")).select("first.*")
    return [list(r) for r in firsts.orderBy("doc_id", "order").collect()]


def with_next(rows: DataFrame, firsts: list[list], carried: list[str]) -> DataFrame:
    """rows (doc_id, order, text and carried) with next: a struct of text and carried of the row after.

    Texts move once, into blocks of consecutive rows; the first row of a block stands in the block before as well, as its last.
    """
    if not firsts:
        return rows.withColumn("next", F.struct("text", *carried))
    kind = f"struct<doc_id:{dict(rows.dtypes)['doc_id']},`order`:bigint>"
    step = math.isqrt(len(firsts) - 1) + 1
    records = [{"doc_id": d, "order": o} for d, o in firsts]
    dealt = [records[i : i + step] for i in range(0, len(records), step)]
    tops = F.from_json(F.lit(json.dumps([g[0] for g in dealt])), f"array<{kind}>")
    lists = F.from_json(F.lit(json.dumps(dealt)), f"array<array<{kind}>>")
    upto = lambda a: F.size(F.filter(a, lambda x: x <= F.col("_key"))) - 1
    d = rows.withColumn("_key", F.struct("doc_id", "order")).withColumn("_list", upto(tops))
    d = d.withColumn("_at", upto(F.get(lists, F.col("_list"))))
    block, first = F.col("_list") * step + F.col("_at"), F.get(F.get(lists, F.col("_list")), F.col("_at")) == F.col("_key")
    place = lambda b, edge: F.struct(b.alias("block"), F.lit(edge).alias("edge"))
    places = F.when(first, F.array(place(block, False), place(F.pmod(block - 1, F.lit(len(firsts))), True))).otherwise(F.array(place(block, False)))
    d = d.withColumn("_p", F.explode(places)).select(*rows.columns, "_p.block", "_p.edge")
    after = F.lead(F.struct("text", *carried)).over(Window.partitionBy("block").orderBy("edge", "doc_id", "order", "text"))
    return d.withColumn("next", after).filter("not edge").drop("block", "edge")


def edited(docs: DataFrame) -> DataFrame:
    """A row for each row: doc_id, n_chars, the digest of its edited text, both fingerprints and two likenesses.

    The edited text ends with the beginning of the next document's, as long as half the text. near_edited and near_next are 1
    where the canonical texts are equal, which is decided by their bytes once their hashes are equal.
    """
    d = hashed(doc_texts(docs), "text", "").withColumn("order", F.xxhash64("text"))
    keys = staged(d.select("doc_id", "order", F.octet_length("text").cast("long").alias("bytes"), "a", "b"), "fingerprint-keys")
    unlike, firsts = variants(docs, keys), borders(keys)
    discard(keys)
    d = with_next(d.drop("canon"), firsts, ["a", "b"]).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("changed", F.concat(F.left("text", F.length("text") - half), F.left("next.text", half)))
    d = hashed(d, "changed", "e_")
    near = lambda a, b, canon: F.when((F.col("a") == a) & (F.col("b") == b), F.when(canonical(F.col("text")) == canon, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))
    d = d.withColumns({"edited_sha256": F.sha2("changed", 256), "near_edited": near(F.col("e_a"), F.col("e_b"), F.col("e_canon")), "near_next": near(F.col("next.a"), F.col("next.b"), canonical(F.col("next.text")))})
    if unlike is not None:
        d = d.withColumn("canon", canonical(F.col("text")))
    d = named(named(d, unlike, "", "fingerprint"), unlike, "e_", "edited_fingerprint")
    return d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its edited text and its next document, by exact canonical fingerprints."""
    return edited(documents(spark, sf_dir))

"""What the operators share: table reading, shared staging, safe column handling."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"

#: Separators become spaces and A-Z lower case; bytes from 0x80 on stay.
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: str) -> list[bytes]:
    """Runs of ASCII letters (as lower case), digits and characters beyond ASCII, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; every other column of the caller is left behind."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def row_key() -> Column:
    """A name of a row by its doc_id and text, never null: rows with one name are repeated rows."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.concat(F.lit("="), F.col("text").cast("string")), F.lit("")))
    return F.unhex(F.sha2(named, 256))


def join_paths(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left and right joined on doc_id, where null equals null, and blob; both keys are left's."""
    named = right.withColumnsRenamed({"doc_id": "_right_doc_id", "blob": "_right_blob"})
    same = F.col("doc_id").eqNullSafe(F.col("_right_doc_id")) & (F.col("blob") == F.col("_right_blob"))
    return left.join(named, same, how).drop("_right_doc_id", "_right_blob")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; only a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not (own := getattr(shared_dir, "own", None)):
        own = shared_dir.own = tempfile.mkdtemp(prefix="registrum-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/registrum-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of staged() that nothing reads any more: what was made of them has been written."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._staged)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives the memory that a worker has freed back to the system: idle workers are kept, and what they hold counts on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def batches(it: Iterator, *cols: str) -> Iterator[tuple[list, ...]]:
    """Python lists of the named columns of each Arrow batch."""
    for b in it:
        if b.num_rows:
            yield tuple(b.column(c).to_pylist() for c in cols)

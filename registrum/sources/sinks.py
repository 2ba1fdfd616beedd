"""Sinks: CSV exports, GeoJSON, append-only history, paths of lead folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.functions import fixed
from registrum.functions.text import blank_to_null, sanitize_path_part


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite", order: list[str] | None = None, escape: str = '"') -> None:
    """CSV with a header in every part; order: parts and the rows in them follow these columns, so that part names list the whole in order."""
    out = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns or df.columns])
    by = [F.col(f"`{c}`") for c in order or []]
    out = out.repartitionByRange(*by).sortWithinPartitions(*by) if by else out
    out.write.mode(mode).option("header", True).option("emptyValue", "").option("escape", escape).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """part, bytes of an export's files, in the order in which they make the whole."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("part"), F.col("length").alias("bytes")).filter("part like 'part-%'").orderBy("part")


def join_parts(spark: SparkSession, path: str, target: str) -> int:
    """Writes an export's parts as one file, for programs that want one, with one header; gives the number of parts.

    Bytes are streamed from file to file, a buffer at a time; no task or driver holds the export.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    names = [r["part"] for r in manifest(spark, path).select("part").toLocalIterator()]
    fs = hadoop.fs.Path(path).getFileSystem(conf)
    out = hadoop.fs.Path(target).getFileSystem(conf).create(hadoop.fs.Path(target), True)
    try:
        for k, name in enumerate(names):
            part = fs.open(hadoop.fs.Path(f"{path.rstrip('/')}/{name}"))
            try:
                while k and part.read() not in (10, -1):  # later parts leave their header out; names of columns hold no line end
                    pass
                hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            finally:
                part.close()
    finally:
        out.close()
    return len(names)


def write_applications(leads: DataFrame, path: str) -> None:
    """Leads in the order of councils and references."""
    write_csv(leads, path, fixed.APPLICATION_COLUMNS, order=["council", "Reference"])


def write_failures(rows: DataFrame, path: str) -> None:
    write_csv(rows, path, fixed.FAILURE_COLUMNS, order=["council"])


def append_history(row: DataFrame, path: str) -> None:
    write_csv(row, path, fixed.HISTORY_COLUMNS, mode="append")


def drop_empty_json(*cols: str) -> Column:
    """JSON of the columns that are not blank, empty lists or empty objects, keys sorted."""
    keep = [F.when(~F.to_json(F.struct(c)).rlike(r'^\{"[^"]*":(""|\[\]|\{\})\}$|^\{\}$'), F.col(c)).alias(c) for c in sorted(cols)]
    return F.to_json(F.struct(*keep))


def feature_collection(targets: DataFrame, properties: list[str], geometry_json: str) -> DataFrame:
    """One row: a FeatureCollection of selected authorities. Its size is that of the catalogue, a few hundred."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.parse_json(geometry_json).alias("geometry"))
    return targets.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array_sort(F.collect_list(F.to_json(feature))).alias("features"))).alias("json"))


def lead_folder(date: Column, council: Column, reference: Column) -> Column:
    return F.concat_ws("/", sanitize_path_part(F.coalesce(blank_to_null(date), F.lit("undated"))), sanitize_path_part(council), sanitize_path_part(reference))


def catalogue_collection(targets: DataFrame, properties: list[str], geometry_json: str, generated_at: Column, source_url: str) -> DataFrame:
    """The catalogue file: feature_collection() with when and what it was made from."""
    wrap = F.concat(F.lit('{"generated_at":'), F.to_json(F.array(generated_at)).substr(F.lit(2), F.length(F.to_json(F.array(generated_at))) - 2), F.lit(',"source_url":"' + source_url + '",'), F.expr("substring(json, 2)"))
    return feature_collection(targets, properties, geometry_json).select(wrap.alias("json"))


def stream_applications(leads: DataFrame, path: str, checkpoint: str, found_at: str, delay: str = "30 days"):
    """Appends leads to Parquet as they are found, each reference once; restarts go on from the checkpoint.

    References seen are kept for delay of found_at (an event time), so the state stays bounded.
    """
    once = leads.withWatermark(found_at, delay).dropDuplicatesWithinWatermark(["Reference"])
    return once.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)

"""What a run does around its search: checks of its settings, metrics, caches, cancellation."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from registrum.functions.text import parse_keywords
from registrum.operators.relations import union_distinct


@dataclass(frozen=True)
class RunConfig:
    """A run's settings: window, keywords, areas, at most so many rows an authority."""

    start: str
    end: str
    keywords: tuple[str, ...]
    limit: int | None = None
    workers: int = 4
    #: Called with each stage's name and metrics.
    report: Callable[[str, dict], None] | None = field(default=None, compare=False)

    def __post_init__(self):
        if date.fromisoformat(self.start) > date.fromisoformat(self.end):
            raise ValueError("the window ends before it begins")
        if not [k for k in self.keywords if k.strip()]:
            raise ValueError("at least one keyword is needed")
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit must be positive")
        object.__setattr__(self, "workers", min(8, max(1, self.workers)))


def config_errors(rows: DataFrame, start: str, end: str, keywords: str) -> DataFrame:
    """rows with error: what is wrong with settings stored as text columns; null: nothing."""
    s, e = F.try_to_date(start, "yyyy-MM-dd"), F.try_to_date(end, "yyyy-MM-dd")
    words = F.coalesce(F.size(parse_keywords(F.coalesce(F.col(keywords), F.lit("")))), F.lit(0))
    return rows.withColumn("error", F.when(s.isNull() | e.isNull(), "no date").when(s > e, "window").when(words < 1, "keywords"))


def checked_targets(targets: DataFrame) -> DataFrame:
    """targets, which must be some."""
    if targets.isEmpty():
        raise ValueError("no authority meets the areas")
    return targets


def observed(df: DataFrame, stage: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df with an observation: its rows and further aggregates, known when a query over it has run, without another pass."""
    o = Observation(stage)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), *[m.alias(n) for n, m in metrics.items()]), o


def reported(config: RunConfig, stage: str, o: Observation) -> dict:
    """The observation's metrics, given to the run's callback too."""
    if config.report:
        config.report(stage, dict(o.get))
    return o.get


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs that this thread starts within carry the tag, so another thread can end them by cancel()."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Ends the running jobs of a tag; what sinks have committed stays."""
    spark.sparkContext.cancelJobsWithTag(tag)


def write_cache(rows: DataFrame, path: str) -> DataFrame:
    """Writes area records or link tests as a cache table and reads it back."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def cached_areas(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """Area records, those of the cache first; one row an area."""
    return union_distinct([cache, fetched], ["area_id", "area_name", "gss_code"], ["ordinal"])


def capped(rows: DataFrame, caps: DataFrame, by: str, turn: str) -> DataFrame:
    """Pages within their family's cap. caps: by, cap; a family without one has none."""
    return rows.join(F.broadcast(caps), by, "left").filter(F.col("cap").isNull() | (F.col(turn) <= F.col("cap"))).drop("cap")  # caps: a row a family

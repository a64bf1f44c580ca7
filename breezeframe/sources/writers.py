"""Writers: partitioned tables, reports, logs, exports and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed value: records shown by the log view -----------------------------
LOG_LIMIT = 100


def write_by_station(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per station. Rows stay where they are, so a large station keeps many writers."""
    writer = df.write.mode(mode).partitionBy("station")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per split; readers that filter on ``split`` open only theirs."""
    df.write.mode(mode).partitionBy("split").format(fmt).save(path)


def write_report(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    metrics.write.mode(mode).json(path)


def append_log(records: DataFrame, path: str) -> None:
    """Append only: concurrent jobs never rewrite each other's records."""
    records.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, order: list[str], limit: int = LOG_LIMIT) -> DataFrame:
    """The latest ``limit`` records (top-k, not a full sort)."""
    return latest_records(spark.read.parquet(path), order, limit)


def latest_records(records: DataFrame, order: list[str], limit: int = LOG_LIMIT) -> DataFrame:
    return records.orderBy(*[F.desc(c) for c in order]).limit(limit)


def export_selection(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

"""The dashboard's tables from the stored panel, forecast and log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import serving
from tidegauge.schema import TARGET_LABEL, TARGET_SERIES
from tidegauge.sources import publish


def history(monthly: DataFrame, series: str = TARGET_SERIES, label: str = TARGET_LABEL) -> DataFrame:
    """Realised values of one series of the long monthly table."""
    own = monthly.filter((F.col("series_id") == series) & F.col("value").isNotNull())
    return own.select(F.lit(label).alias("variavel"), "data", F.col("value").alias("valor"))


def build(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every published table by name; ``root`` holds the long table and the published runs."""
    past = history(spark.read.parquet(f"{root}/long").filter("freq = 'M'"))
    ahead = publish.read_current(spark, f"{root}/published", "forecast")
    served = serving.history_union(past, ahead)
    log = publish.read_all(spark, f"{root}/published", "tracking")
    return {
        "served": served,
        "models": serving.model_choices(ahead),
        "tracking": serving.tracking_errors(log, past.withColumnRenamed("valor", "ipca")),
        "cards": serving.cards(served),
        "fan_chart": serving.fan_chart(served, serving.FAN_ROWS),
        "fan_table": serving.fan_table(served),
    }

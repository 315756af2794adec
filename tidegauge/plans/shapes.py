"""The star-schema tables seen as time series.

Each shape is one scan with a partial aggregate on (key, day or month): a hot key leaves a
map task as one row per day. Values are means and totals of whole numbers, so every engine
and partitioning gets the same bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import month_start
from tidegauge.operators import grid
from tidegauge.session import settle

FLAGS = ["A", "N", "R"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EXOG = ["quantity", "discount", "tax", "line"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def percent(rate: Column) -> Column:
    """A rate with two decimals as a whole percent."""
    return F.rint(rate * 100)


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per priority and day."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("data")
    ).agg(F.sum(F.floor("o_totalprice").cast("double")).alias("value"))


def daily_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped value per return flag and day."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(
        F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("data")
    ).agg(F.sum(F.floor("l_extendedprice").cast("double")).alias("value"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event value per type and day."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(
        F.col("event_type").alias("series_id"), F.to_date("ts").alias("data")
    ).agg(F.sum(F.floor("value").cast("double")).alias("value"))


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.month_mean(daily_orders(spark, sf_dir), ["series_id"])


def monthly_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.month_mean(daily_lineitem(spark, sf_dir), ["series_id"])


def annual(daily: DataFrame) -> DataFrame:
    """Yearly totals of daily ones, dated 1 January."""
    year = F.trunc("data", "YEAR").alias("data")
    return daily.groupBy("series_id", year).agg(F.sum("value").alias("value"))


def annual_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per priority and year."""
    return annual(daily_orders(spark, sf_dir))


def months_back(df: DataFrame, months: int) -> Column:
    """The month that many months before the last date of ``data``, as a scalar subquery."""
    return df.agg(F.add_months(month_start(F.max("data")), -months).alias("end")).scalar()


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean discount in percent per return flag and month."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(
        F.col("l_returnflag").alias("series_id"),
        month_start(F.col("l_shipdate")).alias("data"),
    ).agg(F.avg(percent(F.col("l_discount"))).alias("value"))


def survey(spark: SparkSession, sf_dir: str, ref: str = "MM") -> DataFrame:
    """Survey rows: asked on the order date, about the period the line shipped in."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_shipdate", "l_discount", "l_quantity"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("l_returnflag").alias("series_id"),
        F.to_date("o_orderdate").alias("survey_date"),
        F.trunc("l_shipdate", ref).cast("date").alias("ref_date"),
        percent(F.col("l_discount")).alias("mean"),
        F.col("l_quantity").alias("median"),
    )


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums per flag, order month and ship day, stored: both raw tables are scanned once.

    The survey, the daily history and the last months are made of these cells, whose number
    is bounded by the calendar. The sums are of whole numbers, so means of them are exact.
    A line without an order has no order month.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_shipdate", "l_quantity", "l_discount", "l_extendedprice"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    cells = joined.groupBy(
        F.col("l_returnflag").alias("series_id"),
        month_start(F.col("o_orderdate")).alias("survey_date"),
        F.to_date("l_shipdate").alias("data"),
    ).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("l_quantity").alias("quantity"),
        F.sum(percent(F.col("l_discount"))).alias("percent"),
        F.sum(F.floor("l_extendedprice").cast("double")).alias("value"),
    )
    return settle(cells, "line_cells")


def shipped(cells: DataFrame) -> DataFrame:
    """``daily_lineitem`` from the cells."""
    return cells.groupBy("series_id", "data").agg(F.sum("value").alias("value"))


def asked(cells: DataFrame) -> DataFrame:
    """The cells' rows that have an order, per survey month and reference month."""
    rows = cells.filter(F.col("survey_date").isNotNull())
    return rows.withColumn("ref_date", month_start(F.col("data")))


def survey_table(cells: DataFrame) -> DataFrame:
    """One row per survey month and reference month."""
    return asked(cells).groupBy("series_id", "survey_date", "ref_date").agg(
        (F.sum("quantity") / F.sum("n_rows")).alias("median")
    )


def last_observed(rows: DataFrame, back: int = 15) -> DataFrame:
    """Last month of each series up to ``back`` months before the table's end.

    ``rows`` has ``series_id`` and ``data``; the columns are series_id, last. What comes
    after stands for what is not yet known.
    """
    months = rows.select("series_id", month_start(F.col("data")).alias("data"))
    known = months.filter(F.col("data") <= months_back(months, back))
    return known.groupBy("series_id").agg(F.max("data").alias("last"))


def served(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``split_served`` of the rates, stored as published forecasts are."""
    return split_served(settle(rates(spark, sf_dir), "rates"))


def split_served(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History and forecasts of two models, split 13 months before the end; both hold that month."""
    split = months_back(base, 13)
    history = base.filter(F.col("data") <= split).select(
        F.col("series_id").alias("variavel"), "data", F.col("value").alias("valor")
    )
    # per model: label and the factors of value, lower and upper bound
    models = F.array(
        *[
            F.struct(
                F.lit(name).alias("tipo"),
                (F.col("value") * mid).alias("valor"),
                (F.col("value") * lo).alias("ic_inferior"),
                (F.col("value") * hi).alias("ic_superior"),
            )
            for name, mid, lo, hi in (("Ridge", 1.015625, 0.875, 1.125), ("Huber", 0.984375, 0.75, 1.25))
        ]
    )
    ahead = base.filter(F.col("data") >= split)
    forecast = ahead.select(F.col("series_id").alias("variavel"), "data", F.inline(models))
    return history, forecast.select(
        "data", "valor", "ic_inferior", "ic_superior", "variavel", "tipo"
    )


def supplier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many targets: monthly price and four regressors per supplier."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(
        F.col("l_suppkey").alias("target_id"), month_start(F.col("l_shipdate")).alias("data")
    ).agg(
        F.avg(F.floor("l_extendedprice").cast("double")).alias("y"),
        F.avg("l_quantity").alias("quantity"),
        F.avg(percent(F.col("l_discount"))).alias("discount"),
        F.avg(percent(F.col("l_tax"))).alias("tax"),
        F.avg(F.col("l_linenumber").cast("double")).alias("line"),
    )


def supplier_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on each supplier's own month grid, gaps filled from the neighbours."""
    cells = supplier_cells(spark, sf_dir)
    columns = ["y", *EXOG]
    dense = grid.asfreq_month(cells, ["target_id"], columns, scope="series")
    return grid.fill_both(dense, ["target_id"], columns)


BALANCE = 25  # a quantity's usual level: about half of the months lie on each side


def signed_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier_frame`` with quantities counted from their usual level: both signs occur."""
    return supplier_frame(spark, sf_dir).withColumn("quantity", F.col("quantity") - BALANCE)


def brand_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly shipped value per brand and size of part: more series than are spelled out."""
    lines, month = table(spark, sf_dir, "lineitem"), month_start(F.col("l_shipdate")).alias("data")
    sold = lines.groupBy("l_partkey", month).agg(F.sum(F.floor("l_extendedprice").cast("double")).alias("value"))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_brand", "p_size").alias("series_id")
    )
    return sold.join(parts, "l_partkey").groupBy("series_id", "data").agg(F.sum("value").alias("value"))

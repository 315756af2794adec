"""The registered queries: each operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import (
    ceil_month,
    english_month,
    horizon,
    month_start,
    parse_date,
    parse_quarter,
    quarter_start,
    round_even,
    safe_ln,
)
from tidegauge.functions.power import yeo_johnson, yeo_johnson_inverse
from tidegauge.operators import align, blocks, draws, expectations, forecast, grid, models, panel, power, rounds
from tidegauge.operators import relational as rel
from tidegauge.operators import scenarios, serving, transforms
from tidegauge.plans import landing, outlook, shapes
from tidegauge.schema import CATALOG_HEADER
from tidegauge.session import new_dir, settle
from tidegauge.sources import ledger, payload_format, payloads, publish, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SERIES = ["series_id"]
H = 12


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Round the given columns (all doubles by default) so engines agree on the last bits."""
    names = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: round_even(F.col(f"`{n}`"), digits) for n in names})


def catalog_rows(spark: SparkSession) -> DataFrame:
    """Metadata of the series the tables hold."""
    sources = ["BCB/SGS", "IBGE/SIDRA", "IPEADATA", "FRED", "BCB/SGS"]
    rows = [
        (p, s, str(i + 1), "Diária", str(i + 2))
        for i, (p, s) in enumerate(zip(shapes.PRIORITIES, sources))
    ]
    rows += [(f, "FRED", str(i + 6), "Mensal", c) for i, (f, c) in enumerate(zip(shapes.FLAGS, "156"))]
    return spark.createDataFrame(
        rows, "series_id string, source string, input string, freq string, transform string"
    )


# sources --------------------------------------------------------------------------------


@query
def src_catalog(spark, sf_dir):
    # the catalog of the series that have rows, and an entry for every part
    seen = shapes.daily_orders(spark, sf_dir).select("series_id").distinct()
    parts = shapes.table(spark, sf_dir, "part").select(
        F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("series_id"),
        F.col("p_brand").alias("source"),
        F.col("p_name").alias("input"),
        F.when(F.col("p_size") % 2 == 0, "Diária").otherwise("Mensal").alias("freq"),
        (F.col("p_size") % 6 + 1).cast("string").alias("transform"),
    )
    path = new_dir(spark, "catalog")
    rows = rel.union_all(catalog_rows(spark).join(seen, "series_id"), parts)
    landing.land_catalog(rows, path, CATALOG_HEADER)
    return tables.read_catalog(spark, path)


@query
def src_json_array(spark, sf_dir):
    path = new_dir(spark, "json-array")
    landing.land_json_array(shapes.daily_orders(spark, sf_dir), path)
    return payloads.read_json_array(spark, path)


@query
def src_landed(spark, sf_dir):
    """Daily rows landed in two windows, each read once and kept by month."""
    path, store = new_dir(spark, "landing"), new_dir(spark, "landed")
    daily = settle(shapes.daily_orders(spark, sf_dir), "daily")
    early = F.col("data") < F.lit("1998-07-15").cast("date")  # within a month: both windows touch it
    for window in (early, ~early):
        landing.land_json_array(daily.filter(window), path, mode="append")
        rows = ledger.refresh(spark, path, payloads.read_json_array, store)
    return rows


@query
def src_payload_format(spark, sf_dir):
    """Two series since 1996 through the data source; files of other series and windows stay closed."""
    path = new_dir(spark, "windows")
    landing.land_json_windows(shapes.daily_orders(spark, sf_dir), path)
    payload_format.register(spark)
    rows = spark.read.format("payload").option("path", path).option("layout", "json_array").load()
    asked = F.col("series_id").isin("1-URGENT", "4-NOT SPECIFIED") & (F.col("data") >= F.lit("1996-01-01").cast("date"))
    return rows.filter(asked)


@query
def src_json_sentinel(spark, sf_dir):
    path = new_dir(spark, "json-sentinel")
    landing.land_json_sentinel(shapes.monthly_orders(spark, sf_dir), path)
    return rounded(payloads.read_json_sentinel(spark, path))


@query
def src_json_nested(spark, sf_dir):
    path = new_dir(spark, "json-nested")
    landing.land_json_nested(shapes.daily_lineitem(spark, sf_dir), path)
    return payloads.read_json_nested(spark, path)


@query
def src_csv_wide(spark, sf_dir):
    path = new_dir(spark, "csv-wide")
    landing.land_csv_wide(shapes.daily_lineitem(spark, sf_dir), path)
    return payloads.read_csv_wide(spark, path)


@query
def src_decimal_comma(spark, sf_dir):
    path = new_dir(spark, "decimal-comma")
    orders = shapes.table(spark, sf_dir, "orders")
    orders.select(
        "o_orderkey",
        "o_orderpriority",
        landing.decimal_comma_text(F.col("o_totalprice")).alias("o_totalprice"),
    ).write.csv(path, header=True)
    raw = payloads.read_decimal_comma(spark, path, ["o_totalprice"])
    return raw.withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query
def src_survey(spark, sf_dir):
    path = new_dir(spark, "survey")
    landing.land_survey(shapes.survey(spark, sf_dir), path)
    return payloads.read_survey(
        spark, path, ref="month", since="1998-01-01", indicator="IPCA", calc="C"
    )


@query
def src_parquet(spark, sf_dir):
    rows = tables.read_panel(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"])
    return rows


@query
def src_tracking(spark, sf_dir):
    path = new_dir(spark, "tracking")
    _, ahead = shapes.served(spark, sf_dir)
    stamped = ahead.withColumn("previsao", F.lit("2000-10-03 15:35:45.413654").cast("timestamp"))
    sinks.append_tracking(stamped, path)
    rows = tables.read_tracking(spark, path)
    stamp = F.date_format("previsao", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return rounded(rows.withColumn("previsao", stamp))


@query
def route_by_freq(spark, sf_dir):
    raw = shapes.daily_orders(spark, sf_dir).unionByName(shapes.rates(spark, sf_dir))
    return rounded(tables.route_by_freq(raw, catalog_rows(spark)))


@query
def backfill_windows(spark, sf_dir):
    spans = shapes.table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("series_id")
    ).agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    return tables.backfill_windows(spans, SERIES)


# sinks ----------------------------------------------------------------------------------


@query
def snk_parquet(spark, sf_dir):
    path = new_dir(spark, "long")
    daily = shapes.daily_orders(spark, sf_dir).withColumn("freq", F.lit("D"))
    monthly = shapes.monthly_orders(spark, sf_dir).withColumn("freq", F.lit("M"))
    sinks.write_long(daily.unionByName(monthly), path)
    stored = spark.read.schema(
        "series_id string, data date, value double, freq string, year int"
    ).parquet(path)
    halves = []
    for freq in ("D", "M"):
        wide = new_dir(spark, "wide")
        sinks.write_wide(align.to_wide(stored.filter(F.col("freq") == freq), shapes.PRIORITIES), wide)
        halves.append(spark.read.parquet(wide).withColumn("freq", F.lit(freq)))
    return rounded(rel.union_all(*halves))


@query
def snk_forecast(spark, sf_dir):
    path = new_dir(spark, "forecast")
    _, ahead = shapes.served(spark, sf_dir)
    sinks.write_forecast(ahead.withColumn("previsao", F.current_timestamp()), path)
    return rounded(spark.read.parquet(path))


@query
def snk_append(spark, sf_dir):
    path = new_dir(spark, "log")
    _, ahead = shapes.served(spark, sf_dir)
    for run in ("2000-10-03 12:00:00", "2000-10-10 12:00:00"):
        sinks.append_tracking(ahead.withColumn("previsao", F.lit(run).cast("timestamp")), path)
    rows = tables.read_tracking(spark, path)
    return rounded(rows.withColumn("previsao", F.date_format("previsao", "yyyy-MM-dd HH:mm:ss")))


@query
def snk_publish(spark, sf_dir):
    """Two runs, the second one twice: the current forecast, and the log with each run once."""
    root = new_dir(spark, "published")
    _, ahead = shapes.served(spark, sf_dir)
    ahead = settle(ahead, "ahead")
    for run in ("2000-10-03 12:00:00", "2000-10-10 12:00:00", "2000-10-10 12:00:00"):
        stamped = ahead.withColumn("previsao", F.lit(run).cast("timestamp"))
        publish.publish(spark, root, run, {"forecast": ahead, "tracking": stamped})
    log = publish.read_all(spark, root, "tracking")
    log = log.withColumn("previsao", F.date_format("previsao", "yyyy-MM-dd HH:mm:ss"))
    now = publish.read_current(spark, root, "forecast").withColumn("previsao", F.lit("now"))
    return rounded(rel.union_all(log, now))


# projections and predicates -------------------------------------------------------------


@query
def prj_select(spark, sf_dir):
    return rel.pick(shapes.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_tax"])


@query
def prj_tolerant(spark, sf_dir):
    orders = shapes.table(spark, sf_dir, "orders")
    return rel.pick_present(orders, ["o_orderstatus", "not_there", "o_orderkey"])


@query
def prj_drop(spark, sf_dir):
    return shapes.table(spark, sf_dir, "customer").drop("c_name", "c_acctbal")


@query
def prj_cast(spark, sf_dir):
    orders = shapes.table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        F.col("o_totalprice").cast("int").alias("price_int"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("level"),
        F.col("o_orderpriority").try_cast("double").alias("not_a_number"),
        F.col("o_custkey").cast("string").alias("customer"),
    )


@query
def flt_eq(spark, sf_dir):
    return shapes.table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select(
        "o_orderkey", "o_orderstatus"
    )


@query
def flt_in(spark, sf_dir):
    orders = shapes.table(spark, sf_dir, "orders")
    level = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    rows = orders.select("o_orderkey", "o_orderstatus", level.alias("level"))
    return rows.filter(
        rel.not_in(F.col("level"), ["1-URGENT", "2-HIGH"])
        & rel.is_in(F.col("o_orderstatus"), ["F", "O"])
    )


@query
def flt_range(spark, sf_dir):
    lines = shapes.table(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate")
    lo, hi = F.lit("1997-03-01").cast("timestamp_ntz"), F.lit("1998-02-28").cast("timestamp_ntz")
    return lines.filter(day.between(lo, hi)).select("l_orderkey", "l_linenumber")


@query
def flt_bool(spark, sf_dir):
    lines = shapes.table(spark, sf_dir, "lineitem")
    keep = ((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 40)) | (
        (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    )
    return lines.filter(keep).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


@query
def flt_at_extreme(spark, sf_dir):
    lines = shapes.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("series_id"),
        F.to_date("l_shipdate").alias("data"),
        "l_orderkey",
        "l_linenumber",
    )
    return rel.at_extremes(lines, SERIES, "data")


@query
def flt_year(spark, sf_dir):
    orders = shapes.table(spark, sf_dir, "orders")
    return orders.filter(rel.in_year(F.col("o_orderdate"), 1998)).select(
        "o_orderkey", F.to_date("o_orderdate").alias("day")
    )


@query
def flt_dropna(spark, sf_dir):
    wide = align.to_wide(shapes.daily_orders(spark, sf_dir), shapes.PRIORITIES)
    every = rel.drop_null(wide).withColumn("rule", F.lit("all"))
    some = rel.drop_null(wide, ["1-URGENT"]).withColumn("rule", F.lit("subset"))
    return rel.union_all(every, some)


@query
def flt_in_period(spark, sf_dir):
    cells = shapes.line_cells(spark, sf_dir)
    period = settle(grid.forecast_period(shapes.last_observed(cells), SERIES, H), "period")
    # reduced to months before it meets the period
    rows = shapes.asked(cells).groupBy(*SERIES, "ref_date").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("percent").alias("total")
    )
    return rel.in_period(rows, period, "ref_date", SERIES)


# joins ----------------------------------------------------------------------------------


@query
def jn_left_nway(spark, sf_dir):
    daily = shapes.daily_orders(spark, sf_dir)
    return align.to_wide(daily, shapes.PRIORITIES, anchors=["1-URGENT"])


@query
def jn_outer_nway(spark, sf_dir):
    both = rel.union_all(shapes.daily_orders(spark, sf_dir), shapes.daily_lineitem(spark, sf_dir))
    return align.to_wide(both, [*shapes.PRIORITIES, *shapes.FLAGS])


def _columns_to_rows(wide):
    """The wide table's columns as (series_id, value) rows, its nulls left out."""
    names = [c for c in wide.columns if c != "data"]
    values = F.expr(f"array({', '.join(map(align.quoted, names))})")
    pairs = F.arrays_zip(F.lit(names).alias("series_id"), values.alias("value"))
    return wide.select("data", F.inline(pairs)).filter("value is not null")


def _brand_columns(spark, sf_dir, anchored):
    rows = settle(shapes.brand_sizes(spark, sf_dir), "brand_sizes")
    # brands times sizes, which do not grow with the tables
    names = sorted(r["series_id"] for r in rows.select("series_id").distinct().collect())
    return _columns_to_rows(align.to_wide(rows, names, anchors=names[:1] if anchored else None))


@query
def jn_outer_many(spark, sf_dir):
    """A column for each brand and size, by slots: the full outer join of more than a thousand series."""
    return _brand_columns(spark, sf_dir, False)


@query
def jn_left_many(spark, sf_dir):
    """The same, on the months of the first series."""
    return _brand_columns(spark, sf_dir, True)


@query
def jn_left_monthlyised(spark, sf_dir):
    # the anchors end before the other series
    rates = settle(shapes.rates(spark, sf_dir), "rates")
    both = rel.union_all(
        rates.filter(F.col("data") <= shapes.months_back(rates, 6)),
        shapes.monthly_orders(spark, sf_dir),
    )
    wide = align.to_wide(both, [*shapes.FLAGS, *shapes.PRIORITIES], anchors=shapes.FLAGS)
    return rounded(wide)


@query
def panel_monthly(spark, sf_dir):
    daily = settle(shapes.daily_orders(spark, sf_dir), "daily")
    urgent = F.col("series_id") == "1-URGENT"
    # one daily series enters by its first row of the month, the others by their mean
    means = grid.month_mean(daily.filter(~urgent), SERIES)
    first = grid.month_first(daily.filter(urgent), SERIES)
    target = grid.upsample_ffill(
        shapes.annual(daily.filter(F.col("series_id") == "5-LOW")), SERIES, extend=11
    ).withColumn("series_id", F.lit("target"))
    asked = shapes.survey(spark, sf_dir)
    ahead = expectations.expectation(asked, expectations.Expectation("ref", steps=1))
    shipped = grid.month_mean(settle(shapes.daily_lineitem(spark, sf_dir), "shipped"), SERIES)
    rows = rel.union_all(
        means, first, target, ahead.select(F.lit("expected").alias("series_id"), "data", "value"), shipped
    )
    return rounded(align.to_wide(rows, [*shapes.PRIORITIES, "target", "expected", *shapes.FLAGS]))


# aggregates and grids -------------------------------------------------------------------


def _expectation(spark, sf_dir, ref, **spec):
    rows = shapes.survey(spark, sf_dir, ref)
    return rounded(expectations.expectation(rows, expectations.Expectation(**spec), by=SERIES))


@query
def exp_by_ref_h1(spark, sf_dir):
    return _expectation(spark, sf_dir, "MM", key="ref", steps=1)


@query
def exp_by_ref_h6(spark, sf_dir):
    return _expectation(spark, sf_dir, "MM", key="ref", steps=6)


@query
def exp_by_survey_month_trunc(spark, sf_dir):
    return _expectation(
        spark, sf_dir, "YEAR", key="month", steps=1, unit_days=365, truncated=True
    )


@query
def exp_by_survey_month_raw(spark, sf_dir):
    return _expectation(spark, sf_dir, "YEAR", key="month", steps=1, unit_days=365)


@query
def exp_by_survey_quarter(spark, sf_dir):
    return _expectation(spark, sf_dir, "QUARTER", key="quarter", steps=9)


@query
def exp_monthly_mean(spark, sf_dir):
    return _expectation(spark, sf_dir, "MM", key="month")


@query
def rs_month_mean(spark, sf_dir):
    return rounded(shapes.monthly_orders(spark, sf_dir))


@query
def rs_month_first(spark, sf_dir):
    return grid.month_first(shapes.daily_orders(spark, sf_dir), SERIES)


@query
def rs_month_last(spark, sf_dir):
    daily = shapes.daily_orders(spark, sf_dir)
    # null out large days: the last non-null row is not always the last row
    holes = daily.withColumn("value", F.when(F.col("value") % 3 != 0, F.col("value")))
    return grid.month_last(holes, SERIES)


@query
def rs_annual_ffill(spark, sf_dir):
    return grid.upsample_ffill(shapes.annual_orders(spark, sf_dir), SERIES)


@query
def rs_annual_extend(spark, sf_dir):
    return grid.upsample_ffill(shapes.annual_orders(spark, sf_dir), SERIES, extend=11)


@query
def agg_month_median(spark, sf_dir):
    return rounded(scenarios.month_median(shapes.monthly_orders(spark, sf_dir), SERIES))


@query
def agg_latest_complete(spark, sf_dir):
    asked, _, last = _lines(spark, sf_dir)
    rows = expectations.latest_complete(asked, grid.forecast_period(last, SERIES, H), H, SERIES)
    return rows.groupBy(*SERIES, "survey_date").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def agg_null_share(spark, sf_dir):
    # daily rows keep only those dated on the 1st, so these series have holes
    daily = settle(shapes.daily_orders(spark, sf_dir), "daily")
    cells = settle(rel.union_all(daily, shapes.monthly_lineitem(spark, sf_dir)), "cells")
    on_grid = grid.asfreq_month(cells, SERIES)
    goal = grid.month_mean(daily, SERIES).filter("series_id = '1-URGENT'")
    bounds = panel.target_bounds(goal, [], start="1995-01-01")
    share = panel.null_share(on_grid, SERIES, bounds.select("n_y").scalar())
    return rounded(share.withColumn("kept", F.col("null_share") < panel.MAX_NULL_SHARE))


@query
def agg_distinct_list(spark, sf_dir):
    _, ahead = shapes.served(spark, sf_dir)
    choices = serving.model_choices(ahead)
    return choices.withColumn("modelos", F.array_join("modelos", ","))


@query
def ts_asfreq_month(spark, sf_dir):
    cells = rel.union_all(shapes.daily_orders(spark, sf_dir), shapes.daily_lineitem(spark, sf_dir))
    return grid.asfreq_month(settle(cells, "daily"), SERIES)


@query
def ts_forecast_period(spark, sf_dir):
    daily = settle(shapes.daily_lineitem(spark, sf_dir), "shipped")
    return grid.forecast_period(shapes.last_observed(daily), SERIES, H)


@query
def ts_trunc(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return shapes.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        month_start(day).alias("month"),
        quarter_start(day).alias("quarter"),
        ceil_month(day).alias("next_month"),
    )


@query
def win_bfill_ffill(spark, sf_dir):
    on_grid = grid.asfreq_month(settle(shapes.daily_orders(spark, sf_dir), "daily"), SERIES)
    return grid.fill_both(on_grid, SERIES)


@query
def win_compound12(spark, sf_dir):
    return rounded(transforms.rolling_compound(shapes.rates(spark, sf_dir), SERIES))


LONG_BLOCK = 5_000  # rows; small, so that the given tables have several blocks


def _lines_as_one(spark, sf_dir, value):
    """Every line a row of one series, in the order of its keys; where they are equal, of its price and tax."""
    places = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "floor(l_extendedprice)", "round(l_tax * 100)"]
    spelled = [F.lpad(F.expr(f"cast({p} as bigint)").cast("string"), 12, "0") for p in places]
    return shapes.table(spark, sf_dir, "lineitem").select(
        F.lit("lines").alias("series_id"), F.concat(*spelled).alias("data"), value.cast("double").alias("value")
    )


@query
def win_long_diff2(spark, sf_dir):
    step = lambda df, by: transforms.transform(df, "3", by)
    rows = _lines_as_one(spark, sf_dir, F.floor("l_extendedprice"))
    return rounded(blocks.over_blocks(rows, SERIES, step, before=2, block_rows=LONG_BLOCK))


@query
def win_long_compound12(spark, sf_dir):
    step = lambda df, by: transforms.rolling_compound(df, by)
    rows = _lines_as_one(spark, sf_dir, F.round(F.col("l_tax") * 100))
    return rounded(blocks.over_blocks(rows, SERIES, step, before=11, block_rows=LONG_BLOCK))


@query
def win_long_fill(spark, sf_dir):
    """All events as one series, known where an error was seen; backward, then forward fill."""
    seen = F.when(F.col("event_type") == "error", F.col("value"))
    rows = shapes.table(spark, sf_dir, "events").select(
        F.lit("events").alias("series_id"), F.col("event_id").alias("data"), seen.alias("value")
    )
    return rounded(blocks.over_blocks(rows, SERIES, grid.fill_both, fill=["value"], block_rows=LONG_BLOCK))


def _transformed(spark, sf_dir, code):
    return rounded(transforms.transform(shapes.monthly_orders(spark, sf_dir), code))


@query
def tr_diff(spark, sf_dir):
    return _transformed(spark, sf_dir, "2")


@query
def tr_diff2(spark, sf_dir):
    return _transformed(spark, sf_dir, "3")


@query
def tr_log(spark, sf_dir):
    return _transformed(spark, sf_dir, "4")


@query
def tr_logdiff(spark, sf_dir):
    return _transformed(spark, sf_dir, "5")


@query
def tr_logdiff2(spark, sf_dir):
    return _transformed(spark, sf_dir, "6")


@query
def tr_by_catalog(spark, sf_dir):
    rows = rel.union_all(shapes.monthly_orders(spark, sf_dir), shapes.rates(spark, sf_dir))
    return rounded(transforms.transform_by_catalog(rows, catalog_rows(spark)))


@query
def srt_date(spark, sf_dir):
    ordered = shapes.daily_orders(spark, sf_dir).orderBy("data", "series_id")
    return ordered


@query
def lim_last_n(spark, sf_dir):
    return rel.last_n(shapes.daily_orders(spark, sf_dir), SERIES, "data", 240)


@query
def set_union(spark, sf_dir):
    return rel.union_all(shapes.daily_orders(spark, sf_dir), shapes.daily_events(spark, sf_dir))


@query
def set_union_missing(spark, sf_dir):
    left = shapes.daily_orders(spark, sf_dir)
    right = shapes.rates(spark, sf_dir).withColumnRenamed("value", "rate")
    return rounded(rel.union_all(left, right, fill=True))


# scalar functions -----------------------------------------------------------------------


@query
def fn_date_parse(spark, sf_dir):
    day = F.col("o_orderdate")
    text = shapes.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.date_format(day, "dd/MM/yyyy").alias("br"),
        F.date_format(day, "yyyyMM").alias("code"),
        F.date_format(day, "MM/yyyy").alias("month"),
        F.date_format(day, "yyyy").alias("year"),
        F.concat_ws("/", F.quarter(day), F.year(day)).alias("quarter"),
    )
    return text.select(
        "o_orderkey",
        parse_date(F.col("br"), "dd/MM/yyyy").alias("br"),
        parse_date(F.col("code"), "yyyyMM").alias("code"),
        parse_date(F.col("month"), "MM/yyyy").alias("month"),
        parse_date(F.col("year"), "yyyy").alias("year"),
        parse_quarter(F.col("quarter")).alias("quarter"),
    )


@query
def fn_date_format(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return shapes.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.date_format(day, "yyyy-MM-dd").alias("iso"),
        F.date_format(day, "MM/yyyy").alias("month_year"),
        F.date_format(day, "dd/MM/yyyy").alias("br"),
        F.date_format(day, "yyyy-MM-01").alias("first_day"),
        english_month(day).alias("month_name"),
        F.month(day).alias("month_no"),
        F.year(day).alias("year_no"),
    )


@query
def fn_numeric(spark, sf_dir):
    lines = shapes.table(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        round_even(safe_ln(F.col("l_discount")), 6).alias("ln_discount"),
        round_even(F.col("l_quantity") / 8, 2).alias("even"),
        horizon(day, F.lit("1998-06-15").cast("date"), 30).alias("h30"),
        horizon(day, F.lit("1998-06-15").cast("date"), 365).alias("h365"),
        F.replace(F.col("l_returnflag"), F.lit("N"), F.lit("none")).alias("flag"),
    )


# models ---------------------------------------------------------------------------------


TARGET = ["target_id"]
EXOG = ["quantity", "discount"]
PLAIN = panel.features(EXOG, dummies=False)
SCALED = ["quantity", "discount", "tax"]  # the first has both signs
STILL = 1e-6  # largest gradient of a proved fit, relative to its terms


def _rows(spark, sf_dir, exog=EXOG, dummies=False):
    frame = shapes.supplier_frame(spark, sf_dir)
    return panel.design_matrix(frame, TARGET, exog, dummies=dummies)


@query
def mod_seasonal_dummies(spark, sf_dir):
    return panel.add_dummies(shapes.monthly_orders(spark, sf_dir).select("series_id", "data"))


@query
def mod_design_matrix(spark, sf_dir):
    return rounded(_rows(spark, sf_dir, shapes.EXOG, dummies=True))


def _ridge(spark, sf_dir, rows=None):
    rows = _rows(spark, sf_dir) if rows is None else rows
    return models.fit_ridge(rows, TARGET, PLAIN)


@query
def mod_ridge(spark, sf_dir):
    fitted = _ridge(spark, sf_dir)
    return rounded(
        fitted.select(
            "target_id",
            "n_rows",
            "intercept",
            F.col("coef")[0].alias("w_lag"),
            F.col("coef")[1].alias("w_quantity"),
            F.col("coef")[2].alias("w_discount"),
        ),
        4,
    )


@query
def mod_residuals(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rounded(models.residuals(rows, _ridge(spark, sf_dir, rows), TARGET, PLAIN), 4)


@query
def mod_huber(spark, sf_dir):
    fitted = models.fit_huber(_rows(spark, sf_dir), TARGET, PLAIN)
    return rounded(
        fitted.select(
            "target_id",
            "n_rows",
            "intercept",
            F.col("coef")[0].alias("w_lag"),
            F.col("coef")[1].alias("w_quantity"),
            F.col("coef")[2].alias("w_discount"),
        ),
        2,
    )


def _proved(proof, by):
    """Proofs as 0/1 columns; a gradient is zero up to ``STILL`` of the sizes of its terms."""
    return proof.select(
        *by,
        "n_rows",
        F.col("converged").cast("int").alias("converged"),
        (F.col("gradient") < STILL).cast("int").alias("stationary"),
    )


@query
def mod_ridge_proof(spark, sf_dir):
    """All 16 features of every supplier: the objective's gradient vanishes at the fit."""
    rows = settle(_rows(spark, sf_dir, shapes.EXOG, dummies=True), "design")
    return _proved(outlook.proofs(rows, TARGET, shapes.EXOG, ["Ridge"]), TARGET)


@query
def mod_huber_proof(spark, sf_dir):
    """The same for the Huber fits, whose scale is a variable as well."""
    rows = settle(_rows(spark, sf_dir, shapes.EXOG, dummies=True), "design")
    return _proved(outlook.proofs(rows, TARGET, shapes.EXOG, ["Huber"]), TARGET)


@query
def mod_huber_rounds(spark, sf_dir):
    """Huber by distributed rounds, 16 features, one target a return flag, every line a row."""
    lines = shapes.table(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    rows = lines.select(
        F.col("l_returnflag").alias("flag"),
        day.alias("data"),
        F.floor("l_extendedprice").cast("double").alias("y"),
        F.col("l_quantity").cast("double").alias(panel.LAG),
        F.col("l_discount").cast("double").alias("quantity"),
        F.col("l_tax").cast("double").alias("discount"),
        F.col("l_linenumber").cast("double").alias("tax"),
        F.dayofmonth(day).cast("double").alias("line"),
    )
    rows, by = settle(panel.add_dummies(rows), "design"), ["flag"]
    fitted = rounds.fit_huber_by_rounds(rows, by, panel.features(shapes.EXOG))
    proof = models.stationarity(rows, fitted, by, panel.features(shapes.EXOG), **outlook.OBJECTIVES["Huber"])
    return _proved(proof.join(fitted.select("flag", "converged"), "flag"), by)


@query
def mod_yeo_johnson_apply(spark, sf_dir):
    rows = shapes.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("v"))
    lams = {"m1": -1.0, "zero": 0.0, "half": 0.5, "one": 1.0, "two": 2.0, "three": 3.0}
    return rows.select(
        "c_custkey",
        *[round_even(yeo_johnson(F.col("v"), F.lit(x)), 6).alias(n) for n, x in lams.items()],
    )


@query
def mod_yeo_johnson_inverse(spark, sf_dir):
    # values within the inverse's domain for every exponent used
    rows = shapes.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 20000).alias("z"))
    lams = {"m1": -1.0, "zero": 0.0, "half": 0.5, "one": 1.0, "two": 2.0, "three": 3.0}
    return rows.select(
        "c_custkey",
        *[round_even(yeo_johnson_inverse(F.col("z"), F.lit(x)), 6).alias(n) for n, x in lams.items()],
    )


@query
def mod_yeo_johnson_lambda(spark, sf_dir):
    frame = shapes.supplier_frame(spark, sf_dir)
    return rounded(power.power_params(frame, TARGET, "quantity"), 4)


@query
def mod_yeo_johnson_signed(spark, sf_dir):
    """The search on values of both signs."""
    return rounded(power.power_params(shapes.signed_frame(spark, sf_dir), TARGET, "quantity"), 4)


@query
def mod_frame_params(spark, sf_dir):
    """Exponent, mean and deviation of three columns of a frame at once, one of them of both signs."""
    frame = shapes.signed_frame(spark, sf_dir)
    return rounded(power.frame_params(frame, TARGET, SCALED), 4)


@query
def mod_frame_apply(spark, sf_dir):
    """The frame on its transformed, standardised scale."""
    frame = settle(shapes.signed_frame(spark, sf_dir), "frame").select(*TARGET, "data", *SCALED)
    return rounded(power.frame_apply(frame, power.frame_params(frame, TARGET, SCALED), TARGET, SCALED), 4)


# scenarios and forecasts ----------------------------------------------------------------


def _lines(spark, sf_dir):
    """Survey table, daily history and last months, from one pass over the raw tables."""
    cells = shapes.line_cells(spark, sf_dir)
    last = settle(shapes.last_observed(cells), "last")
    return settle(shapes.survey_table(cells), "survey"), shapes.shipped(cells), last


@query
def scn_survey(spark, sf_dir):
    asked, _, last = _lines(spark, sf_dir)
    return rounded(scenarios.survey_path(asked, grid.forecast_period(last, SERIES, H), H, SERIES))


@query
def scn_survey_transformed(spark, sf_dir):
    asked, _, last = _lines(spark, sf_dir)
    period = grid.forecast_period(last, SERIES, H)
    path = scenarios.survey_path_transformed(
        asked, period, last.withColumnRenamed("last", "data"), H, "5", SERIES
    )
    return rounded(path)


@query
def scn_seasonal_median(spark, sf_dir):
    daily = settle(shapes.daily_lineitem(spark, sf_dir), "shipped")
    period = grid.forecast_period(shapes.last_observed(daily), SERIES, H)
    return rounded(scenarios.seasonal_path(grid.month_mean(daily, SERIES), period, SERIES))


@query
def scn_assemble(spark, sf_dir):
    asked, daily, last = _lines(spark, sf_dir)
    period = grid.forecast_period(last, SERIES, H)
    keyed = lambda df: df.withColumnRenamed("series_id", "target_id")
    paths = {
        "expected": keyed(scenarios.survey_path(asked, period, H, SERIES)),
        "price": keyed(
            scenarios.survey_path_transformed(
                asked, period, last.withColumnRenamed("last", "data"), H, "5", SERIES
            )
        ),
        "shipped": keyed(scenarios.seasonal_path(grid.month_mean(daily, SERIES), period, SERIES)),
    }
    return rounded(scenarios.assemble(paths, TARGET))


def _supplier_scenario(frame, exog, h=H):
    """Seasonal medians of every regressor for the months after each target's last."""
    last = frame.groupBy(*TARGET).agg(F.max("data").alias("last"))
    period = grid.forecast_period(last, TARGET, h).withColumn("month", F.month("data"))
    medians = frame.groupBy(*TARGET, F.month("data").alias("month")).agg(
        *[F.median(c).alias(c) for c in exog]
    )
    return period.join(medians, [*TARGET, "month"]).drop("month")


def _forecast_inputs(frame, fitted, exog, lam=1.0):
    scenario = _supplier_scenario(frame, exog)
    start = frame.groupBy(*TARGET).agg(F.max_by("y", "data").alias("start"))
    steps = forecast.step_inputs(scenario, fitted, TARGET, exog)
    return steps.join(start, TARGET).withColumns(
        {"lam": F.lit(lam), "mu": F.lit(0.0), "sd": F.lit(1.0)}
    )


@query
def fc_recursive(spark, sf_dir):
    frame = settle(shapes.supplier_frame(spark, sf_dir), "frame")
    rows = panel.design_matrix(frame, TARGET, EXOG, dummies=False)
    inputs = _forecast_inputs(frame, models.fit_ridge(rows, TARGET, PLAIN), EXOG)
    return rounded(forecast.forecast_point(inputs, TARGET), 3)


def _interval(frame, alpha=models.RIDGE_ALPHA, made=forecast.forecast_interval):
    """Intervals of every supplier, on the square-root-like scale of exponent 0.5."""
    frame = frame.withColumn("y", yeo_johnson(F.col("y"), F.lit(0.5)))
    rows = panel.design_matrix(frame, TARGET, EXOG, dummies=False)
    fitted = models.fit_ridge(rows, TARGET, PLAIN, alpha=alpha)
    resid = forecast.residual_lists(models.residuals(rows, fitted, TARGET, PLAIN), TARGET)
    inputs = _forecast_inputs(frame, fitted, EXOG, lam=0.5).join(resid, TARGET)
    return made(inputs, TARGET)


@query
def fc_bootstrap_interval(spark, sf_dir):
    return rounded(_interval(settle(shapes.supplier_frame(spark, sf_dir), "frame")), 2)


@query
def fc_bootstrap_dealt(spark, sf_dir):
    """The same bounds from paths dealt over tasks and quantiles found by counting."""
    frame = settle(shapes.supplier_frame(spark, sf_dir), "frame")
    return rounded(_interval(frame, made=draws.forecast_interval_dealt), 2)


@query
def fc_table(spark, sf_dir):
    # two ridge fits stand for the two models
    frame = settle(shapes.supplier_frame(spark, sf_dir), "frame")
    parts = [
        forecast.forecast_table(
            _interval(frame, alpha),
            F.col("target_id").cast("string"),
            F.lit(name),
            F.lit("2001-12-03 15:35:45").cast("timestamp_ntz"),
        )
        for name, alpha in (("Ridge", 1.0), ("Ridge10", 10.0))
    ]
    rows = rel.union_all(*parts)
    return rounded(rows.withColumn("previsao", F.date_format("previsao", "yyyy-MM-dd HH:mm:ss")), 2)


@query
def fc_published(spark, sf_dir):
    """The published chain for every supplier: searched exponents, 16 features, both models, 5,000 paths."""
    frame = settle(shapes.supplier_frame(spark, sf_dir), "frame")
    scenario = outlook.seasonal_scenario(frame, TARGET, shapes.EXOG)
    return rounded(outlook.fit_and_forecast(frame, scenario, TARGET, shapes.EXOG), 4)


@query
def fc_published_proof(spark, sf_dir):
    """The fits behind ``fc_published``, on their own scale: both models, 16 features."""
    frame = settle(shapes.supplier_frame(spark, sf_dir), "frame")
    _, rows = outlook.scaled_design(frame, TARGET, shapes.EXOG)
    return _proved(outlook.proofs(rows, TARGET, shapes.EXOG), [*TARGET, "tipo"])


# serving --------------------------------------------------------------------------------


def _served(spark, sf_dir):
    return serving.history_union(*shapes.served(spark, sf_dir))


@query
def serve_history_union(spark, sf_dir):
    return rounded(_served(spark, sf_dir).orderBy("data", "variavel", "tipo"))


@query
def serve_tracking(spark, sf_dir):
    rates = settle(shapes.rates(spark, sf_dir), "rates")
    _, ahead = shapes.split_served(rates)
    log = ahead.withColumn("previsao", F.lit("2000-10-03"))
    observed = rates.filter(F.col("data") <= shapes.months_back(rates, 6)).select(
        F.col("series_id").alias("variavel"), "data", F.col("value").alias("ipca")
    )
    return serving.tracking_errors(log, observed)


@query
def serve_forecast_year(spark, sf_dir):
    return serving.forecast_year(_served(spark, sf_dir))


@query
def serve_yoy(spark, sf_dir):
    return serving.year_compound(_served(spark, sf_dir))


@query
def serve_next_mom(spark, sf_dir):
    return serving.next_value(_served(spark, sf_dir))


@query
def serve_last(spark, sf_dir):
    return serving.last_value(_served(spark, sf_dir))


@query
def serve_fanchart(spark, sf_dir):
    return serving.fan_chart(_served(spark, sf_dir), serving.FAN_ROWS)


@query
def serve_fantable(spark, sf_dir):
    return serving.fan_table(_served(spark, sf_dir))


@query
def serve_cards(spark, sf_dir):
    return serving.cards(_served(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest yearly compound of monthly log growth, per series."""
    growth = transforms.transform(shapes.monthly_orders(spark, sf_dir), "5")
    percent = growth.withColumn("value", F.col("value") * 100)
    yearly = transforms.rolling_compound(percent, SERIES).filter(F.col("compound").isNotNull())
    return rounded(rel.at_extreme(yearly, SERIES, "data"))

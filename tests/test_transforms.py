import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidegauge.functions import horizon, parse_quarter, round_even, safe_ln, utc_date
from tidegauge.operators import relational as rel
from tidegauge.operators import transforms

VALUES = [3.0, 4.0, 2.5, 8.0, 1.5, 6.0]
ROWS = [("a", f"2020-{m:02d}-01", v) for m, v in enumerate(VALUES, 1)]


def pandas_transform(s, code):
    return {
        "1": lambda: s,
        "2": lambda: s.diff(),
        "3": lambda: s.diff().diff(),
        "4": lambda: np.log(s),
        "5": lambda: np.log(s).diff(),
        "6": lambda: np.log(s).diff().diff(),
    }[code]()


def values(df):
    return [r.value for r in df.orderBy("series_id", "data").collect()]


@pytest.mark.parametrize("code", list("123456"))
def test_codes(long, code):
    got = values(transforms.transform(long(ROWS), code))
    want = pandas_transform(pd.Series(VALUES), code)
    assert [v is None for v in got] == list(want.isna())
    assert np.allclose([v for v in got if v is not None], want.dropna())


def test_unknown_code(long, spark):
    with pytest.raises(ValueError, match="unknown transform code"):
        transforms.transform(long(ROWS), "7")
    catalog = spark.createDataFrame([("a", "9")], "series_id string, transform string")
    with pytest.raises(PySparkException, match="unknown transform code: 9"):
        transforms.transform_by_catalog(long(ROWS), catalog).collect()
    empty = catalog.filter("false")
    with pytest.raises(PySparkException, match="unknown transform code: NULL"):
        transforms.transform_by_catalog(long(ROWS), empty).collect()


def test_each_series_takes_its_own_code(long, spark):
    rows = [*ROWS, *[("b", d, v) for _, d, v in ROWS]]
    catalog = spark.createDataFrame([("a", "2"), ("b", "5")], "series_id string, transform string")
    got = values(transforms.transform_by_catalog(long(rows), catalog))
    want = [*pandas_transform(pd.Series(VALUES), "2"), *pandas_transform(pd.Series(VALUES), "5")]
    assert np.allclose([np.nan if v is None else v for v in got], want, equal_nan=True)


def test_log_of_zero_and_negative_is_null(long):
    rows = [("a", "2020-01-01", 0.0), ("a", "2020-02-01", -1.0), ("a", "2020-03-01", 1.0)]
    assert [r.v for r in long(rows).select("data", safe_ln(F.col("value")).alias("v")).orderBy("data").collect()] == [
        None,
        None,
        0.0,
    ]


def test_rolling_compound_needs_every_row(long):
    rates = [0.5, 0.1, None, 0.3, 0.2, 0.4, 0.6]
    rows = [("a", f"2020-{m:02d}-01", v) for m, v in enumerate(rates, 1)]
    got = transforms.rolling_compound(long(rows), ["series_id"], rows=3).orderBy("data").collect()
    want = pd.Series(rates, dtype=float).rolling(3).apply(lambda x: ((x / 100 + 1).prod() - 1) * 100)
    assert np.allclose([np.nan if r.compound is None else r.compound for r in got], want, equal_nan=True)


def test_scalars(spark):
    df = spark.sql(
        "SELECT DATE'2020-03-01' r, DATE'2020-02-05' s, '3/2024' q, "
        "'2020-01-01T00:30:00+03:00' ts, 0.125D tie, 0.375D up"
    )
    row = df.select(
        horizon(F.col("r"), F.col("s"), 30).alias("near"),
        horizon(F.col("s"), F.col("r"), 30).alias("past"),
        parse_quarter(F.col("q")).alias("q"),
        utc_date(F.col("ts")).alias("d"),
        round_even(F.col("tie")).alias("tie"),
        round_even(F.col("up")).alias("up"),
    ).head()
    assert (row.near, row.past) == (0, 0)
    assert (row.q.isoformat(), row.d.isoformat()) == ("2024-07-01", "2019-12-31")
    assert (row.tie, row.up) == (0.12, 0.38)


def test_utc_date_in_another_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        df = spark.sql("SELECT '2020-01-01T00:00:00-02:00' ts, '2020-01-01T23:30:00-03:00' late")
        row = df.select(utc_date(F.col("ts")).alias("a"), utc_date(F.col("late")).alias("b")).head()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (row.a.isoformat(), row.b.isoformat()) == ("2020-01-01", "2020-01-02")


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "v string")
    assert {r.v for r in df.filter(rel.not_in(F.col("v"), ["x"])).collect()} == {"y", None}


def test_extreme_keeps_ties_and_last_n(long):
    rows = [("a", "2020-01-01", 1.0), ("a", "2020-02-01", 9.0), ("a", "2020-03-01", 9.0), ("b", "2020-01-01", None)]
    got = rel.at_extreme(long(rows), ["series_id"], "value").collect()
    assert sorted(r.data.month for r in got) == [2, 3]
    assert [r.data.month for r in rel.last_n(long(rows), ["series_id"], "data", 1).orderBy("series_id").collect()] == [3, 1]


def test_assign_sees_earlier_columns(spark):
    df = rel.assign(spark.range(1), a=F.lit(2), b=F.col("a") * 3)
    assert df.head().b == 6


def test_year_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "days")
    spark.sql("SELECT explode(sequence(DATE'2019-12-30', DATE'2020-01-03')) AS data").write.parquet(path)
    df = spark.read.parquet(path).filter(rel.in_year(F.col("data"), 2020))
    assert df.count() == 3
    assert "GreaterThanOrEqual(data,2020-01-01)" in df._jdf.queryExecution().toString()


def test_both_extremes_keep_ties_and_skip_null(spark):
    rows = spark.createDataFrame(
        [("a", 1, 0), ("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 5, 4), ("b", None, 5), ("c", None, 6)],
        "k string, v int, n int",
    )
    got = {(r["n"], r["edge"]) for r in rel.at_extremes(rows, ["k"], "v").collect()}
    assert got == {(0, "first"), (1, "first"), (3, "last"), (4, "first"), (4, "last")}

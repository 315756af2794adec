"""Grids against pandas on the same rows."""

import datetime as dt

import pandas as pd
import pytest

from tidegauge.operators import align, grid
from tidegauge.schema import require_unique

BY = ["series_id"]


def frame(rows):
    out = pd.DataFrame(rows, columns=["series_id", "data", "value"])
    out["data"] = pd.to_datetime(out["data"])
    return out


def as_dict(df, value="value"):
    return {(r.series_id, r.data.isoformat()): r[value] for r in df.collect()}


def expected(series):
    """{(series, date): value or None} from {name: pandas series}."""
    return {
        (name, day.date().isoformat()): None if pd.isna(v) else v
        for name, s in series.items()
        for day, v in s.items()
    }


ROWS = [
    ("a", "2020-01-15", 1.0),
    ("a", "2020-02-01", 2.0),
    ("a", "2020-02-20", 3.0),
    ("a", "2020-05-01", None),
    ("a", "2020-07-01", 5.0),
    ("a", "2020-08-09", 6.0),
    ("b", "2020-03-01", 7.0),
    ("b", "2020-03-31", 8.0),
    ("c", "2020-04-02", 9.0),
    ("c", "2020-04-20", 9.5),
    ("c", "2020-06-20", 9.7),
]


def each():
    f = frame(ROWS)
    return {n: g.set_index("data")["value"] for n, g in f.groupby("series_id")}


def test_asfreq_series_scope(long):
    got = as_dict(grid.asfreq_month(long(ROWS), BY, scope="series"))
    assert got == expected({n: s.asfreq("MS") for n, s in each().items()})


def test_asfreq_panel_scope(long):
    wide = frame(ROWS).pivot(index="data", columns="series_id", values="value").asfreq("MS")
    got = as_dict(grid.asfreq_month(long(ROWS), BY, scope="panel"))
    assert got == expected({n: wide[n] for n in wide})


def test_asfreq_panel_starts_on_the_first(long):
    rows = [("a", "2020-01-01", 1.0), ("b", "2020-03-05", 2.0)]
    wide = frame(rows).pivot(index="data", columns="series_id", values="value").asfreq("MS")
    got = as_dict(grid.asfreq_month(long(rows), BY, scope="panel"))
    assert got == expected({n: wide[n] for n in wide})


def test_unknown_scope(long):
    with pytest.raises(ValueError):
        grid.asfreq_month(long(ROWS), BY, scope="world")


def test_month_mean(long):
    got = as_dict(grid.month_mean(long(ROWS), BY))
    assert got == expected({n: s.resample("MS").mean() for n, s in each().items()})


def test_month_mean_panel(long):
    wide = frame(ROWS).pivot(index="data", columns="series_id", values="value").resample("MS").mean()
    got = as_dict(grid.month_mean(long(ROWS), BY, scope="panel"))
    assert got == expected({n: wide[n] for n in wide})


def test_month_first_keeps_date_and_null(long):
    f = frame(ROWS)
    heads = f.groupby(["series_id", f.data.dt.to_period("M")]).head(1)
    want = {
        (r.series_id, r.data.date().isoformat()): None if pd.isna(r.value) else r.value
        for r in heads.itertuples()
    }
    assert as_dict(grid.month_first(long(ROWS), BY)) == want


def test_first_of_month_survives_grid_only_if_dated_on_it(long):
    first = grid.month_first(long(ROWS), BY)
    got = as_dict(grid.asfreq_month(first, BY, scope="series"))
    assert got[("a", "2020-02-01")] == 2.0
    assert got[("a", "2020-08-01")] is None


def test_month_last_is_redated_and_skips_null(long):
    rows = [*ROWS, ("a", "2020-08-31", None)]
    f = frame(rows).dropna()
    tails = f.groupby(["series_id", f.data.dt.to_period("M")]).tail(1)
    want = {(r.series_id, r.data.strftime("%Y-%m-01")): r.value for r in tails.itertuples()}
    assert as_dict(grid.month_last(long(rows), BY)) == want


@pytest.mark.parametrize("day", ["01-01", "03-01", "12-31"])
def test_upsample_ffill(long, day):
    rows = [("x", f"20{y}-{day}", float(y)) for y in (10, 11, 14)]
    s = frame(rows).set_index("data")["value"]
    got = as_dict(grid.upsample_ffill(long(rows), BY))
    assert got == expected({"x": s.resample("MS").ffill()})


def test_upsample_extends_the_last_value(long):
    rows = [("x", "2010-01-01", 1.0), ("x", "2011-01-01", 2.0)]
    got = as_dict(grid.upsample_ffill(long(rows), BY, extend=11))
    assert len(got) == 24 and got[("x", "2011-12-01")] == 2.0 and got[("x", "2010-12-01")] == 1.0


def test_fill_both(long):
    rows = [("a", f"2020-{m:02d}-01", v) for m, v in enumerate([None, 2, None, None, 5, None], 1)]
    s = frame(rows).set_index("data")["value"].astype(float)
    assert as_dict(grid.fill_both(long(rows), BY)) == expected({"a": s.bfill().ffill()})
    assert as_dict(grid.fill_forward(long(rows), BY)) == expected({"a": s.ffill()})


def test_forecast_period(spark):
    last = spark.createDataFrame([("a", dt.date(2020, 11, 1))], "series_id string, last date")
    got = [(r.step, r.data.isoformat()) for r in grid.forecast_period(last, BY, 3).orderBy("step").collect()]
    assert got == [(1, "2020-12-01"), (2, "2021-01-01"), (3, "2021-02-01")]


def test_left_join_keeps_null_anchor_rows(long):
    rows = [
        ("a", "2020-01-01", 1.0),
        ("a", "2020-02-01", None),
        ("b", "2020-02-01", 5.0),
        ("b", "2020-03-01", 6.0),
    ]
    sides = {n: g.set_index("data")[["value"]].rename(columns={"value": n}) for n, g in frame(rows).groupby("series_id")}
    for how, anchors in (("left", ["a"]), ("outer", None)):
        want = sides["a"].join(sides["b"], how=how)
        got = align.to_wide(long(rows), ["a", "b"], anchors=anchors).collect()
        assert {r.data.isoformat(): (r.a, r.b) for r in got} == {
            d.date().isoformat(): tuple(None if pd.isna(v) else v for v in row)
            for d, row in zip(want.index, want.to_numpy())
        }
    kept = align.keep_anchor_dates(long(rows), ["a"])
    assert {(r.series_id, r.data.month) for r in kept.collect()} == {("a", 1), ("a", 2), ("b", 2)}


def test_duplicate_key_is_an_error(long):
    df = long([("a", "2020-01-01", 1.0), ("a", "2020-01-01", 2.0)])
    with pytest.raises(ValueError, match="duplicate key"):
        require_unique(df, ["series_id", "data"])
    require_unique(df.limit(1), ["series_id", "data"])


def test_hot_series_gives_the_same_result_on_any_partitioning(spark):
    """One series holds most rows; the result does not depend on how rows are spread."""
    rows = spark.range(40000).selectExpr(
        "if(id % 3 = 0, concat('s', cast(id % 30 as string)), 'hot') as series_id",
        "date_add(DATE'2000-01-01', cast(id * 7919 % 4000 as int)) as data",
        "cast(id % 101 as double) as value",
    )
    results = []
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        made = grid.month_mean(rows.repartition(n), BY).selectExpr(
            "count(*) as n", "sum(round(value, 6)) as total", "count(value) as held"
        )
        r = made.head()
        results.append((r.n, round(r.total, 3), r.held))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]

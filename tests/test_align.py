"""Many series side by side: slots against the spelled-out columns and the long rows."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import align

SF = "/root/testdata/sf0.01"


def triples(wide, names):
    out = set()
    for row in wide.collect():
        out |= {(row["data"], n, row[n]) for n in names if row[n] is not None}
    return out


def test_slots_equal_spelled_columns(spark, long):
    names = [f"s{i}" for i in range(align.LANES * 2 + 3)]
    rows = [(n, f"2020-{1 + (i * k) % 12:02d}-01", i + k) for i, n in enumerate(names) for k in (1, 5) if i != 7]
    rows = list({r[:2]: r for r in rows}.values())
    df = long([*rows, ("s9", "2021-01-01", None), ("other", "2022-01-01", 1.0), ("odd `name", "2020-01-01", 4.0)])
    names.append("odd `name")
    wide = align.to_wide(df, names)
    assert wide.columns == ["data", *names]
    want = {(r["data"], r["series_id"], r["value"]) for r in df.collect() if r["series_id"] != "other" and r["value"] is not None}
    assert triples(wide, names) == want
    # a date with a null alone is a date of the outer join, one of a series that is not asked for is none
    days = {str(r["data"]) for r in wide.select("data").collect()}
    assert "2021-01-01" in days and "2022-01-01" not in days


@pytest.mark.parametrize("anchors", [["s3"], ["s3", "s100"], ["other"], ["s9"]])
def test_anchors_keep_the_same_dates_as_spelled_columns(spark, long, anchors):
    names = [f"s{i}" for i in range(align.LANES + 40)]
    rows = [(n, f"20{10 + i % 9}-0{1 + i % 7}-01", i) for i, n in enumerate(names)]
    df = long([*rows, ("s9", "2021-01-01", None), ("other", "2012-03-01", 1.0)])
    wide = align.to_wide(df, names, anchors=anchors)
    kept = {r["data"] for r in df.filter(F.col("series_id").isin(*anchors)).collect()}
    assert {r["data"] for r in wide.select("data").collect()} == kept
    want = {(r["data"], r["series_id"], r["value"]) for r in df.collect() if r["data"] in kept and r["value"] is not None}
    assert triples(wide, names) == {x for x in want if x[1] != "other"}


def test_slots_by_key_and_twice_named(spark):
    rows = [(g, f"s{i}", "2020-01-01", float(i)) for g in "ab" for i in range(70) if g == "a" or i % 2]
    df = spark.createDataFrame(rows, "g string, series_id string, data string, value double")
    names = [f"s{i}" for i in range(70)]
    wide = {r["g"]: r for r in align.to_wide(df, names, by=["g"]).collect()}
    assert [wide["a"][n] for n in names] == [float(i) for i in range(70)]
    assert [wide["b"][n] for n in names] == [float(i) if i % 2 else None for i in range(70)]
    with pytest.raises(ValueError, match="twice"):
        align.to_slots(df, ["s1", "s1"])
    assert align.to_wide(df.limit(0), names).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_all_parts_as_columns(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    rows = lines.groupBy(F.col("l_partkey").cast("string").alias("series_id"), F.trunc("l_shipdate", "MM").alias("data")).agg(
        F.sum(F.floor("l_extendedprice").cast("double")).alias("value")
    )
    names = [str(r[0]) for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()]
    assert len(names) == 2000
    begun = time.monotonic()
    wide = align.to_wide(rows, names).toPandas().set_index("data").sort_index()
    assert time.monotonic() - begun < 30
    want = rows.toPandas().pivot(index="data", columns="series_id", values="value").sort_index()
    assert (wide.reindex(columns=want.columns).fillna(-1) == want.fillna(-1)).all(axis=None)
    assert wide[[n for n in names if n not in want.columns]].isna().all(axis=None)


def test_plan_does_not_grow_with_the_series(spark, long):
    df = long([("s1", "2020-01-01", 1.0)])
    plans = [
        align.to_slots(df, [f"s{i}" for i in range(n)])._jdf.queryExecution().executedPlan().toString() for n in (200, 2000)
    ]
    assert abs(len(plans[0]) - len(plans[1])) < 100

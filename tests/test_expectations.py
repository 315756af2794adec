"""Survey horizons and scenario paths."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import expectations, scenarios
from tidegauge.operators.expectations import SURVEYS, Expectation

d = dt.date


def survey(spark, rows):
    return spark.createDataFrame(rows, "survey_date date, ref_date date, mean double")


def as_dict(df):
    return {r.data: r.value for r in df.collect()}


def random_survey(seed, refs):
    rng = np.random.default_rng(seed)
    days = [d(2020, 1, 1) + dt.timedelta(int(k)) for k in rng.integers(0, 700, 600)]
    return [(day, refs[int(rng.integers(len(refs)))], float(rng.integers(0, 9))) for day in days]


MONTHS = [d(2020 + i // 12, i % 12 + 1, 1) for i in range(36)]
QUARTERS = MONTHS[::3]
YEARS = MONTHS[::12]


@pytest.mark.parametrize("name,refs", [(n, MONTHS if s.ref in ("month", None) else QUARTERS if s.ref == "quarter" else YEARS) for n, s in SURVEYS.items()])
def test_every_survey_against_pandas(spark, name, refs):
    spec = SURVEYS[name]
    rows = random_survey(11, refs)
    f = pd.DataFrame(rows, columns=["s", "r", "mean"])
    f["s"], f["r"] = pd.to_datetime(f["s"]), pd.to_datetime(f["r"])
    freq = {"month": "M", "quarter": "Q"}.get(spec.key)
    period = f.s.dt.to_period(freq).dt.to_timestamp() if freq else f.r
    base = period if spec.truncated else f.s
    if spec.steps is not None:
        whole = ((f.r - base) / np.timedelta64(spec.unit_days, "D")).astype(int)
        f, period = f[whole == spec.steps], period[whole == spec.steps]
    want = f["mean"].groupby(period).mean()
    got = as_dict(expectations.expectation(survey(spark, rows), spec))
    assert len(got) > 0
    assert got == pytest.approx({k.date(): v for k, v in want.items()})


def test_horizon_zero_spans_both_sides(spark):
    rows = [(d(2020, 1, 31), d(2020, 2, 1), 1.0), (d(2020, 2, 20), d(2020, 2, 1), 3.0), (d(2020, 3, 2), d(2020, 2, 1), 9.0)]
    got = as_dict(expectations.expectation(survey(spark, rows), Expectation("ref", steps=0)))
    assert got == {d(2020, 2, 1): 2.0}


def path_frame(spark, rows):
    return spark.createDataFrame(rows, "target_id string, survey_date date, ref_date date, median double")


def period(spark, h=3):
    rows = [("t", i, MONTHS[12 + i]) for i in range(1, h + 1)]
    return spark.createDataFrame(rows, "target_id string, step int, data date")


def test_latest_complete_survey(spark):
    full = [("t", d(2021, 1, 8), m, float(i)) for i, m in enumerate(MONTHS[12:17])]
    older = [("t", d(2021, 1, 1), m, 50.0) for m in MONTHS[12:17]]
    short = [("t", d(2021, 1, 15), m, 99.0) for m in MONTHS[12:15]]
    rows = path_frame(spark, [*older, *full, *short])
    got = as_dict(scenarios.survey_path(rows, period(spark), 3, ["target_id"]))
    assert got == {MONTHS[13]: 1.0, MONTHS[14]: 2.0, MONTHS[15]: 3.0}
    none = scenarios.survey_path(path_frame(spark, short), period(spark), 3, ["target_id"])
    assert none.count() == 0


def test_path_with_the_last_month_is_differenced_in_date_order(spark):
    levels = {12: 5.0, 13: 5.5, 14: 5.2, 15: 6.0}
    rows = [("t", d(2021, 1, 8), MONTHS[i], v) for i, v in sorted(levels.items(), reverse=True)]
    last = spark.createDataFrame([("t", MONTHS[12])], "target_id string, data date")
    got = as_dict(
        scenarios.survey_path_transformed(path_frame(spark, rows), period(spark), last, 3, "2", ["target_id"])
    )
    assert got == pytest.approx({MONTHS[13]: 0.5, MONTHS[14]: -0.3, MONTHS[15]: 0.8})


def test_seasonal_path_and_assembly(spark):
    x = spark.createDataFrame(
        [("t", MONTHS[i], v) for i, v in ((1, 1.0), (13, 3.0), (2, 4.0), (14, None), (3, 7.0), (8, 8.0))],
        "target_id string, data date, value double",
    )
    rows = scenarios.seasonal_path(x, period(spark), ["target_id"])
    assert {(r.month, r.value, r.data) for r in rows.collect()} == {
        (2, 2.0, MONTHS[13]),
        (3, 4.0, MONTHS[14]),
        (4, 7.0, MONTHS[15]),
        (9, 8.0, None),
    }
    other = spark.createDataFrame(
        [("t", MONTHS[13], 1.5), ("t", MONTHS[15], 2.5)], "target_id string, data date, value double"
    )
    made = scenarios.assemble({"a": rows, "b": other}, ["target_id"]).orderBy("data").collect()
    assert [(r.data, r.a, r.b, r.February, r.March) for r in made] == [
        (MONTHS[13], 2.0, 1.5, 1, 0),
        (MONTHS[14], 4.0, None, 0, 1),
        (MONTHS[15], 7.0, 2.5, 0, 0),
    ]
    assert "December" not in made[0].asDict()

"""Survey expectations at a fixed horizon."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import horizon, month_start, quarter_start

_PERIODS = {"month": month_start, "quarter": quarter_start}


@dataclass(frozen=True)
class Expectation:
    """How one survey becomes a series.

    key: ``ref`` (keyed by reference date) or ``month`` / ``quarter`` (of the survey date).
    unit_days, steps: keep rows whose whole horizon equals ``steps`` units; None keeps all.
    truncated: measure the horizon from the start of the survey's period, not its day.
    ref: form of the reference period in the payload.
    """

    key: str
    steps: int | None = None
    unit_days: int = 30
    truncated: bool = False
    ref: str | None = "month"


# The surveys, their horizons and keys.
SURVEYS = {
    "expec_ipca_top5_curto_prazo": Expectation(key="ref", steps=1, unit_days=30),
    "expec_ipca_top5_medio_prazo": Expectation(key="ref", steps=6, unit_days=30),
    "expec_selic": Expectation(key="month", steps=1, unit_days=365, truncated=True, ref="year"),
    "expec_cambio": Expectation(key="ref", steps=1, unit_days=30),
    "expec_ipca_12m": Expectation(key="month", steps=None, ref=None),
    "expec_pib": Expectation(key="quarter", steps=9, unit_days=30, ref="quarter"),
    "expec_primario": Expectation(key="month", steps=1, unit_days=365, ref="year"),
}


def expectation(
    survey: DataFrame, spec: Expectation, by: Sequence[str] = (), value: str = "mean"
) -> DataFrame:
    """Mean expectation per date at the horizon the spec asks for.

    A filter and one partial aggregate: a hot survey date is averaged map-side.
    """
    asked = F.col("survey_date")
    period = None if spec.key == "ref" else _PERIODS[spec.key](asked)
    if spec.steps is not None:
        start = period if spec.truncated else asked
        survey = survey.filter(horizon(F.col("ref_date"), start, spec.unit_days) == spec.steps)
    day = F.col("ref_date") if period is None else period
    return survey.groupBy(*by, day.alias("data")).agg(F.avg(value).alias("value"))


def latest_complete(
    survey: DataFrame,
    period: DataFrame,
    count: int,
    by: Sequence[str] = (),
    include: DataFrame | None = None,
) -> DataFrame:
    """The rows of the latest survey that covers the whole period.

    A survey date qualifies when exactly ``count`` of its rows fall in ``period`` (plus the
    months in ``include``, if given). A key with no such survey gives no rows.
    """
    months = period.select(*by, F.col("data").alias("ref_date"))
    if include is not None:
        months = months.unionByName(include.select(*by, F.col("data").alias("ref_date")))
    inside = survey.join(months, [*by, "ref_date"], "left_semi")
    full = (
        inside.groupBy(*by, "survey_date")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("n_rows") == count)
    )
    latest = full.groupBy(*by).agg(F.max("survey_date").alias("survey_date"))
    latest = latest.filter(F.col("survey_date").isNotNull())
    return inside.join(latest, [*by, "survey_date"], "left_semi").select(*survey.columns)

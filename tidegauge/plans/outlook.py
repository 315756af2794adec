"""Forecasts with intervals for many targets: fit, path, bootstrap.

``frame`` is wide and model-ready: key columns, ``data``, ``y`` and the regressors, one row
per key and month, no gaps. ``scenario`` has the same regressors for the months ahead, with
``step`` 1..h. Every stage is keyed, so a thousand targets are one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.dates import DUMMIES
from tidegauge.operators import align, forecast, grid, models, panel, power, scenarios
from tidegauge.operators.relational import union_all
from tidegauge.schema import TARGET_LABEL, TARGET_SERIES
from tidegauge.session import settle
from tidegauge.sources import publish

# Regressors of the published model besides the lag and the month dummies.
REGRESSORS = ["expec_ipca_top5_curto_prazo", "ic_br", "cambio_brl_eur", "ipc_s"]
SURVEY_PATH, SURVEY_DIFFERENCED = "expec_ipca_top5_curto_prazo", "cambio_brl_eur"
SEASONAL_PATHS = ["ic_br", "ipc_s"]

MODELS = {"Ridge": models.fit_ridge, "Huber": models.fit_huber}
OBJECTIVES = {
    "Ridge": {"alpha": models.RIDGE_ALPHA},
    "Huber": {"alpha": models.HUBER_ALPHA, "epsilon": models.HUBER_EPSILON},
}


def scaled_design(frame: DataFrame, by: Sequence[str], exog: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Transform parameters per key, and the rows the published models are fitted on.

    The target and regressors are power-transformed and standardised per key, the dummies
    standardised; each key's first row is dropped.
    """
    by = list(by)
    full = panel.add_dummies(frame)
    continuous = ["y", *exog]
    params = settle(power.frame_params(full, by, continuous, DUMMIES), "params")
    scaled = power.frame_apply(full.select(*by, "data", *continuous, *DUMMIES), params, by, continuous, DUMMIES)
    rows = panel.add_lag(scaled, by).filter(F.col(panel.LAG).isNotNull())
    return params, settle(rows.select(*by, "data", "y", *panel.features(exog)), "design")


def proofs(rows: DataFrame, by: Sequence[str], exog: Sequence[str], kinds: Sequence[str] = ("Ridge", "Huber")) -> DataFrame:
    """Key columns, ``tipo``, ``n_rows``, ``converged`` and ``gradient`` of each model fitted on the rows.

    The gradient is taken from the rows at the fitted coefficients, see ``models.stationarity``.
    """
    names, out = panel.features(exog), []
    for kind in kinds:
        fitted = settle(MODELS[kind](rows, by, names), "model")
        proof = models.stationarity(rows, fitted, by, names, **OBJECTIVES[kind])
        if "converged" in fitted.columns:
            proof = proof.join(fitted.select(*by, "converged"), list(by))
        else:  # solved directly
            proof = proof.withColumn("converged", F.lit(True))
        out.append(proof.withColumn("tipo", F.lit(kind)))
    return union_all(*out)


def require_converged(fitted: DataFrame, kind: str) -> DataFrame:
    """The fits unchanged, or an error if one of them has not come to rest."""
    if "converged" in fitted.columns and not fitted.filter(~F.col("converged")).isEmpty():
        raise ValueError(f"{kind}: a fit has not converged")
    return fitted


def fit_and_forecast(
    frame: DataFrame,
    scenario: DataFrame,
    by: Sequence[str],
    exog: Sequence[str],
    n_boot: int = forecast.N_BOOT,
    seed: int = forecast.SEED,
    kinds: Sequence[str] = ("Ridge", "Huber"),
    strict: bool = False,
) -> DataFrame:
    """Key columns, ``tipo``, ``step``, ``data``, ``valor`` and the interval.

    Models are fitted on the transformed scale of ``scaled_design`` and the paths brought
    back. ``strict`` raises if a fit has not converged.
    """
    by = list(by)
    regressors, names = [*exog, *DUMMIES], panel.features(exog)
    params, rows = scaled_design(frame, by, exog)
    ahead = power.frame_apply(
        panel.add_dummies(scenario).select(*by, "step", "data", *regressors), params, by, exog, DUMMIES
    )
    start = rows.groupBy(*by).agg(F.max_by("y", "data").alias("start"))
    scale = params.select(
        *by, *[F.col(f"y_{p}").alias(p) for p in ("lam", "mu", "sd")]
    )
    out = []
    for kind in kinds:
        fitted = settle(MODELS[kind](rows, by, names), "model")
        if strict:
            require_converged(fitted, kind)
        resid = forecast.residual_lists(models.residuals(rows, fitted, by, names), by)
        steps = forecast.step_inputs(ahead, fitted, by, regressors)
        inputs = steps.join(start, by).join(scale, by).join(resid, by)
        made = forecast.forecast_interval(inputs, by, n_boot=n_boot, seed=seed)
        out.append(made.withColumn("tipo", F.lit(kind)))
    return union_all(*out)


def seasonal_scenario(frame: DataFrame, by: Sequence[str], exog: Sequence[str], h: int = forecast.HORIZON):
    """Every regressor's calendar-month median for the ``h`` months after the last row."""
    by = list(by)
    last = frame.groupBy(*by).agg(F.max("data").alias("last"))
    period = grid.forecast_period(last, by, h).withColumn("month", F.month("data"))
    medians = frame.groupBy(*by, F.month("data").alias("month")).agg(
        *[F.median(c).alias(c) for c in exog]
    )
    return period.join(medians, [*by, "month"]).drop("month")


def published_inputs(
    monthly: DataFrame,
    catalog: DataFrame,
    survey_level: DataFrame,
    survey_change: DataFrame,
    h: int = forecast.HORIZON,
) -> tuple[DataFrame, DataFrame]:
    """Frame and scenario of the published inflation forecast.

    ``monthly`` is the stored long table. The two surveys feed the paths of the short-term
    expectation (as asked) and of the exchange rate (transformed).
    """
    key = ["target_id"]
    on_grid = settle(grid.asfreq_month(monthly, ["series_id"]), "grid")
    is_target = F.col("series_id") == TARGET_SERIES
    y = on_grid.filter(is_target & F.col("value").isNotNull())
    y = y.filter(F.col("data") >= F.lit(panel.SAMPLE_START).cast("date"))
    bounds = panel.target_bounds(y, [])
    wanted = on_grid.filter(F.col("series_id").isin(*REGRESSORS))
    x = settle(panel.prepare_regressors(wanted, catalog, bounds), "regressors")
    kept = {r["series_id"] for r in x.select("series_id").distinct().collect()}  # at most four
    if lost := [name for name in REGRESSORS if name not in kept]:
        raise ValueError(f"regressors missing or too sparse: {lost}")
    named = union_all(y.withColumn("series_id", F.lit("y")), x).withColumn(
        "target_id", F.lit(TARGET_LABEL)
    )
    frame = align.to_wide(named, ["y", *REGRESSORS], by=key, anchors=["y"])
    frame = settle(frame, "frame")

    last = bounds.select(F.lit(TARGET_LABEL).alias("target_id"), "last")
    period = settle(grid.forecast_period(last, key, h), "period")
    month = last.select("target_id", F.col("last").alias("data"))
    keyed = lambda df: df.withColumn("target_id", F.lit(TARGET_LABEL))
    # one row: the code is part of the plan
    code = catalog.filter(F.col("series_id") == SURVEY_DIFFERENCED).select("transform").head()[0]
    paths = {
        SURVEY_PATH: scenarios.survey_path(keyed(survey_level), period, h, key),
        SURVEY_DIFFERENCED: scenarios.survey_path_transformed(
            keyed(survey_change), period, month, h, code, key
        ),
    }
    for name in SEASONAL_PATHS:
        own = named.filter(F.col("series_id") == name)
        paths[name] = scenarios.seasonal_path(own, period, key)
    made = scenarios.assemble(paths, key).select(*key, "data", *REGRESSORS)
    return frame, made.join(period, [*key, "data"])


def require_scenario(scenario: DataFrame, h: int = forecast.HORIZON) -> DataFrame:
    """The scenario unchanged, or an error that names the paths with months missing."""
    found = scenario.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in REGRESSORS]).head()
    short = [c for c in REGRESSORS if found[c] < h]
    if found["rows"] != h or short:
        raise ValueError(f"scenario has {found['rows']} of {h} months; incomplete paths: {short}")
    return scenario


def require_complete(rows: DataFrame, models: int, h: int = forecast.HORIZON) -> DataFrame:
    """The forecast unchanged, or an error: ``h`` rows a model, no null value or bound."""
    values = ["valor", "ic_inferior", "ic_superior"]
    whole = F.count(F.when(F.forall(F.array(*values), lambda v: v.isNotNull()), 1))
    groups = rows.groupBy("variavel", "tipo").agg(whole.alias("whole"), F.count(F.lit(1)).alias("n"))
    found = groups.agg(F.count(F.lit(1)).alias("models"), F.count_if((F.col("whole") != h) | (F.col("n") != h)).alias("bad")).head()
    if found["models"] != models or found["bad"]:
        raise ValueError(f"forecast incomplete: {found['models']} of {models} models, {found['bad']} with gaps")
    return rows


def run(
    spark: SparkSession,
    monthly: DataFrame,
    catalog: DataFrame,
    survey_level: DataFrame,
    survey_change: DataFrame,
    out: str,
    run_at: datetime | None = None,
) -> None:
    """Forecast, and publish the current forecast and the log of all runs in one step.

    Raises before anything is written when a regressor, a path or a forecast is incomplete,
    or a fit has not converged. A run with the stamp of an earlier one replaces it.
    """
    frame, scenario = published_inputs(monthly, catalog, survey_level, survey_change)
    scenario = require_scenario(settle(scenario, "scenario"))
    made = fit_and_forecast(frame, scenario, ["target_id"], REGRESSORS, strict=True)
    # one stamp for the whole run
    run_at = run_at or datetime.now()
    stamp = F.lit(run_at).cast("timestamp")
    rows = settle(
        forecast.forecast_table(made, F.col("target_id"), F.col("tipo"), stamp), "forecast"
    )
    require_complete(rows, len(MODELS))
    publish.publish(
        spark, f"{out}/published", run_at.isoformat(), {"forecast": rows.drop("previsao"), "tracking": rows}
    )

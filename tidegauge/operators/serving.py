"""Tables behind the forecast dashboard, for all variables and models at once.

``served`` is history plus forecasts: data, valor, ic_inferior, ic_superior, variavel, tipo.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import round_even
from tidegauge.operators.relational import at_extreme, distinct_list, last_n, union_all
from tidegauge.schema import HISTORY_LABEL

KEYS = ["variavel", "tipo"]
FAN_ROWS = 12 * 20

# Published column names.
TRACKING_NAMES = {
    "variavel": "Variável",
    "previsao": "Data de Previsão",
    "data": "Horizonte da Previsão",
    "tipo": "Modelo",
    "ipca": "Observado",
    "valor": "Previsto",
    "erro": "Erro de Previsão",
}
FAN_TABLE_NAMES = {
    "data": "Data",
    "ic_inferior": "IC Inferior",
    "valor": "Previsão (%)",
    "ic_superior": "IC Superior",
}


def history_union(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """History (variavel, data, valor) labelled as such, over the forecast rows."""
    labelled = history.dropna(subset=["valor"]).withColumn("tipo", F.lit(HISTORY_LABEL))
    return union_all(labelled, forecast, fill=True)


def model_choices(forecast: DataFrame) -> DataFrame:
    return distinct_list(forecast, ["variavel"], "tipo", "modelos")


def tracking_errors(tracking: DataFrame, observed: DataFrame) -> DataFrame:
    """Forecasts against realised values (variavel, data, ipca), typed dates on both sides."""
    joined = tracking.join(observed, ["variavel", "data"], "left")
    shown = joined.select(
        "variavel",
        "previsao",
        "data",
        "tipo",
        round_even(F.col("ipca")).alias("ipca"),
        round_even(F.col("valor")).alias("valor"),
        round_even(F.col("ipca") - F.col("valor")).alias("erro"),
    )
    return shown.withColumnsRenamed(TRACKING_NAMES)


def _models(served: DataFrame) -> DataFrame:
    return served.filter(F.col("tipo") != HISTORY_LABEL)


def _history(served: DataFrame) -> DataFrame:
    return served.filter(F.col("tipo") == HISTORY_LABEL)


def forecast_year(served: DataFrame) -> DataFrame:
    """Year of each model's first forecast."""
    used = _models(served).dropna(subset=["valor"])
    return used.groupBy(*KEYS).agg(F.year(F.min("data")).alias("ano"))


def year_compound(served: DataFrame) -> DataFrame:
    """Compounded growth of the forecast year; null unless all twelve months are there.

    Where a month is both realised and forecast, the realised value wins.
    """
    years = forecast_year(served)
    past = _history(served).select("variavel", F.year("data").alias("ano"), "data", "valor")
    ahead = _models(served).select(*KEYS, F.year("data").alias("ano"), "data", "valor")
    rows = union_all(
        past.join(years, ["variavel", "ano"]).withColumn("_rank", F.lit(0)),
        ahead.join(years, [*KEYS, "ano"], "left_semi").withColumn("_rank", F.lit(1)),
    )
    months = rows.groupBy(*KEYS, "ano", "data").agg(F.min_by("valor", "_rank").alias("valor"))
    grown = (F.product(F.col("valor") / 100 + 1) - 1) * 100
    return months.groupBy(*KEYS, "ano").agg(
        F.when(F.count("valor") == 12, round_even(grown)).alias("valor_yoy")
    )


def next_value(served: DataFrame) -> DataFrame:
    """Each model's first forecast month."""
    rows = at_extreme(_models(served), KEYS, "data", largest=False)
    return rows.select(*KEYS, "data", round_even(F.col("valor")).alias("valor"))


def last_value(served: DataFrame) -> DataFrame:
    """Last realised month of each variable."""
    rows = at_extreme(_history(served), ["variavel"], "data")
    return rows.select("variavel", "data", round_even(F.col("valor")).alias("valor"))


def fan_chart(served: DataFrame, rows: int | None = None) -> DataFrame:
    """History and one model per ``modelo``, rounded and relabelled.

    ``rows`` keeps the last that many for drawing (``FAN_ROWS`` in the published chart).
    """
    picks = _models(served).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    models = picks.select("variavel", F.col("tipo").alias("modelo"))
    past = _history(served).join(models, "variavel")
    ahead = _models(served).withColumn("modelo", F.col("tipo"))
    both = union_all(past, ahead.select(*past.columns))
    if rows is not None:
        both = last_n(both, ["variavel", "modelo"], ["data", "tipo"], rows)
    return both.select(
        "variavel",
        "modelo",
        F.date_format("data", "yyyy-MM-dd").alias("data"),
        round_even(F.col("valor")).alias("valor"),
        F.replace(F.col("tipo"), F.lit(HISTORY_LABEL), F.col("variavel")).alias("tipo"),
        round_even(F.col("ic_inferior")).alias("ic_inferior"),
        round_even(F.col("ic_superior")).alias("ic_superior"),
    )


def fan_table(served: DataFrame) -> DataFrame:
    """Forecast rows that carry an interval, in the published columns."""
    rows = _models(served).dropna(subset=["ic_inferior", "ic_superior"])
    shown = rows.select(
        "variavel",
        F.col("tipo").alias("modelo"),
        F.date_format("data", "MM/yyyy").alias("data"),
        *[round_even(F.col(c)).alias(c) for c in ("ic_inferior", "valor", "ic_superior")],
    )
    return shown.withColumnsRenamed(FAN_TABLE_NAMES)


def cards(served: DataFrame) -> DataFrame:
    """Texts of the value boxes: one row per variable, model and card."""
    # a null rate has no text
    percent = lambda c: F.when(c.isNotNull(), F.format_string("%s%%", c.cast("string")))
    yoy = year_compound(served).select(
        *KEYS,
        F.format_string("Previsão %d", F.col("ano")).alias("titulo"),
        percent(F.col("valor_yoy")).alias("texto"),
        F.lit("YoY").alias("medida"),
    )
    mom = next_value(served).select(
        *KEYS,
        F.format_string("Previsão %s", F.date_format("data", "MM/yyyy")).alias("titulo"),
        percent(F.col("valor")).alias("texto"),
        F.lit("MoM").alias("medida"),
    )
    last = last_value(served).select(
        "variavel",
        F.lit(HISTORY_LABEL).alias("tipo"),
        F.format_string("Realizado %s", F.date_format("data", "MM/yyyy")).alias("titulo"),
        percent(F.col("valor")).alias("texto"),
        F.lit("MoM").alias("medida"),
    )
    return union_all(yoy, mom, last)

import datetime as dt

import pandas as pd
import pytest

from tidegauge.operators import serving

# one run of the published log, rounded
LOG = [
    ("2025-11-01", 0.376846, 0.178253, 0.627159),
    ("2025-12-01", 0.664795, 0.445191, 0.922734),
    ("2026-01-01", 0.484379, 0.26982, 0.722978),
    ("2026-02-01", 0.585707, 0.377608, 0.819663),
    ("2026-03-01", 0.523988, 0.31385, 0.765522),
    ("2026-04-01", 0.455683, 0.245996, 0.683604),
    ("2026-05-01", 0.458696, 0.24245, 0.702219),
    ("2026-06-01", 0.282563, 0.073359, 0.521809),
    ("2026-07-01", 0.287249, 0.07126, 0.528538),
    ("2026-08-01", 0.209323, 0.009558, 0.45039),
    ("2026-09-01", 0.296589, 0.093038, 0.527605),
    ("2026-10-01", 0.509755, 0.293367, 0.738477),
]


@pytest.fixture
def forecast(spark):
    rows = [(dt.date.fromisoformat(d), v, lo, hi, "IPCA", "Ridge") for d, v, lo, hi in LOG]
    return spark.createDataFrame(
        rows, "data date, valor double, ic_inferior double, ic_superior double, variavel string, tipo string"
    )


@pytest.fixture
def history(spark):
    rows = [("IPCA", d.date(), 0.1 * d.month) for d in pd.date_range("2024-01-01", "2025-11-01", freq="MS")]
    return spark.createDataFrame([*rows, ("IPCA", dt.date(2025, 12, 1), None)], "variavel string, data date, valor double")


def test_twelve_forecast_months_compound(spark, forecast):
    from tidegauge.operators import transforms

    last = transforms.rolling_compound(forecast, ["variavel", "tipo"], value="valor").orderBy("data").collect()
    assert [r.compound for r in last[:11]] == [None] * 11
    assert last[11].compound == pytest.approx(5.257098, abs=1e-5)


def test_year_card_prefers_the_realised_month(history, forecast):
    served = serving.history_union(history, forecast)
    row = serving.year_compound(served).head()
    assert row.ano == 2025
    months = [0.1 * m for m in range(1, 12)] + [0.664795]
    want = ((pd.Series(months) / 100 + 1).prod() - 1) * 100
    assert row.valor_yoy == round(want, 2)


def test_year_card_is_empty_without_twelve_months(history, forecast):
    served = serving.history_union(history.filter("data >= '2025-03-01'"), forecast)
    assert serving.year_compound(served).head().valor_yoy is None


def test_cards_and_tables(history, forecast):
    served = serving.history_union(history, forecast)
    assert served.count() == 23 + 12
    assert tuple(serving.next_value(served).head()) == ("IPCA", "Ridge", dt.date(2025, 11, 1), 0.38)
    assert tuple(serving.last_value(served).head()) == ("IPCA", dt.date(2025, 11, 1), 1.1)
    chart = serving.fan_chart(served, rows=15).orderBy("data", "tipo").collect()
    assert len(chart) == 15 and {r.tipo for r in chart} == {"IPCA", "Ridge"}
    table = serving.fan_table(served).collect()
    assert len(table) == 12
    assert {r["Data"] for r in table} >= {"11/2025", "10/2026"}


def test_tracking_joins_typed_dates(history, forecast):
    log = forecast.selectExpr("*", "timestamp'2025-12-03 15:35:45' AS previsao")
    observed = history.filter("valor IS NOT NULL").withColumnRenamed("valor", "ipca")
    rows = serving.tracking_errors(log, observed).orderBy("`Horizonte da Previsão`").collect()
    assert list(rows[0].asDict()) == list(serving.TRACKING_NAMES[c] for c in ("variavel", "previsao", "data", "tipo", "ipca", "valor", "erro"))
    assert (rows[0]["Observado"], rows[0]["Previsto"], rows[0]["Erro de Previsão"]) == (1.1, 0.38, 0.72)
    assert rows[1]["Observado"] is None and rows[1]["Erro de Previsão"] is None

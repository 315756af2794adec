"""Landed files to published tables, checked against pandas on the same numbers."""

import datetime as dt
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.plans import board, etl, outlook
from tidegauge.sources import payloads, publish, tables

CATALOG = [
    # id, source, frequency, transform
    ("cambio_brl_eur", "BCB/SGS", "Diária", "5"),
    ("selic", "BCB/SGS", "Diária", "2"),
    ("ipca", "BCB/SGS", "Mensal", "1"),
    ("ic_br", "BCB/SGS", "Mensal", "5"),
    ("meta_inflacao", "BCB/SGS", "Anual", "2"),
    ("expec_ipca_top5_curto_prazo", "BCB/ODATA", "Diária", "1"),
    ("expec_selic", "BCB/ODATA", "Diária", "2"),
    ("expec_pib", "BCB/ODATA", "Diária", "2"),
    ("pim", "IBGE/SIDRA", "Mensal", "5"),
    ("ipc_s", "IPEADATA", "Diária", "1"),
    ("caged", "IPEADATA", "Mensal", "2"),
    ("us_cpi", "FRED", "Mensal", "5"),
    ("us_10y", "FRED", "Diária", "2"),
]
START, END = "2004-01-01", "2014-06-30"


def series():
    """The numbers behind the files."""
    rng = np.random.default_rng(1)
    months = pd.date_range(START, END, freq="MS")
    days = pd.bdate_range(START, END)
    out = {
        "cambio_brl_eur": pd.Series(3 + rng.normal(0, 0.01, len(days)).cumsum(), days),
        "selic": pd.Series(10 + rng.normal(0, 0.05, len(days)).cumsum(), days),
        "ic_br": pd.Series(100 + rng.normal(0, 1, len(months)).cumsum(), months),
        "meta_inflacao": pd.Series([4.5] * 10 + [4.25], pd.date_range("2004-01-01", "2014-01-01", freq="YS")),
        "pim": pd.Series(90 + rng.normal(0, 1, len(months)), months),
        "caged": pd.Series(rng.normal(0, 10, len(months)), months),
        "us_cpi": pd.Series(200 + rng.normal(0.2, 0.1, len(months)).cumsum(), months),
        "us_10y": pd.Series(2 + rng.normal(0, 0.02, len(days)).cumsum(), days),
    }
    weekly = pd.date_range(START, END, freq="7D")
    out["ipc_s"] = pd.Series(0.4 + rng.normal(0, 0.1, len(weekly)), weekly)
    season = np.sin(2 * np.pi * months.month / 12)
    out["ipca"] = pd.Series(0.45 + 0.2 * season + rng.normal(0, 0.08, len(months)), months)
    # the exchange rate misses days the rate on deposits has, and the reverse
    out["cambio_brl_eur"] = out["cambio_brl_eur"].drop(out["cambio_brl_eur"].index[[0, 30, 31]])
    out["selic"] = out["selic"].drop(out["selic"].index[[50]])
    return {k: v.round(6) for k, v in out.items()}


def put(root, source, name, file, text):
    folder = os.path.join(root, etl.FOLDERS[source], f"series_id={name}")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, file), "w", encoding="utf-8") as f:
        f.write(text)


def comma(x):
    return '"' + str(x).replace(".", ",") + '"'


def survey_csv(rows, ref_format):
    lines = ["Indicador,Data,DataReferencia,tipoCalculo,Media,Mediana"]
    lines += [f"IPCA,{s:%Y-%m-%d},{ref_format(r)},C,{comma(v)},{comma(v)}" for s, r, v in rows]
    return "\n".join(lines) + "\n"


def survey_rows(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for s in pd.date_range(START, END, freq="14D"):
        first = s.to_period("M").to_timestamp()
        for k in range(14):
            rows.append((s, first + pd.DateOffset(months=k), round(0.4 + rng.normal(0, 0.05), 4)))
    return rows


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("landing"))
    data = series()
    for name, source, freq, _ in CATALOG:
        if source == "BCB/SGS":
            for k, part in enumerate(np.array_split(data[name], 2)):
                doc = [{"data": f"{i:%d/%m/%Y}", "valor": str(v)} for i, v in part.items()]
                put(root, source, name, f"{k}.json", json.dumps(doc))
        elif source == "IBGE/SIDRA":
            doc = [{"D3C": "Mês (Código)", "V": "Valor"}, {"D3C": "201501", "V": "..."}]
            doc += [{"D3C": f"{i:%Y%m}", "V": str(v)} for i, v in data[name].items()]
            put(root, source, name, "0.json", json.dumps(doc))
        elif source == "IPEADATA":
            doc = [{"VALDATA": f"{i:%Y-%m-%d}T00:00:00-03:00", "VALVALOR": v} for i, v in data[name].items()]
            put(root, source, name, "0.json", json.dumps({"value": doc}))
        elif source == "FRED":
            lines = ["observation_date,CODE"] + [f"{i:%Y-%m-%d},{v}" for i, v in data[name].items()]
            put(root, source, name, "0.csv", "\n".join(lines) + "\n")
    monthly = lambda r: f"{r:%m/%Y}"
    asked = survey_rows(5)
    put(root, "BCB/ODATA", "expec_ipca_top5_curto_prazo", "0.csv", survey_csv(asked, monthly))
    years = [(s, pd.Timestamp(r.year, 1, 1), v) for s, r, v in asked]
    put(root, "BCB/ODATA", "expec_selic", "0.csv", survey_csv(years, lambda r: f"{r:%Y}"))
    quarters = [(s, r, v) for s, r, v in asked if r.month % 3 == 1]
    put(root, "BCB/ODATA", "expec_pib", "0.csv", survey_csv(quarters, lambda r: f"{r.quarter}/{r.year}"))
    lines = ["Identificador,Fonte,Input de Coleta,Frequência,Transformação"]
    lines += [f"{n},{s},{k},{f},{t}" for k, (n, s, f, t) in enumerate(CATALOG)]
    with open(os.path.join(root, "catalog.csv"), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return root, data, asked


@pytest.fixture(scope="module")
def stored(spark, landed, tmp_path_factory):
    root = landed[0]
    out = str(tmp_path_factory.mktemp("stored"))
    catalog = tables.read_catalog(spark, f"{root}/catalog.csv")
    etl.run(spark, root, catalog, out)
    return out, catalog


def wide(spark, path):
    pdf = spark.read.parquet(path).toPandas()
    pdf["data"] = pd.to_datetime(pdf["data"])
    return pdf.set_index("data").sort_index().astype(float)


def test_daily_table(spark, landed, stored):
    data = {k: v.to_frame(k) for k, v in landed[1].items()}
    want = data["cambio_brl_eur"].join([data["selic"]]).join(data["us_10y"], how="outer").sort_index()
    got = wide(spark, f"{stored[0]}/daily")
    assert list(got.columns) == ["cambio_brl_eur", "selic", "us_10y"]
    pd.testing.assert_frame_equal(got, want, check_freq=False, check_names=False, check_index_type=False)


def test_monthly_table(spark, landed, stored):
    data, asked = {k: v.to_frame(k) for k, v in landed[1].items()}, landed[2]
    daily = data["cambio_brl_eur"].join([data["selic"]]).sort_index()
    means = daily.resample("MS").mean()[["cambio_brl_eur"]]
    first = daily.groupby(daily.index.to_period("M")).head(1)[["selic"]]
    target = data["meta_inflacao"].resample("MS").ffill()
    tail = pd.DataFrame({"meta_inflacao": 4.25}, index=pd.date_range("2014-02-01", "2014-12-01", freq="MS"))
    f = pd.DataFrame(asked, columns=["s", "r", "v"])
    whole = ((f.r - f.s) / np.timedelta64(30, "D")).astype(int)
    ahead = f[whole == 1].groupby("r").v.mean().to_frame("expec_ipca_top5_curto_prazo")
    y = pd.DataFrame([(s, pd.Timestamp(r.year, 1, 1), v) for s, r, v in asked], columns=["s", "r", "v"])
    y["s"] = y.s.dt.to_period("M").dt.to_timestamp()
    whole = ((y.r - y.s) / np.timedelta64(365, "D")).astype(int)
    rates = y[whole == 1].groupby("s").v.mean().to_frame("expec_selic")
    weekly = data["ipc_s"].dropna()
    last = weekly.groupby(weekly.index.to_period("M")).tail(1)
    last.index = last.index.to_period("M").to_timestamp()
    fred = data["us_cpi"].join(data["us_10y"].resample("MS").mean())
    want = data["ipca"]
    for part in (data["ic_br"], means, first, pd.concat([target, tail]), ahead, rates, data["pim"], last, data["caged"], fred):
        want = want.join(part, how="outer")
    got = wide(spark, f"{stored[0]}/monthly")
    assert "expec_pib" not in got.columns
    pd.testing.assert_frame_equal(got, want[list(got.columns)], check_freq=False, check_names=False, check_index_type=False)


@pytest.fixture(scope="module")
def published(spark, landed, stored):
    out, catalog = stored
    monthly = spark.read.parquet(f"{out}/long").filter("freq = 'M'")
    folder = f"{landed[0]}/bcb_odata/series_id=expec_ipca_top5_curto_prazo"
    level = payloads.read_survey(spark, folder, since="2014-06-01").drop("series_id")
    change = level.withColumn("median", F.col("median") * 7)
    for day in (3, 10):
        outlook.run(spark, monthly, catalog, level, change, out, dt.datetime(2014, 7, day, 12))
    return out


def test_frame_follows_the_preparation_order(spark, landed, stored):
    out, catalog = stored
    monthly = spark.read.parquet(f"{out}/long").filter("freq = 'M'")
    folder = f"{landed[0]}/bcb_odata/series_id=expec_ipca_top5_curto_prazo"
    level = payloads.read_survey(spark, folder, since="2014-06-01").drop("series_id")
    frame, scenario = outlook.published_inputs(monthly, catalog, level, level)
    pdf = wide(spark, f"{out}/monthly").asfreq("MS")
    y = pdf.ipca.dropna()
    x = pd.DataFrame(
        {
            "expec_ipca_top5_curto_prazo": pdf.expec_ipca_top5_curto_prazo,
            "ic_br": np.log(pdf.ic_br).diff(),
            "cambio_brl_eur": np.log(pdf.cambio_brl_eur).diff(),
            "ipc_s": pdf.ipc_s,
        }
    )
    x = x[(x.index >= "2004-01-01") & (x.index <= y.index.max())].bfill().ffill()
    got = frame.drop("target_id").toPandas()
    got["data"] = pd.to_datetime(got["data"])
    got = got.set_index("data").sort_index()
    assert np.allclose(got[list(x.columns)].to_numpy(), x.to_numpy())
    assert np.allclose(got["y"].to_numpy(), y.to_numpy())
    ahead = scenario.orderBy("step").toPandas()
    assert list(ahead["step"]) == list(range(1, 13))
    medians = x.ic_br.groupby(x.index.month).median()
    assert np.allclose(ahead["ic_br"], [medians[d.month] for d in ahead["data"]])
    assert not ahead.isna().any().any()


def test_forecast_and_log(spark, published):
    now = publish.read_current(spark, f"{published}/published", "forecast")
    assert now.columns == ["data", "valor", "ic_inferior", "ic_superior", "variavel", "tipo"]
    assert now.count() == 24
    assert now.filter("ic_inferior < valor AND valor < ic_superior").count() == 24
    log = publish.read_all(spark, f"{published}/published", "tracking")
    assert log.count() == 48
    assert log.select("previsao").distinct().count() == 2
    months = {r.data for r in now.select("data").collect()}
    assert min(months) == dt.date(2014, 7, 1) and len(months) == 12


def test_board(spark, published):
    made = board.build(spark, published)
    assert made["models"].head().modelos == ["Huber", "Ridge"]
    cards = {(r.tipo, r.medida): (r.titulo, r.texto) for r in made["cards"].collect()}
    assert cards[("Ridge", "YoY")][0] == "Previsão 2014" and cards[("Ridge", "YoY")][1].endswith("%")
    assert cards[("Huber", "MoM")][0] == "Previsão 07/2014"
    assert cards[("Histórico", "MoM")][0] == "Realizado 06/2014"
    assert made["fan_table"].count() == 24
    assert made["tracking"].filter("`Observado` IS NOT NULL").count() == 0
    assert made["fan_chart"].filter("modelo = 'Ridge'").count() == 126 + 12


def test_a_short_survey_leaves_the_old_forecast(spark, landed, stored, published):
    out, catalog = stored
    monthly = spark.read.parquet(f"{out}/long").filter("freq = 'M'")
    folder = f"{landed[0]}/bcb_odata/series_id=expec_ipca_top5_curto_prazo"
    level = payloads.read_survey(spark, folder, since="2014-06-01").drop("series_id")
    before = sorted(publish.read_current(spark, f"{out}/published", "forecast").toPandas()["valor"])
    sparse = monthly.filter("series_id <> 'ic_br' or data >= '2013-06-01'")
    for rows, survey in ((monthly, level.filter("ref_date < '2014-11-01'")), (sparse, level)):
        with pytest.raises(Exception):
            outlook.run(spark, rows, catalog, survey, survey, out)
        assert sorted(publish.read_current(spark, f"{out}/published", "forecast").toPandas()["valor"]) == before


def test_overlapping_files_leave_the_old_tables(spark, landed, stored, tmp_path):
    import shutil

    root = str(tmp_path / "landing")
    shutil.copytree(landed[0], root)
    copy = next(p for p in (tmp_path / "landing").rglob("series_id=selic/*.json"))
    (copy.parent / "again.json").write_text(copy.read_text())
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="duplicate key"):
        etl.run(spark, root, stored[1], out)
    assert not os.path.exists(f"{out}/long")


def test_an_incremental_run_equals_a_full_one(spark, landed, stored, tmp_path, monkeypatch):
    import shutil

    root, out = str(tmp_path / "landing"), str(tmp_path / "out")
    shutil.copytree(landed[0], root)
    late = next(p for p in (tmp_path / "landing").rglob("series_id=selic/1.json"))
    text = late.read_text()
    late.unlink()
    etl.run(spark, root, stored[1], out, incremental=True)
    assert wide(spark, f"{out}/daily")["selic"].count() < wide(spark, f"{stored[0]}/daily")["selic"].count()
    late.write_text(text)
    asked, scan = [], payloads._scan

    def watched(session, base):
        asked.append(base)
        return scan(session, base)

    monkeypatch.setattr(payloads, "_scan", watched)
    etl.run(spark, root, stored[1], out, incremental=True)
    assert [os.path.basename(a) for a in asked] == ["bcb_sgs"]  # the other sources' files are not opened
    for name in ("daily", "monthly"):
        pd.testing.assert_frame_equal(wide(spark, f"{out}/{name}"), wide(spark, f"{stored[0]}/{name}"))

"""Readers over small raw files as they are landed, and the writers."""

import datetime as dt
import os

import pytest

from tidegauge.schema import CATALOG, FORECAST, LONG, TRACKING
from tidegauge.sources import payloads, sinks, tables

d = dt.date


def land(root, series, name, text):
    folder = os.path.join(root, f"series_id={series}")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


def rows(df):
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in LONG]
    return sorted(tuple(r) for r in df.collect())


def test_json_array_unions_the_files_of_a_series(spark, tmp_path):
    land(tmp_path, "selic", "1.json", '[{"data":"03/01/2000","valor":"1.5"},{"data":"04/01/2000","valor":"x"}]')
    land(tmp_path, "selic", "2.json", '[{"data":"01/02/2005","valor":"-0.25"}]')
    land(tmp_path, "007", "1.json", '[{"data":"01/02/2005","valor":"2"}]')
    assert rows(payloads.read_json_array(spark, str(tmp_path))) == [
        ("007", d(2005, 2, 1), 2.0),
        ("selic", d(2000, 1, 3), 1.5),
        ("selic", d(2000, 1, 4), None),
        ("selic", d(2005, 2, 1), -0.25),
    ]


def test_json_array_over_many_lines(spark, tmp_path):
    land(tmp_path, "a", "1.json", '[\n {"data":"03/01/2000",\n "valor":"1.5"}\n]')
    assert rows(payloads.read_json_array(spark, str(tmp_path), multiline=True)) == [("a", d(2000, 1, 3), 1.5)]


def test_broken_json_is_an_error(spark, tmp_path):
    land(tmp_path, "a", "1.json", '[{"data":"03/01/2000","valor":"1.5"')
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILED_READ_FILE"):
        payloads.read_json_array(spark, str(tmp_path)).collect()


def test_json_sentinel(spark, tmp_path):
    land(
        tmp_path,
        "a",
        "1.json",
        '[{"D3C":"Mês (Código)","V":"Valor"},{"D3C":"202001","V":"0.21"},{"D3C":"202002","V":"..."},'
        '{"D3C":"202003","V":"-"},{"D3C":"202004","V":null}]',
    )
    assert rows(payloads.read_json_sentinel(spark, str(tmp_path))) == [
        ("a", d(2020, 1, 1), 0.21),
        ("a", d(2020, 4, 1), None),
    ]


def test_json_nested(spark, tmp_path):
    text = (
        '{"@odata.context":"x","value":[{"SERCODIGO":"A","VALDATA":"2020-01-01T00:00:00-02:00","VALVALOR":1.5},'
        '{"SERCODIGO":"A","VALDATA":"2020-02-01T00:00:00+03:00","VALVALOR":null}]}'
    )
    land(tmp_path, "a", "1.json", text)
    assert rows(payloads.read_json_nested(spark, str(tmp_path))) == [
        ("a", d(2020, 1, 1), 1.5),
        ("a", d(2020, 1, 31), None),
    ]


def test_csv_wide_with_a_column_name_per_series(spark, tmp_path):
    land(tmp_path, "a", "1.csv", "observation_date,DGS10\n2020-01-02,1.88\n2020-01-03,.\n")
    land(tmp_path, "b", "1.csv", "observation_date,CPI\n2020-01-01,258.9\n")
    assert rows(payloads.read_csv_wide(spark, str(tmp_path))) == [
        ("a", d(2020, 1, 2), 1.88),
        ("a", d(2020, 1, 3), None),
        ("b", d(2020, 1, 1), 258.9),
    ]


SURVEY = (
    "Indicador,Data,DataReferencia,tipoCalculo,Media,Mediana\n"
    'IPCA,2020-01-03,{0},C,"0,35","0,34"\n'
    'IPCA,2019-12-30,{0},C,"0,30","0,31"\n'
    'IPCA,2020-01-03,{0},M,"9,9","9,9"\n'
    'Câmbio,2020-01-03,{0},C,"4,1","4,2"\n'
)


@pytest.mark.parametrize(
    "ref,text,want",
    [("month", "02/2020", d(2020, 2, 1)), ("year", "2021", d(2021, 1, 1)), ("quarter", "3/2020", d(2020, 7, 1))],
)
def test_survey(spark, tmp_path, ref, text, want):
    land(tmp_path, "s", "1.csv", SURVEY.format(text))
    got = payloads.read_survey(spark, str(tmp_path), ref, since="2020-01-01", indicator="IPCA", calc="C")
    assert [tuple(r) for r in got.collect()] == [("s", d(2020, 1, 3), want, 0.35, 0.34)]


def test_decimal_comma_any_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,a,b\n1,"1,5","2,25"\n2,NaN,7\n')
    got = payloads.read_decimal_comma(spark, str(tmp_path), ["a", "b"]).orderBy("id").collect()
    assert [(r.id, r.a, r.b) for r in got] == [("1", 1.5, 2.25), ("2", None, 7.0)]


def test_catalog_ignores_other_columns(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        "Nome,Fonte,Identificador,Input de Coleta,Frequência,Transformação\nÍndice,FRED,cpi,CPIAUCSL,Mensal,5\n",
        encoding="utf-8",
    )
    got = tables.read_catalog(spark, str(tmp_path))
    assert got.columns == CATALOG.fieldNames()
    assert tuple(got.head()) == ("cpi", "FRED", "CPIAUCSL", "Mensal", "5")


LINE = "2025-11-01,0.37,0.17,0.62,IPCA,{},2025-12-03 15:35:45.413654\n"


def test_log_with_and_without_header(spark, tmp_path):
    (tmp_path / "log").mkdir()
    header = ",".join(TRACKING.fieldNames()) + "\n"
    (tmp_path / "log" / "old.csv").write_text(header + LINE.format("Ridge"))
    first = tables.read_tracking(spark, str(tmp_path / "log"))
    assert first.schema == TRACKING and first.count() == 1
    sinks.append_tracking(first.replace("Ridge", "Huber", "tipo").select(*reversed(first.columns)), str(tmp_path / "log"))
    got = tables.read_tracking(spark, str(tmp_path / "log"))
    assert {(r.tipo, r.valor, r.data, r.previsao.microsecond) for r in got.collect()} == {
        ("Ridge", 0.37, d(2025, 11, 1), 413654),
        ("Huber", 0.37, d(2025, 11, 1), 413654),
    }
    sinks.write_forecast(got, str(tmp_path / "now"))
    assert spark.read.parquet(str(tmp_path / "now")).columns == FORECAST.fieldNames()


def test_long_table_is_pruned_by_folder(spark, tmp_path, long):
    path = str(tmp_path / "long")
    df = long([("a", "2019-05-01", 1.0), ("a", "2020-05-01", 2.0)]).selectExpr("*", "'M' AS freq")
    for _ in range(2):
        sinks.write_long(df, path)
    got = spark.read.parquet(path).filter("freq = 'M' AND year = 2020")
    assert got.count() == 1
    assert "PartitionFilters: [isnotnull(freq" in got._jdf.queryExecution().toString()


def test_backfill_windows(spark):
    spans = spark.createDataFrame([("a", d(2000, 1, 1), d(2010, 1, 1)), ("b", d(2000, 1, 1), d(2010, 1, 2))], "series_id string, lo date, hi date")
    got = tables.backfill_windows(spans, ["series_id"]).orderBy("series_id", "window_no").collect()
    assert [(r.series_id, r.window_start, r.window_end) for r in got] == [
        ("a", d(2000, 1, 1), d(2004, 12, 31)),
        ("a", d(2005, 1, 1), d(2009, 12, 31)),
        ("b", d(2000, 1, 1), d(2004, 12, 31)),
        ("b", d(2005, 1, 1), d(2009, 12, 31)),
        ("b", d(2010, 1, 1), d(2014, 12, 31)),
    ]


@pytest.mark.parametrize(
    "reader, text",
    [
        (payloads.read_json_nested, '{"value": [{"VALDATA": "2020-01-01T00:00:00-03:00", "VALV'),
        (payloads.read_json_nested, '{"value": [{"VALDATA": "2020-01-01T00:00:00-03:00", "VALVALOR": "abc"}]}'),
        (payloads.read_json_sentinel, '[{"D3C": "202013", "V": "1.5"}]'),
        (payloads.read_json_sentinel, '[{"D3C": "202001", "V": "abc"}]'),
        (payloads.read_csv_wide, "observation_date,CODE\n2020-01-01,abc\n"),
    ],
)
def test_what_cannot_be_read_is_an_error(spark, tmp_path, reader, text):
    land(tmp_path, "a", "0.json", text)
    with pytest.raises(Exception, match="(?i)malformed|not a number|CANNOT_PARSE|parse"):
        reader(spark, str(tmp_path)).collect()

"""The data source over landed payloads: the same rows as the readers, and which files it opens."""

import datetime as dt
import os

import pytest
from test_payloads import SURVEY, land

from tidegauge.sources import payload_format as fmt
from tidegauge.sources import payloads

d = dt.date


def load(spark, path, layout, **options):
    fmt.register(spark)
    return spark.read.format("payload").option("path", str(path)).option("layout", layout).options(**options).load()


def same(left, right):
    assert left.columns == right.columns
    assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


def test_layouts_equal_the_readers(spark, tmp_path):
    a, b, c, e = (tmp_path / x for x in "abce")
    land(a, "selic", "1.json", '[{"data":"03/01/2000","valor":"1.5"},{"data":"04/01/2000","valor":"x"}]\n[{"data":"05/01/2000","valor":null}]\n')
    land(a, "007", "1.json", '[{"data":"01/02/2005","valor":"2"}]')
    same(load(spark, a, "json_array"), payloads.read_json_array(spark, str(a)))
    land(b, "a", "1.json", '[{"D3C":"M","V":"Valor"},{"D3C":"202001","V":"0.21"},{"D3C":"202002","V":"..."},{"D3C":"202004","V":null}]')
    same(load(spark, b, "json_sentinel"), payloads.read_json_sentinel(spark, str(b)))
    land(c, "a", "1.json", '{"value":[{"VALDATA":"2020-01-01T00:00:00-02:00","VALVALOR":1.5},{"VALDATA":"2020-02-01T00:00:00+03:00","VALVALOR":null}]}')
    same(load(spark, c, "json_nested"), payloads.read_json_nested(spark, str(c)))
    land(e, "a", "1.csv", "observation_date,DGS10\n2020-01-02,1.88\n2020-01-03,.\n")
    same(load(spark, e, "csv_wide"), payloads.read_csv_wide(spark, str(e)))


@pytest.mark.parametrize("ref,text", [("month", "02/2020"), ("year", "2021"), ("quarter", "3/2020"), ("none", "x")])
def test_survey_equals_the_reader(spark, tmp_path, ref, text):
    land(tmp_path, "s", "1.csv", SURVEY.format(text))
    got = load(spark, tmp_path, "survey", ref=ref).filter("indicator = 'IPCA' AND calc = 'C' AND survey_date >= DATE '2020-01-01'")
    want = payloads.read_survey(spark, str(tmp_path), None if ref == "none" else ref, since="2020-01-01", indicator="IPCA", calc="C")
    same(got.drop("indicator", "calc"), want)


def windows(root):
    for series in ("a", "b"):
        for first in (2000, 2005, 2010):
            name = os.path.join(series, f"window={first}-01-01_{first + 4}-12-31")
            land(root, name, "1.json", f'[{{"data":"03/01/{first}","valor":"{first}"}},{{"data":"03/01/{first + 3}","valor":"1"}}]')


def test_filters_open_only_the_files_they_need(spark, tmp_path):
    windows(tmp_path)
    # what is not asked for cannot be read: opening it would fail the job
    for broken in ("series_id=a/window=2000-01-01_2004-12-31", "series_id=b/window=2005-01-01_2009-12-31"):
        (tmp_path / broken / "1.json").write_text("broken")
    rows = load(spark, tmp_path, "json_array")
    assert [tuple(r) for r in rows.filter("series_id = 'a' AND data > DATE '2009-06-01'").orderBy("data").collect()] == [
        ("a", d(2010, 1, 3), 2010.0),
        ("a", d(2013, 1, 3), 1.0),
    ]
    assert rows.filter("series_id IN ('b') AND data = DATE '2000-01-03'").count() == 1
    assert rows.filter("data BETWEEN DATE '2010-01-01' AND DATE '2012-01-01'").count() == 2
    assert rows.filter("series_id = 'c'").count() == 0
    with pytest.raises(Exception, match="cannot parse"):
        rows.filter("series_id = 'a' AND data < DATE '2009-06-01'").collect()


def test_a_window_cut_within_is_filtered_by_row(spark, tmp_path):
    windows(tmp_path)
    got = load(spark, tmp_path, "json_array").filter("series_id = 'b' AND data >= DATE '2001-01-01' AND data < DATE '2008-01-03'")
    assert sorted(r["data"] for r in got.collect()) == [d(2003, 1, 3), d(2005, 1, 3)]


def test_filters_are_seen_by_the_reader():
    reader = fmt.PayloadReader("x", "json_array", None)
    asked = [fmt.GreaterThanOrEqual(("data",), d(2001, 1, 1)), fmt.LessThan(("data",), d(2005, 1, 1)), fmt.In(("series_id",), ("a", "b")), fmt.EqualTo(("series_id",), "b")]
    assert list(reader.pushFilters(asked)) == asked  # Spark filters the rows as well
    assert (reader.series, reader.first, reader.last) == ({"b"}, d(2001, 1, 1), d(2005, 1, 1))


@pytest.mark.parametrize(
    "layout,text,match",
    [
        ("json_array", '[{"data":"03/01/2000","valor":"1.5"', "cannot parse"),
        ("json_array", '[{"data":"2000-01-03","valor":"1.5"}]', "cannot parse"),
        ("json_nested", '{"value": [{"VALDATA": "2020-01-01T00:00:00-03:00", "VALVALOR": "abc"}]}', "not a number"),
        ("json_sentinel", '[{"D3C": "202013", "V": "1.5"}]', "cannot parse"),
        ("csv_wide", "observation_date,CODE\n2020-01-01,abc\n", "not a number"),
        ("none such", "", "is none of"),
    ],
)
def test_what_cannot_be_read_is_an_error(spark, tmp_path, layout, text, match):
    land(tmp_path, "a", "0.json", text)
    with pytest.raises(Exception, match=match):
        load(spark, tmp_path, layout).collect()


def test_a_row_outside_of_its_window_and_a_file_of_no_series(spark, tmp_path):
    land(tmp_path, "a/window=2000-01-01_2000-12-31", "1.json", '[{"data":"03/01/2001","valor":"1"}]')
    with pytest.raises(Exception, match="outside of its window"):
        load(spark, tmp_path, "json_array").collect()
    (tmp_path / "stray.json").write_text("[]")
    with pytest.raises(Exception, match="no folder of a series"):
        load(spark, tmp_path, "json_array").collect()


def test_empty_folders_and_files(spark, tmp_path):
    land(tmp_path, "a", "0.json", "")
    assert load(spark, tmp_path, "json_array").collect() == []
    assert load(spark, tmp_path, "csv_wide").collect() == []

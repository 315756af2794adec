"""Landed files read once: new, changed, removed and broken ones."""

import datetime as dt
import json
import os

import pytest
from test_payloads import land

from tidegauge.sources import ledger, payloads, publish


def doc(*rows):
    return json.dumps([{"data": f"{d:%d/%m/%Y}", "valor": str(v)} for d, v in rows])


def values(df):
    return sorted((r.series_id, r.data, r.value) for r in df.collect())


@pytest.fixture
def reader():
    """The JSON reader, and the names of the files it was asked for."""

    def read(spark, paths, base):
        read.asked.append(sorted(os.path.basename(p) for p in paths))
        return payloads.read_json_array(spark, paths, base=base)

    read.asked = []
    return read


def test_only_new_files_are_read_and_only_their_months_written(spark, tmp_path, reader):
    raw, store = str(tmp_path / "raw"), str(tmp_path / "store")
    d = dt.date
    land(raw, "a", "1.json", doc((d(2020, 1, 5), 1), (d(2020, 2, 5), 2)))
    land(raw, "b b", "1.json", doc((d(2020, 1, 5), 3)))
    first = values(ledger.refresh(spark, raw, reader, store))
    assert first == [("a", d(2020, 1, 5), 1.0), ("a", d(2020, 2, 5), 2.0), ("b b", d(2020, 1, 5), 3.0)]
    before = publish.latest(spark, store)[1]["months"]
    land(raw, "a", "2.json", doc((d(2020, 2, 6), 4), (d(2020, 3, 1), 5)))
    got = values(ledger.refresh(spark, raw, reader, store))
    assert got == values(payloads.read_json_array(spark, raw))
    assert reader.asked == [["1.json", "1.json"], ["2.json"]]
    after = publish.latest(spark, store)[1]["months"]
    assert {m for m in after if after[m] != before.get(m)} == {str(2020 * 12 + 1), str(2020 * 12 + 2)}
    assert values(ledger.refresh(spark, raw, reader, store)) == got  # nothing new: nothing read
    assert len(reader.asked) == 2 and publish.latest(spark, store)[0] == 2


def test_changed_and_removed_files(spark, tmp_path, reader):
    raw, store = str(tmp_path / "raw"), str(tmp_path / "store")
    d = dt.date
    land(raw, "a", "1.json", doc((d(2020, 1, 5), 1), (d(2020, 4, 5), 9)))
    land(raw, "a", "2.json", doc((d(2020, 2, 5), 2)))
    ledger.refresh(spark, raw, reader, store)
    land(raw, "a", "1.json", doc((d(2020, 1, 5), 10), (d(2020, 3, 5), 11)))
    assert values(ledger.refresh(spark, raw, reader, store)) == values(payloads.read_json_array(spark, raw))
    os.remove(f"{raw}/series_id=a/2.json")
    got = values(ledger.refresh(spark, raw, reader, store))
    assert got == [("a", d(2020, 1, 5), 10.0), ("a", d(2020, 3, 5), 11.0)]
    assert reader.asked[1:] == [["1.json"]]


def test_a_refresh_that_fails_leaves_the_store(spark, tmp_path, reader):
    raw, store = str(tmp_path / "raw"), str(tmp_path / "store")
    d = dt.date
    land(raw, "a", "1.json", doc((d(2020, 1, 5), 1)))
    want = values(ledger.refresh(spark, raw, reader, store))
    land(raw, "a", "2.json", doc((d(2020, 1, 5), 2)))  # the same date again
    with pytest.raises(ValueError, match="duplicate key"):
        ledger.refresh(spark, raw, reader, store)
    land(raw, "a", "2.json", '[{"data":"06/01/2020"')
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILED_READ_FILE"):
        ledger.refresh(spark, raw, reader, store)
    assert values(ledger.rows(spark, store)) == want
    land(raw, "a", "2.json", doc((d(2020, 1, 6), 2)))
    assert len(values(ledger.refresh(spark, raw, reader, store))) == 2


def test_of_two_refreshes_at_once_one_is_refused(spark, tmp_path, reader, monkeypatch):
    raw, store = str(tmp_path / "raw"), str(tmp_path / "store")
    land(raw, "a", "1.json", doc((dt.date(2020, 1, 5), 1)))
    commit = publish.commit

    def late(*args):
        monkeypatch.setattr(publish, "commit", commit)
        ledger.refresh(spark, raw, reader, store)
        return commit(*args)

    monkeypatch.setattr(publish, "commit", late)
    with pytest.raises(RuntimeError, match="another run"):
        ledger.refresh(spark, raw, reader, store)
    assert len(values(ledger.rows(spark, store))) == 1

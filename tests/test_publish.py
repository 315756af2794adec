"""Runs published in one step: killed, repeated, and at the same time."""

import pytest

from tidegauge.sources import publish


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def values(df):
    return sorted(r.v for r in df.collect())


def test_a_run_is_seen_whole(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        publish.read_current(spark, root, "forecast")
    publish.publish(spark, root, "a", {"forecast": rows(spark, 1, 2), "tracking": rows(spark, 1)})
    publish.publish(spark, root, "b", {"forecast": rows(spark, 3), "tracking": rows(spark, 3)})
    assert values(publish.read_current(spark, root, "forecast")) == [3]
    assert values(publish.read_all(spark, root, "tracking")) == [1, 3]


def test_a_run_killed_between_its_writes_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    publish.publish(spark, root, "a", {"forecast": rows(spark, 1), "tracking": rows(spark, 1)})
    broken = rows(spark, 7).selectExpr("raise_error('killed') as v")
    with pytest.raises(Exception, match="killed"):
        publish.publish(spark, root, "b", {"forecast": rows(spark, 7), "tracking": broken})
    assert publish.manifest(spark, root)["current"] == "a"
    assert values(publish.read_current(spark, root, "forecast")) == [1]
    assert values(publish.read_all(spark, root, "tracking")) == [1]
    assert publish.drop_unnamed(spark, root) == 1
    assert values(publish.read_current(spark, root, "forecast")) == [1]


def test_a_run_killed_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    publish.publish(spark, root, "a", {"forecast": rows(spark, 1)})

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(publish, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            publish.publish(spark, root, "b", {"forecast": rows(spark, 2)})
    assert values(publish.read_current(spark, root, "forecast")) == [1]


def test_a_repeated_run_replaces_its_own_rows(spark, tmp_path):
    root = str(tmp_path)
    for run, value in (("a", 1), ("b", 2), ("b", 3), ("a", 4)):
        held = publish.read_all(spark, root, "tracking") if publish.manifest(spark, root)["runs"] else None
        before = held and values(held)
        publish.publish(spark, root, run, {"tracking": rows(spark, value)})
        if held:  # a reader of the older manifest keeps its tables
            assert values(held) == before
    assert values(publish.read_all(spark, root, "tracking")) == [3, 4]
    assert values(publish.read_current(spark, root, "tracking")) == [4]
    assert publish.drop_unnamed(spark, root) == 2


def test_two_runs_at_once_are_both_kept(spark, tmp_path, monkeypatch):
    root, commit, other = str(tmp_path), publish.commit, []

    def late(*args):
        if not other:  # the other run publishes while this one is about to
            other.append("b")
            publish.publish(spark, root, "b", {"tracking": rows(spark, 2)})
        return commit(*args)

    monkeypatch.setattr(publish, "commit", late)
    publish.publish(spark, root, "a", {"tracking": rows(spark, 1)})
    assert values(publish.read_all(spark, root, "tracking")) == [1, 2]
    assert publish.manifest(spark, root)["current"] == "a"


def test_a_taken_number_is_refused(spark, tmp_path):
    root = str(tmp_path)
    assert publish.commit(spark, root, 1, {"current": "a", "runs": {}})
    assert not publish.commit(spark, root, 1, {"current": "b", "runs": {}})
    assert publish.manifest(spark, root)["current"] == "a"
    assert publish._numbers(spark, root) == [1]

"""Bootstrap paths dealt over tasks, against the paths of a target in one row."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import brute_bounds, inputs

from tidegauge.operators import draws, forecast

BY = ["target_id"]
SCALES = [(1.0, 0.0, 1.0), (0.5, 0.3, 0.8), (0.0, 0.1, 0.5), (2.0, -0.5, 0.4), (-2.0, 0.2, 0.5), (-1.0, 0.4, 0.6), (3.0, -1.0, 1.0)]


def test_bits_keep_the_order_and_the_value():
    values = np.array([-np.inf, -1e300, -2.5, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf])
    bits = draws.ordered_bits(values)
    assert bits[5] == bits[6] and (np.diff(np.delete(bits, 5)) > 0).all()
    assert (draws.from_bits(bits) == values).all()


def test_ranges_of_draws_are_the_whole():
    whole = forecast.draw_base(100, 7, 3)
    parts = [forecast.draw_range(a, min(a + 33, 100), 7, 3) for a in range(0, 100, 33)]
    assert (np.concatenate(parts) == whole).all()


@pytest.mark.parametrize("lam,mu,sd", SCALES)
def test_dealt_paths_equal_brute_force(spark, lam, mu, sd):
    resid, drive = np.random.default_rng(5).normal(0, 0.3, 40), (0.1, 0.05, 0.02)
    made = draws.forecast_interval_dealt(inputs(spark, resid, lam, mu, sd, drive), BY, 400, 11, paths=64, keep=20)
    rows = made.orderBy("step").collect()
    want = brute_bounds(resid, lam, mu, sd, drive, 400, 11)
    assert np.allclose([r.ic_inferior for r in rows], want[0], rtol=1e-12)
    assert np.allclose([r.ic_superior for r in rows], want[1], rtol=1e-12)
    if lam in (0.0, 0.5, 1.0, 2.0):  # the inverse has no edge
        assert [r.n_paths for r in rows] == [400] * 3


def test_paths_without_an_inverse_are_counted_out(spark):
    resid = np.random.default_rng(6).normal(0, 0.6, 30)
    row = inputs(spark, resid, -2.0, 0.2, 0.5)
    rows = draws.forecast_interval_dealt(row, BY, 500, 1, paths=100).orderBy("step").collect()
    assert 0 < min(r.n_paths for r in rows) < 500
    none = draws.forecast_interval_dealt(row.withColumn("mu", F.lit(50.0)), BY, 500, 1).collect()
    assert [(r.ic_inferior, r.ic_superior, r.n_paths) for r in none] == [(None, None, 0)] * 3


def test_equal_paths_take_every_bit(spark):
    rows = draws.forecast_interval_dealt(inputs(spark, [0.0, 0.0]), BY, 300, paths=50, keep=10).collect()
    assert all(r.ic_inferior == pytest.approx(r.valor, rel=1e-14) == r.ic_superior for r in rows)


def test_targets_apart_and_targets_without_residuals(spark):
    rng = np.random.default_rng(7)
    one = inputs(spark, rng.normal(0, 0.3, 25))
    two = inputs(spark, rng.normal(0, 2.0, 31), 0.5, 0.2, 0.7).withColumn("target_id", F.lit("u"))
    empty = inputs(spark, []).withColumn("target_id", F.lit("none"))
    several = one.unionByName(two).unionByName(empty)
    got = {(r.target_id, r.step): r for r in draws.forecast_interval_dealt(several, BY, 700, 5, paths=90, keep=20).collect()}
    want = forecast.forecast_interval(one.unionByName(two), BY, 700, 5).collect()
    assert len(got) == 9 and len(want) == 6
    for r in want:
        made = got[(r.target_id, r.step)]
        assert made.data == r.data and made.valor == r.valor
        assert (made.ic_inferior, made.ic_superior) == pytest.approx((r.ic_inferior, r.ic_superior), rel=1e-12)
    assert all(got[("none", s)].ic_inferior is None and got[("none", s)].n_paths == 0 for s in (1, 2, 3))


def test_no_targets(spark):
    assert draws.forecast_interval_dealt(inputs(spark, [0.1]).limit(0), BY, 100).count() == 0


def test_one_target_with_a_million_paths_is_many_tasks(spark):
    row = inputs(spark, np.random.default_rng(8).normal(0, 0.3, 120), 0.5, 0.3, 0.8)
    made = draws.forecast_interval_dealt(row, BY, 1_000_000, 2)
    want = forecast.forecast_interval(row, BY, 1_000_000, 2).orderBy("step").collect()
    got = made.orderBy("step").collect()
    for a, b in zip(got, want):
        assert (a.ic_inferior, a.ic_superior) == pytest.approx((b.ic_inferior, b.ic_superior), rel=1e-12)
        assert a.n_paths == 1_000_000


def test_a_round_sends_few_rows_however_many_values_it_counts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = inputs(spark, rng.normal(0, 0.3, 80), 0.5, 0.3, 0.8)
    row = base.crossJoin(spark.range(20).select(F.col("id").alias("k")))
    seen, real = [], draws._over_ranges
    monkeypatch.setattr(draws, "_over_ranges", lambda *a: seen.append(real(*a)) or seen[-1])
    got = draws.forecast_interval_dealt(row, [*BY, "k"], 5000, 3).collect()
    want = forecast.forecast_interval(base, BY, 5000, 3).orderBy("step").collect()
    assert len(got) == 60
    for r in got:
        w = want[r.step - 1]
        assert (r.ic_inferior, r.ic_superior) == pytest.approx((w.ic_inferior, w.ic_superior), rel=1e-12)
    # two levels with two ranks each: at most four parts of a step, each one row
    assert len(seen) >= 3 and all(made.count() <= 20 * 3 * 4 for made in seen[1:])


def test_more_paths_than_draws_is_an_error(spark):
    with pytest.raises(ValueError, match="repeat"):
        draws.order_statistics(inputs(spark, [0.1, 0.2]), BY, 10**9)

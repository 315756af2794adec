"""Models and forecasts against closed forms and brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.dates import MONTH_NAMES
from tidegauge.functions.power import yeo_johnson, yeo_johnson_inverse
from tidegauge.operators import forecast, models, moments, panel, power, rounds
from tidegauge.plans import outlook

BY = ["target_id"]


def month(i):
    return dt.date(2005 + i // 12, i % 12 + 1, 1)


def made_frame(spark, n=120, targets=("a", "b"), seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for k, t in enumerate(targets):
        y = 1.0
        for i in range(n):
            x1, x2 = rng.normal(2 + k, 1), rng.gamma(2.0, 1.0)
            y = 0.5 + 0.4 * y + 0.3 * x1 - 0.2 * x2 + 0.1 * (i % 12 == 0) + rng.normal(0, 0.2)
            rows.append((t, month(i), y, x1, x2))
    return spark.createDataFrame(rows, "target_id string, data date, y double, x1 double, x2 double")


def to_numpy(df, columns, target):
    pdf = df.filter(F.col("target_id") == target).orderBy("data").select(*columns).toPandas()
    return pdf.to_numpy(float)


def test_design_matrix_drops_the_first_row(spark):
    rows = panel.design_matrix(made_frame(spark, n=24), BY, ["x1", "x2"])
    assert rows.columns == ["target_id", "data", "y", *panel.features(["x1", "x2"])]
    assert rows.count() == 46
    a = to_numpy(rows, ["y", "lag_1"], "a")
    assert np.array_equal(a[1:, 1], a[:-1, 0])


def test_ridge_equals_the_closed_form(spark):
    names = panel.features(["x1", "x2"])
    rows = panel.design_matrix(made_frame(spark), BY, ["x1", "x2"]).cache()
    fitted = {r.target_id: r for r in models.fit_ridge(rows, BY, names).collect()}
    for t in ("a", "b"):
        m = to_numpy(rows, ["y", *names], t)
        y, x = m[:, 0], m[:, 1:]
        xc = x - x.mean(0)
        w = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ (y - y.mean()))
        assert np.allclose(fitted[t].coef, w, atol=1e-9)
        assert fitted[t].intercept == pytest.approx(y.mean() - x.mean(0) @ w)
        assert fitted[t].n_rows == len(y)


def huber_objective(params, x, y, eps, alpha):
    w, c, s = params[:-2], params[-2], params[-1]
    z = np.abs(y - x @ w - c) / s
    h = np.where(z <= eps, z**2, 2 * eps * z - eps**2)
    return len(y) * s + (s * h).sum() + alpha * w @ w


def test_huber_gradient_vanishes(spark):
    frame = made_frame(spark).withColumn(
        "y", F.col("y") + F.when(F.month("data") == 6, 5.0).otherwise(0.0)
    )
    names = panel.features(["x1", "x2"], dummies=False)
    rows = panel.design_matrix(frame, BY, ["x1", "x2"], dummies=False).cache()
    fitted = {r.target_id: r for r in models.fit_huber(rows, BY, names).collect()}
    for t in ("a", "b"):
        m = to_numpy(rows, ["y", *names], t)
        y, x = m[:, 0], m[:, 1:]
        beta, scale = models.huber_coefficients(x[None], y[None], np.ones((1, len(y)), bool))
        assert np.allclose(fitted[t].coef, beta[0, :-1])
        at = np.concatenate([beta[0], scale])
        for i in range(len(at)):
            step = np.zeros(len(at))
            step[i] = 1e-6
            slope = (
                huber_objective(at + step, x, y, 1.35, 1e-4) - huber_objective(at - step, x, y, 1.35, 1e-4)
            ) / 2e-6
            assert abs(slope) < 1e-3


def test_huber_stack_with_padding_equals_one_by_one():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(5, 60, 3)), rng.standard_t(2, size=(5, 60))
    present = np.arange(60)[None, :] < np.array([60, 20, 35, 50, 12])[:, None]
    stacked, _ = models.huber_coefficients(x, y, present)
    for i in range(5):
        own = present[i]
        alone, _ = models.huber_coefficients(x[i : i + 1, own], y[i : i + 1, own], present[i : i + 1, own])
        assert np.allclose(stacked[i], alone[0], atol=1e-7)


def test_huber_ignores_outliers_more_than_ridge(spark):
    frame = made_frame(spark, targets=("a",)).withColumn(
        "y", F.when(F.col("data") == month(60), 500.0).otherwise(F.col("x1") * 2)
    )
    rows = panel.design_matrix(frame, BY, ["x1"], dummies=False)
    names = panel.features(["x1"], dummies=False)
    robust = models.fit_huber(rows, BY, names).head().coef[1]
    plain = models.fit_ridge(rows, BY, names).head().coef[1]
    assert abs(robust - 2) < 0.01 < abs(plain - 2)


def loglik(v, lam):
    t = np_yeo_johnson(v, lam)
    return -len(v) / 2 * np.log(t.var()) + (lam - 1) * (np.sign(v) * np.log1p(np.abs(v))).sum()


def np_yeo_johnson(v, lam):
    out = np.empty_like(v)
    pos = v >= 0
    out[pos] = np.log1p(v[pos]) if lam == 0 else ((v[pos] + 1) ** lam - 1) / lam
    out[~pos] = -np.log1p(-v[~pos]) if lam == 2 else -((1 - v[~pos]) ** (2 - lam) - 1) / (2 - lam)
    return out


def test_power_search_finds_the_best_exponent(spark):
    rng = np.random.default_rng(3)
    series = {"skew": rng.gamma(1.5, 2.0, 200), "mixed": rng.normal(-0.5, 2.0, 200), "left": -rng.gamma(2.0, 1.0, 200)}
    rows = [(k, float(v)) for k, vs in series.items() for v in vs] + [("skew", None)]
    found = power.power_params(spark.createDataFrame(rows, "k string, value double"), ["k"])
    for r in found.collect():
        v = series[r.k]
        fine = np.arange(r.lam - 0.05, r.lam + 0.05, 0.0005)
        best = fine[np.argmax([loglik(v, x) for x in fine])]
        assert abs(best - r.lam) <= 0.001
        coarse = np.arange(-5, 5, 0.01)
        assert abs(coarse[np.argmax([loglik(v, x) for x in coarse])] - r.lam) <= 0.02
        t = np_yeo_johnson(v, r.lam)
        assert (r.mu, r.sd) == (pytest.approx(t.mean()), pytest.approx(t.std()))


def test_power_search_beyond_the_first_grid_and_without_variance():
    rng = np.random.default_rng(4)
    far, near = 30 - rng.gamma(1.2, 1.0, 150), 2 + rng.gamma(1.0, 0.25, 150)
    rows = np.vstack([far, near, np.full(150, 3.0)])
    got = power.search_exponents(rows, np.ones(rows.shape, bool), 4)
    for v, (lam, _, _) in zip((far, near), got):
        fine = np.arange(lam - 0.05, lam + 0.05, 0.0005)
        assert abs(fine[np.argmax([loglik(v, x) for x in fine])] - lam) <= 0.001
        wide = np.arange(-30, 30, 0.5)
        with np.errstate(divide="ignore"):
            score = np.array([loglik(v, x) for x in wide])
        assert abs(wide[np.argmax(np.where(np.isfinite(score), score, -np.inf))] - lam) <= 0.5
    assert got[0, 0] > 5.5 and got[1, 0] < -5.5
    assert got[2].tolist() == [1.0, 3.0, 1.0]


@pytest.mark.parametrize("lam", [-1.5, 0.0, 0.5, 1.0, 2.0, 3.5])
def test_power_round_trip(spark, lam):
    df = spark.range(-50, 51).select((F.col("id") / 10).alias("v"))
    there = df.withColumn("t", yeo_johnson(F.col("v"), F.lit(lam)))
    back = there.withColumn("b", yeo_johnson_inverse(F.col("t"), F.lit(lam)))
    assert back.select(F.max(F.abs(F.col("b") - F.col("v")))).head()[0] < 1e-9
    if lam == 1.0:
        assert there.select(F.max(F.abs(F.col("t") - F.col("v")))).head()[0] < 1e-12


def test_recursive_path(spark):
    df = spark.sql("SELECT 2.0D s, 0.5D phi, array(1.0D, 0.0D, 3.0D) d")
    path = df.select(forecast.recursive_path(F.col("s"), F.col("phi"), F.col("d")).alias("p")).head().p
    assert path == [2.0, 1.0, 3.5]


def inputs(spark, resid, lam=1.0, mu=0.0, sd=1.0, drive=(1.0, 0.5, 0.2)):
    days = [month(i) for i in range(len(drive))]
    row = ("t", 0.5, days, list(drive), 2.0, lam, mu, sd, [float(e) for e in resid])
    return spark.createDataFrame(
        [row],
        "target_id string, phi double, days array<date>, drive array<double>, start double, "
        "lam double, mu double, sd double, resid array<double>",
    )


def brute_bounds(resid, lam, mu, sd, drive, n_boot, seed):
    resid = np.array(resid)
    draws = forecast.draw_base(n_boot, len(drive), seed) % len(resid)
    paths = np.empty((n_boot, len(drive)))
    for b in range(n_boot):
        y = 2.0
        for t, d in enumerate(drive):
            y = d + 0.5 * y + resid[draws[b, t]]
            paths[b, t] = y
    v = paths * sd + mu
    with np.errstate(invalid="ignore"):
        up = np.expm1(v) if lam == 0 else np.power(lam * v + 1, 1 / lam) - 1
        down = -np.expm1(-v) if lam == 2 else 1 - np.power(1 - (2 - lam) * v, 1 / (2 - lam))
    # an odd whole power would give a number outside the domain too
    inside = np.where(v >= 0, lam * v + 1, 1 - (2 - lam) * v) > 0
    return np.nanquantile(np.where(inside, np.where(v >= 0, up, down), np.nan), [0.05, 0.95], axis=0)


@pytest.mark.parametrize("lam,mu,sd", [(1.0, 0.0, 1.0), (0.5, 0.3, 0.8), (-0.4, 0.5, 0.3), (-2.0, 0.2, 0.5), (3.0, -1.0, 1.0)])
def test_interval_equals_brute_force(spark, lam, mu, sd):
    resid = np.random.default_rng(5).normal(0, 0.3, 40)
    drive = (0.1, 0.05, 0.02)
    got = forecast.forecast_interval(inputs(spark, resid, lam, mu, sd, drive), BY, n_boot=400, seed=11)
    rows = got.orderBy("step").collect()
    want = brute_bounds(resid, lam, mu, sd, drive, 400, 11)
    assert np.allclose([r.ic_inferior for r in rows], want[0])
    assert np.allclose([r.ic_superior for r in rows], want[1])


def test_no_residuals_no_width(spark):
    rows = forecast.forecast_interval(inputs(spark, [0.0, 0.0]), BY, n_boot=50).collect()
    assert all(r.ic_inferior == pytest.approx(r.valor) == r.ic_superior for r in rows)


def test_draws_are_spread_evenly():
    bins = np.bincount((forecast.draw_base(5000, 12, 1984) % 262).ravel(), minlength=262)
    expected = 60000 / 262
    assert ((bins - expected) ** 2 / expected).sum() < 330


def test_fit_and_forecast_many_targets(spark):
    """The whole chain against numpy for every target."""
    frame = made_frame(spark, targets=("a", "b", "c")).cache()
    exog = ["x1", "x2"]
    scenario = outlook.seasonal_scenario(frame, BY, exog)
    got = outlook.fit_and_forecast(frame, scenario, BY, exog, n_boot=300).cache()
    assert got.count() == 3 * 2 * 12
    assert got.filter("ic_inferior < valor and valor < ic_superior").count() == 72
    params = {r.target_id: r.asDict() for r in power.frame_params(frame, BY, ["y", *exog]).collect()}
    for t in ("a", "b", "c"):
        pdf = frame.filter(F.col("target_id") == t).orderBy("data").toPandas()
        z, p = {}, params[t]
        for c in ("y", *exog):
            z[c] = (np_yeo_johnson(pdf[c].to_numpy(), p[f"{c}_lam"]) - p[f"{c}_mu"]) / p[f"{c}_sd"]
        m = np.array([d.month for d in pdf.data])
        stats = {n: ((m == k).mean(), (m == k).std()) for n, k in MONTH_NAMES.items()}
        dummies = [((m == k) - stats[n][0]) / stats[n][1] for n, k in MONTH_NAMES.items()]
        x = np.column_stack([z["y"][:-1], z["x1"][1:], z["x2"][1:], *[d[1:] for d in dummies]])
        y = z["y"][1:]
        xc = x - x.mean(0)
        w = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ (y - y.mean()))
        c = y.mean() - x.mean(0) @ w
        ahead = scenario.filter(F.col("target_id") == t).orderBy("step").toPandas()
        value, path = y[-1], []
        for r in ahead.itertuples():
            zx = [
                (np_yeo_johnson(np.array([getattr(r, e)]), p[f"{e}_lam"])[0] - p[f"{e}_mu"]) / p[f"{e}_sd"]
                for e in exog
            ]
            zd = [((r.data.month == k) - stats[n][0]) / stats[n][1] for n, k in MONTH_NAMES.items()]
            value = c + w @ np.array([value, *zx, *zd])
            path.append(value)
        v, lam = np.array(path) * p["y_sd"] + p["y_mu"], p["y_lam"]
        up = np.power(np.maximum(lam * v + 1, 0), 1 / lam) - 1
        down = 1 - np.power(1 - (2 - lam) * np.minimum(v, 0), 1 / (2 - lam))
        want = np.where(v >= 0, up, down)
        rows = got.filter((F.col("target_id") == t) & (F.col("tipo") == "Ridge")).orderBy("step").collect()
        assert np.allclose([r.valor for r in rows], want, atol=1e-6)


# moments, proofs and rounds -------------------------------------------------------------


def test_moments_of_blocks_merge_without_cancellation():
    rng = np.random.default_rng(3)
    values = rng.normal(size=(4000, 3)) + np.array([1e8, -1e8, 0.0])
    weight = rng.uniform(0.5, 2.0, 4000)
    blocks = [
        moments.batch_blocks(values[a : a + 100], weight[a : a + 100], np.zeros(100, int), 1)[0] for a in range(0, 4000, 100)
    ]
    got = moments.merged(np.stack(blocks), 3)
    mean = np.average(values.astype(np.longdouble), axis=0, weights=weight.astype(np.longdouble))
    away = values - mean
    want = ((weight[:, None] * away).T @ away).astype(float)
    assert got[0] == 4000 and got[1] == pytest.approx(weight.sum())
    assert np.allclose(moments.full_matrix(got[None], 3)[0], want, rtol=1e-8, atol=1e-4)  # raw sums would be off by thousands


def test_moments_of_many_keys(spark, monkeypatch):
    monkeypatch.setattr(moments, "HELD_KEYS", 3)
    rng = np.random.default_rng(4)
    rows = [(None if i % 7 == 0 else f"k{i % 11}", float(rng.normal()), None if i % 13 == 0 else float(rng.normal())) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(5)
    got = {r.k: moments.merged(np.reshape(r.blocks, (-1, 7)), 2) for r in moments.moments(df, ["k"], ["a", "b"]).collect()}
    pdf = df.toPandas().dropna(subset=["a", "b"])
    assert set(got) == set(pdf["k"])
    for key, block in got.items():
        own = pdf[pdf["k"].isna() if key is None else pdf["k"] == key][["a", "b"]].to_numpy()
        away = own - own.mean(0)
        assert block[0] == len(own) and np.allclose(block[2:4], own.mean(0))
        assert np.allclose(block[4:], [away[:, 0] @ away[:, 0], away[:, 0] @ away[:, 1], away[:, 1] @ away[:, 1]])


def test_ridge_keeps_digits_of_a_large_mean(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 2))
    y = 2 * x[:, 0] - 3 * x[:, 1] + rng.normal(size=3000) * 0.1
    wide = spark.createDataFrame([(1, float(a + 1e8), float(b - 1e8), float(c + 1e8)) for (a, b), c in zip(x, y)], "k int, a double, b double, y double")
    r = models.fit_ridge(wide.repartition(6), ["k"], ["a", "b"]).head()
    # the values as they are after adding the mean
    away = np.array([[v.a - 1e8, v.b + 1e8, v.y - 1e8] for v in wide.collect()])
    away -= away.mean(0)
    w = np.linalg.solve(away[:, :2].T @ away[:, :2] + np.eye(2), away[:, :2].T @ away[:, 2])
    assert np.allclose(r.coef, w, atol=1e-8)


def skewed(spark, n=150, targets=("a", "b", "c")):
    return made_frame(spark, n=n, targets=targets).withColumn(
        "y", F.col("y") + F.when(F.month("data") == 6, 5.0).otherwise(0.0)
    )


def test_stationarity_proves_a_fit_and_finds_a_wrong_one(spark):
    names = panel.features(["x1", "x2"])
    rows = panel.design_matrix(skewed(spark), BY, ["x1", "x2"]).cache()
    ridge = models.fit_ridge(rows, BY, names)
    huber = models.fit_huber(rows, BY, names)
    for fitted, more in ((ridge, {}), (huber, {"alpha": models.HUBER_ALPHA, "epsilon": models.HUBER_EPSILON})):
        proof = {r.target_id: r for r in models.stationarity(rows, fitted, BY, names, **more).collect()}
        assert set(proof) == {"a", "b", "c"} and all(r.gradient < 1e-8 and r.n_rows == 149 for r in proof.values())
        off = fitted.withColumn("coef", F.transform("coef", lambda c: c * 1.001))
        assert all(r.gradient > 1e-5 for r in models.stationarity(rows, off, BY, names, **more).collect())
    assert all(r.converged and r.scale > 0 and r.steps < 60 for r in huber.collect())
    # the wrong scale is found as well
    off = huber.withColumn("scale", F.col("scale") * 1.01)
    wrong = models.stationarity(rows, off, BY, names, alpha=models.HUBER_ALPHA, epsilon=models.HUBER_EPSILON)
    assert all(r.gradient > 1e-4 for r in wrong.collect())


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_stationarity_deals_a_long_target_and_sorts_no_rows(spark, monkeypatch, broadcast):
    names = panel.features(["x1", "x2"])
    rows = panel.design_matrix(skewed(spark), BY, ["x1", "x2"]).cache()
    fitted = models.fit_huber(rows, BY, names).withColumn("coef", F.transform("coef", lambda c: c * 1.01)).cache()
    more = {"alpha": models.HUBER_ALPHA, "epsilon": models.HUBER_EPSILON}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        whole = {r.target_id: r for r in models.stationarity(rows, fitted, BY, names, **more).collect()}
        monkeypatch.setattr(models, "PIECE_ROWS", 20, raising=False)
        proof = models.stationarity(rows, fitted, BY, names, **more)
        plan = proof._jdf.queryExecution().toString()
        dealt = {r.target_id: r for r in proof.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortAggregate" not in plan and "_piece" in plan
    assert set(dealt) == set(whole) == {"a", "b", "c"}
    for t, r in dealt.items():
        assert r.n_rows == whole[t].n_rows == 149 and r.gradient == pytest.approx(whole[t].gradient, rel=1e-9)


def test_fits_that_do_not_converge_say_so():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2, 40, 2))
    y = np.stack([x[0] @ [1.0, 2.0], rng.standard_t(2, size=40)])
    present = np.ones((2, 40), bool)
    _, _, converged, _ = models.huber_solutions(x, y, present, alpha=0.0)
    assert converged.tolist() == [False, True]  # the first is fitted exactly
    _, _, converged, steps = models.huber_solutions(x[1:], y[1:], present[1:], max_iter=1)
    assert not converged[0] and steps[0] == 1


def test_a_strict_forecast_wants_fits_at_rest(spark):
    fitted = spark.createDataFrame([("a", True), ("b", False)], "target_id string, converged boolean")
    assert outlook.require_converged(fitted.filter("converged"), "Huber").count() == 1
    with pytest.raises(ValueError, match="not converged"):
        outlook.require_converged(fitted, "Huber")


def test_huber_by_rounds_equals_the_fit_in_arrays(spark):
    names = panel.features(["x1", "x2"])
    rows = panel.design_matrix(skewed(spark), BY, ["x1", "x2"])
    rows = rows.repartition(7).cache()
    whole = {r.target_id: r for r in models.fit_huber(rows, BY, names).collect()}
    by_rounds = {r.target_id: r for r in rounds.fit_huber_by_rounds(rows, BY, names).collect()}
    assert set(whole) == set(by_rounds)
    for t, r in by_rounds.items():
        assert r.converged and r.gradient < 1e-8 and r.n_rows == whole[t].n_rows
        assert np.allclose(r.coef, whole[t].coef, rtol=1e-6, atol=1e-6)
        assert r.intercept == pytest.approx(whole[t].intercept, rel=1e-6)
        assert r.scale == pytest.approx(whole[t].scale, rel=1e-6)


def test_huber_by_rounds_of_one_long_target(spark):
    n = 400_000
    noise = F.when(F.rand(2) < 0.1, F.randn(3) * 50).otherwise(F.randn(4))
    rows = spark.range(n, numPartitions=16).select(
        F.lit("long").alias("target_id"), F.randn(5).alias("x1"), (F.randn(6) + 1e6).alias("x2"), noise.alias("e")
    )
    rows = rows.withColumn("y", F.col("x1") * 2 - (F.col("x2") - 1e6) + F.col("e"))
    r = rounds.fit_huber_by_rounds(rows, BY, ["x1", "x2"]).head()
    assert r.converged and r.n_rows == n and np.allclose(r.coef, [2, -1], atol=0.02)


def test_huber_by_rounds_of_odd_targets(spark):
    rows = [("exact", float(i), 3.0 * i) for i in range(20)] + [("flat", float(i), 7.0) for i in range(20)]
    rows += [("gaps", None, 1.0), (None, 1.0, 2.0), (None, 2.0, 4.5), (None, 3.0, 5.5), (None, 4.0, 9.0)]
    df = spark.createDataFrame(rows, "target_id string, x double, y double")
    got = {r.target_id: r for r in rounds.fit_huber_by_rounds(df, BY, ["x"]).collect()}
    assert set(got) == {"exact", "flat", None} and not got["flat"].converged
    none = df.filter("y < 0")
    assert rounds.fit_huber_by_rounds(none, BY, ["x"]).count() == 0 == models.fit_ridge(none, BY, ["x"]).count()

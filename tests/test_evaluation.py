import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltrace.operators import agreement, controls, forecasts, metrics, models, significance


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, as_of date, y_true double, y_pred double, baseline double")


def test_metric_anchors(spark):
    day = dt.date(2020, 5, 14)
    rows = [("a", day, t, p, 0.0) for t, p in ((1.0, 1.0), (2.0, 4.0), (3.0, 3.0))] + [("a", day, None, 1.0, 0.0), ("b", day, 1.0, 1.0, 1.0)]
    found = {r["k"]: r for r in metrics.metric_cells(frame(spark, rows), ["k"]).collect()}
    assert found["a"]["mse"] == pytest.approx(4 / 3) and found["a"]["mae"] == pytest.approx(2 / 3) and found["a"]["n"] == 3
    assert found["a"]["r2_oos"] == pytest.approx(1 - 4 / 14) and found["b"]["r2_oos"] is None and found["b"]["spearman_q"] is None


def test_spearman_averages_ties_and_quarters(spark):
    rows = [("a", dt.date(2020, 1, 1 + i), float(i // 2), float(i), 0.0) for i in range(6)] + [("a", dt.date(2020, 4, 1 + i), float(i), float(-i), 0.0) for i in range(4)]
    quarters = {r["quarter"]: r["spearman"] for r in metrics.spearman(frame(spark, rows).withColumn("quarter", metrics.quarter_of(F.col("as_of"))), ["quarter"]).collect()}
    ranks = np.corrcoef([1.5, 1.5, 3.5, 3.5, 5.5, 5.5], range(6))[0, 1]
    assert quarters["2020Q1"] == pytest.approx(ranks) and quarters["2020Q2"] == pytest.approx(-1.0)
    assert metrics.spearman_by_quarter(frame(spark, rows), ["k"]).first()["spearman_q"] == pytest.approx((ranks - 1) / 2)


def test_student_t_against_quadrature():
    for df in (1, 2, 3, 7, 30, 480):
        for t in (0.0, 0.3, 1.0, 2.5, 7.0):
            x = np.linspace(-t, t, 200_001)
            density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
            inside = float(np.sum((density[1:] + density[:-1]) / 2 * np.diff(x)))
            assert significance.student_t_p(t, df) == pytest.approx(1 - inside, abs=1e-7)


@pytest.mark.parametrize("h", [1, 3])
def test_diebold_mariano_against_plain_sums(spark, h):
    rng = np.random.default_rng(h)
    a, b = rng.normal(0, 1.2, 60), rng.normal(0, 1, 60)
    rows = [("x", i, float(p), float(q)) for i, (p, q) in enumerate(zip(a, b, strict=True))] + [("x", 99, None, 1.0), ("one", 0, 1.0, 2.0), ("same", 0, 1.0, 1.0), ("same", 1, 1.0, 1.0)]
    found = {r["k"]: r for r in significance.diebold_mariano(spark.createDataFrame(rows, "k string, t int, ea double, eb double"), ["k"], ["t"], h=h).collect()}
    d = a**2 - b**2
    dev = d - d.mean()
    lrv = np.mean(dev**2) + 2 * sum(np.mean(dev[k:] * dev[:-k]) for k in range(1, h))
    stat = d.mean() / np.sqrt(lrv / 60) * np.sqrt((61 - 2 * h + h * (h - 1) / 60) / 60)
    assert found["x"]["dm_stat"] == pytest.approx(stat) and found["x"]["dm_p"] == pytest.approx(significance.student_t_p(stat, 59))
    assert found["one"]["dm_stat"] is None and found["same"]["dm_stat"] is None and found["same"]["dm_p"] is None


def test_holm(spark):
    cells = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005, None])], "f string, i int, p double")
    found = {r["i"]: r["adj"] for r in significance.holm(cells, ["f"], "p", "adj").collect()}
    assert [found[i] for i in range(4)] == pytest.approx([0.03, 0.06, 0.06, 0.02]) and found[4] is None


def test_clustered_interval_is_wider(spark):
    rng = np.random.default_rng(0)
    level = rng.normal(0, 1, 20)
    rows = [(c, i, float(level[c])) for c in range(20) for i in range(50)]
    df = spark.createDataFrame(rows, "c int, i int, v double").withColumn("own", F.col("c") * 50 + F.col("i"))
    wide, narrow = significance.cluster_bootstrap(df, "c", "v", 400).first(), significance.cluster_bootstrap(df, "own", "v", 400).first()
    assert wide["point"] == pytest.approx(level.mean()) and wide["hi"] - wide["lo"] > 3 * (narrow["hi"] - narrow["lo"])
    assert significance.cluster_bootstrap(df, "c", "v", 400).first() == wide
    median = significance.cluster_bootstrap_statistic(df, "c", "v", np.median, 100).first()
    assert median["lo"] <= np.median(level) <= median["hi"]


def test_kappa_rules(spark):
    rows = [("same", "1", "1"), ("same", "2", "2"), ("one", "1", "1"), ("flat", "1", "1"), ("flat", "1", "1"), ("na", "NA", "1"), ("na", "1", "1"), ("na", "0", "0"), ("na", " ", "0")]
    rows += [("gap", a, b) for a, b in (("0", "4"), ("4", "4"), ("0", "0"), ("4", "0"))]
    df = spark.createDataFrame(rows, "g string, a string, b string")
    found = {r["g"]: (r["n"], r["kappa"]) for r in agreement.kappa(df, ["g"], "a", "b").collect()}
    assert found["same"] == (2, 1.0) and found["one"] == (1, None) and found["flat"] == (2, None) and found["na"] == (2, 1.0)
    linear = {r["g"]: r["kappa"] for r in agreement.kappa(df.where("g = 'gap'"), ["g"], "a", "b", "linear").collect()}
    assert linear["gap"] == pytest.approx(found["gap"][1])  # two observed classes are one step apart, whatever their values


def test_kappa_gate(spark):
    scores = spark.createDataFrame([("a", 0.7), ("b", 0.5), ("c", None)], "field string, kappa double")
    assert tuple(agreement.passes_gate(scores, ["a", "c"]).first()) == (1, True)
    assert tuple(agreement.passes_gate(scores, ["a", "b"]).first()) == (2, False)
    assert tuple(agreement.passes_gate(scores, ["c"]).first()) == (0, False)


def test_shuffles_permute_within_groups(spark):
    rows = [(i, "solo" if i == 0 else f"g{i % 3}", [float(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, g string, x array<double>")
    for group in ("g", None):
        found = controls.shuffle_within(df, "id", ["x"], group, 1).collect()
        assert sorted(r["x"][0] for r in found) == [float(i) for i in range(40)]
        if group:
            assert all(rows[int(r["x"][0])][1] == r["g"] for r in found) and next(r for r in found if r["g"] == "solo")["x"] == [0.0]


def test_ewma_closed_form_is_the_recursion(spark):
    rng = np.random.default_rng(0)
    r = rng.normal(0, 0.01, 300)
    rows = [("A", dt.date(2015, 1, 1) + dt.timedelta(i), float(x)) for i, x in enumerate(r)]
    found = [x["ewma_var"] for x in forecasts.ewma(spark.createDataFrame(rows, "ticker string, date date, ret double")).orderBy("date").collect()]
    for n in (1, 2, 50, 300):
        var = float(np.var(r[:n]))
        for x in r[:n]:
            var = 0.94 * var + 0.06 * x * x
        assert found[n - 1] == pytest.approx(var, rel=1e-9)


def test_least_squares_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 1, (80, 2)), rng.normal(0, 1, 80)
    rows = [("g", float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)] + [("g", None, 1.0, 1.0)]
    found = forecasts.solve_least_squares(spark.createDataFrame(rows, "g string, a double, b double, y double"), ["g"], [F.col("a"), F.col("b")], F.col("y"))
    assert found["g",] == pytest.approx(np.linalg.lstsq(np.column_stack([np.ones(80), x]), y, rcond=None)[0])


def test_ridge_matches_the_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(2, 3, (60, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(0, 1, 60)
    seg = ["train"] * 40 + ["val"] * 10 + ["test"] * 10
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), seg[i]) for i in range(60)], "i int, x array<double>, y double, segment string")
    found, alpha = models.ridge(df, "x", "y")
    z = (x - x[:40].mean(0)) / x[:40].std(0)
    preds = {}
    for a in models.ALPHAS:
        w = np.linalg.solve(z[:40].T @ z[:40] + a * np.eye(3), z[:40].T @ (y[:40] - y[:40].mean()))
        preds[a] = z @ w + y[:40].mean()
    best = min(models.ALPHAS, key=lambda a: (np.mean((preds[a][40:50] - y[40:50]) ** 2), models.ALPHAS.index(a)))
    assert alpha == {(): best}
    assert [r["pred"] for r in found.orderBy("i").collect()] == pytest.approx(preds[best], rel=1e-6)


def test_garch_recovers_a_simulated_process():
    rng = np.random.default_rng(4)
    s, r = 1e-4, []
    for _ in range(3000):
        r.append(math.sqrt(s) * rng.normal())
        s = 2e-6 + 0.08 * r[-1] ** 2 + 0.9 * s
    found, ok = models.garch_forecasts(np.array(r), np.array([50, 99, 3000, 1500]), 30)
    assert ok.tolist() == [False, False, True, True]
    assert found[2, 0] == pytest.approx(s, rel=0.35) and found[2, 29] == pytest.approx(1e-4, rel=0.6)


def test_network_learns_a_curve():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (2000, 2))
    y = np.abs(x[:, 0]) + 0.1 * x[:, 1]
    a, b, c, d = models.fit_network(x, y, 0, 32, 80, 1e-3)
    assert np.mean((np.maximum(x @ a + b, 0) @ c + d[0] - y) ** 2) < 0.1 * np.var(y)

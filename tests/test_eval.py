import datetime as dt
import random

import numpy as np
import pytest

from tsengine.operators import align, metrics, scale, split


def aligned(spark, n=50, seed=3, constant=False):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        y = 5.0 if constant else rng.uniform(-10, 10)
        rows.append(("a", t0 + dt.timedelta(hours=i), y, y + rng.uniform(-3, 3), y + rng.uniform(-1, 4)))
    rows[0] = (rows[0][0], rows[0][1], 0.0, 1.0, 2.0) if not constant else rows[0]
    return spark.createDataFrame(rows, "series_id STRING, ts TIMESTAMP_NTZ, y_true DOUBLE, pred_a DOUBLE, pred_b DOUBLE")


def test_tune_blend_equals_grid_scan(spark):
    df = aligned(spark)
    pdf = df.toPandas()
    best_w, best = 0.5, float("inf")
    for w in np.linspace(0.0, 1.0, 101):
        r = float(np.sqrt(np.mean((pdf.y_true - (w * pdf.pred_a + (1 - w) * pdf.pred_b)) ** 2)))
        if r < best:
            best, best_w = r, float(w)
    got = align.tune_blend(df).first()
    assert abs(got.weight - best_w) < 1e-12 and abs(got.rmse - best) < 1e-9
    ends = [float(np.sqrt(np.mean((pdf.y_true - p) ** 2))) for p in (pdf.pred_a, pdf.pred_b)]
    assert got.rmse <= min(ends) + 1e-12
    assert align.weight_grid(1) == [0.0, 0.5, 1.0]


def test_tune_blend_empty_defaults(spark):
    got = align.tune_blend(aligned(spark).limit(0)).first()
    assert got.weight == 0.5 and got.rmse is None


def test_metrics_match_numpy(spark):
    df = aligned(spark)
    pdf = df.toPandas()
    m = {(r.model, r.metric): r.value for r in metrics.forecast_metrics(df, ["pred_a"]).collect()}
    y, p = pdf.y_true.to_numpy(), pdf.pred_a.to_numpy()
    eps = np.finfo(np.float64).eps
    ys = np.where(np.isclose(y, 0.0), eps, y)
    assert abs(m[("pred_a", "mse")] - np.mean((y - p) ** 2)) < 1e-9
    assert abs(m[("pred_a", "mae")] - np.mean(np.abs(y - p))) < 1e-9
    assert abs(m[("pred_a", "mape")] - 100 * np.mean(np.abs(ys - p) / np.maximum(np.abs(ys), eps))) / m[("pred_a", "mape")] < 1e-9
    r2 = 1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2)
    assert abs(m[("pred_a", "r2")] - r2) < 1e-9


def test_r2_constant_truth(spark):
    df = aligned(spark, constant=True)
    m = {r.model: r.value for r in metrics.forecast_metrics(df.selectExpr("*", "y_true AS perfect"), ["pred_a", "perfect"], metrics=["r2"]).collect()}
    assert m["perfect"] == 1.0 and m["pred_a"] == 0.0


def test_compare_models_order(spark):
    cmp = metrics.compare_models(metrics.forecast_metrics(aligned(spark), ["pred_a", "pred_b"]))
    assert cmp.columns == ["model", "mse", "rmse", "mae", "mape", "r2"] and cmp.count() == 2


def test_tail_fallback_pairs_by_rank_from_end(spark):
    t0 = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([("s", t0 + dt.timedelta(hours=i), float(i), float(i)) for i in range(5)], "series_id STRING, ts TIMESTAMP_NTZ, y_true_a DOUBLE, pred_a DOUBLE")
    b = spark.createDataFrame([("s", t0 + dt.timedelta(hours=i, minutes=30), float(i), float(i)) for i in range(3)], "series_id STRING, ts TIMESTAMP_NTZ, y_true_b DOUBLE, pred_b DOUBLE")
    got = align.align_forecasts(a, b).orderBy("ts").collect()
    assert [(r.y_true_a, r.y_true_b) for r in got] == [(2.0, 0.0), (3.0, 1.0), (4.0, 2.0)]
    assert align.truth_gap(align.align_forecasts(a, b)).first().truth_gap == 2.0


def test_split_flags_cover_and_order(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(days=i), float(i)) for i in range(23)] + [("b", t0, 1.0)]
    df = spark.createDataFrame(rows, "series_id STRING, ts TIMESTAMP_NTZ, y DOUBLE")
    got = split.split_chrono(df, 0.2, 0.2).orderBy("series_id", "ts").collect()
    a = [r.split for r in got if r.series_id == "a"]
    k = min(max(int(23 * 0.8), 1), 22)
    kf = min(max(int(k * 0.8), 1), k - 1)
    assert a == ["fit"] * kf + ["val"] * (k - kf) + ["test"] * (23 - k)
    assert [r.split for r in got if r.series_id == "b"] == ["test"]  # n=1: empty train, like the clamp rule
    with pytest.raises(ValueError):
        split.split_chrono(df, 1.5)


def test_scaler_round_trip_and_constant_column(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(days=i), float(i * i), 3.0, "train" if i < 8 else "test") for i in range(10)]
    df = spark.createDataFrame(rows, "series_id STRING, ts TIMESTAMP_NTZ, x DOUBLE, c DOUBLE, split STRING")
    for kind in ("standard", "minmax"):
        params = scale.fit_scaler(df, ["x", "c"], kind)
        p = {r.column: (r.center, r.scale) for r in params.collect()}
        assert p["c"][1] == 1.0
        train = np.array([float(i * i) for i in range(8)])
        if kind == "standard":
            assert abs(p["x"][0] - train.mean()) < 1e-12 and abs(p["x"][1] - train.std()) < 1e-12
        back = scale.invert_scaler(scale.apply_scaler(df, params, ["x", "c"]), params, ["x", "c"]).orderBy("ts").collect()
        assert all(abs(r.x - float(i * i)) < 1e-9 and abs(r.c - 3.0) < 1e-12 for i, r in enumerate(back))


def test_global_scaler_and_pooled_blend_weight(spark):
    df = aligned(spark).withColumn("split", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("train"))
    params = scale.fit_scaler(df, ["y_true"], "standard", by=[])
    out = scale.apply_scaler(df, params, ["y_true"], by=[]).toPandas()
    assert abs(out["y_true"].mean()) < 1e-9 and abs(out["y_true"].std(ddof=0) - 1) < 1e-9
    w = align.tune_blend(df)
    got = align.blend_tuned(df, w).first()
    wt = w.first().weight
    assert abs(got.hybrid_pred - (wt * got.pred_a + (1 - wt) * got.pred_b)) < 1e-12


def test_assert_complete_and_cluster_conf(spark):
    from tsengine.session import cluster_conf

    df = aligned(spark)
    assert metrics.assert_complete(df, ["y_true", "pred_a"]) is df
    with pytest.raises(ValueError):
        metrics.assert_complete(df.selectExpr("y_true", "CAST(NULL AS DOUBLE) AS pred_a"), ["pred_a"])
    conf = cluster_conf(100 << 40, 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600 and conf["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert int(cluster_conf(1 << 20, 16)["spark.sql.shuffle.partitions"]) == 48

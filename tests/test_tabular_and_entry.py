import re

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from tsengine.config import ForecastConfig
from tsengine.operators import tabular
from tsengine.sources import fixtures as fx


def test_early_stop_patience_rule():
    assert tabular.early_stop([5, 4, 3, 3.5, 3.6, 3.7, 1.0], 3) == 2
    assert tabular.early_stop([5, 4, 3, 3.5, 2.0], 3) == 4
    assert tabular.early_stop([1.0], 3) == 0


def test_gbt_fit_predict_importance_and_reload(spark, tmp_path):
    cfg = ForecastConfig(max_lag=7, seasonal_anchors=(1, 7), rolling_candidates=(3, 7), max_iter=6, patience=2, max_depth=3)
    ds, params, cols = tabular.tabular_dataset(fx.lineitem_daily(spark, SF001), cfg)
    model = tabular.GbtForecaster(cfg).fit(ds, cols)
    assert 0 <= model.best_iteration < len(model.val_curve) <= min(6, model.best_iteration + 3)
    test = ds.filter("split = 'test'")
    preds = model.predict(test, params, keep=["y_raw"])
    assert preds.count() == test.count()
    imp = tabular.feature_importance(model, str(tmp_path / "m"))
    rows = imp.collect()
    assert len(rows) == len(cols) and rows[0].gain >= rows[-1].gain
    again = tabular.GbtForecaster().load(str(tmp_path / "m"))
    assert (again.cfg, again.feature_cols, again.best_iteration) == (cfg, cols, model.best_iteration)
    one, two = (sorted((r.series_id, r.ts, r.prediction) for r in m.predict(test).collect()) for m in (model, again))
    assert one == two
    with pytest.raises(FileNotFoundError):
        tabular.GbtForecaster().load(str(tmp_path / "missing"))
    with pytest.raises(RuntimeError):
        tabular.GbtForecaster(cfg).predict(test)


def test_first_trees_are_the_boosting_cut_short(spark):
    cfg = ForecastConfig(max_lag=3, seasonal_anchors=(1,), rolling_candidates=(3,), max_iter=5, max_depth=2, step_size=0.5, min_info_gain=0.0)
    ds, _, cols = tabular.tabular_dataset(fx.lineitem_daily(spark, SF001), cfg)
    whole = tabular.GbtForecaster(cfg)
    whole.feature_cols = cols
    rows = whole.assemble(ds.filter("split = 'fit'")).select("features", "y").cache()
    fitted = whole._estimator(5).fit(rows)
    short = tabular.first_trees(fitted, 2)
    assert len(short.trees) == 2 and short.treeWeights == fitted.treeWeights[:2]
    again = whole._estimator(2).fit(rows)
    a, b = (sorted(round(r.prediction, 9) for r in m.transform(rows).select("prediction").collect()) for m in (short, again))
    assert a == b


def _noisy(spark, n=1200):
    """Rows whose validation error first falls and then rises."""
    rows = spark.range(n).select(
        F.lit("a").alias("series_id"),
        *[((F.xxhash64("id", F.lit(i)) % 1000) / 1000).alias(f"f{i}") for i in range(4)],
        ((F.xxhash64("id", F.lit(9)) % 1000) / 800).alias("noise"),
        F.when(F.col("id") % 3 == 0, "val").otherwise("fit").alias("split"),
    )
    return rows.withColumn("y", F.sin(F.col("f0") * 4) + F.col("f1") * F.col("f2") + F.col("noise")).drop("noise").repartition(3).checkpoint()


def test_patience_while_training_gives_the_trees_of_one_whole_fit(spark):
    cols = [f"f{i}" for i in range(4)]
    cfg = ForecastConfig(max_iter=60, patience=3, max_depth=3, step_size=0.3, subsample=0.9, feature_subset="0.75", min_info_gain=0.0, boost_chunk=2)
    data = _noisy(spark)
    mine = tabular.GbtForecaster(cfg).fit(data, cols)
    trained = len(mine.val_curve)
    assert cfg.patience + 1 < trained == mine.best_iteration + cfg.patience + 1 < cfg.max_iter  # exactly to the stop
    whole = tabular.GbtForecaster(cfg)
    whole.feature_cols = cols
    rows = whole.assemble(data).select("features", "y", "split").persist()
    model = whole._estimator(trained).fit(rows.filter("split = 'fit'"))
    text = lambda m: [t.toDebugString().split("\n", 1)[1] for t in m._java_obj.trees()]
    assert text(mine.model) == text(model)[: mine.best_iteration + 1]
    assert list(mine.model.treeWeights) == list(model.treeWeights)[: mine.best_iteration + 1]
    errors = [e**0.5 for e in model.evaluateEachIteration(rows.filter("split = 'val'"), "squared")]
    assert errors == pytest.approx(mine.val_curve, rel=1e-9) and tabular.early_stop(errors, 3) == mine.best_iteration
    assert [r.round for r in mine.curve().filter("is_best").collect()] == [mine.best_iteration] and mine.curve().count() == trained


def test_training_goes_on_from_a_saved_model(spark, tmp_path):
    cols = [f"f{i}" for i in range(4)]
    cfg = ForecastConfig(max_iter=5, patience=3, max_depth=3, step_size=0.05, min_info_gain=0.0, boost_chunk=3)
    data = _noisy(spark)
    short = tabular.GbtForecaster(cfg).fit(data, cols)
    assert short.best_iteration == 4  # still improving
    short.save(str(tmp_path / "m"))
    more = tabular.GbtForecaster().load(str(tmp_path / "m"))
    more.cfg = cfg.with_(max_iter=9)
    more.fit(data, cols, resume=True)
    straight = tabular.GbtForecaster(cfg.with_(max_iter=9)).fit(data, cols)
    assert more.val_curve == pytest.approx(straight.val_curve, rel=1e-9) and more.best_iteration == straight.best_iteration
    with pytest.raises(RuntimeError):
        tabular.GbtForecaster(cfg).fit(data, cols, resume=True)
    with pytest.raises(ValueError):
        more.fit(data, cols[:2], resume=True)


def test_columns_drawn_once_per_tree(spark):
    cols = [f"f{i}" for i in range(4)]
    cfg = ForecastConfig(max_iter=7, patience=2, max_depth=3, step_size=0.3, subsample=0.9, feature_subset="0.5", min_info_gain=0.0, boost_chunk=3, column_sample="tree")
    data = _noisy(spark)
    model = tabular.GbtForecaster(cfg).fit(data, cols)
    draws = [model.tree_columns(m) for m in range(7)]
    assert all(len(d) == 2 for d in draws) and len({tuple(d) for d in draws}) > 1
    used = [set(map(int, re.findall(r"feature (\d+)", t.toDebugString()))) for t in model.model._java_obj.trees()]
    assert all(u and u <= set(d) for u, d in zip(used, draws, strict=False))
    # drawing all columns is MLlib's own fit
    every = tabular.GbtForecaster(cfg.with_(feature_subset="1.0")).fit(data, cols)
    plain = tabular.GbtForecaster(cfg.with_(feature_subset="all", column_sample="node")).fit(data, cols)
    assert every.val_curve == pytest.approx(plain.val_curve, rel=1e-9) and every.best_iteration == plain.best_iteration
    rmse = every.model.evaluateEachIteration(every.assemble(data).filter("split = 'val'").withColumn("label", F.col("y")), "squared")
    assert [e**0.5 for e in rmse] == pytest.approx(every.val_curve[: len(rmse)], rel=1e-9)
    with pytest.raises(ValueError):
        tabular.GbtForecaster(cfg.with_(column_sample="level"))


def test_no_validation_rows_keep_all_rounds(spark):
    cfg = ForecastConfig(max_iter=3, patience=1, max_depth=2)
    model = tabular.GbtForecaster(cfg).fit(_noisy(spark).filter("split = 'fit'"), ["f0", "f1"])
    assert len(model.model.trees) == 3 and model.val_curve == [] and model.best_iteration == 2


def test_entry_smoke(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    df = entry(spark)
    assert df.columns == ["model", "mse", "rmse", "mae", "mape", "r2"] and df.count() == 3
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", ["clean_series", "build_features", "context_windows", "prediction_bands", "align_tail_fallback", "forecast_metrics", "plot_frame"])
def test_registered_queries_run_on_smallest_data(spark, name):
    """As many rows, with the same columns, as the SQL gives on the same files."""
    import duckdb
    from __spark_entry__ import oracle_sql, queries

    con = duckdb.connect()
    for table in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF001}/{table}.parquet')")
    expected = con.execute(oracle_sql()[name]).df()
    got = queries()[name](spark, SF001)
    assert sorted(got.columns) == sorted(expected.columns) and got.count() == len(expected)


def test_tabular_dataset_float32_and_assemble(spark):
    cfg = ForecastConfig(max_lag=3, seasonal_anchors=(1,), rolling_candidates=(3,), float32=True, layout="series")
    ds, params, cols = tabular.tabular_dataset(fx.lineitem_daily(spark, SF001), cfg)
    types = dict(ds.dtypes)
    assert all(types[c] == "float" for c in cols + ["y"]) and types["y_raw"] == "double"
    assert set(ds.select("split").distinct().toPandas()["split"]) == {"fit", "val", "test"}
    x = tabular.assemble(ds, cols, "y")
    assert x.select("features").first().features.size == len(cols)
    with pytest.raises(KeyError):
        tabular.assemble(ds, cols, "missing")

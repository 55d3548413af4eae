import pytest
from conftest import SF001

from tsengine.sources import files, fixtures as fx, sinks
from tsengine.streaming import land_stream

SCHEMA = "event_id BIGINT, ts_raw STRING, value_raw STRING, series_id STRING"


def test_land_csv_once_and_skip_if_present(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    raw = fx.events_dirty(spark, SF001)
    raw.write.option("header", True).csv(src)
    files.land_csv(spark, src, dst, schema=SCHEMA)
    files.land_csv(spark, src, dst, schema=SCHEMA)  # no-op: target exists
    got = files.read_series(spark, dst)
    assert got.count() == raw.count() and got.drop(files.INPUT_ORDER).exceptAll(raw).count() == 0
    with pytest.raises(ValueError):
        files.land_csv(spark, "", dst)
    with pytest.raises(KeyError):
        files.require_columns(got, ["nope"])


def test_land_stream_lands_only_new_files(spark, tmp_path):
    src, dst, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    raw = fx.events_dirty(spark, SF001)
    first, second = raw.filter("event_id % 2 = 0"), raw.filter("event_id % 2 = 1")
    first.write.option("header", True).csv(str(src / "batch1"))
    land_stream(spark, str(src / "*"), dst, SCHEMA, checkpoint=ck)
    assert spark.read.parquet(dst).count() == first.count()
    second.write.option("header", True).csv(str(src / "batch2"))
    land_stream(spark, str(src / "*"), dst, SCHEMA, checkpoint=ck)
    land_stream(spark, str(src / "*"), dst, SCHEMA, checkpoint=ck)  # nothing new
    out = spark.read.parquet(dst)
    assert out.count() == raw.count() and out.exceptAll(raw).count() == 0


def test_metrics_and_comparison_sinks_round_trip(spark, tmp_path):
    from tsengine.operators import metrics

    df = spark.createDataFrame([(1.0, 1.5, 0.5), (2.0, 2.5, 2.0), (4.0, 3.0, 4.5)], "y_true DOUBLE, a DOUBLE, b DOUBLE")
    m = metrics.forecast_metrics(df, ["a", "b"])
    sinks.write_metrics(m, str(tmp_path / "m"))
    back = spark.read.json(str(tmp_path / "m"))
    assert sorted(r.model for r in back.select("model").distinct().collect()) == ["a", "b"] and back.count() == 10
    sinks.write_comparison(metrics.compare_models(m), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["model", "mse", "rmse", "mae", "mape", "r2"]


def test_cli_end_to_end(spark, tmp_path):
    from pyspark.sql import functions as F

    from tsengine.__main__ import main

    src = str(tmp_path / "csv")
    (
        fx.events_30min(spark, "/root/testdata/sf0.01")
        .select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("y").cast("string").alias("value"))
        .coalesce(1)
        .write.option("header", True)
        .csv(src)
    )
    out = str(tmp_path / "out")
    main(["--input", src, "--output", out, "--max-iter", "3", "--context-length", "256", "--max-lag", "24"])
    cmp = spark.read.option("header", True).csv(f"{out}/model_comparison")
    assert sorted(r.model for r in cmp.collect()) == ["gbt", "hybrid", "probabilistic"]
    assert spark.read.json(f"{out}/metrics").count() == 18
    assert spark.read.parquet(f"{out}/plot_probabilistic").filter("line = 'low'").count() > 0

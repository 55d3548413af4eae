"""Tabular forecasting: leakage-safe dataset, MLlib gradient-boosted trees with patience-based
early stopping, inverse-scaled predictions and split-count / mean-gain feature importance."""

from __future__ import annotations

import json
import random
from collections.abc import Sequence
from dataclasses import asdict

from pyspark import SparkContext, StorageLevel
from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.config import ForecastConfig
from tsengine.operators.clean import drop_incomplete
from tsengine.operators.features import build_features
from tsengine.operators.scale import apply_scaler, fit_scaler, invert_scaler
from tsengine.operators.split import split_chrono, split_index
from tsengine.session import materialize, scratch_path


def feature_columns(df: DataFrame, cfg: ForecastConfig) -> list[str]:
    skip = {cfg.series_col, cfg.time_col, cfg.target, "split", "y_raw"}
    return [c for c in df.columns if c not in skip]


def tabular_dataset(df: DataFrame, cfg: ForecastConfig = ForecastConfig()) -> tuple[DataFrame, DataFrame, list[str]]:
    """features -> fit/val/test flags -> scaler fitted on train (fit+val) rows -> scaled frame.

    Returns ``(scaled, params, feature_cols)``; ``scaled`` keeps the unscaled target as
    ``y_raw`` so evaluation never round-trips the truth through the scaler.
    """
    from tsengine.plans.layout import features_by_layout, resolve_layout

    cfg = resolve_layout(df, cfg)
    if cfg.layout == "blocks":
        flagged = _flag_blocks(drop_incomplete(features_by_layout(df, cfg, keep_position=True)), cfg)
    else:
        flagged = split_chrono(build_features(df, cfg), cfg.test_size, cfg.validation_ratio, by=cfg.series_col, time_col=cfg.time_col)
    # the scaler fit and the transform both read the features: they are materialised once in the
    # shared checkpoint folder (also cuts the window lineage for executor-loss recovery)
    if cfg.layout != "blocks":
        flagged = materialize(flagged)
    cols = feature_columns(flagged, cfg)
    params = fit_scaler(flagged, cols + [cfg.target], cfg.scaler, by=cfg.series_col, where="split != 'test'")
    scaled = apply_scaler(flagged.withColumn("y_raw", F.col(cfg.target)), params, cols + [cfg.target], by=cfg.series_col)
    if cfg.float32:
        narrow = set(cols + [cfg.target])
        scaled = scaled.select(*[F.col(c).cast("float").alias(c) if c in narrow else F.col(c) for c in scaled.columns])
    return scaled, params, cols


def _flag_blocks(feats: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Split flags from the positions that the features were built on: rows are numbered once.

    Only a series' first rows lack history in complete data, so what is left of it is one run of
    positions, told by its least position and its row count. Where a series has holes after all, the
    rows are numbered again.
    """
    from tsengine.plans.layout import POS

    s = cfg.series_col
    feats = materialize(feats)
    runs = feats.groupBy(F.col(s).alias("__s")).agg(F.min(POS).alias("__from"), F.max(POS).alias("__to"), F.count(F.lit(1)).alias("__n"))
    if not runs.filter(F.col("__to") - F.col("__from") + 1 != F.col("__n")).isEmpty():
        return split_chrono(feats.drop(POS), cfg.test_size, cfg.validation_ratio, by=s, time_col=cfg.time_col, cfg=cfg)
    placed = feats.join(runs, F.col(s).eqNullSafe(F.col("__s"))).withColumn(POS, F.col(POS) - F.col("__from"))
    k = split_index(F.col("__n"), cfg.test_size)
    flag = F.when(F.col(POS) >= k, "test").when(F.col(POS) < split_index(k, cfg.validation_ratio), "fit").otherwise("val")
    return placed.withColumn("split", flag).drop(POS, "__s", "__from", "__to", "__n")


def assemble(df: DataFrame, feature_cols: Sequence[str], label: str = "y", out: str = "features") -> DataFrame:
    """Feature vector + label (``X``/``y``); errors when the label column is missing."""
    if label not in df.columns:
        raise KeyError(f"Target column '{label}' not found")
    return VectorAssembler(inputCols=list(feature_cols), outputCol=out, handleInvalid="keep").transform(df)


def early_stop(errors: Sequence[float], patience: int) -> int:
    """Index of the best iteration, stopping once ``patience`` rounds bring no improvement."""
    best, best_err = 0, float("inf")
    for i, e in enumerate(errors):
        if e < best_err:
            best, best_err = i, e
        elif i - best >= patience:
            break
    return best


def model_of(trees: Sequence, weights: Sequence[float], num_features: int, uid: str) -> GBTRegressionModel:
    """A boosted model of these trees (JVM objects) and their weights."""
    sc = SparkContext._active_spark_context
    kind = sc._jvm.org.apache.spark.ml.regression
    n = len(trees)
    jtrees, jweights = sc._gateway.new_array(kind.DecisionTreeRegressionModel, n), sc._gateway.new_array(sc._jvm.double, n)
    for i, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        jtrees[i], jweights[i] = tree, float(weight)
    return GBTRegressionModel(kind.GBTRegressionModel(uid, jtrees, jweights, num_features))


def first_trees(model: GBTRegressionModel, k: int) -> GBTRegressionModel:
    """The model of the first ``k`` trees: what boosting would have been after ``k`` rounds."""
    whole = model._java_obj
    return model_of(list(whole.trees())[:k], model.treeWeights[:k], whole.numFeatures(), whole.uid())


class GbtForecaster:
    """One pooled gradient-boosted tree model over all series' scaled rows."""

    def __init__(self, cfg: ForecastConfig = ForecastConfig()):
        if cfg.max_iter < 1:
            raise ValueError("max_iter must be >= 1")
        if cfg.column_sample not in ("node", "tree"):
            raise ValueError("column_sample must be 'node' or 'tree'")
        self.cfg = cfg
        self.model: GBTRegressionModel | None = None
        self.best_iteration: int | None = None
        self.val_curve: list[float] = []
        self.feature_cols: list[str] = []

    def _estimator(self, max_iter: int) -> GBTRegressor:
        c = self.cfg
        return GBTRegressor(
            featuresCol="features",
            labelCol=c.target,
            maxIter=max_iter,
            maxDepth=c.max_depth,
            stepSize=c.step_size,
            subsamplingRate=c.subsample,
            featureSubsetStrategy=c.feature_subset,
            minInstancesPerNode=c.min_instances_per_node,
            minInfoGain=c.min_info_gain,
            maxBins=c.max_bins,
            lossType="squared",
            seed=c.seed,
        )

    def assemble(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.feature_cols, outputCol="features", handleInvalid="keep").transform(df)

    def _one_tree(self, round_: int) -> RandomForestRegressor:
        """The estimator of one boosting round: what GBTRegressor fits in round ``round_``, on its residuals."""
        c = self.cfg
        return RandomForestRegressor(
            featuresCol="features",
            labelCol="__residual",
            numTrees=1,
            bootstrap=False,
            maxDepth=c.max_depth,
            subsamplingRate=c.subsample,
            featureSubsetStrategy="all" if c.column_sample == "tree" else c.feature_subset,
            minInstancesPerNode=c.min_instances_per_node,
            minInfoGain=c.min_info_gain,
            maxBins=c.max_bins,
            seed=c.seed + round_,
        )

    def tree_columns(self, round_: int) -> list[int]:
        """The features that the tree of a round may split on: all, or with ``column_sample="tree"`` a draw
        of ``feature_subset`` (a share) of them, by ``seed + round``."""
        n = len(self.feature_cols)
        if self.cfg.column_sample != "tree":
            return list(range(n))
        return sorted(random.Random(self.cfg.seed + round_).sample(range(n), max(1, int(n * float(self.cfg.feature_subset)))))

    def _seen(self, rows: DataFrame, round_: int) -> DataFrame:
        """Rows as a round's tree sees them: a column outside its draw is 0 in all of them, so it has no
        place to split and trees keep the numbers of the whole vector."""
        if self.cfg.column_sample != "tree":
            return rows
        drawn = set(self.tree_columns(round_))
        mask = Vectors.dense([float(i in drawn) for i in range(len(self.feature_cols))])
        masked = ElementwiseProduct(scalingVec=mask, inputCol="features", outputCol="__masked").transform(rows)
        return masked.drop("features").withColumnRenamed("__masked", "features")

    def _more_rounds(self, state: DataFrame, done: int, n: int) -> list:
        """The trees of ``n`` further rounds on the stored predictions ``__p`` of the first ``done``.

        As in MLlib's boosting with squared loss, the first tree is fitted to the labels and counts once; a
        later one is fitted to twice the residuals and counts ``step_size`` times. Rows and columns are
        drawn by ``seed + round``.
        """
        rows, trees = state.filter(F.col("split") == "fit"), []
        for m in range(done, done + n):
            residual = (F.lit(2.0) if m else F.lit(1.0)) * (F.col(self.cfg.target) - F.col("__p"))
            trees.append(self._one_tree(m).fit(self._seen(rows, m).withColumn("__residual", residual)).trees[0].setPredictionCol("__tree"))
            rows = self._added(rows, m, trees[-1:])
        return trees

    def _weight(self, round_: int) -> float:
        return self.cfg.step_size if round_ else 1.0

    def _added(self, rows: DataFrame, done: int, trees: Sequence) -> DataFrame:
        for m, tree in enumerate(trees, done):
            rows = tree.transform(rows).withColumn("__p", F.col("__p") + F.lit(self._weight(m)) * F.col("__tree")).drop("__tree")
        return rows

    def _errors(self, state: DataFrame, done: int, trees: Sequence) -> list[float]:
        """Validation RMSE after each of ``trees`` on top of the stored predictions, in one pass."""
        rows, p, means = state.filter(F.col("split") == "val"), F.col("__p"), []
        for i, tree in enumerate(trees):
            rows = tree.transform(rows).withColumnRenamed("__tree", f"__tree_{i}")
            p = p + F.lit(self._weight(done + i)) * F.col(f"__tree_{i}")
            means.append(F.avg((F.col(self.cfg.target) - p) ** 2))
        return [float(e) ** 0.5 for e in rows.agg(*means).first()]

    def fit(self, scaled: DataFrame, feature_cols: Sequence[str], resume: bool = False) -> "GbtForecaster":
        """Boost on ``fit`` rows until the error on ``val`` rows hasn't improved for ``patience`` rounds;
        keep the trees up to the best round.

        No stop can come before round ``patience``, so these rounds are one MLlib fit. From there on
        boosting goes on in chunks of at most ``boost_chunk`` rounds over stored residuals, each just long
        enough to reach the next possible stop: no round is trained beyond the stop, and the trees are
        those of one MLlib fit of all rounds (of the same seed and partitions; where a fit part of over
        10,000 rows is sampled for its bins, each tree of a chunk draws its own sample). ``resume`` goes
        on from the trees at hand (of an earlier fit, or loaded) up to the configured rounds and patience.
        With ``column_sample="tree"``, which MLlib's fit doesn't have, all rounds are trained in chunks.
        Without ``val`` rows all rounds are trained and kept.
        """
        c = self.cfg
        if resume and self.model is None:
            raise RuntimeError("There are no trees to go on from: fit a model or load a saved one")
        if resume and list(feature_cols) != self.feature_cols:
            raise ValueError("resume needs the features that the trees were fitted on")
        self.feature_cols = list(feature_cols)
        data = self.assemble(scaled.filter(F.col("split") != "test")).select("features", c.target, "split")
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
        state = None
        try:
            fit_rows, val_rows = (data.filter(F.col("split") == part) for part in ("fit", "val"))
            judged = not val_rows.isEmpty()
            first = c.max_iter if not judged else min(c.max_iter, c.patience + 1)
            model, trees, weights, curve = self.model if resume else None, [], [], []
            if model is None and c.column_sample != "tree":
                model = self._estimator(first).fit(fit_rows)
            if model is not None:
                trees, weights = list(model._java_obj.trees()), list(model.treeWeights)
                if judged:  # a loaded model has no label column set
                    curve = [float(e) ** 0.5 for e in model.evaluateEachIteration(val_rows.withColumn("label", F.col(c.target)), "squared")]
            grown = []  # a tree's JVM object is let go when its wrapper is
            while True:
                stop = early_stop(curve, c.patience) + c.patience + 1 if curve else first
                room = min(c.max_iter, stop) - len(trees)
                if room < 1:
                    break
                if state is None:
                    state = materialize(model.setPredictionCol("__p").transform(data) if model is not None else data.withColumn("__p", F.lit(0.0)))
                done, new = len(trees), self._more_rounds(state, len(trees), min(room, c.boost_chunk))
                if judged:
                    curve += self._errors(state, done, new)
                grown += new
                trees += [t._java_obj for t in new]
                weights += [self._weight(done + i) for i in range(len(new))]
                state = materialize(self._added(state, done, new))
            best = early_stop(curve, c.patience) if curve else len(trees) - 1
            uid = model.uid if model is not None else self._estimator(1).uid
            self.model = model_of(trees[: best + 1], weights[: best + 1], len(self.feature_cols), uid)
            self.best_iteration, self.val_curve = best, curve
        finally:
            data.unpersist()
        return self

    def curve(self) -> DataFrame:
        """One row per trained round: ``round, val_rmse, is_best``; the last round is where training stopped."""
        rows = [(i, e, i == self.best_iteration) for i, e in enumerate(self.val_curve)]
        return self._spark().createDataFrame(rows, "round INT, val_rmse DOUBLE, is_best BOOLEAN")

    def predict(self, scaled: DataFrame, params: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """``prediction`` per row (inverse-scaled with the target's parameters when given)."""
        if self.model is None:
            raise RuntimeError("There are no trees to predict with: fit a model or load a saved one")
        c = self.cfg
        cols = [c.series_col, c.time_col, *keep]
        out = self.model.transform(self.assemble(scaled)).select(*cols, "prediction")
        if params is not None:
            out = invert_scaler(out, params, ["prediction"], by=c.series_col, param_cols=[c.target])
        return out

    def save(self, path: str) -> str:
        if self.model is None:
            raise RuntimeError("There are no trees to save: fit a model first")
        self.model.write().overwrite().save(path)
        about = {"feature_cols": self.feature_cols, "best_iteration": self.best_iteration, "val_curve": self.val_curve, "config": asdict(self.cfg)}
        self._spark().createDataFrame([(json.dumps(about),)], "value STRING").write.mode("overwrite").text(f"{path}/forecaster")
        return path

    def load(self, path: str) -> "GbtForecaster":
        """The saved model with its feature names, configuration and best iteration."""
        from tsengine.sources.sinks import load_model

        self.model = load_model(self._spark(), path)
        about = json.loads(self._spark().read.text(f"{path}/forecaster").first()["value"])
        config = {k: tuple(v) if isinstance(v, list) else v for k, v in about["config"].items()}
        self.cfg = ForecastConfig(**config)
        self.feature_cols, self.best_iteration, self.val_curve = about["feature_cols"], about["best_iteration"], about["val_curve"]
        return self

    @staticmethod
    def _spark():
        from pyspark.sql import SparkSession

        return SparkSession.getActiveSession()


def feature_importance(forecaster: GbtForecaster, path: str | None = None) -> DataFrame:
    """``feature, weight (number of splits), gain (mean gain per split)``; unused features get 0.

    Read from the saved model's node table with Spark (tree data never goes through the driver).
    Sorted by gain, then weight, descending.
    """
    spark = forecaster._spark()
    path = path or scratch_path(spark, "gbt-model")
    forecaster.save(path)
    nodes = spark.read.parquet(f"{path}/data")
    splits = nodes.filter(F.col("nodeData.leftChild") >= 0).select(
        F.col("nodeData.split.featureIndex").alias("idx"), F.col("nodeData.gain").alias("g")
    )
    per = splits.groupBy("idx").agg(F.count(F.lit(1)).alias("weight"), F.avg("g").alias("gain"))
    names = spark.createDataFrame([(i, n) for i, n in enumerate(forecaster.feature_cols)], "idx INT, feature STRING")
    out = names.join(per, "idx", "left").select(
        "feature", F.coalesce("weight", F.lit(0)).cast("bigint").alias("weight"), F.coalesce("gain", F.lit(0.0)).alias("gain")
    )
    return out.orderBy(F.col("gain").desc(), F.col("weight").desc())

"""Pipeline parameters (defaults follow the behaviour being reproduced)."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class ForecastConfig:
    """Pipeline parameters.

    Fixed values (defaults equal to the reproduced pipeline's configuration, so results line up):
    test_size 0.2, validation_ratio 0.2, max_lag 48, seasonal lag anchors 1, 2, 24, 48, 168, 336,
    rolling-window candidates 3, 6, 12, 24, 48, context_length 1024, prediction_length 24,
    num_samples 32, confidence 0.9, blend weight 0.37, blend search points 101, seed 42, standard
    scaler, tree learning rate 0.025, depth 8, subsample 0.9, column sample 0.85, minimum child
    weight 3, minimum gain 0.05, patience 80, at most 1800 rounds. MLlib runs each round as Spark jobs,
    so checks and small runs pass smaller tree settings by name.
    """

    # column roles
    series_col: str = "series_id"
    time_col: str = "ts"
    target: str = "y"

    # splits
    test_size: float = 0.2
    validation_ratio: float = 0.2

    # features
    max_lag: int = 48
    seasonal_anchors: tuple[int, ...] = (1, 2, 24, 48, 168, 336)
    rolling_candidates: tuple[int, ...] = (3, 6, 12, 24, 48)

    # scaling: "standard" or anything else = min-max; float32 narrows the scaled matrix
    scaler: str = "standard"
    float32: bool = False

    # context / horizon windows
    context_length: int = 1024
    prediction_length: int = 24
    stride: int | None = None  # None -> prediction_length (non-overlapping horizons)
    on_short: str = "error"  # "error" | "skip" for series too short to cut windows

    # probabilistic sampling
    num_samples: int = 32
    confidence: float = 0.9
    season_length: int = 48
    sampler: str = "analog"  # "analog" | "bootstrap" | "plugin"

    # blending
    blend_weight: float = 0.37
    auto_tune: bool = True
    search_points: int = 101

    # boosted trees (MLlib GBTRegressor)
    seed: int = 42
    max_iter: int = 1800
    patience: int = 80
    boost_chunk: int = 10  # rounds between stored residuals once training may stop
    step_size: float = 0.025
    max_depth: int = 8
    subsample: float = 0.9
    feature_subset: str = "0.85"
    column_sample: str = "node"  # "node": MLlib draws columns for each node; "tree": once for each tree
    min_instances_per_node: int = 3
    min_info_gain: float = 0.05
    max_bins: int = 32

    # physical layout: series with more rows than this are processed in position blocks
    # with halos instead of one window partition per series ("auto" | "series" | "blocks")
    # "auto" splits a series that is larger than its fair share of the work (total rows /
    # parallelism) and than min_split_rows, and always one larger than max_rows_per_task;
    # blocks then hold at most block_rows rows (about four blocks per core for that series)
    layout: str = "auto"
    max_rows_per_task: int = 4_000_000
    min_split_rows: int = 200_000
    block_rows: int = 1_000_000

    def with_(self, **kw) -> "ForecastConfig":
        return replace(self, **kw)

    @property
    def effective_stride(self) -> int:
        return self.prediction_length if self.stride is None else int(self.stride)

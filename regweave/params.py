"""Validated parameter records."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from regweave import constants as C

# booster keys that steer the fit, and keys that only steer native threads or logging
_FIT_KEYS = {
    "eta": float,
    "max_depth": int,
    "subsample": float,
    "colsample_bytree": float,
    "seed": int,
    "gamma": float,
    "min_child_weight": float,
    "lambda": float,
    "base_score": float,
    "eval_metric": str,
}
_IGNORED_KEYS = {"nthread", "silent"}


def with_defaults(params: Mapping[str, Any] | None) -> dict[str, Any]:
    """Booster parameters with the defaults filled in where absent."""
    return {**C.DEFAULT_BOOSTER_PARAMS, **(params or {})}


def with_seed(params: Mapping[str, Any], seed: int) -> dict[str, Any]:
    return {**params, "seed": seed}


@dataclass(frozen=True)
class BoostParams:
    """Squared-loss boosting parameters, all typed and checked."""

    eta: float = 0.01
    max_depth: int = 1
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    seed: int = C.DEFAULT_SEED
    gamma: float = 0.0
    min_child_weight: float = 1.0
    reg_lambda: float = C.REG_LAMBDA
    base_score: float = C.BASE_SCORE
    min_gain: float = C.MIN_GAIN
    eval_metric: str = C.DEFAULT_EVAL_METRIC

    def __post_init__(self) -> None:
        if not 0 < self.eta <= 1:
            raise ValueError("eta must be in (0, 1]")
        if self.max_depth < 1:
            raise ValueError("max_depth must be at least 1")
        for name in ("subsample", "colsample_bytree"):
            if not 0 < getattr(self, name) <= 1:
                raise ValueError(f"{name} must be in (0, 1]")
        if self.gamma < 0 or self.min_child_weight < 0 or self.reg_lambda < 0:
            raise ValueError("gamma, min_child_weight and lambda must not be negative")
        if self.eval_metric != C.DEFAULT_EVAL_METRIC:
            raise ValueError("the only supported eval_metric is rmse")

    @classmethod
    def from_map(cls, params: Mapping[str, Any] | None = None) -> BoostParams:
        """Build from a free-form ``key=value`` map; unknown keys are an error."""
        kwargs: dict[str, Any] = {}
        for key, value in with_defaults(params).items():
            if key in _IGNORED_KEYS:
                continue
            if key not in _FIT_KEYS:
                raise ValueError(f"unknown booster parameter: {key}")
            kwargs["reg_lambda" if key == "lambda" else key] = _FIT_KEYS[key](value)
        return cls(**kwargs)


@dataclass(frozen=True)
class RegressionParams:
    """Booster parameters plus rounds, folds and the elbow precision (None = no labels)."""

    boost: BoostParams = field(default_factory=BoostParams)
    nr_rounds: int | None = None
    nr_folds: int = C.DEFAULT_NR_FOLDS
    regularize: float | None = C.ELBOW_PRECISION


RUN_MODES = ("dry", "cfg", "inf")
OUTPUT_FORMATS = ("list", "matrix", "parquet")


@dataclass(frozen=True)
class RunConfig:
    """Everything that describes one run."""

    input_path: str | None = None
    regulators_path: str | None = None
    output_path: str | None = None
    skip_headers: int = 1
    delimiter: str = C.DEFAULT_DELIMITER
    output_format: str = "list"
    sample_size: int | None = None
    nr_partitions: int | None = None
    truncate: int | None = None
    nr_boosting_rounds: int | None = None
    nr_estimation_genes: int = C.DEFAULT_ESTIMATION_SET
    estimation_genes: tuple[str, ...] = ()
    nr_folds: int = C.DEFAULT_NR_FOLDS
    regularized: bool = False
    normalized: bool = False
    include_flags: bool = False
    targets: tuple[str, ...] = ()
    booster_params: Mapping[str, Any] = field(default_factory=dict)
    run_mode: str = "inf"
    report: bool = True
    max_bin: int | None = None

    def __post_init__(self) -> None:
        if self.run_mode not in RUN_MODES:
            raise ValueError(f"run_mode must be one of {RUN_MODES}")
        if self.output_format not in OUTPUT_FORMATS:
            raise ValueError(f"output_format must be one of {OUTPUT_FORMATS}")
        if self.sample_size is not None and self.sample_size <= 0:
            raise ValueError("sample_size must be positive")
        if self.nr_estimation_genes <= 0:
            raise ValueError("nr_estimation_genes must be positive")
        if self.skip_headers < 0:
            raise ValueError("skip_headers must not be negative")

    @property
    def boost(self) -> BoostParams:
        return BoostParams.from_map(self.booster_params)

    def with_rounds(self, rounds: int | None) -> RunConfig:
        return replace(self, nr_boosting_rounds=rounds)

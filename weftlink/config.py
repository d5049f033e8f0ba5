"""Run configuration: defaults, then a file, then overrides; unknown keys and bad values are rejected."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Config:
    data_dir: str = "data"
    output_dir: str = "outputs"
    mode: str = "train"
    seed: int = 42
    train_percent: float = 1.0
    target_distractor_percent: float | None = None
    top_k_dense: int = 150
    top_k_tfidf: int = 150
    tfidf_max_features: int = 500_000
    exact_limit: int = 50_000
    ivf_nlist: int = 1024
    pq_m: int = 32
    nprobe: int = 32
    index_train_rows: int = 200_000
    shard_rows: int = 100_000
    hard_negatives: int = 5
    trees: int = 400
    tree_depth: int = 6
    threshold_grid_size: int = 15
    #: "fixture" scores by fixed formulas, "gbt" fits boosted trees
    scorer: str = "fixture"

    def __post_init__(self):
        if self.mode not in ("train", "test"):
            raise ValueError("mode must be train or test")
        if self.scorer not in ("fixture", "gbt"):
            raise ValueError("scorer must be fixture or gbt")
        for name in ("train_percent", "target_distractor_percent"):
            value = getattr(self, name)
            if value is not None and not 0 < value <= 100:
                raise ValueError(f"{name} must lie in (0, 100]")
        for name in ("top_k_dense", "top_k_tfidf", "tfidf_max_features", "exact_limit", "ivf_nlist", "pq_m", "nprobe", "index_train_rows", "shard_rows", "hard_negatives", "trees", "tree_depth", "threshold_grid_size"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")

    def dump(self) -> dict[str, Any]:
        return asdict(self)


def _typed(name: str, value: Any) -> Any:
    known = {f.name: f for f in fields(Config)}
    if name not in known:
        raise ValueError(f"unknown option: {name}")
    if not isinstance(value, str):
        return value
    default = known[name].default
    if isinstance(default, str):
        return value
    if value.lower() in ("null", "none", ""):
        return None
    return int(value) if isinstance(default, int) else float(value)


def resolve(path: str | None = None, overrides: dict[str, Any] | None = None) -> Config:
    """Defaults < YAML file < overrides; an override of None is left out."""
    values: dict[str, Any] = {}
    if path:
        import yaml

        with open(path, encoding="utf-8") as stream:
            values |= yaml.safe_load(stream) or {}
    values |= {k: v for k, v in (overrides or {}).items() if v is not None}
    return replace(Config(), **{k: _typed(k, v) for k, v in values.items()})

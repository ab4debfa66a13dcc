"""Run configuration from YAML, checked on loading."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

from plumbline.operators.labels import Targets


@dataclass(frozen=True)
class Paths:
    raw: str = "data/raw"
    processed: str = "data/processed"
    artifacts: str = "artifacts"


@dataclass(frozen=True)
class Validation:
    """Years held out, and the shape of walk-forward folds."""

    n_holdout_years: int = 2
    min_train_years: int = 4
    val_horizon_years: int = 1
    step_years: int = 1
    expanding: bool = True

    def __post_init__(self):
        if min(self.n_holdout_years, self.min_train_years, self.val_horizon_years, self.step_years) < 1:
            raise ValueError("years must be 1 or more")


@dataclass(frozen=True)
class Config:
    seed: int = 42
    primary_window_years: int = 4
    paths: Paths = field(default_factory=Paths)
    validation: Validation = field(default_factory=Validation)

    def path(self, name: str, root: str | Path = ".") -> Path:
        return Path(root) / getattr(self.paths, name)


def _known(kind, values: dict | None):
    values, names = values or {}, {f.name for f in fields(kind)}
    if unknown := set(values) - names:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return kind(**values)


def load_config(path: str | Path) -> Config:
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    nested = {"paths": _known(Paths, raw.pop("paths", None)), "validation": _known(Validation, raw.pop("validation", None))}
    return _known(Config, raw | nested)


def load_targets(path: str | Path) -> Targets:
    """Label targets; tiers are a list of name, least value and, if any, the honour that counts."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    tiers = [(t["name"], float(t["least"]), t.get("honour")) for t in raw.pop("tiers", [])]
    return _known(Targets, raw | ({"tiers": tiers} if tiers else {}))


def load_params(path: str | Path) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}

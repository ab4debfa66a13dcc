"""Drift, retraining, a model registry and the pipeline that ties them together."""

from __future__ import annotations

import json
import logging
import math
import os
import random
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import band
from plumbline.operators.ordered import quantiles

TINY = 1e-6


def _indices(reference: DataFrame, current: DataFrame, columns: list[str], bins: int) -> dict[str, float]:
    """The index of each column: its reference's quantile bins, all columns together; counts of both
    tables by column and bin, in one job."""
    found = quantiles(reference, {c: [i / bins for i in range(bins + 1)] for c in columns})
    edges = {c: sorted(set(q) - {None}) for c, q in found.items()}
    rows = reference.select(*columns, F.lit(0).alias("_new")).unionByName(current.select(*columns, F.lit(1).alias("_new")))
    parts = []
    for c in columns:
        inner = edges[c][1:-1]
        place = band(F.col(c).cast("double"), inner, [str(i) for i in range(len(inner) + 1)]).cast("int")
        parts.append(F.struct(F.lit(c).alias("c"), place.alias("b")))
    counts = rows.select("_new", F.explode(F.array(*parts)).alias("p")).where("p.b is not null").groupBy("p.c", "p.b").agg(F.count_if(F.col("_new") == 0).alias("r"), F.count_if(F.col("_new") == 1).alias("k"))
    by: dict[str, list] = {c: [] for c in columns}
    for x in counts.collect():  # a row for each column and bin
        by[x.c].append((x.r, x.k))

    def index(c: str) -> float:
        old, new = (sum(x[i] for x in by[c]) for i in (0, 1))
        if not old or not new:
            return math.nan
        shares = [(max(r / old, TINY), max(k / new, TINY)) for r, k in sorted(by[c])]
        return 0.0 if len(edges[c]) == 1 else math.fsum((a - e) * math.log(a / e) for e, a in shares)

    return {c: index(c) for c in columns}


def stability_index(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row, ``psi``: between two tables, by the reference's quantile bins with open ends.

    NaN if either is empty, 0 if the reference has one value.
    """
    return reference.sparkSession.createDataFrame([(_indices(reference, current, [column], bins)[column],)], "psi double")


def drift_report(reference: DataFrame, current: DataFrame, features: list[str], limit: float = 0.25) -> DataFrame:
    """feature, psi to four places and whether it drifted, the largest first; typed when empty."""
    both = [f for f in features if f in reference.columns and f in current.columns]
    found = _indices(reference, current, both, 10) if both else {}
    out = reference.sparkSession.createDataFrame(list(found.items()), "feature string, psi double").withColumn("psi", F.round("psi", 4))
    return out.withColumn("drifted", F.col("psi") > limit).orderBy(F.desc_nulls_last("psi"), "feature")


@dataclass(frozen=True)
class RetrainingPolicy:
    psi: float = 0.25
    new_years: int = 1


def should_retrain(trained_through: int, labelled_through: int, largest_psi: float, policy: RetrainingPolicy = RetrainingPolicy()) -> tuple[bool, list[str]]:
    """Whether to train again, and why."""
    why = []
    if labelled_through - trained_through >= policy.new_years:
        why.append(f"{labelled_through - trained_through} new labelled years")
    if largest_psi > policy.psi:
        why.append(f"drift: psi {largest_psi:.3f}")
    return bool(why), why


@dataclass
class ModelMeta:
    name: str
    version: str
    metrics: dict
    features: list[str]
    stage: str = "none"
    created_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())


class Registry:
    """Versioned models (JSON parameters) in a folder of the driver, with stages and a latest version."""

    STAGES = ("none", "staging", "production", "archived")

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _index(self) -> dict:
        path = self.folder / "registry.json"
        return json.loads(path.read_text()) if path.exists() else {"latest": None, "models": {}}

    def _write(self, index: dict) -> None:
        (self.folder / "registry.json").write_text(json.dumps(index, indent=1))

    def register(self, name: str, parameters: str, metrics: dict, features: list[str], version: str | None = None) -> ModelMeta:
        index = self._index()
        version = version or f"v{len(index['models']) + 1}"
        meta = ModelMeta(name, version, metrics, features)
        (self.folder / version).mkdir(exist_ok=True)
        (self.folder / version / "model.json").write_text(parameters)
        index["models"][version], index["latest"] = asdict(meta), version
        self._write(index)
        return meta

    def load(self, which: str | None = None) -> tuple[str, ModelMeta]:
        """Parameters and record by version, by stage (its newest), or the latest."""
        index = self._index()
        version = which or index["latest"]
        if which in self.STAGES:
            version = max((m["created_at"], v) for v, m in index["models"].items() if m["stage"] == which)[1] if any(m["stage"] == which for m in index["models"].values()) else None
        if version not in index["models"]:
            raise KeyError(which or "no model")
        return (self.folder / version / "model.json").read_text(), ModelMeta(**index["models"][version])

    def models(self) -> list[ModelMeta]:
        return sorted((ModelMeta(**m) for m in self._index()["models"].values()), key=lambda m: m.created_at, reverse=True)

    def promote(self, version: str, stage: str) -> None:
        index = self._index()
        if stage not in self.STAGES:
            raise ValueError(stage)
        index["models"][version]["stage"] = stage
        self._write(index)


class Tracker:
    """Run parameters, metrics and tags as a JSON file; does nothing without a folder."""

    def __init__(self, folder: str | Path | None = None):
        self.folder, self.run = folder, {"params": {}, "metrics": {}, "tags": {}, "artifacts": []}

    def __enter__(self) -> Tracker:
        return self

    def params(self, **x) -> None:
        self.run["params"] |= x

    def metrics(self, **x) -> None:
        self.run["metrics"] |= x

    def tags(self, **x) -> None:
        self.run["tags"] |= x

    def artifact(self, path: str) -> None:
        self.run["artifacts"].append(path)

    def __exit__(self, *_) -> None:
        if self.folder:
            Path(self.folder).mkdir(parents=True, exist_ok=True)
            (Path(self.folder) / f"run-{datetime.now(UTC):%Y%m%d%H%M%S%f}.json").write_text(json.dumps(self.run))


def set_seed(seed: int) -> None:
    random.seed(seed)
    np.random.seed(seed)
    os.environ["PYTHONHASHSEED"] = str(seed)


def logger(name: str) -> logging.Logger:
    if not logging.getLogger().handlers:
        logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    return logging.getLogger(name)


def run_pipeline(prospects: DataFrame, features: list[str], target: str, registry: Registry, holdout_years: int = 2, alpha: float = 10.0, key: str = "player_id") -> dict:
    """Split in time, compare models by walk-forward folds, train, score the holdout once, register, watch drift."""
    from plumbline.operators.cleaning import Preprocessor
    from plumbline.operators.metrics import default_metrics
    from plumbline.operators.models import Linear, mean_model, ridge
    from plumbline.operators.temporal import evaluated, holdout, walk_forward, years_of

    dev, held = (x.cache() for x in holdout(prospects, holdout_years))
    folds = walk_forward(years_of(dev))

    class Fitted:
        def __init__(self, pre: Preprocessor, model: Linear):
            self.pre, self.model = pre, model

        def transform(self, df: DataFrame) -> DataFrame:
            return self.model.transform(self.pre.transform(df))

    def fit_ridge(train: DataFrame) -> Fitted:
        pre = Preprocessor(features).fit(train)
        return Fitted(pre, ridge(pre.transform(train), features, target, alpha))

    def fit_mean(train: DataFrame) -> Fitted:
        return Fitted(Preprocessor(features).fit(train), mean_model(train, target))

    scores = default_metrics(target, key)
    results = {name: evaluated(dev, folds, fit, scores)[1] for name, fit in (("ridge", fit_ridge), ("mean", fit_mean))}
    final = fit_ridge(dev)
    scored = final.transform(held)
    metrics = {k: m(scored).first()[0] for k, m in scores.items()}
    meta = registry.register("ridge", final.model.to_json(), metrics, features)
    drift = [r.asDict() for r in drift_report(dev, held, features).collect()]
    return {"cross_validation": results, "holdout": metrics, "version": meta.version, "drift": drift}

"""Strictly temporal splits: folds are sets of years, applied as filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.features import LeakageError


@dataclass(frozen=True)
class Fold:
    """Years of training and validation; all of the former are before all of the latter."""

    number: int
    train_years: tuple[int, ...]
    val_years: tuple[int, ...]

    def __post_init__(self):
        if not self.train_years or not self.val_years or max(self.train_years) >= min(self.val_years):
            raise LeakageError(f"fold {self.number}: training years aren't all before validation years")

    def split(self, df: DataFrame, year: str = "draft_year") -> tuple[DataFrame, DataFrame]:
        return df.where(F.col(year).isin(*self.train_years)), df.where(F.col(year).isin(*self.val_years))


def years_of(df: DataFrame, year: str = "draft_year") -> list[int]:
    """The distinct years of ``df``, in order; none is an error."""
    years = sorted(r[0] for r in df.select(year).where(F.col(year).isNotNull()).distinct().collect())
    if not years:
        raise ValueError("no years")
    return years


def holdout(df: DataFrame, n_years: int = 2, year: str = "draft_year") -> tuple[DataFrame, DataFrame]:
    """(development, holdout): the last ``n_years`` distinct years are held out."""
    years = years_of(df, year)
    if not 0 < n_years < len(years):
        raise LeakageError(f"{n_years} of {len(years)} years can't be held out")
    edge = years[-n_years]
    return df.where(F.col(year) < edge), df.where(F.col(year) >= edge)


def walk_forward(years: list[int], min_train: int = 4, horizon: int = 1, step: int = 1, expanding: bool = True) -> list[Fold]:
    """Folds over distinct years: ``min_train`` or more years of training, then ``horizon`` of validation."""
    years, folds = sorted(set(years)), []
    for end in range(min_train, len(years) - horizon + 1, step):
        start = 0 if expanding else end - min_train
        folds.append(Fold(len(folds), tuple(years[start:end]), tuple(years[end : end + horizon])))
    if not folds:
        raise LeakageError("too few years for a fold")
    return folds


def evaluated(df: DataFrame, folds: list[Fold], fit: Callable, metrics: dict[str, Callable], year: str = "draft_year") -> tuple[list[dict], dict]:
    """Per fold the metrics of ``fit(train).transform(validation)``, then their means and population deviations.

    ``fit`` takes a DataFrame and returns a model with ``transform``; a metric takes the scored
    DataFrame and returns a one-row DataFrame. Cache ``df``: each fold reads it.
    """
    rows = []
    for fold in folds:
        train, val = fold.split(df, year)
        scored = fit(train).transform(val)
        if scored.where("prediction is null").limit(1).count():
            raise ValueError(f"fold {fold.number}: nulls are left after preprocessing")
        rows.append({"fold": fold.number, "train_years": list(fold.train_years), "val_years": list(fold.val_years)} | {k: m(scored).first()[0] for k, m in metrics.items()})
    n = len(rows)
    means = {k: sum(r[k] for r in rows) / n for k in metrics}
    return rows, {k: {"mean": means[k], "std": (sum((r[k] - means[k]) ** 2 for r in rows) / n) ** 0.5} for k in metrics}


def predictions(df: DataFrame, folds: list[Fold], fit: Callable, year: str = "draft_year") -> DataFrame:
    """Out-of-fold predictions: each validated row once, with its fold."""
    def parts() -> Iterator[DataFrame]:
        for fold in folds:
            train, val = fold.split(df, year)
            yield fit(train).transform(val).withColumn("fold", F.lit(fold.number))

    out = None
    for part in parts():
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def report(rows: list[dict], totals: dict) -> str:
    """An evaluation as text, a fold to a line."""
    names = list(totals)
    lines = [f"fold {r['fold']} ({r['val_years'][0]}-{r['val_years'][-1]}): " + ", ".join(f"{k} {r[k]:.4f}" for k in names) for r in rows]
    return "\n".join([*lines, "all: " + ", ".join(f"{k} {totals[k]['mean']:.4f} +- {totals[k]['std']:.4f}" for k in names)])

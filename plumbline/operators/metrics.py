"""Rank, error and calibration metrics, each a one-row or small DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import paired, running_total


def mean_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """(_v, ``name``): the rank from 1 of each distinct value, ties at their mean.

    Counts by value are summed in order, so rows are never sorted together; only distinct
    values are.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return running_total(counts, "_v", "_n", "_before").select("_v", (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(name))


def with_mean_rank(df: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """Add the mean rank of each (column, name)."""
    out = df
    for column, name in columns:
        out = out.join(mean_ranks(df, column, name), F.col(column) == F.col("_v"), "left").drop("_v")
    return out


def spearman(df: DataFrame, a: str, b: str, name: str = "rho", few: float | None = None) -> DataFrame:
    """Pearson's correlation of mean ranks; 0 without variance; under two rows ``few``, or an error without it."""
    rows = with_mean_rank(df.select(a, b).dropna(), (a, "_ra"), (b, "_rb"))
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.covar_pop("_ra", "_rb").alias("c"), F.var_pop("_ra").alias("va"), F.var_pop("_rb").alias("vb"))
    none = F.raise_error(F.lit("a rank correlation needs two rows")) if few is None else F.lit(few)
    rho = F.when(F.col("n") < 2, none.cast("double")).otherwise(F.coalesce(F.try_divide(F.col("c"), F.sqrt(F.col("va") * F.col("vb"))), F.lit(0.0)))
    return s.select(rho.alias(name))


def kendall(df: DataFrame, a: str, b: str, key: str, name: str = "tau") -> DataFrame:
    """Tau-a over all pairs of distinct rows, without correction for ties, by counting inversions."""
    known = df.select(a, b).dropna().persist()
    pairs, n = paired(known, a, b, F.lit(1.0), F.lit(1.0)), known.count()
    known.unpersist()
    return pairs.select(F.try_divide(F.col("less") - F.col("more"), F.lit(n * (n - 1) / 2.0)).alias(name))


def top_k_hit_rate(df: DataFrame, actual: str, predicted: str, order: str, k: int = 10, name: str = "hit_rate") -> DataFrame:
    """The overlap of both top k over min(k, n); ties by ``order``. Two bounded top-k plans, one join."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    best = lambda c: df.orderBy(F.desc(c), order).limit(k).select(order)
    hits = best(actual).join(best(predicted), order).agg(F.count(F.lit(1)).alias("hits"))
    size = df.limit(k).agg(F.count(F.lit(1)).alias("n"))
    return hits.crossJoin(size).select(F.try_divide(F.col("hits").cast("double"), F.col("n")).alias(name))


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((actual - predicted) * (actual - predicted)))


def probability(p: Column) -> Column:
    return F.when((p < 0) | (p > 1), F.raise_error(F.lit("probabilities must be in [0, 1]")).cast("double")).otherwise(p)


def brier(p: Column, y: Column) -> Column:
    return F.avg((probability(p) - y) * (probability(p) - y))


def bin_of(p: Column, bins: int) -> Column:
    """The number of the bin (lo, hi] that holds ``p``; the first one is closed."""
    edges = [i / bins for i in range(1, bins)]
    ladder = F.when(p.isNull(), None)
    for i, hi in enumerate(edges):
        ladder = ladder.when(p <= hi, i)
    return ladder.otherwise(bins - 1)


def calibration_table(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """bin, lo, hi, n, mean_p and mean_y of all bins, empty ones too."""
    got = df.where(F.col(p).isNotNull()).groupBy(bin_of(probability(F.col(p)), bins).alias("_bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(got), F.col("bin") == F.col("_bin"), "left").select(
        "bin", (F.col("bin") / float(bins)).alias("lo"), ((F.col("bin") + 1) / float(bins)).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "mean_y"
    )


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10, name: str = "ece") -> DataFrame:
    """Expected calibration error: the bins' gaps, by their share of rows."""
    t = calibration_table(df, p, y, bins)
    return t.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("mean_y") - F.col("mean_p"))), F.sum("n")).alias(name))


def residual_segments(df: DataFrame, segment: str, actual: str, predicted: str) -> DataFrame:
    """n, bias, mae and rmse by segment, the worst mae first."""
    r = F.col(predicted) - F.col(actual)
    return df.groupBy(segment).agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("bias"), F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse")).orderBy(F.desc("mae"), segment)


def largest_errors(df: DataFrame, actual: str, predicted: str, k: int, *order: str) -> DataFrame:
    """The ``k`` rows with the largest absolute residual."""
    r = F.col(predicted) - F.col(actual)
    return df.withColumns({"residual": r, "abs_residual": F.abs(r)}).orderBy(F.desc("abs_residual"), *order).limit(k)


def interval_coverage(y: Column, low: Column, high: Column) -> Column:
    return F.avg(F.when(y.between(low, high), 1.0).otherwise(0.0))


def default_metrics(target: str, key: str, predicted: str = "prediction") -> dict:
    """The usual three, each a function of scored rows: rank correlation, hit rate of the top ten, RMSE."""
    return {
        "spearman": lambda d: spearman(d, target, predicted),
        "top10": lambda d: top_k_hit_rate(d, target, predicted, key, 10),
        "rmse": lambda d: d.agg(rmse(F.col(target), F.col(predicted))),
    }


@dataclass(frozen=True)
class Spec:
    """A model to compare: its features, and what makes a preprocessor and a model of them."""

    features: list[str]
    model: Callable
    preprocessor: Callable

    def fit(self, train: DataFrame):
        """The fitted chain, for ``temporal.evaluated``."""
        pre = self.preprocessor(self.features).fit(train)
        model = self.model(pre.transform(train), self.features)
        return _Chain(pre, model)


@dataclass(frozen=True)
class _Chain:
    pre: object
    model: object

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.pre.transform(df))


def compare(spark, results: list[dict], metric: str, baseline: str, larger_is_better: bool = True) -> DataFrame:
    """Models by ``metric``, best first and missing last, with their uplift over ``baseline``."""
    base = next((r[metric] for r in results if r["model"] == baseline), None)
    rows = [(r["model"], r.get(metric), None if base is None or r.get(metric) is None else r[metric] - base) for r in results]
    df = spark.createDataFrame(rows, f"model string, {metric} double, uplift double")
    return df.orderBy(F.desc_nulls_last(metric) if larger_is_better else F.asc_nulls_last(metric), "model")


def concordance(df: DataFrame, time: str, event: str, risk: str, name: str = "c_index") -> DataFrame:
    """Censoring-aware concordance: of comparable pairs, those whose higher risk has the earlier event.

    A pair is comparable if the first has an event and the other is observed for longer, or as
    long without an event; equal risks count half. Pairs are counted, not made.
    """
    seen = F.col(event).cast("int") == 1
    known = df.select(time, event, risk).dropna().persist()
    # of equal times the events come first
    times = running_total(known.groupBy(F.col(time).cast("double").alias("_t")).agg(F.lit(2).alias("_two")), "_t", "_two", "_p").select("_t", "_p")
    rows = known.join(times, F.col(time).cast("double") == F.col("_t")).withColumn("_p", F.col("_p") + F.when(seen, 0).otherwise(1))
    got = paired(rows, "_p", risk, F.when(seen, 1.0).otherwise(0.0), F.lit(1.0))
    known.unpersist()
    return got.select(F.try_divide(F.col("more") + 0.5 * F.col("equal"), F.col("less") + F.col("equal") + F.col("more")).alias(name))

"""Summaries for exploring a table, and their Markdown report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import band
from plumbline.operators.metrics import spearman, with_mean_rank
from plumbline.operators.ordered import quantiles


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, missing share, mean, sd, min, quartiles (linear) and max of each column, all columns together."""
    quartiles = quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})

    def stats(c: str) -> Column:
        x = F.col(c).cast("double")
        q = [F.lit(v).cast("double") for v in quartiles[c]]
        return F.struct(
            F.lit(c).alias("feature"), F.count(F.lit(1)).alias("n"), F.avg(F.when(x.isNull(), 1.0).otherwise(0.0)).alias("missing"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
            F.min(x).alias("min"), q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"), F.max(x).alias("max"),
        )

    return df.agg(F.array(*map(stats, columns)).alias("s")).select(F.inline("s"))


def missingness_by_group(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    return df.groupBy(group).agg(*(F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)).alias(c) for c in columns))


def _whole(df: DataFrame, columns: list[str]) -> tuple[list[str], int]:
    """The columns without nulls, and the number of rows."""
    n, *counts = df.agg(F.count(F.lit(1)), *map(F.count, columns)).first()
    return [c for c, k in zip(columns, counts, strict=True) if k == n], n


def _rank_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """a, b, rho of each pair, over rows that have both (NaN under two).

    Columns without nulls are ranked once, and one aggregate gives all their pairs; a pair with
    nulls has ranks of its own.
    """
    whole, n = _whole(df, list(dict.fromkeys(c for p in pairs for c in p)))
    together = [p for p in pairs if set(p) <= set(whole)] if n > 1 else []
    out = None
    if together:
        used = list(dict.fromkeys(c for p in together for c in p))
        base = df.select(*(F.col(c).cast("double").alias(c) for c in used)).persist()
        at = {c: f"_rank{i}" for i, c in enumerate(used)}
        rows = with_mean_rank(base, *at.items())
        rho = lambda a, b: F.coalesce(F.try_divide(F.covar_pop(at[a], at[b]), F.sqrt(F.var_pop(at[a]) * F.var_pop(at[b]))), F.lit(0.0))
        found = rows.agg(*(rho(a, b) for a, b in together)).first()  # a number for each pair
        base.unpersist()
        out = df.sparkSession.createDataFrame([(a, b, float(x)) for (a, b), x in zip(together, found, strict=True)], "a string, b string, rho double")
    for a, b in pairs:
        if (a, b) not in together:
            both = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
            one = spearman(both, "x", "y", few=float("nan")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "rho")
            out = one if out is None else out.union(one)
    return out


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, rho: pairwise complete Spearman correlations to four places, NaN under two rows."""
    return _rank_correlations(df, [(a, b) for i, a in enumerate(columns) for b in columns[i:]]).withColumn("rho", F.round("rho", 4))


def feature_target(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Each feature's Spearman correlation with the target, the largest by size first."""
    found = _rank_correlations(df, [(f, target) for f in features]).select(F.col("a").alias("feature"), "rho")
    return found.orderBy(F.desc_nulls_last(F.abs("rho")), "feature")


def with_bands(df: DataFrame, column: str, edges: list[float], labels: list[str], name: str = "band") -> DataFrame:
    return df.withColumn(name, band(F.col(column), edges, labels))


def band_counts(df: DataFrame, column: str = "band", order: list[str] | None = None) -> DataFrame:
    """Rows and share of each band; with ``order`` all its bands, in that order, empty ones too."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if order is not None:
        every = df.sparkSession.createDataFrame(list(enumerate(order)), f"_i int, {column} string")
        counts = every.join(F.broadcast(counts), column, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("base_rate", F.try_divide(F.col("n").cast("double"), F.col("_total"))).drop("_total")
    return out.orderBy("_i").drop("_i") if order is not None else out.orderBy(column)


def grouped_target(df: DataFrame, group: str, target: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean_target"), F.median(target).alias("median_target"))


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """The distinct linear quantiles at the bins' edges (a few numbers on the driver)."""
    got = quantiles(df, {column: [i / bins for i in range(bins + 1)]})[column]
    return sorted(set(got) - {None})


def binned_relationship(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """lo, hi, n and mean target of quantile bins with distinct edges."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    edges = quantile_edges(rows, x, bins)
    if len(edges) < 2:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long, mean_target double")
    place = band(F.col(x).cast("double"), edges[1:-1], [str(i) for i in range(len(edges) - 1)]).cast("int")
    table = F.array(*map(F.lit, edges))
    return rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_target")).select("bin", F.element_at(table, F.col("bin") + 1).alias("lo"), F.element_at(table, F.col("bin") + 2).alias("hi"), "n", "mean_target").orderBy("bin")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin, lo, hi and n of bins of equal width from the least to the largest value."""
    x = F.col(column).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    got = df.where(x.isNotNull()).groupBy(place.alias("_bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(got), F.col("bin") == F.col("_bin"), "left").select("bin", (low + F.col("bin") * width).alias("lo"), (low + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def markdown(df: DataFrame, rows: int = 20) -> str:
    """A table of the first rows, numbers to four digits, with a note on how many are left out."""
    shown = df.limit(rows + 1).collect()
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in shown[:rows]]
    if len(shown) > rows:
        lines.append(f"\n_{df.count() - rows} more rows_")
    return "\n".join(lines)


def report(df: DataFrame, features: list[str], target: str, group: str, edges: list[float], labels: list[str]) -> str:
    """Six sections: summary, missing values, target bands, target by group, correlations, a binned relation."""
    ranked = feature_target(df, features, target)
    best = ranked.first()
    sections = [
        ("Numeric summary", numeric_summary(df, [*features, target])),
        ("Missing by group", missingness_by_group(df, group, features).orderBy(group)),
        ("Target bands", band_counts(with_bands(df, target, edges, labels), order=labels)),
        ("Target by group", grouped_target(df, group, target).orderBy(group)),
        ("Features and target", ranked),
        (f"Target by {best.feature}", binned_relationship(df, best.feature, target)),
    ]
    return "# Report\n\n" + "\n\n".join(f"## {t}\n\n{markdown(d)}" for t, d in sections) + "\n"

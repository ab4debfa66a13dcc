"""Running totals, numbers and order statistics over a whole order without gathering it in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a window partition that are aimed at, and cuts at least and at most.
ROWS, BINS, MOST = 1_000_000, 64, 1024
#: Distinct values that reach the driver to end a search for order statistics.
FEW = 4096


def _steps(n: int) -> Column:
    return F.expr(f"array({', '.join(f'{i}D / {n}' for i in range(n + 1))})")


def binned(df: DataFrame, order: Column, name: str = "_bin", rows: int = ROWS) -> DataFrame:
    """Add the number of the cut that ``order`` (a number) falls in; ties share a cut.

    Cuts are approximate quantiles, one for each ``rows`` rows, ``BINS`` at least and ``MOST`` at
    most; the one row that they come in is sent to all tasks.
    """
    x = order.cast("double")
    bins = F.least(F.lit(MOST), F.greatest(F.lit(BINS), F.ceil(F.count(F.lit(1)) / rows).cast("int")))
    every = df.agg(bins.alias("n"), F.percentile_approx(x, _steps(MOST), F.lit(10 * MOST)).alias("p"))
    cuts = every.select(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.element_at("p", (i * MOST / F.col("n")).cast("int") + 1))).alias("c"))
    wide = 32
    found = cuts.select(F.col("c").alias("_all"), F.filter("c", lambda _, i: i % wide == wide - 1).alias("_few"))
    # the stretch of cuts first, then the place in it
    under = lambda a: F.size(F.filter(a, lambda c: c <= x))
    stretch = under(F.col("_few")) * wide
    place = stretch + under(F.slice(F.col("_all"), stretch + 1, F.lit(wide)))
    return df.crossJoin(F.broadcast(found)).withColumn(name, F.greatest(F.coalesce(place, F.lit(0)), F.lit(0))).drop("_all", "_few")


def running_total(df: DataFrame, order: str, value: str, name: str, *then: str) -> DataFrame:
    """Add the sum of ``value`` over all rows that come before by ``order`` (a number), ties by ``then``.

    The order is cut at approximate quantiles, which bound the rows of a window partition; the
    totals of the cuts are few and are broadcast. Ties share a cut, so the sums are exact.
    """
    rows = binned(df, F.col(order))
    totals = rows.groupBy("_bin").agg(F.sum(value).alias("_t"))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("_bin").alias("_b"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_bin").orderBy(order, *then).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_w", F.coalesce(F.sum(value).over(within), F.lit(0))).join(F.broadcast(bases), F.col("_bin") == F.col("_b"))
    return out.withColumn(name, F.col("_w") + F.col("_base")).drop("_w", "_b", "_base", "_bin")


def numbered(df: DataFrame, group: list[str], first: Column, then: list, name: str) -> DataFrame:
    """Number the rows of each group from 1 by ``first`` (a number, ascending) and then ``then``.

    A group's rows are cut by ``first``, so a group with most of the rows isn't one task's.
    """
    rows = binned(df, first)
    counts = rows.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_bin").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    same = F.col("_bin") == F.col("_b")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = F.row_number().over(Window.partitionBy(*group, "_bin").orderBy(first, *then))
    return rows.withColumn("_w", within).join(base, same).withColumn(name, (F.col("_w") + F.col("_base")).cast("long")).select(*df.columns, name)


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each value of ``keys``: the first by ``order`` and then by all columns, so equal tables keep equal rows."""
    rest = [F.col(c) for c in df.columns if c not in keys]
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *rest))).where("_first = 1").drop("_first")


def paired(df: DataFrame, first: str, second: str, left: Column, right: Column) -> DataFrame:
    """One row, less, equal and more: over all pairs of rows whose first has the smaller ``first``, the sum
    of its ``left`` times the other's ``right``, by how their ``second`` compare (first's to other's).

    Pairs are never made. Distinct values of ``second`` are numbered, and a number's binary digits
    split the pairs: two numbers compare as the first digit in which they differ. So for each
    digit and all that stands before it, running sums by ``first`` give the pairs: a sort of the
    rows for each digit, in one shuffle, with cuts for groups of many rows.
    """
    rows = df.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(F.col(first).alias("_x"), F.col(second).alias("_y")).agg(F.sum(left).alias("_l"), F.sum(right).alias("_r")).persist()

    def place(c: str, name: str) -> DataFrame:
        each = rows.select(F.col(c).cast("double").alias(f"{name}_v")).distinct().withColumn("_one", F.lit(1))
        return running_total(each, f"{name}_v", "_one", name).select(F.col(f"{name}_v"), F.col(name).cast("long").alias(name))

    a, b = place("_x", "_first"), place("_y", "_second")
    own, levels = rows, max(1, (rows.select("_y").distinct().count() - 1).bit_length())
    rows = rows.join(a, F.col("_x").cast("double") == F.col("_first_v")).join(b, F.col("_y").cast("double") == F.col("_second_v")).select("_first", "_second", "_l", "_r")
    placed = binned(rows, F.col("_first")).persist()
    rows = placed.withColumn("_level", F.explode(F.sequence(F.lit(-1), F.lit(levels - 1))))  # level -1: equal numbers
    prefix = F.when(F.col("_level") < 0, F.col("_second")).otherwise(F.expr("shiftright(_second, _level + 1)"))
    digit = F.when(F.col("_level") < 0, F.lit(0)).otherwise(F.expr("shiftright(_second, _level) & 1").cast("int"))
    some = lambda c, j: F.sum(F.when(F.col("_digit") == j, F.col(c)).otherwise(0)).cast("double").alias(f"{c}{j}")
    group = ["_level", "_prefix"]
    rows = rows.withColumns({"_prefix": prefix, "_digit": digit}).groupBy(*group, "_bin", "_first").agg(some("_l", 0), some("_l", 1), some("_r", 0), some("_r", 1))
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*group, "_bin").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    base = rows.groupBy(*group, "_bin").agg(F.sum("_l0").alias("_t0"), F.sum("_l1").alias("_t1"))
    base = base.select(*group, "_bin", *(F.coalesce(F.sum(f"_t{j}").over(before), zero).alias(f"_b{j}") for j in (0, 1)))
    rows = rows.withColumns({f"_w{j}": F.coalesce(F.sum(f"_l{j}").over(within), zero) for j in (0, 1)}).join(base, [*group, "_bin"])
    low, high = F.col("_w0") + F.col("_b0"), F.col("_w1") + F.col("_b1")
    differ = F.col("_level") >= 0
    total = lambda when, x: F.coalesce(F.sum(F.when(when, x)), zero)
    got = rows.agg(total(differ, F.col("_r1") * low), total(~differ, F.col("_r0") * low), total(differ, F.col("_r0") * high)).first()
    for held in (own, placed):
        held.unpersist()
    return df.sparkSession.createDataFrame([tuple(got)], "less double, equal double, more double")


def quantiles(df: DataFrame, wanted: dict[str, list[float]], ceil: bool = False) -> dict[str, list[float | None]]:
    """Exact quantiles of columns: linear between neighbours, or with ``ceil`` the order statistic above.

    Each is searched between bounds that close in on it by approximate quantiles, all in one job a
    round; at most ``FEW`` distinct values of a column reach the driver at its end. Nulls and NaN
    are left out; a column without values gives None; infinities are values like any other, and a
    place between a finite value and an infinity is that infinity (between both, NaN). The columns are kept while rounds
    go on, on disk where memory is short, so what they come from runs once.
    """
    value = {c: F.col(c) for c in wanted}
    df = df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in wanted)).persist()

    def inside(c: str, low, high) -> Column:
        x = value[c]
        fits = F.lit(True) if low is None else x > low
        return F.when(fits if high is None else fits & (x < high), x)

    def looked(spans: list) -> list:
        """Of each (column, open ends): distinct values, nearly, their number and 129 approximate quantiles."""
        of = lambda x: F.struct(F.approx_count_distinct(x).alias("d"), F.count(x).alias("n"), F.percentile_approx(x, _steps(128), F.lit(10_000)).alias("cuts"))
        return list(df.agg(*(of(inside(*s)).alias(f"s{i}") for i, s in enumerate(spans))).first())

    known = dict(zip([(c, None, None) for c in wanted], looked([(c, None, None) for c in wanted]), strict=True))
    sizes = {c: known[c, None, None].n for c in wanted}
    places = {c: [(sizes[c] - 1) * q for q in qs] for c, qs in wanted.items()}
    needed = {(c, k) for c, ps in places.items() if sizes[c] for p in ps for k in ({math.ceil(p - 1e-9)} if ceil else {math.floor(p), math.ceil(p)})}
    bounds = dict.fromkeys(needed, (None, None, 0))  # open ends, and values up to the lower one
    found: dict[tuple[str, int], float] = {}
    while todo := sorted(needed - set(found)):
        spans = sorted({(c, *bounds[c, k]) for c, k in todo}, key=repr)
        new = [s[:3] for s in spans if s[:3] not in known]
        known |= dict(zip(new, looked(new), strict=True)) if new else {}
        few = [s for s in spans if known[s[:3]].d <= FEW // 2]
        if few:  # all their values, counted in one job
            each = F.array(*(F.struct(F.lit(i).alias("i"), inside(*s[:3]).alias("v")) for i, s in enumerate(few)))
            counts = df.select(F.inline(each)).where("v is not null").groupBy("i", "v").count().collect()
            for i, (c, lo, hi, before) in enumerate(few):
                at, mine = before, [k for d, k in todo if d == c and bounds[c, k] == (lo, hi, before)]
                for v, n in sorted((r["v"], r["count"]) for r in counts if r["i"] == i):
                    found |= {(c, k): v for k in mine if at <= k < at + n}
                    at += n
        for c, lo, hi, before in (s for s in spans if s not in few):
            cuts = sorted(set(known[c, lo, hi].cuts))
            x = inside(c, lo, hi)
            under = df.agg(*(F.count(F.when(x < v, 1)).alias(f"l{j}") for j, v in enumerate(cuts)), *(F.count(F.when(x == v, 1)).alias(f"e{j}") for j, v in enumerate(cuts))).first()
            for k in [k for d, k in todo if d == c and bounds[c, k] == (lo, hi, before)]:
                j = max((j for j in range(len(cuts)) if before + under[f"l{j}"] <= k), default=None)
                if j is None:
                    bounds[c, k] = (lo, cuts[0], before)
                elif k < (to := before + under[f"l{j}"] + under[f"e{j}"]):
                    found[c, k] = cuts[j]
                else:
                    bounds[c, k] = (cuts[j], cuts[j + 1] if j + 1 < len(cuts) else hi, to)

    def between(c: str, p: float) -> float | None:
        if not sizes[c]:
            return None
        if ceil:
            return found[c, math.ceil(p - 1e-9)]
        a, b = found[c, math.floor(p)], found[c, math.ceil(p)]
        if a == b or math.isinf(a) or math.isinf(b):
            return a if a == b else a + b
        return a + (b - a) * (p - math.floor(p))

    df.unpersist()
    return {c: [between(c, p) for p in ps] for c, ps in places.items()}

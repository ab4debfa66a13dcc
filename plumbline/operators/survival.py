"""Cox proportional hazards over distributed risk sets."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.expressions import clip, dot
from plumbline.operators.ordered import binned

#: Events of one time whose terms are summed by one row.
BLOCK = 1 << 16


def soft(x: float, by: float) -> float:
    """``x`` moved towards 0 by ``by``, and not beyond it."""
    return math.copysign(max(abs(x) - by, 0.0), x)


class Cox:
    """Cox regression with Efron's ties and an elastic net, by proximal Newton steps.

    Minimises ``-log likelihood / n + penalty * (l1_ratio * |b| + (1 - l1_ratio) / 2 * b * b)`` over
    coefficients of standardised features. A step takes these jobs, and brings one row of sums to
    the driver whatever the number of rows and of distinct times:

    * rows are summed by time, those with an event also apart;
    * a time's risk set is all of its time and later: sums within a cut of the order of times (in
      a window), and the totals of later cuts (``ordered.MOST`` at most, so few rows to broadcast);
    * of ``d`` events at one time the l-th sees the risk set less l/d of the events' own sums. The
      terms are as many as events; they are summed in blocks, so a time with most of the events is
      many rows' work and no long array.

    Steps are halved until the objective doesn't rise; scores beyond 300 count as 300, so that sums stay finite. Rows with a null or NaN among the features, time or
    event don't count; without rows fitting is an error, and without events all coefficients are 0. A feature
    without spread has coefficient 0.
    """

    def __init__(self, features: list[str], time: str, event: str, penalty: float = 0.1, l1_ratio: float = 0.0, steps: int = 25, block: int = BLOCK):
        self.features, self.time, self.event = features, time, event
        self.penalty, self.l1_ratio, self.steps, self.block = penalty, l1_ratio, steps, block

    def fit(self, df: DataFrame) -> Cox:
        k = len(self.features)
        used = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.features)), F.col(self.time).cast("double").alias("_t"), F.col(self.event).cast("double").alias("_e")).dropna()
        m = used.agg(F.count(F.lit(1)), *(F.avg(f"x{i}") for i in range(k)), *(F.stddev_samp(f"x{i}") for i in range(k))).first()
        self.n = m[0]
        if not self.n:
            raise ValueError("no rows to fit")
        self.mean = np.array(m[1 : k + 1], float)
        spread = np.array([x or 0.0 for x in m[k + 1 :]], float)
        self.sd = np.where(spread > 1e-12, spread, 1.0)
        z = [((F.col(f"x{i}") - float(self.mean[i])) / float(self.sd[i])).alias(f"z{i}") for i in range(k)]
        rows = binned(used.select("_t", "_e", *z), F.col("_t")).persist()
        beta = np.zeros(k)
        now, grad, hess = self._looked(rows, beta)
        self.objectives = [now]
        for _ in range(self.steps):
            move = self._direction(beta, grad, hess)
            if not k or np.abs(move).max() < 1e-9:
                break
            size = 1.0
            while size > 1e-6:
                then, new_grad, new_hess = self._looked(rows, beta + size * move)
                if then <= now + 1e-12:
                    break
                size /= 2
            else:
                break
            beta, now, grad, hess = beta + size * move, then, new_grad, new_hess
            self.objectives.append(now)
        rows.unpersist()
        self.beta = beta
        return self

    def _looked(self, rows: DataFrame, beta) -> tuple[float, np.ndarray, np.ndarray]:
        """(objective, gradient and Hessian of its smooth part) at ``beta``."""
        k = len(beta)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        names = ["s", *(f"s{i}" for i in range(k)), *(f"s{i}_{j}" for i, j in pairs)]
        score = dot([f"z{i}" for i in range(k)], beta)
        risk = F.col("_r")
        parts = [risk, *(risk * F.col(f"z{i}") for i in range(k)), *(risk * F.col(f"z{i}") * F.col(f"z{j}") for i, j in pairs)]
        event = F.col("_e") > 0
        own = lambda x: F.sum(F.when(event, x).otherwise(0.0))
        times = rows.withColumn("_r", F.exp(clip(score, -300, 300))).groupBy("_bin", "_t").agg(
            F.sum(F.when(event, 1).otherwise(0)).alias("d"), own(score).alias("x"), *(own(F.col(f"z{i}")).alias(f"x{i}") for i in range(k)),
            *(F.sum(p).alias(c) for p, c in zip(parts, names, strict=True)), *(own(p).alias(f"e{c}") for p, c in zip(parts, names, strict=True)),
        ).persist()
        later = Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)  # a row a cut
        totals = times.groupBy("_bin").agg(*(F.sum(c).alias(c) for c in names))
        bases = totals.select(F.col("_bin").alias("_b"), *(F.coalesce(F.sum(c).over(later), F.lit(0.0)).alias(f"b{c}") for c in names))
        within = Window.partitionBy("_bin").orderBy(F.desc("_t")).rowsBetween(Window.unboundedPreceding, 0)
        sets = times.select("_bin", "_t", "d", "x", *(f"x{i}" for i in range(k)), *(f"e{c}" for c in names), *(F.sum(c).over(within).alias(c) for c in names)).where("d > 0")
        sets = sets.join(F.broadcast(bases), F.col("_bin") == F.col("_b")).withColumns({c: F.col(c) + F.col(f"b{c}") for c in names})

        blocks = sets.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d") - 1, F.lit(self.block).cast("long")))).repartition("_t", "_from")
        terms = F.sequence(F.col("_from"), F.least(F.col("_from") + self.block, F.col("d")) - 1)

        def added(a, term):
            u = term / F.col("d")
            left = F.col("s") - u * F.col("es")
            return F.struct(*(x.alias(c) for c, x in {"l": a["l"] + F.log(left), "p": a["p"] + 1 / left, "q": a["q"] + u / left, "pp": a["pp"] + 1 / left / left, "pq": a["pq"] + u / left / left, "qq": a["qq"] + u * u / left / left}.items()))

        zero = F.struct(*(F.lit(0.0).alias(c) for c in ("l", "p", "q", "pp", "pq", "qq")))
        got = blocks.withColumn("w", F.aggregate(terms, zero, added)).withColumn("_first", (F.col("_from") == 0).cast("double"))
        w = lambda c: F.col(f"w.{c}")
        s, e = F.col, lambda c: F.col(f"e{c}")
        wanted = [F.sum(F.col("_first") * F.col("x") - w("l")).alias("ll")]
        wanted += [F.sum(F.col("_first") * F.col(f"x{i}") - w("p") * s(f"s{i}") + w("q") * e(f"s{i}")).alias(f"g{i}") for i in range(k)]
        for i, j in pairs:
            seen = w("pp") * s(f"s{i}") * s(f"s{j}") - w("pq") * (s(f"s{i}") * e(f"s{j}") + e(f"s{i}") * s(f"s{j}")) + w("qq") * e(f"s{i}") * e(f"s{j}")
            wanted.append(F.sum(w("p") * s(f"s{i}_{j}") - w("q") * e(f"s{i}_{j}") - seen).alias(f"h{i}_{j}"))
        r = got.agg(*wanted).first()
        times.unpersist()
        l2 = self.penalty * (1 - self.l1_ratio)
        if r.ll is None:  # no events
            return 0.5 * l2 * float(beta @ beta) + self.penalty * self.l1_ratio * float(np.abs(beta).sum()), l2 * beta, l2 * np.eye(k)
        value = -r.ll / self.n + 0.5 * l2 * float(beta @ beta) + self.penalty * self.l1_ratio * float(np.abs(beta).sum())
        grad = -np.array([r[f"g{i}"] for i in range(k)]) / self.n + l2 * beta
        hess = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]).reshape(k, k) / self.n + l2 * np.eye(k)
        return (value if math.isfinite(value) else math.inf), grad, hess

    def _direction(self, beta, grad, hess) -> np.ndarray:
        """The step to the least of the quadratic model with the absolute values, a coordinate at a time."""
        move, l1 = np.zeros(len(beta)), self.penalty * self.l1_ratio
        for _ in range(1000):
            most = 0.0
            for i in range(len(beta)):
                if hess[i, i] <= 1e-15:
                    continue
                slope = grad[i] + hess[i] @ move
                to = soft(beta[i] + move[i] - slope / hess[i, i], l1 / hess[i, i]) - beta[i]
                most, move[i] = max(most, abs(to - move[i])), to
            if most < 1e-12:
                break
        return move

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``risk``, the hazard over that of a row of means; higher is shorter."""
        w = self.beta / self.sd
        return df.withColumn("risk", F.exp(dot(self.features, w, -float(w @ self.mean))))

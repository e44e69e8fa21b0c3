"""Logistic-regression baseline on case features.

Features are one aggregation per case.  The fit takes Newton steps (iteratively
reweighted least squares): cases with equal features and label are one weighted
pattern, and a step needs one aggregation over the patterns, the gradient and
the 12 x 12 Gram matrix.  Scoring is a column expression with the fitted numbers
as literals.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgefuse.operators.steps import last_non_null

CHANNELS = ("E1_gui", "E2_code", "E4_noresp")
FEATURES = tuple(f"{c}_{s}" for c in CHANNELS for s in ("mean", "max", "sum")) + ("step_count", "agent_score")


@dataclass
class LRParams:
    coefficients: dict[str, float]
    intercept: float
    scaler_mean: list[float]
    scaler_scale: list[float]
    C: float = 1.0
    class_weight: str = "balanced"
    classes: list[int] = field(default_factory=lambda: [0, 1])

    def to_json(self) -> str:
        return json.dumps(self.__dict__, indent=2)

    @classmethod
    def from_json(cls, text: str) -> "LRParams":
        return cls(**json.loads(text))


def case_features(steps: DataFrame, agent: str = "agent", label: str = "phi", extra: tuple[str, ...] = ()) -> DataFrame:
    """mean/max/sum of the binary channels, step count, last agent score
    and last label per case; NULL features -> 0 (label stays NULL).  Columns of
    ``extra`` are the same in all rows of a case (its split)."""
    aggs = []
    for c in CHANNELS:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"), F.sum(c).alias(f"{c}_sum")]
    out = steps.groupBy("test_case_id").agg(
        *aggs, F.count(F.lit(1)).cast("double").alias("step_count"),
        last_non_null(agent).alias("agent_score"), last_non_null(label).alias("label"), *[F.first(c).alias(c) for c in extra])
    return out.select("test_case_id", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES],
                      F.col("agent_score").alias("agent_raw"), "label", *extra)


def class_balance(features: DataFrame) -> DataFrame:
    """Per class count and balanced weight n / (2 · n_c) (labelled cases)."""
    lab = features.filter(F.col("label").isNotNull())
    from pyspark.sql import Window
    counts = lab.groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))
    # the window spans the per-class table only (one row per class)
    n = F.sum("n_c").over(Window.partitionBy())
    return counts.select("label", "n_c", (n / (F.lit(2.0) * F.col("n_c"))).alias("class_weight"))


def scaler_stats(features: DataFrame) -> DataFrame:
    """Per feature mean and population std (zero std -> 1), one row."""
    return features.filter(F.col("label").isNotNull()).agg(*_scaler_aggs())


def _scaler_aggs() -> list[Column]:
    aggs = []
    for f in FEATURES:
        sd = F.stddev_pop(f)
        aggs += [F.avg(f).alias(f"{f}__mean"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"{f}__scale")]
    return aggs


def _z(params: LRParams) -> Column:
    z = F.lit(float(params.intercept))
    for f, m, s in zip(FEATURES, params.scaler_mean, params.scaler_scale):
        z = z + F.lit(float(params.coefficients[f])) * ((F.col(f) - F.lit(float(m))) / F.lit(float(s)))
    return z


def score(features: DataFrame, params: LRParams) -> DataFrame:
    """Case probabilities from params (sigmoid of the scaled linear
    score).  P_case_AgentFail is P(label = 1) (Q25)."""
    p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-_z(params)))
    return features.select(
        F.col("test_case_id").alias("case_id"), F.col("label").cast("int").alias("human_gt"),
        F.when(F.col("agent_raw").isNotNull(), F.col("agent_raw").cast("int").cast("double")).alias("agent_original"),
        (F.lit(1.0) - p1).alias("P_case_EnvFail"), p1.alias("P_case_AgentFail"))


def fit(features: DataFrame, C: float = 1.0, max_iter: int = 50, tol: float = 1e-10) -> LRParams:
    """L2 logistic regression with balanced class weights on
    standardised features (population std): C·Σ wᵢ·lossᵢ + ½‖β‖² is minimised, the
    intercept is free.

    Newton steps, halved while the objective rises, until no coefficient moves
    by ``tol``; raises if ``max_iter`` rounds do not get there, and if there are
    not both classes.
    """
    from judgefuse.session import checkpoint_dir

    # The labelled cases are reduced once to their distinct patterns; every round reads these.
    checkpoint_dir(features.sparkSession)
    patterns = (features.filter(F.col("label").isNotNull())
                .groupBy(*FEATURES, F.col("label").cast("double").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
                .checkpoint(eager=True))
    first = patterns.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("n"))), F.lit(0.0)).alias("n1"),
                         *[(F.sum(F.col(f) * F.col("n")) / F.sum("n")).alias(f) for f in FEATURES]).first()
    n, n1 = first["n"] or 0.0, first["n1"]
    if not 0 < n1 < n:
        raise ValueError("the fit needs labelled cases of both classes")
    mean = [float(first[f]) for f in FEATURES]
    second = patterns.agg(*[(F.sum(F.col("n") * (F.col(f) - F.lit(m)) * (F.col(f) - F.lit(m))) / F.lit(n)).alias(f)
                            for f, m in zip(FEATURES, mean)]).first()
    scale = [float(second[f]) ** 0.5 or 1.0 for f in FEATURES]
    beta = _newton(patterns, mean, scale, (n / (2.0 * (n - n1)), n / (2.0 * n1)), C, max_iter, tol)
    return LRParams(dict(zip(FEATURES, beta[:-1].tolist())), float(beta[-1]), mean, scale, C)


def _newton(patterns: DataFrame, mean: list[float], scale: list[float], weights: tuple[float, float],
            C: float, max_iter: int, tol: float) -> np.ndarray:
    """Coefficients (the intercept last).  A round is one aggregation: every pattern
    gives its loss, its part of the gradient and its outer product by place, and
    the parts of a place are summed before the shuffle."""
    k = len(FEATURES) + 1
    z = F.array(*[(F.col(f) - F.lit(m)) / F.lit(s) for f, m, s in zip(FEATURES, mean, scale)], F.lit(1.0))
    w = F.col("n") * F.when(F.col("y") == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    base = patterns.select(z.alias("z"), "y", w.alias("w"))
    ridge = np.diag([1.0] * (k - 1) + [0.0])
    beta, last, held = np.zeros(k), np.zeros(k), np.inf
    for _ in range(max_iter):
        b = "array(" + ", ".join(f"{float(v)!r}D" for v in beta) + ")"
        rows = base.selectExpr("z", "y", "w", f"aggregate(zip_with(z, {b}, (a, b) -> a * b), 0D, (s, x) -> s + x) AS m")
        rows = rows.selectExpr("z", "y", "w", "m", "1D / (1D + exp(-m)) AS p", "log1p(exp(-abs(m))) + greatest(m, 0D) - y * m AS loss")
        rows = rows.selectExpr("z", "w * p * (1D - p) AS h", "w * (p - y) AS g", "w * loss AS l", "posexplode(z) AS (i, a)")
        rows = rows.selectExpr("i", "a", "h", "g", "l", "posexplode(z) AS (j, b)").filter("i <= j")
        gram, slope, loss = np.zeros((k, k)), np.zeros(k), 0.0
        for r in rows.groupBy("i", "j").agg(F.expr("sum(h * a * b) AS h"), F.expr("sum(g * a) AS g"), F.expr("sum(l) AS l")).collect():
            gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = C * r["h"]
            if r["i"] == r["j"]:
                slope[r["i"]], loss = C * r["g"], C * r["l"]
        value = loss + 0.5 * float(beta @ ridge @ beta)
        if value > held * (1 + 1e-12):           # too far: halve the last step
            beta = (beta + last) / 2
            continue
        step = np.linalg.solve(gram + ridge, slope + ridge @ beta)
        last, held, beta = beta, value, beta - step
        if np.abs(step).max() < tol:
            return beta
    raise RuntimeError(f"the logistic fit did not settle in {max_iter} rounds")


def optimality(features: DataFrame, params: LRParams) -> dict[str, float]:
    """Gradient of the penalised loss at ``params``, per labelled case: zero for
    every feature (and the intercept) at the optimum.  One aggregation."""
    lab = features.filter(F.col("label").isNotNull())
    counts = lab.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n1")).first()
    n, n1 = counts["n"], counts["n1"]
    w = F.when(F.col("label") == 1, F.lit(n / (2.0 * n1) if n1 else 1.0)).otherwise(F.lit(n / (2.0 * (n - n1)) if n > n1 else 1.0))
    gap = w * (F.lit(1.0) / (F.lit(1.0) + F.exp(-_z(params))) - F.col("label"))
    sums = lab.agg(F.sum(gap).alias("intercept"), *[
        F.sum(gap * (F.col(f) - F.lit(m)) / F.lit(s)).alias(f)
        for f, m, s in zip(FEATURES, params.scaler_mean, params.scaler_scale)]).first()
    out = {f: (params.C * sums[f] + params.coefficients[f]) / n for f in FEATURES}
    return out | {"intercept": params.C * sums["intercept"] / n}


def save_params(spark: SparkSession, p: LRParams, path: str) -> None:
    """One JSON document written through Spark (shared storage)."""
    spark.createDataFrame([(p.to_json(),)], "params string").coalesce(1).write.mode("overwrite").text(path)


def load_params(spark: SparkSession, path: str) -> LRParams:
    return LRParams.from_json(spark.read.text(path, wholetext=True).first()[0])


def correct(scored: DataFrame, tau_agentfail: float = 0.75, tau_envfail: float = 0.75) -> DataFrame:
    """The threshold rule of H9 with one τ_env for both verdicts."""
    from judgefuse.operators.cases import correct_threshold
    return correct_threshold(scored, tau_agentfail, tau_envfail, tau_envfail)

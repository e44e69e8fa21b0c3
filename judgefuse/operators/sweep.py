"""Parameter sweep over the correction rules (H17) and its ranking.

Re-aimed from a process-per-point runner.  The noisy-or products of a case are
taken once: a power of the product is the product of the powers, so one product
per verdict variant serves every alpha.  A case's probabilities only matter by
which thresholds they reach, so cases are counted by (verdict, truth, alpha,
thresholds reached); that table is bounded by the grid, not by the data, and the
grid is expanded on it.  Several models (parameter sets with their weights) are
products of one aggregation over the steps.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import product as cartesian

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgefuse.operators import cases as C
from judgefuse.operators import em as EM
from judgefuse.operators.model import ChannelWeights, EMParams
from judgefuse.operators.steps import last_non_null

GRID_COLS = ("tau_agentfail", "tau_envfail", "tau_envfail_high", "alpha")


def make_grid(tau_agentfail: list[float], tau_envfail: list[float], alpha: list[float],
              tau_envfail_high: list[float] | None = None) -> list[tuple]:
    """Grid points; without ``tau_envfail_high`` it equals tau_envfail at every point."""
    if tau_envfail_high is None:
        return [(float(a), float(e), float(e), float(x)) for a, e, x in cartesian(tau_agentfail, tau_envfail, alpha)]
    return [tuple(map(float, p)) for p in cartesian(tau_agentfail, tau_envfail, tau_envfail_high, alpha)]


def case_products(steps: DataFrame, models: Mapping[str, tuple[EMParams, ChannelWeights]]) -> DataFrame:
    """Per model and case: P_case_EnvFail at alpha 1 (the product over its steps), verdict, truth."""
    aggs, names = [], list(models)
    for m, (params, weights) in enumerate(models.values()):
        for v, c in enumerate(C.VARIANTS):
            post, _ = C._posterior_cols(params, weights, c)
            q = sum(post[1:], F.lit(0.0)) if params.k > 2 else post[1]
            aggs.append(F.product(F.lit(1.0) - F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0))).alias(f"_p{m}_{v}"))
    agg = steps.groupBy("test_case_id").agg(
        last_non_null("agent").alias("agent_original"), last_non_null("phi").alias("human_gt"), *aggs)
    c = F.col("agent_original")
    rows = F.array(*[F.struct(F.lit(n).alias("model"), F.when(c == 1.0, F.col(f"_p{m}_2")).when(c == 0.0, F.col(f"_p{m}_1"))
                              .otherwise(F.col(f"_p{m}_0")).alias("env")) for m, n in enumerate(names)])
    return agg.select("test_case_id", "agent_original", "human_gt", F.inline(rows))


def reached(value: Column, thresholds: list[float]) -> Column:
    """How many of the ascending thresholds the value reaches."""
    return sum(((value >= F.lit(t)).cast("int") for t in thresholds), F.lit(0))


def sweep_models(steps: DataFrame, models: Mapping[str, tuple[EMParams, ChannelWeights]], grid: list[tuple],
                 split: str | None = None) -> DataFrame:
    """Per model, grid point (and value of the ``split`` column): accuracy
    before and after the threshold rule, misflips in subset A and corrections in
    subset B with 4-decimal rates.  Cases without ground truth are left out."""
    if split is not None:
        of = steps.groupBy("test_case_id").agg(F.min(split).alias("split"))
        cases = case_products(steps, models).join(of, "test_case_id")
    else:
        cases = case_products(steps, models).withColumn("split", F.lit("all"))
    agents, envs = sorted({g[0] for g in grid}), sorted({x for g in grid for x in g[1:3]})
    alphas = sorted({g[3] for g in grid})
    cases = cases.filter(F.col("human_gt").isNotNull()).withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    env = F.pow(F.col("env"), F.col("alpha"))
    table = cases.groupBy("split", "model", "agent_original", "human_gt", "alpha", reached(F.lit(1.0) - env, agents).alias("ra"),
                          reached(env, envs).alias("re")).agg(F.count(F.lit(1)).alias("n"))
    points = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(g, GRID_COLS)], F.lit(agents.index(g[0]) + 1).alias("na"),
                                F.lit(envs.index(g[1]) + 1).alias("ne"), F.lit(envs.index(g[2]) + 1).alias("nh")) for g in grid])
    x = table.withColumnRenamed("alpha", "at").select("*", F.inline(points)).filter("at = alpha")
    c, gt, n = F.col("agent_original"), F.col("human_gt"), F.col("n")
    label = (F.when((c == 0.0) & (F.col("ra") >= F.col("na")), F.lit(1)).when((c == 0.0) & (F.col("re") >= F.col("ne")), F.lit(0))
              .when((c == 1.0) & (F.col("re") >= F.col("nh")), F.lit(0)).otherwise(c.cast("int")))
    before, after = F.coalesce(c == gt, F.lit(False)), F.coalesce(label == gt, F.lit(False))
    flipped = ~F.coalesce(c == label, F.lit(False))
    count = lambda cond: F.sum(F.when(cond, n).otherwise(F.lit(0))).cast("long")
    agg = x.groupBy("split", "model", *GRID_COLS).agg(
        F.sum("n").alias("n_cases"), count(before).alias("_b"), count(after).alias("_a"),
        count(before).alias("subset_a_total"), count(before & flipped).alias("misflip_count"),
        count(~before).alias("subset_b_total"), count(~before & after).alias("correction_count"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(F.lit(0.0))
    return agg.select(
        "split", "model", *GRID_COLS, "n_cases",
        F.try_divide("_b", "n_cases").alias("acc_original"), F.try_divide("_a", "n_cases").alias("acc_correct"),
        "subset_a_total", "misflip_count", rate("misflip_count", "subset_a_total").alias("misflip_rate"),
        "subset_b_total", "correction_count", rate("correction_count", "subset_b_total").alias("correction_rate"))


def sweep_thresholds(steps: DataFrame, params: EMParams, weights: ChannelWeights, grid: list[tuple]) -> DataFrame:
    """H17 for one model."""
    return sweep_models(steps, {"m": (params, weights)}, grid).drop("split", "model")


def refit(train: DataFrame, configs: Mapping[str, EM.EMConfig]) -> dict[str, tuple[EMParams, ChannelWeights]]:
    """One fit per configuration (channel and verdict weights, temperature) on the
    same cells: the training steps are aggregated once."""
    cells = EM.collect_cells(EM.em_cells(train))
    return {name: (EM.fit_cells(cells, cfg).params, cfg.weights) for name, cfg in configs.items()}


def top_k(results: DataFrame, k: int = 5, metric: str = "acc_correct") -> DataFrame:
    """best k grid points by ``metric`` (desc), full parameter tie-break."""
    ties = [c for c in ("model", *GRID_COLS) if c in results.columns]
    return results.orderBy(F.col(metric).desc(), *[F.col(c).asc() for c in ties]).limit(k)

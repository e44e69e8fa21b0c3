"""Step scoring and case aggregation: E1, D11, H5, H7, E8, E9, H8, H9, H10.

Plans are built so that a single case holding a large share of all rows
never lands whole in one task: case-level values are computed with
map-side-combinable aggregates (``max_by``, ``sum``, ``product``), and the
per-case agent verdict is folded into the aggregation instead of being joined
back onto the steps (the agent channel only adds a per-case constant to the
logits, and the verdict takes three values: NULL, 0, 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgefuse.operators.model import (EPS, ChannelWeights, EMParams, agent_logit,
                                       softmax_eps, step_base_logits)
from judgefuse.operators.steps import evidence_e, evidence_m, last_non_null
from judgefuse.session import checkpoint_dir

HOT_SHARE = 1000  # a case with more than this share of all steps is hot
VARIANTS = (None, 0.0, 1.0)  # case verdict C: unknown, FAIL, PASS


def case_last_values(steps: DataFrame, cols=("agent", "delta", "phi")) -> DataFrame:
    """Last non-null value per case for each column (one partial agg)."""
    return steps.groupBy("test_case_id").agg(
        *[last_non_null(c).alias(c) for c in cols])


def case_value_broadcast(steps: DataFrame, cols=("agent", "delta")) -> DataFrame:
    """Copy each case's last non-null value onto all of its steps.

    The values are one partial aggregation.  Cases with more than one step in
    ``HOT_SHARE`` are fewer than ``HOT_SHARE``, so their values are broadcast
    whatever the size of the data; the steps of all other cases are joined by
    key, where no key is hot.
    """
    cv = steps.groupBy("test_case_id").agg(
        F.count(F.lit(1)).alias("_n"), *[last_non_null(c).alias(f"{c}_case") for c in cols])
    checkpoint_dir(steps.sparkSession)
    cv = cv.checkpoint()
    limit = (cv.agg(F.sum("_n")).first()[0] or 0) / HOT_SHARE
    hot, rest = cv.filter(F.col("_n") > limit).drop("_n"), cv.filter(F.col("_n") <= limit).drop("_n")
    few = steps.join(F.broadcast(hot), "test_case_id")
    many = steps.join(F.broadcast(hot.select("test_case_id")), "test_case_id", "left_anti").join(rest, "test_case_id", "left")
    return few.unionByName(many)


def _posterior_cols(params: EMParams, weights: ChannelWeights, c: float | None,
                    masked: bool = True) -> tuple[list[Column], Column]:
    base = step_base_logits(params, weights.w, evidence_e(),
                            evidence_m() if masked else None)
    logits = []
    for d in range(params.k):
        l = F.lit(float(_log_prior(params, d))) + base[d]
        if c is not None:
            l = l + F.lit(agent_logit(params, d, c, weights.agent_weight))
        logits.append(l)
    return softmax_eps(logits)


def _log_prior(params: EMParams, d: int) -> float:
    import math
    return math.log(params.p_delta[d] + EPS)


def _posterior_with_c(params: EMParams, weights: ChannelWeights, c: Column) -> list[Column]:
    """Posterior per cause where the agent constant is chosen by column c."""
    base = step_base_logits(params, weights.w, evidence_e(), evidence_m())
    logits = []
    for d in range(params.k):
        a = (F.when(c == F.lit(1.0), F.lit(agent_logit(params, d, 1.0, weights.agent_weight)))
              .when(c == F.lit(0.0), F.lit(agent_logit(params, d, 0.0, weights.agent_weight)))
              .otherwise(F.lit(0.0)))
        logits.append(F.lit(_log_prior(params, d)) + base[d] + a)
    post, _ = softmax_eps(logits)
    return post


def step_posterior(steps: DataFrame, params: EMParams,
                   weights: ChannelWeights = ChannelWeights()) -> DataFrame:
    """H5 / H7: P(cause | step evidence, case verdict), masks applied, no temperature.

    Output: test_case_id, ord, step, P_<cause> for every cause, and for K > 2
    also P_AgentFail = Σ agent causes.
    """
    return _posterior_rows(case_value_broadcast(steps, ("agent",)), params, weights)


def step_posterior_of(steps: DataFrame, scored: DataFrame, params: EMParams,
                      weights: ChannelWeights = ChannelWeights()) -> DataFrame:
    """``step_posterior`` with the verdicts of a scored case table (case_id, agent_original),
    so that cases are not aggregated again.  One exchange of the steps; where
    ``scored`` was written before, a hot case's part of it can be split."""
    verdicts = scored.select(F.col("case_id").alias("test_case_id"), F.col("agent_original").alias("agent_case"))
    return _posterior_rows(steps.join(verdicts, "test_case_id", "left"), params, weights)


def _posterior_rows(s: DataFrame, params: EMParams, weights: ChannelWeights) -> DataFrame:
    post = _posterior_with_c(params, weights, F.col("agent_case"))
    out = [F.col("test_case_id"), F.col("ord"), F.col("step")]
    out += [p.alias(f"P_{name}") for p, name in zip(post, params.causes)]
    if params.k > 2:
        out.append(sum(post[1:], F.lit(0.0)).alias("P_AgentFail"))
    return s.select(*out)


def case_noisy_or(steps: DataFrame, params: EMParams,
                  weights: ChannelWeights = ChannelWeights(),
                  alpha: float = 0.75) -> DataFrame:
    """P_case_AgentFail = 1 − Π (1 − clip(q))^α over the case's steps.

    q is the step posterior of the agent causes.  All three verdict variants
    are accumulated in one aggregation and the right one is picked per case.
    ``product`` skips NULLs and keeps exact zeros (Q10).
    """
    agg = case_noisy_or_multi(steps, params, weights, [alpha])
    return agg.select("case_id", "human_gt", "agent_original",
                      (F.lit(1.0) - F.col("_pa0")).alias("P_case_EnvFail"),
                      F.col("_pa0").alias("P_case_AgentFail"))


def case_noisy_or_multi(steps: DataFrame, params: EMParams, weights: ChannelWeights,
                        alphas: list[float]) -> DataFrame:
    """E8 for several α in one aggregation: columns _pa<i> = P_case_AgentFail(α_i)."""
    qs = []
    for c in VARIANTS:
        post, _ = _posterior_cols(params, weights, c)
        q = sum(post[1:], F.lit(0.0)) if params.k > 2 else post[1]
        qs.append(F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)))
    prods = [F.product(F.pow(F.lit(1.0) - q, F.lit(float(a)))).alias(f"_p{i}_{j}")
             for j, a in enumerate(alphas) for i, q in enumerate(qs)]
    agg = steps.groupBy("test_case_id").agg(
        last_non_null("agent").alias("agent_original"),
        last_non_null("phi").alias("human_gt"),
        *prods)
    out = [F.col("test_case_id").alias("case_id"), "human_gt", "agent_original"]
    for j in range(len(alphas)):
        chosen = (F.when(F.col("agent_original") == 1.0, F.col(f"_p2_{j}"))
                   .when(F.col("agent_original") == 0.0, F.col(f"_p1_{j}"))
                   .otherwise(F.col(f"_p0_{j}")))
        out.append((F.lit(1.0) - chosen).alias(f"_pa{j}"))
    return agg.select(*out)


def case_bayes(steps: DataFrame, params: EMParams) -> DataFrame:
    """Full Bayes per case — Σ unmasked channel log-likelihoods (no channel
    weights), the verdict channel once, log prior; max-shifted softmax.

    Output: case_id, human_gt, agent_original, P_case_<cause> per cause and,
    for K > 2, P_case_AgentFail = Σ agent causes.
    """
    base = step_base_logits(params, None, evidence_e(), evidence_m())
    agg = steps.groupBy("test_case_id").agg(
        last_non_null("agent").alias("agent_original"),
        last_non_null("phi").alias("human_gt"),
        *[F.sum(b).alias(f"_ll{d}") for d, b in enumerate(base)])
    import math
    logits = []
    for d in range(params.k):
        psi = params.psi[d]
        cterm = (F.when(F.col("agent_original") == 1.0, F.lit(math.log(psi + EPS)))
                  .when(F.col("agent_original") == 0.0, F.lit(math.log(1 - psi + EPS)))
                  .otherwise(F.lit(0.0)))
        logits.append(F.lit(_log_prior(params, d)) + F.coalesce(F.col(f"_ll{d}"), F.lit(0.0)) + cterm)
    mx = F.greatest(*logits)
    ex = [F.exp(l - mx) for l in logits]
    tot = sum(ex[1:], ex[0])
    post = [e / tot for e in ex]
    out = [F.col("test_case_id").alias("case_id"), "human_gt", "agent_original"]
    out += [p.alias(f"P_case_{c}") for p, c in zip(post, params.causes)]
    if params.k > 2:
        out.append(sum(post[1:], F.lit(0.0)).alias("P_case_AgentFail"))
    return agg.select(*out)


def correct_threshold(cases: DataFrame, tau_agentfail: float = 0.7,
                      tau_envfail: float = 0.7, tau_envfail_high: float = 0.7) -> DataFrame:
    """H9: verdict 0 → flip to 1 if P_agent ≥ τ_a, else keep_EnvFail if
    P_env ≥ τ_e; verdict 1 → flip to 0 if P_env ≥ τ_eh; otherwise keep."""
    c, pa, pe = F.col("agent_original"), F.col("P_case_AgentFail"), F.col("P_case_EnvFail")
    label = (F.when((c == 0.0) & (pa >= tau_agentfail), F.lit(1))
              .when((c == 0.0) & (pe >= tau_envfail), F.lit(0))
              .when((c == 1.0) & (pe >= tau_envfail_high), F.lit(0))
              .otherwise(c.cast("int")))
    action = (F.when((c == 0.0) & (pa >= tau_agentfail), F.lit("flip_to_AgentFail"))
               .when((c == 0.0) & (pe >= tau_envfail), F.lit("keep_EnvFail"))
               .when((c == 1.0) & (pe >= tau_envfail_high), F.lit("flip_to_EnvFail"))
               .otherwise(F.lit("keep_AgentJudge")))
    return cases.withColumn("corrected_label", label).withColumn("action", action)


def correct_margin(cases: DataFrame, margin: float = 0.0,
                   agent_causes: list[str] | None = None) -> DataFrame:
    """H8 (+H10 when ``agent_causes`` has more than one entry).

    NULL verdict → argmax (from_model); 0 flips when P_agent > P_env + margin;
    1 flips when P_env > P_agent + margin.  With several agent causes the flip
    action and ``agent_fail_type`` name the larger agent cause, and the type is
    NULL whenever the corrected label is 0.
    """
    c, pa, pe = F.col("agent_original"), F.col("P_case_AgentFail"), F.col("P_case_EnvFail")
    m = F.lit(float(margin))
    label = (F.when(c.isNull(), F.when(pa >= pe, F.lit(1)).otherwise(F.lit(0)))
              .when(c == 0.0, F.when(pa > pe + m, F.lit(1)).otherwise(F.lit(0)))
              .otherwise(F.when(pe > pa + m, F.lit(0)).otherwise(F.lit(1))))
    multi = agent_causes is not None and len(agent_causes) > 1
    if multi:
        cols = [F.col(f"P_case_{a}") for a in agent_causes]
        best = F.lit(agent_causes[-1])
        # first maximum wins, as argmax does
        for i in range(len(agent_causes) - 2, -1, -1):
            others = [cols[j] for j in range(len(agent_causes)) if j > i]
            cond = cols[i] >= F.greatest(*others) if len(others) > 1 else cols[i] >= others[0]
            best = F.when(cond, F.lit(agent_causes[i])).otherwise(best)
        flip_name = F.concat(F.lit("flip_to_"), best)
    else:
        best = None
        flip_name = F.lit("flip_to_AgentFail")
    action = (F.when(c.isNull(), F.lit("from_model"))
               .when(c == 0.0, F.when(pa > pe + m, flip_name)
                     .otherwise(F.lit("keep_EnvFail_or_AgentFail")))
               .otherwise(F.when(pe > pa + m, F.lit("flip_to_EnvFail"))
                          .otherwise(F.lit("keep_AgentJudge"))))
    out = cases.withColumn("corrected_label", label).withColumn("action", action)
    if multi:
        out = out.withColumn("agent_fail_type",
                             F.when(F.col("corrected_label") == 1, best))
    return out

"""Registered queries: normalisation, scoring, case aggregation, correction,
quality metrics (C1-C5, D11, E1, H5, H7, E8, E9, H8-H10, E3, E4, E7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from judgefuse.functions import evidence as ev
from judgefuse.operators import cases as C
from judgefuse.operators import metrics as M
from judgefuse.operators.model import RUN_WEIGHTS
from judgefuse.plans import fixtures as fx
from judgefuse.plans import oracle as O
from judgefuse.plans.registry import register

P, P3, W = fx.LIT_PARAMS, fx.LIT_PARAMS_K3, RUN_WEIGHTS
TA, TE, TEH = fx.TAU_AGENTFAIL, fx.TAU_ENVFAIL, fx.TAU_ENVFAIL_HIGH
ALPHA = 0.75


def scored_cases(spark, sf):
    return C.correct_threshold(C.case_noisy_or(fx.steps(spark, sf), P, W, ALPHA), TA, TE, TEH)


def _cases_sql_ctes(params=P):
    return [O.STEPS_RAW, O.CASE_VALUES, O.posterior_ctes(params, W.w, W.agent_weight),
            O.noisy_or_cases_sql(params, W.w, W.agent_weight, ALPHA)]


_LABEL, _ACTION = O.threshold_rule_sql(TA, TE, TEH)
CORRECTED_SQL = (O.with_ctes(*_cases_sql_ctes()) +
                 f", corrected AS (SELECT *, {_LABEL} AS corrected_label, {_ACTION} AS action FROM cases)")


# ---- C1-C4: raw evidence with out-of-range values -> normalised ------------
def _raw_evidence(spark, sf):
    e = fx.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("ord"),
        (F.col("value") / 50.0).alias("gui_raw"),
        (F.when(k % 7 == 0, F.lit(float("nan"))).otherwise((k % 10) / 9.0)).alias("code_raw"),
        (k % 10 / 10.0).alias("mask_raw"),
        (F.col("value") / 5.0 - 2.0).alias("weight_raw"),
        F.when(F.col("event_type").isin("purchase", "error"), k / 100.0).alias("agent_raw"))


@register("binarize_mask_weight", doubles=("e_gui", "e_code", "weight", "agent"), ops="C1 C2 C3 C4", sql="""
SELECT event_id AS ord,
  CASE WHEN least(greatest(value / 50.0, 0.0), 1.0) >= 0.5 THEN 1.0 ELSE 0.0 END AS e_gui,
  CASE WHEN k % 7 = 0 THEN 0.0 WHEN least(greatest((k % 10) / 9.0, 0.0), 1.0) >= 0.5 THEN 1.0 ELSE 0.0 END AS e_code,
  CASE WHEN (k % 10) / 10.0 >= 0.5 THEN 1 ELSE 0 END AS m,
  least(greatest(value / 5.0 - 2.0, 0.0), 10.0) AS weight,
  CASE WHEN event_type IN ('purchase', 'error') THEN (CASE WHEN k / 100.0 >= 0.5 THEN 1.0 ELSE 0.0 END) END AS agent
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def q_binarize(spark, sf):
    r = _raw_evidence(spark, sf)
    return r.select("ord", ev.binarize("gui_raw").alias("e_gui"), ev.binarize("code_raw").alias("e_code"),
                    ev.mask(F.col("mask_raw")).alias("m"), ev.clip_weight(F.col("weight_raw")).alias("weight"),
                    ev.agent_score("agent_raw").alias("agent"))


# ---- C5: delta label from strings and numbers --------------------------------
_DELTA_WORDS = ["EnvFail", " agent ", "1", "2", "ENV_timeout", "AgentRetry", "unknown"]


@register("delta_normalise", doubles=("delta_s", "delta_n"), ops="C5", sql="""
SELECT event_id AS ord,
  CASE WHEN lower(trim(s)) LIKE 'env%' THEN 0.0 WHEN lower(trim(s)) LIKE 'agent%' THEN 1.0 END AS delta_s,
  CASE WHEN n IN (0.0, 1.0) THEN n END AS delta_n
FROM (SELECT event_id,
        list_extract(['EnvFail', ' agent ', '1', '2', 'ENV_timeout', 'AgentRetry', 'unknown'], CAST(event_id % 7 AS INTEGER) + 1) AS s,
        CAST(event_id % 3 AS DOUBLE) AS n
      FROM events)""")
def q_delta(spark, sf):
    e = fx.table(spark, sf, "events")
    words = F.array(*[F.lit(w) for w in _DELTA_WORDS])
    r = e.select(F.col("event_id").alias("ord"),
                 F.element_at(words, (F.col("event_id") % 7 + 1).cast("int")).alias("s"),
                 (F.col("event_id") % 3).cast("double").alias("n"))
    return r.select("ord", ev.delta_label("s", r.schema["s"].dataType).alias("delta_s"),
                    ev.delta_label("n", r.schema["n"].dataType).alias("delta_n"))


# ---- E1 / D11 -----------------------------------------------------------------
@register("case_last_value", doubles=("agent", "delta"), ops="E1", sql=O.with_ctes(O.STEPS_RAW, O.CASE_VALUES) + """
SELECT test_case_id, c_case AS agent, delta_case AS delta, gt_case AS phi FROM case_vals""")
def q_case_last(spark, sf):
    return C.case_last_values(fx.steps(spark, sf))


@register("case_value_broadcast", doubles=("agent_case", "delta_case"), ops="D11",
          sql=O.with_ctes(O.STEPS_RAW, O.CASE_VALUES) + """
SELECT s.test_case_id, s.ord, v.c_case AS agent_case, v.delta_case AS delta_case
FROM steps s LEFT JOIN case_vals v USING (test_case_id)""")
def q_case_bcast(spark, sf):
    return C.case_value_broadcast(fx.steps(spark, sf)).select(
        "test_case_id", "ord", "agent_case", "delta_case")


# ---- H5 / H7: step posterior ---------------------------------------------------
@register("step_posterior", doubles=("P_EnvFail", "P_AgentFail"), ops="H5",
          sql=O.with_ctes(O.STEPS_RAW, O.CASE_VALUES, O.posterior_ctes(P, W.w, W.agent_weight)) + """
SELECT test_case_id, ord, step, p0 AS P_EnvFail, p1 AS P_AgentFail FROM step_post""")
def q_step_posterior(spark, sf):
    return C.step_posterior(fx.steps(spark, sf), P, W)


@register("step_posterior_k3", doubles=("P_EnvFail", "P_AgentRetryFail", "P_AgentReasoningFail", "P_AgentFail"),
          ops="H7", sql=O.with_ctes(O.STEPS_RAW, O.CASE_VALUES, O.posterior_ctes(P3, W.w, W.agent_weight)) + """
SELECT test_case_id, ord, step, p0 AS P_EnvFail, p1 AS P_AgentRetryFail, p2 AS P_AgentReasoningFail,
       p_agent AS P_AgentFail FROM step_post""")
def q_step_posterior_k3(spark, sf):
    return C.step_posterior(fx.steps(spark, sf), P3, W)


# ---- E8 + H9 (slice 1) ---------------------------------------------------------------
@register("case_noisy_or", doubles=("agent_original", "P_case_EnvFail", "P_case_AgentFail"), ops="E8",
          sql=O.with_ctes(*_cases_sql_ctes()) + " SELECT * FROM cases")
def q_noisy_or(spark, sf):
    return C.case_noisy_or(fx.steps(spark, sf), P, W, ALPHA)


@register("correct_threshold", doubles=("agent_original", "P_case_EnvFail", "P_case_AgentFail"), ops="H9",
          sql=CORRECTED_SQL + " SELECT * FROM corrected")
def q_correct_threshold(spark, sf):
    return scored_cases(spark, sf)


@register("accuracy", doubles=("acc_before", "acc_after"), ops="E3", sql=CORRECTED_SQL + """
SELECT count(*) AS n_cases,
       count(*) FILTER (WHERE agent_original = human_gt) / count(*) AS acc_before,
       count(*) FILTER (WHERE corrected_label = human_gt) / count(*) AS acc_after
FROM corrected WHERE human_gt IS NOT NULL""")
def q_accuracy(spark, sf):
    return M.accuracy(scored_cases(spark, sf))


@register("confusion", doubles=("accuracy",), ops="E4", sql=CORRECTED_SQL + """
SELECT count(*) FILTER (WHERE human_gt = 0 AND corrected_label = 0) AS gt0_pred0,
       count(*) FILTER (WHERE human_gt = 0 AND corrected_label = 1) AS gt0_pred1,
       count(*) FILTER (WHERE human_gt = 1 AND corrected_label = 0) AS gt1_pred0,
       count(*) FILTER (WHERE human_gt = 1 AND corrected_label = 1) AS gt1_pred1,
       count(*) FILTER (WHERE human_gt = corrected_label) / count(*) AS accuracy
FROM corrected WHERE human_gt IS NOT NULL AND corrected_label IS NOT NULL""")
def q_confusion(spark, sf):
    return M.confusion(scored_cases(spark, sf))


_FLAGS_SQL = CORRECTED_SQL + """,
flags AS (
  SELECT *, coalesce(human_gt = agent_original, false) AS is_correct_before,
         coalesce(human_gt = corrected_label, false) AS is_correct_after,
         NOT coalesce(agent_original = corrected_label, false) AS is_flipped
  FROM corrected)"""


@register("flip_analysis", doubles=("misflip_rate", "correct_rate"), ops="E7", sql=_FLAGS_SQL + """,
agg AS (
  SELECT count(*) FILTER (WHERE is_correct_before) AS subset_a,
         count(*) FILTER (WHERE is_correct_before AND is_flipped) AS misflipped,
         count(*) FILTER (WHERE is_correct_before AND agent_original = 0) AS subset_a_orig0,
         count(*) FILTER (WHERE is_correct_before AND is_flipped AND agent_original = 0) AS misflipped_orig0,
         count(*) FILTER (WHERE is_correct_before AND agent_original = 1) AS subset_a_orig1,
         count(*) FILTER (WHERE is_correct_before AND is_flipped AND agent_original = 1) AS misflipped_orig1,
         count(*) FILTER (WHERE NOT is_correct_before) AS subset_b,
         count(*) FILTER (WHERE NOT is_correct_before AND is_correct_after) AS corrected
  FROM flags)
SELECT *, CASE WHEN subset_a > 0 THEN misflipped / subset_a ELSE 0.0 END AS misflip_rate,
          CASE WHEN subset_b > 0 THEN corrected / subset_b ELSE 0.0 END AS correct_rate
FROM agg""")
def q_flip_analysis(spark, sf):
    return M.flip_analysis(scored_cases(spark, sf))


@register("flip_detail", doubles=("agent_original", "P_case_EnvFail", "P_case_AgentFail"), ops="E7",
          sql=_FLAGS_SQL + " SELECT * FROM flags WHERE is_correct_before AND is_flipped")
def q_flip_detail(spark, sf):
    f = M.flip_flags(scored_cases(spark, sf))
    return f.filter(F.col("is_correct_before") & F.col("is_flipped"))


# ---- E9 + H8 + H10 ---------------------------------------------------------------------
@register("case_bayes", doubles=("agent_original", "P_case_EnvFail", "P_case_AgentFail"), ops="E9",
          sql=O.with_ctes(O.STEPS_RAW, O.CASE_VALUES, O.bayes_cases_sql(P)) + " SELECT * FROM bcases")
def q_case_bayes(spark, sf):
    return C.case_bayes(fx.steps(spark, sf), P)


_ML, _MA = O.margin_rule_sql(0.0)


@register("correct_margin", doubles=("agent_original", "P_case_EnvFail", "P_case_AgentFail"), ops="H8",
          sql=O.with_ctes(O.STEPS_RAW, O.CASE_VALUES, O.bayes_cases_sql(P)) +
          f" SELECT *, {_ML} AS corrected_label, {_MA} AS action FROM bcases")
def q_correct_margin(spark, sf):
    return C.correct_margin(C.case_bayes(fx.steps(spark, sf), P), 0.0)


_best = ("(CASE WHEN P_case_AgentRetryFail >= P_case_AgentReasoningFail "
         "THEN 'AgentRetryFail' ELSE 'AgentReasoningFail' END)")
_ML3, _MA3 = O.margin_rule_sql(0.0, flip_name=f"concat('flip_to_', {_best})")


@register("agent_fail_type", ops="H10 H7",
          doubles=("agent_original", "P_case_EnvFail", "P_case_AgentRetryFail",
                   "P_case_AgentReasoningFail", "P_case_AgentFail"),
          sql=O.with_ctes(O.STEPS_RAW, O.CASE_VALUES, O.bayes_cases_sql(P3)) +
          f", k3 AS (SELECT *, {_ML3} AS corrected_label, {_MA3} AS action FROM bcases)"
          f" SELECT *, CASE WHEN corrected_label = 1 THEN {_best} END AS agent_fail_type FROM k3")
def q_agent_fail_type(spark, sf):
    cases = C.case_bayes(fx.steps(spark, sf), P3)
    return C.correct_margin(cases, 0.0, agent_causes=P3.causes[1:])
